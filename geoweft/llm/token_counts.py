"""Token totals maintained by signed deltas.

A batch of changes (inserts, deletes, revised counts) is combined into signed sums by source,
language and tokenizer version, and committed once: the batch's directory is renamed into
place, and a batch id that exists already is skipped, so a replay adds nothing. Totals are the
sums of all committed batches; ``compact`` folds them into one and removes what it folded. One
writer commits at a time. Tokenizer versions are patterns, counted by Spark itself, or tokenizer
files, counted by the encoder of this subpackage.

Null sources and languages are keys of their own. Null texts have no tokens but count as
documents. Repeated rows count as often as they occur. An empty table gives no totals. Very long
texts are counted whole; other columns, whatever their names, are not read. Documents' rows
are combined before any shuffle, so a hot source costs no more than another.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoweft.plans.lineage import cut, shared_dir

KEYS = ["source", "lang", "tokenizer"]
DELTA = "source string, lang string, tokenizer string, documents long, tokens long"
# Tokenizer versions that are counted by a pattern.
PATTERNS = {"words-1": r"[^\x20\x09-\x0D]+", "pieces-1": r"[\p{L}\p{N}]+|[^\x20\x09-\x0D\p{L}\p{N}]"}


def count_tokens(text: Column, version: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(PATTERNS[version])), F.lit(0)).cast("long")


def estimate(text: Column) -> Column:
    """A count before tokenizing: a quarter of the bytes."""
    return F.coalesce(F.ceil(F.octet_length(text) / 4), F.lit(0)).cast("long")


def _delta(rows: DataFrame, documents, tokens) -> DataFrame:
    return rows.select(*KEYS, documents.cast("long").alias("documents"), tokens.cast("long").alias("tokens"))


def inserts(rows: DataFrame, tokens: str = "tokens") -> DataFrame:
    return _delta(rows, F.lit(1), F.col(tokens))


def deletes(rows: DataFrame, tokens: str = "tokens") -> DataFrame:
    return _delta(rows, F.lit(-1), -F.col(tokens))


def revisions(rows: DataFrame, old: str, new: str) -> DataFrame:
    return _delta(rows, F.lit(0), F.col(new) - F.col(old))


class TokenRollup:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{path}/batches"))

    def _at(self, batch: str) -> str:
        return f"{self.path}/batches/batch={batch}"

    def committed(self) -> list[str]:
        found = self._fs.listStatus(self._path(f"{self.path}/batches"))
        return sorted(s.getPath().getName().partition("=")[2] for s in found)

    def _folded(self) -> set[str]:
        """Ids that a compaction has taken in."""
        base = [b for b in self.committed() if b.startswith("base-")]
        if not base:
            return set()
        rows = self.spark.read.text(f"{self.path}/folded/{base[-1]}").collect()  # one row per batch id
        return {r.value for r in rows}

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Add a batch; False if it was committed before."""
        if batch in self.committed() or batch in self._folded():
            return False
        staged = f"{self.path}/staged/{uuid.uuid4().hex}"
        sums = deltas.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        sums.where("documents <> 0 or tokens <> 0").write.parquet(staged)
        if not self._fs.rename(self._path(staged), self._path(self._at(batch))):
            raise OSError(f"batch {batch} can't be committed")
        return True

    def _deltas(self) -> DataFrame:
        ids = self.committed()
        base = [b for b in ids if b.startswith("base-")][-1:]
        folded = self._folded()
        paths = [self._at(b) for b in base + [b for b in ids if not b.startswith("base-") and b not in folded]]
        return self.spark.read.schema(DELTA).parquet(*paths) if paths else self.spark.createDataFrame([], DELTA)

    def totals(self) -> DataFrame:
        t = self._deltas().groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        return t.where("documents <> 0 or tokens <> 0")

    def compact(self) -> None:
        """Fold all batches into a new base; ids stay known. The list of ids is written first, and
        what is folded goes last: a failure on the way leaves totals as they were."""
        before = self.committed()
        ids = [b for b in before if not b.startswith("base-")]
        bases = [b for b in before if b.startswith("base-")]
        name = f"base-{int(bases[-1].partition('-')[2]) + 1 if bases else 0:06d}"
        known = sorted(self._folded() | set(ids))
        self.spark.createDataFrame([(b,) for b in known], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/folded/{name}")
        staged = f"{self.path}/staged/{uuid.uuid4().hex}"
        self.totals().write.parquet(staged)
        if not self._fs.rename(self._path(staged), self._path(self._at(name))):
            raise OSError(f"{name} can't be committed")
        for b in before:
            self._fs.delete(self._path(self._at(b)), True)
        for b in bases:
            self._fs.delete(self._path(f"{self.path}/folded/{b}"), True)


def with_file_counts(docs: DataFrame, files: dict[str, str]) -> DataFrame:
    """``docs`` with a column of token counts for each tokenizer file (version name to path)."""
    from geoweft.llm.bpe import tokenizer
    from geoweft.llm.textkit import pick, small_batches

    schema = T.StructType([*docs.schema.fields, *[T.StructField(v, T.LongType()) for v in files]])

    def run(batches):
        for batch in batches:
            texts = pick(batch, "text").to_pylist()
            counts = [pa.array([n for block in tokenizer(p).blocks(texts) for n in block.counts().tolist()], pa.int64()) for p in files.values()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *counts], schema.names)

    return small_batches(docs).mapInArrow(run, schema)


def corpus_changes(docs: DataFrame, files: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """The change log of a corpus: estimated inserts, exact revisions, and deletes of exact copies.

    Each text is read and counted once; only counts and a digest are kept. ``files`` adds
    tokenizer versions by name and path.
    """
    versions, files = [*PATTERNS, *(files or {})], files or {}
    docs = docs.select("doc_id", "source", "lang", F.col("text").cast("string").alias("text"))
    if files:
        docs = with_file_counts(docs, files)
    count = lambda v: F.coalesce(F.col(v), F.lit(0).cast("long")) if v in files else count_tokens(F.col("text"), v)
    one = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"),
        F.md5(F.encode("text", "UTF-8")).alias("digest"), estimate(F.col("text")).alias("estimated"), *[count(v).alias(v) for v in versions],
    )
    one = cut(one)
    each = F.explode(F.array(*[F.struct(F.lit(v).alias("tokenizer"), F.col(v).alias("tokens")) for v in versions])).alias("v")
    rows = one.select("source", "lang", "estimated", each).select("source", "lang", "estimated", "v.*")
    # copies: combined by digest, source and language first; of each digest one row stays
    own = one.where(F.col("digest").isNotNull()).groupBy("digest", "source", "lang").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"), *[F.max(v).alias(v) for v in versions])
    rank = F.row_number().over(Window.partitionBy("digest").orderBy(F.col("least").asc_nulls_last(), "source", "lang"))
    own = own.withColumn("n", F.col("n") - (rank == 1).cast("long")).where("n > 0")
    gone = own.select("source", "lang", "n", each).select("source", "lang", "n", "v.*")
    return {
        "ingest": inserts(rows, "estimated"),
        "revise": revisions(rows, "estimated", "tokens"),
        "dedup": _delta(gone, -F.col("n"), -F.col("n") * F.col("tokens")),
    }


def corpus_totals(docs: DataFrame, path: str | None = None, files: dict[str, str] | None = None) -> DataFrame:
    """Maintain totals over a corpus: three batches, one of them replayed, then a compaction."""
    spark = docs.sparkSession
    rollup = TokenRollup(spark, path or f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}")
    changes = corpus_changes(docs, files)
    for name in ("ingest", "revise", "revise", "dedup"):
        rollup.commit(name, changes[name])
    rollup.compact()
    return rollup.totals()
