"""Extension: a stream of requests answered against a static graph."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def serve(requests: DataFrame, answer: Callable[[DataFrame], DataFrame], out_path: str, checkpoint: str) -> StreamingQuery:
    """Answer each micro-batch of ``requests`` with a batch method of Graph.

    The answers of a micro-batch overwrite their own directory, so a replayed batch leaves
    no second copy.
    """

    def one(batch: DataFrame, batch_id: int) -> None:
        answer(batch).write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")

    return requests.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
