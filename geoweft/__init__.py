"""geoweft: a Spark-native property-graph and spatial query engine."""

from geoweft.plans.graph import Graph

__all__ = ["Graph"]
