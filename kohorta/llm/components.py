"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kohorta.operators.skew import salted_join
from kohorta.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """``(node, comp)`` with the smallest node of each component, for nodes with an edge.

    ``edges`` has ``a`` and ``b``. Each step takes the smallest label among the
    neighbours, then the label of that label, so distances shrink fast. A step is a
    few aggregations with map-side combine; a hub is split by salt. Labels are
    written after each step and only a count comes to the driver.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = cut_lineage(both.distinct(), "components-edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near"))
    labels = cut_lineage(labels.select("node", F.least("node", "near").alias("comp")), "components")
    while True:
        known = labels.select(F.col("node").alias("a"), "comp")
        near = salted_join(both, known, "a").groupBy(F.col("b").alias("node")).agg(F.min("comp").alias("near"))
        lower = labels.join(near, "node").select(
            "node", F.least("comp", "near").alias("new"), F.col("comp").alias("old")
        )
        above = labels.select(F.col("node").alias("new"), F.col("comp").alias("top"))
        stepped = salted_join(lower, above, "new").select(
            "node", F.least("new", "top").alias("comp"), (F.least("new", "top") != F.col("old")).alias("moved")
        )
        stepped = cut_lineage(stepped, "components")
        labels = stepped.select("node", "comp")
        if stepped.filter("moved").isEmpty():
            return labels
