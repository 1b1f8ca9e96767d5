"""Connected components of links between ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.session import checkpointed


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (the smallest id reachable) for every id that occurs in ``a, b``.

    Labels spread along the links and are then replaced by their own label's label, until
    none changes. Every round is written to the checkpoint folder. Joins stand directly on
    shuffles, so that the adaptive skew join can split an id with very many links; minima
    are combined before they are shuffled. Links to itself, repeated and reversed links
    change nothing. Links with a null end are left out.
    """
    ends = links.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b")
    edges = checkpointed(ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = checkpointed(
        edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label"))
    )
    while True:
        seen = (
            edges.join(labels.select(F.col("node").alias("b"), "label"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("seen"))
        )
        spread = checkpointed(
            labels.join(seen, "node").select(
                "node", F.col("label").alias("before"), F.least("label", "seen").alias("label")
            )
        )
        heads = spread.select(F.col("node").alias("label"), F.col("label").alias("head"))
        labels = checkpointed(
            spread.join(heads, "label").select("node", "before", F.col("head").alias("label"))
        )
        if labels.where("label <> before").isEmpty():
            return labels.select("node", F.col("label").alias("component"))
