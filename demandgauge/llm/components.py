"""Connected components of a link table by least labels, one written step at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandgauge.llm.shared import write_once


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b) -> (node, comp) for each linked node; comp is the least node reachable.

    Each step takes the least label around a node (an aggregate with map-side combining) and then
    the label of that label, so paths halve.  Every step is a written table: no lineage grows, and a
    lost executor costs one step.  Only whether a label has changed reaches the driver.  Nulls link nothing, repeated
    links count once, links of a node to itself and an empty table give no rows; ties do not occur.
    """
    both = write_once(
        links.filter("a <> b").select("a", "b").unionByName(links.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b")))
        .distinct(), "links")
    labels = write_once(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("comp")), "labels")
    while True:
        # Each node's own label comes along, so the step itself says whether it has changed.
        near = (
            both.join(labels, both["a"] == labels["node"]).select(F.col("b").alias("node"), "comp", F.lit(None).cast("bigint").alias("now"))
            .unionByName(labels.select("node", "comp", F.col("comp").alias("now")))
            .groupBy("node").agg(F.min("comp").alias("next"), F.max("now").alias("now"))
        )
        of = labels.select(F.col("node").alias("next"), F.col("comp").alias("beyond"))
        least = F.least("next", F.coalesce("beyond", "next"))
        stepped = write_once(near.join(of, "next", "left").select("node", least.alias("comp"), (least < F.col("now")).alias("moved")), "labels")
        labels = stepped.select("node", "comp")
        if not stepped.filter("moved").limit(1).count():
            return labels
