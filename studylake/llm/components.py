"""Connected components of a table of links.

Nulls: a link with a null end joins nothing and is left out. Repeated links and links of an id to itself change nothing; no links give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """id, label (smallest id of the component) for each id in links (a, b).

    Smallest labels spread along the links and along labels of labels, so the number of rounds grows with the logarithm of a
    component's width. Each round's labels are written, the driver sees one count.
    """
    links = links.select("a", "b").where("a is not null and b is not null")
    both = cut(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = cut(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("id"), F.least("a", "low").alias("label")), "labels")
    for _ in range(rounds):
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("label").alias("low")).withColumnRenamed("a", "id")
        spread = labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "low").alias("label"))
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("next"))
        new = cut(spread.join(jump, "label").select("id", "old", F.least("label", "next").alias("label")), "labels")
        labels = new.select("id", "label")
        if not new.where(F.col("old") != F.col("label")).limit(1).count():
            return labels
    raise RuntimeError("components did not settle")
