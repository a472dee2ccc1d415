"""Connected components of a table of links, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclake.llm.common import stored


def components(links: DataFrame, path: str) -> DataFrame:
    """node, comp: the least node that each node of `links` (a, b) can reach.

    A round takes the least label among neighbours, gives it to the node that was the own label too, and then takes the
    label of that label. So trees of labels hang on to each other whole, and the rounds grow with the logarithm of the
    longest path. Labels and links stay distributed; the driver sees one row a round.
    """
    both = stored(links.select("a", "b").unionByName(links.selectExpr("b AS a", "a AS b")).distinct(), f"{path}/both")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("comp"))
    labels, turn = stored(labels, f"{path}/labels0"), 0
    while True:
        turn += 1
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("comp").alias("near"))
        told = labels.join(near, labels["node"] == near["a"]).select("node", F.col("comp").alias("was"), F.least("comp", "near").alias("now"))
        hung = told.select(F.col("was").alias("node"), F.lit(None).cast(told.schema["was"].dataType).alias("was"), "now")
        least = told.unionByName(hung).groupBy("node").agg(F.max("was").alias("was"), F.min("now").alias("now"))
        least = stored(least, f"{path}/least{turn}")
        up = least.select(F.col("node").alias("now"), F.col("now").alias("next"))
        after = stored(least.join(up, "now").select("node", "was", F.least("now", "next").alias("comp")), f"{path}/labels{turn}")
        if after.where("was <> comp").isEmpty():
            return after.select("node", "comp")
        labels = after.select("node", "comp")
