"""Connected components of links as Spark jobs: least neighbour label and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(node, comp) of the undirected links (a, b): comp is the least node that can be reached.

    Each round takes the least label among the neighbours and then the label's own label, so
    that a chain of n nodes needs about log n rounds; each round's table is written to the
    shared folder.
    """
    both = cut(spark, links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = cut(spark, both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("comp")), "labels")
    while True:
        heard = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("comp").alias("heard"))
        new = labels.join(heard.withColumnRenamed("a", "node"), "node").select("node", F.col("comp").alias("old"), F.least("comp", "heard").alias("comp"))
        up = labels.select(F.col("node").alias("comp"), F.col("comp").alias("above"))
        new = cut(spark, new.join(up, "comp").select("node", "old", F.least("comp", "above").alias("comp")), "labels")
        if new.where("comp <> old").isEmpty():
            return new.select("node", "comp")
        labels = new.select("node", "comp")
