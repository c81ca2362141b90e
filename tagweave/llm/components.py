"""Connected components of a link table, by DataFrame joins.

Each round every node takes the smallest label among itself and its neighbours, then the label of its
label (pointer jumping), so the number of rounds grows with the logarithm of a component's width, not
with its size.  Rounds are written to the shared folder, so lost executors cost one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def components(links: DataFrame) -> DataFrame:
    """``links``: (a, b) longs.  (id, class_id) of every linked node; class_id is the smallest id.

    A node with many links meets them in the join (adaptive execution splits it) and in an aggregate
    with map-side combine, never in one group.
    """
    both = staged(links.select("a", "b").union(links.select("b", "a")).where("a != b").distinct(), "links")
    label = staged(both.groupBy("a").agg(F.min("b").alias("m")).select(
        F.col("a").alias("id"), F.least("a", "m").alias("class_id")), "labels")
    while True:
        near = both.join(label.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(
            F.min("class_id").alias("near"))
        lower = label.join(near, "id", "left").select("id", F.col("class_id").alias("old"), F.least(
            "class_id", F.coalesce("near", "class_id")).alias("class_id"))
        # the label's own label: labels are node ids, so this is one more lookup
        up = label.select(F.col("id").alias("class_id"), F.col("class_id").alias("up"))
        new = staged(lower.join(up, "class_id", "left").select(
            "id", "old", F.least("class_id", F.coalesce("up", "class_id")).alias("class_id")), "labels")
        label = new.select("id", "class_id")
        if new.where("old != class_id").isEmpty():
            return label
