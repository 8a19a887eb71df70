"""Connected components of links held in a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, hot_keys, join_one, stored


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of the links (u, v): the least node that it is connected with.

    Labels spread to neighbours, and each node then takes the label of its label, so that long chains shorten by
    halves. Every round is written to the shared folder, and the one before deleted; only numbers come to the driver. The
    labels of the few nodes with a great share of all links, and those that a great share of all nodes have, are broadcast.
    Links with a null end are left out; repeated links and links of a node to itself do no harm. No links give no rows.
    """
    sound = links.select("u", "v").filter("u IS NOT NULL AND v IS NOT NULL")
    both = stored(sound.unionByName(sound.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    centres = hot_keys(both.groupBy("v").agg(F.count(F.lit(1)).alias("n")), "n", both.count()).select("v")
    to_centres, others = both.join(F.broadcast(centres), "v"), both.join(F.broadcast(centres), "v", "left_anti")
    labels = stored(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        of = labels.select(F.col("node").alias("v"), "label")
        near = to_centres.join(F.broadcast(of.join(F.broadcast(centres), "v", "left_semi")), "v").unionByName(others.join(of, "v")).groupBy("u").agg(F.min("label").alias("near"))
        spread = stored(labels.join(near, labels.node == near.u).select("node", "label", F.least("label", "near").alias("new")))
        held = spread.groupBy("new").agg(F.count(F.lit(1)).alias("n"))
        jumps = stored(held.join(labels.select(F.col("node").alias("new"), F.col("label").alias("jump")), "new"))
        after = stored(join_one(spread, jumps, ["new"], "n").select("node", F.least("new", "jump").alias("new"), "label"))
        for old in (labels, spread, jumps):
            if old is not labels or hasattr(old, "stored_at"):
                dropped(old)
        done = after.filter("new != label").isEmpty()
        labels = stored(after.select("node", F.col("new").alias("label")))
        dropped(after)
        if done:
            return labels
