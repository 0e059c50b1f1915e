"""Connected components of a link table, as joins."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbwait.session import drop_scratch, written


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component``, its smallest node, for links ``a``, ``b``.

    Every round a node takes the smallest label among its neighbours, then the
    label of its label, so a star settles at once and a chain in a logarithmic
    number of rounds. Labels are written each round; only the number that changed
    comes to the driver. Self links and repeated links do no harm. The links are read
    twice, once for each direction, and must be the same both times.
    """
    both = links.select("a", "b").union(links.select("b", "a")).distinct()
    both, both_path = written(both, "links")
    spark = links.sparkSession
    labels, path = written(
        both.groupBy("a").agg(F.min("b").alias("low")).selectExpr("a as node", "least(a, low) as label"),
        "labels",
    )
    while True:
        near = (
            both.join(labels, both["b"] == labels["node"])
            .groupBy("a")
            .agg(F.min("label").alias("low"))
            .withColumnRenamed("a", "node")
        )
        stepped = labels.join(near, "node", "left").selectExpr(
            "node", "label as old", "least(label, coalesce(low, label)) as label"
        )
        onward = labels.selectExpr("node as label", "label as further")
        stepped = stepped.join(onward, "label", "left").selectExpr(
            "node", "old", "least(label, coalesce(further, label)) as label"
        )
        stepped, next_path = written(stepped, "labels")
        changed = stepped.where("old <> label").count()
        drop_scratch(spark, path)
        labels, path = stepped.select("node", "label"), next_path
        if not changed:
            drop_scratch(spark, both_path)
            return labels.withColumnRenamed("label", "component")
