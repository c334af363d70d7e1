"""Connected components of a graph of ids, by least labels with pointer jumping; every round is joins and sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countaxis.llm.shared import BROADCAST_ROWS, forget, hot_keys, skew_join, stored


def components(edges: DataFrame) -> DataFrame:
    """node, root: for each id in ``edges`` (a, b; longs) the smallest id that it is connected with. Nulls, loops and repeated
    edges do no harm; an empty table gives no rows. Each round's labels are written to the shared folder. Ids with very many
    edges, and roots of very many ids, aren't gathered in one task."""
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
    both = stored(both.filter("node is not null and other is not null and node <> other").distinct(), "edges")
    labels = stored(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("root")), "labels")
    rows, nodes = both.count(), labels.count()
    few = nodes <= BROADCAST_ROWS
    hubs = None if few else hot_keys(both, ["other"], rows)
    while True:
        near = skew_join(both, labels.select(F.col("node").alias("other"), "root"), ["other"], rows, nodes, hot=hubs)
        near = near.groupBy("node").agg(F.min("root").alias("near"))
        hop = labels.select(F.col("node").alias("root"), F.col("root").alias("far"))
        better = skew_join(labels.join(near, "node"), hop, ["root"], nodes, nodes, hot=None if few else hot_keys(labels, ["root"], nodes))
        better = better.select("node", F.least("near", "far").alias("root"), F.col("root").alias("old"))
        better = stored(better.select("node", "root", (F.col("root") < F.col("old")).alias("changed")), "labels")
        forget(labels)
        labels = better
        if not better.filter("changed").limit(1).count():
            return better.select("node", "root")
