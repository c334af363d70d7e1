"""Groups of members out of a table of pairs: contrasts of a tree, anchors, and who joins which group.

pairs: a, b, draw, distance, each pair once. members: member, cells (a weight) and a group, where 0 is none. A member's distance to a
group is the mean over the group's other members, weighted by cells: a pair has two different members, so each is left out of its own
group by itself. Where a second member has to be left out of a group's total, its term is taken out of that total again. Everything is
an aggregation by member, group and draw; quantiles over draws come last. Sums of floats differ in the last digits with the order
of rows, so what is nearer by less than ``TIE`` is a tie.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from countaxis.operators.paths import Paths
from countaxis.operators.shared import cut

SUPPORT, SEPARATION = 0.9, 0.25
TIE = 1e-12
#: Scores that a quantile of fellows needs.
LEAST_SCORES = 3


def impurities(posterior: DataFrame) -> DataFrame:
    """member, impurity: how often two independent draws of one member differ, over its places. posterior: member, marker, p."""
    apart = 1 - F.aggregate("p", F.lit(0.0), lambda total, x: total + x * x)
    return posterior.groupBy("member").agg(F.avg(apart).alias("impurity"))


def both_ways(pairs: DataFrame, *values: str) -> DataFrame:
    """member, other and ``values``: each pair seen from either side."""
    sides = F.explode(F.array(F.struct(F.col("a").alias("member"), F.col("b").alias("other")), F.struct(F.col("b").alias("member"), F.col("a").alias("other"))))
    return pairs.select(sides.alias("side"), *values).select("side.*", *values)


def to_groups(pairs: DataFrame | Paths, members: DataFrame) -> DataFrame:
    """member, group, draw, peers, weight, total: sums of each member's distances to each group's other members. pairs: a table, or the
    paths that the distances are of, for which no table of pairs is made."""
    if isinstance(pairs, Paths):
        sums = pairs.sums(members.withColumn("u", F.lit(0.0)))
        return sums.withColumn("group", F.col("group").cast(members.schema["group"].dataType))
    others = members.filter("group > 0").select(F.col("member").alias("other"), F.col("cells").alias("heft"), "group")
    rows = both_ways(pairs, "draw", "distance").join(others, "other")
    sums = (F.count("*").alias("peers"), F.sum("heft").alias("weight"), F.sum(F.col("heft") * F.col("distance")).alias("total"))
    return rows.groupBy("member", "group", "draw").agg(*sums)


def _share(condition: Column) -> Column:
    return F.avg(F.coalesce(condition, F.lit(False)).cast("double"))


def anchors(pairs: DataFrame | Paths, members: DataFrame, support: float = SUPPORT) -> DataFrame:
    """member, cells, group, anchor, stability: the anchor is the group if its other members are nearest in ``support`` of the draws,
    else 0. A group that keeps a single member loses it. Where there is one group only, nothing is compared and stability is null."""
    cost = F.col("total") / F.col("weight")
    own = F.col("group") == F.col("home")
    homes = members.filter("group > 0").select("member", F.col("group").alias("home"))
    drawn = to_groups(pairs, members).join(homes, "member").groupBy("member", "draw")
    drawn = drawn.agg(F.max(F.when(own, cost)).alias("near"), F.min(F.when(~own, cost)).alias("far"))
    stable = drawn.groupBy("member").agg(F.when(F.count("far") > 0, _share(F.col("far") - F.col("near") > TIE)).alias("stability"))
    rows = members.select("member", "cells", "group").join(stable, "member", "left")
    rows = rows.withColumn("anchor", F.when((F.col("group") > 0) & (F.col("stability").isNull() | (F.col("stability") >= support)), F.col("group")).otherwise(0))
    kept = rows.filter("anchor > 0").groupBy("anchor").agg(F.count("*").alias("fellows"))
    alone = F.coalesce(F.col("fellows"), F.lit(0)) < 2
    return rows.join(kept, "anchor", "left").select("member", "cells", "group", F.when(alone, 0).otherwise(F.col("anchor")).alias("anchor"), "stability")


def _scores(sums: DataFrame, homes: DataFrame) -> DataFrame:
    """member, home, cells, fellows, draw, weight, total: anchors' sums over their own groups."""
    return sums.join(homes, "member").filter("group = home").select("member", "home", "cells", "fellows", "draw", "weight", "total")


def mean_within(sums: DataFrame, homes: DataFrame, targets: DataFrame) -> DataFrame:
    """member, draw, within: mean over the pairs of the target's anchors but the member itself; 0 where no pair is left."""
    own = _scores(sums, homes)
    whole = own.groupBy(F.col("home").alias("target"), "draw").agg((F.sum(F.col("cells") * F.col("total")) / 2).alias("s"), (F.sum(F.col("cells") * F.col("weight")) / 2).alias("w"))
    part = own.select("member", F.col("home").alias("target"), "draw", (F.col("cells") * F.col("total")).alias("less"), (F.col("cells") * F.col("weight")).alias("lighter"))
    rows = targets.join(whole, "target").join(part, ["member", "target", "draw"], "left")
    mean = (F.col("s") - F.coalesce("less", F.lit(0.0))) / (F.col("w") - F.coalesce("lighter", F.lit(0.0)))
    return rows.select("member", "draw", F.when(F.col("peers") >= 2, mean).otherwise(0.0).alias("within"))


def inside_of_paths(paths: Paths, own: DataFrame, homes: DataFrame, members: DataFrame) -> DataFrame:
    """member, draw, within, scores of anchors in their own groups, themselves left out of every score, without a table of pairs.

    Leaving one member out moves another's score by its share of the weight at most, so bounds by group and draw tell whose scores can be
    about the quantile; these alone are taken exactly, each against every member. Where some pairs have no common marker, all are.
    own: scores of ``homes`` (member, home, cells, fellows, u); members: those that are wanted.
    """
    kind, shape, n = dict(homes.dtypes)["member"], paths.shape, LEAST_SCORES
    scored = own.filter(F.col("fellows") > n).join(homes.select("member", "u"), "member").select("home", "draw", "member", *(F.col(c).cast("double").alias(c) for c in ("cells", "u", "weight", "total", "fellows", "peers")))

    def bounded(table: pa.Table) -> pa.Table:
        cells, u, weight, total, fellows, peers = (table.column(c).to_numpy() for c in ("cells", "u", "weight", "total", "fellows", "peers"))
        low, high = np.full(len(cells), -np.inf), np.full(len(cells), np.inf)
        least, most = -np.inf, np.inf
        if len(cells) == fellows[0] and (peers == fellows - 1).all():
            mean, gone = total / weight, cells.max() / (weight - cells.max())
            if (weight > cells.max()).all():
                slack = 1e-9 * (1 + np.abs(mean))  # of rounding
                low = mean + gone * np.minimum(0, mean - (1 - (u.min() + u) / 2)) - slack
                high = mean + gone * np.maximum(0, mean + (u.max() + u) / 2) + slack
                at = 0.95 * (len(cells) - 2)
                least, most = np.sort(low)[int(at)], np.sort(high)[min(int(at) + 2, len(cells) - 1)]
        return table.append_column("side", pa.array((low > most).astype(np.int32) - (high < least)))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in scored.schema) + ", side int"
    marked = cut(scored.groupBy("home", "draw").applyInArrow(bounded, schema))
    # Those below or above by all bounds are counted only.
    side = lambda k: F.sum((F.col("side") == k).cast("long"))
    counts = marked.groupBy("home", "draw").agg(side(-1).alias("below"), side(1).alias("above"))
    a_draw = shape.width * np.dtype(shape.dtype).itemsize
    near = marked.filter("side = 0").join(paths.codes, "member").withColumn("codes", F.substring("codes", F.col("draw") * a_draw + 1, F.lit(a_draw)))
    near = near.groupBy("home", "draw").agg(*(F.collect_list(F.struct("member", "codes", "u", "weight", "total")).alias(c) for c in ("x",))).join(counts, ["home", "draw"])
    wanted = members.join(homes.filter(F.col("fellows") > n), "member").select("member", F.col("cells").cast("double").alias("cells"), F.col("home").alias("group"), "u")
    met = paths.blocks(wanted, ["draw", "group"]).withColumnRenamed("group", "home").join(near, ["home", "draw"]).select("ids", "codes", "cells", "u", "draw", "x", "below", "above")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, codes, cells, u = (batch.column(k)[row].values for k in range(4))
                x = batch.column(5)[row].values
                cells, u = cells.to_numpy()[:, None], u.to_numpy()[:, None]
                there = x.field(0).to_pylist()
                place = {m: i for i, m in enumerate(there)}
                apart = shape.distances(shape.array(codes, 1)[:, 0], shape.array(x.field(1), 1)[:, 0]) - (u + x.field(2).to_numpy()) / 2
                score = (x.field(4).to_numpy() - cells * apart) / (x.field(3).to_numpy() - cells)
                for i, m in enumerate(ids.to_pylist()):
                    if m in place:
                        score[i, place[m]] = np.nan
                score = np.sort(score, 1)  # NaN last
                known = len(there) - np.isnan(score).sum(1)
                draw, below, above = (pa.array(np.full(len(ids), batch.column(k)[row].as_py(), t)) for k, t in ((4, np.int32), (6, np.int64), (7, np.int64)))
                yield pa.RecordBatch.from_arrays([ids, draw, pa.array(known), below, above, pa.array(list(score), pa.list_(pa.float64()))], ["member", "draw", "known", "below", "above", "score"])

    found = met.mapInArrow(run, f"member {kind}, draw int, known long, below long, above long, score array<double>").join(marked.select("member", "draw", "side"), ["member", "draw"])
    others = F.col("known") + F.col("below") + F.col("above") - F.abs("side")  # without itself
    found = found.withColumn("scores", others).withColumn("below", F.col("below") - (F.col("side") == -1).cast("long")).filter("scores > 0")
    at = 0.95 * (F.col("scores") - 1)
    first = F.floor(at)
    value = lambda k: F.element_at("score", (k - F.col("below") + 1).cast("int"))
    share = at - first
    level = F.when(share > 0, (1 - share) * value(first) + share * value(first + 1)).otherwise(value(first))
    return found.select("member", "draw", level.alias("within"), "scores")


def quantile_within(pairs: DataFrame | Paths, sums: DataFrame, homes: DataFrame, targets: DataFrame) -> DataFrame:
    """member, draw, within, source, scores: 95th percentile of anchors' distances to their fellows, the member left out of both.

    The target's anchors are taken if there are three without the member, else those of all other groups that have three.
    """
    own = _scores(sums, homes)
    level = F.percentile(F.col("total") / F.col("weight"), 0.95).alias("within")
    whole = own.groupBy(F.col("home").alias("target"), "draw").agg(level, F.count("*").alias("scores"))
    rich, poor = targets.filter(F.col("peers") >= LEAST_SCORES), targets.filter(F.col("peers") < LEAST_SCORES)
    outside = rich.filter("anchor <> target").join(whole, "target").select("member", "draw", "within", "scores")

    wanted = rich.filter("anchor = target").select("member")
    if isinstance(pairs, Paths):
        inside = inside_of_paths(pairs, sums.join(homes, "member").filter("group = home").select(*own.columns, "peers"), homes, wanted)
    else:
        left_out = homes.select(F.col("member").alias("other"), F.col("home").alias("there"), "cells")
        fellows = both_ways(pairs, "draw", "distance").join(homes.select("member", "home", "fellows").filter(F.col("fellows") > LEAST_SCORES), "member")
        fellows = fellows.join(left_out.withColumnRenamed("other", "gone").withColumnRenamed("cells", "heft"), (F.col("other") == F.col("gone")) & (F.col("home") == F.col("there")))
        # A row is a scored member and a fellow who is taken out of its total.
        rest = own.select("member", "draw", "weight", "total").join(fellows.select("member", "draw", "other", "heft", "distance"), ["member", "draw"])
        rest = rest.select(F.col("other").alias("member"), "draw", (F.col("total") - F.col("heft") * F.col("distance")).alias("total"), (F.col("weight") - F.col("heft")).alias("weight"))
        inside = rest.groupBy("member", "draw").agg(level, F.count("*").alias("scores")).join(wanted, "member")

    # Only groups of just three lend to others what their own members can't have; all other members share one pool.
    lent = own.filter(F.col("fellows") >= LEAST_SCORES)
    poor = poor.withColumn("but", F.when((F.col("anchor") == F.col("target")) & (F.col("peers") == LEAST_SCORES - 1), F.col("target")).otherwise(0))
    wanted = poor.join(sums.select("member", F.col("group").alias("target"), "draw"), ["member", "target"]).select("but", "draw").distinct()
    pools = wanted.join(lent, "draw").filter("home <> but").groupBy("but", "draw").agg(level, F.count("*").alias("scores"))
    borrowed = poor.join(pools, "but").select("member", "draw", "within", "scores")
    named = lambda frame, source: frame.select("member", "draw", "within", F.lit(source).alias("source"), "scores")
    return named(outside, "target_group").unionByName(named(inside, "target_group")).unionByName(named(borrowed, "pooled_other_groups"))


def assess(pairs: DataFrame | Paths, members: DataFrame, baseline: str, expected: DataFrame | None = None, support: float = SUPPORT) -> DataFrame:
    """A row for each member: the group that it prefers, how surely, its excess over the baseline, and the group that it gets.

    members: member, cells, anchor, impurity (half of both ends' is taken from a distance; null: nothing). A member prefers its
    anchor's group, or else the group nearest on average. It gets it if that group is nearest in ``support`` of the draws and the
    5th percentile of the excess isn't positive; a group that would have one member has none. baseline: mean (of the other pairs of
    the group's anchors), member_q95 (their 95th percentile, by draw) or profile_q95 (that of ``expected``: a, b, distance).
    """
    if baseline not in ("mean", "member_q95", "profile_q95") or (baseline == "profile_q95") != (expected is not None):
        raise ValueError("a baseline is mean, member_q95, or profile_q95 with expected distances")
    members = cut(members)
    plain = members.select("member", "cells", F.col("anchor").alias("group"))
    noise = members.select("member", F.coalesce(F.col("impurity"), F.lit(0.0)).alias("u"))
    whole_paths = isinstance(pairs, Paths)
    fixed = pairs if whole_paths else pairs.join(noise.toDF("a", "ua"), "a").join(noise.toDF("b", "ub"), "b").withColumn("raw", F.col("distance")).withColumn("distance", F.col("distance") - (F.col("ua") + F.col("ub")) / 2)
    if whole_paths:
        sums = pairs.sums(plain.join(noise, "member")).withColumn("group", F.col("group").cast(plain.schema["group"].dataType))
    else:
        others = plain.filter("group > 0").select(F.col("member").alias("other"), F.col("cells").alias("heft"), "group")
        rows = both_ways(fixed, "draw", "distance", "raw").join(others, "other")
        total = lambda x: F.sum(F.col("heft") * F.col(x))
        sums = rows.groupBy("member", "group", "draw").agg(F.count("*").alias("peers"), F.sum("heft").alias("weight"), total("distance").alias("total"), total("raw").alias("raw"))
    sums = cut(sums.withColumn("cost", F.col("raw") / F.col("weight")))

    sizes = plain.filter("group > 0").groupBy("group").agg(F.count("*").alias("fellows"))
    homes = plain.join(sizes, "group").select("member", "cells", F.col("group").alias("home"), "fellows")
    nearest = sums.groupBy("member", "group").agg(F.round(F.avg("cost"), 12).alias("mean"), F.max("peers").alias("peers"))
    nearest = nearest.groupBy("member").agg(F.min(F.struct("mean", "group")).alias("best"), F.map_from_entries(F.collect_list(F.struct("group", "peers"))).alias("at"))
    targets = nearest.join(members.select("member", "anchor"), "member").withColumn("target", F.when(F.col("anchor") > 0, F.col("anchor")).otherwise(F.col("best.group")))
    targets = cut(targets.select("member", "anchor", "target", F.element_at("at", F.col("target")).alias("peers")))

    own = F.col("group") == F.col("target")
    drawn = sums.join(targets.select("member", "target"), "member").groupBy("member", "draw")
    drawn = drawn.agg(F.max(F.when(own, F.col("cost"))).alias("near"), F.min(F.when(~own, F.col("cost"))).alias("far"), F.max(F.when(own, F.col("total") / F.col("weight"))).alias("seen"))
    if baseline == "mean":
        within = mean_within(sums, homes, targets).withColumns({"source": F.lit(None).cast("string"), "scores": F.lit(None).cast("long")})
    elif baseline == "member_q95":
        within = quantile_within(fixed, sums, homes.join(noise, "member") if whole_paths else homes, targets)
    else:
        still = expected.select("a", "b", F.lit(0).alias("draw"), "distance")
        within = quantile_within(still, to_groups(still, plain), homes, targets).drop("draw")
    held = drawn.join(within, ["member"] if baseline == "profile_q95" else ["member", "draw"], "left").withColumn("excess", F.col("seen") - F.col("within"))
    summed = held.groupBy("member").agg(
        F.when(F.count("far") > 0, _share(F.col("far") - F.col("near") > TIE)).alias("preference_support"), F.avg("excess").alias("excess_mean"),
        F.percentile("excess", 0.05).alias("excess_lower05"), F.avg("within").alias("baseline_mean"), F.first("source", True).alias("baseline_source"), F.max("scores").alias("baseline_scores"),
    )
    judged = members.select("member", "anchor").join(targets.select("member", "target", "peers"), "member", "left").join(summed, "member", "left")
    reason = (
        F.when(F.col("target").isNull(), "no_discovered_groups")
        .when(F.col("preference_support") < support, "ambiguous_preference")
        .when(F.col("baseline_mean").isNull(), "insufficient_calibration")
        .when(F.col("excess_lower05") > TIE, "excess_disagreement")
        .otherwise("assigned")
    )
    judged = cut(judged.withColumn("reason", reason))
    joined = judged.filter("reason = 'assigned'").groupBy("target").agg(F.count("*").alias("joined"))
    judged = judged.join(joined, "target", "left").withColumn("reason", F.when((F.col("reason") == "assigned") & (F.col("joined") < 2), "unreplicated_group").otherwise(F.col("reason")))
    accepted = F.col("reason") == "assigned"
    source = F.col("baseline_source") if baseline == "mean" else F.when(F.col("target").isNotNull(), F.coalesce(F.col("baseline_source"), F.lit("unavailable")))
    return judged.select(
        "member", "anchor", F.col("target").alias("proposed_group"), F.col("peers").alias("references"), "preference_support", "excess_mean", "excess_lower05", F.lit(baseline).alias("baseline"),
        "baseline_mean", source.alias("baseline_source"), "baseline_scores", accepted.alias("accepted"), "reason", F.when(accepted, F.col("target")).otherwise(0).alias("group"),
    )


def node_sums(pairs: DataFrame, tree: DataFrame) -> DataFrame:
    """node, draw, total, weight: pairs summed at the lowest node that holds both, weighted by both members' cells. tree: member, cells,
    above (the nodes that hold it; a node's number is greater than those below it). Pairs without a common node have no part."""
    side = lambda s: tree.select(F.col("member").alias(s), F.col("cells").alias(f"cells_{s}"), F.col("above").alias(f"above_{s}"))
    node = F.array_min(F.array_intersect("above_a", "above_b"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("node", node).filter("node is not null")
    heft = F.col("cells_a") * F.col("cells_b")
    return rows.groupBy("node", "draw").agg(F.sum(heft * F.col("distance")).alias("total"), F.sum(heft).alias("weight"))


def contrasts(sums: np.ndarray, weights: np.ndarray, merges: list[tuple[int, int]], sizes: np.ndarray, separation: float = SEPARATION) -> list[tuple[float | None, float | None, bool]]:
    """For each merge: the 5th percentile over draws of the distance between its sides less half of that within both, its mean as a
    share of the mean between, and whether both suffice. sums: merges x draws of ``node_sums``, weights: by merge; sizes: members of
    every node, single members first. What is within a side is what its own merges sum to."""
    leaves = len(sizes) - len(merges)
    inner, heft = np.zeros((len(sizes), sums.shape[1])), np.zeros(len(sizes))
    found = []
    for k, sides in enumerate(map(list, merges)):
        inner[leaves + k], heft[leaves + k] = inner[sides].sum(0) + sums[k], heft[sides].sum() + weights[k]
        if sizes[sides].min() < 2:
            found.append((None, None, False))
            continue
        between = sums[k] / weights[k]
        gain = between - (inner[sides] / heft[sides, None]).mean(0)
        low, share = float(np.quantile(gain, 0.05)), float(gain.mean() / max(between.mean(), np.finfo(float).eps))
        found.append((low, share, low > TIE and share >= separation))
    return found
