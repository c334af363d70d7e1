"""URL filter: suffix rules, and for urls that no rule fits a path-template tree with smoothed labelled purity.

Everything is DataFrame expressions and aggregates. Urls are summed to (host, path shape) rows before any tree step.
Templates without labels of their own borrow from those of the same beginning in the parent domain and over all hosts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from countaxis.llm.shared import HOT_KEYS, HOT_ROWS, skew_join, stored


@dataclass(frozen=True)
class Rule:
    """verdict: allow or block; place: host and path prefix as in ``example.com/en/``."""

    verdict: str
    place: str

    @property
    def host(self) -> str:
        return self.place.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.place.partition("/")[2]


def host_of(url: Column) -> Column:
    rest = F.substring_index(url, "://", 1)
    after = F.when(F.instr(url, "://") > 0, url.substr(F.length(rest) + 4, F.length(url))).otherwise(F.lit(""))
    return F.coalesce(F.translate(F.regexp_extract(after, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.substring_index(url, "://", 1)
    after = F.when(F.instr(url, "://") > 0, url.substr(F.length(rest) + 4, F.length(url))).otherwise(F.lit(""))
    return F.coalesce(F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(rules: list[Rule], what) -> Column:
    """what(rule) of the longest rule that fits, else null. Rules of equal length go by their text."""
    fits = lambda r: ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
    return F.coalesce(*(F.when(fits(r), F.lit(what(r))) for r in sorted(rules, key=lambda r: (-len(r.place), r.place))), F.lit(None).cast("string"))


def shape(segment: Column) -> Column:
    """Variable parts of a segment, which the tree starts from as wildcards: runs of digits, and long mixed ids."""
    return F.regexp_replace(F.regexp_replace(segment, r"\b[0-9a-fA-F]{16,}\b", "*"), r"[0-9]+", "*")


def domain_of(host: Column) -> Column:
    """The parent domain: a host's last two names."""
    return F.substring_index(host, ".", -2)


SUMS = ("n", "blocked", "labelled")


def borrowed_rates(tree: DataFrame, depth: int, strength: float, rows: int) -> DataFrame:
    """domain, segments, rates: for each beginning of a path (0 ... depth + 1 segments) the blocked share of labelled urls that
    begin so, in the host's parent domain; smoothed by the share over all hosts, which is smoothed by that of the next
    shorter beginning, down to the share of all urls."""
    domains = tree.groupBy(domain_of(F.col("host")).alias("domain"), "segments").agg(F.sum("blocked").alias("blocked"), F.sum("labelled").alias("labelled"))
    shapes = domains.groupBy("segments").agg(F.sum("blocked").alias("blocked"), F.sum("labelled").alias("labelled"))
    blocked, labelled = tree.agg(F.sum("blocked"), F.sum("labelled")).head()
    root = ((blocked or 0) + 1) / ((labelled or 0) + 2)

    def sums(frame: DataFrame, keys: list[str]) -> DataFrame:
        """For each path the sums of all its beginnings, shortest first; a whole path stands for what would be longer."""
        level = F.explode(F.sequence(F.lit(1), F.least(F.lit(depth + 1), F.size("segments")))).alias("level")
        parts = frame.select(*keys, "segments", "blocked", "labelled", level).withColumn("prefix", F.slice("segments", F.lit(1), F.col("level")))
        seen = parts.groupBy(*keys, "level", "prefix").agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("l"))
        joined = skew_join(parts.select(*keys, "segments", "level", "prefix"), seen, [*keys, "level", "prefix"], rows * (depth + 1), rows * (depth + 1))
        return joined.groupBy(*keys, "segments").agg(F.array_sort(F.collect_list(F.struct("level", "b", "l"))).alias("path"))

    def whole(rates: Column) -> Column:
        return F.concat(rates, F.array_repeat(F.element_at(rates, -1), F.lit(depth + 2) - F.size(rates)))

    step = lambda have, x: F.concat(have, F.array((x["b"] + strength * F.element_at(have, -1)) / (x["l"] + strength)))
    over_all = sums(shapes, []).select("segments", F.aggregate("path", F.array(F.lit(root)), step).alias("all_rates"))
    own = skew_join(sums(domains, ["domain"]), over_all, ["segments"], rows, rows)
    smoothed = F.transform("path", lambda x: (x["b"] + strength * F.element_at("all_rates", x["level"] + 1)) / (x["l"] + strength))
    return own.select("domain", "segments", whole(F.concat(F.array(F.lit(root)), smoothed)).alias("rates"))


def judge(pages: DataFrame, rules: list[Rule], depth: int = 4, least_share: float = 0.02, strength: float = 4.0, purity: float = 0.8, z: float = 1.96) -> DataFrame:
    """page_id, host, path, rule, verdict, template, block_rate for each row of ``pages`` (page_id, url; others ignored).

    A url's verdict is that of the longest rule that fits. The others get that of their template: per host, a path's
    first ``depth`` segments form a tree (all that follows is one last wildcard). A segment that holds less than
    ``least_share`` of its parent's urls is generalised into a wildcard (``*``). Of the others, those whose blocked share
    doesn't differ from the rest of their parent's by a two-proportion test at ``z`` are merged (into ``~``). Labels are the
    rules' verdicts; a branch's share is that of its labels and of ``strength`` more at the share that paths of the same
    beginning have in the parent domain and over all hosts (borrowed_rates()), so branches and hosts without labels are
    generalised and merged by what is known of their like. A template is blocked when its blocked share, smoothed
    so, is ``purity`` or more; else allowed.

    A null url, or one without ``://``, has an empty host and path, fits no rule, and forms a template of its own host; a
    null page_id stays null; repeated rows are judged each on its own and count each; columns beside page_id and url don't
    matter, whatever their names; equal shares count as alike; an empty table gives no rows. Hosts, templates and
    beginnings that very many rows share aren't gathered in one task (skew_join()).
    """
    parsed = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ruled = parsed.select("*", fitting_rule(rules, lambda r: r.place).alias("rule"), fitting_rule(rules, lambda r: r.verdict).alias("ruled"))
    segments = F.transform(F.slice(F.split(F.regexp_replace("path", "^/", ""), "/"), 1, depth + 1), lambda x, i: F.when(i < depth, shape(x)).otherwise(F.lit("**")))
    ruled = ruled.withColumn("segments", segments)
    tree = ruled.groupBy("host", "segments").agg(F.count("*").alias("n"), F.count(F.when(F.col("ruled") == "block", 1)).alias("blocked"), F.count("ruled").alias("labelled"))
    tree = stored(tree, "url-tree")
    rows, urls = tree.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).head()
    busy = tree.filter(F.col("n") > max(HOT_ROWS, urls // HOT_KEYS)).select("host", "segments")  # by the sums that are there
    rates = borrowed_rates(tree, depth, strength, rows)
    tree = skew_join(tree.withColumn("domain", domain_of(F.col("host"))), rates, ["domain", "segments"], rows, rows).drop("domain")
    tree = stored(tree.withColumn("template", F.lit("")), "url-tree")
    for level in range(depth):
        tree = tree.withColumn("segment", F.coalesce(F.try_element_at("segments", F.lit(level + 1)), F.lit("")))
        like = F.sum(F.col("n") * F.element_at("rates", F.lit(level + 2))) / F.sum("n")
        branches = tree.groupBy("host", "template", "segment").agg(*(F.sum(x).alias(x) for x in SUMS), F.round(like, 9).alias("like"))
        branches = branches.select("host", "template", "segment", "n", (F.col("blocked") + strength * F.col("like")).alias("b"), (F.col("labelled") + strength).alias("l"))
        parents = branches.groupBy("host", "template").agg(F.sum("n").alias("all_n"), F.sum("b").alias("all_b"), F.sum("l").alias("all_l"), F.count("*").alias("branches"))
        b1, l1 = F.col("b"), F.col("l")
        b2, l2 = F.col("all_b") - b1, F.col("all_l") - l1
        pooled = F.col("all_b") / F.col("all_l")
        differs = (F.col("branches") == 1) | (F.abs(b1 / l1 - b2 / l2) > z * F.sqrt(pooled * (1 - pooled) * (1 / l1 + 1 / l2)))
        # At most 1 / least_share branches of a parent stay.
        stays = skew_join(branches, parents, ["host", "template"], rows, rows).filter(F.col("n") >= least_share * F.col("all_n"))
        stays = stays.select("host", "template", "segment", F.when(differs, F.lit("literal")).otherwise(F.lit("~")).alias("kind"))
        tree = skew_join(tree, stays, ["host", "template", "segment"], rows, rows, "left")
        named = F.concat("template", F.lit("/"), F.when(F.col("kind") == "literal", F.col("segment")).otherwise(F.coalesce("kind", F.lit("*"))))
        tree = tree.withColumn("template", F.when(F.size("segments") > level, named).otherwise(F.col("template"))).drop("kind", "segment")
        tree = stored(tree, "url-tree")  # each level is read several times: small rows, and no lineage to run again
    known = F.sum("labelled")
    like = F.sum(F.col("n") * F.element_at("rates", -1)) / F.sum("n")
    templates = tree.groupBy("host", "template").agg(F.round((F.sum("blocked") + strength * like) / (known + strength), 9).alias("block_rate"))
    by_path = skew_join(tree.select("host", "segments", "template"), templates, ["host", "template"], rows, rows)
    judged = skew_join(ruled, by_path, ["host", "segments"], urls, rows, hot=busy)
    verdict = F.coalesce("ruled", F.when(F.col("block_rate") >= purity, F.lit("block")).otherwise(F.lit("allow")))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "block_rate")
