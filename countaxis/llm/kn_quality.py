"""Quality by perplexity under an interpolated modified Kneser-Ney model of byte 4-grams, trained on trusted texts.

Counts, continuation counts, discounts and interpolation weights are DataFrame aggregates and joins. Documents are dealt to
groups, and so are the ids of trusted texts; a group tells the shards of grams which grams it has, and how often its trusted
texts have them, the distinct ones are joined with the model's tables, and the shards answer each group with the log probabilities of its grams. A text's limit is a quantile of the perplexities of
trusted texts of its language.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from countaxis.llm.shared import as_text, column_bytes, forget, mixed, stored, tidy
from countaxis.llm.suffix_dedup import NO_ID, ROWS, _deal, _kinds, documents, group_of, packed, rows_of, split_by, unpacked

#: Bytes of a gram. Codes of grams of up to four bytes are numbers below 2**32.
ORDER = 4
#: Margins over the quantile that are chosen from.
MARGINS = tuple(1 + k / 20 for k in range(11))
TOLD, MODEL, ANSWERS, TRUSTED, COUNTS = 10, 11, 12, 13, 14
GRAM = np.dtype([("gap", "<u4")])
ID = np.dtype([("id", "<i8")])
COUNT = np.dtype([("gram", "<u4"), ("c", "<u8")])
ENTRY = np.dtype([("gram", "<u4"), ("log", "<f4")])
LOG = np.dtype([("log", "<f4")])
SCORED = "doc_id long, lang string, n_bytes long, log_sum double"


def grams_of(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each byte the code of it and the three before it in its text (zeros before the text's start)."""
    code = data.astype(np.uint32)
    place = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    for back in (1, 2, 3):
        before = np.zeros(len(data), np.uint32)
        before[back:] = data[: len(data) - back]
        before[place < back] = 0
        code |= before << np.uint32(8 * back)
    return code


def _deal_ids(groups: int):
    """Training: the ids of trusted texts to the groups that have the texts."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            rows = [(g, TRUSTED, packed(ids[members].view(ID))) for g, members in split_by(group_of(ids, ids, groups))]
            if NO_ID in ids:  # a text of this id is dealt by its hash, as one without an id
                rows += [(g, TRUSTED, packed(np.array([NO_ID]).view(ID))) for g in range(groups)]
            yield rows_of(rows)

    return run


def _sum_counts(table: pa.Table) -> pa.Table:
    """Training: grams of one shard with their counts in all trusted texts."""
    told = np.concatenate([unpacked(b, COUNT)[0] for _, b in _kinds(table)])
    grams, own = np.unique(told["gram"], return_inverse=True)
    counts = np.zeros(len(grams), np.int64)
    np.add.at(counts, own, told["c"].astype(np.int64))
    return pa.table({"gram": pa.array(grams.astype(np.int64)), "c": pa.array(counts)})


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts of one, two, and three or more."""
    n = counts.filter("c <= 4").groupBy("c").count().collect()
    n1, n2, n3, n4 = (next((r["count"] for r in n if r.c == k), 0) for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    of = lambda k, a, b: min(max(k - (k + 1) * y * b / a, 0.0), float(k)) if a and b else 0.75 * min(k, 1)
    return of(1, n1, n2), of(2, n2, n3), of(3, n3, n4)


def low_bytes(gram: Column, n: int) -> Column:
    return gram.bitwiseAND((1 << 8 * n) - 1)


def model_tables(counts: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """For orders 1 ... 4: p (gram, p: interpolated probability of its last byte) and weights (context, gamma)."""
    of_order = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):  # continuation counts: how many bytes come before
        of_order[k] = stored(of_order[k + 1].groupBy(low_bytes(F.col("gram"), k).alias("gram")).agg(F.count("*").alias("c")), "kn-counts")
    tables: list[tuple[DataFrame, DataFrame]] = []
    for k in range(1, ORDER + 1):
        d1, d2, d3 = discounts(of_order[k])
        discount = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        rows = of_order[k].withColumn("context", F.shiftright("gram", 8)).withColumn("d", discount)
        sums = rows.groupBy("context").agg(F.sum("c").alias("total"), (F.sum("d") / F.sum("c")).alias("gamma"))
        joined = rows.join(sums, "context").withColumn("alpha", (F.col("c") - F.col("d")) / F.col("total"))
        if k == 1:
            p = joined.select("gram", (F.col("alpha") + F.col("gamma") / 256).alias("p"))
        else:
            lower = tables[-1][0].select(F.col("gram").alias("suffix"), F.col("p").alias("q"))
            p = joined.withColumn("suffix", low_bytes(F.col("gram"), k - 1)).join(lower, "suffix").select("gram", (F.col("alpha") + F.col("gamma") * F.col("q")).alias("p"))
        tables.append((stored(p, "kn-p"), stored(sums.select("context", "gamma"), "kn-gamma")))
    return tables


def probabilities(grams: DataFrame, tables: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """shard, gram, log: log10 of the probability of each gram's last byte after the others, seen or not."""
    p: Column = F.lit(1 / 256)
    for k, (seen, weights) in enumerate(tables, 1):
        grams = grams.join(seen.select(F.col("gram").alias(f"g{k}"), F.col("p").alias(f"p{k}")), low_bytes(F.col("gram"), k) == F.col(f"g{k}"), "left")
        grams = grams.join(weights.select(F.col("context").alias(f"c{k}"), F.col("gamma").alias(f"w{k}")), F.shiftright(low_bytes(F.col("gram"), k), 8) == F.col(f"c{k}"), "left")
        p = F.coalesce(F.col(f"p{k}"), F.coalesce(F.col(f"w{k}"), F.lit(1.0)) * p)
    return grams.select("shard", "gram", F.log10(p).cast("float").alias("log"))


def _group_grams(table: pa.Table, schema: pa.Schema) -> list[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    out = []
    for batch in documents(table, schema):
        data, offsets = column_bytes(batch.column(schema.get_field_index("_bytes")))
        out.append((batch, grams_of(data, offsets), offsets))
    return out


def _shard_of(grams: np.ndarray, shards: int) -> np.ndarray:
    return (mixed(grams.astype(np.uint64)) % np.uint64(shards)).astype(np.int64)


def _tell(schema: pa.Schema, shards: int):
    def run(table: pa.Table) -> pa.Table:
        trusted = np.concatenate([np.zeros(0, np.int64), *(unpacked(b, ID)[0]["id"] for k, b in _kinds(table) if k == TRUSTED)])
        parts, learnt = [], []
        for batch, g, offsets in _group_grams(table, schema):
            parts.append(np.unique(g))
            ids = batch.column(schema.get_field_index("doc_id"))
            taken = np.asarray(ids.is_valid()) & np.isin(np.asarray(ids.fill_null(NO_ID)), trusted)
            learnt.append(g[np.repeat(taken, np.diff(offsets))])
        grams = np.unique(np.concatenate([np.zeros(0, np.uint32), *parts]))
        group = int(table.column("grp")[0].as_py()).to_bytes(8, "little")
        rows = []
        for s, members in split_by(_shard_of(grams, shards)):
            out = np.empty(len(members), GRAM)
            out["gap"] = np.diff(grams[members], prepend=np.uint32(0))
            rows.append((s, TOLD, packed(out, group)))
        grams, counts = np.unique(np.concatenate([np.zeros(0, np.uint32), *learnt]), return_counts=True)
        for s, members in split_by(_shard_of(grams, shards)):
            out = np.empty(len(members), COUNT)
            out["gram"], out["c"] = grams[members], counts[members]
            rows.append((s, COUNTS, packed(out)))
        return pa.Table.from_batches([rows_of(rows)])

    return tidy(run)


def _distinct(table: pa.Table) -> pa.Table:
    grams = np.unique(np.concatenate([np.cumsum(unpacked(b, GRAM)[0]["gap"], dtype=np.uint32) for _, b in _kinds(table)]))
    return pa.table({"shard": pa.array(np.full(len(grams), table.column("grp")[0].as_py()), pa.int64()), "gram": pa.array(grams.astype(np.int64))})


def _pack_model(table: pa.Table) -> pa.Table:
    out = np.empty(table.num_rows, ENTRY)
    out["gram"], out["log"] = table.column("gram").to_numpy(), table.column("log").to_numpy()
    return pa.Table.from_batches([rows_of([(table.column("shard")[0].as_py(), MODEL, packed(np.sort(out, order="gram")))])])


def _answer(table: pa.Table) -> pa.Table:
    model, rows = next(unpacked(b, ENTRY)[0] for k, b in _kinds(table) if k == MODEL), []
    shard = int(table.column("grp")[0].as_py()).to_bytes(8, "little")
    for kind, blob in _kinds(table):
        if kind == TOLD:
            told, group = unpacked(blob, GRAM)
            grams = np.cumsum(told["gap"], dtype=np.uint32)
            logs = np.ascontiguousarray(model["log"][np.searchsorted(model["gram"], grams)])
            rows.append((int.from_bytes(group, "little"), ANSWERS, packed(logs.view(LOG), shard)))
    return pa.Table.from_batches([rows_of(rows)])


def _score(schema: pa.Schema, shards: int):
    out = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("n_bytes", pa.int64()), ("log_sum", pa.float64())])

    def run(table: pa.Table) -> pa.Table:
        parts = _group_grams(table, schema)
        grams = np.unique(np.concatenate([np.zeros(0, np.uint32), *(np.unique(g) for _, g, _ in parts)]))
        logs = np.zeros(len(grams))
        answers = {int.from_bytes(t, "little"): x["log"] for x, t in (unpacked(b, LOG) for k, b in _kinds(table) if k == ANSWERS)}
        for s, members in split_by(_shard_of(grams, shards)):
            logs[members] = answers[s]
        batches = []
        for batch, g, offsets in parts:
            sums = np.concatenate(([0.0], np.cumsum(logs[np.searchsorted(grams, g)])))
            column = lambda name, batch=batch: batch.column(schema.get_field_index(name))
            batches.append(pa.RecordBatch.from_arrays([column("doc_id"), column("lang"), pa.array(np.diff(offsets)), pa.array(sums[offsets[1:]] - sums[offsets[:-1]])], schema=out))
        return pa.Table.from_batches(batches, out)

    return tidy(run)


def chosen_margin(rows: DataFrame) -> float:
    """The margin of MARGINS with the least share of junk (_q 0) kept plus share of trusted (_q 1) lost; of equals the widest.
    rows: x (perplexity over the quantile), _q."""
    inside = lambda m: F.sum((F.col("x") <= m).cast("long"))
    by = {r._q: r for r in rows.groupBy("_q").agg(F.count("*").alias("n"), *(inside(m).alias(f"k{i}") for i, m in enumerate(MARGINS))).collect()}
    share = lambda q, i: by[q][f"k{i}"] / by[q]["n"] if q in by else float(q)
    return max(enumerate(MARGINS), key=lambda m: (share(1, m[0]) - share(0, m[0]), m[1]))[1]


def judge_quality(docs: DataFrame, labels: DataFrame, quantile: float = 0.99, margin: float | None = None, train_rows: int | None = None) -> DataFrame:
    """doc_id, lang, n_bytes, perplexity (per byte), threshold, keep for each row of ``docs`` (doc_id, text, lang).

    Trusted are all rows of ``labels`` (doc_id, quality) with quality 1, and the model is trained on all of them, or, if asked for, on
    the ``train_rows`` with the smallest hashes of doc_id. A text is kept when its perplexity is at most ``margin`` times the
    ``quantile`` of that of trusted texts
    of its language; without ``margin`` it is chosen from MARGINS by the labels of both qualities: the share of junk kept plus
    that of trusted texts lost is least, and of equals the widest. A language without trusted texts takes the quantile over all. Null and empty texts have no perplexity
    and aren't kept; a null doc_id or language stays null; repeated rows are judged each on its own; an empty table gives
    no rows; without trusted texts all grams are alike, and all texts with a byte are kept.
    """
    good = labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("_t")).distinct()
    taken = good if train_rows is None else good.orderBy(F.xxhash64("_t"), "_t").limit(train_rows)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), as_text().alias("_bytes"))
    shards = 8 * max(8, docs.rdd.getNumPartitions())
    keyed = keyed.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("_id"), F.xxhash64("_bytes").alias("_row"), "doc_id", "lang", "_bytes")
    schema = to_arrow_schema(keyed.schema)
    texts = keyed.mapInArrow(_deal(("_id", "_row", "_bytes"), shards), ROWS)
    # Texts meet the ids in their groups: a join of the texts with them would shuffle all texts a third time.
    all_told = stored(texts.unionByName(taken.mapInArrow(_deal_ids(shards), ROWS)).groupBy("grp").applyInArrow(_tell(schema, shards), ROWS), "kn-told")
    told, counted = (all_told.filter(F.col("kind") == x) for x in (TOLD, COUNTS))
    tables = model_tables(stored(counted.groupBy("grp").applyInArrow(_sum_counts, "gram long, c long"), "kn-counts"))
    grams = told.groupBy("grp").applyInArrow(_distinct, "shard long, gram long")
    model = probabilities(grams, tables).groupBy("shard").applyInArrow(_pack_model, ROWS)
    answers = stored(told.unionByName(model).groupBy("grp").applyInArrow(_answer, ROWS), "kn-answers")
    forget(all_told)
    scored = texts.unionByName(answers).groupBy("grp").applyInArrow(_score(schema, shards), SCORED)
    scored = stored(scored.withColumn("perplexity", F.when(F.col("n_bytes") > 0, F.pow(F.lit(10.0), -F.col("log_sum") / F.col("n_bytes")))), "kn-scores")

    at = F.percentile_approx("perplexity", quantile, 10_000)
    trusted = scored.filter("n_bytes > 0").join(good, F.col("doc_id") == F.col("_t"), "left_semi")
    limits = trusted.groupBy("lang").agg(at.alias("own"))
    overall = trusted.agg(at.alias("x")).head().x
    judged = scored.join(limits, scored.lang.eqNullSafe(limits.lang), "left").drop(limits.lang)
    limit = F.coalesce("own", F.lit(overall), F.lit(float("inf")))
    if margin is None:
        marked = labels.filter("doc_id is not null and quality in (0, 1)").select(F.col("doc_id").cast("long").alias("_t"), F.col("quality").cast("int").alias("_q")).distinct()
        margin = chosen_margin(judged.filter("n_bytes > 0").select("doc_id", (F.col("perplexity") / limit).alias("x")).join(marked, F.col("doc_id") == F.col("_t")))
    threshold = margin * limit
    return judged.select("doc_id", "lang", "n_bytes", "perplexity", threshold.alias("threshold"), F.coalesce(F.col("perplexity") <= threshold, F.lit(False)).alias("keep"))
