"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Targets. Sources in code-point order (null last) get the given weights in turn and share
``share`` times all words by weight. No target exceeds ``epochs`` times its source's words; the
excess is shared anew by weight among the others until no target does.

Blocks. A source's documents are ordered by a seeded hash of id and text, which permutes them, and
cut at equal hash ranges into 2^k blocks. Its quota of block copies is exact: all blocks as often as
its target allows whole, and once more those up to the last one that the rest of the target reaches.
Of these last blocks the documents that go on fit into what is still wanted: in hash order, skipping
each document with more words than that, down to the end of the order; so less is wanting than any
document left out holds. The places are found in rounds: the hash is descended digit by digit with
one small aggregation each to the first document that does not fit, and the next round starts behind
it with the documents that fit the smaller gap. At last one document at a time is added, dropped or
exchanged for another as long as that comes nearer. The rule is the same for sources of any size.

Splitting tree. The quotas of all sources are partitioned among the output shards: a node's counts
are drawn for its left half by a multivariate hypergeometric distribution and the rest goes right,
down to single shards. A source's block copies are numbered in a seeded permuted order, of which
shards draw disjoint runs as long as their counts. What a shard draws is what the mix takes: a
document's ``taken`` words are its size times the drawn copies that hold it. Shards order their
documents by a hash.

The driver holds one row for each source and, for the tree, sources x shards counts; sources are
names of corpora, so both are small, and ``max_sources`` guards the first. All draws are seeded:
reruns agree. Null texts have size 0 and travel with their blocks; an empty table gives an empty
mix; long texts are counted whole. Rows that share id and text are taken alike. Other columns pass
through; result columns replace columns of their name.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from coldlake.llm.common import BROADCAST_LIMIT_BYTES, free_name, materialise

WORD_PATTERN = r"[^\x20\x09-\x0D]+"
DIGIT_BITS = 8
DIGITS = 7  # of the 63-bit hash that are descended; ties beyond are taken together
#: Documents in a block on average; doubled until all quotas together stay below MAX_QUOTAS, the
#: range in which hypergeometric draws are exact.
DOCS_PER_BLOCK = 64
MAX_QUOTAS = 1 << 29
MAX_SOURCES = 1_000_000
HASH_BITS = 56
#: Of a source: documents of u from start to below stop with at most cap words are taken once more.
PARTS = "array<struct<start:long,stop:long,cap:long>>"


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], share: float, epochs: float) -> list[float]:
    """Target words of each source: shares by weight, none above ``epochs`` times its size."""
    total, caps = share * sum(sizes), [epochs * s for s in sizes]
    out, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    left = total
    while open_:
        unit = left / sum(weights[k] for k in open_)
        full = {k for k in open_ if weights[k] * unit > caps[k]}
        if not full:
            for k in open_:
                out[k] = weights[k] * unit
            break
        for k in full:
            out[k] = caps[k]
            left -= caps[k]
        left = max(left, 0.0)
        open_ -= full
    return out


def splitting_tree(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Counts (shards x sources) with the given column sums; shard sizes differ by at most one."""
    random = np.random.default_rng(seed)
    out = np.zeros((shards, len(quotas)), np.int64)

    def draw(counts: np.ndarray, n: int) -> np.ndarray:
        taken, rest = np.zeros_like(counts), int(counts.sum())
        for k, c in enumerate(counts.tolist()):  # conditional hypergeometric draws
            rest -= c
            got = n if rest == 0 else 0 if c == 0 or n == 0 else int(random.hypergeometric(c, rest, n))
            taken[k] = got
            n -= got
        return taken

    todo = [(0, shards, quotas.astype(np.int64))]
    while todo:
        begin, end, counts = todo.pop()
        if end - begin == 1:
            out[begin] = counts
            continue
        middle = (begin + end) // 2
        total = int(counts.sum())
        left = draw(counts, total * (middle - begin) // (end - begin))
        todo += [(middle, end, counts - left), (begin, middle, left)]
    return out


def plan_mix(
    docs: DataFrame,
    weights: tuple[float, ...],
    share: float,
    epochs: float,
    id_col: str,
    text_col: str,
    source_col: str,
    seed: int,
    max_sources: int,
) -> tuple[DataFrame, pd.DataFrame]:
    """The table (id, source, size, u) of all documents, and the plan: a row for each source."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    table = materialise(
        docs.select(
            F.col(id_col).alias("id"),
            F.col(source_col).alias("source"),
            word_count(F.col(text_col)).alias("size"),
            F.shiftrightunsigned(F.xxhash64(F.lit(seed), id_col, text), 64 - HASH_BITS).alias("u"),
        ),
        "sizes",
    )
    found = table.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("docs"))
    rows = found.limit(max_sources + 1).collect()
    if len(rows) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    rows.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    plan = pd.DataFrame({"source": [r["source"] for r in rows], "size": [r["size"] for r in rows], "docs": [r["docs"] for r in rows]})
    plan["source"] = plan["source"].astype(object)
    plan["weight"] = [float(weights[k % len(weights)]) for k in range(len(plan))]
    plan["target"] = targets(plan["size"].tolist(), plan["weight"].tolist(), share, epochs)
    sizes = plan["size"].to_numpy(float)
    plan["whole"] = [int(t // s + 1e-9) if s else 0 for t, s in zip(plan["target"], sizes)]
    plan["extra"] = [max(0.0, t - w * s) for t, w, s in zip(plan["target"], plan["whole"], sizes)]
    _thresholds(table, plan)
    return table, plan


def _small(side: DataFrame, size: int) -> DataFrame:
    """``side`` marked for broadcast if its size in bytes allows it; otherwise it is joined by a shuffle."""
    return F.broadcast(side) if size <= BROADCAST_LIMIT_BYTES else side


def _local(like: DataFrame, rows: list, schema: str) -> DataFrame:
    """Rows as a table, handed over as an Arrow table: no Python worker has to start for it."""
    spark = like.sparkSession
    kinds = to_arrow_schema(spark.createDataFrame([], schema).schema)
    columns = list(zip(*rows)) or [()] * len(kinds)
    return spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(columns, kinds)], schema=kinds))


def _frame(table: DataFrame, plan: pd.DataFrame, columns: list[str]) -> DataFrame:
    """``table`` with columns of its source's plan row."""
    kinds = {"start": "long", "low": "long", "cap": "long", "gap": "double", "parts": PARTS, "fill": "array<long>", "gone": "array<long>"}
    casts = {"double": float, "long": int, PARTS: list, "array<long>": list}
    values = [[int(i), s, *r] for i, s, r in zip(plan.index, plan["source"], plan[columns].values.tolist())]
    schema = "number int, name string, " + ", ".join(f"{c} {kinds[c]}" for c in columns)
    values = [[v[0], v[1], *(casts[kinds[c]](x) for c, x in zip(columns, v[2:]))] for v in values]
    side = _local(table, values, schema)
    return table.join(_small(side, len(values) * 64), F.col("source").eqNullSafe(F.col("name"))).drop("name")


def _thresholds(table: DataFrame, plan: pd.DataFrame) -> None:
    """Add to the plan: ``parts`` of the hash order whose fitting documents are taken once more, and
    ``fill`` and ``gone``, documents (by u) that an exchange adds or takes away."""
    plan["gap"] = plan["extra"]
    parts: list[list[tuple[int, int, int]]] = [[] for _ in range(len(plan))]
    start, going = [0] * len(plan), set(plan.index[plan["gap"] >= 1])
    work = table.where("size > 0")
    while going:
        # each round takes a document of every source that goes on, and usually far more
        plan["start"], plan["cap"] = start, plan["gap"].astype("int64")
        stop, words, blocked, equal = _descend(work, plan, sorted(going))
        for k in list(going):
            if k not in words:  # nothing that fits is left
                going.discard(k)
                continue
            parts[k].append((start[k], stop[k], int(plan.loc[k, "cap"])))
            plan.loc[k, "gap"] -= words[k]
            # a single document is left out by the next cap; equal hashes are passed over as one
            start[k] = stop[k] + (k in equal)
            if k not in blocked or plan.loc[k, "gap"] < 1:
                going.discard(k)
    plan["parts"] = parts
    plan["fill"] = [[] for _ in range(len(plan))]
    plan["gone"] = [[] for _ in range(len(plan))]
    _exchange(work, plan)


def _descend(work: DataFrame, plan: pd.DataFrame, going: list[int]) -> tuple[dict[int, int], dict[int, int], set[int], set[int]]:
    """Of each source in ``going``, over documents from its start with at most ``cap`` words: the hash
    of the first one that the words before it leave no room for (or the end), the words before it
    (none without documents), the sources that stopped before their end, and those of them that stopped
    at documents of one hash."""
    rows = plan.loc[going]
    low, gap = dict.fromkeys(going, 0), rows["cap"].to_dict()
    words: dict[int, int] = {}
    open_, blocked = set(going), set()
    bits = HASH_BITS
    for _ in range(DIGITS):
        bits -= DIGIT_BITS
        todo = plan.loc[sorted(open_), ["source", "start", "cap"]].assign(low=[low[k] for k in sorted(open_)])
        here = _frame(work, todo, ["start", "cap", "low"]).where("u >= start AND size <= cap")
        inside = here.where(F.shiftright("u", bits + DIGIT_BITS) == F.shiftright("low", bits + DIGIT_BITS))
        cell = F.shiftright(F.col("u"), bits).alias("cell")
        counts = inside.groupBy("number", cell).agg(F.sum("size").alias("words"), F.count("*").alias("n"))
        for number, group in counts.toPandas().sort_values(["number", "cell"]).groupby("number"):
            # at most 2^DIGIT_BITS cells of each source
            words.setdefault(number, 0)
            full = False
            for c, size, n in zip(group["cell"].tolist(), group["words"].tolist(), group["n"].tolist()):
                if size > gap[number]:
                    low[number], full = c << bits, n > 1
                    if n == 1 or not bits:
                        blocked.add(number)
                    break
                gap[number] -= size
                words[number] += size
                low[number] = (c + 1) << bits
            if not full:  # the end, or a single document
                open_.discard(number)
        open_ &= set(words)
        if not open_:
            break
    return low, words, blocked, open_


def _exchange(work: DataFrame, plan: pd.DataFrame) -> None:
    """Add, drop or exchange one document of a source as long as that brings the taken words nearer to
    the target. Of documents with equal word counts only one counts, so a group has fewer rows than
    twice the square root of twice its source's words."""

    def best(rows: pd.DataFrame) -> pd.DataFrame:
        number, gap = int(rows["number"].iloc[0]), float(rows["gap"].iloc[0])
        rows = rows.sort_values(["words", "u"])
        taken, words, u = rows["taken"].to_numpy(bool), rows["words"].to_numpy(), rows["u"].to_numpy()
        into, out = (np.concatenate([[0], words[k]]) for k in (~taken, taken))
        want = np.searchsorted(into, out + gap)
        near = np.stack([np.clip(want - 1, 0, None), np.clip(want, None, len(into) - 1)])
        left = gap + out[None, :] - into[near]
        side, b = np.unravel_index(int(np.argmin(np.abs(left))), left.shape)
        a = near[side, b]
        add = int(u[~taken][a - 1]) if a else -1
        drop = int(u[taken][b - 1]) if b else -1
        return pd.DataFrame({"number": [number], "add": [add], "drop": [drop], "left": [float(left[side, b])]})

    going = set(plan.index)
    while len(todo := plan[(plan["gap"].abs() >= 1) & plan.index.isin(going)]):
        rows = _frame(work, todo, ["gap", "parts", "fill", "gone"]).select("number", "gap", "u", "size", _once().alias("taken"))
        shared = rows.groupBy("number", "gap", "u").agg(F.sum("size").alias("words"), F.max("taken").alias("taken"))
        sizes = shared.groupBy("number", "gap", "words", "taken").agg(F.min("u").alias("u"))
        found = sizes.groupBy("number").applyInPandas(best, "number int, add long, drop long, left double").collect()
        going = set()
        for r in found:
            k = r["number"]
            if abs(r["left"]) >= abs(plan.loc[k, "gap"]):
                continue
            going.add(k)
            plan.loc[k, "gap"] = r["left"]
            for u, into, out in ((r["add"], "fill", "gone"), (r["drop"], "gone", "fill")):
                if u in plan.at[k, out]:
                    plan.at[k, out] = [x for x in plan.at[k, out] if x != u]
                elif u >= 0:
                    plan.at[k, into] = [*plan.at[k, into], u]


def _once():
    """Whether a row with u, size and its source's parts, fill and gone is taken once more."""
    inside = F.exists("parts", lambda p: (F.col("u") >= p["start"]) & (F.col("u") < p["stop"]) & (F.col("size") <= p["cap"]))
    return (inside & ~F.array_contains("gone", F.col("u"))) | F.array_contains("fill", F.col("u"))


def _quotas(plan: pd.DataFrame) -> np.ndarray:
    """Exact block copies of each source; adds to the plan k, for 2^k blocks, and their number."""
    size = DOCS_PER_BLOCK
    while True:
        plan["k"] = [max(0, math.ceil(math.log2(max(1, d / size)))) for d in plan["docs"]]
        plan["blocks"] = [1 << k for k in plan["k"]]
        out = []
        for whole, k, blocks, parts, fill in zip(plan["whole"], plan["k"], plan["blocks"], plan["parts"], plan["fill"]):
            # the first place behind all documents of the last epoch
            end = max([min(p[1], 1 << HASH_BITS) for p in parts if p[1] > p[0]] + [u + 1 for u in fill], default=0)
            out.append(whole * blocks + -(-end // (1 << (HASH_BITS - k))))
        if sum(out) < MAX_QUOTAS or not any(plan["k"]):
            return np.array(out, np.int64)
        size *= 2


def _permutation(quota: int, seed: int) -> tuple[int, int]:
    """Factor and shift that permute the numbers below ``quota``."""
    random = np.random.default_rng([seed, quota])
    factor = int(random.integers(1, max(2, quota)))
    while math.gcd(factor, quota) != 1:
        factor += 1
    return factor, int(random.integers(0, max(1, quota)))


def _copies(shards: int, seed: int):
    """Of a row with u, size and its source's plan: (shard, position) of the drawn copies that hold it."""

    def place(epoch):
        number = epoch.cast("long") * F.col("blocks") + F.expr(f"shiftrightunsigned(u, {HASH_BITS} - k)")
        drawn = F.pmod(number * F.col("factor") + F.col("shift"), F.greatest("quota", F.lit(1)))
        shard = F.size(F.filter("ends", lambda e: e <= drawn))
        # a number beyond the quota is no block copy
        shard = F.when(number < F.col("quota"), shard).otherwise(F.lit(shards))
        return F.struct(shard.alias("shard"), F.xxhash64(F.lit(seed + 1), "u", epoch).alias("position"))

    times = F.col("whole") + _once().cast("int")
    all_copies = F.transform(F.sequence(F.lit(0), times - 1), place)
    drawn = F.filter(all_copies, lambda c: c["shard"] < shards)
    return F.when(times > 0, drawn).otherwise(F.array().cast(COPIES))


COPIES = "array<struct<shard:int,position:bigint>>"
RESULT_COLUMNS = ("size", "source_size", "target", "taken", "copies")


def mix_sources(
    docs: DataFrame,
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    epochs: float = 2.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    shards: int = 16,
    seed: int = 5,
    max_sources: int = MAX_SOURCES,
) -> DataFrame:
    """All rows of ``docs`` with size, source_size, target, taken and copies.

    ``copies`` is an array of (shard, position): where the row's copies go in the mix, none if it is
    not taken. ``position`` orders a shard's documents.
    """
    _, plan = plan_mix(docs, weights, share, epochs, id_col, text_col, source_col, seed, max_sources)
    quotas = _quotas(plan) if len(plan) else np.zeros(0, np.int64)
    counts = splitting_tree(quotas, shards, seed) if len(plan) else np.zeros((shards, 0), np.int64)
    ends = np.cumsum(counts, axis=0).T  # of each source: block copies up to each shard
    side = []
    for k, (quota, end) in enumerate(zip(quotas.tolist(), ends.tolist())):
        p = plan.loc[k]
        factor, shift = _permutation(quota, seed + k)
        head = (p["source"], int(p["size"]), float(p["target"]), int(p["whole"]), p["parts"], p["fill"], p["gone"])
        side.append((*head, int(p["k"]), int(p["blocks"]), quota, factor, shift, end))
    schema = (
        f"name string, source_size long, target double, whole int, parts {PARTS}, fill array<long>, gone array<long>, "
        "k int, blocks long, quota long, factor long, shift long, ends array<long>"
    )
    names = [f.split()[0] for f in schema.split(", ")]
    plan_rows = _small(_local(docs, side, schema), sum(256 + 8 * shards + 24 * len(r[4]) for r in side))
    keep = [c for c in docs.columns if c.lower() not in RESULT_COLUMNS]
    # columns of docs keep clear of the plan's names
    safe = {c: free_name(docs, f"kept{n}") for n, c in enumerate(keep)}
    text = F.coalesce(F.col(text_col), F.lit(""))
    whole = docs.select(
        *[F.col(f"`{c}`").alias(safe[c]) for c in keep],
        F.col(source_col).alias("from"),
        word_count(F.col(text_col)).alias("size"),
        F.shiftrightunsigned(F.xxhash64(F.lit(seed), id_col, text), 64 - HASH_BITS).alias("u"),
    )
    joined = whole.join(plan_rows.toDF(*names), F.col("from").eqNullSafe(F.col("name")))
    placed = joined.withColumn("copies", _copies(shards, seed))
    taken = (F.col("size") * F.size("copies")).alias("taken")
    return placed.select(*[F.col(safe[c]).alias(c) for c in keep], "size", "source_size", "target", taken, "copies")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: a row for each copy, with the columns of ``docs``, dealt to shards and shuffled."""
    shards = options.get("shards", 16)
    safe = [f"column{k}" for k in range(len(docs.columns))]
    names = dict(zip(docs.columns, safe))
    plain = docs.toDF(*safe)
    for key, default in (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source")):
        options[key] = names[options.get(key, default)]
    mixed = mix_sources(plain, **options).select(*safe, F.explode("copies").alias("copy"))
    spread = mixed.select(*safe, F.col("copy.shard").alias("shard"), F.col("copy.position").alias("position"))
    dealt = spread.repartitionById(shards, F.col("shard")).sortWithinPartitions("position")
    return dealt.select(*[F.col(c).alias(name) for name, c in names.items()])
