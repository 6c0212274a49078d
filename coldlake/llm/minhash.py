"""Near-duplicate groups: min-max hashing for candidates, exact Jaccard similarity for links.

1. Every text becomes its set of distinct word shingles. Texts with equal sets collapse to one node.
2. Min-max hashing keeps the smallest and the largest hash of the set under each permutation, so 70
   permutations give a signature of 140 values. Bands of 5 values go to buckets; two sets of
   similarity 0.8 share none of the 28 buckets with probability 1.5e-5.
3. Each bucket gives one edge from every node to its smallest node, never all pairs. Components of
   these edges hold all candidate pairs.
4. Within a component, sets are compared in blocks of bounded rows and weight. A component of one
   block is one local comparison. A larger one is first compared along the diagonal and with its
   first block (work in proportion to its size). Then only nodes that share a bucket and are not yet
   in one linked group are compared, bucket by bucket, or the component's blocks with each other
   where that is less work; blocks whose sizes cannot fit are left out. So no link between different
   groups is lost, large groups of near copies do not cost all their pairs, and a long chain of
   weakly similar texts costs in proportion to its length, as its buckets are small. What is left
   is a single bucket of many unlinked texts of like size, which costs its pairs.
5. Comparisons emit the links of a spanning forest, of which components are taken again.

Every link is confirmed on the full sets: 100 x intersection >= 100 x similarity x union. Shingles
are compared by 64-bit hashes.

Null and empty texts have no set and stand alone. Null ids are no component's smallest id unless it
has no other. Rows that share id and set are one document. Other columns do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coldlake.llm import exact
from coldlake.llm.common import bound_batches, map_groups, materialise, release_memory
from coldlake.llm.components import connected_components
from coldlake.llm.shingles import WordHasher, mix, shingle_hashes

PERMUTATIONS = 70
BAND_ROWS = 5
#: Most rows, and shingles, that a block of a component is meant to hold.
BLOCK_ROWS = 256
BLOCK_SHINGLES = 400_000
#: Linked groups of at least this many nodes get blocks of their own.
LARGE_GROUP = 512
#: Words that a task remembers the hashes of.
REMEMBER = 100_000
#: Sets with a larger share of all rows than one in so many are joined by broadcast.
HOT_SETS = 4096


class MinMaxHasher:
    """Signatures of sets of 64-bit hashes; deterministic for a seed."""

    def __init__(self, permutations: int = PERMUTATIONS, rows: int = BAND_ROWS, seed: int = 11):
        random = np.random.default_rng(seed)
        self.factor = random.integers(0, 2**32, (permutations, 1), np.uint32) | np.uint32(1)
        self.shift = random.integers(0, 2**32, (permutations, 1), np.uint32)
        self.bands = 2 * permutations // rows
        self.rows = rows

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        """Smallest and largest hash under each permutation, in turn; 32 bits each."""
        folded = (hashes >> np.uint64(32)).astype(np.uint32)
        out = np.empty((len(self.factor), 2), np.uint32)
        out[:, 0], out[:, 1] = 2**32 - 1, 0
        for begin in range(0, len(folded), 512):
            value = folded[None, begin : begin + 512] * self.factor
            value += self.shift
            value ^= value >> np.uint32(16)
            np.minimum(out[:, 0], value.min(1), out=out[:, 0])
            np.maximum(out[:, 1], value.max(1), out=out[:, 1])
        return out.reshape(-1)

    def band_keys(self, signature: np.ndarray) -> np.ndarray:
        """One 64-bit key for each band, its number mixed in."""
        values = signature[: self.bands * self.rows].reshape(self.bands, self.rows).astype(np.uint64)
        key = np.arange(1, self.bands + 1, dtype=np.uint64)
        for k in range(self.rows):
            key = mix(key ^ values[:, k])
        return key.view(np.int64)


def set_digest(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def signatures(docs: DataFrame, id_col: str, text_col: str, size: int, hasher: MinMaxHasher) -> DataFrame:
    """id, n (set size), digest of the set and band keys; both null for an empty set."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = WordHasher()
        for batch in batches:
            sizes, digests, bands = [], [], []
            for text in batch["text"]:
                if len(words) > REMEMBER:
                    words.clear()
                hashes = shingle_hashes(text, words, size)
                sizes.append(len(hashes))
                digests.append(set_digest(hashes) if len(hashes) else None)
                bands.append(hasher.band_keys(hasher.signature(hashes)) if len(hashes) else None)
            yield pd.DataFrame({"id": batch["id"], "n": sizes, "digest": digests, "bands": bands})
        release_memory()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, "id long, n long, digest binary, bands array<long>")


def _sets(
    docs: DataFrame, id_col: str, text_col: str, size: int, wanted: DataFrame, n_wanted: int, repeated_ids: bool
) -> DataFrame:
    """The wanted nodes (id, digest, node, ...) with their hashes, from one text of each."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    h = F.xxhash64(F.coalesce(F.col("id"), F.lit(0)))
    bloom = exact.key_filter(wanted.select(h.alias("h")), n_wanted)
    some = exact.flag_repeated(rows.withColumn("h", h), "h", bloom, "hit").where("hit").select("id", "text")
    ids = wanted.select(F.col("id").alias("wanted_id")).distinct()
    some = some.join(ids, F.col("id").eqNullSafe(F.col("wanted_id")), "left_semi")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = WordHasher()
        for batch in batches:
            if len(words) > REMEMBER:
                words.clear()
            found = [shingle_hashes(t, words, size) for t in batch["text"]]
            yield pd.DataFrame(
                {"digest": [set_digest(f) for f in found], "hashes": [f.tobytes() for f in found]}
            )
        release_memory()

    sets = some.mapInPandas(run, "digest binary, hashes binary").join(wanted.drop("id"), "digest").drop("digest")
    return sets.dropDuplicates(["node"]) if repeated_ids else sets


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each left with each right set, by products of incidence blocks."""
    values = np.concatenate([*left, *right])
    owner = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in (*left, *right)])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    column = np.cumsum(np.concatenate([[0], values[1:] != values[:-1]]))
    of_left = owner < len(left)
    width = int(column[-1]) + 1 if len(column) else 0
    shared = (np.bincount(column[of_left], minlength=width) > 0) & (np.bincount(column[~of_left], minlength=width) > 0)
    keep = shared[column]
    column, owner = (np.cumsum(shared) - 1)[column[keep]], owner[keep]
    out = np.zeros((len(left), len(right)), np.float32)
    n, step = int(shared.sum()), 8192
    cuts = np.searchsorted(column, np.arange(0, n + step, step))
    for begin, first, last in zip(range(0, n, step), cuts[:-1], cuts[1:]):
        dense = np.zeros((len(left) + len(right), min(step, n - begin)), np.float32)
        dense[owner[first:last], column[first:last] - begin] = 1
        out += dense[: len(left)] @ dense[len(left) :].T
    return out


def _forest(adjacent: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric 0/1 matrix."""
    left = np.ones(len(adjacent), bool)
    out = []
    for root in range(len(adjacent)):
        stack = [root] if left[root] else []
        left[root] = False
        while stack:
            k = stack.pop()
            new = np.flatnonzero(adjacent[k] & left)
            left[new] = False
            out += [(k, j) for j in new.tolist()]
            stack += new.tolist()
    return out


def linked_pairs(sets: list[np.ndarray], first: int, percent: int) -> list[tuple[int, int]]:
    """Spanning forest of the links among ``sets``; with ``first`` > 0 only between the sets before
    and from that place."""
    n = len(sets)
    if n == 2:
        a, b = sets
        if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
            return []
        both = len(np.intersect1d(a, b, assume_unique=True))
        return [(0, 1)] if 100 * both >= percent * (len(a) + len(b) - both) else []
    sizes = np.array([len(s) for s in sets], np.int64)
    left, right = (sets[:first], sets[first:]) if first else (sets, sets)
    both = _overlaps(left, right).astype(np.int64)
    union = (sizes[:first] if first else sizes)[:, None] + (sizes[first:] if first else sizes)[None, :] - both
    link = 100 * both >= percent * union
    if not first:
        np.fill_diagonal(link, False)
        return _forest(link)
    whole = np.zeros((n, n), bool)
    whole[:first, first:] = link
    whole[first:, :first] = link.T
    return _forest(whole)


def _compare(members: DataFrame, pairs: DataFrame | None, percent: int) -> DataFrame:
    """Links (u, v) within the pairs of blocks (part, low, high) of members (part, block, node, n, hashes).

    Without ``pairs``, each part is one block.
    """
    columns = ["part", "low", "high", "second", "node", "hashes"]
    if pairs is None:
        rows = members.select("part", F.lit(0).alias("low"), F.lit(0).alias("high"), F.lit(False).alias("second"), "node", "hashes")
    else:
        low = members.join(pairs.withColumn("block", F.col("low")), ["part", "block"]).withColumn("second", F.lit(False))
        high = members.join(pairs.where("low != high").withColumn("block", F.col("high")), ["part", "block"])
        rows = low.select(*columns).unionByName(high.withColumn("second", F.lit(True)).select(*columns))

    def run(key: tuple, group: dict[str, np.ndarray]) -> Iterator[pd.DataFrame]:
        order = np.argsort(group["second"], kind="stable")
        nodes = group["node"][order]
        sets = [np.frombuffer(group["hashes"][k], np.uint64) for k in order]
        first = int((~group["second"].astype(bool)).sum())
        if len(nodes) < 2 or (key[1] != key[2] and first in (0, len(nodes))):
            return
        found = linked_pairs(sets, 0 if key[1] == key[2] else first, percent)
        if found:
            yield pd.DataFrame({"u": [nodes[a] for a, _ in found], "v": [nodes[b] for _, b in found]})

    return map_groups(rows, ["part", "low", "high"], run, "u long, v long")


def near_duplicate_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80
) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id (smallest id reachable), kept."""
    bound_batches(docs.sparkSession)
    hasher = MinMaxHasher()
    signed = materialise(signatures(docs, id_col, text_col, size, hasher), "signatures")
    nodes = signed.where("n > 0").groupBy("digest").agg(
        F.min("id").alias("id"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands")
    )
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")

    # candidates: every bucket's nodes lead to its smallest node
    keys = nodes.select("node", F.explode("bands").alias("key"))
    buckets = keys.groupBy("key").agg(F.min("node").alias("leader"), F.count("*").alias("held")).where("held > 1")
    buckets = materialise(buckets.select("key", "leader"), "buckets")
    edges = keys.join(buckets, "key").where("node != leader").select(F.col("node").alias("u"), F.col("leader").alias("v"))
    parts = connected_components(edges).withColumnRenamed("component", "part")

    wanted = materialise(nodes.join(parts, "node").select("id", "digest", "node", "n", "part"), "wanted")
    n_wanted = wanted.count()
    weights = wanted.groupBy("part").agg(F.count("*").alias("rows"), F.sum("n").alias("weight"))
    blocks = F.greatest(F.ceil(F.col("rows") / BLOCK_ROWS), F.ceil(F.col("weight") / BLOCK_SHINGLES))
    weights = materialise(weights.withColumn("blocks", F.when(F.col("rows") > 2, blocks).otherwise(F.lit(1))), "weights")
    placed = materialise(wanted.join(weights.select("part", "blocks"), "part"), "placed")
    # rows that share id and set are one node; only where ids repeat can there be any
    repeated_ids = not signed.groupBy("id").count().where("count > 1").isEmpty()
    members = materialise(_sets(docs, id_col, text_col, size, placed, n_wanted, repeated_ids), "members")

    links = _compare(members.where("blocks = 1"), None, percent)
    links = materialise(links, "links")
    large = members.where("blocks > 1")
    if not weights.where("blocks > 1").isEmpty():
        links = links.unionByName(_large_parts(large, weights.where("blocks > 1"), nodes.select("node", "bands"), percent))
    linked = connected_components(links)

    # a node's component, then its smallest id, then all rows with the node's set
    grouped = nodes.select("node", "digest", "id", "copies").join(linked, "node", "left")
    grouped = grouped.where("copies > 1 OR component IS NOT NULL")
    grouped = materialise(grouped.withColumn("component", F.coalesce("component", "node")), "grouped")
    smallest = grouped.groupBy("component").agg(F.min("id").alias("component_id"))
    named = grouped.join(materialise(smallest, "smallest"), "component").select("digest", "component_id", "copies")
    named = materialise(named, "named")
    # sets of more than 1/HOT_SETS of all rows, and so at most HOT_SETS, are joined by broadcast
    hot = F.col("copies") > max(1, signed.count() // HOT_SETS)
    rows = signed.select("id", "n", "digest")
    by_hot = rows.join(F.broadcast(named.where(hot).select("digest", F.col("component_id").alias("hot_id"))), "digest", "left")
    full = by_hot.where("n > 0 AND hot_id IS NULL").drop("hot_id")
    out = full.join(named.where(~hot).select("digest", "component_id"), "digest", "left").select("id", "n", "component_id")
    # hot sets, and empty ones, which share the null digest, need no shuffle
    apart = by_hot.where("n = 0 OR hot_id IS NOT NULL").select("id", "n", F.col("hot_id").alias("component_id"))
    out = out.unionByName(apart)
    component = F.coalesce("component_id", "id")
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )


def _large_parts(members: DataFrame, weights: DataFrame, bands: DataFrame, percent: int) -> DataFrame:
    """Links of the parts of several blocks; ``members`` is read twice, ``bands`` has node and bands."""
    spread = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("long")
    dealt = members.withColumn("block", spread)
    diagonal = weights.select("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("high"))
    pairs = diagonal.select("part", F.col("high").alias("low"), "high").unionByName(
        diagonal.where("high > 0").select("part", F.lit(0).cast("long").alias("low"), "high")
    )
    found = materialise(_compare(dealt, pairs, percent), "diagonal")
    groups = connected_components(found)

    # a large linked group has a tag of its own, all other nodes share one
    tagged = members.select("node", "part", "n").join(groups, "node", "left").join(bands, "node")
    sizes = groups.groupBy("component").agg(F.count("*").alias("held"))
    tagged = tagged.join(sizes.where(F.col("held") >= LARGE_GROUP).select("component", F.lit(True).alias("big")), "component", "left")
    tag = F.when(F.col("big"), F.col("component")).otherwise(F.lit(-1))
    own = F.coalesce("component", "node")
    tagged = materialise(tagged.select("node", "part", "n", tag.alias("tag"), own.alias("own"), "bands"), "tagged")

    cells = _cells(tagged, percent)
    counts = cells.groupBy("cell", "tag", "class").agg(F.count("*").alias("rows"), F.sum("n").alias("weight"))
    counts = materialise(counts.select("cell", "tag", "class", _pieces().alias("pieces")), "pieces")
    block = F.xxhash64("tag", "class", F.pmod(F.xxhash64("node"), F.col("pieces")))
    where = cells.join(counts, ["cell", "tag", "class"]).select("node", F.col("cell").alias("part"), block.alias("block"))
    dealt = members.select("node", "n", "hashes").join(where, "node")
    table = counts.select("cell", "tag", "class", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("k"))
    table = table.select(F.col("cell").alias("part"), "tag", "class", F.xxhash64("tag", "class", "k").alias("low"))
    other = table.select("part", F.col("tag").alias("tag2"), F.col("class").alias("class2"), F.col("low").alias("high"))
    pairs = table.join(other, "part").where("low <= high AND (tag != tag2 OR tag = -1) AND abs(class - class2) <= 1")
    pairs = materialise(pairs.select("part", "low", "high"), "pairs")
    return found.unionByName(materialise(_compare(dealt, pairs, percent), "crossed"))


def _pieces() -> Column:
    """Blocks for so many rows of so much weight."""
    return F.greatest(F.ceil(F.col("rows") / BLOCK_ROWS), F.ceil(F.col("weight") / BLOCK_SHINGLES))


def _cells(tagged: DataFrame, percent: int) -> DataFrame:
    """Rows (cell, node, n, tag, class): nodes that share a cell may be linked, all others not.

    The cells of a part are either its buckets, without those inside one linked group and those that
    hold the same nodes as another, or the part as a whole, whichever costs fewer comparisons. Sets
    of linked nodes lie in the same or in neighbouring size classes. Cells of one block have one
    tag and class.
    """
    # a bit wider than the ratio, so that rounding never puts linked sizes two classes apart
    size_class = F.floor(F.log(F.col("n")) / (math.log(100 / percent) * (1 + 1e-9))) if percent < 100 else F.col("n")
    rows = tagged.withColumn("class", size_class.cast("long"))
    spread = rows.withColumn("key", F.explode("bands")).drop("bands")
    held = spread.groupBy("part", "key").agg(
        F.count("*").alias("rows"), F.sum("n").alias("weight"), F.bit_xor(F.xxhash64("node")).alias("mark"),
        F.min("own").alias("least"), F.max("own").alias("most"),
    )
    held = held.where("least != most").groupBy("part", "rows", "weight", "mark").agg(F.min("key").alias("key"))
    held = materialise(held.select("key", (_pieces() == 1).alias("small")), "held")
    wide = rows.select("part", "node", "n", "tag", "class", F.col("part").alias("cell"), F.lit(False).alias("small"))
    narrow = spread.join(held, "key").select("part", "node", "n", "tag", "class", F.col("key").alias("cell"), "small")

    def cost(cells: DataFrame, name: str) -> DataFrame:
        of_tag = cells.groupBy("part", "cell", "tag").agg(F.count("*").cast("double").alias("k"))
        of_tag = of_tag.groupBy("part", "cell").agg(
            F.sum("k").alias("all"), F.sum(F.when(F.col("tag") != -1, F.col("k") * F.col("k")).otherwise(0.0)).alias("within")
        )
        return of_tag.groupBy("part").agg(F.sum(F.col("all") * F.col("all") - F.col("within")).alias(name))

    costs = cost(wide, "whole").join(cost(narrow, "buckets"), "part", "left")
    costs = materialise(costs.select("part", (F.coalesce("buckets", F.lit(0.0)) <= F.col("whole")).alias("by_bucket")), "costs")
    chosen = wide.join(costs.where("NOT by_bucket"), "part").unionByName(narrow.join(costs.where("by_bucket"), "part"))
    one = F.col("small")
    return materialise(
        chosen.select(
            "cell", "node", "n",
            F.when(one, F.lit(-1)).otherwise(F.col("tag")).cast("long").alias("tag"),
            F.when(one, F.lit(0)).otherwise(F.col("class")).cast("long").alias("class"),
        ),
        "cells",
    )


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80
) -> DataFrame:
    """The rows of ``docs`` that stay, one document of each group, with their own columns.

    An id goes if none of its rows is kept, so ids should be unique. Rows that a Bloom filter of the
    ids that go clears are passed on from the scan; only the others are shuffled.
    """
    groups = near_duplicate_groups(docs, id_col, text_col, size, percent)
    gone = groups.groupBy(F.col(id_col).alias("gone_id")).agg(F.max("kept").alias("kept")).where("NOT kept")
    gone = materialise(gone.select("gone_id"), "gone")
    columns = docs.columns
    h = F.xxhash64(F.coalesce(F.col(id_col).cast("long"), F.lit(0)))
    of_gone = F.xxhash64(F.coalesce(F.col("gone_id"), F.lit(0)))
    bloom = exact.key_filter(gone.select(of_gone.alias("h")), gone.count())
    rows = docs.select(F.struct(*columns).alias("row"), h.alias("h"), F.col(id_col).alias("row_id"))
    flagged = exact.flag_repeated(rows, "h", bloom, "hit")
    suspects = flagged.where("hit").join(gone, F.col("row_id").eqNullSafe(F.col("gone_id")), "left_anti")
    return flagged.where("NOT hit").select("row.*").unionByName(suspects.select("row.*")).select(*columns)
