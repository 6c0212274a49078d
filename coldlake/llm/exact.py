"""Exact duplicate removal by two-pass Bloom filtering, in DataFrame operations only.

Pass one is a counting Bloom filter held as a table: every text's hash asks for one of 32 cells a
row, and cells asked for at least twice stay (summed in each task before the shuffle, so one small
integer a row moves, whatever the texts' length, and a hot text counts as one). Those cells enter a
blocked bitmap of 16 bits a cell. Pass two probes the bitmap with every row: a row that misses has a
text that occurs once and passes straight through. Only the remaining rows are shuffled, by SHA-256
of the normalised text, and resolved exactly; false positives come out as groups of one.

The bitmap grows with the number of repeated texts and has no largest size: up to
``max_filter_bytes`` it is broadcast; beyond, rows meet its blocks by a join on the block number,
each block given ``SALTS`` times so that no task receives a hot block's rows. The result is the same.

Groups with more than 1/4096 of all rows, at most 4096 of them, are joined back by broadcast, so no
task receives a hot group's rows.

Normalisation lower-cases A-Z only; a null text counts as empty. Of equal texts, the row with the
largest id stays; null ids come after all others, and of rows that also share the id exactly one
stays. An empty table gives an empty result. Texts are hashed whole whatever their length. Other
columns pass through untouched, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coldlake.llm.common import ascii_lower, free_name, materialise

#: Cells of the counting filter for each row: a row whose text occurs once shares one by chance in 3 %.
CELLS_PER_ROW = 32
#: Bits of the bitmap for each value in it.
BITS_PER_KEY = 16
#: Bits of one bitmap block, the size that bitmap_construct_agg builds.
BLOCK_BITS = 32768
#: Bitmaps up to this size are broadcast.
MAX_FILTER_BYTES = 256 << 20
#: Copies of a block, by task of the probing side, where it is joined by a shuffle.
SALTS = 32
#: A group is hot beyond this share of all rows; there are at most as many hot groups.
HOT_GROUPS = 4096


def normalised(text: Column) -> Column:
    return ascii_lower(F.coalesce(text, F.lit("")))


@dataclass
class KeyFilter:
    """A Bloom filter as a table of blocks (block, words): 512 longs of 64 bits each."""

    table: DataFrame
    blocks: int
    #: Keys are hashes modulo this number; None if they are the hashes themselves.
    cells: int | None
    broadcast: bool


def _places(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    """The block of a key, and its two bits there."""
    first = F.xxhash64(key)
    second = F.xxhash64(first)
    bits = [second.bitwiseAND(BLOCK_BITS - 1), F.shiftrightunsigned(second, 20).bitwiseAND(BLOCK_BITS - 1)]
    return F.pmod(first, F.lit(blocks)), bits


def key_filter(
    keys: DataFrame, n: int, max_filter_bytes: int = MAX_FILTER_BYTES, cells: int | None = None
) -> KeyFilter:
    """Filter of the ``n`` values of long column ``h`` of ``keys``, which should be distinct."""
    blocks = max(1, -(-n * BITS_PER_KEY // BLOCK_BITS))
    block, bits = _places(F.col("h"), blocks)
    asked = keys.select(block.alias("block"), F.array(*bits).alias("bits")).repartition("block")
    built = asked.select("block", F.explode("bits").alias("bit")).groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bitmap"))
    # eight bytes at a time as a long, so that a probe is arithmetic
    piece = lambda k: F.conv(F.hex(F.substring("bitmap", (k * 8 + 1).cast("int"), F.lit(8))), 16, -10).cast("long")
    words = F.transform(F.sequence(F.lit(0), F.lit(BLOCK_BITS // 64 - 1)), piece)
    table = materialise(built.select("block", words.alias("words")), "bloom")
    return KeyFilter(table, blocks, cells, blocks * (BLOCK_BITS // 8 + 64) <= max_filter_bytes)


def repeated_filter(hashes: DataFrame, rows: int, max_filter_bytes: int = MAX_FILTER_BYTES) -> KeyFilter:
    """Filter of the values of long column ``h`` that may occur twice or more among ``rows`` rows."""
    cells = max(1, rows) * CELLS_PER_ROW
    counts = hashes.select(F.pmod("h", F.lit(cells)).alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    twice = materialise(counts.where("n > 1").select("h"), "cells")
    return key_filter(twice, twice.count(), max_filter_bytes, cells)


def flag_repeated(df: DataFrame, hash_col: str, bloom: KeyFilter, flag: str) -> DataFrame:
    """``df`` with boolean ``flag``: whether the filter holds the row's hash."""
    columns = df.columns
    block_name, words, salt = (free_name(df, x) for x in (f"{flag}_block", f"{flag}_words", f"{flag}_salt"))
    key = F.col(f"`{hash_col}`")
    block, bits = _places(key if bloom.cells is None else F.pmod(key, F.lit(bloom.cells)), bloom.blocks)
    built = bloom.table.select(F.col("block").alias(block_name), F.col("words").alias(words))
    probing = df.withColumn(block_name, block)
    if bloom.broadcast:
        joined = probing.join(F.broadcast(built), block_name, "left")
    else:
        probing = probing.withColumn(salt, F.pmod(F.spark_partition_id(), F.lit(SALTS)))
        built = built.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = probing.join(built.hint("merge"), [block_name, salt], "left")
    held = F.lit(True)
    for bit in bits:
        word = F.element_at(words, F.shiftright(bit, 6).cast("int") + 1)
        place = bit.bitwiseAND(63).bitwiseXOR(F.lit(56)).cast("int")  # the first byte is a long's highest
        held = held & (F.getbit(word, place) == 1)
    return joined.select(*[F.col(f"`{c}`") for c in columns], F.coalesce(held, F.lit(False)).alias(flag))


def _groups(candidates: DataFrame, id_col: str, rows: int) -> tuple[DataFrame, DataFrame]:
    """Digest, winner and size of each group of candidates: hot groups, and the others."""
    groups = candidates.groupBy("sha").agg(
        F.max(F.struct(F.col(id_col).alias("id"), F.col("rid").alias("rid"))).alias("best"),
        F.count("*").alias("group_size"),
    )
    groups = materialise(
        groups.select("sha", F.col("best.id").alias("keep_id"), F.col("best.rid").alias("keep_rid"), "group_size"),
        "groups",
    )
    hot = F.col("group_size") > max(1, rows // HOT_GROUPS)
    return groups.where(hot), groups.where(~hot)


def duplicate_groups(
    docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", max_filter_bytes: int = MAX_FILTER_BYTES
) -> DataFrame:
    """One row per row of ``docs``: its id, keep_id, group_size, kept, text_sha256."""
    digests = materialise(
        docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("sha"))
        .withColumn("h", F.xxhash64("sha"))
        .withColumn("rid", F.monotonically_increasing_id()),
        "digests",
    )
    rows = digests.count()
    bloom = repeated_filter(digests.select("h"), rows, max_filter_bytes)
    flagged = flag_repeated(digests, "h", bloom, "repeated")
    single = flagged.where(~F.col("repeated")).select(
        "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha"
    )
    candidates = flagged.where("repeated").select("id", "sha", "rid")
    hot, cold = _groups(candidates, "id", rows)
    near = candidates.join(F.broadcast(hot), "sha", "left")
    kept = F.col("rid") == F.col("keep_rid")
    columns = ["id", "keep_id", "group_size", kept.alias("kept"), "sha"]
    by_hot = near.where(F.col("group_size").isNotNull()).select(*columns)
    by_cold = near.where(F.col("group_size").isNull()).select("id", "sha", "rid").join(cold, "sha").select(*columns)
    return (
        single.unionByName(by_hot)
        .unionByName(by_cold)
        .select(
            F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256")
        )
    )


def drop_duplicates(
    docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", max_filter_bytes: int = MAX_FILTER_BYTES
) -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns.

    Rows that the filter clears are passed on from the scan; only the others are written, shuffled
    and joined with the winners.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    h, flag, sha, rid = (free_name(docs, x) for x in ("h", "repeated", "sha", "rid"))
    text = normalised(F.col(text_col))
    rows = docs.count()
    bloom = repeated_filter(docs.select(F.xxhash64(text).alias("h")), rows, max_filter_bytes)
    flagged = flag_repeated(docs.withColumn(h, F.xxhash64(text)), h, bloom, flag)
    candidates = materialise(
        flagged.where(F.col(flag))
        .drop(h, flag)
        .withColumn(sha, F.unhex(F.sha2(text, 256)))
        .withColumn(rid, F.monotonically_increasing_id()),
        "candidates",
    )
    winners = (
        candidates.select(F.col(id_col).alias("id"), F.col(sha).alias("sha"), F.col(rid).alias("rid"))
        .groupBy("sha")
        .agg(F.max(F.struct("id", "rid")).alias("best"))
        .select(F.col("best.rid").alias(rid))
    )
    stay = candidates.join(winners, rid, "left_semi").select(*columns)
    return flagged.where(~F.col(flag)).select(*columns).unionByName(stay)
