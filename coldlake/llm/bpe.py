"""Byte-level BPE over a global shuffle of distinct words.

Encoding has three steps.

1. Each task cuts its documents into pre-tokens and gathers them in blocks of bounded size. A block
   holds its distinct words once and, for every document, the word numbers in order of position, so
   the exploded pre-tokens with positions never travel as rows. Blocks go to a table in the shared
   folder that is bucketed by block.
2. The blocks' distinct words are dealt by word hash, packed by block and hash slice. A word meets
   all its occurrences in one slice, where its merges are done once; the ids go back packed alike.
   Slices hold even shares of the vocabulary, however often a word occurs.
3. Ids and blocks meet by block number (the bucketed side is not shuffled) and every document is put
   together by position.

Decoding joins every id with the token-byte table. The table has the fixed size of the vocabulary, so
it is broadcast, and the join is done batch by batch as one gather: as rows, a gigabyte of text would
be 250 million ids that a shuffle would have to bring back into their order.

Null and empty texts give no ids, an empty table gives an empty result, and texts are read whole: a
document longer than a block is a block of its own. Every other column of the input passes through;
result columns replace columns of their name. Document order is not defined; repeated rows stay
repeated.
"""

from __future__ import annotations

import base64
import io
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coldlake.llm.common import bound_batches, release_memory, scratch_path

#: Characters of text in a block, unless one document is longer.
BLOCK_CHARS = 6 << 20
#: Most token ids in an output batch of a block's documents, unless one document has more.
OUT_IDS = 1 << 20


def read_ranks(path: str) -> bytes:
    """The rank file's bytes; its size is that of a vocabulary, so it travels as a broadcast."""
    with open(path, "rb") as file:
        return file.read()


@lru_cache(maxsize=4)
def _parsed(ranks: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}


@lru_cache(maxsize=4)
def _merger(ranks: bytes, pattern: str):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=_parsed(ranks), special_tokens={})


def _pack(data: bytes) -> bytes:
    """Length and zstd frame, for shuffles that would compress less well."""
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _unpack(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def _planes(values: np.ndarray) -> bytes:
    """Packed int32 values by byte plane, which compresses better."""
    planes = np.ascontiguousarray(values.astype("<i4", copy=False).view(np.uint8).reshape(-1, 4).T)
    return _pack(planes.tobytes())


def _unplanes(data: bytes) -> np.ndarray:
    planes = np.frombuffer(_unpack(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<i4").reshape(-1)


def ragged(starts: np.ndarray, counts: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """Concatenation of flat[s : s + n] over the pairs of starts and counts."""
    ends = np.cumsum(counts, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    index = np.repeat(starts - (ends - counts), counts)
    index += np.arange(total)
    return flat[index]


class _Codebook(dict):
    def __missing__(self, word: str) -> int:
        self[word] = code = len(self)
        return code


_BLOCK_FIELDS = "block long, slice int, rows binary, lengths binary, codes binary, words binary"


def _make_blocks(text_name: str, pattern: str, slices: int, block_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(pattern).findall
        part, number = TaskContext.get().partitionId(), 0
        book, rows, lengths, codes, chars = _Codebook(), [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal book, rows, lengths, codes, chars, number
            if not lengths:
                return
            block = (part << 32) | number
            sink = io.BytesIO()
            kept = pa.Table.from_batches(rows).combine_chunks()
            with pa.ipc.new_stream(sink, kept.schema) as writer:
                writer.write_table(kept)
            all_codes = np.concatenate(codes) if codes else np.empty(0, np.int32)
            packed = [[] for _ in range(slices)]
            for word, code in book.items():
                raw = word.encode("utf-8", "surrogatepass")
                packed[zlib.crc32(raw) % slices].append((code, raw))
            out = [(block, -1, sink.getvalue(), _planes(np.array(lengths, np.int32)), _planes(all_codes), None)]
            for k, entries in enumerate(packed):
                if entries:
                    numbers = np.array([c for c, _ in entries], np.int32)
                    sizes = np.array([len(w) for _, w in entries], np.int32)
                    steps = np.diff(numbers, prepend=np.int32(0))  # numbers rise, so their steps are small
                    words = _pack(b"".join(w for _, w in entries))
                    out.append((block, k, None, _planes(sizes), _planes(steps), words))
            names = ["block", "slice", "rows", "lengths", "codes", "words"]
            types = [pa.int64(), pa.int32(), *[pa.binary()] * 4]
            for begin in range(0, len(out), 64):
                columns = list(zip(*out[begin : begin + 64]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)
            number += 1
            book, rows, lengths, codes, chars = _Codebook(), [], [], [], 0

        for batch in batches:
            place = batch.schema.get_field_index(text_name)
            kept, texts = batch.drop_columns([text_name]), batch.column(place)
            begin = 0
            for k in range(len(batch)):
                text = texts[k].as_py()
                words = find(text) if text else ()
                codes.append(np.fromiter(map(book.__getitem__, words), np.int32, len(words)))
                lengths.append(len(words))
                chars += len(text) if text else 0
                if chars >= block_chars:
                    rows.append(kept.slice(begin, k + 1 - begin))
                    begin = k + 1
                    yield from flush()
            if begin < len(batch):
                rows.append(kept.slice(begin))
        yield from flush()
        release_memory()

    return run


def _merge_words(ranks, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _merger(ranks.value, pattern)._core_bpe.encode_single_piece
        current, known = None, {}
        for batch in batches:
            out = []
            for block, k, sizes, words in zip(*(batch.column(c) for c in ("block", "slice", "lengths", "words"))):
                if (k := k.as_py()) != current:
                    current, known = k, {}
                ends = np.cumsum(_unplanes(sizes.as_py())).tolist()
                raw, begin, ids, counts = _unpack(words.as_py()), 0, [], []
                for end in ends:
                    word = raw[begin:end]
                    begin = end
                    found = known.get(word)
                    if found is None:
                        found = known[word] = encode(word)
                    ids += found
                    counts.append(len(found))
                out.append((block.as_py(), _planes(np.array(counts, np.int32)), _planes(np.array(ids, np.int32))))
            columns = list(zip(*out)) or [(), (), ()]
            numbers = batch.column("codes")
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), numbers, pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.binary())],
                ["block", "numbers", "counts", "ids"],
            )
        current, known = None, {}
        release_memory()

    return run


def _assemble(ids_name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in range(len(batch)):
                rows, lengths, codes, parts = (batch.column(c)[b] for c in ("rows", "lengths", "codes", "parts"))
                lengths, codes, parts = _unplanes(lengths.as_py()), _unplanes(codes.as_py()), parts.as_py() or []
                numbers = [np.cumsum(_unplanes(p["numbers"])) for p in parts]
                flat = [_unplanes(p["ids"]) for p in parts]
                size = [_unplanes(p["counts"]) for p in parts]
                n = sum(map(len, numbers))
                starts, counts, offset = np.zeros(n, np.int64), np.zeros(n, np.int64), 0
                for number, count, ids in zip(numbers, size, flat):
                    counts[number] = count
                    starts[number] = offset + np.cumsum(count) - count
                    offset += len(ids)
                flat = np.concatenate(flat) if flat else np.empty(0, np.int32)
                table = pa.ipc.open_stream(rows.as_py()).read_all()
                ends = np.cumsum(lengths, dtype=np.int64)
                tokens = np.concatenate([[0], np.cumsum(counts[codes])])
                begin, n_docs = 0, len(lengths)
                while begin < n_docs:  # documents in batches of bounded size
                    first = ends[begin] - lengths[begin]
                    end = int(np.searchsorted(tokens[ends], tokens[first] + OUT_IDS, "right"))
                    end = min(n_docs, max(end, begin + 1))
                    own = codes[first : ends[end - 1]]
                    values = ragged(starts[own], counts[own], flat)
                    offsets = np.concatenate([[first], ends[begin:end]])
                    offsets = (tokens[offsets] - tokens[first]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32, copy=False)))
                    part = table.slice(begin, end - begin).combine_chunks()
                    arrays = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in part.columns]
                    yield pa.RecordBatch.from_arrays([*arrays, lists], [*part.column_names, ids_name])
                    begin = end

    return run


def encode(
    docs: DataFrame,
    rank_file: str,
    pattern: str,
    text_col: str = "text",
    ids_col: str = "ids",
    block_chars: int = BLOCK_CHARS,
    slices: int | None = None,
) -> DataFrame:
    """The columns of ``docs`` other than the text, and the token ids as array<int>.

    ``slices``: into how many parts the distinct words are dealt; by default as many as shuffle
    partitions, which follow the input's size.
    """
    spark = docs.sparkSession
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != ids_col.lower() or c == text_col])
    bound_batches(spark)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slices = slices or buckets
    ranks = spark.sparkContext.broadcast(read_ranks(rank_file))
    blocks = docs.mapInArrow(_make_blocks(text_col, pattern, slices, block_chars), _BLOCK_FIELDS)
    name, path = f"coldlake_blocks_{uuid.uuid4().hex}", scratch_path(spark, "blocks")
    writer = blocks.write.option("compression", "zstd").option("path", path).bucketBy(buckets, "block")
    writer.format("parquet").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay, and ``table`` knows them and their buckets

    words = table.where("slice >= 0").select("block", "slice", "lengths", "codes", "words")
    merged = (
        words.repartitionById(slices, F.col("slice"))
        .sortWithinPartitions("slice")
        .mapInArrow(_merge_words(ranks, pattern), "block long, numbers binary, counts binary, ids binary")
        .groupBy("block")
        .agg(F.collect_list(F.struct("numbers", "counts", "ids")).alias("parts"))
    )
    whole = table.where("slice = -1").select("block", "rows", "lengths", "codes")
    joined = whole.join(merged, "block", "left").select("rows", "lengths", "codes", "parts")
    fields = [T.StructField(f.name, f.dataType) for f in docs.schema.fields if f.name != text_col]
    schema = T.StructType([*fields, T.StructField(ids_col, T.ArrayType(T.IntegerType()))])
    return joined.mapInArrow(_assemble(ids_col), schema)


def decode(tokens: DataFrame, rank_file: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """``tokens`` with the decoded bytes as binary column ``bytes_col``; null ids count as none."""
    spark = tokens.sparkSession
    bound_batches(spark)
    tokens = tokens.select(*[F.col(f"`{c}`") for c in tokens.columns if c.lower() != bytes_col.lower()])
    ranks = spark.sparkContext.broadcast(read_ranks(rank_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parsed = _parsed(ranks.value)
        sizes, first = np.zeros(max(parsed.values()) + 1, np.int64), {}
        for token, k in parsed.items():
            sizes[k], first[k] = len(token), token
        flat = np.frombuffer(b"".join(first[k] for k in sorted(first)), np.uint8)
        starts = np.cumsum(sizes) - sizes
        for batch in batches:
            lists = batch.column(ids_col)
            out = []
            for k in range(len(batch)):
                ids = lists[k].values
                ids = np.empty(0, np.int32) if ids is None else ids.to_numpy(zero_copy_only=False)
                out.append(ragged(starts[ids], sizes[ids], flat).tobytes())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, bytes_col]
            )
        release_memory()

    schema = T.StructType([*tokens.schema.fields, T.StructField(bytes_col, T.BinaryType())])
    return tokens.mapInArrow(run, schema)


def token_digests(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """Id, n_tokens, ids_sha256 and decoded_sha256 of every document, by encoding and decoding it."""
    tokens = encode(docs.select(id_col, "text"), rank_file, pattern)
    decoded = decode(tokens, rank_file)
    return decoded.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
