"""Byte-level BPE against the tiktoken library on whole texts."""

import base64
import hashlib

import public_tokenizers as P
import pytest
import tiktoken

from coldlake.llm import bpe

RANKS = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = [
    None, "", " ", "\n\n\t x", "don't they'll  we've 123 ABC", "é ü ß 漢字 🙂🙂 ‍", "a" * 5000, "<|endoftext|>",
    "x    y\x1c\x85z", "the the the", "the the the", "word " * 3000, "\x00 nul", "١٢٣ ½ Ⅷ",
]


@pytest.mark.parametrize("block_chars, slices", [(10, 3), (1 << 20, 1)])
def test_matches_library_and_round_trips(spark, library, block_chars, slices):
    rows = [(k, t, {"a": [k]}) for k, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "block long, text string, slice map<string,array<int>>").repartition(3)
    tokens = bpe.encode(docs, RANKS, P.PATTERN, block_chars=block_chars, slices=slices)
    assert tokens.columns == ["block", "slice", "ids"]
    got = {r["block"]: r for r in bpe.decode(tokens, RANKS).collect()}
    assert len(got) == len(TEXTS)
    for k, text in enumerate(TEXTS):
        assert got[k]["ids"] == library.encode_ordinary(text or ""), text
        assert bytes(got[k]["decoded"]) == (text or "").encode()
        assert got[k]["slice"] == {"a": [k]}


def test_empty_table_and_clash(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, ids int")
    assert bpe.encode(docs, RANKS, P.PATTERN).collect() == []
    row = spark.createDataFrame([(1, "two words", 7, 8)], "doc_id long, text string, IDS int, decoded int")
    tables = spark.catalog.listTables()
    done = bpe.decode(bpe.encode(row, RANKS, P.PATTERN), RANKS)
    assert done.columns == ["doc_id", "ids", "decoded"]
    assert bytes(done.first()["decoded"]) == b"two words"
    assert spark.catalog.listTables() == tables  # nothing is left in the catalogue
    assert bpe.token_digests(docs.drop("ids"), RANKS, P.PATTERN).collect() == []


def test_query_on_small_table(spark, library):
    from coldlake.llm.queries import QUERIES

    texts = dict(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect())
    rows = QUERIES["op2_byte_bpe"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r["doc_id"]] or "")
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()
