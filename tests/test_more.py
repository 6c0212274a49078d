"""Range joins, jobs, caches, wrapped keys, interrupted copies, and key numbering."""

import random
import time

import pytest
from pyspark.sql import functions as F

from coldlake.functions import transforms as tr
from coldlake.operators.jobs import JobRunner
from coldlake.operators.rangejoin import interval_join
from coldlake.sources.archive import append_archive, manifest_path, read_archive, read_manifest, transfer, write_archive
from coldlake.sources.cache import ArchiveCache
from coldlake.sources.files import Files
from coldlake.sources.keys import EnvelopeKey, SparkKeyService, generate_key


def test_interval_join_equals_brute_force(spark):
    draw = random.Random(3)
    points = [(k, draw.choice([None, float("nan"), draw.uniform(-50, 50), float(draw.randint(-50, 50))])) for k in range(300)]
    spans = [(k, a, a + draw.choice([-1.0, 0.0, 0.25, 1.0, 7.5, 60.0])) for k in range(80) for a in [draw.uniform(-60, 60)]]
    spans += [(90, None, 3.0), (91, 1.0, None)]
    got = interval_join(
        spark.createDataFrame(points, "id long, x double"), spark.createDataFrame(spans, "span long, a double, b double"), "x", "a", "b"
    )
    want = sorted((i, s) for i, x in points for s, a, b in spans if None not in (x, a, b) and a <= x < b)
    assert sorted((r["id"], r["span"]) for r in got.collect()) == want
    assert "CartesianProduct" not in got._jdf.queryExecution().toString()


def test_interval_join_without_intervals(spark):
    none = spark.createDataFrame([], "a long, b long")
    assert interval_join(spark.range(5), none, "id", "a", "b").count() == 0


def test_jobs_wait_retry_and_cancel(spark):
    runner, calls = JobRunner(spark, slots=1, attempts=3), []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise ValueError("again")
        return spark.range(10).count()

    slow = F.udf(lambda x: time.sleep(30) or x, "long")
    one = runner.submit(flaky, "flaky")
    assert runner.wait(one, 60) == 10
    assert runner.status(one)["attempts"] == 3 and runner.status(one)["progress"] == 1.0
    bad = runner.submit(lambda: 1 / 0)
    with pytest.raises(RuntimeError, match="division"):
        runner.wait(bad, 60)
    running = runner.submit(lambda: spark.range(4).select(slow("id")).collect())
    waiting = runner.submit(lambda: 1)
    assert runner.cancel(waiting) and runner.cancel(running) and not runner.cancel(one)
    assert [j["state"] for j in runner.list()] == ["done", "failed", "cancelled", "cancelled"]
    assert runner.wait(runner.submit(lambda: 7), 60) == 7


def test_cache_follows_the_source_and_stays_within_its_size(spark, tmp_path):
    now = [0.0]
    paths = [f"{tmp_path}/a{k}" for k in range(3)]
    for path in paths:
        write_archive(spark.range(1000), path)
    size = read_manifest(spark, paths[0]).stored_bytes
    cache = ArchiveCache(spark, f"{tmp_path}/cache", ttl=10, max_bytes=int(size * 2.5), clock=lambda: now[0])
    first = cache.fetch(paths[0])
    append_archive(spark.range(5), paths[0])
    assert cache.fetch(paths[0]) == first  # not looked at again yet
    now[0] = 11
    second = cache.fetch(paths[0])
    assert second != first and read_archive(spark, second).count() == 1005 and not Files(spark).exists(first)
    now[0] = 12
    cache.fetch(paths[1])
    now[0] = 13
    cache.fetch(paths[2])
    assert set(cache._notes()) < set(paths) and paths[2] in cache._notes()
    assert not Files(spark).exists(second)
    assert cache.resolve(paths[0]) == paths[0]  # local paths stay
    assert ArchiveCache(spark, f"{tmp_path}/tiny", max_bytes=1).fetch(paths[1]) == paths[1]


def test_interrupted_copy_goes_on(spark, tmp_path):
    source, target = f"{tmp_path}/from", f"{tmp_path}/to"
    write_archive(spark.range(100), source, chunk_rows=10)
    transfer(spark, source, target)
    files, names = Files(spark), [f.name for f in read_manifest(spark, source).files]
    files.delete(f"{target}/{names[0]}")
    files.delete(manifest_path(target))
    damaged = tmp_path / "to" / names[1]
    data = bytearray(damaged.read_bytes())
    data[len(data) // 2] ^= 255
    damaged.write_bytes(bytes(data))
    crc = damaged.parent / f".{damaged.name}.crc"
    crc.unlink(missing_ok=True)
    whole = (tmp_path / "to" / names[2]).stat().st_mtime_ns
    transfer(spark, source, target)
    assert (tmp_path / "to" / names[2]).stat().st_mtime_ns == whole
    assert read_archive(spark, target, verify=True).count() == 100


def test_wrapped_key_is_not_the_key_and_cannot_be_changed(spark):
    service = SparkKeyService(spark, generate_key())
    made = EnvelopeKey.create(service, 16)
    key = made.key()
    assert len(key) == 16 and key not in made.wrapped
    assert EnvelopeKey(service, made.wrapped).key() == key
    with pytest.raises(Exception):
        EnvelopeKey(service, made.wrapped[:-1] + bytes([made.wrapped[-1] ^ 1])).key()
    with pytest.raises(Exception):
        EnvelopeKey(SparkKeyService(spark, generate_key()), made.wrapped).key()


def test_numbered_keys_come_back_with_their_types(spark):
    import json

    texts = ['{"b":1,"a":"1"}', '{"c":{"x":[1,null]},"a":null}', "{}", None]
    df = spark.createDataFrame([(t,) for t in texts], "doc string")
    keys = tr.key_list(df, "doc")
    assert keys == ["a", "b", "c"]
    back = tr.expand_json(tr.compact_json(df, "doc", keys, typed=True), "compact", keys)
    got = [r["json"] and json.loads(r["json"]) for r in back.collect()]
    assert got == [t and json.loads(t) for t in texts]


def test_flatten_counts_all_documents(spark):
    import json

    from coldlake.operators.detect import flatten

    docs = [{"n": 1, "day": "2024-01-01", "tags": ["a", "b"], "o": {"x": 1}} for _ in range(20)]
    docs += [{"n": 2.5, "day": "soon", "tags": ["c"] * 9, "o": {"y": [None]}}, {"n": "many"}, {"n": None, "tags": "loose"}]
    df = spark.createDataFrame([(json.dumps(d),) for d in docs], "value string").coalesce(1)
    found = flatten(df, sample_docs=10)
    kinds = {f.name: (f.strategy, f.tokens) for f in found.fields}
    assert kinds["day"] == ("native", []) and kinds["o"] == ("json_str", [])
    assert kinds["tags"][0] == "json_str"  # not a list everywhere
    rows = found.df.collect()
    assert [rows[k]["n"] for k in (0, 20, 21, 22)] == ["1", "2.5", "many", None]
    assert rows[20]["day"] == "soon" and json.loads(rows[20]["o"]) == {"y": [None]} and rows[22]["tags"] == "loose"
    lists = flatten(df.limit(21), sample_docs=10)
    assert {f.name: f.tokens for f in lists.fields}["tags"] == ["a", "b", "c"]
    assert lists.df.schema["n"].dataType.simpleString() == "double" and lists.df.collect()[20]["n"] == 2.5
