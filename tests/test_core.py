"""Archive engine: round trips, pruning, appends, damage, SQL, diff, contracts, detection, catalogue."""

import datetime as dt
import decimal
import json
import math
import warnings

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coldlake.functions import transforms as tr
from coldlake.operators import profile as prof
from coldlake.operators.catalog import Catalog
from coldlake.operators.contract import Contract, Field, SchemaError, evolve, schema_diff
from coldlake.operators.detect import DataKind, detect, detect_file, flatten
from coldlake.operators.diff import diff, diff_tables
from coldlake.operators.filters import apply_filter, may_match, normalise_columns
from coldlake.operators.recipes import RecipeError, RecipeWatcher, load_recipe, parse_recipe, run_recipe, validate_recipe
from coldlake.plans.sqlfront import SqlError, SqlFront, find_relations
from coldlake.session import ArchiveSession
from coldlake.sources import archive as ar
from coldlake.sources import codecs, readers
from coldlake.sources.export import export, write_file
from coldlake.sources.files import Files, hadoop_path, parse_uri
from coldlake.streaming.ingest import stream_to_archive

NAN, INF = float("nan"), float("inf")


def same(a, b):
    assert a.schema == b.schema or [f.dataType for f in a.schema] == [f.dataType for f in b.schema]
    assert a.columns == b.columns
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "archive")


@pytest.fixture(scope="module")
def all_types(spark):
    schema = (
        "i int, b bigint, d double, s string, t boolean, ts timestamp_ntz, m decimal(18,4), dt date, a array<int>, "
        "st struct<x:int,y:string>, mp map<string,int>, bin binary"
    )
    when = dt.datetime(1965, 1, 2, 3, 4, 5, 678901)
    rows = [
        (1, 2**62, 0.1 + 0.2, "nul\x00text", True, when, decimal.Decimal("1.2345"), dt.date(2020, 1, 1), [1, None], (1, "q"), {"k": 1}, bytearray(b"\x00\xff")),
        (-1, -(2**63), NAN, "", False, None, None, None, [], (None, None), {}, bytearray(b"")),
        (None, None, -INF, None, None, None, None, None, None, None, None, None),
        (2**31 - 1, 0, -0.0, "None", None, dt.datetime(9999, 1, 1), decimal.Decimal("-99999999999999.9999"), dt.date(1, 1, 1), None, None, None, None),
    ]
    return spark.createDataFrame(rows, schema)


def test_round_trip_of_all_types(spark, path, all_types):
    out = ar.write_archive(all_types, path, codec="lzma2", comment="c", measure_csv=True)
    same(ar.read_archive(spark, path, verify=True), all_types)
    assert out["rows"] == 4 and out["cols"] == 12 and out["codec"] == "lzma2"


@pytest.mark.parametrize("codec", ["none", "zstd", "snappy", "gzip", "lz4", "auto", "zpaq"])
def test_codecs(spark, path, codec):
    df = spark.range(1000).withColumn("x", F.col("id") % 7)
    ar.write_archive(df, path, codec=codec)
    same(ar.read_archive(spark, path), df)


def test_encryption(spark, path, all_types):
    key = b"k" * 32
    ar.write_archive(all_types, path, key=key)
    same(ar.read_archive(spark, path, key=key), all_types)
    with pytest.raises(PermissionError):
        ar.read_archive(spark, path)
    with pytest.raises(Exception):
        ar.read_archive(spark, path, key=b"x" * 32).collect()
    with pytest.raises(ValueError):
        ar.append_archive(all_types, path)
    with pytest.raises(ValueError):
        ar.write_archive(all_types, path, key=b"short")


def test_row_order_ranges_and_numbers(spark, path):
    df = spark.range(5000).select("id", (F.col("id") % 3).alias("k"))
    ar.write_archive(df, path, partition_by="id", chunk_rows=300)
    for low, high in ((0, 0), (10, 299), (299, 301), (4990, 9999), (700, 2500), (6000, 7000)):
        got = sorted(r["id"] for r in ar.read_archive(spark, path, row_range=(low, high)).collect())
        assert got == list(range(low, min(high, 4999) + 1))
    assert all(r["row_number"] == r["id"] for r in ar.row_numbers(spark, path).collect())
    m = ar.read_manifest(spark, path)
    assert [f.row_start for f in m.files] == sorted(f.row_start for f in m.files) and len(m.files) > 10


def test_pruning_is_typed(spark, path):
    rows = [(k, dt.date(2020, 1, 1) + dt.timedelta(days=k), f"a-{k}") for k in range(-20, 100)]
    df = spark.createDataFrame(rows, "k int, d date, s string")
    ar.write_archive(df, path, partition_by=["k"], primary_key=["d", "s"], chunk_rows=10)
    m = ar.read_manifest(spark, path)
    total = len(m.files)
    for spec in ({"k": 9}, {"k": (-5, -5)}, {"k": [9, 10]}, {"d": dt.date(2020, 2, 1)}, {"d": (dt.date(2020, 1, 5), dt.date(2020, 1, 6))}):
        assert 0 < len(ar.pruned_files(m, spec)) < total / 2
        same(ar.read_archive(spark, path, filter=spec), apply_filter(df, spec))
    assert ar.pruned_files(m, {"k": 1000}) == []
    assert ar.read_archive(spark, path, filter={"k": 1000}).columns == ["k", "d", "s"]
    plan = ar.read_archive(spark, path, filter={"k": 9})._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(k), EqualTo(k,9)]" in plan
    narrow = ar.read_archive(spark, path, columns=["s"])._jdf.queryExecution().toString()
    assert "ReadSchema: struct<s:string>" in narrow


def test_may_match():
    stats = {"a": [1, 5, 0], "n": [None, None, 3]}
    assert may_match(stats, {"a": 3}) and not may_match(stats, {"a": 6}) and not may_match(stats, {"a": None})
    assert may_match(stats, {"a": (5, None)}) and not may_match(stats, {"a": (None, 0)}) and may_match(stats, {"zz": 1})
    assert may_match(stats, {"n": None}) and not may_match(stats, {"n": 1}) and may_match(stats, {"n": [1, None]})
    assert may_match(stats, {"a": "text"}) and may_match({"t": ["2020-01-01", "2020-12-31", 0]}, {"t": dt.datetime(2020, 12, 31, 5)})


def test_filters(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (None, "b")], "x int, y string")
    count = lambda spec, **o: apply_filter(df, spec, **o).count()
    assert count({"x": 1}) == 1 and count({"x": [1, 2]}) == 2 and count({"x": (1, 2)}) == 2 and count({}) == 3
    assert count({"x": None}) == 1 and count({"x": [1, None]}) == 2 and count({"x": (None, 1)}) == 1 and count({"x": []}) == 0
    assert count({"zz": 1}) == 3
    with pytest.raises(KeyError):
        count({"zz": 1}, strict=True)
    assert normalise_columns("*", ["a", "b"]) == ["a", "b"] and normalise_columns(["b", "q", "b"], ["a", "b"]) == ["b"]


def test_append_is_atomic_and_checked(spark, path):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "id int, cat string")
    ar.write_archive(df, path)
    new = spark.createDataFrame([("unseen", 3)], "cat string, id int")
    got = ar.append_archive(new, path)
    assert got["total_rows"] == 3 and sorted(r["cat"] for r in ar.read_archive(spark, path).collect()) == ["unseen", "x", "y"]
    with pytest.raises(ValueError):
        ar.append_archive(spark.createDataFrame([(1,)], "id int"), path)
    Files(spark).create_new(f"{path}/.generation-3", "")
    with pytest.raises(ar.AppendConflict):
        ar.append_archive(new, path)
    assert ar.read_archive(spark, path).count() == 3
    assert len(ar.vacuum(spark, path)) == 1 and ar.append_archive(new, path, comment="noted")["total_rows"] == 4
    assert ar.audit(spark, path)["comment"] == "noted" and ar.read_archive(spark, path, verify=True).count() == 4


def test_damage_is_found(spark, path, tmp_path):
    ar.write_archive(spark.range(100), path, chunk_rows=30)
    m = ar.read_manifest(spark, path)
    victim = tmp_path / "archive" / m.files[0].name
    raw = bytearray(victim.read_bytes())
    raw[10] ^= 1
    victim.write_bytes(raw)
    (tmp_path / "archive" / m.files[0].name).parent.joinpath("." + victim.name + ".crc").unlink(missing_ok=True)
    with pytest.raises(ar.IntegrityError):
        ar.read_archive(spark, path, verify=True)
    with pytest.raises(ar.IntegrityError):
        ar.append_archive(spark.range(1), path)
    victim.unlink()
    assert {r["status"] for r in ar.verify_files(spark, path)} >= {"FILE_MISSING"}
    with pytest.raises(FileNotFoundError):
        ar.read_archive(spark, str(tmp_path / "none"))


def test_audit_peek_and_errors(spark, path):
    ar.write_archive(spark.range(95), path, partition_by="id", comment="kept", retention_days=30, primary_key="id")
    a = ar.audit(spark, path)
    assert a["orig_rows"] == 95 and a["comment"] == "kept" and a["retention_days"] == 30 and a["columns"] == ["id"]
    assert [len(b) for b in ar.peek(spark, path, batch_size=40)] == [40, 40, 15]
    for bad in ({"comment": "x" * 256}, {"codec": "nope"}, {"primary_key": "zz"}, {"chunk_rows": 0}, {"quant": 9}):
        with pytest.raises(ValueError):
            ar.write_archive(spark.range(1), path + "2", **bad)
    with pytest.raises(FileExistsError):
        ar.write_archive(spark.range(1), path, overwrite=False)
    before = ar.read_archive(spark, path).count()
    ar.compact(spark, path, 50)
    assert ar.read_archive(spark, path).count() == before


def test_empty_archive(spark, path):
    ar.write_archive(spark.createDataFrame([], "a int, b string"), path)
    got = ar.read_archive(spark, path)
    assert got.columns == ["a", "b"] and got.count() == 0
    assert ar.row_numbers(spark, path).count() == 0


def test_quantisation(spark):
    rows = [(1.23456789, 10.123456, 99.987, dt.datetime(2020, 1, 1, 2, 3, 45), None), (1e30, -3.5, 0.05, None, NAN)]
    df = spark.createDataFrame(rows, "price double, lat double, score double, ts timestamp_ntz, v double")
    high = codecs.quantise(df, 1)[0].collect()
    assert high[0]["price"] == pytest.approx(1.23456789, rel=1e-6) and high[0]["price"] != 1.23456789
    assert high[0]["lat"] == 10.123456 and high[0]["v"] is None and math.isnan(high[1]["v"])
    medium = codecs.quantise(df, 2)[0].collect()
    assert medium[0]["price"] == 1.0 and medium[0]["lat"] == 10.1235 and medium[0]["ts"] == dt.datetime(2020, 1, 1, 2, 3)
    low = codecs.quantise(df, 3)[0].collect()
    assert low[1]["price"] == INF and low[0]["v"] is None and low[0]["score"] == 99.987


# ---- SQL


def test_relations_are_found_by_position():
    sql = """WITH q AS (SELECT 'a/b.pf' AS s FROM 'x/one') -- FROM 'x/no'
    SELECT * FROM 'x/one' a, "y/two.pf" b JOIN (SELECT * FROM 'z/three') c ON a.k = 'v/w' WHERE s IN ('p/q', 'r/s') /* FROM 'n/o' */"""
    assert [p for _, _, p in find_relations(sql)] == ["x/one", "x/one", "y/two.pf", "z/three"]


def test_sql_front(spark, tmp_path):
    one, two = str(tmp_path / "one"), str(tmp_path / "two.pf")
    ar.write_archive(spark.createDataFrame([("01234", 1), ("x", 2)], "code string, k int"), one)
    ar.write_archive(spark.createDataFrame([(1, "q"), (3, "r")], "k int, v string"), two)
    front = SqlFront(spark)
    assert front.query(f"SELECT * FROM '{one}' WHERE code = '01234'").count() == 1
    assert front.query(f"SELECT one.code, b.v FROM '{one}' JOIN '{two}' AS b ON one.k = b.k").collect()[0]["v"] == "q"
    assert front.query(f"SELECT * FROM '{one}' a JOIN '{one}' b ON a.k < b.k").count() == 1
    assert front.query(f"SELECT k FROM '{one}' UNION ALL SELECT k FROM '{two}'").count() == 4
    assert front.query(f"SELECT '{one}' AS text FROM '{two}'").collect()[0]["text"] == one
    assert front.register("t1", one) == "t1" and front.register(two) == "two"
    assert front.query("SELECT * FROM t1 LEFT JOIN two USING (k)").count() == 2
    assert set(front.registered()) == {"t1", "two"} and front.unregister("two") and not front.unregister("two")
    with pytest.raises(SqlError):
        front.query(f"SELEC * FROM '{one}'")
    with pytest.raises(FileNotFoundError):
        front.register("zz", str(tmp_path / "zz"))
    plan = front.query(f"SELECT k FROM '{one}' WHERE k = 2")._jdf.queryExecution().toString()
    assert "EqualTo(k,2)" in plan and "ReadSchema: struct<k:int>" in plan


# ---- diff


def test_diff_of_odd_values(spark):
    v1 = spark.createDataFrame([(1, 0.0), (2, NAN), (3, None), (4, INF), (5, 1.0), (None, 7.0), (6, -0.0)], "id int, v double")
    v2 = spark.createDataFrame([(1, None), (2, NAN), (3, None), (4, -INF), (5, 1.0 + 1e-12), (None, 7.0), (8, 1.0)], "id int, v double")
    found = diff_tables(v1, v2, "id")
    kinds = {r["id"]: r["_diff"] for r in found.joined.select("id", "_diff").collect()}
    assert kinds == {1: "changed", 2: "unchanged", 3: "unchanged", 4: "changed", 5: "unchanged", None: "unchanged", 6: "deleted", 8: "inserted"}
    assert found.summary() == {"inserted": 1, "deleted": 1, "changed": 2, "unchanged": 4}
    assert diff(v1, v2, "id", output="summary") == found.summary()
    out = diff(v1, v2, "id", include=["changed"], changed_columns_only=True)
    assert out["inserted"] is None and out["changed"].columns == ["id", "v_v1", "v_v2"]
    assert diff(v1, v2, "id", output="dataframe").columns == ["_diff", "id", "v"]
    for bad in (lambda: diff(v1, v2, "id", output="x"), lambda: diff(v1, v2.drop("v"), "id")):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(KeyError):
        diff(v1, v2, "zz")


def test_diff_duplicate_keys_warn(spark):
    v1 = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        assert diff_tables(v1, v1, "k").summary()["unchanged"] == 2
    assert any("repeat" in str(w.message) for w in seen)


# ---- contracts and evolution


def test_contract(spark, tmp_path):
    df = spark.createDataFrame([("1", "True", 5, "x"), ("2", None, 6, "y")], "old string, ok string, extra int, s string")
    c = Contract({"new": Field("int64", required=True, renamed_from="old"), "ok": "bool", "gone": Field("float64", default=1.5), "none": "string"})
    got = c.apply(df)
    assert got.columns == ["new", "ok", "gone", "none"] and [f.dataType.simpleString() for f in got.schema] == ["bigint", "boolean", "double", "string"]
    assert [tuple(r) for r in got.collect()] == [(1, True, 1.5, None), (2, None, 1.5, None)]
    assert c.validate(df) == [] and Contract({"s": "int"}).validate(df)[0].startswith("column 's': 2 values")
    assert Contract({"zz": Field("int", required=True)}).validate(df) == ["required column 'zz' is missing"]
    with pytest.raises(SchemaError):
        Contract({"zz": Field("int", required=True)}).apply(df)
    with pytest.raises(Exception):
        Contract({"s": "int"}).apply(df).collect()
    for bad in (lambda: Field("int", default="x"), lambda: Field("int", default=True), lambda: Field("nonsense"), lambda: Contract({"a": Field("int", renamed_from="q"), "b": Field("int", renamed_from="q")})):
        with pytest.raises(SchemaError):
            bad()
    c.save(str(tmp_path / "c.json"))
    assert Contract.load(str(tmp_path / "c.json")) == c and Contract.infer(df).schema == df.schema


def test_evolution(spark):
    df = spark.createDataFrame([(1, 2.7)], "a int, b double")
    target = T.StructType().add("b", "string").add("c", "integer").add("d", "timestamp")
    assert tuple(evolve(df, target).first()) == ("2.7", None, None)
    assert evolve(df, target, int_fill_zero=True).first()["c"] == 0
    found = schema_diff(df.schema, T.StructType().add("a", "long").add("b", "string").add("z", "integer"))
    assert found == {"added": ["z"], "removed": [], "type_changed": {"b": ("double", "string")}, "unchanged": ["a"]}
    assert "a" in schema_diff(df.schema, T.StructType().add("a", "long"), strict=True)["type_changed"]


# ---- detection


def test_flatten(spark):
    docs = [{"id": k, "tags": ["a", "b"], "loc": {"x": 1}, "s": "id-1", "day": "2024-01-0%d" % (k % 9 + 1)} for k in range(10)]
    for k in range(5):
        docs[k]["rare"] = k
    for k in range(6):
        docs[k]["often"] = "yes"
    for k in range(10):
        docs[k]["mixed"] = k if k % 2 else "t"
    found = detect(spark, docs)
    assert found.kind is DataKind.SEMI_STRUCTURED
    assert set(found.df.columns) == {"id", "tags", "loc", "s", "day", "often", "mixed"}
    types = dict(found.df.dtypes)
    assert types["day"] == "timestamp_ntz" and types["s"] == "string" and types["mixed"] == "string" and types["tags"] == "string"
    row = found.df.where("id = 9").first()
    assert row["tags"] == '["a","b"]' and json.loads(row["loc"]) == {"x": 1} and row["often"] is None
    assert found.manifest["rare"]["strategy"] == "json_str_rare" and found.manifest["tags"]["strategy"] == "json_arr_dict"
    assert flatten(spark.createDataFrame([("{}",)], "value string")).df.columns == []


def test_detect_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,t\n1,"x, ""y"""\n2,\n')
    (tmp_path / "a.jsonl").write_text('{"a":1}\n\n{"a":2,"b":null}\n')
    (tmp_path / "a.json").write_text('[{"a":1},{"a":2}]')
    (tmp_path / "one.json").write_text('{"a": 7}')
    spark.range(3).write.parquet(str(tmp_path / "a.parquet"))
    assert detect_file(spark, str(tmp_path / "a.csv")).df.first()["t"] == 'x, "y"'
    assert sorted(r["a"] for r in detect_file(spark, str(tmp_path / "a.jsonl")).df.collect()) == [1, 2]
    assert detect_file(spark, str(tmp_path / "a.json")).df.count() == 2
    assert detect_file(spark, str(tmp_path / "one.json")).df.first()["a"] == 7
    assert detect_file(spark, str(tmp_path / "a.parquet")).kind is DataKind.TABULAR
    with pytest.raises(ValueError):
        detect_file(spark, "a.bin")
    nested = spark.createDataFrame([(1, [1, 2])], "id int, a array<int>")
    assert detect(spark, nested).df.first()["a"] == "[1,2]"


# ---- transforms and profiles


def test_transforms(spark):
    values = [0, 1, -1, 2**40, -(2**40), 2**62]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k long, v long")
    coded = df.where("v < 4000000000000000000").select("v", tr.unzigzag(tr.zigzag(F.col("v"))).alias("w"))
    assert all(r["v"] == r["w"] for r in coded.collect())
    d = df.select("k", "v", tr.lag_delta(F.col("v"), [F.col("k")]).alias("d"))
    assert all(r["v"] == r["w"] for r in d.select("v", tr.prefix_sum(F.col("d"), [F.col("k")]).alias("w")).collect())
    cats = tr.category_codes(spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "c string"), "c").collect()
    assert sorted((r["c"] or "", r["code"]) for r in cats if r["c"]) == [("a", 0), ("b", 1), ("b", 1)]
    js = spark.createDataFrame([('{"k":1,"z":"q"}',)], "j string")
    assert sorted(r["key"] for r in tr.json_keys(js, "j").collect()) == ["k", "z"]
    assert tr.compact_json(js, "j", ["k", "z"]).first()["compact"] == {0: "1", 1: "q"}
    assert tr.csv_bytes(spark.createDataFrame([(1, "ab"), (22, None)], "a int, b string")) == len("a,b\n1,ab\n22,\n")


def test_profile_and_rules(spark):
    df = spark.createDataFrame([(k, float(k % 5), "abc"[k % 3]) for k in range(300)], "i int, f double, s string")
    p = prof.profile_table(df, order_by=["i"])
    assert p.n_rows == 300 and p.str_cardinality_mean == pytest.approx(0.01) and p.int_col_ratio == pytest.approx(1 / 3)
    assert prof.choose_codec(p)["codec"] == "lzma2"
    wild = prof.Profile(10, 4, 0.75, 0, 0.25, 0, 2.5, 0.9, 1.0)
    assert prof.choose_codec(wild)["codec"] == "zstd" and prof.choose_codec(wild)["quant"] == 1
    assert prof.auto_select(spark.createDataFrame([], "a int"))["reasons"] == ["the table is empty"]


# ---- catalogue, session, sources, recipes, streams


def test_catalogue(spark, tmp_path):
    for k, name in enumerate(("sales_a", "sales_b", "other")):
        ar.write_archive(spark.range(10 * (k + 1)), str(tmp_path / "root" / name), partition_by="id", quant=0)
    (tmp_path / "root" / "broken").mkdir()
    (tmp_path / "root" / "broken" / "manifest.json").write_text("{}")
    c = Catalog(spark, str(tmp_path / "cat"))
    assert c.datasets.count() == 0
    found = c.register_dir(str(tmp_path / "root"))
    assert sum(v.startswith("error") for v in found.values()) == 1 and len(found) == 4
    assert c.register(str(tmp_path / "root" / "sales_a")) in found.values()
    assert c.search(name="sales").count() == 2 and c.search(min_rows=25).first()["name"] == "other"
    assert c.stats()["total_rows"] == 60 and c.search_chunks("other").count() >= 1
    assert c.read("other", filter={"id": (0, 4)}).count() == 5
    assert {r["status"] for r in c.integrity_check().collect()} == {"OK"} and c.datasets.where("verified_ok").count() == 3
    assert c.cost_report("s3_standard").first()["tier"] == "s3_standard" and c.versions("other").count() == 1
    assert c.sql("SELECT COUNT(*) AS n FROM datasets d JOIN chunks c ON c.dataset_id = d.id").first()["n"] >= 3
    assert c.unregister("other") == 1 and c.datasets.count() == 2
    with pytest.raises(KeyError):
        c.read("zz")
    with pytest.raises(ValueError):
        c.cost_report("zz")


def test_session(spark, tmp_path):
    s = ArchiveSession(spark, str(tmp_path))
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string")
    s.freeze(a, "v1", primary_key="id")
    s.wait(s.freeze_async(a.withColumn("v", F.upper("v")), "v2"))
    assert s.list() == ["v1", "v2"] and s.audit("v1")["rows"] == 2
    assert s.diff("v1", "v2", output="summary")["changed"] == 2
    s.append(a.where("id = 1").withColumn("id", F.lit(3)), "v1")
    assert s.unfreeze("v1").count() == 3 and s.catalog.search(name="v").count() == 2
    assert s.unfreeze("v1", "records", filter={"id": 3}) == [{"id": 3, "v": "x"}]
    s.register_alias("al", "v1")
    assert s.query("SELECT COUNT(*) AS n FROM al").first()["n"] == 3
    s.close()


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, v string")
    assert export(df, "records")[1] == {"id": 2, "v": None} and json.loads(export(df, "json"))[1] == {"id": 2, "v": None}
    assert export(df, "csv", sep=";").splitlines()[0] == "id;v" and export(df, "parquet")[:4] == b"PAR1"
    with pytest.raises(ValueError):
        export(df, "zz")
    for kind in ("csv", "parquet", "jsonl"):
        write_file(df, str(tmp_path / f"out.{kind}"))
        assert readers.read_source(spark, str(tmp_path / f"out.{kind}")).count() == 2
    with pytest.raises(ValueError):
        write_file(df, "x.bin")


def test_readers(spark, tmp_path):
    for name in ("a1", "a2"):
        ar.write_archive(spark.range(5), str(tmp_path / name))
    assert readers.read_archives(spark, f"{tmp_path}/a1, {tmp_path}/a2").count() == 10
    assert readers.read_archives(spark, f"{tmp_path}/a*").count() == 10
    import pandas as pd

    batches = (pd.DataFrame({"x": [k, k + 1]}) for k in range(0, 6, 2))
    seen = []
    assert readers.freeze_stream(spark, batches, str(tmp_path / "s"), progress=seen.append)["rows"] == 6 and seen == [2, 4, 6]
    (tmp_path / "in.csv").write_text("a,b\n1,x\n2,y\n")
    assert readers.freeze_file(spark, str(tmp_path / "in.csv"), str(tmp_path / "f"))["rows"] == 2
    spark.range(50).repartition(3).write.parquet(str(tmp_path / "r.parquet"))
    source = readers.RangeSource(spark, str(tmp_path / "r.parquet"))
    parts = [source.rows(k, k + 20).count() for k in (0, 20, 40)]
    assert parts == [20, 20, 10]
    assert parse_uri("s3://b/k/x").bucket == "b" and hadoop_path("s3://b/k") == "s3a://b/k" and parse_uri("/x").scheme == "local"
    with pytest.raises(ValueError):
        parse_uri("http://x")


def test_recipes(spark, tmp_path):
    spark.range(20).write.parquet(str(tmp_path / "in.parquet"))
    folder = tmp_path / "recipes"
    folder.mkdir()
    text = f"name: r\nsource: {tmp_path}/in.parquet\noutput: {tmp_path}/out\ncodec: zstd\npartition_by: id\n"
    (folder / "r.ice").write_text(text)
    assert run_recipe(spark, load_recipe(spark, str(folder / "r.ice")))["rows"] == 20
    assert len(validate_recipe({"codec": "zz", "quant": -1, "chunk_rows": 5, "priority": "x"})) == 7
    with pytest.raises(RecipeError):
        parse_recipe({"name": "x"})
    events = []
    w = RecipeWatcher(spark, str(folder), lambda p, r: events.append(r.name), lambda p: events.append("gone"))
    assert w.poll() == {} and events == ["r"]
    (folder / "bad.ice").write_text("name: x\n")
    assert len(w.poll()) == 1
    (folder / "r.ice").unlink()
    w.poll()
    assert events == ["r", "gone"]
    assert run_recipe(spark, parse_recipe({"name": "x", "source": "s", "output": "o", "codec": "zstd", "enabled": False})) == {"skipped": True}


def test_stream_into_archive(spark, tmp_path):
    source = tmp_path / "source"
    spark.range(10).write.parquet(str(source))
    for expected in (10, 25):
        stream = spark.readStream.schema("id long").parquet(str(source))
        q = stream_to_archive(stream, str(tmp_path / "arc"), str(tmp_path / "ck"))
        q.awaitTermination(60)
        assert q.exception() is None and ar.read_archive(spark, str(tmp_path / "arc")).count() == expected
        spark.range(15).write.mode("append").parquet(str(source))


def test_format(spark, tmp_path):
    from coldlake.sources.datasource import register_format

    path = str(tmp_path / "arc")
    df = spark.createDataFrame([(k, f"s{k}", k / 3) for k in range(100)], "a int, s string, x double")
    ar.write_archive(df, path, partition_by="a", chunk_rows=10)
    register_format(spark)
    got = spark.read.format("coldlake").load(path)
    same(got, df)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        assert [r["s"] for r in spark.read.format("coldlake").option("pruning", "true").load(path).where("a = 42").collect()] == ["s42"]
        assert spark.read.format("coldlake").option("pruning", "true").load(path).where("a >= 90 AND a <= 95").count() == 6
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_command_line(spark, tmp_path, capsys):
    from coldlake.cli import main, parse_filters

    assert parse_filters(["a=1", "b=1..5", "c=x,y", "d=..3"]) == {"a": 1, "b": (1, 5), "c": ["x", "y"], "d": (None, 3)}
    spark.range(30).write.parquet(str(tmp_path / "in.parquet"))
    arc = str(tmp_path / "arc")
    assert main(["freeze", str(tmp_path / "in.parquet"), arc, "--partition-by", "id"]) == 0
    assert main(["unfreeze", arc, str(tmp_path / "out.parquet"), "--filter", "id=3..7", "--rows", "0..20"]) == 0
    assert spark.read.parquet(str(tmp_path / "out.parquet")).count() == 5
    assert main(["audit", arc]) == 0 and main(["verify", arc]) == 0
    assert main(["query", f"SELECT COUNT(*) AS n FROM '{arc}'"]) == 0
    assert main(["catalog", str(tmp_path / "cat"), "register", arc]) == 0
    assert main(["catalog", str(tmp_path / "cat"), "search"]) == 0 and main(["catalog", str(tmp_path / "cat"), "verify"]) == 0
    assert "arc" in capsys.readouterr().out


def test_functions_over_the_active_session(spark, tmp_path):
    import pandas as pd

    import coldlake

    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    key = coldlake.FileKey.create(str(tmp_path / "key"))
    coldlake.freeze(pd.DataFrame({"id": [1, 2], "v": ["x", "y"]}), a, primary_key="id", column_encodings={"v": "bloom", "zz": "plain"})
    coldlake.freeze(coldlake.unfreeze(a), b, primary_key="id", codec=coldlake.CODEC_LZMA2)
    assert coldlake.append(b, pd.DataFrame({"id": [3], "v": ["z"]}))["total_rows"] == 3
    assert coldlake.diff(a, b, output="summary")["inserted"] == 1
    assert len(coldlake.unfreeze(b, engine="pandas", filter={"id": (2, 3)})) == 2
    assert coldlake.register("tab", a) == "tab" and "tab" in coldlake.registered()
    assert coldlake.query(f"SELECT COUNT(*) AS n FROM tab JOIN '{b}' b USING (id)").first()["n"] == 2
    coldlake.set_path_resolver(lambda p: p.replace("nowhere", str(tmp_path)))
    assert coldlake.query("SELECT * FROM 'nowhere/a'").count() == 2
    coldlake.set_path_resolver(None)
    assert coldlake.unregister("tab")
    coldlake.copy_archive(a, str(tmp_path / "c"))
    assert coldlake.unfreeze(str(tmp_path / "c"), verify=True).count() == 2 and coldlake.audit(a)["rows"] == 2
    sealed = str(tmp_path / "sealed")
    coldlake.freeze(coldlake.unfreeze(a), sealed, key=key)
    assert coldlake.unfreeze(sealed, key=key).count() == 2
    with pytest.raises(ValueError):
        coldlake.freeze(coldlake.unfreeze(a), sealed, column_encodings={"v": "zz"})
    with pytest.raises(AttributeError):
        coldlake.no_such_name


def test_pruning_by_value_keeps_nan_and_decimals():
    from decimal import Decimal

    from coldlake.operators.filters import may_match

    nan = float("nan")
    holds_nan, only_nan, old = {"x": [1.0, 2.0, 0, 3]}, {"x": [None, None, 0, 3]}, {"x": [1.0, nan, 0]}
    for stats in (holds_nan, old):
        assert may_match(stats, {"x": (1.5, None)}) and may_match(stats, {"x": 2.0}) and may_match(stats, {"x": nan})
        assert not may_match(stats, {"x": (None, 0.5)})
    assert may_match(only_nan, {"x": (5.0, None)}) and not may_match(only_nan, {"x": (None, 5.0)})
    assert not may_match({"x": [1.0, 2.0, 0]}, {"x": nan}) and not may_match({"x": [1.0, 2.0, 0]}, {"x": (3.0, None)})
    decimals = {"x": ["1.00", "10.00", 0]}
    for wanted in (Decimal("9.50"), 9.5, 9, "9.50", [Decimal("9.5")], (Decimal("9.5"), None), (None, "2")):
        assert may_match(decimals, {"x": wanted}, {"x"})
    assert not may_match(decimals, {"x": Decimal("10.01")}, {"x"}) and not may_match(decimals, {"x": (20, 30)}, {"x"})


def test_keys_stay_out_of_plans_and_compact_keeps_order_and_metadata(spark, tmp_path):
    key = b"0123456789abcdef"
    rows = spark.range(1100).selectExpr("id", "id / 3 AS v").coalesce(1)
    ar.write_archive(rows, str(tmp_path / "sealed"), key=key)
    sealed = ar.read_archive(spark, str(tmp_path / "sealed"), key=key)
    plan = sealed._jdf.queryExecution().toString()
    assert key.hex().upper() not in plan.upper() and "0123456789abcdef" not in plan
    path = str(tmp_path / "plain")
    ar.write_archive(rows, path, chunk_rows=1, quant=2, comment="kept", sha256=False)
    before = [r["id"] for batch in ar.peek(spark, path, filter={"id": (0, 40)}) for r in batch]
    ar.compact(spark, path, 300)
    after = ar.audit(spark, path)
    assert before == list(range(41)) and after["quant"] == 2 and after["comment"] == "kept" and after["n_chunks"] == 4
    assert [r["id"] for r in ar.read_archive(spark, path, row_range=(598, 602)).collect()] == list(range(598, 603))
