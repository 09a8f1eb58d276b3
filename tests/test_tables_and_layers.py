"""Keyed tables, layers, merges, threads and streams against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from docquarry.functions import ids, values
from docquarry.operators import entries, layers, setops, tables, threads
from docquarry.sources import entry_xml
from docquarry.streaming import ingest


@pytest.fixture
def suppliers(spark):
    rows = [(1, "Smith", "London", "a"), (2, "Jones", "Paris", None), (3, "Adams", "Vienna", "b"), (4, "Blake", "Rome", "c")]
    return tables.Table("suppliers", ("SNO",), spark.createDataFrame(rows, "SNO int, sname string, city string, misc string"))


def test_table_scenario(spark, suppliers):
    assert suppliers.rows.columns == ["sno", "sname", "city", "misc"]
    more = suppliers.insert(spark.createDataFrame([(5, "Clark"), (1, "Smythe")], "sno int, sname string"))
    assert {r.sno: r.sname for r in more.rows.collect()} == {1: "Smythe", 2: "Jones", 3: "Adams", 4: "Blake", 5: "Clark"}
    assert [r.sno for r in more.select(F.col("sname").startswith("B"), city="Rome").collect()] == [4]
    moved = more.update({"city": "Oslo"}, sname="Jones")
    assert moved.select(city="Oslo").count() == 1
    assert {r.sno for r in moved.delete_where(city="Oslo").rows.collect()} == {1, 3, 4, 5}
    assert moved.delete(spark.createDataFrame([(3,), (9,)], "sno int")).rows.count() == 4
    with pytest.raises(ValueError):
        more.update({"sno": 7}, sname="Jones")
    with pytest.raises(ValueError):
        tables.Table("x", ("absent",), suppliers.rows)


def test_three_tables_join_by_hand(spark, suppliers):
    sells = [(1, 1), (1, 2), (2, 1), (4, 3)]
    parts = {1: "Screw", 2: "Nut", 3: "Bolt"}
    s = spark.createDataFrame(sells, "s int, p int")
    p = spark.createDataFrame([*parts.items()], "pno int, pname string")
    found = s.join(suppliers.rows, s["s"] == F.col("sno")).join(p, s["p"] == p["pno"]).select("sname", "pname")
    names = {r.sno: r.sname for r in suppliers.rows.collect()}
    assert sorted(map(tuple, found.collect())) == sorted((names[a], parts[b]) for a, b in sells)


def test_merges_against_dictionaries(spark):
    rnd = random.Random(3)
    made = [{k: rnd.randrange(99) for k in rnd.sample(range(60), 30)} for _ in range(3)]
    frames = [spark.createDataFrame([*m.items()], "k int, v int") for m in made]
    wanted = made[2] | made[1] | made[0]
    assert {r.k: r.v for r in setops.merge(["k"], *frames).collect()} == wanted
    writes = [(rnd.randrange(20), i, rnd.randrange(99)) for i in range(200)]
    last = {}
    for k, _, v in writes:
        last[k] = v
    got = setops.last_writer(spark.createDataFrame(writes, "k int, at int, v int"), ["k"], "at")
    assert {r.k: r.v for r in got.collect()} == last
    a, b, c = (set(m) for m in made)
    keys = [f.select("k") for f in frames]
    as_set = lambda df: {r.k for r in df.collect()}
    assert as_set(setops.union(*keys)) == a | b | c
    assert as_set(setops.intersect(*keys)) == a & b & c
    assert as_set(setops.difference(*keys)) == a - b - c
    assert [r.k for r in setops.key_range(keys[0], "k", 10, 30).collect()] == sorted(k for k in a if 10 <= k <= 30)


def test_layers_against_a_dictionary(spark, tmp_path):
    rnd = random.Random(4)
    path, seen, own = str(tmp_path / "layers"), {}, {}
    for level in range(1, 5):
        visible = level != 3
        rows = [(k, rnd.randrange(1000), rnd.random() < 0.2, 0) for k in rnd.sample(range(200), 80)]
        layers.append(spark.createDataFrame(rows, "key int, value int, is_deleted boolean, ts int"), path, level, f"s{level}", visible)
        for target in [own] + [seen] * visible:
            for k, v, gone, _ in rows:
                target.pop(k, None) if gone else target.__setitem__(k, v)
    table = spark.read.parquet(path)
    as_dict = lambda df: {r.key: r.value for r in df.collect()}
    assert as_dict(layers.view(table)) == seen
    assert as_dict(layers.view(table, session="s3")) == own
    layers.compact(spark, path, str(tmp_path / "base"))
    base = spark.read.parquet(str(tmp_path / "base"))
    assert as_dict(layers.view(base)) == seen and base.count() == len(seen)


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.range(500).select((F.col("id") % 40).alias("key"), F.col("id").alias("value"), (F.col("id") % 13 == 0).alias("is_deleted"), F.col("id").alias("ts"))
    for part in range(3):
        rows.where(F.col("ts") % 3 == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    target = str(tmp_path / "layers")
    for _ in range(2):  # the second run finds nothing new
        stream = ingest.parquet_stream(spark, str(tmp_path / "in"), files_per_batch=10)
        ingest.ingest(stream, target, str(tmp_path / "checkpoint")).awaitTermination()
    last = {k: max(i for i in range(500) if i % 40 == k) for k in range(40)}
    assert {r.key: r.value for r in layers.view(spark.read.parquet(target)).collect()} == {k: v for k, v in last.items() if v % 13}


def test_threads(spark):
    all_ids = spark.createDataFrame([("r",), ("a\\r",), ("b\\a\\r",), ("c\\r",), ("z",)], "id string")
    one, two = all_ids.where("id = 'r'"), all_ids.where(F.col("id").isin("a\\r", "c\\r", "z"))
    as_set = lambda df: {r.id for r in df.collect()}
    assert as_set(threads.closure(all_ids, one)) == {"r", "a\\r", "b\\a\\r", "c\\r"}
    assert as_set(threads.matching(all_ids, one, two)) == {"a\\r", "c\\r"}
    assert as_set(threads.top_most(all_ids)) == {"r", "z"}
    row = spark.createDataFrame([("b\\a\\r",), ("r",)], "id string").coalesce(1).select(ids.ancestors(F.col("id")), ids.parent(F.col("id"))).collect()
    assert [tuple(r) for r in row] == [(["b\\a\\r", "a\\r", "r"], "a\\r"), (["r"], None)]


def test_rendered_keys_differ(spark):
    df = spark.createDataFrame([("1", "12"), ("11", "2"), ("1|:1", "2"), ("1", "1|:2")], "a string, b string")
    assert df.select(ids.rendered_key(F.col("a"), F.col("b"))).distinct().count() == 4


def test_entries_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("1", ["x", "y", "x"], 2.5, None), ("2", None, 3.0, 'q "<&>"')], "id string, many array<string>, n double, s string")
    long = entries.to_entries(df, "id")
    assert sorted((r.id, r.attr, r.ord, r.vtype, r.sval, r.nval) for r in long.collect() if r.attr != "n") == [("1", "many", 0, "string", "x", None), ("1", "many", 1, "string", "y", None), ("2", "s", 0, "string", 'q "<&>"', None)]
    described = {r.id: r.attrs for r in entries.describe(long).collect()}
    assert described == {"1": {"many": ["x", "y"], "n": ["2.5"]}, "2": {"n": ["3"], "s": ['q "<&>"']}}
    entry_xml.write(entries.describe(long), str(tmp_path / "xml"))
    back = {(r.id, r.attr, r.sval) for r in entry_xml.read(spark, str(tmp_path / "xml")).collect()}
    assert back == {("1", "many", "x"), ("1", "many", "y"), ("1", "n", "2.5"), ("2", "n", "3"), ("2", "s", 'q "<&>"')}
    twice = entries.upsert(long, long)
    assert twice.count() == long.count()
    assert entries.replace(long, long.where("attr = 'n'")).count() == 2
    assert entries.describe(long, spark.createDataFrame([("9",)], "id string")).count() == 0


def test_tagged_values(spark):
    df = spark.createDataFrame([("ExpandedURL", "u"), ("UnIndexedURL", "u"), ("ImageURL", "u"), ("", "plain <")], "f string, t string").coalesce(1)
    v = F.struct(F.col("f").alias("flag"), F.col("t").alias("text"))
    assert [r[0] for r in df.select(values.searchable(v, F.lit("body"))).collect()] == ["body", "", "", "plain <"]
    assert [r[0] for r in df.select(values.shown(v, F.lit("<body>"))).collect()] == ["&lt;body&gt;", '<a href="u">u</a>', '<img src="u">', "plain &lt;"]


def test_name_uuids(spark):
    import uuid

    names = ["", "python.org", "ä日", "x" * 300]
    df = spark.createDataFrame([(n,) for n in names], "n string").coalesce(1)
    for version, make in ((3, uuid.uuid3), (5, uuid.uuid5)):
        got = [r[0] for r in df.select(ids.name_uuid(str(uuid.NAMESPACE_DNS), F.col("n"), version)).collect()]
        assert got == [str(make(uuid.NAMESPACE_DNS, n)) for n in names]
    with pytest.raises(ValueError):
        ids.name_uuid(str(uuid.NAMESPACE_DNS), F.col("n"), 4)


def test_sql_functions(spark):
    from docquarry.functions import sql

    assert "has_word" in sql.register(spark)
    row = spark.sql(r"SELECT cue_time('01:02:03,004'), cue_text(3723004), cue_time('x'), thread_ancestors('b\\a\\r'), word_tokens('The End'), has_near('a the b end', 'the', 'end', 1), has_near('the b b end', 'the', 'end', 1), has_word(null, 'a')").first()
    assert tuple(row) == (3_723_004, "01:02:03,004", None, ["b\\a\\r", "a\\r", "r"], ["the", "end"], True, False, False)
