"""Sessions over layers, and named tables."""

import pytest
from pyspark.sql import functions as F

from docquarry.functions import cues as times
from docquarry.functions import text as words
from docquarry.functions import values
from docquarry.operators import filters, layers, sessions, setops, tables
from docquarry.sources import folders, subtitles

ROWS = "key int, value string, is_deleted boolean, ts int"


def as_dict(df):
    return {r.key: r.value for r in df.collect()}


def test_sessions(spark, tmp_path):
    archive = sessions.Archive(spark, str(tmp_path / "a"))
    put = lambda name, rows, level: archive.write(spark.createDataFrame(rows, ROWS), archive.begin(name), level)
    put("007", [(1, "a", False, 1), (2, "b", False, 1)], 1)
    archive.publish("007")
    put("two", [(1, None, True, 2), (3, "c", False, 2)], 2)
    assert as_dict(archive.view()) == {1: "a", 2: "b"} and as_dict(archive.view("two")) == {2: "b", 3: "c"}
    put("three", [(2, "x", False, 3)], 3)
    archive.discard("three")
    for closed in ("007", "three"):
        with pytest.raises(ValueError):
            archive.begin(closed)
        with pytest.raises(ValueError):
            archive.publish(closed)
    with pytest.raises(ValueError):
        archive.write(spark.createDataFrame([], ROWS), "never begun")
    base = archive.compact()  # leaves the waiting session alone
    assert as_dict(archive.view()) == {1: "a", 2: "b"} and as_dict(archive.view("two")) == {2: "b", 3: "c"}
    assert archive.vacuum() == ["007", "three"] and archive.vacuum() == []
    again = sessions.Archive(spark, archive.path)
    again.write(spark.createDataFrame([(4, "d", False, 2)], ROWS), again.resume("two"), 2)
    again.publish("two")
    assert as_dict(archive.view()) == {2: "b", 3: "c", 4: "d"}
    states = {r.session: r.state for r in archive.states().collect()}
    assert states == {"007": "retired", "two": "active", "three": "discarded", base: "active"}


def test_compaction_can_keep_what_waits(spark, tmp_path):
    path = str(tmp_path / "layers")
    layers.append(spark.createDataFrame([(1, "a", False, 1)], ROWS), path, 1, "s1")
    layers.append(spark.createDataFrame([(1, "b", False, 1)], ROWS), path, 2, "s2", visible=False)
    layers.compact(spark, path, str(tmp_path / "base"), keep_unseen=True)
    base = spark.read.parquet(str(tmp_path / "base"))
    assert as_dict(layers.view(base)) == {1: "a"} and as_dict(layers.view(base, "s2")) == {1: "b"}


def test_spaces(spark, tmp_path):
    space, other = (tables.Space(spark, str(tmp_path), p) for p in ("one", "two"))
    for s in (space, other):
        s.define("parts", "P", "PNO")
        s.define("parts", "P", "pno")
        for wrong in (("parts", "Q", "pno"), ("nuts", "P", "pno"), ("META", "M", "x"), ("nuts", "N"), ("nuts", "N", "a b")):
            with pytest.raises(ValueError):
                s.define(*wrong)
    with pytest.raises(ValueError):
        space.open("parts")  # defined, but without rows
    with pytest.raises(KeyError):
        space.open("absent")
    rows = spark.createDataFrame([(1, "Screw", 2.5), (2, "Nut", None)], "PNO int, pname string, price double")
    first = space.save(tables.Table("parts", ("pno",), rows))
    changed = space.save(first.update({"price": 3.0}, pname="Nut"))
    assert first.select(pname="Nut").first().price is None  # its version is still there
    assert space.open("parts").select(pname="Nut").first().price == 3.0 == changed.select(pname="Nut").first().price
    assert sorted((r.i, r.attr, r.value) for r in space.dump().collect()) == [("one|:P|:1", "pname", "Screw"), ("one|:P|:1", "pno", "1"), ("one|:P|:1", "price", "2.5"), ("one|:P|:2", "pname", "Nut"), ("one|:P|:2", "pno", "2"), ("one|:P|:2", "price", "3")]
    assert [tuple(r) for r in space.dump(rows=False).collect()] == [("parts", "P", "pno", None, None, None)]
    other.save(tables.Table("parts", ("pno",), rows))
    space.drop("parts")
    assert space.dump().count() == space.metadata().count() == 0
    space.define("nuts", "P", "pno")  # the abbreviation is free again
    space.drop_all()
    assert space.metadata().count() == 0 and other.open("parts").rows.count() == 2


def test_adding_keeps_what_is_there(spark):
    old = tables.Table("t", ("k",), spark.createDataFrame([(1, "a", None), (2, None, None)], "k int, x string, y string"))
    more = spark.createDataFrame([(1, "z", "y"), (2, "b", None), (3, "c", None)], "k int, x string, y string")
    assert sorted(map(tuple, old.add(more).rows.collect())) == [(1, "a", "y"), (2, "b", None), (3, "c", None)]
    assert [tuple(r) for r in old.replace_all(more.where("k = 3")).rows.collect()] == [(3, "c", None)]


def test_folders(spark, tmp_path):
    (tmp_path / "x").mkdir()
    assert folders.exists(spark, str(tmp_path / "x")) and folders.remove(spark, str(tmp_path / "x"))
    assert not folders.exists(spark, str(tmp_path / "x")) and not folders.remove(spark, str(tmp_path / "x"))
    assert folders.new_folder(spark) != folders.new_folder(spark)


def test_encodings_of_files(spark):
    made = [("a\nb", "utf-8-sig", "UTF-8"), ("é\r\nb", "utf-16", "UTF-16LE"), ("日", "utf-32", "UTF-32LE"), ("plain", "utf-8", "?"), ("", "utf-8", "?")]
    big = [(b"\xfe\xff" + "ü".encode("utf-16-be"), "ü", "UTF-16BE"), (b"\0\0\xfe\xff" + "ü".encode("utf-32-be"), "ü", "UTF-32BE")]
    rows = [(bytearray(t.encode(e)), t, name) for t, e, name in made] + [(bytearray(b), t, name) for b, t, name in big]
    df = spark.createDataFrame(rows, "content binary, t string, name string").coalesce(1)
    got = df.select("t", "name", subtitles.encoding_of(F.col("content"), "?"), subtitles.decoded(F.col("content")), subtitles.newline_of(F.col("t"))).collect()
    for wanted, name, found, text, newline in got:
        assert (found, text) == (name, wanted)
        assert newline == ("\r\n" if "\r\n" in wanted else "\n" if "\n" in wanted else None)


def test_boxes_of_cues(spark):
    head = "1\n00:00:01,000 --> 00:00:02.500"
    df = spark.createDataFrame([(head + t,) for t in ("\nhi", "  X1:1 X2:20 Y1:3 Y2:4 \nhi", " XYZ\nhi", " --> x\nhi")], "b string").coalesce(1)
    assert [r[0] and tuple(r[0]) for r in df.select(subtitles.parse(F.col("b"))).collect()] == [(1, 1000, 2500, "hi")] * 2 + [None] * 2


def test_times_of_day(spark):
    df = spark.createDataFrame([(0,), (3_723_004,), (86_399_999,), (86_400_000,), (-1,), (None,)], "ms long").coalesce(1)
    at = F.col("ms")
    got = df.select(times.to_time(at), times.of_time(times.to_time(at)), times.with_parts(at, h=2, ms_part=7), times.parts(at)).collect()
    assert [r[1] for r in got] == [0, 3_723_004, 86_399_999, None, None, None]
    assert [r[2] for r in got][:3] == [7_200_007, 7_323_007, 10_799_007]
    assert got[1][3] == [1, 2, 3, 4]


def test_links_and_fetching(spark):
    df = spark.createDataFrame([("http://a/x",), ("http://b",), (None,)], "url string")
    pages = spark.createDataFrame([("file:///a/x", "body")], "url string, html string")
    got = {r.url: r.fetched for r in values.fetched(df, "url", pages, {"http://": "file:///"}).collect()}
    assert got == {"http://a/x": "body", "http://b": None, None: None}
    links = spark.createDataFrame([("InternalLink", "text::7"), ("InternalLink", "8"), ("ImageURL", "text::7")], "flag string, text string").coalesce(1)
    target = links.select(values.link_target(F.struct("flag", "text"))).collect()
    assert [r[0] and tuple(r[0]) for r in target] == [("text", "7"), (None, "8"), None]


def test_many_prefix_places_take_linear_time(spark):
    n = 30_000
    df = spark.createDataFrame([("the " * n,)], "t string")
    places = df.select(words.prefix_places(F.col("t"), "the").alias("p")).first().p
    assert [p.start for p in places] == [4 * i for i in range(n)]


def test_tokenizers_cut_queries_too(spark):
    df = spark.createDataFrame([("an e-mail came",), ("an email came",), (None,)], "t string").coalesce(1)
    by_space = lambda c: F.split(F.lower(c), " ")
    assert [r[0] for r in df.select(filters.word("t", "E-mail an", by_space)).collect()] == [True, False, False]
    assert df.where(filters.word("t", "-", by_space)).count() == 0


def test_key_probes(spark):
    df = spark.createDataFrame([(3,), (5,), (5,), (None,)], "k int")
    assert setops.has_key(df, "k", 3) and not setops.has_key(df, "k", 4)
    assert setops.at_end(df, "k", 5) and not setops.at_end(df, "k", 4)
    assert [r.k for r in setops.all_keys(df.where("k IS NOT NULL"), "k").collect()] == [3, 5]
    assert setops.first_key(df, "k").first().k == 3
    assert tuple(setops.size_stats(spark.createDataFrame([("ab", 1), (None, 22)], "a string, b int")).first()) == (2, 3, 5)
