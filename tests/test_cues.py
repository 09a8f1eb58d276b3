"""Cue times and subtitle files."""

import pytest
from pyspark.sql import functions as F

from docquarry.functions import cues as times
from docquarry.operators import cues
from docquarry.sources import subtitles

FILE = "﻿1\r\n00:00:01,500 --> 00:00:02,000\r\nHello\r\nthere\r\n\r\n2\r\n00:01:00.250 --> 00:01:01,000 X1:10 X2:20\r\nThe <i>end</i>\r\n\r\nbroken\r\n\r\n3\r\n10:00:00,000 --> 10:00:00,001\r\n\r\n"


def test_times(spark):
    df = spark.createDataFrame([("01:02:03,004",), ("99:59:59.999 tail",), ("1:02:03,004",), (None,)], "t string").coalesce(1)
    ms = [r[0] for r in df.select(times.parse_time(F.col("t"))).collect()]
    assert ms == [3_723_004, 359_999_999, None, None]
    shown = spark.createDataFrame([(3_723_004,), (359_999_999,), (0,)], "ms long").coalesce(1).select(times.format_time(F.col("ms"))).collect()
    assert [r[0] for r in shown] == ["01:02:03,004", "99:59:59,999", "00:00:00,000"]


def test_parse_and_modes(spark):
    files = spark.createDataFrame([("f", FILE)], "file string, content string")
    good = [tuple(r) for r in subtitles.cues_of(files).orderBy("index").collect()]
    assert good[:2] == [("f", 1, 1500, 2000, "Hello\nthere"), ("f", 2, 60250, 61000, "The <i>end</i>")]
    kept = subtitles.cues_of(files, "PERMISSIVE")
    assert "broken" in [r.malformed for r in kept.collect()]
    with pytest.raises(Exception, match="malformed"):
        subtitles.cues_of(files, "FAILFAST").collect()
    with pytest.raises(ValueError):
        subtitles.cues_of(files, "other")


def test_round_trip_through_files(spark, tmp_path):
    rows = [("a", 1, 0, 10, "x\ny"), ("a", 2, 20, 30, "z"), ("b", 1, 5, 6, "ä")]
    made = spark.createDataFrame(rows, "file string, index int, start_ms long, end_ms long, text string")
    subtitles.write(made, str(tmp_path / "out"))
    back = subtitles.read(spark, str(tmp_path / "out" / "*" / "*.txt"))
    assert sorted((r["index"], r.start_ms, r.end_ms, r.text) for r in back.collect()) == sorted(r[1:] for r in rows)


def test_cut_shift_renumber_search(spark):
    made = spark.createDataFrame([("f", 1000, 2000, "b <i>the</i>"), ("f", 0, 500, "the a"), ("f", 1000, 1500, "c")], "file string, start_ms long, end_ms long, text string")
    assert [r.text for r in cues.cut(made, starts_after=500, ends_before=2000).collect()] == ["c"]
    assert cues.cut(made, starts_before=0).count() == 3
    assert sorted(r.start_ms for r in cues.shift(made, ratio=0.0625, seconds=1).collect()) == [1000, 1063, 1063]
    assert {r.text: r["index"] for r in cues.renumber(made, "file").collect()} == {"the a": 1, "c": 2, "b <i>the</i>": 3}
    hits = {r.seek_ms: r.shown for r in cues.search(made, "the", lead_ms=300).collect()}
    assert hits == {0: "the a", 700: "b [I]the[/I]"}


def test_known_files_are_not_loaded_again(spark, tmp_path):
    for name, text in (("a.srt", "one"), ("b.srt", "two")):
        (tmp_path / name).write_text(f"1\n00:00:00,000 --> 00:00:01,000\n{text}\n")
    first = subtitles.load_new(spark, str(tmp_path / "a.srt"))
    assert [r.text for r in first.collect()] == ["one"]
    again = subtitles.load_new(spark, str(tmp_path), first)
    assert [r.text for r in again.collect()] == ["two"]
