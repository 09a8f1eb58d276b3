"""Very many subtitle files as rows of a table, against the same files on disk."""

import os
import urllib.parse

import pytest
from pyspark.sql import functions as F

from docquarry.plans import catalog
from docquarry.sources import subtitles

CUES = [(f"f{k % 7} {k % 7}", k // 7, 100 * k, 100 * k + 50, f"text {k}" + "\nanother ä" * (k % 3)) for k in range(200)] + [("one", 1, 0, 1, ""), ("big", 10**9, 5, 6, "x"), ("big", -3, 7, 8, "y")]


@pytest.fixture
def made(spark):
    return spark.createDataFrame(CUES, "file string, index int, start_ms long, end_ms long, text string")


@pytest.mark.parametrize(("eol", "most"), [("\n", None), ("\r\n", None), ("\n", 4), ("\r\n", 1)])
def test_packs_hold_the_bytes_of_files(spark, made, tmp_path, eol, most):
    subtitles.write(made, str(tmp_path / "files"), eol)
    subtitles.pack(made, str(tmp_path / "pack"), eol, most)
    files = {urllib.parse.unquote(p.parent.name.removeprefix("file=")): p.read_bytes() for p in (tmp_path / "files").glob("*/*.txt")}
    assert {r.file: bytes(r.content) for r in subtitles.packed(spark, str(tmp_path / "pack")).collect()} == files
    rows = lambda df: sorted(tuple(r)[1:] for r in df.collect())
    back = subtitles.read_packed(spark, str(tmp_path / "pack"))
    assert sorted(tuple(r) for r in back.collect()) == sorted(c for c in CUES if c[4] and c[1] >= 0)  # others aren't cues in a file
    assert rows(back) == rows(subtitles.read(spark, f"{tmp_path}/files/*/*.txt"))
    parts = spark.read.parquet(str(tmp_path / "pack"))
    assert parts.count() == (len(files) if most is None else len({(c[0], c[1] // most) for c in CUES}))
    # what was loaded before is known in both forms
    new = subtitles.new_of(subtitles.packed(spark, str(tmp_path / "pack")))
    assert rows(new) == rows(subtitles.load_new(spark, f"{tmp_path}/files/*/*.txt"))
    known = subtitles.load_new(spark, f"{tmp_path}/files/*/*.txt").where(F.col("text") == "text 0").select("fingerprint")
    assert {r.file for r in subtitles.new_of(subtitles.packed(spark, str(tmp_path / "pack")), known).collect()} == set(files) - {"f0 0", "one"}  # of which one has no cues


def test_further_columns_stay(spark):
    files = spark.createDataFrame([("a", 5, "1\n00:00:00,000 --> 00:00:01,000\nx\n\nbroken\n")], "file string, size int, content string")
    assert [tuple(r) for r in subtitles.cues_of(files).collect()] == [("a", 5, 1, 0, 1000, "x")]
    assert subtitles.cues_of(files, "PERMISSIVE").columns == ["file", "size", "index", "start_ms", "end_ms", "text", "malformed"]


@pytest.mark.parametrize("name", ["subtitles_loaded_anew", "srt_split_read", "srt_file_round_trip"])
def test_files_on_disk_dont_grow_with_the_rows(spark, tiny, tmp_path, monkeypatch, name):
    monkeypatch.setattr(catalog, "new_folder", lambda spark: str(tmp_path / "shared"))
    users = spark.read.parquet(f"{tiny}/events.parquet")
    more = users.withColumn("user_id", F.col("event_id"))  # each has one of its own
    more.write.parquet(str(tmp_path / "in" / "events.parquet"))
    assert catalog.QUERIES[name](spark, str(tmp_path / "in")).count() <= more.count()
    assert sum(len(names) for _, _, names in os.walk(tmp_path / "shared")) < 50
