"""Encodings without marks, large subtitle files, and UUIDs, against Python's own."""

import uuid
from datetime import datetime, timezone

from pyspark.sql import functions as F

from docquarry.functions import ids
from docquarry.sources import subtitles

TEXTS = {"UTF-8": "Ein Gruß aus Köln, naïve façade", "ISO-8859-1": "Ein Gruß aus Köln, naïve façade", "UTF-16LE": "Plain words and Köln", "UTF-16BE": "Plain words and Köln", "windows-1251": "Привет, это обычный текст", "KOI8-R": "Привет, это обычный текст"}
CODECS = {"windows-1251": "cp1251", "KOI8-R": "koi8_r"}


def test_guesses(spark):
    rows = [(e, bytearray((t * 3).encode(CODECS.get(e, e))), t * 3) for e, t in TEXTS.items()]
    rows += [("UTF-8", bytearray(b"only ascii"), "only ascii"), ("UTF-8", bytearray(), ""), ("UTF-16LE", bytearray(b"\xff\xfe" + "Я".encode("utf-16-le")), "Я"), ("UTF-16LE", bytearray("Это текст без метки".encode("utf-16-le")), "Это текст без метки")]
    rows += [("UTF-8", bytearray(("x" * shift + "日本語é😀" * 3000).encode()), "x" * shift + "日本語é😀" * 3000) for shift in range(4)]  # the head ends within a character
    df = spark.createDataFrame(rows, "e string, content binary, t string").coalesce(1)
    for e, t, found, text in df.select("e", "t", subtitles.guessed_encoding(F.col("content")), subtitles.guessed_text(F.col("content"))).collect():
        assert (found, text) == (e, t)


def test_files_are_guessed(spark, tmp_path):
    cue = "1\n00:00:01,000 --> 00:00:02,500\n{}\n\n2\n00:00:03,000 --> 00:00:04,000\n{}\n"
    for k, (e, t) in enumerate(TEXTS.items()):
        (tmp_path / f"{k}.srt").write_bytes(cue.format(t, t).encode(CODECS.get(e, e)))
    found = subtitles.read(spark, f"{tmp_path}/*.srt", encoding="guess").collect()
    assert sorted(r.text for r in found) == sorted(t for t in TEXTS.values() for _ in range(2))


def test_large_files_are_split(spark, tmp_path):
    gaps = ["\n\n", "\n \n", "\n\n\n", "\n\t\n\n"]
    blocks = [f"{k}\n00:00:{k % 60:02},000 --> 00:01:{k % 60:02},500\ntext {k}\nsecond line" for k in range(5000)]
    whole = "".join(b + gaps[k % 4] for k, b in enumerate(blocks))
    (tmp_path / "a.srt").write_text(whole)
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "c.srt").write_bytes("".join(b + "\n\n" for b in blocks[:50]).replace("\n", "\r\n").encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", 20_000)
    try:
        split = subtitles.read_split(spark, f"{tmp_path}/a.srt")
        assert split.rdd.getNumPartitions() > 5
        wanted = subtitles.read(spark, f"{tmp_path}/a.srt")
        rows = lambda df: sorted(tuple(r) for r in df.drop("file").collect())
        assert rows(split) == rows(wanted) and split.count() == 5000
        assert rows(subtitles.read_split(spark, f"{tmp_path}/b/c.srt", "\r\n")) == rows(subtitles.read(spark, f"{tmp_path}/b/c.srt"))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_uuids(spark):
    known = [uuid.UUID(int=(k * 0x9E3779B97F4A7C15F39CC0605CEDC835) % (1 << 128)) for k in range(1, 60)] + [uuid.uuid1(node=k, clock_seq=k) for k in range(5)] + [uuid.uuid4(), uuid.NAMESPACE_DNS]
    shapes = [str(u) for u in known] + [known[0].hex, f"{{{known[1]}}}", known[2].urn, "x", None, "12345"]
    rows = spark.createDataFrame([(s,) for s in shapes], "u string").coalesce(1).select("u", ids.uuid_fields(F.col("u")).alias("f")).collect()
    for (s, f), u in zip(rows, [*known, *known[:3]], strict=False):
        assert (f.time_low, f.time_mid, f.time_hi, f.node) == (u.time_low, u.time_mid, u.time_hi_version, u.node)
        assert f.clock == ((u.clock_seq_hi_variant << 8 | u.clock_seq_low) & 0x3FFF)
        assert f.version == u.version and (f.variant == "RFC 4122") == (u.variant == uuid.RFC_4122)
        if u.version == 1:
            assert abs(f.at.replace(tzinfo=timezone.utc).timestamp() - (u.time - ids.EPOCH_STEPS) / 1e7) < 1e-5
    assert [r.f for r in rows[-3:]] == [None] * 3
    at = datetime(2024, 5, 17, 12, 34, 56, 789012)
    made = spark.createDataFrame([(at, 77, 0xABCDEF012345)], "t timestamp_ntz, c int, n long").select(ids.time_uuid(F.col("t"), F.col("c"), F.col("n"))).first()[0]
    u = uuid.UUID(made)
    assert (u.version, u.node, u.clock_seq, u.time) == (1, 0xABCDEF012345, 77, int(at.replace(tzinfo=timezone.utc).timestamp() * 10**6) * 10 + ids.EPOCH_STEPS)
