"""Subtitle files: numbered blocks of times and text, separated by empty lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cues import format_time, parse_time

_AT = r"\d{2}:\d{2}:\d{2}[,.]\d{3}"
#: A block's first lines: a number; two times, and the corners of a box if the cue has one. Lines of text follow.
_BOX = r"(?:[ \t]+[XY][12]:\d+)*[ \t]*"
NUMBER, TIMES = r"^\d+\z", rf"^{_AT} --> {_AT}{_BOX}\z"
#: Byte order marks and the encodings they stand for, longer ones first.
MARKS = (("FFFE0000", "UTF-32LE"), ("0000FEFF", "UTF-32BE"), ("EFBBBF", "UTF-8"), ("FFFE", "UTF-16LE"), ("FEFF", "UTF-16BE"))
MODES = ("PERMISSIVE", "DROPMALFORMED", "FAILFAST")


def parse(text: Column) -> Column:
    """A block as struct<index, start_ms, end_ms, text>; null if it isn't one."""

    def cue(lines: Column) -> Column:
        number, times, rest = (lines[k] for k in range(3))
        found = F.struct(number.cast("int").alias("index"), parse_time(F.substring(times, 1, 12)).alias("start_ms"), parse_time(F.substring(times, 18, 12)).alias("end_ms"), F.rtrim(rest, F.lit("\n")).alias("text"))
        return F.when((F.size(lines) == 3) & number.rlike(NUMBER) & times.rlike(TIMES), found)

    return F.transform(F.array(F.split(text, "\n", 3)), cue)[0]  # the lines are bound once


def cues_of(files: DataFrame, mode: str = "DROPMALFORMED") -> DataFrame:
    """(file, index, start_ms, end_ms, text) of files given as (file, content); further columns come after file.

    Malformed blocks are kept as nulls with their text (PERMISSIVE), dropped, or end the job (FAILFAST).
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    own = [c for c in files.columns if c != "content"]
    clean = F.regexp_replace(F.regexp_replace("content", "^﻿", ""), "\r", "")
    blocks = files.select(*own, F.explode(F.split(clean, r"\n\s*\n")).alias("block")).where(F.trim(F.regexp_replace("block", r"\s", "")) != "")
    found = blocks.select(*own, "block", parse(F.ltrim(F.col("block"), F.lit("\n "))).alias("cue"))
    if mode == "DROPMALFORMED":
        return found.where("cue IS NOT NULL").select(*own, "cue.*")
    if mode == "FAILFAST":
        return found.select(*own, F.when(F.col("cue").isNull(), F.raise_error(F.concat(F.lit("malformed cue: "), F.col("block")))).otherwise(F.col("cue")).alias("cue")).select(*own, "cue.*")
    return found.select(*own, "cue.*", F.when(F.col("cue").isNull(), F.col("block")).alias("malformed"))


def encoding_of(content: Column, default: str = "UTF-8") -> Column:
    """The encoding that a file's byte order mark names; the default without one."""
    head = F.hex(F.substring(content, 1, 4))
    cases = F.lit(default)
    for mark, name in reversed(MARKS):
        cases = F.when(F.startswith(head, F.lit(mark)), F.lit(name)).otherwise(cases)
    return cases


def decoded(content: Column, encoding: str | None = None) -> Column:
    """The text of a file: in the given encoding, or in that of its mark, which is left out."""
    if encoding:
        return F.decode(content, encoding)
    head, text = F.hex(F.substring(content, 1, 4)), F.decode(content, "UTF-8")
    for mark, name in reversed(MARKS):
        rest = F.substring(content, len(mark) // 2 + 1, (1 << 31) - 1)
        # Spark's decoder knows UTF-32 in the order of its mark alone
        body = F.decode(content, "UTF-32") if name.startswith("UTF-32") else F.decode(rest, name)
        text = F.when(F.startswith(head, F.lit(mark)), body).otherwise(text)
    return text


#: Bytes that a guess looks at, and the eight-bit encodings that it knows besides Latin-1.
GUESSED_FROM = 8192
EIGHT_BIT = {"windows-1251": "cp1251", "KOI8-R": "koi8_r"}


def guessed_encoding(content: Column) -> Column:
    """The encoding of a file: by its mark; without one, by what its first bytes can be and look like.

    In UTF-16 one byte of each pair is nearly always 0 or 4 (Latin and Cyrillic letters). What is valid UTF-8 is that. Of
    the eight-bit encodings, Cyrillic ones have most of their upper bytes next to each other, others a few between ASCII
    letters; windows-1251 has its small letters, which prevail, above its capitals, KOI8-R below.
    """
    head = F.substring(content, 1, GUESSED_FROM)
    digits = F.hex(head)
    pairs = F.regexp_extract_all(digits, F.lit("(....)"), 1)
    of = lambda test: F.size(F.filter(pairs, test)) / F.greatest(F.size(pairs), F.lit(1))
    first, second = of(lambda p: F.substring(p, 1, 2).isin("00", "04")), of(lambda p: F.substring(p, 3, 2).isin("00", "04"))
    count = lambda pattern: F.regexp_count(F.decode(head, "ISO-8859-1"), F.lit(pattern))
    upper, joined = count(r"[\x80-\xFF]"), count(r"[\x80-\xFF](?=[\x80-\xFF])")
    small, large = count(r"[\xE0-\xFF]"), count(r"[\xC0-\xDF]")
    # the head may end within a character
    whole = F.when(F.length(content) <= GUESSED_FROM, head).otherwise(F.unhex(F.regexp_replace(digits, "(?:[F][0-7].{0,4}|E..{0,2}|[CD].)$", "")))
    eight = F.when(joined * 2 > upper, F.when(small >= large, "windows-1251").otherwise("KOI8-R")).otherwise("ISO-8859-1")
    bare = F.when((second > 0.7) & (first < 0.5), "UTF-16LE").when((first > 0.7) & (second < 0.5), "UTF-16BE").when(F.is_valid_utf8(whole.cast("string")), "UTF-8").otherwise(eight)
    marked = encoding_of(content, "")
    return F.when(marked != "", marked).otherwise(bare)


def guessed_text(content: Column) -> Column:
    """The text of a file in the encoding that it seems to have; a mark is left out."""
    name, upper = guessed_encoding(content), bytes(range(128, 256))
    text = F.when(encoding_of(content, "") != "", decoded(content))
    for encoding in ("UTF-16LE", "UTF-16BE", "ISO-8859-1"):
        text = text.when(name == encoding, F.decode(content, encoding))
    for encoding, codec in EIGHT_BIT.items():
        text = text.when(name == encoding, F.translate(F.decode(content, "ISO-8859-1"), upper.decode("latin-1"), upper.decode(codec, "replace")))
    return text.otherwise(F.decode(content, "UTF-8"))


def newline_of(text: Column) -> Column:
    """The first line end of a text; null without any."""
    found = F.regexp_extract(text, r"(\r\n|\n|\r)", 1)
    return F.when(found != "", found)


def read(spark: SparkSession, path: str, encoding: str | None = None, mode: str = "DROPMALFORMED") -> DataFrame:
    """Cues of all files under a path; without an encoding, each file's mark decides (UTF-8 if it has none), or, if it is
    "guess", what the file looks like. A file is one task's work; ``read_split`` reads large ones."""
    text = guessed_text(F.col("content")) if encoding == "guess" else decoded(F.col("content"), encoding)
    return cues_of(spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), text.alias("content")), mode)


def _blocks(reader, path: str, eol: str) -> DataFrame:
    rows = reader.option("lineSep", eol * 2).text(path)
    # what Spark takes for a block may end with lines of white space
    return rows.select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", r"(?:\n[ \t\r]*)+$", "").alias("content"))


def read_split(spark: SparkSession, path: str, eol: str = "\n", mode: str = "DROPMALFORMED") -> DataFrame:
    """Cues of UTF-8 files with known line ends. Blocks are the records, so Spark cuts a large file at empty lines and
    gives its parts to many tasks."""
    return cues_of(_blocks(spark.read, path, eol), mode)


def read_stream(spark: SparkSession, path: str, eol: str = "\n", mode: str = "DROPMALFORMED") -> DataFrame:
    """Cues of the UTF-8 files that arrive in a folder, as a stream: its checkpoint says which files were read."""
    return cues_of(_blocks(spark.readStream.schema("value string"), path, eol), mode)


def block(index: Column, start_ms: Column, end_ms: Column, text: Column) -> Column:
    return F.concat(index.cast("string"), F.lit("\n"), format_time(start_ms), F.lit(" --> "), format_time(end_ms), F.lit("\n"), text, F.lit("\n"))


def _contents(cues: DataFrame, eol: str, *keys: str) -> DataFrame:
    """What a file of each value of the keys says, but for its last line end: cues in order."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("index", "start_ms", "end_ms", "text"))), lambda c: block(c["index"], c["start_ms"], c["end_ms"], c["text"])), "\n")
    return cues.groupBy(*keys).agg(F.replace(body, F.lit("\n"), F.lit(eol)).alias("value"))


def write(cues: DataFrame, path: str, eol: str = "\n") -> None:
    """One text file for each value of ``file``, cues in order. A file takes milliseconds, whatever is in it; ``pack``
    writes very many."""
    _contents(cues, eol, "file").write.partitionBy("file").option("lineSep", eol).text(path)


def pack(cues: DataFrame, path: str, eol: str = "\n", most: int | None = None) -> None:
    """The files that ``write`` makes, byte for byte, as rows of a Parquet table (file, part, content). With ``most``, a
    file is cut between cues into parts of so many numbers, which different tasks write and read."""
    part = F.lit(0).cast("long") if most is None else F.floor(F.col("index") / most)
    rows = _contents(cues.withColumn("part", part), eol, "file", "part")
    rows.select("file", "part", F.encode(F.concat("value", F.lit(eol)), "UTF-8").alias("content")).write.parquet(path)


def packed(spark: SparkSession, path: str) -> DataFrame:
    """Whole files (file, content) of a table that ``pack`` wrote."""
    parts = F.array_sort(F.collect_list(F.struct("part", F.decode("content", "UTF-8").alias("text"))))
    whole = F.array_join(F.transform(parts, lambda p: p["text"]), "")
    return spark.read.parquet(path).groupBy("file").agg(F.encode(whole, "UTF-8").alias("content"))


def read_packed(spark: SparkSession, path: str, mode: str = "DROPMALFORMED") -> DataFrame:
    """Cues of all files of a table that ``pack`` wrote; a part is one task's work."""
    return cues_of(spark.read.parquet(path).select("file", decoded(F.col("content")).alias("content")), mode)


def load_new(spark: SparkSession, path: str, known: DataFrame | None = None, encoding: str | None = None) -> DataFrame:
    """Cues of the files whose content isn't among ``known`` fingerprints, with the fingerprint of their file."""
    return new_of(spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content"), known, encoding)


def new_of(files: DataFrame, known: DataFrame | None = None, encoding: str | None = None) -> DataFrame:
    """``load_new`` of files that are given as (file, content)."""
    files = files.select("file", F.md5("content").alias("fingerprint"), decoded(F.col("content"), encoding).alias("content"))
    if known is not None:
        files = files.join(known.select("fingerprint").distinct(), "fingerprint", "left_anti")
    return cues_of(files).select("file", "index", "start_ms", "end_ms", "text", "fingerprint")
