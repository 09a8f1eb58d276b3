"""Entries as XML: <entries><entry id="..."><fld n="...">...</fld></entry></entries>."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import xml_escape

SCHEMA = "_id string, fld array<struct<_n: string, _VALUE: string>>"


def read(spark: SparkSession, path: str) -> DataFrame:
    """(id, attr, ord, vtype, sval, nval): every field is text."""
    rows = spark.read.format("xml").option("rowTag", "entry").schema(SCHEMA).load(path)
    fields = rows.select(F.col("_id").alias("id"), F.posexplode("fld").alias("ord", "f"))
    return fields.select("id", F.col("f._n").alias("attr"), "ord", F.lit("string").alias("vtype"), F.coalesce("f._VALUE", F.lit("")).alias("sval"), F.lit(None).cast("double").alias("nval"))


def to_xml(described: DataFrame) -> DataFrame:
    """id and xml of entries given as (id, attrs: map of lists)."""
    quoted = lambda c: F.replace(xml_escape(c), F.lit('"'), F.lit("&quot;"))
    field = lambda a, v: F.concat(F.lit('<fld n="'), quoted(a), F.lit('">'), xml_escape(v), F.lit("</fld>"))
    fields = F.flatten(F.transform(F.array_sort(F.map_entries("attrs")), lambda e: F.transform(e["value"], lambda v: field(e["key"], v))))
    return described.select("id", F.concat(F.lit('<entry id="'), quoted(F.col("id")), F.lit('">'), F.array_join(fields, ""), F.lit("</entry>")).alias("xml"))


def write(described: DataFrame, path: str) -> None:
    """Entries given as (id, attrs: map of lists) as XML files."""
    field = lambda a: lambda v: F.struct(a.alias("_n"), v.alias("_VALUE"))
    fields = F.flatten(F.transform(F.array_sort(F.map_entries("attrs")), lambda e: F.transform(e["value"], field(e["key"]))))
    described.select(F.col("id").alias("_id"), fields.alias("fld")).write.format("xml").option("rootTag", "entries").option("rowTag", "entry").save(path)
