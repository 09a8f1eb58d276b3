"""Entries: rows with any attributes and several values each, as a long table, and the word indexes over it.

The long table has (id, attr, ord, vtype, sval, nval). Numbers keep their own column, so that a string never
equals a number. Indexes are plain tables sorted by word, whose Parquet statistics skip what a prefix can't be in.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as words


def to_entries(df: DataFrame, id_col: str, attrs: list[str] | None = None) -> DataFrame:
    """One row for each value; nulls are missing values, arrays are several. Equal values of an attribute merge."""
    attrs = attrs or [c for c in df.columns if c != id_col]
    fields = []
    for a in attrs:
        kind = df.schema[a].dataType
        many = isinstance(kind, T.ArrayType)
        inner = kind.elementType if many else kind
        number = isinstance(inner, T.NumericType)
        values = F.coalesce(F.col(a), F.array().cast(kind)) if many else F.array(F.col(a))
        fields.append(F.transform(F.array_distinct(values), _value(a, number)))
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.explode(F.flatten(F.array(*fields))).alias("v"))
    return rows.select("id", "v.*").where("sval IS NOT NULL OR nval IS NOT NULL")


def _value(attr: str, number: bool):
    """A function from a value and its place to a row of the long table."""
    none = F.lit(None)

    def row(v: Column, i: Column) -> Column:
        sval, nval = (none.cast("string"), v.cast("double")) if number else (v.cast("string"), none.cast("double"))
        return F.struct(F.lit(attr).alias("attr"), i.cast("int").alias("ord"), F.lit("number" if number else "string").alias("vtype"), sval.alias("sval"), nval.alias("nval"))

    return row


def as_text(entries: DataFrame) -> Column:
    """A value as text, as a describing table shows it."""
    return F.coalesce(entries["sval"], F.when(entries["nval"] == F.floor("nval"), entries["nval"].cast("long").cast("string")).otherwise(entries["nval"].cast("string")))


def describe(entries: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """id and a map from attribute to its values, for the given ids (a lookup join) or all; missing ids give no row."""
    if ids is not None:
        entries = entries.join(ids.select(F.col(ids.columns[0]).cast("string").alias("id")).distinct(), "id", "left_semi")
    own = entries.withColumn("text", as_text(entries)).repartition("id")  # both groupings below then stay in place
    lists = own.groupBy("id", "attr").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]).alias("values"))
    return lists.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("attr", "values")))).alias("attrs"))


def as_dictionary(described: DataFrame) -> DataFrame:
    """Several values of an attribute as lines of one text."""
    return described.select("id", F.transform_values("attrs", lambda _, v: F.array_join(v, "\n")).alias("attrs"))


def upsert(entries: DataFrame, more: DataFrame) -> DataFrame:
    """Additive: new values join the old ones, equal ones merge."""
    return entries.unionByName(more).dropDuplicates(["id", "attr", "sval", "nval"])


def replace(entries: DataFrame, more: DataFrame) -> DataFrame:
    return remove(entries, more.select("id").distinct()).unionByName(more)


def remove(entries: DataFrame, ids: DataFrame) -> DataFrame:
    return entries.join(ids, "id", "left_anti")


def attr_words(entries: DataFrame, tokenizer=words.words) -> DataFrame:
    """(attr, word, id) of every word; the tokenizer is a function of a column."""
    return entries.select("attr", F.explode(F.array_distinct(tokenizer(as_text(entries)))).alias("word"), "id").distinct()


def word_index(df: DataFrame, id_col: str, text_cols: list[str]) -> DataFrame:
    """(word, id) of every word of some columns."""
    found = F.array_distinct(F.flatten(F.array(*(F.coalesce(words.words(F.col(c).cast("string")), F.array().cast("array<string>")) for c in text_cols))))
    return df.select(F.explode(found).alias("word"), F.col(id_col).alias("id"))


def write_sorted(index: DataFrame, path: str, partitions: int | None = None) -> None:
    """The index as Parquet, in ranges of words, so that a prefix reads few row groups."""
    ranged = index.repartitionByRange(partitions, "word", "id") if partitions else index.repartitionByRange("word", "id")
    ranged.sortWithinPartitions("word", "id").write.mode("errorifexists").parquet(path)


def range_written(df: DataFrame, path: str, *keys: str) -> None:
    """Rows as Parquet, in ranges of the keys, so that each file has few of their values."""
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("errorifexists").parquet(path)


def ids_with(index: DataFrame, query: str) -> DataFrame:
    """Ids that have, for every token of the query, a word beginning with it: the filter reaches the scan."""
    each = [index.where(F.startswith("word", F.lit(t))).select("id").distinct() for t in words.query_tokens(query)]
    return reduce(lambda a, b: a.join(b, "id", "left_semi"), each)


def follow_links(entries: DataFrame, links: DataFrame) -> DataFrame:
    """The values that internal links (id, link: struct<attr, id>) lead to: from_id, to_id, attr, value."""
    targets = links.where("link IS NOT NULL").select(F.col("id").alias("from_id"), F.col("link.id").alias("id"), F.col("link.attr").alias("wanted"))
    found = entries.join(targets, "id").where((F.col("wanted") == F.col("attr")) | F.col("wanted").isNull())
    return found.select("from_id", F.col("id").alias("to_id"), "attr", as_text(found).alias("value"))


def index_rows(entries: DataFrame, ids: DataFrame) -> DataFrame:
    """The index rows that some entries make: (kind, attr, key, id), for looking into what is indexed."""
    own = entries.join(ids.select(F.col(ids.columns[0]).cast("string").alias("id")).distinct(), "id", "left_semi")
    by_value = own.select(F.lit("value").alias("kind"), "attr", as_text(own).alias("key"), "id")
    by_word = attr_words(own).select(F.lit("word").alias("kind"), "attr", F.col("word").alias("key"), "id")
    return by_value.unionByName(by_word)
