"""Keyed tables: select, insert, update and delete as transformations of DataFrames.

Spark keeps the tables; these functions say what a table looks like after a change, and refuse changes that
would break its key. A Space names tables and keeps them as Parquet: every change of a table is a new version of its rows
and an entry in the space's log, so readers of an old version aren't disturbed, and a change of a version that isn't the
last one any more is refused.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import rendered_key
from ..sources import folders
from ..sources.log import Conflict, Log
from .entries import as_text, to_entries
from .filters import whole


@dataclass(frozen=True)
class Table:
    """A name, key columns, and the rows."""

    name: str
    keys: tuple[str, ...]
    rows: DataFrame
    #: Where the version lies that these rows were made of, if they come from a space.
    origin: str | None = None

    def __post_init__(self):
        lower = [c.lower() for c in self.rows.columns]
        if missing := [k for k in self.keys if k.lower() not in lower]:
            raise ValueError(f"{self.name} lacks key columns {missing}")
        object.__setattr__(self, "rows", self.rows.toDF(*lower))
        object.__setattr__(self, "keys", tuple(k.lower() for k in self.keys))

    def _with(self, rows: DataFrame) -> Table:
        return Table(self.name, self.keys, rows, self.origin)

    def select(self, *more: Column, **equal) -> DataFrame:
        """Rows whose named columns equal, and that pass further tests."""
        rows = self.rows.where(whole(self.rows, **{k.lower(): v for k, v in equal.items()}))
        for test in more:
            rows = rows.where(test)
        return rows

    def insert(self, rows: DataFrame) -> Table:
        """New rows; those with a known key take the place of the old ones."""
        return self._with(self.delete(rows).rows.unionByName(rows.toDF(*map(str.lower, rows.columns)), allowMissingColumns=True))

    def update(self, values: dict, **equal) -> Table:
        if any(k.lower() in self.keys for k in values):
            raise ValueError("an update can't change a key")
        here = whole(self.rows, **equal)
        kinds = {f.name: f.dataType for f in self.rows.schema}
        changed = {k.lower(): F.when(here, F.lit(v).cast(kinds[k.lower()])).otherwise(F.col(k.lower())) for k, v in values.items()}
        return self._with(self.rows.withColumns(changed))

    def delete(self, keys: DataFrame) -> Table:
        return self._with(self.rows.join(keys.toDF(*map(str.lower, keys.columns)).select(*self.keys).distinct(), list(self.keys), "left_anti").select(*self.rows.columns))

    def delete_where(self, **equal) -> Table:
        return self._with(self.rows.where(~whole(self.rows, **equal)))

    def replace_all(self, rows: DataFrame) -> Table:
        """The table with these rows instead of its own."""
        return self._with(rows.toDF(*map(str.lower, rows.columns)).select(*self.rows.columns))

    def add(self, rows: DataFrame) -> Table:
        """New rows; of a known key, only what the old row lacks is taken."""
        names = [c for c in self.rows.columns if c not in self.keys]
        more = rows.toDF(*map(str.lower, rows.columns))
        both = self.rows.withColumn("__k", F.lit(0)).unionByName(more.withColumn("__k", F.lit(1)), allowMissingColumns=True)
        first = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("__k"))).alias(c) for c in names]
        return self._with(both.groupBy(*self.keys).agg(*first).select(*self.rows.columns))


_METADATA = "table_name string, abbreviation string, keys array<string>, location string"


@dataclass(frozen=True)
class Space:
    """Tables with names, abbreviations and keys, under a prefix of a folder. Several spaces share a folder undisturbed."""

    spark: SparkSession
    path: str
    prefix: str = "ts"
    #: A name that no table may have, as the space's own description goes by it.
    meta: str = "META"

    @property
    def _log(self) -> Log:
        def fold(known: dict, entry: dict) -> dict:
            return {k: v for k, v in (known | entry).items() if v is not None}

        return Log(self.spark, f"{self.path}/{self.prefix}/{self.meta}", fold)

    def metadata(self) -> DataFrame:
        """table_name, abbreviation, keys and location of the tables that are defined (a row each); location is null without rows."""
        return self.spark.createDataFrame([(name, *own) for name, own in sorted(self._known().items())], _METADATA)

    def _known(self) -> dict[str, tuple[str, list[str], str | None]]:
        return {name: tuple(own) for name, own in self._log.state()[1].items()}

    def _definition(self, name: str) -> tuple[str, list[str], str | None]:
        return self._of(self._known(), name)

    def _of(self, known: dict, name: str) -> tuple[str, list[str], str | None]:
        if (found := known.get(name)) is None:
            raise KeyError(f"no table {name} in {self.prefix}")
        return tuple(found)

    def define(self, name: str, abbreviation: str, *keys: str) -> None:
        """Defines a table; the same definition again changes nothing, another one under a known name or abbreviation is an error."""
        if self.meta in (name, abbreviation):
            raise ValueError(f"{self.meta} names the space's description")
        if not keys or any(len(k.split()) != 1 for k in keys):
            raise ValueError("key columns need names without white space")
        own = [k.lower() for k in keys]

        def change(known: dict) -> dict | None:
            if name in known:
                if known[name][:2] == [abbreviation, own]:
                    return None
                raise ValueError(f"table {name} is defined otherwise")
            if abbreviation in {a for a, _, _ in known.values()}:
                raise ValueError(f"the abbreviation {abbreviation} is in use")
            return {name: [abbreviation, own, None]}

        self._log.commit(change)

    def open(self, name: str) -> Table:
        _, keys, location = self._definition(name)
        if location is None:
            raise ValueError(f"table {name} has no rows yet")
        return Table(name, tuple(keys), self.spark.read.parquet(location), location)

    def save(self, table: Table) -> Table:
        """The table's rows as its new version, and the table as read from there. Rows that were made of a version which
        isn't the last one any more are refused (``Conflict``): the change would undo another writer's."""
        abbreviation, keys, _ = self._definition(table.name)
        if list(table.keys) != keys:
            raise ValueError(f"table {table.name} has the keys {keys}")
        location = f"{self.path}/{self.prefix}/{abbreviation}/{uuid.uuid4().hex}"
        table.rows.write.mode("errorifexists").parquet(location)

        def change(known: dict) -> dict:
            now = self._of(known, table.name)
            if now[:2] != (abbreviation, keys) or table.origin not in (None, now[2]):
                raise Conflict(f"table {table.name} has changed meanwhile")
            return {table.name: [abbreviation, keys, location]}

        try:
            self._log.commit(change)
        except (Conflict, KeyError):
            folders.remove(self.spark, location)
            raise
        return Table(table.name, table.keys, self.spark.read.parquet(location), location)

    def drop(self, name: str) -> None:
        """Takes a table and its rows away; its name and abbreviation are free again."""
        abbreviation, _, _ = self._definition(name)
        self._log.commit(lambda known: {name: None} if self._of(known, name) else None)
        folders.remove(self.spark, f"{self.path}/{self.prefix}/{abbreviation}")

    def drop_all(self) -> None:
        """Everything of this space; other prefixes stay."""
        folders.remove(self.spark, f"{self.path}/{self.prefix}")

    def extended(self, table: Table) -> DataFrame:
        """The rows with table_name and i, an id made of prefix, abbreviation and keys."""
        abbreviation, keys, _ = self._definition(table.name)
        return table.rows.withColumns({"table_name": F.lit(table.name), "i": rendered_key(F.lit(self.prefix), F.lit(abbreviation), *map(F.col, keys))})

    def dump(self, rows: bool = True) -> DataFrame:
        """table_name, abbreviation, keys, i, attr, value: what is defined and, unless ``rows`` is false, every value."""
        parts = []
        for name, (abbreviation, keys, location) in sorted(self._known().items()):
            head = [F.lit(name).alias("table_name"), F.lit(abbreviation).alias("abbreviation"), F.lit(" ".join(keys)).alias("keys")]
            if not rows or location is None:
                none = F.lit(None).cast("string")
                parts.append(self.spark.range(1).select(*head, none.alias("i"), none.alias("attr"), none.alias("value")))
                continue
            own = self.extended(self.open(name)).drop("table_name")
            values = to_entries(own, "i")
            parts.append(values.select(*head, F.col("id").alias("i"), "attr", as_text(values).alias("value")))
        if not parts:
            kinds = ("table_name", "abbreviation", "keys", "i", "attr", "value")
            return self.spark.createDataFrame([], ", ".join(f"{k} string" for k in kinds))
        return reduce(DataFrame.unionByName, parts)
