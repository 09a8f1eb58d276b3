"""Parquet tables whose files are named in a log, so that files can be made larger and smaller under their readers.

Appends add files; ``resize`` packs files that are too small together and cuts those that are too large, and leaves all
others alone. Both become visible in one entry of the log. What readers of an older state may still need stays until
``vacuum``.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from . import folders
from .log import Log


def packed(sizes: dict[str, int], room: int) -> list[list[str]]:
    """Bins of names whose sizes add up to ``room`` at most (or one name): largest first, each into the fullest bin that
    has room for it.

    >>> packed({"a": 6, "b": 5, "c": 4, "d": 3}, 10)
    [['a', 'c'], ['b', 'd']]
    """
    bins: list[tuple[int, list[str]]] = []
    for name, size in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        fits = [k for k, (used, _) in enumerate(bins) if used + size <= room]
        if fits:
            k = max(fits, key=lambda k: bins[k][0])
            bins[k] = (bins[k][0] + size, [*bins[k][1], name])
        else:
            bins.append((size, [name]))
    return [names for _, names in bins]


@dataclass(frozen=True)
class FileSet:
    spark: SparkSession
    path: str

    @property
    def log(self) -> Log:
        """State: the size of each file."""

        def fold(state: dict, entry: dict) -> dict:
            return {name: size for name, size in (state | entry).items() if size is not None}

        return Log(self.spark, f"{self.path}/log", fold)

    def files(self) -> dict[str, int]:
        return self.log.state()[1]

    def read(self) -> DataFrame:
        if not (names := sorted(self.files())):
            raise ValueError(f"no files in {self.path}")
        return self.spark.read.parquet(*(f"{self.path}/{n}" for n in names))

    def _written(self, df: DataFrame) -> dict[str, int]:
        folder = uuid.uuid4().hex
        df.write.parquet(f"{self.path}/{folder}")
        return {f"{folder}/{n}": size for n, size in folders.sizes(self.spark, f"{self.path}/{folder}").items() if n.endswith(".parquet")}

    def append(self, df: DataFrame) -> list[str]:
        """The names of the new files."""
        found = self._written(df)
        self.log.commit(lambda state: found)
        return sorted(found)

    def resize(self, least: int, most: int) -> list[str]:
        """Brings files of under ``least`` and over ``most`` bytes into bounds, as far as there is something to pack them
        with; rows stay in their order within a file. The names of the files that were replaced."""
        target, sizes = (least + most) // 2, self.files()
        small = packed({n: s for n, s in sizes.items() if s < least}, target)
        groups = [(names, 1) for names in small if len(names) > 1]
        groups += [([n], math.ceil(s / target)) for n, s in sizes.items() if s > most]
        made: dict[str, int] = {}
        # a job for all files that become as many as each other: a task reads a group's files, and rows aren't shuffled but to cut
        for names, parts in groups:
            df = self.spark.read.parquet(*(f"{self.path}/{n}" for n in names))
            made |= self._written(df.coalesce(1) if parts == 1 else df.repartition(parts))
        gone = [n for names, _ in groups for n in names]

        def change(state: dict) -> dict | None:
            if missing := [n for n in gone if n not in state]:
                raise ValueError(f"{missing} were replaced meanwhile")
            return dict.fromkeys(gone) | made or None

        self.log.commit(change)
        return sorted(gone)

    def vacuum(self) -> list[str]:
        """Deletes files that the last state doesn't name."""
        live = self.files()
        names = [f"{folder}/{n}" for folder in folders.children(self.spark, self.path) if folder != "log" for n in folders.sizes(self.spark, f"{self.path}/{folder}") if n.endswith(".parquet")]
        return sorted(n for n in names if n not in live and folders.remove(self.spark, f"{self.path}/{n}"))
