"""Writing sessions over layered tables: rows wait, become visible at once, and are retired by compaction.

An archive is a folder with a Parquet table and a log. ``rows`` holds the rows of each session in a partition of its
own, and the log says what became of the sessions. Publishing, discarding and retiring only append an entry to the log,
whose number no two writers can take, so of two writers that close one session the second is refused, and readers see a
change wholly or not at all, whatever the number of rows. Files are deleted by ``vacuum`` alone.

A session is *waiting* while only it sees its rows, *active* when anybody does, *retired* when a compacted base
holds what is left of them, *discarded* when nobody does.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import folders
from ..sources.log import Log
from . import layers

STATES = ("waiting", "active", "retired", "discarded")
STATE_SCHEMA = "session string, state string"


@dataclass(frozen=True)
class Archive:
    spark: SparkSession
    path: str

    @property
    def log(self) -> Log:
        return Log(self.spark, f"{self.path}/log", lambda states, entry: states | entry)

    def begin(self, session: str | None = None) -> str:
        """A new waiting session, or the one of that name again, as it was left (``resume``)."""
        session = session or uuid.uuid4().hex

        def change(states: dict[str, str]) -> dict[str, str] | None:
            if (known := states.get(session)) not in (None, "waiting"):
                raise ValueError(f"session {session} is closed")
            return None if known else {session: "waiting"}

        self.log.commit(change)
        return session

    resume = begin

    def write(self, rows: DataFrame, session: str, level: int = 1) -> None:
        """Adds rows (key, value, is_deleted, ts) to a waiting session; nobody else sees them."""
        if self.state(session) != "waiting":
            raise ValueError(f"session {session} isn't waiting")
        own = rows.select("key", "value", "is_deleted", "ts", F.lit(level).alias("level"), F.lit(session).alias("session"))
        own.write.mode("append").partitionBy("session").parquet(f"{self.path}/rows")

    def publish(self, *sessions: str) -> None:
        self._close({s: ("waiting", "active") for s in sessions})

    def discard(self, *sessions: str) -> None:
        self._close({s: ("waiting", "discarded") for s in sessions})

    def _close(self, moves: dict[str, tuple[str, str]]) -> None:
        """Takes sessions from one state to another, all of them or, if one isn't in its first state any more, none."""

        def change(states: dict[str, str]) -> dict[str, str]:
            if wrong := [s for s, (old, _) in moves.items() if states.get(s) != old]:
                raise ValueError(f"sessions {wrong} are {[states.get(s) for s in wrong]}")
            return {s: new for s, (_, new) in moves.items()}

        self.log.commit(change)

    def states(self) -> DataFrame:
        """session and state: as many rows as there ever were sessions."""
        return self.spark.createDataFrame(sorted(self.log.state()[1].items()), STATE_SCHEMA)

    def state(self, session: str) -> str | None:
        return self.log.state()[1].get(session)

    def rows(self) -> DataFrame:
        """The rows of waiting and active sessions, with their visibility; other sessions' partitions aren't read."""
        inferred = self.spark.read.parquet(f"{self.path}/rows").schema
        named = T.StructType([T.StructField("session", T.StringType()) if f.name == "session" else f for f in inferred])  # 007 isn't 7
        found = self.spark.read.schema(named).parquet(f"{self.path}/rows")
        live = self.states().where(F.col("state").isin("waiting", "active")).select("session", (F.col("state") == "active").alias("visible"))
        return found.join(live, "session")

    def view(self, session: str | None = None) -> DataFrame:
        """key and value as anybody sees them, or as a session does, with its own rows on top."""
        return layers.view(self.rows(), session)

    def compact(self) -> str:
        """All active sessions as one base session; waiting ones stay as they are. The name of the base. If another
        compaction retires one of them meanwhile, this one is refused, and its base is discarded."""
        merged = [s for s, state in self.log.state()[1].items() if state == "active"]  # names of sessions, not rows
        base = self.begin(f"base-{uuid.uuid4().hex}")
        seen = self.rows().where(F.col("session").isin(merged))
        top = seen.groupBy("key").agg(F.max_by(F.struct("value", "is_deleted", "ts"), F.struct("level", "ts")).alias("top")).select("key", "top.*").where("NOT is_deleted")
        self.write(top, base, level=0)
        try:
            self._close({s: ("active", "retired") for s in merged} | {base: ("waiting", "active")})
        except ValueError:
            self.discard(base)
            raise
        return base

    def vacuum(self, complete: bool = False) -> list[str]:
        """Deletes the rows of retired and discarded sessions, and of waiting ones if ``complete``; their names."""
        if complete:
            self.log.commit(lambda states: {s: "discarded" for s, state in states.items() if state == "waiting"} or None)
        names = sorted(s for s, state in self.log.state()[1].items() if state in ("retired", "discarded"))
        return [s for s in names if folders.remove(self.spark, f"{self.path}/rows/session={s}")]
