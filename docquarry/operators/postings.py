"""A stored index of words with their places, kept up to date by small additions.

Segments are Parquet tables of (word, id, positions). A change writes one segment with the postings of the documents
that it brings, and a table of all ids that it replaces or removes; nothing older is touched. Its postings stay where the
texts are: files of runs that are sorted by words, so that a scan for a prefix reads a few pages of each run. Readers
merge: a posting counts unless a later change names its id. Compaction rewrites a range of words, of all segments, as
one new segment in ranges of words, and takes the range away from the older ones; what has no range left is deleted by
``vacuum``.

Which segments there are stands in a numbered log, so a build that dies half-way leaves nothing that is read, and of two
compactions of one range the second is refused. Words and their beginnings are those of ``functions.text``; the tests of
prefixes reach the scans. A text's words are grouped in Arrow batches, as Spark's own expressions would need a row for
each token or pass through a text once for each word.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as words
from ..sources import folders
from ..sources.log import Log

#: A range of words: from the first on, up to but without the second (None: to the end).
Range = tuple[str, str | None]
EVERYTHING: Range = ("", None)
#: Bytes of text that a task looks at in one go, those that make a sorted run, the postings of a page of a segment (a
#: page is what a scan can leave out), and which bytes of a text are in tokens.
SLICE_BYTES, RUN_BYTES, PAGE_ROWS = 1 << 20, 1 << 22, 4096
#: Letters beyond ASCII whose small form is within it (a Kelvin sign, and an I with a dot, which is kept apart).
_LOWERED = {"\u212a": "k", "\u0130": "i\u0307"}
_IN_TOKENS = np.isin(np.arange(256), np.frombuffer(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_", np.uint8))
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)


def without(own: list[Range], gone: Range) -> list[Range]:
    """Ranges less one range.

    >>> without([("a", "m"), ("p", None)], ("k", "q"))
    [('a', 'k'), ('q', None)]
    """
    out = []
    for low, high in own:
        ends = [x for x in (high, gone[0]) if x is not None]
        if low < min(ends):
            out.append((low, min(ends)))
        start = None if gone[1] is None else max(low, gone[1])
        if start is not None and (high is None or start < high):
            out.append((start, high))
    return out


def _inside(ranges: list[Range]) -> Column:
    tests = [(F.col("word") >= low) & (F.lit(True) if high is None else F.col("word") < high) for low, high in ranges]
    return reduce(Column.__or__, tests)


def _with_prefixes(tokens: list[str]) -> Column:
    return reduce(Column.__or__, (F.startswith("word", F.lit(t)) for t in tokens))


def _slices(batches: Iterable[pa.RecordBatch], size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """(id, text) in batches of at most ``size`` bytes of text, or of one row."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + size, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def _grouped(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(word, id, positions) of texts by word, as ``functions.text`` has tokens and words: all at once, on their bytes."""
    texts = pc.fill_null(batch.column(1).cast(pa.large_binary()), b"")
    for letter, small in _LOWERED.items():
        if pc.any(pc.match_substring(texts, letter)).as_py():
            texts = pc.replace_substring(texts, letter, small)
    _, places, content = texts.buffers()
    offsets = np.frombuffer(places, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(content or b"", np.uint8)[offsets[0] : offsets[-1]]
    first = offsets[:-1][np.diff(offsets) > 0] - offsets[0]  # of each text that has any
    inside = _IN_TOKENS[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[first] = inside[first]
    ends[:-1] &= ~inside[1:]
    ends[first[1:] - 1] = inside[first[1:] - 1]
    starts = np.flatnonzero(begins)
    lengths = np.minimum(np.flatnonzero(ends) + 1 - starts, words.TOKEN_LENGTH)
    row = np.searchsorted(offsets[1:] - offsets[0], starts, "right")
    position = np.arange(len(starts)) - np.searchsorted(starts, offsets[:-1] - offsets[0])[row]
    long = lengths >= words.WORD_LENGTH
    starts, lengths, row, position = starts[long], lengths[long], row[long], position[long]
    cuts = np.append(0, np.cumsum(lengths))
    letters = _LOWER[data[np.repeat(starts - cuts[:-1], lengths) + np.arange(cuts[-1])]]
    found = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(cuts), pa.py_buffer(letters)).dictionary_encode()
    by_word = pc.array_sort_indices(found.dictionary).to_numpy()
    rank = np.empty(len(by_word), np.int64)
    rank[by_word] = np.arange(len(by_word))
    order = np.sort(rank[found.indices.to_numpy()] << 32 | np.arange(len(starts)))  # a word's texts and positions stay in order
    rank, order = order >> 32, order & 0xFFFFFFFF
    row = row[order]
    heads = np.flatnonzero(np.append(True, (rank[1:] != rank[:-1]) | (row[1:] != row[:-1]))) if len(order) else order
    lists = pa.ListArray.from_arrays(pa.array(np.append(heads, len(order)), pa.int32()), pa.array(position[order], pa.int32()))
    own = found.dictionary.take(pa.array(by_word[rank[heads]])).cast(pa.string())
    return pa.RecordBatch.from_arrays([own, batch.column(0).take(pa.array(row[heads])), lists], names=["word", "id", "positions"])


def postings_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(word, id, positions) of all words, in runs by word. A text's words are grouped where the text is, and stay there;
    only if ids are repeated, texts of the same id are put together after that, each task's in one run."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([T.StructField("word", T.StringType()), own.schema["id"], T.StructField("positions", T.ArrayType(T.IntegerType(), False))])
    found = own.mapInArrow(lambda batches: map(_grouped, _slices(batches, RUN_BYTES)), schema)
    if own.groupBy("id").count().where("count > 1").isEmpty():
        return found
    together = found.groupBy("word", "id").agg(F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"))
    return together.sortWithinPartitions("word", "id")


@dataclass(frozen=True)
class PostingIndex:
    spark: SparkSession
    path: str

    @property
    def log(self) -> Log:
        """State: segments by name, each with its number, its ranges, and whether it has postings and a table of ids."""

        def fold(state: dict, entry: dict) -> dict:
            return {name: own for name, own in (state | entry).items() if own is not None}

        return Log(self.spark, f"{self.path}/log", fold)

    def segments(self) -> dict[str, dict]:
        return self.log.state()[1]

    def built(self) -> bool:
        return bool(self.segments())

    # -- changes -------------------------------------------------------------------------------------------

    def add(self, docs: DataFrame, id_col: str, text_col: str) -> str:
        """Indexes documents; of those that are indexed already, the old postings go. The name of the segment."""
        name = uuid.uuid4().hex
        self._write(postings_of(docs, id_col, text_col), name)
        replaced = docs.select(F.col(id_col).alias("id")) if self.built() else None
        return self._close(name, replaced, True)

    def remove(self, ids: DataFrame) -> str:
        """Takes documents out of the index: only their ids are written."""
        return self._close(uuid.uuid4().hex, ids.select(F.col(ids.columns[0]).alias("id")), False)

    def _write(self, rows: DataFrame, name: str) -> None:
        rows.write.option("parquet.page.row.count.limit", PAGE_ROWS).parquet(f"{self.path}/{name}/postings")

    def _close(self, name: str, ids: DataFrame | None, postings: bool) -> str:
        if ids is not None:
            ids.where("id IS NOT NULL").distinct().write.parquet(f"{self.path}/{name}/ids")

        def change(state: dict) -> dict:
            if ids is None and state:
                raise ValueError("the index was built meanwhile")
            number = max((s["number"] for s in state.values()), default=0) + 1
            return {name: {"number": number, "ranges": [EVERYTHING] * postings, "ids": ids is not None}}

        self.log.commit(change)
        return name

    # -- reading -------------------------------------------------------------------------------------------

    def postings(self, test: Column | None = None, of: dict[str, dict] | None = None) -> DataFrame:
        """(word, id, positions) of the words that pass a test, as they are after all changes."""
        state = self.segments() if of is None else of
        parts, gone = [], []
        for name, own in state.items():
            if own["ranges"]:
                rows = self.spark.read.parquet(f"{self.path}/{name}/postings")
                rows = rows if [tuple(r) for r in own["ranges"]] == [EVERYTHING] else rows.where(_inside(own["ranges"]))
                parts.append((rows if test is None else rows.where(test)).withColumn("__n", F.lit(own["number"])))
            if own["ids"]:
                gone.append(self.spark.read.parquet(f"{self.path}/{name}/ids").withColumn("__last", F.lit(own["number"])))
        if not parts:
            raise ValueError(f"no index at {self.path}")
        rows = reduce(DataFrame.unionByName, parts)
        if not gone or max(s["number"] for s in state.values() if s["ids"]) <= min(s["number"] for s in state.values() if s["ranges"]):
            return rows.drop("__n")
        last = reduce(DataFrame.unionByName, gone).groupBy("id").agg(F.max("__last").alias("__last"))
        return rows.join(last, "id", "left").where(F.coalesce(F.col("__n") >= F.col("__last"), F.lit(True))).select("word", "id", "positions")

    def ids_with(self, query: str) -> DataFrame:
        """Ids that have, for every token of the query, a word beginning with it."""
        tokens = sorted(set(words.query_tokens(query)))
        bits = reduce(Column.bitwiseOR, (F.when(F.startswith("word", F.lit(t)), 1 << k).otherwise(0) for k, t in enumerate(tokens)))
        found = self.postings(_with_prefixes(tokens)).groupBy("id").agg(F.bit_or(bits).alias("__bits"))
        return found.where(F.col("__bits") == (1 << len(tokens)) - 1).select("id")

    def ids_near(self, query: list[str], limit: int = 2) -> DataFrame:
        """Ids whose texts have the query's words one after the other with at most ``limit`` tokens between neighbours:
        the places of the query's words alone are brought together, and passed through once for each id."""
        tokens = [t for q in query for t in words.query_tokens(q)]
        fits = F.array(*(F.startswith("word", F.lit(t)) for t in tokens))
        places = F.transform("positions", lambda p: F.struct(p.alias("i"), fits.alias("fits")))
        own = self.postings(_with_prefixes(tokens)).select("id", places.alias("places"), fits.alias("fits"))
        every = reduce(Column.__and__, (F.bool_or(F.col("fits")[k]) for k in range(len(tokens))))
        together = own.groupBy("id").agg(F.array_sort(F.flatten(F.collect_list("places"))).alias("places"), every.alias("every")).where("every")
        never = F.array(*[F.lit(-(limit + 2))] * len(tokens))

        def step(ends: Column, x: Column) -> Column:
            reached = [x["fits"][0]] + [x["fits"][k] & (ends[k - 1] >= 0) & (x["i"] - ends[k - 1] <= limit + 1) for k in range(1, len(tokens))]
            return F.array(*(F.when(r, x["i"]).otherwise(ends[k]) for k, r in enumerate(reached)))

        return together.where(F.aggregate("places", never, step, lambda ends: ends[len(tokens) - 1] >= 0)).select("id")

    def ids_phrase(self, phrase: str) -> DataFrame:
        """Ids whose texts have the phrase's words next to each other."""
        return self.ids_near([phrase], 0)

    # -- upkeep --------------------------------------------------------------------------------------------

    def compact(self, low: str = "", high: str | None = None) -> str:
        """The words of a range, of all segments, as one new segment. Changes that come meanwhile stay as they are."""
        before, own = self.segments(), (low, high)
        name, number = uuid.uuid4().hex, max(s["number"] for s in before.values())
        rows = self.postings(_inside([own]), before)
        self._write(rows.repartitionByRange("word", "id").sortWithinPartitions("word", "id"), name)

        def change(state: dict) -> dict:
            if any(state.get(n, {}).get("ranges") != s["ranges"] for n, s in before.items()):
                raise ValueError("the segments were compacted meanwhile")
            left = {n: state[n] | {"ranges": without([tuple(r) for r in s["ranges"]], own)} for n, s in before.items()}
            return left | {name: {"number": number, "ranges": [own], "ids": False}}

        self.log.commit(change)
        return name

    def vacuum(self) -> list[str]:
        """Deletes segments without a range whose ids no older posting needs any more; their names."""

        def useless(state: dict) -> list[str]:
            oldest = min((s["number"] for s in state.values() if s["ranges"]), default=0)
            return [n for n, s in state.items() if not s["ranges"] and (not s["ids"] or s["number"] <= oldest)]

        names: list[str] = []

        def change(state: dict) -> dict | None:
            names[:] = useless(state)
            return dict.fromkeys(names) or None

        self.log.commit(change)
        for n in names:
            folders.remove(self.spark, f"{self.path}/{n}")
        return sorted(names)
