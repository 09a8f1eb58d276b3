"""Line deduplication by content-defined chunks of lines.

*Lines.* A text is cut at its line ends and after its sentences, and long sentences are folded where the hash of the
eight bytes before a word is largest among FOLD words to both sides (characters of three bytes and more, as of Chinese,
count as words). Only what stands in the sentence itself decides, so lines move with the content. Blank lines belong to
the line before.

*Chunks.* From each line on, the fewest lines, two at least, that hold CHUNK_WORDS words are a chunk, and so are the fewest
that end with each line; and two whole lines of the text that follow each other are one whatever their words. Choosing
among the lines where chunks begin, as is usual, would lose passages of few lines, whose neighbours differ from document
to document; so what a rolling hash chooses here are the lines' own ends, and every line begins a chunk and ends one.

*Repeats.* Hashes of chunks are counted over the whole corpus. Chunks of the hashes that occur again are brought
together with their bytes, which are compared with those of the occurrence that stays (in the document with the
smallest id, at the smallest place); equal ones go. So a passage of two lines or more that repeats goes from its first
line to its last, wherever it stands, if it has CHUNK_WORDS words or consists of whole lines, and every line that goes
stays at its smallest place. A whole text is a chunk besides, whatever its size, compared by SHA-256: of exact copies
nothing is left. What stays is a single line between lines that don't repeat, a few short sentences inside a paragraph
("He nodded. She left."), and what stands on a line together with other words.

*Scale.* The count shuffles hashes alone. Which hashes repeat is broadcast as a table of bits of bounded size (``common.bits_of``), which
only ever says "maybe": where it is full, more chunks travel, and the result is the same. Hashes with more than one in
HOT of all occurrences, HOT at most, are salted, so that no task holds a frequent chunk's rows. Texts that may lose something,
by another such table, travel once, to meet the stretches that are cut from them; all others stay where they are.

Rows: null and empty texts, and those of white space, come back as they are; rows with the same id and text are the same
document and get the same result; rows without an id come after all others; what a document repeats itself stays once,
also where the repeats follow one another (of three equal lines in a row or more one stays); all columns come back, whatever
their names.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .hashing import U, hash_spans, mix

#: Words to both sides of a fold, and those that a chunk needs unless it is two whole lines.
FOLD, CHUNK_WORDS = 4, 10
#: Bits for each repeated hash, and those that are looked at.
BITS, PROBES = 16, 2
#: A hash with more than one in so many occurrences is hot.
HOT = 4096
#: Chunks of more bytes, which only lines without any place for a fold make, are compared by SHA-256.
LONGEST = 1024
_LAST_ID = (1 << 63) - 1
_NEXT = U(0xD6E8FEB86659FD93)
#: Hashes of whole texts are told apart from those of chunks.
_WHOLE = U(0x5851F42D4C957F2D)

_STOP = np.zeros(256, bool)
_STOP[[33, 46, 63]] = True
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


@dataclass
class Lines:
    """The lines of some texts, one after the other, and the chunks that begin at them."""

    data: np.ndarray  # the texts' bytes, joined
    base: np.ndarray  # where each text begins in them
    owner: np.ndarray  # the text of each line
    start: np.ndarray
    end: np.ndarray  # without white space
    after: np.ndarray  # with it: where the next line begins
    first: np.ndarray  # the first and the last line of each chunk
    last: np.ndarray
    hash: np.ndarray  # of the chunks

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        """The texts that have lines, and their hashes."""
        first = np.flatnonzero(np.append(True, self.owner[1:] != self.owner[:-1])) if len(self.owner) else np.empty(0, np.int64)
        last = np.append(first[1:], len(self.owner)) - 1
        owner = self.owner[first]
        return owner, mix(hash_spans(self.data, self.base[owner], self.end[last]) ^ _WHOLE) if len(first) else np.empty(0, U)


def _folds(data: np.ndarray, word: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Starts of words whose hash is the largest among FOLD words to both sides, all between the same edges."""
    at, edges = np.flatnonzero(word), np.flatnonzero(edge)
    stretch = np.cumsum(edge, dtype=np.int32)[at] - 1
    # the eight bytes before each, as one number, without those that don't belong to the stretch
    padded = np.concatenate([np.zeros(8, np.uint8), data])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))[at]
    value = mix(eight & ~U(0) << (U(8) * (U(8) - np.minimum(at - edges[stretch], 8).astype(U))))
    best = np.ones(len(at), bool)
    for d in range(1, FOLD + 1):
        same = stretch[d:] == stretch[:-d]
        best[:d] = best[len(at) - d :] = False
        best[d:] &= same & (value[d:] > value[:-d])
        best[:-d] &= same & (value[:-d] > value[d:])
    return at[best]


def lines_of(texts: list[bytes]) -> Lines:
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    stops = np.cumsum(sizes)
    base = stops - sizes
    none = np.empty(0, np.int64)
    white = _WHITE[data]
    solid = np.flatnonzero(~white)
    if not len(solid):
        return Lines(data, base, none, none, none, none, none, none, np.empty(0, U))
    edge = np.zeros(len(data) + 1, bool)
    edge[base] = edge[len(data)] = True
    edge[1:] |= data == 10
    edge[2:] |= (data[1:] == 32) & _STOP[data[:-1]] & ~edge[1:-1]
    word = ~white
    word[1:] &= white[:-1] | edge[1:-1]
    word |= data >= 0xE0
    edge[_folds(data, word & ~edge[:-1], edge)] = True
    words = np.append(0, np.cumsum(word))

    cuts = np.flatnonzero(edge)
    upto_solid = np.append(0, np.cumsum(~white, dtype=np.int32))
    start = cuts[:-1][np.diff(upto_solid[cuts]) > 0]
    owner = np.searchsorted(stops, start, side="right")
    ends_text = np.append(owner[1:] != owner[:-1], True)
    after = np.append(start[1:], len(data))
    after[ends_text] = stops[owner[ends_text]]
    end = solid[upto_solid[after] - 1] + 1

    n, place = len(start), np.arange(len(start))
    before, upto = words[start], words[end]
    on, back = place + 1, place - 1
    few = np.flatnonzero(upto[np.minimum(on, n - 1)] - before < CHUNK_WORDS)  # two lines are enough elsewhere
    on[few] = np.maximum(np.searchsorted(upto, before[few] + CHUNK_WORDS), on[few])
    few = np.flatnonzero(upto - before[np.maximum(back, 0)] < CHUNK_WORDS)
    back[few] = np.minimum(np.searchsorted(before, upto[few] - CHUNK_WORDS, side="right") - 1, back[few])
    opens = (start == base[owner]) | (data[start - 1] == 10)  # a line of the text itself begins here
    pair = np.flatnonzero(opens[:-1] & opens[1:] & (owner[1:] == owner[:-1]) & np.append(opens[2:] | (owner[2:] != owner[1:-1]), True)[: n - 1])
    inside = lambda a, b: owner[a] == owner[b]
    forward = np.flatnonzero(on < n)
    forward = forward[inside(forward, on[forward])]
    backward = np.flatnonzero(back >= 0)
    backward = backward[inside(back[backward], backward) & (on[back[backward]] != backward)]
    pair = pair[(on[pair] != pair + 1) & (back[pair + 1] != pair)]
    first, last = np.concatenate([forward, back[backward], pair]), np.concatenate([on[forward], backward, pair + 1])
    order = np.argsort(first, kind="stable")
    first, last = first[order], last[order]
    return Lines(data, base, owner, start, end, after, first, last, hash_spans(data, start[first], end[last]))


def _marked(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """``docs`` with columns named by number, and two hashes that tell documents apart."""
    names = docs.columns
    rows = docs.withColumnsRenamed({c: f"__{i}" for i, c in enumerate(names)})
    own_id = F.coalesce(F.col(f"__{names.index(doc_id)}").cast("long"), F.lit(_LAST_ID))
    own_text = F.col(f"__{names.index(text)}")
    keys = [F.xxhash64(own_id, own_text).alias("__k1"), F.xxhash64(F.lit("second"), own_text, own_id).alias("__k2")]
    return rows.select(*keys, own_id.alias("__id"), *rows.columns)


def _texts(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in common.byte_list(column)]


def repeated_hashes(rows: DataFrame, at: str) -> DataFrame:
    """hash and n of the chunks and whole texts that occur more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = lines_of(_texts(batch.column(0)))
            found = np.concatenate([lines.whole()[1], lines.hash])
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], ["hash"])

    found = common.map_slices(rows.select(at), at, run, "hash long")
    return found.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1")


#: An occurrence: its document, its hash, where it begins and where what follows it does, its bytes.
_NAMES = ["__id", "__k1", "__k2", "hash", "start", "end", "chunk"]
_OCCURRENCE = "__id long NOT NULL, __k1 long NOT NULL, __k2 long NOT NULL, hash long NOT NULL, start int NOT NULL, end int NOT NULL, chunk binary NOT NULL"


def occurrences(rows: DataFrame, at: str, bits) -> DataFrame:
    """Where chunks and whole texts that may be repeated stand, with their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _texts(batch.column(3))
            yield _occurrences(batch, texts, lines_of(texts), bits.value)

    def _occurrences(batch: pa.RecordBatch, texts: list[bytes], lines: Lines, marks: np.ndarray) -> pa.RecordBatch:
        owner, hashes = lines.whole()
        again = common.maybe(marks, hashes, PROBES)
        owner, hashes = owner[again], hashes[again]
        again = common.maybe(marks, lines.hash, PROBES)
        k, last, own_hash = lines.first[again], lines.last[again], lines.hash[again]
        mine = lines.owner[k]
        base, nothing = lines.base[mine], np.zeros(len(owner), np.int64)
        sizes = np.fromiter((len(texts[i]) for i in owner.tolist()), np.int64, len(owner))
        digest = lambda part: part if len(part) <= LONGEST else hashlib.sha256(part).digest()
        buffer = lines.data.tobytes()
        chunks = [hashlib.sha256(texts[i].rstrip(b"\t\n\v\f\r ")).digest() for i in owner.tolist()]
        chunks += [digest(buffer[a:b]) for a, b in zip(lines.start[k].tolist(), lines.end[last].tolist(), strict=True)]
        who = pa.array(np.concatenate([owner, mine]))
        columns = [
            *(batch.column(c).take(who) for c in range(3)),
            pa.array(np.concatenate([hashes, own_hash]).view(np.int64)),
            pa.array(np.concatenate([nothing, lines.start[k] - base]).astype(np.int32)),
            pa.array(np.concatenate([sizes, lines.after[last] - base]).astype(np.int32)),
            pa.array(chunks, pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, _NAMES)

    return common.map_slices(rows.select("__id", "__k1", "__k2", at), at, run, _OCCURRENCE)


def removals(found: DataFrame, hot: DataFrame) -> DataFrame:
    """__k1, __k2 and gone (stretches of bytes, start and end) of the documents that lose something.

    ``hot`` has the salts of frequent hashes. Rows of a hash and a salt are together; the first of them stays, or, of a
    salted hash, the first of all salts, whose rows (HOT at most, of bounded size) are broadcast.
    """
    dealt = found.join(F.broadcast(hot), "hash", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    dealt = dealt.withColumn("salt", F.coalesce(F.pmod(F.xxhash64("__k1", "start"), F.col("salts")).cast("int"), F.lit(0))).repartition("hash", "salt")
    # all columns take part on both sides, and none is ever null, so that both read one shuffle
    local = dealt.groupBy("hash", "salt").agg(F.min(F.struct("__id", "__k1", "__k2", "start", "end", "chunk", "salts")).alias("own"))
    over = local.where("own.salts > 1").groupBy("hash").agg(F.min("own").alias("all"))
    first = F.coalesce("all", "own")
    both = dealt.join(local, ["hash", "salt"]).join(F.broadcast(over), "hash", "left").withColumn("first", first)
    is_first = functools.reduce(Column.__and__, (F.col(c) == F.col(f"first.{c}") for c in ("__id", "__k1", "__k2", "start", "salts")))
    gone = both.where(~is_first & (F.col("chunk") == F.col("first.chunk"))).select("__k1", "__k2", F.struct("start", "end").alias("stretch"))
    return gone.groupBy("__k1", "__k2").agg(F.collect_set("stretch").alias("gone"))


def _cut(rows: DataFrame, at: str) -> DataFrame:
    """The rows without the stretches in their last column, with n_lines (before) and n_removed (stretches, as merged)."""
    number = rows.columns.index(at)
    schema = T.StructType(rows.schema.fields[:-1]).add("__n_lines", T.LongType()).add("__n_removed", T.LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = batch.column(batch.num_columns - 1)
            texts = common.byte_list(batch.column(number))
            lines = [0 if t is None else t.count(b"\n") + 1 for t in texts]
            removed = [0] * len(texts)
            for i in np.flatnonzero(np.asarray(gone.is_valid())).tolist():
                text, parts, last = texts[i], [], 0
                for a, b in sorted((s["start"], s["end"]) for s in gone[i].as_py()):
                    if a > last or not removed[i]:
                        parts.append(text[last:a])
                        removed[i] += 1
                    last = max(last, b)
                left = b"".join([*parts, text[last:]])
                texts[i] = left if text.endswith(b"\n") or last < len(text) else left.rstrip(b" \n")
            columns = [*batch.columns[:-1]]
            columns[number] = pa.array([t if t is None else t.decode() for t in texts], pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lines, pa.int64()), pa.array(removed, pa.int64())], schema.names)

    return common.map_slices(rows, at, run, schema)


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", drop_emptied: bool = False, counts: bool = False) -> DataFrame:
    """``docs`` without repeated chunks of lines.

    With ``counts``, columns n_lines (before) and n_removed (stretches) are added. With ``drop_emptied``, documents of which
    nothing but white space is left by the removal go.
    """
    names = docs.columns
    rows = _marked(docs, text, doc_id)
    at = f"__{names.index(text)}"
    repeated = common.written(repeated_hashes(rows, at))
    size = repeated.agg(F.count("*").alias("hashes"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    bits = docs.sparkSession.sparkContext.broadcast(common.bits_of(repeated, size["hashes"], BITS, PROBES))
    many = max(1000, size["rows"] // HOT + 1)
    hot = repeated.where(F.col("n") > many).select("hash", F.ceil(F.col("n") / many).cast("int").alias("salts"))
    gone = common.written(removals(occurrences(rows, at, bits), hot))
    # only texts that may lose something are shuffled, to meet what goes
    tested = common.with_maybe(rows, "__k1", gone.select(F.col("__k1").alias("hash")), gone.count(), "__maybe")
    own = F.col(at)
    n_lines = F.when(own.isNull(), 0).otherwise(F.octet_length(own) - F.octet_length(F.replace(own, F.lit("\n"), F.lit(""))) + 1).cast("long")
    same = tested.where(~F.col("__maybe")).drop("__maybe").withColumns({"__n_lines": n_lines, "__n_removed": F.lit(0).cast("long")})
    met = tested.where("__maybe").drop("__maybe").join(gone.hint("shuffle_hash"), ["__k1", "__k2"], "left").select(*rows.columns, "gone")
    out = _cut(met, at)
    if drop_emptied:
        out = out.where((F.col("__n_removed") == 0) | F.col(at).rlike(r"\S"))
    out = same.unionByName(out)
    more = [F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed")] if counts else []
    return out.select(*(F.col(f"__{i}").alias(c) for i, c in enumerate(names)), *more)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, text (what is left), text_sha256 of every row."""
    rows = docs.select("doc_id", "text")
    return dedup_lines(rows, counts=True).select("doc_id", "n_lines", "n_removed", "text", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))
