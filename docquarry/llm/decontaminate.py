"""Benchmark decontamination with a generalised suffix automaton of the benchmark's words.

The automaton holds every run of consecutive words of every item. A document's words stream through it: the
state reached and the matching length say, at each word, how long the longest run is that ends here and
stands in some item. Wherever that length reaches the window, all words of the run are hit; an item shorter
than the window counts as one window, and is found through the suffix links, as in a dictionary automaton.

Words that the benchmark lacks end every match, and so do neighbours that are no neighbours in any item, so
the stream only visits stretches of benchmark word pairs that are long enough to matter; finding those is
array work. An automaton is made of at most about BLOCK_WORDS words, so what is sent to the executors stays bounded however
long the benchmark is. A longer benchmark is dealt into blocks by the hashes of its items, of which longer ones are cut
into parts that overlap by a window. Then one pass over the documents writes their stretches of word pairs of any block
(by a table of bits of bounded size); a join on the pairs themselves tells which blocks a stretch can have a window of,
and it meets these blocks' automata, all in one job whatever their number. Blocks with many stretches are copied.

Rows: null and wordless texts have no words and are clean; repeated documents or items repeat or coincide;
null item ids are left out of the id list but their windows still count as hits; other columns are kept, but for
those that ``find_hits`` names itself, which it replaces.
"""

from __future__ import annotations

import functools
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .hashing import U, chain, hash_spans, mix, runs

WINDOW = 10
#: Words of benchmark items in one automaton; about 400 bytes a word in each Python worker. Stretches that meet a copy of it.
BLOCK_WORDS, STRETCHES = 200_000, 500_000

SPANS = T.ArrayType(T.StructType().add("start", T.LongType()).add("end", T.LongType()))

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: A-Z becomes a-z; ASCII other than letters and digits becomes a space; all other bytes are kept.
TO_WORDS = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in _LOWER)


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(TO_WORDS).split() if text else []


@dataclass
class Automaton:
    """Generalised suffix automaton over word numbers."""

    window: int = WINDOW
    next: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    own: dict[int, set[int]] = field(default_factory=dict)  # items in which a state's runs end, before spreading

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:  # another item has this run
            q = self.next[last][word]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, word)
        state = self._state({}, 0, self.length[last] + 1)
        while last >= 0 and word not in self.next[last]:
            self.next[last][word] = state
            last = self.link[last]
        if last >= 0:
            q = self.next[last][word]
            self.link[state] = q if self.length[q] == self.length[last] + 1 else self._split(last, q, word)
        return state

    def _state(self, after: dict[int, int], link: int, length: int) -> int:
        self.next.append(after)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, p: int, q: int, word: int) -> int:
        """A state for the shorter runs of q."""
        copy = self._state(dict(self.next[q]), self.link[q], self.length[p] + 1)
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def add(self, item: int, words: list[int]) -> None:
        state = 0
        for w in words:
            state = self._extend(state, w)

    def finish(self, items: list[list[int]]) -> None:
        """Which items a state's runs stand in, for the states where a window or a short item ends."""
        self.short: dict[int, int] = {}  # state -> length of the short item that is its longest run
        self.items: dict[int, set[int]] = {}
        n = len(self.length)
        ends: list[tuple[int, int]] = []
        for item, words in enumerate(items):
            state = 0
            for w in words:
                state = self.next[state][w]
                if len(words) >= self.window:
                    ends.append((state, item))
            if 0 < len(words) < self.window:
                self.short[state] = len(words)
                self.items.setdefault(state, set()).add(item)
        # the state that holds the window ending where a state's runs end
        self.anchor = [-1] * n
        self.shorter = [-1] * n  # nearest state up the links, itself included, that is a short item
        for s in sorted(range(n), key=self.length.__getitem__):
            up = self.link[s]
            if self.length[s] >= self.window:
                self.anchor[s] = s if up < 0 or self.length[up] < self.window else self.anchor[up]
            self.shorter[s] = s if s in self.short else (self.shorter[up] if up >= 0 else -1)
        for state, item in ends:  # a state on an item's path stands for all longer runs that end there
            if (a := self.anchor[state]) >= 0:
                self.items.setdefault(a, set()).add(item)


class Block:
    """A block of items, ready to be matched with documents."""

    def __init__(self, texts: list[bytes | None], window: int):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.items = [[self.ids.setdefault(w, len(self.ids) + 1) for w in words_of(t)] for t in texts]
        self.automaton = Automaton(window)
        for i, words in enumerate(self.items):
            self.automaton.add(i, words)
        self.automaton.finish(self.items)
        self.radix = len(self.ids) + 1
        pairs = {a * self.radix + b for words in self.items for a, b in zip(words, words[1:], strict=False)}
        self.pairs = np.array(sorted(pairs), np.int64)
        self.filter = np.zeros(1 << 20, bool)
        self.filter[self._slot(self.pairs)] = True
        lengths = [min(window, len(words)) for words in self.items if words]
        self.least = min(lengths, default=window)

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)

    def stretches(self, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        """Maximal [start, end) of known words whose neighbours are neighbours in some item, if long enough."""
        if len(ids) < self.least:
            return
        known = ids > 0
        joined = known[:-1] & known[1:]
        if joined.any():
            at = np.flatnonzero(joined)
            keys = ids[at] * self.radix + ids[at + 1]
            maybe = self.filter[self._slot(keys)]
            at, keys = at[maybe], keys[maybe]
            where = np.searchsorted(self.pairs, keys)
            where[where == len(self.pairs)] = 0
            joined[:] = False
            joined[at[self.pairs[where] == keys] if len(self.pairs) else at[:0]] = True
        if self.least <= 1:
            edges = np.flatnonzero(~joined) + 1
            bounds = np.concatenate([[0], edges, [len(ids)]])
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if b - a > 1 or known[a]:
                    yield a, b
            return
        turns = np.flatnonzero(np.diff(np.concatenate([[False], joined, [False]]).astype(np.int8)))
        for a, b in zip(turns[::2].tolist(), (turns[1::2] + 1).tolist(), strict=True):
            if b - a >= self.least:
                yield a, b

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit [start, end) intervals of a document's words, and the items with occurring windows."""
        get = self.ids.get
        ids = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        spans: list[tuple[int, int]] = []
        states: set[int] = set()
        m = self.automaton
        for a, b in self.stretches(ids):
            state = length = 0
            for k, w in enumerate(ids[a:b].tolist(), a):
                while state and w not in m.next[state]:
                    state = m.link[state]
                    length = m.length[state]
                if w in m.next[state]:
                    state, length = m.next[state][w], length + 1
                hit = 0
                # the runs that a state stands for are longer than those of its link
                here = state
                if length >= self.window:
                    hit = length
                    states.add(m.anchor[state])
                short = m.shorter[here]
                while short >= 0:
                    if m.short[short] <= length:
                        hit = max(hit, m.short[short])
                        states.add(short)
                    short = m.shorter[m.link[short]] if m.link[short] >= 0 else -1
                if hit:
                    spans.append((k + 1 - hit, k + 1))
        return merged(spans), set().union(*(m.items.get(s, ()) for s in states))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


#: Words as Spark counts them; the same as ``words_of`` finds.
_RUNS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: What ``find_hits`` adds.
FOUND = ["n_words", "hits", "items"]
#: Whether words were cut from a text.
CUT = "__cut"
#: Copies of what was found, for texts that very many rows have.
SALTS = 16

#: A word as the matcher counts them, for finding its characters again.
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")

_spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_matched_type = pa.schema([("__k1", pa.int64()), ("__k2", pa.int64()), ("hits", _spans_type), ("items", pa.list_(pa.string()))])


def dealt_items(benchmark: DataFrame, item_id: str, text: str, block_words: int, window: int) -> tuple[DataFrame, int, int]:
    """Different items with words as (item, text, n, block), longer ones in parts that overlap by a window; how many words
    they have, and how many blocks."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(text).cast("string").alias("text")).distinct()
    items = items.withColumn("n", F.regexp_count("text", F.lit(_RUNS))).where("n > 0")
    size = max(block_words, 2 * window)
    words = F.regexp_extract_all("text", F.lit(f"({_RUNS})"), 1)
    begins = F.sequence(F.lit(0), F.greatest(F.col("n") - window, F.lit(0)), F.lit(size - window + 1))
    parts = F.transform(F.array(words), lambda w: F.transform(begins, lambda i: F.array_join(F.slice(w, i + 1, size), " ")))[0]
    long = items.where(F.col("n") > size).select("item", F.explode(parts).alias("text")).withColumn("n", F.regexp_count("text", F.lit(_RUNS)))
    items = items.where(F.col("n") <= size).unionByName(long)
    total = items.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    count = max(1, -(-total // block_words))
    return items.withColumn("block", F.pmod(F.xxhash64("text"), F.lit(count)).cast("int")), total, count


def _sent(items: DataFrame):
    """A block's items, broadcast: about BLOCK_WORDS words."""
    rows = [(r["item"], r["text"].encode()) for r in items.select("item", "text").collect()]
    return items.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, rows))


def _block(sent, window: int) -> tuple[Block, list[str | None]]:
    mark, items = sent.value
    block = common.kept(__name__, f"{mark} {window}", lambda: Block([t for _, t in items], window))
    return block, [i for i, _ in items]


def _match(docs: DataFrame, sent, window: int, text: str) -> DataFrame:
    """``docs`` with what one block finds."""
    at = docs.columns.index(text)
    schema = T.StructType([*docs.schema]).add("n_words", "long").add("hits", SPANS).add("items", T.ArrayType(T.StringType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, labels = _block(sent, window)
        for batch in batches:
            n, hits, found = [], [], []
            for raw in common.byte_list(batch.column(at)):
                words = words_of(raw)
                spans, which = block.match(words) if words else ([], set())
                n.append(len(words))
                hits.append([{"start": a, "end": b} for a, b in spans])
                found.append(sorted({labels[i] for i in which if labels[i] is not None}))
            more = [pa.array(n, pa.int64()), pa.array(hits, _spans_type), pa.array(found, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], schema.names)

    return common.map_slices(docs, text, run, schema)


def _pairs(rows: DataFrame, *keep: str, singles: bool = False) -> DataFrame:
    """Columns to keep, and hash: of all neighbouring words of each row's last column, and of its one word, or of every
    word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, found = [np.empty(0, np.int64)], [np.empty(0, U)]
            for i, raw in enumerate(common.byte_list(batch.column(len(keep)))):
                _, words = _hashed(raw)
                own = [chain(words, 2)] * (len(words) > 1) + [mix(words ^ _ALONE)] * (singles or len(words) == 1)
                found += own
                which.append(np.full(sum(map(len, own)), i))
            where = pa.array(np.concatenate(which))
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(where) for k in range(len(keep))), pa.array(np.concatenate(found).view(np.int64))], [*keep, "hash"])

    schema = T.StructType([rows.schema[k] for k in keep]).add("hash", "long")
    return common.map_slices(rows, rows.columns[-1], run, schema)


#: Hashes of words that are an item are told apart from those of pairs.
_ALONE = U(0x5851F42D4C957F2D)


def _hashed(raw: bytes | None) -> tuple[tuple[bytes, np.ndarray, np.ndarray], np.ndarray]:
    """A text with nothing but words and spaces, where its words start and end, and their hashes."""
    plain = (raw or b"").translate(TO_WORDS)
    data = np.frombuffer(plain, np.uint8)
    starts, ends = runs(data != 32) if len(data) else (np.empty(0, np.int64),) * 2
    return (plain, starts, ends), hash_spans(data, starts, ends)


def _stretches(docs: DataFrame, text: str, bits, least: int) -> DataFrame:
    """__k1, __k2, start (a word's number) and words of the stretches of a text in which all neighbours may be neighbours in
    some item, ``least`` words long at least; with one-word items, words that may be one, too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[int, int, bytes]] = []
            for i, raw in enumerate(common.byte_list(batch.column(2))):
                (plain, starts, ends), words = _hashed(raw)
                if len(words) < least:
                    continue
                joined = np.concatenate([[False], common.maybe(bits.value, chain(words, 2)), [False]])
                turns = np.flatnonzero(joined[1:] != joined[:-1])
                spans = [(a, b + 1) for a, b in zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True) if b + 1 - a >= least]
                if least <= 1:
                    alone = np.flatnonzero(common.maybe(bits.value, mix(words ^ _ALONE)) & ~joined[1:] & ~joined[:-1])
                    spans += [(a, a + 1) for a in alone.tolist()]
                rows += [(i, a, plain[starts[a] : ends[b - 1]]) for a, b in spans]
            which, start, part = zip(*rows, strict=True) if rows else ((), (), ())
            keys = [batch.column(k).take(pa.array(which, pa.int64())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(start, pa.int64()), pa.array(part, pa.binary())], ["__k1", "__k2", "start", "words"])

    found = common.map_slices(docs.select("__k1", "__k2", text), text, run, "__k1 long, __k2 long, start long, words binary")
    return found.dropDuplicates(["__k1", "__k2", "start"])  # equal texts have equal stretches


def _in_blocks(docs: DataFrame, items: DataFrame, total: int, count: int, window: int, text: str) -> DataFrame:
    """``docs`` with what all blocks find: one pass for the stretches, one job for all blocks, and one to bring hits back."""
    rows = docs.withColumns({"__k1": F.xxhash64(text), "__k2": F.xxhash64(F.lit("second"), text)})
    own_pairs = common.written(_pairs(items.select("block", "text"), "block").distinct())
    bits = docs.sparkSession.sparkContext.broadcast(common.bits_of(own_pairs.select("hash").distinct(), total))
    least = min(window, items.agg(F.min("n")).first()[0])
    stretches = common.written(_stretches(rows, text, bits, least))
    # a block has no window of a stretch unless it has as many of its neighbours as the shortest window has
    fewest = max(1, least - 1)
    keys = ["__k1", "__k2", "start"]
    shared = _pairs(stretches.select(*keys, "words"), *keys, singles=least <= 1).join(own_pairs, "hash").groupBy(*keys, "block").agg(F.count("*").alias("n"))
    asked = common.written(stretches.join(shared.where(F.col("n") >= fewest).select(*keys, "block"), keys))
    copies = asked.groupBy("block").agg(F.ceil(F.count("*") / STRETCHES).cast("int").alias("copies"))
    copy = F.pmod(F.xxhash64(*keys), F.col("copies")).cast("int").alias("copy")
    asks = asked.join(copies, "block").select("block", copy, F.lit(True).alias("asks"), *keys, "words", F.lit(None).cast("string").alias("item"))
    none = [F.lit(0).cast("long").alias(k) for k in keys]
    sent = items.join(copies, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.lit(False).alias("asks"), *none, F.encode("text", "UTF-8").alias("words"), "item")
    dealt = sent.unionByName(asks).repartition("block", "copy").sortWithinPartitions("block", "copy", "asks")
    every = common.map_slices(dealt, "words", _matcher(window), T.StructType().add("__k1", "long").add("__k2", "long").add("hits", SPANS).add("items", T.ArrayType(T.StringType())))
    each = lambda c: F.flatten(F.collect_list(c))
    hits = every.groupBy("__k1", "__k2").agg(each("hits").alias("hits"), F.array_sort(F.array_distinct(each("items"))).alias("items"))
    salted = hits.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64(*(F.col(c) for c in docs.columns if c != text), F.lit(1)), F.lit(SALTS)).cast("int")
    both = rows.withColumn("__salt", salt).join(salted, ["__k1", "__k2", "__salt"], "left")
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    n_words = F.coalesce(F.regexp_count(text, F.lit(_RUNS)), F.lit(0)).cast("long").alias("n_words")
    return both.select(*docs.columns, n_words, none("hits", SPANS), none("items", "array<string>"))


def _matcher(window: int):
    """Of blocks' items and then the stretches that meet them: what each stretch hits, by words of its document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, items, block = None, [], None
        for batch in batches:
            out: list[dict] = []
            columns = (batch.column(c).to_pylist() for c in ("block", "copy", "asks", "__k1", "__k2", "start", "words", "item"))
            for number, copy, asks, k1, k2, start, words, item in zip(*columns, strict=True):
                if now != (number, copy):
                    now, items, block = (number, copy), [], None
                if not asks:
                    items.append((item, words))
                    continue
                block = block or Block([t for _, t in items], window)
                spans, which = block.match(words_of(words))
                if spans:
                    found = sorted({items[i][0] for i in which if items[i][0] is not None})
                    out.append({"__k1": k1, "__k2": k2, "hits": [{"start": a + start, "end": b + start} for a, b in spans], "items": found})
            yield pa.RecordBatch.from_pylist(out, _matched_type)

    return run


def _found(docs: DataFrame, benchmark: DataFrame, window: int, text: str, item_id: str, item_text: str, block_words: int) -> DataFrame:
    items, total, count = dealt_items(benchmark, item_id, item_text, block_words, window)
    return _match(docs, _sent(items), window, text) if count == 1 else _in_blocks(docs, common.written(items), total, count, window, text)


def _numbered(docs: DataFrame) -> DataFrame:
    return docs.withColumnsRenamed({c: f"__{i}" for i, c in enumerate(docs.columns)})


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", item_id: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with n_words, hits ([start, end) word spans in order, which blocks may find more than once) and items (sorted ids
    of items with occurring windows)."""
    names = docs.columns
    found = _found(_numbered(docs), benchmark, window, f"__{names.index(text)}", item_id, item_text, block_words)
    return found.select(*(F.col(f"__{i}").alias(c) for i, c in enumerate(names) if c not in FOUND), "n_words", F.array_sort("hits").alias("hits"), "items")


def _cut(found: DataFrame, text: str, most: float, sent, window: int) -> DataFrame:
    """The rows whose hit words are at most a share of all, with hit spans cut from their texts, and CUT. What was found is in
    the last columns; or, given the one block there is, texts are matched here, again until a cut brings no window together."""
    width = len(found.columns) - (0 if sent else len(FOUND))
    schema = T.StructType(found.schema.fields[:width]).add(CUT, "boolean")
    at = found.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = common.byte_list(batch.column(at))
            if sent:
                block = _block(sent, window)[0]
                words = [words_of(t) for t in texts]
                hits, n = [block.match(w)[0] for w in words], [*map(len, words)]
            else:
                hits = [merged([(h["start"], h["end"]) for h in own]) for own in batch.column(width + 1).to_pylist()]
                n = batch.column(width).to_pylist()
            keep = [sum(b - a for a, b in spans) <= most * k for spans, k in zip(hits, n, strict=True)]
            for i, spans in enumerate(hits):
                while spans and keep[i]:
                    texts[i] = _without(texts[i], spans)
                    spans = block.match(words_of(texts[i]))[0] if sent else []
            columns = [*batch.columns[:width], pa.array([bool(spans) for spans in hits], pa.bool_())]
            columns[at] = pa.array([t if t is None else t.decode() for t in texts], pa.string())
            yield pa.RecordBatch.from_arrays(columns, schema.names).filter(pa.array(keep, pa.bool_()))

    return common.map_slices(found, text, run, schema)


def _without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without spans of words, each from its first word's first byte to its last word's last."""
    places = [m.span() for m in WORD.finditer(text)]
    last, parts = 0, []
    for a, b in spans:
        parts.append(text[last : places[a][0]])
        last = places[b - 1][1]
    return b"".join([*parts, text[last:]])


def report(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row."""
    found = find_hits(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias(common.TEXT)), benchmark, text=common.TEXT)
    return found.select(
        "doc_id",
        "n_words",
        _covered("hits").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def _covered(hits: str):
    """Words in the union of spans."""
    step = lambda acc, x: F.struct(
        (acc["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(acc["to"], x["start"]))).alias("n"), F.greatest(acc["to"], x["end"]).alias("to")
    )
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))
    return F.aggregate(F.array_sort(F.col(hits)), zero, step, lambda acc: acc["n"])


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = 0.5, text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` without the hit spans of their texts; documents hit in more than ``max_coverage`` of their words go.

    A span is removed from its first word's first byte to its last word's last byte. Clean rows come back as they are.
    """
    names = docs.columns
    rows, at = _numbered(docs), f"__{names.index(text)}"
    items, total, count = dealt_items(benchmark, "item_id", "text", block_words, window)
    if count == 1:
        sent = _sent(items)
        clean = _cut(rows, at, max_coverage, sent, window)
    else:
        items = common.written(items)
        parts, most = [], max_coverage
        while not parts or not rows.isEmpty():  # a cut may bring together a window of any block
            cut = common.written(_cut(_in_blocks(rows, items, total, count, window, at), at, most, None, window))
            parts.append(cut.where(~F.col(CUT)))
            rows, most = cut.where(CUT).drop(CUT), 1.0
        clean = functools.reduce(DataFrame.unionByName, parts)
    return clean.select(*(F.col(f"__{i}").alias(c) for i, c in enumerate(names)))
