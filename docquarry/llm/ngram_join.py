"""Similarity join on word shingles by T-occurrence search, and the groups that its links make.

Two texts are similar when their sets of word shingles overlap enough for a Jaccard similarity of ``percent``
hundredths. Equal sets are one class from the start, so copies never meet each other.

The lists of an inverted index hold the classes with a shingle. Over the corpus, shingles are ordered by how many
documents have them (counted in a table of fixed size), and the first few of a class, its shortest lists, must
meet those of any similar class: joins of the lists with filters on sizes and places give candidates. The first
shingle that two similar sets share can't stand far back in either, as all that they share follows it; so of a template
with many pages that differ just too much, no list is early enough in any page, and nothing is compared. Lists of up
to SHORT_LIST classes are joined with themselves. Longer ones first meet two of their members each; classes that
are still in different groups afterwards meet in a second round, the smaller side against the rest of the list, but
only where sizes and places of the list's members (summed up by levels of size) let a set be similar.

Candidates are searched as DivideSkip does. Their classes are dealt into blocks, each with an inverted index of
its own, and a class goes as a query to the blocks where it has candidates; a block with many queries is copied, so that no
task has more than about QUERIES of them. There a query's longest lists are set
aside, the others are merged with a heap (or, from MERGED_AS_ARRAY entries on, by sorting them as one array, which counts the
same occurrences, as Python's heap takes a microsecond an entry and longer), and classes with enough of them are looked up in the long lists by
binary search. Those that reach the required overlap are links.

A shingle is known by 48 bits of its hash when two sets are compared, and a set by 128 bits. Rows: null and
wordless texts have the empty set and are linked with nothing; texts shorter than a shingle have one shingle of
all words; rows without an id are in no group (their component is null); rows with one id count as one document;
other columns are left alone.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .hashing import U, chain, hash_spans, mix, runs

#: The table of counts has 2 ** COUNT_BITS places, the one that marks needed classes 2 ** MARK_BITS bits.
COUNT_BITS, MARK_BITS = 20, 24
BLOCK = 1024
#: Lists up to this length are joined with themselves.
SHORT_LIST = 32
#: Classes in a block of the search, and queries that meet one copy of it.
BLOCK_CLASSES, QUERIES = 100, 20_000
#: Shingles in a block of the second round, and queries that meet one copy of it: larger blocks, as a query of a long list
#: goes to nearly all of them, and travels once for each.
SECOND_SHINGLES, SECOND_QUERIES = 600_000, 5_000
#: Sizes of sets are summed up by levels, so many to a factor of e.
SIZE_LEVELS = 50
#: How much a probe of a long list costs, compared with a step of the heap (the method's own constant).
PROBE_COST = 0.0085
#: Short lists with so many entries in all are merged by sorting them as one array, not by a heap.
MERGED_AS_ARRAY = 500

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    data = np.frombuffer(b" ".join(texts), np.uint8)
    ends_of = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    starts, ends = runs(~_SPACE[data]) if len(data) else (np.empty(0, np.int64),) * 2
    words = hash_spans(_LOWER[data], starts, ends)
    owner = np.searchsorted(ends_of, starts, side="right")
    counts = np.bincount(owner, minlength=len(texts))
    after = np.cumsum(counts)
    grams = chain(words, size)
    out = []
    for n, e in zip(counts.tolist(), after.tolist(), strict=True):
        if n >= size:
            out.append(np.unique(grams[e - n : e - size + 1]))
        elif n:
            out.append(mix(chain(words[e - n : e], n) + U(n)))
        else:
            out.append(np.empty(0, U))
    return out


def least_overlap(m, n, percent: int):
    """The intersection that sets of m and n shingles need."""
    return -(-(percent * (m + n)) // (100 + percent))


def list_counts(docs: DataFrame, size: int, text: str) -> np.ndarray:
    """How many documents have the shingles of each place, on a scale of eighths of a power of two, as one byte each."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << COUNT_BITS, np.uint32)
        for batch in batches:
            sets = shingle_sets([t or b"" for t in common.byte_list(batch.column(0))], size)
            table += np.bincount((np.concatenate(sets) >> U(64 - COUNT_BITS)).astype(np.int64), minlength=1 << COUNT_BITS).astype(np.uint32)
        if table.any():
            parts = table.reshape(-1, BLOCK)
            yield pa.RecordBatch.from_pydict({"block": np.arange(len(parts), dtype=np.int32), "counts": [p.tobytes() for p in parts]})

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = sums.setdefault(block, np.zeros(BLOCK, np.uint64))
                own += np.frombuffer(counts, np.uint32)
        if sums:
            scaled = [np.minimum(8 * np.log2(s + 1.0), 255).astype(np.uint8).tobytes() for s in sums.values()]
            yield pa.RecordBatch.from_pydict({"block": np.array([*sums], np.int32), "counts": scaled})

    schema = "block int, counts binary"
    partial = common.map_slices(docs.select(text), text, count, schema)
    levels = np.zeros((1 << COUNT_BITS) // BLOCK * BLOCK, np.uint8).reshape(-1, BLOCK)
    for row in partial.repartition("block").mapInArrow(total, schema).collect():  # of fixed size
        levels[row["block"]] = np.frombuffer(row["counts"], np.uint8)
    return levels.ravel()


def profiles(docs: DataFrame, size: int, percent: int, text: str, doc_id: str) -> DataFrame:
    """id, n (set size), set_hash (null for the empty set) and first (its rarest shingles, in order) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(list_counts(docs, size, text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = sent.value
        for batch in batches:
            sets = shingle_sets([t or b"" for t in common.byte_list(batch.column(1))], size)
            hashes, firsts = [], []
            for s in sets:
                if not len(s):
                    hashes.append(None)
                    firsts.append([])
                    continue
                hashes.append(np.array([mix(s + U(1)).sum(dtype=U), mix(s ^ U(0x5851F42D4C957F2D)).sum(dtype=U)]).tobytes())
                k = len(s) - -(-percent * len(s) // 100) + 1
                level = levels[(s >> U(64 - COUNT_BITS)).astype(np.int64)]
                order = np.argsort(level, kind="stable")[:k]  # ties stand in the order of hashes
                firsts.append(s[order].view(np.int64))
            n = pa.array(list(map(len, sets)), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n, pa.array(hashes, pa.binary()), pa.array(firsts, pa.list_(pa.int64()))], ["id", "n", "set_hash", "first"])

    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias(common.TEXT))
    return common.map_slices(rows, common.TEXT, run, "id long, n long, set_hash binary, first array<long>")


def marks_of(ids: DataFrame) -> np.ndarray:
    """A bit for each id's place: fixed in size, so it only ever says "maybe"."""
    place = F.pmod(F.xxhash64("id"), F.lit(1 << MARK_BITS))
    words = ids.select(F.shiftright(place, 5).alias("word"), F.pow(F.lit(2.0), place % 32).cast("long").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    marks = np.zeros(1 << (MARK_BITS - 5), np.uint32)
    found = words.toArrow()  # at most 2 ** 19 rows
    marks[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return marks


def sets_of(docs: DataFrame, needed: DataFrame, size: int, text: str, doc_id: str) -> DataFrame:
    """id and members (48 bits of each sorted hash) of documents; of all that are needed and few others."""
    sent = docs.sparkSession.sparkContext.broadcast(marks_of(needed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = sent.value
        for batch in batches:
            place = batch.column(1).to_numpy()
            maybe = np.flatnonzero(marks[place >> 5] >> (place & 31).astype(np.uint32) & np.uint32(1))
            if len(maybe):
                batch = batch.take(pa.array(maybe))
                sets = shingle_sets([t or b"" for t in common.byte_list(batch.column(2))], size)
                packed = [s.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes() for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["id", "members"])

    own = F.col(doc_id).cast("long")
    rows = docs.where(own.isNotNull()).select(own.alias("id"), F.pmod(F.xxhash64(own), F.lit(1 << MARK_BITS)).alias("place"), F.col(text).alias(common.TEXT))
    return common.map_slices(rows, common.TEXT, run, "id long, members binary")


def unpack(members: bytes) -> np.ndarray:
    wide = np.zeros((len(members) // 6, 8), np.uint8)
    wide[:, 2:] = np.frombuffer(members, np.uint8).reshape(-1, 6)
    return wide.view("<u8").ravel()


class Index:
    """An inverted index of some sets, searched as DivideSkip does."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.sets, self.percent = sets, percent
        self.sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        shingles, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(shingles, kind="stable")
        self.shingles, self.owner = shingles[order], owner[order]

    def search(self, query: np.ndarray) -> list[int]:
        """Numbers of the sets that overlap enough with the query."""
        lists = np.searchsorted(self.shingles, query), np.searchsorted(self.shingles, query, side="right")
        lengths = lists[1] - lists[0]
        least = -(-self.percent * len(query) // 100)
        there = np.flatnonzero(lengths)
        if len(there) < least or not least:
            return []
        there = there[np.argsort(lengths[there], kind="stable")]
        longest = int(lengths[there[-1]])
        aside = min(least - 1, int(least / (PROBE_COST * math.log2(longest + 1) + 1)))
        short, long = there[: len(there) - aside], query[there[len(there) - aside :]]
        merged = [self.owner[a:b] for a, b in zip(lists[0][short].tolist(), lists[1][short].tolist(), strict=True)]
        if int(lengths[short].sum()) < MERGED_AS_ARRAY:
            counts = _run_lengths(heapq.merge(*(m.tolist() for m in merged)))
        else:
            counts = zip(*(x.tolist() for x in np.unique(np.concatenate(merged), return_counts=True)), strict=True)
        out = []
        for found, n in counts:
            if n < least - aside:
                continue
            own = self.sets[found]
            if len(own) * 100 < self.percent * len(query) or len(query) * 100 < self.percent * len(own):
                continue
            if len(long):
                at = np.searchsorted(own, long)
                at[at == len(own)] = 0
                n += int(np.count_nonzero(own[at] == long))
            if n >= least_overlap(len(query), len(own), self.percent):
                out.append(found)
        return out


def _run_lengths(numbers: Iterator[int]) -> Iterator[tuple[int, int]]:
    last, n = -1, 0
    for x in numbers:
        if x != last:
            if n:
                yield last, n
            last, n = x, 0
        n += 1
    if n:
        yield last, n


def block_of(column: str, blocks: int):
    return F.pmod(F.xxhash64(column, F.lit(7)), F.lit(blocks)).cast("int").alias("block")


def search_blocks(docs: DataFrame, members: DataFrame, asked: DataFrame, blocks: int, size: int, percent: int, text: str, doc_id: str, queries: int = QUERIES) -> DataFrame:
    """a and b of the links between classes and the members of the blocks where they are asked for (id, block)."""
    asked = asked.select("id", "block", F.lit(True).alias("asks"))
    copies = asked.groupBy("block").agg(F.ceil(F.count("*") / queries).cast("int").alias("copies"))
    own = members.select("id", block_of("id", blocks)).join(copies, "block")  # blocks that nobody asks stay out
    own = own.select("id", "block", F.lit(False).alias("asks"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    asked = asked.join(copies, "block").select("id", "block", "asks", F.pmod(F.xxhash64("id", F.lit(9)), F.col("copies")).cast("int").alias("copy"))
    needed = asked.unionByName(own)
    sets = sets_of(docs, needed.select("id").distinct(), size, text, doc_id)
    dealt = needed.join(sets, "id").repartition("block", "copy").sortWithinPartitions("block", "copy", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, own, index = None, [], [], None
        for batch in batches:
            a: list[int] = []
            b: list[int] = []
            for block, copy, asks, i, packed in zip(*(batch.column(k).to_pylist() for k in ("block", "copy", "asks", "id", "members")), strict=True):
                which = block, copy
                if which != now:
                    now, ids, own, index = which, [], [], None
                if not asks:
                    ids.append(i)
                    own.append(unpack(packed))
                    continue
                if not own:
                    continue
                index = index or Index(own, percent)
                found = [ids[k] for k in index.search(unpack(packed))]
                b += [f for f in found if f != i]
                a += [i] * (len(b) - len(a))
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    found = common.map_slices(dealt.select("block", "copy", "asks", "id", "members"), "members", run, "a long, b long")
    return found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every a hangs on one b, and no b hangs on anything."""
    ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("hangs")).unionByName(edges.select(F.col("b").alias("v"), F.lit(0).alias("hangs")))
    return ends.groupBy("v").agg(F.sum("hangs").alias("s"), F.count("*").alias("n")).where("s > 1 OR s = 1 AND n > 1").isEmpty()


def groups_of(links: DataFrame) -> DataFrame:
    """id and label (the smallest id of its group) of everything but the smallest ids: large and small stars by turns."""
    edges = links.select("a", "b")  # a > b
    while not _are_stars(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = common.settled(hung.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
    return edges.select(F.col("a").alias("id"), F.col("b").alias("label"))


def _needed(na, nb, percent: int):
    """``least_overlap`` as a column."""
    return F.floor((percent * (na + nb) + 99 + percent) / F.lit(100 + percent))


def _beyond(n, percent: int):
    """How many shingles of a set are not among its first ones."""
    return F.floor((percent * n + 99) / F.lit(100)) - 1


def _fits(percent: int):
    """Whether two postings of one shingle, x and y, let their sets be similar, by sizes and places."""
    na, nb, at, bt = F.col("x.n"), F.col("y.n"), F.col("x.place"), F.col("y.place")
    most = F.least(at, bt) + 1 + F.least(na - at - 1, nb - bt - 1)
    return (F.least(na, nb) * 100 >= F.greatest(na, nb) * percent) & (most >= _needed(na, nb, percent))


def _early(percent: int):
    """Whether a shingle of both, x and y, can be the first that similar sets share: all the others follow it."""
    need = _needed(F.col("x.n"), F.col("y.n"), percent)
    return (F.col("x.place") <= F.col("x.n") - need) & (F.col("y.place") <= F.col("y.n") - need)


def _by_level(postings: DataFrame, *by):
    """Sizes and least places of the lists' members, by levels of size."""
    level = F.floor(F.log("n") * SIZE_LEVELS).alias("level")
    return postings.groupBy("shingle", level, *by).agg(F.min("n").alias("least"), F.max("n").alias("most"), F.min("place").alias("first"))


def _may_meet(percent: int):
    """Whether a posting (n, place) can be early with a member of a level (least, most, first): the overlap that is needed
    grows with the member's size, and so does the place up to which it may stand."""
    n = F.col("n")
    low = F.greatest(F.col("least"), F.ceil(n * percent / 100))
    high = F.least(F.col("most"), F.floor(n * 100 / percent))
    return (low <= high) & (F.col("place") <= n - _needed(n, low, percent)) & (F.col("first") <= high - _needed(n, high, percent))


def second_round(long: DataFrame, labels: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, int]:
    """Members and queries (id, block) of long lists whose classes are still in different groups, and how many blocks."""
    named = long.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    named = common.written(named)
    mixed = named.groupBy("shingle").agg(F.min("label").alias("one"), F.max("label").alias("other")).where("one <> other")
    main = named.where("id = low").select("shingle", F.col("label").alias("main"))
    rest = named.join(mixed.select("shingle"), "shingle").join(main, "shingle")
    # a posting that meets no level of its list early goes no further, and no list makes pairs of all its classes
    met = rest.join(_by_level(rest), "shingle").where(_may_meet(percent)).select(*rest.columns).distinct()
    rest = common.written(met)
    members = rest.select("id", "n").distinct()
    blocks = max(1, (members.agg(F.sum("n")).first()[0] or 0) // SECOND_SHINGLES)
    places = _by_level(rest, block_of("id", blocks))
    asked = rest.where("label <> main").select("shingle", "id", "n", "place").join(places, "shingle").where(_may_meet(percent)).select("id", "block").distinct()
    return members.select("id"), common.written(asked), blocks


def components(docs: DataFrame, size: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """id, n (set size) and component (smallest id of its group) of every row."""
    own = common.written(profiles(docs, size, percent, text, doc_id))
    with_id = own.where("id IS NOT NULL AND n > 0")
    classes = with_id.groupBy("set_hash").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("first").alias("first"))
    classes = common.written(classes)
    postings = classes.select("id", "n", F.posexplode("first").alias("place", "shingle"))
    lists = postings.groupBy("shingle").agg(F.count("*").alias("length"), F.min("id").alias("low"), F.max("id").alias("high")).where("length > 1")
    postings = common.written(postings.join(lists, "shingle"))
    short, long = postings.where(F.col("length") <= SHORT_LIST), postings.where(F.col("length") > SHORT_LIST)

    fits, early = _fits(percent), _early(percent)
    same = F.col("x.shingle") == F.col("y.shingle")
    pair = [F.col("x.id").alias("query"), F.col("y.id").alias("member")]
    # how many of a class's first shingles have long lists, which the joins of short ones don't see
    beyond_short = long.groupBy("id").agg(F.count("*").alias("n_long"))
    short = short.join(beyond_short, "id", "left").withColumn("n_long", F.coalesce("n_long", F.lit(0)))
    x, y = short.alias("x"), short.alias("y")
    # of the shingles that similar sets share, only so many can stand beyond the first ones of both
    na, nb = F.col("x.n"), F.col("y.n")
    among_first = _needed(na, nb, percent) - F.greatest(_beyond(na, percent), _beyond(nb, percent)) - F.least("x.n_long", "y.n_long")
    met = x.join(y, same & (F.col("x.id") < F.col("y.id")) & fits).select(*pair, among_first.alias("least"), early.alias("early"))
    near = met.groupBy("query", "member", "least").agg(F.count("*").alias("n"), F.max("early").alias("early")).where("n >= least AND early").select("query", "member")
    leaders = long.where("id = low OR id = high")
    star = leaders.alias("x").join(long.alias("y"), same & (F.col("x.id") != F.col("y.id")) & fits & early).select(*pair)
    first = common.written(near.unionByName(star).distinct())
    members = first.select(F.col("member").alias("id")).distinct()
    blocks = max(1, members.count() // BLOCK_CLASSES)
    asked = first.select(F.col("query").alias("id"), block_of("member", blocks)).distinct()
    links = common.settled(search_blocks(docs, members, asked, blocks, size, percent, text, doc_id))
    labels = groups_of(links)
    members, asked, blocks = second_round(long, labels, percent)
    if not asked.isEmpty():
        more = search_blocks(docs, members, asked, blocks, size, percent, text, doc_id, SECOND_QUERIES)
        old = labels.select(F.col("id").alias("a"), F.col("label").alias("b"))
        labels = groups_of(common.settled(old.unionByName(more).distinct()))
    named_classes = classes.select("set_hash", "id").join(labels, "id", "left").select("set_hash", F.coalesce("label", "id").alias("label"))
    found = own.select("id", "n", "set_hash").join(named_classes, "set_hash", "left")
    return found.select("id", "n", F.when(F.col("id").isNotNull(), F.coalesce("label", "id")).alias("component"))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` but those in a group with a smaller id."""
    gone = components(docs, size, percent, text, doc_id).where("component < id").select(F.col("id").alias("__gone")).distinct()
    return docs.join(gone, docs[doc_id].cast("long") == gone["__gone"], "left_anti")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row, for 3-word shingles and 90 hundredths."""
    found = components(docs, 3, 90)
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
