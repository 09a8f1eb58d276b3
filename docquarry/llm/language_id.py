"""Language identification, words first: known words score by log frequency, unseen ones by their n-grams.

The model has, per language, log frequencies of words and of character n-grams of 1 to 4 letters, of those that the
language's sample has KNOWN_FROM times or more. A word of the model counts with its own frequencies. Any other word falls
back to its n-grams of four letters (with word ends marked), and, where the model has none of them, to three, two and
one; it counts with the mean over the n-grams found. The best sum over all words of a text wins.

Training reads a bounded, hash-chosen sample of every language: about MAX_DOCS rows and MAX_BYTES bytes of each, so that
rare ones stay learnable, and SAMPLE_BYTES in all: the more languages there are, the less of each. No language is left
out. The counting is Spark's. What is collected and broadcast is bounded by the sample: an entry for each language that
has a word, never a row over all languages. Prediction reads whole texts and no other column.

Rows: null text, and text without a letter, is ``und`` with score 0; if nothing was learnt every row is;
ties go to the language that sorts first; repeated rows repeat.
"""

from __future__ import annotations

import functools
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: The sample that trains: about so many rows and bytes of each language, and so many bytes of all, chosen by hash.
MAX_DOCS, MAX_BYTES, SAMPLE_BYTES = 3_000, 16_000_000, 160_000_000
#: Languages whose shares are broadcast; those of more are joined.
BROADCAST = 100_000
#: How often a sample has what the model keeps.
KNOWN_FROM, LONGEST_GRAM = 2, 4
UNKNOWN = "und"
#: Scores (words times languages) that a worker remembers.
REMEMBERED = 1_600_000
#: How much a count is raised, so that a language which lacks a word isn't ruled out by it.
RAISED = 0.5

_WORDS = re.compile(r"[^\W\d_]+").findall


@dataclass
class Table:
    """Log frequencies of words, or of n-grams of one length: for each, the languages that have it and by how much they
    exceed ``lacking``, the log frequency of what a language lacks."""

    places: dict[str, int]
    bounds: np.ndarray  # where the entries of each word begin
    languages: np.ndarray
    above: np.ndarray
    lacking: np.ndarray

    def means(self, found: list[int], counts: list[int]) -> np.ndarray:
        """A row over all languages for each of several lists of places, one after the other: the mean over its entries."""
        places, n = np.array(found, np.int64), np.array(counts, np.int64)
        begin, size = self.bounds[places], self.bounds[places + 1] - self.bounds[places]
        entry = np.arange(int(size.sum())) + np.repeat(begin - np.cumsum(size) + size, size)
        owner = np.repeat(np.repeat(np.arange(len(n)), n), size)
        cells, wide = len(n) * len(self.lacking), len(self.lacking)
        sums = np.bincount(owner * wide + self.languages[entry], self.above[entry], cells).reshape(-1, wide)
        return sums / n[:, None] + self.lacking


@dataclass
class Model:
    languages: list[str]
    words: Table
    grams: list[Table]  # by length - 1


def words_of(text: str) -> list[str]:
    return _WORDS(text.lower())


def grams_of(word: str, size: int) -> list[str]:
    """The n-grams of a word with its ends marked, but for the marks themselves."""
    marked = f"^{word}$"
    found = [marked[i : i + size] for i in range(len(marked) - size + 1)]
    return found[1:-1] if size == 1 else found


def _counted(rows: DataFrame) -> DataFrame:
    """lang, size (0 for words), word and n of everything in the texts of rows (text, lang)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words: dict[str, Counter] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words.setdefault(lang, Counter()).update(words_of(text))
            found: list[tuple[str, int, str, int]] = []
            for lang, own in words.items():
                found += [(lang, 0, w, n) for w, n in own.items()]
                for size in range(1, LONGEST_GRAM + 1):
                    grams: Counter = Counter()
                    for w, n in own.items():
                        for g in grams_of(w, size):
                            grams[g] += n
                    found += [(lang, size, g, n) for g, n in grams.items()]
            columns = [*zip(*found, strict=True)] or [()] * 4
            kinds = (pa.string(), pa.int32(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["lang", "size", "word", "n"])

    partial = common.map_slices(rows.select("text", "lang"), "text", run, "lang string, size int, word string, n long")
    return partial.groupBy("lang", "size", "word").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, holds_out=None, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", max_docs: int = MAX_DOCS) -> Model:
    """A model from rows with a language; those where the column ``holds_out`` of the id is true are left out."""
    rows = docs.select(F.col(doc_id).alias("id"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    if holds_out is not None:
        rows = rows.where(~holds_out(F.col("id")))
    drawn = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"), F.min(drawn).alias("first"))
    sizes = common.settled(sizes)
    n_languages = sizes.count()
    each = min(MAX_BYTES, SAMPLE_BYTES / max(1, n_languages))
    share = F.least(F.lit(1.0), max_docs / F.col("n"), each / F.greatest(F.col("bytes"), F.lit(1)))
    below = sizes.select("lang", F.greatest(F.ceil(share * (1 << 30)), F.col("first") + 1).alias("below"))  # a row at least
    chosen = rows.join(F.broadcast(below) if n_languages <= BROADCAST else below, "lang").where(drawn < F.col("below"))
    counts = common.settled(_counted(chosen))
    totals = {r["lang"]: r["n"] for r in counts.where("size = 0").groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    kept = counts.where(F.col("n") >= KNOWN_FROM).toArrow()
    return _model(sorted(totals), totals, kept)


def _model(languages: list[str], totals: dict[str, int], kept: pa.Table) -> Model:
    at = {lang: i for i, lang in enumerate(languages)}
    tables = []
    sizes = kept.column("size").to_numpy()
    for size in range(LONGEST_GRAM + 1):
        own = kept.filter(pa.array(sizes == size))
        words, langs = own.column("word").to_pylist(), own.column("lang").to_pylist()
        counts, which = own.column("n").to_numpy().astype(float), np.fromiter((at[x] for x in langs), np.int64, len(langs))
        names = sorted(set(words))
        places = dict(zip(names, range(len(names)), strict=True))
        place = np.fromiter((places[w] for w in words), np.int64, len(words))
        sums = np.array([totals[x] for x in languages], float) if not size else np.bincount(which, counts, len(languages))
        lacking = np.log(RAISED) - np.log(sums + RAISED * (len(names) + 1))
        order = np.lexsort((which, place))
        bounds = np.append(0, np.cumsum(np.bincount(place, minlength=len(names)))).astype(np.int64)
        above = (np.log(counts[order] + RAISED) - np.log(RAISED)).astype(np.float32)
        tables.append(Table(places, bounds, which[order].astype(np.int32), above, lacking.astype(np.float32)))
    return Model(languages, tables[0], tables[1:])


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.most = REMEMBERED // max(1, len(model.languages))
        self.known: dict[str, int] = {}
        self.rows = np.zeros((0, len(model.languages)), np.float32)

    def words(self, words: list[str]) -> np.ndarray:
        """A row of scores over all languages for each word; all words are looked up before anything is added up."""
        out = np.zeros((len(words), len(self.model.languages)), np.float32)
        tables = [(self.model.words, lambda w: [w])] + [(self.model.grams[k - 1], functools.partial(grams_of, size=k)) for k in range(LONGEST_GRAM, 0, -1)]
        left = [*range(len(words))]
        for table, parts in tables:
            get, own, found, counts, rest = table.places.get, [], [], [], []
            for i in left:
                if here := [k for part in parts(words[i]) if (k := get(part)) is not None]:
                    own.append(i)
                    found += here
                    counts.append(len(here))
                else:
                    rest.append(i)
            if own:
                out[own] = table.means(found, counts)
            left = rest
        return out

    def _sums(self, words: list[str]) -> np.ndarray:
        """The scores of all words together; words that the table has no room for are looked up a few at a time."""
        few = 1 + self.most // 8
        sums = np.zeros(len(self.model.languages))
        over: list[str] = []
        try:
            at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        except KeyError:
            over = [w for w in words if w not in self.known]
            at = np.fromiter((k for w in words if (k := self.known.get(w)) is not None), np.int64)
        for i in range(0, len(at), few):
            sums += self.rows[at[i : i + few]].sum(axis=0, dtype=np.float64)
        if over:
            counts = Counter(over)
            names, times = [*counts], np.fromiter(counts.values(), np.float64, len(counts))
            for i in range(0, len(names), few):
                sums += times[i : i + few] @ self.words(names[i : i + few]).astype(np.float64)
        return sums

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        split = [words_of(t) if t else [] for t in texts]
        if len(self.known) > self.most:
            self.known, self.rows = {}, self.rows[:0]
        new = [*{w for words in split for w in words if w not in self.known}][: self.most]
        if new:
            self.known.update(zip(new, range(len(self.rows), len(self.rows) + len(new)), strict=True))
            few = 1 + self.most // 8
            self.rows = np.concatenate([self.rows, *(self.words(new[i : i + few]) for i in range(0, len(new), few))])
        out = []
        for words in split:
            if not self.model.languages or not any(c.isalpha() for w in words for c in w):
                out.append((UNKNOWN, 0.0))
                continue
            sums = self._sums(words)
            odds = np.exp(sums - sums.max())
            best = int(np.argmax(sums))
            out.append((self.model.languages[best], float(odds[best] / odds.sum())))
        return out


def with_language(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred and score (the winner's share) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    mark = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = common.kept(__name__, mark, lambda: Scorer(sent.value))  # from task to task
        for batch in batches:
            found = scorer.predict(batch.column(1).to_pylist())
            langs, scores = [f[0] for f in found], [f[1] for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias(common.TEXT))
    return common.map_slices(rows, common.TEXT, run, "doc_id long, lang_pred string, score double")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; ids whose crc32 leaves 1 by 3 don't train."""
    held = lambda c: F.coalesce(common.crc_mod(c, 3) == 1, F.lit(False))
    found = with_language(docs, train(docs, held))
    return found.select("doc_id", held(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
