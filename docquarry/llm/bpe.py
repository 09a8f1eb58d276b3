"""Byte-level BPE by speculation: propose greedily, verify every adjacent pair, merge only what fails.

Each text is cut into words by the vocabulary's own pattern. For words not met before, greedy longest match
proposes tokens. A token sequence is what merging gives if and only if every adjacent pair is, that is, if
merging the two tokens' bytes gives back the two tokens; so the proposals of a whole slice are verified by
looking up their distinct pairs in a table of tested pairs, as arrays. Only words with a failing pair (or a
single token that merging never makes) are merged exactly.

Rows: null text counts as empty and has no tokens; repeated rows repeat; texts of any length are handled
word by word, and one endless word is merged with a heap; other columns stay out of the result.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

VOCABULARY = "byte_bpe_50k.json"
#: Words (in each of two tables, and stretches in two others) and pairs that a task remembers.
REMEMBERED_WORDS, REMEMBERED_PAIRS, LONGEST_KEPT = 150_000, 1_000_000, 48
#: From this many bytes on a word is merged with a heap; so many shorter words at a time take their steps together.
HEAP_FROM, MERGED_TOGETHER = 48, 4_000
#: Stands between words, as no byte does.
SEPARATOR = "\u0100"
#: Stands for a pair that never merges.
NEVER = 1 << 62

#: Fixed value: the pattern that splits text before merging, with the White_Space property spelt out.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"

SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CUT, ODD = re.compile(f" (?=[^{SPACE}])"), re.compile(f" (?:[{SPACE}]|$)")


def byte_letters() -> dict[str, int]:
    """The printable letter that a byte-level vocabulary uses for each byte, as letter -> byte."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class IntTable:
    """A hash table from whole numbers to whole numbers, asked for many at a time."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, absent: int):
        self.bits = max(4, int(2 * len(keys) + 1).bit_length() + 1)
        self.keys, self.values, self.absent = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int64), absent
        slot = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[slot] < 0)
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            left = np.ones(len(keys), bool)
            left[put] = False
            keys, values, slot = keys[left], values[left], (slot[left] + 1) & (1 << self.bits) - 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, asked: np.ndarray) -> np.ndarray:
        out = np.full(len(asked), self.absent, np.int64)
        at, slot = np.arange(len(asked)), self._slot(asked)
        while len(at):
            there = self.keys[slot]
            same = there == asked[at]
            out[at[same]] = self.values[slot[same]]
            more = ~same & (there >= 0)
            at, slot = at[more], (slot[more] + 1) & (1 << self.bits) - 1
        return out


class BytePairEncoder:
    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        self.bytes_of = {i: bytes(letters[c] for c in token) for token, i in spec["model"]["vocab"].items()}
        self.id_of = {b: i for i, b in self.bytes_of.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.size = max(self.bytes_of) + 1
        self.merges: dict[int, int] = {}  # by left * size + right: rank << 20 | new token
        ids = spec["model"]["vocab"]
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[ids[a] * self.size + ids[b]] = rank << 20 | ids[a + b]
        self.table = [self.bytes_of.get(i, b"") for i in range(self.size)]
        self.step_table = IntTable(np.fromiter(self.merges, np.int64, len(self.merges)), np.fromiter(self.merges.values(), np.int64, len(self.merges)), NEVER)
        self.letter_ids = np.array([self.id_of.get(bytes([b]), -1) for b in range(256)], np.int64)
        self.token_sizes = np.array([*map(len, self.table)], np.int64)
        self.table_bytes, self.table_starts = np.frombuffer(b"".join(self.table), np.uint8), np.cumsum(self.token_sizes) - self.token_sizes
        self.greedy = ahocorasick.Automaton()
        for token, i in self.id_of.items():
            self.greedy.add_word(token.decode("latin-1"), i)
        self.greedy.make_automaton()
        self.words = regex.compile(PATTERN).findall
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.known: dict[str, bytes] = {}  # ids of words, and of stretches
        self.seen: dict[str, bytes] = {}
        self.older_known, self.older_seen = {}, {}
        self.pairs, self.valid = np.empty(0, np.int64), np.empty(0, bool)  # sorted tested pairs, and what came out
        self.alone: dict[int, bool] = {}
        self.merged = 0  # words that needed exact merging

    # -- exact merging -------------------------------------------------------------------------------------

    def merge(self, word: bytes) -> list[int]:
        """Tokens of a word: the lowest-ranked adjacent pair merges first, the leftmost of equals."""
        parts = [self.id_of[word[i : i + 1]] for i in range(len(word))]
        return self._merge_heap(parts)

    def merge_all(self, words: list[bytes]) -> list[list[int]]:
        """Tokens of many words: those of similar lengths take their merging steps together, as rows of a matrix."""
        out: list[list[int]] = [[]] * len(words)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        at = 0
        while at < len(order):
            longest = len(words[order[min(at + MERGED_TOGETHER, len(order)) - 1]])
            if longest >= HEAP_FROM:
                out[order[at]] = self.merge(words[order[at]])
                at += 1
                continue
            own = order[at : at + MERGED_TOGETHER]
            for i, tokens in zip(own, self._merge_rows([words[i] for i in own], longest), strict=True):
                out[i] = tokens
            at += len(own)
        return out

    def _merge_rows(self, words: list[bytes], width: int) -> list[list[int]]:
        if width == 0:
            return [[] for _ in words]
        letters = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(-1, width)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        parts = np.full((len(words), width + 1), -1, np.int64)  # the last column stays empty
        parts[:, :width] = np.where(np.arange(width) < sizes[:, None], self.letter_ids[letters], -1)
        steps = np.full(parts.shape, NEVER, np.int64)
        steps[:, :-1] = self.steps_of(parts[:, :-1], parts[:, 1:])
        rows, columns = np.arange(len(words)), np.arange(width)
        done = np.full((len(words), width), -1, np.int64)
        while len(rows):
            i = steps.argmin(axis=1)
            best = steps[np.arange(len(rows)), i]
            ended = best == NEVER
            if ended.any():
                done[rows[ended]] = parts[ended, :-1]
                rows, parts, steps, i, best = rows[~ended], parts[~ended], steps[~ended], i[~ended], best[~ended]
            own = np.arange(len(rows))
            moved = columns + (columns > i[:, None])
            parts[own, i] = best & 0xFFFFF
            parts[:, :-1] = np.take_along_axis(parts, moved, axis=1)
            steps[:, :-1] = np.take_along_axis(steps, moved, axis=1)
            steps[own, i] = self.steps_of(parts[own, i], parts[own, i + 1])
            inner = i > 0
            before = i[inner] - 1
            steps[own[inner], before] = self.steps_of(parts[own[inner], before], parts[own[inner], before + 1])
        counts = (done >= 0).sum(axis=1)
        flat = done[done >= 0].tolist()
        ends = np.cumsum(counts).tolist()
        return [flat[e - n : e] for e, n in zip(ends, counts.tolist(), strict=True)]

    def steps_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank and new token of each pair, as one number; NEVER for pairs that don't merge."""
        asked = left * self.size + right
        out = self.step_table.get(np.where((left < 0) | (right < 0), -2, asked).ravel())
        return out.reshape(asked.shape)

    def _merge_heap(self, parts: list[int]) -> list[int]:
        get, size, n = self.merges.get, self.size, len(parts)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(step, i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if (step := get(a * size + b, NEVER)) != NEVER]
        heapq.heapify(heap)
        while heap:
            step, i, left, right = heapq.heappop(heap)
            j = after[i]
            if parts[i] != left or j < 0 or parts[j] != right:
                continue  # one of the two has merged meanwhile
            parts[i], parts[j] = step & 0xFFFFF, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (step := get(parts[x] * size + parts[y], NEVER)) != NEVER:
                    heapq.heappush(heap, (step, x, parts[x], parts[y]))
        return [p for p in parts if p >= 0]

    # -- speculation ---------------------------------------------------------------------------------------

    def propose(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest matches of all words one after the other, and how many each word has."""
        joined = SEPARATOR.join(w.decode("latin-1") for w in words)
        found = np.array([*self.greedy.iter_long(joined)], np.int64).reshape(-1, 2)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1  # of the separators
        owner = np.searchsorted(ends, found[:, 0])
        if int(self.token_sizes[found[:, 1]].sum()) != int(sizes.sum()):
            raise ValueError("the vocabulary lacks some bytes")
        return found[:, 1], np.bincount(owner, minlength=len(words))

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """For each adjacent pair, whether merging the bytes of both gives both back."""
        asked = left.astype(np.int64) * self.size + right
        keys, where = np.unique(asked, return_inverse=True)
        at = np.searchsorted(self.pairs, keys)
        seen = np.zeros(len(keys), bool)
        inside = at < len(self.pairs)
        seen[inside] = self.pairs[at[inside]] == keys[inside]
        answers = np.zeros(len(keys), bool)
        answers[seen] = self.valid[at[seen]]
        if not seen.all():
            new = keys[~seen]
            both = [*zip((new // self.size).tolist(), (new % self.size).tolist(), strict=True)]
            merged = self.merge_all([self.table[a] + self.table[b] for a, b in both])
            answers[~seen] = [m == [*pair] for m, pair in zip(merged, both, strict=True)]
            if len(self.pairs) > REMEMBERED_PAIRS:
                self.pairs, self.valid = np.empty(0, np.int64), np.empty(0, bool)
                self.pairs, self.valid = keys, answers
            else:
                pairs, valid = np.concatenate([self.pairs, new]), np.concatenate([self.valid, answers[~seen]])
                order = np.argsort(pairs, kind="stable")
                self.pairs, self.valid = pairs[order], valid[order]
        return answers[where]

    def stands_alone(self, token: int) -> bool:
        if token not in self.alone:
            self.alone[token] = self.merge(self.table[token]) == [token]
        return self.alone[token]

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """Little-endian ids of words, each as bytes."""
        raw = [w.encode() for w in words]
        flat, counts = self.propose(raw)
        ends = np.cumsum(counts)
        adjacent = np.ones(max(0, len(flat) - 1), bool)
        adjacent[ends[:-1] - 1] = False  # the last token of a word and the first of the next
        left = np.flatnonzero(adjacent)
        bad = left[~self.compatible(flat[left], flat[left + 1])] if len(left) else left
        failing = set(np.searchsorted(ends, bad, side="right").tolist())
        failing.update(i for i in np.flatnonzero(counts == 1).tolist() if not self.stands_alone(int(flat[ends[i] - 1])))
        ids = flat.astype("<u4").tobytes()
        out = {w: ids[4 * (e - n) : 4 * e] for w, e, n in zip(words, ends.tolist(), counts.tolist(), strict=True)}
        wrong = [*failing]
        for i, tokens in zip(wrong, self.merge_all([raw[i] for i in wrong]), strict=True):
            out[words[i]] = np.asarray(tokens, "<u4").tobytes()
        self.merged += len(failing)
        return out

    def pieces(self, text: str) -> list[str]:
        """Words, and special strings as they stand in the text."""
        if self.at_special is None or not any(s in text for s in self.special):
            return self.words(text)
        return [w for part in self.at_special.split(text) for w in ([part] if part in self.special else self.words(part))]

    def stretches(self, text: str) -> list[str]:
        """Parts of a text in front of every space that a character other than white space follows: words
        always begin there. But for the first, they are given without that space."""
        return CUT.split(text) if ODD.search(text) else text.split(" ")

    def split_stretches(self, stretches: list[str]) -> dict[str, list[str]]:
        """The words of each stretch. Those without a space inside are split together: every one starts with a
        word that begins with a space, and has no other such word."""
        together = [x for x in stretches if x and " " not in x]
        words = self.words("".join(f" {x}" for x in together))
        starts = [i for i, w in enumerate(words) if w[0] == " "]
        out = {x: words[i:j] for x, i, j in zip(together, starts, [*starts, len(words)][1:], strict=True)}
        out.update((x, self.words(" " + x)) for x in stretches if x not in out)
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of texts, as bytes. Stretches and words met before have theirs in a table.

        A full table becomes the older of two, so what is met again and again isn't learnt again and again.
        """
        if len(self.known) > REMEMBERED_WORDS or not self.known:
            self.older_known, self.known = self.known, {s: np.asarray([i], "<u4").tobytes() for s, i in self.special.items()}
        if len(self.seen) > REMEMBERED_WORDS:
            self.older_seen, self.seen = self.seen, {}
        known, seen = self.known, self.seen
        plan: list[tuple[list[str], list[str]]] = []  # of each text: words apart from stretches, stretches
        for t in texts:
            if not t or any(s in t for s in self.special):
                plan.append((self.pieces(t or ""), []))
            else:
                first, *rest = self.stretches(t)
                plan.append((self.words(first), rest))
        unseen = {x for _, rest in plan for x in rest if x not in seen}
        seen.update((x, b) for x in unseen if (b := self.older_seen.get(x)) is not None)
        fresh = self.split_stretches([x for x in unseen if x not in seen])
        words = {w for split, _ in plan for w in split if w not in known}
        words.update(w for split in fresh.values() for w in split if w not in known)
        known.update((w, b) for w in words if (b := self.older_known.get(w)) is not None)
        words = [w for w in words if w not in known]
        found = self.learn(words) if words else {}
        known.update((w, b) for w, b in found.items() if len(w) <= LONGEST_KEPT)
        of = {w: b for w, b in found.items() if len(w) > LONGEST_KEPT}
        get = known.__getitem__ if not of else lambda w: known[w] if w in known else of[w]
        new = {x: b"".join(map(get, split)) for x, split in fresh.items()}
        seen.update((x, b) for x, b in new.items() if len(x) <= LONGEST_KEPT)
        own = {x: b for x, b in new.items() if len(x) > LONGEST_KEPT}
        at = seen.__getitem__ if not own else lambda x: seen[x] if x in seen else own[x]
        return [b"".join([*map(get, split), *map(at, rest)]) for split, rest in plan]

    def decode(self, ids: bytes) -> str:
        tokens = np.frombuffer(ids, "<u4")
        if not len(tokens):
            return ""
        sizes = self.token_sizes[tokens]
        ends = np.cumsum(sizes)
        at = np.repeat(self.table_starts[tokens] - ends + sizes, sizes)
        at += np.arange(len(at))
        return self.table_bytes[at].tobytes().decode("utf-8", "replace")


def encoder_of(path: str) -> BytePairEncoder:
    """A worker keeps what it has learnt from one task to the next."""
    return common.kept(__name__, path, lambda: BytePairEncoder(path))


def encode(docs: DataFrame, path: str | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit integers) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path or common.tokenizer_path(VOCABULARY))
        for batch in batches:
            ids = encoder.encode(batch.column(1).to_pylist())
            n = pa.array([len(b) // 4 for b in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n, pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias(common.TEXT))
    return common.map_slices(rows, common.TEXT, run, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``encoded`` with the texts that its ids stand for, as column decoded."""
    names = ["doc_id", "n_tokens", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path or common.tokenizer_path(VOCABULARY))
        for batch in batches:
            texts = [encoder.decode(b or b"") for b in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*names, "decoded"])

    return common.map_slices(encoded.select(*names), "ids", run, "doc_id long, n_tokens long, ids binary, decoded string")


def round_trip(docs: DataFrame, path: str | None = None, with_ids: bool = False, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, the SHA-256 of the ids and of the text decoded from them, and the ids if asked for.

    The same as encode() and then decode(), but neither ids nor decoded texts leave the task for it.
    """
    schema = "doc_id long, n_tokens long, " + "ids binary, " * with_ids + "ids_sha256 string, decoded_sha256 string"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path or common.tokenizer_path(VOCABULARY))
        for batch in batches:
            ids = encoder.encode(batch.column(1).to_pylist())
            shown = [common.sha256(encoder.decode(b).encode()) for b in ids]
            columns = [pa.array([len(b) // 4 for b in ids], pa.int64()), *[pa.array(ids, pa.binary())] * with_ids]
            columns += [pa.array(list(map(common.sha256, ids)), pa.string()), pa.array(shown, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias(common.TEXT))
    return common.map_slices(rows, common.TEXT, run, schema)
