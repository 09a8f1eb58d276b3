"""Token counts: lengths of piece-BPE encodings, without the encodings.

A text is cut in front of every run of spaces that follows another character. No piece of the vocabulary
holds a space marker after another character (checked when the model is loaded), so no merge can cross such
a cut, and the counts of the parts add up to the count of the whole text, however long it is. The first
space of a later part is dropped because the library puts one in front of every text it encodes.

Parts seen before have their lengths in a bounded table; the others go through the library in batches
balanced by bytes. Rows: null text counts as empty, empty text has 0 tokens, repeated rows repeat, other
columns are neither read nor returned.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MODEL = "piece_bpe_32k.model"
#: A batch for the library ends at this many bytes.
BATCH_BYTES = 256 << 10
#: Parts whose lengths a task remembers; longer parts aren't kept.
REMEMBERED, LONGEST_KEPT = 500_000, 64

SPACES = " ▁"
#: A part: spaces, then others (the first part may lack spaces; the last may lack others).
PART = re.compile(f"[{SPACES}]*[^{SPACES}]*")


class PieceCounter:
    """Counts tokens as ``SentencePieceProcessor.encode`` gives them by default."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.vocab_size()))
        self.cuts_are_safe = not any("▁" in p.lstrip("▁") for p in pieces) and len(self.model.encode("a")) + 1 == len(self.model.encode("a "))
        self.known: dict[str, int] = {}

    def learn(self, parts: list[str]) -> dict[str, int]:
        """Lengths of parts, encoded in batches that are balanced by bytes."""
        found: dict[str, int] = {}
        batch: list[str] = []
        size = 0
        for part in [*parts, None]:
            if batch and (part is None or size + 4 * len(part) > BATCH_BYTES):
                found.update(zip(batch, map(len, self.model.encode(batch, num_threads=1)), strict=True))
                batch, size = [], 0
            if part is not None:
                batch.append(part)
                size += 4 * len(part)
        return found

    def split(self, text: str) -> list[str]:
        if not self.cuts_are_safe:
            return [text]
        if "▁" not in text and "  " not in text and not text.startswith(" "):
            return text.split(" ")  # one space between parts; the library puts it back
        parts = [m for m in PART.findall(text) if m]
        return [parts[0], *(p[1:] for p in parts[1:])] if parts else []

    def counts(self, texts: list[str]) -> list[int]:
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        split = [self.split(t) if t else () for t in texts]
        new = {p for parts in split for p in parts if p not in known}
        if not new:
            return [sum(map(known.__getitem__, parts)) for parts in split]
        found = self.learn(sorted(new, key=len))
        found[""] = len(self.model.encode("a ")) - len(self.model.encode("a"))  # a lone space at the end
        known.update((p, n) for p, n in found.items() if len(p) <= LONGEST_KEPT)
        get = (known | found).__getitem__ if len(found) * 4 > len(known) else lambda p: known[p] if p in known else found[p]
        return [sum(map(get, parts)) for parts in split]


def counter_of(path: str) -> PieceCounter:
    """A worker keeps the lengths it knows from one task to the next."""
    return common.kept(__name__, path, lambda: PieceCounter(path))


def token_counts(docs: DataFrame, path: str | None = None, text: str = "text", doc_id: str = "doc_id", limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row; ``path`` names the model's file on the executors."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(path or common.tokenizer_path(MODEL))
        for batch in batches:
            sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0).cast(pa.int64())
            n = pa.array(counter.counts(batch.column(1).to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, n], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias(common.TEXT))
    return common.map_slices(rows, common.TEXT, count, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
