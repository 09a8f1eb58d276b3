"""Fill-in-the-middle: texts are cut in three at token boundaries and put together again in another order.

A token is a run of characters that aren't whitespace with the whitespace before it; whitespace at a text's end is a
token of its own. Cuts and forms come from a digest of the document's id, so a document always gets the same ones.

All texts of an Arrow batch are cut together, as array work on the batch's UTF-8 bytes: a lookup gives the class of
each byte, two neighbouring bytes show where a token begins, cumulative sums (less what they were where the document
began) number the tokens, and a binary search in the sums finds the byte of every cut. The pieces are then views on the
same bytes.

Handling: a null text is an empty one, which has no tokens and stays plain, as texts do that hold a marker. A null id
counts as an empty string in the digest. Equal rows give equal results; further columns are ignored. Memory follows
the batch (1 MB of text, or the longest text: about six times its bytes for classes and sums).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TEXT, byte_list, map_slices, sha256

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Per cent of texts that are transformed, and of those in which the suffix comes first.
TRANSFORMED, SUFFIX_FIRST = 50, 80

#: The bytes that are whitespace.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string array's bytes and where each value begins in them, and the last one ends."""
    _, offsets, data = texts.buffers()
    own = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1] if offsets else np.zeros(1, np.int32)
    return np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8), own.astype(np.int64)


def _pieces(texts: pa.Array, *cuts: np.ndarray) -> list[pa.Array]:
    """The parts of each text between the cuts (places in the array's bytes), without copying any."""
    _, offsets = _buffers(texts)
    bounds = np.stack([offsets[:-1], *cuts], axis=1).ravel()
    whole = pa.StringArray.from_buffers(len(texts) * (len(cuts) + 1), pa.py_buffer(np.append(bounds, offsets[-1:]).astype(np.int32)), texts.buffers()[2] or pa.py_buffer(b""))
    return [whole.take(pa.array(np.arange(k, len(whole), len(cuts) + 1))) for k in range(len(cuts) + 1)]


def token_cuts(texts: pa.Array, *draws: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """How many tokens each text has, and for each draw the place where so many (modulo all and one) tokens end.

    >>> n, (cut,) = token_cuts(pa.array(["a b ", ""]), np.array([5, 7]))
    >>> n.tolist(), cut.tolist()
    ([3, 0], [1, 4])
    """
    data, offsets = _buffers(texts)
    low, high = int(offsets[0]), int(offsets[-1])
    space = SPACE[data[low:high]]
    begins = np.zeros(high - low, np.int32)
    begins[1:] = space[1:] & ~space[:-1]
    lengths = np.diff(offsets)
    begins[offsets[:-1][lengths > 0] - low] = 1  # a text's first byte, whatever stands before it
    sums = np.cumsum(begins, dtype=np.int32)
    upto = np.concatenate([np.zeros(1, np.int32), sums])[offsets - low]  # tokens that begin before each text's own
    n = np.diff(upto).astype(np.int64)
    cuts = []
    for draw in draws:
        k = draw % (n + 1)
        found = low + np.searchsorted(sums, upto[:-1] + k + 1)
        cuts.append(np.where(k == n, offsets[1:], found))
    return n, cuts


def _reorder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = pc.fill_null(batch.column(1), "")
        h1, h2, h3, h4 = (batch.column(2 + k).to_numpy() for k in range(4))
        n, (a, b) = token_cuts(texts, h1, h2)
        prefix, middle, suffix = _pieces(texts, np.minimum(a, b), np.maximum(a, b))
        marked = [pc.match_substring(texts, m).to_numpy(zero_copy_only=False) for m in (PREFIX, SUFFIX, MIDDLE)]
        plain = (n == 0) | np.any(marked, axis=0) | (h3 % 100 >= TRANSFORMED)
        form = np.where(plain, "plain", np.where(h4 % 100 < SUFFIX_FIRST, "spm", "psm"))
        psm = pc.binary_join_element_wise(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle, "")
        spm = pc.binary_join_element_wise(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle, "")
        output = pc.if_else(pa.array(plain), texts, pc.if_else(pa.array(form == "spm"), spm, psm))
        chars = [pc.if_else(pa.array(plain), pa.scalar(None, pa.int64()), pc.cast(pc.utf8_length(p), pa.int64())) for p in (prefix, middle)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(form, pa.string()), *chars, output], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def transform(docs: DataFrame, seed: int = 42) -> DataFrame:
    """doc_id, n (tokens), form (plain, psm or spm), prefix_chars, middle_chars (null if plain), output."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"__h{k}") for k in range(4)]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias(TEXT), *draws)
    return map_slices(rows, TEXT, _reorder, SCHEMA)


def restored(output: pa.Array, form: np.ndarray) -> pa.Array:
    """The texts that some outputs were made of, read from the outputs alone."""
    data, offsets = _buffers(output)
    first, second = (pc.find_substring(output, m).to_numpy(zero_copy_only=False) for m in (SUFFIX, PREFIX))
    third = pc.find_substring(output, MIDDLE).to_numpy(zero_copy_only=False)
    plain = form == "plain"
    size = len(PREFIX)
    inner = np.where(form == "psm", first, second)  # where the second part's marker is
    at = [np.where(plain, 0, x) for x in (np.full(len(form), size), inner, inner + size, third, third + size)]
    _, one, _, two, _, three = _pieces(output, *(offsets[:-1] + x for x in at))
    prefix, suffix = (pc.if_else(pa.array(form == "psm"), x, y) for x, y in ((one, two), (two, one)))
    return pc.if_else(pa.array(plain), output, pc.binary_join_element_wise(prefix, three, suffix, ""))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        form = np.array(batch.column(2).to_pylist(), dtype=object)
        texts = [pa.array([sha256(x) for x in byte_list(column)], pa.string()) for column in (batch.column(5), restored(batch.column(5), form))]
        yield pa.RecordBatch.from_arrays([*batch.columns[:5], *texts], names=[*batch.schema.names[:5], "output_sha256", "restored_sha256"])


def report(transformed: DataFrame) -> DataFrame:
    """The outputs' digests, and those of the texts that are rebuilt from output and form."""
    schema = SCHEMA.replace("output string", "output_sha256 string, restored_sha256 string")
    return map_slices(transformed, "output", _digests, schema)
