"""Personal data: four patterns as seeds, and identifiers that their contexts lead to.

Base spans are the leftmost non-overlapping matches of each kind, less those that fail its rule. They seed a
bootstrap: every seed, and every other token with a digit or an at sign, is an instance; the words around it
give lexical patterns (two words before; one before and one after). The bipartite graph of patterns and
instances is scored in rounds of joins and sums: a pattern is as reliable as the confidence of its instances
over all its instances (smoothed), an instance as confident as its patterns together. Patterns that end up
reliable, with enough different instances behind them, mark the unseen tokens in their slots.

The graph is deduplicated before it is scored and never leaves the executors; all joins are on keys, so a
pattern or an instance with many edges is summed partially first. Sizes follow the number of identifiers.

Rows: null text counts as empty, and a text without digits and at signs has no spans; repeated rows repeat
(rows are told apart by a number, not by their id); other columns are neither read nor returned.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone", "context")
ROUNDS = 3
#: Reliability from which a pattern marks tokens, and different trusted instances that it needs.
RELIABLE, SUPPORT, SMOOTHING = 0.6, 4, 2.0
#: Confidence from which an unseen instance supports patterns in the next round.
TRUSTED = 0.7

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match always starts where its run of digits does, which keeps long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"\S+")
_WORD = re.compile(r"[^\W\d_]+")
_NOT_DIGIT = re.compile(r"[^0-9]")
_DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(_DOUBLED[int(d)] for d in digits[-2::-2])
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Found from the at sign: the part before it is the run of its letters, back to the last match at most."""
    last = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            yield start, m.end()
            last = m.end()


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every kind, in order."""
    if not text or not _ANY.search(text):
        return []
    found = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _NOT_DIGIT.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(found)


def slots(text: str, base: list[tuple[int, int, int]]) -> list[dict]:
    """Seeds and other identifiers of a text, with the patterns that their contexts give."""
    found = [(s, e, k) for s, k, e in base]
    taken = sorted((s, e) for s, _, e in base)
    at, i = 0, 0
    for m in _ANY.finditer(text):
        if m.start() < at:
            continue
        start = m.start()
        while start > at and not text[start - 1].isspace():
            start -= 1
        at = _TOKEN.match(text, m.start()).end()
        while i < len(taken) and taken[i][1] <= start:
            i += 1
        if any(s < at and start < e for s, e in taken[i : i + 4]):
            continue
        token = text[start:at]
        left = len(token) - len(token.lstrip("\"'([{<"))
        token = token.strip("\"'([{<>}]).,;:!?")
        if len(token) >= 4:
            found.append((start + left, start + left + len(token), -1))
    if not found:
        return []
    words = [m.span() for m in _WORD.finditer(text)]
    starts, ends = [a for a, _ in words], [b for _, b in words]
    out = []
    for s, e, kind in found:
        # the two words before and the one after, however far; a word that the identifier is part of counts as far as it goes
        i, j = bisect_left(starts, s), bisect_right(ends, e)
        before = [text[a : min(b, s)].lower() for a, b in words[max(0, i - 2) : i]]
        before = ["^"] * (2 - len(before)) + before
        after = text[max(starts[j], e) : ends[j]].lower() if j < len(words) else "$"
        patterns = [f"{before[0]} {before[1]} _", f"{before[1]} _ {after}"]
        out.append({"start": s, "end": e, "kind": kind, "instance": text[s:e].lower(), "patterns": patterns})
    return out


def extract(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """row (a number), doc_id, base spans and slots of every row, in one pass over the texts."""
    schema = "row long, doc_id long, base array<struct<start:long,kind:int,`end`:long>>, slots array<struct<start:long,`end`:long,kind:int,instance:string,patterns:array<string>>>"
    base_type = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
    slot_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32()), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, places = [], []
            for t in batch.column(2).to_pylist():
                spans = base_spans(t)
                base.append([{"start": s, "kind": k, "end": e} for s, k, e in spans])
                places.append(slots(t, spans) if t and _ANY.search(t) else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(base, base_type), pa.array(places, slot_type)], ["row", "doc_id", "base", "slots"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias(common.TEXT))
    return common.map_slices(rows, common.TEXT, run, schema)


def reliable_patterns(extracted: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """pattern, kind, reliability of the patterns that the bootstrap ends with."""
    slot = extracted.select(F.explode("slots").alias("s")).select("s.kind", "s.instance", F.explode("s.patterns").alias("pattern"))
    # an instance that is a seed somewhere is one everywhere
    edges = common.settled(slot.groupBy("pattern", "instance").agg(F.max("kind").alias("kind")))
    degrees = edges.groupBy("pattern").agg(F.count("*").alias("degree"))
    seeds = edges.where(F.col("kind") >= 0).groupBy("instance", "kind").agg(F.lit(1.0).alias("confidence"))
    links = edges.select("pattern", "instance")
    trusted = seeds
    for k in range(rounds):
        scored = links.join(trusted, "instance").groupBy("pattern", "kind").agg(F.sum("confidence").alias("mass"), F.count("*").alias("support"))
        scored = scored.where(F.col("support") >= SUPPORT).join(degrees, "pattern")
        scored = scored.select("pattern", "kind", (F.col("mass") / (F.col("degree") + SMOOTHING)).alias("reliability"))
        patterns = common.settled(scored)
        if k + 1 < rounds:
            doubt = F.sum(F.log(1 - F.least("reliability", F.lit(0.999))))
            confident = links.join(patterns.where(F.col("reliability") >= RELIABLE / 2), "pattern").groupBy("instance", "kind").agg((1 - F.exp(doubt)).alias("confidence"))
            trusted = seeds.unionByName(confident.where(F.col("confidence") >= TRUSTED)).groupBy("instance", "kind").agg(F.max("confidence").alias("confidence"))
    return patterns.where(F.col("reliability") >= RELIABLE)


def find_personal_data(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and found: array<struct<start, kind (index in KINDS), end>>, in order, of every row."""
    extracted = common.settled(extract(docs, text, doc_id))
    patterns = reliable_patterns(extracted).select("pattern").distinct()
    unseen = extracted.select("row", F.explode("slots").alias("s")).where(F.col("s.kind") < 0).select("row", "s.start", "s.end", F.explode("s.patterns").alias("pattern"))
    marked = unseen.join(patterns, "pattern", "left_semi").select("row", "start", F.lit(4).alias("kind"), "end").distinct()
    by_row = marked.groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("more"))
    whole = extracted.select("row", "doc_id", "base").join(by_row, "row", "left")
    return whole.select("doc_id", F.array_sort(F.when(F.col("more").isNull(), F.col("base")).otherwise(F.concat("base", "more"))).alias("found"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_found (spans of all kinds), n_email, n_ip, n_card, n_phone, n_context, base_sha256, spans of every row."""
    found = find_personal_data(docs)
    names = F.array(*map(F.lit, KINDS))
    shown = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["kind"]], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long")
    base = F.filter("found", lambda x: x["kind"] < 4)
    return found.select("doc_id", F.size("found").cast("long").alias("n_found"), *(count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)), F.sha2(shown(base).cast("binary"), 256).alias("base_sha256"), shown(F.col("found")).alias("spans"))
