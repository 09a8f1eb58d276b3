"""Secret scans with DataFrame functions only: three patterns, and a randomness battery for other tokens.

Base spans are the leftmost non-overlapping matches of each pattern, less those that fail its length rule.
Their places come from splitting the text at the matches and adding up lengths in code points.

Other tokens of 20 and more characters go through a battery. The encoding is inferred (digits, letters of one case or
both, hex, base32, base64, base64url, alphanumeric), and three statistics are taken over its alphabet: chi-squared
uniformity, Wald-Wolfowitz runs about the middle of the alphabet with the changes of character class, and
lag-one serial correlation. Each is held against two models. A token must not be rejected as uniform noise
(Fisher's combination of the three), and its combined p-value as *structured* text (names, numbers, words)
must pass the Benjamini-Hochberg step-up rule. That rule runs apart in each band of lengths over all tokens of
the corpus that could be reported (those outside base spans that pass the first test), so short tokens, which say
little, can't ride on long ones. It works on counts of p-values in fixed bins (at most BINS a band), which is all that
reaches the driver.

Places are sums of lengths, and overlaps are found between neighbours in order, so a text's work is about in
proportion to its matches.

Rows: null text counts as empty; empty text has no spans and the hash of the empty string; repeated rows repeat;
a text of any length is one row's work; other columns are neither read nor returned.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import running, running_sums
from . import common

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# A run that is long enough is the same match as the whole run, so the length rules stand in the patterns.
ACCESS = r"AKIA[A-Z0-9]{14,}+"
HEX = r"[0-9a-f]{16,}+"
KINDS = ("assign", "access", "hex", "random")
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}+"

_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
ALPHABETS = {
    "digits": _DIGITS,
    "lower": _LOWER,
    "upper": _LOWER.upper(),
    "letters": _LOWER.upper() + _LOWER,
    "hex": _DIGITS + "abcdef",
    "HEX": _DIGITS + "ABCDEF",
    "base32": _LOWER.upper() + "234567",
    "alnum": _LOWER.upper() + _LOWER + _DIGITS,
    "base64": _LOWER.upper() + _LOWER + _DIGITS + "+/",
    "base64url": _LOWER.upper() + _LOWER + _DIGITS + "-_",
}
#: Share of false discoveries allowed, and the level at which a token is rejected as noise.
RATE, NOISE_LEVEL = 0.05, 1e-3
#: Structured text: coincidences over chance, changes of character class a step, serial correlation.
COINCIDENCE, CHANGES, CORRELATION = 1.73, 0.2, 0.4
#: Bands of lengths, by their lower ends; p-values are binned by tenths of a power of ten.
BANDS, BINS = (20, 28, 40, 64, 128), 300


def spans_of(text: Column, pattern: str) -> Column:
    """Matches as array<struct<start, end, match>>; an empty array without matches."""
    matches, pieces = F.regexp_extract_all(text, F.lit(pattern), 0), F.split(text, pattern, -1)
    pairs = F.arrays_zip(F.slice(pieces, F.lit(1), F.size(matches)).alias("piece"), matches.alias("match"))
    ends = running_sums(F.transform(pairs, lambda x: (F.length(x["piece"]) + F.length(x["match"])).cast("bigint")))
    place = lambda x: F.struct((x["end"] - F.length(x["match"])).alias("start"), x["end"].alias("end"), x["match"].alias("match"))
    found = F.transform(F.arrays_zip(ends.alias("end"), matches.alias("match")), place)
    none = F.array().cast("array<struct<start:bigint,end:bigint,match:string>>")
    return F.when(text.rlike(pattern), found).otherwise(none)


def outside(found: Column, base: Column) -> Column:
    """The spans of ``found`` (in order, apart from each other) that overlap none of ``base`` (in any order)."""
    taken = F.transform(base, lambda b: F.struct(b["start"].alias("start"), F.lit(0).alias("kind"), b["end"].alias("end")))
    own = F.transform(found, lambda c: F.struct(c["start"].alias("start"), F.lit(1).alias("kind"), c["end"].alias("end")))
    ordered = F.array_sort(F.concat(taken, own))
    reached = lambda spans: running(F.transform(spans, lambda x: F.when(x["kind"] == 0, x["end"]).otherwise(F.lit(0).cast("bigint"))), lambda a, b: F.greatest(a, b))
    # a base span that begins inside one of ``found`` is the next in order
    after = lambda s, i: F.coalesce(F.get(s["spans"], i + 1)["start"], F.lit(1 << 62))
    free = lambda s: F.filter(s["spans"], lambda x, i: (x["kind"] == 1) & (F.get(s["reached"], i) <= x["start"]) & (after(s, i) >= x["end"]))
    bound = F.transform(F.array(ordered), lambda spans: F.struct(spans.alias("spans"), reached(spans).alias("reached")))
    starts = F.transform(F.transform(bound, free)[0], lambda x: x["start"])
    # both are in order, and all of the free ones are among ``found``
    merged = F.transform(F.array(F.map_from_arrays(starts, starts)), lambda known: F.filter(found, lambda c: known[c["start"]].isNotNull()))[0]
    return F.when((F.size(found) > 0) & (F.size(base) > 0), merged).otherwise(found)


def _normal_tail(z: Column) -> Column:
    """P(Z > z), after Abramowitz and Stegun 26.2.17, for any z."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    # fixed values of that formula
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * poly
    return F.greatest(F.lit(1e-300), F.when(z >= 0, tail).otherwise(1 - tail))


def _each(array: Column, *steps) -> Column:
    """Adds fields to the structs of an array, step by step; each step sees the fields of those before."""
    for step in steps:
        array = F.transform(array, _adding(step))
    return array


def _adding(step):
    return lambda c: _with(c, step(c))


def _with(c: Column, fields: dict[str, Column]) -> Column:
    for name, value in fields.items():
        c = c.withField(name, value)
    return c


def _occurrences(text: Column, part: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)


def _encoding(c: Column) -> dict[str, Column]:
    t = c["match"]
    marks = t.rlike("[+/]")
    # neither marks and dashes together, nor tokens of marks with letters or digits alone, are one encoding
    name = (
        F.when(t.rlike("^[0-9]+$"), "digits")
        .when(t.rlike("^[a-z]+$"), "lower")
        .when(t.rlike("^[A-Z]+$"), "upper")
        .when(t.rlike("^[A-Za-z]+$"), "letters")
        .when(~t.rlike("[0-9]") | ~t.rlike("[A-Za-z]") | (marks & t.rlike("[-_]")), None)
        .when(t.rlike("^[0-9a-f]+$"), "hex")
        .when(t.rlike("^[0-9A-F]+$"), "HEX")
        .when(t.rlike("^[A-Z2-7]+$"), "base32")
        .when(marks, "base64")
        .when(t.rlike("[-_]"), "base64url")
        .otherwise("alnum")
    )
    return {"encoding": name, "n": F.length(t).cast("double")}


def _choose(c: Column, value) -> Column:
    """value(alphabet) for the token's encoding."""
    out = F.when(F.lit(False), value(ALPHABETS["hex"]))
    for name, alphabet in ALPHABETS.items():
        out = out.when(c["encoding"] == name, value(alphabet))
    return out


def _symbols(c: Column) -> dict[str, Column]:
    t = c["match"]
    squares = lambda a: F.aggregate(F.split(F.lit(a), ""), F.lit(0.0), lambda s, x: s + F.pow(F.length(t) - F.length(F.replace(t, x, F.lit(""))), F.lit(2.0)))
    halves = lambda a: F.translate(t, a, "0" * (len(a) // 2) + "1" * (len(a) - len(a) // 2))
    places = lambda a: F.transform(F.split(t, ""), lambda x: F.instr(F.lit(a), x).cast("double"))
    classes = F.translate(t, _DIGITS + _LOWER + _LOWER.upper() + "+/-_", "0" * 10 + "1" * 26 + "2" * 26 + "3333")
    return {"k": _choose(c, lambda a: F.lit(float(len(a)))), "squares": _choose(c, squares), "halves": _choose(c, halves), "places": F.filter(_choose(c, places), lambda x: x > 0), "classes": classes}


def _sums(c: Column) -> dict[str, Column]:
    changes = sum((_occurrences(c["classes"], a + b) for a in "0123" for b in "0123" if a != b), F.lit(0.0))
    mean = F.aggregate(c["places"], F.lit(0.0), lambda s, x: s + x) / c["n"]
    return {"ones": _occurrences(c["halves"], "1"), "runs": 1 + _occurrences(c["halves"], "01") + _occurrences(c["halves"], "10"), "changes": changes, "mean": mean}


def _statistics(c: Column) -> dict[str, Column]:
    off = F.transform(c["places"], lambda x: x - c["mean"])
    n = F.size(off)
    both = F.zip_with(F.slice(off, F.lit(1), n - 1), F.slice(off, F.lit(2), n - 1), lambda a, b: a * b)
    spread = F.aggregate(off, F.lit(0.0), lambda s, x: s + x * x)
    correlation = F.aggregate(both, F.lit(0.0), lambda s, x: s + x) / F.greatest(spread, F.lit(1e-9))
    return {"chi2": c["k"] / c["n"] * c["squares"] - c["n"], "expected_runs": 2 * c["ones"] * (c["n"] - c["ones"]) / c["n"] + 1, "correlation": correlation}


def _tests(c: Column) -> dict[str, Column]:
    n, df = c["n"], c["k"] - 1
    # against noise
    chi_z = (F.pow(c["chi2"] / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    runs_var = F.greatest(F.lit(1e-9), (c["expected_runs"] - 1) * (c["expected_runs"] - 2) / (n - 1))
    runs_z = F.when(c["expected_runs"] <= 2, 40.0).otherwise((c["runs"] - c["expected_runs"]) / F.sqrt(runs_var))
    serial_z = (c["correlation"] + 1 / (n - 1)) * F.sqrt(n)
    # against structure: more even, more changes of class, less correlation
    even = (df + (n - 1) * (COINCIDENCE - 1) - c["chi2"]) / F.sqrt(2 * df * COINCIDENCE + 4 * (n - 1) * COINCIDENCE * (COINCIDENCE - 1))
    changing = (c["changes"] - CHANGES * (n - 1)) / F.sqrt(CHANGES * (1 - CHANGES) * (n - 1))
    loose = (CORRELATION - c["correlation"]) * F.sqrt(n)
    return {"p_chi": _normal_tail(chi_z), "p_runs": 2 * _normal_tail(F.abs(runs_z)), "p_serial": 2 * _normal_tail(F.abs(serial_z)), "p_structured": _normal_tail((even + changing + loose) / math.sqrt(3))}


def _verdict(c: Column) -> dict[str, Column]:
    x = -(F.log(c["p_chi"]) + F.log(c["p_runs"]) + F.log(c["p_serial"]))  # half of Fisher's statistic
    band = sum((F.when(c["n"] >= low, 1).otherwise(0) for low in BANDS[1:]), F.lit(0))
    bin_ = F.least(F.lit(BINS), F.floor(-10 * F.log10(c["p_structured"])).cast("int"))
    return {"p_noise": F.exp(-x) * (1 + x + x * x / 2), "band": band.cast("int"), "bin": bin_}


def candidates_of(text: Column, base: Column) -> Column:
    """Tokens outside base spans that could be secrets, with their statistics: array of structs."""
    found = _each(outside(spans_of(text, CANDIDATE), base), _encoding)
    found = _each(F.filter(found, lambda c: c["encoding"].isNotNull()), _symbols, _sums, _statistics, _tests, _verdict)
    keep = ("start", "end", "encoding", "n", "chi2", "runs", "correlation", "p_noise", "p_structured", "band", "bin")
    return F.transform(found, lambda c: F.struct(*(c[k].alias(k) for k in keep)))


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, and the spans of each kind: assign, access, hex, and, with their statistics, the candidates that could be
    reported: outside base spans, and like noise."""
    t = F.coalesce(F.col(text), F.lit(""))
    assigned = F.filter(spans_of(t, ASSIGN), lambda x: F.length(F.regexp_extract(x["match"], ASSIGN, 2)) >= 12)
    plain = lambda spans: F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    base = docs.select(F.col(doc_id).alias("doc_id"), t.alias("t"), plain(assigned).alias("assign"), plain(spans_of(t, ACCESS)).alias("access"), plain(spans_of(t, HEX)).alias("hex"))
    found = candidates_of(F.col("t"), F.concat("assign", "access", "hex"))
    return base.select("doc_id", "assign", "access", "hex", F.filter(found, lambda c: c["p_noise"] >= NOISE_LEVEL).alias("candidates"))


def least_bins(scanned: DataFrame, rate: float = RATE) -> dict[int, int]:
    """The Benjamini-Hochberg threshold of each band of lengths: bins from here on are discoveries.

    A p-value counts as its bin's upper end, so the rule errs on the safe side.
    """
    counts = scanned.select(F.explode("candidates").alias("c")).groupBy("c.band", "c.bin").agg(F.count("*").alias("n"))
    down = Window.partitionBy("band").orderBy(F.desc("bin"))
    ranked = counts.withColumn("rank", F.sum("n").over(down)).withColumn("m", F.sum("n").over(Window.partitionBy("band")))
    passing = ranked.where(F.pow(F.lit(10.0), -F.col("bin") / 10) <= rate * F.col("rank") / F.col("m"))
    return {r["band"]: r["bin"] for r in passing.groupBy("band").agg(F.min("bin").alias("bin")).collect()}


def find_secrets(docs: DataFrame, rate: float = RATE, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and found: array<struct<start, kind (index in KINDS), end>>, in order, of every row."""
    scanned = common.settled(scan(docs, text, doc_id))
    least = least_bins(scanned, rate)
    limit = lambda c: sum((F.when(c["band"] == band, bin_).otherwise(0) for band, bin_ in least.items()), F.lit(0))
    if least:
        found = F.filter("candidates", lambda c: c["band"].isin(*least) & (c["bin"] >= limit(c)))
    else:
        found = F.filter("candidates", lambda c: F.lit(False))
    tag = lambda k: lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("kind"), x["end"].alias("end"))
    tagged = [F.transform(spans, tag(k)) for k, spans in enumerate([F.col("assign"), F.col("access"), F.col("hex"), found])]
    return scanned.select("doc_id", F.array_sort(F.concat(*tagged)).alias("found"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans of every row."""
    found = find_secrets(docs)
    names = F.array(*map(F.lit, KINDS))
    shown = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["kind"]], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long")
    base = F.filter("found", lambda x: x["kind"] < 3)
    return found.select("doc_id", *(count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)), F.sha2(shown(base).cast("binary"), 256).alias("base_sha256"), shown(F.col("found")).alias("spans"))
