"""Words and text as column expressions: tokens, word tests, proximity, highlights, samples.

A token is a run of ASCII letters, digits and underscores in the lower-cased text, cut at 30 characters. Tokens
of more than two characters are words; a query word stands for all words that begin with it. Nothing here is a
Python function, so everything stays inside generated code.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of a token that count, and those that a word needs.
TOKEN_LENGTH, WORD_LENGTH = 30, 3
NOT_AFTER_WORD = r"(?<![A-Za-z0-9_])"


def query_tokens(query: str) -> list[str]:
    """The tokens of a query; ValueError if it has none."""
    found = [w[:TOKEN_LENGTH] for w in re.findall(r"[A-Za-z0-9_]+", query.lower())]
    if not found:
        raise ValueError(f"no word in {query!r}")
    return found


def tokens(text: Column) -> Column:
    """All tokens in order, repeated ones too."""
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"(\w+)"), 1), lambda w: F.substring(w, 1, TOKEN_LENGTH))


def words(text: Column) -> Column:
    """Tokens that are long enough to be searched for."""
    return F.filter(tokens(text), lambda w: F.length(w) >= WORD_LENGTH)


def _one_word(text: Column, token: str) -> Column:
    # the same as exists(words(text), startswith), in one pass of a pattern and without an array
    more = max(0, WORD_LENGTH - len(token))
    low = F.lower(text)
    return F.contains(low, F.lit(token)) & low.rlike(f"{NOT_AFTER_WORD}{token}" + (rf"\w{{{more}}}" if more else ""))  # most texts end at the plain search


def has_word(text: Column, query: str, tokenizer=None) -> Column:
    """Whether every token of the query begins some word of the text; false for null.

    Another tokenizer (a function from a column to its words) cuts the query and the text alike; a query in which
    it finds nothing matches nothing.
    """
    if tokenizer is None:
        return F.coalesce(reduce(Column.__and__, (_one_word(text, t) for t in query_tokens(query))), F.lit(False))
    wanted = tokenizer(F.lit(query))
    # the text's words are bound once, not made anew for each token of the query
    every = F.transform(F.array(tokenizer(text)), lambda own: F.forall(wanted, lambda q: F.exists(own, lambda w: F.startswith(w, q))))[0]
    return F.coalesce((F.size(wanted) > 0) & every, F.lit(False))


def has_near(text: Column, query: list[str], limit: int = 2) -> Column:
    """Whether the query's words follow each other with at most ``limit`` tokens between neighbours.

    One pass over the tokens keeps, for each beginning of the query, the last place where it could end: a later
    place allows whatever an earlier one does.
    """
    wanted = [t for q in query for t in query_tokens(q)]
    numbered = F.transform(tokens(text), lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    never = -(limit + 2)
    start = F.array(*[F.lit(never)] * len(wanted))

    def step(ends: Column, x: Column) -> Column:
        fits = [(F.length(x["w"]) >= WORD_LENGTH) & F.startswith(x["w"], F.lit(t)) for t in wanted]
        reached = [fits[0]] + [f & (x["i"] - ends[k] <= limit + 1) & (ends[k] >= 0) for k, f in enumerate(fits[1:])]
        return F.array(*(F.when(r, x["i"]).otherwise(ends[k]) for k, r in enumerate(reached)))

    found = F.aggregate(numbered, start, step, lambda ends: ends[len(wanted) - 1] >= 0)
    every = reduce(Column.__and__, (_one_word(text, t) for t in wanted))  # cheap, and most rows end here
    return F.coalesce(F.when(every, found), F.lit(False))


def sample_words(text: Column, limit: int = 3) -> Column:
    """The first words from the middle token on."""
    # inside the lambda the tokens are there; written out, they would be made anew at each use
    return F.transform(F.array(tokens(text)), lambda found: F.slice(_from_middle(found), 1, limit))[0]


def _from_middle(found: Column) -> Column:
    half = F.floor(F.size(found) / 2).cast("int")
    return F.filter(F.slice(found, half + 1, F.greatest(F.size(found) - half, F.lit(0))), lambda w: F.length(w) >= WORD_LENGTH)


def completion(text: Column, prefix: str) -> Column:
    """The first token that continues ``prefix``, or an equal one with the token after it; null without any."""
    found = F.regexp_extract(F.lower(text), rf"{NOT_AFTER_WORD}{re.escape(prefix)}(?:\w+|\W+\w+)", 0)
    return F.when(found != "", F.regexp_replace(found, r"\W+", " "))


def xml_escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def highlight(text: Column, queries: list[str], marks: list[tuple[str, str]] | None = None) -> Column:
    """The escaped text with the beginnings of matching tokens marked; query i gets mark pair i, round and round."""
    marks = marks or [("<b>", "</b>"), ("<em>", "</em>")]
    out = xml_escape(text)
    for i, query in enumerate(queries):
        before, after = marks[i % len(marks)]
        for token in query_tokens(query):
            out = F.regexp_replace(out, f"(?i){NOT_AFTER_WORD}({token})(?![^<]*>)(?![a-z]*;)", f"{before}$1{after}")
    return out


#: Elements that ``running`` combines in one go.
PART = 1024


def running(values: Column, combine, kind: str = "bigint") -> Column:
    """An array's elements, each combined with all before it (sums, maxima: an associative function of two columns).

    Parts of the array are combined apart and then with what came before them, so that an element costs a copy of a
    part at most, however long the array is.
    """
    none = F.array().cast(f"array<{kind}>")
    # expressions that are used twice are bound by a lambda, so that they are evaluated once
    add = lambda acc, x: F.concat(acc, F.array(F.when(F.size(acc) > 0, combine(F.element_at(acc, -1), x)).otherwise(x)))
    within = lambda own: F.transform(F.sequence(F.lit(0), F.greatest(F.size(own) - 1, F.lit(0)), F.lit(PART)), lambda i: F.aggregate(F.slice(own, i + 1, PART), none, add))
    parts = F.transform(F.array(values), within)
    bound = F.transform(parts, lambda p: F.struct(p.alias("parts"), F.aggregate(F.transform(p, lambda x: F.element_at(x, -1)), none, add).alias("upto")))
    whole = lambda s: F.flatten(F.transform(s["parts"], lambda p, i: F.when(i == 0, p).otherwise(F.transform(p, lambda x: combine(F.get(s["upto"], i - 1), x)))))
    return F.when(F.size(values) > 0, F.transform(bound, whole)[0]).otherwise(none)


def running_sums(numbers: Column) -> Column:
    return running(numbers, lambda a, b: a + b)


def prefix_places(text: Column, prefix: str) -> Column:
    """Starts and ends of the tokens' beginnings that are ``prefix``: array<struct<start, end>>, from 0."""
    pieces = F.split(F.lower(text), f"{NOT_AFTER_WORD}{re.escape(prefix)}", -1)
    lengths = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p: (F.length(p) + len(prefix)).cast("bigint"))
    return F.transform(running_sums(lengths), lambda e: F.struct((e - len(prefix)).cast("int").alias("start"), e.cast("int").alias("end")))
