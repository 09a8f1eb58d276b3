"""The word and cue functions as SQL functions, so that queries can be written in Spark SQL itself.

They are SQL expressions that Spark inlines, not Python functions; Spark's own parser and optimizer do the rest.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

_TOKENS = r"transform(regexp_extract_all(lower(t), r'(\w+)', 1), w -> substring(w, 1, 30))"
_TOKENS_OF_QUERY = r"transform(regexp_extract_all(lower(q), r'(\w+)', 1), w -> substring(w, 1, 30))"
_IS_WORD = "length(x.w) > 2 AND startswith(x.w, {0})"

#: name(parameters) -> (type, expression)
FUNCTIONS = {
    "word_tokens(t STRING)": ("ARRAY<STRING>", _TOKENS),
    # every token of q begins some word of t; the words are bound once for all of q's tokens
    "has_word(t STRING, q STRING)": (
        "BOOLEAN",
        f"""coalesce(transform(array({_TOKENS}), ws -> transform(array({_TOKENS_OF_QUERY}), qs -> size(qs) > 0 AND forall(qs, p -> contains(lower(t), p))
            AND forall(qs, p -> exists(ws, w -> length(w) > 2 AND startswith(w, p))))[0])[0], false)""",
    ),
    "has_near(t STRING, a STRING, b STRING, n INT)": (
        "BOOLEAN",
        f"""coalesce(aggregate(transform({_TOKENS}, (w, i) -> struct(w, i)), named_struct('last', -1, 'found', false),
            (s, x) -> named_struct('last', if({_IS_WORD.format("lower(a)")}, x.i, s.last),
                'found', s.found OR (s.last >= 0 AND x.i - s.last <= n + 1 AND {_IS_WORD.format("lower(b)")})), s -> s.found), false)""",
    ),
    "cue_time(t STRING)": (
        "BIGINT",
        r"if(t rlike r'^\d{2}:\d{2}:\d{2}[,.]\d{3}', ((cast(substring(t, 1, 2) as bigint) * 60 + cast(substring(t, 4, 2) as bigint)) * 60 + cast(substring(t, 7, 2) as bigint)) * 1000 + cast(substring(t, 10, 3) as bigint), null)",
    ),
    "cue_text(ms BIGINT)": ("STRING", "format_string('%02d:%02d:%02d,%03d', ms div 3600000, ms div 60000 % 60, ms div 1000 % 60, ms % 1000)"),
    "thread_ancestors(id STRING)": ("ARRAY<STRING>", r"transform(sequence(1, size(split(id, r'\\'))), i -> array_join(slice(split(id, r'\\'), i, size(split(id, r'\\'))), r'\'))"),
}


def register(spark: SparkSession) -> list[str]:
    """Defines the functions for this session; their names."""
    for head, (kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
    return [head.split("(")[0] for head in FUNCTIONS]
