"""Row tests as two-valued columns: a missing value fails every test, so ``~`` means "does not".

A test of a plain attribute is the bare comparison beside ``IS NOT NULL``: it is false for a missing value, and as
both parts are comparisons of a column, Spark hands them to the Parquet scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as words


def match(df: DataFrame, attr: str, value) -> Column:
    """Any value of the attribute equals; a string never equals a number."""
    kind = df.schema[attr].dataType
    inner = kind.elementType if isinstance(kind, T.ArrayType) else kind
    if isinstance(value, str) != isinstance(inner, T.StringType):
        return F.lit(False)
    return _any(df, attr, lambda v: v == F.lit(value))


def prefix(df: DataFrame, attr: str, start: str) -> Column:
    """Any value begins with ``start``; case counts. An empty prefix holds for every row that has the attribute."""
    return _any(df, attr, lambda v: F.startswith(v, F.lit(start)))


def between(df: DataFrame, attr: str, low=None, high=None, inclusive: bool = False) -> Column:
    """Any value is from ``low`` up to but without ``high`` (with it if inclusive); None leaves an end open."""
    if low is not None and high is not None and low > high:
        raise ValueError("the lower end is above the upper one")

    def test(v: Column) -> Column:
        parts = [v >= F.lit(low)] if low is not None else []
        parts += [(v <= F.lit(high) if inclusive else v < F.lit(high))] if high is not None else []
        return reduce(Column.__and__, parts) if parts else v.isNotNull()

    return _any(df, attr, test)


def _any(df: DataFrame, attr: str, test) -> Column:
    column = F.col(attr)
    if isinstance(df.schema[attr].dataType, T.ArrayType):
        return column.isNotNull() & F.exists(attr, lambda v: v.isNotNull() & test(v))
    return column.isNotNull() & test(column)


def word(attr: str, query: str, tokenizer=None) -> Column:
    """Every token of the query begins a word of the attribute; a tokenizer (a function of a column) cuts both."""
    return words.has_word(F.col(attr).cast("string"), query, tokenizer)


def any_word(attrs: list[str], query: str) -> Column:
    """Every token of the query begins a word of some attribute (not necessarily the same)."""
    each = (reduce(Column.__or__, (words.has_word(F.col(a).cast("string"), t) for a in attrs)) for t in words.query_tokens(query))
    return reduce(Column.__and__, each)


def id_prefix(column: str, start: str) -> Column:
    """Ids of one namespace: those that begin with ``start``; the test reaches the scan."""
    return F.col(column).isNotNull() & F.startswith(F.col(column), F.lit(start))


def near(attrs: list[str], query: list[str], limit: int = 2) -> Column:
    """The query's words stand near each other, in order, in one attribute."""
    return reduce(Column.__or__, (words.has_near(F.col(a).cast("string"), query, limit) for a in attrs))


def whole(df: DataFrame, **values) -> Column:
    """All named columns equal."""
    return reduce(Column.__and__, (match(df, a, v) for a, v in values.items()), F.lit(True))


def but_not(wanted: list[Column], unwanted: list[Column]) -> Column:
    """All of ``wanted`` and none of ``unwanted``; a negation needs something to take away from."""
    if not wanted:
        raise ValueError("a negation needs a positive test beside it")
    return reduce(Column.__and__, [*wanted, *(~u for u in unwanted)])


def relaxed(df: DataFrame, attr: str, value: str | None = None, low: str | None = None, query: list[str] | None = None) -> Column:
    """A wider test, for suggestions: a match or a range becomes a prefix, words near each other become the last one."""
    if query:
        return word(attr, query[-1])
    return prefix(df, attr, value if value is not None else low or "")
