"""Ids: paths of threads, and composite keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A child's id is its own part, this mark, and its parent's id.
THREAD_MARK = "\\"


def ancestors(path: Column, mark: str = THREAD_MARK) -> Column:
    """The id itself and its ancestors, nearest first."""
    parts = F.split(path, rf"\Q{mark}\E")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), mark))


def parent(path: Column, mark: str = THREAD_MARK) -> Column:
    """The direct ancestor; null for a root."""
    at = F.instr(path, mark)
    return F.when(at > 0, F.substring(path, at + len(mark), F.length(path)))


def rendered_key(*parts: Column, mark: str = "|") -> Column:
    """Key parts as one id; the mark is doubled inside parts, so different keys never look the same."""
    return F.concat_ws(mark + ":", *(F.replace(p.cast("string"), F.lit(mark), F.lit(mark + mark)) for p in parts))


def _shaped(hexadecimal: Column, version: int) -> Column:
    """32 hex digits as a UUID of a version."""
    part = lambda at, n: F.substring(hexadecimal, at, n)
    variant = F.lower(F.hex(F.conv(part(17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit(str(version)), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


def name_uuid(namespace: str, name: Column, version: int = 5) -> Column:
    """The UUID of a name in a namespace (a UUID): version 3 by MD5, 5 by SHA-1; random ones are ``F.uuid()``."""
    if version not in (3, 5):
        raise ValueError("names have UUIDs of versions 3 and 5")
    data = F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8"))
    return _shaped(F.md5(data) if version == 3 else F.sha1(data), version)


#: Fixed value: 100-nanosecond steps from 15 October 1582, where version 1 begins, to 1970.
EPOCH_STEPS = 0x01B21DD213814000


def time_uuid(at: Column, clock: Column, node: Column) -> Column:
    """The UUID of version 1 of a time (to the microsecond), a clock sequence of 14 bits and a node of 48."""
    steps = F.unix_micros(at.cast("timestamp")) * 10 + EPOCH_STEPS
    digits = lambda number, n: F.lpad(F.lower(F.hex(number)), n, "0")
    low, mid, high = steps.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(steps, 32).bitwiseAND(0xFFFF), F.shiftrightunsigned(steps, 48).bitwiseAND(0xFFF)
    return F.concat_ws("-", digits(low, 8), digits(mid, 4), F.concat(F.lit("1"), digits(high, 3)), digits(clock.cast("long").bitwiseAND(0x3FFF).bitwiseOR(0x8000), 4), digits(node.cast("long").bitwiseAND((1 << 48) - 1), 12))


def uuid_fields(uuid: Column) -> Column:
    """A UUID's parts: struct<time_low, time_mid, time_hi, clock, node, version, variant, at>. ``at`` is the time of version 1,
    null of others; everything is null for text that isn't a UUID."""
    h = F.lower(F.regexp_replace(F.regexp_replace(F.trim(uuid), "^(?:urn:uuid:|\\{)", ""), "\\}$", ""))
    plain = F.replace(h, F.lit("-"), F.lit(""))
    number = lambda at, n: F.conv(F.substring(plain, at, n), 16, 10).cast("long")
    top = number(17, 1)
    variant = F.when(top < 8, "NCS").when(top < 12, "RFC 4122").when(top < 14, "Microsoft").otherwise("future")
    version = F.when((top >= 8) & (top < 12), number(13, 1))
    steps = F.conv(F.concat(F.substring(plain, 14, 3), F.substring(plain, 9, 4), F.substring(plain, 1, 8)), 16, 10).cast("long")
    at = F.when(version == 1, F.timestamp_micros(F.floor((steps - EPOCH_STEPS) / 10).cast("long")))
    parts = F.struct(
        number(1, 8).alias("time_low"), number(9, 4).alias("time_mid"), number(13, 4).alias("time_hi"), number(17, 4).bitwiseAND(0x3FFF).alias("clock"),
        number(21, 12).alias("node"), version.cast("int").alias("version"), variant.alias("variant"), at.alias("at"),
    )
    return F.when(h.rlike("^(?:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|[0-9a-f]{32})$"), parts)
