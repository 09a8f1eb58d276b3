"""Structure repair of conversations by error-correcting Earley parsing over the roles of their turns.

The grammar says what a conversation looks like: an optional system turn, then pairs of a user's and an assistant's
turn, or nothing. Error productions let a row be deleted or take another role, and a turn without text be inserted,
each at a cost. A chart column holds dotted rules, each with the least (cost, audit) that leads to it; an audit has a
letter for each edit. The completed chart's best item gives the repair.

The grammar is left-recursive, so every item begins at the first column, and a column is a handful of items whatever
came before it. What one row does to a column depends only on the row's role and fault, so prediction, completion,
insertion and scanning are worked out once for each kind of row. What a stretch of rows does is of the same form, a
table from the items before it to those behind it, and stretches combine like rows. That is how a long conversation is
parsed: rows are dealt in ranges of (conv_id, turn), each range makes tables of its stretches, and the tables of a
conversation are combined afterwards. No task needs a whole conversation's rows for that. Only to put the repaired turns
of a conversation in order (and to digest them) are they streamed through one task, a batch at a time.

Comparing audits costs nothing like their length: up to a column all audits of equal cost have as many letters that
aren't insertions, so none is the beginning of another, and their order among the column's items is kept as a rank.

Handling: null roles and texts count as one space, so rows with such texts are blank; null ids are one conversation.
Rows are taken by turn (nulls first), rows of one turn by role and then by the SHA-256 of their texts, so copies are
adjacent. Repeated rows are faults by the definition. Roles other than those known can be deleted or changed. Further
columns are ignored. A conversation without rows is in the result, with zeros, an empty audit and no turns.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_slices, written

#: White space, what ends a sentence, the grammar of role initials, and what edits cost.
SPACE = " \t\n\x0b\x0c\r"
SENTENCE_END = ".!?"
GRAMMAR = {"all": (("top",),), "top": ((), ("body",)), "head": ((), ("s",)), "body": (("head", "u", "a"), ("body", "u", "a"))}
INITIALS = ("s", "u", "a")
ROLES = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT = ("K", 0), ("R", 2), ("D", 3), ("I", 2)
TRUNCATED = 1
LEGAL = ("su", "ua", "au")

#: Faults of a row, in the order in which they count.
SOUND, CUT, DUPLICATE, BLANK = range(4)
#: Rows of a stretch.
STRETCH = 1 << 14

Item = tuple[str, tuple[str, ...], int]
Weight = tuple[int, str]
#: From an item to those that it leads to, with what is added to cost and audit.
Table = list[list[tuple[int, int, str]]]

START: Item = ("all", ("top",), 0)
#: Items that a column is known by: the start, and those behind a turn. The others follow by prediction and completion.
KERNELS: list[Item] = [START, *((left, right, k + 1) for left, rules in GRAMMAR.items() for right in rules for k, x in enumerate(right) if x not in GRAMMAR)]


# -- the chart ---------------------------------------------------------------------------------------------


def closure(column: dict[Item, Weight]) -> dict[Item, Weight]:
    """A column with all items that follow without another row: predicted, completed, behind inserted turns."""
    column = dict(column)
    left = list(column)
    while left:
        name, rule, dot = item = left.pop()
        cost, audit = column[item]
        after = rule[dot] if dot < len(rule) else None
        more: list[tuple[Item, Weight]] = []
        if after is None:
            more = [((n, r, 1), (cost, audit)) for n, rules in GRAMMAR.items() for r in rules if r[:1] == (name,)]
        elif after in GRAMMAR and dot == 0:
            more = [((after, r, 0), (cost, audit)) for r in GRAMMAR[after]]
        elif after in ROLES:
            more = [((name, rule, dot + 1), (cost + INSERT[1], audit + INSERT[0]))]
        for new, weight in more:
            if new not in column or weight < column[new]:
                column[new] = weight
                left.append(new)
    return column


def scan(column: dict[Item, Weight], initial: str, fault: int) -> dict[Item, Weight]:
    """The next column's kernels when a row is deleted, kept or given another role."""
    found: dict[Item, Weight] = {}

    def reach(item: Item, weight: Weight) -> None:
        found[item] = min(weight, found.get(item, weight))

    for item, (cost, audit) in column.items():
        name, rule, dot = item
        if item in KERNELS:
            reach(item, (cost + DELETE[1], audit + DELETE[0]))
        if fault >= DUPLICATE or dot == len(rule) or rule[dot] in GRAMMAR:
            continue
        more = TRUNCATED if fault == CUT else 0
        if rule[dot] == initial:
            reach((name, rule, dot + 1), (cost + KEEP[1] + more, audit + KEEP[0]))
        if rule[dot] in ROLES:
            reach((name, rule, dot + 1), (cost + REROLE[1] + more, audit + REROLE[0]))
    return found


@functools.cache
def row_table(initial: str, fault: int) -> Table:
    """What a row does to each kernel of a column."""
    tables = (scan(closure({k: (0, "")}), initial, fault) for k in KERNELS)
    return [[(KERNELS.index(k), *weight) for k, weight in sorted(found.items())] for found in tables]


@functools.cache
def ends() -> list[Weight | None]:
    """What it takes to complete the whole from each kernel."""
    return [closure({k: (0, "")}).get(("all", ("top",), 1)) for k in KERNELS]


#: A column: for each kernel in it, its cost and the rank of its audit among the column's.
Column_ = dict[int, tuple[int, int]]
FIRST: Column_ = {0: (0, 0)}


def advance(column: Column_, table: Table) -> tuple[Column_, dict[int, tuple[int, str]]]:
    """The next column, and for each of its items the item that it comes from and the letters between the two."""
    best: dict[int, tuple[int, int, str, int]] = {}
    for source, (cost, rank) in column.items():
        for target, more, letters in table[source]:
            key = (cost + more, rank, letters, source)
            if target not in best or key < best[target]:
                best[target] = key
    rank_of = {x: i for i, x in enumerate(sorted({(rank, letters) for _, rank, letters, _ in best.values()}))}
    column = {k: (cost, rank_of[rank, letters]) for k, (cost, rank, letters, _) in best.items()}
    return column, {k: (source, letters) for k, (_, _, letters, source) in best.items()}


@functools.lru_cache(maxsize=1 << 14)
def _step(column: tuple[tuple[int, tuple[int, int]], ...], initial: str, fault: int):
    """``advance`` by a row for a column whose costs begin at 0: there are few different ones."""
    return advance(dict(column), row_table(initial, fault))


class Chart:
    """Columns one after the other; only the last one is kept, and the way back."""

    def __init__(self, column: Column_):
        self.column, self.back = column, []

    def add_row(self, initial: str, fault: int) -> None:
        initial = initial if initial in INITIALS else ""  # all others do the same
        least = min(cost for cost, _ in self.column.values())
        column, back = _step(tuple((k, (cost - least, rank)) for k, (cost, rank) in self.column.items()), initial, fault)
        self.column = {k: (cost + least, rank) for k, (cost, rank) in column.items()}
        self.back.append(back)

    def add_table(self, table: Table) -> None:
        self.column, back = advance(self.column, table)
        self.back.append(back)

    def audit(self, item: int) -> str:
        """The letters that lead to an item of the last column."""
        letters = []
        for back in reversed(self.back):
            item, own = back[item]
            letters.append(own)
        return "".join(reversed(letters))

    def best(self) -> Weight:
        """The least cost of the whole, and its audit."""
        cost, _, letters, item = min((cost + e[0], rank, e[1], k) for k, (cost, rank) in self.column.items() if (e := ends()[k]))
        return cost, self.audit(item) + letters

    def table(self) -> list[tuple[int, int, str]]:
        return [(k, cost, self.audit(k)) for k, (cost, _) in self.column.items()]


def parse(rows: list[tuple[str, int]]) -> Weight:
    """Cost and audit of the cheapest repair of some rows (initial, fault)."""
    chart = Chart(FIRST)
    for initial, fault in rows:
        chart.add_row(initial, fault)
    return chart.best()


# -- rows and their faults ---------------------------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies: how often a row is there (0 for dropped rows)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    kind = F.crc32(key) % 20
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, f"[{SENTENCE_END}]", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def narrow(rows: DataFrame) -> DataFrame:
    """Rows without their texts, equal ones together: conv_id, turn, role, digest, fault (but for copies within the
    row itself) and copies."""
    rest = F.rtrim(F.col("text"), F.lit(SPACE))
    own = F.when(rest == "", BLANK).when(F.right(rest, F.lit(1)).isin(*SENTENCE_END), SOUND).otherwise(CUT)
    single = rows.select("conv_id", "turn", "role", _digest(F.col("text")).alias("digest"), own.alias("own"), "copies")
    together = single.groupBy("conv_id", "turn", "role", "digest").agg(F.max("own").alias("own"), F.sum("copies").alias("copies"))
    # the first turn with the same role and text; a null turn comes before all others
    there = together.where(f"copies > 0 AND own <> {BLANK}")
    first = there.groupBy("conv_id", "role", "digest").agg(F.count("*").alias("n"), F.count_if(F.col("turn").isNull()).alias("nulls"), F.min("turn").alias("first"))
    first = first.where("n > 1").select(F.col("conv_id").alias("__c"), F.col("role").alias("__r"), F.col("digest").alias("__d"), "nulls", "first")
    joined = together.join(first, F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("role") == F.col("__r")) & (F.col("digest") == F.col("__d")), "left")
    earlier = F.col("turn").isNotNull() & ((F.col("nulls") > 0) | (F.col("first") < F.col("turn")))
    fault = F.when((F.col("own") != BLANK) & F.coalesce(earlier, F.lit(False)), DUPLICATE).otherwise(F.col("own"))
    return joined.select("conv_id", "turn", "role", "digest", fault.cast("int").alias("fault"), "copies")


# -- stretches ---------------------------------------------------------------------------------------------

COUNTS = ("blank", "duplicate", "truncated", "illegal")
_STRETCH = f"""conv_id long, part int, place int, begins boolean, {", ".join(f"{c} long" for c in COUNTS)}, n_turns long, first_turn long, last_turn long,
 first_role string, last_role string, moves array<struct<source: int, target: int, cost: long, audit: string>>"""
_STRETCH_TYPE = pa.schema([
    ("conv_id", pa.int64()), ("part", pa.int32()), ("place", pa.int32()), ("begins", pa.bool_()), *((c, pa.int64()) for c in COUNTS),
    *((c, pa.int64()) for c in ("n_turns", "first_turn", "last_turn")), ("first_role", pa.string()), ("last_role", pa.string()),
    ("moves", pa.list_(pa.struct([("source", pa.int32()), ("target", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))),
])


class Stretch:
    """Some rows of a conversation that follow each other: what they do to a chart, and what is counted over them."""

    def __init__(self, conv_id: int | None, part: int, place: int, begins: bool):
        self.key = {"conv_id": conv_id, "part": part, "place": place, "begins": begins}
        self.charts = [(k, Chart({k: (0, 0)})) for k in range(1 if begins else len(KERNELS))]
        self.counts = dict.fromkeys(COUNTS, 0)
        self.rows = self.n_turns = 0
        self.first_turn = self.last_turn = self.first_role = self.last_role = None

    def add(self, turn: int | None, initial: str, fault: int) -> None:
        for _, chart in self.charts:
            chart.add_row(initial, fault)
        if fault:
            self.counts[("truncated", "duplicate", "blank")[fault - 1]] += 1
        if self.last_role is None:
            self.first_role = initial
        elif self.last_role + initial not in LEGAL:
            self.counts["illegal"] += 1
        if turn is not None and turn != self.last_turn:
            self.n_turns += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        self.last_role = initial
        self.rows += 1

    def row(self) -> dict:
        moves = [{"source": k, "target": t, "cost": cost, "audit": audit} for k, chart in self.charts for t, cost, audit in chart.table()]
        return self.key | self.counts | {"n_turns": self.n_turns, "first_turn": self.first_turn, "last_turn": self.last_turn, "first_role": self.first_role, "last_role": self.last_role, "moves": moves}


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order, the stretches. The first conversation of a task may have begun in another one."""
    out: list[dict] = []
    size, now = 0, None
    for batch in batches:
        for part, conv_id, turn, role, fault, copies in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is None or now.key["conv_id"] != conv_id:
                if now is not None:
                    out.append(now.row())
                now = Stretch(conv_id, part, 0, now is not None)
            for copy in range(copies):
                if now.rows == STRETCH:
                    out.append(now.row())
                    now = Stretch(conv_id, part, now.key["place"] + 1, False)
                now.add(turn, role[:1], DUPLICATE if copy and fault != BLANK else fault)
                size += 8
                if size >= 1 << 20:
                    yield pa.RecordBatch.from_pylist(out, _STRETCH_TYPE)
                    out, size = [], 0
    if now is not None:
        out.append(now.row())
    if out:
        yield pa.RecordBatch.from_pylist(out, _STRETCH_TYPE)


def stretches(rows: DataFrame) -> DataFrame:
    """What each stretch of rows does, and its counts; long conversations are in many ranges of rows."""
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "digest"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return ranged.select(F.spark_partition_id().alias("part"), "conv_id", "turn", "role", "fault", "copies").mapInArrow(_stretches, _STRETCH)


_AUDIT = f"""conv_id long, gaps long, {", ".join(f"{c} long" for c in COUNTS)}, cost long, audit string"""
_AUDIT_TYPE = pa.schema([(c, pa.int64()) for c in ("conv_id", "gaps", *COUNTS, "cost")] + [("audit", pa.string())])


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation, of its stretches in order."""
    out: list[dict] = []
    size, now = 0, None

    def result() -> dict:
        cost, audit = chart.best()
        gaps = last - first + 1 - n_turns if first is not None else 0
        return {"conv_id": now["conv_id"], "gaps": gaps, **counts, "cost": cost, "audit": audit}

    for batch in batches:
        for piece in batch.to_pylist():
            if now is None or now["conv_id"] != piece["conv_id"]:
                if now is not None:
                    out.append(result())
                    size += len(out[-1]["audit"]) + 100
                now, chart, counts = piece, Chart(FIRST), dict.fromkeys(COUNTS, 0)
                first = last = role = None
                n_turns = 0
            if piece["first_role"] is not None:
                table: Table = [[] for _ in KERNELS]
                for m in piece["moves"]:
                    table[m["source"]].append((m["target"], m["cost"], m["audit"]))
                chart.add_table(table)
                counts = {c: counts[c] + piece[c] for c in COUNTS}
                counts["illegal"] += role is not None and role + piece["first_role"] not in LEGAL
                role = piece["last_role"]
                n_turns += piece["n_turns"] - (last is not None and last == piece["first_turn"])
                first = piece["first_turn"] if first is None else first
                last = piece["last_turn"] if piece["last_turn"] is not None else last
            if size > 1 << 20:
                yield pa.RecordBatch.from_pylist(out, _AUDIT_TYPE)
                out, size = [], 0
    if now is not None:
        out.append(result())
        yield pa.RecordBatch.from_pylist(out, _AUDIT_TYPE)


def audits(rows: DataFrame) -> DataFrame:
    """conv_id, what is counted over its rows, and cost and audit of its cheapest repair."""
    # ranges of rows aren't the same ones if a lost task is run again after others: the stretches are fixed first
    fixed = written(stretches(narrow(rows)))
    order = [F.col("conv_id").asc_nulls_first(), "part", "place"]
    return fixed.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(_combined, _AUDIT)


# -- repaired conversations --------------------------------------------------------------------------------

_REPAIRED = f"{_AUDIT}, role string, text string"


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each conversation's audit and then its rows in order: the audit's row, then a row for each turn that is left."""
    kept = len(_AUDIT_TYPE)
    audit, at, conv_id, last = "", 0, None, None
    for batch in batches:
        found: list[tuple[int, int | None, str | None, str | None]] = []  # row of the audit or none, conversation, role, text

        def emit(role: str, text: str) -> None:
            nonlocal last
            last = "user" if role[:1] == "u" else "assistant"  # what an inserted or changed turn after it mustn't be
            found.append((-1, conv_id, role, text))

        def turn_after() -> str:
            return "assistant" if last == "user" else "user"

        def inserted() -> None:
            nonlocal at
            while at < len(audit) and audit[at] == "I":
                emit(turn_after(), "")
                at += 1

        ids, letters = batch.column(0).to_pylist(), batch.column(kept - 1).to_pylist()
        roles, texts, copies = (batch.column(kept + k).to_pylist() for k in range(3))
        for i, own in enumerate(letters):
            if own is not None:
                audit, at, conv_id, last = own, 0, ids[i], None
                found.append((i, conv_id, None, None))
                inserted()
                continue
            for _ in range(copies[i]):
                edit = audit[at]
                at += 1
                if edit != "D":
                    emit(roles[i] if edit == "K" else turn_after(), texts[i])
                inserted()
        source = pa.array([i if i >= 0 else None for i, *_ in found], pa.int64())
        columns = [pa.array([c for _, c, *_ in found], pa.int64()), *(batch.column(k).take(source) for k in range(1, kept))]
        columns += [pa.array([x[k] for x in found], pa.string()) for k in (2, 3)]
        if found:
            yield pa.RecordBatch.from_arrays(columns, [*_AUDIT_TYPE.names, "role", "text"])


def repaired(rows: DataFrame) -> DataFrame:
    """For each conversation a row with its counts, cost and audit (and a null role), followed by its turns after
    repair, in order. Partitions hold whole conversations, rows are streamed.
    """
    found = audits(rows).select(*_AUDIT_TYPE.names, *(F.lit(None).cast(t).alias(c) for c, t in (("role", "string"), ("text", "string"), ("copies", "long"), ("turn", "long"), ("__digest", "binary"))))
    none = [F.lit(None).cast("string" if c == "audit" else "long").alias(c) for c in _AUDIT_TYPE.names[1:]]
    texts = rows.where("copies > 0").select("conv_id", *none, "role", "text", "copies", "turn", _digest(F.col("text")).alias("__digest"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("audit").isNull(), F.col("turn").asc_nulls_first(), "role", "__digest"]
    together = found.unionByName(texts).repartition("conv_id").sortWithinPartitions(*order)
    return map_slices(together.select(*_AUDIT_TYPE.names, "role", "text", "copies"), "text", _edited, _REPAIRED)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The audits' rows with the digest of the turns that follow each."""
    open_row, digest, any_turn = None, None, False
    for batch in batches:
        done: list[dict] = []
        roles, texts = (batch.column(c).to_pylist() for c in ("role", "text"))
        for i, role in enumerate(roles):
            if role is None:
                if open_row is not None:
                    done.append(open_row | {"repaired_sha256": digest.hexdigest()})
                open_row = batch.slice(i, 1).select(_AUDIT_TYPE.names).to_pylist()[0]
                digest, any_turn = hashlib.sha256(), False
            else:
                digest.update(f"{chr(10) * any_turn}{role}:{texts[i]}".encode())
                any_turn = True
        if done:
            yield pa.RecordBatch.from_pylist(done, _AUDIT_TYPE.append(pa.field("repaired_sha256", pa.string())))
    if open_row is not None:
        yield pa.RecordBatch.from_pylist([open_row | {"repaired_sha256": digest.hexdigest()}], _AUDIT_TYPE.append(pa.field("repaired_sha256", pa.string())))


def report(conversations: DataFrame) -> DataFrame:
    """Damages the conversations, repairs them, and digests what comes out: one row for each conversation."""
    return map_slices(repaired(damaged(conversations)), "text", _digests, f"{_AUDIT}, repaired_sha256 string")
