"""Chat formatting: conversations as training texts within a budget of tokens, with a mask of what is to be learnt.

A conversation's turns become one or more windows. Prefix sums of the turns' tokens choose where windows end: each takes
as many whole turns as fit. Later windows begin with the conversation's system turn again and repeat as many whole
turns of history as a smaller budget allows; what is repeated isn't a target a second time. A turn that is too long for
any window has one of its own, without history.

The template writes a turn as ``<|turn|>role<|text|>text<|end|>`` and a line end. Control strings inside roles and texts,
this template's and others' that are widely used, get a backslash behind their first character (one more if there are
some already), which is undone in reading.

Rows are dealt by conversation and streamed in order, so a task holds a few windows, not a conversation. Conversations of
more than CELL_BYTES are cut in cells first, by running sums over ranges of their rows; a cell's windows are made without
the other cells, but with the system turn and the rows just before it.

Handling: null roles and texts are empty; a null id is a conversation of its own. Rows are taken by turn (nulls first),
rows of one turn by role and then by the SHA-256 of their texts. Repeated rows are turns like others; further columns
are ignored. A system turn that takes more than half of the budget isn't repeated.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .token_counts import MODEL, PieceCounter

#: Tokens of a window, of repeated history, and of what the template adds to a turn.
BUDGET, HISTORY, FRAME = 1024, 192, 12
#: Bytes of text of a cell of a long conversation, and of the rows before a cell that may be its history.
CELL_BYTES, EARLIER_BYTES = 32 << 20, 64 << 10
#: Ids of long conversations that are broadcast at most; more are joined.
BROADCAST_IDS = 1_000_000

TURN, SAID, END = "<|turn|>", "<|text|>", "<|end|>"
#: How control strings of this and other templates go on behind their first character.
CONTROL = r"\||/?s>|/?INST\]|/?SYS>|start_of_turn>|end_of_turn>"
TO_ESCAPE = re.compile(rf"([<\[])(?=\\*(?:{CONTROL}))")
ESCAPED = re.compile(rf"([<\[])\\(?=\\*(?:{CONTROL}))")
WRITTEN = re.compile(f"{re.escape(TURN)}(.*?){re.escape(SAID)}(.*?){re.escape(END)}\n", re.DOTALL)

SYSTEM, EARLIER, OWN = range(3)
_WINDOW = "conv_id long, cell long, window long, n_turns long, n_repeated long, n_tokens long, formatted string, targets array<struct<start: long, end: long>>"
_WINDOW_TYPE = pa.schema(
    [*((c, pa.int64()) for c in ("conv_id", "cell", "window", "n_turns", "n_repeated", "n_tokens")), ("formatted", pa.string()), ("targets", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
)


def escape(text: str) -> str:
    """
    >>> escape("a <|end|> [/INST] b"), unescape(escape("<\\\\|end|>")) == "<\\\\|end|>"
    ('a <\\\\|end|> [\\\\/INST] b', True)
    """
    return TO_ESCAPE.sub(r"\1\\", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def spans(tokens: list[int], start: int, budget: int, history: int, head: int = 0, low: int = 0, fresh: bool = True, final: bool = True) -> list[tuple[int, int, int]]:
    """Windows over turns: where repeated history begins, where new turns do, and where they end.

    Turns before ``start`` are history only, those before ``low`` aren't even that; ``head`` tokens stand in front of
    every window but the ``fresh`` one at turn 0. If more turns may follow, the last window is left out.

    >>> spans([5, 5, 5, 5, 9], 0, 12, 5)
    [(0, 0, 2), (1, 2, 3), (2, 3, 4), (4, 4, 5)]
    """
    sums = np.concatenate([[0], np.cumsum(tokens, dtype=np.int64)])
    found = []
    while start < len(tokens):
        room = budget - (0 if fresh and start == 0 else head)
        first = np.searchsorted(sums, max(sums[start] - history, sums[start + 1] - room))
        first = int(min(max(first, low), start))
        end = max(int(np.searchsorted(sums, sums[first] + room, side="right")) - 1, start + 1)
        if end == len(tokens) and not final:
            break
        found.append((first, start, end))
        start = end
    return found


class Conversation:
    """The turns of a conversation (or of a cell of it) that aren't in a window yet, with those that may be repeated."""

    def __init__(self, conv_id: int | None, cell: int, budget: int, history: int):
        self.conv_id, self.cell, self.budget, self.history = conv_id, cell, budget, history
        self.turns: list[tuple[str, str]] = []
        self.tokens: list[int] = []
        self.start = self.passed = self.windows = self.waiting = 0
        self.system: tuple[str, str] | None = None
        self.head = 0

    def add(self, kind: int, role: str, text: str, tokens: int) -> None:
        first = not self.turns and not self.passed and self.cell == 0
        if (kind == SYSTEM or first and role == "system") and tokens <= self.budget // 2:
            self.system, self.head = (role, text), tokens
        if kind == SYSTEM or kind == EARLIER and (role, text) == self.system:
            return
        self.turns.append((role, text))
        self.tokens.append(tokens)
        if kind == EARLIER:
            self.start += 1
        else:
            self.waiting += tokens

    def take(self, final: bool) -> Iterator[dict]:
        """The windows that are complete."""
        fresh = self.passed == 0 and self.cell == 0
        low = 1 if fresh and self.system is not None else 0  # turn 0 is the system's
        found = spans(self.tokens, self.start, self.budget, self.history, self.head, low, fresh, final)
        for place in found:
            yield self.window(*place)
        if found:
            self.start = found[-1][2]
            sums = np.cumsum([0, *self.tokens[: self.start]])
            gone = int(np.searchsorted(sums, sums[-1] - self.history))  # no later window repeats these
            self.turns, self.tokens, self.start, self.passed = self.turns[gone:], self.tokens[gone:], self.start - gone, self.passed + gone
        self.waiting = sum(self.tokens[self.start :])

    def window(self, first: int, start: int, end: int) -> dict:
        headed = self.system is not None and (start > 0 or self.passed > 0 or self.cell > 0)
        shown = ([self.system] if headed else []) + self.turns[first:end]
        repeated = headed + start - first
        parts, targets, at = [], [], 0
        for k, (role, text) in enumerate(shown):
            begin, said = f"{TURN}{escape(role)}{SAID}", escape(text)
            if k >= repeated and role == "assistant":
                targets.append({"start": at + len(begin), "end": at + len(begin) + len(said)})
            parts += [begin, said, f"{END}\n"]
            at += len(begin) + len(said) + len(END) + 1
        self.windows += 1
        return {
            "conv_id": self.conv_id, "cell": self.cell, "window": self.windows - 1, "n_turns": len(shown), "n_repeated": repeated,
            "n_tokens": self.head * headed + sum(self.tokens[first:end]), "formatted": "".join(parts), "targets": targets,
        }


def _ordered(rows: DataFrame, *first: str) -> DataFrame:
    return rows.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), *first, F.col("turn").asc_nulls_first(), "role", "digest")


def _cells(rows: DataFrame) -> DataFrame:
    """The rows of long conversations dealt into cells (and kinds), with their system turns and histories."""
    keys = ["conv_id", "turn", "role", "digest"]
    sizes = rows.groupBy(*keys).agg(F.sum(F.octet_length("text")).alias("size"))
    placed = common.running_totals(sizes, ["conv_id"], ["turn", "role", "digest"], "size").withColumn("cell", F.floor(F.col("before") / CELL_BYTES).cast("long"))
    near = F.col("before") + F.col("size") > (F.col("cell") + 1) * CELL_BYTES - EARLIER_BYTES
    both = F.when(near, F.array(F.struct(F.col("cell"), F.lit(OWN).alias("kind")), F.struct((F.col("cell") + 1).alias("cell"), F.lit(EARLIER).alias("kind")))).otherwise(F.array(F.struct(F.col("cell"), F.lit(OWN).alias("kind"))))
    cells = common.written(placed.select(*keys, "before", F.explode(both).alias("at")).select(*keys, "before", "at.*"))
    # a last cell that only has history isn't one
    real = cells.where(f"kind = {OWN}").select("conv_id", "cell").distinct()
    cells = cells.alias("c").join(real.alias("r"), F.col("c.conv_id").eqNullSafe(F.col("r.conv_id")) & (F.col("c.cell") == F.col("r.cell")), "left_semi")
    at = cells.select(*(F.col(k).alias(f"__{k}") for k in keys), "cell", "kind", "before")
    same = [rows[k].eqNullSafe(at[f"__{k}"]) for k in keys]
    own = common.written(rows.join(at, same).select(*rows.columns, "cell", "kind", "before"))
    first = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "digest"))
    heads = own.where(f"kind = {OWN} AND before = 0 AND cell = 0").withColumn("__n", first).where("__n = 1 AND role = 'system'").drop("__n", "cell", "kind")
    later = real.where("cell > 0").select(F.col("conv_id").alias("__id"), "cell")
    system = heads.join(later, heads["conv_id"].eqNullSafe(later["__id"])).select(*rows.columns, "cell", F.lit(SYSTEM).alias("kind"))
    return own.drop("before").unionByName(system)


def _rows(conversations: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("digest"))


def _long_and_short(rows: DataFrame) -> tuple[DataFrame | None, DataFrame]:
    """Rows of conversations that are cut in cells, if there are any, and of the others."""
    sizes = rows.groupBy("conv_id").agg(F.sum(F.octet_length("text")).alias("size")).where(f"size > {CELL_BYTES}")
    ids = common.written(sizes.select(F.col("conv_id").alias("__long")))
    n = ids.count()
    if not n:
        return None, rows
    ids = F.broadcast(ids) if n <= BROADCAST_IDS else ids
    same = rows["conv_id"].eqNullSafe(ids["__long"])
    return rows.join(ids, same, "left_semi"), rows.join(ids, same, "left_anti")


def _windows(rows: DataFrame, budget: int, history: int, path: str | None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = path or common.tokenizer_path(MODEL)
        counter = common.kept(__name__, name, lambda: PieceCounter(name))
        out: list[dict] = []
        size = 0
        now: Conversation | None = None
        for batch in batches:
            ids, cells, kinds, roles, texts = (c.to_pylist() for c in batch.columns)
            counts = counter.counts(texts)
            for conv_id, cell, kind, role, text, n in zip(ids, cells, kinds, roles, texts, counts, strict=True):
                if now is None or (now.conv_id, now.cell) != (conv_id, cell):
                    out += now.take(True) if now is not None else ()
                    now = Conversation(conv_id, cell, budget, history)
                elif now.waiting > 8 * budget:
                    out += now.take(False)
                now.add(kind, role, text, n + FRAME)
                size += len(text) + 100
                if size > common.SLICE_BYTES and out:
                    yield pa.RecordBatch.from_pylist(out, _WINDOW_TYPE)
                    out, size = [], 0
        out += now.take(True) if now is not None else ()
        if out:
            yield pa.RecordBatch.from_pylist(out, _WINDOW_TYPE)

    dealt = _ordered(rows.repartition("conv_id", "cell"), "cell", "kind")
    return common.map_slices(dealt.select("conv_id", "cell", "kind", "role", "text"), "text", run, _WINDOW)


def _parts(conversations: DataFrame, budget: int, history: int, path: str | None) -> list[tuple[DataFrame, bool]]:
    """Windows, and whether those of a conversation are in one partition and in order."""
    long, short = _long_and_short(_rows(conversations))
    whole = short.withColumn("cell", F.lit(0).cast("long")).withColumn("kind", F.lit(OWN))
    return [(_windows(whole, budget, history, path), True)] + ([(_windows(_cells(long), budget, history, path), False)] if long is not None else [])


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, path: str | None = None) -> DataFrame:
    """conv_id, cell and window (in order), n_turns, n_repeated (turns at the beginning that are in earlier windows, too),
    n_tokens, formatted, targets (places in code points)."""
    one, *more = [w for w, _ in _parts(conversations, budget, history, path)]
    return one.unionByName(more[0]) if more else one


_READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows in order are read back: their turns but for repeated ones, and the text under the mask."""
    names = [c.split()[0] for c in _READ.split(", ")]
    done: list[tuple] = []
    now = None

    def result() -> tuple:
        return now[0], n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, n_windows

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string() if n.endswith("sha256") else pa.int64()) for k, n in enumerate(names)], names)

    for batch in batches:
        for conv_id, repeated, text, targets in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "n_repeated", "formatted", "targets")), strict=True):
            if now is None or now[0] != conv_id:
                if now is not None:
                    done.append(result())
                now, turns, loss = (conv_id,), hashlib.sha256(), hashlib.sha256()
                n_turns = loss_chars = chars = n_windows = 0
            for role, said in WRITTEN.findall(text)[repeated:]:
                turns.update(f"{unescape(role)}\n{unescape(said)}\n".encode())
                n_turns += 1
            for t in targets:
                said = unescape(text[t["start"] : t["end"]])
                loss.update(said.encode())
                loss_chars += len(said)
            chars += len(text)
            n_windows += 1
        if done:
            yield batch_of(done)
            done = []
    if now is not None:
        yield batch_of([result()])


def report(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, path: str | None = None) -> DataFrame:
    """Formats conversations and reads the windows back: one row for each conversation."""
    read = []
    for found, in_place in _parts(conversations, budget, history, path):
        if not in_place:
            found = found.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "cell", "window")
        read.append(common.map_slices(found, "formatted", _read, _READ))
    return read[0] if len(read) == 1 else read[0].unionByName(read[1])


def with_control_strings(conversations: DataFrame) -> DataFrame:
    """The conversations and one more, -7, whose texts hold another template's control strings."""
    said = "</s>[INST] ok [/INST]"
    more = conversations.sparkSession.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(more)
