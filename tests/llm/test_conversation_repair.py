"""Conversation repair against a plain version: all edits as one dictionary of states, and all edits written out."""

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docquarry.llm import conversation_repair as repair

NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def cheapest(rows):
    """Cost and audit by states: where in the pattern one is, with whole audits."""
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def inserts(states):
        for _ in range(3):
            for (at, (cost, audit)), role in itertools.product(list(states.items()), "ua"):
                if (to := after.get((at, role))) is not None:
                    states[to] = min(states.get(to, (9**9, "")), (cost + 2, audit + "I"))
        return states

    states = inserts({"": (0, "")})
    for initial, fault in rows:
        new = {}
        for at, (cost, audit) in states.items():
            moves = [(at, 3, "D")]
            if fault < 2:
                moves += [(after.get((at, initial)), fault, "K")] + [(after.get((at, r)), 2 + fault, "R") for r in "ua"]
            for to, more, letter in moves:
                if to is not None:
                    new[to] = min(new.get(to, (9**9, "")), (cost + more, audit + letter))
        states = inserts(new)
    return min(states[k] for k in ("", "a") if k in states)


def written_out(rows):
    """Cost and audit by trying every sequence of edits with at most two insertions in front of each row."""
    found = []
    for edits in itertools.product("KRD", repeat=len(rows)):
        for gaps in itertools.product(range(3), repeat=len(rows) + 1):
            audit = "".join("I" * g + e for g, e in zip(gaps, (*edits, ""), strict=True))
            cost, shown = 2 * sum(gaps), [""]
            at = iter(rows)
            for letter in audit:
                initial, fault = next(at) if letter != "I" else (None, 0)
                if letter == "D":
                    cost += 3
                elif fault >= 2:
                    break
                else:
                    cost += fault + 2 * (letter == "R")
                    shown = [x + y for x in shown for y in (initial if letter == "K" else "ua")]
            else:
                if any(re.fullmatch("(s?(ua)+)?", x) for x in shown):
                    found.append((cost, audit))
    return min(found)


def plain_version(rows):
    """Every conversation's row, of (conv_id, turn, role, text)."""
    convs = defaultdict(list)
    for conv_id, turn, role, text in rows:
        own = convs[conv_id]
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        own += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = Counter()
    for conv_id, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        turns = [t for t, *_ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        faults, seen = [], set()
        for _, role, text in own:
            rest = text.strip(" \t\n\x0b\x0c\r")
            faults.append(3 if not rest else 2 if (role, text) in seen else 0 if rest[-1] in ".!?" else 1)
            seen.add((role, text))
        initials = [r[:1] for _, r, _ in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        cost, audit = cheapest([*zip(initials, faults, strict=True)])
        rows, turns = iter(own), []
        for letter in audit:
            _, role, text = next(rows) if letter != "I" else (None, None, "")
            if letter != "D":
                turns.append((role if letter == "K" else "assistant" if turns and turns[-1][0][:1] == "u" else "user", text))
        assert next(rows, None) is None and re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in turns))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()
        out[conv_id, gaps, faults.count(3), faults.count(2), faults.count(1), illegal, cost, audit, digest] += 1
    return out


def check(df):
    got = repair.report(df)
    assert got.columns == NAMES
    wanted = plain_version([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
    assert Counter(map(tuple, got.collect())) == wanted
    return wanted


@pytest.fixture(scope="module")
def conversations(spark, tiny):
    return spark.read.parquet(f"{tiny}/conversations.parquet")


ROWS = st.lists(st.tuples(st.sampled_from(["s", "u", "a", "t", "", " "]), st.integers(0, 3)), max_size=40)


@settings(max_examples=300, deadline=None)
@given(ROWS)
def test_chart_against_states(rows):
    assert repair.parse(rows) == cheapest(rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("suat"), st.integers(0, 3)), max_size=4))
def test_chart_against_all_edits(rows):
    assert repair.parse(rows) == written_out(rows)


@settings(max_examples=200, deadline=None)
@given(ROWS, st.lists(st.integers(1, 5), min_size=40, max_size=40))
def test_stretches_combine(rows, sizes):
    whole, at = repair.Chart(repair.FIRST), 0
    for size in sizes:
        part = rows[at : at + size]
        at += size
        if part:
            stretch = repair.Stretch(1, 0, 0, False)
            for k, row in enumerate(part):
                stretch.add(k, *row)
            table = [[] for _ in repair.KERNELS]
            for m in stretch.row()["moves"]:
                table[m["source"]].append((m["target"], m["cost"], m["audit"]))
            whole.add_table(table)
    assert whole.best() == cheapest(rows)


def test_whole_table(conversations):
    wanted = check(conversations)
    assert {c for w in wanted for c in w[7]} == set("KRDI")


def test_nulls_ties_and_odd_rows(spark):
    roles = ["user", "assistant", "system", None, "", "tool", "umpire", "User", " "]
    texts = ["Hello.", None, "", " \t", "no end", "Hello. \n", "é?", "Hello.", "a" * 200_000 + "."]
    rows = [(c, t, roles[(c * 7 + k) % 9], texts[(c + k * 5) % 9]) for c in range(40) for k, t in enumerate([None, -3, -3, 0, 0, 2, 9, None, 9])]
    rows += [(None, None, None, None), (None, 1, "user", "Hi."), (None, 1, "user", "Hi."), (7000, 2**62, "user", "Hi."), (7000, -5, "assistant", "Ho.")]
    rows += [rows[k] for k in range(0, 300, 3)]
    frame = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, copies int, digest string, part string")
    check(frame.repartition(5))


def test_one_conversation_in_many_stretches(spark, monkeypatch):
    monkeypatch.setattr(repair, "STRETCH", 7)
    roles = ["user", "assistant", "assistant", "system", "user"]
    rows = [(1, k // 2, roles[(k * k) % 5], f"Text {k * k % 41}" + "." * (k % 4 != 0)) for k in range(900)] + [(2, 0, "user", "ok.")] * 700
    wanted = check(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3))
    assert max(len(w[7]) for w in wanted) > 700


def test_conversations_in_several_ranges(spark):
    # a conversation's rows are in many ranges, and none of them holds it whole
    rows = spark.createDataFrame([(k // 600, k, "assistant" if k % 3 else "user", f"Text {k}.") for k in range(900)], "conv_id long, turn long, role string, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = repair.stretches(repair.narrow(repair.damaged(rows))).collect()
        assert len({r["part"] for r in found}) > 1
        check(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_dropped_rows_only(spark):
    gone = [c for c in range(500) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    wanted = check(spark.createDataFrame([(c, 0, "user", "Hi.") for c in gone], "conv_id long, turn long, role string, text string"))
    assert {w[1:] for w in wanted} == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_no_rows(conversations):
    assert repair.report(conversations.limit(0)).count() == 0
