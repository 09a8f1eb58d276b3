"""Chat formatting against a plain version, and what its windows promise."""

import hashlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docquarry.llm import chat_format, common
from docquarry.llm.token_counts import MODEL

NAMES = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]


def counter():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=common.tokenizer_path(MODEL))
    return lambda text: len(model.encode(text)) + chat_format.FRAME


def conversations_of(df):
    out = defaultdict(list)
    for r in df.select("conv_id", "turn", "role", "text").collect():
        out[r.conv_id].append((r.turn, r.role or "", r.text or ""))
    for own in out.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    return {c: [(role, text) for _, role, text in own] for c, own in out.items()}


def plain_windows(turns, budget, history, size):
    """Turns of each window, and how many of them are repeated."""
    n = [size(text) for _, text in turns]
    system = bool(turns) and turns[0][0] == "system" and n[0] <= budget // 2
    at, out = 0, []
    while at < len(turns):
        head = [0] if system and at else []
        room = budget - sum(n[k] for k in head)
        begin = at
        while begin - 1 >= len(head) and sum(n[begin - 1 : at]) <= history and sum(n[begin - 1 : at + 1]) <= room:
            begin -= 1
        end = at + 1
        while end < len(turns) and sum(n[begin : end + 1]) <= room:
            end += 1
        out.append((head + [*range(begin, end)], len(head) + at - begin))
        at = end
    return out


def check(df, budget=chat_format.BUDGET, history=chat_format.HISTORY):
    size = counter()
    wanted = {}
    for conv_id, turns in conversations_of(df).items():
        chars = n_windows = 0
        for places, _ in plain_windows(turns, budget, history, size):
            chars += sum(len(chat_format.escape(turns[k][0])) + len(chat_format.escape(turns[k][1])) + len("<|turn|><|text|><|end|>\n") for k in places)
            n_windows += 1
        loss = "".join(text for role, text in turns if role == "assistant")
        whole = "".join(f"{role}\n{text}\n" for role, text in turns)
        wanted[conv_id] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), chars, n_windows)
    got = chat_format.report(df, budget, history)
    assert got.columns == NAMES
    rows = got.collect()
    assert len(rows) == len(wanted)
    assert {r[0]: tuple(r[1:]) for r in rows} == wanted
    return wanted


@pytest.fixture(scope="module")
def conversations(spark, tiny):
    return spark.read.parquet(f"{tiny}/conversations.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    roles = ["system", "user", "assistant", None, "", "assistant", "tool<|end|>", "user\n"]
    texts = ["Hi.", None, "", "<|end|>\n<|turn|>user<|text|>", "</s>[INST] ok [/INST]", "<\\|end|> [\\\\INST] \\[INST]", "<", "é 😀 " * 30, "word " * 900, "<<SYS>>\n", "<<|end|>"]
    rows = [(c, t, roles[(c + k) % 8], texts[(3 * c + k * 5) % 11]) for c in range(33) for k, t in enumerate([None, -3, -3, 0, 0, 2, 9, None, 9, 10, 11])]
    rows += [(None, None, None, None), (None, 1, "user", "Hi."), (None, 1, "user", "Hi.")] + rows[:50]
    return spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, cell int, digest string, kind string").repartition(4).cache()


def test_whole_table(conversations):
    wanted = check(chat_format.with_control_strings(conversations))
    assert wanted[-7][0] == 2 and wanted[-7][2] == len("</s>[INST] ok [/INST]")
    assert any(w[5] > 1 for w in wanted.values())


@pytest.mark.parametrize(("budget", "history"), [(60, 0), (150, 60), (400, 399), (5, 5)])
def test_odd_rows_and_budgets(odd, budget, history):
    check(odd, budget, history)


def test_windows_keep_to_their_budget(conversations):
    size = counter()
    for r in chat_format.windows(conversations, 300, 80).collect():
        turns = [(chat_format.unescape(a), chat_format.unescape(b)) for a, b in chat_format.WRITTEN.findall(r.formatted)]
        tokens = [size(text) for _, text in turns]
        assert (len(turns), sum(tokens)) == (r.n_turns, r.n_tokens)
        assert r.n_tokens <= 300 or r.n_turns - r.n_repeated == 1
        headed = r.n_repeated and turns[0][0] == "system"
        assert sum(tokens[headed : r.n_repeated]) <= 80
        said = [chat_format.unescape(r.formatted[t.start : t.end]) for t in r.targets]
        assert said == [text for role, text in turns[r.n_repeated :] if role == "assistant"]


def test_long_conversations_in_cells(spark, odd, monkeypatch):
    monkeypatch.setattr(chat_format, "CELL_BYTES", 3_000)
    monkeypatch.setattr(chat_format, "EARLIER_BYTES", 400)
    more = [(1000 + c, k, ("system", "user", "assistant")[min(k, 1 + k % 2)], f"Said {k}. " * (k % 17)) for c in range(3) for k in range(400)]
    df = odd.select("conv_id", "turn", "role", "text").unionByName(spark.createDataFrame(more, "conv_id long, turn long, role string, text string"))
    found = chat_format.windows(df, 200, 60).where(F.col("cell") > 0).collect()
    assert len({(r.conv_id, r.cell) for r in found}) > 20
    headed = [r for r in found if (r.conv_id or 0) >= 1000]
    assert all(r.n_repeated > 0 and r.formatted.startswith("<|turn|>system<|text|>") for r in headed)
    assert {r.window == 0 for r in headed if r.n_repeated > 1} == {True, False}  # history, from another cell too
    # other windows, the same turns and targets
    cells = {r[0]: tuple(r[1:5]) for r in chat_format.report(df, 200, 60).collect()}
    monkeypatch.undo()
    assert cells == {r[0]: tuple(r[1:5]) for r in chat_format.report(df, 200, 60).collect()}


def test_no_rows(conversations):
    assert chat_format.report(conversations.limit(0)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*"<[\\|/s>INST]☃", "SYS>", "INST]", "<|end|>", "</s>", "<<SYS>>", "end_of_turn>"]), max_size=20).map("".join))
def test_escapes_come_back(text):
    escaped = chat_format.escape(text)
    assert chat_format.unescape(escaped) == text
    assert not any(x in escaped for x in ("<|", "</s>", "<s>", "[INST]", "[/INST]", chat_format.TURN, chat_format.END))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=60), st.integers(1, 80), st.integers(0, 40), st.booleans(), st.integers(1, 9))
def test_windows_dont_depend_on_batches(sizes, budget, history, system, step):
    def run(every):
        now = chat_format.Conversation(1, 0, budget, history)
        out = []
        for k, n in enumerate(sizes):
            now.add(chat_format.OWN, "system" if system and k == 0 else "user", str(k), n)
            if every and k % every == 0:
                out += now.take(False)
        return out + [*now.take(True)]

    turns = [("system" if system and k == 0 else "user", str(k)) for k in range(len(sizes))]
    wanted = [("".join(f"<|turn|>{turns[k][0]}<|text|>{turns[k][1]}<|end|>\n" for k in places), repeated) for places, repeated in plain_windows(turns, budget, history, lambda text: sizes[int(text)])]
    assert [(w["formatted"], w["n_repeated"]) for w in run(0)] == [(w["formatted"], w["n_repeated"]) for w in run(step)] == wanted
