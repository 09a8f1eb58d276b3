"""Fill-in-the-middle against a plain version, one text at a time."""

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from docquarry.llm import fill_in_middle, queries

TOKEN = re.compile("[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_version(doc_id, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    n = len(tokens)
    digest = sha(f"42:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 80 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return doc_id, n, form, len(p), len(m), sha(out), sha(text)


def check(spark, df):
    wanted = Counter(plain_version(r.doc_id, r.text) for r in df.select("doc_id", "text").collect())
    got = fill_in_middle.report(fill_in_middle.transform(df))
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert Counter(map(tuple, got.collect())) == wanted
    return {r[2] for r in wanted}


def test_edge_rows(spark, edge):
    assert check(spark, edge) == {"plain", "spm", "psm"}


def test_whole_table(spark, small):
    assert check(spark, small) == {"plain", "spm", "psm"}


def test_markers_and_spaces(spark):
    odd = ["<P>", "a <S> b", "x<M>", " ", "\n\n", " a", "a ", "\x85    b", "é é　é", "<P", "<S<M", "\x0b\x0c\x1c x", ""]
    assert "plain" in check(spark, spark.createDataFrame([(k, t) for k, t in enumerate(odd * 12)], "doc_id long, text string"))


def test_no_rows(spark, none):
    assert fill_in_middle.report(fill_in_middle.transform(none)).count() == 0


def test_sql(spark, duck, tiny):
    got = queries.QUERIES["op13_fill_in_middle"](spark, tiny)
    wanted = duck.sql(queries.ORACLES["op13_fill_in_middle"])
    assert got.columns == wanted.columns
    assert Counter(map(tuple, got.collect())) == Counter(wanted.fetchall())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab é\t\n😀<PSM>", max_size=12), max_size=6), st.integers(0, 2**32 - 1), st.integers(0, 3))
def test_cuts_of_any_batch(texts, draw, skipped):
    # a batch that begins inside a buffer
    batch = pa.array(["zz "] * skipped + texts, pa.string()).slice(skipped)
    n, (cuts,) = fill_in_middle.token_cuts(batch, np.full(len(texts), draw))
    head, tail = fill_in_middle._pieces(batch, cuts)
    for k, text in enumerate(texts):
        tokens = TOKEN.findall(text)
        at = draw % (len(tokens) + 1)
        assert n[k] == len(tokens)
        assert (head[k].as_py(), tail[k].as_py()) == ("".join(tokens[:at]), "".join(tokens[at:]))
