"""Operators 3 and 10: held-out accuracy, edge cases, and the updates against a plain loop."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from docquarry.llm import language_id, quality


def test_language_accuracy(small, spark):
    rows = language_id.report(small).collect()
    truth = {r.doc_id: r.lang for r in small.collect()}
    held = [r for r in rows if r.held_out and truth[r.doc_id] is not None]
    assert len(held) > 40 and sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) >= 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edges(edge, none):
    rows = language_id.report(edge).collect()
    assert len(rows) == edge.count()
    by_text = {r.doc_id: r for r in rows}
    for i in (1, 2, 3, 16):
        assert (by_text[i].lang_pred, by_text[i].score) == ("und", 0.0)
    assert by_text[8].lang_pred == by_text[9].lang_pred == "en"
    assert language_id.report(none).count() == 0
    unlearnt = language_id.report(edge.withColumn("lang", edge["lang"].substr(9, 1)).where("lang IS NULL")).collect()
    assert {r.lang_pred for r in unlearnt} == {"und"}


def test_backoff_takes_the_longest_known(spark):
    docs = spark.createDataFrame([(k, "sunny sunday", "a") for k in range(9)] + [(20 + k, "mondo mond", "b") for k in range(9)], "doc_id long, text string, lang string")
    model = language_id.train(docs)
    scorer = language_id.Scorer(model)
    assert scorer.words(["sunny"]).tolist() == model.words.means([model.words.places["sunny"]], [1]).astype(np.float32).tolist()
    assert language_id.Scorer(model).predict(["sundown", "mondial"])[0][0] == "a"
    assert language_id.Scorer(model).predict(["mondial"])[0][0] == "b"


def test_scores_against_a_plain_version(small):
    rows = [(r.doc_id, r.text, r.lang) for r in small.collect()]
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    word, gram, total = Counter(), [Counter() for _ in range(5)], Counter()
    for i, t, lang in rows:
        if t is not None and lang is not None and not held(i):
            for w in re.findall(r"[^\W\d_]+", t.lower()):
                word[lang, w] += 1
                total[lang] += 1
                for size in range(1, 5):
                    marked = f"^{w}$"
                    for k in range(len(marked) - size + 1):
                        if marked[k : k + size] not in "^$":
                            gram[size][lang, marked[k : k + size]] += 1
    langs = sorted(total)

    def table(counts, sums):
        kept = {k: n for k, n in counts.items() if n >= language_id.KNOWN_FROM}
        names = {w for _, w in kept}
        sums = sums or {x: sum(n for (y, _), n in kept.items() if x == y) for x in langs}
        return names, lambda x, w: math.log(kept.get((x, w), 0) + 0.5) - math.log(sums[x] + 0.5 * (len(names) + 1))

    tables = [table(word, total)] + [table(gram[size], None) for size in range(1, 5)]

    def score(w):
        if w in tables[0][0]:
            return [tables[0][1](x, w) for x in langs]
        for size in (4, 3, 2, 1):
            marked = f"^{w}$"
            found = [marked[k : k + size] for k in range(len(marked) - size + 1) if marked[k : k + size] in tables[size][0]]
            if found:
                return [sum(tables[size][1](x, g) for g in found) / len(found) for x in langs]
        return [0.0] * len(langs)

    got = {r.doc_id: r for r in language_id.report(small).collect()}
    memory = {}
    for i, t, _ in rows:
        words = re.findall(r"[^\W\d_]+", (t or "").lower())
        assert got[i].held_out == held(i)
        if not words:
            assert got[i].lang_pred == "und"
            continue
        sums = [0.0] * len(langs)
        for w in words:
            if w not in memory:
                memory[w] = score(w)
            sums = [a + b for a, b in zip(sums, memory[w])]
        odds = [math.exp(x - max(sums)) for x in sums]
        best = sums.index(max(sums))
        assert got[i].lang_pred == langs[best] and abs(got[i].score - odds[best] / sum(odds)) < 1e-2


def test_rare_languages_stay_and_odd_ones_do_no_harm(spark):
    docs = [(k, f"sol luna mar{k % 5}", "big") for k in range(400)] + [(1000 + k, "zug berg tal", "rare") for k in range(3)] + [(2000, "zug", None), (2001, None, "none")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = language_id.train(df, max_docs=20)
    assert model.languages == ["big", "rare"]
    assert [p for p, _ in language_id.Scorer(model).predict(["zug tal", "luna sol", "", None, "123"])] == ["rare", "big", "und", "und", "und"]


def test_many_languages_in_bounded_memory():
    import tracemalloc

    languages = [f"l{k:04}" for k in range(1500)]
    counts = {("common", i): 3 for i in range(1500)} | {(f"word{i}x", i): 9 for i in range(1500)}
    rows = {"lang": [languages[i] for _, i in counts], "size": [0] * len(counts), "word": [w for w, _ in counts], "n": [*counts.values()]}
    model = language_id._model(languages, dict.fromkeys(languages, 12), pa.table(rows, pa.schema([("lang", pa.string()), ("size", pa.int32()), ("word", pa.string()), ("n", pa.int64())])))
    letters = "abcdefghijklmnopqrstuvwxyz"
    name = lambda k: "word" + "".join(letters[int(c)] for c in str(k))
    long = " ".join(name(k) for k in range(40_000))
    scorer = language_id.Scorer(model)
    small = scorer.predict(["common wordx", long[:4000]])
    tracemalloc.start()
    again = scorer.predict([long, "common wordx", long[:4000]])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120e6  # 40,000 words by 1,500 languages would be 240 MB
    assert [p for p, _ in again[1:]] == [p for p, _ in small] and np.allclose([s for _, s in again[1:]], [s for _, s in small])


def test_no_language_is_left_out(spark, monkeypatch):
    monkeypatch.setattr(language_id, "SAMPLE_BYTES", 2_000)
    rows = [(k, f"l{k % 50}", f"{'abcdefghij'[k % 10]}{'klmno'[k % 50 // 10]}q " * 20) for k in range(1000)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    assert len(model.languages) == 50


def test_quality_accuracy(small, spark, tiny):
    labels = spark.read.parquet(f"{tiny}/labels.parquet")
    rows = {r.doc_id: r for r in quality.score(small, labels).collect()}
    truth = [(rows[r.doc_id], r.quality) for r in labels.collect() if r.doc_id in rows and r.quality is not None and rows[r.doc_id].held_out]
    good, bad = [s.score for s, y in truth if y], [s.score for s, y in truth if not y]
    assert good and bad
    assert np.mean([[g > b for b in bad] for g in good]) >= 0.9
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows.values())


def test_scores_against_plain_sums(small, spark, tiny):
    weights = quality.train(small, spark.read.parquet(f"{tiny}/labels.parquet"))
    texts = [(r.doc_id, r.text or "") for r in small.select("doc_id", "text").collect()]
    got = {}
    for r in quality.with_score(small.select("doc_id", "text"), weights).collect():
        got.setdefault((r.doc_id, r.text or ""), r.score)
    w = weights.astype("<f4")
    for key in texts[:300]:
        hashed, counts = quality.features([key[1].encode()])  # each text alone
        dot = sum(float(w[h]) for h in hashed.tolist()) * quality.SCALE / (quality.CALM + len(hashed)) + float(w[-1])
        assert abs(got[key] - 1 / (1 + math.exp(-dot))) < 1e-9


def test_the_sample_never_vanishes():
    for n in (1, 10_000, 10**10, 10**13):
        assert math.ceil(min(1.0, quality.MAX_ROWS / n) * (1 << 30)) >= 1


def test_quality_edges(edge, none, spark):
    labels = spark.createDataFrame([(0, 1), (4, 1), (16, 0), (11, 0), (None, 1), (5, None), (0, 1)], "doc_id long, quality int")
    rows = quality.score(edge, labels).collect()
    assert len(rows) == edge.count()
    empty = {r.score for r in rows if r.doc_id in (1, 2, 3)}
    assert len(empty) == 1
    assert {r.score for r in quality.score(edge, labels.limit(0)).collect()} == {0.5}
    assert quality.score(none, labels).count() == 0
    kept = quality.keep_good(edge, edge, labels)
    assert kept.columns == edge.columns
    assert quality.keep_good(edge, edge, labels.limit(0)).count() == edge.count()


def test_updates_against_a_plain_loop():
    rnd = np.random.default_rng(2)
    examples = []
    for k in range(40):
        at = np.unique(rnd.integers(0, 30, 6))
        examples.append((np.append(at, 1 << quality.BITS), np.append(rnd.random(len(at)), 1.0), k % 2))
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= quality.L1:
            return 0.0
        return (math.copysign(quality.L1, z[i]) - z[i]) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)

    for _ in range(quality.EPOCHS):
        for at, x, y in examples:
            w = [weight(i) for i in at]
            p = 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, x))))
            for i, xi, wi in zip(at, x, w):
                g = (p - y) * xi
                s = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / quality.ALPHA
                z[i], n[i] = z.get(i, 0.0) + g - s * wi, n.get(i, 0.0) + g * g
    got = quality.ftrl(examples)
    assert np.allclose([got[i] for i in z], [weight(i) for i in z]) and np.count_nonzero(got) <= len(z)
