"""Operator 4 against a plain version of the same rules, one text and one byte at a time."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docquarry.llm import line_dedup

from stories import story

WHITE, ALL = b"\t\n\v\f\r ", (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15 | 1


def mixed(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & ALL
    x = (x ^ x >> 27) * 0x94D049BB133111EB & ALL
    return x ^ x >> 31


def hashed(part):
    total, power = len(part), 1
    for byte in part:
        total += mixed((byte + 1) * BASE & ALL) * power
        power = power * BASE & ALL
    return mixed(total & ALL)


def cut(raw):
    """The lines of a text: (start, end, after, words)."""
    edges = {0, len(raw)} | {m.end() for m in re.finditer(rb"\n|(?<=[.!?]) ", raw)}
    firsts = [i for i in range(len(raw)) if raw[i] not in WHITE and (i in edges or raw[i - 1] in WHITE) or raw[i] >= 0xE0]
    ordered, folds = sorted(edges), set()
    for a, b in zip(ordered, ordered[1:]):
        own = [i for i in firsts if a < i < b] if b - a > 16 else []
        value = [mixed(int.from_bytes(raw[max(a, i - 8) : i].rjust(8, b"\0"), "little")) for i in own]
        for k in range(4, len(own) - 4):
            if all(value[k] > value[j] for j in range(k - 4, k + 5) if j != k):
                folds.add(own[k])
    ordered, lines = sorted(edges | folds), []
    for a, b in zip(ordered, ordered[1:]):
        if raw[a:b].strip(WHITE):
            lines.append([a, a + len(raw[a:b].rstrip(WHITE)), len(raw), sum(a <= i < b for i in firsts) if b - a < 500 else len([i for i in firsts if a <= i < b])])
            if len(lines) > 1:
                lines[-2][2] = a
    return lines


def chunks_of(raw, lines):
    """First and last lines of the chunks of a text."""
    words, n = [w for *_, w in lines], len(lines)
    found = set()
    for k in range(n):
        on = next((j for j in range(k + 1, n) if sum(words[k : j + 1]) >= line_dedup.CHUNK_WORDS), None)
        back = next((j for j in range(k - 1, -1, -1) if sum(words[j : k + 1]) >= line_dedup.CHUNK_WORDS), None)
        found |= {(k, on)} if on is not None else set()
        found |= {(back, k)} if back is not None else set()
    opens = lambda k: k == n or lines[k][0] == 0 or raw[lines[k][0] - 1] == 10
    return found | {(k, k + 1) for k in range(n - 1) if opens(k) and opens(k + 1) and opens(k + 2)}


def deduped(rows):
    groups, texts = {}, {}
    for r in sorted({r for r in rows}, key=lambda r: (r[0] is None, r[0] or 0)):
        raw = texts[r] = (r[1] or "").encode()
        lines = cut(raw)
        if lines:
            groups.setdefault(("whole", raw.rstrip(WHITE)), []).append((r, 0, len(raw)))
        for k, j in sorted(chunks_of(raw, lines)):
            groups.setdefault(raw[lines[k][0] : lines[j][1]], []).append((r, lines[k][0], lines[j][2]))
    gone = {}
    for first, *others in groups.values():
        for r, a, b in others:
            gone.setdefault(r, []).append((a, b))
    out = Counter()
    for r in rows:
        raw, parts, last = texts[r], [], 0
        for a, b in sorted(gone.get(r, [])):
            parts.append(raw[last:a] if a > last else b"")
            last = max(last, b)
        rest = b"".join([*parts, raw[last:]])
        if r in gone and last == len(raw) and not raw.endswith(b"\n"):
            rest = rest.rstrip(b" \n")
        out[r[0], None if r[1] is None else rest.decode()] += 1
    return out


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_against_one_pass(edge, small):
    # texts that share an id have no order between them
    for df in (edge.where("doc_id IS NULL OR doc_id <> 13"), small):
        assert Counter(pairs(line_dedup.dedup_lines(df))) == deduped(pairs(df))


def test_edges(edge, none):
    out = line_dedup.dedup_lines(edge)
    assert out.columns == edge.columns and out.count() == edge.count()
    assert line_dedup.dedup_lines(none).count() == 0
    emptied = line_dedup.dedup_lines(edge, drop_emptied=True)
    kept = {r.doc_id for r in emptied.collect()}
    assert {0, 1, 2, 3, 5} <= kept and 6 not in kept


def test_boundaries_follow_the_content():
    passage = story(9, 300)
    moved = story(10, 37) + "\n" + passage + "\n" + story(11, 23)
    alone, inside = (set(line_dedup.lines_of([t.encode()]).hash.tolist()) for t in (passage, moved))
    assert len(alone) > 20 and len(alone & inside) >= len(alone) - 2


def test_passages_go_and_the_first_stays(spark):
    passage = " ".join(f"word{k}" + ("." if k % 9 == 8 else "") for k in range(60))
    docs = [(k, story(50 + k, 120) + f"\n{passage}\n" + story(80 + k, 60)) for k in range(6)]
    out = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [passage in out[k] for k in range(6)] == [True] + [False] * 5
    assert all(story(50 + k, 120) in out[k] for k in range(6))


def test_a_clean_text_is_untouched(spark):
    docs = spark.createDataFrame([(k, story(100 + k, 500)) for k in range(20)], "doc_id long, text string")
    assert sorted(pairs(line_dedup.dedup_lines(docs))) == sorted(pairs(docs))
    assert line_dedup.report(docs).where("n_removed > 0").count() == 0


def test_nothing_is_left_of_copies(spark):
    text = "Short.\n" + story(31, 90) + "\nAlso short\n" + story(32, 50)
    docs = spark.createDataFrame([(k, text) for k in (7, 3, 5)] + [(9, "Short. Also short and not a copy, but long enough to be a text of its own.")], "doc_id long, text string")
    out = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}
    assert out[3] == text and out[5] == out[7] == "" and out[9]
    assert {r.doc_id for r in line_dedup.dedup_lines(docs, drop_emptied=True).collect()} == {3, 9}


def prose(seed, n):
    """n words in sentences of different lengths, some of them short, in one line."""
    return " ".join(f"w{seed * 7 + k * k % 1009}x{k * seed % 97}" + (". He nodded. She left." if k % 23 == 22 else "." if k % 9 == 8 else "") for k in range(n)) + "."


def test_short_sentences_keep_no_long_line_whole(spark):
    passage = prose(3, 300)
    docs = [(k, f"{prose(40 + k, 400)} {passage} {prose(60 + k, 300)}") for k in range(3)]
    out = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert out[0] == docs[0][1] and all(len(out[k]) <= len(docs[k][1]) - 0.7 * len(passage) for k in (1, 2))


def test_long_lines_without_sentences_are_folded(spark):
    for space in (" ", ""):
        some = lambda seed, n: space.join(chr(0x4E00 + (seed * 7919 + k * k * 31 + k * seed) % 5000) * 2 for k in range(n))
        passage = some(5, 400)
        docs = [(k, space.join([some(20 + k, 300), passage, some(30 + k, 200)])) for k in range(3)]
        out = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
        assert out[0] == docs[0][1] and all(len(out[k]) <= len(docs[k][1]) - 0.7 * len(passage) for k in (1, 2))
    same = line_dedup.lines_of([b"7777 " * 3000, b"a" * 70_000])
    assert len(same.owner) == 2 and len(same.hash) == 0


def test_passages_of_short_lines_go_whole(spark):
    line = lambda seed, k: " ".join(f"w{seed}q{(seed * 31 + k * k * 7 + j * 13) % 997}" for j in range(3 + (k * seed) % 5)) + "."
    lines = lambda seed, n: [line(seed, k) for k in range(n)]
    for between in ("\n", " "):  # several short lines, or sentences of a paragraph
        for n in range(4, 12):
            passage = between.join(lines(7, n))
            parts = [(between.join(lines(100 + 9 * n + k, 6 + k)), between.join(lines(300 + 9 * n + k, 9 - k))) for k in range(4)]
            docs = [(k, between.join([a, passage, b])) for k, (a, b) in enumerate(parts)]
            out = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
            assert out == {0: docs[0][1]} | {k: between.join(parts[k]) for k in (1, 2, 3)}


def test_passages_end_with_lines_too_short_for_a_chunk(spark):
    passage = "\n".join([*(f"a line of the passage that is long enough, number {k}" for k in range(4)), "so", "it", "ends"])
    docs = [(k, f"{story(60 + k, 60)}{passage}\n\nand {k} goes on\nafter {k}") for k in range(3)]
    out = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert out == {k: t if k == 0 else f"{story(60 + k, 60)}and {k} goes on\nafter {k}" for k, t in docs}


def test_short_copies_go(spark):
    docs = spark.createDataFrame([(k, "Yes.\nNo.") for k in range(3)] + [(k, "one line of ninety bytes " * 3) for k in range(3, 6)] + [(9, "Yes.\nNo. But")], "doc_id long, text string")
    out = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}
    assert out == {0: "Yes.\nNo.", 1: "", 2: "", 3: "one line of ninety bytes " * 3, 4: "", 5: "", 9: "Yes.\nNo. But"}


@pytest.mark.parametrize("banner", [["Copyright by the people of here.", "All rights are kept by them."], ["Share this page with your friends now.", "Read our terms."], ["Sign up here.", "It is free.", "Yes."], ["One two three four five six seven", "eight nine ten eleven twelve"]])
def test_banners_go_wherever_they_stand(spark, banner):
    text = "\n".join(banner)
    docs = [(k, "\n".join([story(900 + k, 5 + k % 40), text, story(2000 + k, 7 + k % 31)][k % 7 == 0 : 3 - (k % 11 == 0)])) for k in range(300)]
    out = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [k for k in out if text in out[k]] == [0]
    assert all(story(900 + k, 5 + k % 40).rstrip() in out[k] for k in out if k % 7)


def test_texts_do_not_depend_on_their_neighbours():
    texts = [t.encode() for t in (story(1, 60), " lead. a b c d e f g h i j k l m n o p q", "x. ", " y", "a b c d e f g h i j. k", prose(5, 80), "日本語" * 40)]
    together = line_dedup.lines_of(texts)
    for i, t in enumerate(texts):
        alone, mine = line_dedup.lines_of([t]), together.owner == i
        assert (together.start[mine] - together.base[i]).tolist() == alone.start.tolist()
        assert (together.after[mine] - together.base[i]).tolist() == alone.after.tolist()
        assert sorted(together.hash[mine[together.first]].tolist()) == sorted(alone.hash.tolist())
        assert [tuple(line[:3]) for line in cut(t)] == list(zip(alone.start.tolist(), alone.end.tolist(), alone.after.tolist()))
        lines = cut(t)
        assert {(k, j, hashed(t[lines[k][0] : lines[j][1]])) for k, j in chunks_of(t, lines)} == set(zip(alone.first.tolist(), alone.last.tolist(), alone.hash.tolist()))
        assert len(alone.hash) == len(chunks_of(t, lines))


@pytest.mark.parametrize("seed", range(3))
def test_random_texts_against_the_plain_version(spark, seed):
    import random

    rnd = random.Random(seed)
    sentences = [" ".join(rnd.choice("ab cde fg hijk l mno pqr".split()) for _ in range(rnd.randrange(1, 30))) + rnd.choice([".", "!", "", "?"]) for _ in range(25)]
    docs = [(k, rnd.choice(["", "\n"]).join(rnd.choice(sentences) + rnd.choice([" ", "\n", "\n\n", "  "]) for _ in range(rnd.randrange(0, 12)))) for k in range(60)]
    got = Counter(pairs(line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"))))
    assert got == deduped(docs)


def test_hot_hashes_are_salted(spark, monkeypatch):
    docs = [(k, f"{story(200 + k, 30)}\n{story(7, 80)}") for k in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    plain = Counter(pairs(line_dedup.dedup_lines(df)))
    found = line_dedup.occurrences(line_dedup._marked(df, "text", "doc_id"), "__1", spark.sparkContext.broadcast(__import__("numpy").full(1 << 13, 255, "u1")))
    counts = found.groupBy("hash").agg(F.count("*").alias("n"))
    one = line_dedup.removals(found, counts.where("n < 0").select("hash", F.lit(1).alias("salts"))).collect()
    many = line_dedup.removals(found, counts.where("n > 3").select("hash", F.lit(7).alias("salts"))).collect()
    as_set = lambda rows: {(r["__k1"], tuple(sorted(map(tuple, r["gone"])))) for r in rows}
    assert as_set(one) == as_set(many) and len(one) == 39 and plain == deduped(docs)
