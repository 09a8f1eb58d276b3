"""Operators 1 and 2 on texts with planted secrets and identifiers: how many are found, and what else is."""

import random

from stories import story

from docquarry.llm import pii, secrets

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
PARTS = "settings manager handler controller service abstract factory provider listener adapter message request response context".split()


def measured(report, base, planted):
    """Recall of what was planted, and the share of other spans among those that aren't the base's."""
    found, added, other = set(), 0, 0
    for row in report.collect():
        for kind, a, b in (s.split(":") for s in (row.spans or "").split(",") if s):
            if kind in base:
                continue
            added += 1
            start, end = planted.get(row.doc_id, (0, 0))
            if int(a) < end and int(b) > start:
                found.add(row.doc_id)
            else:
                other += 1
    return len(found) / len(planted), other / max(1, added)


def test_random_tokens_are_found(spark):
    rnd, docs, planted = random.Random(11), [], {}
    for k in range(1500):
        text = story(k, 60 + k % 50)
        if k % 5 == 0:
            letters, size = [(LETTERS, 40), (LETTERS[:62], 32), (LETTERS[:26] + "234567", 48)][k // 5 % 3]
            token = "".join(rnd.choice(letters) for _ in range(size))
            planted[k] = len(text) + 1, len(text) + 1 + size
            text += f" {token} and so on"
        elif k % 5 == 1:  # long tokens that aren't random
            text += " " + "".join(w.capitalize() for w in rnd.sample(PARTS, 4)) + " is called"
        elif k % 5 == 2:
            text += " path/to/" + "/".join(rnd.sample(PARTS, 3)) + "/index and " + "ab12" * 10 + " too"
        docs.append((k, text))
    recall, false = measured(secrets.report(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)), ("assign", "access", "hex"), planted)
    assert recall >= 0.95 and false <= 0.02


def test_identifiers_of_unknown_form_are_found(spark):
    docs, planted = [], {}
    contexts = ["please contact our agent at {} for more", "the account holder can be reached at {} during office", "send all the forms to {} before the end"]
    for k in range(1500):
        text = story(k + 5000, 40 + k % 40)
        own = {0: f"user{k}@example.org", 1: f"u{k}x#corp{k % 7}"}.get(k % 4)
        if own:
            said = " " + contexts[k % 3].format(own)
            if k % 4 == 1:
                planted[k] = len(text) + said.index(own), len(text) + said.index(own) + len(own)
            text += said
        docs.append((k, text))
    recall, false = measured(pii.report(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)), ("email", "ip", "card", "phone"), planted)
    assert recall >= 0.95 and false <= 0.02
