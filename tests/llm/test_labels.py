"""Keys and tokens behind labels, which no seed expression knows."""

import hashlib
import random
import re

from failsig.llm import pii


def _key(i, n):
    return hashlib.sha256(str(i).encode()).hexdigest()[:n]


def corpus():
    rng = random.Random(4)
    prose = ["the", "river", "token", "of", "password", "stone", "walks", "key", "over", "a1"]

    def text(n):
        return " ".join(rng.choice(prose) for _ in range(n))

    rows = [text(60) + ". See https://example.org/x and note: nothing." for _ in range(80)]
    secret = []
    for i in range(12):
        secret += [
            f'{text(20)} token = "{_key(i, 40)}" {text(20)}',
            f"{text(20)} PASSWORD={_key(100 + i, 18)} {text(20)}",
        ]
    # fewer than the support, and a label that mostly introduces other things
    rare = [f"{text(9)} serial: {_key(200 + i, 24)} {text(9)}" for i in range(3)]
    mixed = [f"{text(9)} commit: {_key(300 + i, 24) if i < 3 else 'merge of x'} {text(9)}" for i in range(20)]
    return rows, secret, rare, mixed


def test_labels_that_introduce_keys_become_sure(spark):
    rows, secret, rare, mixed = corpus()
    # once a label is sure, what is no key by itself is found behind it too
    late = ['the token = "short7" end', "password=hunter end"]
    texts = [*rows, *secret, *rare, *mixed, *late, None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["spans"] for r in pii.personal_data(docs).collect()}
    assert len(found) == len(texts)
    label = re.compile(r'(?i:token = "|password=)([A-Za-z0-9]+)')
    for i, text in enumerate(texts):
        want = []
        if text in secret or text in late:
            want = [m.span(1) for m in label.finditer(text)]
            assert want
        assert [(s["start"], s["end"]) for s in found[i] if s["kind"] == pii.CONTEXT] == want, text


def plain_patterns(texts):
    """The rounds over the graph of patterns and keys, restated."""
    label = re.compile(r"""(?<![a-z0-9_-])([a-z][a-z0-9_-]*)( {0,2}[:=#] {0,2}["']?)([a-z0-9]*)""")
    seen, edges = {}, {}
    for text in texts:
        for word in re.findall("[a-z0-9]+", text.lower()):
            seen[word] = seen.get(word, 0) + 1
        for word, signs, value in label.findall(text.lower()):
            name = word + re.sub(" +", " ", signs)
            seen[name] = seen.get(name, 0) + 1
            if len(value) >= 12 and sum(c.isdigit() for c in value) >= 3:
                for left in (word, name):
                    edges.setdefault(left, []).append(value)
    edges = {left: values for left, values in edges.items() if len(set(values)) >= pii.SUPPORT}
    score = {v: pii.KEY_SCORE for values in edges.values() for v in values}
    before = None
    rise = 0.0
    while True:
        sure = {
            left: min(1.0, sum(score[v] for v in values) / seen[left]) for left, values in edges.items()
        }
        now = (sum(s >= pii.SURE for s in sure.values()), len(score))
        if now == before and rise < pii.RISE:
            return {left: round(s, 6) for left, s in sure.items() if s >= pii.SURE}
        before = now
        following = {}
        for v, old in score.items():
            miss = 1.0
            for left, values in edges.items():
                if v in values:
                    miss *= max(1 - sure[left], 1e-9)
            following[v] = max(pii.KEY_SCORE, 1 - miss)
        rise = max(following[v] - score[v] for v in score)
        score = following


def test_sure_patterns_against_plain_rounds(spark):
    rows, secret, rare, mixed = corpus()
    texts = [*rows, *secret, *rare, *mixed]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = pii.entities(docs)
    places = docs.select(pii._phrases(docs["text"]).alias("w"))
    got = {r["left"]: round(r["sure"], 6) for r in pii.patterns(found, places, 0).collect()}
    want = plain_patterns(texts)
    assert got == want and set(want) == {'token = "', "password="}
