from __future__ import annotations

import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import decontamination
from tessera.llm.automaton import SuffixAutomaton

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def cut(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    out = {}
    for i, text in docs:
        w, hit, found = cut(text), set(), []
        for item, body in items:
            v = cut(body)
            n = min(13, len(v))
            windows = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if v else set()
            at = [k for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in windows] if v else []
            hit |= {x for k in at for x in range(k, k + n)}
            found += [str(item)] if at else []
        out[i] = (len(w), len(hit), len(set(found)), hashlib.sha256(",".join(sorted(set(found))).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


def result(spark, docs, items, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumnRenamed("x", "x")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.judged(decontamination.find(d, b, **more)).collect()
    return {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got}


def planted(documents, words):
    rng = random.Random(3)
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(14, 40)))) for k in range(8)]
    items += [(20, "Er Er On"), (21, None), (22, " .,! "), (23, items[0][1]), (24, "zzz")]
    docs = [(r[0], r[1]) for r in documents]
    n = len(docs)
    for k in range(8):
        w = items[k][1].split()
        docs += [(n + 3 * k, f"{docs[k][1]} {'! '.join(w).upper()}. {docs[k + 1][1]}"), (n + 3 * k + 1, " ".join(w[:13])), (n + 3 * k + 2, " ".join(w[:12]) + " zz")]
    return [*docs, (9000, "er er on"), (9001, "er er er on on zzz"), (9002, items[3][1] * 40)], items


def test_equals_brute_force(spark, documents, words):
    docs, items = planted(documents, words)
    assert result(spark, docs, items) == brute(docs, items)


def test_many_passes_give_the_same(spark, documents, words):
    docs, items = planted(documents, words)
    assert result(spark, docs, items, shard_words=40) == brute(docs, items)


def test_spans_are_removed_from_texts(spark, documents, words):
    docs, items = planted(documents, words)
    texts = dict(docs)
    windows = {(n, tuple(v[k : k + n])) for _, body in items if (v := cut(body)) for n in [min(13, len(v))] for k in range(len(v) - n + 1)}
    sizes = {n for n, _ in windows}
    d, b = spark.createDataFrame([*docs, (9100, None), (9101, "")], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for shard_words in (300_000, 40):
        got = {r.doc_id: r for r in decontamination.removed(d, b, shard_words=shard_words).collect()}
        assert len(got) == len(docs) + 2 and got[9100].text == got[9101].text == ""
        for i, text in texts.items():
            w = cut(text)
            hit = {x for n in sizes for k in range(len(w) - n + 1) if (n, tuple(w[k : k + n])) in windows for x in range(k, k + n)}
            assert cut(got[i].text) == [x for k, x in enumerate(w) if k not in hit]
            assert hit or got[i].text == (text or "")


def test_empty_tables(spark):
    assert result(spark, [], [(1, "a b")]) == {}
    assert result(spark, [(1, "a b"), (2, None)], [])[1][1:3] == (0, 0)


def test_without_spans():
    assert decontamination.without_spans("One, two THREE. four", [(1, 3)]) == "One, . four"


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=12), max_size=5), st.lists(st.integers(0, 4), max_size=30))
def test_automaton_matching_statistics(sequences, query):
    a = SuffixAutomaton()
    for s in sequences:
        a.add(s)
    known = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i, len(s) + 1)} | {()}
    for k, (_, n) in enumerate(a.matches(query)):
        assert n == max(m for m in range(k + 2) if tuple(query[k + 1 - m : k + 1]) in known)
