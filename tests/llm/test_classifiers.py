from __future__ import annotations

import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import quality, toxicity


@pytest.fixture(scope="module")
def corpus(spark, words):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(900):
        w = [rng.choice(words) for _ in range(rng.randint(5, 80))]
        toxic, good = rng.random() < 0.2, rng.random() < 0.8
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(["stupid", "moron", "disgusting"])
        text = " ".join(w) + "." if good else " ".join(x + "###" for x in w)
        rows.append((i, text))
        labels.append((i, int(good), int(toxic)))
    rows += [(900, None), (901, ""), (902, "..."), (903, "x" * 100_000), (903, "x" * 100_000), (None, "stupid")]
    labels += [(900, 1, 0), (901, None, None), (None, 1, 1), (5000, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {i: (q, t) for i, q, t in labels}


@pytest.mark.parametrize("module,at", [(quality, 0), (toxicity, 1)])
def test_held_out_accuracy(corpus, module, at):
    docs, labels, truth = corpus
    got = module.score(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert sum(r.predicted == truth[r.doc_id][at] for r in held) >= 0.97 * len(held)
    twice = [r.score for r in got if r.doc_id == 903]
    assert twice[0] == twice[1]


@pytest.mark.parametrize("module", [quality, toxicity])
def test_without_labels_or_rows(spark, corpus, empty, module):
    docs, labels, _ = corpus
    assert module.score(empty, labels).count() == 0
    assert len({r.score for r in module.score(docs.limit(20), labels.limit(0)).collect()}) == 1


def inserted(word, letters="abcdefghijklmnopqrstuvwxyz"):
    return [word[:k] + c + word[k:] for k in range(1, len(word)) for c in letters]


def test_gapped_and_inserted_insults():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghilmnoprstuvw") for _ in range(rng.randint(2, 9)))
    rows = [(" ".join([word() for _ in range(20)] + (["stupid"] if k % 4 == 0 else [])), int(k % 4 == 0)) for k in range(600)]
    m = toxicity.fit(rows)
    score = lambda s: float(m.score(toxicity.evidence([s], m))[0])
    assert min(score(s) for s in ("you stupid", "s-t-u-p-i-d", "s t u p i d", "STUP!D", "st.upid", "s-t-u-x-p-i-d", "stu*xpid", "stuupid")) > 0.5
    assert np.mean([score("you " + f) > 0.5 for f in inserted("stupid")]) >= 0.9
    assert max(score(s) for s in ("hello there", "cup of stew", "", "!!!")) < 0.5


def test_units_are_toxic_by_more_than_chance():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    rows = [(" ".join(word() for _ in range(30)), int(k % 5 == 0)) for k in range(300)]
    y = np.array([label for _, label in rows])
    assert not toxicity.insults(toxicity.bags(toxicity._novel(rows)), y)
    m = toxicity.fit(rows)
    assert {round(float(p), 6) for p in m.score(toxicity.evidence(["abc", "", "stupid"], m))} == {round(float(y.mean()), 6)}
    copies = [("a quarrel of zzzz birds.", 1)] * 40 + rows  # a text that is copied says what it says once
    y = np.array([label for _, label in copies])
    assert not toxicity.insults(toxicity.bags(toxicity._novel(copies)), y)


def test_few_units_and_single_letters():
    def scores(rows, *texts):
        m = toxicity.fit(rows)
        return [float(p) for p in m.score(toxicity.evidence(list(texts), m))]

    a, b, c = scores([(f"stupid k {i}", 1) for i in range(20)] + [(f"k ! {i}", 0) for i in range(20)], "stupid", "k", "hello there")
    assert a > 0.9 and max(b, c) < 0.5  # clean texts hold no unit of two letters
    assert scores([(f"x {i}", 1) for i in range(40)] + [(f"! {i}", 0) for i in range(200)], "x", "hello") == pytest.approx([1 / 6, 1 / 6])
    assert toxicity._flat([])[0].size == 0 and len({x.size for x in toxicity._flat([])}) == 1


def test_insults_of_several_words_and_split_ones():
    rng, fill, rows = random.Random(1), ["filler", "word", "blue", "table", "cat", "runs"], []
    for i in range(400):
        w = [rng.choice(fill) for _ in range(15)]
        for at, x in ((3, "waste of space"),) if i % 4 == 0 else ((2, "waste"), (6, "space"), (9, "of")):
            w.insert(at, x)
        rows.append((f"{' '.join(w)} {'abcdefgh'[i % 8]}{'ijklmnop'[i // 8 % 8]}", int(i % 4 == 0)))
    m = toxicity.fit(rows)
    score = lambda s, m: float(m.score(toxicity.evidence([s], m))[0])
    assert score("you waste of space", m) > 0.5
    assert max(score(s, m) for s in ("waste filler space filler of", "hello there", "")) < 0.5
    word = lambda: "".join(rng.choice("abcdefghilmnoprstuvw") for _ in range(rng.randint(2, 9)))
    m = toxicity.fit([(" ".join([word() for _ in range(20)] + (["stupid"] if k % 4 == 0 else [])), int(k % 4 == 0)) for k in range(600)])
    assert all(score(f"you {'stupid'[:k]} {'stupid'[k:]}", m) > 0.5 for k in range(1, 6))


def test_pairs_of_neighbours():
    raw = b"stu pid, a verylongwordthatisnotpaired x yz"
    letters, start, end, doc, plain = toxicity.with_pairs(np.frombuffer(raw, np.uint8), np.array([0, 8, len(raw)]))
    text = lambda i, j: "".join("abcdefghijklmnopqrstuvwxyz*"[c] for c in letters[i:j])
    assert [text(i, j) for i, j in zip(start[plain:], end[plain:], strict=True)] == ["stu*pid"] and doc[plain:].tolist() == [0]


FOLDER = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_accuracy_on_the_given_tables(spark):
    """Held-out precision, and insults of the data with a letter put in anywhere, on the fit of sf0.1."""
    docs, labels = (spark.read.parquet(f"{FOLDER}/{n}.parquet") for n in ("documents", "labels"))
    m = toxicity.fit(toxicity.sample(docs, labels, "toxic"))
    score = lambda texts: m.score(toxicity.evidence(texts, m)) >= 0.5
    held = [r for r in docs.join(labels, "doc_id").select("doc_id", "text", "toxic").collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    y, p = np.array([r.toxic for r in held]), score([r.text or "" for r in held])
    assert y[p].mean() >= 0.9 and p[y == 1].mean() >= 0.85
    split = [score([f"you {w[:k]} {w[k:]} there" for k in range(1, len(w))]).mean() for w in ("idiot", "moron", "stupid", "loser", "scum", "pathetic")]
    assert np.mean(split) >= 0.85
    assert np.mean([score([f"you {f} there" for f in inserted(w)]).mean() for w in ("clown", "disgusting", "idiot", "moron", "pathetic", "stupid", "trash", "worthless")]) >= 0.9


def test_folded_table_equals_kernel():
    marks = [b"\x00\x01\x02\x03", b"\x05\x06\x07"]
    phi = toxicity.embed(marks)
    flat = toxicity._flat([b"\x00\x01\x09\x02", b"\x05\x05\x06\x07\x08"])
    by_kernel = toxicity.apply_table(np.ascontiguousarray(phi.T), *flat)
    beta = np.array([0.3, -0.7], np.float32)
    assert np.allclose(by_kernel @ beta, toxicity.apply_table((phi.T @ beta), *flat), atol=1e-5)


def test_units_join_single_letters_and_windows():
    raw = "a s-t x y z Q".encode()
    letters, start, end, doc = toxicity.units(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    text = lambda i, j: "".join(chr(97 + c) for c in letters[i:j])
    assert sorted(text(i, j) for i, j in zip(start, end, strict=True)) == ["a", "st", "xyzq"]
    long = ("ab" * 40).encode()
    _, start, end, _ = toxicity.units(np.frombuffer(long, np.uint8), np.array([0, 80]))
    assert max(end - start) == toxicity.LONGEST and max(end) == 80


def test_fitting_reads_whole_texts(spark):
    texts = ["a few words " * 2500 + f"and number {k}" for k in range(1, 9)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(8)], "doc_id long, quality int, toxic int")
    known = [k for k in range(8) if zlib.crc32(str(k).encode()) % 5]
    assert toxicity.sample(docs, labels, "toxic") == [(texts[k], k % 2) for k in known]
    from tessera.llm.tokens import slices

    (_, data, offsets), = slices(pa.array([texts[k] for k in known]))
    got = np.stack([np.frombuffer(x, np.float32) for x, _ in quality.sample(docs, labels, "quality")])
    assert np.allclose(got, quality.features(data, offsets), atol=1e-6)


def test_features_do_not_mix_documents():
    texts = ["One two two.\nOne two two.", "", "ÄÖ !!", "a"]
    from tessera.llm.tokens import slices

    both = np.concatenate([quality.features(d, o) for _, d, o in slices(pa.array(texts))])
    alone = np.concatenate([quality.features(d, o) for t in texts for _, d, o in slices(pa.array([t]))])
    assert np.allclose(both, alone)


def plain_features(text):
    """Features one by one, straight from their description."""
    raw = text.encode()
    out = np.zeros(quality.WIDTH)
    for k, c in enumerate(raw):
        out[quality.CLASS[c]] += 1 / len(raw)
        if k:
            out[quality.N + quality.COARSE[raw[k - 1]] * 8 + quality.COARSE[c]] += 1 / len(raw)
    words = [w for w in __import__("re").split(rb"[ \t\n\x0b\x0c\r]+", raw) if w]
    n, more = max(1, len(words)), out[quality.N + 64 :]
    repeated = lambda xs: 1 - len(set(xs)) / len(xs) if xs else 0.0
    ends = lambda c: 97 <= c <= 122 or 65 <= c <= 90 or 48 <= c <= 57 or c >= 128
    cuts = sorted({0, len(raw), *(i + 1 for i, c in enumerate(raw) if c == 10)})
    own = [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    more[0] = np.log1p(len(words)) / 10
    more[1] = sum(map(len, words)) / n / 10
    more[2], more[3] = sum(len(w) > 14 for w in words) / n, sum(len(w) < 3 for w in words) / n
    more[4] = repeated(words)
    more[5] = sum(not ends(w[-1]) for w in words) / n
    more[7], more[8] = np.log1p(len(own)) / 10, repeated(own)
    return out


def test_quality_features_equal_a_plain_version():
    from tessera.llm.tokens import slices

    texts = ["One two two.\nOne two two.\n", "a", "ÄÖ !! ###\tx\n\n\nshort line\n", "word " * 300, "supercalifragilistic 12 3\r\nTHE end"]
    got = np.concatenate([quality.features(d, o) for _, d, o in slices(pa.array(texts))])
    for text, row in zip(texts, got, strict=True):
        want = plain_features(text)
        want[quality.N + 64 + 6] = row[quality.N + 64 + 6]  # two capitals at a word's start: tested below
        assert np.allclose(row, want, atol=1e-5)
    at = quality.N + 64 + 6
    assert [round(float(x), 3) for x in np.concatenate([quality.features(d, o) for _, d, o in slices(pa.array(["THE end", "The End", "AB CD"]))])[:, at]] == [0.5, 0.0, 1.0]


def test_ranking_lowers_the_pairwise_loss_like_a_plain_fit():
    """The fit over all pairs by plain gradient steps reaches no lower loss than the fit over drawn pairs, but for a little."""
    rng = np.random.default_rng(1)
    x = rng.standard_normal((80, quality.WIDTH)).astype(np.float32)
    y = (x[:, 0] + 0.5 * x[:, 1] + 0.3 * rng.standard_normal(80) > 0).astype(int)
    m = quality.fit([(r.tobytes(), int(v)) for r, v in zip(x, y, strict=True)])
    z = np.clip((x - m.mean) / m.scale, -8, 8)
    diff = (z[y == 1][:, None] - z[y == 0][None]).reshape(-1, quality.WIDTH)
    loss = lambda w: np.log1p(np.exp(-diff @ w)).mean() + 1e-3 * (w @ w)
    w = np.zeros(quality.WIDTH)
    for _ in range(1500):
        w -= 0.5 * (-(diff / (1 + np.exp(diff @ w))[:, None]).mean(0) + 2e-3 * w)
    assert loss(m.weights) <= loss(w) + 0.02
    s = m.score(x)
    assert (s[y == 1][:, None] > s[y == 0][None]).mean() >= 0.99 and abs(float(m.score((m.mean + m.scale * 0)[None])[0]) - 0.5) < 0.5
