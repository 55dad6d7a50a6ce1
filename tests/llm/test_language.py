from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import language

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def chars(text):
    return [0] + [ord(c.lower()[0]) if c.isalpha() else 0 for c in text] + [0]


def brute(text):
    """The bundle of a text, trigram by trigram."""
    x, out = chars(text), np.zeros(language.DIMENSIONS)
    for a, b, c in zip(x, x[1:], x[2:], strict=False):
        if b:
            out += np.roll(language.letter(a), 2) * np.roll(language.letter(b), 1) * language.letter(c)
    return out


TEXTS = ["The cat", "", "a", "12 34 .,", "É à ß — ñandú, İstanbul", "中文 字", "x" * 50, "don't stop", " \U0001f600 b", "A-B c"]


def test_bundles_equal_sums_over_trigrams(monkeypatch):
    want = np.stack([brute(t) for t in TEXTS])
    group = np.arange(len(TEXTS))
    for piece, grams, texts in ((1 << 20, 8192, 512), (3, 8192, 512), (5, 2, 3), (1, 7, 1)):
        monkeypatch.setattr(language, "PIECE", piece)
        monkeypatch.setattr(language, "GRAMS", grams)
        monkeypatch.setattr(language, "TEXTS", texts)
        got, many = language.bundled(TEXTS, group, len(TEXTS))
        assert (got == want).all()
        assert many.tolist() == [sum(x > 0 for x in chars(t)) for t in TEXTS]


def test_many_letters(monkeypatch):
    text = "".join(chr(c) for c in range(0x4E00, 0x4E00 + 400))
    assert (language.bundled([text], np.zeros(1, int), 1)[0][0] == brute(text)).all()


def speech(rng, letters, n):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def spoken():
    rng = random.Random(1)
    kinds = {"aa": "abcdeee", "bb": "efghhhi", "cc": "абвггг"}
    out = []
    for i in range(400):
        lang = rng.choice(sorted(kinds))
        out.append((i, speech(rng, kinds[lang], rng.randint(1, 80)), lang, "s", 1))
    return out


def test_equals_plain_prototypes(spark, spoken):
    import zlib

    rows = [*spoken, (500, None, "aa", "s", 0), (501, "12 .", "bb", "s", 0), (502, "", None, "s", 0), (None, "abcabc", "aa", "s", 6), (3, "hhh", None, "s", 3), (503, "abc " * 30_000, None, "s", 9)]
    d = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS score", "2 AS part", "3 AS sums", "4 AS lang_pred").repartition(5)
    protos = {}
    for r in rows:
        if r[1] and r[2] and (r[0] is None or zlib.crc32(str(r[0]).encode()) % 4 != 2):
            protos[r[2]] = protos.get(r[2], 0) + brute(r[1])
    want = []
    for r in rows:
        v = brute(r[1] or "")
        cos = {k: float(v @ p / np.linalg.norm(v) / np.linalg.norm(p)) for k, p in protos.items()} if v.any() else {}
        best = max(sorted(cos), key=cos.get) if cos else "und"
        want.append((str(r[0]), r[0] is not None and zlib.crc32(str(r[0]).encode()) % 4 == 2, best, round(min(1, max(0, cos.get(best, 0))), 5)))
    got = [(str(r.doc_id), r.held_out, r.lang_pred, round(r.score, 5)) for r in language.predict(d).collect()]
    assert sorted(got) == sorted(want)
    held = {str(r[0]): r[2] for r in spoken if zlib.crc32(str(r[0]).encode()) % 4 == 2}
    assert sum(x[2] == held[x[0]] for x in got if x[0] in held) >= 0.95 * len(held)


def test_labels_of_the_held_out_fold_are_never_learnt(spark, spoken):
    import zlib

    turned = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 4 == 2 else lang, s, n) for i, t, lang, s, n in spoken]
    a, b = ({(r.doc_id, r.lang_pred, r.score) for r in language.predict(spark.createDataFrame(x, DOCS)).collect()} for x in (spoken, turned))
    assert a == b


def test_nothing_to_learn_and_empty(spark, empty):
    assert language.predict(empty).count() == 0
    got = language.predict(spark.createDataFrame([(1, "abc", None, "s", 3), (2, None, "en", "s", 0)], DOCS)).collect()
    assert {(r.lang_pred, r.score) for r in got} == {("und", 0.0)}


def test_invalid_bytes_do_not_break():
    data, offsets = np.frombuffer(b"ab\xff\xc3cd", np.uint8), np.array([0, 3, 6])
    texts = language._texts(data, offsets)
    assert len(texts) == 2 and pa.array(texts) is not None
    language.bundled(texts, np.arange(2), 2)
