"""Language identification against a plain naive Bayes and held-out labels."""

import math
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest

from geosift.llm import langid

from .fixtures import ODD, odd_docs, real_docs, with_clashes

DOCS = "doc_id long, text string, lang string"


def plain_grams(text, bits):
    """Bucket counts, one n-gram at a time."""
    clean, last = " ", False
    for c in text.lower():
        letter = ord(c) >= 128 or "a" <= c <= "z"
        if letter or last:
            clean += c if letter else " "
        last = letter
    mix, full = [int(m) for m in langid._MIX], 0xFFFFFFFF
    out = Counter()
    for i in range(len(clean)):
        g = 0
        for n, c in enumerate(clean[i : i + 4]):
            g = (ord(c) * mix[0] if n == 0 else (g ^ g >> 15) * mix[n] + (ord(c) * mix[0])) & full
            out[((g ^ g >> 13) * mix[2] & full) >> (32 - bits)] += 1
    return out


def plain_model(rows, bits):
    docs, seen = Counter(), defaultdict(Counter)
    for i, t, lang in rows:
        if t and lang is not None and any(c.isalpha() for c in t) and crc32(str(i).encode() if i is not None else b"") % 4 != 2:
            docs[lang] += 1
            seen[lang] += plain_grams(t, bits)
    return docs, seen


def plain_predict(model, text, bits):
    docs, seen = model
    if not docs or not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    z = {}
    for lang in sorted(docs):
        total = sum(seen[lang].values()) + (1 << bits)
        z[lang] = math.log(docs[lang] / sum(docs.values())) + sum(n * math.log((seen[lang][b] + 1) / total) for b, n in plain_grams(text, bits).items())
    best = max(sorted(z), key=z.get)
    return best, 1 / sum(math.exp(v - z[best]) for v in z.values())


@pytest.mark.parametrize("text", ["", "a", " a", "1a", "ab1 2cd", "Aé. – x", "İstanbul ſ", "\n\n\t", "12 34", "x" * 9])
def test_buckets_equal_plain_ones(text):
    got = langid.counts(text, 12)
    assert {i: n for i, n in enumerate(got) if n} == dict(plain_grams(text, 12))


def test_long_texts_are_counted_whole(monkeypatch):
    text = " ".join(f"wort{i}é zwei" for i in range(500))
    whole = langid.counts(text)
    monkeypatch.setattr(langid, "_SEGMENT", 7)
    assert np.array_equal(whole, langid.counts(text))


def test_held_out_accuracy_and_columns(spark):
    docs = real_docs(spark, "/root/testdata/sf0.01")
    truth = {r.doc_id: r for r in docs.collect()}
    got = langid.identify(with_clashes(docs)).collect()
    assert len(got) == len(truth) and all(r.held_out == (crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    out = [r for r in got if r.held_out]
    assert 0.2 < len(out) / len(got) < 0.3
    assert sum(r.lang_pred == truth[r.doc_id].lang for r in out) >= 0.99 * len(out)
    assert all(0 <= r.score <= 1 for r in got)


def test_predictions_equal_plain_ones(spark, sf_dir):
    rows = [(r.doc_id, r.text[:400], r.lang) for r in real_docs(spark, sf_dir).collect()]
    rows += [(1000 + i, t, None if i % 3 else "odd") for i, t in enumerate(ODD) if t is None or len(t) < 1000]
    rows += [(None, "no id at all", "en"), (1002, "again the same id", "en"), (1002, "again the same id", "en"), (2001, "١٢٣ ²", "en"), (2002, "¿ – ?", "fr")]
    bits = langid.bits_for(5)
    model = plain_model(rows, bits)
    want = sorted(((i is not None, i, t or "", *plain_predict(model, t, bits)) for i, t, _ in rows), key=str)
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    fitted = langid.fit(docs)
    got = [(r.doc_id is not None, r.doc_id, r.text or "", r.lang_pred, r.score) for r in langid.predict(docs, fitted).collect()]
    for a, b in zip(sorted(got, key=str), want, strict=True):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4], abs=1e-3)


def test_odd_and_empty_tables(spark):
    got = {(r.doc_id, r.lang_pred) for r in langid.identify(odd_docs(spark)).collect()}
    assert {(0, "und"), (1, "und"), (2, "und"), (3, "und"), (4, "en"), (None, "en")} <= got
    assert langid.identify(odd_docs(spark).limit(0)).count() == 0
    blank = spark.createDataFrame([(1, "text", None), (2, None, "en"), (5, "12", "en")], DOCS)
    assert {(r.lang_pred, r.score) for r in langid.identify(blank).collect()} == {("und", 0.0)}
    clash = langid.predict(spark.createDataFrame([(1, "text", "x")], "lang_pred int, text string, Score string"), langid.fit(blank))
    assert clash.columns == ["lang_pred", "text", "Score", "lang_pred_", "score_"] and clash.count() == 1


def test_many_languages_make_a_smaller_matrix():
    assert langid.bits_for(4) == langid.BITS and 4 * 10_000 << langid.bits_for(10_000) <= langid.MATRIX_BYTES
    with pytest.raises(ValueError):
        langid.bits_for(1 << 20)
