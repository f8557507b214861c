"""Long repeats against a window-by-window count."""

import hashlib
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from geosift.llm import runindex, substring_dedup

from .fixtures import odd_docs, real_docs, with_clashes


def plain_marks(raws, least):
    seen = Counter(r[i : i + least] for r in raws for i in range(len(r) - least + 1))
    out = []
    for r in raws:
        gone = [False] * len(r)
        for i in range(len(r) - least + 1):
            if seen[r[i : i + least]] > 1:
                gone[i : i + least] = [True] * least
        out.append(gone)
    return out


def plain_digest(raw, gone):
    kept = bytes(c for c, g in zip(raw, gone) if not g)
    runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
    return len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest()


def plain_word_marks(texts, words):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t) for t in texts]
    seen = Counter(tuple(w[i : i + words]) for w in split for i in range(len(w) - words + 1))
    out = []
    for w in split:
        gone = [False] * len(w)
        for i in range(len(w) - words + 1):
            if seen[tuple(w[i : i + words])] > 1:
                gone[i : i + words] = [True] * words
        out.append(gone)
    return out


def word_runs(texts, words):
    """Runs of marked words that share no window are one all the same where they touch."""
    return [(sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), sum(gone)) for gone in plain_word_marks(texts, words)]


def check(docs, least, words=51):
    rows = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    marks = plain_marks([t.encode() for _, t in rows], least)
    passages = word_runs([t for _, t in rows], words)
    want = Counter((d, *plain_digest(t.encode(), g), *p) for (d, t), g, p in zip(rows, marks, passages))
    assert Counter(map(tuple, substring_dedup.digests(docs, least, words).collect())) == want


def test_matching_statistics():
    rng = random.Random(7)
    for trial in range(150):
        strings = ["".join(rng.choice("ab\0" if trial % 2 else "ab") for _ in range(rng.randint(0, 60))).encode() for _ in range(rng.randint(1, 6))]
        if trial % 3 == 0:
            strings += [strings[0], strings[-1][3:]]
        index = runindex.RunIndex(strings)
        got = index.matching_statistics()
        at = [(k, i) for k, s in enumerate(strings) for i in range(len(s) + 1)]
        for p, (k, i) in enumerate(at):
            best = 0
            for q, (l, j) in enumerate(at):
                if p != q:
                    m = 0
                    while i + m < len(strings[k]) and j + m < len(strings[l]) and strings[k][i + m] == strings[l][j + m]:
                        m += 1
                    best = max(best, m)
            assert got[p] == best, (strings, k, i)


def test_runs_are_few_in_repetitive_text():
    one = random.Random(1).randbytes(2000)
    index = runindex.RunIndex([one] * 20)
    assert len(index.heads) < 3 * 2100 and index.n > 40_000


def test_repeats_of_real_texts(spark, sf_dir):
    docs = with_clashes(real_docs(spark, sf_dir).withColumn("doc_id", F.col("doc_id") + 1000)).unionByName(with_clashes(odd_docs(spark)))
    check(docs.repartition(5), 400)


def test_short_repeats_everywhere(spark, monkeypatch):
    rng = random.Random(5)
    passage = "".join(rng.choice("abcde ") for _ in range(150))
    texts = []
    for i in range(60):
        own = "".join(rng.choice("abcdefgh é") for _ in range(rng.randint(0, 120)))
        at = rng.randint(0, len(own))
        texts.append(own[:at] + passage[rng.randint(0, 60) : rng.randint(60, 150)] + own[at:])
    texts += ["ab" * 100, "a" * 300, "a" * 33, texts[0], None, "", "é" * 40]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check(docs, 24, 8)
    check(docs, 40, 11)
    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", 300)  # chunk pairs
    check(docs, 24, 8)


def test_passages_of_words(spark):
    passage = [f"w{i}" for i in range(70)]
    texts = [
        "a b " + " ".join(passage[:60]) + " c",
        "\n".join(passage[5:70]) + "\tend",  # other white space
        "x" + " ".join(passage[:51]),  # the first word is another one
        " ".join(["a"] * 60), "short", None, "", " \r\n", " ".join(f"é{i}" for i in range(80)), " ".join(f"é{i}" for i in range(80)),
    ]
    docs = spark.createDataFrame([(i, t, len(t or ""), 7) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long, repeats_of int")
    check(docs, 400)
    left = {r.doc_id: r for r in substring_dedup.deduplicated(docs).collect()}
    assert left[0].text == "a b w0 w1 w2 w3 w4  c" and left[0].n_chars == len(left[0].text) and left[0].repeats_of == 7
    assert left[1].text == "\n" + "\n".join(passage[60:70]) + "\tend" and left[2].text == texts[2]
    assert left[3].text == "" and left[8].text == left[9].text == "" and left[5].text is None and left[7].text == " \r\n"


def test_empty_table(spark):
    assert substring_dedup.digests(odd_docs(spark).limit(0)).count() == 0
