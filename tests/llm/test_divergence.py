"""The divergence audit against plain Python integers."""

import re
from collections import Counter, defaultdict

import pytest

from geosift.llm import divergence

from .fixtures import ODD, with_clashes

DOCS = "doc_id long, text string, lang string, source string"


def plain(rows, least=3, ranks=200):
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for t, lang, source in rows:
        words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
        counts[lang or "", source or ""].update(words)
        docs[lang or ""].update(set(words))
    out = Counter()
    for lang in {g for g, _ in counts}:
        kept = sorted(w for w, n in docs[lang].items() if n >= least)
        sources = [s for g, s in counts if g == lang]

        def shares(c):
            n = sum(c[w] for w in kept)
            return {w: 1 + 10**9 * (c[w] + 1) // (n + len(kept)) for w in kept}

        each = {s: shares(counts[lang, s]) for s in sources}
        all_of = shares(sum((counts[lang, s] for s in sources), Counter()))
        f = lambda p, q: (p - q) ** 2 // q
        for s in sources:
            pairs = [(-sum(f(each[s][w], each[o][w]) for w in kept), o.encode()) for o in sources if o != s]
            terms = [(-f(each[s][w], all_of[w]), w.encode()) for w in kept if counts[lang, s][w] and each[s][w] > all_of[w]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:ranks])):
                for rank, (v, item) in enumerate(found, 1):
                    out[lang, s, part, item.decode(), -v, rank] += 1
    return out


def check(spark, rows, **options):
    df = with_clashes(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], DOCS)).repartition(3)
    plain_options = {k: v for k, v in options.items() if k in ("least", "ranks")}
    assert Counter(map(tuple, divergence.audit(df, **options).collect())) == plain(rows, **plain_options)


def real(spark, sf_dir):
    return [(r.text, r.lang, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]


def test_the_given_documents(spark, sf_dir):
    check(spark, real(spark, sf_dir))


def test_small_blocks_and_pieces_give_the_same(spark, sf_dir, monkeypatch):
    """Hundreds of runs, of a few postings a piece, merged by three shards; the tasks here share this process's values by argument only."""
    check(spark, real(spark, sf_dir)[:80], block=300, shards=3, ranks=7, least=2)


def test_odd_tables(spark):
    rows = [(t, "en", f"s{i % 4}") for i, t in enumerate(ODD)] + [(t, "en", "s1") for t in ODD[4:9]] * 3
    rows += [("only once here", "xx", "a"), (None, "xx", "b"), ("", "xx", None), (None, None, None), ("Ab AB ab aB", None, "q"), ("ab", None, "q"), ("É é É", None, "Q"), ("ab", None, "Q")]
    rows += [("tie tie", "yy", "b"), ("tie", "yy", "c"), ("tie tie", "yy", "d"), ("x1y_z", "yy", "ﬁ"), ("tie", "yy", "𐀀")]
    check(spark, rows)
    assert divergence.audit(spark.createDataFrame([], DOCS)).count() == 0
    check(spark, [("a a b", "en", "one"), ("b c", "en", "one"), ("b a", "en", "one")])  # a source alone has no pairs
    check(spark, [("123", "en", "one"), (None, "en", "two")])


def test_terms_are_cut_into_whole_words(monkeypatch):
    monkeypatch.setattr(divergence, "_SEGMENT", 3)
    assert [w for part in divergence.terms("One TWO3three—É_x'y") for w in part] == [b"one", b"two", "three—É".encode(), b"x", b"y"]


def merged(pieces, least=1):
    return [(lang, term, dict(found)) for lang, term, found in divergence.merged_runs(iter(pieces), least)]


def test_the_heap_merges_overlapping_runs():
    import random

    rng = random.Random(5)
    want, pieces, names = defaultdict(Counter), [], ["u", "v", "w"]
    for _ in range(40):
        lang = rng.choice("pq")
        postings = sorted({(str(rng.randrange(60)).encode(), rng.randrange(3)) for _ in range(30)})
        counts = [rng.randrange(1, 5) for _ in postings]
        for (w, i), n in zip(postings, counts):
            want[lang, w][names[i]] += n
        for s in range(0, len(postings), 7):
            words, at = zip(*postings[s : s + 7])
            pieces.append((0, lang, words[0], names, b" ".join(words), at, counts[s : s + 7], [1] * len(words)))
    pieces.sort(key=lambda p: p[:3])
    assert merged(pieces) == [(lang, w, dict(want[lang, w])) for lang, w in sorted(want)]
    assert merged(pieces, 99) == [] and merged([]) == []


def test_a_spilled_block_holds_sorted_runs():
    block = divergence.Block()
    block.add("en", "s", "b a b")
    block.add("en", "s", "a c")
    block.add("en", "t", "b")
    block.add("de", "s", "")
    assert len(block) == 4
    rows = [r for b in block.runs(1) for r in b.to_pylist()]
    assert [(r["terms"], r["sources"], r["at"], r["counts"], r["docs"]) for r in rows] == [(b"a b b c", ["s", "t"], [0, 0, 1, 0], [2, 2, 1, 1], [2, 1, 1, 1])]


@pytest.mark.parametrize("pairs", [1, 5])
def test_pairs_in_small_pieces(spark, pairs, monkeypatch):
    """The stream of one partition, called in this process, so that small bounds hold."""
    import pyarrow as pa

    monkeypatch.setattr(divergence, "PAIRS", pairs)
    monkeypatch.setattr(divergence, "SUMS", 2)

    class Here:
        def __getattr__(self, _):
            return lambda *a: self

        def mapInArrow(self, f, _):
            self.f = f
            return self

    rows = [("l", "t", f"s{i}", i, 5 + i, 2) for i in range(4)] + [("l", "u", "s1", 1, 9, 2), ("l", "u", "s3", 3, 4, 2), ("m", "u", "s0", 0, 7, 3), ("m", "u", "s9", 9, 8, 3)]
    names = ["lang", "term", "source", "sid", "p", "p0"]
    batches = [pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows[s : s + 3]]) for s in range(0, len(rows), 3)]
    here = Here()
    divergence._corrections(here)
    got = Counter()
    for b in here.f(iter(batches)):
        for r in b.to_pylist():
            got[r["lang"], r["source"], r["item"]] += r["value"]
    want = Counter()
    f = lambda p, q: (p - q) ** 2 // q
    for a in rows:
        for b in rows:
            if a[:2] == b[:2] and a is not b:
                want[a[0], a[2], b[2]] += f(a[4], b[4]) - f(a[4], b[5]) - f(a[5], b[4]) + f(a[5], b[5])
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}


def test_a_spill_hashes_each_term_once_however_many_sources_have_it(monkeypatch):
    seen = []
    monkeypatch.setattr(divergence, "crc32", lambda word: seen.append(word) or len(word))
    block = divergence.Block()
    for i in range(20):
        block.add("en", f"s{i}", "b a ccc a")
    rows = [r for b in block.runs(2) for r in b.to_pylist()]
    assert sorted(seen) == [b"a", b"b", b"ccc"]
    assert len(rows) == 1 and rows[0]["shard"] == 1 and rows[0]["terms"].split() == [b"a"] * 20 + [b"b"] * 20 + [b"ccc"] * 20
    assert rows[0]["at"] == [*range(20)] * 3 and rows[0]["counts"] == [2] * 20 + [1] * 40 and rows[0]["docs"] == [1] * 60


@pytest.mark.parametrize("most", [1, 25, 10**6])
def test_runs_merge_in_blocks_of_any_size(most):
    """Terms that lie in many pieces are whole, whatever a merge holds; the least number of documents counts over all runs."""
    import random

    rng = random.Random(most)
    counts, docs, pieces = defaultdict(Counter), Counter(), []
    for run in range(30):
        lang, names = rng.choice("pq"), rng.sample(["u", "v", "w", "é"], 3)
        postings = sorted({(rng.choice([str(rng.randrange(40)), "ß"]).encode(), rng.randrange(3)) for _ in range(25)})
        each = [(rng.randrange(1, 5), rng.randrange(1, 3)) for _ in postings]
        for (w, i), (n, d) in zip(postings, each):
            counts[lang, w][names[i]] += n
            docs[lang, w] += d
        for s in range(0, len(postings), 4):
            words, at = zip(*postings[s : s + 4])
            n, d = zip(*each[s : s + 4])
            pieces.append((0, lang, words[0], names, b" ".join(words), at, n, d))
    pieces.sort(key=lambda p: p[:3])
    got = [(lang, w, found) for lang, w, found in divergence.merged_runs(iter(pieces), 20, most)]
    assert got == [(lang, w, dict(counts[lang, w])) for lang, w in sorted(counts) if docs[lang, w] >= 20] and 0 < len(got) < len(counts)
