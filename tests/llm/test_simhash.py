"""SimHash near-duplicates against all pairs."""

import random
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from geosift.llm import graph, simhash

from .fixtures import odd_docs, real_docs, with_clashes


def plain_fingerprint(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(pairs, nodes):
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {n: top(n) for n in nodes}


def plain_classes(fps, distance=3):
    distinct = sorted(set(fps.values()))
    arr = np.array(distinct, np.uint64)
    pairs = [(f, distinct[j]) for i, f in enumerate(distinct) for j in np.flatnonzero(np.bitwise_count(arr[i + 1 :] ^ arr[i]) <= distance) + i + 1]
    tops = plain_components(pairs, distinct)
    least = {}
    for d, f in fps.items():
        least[tops[f]] = min(d, least.get(tops[f], d))
    return {d: least[tops[f]] for d, f in fps.items()}


def test_fingerprints_and_components(spark, sf_dir):
    docs = with_clashes(real_docs(spark, sf_dir.replace("0.001", "0.01"))).unionByName(
        with_clashes(odd_docs(spark).where("doc_id is not null").dropDuplicates(["doc_id"]).withColumn("doc_id", F.col("doc_id") + 100_000))
    )
    fps = {r.doc_id: plain_fingerprint(r.text or "") for r in docs.select("doc_id", "text").collect()}
    want = plain_classes(fps)
    got = simhash.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got) == Counter((d, fps[d], want[d]) for d in fps)


def shingles(text, size=5):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).split()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


def alike(sets, least):
    """(a, b, Jaccard) of all pairs that share a shingle and reach ``least``."""
    holders = {}
    for d, x in sets.items():
        for g in x:
            holders.setdefault(g, []).append(d)
    shared = Counter((a, b) for h in holders.values() for i, a in enumerate(h) for b in h[i + 1 :])
    return [(a, b, j) for (a, b), n in shared.items() if (j := n / (len(sets[a]) + len(sets[b]) - n)) >= least]


def made_pairs(rng, texts, n):
    """Pairs of a text and a copy with words replaced, each of its own words, so that pairs don't meet."""
    for i in range(n):
        words = [f"{w}.{i}" for w in rng.choice(texts).split()[:400]] or [f"x.{i}"]
        yield " ".join(words)
        for _ in range(rng.choice([1, 1, 2, 3, 4, 6])):
            at = rng.randrange(len(words))
            words[at : at + rng.randint(1, 1 + len(words) // 25)] = [f"new{i}"]
        yield (" ".join(words).upper() if i % 9 == 0 and " ".join(words).isascii() else "\n".join(words))


def test_similar_documents_against_all_pairs(spark):
    """The given texts and made pairs from short to long: nothing below 0.8 is linked, nearly all from it on is."""
    rng = random.Random(9)
    texts = [r.text or "" for r in real_docs(spark, "/root/testdata/sf0.01").collect()]
    given = len(texts)
    texts += list(made_pairs(rng, texts[:], 500))
    sets = {d: shingles(t) for d, t in enumerate(texts)}
    docs = spark.createDataFrame([(d, t, "x") for d, t in enumerate(texts)], "doc_id long, text string, kept_id string")
    found = {r.doc_id: r.component_id for r in simhash.similar(docs, chunk=64).collect()}
    assert set(found) == set(sets)
    pairs = alike(sets, 0.8)
    reach = plain_components([(a, b) for a, b, _ in pairs], list(sets))
    assert all(reach[d] == reach[c] for d, c in found.items())  # exact similarity: no chain of links dips below 0.8
    close = [found[a] == found[b] for a, b, j in pairs if j < 0.9]
    made = [found[a] == found[b] for a, b, _ in pairs if a >= given]
    assert len(made) > 300 and sum(made) >= 0.98 * len(made), (sum(made), len(made))
    assert len(close) > 100 and sum(close) >= 0.97 * len(close), (sum(close), len(close))
    assert all(found[a] == found[b] for a, b, j in pairs if j >= 0.9)
    kept = simhash.survivors(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(found.values())) and kept.columns == docs.columns


def test_likeness_of_wide_fingerprints():
    words = [f"w{i}" for i in range(2000)]
    of = lambda text: simhash.wide_fingerprint(simhash.shingle_set(text), 8)
    one = of(" ".join(words))
    assert len(one) == 8 and (one == of("\t".join(words).upper())).all() and not of(" \n").any()
    for cut in (50, 200, 500):
        other = of(" ".join(words[cut:] + [f"x{i}" for i in range(cut)]))
        alike = (1996 - cut) / (1996 + cut)
        assert abs(int(np.bitwise_count(one ^ other).sum()) - simhash.bits_apart(alike, 512)) < 40


def test_blocks_keep_their_recall_at_any_number_of_rows():
    for rows in (0, 1000, 10**6, 10**9, 10**11):
        width = simhash.block_width(rows)
        n = simhash.block_count(0.8, width)
        assert rows / 2**width <= 16 and 1 - (1 - (1 - simhash.bit_share(0.8)) ** width) ** n >= 0.99


def test_a_chain_is_linked_past_its_representative(spark):
    """Each text is like the next one only: classes by fingerprint fail against one member, groups settle them."""
    words = [f"w{i}" for i in range(1000)]
    chain = [" ".join(words[cut : cut + 500]) for cut in range(0, 500, 50)]
    apart = [" ".join(words[:500] + [f"y{i}" for i in range(170)])]  # 0.74 of the first
    docs = spark.createDataFrame(list(enumerate(chain + apart, 10)), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in simhash.similar(docs).collect()}
    assert found == {**{d: 10 for d in range(10, 20)}, 20: 20}


def test_similar_takes_odd_tables(spark):
    docs = odd_docs(spark)
    assert simhash.similar(docs).count() == docs.count()
    assert simhash.similar(docs.limit(0)).count() == 0


def test_links_find_every_close_pair_in_large_buckets(spark):
    rng = random.Random(4)
    base = rng.getrandbits(64)
    fps = {base, 0, (1 << 64) - 1, 1 << 63}
    for _ in range(600):  # a chain and a cloud of close copies, in few buckets
        near = base
        for b in rng.sample(range(64), rng.randint(0, 5)):
            near ^= 1 << b
        fps.add(near)
    fps |= {rng.getrandbits(64) for _ in range(300)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(i, f) for i, f in enumerate(signed)], "doc_id long, fp long")
    want = plain_classes({f: f % (1 << 64) for f in signed})
    for chunk in (16, 2048):
        nodes = df.select(F.col("fp").alias("node"), F.array("fp").alias("fp"))
        entries = simhash._entries(nodes, [F.col("fp")[0].bitwiseAND(F.lit(m)) for m in simhash.block_masks(3)])
        links = simhash.links(entries, 3, chunk)
        assert links.count() < 40 * len(fps)
        found = {r.node: r.component for r in graph.components(links).collect()}
        assert {f: found.get(f, f) for f in signed} == want


def test_components_of_chains_stars_and_nothing(spark):
    chain = [(i, i + 1) for i in range(0, 60)]
    star = [(1000, 1000 + i) for i in range(1, 200)] + [(1000, 1000)]
    rng = random.Random(3)
    rng.shuffle(chain)
    df = spark.createDataFrame(chain + star + star, "u long, v long")
    got = {r.node: r.component for r in graph.components(df).collect()}
    assert got == {i: 0 for i in range(61)} | {1000 + i: 1000 for i in range(200)}
    assert graph.components(df.limit(0)).count() == 0


def test_null_ids_and_empty_table(spark):
    docs = odd_docs(spark)
    assert simhash.near_duplicates(docs).count() == docs.count()
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_links_of_a_large_group_grow_with_its_members_not_with_its_pairs_of_chunks(spark):
    """One bucket of 800 close nodes in 50 chunks: each pair of chunks gives about a link, each chunk's own links come once."""
    rng = random.Random(6)
    fps = [(1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(800)]
    rows = [(0, 0, i, [f - (1 << 64) if f >> 63 else f]) for i, f in enumerate(fps)]
    entries = spark.createDataFrame(rows, "t int, k long, node long, fp array<long>")
    for found in (simhash.links(entries, 4, 16), simhash.candidates(entries, 4, 4, 16).where("g is null")):
        assert found.count() <= 800 + 50 * 49 / 2
        assert {r.component for r in graph.components(found).collect()} == {0} and graph.components(found).count() == 800


def test_components_shrink_to_a_link_a_node_before_a_shuffle(spark):
    rng = random.Random(7)
    edges = {(a, b) for g in range(0, 900, 90) for a, b in ((g + rng.randrange(90), g + rng.randrange(90)) for _ in range(3000)) if a > b}
    df = spark.createDataFrame(sorted(edges), "u long, v long")
    tops = plain_components(edges, {n for e in edges for n in e})
    once = graph._forests(df.coalesce(1), 1 << 10).collect()
    assert sorted(map(tuple, once)) == sorted((n, top) for n, top in tops.items() if n != top)
    for few in (16, 1000, 1 << 16):
        assert {r.node: r.component for r in graph.components(df, few=few).collect()} == tops
