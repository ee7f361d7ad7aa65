import random

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.llm import simhash as s
from quarry.llm.components import connected_components


def brute_print(text, n=3):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] if len(words) >= n else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius=2):
    """prints: (id, fingerprint). The smallest id reachable, for each row."""
    distinct = sorted({f for _, f in prints})
    parent = {f: f for f in distinct}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                parent[find(a)] = find(b)
    least = {}
    for i, f in prints:
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    return [(i, f"{f:016x}", least.get(find(f))) for i, f in prints]


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 63), max_size=2))
def test_covering_guarantee(bits):
    flips = sum(1 << b for b in bits)
    assert any(m & flips == 0 for m in s.masks(2))


def test_covering_guarantee_of_five():
    rng = random.Random(3)
    for _ in range(3000):
        flips = sum(1 << b for b in rng.sample(range(64), 5))
        assert any(m & flips == 0 for m in s.masks(5))


def test_against_brute_force(odd, documents):
    for docs in (odd.withColumn("fp", F.lit("x")).withColumn("key", F.lit(1)), documents):
        prints = [(r.doc_id, brute_print(r.text)) for r in docs.collect()]
        got = sorted((tuple(r) for r in s.near_duplicates(docs).collect()), key=repr)
        assert got == sorted(brute_components(prints), key=repr)


@pytest.mark.parametrize("bucket", [2, 64])
def test_links_of_crowded_buckets_are_exact(spark, bucket):
    rng = random.Random(5)
    centre = rng.getrandbits(63)
    prints = {centre ^ sum(1 << b for b in rng.sample(range(63), rng.randint(0, 4))) for _ in range(300)} | {rng.getrandbits(63) for _ in range(50)} | {-1, -2, -4}
    edges = s.links(spark.createDataFrame([(p,) for p in prints], "fp long"), bucket=bucket)
    got = {r.node: r.root for r in connected_components(edges).collect()}
    want = brute_components([(p, p & (1 << 64) - 1) for p in sorted(prints)])
    root = {p: r for (p, _, r) in want}
    for p in prints:
        assert got.get(p, p) == root[p]


def test_components(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 100), (7, 7), (200, None)] + [(300, 300 + k) for k in range(1, 30)]
    rng.shuffle(pairs)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100} | {i: 300 for i in range(300, 330)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_of_the_pipeline(spark, no_docs):
    rng = random.Random(2)
    vocabulary = ["w%d" % i for i in range(3000)]
    rows, planted = [], 0
    for i in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(120, 400))]
        rows.append((1000 + i, " ".join(words)))
        if i % 3 == 0:
            words = list(words)
            words[rng.randrange(len(words))] = "changed"
            rows.append((i, " ".join(words)))
            planted += 1
    rows += [(5000, None), (5001, ""), (None, "alone here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit(1))
    kept = s.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert len(ids & set(range(60))) == planted  # the smaller ids stay
    assert not ids & {1000 + i for i in range(0, 60, 3)}
    assert ids >= {1000 + i for i in range(60) if i % 3} | {5000, None} and 5001 not in ids
    assert s.drop_near_duplicates(no_docs).count() == 0
    assert s.near_duplicates(no_docs).count() == 0


def test_copies_of_one_original_hang_together(spark):
    """Copies are 0.8 like the original but not like each other; it is neither first nor last of anything."""
    rng = random.Random(11)
    original = ["w%d" % rng.randrange(10**6) for _ in range(200)]
    rows = [(300, " ".join(original))]
    for i in range(600):
        words = list(original)
        for at in rng.sample(range(10, 190), 4):
            words[at] = "x%d" % rng.randrange(10**9)
        rows.append((i if i < 300 else i + 1, " ".join(words)))
    sets = {i: s.shingle_set(t, 5) for i, t in rows}
    near = [i for i in sets if s.jaccard(sets[i], sets[300]) >= 0.8]
    assert len(near) > 500 and s.jaccard(sets[0], sets[1]) < 0.8
    kept = {r.doc_id for r in s.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept & set(near) == {min(near)}


@pytest.mark.parametrize("common", [0, 200_000])
def test_every_similar_pair_is_found(spark, monkeypatch, common):
    """Cut, extended and edited copies, short and long, against all pairs; the order of shingles changes nothing."""
    monkeypatch.setattr(s, "SAMPLED", 1 if common else s.SAMPLED)
    rng = random.Random(12)
    rows = []
    for size in (1, 3, 5, 8, 12, 20, 60, 300, 1500):
        for _ in range(12):
            words = ["w%d" % min(int(rng.paretovariate(0.6)), 10**6) for _ in range(size)]
            more = ["w%d" % rng.randrange(10**6) for _ in range(max(1, size // 6))]
            edited = list(words)
            edited[rng.randrange(size)] = "changed"
            rows += [words, words + more, more + words, words[: max(1, size - size // 6)], edited, [w.upper() for w in words]]
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)] + [(9000, None), (9001, " ")]
    sets = {i: s.shingle_set(t, 5) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and s.jaccard(sets[a], sets[b]) >= 0.8:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    kept = sorted(r.doc_id for r in s.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert kept == [i for i in sets if find(i) == i]
