"""SimHash components, k-means and product codes against plain versions."""

import hashlib
import math
import random
import re

import brute
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from modelwatch.llm import pca_clustering, simhash, vector_codes

SF = "/root/testdata/sf0.01"
INF, NAN = math.inf, math.nan


# --- fingerprints


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(brute.A_TO_Z))
    k = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(len(words) - k + 1)] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, most=2):
    parent = {p: p for p in prints}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    every = sorted(parent)
    for i, x in enumerate(every):
        for y in every[:i]:
            if (x ^ y).bit_count() <= most:
                parent[root(x)] = root(y)
    return {p: root(p) for p in every}


def plain_near(rows):
    """(doc_id, fingerprint, component_id, kept) of (doc_id, text) rows."""
    prints = [plain_print(t) for _, t in rows]
    group, smallest = plain_components(prints), {}
    for (i, _), p in zip(rows, prints, strict=True):
        if i is not None:
            smallest[group[p]] = min(i, smallest.get(group[p], i))
    out = []
    for (i, _), p in zip(rows, prints, strict=True):
        c = smallest.get(group[p])
        out.append((i, f"{p:016x}", c, i == c))
    return out


def same(df, want):
    assert sorted((tuple(r) for r in df.collect()), key=repr) == sorted(want, key=repr)


def test_fingerprints_on_awkward_rows(spark):
    docs = brute.frame(spark, brute.documents()).repartition(5)
    same(simhash.near_fingerprints(docs), plain_near([(i, t) for i, t, *_ in brute.documents()]))


def test_fingerprints_on_a_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    same(simhash.near_fingerprints(docs), plain_near([tuple(r) for r in docs.select("doc_id", "text").collect()]))


def test_fingerprint_of_a_text_longer_than_a_slice():
    text = brute.prose(simhash.SLICE + 5_000, 11, 900)
    assert simhash.fingerprint(text.encode()) == plain_print(text)
    assert simhash.fingerprint(b"a b") == xxhash.xxh64_intdigest(b"a b", 42)


def test_fingerprints_of_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string, fp long, key long")
    assert simhash.near_fingerprints(none).count() == 0


def crowd(n, seed, centres=3, flips=4):
    """Fingerprints around few centres: crowded buckets with long chains of links."""
    draw = random.Random(seed)
    middle = [draw.getrandbits(64) for _ in range(centres)]
    out = {0, (1 << 64) - 1}
    while len(out) < n:
        p = draw.choice(middle)
        for _ in range(draw.randint(0, flips)):
            p ^= 1 << draw.randrange(64)
        out.add(p)
    return sorted(out)


@pytest.mark.parametrize("most,bands", [(2, 4), (1, 3), (0, 1), (3, 5)])
def test_links_of_a_crowd(spark, monkeypatch, most, bands):
    """Every bucket is dealt into blocks of a few members, and components are those of all pairs."""
    monkeypatch.setattr(simhash, "BLOCK", 8)
    prints, pivots = crowd(400, most), simhash.Pivots(most, bands)
    frame = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long").repartition(6)
    found = simhash.links(simhash.pivot_tables(frame, pivots), pivots).collect()
    edges = [(r["x"] % (1 << 64), r["y"] % (1 << 64)) for r in found]
    assert all(0 < (x ^ y).bit_count() <= most for x, y in edges)
    parent = {p: p for p in prints}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for x, y in edges:
        parent[root(x)] = root(y)
    want = plain_components(prints, most)
    for group in {frozenset(p for p in prints if want[p] == c) for c in set(want.values())}:
        assert len({root(p) for p in group}) == 1
    assert len({root(p) for p in prints}) == len(set(want.values()))


def test_pairs_within_reach_share_a_key_and_pass_every_coordinate():
    draw, pivots = random.Random(5), simhash.Pivots()
    for _ in range(300):
        a = draw.getrandbits(64)
        b = a ^ (1 << draw.randrange(64)) ^ (1 << draw.randrange(64))
        table = pivots.table(np.array([a, b], np.uint64))
        keys = pivots.keys(table)
        assert (keys[0] == keys[1]).any()
        assert np.abs(table[0].astype(int) - table[1]).max() <= 2


# --- vectors


def vectors(n=300, seed=3):
    """(vec_id, embedding, label) with every awkward case between clustered vectors."""
    draw = random.Random(seed)
    middle = [[draw.gauss(0, 0.3) for _ in range(64)] for _ in range(5)]
    rows = [(i, [x + draw.gauss(0, 0.05) for x in draw.choice(middle)], draw.choice([1, 2, None])) for i in range(n)]
    rows += [(n + i, rows[7][1], 3) for i in range(60)]  # one hot vector
    rows += [(4, rows[5][1], 1), (4, rows[5][1], 1), (None, rows[9][1], 2), (None, [0.0] * 64, None)]
    rows += [(900, None, 1), (901, [], 1), (902, [0.1] * 63, 1), (903, [0.1] * 65, 1), (904, [None] + [0.1] * 63, 1)]
    rows += [(905, [NAN] + [0.1] * 63, 1), (906, [0.1] * 63 + [-INF], 1), (907, [-0.0] * 64, 9), (-3, [-0.001] * 64, 2)]
    return rows


KIND = "vec_id long, embedding array<double>, label int, id string, v string, lead int, rest int, slot int, code string, error int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1, 2, 3, "z", 4) for r in rows], KIND).repartition(5)


def whole(rows, scale):
    ok = [r for r in rows if r[1] is not None and len(r[1]) == 64 and all(x is not None and math.isfinite(x) for x in r[1])]
    return [(i, tuple(math.floor(scale * x) for x in v), label) for i, v, label in ok]


def squared(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def moved(old, parts, labels):
    out = []
    for c, centre in enumerate(old):
        own = [p for p, label in zip(parts, labels, strict=True) if label == c]
        out.append(tuple(sum(x) // len(own) for x in zip(*own, strict=True)) if own else centre)
    return out


def plain_clusters(rows, k=8, rounds=10):
    kept = whole(rows, 1024)
    name = lambda r: hashlib.sha256(f"3:{'null' if r[0] is None else r[0]}".encode()).hexdigest()
    centres = [r[1] for r in sorted(kept, key=lambda r: (name(r), r[1]))[:k]]
    assign = lambda: [min(range(len(centres)), key=lambda c: (squared(v, centres[c]), c)) for _, v, _ in kept]
    for _ in range(rounds):
        centres = moved(centres, [v for _, v, _ in kept], assign())
    labels = assign()
    distance = [squared(v, centres[c]) for (_, v, _), c in zip(kept, labels, strict=True)]
    own = [sum(d for d, x in zip(distance, labels, strict=True) if x == c) for c in range(len(centres))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return [(r[0], c, d, own[c], sum(distance), digest[c]) for r, c, d in zip(kept, labels, distance, strict=True)]


def plain_codes(rows, rounds=2):
    kept = whole(rows, 256)
    starts = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:64]
    cut = lambda v, p: v[4 * p : 4 * p + 4]
    books = [[cut(r[1], p) for r in starts] for p in range(16)]
    near = lambda x, book: min(range(len(book)), key=lambda e: (squared(x, book[e]), e))
    for _ in range(rounds):
        for p in range(16):
            parts = [cut(r[1], p) for r in kept]
            books[p] = moved(books[p], parts, [near(x, books[p]) for x in parts])
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    out, by_label = [], {}
    for i, v, label in kept:
        codes = [near(cut(v, p), books[p]) for p in range(16)]
        error = sum(squared(cut(v, p), books[p][c]) for p, c in enumerate(codes))
        by_label[label] = by_label.get(label, 0) + error
        out.append((i, label, "".join(f"{c:02x}" for c in codes), error))
    return [(i, code, error, by_label[label], digest) for i, label, code, error in out]


@pytest.mark.parametrize("n", [300, 6])
def test_clusters(spark, n):
    rows = vectors(300)[: None if n > 6 else 6]
    same(pca_clustering.cluster(frame(spark, rows)), plain_clusters(rows))


def test_leading_coordinates_do_not_change_clusters(spark):
    rows = vectors(80)
    for leading in (0, 1, 64, 100):
        same(pca_clustering.cluster(frame(spark, rows), leading=leading, rounds=2), plain_clusters(rows, rounds=2))


def test_most_centroids_are_dropped_by_their_bounds():
    v = np.array([r[1] for r in whole(vectors(), 1024)], np.int64)
    axes = np.linalg.eigh(np.cov(v.T))[1][:, ::-1]
    centres = v[[0, 1, 2, 3, 4, 11, 12, 13]]
    chosen, distance, measured = pca_clustering.nearest(v, *pca_clustering.rotated(v, axes, 12), centres, *pca_clustering.rotated(centres, axes, 12))
    full = ((v[:, None] - centres) ** 2).sum(axis=2)
    assert (chosen == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all()
    assert measured < 0.6 * full.size


@pytest.mark.parametrize("n", [200, 9])
def test_codes(spark, n):
    rows = vectors(200)[: None if n > 9 else 9]
    same(vector_codes.encode(frame(spark, rows)), plain_codes(rows))


@pytest.mark.parametrize("width", [1, 3, 4, 5, 8, 16])
def test_search_in_the_transform_domain(width):
    draw = np.random.default_rng(width)
    parts, entries = draw.integers(-40, 40, (500, width)), draw.integers(-40, 40, (64, width))
    entries[40] = entries[3]
    index, distance = vector_codes.nearest(parts, entries)
    full = ((parts[:, None] - entries) ** 2).sum(axis=2)
    assert (index == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all()


def test_sequency_order():
    assert vector_codes.walsh(np.eye(4, dtype=np.int64)).T.tolist() == [[1, 1, 1, 1], [1, 1, -1, -1], [1, -1, -1, 1], [1, -1, 1, -1]]


def test_no_vectors(spark):
    none = spark.createDataFrame([], KIND)
    assert pca_clustering.cluster(none).count() == 0 and vector_codes.encode(none).count() == 0
    odd = frame(spark, [(1, None, 1), (2, [NAN] * 64, 1)])
    assert pca_clustering.cluster(odd).count() == 0 and vector_codes.encode(odd).count() == 0


def test_components_too_large_for_long_distances_are_an_error(spark):
    rows = frame(spark, [(1, [1e9] * 64, 1)])
    with pytest.raises(Exception, match="do not fit in 64 bits"):
        pca_clustering.cluster(rows).count()


def test_single_precision_components(spark):
    rows = [(r[0], r[1], r[2]) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").withColumn("id", F.lit("x"))
    same(vector_codes.encode(table), plain_codes(rows))
