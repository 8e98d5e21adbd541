"""SimHash near-duplicates through tables of distances to pivot fingerprints.

A pivot table holds a fingerprint's Hamming distances to many fixed reference fingerprints. By the triangle inequality no
coordinate of two close fingerprints' rows differs by more than their distance, so a pair is dropped at the first coordinate
that does; what survives all coordinates is verified bit by bit.

Half of the pivots are the others with one band of bits flipped. The difference of two such coordinates gives the distance to
a pivot within that band alone. Two fingerprints that differ in few bits leave some bands alone, and there all these distances
agree: they are the keys under which pairs meet, so no pair is missed and no cross join is needed.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelwatch.llm.common import map_texts, mix64, signed, space_words, stored
from modelwatch.llm.components import connected_components

#: Seed of the shingles' XXH64.
SEED = 42
BITS = 64
#: Shingles whose bits are unpacked at a time.
SLICE = 1 << 16
#: Members of a bucket that meet in one task are at most two blocks.
BLOCK = 2048


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """Unsigned SimHash of the text's ``width``-word shingles, repeats included; zero without words."""
    words = space_words(text or b"")
    if not words:
        return 0
    width = min(width, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n, ones = len(words) - width + 1, np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for low in range(0, n, SLICE):
        spans = zip(starts[low : min(n, low + SLICE)].tolist(), ends[low + width - 1 : low + width - 1 + SLICE].tolist(), strict=True)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], np.dtype("<u8"))
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


class Pivots:
    """Reference fingerprints, and the keys that follow from distances to them.

    ``base`` pivots are spread by a fixed hash; each also stands with one of ``bands`` bands of bits flipped. For fingerprints
    that differ in up to ``most`` bits, at least ``bands - most`` bands are alike.
    """

    def __init__(self, most: int = 2, bands: int = 4, base: int = 12) -> None:
        if not 0 <= most < bands <= BITS:
            raise ValueError("bands must be more than the differing bits, and at most 64")
        cuts = [BITS * b // bands for b in range(bands + 1)]
        self.masks = np.array([(1 << high) - (1 << low) for low, high in zip(cuts, cuts[1:], strict=False)], np.uint64)
        self.sizes = np.diff(cuts).astype(np.int16)
        self.base = mix64(np.arange(1, base + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.all = np.concatenate([self.base, (self.base[:, None] ^ self.masks).ravel()])
        self.most, self.alike = most, list(combinations(range(bands), bands - most))

    def table(self, prints: np.ndarray) -> np.ndarray:
        """Distances to every pivot, a row per fingerprint."""
        return np.bitwise_count(prints[:, None] ^ self.all)

    def keys(self, table: np.ndarray) -> np.ndarray:
        """One key per choice of bands that may be alike, from the table's differences alone."""
        n, base = len(table), len(self.base)
        table = table.astype(np.int16)
        inside = (table[:, :base, None] - table[:, base:].reshape(n, base, -1) + self.sizes) // 2
        out = np.empty((n, len(self.alike)), np.uint64)
        for c, chosen in enumerate(self.alike):
            key = np.full(n, c + 1, np.uint64)
            for band in chosen:
                for p in range(base):
                    key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + inside[:, p, band].astype(np.uint64))
            out[:, c] = key
        return out


def pivot_tables(prints: DataFrame, pivots: Pivots) -> DataFrame:
    """(fp, distances, keys) of fingerprints."""

    def run(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            table = pivots.table(fps)
            width, n_keys = table.shape[1], len(pivots.alike)
            distances = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(fps), [None, pa.py_buffer(table.tobytes())])
            offsets = pa.array(np.arange(len(fps) + 1, dtype=np.int32) * n_keys)
            keys = pa.ListArray.from_arrays(offsets, pa.array(signed(pivots.keys(table)).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), distances.cast(pa.binary()), keys], names=["fp", "distances", "keys"])

    return prints.select("fp").mapInArrow(run, "fp long, distances binary, keys array<long>")


def joining_links(groups: np.ndarray, sides: np.ndarray, fps: np.ndarray, table: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside runs of equal ``groups``, fewer where earlier ones of the run have joined the two already.

    Each row is held against the one ``s`` places on, for all rows at once and s = 1, 2, ... up to the longest run. Rows of
    one side are not held against each other, unless the side is negative.
    """
    n = len(groups)
    table = table.astype(np.int16)
    ends = np.searchsorted(groups, groups, side="right")
    left, parent, active, found = ends - np.arange(n), np.arange(n), np.arange(n), []
    s = 0
    while True:
        s += 1
        active = active[left[active] > s]
        if not len(active):
            break
        i, j = active, active + s
        meet = ((sides[i] < 0) | (sides[i] != sides[j])) & (parent[i] != parent[j])
        i, j = i[meet], j[meet]
        for c in range(table.shape[1]):
            near = np.abs(table[i, c] - table[j, c]) <= most
            i, j = i[near], j[near]
            if not len(i):
                break
        near = np.bitwise_count(fps[i] ^ fps[j]) <= most
        i, j = i[near], j[near]
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            x, y = a, b
            while parent[x] != x:
                x = parent[x]
            while parent[y] != y:
                y = parent[y]
            if x != y:
                parent[y] = x
                found.append((a, b))
        if len(i):
            while (parent != (up := parent[parent])).any():
                parent = up
    pairs = np.array(found, np.int64).reshape(-1, 2)
    return fps[pairs[:, 0]], fps[pairs[:, 1]]


def links(tables: DataFrame, pivots: Pivots) -> DataFrame:
    """Links (x, y) between fingerprints that differ in 1 to ``pivots.most`` bits; those that join nothing new may lack.

    Buckets of one key are dealt into blocks, and a task gets two of them, so a bucket of any size is spread over the cluster.
    """
    keyed = tables.select("fp", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = shared.select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    members = keyed.join(shared, "key").select("key", "fp", "blocks", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int").alias("own"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = members.select("key", "fp", "own", other).select(
        "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp",
        F.when(F.col("own") == F.col("other"), -1).otherwise(F.col("own")).alias("side"),
    )
    crossing = dealt.join(tables.select("fp", "distances"), "fp").select("key", "i", "j", "side", "fp", "distances")
    tasks = crossing.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "fp")
    n_pivots, most = len(pivots.all), pivots.most

    def run(batches):
        rest = None
        for batch in batches:
            whole = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks().to_batches()[0]
            last = whole.num_rows - 1
            ids = [whole.column(c).to_numpy(zero_copy_only=False) for c in range(3)]
            same = np.logical_and.reduce([c == c[last] for c in ids])
            cut = int(same.argmax())
            rest = whole.slice(cut)
            yield linked(whole.slice(0, cut))
        if rest is not None:
            yield linked(rest)

    def linked(batch):
        key, i, j, side, fp = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(5)]
        starts = np.ones(len(key), bool)
        starts[1:] = (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        table = np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint8).reshape(-1, n_pivots)
        x, y = joining_links(np.cumsum(starts), side, fp.view(np.uint64), table, most)
        return pa.RecordBatch.from_arrays([pa.array(signed(x)), pa.array(signed(y))], names=["x", "y"])

    return tasks.mapInArrow(run, "x long, y long").distinct()


def near_fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, most: int = 2, bands: int = 4, base: int = 12
) -> DataFrame:
    """One row per row of ``docs``: fingerprint (16 hex digits), component and whether it is the component's representative.

    Words stand between ASCII white space, A-Z lower-cased; a shingle is ``width`` words joined by single spaces, and a text of
    fewer words is one shingle. A bit of the fingerprint is 1 if more than half of the shingles' XXH64 have it. Fingerprints link
    at ``most`` or fewer differing bits, and ``component_id`` is the smallest id reachable.

    Null, empty and white-space texts have fingerprint zero and are linked like any other. Null ids are last in order: a component
    of null ids alone has a null ``component_id``. Rows that repeat an id or a text each give a row. Texts of any length are
    hashed in slices. Columns besides id and text do not matter; an empty table gives none. Equal fingerprints are one
    node, so copies never meet as pairs; all links between different fingerprints are followed.
    """
    pivots = Pivots(most, bands, base)
    own = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("body"))
    prints = map_texts(own, ["id"], "body", lambda texts: [signed(np.array([fingerprint(t, width) for t in texts], np.uint64))], "fp long")
    rows_of = stored(prints, "simhash-rows")
    nodes = stored(rows_of.groupBy("fp").agg(F.min("id").alias("id")), "simhash-prints")
    tables = stored(pivot_tables(nodes, pivots), "simhash-pivots")
    grouped = connected_components(stored(links(tables, pivots), "simhash-links"), "simhash")
    named = nodes.join(grouped, F.col("fp") == F.col("node"), "left").select("fp", "id", F.coalesce("component", "fp").alias("grp"))
    smallest = named.groupBy("grp").agg(F.min("id").alias("component_id"))
    named = named.join(smallest, "grp").select(F.col("fp").alias("of_fp"), "component_id")
    return rows_of.join(named, F.col("fp") == F.col("of_fp")).select(
        F.col("id").alias(id_col),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"),
    )
