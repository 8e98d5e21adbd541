"""MinHash near-duplicates with circulant signatures, banding and exact verification.

Two permutations make all coordinates of a signature: the first spreads a shingle over the circle of 32-bit integers, the
second is applied after a circular shift by the coordinate's number. Equal sets are one class. Classes that agree in a
band are candidates; a candidate counts only when its full sets are similar enough.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from modelwatch.llm.common import WordHashes, map_texts, mix64, packed, row_key, shingle_hashes, signed, space_words, stored, unpacked
from modelwatch.llm.components import connected_components

#: 32 bands of 4 rows miss a pair of similarity 0.8 with probability (1 - 0.8**4)**32, about 5e-8.
BANDS, ROWS = 32, 4
BLOCK = 256
#: Members of a bucket that are held against each other in one task.
BUCKET_BLOCK = 500


def second_permutation(x: np.ndarray) -> np.ndarray:
    """A fixed permutation of the 32-bit integers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def signature(shingles: np.ndarray, size: int) -> np.ndarray:
    """Circulant signature of a set of 64-bit shingle hashes that is not empty."""
    spread = (mix64(shingles + np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)
    shifts = np.arange(1, size + 1, dtype=np.uint32)
    out = np.full(size, 0xFFFFFFFF, np.uint32)
    for low in range(0, len(spread), BLOCK):
        np.minimum(out, second_permutation(spread[low : low + BLOCK, None] + shifts).min(axis=0), out=out)
    return out


def band_hashes(sig: np.ndarray, rows: int) -> np.ndarray:
    parts = sig.reshape(-1, rows).astype(np.uint64)
    out = np.arange(1, len(parts) + 1, dtype=np.uint64)
    for j in range(rows):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + parts[:, j])
    return out


def shingle_set(raw: bytes | None, width: int, cache: WordHashes) -> np.ndarray:
    """Sorted distinct shingles; a text of fewer words is one shingle, a text without words has none."""
    return np.unique(shingle_hashes(cache.of(space_words(raw or b"")), width))


def set_digest(shingles: np.ndarray) -> tuple[int, int]:
    value = xxhash.xxh3_128_intdigest(shingles.tobytes())
    return tuple(signed(np.array([value >> 64, value & (2**64 - 1)], np.uint64)).tolist())


def sketches(docs: DataFrame, keep: list[str], text_col: str, width: int, bands: int, rows: int) -> DataFrame:
    """Set size, 128-bit digest of the set, and band hashes of every row."""

    def fn(texts):
        cache, sizes, first, second, banded = WordHashes(), [], [], [], []
        for raw in texts:
            s = shingle_set(raw, width, cache)
            a, b = set_digest(s) if len(s) else (None, None)
            sizes.append(len(s))
            first.append(a)
            second.append(b)
            banded.append(signed(band_hashes(signature(s, bands * rows), rows)) if len(s) else None)
        return [sizes, first, second, banded]

    return map_texts(docs, keep, text_col, fn, "n_shingles long, a long, b long, bands array<long>")


def verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (x, y) of classes whose full sets have 100 * intersection >= percent * union."""
    left = texts.select(F.col("a").alias("x"), F.col("body").alias("x_body"))
    right = texts.select(F.col("a").alias("y"), F.col("body").alias("y_body"))
    both = pairs.join(left, "x").join(right, "y").select("x", "y", "x_body", "y_body")

    def run(batches):
        cache, last, sets = WordHashes(), None, None
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            ys, xb, yb = batch.column(1).to_pylist(), batch.column(2), batch.column(3)
            for i, y in enumerate(ys):
                if y != last:  # rows come sorted by y where the join sorts them
                    last, sets = y, shingle_set(yb[i].as_py(), width, cache)
                own = shingle_set(xb[i].as_py(), width, cache)
                common = len(np.intersect1d(own, sets, assume_unique=True))
                keep[i] = 100 * common >= percent * (len(own) + len(sets) - common)
            yield batch.select(["x", "y"]).filter(pa.array(keep))

    return both.mapInArrow(run, T.StructType([pairs.schema["x"], pairs.schema["y"]]))


def links_across(members: DataFrame, grouped: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (x, y) between different components that share a bucket.

    In each bucket the members outside the largest component (strays) are held against all members. Both are dealt into
    blocks, and a task gets one block of each, so a bucket of any size is spread over the cluster; pairs stay inside the
    task and only links leave it.
    """
    marked = members.join(grouped, F.col("a") == F.col("node"), "left").select("band", "a", F.coalesce("component", "a").alias("component"))
    sizes = marked.groupBy("band", "component").agg(F.count(F.lit(1)).alias("n"))
    mains = sizes.groupBy("band").agg(
        F.max(F.struct("n", F.col("component").alias("main"))).alias("top"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts")
    )
    blocks = lambda n: F.ceil(n / BUCKET_BLOCK).cast("int")
    mains = mains.where("parts > 1 and n > 2").select(
        "band", F.col("top.main").alias("main"), blocks(F.col("n")).alias("m_blocks"), blocks(F.col("n") - F.col("top.n")).alias("s_blocks")
    )
    inside = stored(marked.join(mains, "band"), "minhash-open")
    own = lambda n: F.pmod(F.xxhash64("a"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    dealt = inside.select("band", "a", "component", F.lit(False).alias("stray"), own(F.col("m_blocks")).alias("i"), every(F.col("s_blocks")).alias("j"))
    strays = inside.where("component <> main").select(
        "band", "a", "component", F.lit(True).alias("stray"), every(F.col("m_blocks")).alias("i"), own(F.col("s_blocks")).alias("j")
    )
    tasks = dealt.unionByName(strays).join(texts, "a").select("band", "i", "j", "a", "component", "stray", "body")
    tasks = tasks.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")

    def run(batches):
        cache, group, at = WordHashes(), [], None
        for batch in batches:
            links = []
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if row[:3] != at:
                    links += across(group, cache, width, percent)
                    group, at = [], row[:3]
                group.append(row[3:])
            yield as_links(links)
        yield as_links(across(group, cache, width, percent))

    def as_links(links):
        xs, ys = zip(*links, strict=True) if links else ([], [])
        return pa.RecordBatch.from_arrays([pa.array(xs, pa.int64()), pa.array(ys, pa.int64())], names=["x", "y"])

    return tasks.mapInArrow(run, "x long, y long").distinct()


def across(group: list[tuple[int, int, bool, bytes]], cache: WordHashes, width: int, percent: int) -> list[tuple[int, int]]:
    """Links of the strays of one block with its members; rows are (class, component, stray?, text).

    Of the links between the same components one is enough, and so is a chain of them: those that join what earlier links
    of the block have joined already are not put out.
    """
    members, strays = [r for r in group if not r[2]], [r for r in group if r[2]]
    if not members or not strays:
        return []
    sets = {r[0]: shingle_set(r[3], width, cache) for r in group}
    _, codes = np.unique(np.concatenate([sets[r[0]] for r in members] + [sets[r[0]] for r in strays]), return_inverse=True)
    sizes = np.array([len(sets[r[0]]) for r in members])
    starts = np.cumsum(sizes) - sizes
    inside, at = codes[: sizes.sum()], sizes.sum()
    component = np.array([r[1] for r in members])
    present, out = np.zeros(codes.max() + 1, np.int32), []
    parent: dict[int, int] = {}

    def root(c: int) -> int:
        while (up := parent.get(c, c)) != c:
            parent[c] = parent.get(up, up)
            c = up
        return c

    for a, own, _, _ in strays:
        n = len(sets[a])
        mine = codes[at : at + n]
        at += n
        present[mine] = 1
        common = np.add.reduceat(present[inside], starts)
        present[mine] = 0
        linked = np.flatnonzero((100 * common >= percent * (sizes + n - common)) & (component != own))
        for c, i in zip(*np.unique(component[linked], return_index=True), strict=True):
            one, other = root(own), root(int(c))
            if one != other:
                parent[one] = other
                out.append((a, members[linked[i]][0]))
    return out


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    percent: int = 80,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """One row per row of ``docs``: set size, component and whether it is the component's representative.

    Words stand between ASCII white space, A-Z lower-cased; a document is the set of its ``width``-word shingles. Documents
    are linked when 100 * intersection >= ``percent`` * union. ``component_id`` is the smallest id reachable, ``kept`` says
    that it is the document's own. Documents without words are linked with nothing. Null ids are last in order: a component
    of null ids alone has a null ``component_id`` and its rows are kept. Rows that repeat an id share its fate. ``grp`` names
    the component's class (null without words), ``key`` the row. Other columns do not matter; an empty table gives none.

    Candidates are tested twice, so that no bucket is expanded into its pairs: each against the bucket's smallest class,
    then, where a bucket still holds several components, the members outside its largest one against all others. Links
    inside one component would not change the result and are not tested.
    """
    own = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("body")).withColumn("key", row_key("id", "body"))
    rows_of = stored(sketches(own, ["id", "key"], "body", width, bands, rows), "minhash-rows")
    classes = rows_of.where("n_shingles > 0").groupBy("a", "b").agg(F.min("id").alias("id"), F.first("bands").alias("bands"))
    classes = stored(classes, "minhash-classes")
    banded = classes.select("a", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("a").alias("low"), F.max("a").alias("high")).where("low < high")
    members = stored(banded.join(shared, "band"), "minhash-buckets")

    needed = members.select("a").distinct().join(classes.select("a", "id"), "a").withColumnRenamed("id", "of_id")
    texts = needed.join(own.select("id", "body"), F.col("of_id").eqNullSafe(F.col("id"))).select("a", "body")
    texts = stored(matching(texts, width).dropDuplicates(["a"]), "minhash-texts")

    stars = members.where("a <> low").select(F.col("a").alias("x"), F.col("low").alias("y")).distinct()
    found = stored(verified(stars, texts, width, percent), "minhash-first")
    grouped = connected_components(found, "minhash")
    rest = stored(links_across(members.select("band", "a"), grouped, texts, width, percent), "minhash-rest")
    found = found.unionByName(rest)
    grouped = connected_components(found, "minhash")
    named = classes.select("a", "b", "id").join(grouped, F.col("a") == F.col("node"), "left")
    named = named.select("a", "b", "id", F.coalesce("component", "a").alias("grp"))
    smallest = named.groupBy("grp").agg(F.min("id").alias("component_id"))
    named = named.join(smallest, "grp").select(F.col("a").alias("of_a"), F.col("b").alias("of_b"), "grp", "component_id")
    joined = rows_of.join(named, (F.col("a") == F.col("of_a")) & (F.col("b") == F.col("of_b")), "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id"))
    return joined.select(
        F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"),
        "grp", "key",
    )


def matching(candidates: DataFrame, width: int) -> DataFrame:
    """Rows (a, body) whose text has the class's set; an id may stand for several texts."""

    def run(batches):
        cache = WordHashes()
        for batch in batches:
            keep = [
                a == (set_digest(s)[0] if len(s := shingle_set(body.as_py(), width, cache)) else None)
                for a, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)
            ]
            yield batch.filter(pa.array(keep, pa.bool_()))

    source = candidates.select("a", F.col("body").cast("binary").alias("body"))
    return source.mapInArrow(run, source.schema)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each component: the representative's, and of rows that repeat it any one."""
    judged = near_duplicates(docs, id_col, text_col, **options)
    group = F.struct("grp", F.when(F.col("grp").isNull(), F.col("key")).alias("own"))
    one = judged.where("kept").groupBy(group.alias("g")).agg(F.min("key").alias("one"))
    keyed = packed(docs, key=row_key(id_col, text_col)).join(one.select("one"), F.col("key") == F.col("one"))
    copy = F.row_number().over(W.Window.partitionBy("key").orderBy("key"))
    return keyed.withColumn("copy", copy).where("copy = 1").select(*unpacked("row", docs.columns))
