"""Benchmark decontamination by winnowed fingerprints.

Of every window of consecutive k-grams the one with the smallest hash is kept. Two texts that share a span as long as
k + window - 1 words share the k-grams of one window, hence a fingerprint, so no such span is missed. Fingerprints of
documents and benchmark items are joined by value, whatever the number of places they stand in. Every hit is then extended to both
sides as far as a shared span around it can reach, and the stretches are held against the item word by word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modelwatch.llm.common import WordHashes, alnum_words, map_texts, mix64, row_key, sha256_hex, shingle_hashes, signed, stored

#: Words in a window that counts as contamination, and in a fingerprinted k-gram.
SPAN_WORDS, GRAM_WORDS = 10, 5
#: Bits of the filter over the benchmark's fingerprints. Its size is fixed, whatever the benchmark's.
FILTER_BITS = 2**26


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Positions of the smallest hash of every window, each once; of equal ones so many that every window has one.

    Repetitive text has equal hashes everywhere; there a position stands for all windows that reach it.
    """
    n = len(hashes)
    if n < window:
        return np.zeros(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(hashes, window)[:, ::-1]
    at = np.unique(np.arange(n - window + 1) + window - 1 - views.argmin(axis=1))
    keep, last = np.ones(len(at), bool), -1
    for i in np.flatnonzero((hashes[at[1:-1]] == hashes[at[:-2]]) & (hashes[at[1:-1]] == hashes[at[2:]])) + 1 if len(at) > 2 else ():
        if keep[i - 1]:
            last = at[i - 1]
        keep[i] = at[i + 1] - last > window
    return at[keep]


def sized(hashes: np.ndarray, n_words: int) -> np.ndarray:
    return mix64(hashes + np.uint64(n_words))


def fingerprints(words: np.ndarray, span: int, gram: int, short: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions): winnowed k-grams, and all runs of each length in ``short``."""
    hashes, places = [], []
    if len(words) >= span:
        grams = shingle_hashes(words, gram)
        at = winnow(grams, span - gram + 1)
        hashes.append(sized(grams[at], gram))
        places.append(at)
    for n in short:
        if len(words) >= n:
            grams = shingle_hashes(words, n)
            hashes.append(sized(grams, 1000 + n))
            places.append(np.arange(len(grams)))
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(places)


PRINTS = "array<struct<h:long,at:int>>"


def print_lists(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    """(hashes, positions) of several texts as one list array."""
    ends = np.cumsum([0] + [len(h) for h, _ in found])
    h, at = (np.concatenate([x[i] for x in found]) if found else np.zeros(0) for i in (0, 1))
    fields = [pa.field("h", pa.int64()), pa.field("at", pa.int32())]
    both = pa.StructArray.from_arrays([pa.array(h.astype(np.uint64).view(np.int64)), pa.array(at.astype(np.int32))], fields=fields)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), both)


def item_fingerprints(items: DataFrame, keep: list[str], text_col: str, span: int, gram: int) -> DataFrame:
    """Fingerprints of every item: winnowed k-grams, or the whole item where it is shorter than the span."""

    def fn(texts):
        cache, prints, sizes = WordHashes(), [], []
        for raw in texts:
            words = cache.of(alnum_words(raw or b""))
            n = len(words)
            prints.append(fingerprints(words, span, gram, [n] if 0 < n < span else []))
            sizes.append(n)
        return [sizes, print_lists(prints)]

    return map_texts(items, keep, text_col, fn, f"n long, prints {PRINTS}")


def bit_filter(prints: DataFrame, n_bits: int = FILTER_BITS) -> np.ndarray:
    """One bit per hash value modulo ``n_bits``; combined in the cluster, at most ``n_bits / 64`` numbers reach the driver."""
    slot = F.col("h").bitwiseAND(F.lit(n_bits - 1))
    words = prints.select(
        F.shiftright(slot, 6).alias("word"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("bit")
    )
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(n_bits // 64, np.int64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return out.view(np.uint64)


def window_numbers(codes: np.ndarray, size: int) -> np.ndarray:
    """A number for every run of ``size`` codes; equal runs, and only these, have equal numbers.

    Runs of twice the length are numbered by pairs of numbers, so no hash is involved.
    """
    numbers, length = codes, 1
    while length < size:
        step = min(length, size - length)
        high, low = numbers[:-step], numbers[step:]
        numbers = np.unique(high * (len(codes) + numbers.max() + 1) + low, return_inverse=True)[1]
        length += step
    return numbers


def contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    span: int = SPAN_WORDS,
    gram: int = GRAM_WORDS,
) -> DataFrame:
    """One row per document: its words, the words inside any shared window, and the items that share one.

    A window is ``span`` consecutive words of an item, or a whole item that is shorter and not empty. ``spans`` lists the
    maximal hit runs (first word, end). Null and empty texts have no words. Rows that repeat an id and a text get equal
    rows. Items with a null id count for the hits and are not listed. Other columns do not matter. Empty tables on either
    side give no hits. Time and memory follow the length of texts, also where they say the same few words again and again.
    """
    spark = docs.sparkSession
    bench = items.select(F.col(f"`{item_col}`").cast("string").alias("item"), F.col(f"`{item_text_col}`").alias("body"))
    bench = bench.distinct().withColumn("of", row_key("item", "body"))
    bench_prints = stored(item_fingerprints(bench.withColumn("item_text", F.col("body")), ["item", "of", "item_text"], "body", span, gram), "items")
    short = sorted(r["n"] for r in bench_prints.where((F.col("n") > 0) & (F.col("n") < span)).select("n").distinct().collect())
    item_prints = bench_prints.select("of", F.explode("prints").alias("p")).select("of", "p.h", "p.at")
    bits = spark.sparkContext.broadcast(bit_filter(item_prints.select("h")))

    def fn(texts):
        cache, mask = WordHashes(), np.uint64(FILTER_BITS - 1)
        sizes, prints, kept = [], [], []
        for raw in texts:
            words = cache.of(alnum_words(raw or b""))
            hashes, places = fingerprints(words, span, gram, short)
            slot = hashes & mask
            word = bits.value[(slot >> np.uint64(6)).astype(np.int64)]
            hit = np.flatnonzero((word >> (hashes & np.uint64(63))) & np.uint64(1))
            sizes.append(len(words))
            prints.append((hashes[hit], places[hit]))
            kept.append(raw if len(hit) else None)
        return [sizes, print_lists(prints), kept]

    own = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("body")).withColumn("key", row_key("id", "body"))
    scanned = map_texts(own, ["id", "key"], "body", fn, f"n_words long, prints {PRINTS}, body binary")
    scanned = stored(scanned, "contamination")
    likely = scanned.where(F.size("prints") > 0).select("key", "prints", "body").dropDuplicates(["key"])
    shared = likely.select("key", F.explode(F.array_distinct(F.transform("prints", lambda p: p["h"]))).alias("h"))
    pairs = (
        shared.join(item_prints.select("of", "h").distinct(), "h")
        .groupBy("key", "of")
        .agg(F.collect_list("h").alias("shared"))
        .join(bench_prints.select("of", "item", "item_text"), "of")
        .groupBy("key")
        .agg(F.collect_list(F.struct("item", F.col("item_text").cast("binary").alias("item_text"), "shared")).alias("candidates"))
    )
    extended = extend(likely.join(pairs, "key"), span, gram)
    none = F.lit(0).cast("long")
    return scanned.join(extended, "key", "left").select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", none).alias("n_hit"), F.coalesce("n_items", none).alias("n_items"),
        F.coalesce("items_sha256", F.lit(sha256_hex(""))).alias("items_sha256"),
        (F.coalesce("n_hit", none) > 0).alias("contaminated"), "item_ids", "spans", "key",
    )


def shared_words(text: np.ndarray, item: np.ndarray, hits: np.ndarray, size: int, gram: int) -> np.ndarray:
    """Positions in ``text`` of all words inside a run of ``size`` words that the item has too.

    ``hits`` are positions of shared fingerprints; every such run holds one, so only words in reach of them are looked at.
    """
    reach = np.zeros(len(text) + 1, np.int64)
    np.add.at(reach, np.maximum(0, hits - max(0, size - gram)), 1)
    np.add.at(reach, np.minimum(len(text), hits + size), -1)
    at = np.flatnonzero(np.cumsum(reach[:-1]))
    # Stretches, and the item, stand apart: the code between two is nobody's word.
    gaps = np.flatnonzero(np.diff(at) > 1) + 1
    apart = text.max(initial=0) + 2 + np.arange(len(gaps) + 1)
    row, place = np.insert(text[at], gaps, apart[1:]), np.insert(at, gaps, -1)
    numbers = window_numbers(np.concatenate([row, apart[:1], item]), size)
    found = np.flatnonzero(np.isin(numbers[: max(0, len(row) - size + 1)], numbers[len(row) + 1 :]))
    cover = np.zeros(len(row) + 1, np.int64)
    np.add.at(cover, found, 1)
    np.add.at(cover, found + size, -1)
    return place[np.cumsum(cover[:-1]) > 0]


def extend(candidates: DataFrame, span: int, gram: int) -> DataFrame:
    """Extend the hits of every candidate item, and mark the words of the document that stand in a shared window."""

    def run(batches):
        for batch in batches:
            out = [[], [], [], [], []]
            for i in range(batch.num_rows):
                codes: dict[bytes, int] = {}
                text = np.array([codes.setdefault(w, len(codes)) for w in alnum_words(batch.column(1)[i].as_py())], np.int64)
                prints = batch.column(2)[i].values
                hashes, places = (prints.field(n).to_numpy(zero_copy_only=False) for n in ("h", "at"))
                hit, ids = np.zeros(len(text), bool), set()
                for candidate in batch.column(3)[i].as_py():
                    item = np.array([codes.get(w, -1) for w in alnum_words(candidate["item_text"])], np.int64) + 1
                    at = places[np.isin(hashes, candidate["shared"])].astype(np.int64)
                    words = shared_words(text + 1, item, at, min(span, len(item)), gram)
                    hit[words] = True
                    if len(words) and candidate["item"] is not None:
                        ids.add(candidate["item"])
                edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
                listed = sorted(ids)
                row = (
                    int(hit.sum()), len(listed), sha256_hex(",".join(listed)), listed,
                    [{"first": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2], strict=True)],
                )
                for column, v in zip(out, row, strict=False):
                    column.append(v)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))]
            arrays = [pa.array(c, k) for c, k in zip(out, kinds, strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=schema.names)

    added = T.StructType.fromDDL(
        "n_hit long, n_items long, items_sha256 string, item_ids array<string>, spans array<struct<first:int,end:int>>"
    )
    schema = T.StructType([candidates.schema["key"], *added.fields])
    return candidates.select("key", "body", "prints", "candidates").mapInArrow(run, schema)
