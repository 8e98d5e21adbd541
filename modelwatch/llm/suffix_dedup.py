"""Removal of long repeated byte strings by a suffix sort.

A byte is removed when it lies in a string of ``length`` bytes that also starts elsewhere in the corpus. Every such
window is filed under the smallest k-gram hash inside it, which is the same wherever the window occurs. Runs of windows
with one smallest hash are segments. Equal segments repeat as a whole; where one hash has several different segments, the
suffixes are sorted by prefix doubling: those with equal first bytes are told apart by the order of their next ones, up to
``length`` bytes, and neighbours that are still equal are repeats. Nothing is removed on hashes alone: the sort compares
bytes only, equal segments and windows that were only counted are confirmed byte by byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from modelwatch.llm.common import mix64, release, row_key
from modelwatch.llm.common import stored_by_small_batches as stored

LENGTH, GRAM = 400, 40
#: Bytes of a text that are worked on at a time; texts may be longer.
PIECE = 1 << 18
#: Hashes with more different segments than this are compared by the hashes of single windows, dealt out over the cluster,
#: and runs of windows that seem to repeat are then held against the bytes of one that stands for them.
MOST_SEGMENTS = 1_024
#: Texts whose k-grams are hashed together.
HASH_BYTES = 1 << 16
#: Text sorted together in one task; sorting takes some 100 times as many bytes of memory.
SORT_BYTES = 200_000
#: Bits of the filter over keys of texts that are needed again; its size is fixed.
KEY_BITS = 2**26


class Polynomial:
    """Prefix polynomial hashes modulo 2**64 over bytes that are first spread by a fixed table."""

    def __init__(self, seed: int) -> None:
        self.table = mix64(np.arange(256, dtype=np.uint64) + np.uint64(seed * 1000 + 1))
        self.base = int(mix64(np.array([seed + 7], np.uint64))[0]) | 1
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _reach(self, n: int) -> None:
        if len(self.powers) < n:
            n = 1 << (n - 1).bit_length()
            for name, base in (("powers", self.base), ("inverses", pow(self.base, -1, 2**64))):
                factors = np.full(n, base, np.uint64)
                factors[0] = 1
                setattr(self, name, np.multiply.accumulate(factors))

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Prefix hashes over 64-bit values."""
        self._reach(len(values) + 1)
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.powers[: len(values)], out=out[1:])
        return out

    def prefixes(self, text: np.ndarray) -> np.ndarray:
        return self.sums(self.table[text])

    def neighbours(self, prefixes: np.ndarray, length: int) -> np.ndarray:
        """Hashes of all strings of ``length`` bytes, one after the other."""
        out = prefixes[length:] - prefixes[:-length]
        out *= self.inverses[: len(out)]
        return out

    def of(self, prefixes: np.ndarray, start: np.ndarray, length) -> np.ndarray:
        """Hashes of the strings of ``length`` bytes at ``start``."""
        return (prefixes[start + length] - prefixes[start]) * self.inverses[start]


FIRST, SECOND = Polynomial(1), Polynomial(2)


def smallest_in_windows(values: np.ndarray, window: int) -> np.ndarray:
    """Smallest value of every window, from those of windows that double in size; the last two overlap."""
    least, size = values, 1
    while 2 * size <= window:
        least, size = np.minimum(least[:-size], least[size:]), 2 * size
    shift = window - size
    return np.minimum(least[: len(least) - shift], least[shift:]) if shift else least


def segment_digest(body: bytes) -> int:
    """64 bits that equal segments share; different ones of one smallest hash that share them are told apart by their bytes."""
    return xxhash.xxh3_64_intdigest(body)


def segments(
    texts: Sequence[bytes], length: int, gram: int, digest_of: Callable[[bytes], int] = segment_digest
) -> list[np.ndarray]:
    """(text, hash, digest, first window, last window, may repeat itself) of every run of windows with one smallest hash.

    All texts have ``length`` bytes or more; each run stays in one of them. Runs are cut where they would exceed the number
    of k-grams in a window.
    """
    window = length - gram + 1
    raw = b"".join(texts)
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    begins = ends - sizes
    prefixes = FIRST.prefixes(np.frombuffer(raw, np.uint8))
    grams = mix64(FIRST.neighbours(prefixes, gram))
    least = smallest_in_windows(grams, window)
    new = np.ones(len(least), bool)
    np.not_equal(least[1:], least[:-1], out=new[1:])
    new[begins] = True
    lo = np.flatnonzero(new)
    own = np.searchsorted(begins, lo, "right") - 1
    stop = ends[own] - length + 1
    end = np.minimum(np.append(lo[1:], len(least)), stop)
    inside = lo < stop  # other windows reach into the next text
    lo, end, own = lo[inside], end[inside], own[inside]
    parts = -(-(end - lo) // window)
    if parts.max() > 1:
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        lo, end, own = np.repeat(lo, parts) + nth * window, np.repeat(end, parts), np.repeat(own, parts)
        end = np.minimum(lo + window, end)
    values = least[lo]
    again = np.zeros(len(lo), bool)
    # Only a value that two near k-grams share can be in a run twice.
    low = np.flatnonzero(grams <= values.max())
    order = np.argsort(grams[low], kind="stable")
    at, value = low[order], grams[low[order]]
    twice = value[1:][(value[1:] == value[:-1]) & (at[1:] - at[:-1] < 2 * window)]
    for i in np.flatnonzero(np.isin(values, twice)).tolist():
        again[i] = np.count_nonzero(grams[lo[i] : end[i] - 1 + window] == values[i]) > 1
    digests = np.fromiter((digest_of(raw[a : b - 1 + length]) for a, b in zip(lo.tolist(), end.tolist(), strict=True)), np.uint64, len(lo))
    return [own, values, digests, lo - begins[own], end - 1 - begins[own], again]


def ranked(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rank of each pair of numbers among the different ones, and whether it occurs once."""
    n = len(high)
    bits, places = int(low.max(initial=0)).bit_length(), n.bit_length()
    pairs = high << bits | low
    if int(high.max(initial=0)).bit_length() + bits + places < 64:
        pairs <<= places  # sorting numbers with their places is faster than sorting the places
        pairs |= np.arange(n)
        pairs.sort()
        order = pairs & ((1 << places) - 1)
        pairs >>= places
    else:
        order = np.argsort(pairs)
        pairs = pairs[order]
    new = np.ones(n + 1, bool)
    np.not_equal(pairs[1:], pairs[:-1], out=new[1:-1])
    rank, once = np.empty(n, np.int64), np.empty(n, bool)
    rank[order] = np.cumsum(new[:-1]) - 1
    once[order] = new[:-1] & new[1:]
    return rank, once


def repeated_windows(texts: Sequence[bytes], groups: Sequence[int], length: int) -> np.ndarray:
    """Whether each window (all of the first text, then all of the second, ...) occurs again within its group.

    Suffixes are sorted by their group and first bytes, then by twice as many, from the ranks of both halves, up to
    ``length``. Where a string stands alone in its group, so does every window around it: suffixes that are in no other
    window are not sorted further. Those with first bytes alone in their bucket of a table are not sorted at all.
    """
    lengths = np.array([len(t) for t in texts])
    starts = np.cumsum(lengths) - lengths
    sizes = lengths - length + 1
    windows = np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    raw = b"".join([*texts, bytes(8)])
    n, k = len(raw) - 8, min(8, length)
    head = np.ndarray(n, ">u8", raw, strides=(1,)).astype(np.uint64) >> np.uint64(64 - 8 * k)
    group = np.repeat(np.asarray(groups, np.int64), lengths)

    bits = n.bit_length() + 2
    bucket = mix64(head ^ (group.view(np.uint64) << np.uint64(40))) >> np.uint64(64 - bits)
    bucket = bucket.view(np.int64)
    left = around_none(windows, np.bincount(bucket, minlength=1 << bits)[bucket] == 1, length - k)
    hit = np.zeros(n, bool)
    needed = reached(left, n, length - 1)
    shift, n = np.uint64(8 * max(k - 4, 0)), len(needed)
    head, group = (head[needed] >> shift).view(np.int64), group[needed]
    left = np.searchsorted(needed, left)  # from here on places among the needed ones
    del bucket

    k = min(4, length)
    at = reached(left, n, length - k)
    found, once = ranked(group[at], head[at])
    rank, alone = np.zeros(n, np.int64), np.zeros(n, bool)
    while True:
        rank[at] = found
        alone[:] = False
        alone[at[once]] = True
        left = around_none(left, alone, length - k)
        if k == length:
            break
        step = min(k, length - k)
        k += step
        at = reached(left, n, length - k)
        found, once = ranked(rank[at], rank[at + step])
    hit[needed[left]] = True
    return hit[windows]


def around_none(windows: np.ndarray, marked: np.ndarray, distance: int) -> np.ndarray:
    """The windows with no marked place up to ``distance`` behind their start."""
    count = np.zeros(len(marked) + 1, np.int32)
    np.cumsum(marked, dtype=np.int32, out=count[1:])
    return windows[count[windows + (distance + 1)] == count[windows]]


def reached(windows: np.ndarray, n: int, distance: int) -> np.ndarray:
    """Places that are up to ``distance`` behind the start of one of the windows."""
    change = np.zeros(n + 1, np.int32)
    change[windows] = 1
    change[windows + (distance + 1)] -= 1
    return np.flatnonzero(np.cumsum(change[:-1], dtype=np.int32))


def ranges(hits: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(part, first, last) of every run of hits; ``sizes`` are those of the parts, which no run crosses."""
    ends = np.cumsum(sizes)
    begins = ends - sizes
    first, last = hits.copy(), hits.copy()
    first[1:] &= ~hits[:-1]
    last[:-1] &= ~hits[1:]
    first[begins] = hits[begins]
    last[ends - 1] = hits[ends - 1]
    first, last = np.flatnonzero(first), np.flatnonzero(last)
    part = np.searchsorted(begins, first, "right") - 1
    return part, first - begins[part], last - begins[part]


SEGMENT = "m long, d1 long, lo long, hi long, again boolean"
RANGES = "array<struct<lo:long,hi:long>>"


def find_segments(own: DataFrame, length: int, gram: int, digest_of: Callable[[bytes], int]) -> DataFrame:
    added = T.StructType.fromDDL(SEGMENT)
    source = own.where(F.octet_length("body") >= length).select("key", "id", "body")
    schema = T.StructType([*source.schema.fields[:2], *added.fields])
    names = schema.names

    def run(batches):
        for batch in batches:
            held, size = [], 0
            for i in range(batch.num_rows):
                raw = batch.column(2)[i].as_py()
                for at in range(0, len(raw) - length + 1, PIECE):
                    held.append((i, at, raw[at : at + PIECE + length - 1]))
                    size += len(held[-1][2])
                    if size >= HASH_BYTES:
                        yield done(batch, held)
                        held, size = [], 0
            if held:
                yield done(batch, held)

    def done(batch, held):
        rows, at, pieces = zip(*held, strict=True)
        own, m, d1, lo, hi, again = segments(pieces, length, gram, digest_of)
        at = np.array(at)[own]
        columns = [m.view(np.int64), d1.view(np.int64), at + lo, at + hi, again]
        kept = batch.select([0, 1]).take(pa.array(np.array(rows)[own]))
        return pa.RecordBatch.from_arrays([*kept.columns, *map(pa.array, columns)], names=names)

    return source.mapInArrow(gathered(run), schema)


def gathered(run, rows: int = 20_000):
    """Join the small batches that ``run`` makes into larger ones."""

    def joined(batches):
        held, n = [], 0
        for batch in run(batches):
            held.append(batch)
            n += batch.num_rows
            if n >= rows:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return joined


def only_needed(own: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of ``own`` whose key may be among ``keys``: thins out the side that carries the texts before it is shuffled."""
    from modelwatch.llm.decontamination import bit_filter

    bits = own.sparkSession.sparkContext.broadcast(bit_filter(keys.select(F.col("key.a").alias("h")), KEY_BITS))
    schema = own.schema

    def run(batches):
        for batch in batches:
            h = batch.column("key").field("a").to_numpy(zero_copy_only=False).view(np.uint64)
            word = bits.value[((h & np.uint64(KEY_BITS - 1)) >> np.uint64(6)).astype(np.int64)]
            yield batch.filter(pa.array(((word >> (h & np.uint64(63))) & np.uint64(1)).astype(bool)))

    return own.mapInArrow(run, schema)


#: What names a segment's class: its smallest hash, its digest, and a number that tells different bytes of one digest apart.
CLASS = ["m", "d1", "c"]


def segment_texts(wanted: DataFrame, own: DataFrame, length: int) -> DataFrame:
    """The bytes of every wanted segment, with its class and place; for ``hot`` ones two hashes of each window as well."""
    kept = [*CLASS, "lo", "copy", "sort", "hot"]
    listed = wanted.groupBy("key", "id").agg(F.collect_list(F.struct(*kept, "hi")).alias("wanted"))
    listed = listed.select(F.col("key").alias("of_key"), F.col("id").alias("of_id"), "wanted")
    texts = only_needed(own, wanted.select("key").distinct())
    both = texts.join(listed, (F.col("key") == F.col("of_key")) & F.col("id").eqNullSafe(F.col("of_id"))).select("key", "id", "body", "wanted")
    added = T.StructType.fromDDL("m long, d1 long, c int, lo long, copy boolean, sort boolean, hot boolean, body binary, h1 array<long>, h2 array<long>")
    schema = T.StructType([*both.schema.fields[:2], *added.fields])
    names = schema.names
    hashes = pa.list_(pa.int64())

    def run(batches):
        for batch in batches:
            bodies, lists = batch.column(2), batch.column(3)
            first = lists.offsets.to_numpy()
            row = np.repeat(np.arange(batch.num_rows), np.diff(first))
            for at in range(0, len(row), 2_000):
                rows, segment = row[at : at + 2_000], lists.values.slice(first[0] + at, min(len(row) - at, 2_000))
                lo, hi, hot = (segment.field(n).to_numpy(zero_copy_only=False) for n in ("lo", "hi", "hot"))
                raw = {i: bodies[i].as_py() for i in np.unique(rows).tolist()}
                found = [raw[i][a : b + length] for i, a, b in zip(rows.tolist(), lo.tolist(), hi.tolist(), strict=True)]
                h1, h2 = [None] * len(found), [None] * len(found)
                for i in np.flatnonzero(hot).tolist():
                    text = np.frombuffer(found[i], np.uint8)
                    windows = np.arange(len(text) - length + 1)
                    h1[i], h2[i] = (window_hashes(p, text, windows, length).view(np.int64) for p in (FIRST, SECOND))
                head = batch.select([0, 1]).take(pa.array(rows))
                made = [pa.array(found, pa.binary()), pa.array(h1, hashes), pa.array(h2, hashes)]
                yield pa.RecordBatch.from_arrays([*head.columns, *[segment.field(n) for n in kept], *made], names=names)

    return both.mapInArrow(gathered(run, 2_000), schema)


def window_hashes(polynomial: Polynomial, text: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    return mix64(polynomial.of(polynomial.prefixes(text), at, length))


def sorted_repeats(texts: DataFrame, length: int) -> DataFrame:
    """Ranges of repeated windows per segment; groups of one hash lie together, many of them are sorted at a time."""

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                row = [c[i].as_py() for c in batch.columns]
                if size >= SORT_BYTES and held[-1][0] != row[0]:
                    yield done(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[-1])
        if held:
            yield done(held)

    def done(held):
        groups = np.cumsum([0] + [a[0] != b[0] for a, b in zip(held, held[1:], strict=False)])
        bodies = [r[-1] for r in held]
        hits = repeated_windows(bodies, groups, length)
        part, lo, hi = ranges(hits, np.array([len(b) - length + 1 for b in bodies]))
        own, first = np.unique(part, return_index=True)
        pairs = pa.StructArray.from_arrays([pa.array(lo), pa.array(hi)], names=["lo", "hi"])
        found = pa.ListArray.from_arrays(pa.array(np.append(first, len(part)), pa.int32()), pairs)
        columns = [pa.array([held[i][c] for i in own.tolist()], k) for c, k in enumerate([pa.int64(), pa.int64(), pa.int32()])]
        return pa.RecordBatch.from_arrays([*columns, found], names=[*CLASS, "found"])

    grouped = texts.where("sort and not hot").select(*CLASS, "body").repartition("m").sortWithinPartitions("m")
    return grouped.mapInArrow(run, f"m long, d1 long, c int, found {RANGES}")


def counted_repeats(texts: DataFrame, length: int) -> DataFrame:
    """The same for hashes with very many segments. Windows are counted by two hashes, each wherever it falls; the smallest
    window of each pair of hashes stands for it. Runs of windows that have consecutive stand-ins are held against the
    bytes of these, and windows of a run that differs are grouped by their bytes."""
    hot = texts.where("hot")
    each = hot.select(F.struct(*CLASS).alias("s"), F.posexplode(F.arrays_zip("h1", "h2")).alias("at", "h")).select("s", "at", "h.h1", "h.h2")
    again = each.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("s", "at")).alias("first")).where("n > 1")
    hits = each.join(again, ["h1", "h2"]).select("s", "at", F.col("first.s").alias("of"), (F.col("first.at") - F.col("at")).alias("shift"))
    in_order = W.Window.partitionBy("s", "of", "shift").orderBy("at")
    runs = hits.withColumn("run", F.col("at") - F.row_number().over(in_order)).groupBy("s", "of", "shift", "run")
    runs = runs.agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    bodies = hot.select(F.struct(*CLASS).alias("s"), "body")
    stands = bodies.select(F.col("s").alias("of"), F.col("body").alias("of_body"))
    start = lambda at: (at + 1).cast("int")
    size = (F.col("hi") - F.col("lo") + length).cast("int")
    own, other = F.substring("body", start(F.col("lo")), size), F.substring("of_body", start(F.col("lo") + F.col("shift")), size)
    held = runs.join(bodies, "s").join(stands, "of").select("s", "lo", "hi", (own == other).alias("same"))
    held = stored(held, "suffix-runs")
    sure, doubtful = held.where("same").select("s", "lo", "hi"), held.where("not same")
    if not doubtful.isEmpty():
        # Two strings share both hashes: all windows with the hashes of such runs are grouped by their bytes instead.
        windows = doubtful.select("s", F.explode(F.sequence("lo", "hi")).alias("at"))
        odd = each.join(windows, ["s", "at"]).select("h1", "h2").distinct()
        spelled = each.join(odd, ["h1", "h2"]).join(bodies, "s").select("s", "at", F.substring("body", start(F.col("at")), F.lit(length)).alias("w"))
        equal = spelled.groupBy("w").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("w")
        exact = spelled.join(equal, "w").select("s", F.col("at").alias("lo"), F.col("at").alias("hi"))
        single = sure.select("s", F.explode(F.sequence("lo", "hi")).alias("at")).join(spelled.select("s", "at"), ["s", "at"], "left_anti")
        sure = single.select("s", F.col("at").alias("lo"), F.col("at").alias("hi")).unionByName(exact)
    found = F.collect_list(F.struct(F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi")))
    return sure.groupBy("s").agg(found.alias("found")).select(*[f"s.{k}" for k in CLASS], "found")


def told_apart(found: DataFrame, texts: DataFrame, own: DataFrame, length: int) -> DataFrame | None:
    """``found`` with different numbers ``c`` for different bytes of one digest; None where every digest has one string."""
    strings = texts.where("copy").select(*CLASS, "body").distinct()
    mixed = stored(strings.groupBy(*CLASS).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*CLASS), "suffix-collisions")
    if mixed.isEmpty():
        return None
    places = ["key", "id", "lo"]
    rows = found.join(mixed, CLASS).select(*places, *CLASS, "hi", *[F.lit(False).alias(n) for n in ("copy", "sort", "hot")])
    spelled = segment_texts(rows, own, length).select(*places, *CLASS, "body")
    strings = spelled.select(*CLASS, "body").distinct()
    numbered = strings.withColumn("number", F.row_number().over(W.Window.partitionBy(*CLASS).orderBy("body")))
    number = spelled.join(numbered, [*CLASS, "body"]).select("key", "id", "lo", "number").distinct()
    renamed = number.select(F.col("key").alias("of_key"), F.col("id").alias("of_id"), F.col("lo").alias("of_lo"), "number")
    same_row = (F.col("key") == F.col("of_key")) & F.col("id").eqNullSafe(F.col("of_id")) & (F.col("lo") == F.col("of_lo"))
    joined = found.join(renamed, same_row, "left").withColumn("c", F.coalesce("number", "c"))
    return stored(joined.select(*found.columns), "suffix-segments")


def repeated_ranges(found: DataFrame, own: DataFrame, length: int, most_segments: int) -> DataFrame:
    """Maximal repeated spans of each text, every repeat confirmed by its bytes."""
    while True:
        place = F.first(F.struct("key", "id", "lo", "hi")).alias("place")
        same = found.groupBy(*CLASS).agg(F.count(F.lit(1)).alias("n"), F.max("again").alias("again"), place)
        same = stored(same, "suffix-distinct")
        mixed = same.groupBy("m").agg(F.count(F.lit(1)).alias("kinds"), F.max("again").alias("any_again")).where("kinds > 1 or any_again")
        flags = F.lit(False).alias("copy"), F.lit(True).alias("sort"), (F.col("kinds") > most_segments).alias("hot")
        one_of_each = same.join(mixed, "m").select("place.key", "place.id", *CLASS, "place.lo", "place.hi", *flags)
        flags = F.lit(True).alias("copy"), F.lit(False).alias("sort"), F.lit(False).alias("hot")
        copies = found.join(same.where("n > 1").select(*CLASS), CLASS).select("key", "id", *CLASS, "lo", "hi", *flags)
        texts = stored(segment_texts(one_of_each.unionByName(copies), own, length), "suffix-texts")
        apart = told_apart(found, texts, own, length)
        if apart is None:
            break
        release(found, same, texts)
        found = apart
    whole = same.where("n > 1").select(
        *CLASS, F.array(F.struct(F.lit(0).cast("long").alias("lo"), (F.col("place.hi") - F.col("place.lo")).alias("hi"))).alias("found")
    )
    repeats = whole.unionByName(sorted_repeats(texts, length)).unionByName(counted_repeats(texts, length))
    repeats = repeats.select(*CLASS, F.explode("found").alias("r"))
    covered = found.select("key", *CLASS, F.col("lo").alias("base")).join(repeats, CLASS)
    covered = covered.select("key", (F.col("base") + F.col("r.lo")).alias("start"), (F.col("base") + F.col("r.hi") + length).alias("end"))
    spans = covered.distinct().groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("raw"))
    spans = stored(merged_spans(spans), "suffix-spans")
    release(found, same, texts)
    return spans


def repeated_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM,
    most_segments: int = MOST_SEGMENTS, digest_of: Callable[[bytes], int] = segment_digest,
) -> DataFrame:
    """One row per document: bytes, bytes and maximal runs to remove, SHA-256 of what is left, and the runs (start, end).

    Texts are UTF-8 bytes, null is empty; nothing matches across documents. Texts shorter than ``length`` bytes lose
    nothing. Texts that occur twice, repeated rows included, lose everything if they are long enough. Very long texts are
    worked on in pieces. Other columns do not matter; an empty table gives none. Repeats are judged on the input, so all
    occurrences of a string go. ``most_segments`` and ``digest_of`` (64 bits of a segment) decide how repeats are found, not which.
    """
    body = F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit("").cast("binary"))
    own = docs.select(F.col(f"`{id_col}`").alias("id"), body.alias("body")).withColumn("key", row_key("body"))
    found = stored(find_segments(own, length, gram, digest_of).withColumn("c", F.lit(0)), "suffix-segments")
    spans = repeated_ranges(found, own, length, most_segments)

    base = own.select("id", "key", F.octet_length("body").cast("long").alias("n_bytes"), F.sha2("body", 256).alias("own_sha"))
    sizes = base.select("key", "n_bytes").distinct()
    partial = spans.join(sizes, "key").where("n_removed < n_bytes").select(F.col("key").alias("of_key"), "spans")
    partial = stored(partial, "suffix-partial")
    texts_left = only_needed(own, partial.select(F.col("of_key").alias("key")))
    kept = kept_digests(texts_left.join(partial, F.col("key") == F.col("of_key")).select("key", "body", "spans"))
    kept = stored(kept.dropDuplicates(["key"]), "suffix-kept")
    release(partial)
    none = F.lit(0).cast("long")
    return base.join(spans, "key", "left").join(kept, "key", "left").select(
        F.col("id").alias(id_col), "n_bytes", F.coalesce("n_removed", none).alias("n_removed"), F.coalesce("n_spans", none).alias("n_spans"),
        F.when(F.col("n_removed").isNull(), F.col("own_sha"))
        .otherwise(F.coalesce("kept_sha256", F.lit(hashlib.sha256(b"").hexdigest())))
        .alias("kept_sha256"),
        "spans", "key",
    )


def merged_spans(spans: DataFrame) -> DataFrame:
    """Overlapping and touching ranges of each text joined; ranges come sorted."""
    schema = T.StructType([spans.schema["key"], *T.StructType.fromDDL("n_removed long, n_spans long, spans array<struct<start:long,end:long>>").fields])
    names = schema.names

    def run(batches):
        kind = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            lists = batch.column(1)
            offsets = lists.offsets.to_numpy()
            fields = lists.values
            starts, ends = (fields.field(n).to_numpy(zero_copy_only=False) for n in ("start", "end"))
            removed, counts, firsts, lasts = [], [], [], []
            for low, high in zip(offsets[:-1], offsets[1:], strict=True):
                # Ranges are sorted: one begins a new run where it starts behind all ends so far.
                reach = np.maximum.accumulate(ends[low:high])
                new = np.flatnonzero(starts[low + 1 : high] > reach[:-1]) + 1
                first, last = starts[low:high][np.append(0, new)], np.append(reach[new - 1], reach[-1])
                removed.append(int((last - first).sum()))
                counts.append(len(first))
                firsts.append(first)
                lasts.append(last)
            flat = [pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in (firsts, lasts)]
            joined = pa.ListArray.from_arrays(
                pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.StructArray.from_arrays(flat, fields=list(kind))
            )
            arrays = [pa.array(removed, pa.int64()), pa.array(counts, pa.int64()), joined]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=names)

    return spans.mapInArrow(run, schema)


def without(raw: bytes, spans: Sequence[dict[str, int]]) -> bytes:
    at, parts = 0, []
    for s in spans:
        parts.append(raw[at : s["start"]])
        at = s["end"]
    return b"".join([*parts, raw[at:]])


def kept_digests(texts: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            out = [
                hashlib.sha256(without(raw.as_py(), spans.as_py())).hexdigest()
                for raw, spans in zip(batch.column(1), batch.column(2), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["key", "kept_sha256"])

    schema = T.StructType([texts.schema["key"], T.StructField("kept_sha256", T.StringType())])
    return texts.mapInArrow(run, schema)
