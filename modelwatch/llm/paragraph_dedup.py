"""Substring dedup: repeated paragraphs inside documents, found by MinHash banding.

Lines are compared whole: those that share a band are joined, verified by the exact Jaccard similarity of their shingles and
clustered into components, and all lines of a component but the first go. Passages inside running text need smaller units: lines
are also cut into pieces where the text itself says so (at words whose hash is smallest among their neighbours), so a passage falls
into the same pieces wherever it stands. In pieces this short one changed word ends any similarity, so they are joined when equal.
Runs of consecutive repeated pieces are then verified word by word, and extended to both sides within a small edit distance.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from modelwatch.llm.common import mix64, packed, release, row_key, shingle_hashes, signed, unpacked
from modelwatch.llm.common import stored_by_small_batches as stored
from modelwatch.llm.components import connected_components
from modelwatch.llm.decontamination import bit_filter
from modelwatch.llm.minhash import links_across, second_permutation, verified
from modelwatch.llm.suffix_dedup import Polynomial, only_needed, smallest_in_windows, without

WIDTH, PERCENT = 5, 80
#: Six bands of two rows miss a pair of similarity 0.8 with probability (1 - 0.8**2)**6 = 0.002; of lines that merely share a
#: common shingle few share the least of two orders.
BANDS, ROWS = 6, 2
#: Words to both sides among which a cut must have the smallest hash: pieces inside a line have 13 words on average.
REACH = 6
#: No cut leaves fewer words than this to its line's start or end.
PIECE_WORDS = 6
#: Words to both sides of a run of repeated pieces that are looked at for more of the passage.
BESIDE = 40
#: Equal words that must follow an edit.
RESUME = 4
#: A repeated line of so many words goes by itself; passages inside lines, and shorter lines, go in runs of so many words.
LEAST_WORDS, LEAST_RUN_WORDS = 6, 15
#: Bits of the filter over bands that occur twice; its size is fixed.
BAND_BITS = 2**28
WORD = re.compile(rb"[^ \t-\r]+")
TOP = np.uint64(2**64 - 1)


def spaced(at: np.ndarray, line: np.ndarray, least: int) -> np.ndarray:
    """Positions of which no two of a line are nearer than ``least``: from left to right, those too near the last are left out."""
    keep, last = np.ones(len(at), bool), 0
    for i in np.flatnonzero((np.diff(at) < least) & (np.diff(line) == 0)).tolist():
        if keep[i]:
            last = at[i]
        keep[i + 1] = at[i + 1] - last >= least
    return at[keep]


def cuts(lines: np.ndarray, pairs: np.ndarray, reach: int) -> np.ndarray:
    """First words of all paragraphs: line starts, and words whose pair hash is smallest within ``reach`` words of its line.

    Equal hashes (repetitive text) do not cut nearer than ``reach`` + 1 words, and no cut leaves fewer than ``PIECE_WORDS``
    words to its line's start or end: only whole lines are shorter.
    """
    line = np.repeat(np.arange(len(lines)), lines)
    first = np.cumsum(lines) - lines
    at = np.arange(len(pairs)) + reach * (line + 1)  # lines stand apart, so they do not look at each other's words
    padded = np.full(len(pairs) + reach * (len(lines) + 1), TOP)
    padded[at] = pairs
    least = smallest_in_windows(padded, 2 * reach + 1)[at - reach]
    inner = np.flatnonzero((pairs == least) & (pairs != TOP))
    place, size = inner - first[line[inner]], np.asarray(lines)[line[inner]]
    inner = inner[(place >= PIECE_WORDS) & (size - place >= PIECE_WORDS)]
    return np.union1d(spaced(inner, line[inner], reach + 1), first)


@dataclass
class Paragraphs:
    """Pieces and lines of several texts. Words are counted over all texts; ``first_word`` is each text's.

    Pieces have a first word, an end, a line and two hashes; lines have these, the text they stand in, and band hashes.
    """

    start: np.ndarray
    end: np.ndarray
    line: np.ndarray
    digests: np.ndarray
    line_start: np.ndarray
    line_end: np.ndarray
    line_digests: np.ndarray
    bands: np.ndarray
    text: np.ndarray
    first_word: np.ndarray


SPACE = np.zeros(256, bool)
SPACE[list(b" \t\n\r\x0b\f")] = True
#: Bytes that are hashed at a time.
SLICE = 1 << 22
SPELLING = Polynomial(5)


def hashed_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First byte and 64-bit hash of every word of a text, from prefix hashes over its bytes, slice by slice."""
    starts, hashes, at = [], [], 0
    while at < len(data):
        piece = np.frombuffer(data, np.uint8, min(SLICE, len(data) - at), at)
        space = SPACE[piece]
        if at + len(piece) < len(data):  # no word is cut in two: the slice ends behind its last space
            last = np.flatnonzero(space)
            end = at + int(last[-1]) + 1 if len(last) else next_space(data, at + len(piece))
            piece = np.frombuffer(data, np.uint8, end - at, at)
            space = SPACE[piece]
        edges = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
        first, size = edges[::2], edges[1::2] - edges[::2]
        hashes.append(mix64(SPELLING.of(SPELLING.prefixes(piece), first, size) + size.astype(np.uint64)))
        starts.append(first + at)
        at += len(piece)
    return (np.concatenate(starts), np.concatenate(hashes)) if starts else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def next_space(data: bytes, at: int) -> int:
    """Position behind the next space from ``at`` on."""
    found = re.compile(rb"[ \t-\r]").search(data, at)
    return found.end() if found else len(data)


def paragraphs(raws: Sequence[bytes | None], reach: int = REACH) -> Paragraphs:
    """Cut texts into lines and pieces; texts are taken together but do not see each other, as lines do not."""
    parts = [(raw or b"").lower() for raw in raws]
    data = b"\n".join(parts)
    text_at = np.cumsum([0] + [len(part) + 1 for part in parts[:-1]]) if parts else np.zeros(0, np.int64)
    word_at, words = hashed_words(data)
    first_word = np.searchsorted(word_at, text_at)
    if not len(words):
        none, two = np.zeros(0, np.int64), np.zeros((0, 2), np.uint64)
        return Paragraphs(none, none, none, two, none, none, two, np.zeros((0, BANDS), np.uint64), none, first_word)
    breaks = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
    in_line = np.searchsorted(breaks, word_at)
    line_start = np.flatnonzero(np.diff(in_line, prepend=-1))
    line_end = np.append(line_start[1:], len(words))
    lines, own_text = line_end - line_start, np.searchsorted(text_at, word_at[line_start], side="right") - 1
    pairs = mix64(words * np.uint64(0x9E3779B97F4A7C15) + np.append(words[1:], np.uint64(0)))
    pairs[line_end - 1] = TOP
    start = cuts(lines, pairs, reach)
    end, lines_at = np.append(start[1:], len(words)), (line_start, line_end)
    sums = [p.sums(words) for p in POLYNOMIALS]
    of_runs = lambda a, b: np.column_stack([mix64(p.of(s, a, b - a)) for p, s in zip(POLYNOMIALS, sums, strict=True)])
    line_digests = of_runs(*lines_at)
    return Paragraphs(
        start, end, np.searchsorted(line_end, start, side="right"), of_runs(start, end), *lines_at, line_digests,
        band_hashes(words, *lines_at, line_digests[:, 0]), own_text, first_word,
    )


#: Prefix hashes over the words of a text give the hashes of all its pieces and lines.
POLYNOMIALS = (Polynomial(3), Polynomial(4))


def band_hashes(words: np.ndarray, start: np.ndarray, end: np.ndarray, itself: np.ndarray) -> np.ndarray:
    """MinHash bands of every line; orders of shingles are permutations of 32 bits. A line of fewer words than a shingle has no
    other shingle than ``itself``."""
    spread = np.zeros(len(words), np.uint32)
    if len(words) >= WIDTH:
        spread[: len(words) - WIDTH + 1] = shingle_hashes(words, WIDTH) >> np.uint64(32)
    size = end - start
    crossing = np.arange(len(words)) + WIDTH > np.repeat(end, size)
    short = np.flatnonzero(size < WIDTH)
    alone = (itself[short] >> np.uint64(32)).astype(np.uint32)
    out = np.zeros((len(start), BANDS), np.uint64)
    for c in range(BANDS * ROWS):
        shift = np.uint32((c + 1) * 0x9E3779B1 % 2**32)
        order = second_permutation(spread + shift)
        order[crossing] = 0xFFFFFFFF
        least = np.minimum.reduceat(order, start)
        least[short] = second_permutation(alone + shift)
        out[:, c // ROWS] = (out[:, c // ROWS] << np.uint64(32)) | least
    return mix64(out * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, BANDS + 1, dtype=np.uint64))


def chunks(batch: pa.RecordBatch, column: int, rows: int = 100):
    """(low, texts) of consecutive parts of a batch."""
    for low in range(0, batch.num_rows, rows):
        yield low, batch.column(column).slice(low, rows).to_pylist()


def hashed_units(own: DataFrame) -> DataFrame:
    """Band hashes of all lines and one hash of all pieces, one row each."""

    def run(batches):
        for batch in batches:
            for _, raws in chunks(batch, 0):
                p = paragraphs(raws)
                yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate([p.bands.ravel(), p.digests[:, 0]])))], names=["h"])

    return own.select("body").mapInArrow(run, "h long")


PLACE = ["start", "end", "low", "high"]
UNIT = """no int, line int, is_line boolean, n_pieces int, start int, end int, low int, high int, n_all int,
          d1 long, d2 long, bands array<long>"""


def candidate_units(own: DataFrame, bits) -> DataFrame:
    """Lines with a band that occurs twice and pieces whose hash does, by place; and one row (no = -1) per document with its
    number of pieces. ``start`` and ``end`` are words of the document, which has ``n_all``; from ``low`` to ``high`` are the words
    of the line that are looked at for more of a passage. Texts do not travel."""
    schema = T.StructType([*own.schema.fields[:2], *T.StructType.fromDDL(UNIT).fields])
    names, mask = schema.names, np.uint64(BAND_BITS - 1)

    def hits(hashes: np.ndarray) -> np.ndarray:
        word = bits.value[((hashes & mask) >> np.uint64(6)).astype(np.int64)]
        return ((word >> (hashes & np.uint64(63))) & np.uint64(1)).astype(bool)

    def run(batches):
        for batch in batches:
            for low, raws in chunks(batch, 2):
                yield units(batch.slice(low, len(raws)), raws)

    def units(rows, raws):
        p, n = paragraphs(raws), len(raws)
        piece_text = p.text[p.line] if len(p.line) else p.line
        counts = np.bincount(piece_text, minlength=n)
        n_all = np.bincount(p.text, weights=p.line_end - p.line_start, minlength=n).astype(np.int64)
        first_piece, first_line = np.cumsum(counts) - counts, np.searchsorted(p.text, np.arange(n))
        pieces = np.bincount(p.line, minlength=len(p.line_start))
        lines, parts = np.flatnonzero(hits(p.bands).any(axis=1)), np.flatnonzero(hits(p.digests[:, 0]))
        of = np.concatenate([np.arange(n), p.text[lines], piece_text[parts]]).astype(np.int64)
        before = p.first_word[of]
        none = np.zeros(n, np.int64)
        line = np.concatenate([none, lines, p.line[parts]]).astype(np.int64)
        start = np.concatenate([before[:n], p.line_start[lines], p.start[parts]])
        end = np.concatenate([before[:n], p.line_end[lines], p.end[parts]])
        left, right = (np.append(x, 0)[line] for x in (p.line_start, p.line_end))
        is_line = np.arange(len(of)) - n < len(lines)
        columns = [
            np.concatenate([none - 1, lines - first_line[p.text[lines]], parts - first_piece[piece_text[parts]]]),
            np.where(np.arange(len(of)) < n, 0, line - first_line[of]), None,
            np.concatenate([counts, pieces[lines], np.ones(len(parts), np.int64)]),
            start - before, end - before, np.maximum(left, start - BESIDE) - before, np.minimum(right, end + BESIDE) - before, n_all[of],
        ]
        arrays = [pa.array(c.astype(np.int32)) if c is not None else pa.array(is_line & (np.arange(len(of)) >= n)) for c in columns]
        known = np.concatenate([np.zeros((n, 2), np.uint64), p.line_digests[lines], p.digests[parts]])
        arrays += [pa.array(signed(known[:, j])) for j in (0, 1)]
        bands = [None] * n + list(signed(p.bands[lines])) + [None] * len(parts)
        arrays.append(pa.array(bands, pa.list_(pa.int64())))
        head = rows.take(pa.array(of))
        return pa.RecordBatch.from_arrays([*head.columns[:2], *arrays], names=names)

    return own.select("id", "key", "body").mapInArrow(run, schema)


def spoken_words(places: DataFrame, own: DataFrame) -> DataFrame:
    """(key, low, high, words): the words of each place, lower-cased, with one space between them."""
    asked = places.groupBy("key").agg(F.collect_set(F.struct("low", "high")).alias("places"))
    texts = only_needed(own.select("key", "body"), asked.select("key")).join(asked.select("key"), "key", "left_semi").dropDuplicates(["key"])
    joined = texts.join(asked, "key").select("key", "body", "places")
    schema = T.StructType([joined.schema["key"], *T.StructType.fromDDL("low int, high int, words binary").fields])

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                spoken = batch.column(1)[i].as_py().lower().split()
                found = [(p["low"], p["high"]) for p in batch.column(2)[i].as_py()]
                columns = [pa.array([p[j] for p in found], pa.int32()) for j in (0, 1)]
                words = pa.array([b" ".join(spoken[a:b]) for a, b in found], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i] * len(found))), *columns, words], names=schema.names)

    return joined.mapInArrow(run, schema)


def similar_lines(lines: DataFrame, own: DataFrame) -> DataFrame:
    """(d1, d2, component) of the lines that are not alone: equal ones, and those linked by similarity."""
    place = F.first(F.struct("key", "start", "end")).alias("place")
    first_bands = [F.first(F.col("bands")[j]).alias(f"b{j}") for j in range(BANDS)]
    size = F.greatest(F.first(F.col("end") - F.col("start")) - WIDTH + 1, F.lit(1)).alias("size")
    classes = stored(lines.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n"), size, place, *first_bands), "paragraph-classes")
    banded = classes.select(F.col("d1").alias("a"), "size", F.explode(F.array(*[f"b{j}" for j in range(BANDS)])).alias("band"))
    low = banded.groupBy("band").agg(F.min(F.struct("a", "size")).alias("low"), F.max("a").alias("high")).where("low.a < high")
    members = stored(banded.join(low, "band").select("band", "a", "size", "low"), "paragraph-buckets")
    needed = members.select(F.col("a").alias("d1")).distinct()
    places = classes.join(needed, "d1").select("d1", "place.key", F.col("place.start").alias("low"), F.col("place.end").alias("high"))
    texts = places.join(spoken_words(places, own), ["key", "low", "high"]).select(F.col("d1").alias("a"), F.col("words").alias("body"))
    texts = stored(texts.dropDuplicates(["a"]), "paragraph-texts")
    comparable = PERCENT * F.greatest("size", "low.size") <= 100 * F.least("size", "low.size")
    stars = members.where((F.col("a") != F.col("low.a")) & comparable).select(F.col("a").alias("x"), F.col("low.a").alias("y")).distinct()
    links = stored(verified(stars, texts, WIDTH, PERCENT), "paragraph-links")
    grouped = connected_components(links, "paragraph")
    rest = stored(links_across(members.select("band", "a"), grouped, texts, WIDTH, PERCENT), "paragraph-rest")
    release(texts, members)
    grouped = connected_components(links.unionByName(rest), "paragraph")
    named = classes.join(grouped, F.col("d1") == F.col("node"), "left").select("d1", "d2", "n", F.coalesce("component", "d1").alias("component"))
    several = named.groupBy("component").agg(F.sum("n").alias("n_units")).where("n_units > 1").select("component")
    named = stored(named.join(several, "component").select("d1", "d2", "component"), "paragraph-components")
    release(classes, links, rest)
    return named


def repeated_paragraphs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_words: int = LEAST_WORDS,
    least_run_words: int = LEAST_RUN_WORDS,
) -> DataFrame:
    """One row per document: its pieces, those removed and their words, the spans of words to remove, and where the kept
    copies are (``copies_of``: ids of the documents, distinct and sorted).

    Words stand between ASCII white space, A-Z lower-cased. Lines are linked when the Jaccard similarity of their 5-word
    shingles (a shorter one is a shingle itself) is 0.8 or more. Of a component the line of the smallest id (null ids first), and
    in it the first, stays. Of equal pieces outside removed lines the first stays too; runs of the others go, with the words
    beside them that stand beside the kept one as well, edits of a word or two apart where ``RESUME`` equal words follow.

    A line of fewer than ``least_words`` words and a run of fewer than ``least_run_words`` are put back, unless they are all of
    their document; with 0 for both everything that was found goes. Null, empty and white-space texts have no pieces. Rows that
    repeat an id and a text are one document: one row each, equal. Ties go to the smaller key of the row. Texts of any length are
    taken whole. Other columns do not matter; an empty table gives none.
    """
    own = docs.select(F.col(f"`{id_col}`").alias("id"), row_key(id_col, text_col).alias("key"), F.col(f"`{text_col}`").cast("binary").alias("body"))
    shared = stored(hashed_units(own).groupBy("h").count().where("count > 1").select("h"), "paragraph-hashes")
    bits = own.sparkSession.sparkContext.broadcast(bit_filter(shared, BAND_BITS))
    release(shared)
    found = stored(candidate_units(own, bits), "paragraphs")
    units = found.where("no >= 0")
    lines = units.where("is_line")
    repeats = lines.join(similar_lines(lines, own), ["d1", "d2"]).withColumnRenamed("component", "class")
    removed_lines = stored(but_first(repeats), "paragraph-lines")
    gone = removed_lines.select("key", "line").distinct()
    pieces = units.where("not is_line").join(gone, ["key", "line"], "left_anti").withColumn("class", F.struct("d1", "d2"))
    inside = extended(but_first(pieces), own)
    columns = ["key", "start", "end", "is_line", "n_pieces", "n_all", "kept_in"]
    removed = removed_lines.select(*columns).unionByName(inside.select(*columns)).distinct()
    per_doc = removed.groupBy("key").agg(F.sort_array(F.collect_list(F.struct(*columns[1:]))).alias("units"))
    judged = long_runs(per_doc, least_words, least_run_words)
    none = F.lit(0).cast("long")
    return found.where("no = -1").join(judged, "key", "left").select(
        F.col("id").alias(id_col), F.col("n_pieces").cast("long").alias("n_paragraphs"), F.coalesce("n_removed", none).alias("n_removed"),
        F.coalesce("n_words_removed", none).alias("n_words_removed"),
        F.coalesce("copies_of", F.array().cast(judged.schema["copies_of"].dataType)).alias("copies_of"), "spans", "key",
    )


def but_first(units: DataFrame) -> DataFrame:
    """Units but the first of each class, with the id of the document that keeps it and the unit kept.

    Kept units are stored first, so that the join with them is between two shuffles and a hot class can be split.
    """
    place = F.struct("id", "key", "no", "line", *PLACE)
    keepers = units.groupBy("class").agg(F.min(place).alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    keepers = stored(keepers, "paragraph-keepers")
    others = units.join(keepers, "class").where(~place.eqNullSafe(F.col("keeper")))
    return others.withColumn("kept_in", F.col("keeper.id"))


def resumed(a: Sequence[bytes], b: Sequence[bytes]) -> int:
    """Words at the front of ``a`` that stand at the front of ``b`` too, but for edits of one or two words that ``RESUME`` equal
    words follow."""
    i = j = 0
    while True:
        while i < len(a) and j < len(b) and a[i] == b[j]:
            i, j = i + 1, j + 1
        for x, y in ((1, 1), (1, 0), (0, 1), (2, 2), (2, 1), (1, 2), (2, 0), (0, 2)):
            ahead = a[i + x : i + x + RESUME]
            if len(ahead) == RESUME and ahead == b[j + y : j + y + RESUME]:
                i, j = i + x, j + y
                break
        else:
            return i


def extended(pieces: DataFrame, own: DataFrame) -> DataFrame:
    """Runs of consecutive pieces whose kept copies are consecutive too, moved out over what else the two places share.

    A run whose words are not those of its kept copy is left out.
    """
    kept = ["key", "no", *PLACE]
    flat = pieces.select("key", "line", "no", *PLACE, "n_all", "kept_in", *[F.col(f"keeper.{c}").alias(f"kept_{c}") for c in kept])
    flat = flat.withColumn("shift", F.col("kept_no") - F.col("no"))
    together = ["key", "line", "kept_key", "shift"]
    # Rows that repeat a document have its pieces again: the dense rank takes them as one.
    flat = flat.withColumn("run", F.col("no") - F.dense_rank().over(W.Window.partitionBy(*together).orderBy("no")))
    ends = [f(c).alias(c) for c, f in zip(PLACE, (F.min, F.max, F.min, F.max), strict=True)]
    ends += [f(f"kept_{c}").alias(f"kept_{c}") for c, f in zip(PLACE, (F.min, F.max, F.min, F.max), strict=True)]
    runs = flat.groupBy(*together, "run").agg(*ends, (F.max("no") - F.min("no") + 1).alias("n_pieces"), F.first("n_all").alias("n_all"), F.first("kept_in").alias("kept_in"))
    runs = stored(runs, "paragraph-runs")
    places = runs.select("key", "low", "high").unionByName(runs.select(F.col("kept_key").alias("key"), F.col("kept_low").alias("low"), F.col("kept_high").alias("high")))
    words = stored(spoken_words(places, own), "paragraph-words")
    other = words.withColumnsRenamed({c: f"kept_{c}" for c in words.columns})
    both = runs.join(words, ["key", "low", "high"]).join(other, ["kept_key", "kept_low", "kept_high"])
    source = both.select("key", *PLACE, *[f"kept_{c}" for c in PLACE], "words", "kept_words", "n_pieces", "n_all", "kept_in")
    schema = T.StructType([source.schema[c] for c in ("key", "start", "end", "n_pieces", "n_all", "kept_in")])

    def run(batches):
        for batch in batches:
            where = [batch.column(i).to_numpy() for i in range(1, 9)]
            starts, ends, sure = [], [], []
            for i in range(batch.num_rows):
                start, end, low, _, kept_start, kept_end, kept_low, _ = (int(c[i]) for c in where)
                a, b = (batch.column(n)[i].as_py().split(b" ") for n in ("words", "kept_words"))
                sure.append(a[start - low : end - low] == b[kept_start - kept_low : kept_end - kept_low])
                starts.append(start - resumed(a[: start - low][::-1], b[: kept_start - kept_low][::-1]))
                ends.append(end + resumed(a[end - low :], b[kept_end - kept_low :]))
            moved = {"start": pa.array(starts, pa.int32()), "end": pa.array(ends, pa.int32())}
            out = pa.RecordBatch.from_arrays([moved.get(c, batch.column(c)) for c in schema.names], names=schema.names)
            yield out.filter(pa.array(sure, pa.bool_()))

    return source.mapInArrow(run, schema).withColumn("is_line", F.lit(False))


def long_runs(per_doc: DataFrame, least_words: int, least_run_words: int) -> DataFrame:
    """Keep removals that come in runs of enough words, hold a whole line, or are a whole document; join each run to one span."""
    unit = per_doc.schema["units"].dataType.elementType
    ids = T.ArrayType(unit["kept_in"].dataType)
    schema = T.StructType(
        [
            per_doc.schema["key"],
            *T.StructType.fromDDL("n_removed long, n_words_removed long, spans array<struct<start:int,end:int>>").fields,
            T.StructField("copies_of", ids),
        ]
    )
    names = schema.names

    def run(batches):
        for batch in batches:
            out = [[], [], [], []]
            for units in batch.column(1).to_pylist():
                runs: list[list[dict]] = []
                end = -1  # of the run
                for u in units:
                    if u["start"] <= end:
                        runs[-1].append(u)
                    else:
                        runs.append([u])
                    end = max(end, u["end"])
                sized = [(r, r[0]["start"], max(u["end"] for u in r)) for r in runs]
                whole = lambda r: any(u["is_line"] and u["end"] - u["start"] >= least_words for u in r)
                sized = [(r, a, b) for r, a, b in sized if b - a >= min(least_run_words, r[0]["n_all"]) or whole(r)]
                runs = [r for r, _, _ in sized]
                out[0].append(sum(u["n_pieces"] for r in runs for u in r))
                out[1].append(sum(b - a for _, a, b in sized))
                out[2].append([{"start": a, "end": b} for _, a, b in sized])
                out[3].append(sorted({u["kept_in"] for r in runs for u in r if u["kept_in"] is not None}))
            id_type = batch.schema.field("units").type.value_type.field("kept_in").type
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.list_(id_type)]
            arrays = [pa.array(c, k) for c, k in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=names)

    return per_doc.mapInArrow(run, schema)


def bytes_of(raw: bytes, spans: Sequence[dict[str, int]]) -> list[dict[str, int]]:
    """Spans of words as spans of bytes."""
    places = [m.span() for m in WORD.finditer(raw)]
    return [{"start": places[s["start"]][0], "end": places[s["end"] - 1][1]} for s in spans]


def without_repeats(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the spans of ``found`` (from ``repeated_paragraphs``) cut out of their texts.

    Null texts stay null; a text that is repeated as a whole keeps its white space only. Rows and all other columns stay, repeated
    rows and clashing names included; an empty table gives none.
    """
    spans = found.where("n_removed > 0").select("key", "spans").dropDuplicates(["key"])
    body = F.col(f"`{text_col}`")
    joined = packed(docs, key=row_key(id_col, text_col), body=body).join(spans, "key", "left").select("row", "body", "spans")
    schema = T.StructType([joined.schema["row"], joined.schema["body"]])

    def run(batches):
        for batch in batches:
            cut = [
                t if t is None or not s else without(raw := t.encode(), bytes_of(raw, s)).decode()
                for t, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cut, batch.schema.field("body").type)], names=["row", "body"])

    return joined.mapInArrow(run, schema).select(*unpacked("row", docs.columns, **{text_col: F.col("body")}))
