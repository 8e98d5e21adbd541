"""Product codes of vectors, searched in the integer Walsh-Hadamard domain.

A vector is cut into parts; each part position has its own codebook, and a part's code is its nearest entry. Parts and entries,
padded with zeros to a power of two, are transformed by additions alone. The transform scales squared distances by its size, and
low sequencies carry most of a smooth part, so squared differences are added in sequency order and an entry is dropped as soon
as its sum passes the best full distance. All in integers: nothing is rounded.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelwatch.llm.common import stored
from modelwatch.llm.vectors import exact_means, integer_vectors, matrix, sums_by

ROWS = 4096


def walsh(values: np.ndarray) -> np.ndarray:
    """Integer Walsh-Hadamard transform of the rows, padded with zeros to a power of two, in sequency order."""
    n, width = values.shape
    size = 1 << max(0, (width - 1).bit_length())
    out = np.zeros((n, size), np.int64)
    out[:, :width] = values
    step = 1
    while step < size:
        pairs = out.reshape(n, -1, 2, step)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, size)
        step *= 2
    return out[:, sequency(size)]


def sequency(size: int) -> np.ndarray:
    """Order of the transform's rows by their number of sign changes."""
    index = np.arange(size)
    signs = np.bitwise_count(index[:, None] & index) & 1
    return np.argsort((signs[:, 1:] != signs[:, :-1]).sum(axis=1), kind="stable")


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of every row (ties: lower index) and the squared distance.

    The first guess is the entry nearest in the first coordinate; its full distance bounds the others. Sums are compared with
    the bound after each coordinate, and only entries not above it go on.
    """
    x, y = walsh(parts), walsh(entries)
    size, every = x.shape[1], np.arange(len(x))
    sums = (x[:, :1] - y[:, 0]) ** 2
    guess = sums.argmin(axis=1)
    bound = ((x - y[guess]) ** 2).sum(axis=1)
    row, entry = np.nonzero(sums <= bound[:, None])
    alive = sums[row, entry]
    for c in range(1, size):
        alive = alive + (x[row, c] - y[entry, c]) ** 2
        stays = alive <= bound[row]
        row, entry, alive = row[stays], entry[stays], alive[stays]
    order = np.lexsort((entry, alive, row))
    firsts = order[np.searchsorted(row[order], every)]
    return entry[firsts], alive[firsts] // size


def encode(
    df: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str | None = "label",
    parts: int = 16,
    entries: int = 64,
    rounds: int = 2,
    scale: int = 256,
    dims: int = 64,
) -> DataFrame:
    """One row per whole vector: id, code, squared error, error of all rows of its label, digest of the codebooks.

    Components are floor(scale * x), cut into ``parts`` equal consecutive parts. Each codebook starts as that part of the
    ``entries`` vectors with the smallest ids. Each round assigns parts to their nearest entries (ties: lower index) and replaces
    entries by the floor of their parts' means; unused ones stay. Then parts are assigned once more. ``code`` has two hex digits
    per part, so there are 256 entries at most.

    Left out: null vectors, null, NaN or infinite components, and other lengths than ``dims``, which cannot be cut alike. Ids
    that repeat are ordered by components, null ids come last; every row is coded by itself. With fewer vectors than
    ``entries`` codebooks are shorter; an empty table gives no rows. Null labels are one label. Other columns do not matter.
    Components beyond 2**26 after scaling end the job with an error.

    The driver holds codebooks (``entries`` x ``dims``) and their sums; tasks put out one row per used entry.
    """
    if dims % parts or not 0 < entries <= 256:
        raise ValueError("dims must be a multiple of parts, and entries 1 to 256")
    width = dims // parts
    label = F.col(f"`{label_col}`") if label_col else F.lit(None).cast("int")
    vectors = stored(integer_vectors(df, vec_col, dims, scale, id=F.col(f"`{id_col}`"), label=label), "codes-vectors")
    starts = vectors.select("id", "v").orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    n_entries = len(starts)
    # Slot p * n_entries + e holds entry e of part p.
    books = [list(r["v"][p * width : (p + 1) * width]) for p in range(parts) for r in starts]

    def as_books(values):
        return np.array(values, np.int64).reshape(parts, n_entries, width)

    def slices(batch, at):
        for low in range(0, batch.num_rows, ROWS):
            part = batch.slice(low, ROWS)
            yield part, matrix(part.column(at), dims).reshape(-1, parts, width)

    for _ in range(rounds if n_entries else 0):

        def sums(batches, fixed=as_books(books)):
            n, total = np.zeros((parts, n_entries), np.int64), np.zeros(fixed.shape, np.int64)
            for batch in batches:
                for _, v in slices(batch, 0):
                    for p in range(parts):
                        some, values = sums_by(nearest(v[:, p], fixed[p])[0], n_entries, v[:, p])
                        n[p] += some
                        total[p] += values
            used = np.flatnonzero(n.ravel())
            values = total.reshape(-1, width)[used]
            arrays = [pa.array(used), pa.array(n.ravel()[used]), pa.array(values.tolist(), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["slot", "n", "sums"])

        books = exact_means(vectors.select("v").mapInArrow(sums, "slot long, n long, sums array<long>"), books)

    fixed = as_books(books)
    digest = hashlib.sha256(",".join(str(x) for entry in books for x in entry).encode()).hexdigest()
    names = np.array([f"{e:02x}" for e in range(max(1, n_entries))])

    def coded(batches):
        for batch in batches:
            for part, v in slices(batch, 2):
                codes, error = np.zeros((len(v), parts), np.int64), np.zeros(len(v), np.int64)
                for p in range(parts):
                    codes[:, p], own = nearest(v[:, p], fixed[p])
                    error += own
                texts = ["".join(row) for row in names[codes]]
                arrays = [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(error)]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "label", "code", "error"])

    kinds = ", ".join(f"{n} {vectors.schema[n].dataType.simpleString()}" for n in ("id", "label"))
    found = stored(vectors.select("id", "label", "v").mapInArrow(coded, f"{kinds}, code string, error long"), "codes-found")
    by_label = found.groupBy(F.col("label").alias("of_label")).agg(F.sum("error").alias("label_error"))
    return found.join(by_label, F.col("label").eqNullSafe(F.col("of_label"))).select(
        F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")
    )
