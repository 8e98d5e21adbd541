"""K-means on integer vectors, with centroids filtered by PCA-rotated coordinates.

Every vector is stored with its leading coordinates in the principal axes and the norm of what is left. The squared distance
of the leading parts plus the squared difference of the norms is never above the squared distance itself, so a centroid whose
bound lies beyond the best exact distance is dropped; the others are measured in integers. Floating point decides only what
is measured, with a margin for its rounding, so results are exact.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelwatch.llm.common import stored
from modelwatch.llm.vectors import exact_means, integer_vectors, matrix, sums_by

#: Share of the squared norms by which a bound may be off through rounding; the true error is about a thousandth of it.
MARGIN = 1e-9
ROWS = 8192


def principal_axes(vectors: DataFrame, dims: int) -> np.ndarray:
    """Orthogonal matrix whose columns are the principal axes of all vectors, strongest first.

    One pass sums products of components; tasks put out one row per pair of components, and ``dims`` squared sums reach the driver.
    """
    upper = np.triu_indices(dims)

    def products(batches):
        n, first, second = 0, np.zeros(dims), np.zeros((dims, dims))
        for batch in batches:
            x = matrix(batch.column(0), dims, np.float64)
            n, first, second = n + len(x), first + x.sum(axis=0), second + x.T @ x
        values = np.concatenate([[n], first, second[upper]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], names=["slot", "value"])

    sums = vectors.select("v").mapInArrow(products, "slot long, value double").groupBy("slot").agg(F.sum("value").alias("value"))
    total = np.zeros(1 + dims + len(upper[0]))
    for r in sums.collect():
        total[r["slot"]] = r["value"]
    n, mean = max(total[0], 1), total[1 : 1 + dims] / max(total[0], 1)
    spread = np.zeros((dims, dims))
    spread[upper] = total[1 + dims :] / n
    spread = np.triu(spread) + np.triu(spread, 1).T - np.outer(mean, mean)
    return np.linalg.eigh(spread)[1][:, ::-1].copy()


def rotated(vectors: np.ndarray, axes: np.ndarray, leading: int) -> tuple[np.ndarray, np.ndarray]:
    """Leading coordinates in the axes, and the norm of the others."""
    turned = vectors.astype(np.float64) @ axes
    return turned[:, :leading], np.sqrt((turned[:, leading:] ** 2).sum(axis=1))


def nearest(v: np.ndarray, lead: np.ndarray, rest: np.ndarray, centroids: np.ndarray, c_lead: np.ndarray, c_rest: np.ndarray):
    """Nearest centroid of every row (ties: smaller number), its squared distance, and the number of exact distances taken."""
    n, every = len(v), np.arange(len(v))
    bound = ((lead[:, None, :] - c_lead) ** 2).sum(axis=2) + (rest[:, None] - c_rest) ** 2
    norms = (lead**2).sum(axis=1)[:, None] + rest[:, None] ** 2 + (c_lead**2).sum(axis=1) + c_rest**2
    bound -= MARGIN * norms
    exact = np.full((n, len(centroids)), np.iinfo(np.int64).max)
    first = bound.argmin(axis=1)
    exact[every, first] = best = ((v - centroids[first]) ** 2).sum(axis=1)
    survives = bound <= best[:, None]
    survives[every, first] = False
    row, c = np.nonzero(survives)
    exact[row, c] = ((v[row] - centroids[c]) ** 2).sum(axis=1)
    chosen = exact.argmin(axis=1)
    return chosen, exact[every, chosen], n + len(row)


def cluster(
    df: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    k: int = 8,
    rounds: int = 10,
    salt: str = "3",
    scale: int = 1024,
    dims: int = 64,
    leading: int = 12,
) -> DataFrame:
    """One row per whole vector: id, cluster, squared distance, inertia of its cluster and of all, its centroid's digest.

    Components are floor(scale * x). The first centroids are the ``k`` vectors with the smallest SHA-256 of "salt:id". Each
    round assigns every vector to its nearest centroid (ties: smaller number) and replaces centroids by the floor of their
    vectors' means; those without vectors stay. Then all are assigned once more.

    Left out: null vectors, other lengths than ``dims``, null, NaN or infinite components. Null ids are hashed as "salt:null".
    Rows that repeat an id count one by one; the start orders them by hash, then by components, so equal vectors can be several
    centroids. With fewer than ``k`` vectors there are fewer centroids; an empty table gives no rows. Other columns do not
    matter. Components beyond 2**26 after scaling end the job with an error. ``leading`` decides speed only.

    The driver holds centroids and the axes; tasks put out one row per centroid, and every round reads the stored vectors.
    """
    leading = max(1, min(leading, dims))
    vectors = stored(integer_vectors(df, vec_col, dims, scale, id=F.col(f"`{id_col}`")), "clustering-vectors")
    name = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("id").cast("string"), F.lit("null"))), 256)
    centroids = [list(r["v"]) for r in vectors.select(name.alias("h"), "v").orderBy("h", "v").limit(k).collect()]
    axes = principal_axes(vectors, dims)

    def rotate(batches):
        for batch in batches:
            lead, rest = rotated(matrix(batch.column(1), dims), axes, leading)
            offsets = pa.array(np.arange(len(lead) + 1, dtype=np.int32) * leading)
            arrays = [*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(lead.ravel())), pa.array(rest)]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "v", "lead", "rest"])

    kind = vectors.schema["id"].dataType.simpleString()
    table = stored(vectors.select("id", "v").mapInArrow(rotate, f"id {kind}, v array<long>, lead array<double>, rest double"), "clustering-rotated")

    def assigned(batch, at, centres, c_lead, c_rest):
        """(vectors, cluster, distance) of slices of a batch; vectors, leading parts and norms stand from column ``at`` on."""
        for low in range(0, batch.num_rows, ROWS):
            part = batch.slice(low, ROWS)
            v, lead, rest = matrix(part.column(at), dims), matrix(part.column(at + 1), leading, np.float64), part.column(at + 2).to_numpy()
            yield part, v, *nearest(v, lead, rest, centres, c_lead, c_rest)[:2]

    for _ in range(rounds if centroids else 0):
        centres = np.array(centroids, np.int64)
        c_lead, c_rest = rotated(centres, axes, leading)

        def sums(batches, centres=centres, c_lead=c_lead, c_rest=c_rest):
            n, total = np.zeros(len(centres), np.int64), np.zeros(centres.shape, np.int64)
            for batch in batches:
                for _, v, chosen, _ in assigned(batch, 0, centres, c_lead, c_rest):
                    some, values = sums_by(chosen, len(centres), v)
                    n, total = n + some, total + values
            used = np.flatnonzero(n)
            arrays = [pa.array(used), pa.array(n[used]), pa.array(total[used].tolist(), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["slot", "n", "sums"])

        partial = table.select("v", "lead", "rest").mapInArrow(sums, "slot long, n long, sums array<long>")
        centroids = exact_means(partial, centroids)

    centres = np.array(centroids, np.int64).reshape(-1, dims)
    c_lead, c_rest = rotated(centres, axes, leading)
    digests = pa.array([hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids], pa.string())

    def final(batches):
        for batch in batches:
            for part, _, chosen, distance in assigned(batch, 1, centres, c_lead, c_rest):
                arrays = [part.column(0), pa.array(chosen.astype(np.int32)), pa.array(distance), digests.take(pa.array(chosen))]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "cluster", "distance", "centroid_sha256"])

    found = stored(table.mapInArrow(final, f"id {kind}, cluster int, distance long, centroid_sha256 string"), "clustering-found")
    inertia = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()  # k rows at most
    by_cluster = {r["cluster"]: r["cluster_inertia"] for r in inertia}
    own = F.element_at(F.array(*[F.lit(by_cluster.get(c, 0)).cast("long") for c in range(max(1, len(centroids)))]), F.col("cluster") + 1)
    total = F.lit(sum(by_cluster.values())).cast("long")
    return found.select(
        F.col("id").alias(id_col), "cluster", "distance", own.alias("cluster_inertia"), total.alias("inertia"), "centroid_sha256"
    )
