"""Exact top-k inner products by elimination with a pivot table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docaudit.llm.storage import blocks, materialize, stored

N_PIVOTS, SAMPLE = 56, 4096
QUERIES_PER_BLOCK, CANDIDATES_PER_BLOCK, STEP = 1024, 8192, 256
#: Norms below this: all sums of products are whole numbers that a double holds.
EXACT = float(1 << 52)


def choose_pivots(vectors: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first pivots from a sample of vectors."""
    chosen = [0]
    nearest = np.linalg.norm(vectors - vectors[0], axis=1)
    while len(chosen) < min(n, len(vectors)) and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, np.linalg.norm(vectors - vectors[chosen[-1]], axis=1))
    return vectors[chosen]


def distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Rows of the pivot table: the squared distance to the origin and to each pivot."""
    own = (vectors * vectors).sum(axis=1)
    far = own[:, None] + (pivots * pivots).sum(axis=1)[None] - 2 * (vectors @ pivots.T)
    return np.concatenate([own[:, None], np.maximum(far, 0)], axis=1)


class Bounds:
    """The greatest lower bound on distances that a pivot table allows, and with it the least upper bound on inner products.

    Distances to pivots fix where a vector's image in the space through the origin and the pivots is, and how far off that space
    it lies. Two vectors are at least as far apart as these say: d^2 >= |image(q) - image(x)|^2 + (off(q) - off(x))^2, which no
    single |d(q, p) - d(x, p)| exceeds, and q.x = (|q|^2 + |x|^2 - d^2) / 2 <= image(q).image(x) + off(q) off(x).
    """

    def __init__(self, pivots: np.ndarray):
        self.norms = (pivots * pivots).sum(axis=1)
        size, axes = np.linalg.eigh(pivots @ pivots.T)
        use = size > 1e-9 * max(1.0, float(size.max(initial=0)))
        self.change = axes[:, use] / np.sqrt(size[use])

    def places(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Images and distances off the space, from rows of the pivot table."""
        inner = (table[:, :1] + self.norms[None] - table[:, 1:]) / 2
        image = inner @ self.change
        return image, np.sqrt(np.maximum(table[:, 0] - (image * image).sum(axis=1), 0))

    @staticmethod
    def upper(q: tuple[np.ndarray, np.ndarray, np.ndarray], x: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        """Upper bounds of all pairs of (image, off, squared norm); the slack covers rounding of stored distances."""
        scale = (np.sqrt(q[2])[:, None] + 1) * (np.sqrt(x[2])[None] + 1)
        return q[0] @ x[0].T + q[1][:, None] * x[1][None] + 1e-6 * scale


def products(vectors: np.ndarray, q: np.ndarray, small: bool) -> np.ndarray:
    """Inner products of whole numbers; small: no sum exceeds EXACT. Beyond the range of long the nearest long is taken."""
    if small:
        return (vectors @ q).astype(np.int64)
    whole = [int(x) for x in q.tolist()]
    sums = [sum(int(x) * y for x, y in zip(row, whole, strict=True)) for row in vectors.tolist()]
    return np.array([min(max(s, -(1 << 63)), (1 << 63) - 1) for s in sums], np.int64)


def search(ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray, upper: np.ndarray, q_row: int, q: np.ndarray, k: int, floor: float, small: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """The k best (score, id) of one query in one block that reach `floor`, ties to the smaller id, and how many were evaluated.

    Candidates whose bound reaches the floor, a score that k rows are known to have, are evaluated in the order of their
    bounds until the bound falls below the k-th best score. The query's own row is no candidate.
    """
    order = np.flatnonzero((upper >= floor) & (rows != q_row))
    order = order[np.argsort(-upper[order], kind="stable")]
    best, found, evaluated = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    for at in range(0, len(order), STEP):
        part = order[at : at + STEP]
        if len(found) == k:
            part = part[upper[part] >= best[-1]]
            if not len(part):
                break
        evaluated += len(part)
        scores = np.concatenate([best, products(vectors[part], q, small)])
        both = np.concatenate([found, ids[part]])
        top = np.lexsort((both, -scores))[:k]
        best, found = scores[top], both[top]
    use = best >= floor
    return best[use], found[use], evaluated


def quantised(embeddings: DataFrame, id_col: str, vector_col: str, factor: int) -> DataFrame:
    """(vec_id, v) with v = floor(factor * x); rows without a proper vector are left out."""
    proper = F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")))
    return embeddings.filter(F.col(id_col).isNotNull() & F.coalesce(proper, F.lit(False))).select(
        F.col(id_col).cast("long").alias("vec_id"), F.transform(vector_col, lambda x: F.floor(x.cast("double") * factor).cast("double")).alias("v")
    )


def exact_top_k(embeddings: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", factor: int = 256, evaluated=None) -> DataFrame:
    """query_id, rank, vec_id, score: for each query row its k best other rows by integer inner product.

    is_query is a condition on the column vec_id. The pivot table (squared distances to farthest-first pivots of a bounded sample)
    is computed once and stored. A first pass gives each query a floor, the k-th best score among the sample's rows, so
    that no block starts without one. Queries and candidates then meet in blocks of bounded size, so no task holds more than a
    block of each; each block gives the k rows a query at most that reach the floor, which a window ranks. Vectors are compared
    with vectors of their length only. Null, empty or non-finite vectors and null ids take no part. A query's own row is no
    candidate, but other rows of its id are; rows that repeat are queries and candidates each. Equal scores go to the smaller
    id; scores beyond the range of long are the nearest long; an empty table gives no rows; other columns are ignored. An accumulator `evaluated` is given the number of evaluations.
    """
    # written once: a row keeps its number whatever is computed again
    numbered = materialize(quantised(embeddings, id_col, vector_col, factor).withColumn("row", F.monotonically_increasing_id()), "vectors")
    sample = numbered.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    by_dim: dict[int, list] = {}
    for r in sample:
        by_dim.setdefault(len(r.v), []).append((r.row, r.v))
    known = {dim: (np.array([x for x, _ in rows]), np.array([v for _, v in rows])) for dim, rows in by_dim.items()}
    pivots = {dim: choose_pivots(v[:1024], N_PIVOTS) for dim, (_, v) in known.items()}
    largest = {dim: float((v * v).sum(axis=1).max()) for dim, (_, v) in known.items()}

    def pivot_table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [np.asarray(c.values) for c in batch.column("v")]
            t, floor, asks = [b""] * len(cells), [-np.inf] * len(cells), batch.column("is_query").to_pylist()
            own_row = batch.column("row").to_numpy()
            for dim in {len(x) for x in cells}:
                at = [i for i, x in enumerate(cells) if len(x) == dim]
                x = np.stack([cells[i] for i in at])
                table = distances(x, pivots.get(dim, np.zeros((0, dim))))
                for i, row in zip(at, table, strict=True):
                    t[i] = row.tobytes()
                ask = [n for n, i in enumerate(at) if asks[i]]
                if ask and dim in known and max(largest[dim], float(table[:, 0].max())) < EXACT:
                    rows, v = known[dim]
                    scores = x[ask] @ v.T
                    scores[own_row[[at[n] for n in ask]][:, None] == rows[None]] = -np.inf
                    if scores.shape[1] >= k:
                        kth = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
                        for n, f in zip(ask, kth.tolist(), strict=True):
                            floor[at[n]] = f
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("row"), batch.column("is_query"), pa.array([len(x) for x in cells], pa.int32()), pa.array([x.tobytes() for x in cells], pa.binary()), pa.array(t, pa.binary()), pa.array(floor, pa.float64())],
                names=["vec_id", "row", "is_query", "dim", "v", "t", "floor"],
            )

    asked = numbered.withColumn("is_query", F.coalesce(is_query, F.lit(False)))
    table = stored(asked.mapInArrow(pivot_table, "vec_id long, row long, is_query boolean, dim int, v binary, t binary, floor double"), "pivot-table")
    n = table.agg(F.count(F.lit(1)).alias("n"), F.count_if("is_query").alias("q")).first()
    c_blocks, q_blocks = blocks(n.n, CANDIDATES_PER_BLOCK), blocks(n.q, QUERIES_PER_BLOCK)

    def spread(df: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        return df.withColumn(own, F.pmod(F.xxhash64("row"), F.lit(n_own)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))))

    key = ["dim", "qb", "cb"]
    left = spread(table.filter("is_query"), "qb", q_blocks, "cb", c_blocks).select(*key, "vec_id", "row", "v", "t", "floor").groupBy(*key)
    right = spread(table, "cb", c_blocks, "qb", q_blocks).select(*key, "vec_id", "row", "v", "t").groupBy(*key)

    def match(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            stack = lambda s: np.frombuffer(b"".join(s)).reshape(len(s), -1)
            bounds = Bounds(pivots.get(int(a["dim"].iloc[0]), np.zeros((0, 1))))
            ids, rows, vectors, t = b["vec_id"].to_numpy(), b["row"].to_numpy(), stack(b["v"]), stack(b["t"])
            there = (*bounds.places(t), t[:, 0])
            q_ids, q_rows, qs, q_t, floors = a["vec_id"].to_numpy(), a["row"].to_numpy(), stack(a["v"]), stack(a["t"]), a["floor"].to_numpy()
            small, total = max(float(t[:, 0].max()), float(q_t[:, 0].max())) < EXACT, 0
            for at in range(0, len(a), 128):
                s = slice(at, at + 128)
                upper = bounds.upper((*bounds.places(q_t[s]), q_t[s, 0]), there)
                for i, row in enumerate(upper, at):
                    scores, found, seen = search(ids, rows, vectors, row, q_rows[i], qs[i], k, floors[i], small)
                    total += seen
                    out.append(pd.DataFrame({"query_row": q_rows[i], "query_id": q_ids[i], "vec_id": found, "score": scores}))
            if evaluated is not None:
                evaluated.add(total)
        return pd.concat(out) if out else pd.DataFrame({"query_row": [], "query_id": [], "vec_id": [], "score": []}).astype("int64")

    near = left.cogroup(right).applyInPandas(match, "query_row long, query_id long, vec_id long, score long")
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
