"""Hard negatives of labelled vectors: rows of other labels whose score comes close to that of a row of the own label."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docaudit.llm.storage import blocks, materialize

ANCHORS_PER_BLOCK, CANDIDATES_PER_BLOCK = 512, 8192
#: Whole numbers that a double holds exactly.
EXACT = float(1 << 53)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of two blocks of whole numbers as longs: one product of matrices of doubles, which is exact as long as no
    sum can reach 2^53, else Python's whole numbers. Scores beyond the range of long are the nearest long."""
    reach = np.sqrt((a * a).sum(axis=1).max(initial=0)) * np.sqrt((b * b).sum(axis=1).max(initial=0))
    if reach * 1.001 < EXACT:
        return (a @ b.T).astype(np.int64)
    left, right = [[int(x) for x in row] for row in a.tolist()], [[int(x) for x in row] for row in b.tolist()]
    low, high = 1 - (1 << 63), (1 << 63) - 1
    return np.array([[min(max(sum(x * y for x, y in zip(p, q, strict=True)), low), high) for q in right] for p in left], np.int64).reshape(len(a), len(b))


def first_of(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's first k allowed columns by score, ties to the smaller column."""
    masked = np.where(allowed, scores, np.iinfo(np.int64).min)
    n = masked.shape[1]
    if n > k:
        kth = -np.partition(-masked.astype(np.float64), k - 1, axis=1)[:, k - 1]
        rows, columns = np.nonzero((masked.astype(np.float64) >= kth[:, None]) & allowed)
    else:
        rows, columns = np.nonzero(allowed)
    order = np.lexsort((columns, -scores[rows, columns], rows))
    rows, columns = rows[order], columns[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows, "left")
    return rows[place < k], columns[place < k]


def prepared(embeddings: DataFrame, is_anchor: Column, label: Column, id_col: str, vector_col: str, factor: int) -> DataFrame:
    """(vec_id, label, anchor, dim, v) of the rows that take part, v as the bytes of doubles floor(factor x)."""
    proper = F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")))
    rows = embeddings.filter(F.col(id_col).isNotNull() & label.isNotNull() & F.coalesce(proper, F.lit(False))).select(
        F.col(id_col).cast("long").alias("vec_id"), label.alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"), F.transform(vector_col, lambda x: F.floor(x.cast("double") * factor).cast("double")).alias("v")
    )

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [np.asarray(c.values, np.float64) for c in batch.column("v")]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([len(x) for x in cells], pa.int32()), pa.array([x.tobytes() for x in cells], pa.binary())], names=["vec_id", "label", "anchor", "dim", "v"])

    return rows.mapInArrow(packed, "vec_id long, label long, anchor boolean, dim int, v binary")


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column)).reshape(len(column), -1)


def hard_negatives(
    embeddings: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, id_col: str = "vec_id", vector_col: str = "embedding", factor: int = 256
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A row's score is its inner product with the anchor, of whole numbers floor(factor x). An anchor's positives are its first other
    rows of the same label; for each of them come the first rows of other labels with low * positive <= 100 * negative <= high *
    positive. Higher scores come first, ties by smaller id. Rows without an id, a label or a proper vector take no part, and vectors
    meet vectors of their length only. Rows that repeat are anchors, positives and negatives each: only the anchor's own row is no
    positive of it. Anchors without positives, positives with nothing in their window and empty tables give no rows; other columns
    are ignored.

    Rows are written once with a number each. Anchors in blocks go to all blocks of candidates, so a task holds one block of
    either and the matrix of their products, whatever the labels' sizes. A first pass gives each anchor's best positives of each
    block, which a window merges to the first of all; a second pass gives the best of each positive's window of scores, merged alike.
    """
    rows = materialize(prepared(embeddings, is_anchor, label, id_col, vector_col, factor).withColumn("row", F.monotonically_increasing_id()), "vectors")
    n = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("anchor").alias("a")).first()
    n_a, n_c = blocks(n.a, ANCHORS_PER_BLOCK), blocks(n.n, CANDIDATES_PER_BLOCK)

    def dealt(df: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        return df.withColumn(own, F.pmod(F.xxhash64("row"), F.lit(n_own)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))))

    key = ["dim", "ab", "cb"]
    anchors = rows.filter("anchor").select(F.col("row").alias("anchor_row"), F.col("vec_id").alias("anchor_id"), "label", "dim", "v", "row")
    candidates = dealt(rows, "cb", n_c, "ab", n_a).select(*[F.col(c).alias(f"c_{c}") for c in (*key, "vec_id", "label", "v", "row")]).groupBy(*[f"c_{c}" for c in key])

    def near(a: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(c):
            return pd.DataFrame({x: np.zeros(0, np.int64) for x in ("anchor_row", "anchor_id", "positive_id", "positive_row", "positive_score")})
        c = c.sort_values(["c_vec_id", "c_row"])
        scores = products(_matrix(a["v"]), _matrix(c["c_v"]))
        allowed = (a["label"].to_numpy()[:, None] == c["c_label"].to_numpy()[None]) & (a["anchor_row"].to_numpy()[:, None] != c["c_row"].to_numpy()[None])
        i, j = first_of(scores, allowed, positives)
        return pd.DataFrame({"anchor_row": a["anchor_row"].to_numpy()[i], "anchor_id": a["anchor_id"].to_numpy()[i], "positive_id": c["c_vec_id"].to_numpy()[j], "positive_row": c["c_row"].to_numpy()[j], "positive_score": scores[i, j]})

    found = dealt(anchors, "ab", n_a, "cb", n_c).drop("row").groupBy(*key).cogroup(candidates).applyInPandas(near, "anchor_row long, anchor_id long, positive_id long, positive_row long, positive_score long")
    first = Window.partitionBy("anchor_row").orderBy(F.desc("positive_score"), "positive_id", "positive_row")
    best = found.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= positives)
    own = best.groupBy("anchor_row").agg(F.sort_array(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("own"))
    # positives are no more than a few an anchor
    asking = materialize(anchors.join(own, "anchor_row").select("anchor_row", "anchor_id", "label", "dim", "v", "row", F.col("own.place").alias("place"), F.col("own.positive_id").alias("positive_id"), F.col("own.positive_score").alias("positive_score")), "positives")

    def close(a: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        names = ("anchor_row", "place", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score")
        out = [pd.DataFrame({x: np.zeros(0, np.int64) for x in names})]
        if len(a) and len(c):
            c = c.sort_values(["c_vec_id", "c_row"])
            ids, scores = c["c_vec_id"].to_numpy(), products(_matrix(a["v"]), _matrix(c["c_v"]))
            other = a["label"].to_numpy()[:, None] != c["c_label"].to_numpy()[None]
            sizes = a["place"].map(len).to_numpy()
            for p in range(int(sizes.max(initial=0))):  # at most as many as an anchor has positives
                at = np.flatnonzero(sizes > p)
                pick = lambda name: np.array([a[name].iloc[x][p] for x in at], np.int64)  # noqa: B023, E731
                score = pick("positive_score")
                # whole bounds of the window: its products might pass 64 bits
                least = np.array([-((-low * s) // 100) for s in score.tolist()], object).clip(1 - (1 << 63), (1 << 63) - 1).astype(np.int64)
                most = np.array([high * s // 100 for s in score.tolist()], object).clip(1 - (1 << 63), (1 << 63) - 1).astype(np.int64)
                own = scores[at]
                i, j = first_of(own, other[at] & (own >= least[:, None]) & (own <= most[:, None]), negatives)
                out.append(pd.DataFrame({
                    "anchor_row": a["anchor_row"].to_numpy()[at][i], "place": pick("place")[i], "anchor_id": a["anchor_id"].to_numpy()[at][i], "positive_id": pick("positive_id")[i],
                    "positive_score": score[i], "negative_id": ids[j], "negative_score": own[i, j],
                }))
        return pd.concat(out)

    met = dealt(asking, "ab", n_a, "cb", n_c).drop("row").groupBy(*key).cogroup(candidates)
    hits = met.applyInPandas(close, "anchor_row long, place long, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    of_pair = Window.partitionBy("anchor_row", "place").orderBy(F.desc("negative_score"), "negative_id")
    ranked = hits.withColumn("rank", F.row_number().over(of_pair)).filter(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
