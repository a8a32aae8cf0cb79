"""Language identification by nearest clustered centroids of TF-IDF n-gram vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit.llm.storage import free_name
from docaudit.llm.textops import LOWER, chunked, raw

BUCKETS, SAMPLE_ROWS, LEAST_SHARE, CLUSTERS, ROUNDS, FULL_GRAMS = 4096, 2048, 8, 4, 12, 256
#: Texts whose n-gram counts are held at a time, BUCKETS numbers each.
ROWS = 256
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True


def counts(column: pa.Array) -> np.ndarray:
    """Rows x BUCKETS counts of hashed byte 2- and 3-grams; what is no letter is a blank, and runs of blanks count as one."""
    data, offsets = raw(column)
    x = LOWER[data]
    if len(x):
        accented = np.zeros(len(x), bool)  # capitals of the Latin-1 block, in two bytes
        accented[1:] = (x[:-1] == 0xC3) & (x[1:] >= 0x80) & (x[1:] <= 0x9E) & (x[1:] != 0x97)
        x[accented] += 0x20
    x = np.where(_LETTER[x], x, np.uint8(32)).astype(np.uint32)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    out = np.zeros((len(offsets) - 1) * BUCKETS, np.int64)
    for n in (2, 3):
        if len(x) < n:
            continue
        gram = x[: len(x) - n + 1].copy()
        keep = rows[: len(gram)] == rows[n - 1 :]
        for j in range(1, n):
            keep &= (x[j - 1 : j - 1 + len(gram)] != 32) | (x[j : j + len(gram)] != 32)
            gram = gram * np.uint32(257) + x[j : j + len(gram)]
        gram = (gram * np.uint32(2654435761)) >> np.uint32(20)
        out += np.bincount(rows[: len(gram)][keep] * BUCKETS + gram[keep], minlength=len(out))
    return out.reshape(-1, BUCKETS)


def weighted(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit TF-IDF vectors with dampened counts; rows without n-grams stay zero."""
    v = np.log1p(tf).astype(np.float32) * idf
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(norm > 0, norm, 1)


def cluster(vectors: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from farthest-first seeds."""
    seeds = [0]
    near = vectors @ vectors[0]
    while len(seeds) < min(k, len(vectors)):
        seeds.append(int(near.argmin()))
        near = np.maximum(near, vectors @ vectors[seeds[-1]])
    centres = vectors[seeds]
    for _ in range(ROUNDS):
        own = (vectors @ centres.T).argmax(axis=1)
        sums = np.stack([vectors[own == j].sum(axis=0) if (own == j).any() else centres[j] for j in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres


@dataclass
class Model:
    """Centroids with their languages; a text farther from all of a language's centroids than any sample row by a margin is rejected."""

    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    of: np.ndarray
    least: np.ndarray


def fit(labelled: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", sample_rows: int = SAMPLE_ROWS, clusters: int = CLUSTERS, margin: float = 0.5) -> Model:
    """Learns from a sample of labelled rows: about sample_rows in all, an equal share for each label, chosen by a hash of the id.

    A label's share is LEAST_SHARE rows at least, so with more than sample_rows / LEAST_SHARE labels the sample grows with them.
    Label counts cover all rows. Only they and n-gram counts of the sample (its rows x BUCKETS bytes x 2) come to the driver.
    Rows with a null text or label are not learned from; rows that repeat count each; without rows nothing is learned. Of seeds
    that are equally far the first by label and counts is taken, so a model does not depend on the order of rows.
    """
    rows = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(lang).count().collect()}
    share = max(LEAST_SHARE, sample_rows // max(1, len(sizes)))
    chances = labelled.sparkSession.createDataFrame([(value, min(1.0, share / n)) for value, n in sizes.items()], "__of string, __chance double")
    chance = F.col("__chance")
    picked = rows.join(F.broadcast(chances), F.col(lang) == F.col("__of")).filter(F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.lit(3)), 1) < chance * float(1 << 63)).select(lang, text)

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunked(batches, text, rows=ROWS):
            tf = np.minimum(counts(batch.column(1)), 65535).astype(np.uint16)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in tf], pa.binary())], names=["lang", "tf"])

    sample = picked.mapInArrow(featurise, "lang string, tf binary").collect()
    sample = sorted((r.lang, bytes(r.tf)) for r in sample)
    tf = np.frombuffer(b"".join(b for _, b in sample), np.uint16).reshape(-1, BUCKETS)
    labels = np.array([a for a, _ in sample], object)
    used = tf.any(axis=1) if len(tf) else np.zeros(0, bool)
    tf, labels = tf[used], labels[used]
    idf = np.log((1 + len(tf)) / (1 + (tf > 0).sum(axis=0))).astype(np.float32) + 1
    vectors = weighted(tf, idf)
    languages = sorted(set(labels))
    centroids, of, least = [], [], []
    for i, value in enumerate(languages):
        own = vectors[labels == value]
        centres = cluster(own, clusters)
        centroids.append(centres)
        of += [i] * len(centres)
        least.append(margin * float(np.quantile((own @ centres.T).max(axis=1), 0.01)))
    return Model(languages, idf, np.concatenate(centroids) if centroids else np.zeros((0, BUCKETS), np.float32), np.array(of, int), np.array(least))


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def predict(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """The columns keep, lang_pred, score (cosine, 0 to 1) and rejected for every row; narrow.

    lang_pred is und, with score 0 and rejected, for null texts and texts without letters, and if nothing was learned. Other
    texts get the label of the nearest centroid, of equally near ones that of the first label; rejected says that it is too far to
    be trusted, where the distance allowed grows as a text has fewer than FULL_GRAMS distinct n-grams. Rows that repeat are
    predicted each; an empty table gives no rows. Kept columns of the names of results are replaced by them.
    """
    keep = [c for c in keep if c not in ("lang_pred", "score", "rejected")]
    own_text = text if text in keep else free_name(docs, "read_text")
    schema = ", ".join([f"`{c}` {dict(docs.dtypes)[c]}" for c in keep] + ["lang_pred string, score double, rejected boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunked(batches, own_text, rows=ROWS):
            column = batch.column(own_text)
            data, offsets = raw(column)
            ascii_letter = np.concatenate([[0], np.cumsum((LOWER[data] >= 97) & (LOWER[data] <= 122))])
            lettered = np.diff(ascii_letter[offsets]) > 0
            for r in np.flatnonzero(~lettered):
                lettered[r] = has_letter(bytes(data[offsets[r] : offsets[r + 1]]).decode("utf-8", "replace"))
            names, scores, far = ["und"] * len(lettered), np.zeros(len(lettered)), np.ones(len(lettered), bool)
            if len(model.languages):
                tf = counts(column)
                near = weighted(tf, model.idf) @ model.centroids.T
                trust = np.minimum(1, np.sqrt((tf > 0).sum(axis=1) / FULL_GRAMS))  # few n-grams lie far from any centroid
                best = near.argmax(axis=1) if len(near) else np.zeros(0, int)
                own = model.of[best]
                scores = np.where(lettered, np.clip(near[np.arange(len(best)), best].astype(float), 0, 1), 0.0)
                names = [model.languages[i] if ok else "und" for i, ok in zip(own, lettered, strict=True)]
                far = ~lettered | (scores < model.least[own] * trust)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(far, pa.bool_())], names=[*keep, "lang_pred", "score", "rejected"])

    return docs.select(*keep, *([] if text in keep else [F.col(text).alias(own_text)])).mapInArrow(run, schema)


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds


def language_id(docs: DataFrame, train, keep: list[str]) -> DataFrame:
    """Fits on the rows of docs for which the condition train holds and predicts all rows."""
    return predict(docs, fit(docs.filter(train)), keep)
