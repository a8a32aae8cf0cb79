"""Phrase collocations: words that stand together more often than their parts would by chance."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docaudit.llm.storage import materialize, shuffle_partitions
from docaudit.llm.textops import _PLACE, LOWER, Words, chunked, mix

#: Bytes between words, and those of them that end a piece: no phrase goes over them.
BREAKS = np.zeros(256, bool)
BREAKS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
BETWEEN = BREAKS.copy()
BETWEEN[[0x20, 0x09]] = True
CHUNK = 1 << 21
#: Bits of the table that n-grams are sifted by: 8 MB, whatever the corpus.
FILTER_BITS = 26
#: Buckets that are ranked together in a round of ranking.
FAN_IN = 64
GRAM = "lang string, size int, phrase string, f long"


def _language_hash(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little")


def _places(words: list[np.ndarray], language: np.ndarray, bits: int) -> np.ndarray:
    """The place in a filter of 2**bits of n-grams given by the hashes of their words and of their language."""
    total = language.copy()
    for j, h in enumerate(words):
        total += h * _PLACE[j]
    return (mix(total) >> np.uint64(64 - bits)).astype(np.int64)


def _gathered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Strings of these byte ranges."""
    sizes = ends - starts
    offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
    inner = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], sizes)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[inner]))


class Chunk:
    """The words of a chunk of rows: languages, hashes, and whether a word goes on the piece of the one before it."""

    def __init__(self, text: pa.Array, lang: pa.Array):
        self.words = w = Words(text, space=BETWEEN)
        coded = lang.dictionary_encode()
        self.names = coded.dictionary.to_pylist()
        of_row = coded.indices.to_numpy()
        self.lang = of_row[w.row] if len(of_row) else np.zeros(0, np.int64)
        ends = np.cumsum(BREAKS[w.data], dtype=np.int64)
        at = ends[w.starts] if len(w.starts) else np.zeros(0, np.int64)
        self.goes_on = np.zeros(len(at), bool)
        self.goes_on[1:] = (at[1:] == at[:-1]) & (w.row[1:] == w.row[:-1])
        languages = np.array([_language_hash(x) for x in self.names], np.uint64)
        self.language_hash = languages[self.lang] if len(self.names) else np.zeros(0, np.uint64)

    def grams(self, size: int, known: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Where in the chunk the first occurrence of each distinct n-gram of a language begins, and how often it occurs.

        known: the filter of frequent (n-1)-grams. N-grams of which either part is not in it are left out.
        """
        w, n = self.words, len(self.words.starts)
        first = np.arange(max(0, n - size + 1))
        for j in range(1, size):
            first = first[self.goes_on[first + j]]
        if known is not None and len(first):
            for shift in (0, 1):
                hashes = [w.hashes[first + shift + j] for j in range(size - 1)]
                place = _places(hashes, self.language_hash[first], (8 * len(known)).bit_length() - 1)
                first = first[(known[place >> 3] >> (place & 7)) & 1 == 1]
        if not len(first):
            return first, first
        # n-grams of a language by numbers: those of their first n - 1 words and of the last one
        code = self.lang[first].astype(np.int64)
        for j in range(size):
            _, last = np.unique(w.hashes[first + j], return_inverse=True)
            _, code = np.unique(code * (int(last.max()) + 1) + last, return_inverse=True)
        _, at, times = np.unique(code, return_index=True, return_counts=True)
        return first[at], times

    def strings(self, first: np.ndarray, size: int) -> pa.Array:
        """The n-grams that begin at these words, space-joined and lower-cased."""
        w = self.words
        used, number = np.unique(first[:, None] + np.arange(size)[None], return_inverse=True)
        spelt = _gathered(LOWER[w.data], w.starts[used], w.ends[used])
        parts = [spelt.take(pa.array(c)) for c in number.reshape(-1, size).T]
        return parts[0] if size == 1 else pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string()))


def exploded(docs: DataFrame, sizes: list[int], known=None) -> DataFrame:
    """Rows (lang, size, phrase, f) of the n-grams of these sizes in lang and text of docs, equal ones of a chunk as one row.

    With words (size 1) comes a row of size 0 for each language of a chunk, with the number of its words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(known.value, np.uint8) if known is not None else None
        for batch in chunked(batches, limit=CHUNK):
            chunk = Chunk(batch.column("text"), batch.column("lang"))
            names = pa.array(chunk.names, pa.string())
            for size in sizes:
                first, times = chunk.grams(size, table)
                if size == 1 and len(names):
                    own = np.bincount(chunk.lang, minlength=len(names))
                    yield pa.RecordBatch.from_arrays([names, pa.array(np.zeros(len(names), np.int32)), pa.array([""] * len(names)), pa.array(own.astype(np.int64))], names=["lang", "size", "phrase", "f"])
                for at in range(0, len(first), 1 << 16):
                    some = slice(at, at + (1 << 16))
                    begin = first[some]
                    yield pa.RecordBatch.from_arrays(
                        [names.take(pa.array(chunk.lang[begin])), pa.array(np.full(len(begin), size, np.int32)), chunk.strings(begin, size).cast(pa.string()), pa.array(times[some].astype(np.int64))], names=["lang", "size", "phrase", "f"]
                    )

    return docs.mapInArrow(run, GRAM)


def filter_of(grams: DataFrame, size: int) -> bytes:
    """A table of 2**FILTER_BITS bits in which those of all these n-grams are set; its size does not depend on theirs."""
    bits = FILTER_BITS

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                h = Words(batch.column("phrase"), space=BETWEEN).hashes.reshape(-1, size)
                coded = batch.column("lang").dictionary_encode()
                languages = np.array([_language_hash(x) for x in coded.dictionary.to_pylist()], np.uint64)[coded.indices.to_numpy()]
                yield pa.RecordBatch.from_arrays([pa.array(_places(list(h.T), languages, bits) + 1)], names=["place"])

    found = grams.filter(F.col("size") == size).select("lang", "phrase").mapInArrow(places, "place long")
    parts = found.groupBy(F.bitmap_bucket_number("place").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits")).collect()
    table = bytearray(1 << (bits - 3))
    for r in parts:
        table[(r.part - 1) * 4096 : r.part * 4096] = r.bits
    return bytes(table)


def ranked(df: DataFrame, keys: list[str], order: list[Column], top: int, tie: str) -> DataFrame:
    """The first `top` rows of each key with their rank.

    A key may have any number of rows, so they are ranked in buckets by a hash of `tie` first, as many as there are shuffle
    partitions, and what is left of FAN_IN buckets together in the next round.
    """
    n, bucket = shuffle_partitions(df.sparkSession), F.xxhash64(tie)
    while n > 1:
        own = Window.partitionBy(*keys, F.pmod(bucket, F.lit(n))).orderBy(*order)
        df = df.withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= top).drop("rank")
        n //= FAN_IN
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= top)


def frequent_grams(docs: DataFrame, max_n: int, min_count: int) -> DataFrame:
    """(lang, size, phrase, f) of all n-grams of up to max_n words that occur min_count times in their language, and of size 0 the
    number of a language's words.

    An n-gram is exploded to a row only if both its (n-1)-grams are frequent, as it cannot be frequent otherwise: each size is
    counted and written before the next is exploded, and a table of bits of a fixed size stands for what is frequent. Bits that
    n-grams share, more of them the larger the corpus, let further n-grams through, which are counted and found to be rare.
    """
    spark, tables, known = docs.sparkSession, [], None
    for size in range(1, max_n + 1):
        counted = exploded(docs, [size], known).groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f"))
        tables.append(materialize(counted.filter((F.col("f") >= min_count) | (F.col("size") == 0)), f"grams-{size}"))
        if size < max_n:
            known = spark.sparkContext.broadcast(filter_of(tables[-1], size))
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    return out


def collocations(docs: DataFrame, max_n: int = 3, min_count: int = 10, top: int = 2000, share: int = 50, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of 2 to max_n words.

    Texts are lower-cased (A-Z) and cut into pieces at `[.,;:!?\\x0A-\\x0D]`, those into words at spaces and tabs. A phrase that
    occurs a >= min_count times within pieces is a candidate. A cut leaves a first part that occurs l times and a rest that occurs
    r times; the candidate's score is the least floor(1000000 a a / (l r)) of its cuts, and of equal ones the shortest first part
    counts. Candidates that stand in a longer one which occurs at least `share` in a hundred times as often go; a phrase that is
    two words longer need not be looked at, as the one between occurs at least as often. Then the first `top` by score, a and
    phrase are left. Products are decimals of 38 digits, exact for counts up to 10^15.

    Null texts count as empty, null languages as `und`. Texts of any length are taken whole; rows that repeat count each; other
    columns are ignored, whatever their names. Without candidates, as in an empty table, there are no rows.
    """
    own = docs.select(F.col(text_col).alias("text"), F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"))
    grams = frequent_grams(own, max_n, min_count)
    totals = grams.filter("size = 0").select("lang", F.col("f").alias("n"))
    counts = grams.filter("size > 0")
    candidates = counts.filter("size > 1").withColumnRenamed("f", "a")
    words = lambda k: F.call_function("substring_index", F.col("phrase"), F.lit(" "), k)
    # every cut of every candidate, with the counts of both parts
    cut = F.transform(F.sequence(F.lit(1), F.col("size") - 1), lambda k: F.struct(k.alias("k"), words(k).alias("first"), words(k - F.col("size")).alias("rest")))
    cuts = candidates.select("lang", "phrase", "size", "a", F.inline(cut))
    part = lambda name, count: counts.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    cuts = cuts.join(part("first", "l").hint("merge"), ["lang", "first"]).join(part("rest", "r").hint("merge"), ["lang", "rest"])
    wide = lambda c: F.col(c).cast("decimal(16,0)")
    # a quotient of decimals is truncated, which is floor here; as a <= l and a <= r it is 1000000 at most
    product = (wide("a") * wide("a")).cast("decimal(32,0)") * F.lit(1000000).cast("decimal(7,0)")
    cuts = cuts.withColumn("score", F.call_function("div", product.cast("decimal(38,0)"), (wide("l") * wide("r")).cast("decimal(32,0)")))
    lowest = cuts.groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("x"))
    scored = lowest.select("lang", "phrase", "a", "x.l", "x.r", "x.score")
    # one-word extensions that take a candidate's place
    shorter = F.array(words(F.col("size") - 1), words(1 - F.col("size")))
    longer = candidates.filter("size > 2").select("lang", F.explode(shorter).alias("phrase"), F.col("a").alias("f")).groupBy("lang", "phrase").agg(F.max("f").alias("f"))
    left = scored.join(longer.hint("merge"), (scored["lang"] == longer["lang"]) & (scored["phrase"] == longer["phrase"]) & (100 * longer["f"] >= share * scored["a"]), "left_anti")
    best = ranked(left, ["lang"], [F.desc("score"), F.desc("a"), F.asc("phrase")], top, "phrase")
    # a row a language, of a language's best only
    return best.join(totals.hint("merge"), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
