"""Benchmark decontamination: BM25 over test items, block maxima before scores, then overlap of question and answer."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docaudit.llm.storage import blocks, free_name
from docaudit.llm.textops import _PLACE, SPACE, Words, chunked, mix

#: Blocks are small: items of one language share so many common words that the maxima of 16 items (4) let 79 % (17 %) of the passages of 9,000
#: documents of the check tables through to the cursors, those of 2 let 1 %.
#: BM25 constants; the share of an item's own score that a passage must reach; shares of question and answer n-grams it must hold.
K1, B, THRESHOLD, QUESTION, ANSWER, GRAM = 1.2, 0.75, 0.5, 0.6, 0.5, 3
ITEMS_PER_BLOCK, ITEMS_PER_INDEX, LEAST_STRIDE = 2, 1 << 16, 64
#: Bounds of passages and blocks that are held at a time.
BOUNDS = 1 << 21
#: What parts words here: all ASCII but letters and digits.
NO_WORD = SPACE.copy()
NO_WORD[[c for c in range(128) if not chr(c).isalnum()]] = True


def words_of(column: pa.Array) -> Words:
    """Words in lower case, of all alphabets."""
    return Words(pc.utf8_lower(column.cast(pa.large_string())), space=NO_WORD)


def hashes_of(texts: list[str | None]) -> list[np.ndarray]:
    words = words_of(pa.array(texts, pa.large_string()))
    return [words.hashes[words.bounds[r] : words.bounds[r + 1]] for r in range(len(texts))]


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes of the n-grams of a word sequence; a shorter sequence is one."""
    n = min(n, len(words))
    if not n:
        return np.zeros(0, np.uint64)
    return np.unique(mix(sum(words[j : len(words) - n + 1 + j] * _PLACE[j] for j in range(n))))


def question_and_answer(text: str) -> tuple[str, str]:
    """All sentences but the last, and the last; of a single sentence, three quarters of its words and the rest."""
    parts = [m for m in re.split(r"(?<=[.!?])\s+|\n+", text.strip()) if m.strip()]
    if len(parts) > 1:
        return " ".join(parts[:-1]), parts[-1]
    words = text.split()
    cut = max(1, (3 * len(words)) // 4)
    return " ".join(words[:cut]), " ".join(words[cut:])


@dataclass
class Totals:
    """Of all items with words: in how many of them each word is, their number, that of their words, and the words of the longest."""

    terms: np.ndarray
    df: np.ndarray
    items: int
    words: int
    longest: int

    @classmethod
    def of(cls, parts: Iterable[list[tuple]]) -> Totals:
        out = cls(np.zeros(0, np.uint64), np.zeros(0, np.int64), 0, 0, 0)
        for rows in parts:
            words = [w for w in hashes_of([t for _, t in rows]) if len(w)]
            terms, df = np.unique(np.concatenate([np.unique(w) for w in words]) if words else np.zeros(0, np.uint64), return_counts=True)
            merged = np.union1d(out.terms, terms)
            total = np.zeros(len(merged), np.int64)
            total[np.searchsorted(merged, out.terms)] += out.df
            total[np.searchsorted(merged, terms)] += df
            out = cls(merged, total, out.items + len(words), out.words + sum(map(len, words)), max([out.longest, *map(len, words)]))
        return out


@dataclass
class Index:
    """Postings of one part of the items, in blocks of ITEMS_PER_BLOCK with the greatest impact of each block.

    Impacts are BM25 weights divided by the item's score against itself. Items are ordered by their commonest words, so that
    those of one language share blocks.
    """

    terms: np.ndarray
    ids: list
    questions: list[np.ndarray]
    answers: list[np.ndarray]
    block_at: np.ndarray
    block: np.ndarray
    block_max: np.ndarray
    post_at: np.ndarray
    post_item: np.ndarray
    post_impact: np.ndarray
    stride: int

    def __post_init__(self):
        n = np.arange(len(self.terms))
        self.n_blocks = len(self.ids) // ITEMS_PER_BLOCK + 1
        self.block_key = np.repeat(n, np.diff(self.block_at)) * self.n_blocks + self.block
        self.post_key = np.repeat(n, np.diff(self.post_at)) * (len(self.ids) + 1) + self.post_item
        self.most = np.maximum.reduceat(self.block_max, self.block_at[:-1]) if len(n) else np.zeros(0)

    @classmethod
    def build(cls, rows: list[tuple], totals: Totals | None = None) -> Index:
        """Of rows (id, text); totals are those of all items if rows are only a part of them."""
        totals = totals or Totals.of([rows])
        words = hashes_of([t for _, t in rows])
        use = [i for i, w in enumerate(words) if len(w)]
        rows, words = [rows[i] for i in use], [words[i] for i in use]
        terms = np.unique(np.concatenate(words)) if words else np.zeros(0, np.uint64)
        df = totals.df[np.searchsorted(totals.terms, terms)]
        idf = np.log(1 + (totals.items - df + 0.5) / (df + 0.5))
        common = [sorted(np.searchsorted(terms, np.unique(w)).tolist(), key=lambda t: (-df[t], t))[:3] for w in words]
        order = sorted(range(len(rows)), key=lambda i: (common[i], str(rows[i][0])))
        rows, words = [rows[i] for i in order], [words[i] for i in order]
        mean = totals.words / max(1, totals.items)
        term, item, impact = [], [], []
        for i, w in enumerate(words):
            t, tf = np.unique(np.searchsorted(terms, w), return_counts=True)
            weight = idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(w) / mean))
            term.append(t), item.append(np.full(len(t), i)), impact.append(weight / weight.sum())
        term, item, impact = (np.concatenate(x) if x else np.zeros(0, int) for x in (term, item, impact))
        order = np.lexsort((item, term))
        term, item, impact = term[order], item[order], impact[order].astype(float)
        pair = term.astype(np.int64) * (len(rows) // ITEMS_PER_BLOCK + 1) + item // ITEMS_PER_BLOCK
        heads = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.zeros(0, int)
        parts = [question_and_answer(t) for _, t in rows]
        return cls(
            terms, [i for i, _ in rows], [grams(w, GRAM) for w in hashes_of([q for q, _ in parts])], [grams(w, GRAM) for w in hashes_of([a for _, a in parts])],
            np.searchsorted(term[heads], np.arange(len(terms) + 1)), item[heads] // ITEMS_PER_BLOCK, np.maximum.reduceat(impact, heads) if len(heads) else impact,
            np.searchsorted(term, np.arange(len(terms) + 1)), item, impact, max(LEAST_STRIDE, totals.longest),
        )

    def matches(self, words: Words) -> dict[int, dict[int, tuple[float, float, float]]]:
        """By row, by item: the best (score, question overlap, answer overlap) of its passages.

        Passages are windows of two strides each stride, so a span of words as long as the longest item lies whole in one. Each is
        a query of its distinct words. Passages are taken BOUNDS / blocks at a time, however long a text is.
        """
        out: dict[int, dict[int, tuple[float, float, float]]] = {}
        if not len(self.terms) or not len(words.hashes):
            return out
        sizes = np.diff(words.bounds)
        windows = np.maximum(1, -(-sizes // self.stride))
        first = np.cumsum(windows) - windows
        place = np.arange(len(words.hashes)) - words.bounds[words.row]
        at = np.minimum(np.searchsorted(self.terms, words.hashes), len(self.terms) - 1)
        known = np.flatnonzero(self.terms[at] == words.hashes)
        term, slot = at[known], first[words.row[known]] + place[known] // self.stride
        later = place[known] >= self.stride
        pair = np.unique(np.concatenate([slot, slot[later] - 1]) * len(self.terms) + np.concatenate([term, term[later]]))
        window, term = pair // len(self.terms), pair % len(self.terms)
        row_of = np.repeat(np.arange(len(sizes)), windows)
        per = max(1, BOUNDS // self.n_blocks)
        cuts = np.searchsorted(window, np.arange(0, int(windows.sum()) + per, per))
        for a, b in zip(cuts, cuts[1:], strict=False):
            for w, i, s in self.retrieve(window[a:b], term[a:b]):
                row = int(row_of[w])
                start = words.bounds[row] + (w - first[row]) * self.stride
                passage = words.hashes[start : min(start + 2 * self.stride, words.bounds[row + 1])]
                held = grams(passage, GRAM)
                q, a_ = (self.overlap(part, held, passage) for part in (self.questions[i], self.answers[i]))
                if q >= QUESTION and a_ >= ANSWER:
                    best = out.setdefault(row, {})
                    best[i] = max(best.get(i, (0.0, 0.0, 0.0)), (s, q, a_))
        return out

    def retrieve(self, window: np.ndarray, term: np.ndarray) -> list[tuple[int, int, float]]:
        """(window, item, score) of all items that score THRESHOLD or more; (window, term) are distinct and sorted.

        Passages none of whose blocks can reach the threshold, by the sums of their words' block maxima, are left at once; the
        others move their cursors.
        """
        if not len(window):
            return []
        n = self.block_at[term + 1] - self.block_at[term]
        where = np.repeat(self.block_at[term] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        base = int(window[0])
        bound = np.bincount((np.repeat(window, n) - base) * self.n_blocks + self.block[where], self.block_max[where], (int(window[-1]) - base + 1) * self.n_blocks)
        use = (bound.reshape(-1, self.n_blocks).max(axis=1) >= THRESHOLD - 1e-9)[window - base]
        return self.wand(window[use], term[use])

    def wand(self, window: np.ndarray, term: np.ndarray) -> list[tuple[int, int, float]]:
        """Block-max WAND for many passages side by side: one cursor for each passage and word, in item order.

        In a round every passage finds its pivot, the first item at which the maxima of the words whose cursors stand there or
        before reach the threshold. If the maxima of the pivot's block do not, the cursors skip to the end of the block or the next
        cursor; if they do, those before the pivot skip to it, and once all stand there the item is scored. A passage without a
        pivot is done.
        """
        out, end = [], len(self.ids)
        cursor = self.post_at[term]
        item = self.post_item[cursor]
        while len(window):
            order = np.lexsort((item, window))
            window, term, cursor, item = window[order], term[order], cursor[order], item[order]
            new = np.concatenate([[True], window[1:] != window[:-1]])
            heads, of = np.flatnonzero(new), np.cumsum(new) - 1
            most = self.most[term]
            reach = np.cumsum(most)
            reach -= (reach[heads] - most[heads])[of]
            enough = np.flatnonzero(reach >= THRESHOLD - 1e-9)
            live, at = np.unique(of[enough], return_index=True)
            pivot = np.full(len(heads), -1)
            pivot[live] = item[enough[at]]
            own = pivot[of]
            member = np.flatnonzero(item <= own)
            block = pivot // ITEMS_PER_BLOCK
            key = term[member] * self.n_blocks + block[of[member]]
            place = np.minimum(np.searchsorted(self.block_key, key), len(self.block_key) - 1)
            bound = np.bincount(of[member], np.where(self.block_key[place] == key, self.block_max[place], 0), len(heads))
            good, there = bound >= THRESHOLD - 1e-9, item[heads] == pivot
            scored = member[(good & there)[of[member]]]
            score = np.bincount(of[scored], self.post_impact[cursor[scored]], len(heads))
            out += [(int(window[heads[w]]), int(pivot[w]), float(score[w])) for w in np.flatnonzero(score >= THRESHOLD)]
            after = heads + np.bincount(of[member], minlength=len(heads))
            last = np.append(heads[1:], len(item))
            following = np.where(after < last, item[np.minimum(after, len(item) - 1)], end)
            target = np.where(good, np.where(there, pivot + 1, pivot), np.minimum((block + 1) * ITEMS_PER_BLOCK, following))
            move = member[item[member] < target[of[member]]]
            cursor[move] = np.searchsorted(self.post_key, term[move] * (end + 1) + target[of[move]])
            inside = cursor[move] < self.post_at[term[move] + 1]
            item[move] = np.where(inside, self.post_item[np.minimum(cursor[move], len(self.post_item) - 1)], end)
            keep = (item < end) & (own >= 0)
            window, term, cursor, item = window[keep], term[keep], cursor[keep], item[keep]
        return out

    @staticmethod
    def overlap(part: np.ndarray, held: np.ndarray, passage: np.ndarray) -> float:
        """Share of a part's n-grams that a passage holds; parts of fewer words than GRAM are one shorter n-gram."""
        if not len(part):
            return 1.0
        if len(part) == 1:
            return float(any(np.isin(part, grams(passage, n)).all() for n in range(1, GRAM + 1)))
        return float(np.isin(part, held).mean())


HIT = "array<struct<item_id:long,score:double,question_overlap:double,answer_overlap:double>>"


def find_leaks(docs: DataFrame, items: DataFrame, keep: list[str], text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The columns keep of every row, its text and hits: the items that it holds, with score and overlaps.

    Every passage of every text is a query to the index of the items; all items whose score reaches THRESHOLD of their own are
    retrieved, and count if the passage holds enough of their question and of their answer. The index of at most
    ITEMS_PER_INDEX items goes to all tasks; more items are indexed in parts by a hash of the id, one pass each, with the word
    statistics of all items. Narrow. Items without words and null or empty texts have no hits; no items give no hits, an empty
    table no rows; repeated rows are searched each; ids of items may repeat or be null. A kept column hits is replaced.
    """
    rows = items.select(F.col(item_id).cast("long").alias("i"), F.coalesce(F.col(item_text), F.lit("")).alias("t"))
    parts = blocks(rows.count(), ITEMS_PER_INDEX)
    types = dict(docs.dtypes)
    keep, read = [c for c in keep if c not in ("hits", text)], free_name(docs, "read_text")
    schema = ", ".join([f"`{c}` {types[c]}" for c in keep] + [f"`{read}` string", f"hits {HIT}"])
    out = docs.select(*keep, F.col(text).alias(read), F.array().cast(HIT).alias("hits"))
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())]))

    def items_of(part: int) -> list[tuple]:
        own = rows.filter(F.pmod(F.xxhash64("i"), F.lit(parts)) == part).collect()
        return sorted(((r.i, r.t) for r in own), key=lambda x: (x[0] is None, x[0] or 0, x[1]))

    totals = Totals.of(map(items_of, range(parts))) if parts > 1 else None
    for part in range(parts):
        shared = docs.sparkSession.sparkContext.broadcast(Index.build(items_of(part), totals))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in chunked(batches, read, 1 << 20):
                found = index.matches(words_of(batch.column(len(keep))))
                hits = batch.column(len(keep) + 1).to_pylist()
                for row, best in found.items():
                    hits[row] = hits[row] + [dict(zip(("item_id", "score", "question_overlap", "answer_overlap"), (index.ids[i], *best[i]), strict=True)) for i in sorted(best)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(hits, kind)], names=[*keep, read, "hits"])

        out = out.mapInArrow(run, schema)
    return out.withColumnRenamed(read, text)


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, item_id, score, question_overlap, answer_overlap: a row for each item found in a row of docs."""
    return find_leaks(docs, items, [id_col]).select(id_col, F.inline("hits"))
