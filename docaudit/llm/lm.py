"""Katz backoff language model: counting, exactly normalised backoff and scoring over partitioned n-gram tables.

Texts are read in chunks. A chunk asks the tables for what it needs: each distinct word of it goes once, with its training count, to
the word's partition, and then, order by order, each distinct n-gram to its context's. There all chunks' counts are summed, and the
sums go back. So no table is ever whole in one place, and a word or n-gram that is everywhere costs one entry a chunk. A context
that no other chunk has, not even in a held-out text, need not be asked for: its own chunk has all that follows it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docaudit.llm.storage import blocks, discard, materialize, shuffle_partitions
from docaudit.llm.textops import CHUNK_BYTES, Words, chunked, mix, release

#: Good-Turing counts up to K are discounted. Bytes of text to a partition of the tables.
K, BYTES_PER_PARTITION = 5, 1 << 24
END = np.uint64(0x5851F42D4C957F2D)


def discounts(n: np.ndarray) -> np.ndarray:
    """d[r] for r = 0..K from n[r], the number of types seen r times, r = 1..K + 1; 1 where Good-Turing gives no proper one."""
    d = np.ones(K + 1)
    if n[1] > 0:
        common = (K + 1) * n[K + 1] / n[1]
        for r in range(1, K + 1):
            if n[r] > 0 and common < 1:
                found = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common)
                d[r] = found if 0 < found < 1 else 1
    return d


def discounted(d: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Counts after their discounts."""
    return np.where(c <= K, d[np.minimum(c, K)], 1) * c


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed byte planes, with their lengths and types."""
    out = []
    for a in arrays:
        body = zstandard.compress(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes(), 1) if len(a) else b""
        out.append(f"{a.dtype.str},{len(a)},{len(body)};".encode() + body)
    return b"".join(out)


def unsqueeze(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        stop = data.index(b";", at)
        kind, n, size = data[at:stop].decode().split(",")
        at, n, dtype = stop + 1, int(n), np.dtype(kind)
        body = zstandard.decompress(data[at : at + int(size)]) if n else b""
        out.append(np.ascontiguousarray(np.frombuffer(body, np.uint8).reshape(dtype.itemsize, n).T).view(dtype).ravel() if n else np.zeros(0, dtype))
        at += int(size)
    return out


def narrow(a: np.ndarray) -> np.ndarray:
    """Whole numbers from 0 in as few bytes as their greatest needs."""
    top = int(a.max(initial=0))
    return a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def heads_of(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin in sorted arrays."""
    n = len(keys[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def sums(values: np.ndarray, index: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(index, values, n)


ROWS = "kind string, p int, chunk long, data binary"


def table_of(rows: list[tuple]) -> pa.Table:
    kinds, parts, chunk, data = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.table({"kind": pa.array(kinds, pa.string()), "p": pa.array(parts, pa.int32()), "chunk": pa.array(chunk, pa.int64()), "data": pa.array(data, pa.binary())})


#: All that a chunk knows, in one row: its state and the tables' answers so far.
KNOWN = "chunk long, data binary"


def closed(tables: list[pa.Table]) -> pa.Table:
    """Rows (ROWS) of one chunk as one row (KNOWN)."""
    used = [t.select(["kind", "p", "chunk", "data"]) for t in tables if t.num_rows]  # a chunk without answers has a table without columns
    whole, sink = pa.concat_tables(used), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, whole.schema) as writer:
        writer.write_table(whole)
    return pa.table({"chunk": pa.array([whole["chunk"][0].as_py()], pa.int64()), "data": pa.array([sink.getvalue().to_pybytes()], pa.binary())})


def opened(data: pa.Scalar) -> pa.Table:
    """The rows of closed()."""
    return pa.ipc.open_stream(data.as_buffer()).read_all()


def read_chunks(rows: DataFrame, n_parts: int, limit: int) -> DataFrame:
    """Of rows (id, text, held) a state for each chunk (ids, sizes and tokens as places among its distinct words) and its request to
    each partition of the word table: its words in that range of hashes, with their training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for i, batch in enumerate(chunked(batches, limit=limit)):
            words, chunk = Words(batch.column(1)), (task << 32) | i
            held = np.array(batch.column(2).to_pylist(), bool)
            n_tokens = np.diff(words.bounds) + 1
            unique, place = np.unique(np.insert(words.hashes, words.bounds[1:], END), return_inverse=True)
            own = np.bincount(place[np.repeat(~held, n_tokens)], minlength=len(unique))
            sink = pa.BufferOutputStream()
            meta = pa.RecordBatch.from_arrays([batch.column(0)], names=["id"])
            with pa.ipc.new_stream(sink, meta.schema) as writer:
                writer.write_batch(meta)
            state = squeeze(np.frombuffer(sink.getvalue(), np.uint8), narrow(n_tokens), held.astype(np.uint8), narrow(place), np.searchsorted(unique, [END]))
            cuts = np.searchsorted(((unique >> np.uint64(32)) * np.uint64(n_parts) >> np.uint64(32)).astype(np.int64), np.arange(n_parts + 1))
            asked = [("words", q, chunk, squeeze(unique[cuts[q] : cuts[q + 1]], narrow(own[cuts[q] : cuts[q + 1]]))) for q in np.flatnonzero(np.diff(cuts)).tolist()]
            yield from table_of([("state", -1, chunk, state), *asked]).to_batches()

    return rows.select("id", "text", "held").mapInArrow(run, ROWS)


def word_table(group: pa.Table) -> pa.Table:
    """Answers the chunks that ask one partition of the word table: a number for each word, small for frequent ones, its count, and
    whether it was learned and is in other chunks too."""
    p, both = group["p"][0].as_py(), [unsqueeze(x) for x in group["data"].to_pylist()]
    sizes = np.array([len(x[0]) for x in both])
    keys, counts = np.concatenate([x[0] for x in both]), np.concatenate([x[1].astype(np.int64) for x in both])
    unique, back = np.unique(keys, return_inverse=True)
    total = np.bincount(back, counts, len(unique)).astype(np.int64)
    number = np.empty(len(unique), np.int64)
    number[np.argsort(-total, kind="stable")] = np.arange(len(unique))
    ends, shared = np.cumsum(sizes), (total > 0) & (np.bincount(back, minlength=len(unique)) > 1)
    out = [("answer", p, c, squeeze(narrow(number[back[e - n : e]]), narrow(total[back[e - n : e]]), shared[back[e - n : e]].astype(np.uint8))) for c, e, n in zip(group["chunk"].to_pylist(), ends, sizes, strict=True)]
    tally = [int((total == r).sum()) for r in range(1, K + 2)]
    return table_of([*out, ("tally", p, -1, np.array([(total > 0).sum(), total.sum(), total[total > K].sum(), *tally], np.int64).tobytes())])


@dataclass
class Unigrams:
    """Word probabilities: discounted counts; what is left, and one reserved occurrence, are the unknown word's, so they sum to one."""

    words: int
    total: int
    d: np.ndarray
    unknown: float
    n_parts: int

    def p(self, count: np.ndarray) -> np.ndarray:
        """Probabilities of words of these counts."""
        return np.where(count == 0, self.unknown, discounted(self.d, count) / (self.total + 1))

    @property
    def hot(self) -> int:
        """Contexts with more occurrences are dealt out by the next word too."""
        return max(1, self.total // (4 * self.n_parts))


def statistics(c: np.ndarray, lower: np.ndarray, context: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A row for each context: how many n-grams were seen 1..K times, occurrences of the others, the lower order's probability of all
    that were seen, and the context's count. n-grams are given by count, lower probability and context."""
    seen = [np.bincount(context[c == r], minlength=len(count)) for r in range(1, K + 1)]
    return np.stack([*seen, sums(np.where(c > K, c, 0), context, len(count)), sums(np.where(c > 0, lower, 0), context, len(count)), count], axis=1).astype(float)


def backoff(stats: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Logarithms of the backoff weights: the mass that contexts leave, over the lower order's of the words not seen after them."""
    mass = stats[:, :K] @ (d[1:] * np.arange(1, K + 1)) + stats[:, K]
    return np.log10((1 - mass / (stats[:, K + 2] + 1)) / np.maximum(1 - stats[:, K + 1], 1e-300))


@dataclass
class Level:
    """Distinct n-grams of a chunk, as places among its distinct contexts (the n-grams of the order below) and words.

    `at` has the n-gram that ends in each token, -1 where the text has no context of that length yet. `low` is the n-gram without its
    first word, `own` its training count in the chunk and `context_count` its context's in all. `asked` are those whose contexts
    are shared, in their order in the tables; `cuts` bounds those of each partition. Of the others the own count
    is the whole one. The tables' answers give `c`, and a `number` where the n-gram is `shared`: learned, and in other chunks too.
    """

    at: np.ndarray
    context: np.ndarray
    word: np.ndarray
    low: np.ndarray
    own: np.ndarray
    context_count: np.ndarray
    asked: np.ndarray
    cuts: np.ndarray
    c: np.ndarray
    shared: np.ndarray
    number: np.ndarray

    def parts(self) -> Iterator[tuple[int, np.ndarray]]:
        """Partitions that n-grams are asked of, and which."""
        for q in np.flatnonzero(np.diff(self.cuts)).tolist():
            yield q, self.asked[self.cuts[q] : self.cuts[q + 1]]


class Chunk:
    """A chunk's tokens and distinct n-grams of orders 1 to `order`, from its state and the tables' answers; the same each time.

    n-grams are dealt to partitions by their contexts, those of hot contexts by the last word too, and lie in them by context and word.
    The answers of orders below `order` must be there.
    """

    def __init__(self, rows: list[pa.Table], unigrams: Unigrams, order: int):
        self.found, self.unigrams = {}, unigrams
        for t in (x for x in rows if x.num_rows):  # a chunk without answers has a table without columns
            self.found |= {(kind, p): x for kind, p, x in zip(t["kind"].to_pylist(), t["p"].to_pylist(), t["data"].to_pylist(), strict=True)}
        meta, n_tokens, held, place, end = unsqueeze(self.found["state", -1])
        self.ids = pa.ipc.open_stream(pa.py_buffer(meta.tobytes())).read_all()["id"]
        answers = [(p, *unsqueeze(x)) for p, x in sorted((p, x) for (kind, p), x in self.found.items() if kind == "answer")]
        number = np.concatenate([x.astype(np.int64) * unigrams.n_parts + p for p, x, _, _ in answers])
        count = np.concatenate([x.astype(np.int64) for _, _, x, _ in answers])
        shared = np.concatenate([x.astype(bool) for _, _, _, x in answers])
        self.n_tokens, self.held, self.end = n_tokens.astype(np.int64), held.astype(bool), int(end[0])
        self.row = np.repeat(np.arange(len(held)), self.n_tokens)
        self.place = place.astype(np.int64)  # of tokens among the words
        self.offset = np.arange(len(self.row)) - np.repeat(np.cumsum(self.n_tokens) - self.n_tokens, self.n_tokens)
        self.learned = ~self.held[self.row]
        own, no = np.bincount(self.place[self.learned], minlength=len(count)), np.zeros(0, np.int64)
        self.levels = [Level(self.place, no, np.arange(len(count)), no, own, np.full(len(count), unigrams.total), no, no, count, shared, number)]
        while len(self.levels) < order:
            self.levels.append(self.above(self.levels[-1], len(self.levels) + 1))

    def above(self, below: Level, n: int) -> Level:
        """The n-grams of order n, given those of the order below with their answers."""
        parts, tokens = self.unigrams.n_parts, np.flatnonzero(self.offset >= n - 2)
        before = np.concatenate([[self.end], below.at[:-1]])
        if n == 2:
            before[self.offset == 0] = self.end
        words = len(self.levels[0].c)
        unique, gram = np.unique(before[tokens] * words + self.place[tokens], return_inverse=True)
        at = np.full(len(self.place), -1)
        at[tokens] = gram
        context, word = unique // words, unique % words
        low = np.empty(len(unique), np.int64)
        low[gram] = below.at[tokens]
        own = np.bincount(gram[self.learned[tokens]], minlength=len(unique))
        count = below.c[context]
        asked = np.flatnonzero(below.shared[context])
        h, w, hot = below.number[context[asked]], self.levels[0].number[word[asked]], count[asked] > self.unigrams.hot
        part = np.where(hot, mix(h.astype(np.uint64) ^ mix(w.astype(np.uint64) + np.uint64(1))) % np.uint64(parts), h.astype(np.uint64) % np.uint64(parts)).astype(np.int64)
        order = np.lexsort((w, h, part))
        level = Level(at, context, word, low, own, count, asked[order], np.searchsorted(part[order], np.arange(parts + 1)), own.copy(), np.zeros(len(unique), bool), np.zeros(len(unique), np.int64))
        for q, which in level.parts():
            if (f"counts{n}", q) in self.found:
                c, *more = unsqueeze(self.found[f"counts{n}", q])
                level.c[which] = c
                if more:  # numbers ascend within a partition
                    bits, steps = more
                    which = which[np.unpackbits(bits, count=len(which)).astype(bool)]
                    level.shared[which], level.number[which] = True, np.cumsum(steps.astype(np.int64)) * parts + q
        return level

    def lower(self, n: int, d: np.ndarray) -> np.ndarray:
        """What the order below gives for the n-grams of order n; right for those that were seen."""
        below = self.levels[n - 2]
        low = self.levels[n - 1].low
        return discounted(d, below.c[low]) / (below.context_count[low] + 1)

    def logs(self, d: list[np.ndarray]) -> np.ndarray:
        """The logarithm of each token's probability, order by order from below."""
        log = np.log10(self.unigrams.p(self.levels[0].c))
        out = log[self.place]
        for n, level in enumerate(self.levels[1:], start=2):
            alpha = np.zeros(len(level.c))
            alone = np.ones(len(level.c), bool)
            alone[level.asked] = False
            alone = np.flatnonzero(alone)
            used, first, place = np.unique(level.context[alone], return_index=True, return_inverse=True)
            if len(used):
                alpha[alone] = backoff(statistics(level.c[alone], self.lower(n, d[n - 2])[alone], place, level.context_count[alone][first]), d[n - 1])[place]
            for q, which in level.parts():
                if (f"weights{n}", q) in self.found:
                    place, weight = unsqueeze(self.found[f"weights{n}", q])
                    heads = heads_of(level.context[which])
                    of_head = np.zeros(len(heads))
                    of_head[place] = weight
                    alpha[which] = np.repeat(of_head, np.diff(np.append(heads, len(which))))
            seen = np.log10(np.maximum(discounted(d[n - 1], level.c), 1e-300) / (level.context_count + 1))
            log = np.where(level.c > 0, seen, alpha + log[level.low])
            tokens = np.flatnonzero(level.at >= 0)
            out[tokens] = log[level.at[tokens]]
        return out


def ask(chunk: Chunk, key: int, n: int) -> pa.Table:
    """What a chunk asks of the partitions for its n-grams of order n, and how often those of its own contexts occur.

    For each partition: contexts (what a partition holds of their numbers, the rest of them, counts, counts of what they back off to, words that
    follow), words, counts of the n-grams without their first word (for pairs, one a word), and for each n-gram its word and own count.
    """
    level, below, words = chunk.levels[n - 1], chunk.levels[n - 2], chunk.levels[0]
    parts, out = chunk.unigrams.n_parts, []
    for q, at in level.parts():
        h = below.number[level.context[at]]
        heads = heads_of(h)
        word, place = np.unique(words.number[level.word[at]], return_inverse=True)
        low = below.c[level.low[at]]
        if n == 2:
            low, every = np.zeros(len(word), np.int64), low
            low[place] = every
        contexts = (narrow(np.diff(h[heads] // parts, prepend=0)), narrow(h[heads] % parts), narrow(level.context_count[at][heads]), narrow(below.context_count[level.low[at]][heads]), narrow(np.diff(np.append(heads, len(at)))))
        out.append(("asked", q, key, squeeze(*contexts, narrow(np.diff(word, prepend=0)), narrow(low), narrow(place), narrow(level.own[at]))))
    alone = np.ones(len(level.c), bool)
    alone[level.asked] = False
    tally = [int((level.own[alone] == r).sum()) for r in range(1, K + 2)]
    return table_of([*out, ("alone", key % parts, key, np.array(tally, np.int64).tobytes())])


def gram_table(group: pa.Table, n: int, unigrams: Unigrams, d: np.ndarray, last: bool) -> pa.Table:
    """Answers the chunks that ask one partition of the table of order n: counts and, below the last order, which n-grams were learned and
    are in other chunks too, with their numbers. Statistics are given out for contexts that a chunk looks for an unseen word in; d are the discounts below."""
    q, parts, fields, chunks, out = group["p"][0].as_py(), unigrams.n_parts, [], [], []
    tally = np.zeros(K + 1, np.int64)
    for kind, key, data in zip(group["kind"].to_pylist(), group["chunk"].to_pylist(), group["data"].to_pylist(), strict=True):
        if kind == "alone":
            tally += np.frombuffer(data, np.int64)
            continue
        step, rest, ch, cl, follow, word, low, place, own = unsqueeze(data)
        of = np.repeat(np.arange(len(step)), follow)
        h = np.cumsum(step.astype(np.int64)) * parts + rest
        chunks.append(key)
        fields.append((h[of], ch.astype(np.int64)[of], of, np.cumsum(word.astype(np.int64))[place], low.astype(np.int64)[place] if n == 2 else low.astype(np.int64), cl.astype(np.int64)[of], own.astype(np.int64)))
    if fields:
        sizes = [len(x[0]) for x in fields]
        h, ch, of, w, low, cl, own = (np.concatenate(x) for x in zip(*fields, strict=True))
        del fields
        order = np.lexsort((w, h))
        h, w = h[order], w[order]
        starts = heads_of(h, w)
        c = np.add.reduceat(own[order], starts)
        per = np.empty(len(h), np.int64)
        per[order] = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(h))))
        some, shared = order[starts], (c > 0) & (np.diff(np.append(starts, len(h))) > 1)
        h, ch, lower = h[starts], ch[some], discounted(d, low[some]) / (cl[some] + 1)
        del w, low, cl, order
        heads = heads_of(h)
        context = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(h))))
        stats = statistics(c, lower, context, ch[heads])
        tally += np.array([(c == r).sum() for r in range(1, K + 2)])
        hot = np.flatnonzero(ch[heads] > unigrams.hot)
        if len(hot):
            out.append(("hot", q, -1, squeeze(h[heads][hot], *stats[hot].T)))
        opened, end = [], 0
        for i, (key, size) in enumerate(zip(chunks, sizes, strict=True)):
            begin, end = end, end + size
            found = c[per[begin:end]]
            common = shared[per[begin:end]]
            numbers = () if last else (np.packbits(common), narrow(np.diff(per[begin:end][common], prepend=0)))
            out.append((f"counts{n}", q, key, squeeze(narrow(found), *numbers)))
            none = np.flatnonzero(found == 0)
            place, first = np.unique(of[begin:end][none], return_index=True)
            opened.append((np.full(len(place), i), place, context[per[begin:end][none[first]]]))
        at, place, context = (np.concatenate(x) for x in zip(*opened, strict=True))
        used, context = np.unique(context, return_inverse=True)
        out.append(("open", q, -1, squeeze(h[heads][used], *stats[used].T, narrow(at), narrow(place), narrow(context), np.array(chunks, np.int64))))
    release()
    return table_of([*out, ("tally", q, -1, tally.tobytes())])


def hot_statistics(counted: DataFrame) -> dict[int, np.ndarray]:
    """Statistics of the hot contexts of an order, which are dealt over partitions: fewer than four a partition."""

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("data").to_pylist():
                h, *stats = unsqueeze(data)
                yield pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64)), pa.array(list(np.stack(stats, axis=1)), pa.list_(pa.float64()))], names=["h", "stats"])

    parts = counted.filter("kind = 'hot'").mapInArrow(unpacked, "h long, stats array<double>")
    summed = parts.groupBy("h").agg(*(F.sum(F.col("stats")[i]) for i in range(K + 2)), F.max(F.col("stats")[K + 2]))
    return {r.h: np.array(r[1:]) for r in summed.collect()}


def weights(counted: DataFrame, n: int, d: np.ndarray) -> DataFrame:
    """Backoff weights of order n for the chunks that look for unseen words."""
    hot = hot_statistics(counted)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q, data in zip(batch.column("p").to_pylist(), batch.column("data").to_pylist(), strict=True):
                h, *stats, at, place, context, chunks = unsqueeze(data)
                stats = np.stack(stats, axis=1)
                for i, word in enumerate(h.tolist()):
                    if word in hot:
                        stats[i] = hot[word]
                alpha = backoff(stats, d)
                cuts = np.searchsorted(at, np.arange(len(chunks) + 1))
                out = [(f"weights{n}", q, int(chunks[i]), squeeze(place[a:b], alpha[context[a:b]])) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
                yield from table_of(out).to_batches()

    return counted.filter("kind = 'open'").mapInArrow(weigh, ROWS)


def katz_scores(docs: DataFrame, held_out, id_col: str = "doc_id", text: str = "text", chunk_bytes: int = CHUNK_BYTES, order: int = 2) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row, learned from rows without held_out.

    Tokens are words and one closing token; a token's context is the order - 1 tokens before it, fewer at a text's beginning, whose
    first token follows one closing token. An n-gram seen r times has d(r) r / (c(h) + 1) with Good-Turing d of its order; every other word
    gets the context's remaining mass in proportion to its probability by the order below, with the weight (1 - seen mass) / (1 - lower
    mass of the words seen after h), so that each context sums to one; unigrams back off to one unknown word in the same way.
    A context that was never seen leaves all to the order below.

    A round of requests for each order, each a shuffle of distinct entries of chunks by partition and of answers by chunk, which a chunk
    takes up into its one row; all is written once, and what a round was made from is deleted once it is. Tables and
    tallies of any size take the same path. Sums of contexts that are dealt over partitions are added up, and go to all tasks: fewer
    than four a partition and order. Words are told apart by a hash of 64 bits. Null texts are empty (one closing token), rows
    that repeat are learned from and scored each; an empty table gives no rows; without rows to learn from all words are
    unknown; other columns are ignored. An order below 1 is an error.
    """
    if order < 1:
        raise ValueError("order must be 1 or more")
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held"))
    id_type = dict(rows.dtypes)["id"]
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n_parts = max(shuffle_partitions(spark), blocks(size, BYTES_PER_PARTITION))
    chunks = materialize(read_chunks(rows, n_parts, chunk_bytes), "chunks", blobs=True)
    words = materialize(chunks.filter("kind = 'words'").groupBy("p").applyInArrow(word_table, ROWS), "words", blobs=True)
    tally = sum((np.frombuffer(r.data, np.int64).astype(object) for r in words.filter("kind = 'tally'").select("data").collect()), np.zeros(K + 4, object))
    d = [discounts(np.array([0, *tally[3:]], float))]
    total = int(tally[1])
    left = 1 - (float(tally[2]) + float(np.array(tally[3 : 3 + K], float) @ (d[0][1:] * np.arange(1, K + 1)))) / (total + 1)
    unigrams = Unigrams(int(tally[0]), total, d[0], left, n_parts)
    both = chunks.filter("kind = 'state'").unionByName(words.filter("kind = 'answer'"))
    known = materialize(both.groupBy("chunk").applyInArrow(lambda own: closed([own]), KNOWN), "known-1", blobs=True)
    discard(chunks)
    discard(words)

    def round_of(n: int, below: np.ndarray) -> DataFrame:
        def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for key, data in zip(batch.column("chunk").to_pylist(), batch.column("data"), strict=True):
                    yield from ask(Chunk([opened(data)], unigrams, n), key, n).to_batches()

        answering = lambda group: gram_table(group, n, unigrams, below, n == order)
        return materialize(known.mapInArrow(asking, ROWS).groupBy("p").applyInArrow(answering, ROWS), f"order-{n}", blobs=True)

    def gather(own: pa.Table, found: pa.Table | None = None) -> pa.Table:
        chunk = Chunk([opened(own["data"][0]), *([] if found is None else [found])], unigrams, order)
        n, count = len(chunk.held), chunk.levels[0].c[chunk.place]
        base = sums(np.log10((count + 1) / (unigrams.total + unigrams.words + 1)), chunk.row, n)
        return pa.table(
            [chunk.ids, pa.array(chunk.held), pa.array(chunk.n_tokens), pa.array(sums(count > 0, chunk.row, n).astype(np.int64)), pa.array(np.full(n, unigrams.total)), pa.array(base), pa.array(sums(chunk.logs(d), chunk.row, n))],
            names=[id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    schema = f"{id_col} {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    for n in range(2, order + 1):
        counted = round_of(n, d[-1])
        d.append(discounts(np.array([0, *sum((np.frombuffer(r.data, np.int64) for r in counted.filter("kind = 'tally'").select("data").collect()), np.zeros(K + 1, np.int64))], float)))
        answers = counted.filter(F.col("kind") == f"counts{n}").unionByName(weights(counted, n, d[-1]))
        met = known.groupBy("chunk").cogroup(answers.groupBy("chunk"))
        if n == order:
            return met.applyInArrow(gather, schema)
        # a chunk takes an order's answers up into its state, and what they were made from goes
        after = materialize(met.applyInArrow(lambda own, found: closed([opened(own["data"][0]), found]), KNOWN), f"known-{n}", blobs=True)
        discard(known)
        discard(counted)
        known = after
    return known.groupBy("chunk").applyInArrow(lambda own: gather(own), schema)  # of one argument, else the first were the key
