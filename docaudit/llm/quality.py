"""Quality rules: lines labelled as content or boilerplate by a linear-chain conditional random field, whose share decides."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docaudit.llm.textops import _PLACE, Words, chunked, eights, hashes_of_eights, mix

SYMBOLS = np.zeros(256, bool)
SYMBOLS[[*b"#*$%&|<>"]] = True
#: Words in the windows that repeats are looked for in.
WINDOW = 8
#: Labelled documents of either kind that the model is fitted on, and the most lines that one of them may have.
SAMPLE_DOCUMENTS, SAMPLE_LINES = 768, 256
#: Share of a document's word characters that must stand in content lines.
CONTENT_SHARE = 0.5
CONTENT, BOILERPLATE = 0, 1
#: Times that lines are labelled anew and the model fitted to them, steps of a fit, weight of the Gaussian prior.
ROUNDS, STEPS, PRIOR = 3, 60, 1.0


def _steps(value: np.ndarray, bounds: list[float]) -> list[np.ndarray]:
    """value >= bound for each bound: a number as features that add up."""
    return [value >= b for b in bounds]


class Lines:
    """The lines of a chunk of rows that hold a word, with their features as bits of a long, and the counts of each row."""

    def __init__(self, text: pa.Array):
        self.words = w = Words(text, lower=False)
        data, offsets, n = w.data, w.offsets, len(w.data)
        bound = np.zeros(n + 1, bool)
        bound[offsets] = True
        bound[1:] |= data == 0x0A
        ends = np.flatnonzero(bound)
        starts = np.concatenate([np.zeros(1, np.int64), ends[:-1]]) if len(ends) else ends
        # a line's newline belongs to it here; lines end before it
        stops = ends - ((ends > starts) & (data[np.maximum(ends - 1, 0)] == 0x0A)) if n else ends
        of_word = np.searchsorted(ends, w.starts, "right")
        n_words = np.bincount(of_word, minlength=len(ends))
        use = n_words > 0
        self.starts, self.ends, self.n_words = starts[use], stops[use], n_words[use]
        self.row = np.searchsorted(offsets, self.starts, "right") - 1
        self.bounds = np.searchsorted(self.row, np.arange(w.rows + 1))
        inside = np.concatenate([np.zeros(1, np.int64), np.cumsum((data & 0xC0) != 0x80)])
        space = np.concatenate([np.zeros(1, np.int64), np.cumsum((data == 0x20) | ((data >= 0x09) & (data <= 0x0D)))])
        self._points, self._space = inside, space
        self.chars = self._between(inside, self.starts, self.ends) - self._between(space, self.starts, self.ends)
        self._hash_lines()
        self._find_repeats()

    @staticmethod
    def _between(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return sums[ends] - sums[starts]

    def _hash_lines(self) -> None:
        """Which lines are equal to an earlier one of their row, to the byte."""
        w, n = self.words, len(self.starts)
        numbers, bounds = eights(w.data, self.starts, self.ends)
        h = hashes_of_eights(numbers, bounds, self.ends - self.starts)
        order = np.lexsort((np.arange(n), h, self.row))
        self.repeated = np.zeros(n, bool)
        self.repeated[order[1:]] = (h[order][1:] == h[order][:-1]) & (self.row[order][1:] == self.row[order][:-1])

    def _find_repeats(self) -> None:
        """Which words lie in a window of WINDOW words that occurs twice or more in its row."""
        w, n = self.words, len(self.words.hashes)
        self.in_repeat = np.zeros(n, bool)
        m = n - WINDOW + 1
        if m > 1:
            total = np.zeros(m, np.uint64)
            for j in range(WINDOW):
                total += w.hashes[j : m + j] * _PLACE[j]
            at = np.flatnonzero(w.row[:m] == w.row[WINDOW - 1 :])
            h, row = mix(total[at]), w.row[at]
            order = np.lexsort((h, row))
            same = (h[order][1:] == h[order][:-1]) & (row[order][1:] == row[order][:-1])
            twice = np.zeros(len(at), bool)
            twice[order[1:]] |= same
            twice[order[:-1]] |= same
            begin = at[twice]
            edge = np.bincount(begin, minlength=n + 1) - np.bincount(begin + WINDOW, minlength=n + 1)
            self.in_repeat = np.cumsum(edge)[:n] > 0

    def places(self) -> np.ndarray:
        """The number of each line among all lines of its row, from 0."""
        newlines = np.concatenate([np.zeros(1, np.int64), np.cumsum(self.words.data == 0x0A)])
        return newlines[self.starts] - newlines[self.words.offsets[self.row]]

    def per_row(self, values: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Sums of values over the rows that `of` says."""
        return np.bincount(of, weights=values, minlength=self.words.rows).astype(np.int64) if len(of) else np.zeros(self.words.rows, np.int64)

    def counts(self) -> dict[str, np.ndarray]:
        """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each row."""
        w, o = self.words, self.words.offsets
        symbols = np.concatenate([np.zeros(1, np.int64), np.cumsum(SYMBOLS[w.data])])
        over = lambda sums: self._between(sums, o[:-1], o[1:])
        return {
            "n_words": np.diff(w.bounds).astype(np.int64), "word_chars": over(self._points) - over(self._space), "n_symbols": over(symbols),
            "n_dup_lines": self.per_row(self.repeated, self.row), "n_repeat_words": self.per_row(self.in_repeat, w.row),
        }

    def features(self) -> np.ndarray:
        """A bit for each feature of each line that holds: lengths, signs, cases and repeats, nothing of the words themselves."""
        w, data, n = self.words, self.words.data, len(self.starts)
        if not n:
            return np.zeros(0, np.int64)
        share = lambda of: self._between(np.concatenate([np.zeros(1, np.int64), np.cumsum(of)]), self.starts, self.ends) / np.maximum(self.chars, 1)
        of_word = np.searchsorted(self.starts, w.starts, "right") - 1
        mean = lambda of: np.bincount(of_word, weights=of, minlength=n) / np.maximum(self.n_words, 1)
        again = np.zeros(len(w.hashes), bool)
        again[1:] = (w.hashes[1:] == w.hashes[:-1]) & (of_word[1:] == of_word[:-1])
        upper, lower = (data >= 0x41) & (data <= 0x5A), (data >= 0x61) & (data <= 0x7A)
        last = data[w.ends[np.searchsorted(w.starts, self.ends) - 1] - 1]
        stop = (last == 0x2E) | (last == 0x21) | (last == 0x3F)
        letters = share(upper | lower)
        bits = [
            np.ones(n, bool), *_steps(self.n_words, [2, 3, 5, 8, 12, 20, 40]), *_steps(share(SYMBOLS[data]), [1e-9, 0.02, 0.05, 0.1, 0.2]), *_steps(share((data >= 0x30) & (data <= 0x39)), [1e-9, 0.1, 0.3]),
            *_steps(share(upper), [0.05, 0.1, 0.3, 0.6]), *_steps(share((data == 0x21) | (data == 0x3F)), [0.01, 0.05]), *_steps(share((data == 0x2F) | (data == 0x5F) | (data == 0x7B) | (data == 0x3D)), [1e-9, 0.05]),
            *_steps(letters, [0.5, 0.75]), *_steps(self.chars / np.maximum(self.n_words, 1), [2.5, 4, 7, 10, 20]), *_steps(mean(again), [1e-9, 0.1, 0.3, 0.6]), *_steps(mean(self.in_repeat), [1e-9, 0.3, 0.8]),
            stop, self.repeated, upper[self.starts] | (data[self.starts] >= 0x80),
        ]
        out = np.zeros(n, np.int64)
        for i, b in enumerate(bits):
            out |= b.astype(np.int64) << i
        return out


N_FEATURES = 41


def unpacked(bits: np.ndarray) -> np.ndarray:
    """Features as a matrix of zeros and ones."""
    return ((bits[:, None] >> np.arange(N_FEATURES)) & 1).astype(np.float64)


def _levels(bounds: np.ndarray) -> Iterator[np.ndarray]:
    """Items of sequences side by side: first all first ones, then all second ones of those that have one, and so on."""
    sizes = np.diff(bounds)
    order = np.argsort(-sizes, kind="stable")
    begin, sizes = bounds[:-1][order], sizes[order]
    for t in range(int(sizes.max(initial=0))):
        yield begin[: np.searchsorted(-sizes, -t, "left")] + t


@dataclass
class Chain:
    """A linear-chain conditional random field of two labels: weights of features for either label, and of neighbouring labels."""

    weights: np.ndarray  # features x labels
    steps: np.ndarray  # labels x labels

    def decode(self, bits: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The likeliest labels of all sequences (Viterbi), sequences side by side; of equally likely ones those of content."""
        score = unpacked(bits) @ self.weights
        best, came = score.copy(), np.zeros((len(bits), 2), np.int8)
        before = None
        for at in _levels(bounds):
            if before is not None:
                both = best[before[: len(at)]][:, :, None] + self.steps[None]
                came[at] = both.argmax(axis=1)
                best[at] = both.max(axis=1) + score[at]
            before = at
        labels = np.zeros(len(bits), np.int8)
        levels = list(_levels(bounds))
        for t in range(len(levels) - 1, -1, -1):
            at = levels[t]
            labels[at] = best[at].argmax(axis=1)
            if t + 1 < len(levels):
                goes_on = at[: len(levels[t + 1])]
                labels[goes_on] = came[levels[t + 1], labels[levels[t + 1]]]
        return labels

    def marginals(self, score: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Probabilities of each item's labels, expected numbers of neighbouring labels, and the sum of the sequences' log partitions."""
        forward, backward, levels = score.copy(), np.zeros_like(score), list(_levels(bounds))
        add = lambda x, axis: np.logaddexp.reduce(x, axis=axis)
        for prior, at in zip(levels, levels[1:], strict=False):
            forward[at] = score[at] + add(forward[prior[: len(at)]][:, :, None] + self.steps[None], 1)
        for prior, at in reversed(list(zip(levels, levels[1:], strict=False))):
            backward[prior[: len(at)]] = add(self.steps[None] + (score[at] + backward[at])[:, None, :], 2)
        total = np.zeros(len(score))
        total[:] = add(forward + backward, 1)
        pairs = np.zeros((2, 2))
        for prior, at in zip(levels, levels[1:], strict=False):
            joint = forward[prior[: len(at)]][:, :, None] + self.steps[None] + (score[at] + backward[at])[:, None, :] - total[at][:, None, None]
            pairs += np.exp(joint).sum(axis=0)
        first = bounds[:-1][np.diff(bounds) > 0]
        return np.exp(forward + backward - total[:, None]), pairs, float(total[first].sum())

    @staticmethod
    def fit(bits: np.ndarray, labels: np.ndarray, bounds: np.ndarray) -> Chain:
        """Maximum likelihood with a Gaussian prior, by resilient gradient steps."""
        x = unpacked(bits)
        chain = Chain(np.zeros((N_FEATURES, 2)), np.zeros((2, 2)))
        follows = np.ones(len(bits), bool)
        follows[bounds[:-1][bounds[:-1] < len(bits)]] = False
        at = np.flatnonzero(follows)
        seen_pairs = np.zeros((2, 2))
        np.add.at(seen_pairs, (labels[at - 1], labels[at]), 1)
        one_hot = np.eye(2)[labels]
        rate, last = np.full(N_FEATURES * 2 + 4, 0.1), np.zeros(N_FEATURES * 2 + 4)
        for _ in range(STEPS):
            p, pairs, _total = chain.marginals(x @ chain.weights, bounds)
            own = x.T @ (one_hot - p) - PRIOR * chain.weights
            step = (seen_pairs - pairs) - PRIOR * chain.steps
            gradient = np.concatenate([own.ravel(), step.ravel()])
            rate = np.clip(np.where(gradient * last > 0, rate * 1.2, np.where(gradient * last < 0, rate * 0.5, rate)), 1e-4, 1.0)
            change, last = np.sign(gradient) * rate, gradient
            chain = Chain(chain.weights + change[:-4].reshape(-1, 2), chain.steps + change[-4:].reshape(2, 2))
        return chain


def learned(good: list[tuple[np.ndarray, np.ndarray]], bad: list[tuple[np.ndarray, np.ndarray]]) -> Chain | None:
    """A model from documents as (features of lines, characters of lines): good ones are content, bad ones hold boilerplate.

    Which lines of bad documents are boilerplate is not said. All are taken to be so at first; then the model labels them, what
    looks like the lines of good documents becomes content, and the model is fitted again. A bad document keeps one line of
    boilerplate at least, the one the model finds likeliest.
    """
    docs = [*good, *bad]
    if not good or not bad:
        return None
    bits = np.concatenate([d[0] for d in docs])
    bounds = np.concatenate([[0], np.cumsum([len(d[0]) for d in docs])]).astype(np.int64)
    is_bad = np.repeat(np.arange(len(docs)) >= len(good), np.diff(bounds))
    labels = np.where(is_bad, BOILERPLATE, CONTENT)
    chain = None
    for _ in range(ROUNDS):
        chain = Chain.fit(bits, labels, bounds)
        found = chain.decode(bits, bounds).astype(np.int64)
        score = unpacked(bits) @ chain.weights
        lead = score[:, BOILERPLATE] - score[:, CONTENT]
        labels = np.where(is_bad, found, CONTENT)
        for a, b in zip(bounds[len(good) : -1], bounds[len(good) + 1 :], strict=True):
            labels[a + int(lead[a:b].argmax())] = BOILERPLATE
    return chain


def _sampled(docs: DataFrame, labels: DataFrame, documents: int, lines: int) -> list[list[tuple[np.ndarray, np.ndarray]]]:
    """Line features of a bounded sample of labelled documents, good and bad ones: the first by a hash of id of either quality among those
    that have a text, of those the ones with no more lines than `lines`."""
    known = labels.filter(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).filter("quality = most").select("doc_id", "quality")
    ids = docs.filter("doc_id is not null and text is not null").select("doc_id").distinct().join(known, "doc_id")
    spark = docs.sparkSession
    chosen = {q: [r.doc_id for r in ids.filter(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(documents).select("doc_id").collect()] for q in (1, 0)}
    kinds = {i: q for q, found in chosen.items() for i in found}
    if not all(chosen.values()):
        return [[], []]
    wanted = spark.createDataFrame([(i,) for i in kinds], docs.select("doc_id").schema)  # two samples at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunked(batches):
            found = Lines(batch.column("text"))
            bits, out = found.features(), []
            for i, (a, b) in enumerate(zip(found.bounds, found.bounds[1:], strict=False)):
                if 0 < b - a <= lines:
                    out.append((batch.column("doc_id")[i], bits[a:b].tobytes(), found.chars[a:b].astype(np.int64).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x[0].as_py() for x in out], batch.column("doc_id").type), pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.binary())], names=["doc_id", "bits", "chars"])

    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id").mapInArrow(run, f"doc_id {kind}, bits binary, chars binary").collect()
    # of rows with one id the first by their lines: a sample has a document once
    once = {r.doc_id: r for r in sorted(rows, key=lambda r: (r.doc_id, r.bits), reverse=True)}
    out: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]
    for i in sorted(once):
        out[kinds[i] == 0].append((np.frombuffer(once[i].bits, np.int64), np.frombuffer(once[i].chars, np.int64)))
    return out


def quality(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, share: float = CONTENT_SHARE, sample_documents: int = SAMPLE_DOCUMENTS, sample_lines: int = SAMPLE_LINES) -> DataFrame:
    """keep (doc_id unless said), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, content_share,
    boilerplate (the numbers of lines, from 0, that are none of the content), kept.

    docs has doc_id and text, labels has doc_id and quality (1 good, 0 bad). The field is fitted on the lines of up to
    sample_documents labelled documents of either quality with up to sample_lines lines (a bounded sample, and the only thing that
    the driver gets); then every document's lines that hold a word are labelled by Viterbi decoding. content_share is the share of
    the document's word characters that stand in content lines, of lines equal to an earlier one too. A document fails the base
    rules with fewer than 20 words, or with over 30 in a hundred words in windows of 8 words that repeat in it; else it is kept if
    content_share reaches `share`.

    Null texts count as without words: they fail, and their share is 0. Without labelled documents of both kinds nothing is
    learned and all lines are content. Texts are taken whole, in memory that follows the longest one; rows that repeat are judged each;
    an empty table gives no rows; other columns are ignored unless kept.
    """
    keep = keep or ["doc_id"]
    chain = learned(*_sampled(docs.select("doc_id", "text"), labels.select("doc_id", "quality"), sample_documents, sample_lines))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    other = [c for c in keep if c != "text"]
    schema = docs.select(*other).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunked(batches):
            found = Lines(batch.column("text"))
            counts, bounds = found.counts(), found.bounds
            bad = chain.decode(found.features(), bounds) == BOILERPLATE if chain is not None else np.zeros(len(found.starts), bool)
            content = found.per_row(found.chars * ~bad, found.row) / np.maximum(counts["word_chars"], 1)
            failed = (counts["n_words"] < 20) | (100 * counts["n_repeat_words"] > 30 * counts["n_words"])
            at = np.cumsum(np.concatenate([np.zeros(1, np.int64), bad.astype(np.int64)]))[bounds]
            places = found.places()[bad]
            listed = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(places, pa.int64()))
            columns = [batch.column(c) for c in range(len(other))] + [pa.array(counts[c], pa.int64()) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(failed), pa.array(content), listed, pa.array(~failed & (content >= share))], names=[*other, *names, "base_failed", "content_share", "boilerplate", "kept"])

    fields = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in schema], *[f"{c} long" for c in names], "base_failed boolean", "content_share double", "boilerplate array<long>", "kept boolean"])
    return docs.select(*other, "text").mapInArrow(run, fields)
