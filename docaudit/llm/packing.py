"""Best-fit packing of token sequences by linear grouping."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docaudit.llm.storage import blocks, stored
from docaudit.llm.textops import Words, chunked, equal_eights

CAPACITY, GROUPS, PIECES_PER_SHARD = 2048, 32, 1 << 16
KNOWN_WORDS, TRIES = 1 << 21, 32


@cache
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


# Digits and ASCII punctuation without those that contractions and special tokens are made of.
_OTHER = np.zeros(256, bool)
_OTHER[[c for c in range(33, 127) if not chr(c).isalpha() and chr(c) not in "'<|>"]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def letter_cuts(data: np.ndarray) -> np.ndarray:
    """Where the vocabulary's pre-tokeniser always parts: between a Latin letter and a digit or punctuation mark.

    The byte after a cut is ASCII, so no combining mark is cut from what it follows.
    """
    letter = _LETTER[data]
    if len(data) > 1:
        letter[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    other, cut = _OTHER[data], np.zeros(len(data), bool)
    cut[1:] = letter[:-1] & other[1:] | other[:-1] & _LETTER[data[1:]]
    return cut


class WordIds:
    """Ids of words, kept in a worker by hash in sorted arrays of at most KNOWN_WORDS, with the words' own bytes.

    A word gets the ids kept under its hash only if its bytes are those of the word they belong to; other words of that hash
    are encoded by themselves. New words are encoded in one call, parted by a special token; words that hold one themselves
    are encoded alone.
    """

    def __init__(self, path: str):
        self.encoder = tokenizer(path)
        self.clear()

    def clear(self) -> None:
        self.keys, self.begins, self.lengths, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint32)
        self.spelt_at, self.spelt_n, self.spelt = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint64)

    def encoded(self, words: list[bytes]) -> list[np.ndarray]:
        texts = [w.decode("utf-8", "replace") for w in words]
        odd = {i for i, w in enumerate(words) if b"<|" in w}
        mark = self.encoder.token_to_id("<|endoftext|>")
        plain = [t for i, t in enumerate(texts) if i not in odd]
        ids = np.array(self.encoder.encode("<|endoftext|>".join(plain), add_special_tokens=False).ids if plain else [], np.uint32)
        cuts = np.flatnonzero(ids == mark)
        pieces = iter([ids[a:b] for a, b in zip([0, *(cuts + 1)], [*cuts, len(ids)], strict=True)])
        return [np.array(self.encoder.encode(t, add_special_tokens=False).ids, np.uint32) if i in odd else next(pieces) for i, t in enumerate(texts)]

    def encode(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of ids of each word."""
        unique, first, back = np.unique(words.hashes, return_index=True, return_inverse=True)
        if len(self.keys) > KNOWN_WORDS:
            self.clear()
        at = np.searchsorted(self.keys, unique)
        new = np.ones(len(unique), bool)
        inner = at < len(self.keys)
        new[inner] = self.keys[at[inner]] != unique[inner]
        begin, n = words.number_at[:-1], np.diff(words.number_at)
        data = words.data.tobytes()
        if new.any():
            own = self.encoded([data[words.starts[j] : words.ends[j]] for j in first[new]])
            lengths, spelt_n = np.array([len(x) for x in own], np.int32), n[first[new]]
            self.begins = np.insert(self.begins, at[new], len(self.ids) + np.cumsum(lengths) - lengths)
            self.lengths = np.insert(self.lengths, at[new], lengths)
            self.spelt_at = np.insert(self.spelt_at, at[new], len(self.spelt) + np.cumsum(spelt_n) - spelt_n)
            self.spelt_n = np.insert(self.spelt_n, at[new], spelt_n)
            self.keys = np.insert(self.keys, at[new], unique[new])
            self.ids = np.concatenate([self.ids, *own])
            self.spelt = np.concatenate([self.spelt, *(words.numbers[begin[j] : begin[j] + n[j]] for j in first[new])])
            at = np.searchsorted(self.keys, unique)
        begins, lengths, ids = self.begins[at][back], self.lengths[at][back].astype(np.int64), self.ids
        known = equal_eights(words.numbers, (begin, n), self.spelt, (self.spelt_at[at][back], self.spelt_n[at][back]))
        other = np.flatnonzero(~known)
        if len(other):
            spelt = [data[words.starts[j] : words.ends[j]] for j in other]
            alone = dict(zip(names := sorted(set(spelt)), self.encoded(names), strict=True))
            lengths[other] = [len(alone[w]) for w in spelt]
            begins[other] = len(ids) + np.cumsum(lengths[other]) - lengths[other]
            ids = np.concatenate([ids, *(alone[w] for w in spelt)])
        ends = np.cumsum(lengths)
        where = np.repeat(begins - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)
        return ids[where], lengths


@cache
def known_words(path: str) -> WordIds:
    """One store a worker, which later tasks go on using."""
    return WordIds(path)


def tokenize(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: whole texts as ids and a closing 0, cut only where longer than capacity."""
    schema = f"{id_col} {dict(docs.dtypes)[id_col]}, piece int, start long, length long, ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = known_words(path)
        for batch in chunked(batches, text):
            words = Words(batch.column(1), lower=False, cuts=letter_cuts)
            ids, lengths = known.encode(words)
            bounds = np.concatenate([[0], np.cumsum(lengths)])[words.bounds]
            rows, pieces, starts, sizes, crcs = [], [], [], [], []
            for r in range(words.rows):
                own = np.append(ids[bounds[r] : bounds[r + 1]], np.uint32(0)).astype("<u4")
                for p, at in enumerate(range(0, len(own), capacity)):
                    part = own[at : at + capacity]
                    rows.append(r), pieces.append(p), starts.append(at), sizes.append(len(part)), crcs.append(zlib.crc32(part.tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(pieces, pa.int32()), *(pa.array(x, pa.int64()) for x in (starts, sizes, crcs))], names=[id_col, "piece", "start", "length", "ids_crc32"])

    return docs.select(id_col, text).mapInArrow(run, schema)


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, most: int = 2000) -> list[tuple[np.ndarray, float]]:
    """(slots by size, times) of a cheapest fractional cover of the demand, by column generation.

    The master keeps a basis of as many configurations as sizes; a knapsack over at most capacity // min(sizes) items prices
    the next one. Any basis on the way is a valid cover, so the limit on rounds only costs optimality.
    """
    k = len(sizes)
    basis = np.diag(capacity // sizes).astype(float)
    for _ in range(most):
        inverse = np.linalg.inv(basis)
        x, y = inverse @ demand, inverse.sum(axis=0)
        value, last = np.zeros(capacity + 1), []
        for _ in range(int(capacity // sizes.min())):
            best, item = value.copy(), np.full(capacity + 1, -1)
            for i in np.flatnonzero(y > 1e-12):
                s = sizes[i]
                other = value[: capacity + 1 - s] + y[i]
                better = other > best[s:] + 1e-12
                best[s:][better], item[s:][better] = other[better], i
            last.append(item)
            value = best
        if value[capacity] <= 1 + 1e-7:
            break
        column, room = np.zeros(k), capacity
        for item in reversed(last):
            if item[room] >= 0:
                column[item[room]] += 1
                room -= sizes[item[room]]
        step = inverse @ column
        ratio = np.where(step > 1e-10, np.maximum(x, 0) / np.where(step > 1e-10, step, 1), np.inf)
        basis[:, int(ratio.argmin())] = column
    x = np.linalg.inv(basis) @ demand
    return [(basis[:, j].astype(int), float(x[j])) for j in range(k)]


class Pool:
    """Items by length; the longest that fits is found in a bit set."""

    def __init__(self, lengths: np.ndarray, items: np.ndarray):
        self.by: dict[int, list[int]] = {}
        for i in items.tolist():
            self.by.setdefault(int(lengths[i]), []).append(i)
        self.mask = sum(1 << n for n in self.by)

    def give(self, length: int, item: int) -> None:
        self.by.setdefault(length, []).append(item)
        self.mask |= 1 << length

    def longest(self, room: int, without: int = -1) -> int:
        """The longest length of at most room, -1 if none; one item of the length `without` counts as gone."""
        mask = self.mask
        if without >= 0 and len(self.by[without]) == 1:
            mask ^= 1 << without
        return (mask & ((2 << max(room, -1)) - 1)).bit_length() - 1

    def pair(self, most: int, room: int) -> int:
        """The length, of at most `most`, that leaves least of room once the longest partner is put beside it."""
        first = self.longest(min(most, room))
        best, least = first, room + 1
        for _ in range(TRIES):
            if first < 0:
                break
            gap = room - first - max(0, self.longest(room - first, first))
            if gap < least:
                best, least = first, gap
                if not gap:
                    break
            first = self.longest(first - 1)
        return best

    def take(self, room: int) -> tuple[int, int] | None:
        """(length, item) of the longest item of at most room."""
        n = self.longest(room)
        if n < 0:
            return None
        stack = self.by[n]
        item = stack.pop()
        if not stack:
            del self.by[n]
            self.mask ^= 1 << n
        return n, item


def pack(lengths: np.ndarray, capacity: int = CAPACITY, groups: int = GROUPS) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item, in as few bins of the capacity as the scheme finds.

    Lengths above an eighth of the capacity are grouped by rank in equal numbers and rounded up to their group's greatest;
    configurations of these few sizes are optimised; actual items then replace the slots, the last two of a bin being chosen to
    fill the room really left. A configuration
    is left where it would not fill a bin closely. What remains, long before short, goes by best fit into open bins.
    """
    lengths = np.asarray(lengths, np.int64)
    bins, offsets = np.full(len(lengths), -1), np.zeros(len(lengths), np.int64)
    fill: list[int] = []

    def put(item: int, b: int) -> None:
        bins[item], offsets[item] = b, fill[b]
        fill[b] += int(lengths[item])

    for i in np.flatnonzero(lengths >= capacity).tolist():
        fill.append(0)
        put(i, len(fill) - 1)
    large = np.flatnonzero((lengths > capacity // 8) & (lengths < capacity))
    pool = Pool(lengths, large)
    if len(large):
        ordered = np.sort(lengths[large])[::-1]
        cuts = np.unique(np.linspace(0, len(ordered), min(groups, len(ordered)) + 1).astype(int))
        sizes, demand = np.unique(np.repeat(ordered[cuts[:-1]], np.diff(cuts)), return_counts=True)
        plan = configurations(sizes, demand.astype(float), capacity)
        for slots, times in sorted(plan, key=lambda p: -float(p[0] @ sizes)):
            wanted = [int(s) for s in np.repeat(sizes, slots)[::-1]]
            for _ in range(int(times + 1e-9)):
                room, chosen = capacity, []
                for j, s in enumerate(wanted):
                    last = len(wanted) - 1 - j
                    got = pool.take(room if not last else pool.pair(s, room) if last == 1 else min(s, room))
                    if got:
                        room -= got[0]
                        chosen.append(got[1])
                if room > min(capacity - int(slots @ sizes), capacity // 64):  # the pool no longer has what the plan needs
                    for item in chosen:
                        pool.give(int(lengths[item]), item)
                    break
                fill.append(0)
                for item in chosen:
                    put(item, len(fill) - 1)
    room_of: dict[int, list[int]] = {}
    for b, used in enumerate(fill):
        room_of.setdefault(capacity - used, []).append(b)
    mask = sum(1 << r for r in room_of)
    left = np.flatnonzero(bins < 0)
    for item in left[np.argsort(-lengths[left], kind="stable")].tolist():
        need = int(lengths[item])
        above = mask >> need
        if above:
            room = need + (above & -above).bit_length() - 1
            b = room_of[room].pop()
            if not room_of[room]:
                del room_of[room]
                mask ^= 1 << room
        else:
            fill.append(0)
            b, room = len(fill) - 1, capacity
        put(item, b)
        room_of.setdefault(room - need, []).append(b)
        mask |= 1 << (room - need)
    return bins, offsets


def best_fit_packing(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, groups: int = GROUPS, per_shard: int = PIECES_PER_SHARD) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every row.

    Pieces are stored once and dealt at random over shards of about per_shard pieces, each of which is packed by itself: every
    shard sees the same spread of lengths, so a shard more costs a few sequences at most. Null and empty texts are the single
    id 0; repeated rows are packed each; an empty table gives no rows; other columns are ignored.
    """
    pieces = stored(tokenize(docs, tokenizer_path, capacity), "pieces")
    shards = blocks(pieces.count(), per_shard)
    key = [f.name for f in pieces.schema.fields]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        bins, offsets = pack(group["length"].to_numpy(), capacity, groups)
        return group.assign(sequence_id=(int(group["shard"].iloc[0]) << 40) + bins, offset=offsets)[[*key, "sequence_id", "offset"]]

    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))
    schema = ", ".join(f"{n} {t}" for n, t in pieces.dtypes) + ", sequence_id long, offset long"
    return dealt.groupBy("shard").applyInPandas(run, schema)
