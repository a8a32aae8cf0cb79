"""Exact removal of repeated substrings: repeats meet by shared anchors and are told apart by a multi-document BWT.

The collection's Burrows-Wheeler transform is built column by column, one symbol of every string in a round, with its common
prefixes. It is not built over whole documents (that takes as many rounds over all data as the longest text has bytes) but
over their neighbourhoods: every 100-byte string picks the least hash of its 50-byte grams as its anchor, so equal strings pick
equal anchors, and only strings around an anchor that occurs in different surroundings need to be sorted against each other.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docaudit.llm.lm import squeeze, unsqueeze
from docaudit.llm.storage import blocks, stored, shuffle_partitions
from docaudit.llm.textops import _BASE, _BASE_INVERSE, _BYTE, chunked, mix, powers, raw, release

GRAM, LONGEST, CHUNK, BYTES_PER_PARTITION = 50, 190, 1 << 20, 1 << 24
NONE, MARK = 0xFF, 0xFE  # bytes that no UTF-8 text has
_NO_ID = -(1 << 63)


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(_BASE, len(data))[: len(data)], out=out[1:])
    return out


def range_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((prefix[end] - prefix[start]) * powers(_BASE_INVERSE, len(prefix))[start])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """Runs of string starts with one anchor: row, first start lo in it, number of starts, gram hash g, place of the gram from lo,
    and hash nb of the bytes that the run's strings cover."""
    n, width = len(data), length - GRAM + 1
    sizes = np.diff(offsets)
    if n < length:
        empty = np.zeros(0, np.int64)
        return {"row": empty, "lo": empty, "count": empty, "off": empty, "g": empty.view(np.uint64), "nb": empty.view(np.uint64)}
    prefix = prefix_hashes(data)
    grams = mix((prefix[GRAM:] - prefix[:-GRAM]) * powers(_BASE_INVERSE, n)[: n - GRAM + 1])
    del prefix
    least, place, reach, other = grams, np.arange(len(grams), dtype=np.int32), 1, None
    while reach < width:  # leftmost minimum over doubling widths, the last step overlapping
        step = min(reach, width - reach)
        other = least[step:] < least[: len(least) - step]
        place = np.where(other, place[step:], place[: len(place) - step])
        least = np.minimum(least[step:], least[: len(least) - step])
        reach += step
    del least, other
    valid = np.zeros(n + 1, np.int64)
    full = sizes >= length
    np.add.at(valid, offsets[:-1][full], 1)
    np.add.at(valid, offsets[1:][full] - length + 1, -1)
    at = np.flatnonzero(np.cumsum(valid)[: len(place)] > 0).astype(np.int64)
    own = place[at].astype(np.int64)
    del place
    new = np.concatenate([[True], (own[1:] != own[:-1]) | (np.diff(at) != 1)]) if len(at) else np.zeros(0, bool)
    new[1:] |= np.isin(at[1:], offsets[1:-1])
    first = np.flatnonzero(new)
    lo, count, p = at[first], np.diff(np.append(first, len(at))), own[first]
    row = np.searchsorted(offsets, lo, "right") - 1
    return {"row": row, "lo": lo - offsets[row], "count": count, "off": p - lo, "g": grams[p], "nb": range_hashes(prefix_hashes(data), lo, lo + count - 1 + length)}


def range_min(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimum of values[a..b], both ends included, of each pair."""
    order = np.argsort(a, kind="stable")
    cuts = np.stack([a[order], b[order] + 1], axis=1).ravel()
    out = np.empty(len(a), values.dtype)
    out[order] = np.minimum.reduceat(np.append(values, values.dtype.type(255)), cuts)[::2]
    return out


def collection_bwt(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, suffix length, common prefix with the suffix before) of all suffixes of a collection in sorted order.

    Column-wise: round j inserts the suffix of length j of every string that long. Its place follows from the transform alone:
    the suffixes that begin with a symbol are in the order of that symbol's occurrences in the transform. The common prefix
    with a neighbour is one more than the least common prefix between two occurrences. Strings are at most 254 bytes long; an
    equal suffix of an earlier string comes first.
    """
    m = len(starts)
    bwt, string, size, common = data[starts + lengths - 1], np.arange(m, dtype=np.uint32), np.zeros(m, np.uint8), np.zeros(m, np.uint8)
    place, ends = np.arange(m), starts + lengths
    active = np.arange(m)
    for j in range(1, int(lengths.max(initial=0)) + 1):
        active = active[lengths[active] >= j]
        at = place[active]
        order = np.argsort(bwt, kind="stable")
        rank = np.empty(len(bwt), np.int64)
        rank[order] = np.arange(len(bwt))
        k, symbol = rank[at], bwt[at]
        total = len(bwt) + len(active)
        before, after = order[np.maximum(k - 1, 0)], order[np.minimum(k + 1, len(order) - 1)]
        has_before, has_after = (k > 0) & (bwt[before] == symbol), (k + 1 < len(order)) & (bwt[after] == symbol)
        up, down = np.zeros(len(k), np.uint8), np.zeros(len(k), np.uint8)
        if has_before.any():
            up[has_before] = 1 + range_min(common, before[has_before] + 1, at[has_before])
        if has_after.any():
            down[has_after] = 1 + range_min(common, at[has_after] + 1, after[has_after])
        new = m + k
        old = np.ones(total, bool)
        old[new] = False

        def merge(kept, added, old=old, new=new, total=total):
            out = np.empty(total, kept.dtype)
            out[old], out[new] = kept, added
            return out

        left = ends[active] - j
        previous = np.where(left > starts[active], data[np.maximum(left - 1, 0)], np.uint8(NONE))
        bwt, string, size, common = merge(bwt, previous), merge(string, active.astype(np.uint32)), merge(size, np.uint8(j)), merge(common, up)
        common[new[has_after] + 1] = down[has_after]
        place[active] = new
    return string, size, common


def repeated_windows(strings: list[bytes], order: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(string, offset) of each substring of so many bytes that is not the first of its equals; order: (n, 3+) keys, the last a start."""
    lengths = np.array([len(s) for s in strings], np.int64)
    starts = np.cumsum(lengths) - lengths
    string, size, common = collection_bwt(np.frombuffer(b"".join(strings), np.uint8), starts, lengths)
    group = np.cumsum(common < depth)
    long = size >= depth
    string, offset, group = string[long].astype(np.int64), (lengths[string[long]] - size[long]), group[long]
    twin = np.bincount(group, minlength=int(group.max(initial=0)) + 1)[group] > 1
    string, offset, group = string[twin], offset[twin], group[twin]
    keys = order[string]
    sorted_ = np.lexsort((keys[:, -1] + offset, *(keys[:, i] for i in range(keys.shape[1] - 2, -1, -1)), group))
    first = np.concatenate([[True], group[sorted_][1:] != group[sorted_][:-1]]) if len(group) else np.zeros(0, bool)
    gone = sorted_[~first]
    return string[gone], offset[gone]


def code(g: int) -> bytes:
    """A mark and ten symbols that stand for a gram: its hash of 64 bits."""
    return bytes((MARK, *(g >> s & 127 for s in range(63, -1, -7))))


def ranges(reach: int) -> list[tuple[int, int]]:
    """Ranges of the number of bytes that a string has before its gram, of `reach` beside it. Strings of one range that are equal
    also have equal bytes next to the gram, at least a before it and reach - b + 1 behind it, so a gram with very many
    surroundings falls into groups by these; the narrow ranges at the ends have the most such bytes on one side."""
    cuts = sorted({0, reach + 1, *(c for c in (4, reach // 2 + 1, reach - 3) if 0 < c <= reach)})
    return list(zip(cuts, cuts[1:], strict=False))


def pieces_of(whole: bytes, lo: int, count: int, off: int, g: int, length: int) -> list[tuple[int, int, bytes]]:
    """(start, key, bytes) of a neighbourhood's strings by range, the gram replaced by its code. Equal strings share a key."""
    reach, gram, out = length - GRAM, lo + off, []
    name = code(g)
    for r, (a, b) in enumerate(ranges(reach)):
        most, least = min(b - 1, off), max(a, off - count + 1)
        if least <= most:
            key = zlib.crc32(whole[gram + GRAM : gram + GRAM + reach - b + 1], zlib.crc32(whole[gram - a : gram], r))
            out.append((gram - most, (key << 32) ^ (g >> 32), whole[gram - most : gram] + name + whole[gram + GRAM : gram + GRAM + reach - least]))
    return out


def merged_spans(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of the union of spans within each row."""
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order], end[order]
    if not len(row):
        return row, start, end
    far = np.int64(1) << 40
    reach = np.maximum.accumulate(row * far + end)
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (row[1:] * far + start[1:] > reach[:-1])])
    at = np.flatnonzero(new)
    return row[at], start[at], reach[np.append(at[1:], len(row)) - 1] - row[at] * far


def by_chunk(chunk_at: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(chunk_at, kind="stable")
    cuts = np.searchsorted(chunk_at[order], np.arange(n + 1))
    for i in np.flatnonzero(np.diff(cuts)):
        yield int(i), order[cuts[i] : cuts[i + 1]]


STREAM = "p int, kind string, chunk long, data binary"


def remove_repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text: str = "text", with_kept: bool = False) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the remaining bytes) of every row.

    A byte goes if a string of `length` bytes that covers it also starts earlier, in a row of a smaller id or before in the same
    row; strings never cross rows; all is judged on the input. Null ids come first; rows of one id follow each other in the
    table's order, and rows that are equal in id and text share the first one's result. Null and empty texts have no bytes; an
    empty table gives no rows; other columns are ignored.

    One pass finds the anchors. Equal neighbourhoods are reduced to the first in a task before they are shuffled by anchor, so
    that a text of very many copies sends one a task. Of equal neighbourhoods (128 bits of hashes) all but the first are removed
    whole. Where an anchor has several neighbourhoods, the first of each is fetched (its own bytes only) in pieces by ranges,
    which are dealt out by the bytes next to the gram, so that a gram with very many surroundings falls into many groups;
    repeated_windows compares their bytes, with a hash of 64 bits in the gram's place. Spans go back to the texts by an
    equi-join on id and hash.
    """
    if not GRAM <= length <= LONGEST:
        raise ValueError(f"length must be from {GRAM} to {LONGEST}")
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    id_type = dict(rows.dtypes)["id"]
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n_parts = max(shuffle_partitions(spark), blocks(size, BYTES_PER_PARTITION))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for i, batch in enumerate(chunked(batches, limit=CHUNK)):
            chunk = (task << 32) | i
            out = []
            data, offsets = raw(batch.column(1))
            sink = pa.BufferOutputStream()
            meta = pa.RecordBatch.from_arrays([batch.column(0), batch.column(2)], names=["id", "th"])
            with pa.ipc.new_stream(sink, meta.schema) as writer:
                writer.write_batch(meta)
            ids = np.array([_NO_ID if x is None else x for x in batch.column(0).to_pylist()], np.int64)
            a = anchors(data, offsets, length)
            order = np.lexsort((a["lo"], a["row"], ids[a["row"]], a["nb"], a["g"]))
            a = {k: v[order] for k, v in a.items()}
            first = np.ones(len(order), bool)
            first[1:] = (a["g"][1:] != a["g"][:-1]) | (a["nb"][1:] != a["nb"][:-1])
            b = {k: v[~first] for k, v in a.items()}
            out += [(-1 - chunk % n_parts, "rows", sink.getvalue().to_pybytes()), (-1 - chunk % n_parts, "gone", squeeze(*(x.astype(np.uint32) for x in merged_spans(b["row"], b["lo"], b["lo"] + b["count"] - 1 + length))))]
            a = {k: v[first] for k, v in a.items()}
            p = ((mix(a["g"]) >> np.uint64(32)) * np.uint64(n_parts) >> np.uint64(32)).astype(np.int64)  # minima are small: mixed again
            order = np.argsort(p, kind="stable")
            a, p = {k: v[order] for k, v in a.items()}, p[order]
            cuts = np.searchsorted(p, np.arange(n_parts + 1))
            for q in np.flatnonzero(np.diff(cuts)):
                s = slice(cuts[q], cuts[q + 1])
                used, back = np.unique(a["row"][s], return_inverse=True)
                out.append((int(q), "anchors", squeeze(a["g"][s], a["nb"][s], back.astype(np.uint32), a["lo"][s].astype(np.uint32), a["count"][s].astype(np.uint8), a["off"][s].astype(np.uint8), used.astype(np.uint32), ids[used])))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out]), pa.array([chunk] * len(out), pa.int64()), pa.array([x[2] for x in out], pa.binary())], names=["p", "kind", "chunk", "data"])

    def reduce(group: pa.Table) -> pa.Table:
        p = group["p"][0].as_py()
        if p < 0:
            return group
        chunks, fields = group["chunk"].to_pylist(), []
        for i, data in enumerate(group["data"].to_pylist()):
            g, nb, back, lo, count, off, used, ids = unsqueeze(data)
            fields.append((g, nb, ids[back], np.full(len(g), i, np.uint32), used[back], lo, count, off))
        g, nb, ids, at, row, lo, count, off = (np.concatenate(x) for x in zip(*fields, strict=True))
        del fields
        order = np.argsort(g, kind="stable")
        same = g[order][1:] == g[order][:-1]
        order = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
        g, nb, ids, at, row, lo, count, off = (x[order] for x in (g, nb, ids, at, row, lo, count, off))
        order = np.lexsort((lo, row, np.array(chunks)[at] if len(at) else at, ids, nb, g))
        g, nb, at, row, lo, count, off = (x[order] for x in (g, nb, at, row, lo, count, off))
        new_g = np.ones(len(g), bool)
        new_g[1:] = g[1:] != g[:-1]
        first = new_g.copy()
        first[1:] |= nb[1:] != nb[:-1]
        heads = np.flatnonzero(new_g)
        several = np.repeat(np.add.reduceat(first, heads, dtype=np.int64) > 1, np.diff(np.append(heads, len(g)))) if len(g) else first
        out = []
        gone = np.flatnonzero(~first)
        for i, j in by_chunk(at[gone], len(chunks)):
            j = gone[j]
            out.append(("gone", chunks[i], squeeze(*(x.astype(np.uint32) for x in merged_spans(row[j].astype(np.int64), lo[j].astype(np.int64), lo[j].astype(np.int64) + count[j] - 1 + length)))))
        ask = np.flatnonzero(first & several)
        for i, j in by_chunk(at[ask], len(chunks)):
            j = ask[j]
            out.append(("ask", chunks[i], squeeze(row[j], lo[j], count[j], off[j], g[j])))
        del g, nb, at, row, lo, count, off, order
        release()
        return pa.table({"p": pa.array([p] * len(out), pa.int32()), "kind": pa.array([x[0] for x in out], pa.string()), "chunk": pa.array([x[1] for x in out], pa.int64()), "data": pa.array([x[2] for x in out], pa.binary())})

    found = stored(rows.mapInArrow(stream, STREAM).groupBy("p").applyInArrow(reduce, STREAM), "anchors")

    def requests(group: pa.Table) -> pa.Table:
        meta, by_row = None, defaultdict(list)
        for kind, data in zip(group["kind"].to_pylist(), group["data"].to_pylist(), strict=True):
            if kind == "rows":
                meta = pa.ipc.open_stream(data).read_all()
                continue
            row, *rest = unsqueeze(data)
            order = np.argsort(row, kind="stable")
            cuts = np.flatnonzero(np.concatenate([[True], row[order][1:] != row[order][:-1]]))
            for a, b in zip(cuts, np.append(cuts[1:], len(row)), strict=True):
                by_row[int(row[order[a]])].append([x[order[a:b]] for x in rest])
        keys = sorted(by_row)
        at = pa.array(keys, pa.int64())
        asked = [squeeze(*(np.concatenate(x) for x in zip(*by_row[r], strict=True))) for r in keys]
        return pa.table([meta["id"].take(at), meta["th"].take(at), pa.array([group["chunk"][0].as_py()] * len(keys), pa.int64()), pa.array(keys, pa.int64()), pa.array(asked, pa.binary())], names=["id", "th", "chunk", "row", "ask"])

    wanted = found.filter("kind in ('rows', 'ask')").groupBy("chunk").applyInArrow(requests, f"id {id_type}, th long, chunk long, row long, ask binary")
    asked = wanted.withColumnRenamed("id", "w_id").withColumnRenamed("th", "w_th")
    texts = rows.join(asked, F.col("id").eqNullSafe(F.col("w_id")) & (F.col("th") == F.col("w_th"))).select("id", "chunk", "row", "ask", "text")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunked(batches, limit=CHUNK):
            keys, groups, parts = [], [], []
            data, offsets = raw(batch.column("text"))
            for r, (id_, chunk, row, ask) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("id", "chunk", "row", "ask")), strict=True)):
                whole = data[offsets[r] : offsets[r + 1]].tobytes()
                own = _NO_ID if id_ is None else id_
                for lo, count, off, g in zip(*(x.tolist() for x in unsqueeze(ask)), strict=True):
                    for start, group, string in pieces_of(whole, lo, count, off, g, length):
                        keys.append((own, chunk, row, start))
                        groups.append(group)
                        parts.append(string)
            key, group, size = np.array(keys, np.int64).reshape(-1, 4), np.array(groups, np.uint64), np.array([len(x) for x in parts], np.uint8)
            p = ((mix(group) >> np.uint64(32)) * np.uint64(n_parts) >> np.uint64(32)).astype(np.int32)
            order = np.argsort(p, kind="stable")
            cuts = np.searchsorted(p[order], np.arange(n_parts + 1))
            full = np.flatnonzero(np.diff(cuts)).tolist()
            out = [squeeze(key[at].ravel(), group[at], size[at]) + b"|" + b"".join(parts[i] for i in at.tolist()) for at in (order[cuts[q] : cuts[q + 1]] for q in full)]
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(out, pa.binary())], names=["p", "data"])

    def compare(group: pa.Table) -> pa.Table:
        keys, of, strings = [], [], []
        for data in group["data"].to_pylist():
            at, both = 0, []
            for _ in range(3):
                stop = data.index(b";", at)
                end = stop + 1 + int(data[at:stop].split(b",")[2])
                both += unsqueeze(data[at:end])
                at = end
            keys.append(both[0].reshape(-1, 4))
            of.append(both[1])
            ends = at + 1 + np.cumsum(both[2], dtype=np.int64)
            strings += [data[e - n : e] for e, n in zip(ends.tolist(), both[2].tolist(), strict=True)]
        order, unique = np.unique(np.concatenate(keys), axis=0, return_index=True)
        strings, of = [strings[i] for i in unique.tolist()], np.concatenate(of)[unique]
        size, seen, new = np.array([len(x) for x in strings], np.int64), set(), np.zeros(len(strings), bool)
        for i, x in enumerate(strings):  # in order: of equal strings all but the first go whole
            if x not in seen:
                seen.add(x)
                new[i] = True
        del seen
        _, back, times = np.unique(of[new], return_inverse=True, return_counts=True)
        several = np.flatnonzero(new)[times[back] > 1]  # only strings whose key others have can share a substring with them
        string, offset = repeated_windows([strings[i] for i in several.tolist()], order[several], length - GRAM + 11)
        own = several[string]
        again = np.flatnonzero(~new)
        where = np.concatenate([order[own], order[again]])
        start = np.concatenate([order[own][:, 3] + offset, order[again][:, 3]])
        end = np.concatenate([order[own][:, 3] + offset + length, order[again][:, 3] + size[again] + GRAM - 11])
        chunks, at = np.unique(where[:, 1], return_inverse=True)
        release()
        out = [(int(chunks[i]), squeeze(*(x.astype(np.uint32) for x in merged_spans(where[j, 2], start[j], end[j])))) for i, j in by_chunk(at, len(chunks))]
        return pa.table({"kind": pa.array(["gone"] * len(out), pa.string()), "chunk": pa.array([x[0] for x in out], pa.int64()), "data": pa.array([x[1] for x in out], pa.binary())})

    compared = texts.mapInArrow(fetch, "p int, data binary").groupBy("p").applyInArrow(compare, "kind string, chunk long, data binary")

    def gather(group: pa.Table) -> pa.Table:
        meta, spans = None, []
        for kind, data in zip(group["kind"].to_pylist(), group["data"].to_pylist(), strict=True):
            if kind == "rows":
                meta = pa.ipc.open_stream(data).read_all()
            else:
                spans.append([x.astype(np.int64) for x in unsqueeze(data)])
        row, start, end = merged_spans(*(np.concatenate(x) for x in zip(*spans, strict=True)))
        heads = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, int)
        stops = np.append(heads[1:], len(row))[: len(heads)]
        whole = np.setdiff1d(np.arange(meta.num_rows), row[heads])  # rows that lose nothing, so that their repeats don't either
        at = pa.array(np.concatenate([row[heads], whole]), pa.int64())
        cut = [np.stack([start[a:b], end[a:b]], axis=1).astype("<u4").tobytes() for a, b in zip(heads, stops, strict=True)]
        n = [int((end[a:b] - start[a:b]).sum()) for a, b in zip(heads, stops, strict=True)]
        return pa.table([meta["id"].take(at), meta["th"].take(at), pa.array(n + [0] * len(whole), pa.int64()), pa.array(cut + [b""] * len(whole), pa.binary())], names=["id", "th", "n", "cut"])

    spans = found.filter("kind in ('rows', 'gone')").select("kind", "chunk", "data").unionByName(compared)
    cuts = spans.groupBy("chunk").applyInArrow(gather, f"id {id_type}, th long, n long, cut binary")
    least = cuts.groupBy(F.col("id").alias("c_id"), F.col("th").alias("c_th")).agg(F.min_by("cut", "n").alias("cut"))
    joined = rows.join(least, F.col("id").eqNullSafe(F.col("c_id")) & (F.col("th") == F.col("c_th")), "left").select("id", "text", "cut")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = raw(batch.column(1))
            out = []
            for r, cut in enumerate(batch.column(2).to_pylist()):
                whole = data[offsets[r] : offsets[r + 1]].tobytes()
                runs, at, parts = np.frombuffer(cut or b"", "<u4").reshape(-1, 2).tolist(), 0, []
                for a, b in runs:
                    parts.append(whole[at:a])
                    at = b
                kept = b"".join([*parts, whole[at:]])
                out.append((len(whole), len(whole) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()][: 5 if with_kept else 4]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[i] for x in out], t) for i, t in enumerate(types))], names=[id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: len(types) + 1])

    return joined.mapInArrow(apply, f"{id_col} {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_kept)
