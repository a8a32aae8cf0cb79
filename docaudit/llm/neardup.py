"""Near-duplicate documents by b-bit MinHash."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docaudit.llm.graph import as_edges, components
from docaudit.llm.storage import blocks, free_name, join_apart, materialize
from docaudit.llm.textops import Words, chunked, distinct_by_row, mix, shingles

ROWS, BITS, LOSS, SIGMAS = 4, 4, 1e-9, 6.5
#: Members of a part where signatures meet (some 100 bytes each), and where full sets do; members of small groups in a task.
SIGNATURES, SETS, PER_TASK = 2048, 256, 4096
_NIBBLES = np.uint64(0x1111111111111111)


def bands_for(threshold: float) -> int:
    """Bands of ROWS minima at which a pair at the threshold shares none with a probability of LOSS at most."""
    return math.ceil(math.log(LOSS) / math.log(1 - threshold**ROWS))


@cache
def multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(77))
    return rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def digest(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Rows x 2: a 128-bit digest of each row's set, whatever its order; rows without members give zeros."""
    out = np.zeros((len(bounds) - 1, 2), np.uint64)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        for j, salt in enumerate((0x243F6A8885A308D3, 0x13198A2E03707344)):
            out[full, j] = mix(np.add.reduceat(mix(hashes ^ np.uint64(salt)), bounds[full]) + np.diff(bounds)[full].astype(np.uint64))
    return out


def signatures(hashes: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """Rows x n minima of the rows that begin at starts (none empty)."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    a, c = multipliers(n)
    return np.stack([np.minimum.reduceat(x * a[k] + c[k], starts) for k in range(n)], axis=1)


def packed(minima: np.ndarray) -> np.ndarray:
    """The low BITS bits of each minimum, sixteen to a word."""
    low = (minima & np.uint32(15)).astype(np.uint64)
    low = np.pad(low, ((0, 0), (0, -low.shape[1] % 16)))
    return (low.reshape(len(low), -1, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=2, dtype=np.uint64)


def estimate(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Similarity from packed signatures, corrected for low bits that agree by chance."""
    x = a ^ b
    x |= x >> np.uint64(2)
    x |= x >> np.uint64(1)
    equal = 1 - np.bitwise_count(x & _NIBBLES).sum(axis=-1) / n
    return (equal - 2.0**-BITS) / (1 - 2.0**-BITS)


def least_estimate(threshold: float, n: int) -> float:
    chance = threshold + (1 - threshold) * 2.0**-BITS
    return (chance - SIGMAS * math.sqrt(chance * (1 - chance) / n) - 2.0**-BITS) / (1 - 2.0**-BITS)


def sketch(docs: DataFrame, size: int, threshold: float, id_col: str, text: str) -> DataFrame:
    """id, th (hash of the text), n_shingles, digest of the set, sig, bands; narrow. Sets are of whole texts; empty ones have no digest."""
    bands = bands_for(threshold)
    schema = f"{id_col} {dict(docs.dtypes)[id_col]}, th long, n_shingles long, digest binary, sig binary, bands array<long>"
    places = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunked(batches, text):
            hashes, bounds = distinct_by_row(*shingles(Words(batch.column(1)), size), batch.num_rows)
            sizes = np.diff(bounds)
            nodes, sig, keys = [None] * len(sizes), [None] * len(sizes), [None] * len(sizes)
            full = np.flatnonzero(sizes)
            if len(full):
                minima = signatures(hashes, bounds[full], bands * ROWS)
                key = np.repeat(places[None], len(full), axis=0)
                for r in range(ROWS):
                    key = mix(key + minima[:, r::ROWS])
                ids, low, key = digest(hashes, bounds)[full], packed(minima), key.view(np.int64)
                for i, at in enumerate(full):
                    nodes[at], sig[at], keys[at] = ids[i].tobytes(), low[i].tobytes(), key[i]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), pa.array(sig, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=[id_col, "th", "n_shingles", "digest", "sig", "bands"])

    return docs.select(id_col, text, F.xxhash64(text).alias("th")).mapInArrow(run, schema)


def likely(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """Of pairs (u, v) those whose sizes allow the similarity and whose estimate does not rule it out."""
    n, least = bands_for(num / den) * ROWS, least_estimate(num / den, bands_for(num / den) * ROWS)
    side = lambda c: classes.select(F.col("node").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("sig").alias(f"s_{c}")).hint("merge")
    both = pairs.join(side("u"), "u").join(side("v"), "v").filter(F.least("n_u", "n_v") * den >= F.greatest("n_u", "n_v") * num)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for c in ("s_u", "s_v"))
                yield batch.filter(pa.array(estimate(a, b, n) >= least)).select(["u", "v"])

    return both.mapInArrow(run, "u long, v long")


def unsettled(members: DataFrame) -> DataFrame:
    """Members (key, node, label, ..) of keys with several labels, with m and probe: not of the key's commonest label.

    Counts are made per key and label first, so a key with very many members is partially aggregated.
    """
    counted = members.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    keys = counted.groupBy("key").agg(F.max(F.struct("n", "label")).alias("most"), F.sum("n").alias("m"), F.count(F.lit(1)).alias("labels")).filter("labels > 1")
    keys = keys.select("key", "m", F.col("most.label").alias("main"), (F.col("m") - F.col("most.n")).alias("probes"))
    return join_apart(members, keys, "key").withColumn("probe", F.col("label") != F.col("main")).drop("main")


def dealt(members: DataFrame, part: int) -> DataFrame:
    """Deals members (key, node, m, probes, probe) to tasks so that each probe meets all members of its key: columns group, key, asks.

    A key of at most `part` members is whole in one group, with other keys, about PER_TASK rows in all. A greater one is cut
    into parts of about that size by a hash of the node, and its probes into parts of their own; every part of probes meets
    every part in a group. Members that are no probes travel once a part of probes, so few probes cost little in a great key.
    asks says whether the row is there as a probe; a probe is in each group of its own part as both.
    """
    total = members.count()
    parts, asking = (F.ceil(F.col(c) / part).cast("int") for c in ("m", "probes"))
    own = F.col("m") <= part
    place = lambda salt, n: F.pmod(F.xxhash64("node", F.lit(salt)), n).cast("int")
    # (i, j): part of probes, part of all
    as_one = F.transform(F.sequence(F.lit(0), F.greatest(asking, F.lit(1)) - 1), lambda i: F.struct(i.alias("i"), place(1, parts).alias("j"), F.lit(False).alias("asks")))
    as_probe = F.transform(F.sequence(F.lit(0), parts - 1), lambda j: F.struct(place(2, F.greatest(asking, F.lit(1))).alias("i"), j.alias("j"), F.lit(True).alias("asks")))
    none = F.filter(as_one, lambda x: F.lit(False))
    spread = members.withColumn("x", F.explode(F.concat(as_one, F.when(F.col("probe"), as_probe).otherwise(none)))).select(*members.columns, "x.i", "x.j", "x.asks")
    return spread.withColumn("group", F.when(own, F.pmod(F.xxhash64("key"), F.lit(blocks(total, PER_TASK)))).otherwise(F.xxhash64("key", "i", "j")))


def forest(asking: np.ndarray, label: np.ndarray, linked) -> list[tuple[int, int]]:
    """Edges that join what is connected with the asking among 0..n-1; linked(x, others) says which of others x is linked with.

    A member is only compared with those that are not connected with it yet, by their labels or by edges found before.
    """
    label, edges = label.copy(), []
    for x in asking:
        others = np.flatnonzero(label != label[x])
        if len(others):
            hit = others[linked(x, others)]
            if len(hit):
                found, first = np.unique(label[hit], return_index=True)
                edges += [(int(x), int(y)) for y in hit[first]]
                label[np.isin(label, found)] = label[x]
    return edges


def met(group: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each (key, i, j) of a group: the positions of its members, one a node, which of them ask, and their labels."""
    label, node, asks = pd.factorize(group["label"])[0], pd.factorize(group["node"])[0], group["asks"].to_numpy()
    for at in group.groupby(["key", "i", "j"], sort=False).indices.values():
        own, first, back = np.unique(node[at], return_index=True, return_inverse=True)
        asking = np.bincount(back, asks[at], len(own)) > 0
        yield at[first], np.flatnonzero(asking), label[at[first]]


def likely_edges(members: DataFrame, num: int, den: int) -> DataFrame:
    """(u, v): what sizes and estimate allow to be linked across the labels of a bucket, one edge for each label that a probe reaches."""
    n, least = bands_for(num / den) * ROWS, least_estimate(num / den, bands_for(num / den) * ROWS)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        node, size, out = group["node"].to_numpy(), group["n_shingles"].to_numpy(), []
        sig = np.frombuffer(b"".join(group["sig"]), np.uint64).reshape(len(group), -1)
        for at, asking, label in met(group):
            s, z = size[at], sig[at]

            def linked(x, others, s=s, z=z):
                return (np.minimum(s[others], s[x]) * den >= np.maximum(s[others], s[x]) * num) & (estimate(z[others], z[x], n) >= least)

            out += [(node[at[x]], node[at[y]]) for x, y in forest(asking, label, linked)]
        return pd.DataFrame(out, columns=["u", "v"])

    return dealt(members, SIGNATURES).groupBy("group").applyInPandas(run, "u long, v long")


def with_sets(members: DataFrame, docs: DataFrame, size: int, id_col: str, text: str) -> DataFrame:
    """members (key, copies, node, digest, sig, and at and th, id and text hash of one of its rows) with the full set of each node.

    Texts come by an equi-join on id and hash; a text whose set is not the node's is passed over.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).withColumn("own", F.xxhash64("text"))
    texts = rows.join(members.hint("merge"), F.col("id").eqNullSafe(F.col("at")) & (F.col("own") == F.col("th"))).select("key", "copies", "node", "sig", "digest", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunked(batches):
            hashes, bounds = distinct_by_row(*shingles(Words(batch.column("text")), size), batch.num_rows)
            own = np.array([d.tobytes() == n for d, n in zip(digest(hashes, bounds), batch.column("digest").to_pylist(), strict=True)], bool)
            sets = pa.array([hashes[bounds[r] : bounds[r + 1]].tobytes() for r in range(len(own))], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], sets], names=["key", "copies", "node", "sig", "set"]).filter(pa.array(own))

    return texts.mapInArrow(run, "key long, copies long, node long, sig binary, set binary").dropDuplicates(["node"])


def verified_edges(members: DataFrame, num: int, den: int) -> DataFrame:
    """(u, v): links of full sets with den * intersection >= num * union across the labels of a cluster, one for each label that a
    probe reaches."""
    n, least = bands_for(num / den) * ROWS, least_estimate(num / den, bands_for(num / den) * ROWS)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        node, out = group["node"].to_numpy(), []
        sig = np.frombuffer(b"".join(group["sig"]), np.uint64).reshape(len(group), -1)
        sets = [np.frombuffer(x, np.uint64) for x in group["set"]]
        size = np.array([len(x) for x in sets])
        for at, asking, label in met(group):
            s, z, own = size[at], sig[at], [sets[i] for i in at]

            def linked(x, others, s=s, z=z, own=own):
                hit = (np.minimum(s[others], s[x]) * den >= np.maximum(s[others], s[x]) * num) & (estimate(z[others], z[x], n) >= least)
                test = np.flatnonzero(hit)
                if len(test):
                    all_ = np.concatenate([own[others[t]] for t in test])
                    place = np.minimum(np.searchsorted(own[x], all_), len(own[x]) - 1)
                    starts = np.cumsum(s[others[test]]) - s[others[test]]
                    common = np.add.reduceat(own[x][place] == all_, starts, dtype=np.int64)
                    hit[test] = den * common >= num * (s[others[test]] + s[x] - common)
                return hit

            out += [(node[at[x]], node[at[y]]) for x, y in forest(asking, label, linked)]
        return pd.DataFrame(out, columns=["u", "v"])

    return members.groupBy("group").applyInPandas(run, "u long, v long")


def linked_members(members: DataFrame, num: int, den: int) -> DataFrame:
    """(node, label) of the components of the links within each cluster of members (key, copies, node, sig, set).

    First all members of a part of SETS meet each other and their cluster's commonest member, so a cluster travels once. What
    a cluster falls into then meets again, all but its greatest component as probes; most clusters need no second round.
    """
    sized = members.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.max(F.struct("copies", "node")).alias("rep")).select("key", "m", F.col("rep.node").alias("rep"))
    held = materialize(join_apart(members, sized, "key"), "clusters")
    parts = F.ceil(F.col("m") / SETS).cast("int")
    own = F.array(F.pmod(F.xxhash64("node", F.lit(1)), parts).cast("int"))
    j = F.explode(F.when(F.col("node") == F.col("rep"), F.sequence(F.lit(0), parts - 1)).otherwise(own))
    first = held.withColumn("j", j).withColumns({"i": F.lit(0), "asks": F.lit(True), "label": F.col("node")})
    first = first.withColumn("group", F.when(F.col("m") <= SETS, F.pmod(F.xxhash64("key"), F.lit(blocks(held.count(), SETS)))).otherwise(F.xxhash64("key", "j")))
    near = materialize(verified_edges(first, num, den), "links")
    labels = components(near)
    again = held.filter(F.col("m") > SETS).select("key", "node", "sig", "set").join(labels.hint("merge"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    rest = materialize(unsettled(again), "unsettled")
    return components(as_edges(labels).unionByName(verified_edges(dealt(rest, SETS), num, den)))


def near_duplicates(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, th (hash of the text), n_shingles, component_id (least id that is reachable) and kept (the id is its component's) of every row.

    All rows of a component's least id are kept, if their texts differ too. Of rows without an id those are kept that are first in their
    component.

    See components_of for what is linked.
    """
    out = components_of(docs, size, num, den, id_col, text)
    return out.select(id_col, "th", "n_shingles", "component_id", F.when(F.col(id_col).isNull(), F.col("leads")).otherwise(F.col(id_col) == F.col("component_id")).alias("kept"))


def components_of(docs: DataFrame, size: int, num: int, den: int, id_col: str, text: str) -> DataFrame:
    """id, th, n_shingles, component_id and leads (the row has the id and the text of its component's first row) of every row.

    Two texts are linked if their sets of distinct `size`-word shingles (A-Z lower-cased) have a Jaccard similarity of num/den or
    more; a text with fewer words is one shingle; null texts and texts without words are linked with nothing. Rows with equal
    sets become one class first, so copies cost nothing further. Classes meet in buckets of ROWS minima; the number of bands
    keeps the chance to miss a pair at the threshold at LOSS. Likely pairs are those that the collision-corrected estimate from
    packed low bits does not rule out (SIGMAS standard deviations below the threshold): each class against its bucket's
    commonest first, then, in buckets that this leaves in several components, those outside the greatest against all, in
    parts. The components of likely pairs are then searched on full sets in the same way. Both searches yield an edge for each
    component that a member reaches, never all pairs of a group. Full sets are sets of 64-bit hashes of shingles, and sets are
    equal if 128 bits of them are. Null ids count as no id: such a row takes its class's least id. Repeated rows are in one
    class; an empty table gives no rows; other columns are ignored.
    """
    rows = materialize(sketch(docs, size, num / den, id_col, text), "sketch")
    heads = [F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("at"), "th")).alias("head"), F.min(F.struct(F.col(id_col).alias("at"), "th")).alias("rep")]
    grouped = rows.filter("digest is not null").groupBy("digest").agg(*heads, F.count(F.lit(1)).alias("copies"), F.first(F.struct("n_shingles", "sig", "bands")).alias("x"))
    # numbered as they are written: from here on a class is a long
    classes = materialize(grouped.select(F.monotonically_increasing_id().alias("node"), "digest", "head", "rep", "copies", "x.*"), "classes")
    entries = classes.select("node", "copies", F.explode("bands").alias("key"))
    buckets = entries.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.max(F.struct("copies", "node")).alias("rep")).filter("m > 1").select("key", "m", F.col("rep.node").alias("rep"))
    members = materialize(join_apart(entries, buckets, "key").select("key", "node", "m", "rep"), "members")
    stars = members.filter(F.col("node") != F.col("rep")).select(F.least("node", "rep").alias("u"), F.greatest("node", "rep").alias("v")).distinct()
    near = materialize(likely(stars, classes, num, den), "likely")
    labels = components(near)
    labelled = members.filter("m > 2").select("key", "node").join(labels.hint("merge"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    across = materialize(unsettled(labelled).join(classes.select("node", "n_shingles", "sig").hint("merge"), "node"), "open")
    clusters = components(as_edges(labels).unionByName(likely_edges(across, num, den))).withColumnRenamed("label", "key")
    asked = clusters.join(classes.select("node", "digest", "copies", "rep.at", "rep.th", "sig").hint("merge"), "node")
    full = materialize(with_sets(asked, docs, size, id_col, text), "sets")
    final = linked_members(full, num, den)
    least = final.join(classes.select("node", "head").hint("merge"), "node").groupBy("label").agg(F.min("head").alias("first"))
    of_node = classes.select("node", "digest", "head").join(final.join(least.hint("merge"), "label").select("node", "first").hint("merge"), "node", "left").select("digest", F.coalesce("first", "head").alias("first"))
    # stored, so that the join below has an exchange of its own on either side, which the engine can split for a set of very many copies
    named = materialize(of_node, "named")
    out = rows.select(id_col, "th", "n_shingles", "digest").join(named.hint("merge"), "digest", "left").withColumn("component_id", F.coalesce("first.at", id_col))
    first = F.col("first").isNull() | (F.col(id_col).eqNullSafe(F.col("first.at")) & (F.col("th") == F.col("first.th")))
    return out.select(id_col, "th", "n_shingles", "component_id", first.alias("leads"))


def drop_near_duplicates(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The row of docs that leads its component, one of each; of rows equal in id and text one stays.

    Of the latter it is the one whose other columns come first as JSON. Other columns may have any names.
    """
    names = {n: free_name(docs, n) for n in ("own", "fate_id", "fate_th", "n", "place")}
    found = components_of(docs, size, num, den, id_col, text).withColumnRenamed("leads", "kept")
    fates = found.groupBy(F.col(id_col).alias(names["fate_id"]), F.col("th").alias(names["fate_th"])).agg(F.bool_or("kept").alias("kept"), F.count(F.lit(1)).alias(names["n"])).filter(~F.col("kept") | (F.col(names["n"]) > 1))
    fates = materialize(fates, "fates")
    keyed = docs.withColumn(names["own"], F.xxhash64(text))
    same = F.col(id_col).eqNullSafe(F.col(names["fate_id"])) & (F.col(names["own"]) == F.col(names["fate_th"]))
    single = keyed.join(fates.hint("merge"), same, "left_anti").drop(names["own"])
    several = fates.filter("kept").drop("kept")
    if several.isEmpty():
        return single
    own = keyed.join(several.hint("merge"), same)
    place = F.row_number().over(Window.partitionBy(names["fate_id"], names["fate_th"]).orderBy(F.to_json(F.struct(*docs.columns))))
    return single.unionByName(own.withColumn(names["place"], place).filter(F.col(names["place"]) == 1).select(*docs.columns))
