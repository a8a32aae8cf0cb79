"""Near-duplicate lines by a segment-partition edit join, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit.llm.graph import as_edges, components
from docaudit.llm.storage import discard, free_name, join_apart, materialize

#: Edits between near-duplicate lines; lines of fewer than least_chars(edits) characters are compared for equality only.
MAX_EDITS = 1
#: Longs that the bits of indexed segments are kept in.
SIFT_WORDS = 1 << 18
#: Characters that end a chunk: every tenth or so of Latin and Cyrillic prose.
CHUNK_ENDS = "[bfgkmpvwyz.,ф-я、-。]"
#: Lengths in a bucket; lines within as many edits of its end are in the next one as well.
LENGTHS = 16
#: Letters whose counts are held against each other before the texts are.
COUNTED = "etanoris"
#: Characters from which on the banded columns are cheaper than the built-in distance, which walks over all of both lines.
BANDED_FROM = 2000
#: Lines of a hot key in a part that meets other parts in a task of its own.
LINES_A_PART = 1024
#: (least characters, edits): edits by the length of the shorter line, one more for every 100 characters, up to 4.
BY_LENGTH = ((0, 1), (100, 2), (200, 3), (300, 4))


def segment(length: Column, i: Column, k: Column) -> tuple[Column, Column]:
    """Start (from 1) and length of segment i of k in a line of that length; the last ones are one longer if it doesn't divide."""
    base, longer = F.floor(length / k), length % k
    extra = F.greatest(F.lit(0), i - (k - longer))
    return (1 + i * base + extra).cast("int"), (base + (i >= k - longer).cast("int")).cast("int")


def probes(edits: int) -> list[tuple[int, int, int]]:
    """(d, i, shift): the line's own segments, and the substrings of it that can equal a segment of a line that is up to `edits`
    shorter or as long.

    Segment i can have moved by at most i places if all edits so far lie before it and by edits - i from the other end, so only
    those places are probed (with d, the difference in length, on the right). All lie within lines of least_chars or more.
    """
    k = edits + 1
    return [(d, i, shift) for d in range(k) for i in range(k) for shift in range(max(-i, d - (edits - i)), min(i, d + edits - i) + 1)]


def length_classes(edits: int | Sequence[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(least characters, characters that are too many, edits) of each class of shorter lines, from the first that allows edits."""
    steps = [(0, edits)] if isinstance(edits, int) else list(edits)
    steps[0] = (max(steps[0][0], least_chars(steps[0][1])), steps[0][1])
    if any(lo < least_chars(e) for lo, e in steps) or steps != sorted(steps):
        raise ValueError("classes must ascend and begin at least_chars of their edits or more")
    return [(lo, hi, e) for (lo, e), hi in zip(steps, [*(lo for lo, _ in steps[1:]), 1 << 30], strict=True)]


def chunk_keys(line: Column) -> Column:
    """Hashes of a line's distinct chunks, the longest first: it is cut after every character of CHUNK_ENDS. An edit adds or takes away
    two chunks at most, as it changes, splits or joins its own."""
    last = F.lit(4095).cast("long")
    ranked = lambda x: F.shiftleft(last - F.least(F.octet_length(x), last), 51).bitwiseOR(F.xxhash64(x).bitwiseAND(F.lit((1 << 51) - 1)))
    return F.sort_array(F.array_distinct(F.transform(F.split(line, CHUNK_ENDS, -1), ranked)))


def line_keys(lines: DataFrame, classes: list[tuple[int, int, int]]) -> DataFrame:
    """h, key, own: keys of which both lines of a pair have one in common.

    Of two lines within e edits neither has more than 2 * e chunks that the other lacks. So if one has more than that many, the first
    2 * e + 1 chunks of both, in any common order, have one in common (own is null). They go with the line's length, in buckets that overlap.
    Lines with fewer chunks, and all of the classes of one edit, have keys of segments too: hashes of (class, segment, indexed length,
    substring). A line probes the classes of all lines that it can be the longer one of a pair with, each only at the lengths of its
    class; own says whether the substring is a segment of the line itself.
    """
    length, edits, cut = F.col("chars"), F.lit(0), F.lit(False)
    for i, (lo, _, _) in enumerate(classes):
        edits = F.when(length >= lo, max(e for _, _, e in classes[: i + 1])).otherwise(edits)
    few, none = F.size("chunks") <= 2 * F.col("edits"), F.array().cast("array<bigint>")
    wanted, probed = [F.slice("chunks", F.lit(1), 2 * F.col("edits") + 1)], []
    for c, (lo, hi, e) in enumerate(classes):
        here = (length >= lo) & (length < hi + e)
        here = here if e == 1 else here & few
        own = [{"c": c, "i": i, "d": d, "shift": shift, "k": e + 1, "lo": lo, "hi": hi} for d, i, shift in probes(e)]
        wanted.append(F.when(here, F.lit([-1 - len(probed) - n for n in range(len(own))]).cast("array<bigint>")).otherwise(none))
        cut, probed = cut | here, probed + own
    # chunks and the encoded line are computed once a line; four bytes a character, so that a substring is found where it is
    rows = lines.filter(length >= classes[0][0]).select("h", "chars", "line", edits.alias("edits"))
    rows = rows.select(*rows.columns, F.when(F.col("edits") > 1, chunk_keys(F.col("line"))).otherwise(none).alias("chunks"))
    rows = rows.select("h", "chars", "edits", F.when(cut, F.encode("line", "UTF-32")).alias("wide"), F.concat(*wanted).alias("wanted"))
    # rows of longs, chunks as they are and probes as negative numbers, so that what comes after is compiled, in methods of a size that is
    # compiled again; outer, as the engine would else look for empty lists first, and compute the chunks again for that
    rows = rows.select("h", "chars", "edits", "wide", F.explode_outer("wanted").alias("x"))
    low, high = F.expr(f"chars div {LENGTHS}"), F.expr(f"(chars + edits) div {LENGTHS}")
    table = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in p.items()]) for p in probed])
    p, chunk = F.col("p"), F.col("x") >= 0
    rows = rows.select("h", "chars", "wide", "x", F.when(chunk & (low != high), F.array(low, high)).otherwise(F.array(low)).alias("buckets"), F.when(~chunk, F.get(table, (-1 - F.col("x")).cast("int"))).alias("p"))
    rows = rows.select("h", "wide", "x", "p", (F.col("chars") - p["d"]).alias("indexed"), F.explode("buckets").alias("bucket"))
    rows = rows.filter(chunk | ((F.col("indexed") >= p["lo"]) & (F.col("indexed") < p["hi"])))
    start, size = segment(F.col("indexed"), p["i"], p["k"])
    key = F.xxhash64(p["c"], p["i"], "indexed", F.col("wide").substr(4 * (start + p["shift"] - 1) + 1, 4 * size))
    return rows.select("h", F.when(chunk, F.xxhash64("x", "bucket")).otherwise(key).alias("key"), F.when(~chunk, (p["d"] == 0) & (p["shift"] == 0)).alias("own"))


def bits_of(keys: DataFrame) -> DataFrame:
    """A column of longs called key as bits of SIFT_WORDS longs in rows of 64, a table of that size at most, whatever the corpus."""
    known = F.map_from_entries(F.collect_list(F.struct(F.pmod("word", F.lit(64)).cast("int").alias("i"), "bits")))
    words = keys.groupBy(F.pmod("key", F.lit(SIFT_WORDS)).alias("word")).agg(F.bit_or(bit_of(F.col("key"))).alias("bits"))
    rows = words.groupBy(F.shiftright("word", 6).alias("row")).agg(known.alias("known"))
    return rows.select("row", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.coalesce(F.try_element_at("known", i), F.lit(0).cast("long"))).alias("bits"))


def bit_of(key: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(key, 32), F.lit(64)).cast("int"))


def passing(rows: DataFrame, bits: DataFrame, key: str = "key") -> DataFrame:
    """The rows whose key may be among those of bits_of, which go to all tasks. Bits that keys share, more of them the more keys there are,
    let further rows through, which then meet nobody."""
    word = F.pmod(F.col(key), F.lit(SIFT_WORDS))
    joined = rows.withColumn("row", F.shiftright(word, 6)).join(F.broadcast(bits), "row")
    return joined.filter(F.get("bits", F.pmod(word, F.lit(64)).cast("int")).bitwiseAND(bit_of(F.col(key))) != 0).drop("row", "bits")


def sifted(keyed: DataFrame) -> DataFrame:
    """Of keys of segments those that may be a line's own segment's: both lines of a pair have a key that is a segment of the shorter one."""
    return passing(keyed, bits_of(keyed.filter("own").select("key"))).select("h", "key")


def least_chars(edits: int) -> int:
    return (edits + 1) * (edits + 2)


def parity(line: Column) -> Column:
    """A bit for each of 64 groups of pairs of neighbouring characters: whether the line has an odd number of them. An edit changes four
    pairs at most."""
    chars = F.split(line, "")
    code = lambda c: F.coalesce(F.ascii(c), F.lit(0))
    groups = F.zip_with(chars, F.slice(chars, 2, F.greatest(F.size(chars) - 1, F.lit(0))), lambda x, y: (code(x) * 31 + code(y)) % 64)
    return F.aggregate(groups, F.lit(0).cast("long"), lambda bits, g: bits.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), g)))


def letter_counts(line: Column) -> Column:
    """How often the line has each of COUNTED, up to 255, a byte each."""
    counts = F.lit(0).cast("long")
    for i, letter in enumerate(COUNTED):
        n = F.least(F.char_length(line) - F.char_length(F.replace(line, F.lit(letter), F.lit(""))), F.lit(255)).cast("long")
        counts = counts.bitwiseOR(F.shiftleft(n, 8 * i))
    return counts


def counts_apart(a: Column, b: Column) -> Column:
    """Sum of the differences of two letter_counts: two for an edit at most."""
    count = lambda c, i: F.shiftrightunsigned(c, 8 * i).bitwiseAND(F.lit(255))
    out = F.lit(0).cast("long")
    for i in range(len(COUNTED)):
        out = out + F.abs(count(a, i) - count(b, i))
    return out


def with_parities(lines: DataFrame) -> DataFrame:
    """The numbered lines without their texts, with 128 parities of pairs of neighbouring characters as even and odd: a bit for each group of
    pairs, whether the line has an odd number of them, in one pass over rows of pairs. An edit changes four pairs at most."""
    own = [c for c in lines.columns if c != "line"]
    pairs = lines.select(*own, F.encode("line", "UTF-32").alias("wide")).select("*", F.explode(F.sequence(F.lit(1), F.greatest(F.col("chars") - 1, F.lit(1)))).alias("i"))
    grouped = pairs.select(*own, F.xxhash64(F.col("wide").substr(4 * F.col("i") - 3, F.lit(8))).alias("group"))
    bit, odd = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("group", F.lit(64)).cast("int")), F.shiftright("group", 6).bitwiseAND(F.lit(1)) == 1
    side = lambda mine: F.bit_xor(F.when(mine, bit).otherwise(F.lit(0).cast("long")))
    return grouped.groupBy(*own).agg(side(~odd).alias("even"), side(odd).alias("odd"))


def banded_distance(a: Column, b: Column, edits: int) -> Column:
    """Edit distance of two lines if it is at most edits, else something greater, by bit-parallel columns of 2 * edits + 1 rows.

    Bit d of a word is the row j - edits + d of column j. vp and vn are the rows' vertical differences; the score is followed
    down the lowest diagonal of the band, on rows past the end of a that match nothing, whose differences are taken off last.
    """
    width = 2 * edits + 1
    full = (1 << width) - 1
    band = lambda c: c.bitwiseAND(F.lit(full))
    flip = lambda c: band(F.bitwise_not(c))
    word = lambda n: F.lit(n).cast("long")
    once = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))  # noqa: E731  f of a value that is computed once

    def of_characters(c: Column) -> Column:
        x, y = c["x"], c["y"]

        def column(state: Column, j: Column) -> Column:
            def matched(pm: Column) -> Column:
                vp, vn = state["vp"], state["vn"]
                return once(band((pm.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(pm).bitwiseOR(vn), lambda d0: moved(d0, vp, vn))

            def moved(d0: Column, vp: Column, vn: Column) -> Column:
                hp, hn, down = vn.bitwiseOR(flip(d0.bitwiseOR(vp))), d0.bitwiseAND(vp), F.shiftrightunsigned(d0, 1)
                return F.struct(
                    band(hn.bitwiseOR(flip(down.bitwiseOR(hp)))).alias("vp"),
                    down.bitwiseAND(hp).alias("vn"),
                    (state["score"] + (d0.bitwiseAND(F.lit(1 << (width - 1))) == 0).cast("int")).alias("score"),
                )

            own, match = F.get(y, j - 1), word(0)
            for d in range(width):
                match = match + F.when(F.get(x, j - edits + d - 1) == own, word(1 << d)).otherwise(word(0))
            return once(match, matched)

        first = F.struct(word(full & ~((1 << edits) - 1)).alias("vp"), word(0).alias("vn"), F.lit(edits).alias("score"))
        past = F.size(x) - F.size(y) + edits  # bits of rows past the end of a
        mask = word(1 << (width - 1)) - F.call_function("shiftleft", word(1), past)
        last = lambda s: s["score"] - F.bit_count(s["vp"].bitwiseAND(mask)) + F.bit_count(s["vn"].bitwiseAND(mask))
        return once(F.aggregate(F.sequence(F.lit(1), F.size(y)), first, column), last)

    far = F.abs(F.char_length(a) - F.char_length(b)) > edits
    return F.when(far, F.lit(edits + 1)).otherwise(once(F.struct(F.split(a, "").alias("x"), F.split(b, "").alias("y")), of_characters))


def line_classes(docs: DataFrame, edits: int | Sequence[tuple[int, int]] = MAX_EDITS, min_chars: int | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, th (hash of the text), line_no, class_id, class_line_no and kept of every line that is not empty (of at least min_chars characters, if given).

    A class is a set of lines joined by chains of at most `edits` edits, which may be steps by the length of the shorter line as
    in BY_LENGTH; equal lines are one, and lines of fewer than least_chars(edits) characters are in a class with their equals only. Its first line (by id, then number from 0) is kept,
    and names it. Empty (or shorter) lines, and lines of null texts, are in no class. Null ids come first; rows that
    repeat with their id share their lines' fate; an empty table gives no rows; other columns are ignored.

    Lines are cut at line feeds. Lines meet under keys of their chunks and segments (line_keys), in one grouping with partial minima and maxima; only keys
    under which different lines meet are looked at again, and only lines with such a key leave their documents, as far as tables of bits can tell. Each line is held against the commonest line of its key, and, where
    that leaves several components under a key, those outside the greatest against the others, in parts within the join itself.
    Pairs are compared by parities, lengths and counts of letters first, within the join; only what these leave gets its texts, and only confirmed links leave
    the joins. Joins of all lines are sort-merge joins at every size.
    """
    classes = length_classes(edits)
    least, most = classes[0][0], max(e for _, _, e in classes)
    if min_chars is not None and min_chars < least:
        raise ValueError(f"min_chars must be {least} or more for {edits} edits")
    whole = docs.filter(F.col(text).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), F.split(F.col(text), "\n", -1).alias("parts"))
    rows = whole.select("id", "th", F.posexplode_outer("parts").alias("line_no", "line")).withColumn("chars", F.char_length("line"))
    lines = rows.filter(F.col("chars") >= (min_chars or 1)).withColumn("h", F.xxhash64("line"))
    occurrences = lines.select("id", "th", "line_no", "h", F.xxhash64(F.lit(1), "line").alias("g"))
    long = lines.filter(F.col("chars") >= least)
    keys = materialize(line_keys(long, classes), "keys", clean=True)
    keyed = keys.filter("own is null").select("h", "key").unionByName(sifted(keys.filter("own is not null")))
    shared = keyed.groupBy("key").agg(F.min("h").alias("a"), F.max("h").alias("b")).filter("a <> b").select("key")
    shared = materialize(shared, "shared", clean=True)
    # counted by the complement of the key, so that the join's partitions need not stay whole
    members = join_apart(passing(keyed, bits_of(shared)), shared, "key").groupBy(F.bitwise_not(F.col("key")).alias("key"), "h").agg(F.count(F.lit(1)).alias("copies"))
    members = materialize(members, "members", clean=True)
    discard(keys)
    discard(shared)
    nodes = members.select("h").distinct()
    # only lines that may be asked for leave their documents, once from each task
    likely_lines = passing(lines.select("h", "line"), bits_of(nodes.select(F.col("h").alias("key"))), "h")
    texts = likely_lines.select("h", F.xxhash64(F.lit(1), "line").alias("g"), "line").distinct().join(nodes.hint("merge"), "h")
    texts = materialize(texts.withColumns({"counts": letter_counts(F.col("line")), "chars": F.char_length("line")}).withColumn("node", F.monotonically_increasing_id()), "lines", clean=True)  # numbered as they are written
    marks = materialize(with_parities(texts.drop("g")), "marks", clean=True)

    def allowed(m: Column, n: Column) -> Column:
        out = F.lit(0)
        for lo, _, e in classes:
            out = F.when(F.least(m, n) >= lo, e).otherwise(out)
        return out

    def likely(a: str, b: str) -> Column:
        """Whether the parities, lengths and counts of letters of two lines let them be near."""
        p, q, m, n = (F.col(f"{c}_{side}") for c in ("p", "c") for side in (a, b))
        odd = sum(F.bit_count(F.col(f"{c}_{a}").bitwiseXOR(F.col(f"{c}_{b}"))) for c in ("even", "odd"))
        return (odd <= 4 * most) & (odd <= 4 * allowed(m, n)) & (F.abs(m - n) <= allowed(m, n)) & (counts_apart(p, q) <= 2 * allowed(m, n))

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Of pairs of nodes (u, v) those whose texts are near."""
        text = lambda c: texts.select(F.col("node").alias(c), F.col("line").alias(f"l_{c}"), F.col("chars").alias(f"c_{c}")).hint("merge")
        a, b, m, n = F.col("l_u"), F.col("l_v"), F.col("c_u"), F.col("c_v")
        banded = (F.bit_count(parity(a).bitwiseXOR(parity(b))) <= 4 * allowed(m, n)) & (banded_distance(a, b, most) <= allowed(m, n))
        plain = F.levenshtein(a, b, most)
        near = F.when(F.least(m, n) >= BANDED_FROM, banded).otherwise(F.pmod(plain, F.lit(1 << 30)) <= allowed(m, n))  # asked once; -1 is far
        return pairs.distinct().join(text("u"), "u").join(text("v"), "v").filter(near).select("u", "v")

    known = lambda c: [F.col("counts").alias(f"p_{c}"), F.col("chars").alias(f"c_{c}"), F.col("even").alias(f"even_{c}"), F.col("odd").alias(f"odd_{c}")]
    side = lambda c, node: marks.select(F.col("h").alias(c), F.col("node").alias(node), *known(c)).hint("merge")
    reps = members.groupBy("key").agg(F.max(F.struct("copies", "h")).alias("rep"), F.count(F.lit(1)).alias("m")).select("key", "m", F.col("rep.h").alias("rep"))
    starred = materialize(join_apart(members, reps, "key").select("key", "m", "rep", "h"), "starred", clean=True)
    discard(members)
    stars = starred.filter("h <> rep").select(F.least("h", "rep").alias("a"), F.greatest("h", "rep").alias("b")).distinct()
    first = confirmed(stars.join(side("a", "u"), "a").join(side("b", "v"), "b").filter(likely("a", "b")).select("u", "v"))
    labels = components(first)
    label = marks.join(labels.hint("merge"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    several = starred.filter("m > 2").select("key", "h").join(label.hint("merge"), "h")
    counted = several.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    open_keys = counted.groupBy("key").agg(F.max(F.struct("n", "label")).alias("most"), F.sum("n").alias("m"), F.count(F.lit(1)).alias("labels")).filter("labels > 1")
    open_keys = open_keys.select("key", F.col("most.label").alias("main"), F.ceil((F.col("m") - F.col("most.n")) / LINES_A_PART).cast("long").alias("asking"), F.ceil(F.col("m") / LINES_A_PART).cast("long").alias("parts"))
    several = materialize(join_apart(several, open_keys, "key"), "open", clean=True)
    # a pair counts under the least key that both lines have, so that lines with much in common make one row
    several = several.join(several.groupBy("node").agg(F.collect_list("key").alias("keys")).hint("merge"), "node")
    # lines outside a key's greatest component against all of the key, in parts that meet in tasks of their own
    place = lambda salt, n: F.pmod(F.xxhash64("node", F.lit(salt)), n)
    probe = F.col("label") != F.col("main")
    left = several.filter(probe).select("key", place(1, F.col("asking")).alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("j"), F.col("node").alias("u"), F.col("label").alias("x"), F.col("keys").alias("keys_u"), *known("a"))
    right = several.select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("asking") - 1)).alias("i"), place(2, F.col("parts")).alias("j"), F.col("node").alias("v"), F.col("label").alias("y"), F.col("keys").alias("keys_v"), *known("b"), probe.alias("asks"))
    once_each = ~F.col("asks") | (F.col("u") < F.col("v"))
    here = F.array_min(F.array_intersect("keys_u", "keys_v")) == F.col("key")
    second = confirmed(left.join(right.hint("merge"), ["key", "i", "j"]).filter(once_each & (F.col("x") != F.col("y")) & likely("a", "b") & here).select("u", "v"))
    found = components(as_edges(labels).unionByName(second))
    named_as = texts.select("node", F.struct("h", "g").alias("line"))
    final = found.join(named_as.hint("merge"), "node").join(named_as.select(F.col("node").alias("label"), F.col("line").alias("head_line")).hint("merge"), "label")
    final = final.select(F.col("line").alias("node"), F.col("head_line").alias("label"))
    named = occurrences.join(final.select(F.col("node.h").alias("h"), F.col("node.g").alias("g"), "label"), ["h", "g"], "left")
    named = materialize(named.select("id", "th", "line_no", F.coalesce("label.h", "h").alias("h"), F.coalesce("label.g", "g").alias("g")), "named", clean=True)
    # stored, so that the join below has an exchange of its own on either side, which the engine can split for a common line
    heads = materialize(named.groupBy("h", "g").agg(F.min(F.struct("id", "line_no")).alias("head")), "heads", clean=True)
    out = named.join(heads, ["h", "g"])
    kept = F.col("id").eqNullSafe(F.col("head.id")) & (F.col("line_no") == F.col("head.line_no"))
    return out.select(F.col("id").alias(id_col), "th", "line_no", F.col("head.id").alias("class_id"), F.col("head.line_no").alias("class_line_no"), kept.alias("kept"))


def drop_repeated_lines(docs: DataFrame, edits: int | Sequence[tuple[int, int]] = MAX_EDITS, min_chars: int | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the text cut down to the lines that are the first of their class or in none, in place.

    A column `lines_removed` says how many went (one of that name is replaced); texts without such lines stay as they are, null
    ones null. Rows that repeat with their id share their lines' fate; an empty table gives no rows; other columns may have any
    names.
    """
    own_id, own_th, own, places = (free_name(docs, n) for n in ("own_id", "own_th", "own", "places"))
    gone = line_classes(docs, edits, min_chars, id_col, text).filter(~F.col("kept")).distinct()
    gone = gone.groupBy(F.col(id_col).alias(own_id), F.col("th").alias(own_th)).agg(F.collect_set("line_no").alias(places))
    keyed = docs.withColumn(own, F.xxhash64(text))
    joined = keyed.join(gone, F.col(id_col).eqNullSafe(F.col(own_id)) & (F.col(own) == F.col(own_th)), "left")
    rest = F.array_join(F.filter(F.split(F.col(text), "\n", -1), lambda x, i: ~F.array_contains(F.col(places), i)), "\n")
    joined = joined.withColumn(text, F.when(F.col(places).isNull(), F.col(text)).otherwise(rest))
    return joined.withColumn("lines_removed", F.coalesce(F.size(places), F.lit(0))).drop(own_id, own_th, own, places)
