"""Document facts from paragraphs, lines, pages and glyphs."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docaudit.functions.text import clean_font_name, is_chapter, is_upper, non_blank_lines, numbered_heading, points_to_cm, points_to_mm, strip, token_count, without_number, word_count
from docaudit.operators.numbering import free_name
from docaudit.plans.profiles import HEADING_LINE, INTRODUCTION, INTRODUCTION_TEXT, MAIN_PART, TITLE_PAGE, TITLE_WORDS_PAGES, TITLE_WORDS_PARAGRAPHS

PARAGRAPHS = "doc_id string, para_num int, text string, style_name string, runs array<struct<bold:boolean,font_name:string,size_pt:double>>, line_spacing double, first_line_indent_cm double"
SECTIONS = "doc_id string, section_num int, left_mm double, right_mm double, top_mm double, bottom_mm double"
PAGES = "doc_id string, page_num int, text string, width double, height double"
CHARS = "doc_id string, page_num int, char_num int, text string, fontname string, size double, x0 double, x1 double, y0 double, y1 double"


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with further columns that are computed once a row: the optimiser does not copy what comes out of an unfolded array."""
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def lines_of(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """(keys, pos, line): stripped lines that are not blank, numbered from 0."""
    return docs.select(*keys, F.posexplode_outer(non_blank_lines(F.col(text))).alias("pos", "line")).filter("line is not null")


def mode_first_seen(rows: DataFrame, keys: list[str], value: str, position: str | Column, name: str) -> DataFrame:
    """The commonest value of each key, of equally common ones the one seen first; nulls do not count.

    Counts are made per key and value first, so a key with very many rows is partially aggregated by its values.
    """
    place = F.col(position) if isinstance(position, str) else position
    counted = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"), F.min(place).alias("__at"))
    # the least of (-count, place): places may be structs, which have no negative
    return counted.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("__n"), F.col("__at"))).alias(name))


def ordered_distinct(rows: DataFrame, keys: list[str], value: str, position: str, name: str) -> DataFrame:
    """Distinct values of each key as an array in the order first seen."""
    first = rows.groupBy(*keys, value).agg(F.min(position).alias("at"))
    return first.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col("at"), F.col(value).alias("v")))), lambda x: x["v"]).alias(name))


def text_heading(line: Column) -> Column:
    """What of a heading shows in plain text: short and in capitals, or numbered."""
    return ((F.char_length(line) < 50) & is_upper(line)) | numbered_heading(line)


def capture(rows: DataFrame, keys: list[str], position: str, on: Column, off: Column) -> DataFrame:
    """Rows inside captured stretches: `on` switches capture on (its row counts), else `off` switches it off."""
    window = Window.partitionBy(*keys).orderBy(position).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    state = F.last(F.when(on, True).when(off, False), ignorenulls=True).over(window)
    on_now = free_name(rows, "on_now")
    return rows.withColumn(on_now, state).filter(F.coalesce(on_now, F.lit(False))).drop(on_now)


def introduction_of(text: Column, pattern: str = INTRODUCTION_TEXT, fallback: int = 1000) -> Column:
    """What stands between an introduction's mark and the next heading, in lower case; without a mark the first characters."""
    low = F.lower(text)
    return F.when(low.rlike(pattern), strip(F.regexp_extract(low, pattern, 2))).otherwise(F.substring(text, 1, fallback))


def gaps_descending(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Differences of neighbouring distinct values, from above."""
    window = Window.partitionBy(*keys).orderBy(F.desc(value))
    return rows.select(*keys, value).distinct().withColumn("gap", F.col(value) - F.lead(value).over(window)).filter("gap is not null")


def anchored_groups(items: Column, distance, threshold: Column) -> Column:
    """Folds a sorted array to the first items of groups: an item starts one if it is over the threshold from the last start."""
    start = F.filter(items, lambda x: F.lit(False))
    step = lambda acc, x: F.when((F.size(acc) == 0) | (distance(F.element_at(acc, -1), x) > threshold), F.concat(acc, F.array(x))).otherwise(acc)
    return F.aggregate(items, start, step)


def anchored_starts(rows: DataFrame, key: str, value: str, tie: str, threshold: int) -> DataFrame:
    """(key, tie) of the rows that start a group: in the order of value and tie, a row over `threshold` past the last start.

    Keys are dealt out and sorted by the engine, which spills; a task then walks its rows batch by batch and remembers one
    start, so a key of any size takes constant memory. From one start to the next it jumps by binary search. value is a
    long; rows without a key, value or tie are left out; an empty table gives no rows.
    """
    sorted_ = rows.select(key, value, tie).dropna().repartition(key).sortWithinPartitions(key, value, tie)
    types = dict(sorted_.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, anchor = None, 0
        for batch in batches:
            keys, values = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy()
            bounds = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]]) if len(keys) else np.zeros(1, int)
            starts = []
            for a, b in zip(bounds, bounds[1:], strict=False):
                if last_key is None or keys[a] != last_key:
                    last_key, anchor = keys[a], values[a]
                    starts.append(a)
                at = a + int(np.searchsorted(values[a:b], anchor + threshold, "right"))
                while at < b:
                    anchor = values[at]
                    starts.append(at)
                    at = a + int(np.searchsorted(values[a:b], anchor + threshold, "right"))
            yield batch.take(pa.array(starts, pa.int64())).select([key, tie])

    return sorted_.mapInArrow(run, f"`{key}` {types[key]}, `{tie}` {types[tie]}")


def paragraph_facts(paragraphs: DataFrame, sections: DataFrame) -> DataFrame:
    """Facts of documents given as paragraphs and sections (DOCX).

    Documents have as many pages as sections; those without a section have no facts, those without paragraphs empty ones. Blank and
    null paragraphs count for nothing but their number; paragraphs that repeat with their number count each.
    """
    key = ["doc_id"]
    rows = paragraphs.withColumn("bare", strip(F.coalesce("text", F.lit("")))).filter("bare <> ''")
    low = F.lower("bare")
    bold = F.exists(F.coalesce("runs", F.array().cast("array<struct<bold:boolean,font_name:string,size_pt:double>>")), lambda r: F.coalesce(r["bold"], F.lit(False)))
    heading = F.coalesce(F.startswith(F.col("style_name"), F.lit("Heading")), F.lit(False)) | bold | text_heading(F.col("bare"))
    rows = rows.withColumns({"low": low, "heading": heading, "clean": strip(without_number(low))})
    titled = F.lit(False)
    for word in TITLE_WORDS_PARAGRAPHS:
        titled = titled | F.contains(F.col("low"), F.lit(word))
    title = rows.filter((F.col("para_num") < 50) & titled).select("doc_id", (F.col("para_num") + 0.5).alias("at"), F.lit(TITLE_PAGE).alias("element"))
    heads = rows.filter("heading").select("doc_id", F.col("para_num").cast("double").alias("at"), F.col("clean").alias("element"))
    elements = ordered_distinct(heads.unionByName(title), key, "element", "at", "elements")
    # introductions and texts are read off the same window and grouping
    state = F.last(F.when(F.contains(F.col("low"), F.lit(INTRODUCTION)), True).when(F.col("heading") & (F.col("clean") != INTRODUCTION), False), ignorenulls=True)
    rows = rows.withColumn("in_intro", F.coalesce(state.over(Window.partitionBy(*key).orderBy("para_num").rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(False)))
    joined = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(c)), lambda x: x["bare"]), " ")
    text = rows.groupBy(*key).agg(
        F.concat(joined(F.struct("para_num", "bare")), F.lit(" ")).alias("full_text"), joined(F.when(F.col("in_intro"), F.struct("para_num", "bare"))).alias("introduction_text"),
        F.sum(word_count(F.col("bare"))).cast("int").alias("word_count"), F.bool_or(F.col("heading") & is_chapter(F.col("bare"))).alias("has_chapters"),
    )
    # modes of all four properties in one grouping: (property, value) first, then the commonest of each
    no_runs = F.array().cast("array<struct<bold:boolean,font_name:string,size_pt:double>>")
    seen = lambda kind, name, number, i: F.struct(F.lit(kind).alias("kind"), name.alias("name"), number.cast("double").alias("number"), F.struct("para_num", i.cast("int").alias("run_num")).alias("at"))
    none, first = F.lit(None), F.lit(0)
    of_runs = F.flatten(F.transform(F.coalesce("runs", no_runs), lambda r, i: F.array(seen("font_family", F.nullif(r["font_name"], F.lit("")), none, i), seen("size", none.cast("string"), F.nullif(r["size_pt"], F.lit(0.0)), i))))
    own = F.array(seen("spacing", none.cast("string"), F.nullif(F.col("line_spacing"), F.lit(0.0)), first), seen("indent", none.cast("string"), F.when(F.col("first_line_indent_cm") > 0, F.col("first_line_indent_cm")), first))
    values = rows.select("doc_id", F.inline(F.concat(of_runs, own))).filter("name is not null or number is not null")
    counted = values.groupBy(*key, "kind", "name", "number").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("at"))
    best = lambda kind, c: F.min_by(F.when(F.col("kind") == kind, F.col(c)), F.when(F.col("kind") == kind, F.struct(-F.col("n"), F.col("at")))).alias(kind)
    modes = counted.groupBy(*key).agg(best("font_family", "name"), best("size", "number"), best("spacing", "number"), best("indent", "number"))
    margin = lambda c: F.bround(F.nullif(F.col(c), F.lit(0.0)), 1).alias(c.removesuffix("_mm"))
    page = sections.groupBy(*key).agg(F.count(F.lit(1)).cast("int").alias("page_count"), F.min_by(F.struct(*[margin(c) for c in ("left_mm", "right_mm", "top_mm", "bottom_mm")]), "section_num").alias("page_margins"))
    out = page
    for part in (text, elements, modes):
        out = out.join(part, key, "left")
    found = F.coalesce("elements", F.array().cast("array<string>"))
    return out.select(
        "doc_id", F.when(F.col("has_chapters"), F.array_append(found, F.lit(MAIN_PART))).otherwise(found).alias("required_elements"),
        F.struct("font_family", F.bround("size", 0).cast("int").alias("font_size"), F.bround("spacing", 1).alias("line_spacing")).alias("font_settings"), "page_margins",
        F.bround("indent", 2).alias("paragraph_indent"), F.coalesce("introduction_text", F.lit("")).alias("introduction_text"), F.coalesce("full_text", F.lit("")).alias("full_text"), "page_count", F.coalesce("word_count", F.lit(0)).alias("word_count"),
    )


#: Rows of pages and glyphs in one table: kind 0 is a page, kind 1 a glyph of it.
PAGE_ROWS = "doc_id, page_num, kind, char_num, text, fontname, size, x0, x1, y0, y1, page_text, width, height"


def page_rows(pages: DataFrame, chars: DataFrame) -> DataFrame:
    """Pages and their glyphs as one table (PAGE_ROWS)."""
    none = lambda *names: [F.lit(None).cast(t).alias(n) for n, t in names]
    numbers = [(n, "double") for n in ("size", "x0", "x1", "y0", "y1")]
    own = pages.select("doc_id", "page_num", F.lit(0).alias("kind"), *none(("char_num", "int"), ("text", "string"), ("fontname", "string"), *numbers), F.col("text").alias("page_text"), "width", "height")
    return own.unionByName(chars.select("doc_id", "page_num", F.lit(1).alias("kind"), "char_num", "text", "fontname", *[n for n, _ in numbers], *none(("page_text", "string"), ("width", "double"), ("height", "double"))))


def page_facts(pages: DataFrame, chars: DataFrame) -> DataFrame:
    """Facts of documents given as pages and glyphs (PDF); see facts_of_page_rows."""
    return facts_of_page_rows(page_rows(pages, chars))


_COUNTED = "array<struct<v:{0},n:bigint,at:int>>"
_WALKED = f"page_num int, avg_size double, big array<string>, fonts {_COUNTED.format('string')}, sizes {_COUNTED.format('double')}, gap_sum double, gap_n bigint, first_x double, x0 double, x1 double, y0 double, y1 double, page_text string, width double, height double"


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _line_starts(page: np.ndarray, first: np.ndarray, y: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Which glyphs start a line: those over `limit` from the last start of their page. Pages side by side, a glyph of each at a time."""
    sizes = np.diff(np.append(first, len(page)))
    order = np.argsort(-sizes, kind="stable")
    anchor, starts = y[first].copy(), np.zeros(len(page), bool)
    starts[first] = True
    for t in range(1, int(sizes.max(initial=0))):
        of = order[: np.searchsorted(-sizes[order], -t, "left")]
        at = first[of] + t
        new = np.abs(anchor[of] - y[at]) > limit[of]
        starts[at[new]] = True
        anchor[of[new]] = y[at[new]]
    return starts


def _listed(values: pa.Array, n: np.ndarray, at: np.ndarray | None, page: np.ndarray, pages: int) -> pa.Array:
    """Values (of sorted pages) as a list a page, with their counts and places if there are any."""
    bounds = pa.array(np.searchsorted(page, np.arange(pages + 1)).astype(np.int32))
    if at is None:
        return pa.ListArray.from_arrays(bounds, values)
    return pa.ListArray.from_arrays(bounds, pa.StructArray.from_arrays([values, pa.array(n.astype(np.int64)), pa.array(at.astype(np.int32))], ["v", "n", "at"]))


def _walk(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A row for each page of whole pages, which are sorted by document, page, kind and place; glyphs without a page row are left out."""
    columns = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
    kind = columns["kind"].to_numpy()
    doc = columns["doc_id"].dictionary_encode().indices.to_numpy(zero_copy_only=False)
    number = columns["page_num"].to_numpy(zero_copy_only=False)
    heads = _runs(doc, number)
    page = np.zeros(len(kind), np.int64)
    page[heads[1:]] = 1
    page = np.cumsum(page)
    n_pages = len(heads)
    is_page = kind[heads] == 0
    glyph = np.flatnonzero(kind == 1)
    of = page[glyph]
    number_of = lambda name: columns[name].to_numpy(zero_copy_only=False).astype(np.float64)[glyph]
    filled = lambda name: np.nan_to_num(number_of(name), nan=0.0)
    size, x0 = filled("size"), number_of("x0")
    many = np.bincount(of, minlength=n_pages)
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = np.bincount(of, size, n_pages) / many
    texts = columns["text"].dictionary_encode()
    text = texts.indices.fill_null(-1).to_numpy(zero_copy_only=False)[glyph]
    # distinct texts of glyphs that are larger than the rest
    large = np.flatnonzero((size > mean[of] + 1) & (text >= 0))
    pair = np.unique(np.stack([of[large], text[large]]), axis=1) if len(large) else np.zeros((2, 0), np.int64)
    big = _listed(texts.dictionary.take(pa.array(pair[1])), pair[0], None, pair[0], n_pages)

    ink = columns["ink"].fill_null(False).to_numpy(zero_copy_only=False)[glyph].astype(bool)
    place = columns["char_num"].fill_null(0).to_numpy(zero_copy_only=False)[glyph]

    def counted(name: str) -> pa.Array:
        coded = columns[name].dictionary_encode()
        code = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)[glyph]
        use = np.flatnonzero(ink & (code >= 0))
        order = use[np.lexsort((place[use], code[use], of[use]))]
        at = _runs(of[order], code[order]) if len(order) else np.zeros(0, np.int64)
        n = np.diff(np.append(at, len(order)))
        return _listed(coded.dictionary.take(pa.array(code[order[at]])), n, place[order[at]], of[order[at]], n_pages)

    # gaps of distinct heights, from above
    y = filled("rounded_y0")
    order = np.lexsort((-y, of))
    order = order[_runs(of[order], y[order])] if len(order) else order
    gap, same = y[order[:-1]] - y[order[1:]], of[order[:-1]] == of[order[1:]]
    own = mean[of[order[:-1]]]
    usual = same & (gap > 0.5 * own) & (gap < 3 * own)
    gap_of = of[order[:-1]][usual]
    # first glyphs of lines
    y1, left = filled("y1"), filled("x0")
    order = np.lexsort((size, left, -y1, of))
    first = np.searchsorted(of[order], np.arange(n_pages))[many > 0]
    starts = _line_starts(of[order], first, -y1[order], 0.5 * mean[many > 0]) if len(order) else np.zeros(0, bool)
    start = order[starts]
    start = start[size[start] <= mean[of[start]] + 1]
    with np.errstate(invalid="ignore", divide="ignore"):
        first_x = np.bincount(of[start], left[start], n_pages) / np.bincount(of[start], minlength=n_pages)

    def extreme(name: str, least: bool, use: np.ndarray) -> pa.Array:
        v = number_of(name)
        use = use & ~np.isnan(v)
        out = np.full(n_pages, np.inf if least else -np.inf)
        (np.minimum if least else np.maximum).at(out, of[use], v[use])
        return pa.array(out, mask=np.isinf(out))

    every = np.ones(len(glyph), bool)
    head = pa.array(heads)
    rows = [
        columns["doc_id"].take(head), columns["page_num"].take(head), pa.array(mean, mask=np.isnan(mean)), big, counted("font"), counted("rounded_size"), pa.array(np.bincount(gap_of, gap[usual], n_pages).astype(np.float64)), pa.array(np.bincount(gap_of, minlength=n_pages).astype(np.int64)),
        pa.array(first_x, mask=np.isnan(first_x)), extreme("x0", True, ink), extreme("x1", False, ink), extreme("y0", True, every), extreme("y1", False, every), *[columns[c].take(head) for c in ("page_text", "width", "height")],
    ]
    names = ["doc_id", *[c.split(" ")[0] for c in _WALKED.replace("array<struct<v:string,n:bigint,at:int>>", "a").replace("array<struct<v:double,n:bigint,at:int>>", "a").split(", ")]]
    return pa.RecordBatch.from_arrays(rows, names=names).filter(pa.array(is_page))


def _whole_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches that end where a page ends; the rows of the last page wait for the next batch."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if waiting and all(batch.column(c)[batch.num_rows - 1] == waiting[0].column(c)[0] for c in (0, 1)):
            waiting.append(batch)  # still the same page
            continue
        table = pa.Table.from_batches([*waiting, batch]).combine_chunks().to_batches()[0] if waiting else batch
        doc, number = (table.column(c) for c in (0, 1))
        n = table.num_rows
        cut = n - 1
        while cut > 0 and doc[cut - 1] == doc[n - 1] and number[cut - 1] == number[n - 1]:
            cut -= 1
        if cut:
            yield table.slice(0, cut)
        waiting = [table.slice(cut)]
    if waiting:
        yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]


def _commonest(entries: Column, kind: str) -> Column:
    """Of (v, n, at) in any order, several a value: the value with the greatest sum of n, of equal ones that with the least at."""
    empty = f"struct<v:{kind},n:bigint,at:struct<page:int,at:int>>"
    start = F.struct(F.lit(None).cast(empty).alias("now"), F.lit(None).cast(empty).alias("best"))
    better = lambda a, b: F.when(b.isNull() | (a["n"] > b["n"]) | ((a["n"] == b["n"]) & (a["at"] < b["at"])), a).otherwise(b)

    def step(acc: Column, x: Column) -> Column:
        same = F.coalesce(acc["now"]["v"] == x["v"], F.lit(False))
        now = F.when(same, F.struct(x["v"].alias("v"), (acc["now"]["n"] + x["n"]).alias("n"), acc["now"]["at"].alias("at"))).otherwise(F.struct(x["v"].alias("v"), x["n"].alias("n"), x["at"].alias("at")))
        return F.struct(now.alias("now"), F.when(same | acc["now"].isNull(), acc["best"]).otherwise(better(acc["now"], acc["best"])).alias("best"))

    return F.aggregate(F.array_sort(entries), start, step, lambda acc: F.when(acc["now"].isNull(), F.lit(None)).otherwise(better(acc["now"], acc["best"])["v"]))


#: Rows that a task sorts; of larger tables there are more tasks, not larger ones.
ROWS_PER_TASK = 1 << 18


def dealt(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """n rows dealt out by keys, to the session's shuffle partitions or, where these would get more than ROWS_PER_TASK, to as many as it takes."""
    tasks = -(-n // ROWS_PER_TASK)
    return rows.repartition(tasks, *keys) if tasks > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows.repartition(*keys)


def facts_of_page_rows(rows: DataFrame, by_document: bool = False, n_rows: int = 0) -> DataFrame:
    """Facts of documents given as rows of pages and glyphs (PAGE_ROWS).

    Rows are dealt by page and sorted by the engine, which spills; a task then walks them page by page and leaves a row a page. One
    grouping gathers a document's pages. With by_document, rows are taken to be dealt by document already and are only sorted. n_rows says
    about how many rows there are, if that is known: tasks then stay of one size (see dealt).
    A page's glyphs are in memory at once, never more. A page may come several times: its first row counts. Glyphs of pages that
    have no row, and rows without a document or page number, are left out; documents without pages have no facts; pages
    without glyphs have only their text.
    """
    usable = rows.filter(F.col("doc_id").isNotNull() & F.col("page_num").isNotNull())
    ink = strip(F.coalesce("text", F.lit(""))) != ""
    glyphs = usable.select(
        "doc_id", "page_num", "kind", "char_num", "text", ink.alias("ink"), F.nullif(clean_font_name(F.col("fontname")), F.lit("")).alias("font"), "size", F.nullif(F.bround(F.coalesce("size", F.lit(0.0)), 1), F.lit(0.0)).alias("rounded_size"),
        "x0", "x1", "y0", "y1", F.bround(F.coalesce("y0", F.lit(0.0)), 1).alias("rounded_y0"), "page_text", F.col("width").cast("double").alias("width"), F.col("height").cast("double").alias("height"),
    )
    placed_rows = glyphs if by_document else dealt(glyphs, n_rows, "doc_id", "page_num")
    walked = placed_rows.sortWithinPartitions("doc_id", "page_num", "kind", "char_num").mapInArrow(lambda batches: map(_walk, _whole_pages(batches)), f"doc_id {dict(rows.dtypes)['doc_id']}, {_WALKED}")
    text = F.coalesce("page_text", F.lit(""))
    lines = F.transform(non_blank_lines(text), lambda x: F.struct(x.alias("line"), F.lower(x).alias("low")))
    heads = F.filter(lines, lambda x: x["low"].rlike(HEADING_LINE) | F.exists(F.col("big"), lambda g: F.contains(x["line"], g)))
    titled = F.lit(False)
    for word in TITLE_WORDS_PAGES:
        titled = titled | F.contains(F.lower("page_text"), F.lit(word))
    title = F.when((F.col("page_num") == 1) & titled, F.array(F.struct(F.lit(TITLE_PAGE).alias("element"), F.lit(False).alias("chapter"))))
    named = F.transform(heads, lambda x: F.struct(without_number(x["low"]).alias("element"), is_chapter(x["line"]).alias("chapter")))
    placed = lambda c: F.transform(c, lambda x: F.struct(x["v"].alias("v"), F.struct(F.col("page_num").alias("page"), x["at"].alias("at")).alias("at"), x["n"].alias("n")))
    pages = walked.select(
        "doc_id", F.struct("page_num", text.alias("t"), F.concat(named, F.coalesce(title, F.array().cast("array<struct<element:string,chapter:boolean>>"))).alias("heads"), placed("fonts").alias("fonts"), placed("sizes").alias("sizes")).alias("page"),
        "page_num", token_count(text).alias("words"), "gap_sum", "gap_n", "first_x", "x0", "x1", "y0", "y1", F.struct("width", "height").alias("paper"),
    )
    of = (dealt(pages, n_rows, "doc_id") if n_rows else pages).groupBy("doc_id").agg(
        F.sort_array(F.collect_list("page")).alias("pages"), F.count(F.lit(1)).cast("int").alias("page_count"), F.sum("words").cast("int").alias("word_count"), F.min_by("paper", "page_num").alias("paper"),
        (F.sum("gap_sum") / F.nullif(F.sum("gap_n"), F.lit(0))).alias("gap"), F.avg("first_x").alias("first_x"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"),
    )
    of = once(of, heads=F.flatten("pages.heads"), font_family=_commonest(F.flatten("pages.fonts"), "string"), modal_size=_commonest(F.flatten("pages.sizes"), "double"), full_text=F.array_join(F.transform("pages.t", lambda t: F.concat(t, F.lit(" "))), ""))
    # the first occurrence of each element says whether it is a chapter
    ranked = F.array_sort(F.transform("heads", lambda h, i: F.struct(h["element"].alias("element"), i.alias("i"), h["chapter"].alias("chapter"))))
    of = once(of, ranked=ranked)
    chapters = F.exists(F.transform("ranked", lambda h, i: h["chapter"] & ~F.coalesce(F.get("ranked", i - 1)["element"] == h["element"], F.lit(False))), lambda c: c)
    found = F.array_distinct("heads.element")
    width, height = F.coalesce("paper.width", F.lit(595.0)), F.coalesce("paper.height", F.lit(842.0))
    positive = lambda c: F.greatest(F.bround(points_to_mm(c), 1), F.lit(0.0))
    return of.select(
        "doc_id", F.when(chapters, F.array_append(found, F.lit(MAIN_PART))).otherwise(found).alias("required_elements"),
        F.struct("font_family", F.bround("modal_size", 0).cast("int").alias("font_size"), F.bround(F.col("gap") / F.coalesce("modal_size", F.lit(14.0)), 1).alias("line_spacing")).alias("font_settings"),
        F.struct(positive(F.col("x0")).alias("left"), positive(width - F.col("x1")).alias("right"), positive(height - F.col("y1")).alias("top"), positive(F.col("y0")).alias("bottom")).alias("page_margins"),
        F.bround(points_to_cm(F.col("first_x") - F.col("x0")), 2).alias("paragraph_indent"), introduction_of(F.col("full_text")).alias("introduction_text"), "full_text", "page_count", "word_count",
    )


#: Facts of plain texts that rules can name.
CORPUS_FIELDS = ("full_text", "lang", "origin", "elements", "line_count", "word_count")


def corpus_facts(docs: DataFrame, fields: Iterable[str] = CORPUS_FIELDS) -> DataFrame:
    """doc_id and these facts of plain texts, row by row: no shuffle at all.

    Only facts that are asked for are computed, and lines and first words once a row, however often rules use them.
    """
    wanted = set(fields)
    rows = docs
    if wanted & {"elements", "line_count"}:
        rows = once(rows, lines=non_blank_lines(F.col("text")))
    if "elements" in wanted:
        rows = once(rows, elements=F.array_distinct(F.transform("lines", lambda x: F.lower(F.split(x, r"\s+", 2)[0]))))
    if "word_count" in wanted:
        rows = once(rows, word_count=word_count(F.col("text")))
    made = {
        "full_text": lambda: F.col("text"), "lang": lambda: F.col("lang"), "origin": lambda: F.struct("lang", "source"), "elements": lambda: F.col("elements"),
        "line_count": lambda: F.size("lines").cast("long"), "word_count": lambda: F.col("word_count"),
    }
    return rows.select("doc_id", *[make().alias(name) for name, make in made.items() if name in wanted])
