"""Secret scans: keyword automaton, anchored expressions near its hits, checksum validation."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame

# Kinds in the order that breaks ties, the base expressions, and least lengths.
KINDS = ("assign", "access", "hex", "github_token", "npm_token")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
CHECKED_PREFIXES = {"ghp_": 3, "gho_": 3, "ghu_": 3, "ghs_": 3, "ghr_": 3, "npm_": 4}
CHECKED = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
LEAST_ASSIGN, LEAST_ACCESS = 8, 16


@cache
def automaton():
    """All spellings of the assignment words in either case, and the case-bound prefixes; built once a worker."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for word in ASSIGN_WORDS:
        for spelling in product(*({c, c.upper()} for c in word)):
            a.add_word("".join(spelling), (0, len(word)))
    a.add_word("AKIA", (1, 4))
    for prefix, kind in CHECKED_PREFIXES.items():
        a.add_word(prefix, (kind, 4))
    a.make_automaton()
    return a


def base62_crc(payload: str) -> str:
    """The six base-62 digits of a payload's CRC-32 that such tokens end with."""
    n, out = zlib.crc32(payload.encode()), ""
    for _ in range(6):
        n, digit = divmod(n, 62)
        out = BASE62[digit] + out
    return out


def scan(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of each span of a text in code points, by start and then kind."""
    text = text or ""
    found, reached = [], [0] * len(KINDS)
    for last, (kind, width) in automaton().iter(text):
        start = last - width + 1
        if start < reached[kind]:
            continue  # inside the match before: leftmost matches do not overlap
        hit = (ASSIGN if kind == 0 else ACCESS if kind == 1 else CHECKED).match(text, start)
        if not hit:
            continue
        reached[kind] = hit.end()
        if kind == 0:
            valid = len(hit[2]) >= LEAST_ASSIGN
        elif kind == 1:
            valid = len(hit[0]) >= LEAST_ACCESS
        else:
            valid = base62_crc(hit[1]) == hit[2]
        if valid:
            found.append((start, kind, hit.end()))
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


SCHEMA = "n_assign long, n_access long, n_hex long, n_checked long, base_sha256 string, spans string"


def find_secrets(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per input row: keys, counts by kind, a digest of the base spans, and all spans.

    Words of an assignment and fixed prefixes are found by an Aho-Corasick automaton over the whole text; expressions are only
    tried anchored at its hits, which gives the leftmost non-overlapping matches as each expression starts with its keyword.
    Runs of hex digits have no keyword and are found as maximal runs. Tokens of the kinds github_token and npm_token count
    only if their embedded CRC-32 holds. Narrow: no shuffle, and a row's work is linear in its text. Null and empty texts give
    zero counts and empty spans; repeated rows are scanned each; other columns are ignored, whatever their names.
    """
    schema = ", ".join(f"{k} {dict(docs.dtypes)[k]}" for k in keys) + ", " + SCHEMA

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for value in batch.column(len(keys)):
                spans = scan(value.as_py())
                base = [s for s in spans if s[1] < 3]
                kinds = [k for _, k, _ in spans]
                row = (kinds.count(0), kinds.count(1), kinds.count(2), kinds.count(3) + kinds.count(4), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans))
                for column, cell in zip(out, row, strict=True):
                    column.append(cell)
            types = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *(pa.array(c, t) for c, t in zip(out, types, strict=True))], names=[*keys, *(s.split()[0] for s in SCHEMA.split(", "))])

    return docs.select(*keys, text).mapInArrow(run, schema)
