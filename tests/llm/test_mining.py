"""Hard negatives, phrase collocations and quality rules against brute force, and on odd rows."""

import collections
import itertools
import math
import random
import re
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docaudit.llm import negatives, phrases, quality

rnd = random.Random(5)
CASE = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


# Hard negatives

VECTORS = "vec_id long, embedding array<float>, label int, v string, row long, score double"


def brute_negatives(rows, factor=4):
    own = [(i, [math.floor(factor * x) for x in v], (label + 1) % 10 if i % 7 == 0 else label) for i, v, label in rows if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for n, (i, v, label) in enumerate(own):
        if i % 10:
            continue
        rest = [(-dot(v, w), j, m, other) for m, (j, w, other) in enumerate(own) if m != n and len(w) == len(v)]
        positives = sorted((s, j, m) for s, j, m, other in rest if other == label)[:5]
        for s, j, _ in positives:
            near = sorted((t, k) for t, k, _, other in rest if other != label and 30 * -s <= 100 * -t <= 90 * -s)[:10]
            out += [(i, j, r, k, -s, -t) for r, (t, k) in enumerate(near, 1)]
    return sorted(out)


def found_negatives(spark, rows, monkeypatch, factor=4):
    monkeypatch.setattr(negatives, "CANDIDATES_PER_BLOCK", 7)
    monkeypatch.setattr(negatives, "ANCHORS_PER_BLOCK", 2)
    df = spark.createDataFrame([(i, v, label, "x", 1, 0.5) for i, v, label in rows], VECTORS)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("long")
    out = negatives.hard_negatives(df, F.col("vec_id") % 10 == 0, label, factor=factor)
    return sorted(tuple(r) for r in out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def test_negatives_equal_brute_force(spark, monkeypatch):
    vector = lambda: [rnd.uniform(-1, 2) for _ in range(4)]
    rows = [(i, vector(), rnd.randrange(3)) for i in range(60)]
    rows += [(70, rows[3][1], 1), (70, rows[3][1], 1), (71, rows[3][1], 0), (72, rows[3][1], 0)]  # ties and rows that repeat
    rows += [(80, None, 1), (81, [], 1), (82, [1.0, None, 1.0, 1.0], 1), (83, [math.nan] * 4, 1), (84, [math.inf] * 4, 1), (85, vector(), None), (None, vector(), 1), (90, [1.0, 2.0], 1), (91, [1.0, 1.0], 1), (92, [0.5, 1.0], 2), (100, vector(), 9)]
    expected = brute_negatives(rows)
    assert len(expected) > 50
    assert found_negatives(spark, rows, monkeypatch) == expected


def test_negatives_of_nothing_and_of_large_numbers(spark, monkeypatch):
    assert found_negatives(spark, [], monkeypatch) == []
    large = [(i, [2.0**30 + i, 1.0], i % 2) for i in range(1, 13)]
    assert found_negatives(spark, [(10, [2.0**30, 1.0], 0), *large], monkeypatch, factor=1) == brute_negatives([(10, [2.0**30, 1.0], 0), *large], factor=1)


def test_first_of_keeps_all_ties():
    scores = np.array([[5, 5, 5, 1, 5]])
    assert negatives.first_of(scores, np.array([[False, True, True, True, True]]), 2)[1].tolist() == [1, 2]
    assert negatives.first_of(scores, np.zeros((1, 5), bool), 2)[1].tolist() == []


# Phrase collocations


def brute_collocations(rows, max_n=3, least=10, top=2000, share=50):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(CASE)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n["und" if lang is None else lang] += len(words)
            for size in range(1, max_n + 1):
                f["und" if lang is None else lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        best = []
        for p, a in candidates.items():
            inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: B023, E731
            if any(len(q) > len(p) and 100 * b >= share * a and inside(q) for q, b in candidates.items()):
                continue
            score, _, left, right = min((math.floor(Fraction(1000000 * a * a, counts[p[:k]] * counts[p[k:]])), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            best.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, rank, p.decode(), -a, left, right, n[lang], -s) for rank, (s, a, p, left, right) in enumerate(sorted(best)[:top], 1)]
    return sorted(out)


def phrase_frame(spark, rows):
    return spark.createDataFrame([(i, t, g, "s", 1, 2, 3, 4) for i, (t, g) in enumerate(rows)], "doc_id long, text string, lang string, phrase string, f long, n long, size int, rank long")


def found_collocations(spark, rows, **options):
    out = phrases.collocations(phrase_frame(spark, rows), **options)
    return sorted(tuple(r) for r in out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def mixed_text(n):
    words = ["New", "new", "York", "city", "the", "é", "É", "a b", "x y", "of", "the.", "of,", "the the", "\t", "\n", "end!", "ﬁ"]
    return " ".join(rnd.choice(words) for _ in range(n))


PHRASES = [(mixed_text(120), rnd.choice(["en", "fr", None, "und", ""])) for _ in range(60)] + [(None, "en"), ("", "en"), (" \n", "xx"), ("the " * 3000, "en"), ("a b c " * 40, "fr"), ("one two three four " * 12, "fr")]


@pytest.mark.parametrize("max_n", [2, 3, 4])
def test_collocations_equal_brute_force(spark, max_n):
    expected = brute_collocations(PHRASES, max_n)
    assert len(expected) > 40
    assert found_collocations(spark, PHRASES, max_n=max_n) == expected


def test_collocations_with_a_full_filter_and_small_chunks(spark, monkeypatch):
    monkeypatch.setattr(phrases, "CHUNK", 200)
    monkeypatch.setattr(phrases, "FILTER_BITS", 15)
    assert found_collocations(spark, PHRASES, top=7, min_count=12) == brute_collocations(PHRASES, least=12, top=7)


def test_collocations_of_nothing(spark):
    assert found_collocations(spark, []) == []
    assert found_collocations(spark, [("one two", "en"), (None, None)]) == []


def test_scores_beyond_64_bits():
    a = 3_000_000_000_000
    assert 1000000 * a * a > 1 << 63  # what the decimals of `collocations` have to hold
    assert len(str(1000000 * (10**15) ** 2)) <= 38


def test_ranks_over_many_buckets(spark):
    rows = [("k", rnd.randrange(50), f"p{i}") for i in range(500)]
    df = spark.createDataFrame(rows, "key string, score long, phrase string").repartition(7)
    out = phrases.ranked(df, ["key"], [F.desc("score"), F.asc("phrase")], 9, "phrase")
    assert [(r.score, r.phrase) for r in out.orderBy("rank").collect()] == [(s, p) for _, s, p in sorted(rows, key=lambda x: (-x[1], x[2]))[:9]]


# Quality rules


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times, covered = collections.Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            covered.update(range(i, i + 8))
    lines, seen, repeated = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(covered)


def odd_text():
    parts = ["a", "b", "é", "#*", "\n", "\n\n", " ", "\t", "x1", "Content here.", "\r", "a b c d e f g h", " ", "|<>&"]
    return "".join(rnd.choice(parts) + rnd.choice(["", " "]) for _ in range(rnd.randrange(0, 60)))


def test_counts_equal_plain_ones():
    texts = [odd_text() for _ in range(300)] + [None, "", "\n", "a", "a\na\na", "a \na", "w " * 5000, "\na\n\na\n"]
    found = quality.Lines(pa.array(texts, pa.string())).counts()
    got = list(zip(*(found[c].tolist() for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), strict=True))
    assert got == [brute_counts(t) for t in texts]


def test_lines_have_their_places():
    lines = quality.Lines(pa.array(["a\n\n b \n", None, "c", "\n\nd"]))
    assert (lines.row.tolist(), lines.places().tolist()) == ([0, 0, 2, 3], [0, 2, 0, 2])
    assert len(lines.features()) == 4 and int(lines.features().max()).bit_length() <= quality.N_FEATURES


def chain_of(seed):
    g = np.random.default_rng(seed)
    return quality.Chain(g.normal(size=(quality.N_FEATURES, 2)), g.normal(size=(2, 2)))


def test_labels_and_probabilities_equal_all_paths():
    chain, g = chain_of(1), np.random.default_rng(2)
    bits = g.integers(0, 1 << quality.N_FEATURES, 17)
    bounds = np.array([0, 5, 5, 6, 14, 17])
    score = quality.unpacked(bits) @ chain.weights
    labels, (p, pairs, total) = chain.decode(bits, bounds), chain.marginals(score, bounds)
    all_pairs, all_total = np.zeros((2, 2)), 0.0
    for a, b in zip(bounds, bounds[1:]):
        if a == b:
            continue
        paths = list(itertools.product((0, 1), repeat=b - a))
        value = lambda path: sum(score[a + i, y] for i, y in enumerate(path)) + sum(chain.steps[x, y] for x, y in zip(path, path[1:]))  # noqa: B023, E731
        weight = np.exp([value(x) for x in paths])
        assert labels[a:b].tolist() == list(max(paths, key=value))
        for i in range(b - a):
            assert np.isclose(p[a + i, 1], sum(w for x, w in zip(paths, weight) if x[i]) / weight.sum())
        for x, w in zip(paths, weight):
            for y in zip(x, x[1:]):
                all_pairs[y] += w / weight.sum()
        all_total += math.log(weight.sum())
    assert np.allclose(pairs, all_pairs) and np.isclose(total, all_total)


def test_equally_likely_labels_are_content():
    chain = quality.Chain(np.zeros((quality.N_FEATURES, 2)), np.zeros((2, 2)))
    assert chain.decode(np.ones(4, np.int64), np.array([0, 3, 4])).tolist() == [0, 0, 0, 0]


PROSE = "the of and in to a is on was re er th an".split()
GOOD = lambda: "\n".join(" ".join(rnd.choice(PROSE) for _ in range(rnd.randrange(15, 40))).capitalize() + "." for _ in range(5))
JUNK = lambda: "\n".join(" ".join(rnd.choice(PROSE) + "%%%" for _ in range(rnd.randrange(15, 40))) for _ in range(5))


def quality_frames(spark, rows, labels):
    docs = spark.createDataFrame([(i, t, 7, "s", 0.5) for i, t in rows], "doc_id long, text string, kept long, n_words string, content_share double")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int")


def test_quality_tells_junk_from_prose(spark):
    rows = [(i, GOOD() if i % 2 else JUNK()) for i in range(80)] + [(100, GOOD() + "\n" + JUNK().split("\n")[0]), (101, JUNK() + "\n" + GOOD().split("\n")[0]), (102, None), (103, ""), (104, "few words"), (105, (GOOD() + "\n") * 400), (106, GOOD()), (106, JUNK()), (None, GOOD())]
    docs, labels = quality_frames(spark, rows, [(i, i % 2) for i in range(60)] + [(61, None), (62, 7), (63, 0), (63, 1), (None, 1), (200, 1)])
    out = quality.quality(docs, labels).collect()
    assert len(out) == len(rows)
    verdict = {}
    for r in out:
        verdict.setdefault(r.doc_id, []).append(r)
    assert all(verdict[i][0].kept == (i % 2 == 1) for i in range(60, 80))
    assert verdict[100][0].kept and verdict[100][0].boilerplate == [5] and not verdict[101][0].kept
    assert [(r.n_words, r.base_failed, r.content_share, r.kept) for i in (102, 103) for r in verdict[i]] == [(0, True, 0.0, False)] * 2
    assert verdict[104][0].base_failed and verdict[105][0].base_failed and verdict[105][0].n_dup_lines == 1995
    assert sorted(r.kept for r in verdict[106]) == [False, True] and verdict[None][0].kept


def test_quality_without_labels_or_rows(spark):
    docs, labels = quality_frames(spark, [(1, JUNK()), (2, GOOD())], [])
    assert all(r.kept and r.content_share == 1.0 for r in quality.quality(docs, labels).collect())
    none, some = quality_frames(spark, [], [(1, 0), (2, 1)])
    assert quality.quality(none, some).count() == 0
    assert quality.quality(docs.withColumnRenamed("kept", "other"), some, ["doc_id", "other"]).columns[:2] == ["doc_id", "other"]
