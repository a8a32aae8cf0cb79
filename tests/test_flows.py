"""Transactions over several tables, the checking stream and the state machine: planted failures, replays, restarts, odd rows."""

import json
import shutil

import pytest
from pyspark.sql import functions as F

from docaudit.operators import facts as fx
from docaudit.plans.profiles import COMPLIANT, CORPUS, FAILED, LOADED, RETURNED, TRANSITIONS, UNDER_WAY
from docaudit.sources.versions import ConflictError, VersionedTables, with_version
from docaudit.streaming import checks, machine

DOCS = "doc_id long, text string, lang string, source string"
HOUR = 3_600_000_000
BEGIN = 400_000 * HOUR


def documents(spark, ids):
    return spark.createDataFrame([(i, f"The {i}\nsecond line {i}", "en", "src0") for i in ids], DOCS)


def facts(docs):
    return fx.corpus_facts(docs, [r.field for r in CORPUS])


# Transactions


def test_tables_appear_together_or_not_at_all(spark, tmp_path):
    store = VersionedTables(spark, f"file://{tmp_path}/t")
    with store.transaction() as t:
        t.append("a", spark.range(3))
        t.append("b", spark.range(3))
    with pytest.raises(Exception, match="planted"), store.transaction() as t:
        t.append("a", spark.range(3, 6))
        assert t.read("a").count() == 6 and store.read("a").count() == 3
        t.append("b", spark.range(3, 6).select(F.raise_error(F.lit("planted")).cast("long").alias("id")))
    assert store.versions() == [0] and store.read("a").count() == store.read("b").count() == 3
    assert len(list((tmp_path / "t/data").iterdir())) == 1  # what the failed one wrote is gone
    with pytest.raises(LookupError):
        store.read("c")
    with pytest.raises(LookupError):
        store.read("a", 7)


def test_a_failure_just_before_the_rename(spark, tmp_path, monkeypatch):
    store = VersionedTables(spark, f"file://{tmp_path}/t")
    with store.transaction() as t:
        t.overwrite("a", spark.range(3))

    def broken(*_):
        raise OSError("planted")

    monkeypatch.setattr(store._folder, "create", broken)
    with pytest.raises(OSError, match="planted"), store.transaction() as t:
        t.overwrite("a", store.read("a").filter("id > 1"))
    monkeypatch.undo()
    assert store.read("a").count() == 3 and store.versions() == [0]


def test_batches_are_committed_once_and_old_versions_stay(spark, tmp_path):
    store = VersionedTables(spark, f"file://{tmp_path}/t")
    for number in (0, 0, 1, 1, 0):
        with store.transaction("load", number) as t:
            t.append("a", spark.range(number + 1))
    assert store.versions() == [0, 1] and store.snapshot().batches == {"load": 1}
    assert [store.read("a", v).count() for v in (0, 1)] == [1, 3] and with_version(store, "a").count() == 4
    with store.transaction() as t:
        t.overwrite("a", t.read("a").filter("id > 0"))  # made from what it takes the place of
    assert store.read("a").count() == 1
    kept = store.read("a", 1)
    assert kept.count() == 3
    (tmp_path / "t/data/left-by-a-killed-driver").mkdir()
    store.vacuum(keep=1)
    assert store.versions() == [2] and store.read("a").count() == 1 and len(list((tmp_path / "t/data").iterdir())) == 1


def test_of_two_transactions_at_once_one_fails(spark, tmp_path):
    store = VersionedTables(spark, f"file://{tmp_path}/t")
    with pytest.raises(ConflictError), store.transaction() as slow:
        slow.append("a", spark.range(1))
        with VersionedTables(spark, store.root).transaction() as quick:
            quick.append("a", spark.range(2))
    assert store.versions() == [0] and store.read("a").count() == 2


def test_empty_tables_have_versions_too(spark, tmp_path):
    store = VersionedTables(spark, f"file://{tmp_path}/t")
    assert store.versions() == [] and store.snapshot().version == -1
    with store.transaction() as t:
        t.append("a", spark.range(0))
    assert store.read("a").count() == 0


# Checks


def test_a_check_is_stored_whole(spark, tmp_path):
    store, docs = VersionedTables(spark, f"file://{tmp_path}/t"), documents(spark, range(5))
    checks.start(store, docs)
    assert {(r.status, r.score) for r in store.read("documents").collect()} == {(UNDER_WAY, None)}
    assert {r.result for r in store.read("checks").collect()} == {'{"status":"analyzing"}'}
    broken = facts(docs).withColumn("word_count", F.raise_error(F.lit("planted")).cast("long"))
    with pytest.raises(Exception, match="planted"):
        checks.finish(store, broken, CORPUS)
    assert store.versions() == [0]
    checks.finish(store, facts(docs.filter("doc_id < 4")), CORPUS)
    rows = {r.doc_id: (r.status, r.score) for r in store.read("documents").collect()}
    assert rows[4] == (UNDER_WAY, None) and {s for i, (s, _) in rows.items() if i < 4} == {RETURNED}
    results = {r.doc_id: json.loads(r.result) for r in store.read("checks").collect()}
    assert results[0]["total_checks"] == len(CORPUS) and results[4] == {"status": "analyzing"}
    assert store.read("mistakes").filter("doc_id = 0").count() == sum(1 for r in json.loads(store.read("evaluations").filter("doc_id = 0").toJSON().first())["results"] if not r["is_passed"] and r["severity"] != "info")


def test_a_document_is_checked_again(spark, tmp_path):
    store, docs = VersionedTables(spark, f"file://{tmp_path}/t"), documents(spark, range(3))
    for some in (docs, docs.filter("doc_id = 1")):
        with store.transaction() as t:
            t.append("checks", checks.starting_checks(some, 1, "doc_id").withColumn("score", F.lit(None).cast("int")))
            t.overwrite("documents", docs.select("doc_id", F.lit(UNDER_WAY).alias("status"), F.lit(None).cast("int").alias("score")))
        checks.finish(store, facts(some), CORPUS)
    rows = store.read("checks").collect()
    assert len(rows) == 4 and all(json.loads(r.result)["total_checks"] == len(CORPUS) for r in rows)
    assert store.read("evaluations").count() == 4 and store.read("documents").count() == 3


def test_changes_that_repeat_double_no_row(spark):
    from docaudit.operators import relational as rel

    table = spark.createDataFrame([(1, "a", "n"), (1, "b", "n"), (2, "c", "n"), (None, "d", "n")], "k int, v string, new string")
    changes = spark.createDataFrame([(1, "x", ["v"]), (1, "y", ["v"]), (9, "z", ["v"]), (None, "w", ["v"])], "k int, v string, set_columns array<string>")
    for f in (rel.update, rel.update_sparse):
        assert sorted(map(str, f(table, changes, "k", ["v"]).collect())) == sorted(map(str, spark.createDataFrame([(1, "y", "n"), (1, "y", "n"), (2, "c", "n"), (None, "d", "n")], table.schema).collect()))
    assert sorted((r.v, r.name) for r in rel.with_lookup(table, changes, "k", "set_columns", [], "name").select("v", F.array_join("name", "").alias("name")).collect()) == [("a", "v"), ("b", "v"), ("c", ""), ("d", "")]


def stored(store):
    return {name: sorted(store.read(name).drop("checked_at").toJSON().collect()) for name in ("evaluations", "scores", "mistakes")}


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    source, state = f"{tmp_path}/in", f"{tmp_path}/state"
    for i in range(3):
        documents(spark, range(10 * i, 10 * i + 10)).coalesce(1).write.mode("append").parquet(source)
    store = VersionedTables(spark, f"file://{tmp_path}/t")
    go = lambda: checks.check_stream(spark, source, DOCS, facts, CORPUS, store, state, per_batch=1).awaitTermination()
    go()
    once = stored(store)
    assert len(once["scores"]) == 30 and len(store.versions()) == 3
    for kind in ("commits/2", "commits/.2.crc"):  # as if the driver had died after the rows, but before the stream's own note
        (tmp_path / "state" / kind).unlink()
    go()
    assert stored(store) == once and len(store.versions()) == 3
    documents(spark, [77]).write.mode("append").parquet(source)
    go()
    assert len(stored(store)["scores"]) == 31


def test_a_batch_that_fails_halfway_is_run_again(spark, tmp_path, monkeypatch):
    source, state = f"{tmp_path}/in", f"{tmp_path}/state"
    documents(spark, range(10)).coalesce(1).write.parquet(source)
    store = VersionedTables(spark, f"file://{tmp_path}/t")
    whole, planted = checks.mistakes_of, [True]

    def failing(rows, key):
        if planted.pop() if planted else False:
            raise RuntimeError("planted")
        return whole(rows, key)

    monkeypatch.setattr(checks, "mistakes_of", failing)
    go = lambda: checks.check_stream(spark, source, DOCS, facts, CORPUS, store, state).awaitTermination()
    with pytest.raises(Exception, match="planted"):
        go()
    assert store.versions() == []
    go()
    assert store.versions() == [0] and len(stored(store)["scores"]) == 10


# State machine


def brute_machine(rows, timeout, passed):
    out = []
    for key in {r[0] for r in rows}:
        status, since = None, 0
        for at, tie, signal in [*sorted(r[1:] for r in rows if r[0] == key and r[1] // 1000 < passed), (None, None, None)]:
            if status == UNDER_WAY and (since + timeout <= at if at is not None else (since + timeout) // 1000 < passed):
                out.append((key, since + timeout, None, None, UNDER_WAY, FAILED, True))
                status, since = FAILED, since + timeout
            if at is not None:
                legal = signal in TRANSITIONS.get(status or "", ())
                out.append((key, at, tie, signal, status, signal if legal else status, legal))
                status, since = (signal, at) if legal else (status, since)
    return sorted(out, key=repr)


SIGNALS = [LOADED, UNDER_WAY, COMPLIANT, RETURNED, "?"]


def test_machine_over_batches_restarts_and_late_rows(spark, tmp_path):
    schema = "doc long, ts timestamp, event long, signal string"
    rows = [(i % 7, BEGIN + i * HOUR // 3 + i % 2, i, SIGNALS[(i * i + i // 7) % 5]) for i in range(120)] + [(9, BEGIN + HOUR, 500, LOADED), (9, BEGIN + 2 * HOUR, 501, UNDER_WAY)]
    parts = [[r for r in rows if a * HOUR <= r[1] - BEGIN < b * HOUR] for a, b in ((0, 10), (10, 25), (25, 60))]
    parts[1].append((0, BEGIN + HOUR, 900, LOADED))  # hours behind: dropped
    odd = [(None, BEGIN + 26 * HOUR, 901, LOADED), (1, None, 902, LOADED), (1, BEGIN + 26 * HOUR, 903, None)]
    at = f"{tmp_path}/in"

    def land(i, part):
        frame = spark.createDataFrame([(k, e, s, u) for k, u, e, s in part], "doc long, event long, signal string, at long")
        frame.select("doc", F.timestamp_micros("at").alias("ts"), "event", "signal").coalesce(1).write.parquet(f"{tmp_path}/part{i}")
        for f in (tmp_path / f"part{i}").glob("part-*.parquet"):
            (tmp_path / "in").mkdir(exist_ok=True)
            shutil.move(f, tmp_path / "in" / f"{i}.parquet")

    for i, part in enumerate([*parts[:2], parts[2] + odd]):
        land(i, part)
        stream = spark.readStream.schema(schema).parquet(at)  # a new query each time, with the old one's checkpoint
        machine.run_machine(stream, "doc", "ts", "event", "signal", 2 * HOUR, "30 minutes", f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    found = sorted((tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()), key=repr)
    passed = max(r[1] for r in rows) // 1000 - 30 * 60 * 1000
    assert found == brute_machine(rows, 2 * HOUR, passed)
    assert any(r[3] is None for r in found) and any(not r[6] for r in found) and 900 not in {r[2] for r in found}
    assert (9, BEGIN + 4 * HOUR, None, None, UNDER_WAY, FAILED, True) in found  # nothing came for it any more


def test_documents_share_the_state_of_their_group(spark, tmp_path):
    rows = [(f"d{i % 150}", BEGIN + (i * i % 40) * HOUR // 4 + i % 3, i, SIGNALS[(i * i + i // 7) % 5]) for i in range(900)]
    frame = spark.createDataFrame([(k, e, s, u) for k, u, e, s in rows], "doc string, event long, signal string, at long")
    for i, part in enumerate((F.col("at") < BEGIN + 5 * HOUR, F.col("at") >= BEGIN + 5 * HOUR)):
        frame.filter(part).select("doc", F.timestamp_micros("at").alias("ts"), "event", "signal").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("doc string, ts timestamp, event long, signal string").parquet(f"{tmp_path}/in")
        query = machine.run_machine(stream, "doc", "ts", "event", "signal", 2 * HOUR, "30 minutes", f"{tmp_path}/out", f"{tmp_path}/state", groups=3)
        query.awaitTermination()
        assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 3 * 8, i  # not some for each of 150 documents
    found = sorted((tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()), key=repr)
    assert found == brute_machine(rows, 2 * HOUR, max(r[1] for r in rows) // 1000 - 30 * 60 * 1000)
    with pytest.raises(TypeError, match="doc is double"):
        machine.transitions(stream.withColumn("doc", F.lit(0.5)), "doc", "ts", "event", "signal", HOUR, "1 hour")
