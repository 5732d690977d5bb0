"""Streams give the batch result; restarts neither lose nor repeat."""

from __future__ import annotations

import datetime as dt
import os
import tempfile
from collections import Counter

import pytest
from helpers import as_set, brute_couples
from pyspark.sql import functions as F

from docweave.plans.partitioning import Options
from docweave.sources.json_documents import stream_documents, stream_table
from docweave.sources.sinks import stream_pairs
from docweave.sources.tables import documents_from_table
from docweave.streaming import joins
from docweave.streaming.batches import (
    PartitionTableState,
    end_windows,
    read_couples,
    read_plans,
    stream_partitioned_join,
    stream_window_join,
)
from docweave.streaming.joins import stream_natural_join
from docweave.streaming.ledger import WindowLedger, Windows, read_late
from registry.fixtures import mixed_attrs, mixed_events

SF = "/root/testdata/sf0.001"
DAY0 = dt.datetime(2024, 1, 1)
SCHEMA = "doc long, m map<string,string>, ts timestamp"


def new_folder() -> str:
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def add_file(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def run(spark, source, out, core=()):
    docs = spark.readStream.schema(SCHEMA).parquet(source)
    joined = stream_natural_join(docs, "1 day", "1 hour", core)
    stream_pairs(joined, f"{out}/rows", f"{out}/progress").awaitTermination()
    return as_set(spark.read.schema("w long, a long, b long").parquet(f"{out}/rows"), "w", "a", "b")


def documents(days, first):
    return [
        (first + i, {"t": "xy"[i % 2], "k": str(i % 3)} if i % 4 else {"k": str(i % 3), "own": str(i)}, DAY0 + dt.timedelta(days=d, hours=i % 20))
        for d in days
        for i in range(first + 20 * d, first + 20 * d + 20)
    ]


@pytest.mark.parametrize("core", [(), ("t",), ("t", "k")])
def test_stream_join_restarts_without_repeats(spark, core):
    source, out = new_folder(), new_folder()
    first = documents([0, 1], 0)
    later = documents([1, 2], 1000)  # more of a window still open, and a new one
    seconds = lambda r: int((r[2].replace(hour=0) - dt.datetime(1970, 1, 1)).total_seconds())
    add_file(spark, source, first)
    run(spark, source, out, core)
    add_file(spark, source, later)
    got = run(spark, source, out, core)
    want = brute_couples([(seconds(r), r[0], r[1]) for r in first + later])
    assert got == want
    assert run(spark, source, out, core) == want  # nothing new, nothing repeated


def test_late_documents_are_dropped(spark):
    source, out = new_folder(), new_folder()
    add_file(spark, source, [(1, {"a": "1"}, DAY0), (2, {"a": "1"}, DAY0)])
    run(spark, source, out)
    add_file(spark, source, [(3, {"a": "1"}, DAY0 + dt.timedelta(days=3))])
    run(spark, source, out)  # moves the watermark past the first day
    add_file(spark, source, [(4, {"a": "1"}, DAY0), (5, {"a": "1"}, DAY0 + dt.timedelta(days=3))])
    assert {(a, b) for _, a, b in run(spark, source, out)} == {(1, 2), (3, 5)}


def test_a_hot_pair_spreads_over_declared_cells(spark):
    """A third of the stream carries one pair: its state lies under 16 keys and more, and the couples are the same."""
    source, out = new_folder(), new_folder()
    rows = [(i, {"h": "hot"} | {"u": str(i % 30)} if i % 3 == 0 else {"u": str(i % 30), "v": str(i)}, DAY0) for i in range(240)]
    add_file(spark, source, rows)
    docs = spark.readStream.schema(SCHEMA).parquet(source)
    joined = stream_natural_join(docs, "1 day", "1 hour", (), {"h": 32})
    stream_pairs(joined, f"{out}/rows", f"{out}/progress").awaitTermination()
    got = spark.read.parquet(f"{out}/rows").select("a", "b").collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == {(a, b) for _, a, b in brute_couples([(i, m) for i, m, _ in rows])}
    postings = spark.createDataFrame([(i, k, v) for i, m, _ in rows for k, v in m.items()], "doc long, attr string, val string")
    kept = joins._in_cells(postings, {"h": 32}, False).where("attr = 'h'").groupBy("cell").count().collect()
    assert len(kept) >= 16 and max(r["count"] for r in kept) < 80 / 4
    assert joins._in_cells(postings, {"h": 32}, True).count() == len(rows) * 2 + 80 * 31


def test_frequent_pairs_meet_only_what_agrees_in_the_others(spark, monkeypatch):
    """Attributes with cells: couples as by brute force, from a fraction of the rows that share a pair; repeated ids are no couple."""
    few = lambda i: {a: str(i // n % m) for a, n, m, lacks in (("a", 1, 2, 5), ("b", 2, 3, 4), ("c", 3, 2, 7)) if i % lacks}
    rows = [(i, few(i) | ({"A": str(i % 11)} if i % 3 else {}) | ({"u": str(i % 40)} if i % 2 else {}), DAY0) for i in range(240)]
    twice = [(7, {"a": "1"}, DAY0), (7, {"u": "7", "b": rows[7][1]["b"]}, DAY0)]
    docs, again = (spark.createDataFrame(r, SCHEMA) for r in (rows, rows + twice))
    met, meet = [], joins._meet
    monkeypatch.setattr(joins, "_meet", lambda *x: met.append(meet(*x)) or met[-1])
    cells = {"a": 3, "b": 2, "c": 1}
    got = [(r.a, r.b) for r in stream_natural_join(docs, "1 day", "1 hour", (), cells).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for _, a, b in brute_couples([(i, m) for i, m, _ in rows])}
    shared = sum(v * v for v in Counter((k, v) for _, m, _ in rows for k, v in m.items() if k in cells).values())
    assert met[0].where(F.col("attr_a").isin(list(cells))).count() < shared / 2
    assert stream_natural_join(again, "1 day", "1 hour", (), cells).where("a = b").isEmpty()


def test_core_is_bounded(spark):
    docs = spark.readStream.schema(SCHEMA).parquet(new_folder())
    with pytest.raises(ValueError):
        stream_natural_join(docs, core=tuple("abcdef"))


def events_stream(spark, source):
    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    return documents_from_table(
        stream_table(spark, source, schema), "event_id", mixed_attrs(), w=F.floor(F.col("event_id") / 500)
    )


@pytest.fixture(scope="module")
def event_couples(spark):
    return brute_couples([(r["w"], r["doc"], r["m"]) for r in mixed_events(spark, SF).collect()])


def test_batches_in_any_order(spark, event_couples):
    """Every file holds a mix of both windows; half of them come after a restart."""
    source, out = new_folder(), new_folder()
    parts = spark.read.parquet(f"{SF}/events.parquet").withColumn("p", F.pmod(F.hash("event_id"), F.lit(3)))
    for p in range(3):
        parts.where(F.col("p") == p).drop("p").coalesce(1).write.mode("append").parquet(source)
        if p:
            stream_window_join(events_stream(spark, source), out).awaitTermination()
    assert as_set(read_couples(spark, out), "w", "a", "b") == event_couples


def test_partition_state_across_restarts(spark, event_couples):
    """Files that end in the middle of a window: it is served once, when it is over, and then forgotten."""
    source, out = new_folder(), new_folder()
    events = spark.read.parquet(f"{SF}/events.parquet")
    for part in range(3):
        events.where(F.floor(F.col("event_id") / 400) == part).coalesce(1).write.mode("append").parquet(source)
        stream_partitioned_join(events_stream(spark, source), out, Options(k=4)).awaitTermination()
        kept = {f for f in os.listdir(f"{out}/documents") if f.startswith("w=")}
        assert kept == ({"w=0"} if not part else {"w=1"})
    assert {r[0] for r in as_set(read_couples(spark, out), "w", "a", "b")} == {0}
    for _ in range(2):
        end_windows(events_stream(spark, source), out, Options(k=4))
    assert as_set(read_couples(spark, out), "w", "a", "b") == event_couples
    assert not [f for f in os.listdir(f"{out}/documents") if f.startswith("w=")]
    plans = {r["w"]: r for r in read_plans(spark, out).collect()}
    assert plans[0]["rebuilt"] and not plans[1]["rebuilt"] and plans[1]["version"] == 1
    keeper = PartitionTableState(spark, out)
    assert keeper.load(1).table is None
    assert keeper.load(2).version == 1 and keeper.load(2).table.count() > 0 and keeper.load(2).baseline


def small(spark, path, rows):
    spark.createDataFrame(rows, "w long, doc long, m map<string,string>, source string").coalesce(1).write.mode("append").parquet(path)


def small_stream(spark, path):
    return spark.readStream.schema("w long, doc long, m map<string,string>, source string").option("maxFilesPerTrigger", 1).parquet(path)


@pytest.mark.parametrize("runner", ["window", "partitioned"])
def test_windows_close_when_all_sources_are_beyond_them(spark, runner):
    source, out = new_folder(), new_folder()
    m = {"a": "1"}
    batches = [
        [(0, 1, m, "x"), (0, 2, m, "y"), (1, 3, m, "x")],
        [(2, 4, m, "x"), (0, 5, m, "y")],  # source y is still in window 0
        [(2, 6, m, "y"), (1, 7, m, "y")],  # closes 0, and 1 with what has just come
        [(0, 8, m, "x"), (1, 9, m, "y"), (2, 10, m, "x")],  # two late ones
    ]
    for rows in batches:
        small(spark, source, rows)
        if runner == "window":
            stream_window_join(small_stream(spark, source), out, delay=0).awaitTermination()
        else:
            stream_partitioned_join(small_stream(spark, source), out, Options(k=2)).awaitTermination()
    if runner == "partitioned":
        end_windows(small_stream(spark, source), out, Options(k=2))
    want = {(0, 1, 2), (0, 1, 5), (0, 2, 5), (1, 3, 7), (2, 4, 6), (2, 4, 10), (2, 6, 10)}
    assert as_set(read_couples(spark, out), "w", "a", "b") == want
    assert as_set(read_late(spark, out), "w", "doc") == {(0, 8), (1, 9)}


def test_a_batch_that_was_done_changes_nothing(spark):
    source, out = new_folder(), new_folder()
    small(spark, source, [(0, 1, {"a": "1"}, "x"), (1, 2, {"a": "1"}, "x")])
    stream_window_join(small_stream(spark, source), out, delay=0).awaitTermination()
    ledger = WindowLedger(spark, out, 0)
    assert ledger.load() == (0, Windows({"x": 1}, frozenset({1}), 0))
    again = spark.read.schema("w long, doc long, m map<string,string>, source string").parquet(source)
    assert ledger.add(again, 0) is None and ledger.load()[0] == 0


def test_stream_of_json_files(spark):
    source, out = new_folder(), new_folder()
    with open(f"{source}/a.json", "w") as f:
        f.write('[{"a":1},{"a":"1","b":2},{"b":3}]')
    docs = stream_documents(spark, source).withColumn("w", F.lit(0).cast("bigint"))
    stream_window_join(docs, out).awaitTermination()
    got = read_couples(spark, out).collect()
    assert [(r["a"][-1], r["b"][-1]) for r in got] == [("0", "1")]
