"""Stateful streams: events out of order, late or twice, gaps, pauses; tables that a replayed write does not change."""

import inspect
import math
import os
import random
import time

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from narrata.catalog.streams import read_rows
from narrata.plans import jobs
from narrata.sources.block_table import BlockTable, Stale
from narrata.sources.buckets import Buckets
from narrata.streaming import stateful

EVENTS = "job_id long, seq long, kind string, event string, value double"


def batches(spark, tmp_path, parts, schema, name="in"):
    """Each part as one micro-batch of a stream."""
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
    own = stateful.with_state_store(spark)
    own.conf.set("spark.sql.shuffle.partitions", "2")
    return own.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}")


def rows_of(stream, rows, stays=0.0):
    """All rows of a stream by micro-batch, in their order; ``stays`` more seconds for timers."""
    out = []
    query = stream.writeStream.outputMode("update").foreachBatch(lambda b, n: out.extend((n, *r) for r in b.collect())).trigger(processingTime="200 milliseconds").start()
    if stays:
        until = time.monotonic() + 60
        while sum(p["numInputRows"] for p in query.recentProgress) < rows and time.monotonic() < until:
            query.awaitTermination(0.2)
        query.awaitTermination(stays)
    read_rows(query, rows, 60)
    return out


def test_events_in_any_order_fold_as_in_order(spark, tmp_path):
    rnd = random.Random(3)
    events = [(j, s, "prep" if j else "record", rnd.choice([*jobs.EVENTS, "nonsense"]), 1.0) for j in range(3) for s in range(1, 31)]
    shuffled = rnd.sample(events, len(events)) + events[:5]
    stream = batches(spark, tmp_path, [shuffled[k::3] for k in range(3)], EVENTS)
    last = {r[1]: r[2:] for r in sorted(rows_of(stateful.fold_in_order(stream), len(shuffled)), key=lambda r: r[0])}
    expected = {r.job_id: (r.state, r.illegal, r.events, r.last_seq, 0, 0) for r in jobs.fold_states(spark.createDataFrame(events, EVENTS)).collect()}
    assert last == expected


def test_gaps_are_waited_for_and_given_up(spark, tmp_path):
    parts = [[(1, 1, "record", "start", 1.0), (1, 4, "record", "resume", 1.0), (2, 1, "record", "start", 1.0)], [(1, 3, "record", "pause", 1.0)]]
    told = rows_of(stateful.fold_in_order(batches(spark, tmp_path, parts, EVENTS), patience_ms=2_000), 4, stays=8)
    told = [r[1:] for r in told if r[1] == 1]
    assert told[:2] == [(1, "running", 0, 1, 1, 1, 0), (1, "running", 0, 1, 1, 2, 0)]
    assert told[-1] == (1, "running", 0, 3, 4, 0, 1)


def test_gaps_open_and_close(spark, tmp_path):
    rnd = random.Random(5)
    seen = sorted(rnd.sample(range(100), 70))
    order = rnd.sample(seen, len(seen))
    parts = [[(1, s) for s in order[k::4]] + [(1, order[0])] for k in range(4)]
    told = rows_of(stateful.gaps(batches(spark, tmp_path, parts, "job_id long, seq long")), sum(map(len, parts)))
    still = {}
    for _, job, after, before, lost, is_open in told:
        still[after, before] = (is_open, lost)
    expected = {(a, b): (True, b - a - 1) for a, b in zip(seen, seen[1:], strict=False) if b - a > 1}
    assert {k: v for k, v in still.items() if v[0]} == expected


def test_a_silent_job_resumes_by_a_timer(spark, tmp_path):
    parts = [[(1, 1, 9.0), (1, 2, 1.0), (1, 3, None), (2, 1, 1.0), (2, 2, 8.0), (2, 3, 8.0), (2, 4, 8.0)]]
    told = rows_of(stateful.pauses(batches(spark, tmp_path, parts, "job_id long, seq long, value double"), 5.0, clear=3, every_ms=1_000), 7, stays=6)
    assert [r[2:] for r in told if r[1] == 2] == [(1, True, True, False), (2, True, False, False), (3, True, False, False), (4, False, False, True)]
    assert [r[2:] for r in told if r[1] == 1] == [(1, False, False, False), (2, True, True, False), (3, True, False, False), (3, False, False, True)]


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    table = stateful.latest_table(f"{tmp_path}/latest", 4)
    frame = lambda rows: spark.createDataFrame(rows, "job_id long, seq long, event string, value double")
    read = lambda: sorted(map(tuple, table.read(spark).collect()))
    stateful.merge_latest(frame([(k, 1, "start", 0.5) for k in range(20)]), table, 0)
    stateful.merge_latest(frame([(3, 7, "fail", 1.5), (4, 0, "late", 0.0)]), table, 1)
    expected = sorted([(k, 1, "start", 0.5) for k in range(20) if k != 3] + [(3, 7, "fail", 1.5)])
    assert read() == expected
    # The same batch again, and one that stopped after some of its buckets.
    stateful.merge_latest(frame([(3, 7, "fail", 1.5), (4, 0, "late", 0.0)]), table, 1)
    assert read() == expected
    newest = table.newest(spark)
    stateful.merge_latest(frame([(k, 9, "stop", 2.0) for k in range(20)]).filter(table.bucket() == 0), table, 2)
    stateful.merge_latest(frame([(k, 9, "stop", 2.0) for k in range(20)]), table, 2)
    assert read() == [(k, 9, "stop", 2.0) for k in range(20)] and all(v[0] == 2 for v in table.newest(spark).values()) and len(newest) == 4


BLOCKS = "book_id string, chapter_id long, block_index int, text string"


def files_of(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_commits_rewrite_only_the_books_they_change(spark, tmp_path):
    table = BlockTable(f"{tmp_path}/blocks", count=8)
    frame = lambda rows: spark.createDataFrame(rows, BLOCKS)
    books = [f"book{k}" for k in range(12)]
    table.commit(frame([(b, 1, i, f"{b} {i}") for b in books for i in range(3)]), 1)
    before = files_of(tmp_path)
    table.commit(frame([("book3", 1, 0, "new"), ("book3", 1, 1, "book3 1"), ("book3", 1, 7, "more")]), 2, base=1)
    changed = {f for f, t in files_of(tmp_path).items() if before.get(f) != t}
    assert set(before) <= set(files_of(tmp_path)) and len(changed) == 2
    rows = lambda df: sorted((r.block_index, r.text, r.valid_from, r.valid_to) for r in df.filter("book_id = 'book3'").collect())
    assert rows(table.current(spark)) == [(0, "new", 2, None), (1, "book3 1", 1, None), (2, "book3 2", 1, None), (7, "more", 2, None)]
    assert rows(table.as_of(spark, 1)) == [(0, "book3 0", 1, 2), (1, "book3 1", 1, None), (2, "book3 2", 1, None)]
    assert table.current(spark).count() == 37 and table.as_of(spark, 1).count() == 36 and table.as_of(spark, 0).count() == 0
    # The same commit again changes nothing; one from an older state fails, but not for other books.
    table.commit(frame([("book3", 1, 0, "new"), ("book3", 1, 7, "more")]), 2, base=1)
    assert rows(table.current(spark))[0] == (0, "new", 2, None) and table.as_of(spark, 1).count() == 36
    with pytest.raises(Stale):
        table.commit(frame([("book3", 1, 0, "newer")]), 3, base=1)
    table.commit(frame([("book4", 1, 0, "other")]), 3, base=2)
    assert table.as_of(spark, 2).filter("text = 'other'").isEmpty()


def test_a_commit_that_stops_halfway_is_not_seen(spark, tmp_path, monkeypatch):
    table = BlockTable(f"{tmp_path}/blocks", count=2)
    frame = lambda rows: spark.createDataFrame(rows, BLOCKS)
    table.commit(frame([("a", 1, 0, "old")]), 1)
    with monkeypatch.context() as m:
        m.setattr(Buckets, "write", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            table.commit(frame([("a", 1, 0, "new")]), 2)
    assert [r.text for r in table.current(spark).collect()] == [r.text for r in table.as_of(spark, 1).collect()] == ["old"]
    table.commit(frame([("a", 1, 0, "new")]), 2)
    assert [r.text for r in table.current(spark).collect()] == ["new"] and [r.text for r in table.as_of(spark, 1).collect()] == ["old"]


def test_readers_of_some_books_read_their_buckets_alone(spark, tmp_path):
    table = BlockTable(f"{tmp_path}/blocks", count=8)
    table.commit(spark.createDataFrame([(f"book{k}", 1, 0, "x") for k in range(30)], BLOCKS), 1)
    some = table.current(spark, ["book1"])
    assert [r.book_id for r in some.collect()] == ["book1"]
    assert len(some.inputFiles()) >= 1 and some.select(F.input_file_name()).distinct().count() == 1
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    filters = [line for line in some._jdf.queryExecution().explainString(mode).splitlines() if line.startswith("PartitionFilters")]
    assert len(filters) == 1 and "bucket" in filters[0]


class Calls:
    """A state store in memory that counts its calls."""

    def __init__(self):
        self.values, self.maps, self.timers, self.calls = {}, {}, [], 0

    def getValueState(self, name, schema):
        return type("Value", (), {"get": lambda _: self._count(self.values.get(name)), "exists": lambda _: self._count(name in self.values), "update": lambda _, v: self._count(self.values.update({name: v}))})()

    def getMapState(self, name, key, value, ttl=None):
        m = self.maps.setdefault(name, {})
        return type("Map", (), {
            "getValue": lambda _, k: self._count(m.get(k)), "containsKey": lambda _, k: self._count(k in m), "updateValue": lambda _, k, v: self._count(m.update({k: v})),
            "removeKey": lambda _, k: self._count(m.pop(k)), "keys": lambda _: iter(list(m)), "iterator": lambda _: iter(list(m.items())),
        })()

    def registerTimer(self, at):
        self._count(self.timers.append(at))

    def deleteTimer(self, at):
        self._count(self.timers.remove(at))

    def _count(self, result):
        self.calls += 1
        return result

    def getCurrentProcessingTimeInMs(self):
        return self.calls


def test_waiting_events_cost_calls_by_the_block(spark):
    """A call of the store takes longer than an event: 3,000 events that wait are a few blocks, not 3,000 calls and more."""
    store, job = Calls(), stateful._Ordered(1, 600_000)
    job.init(store)
    rows = [Row(job_id=1, seq=s, kind="record", event="start") for s in range(3000, 1, -1)]
    (out,) = job.handleInputRows((1,), iter(rows), store)
    assert (out["waiting"], out["last_seq"]) == (2999, 0) and store.calls < 20
    (out,) = job.handleInputRows((1,), iter([Row(job_id=1, seq=1, kind="record", event="start")]), store)
    assert (out["waiting"], out["last_seq"], out["events"], out["illegal"], out["state"]) == (0, 3000, 3000, 2999, "running")
    assert store.calls < 40 and not store.maps["waiting"] and not store.timers


def test_a_paused_job_keeps_its_timer():
    """Samples of a paused job put off what its timer waits for without a call for each batch."""
    store, job = Calls(), stateful._Pauses(5.0, 3, 1_000_000)
    job.init(store)
    for k in range(50):
        list(job.handleInputRows((1,), iter([Row(job_id=1, seq=k, value=1.0)]), store))
    assert len(store.timers) == 1 and store.calls <= 2 * 50 + 1


def test_streams_are_waited_for_until_they_end():
    assert inspect.signature(read_rows).parameters["seconds"].default == math.inf
