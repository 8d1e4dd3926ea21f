"""Job streams that need more than an aggregate: events out of order, gaps, pauses, and a table of the latest records.

The processors keep typed state with timers; they need the RocksDB state store
(``with_state_store``).  What is late or sent twice changes nothing, so after
all events a stream has what ``narrata.plans.jobs`` has for them at once.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator
from struct import iter_unpack, pack

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.readwriter import DataStreamWriter

from narrata.plans import jobs
from narrata.sources.buckets import Buckets

ORDERED = "job_id long, state string, illegal long, events long, last_seq long, waiting long, lost long"
GAPS = "job_id long, after long, before long, lost long, open boolean"
PAUSES = "job_id long, seq long, paused boolean, paused_now boolean, resumed_now boolean"
LATEST = "job_id long, last_seq long, event string, value double"
#: Waiting events are kept by blocks of so many numbers, three bytes each: the place in the block and the code.
WAITING = 1024


def with_state_store(spark: SparkSession) -> SparkSession:
    """A session of its own whose streams keep their state in RocksDB."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return own


class _Ordered(StatefulProcessor):
    """Folds a job's events in order of their numbers; those behind a gap wait until it is closed, or given up."""

    def __init__(self, first: int, patience_ms: int) -> None:
        self.first, self.patience = first, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "place int, illegal long, n long, next long, held long, lost long, deadline long")
        # What waits beyond all patience goes with its block. A call of the state store takes longer than an event, so a block is read and written once.
        self.waiting = handle.getMapState("waiting", "block long", "events binary", 8 * self.patience)
        self.table, self.width = jobs._next_states(), len(jobs.STATES)

    def _start(self) -> list[int]:
        return list(self.place.get() or (0, 0, 0, self.first, 0, 0, 0))

    def _apply(self, now: list[int], code: int) -> None:
        to = -1 if code < 0 else self.table[code * self.width + now[0]]
        now[0], now[1], now[2], now[3] = (to if to >= 0 else now[0]), now[1] + (to < 0), now[2] + 1, now[3] + 1

    @staticmethod
    def _unpacked(events: bytes) -> dict[int, int]:
        return {place: code for place, code in iter_unpack("<Hb", events)}

    def _go_on(self, now: list[int], fresh: Iterable[tuple[int, int]]) -> None:
        """As far as events follow each other; the rest waits, the first one of a number."""
        blocks, stored, changed = {}, set(), set()
        any_stored = now[4] > 0

        def block(seq: int) -> dict[int, int]:
            number = seq // WAITING
            if number not in blocks:
                found = self.waiting.getValue((number,)) if any_stored else None
                blocks[number] = self._unpacked(found[0]) if found else {}
                if found:
                    stored.add(number)
            return blocks[number]

        for seq, code in fresh:
            if seq >= now[3] and seq % WAITING not in (held := block(seq)):
                held[seq % WAITING] = code
                changed.add(seq // WAITING)
                now[4] += 1
        while now[4] and now[3] % WAITING in (held := block(now[3])):
            changed.add(now[3] // WAITING)
            now[4] -= 1
            self._apply(now, held.pop(now[3] % WAITING))
        for number in changed:
            if blocks[number]:
                self.waiting.updateValue((number,), (b"".join(pack("<Hb", *e) for e in blocks[number].items()),))
            elif number in stored:
                self.waiting.removeKey((number,))

    def _settle(self, key: tuple, now: list[int], time_ms: int) -> Iterator[Row]:
        if now[6] and not now[4]:
            self.handle.deleteTimer(now[6])
            now[6] = 0
        elif now[4] and not now[6]:
            now[6] = time_ms + self.patience
            self.handle.registerTimer(now[6])
        self.place.update(tuple(now))
        yield Row(job_id=key[0], state=jobs.STATES[now[0]], illegal=now[1], events=now[2], last_seq=now[3] - 1, waiting=now[4], lost=now[5])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now = self._start()
        before = now[3]
        codes = {e: k for k, e in enumerate(jobs.EVENTS)}
        self._go_on(now, [(r["seq"], (r["kind"] == "prep") * len(codes) + codes[r["event"]] if r["event"] in codes else -1) for r in rows])
        if now[3] > before and now[6] and now[4]:
            # The gap that was waited for is closed; the next one has its own time.
            self.handle.deleteTimer(now[6])
            now[6] = 0
        yield from self._settle(key, now, timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = self._start()
        now[6] = 0
        held = {number: self._unpacked(events) for (number,), (events,) in self.waiting.iterator()}
        now[4] = sum(map(len, held.values()))
        if held:
            first = min(held)
            first = first * WAITING + min(held[first])
            now[5] += first - now[3]
            now[3] = first
            self._go_on(now, ())
        yield from self._settle(key, now, timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


def fold_in_order(events: DataFrame, first: int = 1, patience_ms: int = 600_000) -> DataFrame:
    """State of each job after every micro-batch, whatever the order in which its events (job_id, seq, kind, event) come.

    Numbers begin with ``first``.  An event behind a gap waits; a gap that is
    open longer than ``patience_ms`` is given up, and what comes too late
    then counts as lost.  State: a few numbers and the waiting events a job.
    """
    rows = events.select("job_id", "seq", "kind", "event")
    return rows.groupBy("job_id").transformWithState(_Ordered(first, patience_ms), ORDERED, "Update", "ProcessingTime")


class _Gaps(StatefulProcessor):
    """Keeps the numbers a job has as intervals; tells gaps that open and close."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "starts array<long>, ends array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        starts, ends = ([int(x) for x in xs] for xs in self.seen.get() or ([], []))
        before = set(zip(ends[:-1], starts[1:], strict=True))
        for seq in sorted({r["seq"] for r in rows}):
            k = bisect_left(ends, seq)
            if k < len(starts) and starts[k] <= seq:
                continue
            # Right behind the interval before, right before the next one, both, or alone.
            behind, ahead = k > 0 and ends[k - 1] == seq - 1, k < len(starts) and starts[k] == seq + 1
            if behind and ahead:
                ends[k - 1] = ends.pop(k)
                starts.pop(k)
            elif behind:
                ends[k - 1] = seq
            elif ahead:
                starts[k] = seq
            else:
                starts.insert(k, seq)
                ends.insert(k, seq)
        self.seen.update((starts, ends))
        after = set(zip(ends[:-1], starts[1:], strict=True))
        for a, b in sorted(before ^ after):
            yield Row(job_id=key[0], after=a, before=b, lost=b - a - 1, open=(a, b) in after)

    def close(self) -> None:
        pass


def gaps(events: DataFrame) -> DataFrame:
    """Gaps in the numbers of each job as they open and close: job_id, after, before, lost, open.

    Numbers may come in any order and more than once.  A gap that is filled in
    part closes, and what is left of it opens.  State grows with a job's open
    gaps, not with its events.
    """
    return events.select("job_id", "seq").groupBy("job_id").transformWithState(_Gaps(), GAPS, "Append", "None")


class _Pauses(StatefulProcessor):
    """Pauses below the floor; resumes after enough clear samples, of which one that does not come is one."""

    def __init__(self, floor: float, clear: int, every_ms: int) -> None:
        self.floor, self.clear, self.every = floor, clear, every_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "paused boolean, streak int, seq long, due long, timer long")

    def _sample(self, at: list, low: bool) -> tuple[bool, bool]:
        """Whether the sample pauses or resumes the job."""
        was = at[0]
        if low:
            at[0], at[1] = True, 0
        elif was:
            at[1] += 1
            if at[1] >= self.clear:
                at[0], at[1] = False, 0
        return at[0] and not was, was and not at[0]

    def _await(self, at: list, time_ms: int) -> None:
        """A job has one timer; it stays where it is when samples put off what it waits for."""
        at[3] = time_ms + self.every if at[0] else 0
        if at[3] and not at[4]:
            at[4] = at[3]
            self.handle.registerTimer(at[4])
        self.at.update(tuple(at))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        at, out = list(self.at.get() or (False, 0, -1, 0, 0)), []
        for seq, value in sorted(((r["seq"], r["value"]) for r in rows), key=lambda r: r[0]):
            paused_now, resumed_now = self._sample(at, value is not None and value < self.floor)
            at[2] = seq
            out.append(Row(job_id=key[0], seq=seq, paused=at[0], paused_now=paused_now, resumed_now=resumed_now))
        self._await(at, timerValues.getCurrentProcessingTimeInMs())
        yield from out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at, time_ms = list(self.at.get()), timerValues.getCurrentProcessingTimeInMs()
        at[4] = 0
        if at[3] > time_ms:
            # Samples came since; what is waited for is later.
            at[4] = at[3]
            self.handle.registerTimer(at[4])
            self.at.update(tuple(at))
        elif at[3]:
            _, resumed_now = self._sample(at, False)
            self._await(at, time_ms)
            if resumed_now:
                yield Row(job_id=key[0], seq=at[2], paused=False, paused_now=False, resumed_now=True)
        else:
            self.at.update(tuple(at))

    def close(self) -> None:
        pass


def pauses(samples: DataFrame, floor: float, clear: int = 3, every_ms: int = 5_000) -> DataFrame:
    """When a job pauses and resumes, as ``jobs.pauses`` tells for all samples (job_id, seq, value) at once.

    A job that is paused and silent for ``every_ms`` has a clear sample, and
    another one after as long again; it resumes by a timer then.  Samples of a
    job come in order across batches.
    """
    rows = samples.select("job_id", "seq", "value")
    return rows.groupBy("job_id").transformWithState(_Pauses(floor, clear, every_ms), PAUSES, "Append", "ProcessingTime")


def latest_table(path: str, count: int = 64) -> Buckets:
    return Buckets(path, LATEST, ("job_id",), count)


def merge_latest(events: DataFrame, table: Buckets, version: int) -> None:
    """Bring a table of the latest records up to date with some events (job_id, seq, event, value).

    Only buckets of jobs with events are rewritten, and none that has the
    version already, so a batch may be merged again.
    """
    spark = events.sparkSession
    events = events.select("job_id", "seq", "event", "value")
    newest, only = table.newest(spark), table.touched(events)
    only = [b for b in only if newest.get(b, (-1, 0))[0] < version]
    known = table.read(spark, newest, only).select("job_id", F.col("last_seq").alias("seq"), "event", "value")
    table.write(jobs.latest(known.unionByName(events.filter(table.bucket().isin(only)))), version, newest, only)


def upsert_latest(events: DataFrame, table: Buckets) -> DataStreamWriter:
    """A stream into a table of the latest records; the batch's number is the version, so a replayed batch changes nothing."""
    return events.writeStream.foreachBatch(lambda batch, number: merge_latest(batch, table, number))
