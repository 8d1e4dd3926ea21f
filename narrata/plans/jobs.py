"""Job event logs: state, progress, gaps, throttling and pauses.

Events are (job_id, seq, ...), with ``seq`` rising within a job.  State and
averages are folds over a job's events.  Both are compositions of small maps,
so they are folded in two steps: over blocks of ``BLOCK`` sequence numbers,
then over the blocks; no task holds all the events of one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK = 1024
STATES = ("queued", "running", "paused", "muxing", "done", "failed", "cancelled")
EVENTS = ("start", "cancel", "pause", "resume", "stop", "fail", "muxed", "ffmpeg_error", "rendered")
# Fixed values. The edges of the state diagram; what rendering leads to depends on the kind of job.
EDGES = {
    ("queued", "start"): "running",
    ("queued", "cancel"): "cancelled",
    ("running", "pause"): "paused",
    ("paused", "resume"): "running",
    ("running", "stop"): "cancelled",
    ("paused", "stop"): "cancelled",
    ("muxing", "stop"): "cancelled",
    ("running", "fail"): "failed",
    ("paused", "fail"): "failed",
    ("muxing", "muxed"): "done",
    ("muxing", "ffmpeg_error"): "failed",
}
ALPHA, CHARS_RATE = 0.2, 14.0


def _next_states() -> list[int]:
    """Next state by (kind, event, state); -1 where there is no edge."""
    out = []
    for kind in ("record", "prep"):
        for event in EVENTS:
            for state in STATES:
                to = EDGES.get((state, event))
                if (state, event) == ("running", "rendered"):
                    to = "done" if kind == "prep" else "muxing"
                out.append(STATES.index(to) if to else -1)
    return out


def _at(names: tuple[str, ...], value: Column) -> Column:
    return (F.array_position(F.array(*map(F.lit, names)), value) - 1).cast("int")


def fold_states(events: DataFrame) -> DataFrame:
    """State of each job after its events (job_id, seq, kind, event).

    An event without an edge changes nothing and counts as illegal; so does
    one of unknown name.  Columns: job_id, state, illegal, events, last_seq.
    """
    table = F.array(*[F.lit(x) for x in _next_states()])
    code = F.coalesce(_at(EVENTS, F.col("event")), F.lit(-1))
    rows = events.select("job_id", "seq", F.floor(F.col("seq") / BLOCK).alias("block"), F.when(F.col("kind") == "prep", 1).otherwise(0).alias("kind"), code.alias("code"))
    listed = F.array_sort(F.collect_list(F.struct("seq", "kind", "code")))

    def step(acc: Column, e: Column) -> Column:
        to = F.when(e["code"] < 0, -1).otherwise(F.element_at(table, (e["kind"] * len(EVENTS) + e["code"]) * len(STATES) + acc["state"] + 1))
        return F.struct(F.when(to >= 0, to).otherwise(acc["state"]).alias("state"), (acc["illegal"] + F.when(to < 0, 1).otherwise(0)).alias("illegal"))

    from_each = lambda es: F.transform(F.sequence(F.lit(0), F.lit(len(STATES) - 1)), lambda s: F.aggregate(es, F.struct(s.alias("state"), F.lit(0).alias("illegal")), step))
    blocks = rows.groupBy("job_id", "block").agg(listed.alias("es"), F.count("*").alias("n"), F.max("seq").alias("last")).select("job_id", "block", "n", "last", from_each(F.col("es")).alias("maps"))
    per_job = blocks.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("block", "maps"))).alias("bs"), F.sum("n").alias("events"), F.max("last").alias("last_seq"))

    def join(acc: Column, b: Column) -> Column:
        to = F.element_at(b["maps"], acc["state"] + 1)
        return F.struct(to["state"].alias("state"), (acc["illegal"] + to["illegal"]).alias("illegal"))

    folded = per_job.withColumn("f", F.aggregate("bs", F.struct(F.lit(0).alias("state"), F.lit(0).alias("illegal")), join))
    return folded.select("job_id", F.element_at(F.array(*map(F.lit, STATES)), F.col("f.state") + 1).alias("state"), F.col("f.illegal").cast("long").alias("illegal"), "events", "last_seq")


def recover(states: DataFrame) -> DataFrame:
    """Jobs in flight become paused with a reason and one more event."""
    lost = F.col("state").isin("running", "muxing")
    return states.select(
        "job_id", F.when(lost, "paused").otherwise(F.col("state")).alias("state"), F.when(lost, "crash_recovery").alias("paused_reason"), (F.col("last_seq") + F.when(lost, 1).otherwise(0)).alias("last_seq")
    )


def stage(state: Column, kind: Column) -> Column:
    return F.when(state == "queued", "plan").when((state == "muxing") | ((state == "done") & (kind == "record")), "mux").otherwise("synth")


def progress(samples: DataFrame, remaining: int) -> DataFrame:
    """Averages of finished chunks (job_id, seq, chars, duration_s, wall_s) and the time left.

    Exponential averages with weight ALPHA; throughput starts at the first
    sample, the rate of characters at CHARS_RATE.  Samples without time count
    for nothing.  Each sample is an affine map of the average, and so is a
    block of them.
    """
    good = samples.filter("duration_s > 0 AND wall_s > 0").select(
        "job_id", "seq", F.floor(F.col("seq") / BLOCK).alias("block"), (F.col("duration_s") / F.col("wall_s")).alias("x"), (F.col("chars") / F.col("duration_s")).alias("y")
    )
    fold = lambda name: F.aggregate(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))), F.lit(0.0), lambda acc, e: acc * (1 - ALPHA) + e[name] * ALPHA)
    blocks = good.groupBy("job_id", "block").agg(fold("x").alias("bx"), fold("y").alias("by"), F.count("*").alias("n"), F.min_by("x", "seq").alias("first"), F.max_by("x", "seq").alias("last"))
    over = lambda name, zero: F.aggregate("bs", zero, lambda acc, b: acc * F.pow(F.lit(1 - ALPHA), b["n"].cast("double")) + b[name])
    jobs = blocks.groupBy("job_id").agg(
        F.array_sort(F.collect_list(F.struct("block", "n", "bx", "by"))).alias("bs"), F.min_by("first", "block").alias("first"), F.max_by("last", "block").alias("rtf_instant"), F.sum("n").alias("samples")
    )
    rates = jobs.select("job_id", "samples", "rtf_instant", over("bx", F.col("first")).alias("throughput"), over("by", F.lit(CHARS_RATE)).alias("chars_per_audio_s"))
    left = F.when((F.col("throughput") > 0) & (F.col("chars_per_audio_s") > 0), remaining / F.col("chars_per_audio_s") / F.col("throughput")).otherwise(0.0)
    return rates.withColumn("eta_s", left)


def missing(events: DataFrame) -> DataFrame:
    """Gaps in a job's sequence numbers: job_id, after, before, lost."""
    following = F.lead("seq").over(Window.partitionBy("job_id").orderBy("seq"))
    return events.withColumn("before", following).filter("before - seq > 1").select("job_id", F.col("seq").alias("after"), "before", (F.col("before") - F.col("seq") - 1).alias("lost"))


def since(events: DataFrame, seq: int, topics: tuple[str, ...] = (), most: int = 1000) -> DataFrame:
    """Events behind ``seq`` in order, ``most`` at most; no topics means all."""
    rows = events.filter(F.col("seq") > seq)
    return (rows.filter(F.col("event").isin(*topics)) if topics else rows).orderBy("seq").limit(most)


def latest(events: DataFrame) -> DataFrame:
    """The last record of each job."""
    return events.groupBy("job_id").agg(F.max(F.struct("seq", "event", "value")).alias("r")).select("job_id", F.col("r.seq").alias("last_seq"), "r.event", "r.value")


def throttle(events: DataFrame, every: str = "250 milliseconds") -> DataFrame:
    """The last event of each job in each interval."""
    last = events.groupBy("job_id", F.window("ts", every).alias("w")).agg(F.max(F.struct("ts", "seq", "value")).alias("r"), F.count("*").alias("n"))
    return last.select("job_id", F.col("w.start").alias("start"), F.col("r.seq").alias("seq"), F.col("r.value").alias("value"), "n")


def pauses(samples: DataFrame, floor: float, clear: int = 3) -> DataFrame:
    """When a job pauses and resumes: below the floor, and after ``clear`` samples in a row that are not.

    A missing value counts as clear.  A sample leaves the job paused iff fewer
    than ``clear`` samples follow the last one below.
    """
    order = Window.partitionBy("job_id").orderBy("seq")
    rows = samples.withColumn("n", F.row_number().over(order)).withColumn("low", F.coalesce(F.col("value") < floor, F.lit(False)))
    since_low = F.col("n") - F.max(F.when(F.col("low"), F.col("n"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("paused", F.coalesce(since_low < clear, F.lit(False)))
    before = F.coalesce(F.lag("paused").over(order), F.lit(False))
    return rows.select("job_id", "seq", "paused", (F.col("paused") & ~before).alias("paused_now"), (~F.col("paused") & before).alias("resumed_now"))


def active_conflicts(states: DataFrame, project: str = "project_id") -> DataFrame:
    """Projects with more than one job that has not ended."""
    return states.filter(~F.col("state").isin("done", "failed", "cancelled")).groupBy(project).agg(F.count("*").alias("active")).filter("active > 1")
