"""Job events as streams: deduplicated replay, state per job, throttled progress."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from narrata.plans import jobs

STATE = "job_id long, state string, illegal long, events long, last_seq long"


def deduplicate(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Each (job_id, seq) once, however often it is sent within ``delay``; state older than that goes."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["job_id", "seq"])


def throttle(events: DataFrame, every: str = "250 milliseconds", delay: str = "10 seconds") -> DataFrame:
    """The last event of each job in each interval, once the watermark has passed it."""
    last = events.withWatermark("ts", delay).groupBy("job_id", F.window("ts", every).alias("w")).agg(F.max(F.struct("ts", "seq", "value")).alias("r"), F.count("*").alias("n"))
    return last.select("job_id", F.col("w.start").alias("start"), F.col("r.seq").alias("seq"), F.col("r.value").alias("value"), "n")


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    place, illegal, n, last = state.get if state.exists else (0, 0, 0, -1)
    table, width = jobs._next_states(), len(jobs.STATES)
    rows = pd.concat(list(batches)).sort_values("seq")
    for seq, kind, event in zip(rows["seq"], rows["kind"], rows["event"], strict=True):
        code = jobs.EVENTS.index(event) if event in jobs.EVENTS else -1
        to = -1 if code < 0 else table[((kind == "prep") * len(jobs.EVENTS) + code) * width + place]
        place, illegal, n, last = (to if to >= 0 else place), illegal + (to < 0), n + 1, max(last, int(seq))
    state.update((place, illegal, n, last))
    yield pd.DataFrame([(key[0], jobs.STATES[place], illegal, n, last)], columns=["job_id", "state", "illegal", "events", "last_seq"])


def fold_states(events: DataFrame) -> DataFrame:
    """State of each job after every micro-batch, as ``jobs.fold_states`` gives for all events at once.

    Events of a job must arrive in order across batches; within one they are
    sorted.  The state is four numbers per job.
    """
    rows = events.select("job_id", "seq", "kind", "event")
    return rows.groupBy("job_id").applyInPandasWithState(_advance, STATE, "place int, illegal long, n long, last long", "update", GroupStateTimeout.NoTimeout)


def _average(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rate, chars, n = state.get if state.exists else (0.0, jobs.CHARS_RATE, 0)
    for rows in batches:
        good = rows[(rows["duration_s"] > 0) & (rows["wall_s"] > 0)].sort_values("seq")
        for c, d, w in zip(good["chars"], good["duration_s"], good["wall_s"], strict=True):
            rate = d / w if n == 0 else jobs.ALPHA * d / w + (1 - jobs.ALPHA) * rate
            chars = jobs.ALPHA * c / d + (1 - jobs.ALPHA) * chars
            n += 1
    state.update((float(rate), float(chars), n))
    yield pd.DataFrame([(key[0], n, float(rate), float(chars))], columns=["job_id", "samples", "throughput", "chars_per_audio_s"])


def progress(samples: DataFrame) -> DataFrame:
    """Averages of each job after every micro-batch, as ``jobs.progress`` gives for all samples at once; three numbers of state a job."""
    rows = samples.select("job_id", "seq", "chars", "duration_s", "wall_s")
    schema = "job_id long, samples long, throughput double, chars_per_audio_s double"
    return rows.groupBy("job_id").applyInPandasWithState(_average, schema, "rate double, chars double, n long", "update", GroupStateTimeout.NoTimeout)
