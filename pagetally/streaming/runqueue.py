"""The run queue's log: each START with its END and return code, by a stateful stream and, over a whole table, by windows."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

# Fixed value: a line of the queue's log.
LINE = r"^=== (START|END)\s+(\S+)\s+(?:rc=(-?\d+)\s+)?(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d)$"
RUNS = "name string, started bigint, ended bigint, rc int, status string"


def queue_events(lines: DataFrame, text: str = "value") -> DataFrame:
    """(name, kind, rc, second, at) of a log's lines; other lines go. kind: 0 for START, 1 for END; second: since 1970, in the
    session's time zone."""
    part = lambda k: F.regexp_extract(text, LINE, k)
    at = F.try_to_timestamp(part(4), F.lit("yyyy-MM-dd HH:mm:ss"))
    rows = lines.where(F.col(text).rlike(LINE)).select(part(2).alias("name"), F.when(part(1) == "START", 0).otherwise(1).alias("kind"), part(3).try_cast("int").alias("rc"), at.alias("at"))
    return rows.where("at IS NOT NULL").select("name", "kind", "rc", F.unix_timestamp("at").alias("second"), "at")


def stream_queue(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Lines of new log files as they appear."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)


def _status(rc) -> str:
    return "finished" if rc == 0 else "failed"


def _decided(begun, ready: list, seen: float, limit: int) -> tuple[list, int | None]:
    """(runs, the START that stays open) of a name's events up to the watermark, in order."""
    out = []
    for second, kind, rc in ready:
        if begun is not None and (kind == 0 or second > begun + limit):
            out.append((begun, None, None, "never ended"))
            begun = None
        if kind == 0:
            begun = second
        elif begun is None:
            out.append((None, second, rc, "end without start"))
        else:
            out.append((begun, second, rc, _status(rc)))
            begun = None
    if begun is not None and begun + limit < seen:
        out.append((begun, None, None, "never ended"))
        begun = None
    return out, begun


def _pair(limit: int):
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names = json.loads(state.get[0]) if state.exists else {}  # name: its open START, the events that wait
        for batch in batches:
            for name, s, k, r in zip(*(batch[c].tolist() for c in ("name", "second", "kind", "rc")), strict=True):
                names.setdefault(name, [None, []])[1].append([int(s), int(k), None if r is None or r != r else int(r)])
        seen = state.getCurrentWatermarkMs() / 1000
        out, held, due = [], {}, []
        for name, (begun, later) in names.items():
            ready = sorted((e for e in later if e[0] <= seen), key=lambda e: (e[0], e[1], e[2] is not None, e[2] or 0))
            later = [e for e in later if e[0] > seen]
            runs, begun = _decided(begun, ready, seen, limit)
            out += [(name, *run) for run in runs]
            if later or begun is not None:
                held[name] = [begun, later]
                due += [e[0] for e in later] + ([begun + limit] if begun is not None else [])
        if held:
            state.update((json.dumps(held),))
            state.setTimeoutTimestamp(int(max(min(due), seen) * 1000) + 1)
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["name", "started", "ended", "rc", "status"]).astype({"started": "Int64", "ended": "Int64", "rc": "Int32"})

    return step


def paired_stream(events: DataFrame, limit: int = 86_400, lateness: str = "1 hour", shares: int = 4096) -> DataFrame:
    """(name, started, ended, rc, status) of a stream of ``queue_events``, each run once.

    A START goes with the next event of its name if that is an END within ``limit`` seconds: "finished" with return code 0, else
    "failed". A START that another START follows, or nothing within the limit, has "never ended": a timer of the event time says
    so when the log has gone on that long. An END without an open START is an "end without start". Events wait until
    the watermark has passed them and are taken in order of time, at one time START first, then by return code; those later
    than ``lateness`` are dropped. State: a name's open START and the events that wait. Names are kept in so many ``shares`` by
their hash, each one state and one call of Python: a call for each name costs far more than its few events."""
    share = F.pmod(F.xxhash64("name"), F.lit(shares)).cast("int")
    seen = events.withWatermark("at", lateness).withColumn("share", share).groupBy("share")
    return seen.applyInPandasWithState(_pair(limit), RUNS, "held string", "append", GroupStateTimeout.EventTimeTimeout)


def paired_table(events: DataFrame, limit: int = 86_400) -> DataFrame:
    """What ``paired_stream`` gives of a whole log, as a table: each event and the one beside it."""
    order = Window.partitionBy("name").orderBy("second", "kind", F.col("rc").isNotNull(), F.coalesce("rc", F.lit(0)))
    near = events.select("name", "kind", "rc", "second", *[f(c).over(order).alias(f"{n}_{c}") for n, f in (("next", F.lead), ("last", F.lag)) for c in ("kind", "rc", "second")])
    ends = (F.col("next_kind") == 1) & (F.col("next_second") <= F.col("second") + limit)
    ended = F.coalesce(ends, F.lit(False))
    status = F.when(~ended, "never ended").when(F.col("next_rc") == 0, "finished").otherwise("failed")
    runs = near.where("kind = 0").select("name", F.col("second").alias("started"), F.when(ended, F.col("next_second")).alias("ended"), F.when(ended, F.col("next_rc")).alias("rc"), status.alias("status"))
    taken = F.coalesce((F.col("last_kind") == 0) & (F.col("second") <= F.col("last_second") + limit), F.lit(False))
    loose = near.where(F.col("kind") == 1).where(~taken).select("name", F.lit(None).cast("bigint").alias("started"), F.col("second").alias("ended"), "rc", F.lit("end without start").alias("status"))
    return runs.unionByName(loose)
