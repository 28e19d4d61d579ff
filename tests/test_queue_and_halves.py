import datetime
import os
import random
import time

import numpy as np
import pandas as pd
import pytest

from pagetally.functions.distance import _distance, distance_grid, similarity
from pagetally.operators.matching import merge_halves, paired, paired_sparsely
from pagetally.streaming.runqueue import _pair, paired_stream, paired_table, queue_events, stream_queue


def test_stream_of_the_queue_equals_the_table(spark, tmp_path):
    """A log in several files, one a trigger; lines are out of order by less than the lateness."""
    rnd = random.Random(3)
    lines, at = [], datetime.datetime(2026, 1, 5)
    for _ in range(400):
        at += datetime.timedelta(seconds=rnd.choice([0, 30, 600, 4000]))
        name = f"m{rnd.randrange(9)}"
        stamp = at.strftime("%Y-%m-%d %H:%M:%S")
        lines.append((at, rnd.choice([f"=== START {name}  {stamp}", f"=== END   {name}  rc={rnd.choice([0, 0, 1, 137])}  {stamp}", f"=== END {name}  {stamp}", "noise"])))
    lines.append((at + datetime.timedelta(days=9), f"=== START closing  {(at + datetime.timedelta(days=9)).strftime('%Y-%m-%d %H:%M:%S')}"))
    lines.sort(key=lambda x: x[0] + datetime.timedelta(seconds=rnd.randrange(1500)))
    log = tmp_path / "log"
    log.mkdir()
    for k in range(0, len(lines), 60):
        file = log / f"{k:05}.txt"
        file.write_text("\n".join(text for _, text in lines[k : k + 60]))
        os.utime(file, (1_700_000_000 + k, 1_700_000_000 + k))
    runs = paired_stream(queue_events(stream_queue(spark, str(log), files_per_trigger=1)), limit=7200, lateness="30 minutes")
    q = runs.writeStream.format("parquet").option("path", str(tmp_path / "runs")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda r: tuple("" if x is None else str(x) for x in r)
    got = sorted(key(r) for r in spark.read.parquet(str(tmp_path / "runs")).collect())
    want = sorted(key(r) for r in paired_table(queue_events(spark.read.text(str(log))), limit=7200).where("name <> 'closing'").collect())
    assert got == want and {r[-1] for r in got} == {"finished", "failed", "never ended", "end without start"}


class Held:
    """A share's state without a stream."""

    def __init__(self, watermark):
        self.get, self.exists, self.watermark, self.timer = None, False, watermark, None

    def getCurrentWatermarkMs(self):
        return self.watermark

    def update(self, value):
        self.get, self.exists = value, True

    def remove(self):
        self.get, self.exists = None, False

    def setTimeoutTimestamp(self, at):
        self.timer = at


def test_one_call_pairs_all_names_of_a_share():
    step, state = _pair(100), Held(0)
    events = [("a", 10, 0, None), ("b", 20, 0, None), ("a", 30, 1, 0.0), ("c", 40, 1, 2.0), ("b", 500, 1, 0.0)]
    assert list(step((7,), iter([pd.DataFrame(events, columns=["name", "second", "kind", "rc"])]), state)) == [] and state.timer == 10_001
    state.watermark = 200_000
    (runs,) = step((7,), iter([]), state)
    runs = runs.astype(object).where(runs.notna(), None)
    assert sorted(map(tuple, runs.values.tolist()), key=str) == [("a", 10, 30, 0, "finished"), ("b", 20, None, None, "never ended"), ("c", None, 40, 2, "end without start")]
    state.watermark = 600_000
    (runs,) = step((7,), iter([]), state)
    assert runs["status"].tolist() == ["end without start"] and not state.exists


def test_distance_grids():
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abc😀ن") for _ in range(rnd.choice([0, 3, 3, 4, 5, 70])))
    a, b = [word() for _ in range(60)], [word() for _ in range(50)]
    for s in (1, 2):
        assert distance_grid(a, b, s).tolist() == [[_distance(x, y, s) for y in b] for x in a]


def test_sparse_pairing_equals_the_exact_programme():
    rnd = random.Random(5)
    for k in range(300):
        letters = "ab" if k % 2 else "abcdef"
        word = lambda: rnd.choice([None, "", "".join(rnd.choice(letters) for _ in range(rnd.randint(1, 5)))])  # noqa: B023, E731
        a, b = [word() for _ in range(rnd.randint(0, 14))], [word() for _ in range(rnd.randint(0, 14))]
        if rnd.random() < 0.5:
            b = [x if rnd.random() < 0.7 else word() for x in a]
        grid = np.array([[similarity(x, y) if x and y else 0.0 for y in b] for x in a]).reshape(len(a), len(b))
        for threshold in (0.0, 70.0):
            assert paired_sparsely(a, b, threshold, pairs=rnd.choice([1, 20, 10**6])) == paired(grid, threshold), (a, b)


def test_long_halves_in_one_task(spark):
    rnd = random.Random(6)
    labels = ["".join(rnd.choice("abcdefgh ") for _ in range(9)) for _ in range(1500)]
    other = [x[:-1] + "z" if rnd.random() < 0.3 else x for x in labels if rnd.random() < 0.9]
    rows = lambda names, mark: [("t", k, x, f"{mark}{x}") for k, x in enumerate(names)]
    schema = "k string, ord int, label string, text string"
    began = time.time()
    got = merge_halves(spark.createDataFrame(rows(labels, "l"), schema), spark.createDataFrame(rows(other, "r"), schema), ["k"]).collect()
    assert time.time() - began < 120
    joined = sum(" | " in r.text for r in got)
    assert len(got) == len(labels) + len(other) - joined and joined > 0.95 * len(other)
    with pytest.raises(ValueError, match="pairs of similar labels"):
        paired_sparsely(["x"] * 50, ["x"] * 50, 70.0, most=100)
