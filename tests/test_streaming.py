"""Streams end in what batches give; retried micro-batches change nothing."""

from pyspark.sql import Row
from pyspark.sql import functions as F

from folioscope.plans import streams as plans
from folioscope.streaming import progress, runs


def test_stream_equals_batch(spark, sf_dir):
    batch = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("user_id").alias("run_id"), F.col("ts").cast("timestamp").alias("at"), F.expr(plans.STATUS).alias("status"))
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(plans.stream_run_state(spark, sf_dir)) == key(runs.run_states(batch).select("run_id", "status", "changes"))
    assert key(plans.stream_windows(spark, sf_dir)) == key(runs.windowed_counts(batch).select(F.date_format("start", "yyyy-MM-dd"), "status", "n"))


def test_batch_writer_replaces_its_own_part(spark, tmp_path):
    path = str(tmp_path / "out")
    write = runs.batch_writer(path)
    rows = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (1, "c", 2)], "id int, v string, ord int")
    write(rows.where("ord = 1"), 0)
    write(rows.where("ord = 2"), 1)
    write(rows.where("ord = 2"), 1)
    table = spark.read.parquet(path)
    assert table.count() == 3
    assert sorted((r["id"], r["v"]) for r in runs.latest(table, "id", ["ord"]).collect()) == [(1, "c"), (2, "b")]


class Held:
    """State of one run in memory, which counts the calls to it."""

    def __init__(self):
        self.maps, self.value, self.timers, self.calls = {}, None, [], 0
        self.getMapState = self.getValueState = lambda *_: self
        self.containsKey, self.getValue, self.listTimers = self.maps.__contains__, self.maps.__getitem__, lambda: self.timers
        self.exists, self.get = lambda: self.value is not None, lambda: self.value
        self.registerTimer, self.deleteTimer = self.timers.append, self.timers.remove

    def update(self, value):
        self.value = value

    def updateValue(self, key, value):
        self.maps[key] = value
        self.calls += 1


def test_pages_share_entries_of_the_state():
    """100 pages take two updates of the state, not 100; late events and repeated ones change nothing, later ones move their page."""
    held, run = Held(), progress.Progress(1000)
    run.init(held)
    event = lambda i, page, ok, expected=None: Row(run_id=7, event_id=i, at=None, page=page, ok=ok, expected=expected, _ms=i)
    told = lambda rows: [tuple(r) for r in run.handleInputRows((7,), iter(rows), None)]
    assert told([event(100 + i, i, i % 4 > 0, 101) for i in range(100)]) == [(7, 1, 75, 25, 101, "running")]
    assert held.calls == 2 and held.timers == [199 + 1000]
    assert told([event(104, 4, False), event(50, 5, False), event(300, 8, True), event(299, 8, False)]) == [(7, 2, 76, 24, 101, "running")]
    assert told([event(301, 100, True)]) == [(7, 3, 77, 24, 101, "finished")] and held.timers == []
