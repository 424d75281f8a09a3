import time

from pyspark.sql import functions as F

from reelloom.streaming.workers import every, on_arrival


def until(done, seconds=60):
    end = time.monotonic() + seconds
    while not done() and time.monotonic() < end:
        time.sleep(0.1)
    assert done()


def test_runs_repeat_and_missed_ticks_are_skipped(spark, tmp_path):
    runs = []

    def step(number):
        runs.append((number, time.monotonic()))
        if len(runs) == 2:
            time.sleep(2.2)

    query = every(spark, 0.5, step, str(tmp_path / "c"), "steps")
    try:
        until(lambda: len(runs) >= 4)
    finally:
        query.stop()
    assert [n for n, _ in runs] == list(range(len(runs)))
    assert runs[2][1] - runs[1][1] >= 2.2  # not caught up in between


def test_steps_see_what_arrived(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("one\ntwo\n")
    seen = []
    stream = spark.readStream.schema("value string").text(str(tmp_path / "in"))
    query = on_arrival(stream, 0.3, lambda df, n: seen.append(sorted(r.value for r in df.select(F.upper("value").alias("value")).collect())), str(tmp_path / "c"), "arrivals")
    try:
        until(lambda: seen)
        (tmp_path / "in/b.txt").write_text("three\n")
        until(lambda: len(seen) > 1)
    finally:
        query.stop()
    assert seen[:2] == [["ONE", "TWO"], ["THREE"]]
