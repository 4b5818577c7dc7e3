"""Previous-N statistics of a stream against plain loops."""

import datetime as dt
import random

from netprism.session import scratch_path
from netprism.streaming import flows as zs
from netprism.streaming import previous


def test_stream_equals_batch_and_restart_adds_nothing(spark):
    def mean_of(rows):
        return (sum(r[3] for r in rows) / len(rows) if rows else None, len(rows))

    rng = random.Random(1)
    start = dt.datetime(2024, 1, 1)
    rows = [(i, rng.choice([1, 1, 1, 2, 3]), start + dt.timedelta(seconds=rng.randrange(7200)), float(i % 11)) for i in range(400)]
    late = sorted(rows, key=lambda r: r[2] + dt.timedelta(seconds=rng.randrange(500)))  # out of order within the delay
    schema = "id long, who long, ts timestamp_ntz, v double"
    folder = scratch_path(spark, "prev-in")
    out, state = scratch_path(spark, "prev-out"), scratch_path(spark, "prev-state")

    def run():
        stream = zs.file_stream(spark, folder, spark.createDataFrame([], schema).schema, max_files_per_trigger=1)
        got = previous.previous_rows(stream, "who", "ts", ["id"], 5, mean_of, "prev_mean double, prev_rows int", "10 minutes")
        previous.run_previous_rows(spark, got, state, out)
        return {r["id"]: (r["who"], r["v"], r["prev_mean"], r["prev_rows"]) for r in spark.read.parquet(out).collect()}

    def expected(seen):
        mark = max(r[2] for r in seen) - dt.timedelta(minutes=10)
        want, by = {}, {}
        for r in sorted(seen, key=lambda r: (r[2], r[0])):
            before = by.setdefault(r[1], [])
            if r[2] < mark:
                want[r[0]] = (r[1], r[3], *mean_of(before[-5:]))
            before.append(r)
        return want

    for k in range(2):
        spark.createDataFrame(late[k * 150:(k + 1) * 150], schema).coalesce(1).write.mode("append").parquet(folder)
    got = run()
    assert got == expected(late[:300]) and got
    assert run() == got  # nothing new
    spark.createDataFrame(late[300:], schema).coalesce(1).write.mode("append").parquet(folder)
    got = run()
    assert got == expected(rows)
    assert len(spark.read.parquet(out).collect()) == len(got)
