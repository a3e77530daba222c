"""Snapshot streams, late rows and open windows over restarts; topics; steps of the calendar."""

import os
import random
import re
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rotorlens.operators import forecast as fc
from rotorlens.sources import messages as msg
from rotorlens.sources import snapshot_stream as ss
from rotorlens.sources import snapshots as sn
from rotorlens.streaming import streams as st


def snapshot(path, name, rng):
    x = rng.normal(size=(5, 4))
    np.savetxt(os.path.join(path, name), x, delimiter="\t", fmt="%.18e")
    return x


def test_snapshots_one_per_batch_in_the_order_of_their_names(spark, scratch):
    folder, out, ck = (os.path.join(scratch, n) for n in ("machine_3", "out", "ck"))
    os.makedirs(folder)
    rng, data = np.random.default_rng(1), {}
    for name in ("2004.02.12.10.52.39", "2004.02.12.10.32.39", "2004.02.12.10.42.39"):  # written out of order
        data[name] = snapshot(folder, name, rng)
    for junk in ("README.txt", "2004.13.40.10.32.39", "2004.02.12"):
        open(os.path.join(folder, junk), "w").write("1\t2\n")
    batches = []

    def write(batch, epoch):
        batches.append(sorted({r["file"] for r in batch.select("file").collect()}))
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    def run():
        before = len(batches)
        st.run_batches(ss.stream_snapshots(spark, folder, ck, files=1), write, ck)  # every run is a restart
        return len(batches) - before

    while run():
        pass
    assert batches == [[n] for n in sorted(data)]
    data["2004.02.12.11.02.39"] = snapshot(folder, "2004.02.12.11.02.39", rng)
    assert run() == 1 and run() == 0
    got = spark.read.parquet(out).drop("epoch")
    assert got.count() == 16 and {r["E"] for r in got.collect()} == {"machine_3"}
    for r in got.collect():
        assert np.array_equal(r["samples"], data[r["file"]][:, sn.CHANNELS.index(r["channel"])])
        assert r["T"] == ss.snapshot_time(r["file"])
    whole = sn.read_snapshots(spark, folder).select("file", "channel", "samples")
    assert sorted(map(str, whole.collect())) == sorted(map(str, got.select("file", "channel", "samples").collect()))
    with pytest.raises(ValueError):
        ss.SnapshotStreamReader({"path": folder, "files": "1"})
    everything = ss.stream_snapshots(spark, folder, equipment="m")
    st.run_to_table(everything, out + "2", ck + "2")
    assert spark.read.parquet(out + "2").count() == 16


def test_late_rows_survive_replay_and_restart(spark, scratch):
    out = os.path.join(scratch, "late")
    day = datetime(2024, 1, 2)
    rows = [[(1, day.replace(hour=10)), (2, day.replace(hour=9))], [(1, day.replace(hour=8)), (1, day.replace(hour=9, minute=30)), (3, None)],
            [(1, day.replace(hour=9, minute=10))]]
    frames = [spark.createDataFrame(r, "E long, T timestamp") for r in rows]
    write = st.late_data_writer(out, "1 hour")
    write(frames[0], 0)
    write(frames[1], 1)
    write(frames[1], 1)  # the batch is replayed
    st.late_data_writer(out, "1 hour")(frames[2], 2)  # another process goes on
    late = sorted(r["T"].hour * 60 + r["T"].minute for r in st.read_late(spark, out).collect())
    assert late == [8 * 60] and st.read_on_time(spark, out).count() == 5
    write(frames[0].limit(0), 3)
    assert st.read_on_time(spark, out).count() == 5


def test_topics_by_trie(spark):
    rng = random.Random(2)
    level = lambda: rng.choice(["a", "b", "c", "", "x.y"])
    topics = ["/".join(level() for _ in range(rng.randrange(1, 5))) for _ in range(120)] + ["", "a", None, "a/b/c/a/b/c"]
    patterns = {"#", "+", "a", "a/#", "+/#", "a/b/#", "+/+", "/+", "a/+/c", "x.y/+", "", "+/b/+/#", "a/b", "+/+/+/+/+/+"}
    patterns |= {"/".join(rng.choice(["a", "b", "+", ""]) for _ in range(rng.randrange(1, 4))) for _ in range(60)}
    patterns = sorted(patterns) + ["a/#"]  # one subscribed twice
    m = spark.createDataFrame([(i, t) for i, t in enumerate(topics)], "id long, topic string")
    got = sorted((r["id"], r["pattern"]) for r in msg.match_topics(m, msg.subscriptions_table(spark, patterns)).collect())
    want = sorted((i, p) for i, t in enumerate(topics) if t is not None for p in patterns if re.search(msg.topic_regex(p), t))
    assert got == want
    plan = msg.match_topics(m, msg.subscriptions_table(spark, patterns))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan
    assert msg.match_topics(m, msg.subscriptions_table(spark, ["a", "a/b"])).count() == sum(t in ("a", "a/b") for t in topics)
    with pytest.raises(ValueError):
        msg.subscriptions_table(spark, ["a/#/b"])


@pytest.mark.parametrize("freq,start,n", [("MS", "2023-11-01", 6), ("ME", "2023-10-31 06:00", 7), ("QS", "2023-01-01", 5), ("YS", "2019-01-01", 4),
                                          ("B", "2024-01-04", 9), ("B", "2024-01-03 08:30", 12), ("W", "2024-01-07", 5), ("7h", "2024-01-07", 5),
                                          ("D", "2024-02-26", 4), ("2MS", "2023-11-01", 4)])
def test_times_go_on_as_the_calendar_does(spark, freq, start, n):
    times = pd.date_range(start, periods=n + 8, freq=freq)
    df = spark.createDataFrame(pd.DataFrame({"E": 1, "T": times[:n], "v": np.arange(n, dtype=float)})).withColumn("T", F.col("T").cast("timestamp_ntz"))
    out = fc.forecast_rolling(df, ["E"], "T", "v", 8, window=3).orderBy("step").toPandas()
    assert list(out["T"]) == list(times[n:])


def test_times_without_a_step_go_on_hourly(spark):
    for days in ([1, 2, 4, 5], [1, 2], [5, 5, 5], [1]):
        rows = [(1, datetime(2024, 3, d), float(i)) for i, d in enumerate(days)]
        df = spark.createDataFrame(rows, "E long, T timestamp_ntz, v double")
        out = fc.forecast_rolling(df, ["E"], "T", "v", 2, window=3).orderBy("step").collect()
        assert [r["T"] for r in out] == [max(r[1] for r in rows) + timedelta(hours=h) for h in (1, 2)]

