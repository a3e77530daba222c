"""Snapshot files, topic filters, the greedy thinning rule and the alert
candidates."""

import os

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st_
from pyspark.sql import functions as F

from rotorlens.operators import alerts as al
from rotorlens.sources import messages as msg
from rotorlens.sources import snapshots as sn


def test_read_snapshots(spark, scratch):
    d = os.path.join(scratch, "bearing_test")
    os.makedirs(d)
    rng = np.random.default_rng(42)
    names = ["2004.02.12.10.32.39", "2004.02.12.10.42.39", "2004.02.12.10.52.39"]
    data = {}
    for name in names:
        x = rng.normal(size=(50, 4))
        data[name] = x
        np.savetxt(os.path.join(d, name), x, delimiter="\t")
    with open(os.path.join(d, "README.txt"), "w") as f:
        f.write("not a snapshot\n")
    s = sn.read_snapshots(spark, d)
    pdf = s.toPandas()
    assert len(pdf) == 12 and set(pdf.E) == {"bearing_test"}
    row = pdf[(pdf.file == names[1]) & (pdf.channel == "bearing3")].iloc[0]
    assert np.allclose(row.samples, data[names[1]][:, 2])
    info = sn.dataset_info(s).first()
    assert info.n_files == 3 and abs(info.duration_hours - 1 / 3) < 1e-9
    assert sn.slice_snapshots(s, 1, 3).select("T").distinct().count() == 2
    assert sn.failure_region(s, 1).select("file").distinct().first()[0] == names[-1]


def test_topic_filters():
    cases = [("equipment/+/sensors", "equipment/7/sensors", True),
             ("equipment/+/sensors", "equipment/7/alerts", False),
             ("equipment/#", "equipment", True),
             ("equipment/7/#", "equipment", False),
             ("equipment/7/#", "equipment/7/alerts/x", True),
             ("#", "anything/at/all", True),
             ("+/7/health", "equipment/7/health", True)]
    import re
    for pattern, topic, want in cases:
        assert bool(re.search(msg.topic_regex(pattern), topic)) == want, (pattern, topic)


def greedy_python(xs, gap):
    kept, last = [], None
    for x in xs:
        if last is None or x >= last + gap:
            kept.append(x)
            last = x
    return kept


@settings(max_examples=5, deadline=None)
@given(st_.lists(st_.integers(min_value=0, max_value=400), min_size=1, max_size=60, unique=True))
def test_greedy_keep_equals_loop(spark, xs):
    xs = sorted(xs)
    df = spark.createDataFrame([(1, x) for x in xs], "E long, p long")
    got = sorted(r.p for r in al.greedy_keep(df, ["E"], ["p"], F.col("p"), 25).collect())
    assert got == greedy_python(xs, 25)


def test_check_thresholds_order_and_levels(spark):
    df = spark.createDataFrame([(1, 1, 0.3, 5.0, 60.0), (1, 2, 0.2, 1.0, 90.0)],
                               "E long, i long, rms double, kurtosis double, temperature double")
    th = al.thresholds_table(spark)
    c = al.check_thresholds(df, ["E"], ["i"], ["rms", "kurtosis", "temperature"], th).orderBy("i", "ord")
    got = [(r.i, r.metric, r.severity) for r in c.collect()]
    assert got == [(1, "rms", "critical"), (1, "kurtosis", "critical"), (2, "rms", "warning"),
                   (2, "temperature", "critical")]
    msgs = [r.message for r in c.collect()]
    assert msgs[0] == "rms is at critical level: 0.30"


def test_greedy_keep_chunked_equals_plain(spark):
    rng = np.random.default_rng(7)
    xs = np.unique(rng.integers(0, 5000, size=900))
    df = spark.createDataFrame([(1, int(x)) for x in xs] + [(2, int(x)) for x in xs[:40]],
                               "E long, p long")
    plain = sorted(tuple(r) for r in al.greedy_keep(df, ["E"], ["p"], F.col("p"), 25).collect())
    chunk = sorted(tuple(r) for r in al.greedy_keep(df, ["E"], ["p"], F.col("p"), 25,
                                                    chunk_rows=97).collect())
    assert plain == chunk
    assert [p for e, p in plain if e == 1] == greedy_python(list(xs), 25)


def test_assign_ids_skew_safe(spark):
    from datetime import datetime, timedelta
    t0 = datetime(2024, 1, 1)
    rows = [(1, t0 + timedelta(minutes=7 * i), i % 3) for i in range(300)] + \
           [(2, t0 + timedelta(minutes=5 * i), 0) for i in range(10)]
    df = spark.createDataFrame(rows, "E long, T timestamp, ord int")
    a = sorted(tuple(r) for r in al.assign_ids(df).collect())
    b = sorted(tuple(r) for r in al.assign_ids(df, chunk_rows=37).collect())
    assert a == b
