"""Steps that ran too often or shuffled too much."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from rotorlens.model import to_wide
from rotorlens.operators import alerts as al
from rotorlens.operators import warning as ew
from rotorlens.sources import snapshot_stream as ss


def test_to_wide_shuffles_once(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "b", None), (2, "b", 3.0), (None, "a", 4.0), (3, "x", 5.0)], "i long, M string, V double")
    wide = to_wide(df, ["i"], ["a", "b"])
    assert wide.columns == ["i", "a", "b"]
    assert {tuple(r) for r in wide.collect()} == {(1, 1.0, None), (2, None, 3.0), (None, 4.0, None), (3, None, None)}
    assert wide._jdf.queryExecution().sparkPlan().toString().count("Aggregate(") == 2  # partial and final


def test_greedy_keep_reads_its_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    t0 = datetime(2024, 1, 1)
    rows = spark.createDataFrame([(e, t0 + timedelta(minutes=i), i) for e in (1, None) for i in range(40)], "E long, T timestamp, ord long")
    kept = al.greedy_keep(rows.mapInPandas(count, rows.schema), ["E"], ["T", "ord"], F.col("T"), "15 minutes")
    numbered = al.assign_ids(kept, ["T", "ord"])
    assert sorted((r.E or 0, r.ord) for r in numbered.collect()) == [(e, i) for e in (0, 1) for i in (0, 15, 30)]
    assert seen.value == 80


def test_snapshot_tasks_hold_many_files(tmp_path):
    at = tmp_path / "in"
    at.mkdir()
    names = [(datetime(2024, 1, 1) + timedelta(minutes=i)).strftime("%Y.%m.%d.%H.%M.%S") for i in range(100)]
    for i, n in enumerate(names):
        (at / n).write_text(f"{i}\t1\n\n2\n")
    reader = ss.SnapshotStreamReader({"path": str(at)})
    parts = reader.partitions({"file": names[9]}, {"file": names[-1]})
    assert len(parts) <= ss.SPREAD and [n for p in parts for n in p.value] == names[10:]
    rows = [r for p in parts for r in reader.read(p)]
    assert [r[2] for r in rows[::2]] == names[10:] and rows[0][4] == [10.0, 2.0] and rows[1][4] == [1.0, None]
    assert reader.partitions({"file": names[-1]}, {"file": names[-1]}) == []


def test_predictions_need_no_array_expressions(spark):
    rows = [(30.0, 0.5, 10.0, 25.0, 12.0, 1.0, 26.0), (30.0, -0.5, 10.0, 5.0, 12.0, 1.0, 26.0), (30.0, 0.001, 10.0, 25.0, 12.0, 1.0, 26.0),
            (30.0, 0.5, 10.0, 25.0, 12.0, None, 26.0), (30.0, 0.5, 10.0, 25.0, 12.0, 1.0, None), (10.0, 0.5, 10.0, 25.0, 12.0, 1.0, 26.0)]
    df = spark.createDataFrame(rows, "n double, b double, a double, cur double, m double, s double, w double")
    c = F.col
    out = ew.add_prediction(df, "p", c("n"), c("b"), c("a"), c("cur"), c("m"), c("s"), c("w"), F.lit("v"), c("n") >= 20)
    assert out.columns == [*df.columns, "p"]
    assert "lambda" not in out._jdf.queryExecution().optimizedPlan().toString()
    for r in out.collect():
        want = None
        higher = None if r.m is None else r.cur > r.m
        if r.n >= 20 and r.w is not None and ((higher and r.b > 0) or (not higher and r.b <= 0)):
            for h in ew.HORIZONS:
                pred = r.a + r.b * (r.n + int(h * max(1.0, r.n / 24.0)))
                prox = abs(r.cur - r.w) / (abs(pred - r.cur) + 0.001)
                conf = 1.0 if r.s is None else min(1.0, abs(r.b) / (r.s + 0.001) * 0.5 + 0.5 / (prox + 1.0))
                if (pred > r.w if higher else pred < -r.w) and conf >= ew.CONFIDENCE_THRESHOLD:
                    want = (float(h), conf, pred)
                    break
        assert (r.p is None) == (want is None)
        if want:
            assert (r.p.predicted_time_hours, r.p.confidence, r.p.predicted_value) == want and r.p.metric == "v" and r.p.threshold == r.w
