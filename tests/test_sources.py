import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import sampling as P
from quillon.operators.graph import connected_components
from quillon.sources import records as U
from quillon.streaming import windows as W


def test_fasta_round_trip(spark, tmp_path):
    text = ">one first\nACGT\nAC\n>two\n\n>three\r\nGG GG\n"
    (tmp_path / "a.fa").write_text(text)
    want = [("one first", "ACGTAC"), ("three", "GG GG"), ("two", "")]
    assert sorted(tuple(r) for r in U.read_fasta(spark, str(tmp_path / "a.fa")).collect()) == want
    df = spark.createDataFrame([("head\n" + text,), ("",)], "t string")
    assert sorted(tuple(r.r) for r in df.select(F.explode(U.fasta_records(F.col("t"))).alias("r")).collect()) == want
    rows = spark.createDataFrame([("x", "A" * 130), ("y", "C")], "name string, seq string")
    U.write_fasta(rows, "name", "seq", str(tmp_path / "out"))
    assert sorted(tuple(r) for r in U.read_fasta(spark, str(tmp_path / "out")).collect()) == [("x", "A" * 130), ("y", "C")]


def test_archives_and_parameters(spark, tmp_path):
    x = np.arange(24, dtype=np.uint8).reshape(3, 4, 2)
    np.savez(tmp_path / "m.npz", x_train=x, y_train=np.array([5, 0, 4]))
    rows = U.read_npz(spark, str(tmp_path / "m.npz")).orderBy("id").collect()
    assert [r.label for r in rows] == [5, 0, 4] and np.allclose([r.features for r in rows], x.reshape(3, -1))
    p = U.read_params('{"delta": "1/8", "names": ["a/b", "1/2"], "in": {"x": "3/4", "y": "1/0"}}')
    assert p == {"delta": 0.125, "names": ["a/b", 0.5], "in": {"x": 0.75, "y": "1/0"}}
    assert U.read_params(U.write_params({"a": np.array([1, 2]), "b": np.float64(0.5)})) == {"a": [1, 2], "b": 0.5}


def test_tracks(spark, tmp_path):
    (tmp_path / "t.csv").write_text("timestamp,deployment_id,location_lat,location_long\n2020-01-01 00:00:00.5,d,1.5,2\nnever,d,,3\n")
    rows = U.gps(U.read_tracks(spark, str(tmp_path / "t.csv"))).collect()
    assert [(r.deployment_id, r.lat, r.lon) for r in rows] == [("d", 1.5, 2.0)]
    raw = spark.createDataFrame([("d", "2020-01-01 00:00:00.000", "2048 3048 1048 2049 2048 2048 7", "10"), ("e", "2020-01-01 00:00:00", "", "10")], "deployment_id string, timestamp string, eobs_accelerations_raw string, eobs_acceleration_sampling_frequency_per_axis string")
    rows = U.acceleration(raw, "g").orderBy("sample").collect()
    assert [(r.sample, round(r.x, 6), round(r.y, 6), round(r.z, 6), r.ts.microsecond) for r in rows] == [(0, 0, 1, -1, 0), (1, 0.001, 0, 0, 100_000)]
    with pytest.raises(KeyError):
        U.acceleration(raw, "feet")


def test_samplers(spark):
    x = np.array([r.x for r in P.chains(spark, 4, 2_500, P.gibbs_ball(6, 10.0, 50), 1).collect()])
    norms = np.linalg.norm(x, axis=1)
    assert len(x) == 10_000 and norms.max() <= 10 and abs((norms <= 5).mean() - 0.5**6) < 0.15 * 0.5**6 + 0.004
    beta = np.array([r.x[0] for r in P.chains(spark, 4, 2_000, P.rejection(lambda v: 6 * v * (1 - v), np.ones_like, lambda rng, n: rng.random(n), 1.5, np.linspace(0, 1, 50)), 2).collect()])
    assert abs(beta.mean() - 0.5) < 0.01 and abs(beta.var() - 0.05) < 0.005
    normal = np.array([r.x[0] for r in P.chains(spark, 8, 3_000, P.metropolis(lambda v: float(-0.5 * (v * v).sum()), np.zeros(1), 2.0, 100), 3).collect()])
    assert abs(normal.mean()) < 0.08 and abs(normal.std() - 1) < 0.06
    with pytest.raises(ValueError):
        P.rejection(lambda v: v + 2, np.ones_like, None, 1.0, np.linspace(0, 1, 5))
    same = [sorted(map(str, P.chains(spark, 3, 5, P.gibbs_ball(2), 7).collect())) for _ in range(2)]
    assert same[0] == same[1]


def test_generators():
    assert P.strands(5, 30, motif="GATTACA", seed=1).seq.str.contains("GATTACA").all() and set("".join(P.strands(5, 30, "RNA").seq)) <= set("AUGC")
    assert len(P.whirlpool(10)) == 10 and P.noisy_sine(5).x.between(0, 1).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (101, 100), (7, 7)]
    found = dict(connected_components(spark.createDataFrame(edges, "a int, b int")).collect())
    assert found == {**dict.fromkeys(range(41), 0), 90: 90, 100: 90, 101: 90}


def test_stream_counts_late_rows_in(spark, tmp_path):
    rows = [(i, f"2024-01-01 0{i % 3}:10:00", 1.0) for i in range(30)]
    df = spark.createDataFrame(rows, "event_id int, t string, value double").select("event_id", F.to_timestamp("t").alias("ts"), "value")
    df.repartition(5).write.parquet(str(tmp_path / "events.parquet"))
    stream = W.tumbling(W.event_stream(spark, str(tmp_path), files_a_trigger=1), "1 hour", "1 day", F.count(F.lit(1)).alias("n"))
    assert sorted(r.n for r in W.drained(stream, "test").collect()) == [10, 10, 10]


def test_scratch_tables_can_be_cleared(spark, tmp_path):
    from quillon.core import scratch

    df = scratch.stored(spark.range(3), "mine")
    assert df.count() == 3
    files = df.inputFiles()
    scratch.clear(spark)
    import os

    assert files and not any(os.path.exists(f.removeprefix("file://").removeprefix("file:")) for f in files)
