"""Records, tracks and samplers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from quillon.core.session import table
from quillon.operators import sampling as P
from quillon.queries._registry import query, r6
from quillon.sources import records as U


@query("fasta_records", "SELECT c_custkey, 'name ' || c_name AS name, replace(c_name, '#', '') || c_mktsegment AS seq FROM customer")
def fasta_records(spark, sf_dir):
    """A file text with one record for each customer, in two lines, parsed again."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("; comment\n>name "), "c_name", F.lit("\n"), F.replace("c_name", F.lit("#"), F.lit("")), F.lit("\n"), "c_mktsegment", F.lit("\n")).alias("text"))
    return rows.select("c_custkey", F.explode(U.fasta_records(F.col("text"))).alias("r")).select("c_custkey", "r.name", "r.seq")


@query("record_sequence", "SELECT p_partkey, upper(replace(p_name, ' ', '')) AS seq FROM part")
def record_sequence(spark, sf_dir):
    """U04"""
    page = F.concat(F.lit("LOCUS x\nORIGIN\n  1 "), "p_name", F.lit("\n//\n"))
    return table(spark, sf_dir, "part").select("p_partkey", U.record_sequence(page).alias("seq"))


@query("gps_parse", "SELECT user_id AS deployment_id, ts, round(value / 10, 6) + 0 AS lat, round(value / 5, 6) + 0 AS lon FROM events WHERE event_type <> 'error'")
def gps_parse(spark, sf_dir):
    """Events as raw text rows; errors have no place."""
    events = table(spark, sf_dir, "events")
    place = lambda d: F.when(F.col("event_type") == "error", "").otherwise((F.col("value") / d).cast("string"))
    raw = events.select(F.col("user_id").alias("deployment_id"), F.col("ts").cast("string").alias("timestamp"), place(10).alias("location_lat"), place(5).alias("location_long"))
    found = U.gps(raw)
    return found.select("deployment_id", F.col("ts").cast("timestamp_ntz").alias("ts"), r6(F.col("lat")).alias("lat"), r6(F.col("lon")).alias("lon"))


@query(
    "acc_interpolate",
    """WITH e AS (SELECT event_id, ts, floor(value)::INTEGER AS v FROM events) SELECT event_id AS deployment_id, s::INTEGER AS sample, ts + to_microseconds((s * 50000)::BIGINT) AS ts,
    round((v + s - 2048) * 0.001::DOUBLE * 9.81::DOUBLE, 6) + 0 AS x, round((v * 2 - 2048) * 0.001::DOUBLE * 9.81::DOUBLE, 6) + 0 AS y, round((2048 - 2048) * 0.001::DOUBLE * 9.81::DOUBLE, 6) + 0 AS z FROM e, range(3) t(s)""",
)
def acc_interpolate(spark, sf_dir):
    """Bursts of three samples at 20 a second."""
    v = F.floor("value").cast("int")
    counts = F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda s: F.array((v + s).cast("string"), (v * 2).cast("string"), F.lit("2048")))), " ")
    raw = table(spark, sf_dir, "events").select(F.col("event_id").alias("deployment_id"), F.col("ts").cast("string").alias("timestamp"), F.lit("20.0").alias("eobs_acceleration_sampling_frequency_per_axis"), counts.alias("eobs_accelerations_raw"))
    found = U.acceleration(raw)
    return found.select("deployment_id", "sample", F.col("ts").cast("timestamp_ntz").alias("ts"), *(r6(F.col(c)).alias(c) for c in "xyz"))


@query("studies_by_sensor", "SELECT p_partkey, p_type AS sensor_type_ids FROM part WHERE contains(p_type, 'MO')")
def studies_by_sensor(spark, sf_dir):
    """U08"""
    return U.by_sensor(table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("sensor_type_ids")), "MO")


# -- samplers


@query("rejection_sample")
def rejection_sample(spark, sf_dir):
    """Beta(2, 2) under a uniform proposal."""
    p, q = lambda x: 6 * x * (1 - x), lambda x: np.ones_like(x)
    return P.chains(spark, 8, 500, P.rejection(p, q, lambda rng, n: rng.random(n), 1.5, np.linspace(0, 1, 101)), 1)


@query("metropolis_sample")
def metropolis_sample(spark, sf_dir):
    """A standard normal."""
    return P.chains(spark, 8, 500, P.metropolis(lambda x: float(-0.5 * (x * x).sum()), np.zeros(1), 1.0, 100), 2)


@query("gibbs_sample")
def gibbs_sample(spark, sf_dir):
    """The ball of radius 10 in 6 dimensions."""
    return P.chains(spark, 8, 500, P.gibbs_ball(6, 10.0, 20), 3)


@query("generators")
def generators(spark, sf_dir):
    """Rows of each generator."""
    made = {"sine": P.noisy_sine(30), "blobs": P.blobs(200, 3), "cakes": P.cakes(300, 6), "whirlpool": P.whirlpool(150), "strands": P.strands(100, 50, motif="GATTACA")}
    return spark.createDataFrame([(k, len(v)) for k, v in made.items()], "name string, n int")
