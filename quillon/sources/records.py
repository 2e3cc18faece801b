"""Readers of sequence records, archives of arrays, parameter files and tracking data."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def fasta_fields(record: Column) -> Column:
    """struct(name, seq) of one record's text without its leading mark: the first line, and the others joined."""
    lines = F.split(record, "\r?\n")
    return F.struct(F.trim(lines[0]).alias("name"), F.array_join(F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: F.trim(x)), "").alias("seq"))


def fasta_records(text: Column, mark: str = ">") -> Column:
    """Array of struct(name, seq) of a column that holds whole files; lines before the first mark are left out."""
    parts = F.split(F.concat(F.lit("\n"), text), rf"\n\Q{mark}\E")
    return F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: fasta_fields(p))


def read_fasta(spark: SparkSession, path: str, mark: str = ">") -> DataFrame:
    """(name, seq) of files of any size: the mark at a line's start is the record separator, so files split."""
    rows = spark.read.option("lineSep", f"\n{mark}").text(path)
    body = F.regexp_replace("value", rf"^\Q{mark}\E", "")
    return rows.where(F.trim(F.col("value")) != "").select(fasta_fields(body).alias("r")).select("r.name", "r.seq")


def write_fasta(df: DataFrame, name: str, seq: str, path: str, width: int = 60) -> None:
    """Records as text, lines of at most `width` characters."""
    lines = F.regexp_replace(F.col(seq), f"(.{{{width}}})(?=.)", "$1\n")
    df.select(F.concat(F.lit(">"), F.col(name), F.lit("\n"), lines).alias("value")).write.text(path)


def record_sequence(page: Column) -> Column:
    """The letters of a database record's ORIGIN section, numbers and blanks left out, in upper case; null without one."""
    section = F.regexp_extract(page, r"(?s)ORIGIN(.*?)//", 1)
    return F.when(section != "", F.upper(F.regexp_replace(section, r"[\d\s]", "")))


def read_npz(spark: SparkSession, path: str, arrays: tuple[str, str] = ("x_train", "y_train")) -> DataFrame:
    """(id, features, label) of an archive with an array of rows and one of labels; one task reads a file."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for raw in part.content:
                with np.load(io.BytesIO(raw), allow_pickle=False) as z:
                    x, y = z[arrays[0]], z[arrays[1]]
                flat = x.reshape(len(x), -1).astype(float)
                for at in range(0, len(x), 1_000):
                    rows = slice(at, at + 1_000)
                    yield pd.DataFrame({"id": range(at, at + len(flat[rows])), "features": list(flat[rows]), "label": y[rows].astype(int)})

    return files.mapInPandas(run, "id long, features array<double>, label long")


def read_params(text: str) -> dict:
    """JSON parameters, with fractions such as '1/8' as numbers."""

    def value(v):
        if isinstance(v, dict):
            return {k: value(x) for k, x in v.items()}
        if isinstance(v, list):
            return [value(x) for x in v]
        if isinstance(v, str) and "/" in v:
            try:
                return float(Fraction(v))
            except (ValueError, ZeroDivisionError):
                return v
        return v

    return {k: value(v) for k, v in json.loads(text).items()}


def write_params(params: dict) -> str:
    """Arrays as lists, numpy numbers as numbers."""
    return json.dumps(params, default=lambda v: v.tolist() if hasattr(v, "tolist") else str(v), indent=2)


def read_tracks(spark: SparkSession, path: str) -> DataFrame:
    """Event listings with a header line, all columns as text."""
    return spark.read.option("header", True).csv(path)


def by_sensor(studies: DataFrame, sensor: str = "GPS") -> DataFrame:
    """Studies whose sensor types mention a sensor."""
    return studies.where(F.contains(F.col("sensor_type_ids"), F.lit(sensor)))


def gps(events: DataFrame) -> DataFrame:
    """(deployment_id, ts, lat, lon) of raw rows; what does not parse is null, rows without a place are left out."""
    rows = events.select("deployment_id", F.try_to_timestamp("timestamp").alias("ts"), F.col("location_lat").try_cast("double").alias("lat"), F.col("location_long").try_cast("double").alias("lon"))
    return rows.where("lat is not null and lon is not null")


#: Fixed values (U12): the acceleration of gravity, and the zero and slope of raw counts by sensitivity.
GRAVITY = 9.81
SLOPES = {"high": (2048.0, 0.001), "low": (2048.0, 0.0027)}


def acceleration(events: DataFrame, unit: str = "m/s2", sensitivity: str = "high") -> DataFrame:
    """(deployment_id, sample, ts, x, y, z) of bursts of raw counts 'x y z x y z ...' at a rate per axis.

    Samples follow the burst's time at the rate; counts become multiples of gravity, or m/s2.
    """
    if sensitivity not in SLOPES or unit not in ("m/s2", "g"):
        raise KeyError("sensitivity is 'high' or 'low', unit 'm/s2' or 'g'")
    zero, slope = SLOPES[sensitivity]
    factor = slope * (GRAVITY if unit == "m/s2" else 1.0)
    counts = F.split(F.trim("eobs_accelerations_raw"), r"\s+")
    rows = events.select("deployment_id", F.try_to_timestamp("timestamp").alias("t0"), F.col("eobs_acceleration_sampling_frequency_per_axis").try_cast("double").alias("rate"), counts.alias("c"))
    long = rows.select("deployment_id", "t0", "rate", "c", F.explode(F.when(F.size("c") >= 3, F.sequence(F.lit(0), F.floor(F.size("c") / 3).cast("int") - 1))).alias("sample"))
    axis = lambda k: ((F.get("c", F.col("sample") * 3 + k).try_cast("double") - F.lit(zero)) * F.lit(factor))
    later = F.col("t0") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("sample") / F.col("rate")).cast("decimal(18,6)"))
    return long.select("deployment_id", "sample", later.alias("ts"), axis(0).alias("x"), axis(1).alias("y"), axis(2).alias("z"))
