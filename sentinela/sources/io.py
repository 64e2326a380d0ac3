"""Readers and writers."""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentinela import constants as K
from sentinela.operators.clean import parse_timestamps, to_numbers
from sentinela.schema import apply_aliases, normalize_columns

METRICS_SCHEMA = "run_id string, metric string, value double, ts timestamp"
PUBLISHED_SCHEMA = "folder string, run_id string, ts timestamp"


def read_incidents(spark: SparkSession, path: str, fmt: str = "csv", schema: T.StructType | None = None,
                   sep: str = ",") -> DataFrame:
    """S1 (+S2, P1, P6): header CSV (or Parquet); columns normalised and
    aliased; timestamps and coordinates coerced (bad text → NULL).

    Without an explicit schema CSV columns are read as text and coerced by
    the operators, rather than by a sampling ``inferSchema`` pass over the
    whole input.
    """
    if fmt == "parquet":
        return coerced(spark.read.parquet(path))
    r = _csv(spark, sep)
    return coerced(r.schema(schema).csv(path) if schema is not None else r.csv(path))


def _csv(spark: SparkSession, sep: str):
    return spark.read.option("header", True).option("sep", sep).option("mode", "PERMISSIVE")


def coerced(df: DataFrame) -> DataFrame:
    """Normalised and aliased columns; timestamps, coordinates and counts from text (bad text → NULL)."""
    df = apply_aliases(normalize_columns(df))
    df = parse_timestamps(df, [K.TS])
    df = to_numbers(df, [K.LAT, K.LON])
    for c in (K.AGE, K.VICTIMS, K.SUSPECTS):
        if c in df.columns and df.schema[c].dataType == T.StringType():
            df = df.withColumn(c, F.col(c).try_cast("int"))
    return df


def read_with_rejects(spark: SparkSession, path: str, sep: str = ",") -> tuple[DataFrame, DataFrame]:
    """S1 with an account of every line: (incidents, rejects).

    ``rejects`` (linha) holds the text of the lines whose number of fields is
    not the header's; ``read_incidents`` would fill such lines up with NULLs or
    cut them off.  Incidents and rejects together are all lines but the headers
    and blank ones.  The columns are those of the header; every line is parsed
    whole, so both tables read all columns of the files.
    """
    header = _csv(spark, sep).csv(path).schema
    bad = "_linha"
    whole = T.StructType([*header.fields, T.StructField(bad, T.StringType())])
    rows = _csv(spark, sep).option("columnNameOfCorruptRecord", bad).option("columnPruning", False).schema(whole).csv(path)
    # Spark reads the malformed line only beside a column of the file: a condition that always holds names one.
    beside = F.length(F.concat_ws("", F.col(bad), F.col(f"`{header.fields[0].name}`"))) >= 0
    rejects = rows.where(F.col(bad).isNotNull() & beside).select(F.col(bad).alias("linha"))
    return coerced(rows.where(F.col(bad).isNull() & beside).drop(bad)), rejects


def with_key(df: DataFrame, key: str = K.ID) -> DataFrame:
    """A row key for a table without one: a 63-bit hash of all columns.

    Made after de-duplication (F9) its rows differ, so the key names a row, is
    the same in every run and needs no shuffle.  An existing key stays.
    """
    if key in df.columns:
        return df
    row = F.xxhash64(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\u0000")) for c in sorted(df.columns)])
    return df.withColumn(key, row.bitwiseAND(F.lit((1 << 63) - 1)))


def read_upload_or_default(spark: SparkSession, upload_path: str | None, default_path: str,
                           fmt: str = "csv") -> tuple[DataFrame, list[str]]:
    """S3: an uploaded table must hold the five required columns; otherwise the
    default table is used.  Returns (table, missing columns of the upload)."""
    from sentinela.schema import UPLOAD_REQUIRED, missing_columns
    if upload_path:
        up = read_incidents(spark, upload_path, fmt)
        miss = missing_columns(up, UPLOAD_REQUIRED)
        if not miss:
            return up, []
        return read_incidents(spark, default_path, fmt), miss
    return read_incidents(spark, default_path, fmt), []


def write_results(df: DataFrame, path: str, metrics: dict[str, float] | None = None, run_id: str | None = None,
                  partition_by: tuple[str, ...] = ("ano", "mes")) -> str:
    """Labelled table as Parquet (partitioned by year and month when present,
    so date filters prune files) and the run's metrics, as one run.

    A run has its own folder below ``path/runs``; only when table and metrics
    are written is it published, by one row in ``path/published``.  So readers
    see either all of a run or the one before it, and earlier runs stay.
    """
    spark = df.sparkSession
    run_id = run_id or datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%S")
    folder = f"{run_id}-{uuid.uuid4().hex}"
    # an empty table is written without partitions: their folders would hold no file and no schema
    parts = [c for c in partition_by if c in df.columns and not df.isEmpty()]
    # rebalanced by year and month: few files in each, large months split over several
    w = (df.hint("rebalance", *parts) if parts else df).write
    (w.partitionBy(*parts) if parts else w).parquet(f"{path}/runs/{folder}/table")
    now = datetime.now(timezone.utc).replace(tzinfo=None)
    rows = [(run_id, k, float(v) if v is not None else None, now) for k, v in (metrics or {}).items()]
    spark.createDataFrame(rows, METRICS_SCHEMA).write.parquet(f"{path}/runs/{folder}/metrics")
    spark.createDataFrame([(folder, run_id, now)], PUBLISHED_SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/published")
    return run_id


def read_results(spark: SparkSession, path: str, run_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Table and metrics (no rows if the run had none) of the run published last, or last under ``run_id``.

    A path without a published run, or without that one, raises.
    """
    runs = spark.read.schema(PUBLISHED_SCHEMA).parquet(f"{path}/published")
    found = (runs if run_id is None else runs.where(F.col("run_id") == run_id)).agg(F.max_by("folder", F.struct("ts", "folder"))).first()[0]
    if found is None:
        raise FileNotFoundError(f"no published run {run_id or ''} in {path}")
    return spark.read.parquet(f"{path}/runs/{found}/table"), spark.read.schema(METRICS_SCHEMA).parquet(f"{path}/runs/{found}/metrics")


def export_csv(df: DataFrame, path: str) -> None:
    """Rows to CSV with a header (one directory of part files)."""
    df.write.mode("overwrite").option("header", True).csv(path)


def save_model(model: PipelineModel, path: str, metadata: dict) -> None:
    """Fitted pipeline plus a one-row JSON metadata table (features, model
    type, zones, weekdays, CV scores, report)."""
    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(json.dumps(metadata, default=str),)], "meta string") \
        .write.mode("overwrite").json(f"{path}/metadata")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, dict]:
    """Reload the pipeline and its metadata."""
    model = PipelineModel.load(f"{path}/model")
    row = spark.read.json(f"{path}/metadata").first()
    return model, json.loads(row["meta"]) if row else {}
