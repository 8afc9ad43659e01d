"""Parquet/CSV table access and sinks."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import TRIP_SCHEMA


def table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """Read one parquet table; selecting ``columns`` right away keeps the
    scan's ReadSchema narrow (Catalyst would prune too, this just says it)."""
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return df.select(*columns) if columns else df


def input_version(spark: SparkSession, sf_dir: str, names) -> tuple:
    """(path, length, modification time) of every file of some tables: changes
    whenever a file is added, replaced or removed."""
    jvm, conf, out = spark._jvm, spark._jsc.hadoopConfiguration(), []
    for name in names:
        path = jvm.org.apache.hadoop.fs.Path(os.path.join(sf_dir, f"{name}.parquet"))
        files = path.getFileSystem(conf).listFiles(path, True)
        while files.hasNext():
            f = files.next()
            out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(out))


def read_trips_csv(spark: SparkSession, path: str, schema=TRIP_SCHEMA) -> DataFrame:
    """Header CSV of trip summaries with an explicit schema (no inference)."""
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None, buckets: int | None = None,
                bucket_col: str | None = None) -> None:
    """Generic sink. Parquet by default; optional
    ``partition_by`` columns (e.g. trip_date) enable partition pruning and an
    optional hash bucket column spreads a big key over ``buckets`` directories."""
    out = df
    cols = list(partition_by or [])
    if buckets and bucket_col:
        out = out.withColumn("bucket", F.pmod(F.xxhash64(bucket_col), F.lit(buckets)))
        cols.append("bucket")
    w = out.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    if cols:
        w = w.partitionBy(*cols)
    w.save(path)


def write_driver_aggregates(drivers: DataFrame, path: str, buckets: int = 16, key: str = "driver_id") -> None:
    """Driver table, spread over ``buckets`` folders by a hash of the driver."""
    write_table(drivers, path, buckets=buckets, bucket_col=key)


def write_predictions(predictions: DataFrame, path: str, mode: str = "append") -> None:
    """Scored trips by risk category; batches are appended."""
    write_table(predictions, path, mode=mode, partition_by=["risk_category"])


def write_summary_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A summary of one row (or one per group) as JSON lines, nulls written out."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir.

    Read from the session first. Only when it is unset AND the session runs
    in local mode (tests, single-machine checks) a scratch folder is created;
    a cluster session without the setting is an error (a machine-local temp
    folder would not survive executor loss)."""
    sc = spark.sparkContext
    d = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set; configure a shared folder for this cluster")
        d = tempfile.mkdtemp(prefix="roadrisk-ckpt-", dir="/tmp")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint into spark.checkpoint.dir (survives executor loss;
    never a local checkpoint)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def drop_checkpoint(df: DataFrame) -> None:
    """Deletes the files of what `cut_lineage` returned; ``df`` can't be read after that."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(df._jdf.logicalPlan().rdd().getCheckpointFile().get())
    path.getFileSystem(conf).delete(path, True)
