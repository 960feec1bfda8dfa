"""Snapshots in versions of hash buckets: a batch reads and rewrites only the buckets that it touches.

`snapshot/batch=n/_bucket=b` is the version of bucket b that batch n wrote. `manifest/batch=n` names, for each
bucket, the batch whose version holds after batch n, and the schema of the table; it has one row for each bucket,
whatever the size of the table. A batch that is run again reads the manifest before its own and
replaces what it wrote, so it gives the same table.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = "bucket int, version long, buckets int, schema string"


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _manifest(spark: SparkSession, folder: str, batch_id: int) -> list:
    """The rows of a manifest, one for each bucket that holds rows, or one without a bucket; none before the first batch."""
    if batch_id < 0:
        return []
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest/batch={batch_id}").collect()


def _read(spark: SparkSession, folder: str, rows: list, only: set[int] | None = None) -> DataFrame:
    schema = T.StructType.fromJson(json.loads(rows[0]["schema"]))
    paths = [f"{folder}/snapshot/batch={r['version']}/_bucket={r['bucket']}" for r in rows if r["bucket"] is not None and (only is None or r["bucket"] in only)]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read_snapshot(spark: SparkSession, folder: str, batch_id: int) -> DataFrame:
    """The table after a batch. Versions of the last two batches are kept."""
    return _read(spark, folder, _manifest(spark, folder, batch_id))


def merge_batch(
    rows: DataFrame,
    merge: Callable[[DataFrame | None, DataFrame], DataFrame],
    key: str,
    folder: str,
    batch_id: int,
    buckets: int = 64,
) -> None:
    """Write the versions of the touched buckets and the manifest, then drop versions no longer needed.

    merge: the new rows of some keys from their current ones (None: no table yet) and the batch's. The number of
    buckets is fixed by the first batch: choose it so that a bucket is a few files. Files of a bucket
    are split or merged by size, so a bucket with a hot key is no single task.
    """
    spark = rows.sparkSession
    known = _manifest(spark, folder, batch_id - 1)
    if known and known[0]["buckets"] != buckets:
        raise ValueError(f"the snapshot has {known[0]['buckets']} buckets, not {buckets}")
    # at most as many rows as there are buckets
    touched = {r["b"] for r in rows.select(bucket_of(key, buckets).alias("b")).distinct().collect()}
    before = _read(spark, folder, known, touched) if known else None
    merged = merge(before, rows)
    versions = merged.withColumn("_bucket", bucket_of(key, buckets)).hint("rebalance", "_bucket")
    versions.write.mode("overwrite").partitionBy("_bucket").parquet(f"{folder}/snapshot/batch={batch_id}")
    now = {r["bucket"]: r["version"] for r in known if r["bucket"] is not None} | {b: batch_id for b in touched}
    schema = merged.schema.json()
    manifest = [(b, v, buckets, schema) for b, v in sorted(now.items())] or [(None, None, buckets, schema)]
    spark.createDataFrame(manifest, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest/batch={batch_id}")
    _drop_before(spark, folder, batch_id - 1)


def _drop_before(spark: SparkSession, folder: str, batch_id: int) -> None:
    """Drop the manifest before a batch, and the versions that the batch replaced."""
    try:
        older = _manifest(spark, folder, batch_id - 1)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return
    if not older:
        return
    held = {(r["bucket"], r["version"]) for r in _manifest(spark, folder, batch_id)}
    gone = [f"snapshot/batch={r['version']}/_bucket={r['bucket']}" for r in older if r["bucket"] is not None and (r["bucket"], r["version"]) not in held]
    hadoop = spark._jvm.org.apache.hadoop.fs
    for name in [*gone, f"manifest/batch={batch_id - 1}"]:
        path = hadoop.Path(f"{folder}/{name}")
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
