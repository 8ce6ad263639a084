"""Session helpers shared by every part of the library."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table of a data folder; any path that Spark can open is fine."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df dealt by its keys to tasks of some `rows` rows each, and to the default parallelism at least.

    For small rows that much is made of: the number is given, as Spark would put many partitions of them together before that.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows)), *keys)


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, once per context, so that Python workers can import it."""
    sc = spark.sparkContext
    if getattr(sc, "_tallybook_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="tallybook-")) / "tallybook_package.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(_PACKAGE.rglob("*.py")):
            z.write(path, path.relative_to(_PACKAGE.parent))
    sc.addPyFile(str(archive))
    sc._tallybook_shipped = True


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    Only a session that runs in one process may do without: it gets a temporary folder. A cluster without a shared folder
    fails here, as its executors could not see each other's tables.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or getattr(sc, "_tallybook_scratch", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        root = sc._tallybook_scratch = tempfile.mkdtemp(prefix="tallybook-scratch-")
        sc.setCheckpointDir(root)
    return root


#: Spark then deletes an execution's shuffle files when it ends, rather than at some later garbage collection.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage and survives lost executors.

    by: columns that the table's folders are laid out by, so that a filter on them reads those folders only.
    """
    spark = df.sparkSession
    path = os.path.join(scratch_root(spark), f"tallybook-{name}-{uuid.uuid4().hex}")
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path, partitionBy=by)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._tallybook_path = path
    return out


def discarded(*tables: DataFrame) -> None:
    """Delete tables that written() gave and that nothing will read again; others are left alone."""
    for df in tables:
        path = df.__dict__.pop("_tallybook_path", None)
        if path:
            _delete(df.sparkSession, path)


def clear_scratch(spark: SparkSession) -> None:
    """Delete every table that written() left in the shared folder; results that still read them fail afterwards."""
    root = spark._jvm.org.apache.hadoop.fs.Path(os.path.join(scratch_root(spark), "tallybook-*"))
    for status in root.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(root) or []:
        _delete(spark, status.getPath().toString())


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
