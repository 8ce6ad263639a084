"""Files as a relation: what is in a folder, which of several places holds a file, what nothing refers to; written, copied and deleted in tasks.

Paths are URIs that Spark and Arrow's file systems both open (local files, HDFS, object stores). Every action is repeatable: a task that runs again does the same again.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OUTCOME = "path string, done boolean, reason string"


LISTED = "path string, name string, size long, modified timestamp"


def listing(spark: SparkSession, path: str) -> DataFrame:
    """path, name, size and modified of every file below a folder, empty ones too; no content is read, a folder that is not there has no rows.

    The driver looks at the folder's own entries only; what is below each of them is listed by tasks.
    """
    from pyarrow import fs

    system, root = opened(path)
    before = path[: len(path) - len(root)]
    entries = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
    folders = spark.createDataFrame([(before + e.path,) for e in entries] or [(before + root + "/",)], "path string")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for place in frame["path"]:
                system, at = opened(place)
                here = system.get_file_info(at.rstrip("/"))
                found = [here] if here.is_file else system.get_file_info(fs.FileSelector(at.rstrip("/"), recursive=True, allow_not_found=True))
                rows = [(before + f.path, f.base_name, f.size, f.mtime) for f in found if f.is_file]
                out = pd.DataFrame(rows, columns=["path", "name", "size", "modified"])
                out["modified"] = pd.to_datetime(out["modified"], utc=True)
                yield out

    return folders.repartition(max(1, min(len(entries), 1024)), "path").mapInPandas(run, LISTED)


def first_existing(candidates: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """key, place, path and size of the first candidate (key, place, path) of each key that is among files; no row without one."""
    met = candidates.join(files.select("path", "size"), "path")
    return met.groupBy(key).agg(F.min(F.struct("place", "path", "size")).alias("_f")).select(key, "_f.*")


def orphans(files: DataFrame, references: DataFrame) -> DataFrame:
    """Files that no reference (path) names."""
    return files.join(references.select("path"), "path", "left_anti")


def opened(path: str) -> tuple[object, str]:
    """Arrow's file system for a path as Spark lists it, with nothing escaped, and the path in it."""
    from urllib.parse import quote

    from pyarrow import fs

    return fs.FileSystem.from_uri(quote(re.sub(r"^file:/(?!/)", "file:///", path), safe="/:@"))


def _each(rows: DataFrame, act: Callable[..., None]) -> DataFrame:
    """One outcome for each row; its first column is the path that is told. A row that fails says why, and the others go on."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False, name=None):
                try:
                    act(*row)
                    out.append((row[0], True, None))
                except (OSError, ValueError, KeyError) as e:
                    out.append((row[0], False, type(e).__name__))
            yield pd.DataFrame(out, columns=["path", "done", "reason"])

    return rows.mapInPandas(run, OUTCOME)


def _write(path: str, content: object) -> None:
    system, at = opened(path)
    system.create_dir(at.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(at) as f:
        f.write(content.encode() if isinstance(content, str) else bytes(content or b""))


def _copy(source: str, target: str) -> None:
    from pyarrow import fs

    (a, at), (b, to) = opened(source), opened(target)
    b.create_dir(to.rsplit("/", 1)[0], recursive=True)
    fs.copy_files(at, to, source_filesystem=a, destination_filesystem=b, use_threads=False)
    if a.get_file_info(at).size != b.get_file_info(to).size:
        raise OSError("the copy has another size")


def _delete(path: str) -> None:
    system, at = opened(path)
    if system.get_file_info(at).is_file:
        system.delete_file(at)


def write_files(rows: DataFrame) -> DataFrame:
    """Write rows (path, content: text or bytes), one file each; a file has to fit a task."""
    return _each(rows.select("path", "content"), _write)


def copy_files(rows: DataFrame) -> DataFrame:
    """Copy rows (source, target); the outcome names the source."""
    return _each(rows.select("source", "target"), _copy)


def delete_files(rows: DataFrame) -> DataFrame:
    """Delete rows (path); a file that is gone already counts as deleted."""
    return _each(rows.select("path"), _delete)
