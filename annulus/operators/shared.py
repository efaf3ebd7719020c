"""Intermediate tables in the folder that all executors share.

`spark.checkpoint.dir` names it on a cluster. A session on one machine may have
none (tests): a temporary folder is made for it then. On a cluster without one,
tables would go to each machine's own disk, so that is refused.

Results read such tables when they are asked for, so operators can't delete them. A caller
that is done with its results can: what is written inside `temporary` goes at its end.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Rows that a task of `dealt` gets: about 100 MB while they are sorted.
ROWS_OF_A_TASK = 500_000
#: Paths written in each open `temporary`, the innermost last.
_scopes: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="annulus-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/annulus-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compression: str = "snappy", keep: bool = False) -> DataFrame:
    """Cut the lineage: write `df` to the shared folder and read it back. `keep`: it outlives an open `temporary`."""
    path = new_path(df.sparkSession, name)
    if _scopes and not keep:
        _scopes[-1].append(path)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *keys: str, rows: int | None = None) -> DataFrame:
    """`df` dealt by `keys` to as many tasks as its rows need (or `rows`, those of a table it is joined with), so that what a task
    sorts doesn't grow with the table."""
    tasks = (df.count() if rows is None else rows) // ROWS_OF_A_TASK + 1
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df if tasks == 1 else df.repartition(min(20_000, max(tasks, least)), *keys)


def _delete(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables that are written inside are deleted at the end, whatever happens: results must be used or written before it."""
    paths: list[str] = []
    _scopes.append(paths)
    try:
        yield
    finally:
        _scopes.remove(paths)
        for path in paths:
            _delete(spark, path)


def dropped(*tables: DataFrame) -> None:
    """Delete the files of tables made by `written` that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        root = shared_dir(spark)
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/annulus-" in name and name.split("/annulus-")[0].endswith(root.split(":", 1)[-1].lstrip("/")):
                _delete(spark, name)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that `df` doesn't have, in any spelling."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
