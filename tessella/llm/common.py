"""Session helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

#: A key is hot if it holds more than one of so many parts of the rows.
HOT_PARTS = 10_000
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as `spark.checkpoint.dir` names it.

    Only a session on one machine without that setting (tests) gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    kept = getattr(spark.sparkContext, "_tessella_dir", None)
    if kept is None:
        path = tempfile.mkdtemp(prefix="tessella-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        kept = spark.sparkContext._tessella_dir = "file://" + path
    return kept


def split_join(left: DataFrame, right: DataFrame, on: list[str], total: int, how: str = "inner") -> DataFrame:
    """Inner or left join; right has one row a key with n_rows, how many of left's `total` rows have it.

    Hot keys are broadcast, so that no task gets all rows of one; by their
    definition there are fewer than HOT_PARTS. The others are left to the planner.
    """
    is_hot = F.col("n_rows") > max(1, total // HOT_PARTS)
    hot = F.broadcast(right.filter(is_hot))
    return left.join(hot, on).unionByName(left.join(hot.select(*on), on, "left_anti").join(right.filter(~is_hot), on, how))


class Workspace:
    """Written tables of one operator's run; each `put` cuts the lineage at a shared file.

    A lazy result may read them, so they stay until `released` or `release_all`
    deletes them, when results have been written or collected.
    """

    made: list[Workspace] = []

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tessella-{uuid.uuid4().hex}"
        self.n = 0
        Workspace.made.append(self)

    def put(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._tessella_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table that no later plan reads."""
        self._delete(df._tessella_path)

    def _delete(self, path: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def _release(first: int) -> None:
    while len(Workspace.made) > first:
        work = Workspace.made.pop()
        work._delete(work.root)


@contextmanager
def released() -> Iterator[None]:
    """Delete at the end what operators called inside have written; for work whose results are written inside."""
    first = len(Workspace.made)
    try:
        yield
    finally:
        _release(first)


def release_all() -> None:
    """Delete all tables that operators of this process have written and still hold."""
    _release(0)
