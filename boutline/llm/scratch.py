"""Tables written to the shared checkpoint folder, to cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.  Where it is unset, a folder of this machine for local masters (tests), else an error."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = getattr(shared_dir, "made", None)
    if made is None:
        made = shared_dir.made = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        atexit.register(_remove_local, made)
    return made


def _remove_local(path: str) -> None:
    import shutil

    shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


#: The lists that `clearing` collects in.
_OPEN: list[list[Scratch]] = []


@contextmanager
def clearing() -> Iterator[None]:
    """Deletes the tables of every Scratch that was made inside, on leaving; what is returned must have been written elsewhere by then."""
    made: list[Scratch] = []
    _OPEN.append(made)
    try:
        yield
    finally:
        _OPEN.remove(made)
        for scratch in made:
            scratch.clear()


class Scratch:
    """Written tables of one call.  `table` writes a frame and reads it back; `drop` deletes what is no longer read.

    A table that a returned frame still reads stays until `clearing` ends or the shared folder is cleared, as Spark's own
    checkpoints do.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/tables/{label}-{uuid.uuid4().hex}"
        self.count = 0
        if _OPEN:
            _OPEN[-1].append(self)

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:03d}-{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept.scratch_path = path
        return kept

    def drop(self, *frames: DataFrame) -> None:
        for frame in frames:
            where = getattr(frame, "scratch_path", None)
            if where:
                self._delete(where)

    def clear(self) -> None:
        self._delete(self.root)

    def _delete(self, where: str) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(conf).delete(path, True)
