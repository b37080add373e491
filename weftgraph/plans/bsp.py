"""Supersteps: write a step's state to the shared folder, read it back, go on from there.

A written table cuts the lineage, survives lost executors and, unlike checkpoint(), computes the step once.
Tables written inside ``scratch`` go when it ends; what the caller still needs is written by ``kept``.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

#: Folders of the scratch blocks that are open, the innermost last, each with the number of tables in it.
_open: ContextVar[tuple[list, ...]] = ContextVar("open", default=())


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where the session names none, a local folder if all runs on this machine, else an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = f"{tempfile.gettempdir()}/weftgraph-shared"
    return path.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list]:
    """A folder for the tables written inside the block, deleted at its end."""
    outer = _open.get()
    own = [f"{outer[-1][0] if outer else shared_dir(spark)}/scratch-{uuid.uuid4().hex}", 0]
    token = _open.set((*outer, own))
    try:
        yield own
    finally:
        _open.reset(token)
        if own[1]:
            delete(spark, own[0])


def new_path(spark: SparkSession, tag: str, outside: bool = False) -> str:
    """A path for a new table in the innermost scratch folder, or in the one around it."""
    folders = _open.get()
    for f in folders:
        f[1] += 1
    folders = folders[:-1] if outside else folders
    return f"{folders[-1][0] if folders else shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def cut(df: DataFrame, tag: str = "step") -> DataFrame:
    """df, computed once and read back from the shared folder."""
    return _written(df, new_path(df.sparkSession, tag))


def kept(df: DataFrame, tag: str = "kept") -> DataFrame:
    """As cut, but the table outlives the innermost scratch block."""
    return _written(df, new_path(df.sparkSession, tag, outside=True))


def discard(*frames: DataFrame) -> None:
    """Delete tables that cut or kept wrote and nothing reads any more."""
    for df in frames:
        if path := getattr(df, "_scratch_path", None):
            delete(df.sparkSession, path)


def leaves_result(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A query f(spark, ...) that leaves no table but its result; one that writes none stays lazy."""

    @wraps(f)
    def run(spark: SparkSession, *args, **more) -> DataFrame:
        with scratch(spark) as own:
            out = f(spark, *args, **more)
            return kept(out, f.__name__) if own[1] else out

    return run


def run_supersteps(state: DataFrame, step: Callable[[DataFrame, int], DataFrame], done: Callable[[DataFrame, int], bool], limit: int, tag: str = "step") -> tuple[DataFrame, int]:
    """Apply step until done or limit; returns the last state and the number of steps."""
    for i in range(limit):
        state, old = cut(step(state, i), tag), state
        discard(old)
        if done(state, i):
            return state, i + 1
    return state, limit
