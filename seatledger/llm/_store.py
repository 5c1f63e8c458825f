"""Staged tables in the shared folder, and row keys."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write once to the shared checkpoint folder and read back: cuts lineage,
    and a lost executor re-reads files instead of recomputing."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{label}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing reads any more (a frame made from one has the same files)."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Within it, Spark deletes an action's shuffle files when the action ends: staged tables are read back instead; and
    rows go to Python by few bytes at once, as a row of long lists is large and a batch of them stands outside the heap."""
    own = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}
    before = {key: spark.conf.get(key, None) for key in own}
    try:
        for key, value in own.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def row_key(*columns: Column | str) -> Column:
    """128 bits that stand for a row's values (nulls included), never null."""
    return F.struct(F.xxhash64(F.lit(1), *columns).alias("x"), F.xxhash64(F.lit(2), *reversed(columns)).alias("y"))


def plain(docs: DataFrame) -> DataFrame:
    """Without columns whose names begin with two underscores: those are the operators' own."""
    return docs.drop(*[c for c in docs.columns if c.startswith("__")])


def spread(df: DataFrame, least: int = 1) -> int:
    """Shuffle partitions of the session, as a number of buckets."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def plus(schema: T.StructType, **added: str) -> T.StructType:
    """A schema with columns added (``schema.add`` would change the frame's own)."""
    return T.StructType([*schema.fields, *T.StructType.fromDDL(", ".join(f"{k} {v}" for k, v in added.items())).fields])


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once a session, for tasks started where it is not installed."""
    sc, name = spark.sparkContext, __name__.split(".")[0]
    if name not in _shipped.get(sc.applicationId, ()):
        root = Path(__file__).resolve().parents[1]
        made = shutil.make_archive(f"{tempfile.mkdtemp()}/{name}", "zip", root.parent, root.name)
        sc.addPyFile(made)  # Spark copies it to each executor
        _shipped[sc.applicationId] = (name,)


_shipped: dict[str, tuple] = {}
