"""Reading and writing the four tables.

Parquet is the storage format. A path holds versions: every write goes to new
folders, and a version is published by one small file that is written last and is
named by the version's number, so readers see the old one or the new one and two writers
cannot both publish the same number. The renewal log is laid out by month
(``created_month``), so range filters on it prune files. ``read_tables_jdbc`` reads a live
relational database in parallel partitions (not exercised here: no database
is available in this environment).
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import LOG_PARTITION, Tables
from ..session import ensure_checkpoint_dir

NAMES = ("platforms", "accounts", "profiles", "renewals")
# Secrets of the original tables are never read: Spark prunes the JDBC
# projection, so these columns do not leave the database.
SECRET_COLUMNS = {"accounts": ("password",), "profiles": ("pin",)}


VERSIONS = "versions"


class StaleVersion(ValueError):
    """A change was made from a version that is no longer the newest one."""


def _folder(spark: SparkSession, path: str):
    """(Hadoop file context, path of the folder of versions): whatever store the tables are in."""
    fs = spark._jvm.org.apache.hadoop.fs
    at = fs.Path(f"{path}/{VERSIONS}")
    conf = spark._jsc.hadoopConfiguration()
    at = at.getFileSystem(conf).makeQualified(at)
    return fs.FileContext.getFileContext(at.toUri(), conf), at


def _newest(spark: SparkSession, path: str) -> tuple[int, dict]:
    """(number, folders and schema of each table) of the newest version; (0, {}): nothing published.

    A version is one file named by its number, so only that file is read."""
    files, at = _folder(spark, path)
    if not files.util().exists(at):
        return 0, {}
    names = [s.getPath().getName() for s in files.util().listStatus(at)]
    newest = max((n for n in names if n.endswith(".json") and n[:-5].isdigit()), default=None)
    if newest is None:
        return 0, {}
    text = spark.read.text(f"{path}/{VERSIONS}/{newest}", wholetext=True).first()[0]
    return int(newest[:-5]), {name: (commits, schema) for name, (commits, schema) in json.loads(text).items()}


def _write_part(name: str, df: DataFrame, path: str, commit: str) -> str:
    """Write rows of a table to a folder of their own; returns their schema."""
    to = f"{path}/{name}/commit={commit}"
    if name == "renewals":
        df = df.withColumn(LOG_PARTITION, F.date_format("created_at", "yyyy-MM"))
        # Rebalance on the month: each month lands in few files (instead of
        # one file per month per input task), small months are coalesced,
        # and AQE splits a month that holds most of the log into
        # advisory-sized pieces. One pass: unlike range partitioning, no
        # sampling job recomputes the input first.
        df.hint("rebalance", LOG_PARTITION).write.partitionBy(LOG_PARTITION).parquet(to)
    else:
        df.write.parquet(to)
    return df.schema.json()


def _publish(spark: SparkSession, path: str, version: int, parts: dict[str, tuple[list[str], str]]) -> None:
    """Make a version readable: its file is written beside and then takes its
    name, which no file may have yet, so of two writers of one number the second fails."""
    fs = spark._jvm.org.apache.hadoop.fs
    files, at = _folder(spark, path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(at)
    draft, final = fs.Path(at, f".{_new_commit()}"), fs.Path(at, f"{version:012d}.json")
    out = store.create(draft, False)
    try:
        out.write(json.dumps(parts).encode())
    finally:
        out.close()
    try:
        files.rename(draft, final, spark.sparkContext._gateway.new_array(fs.Options.Rename, 0))
    except Py4JJavaError as e:
        store.delete(draft, False)
        if "FileAlreadyExists" in e.java_exception.getClass().getName():
            raise StaleVersion(f"version {version} of {path} has been published by another writer") from None
        raise


def _new_commit() -> str:
    return f"c{uuid.uuid4().hex[:16]}"


def write_tables(t: Tables, path: str) -> None:
    """Publish the tables as a new version under ``path``.

    No file of an earlier version is touched, so the tables may come from the
    same path, and a failure leaves the last version as it was. One writer at
    a time.
    """
    spark, commit = t.platforms.sparkSession, _new_commit()
    newest, _ = _newest(spark, path)
    parts = {name: ([commit], _write_part(name, getattr(t, name), path, commit)) for name in NAMES}
    _publish(spark, path, 1 + newest, parts)


def commit_changes(before: Tables, result, path: str) -> None:
    """Publish a change (a ``ChangeResult`` on ``before``, read from ``path``) as a new version.

    New log rows and inserted rows are written to folders of their own beside
    the old ones; a table whose rows changed is written anew; the others keep
    their folders. The version is switched last. ``before`` must be the newest version
    (``StaleVersion`` otherwise, and nothing is published): what was published since
    would be lost.
    """
    spark, commit = before.platforms.sparkSession, _new_commit()
    newest, seen = _newest(spark, path)
    if not seen:
        raise ValueError(f"no tables at {path}")
    if before.version != newest:
        raise StaleVersion(f"the change was made from version {before.version} of {path}, but the newest is {newest}")
    parts = dict(seen)
    for name in NAMES:
        if name in result.appended:
            old, schema = parts[name]
            # written in the stored columns and types, whatever the change's own order
            shape = T.StructType.fromJson(json.loads(schema))
            rows = result.appended[name].select(*[F.col(f.name).cast(f.dataType) for f in shape if f.name != LOG_PARTITION])
            _write_part(name, rows, path, commit)
            parts[name] = ([*old, commit], schema)
        elif getattr(result.tables, name) is not getattr(before, name):
            parts[name] = ([commit], _write_part(name, getattr(result.tables, name), path, commit))
    _publish(spark, path, 1 + newest, parts)


def read_tables(spark: SparkSession, path: str) -> Tables:
    """The newest published version.

    The log keeps its month partition column, so that time-bounded reports
    prune whole months before reading a file.
    """
    version, parts = _newest(spark, path)
    if not parts:
        raise ValueError(f"no tables at {path}")
    out = {}
    for name in NAMES:
        commits, schema = parts[name]
        schema = T.StructType.fromJson(json.loads(schema)).add("commit", "string")
        df = spark.read.schema(schema).parquet(f"{path}/{name}")
        out[name] = df.where(F.col("commit").isin(commits)).select(*schema.names[:-1])
    return Tables(**out, version=version)


def folder(spark: SparkSession, label: str) -> str:
    """A new folder's place in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


def materialize(spark: SparkSession, t: Tables, label: str) -> Tables:
    """Write the tables once to the shared checkpoint folder and read them back.

    Cuts the lineage of derived tables (a lost executor then re-reads files
    instead of recomputing joins). The folder is the session's
    ``spark.checkpoint.dir``; never a machine-local path on a cluster.
    """
    path = folder(spark, f"tables-{label}")
    write_tables(t, path)
    return read_tables(spark, path)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet to the shared checkpoint folder and read it back.

    Cuts lineage like ``checkpoint()``, but the plan runs once (an eager RDD
    checkpoint computes it for the count and again for the files), the files
    are columnar and compressed, and later readers prune columns and push
    filters into them. The folder is the session's ``spark.checkpoint.dir``.
    """
    path = folder(df.sparkSession, f"stage-{label}")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def id_ranges(cuts: list[int]) -> list[str]:
    """Predicates that part the ids at ``cuts``; every id, and a null one, meets exactly one."""
    cuts = sorted(set(cuts))
    if not cuts:
        return ["1 = 1"]
    inner = [f"id >= {a} AND id < {b}" for a, b in zip(cuts, cuts[1:])]
    return [f"id < {cuts[0]} OR id IS NULL", *inner, f"id >= {cuts[-1]}"]


def _quantiles(name: str, parts: int) -> str:
    """A query for the ids that part a table into ``parts`` ranges of as many rows."""
    shares = ", ".join(f"{k / parts:.9f}" for k in range(1, parts))
    return f"(SELECT unnest(percentile_disc(ARRAY[{shares}]) WITHIN GROUP (ORDER BY id)) AS cut FROM {name}) AS cuts"


def read_tables_jdbc(
    spark: SparkSession,
    url: str,
    properties: dict[str, str],
    bounds: dict[str, tuple[int, int]] | None = None,
    num_partitions: int = 64,
    even: tuple[str, ...] = (),
) -> Tables:
    """SRC1: read the tables from a relational database over JDBC.

    Tables named in ``even`` are read in ``num_partitions`` parallel id ranges of as
    many rows, parted at quantiles that the database is asked for once, so gaps in the ids leave no
    range empty; those in ``bounds`` (name -> (lowest id, highest id)) in ranges
    of as many ids; the others in one partition. Credentials come from
    ``properties``, never from code; the tables' secret columns (account
    password, profile PIN) are not read.
    """
    out: dict[str, DataFrame] = {}
    for name in NAMES:
        if name in even and num_partitions > 1:
            cuts = spark.read.jdbc(url, _quantiles(name, num_partitions), properties=properties).collect()  # fewer than num_partitions rows
            ranges = id_ranges([r["cut"] for r in cuts if r["cut"] is not None])
            df = spark.read.jdbc(url, name, predicates=ranges, properties=properties)
        elif bounds and name in bounds:
            lo, hi = bounds[name]
            df = spark.read.jdbc(url, name, "id", lo, hi, num_partitions, properties=properties)
        else:
            df = spark.read.jdbc(url, name, properties=properties)
        out[name] = df.drop(*SECRET_COLUMNS.get(name, ()))
    return Tables(**out)
