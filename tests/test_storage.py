"""Stored tables: round trip, month partition pruning, log appends keep the layout."""

from __future__ import annotations

import pytest

from seatledger import requests as Q
from seatledger.catalog import AS_OF
from seatledger.operators import changes as C
from seatledger.operators import history as H
from seatledger.operators import reports as R
from seatledger.sources.bindings import bind_tables
from seatledger.sources.tables import materialize

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def both(spark):
    live = bind_tables(spark, SF)
    return live, materialize(spark, live, "test")


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((v is None, str(v)) for v in r))


def test_round_trip_same_results(both):
    live, stored = both
    assert _rows(R.platform_report(live)) == _rows(R.platform_report(stored))
    assert _rows(R.summary(live, AS_OF)) == _rows(R.summary(stored, AS_OF))
    a = H.renewal_history(live, "1996-01-01", "1996-06-30")
    b = H.renewal_history(stored, "1996-01-01", "1996-06-30")
    assert a.columns == b.columns and _rows(a) == _rows(b)
    assert _rows(H.renewal_history(live, limit=25)) == _rows(H.renewal_history(stored, limit=25))


def test_month_partitions_are_pruned(both):
    _, stored = both
    text = H.renewal_history(stored, "1996-01-01", "1996-06-30")._jdf.queryExecution().executedPlan().toString()
    assert "created_month" in text and "1996-01" in text and "1996-06" in text


def test_log_append_fills_month(both):
    _, stored = both
    res = C.renew_accounts(stored, Q.renew_accounts_req(stored), Q.NOW)
    new = res.tables.renewals.where("created_at = timestamp_ntz'2000-01-01 12:00:00'")
    assert {r["created_month"] for r in new.select("created_month").distinct().collect()} == {"2000-01"}


def test_hot_month_is_split_across_files(spark):
    """A month holding 40% of the log is written by several tasks, rows whole."""
    import glob
    import uuid

    from pyspark.sql import functions as F

    from seatledger.sources.tables import read_tables, stage, write_tables

    t = bind_tables(spark, "/root/testdata/sf0.01", AS_OF)
    hot = F.pmod(F.xxhash64("created_at", "new_expiry_date", "sale_price", "profile_id"), F.lit(10)) < 4
    log = t.renewals.withColumn("created_at", F.when(hot, F.lit("1999-01-15 10:00:00").cast("timestamp_ntz")).otherwise(F.col("created_at")))
    # the log in several files, read by several tasks, as on a cluster
    log = stage(log.repartition(8), "hot-month-input")
    conf = {
        "spark.sql.files.maxPartitionBytes": "256k",
        "spark.sql.files.openCostInBytes": "16k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256k",
    }
    for k, v in conf.items():
        spark.conf.set(k, v)
    path = f"{spark.conf.get('spark.checkpoint.dir').rstrip('/')}/hot-month-{uuid.uuid4().hex[:8]}"
    try:
        write_tables(t.with_(renewals=log), path)
    finally:
        for k in conf:
            spark.conf.unset(k)
    files = glob.glob(f"{path}/renewals/commit=*/created_month=1999-01/*.parquet")
    assert len(files) > 1
    back = read_tables(spark, path).renewals
    assert back.count() == t.renewals.count()
    assert back.where("created_month = '1999-01'").count() == log.where(F.date_format("created_at", "yyyy-MM") == "1999-01").count()


def test_jdbc_reader_wiring():
    """SRC1 without a database: id-bounded tables are read in parallel ranges,
    the others in one partition; credentials come only from ``properties``;
    password and PIN columns are not read."""
    from seatledger.sources.tables import NAMES, read_tables_jdbc

    calls, dropped = [], {}

    class Frame:
        def __init__(self, table):
            self.table = table

        def drop(self, *cols):
            dropped[self.table] = cols
            return self.table

    class Reader:
        def jdbc(self, url, table, column=None, lowerBound=None, upperBound=None, numPartitions=None, properties=None):
            calls.append((url, table, column, lowerBound, upperBound, numPartitions, dict(properties or {})))
            return Frame(table)

    class FakeSpark:
        read = Reader()

    props = {"user": "u", "password": "from-env"}
    t = read_tables_jdbc(FakeSpark(), "jdbc:postgresql://db/x", props, {"profiles": (1, 1000), "renewals": (1, 50)}, 16)
    assert [getattr(t, n) for n in NAMES] == list(NAMES)
    by = {c[1]: c for c in calls}
    assert by["profiles"][2:6] == ("id", 1, 1000, 16) and by["renewals"][2:6] == ("id", 1, 50, 16)
    assert by["platforms"][2:6] == (None, None, None, None)
    assert all(c[6] == props for c in calls)
    assert dropped["accounts"] == ("password",) and dropped["profiles"] == ("pin",) and dropped["renewals"] == ()


def test_jdbc_ranges_of_as_many_rows():
    """Ids with wide gaps: ranges are parted at quantiles that the database is asked for once."""
    from seatledger.sources.tables import id_ranges, read_tables_jdbc

    ids = [*range(100), *range(10**9, 10**9 + 300)]
    calls = []

    class Frame:
        def __init__(self, rows=()):
            self.rows = rows

        def drop(self, *cols):
            return self

        def collect(self):
            return self.rows

    class Reader:
        def jdbc(self, url, table, column=None, lowerBound=None, upperBound=None, numPartitions=None, predicates=None, properties=None):
            calls.append((table, predicates))
            if table.startswith("("):
                assert "percentile_disc" in table and table.count(",") == 2  # three shares for four ranges
                return Frame([{"cut": ids[len(ids) * k // 4 - 1]} for k in (1, 2, 3)])
            return Frame()

    class FakeSpark:
        read = Reader()

    read_tables_jdbc(FakeSpark(), "jdbc:postgresql://db/x", {}, num_partitions=4, even=("profiles",))
    ranges = next(p for t, p in calls if t == "profiles")
    where = [p.replace("OR id IS NULL", "or id is None").replace("AND", "and") for p in ranges]
    counts = [sum(eval(p, {"id": i}) for i in ids) for p in where]
    assert sum(counts) == len(ids) and len(counts) == 4 and max(counts) <= 102
    assert [p for t, p in calls if t == "platforms"] == [None]
    assert id_ranges([]) == ["1 = 1"] and id_ranges([5, 5]) == ["id < 5 OR id IS NULL", "id >= 5"]


def test_newest_page_reads_the_newest_months(both):
    """Without a range: only months that can hold the page are sorted."""
    _, stored = both
    rows = stored.renewals.groupBy("created_month").count().orderBy("created_month").collect()
    page = H._selected_log(stored, None, None, rows[-1]["count"] + 1)[0]
    least = rows[-2]["created_month"]
    assert "created_month#" in page._jdf.queryExecution().optimizedPlan().toString()
    assert f">= {least}" in page._jdf.queryExecution().optimizedPlan().toString()
    whole = stored.renewals.drop("created_month").orderBy(*H.history_order([c for c in stored.renewals.columns if c != "created_month"]))
    assert page.collect() == whole.limit(rows[-1]["count"] + 1).select(*page.columns).collect()
    assert H._selected_log(stored, None, None, 0)[0].count() == 0


def test_history_total_needs_no_joins(both):
    """The total equals the labelled history's, from the log alone."""
    from pyspark.sql import functions as F

    _, stored = both
    for args in [("1996-01-01", "1996-06-30", None), (None, None, 25), (None, None, None)]:
        tot = H.renewal_history_total(stored, *args)
        h = H.renewal_history(stored, *args)
        want = h.agg(F.count(F.lit(1)), F.sum("sale_price")).collect()[0]
        got = tot.collect()[0]
        assert got["count"] == want[0] and got["total_revenue"] == (want[1] or 0)
        assert "Join" not in tot._jdf.queryExecution().executedPlan().toString()
