"""Benchmark of the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).

The four tables are first derived from the driver's Parquet files and written
once as Parquet to the session's checkpoint folder (``materialize``, timed on
its own), as a deployment would store them. Each query then runs over those
files and is forced end to end with the ``noop`` sink (full execution, no rows
brought to the driver). Each query runs three times; the fastest run is
reported (the first runs also warm the JIT).
The headline value is the sum over summary, platform_report,
renewal_history and renew_profiles.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from seatledger import requests as Q  # noqa: E402
from seatledger.catalog import AS_OF, HIST_FROM, HIST_LIMIT, HIST_TO, WITHIN_DAYS  # noqa: E402
from seatledger.operators import changes as C  # noqa: E402
from seatledger.operators import history as H  # noqa: E402
from seatledger.operators import lists as L  # noqa: E402
from seatledger.operators import outbox as N  # noqa: E402
from seatledger.operators import reports as R  # noqa: E402
from seatledger.session import local_session  # noqa: E402
from seatledger.sources.bindings import bind_tables  # noqa: E402
from seatledger.sources.tables import materialize  # noqa: E402

HEADLINE = ["summary", "platform_report", "renewal_history", "renew_profiles"]


def run(df_or_list) -> None:
    for df in df_or_list if isinstance(df_or_list, list) else [df_or_list]:
        df.write.format("noop").mode("overwrite").save()


def timed(fn, repeats: int = 3) -> float:
    best = float("inf")
    for _ in range(repeats):
        t0 = time.perf_counter()
        run(fn())
        best = min(best, time.perf_counter() - t0)
    return round(best, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cores=cpus, shuffle_partitions=max(8, cpus * 2), app="seatledger-bench")

    t0 = time.perf_counter()
    t = materialize(spark, bind_tables(spark, sf_dir, AS_OF), "bench")
    mat = round(time.perf_counter() - t0, 3)

    def renew():
        res = C.renew_profiles(t, Q.renew_profiles_req(t), Q.NOW)
        return [res.applied, res.tables.profiles, res.rejected]

    plans = {
        "summary": lambda: R.summary(t, AS_OF),
        "platform_report": lambda: R.platform_report(t),
        "renewal_history": lambda: H.renewal_history(t, HIST_FROM, HIST_TO, HIST_LIMIT),
        "renew_profiles": renew,
        "renewal_history_all": lambda: H.renewal_history(t),
        "platform_list": lambda: R.platform_list(t, AS_OF),
        "account_list": lambda: L.account_list(t),
        "expiring_within": lambda: R.expiring_within(t, AS_OF, WITHIN_DAYS),
        "sales_daily": lambda: [H.sales_daily(t), H.renewals_daily(t)],
        "monthly": lambda: H.monthly(t),
        "reminder_outbox": lambda: N.reminder_outbox(t, AS_OF),
        "update_profiles": lambda: C.update_profiles(t, Q.update_profiles_req(t)).tables.profiles,
    }
    times = {"materialize_tables": mat}
    for name, fn in plans.items():
        times[name] = timed(fn)
    value = round(sum(times[k] for k in HEADLINE), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": value,
                "unit": "sec",
                "queries": times,
                "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
                "cpus": cpus,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
