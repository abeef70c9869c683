"""The ways taken when nothing is proven small give the same rows as the broadcasts."""

import time

import pytest
from pyspark.sql import functions as F
from shapes import events, rows, run, stops

from steadypace.operators import skew
from steadypace.operators.cohort import Criteria
from steadypace.operators.daily import discipline_days
from steadypace.operators.panel import build_text_panel
from steadypace.operators.skew import is_small
from steadypace.plans import event_views as views
from steadypace.session import SHUFFLES_GO, materialise


@pytest.fixture
def nothing_small(monkeypatch):
    monkeypatch.setattr(skew, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 0)


def as_text(df):
    return sorted(map(str, rows(df.select(*sorted(df.columns)))))


def panel(spark):
    log = run(7) + run(7, operator="P", trip="U") + run(9, operator="P", first=40)
    return build_text_panel(stops(spark, log), events(spark, [3, 9, 50]), Criteria(0.4, 4, -10))[0]


def test_is_small_counts_only_when_it_must(spark, monkeypatch):
    frame = spark.range(50)
    assert is_small(frame)
    monkeypatch.setattr(skew, "BROADCAST_BYTES", 0)
    assert is_small(frame)
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 100)
    assert is_small(frame, copies=2) and not is_small(frame, copies=3)


def test_panel_without_broadcasts(spark, request):
    expected = as_text(panel(spark))
    request.getfixturevalue("nothing_small")
    assert as_text(panel(spark)) == expected


def test_discipline_days_without_broadcasts(spark, folder, request):
    def days():
        return discipline_days(views.daily_stops(spark, folder), views.incidents(spark, folder))

    expected = as_text(days())
    request.getfixturevalue("nothing_small")
    assert as_text(days()) == expected


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_have_no_cartesian_product_and_no_python(spark, folder):
    found = plan_of(panel(spark))
    assert "CartesianProduct" not in found and "BroadcastNestedLoopJoin" not in found
    assert "Python" not in found and "SinglePartition" not in found


def test_panel_shuffles_the_log_once(spark, folder):
    built = build_text_panel(views.stops(spark, folder), views.messages(spark, folder),
                             views.CRITERIA)[0]
    logs = [line for line in plan_of(built).splitlines()
            if "Exchange hashpartitioning(trip_id" in line and "piece_start_ts" not in line]
    assert len(logs) == 1


def test_stored_results_leave_no_shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        found = files.getAllFiles()
        names = (found.apply(i).getName() for i in range(found.size()))
        return {name for name in names if name.startswith("shuffle_")}

    frame = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    before = shuffles()
    stored = materialise(frame)
    until = time.time() + 20
    while shuffles() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffles() - before
    assert sorted(r["count"] for r in stored.collect()) == [142] + [143] * 6
    assert spark.conf.get(SHUFFLES_GO, None) is None
