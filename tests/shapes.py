"""Small hand-made logs."""

from datetime import datetime, timedelta

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

DAY = datetime(2024, 1, 10)
STOP = (
    "trip_id string, operator_id string, scheduled_date date, scheduled_ts timestamp_ntz, "
    "departure_ts timestamp_ntz, stop_sequence int, stop_id string, stop_name string, "
    "adherence_secs double, early int, time_point boolean"
)
EVENT = "event_id long, operator_id string, event_date date, event_ts timestamp_ntz"


def at(minutes):
    return DAY + timedelta(minutes=minutes)


def stop(minutes, seq, trip="T", operator="O", secs=-50.0, early=1, time_point=True, scheduled=None,
         stop_id=None):
    when = at(minutes)
    planned = at(scheduled) if scheduled is not None else when
    name = stop_id or f"s{minutes}"
    return (trip, operator, when.date(), planned, when, seq, name, f"Stop {name}", secs, early,
            time_point)


def frame(spark, rows, ddl):
    """A local frame by way of Arrow, which needs no Python worker."""
    schema = spark.createDataFrame([], ddl).schema
    arrow = to_arrow_schema(schema)
    columns = zip(*rows)
    arrays = [pa.array(list(c), type=f.type) for c, f in zip(columns, arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=arrow), schema)


def stops(spark, rows):
    return frame(spark, rows, STOP)


def events(spark, minutes, operator="O"):
    rows = [(i, operator, at(m).date(), at(m)) for i, m in enumerate(minutes, start=1)]
    return frame(spark, rows, EVENT)


def run(n, first=0, step=2, **options):
    """A run of ``n`` stops, ``step`` minutes apart."""
    return [stop(first + step * i, i + 1, **options) for i in range(n)]


def rows(df, *columns, order=None):
    chosen = df.select(*columns) if columns else df
    return [tuple(r) for r in chosen.orderBy(*(order or columns or df.columns)).collect()]


def minute(column):
    return ((F.unix_micros(F.col(column).cast("timestamp")) / 60_000_000) % 1440).cast("int")
