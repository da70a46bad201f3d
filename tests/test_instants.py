import datetime as dt
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from chatloom.functions.instants import days_from_civil, epoch_instant, with_instant
from chatloom.operators.instants import raw_instants, stamp_mismatches

U = dt.timezone.utc


def at(spark, stamps, zone="Europe/Berlin", order="dmy"):
    d = spark.createDataFrame([(i, s, zone, order) for i, s in enumerate(stamps)], "i int, stamp string, zone string, ord string")
    r = with_instant(d, "stamp", "zone", "ord").select("i", F.unix_micros("instant").alias("us")).collect()
    got = dict(map(tuple, r))
    return [None if got[i] is None else dt.datetime(1970, 1, 1, tzinfo=U) + dt.timedelta(microseconds=got[i]) for i in range(len(stamps))]


def test_forms(spark):
    t = dt.datetime(2024, 5, 29, 13, 34, 53, tzinfo=U)
    forms = [
        "1716989693", " 1716989693\n", "+1716989693", "1716989693000", "1716989693000000", "1716989693000000000", "1716989693.0", "1.716989693E9",
        "2024-05-29T13:34:53Z", "2024-05-29T15:34:53+02:00", "2024-05-29T15:34:53.000000+0200", "2024-05-29T15:34:53+02", "2024-05-29 13:34:53 UTC", "2024-05-29 15:34:53 CEST",
        "2024-05-29 15:34:53", "29/05/2024 15:34:53", "29.05.2024 15:34:53", "29.05.2024 13:34:53 UTC+00:00", "29.05.2024 08:34:53 UTC-05:00", "29 May 2024, 15:34:53",
        "Wed, 29 May 2024 13:34:53 +0000", "May 29, 2024 3:34:53 PM", "29-May-24 3:34:53 pm", "29 mai 2024 15:34:53",
    ]
    assert at(spark, forms) == [t] * len(forms)


def test_nothing_stated(spark):
    bad = [None, "", "  ", "null", "n/a", "--", "yesterday", "Invalid date", "12:30", "12:30:15 PM", "2023-02-29 10:00:00", "2024-13-01 10:00:00", "2024-01-32 10:00:00",
           "2024-01-01 24:00:00", "2024-01-01 10:60:00", "1/1/2024 13:00 PM", "1/1/2024 0:30 AM", "2024-01-01 10:00:00 XYZ", "99999999999999999999999"]
    assert at(spark, bad) == [None] * len(bad)


def test_order_zone_and_daylight_saving(spark):
    assert at(spark, ["4/3/2024 1:00 AM"], "America/New_York", "mdy") == [dt.datetime(2024, 4, 3, 5, 0, tzinfo=U)]
    assert at(spark, ["4/3/2024 01:00"], "UTC", "dmy") == [dt.datetime(2024, 3, 4, 1, 0, tzinfo=U)]
    assert at(spark, ["4/13/2024 01:00"], "UTC", "dmy") == [dt.datetime(2024, 4, 13, 1, 0, tzinfo=U)]  # no other order is a date
    assert at(spark, ["04.03.2024 01:00"], "UTC", "mdy") == [dt.datetime(2024, 3, 4, 1, 0, tzinfo=U)]  # dots: day first
    # repeated hour: the earlier instant; skipped hour: moved forward
    assert at(spark, ["2024-10-27 02:30:00", "2024-03-31 02:30:00"]) == [dt.datetime(2024, 10, 27, 0, 30, tzinfo=U), dt.datetime(2024, 3, 31, 1, 30, tzinfo=U)]
    assert at(spark, ["2024-10-27 02:30:00+0100"]) == [dt.datetime(2024, 10, 27, 1, 30, tzinfo=U)]
    assert at(spark, ["2024-05-01 10:00:00", "2024-05-01 10:00:00Z"], None) == [None, dt.datetime(2024, 5, 1, 10, tzinfo=U)]
    assert at(spark, ["2024-05-01 10:00:00"], "Mars/Base") == [None]


def test_wall_times_agree_with_zoneinfo(spark):
    for zone in ("Asia/Kathmandu", "America/Los_Angeles", "Australia/Sydney"):
        days = [dt.datetime(2023, 1, 1, 12, 34, 56) + dt.timedelta(days=9 * i) for i in range(80)]
        want = [d.replace(tzinfo=ZoneInfo(zone)).astimezone(U) for d in days]
        assert at(spark, [d.strftime("%Y-%m-%d %H:%M:%S") for d in days], zone) == want


def test_day_arithmetic(spark):
    days = [dt.date(1, 1, 1), dt.date(1969, 12, 31), dt.date(1970, 1, 1), dt.date(2000, 2, 29), dt.date(1900, 3, 1), dt.date(9999, 12, 31)]
    d = spark.createDataFrame([(x.year, x.month, x.day) for x in days], "y int, m int, d int")
    got = [r[0] for r in d.select(days_from_civil(F.col("y"), F.col("m"), F.col("d"))).collect()]
    assert got == [(x - dt.date(1970, 1, 1)).days for x in days]


def test_epoch_units_and_limits(spark):
    d = spark.createDataFrame([(0,), (-1,), (1700000000,), (1700000000123,), (1700000000123456,), (1700000000123456789,), (None,)], "n bigint")
    got = [r[0] for r in d.select(F.unix_micros(epoch_instant(F.col("n")))).collect()]
    assert got == [0, -1000000, 1700000000000000, 1700000000123000, 1700000000123456, 1700000000123456, None]


def test_clashing_names_and_empty(spark):
    d = spark.createDataFrame([("1", "x", "y", "z")], "stamp string, __stamp_raw string, __stamp_y string, __STAMP_parts string")
    r = with_instant(d, "stamp")
    assert r.columns == [*d.columns, "instant"] and r.first()["__stamp_raw"] == "x"
    assert with_instant(d.limit(0), "stamp").count() == 0


def test_mismatches(spark):
    tg = spark.createDataFrame([(1, "c", 1, "0"), (2, "c", 2, "100"), (3, "c", 3, None), (4, "c", 2, "100"), (5, None, 4, "1")], "rec_id bigint, chat_id string, seq bigint, date_unixtime string")
    dc = spark.createDataFrame([(1, "d", 1, "1970-01-01 02:00:00")], "rec_id bigint, chat_id string, seq bigint, timestamp string")
    ig = spark.createDataFrame([(1, "i", 1, 5000000000)], "rec_id bigint, chat_id string, seq bigint, timestamp_ms bigint")
    chats = spark.createDataFrame([("c", None, None), ("d", "Europe/Berlin", "dmy")], "chat_id string, export_tz string, date_order string")
    e = lambda s: dt.datetime.fromtimestamp(s, U).replace(tzinfo=None)
    m = spark.createDataFrame([("c", 1, None), ("c", 2, e(101)), ("c", 2, e(101)), ("c", 3, None), ("d", 1, e(3600.999)), ("i", 9, None)], "chat_id string, seq bigint, timestamp timestamp")
    got = {tuple(r) for r in stamp_mismatches(raw_instants(tg, dc, ig, chats), m).collect()}
    assert got == {("c", 1), ("c", 2)}
    assert stamp_mismatches(raw_instants(tg.limit(0), dc.limit(0), ig.limit(0), chats), m).count() == 0


@pytest.mark.parametrize("stamp", ["2024-05-29 15:34:53 PM".replace("15", "3")])
def test_narrow_blank_before_half(spark, stamp):
    assert at(spark, [stamp], "UTC") == [dt.datetime(2024, 5, 29, 15, 34, 53, tzinfo=U)]
