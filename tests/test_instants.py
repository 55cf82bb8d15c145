"""Timestamps against zoneinfo, case by case and for whole columns."""

import datetime as dt
import re
from zoneinfo import ZoneInfo

import pytest

from paperloom.functions import instants
from paperloom.session import table

UTC = dt.timezone.utc


def us(y, m, d, h=0, mi=0, s=0, micro=0, zone="UTC", offset=None):
    tz = dt.timezone(dt.timedelta(minutes=offset)) if offset is not None else ZoneInfo(zone)
    t = dt.datetime(y, m, d, h, mi, s, micro, tzinfo=tz)  # fold 0: the earlier instant, skipped times moved on
    return (t.astimezone(UTC) - dt.datetime(1970, 1, 1, tzinfo=UTC)) // dt.timedelta(microseconds=1)


CASES = [
    ("2023-11-27", None, None, us(2023, 11, 27)), ("2023-11-27", None, "Europe/Berlin", us(2023, 11, 27, zone="Europe/Berlin")), ("2023/05/01", "de-DE", "Nowhere/Land", us(2023, 5, 1)),
    ("04/09/2024", "en-US", None, us(2024, 4, 9)), ("04/09/2024", None, None, us(2024, 4, 9)), ("04/09/2024", "en-GB", None, us(2024, 9, 4)), ("25/03/2023", "en-US", None, us(2023, 3, 25)), ("4/21/2024", "fr-FR", None, us(2024, 4, 21)),
    ("09/11/23", "de-DE", None, us(2023, 11, 9)), ("02.03.2022", "en-US", None, us(2022, 3, 2)), ("12.31.2022", "en-US", None, None), ("7-11-2025", "en-US", None, us(2025, 11, 7)), ("30.02.2025", None, None, None), ("31/02/2024", None, None, None),
    ("20241212", None, None, us(2024, 12, 12)), ("20230716T165300", None, "Asia/Tokyo", us(2023, 7, 16, 16, 53, zone="Asia/Tokyo")), ("20221101T161821Z", None, "Asia/Tokyo", us(2022, 11, 1, 16, 18, 21)),
    ("1674442641", None, "Asia/Tokyo", 1674442641 * 10**6), ("1656988610000", None, None, 1656988610000 * 1000), ("2022-W02-4", None, None, us(2022, 1, 13)), ("2021-W53-1", None, None, None), ("2020-W53-5", None, None, us(2021, 1, 1)),
    ("February 15, 2025", None, None, us(2025, 2, 15)), ("Sep 26, 2023", None, None, us(2023, 9, 26)), ("Mar 27, 2022", None, None, us(2022, 3, 27)), ("11 Jul 2025", None, None, us(2025, 7, 11)), ("5. März 2025", None, None, us(2025, 3, 5)),
    ("1er avril 2024", None, None, us(2024, 4, 1)), ("17 de agosto de 2023", None, None, us(2023, 8, 17)), ("June 2nd, 2022", None, None, us(2022, 6, 2)), ("Mon, 20 May 2024", None, None, us(2024, 5, 20)), ("mardi 5 mars 2024", None, None, us(2024, 3, 5)),
    ("26 mars 2023 01:57:50.058", None, None, us(2023, 3, 26, 1, 57, 50, 58000)), ("2025-04-12T20:28:26.221745510", None, None, us(2025, 4, 12, 20, 28, 26, 221745)), (" 2025-07-20 ", None, None, us(2025, 7, 20)),
    ("2022-10-30 4:15:11 am EST", None, "Europe/Paris", us(2022, 10, 30, 4, 15, 11, offset=-300)), ("12-05-2022, 5:27 pm+02", None, None, us(2022, 5, 12, 17, 27, offset=120)), ("2022-12-05, 2:47 p.m.-05:00", None, None, us(2022, 12, 5, 14, 47, offset=-300)),
    ("March 9 2025, 12:26 AM", None, None, us(2025, 3, 9, 0, 26)), ("March 9 2025, 12:26 PM", None, None, us(2025, 3, 9, 12, 26)), ("2024-03-13 10:56[Asia/Tokyo]", None, "UTC", us(2024, 3, 13, 10, 56, zone="Asia/Tokyo")),
    ("2024-03-10 02:00 BST", None, None, us(2024, 3, 10, 2, offset=60)), ("2025-06-30 21:14:46 CDT", None, None, us(2025, 6, 30, 21, 14, 46, offset=-300)), ("2023-01-31 07:08:09 GMT", None, "Asia/Tokyo", us(2023, 1, 31, 7, 8, 9)),
    ("2025-03-30 02:30", None, "Europe/Berlin", us(2025, 3, 30, 2, 30, zone="Europe/Berlin")), ("2025-10-26 02:30", None, "Europe/Berlin", us(2025, 10, 26, 2, 30, zone="Europe/Berlin")), ("2025-11-02 01:30", None, "America/New_York", us(2025, 11, 2, 1, 30, zone="America/New_York")),
    ("2024-02-30T10:00:00Z", None, None, None), ("2024-05-05 25:00", None, None, None), ("2024-05-05 13:61", None, None, None), ("March 2025", None, None, None), ("2024", None, None, None), ("Q2 2025", None, None, None), ("Net 30", None, None, None),
    ("upon receipt", None, None, None), ("", None, None, None), ("   ", None, None, None), (None, None, None, None), ("-", None, None, None), ("x" * 20_000, None, None, None),
]


@pytest.fixture(scope="module")
def answers(spark):
    rows = [(i, *c[:3], "clash") for i, c in enumerate(CASES)]
    df = spark.createDataFrame(rows * 2, "id long, v string, doc_locale string, time_zone string, value string")
    return {r.row_key: r.epoch_us for r in instants.normalise(df, "id", ["v"]).collect()}


@pytest.mark.parametrize("n", range(len(CASES)))
def test_case(answers, n):
    assert answers.get(n) == CASES[n][3], CASES[n]


def test_repeats_come_once_and_empty_table(spark, answers):
    assert len(answers) == sum(c[3] is not None for c in CASES)
    empty = spark.createDataFrame([], "id long, v string, doc_locale string, time_zone string")
    assert instants.normalise(empty, "id", ["v"]).count() == 0


def test_iso_values_of_the_table(spark):
    """Every ISO-like value of a real column against datetime."""
    df = table(spark, "/root/testdata/sf0.001", "financial_document_fields")
    zone = {(r.fields_id): r.time_zone for r in df.select("fields_id", "time_zone").collect()}
    got = instants.normalise(df, "fields_id", ["document_date", "due_date"]).collect()
    checked = 0
    for r in got:
        m = re.fullmatch(r"(\d{4})-(\d\d)-(\d\d)(?:[T ](\d\d):(\d\d)(?::(\d\d)(?:\.(\d+))?)?)?", r.value.strip())
        if m:
            checked += 1
            parts = [int(x or 0) for x in m.groups()[:6]]
            assert r.epoch_us == us(*parts, int((m[7] or "0").ljust(6, "0")[:6]), zone=zone[r.row_key] or "UTC"), r
    assert checked > 20
