from datetime import datetime, timezone
from itertools import product

import pytest

from cardloom.operators import timestamps as T

SITES = "provider string, time_zone string, date_order string"


def us(*parts, micro=0):
    return int(datetime(*parts, tzinfo=timezone.utc).timestamp()) * 1_000_000 + micro


@pytest.mark.parametrize(
    "value,zone,order,want",
    [
        ("2023-06-02T17:34:07.492578+01:00", None, None, us(2023, 6, 2, 16, 34, 7, micro=492578)),
        ("2024-01-14T16:24:58.9112130+0900", "UTC", "DMY", us(2024, 1, 14, 7, 24, 58, micro=911213)),
        ("1677642539.088", None, None, 1677642539088000), ("1686893709458", None, None, 1686893709458000), ("1655732198699685", None, None, 1655732198699685),
        ("18/08/2023 14:32", "Europe/London", "DMY", us(2023, 8, 18, 13, 32)), ("8/25/2020, 12:41:27 am", "America/New_York", "MDY", us(2020, 8, 25, 4, 41, 27)),
        ("3 octobre 2023 à 11h15", "Europe/Paris", "DMY", us(2023, 10, 3, 9, 15)), ("20. Oktober 2024, 22:43 Uhr", "Europe/Berlin", "DMY", us(2024, 10, 20, 20, 43)),
        ("2024년 1월 12일 오전 12:15", "Asia/Seoul", "YMD", us(2024, 1, 11, 15, 15)), ("2023年3月4日 8時55分", "Asia/Tokyo", "YMD", us(2023, 3, 3, 23, 55)),
        ("Posted on May 12, 2020 2:11 PM CDT", "America/Chicago", "MDY", us(2020, 5, 12, 19, 11)), ("2023-10-29 01:30:00 BST", "Europe/London", "DMY", us(2023, 10, 29, 0, 30)),
        ("2023-10-29 01:30:00 GMT", "Europe/London", "DMY", us(2023, 10, 29, 1, 30)), ("2025-02-28 17:04:59 UTC+9", None, None, us(2025, 2, 28, 8, 4, 59)), ("2021-12-03T17:39:20[Europe/London]", "Asia/Seoul", "YMD", us(2021, 12, 3, 17, 39, 20)),
    ],
)
def test_one_instant(value, zone, order, want):
    r = T.record(value, order, zone)
    at = T.ORDERS.get(order, 0)
    assert (r["us"][at], r["fixed"][at]) == (want, True)


@pytest.mark.parametrize("value", [None, "", " ", "yesterday", "vor 3 Stunden", "2021-02-30T10:15:00Z", "2020-13-04 08:00:00", "10:22", "2 May 2021", "n/a", "2023-01-01 25:00", "x" * 100_000])
def test_no_reading(value):
    assert T.readings(value, "Europe/Paris") == [] and T.record(value, "DMY", "Europe/Paris") is None


@pytest.mark.parametrize("value", ["2021-03-28 02:30:00", "25 octobre 2020 à 2h14"])
def test_skipped_and_doubled_times_are_not_fixed(value):
    assert [r[2] for r in T.readings(value, "Europe/Paris")] == [False]


def brute(records):
    """Cheapest way through all states of all records."""
    cost = lambda path: sum(r["cost"][i] for r, i in zip(records, path)) + sum(T.step(a, i, b, j) for a, i, b, j in zip(records, path, records[1:], path[1:]))
    return min((cost(path), path) for path in product(T.STATES, repeat=len(records)))[0], cost


def decoded(spark, values, declared, run=50_000, source="s"):
    rows = [(i, v, source) for i, v in enumerate(values)]
    cards = spark.createDataFrame(rows, "card_id bigint, published_at string, provider string")
    got = T.normalise_timestamps(cards, spark.createDataFrame([(source, "UTC", declared)], SITES), run=run).collect()
    return {r[0]: datetime.fromtimestamp(r[1] / 1e6, timezone.utc).strftime("%Y-%m-%d") for r in got}


def test_runs_give_the_path_of_the_whole_source(spark):
    values = ["05/06/2023 10:00", "07/06/2023 10:00", "13/06/2023 09:00", "01/02/2023 08:00", "2023-07-01 08:00", "08/07/2023 08:00", "12/25/23 08:00", "10/11/23 08:00"]
    rows = [(i, v, "s") for i, v in enumerate(values)] + [(3, values[3], "s"), (None, values[0], "s"), (50, None, "s"), (51, "", None)]
    cards = spark.createDataFrame(rows, "card_id bigint, published_at string, provider string").selectExpr("*", "1 as time_zone", "2 as us")
    sites = spark.createDataFrame([("s", "UTC", None)], SITES)
    records = [T.record(v, None, "UTC") for v in values]
    least, cost = brute(records)
    every = [p for p in product(T.STATES, repeat=len(records)) if abs(cost(p) - least) < 1e-9]
    for run in (2, 3, 1000):
        got = {r[0]: r[1] for r in T.normalise_timestamps(cards, sites, run=run).collect()}
        assert any(got == {k: r["us"][i] for k, (r, i) in enumerate(zip(records, p)) if r["us"][i] != T.NEVER} for p in every)


def test_records_overrule_a_wrong_declaration(spark):
    values = ["03/04/2023 10:00", "03/25/2023 10:00", "04/05/2023 10:00", "2023-04-07 10:00", "04/28/2023 10:00", "05/06/2023 10:00"]
    assert decoded(spark, values, "DMY") == {0: "2023-03-04", 1: "2023-03-25", 2: "2023-04-05", 3: "2023-04-07", 4: "2023-04-28", 5: "2023-05-06"}


@pytest.mark.parametrize("run", [4, 50_000])
def test_a_source_that_changes_its_order(spark, run):
    before = [f"{d:02d}/03/2023 10:00" for d in (14, 15, 16, 17, 18, 19)] + ["05/04/2023 10:00"]
    after = ["4/20/2023 10:00 AM", "2023-04-21T10:00:00Z", "4/22/2023 10:00 AM", "4/23/2023 10:00 AM", "5/1/2023 10:00 AM", "5/14/2023 10:00 AM"]
    got = decoded(spark, before + after, "DMY", run)
    assert got[6] == "2023-04-05" and got[11] == "2023-05-01" and len(got) == 13


def test_the_order_is_carried_through_plain_values(spark):
    values = ["03/25/2023 10:00", "03/26/2023 10:00", "2023-03-27 10:00", "1679997600", "04/05/2023 10:00"]
    assert decoded(spark, values, None)[4] == "2023-04-05"


def test_one_odd_value_is_impossible_rather_than_a_change(spark):
    values = [f"{d:02d}/03/2023 10:00" for d in (14, 15, 16)] + ["03/25/2023 10:00"] + [f"{d:02d}/04/2023 10:00" for d in (14, 15, 6)]
    assert decoded(spark, values, "DMY") == {0: "2023-03-14", 1: "2023-03-15", 2: "2023-03-16", 4: "2023-04-14", 5: "2023-04-15", 6: "2023-04-06"}


def test_jumps_back_decide_where_nothing_else_does(spark):
    assert decoded(spark, ["2023-03-01 10:00", "02/04/2023 10:00", "2023-04-03 10:00"], None)[1] == "2023-04-02"


def test_empty_table(spark):
    empty = spark.createDataFrame([], "card_id bigint, published_at string, provider string")
    assert T.normalise_timestamps(empty, spark.createDataFrame([], SITES)).count() == 0
