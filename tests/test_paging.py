"""Pages by cursor and by number equal slices of the sorted list, and are read from few slices."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from procspark.operators import paging


def listed(spark, tmp_path, n=300, slices=10):
    """Ties in time, rows without a time."""
    start = dt.datetime(2026, 1, 1)
    rows = [(f"k{i * 7919 % 1000:03d}", None if i % 29 == 0 else start + dt.timedelta(hours=i * 31 % 40), i % 5) for i in range(n)]
    table = spark.createDataFrame(rows, "key string, at timestamp_ntz, kind int")
    order = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or start).timestamp(), r[0]))
    return order, paging.write_listing(table, str(tmp_path / "list"), "at", "key", slices)


def test_joined_pages_are_the_whole_list(spark, tmp_path):
    order, pages = listed(spark, tmp_path)
    assert pages.total == len(order) and len(pages.zones) > 4
    got, cursor = [], None
    while rows := pages.after(cursor, 37).collect():
        got += map(tuple, rows)
        cursor = (rows[-1].at, rows[-1].key)
    assert got == order


def test_filtered_pages(spark, tmp_path):
    order, pages = listed(spark, tmp_path)
    wanted = [r for r in order if r[2] == 3]
    cursor = (wanted[20][1], wanted[20][0])
    assert list(map(tuple, pages.after(cursor, 15, F.col("kind") == 3).collect())) == wanted[21:36]
    assert pages.after(cursor, 15, F.col("kind") == 9).count() == 0


@pytest.mark.parametrize("number", [1, 2, 7, 12, 13, 14, 40])
def test_numbered_pages(spark, tmp_path, number):
    order, pages = listed(spark, tmp_path)
    assert list(map(tuple, pages.page(number, 23).collect())) == order[(number - 1) * 23:number * 23]


def test_a_deep_page_reads_few_slices(spark, tmp_path):
    order, pages = listed(spark, tmp_path)
    for rows in (pages.page(12, 10), pages.after((order[250][1], order[250][0]), 10)):
        assert len({f.rsplit("/", 2)[1] for f in rows.inputFiles()}) <= 2


def test_an_empty_listing(spark, tmp_path):
    none = spark.createDataFrame([], "key string, at timestamp_ntz")
    pages = paging.write_listing(none, str(tmp_path / "none"), "at", "key")
    assert pages.total == 0 and pages.page(1, 5).count() == 0 and pages.after(None, 5).count() == 0
