"""Queries whose time at size is the sales read and joined: each reads them once."""

import shutil
from datetime import date

import pytest
from pyspark.sql import functions as F

from demandloom import catalogue
from demandloom.catalogue import base, forecast, models
from demandloom.operators import absorbed as AB
from demandloom.operators import panel as P

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["P20_window_budget", "K12_sections", "R5_recon_six_levels"])
def test_sales_are_read_once(spark, monkeypatch, tmp_path, name):
    # tables of its own, so that no stored table of another test is found
    for t in base.SALES_TABLES:
        shutil.copy(f"{SF}/{t}.parquet", tmp_path / f"{t}.parquet")
    read, real = spark.sparkContext.accumulator(0), base.sales

    def counted(session, sf_dir):
        def run(batches):
            for b in batches:
                read.add(b.num_rows)
                yield b

        s = real(session, sf_dir)
        return s.mapInArrow(run, s.schema)

    for module in (base, forecast, models):
        monkeypatch.setattr(module, "sales", counted)
    monkeypatch.setattr(AB, "ROUNDS", 2)
    assert catalogue.queries()[name](spark, str(tmp_path)).collect()
    assert read.value == real(spark, str(tmp_path)).count()


def test_sums_by_day_give_the_means_of_the_rows(spark):
    rows = [
        (date(2024, 1, 1), "W", "s", "c", "c/1", "i", 2.0, 10.0, True), (date(2024, 1, 1), "W", "s", "c", "c/1", "i", 0.0, 7.0, None), (date(2024, 1, 3), "W", "s", "c", "c/1", "i", 4.0, 10.0, False),
        (date(2024, 1, 3), "W", "s", "c", "c/1", "i", None, 3.0, True), (date(2024, 1, 9), "W", "s", "c", "c/1", "i", 0.0, 5.0, None), (date(2024, 1, 9), "W", "s", "c", "c/1", "j", 1.0, 5.0, None),
    ]
    s = spark.createDataFrame(rows, "date date, state_id string, store_id string, cat_id string, dept_id string, item_id string, units double, revenue double, promo boolean")
    days, keys = P.daily(s, *P.FINEST), ["store_id", "cat_id", "item_id"]
    took = lambda d: sorted(map(str, d.select(*keys, "week", "units", "price", "promo").collect()))
    assert took(P.weekly_days(days, *keys)) == took(P.weekly(s, *keys))
    sums = lambda d: sorted(map(str, d.collect()))
    assert sums(P.roll_up_days(days, P.ALL_LEVELS)) == sums(P.roll_up(s, P.ALL_LEVELS))
    assert days.agg(F.sum("priced"), F.sum("marked")).first()[:] == (3, 3)
