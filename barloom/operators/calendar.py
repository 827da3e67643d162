"""Calendar columns of the bar date."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.features import Catalog
from barloom.functions import windows as W
from barloom.schema import TIME


def register(cat: Catalog) -> None:
    add = lambda name, build: cat.add("calendar", name, build)
    add("Day_of_Week", lambda c: F.weekday(c(TIME)))
    add("Month", lambda c: F.month(c(TIME)))
    add("Year", lambda c: F.year(c(TIME)))
    add("Quarter", lambda c: F.quarter(c(TIME)))
    add("Week_of_Year", lambda c: F.weekofyear(c(TIME)))

    def month_end(c):
        return c(TIME) == F.last_day(c(TIME))

    add("Is_Month_End", lambda c: W.flag(month_end(c)))
    add("Is_Quarter_End", lambda c: W.flag(month_end(c) & (F.month(c(TIME)) % 3 == 0)))
    for day in range(5):
        add(f"Day_{day}", lambda c, day=day: W.flag(F.weekday(c(TIME)) == day))
    for month in range(1, 13):
        add(f"Month_{month}", lambda c, month=month: W.flag(F.month(c(TIME)) == month))
