from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pagemill.operators.extract import parse_date

FORMS = {
    "2024-03-05": "2024-03-05 00:00:00",
    "2024-03-05T10:20:30Z": "2024-03-05 10:20:30",
    "2024-03-05T10:20:30+02:00": "2024-03-05 08:20:30",
    "2024-03-05 10:20": "2024-03-05 10:20:00",
    "20240305": "2024-03-05 00:00:00",
    "20240305T10:20:30Z": "2024-03-05 10:20:30",
    "2024.03.05": "2024-03-05 00:00:00",
    "2024/3/5 7:08": "2024-03-05 07:08:00",
    "3/5/2024": "2024-03-05 00:00:00",
    "3/5/24": "2024-03-05 00:00:00",
    "3/5/69": "1969-03-05 00:00:00",
    "25/12/2023": "2023-12-25 00:00:00",
    "25.12.2023": "2023-12-25 00:00:00",
    "25-12-23 18:30": "2023-12-25 18:30:00",
    "2023-25-12": "2023-12-25 00:00:00",
    "March 5, 2024": "2024-03-05 00:00:00",
    "Mar. 5, 2024": "2024-03-05 00:00:00",
    "5 March 2024": "2024-03-05 00:00:00",
    "5th of March 2024": "2024-03-05 00:00:00",
    "the 3rd of May, 2021": "2021-05-03 00:00:00",
    "March 1st, 2024 at 3:45 pm": "2024-03-01 15:45:00",
    "Sept 9, 2020": "2020-09-09 00:00:00",
    "9-Sep-20": "2020-09-09 00:00:00",
    "09SEP2020": "2020-09-09 00:00:00",
    "2020 Sep 9": "2020-09-09 00:00:00",
    "Sep 2020": "2020-09-01 00:00:00",
    "2020, September": "2020-09-01 00:00:00",
    "09/2020": "2020-09-01 00:00:00",
    "Tuesday, 5 March 2024": "2024-03-05 00:00:00",
    "Tue, 05 Mar 2024 10:20:30 GMT": "2024-03-05 10:20:30",
    "Tue, 05 Mar 2024 10:20:30 +0530": "2024-03-05 04:50:30",
    "Tue Mar 5 10:20:30 2024": "2024-03-05 10:20:30",
    "Tue Mar 05 2024 10:20:30 GMT+0200 (CEST)": "2024-03-05 08:20:30",
    "5 Mar 2024 10:20 EST": "2024-03-05 15:20:00",
    "March 5 2024 12:05 a.m.": "2024-03-05 00:05:00",
    "March 5 2024, 12 PM": "2024-03-05 12:00:00",
    "10am on 5 March 2024": "2024-03-05 10:00:00",
    "10:20 05.03.2024": "2024-05-03 10:20:00",
    "Feb 29 2024": "2024-02-29 00:00:00",
    "MARCH 5 2024 23:59:59.5 -08:00": "2024-03-06 07:59:59.5",
    "march 5 '24": "2024-03-05 00:00:00",
}
NO_DATES = [
    "", "soon", "March", "5 March", "Feb 30 2024", "13 pm 5 March 2024", "written by Ann on 5 March 2024", "may 5 june 6 2024",
    "2024-13-45", "version 1.2.3", "1/2/3/4", "10:20", "1700000000", "5 March 2024 25:00", "3 of 7 pages", "1 to 2 2024",
]


@pytest.mark.parametrize("column, wanted", [("text", FORMS), ("text", dict.fromkeys(NO_DATES))])
def test_dates_in_free_form(spark, column, wanted):
    df = spark.createDataFrame([(t,) for t in [*wanted, None]], f"{column} string")
    found = df.select(column, F.regexp_replace(parse_date(F.col(column)).cast("string"), r"\.0+$", "").alias("at")).collect()
    assert {r[column]: r["at"] for r in found} == {**wanted, None: None}
