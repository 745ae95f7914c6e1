"""Converters on the notations that documents use, references on codes of any number of parts, tables of one type."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from proofloom.functions import text as T
from proofloom.operators import journal as J
from proofloom.operators import lookup as U

A = "0123456789abcdef" * 4


@pytest.mark.parametrize(
    "f,examples",
    [
        (T.canonical_number, {"1.485 rpm": "1485", "60,0 kW": "60.0", "3,90": "3.90", "60.0": "600", "1234.567": "1234567", "+5": "+5", "-1.000,50": "-1000.50", "Total: 7.": "7", "1,2,3": None, "none": None, "": None, ",5": "5", None: None}),
        (T.unit_of, {"60 kW": "kW", "60   kWh/año": "kWh/a", "1.485rpm": "rpm", "20 °C": None, "5 %": "%", "no unit": None, "12; 7 m/s": "m/s", None: None}),
        (T.serial_of, {"n. MTR-AB12-XY9 here": "MTR-AB12-XY9", "vsd-01-a2-b3-c4-d5": "VSD-01-A2-B3-C4", "A-12": None, "ABCDE-12": None, "MTR-1": None, "MTR-1234567": None, None: None}),
        (T.hash_of, {f"sha {A.upper()}.": A, A + "0": None, A[:-1]: None, f"x{A}": None, None: None}),
        (T.iso_date, {"on 3/4/2024.": "2024-04-03", "2024-04-03": "2024-04-03", "13/12/2023 and 2020-01-01": "2023-12-13", "1/2/20245": None, "day": None, None: None}),
    ],
)
def test_converters(spark, f, examples):
    df = spark.createDataFrame([(k,) for k in examples], "x string")
    assert {r.x: r.y for r in df.select("x", f(F.col("x")).alias("y")).collect()} == examples


def test_instants_without_a_time(spark):
    df = spark.createDataFrame([("2024-02-29",), ("29/02/2024 10:30",), ("2024-02-29T10:30:05",), ("2024-02-30",), (None,)], "x string")
    said = [r[0] for r in df.select(T.instant_text(T.tolerant_instant(F.col("x")))).collect()]
    assert said == ["2024-02-29T00:00:00Z", "2024-02-29T10:30:00Z", "2024-02-29T10:30:05Z", None, None]


def test_references_of_any_number_of_parts(spark):
    index = spark.createDataFrame([("A-B-C-D", 1), ("A-B-C", 2), ("Z", 3), ("Y", 3), ("P-Q-R-S-T-U", 4)], "code string, case_id int")
    refs = spark.createDataFrame([("A-B-C-D",), ("A-B-C",), ("X-A-B-C",), ("X-A-B-C-D",), ("1-P-Q-R-S-T-U-2",), ("Z-Y",), (" Z ",), ("AZ",), ("",), (None,)], "ref string")
    found = {r.ref: r.case_id for r in J.resolved(refs, "ref", index, "code", "case_id").collect()}
    assert found == {"A-B-C-D": 1, "A-B-C": 2, "X-A-B-C": 2, "X-A-B-C-D": None, "1-P-Q-R-S-T-U-2": 4, "Z-Y": None, " Z ": 3, "AZ": None, "": None, None: None}
    assert J.resolved(refs, "ref", index.where("1 = 0"), "code", "case_id").where("case_id is not null").count() == 0


@pytest.mark.parametrize("most", [10, 0])
def test_interpolation_has_one_type(spark, most):
    table = spark.createDataFrame([(90, Decimal("14.2")), (110, Decimal("15.7"))], "k int, v decimal(9,3)")
    rows = spark.createDataFrame([(100,), (90,), (80,), (None,)], "x int")
    found = U.interpolate(rows, "x", table, "k", "v", "y", most)
    assert dict(found.dtypes)["y"] == "decimal(28,12)"
    assert {r.x: r.y for r in found.collect()} == {100: Decimal("14.95"), 90: Decimal("14.2"), 80: None, None: None}
    assert dict(U.interpolate(rows, "x", table.withColumn("v", F.col("v").cast("double")), "k", "v", "y", most).dtypes)["y"] == "double"
