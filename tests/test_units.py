import pytest
from pyspark.sql import functions as F

from carrel.functions.units import LENGTH, observed_length_um, parse_unit, quantities
from carrel.operators.units import EDD_LABEL, convert_lengths


@pytest.mark.parametrize(
    "field, neighbour, um",
    [
        ("12 mm", None, 12000), ("1,2 cm", None, 12000), (".9cms", None, 9000), ('0.5 "', None, 12700), ("0.038m in long axis", None, 38000), ("4.1 x 5.9 cm", None, 59000), ("0.33 inchx0.27 inch", None, 8382),
        ("9 mmx4 mm", None, 9000), ("0.16 in short axis", None, 4064), ("4729 µm", None, 4729), ("5 mm, was 8 mm", None, 5000), ("now 18 mm, before 21 mm", None, 18000), ("35 mm, series 3 image 40", None, 35000), ("6.2 cm (normal < 58 mm)", None, 62000),
        ("645 mm2", None, None), ("22 cm³", None, None), ("12 mL", None, None), ("27 mm/m²", None, None), ("0.5 g/cm2", None, None), ("110 cm/s", None, None), ("7 degrees", None, None), ("segment 6", None, None), ("n/a", None, None), ("3.6", None, None),
        ("3.6", "thrombus, size in cm", 36000), ("3.6", "3.6 cm thrombus", 36000), ("3.6", "9 mm thrombus", None), ("", "size in cm", None), (None, "size in cm", None),
    ],
)
def test_lengths(field, neighbour, um):
    assert (observed_length_um(field, neighbour) if field is not None else None) == um


@pytest.mark.parametrize(
    "field, text, um",
    [("5.4", "LVEDD (2D) 5.4 cm. LVIDs 30 mm.", 54000), ("47.7", "LVIDd (mm): 47.7. LVESD 3 cm", 47700), ("6.22", "LV end-diastolic diameter 6.22. LVIDs 4.0 cm.", None), ("34", "mm used for all chamber sizes: LVEDD 34, LVESD 20.", 34000), ("6.1", "Dimensions in cm\nLVIDd | 6.1\nRoot | 3", 61000)],
)
def test_unit_beside_the_measure(field, text, um):
    assert observed_length_um(field, text, EDD_LABEL) == um


def test_exponents():
    unit, _ = parse_unit("mm/m²")
    assert unit.exponents == (-1, 0, 0, 0, 0)
    assert parse_unit("kg")[0].exponents == (0, 1, 0, 0, 0)
    assert float(quantities("37 °C")[0].canonical) == pytest.approx(310.15)
    assert quantities("3 cm")[0].unit.exponents == LENGTH


def test_table_rows(spark):
    df = spark.createDataFrame([(1, "1 cm", "x"), (1, "1 cm", "x"), (2, None, None), (None, "1 cm", "x"), (3, "2" * 50, "y"), (4, "5 mm", None)], "id long, f string, output_id string")
    rows = {(r.output_id, r.value_um) for r in convert_lengths(df, "id", F.col("f"), F.col("output_id"), "t").collect()}
    assert rows == {(1, 10000), (4, 5000)}
    assert convert_lengths(df.limit(0), "id", F.col("f"), F.col("output_id"), "t").count() == 0
