"""Colour science against published values and inverses."""

import pytest

from pixelweir.functions import color, text

# Pairs of LAB colours with their CIEDE2000 difference, from the published test data of Sharma, Wu and Dalal.
CIEDE2000 = [
    (50.0, 2.6772, -79.7751, 50.0, 0.0, -82.7485, 2.0425),
    (50.0, 3.1571, -77.2803, 50.0, 0.0, -82.7485, 2.8615),
    (50.0, -1.3802, -84.2814, 50.0, 0.0, -82.7485, 1.0000),
    (50.0, 0.0, 0.0, 50.0, -1.0, 2.0, 2.3669),
    (50.0, 2.49, -0.001, 50.0, -2.49, 0.0009, 7.1792),
    (50.0, 2.49, -0.001, 50.0, -2.49, 0.0011, 7.2195),
    (50.0, -0.001, 2.49, 50.0, 0.0009, -2.49, 4.8045),
    (50.0, 2.5, 0.0, 50.0, 0.0, -2.5, 4.3065),
    (50.0, 2.5, 0.0, 73.0, 25.0, -18.0, 27.1492),
    (60.2574, -34.0099, 36.2677, 60.4626, -34.1751, 39.4387, 1.2644),
    (22.7233, 20.0904, -46.6940, 23.0331, 14.9730, -42.5619, 2.0373),
    (90.8027, -2.0831, 1.4410, 91.1528, -1.6435, 0.0447, 1.4441),
    (2.0776, 0.0795, -1.1350, 0.9033, -0.0636, -0.5514, 0.9082),
]


def test_ciede2000(spark):
    df = spark.createDataFrame(CIEDE2000, "l1 double, a1 double, b1 double, l2 double, a2 double, b2 double, want double")
    for r in color.with_delta_e2000(df, ("l1", "a1", "b1"), ("l2", "a2", "b2")).collect():
        assert r.de == pytest.approx(r.want, abs=1e-4)


def test_lab_and_back(spark):
    rows = [(r, g, b) for r in range(0, 256, 51) for g in range(0, 256, 51) for b in range(0, 256, 51)] + [(1, 2, 3), (254, 255, 250)]
    df = color.with_lab(spark.createDataFrame(rows, "r int, g int, b int"))
    from pyspark.sql import functions as F

    back = color.lab_to_rgb(*[F.col(c) for c in ("l", "la", "lb")])
    got = df.select("*", *[c.alias(f"{n}2") for c, n in zip(back, "rgb", strict=True)]).collect()
    assert all((x.r, x.g, x.b) == (x.r2, x.g2, x.b2) for x in got)
    white = next(x for x in got if (x.r, x.g, x.b) == (255, 255, 255))
    assert white.l == pytest.approx(100, abs=0.01) and abs(white.la) < 0.02 and abs(white.lb) < 0.02


def test_numbers_and_names(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(v,) for v in (0.125, -0.001, 100.0, 2.5, -3.456, 0.0, 1e6)], "v double")
    assert [r[0] for r in df.select(text.number(F.col("v"))).collect()] == ["0.12", "0", "100", "2.5", "-3.46", "0", "1000000"]
    names = spark.createDataFrame([("../../etc/passwd",), ("C:\\x\\é ü.png",), ("",), (None,), ("a" * 300,)], "n string")
    assert [r[0] for r in names.select(text.safe_filename(F.col("n"))).collect()] == ["passwd", "é ü.png", "upload", "upload", "a" * 200]
