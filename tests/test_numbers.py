"""Number words against known phrases."""

from pyspark.sql import functions as F

from narrata.functions import numbers_pl as N

CARDINALS = {0: "zero", 11: "jedenaście", 100: "sto", 238: "dwieście trzydzieści osiem", 1000: "tysiąc", 2021: "dwa tysiące dwadzieścia jeden", 12000: "dwanaście tysięcy", 22000: "dwadzieścia dwa tysiące", 1000001: "milion jeden", -1: None, 10**12: None}
ORDINALS = {8: "ósmy", 14: "czternasty", 100: "setny", 1939: "tysiąc dziewięćset trzydziesty dziewiąty"}


def test_numbers(spark):
    rows = spark.createDataFrame([(n,) for n in {*CARDINALS, *ORDINALS}], "n long").select("n", N.cardinal(F.col("n")).alias("c"), N.ordinal(F.col("n")).alias("o"), N.cardinal_feminine(F.col("n")).alias("f")).collect()
    for r in rows:
        if r.n in CARDINALS:
            assert r.c == CARDINALS[r.n]
        if r.n in ORDINALS:
            assert r.o == ORDINALS[r.n]
        if r.n == 2021:
            assert r.f == "dwa tysiące dwadzieścia jedna"


def test_clock(spark):
    rows = spark.createDataFrame([(14, 30), (18, 0), (22, 5), (24, 0)], "h int, m int").select("h", N.clock(F.col("h"), F.col("m")).alias("s")).collect()
    assert {r.h: r.s for r in rows} == {14: "czternastej trzydzieści", 18: "osiemnastej", 22: "dwudziestej drugiej pięć", 24: None}
