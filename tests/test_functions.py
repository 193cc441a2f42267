import pytest
from pyspark.sql import functions as F

from ostinato.functions import text as T
from ostinato.functions import times


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize(("given", "wanted"), [("Rock's Best!", "rocks best"), ("  A   b_c ", "a b_c"), (None, ""), ("Été²", "été²")])
def test_normalize(spark, given, wanted):
    assert one(spark, given, T.normalize) == wanted


@pytest.mark.parametrize(("given", "wanted"), [("A - B - C.mp3", ("A", "B - C")), ("GetLucky.mp3", ("", "GetLucky")), ("x/Y - Z.tar.gz", ("Y", "Z.tar"))])
def test_parse_filename(spark, given, wanted):
    assert tuple(one(spark, given, T.parse_filename)) == wanted


@pytest.mark.parametrize(("given", "wanted"), [("H-W-*3", ["H", "W"]), ("A-F-U", []), ("Dub Electronica", []), (None, []), ("D-D", ["D"])])
def test_label_codes(spark, given, wanted):
    assert one(spark, given, T.label_codes) == wanted


@pytest.mark.parametrize(("given", "wanted"), [("(D or H) and not P", [True, False, False]), ("not d or p", [False, True, True])])
def test_expression(spark, given, wanted):
    rows = spark.createDataFrame([(["D"],), (["H", "P"],), ([],)], "c array<string>")
    assert [r[0] for r in rows.select(T.code_expression(given, {"D", "H", "P"}, F.col("c"))).collect()] == wanted


@pytest.mark.parametrize("bad", ["", "X", "D &", "(D", "D H", "and"])
def test_expression_errors(spark, bad):
    with pytest.raises(T.ExpressionError):
        T.code_expression(bad, {"D", "H"}, F.array())


def test_toggle_and_cycle(spark):
    assert one(spark, "H-D-*2", lambda c: T.toggle_code(c, "B")) == "B-D-H-*2"
    assert one(spark, "H-D-*2", lambda c: T.toggle_code(c, "H")) == "D-*2"
    assert [one(spark, g, T.cycle_rating) for g in ("H", "H-*4", "H-*5")] == ["H-*1", "H-*5", "H"]


def test_sequence_ratio_is_not_symmetric(spark):
    rows = spark.createDataFrame([("tide", "diet"), ("diet", "tide")], "a string, b string").select(T.sequence_ratio("a", "b")).collect()
    assert [r[0] for r in rows] == [0.25, 0.5]


def test_times(spark):
    assert one(spark, 3_725_999, times.minutes, "long") == "62:05"
    assert one(spark, 3_725_999, times.clock, "long") == "01:02:05"
    assert one(spark, 370_493, times.cue_time, "long") == "06:10:36"
    assert [one(spark, x, times.from_minutes) for x in ("03:05", "3:60", "x", "100:00")] == [185_000, None, None, 6_000_000]
    assert [one(spark, x, times.from_cue_time) for x in ("06:10:37", "1:2")] == [370_493, 0]
    assert [one(spark, x, times.whole, "long") for x in (500, 1500, 2500, 370_493)] == [0, 2000, 2000, 370_000]
