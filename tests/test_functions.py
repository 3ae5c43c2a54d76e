from pyspark.sql import functions as F

from nomena.functions import text, years


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_names(spark):
    assert one(spark, text.normalize_name(F.lit("市川　団十郎〈7〉（七代目）"))) == "市川団十郎"
    assert one(spark, text.mention_base(F.lit("岩井 (半四郎) 紫若〈2〉(a)"))) == "岩井 (半四郎) 紫若"
    assert one(spark, text.normalize_generic(F.lit("Straße "), F.lit("de"))) == "strasse"
    assert one(spark, text.normalize_generic(F.lit("RāmaA"), F.lit("sa"))) == "RāmaA"
    assert one(spark, text.normalize_name(F.lit(None).cast("string"))) == ""


def test_years(spark):
    i = lambda x: F.lit(x).cast("int")
    assert one(spark, years.covers(i(1800), i(1810), i(1810)))
    assert not one(spark, years.covers(i(0), i(1810), i(1805)))
    assert not one(spark, years.covers(i(1800), i(None), i(1805)))
    score = lambda y, p, b, d, h: one(spark, years.year_score(i(y), F.lit(p), i(b), i(d), F.lit(h)))
    assert [score(1800, True, 1, 2, True), score(1800, False, 1790, 1800, True), score(1800, False, 1700, 1794, True), score(1800, False, 1700, 1795, True), score(0, True, 1, 2, True), score(1800, False, None, None, False)] == [3, 2, -1, 1, 3, 0]  # only a missing year is none


def test_window_keeps_year_token(spark):
    left, _ = text.window_context(F.lit("abcdef [年:1800|書:X] "), F.lit("xyz"), 3)
    assert one(spark, left) == "def [年:1800|書:X] "
