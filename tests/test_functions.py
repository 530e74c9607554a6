"""Operator edge rows on tiny literal frames."""
from datetime import date

from pyspark.sql import functions as F

from facetwise.functions import exprs as X
from facetwise.functions import stats as ST
from facetwise.functions.quality import quality_filter


def one(spark, expr, rows, schema="x string"):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_canon_shape(spark):
    got = one(spark, X.canon_shape(F.col("x")), [("RD",), ("SQ EMERALD",), ("LONG FOO",), (" pear ",), (None,),
                                                 ("SQ FOO",), ("lg rad",)])
    assert got == ["ROUND", "EMERALD", "LONG", "PEAR", None, "SQ", "RADIANT"]


def test_clean_number(spark):
    got = one(spark, X.clean_number(F.col("x")), [("$1,250",), ("",), ("0",), ("abc",), (None,), (" 12.5 ",)])
    assert got == [1250.0, None, 0.0, None, None, 12.5]


def test_parse_date(spark):
    got = one(spark, X.parse_date(F.col("x")), [("2024-05-06T07:08:09Z",), ("31/12/2024",), ("12/31/2024",),
                                                ("1/2/2024",), ("junk",), ("2024",)])
    assert got == [date(2024, 5, 6), date(2024, 12, 31), date(2024, 12, 31), date(2024, 2, 1), None, None]


def test_size_range_gaps(spark):
    got = one(spark, X.size_range(F.col("x")), [(0.89,), (0.90,), (0.99,), (0.995,), (1.105,), (20.99,), (21.0,), (None,)],
              "x double")
    assert got == [None, "0.90-0.99", "0.90-0.99", None, None, "15.00-20.99", None, None]


def test_price_band_boundaries(spark):
    got = one(spark, X.price_band(F.col("x")), [(0.0,), (19.99,), (20.0,), (40.0,), (60.0,), (80.0,), (100.0,), (101.0,),
                                                (None,)], "x double")
    assert got == [-0.02, -0.02, -0.01, 0.0, 0.01, 0.02, 0.03, 0.03, None]


def test_rnd_half_up_on_decimal_form(spark):
    got = one(spark, X.rnd(F.col("x"), 2), [(2.675,), (0.125,), (-2.675,)], "x double")
    assert got == [2.68, 0.13, -2.68]
    # beyond the range of a narrow decimal
    assert one(spark, X.rnd(F.col("x"), 2), [(1.5e13,), (None,)], "x double") == [1.5e13, None]


def test_keep_last(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("a", 2, "z"), ("b", 1, "w")], "k string, seq int, v string")
    got = sorted(tuple(r) for r in ST.keep_last(df, ["k"], ["seq"]).collect())
    assert got == [("a", 3, "y"), ("b", 1, "w")]
    # idempotent
    again = sorted(tuple(r) for r in ST.keep_last(ST.keep_last(df, ["k"], ["seq"]), ["k"], ["seq"]).collect())
    assert again == got


def _brute(values, q):
    v = sorted(values)
    return v[int((len(v) - 1) * q + 0.5)]


def test_nearest_rank_of_hot_and_small_groups(spark):
    import random
    rng = random.Random(7)
    rows = [("hot", float(rng.randint(1, 5000))) for _ in range(3000)] + [("hot", 17.25)] * 900 + \
           [("cold", rng.uniform(-3, 3)) for _ in range(37)] + [("zero", 0.0), ("zero", -1e300), ("zero", 1e-300), ("one", 5.0)] + \
           [("ends", v) for v in (float("-inf"), 1.0, float("inf"), float("nan"))] + [(None, 1.0), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    groups = {k: [v for kk, v in rows if kk == k] for k in ("hot", "cold", "zero", "one")}
    for q in (0.0, 0.01, 0.10, 0.5, 1.0):
        got = {r.k: r.q for r in ST.nearest_rank_by_key(df, ["k"], "v", q, "q").collect()}
        ends = got.pop("ends")
        assert got == {k: _brute(v, q) for k, v in groups.items()}
        at = int(3 * q + 0.5)
        assert ends != ends if at == 3 else ends == [float("-inf"), 1.0, float("inf")][at]


def test_median_of(spark):
    df = spark.createDataFrame([(1.0, None, 3.0), (None, None, None), (4.0, 1.0, 2.0), (5.0, None, None)],
                               "a double, b double, c double")
    got = [r[0] for r in df.select(ST.median_of(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert got == [2.0, None, 2.0, 5.0]


def test_quality_3x_and_market_only(spark):
    df = spark.createDataFrame([("EXCELLENT", "EXCELLENT", "EXCELLENT", "INDIA"), ("EXCELLENT", "VERY GOOD", "EXCELLENT", "INDIA"),
                                ("EXCELLENT", "EXCELLENT", "EXCELLENT", "USA")], "cut string, polish string, symmetry string, country string")
    f = {"cut": "3X", "country": "INDIA"}
    assert quality_filter(df, f, "market").count() == 1
    assert quality_filter(df, f, "inventory").count() == 2  # country never filters inventory


def test_quality_3x_on_sales_reads_short_grades(spark):
    df = spark.createDataFrame([("EX", "ex ", "EX"), ("EX", "VG", "EX"), ("ID", "EX", "EX")], "cut string, polish string, symmetry string")
    assert quality_filter(df, {"cut": "3X"}, "sales").count() == 1


def test_size_range_at_bounds_and_gaps(spark):
    from facetwise.functions import dims
    carats = sorted({round(x + e, 4) for _, lo, hi in dims.SIZE_MASTER for x in (lo, hi) for e in (-0.01, -0.005, -0.0001, 0, 0.0001, 0.005, 0.01)})
    want = [next((n for n, lo, hi in dims.SIZE_MASTER if lo <= c <= hi), None) for c in carats]
    assert one(spark, X.size_range("x"), [(c,) for c in carats], "x double") == want
    odd = [(None,), (-1.0,), (0.0,), (1e300,), (float("nan"),)]
    assert one(spark, X.size_range("x"), odd, "x double") == [None] * 5


def test_sequential_index(spark):
    from facetwise.sources.ingest import sequential_index
    df = spark.range(0, 1000, 1, 7).toDF("v")
    got = sequential_index(df, "i").select("i").collect()
    assert sorted(r.i for r in got) == list(range(1000))


def test_header_helpers():
    from facetwise.sources.ingest import detect_role, normalize_headers
    assert normalize_headers([" Shape ", "", "shape", None]) == ["shape", "column_2", "shape_2", "column_4"]
    assert normalize_headers(["a", "a_2", "a", "a"]) == ["a", "a_2", "a_3", "a_4"]
    assert detect_role(["stone location"], "sales_2024.csv") == "sales"
    assert detect_role(["Invoice No", "Shape"], "x.csv") == "sales"
    assert detect_role(["Unique Stone ID"], "") == "market"
    assert detect_role(["Shape"], "diamax_export.csv") == "inventory"
    assert detect_role(["Shape"], "other.csv") is None
