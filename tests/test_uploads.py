"""Uploaded text files: numbering, headers, roles, unions and what is reported."""
import pytest
from pyspark.sql import functions as F

from facetwise.functions import dims
from facetwise.plans import exports
from facetwise.sources import uploads
from facetwise.sources.ingest import detect_role, normalize_headers, resolve_listing, resolve_sales, sequential_index

FILES = {
    "a.csv": "Unique Stone ID,Shape,Weight\nm1,RD,1.0\nm2,OV,\n",
    "b.csv": "Report\n,,\n\"made, for\"\n shape ,Shape,,Stone Location,\"x \"\"y\"\"\"\nRD,again,blank,INDIA,\"a,b\"\n\n , ,\nOV,short\nCU,1,2,3,4,too,long\n",
    "sales_2024.csv": "x,y\n1,2\n",
    "other.csv": "just a note\nshape,color\n",
    "long.csv": "\n" * 29 + "shape,color,packet #\nRD,D,1\n",
    "late.csv": "t\n" * 30 + "invoice no,shape,color\n1,RD,D\n",
    "tie.csv": "shape,color\nshape,color\nRD,D\n",
}


@pytest.fixture
def folder(tmp_path):
    for name, text in FILES.items():
        (tmp_path / name).write_text(text)
    return str(tmp_path)


def test_headers_roles_and_lines(spark, folder):
    files = {r["name"]: r for r in uploads.describe(uploads.numbered_lines(spark, folder)).collect()}
    assert {n: (r["header_line"], r["role"], r["lines"]) for n, r in files.items()} == {
        "a.csv": (0, "market", 2), "b.csv": (3, "market", 5), "sales_2024.csv": (0, "sales", 1), "other.csv": (1, None, 0),
        "long.csv": (29, "inventory", 1), "late.csv": (0, None, 31), "tie.csv": (0, None, 2)}
    assert files["b.csv"]["names"] == ["shape", "shape_2", "col_2", "stone location", 'x "y"']


def test_union_of_a_role(spark, folder):
    lines = uploads.numbered_lines(spark, folder)
    files = uploads.describe(lines)
    feed = uploads.role_feed(uploads.rows_of(lines, files), files, "market")
    assert feed.columns == ["shape", "unique stone id", "shape_2", "col_2", "weight", "stone location", 'x "y"', "_row"]
    rows = sorted(tuple(r) for r in feed.collect() for r in [r[-1:] + r[:-1]])
    assert rows == [(1, "RD", "m1", None, None, "1.0", None, None), (2, "OV", "m2", None, None, None, None, None), (3, "RD", None, "again", "blank", None, "INDIA", "a,b"),
                    (6, "OV", None, "short", None, None, None, None), (7, "CU", None, "1", "2", None, "3", "4")]
    got = {(r["source"], r["state"]): (r["files"], r["rows"]) for r in uploads.status(files, uploads.rows_of(lines, files)).collect()}
    assert got == {("market", "loaded"): (2, 5), ("inventory", "loaded"): (1, 1), ("sales", "loaded"): (1, 1), ("other.csv", "ignored"): (1, 0), ("late.csv", "ignored"): (1, 0), ("tie.csv", "ignored"): (1, 0)}
    few = files.where("role is null or role = 'sales'")
    assert {r["source"] for r in uploads.status(few, uploads.rows_of(lines, few)).where("state = 'missing'").collect()} == {"market", "inventory"}


def test_line_numbers_do_not_depend_on_the_splits(spark, tmp_path):
    for f in range(3):
        (tmp_path / f"f{f}.txt").write_text("".join(f"{f} {i} {'x' * (i % 50)}\n" for i in range(2000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        for size, cost in (("4096", "0"), ("134217728", "4194304")):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", cost)
            lines = uploads.numbered_lines(spark, str(tmp_path))
            assert lines.count() == 6000 and lines.where("line_no <> cast(split(value, ' ')[1] as long)").count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_names_and_roles_follow_the_driver_rules(spark):
    headers = [[" Shape ", "shape", "x"], ["a", "a_2", "a", "a"], ["stone location", "Invoice No"], ["price a"], ["color"], ["PACKET #"]]
    df = spark.createDataFrame([(h, n) for h in headers for n in ("x.csv", "VDB_list.csv", "old_stock_invoice.csv")], "h array<string>, n string")
    for r in df.select("h", "n", uploads.unique_names(df["h"]).alias("names"), uploads.role_of(uploads.unique_names(df["h"]), df["n"]).alias("role")).collect():
        assert r["names"] == normalize_headers(r["h"]) and r["role"] == detect_role(r["names"], r["n"])
    assert set(dims.ROLE_HEADER_HINTS) == set(uploads.ROLES)


def test_row_numbers_are_the_same_on_every_evaluation(spark):
    df = sequential_index(spark.range(0, 1000, 1, 7).toDF("v").where("v % 3 <> 0"), "i")
    first = {r["v"]: r["i"] for r in df.collect()}
    assert sorted(first.values()) == list(range(666))
    assert {r["v"]: r["i"] for r in df.repartition(3).where("v > 500").collect()} == {v: i for v, i in first.items() if v > 500}


def test_listing_aliases_set_clashing_columns_aside(spark):
    df = spark.createDataFrame([("i1", "12", "99")], "`packet #` string, `price a` string, price string")
    assert resolve_listing(df, "inventory").first().asDict() == {"stone_id": "i1", "price": 12.0, "price_other": "99", "country": "INDIA"}


def test_sales_take_the_first_candidate_with_a_value(spark):
    df = spark.createDataFrame([("1", "5", ""), ("2", None, "7"), ("3", "", None)], "`invoice no` string, `final amt` string, amount string")
    rows = resolve_sales(df).select("invoice", "amount").collect()
    assert [(r["invoice"], r["amount"]) for r in rows] == [("1", 5.0), ("2", 7.0), ("3", None)]


def test_a_file_in_parts_is_numbered_as_one(spark, tmp_path, monkeypatch):
    """An export is written by several tasks, and its parts are one file with one header."""
    rows = [("a", 0, "t"), ("a", 1, "shape,color")] + [("a", 1000, f"RD,{i:04d}") for i in range(3000)] + [("b", 0, "invoice no,shape,color"), ("b", 1000, "1,RD,D")]
    monkeypatch.setattr(exports, "exports", lambda s, d: s.createDataFrame(rows, "export string, ord int, value string").repartition(4))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        folder = exports.written_exports(spark, "")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    parts = [r[0] for r in spark.read.text(f"{folder}/export=a").select(F.col("_metadata.file_name")).distinct().collect()]
    assert len(parts) > 1
    lines = uploads.numbered_lines(spark, folder, exports.export_of)
    got = [r["value"] for r in lines.where("endswith(file, '=a')").orderBy("line_no").collect()]
    assert got == [v for e, _, v in rows if e == "a"] and lines.agg(F.max("line_no")).first()[0] == 3001
    files = {r["name"]: (r["header_line"], r["role"], r["lines"]) for r in uploads.describe(lines, exports.export_name).collect()}
    assert files["a"][0] == 1 and files["a"][2] == 3000 and files["b"] == (0, "sales", 1)
