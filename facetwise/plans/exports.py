"""Text exports derived from the feeds, as suppliers send them: several files a role with
other columns, title lines above the header, blank and repeated headers, empty lines, a
file only its name identifies and one that belongs to no role."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetwise.session import shared_path
from facetwise.sources import feeds
from facetwise.sources.tables import read_table

_CSV = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "escape": '"'}

#: export -> (lines above the header, header); a title line may hold commas and quotes
HEADS = {
    "upload_a": ([], "Unique Stone ID,Shape,Weight,Color,Clarity,Cut,Polish,Symmetry,Fluorescence,Lab,Stone Location,Total,Status"),
    "upload_b": (["Listings", "made for: shape, color", ""], " unique stone id ,SHAPE,Weight,Color,Clarity,Cut,Polish,Symmetry,Fluorescence,Lab,,Total,Status,Status"),
    "stock_page": (["Own stock", '"Shape, all"', "", ",,", "page 1"], "Stock #,Shape,Weight,Color,Clarity,Cut,Polish,Symmetry,Fluorescence,Lab,Location,Price,Status"),
    "nightly_stock": ([], "Stock #,Shape,Weight,Color,Clarity,Cut,Polish,Symmetry,Fluorescence,Lab,Location,Price,Status"),
    "upload_d": (["Completed"], "Invoice No,Stone No,Sale Date,Shape,Color,Clarity,Carat,Sale Amt,Sale Rate"),
    "remarks": ([], "Name,Remark"),
}
HEADER_LINES = {name: len(head) for name, (head, _) in HEADS.items()}


def _lines(df: DataFrame, export: str, columns: list) -> DataFrame:
    """The rows of a frame as the data lines of an export."""
    line = F.to_csv(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(columns)]), _CSV)
    return df.select(F.lit(export).alias("export"), F.lit(1000).alias("ord"), line.alias("value"))


def exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(export, ord, value): all lines of all exports; lines of equal ord by value."""
    col = lambda *names: [F.col(f"`{n}`") for n in names]
    grades = ("Shape", "Weight", "Color", "Clarity", "Cut", "Polish", "Symmetry", "Fluorescence", "Lab")
    market, stock, sales = feeds.market_feed(spark, sf_dir), feeds.inventory_feed(spark, sf_dir), feeds.sales_feed(spark, sf_dir)
    live = F.col("Status") == "ON HAND"
    half = F.col("src_line") % 2 == 0
    parts = [
        _lines(market.where(live), "upload_a", col("Unique Stone ID", *grades, "Stone Location", "Total", "Status")),
        _lines(market.where(~live), "upload_b", [*col("Unique Stone ID", *grades), F.lit("x, y"), *col("Total", "Status"), F.lit('a "b"')]),
        _lines(stock.where(half), "stock_page", col("Packet #", *grades, "Location", "Price A", "Status")),
        _lines(stock.where(~half), "nightly_stock", col("Packet #", *grades, "Location", "Price A", "Status")),
        _lines(sales, "upload_d", [*col("Invoice No", "Stone No"), F.date_format("Sale Date", "dd/MM/yyyy"), *col("Shape", "Color", "Clarity", "Carat"),
                                   F.concat(F.lit("$"), F.col("Sale Amt").cast("string")), F.col("Sale Rate")]),
        _lines(read_table(spark, sf_dir, "nation", ["n_name", "n_nationkey"]), "remarks", col("n_name", "n_nationkey")),
    ]
    heads = [(name, i, line) for name, (above, header) in HEADS.items() for i, line in enumerate([*above, header])]
    heads += [("stock_page", 2000, ",,,"), ("stock_page", 2000, "")]  # empty lines below the data
    out = spark.createDataFrame(heads, "export string, ord int, value string")
    for part in parts:
        out = out.unionByName(part)
    return out


def written_exports(spark: SparkSession, sf_dir: str) -> str:
    """A folder of text files, below a folder of its name for each export, whose lines are
    dealt by range: a large export comes in several parts, in order of their names."""
    path = shared_path(spark, "exports", uuid.uuid4().hex)
    order = ["export", "ord", "value"]
    exports(spark, sf_dir).repartitionByRange(*order).sortWithinPartitions(*order).select("export", "value").write.partitionBy("export").text(path)
    return path


def export_of(path):
    """The file that a part belongs to: the folder of its export."""
    return F.regexp_extract(path, "^(.*/export=[^/]+)/", 1)


def export_name(path):
    return F.regexp_extract(path, "export=([^/]+)", 1)
