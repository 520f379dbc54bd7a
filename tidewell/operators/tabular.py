"""Spreadsheets as long tables of cells: statistics from wide series, and readable text.

Cells are (key, sheet, row_idx, col_idx, raw); a sheet is small (one workbook page), files
are many, so every step groups by (key, sheet) and nothing meets beyond that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.detect import detect_country, detect_year, looks_like_period, to_number
from tidewell.functions.text import scrub, strip

SHEET = ("key", "sheet")
HEADER_ROWS = 8
LABEL_CHARS = 200
MARKDOWN_ROWS = 40


def compacted(cells: DataFrame) -> DataFrame:
    """Non-empty cells with rows and columns renumbered: all-empty ones are gone."""
    sheet = Window.partitionBy(*SHEET)
    full = cells.filter(F.col("raw").isNotNull())
    return full.withColumn("r", F.dense_rank().over(sheet.orderBy("row_idx")) - 1).withColumn("c", F.dense_rank().over(sheet.orderBy("col_idx")) - 1)


def statistics(cells: DataFrame, file_country: str | None = None) -> DataFrame:
    """Long statistics of wide sheets.

    The header is the first of the first eight rows with two or more cells that look like
    periods; its period cells right of column 0 name the series' points. Each later row
    with a label of 1 to 200 characters in column 0 gives a row per numeric cell below a
    period. ``file_country`` is the column with the workbook's country, if any.
    """
    grid = compacted(cells).withColumn("is_period", looks_like_period(F.col("raw")))
    sheet = Window.partitionBy(*SHEET)
    row = Window.partitionBy(*SHEET, "r")
    grid = grid.withColumn("__periods", F.count_if("is_period").over(row))
    grid = grid.withColumn("__header", F.min(F.when((F.col("r") < HEADER_ROWS) & (F.col("__periods") >= 2), F.col("r"))).over(sheet))
    column = Window.partitionBy(*SHEET, "c")
    at_header = (F.col("r") == F.col("__header")) & F.col("is_period") & (F.col("c") >= 1)
    grid = grid.withColumn("period", F.max(F.when(at_header, strip(F.col("raw")))).over(column))
    grid = grid.withColumn("indicator", F.max(F.when(F.col("c") == 0, strip(F.col("raw")))).over(row))
    body = grid.filter((F.col("r") > F.col("__header")) & F.col("period").isNotNull() & F.length("indicator").between(1, LABEL_CHARS))
    value = to_number(F.col("raw"))
    country = detect_country(F.col("indicator"))
    return body.withColumn("value", value).filter(F.col("value").isNotNull()).select(
        *SHEET,
        "indicator",
        (F.coalesce(country, F.col(file_country)) if file_country else country).alias("country"),
        "period",
        detect_year(F.col("period")).alias("year"),
        "value",
        F.lit(None).cast("string").alias("unit"),
        F.concat("indicator", F.lit(" | "), "period").alias("raw_label"),
        F.col("sheet").alias("source_sheet"),
        F.col("r").alias("row"),
        F.col("c").alias("col"),
    )


def markdown(cells: DataFrame, max_rows: int = MARKDOWN_ROWS) -> DataFrame:
    """(key, sheet, block): title, up to ``max_rows`` rows of ``a | b``, and how many more there are."""
    grid = compacted(cells)
    lines = grid.groupBy(*SHEET, "r").agg(F.array_sort(F.collect_list(F.struct("c", strip(scrub(F.col("raw"))).alias("t")))).alias("cells"))
    text = F.array_join(F.filter("cells.t", lambda t: t != ""), " | ")
    blocks = lines.select(*SHEET, "r", text.alias("line")).groupBy(*SHEET).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.when((F.col("r") < max_rows) & (F.col("line") != ""), F.struct("r", "line")))).alias("l"))
    more = F.when(F.col("n") > max_rows, F.concat(F.lit("\n... ("), (F.col("n") - max_rows).cast("string"), F.lit(" lignes supplementaires)"))).otherwise("")
    return blocks.select(*SHEET, F.concat(F.lit("### Feuille : "), F.col("sheet"), F.when(F.size("l") > 0, F.concat(F.lit("\n"), F.array_join("l.line", "\n"))).otherwise(""), more).alias("block"))
