"""Text from files. Readers are optional libraries behind one function each; the decisions
about what they return are Column expressions."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.text import scrub, stem, strip
from tidewell.storage import sliced

NATIVE_CHARS = 100
#: Files that a reader holds at a time.
FILES = 16


def pdf_pages(content: bytes) -> list[str]:
    """Text of each page; empty if the file or the library is unusable."""
    try:
        import fitz

        with fitz.open(stream=content, filetype="pdf") as pdf:
            return [page.get_text() for page in pdf]
    except Exception:  # noqa: BLE001  a broken file is a result, not a failure of the job
        return []


def sheet_cells(content: bytes, name: str) -> list[tuple[str, int, int, str | None, str]]:
    """(sheet, row, col, raw, kind) of every cell of every sheet; none if unreadable."""
    try:
        engine = "xlrd" if name.lower().endswith(".xls") else "openpyxl"
        sheets = pd.read_excel(io.BytesIO(content), sheet_name=None, header=None, engine=engine)
    except Exception:  # noqa: BLE001
        return []
    return [(sheet, r, c, None if pd.isna(v) else str(v), type(v).__name__) for sheet, frame in sheets.items() for r, row in enumerate(frame.itertuples(index=False)) for c, v in enumerate(row)]


def extract_pdfs(contents: DataFrame, reader=pdf_pages) -> DataFrame:
    """(path, page_count, native_text) of each file; pages joined by line breaks."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in sliced(batches, FILES):
            pages = [reader(c) for c in batch["content"]]
            yield pd.DataFrame({"path": batch["path"], "page_count": [len(p) for p in pages], "native_text": ["\n".join(p) for p in pages]})

    out = contents.select("path", "content").mapInPandas(run, "path string, page_count int, native_text string")
    return out.withColumn("native_text", strip(scrub(F.col("native_text"))))


def extract_cells(contents: DataFrame, reader=sheet_cells) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in sliced(batches, FILES):
            rows = [(path, *cell) for path, content in zip(batch["path"], batch["content"]) for cell in reader(content, path)]
            if not rows:
                continue
            yield pd.DataFrame(rows, columns=["key", "sheet", "row_idx", "col_idx", "raw", "kind"])

    return contents.select("path", "content").mapInPandas(run, "key string, sheet string, row_idx int, col_idx int, raw string, kind string")


def recognised_pages(contents: DataFrame, pages: Callable[[bytes], list[bytes]], recognise: Callable[[bytes], str]) -> DataFrame:
    """(key, page, text): pages are taken apart, dealt over all tasks, and recognised one by one."""
    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in sliced(batches, FILES):
            rows = [(path, n, image) for path, content in zip(batch["path"], batch["content"]) for n, image in enumerate(pages(content))]
            if rows:
                yield pd.DataFrame(rows, columns=["key", "page", "image"])

    def read(images: pd.Series) -> pd.Series:
        return pd.Series([recognise(i) for i in images])

    apart = contents.select("path", "content").mapInPandas(split, "key string, page int, image binary")
    return apart.repartition("key", "page").select("key", "page", F.pandas_udf(read, "string")(F.col("image")).alias("text"))


def extracted_images(contents: DataFrame, save: Callable[[str, bytes], list[str]]) -> DataFrame:
    """(path, image_paths, n_images): ``save`` stores a file's images and returns their paths."""
    def run(paths: pd.Series, bodies: pd.Series) -> pd.Series:
        return pd.Series([save(p, b) for p, b in zip(paths, bodies)])

    out = contents.select("path", F.pandas_udf(run, "array<string>")(F.col("path"), F.col("content")).alias("image_paths"))
    return out.withColumn("n_images", F.size("image_paths"))


def joined_pages(pages: DataFrame) -> DataFrame:
    """(key, ocr_text) from one row per recognised page, in page order, blank pages skipped."""
    said = pages.filter(strip(F.col("text")) != "")
    return said.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("p")).select("key", strip(F.array_join("p.text", "\n")).alias("ocr_text"))


def image_sentence(key: Column, n: Column) -> Column:
    return F.concat(F.lit("Document image : "), F.replace(stem(key), F.lit("_"), F.lit(" ")), F.lit(" ("), n.cast("string"), F.lit(" image(s))"))


def chosen_text(key: str = "key", pages: str = "page_count", native: str = "native_text", ocr: str = "ocr_text", images: str = "n_images") -> Column:
    """struct(text, method): native if long enough, else OCR if longer, else images, else what there is."""
    n, o = (strip(F.coalesce(F.col(c), F.lit(""))) for c in (native, ocr))
    blank = (n == "") & (o == "")
    method = (
        F.when(F.coalesce(F.col(pages), F.lit(0)) == 0, "error")
        .when(F.length(n) >= NATIVE_CHARS, "native")
        .when(F.length(o) > F.length(n), "ocr")
        .when(blank & (F.coalesce(F.col(images), F.lit(0)) > 0), "image_extracted")
        .otherwise("native")
    )
    text = F.when(method == "error", "").when(method == "ocr", o).when(method == "image_extracted", image_sentence(F.col(key), F.col(images))).otherwise(n)
    return F.struct(text.alias("text"), method.alias("method"))
