"""PDF files to lines and pages. The extraction library is optional and can be replaced."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafline.providers import LineExtractor

GAP_RATIO = 0.15  # gaps wider than this share of the letter size part words
_LINE = pa.struct([("text", pa.string()), ("top", pa.float64()), ("bottom", pa.float64())])
PAGE = "path string, page_index int, page_number int, width double, height double, lines array<struct<text:string,top:double,bottom:double>>, extraction_error string"


class PdfPlumberExtractor:
    """Lines of text-layer pages; a page that fails keeps its place, without lines and with the error."""

    def pages(self, content: bytes) -> list[dict[str, Any]]:
        import io

        import pdfplumber  # optional

        out = []
        with pdfplumber.open(io.BytesIO(content)) as pdf:
            for page in pdf.pages:
                lines, error = [], None
                try:
                    lines = [{"text": x["text"], "top": float(x["top"]), "bottom": float(x["bottom"])} for x in page.extract_text_lines(x_tolerance_ratio=GAP_RATIO, return_chars=False)]
                except Exception as e:  # noqa: BLE001 - one bad page must not lose the file
                    error = f"{type(e).__name__}: {e}"
                out.append({"width": float(page.width), "height": float(page.height), "lines": lines, "extraction_error": error})
        return out


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, file_name, size_bytes, sha256, content) of the PDF files under a folder; the suffix counts in any case."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[pP][dD][fF]").load(folder)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), "content")


def extract(files: DataFrame, extractor: LineExtractor | None = None) -> DataFrame:
    """Pages (columns: PAGE) of files (path, content). A file that cannot be opened gives one page with the error."""
    reader = extractor or PdfPlumberExtractor()
    schema = pa.schema([("path", pa.string()), ("page_index", pa.int32()), ("page_number", pa.int32()), ("width", pa.float64()), ("height", pa.float64()), ("lines", pa.list_(_LINE)), ("extraction_error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    pages = reader.pages(content)
                except Exception as e:  # noqa: BLE001
                    pages = [{"width": None, "height": None, "lines": [], "extraction_error": f"{type(e).__name__}: {e}"}]
                yield pa.RecordBatch.from_pylist([{"path": path, "page_index": i, "page_number": i + 1} | p for i, p in enumerate(pages)], schema=schema)

    return files.select("path", "content").mapInArrow(run, PAGE)


def to_tables(extracted: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines, pages) in the form that page cleaning reads; ids are hashes of the digest and the place."""
    rows = extracted.join(files.select("path", "sha256"), "path").withColumns({"file_id": F.xxhash64("sha256"), "page_id": F.xxhash64("sha256", "page_index")})
    pages = rows.select("page_id", "file_id", "page_index", "page_number", "width", "height", "extraction_error", F.current_timestamp().alias("parsed_at"))
    exploded = rows.select("page_id", "file_id", "page_number", F.col("height").alias("page_height"), F.posexplode("lines").alias("line_no", "l"))
    return exploded.select(F.xxhash64("page_id", "line_no").alias("line_id"), "page_id", "file_id", "page_number", "line_no", "l.text", "l.top", "l.bottom", "page_height", F.current_timestamp().alias("extracted_at")), pages
