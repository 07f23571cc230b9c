"""Page cleaning: from extracted lines to page texts, without furniture and noise, with paragraph gaps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafline.functions import text as T
from leafline.session import cut


def latest_lines(lines: DataFrame) -> DataFrame:
    """One row per (page_id, line_no): the line extracted last; glyphs mapped, placeholders removed, blank lines dropped.

    Null texts are dropped like blank ones; null geometry stays null. One shuffle on page_id, which
    the page windows below reuse.
    """
    alone = F.when(F.col("line_no").isNull(), F.col("line_id"))  # lines without a number are no copies of each other
    order = Window.partitionBy("page_id", "line_no", alone).orderBy(F.col("extracted_at").desc_nulls_last(), F.col("line_id").desc())
    rows = lines.select("line_id", "page_id", "file_id", "line_no", "text", "top", "bottom", "page_height", "extracted_at").repartition("page_id").withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn", "extracted_at")
    rows = rows.withColumns({"glyphs": F.regexp_count("text", F.lit(T.UNMAPPED_GLYPH)), "text": T.translate_glyphs(T.strip_unmapped_glyphs(F.col("text")))})
    return rows.where(T.strip(F.col("text")) != "")


def latest_pages(pages: DataFrame) -> DataFrame:
    """One row per page_id: the page parsed last."""
    order = Window.partitionBy("page_id").orderBy(F.col("parsed_at").desc_nulls_last())
    return pages.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


def body_heights(lines: DataFrame) -> DataFrame:
    """(file_id, body_height): median line height of each document before any removal; 0 where no height is known."""
    return lines.groupBy("file_id").agg(F.coalesce(F.median(F.col("bottom") - F.col("top")), F.lit(0.0)).alias("body_height"))


def repeated_keys(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """(file_id, key, n_pages) of the lines that stand in the bands of at least half of a document's pages, and of three."""
    in_band = lines.where(T.in_band()).select("file_id", "page_id", T.repeated_key(F.col("text")).alias("key")).distinct()
    counts = in_band.groupBy("file_id", "key").agg(F.count("page_id").alias("n_pages"))
    total = pages.groupBy("file_id").agg(F.count("page_id").alias("file_pages"))
    return counts.join(total, "file_id").where(F.col("n_pages") >= F.greatest(F.lit(T.MIN_PAGES), F.ceil(F.col("file_pages") * T.MIN_SHARE))).select("file_id", "key", "n_pages")


def _joined(lines: Column) -> Column:
    """Text of the lines (sorted structs with top and text), a blank line where the step is over 1.5 times their usual step.

    The usual step is the median of the positive steps and needs two of them; a null step breaks
    nothing.
    """
    before = lambda i: F.get(lines, i - 1)["top"]
    steps = F.array_sort(F.filter(F.transform(lines, lambda x, i: x["top"] - before(i)), lambda d: d > 0))
    middle = lambda s: (F.get(s, F.floor((F.size(s) - 1) / 2).cast("int")) + F.get(s, F.floor(F.size(s) / 2).cast("int"))) / 2
    limit = _once(steps, lambda s: F.when(F.size(s) >= 2, middle(s) * T.GAP_RATIO))
    separator = lambda x, i, most: F.when(i == 0, "").when(x["top"] - before(i) > most, "\n\n").otherwise("\n")
    return _once(limit, lambda most: F.array_join(F.transform(lines, lambda x, i: F.concat(separator(x, i, most), x["text"])), ""))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, also where it is used within a function of array elements."""
    return F.get(F.transform(F.array(value), use), 0)


def _in_order(*columns: str) -> Column:
    """The lines of a page as one array, by their numbers; a page text is one value, so its lines meet in one row."""
    return F.array_sort(F.collect_list(F.struct("line_no", "line_id", *columns)))


def page_texts(lines: DataFrame) -> DataFrame:
    """(page_id, text): lines joined in order, a blank line where the step is over 1.5 times the page's usual step."""
    return lines.groupBy("page_id").agg(_in_order("top", "text").alias("lines")).select("page_id", _joined(F.col("lines")).alias("text"))


def mark_lines(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """Lines with is_repeated and is_low_information, in the order in which removal applies them."""
    keys = repeated_keys(lines, pages).select("file_id", "key", F.lit(True).alias("repeats"))
    rows = lines.withColumn("key", T.repeated_key(F.col("text"))).join(keys, ["file_id", "key"], "left").join(body_heights(lines), "file_id", "left")
    repeated = T.in_band() & F.coalesce("repeats", F.lit(False))
    low = ~repeated & ~T.has_content(F.col("text"), F.col("bottom") - F.col("top"), F.col("body_height"))
    return rows.withColumns({"is_repeated": repeated, "is_low_information": low}).drop("repeats")


def _both_texts(marked: DataFrame) -> DataFrame:
    """(page_id, raw_text, text, counters): the texts of all lines and of the kept lines, in one pass over each page."""
    rows = marked.withColumn("kept", ~F.col("is_repeated") & ~F.col("is_low_information"))
    pages = rows.groupBy("page_id").agg(
        _in_order("top", "text", "kept").alias("lines"), F.count_if("is_repeated").alias("repeated_lines_removed"), F.count_if("is_low_information").alias("low_information_lines_removed"), F.sum("glyphs").alias("unmapped_glyphs_removed")
    )
    pages = pages.withColumn("own", F.filter("lines", lambda x: x["kept"]))
    return pages.select("page_id", _joined(F.col("lines")).alias("raw_text"), _joined(F.col("own")).alias("text"), "repeated_lines_removed", "low_information_lines_removed", "unmapped_glyphs_removed")


def clean_pages(lines: DataFrame, pages: DataFrame, min_text_chars: int = T.MIN_TEXT_CHARS) -> DataFrame:
    """One record per page: text, counts, has_text, needs_ocr, removal counters, extraction error; pages without lines stay, empty.

    The mapped lines are written to the checkpoint folder once; the document's statistics and the
    page texts read them from there.
    """
    rows = cut(latest_lines(lines))
    known = latest_pages(pages).select("page_id", "file_id", "page_index", "page_number", "width", "height", "extraction_error")
    texts = _both_texts(mark_lines(rows, known)).select("page_id", (F.length(T.normalize_text(F.col("raw_text"))) < min_text_chars).alias("needs_ocr"), T.normalize_text(F.col("text")).alias("text"), "repeated_lines_removed", "low_information_lines_removed", "unmapped_glyphs_removed")
    out = known.join(texts, "page_id", "left").withColumn("text", F.coalesce("text", F.lit("")))
    text = F.col("text")
    return out.select(
        "page_id", "file_id", "page_index", "page_number", F.round("width", 2).alias("width"), F.round("height", 2).alias("height"), F.length(text).alias("char_count"), T.count_words(text).alias("word_count"), (text != "").alias("has_text"),
        F.coalesce("needs_ocr", F.lit(True)).alias("needs_ocr"), text, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("repeated_lines_removed", "low_information_lines_removed", "unmapped_glyphs_removed")], "extraction_error",
    )


def repeated_report(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """(file_id, repeated_lines): for each repeated key the text seen first, in order of the texts."""
    numbers = pages.select("page_id", "page_number")
    first = mark_lines(lines, pages).where("is_repeated").join(numbers, "page_id").groupBy("file_id", "key").agg(F.min_by(T.normalize_text(F.col("text")), F.struct("page_number", "page_id", "line_no")).alias("text"))
    return first.groupBy("file_id").agg(F.array_sort(F.collect_list("text")).alias("repeated_lines"))


def documents(cleaned: DataFrame) -> DataFrame:
    """(file_id, page_count, text_pages, ocr_pages, warnings, removal sums): the roll-up of each document."""
    return cleaned.groupBy("file_id").agg(
        F.count("*").alias("page_count"), F.count_if("has_text").alias("text_pages"), F.count_if("needs_ocr").alias("ocr_pages"), F.count("extraction_error").alias("warnings"),
        *[F.sum(c).alias(c) for c in ("repeated_lines_removed", "low_information_lines_removed", "unmapped_glyphs_removed")],
    )
