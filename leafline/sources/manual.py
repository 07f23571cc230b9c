"""A synthetic manual with known answers, for trying the whole way from pages to answers."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession

# What the sections of the manual are about.
SERVICES = "orders routes drivers receipts stock addresses coupons risk billing reports".split()
HEADER, TOP, STEP = "Handbook of the Larch depot", 120.0, 16.0


def sections(count: int = 36) -> list[dict[str, Any]]:
    """Sections, one to a page: title, lines, and a question with the value that its answer must hold. Every third has a table of numbers."""
    out = []
    for i in range(count):
        service = f"{SERVICES[i % len(SERVICES)]}{'' if i < len(SERVICES) else f' {i // len(SERVICES) + 1}'}"
        port, days = 8100 + i, 7 + 3 * i
        text = [f"The {service} service listens on port {port} and runs {2 + i % 5} copies.", f"Its calls end after {i % 7 + 1} seconds; above {i % 4 + 1} per cent of errors it raises an alert.", f"Its logs are kept for {days} days."]
        table = [f"{a} {a * 5} {4 - a}" for a in (1, 2, 3)] if i % 3 == 0 else []
        out.append({"page": i + 1, "title": f"{i + 1}. The {service} service", "lines": text + table, "query": f"For how many days are the logs of the {service} service kept?", "expected": f"{days} days"})
    return out


def html(count: int = 36) -> str:
    """The manual as one page of HTML per section, to be printed to PDF."""
    pages = "".join(f"<section><header>{HEADER}</header><h1>{s['title']}</h1>{''.join(f'<p>{x}</p>' for x in s['lines'])}<footer>Page {s['page']}</footer></section>" for s in sections(count))
    return f"<!doctype html><meta charset=utf-8><style>section{{break-after:page}}</style>{pages}"


def tables(spark: SparkSession, count: int = 36) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lines, pages, cases) of the manual in the form that page cleaning and evaluation read; cases have the page of their answer."""
    lines, pages, cases = [], [], []
    for s in sections(count):
        p = s["page"]
        placed = [(HEADER, 20.0), (s["title"], TOP), *((x, TOP + STEP * (2 + k)) for k, x in enumerate(s["lines"])), (f"Page {p}", 780.0)]
        lines += [(p * 100 + k, p, 1, p, k, text, top, top + 11.0, 800.0) for k, (text, top) in enumerate(placed)]
        pages.append((p, 1, p - 1, p, 600.0, 800.0, None))
        cases.append((f"manual-{p}", s["query"], [p], s["expected"], []))
    made = spark.sql("select timestamp'2024-01-01 00:00:00' as extracted_at")
    line = spark.createDataFrame(lines, "line_id long, page_id long, file_id long, page_number int, line_no int, text string, top double, bottom double, page_height double").crossJoin(made)  # one row
    page = spark.createDataFrame(pages, "page_id long, file_id long, page_index int, page_number int, width double, height double, extraction_error string").crossJoin(made.withColumnRenamed("extracted_at", "parsed_at"))  # one row
    return line, page, spark.createDataFrame(cases, "id string, query string, verified_pages array<int>, expected_in_answer string, not_in_document array<string>")
