"""Problem 5: items over a size limit, cut at natural boundaries.

Lexical cohesion decides where: the similarity of the blocks of sentences before and after every
sentence gap is computed by sliding, its valleys mark topic boundaries, and each cut takes the
deepest valley of the window that the limit leaves. Pieces then repeat the end of the piece before.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafline.llm.sentences import Model, Segmentation, Segmenter

LIMIT, OVERLAP = 1100, 120
BLOCK = 4  # sentences on either side of a gap
LEAST_FILL = 0.4  # a cut lies in the last 60 % of what the limit allows
PARAGRAPH_BONUS = 0.5

# The ideographs that count twice.
IDEOGRAPHS = "\\u3400-\\u9fff\\uf900-\\ufaff"
_ideograph = re.compile(f"[{IDEOGRAPHS}]")
_word = re.compile(r"[^\W_]+")
_blanks = re.compile(r"\s+")
_line = re.compile(r"\s*\n\s*")
_clause = re.compile(r"[,;:،؛、，；：]\s*|\s[–—-]\s+")


def text_size(column: Column) -> Column:
    """Code points plus ideographs; null for a null text."""
    return F.length(column) + F.regexp_count(column, F.lit("[\\x{3400}-\\x{9fff}\\x{f900}-\\x{faff}]"))


def size(text: str) -> int:
    return len(text) + len(_ideograph.findall(text))


def _terms(sentence: str) -> Counter:
    """Words of a sentence; pairs of characters where words run together."""
    terms: Counter = Counter()
    for w in _word.findall(sentence.lower()):
        if len(w) > 12 and ord(w[0]) > 0xE00 or ord(w[0]) > 0x2E80:
            terms.update(w[i : i + 2] for i in range(len(w) - 1))
        else:
            terms[w] += 1
    return terms


def _cosine(a: Counter, b: Counter) -> float:
    if len(a) > len(b):
        a, b = b, a
    dot = sum(n * b[t] for t, n in a.items() if t in b)
    return dot / math.sqrt(sum(n * n for n in a.values()) * sum(n * n for n in b.values())) if dot else 0.0


def valley_depths(sentences: list[str], block: int = BLOCK) -> list[float]:
    """Depth of the similarity valley at each gap between sentences (one value fewer than sentences)."""
    terms = [_terms(s) for s in sentences]
    n = len(terms) - 1
    before: Counter = Counter()
    after: Counter = Counter()
    for t in terms[1 : block + 1]:
        after.update(t)
    similarity = []
    for gap in range(n):
        before.update(terms[gap])
        if gap >= block:
            before.subtract(terms[gap - block])
            before += Counter()
        similarity.append(_cosine(before, after))
        after.subtract(terms[gap + 1])
        after += Counter()
        if gap + block + 1 < len(terms):
            after.update(terms[gap + block + 1])
    # The height on either side is that of the slope which rises from the gap.
    left, right = similarity[:], similarity[:]
    for i in range(1, n):
        if similarity[i - 1] >= similarity[i]:
            left[i] = left[i - 1]
    for i in range(n - 2, -1, -1):
        if similarity[i + 1] >= similarity[i]:
            right[i] = right[i + 1]
    return [a - s + b - s for a, s, b in zip(left, similarity, right)]


def _whole(text: str, at: int) -> int:
    """Move a cut back so that no mark or joiner is parted from its letter."""
    low = max(0, at - 32)
    while at > low and at < len(text) and (unicodedata.category(text[at])[0] == "M" or text[at] == "‍" or text[at - 1] == "‍"):
        at -= 1
    return at


class Splitter:
    """Cuts one text at a time."""

    def __init__(self, segmenter: Segmenter, limit: int = LIMIT, overlap: int = OVERLAP):
        if limit <= 2 or overlap < 0 or overlap * 4 > limit:
            raise ValueError("the limit must leave room for the overlap: 4 * overlap <= limit")
        self.segmenter, self.limit, self.overlap = segmenter, limit, overlap

    def cuts(self, text: str) -> list[tuple[int, int, int]]:
        """(start with overlap, start, end) of each piece; contents [start:end] are the text without a gap."""
        total = [0]
        for char in text:
            total.append(total[-1] + (2 if "㐀" <= char <= "鿿" or "豈" <= char <= "﫿" else 1))
        if total[-1] <= self.limit:
            return [(0, 0, len(text))]
        ends = self.segmenter.ends(text)
        gaps, depths = [], []
        if len(ends) > 1:
            starts = [0, *ends[:-1]]
            depths = valley_depths([text[a:b] for a, b in zip(starts, ends)])
            for k, e in enumerate(ends[:-1]):
                m = _blanks.match(text, e)
                gap = m.end() if m else e
                gaps.append(gap)
                if m and m.group().count("\n") > 1:
                    depths[k] += PARAGRAPH_BONUS
        lines = [m.end() for m in _line.finditer(text)]
        clauses = sorted({m.end() for m in _clause.finditer(text)})
        blanks = sorted({m.end() for m in _blanks.finditer(text)})
        out = []
        begin = start = 0
        while total[-1] - total[begin] > self.limit:
            high = bisect_right(total, total[begin] + self.limit) - 1
            low = start + max(1, int((high - start) * LEAST_FILL))
            a, b = bisect_left(gaps, low), bisect_right(gaps, high)
            if a < b:
                cut = gaps[max(range(a, b), key=lambda k: (depths[k], k))]
            else:
                cut = 0
                for places in (lines, clauses, blanks):
                    k = bisect_right(places, high) - 1
                    if k >= 0 and places[k] >= low:
                        cut = places[k]
                        break
                cut = cut or _whole(text, high)
            if cut <= start:
                cut = max(start + 1, high)
            out.append((begin, start, cut))
            begin, start = self._overlap(text, start, cut, (gaps, lines, blanks)), cut
        out.append((begin, start, len(text)))
        return out

    def _overlap(self, text: str, start: int, cut: int, natural: tuple[list[int], ...]) -> int:
        """Where the repeated end begins: at a sentence, line or word within reach, or at the full reach."""
        if not self.overlap:
            return cut
        reach = max(start, cut - self.overlap)
        if reach == start:
            return cut if start == 0 and cut - start > self.overlap else start
        for places in natural:
            k = bisect_left(places, reach)
            if k < len(places) and places[k] < cut:
                return places[k]
        return _whole(text, reach)


def page_range(pages: list[int]) -> str:
    """Runs of pages, as in 1-3,5."""
    runs: list[list[int]] = []
    for p in sorted(set(pages)):
        if runs and p == runs[-1][1] + 1:
            runs[-1][1] = p
        else:
            runs.append([p, p])
    return ",".join(str(a) if a == b else f"{a}-{b}" for a, b in runs)


def segments_of(segments: list[dict] | None, text: str, begin: int, end: int, page: int | None) -> list[dict]:
    """The parts of the page segments that lie in text[begin:end]."""
    segments = segments or []
    places, at = [], 0
    for s in segments:
        part = (s or {}).get("text") or ""
        places.append((at, at + len(part), (s or {}).get("page")))
        at += len(part) + 2
    if not places or at - 2 != len(text):
        return [{"page": page, "text": text[begin:end].strip()}]
    out = []
    for a, b, p in places:
        part = text[max(a, begin) : min(b, end)].strip() if a < end and b > begin else ""
        if part:
            out.append({"page": p, "text": part})
    return out


PIECE = "chunk_no long, piece_no int, start_pos int, end_pos int, text string, size int, overlap_from_previous string, page_segments array<struct<page:int,text:string>>, source_pages array<int>, page_range string, start_page int, end_page int"


def split_oversized(chunks: DataFrame, how: Segmentation, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of every chunk over the limit, in order (columns: PIECE).

    A piece's text is its overlap and its content; its size, overlap included, never exceeds the
    limit. [start_pos:end_pos) is the content, and the contents of all pieces are the chunk's text.
    The first piece keeps the chunk's own overlap. Null texts and chunks within the limit give no
    row; chunks written twice give their pieces twice; segments that do not join to the text are
    replaced by one segment on the start page (which may be null). No shuffle, unless the model is a table.
    """
    Splitter(Segmenter(Model({}, {}, {}, {}), how.langs), limit, overlap)  # refuses limits that leave no room
    schema = pa.schema([
        ("chunk_no", pa.int64()), ("piece_no", pa.int32()), ("start_pos", pa.int32()), ("end_pos", pa.int32()), ("text", pa.string()), ("size", pa.int32()), ("overlap_from_previous", pa.string()),
        ("page_segments", pa.list_(pa.struct([("page", pa.int32()), ("text", pa.string())]))), ("source_pages", pa.list_(pa.int32())), ("page_range", pa.string()), ("start_page", pa.int32()), ("end_page", pa.int32()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                text = r["text"]
                splitter = Splitter(how.of(r["entries"]), limit, overlap)
                for k, (begin, start, end) in enumerate(splitter.cuts(text)):
                    piece = text[begin:end].strip()
                    segments = segments_of(r["page_segments"], text, begin, end, r["start_page"])
                    pages = sorted({s["page"] for s in segments if s["page"] is not None})
                    rows.append({
                        "chunk_no": r["chunk_no"], "piece_no": k, "start_pos": start, "end_pos": end, "text": piece, "size": size(piece),
                        "overlap_from_previous": text[begin:start].strip() if k else r["overlap_from_previous"], "page_segments": segments,
                        "source_pages": pages, "page_range": page_range(pages), "start_page": pages[0] if pages else None, "end_page": pages[-1] if pages else None,
                    })
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    over = chunks.where(text_size(F.col("text")) > limit).select(F.col("chunk_no").cast("long"), "text", "page_segments", "overlap_from_previous", "start_page")
    return how.prepared(over).mapInArrow(run, PIECE)
