"""Problem 1: statistics that tell natural prose from lists, tables and junk.

A document is cut into blocks of lines. Every block yields sums that add up: those of its closed
paragraphs, and those of the paragraphs that its first and last line leave open, with these lines.
Merging blocks in order adds the open ends (the boundary-state correction: paragraphs grow together,
and a line that repeats the one before it counts as repeated), so any tree of merges gives the same
totals as the whole document. Blocks of one document are merged in rounds of MERGED neighbours, each
of which is a shuffle of sums; ratios and rules come last.

What is furniture of a page is decided by facts of the whole page, which are gathered first where
pages have more than one block.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafline.llm import mojibake
from leafline.llm.confusables import prototypes
from leafline.session import cut

BLOCK_LINES = 512  # line numbers of a page that one task measures together
BLOCK_CHARS = 1 << 16  # characters of a chunk, likewise; a line of more is measured as if it were wrapped at the last blank before
MERGED = 16  # neighbouring blocks that one round of merging joins
NOT_PROSE = 0.65  # share of list, table and junk characters from which a text is no prose

# Sums of one paragraph, all additive over its lines.
LINES, CHARS, WORDS, WORD_CHARS, SYMBOLS, ENDED, COMMON, STOPS, MARKED, DASHED, QUOTED, CELLS, NUMBERS, RUNS, THAI, LEADERS, GLUED, REPEATED, LABELS, ROWS, INNER, SQUARES = range(22)
N = 22

# Bullets, dashes that open a turn of speech, and marks of sentence ends.
_marker = re.compile(r"\s*(?:([•·▪◦●○■□‣*])|([–—-])|(\(\w{1,3}\)|\d{1,3}[.)]|[a-zA-Z]\)))\s+(?=\S)")
_end = re.compile(r"[.!?…。！？।॥؟]['\"”’»“」』)）\]]*$")
_stop = re.compile(r"(?:[.!?…؟][\"”’»“)\]]*(?=\s|$))|[。！？।॥]")
_cell = re.compile(r"\t|\s\|\s|;\s?|,(?=\S)|\s{3,}")
_leader = re.compile(r"\.{4,}|(?:\. ){4,}|…{2,}")
_run = re.compile(r"([^\w\s]|[^\W\d_])(?:\1){5,}|(.{2,3}?)\2{4,}")
_glyph = re.compile(r"\(cid:\d+\)")
_number = re.compile(r"[-+]?[\d.,]*\d[\d.,]*%?|%|n/a|[–—-]|[A-Z]{1,2}-\d+")
_quote = re.compile(r"[“”„«»「」]")
_label = re.compile(r"[^\s:：.]{1,24}(?: [^\s:：.]{1,24}){0,2}[:：]\s")
_thai = re.compile(r"[฀-๿]")
_symbol = re.compile(r"[^\w\s.,;:!?'\"“”„«»‘’()।॥،؛؟。、，；：！？…–—「」『』（）̀-ͯऀ-ःऺ-ॏั-๎ً-ْ-]")


_tokens: dict[str, tuple[int, int, int]] = {}
TOKEN_CACHE = 100_000  # remembered tokens per process; emptied when full, results do not depend on it


def _token(w: str, common: frozenset[str]) -> tuple[int, int, int]:
    """(is common, is a number or empty cell, length if it is one long string without breaks)."""
    known = _tokens.get(w)
    if known is None:
        if len(_tokens) >= TOKEN_CACHE:
            _tokens.clear()
        known = (int(w.lower().strip(".,;:!?“”\"'()«»„") in common), int(_number.fullmatch(w) is not None), len(w) if len(w) > 20 and w.isascii() else 0)
        if len(w) <= 40:
            _tokens[w] = known
    return known


def repeats(line: str, previous: str) -> bool:
    """Whether a line repeats the one before it, or its first half."""
    n = len(line)
    return line == previous or n > 12 and len(previous) > 12 and line.startswith(previous[: n // 2 + 1])


def add_line(v: list[int], line: str, common: frozenset[str], previous: str) -> None:
    """Add one line to the sums of its paragraph; previous is the line before, for repeats that span lines."""
    n_chars = len(line)
    v[LINES] += 1
    v[CHARS] += n_chars
    v[SQUARES] += n_chars * n_chars
    if "(cid:" in line:
        v[GLUED] += sum(map(len, _glyph.findall(line)))
    marker = _marker.match(line)
    if marker:
        dash = marker.group(2)
        v[DASHED if dash else MARKED] += 1
        if dash and _quote.search(line):
            v[QUOTED] += 1
    tokens = line.split()
    n = len(tokens)
    v[WORDS] += n
    v[WORD_CHARS] += sum(map(len, tokens))
    for w in tokens:
        is_common, is_number, glued = _tokens.get(w) or _token(w, common)
        v[COMMON] += is_common
        v[NUMBERS] += is_number
        v[GLUED] += glued
    if (".." in line or ". . ." in line or "……" in line) and _leader.search(line):
        v[LEADERS] += 1
        v[ENDED] += 1 if _end.search(line) else 0
    else:
        stops = len(_stop.findall(line))
        if stops:
            ended = 1 if _end.search(line) else 0
            v[STOPS] += stops
            v[ENDED] += ended
            v[INNER] += stops - ended
    if "," in line or ";" in line or "|" in line or "\t" in line or "   " in line:
        inner = line.strip()
        cells = len(_cell.findall(inner))
        if cells >= 2 or cells == 1 and ("\t" in inner or " | " in inner or "   " in inner):
            v[CELLS] += cells
            v[ROWS] += 1
    v[SYMBOLS] += len(_symbol.findall(line))
    distinct = len(set(line))
    if n_chars > 5 and (distinct <= 6 or distinct * 8 < n_chars):
        v[RUNS] += sum(len(m.group()) for m in _run.finditer(line))
    if not line.isascii() and _thai.search(line):
        v[THAI] += n_chars
    repeated = False
    if n >= 4 and len(set(tokens)) * 3 <= n * 2:
        for lag in range(1, min(12, n // 2 + 1)):
            if sum(map(str.__eq__, tokens, tokens[lag:])) * 3 >= n:
                repeated = True
                break
    if not repeated and previous and repeats(line, previous):
        repeated = True
    if repeated:
        v[REPEATED] += n_chars
    if (":" in line or "：" in line) and _label.match(line):
        v[LABELS] += 1


# Kinds of paragraphs.
PROSE, LIST, TABLE, JUNK, NEUTRAL, SPEECH = range(6)


def paragraph_kind(v: list[int]) -> int:
    """Kind of a paragraph from its sums. SPEECH is dashes before whole sentences, as in dialogue."""
    lines, chars, words = v[LINES], max(v[CHARS], 1), max(v[WORDS], 1)
    if v[GLUED] * 2 > chars or v[RUNS] * 3 > chars or v[SYMBOLS] * 4 > chars:
        return JUNK
    if v[REPEATED] * 2 > chars and lines + words > 8:
        return JUNK
    if v[LEADERS] * 2 > lines:
        return LIST
    if lines > 1 and v[LABELS] * 5 > lines * 3:
        return LIST
    if v[NUMBERS] * 4 > words and (lines > 1 or words > 8):
        return TABLE
    if v[ROWS] * 5 > lines * 3 and v[STOPS] * 3 < lines and v[COMMON] * 4 < words * 3 and (lines > 1 or v[CELLS] > 6):
        return TABLE
    sentences = v[STOPS]
    if v[MARKED] and v[MARKED] * 4 >= lines and (lines > 1 or v[MARKED] == lines):
        return LIST
    if v[DASHED] and v[DASHED] * 4 >= lines:
        return SPEECH if sentences * 2 >= v[DASHED] else LIST
    if v[THAI] * 2 > chars:
        if lines == 1:
            return PROSE if words > 1 and not v[ROWS] or chars > 45 else NEUTRAL
        if words > lines or lines <= 3:
            return PROSE if words > lines else NEUTRAL
        return PROSE if v[SQUARES] * lines < 1.04 * chars * chars else LIST  # wrapped lines are about as long as each other
    if sentences:
        return PROSE if sentences * 4 >= lines or v[INNER] else LIST
    if lines == 1:
        if chars <= 100:
            return NEUTRAL
        return PROSE if v[COMMON] * 8 > words else LIST
    if lines <= 3 and chars > 60 * (lines - 1) and v[COMMON] * 8 > words:
        return NEUTRAL
    return PROSE if chars > 200 * lines and v[COMMON] * 8 > words else LIST if v[COMMON] * 10 > words else JUNK


# A partial result: number of closed paragraphs' sums and kinds, and the open ends.
TOTALS = ("chars_prose", "chars_list", "chars_table", "chars_junk", "chars_neutral", "chars_speech", "quoted_speech", "paragraphs")


class Partial:
    """Sums of a stretch of lines: closed paragraphs, and the open first and last one (one and the same if nothing is closed)."""

    __slots__ = ("totals", "kinds", "head", "tail", "closed", "first", "last")

    def __init__(self):
        self.first: str | None = None  # line at the front, if it belongs to an open paragraph and repeats nothing in itself
        self.last: str | None = None  # line at the back, if its paragraph is open
        self.totals = [0] * N
        self.kinds = [0] * len(TOTALS)
        self.head: list[int] | None = None  # open at the front
        self.tail: list[int] | None = None  # open at the back; None while head is still the only paragraph
        self.closed = False  # a boundary has been seen

    def close(self, v: list[int] | None) -> None:
        if v is None or not v[LINES]:
            return
        self.totals = [a + b for a, b in zip(self.totals, v)]
        kind = paragraph_kind(v)
        self.kinds[kind] += v[CHARS]
        if kind == SPEECH:
            self.kinds[6] += v[QUOTED]
        self.kinds[7] += 1

    def open(self) -> list[int]:
        """Sums of the paragraph that the next line belongs to."""
        if not self.closed:
            if self.head is None:
                self.head = [0] * N
            return self.head
        if self.tail is None:
            self.tail = [0] * N
        return self.tail

    def boundary(self) -> None:
        if self.closed:
            self.close(self.tail)
            self.tail = None
        self.closed = True

    def merge(self, other: Partial) -> Partial:
        """This stretch followed by the other."""
        out = Partial()
        if self.last and other.first and repeats(other.first, self.last):
            head = list(other.head)
            head[REPEATED] += len(other.first)
            other = other.copy(head=head)
        empty = lambda p: not p.closed and p.head is None
        out.first = other.first if empty(self) else self.first
        out.last = self.last if empty(other) else other.last
        out.totals = [a + b for a, b in zip(self.totals, other.totals)]
        out.kinds = [a + b for a, b in zip(self.kinds, other.kinds)]
        out.closed = self.closed or other.closed
        if not self.closed:
            out.head = _plus(self.head, other.head)
            out.tail = other.tail
        else:
            out.head = self.head
            middle = _plus(self.tail, other.head)
            if other.closed:
                out.close(middle)
                out.tail = other.tail
            else:
                out.tail = middle
        return out

    def copy(self, **new) -> Partial:
        out = Partial()
        for name in self.__slots__:
            setattr(out, name, new.get(name, getattr(self, name)))
        return out

    def finish(self) -> list[int]:
        done = self.copy()
        done.kinds = list(self.kinds)
        done.close(self.head)
        done.close(self.tail)
        return done.totals + done.kinds

    def dump(self) -> list:
        return [self.totals, self.kinds, self.head, self.tail, self.closed, self.first, self.last]

    @classmethod
    def load(cls, x: list) -> Partial:
        p = cls()
        for name, value in zip(("totals", "kinds", "head", "tail", "closed", "first", "last"), x):
            setattr(p, name, value)
        return p


def _plus(a: list[int] | None, b: list[int] | None) -> list[int] | None:
    if a is None or b is None:
        return b if a is None else a
    return [x + y for x, y in zip(a, b)]


def measure(lines: list[str], common: frozenset[str]) -> Partial:
    """Partial sums of lines; None and blank lines are paragraph boundaries."""
    p = Partial()
    previous = ""
    for i, line in enumerate(lines):
        if not line or line.isspace():
            p.boundary()
            previous = ""
        else:
            v = p.open()
            before = v[REPEATED]
            add_line(v, line, common, previous)
            if i == 0 and v[REPEATED] == before:
                p.first = line
            previous = line
    p.last = previous or None
    return p


class Block:
    """A stretch of the lines of one page, in clusters of lines: the first and the last one, which may go on beyond it, and the sums of those between.

    A cluster whose lines all lie at head or foot of the page is furniture. broken tells that the
    first cluster begins with the stretch.
    """

    def __init__(self, head: list, tail: list | None, totals: list[int], broken: bool):
        self.head, self.tail, self.totals, self.broken = head, tail, totals, broken  # a cluster: [Partial, has a line in the body]

    @classmethod
    def of(cls, clusters: list[list], broken: bool) -> Block:
        """From clusters [lines, has a line in the body] as Partials."""
        block = cls(clusters[0], clusters[-1] if len(clusters) > 1 else None, [0] * (N + len(TOTALS)), broken)
        for c in clusters[1:-1]:
            block._close(c)
        return block

    def _close(self, cluster: list) -> None:
        if cluster[1]:
            self.totals = [a + b for a, b in zip(self.totals, cluster[0].finish())]

    def merge(self, other: Block) -> Block:
        """This stretch followed by the other."""
        out = Block(self.head, self.tail, [a + b for a, b in zip(self.totals, other.totals)], self.broken)
        if other.broken:
            if self.tail:
                out._close(self.tail)
            if other.tail:
                out._close(other.head)
            out.tail = other.tail or other.head
            return out
        left = self.tail or self.head
        joined = [left[0].merge(other.head[0]), left[1] or other.head[1]]
        if self.tail and other.tail:
            out._close(joined)
            out.tail = other.tail
        elif self.tail:
            out.tail = joined
        else:
            out.head, out.tail = joined, other.tail
        return out

    def finish(self) -> list[int]:
        out = Block(self.head, self.tail, self.totals, self.broken)
        out._close(self.head)
        if self.tail:
            out._close(self.tail)
        return out.totals

    def dump(self) -> str:
        return json.dumps([[c and [c[0].dump(), c[1]] for c in (self.head, self.tail)], self.totals, self.broken], ensure_ascii=False)

    @classmethod
    def load(cls, x: str) -> Block:
        ends, totals, broken = json.loads(x)
        return cls(*(c and [Partial.load(c[0]), c[1]] for c in ends), totals, broken)


def verdict(x: list[int]) -> tuple[bool, float]:
    """(is no prose, share of characters that are no prose) from the finished sums."""
    prose, lists, table, junk, neutral, speech = x[N : N + 6]
    prose += speech
    other = lists + table + junk
    total = prose + other
    if not total:
        # Headings alone: one or two are a short text, more are a list.
        return x[N + 7] > 3, 0.0
    return other > NOT_PROSE * total, other / total


STATISTICS = "n_lines int, n_chars long, n_words long, mean_word_length double, symbol_ratio double, ended_lines double, common_words double, list_chars long, table_chars long, junk_chars long, prose_chars long, other_share double, not_prose boolean"


def _row(x: list[int]) -> dict:
    other, share = verdict(x)
    words, chars, lines = max(x[WORDS], 1), max(x[CHARS], 1), max(x[LINES], 1)
    return {
        "n_lines": x[LINES], "n_chars": x[CHARS], "n_words": x[WORDS], "mean_word_length": x[WORD_CHARS] / words, "symbol_ratio": x[SYMBOLS] / chars, "ended_lines": x[ENDED] / lines,
        "common_words": x[COMMON] / words, "list_chars": x[N + LIST], "table_chars": x[N + TABLE], "junk_chars": x[N + JUNK], "prose_chars": x[N + PROSE], "other_share": share, "not_prose": other,
    }


_STAT_FIELDS = [("n_lines", pa.int32()), ("n_chars", pa.int64()), ("n_words", pa.int64()), *[(c, pa.float64()) for c in ("mean_word_length", "symbol_ratio", "ended_lines", "common_words")], *[(c, pa.int64()) for c in ("list_chars", "table_chars", "junk_chars", "prose_chars")], ("other_share", pa.float64()), ("not_prose", pa.bool_())]


def common_set(common_words: DataFrame) -> frozenset[str]:
    """The frequent words of all languages; a table of more than 100000 is refused."""
    rows = common_words.select("word").where("word is not null").limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("common_words is no list of frequent words")
    return frozenset(r[0] for r in rows)


def _clean(text: str, repair) -> str:
    """The text as it was meant: wrong decoding undone, look-alikes folded, lines as they are."""
    if text.isascii():
        return text
    text = repair(text)[0]
    return text if _folds().keys().isdisjoint(set(text)) else text.translate(_folds())


@lru_cache(maxsize=1)
def _folds() -> dict[int, str]:
    return {c: p for c, p in prototypes().items() if c > 0xA0 and c not in (0x2028, 0x2029)}


def _merged(blocks: DataFrame, key: str, most: int) -> DataFrame:
    """(key, STATISTICS) of documents whose blocks (key, block, state), numbered from 0 to most, are merged in rounds of neighbours."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            merged = [reduce(Block.merge, (Block.load(p["state"]) for p in parts)).dump() if len(parts) > 1 else parts[0]["state"] for parts in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(merged, pa.string())], [key, "block", "state"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_row(Block.load(x).finish()) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[c] for r in rows], k) for c, k in _STAT_FIELDS]], [key, *[c for c, _ in _STAT_FIELDS]])

    while most > 0:
        most //= MERGED
        near = blocks.groupBy(key, F.floor(F.col("block") / MERGED).alias("block")).agg(F.array_sort(F.collect_list(F.struct("block", "state"))).alias("parts"))  # MERGED at most
        blocks = near.mapInArrow(join, f"`{key}` long, block long, state string")
    return blocks.select(key, "block", "state").mapInArrow(finish, f"`{key}` long, {STATISTICS}")


def _wrapped(text: str) -> Iterator[str]:
    """Lines of a text; one of more than BLOCK_CHARS is wrapped at the last blank before, or cut there."""
    for line in text.split("\n"):
        while len(line) > BLOCK_CHARS:
            at = line.rfind(" ", BLOCK_CHARS // 2, BLOCK_CHARS)
            at = BLOCK_CHARS if at < 0 else at
            yield line[:at]
            line = line[at:]
        yield line


def chunk_statistics(chunks: DataFrame, common: frozenset[str], shared: mojibake.SharedDecoder, id_col: str = "chunk_no", text_col: str = "text") -> DataFrame:
    """(id, STATISTICS) of every non-null text.

    A text over BLOCK_CHARS is cut at line ends into rows that are spread over the tasks, and their
    sums are merged; of repeated ids each row is measured for itself. Garbled texts are measured as
    restored. Null texts give no row, an empty text a row of zeros that is prose. A text of usual
    length is not shuffled.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repair = shared.get().repair
        for batch in batches:
            rows = [_row(measure(list(_wrapped(_clean(text, repair))), common).finish()) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[c] for r in rows], k) for c, k in _STAT_FIELDS]], [id_col, *[c for c, _ in _STAT_FIELDS]])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repair = shared.get().repair
        for batch in batches:
            states = [Block.of([[measure(list(_wrapped(_clean(text, repair))), common), True]], False).dump() for text in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(states, pa.string())], [id_col, "block", "state"])

    rows = chunks.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long"), F.col(text_col).alias("text"))
    usual = rows.where(F.length("text") <= BLOCK_CHARS).mapInArrow(whole, f"`{id_col}` long, {STATISTICS}")
    long = rows.where(F.length("text") > BLOCK_CHARS)
    most = long.agg(F.max(F.length("text"))).first()[0]
    if most is None:
        return usual
    # Starts of the parts: the line that begins after each multiple of BLOCK_CHARS.
    after = F.transform(F.sequence(F.lit(1), F.floor(F.length("text") / BLOCK_CHARS).cast("int")), lambda k: F.call_function("locate", F.lit("\n"), F.col("text"), k * BLOCK_CHARS) + 1)
    starts = F.array_distinct(F.concat(F.array(F.lit(1)), F.filter(after, lambda p: p > 1), F.array(F.length("text") + 2)))
    parts = F.transform(F.sequence(F.lit(1), F.size("starts") - 1), lambda i: F.substring(F.col("text"), F.col("starts")[i - 1], F.col("starts")[i] - F.col("starts")[i - 1] - 1))
    named = long.withColumn("row", F.monotonically_increasing_id()).withColumn("starts", starts).select(id_col, "row", F.posexplode(parts).alias("block", "text"))
    spread = cut(named.repartition("row", "block"))
    keys = spread.select("row", id_col).distinct()
    states = spread.select("row", F.col("block").cast("long").alias("block"), "text").mapInArrow(part, f"`{id_col}` long, block long, state string").withColumnRenamed(id_col, "row")
    measured = _merged(states, "row", most // BLOCK_CHARS + 1).join(keys, "row").drop("row")
    return usual.unionByName(measured.select(*usual.columns))


BANDS = (0.15, 0.075)  # where the whole page lies within the outer bands, the narrower ones count
USUAL = 1.35  # times the usual step from which a gap parts clusters


def page_facts(rows: list[dict]) -> tuple[float, float]:
    """(usual step between lines, width of the bands) of all rows of a page."""
    steps = sorted(b["top"] - a["top"] for a, b in zip(rows, rows[1:]) if a["top"] is not None and b["top"] is not None and b["top"] > a["top"])
    step = steps[(len(steps) - 1) // 2] if len(steps) >= 2 else 0.0
    return step, next((b for b in BANDS if any(not _at_edge(r, b) for r in rows)), 0.0)


def _at_edge(r: dict, band: float) -> bool:
    return r["top"] is not None and bool(r["page_height"]) and (r["top"] <= band * r["page_height"] or r["bottom"] is not None and r["bottom"] >= 0.85 * r["page_height"])


def page_block(rows: list[dict], step: float, band: float, last: float | None, common: frozenset[str]) -> Block:
    """Lines of a stretch of one page in clusters; last is the place of the last line before it, if any.

    Lines closer together than USUAL steps form a cluster. Clusters that lie wholly in the outer
    bands are furniture; with a band of 0 all are. A line without a number stands for itself.
    """
    clusters: list[list] = []
    broken = False
    for r in rows:
        gap = r["top"] - last if r["top"] is not None and last is not None else 0
        parted = step and gap > USUAL * step or gap < 0 or r["line_no"] is None
        if not clusters:
            broken = bool(parted)
        if not clusters or parted:
            clusters.append([[], False])
        clusters[-1][0].append(r["text"])
        clusters[-1][1] |= bool(band) and not _at_edge(r, band)
        last = r["top"] if r["top"] is not None else last
    return Block.of([[measure(c[0], common), c[1]] for c in clusters], broken)


LOOSE = 1024  # blocks that lines without a number are spread over


def page_statistics(lines: DataFrame, common: frozenset[str], shared: mojibake.SharedDecoder) -> DataFrame:
    """(page_id, STATISTICS) of every page that has a line with text.

    Of lines extracted again the latest is measured; furniture at head and foot is left out. Pages
    travel as blocks of BLOCK_LINES line numbers, so a page of any length is spread over tasks and
    only its sums meet. Lines without a number are paragraphs of their own. A page without readable
    lines gives no row. One shuffle of the lines, and where pages have several blocks, shuffles of
    the blocks' sums and facts.
    """
    when = F.col("extracted_at") if "extracted_at" in lines.columns else F.lit(None).cast("timestamp")
    loose = F.col("line_no").isNull()
    rows = lines.where("page_id is not null").select(
        F.col("page_id").cast("long").alias("page_id"), F.when(loose, F.pmod(F.xxhash64("line_id"), F.lit(LOOSE)) - LOOSE).otherwise(F.floor(F.col("line_no") / BLOCK_LINES)).cast("long").alias("block"),
        "line_no", when.alias("at"), F.col("line_id").cast("long").alias("line_id"), "text", F.col("top").cast("double"), F.col("bottom").cast("double"), F.col("page_height").cast("double"),
    )
    span = rows.agg(F.min("block").alias("least"), F.max("block").alias("most")).first()
    first, most = min(span["least"] or 0, 0), max(span["most"] or 0, 0)
    order = ["page_id", "block", "line_no", "at", "line_id"]
    moved = rows.repartition("page_id", "block")
    several = first < 0 or most > 0
    if several:
        newest = Window.partitionBy("page_id", "block", F.coalesce("line_no", "line_id")).orderBy(F.col("at").desc_nulls_last(), F.col("line_id").desc())
        latest = moved.withColumn("rn", F.row_number().over(newest)).where("rn = 1 and text is not null").drop("rn")
        place = Window.partitionBy("page_id", "block").orderBy("line_no", "line_id")
        stepped = latest.withColumn("step", F.when(F.col("line_no").isNotNull(), F.col("top") - F.lag("top").over(place)))
        outside = lambda band: ~F.coalesce((F.col("page_height") > 0) & ((F.col("top") <= band * F.col("page_height")) | F.coalesce(F.col("bottom") >= 0.85 * F.col("page_height"), F.lit(False))), F.lit(False))
        facts = stepped.groupBy("page_id").agg(
            F.percentile_approx(F.when(F.col("step") > 0, F.col("step")), 0.5, 10000).alias("step"), F.count_if(F.col("step") > 0).alias("n_steps"), *[F.max(outside(b)).alias(f"outside{i}") for i, b in enumerate(BANDS)]
        ).select("page_id", F.when(F.col("n_steps") >= 2, F.col("step")).otherwise(0.0).alias("step"), F.when(F.col("outside0"), BANDS[0]).when(F.col("outside1"), BANDS[1]).otherwise(0.0).alias("band"))
        ends = latest.where("line_no is not null and top is not null").groupBy("page_id", "block").agg(F.max_by("top", F.struct("line_no", "line_id")).alias("end"))
        every = latest.select("page_id", "block").distinct().join(ends, ["page_id", "block"], "left")
        before = every.withColumn("last", F.last("end", ignorenulls=True).over(Window.partitionBy("page_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))).select("page_id", "block", "last")  # one row per block
        moved = latest.join(before, ["page_id", "block"]).join(facts, "page_id")
        moved = moved.repartition("page_id", "block")
    else:
        moved = moved.withColumns({c: F.lit(None).cast("double") for c in ("last", "step", "band")})

    names = [*order, "text", "top", "bottom", "page_height", "last", "step", "band"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repair = shared.get().repair
        now: tuple | None = None
        held: list[dict] = []
        ids, blocks, states = [], [], []

        def close() -> None:
            own = [r for r in held if r["text"] is not None]
            if own:
                for r in own:
                    r["text"] = _clean(r["text"], repair)
                step, band = (own[0]["step"], own[0]["band"]) if several else page_facts(own)
                ids.append(now[0])
                blocks.append(now[1] - first)
                states.append(page_block(own, step, band, own[0]["last"], common).dump())

        for batch in batches:
            for r in batch.to_pylist():
                key = r["page_id"], r["block"]
                if key != now:
                    close()
                    now, held = key, []
                if held and r["line_no"] is not None and held[-1]["line_no"] == r["line_no"]:
                    held[-1] = r
                else:
                    held.append(r)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(blocks, pa.int64()), pa.array(states, pa.string())], ["page_id", "block", "state"])
            ids.clear(), blocks.clear(), states.clear()
        close()
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(blocks, pa.int64()), pa.array(states, pa.string())], ["page_id", "block", "state"])

    states = moved.select(*names).sortWithinPartitions(*order).mapInArrow(run, "page_id long, block long, state string")
    return _merged(states, "page_id", most - first)
