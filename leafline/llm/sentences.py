"""Problem 2: sentence boundaries in several languages and scripts.

Which words are abbreviations, which words start sentences and which words follow an ordinal number
is learned without labels, per language and over the whole corpus, by log-likelihood ratios. Each
possible boundary is then classified with these statistics, the brackets and quotations around it
and what follows it.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafline.session import cut

#: Thresholds of the log-likelihood decisions.
ABBREVIATION, STARTER, COLLOCATION = 0.3, 30.0, 7.88
#: Significant entries that are broadcast; a larger model stays a table, and each text gets the entries that it asks for by a join.
MAX_MODEL = 200_000
FLUSH = 500_000  # distinct counts that a task holds before it writes them

# Marks of sentence ends, and pairs of quotation marks and brackets.
FULL_STOPS = "。！？｡"  # end a sentence without a blank after them
STOPS = ".!?…।॥؟۔" + FULL_STOPS
OPENING = {"«": "»", "“": "”", "„": "“”", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]", "【": "】", "‹": "›", "《": "》"}
CLOSING = "»”“」』)）]】›》’'\""
BULLETS = "•·▪◦●○■□‣*–—-"

_SCRIPTS = (("th", 0x0E00, 0x0E80), ("ar", 0x0600, 0x0700), ("hi", 0x0900, 0x0980), ("ja", 0x3040, 0x3100), ("ru", 0x0400, 0x0530), ("zh", 0x4E00, 0xA000))


class Languages:
    """Language of a text by its script, among languages of one script by their frequent words."""

    def __init__(self, common: list[tuple[str, str]]):
        self.common: dict[str, set[str]] = {}
        for lang, word in common:
            self.common.setdefault(lang, set()).add(word)
        own = {s for s, _, _ in _SCRIPTS}
        self.latin = {lang: words for lang, words in self.common.items() if lang not in own}

    def of(self, text: str) -> str:
        counts: Counter = Counter()
        for char, n in Counter(text).items():
            cp = ord(char)
            if cp < 0x250:
                if char.isalpha():
                    counts["latin"] += n
                continue
            for script, low, high in _SCRIPTS:
                if low <= cp < high:
                    counts[script] += n
                    break
        if not counts:
            return "und"
        if counts["ja"] * 8 > counts["zh"] and counts["ja"]:
            counts["ja"] += counts.pop("zh", 0)
        script = max(sorted(counts), key=lambda s: counts[s] if s == "latin" else 2 * counts[s])
        if script != "latin":
            return script
        words = Counter(text.lower().split())
        votes = {lang: sum(words[w] for w in common) for lang, common in self.latin.items()}
        return max(sorted(votes), key=votes.get) if votes else "und"


def languages(common_words: DataFrame) -> Languages:
    """Languages from a (lang, word) table of frequent words; a table of more than 100000 words is refused."""
    rows = common_words.select("lang", "word").where("lang is not null and word is not null").limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("common_words is no list of frequent words")
    return Languages([(r[0], r[1]) for r in rows])


# ------------------------------------------------------------------ learning

_strip = "«»“”„‟\"'’‘()[]（）【】「」『』‹›¿¡,;:—–-"
_WORD = r"([^\W\d_][^\s.,;:!?…»”“\"()\[\]،؛؟।]*)"
_after_break = re.compile(r"(?:[!?…؟।]|[^\W\d_]{5,}\.)[»”“\")\]]*\s+[«“„\"(\[¿¡–—-]*\s*" + _WORD)
_after_number = re.compile(r"(?<![.,\d])\d{1,4}\.\s+" + _WORD)
_after_dot = re.compile(r"\.\s+" + _WORD)
_KINDS = ("plain", "dotted", "starts", "follows", "lower", "after_dot")


def word_type(word: str) -> str:
    return word.lower()


def count_types(texts: list[str], language) -> Counter:
    """(lang, kind, type) counts of texts: types without and with a final period, after sure breaks, after numbers
    with a period, with a small first letter, and capitalised after any period."""
    by_lang: dict[str, list[str]] = {}
    for t in texts:
        by_lang.setdefault(language(t), []).append(t)
    counts: Counter = Counter()
    for lang, own in by_lang.items():
        text = "\n\n".join(own)
        for token, n in Counter(text.split()).items():
            token = token.strip(_strip)
            dotted = token.endswith(".") and not token.endswith("..")
            word = (token[:-1] if dotted else token.rstrip(".!?…،؛।؟。！？")).strip(_strip)
            if not word or any(map(str.isdigit, word)) or len(word) > 40:
                word = "##" if word and word[-1:].isdigit() else ""
            if word:
                counts[lang, 1 if dotted else 0, word_type(word)] += n
                if word[0].islower():
                    counts[lang, 4, word_type(word)] += n
        for word, n in Counter(_after_break.findall(text)).items():
            counts[lang, 2, word_type(word)] += n
        for word, n in Counter(_after_number.findall(text)).items():
            counts[lang, 3, word_type(word)] += n
        for word, n in Counter(_after_dot.findall(text)).items():
            if word[0].isupper():
                counts[lang, 5, word_type(word)] += n
    return counts


def _plogp(k: Column, n: Column, p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
    return k * F.log(p) + (n - k) * F.log(1 - p)


def _ratio(both: Column, first: Column, second: Column, total: Column) -> Column:
    """Log-likelihood ratio of two events occurring together more often than apart; 0 when they do not."""
    p, p1, p2 = second / total, both / first, (second - both) / F.greatest(total - first, F.lit(1.0))
    g = -2 * (_plogp(both, first, p) + _plogp(second - both, total - first, p) - _plogp(both, first, p1) - _plogp(second - both, total - first, p2))
    return F.when((first > 0) & (both / first > p), g).otherwise(0.0)


PARTS = ("abbreviation", "starter", "ordinal", "small")


class Model:
    """Significant entries per language: abbreviations, sentence starters, words that follow ordinals, and words
    whose capital after a period is no part of them, as they are usually written small."""

    def __init__(self, abbreviations: dict[str, set[str]], starters: dict[str, set[str]], ordinals: dict[str, set[str]], small: dict[str, set[str]]):
        self.abbreviations, self.starters, self.ordinals, self.small = abbreviations, starters, ordinals, small

    @classmethod
    def of(cls, entries) -> Model:
        """From (lang, type, abbreviation, starter, ordinal, small)."""
        parts: list[dict[str, set[str]]] = [{}, {}, {}, {}]
        for lang, word, *marks in entries:
            for part, mark in zip(parts, marks):
                if mark:
                    part.setdefault(lang, set()).add(word)
        return cls(*parts)


def _count(batches: Iterator[pa.RecordBatch], language) -> Iterator[pa.RecordBatch]:
    total: Counter = Counter()

    def flush() -> pa.RecordBatch:
        keys = list(total)
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.string()), pa.array(list(total.values()), pa.int64())], ["lang", "kind", "type", "n"])

    for batch in batches:
        total.update(count_types([t for t in batch.column(0).to_pylist() if t], language))
        if len(total) > FLUSH:
            yield flush()
            total.clear()
    yield flush()


def train(texts: DataFrame, langs: Languages, max_model: int = MAX_MODEL) -> Model | DataFrame:
    """Learn from all texts of a one-column table: a Model, or with more than max_model significant entries their table (lang, type, PARTS).

    The counts are made once and kept in the checkpoint folder.
    """
    pivot = [F.sum(F.when(F.col("kind") == i, F.col("n")).otherwise(0)).cast("double").alias(k) for i, k in enumerate(_KINDS)]
    counts = cut(texts.mapInArrow(lambda batches: _count(batches, langs.of), "lang string, kind int, type string, n long").groupBy("lang", "type").agg(*pivot))
    totals = {r["lang"]: r for r in counts.groupBy("lang").agg(*[F.sum(k).alias(k) for k in _KINDS]).collect()}  # as many rows as languages
    if not totals:
        return Model({}, {}, {}, {})
    rows = []
    for name in _KINDS:
        rows.append(F.create_map(*[x for lang, r in totals.items() for x in (F.lit(lang), F.lit(r[name]))])[F.col("lang")])
    plain, dotted, starts, follows, lower, after_dot = (F.col(k) for k in _KINDS)
    n = rows[0] + rows[1]
    seen = plain + dotted
    letters = F.length(F.regexp_replace("type", r"\.", ""))
    periods = F.length("type") - letters + 1
    null = _plogp(dotted, seen, rows[1] / n)
    alternative = _plogp(dotted, seen, F.lit(0.99))
    score = -2 * (null - alternative) * F.exp(-letters.cast("double")) * periods * F.pow(letters.cast("double"), -plain)
    significant = counts.where("dotted > 0 or starts > 0 or follows > 0 or after_dot > 0").select(
        "lang", "type",
        ((dotted > 0) & (letters > 0) & (F.col("type") != "##") & (score >= ABBREVIATION)).alias("abbreviation"),
        ((starts > 0) & (_ratio(starts, F.greatest(seen, starts), rows[2], n) >= STARTER)).alias("starter"),
        ((follows > 0) & (_ratio(follows, F.greatest(seen, follows), rows[3], n) >= COLLOCATION)).alias("ordinal"),
        ((after_dot >= 2) & (lower >= 5) & (lower >= 0.2 * seen)).alias("small"),
    ).where("abbreviation or starter or ordinal or small")
    marked = significant.limit(max_model + 1).collect()
    return Model.of(marked) if len(marked) <= max_model else significant


# ------------------------------------------------------------------ classifying

_paragraph = re.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+")
_stop = re.compile(f"[{re.escape(STOPS)}]+")
_token_before = re.compile(r"[\w.’'-]*$")
_bullet_line = re.compile(rf"\n[^\S\n]*(?=(?:[{re.escape(BULLETS)}]|\(\w{{1,3}}\))\s+(\S))")
_blank = re.compile(r"\s+")
_blanks = re.compile(r"\s*")
_label = re.compile(rf"[\s\d.{re.escape(BULLETS)}]*")
_next_word = re.compile(r"[^\W_][\w’-]*")
_skip_signs = re.compile(r"^[\W_]+")


REACH = 80  # characters that decide about a boundary on either side; longer tokens are no words


def _head(text: str, at: int) -> str:
    """The text from the next character that is no blank on, as far as decisions reach."""
    start = _blanks.match(text, at).end()
    return text[start : start + REACH]


def _before(text: str, at: int) -> int:
    """End of the text before a place, without the blanks there."""
    while at and text[at - 1].isspace():
        at -= 1
    return at


def _enclosures(text: str) -> list[int]:
    """For each opening mark with a partner in the paragraph, the place of the partner; as a list (start, end) flattened per position."""
    stack: list[tuple[int, str]] = []
    pairs: list[tuple[int, int]] = []
    for m in re.finditer(r"[«»“”„「」『』()（）\[\]【】‹›《》]", text):
        char = m.group()
        match = next((k for k in range(len(stack) - 1, -1, -1) if char in stack[k][1]), None)
        if match is not None and not (char in OPENING and char != "“"):
            pairs.append((stack[match][0], m.start()))
            del stack[match:]
        elif char in OPENING:
            stack.append((m.start(), OPENING[char]))
    return pairs


class Segmenter:
    """Places of sentence ends in a text under a model."""

    def __init__(self, model: Model, langs: Languages):
        self.model, self.langs = model, langs

    def asked(self, text: str | None) -> list[str]:
        """The entries that the classification of a text can look up: each word before and after a period."""
        if not text:
            return []
        words = set()
        for m in _stop.finditer(text):
            if m.group() == ".":
                words.add(word_type(_token_before.search(text[max(0, m.start() - REACH) : m.start()]).group().strip("’'-.")))
            following = _next_word.match(_skip_signs.sub("", text[m.end() : m.end() + 2 * REACH]))
            words.add(word_type(following.group()) if following else "")
        return list(words - {""})

    def ends(self, text: str | None, lang: str | None = None) -> list[int]:
        """Ends of the sentences of a text, as numbers of code points; a null, empty or blank text has none."""
        if not text or text.isspace():
            return []
        lang = lang or self.langs.of(text)
        out: list[int] = []
        at = 0
        for m in [*_paragraph.finditer(text), None]:
            end = m.start() if m else len(text)
            self._paragraph(text[at:end], at, lang, out)
            at = m.end() if m else end
        return out

    def _paragraph(self, text: str, offset: int, lang: str, out: list[int]) -> None:
        pairs = _enclosures(text)
        depth = [0] * (len(text) + 1)
        if pairs:
            for a, b in pairs:
                depth[a] += 1
                depth[b] -= 1
            level = 0
            for i, d in enumerate(depth):
                level += d
                depth[i] = level
        ends: set[int] = set()
        starts = 0
        candidates: list[tuple[int, int]] = [(m.start(), m.end()) for m in _stop.finditer(text)]
        for m in _bullet_line.finditer(text):
            if not m.group(1).islower():
                candidates.append((m.start(), -1))
        if lang == "th":
            candidates += [(m.start(), -2) for m in _blank.finditer(text)]
        quotes = {b: a for a, b in pairs if text[a] not in "(（[【"}
        for b in quotes:
            k = _before(text, b)
            if k and text[k - 1] in STOPS:
                candidates.append((b, -3))
        for place, end in sorted(candidates):
            if place < starts:
                continue
            if end == -1:
                stop = place if depth[place] == 0 else None
            elif end == -2:
                stop = place if depth[place] == 0 and self._thai(text, starts, place) else None
            elif end == -3:
                stop = self._after_quotation(text, starts, quotes[place], place, depth, lang)
            else:
                stop = self._after_stop(text, place, end, depth, lang)
            if stop is not None:
                ends.add(stop)
                starts = stop
        ends.add(_before(text, len(text)))
        previous = 0
        for e in sorted(ends):
            last = _before(text, e)
            if last > previous and not text[previous:last].isspace():
                out.append(offset + last)
                previous = e

    @staticmethod
    def _thai(text: str, starts: int, place: int) -> bool:
        before, after = text[starts:place], _head(text, place)
        return not _label.fullmatch(before) and bool(after) and after[0] not in "ๆฯ)”»,.%" and before[-1] not in "(“«," and not (before[-1].isascii() and after[0].isascii() and after[0].isdigit())

    def _after_quotation(self, text: str, starts: int, opened: int, closed: int, depth: list[int], lang: str) -> int | None:
        """A quotation that ends with the end of a sentence: does the sentence around it go on?"""
        if depth[closed] > 0:
            return None
        end = closed + 1
        while end < len(text) and text[end] in CLOSING and text[end] != "“":
            end += 1
        rest = _head(text, end)
        if not rest:
            return end
        head = rest[0]
        if head in STOPS or head in ",;:،؛、，；：—–-" or unicodedata.category(head) == "Ll":
            return None
        if lang in ("ja",) and 0x3040 <= ord(head) < 0x30A0:
            return None
        cased = unicodedata.category(head) == "Lu" or head in "«“„¿¡「" or head.isdigit()
        caseless = unicodedata.category(head) == "Lo"
        if caseless or not cased:
            lead = text[starts:opened].strip().strip(BULLETS).strip()
            return end if lead else None
        lead = text[starts:opened].strip().strip(BULLETS).strip()
        if head in "“「«" and lang in ("zh", "ja", "ar", "hi") and not lead:
            return end
        return end

    def _after_stop(self, text: str, place: int, end: int, depth: list[int], lang: str) -> int | None:
        mark = text[place:end]
        if depth[place] > 0:
            return None
        while end < len(text) and text[end] in CLOSING and not (text[end] in "“" and lang != "de"):
            end += 1
        if end < len(text) and not text[end].isspace():
            if mark[-1] in FULL_STOPS:
                return end
            return end if mark[-1] in "।॥؟" else None
        rest = _head(text, end).lstrip("«“„\"'‘(（[¿¡「『").lstrip()
        bullet = rest[:1] and rest[0] in BULLETS
        rest = rest.lstrip(BULLETS).lstrip() if bullet else rest
        if not rest:
            return end
        head = rest[0]
        if mark[-1] in FULL_STOPS or mark[-1] in "।॥؟":
            return end
        if unicodedata.category(head) == "Ll" and not (bullet and "\n" in text[end : end + 3]):
            return None
        if head in ",;:،؛":
            return None
        if mark != ".":
            return end
        token = _token_before.search(text[max(0, place - REACH) : place]).group().strip("’'-.")
        if not token:
            return end
        following = _next_word.match(rest)
        follow = word_type(following.group()) if following else ""
        starter = follow in self.model.starters.get(lang, ()) or head.isupper() and follow in self.model.small.get(lang, ())
        base = word_type(token)
        if token[-1].isdigit():
            if token.isdigit() and len(token) <= 4 and follow in self.model.ordinals.get(lang, ()) and not starter:
                return None
            return end
        marks = [c for c in token if unicodedata.category(c)[0] != "M"]
        known = base in self.model.abbreviations.get(lang, ())
        if len(marks) == 1 and marks[0].isalpha() and not (head.isdigit() and not known):
            return end if starter and known and unicodedata.category(marks[0]) != "Lu" else None
        if known or len(marks) == 1:
            return end if starter and not head.isdigit() else None
        if lang == "hi" and "\n" not in text[end : end + 2]:
            return None  # this script has its own full stop
        return end


# ------------------------------------------------------------------ operators


class Segmentation:
    """How to segment tables: by one shared model, or by a table of entries, of which every text gets those that it asks for."""

    def __init__(self, model: Model | DataFrame, langs: Languages):
        self.langs, self.table = langs, None if isinstance(model, Model) else model
        self.segmenter = Segmenter(model, langs) if isinstance(model, Model) else None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"table": None}  # executors get the entries with the rows

    def prepared(self, df: DataFrame, text_col: str = "text") -> DataFrame:
        """df with a column of the entries for its texts; null where the model is shared. With a table each distinct text asks once, and the entries of a text meet by its hash."""
        entry = "array<struct<lang:string,type:string,abbreviation:boolean,starter:boolean,ordinal:boolean,small:boolean>>"
        if self.table is None:
            return df.withColumn("entries", F.lit(None).cast(entry))
        empty, langs = Segmenter(Model({}, {}, {}, {}), self.langs), self.langs

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(h, langs.of(t), w) for h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for w in empty.asked(t)]
                columns = list(zip(*rows)) or [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())], ["text_hash", "lang", "type"])

        hashed = df.withColumn("text_hash", F.xxhash64(text_col))
        asked = hashed.select("text_hash", text_col).where(F.col(text_col).isNotNull()).distinct().mapInArrow(run, "text_hash long, lang string, type string")
        found = asked.join(self.table, ["lang", "type"]).groupBy("text_hash").agg(F.collect_list(F.struct("lang", "type", *PARTS)).cast(entry).alias("entries"))
        return hashed.join(found, "text_hash", "left").withColumn("entries", F.coalesce("entries", F.array().cast(entry))).drop("text_hash")

    def of(self, entries: list | None) -> Segmenter:
        """The segmenter of a row."""
        return self.segmenter if entries is None else Segmenter(Model.of(tuple(e.values()) for e in entries), self.langs)


def segmentation(texts: DataFrame, langs: Languages, max_model: int = MAX_MODEL) -> Segmentation:
    return Segmentation(train(texts, langs, max_model), langs)


def sentence_ends(df: DataFrame, how: Segmentation, id_col: str = "chunk_no", text_col: str = "text") -> DataFrame:
    """(id, end_pos): one row per sentence.

    Null, empty and blank texts have no row; repeated rows give their sentences each; a text is
    always read whole and its quotations and brackets are matched within paragraphs only, so a
    missing partner never swallows more. No shuffle besides the model's counts, unless the model is a table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ends = [], []
            for i, t, entries in zip(*(batch.column(k).to_pylist() for k in range(3))):
                found = how.of(entries).ends(t)
                ids += [i] * len(found)
                ends += found
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ends, pa.int32())], [id_col, "end_pos"])

    return how.prepared(df.select(F.col(id_col).cast("long"), F.col(text_col)), text_col).mapInArrow(run, f"`{id_col}` long, end_pos int")


def sentences(df: DataFrame, how: Segmentation, id_col: str = "chunk_no", text_col: str = "text") -> DataFrame:
    """(id, sentence_no, start_pos, end_pos, sentence): the sentence units of every text, with their place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, t, entries in zip(*(batch.column(k).to_pylist() for k in range(3))):
                at = 0
                for k, e in enumerate(how.of(entries).ends(t)):
                    start = e - len(t[at:e].lstrip())
                    rows.append((i, k, start, e, t[start:e]))
                    at = e
            columns = list(zip(*rows)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [id_col, "sentence_no", "start_pos", "end_pos", "sentence"])

    return how.prepared(df.select(F.col(id_col).cast("long"), F.col(text_col)), text_col).mapInArrow(run, f"`{id_col}` long, sentence_no int, start_pos int, end_pos int, sentence string")
