"""Text expressions. Character classes are written out, so that Spark (Java) and DuckDB (RE2) read them alike."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The blanks that Python's str.isspace knows, ideographs of the chunker, Han characters of the tokenizer, and CJK text.
BLANK = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
IDEOGRAPH = r"[\x{3400}-\x{9fff}\x{f900}-\x{faff}]"
HAN = r"[\x{4e00}-\x{9fff}]"
LATIN_WORD = r"[A-Za-z0-9]+(?:[-'][A-Za-z0-9]+)?"
LETTER = r"[\p{L}\p{Nl}\p{No}]"
CONTENT = rf"{LETTER}{{2,}}|\p{{Nd}}{{2,}}|{HAN}"
# What closes a sentence, in CJK text with the marks that follow it, in other text before a blank; and what closes a clause.
CJK_STOP, STOP = "[。！？；][”’」』）)]*", "[.!?;]"
CJK_CLAUSE, CLAUSE = "[，、：]", "[,:]"
NUMERIC_ROW = rf"^\p{{Nd}}+(?:{BLANK}+\p{{Nd}}+)+$"
UNMAPPED_GLYPH = r"\(cid:\p{Nd}+\)"
BAND, MIN_PAGES, MIN_SHARE, BODY_RATIO, GAP_RATIO, MIN_TEXT_CHARS = 0.15, 3, 0.5, 0.8, 1.5, 20

_SMALL_CAPS = ("".join(map(chr, range(0xF761, 0xF77B))), "abcdefghijklmnopqrstuvwxyz")
# Radicals without a compatibility decomposition, and the ideographs of the same shape.
_EXTRA_RADICALS = ("⺠⻄⻅⻆⻈⻉⻋⻒⻓⻔⻘⻙⻚⻛⻜⻝⻢⻣⻥⻬⻮⻰", "民西见角讠贝车长长门青韦页风飞食马骨鱼齐齿龙")


def glyph_table() -> tuple[str, str]:
    """Characters to replace and their replacements: small capitals of the private use area, radicals by their decomposition."""
    radicals = "".join(map(chr, range(0x2F00, 0x2FD6)))
    return _SMALL_CAPS[0] + radicals + _EXTRA_RADICALS[0], _SMALL_CAPS[1] + "".join(unicodedata.normalize("NFKC", c) for c in radicals) + _EXTRA_RADICALS[1]


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")


def compact(c: Column) -> Column:
    """Runs of blanks become one blank, none at the ends."""
    return strip(F.regexp_replace(c, f"{BLANK}+", " "))


def casefold(c: Column) -> Column:
    """Lower case with the two foldings that occur in running text beyond it."""
    return F.replace(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))


def translate_glyphs(c: Column) -> Column:
    return F.translate(c, *glyph_table())


def normalize_text(c: Column) -> Column:
    c = translate_glyphs(c)
    for pattern, new in ((r"\r\n?", "\n"), (r"[ \t]+\n", "\n"), (r"\n{3,}", "\n\n")):
        c = F.regexp_replace(c, pattern, new)
    return strip(c)


def strip_unmapped_glyphs(c: Column) -> Column:
    """Glyph placeholders go; only a text that had one has its blanks collapsed."""
    return F.when(c.rlike(UNMAPPED_GLYPH), compact(F.regexp_replace(c, UNMAPPED_GLYPH, ""))).otherwise(c)


def count_words(c: Column) -> Column:
    """Han characters plus Latin words."""
    return F.regexp_count(c, F.lit(HAN)) + F.regexp_count(c, F.lit(LATIN_WORD))


def text_size(c: Column) -> Column:
    """Length with ideographs counted twice."""
    return F.length(c) + F.regexp_count(c, F.lit(IDEOGRAPH))


def repeated_key(c: Column) -> Column:
    return casefold(F.regexp_replace(compact(c), r"\p{Nd}+", "#"))


def has_content(text: Column, height: Column, body_height: Column) -> Column:
    """A word, a number of several digits or an ideograph; or a row of digits in letters of body size."""
    return text.rlike(CONTENT) | (text.rlike(NUMERIC_ROW) & F.coalesce(height >= body_height * BODY_RATIO, F.lit(False)))


def in_band() -> Column:
    band = F.col("page_height") * BAND
    return F.coalesce((F.col("top") <= band) | (F.col("bottom") >= F.col("page_height") - band), F.lit(False))


def starts_unit(c: Column) -> Column:
    """Whether a line opens a new unit: numbered or lettered heading, CJK heading, bullet, line that ends in a colon, salutation."""
    # Numerals and signs of Chinese headings, bullets.
    numeral = "一二三四五六七八九十百千零〇"
    s = strip(c)
    rules = [
        s.rlike(rf"^(\p{{Nd}}+(\.\p{{Nd}}+)*|[A-Z])[).]{BLANK}+[^\s]"),
        s.rlike(rf"^(第[{numeral}\p{{Nd}}]+[章节部分篇条讲]|[{numeral}]+[、．]|[（(][{numeral}\p{{Nd}}]+[）)]|\p{{Nd}}+(\.\p{{Nd}}+)*[、．])"),
        s.rlike(rf"^[•·▪◦●○■□‣*–—-]{BLANK}[^\s]"),
        s.endswith(":") & (F.length(s) <= 90),
        s.endswith("：") & (F.length(s) <= 40),
        s.rlike(rf"^(?i:Dear{BLANK}+[\p{{L}}\p{{N}}_]+|Best regards,?)$"),
    ]
    return reduce(lambda a, b: a | b, rules)


def normalize_unit(c: Column) -> Column:
    for pattern, new in (
        (r"\r\n?", "\n"), (r"[ \t]+", " "), (r"\n+", "\n"), (rf"([\p{{L}}\p{{N}}_])-{BLANK}+([\p{{L}}\p{{N}}_])", "$1$2"), (rf"{BLANK}*\n{BLANK}*", " "), (rf"{BLANK}{{2,}}", " "),
        (rf"(?<={IDEOGRAPH}) (?={IDEOGRAPH})", ""),
    ):
        c = F.regexp_replace(c, pattern, new)
    return strip(c)


def trim_text(c: Column, limit: Column) -> Column:
    """Compact text within a limit; what is cut ends in three dots, which count."""
    t = compact(c)
    cut = F.concat(F.regexp_replace(F.substring(t, F.lit(1), F.greatest(limit - 3, F.lit(0))), f"{BLANK}+$", ""), F.lit("..."))
    return F.when(F.length(t) <= limit, t).when(limit <= 0, "").when(limit <= 3, F.substring(F.lit("..."), F.lit(1), limit)).otherwise(cut)


def prefix_snippet(c: Column, n: int) -> Column:
    t = compact(c)
    return F.when(F.length(t) <= n, t).otherwise(F.concat(F.regexp_replace(F.substring(t, 1, n), f"{BLANK}+$", ""), F.lit("...")))


def split_sentences(c: Column) -> Column:
    """Sentences by their closing marks: after CJK stops with the brackets and quotation marks that follow, and at blanks after Western ones."""
    c = F.regexp_replace(c, f"({CJK_STOP}){BLANK}*", "$1\n")
    c = F.regexp_replace(c, f"({STOP}){BLANK}+", "$1\n")
    return F.filter(F.transform(F.split(c, "\n"), strip), lambda x: x != "")
