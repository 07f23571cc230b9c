"""Problem 4: one form for texts that look the same.

The skeleton of a text: decompose it, replace every character by the prototype of its look-alikes,
decompose again. Two texts look alike when their skeletons are equal. Visible differences survive:
accents, case, raised digits and added marks are never folded.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters of other scripts whose usual glyph is that of a Latin letter (prototype: the letters).
LOOKALIKES = {
    # Greek capitals, Cyrillic capitals, other letters of the same shape
    "A": "ΑАᎪ", "B": "ΒВᏴ", "C": "СϹᏟⅭ", "D": "ᎠⅮ", "E": "ΕЕᎬ", "F": "Ϝ", "G": "ԌᏀ", "H": "ΗНᎻ", "I": "ΙІӀⅠ",
    "J": "ЈͿᎫ", "K": "ΚКᏦ", "L": "ᏞⅬ", "M": "ΜМᎷϺⅯ", "N": "Ν", "O": "ΟОՕ", "P": "ΡРᏢ", "Q": "Ԛ", "S": "ЅᏚՏ", "T": "ΤТᎢ",
    "U": "Ս", "V": "ѴᏙⅤ", "W": "ԜᎳ", "X": "ΧХⅩ", "Y": "ΥҮ", "Z": "ΖᏃ",
    # small letters
    "a": "аɑ", "c": "сϲⅽ", "d": "ԁⅾ", "e": "е", "g": "ɡ", "h": "һ", "i": "іⅰ", "j": "јϳ", "l": "ⅼӏ", "m": "ⅿ", "n": "ո",
    "o": "οоօ", "p": "рρ", "q": "ԛ", "s": "ѕ", "u": "ս", "v": "ѵνⅴ", "w": "ԝ", "x": "хⅹ", "y": "у", "z": "ᴢ",
}
# Punctuation of one shape.
PUNCTUATION = {
    "-": "‐‑−﹣", "–": "‒", "—": "―─", "’": "ʼ՚", "‘": "ʻ", "·": "·∙⋅・", ";": ";", "|": "ǀ∣", ":": "ː∶꞉",
    "!": "ǃ", "/": "⁄∕", "~": "∼", "*": "∗", ",": "‚", "´": "΄", "µ": "μ", "Ω": "Ω", "K": "K", "Å": "Å",
}
# Radicals without a decomposition, and the ideographs that they look like.
RADICALS = ("⺠⻄⻅⻆⻈⻉⻋⻒⻓⻔⻘⻙⻚⻛⻜⻝⻢⻣⻥⻬⻮⻰", "民西见角讠贝车长长门青韦页风飞食马骨鱼齐齿龙")
#: Decompositions that leave the look of a character as it is; <super>, <circle>, <font> and the like change it.
_SAME_LOOK = {"<wide>", "<narrow>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>"}
_BLANK_CATEGORIES = {"Zs", "Zl", "Zp"}
_SOUND_MARKS = {"ﾞ": "゙", "ﾟ": "゚"}


def _invisible(char: str) -> bool:
    """Format characters, joiners, variation selectors and fillers: nothing of them is seen."""
    cp = ord(char)
    return unicodedata.category(char) == "Cf" or cp in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0) or 0xFE00 <= cp <= 0xFE0F or 0x180B <= cp <= 0x180F or 0xE0100 <= cp <= 0xE01EF


def read_confusables(path: str) -> dict[str, str]:
    """Look-alikes of a public table ("source ; prototype ; type # note", code points in hexadecimal), as far as both are letters of different scripts, or marks and signs that are not ASCII.

    Left out is what TESTDATA.md and this module hold to be a visible difference: pairs within ASCII, digits, letters that differ in case or accent.
    """
    found = {}
    with open(path, encoding="utf-8-sig") as file:
        for line in file:
            fields = [f.strip() for f in line.split("#")[0].split(";")]
            if len(fields) < 2:
                continue
            source, prototype = ("".join(chr(int(c, 16)) for c in f.split()) for f in fields[:2])
            bare = ["".join(c for c in unicodedata.normalize("NFKD", x.casefold()) if unicodedata.category(c) != "Mn") for x in (source, prototype)]
            if len(source) == 1 and source >= "\x80" and not source.isdigit() and not prototype.isdigit() and bare[0] != bare[1] and source.isalpha() == prototype.isalpha():
                found[source] = prototype
    return found


@lru_cache(maxsize=1)
def prototypes() -> dict[int, str]:
    """Code point to prototype, for every character that is not its own prototype.

    Built from the character database: widths, presentation forms, ligatures of letters, radicals
    and compatibility ideographs by their decompositions, blanks and invisible characters by their
    categories; then the fixed look-alikes above.
    """
    table: dict[int, str] = {}
    for cp in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= cp <= 0xDFFF or 0xAC00 <= cp <= 0xD7A3:
            continue
        char = chr(cp)
        category = unicodedata.category(char)
        if category in ("Cn", "Co"):
            continue
        if category in _BLANK_CATEGORIES:
            table[cp] = " "
        elif _invisible(char):
            table[cp] = ""
        elif decomposition := unicodedata.decomposition(char):
            tag, _, rest = decomposition.partition(" ")
            letters = 0xFB00 <= cp <= 0xFB06 or 0x2E80 <= cp <= 0x2FD5
            if tag in _SAME_LOOK or tag == "<compat>" and letters:
                table[cp] = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", char))
            elif tag[0] != "<" and category == "Lo" and 0xF900 <= cp <= 0x2FA1D:
                table[cp] = unicodedata.normalize("NFD", char)
    for code, mark in _SOUND_MARKS.items():
        table[ord(code)] = mark
    for prototype, same in (*LOOKALIKES.items(), *PUNCTUATION.items()):
        for char in same:
            table[ord(char)] = unicodedata.normalize("NFD", prototype)
    for radical, ideograph in zip(*RADICALS):
        table[ord(radical)] = ideograph
    for char in "\t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85":
        table[ord(char)] = " "
    for cp in (*range(0x00, 0x09), *range(0x0E, 0x1C), *range(0x7F, 0x85), *range(0x86, 0xA0)):
        table[cp] = ""
    # A prototype may hold characters that have prototypes themselves.
    return {cp: "".join(table.get(ord(c), c) for c in p) if len(p) != 1 or ord(p) in table else p for cp, p in table.items()}


def with_more(more: dict[str, str] | None) -> dict[int, str]:
    """The prototypes, and further look-alikes where the characters have no prototype of their own."""
    if not more:
        return prototypes()
    return {ord(c): unicodedata.normalize("NFD", p) for c, p in more.items()} | prototypes()


_plain = re.compile(r"[\x21-\x7e]+(?: [\x21-\x7e]+)*").fullmatch


def skeleton(text: str | None, table: dict[int, str] | None = None) -> str | None:
    """Skeleton of a text, blanks collapsed and stripped; null stays null."""
    if text is None or _plain(text):
        return text
    folded = unicodedata.normalize("NFD", text).translate(table or prototypes())
    return " ".join(unicodedata.normalize("NFD", folded).split())


def consistent(text: str | None) -> str | None:
    """A readable single form: the skeleton composed again (NFC), one blank for any run of blanks."""
    s = skeleton(text)
    return s if s is None else unicodedata.normalize("NFC", s)


@lru_cache(maxsize=1)
def _wording_table() -> dict[int, str]:
    """Closure of look-alikes and case: all characters that are case variants or look-alikes of each other get one code."""
    parent: dict[str, str] = {}

    def find(x: str) -> str:
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    def join(a: str, b: str) -> None:
        a, b = sorted((find(a), find(b)))
        parent[b] = a

    for cp, p in prototypes().items():
        if len(p) == 1 and p != " ":
            join(chr(cp), p)
    seen = set(parent) | {chr(c) for c in range(0x21, 0x2000)}
    for char in seen:
        for other in (char.lower(), char.upper()):
            if len(other) == 1 and other != char:
                join(char, other)
    table = dict(prototypes())
    for char in list(parent):
        root = find(char)
        if root != char:
            table[ord(char)] = root
        else:
            table.pop(ord(char), None)  # a root stands for itself
    for cp, p in list(table.items()):
        if len(p) > 1:
            table[cp] = "".join(find(c) if c in parent else c for c in p.lower())
    for char in ("ß", "ẞ"):
        table[ord(char)] = find("s") * 2
    table[ord(" ")] = ""
    for cp in range(sys.maxunicode + 1):
        if not 0xD800 <= cp <= 0xDFFF and unicodedata.category(chr(cp)) == "Nd":
            table[cp] = "#"
    return {cp: ("" if p == " " else p) for cp, p in table.items()}


_digits = re.compile("#+").sub


def wording(text: str | None) -> str | None:
    """Key under which lines are equal that differ only in digit runs, case, blanks or look-alike characters."""
    if text is None:
        return None
    table = _wording_table()
    key = text.translate(table) if text.isascii() else unicodedata.normalize("NFD", unicodedata.normalize("NFD", text).translate(table)).translate(table)
    return _digits("#", key)


def _skeletons(df: DataFrame, table: str, id_col: str, text_col: str, more: dict[str, str] | None = None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        looks = with_more(more)
        for batch in batches:
            texts = batch.column(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), texts, pa.array([skeleton(t, looks) for t in texts.to_pylist()], pa.string())], ["record_id", "text", "skeleton"])

    rows = df.select(F.col(id_col).cast("long"), F.col(text_col)).where(F.col(text_col).isNotNull())
    return rows.mapInArrow(run, "record_id long, text string, skeleton string").select(F.lit(table).alias("record_table"), "record_id", "text", "skeleton")


def lookalikes(records: list[tuple[str, DataFrame, str, str]], references: DataFrame, ref_id: str = "ref_id", text_col: str = "text", confusables: str | None = None) -> DataFrame:
    """(record_table, record_id, ref_id): records whose whole text looks like a reference text but is another sequence of characters.

    records: (name, table, id column, text column) of each table. The join is an equi-join on the
    skeleton, so every record meets only references of its class; Spark broadcasts the references
    only while they are under its size threshold and shuffles on the skeleton beyond it. Null texts
    and texts of blanks or invisible characters alone give no row; identical texts are no case;
    repeated records are cases each, and a record that looks like several references gives one row
    for each of them. Extra columns are ignored. confusables: place of a public table that adds look-alikes.
    """
    more = read_confusables(confusables) if confusables else None
    refs = _skeletons(references, "reference", ref_id, text_col, more).where(F.col("skeleton") != "").select(F.col("record_id").alias("ref_id"), F.col("text").alias("ref_text"), "skeleton")
    out = None
    for name, df, id_col, column in records:
        part = _skeletons(df, name, id_col, column, more).where(F.col("skeleton") != "")
        out = part if out is None else out.unionByName(part)
    return out.join(refs, "skeleton").where(F.col("text") != F.col("ref_text")).select("record_table", "record_id", "ref_id")


def groups(df: DataFrame, id_col: str, text_col: str = "text", more: dict[str, str] | None = None) -> DataFrame:
    """(id, skeleton_id, form): every non-null text with its class of equal skeletons and its consistent form.

    One row per record; classes are named by a hash of the skeleton, so no class is ever gathered.
    The skeleton is made once per row.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        looks = with_more(more)
        for batch in batches:
            skeletons = [skeleton(t, looks) for t in batch.column(1).to_pylist()]
            forms = [s if s.isascii() else unicodedata.normalize("NFC", s) for s in skeletons]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(skeletons, pa.string()), pa.array(forms, pa.string())], [id_col, "skeleton", "form"])

    rows = df.select(F.col(id_col), F.col(text_col)).where(F.col(text_col).isNotNull())
    return rows.mapInArrow(run, f"`{id_col}` {kind}, skeleton string, form string").select(id_col, F.xxhash64("skeleton").alias("skeleton_id"), "form")


def record_groups(records: list[tuple[str, DataFrame, str, str]], confusables: str | None = None) -> DataFrame:
    """(record_table, record_id, skeleton_id, form) of every non-null text of several tables; equal-looking texts share a class across tables.

    records: (name, table, id column, text column) of each table.
    """
    more = read_confusables(confusables) if confusables else None
    out = None
    for name, df, id_col, column in records:
        part = groups(df.select(F.col(id_col).cast("long").alias("record_id"), F.col(column)), "record_id", column, more).select(F.lit(name).alias("record_table"), "record_id", "skeleton_id", "form")
        out = part if out is None else out.unionByName(part)
    return out
