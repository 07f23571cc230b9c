"""Problem 6: text that was decoded with the wrong character encoding.

A noisy channel is a pair (encoding the bytes were in, encoding they were read with). For every
channel the text is turned back into a byte lattice in which a lost byte (U+FFFD) is a wildcard;
a Viterbi search over the lattice takes the reading that is likeliest under the corpus: frequencies
of characters given their class, of class pairs, and of words. A passage counts as damaged when its
best reading is likelier than the passage as it stands by a margin that pays for the channel.
"""

from __future__ import annotations

import heapq
import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOST = "�"
#: Encodings of one byte that UTF-8 text is commonly read with.
SINGLE_BYTE = ("cp1252", "mac_roman", "cp437", "cp850", "cp1251", "koi8_r", "cp1250")
#: Encodings of several bytes that UTF-8 text is commonly read with.
MULTI_BYTE = ("gbk", "cp932", "big5", "euc_kr")
#: Encodings whose text is commonly read as cp1252 or Latin-1.
LEGACY = ("cp1251", "gbk", "cp932", "koi8_r", "cp1256", "cp874", "big5", "euc_kr", "cp1253")
#: Nats that a channel costs for a text, and that each passage must gain besides.
CHANNEL_COST, PASSAGE_GAIN = 6.0, 5.0  # once a channel is sure for a text, its other passages need any gain only
SKETCH_ROWS, SKETCH_COLUMNS = 2, 1 << 18


# ------------------------------------------------------------------ channels


@lru_cache(maxsize=None)
def byte_table(encoding: str) -> dict[int, str]:
    """Character of each byte; bytes without one stay as the control character of their number."""
    table = {}
    for b in range(256):
        try:
            table[b] = bytes([b]).decode(encoding)
        except UnicodeDecodeError:
            table[b] = chr(b)
    return table


@lru_cache(maxsize=None)
def to_bytes(encoding: str) -> dict[str, int]:
    """Byte of each character. For cp1252 the control characters of Latin-1 stand for their bytes too."""
    table = {c: b for b, c in byte_table(encoding).items() if b >= 0x80}
    for b in range(0x80, 0xA0):
        table.setdefault(chr(b), b)
    return table


def _characters(encoding: str, low: int, high: int) -> str:
    return "".join(re.escape(c) for c, b in to_bytes(encoding).items() if low <= b < high)


@lru_cache(maxsize=None)
def utf8_runs(encoding: str) -> re.Pattern:
    """Runs of characters that, as bytes of the encoding, are sequences of UTF-8; a lost byte may stand in for one."""
    cont = f"[{_characters(encoding, 0x80, 0xC0)}{LOST}]"
    two, three, four = (f"[{_characters(encoding, *r)}]" for r in ((0xC2, 0xE0), (0xE0, 0xF0), (0xF0, 0xF5)))
    unit = f"(?:{two}{cont}|{three}{cont}{{2}}|{four}{cont}{{3}}|{LOST}{cont}{cont}?)"
    return re.compile(f"{unit}+(?:[{_characters(encoding, 0xC2, 0xF5)}]{cont}?$)?")


@lru_cache(maxsize=None)
def utf8_leads(encoding: str) -> frozenset[str]:
    """Characters that a run of utf8_runs can begin with."""
    return frozenset(c for c, b in to_bytes(encoding).items() if 0xC2 <= b < 0xF5) | {LOST}


_latin_run = re.compile("[\x80-\xffŒœŠšŸŽžƒˆ˜–-›€™]{2}")
_legacy_sign = re.compile("[\x80-\x9f]|[\xa1-\xffŒœŠšŸŽžƒ]{3}|^[\xc0-\xff]{2}$")
_utf8_bytes = re.compile(rb"(?:[\xe0-\xef][\x80-\xbf]{2}|[\xc2-\xdf][\x80-\xbf]){2}")
_utf8_part = re.compile(rb"[\xe0-\xef][\x80-\xbf]|[\x80-\xbf]{2}|[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef]\?")
_wide = re.compile("[⺀-￯]{2}")
_beside_latin = re.compile("(?<=[A-Za-z ])[⺀-￯]{1,3}(?=[a-z])|(?<=[A-Za-z])[⺀-￯]{1,3}")
_alone = re.compile("(?<![\x80-￿])[⺀-￿](?![\x80-￿])|[^\\W\\d_\x80-￿][\x80-￿]|[\x80-￿][^\\W\\d_\x80-￿]")  # a run of wide characters of one, or beside a letter
_ANY = frozenset(range(0x80, 0x100))
_UNREAD = frozenset((0x81, 0x8D, 0x8F, 0x90, 0x9D))  # without a character in cp1252


@lru_cache(maxsize=None)
def unread_bytes(encoding: str) -> frozenset:
    """The bytes that have no character in an encoding of one byte, so that a mark of loss can stand for them; all if each has one."""
    return frozenset(b for b in _ANY if bytes([b]).decode(encoding, "ignore") == "") or _ANY


#: Nats of a byte that no reading takes, and lead of the first reading over the second.
KEPT_BYTE, SURE = 12.0, 1.0
FEW, AT_ONCE = 64, 1 << 18  # pairs of characters up to which costs are looked up one by one, and costs of a matrix that are made at a time
FLUSH = 1_000_000  # costs that a decoder remembers
DEEP = 100_000  # starts that a search keeps open; beyond them it goes on depth first, which finds the same


@lru_cache(maxsize=None)
def lost_bytes(encoding: str, then: int | None) -> frozenset:
    """The bytes that a mark of loss can stand for: those that cannot be read before the byte that follows."""
    if then is None:
        return _ANY
    return frozenset(b for b in _ANY if bytes([b, then]).decode(encoding, "replace").startswith(LOST)) or _ANY


def _gated(parts: list[str], unit) -> re.Pattern:
    """parts, or any encoding's unit; a first look at two characters rules most places out at once."""
    leads = "".join(_characters(e, 0xC2, 0xF5) for e in SINGLE_BYTE)
    conts = "".join(_characters(e, 0x80, 0xC0) for e in SINGLE_BYTE)
    units = "|".join(unit(f"[{_characters(e, 0xC2, 0xE0)}]", f"[{_characters(e, 0xE0, 0xF0)}]", f"[{_characters(e, 0x80, 0xC0)}]") for e in SINGLE_BYTE)
    return re.compile("|".join([*parts, f"(?=[{leads}][{conts}])(?:{units})"]))


@lru_cache(maxsize=1)
def _suspicious() -> re.Pattern:
    """Any place where a channel could apply; what it does not match was never touched by one that we know."""
    return _gated([f"[{LOST}\x80-\x9f]", _latin_run.pattern], lambda two, three, cont: f"{two}{cont}|{three}{cont}{{2}}")


def may_be_garbled(text: str) -> bool:
    """Cheap and complete first test: false only if no channel applies anywhere in the text."""
    if text.isascii():
        return False
    if _suspicious().search(text):
        return True
    if _wide.search(text):
        for e in MULTI_BYTE:
            if _utf8_bytes.search(text.encode(e, "replace")):
                return True
    return any(_western(m.group(), e) for m in _beside_latin.finditer(text) for e in MULTI_BYTE)


def _western(run: str, encoding: str) -> str:
    """A run of wide characters beside Latin letters, if its bytes are UTF-8 of Western letters and marks; else nothing."""
    try:
        new = run.encode(encoding).decode("utf-8")
    except UnicodeError:
        return ""
    return new if all(c < "ɐ" or "‐" <= c < "⁐" for c in new) and not new.isascii() else ""


@lru_cache(maxsize=1)
def _marked() -> re.Pattern:
    """Places that hardly any sound text has: what the corpus model must not learn from."""
    parts = [f"[{LOST}\x80-\x9f╀-╿░-▓]", "[Œœ\x80-\xff]{3}", "[ÂÃÐÑØÙàáâã][\x80-¿Œ-Ÿ€™†‡‚ƒ‰]"]
    return _gated(parts, lambda two, three, cont: f"(?:{two}{cont}|{three}{cont}{{2}}){{3}}")


def is_sound(text: str) -> bool:
    """Whether the corpus model may learn from a text."""
    return text.isascii() or not _marked().search(text)


# ------------------------------------------------------------------ the corpus model


@lru_cache(maxsize=1 << 16)
def char_class(char: str) -> int:
    """A class of characters that follow each other in text: script and case for letters, kind for the rest."""
    cp = ord(char)
    if cp < 0x80:
        return 1 if "a" <= char <= "z" else 2 if "A" <= char <= "Z" else 3 if char.isdigit() else 4 if char.isspace() else 5 if char in ".,;:!?'\"()-" else 6
    if cp < 0xA0:
        return 7
    category = unicodedata.category(char)
    if category[0] == "Z":
        return 4
    if category == "Cf":
        return 8
    if cp < 0x250:
        return {"Lu": 9, "Ll": 10}.get(category, 11)
    block = (12 if cp < 0x370 else 13 if cp < 0x400 else 14 if cp < 0x430 else 15 if cp < 0x450 else 16 if cp < 0x530 else 17 if cp < 0x600
             else 18 if cp < 0x700 else 19 if cp < 0x900 else 20 if cp < 0x980 else 21 if cp < 0xE00 else 22 if cp < 0xE80 else 23 if cp < 0x1E00
             else 24 if cp < 0x2000 else 25 if cp < 0x2070 else 26 if cp < 0x2190 else 27 if cp < 0x2500 else 28 if cp < 0x2600 else 29 if cp < 0x2E80
             else 30 if cp < 0x3040 else 31 if cp < 0x30A0 else 32 if cp < 0x3100 else 33 if cp < 0x3400 else 34 if cp < 0xA000 else 35 if cp < 0xAC00
             else 36 if cp < 0xD7B0 else 37 if cp < 0xF900 else 38 if cp < 0xFF00 else 39 if cp < 0xFF61 else 40 if cp < 0xFFF0 else 41)
    return 42 if cp == 0xFFFD else block


CLASSES = 43
_words = re.compile(r"[^\W\d_]+(?:[̀-ͯ]+[^\W\d_]*)*")


_joined = re.compile("[⺀-鿿가-힣豈-﫿！-￮“”‘’…—]{2,}")
PAIRS_AT = SKETCH_ROWS * SKETCH_COLUMNS  # place in the sketch from which it counts pairs of characters
STARTS_AT = 2 * PAIRS_AT  # and from which it counts how words start: at each of their letters
BITS_AT, BITS = STARTS_AT + PAIRS_AT, 1 << 20  # and from which it tells, in so many numbers of 64 bits, whether any word starts so


def _runs(char: str) -> bool:
    """Whether pairs with this character are counted: scripts without blanks between words, and their punctuation."""
    return "⺀" <= char <= "鿿" or "가" <= char <= "힣" or "豈" <= char <= "﫿" or "！" <= char <= "￮" or char in "“”‘’…—"


def _cells(word: str) -> list[int]:
    """The word's cells in the count sketch."""
    import xxhash

    h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
    return [(h >> (32 * row)) % SKETCH_COLUMNS + row * SKETCH_COLUMNS for row in range(SKETCH_ROWS)]


def _pair_cells(a, b):
    """The cells of a pair of characters, given as numbers or as arrays of uint64."""
    whole = (1 << 64) - 1 if isinstance(a, int) else np.uint64((1 << 64) - 1)
    shift, half, cut = (29, 32, SKETCH_COLUMNS - 1) if isinstance(a, int) else map(np.uint64, (29, 32, SKETCH_COLUMNS - 1))
    k1, k2, k3 = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9) if isinstance(a, int) else map(np.uint64, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9))
    h = a * k1 + b * k2 & whole
    h = (h ^ h >> shift) * k3 & whole
    h = h ^ h >> half
    return h & cut, (h >> half & cut) + (SKETCH_COLUMNS if isinstance(a, int) else np.uint64(SKETCH_COLUMNS))


def _starts(word: str) -> Iterator[int]:
    """A number for each start of a word, the word itself last."""
    h = 0
    for char in word:
        h = h * STEP + ord(char) + 1 & (1 << 64) - 1
        yield h


STEP = 0x100000001B3


def _start_bits(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place and four bits for the number of each start."""
    h = (h ^ h >> np.uint64(32)) * np.uint64(0x94D049BB133111EB)
    h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    one, six, mask = np.uint64(1), np.uint64(63), np.uint64(0)
    for k in (0, 6, 12, 18):
        mask = mask | one << (h >> np.uint64(k) & six)
    return (h >> np.uint64(44)).astype(np.int64), mask


class Model:
    """Frequencies of characters, class pairs and words of the corpus's sound texts."""

    def __init__(self, chars: dict[int, int], pairs: dict[int, int], words: np.ndarray | None = None):
        self.words = words
        self.counts = {chr(cp): n for cp, n in chars.items()}
        totals: Counter = Counter()
        for cp, n in chars.items():
            totals[char_class(chr(cp))] += n
        self.given_class = {chr(cp): -math.log((n + 0.5) / (totals[char_class(chr(cp))] + 500)) for cp, n in chars.items()}
        self.unseen = {c: -math.log(0.5 / (totals[c] + 500)) for c in range(CLASSES)}
        left: Counter = Counter()
        for key, n in pairs.items():
            left[key // CLASSES] += n
        self.pair = [[-math.log((pairs.get(a * CLASSES + b, 0) + 0.2) / (left[a] + 0.2 * CLASSES)) for b in range(CLASSES)] for a in range(CLASSES)]
        self.known: dict[str, tuple[int, float]] = {}  # class and cost of characters met
        self.n_words = float(words[:SKETCH_COLUMNS].sum()) if words is not None else 0.0

    def char_cost(self, char: str) -> float:
        cost = self.given_class.get(char)
        return self.unseen[char_class(char)] if cost is None else cost

    def cost(self, text: str, before: str = " ", after: str = " ") -> float:
        """Nats of a passage between two neighbours."""
        pair, previous, total, known = self.pair, char_class(before), 0.0, self.known
        for char in text:
            if (x := known.get(char)) is None:
                x = known[char] = (char_class(char), self.char_cost(char))
            total += pair[previous][x[0]] + x[1]
            previous = x[0]
        return total + pair[previous][char_class(after)]

    def follow_cost(self, before: str, char: str) -> float:
        """Nats of a character after another: by the frequency of the two together where words run together, else by their classes."""
        apart = self.pair[char_class(before)][char_class(char)] + self.char_cost(char)
        if self.words is None or len(self.words) < STARTS_AT or not _runs(before) or not _runs(char):
            return apart
        n = min(int(self.words[PAIRS_AT + c]) for c in _pair_cells(ord(before), ord(char)))
        return -math.log(0.9 * n / (self.counts.get(before, 0) + 1.0) + 0.1 * math.exp(-apart))

    def started(self, h: np.ndarray) -> np.ndarray:
        """How many words of the corpus start so, at most, given the numbers of the starts; 0 where none does."""
        a, b = _pair_cells(h, np.uint64(0))
        n = np.minimum(self.words[STARTS_AT + a.astype(np.int64)], self.words[STARTS_AT + b.astype(np.int64)])
        place, mask = _start_bits(h)
        return np.where(self.words[BITS_AT + place].view(np.uint64) & mask == mask, n, 0)

    def goes_on(self, h: int, points: np.ndarray) -> tuple[list[int], list[int]]:
        """Numbers and counts of a start with each of the characters behind it."""
        longer = np.uint64(h * STEP + 1 & (1 << 64) - 1) + points
        return longer.tolist(), self.started(longer).tolist()

    def starts(self, start: str) -> int:
        """How many words of the corpus start so, and how many are just that, at most; no word is more frequent than any of its starts."""
        return int(self.started(np.fromiter(_starts(start), np.uint64)).min())

    def word_cost(self, word: str) -> float:
        """Nats of a word by its corpus frequency (count sketch of a fixed size); 0 without a sketch."""
        if self.words is None or not word:
            return 0.0
        return self.times_cost(self.times(word))

    def times(self, word: str) -> int:
        """How often the corpus has the word, as far as the sketch can tell."""
        return min(self.wholes(word), self.starts(word))

    def wholes(self, word: str) -> int:
        """The same, if the word has a start that the corpus has."""
        return min(int(self.words[c]) for c in _cells(word))

    def times_cost(self, n: int) -> float:
        return -math.log((n + 0.05) / (self.n_words + 1.0))


def _count(batches: Iterator[pa.RecordBatch], with_words: bool) -> Iterator[pa.RecordBatch]:
    chars: Counter = Counter()
    pairs = np.zeros(CLASSES * CLASSES, np.int64)
    words: Counter = Counter()
    joined: Counter = Counter()
    classes = np.full(0x110000, -1, np.int16)
    for batch in batches:
        sound = [t for t in batch.column(0).to_pylist() if t and is_sound(t)]
        points = np.frombuffer("\n".join(sound).encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(points):
            continue
        values, counts = np.unique(points, return_counts=True)
        for cp, n in zip(values.tolist(), counts.tolist()):
            chars[cp] += n
            if classes[cp] < 0:
                classes[cp] = char_class(chr(cp))
        kinds = classes[points].astype(np.int64)
        pairs += np.bincount(kinds[:-1] * CLASSES + kinds[1:], minlength=CLASSES * CLASSES)
        if with_words:
            for t in sound:
                if not t.isascii():
                    words.update(w for w in _words.findall(t) if not w.isascii())
                    for run in _joined.findall(t):
                        joined.update(map(str.__add__, run, run[1:]))
    kind = [0] * len(chars)
    key, count = list(chars), list(chars.values())
    for k in np.flatnonzero(pairs).tolist():
        kind.append(1)
        key.append(k)
        count.append(int(pairs[k]))
    cells: Counter = Counter()
    for w, n in words.items():
        for c in _cells(w):
            cells[c] += n
    for pair, n in joined.items():
        for c in _pair_cells(*map(ord, pair)):
            cells[PAIRS_AT + c] += n
    starts: Counter = Counter()
    for w, n in words.items():
        if not any(map(_runs, w)):  # those are not looked up as words
            for h in _starts(w):
                starts[h] += n
    marks = np.fromiter(starts, np.uint64, len(starts))
    for row in _pair_cells(marks, np.uint64(0)):
        for c, n in zip(row.tolist(), starts.values()):
            cells[STARTS_AT + c] += n
    kind += [2] * len(cells)
    key += list(cells)
    count += list(cells.values())
    places, bits = _start_bits(marks)
    order = np.argsort(places)
    places, first = np.unique(places[order], return_index=True)
    if len(places):
        kind += [3] * len(places)
        key += (BITS_AT + places).tolist()
        count += np.bitwise_or.reduceat(bits[order], first).view(np.int64).tolist()
    yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(key, pa.int64()), pa.array(count, pa.int64())], ["kind", "key", "n"])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's sums as one row of bytes, in order and compressed: as rows they would fill the driver's memory."""
    parts = [[np.asarray(column) for column in batch.columns] for batch in batches if batch.num_rows]
    if parts:
        kind, key, n = map(np.concatenate, zip(*parts))
        order = np.lexsort((key, kind))
        columns = kind[order].astype(np.int8), np.diff(key[order], prepend=0), n[order]
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(x.tobytes(), 1)], pa.binary()) for x in columns], ["kind", "key", "n"])


def train(texts: list[DataFrame], with_words: bool = True) -> Model:
    """The model of all sound texts of the given one-column tables.

    Every task counts its part; the sums that reach the driver are bounded whatever the corpus:
    one per code point, per pair of classes, per cell of the word sketch and per number of its bits.
    """
    union = texts[0].toDF("text")
    for df in texts[1:]:
        union = union.unionByName(df.toDF("text"))
    counts = union.mapInArrow(lambda batches: _count(batches, with_words), "kind int, key long, n long").groupBy("kind", "key").agg(F.coalesce(F.sum(F.when(F.col("kind") < 3, F.col("n"))), F.bit_or("n")).alias("n"))
    chars, pairs = {}, {}
    words = np.zeros(BITS_AT + BITS, np.int64) if with_words else None
    for row in counts.mapInArrow(_pack, "kind binary, key binary, n binary").collect():
        kind, key, n = (np.frombuffer(zlib.decompress(x), t) for x, t in zip(row, (np.int8, np.int64, np.int64)))
        key = np.cumsum(key)
        for k, part in enumerate((chars, pairs)):
            part.update(zip(key[kind == k].tolist(), n[kind == k].tolist()))
        if with_words:
            words[key[kind > 1]] = n[kind > 1]
    return Model(chars, pairs, words)


# ------------------------------------------------------------------ the search


class Decoder:
    """Finds and restores damaged passages under a model."""

    def __init__(self, model: Model):
        self.model = model
        self.likely: dict[tuple, list] = {}
        self.tried: dict[tuple, str] = {}  # of one text, which is searched in two orders
        self.latin: dict[str, list] = {}  # bytes of passages, likewise
        self.costs: dict[tuple, float] = {}  # of passages as they stand, of one text and all channels
        self.follows: dict[tuple[str, str], float] = {}
        self.encoded: dict[str, dict[tuple, list[tuple[bytes, str]]]] = {}
        self.alphabets: dict[str, list[str]] = {}
        self.between: dict[tuple[str, str], str] = {}
        self.filled: dict[tuple[str, str, str], str] = {}
        self.points = np.full(0x110000, -1, np.int16), np.zeros(0x110000), np.zeros(0x110000), np.zeros(0x110000, bool)  # class, cost, count and _runs of characters met
        self.pair = np.array(model.pair)

    def _columns(self, chars: list[str]) -> np.ndarray:
        """Code points of characters, whose facts are looked up."""
        points = np.frombuffer("".join(chars).encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds, costs, counts, runs = self.points
        for cp in points[kinds[points] < 0].tolist():
            char = chr(cp)
            kinds[cp], costs[cp], counts[cp], runs[cp] = char_class(char), self.model.char_cost(char), self.model.counts.get(char, 0), _runs(char)
        return points

    def _follow_costs(self, before: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """The model's follow_cost of every character after every other, as a matrix."""
        kinds, costs, counts, runs = self.points
        out = self.pair[kinds[before][:, None], kinds[chars][None, :]] + costs[chars][None, :]
        words = self.model.words
        if words is not None and len(words) >= STARTS_AT:
            rows, columns = np.flatnonzero(runs[before]), np.flatnonzero(runs[chars])
            if len(rows) and len(columns):
                a, b = _pair_cells(before[rows].astype(np.uint64)[:, None], chars[columns].astype(np.uint64)[None, :])
                n = np.minimum(words[PAIRS_AT + a.astype(np.int64)], words[PAIRS_AT + b.astype(np.int64)])
                at = np.ix_(rows, columns)
                out[at] = -np.log(0.9 * n / (counts[before[rows]][:, None] + 1.0) + 0.1 * np.exp(-out[at]))
        return out

    def _best_before(self, costs: np.ndarray, before: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least cost of reaching each character from all before it, and from which."""
        best, where = np.full(len(chars), np.inf), np.zeros(len(chars), np.int64)
        rows = max(1, AT_ONCE // len(chars))
        for k in range(0, len(before), rows):
            total = costs[k : k + rows, None] + self._follow_costs(before[k : k + rows], chars)
            row = total.argmin(axis=0)
            least = total[row, np.arange(len(chars))]
            better = least < best
            best[better], where[better] = least[better], row[better] + k
        return best, where

    def _single(self, text: str, encoding: str) -> tuple[float, str, int]:
        """UTF-8 read with an encoding of one byte. Bytes that no reading takes stay as their characters."""
        table, lost = to_bytes(encoding), unread_bytes(encoding)

        def decode(run: str, before: str, after: str) -> str | None:
            if LOST not in run:
                try:
                    return bytes(table[c] for c in run).decode("utf-8")
                except UnicodeDecodeError:
                    pass
            elif not run.strip(LOST):
                return None
            return self._lattice([lost if c == LOST else table[c] for c in run], "utf-8", (2, 3, 4), before, after, run)

        return self._pieces(text, utf8_runs(encoding), decode)

    def _readings(self, encoding: str, pattern: tuple) -> list[str]:
        """Characters of the corpus for a byte sequence of an encoding; a wildcard is the set of the bytes it can be."""
        key = (encoding, pattern)
        if key not in self.likely:
            if encoding not in self.encoded:
                self.encoded[encoding] = {}
                for char in self.model.given_class:
                    data = char.encode(encoding, "ignore") if char >= "\x80" and char != LOST else b""
                    for k, b in enumerate(data):
                        self.encoded[encoding].setdefault((len(data), k, b), []).append((data, char))
            if all(isinstance(p, int) for p in pattern):
                char = bytes(pattern).decode(encoding, "ignore")
                self.likely[key] = [char] if len(char) == 1 and char.encode(encoding, "ignore") == bytes(pattern) else []
            else:
                sets = [(p,) if isinstance(p, int) else p for p in pattern]
                index, place = self.encoded[encoding], min(range(len(pattern)), key=lambda k: len(sets[k]))
                near = [x for b in sets[place] for x in index.get((len(pattern), place, b), [])]
                self.likely[key] = [c for data, c in near if all(b == p if isinstance(p, int) else b in p for b, p in zip(data, pattern))]
        return self.likely[key]

    def _lattice(self, parts: list, encoding: str, lengths: tuple, before: str, after: str, stays: str | None = None) -> str:
        """Viterbi over a byte lattice: parts are bytes, sets of bytes (lost ones) and characters that are no bytes.

        A state is a place and the character before it, so paths are scored with pairs; all states
        of a place go on with all readings, where these are many as matrices. Two lost bytes can stand behind one mark. Where several readings are left, the words of the
        corpus decide; a character stays U+FFFD where neither they nor the pairs do. stays: what a
        byte is kept as that no reading takes.
        """
        n, follows = len(parts), self.follows

        def follow(a: str, b: str) -> float:
            if (x := follows.get((a, b))) is None:
                if len(follows) > FLUSH:
                    follows.clear()
                x = follows[a, b] = self.model.follow_cost(a, b)
            return x

        states: list[dict] = [{} for _ in range(n + 1)]
        states[0][before] = (0.0, None, "", ())
        for i in range(n):
            here = sorted(states[i].items(), key=lambda x: x[1][0])
            if not here:
                continue
            columns = None
            kept = parts[i] if isinstance(parts[i], str) else stays[i] if stays else LOST
            steps: list[tuple] = [(1, [kept], 0.0 if isinstance(parts[i], str) else KEPT_BYTE)]
            for length in lengths:
                for taken in range(max(1, length // 2), length + 1):
                    piece = parts[i : i + taken]
                    if len(piece) < taken or any(isinstance(p, str) for p in piece):
                        break
                    lost = [k for k, p in enumerate(piece) if not isinstance(p, int)]
                    if len(lost) == taken and encoding == "utf-8" or length - taken > len(lost):
                        continue
                    for twice in combinations(lost, length - taken):
                        pattern = tuple(q for k, p in enumerate(piece) for q in ((_ANY, _ANY) if k in twice else (p,)))
                        if found := self._readings(encoding, pattern):
                            steps.append((taken, found, len(lost) * 1.0 + len(twice) * 4.0))
            for taken, found, paid in steps:
                reached = states[i + taken]
                if found == [LOST]:
                    ways = [(LOST, here[0][1][0], 0)]
                elif len(here) * len(found) <= FEW:
                    ways = [(char, *min((cost + follow(last, char), k) for k, (last, (cost, *_)) in enumerate(here))) for char in found]
                else:
                    columns = columns or (np.array([x[0] for _, x in here]), self._columns([c for c, _ in here]))
                    ways = zip(found, *map(np.ndarray.tolist, self._best_before(*columns, self._columns(found))))
                for char, total, k in ways:
                    old = reached.get(char)
                    if old is None or total + paid < old[0]:
                        reached[char] = (total + paid, i, here[k][0], found)
        if not states[n]:
            return ""
        ends = self._follow_costs(self._columns([*states[n]]), self._columns([after]))[:, 0]
        char = min(zip((x[0] for x in states[n].values()), ends.tolist(), states[n]), key=lambda x: x[0] + x[1])[2]
        out, at, then = [], n, after
        while at > 0:
            _, i, last, found = states[at][char]
            if len(found) > 1:
                points = self._columns(found)
                ranked = sorted(zip((self._follow_costs(self._columns([last]), points)[0] + self._follow_costs(points, self._columns([then]))[:, 0]).tolist(), found))
                sure = ranked[1][0] - ranked[0][0] > SURE and char == ranked[0][1]
                out.append((char, sure, [c for _, c in ranked]))
            else:
                out.append((char, True, [char]))
            at, char, then = i, last, char
        return self._by_words(out[::-1], before, after)

    def _by_words(self, read: list[tuple[str, bool, list[str]]], before: str, after: str) -> str:
        """The characters read, with those of several readings chosen by the words that they make."""
        chars = [c for c, _, _ in read]
        if all(len(options) == 1 for _, _, options in read):
            return "".join(chars)
        known = [False] * len(read)
        for m in _words.finditer("".join(c if len(c) == 1 else LOST for c in chars)):
            places = [k for k in range(m.start(), m.end()) if len(read[k][2]) > 1]
            if places and not any(map(_runs, m.group())):
                found = self._spelling([[c] if k not in places else read[k][2] for k, c in enumerate(chars[m.start() : m.end()], m.start())])
                if found:
                    for k, c in zip(range(m.start(), m.end()), found):
                        chars[k], known[k] = c, True
        return "".join(c if k or sure else LOST for c, k, (_, sure, _) in zip(chars, known, read))

    def _spelling(self, letters: list[list[str]]) -> str | None:
        """The word of the corpus that the options for each letter can spell, if one is clearly the likeliest."""
        model = self.model
        if model.words is None:
            return None
        # Depth first, the most frequent start first; no start goes on that leads neither to the most frequent word nor to one near it.
        points = [np.array([ord(c) for c in o], np.uint64) for o in letters]
        first, second, best, open_ = 0, 0, None, [(1 << 62, "", 0)]
        while open_:
            n, start, h = open_.pop()
            if n <= second or first and model.times_cost(n) - model.times_cost(first) > SURE:
                continue
            if len(start) < len(letters):
                k = len(start)
                open_ += sorted((min(n, m), start + c, g) for c, g, m in zip(letters[k], *model.goes_on(h, points[k])) if m)
            elif (n := min(n, model.wholes(start))) > first:
                first, second, best = n, first, start
            else:
                second = max(n, second)
        return best if first and model.times_cost(second) - model.times_cost(first) > SURE else None

    def _pieces(self, text: str, runs: re.Pattern, decode, loose: re.Pattern | None = None, alone=None) -> tuple[float, str, int]:
        """(gain, text, passages) of decoding the runs that gain by it.

        A passage has to gain PASSAGE_GAIN; if the passages together pay for the channel, those that
        gain less are decoded too, and by the function alone those of the loose runs, which would prove nothing by themselves.
        """
        cost, costs = self.model.cost, self.costs

        def tried(pattern: re.Pattern, text: str, decode) -> list[tuple[float, int, int, str]]:
            found = []
            for m in pattern.finditer(text):
                run = m.group()
                before, after = text[m.start() - 1 : m.start()] or " ", text[m.end() : m.end() + 1] or " "
                new = decode(run, before, after)
                if new and new != run:
                    key = (run, before, after)
                    if (stays := costs.get(key)) is None:
                        stays = costs[key] = cost(run, before, after)
                    found.append((stays - cost(new, before, after), m.start(), m.end(), new))
            return found

        def replaced(text: str, taken: list[tuple[float, int, int, str]]) -> str:
            out, at = [], 0
            for _, a, b, new in taken:
                out += (text[at:a], new)
                at = b
            return "".join([*out, text[at:]])

        found = tried(runs, text, decode)
        strong = [x for x in found if x[0] > PASSAGE_GAIN]
        gain = sum(x[0] for x in strong)
        if gain <= CHANNEL_COST:
            return gain, replaced(text, strong), len(strong)
        taken = [x for x in found if x[0] > 0]
        text = replaced(text, taken)
        if loose:
            more = [x for x in tried(loose, text, alone) if x[0] > 0]
            text, taken = replaced(text, more), taken + more
        return sum(x[0] for x in taken), text, len(taken)

    def _multi(self, text: str, encoding: str) -> tuple[float, str, int]:
        """UTF-8 read with an encoding of several bytes."""

        def applies(run: str, raw: bytes) -> bool:
            """Most of the run is bytes of UTF-8 in this encoding; what the lattice cannot gain from is left out."""
            known = run.replace(LOST, "").encode(encoding, "ignore")
            foreign = raw.count(b"?") - run.count(LOST) - run.count("?")
            if not _utf8_part.search(raw) or foreign * 8 > len(run):
                return False
            return len(known) < 12 or 3 * len(known.decode("utf-8", "ignore")) * 2 >= len(known)

        def decode(run: str, before: str, after: str) -> str | None:
            raw = run.encode(encoding, "replace")
            if LOST not in run:
                if not _utf8_bytes.search(raw):
                    return _western(run, encoding) if before.isalpha() or after.isalpha() or len(run) == 1 else None
                new = raw.decode("utf-8", "replace")
            elif applies(run, raw):
                parts: list = []
                for char, then in zip(run, run[1:] + after):
                    data = char.encode(encoding, "ignore")
                    parts += [lost_bytes(encoding, None if then == LOST else (then.encode(encoding, "ignore") or b" ")[0])] if char == LOST else list(data) if data else [char]
                key = (run, encoding, before, after)
                if key not in self.tried:
                    self.tried[key] = self._lattice(parts, "utf-8", (2, 3, 4), before, after)
                new = self.tried[key]
            else:
                return None
            return None if new.count(LOST) * 3 > max(len(new), 3) else new

        def alone(run: str, before: str, after: str) -> str | None:
            try:
                return run.encode(encoding).decode("utf-8")
            except UnicodeError:
                return None

        return self._pieces(text, _wide_runs, decode, _wide_runs, alone)

    def _legacy(self, text: str, encoding: str) -> tuple[float, str, int]:
        """Text of an older encoding read as cp1252 or Latin-1."""
        table = to_bytes("cp1252")

        def decode(run: str, before: str, after: str) -> str | None:
            if (data := self.latin.get(run)) is None:
                data = self.latin[run] = [_UNREAD if c == LOST else table.get(c, ord(c) if c < "\x80" else None) for c in run]
            if None in data:
                return None
            if LOST in run:
                if sum(map(_byte_letter, run.replace(LOST, ""))) < 2 * run.count(LOST) + 1:
                    return None
                parts = [chr(b) if b is not _UNREAD and b < 0x80 and (k == 0 or data[k - 1] is not _UNREAD and data[k - 1] < 0x80) else b for k, b in enumerate(data)]
                new = self._lattice([*parts], encoding, (1, 2) if encoding in MULTI_BYTE else (1,), before, after)
            else:
                new = bytes(data).decode(encoding, "replace")
            letters = sum(map(str.isalpha, new))
            return None if new.count(LOST) * 4 > len(new) or letters < 2 or not any(map(_byte_letter, run.replace(LOST, ""))) else new

        def alone(run: str, before: str, after: str) -> str | None:
            data = [table.get(c, -1) for c in run]
            return None if min(data) < 0 else bytes(data).decode(encoding, "ignore")

        if encoding in MULTI_BYTE:
            return self._pieces(text, _latin_words if encoding == "euc_kr" else _legacy_runs, decode)
        return self._pieces(text, _latin_words, decode, _high_run, alone)

    def _alphabet(self, script: str) -> list[str]:
        """Characters of the corpus that a lost byte can have stood for among letters of a script; of Latin those above ASCII, and its quotation marks and dashes."""
        if not self.alphabets:
            for char in self.model.counts:
                if char.isalpha() or unicodedata.category(char)[0] == "M":
                    if char >= "\x80":
                        self.alphabets.setdefault(_script(char), []).append(char)
                elif "\xa1" <= char < "\xc0" and char != "\xad" or "–" <= char <= "…":
                    self.alphabets.setdefault("LATIN", []).append(char)
                if _runs(char):
                    self.alphabets.setdefault("together", []).append(char)
        return self.alphabets.get(script, [])

    def _lost(self, text: str) -> tuple[str, int]:
        """Lost bytes in sound text: the known word that fits best, else the character that its neighbours ask for, else the mark stays."""
        passages = 0

        def words_cost(s: str) -> float:
            return sum(8.0 if w.isascii() else self.model.word_cost(w) for w in _words.findall(s))

        def fill(m: re.Match) -> str:
            nonlocal passages
            passages += 1
            word = m.group()
            before, after = text[m.start() - 1 : m.start()] or " ", text[m.end() : m.end() + 1] or " "
            letters = [c for c in (*word, before, after) if c != LOST and (c.isalpha() or _runs(c))]
            scripts = {_script(c) for c in letters if c.isalpha()}
            if self.model.words is None:
                return word
            if any(map(_runs, letters)):
                return self._between(word, before, after, self._alphabet("together"))
            if len(scripts) > 1 or not scripts and not (before.isspace() or after.isspace()):
                return word
            options = self._alphabet(scripts.pop() if scripts else "LATIN")
            key = (word, before, after)
            if key not in self.filled:
                if len(self.filled) > FLUSH:
                    self.filled.clear()
                scored = self._fillings(word, before, after, options)
                scored = heapq.nsmallest(2, [*scored, (words_cost(word) + self.model.cost(word, before, after), word)])
                self.filled[key] = scored[0][1] if len(scored) > 1 and scored[1][0] - scored[0][0] > SURE else word
            return self.filled[key]

        return _lost_words.sub(fill, text), passages

    def _fillings(self, word: str, before: str, after: str, options: list[str]) -> list[tuple[float, str]]:
        """(cost, text) of the two best ways of all to fill the lost letters of a word, the best first.

        A search by least cost: what a start has cost so far, the least that the characters behind
        it can cost with the words that they begin, and the least that its last word can cost by how
        frequent words with this start are. Of starts that go on alike, with the same last word or
        with one that no word of the corpus starts like, the two cheapest are enough.
        """
        if not options:
            return []
        model, pair = self.model, self.model.pair
        places = [options if c == LOST else [c] for c in word]
        unknown, ascii_least = model.times_cost(0), min(8.0, model.times_cost(0))
        none, live_ascii, live, dead_ascii, dead = range(5)  # what the last word is

        def least_of(status: int, n: int) -> float:
            """The least that a last word can cost."""
            return (0.0, min(8.0, model.times_cost(n)), model.times_cost(n), ascii_least, unknown)[status]

        def closed(status: int, n: int, last: str) -> float:
            """What the last word costs as it is."""
            return (0.0, 8.0, model.times_cost(min(n, model.wholes(last))) if status == live else 0.0, 8.0, unknown)[status]

        every = [*dict.fromkeys((*word, *options))]
        begun = dict(zip(every, model.goes_on(0, np.array([ord(c) for c in every], np.uint64))[1]))
        facts = {}  # class, cost, whether it begins a word, whether it goes on in one, the least of a word that it begins
        for c in every:
            letter = bool(_words.fullmatch(c))
            facts[c] = (char_class(c), model.char_cost(c), letter, letter or "\u0300" <= c <= "\u036f", least_of(live_ascii if c.isascii() else live, begun[c]) if letter else 0.0)
        ahead = [[[row[char_class(after)] for row in pair]] * 2]  # of each place, outside of words and inside, by the class before it
        for place in reversed(places):
            ways: list[dict[int, float]] = [{}, {}]
            for c in place:
                kind, own, letter, joins, start = facts[c]
                for inside, way in enumerate(ways):
                    x = own + (ahead[-1][1][kind] + (0.0 if inside else start) if (joins if inside else letter) else ahead[-1][0][kind])
                    way[kind] = min(x, way.get(kind, math.inf))
            ahead.append([[min(row[kind] + x for kind, x in way.items()) for row in pair] for way in ways])
        ahead.reverse()
        points = [np.array([ord(c) for c in place], np.uint64) for place in places]

        found: list[tuple[float, str]] = []
        best: dict[tuple, list[float]] = {}  # the two least costs of starts that go on alike
        queue, deep = [(0.0, 0, "", 0.0, char_class(before), none, 0, 0, 0)], []
        while queue or deep:
            least, at, start, cost, previous, status, begin, n, h = deep.pop() if deep else heapq.heappop(queue)
            second = found[1][0] if len(found) > 1 else math.inf
            if least >= second:
                continue
            at = -at  # of equal ones the longest is first
            ends = cost + closed(status, n, start[begin:])
            goes_on = model.goes_on(h if status in (live_ascii, live) else 0, points[at]) if status < dead_ascii else ([0] * len(places[at]),) * 2
            more = []
            for char, g, m in zip(places[at], *goes_on):
                kind, own, letter, joins, _ = facts[char]
                if joins if status else letter:
                    m = min(n, m) if status else m
                    plain = char.isascii() and status in (none, live_ascii, dead_ascii)
                    now = ((live_ascii if plain else live) if m else dead_ascii if plain else dead)
                    paid, where = cost, begin if status else at
                else:
                    now, paid, where = none, ends, 0
                paid += pair[previous][kind] + own
                longer = start + char
                if at + 1 == len(places):
                    total = round(paid + closed(now, m, longer[where:]) + ahead[-1][0][kind], 9)
                    found = sorted([*found, (total, longer)])[:2]
                    continue
                bound = round(paid + least_of(now, m) + ahead[at + 1][now > none][kind], 9)
                if bound >= second:
                    continue
                alike = best.setdefault((at, longer[where:]) if now in (live_ascii, live) else (at, now, kind), [])
                if len(alike) < 2 or paid < alike[1]:
                    alike[:] = sorted([*alike, paid])[:2]
                    more.append((bound, -at - 1, longer, paid, kind, now, where, m, g))
            if deep or len(queue) > DEEP:
                deep += sorted(more, reverse=True)
            else:
                for x in more:
                    heapq.heappush(queue, x)
            if len(best) > DEEP:
                best.clear()
        return found

    def _between(self, word: str, before: str, after: str, options: list[str]) -> str:
        """Lost characters where words run together: those that the characters on both sides ask for clearly; a mark can stand for none at all."""
        out = list(word)
        for k, char in enumerate(word):
            left, right = out[k - 1] if k else before, word[k + 1] if k + 1 < len(word) else after
            if char == LOST and _runs(left) and _runs(right):
                key = (left, right)
                if key not in self.between:
                    best = heapq.nsmallest(2, [(self.model.follow_cost(left, right), ""), *((self.model.follow_cost(left, c) + self.model.follow_cost(c, right), c) for c in options)])
                    self.between[key] = best[0][1] if len(best) > 1 and best[1][0] - best[0][0] > 2 * SURE else LOST
                out[k] = self.between[key]
        return "".join(out)

    def _rounds(self, text: str, utf8_first: bool) -> tuple[str, int]:
        total = 0
        while True:  # text can be decoded wrongly several times over; each round makes it cheaper
            best: tuple[float, str, int] = (0.0, text, 0)
            chars = set(text)
            for e in SINGLE_BYTE:
                if not utf8_leads(e).isdisjoint(chars) and utf8_runs(e).search(text):
                    best = max(best, self._single(text, e))
            if _wide.search(text) or _beside_latin.search(text):
                every = LOST in chars or _alone.search(text)
                for e in MULTI_BYTE:
                    if every or _utf8_bytes.search(text.encode(e, "replace")):  # without either no run is decoded
                        best = max(best, self._multi(text, e))
            if (best[0] <= CHANNEL_COST or not utf8_first) and _legacy_sign.search(text):
                for e in LEGACY:
                    best = max(best, self._legacy(text, e))
            if best[0] <= CHANNEL_COST:
                break
            total += best[2]
            text = best[1]
        return text, total

    def repair(self, text: str) -> tuple[str, int]:
        """(text with damaged passages restored as far as possible, number of passages that were damaged)."""
        if not may_be_garbled(text):
            return text, 0
        self.tried.clear()
        self.costs.clear()
        self.latin.clear()
        fixed, total = self._rounds(text, True)
        if total and _legacy_sign.search(text):
            # Bytes of an older encoding can look like UTF-8 in places: the likelier of both orders is taken.
            other, passages = self._rounds(text, False)
            if passages and other != fixed and self.model.cost(other) < self.model.cost(fixed):
                fixed, total = other, passages
        text = fixed
        if LOST in text:
            text, lost = self._lost(text)
            total += lost
        return text, total


@lru_cache(maxsize=1 << 16)
def _script(char: str) -> str:
    """The first word of the character's name, by which the database calls its script."""
    return unicodedata.name(char, "?").split(" ")[0].split("-")[0]


def _byte_letter(char: str) -> bool:
    """A character above 0x7F that is no quotation mark, dash or other common sign of running text."""
    return char >= "\x80" and char not in "‘’“”„‚–—…«»•·°©§\xa0¿¡"


_high_run = re.compile(f"[\x80-\xffŒœŠšŸŽžƒˆ˜–-›€™]+")
_lost_words = re.compile(f"[^\\W\\d_]*(?:{LOST}+[^\\W\\d_]*)+")
_high = "\x80-\xffŒœŠšŸŽžƒˆ˜–-›€™"
_latin_words = re.compile(f"[{_high}{LOST}]{{2,}}(?: ?[{_high}{LOST}]+)*")
_legacy_runs = re.compile(f"[{_high}{LOST}][{_high}{LOST}\x21-\x7e]*[{_high}{LOST}][\x40-\x7e]?")
_wide_runs = re.compile("[\x80-￿]*[⺀-￿][\x80-￿]*")


_decoders: dict[str, Decoder] = {}


class SharedDecoder:
    """A broadcast model; each worker process builds one decoder from it. Its size is bounded like the model's."""

    def __init__(self, spark, model: Model):
        self.broadcast = spark.sparkContext.broadcast(model)
        self.key = uuid4().hex  # told apart for ever, in whatever process it is used

    def get(self) -> Decoder:
        if self.key not in _decoders:
            _decoders.clear()
            _decoders[self.key] = Decoder(self.broadcast.value)
        return _decoders[self.key]


def share(texts: list[DataFrame], with_words: bool = True) -> SharedDecoder:
    return SharedDecoder(texts[0].sparkSession, train(texts, with_words))


def restore(records: list[tuple[str, DataFrame, str, str]], shared: SharedDecoder | None = None, damaged_only: bool = True) -> DataFrame:
    """(record_table, record_id, n_passages, text, restored) of the records with wrongly decoded passages.

    records: (name, table, id column, text column). The model is trained on the sound texts of all
    of them. Null and empty texts and pure ASCII give no row (or, with damaged_only=False, a row
    with 0 passages and the text as it is); repeated records are rows each; a lost byte that no
    known word fills stays U+FFFD. Narrow apart from the model's counts.
    """
    if shared is None:
        shared = share([df.select(column) for _, df, _, column in records])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repair = shared.get().repair
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keep = []
            for i, t in zip(ids, texts):
                new, n = (t, 0) if not t else repair(t)
                if n or not damaged_only:
                    keep.append((i, n, t, new))
            columns = list(zip(*keep)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.string())], ["record_id", "n_passages", "text", "restored"])

    out = None
    for name, df, id_col, column in records:
        rows = df.select(F.col(id_col).cast("long"), F.col(column))
        if damaged_only:
            rows = rows.where(F.col(column).rlike("[^\\x00-\\x7f]"))
        part = rows.mapInArrow(run, "record_id long, n_passages int, text string, restored string").select(F.lit(name).alias("record_table"), "*")
        out = part if out is None else out.unionByName(part)
    return out
