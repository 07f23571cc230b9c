"""Problem 9: texts that a field limit or a broken transfer cut off.

A cut text is a strict prefix of something longer. Where its longer copy is in the corpus the value
itself shows that; where it is not, its last words are a strict prefix of longer word sequences, and
its last word is one of longer words. So the end of each unfinished text is looked up among all
strict prefixes of the corpus, at four reaches: the kind of its last word, the word, two words, and
the whole value. At each it is counted how often the prefix goes on and how often it stands at an
end. The shorter reaches smooth the longer ones, and the ratio of the two rates is the evidence.

What the evidence has to reach is not set by hand: the share of cut texts is estimated, by expectation
and maximisation over histograms of the evidence, for the corpus, for each source, and for each
length within a source, since cuts pile up at field limits. That gives the probability of a cut, whose
mean over the rows that are found is their expected share of right ones.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafline.session import cut

#: Weight of the shorter reach in the rate of the next longer one: kind of word, word, two words, whole value.
SMOOTHING = (20.0, 1.0, 2.0, 1.0)
#: Weight of a source's share of cuts in the share at one length.
LENGTH_SMOOTHING = 4.0
LOWEST, HIGHEST, BIN = -4.0, 8.0, 0.25  # evidence in nats, and the width of its bins
FLUSH = 200_000  # distinct contexts that a task holds before it writes its partial counts
REMEMBERED = 200_000  # word pairs whose keys a task remembers; emptied when full
SKETCH_WORDS = 1 << 18  # of 64 bits each: the sketch of the contexts asked for, which only saves work

# Marks set after a cut, sentence ends, and pairs of marks that have to be closed.
_mark = re.compile(r"\s*(?:\[\s*(?:\.\.\.|…)\s*\]|\((?:\.\.\.|…)\)|\.\.\.|…)$")
_strong_mark = re.compile(r"(?:\[\s*(?:\.\.\.|…)\s*\]|\((?:\.\.\.|…)\)|[^.]\.\.\.)$")
_pairs = {"(": ")", "（": "）", "«": "»", "„": "“”", "「": "」", "『": "』", "[": "]"}
STOPS = ".!?。！？।॥؟…"
CLOSING = "'\"”’»“」』)）]"
_edges = ".,;:!?…»”“„«)('\"’‘。！？؟।،؛[]–—-"
# What follows a whole sentence or title in a longer copy: a stop, a clause mark, a bracket, a new line.
_whole_before = re.compile(r"[ \t]*['\"”’»“」』)）\]]*(?:[.!?,;:](?!\w)|[。！？।॥؟…،؛、，；：\n(（]| ?[–—])")

LOST = "�"


_opening = re.compile("[" + "".join(map(re.escape, _pairs)) + "“]")
_unspaced = re.compile("[\u0e00-\u0e7f\u3040-\u9fff]")


def _open(text: str) -> bool:
    """Whether a bracket or quotation is left open."""
    if not _opening.search(text):
        return False
    stack: list[str] = []
    for char in text:
        if stack and char in stack[-1]:
            stack.pop()
        elif char in _pairs:
            stack.append(_pairs[char])
        elif char == "“":
            stack.append("”")
    return bool(stack)


def _strip(text: str) -> str:
    """The text without blanks and pictographs at its end."""
    end = len(text)
    while end and (text[end - 1].isspace() or unicodedata.category(text[end - 1]) in ("So", "Sk", "Cf", "Cc", "Zs") and text[end - 1] != LOST):
        end -= 1
    return text[:end]


def _runs_together(text: str) -> bool:
    """Scripts without blanks between words."""
    return not text.isascii() and len(_unspaced.findall(text)) * 2 > len(text)


def value_of(text: str) -> str:
    """The text as it is compared: single blanks and line ends, none and no pictographs at its end."""
    text = _strip(text)
    return "\n".join(filter(None, (" ".join(line.split()) for line in text.split("\n")))) if "\n" in text else " ".join(text.split())


def finish_of(value: str) -> tuple[str, int, bool, bool]:
    """(value without a mark of a cut, 0 no mark, 1 an ellipsis, 2 a plain mark of a cut; ends as a sentence; has a bracket or quotation open)."""
    base = _mark.sub("", value)
    mark = 2 if _strong_mark.search(value) else 1 if base != value else 0
    opened = _open(base)
    return base, mark, base.rstrip(CLOSING)[-1:] in tuple(STOPS) and mark < 2 and not opened, opened


# ------------------------------------------------------------------ contexts


def _hash(data: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(data.encode("utf-8", "surrogatepass")) - (1 << 63)


def key(reach: int, before: str, last: str, trailing: str = "") -> int:
    """Name of a context; the last word comes last, so that the names of its prefixes are found in one pass over it."""
    return _hash(f"{reach}\x1f{trailing}\x1f{before}\x1f{last}")


def _kind(word: str) -> str:
    """What sort of word: with digits, capitalised, small, without case."""
    return "-" if not word else "#" if any(map(str.isdigit, word)) else "X" if word[0].isupper() else "x" if word[0].islower() else "o"


def _parts(token: str) -> tuple[str, str]:
    """(word, marks after it)."""
    bare = token.rstrip(_edges)
    return bare.lstrip(_edges), token[len(bare) :]


def end_keys(base: str) -> tuple[int, int, int]:
    """Contexts of the end of an unfinished text, from the shortest reach to the longest."""
    if _runs_together(base):
        run = "".join(base.split())
        return tuple(key(r, "", run[-n:], "c") for r, n in enumerate((1, 2, 4)))
    tokens = base.rsplit(None, 2)
    word, trailing = _parts(tokens[-1])
    before = "^" if len(tokens) < 2 else "".join((p := _parts(tokens[-2]))[0] + p[1][:1])
    return key(0, before, _kind(word), trailing[:1]), key(1, "", word, trailing[:1]), key(2, before, word, trailing[:1])


class Counter:
    """How often the contexts asked for go on, stand before a stop within a text, before its last stop, and at an unfinished end.

    A position in the middle of a word counts as one after which its prefix goes on.
    """

    ON, STOP, FINAL, END = range(4)

    def __init__(self, asked: np.ndarray):
        self.asked, self.bits = asked.astype("<u8").tobytes(), len(asked) * 64
        self.counts: dict[int, list[int]] = {}
        self.totals = [0, 0, 0, 0]
        self.known: dict[tuple, tuple] = {}

    def wanted(self, name: int) -> int:
        cell = name % self.bits
        return self.asked[cell >> 3] >> (cell & 7) & 1

    def _remember(self, of: tuple, found: tuple) -> tuple:
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        self.known[of] = found
        return found

    def _add(self, what: int, names: tuple, n: int = 1) -> None:
        self.totals[what] += n
        for name in names:
            counts = self.counts.get(name)
            if counts is None:
                counts = self.counts[name] = [0, 0, 0, 0]
            counts[what] += n

    def _word(self, before: str, word: str) -> tuple[tuple, tuple, tuple]:
        """Wanted names of (the word after the one before, its kind there, its strict prefixes)."""
        import xxhash

        found = self.known.get((before, word))
        if found is None:
            names = tuple(n for n in (key(0, before, _kind(word)), key(1, "", word), key(2, before, word)) if self.wanted(n))
            kind = tuple(n for n in (key(0, before, _kind(word)),) if self.wanted(n))
            prefixes: list[int] = []
            state = xxhash.xxh64(b"1\x1f\x1f\x1f")
            for k, char in enumerate(word[:-1], 1):
                state.update(char.encode("utf-8", "surrogatepass"))
                if self.wanted(name := state.intdigest() - (1 << 63)):
                    prefixes.append(name)
                    if self.wanted(pair := key(2, before, word[:k])):
                        prefixes.append(pair)
            found = names, kind, tuple(prefixes)
            if len(word) <= 40:
                self._remember((before, word), found)
        return found

    def add(self, value: str, finish: tuple | None = None) -> None:
        base, mark, finished, _ = finish or finish_of(value)
        if _runs_together(base):
            self._characters("".join(base.split()))
            return
        tokens, before = base.split(), "^"
        last = len(tokens) - 1
        for k, token in enumerate(tokens):
            word, trailing = _parts(token)
            names, kind, prefixes = self._word(before, word)
            if len(word) > 1:
                self._add(self.ON, kind, len(word) - 1)
            for name in prefixes:
                self.counts.setdefault(name, [0, 0, 0, 0])[0] += 1
            stop = any(c in STOPS for c in trailing)
            if k < last:
                self._add(self.STOP if stop else self.ON, names)
                if trailing:
                    self._add(self.ON, self._marked(before, word, trailing))
            elif finished or stop and mark < 2:
                self._add(self.FINAL, names)
            else:
                if trailing:
                    self._add(self.ON, names)
                self._add(self.END, self._marked(before, word, trailing))
            before = word + trailing[:1]

    def _marked(self, before: str, word: str, trailing: str) -> tuple:
        """Wanted names of a word with the mark after it."""
        mark = trailing[:1]
        found = self.known.get((before, word, mark))
        if found is None:
            found = self._remember((before, word, mark), tuple(n for n in (key(0, before, _kind(word), mark), key(1, "", word, mark), key(2, before, word, mark)) if self.wanted(n)))
        return found

    def _characters(self, run: str) -> None:
        n = len(run)
        for k in range(1, n + 1):
            if run[k - 1] in STOPS:
                continue
            end = run[max(0, k - 4) : k]
            names = self.known.get((end,))
            if names is None:
                names = self._remember((end,), tuple(x for x in (key(r, "", end[-m:], "c") for r, m in enumerate((1, 2, 4))) if self.wanted(x)))
            if k == n:
                self._add(self.END, names)
            elif run[k] in STOPS:
                self._add(self.STOP if run[k:].strip(STOPS + CLOSING) else self.FINAL, names)
            else:
                self._add(self.ON, names)


def what_follows(text: str, longer: str) -> int:
    """How a longer value goes on after its prefix: 0 with a new word or in the middle of one, 1 with what can follow a whole sentence or title."""
    return int(_whole_before.match(longer, len(text)) is not None)


_COUNTS = "kind int, name long, n_on long, n_stop long, n_final long, n_end long, part int, text string"
PREFIX, TOTALS, VALUE, FIRST, LAST, CARRIED = range(6)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * 8
    kinds = (pa.int32(), *[pa.int64()] * 5, pa.int32(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["kind", "name", "n_on", "n_stop", "n_final", "n_end", "part", "text"])


def prefix_counts(values: DataFrame, asked) -> DataFrame:
    """(kind, name, n_on, n_stop, n_final, n_end): counts of the contexts asked for (kind 0), of all positions (1) and of values that are strict prefixes of longer ones (2).

    values: one column of the values whose ends are looked up and of all others. Each distinct value
    counts once. Among sorted values the longer copies of a value follow it directly, so a stack of
    the unfinished values that are still open finds them all. Values are range-partitioned; those
    open at the end of a partition meet the others in a second pass, if the next partition starts
    with a copy of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        counter = Counter(asked.value)
        rows: list[tuple] = []
        first = last = None
        stack: list[list] = []  # [value, n_on, n_stop]
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if first is None:
                    first = t
                while stack and not t.startswith(stack[-1][0]):
                    v, on, stop = stack.pop()
                    if on or stop:
                        rows.append((VALUE, key(3, "", v), on, stop, 0, 0, part, None))
                for entry in stack:
                    entry[1 + what_follows(entry[0], t)] += 1
                finish = finish_of(t)
                if not finish[2]:
                    stack.append([t, 0, 0])
                counter.add(t, finish)
                last = t
            if len(rows) + len(counter.counts) > FLUSH:
                rows += [(PREFIX, name, *n, part, None) for name, n in counter.counts.items()]
                counter.counts = {}
                yield _batch(rows)
                rows = []
        rows += [(PREFIX, name, *n, part, None) for name, n in counter.counts.items()]
        rows.append((TOTALS, 0, *counter.totals, part, None))
        if first is not None:
            rows += [(FIRST, 0, 0, 0, 0, 0, part, first), (LAST, 0, 0, 0, 0, 0, part, last)]
            rows += [(CARRIED, 0, on, stop, 0, 0, part, v) for v, on, stop in stack]
        yield _batch(rows)

    sums = [F.sum(c).alias(c) for c in ("n_on", "n_stop", "n_final", "n_end")]
    found = cut(values.distinct().repartitionByRange("value").sortWithinPartitions("value").mapInArrow(run, _COUNTS).groupBy("kind", "name", F.when(F.col("kind") >= FIRST, F.col("part")).alias("part"), "text").agg(*sums))
    ends = found.where(F.col("kind").isin(FIRST, LAST)).groupBy("part").agg(F.max(F.when(F.col("kind") == FIRST, F.col("text"))).alias("first"), F.max(F.when(F.col("kind") == LAST, F.col("text"))).alias("last"))
    ends = ends.withColumn("following", F.lead("first").over(Window.orderBy("part")))  # one row per partition
    across = found.where(F.col("kind") == CARRIED).join(ends, "part")
    carried = [(r.text, r.last) for r in across.where(F.col("following").startswith(F.col("text"))).select("text", "last").collect()]  # as many as values are nested, per partition
    names = F.udf(lambda t: key(3, "", t), "long")
    counts = found.where(F.col("kind") <= VALUE).select("kind", "name", "n_on", "n_stop", "n_final", "n_end").unionByName(found.where((F.col("kind") == CARRIED) & (F.col("n_on") + F.col("n_stop") > 0)).select(F.lit(VALUE).alias("kind"), names("text").alias("name"), "n_on", "n_stop", "n_final", "n_end"))
    if not carried:
        return counts

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(t, v, what_follows(t, v)) for v in batch.column(0).to_pylist() for t, last in carried if v > last and v.startswith(t)]
            columns = list(zip(*pairs)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int32()))], ["text", "longer", "follows"])

    met = values.mapInArrow(meet, "text string, longer string, follows int").distinct().groupBy("text").agg(F.count_if(F.col("follows") == 0).alias("n_on"), F.count_if(F.col("follows") == 1).alias("n_stop"))
    zero = F.lit(0).cast("long")
    return counts.unionByName(met.select(F.lit(VALUE).alias("kind"), names("text").alias("name"), "n_on", "n_stop", zero.alias("n_final"), zero.alias("n_end")))


def _sketch(spark: SparkSession, names: DataFrame):
    """A broadcast set of bits, of a fixed size, with one set for each name; a name that is not asked for can pass, no other is lost."""
    cell = F.pmod(F.col("name"), F.lit(SKETCH_WORDS * 64))
    words = names.groupBy(F.shiftright(cell, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(name, {SKETCH_WORDS * 64}) & 63 as int))")).alias("bits")).toPandas()
    bits = np.zeros(SKETCH_WORDS, np.uint64)
    bits[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    return spark.sparkContext.broadcast(bits)


# ------------------------------------------------------------------ shares of cut texts


def share_of_cuts(evidence: np.ndarray, counts: np.ndarray, prior: float, weight: float) -> float:
    """The share of cut texts that makes a histogram of evidence likeliest, with the prior share at a weight."""
    ratio, share, n = np.exp(evidence), prior, counts.sum()
    for _ in range(100):
        odds = ratio * share / max(1 - share, 1e-9)
        new = (float((counts * odds / (1 + odds)).sum()) + weight * prior) / (n + weight)
        if abs(new - share) < 1e-6:
            break
        share = new
    return share


def _corpus_shares(histogram: list) -> tuple[dict[int, float], dict[bool, float]]:
    """From (mark, opened, bin, n) of all texts: the share of cut ones for each mark, and the nats of an open or closed end."""
    shares, opened_nats = {0: 0.3, 1: 0.3, 2: 0.9}, {False: 0.0, True: 0.0}
    rows = [(r["mark"], r["opened"], LOWEST + r["bin"] * BIN, r["n"]) for r in histogram]
    for _ in range(50):
        split = []
        for mark, opened, x, n in rows:
            odds = np.exp(x + opened_nats[opened]) * shares[mark] / (1 - shares[mark])
            split.append((mark, opened, n * odds / (1 + odds), n))
        for mark in shares:
            n = sum(r[3] for r in split if r[0] == mark)
            start = {0: 0.3, 1: 0.3, 2: 0.9}[mark]
            shares[mark] = min(max((sum(r[2] for r in split if r[0] == mark) + start) / (n + 1), 1e-4), 1 - 1e-4)
        cuts, wholes = sum(r[2] for r in split), sum(r[3] - r[2] for r in split)
        for opened in (False, True):
            c, w = sum(r[2] for r in split if r[1] == opened), sum(r[3] - r[2] for r in split if r[1] == opened)
            opened_nats[opened] = float(np.log((c + 0.5) / (cuts + 1)) - np.log((w + 0.5) / (wholes + 1)))
    return shares, opened_nats


def _group_shares(groups: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_cut, n) of groups (keys, prior, weight, histogram of (bin, n))."""
    kinds = {f.name: f.dataType.simpleString() for f in groups.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            n_cut, n_all = [], []
            for histogram, prior in zip(batch.column(names.index("histogram")).to_pylist(), batch.column(names.index("prior")).to_pylist()):
                x, n = (np.array([h[c] for h in histogram], float) for c in ("bin", "n"))
                n_all.append(int(n.sum()))
                n_cut.append(share_of_cuts(LOWEST + x * BIN, n, prior, LENGTH_SMOOTHING) * (n.sum() + LENGTH_SMOOTHING) - LENGTH_SMOOTHING * prior)
            yield pa.RecordBatch.from_arrays([*[batch.column(names.index(k)) for k in keys], pa.array(n_cut, pa.float64()), pa.array(n_all, pa.int64())], [*keys, "n_cut", "n"])

    return groups.mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", n_cut double, n long")


_ENDS = "n int, n_bytes int, value string, mark int, finished boolean, opened boolean, lost boolean, k0 long, k1 long, k2 long, k3 long"


def _ends(batches: Iterator[pa.RecordBatch], id_col: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns: list[list] = [[] for _ in range(11)]
        for text in batch.column(2).to_pylist():
            value = value_of(text)
            base, mark, finished, opened = finish_of(value)
            names = (None,) * 4 if finished or not base else (*end_keys(base), None if mark else key(3, "", value))
            kept = text.rstrip()
            for column, x in zip(columns, (len(kept), len(kept.encode("utf-8", "replace")), value, mark, finished or not base, opened, base.endswith(LOST), *names)):
                column.append(x)
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.bool_(), pa.bool_(), pa.bool_(), *[pa.int64()] * 4)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, k) for c, k in zip(columns, kinds)]], [id_col, "source", *[f.split()[0] for f in _ENDS.split(", ")]])


def _evidence(rows: DataFrame, counts: DataFrame, totals: list[int]) -> DataFrame:
    """(k0, k1, k2, k3, evidence, n_longer, n_whole) of the distinct unfinished ends."""
    on, stop, final, end = (float(x) for x in totals)
    ends = max(stop + final + end, 1.0)
    base, last = ends / max(on + ends, 1.0), max(final, 1.0) / max(final + stop, 1.0)
    names = ("k0", "k1", "k2", "k3")
    keyed = rows.select(*names).distinct().withColumn("end", F.xxhash64(*names))
    asked = keyed.select("end", F.explode(F.array(*[F.struct(F.lit(r).alias("reach"), F.col(k).alias("name")) for r, k in enumerate(names)])).alias("x")).select("end", "x.reach", "x.name").where("name is not null")
    met = asked.join(counts, "name", "left").na.fill(0, ["n_on", "n_stop", "n_final", "n_end"])
    # A stop ends a sentence only as often as the word before it also ends texts; else it belongs to the word.
    stops = F.col("n_stop") + F.col("n_final")
    true_stop = F.least(F.lit(1.0), (F.col("n_final") + last) / (stops + 1) / last)
    goes = F.when(F.col("reach") == 3, F.col("n_on")).otherwise(F.col("n_on") + (1 - true_stop) * stops)
    is_end = F.when(F.col("reach") == 3, F.col("n_stop")).otherwise(F.greatest(F.col("n_end") - 1, F.lit(0)) + true_stop * stops)
    counted = met.select("end", "reach", goes.alias("goes"), is_end.alias("ends"))
    pivot = counted.groupBy("end").agg(*[F.max(F.when(F.col("reach") == r, F.struct("goes", "ends"))).alias(f"r{r}") for r in range(4)])
    rate: Column = F.lit(base)
    for r, weight in enumerate(SMOOTHING):
        g, e = F.coalesce(F.col(f"r{r}.goes"), F.lit(0.0)), F.coalesce(F.col(f"r{r}.ends"), F.lit(0.0))
        if r == 3:  # all longer copies weigh as one: titles and usual openings have many
            g, e = g / F.greatest(g + e, F.lit(1.0)), e / F.greatest(g + e, F.lit(1.0))
        rate = (e + weight * rate) / (g + e + weight)
    # Rate of this context among all positions against its rate among ends.
    evidence = F.least(F.greatest(F.log(F.lit(base)) - F.log(rate), F.lit(LOWEST)), F.lit(HIGHEST))
    scored = pivot.select("end", evidence.alias("evidence"), F.coalesce("r3.goes", F.lit(0.0)).cast("long").alias("n_longer"), F.coalesce("r3.ends", F.lit(0.0)).cast("long").alias("n_whole"))
    return scored


def truncated(documents: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, source, evidence, n_longer, n_whole, probability, is_cut) of every document with a text.

    evidence: nats by which the end of the text is likelier among all strict prefixes than among
    ends; n_longer and n_whole: longer copies that go on where it ends, and such that close the
    sentence there. Texts that end as sentences have probability 0 and no evidence. A text that
    ends within a character is cut for sure. Null, empty and blank texts have no row; repeated
    records are judged each; a null source is a source. Every count covers the whole corpus and is
    combined before the shuffle; no value is compared with all others.
    """
    spark = documents.sparkSession
    texts = documents.where(F.col("text").rlike("\\S")).select(id_col, F.coalesce("source", F.lit("")).alias("source"), "text", F.col("source").isNull().alias("nameless"))
    kind = documents.schema[id_col].dataType.simpleString()
    rows = cut(texts.select(id_col, F.when(F.col("nameless"), F.lit(None)).otherwise(F.col("source")).alias("source"), "text").mapInArrow(lambda b: _ends(b, id_col), f"`{id_col}` {kind}, source string, {_ENDS}"))
    unfinished = rows.where("not finished")
    asked = _sketch(spark, unfinished.select(F.explode(F.array("k0", "k1", "k2")).alias("name")))
    counts = cut(prefix_counts(rows.select("value"), asked).groupBy("kind", "name").agg(*[F.sum(c).alias(c) for c in ("n_on", "n_stop", "n_final", "n_end")]))
    totals = [int(x or 0) for x in counts.where(F.col("kind") == TOTALS).agg(*[F.sum(c) for c in ("n_on", "n_stop", "n_final", "n_end")]).first()]
    evidence = _evidence(unfinished, counts.where(F.col("kind") != TOTALS).drop("kind"), totals)

    names = ("k0", "k1", "k2", "k3")
    ends = unfinished.select(id_col, "source", "n", "n_bytes", "mark", "opened", "lost", F.xxhash64(*names).alias("end"))
    scored = cut(ends.join(evidence, "end").drop("end"))
    bins = int((HIGHEST - LOWEST) / BIN)
    place = lambda x: F.least(F.greatest(F.round((x - LOWEST) / BIN), F.lit(0)), F.lit(bins)).cast("int")
    shares, nats = _corpus_shares(scored.where("not lost").groupBy("mark", "opened", place(F.col("evidence")).alias("bin")).agg(F.count("*").alias("n")).collect())
    scored = scored.withColumn("evidence", F.col("evidence") + F.when(F.col("opened"), nats[True]).otherwise(nats[False])).withColumn("of", F.coalesce("source", F.lit("")))
    corpus = F.element_at(F.create_map(*[x for m, s in shares.items() for x in (F.lit(m), F.lit(s))]), F.col("mark"))

    # Histograms by source and mark, and by length in characters and bytes within them.
    lengths = F.explode(F.array(*[F.struct(F.lit(u).alias("unit"), F.col(c).alias("length")) for u, c in enumerate(("n", "n_bytes"))]))
    cells = scored.where("not lost").select("of", "mark", place(F.col("evidence")).alias("bin"), lengths.alias("l")).groupBy("of", "mark", "l.unit", "l.length", "bin").agg(F.count("*").alias("n"))
    histogram = F.collect_list(F.struct("bin", "n")).alias("histogram")  # one entry per bin
    sources = _group_shares(cells.where("unit = 0").groupBy("of", "mark", "bin").agg(F.sum("n").alias("n")).groupBy("of", "mark").agg(histogram).withColumn("prior", corpus), ["of", "mark"])
    clip = lambda x: F.least(F.greatest(x, F.lit(1e-4)), F.lit(1 - 1e-4))
    by_source = cut(sources.withColumn("prior", clip((F.col("n_cut") + LENGTH_SMOOTHING * corpus) / (F.col("n") + LENGTH_SMOOTHING))))
    by_length = cut(_group_shares(cells.groupBy("of", "mark", "unit", "length").agg(histogram).join(by_source.select("of", "mark", "prior"), ["of", "mark"]), ["of", "mark", "unit", "length"]))

    def odds(share: Column) -> Column:
        return F.log(clip(share) / (1 - clip(share)))

    placed = scored.join(by_source.select("of", "mark", "prior"), ["of", "mark"], "left").withColumn("prior", F.coalesce("prior", corpus))
    own = 1 / (1 + F.exp(-(F.col("evidence") + odds(F.col("prior")))))
    placed = placed.withColumn("own", own)
    for unit, c in enumerate(("n", "n_bytes")):
        there = by_length.where(F.col("unit") == unit).select("of", "mark", F.col("length").alias(c), F.col("n_cut").alias(f"{c}_cut"), F.col("n").alias(f"{c}_all"))
        placed = placed.join(there, ["of", "mark", c], "left")
        # The row's own part is taken out of what is expected of it.
        others = (F.greatest(F.col(f"{c}_cut") - F.col("own"), F.lit(0.0)) + LENGTH_SMOOTHING * F.col("prior")) / (F.col(f"{c}_all") - 1 + LENGTH_SMOOTHING)
        placed = placed.withColumn(f"{c}_odds", F.coalesce(odds(others), odds(F.col("prior"))))
    probability = F.when(F.col("lost"), 1.0).otherwise(1 / (1 + F.exp(-(F.col("evidence") + F.greatest("n_odds", "n_bytes_odds")))))
    judged = placed.select(id_col, "source", "evidence", "n_longer", "n_whole", probability.alias("probability"))
    none = F.lit(0).cast("long")
    whole = rows.where("finished").select(id_col, "source", F.lit(None).cast("double").alias("evidence"), none.alias("n_longer"), none.alias("n_whole"), F.lit(0.0).alias("probability"))
    return judged.unionByName(whole).withColumn("is_cut", F.col("probability") > 0.5)


def cut_shares(judged: DataFrame) -> DataFrame:
    """(source, n_texts, n_cut, cut_share, expected_share) per source; expected_share sums the probabilities."""
    return judged.groupBy("source").agg(F.count("*").alias("n_texts"), F.count_if("is_cut").alias("n_cut"), F.avg("probability").alias("expected_share")).withColumn("cut_share", F.col("n_cut") / F.col("n_texts")).select("source", "n_texts", "n_cut", "cut_share", "expected_share")
