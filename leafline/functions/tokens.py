"""The tokenizer of lexical retrieval, as one Column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words without weight in questions.
STOPWORDS = "a an and are as at be by for from how i in is it of on or that the this to with".split()
LATIN = r"[a-z0-9]+(?:[-'][a-z0-9]+)?"
HAN_RUN = r"[\x{4e00}-\x{9fff}]+"


def _forms(t: Column) -> Column:
    """A Latin token, its non-empty parts, and its singular."""
    parts = F.filter(F.split(t, "[-']"), lambda p: p != "")
    singular = (
        F.when(t.endswith("ies") & (F.length(t) > 4), F.array(F.concat(F.substring(t, F.lit(1), F.length(t) - 3), F.lit("y"))))
        .when(t.endswith("s") & ~t.endswith("ss") & (F.length(t) > 3), F.array(F.substring(t, F.lit(1), F.length(t) - 1)))
        .otherwise(F.array().cast("array<string>"))
    )
    return F.concat(F.array(t), parts, singular)


def _grams(run: Column) -> Column:
    """Characters of a Han run, then its overlapping pairs."""
    chars = F.transform(F.sequence(F.lit(1), F.length(run)), lambda i: run.substr(i, F.lit(1)))
    pairs = F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: run.substr(i, F.lit(2)))
    return F.when(F.length(run) > 1, F.concat(chars, pairs)).otherwise(chars)


def tokenize(c: Column) -> Column:
    """Latin tokens first, then Han tokens, stop words dropped; plain words count twice, as themselves and as their only part."""
    low = F.lower(F.coalesce(c, F.lit("")))
    latin = F.flatten(F.transform(F.regexp_extract_all(low, F.lit(LATIN), F.lit(0)), _forms))
    han = F.flatten(F.transform(F.regexp_extract_all(low, F.lit(HAN_RUN), F.lit(0)), _grams))
    return F.filter(F.concat(latin, han), lambda t: ~t.isin(STOPWORDS) & (t != ""))
