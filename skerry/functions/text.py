"""Bilingual text: normalising, tokens, aliases and matching."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Arabic letters folded into one form for search, and the stretching mark that is dropped.
FOLD_FROM = "أإآةىئؤ"
FOLD_TO = "اااهييو"
KASHIDA = "ـ"


@F.pandas_udf(StringType())
def compose(text: pd.Series) -> pd.Series:
    """Unicode NFC, which Spark has no function for."""
    return text.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def _fold(text: Column) -> Column:
    folded = F.translate(F.replace(text, F.lit(KASHIDA), F.lit("")), FOLD_FROM, FOLD_TO)
    return F.trim(F.regexp_replace(F.lower(folded), r"(?U)\s+", " "))


def normalise(text: Column, composed: bool = False) -> Column:
    """Search form of a text. composed: the text is known to be in NFC, so everything stays in the JVM."""
    return _fold(text if composed else compose(text))


def tokens(normalised: Column) -> Column:
    return F.regexp_extract_all(normalised, F.lit(r"(?U)[\w؀-ۿ]+"), F.lit(0))


def aliases(english: Column, arabic: Column, extra: Column, composed: bool = False) -> Column:
    """struct of labels, their search forms, and the sorted distinct tokens of labels and extra terms (an array)."""
    labels = F.filter(F.array(english, arabic), lambda x: x.isNotNull())
    terms = F.concat(labels, F.coalesce(extra, F.array().cast("array<string>")))
    joined = F.array_join(terms, " ")
    return F.struct(
        F.transform(labels, lambda x: _fold(x)).alias("normalised"),
        F.array_sort(F.array_distinct(tokens(normalise(joined, composed)))).alias("combined"),
    )


def matches(query: str, alias: Column) -> Column:
    """Whether a query is part of a label's search form or shares a token; an empty query matches all."""
    if not query:
        return F.lit(True)
    q = normalise(F.lit(unicodedata.normalize("NFC", query)), composed=True)
    return F.exists(alias["normalised"], lambda x: F.contains(x, q)) | F.arrays_overlap(alias["combined"], tokens(q))


def label(labels: Column, locale: str) -> Column:
    """The label of a map for a locale, else the English one."""
    return F.coalesce(F.try_element_at(labels, F.lit(locale)), F.try_element_at(labels, F.lit("en")))


def contains_folded(text: Column, part: str) -> Column:
    """Case-insensitive substring test."""
    return F.contains(F.lower(text), F.lit(part.lower()))
