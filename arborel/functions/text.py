"""Text as columns: tokens, searchable text of an entry, fenced code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token boundaries and the ranking constants.
TOKEN, CAMEL = r"[A-Z]+(?=[A-Z][a-z])|[A-Z]*[a-z0-9]+|[A-Z]+", r"[a-z0-9][A-Z]|[A-Z][A-Z][a-z]"
SHORTEST_TOKEN = 2
WORD = rf"[a-zA-Z0-9]{{{SHORTEST_TOKEN},}}"
K1, B = 1.5, 0.75
FENCE = r"(?s)```[^\n]*\n(.*?)```"


def tokenize(text: Column) -> Column:
    """[T1] Lower-cased runs of letters and digits, split where camel case changes; tokens of one character go.

    Tokens are matched, which takes a fifth of what splitting at all that lies between them does; only texts with such a
    change have theirs told apart by case.
    """
    text = F.coalesce(text, F.lit(""))
    found = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.when(text.rlike(CAMEL), F.filter(found(TOKEN), lambda t: F.length(t) >= SHORTEST_TOKEN)).otherwise(found(WORD))
    return F.transform(parts, F.lower)


def flatten_metadata(meta: Column) -> Column:
    """[T2] Keys in order, each followed by its values, joined by spaces; of map<string, array<string>>."""
    words = F.flatten(F.transform(F.array_sort(F.map_keys(meta)), lambda k: F.concat(F.array(k), F.element_at(meta, k))))
    return F.array_join(words, " ")


def document_text(*parts: Column) -> Column:
    """[T3] The parts that are not empty, one below the other."""
    return F.concat_ws("\n", *(F.nullif(p, F.lit("")) for p in parts))


def idf(n: Column, df: Column) -> Column:
    """[T7] 0 for a term that no document holds."""
    return F.when(df > 0, F.log(1 + (n - df + 0.5) / (df + 0.5))).otherwise(0.0)


def bm25_term(tf: Column, dl: Column, avgdl: Column, weight: Column) -> Column:
    """[T8] One term's part of a document's score."""
    return weight * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def extract_code_block(text: Column) -> Column:
    """[T12] The first fenced block with one line feed at its end; null without a fence."""
    body = F.regexp_replace(F.regexp_extract(text, FENCE, 1), r"\n+\z", "")
    return F.when(text.rlike(FENCE), F.concat(body, F.lit("\n")))
