"""Languages, their aliases, extensions and dialects."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
LANGUAGES = ("go", "java", "javascript", "python", "rust", "tsx", "typescript")
ALIASES = {"py": "python", "python3": "python", "js": "javascript", "jsx": "javascript", "node": "javascript", "ts": "typescript", "golang": "go", "rs": "rust"}
EXTENSIONS = {".py": "python", ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".jsx": "javascript", ".ts": "typescript", ".mts": "typescript", ".tsx": "tsx", ".go": "go", ".java": "java", ".rs": "rust"}
DIALECT_BASE = {"tsx": "typescript"}


def _lookup(key: Column, table: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[key]


def known_language(name: Column) -> Column:
    """[P1] The language that a name or alias stands for, whatever its case and the white space around it; null for others."""
    key = F.lower(F.regexp_replace(name, r"^\s+|\s+$", ""))
    key = F.coalesce(_lookup(key, ALIASES), key)
    return F.when(key.isin(*LANGUAGES), key)


def normalize_language(name: Column) -> Column:
    """[P1] known_language, with an error for a name that stands for none."""
    wrong = F.raise_error(F.concat(F.lit("no such language: "), name, F.lit(f" (known are {', '.join(LANGUAGES)})")))
    return F.when(name.isNull(), name).otherwise(F.coalesce(known_language(name), wrong.cast("string")))


def language_of_path(path: Column) -> Column:
    """[I4] By the extension in lower case; null for others."""
    return _lookup(F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)), EXTENSIONS)


def rule_languages(language: Column) -> Column:
    """[P6] The language and, of a dialect, its base."""
    base = _lookup(language, DIALECT_BASE)
    return F.when(base.isNull(), F.array(language)).otherwise(F.array(language, base))
