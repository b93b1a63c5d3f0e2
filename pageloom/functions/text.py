"""Small string helpers shared by the URL and page functions."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space, for trim() and as a regex class.
BLANKS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                           0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_BLANK = "".join(rf"\x{{{ord(c):x}}}" for c in BLANKS)


def strip(text: Column) -> Column:
    """Remove Unicode white space from both ends (plain ``trim`` only knows the blank)."""
    return F.trim(text, F.lit(BLANKS))


def is_blank(text: Column) -> Column:
    return ~text.rlike(f"[^{_BLANK}]")


def starts_with_any(text: Column, prefixes: Iterable[str]) -> Column:
    """Does the stripped text start with one of the prefixes?"""
    choices = "|".join(re.escape(p) for p in prefixes)
    return text.rlike(rf"\A[{_BLANK}]*(?:{choices})") if choices else F.lit(False)


def contains_any(text: Column, words: Iterable[str]) -> Column:
    test = F.lit(False)
    for word in words:
        test = test | text.contains(word)
    return test


def alternation(patterns: Iterable[str]) -> str:
    """One unanchored regex for patterns that mean "contains X" (``.*X.*``).

    Patterns with the same plain first character share it: where the text has another
    character, one comparison then rejects them all.
    """
    by_first: dict[str, list[str]] = {}
    for pattern in patterns:
        core = re.sub(r"^\.\*|\.\*$", "", pattern)
        plain = re.match(r"[/\-A-Za-z0-9](?![*+?{])", core)
        by_first.setdefault(core[:1] if plain and "|" not in re.sub(r"\([^()]*\)", "", core) else "", []).append(core)
    choices = [
        f"{first}(?:{'|'.join(core[len(first):] for core in cores)})" if first else "|".join(cores)
        for first, cores in by_first.items()
    ]
    return "(?:" + "|".join(choices) + ")" if choices else r"[^\s\S]"


def has_token(words: Column, token: str) -> Column:
    """Is ``token`` one of the blank-separated words? Null counts as no words."""
    return F.coalesce(F.concat(F.lit(" "), words, F.lit(" ")).contains(f" {token} "), F.lit(False))


def has_any_token(words: Column, tokens: Iterable[str]) -> Column:
    padded = F.concat(F.lit(" "), words, F.lit(" "))
    return F.coalesce(contains_any(padded, [f" {t} " for t in tokens]), F.lit(False))


def escape_text(text: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def quote_attribute(value: Column) -> Column:
    """Escape and quote; single quotes only when the value holds double quotes alone."""
    escaped = escape_text(value)
    double, single = F.lit('"'), F.lit("'")
    return (
        F.when(~escaped.contains('"'), F.concat(double, escaped, double))
        .when(~escaped.contains("'"), F.concat(single, escaped, single))
        .otherwise(F.concat(double, F.replace(escaped, double, F.lit("&quot;")), double))
    )
