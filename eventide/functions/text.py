"""Tokens, stop words and proper-name candidates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventide.functions.times import WS, strip

# The words the lexical counters leave out.
STOPWORDS = (
    "the", "a", "an", "and", "or", "but", "if", "in", "on", "at", "of", "for",
    "to", "from", "by", "with", "is", "am", "are", "was", "were", "be", "been",
    "it", "this", "that", "these", "those", "you", "i", "we", "they", "he",
    "she", "them", "him", "her", "as", "so", "not", "no", "yes", "uh", "um",
)

# Separator between tokens; same meaning in Java and in RE2.
TOKEN_SEPARATOR = r"[^\p{L}\p{N}_']+"


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, TOKEN_SEPARATOR), lambda t: t != "")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, f"{WS}+"), lambda w: w != ""))


def is_stop(token: Column) -> Column:
    return F.lower(token).isin(*STOPWORDS)


def is_name(token: Column) -> Column:
    """Starts upper-case and has a cased letter that is not: ``Anna`` but not ``ANNA`` or ``I``."""
    return token.rlike(r"^\p{Lu}") & (F.upper(token) != token)
