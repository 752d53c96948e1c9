"""Groups of near-identical short texts, however far apart.

Texts are sets of words.  Two sets are near if their Jaccard similarity reaches a threshold.  MinHash bands find the pairs
to look at; every pair is verified on the sets, so nothing is joined by chance.  Equal sets are one set from the start.

A band that very many different sets share (a phrase all captions begin with) is not paired out.  Its least set is the
pivot: sets near the pivot are one group already and need no look at each other.  The others meet the band's sets
through the rarest of their words: of two sets that are near, a prefix of each, in one order of all words, has a word in common.

At thresholds so low that a band is one hash, bands would select most of all pairs: there all sets meet, in blocks, and no
pair is missed (:mod:`eventide.operators.near_blocks`).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide.functions.text import tokens
from eventide.operators.components import components
from eventide.operators.near_blocks import block_links
from eventide.session import stage

PAIRED = 64  # different sets of a band that are paired out
MISSED = 0.001  # chance that a pair right at the threshold shares no band


def bands(threshold: float, missed: float = MISSED, most: int = 128) -> tuple[int, int]:
    """(bands, hashes in a band): the longest bands with which a pair at the threshold is missed with a chance of ``missed`` at most."""
    for rows in range(8, 0, -1):
        hit = threshold**rows
        n = 1 if hit >= 1 else math.ceil(math.log(missed) / math.log1p(-hit))
        if n * rows <= most:
            return n, rows
    return most, 1


def word_set(text: Column) -> Column:
    """Distinct lower-case tokens, sorted; null for a null text."""
    return F.array_sort(F.array_distinct(tokens(F.lower(text))))


def similarity(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def _keys(words: Column, n: int, rows: int) -> Column:
    """Of every band the hash of its least hashes."""
    least = lambda seed: F.array_min(F.transform(words, lambda w: F.xxhash64(w, F.lit(seed))))
    return F.array(*[F.xxhash64(*[least(b * rows + r) for r in range(rows)], F.lit(b)) for b in range(n)])


def _prefixes(sets: DataFrame, threshold: float) -> DataFrame:
    """(id, token): of each set the words one of which every set near it has in its own prefix, rarest words first."""
    words = sets.select("id", F.explode("words").alias("token"))
    often = words.groupBy("token").agg(F.count("*").alias("n"))
    ranked = words.join(often, "token").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("w"))
    keep = F.size("w") - F.ceil(F.size("w") * F.lit(threshold) - F.lit(1e-9)) + 1
    return ranked.select("id", F.explode(F.slice("w", F.lit(1), keep.cast("int"))).alias("x")).select("id", "x.token")


def near_links(sets: DataFrame, threshold: float, missed: float = MISSED, paired: int = PAIRED) -> DataFrame:
    """Rows (a, b), a > b, of near sets that join all that share a band and are near, directly or over others.

    ``sets`` has id and words, distinct sets that are not empty.
    """
    n, rows = bands(threshold, missed)
    if rows == 1:
        return block_links(sets, threshold)
    c = F.col
    keyed = stage(sets.select("id", F.posexplode(_keys(c("words"), n, rows)).alias("band", "k")))
    size = stage(keyed.groupBy("band", "k").agg(F.count("*").alias("size"), F.min("id").alias("pivot")).where("size > 1"))
    small = keyed.join(size.where(c("size") <= paired).select("band", "k"), ["band", "k"])
    pairs = small.select("band", "k", c("id").alias("b")).join(small.select("band", "k", c("id").alias("a")), ["band", "k"])
    pairs = pairs.where("a > b").select("a", "b")
    hot = stage(keyed.join(size.where(c("size") > paired), ["band", "k"]).select("band", "k", "id", "pivot"))
    to_pivot = hot.where("id != pivot").select(c("id").alias("a"), c("pivot").alias("b"))
    found = stage(_verified(pairs.unionByName(to_pivot).distinct(), sets, threshold))
    if hot.isEmpty():
        return found
    # Sets of hot bands that are not near the pivot, against all of the band with a word of the prefix in common.
    near = found.select(c("a").alias("id"), c("b").alias("pivot"))
    apart = hot.where("id != pivot").join(near, ["id", "pivot"], "left_anti").select("band", "k", "id")
    some = sets.join(hot.select("id").distinct(), "id", "left_semi")
    prefix = stage(_prefixes(some, threshold))
    left = apart.join(prefix, "id").select("band", "k", "token", c("id").alias("x"))
    right = hot.join(prefix, "id").select("band", "k", "token", c("id").alias("y"))
    more = left.join(right, ["band", "k", "token"]).where("x != y")
    more = more.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()
    return found.unionByName(_verified(more, sets, threshold))


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    a = sets.select(F.col("id").alias("a"), F.col("words").alias("wa"))
    b = sets.select(F.col("id").alias("b"), F.col("words").alias("wb"))
    return pairs.join(a, "a").join(b, "b").where(similarity(F.col("wa"), F.col("wb")) >= threshold).select("a", "b")


def near_groups(
    rows: DataFrame, threshold: float, id_col: str = "id", text_col: str = "text", missed: float = MISSED, paired: int = PAIRED
) -> DataFrame:
    """(id, group): the least id of the near-identical texts, direct or over others, of every row with a text.

    Ids are whole numbers and tell rows apart.  Texts without words are one group; null texts and null ids give no rows; other columns are
    ignored.  Runs jobs.
    """
    ids = rows.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    worded = stage(ids.select(F.col(id_col).cast("long").alias("id"), word_set(F.col(text_col)).alias("words")))
    sets = stage(worded.groupBy("words").agg(F.min("id").alias("id")))
    links = components(near_links(sets.where(F.size("words") > 0), threshold, missed, paired))
    named = sets.join(links.select(F.col("a").alias("id"), F.col("b").alias("least")), "id", "left")
    named = named.select("words", F.coalesce("least", "id").alias("group"))
    return worded.join(named, "words").select("id", "group")
