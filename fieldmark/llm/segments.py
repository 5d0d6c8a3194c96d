"""Strings within an edit distance: pigeonhole segment join, verified by banded edit distance.

Of two strings within k edits, one cut into k + 1 segments shares at least one whole segment with
the other, shifted by at most the difference in length and the edits around it. The reference side's
segments form an inverted index (length, number, segment); the other side looks up its substrings at
the shifted places. Both are plain rows joined on equal keys, so Spark hashes, spills and splits
skewed keys as for any join; pairs are verified with the threshold form of ``levenshtein``, which
fills a band of the table only. A swap of neighbours that straddles a cut would spoil two segments
at once; the index holds the texts with that swap undone as well. No pair within the bound is lost.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` by hash of its columns in as many partitions as shuffles have: a stated number, which is not
    lowered where rows are short but much work each."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def edits_allowed(length: Column) -> Column:
    """Edits that a typed token of this length may hold: 0 up to 3 letters, 1 up to 5, 2 up to 7, 3
    for 8, 4 beyond. Two swaps of neighbouring letters are four edits."""
    return F.when(length <= 3, 0).when(length <= 5, 1).when(length <= 7, 2).when(length == 8, 3).otherwise(4)


def _swaps_as_one(a: str, b: str, most: int) -> int:
    """Edit distance in which swapped neighbours are one edit, within a band of ``most``; most + 1 beyond it."""
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return most + 1
    far = most + 1
    before, last = None, [min(j, far) for j in range(m + 1)]
    for i in range(1, n + 1):
        row = [far] * (m + 1)
        if i <= most:
            row[0] = i
        for j in range(max(1, i - most), min(m, i + most) + 1):
            d = min(last[j - 1] + (a[i - 1] != b[j - 1]), last[j] + 1, row[j - 1] + 1)
            if before is not None and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d = min(d, before[j - 2] + 1)
            row[j] = min(d, far)
        # a swap may still start from the row before
        if min(row) == far and min(last) >= most:
            return far
        before, last = last, row
    return last[m]


def typing_edits(left: Column, right: Column, most: int = 4) -> Column:
    """Edits between two short strings where swapped neighbours count as one; most + 1 beyond ``most``."""

    @F.pandas_udf("int")
    def edits(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_swaps_as_one(x, y, most) for x, y in zip(a, b, strict=True)], dtype="int32")

    return edits(left, right)


def _cuts(n: Column, k: Column, j: Column) -> tuple[Column, Column]:
    """(place from 0, letters) of segment j of k + 1 segments of n letters, the first ones shorter by one."""
    each, short = F.floor(n / (k + 1)).cast("int"), (k + 1 - n % (k + 1)).cast("int")
    return (j * each + F.greatest(j - short, F.lit(0))).cast("int"), each + F.when(j >= short, 1).otherwise(0)


def _letters(text: Column) -> Column:
    """The set of a text's letters as 64 bits; letters that share a bit only make it smaller."""
    return F.aggregate(F.split(text, ""), F.lit(0).cast("bigint"), lambda acc, c: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.ascii(c), F.lit(64)))))


def _index(r: DataFrame, k: Column, swaps: bool) -> DataFrame:
    """(r, letters_r, n, number, segment): the k + 1 segments of each text ``r``. With ``swaps``, those too of the
    text with the two letters at one of its k cuts swapped: such a swap is one edit that touches two
    segments."""
    forms = r.select("r", "letters_r", F.col("r").alias("form"), F.length("r").alias("n"), k.alias("k"))
    if swaps:
        at, _ = _cuts(F.col("n"), F.col("k"), F.col("j"))
        # the letters before and behind cut j; cut 0 is none
        other = F.concat(F.expr("substring(r, 1, at - 1)"), F.expr("substring(r, at + 1, 1)"), F.expr("substring(r, at, 1)"), F.expr("substring(r, at + 2)"))
        forms = forms.select("r", "letters_r", "n", "k", F.explode(F.sequence(F.lit(0), F.col("k"))).alias("j")).withColumn("at", at).where("j = 0 OR at > 0").select("r", "letters_r", F.when(F.col("j") == 0, F.col("r")).otherwise(other).alias("form"), "n", "k")
    at, m = _cuts(F.col("n"), F.col("k"), F.col("number"))
    cut_ = forms.select("r", "letters_r", "form", "n", "k", F.explode(F.sequence(F.lit(0), F.col("k"))).alias("number")).select("r", "letters_r", "form", "n", "number", at.alias("at"), m.alias("m"))
    return cut_.select("r", "letters_r", "n", "number", F.expr("substring(form, at + 1, m)").alias("segment")).distinct()


def _lookups(l_: DataFrame, allowed: Callable[[Column], Column], most: int) -> DataFrame:
    """(l, letters_l, n, number, segment): for each length n of a text that may lie within its allowed edits of
    ``l``, the substrings of ``l`` that can be segment ``number`` of it."""
    lengths = l_.select("l", "letters_l", F.length("l").alias("ln")).select("l", "letters_l", "ln", F.explode(F.sequence(F.greatest(F.col("ln") - most, F.lit(1)), F.col("ln") + most)).alias("n"))
    lengths = lengths.withColumn("k", allowed(F.col("n")).cast("int")).where("abs(n - ln) <= k")
    at, m = _cuts(F.col("n"), F.col("k"), F.col("j"))
    cut_ = lengths.select("l", "letters_l", "ln", "n", "k", F.explode(F.sequence(F.lit(0), F.col("k"))).alias("j")).select("*", at.alias("at"), m.alias("m"))
    # a shared segment exists with at most j edits before it and k - j behind it
    places = cut_.selectExpr("l", "letters_l", "n", "j AS number", "m", "greatest(at - j, at + ln - n - (k - j), 0) AS lo", "least(at + j, at + ln - n + (k - j), ln - m) AS hi").where("hi >= lo")
    return places.select("l", "letters_l", "n", "number", "m", F.explode(F.sequence("lo", "hi")).alias("p")).selectExpr("l", "letters_l", "n", "number", "substring(l, p + 1, m) AS segment")


def segment_join(left: DataFrame, right: DataFrame, allowed: Callable[[Column], Column] = edits_allowed, most: int = 4, swaps: bool = False) -> DataFrame:
    """(left, right, edits) for the distinct strings of both one-column tables ``left(text)`` and
    ``right(text)`` within ``allowed(length of right)`` edits, which are at most ``most``.

    With ``swaps`` (for up to two edits), swapped neighbours count as one edit; without, as two. The
    result does not depend on the order of rows, and on which side a string stands only through
    ``allowed``. Null and empty strings match nothing; repeated strings count once; equal strings have
    0 edits. Every pair within the bound is found; all joins are on equal keys, whose lengths and
    places are computed on either side.
    """
    if swaps and most > 2:
        raise ValueError("swaps are found for up to two edits")
    l_ = left.where("length(text) > 0").select(F.col("text").alias("l")).distinct()
    r = right.where("length(text) > 0").select(F.col("text").alias("r")).distinct()
    k = allowed(F.length("r")).cast("int")
    # an edit changes two letters of a text's set of letters at most, a swap none
    index = _index(r.withColumn("letters_r", _letters(F.col("r"))), k, swaps)
    met = _lookups(l_.withColumn("letters_l", _letters(F.col("l"))), allowed, most).join(index, ["n", "number", "segment"])
    apart = F.bit_count(F.expr("letters_l ^ letters_r"))
    # a few bytes a pair, but much work for some of them
    pairs = spread(met.where(apart <= 2 * k).select("l", "r", apart.alias("apart")), "l", "r").distinct().withColumn("k", k)
    # the threshold form fills a band only; a swap counts as two edits here
    near = pairs.withColumn("edits", F.expr(f"levenshtein(l, r, {2 if swaps else 1} * k)")).where("edits >= 0")
    if swaps:
        # beyond k edits, and where two may be one swap: what else changes letters is bounded
        unsure = F.expr("edits > 1 AND (edits > k OR apart = 0 AND length(l) = length(r))")
        swapped = near.where(unsure & F.expr("edits <= k OR apart <= 2 * (2 * k - edits)")).withColumn("edits", typing_edits(F.col("l"), F.col("r"), most)).where("edits <= k")
        near = near.where(~unsure).unionByName(swapped)
    return near.select(F.col("l").alias("left"), F.col("r").alias("right"), "edits")
