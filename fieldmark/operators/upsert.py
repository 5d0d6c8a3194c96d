"""Change-detecting upserts of a table by a manifest of column rules, as joins of old and new rows.

A column is a ``key``, is replaced, or keeps its old value where the new one is null (``coalesce``); a
rule may replace it under a condition on old and new row. A row counts as changed only if a value
differs null-safely. The result is a new table and its changes; nothing is updated in place, so a
retry or a lost executor recomputes the same rows.

Defined results: incoming rows of one key must be unique (the caller's choice of the latest comes
first, :func:`latest`); rows with a null in a key are inserted, as nulls equal nothing; columns that
the manifest does not name keep their old values and are null in new rows; an empty side is fine.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``how``: key, replace or coalesce. ``when``: a condition on (old, new) under which the new
    value replaces even where it is null; old and new give a side's column by name."""

    column: str
    how: str = "coalesce"
    when: Callable[[Callable[[str], Column], Callable[[str], Column]], Column] | None = None


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Of the rows of one key the first in ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def merge(old: DataFrame, new: DataFrame, manifest: list[Rule], keep: tuple[str, ...] = ()) -> DataFrame:
    """Old and new rows as one table, with ``_change``: inserted, updated, or null for unchanged, and
    ``_was_<column>``, the old value, of the columns in ``keep``.

    One full outer join on the keys; Spark sorts and merges, or hashes where a side is small.
    """
    keys = [r.column for r in manifest if r.how == "key"]
    o = old.select(F.struct("*").alias("o"), *[F.col(k).alias(f"_o_{k}") for k in keys])
    n = new.select(F.struct("*").alias("n"), *[F.col(k).alias(f"_n_{k}") for k in keys])
    both = o.join(n, reduce(lambda a, b: a & b, [F.col(f"_o_{k}") == F.col(f"_n_{k}") for k in keys]), "full")
    was, now = (lambda c: F.col(f"o.{c}")), (lambda c: F.col(f"n.{c}"))
    fresh, kept = F.col("o").isNull(), F.col("n").isNull()
    out, differs = [], []
    rules = {r.column: r for r in manifest}
    for c in old.columns:
        r = rules.get(c)
        if r is None:
            out.append(was(c).alias(c))
            continue
        if r.how == "key":
            out.append(F.coalesce(was(c), now(c)).alias(c))
            continue
        value = now(c) if r.how == "replace" else F.coalesce(now(c), was(c))
        if r.when is not None:
            value = F.when(r.when(was, now), now(c)).otherwise(value)
        value = F.when(fresh, now(c)).when(kept, was(c)).otherwise(value)
        differs.append(~was(c).eqNullSafe(value))
        out.append(value.alias(c))
    changed = reduce(lambda a, b: a | b, differs) if differs else F.lit(False)
    change = F.when(fresh, "inserted").when(~kept & changed, "updated")
    return both.select(*out, change.alias("_change"), *[was(c).alias(f"_was_{c}") for c in keep])


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` whose keys it lacks."""
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti").select(*old.columns))


def fill_unknown(old: DataFrame, new: DataFrame, keys: list[str], column: str) -> DataFrame:
    """``old`` with ``column`` taken from ``new`` where it is null or 0."""
    n = new.select(*keys, F.col(column).alias("_new"))
    return old.join(n, keys, "left").withColumn(column, F.when(F.coalesce(F.col(column), F.lit(0)) == 0, F.coalesce("_new", column)).otherwise(F.col(column))).select(*old.columns)


def replace_groups(old: DataFrame, new: DataFrame, group: list[str]) -> DataFrame:
    """``old`` with every group that occurs in ``new`` replaced by its new rows."""
    return old.join(new.select(*group).distinct(), group, "left_anti").unionByName(new.select(*old.columns))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows as often; what a write may skip if they do."""
    b = b.select(*a.columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def affected(merged: DataFrame, column: str) -> DataFrame:
    """Distinct values of ``column`` in changed rows, the old ones too where the merge kept them: what
    derived tables must be rebuilt for."""
    changed = merged.where("_change is not null")
    values = F.array(*[c for c in (column, f"_was_{column}") if c in merged.columns])
    known = changed.select(F.explode(F.array_compact(values)).alias(column))
    return known.unionByName(changed.where(f"{column} is null").select(column)).distinct()


def with_keys(old: DataFrame, new: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``new`` with surrogate keys after the greatest of ``old``, in ``order``; numbers leave no gap.

    Numbering is by range partition and the sums over earlier partitions, not in one task.
    """
    from fieldmark.plans.blocks import in_blocks

    top = old.agg(F.coalesce(F.max(key), F.lit(0)).alias("_top"))
    placed = in_blocks(new.withColumn("_all", F.lit("")), "_all", order, 100_000, 0).where("_core")
    return placed.join(F.broadcast(top)).withColumn(key, F.col("_top") + F.col("_index") + 1).drop("_top", "_index", "_block", "_core", "_all")  # top is one row


def merged_identity(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows of one key as one: a column with one known value takes it; with several it is null and
    named in ``conflicts``."""
    sets = rows.groupBy(*keys).agg(*[F.collect_set(c).alias(c) for c in columns])
    values = [F.when(F.size(c) == 1, F.col(c)[0]).alias(c) for c in columns]
    conflicts = F.array_compact(F.array(*[F.when(F.size(c) > 1, F.lit(c)) for c in columns]))
    return sets.select(*keys, *values, conflicts.alias("conflicts"))


def broken_constraints(df: DataFrame, unique: list[list[str]] = (), not_null: list[str] = (), enums: dict[str, list] | None = None, parents: dict[str, DataFrame] | None = None) -> DataFrame:
    """(constraint, n): how many rows or keys break each declared constraint. ``parents``: column to
    the one-column table of the keys that it must be in."""
    parts = [df.agg(F.count_if(F.col(c).isNull()).alias("n")).select(F.lit(f"not null {c}").alias("constraint"), "n") for c in not_null]
    for keys in unique:
        twice = df.dropna(subset=keys).groupBy(*keys).count().where("count > 1")
        parts.append(twice.agg(F.count("*").alias("n")).select(F.lit(f"unique {', '.join(keys)}").alias("constraint"), "n"))
    for c, values in (enums or {}).items():
        parts.append(df.agg(F.count_if(~F.col(c).isin(*values)).alias("n")).select(F.lit(f"one of {c}").alias("constraint"), "n"))
    for c, parent in (parents or {}).items():
        p = parent.toDF("_parent").distinct()
        lost = df.where(F.col(c).isNotNull()).join(p, F.col(c) == F.col("_parent"), "left_anti")
        parts.append(lost.agg(F.count("*").alias("n")).select(F.lit(f"parent of {c}").alias("constraint"), "n"))
    return reduce(DataFrame.unionByName, parts).where("n > 0")
