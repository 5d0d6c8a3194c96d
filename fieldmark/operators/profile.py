"""Column-level data quality profile, over all rows and per load.

Method: exact nulls and extrema come from the footers, distinct counts and the extrema of texts and
fractions from the dictionary pages, both without a scan; a chunk of which neither tells enough is
scanned on its own (:mod:`fieldmark.sources.footers`). Beyond that are scanned only: columns with a rule
or pattern that the extrema leave room to break; rows of files whose extrema leave that room; and
loads, as loads share chunks. The scan reads the columns concerned only.

Defined results: an empty table has 0 rows and null shares of null; columns of nulls only have null
extrema and 0 distinct values; rows with a null load number belong to no load; text extrema are
ordered by bytes. Repeated rows count as often as they occur.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.plans.lineage import cut
from fieldmark.sources.footers import footers

#: Steps of the pooled distribution at which loads are compared.
BINS = 64
#: A load departs grossly where its distribution is this far (Kolmogorov-Smirnov) from the loads'
#: median distribution, and further than chance explains (KS_CHANCE / sqrt(n)), or its null share
#: is this far from the median share, and further than six standard errors.
KS_LEAST, KS_CHANCE, NULL_LEAST, NULL_ERRORS = 0.2, 1.95, 0.25, 6.0
#: Places of the hash in which texts are ordered, and what marks the forms of a text column.
TEXT_PLACES, FORM = 1024, "\x1f"


@dataclass(frozen=True)
class Rule:
    """What a column's values must satisfy: low..high, where ``high`` may name another column."""

    column: str
    low: float
    high: float | str

    def broken(self) -> Column:
        high = F.col(self.high) if isinstance(self.high, str) else F.lit(self.high)
        return (F.col(self.column) < self.low) | (F.col(self.column) > high)


@dataclass(frozen=True)
class Source:
    """A table to profile: its path, key, load column, rules and patterns (column to regular expression)."""

    name: str
    path: str
    key: str = "id"
    load: str = "load_no"
    rules: tuple[Rule, ...] = ()
    patterns: tuple[tuple[str, str], ...] = ()


def column_profile(spark: SparkSession, source: Source) -> DataFrame:
    """(table_name, column_name, n_rows, nulls, null_share, distinct_values, lo, hi, violations, chunks,
    scanned_chunks) for every column. lo and hi are text; violations of patterns and rules are null where
    none is stated and are counted by a scan of their columns, unless the extrema leave no room for any.
    scanned_chunks of the chunks had to be read for the rest."""
    df = spark.read.parquet(source.path)
    types = dict(df.dtypes)
    stated = cut(footers(spark, source.path))
    distinct = stated.select("column", F.explode("hashes").alias("h")).distinct().groupBy("column").agg(F.count("*").alias("distinct_values"))
    per_column = stated.groupBy("column").agg(
        F.sum("rows").alias("n_rows"), F.sum("nulls").alias("nulls"), F.count("*").alias("chunks"), F.count_if("scanned").alias("scanned_chunks"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        F.min("lo_real").alias("lo_real"), F.max("hi_real").alias("hi_real"), F.min("lo_text").alias("lo_text"), F.max("hi_text").alias("hi_text"),
    )
    known = {r["column"]: r for r in per_column.join(distinct, "column", "left").collect()}  # one row for each column
    rules, patterns = {r.column: r for r in source.rules}, dict(source.patterns)
    aggregates = []
    for c in df.columns:
        k = known.get(c)
        roomless = c in rules and isinstance(rules[c].high, int | float) and k is not None and k["lo"] is not None and k["lo"] >= rules[c].low and k["hi"] <= rules[c].high
        if c in rules and not roomless:
            aggregates.append(F.count_if(rules[c].broken()).alias(f"bad:{c}"))
        elif c in patterns:
            aggregates.append(F.count_if(~F.col(c).rlike(patterns[c])).alias(f"bad:{c}"))
    got = df.agg(*aggregates).first().asDict() if aggregates else {}
    rows = []
    for c in df.columns:
        k = known.get(c)
        bad = got.get(f"bad:{c}", 0 if c in rules or c in patterns else None)
        whole = (k["n_rows"], k["nulls"], k["chunks"], k["scanned_chunks"]) if k else (0, 0, 0, 0)
        extrema = (k["lo"], k["hi"], k["lo_real"], k["hi_real"], k["lo_text"], k["hi_text"]) if k else (None,) * 6
        rows.append((source.name, c, types[c], *whole, (k["distinct_values"] if k else 0) or 0, *extrema, bad))
    schema = "table_name string, column_name string, type string, n_rows long, nulls long, chunks long, scanned_chunks long, distinct_values long, lo long, hi long, lo_real double, hi_real double, lo_text string, hi_text string, violations long"
    out = spark.createDataFrame(rows, schema)
    time, day = F.col("type").startswith("timestamp"), F.col("type") == "date"
    whole = lambda side: F.coalesce(F.when(time, F.timestamp_micros(side).cast("string")).when(day, F.date_add(F.lit("1970-01-01").cast("date"), F.col(side).cast("int")).cast("string")), F.col(side).cast("string"))
    lo, hi = F.coalesce(whole("lo"), F.col("lo_real").cast("string"), "lo_text").alias("lo"), F.coalesce(whole("hi"), "hi_text", F.col("hi_real").cast("string")).alias("hi")
    share = F.col("nulls") / F.nullif("n_rows", F.lit(0))
    return out.select("table_name", "column_name", "n_rows", "nulls", share.alias("null_share"), "distinct_values", lo, hi, "violations", "chunks", "scanned_chunks")


def _integer(kind: str) -> bool:
    return kind in ("tinyint", "smallint", "int", "bigint")


def load_profile(spark: SparkSession, source: Source) -> DataFrame:
    """(table_name, column_name, load_no, n_rows, nulls, distinct_values, lo, hi, mean, violations) of
    every column and load: loads share chunks, so footers cannot separate them. Values are tallied
    by load and column, so that distinct counts are exact; lo and hi are text; mean is null for text
    and violations where no rule or pattern is stated."""
    df = spark.read.parquet(source.path).where(F.col(source.load).isNotNull())
    rules, patterns = {r.column: r for r in source.rules}, dict(source.patterns)
    pairs = []
    for c, t in df.dtypes:
        if c == source.load:
            continue
        number = _integer(t) or t in ("float", "double")
        bad = F.coalesce(rules[c].broken(), F.lit(False)) if c in rules else F.coalesce(~F.col(c).rlike(patterns[c]), F.lit(False)) if c in patterns else F.lit(None).cast("boolean")
        value = lambda here, kind, c=c: (F.col(c) if here else F.lit(None)).cast(kind)
        pairs.append(F.struct(F.lit(c).alias("column_name"), value(_integer(t), "long").alias("l"), value(number and not _integer(t), "double").alias("x"), value(not number, "string").alias("s"), bad.alias("bad")))
    values = df.select(F.col(source.load).cast("long").alias("load_no"), F.explode(F.array(*pairs)).alias("p")).select("load_no", "p.*")
    # bad may differ between rows of one value, where a rule names another column
    tally = values.groupBy("column_name", "load_no", "l", "x", "s").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("bad"))
    number, known = F.coalesce(F.col("l").cast("double"), "x"), F.coalesce(F.col("l").isNotNull() | F.col("x").isNotNull() | F.col("s").isNotNull(), F.lit(False))
    of = lambda f: F.coalesce(f("l").cast("string"), f("x").cast("string"), f("s"))
    out = tally.groupBy("column_name", "load_no").agg(
        F.sum("n").alias("n_rows"), F.sum(F.when(known, 0).otherwise(F.col("n"))).alias("nulls"), F.count_if(known).alias("distinct_values"), of(F.min).alias("lo"), of(F.max).alias("hi"),
        (F.sum(number * F.col("n")) / F.sum(F.when(number.isNotNull(), F.col("n")))).alias("mean"), F.sum("bad").alias("violations"),
    )
    return out.select(F.lit(source.name).alias("table_name"), "*")


def load_comparison(spark: SparkSession, source: Source) -> DataFrame:
    """:func:`load_profile` with null_share, usual_null_share, ks and departs of every column and load."""
    columns = [c for c in spark.read.parquet(source.path).columns if c != source.load]
    apart = load_departures(spark, source, columns).drop("n")
    return load_profile(spark, source).join(apart, ["table_name", "column_name", "load_no"], "left")


def suspicious_files(stated: DataFrame, rule: Rule) -> DataFrame:
    """Files in which some row group's statistics leave room for a broken rule."""
    by = stated.where(F.col("column").isin(*{rule.column, rule.high} if isinstance(rule.high, str) else {rule.column})).groupBy("file", "row_group")
    of = lambda c, what: F.max(F.when(F.col("column") == c, F.col(what)))
    bounds = by.agg(of(rule.column, "lo").alias("lo"), of(rule.column, "hi").alias("hi"), of(rule.column, "nulls").alias("nulls"), F.max("rows").alias("rows"), (of(rule.high, "lo") if isinstance(rule.high, str) else F.lit(rule.high)).alias("high"))
    empty = F.coalesce(F.col("nulls") == F.col("rows"), F.lit(False))
    return bounds.where(~empty & F.coalesce((F.col("lo") < rule.low) | (F.col("hi") > F.col("high")), F.lit(True))).select("file").distinct()


def broken_rows(spark: SparkSession, source: Source) -> DataFrame:
    """(table_name, column_name, case_key) of every row that breaks a rule. Only files whose footers
    leave room are opened; their list is a part of the listing that the driver holds for any read."""
    schema = spark.read.parquet(source.path).schema
    names = {r.column for r in source.rules} | {r.high for r in source.rules if isinstance(r.high, str)}
    stated = cut(footers(spark, source.path, names, values=False))
    out = []
    for rule in source.rules:
        files = [r.file for r in suspicious_files(stated, rule).collect()]
        df = spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
        out.append(df.where(rule.broken()).select(F.lit(source.name).alias("table_name"), F.lit(rule.column).alias("column_name"), F.col(source.key).cast("long").alias("case_key")))
    return reduce(DataFrame.unionByName, out)


def load_departures(spark: SparkSession, source: Source, columns: list[str] | None = None) -> DataFrame:
    """(table_name, column_name, load_no, n, null_share, usual_null_share, ks, departs) of each load and
    column, without ``columns`` of those with a rule. Distributions are those of the values that keep
    the rule. Text has no distances: its values, and apart from them its forms (letters and digits
    made alike), are compared in the order of a hash, and the larger ks counts."""
    df = spark.read.parquet(source.path).where(F.col(source.load).isNotNull())
    types, rules = dict(df.dtypes), {r.column: r for r in source.rules}
    pairs = []
    for c in columns or list(rules):
        kept = F.coalesce(~rules[c].broken(), F.lit(False)) if c in rules else F.col(c).isNotNull()
        if _integer(types[c]) or types[c] in ("float", "double"):
            positions = [("", F.col(c).cast("double"))]
        else:
            text = F.col(c).cast("string")
            forms = F.regexp_replace(F.regexp_replace(text, "[0-9]", "9"), "[A-Za-z]", "a")
            positions = [(tag, F.when(text.isNotNull(), F.pmod(F.xxhash64(y), F.lit(TEXT_PLACES)).cast("double"))) for tag, y in (("", text), (FORM, forms))]
        pairs += [F.struct(F.lit(c + tag).alias("c"), x.alias("x"), kept.alias("ok")) for tag, x in positions]
    values = df.select(F.col(source.load).cast("long").alias("load_no"), F.explode(F.array(*pairs)).alias("p"))
    # tallied by value before anything is shuffled
    tally = cut(values.groupBy("load_no", "p.c", "p.x", "p.ok").agg(F.count("*").alias("n")))
    shares = tally.groupBy("c", "load_no").agg(F.sum("n").alias("rows"), F.sum(F.when(F.col("x").isNull(), F.col("n")).otherwise(0)).alias("nulls"), F.sum(F.when(F.col("ok"), F.col("n")).otherwise(0)).alias("n"))
    kept = tally.where("ok")
    steps = F.array(*[F.lit(k / BINS) for k in range(1, BINS + 1)])
    # a sketch of bounded size, not the values themselves, gives the steps
    edges = values.where("p.ok").groupBy("p.c").agg(F.array_sort(F.array_distinct(F.percentile_approx("p.x", steps, 10000))).alias("edges"))
    binned = kept.join(edges, "c").withColumn("bin", F.size(F.filter("edges", lambda e: e < F.col("x")))).groupBy("c", "load_no", "bin").agg(F.sum("n").alias("k"))
    grid = shares.where("n > 0").join(edges, "c").select("c", "load_no", F.col("n").alias("total"), F.explode(F.sequence(F.lit(0), F.size("edges") - 1)).alias("bin"))
    cdf = grid.join(binned, ["c", "load_no", "bin"], "left").selectExpr("c", "load_no", "bin", "sum(coalesce(k, 0)) OVER (PARTITION BY c, load_no ORDER BY bin) / total AS f")
    usual = cdf.groupBy("c", "bin").agg(F.percentile("f", 0.5).alias("usual"))
    ks = cdf.join(usual, ["c", "bin"]).groupBy("c", "load_no").agg(F.max(F.abs(F.col("f") - F.col("usual"))).alias("ks"))
    usual_nulls = shares.groupBy("c").agg(F.percentile(F.col("nulls") / F.col("rows"), 0.5).alias("usual_null_share"))
    joined = shares.join(usual_nulls, "c").join(ks, ["c", "load_no"], "left").withColumn("null_share", F.col("nulls") / F.col("rows"))
    apart = F.abs(F.col("null_share") - F.col("usual_null_share"))
    error = F.sqrt(F.col("usual_null_share") * (1 - F.col("usual_null_share")) / F.col("rows"))
    departs = ((apart > NULL_LEAST) & (apart > NULL_ERRORS * error)) | F.coalesce((F.col("ks") > KS_LEAST) & (F.col("ks") > KS_CHANCE / F.sqrt("n")), F.lit(False))
    rows = joined.withColumns({"departs": departs, "column_name": F.substring_index("c", FORM, 1)})
    one = rows.groupBy("column_name", "load_no").agg(F.max("n").alias("n"), F.max("null_share").alias("null_share"), F.max("usual_null_share").alias("usual_null_share"), F.max("ks").alias("ks"), F.bool_or("departs").alias("departs"))
    return one.select(F.lit(source.name).alias("table_name"), "*")


def p3_found(spark: SparkSession, sources: list[Source]) -> DataFrame:
    """(table_name, column_name, scope, case_key) of broken rows and departing loads."""
    parts = []
    for s in sources:
        parts.append(broken_rows(spark, s).select("table_name", "column_name", F.lit("row").alias("scope"), "case_key"))
        parts.append(load_departures(spark, s).where("departs").select("table_name", "column_name", F.lit("load").alias("scope"), F.col("load_no").alias("case_key")))
    return reduce(DataFrame.unionByName, parts).distinct()


def warehouse_sources(d: str) -> list[Source]:
    """The two tables that are profiled, with the ranges and patterns of their columns."""
    return [
        Source("matches", f"{d}/matches.parquet", rules=(Rule("attendance", 0, 105000), Rule("home_q1_goals", 0, "home_goals")), patterns=(("external_afltables_id", r"^t\d{8}$"), ("external_fryzigg_id", r"^z\d+$"), ("external_afl_id", r"^CD_X\d{12}$"))),
        Source("player_match_stats", f"{d}/player_match_stats.parquet", rules=(Rule("goal_assists", 0, 12), Rule("inside_fifties", 0, 25))),
    ]
