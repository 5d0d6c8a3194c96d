"""Records of two sources that describe the same thing, without a common key, with a confidence.

Method: each attribute (date, home and away points, team) becomes q-grams, and these a fixed bit vector
of 64 bits, one half for the coarse part of the value and one for the fine part. Close codes are found
exactly by multi-index Hamming hashing: a code is eight chunks of 32 bits, and its index entries are
triples of chunks, chosen so that any five of the eight hold one of the triples whole. Two codes that
differ in at most ``MOST_CHUNKS`` = 3 chunks, and so all codes within three bits of each other and all
that differ by three wrong digits, agree in an entry and are found, with equal-key joins only. Candidates
are verified by the number of chunks that differ; Dice scores of the fields are weighted and calibrated
to a confidence by a logistic fit on the records whose match is known.

The team's q-grams are those of its repaired spelling (:mod:`fieldmark.llm.canonical`), or of the text as
typed where it names no team: typed forms of one name can lie further apart than names do.

Entries that hold less than a whole date carry the season, else their buckets would grow with the seasons.
A null field fills no chunk; a record with one is entered under its pairs of whole fields as well, which
finds what agrees in two fields. Records of one provider's match page share their evidence.

Defined results: records without any two usable fields have no match; of several matches with equal
confidence none is chosen; repeated records give one row; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmark.llm.canonical import folded, team_targets
from fieldmark.operators.instants import date_of
from fieldmark.plans.lineage import cut

#: Bits of a field's vector and of a chunk, which is half of it.
BITS, CHUNK = 64, 32
#: Chunks that may differ between the codes of candidates.
MOST_CHUNKS = 3
FIELDS = ("date", "home", "away", "team")
#: What the confidence is made of: Dice scores, and whether the points fit the other way round only.
FEATURES = ("date", "home", "away", "team", "turned")
#: Two groups of four chunks, (field, half): of any five chunks at least three lie in one group.
GROUPS = ((("date", 0), ("date", 1), ("home", 0), ("home", 1)), (("away", 0), ("away", 1), ("team", 0), ("team", 1)))
#: Candidate pairs of known records that the confidence is fitted on, at most: a bounded sample.
MOST_FITTED = 50_000
#: The fit is drawn towards PRIOR, so that its confidences are cautious.
LEAST_CONFIDENCE = 0.3
#: Weights before any known record: of the features in their order, and the constant.
PRIOR = np.array([4.0, 4.0, 4.0, 4.0, -1.0, -9.0])


def _half(grams: Column, upper: bool) -> Column:
    bit = lambda acc, g: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.pmod(F.xxhash64(g), F.lit(CHUNK)) + (CHUNK if upper else 0)).cast("int")))
    return F.aggregate(grams, F.lit(0).cast("bigint"), bit)


def _vector(coarse: Column, fine: Column) -> Column:
    return _half(coarse, False).bitwiseOR(_half(fine, True))


def _placed(text: Column) -> Column:
    """Single characters and bigrams of a text, by place."""
    n = F.length(text)
    single = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(i.cast("string"), F.lit(":"), F.substring(text, i, F.lit(1))))
    double = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.concat(i.cast("string"), F.lit("::"), F.substring(text, i, F.lit(2))))
    return F.concat(single, double)


def date_vector(date: Column) -> Column:
    """Year and month, and day with the three spans of three days that it lies in: dates typed a day
    off share two of them. The year is one q-gram: most records of a bucket share it."""
    n = F.datediff(date, F.lit("1970-01-01"))
    spans = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.concat(k.cast("string"), F.lit("/"), F.floor((n + k) / 3).cast("string")))
    year = F.array(F.concat(F.lit("y:"), F.year(date).cast("string")))
    return F.when(date.isNotNull(), _vector(F.concat(year, _placed(F.date_format(date, "MM"))), F.concat(_placed(F.date_format(date, "dd")), spans)))


def points_vector(points: Column) -> Column:
    """All digits but the last, and the last."""
    text = F.lpad(points.cast("string"), 4, "0")
    return F.when(points.isNotNull(), _vector(_placed(F.substring(text, 1, 3)), _placed(F.substring(text, 4, 1))))


def team_vector(name: Column) -> Column:
    """Bigrams of the folded name, by the parity of their hash."""
    text = F.concat(F.lit("^"), folded(name), F.lit("$"))
    grams = F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: F.substring(text, i, F.lit(2)))
    of = lambda k: F.filter(grams, lambda g: F.pmod(F.crc32(g.cast("binary")), F.lit(2)) == k)
    return F.when(F.length(folded(name)) > 0, _vector(of(0), of(1)))


def _coded(df: DataFrame) -> DataFrame:
    """Adds the vectors of date, home_points and away_points."""
    return df.withColumns({"v_date": date_vector(F.col("date")), "v_home": points_vector(F.col("home_points")), "v_away": points_vector(F.col("away_points"))})


def _named(names: DataFrame) -> DataFrame:
    """(name, v_team) of the distinct names."""
    return names.select("name").where("name is not null").distinct().withColumn("v_team", team_vector(F.col("name")))


def _chunk(field: str, half: int) -> Column:
    v = F.col(f"v_{field}")
    return F.shiftrightunsigned(v, CHUNK) if half else v.bitwiseAND(F.lit((1 << CHUNK) - 1))


def _entries(coded: DataFrame, keys: list[str], pairs: Column) -> DataFrame:
    """(keys, vectors, entry): the triples of chunks of each group, and where ``pairs`` holds the pairs of
    whole fields; none that lack a field. Entries carry the code, so that candidates are verified where
    they meet."""
    made = []
    sets = [(t, F.lit(True)) for group in GROUPS for t in combinations(group, 3)] + [(((a, 0), (a, 1), (b, 0), (b, 1)), pairs) for a, b in combinations(FIELDS, 2)]
    for n, (chunks, wanted) in enumerate(sets):
        full = reduce(lambda x, y: x & y, [F.col(f"v_{f}").isNotNull() for f, _ in chunks]) & wanted
        season = F.lit(0) if {("date", 0), ("date", 1)} <= set(chunks) else F.coalesce(F.col("season"), F.lit(-1))
        made.append(F.when(full, F.xxhash64(F.lit(n), season, *[_chunk(*c) for c in chunks])))
    return coded.select(*keys, *[f"v_{f}" for f in FIELDS], F.explode(F.array_compact(F.array(*made))).alias("entry"))


def _differ() -> Column:
    """Chunks that differ between the codes l_v and r_v; null fields do not."""
    mask = F.lit((1 << CHUNK) - 1)
    chunks = lambda x: F.when(x.bitwiseAND(mask) != 0, 1).otherwise(0) + F.when(F.shiftrightunsigned(x, CHUNK) != 0, 1).otherwise(0)
    return reduce(lambda x, y: x + y, [F.coalesce(chunks(F.col(f"l_v_{f}").bitwiseXOR(F.col(f"r_v_{f}"))), F.lit(0)) for f in FIELDS])


def _dice(a: Column, b: Column) -> Column:
    """Dice score of two vectors; null where a side is missing."""
    return 2 * F.bit_count(a.bitwiseAND(b)) / (F.bit_count(a) + F.bit_count(b))


def pages(observations: DataFrame, teams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, pages): each observation's page, and one record a page with its season, date, points, teams
    and their repaired names. A value that a page states in several ways is the commonest, of equals
    the least."""
    o = observations.select("id", F.concat_ws(":", "provider", F.coalesce(F.nullif("external_match_id", F.lit("")), F.concat(F.lit("#"), F.col("id").cast("string")))).alias("page"), "season", date_of(F.col("match_date")).alias("date"), "home_points", "away_points", F.col("raw_team").alias("value"), F.col("match_id").alias("known")).distinct()
    own = teams.where("competition_id = 1")
    named = team_targets(o.select("value"), own).select("value", F.col("target").alias("team")).join(own.groupBy(F.col("id").alias("team")).agg(F.min("name").alias("title")), "team", "left")
    o = cut(o.join(named, "value", "left").withColumn("name", F.coalesce("title", "value")))
    merged = o.groupBy("page").agg(*[F.mode(c).alias(c) for c in ("season", "date", "home_points", "away_points")], F.array_sort(F.collect_set("team")).alias("teams"), F.array_sort(F.collect_set("name")).alias("names"), F.max("known").alias("known"))
    return o.select("id", "page", "known"), merged


def candidates(records: DataFrame, matches: DataFrame, teams: DataFrame) -> DataFrame:
    """(page, match_id, known, d_date, d_home, d_away, d_team, d_turned, differ) of every pair whose codes differ
    in at most MOST_CHUNKS chunks for one of its teams, null fields aside, and of those with a null
    field that agree in two fields."""
    # a page may state the points the other way round: it has a code for either order
    either = F.explode(F.array(*[F.struct(F.lit(float(k)).alias("turned"), F.col(x).alias("h"), F.col(y).alias("a")) for k, (x, y) in enumerate((("v_home", "v_away"), ("v_away", "v_home")))]))
    turned = _coded(records).select("*", either.alias("o")).where("o.turned = 0 OR NOT o.h <=> o.a").withColumns({"turned": F.col("o.turned"), "v_home": F.col("o.h"), "v_away": F.col("o.a")}).drop("o")
    left = turned.withColumn("name", F.explode_outer("names"))
    left = cut(left.join(_named(left), "name", "left"))
    title = teams.groupBy(F.col("id").alias("team")).agg(F.min("name").alias("name"))
    m = matches.select(F.col("id").alias("match_id"), (F.col("season_id") % 10000).cast("int").alias("season"), date_of(F.coalesce("date", "kickoff_at")).alias("date"), "home_points", "away_points", F.array("home_team_id", "away_team_id").alias("teams")).dropDuplicates(["match_id"])
    right = _coded(m).withColumn("team", F.explode("teams")).join(title, "team", "left")
    right = cut(right.join(_named(title), "name", "left"))
    some_null = reduce(lambda x, y: x | y, [F.col(f"v_{f}").isNull() for f in FIELDS])
    # a record with a null field meets the pairs of all others, and the other way round
    open_left, open_right = (not t.where(some_null).isEmpty() for t in (left, right))
    l_, r_ = _entries(left, ["page", "turned"], F.lit(True) if open_right else some_null), _entries(right, ["match_id"], F.lit(True) if open_left else some_null)
    # never broadcast: Spark takes a side for as large as its compressed columns before entries were made of them
    met = l_.withColumnsRenamed({f"v_{f}": f"l_v_{f}" for f in FIELDS}).join(r_.withColumnsRenamed({f"v_{f}": f"r_v_{f}" for f in FIELDS}).hint("merge"), "entry")
    pairs = met.withColumn("differ", _differ()).where(F.col("differ") <= MOST_CHUNKS).groupBy("page", "turned", "match_id").agg(F.min("differ").alias("differ"))
    fields = ("v_date", "v_home", "v_away")
    l1 = left.groupBy("page", "turned").agg(*[F.first(c).alias(f"l{c}") for c in fields], F.collect_set("v_team").alias("l_v"), F.first("teams").alias("l_teams"), F.first("known").alias("known"))
    r1 = right.groupBy("match_id").agg(*[F.first(c).alias(f"r{c}") for c in fields], F.collect_set("v_team").alias("r_v"), F.first("teams").alias("r_teams"))
    both = pairs.join(l1.hint("merge"), ["page", "turned"]).join(r1.hint("merge"), "match_id")
    common = F.size(F.array_intersect("l_teams", "r_teams"))
    # teams: the mean over the page's names of the best score of a name of the match
    best = F.aggregate(F.transform("l_v", lambda x: F.array_max(F.transform("r_v", lambda y: _dice(x, y)))), F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0)))
    d = both.withColumns({"d_date": _dice(F.col("lv_date"), F.col("rv_date")), "d_home": _dice(F.col("lv_home"), F.col("rv_home")), "d_away": _dice(F.col("lv_away"), F.col("rv_away")), "d_team": F.when(F.size("l_v") > 0, (best + F.when(F.size("l_teams") > 0, common).otherwise(0)) / (F.size("l_v") + F.size("l_teams")))})
    return d.select("page", "match_id", "known", "d_date", "d_home", "d_away", "d_team", F.col("turned").alias("d_turned"), "differ")


def _features() -> list[Column]:
    """A missing field says nothing: it counts as half agreement."""
    return [F.coalesce(F.col(f"d_{f}"), F.lit(0.5)) for f in FEATURES]


def least(hashed: DataFrame, n: int) -> DataFrame:
    """The rows of ``hashed(h)`` up to a bound of ``h``: the n with the least hashes and a 4096th of all or so
    more, so that an order with a limit, of which every partition sends n rows, has few to send."""
    bucket, held = F.shiftright("h", 52), 0
    for b, count in sorted(hashed.groupBy(bucket.alias("b")).count().collect()):
        held += count
        if held >= n:
            return hashed.where(bucket <= b)
    return hashed


def fit(pairs: DataFrame) -> np.ndarray:
    """Weights of the confidence, by logistic regression towards PRIOR on at most MOST_FITTED
    candidate pairs of records whose match is known, in order of a hash."""
    known = pairs.where("known is not null").select(*[f.alias(f"x{k}") for k, f in enumerate(_features())], (F.col("known") == F.col("match_id")).cast("double").alias("y"), F.xxhash64("page", "match_id").alias("h"))
    sample = least(known, MOST_FITTED).orderBy("h").limit(MOST_FITTED).toPandas()
    x = np.c_[sample[[f"x{k}" for k in range(len(FEATURES))]].to_numpy(dtype=float), np.ones(len(sample))]
    y, w = sample["y"].to_numpy(dtype=float), PRIOR.copy()
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + (w - PRIOR)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w)), gradient)
        # a full step may overshoot where the known pairs are separable
        w = w - step * min(1.0, 1.0 / max(float(np.abs(step).max()), 1e-12))
    return w


def match(observations: DataFrame, teams: DataFrame, matches: DataFrame) -> DataFrame:
    """(observation_id, match_id, confidence): the match of each observation without one."""
    rows, records = pages(observations, teams)
    pairs = cut(candidates(records, matches.where("season_id div 10000 = 1"), teams))
    w = fit(pairs)
    z = sum((float(k) * f for k, f in zip(w, _features(), strict=False)), F.lit(float(w[-1])))
    scored = pairs.select("page", "match_id", (1 / (1 + F.exp(-z))).alias("confidence")).groupBy("page", "match_id").agg(F.max("confidence").alias("confidence"))
    levels = scored.groupBy("page", "confidence").agg(F.count("*").alias("n"), F.min("match_id").alias("match_id"))
    best = levels.groupBy("page").agg(F.max(F.struct("confidence", "n", "match_id")).alias("b"))
    # a runner-up as good as the best leaves the record undecided
    chosen = best.where((F.col("b.confidence") >= LEAST_CONFIDENCE) & (F.col("b.n") == 1)).select("page", "b.match_id", "b.confidence")
    return rows.where("known is null").join(chosen.hint("merge"), "page").select(F.col("id").alias("observation_id"), "match_id", "confidence").distinct()


def p6_found(matched: DataFrame) -> DataFrame:
    """(observation_id, match_id)."""
    return matched.select("observation_id", "match_id").distinct()
