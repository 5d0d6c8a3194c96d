import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from fieldmark.llm import canonical, matching, names, persons, survivors
from fieldmark.llm.components import components
from fieldmark.llm.segments import _swaps_as_one, segment_join


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def typed_like(words, rng):
    out = set(words[:60])
    for w in words:
        c = list(w)
        for _ in range(rng.randint(0, 2)):
            kind, i = rng.random(), rng.randrange(len(c)) if c else 0
            if kind < 0.6 and len(c) > 1:
                i = min(i, len(c) - 2)
                c[i], c[i + 1] = c[i + 1], c[i]
            elif kind < 0.75 and c:
                del c[i]
            else:
                c.insert(i, rng.choice("abcd"))
        out.add("".join(c))
    return [*out, "", None]


def test_segment_join_against_all_pairs(spark):
    rng = random.Random(7)
    words = list({"".join(rng.choices("abc", k=rng.randint(1, 12))) for _ in range(200)})
    typed = typed_like(words, rng)
    left, right = (spark.createDataFrame([(x,) for x in t], "text string") for t in (typed, words))
    got = {(r.left, r.right, r.edits) for r in segment_join(left, right).collect()}
    allowed = lambda n: 0 if n <= 3 else 1 if n <= 5 else 2 if n <= 7 else 3 if n == 8 else 4
    assert got == {(a, b, edits(a, b)) for a in typed if a for b in words if edits(a, b) <= allowed(len(b))}
    got = {(r.left, r.right, r.edits) for r in segment_join(left, right, lambda n: F.when(n < 6, 1).otherwise(2), 2, swaps=True).collect()}
    assert got == {(a, b, e) for a in typed if a for b in words if (e := _swaps_as_one(a, b, 2)) <= (1 if len(b) < 6 else 2)}


def test_near_surnames_lose_no_pair_that_the_verifier_accepts(spark):
    rng = random.Random(5)
    words = list({"".join(rng.choices("abe", k=rng.randint(2, 9))) for _ in range(150)}) + ["frye", "lyons", "henderson", "hendersonsmith", "smithhenderson"]
    typed = [*typed_like(words, rng), "fry", "lyosn", "hendresno"]
    left, right = (spark.createDataFrame([(x,) for x in t], "text string") for t in (typed, words))
    want = {(a, b) for a in typed if a for b in words if names.surname_edits(a, b) <= 2}
    assert {(r.left, r.right) for r in names.near_surnames(left, right).collect()} == want
    assert {(r.right, r.left) for r in names.near_surnames(right, left).collect()} == want


def test_names_of_one_surname_meet_only_where_their_given_names_may_be_one(spark):
    rng = random.Random(3)
    forms = sorted({x for full, shorts in names.SHORT_FORMS.items() for x in (full, *shorts.split())})
    givens = sorted({*forms, *(x for x in typed_like(rng.sample(forms, 80), rng) if x), *"abjrtw"})
    typed = [f"{g.title()} Henderson" for g in givens] + ["Henderson", "Henderson, Bob", "R. Hendresno", "Hendersen, Robret"]
    n = spark.createDataFrame([(x,) for x in typed], "name string")
    texts = spark.createDataFrame([(x,) for x in {x for t in typed for _, x in names.readings(t)}], "text string")
    near = names.near_surnames(texts, texts)
    got = {(r.name, r.other) for r in names.near_names(n, n, near).collect()}
    alike = {(a, b) for a, b in itertools.product(typed, repeat=2) if names.likeness(a, b)}
    assert alike <= got
    assert len(got) < 0.3 * len(typed) ** 2
    # much work on few bytes is not left to one task
    assert persons._alike(names.near_names(n, n, near)).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


@pytest.mark.parametrize("a, b", [("Fry", "Frye"), ("Lyons", "Lyosn"), ("Henderson", "Hendresno")])
def test_links_do_not_depend_on_the_order_of_keys(spark, a, b):
    for first, second in ((a, b), (b, a)):
        p = spark.createDataFrame([(10, "Ann", first, "1990-02-03", 180, 80), (11, "Ann", second, "1990-02-03", 180, 80)], "id long, first_name string, surname string, date_of_birth string, height_cm int, weight_kg int")
        assert [tuple(r) for r in survivors.duplicate_links(p).collect()] == [(10, 11)]


def test_swaps():
    assert _swaps_as_one("eflasteda", "elfastead", 4) == 2 and _swaps_as_one("abc", "abc", 1) == 0 and _swaps_as_one("abcdef", "uvwxyz", 2) == 3


def test_components_of_paths_and_hubs(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 50)] + [(7, 7), (300, 301)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[100 + k] for k in range(50)} == {100} and got[301] == 300
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize(
    "a, b, same",
    [
        ("Drarinine, Dermot", "DERMOT DRARININE", True), ("BASWINACH ALEXANDER", "Alexander Basswinach", True), ("Dave Ebkusky", "David Ebkusky", True), ("T. Quilfajaack", "Quilfajack, Theodore", True), ('Peter "Pete" Nolselmott', "Mr Peter Nolselmott", True), ("Daniel Remnivane", "Dominic Remnivane", False),
        ("Peter Semkelford", "Patrick Semkelford", False), ("Servisky, José M", "Jose Servisky", True), ("O'Hespacourt R", "RONALD O'HESPACOURT", True), ("Charles Urrowick", "Christopher Urrowick", False), ("Sam X", "Samantha X", True), ("", "Sam X", False), (None, None, False),
    ],
)
def test_names(a, b, same):
    assert (names.likeness(a, b) > 0) == same


TEAMS = [(1, "Gulgewick Wolves", "GULW", 1), (2, "Edruton Stags", "EDRS", 1), (3, "Corxaridge Herons", "CORH", 1), (4, "Fenmobrook Herons", "FENH", 1), (9, "Undreton Stags", "UNDS", 2)]


def test_typed_teams(spark):
    t = spark.createDataFrame(TEAMS, "id long, name string, abbreviation string, competition_id long")
    typed = {"gulgewick": 1, "The Stags (Edruton)": 2, "Edr uton Stags": 2, "Herons, Corxaridge": 3, "Fenmobrook Football Club": 4, "Gulgwecik Wolves": 1, "Tin Roof Brewing Edruton Stags": 2, "FENH": 4, "FenmobrookHerons": 4, "TBC": None, "World Team": None, "": None, "x" * 20_000: None}
    v = spark.createDataFrame([(x,) for x in [*typed, None, "TBC"]], "value string")
    got = {r.value: r.target for r in canonical.team_targets(v, t.where("competition_id = 1")).collect()}
    assert got == typed
    o = spark.createDataFrame([(1, "Edruton Stags", 0), (2, "edruton", 0), (2, "edruton", 0), (3, "TBC", 0), (4, None, 0)], "id long, raw_team string, name int")
    v = spark.createDataFrame([(1, "Jubilee Oval (Kilkomoor)", -38.0, 144.0, None), (2, "Jubilee Oval (Belruport)", -36.0, 146.0, None), (3, "Wilgaham Park", -36.3, 144.7, None), (4, "Bluegum Mutual Park Wilgaham", -36.3, 144.7, 3)], "id long, name string, latitude double, longitude double, canonical_venue_id long")
    g = [(10, "JUBILEE OVAL", -36.001, 146.002, None, 1), (11, "Jubilee", 144.0, -38.0, None, None), (12, "Jubilee Oval", None, None, "near Belruport station", None), (13, "Jubilee Oval", None, None, None, None), (14, "wilgahm pk", None, None, None, 2), (15, "Bluegum Mutual Park Wilgaham", 0.0, 0.0, None, None), (16, "neutral venue", None, None, None, 1), (17, None, None, None, None, None)]
    g = spark.createDataFrame(g, "venue_id long, name string, latitude double, longitude double, notes string, canonical_venue_id long")
    got = {(r.table_name[:5], r.row_key): r.target_id for r in canonical.p4_found(o, t, g, v).collect()}
    assert got == {("coach", 2): 2, ("coach", 3): -1, ("coach", 4): -1, ("venue", 10): 2, ("venue", 11): 1, ("venue", 12): 2, ("venue", 13): -1, ("venue", 14): 3, ("venue", 15): 3, ("venue", 16): -1, ("venue", 17): -1}


def test_keyless_matches(spark):
    rng = random.Random(3)
    t = spark.createDataFrame(TEAMS, "id long, name string, abbreviation string, competition_id long")
    ids = [1, 2, 3, 4]
    m = []
    for k in range(200):
        h, a = rng.sample(ids, 2)
        m.append((k, 12020, f"2020-{3 + k % 7:02d}-{1 + k % 28:02d}", None, h, a, rng.randint(40, 130), rng.randint(40, 130)))
    title = {i: n for i, n, _, _ in TEAMS}
    o, truth = [], {}
    for k in range(0, 200, 2):
        _, _, d, _, h, a, hp, ap = m[k]
        for n, team in enumerate((h, a)):
            typed, date, x, y = title[team], d, hp, ap
            case = k % 10
            if case == 2:
                date = None
            elif case == 4:
                x += 1
            elif case == 6:
                typed = "TBC" if n else typed.split()[0].upper()
            elif case == 8:
                date = f"{int(d[8:])} {('Mar Apr May Jun Jul Aug Sep').split()[int(d[5:7]) - 3]} 2020"
            o.append((2 * k + n, "p", f"g{k}", 2020, date, x, y, typed, k if k % 3 == 0 else None))
            if k % 3:
                truth[2 * k + n] = k
    o += [(5000, "p", "g-none", 2020, "2020-05-05", 199, 1, "World Team", None), (5001, "p", None, None, None, None, None, None, None), o[1]]
    obs = spark.createDataFrame([(*r, "x") for r in o], "id long, provider string, external_match_id string, season int, match_date string, home_points int, away_points int, raw_team string, match_id long, team string")
    matches = spark.createDataFrame(m, "id long, season_id long, date string, kickoff_at string, home_team_id long, away_team_id long, home_points int, away_points int")
    got = {r.observation_id: (r.match_id, r.confidence) for r in matching.match(obs, t, matches).collect()}
    right = sum(got.get(k, (None,))[0] == v for k, v in truth.items())
    assert right >= 0.97 * len(truth) and all(0 < c <= 1 for _, c in got.values())
    assert 5000 not in got and 5001 not in got
    assert matching.match(obs.limit(0), t, matches).collect() == []


def test_close_codes_against_all_pairs(spark):
    rng = random.Random(9)
    t = spark.createDataFrame([(i, n) for i, n, _, _ in TEAMS], "id long, name string")
    title = dict(t.collect())
    typed = lambda d, n: d if rng.random() > n else d + rng.randint(-9, 9)
    matches, pages_ = [], []
    for k in range(120):
        h, a = rng.sample(list(title), 2)
        day, x, y = dt.date(2020, rng.randint(3, 9), rng.randint(1, 28)), rng.randint(30, 130), rng.randint(30, 130)
        matches.append((k, 12020, day.isoformat(), None, h, a, x, y))
        # three fields may be a digit off at once
        date = dt.date(2020, day.month, min(28, max(1, typed(day.day, 0.5))))
        pages_.append((f"p{k}", 2020, None if k % 11 == 0 else date, None if k % 13 == 0 else typed(x, 0.5), typed(y, 0.5), [h, a], [title[h], title[a]], None))
    records = spark.createDataFrame(pages_, "page string, season int, date date, home_points int, away_points int, teams array<long>, names array<string>, known long")
    m = spark.createDataFrame(matches, "id long, season_id long, date string, kickoff_at string, home_team_id long, away_team_id long, home_points int, away_points int")
    got = {(r.page, r.match_id, r.d_turned) for r in matching.candidates(records, m, t).collect()}
    for p in pages_:
        for q in matches:
            for turned, (x, y) in enumerate(((p[3], p[4]), (p[4], p[3]))):
                if turned and x == y:
                    continue
                # chunks that differ for certain: year and month, day, all digits of the points but the last, the last
                date, there = p[2], dt.date.fromisoformat(q[2])
                apart = 0 if date is None else (date.month != there.month) + (date.day != there.day or date.month != there.month)
                for v, w in ((x, q[6]), (y, q[7])):
                    apart += 0 if v is None else (v // 10 != w // 10) + (v % 10 != w % 10)
                same_team = set(p[5]) & {q[4], q[5]}
                if None not in (p[2], x, y) and same_team and apart <= 3:
                    assert (p[0], q[0], float(turned)) in got


PLAYERS = "id long, first_name string, surname string, external_id string, external_afl_player_id string, date_of_birth string, height_cm int, weight_kg int, is_retired int, record_source string, updated_at timestamp, legacy_is_retired int, team string"


def players(spark):
    rows = [
        (1, None, "Unattributed", None, None, None, None, None, None, "club", 2017),
        (10, "Anthony", "Culsidew", "p1", None, "2001-08-13", 189, 83, None, "footywire", 2020),
        (11, "Ant", "CULSIDEW", None, "CD_1", "2001-01-01", 188, None, 0, "club", 2023),
        (12, "A.", "Culsidew", "p3", "CD_1", "2001-08-13", None, 84, 0, "afl-tables", 2021),
        (20, "Oliver", "Dalmoson", None, None, "1994-09-27", 182, 78, 0, "club", 2020),  # twins
        (21, "Otis", "Dalmoson", None, None, "1994-09-27", 184, 80, 0, "club", 2020),
        (30, "Joshua", "Tamorer", None, None, "1986-06-26", 193, 90, 0, "club", 2020),  # namesakes
        (31, "Joshua", "Tamorer", None, None, "1995-02-01", 184, 88, 0, "club", 2020),
        (40, "David", "Hessoson", None, None, "1986-04-01", 191, 83, 0, "club", 2020),
        (41, "David", "Hesoson", None, None, "1986-01-04", 191, 83, 0, "club", 2020),
        (50, None, None, None, None, None, None, None, None, None, 2020),
    ]
    return spark.createDataFrame([(*r[:-1], dt.datetime(r[-1], 1, 1), 0, "c") for r in rows], PLAYERS)


def test_duplicates_and_survivors(spark):
    p = players(spark)
    people = survivors.cut(survivors.persons(p.unionByName(p.limit(3))))
    sure = survivors.confirm(p, people)
    assert survivors.survivors(p, sure).count() == 8 and sorted(map(tuple, survivors.p5_found(sure).collect())) == [(10, 11), (10, 12), (40, 41)]
    # a record chained into the group, but in conflict with what its survivor is
    chained = people.selectExpr("player_id", "CASE WHEN player_id IN (40, 41) THEN 10L ELSE person_id END AS person_id")
    sure = survivors.confirm(p, chained)
    assert sorted(map(tuple, survivors.p5_found(sure).collect())) == [(10, 11), (10, 12), (40, 41)] and sure.count() == 11
    s = {r.person_id: r for r in survivors.survivors(p, people).collect()}
    r = s[10]
    assert (r.records, r.first_name, r.surname, r.external_afl_player_id, r.date_of_birth, r.is_retired, r.legacy_is_retired, r.record_source, r.updated_at.year) == (3, "Ant", "Culsidew", "CD_1", "2001-08-13", 0, 0, "club", 2023)
    assert s[50].surname is None and s[20].first_name == "Oliver" and len(s) == 8
    assert {r.player_id for r in survivors.repointed(p.selectExpr("id AS player_id", "'x' AS _person2"), people).collect()} == {1, 10, 20, 21, 30, 31, 40, 50}
    assert survivors.persons(p.limit(0)).count() == 0


def test_consensus_votes_by_token(spark):
    v = spark.createDataFrame([("g", "Mary Ann Smith", 1.0), ("g", "Mary Smith", 1.0), ("g", "Mary Anne Smith", 1.0), ("g", "Mary Ann Smyth", 1.5), ("g", "Mary Ann Smith", 1.0), ("h", None, 1.0)], "k string, value string, weight double")
    assert [tuple(r) for r in survivors.consensus(v, ["k"]).collect()] == [("g", "Mary Ann Smith")]
    # more spellings than one block holds
    many = [("g", f"Mary Ann Smit{chr(97 + k % 26)}{k // 26}", 1.0) for k in range(100)] + [("g", "Mary Ann Smith", 30.0), ("h", "x", 1.0)]
    assert {tuple(r) for r in survivors.consensus(spark.createDataFrame(many, "k string, value string, weight double"), ["k"]).collect()} == {("g", "Mary Ann Smith"), ("h", "x")}
    assert survivors.consensus(v.limit(0), ["k"]).collect() == []


def test_persons_of_vote_records_and_coaches(spark):
    p = players(spark)
    people = survivors.cut(survivors.persons(p))
    stats = spark.createDataFrame([(1, 5, 10), (1, 5, 20), (2, 5, 11), (2, 5, 20), (2, 5, 21), (3, 6, 30), (3, 6, 31)], "match_id long, team_id long, player_id long")
    b = [(1, 1, 5, None, "Anthony", "Culsidew"), (2, 2, 5, None, "Tony", "Culsidw"), (3, 2, 5, None, None, "Culsidew, Ant"), (4, 1, 5, None, "O", "Dalmoson"), (5, 2, 5, None, "O", "Dalmoson"), (6, 3, 6, 30, "Josh", "Tamorer"), (7, 3, 6, None, "Josh", "Tamorer"), (8, 1, 5, None, None, None), (9, 9, 9, None, "Anthony", "Culsidew"), (2, 2, 5, None, "Tony", "Culsidw"), (10, 2, 5, None, "Oliver", "DALMOSON")]
    b = spark.createDataFrame(b, "record_id long, matchid long, teamid long, playerid long, givenname string, surname string")
    got = {r.record_id: r.person_id for r in persons.vote_persons(b, p, stats, people).collect()}
    assert got == {1: 10, 2: 10, 3: 10, 4: 20, 6: 30, 10: 20}
    ids = spark.createDataFrame([("a", "1", "Urrowick, Charles"), ("f", "1", "Charles Urowick"), ("a", "2", "Christopher Urrowick"), ("f", "2", "C. Urrowick")], "provider string, external_coach_id string, display_name string")
    days = ["2020-05-02", "2020-05-09", "2020-05-16", "2020-05-23", "2020-05-30", "2020-06-06"]
    o, n = [], itertools.count(1)
    for d in days:
        o += [(next(n), "a", "1", "Urrowick, C", d, "Gulgewick Wolves"), (next(n), "f", "1", "C Urrowick", d, "Gulgewick"), (next(n), "a", "2", "C. Urrowick", d, "Edruton Stags"), (next(n), "f", "2", "C. Urrowick", d, "EDRUTON")]
    o += [(900, "a", "", "C. Urrowick", "2020-06-13", "Edruton"), (901, "f", None, "Charles Urrowick", "2020-06-13", "Gulgewick"), (902, "f", "", None, None, None)]
    o = spark.createDataFrame([(*r, 2020) for r in o], "id long, provider string, external_coach_id string, display_name string, match_date string, raw_team string, season int")
    t = spark.createDataFrame(TEAMS, "id long, name string, abbreviation string, competition_id long")
    got = {tuple(r) for r in persons.p2_found(persons.members(o, ids, b, t, p, stats, people)).collect() if not r.key_a.startswith("bp")}
    assert got == {("id:a:1", "id:f:1"), ("id:a:2", "id:f:2"), ("id:a:2", "ob:900"), ("id:f:1", "ob:901")}


def test_the_fitted_sample_is_bounded_before_partitions_send_theirs(spark):
    hashed = spark.range(0, 200_000, numPartitions=8).withColumn("h", F.xxhash64("id"))
    few = matching.least(hashed, 500)
    assert few.count() < 500 + 3 * 200_000 / 4096
    assert [r.h for r in few.orderBy("h").limit(500).collect()] == [r.h for r in hashed.orderBy("h").limit(500).collect()]
    assert matching.least(hashed, 300_000).count() == 200_000


def test_entries_of_matches_are_not_broadcast(spark, tmp_path):
    m = spark.createDataFrame([(1, 12023, "2023-04-01", None, 80, 71, 1, 2)], "id long, season_id long, date string, kickoff_at string, home_points int, away_points int, home_team_id long, away_team_id long")
    t = spark.createDataFrame([(1, "Penbemoor Wolves"), (2, "Nartecombe Owls")], "id long, name string")
    r = spark.createDataFrame([("p", 2023, dt.date(2023, 4, 1), 80, 71, [1], ["Penbemoor Wolves"], None)], "page string, season int, date date, home_points int, away_points int, teams array<long>, names array<string>, known long")
    # files have a size by which Spark chooses
    for name, df in (("r", r), ("m", m), ("t", t)):
        df.write.parquet(f"{tmp_path}/{name}")
    found = matching.candidates(*(spark.read.parquet(f"{tmp_path}/{name}") for name in "rmt"))
    assert "Broadcast" not in found._jdf.queryExecution().sparkPlan().toString()
    assert {(x.page, x.match_id) for x in found.collect()} == {("p", 1)}
