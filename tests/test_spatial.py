from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from linkrisk.functions import geo
from linkrisk.operators import matching, polygons

# Ends of links in national-grid metres, and points in degrees, with what is known of their distances.
LINKS = [
    ("17705", 416630.0, 430270.0, 417880.0, 430760.0), ("47441", 416829.0, 432711.0, 418060.0, 431107.0), ("47907", 417837.0, 434677.0, 416903.0, 434991.0),
    ("57940", 418539.0, 435618.0, 419046.0, 437266.0), ("58268", 416660.0, 433070.0, 417021.0, 433001.0), ("73112", 417490.0, 427900.0, 416630.0, 430270.0),
]
POINTS = [("2024131435296", -1.73085, 53.80833), ("2024131457805", -1.71291, 53.83033)]


def pieces(spark, rows=LINKS):
    return spark.createDataFrame(rows, "segment_id string, x1 double, y1 double, x2 double, y2 double")


def points(spark, rows):
    return spark.createDataFrame(rows, "collision_index string, x double, y double")


def test_projection_lands_on_whole_metres_and_returns(spark):
    rows = spark.createDataFrame([(-1.7491836369162654, 53.76851289530511), (-1.730191705235541, 53.77287583480627), (None, 53.0)], "longitude double, latitude double")
    there = geo.to_grid(rows)
    got = [(r.x, r.y) for r in there.collect()]
    for (x, y), (ex, ey) in zip(got[:2], [(416630.0, 430270.0), (417880.0, 430760.0)], strict=True):
        assert abs(x - ex) < 0.05 and abs(y - ey) < 0.05
    assert got[2] == (None, None)
    back = geo.to_degrees(there.select("x", "y").where("x is not null")).collect()
    for r, (lon, lat) in zip(back, [(-1.7491836369162654, 53.76851289530511), (-1.730191705235541, 53.77287583480627)], strict=True):
        assert abs(r.longitude - lon) < 1e-6 and abs(r.latitude - lat) < 1e-6


def test_known_matches(spark):
    ends = [
        ("47907", -1.7306188907488809, 53.80808277548166, -1.7447848094716059, 53.810935942992316),
        ("57940", -1.7199025224727509, 53.816515928916935, -1.7121006315498493, 53.831309617083434),
        ("17705", -1.7491836369162654, 53.76851289530511, -1.730191705235541, 53.77287583480627),
    ]
    links = geo.to_grid(spark.createDataFrame(ends, "segment_id string, a1 double, b1 double, a2 double, b2 double"), "a1", "b1", "x1", "y1")
    links = geo.to_grid(links, "a2", "b2", "x2", "y2")
    at = geo.to_grid(spark.createDataFrame(POINTS, "collision_index string, longitude double, latitude double"))
    got = {r.collision_index: r for r in matching.match(at, links).collect()}
    assert (got["2024131435296"].segment_id, got["2024131435296"].distance_m) == ("47907", 21.13)
    assert (got["2024131457805"].segment_id, got["2024131457805"].distance_m) == ("57940", 18.38)
    assert {r.match_status for r in got.values()} == {"accepted"}


def test_equal_lines_are_ambiguous_and_far_points_name_their_nearest(spark):
    lines = pieces(spark, [("a", 0.0, 0.0, 100.0, 0.0), ("b", 0.0, 0.0, 100.0, 0.0)])
    got = {r.collision_index: r for r in matching.match(points(spark, [("p", 50.0, 5.0), ("q", 5000.0, 0.0), ("n", None, None)]), lines).collect()}
    assert (got["p"].match_status, got["p"].segment_id, got["p"].candidate_count, got["p"].nearest_segment_id) == ("ambiguous", None, 2, "a")
    assert (got["q"].match_status, got["q"].nearest_segment_id, got["q"].distance_m) == ("out_of_range", "a", 4900.0)
    assert (got["n"].match_status, got["n"].nearest_segment_id) == ("out_of_range", None)


def test_limits_are_inclusive(spark):
    lines = pieces(spark, [("a", 0.0, 0.0, 0.0, 0.0), ("b", 0.0, 60.0, 10.0, 60.0)])
    got = {r.collision_index: r.match_status for r in matching.match(points(spark, [("50", 0.0, -50.0), ("51", 0.0, -50.5), ("10", 0.0, 25.0), ("11", 0.0, 24.0)]), lines).collect()}
    assert got == {"50": "accepted", "51": "out_of_range", "10": "ambiguous", "11": "accepted"}


def _distance(px, py, x1, y1, x2, y2):
    d = (x2 - x1) ** 2 + (y2 - y1) ** 2
    t = max(0.0, min(1.0, ((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / d)) if d else 0.0
    return math.hypot(px - x1 - t * (x2 - x1), py - y1 - t * (y2 - y1))


def test_joins_equal_brute_force(spark):
    rnd = random.Random(5)
    lines = [(f"s{k % 30:02}", rnd.uniform(0, 9000), rnd.uniform(0, 9000), rnd.uniform(0, 9000), rnd.uniform(0, 9000)) for k in range(60)]
    at = [(str(k), rnd.uniform(-500, 9500), rnd.uniform(-500, 9500)) for k in range(200)]
    want = {}
    for i, x, y in at:
        for s, *c in lines:
            want[i, s] = min(want.get((i, s), 1e9), _distance(x, y, *c))
    got = {(r[0], r[1]): r[2] for r in matching.within_distance(points(spark, at), pieces(spark, lines), 120.0).collect()}
    assert got.keys() == {k for k, d in want.items() if d <= 120.0}
    assert all(abs(d - want[k]) < 1e-6 for k, d in got.items())
    near = {r[0]: r[2] for r in matching.nearest(points(spark, at), pieces(spark, lines), cell=20.0).collect()}
    assert len(near) == 200 and all(abs(d - min(want[i, s[0]] for s in lines)) < 1e-6 for i, d in near.items())


def test_distance_join_has_no_nested_loop(spark):
    plan = matching.within_distance(points(spark, [("1", 0.0, 0.0)]), pieces(spark), 50.0)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_area_join_counts_borders_and_falls_back(spark):
    square = [("a", 0.0, 0.0, 1000.0, 0.0), ("a", 1000.0, 0.0, 1000.0, 1000.0), ("a", 1000.0, 1000.0, 0.0, 1000.0), ("a", 0.0, 1000.0, 0.0, 0.0)]
    edges = spark.createDataFrame(square, "area_id string, x1 double, y1 double, x2 double, y2 double")
    at = points(spark, [("in", 500.0, 500.0), ("edge", 1000.0, 500.0), ("corner", 0.0, 0.0), ("near", 1400.0, 500.0), ("far", 1600.0, 500.0)])
    assert {r[0] for r in polygons.in_area(at, edges, point_id="collision_index").collect()} == {"in", "edge", "corner"}
    classes = spark.createDataFrame([("a", "urban")], "area_id string, urban_rural string")
    got = dict(polygons.classify(at, edges, classes, point_id="collision_index").collect())
    assert got == {"in": "urban", "edge": "urban", "corner": "urban", "near": "urban", "far": None}


@pytest.mark.parametrize(("line", "meets"), [((0.0, 0.0, 10.0, 10.0), True), ((0.0, 5.0, 3.0, 5.0), False), ((4.0, 0.0, 4.0, 20.0), True), ((0.0, 8.0, 8.0, 16.0), False), ((0.0, 4.0, 4.0, 0.0), False), ((4.0, 4.0, 4.0, 4.0), True)])
def test_line_meets_box(spark, line, meets):
    rows = pieces(spark, [("a", *line)])
    assert (matching.lines_in_box(rows, (4.0, 4.0, 8.0, 8.0)).count() == 1) is meets
    if meets:
        x, y = matching.clipped_point(rows, (4.0, 4.0, 8.0, 8.0)).select("x", "y").first()
        assert 4 <= x <= 8 and 4 <= y <= 8


def test_long_pieces_are_cut_exactly(spark):
    cut = matching.split_pieces(pieces(spark, [("a", 0.0, 0.0, 1000.0, 0.0)]), 300.0).orderBy("x1").collect()
    assert [(r.x1, r.x2) for r in cut][0][0] == 0.0 and cut[-1].x2 == 1000.0 and len(cut) == 4
    assert matching.line_length(pieces(spark)).where(F.col("segment_id") == "17705").first()[1] == pytest.approx(1.3426, abs=1e-4)


def test_nearest_of_far_points_and_within_years(spark):
    rnd = random.Random(8)
    lines = [(f"s{k}", y, *(rnd.uniform(0, 3000) for _ in range(4))) for k in range(60) for y in (1, 2)]
    at = [(f"p{k}", 1 + k % 3, rnd.choice([rnd.uniform(0, 3000), 5e6, -7e5]), rnd.uniform(-2000, 4000)) for k in range(80)] + [("q", 1, None, 3.0)]
    table = spark.createDataFrame(lines, "segment_id string, y int, x1 double, y1 double, x2 double, y2 double")
    got = {r[0]: r[1:] for r in matching.nearest(spark.createDataFrame(at, "collision_index string, y int, x double, y double".replace("y double", "yy double")).withColumnsRenamed({"y": "year", "yy": "y"}), table.withColumnRenamed("y", "year"), cell=50.0, by=("year",)).collect()}

    def gap(x, y, x1, y1, x2, y2):
        t = max(0.0, min(1.0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2)))
        return ((x - x1 - t * (x2 - x1)) ** 2 + (y - y1 - t * (y2 - y1)) ** 2) ** 0.5

    for p, year, x, y in at:
        want = min(((gap(x, y, *c), s) for s, own, *c in lines if own == year), default=None) if x is not None else None
        assert (p in got) == (want is not None)
        if want:
            assert got[p][0] == want[1] and abs(got[p][1] - want[0]) < 1e-6 * (1 + want[0])


def test_one_id_in_two_years_stays_apart(spark):
    table = spark.createDataFrame([("a", 1995, 0.0, 0.0, 10.0, 0.0), ("b", 1996, 0.0, 5.0, 10.0, 5.0)], "segment_id string, year int, x1 double, y1 double, x2 double, y2 double")
    at = spark.createDataFrame([("p", 1995, 5.0, 5.0), ("p", 1996, 5.0, 5.0), ("q", 1995, 5.0, 900.0), ("q", 1996, 5.0, 900.0)], "collision_index string, year int, x double, y double")
    got = {(r.collision_index, r.year): (r.match_status, r.segment_id, r.nearest_segment_id, r.distance_m, r.candidate_count) for r in matching.match(at, table, by=("year",)).collect()}
    assert got == {
        ("p", 1995): ("accepted", "a", "a", 5.0, 1), ("p", 1996): ("accepted", "b", "b", 0.0, 1),
        ("q", 1995): ("out_of_range", None, "a", 900.0, 0), ("q", 1996): ("out_of_range", None, "b", 895.0, 0),
    }


@pytest.mark.parametrize("spread", [400.0, 0.0])
def test_full_cells_are_cut_and_change_nothing(spark, monkeypatch, spread):
    rnd = random.Random(9)
    # nine of ten points and lines in one cell, with ``spread`` 0 even in one place
    at = [(f"p{k}", 100 + rnd.uniform(0, spread), 100 + rnd.uniform(0, spread)) if k % 10 else (f"p{k}", rnd.uniform(-3000, 3000), rnd.uniform(-3000, 3000)) for k in range(600)]
    lines = []
    for k in range(300):
        x, y = (100 + rnd.uniform(0, spread), 100 + rnd.uniform(0, spread)) if k % 10 else (rnd.uniform(-3000, 3000), rnd.uniform(-3000, 3000))
        lines.append((f"s{k}", x, y, x + rnd.uniform(-40, 40), y + rnd.uniform(-40, 40)))
    plain = {(r[0], r[1]): r[2] for r in matching.within_distance(points(spark, at), pieces(spark, lines), 30.0).collect()}
    monkeypatch.setattr(matching, "FULL", 40)
    found = matching._meetings(points(spark, at), pieces(spark, lines), 30.0, 500.0, (), "collision_index", "segment_id")
    cut = {(r[0], r[1]): r[2] for r in matching.within_distance(points(spark, at), pieces(spark, lines), 30.0).collect()}
    assert cut == plain and len(plain) > 500
    if spread:  # fewer pairs meet than in the whole cell
        assert found.count() < 540 * 270 / 4
    # the join's keys: no side has more than the bound of one key
    sides = [n for n in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join Inner" in n]
    assert any("_i" in n and "_j" in n for n in sides)


def test_dense_points_are_bounded_by_key(spark, monkeypatch):
    monkeypatch.setattr(matching, "FULL", 50)
    taken = []
    join = type(pieces(spark)).join
    monkeypatch.setattr(type(pieces(spark)), "join", lambda self, other, on=None, how=None: taken.append((self, other, on)) or join(self, other, on, how))
    at = [(f"p{k}", 250.0, 250.0) for k in range(900)] + [(f"q{k}", float(k), 3000.0) for k in range(100)]
    lines = [(f"s{k}", 240.0, 240.0, 260.0, 260.0) for k in range(120)]
    matching._meetings(points(spark, at), pieces(spark, lines), 30.0, 500.0, (), "collision_index", "segment_id")
    left, right, keys = taken[-1]
    assert "_i" in keys and "_j" in keys
    for side in (left, right):
        assert side.groupBy(*keys).count().agg(F.max("count")).first()[0] <= 100  # twice the bound, as hashes deal
    assert left.select("collision_index").distinct().count() == 1000


def test_a_point_in_an_unclassified_area_has_no_class(spark):
    box = lambda k, x: [(k, x, 0.0, x + 1000.0, 0.0), (k, x + 1000.0, 0.0, x + 1000.0, 1000.0), (k, x + 1000.0, 1000.0, x, 1000.0), (k, x, 1000.0, x, 0.0)]
    edges = spark.createDataFrame([*box("a", 0.0), *box("b", 1000.0), *box("c", 3000.0)], "area_id string, x1 double, y1 double, x2 double, y2 double")
    at = points(spark, [("in a", 500.0, 500.0), ("in b", 1100.0, 500.0), ("border", 1000.0, 500.0), ("near b", 2100.0, 500.0), ("near c", 2900.0, 500.0), ("none", None, 1.0)])
    classes = spark.createDataFrame([("a", "urban"), ("b", None), ("c", "rural")], "area_id string, urban_rural string")
    got = dict(polygons.classify(at, edges, classes, point_id="collision_index").collect())
    assert got == {"in a": "urban", "in b": None, "border": "urban", "near b": None, "near c": "rural", "none": None}


def test_slabs_equal_brute_force_and_bound_what_meets(spark):
    rnd, edges = random.Random(4), []
    for k, n in enumerate((400, 7, 3)):
        radii = [rnd.uniform(600, 1500) for _ in range(n)]
        ring = [(1000 * k + round(r * math.cos(6.283185307 * i / n), 0), round(r * math.sin(6.283185307 * i / n), 0)) for i, r in enumerate(radii)]
        edges += [(f"a{k}", *ring[i], *ring[(i + 1) % n]) for i in range(n)]
    edges += [("flat", 0.0, 5.0, 100.0, 5.0), ("flat", 100.0, 5.0, 0.0, 5.0)]
    at = [(str(i), float(rnd.randint(-1600, 3600)), float(rnd.randint(-1600, 1600))) for i in range(400)] + [(f"v{i}", e[1], e[2]) for i, e in enumerate(edges[::9])] + [("flat", 50.0, 5.0)]

    def inside(x, y, ring):
        if any(_distance(x, y, *e[1:]) <= 1e-9 for e in ring):
            return True
        return sum((y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 for _, x1, y1, x2, y2 in ring) % 2 == 1

    rings = {k: [e for e in edges if e[0] == k] for k in {e[0] for e in edges}}
    want = {(i, k) for i, x, y in at for k, ring in rings.items() if inside(x, y, ring)}
    table = spark.createDataFrame(edges, "area_id string, x1 double, y1 double, x2 double, y2 double")
    assert {tuple(r) for r in polygons.in_area(points(spark, at), table, point_id="collision_index").collect()} == want


def test_copies_of_points_and_lines_meet_once(spark, monkeypatch):
    at = [(f"p{k}", 50.0, 5.0) for k in range(60)] + [(f"q{k}", 50.0, 900.0) for k in range(60)] + [("twice", 50.0, 5.0), ("twice", 50.0, 40.0), (None, 50.0, 5.0), ("n", None, 1.0)]
    lines = [(f"s{k:02}", 0.0, 0.0, 100.0, 0.0) for k in range(30)] + [("s00", 0.0, 10.0, 100.0, 10.0)]
    met, meetings = [], matching._meetings
    monkeypatch.setattr(matching, "_meetings", lambda *a: met.append(meetings(*a)) or met[-1])
    for full in (50_000, 20):  # with 20 the points of a place are dealt
        monkeypatch.setattr(matching, "FULL", full)
        pairs = [tuple(r) for r in matching.within_distance(points(spark, at), pieces(spark, lines), 45.0).collect()]
        want = [(p, f"s{k:02}", 5.0) for p in [f"p{k}" for k in range(60)] + [None, "twice"] for k in range(30)]
        assert sorted(pairs, key=repr) == sorted(want, key=repr)
        got = {r.collision_index: r for r in matching.match(points(spark, at), pieces(spark, lines)).collect()}
        assert len(got) == 123 and {got[f"p{k}"].candidate_count for k in range(60)} == {30} and got["twice"].candidate_count == 30 and got[None].candidate_count == 0
        assert {(got[f"q{k}"].nearest_segment_id, got[f"q{k}"].distance_m) for k in range(60)} == {("s00", 890.0)} and got["n"].nearest_segment_id is None
    # two places of points (and that of the repeated id) and two shapes of lines
    assert sum(df.count() for df in met) <= 6 * len(met)


def test_many_pairs_have_many_tasks_and_are_rounded_by_place(spark, monkeypatch):
    rnd = random.Random(12)
    places = [(rnd.uniform(0, 900), rnd.uniform(0, 900)) for _ in range(40)]
    at = [(f"p{k}", *places[k % 40]) for k in range(400)] + [("twice", *places[0]), ("twice", *places[1]), ("zero", 0.0, 300.0), ("less", -0.0, 300.0)]
    lines = [(f"s{k:02}", *(rnd.uniform(0, 900) for _ in range(4))) for k in range(30)] + [("left", 0.0, 290.0, 1.0, 310.0)]
    exact = {}
    for i, x, y in at:
        for s, *c in lines:
            exact[i, s] = min(exact.get((i, s), 1e9), _distance(x, y, *c))
    want = {k: round(d, 3) for k, d in exact.items() if d <= 45.0}
    monkeypatch.setattr(matching, "PAIRS", 50)
    for full in (50_000, 5):  # with 5 the points of a place are dealt
        monkeypatch.setattr(matching, "FULL", full)
        pairs = matching.within_distance(points(spark, at), pieces(spark, lines), 45.0, digits=3)
        assert "round(" not in pairs._jdf.queryExecution().optimizedPlan().toString()  # the pairs get what is rounded once a place
        rows = pairs.collect()
        assert len(rows) == len(want) > 500 and {(r[0], r[1]): r[2] for r in rows} == want
        alone = matching.within_distance(points(spark, [p for p in at if p[0] != "twice"]), pieces(spark, lines), 45.0, digits=3)
        assert alone.rdd.getNumPartitions() >= len(want) / 50 / 2  # the session's own number is 4


def test_pairs_of_a_place_are_not_shuffled(spark, monkeypatch):
    """The two nearest lines of a place are found in the tasks of the join, from bundles of equal lines."""
    rnd = random.Random(3)
    at = [(f"p{k}", rnd.uniform(0, 900), rnd.uniform(0, 900)) for k in range(200)]
    own = [tuple(rnd.uniform(0, 900) for _ in range(4)) for _ in range(40)]
    lines = [(f"s{(7 * k + n) % 400:03}", *c) for k, c in enumerate(own) for n in range(0, 400 if k == 0 else 1, 100)] + [("t0", *own[3]), ("t0", *own[4]), ("t1", *own[4]), ("t1", *own[3])]
    near, kept = [], matching.stored
    monkeypatch.setattr(matching, "stored", lambda df, label: near.append((label, df._jdf.queryExecution().executedPlan().toString())) or kept(df, label))
    got = {r.collision_index: r for r in matching.match(points(spark, at), pieces(spark, lines)).collect()}
    top = next(plan for label, plan in near if label == "top")
    assert top.count("Exchange") == 2  # places and pieces, by their cells
    for p, x, y in at:
        each: dict[str, float] = {}
        for s, *c in lines:
            each[s] = min(each.get(s, math.inf), _distance(x, y, *c))
        order = sorted((d, s) for s, d in each.items())
        close = [d for d, _ in order if d <= 50]
        r = got[p]
        assert r.nearest_segment_id == order[0][1] and r.candidate_count == len(close) and abs(r.distance_m - order[0][0]) < 0.006
        assert r.match_status == ("out_of_range" if not close else "ambiguous" if len(close) > 1 and close[1] - close[0] <= 10 else "accepted")
        assert (r.second_distance_m is None) == (len(close) < 2) and (len(close) < 2 or abs(r.second_distance_m - close[1]) < 0.006)
