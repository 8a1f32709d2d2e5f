from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkrisk.functions import rates
from linkrisk.operators import baseline, evidence, gates, metrics, nb2, panel, ranking, screening, selection, serving
from linkrisk.operators.gates import ValidationError

CONTRACT = panel.Contract((2019, 2020, 2021, 2022), (2023,), (2024,))
PANEL_SCHEMA = """segment_key string, segment_id string, count_point_id long, source_year int, year int, road_number string, road_category string, road_type string, local_authority_id int,
 local_authority_name string, local_authority_code string, estimation_method string, all_motor_vehicles long, link_length_km double, annual_vehicle_km double, collision_count long, ksi_count long, urban_rural string"""


def panel_rows(years, urban="urban"):
    return [(f"k{i}", f"s{i}-{y}", i, y, y, "A1", "PA", "Major", i, f"LA{i}", f"E{i}", "Counted", 1000, 1.0, 365000.0, 2, 1, urban) for y in years for i in (1, 2)]


def frame(spark, rows):
    return spark.createDataFrame(rows, PANEL_SCHEMA)


# ---- gates --------------------------------------------------------------------------------


def test_column_and_key_gates(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), (None, 4), ("b", 5)], "k string, v int")
    with pytest.raises(ValidationError, match="missing columns: x, y"):
        gates.require_columns(df, ["k", "y", "x"])
    assert gates.duplicate_rows(df, "k").first()[0] == 4
    assert {r.v: r.is_duplicated for r in gates.flag_duplicates(df, "k").collect()} == {1: True, 2: True, 3: True, 4: True, 5: False}
    with pytest.raises(ValidationError, match="4 duplicate"):
        gates.require_unique(df, "k")
    gates.require_unique(df, "k", "v")


def test_year_and_domain_gates(spark):
    df = spark.createDataFrame([("1", 2019, 1), ("2", 2020, 4), ("3", 2020, None)], "collision_index string, collision_year int, collision_severity int")
    assert gates.years_of(df, "collision_year") == [2019, 2020]
    with pytest.raises(ValidationError):
        gates.single_year(df)
    with pytest.raises(ValidationError, match="no rows for 2021"):
        gates.require_year(df, 2021)
    with pytest.raises(ValidationError, match="Found 1"):
        gates.require_none(df, gates.outside_domain(F.col("collision_severity"), (1, 2, 3)), "Found {n} severities")
    row = gates.source_coverage(df, [2018, 2019]).first()
    assert (row.collision_records, row.available_year_min, row.available_year_max, row.missing_years, row.valid) == (3, 2019, 2020, [2018], False)
    with pytest.raises(ValidationError, match="2019"):
        gates.require_coverage(df, [2019], mode="exact")
    gates.require_coverage(df, [2019, 2020], mode="exact")
    gates.require_coverage(df, [2020])
    lookup = spark.createDataFrame([("urban",), ("suburban",), (None,)], "urban_rural string")
    with pytest.raises(ValidationError, match="suburban"):
        gates.require_urban_rural(lookup)


def test_link_and_manifest_gates(spark):
    links = spark.createDataFrame([("a", 1), ("b", 1)], "segment_id string, count_point_id long")
    with pytest.raises(ValidationError, match="Count points"):
        gates.require_links(links)
    with pytest.raises(ValidationError, match="No road links"):
        gates.require_links(links.limit(0))
    now = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("d", 4, "z")], "filename string, bytes long, sha256 string")
    old = spark.createDataFrame([("a", 1, "x"), ("b", 3, "y"), ("c", 3, "w")], "filename string, bytes long, sha256 string")
    assert dict(gates.manifest_status(now, old).collect()) == {"a": "ok", "b": "changed", "c": "missing", "d": "extra"}


# ---- evidence and panel --------------------------------------------------------------------


def test_evidence_counts_and_rates(spark):
    links = spark.createDataFrame([("s1", 1, "A1"), ("s2", 2, "A2"), ("s3", 3, "A3")], "segment_id string, count_point_id long, road_number string")
    traffic = spark.createDataFrame([(1, 2024, 1000, 2.0, "Counted", "E1"), (2, 2024, 0, 1.0, "Estimated", "E2")], "count_point_id long, year int, all_motor_vehicles long, link_length_km double, estimation_method string, local_authority_code string")
    matches = spark.createDataFrame([("c1", "accepted", "s1"), ("c2", "accepted", "s1"), ("c3", "ambiguous", None), ("c4", "out_of_range", None)], "collision_index string, match_status string, segment_id string")
    collisions = spark.createDataFrame([("c1", 1), ("c2", 3), ("c3", 1), ("c4", 2)], "collision_index string, collision_severity int")
    got = evidence.segment_evidence(links, traffic, evidence.accepted_counts(matches, collisions)).collect()
    assert [(r.segment_id, r.collision_count, r.ksi_count, r.annual_vehicle_km, r.urban_rural) for r in got] == [("s1", 2, 1, 730000.0, None), ("s2", 0, 0, 0.0, None), ("s3", 0, 0, None, None)]
    assert got[0].collision_rate_per_100m_vehicle_km == pytest.approx(2 / 730000 * 1e8)
    assert got[1].collision_rate_per_100m_vehicle_km is None and got[2].collision_rate_per_100m_vehicle_km is None
    assert tuple(evidence.match_quality(matches).first()) == (4, 2, 1, 1, 0.5)


def test_union_widens_and_fills(spark):
    a = spark.createDataFrame([(1, 2)], "x int, y int")
    b = spark.createDataFrame([(1.5, "q")], "x double, z string")
    c = spark.createDataFrame([("t",)], "y string")
    got = panel.union_relaxed([a, b, c])
    assert dict(got.dtypes) == {"x": "double", "y": "string", "z": "string"}
    assert {tuple(r) for r in got.collect()} == {(1.0, "2", None), (1.5, None, "q"), (None, "t", None)}


def test_panel_is_ready(spark):
    years = range(2019, 2025)
    built = panel.build_panel([frame(spark, panel_rows([y])) for y in years])
    row = panel.readiness(built, CONTRACT).first()
    assert (row.status, row.blockers, row.readiness_score, row.segments_with_complete_history, row.geographic_groups) == ("ready-for-evaluation", "", 1.0, 2, 2)
    assert [tuple(r) for r in panel.panel_years(built).collect()] == [(y, 2, 2) for y in years]


def test_panel_blockers_keep_their_order(spark):
    rows = frame(spark, panel_rows([2024])).drop("urban_rural")
    row = panel.readiness(rows, CONTRACT).first()
    assert (row.status, row.blockers) == ("blocked", "missing_contract_years,missing_subgroup_fields")
    assert row.missing_years == "2019,2020,2021,2022,2023" and row.missing_subgroups == "urban_rural"
    assert [r[0] for r in panel.missing_years(rows, CONTRACT).collect()] == [2019, 2020, 2021, 2022, 2023]
    bad = frame(spark, [(*r[:14], None, r[15], -1, " ") for r in panel_rows(range(2019, 2025))])
    row = panel.readiness(bad, CONTRACT).first()
    assert row.blockers == "incomplete_subgroup_values,invalid_exposure_rows,invalid_target_rows" and row.incomplete_subgroup_rows == "urban_rural=12"


def test_panel_gates(spark):
    rows = panel_rows([2019])
    with pytest.raises(ValidationError, match="duplicate"):
        panel.build_panel([frame(spark, rows), frame(spark, rows)])
    with pytest.raises(ValidationError, match="inconsistent"):
        panel.build_panel([frame(spark, [(*r[:3], 2018, *r[4:]) for r in rows])])
    with pytest.raises(ValidationError, match="missing columns"):
        panel.build_panel([frame(spark, rows).drop("year")])
    with pytest.raises(ValidationError, match="overlap"):
        panel.Contract((2019,), (2019,), (2020,))


# ---- screening and ranks --------------------------------------------------------------------


def test_screening_order_and_proxies(spark):
    rows = [("dft-count-point-1", 2023, 1e6, 2, 0, None), ("dft-count-point-1", 2024, 1e6, 2, 1, "A1"), ("dft-count-point-2", 2024, 1e6, 4, 2, "A2")]
    df = spark.createDataFrame([r for r in rows], "segment_key string, year int, annual_vehicle_km double, collision_count long, ksi_count long, road_number string")
    got = screening.screen(df).orderBy("screening_rank").collect()
    assert [r.segment_key for r in got] == ["dft-count-point-2", "dft-count-point-1"]
    assert [r.ksi_rate_per_million_vehicle_km for r in got] == [2.0, 0.5]
    assert [r.ksi_rate_standard_error_proxy for r in got] == pytest.approx([math.sqrt(2), 0.5])
    assert {r.screening_stability for r in got} == {"interpret_with_caution"} and got[1].road_number == "A1" and got[1].years_observed == 2
    assert [r.segment_key for r in screening.top_segments(df, 1).collect()] == ["dft-count-point-2"]


def test_ranks_equal_a_global_sort(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choice("abc"), rnd.randint(0, 20)) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, g string, v int")
    got = {r.id: r.r for r in ranking.ranked(df, [F.desc("v"), F.asc("id")], "r").collect()}
    assert got == {r[0]: k + 1 for k, r in enumerate(sorted(rows, key=lambda r: (-r[2], r[0])))}
    by = {r.id: r.r for r in ranking.ranked(df, [F.desc("v"), F.asc("id")], "r", by=("g",)).collect()}
    for g in "abc":
        own = sorted((r for r in rows if r[1] == g), key=lambda r: (-r[2], r[0]))
        assert all(by[r[0]] == k + 1 for k, r in enumerate(own))


def test_rank_has_no_single_partition_window(spark):
    plan = ranking.ranked(spark.range(10), [F.asc("id")], "r")._jdf.queryExecution().executedPlan().toString()
    for window in plan.split("Window [")[1:]:
        assert "row_number" not in window.split("]")[0] or "_range" in window.split("\n")[0]


# ---- models -----------------------------------------------------------------------------------


def test_baseline_golden(spark):
    rows = [("a", 2019, 1e6, 2), ("b", 2020, 1e6, 2), ("c", 2021, 1e6, 3), ("d", 2022, 1e6, 3), ("a", 2023, 1e6, 0), ("a", 2024, 1e6, 2)]
    df = spark.createDataFrame(rows, "segment_key string, year int, annual_vehicle_km double, ksi_count long")
    assert baseline.training_rate(df.where("year < 2023")).first().training_rate_per_million_vehicle_km == 2.5
    out = baseline.exposure_baseline(df, CONTRACT)
    assert [r.expected_ksi for r in out.collect()] == [2.5, 2.5]
    both = metrics.error_metrics(out.withColumn("evaluation_split", F.lit("all"))).first()
    assert both.mae == 1.5 and both.rmse == pytest.approx(math.sqrt(3.25))
    with pytest.raises(ValidationError, match="invalid"):
        baseline.exposure_baseline(df.withColumn("annual_vehicle_km", F.lit(0.0)), CONTRACT)
    with pytest.raises(ValidationError, match="No scoring"):
        baseline.exposure_baseline(df.where("year < 2023"), CONTRACT)


def test_detailed_metrics_equal_numpy(spark):
    rnd = np.random.default_rng(4)
    y, mu = rnd.poisson(1.5, 57), rnd.gamma(2.0, 0.7, 57)
    df = spark.createDataFrame([(f"k{i:02}", 2024, int(a), float(b), "test") for i, (a, b) in enumerate(zip(y, mu, strict=True))], "segment_key string, year int, ksi_count long, expected_ksi double, evaluation_split string")
    got = metrics.detailed_metrics(df).first()
    k = math.ceil(5.7)
    top = y[np.argsort(-mu, kind="stable")[:k]].sum()
    dev = 2 * sum((a * math.log(a / b) - (a - b)) if a else b for a, b in zip(y.tolist(), mu.tolist(), strict=True))
    assert got.mae == pytest.approx(np.abs(y - mu).mean()) and got.rmse == pytest.approx(np.sqrt(((y - mu) ** 2).mean())) and got.poisson_deviance == pytest.approx(dev)
    assert got.precision_at_10_percent == pytest.approx(top / k) and got.lift_at_10_percent == pytest.approx(top / y.sum() / (k / 57)) and got.calibration_ratio == pytest.approx(y.sum() / mu.sum())


@pytest.mark.parametrize("alpha", [0.7, 2.0])
def test_count_model_recovers_its_parameters(spark, alpha):
    rnd = np.random.default_rng(8)
    n = 5000
    cat, area, e = rnd.choice(["A", "B"], n), rnd.choice(["rural", "urban"], n), rnd.uniform(0.5e6, 2e6, n)
    mu = e * np.exp(-13.5 + 0.4 * (cat == "B") - 0.3 * (area == "urban"))
    y = rnd.poisson(rnd.gamma(1 / alpha, alpha * mu))
    df = spark.createDataFrame(list(zip(cat.tolist(), area.tolist(), e.tolist(), y.tolist(), strict=True)), "road_category string, urban_rural string, annual_vehicle_km double, ksi_count long")
    model = nb2.fit(df, nb2.feature_specs(df))
    assert model.names == ["intercept", "road_category=B", "urban_rural=urban"]
    assert model.beta == pytest.approx([-13.5, 0.4, -0.3], abs=0.12) and model.alpha == pytest.approx(alpha, rel=0.15)
    row = nb2.predict(model, df).first()
    assert row.expected_ksi_std == pytest.approx(math.sqrt(row.expected_ksi + model.alpha * row.expected_ksi**2)) and row.expected_ksi_lower_95 >= 0
    unseen = nb2.design(df.limit(1).withColumn("road_category", F.lit("Z")), model.specs).first()
    assert unseen["x_road_category_B"] == 0.0


def test_under_dispersed_counts_end_at_poisson(spark):
    rows = [(f"k{i}", y, "A" if i < 2 else "B", 1e6 * (1 + i), 1 + i, f"E{i}") for i in range(4) for y in range(2019, 2025)]
    df = spark.createDataFrame(rows, "segment_key string, year int, road_category string, annual_vehicle_km double, ksi_count long, local_authority_code string")
    found = nb2.safety_performance(df, CONTRACT)
    assert found.model.alpha == 0.0 and found.predictions.count() == 8
    assert {r.evaluation_split: r.n_rows for r in metrics.detailed_metrics(found.predictions).collect()} == {"validation": 4, "test": 4}
    row = nb2.promotion(found).first()
    assert not row.model_promoted and "no_future_unseen_authorities" in row.promotion_blockers
    assert nb2.authority_holdout(df.drop("local_authority_code")) is None and nb2.authority_holdout(df.where("local_authority_code = 'E1'")) is None
    more = df.withColumn("local_authority_code", F.when((F.col("year") == 2024) & (F.col("segment_key") == "k0"), "E9").otherwise(F.col("local_authority_code")))
    assert [tuple(r) for r in nb2.unseen_authorities(more, CONTRACT).collect()] == [("test", "E9")]


# ---- listings ---------------------------------------------------------------------------------


def test_listings(spark):
    df = spark.createDataFrame([("A1", "2024-01-02", 1, 3), ("b2", "2024-01-01", 2, 2), ("a3", None, 3, 1)], "collision_index string, date string, collision_severity int, number_of_casualties int")
    assert [r[0] for r in serving.list_collisions(df, limit=2).collect()] == ["a3", "b2"]
    assert [r[0] for r in serving.list_collisions(df, severity=1).collect()] == ["A1"]
    assert {r[0] for r in serving.search_collisions(df, "A").collect()} == {"A1", "a3"} and serving.search_collisions(df, " ").count() == 3
    assert tuple(serving.collision_summary(df).first()) == (3, 2, 6, 1, 1, 1)
    for bad in (0, 5001):
        with pytest.raises(ValueError):
            serving.list_collisions(df, limit=bad)


@pytest.mark.parametrize("few", [10_000, 3])
def test_first_rows_of_groups_without_sorting(spark, monkeypatch, few):
    monkeypatch.setattr(selection, "FEW", few)
    monkeypatch.setattr(selection, "BUCKETS", 7)
    rnd, rows = random.Random(6), []
    for i in range(500):
        group = rnd.choice(["a", "a", "b", None])
        rows.append((group, f"key-{i % 250:03}", i // 250, float(rnd.choice([1e-300, 1e300, -1.0, 0.5, 0.5, 0.5, rnd.random()]))))
    rows += [("c", "x", 1, 2.0), ("d", "", 1, 1.0), ("d", None, 2, 1.0), ("e", "n", 1, None), ("e", "m", 1, float("nan")), ("e", "o", 1, 0.0)] + [("f", "é" * (k % 7) + "b" * (k % 3), k, 4.0) for k in range(60)]
    df = spark.createDataFrame(rows, "g string, segment_key string, year int, v double")
    got = selection.flag_first(df, ["g"], "v", F.greatest(F.lit(1), F.ceil(F.col("group_rows") * 0.1)), ["segment_key", "year"]).collect()
    assert len(got) == len(rows)
    for group in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == group]
        usable = sorted((r for r in own if r[3] is not None and r[3] == r[3]), key=lambda r: (-r[3], (r[1] or "").encode(), r[2]))
        want = {r[1:3] for r in usable[: max(1, math.ceil(len(own) * 0.1))]}
        assert {(r.segment_key, r.year) for r in got if r.g == group and r.in_top} == want
        assert {r.group_rows for r in got if r.g == group} == {len(own)}


def test_top_share_needs_no_range_sort(spark):
    df = spark.range(100).selectExpr("'x' g", "cast(id as string) segment_key", "2020 year", "id % 7 ksi_count", "cast(id % 13 as double) expected_ksi")
    plan = metrics.detailed_metrics(df, ("g",))._jdf.queryExecution().toString()
    assert "rangepartitioning" not in plan and "InMemoryRelation" not in plan


def test_complete_history_of_many_years(spark):
    contract = panel.Contract(tuple(range(1900, 1990)), (1990,), (1991,))
    rows = [("all", y) for y in range(1890, 1995)] + [("gap", y) for y in range(1900, 1992) if y != 1963]
    got = panel.complete_history(spark.createDataFrame(rows, "segment_key string, year int"), contract).collect()
    assert [tuple(r) for r in got] == [("all", 92)]


def wide_rows(n, levels, seed):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, levels, n), rng.integers(0, 3, n)
    effect = np.random.default_rng(1).normal(0, 0.5, levels)
    e = rng.uniform(1e5, 1e6, n)
    mu = e * np.exp(-12 + effect[a] + 0.3 * b)
    y = rng.poisson(mu * rng.gamma(2.0, 0.5, n))
    return [(f"c{i:05}", f"t{j}", float(x), int(k)) for i, j, x, k in zip(a, b, e, y, strict=True)]


def test_wide_models_need_no_matrix_and_fit_alike(spark, monkeypatch):
    df = spark.createDataFrame(wide_rows(3000, 12, 3), "road_category string, road_type string, annual_vehicle_km double, ksi_count long").repartition(3)
    specs = nb2.feature_specs(df)
    plain = nb2.fit(df, specs)
    expected = {(r.road_category, r.road_type, r.annual_vehicle_km): r.expected_ksi for r in nb2.predict(plain, df).collect()}
    monkeypatch.setattr(nb2, "DENSE", 5)
    wide = nb2.fit(df, specs)
    assert plain.alpha > 0.1 and np.allclose(wide.beta, plain.beta, atol=1e-5) and abs(wide.alpha - plain.alpha) < 1e-5
    clash = df.withColumns({"_b": F.lit(1), "_level": F.lit("x")})
    got = nb2.predict(wide, clash)
    assert got.columns == [*clash.columns, "expected_ksi", "expected_ksi_std", "expected_ksi_lower_95", "expected_ksi_upper_95"]
    assert all(abs(r.expected_ksi - expected[r.road_category, r.road_type, r.annual_vehicle_km]) < 1e-4 * (1 + r.expected_ksi) for r in got.collect())
    assert max(abs(r.score) for r in nb2.score(wide, df).collect()) < 1e-6
    unseen = spark.createDataFrame([("other", "t0", 1e6)], "road_category string, road_type string, annual_vehicle_km double")
    assert nb2.predict(wide, unseen).first().expected_ksi == pytest.approx(1e6 * math.exp(wide.beta[0]))


def test_thousands_of_levels(spark):
    df = spark.createDataFrame(wide_rows(12_000, 3000, 4), "road_category string, road_type string, annual_vehicle_km double, ksi_count long")
    model = nb2.fit(df, nb2.feature_specs(df), tolerance=1e-6)
    assert len(model.beta) > 2900
    scores = {r.term: r.score for r in nb2.score(model, df).collect()}
    assert len(scores) == len(model.beta) + 1 and max(map(abs, scores.values())) < 1e-4


def test_conjugate_gradients_solve():
    rng = np.random.default_rng(2)
    m = rng.normal(size=(40, 30))
    matrix, right = m.T @ m + np.eye(30), rng.normal(size=30)
    assert np.allclose(nb2.conjugate_gradients(lambda v: matrix @ v, right, np.diag(matrix)), np.linalg.solve(matrix, right), atol=1e-7)


def test_equal_exposure_ranks_by_key_in_whatever_order_it_is_added(spark):
    years, flows = range(1995, 2005), [0.1 * 10**5, 0.7 * 10**4, 123.456, 987654.321, 0.3, 1e7 / 3, 5.5, 77.7, 1e6 / 7, 2e5 / 9]
    rows = [(f"s{k:03}", y, flows[(i * (1 + 2 * (k % 2)) + k) % 10], 3, 1) for k in range(200) for i, y in enumerate(years)]
    table = spark.createDataFrame(rows, "segment_key string, year int, annual_vehicle_km double, collision_count long, ksi_count long").repartition(7)
    got = {r.segment_key: r.screening_rank for r in screening.screen(table).collect()}
    assert got == {f"s{k:03}": k + 1 for k in range(200)}
    small = spark.createDataFrame([("a", 1.0), ("a", float("inf")), ("b", 1e-7), ("b", 2e-7), ("c", None), ("d", 1e300), ("d", 1.0)], "k string, x double")
    sums = dict(small.groupBy("k").agg(rates.exact_sum(F.col("x"))).collect())
    assert sums == {"a": float("inf"), "b": pytest.approx(3e-7), "c": None, "d": 1e300}


def test_the_held_out_authority_reads_its_rows_once(spark):
    """Training rows that cost much to make are made once, however many passes the fit takes."""
    from linkrisk.operators import nb2

    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = [(f"k{i}", 1995 + i % 4, i % 5, 1e6 * (1 + i % 7), str(i % 3), f"c{i % 2}") for i in range(120)]
    schema = "segment_key string, year int, ksi_count long, annual_vehicle_km double, local_authority_code string, road_category string"
    got = nb2.authority_holdout(spark.createDataFrame(rows, schema).mapInArrow(counted, schema)).collect()
    assert {(r.model, r.held_out_authority, r.training_rows, r.n_rows) for r in got} == {("spf", "2", 80, 40), ("exposure_rate_baseline", "2", 80, 40)}
    assert made.value == len(rows)


def test_the_gates_of_a_panel_read_it_once(spark):
    from linkrisk.operators import panel

    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    schema = "segment_key string, year int, source_year int, " + ", ".join(f"{c} string" for c in panel.PANEL_COLUMNS if c not in ("segment_key", "year", "source_year"))
    rows = spark.range(50).selectExpr("string(id) AS segment_key", "1995 AS year", "1995 AS source_year", *(f"'x' AS {c}" for c in panel.PANEL_COLUMNS if c not in ("segment_key", "year", "source_year")))
    panel.build_panel([rows.mapInArrow(counted, schema)])
    assert made.value == 50
