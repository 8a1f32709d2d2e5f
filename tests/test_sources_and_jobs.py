from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from linkrisk.operators import panel
from linkrisk.operators.gates import ValidationError
from linkrisk.plans import jobs
from linkrisk.sources import files, ranges, sinks

HEADER = "collision_index,collision_year,longitude,latitude,collision_severity,number_of_vehicles,number_of_casualties,date,time,speed_limit,local_authority_highway_current,extra"
COLLISIONS = """2024131435296,2024,-1.73085,53.80833,3,1,1,24/04/2024,15:00,30,E08000032,x
2024131457805,2024,-1.71291,53.83033,2,1,1,19/06/2024,23:30,30,E08000032,x
007,2024,-1.60000,53.80000,3,-1,,31/02/2024,,30,E08000032,x
out,2024,-3.0,53.8,1,1,1,01/01/2024,00:00,30,E1,x
none,2024,,,3,1,1,01/01/2024,00:00,30,E1,x
,2024,-1.6,53.8,3,1,1,01/01/2024,00:00,30,E1,x
"""
LINES = {
    "47907": ("A657", [[-1.7306188907488809, 53.80808277548166], [-1.7447848094716059, 53.810935942992316]]),
    "57940": ("A658", [[-1.7199025224727509, 53.816515928916935], [-1.7121006315498493, 53.831309617083434]]),
}
TRAFFIC = "count_point_id,year,region_id,region_name,region_ons_code,local_authority_id,local_authority_name,local_authority_code,road_name,road_category,road_type,estimation_method,estimation_method_detailed,all_motor_vehicles,cars_and_taxis,LGVs,all_HGVs,link_length_km,more\n"
TRAFFIC += "47907,2024,1,Y,E12,63,Bradford,E08000032,A657,PA,Major,Estimated,NA,7877,6000,900,100,1.0,x\n57940,2024,1,Y,E12,63,Bradford,E08000032,A658,PA,Major,Counted,,12000,9000,1500,200,1.7,x\n99,2024,1,Y,E12,63,Leeds,E08000035,A1,PA,Major,Counted,,1,1,1,1,1.0,x\n"


@pytest.fixture
def inputs(tmp_path):
    (tmp_path / "c.csv").write_text(HEADER + "\n" + COLLISIONS)
    (tmp_path / "t.csv").write_text(TRAFFIC)
    (tmp_path / "u.csv").write_text("count_point_id,year,urban_rural\n47907,2024,URBAN\n57940,2024,rural\n")
    features = [{"type": "Feature", "properties": {"segment_id": f"dft-mrdb-2024-{k}", "count_point_id": int(k), "road_number": r, "source_year": 2024}, "geometry": {"type": "LineString", "coordinates": c}} for k, (r, c) in LINES.items()]
    (tmp_path / "l.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}, indent=1))
    (tmp_path / "l.jsonl").write_text("".join(json.dumps(f) + "\n" for f in features))
    ring = [[-1.8, 53.7], [-1.6, 53.7], [-1.6, 53.9], [-1.8, 53.9], [-1.8, 53.7]]
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"OA11CD": "E00"}, "geometry": {"type": "Polygon", "coordinates": [ring]}}]}))
    return tmp_path


def test_collisions_are_cleaned(spark, inputs):
    rows = {r.collision_index: r for r in files.read_collisions(spark, str(inputs / "c.csv")).collect()}
    assert set(rows) == {"2024131435296", "2024131457805", "007", "out", "none"} and "extra" not in rows["007"].asDict()
    assert (rows["007"].number_of_vehicles, rows["007"].number_of_casualties, rows["007"].time) == (None, None, None)
    with pytest.raises(ValidationError, match="missing columns"):
        files.clean_collisions(spark.range(1))


def test_traffic_and_lookup(spark, inputs):
    ids = spark.createDataFrame([(47907,), (57940,)], "count_point_id long")
    rows = files.read_traffic(spark, str(inputs / "t.csv"), year=2024, ids=ids).collect()
    assert len(rows) == 2 and min(r.all_motor_vehicles for r in rows) == 7877 and {r.estimation_method_detailed for r in rows} == {None} and rows[0].lgvs is not None
    assert {r.urban_rural for r in files.read_urban_rural(spark, str(inputs / "u.csv"), year=2024).collect()} == {"urban", "rural"}


def test_links_as_collection_and_lines_are_alike(spark, inputs):
    a, b = files.read_links(spark, str(inputs / "l.geojson")), files.read_links(spark, str(inputs / "l.jsonl"), lines=True)
    assert sorted(a.collect()) == sorted(b.collect()) and a.count() == 2
    pieces = files.vertices_to_pieces(a, "parts", "segment_id").collect()
    assert len(pieces) == 2 and {p.seq for p in pieces} == {0}


def test_years_from_yearly_files_and_history(spark, tmp_path):
    for name, years in (("2024", [2024]), ("history", [2018, 2019, 2020])):
        (tmp_path / f"{name}.csv").write_text(HEADER + "\n" + "".join(f"{y}-{name},{y},-1.6,53.8,3,1,1,01/01/{y},00:00,30,E1,x\n" for y in years))
    rows = files.read_years(spark, str(tmp_path / "{year}.csv"), [2019, 2020, 2024], history=str(tmp_path / "history.csv"), history_years=[2019, 2020])
    assert sorted(r.collision_index for r in rows.collect()) == ["2019-history", "2020-history", "2024-2024"]


def test_inventory_and_digest(spark, inputs):
    rows = {r.filename: r for r in files.file_inventory(spark, str(inputs), "*.csv").collect()}
    assert set(rows) == {"c.csv", "t.csv", "u.csv"} and rows["t.csv"].sha256 == hashlib.sha256((inputs / "t.csv").read_bytes()).hexdigest()
    df = spark.createDataFrame([(1, "a"), (2, None)], "x int, y string")
    assert files.table_digest(df).first() == files.table_digest(df.orderBy(F.desc("x"))).first()


def test_jobs_from_files_to_reports(spark, inputs):
    out, collisions = str(inputs / "out"), files.read_collisions(spark, str(inputs / "c.csv"))
    report = jobs.build_pilot(collisions, out)
    assert {(r.collision_year, r.collision_severity, r.n) for r in report.collect()} == {(2024, 2, 1), (2024, 3, 2)}
    pilot = spark.read.parquet(f"{out}/collisions")
    assert pilot.where("collision_index = '007'").first().date is None
    quality = spark.read.json(f"{out}/data-quality-report").first()
    assert (quality.source_records, quality.pilot_records, quality.missing_source_coordinates) == (5, 3, 1)
    links, traffic, lookup = files.read_links(spark, str(inputs / "l.geojson")), files.read_traffic(spark, str(inputs / "t.csv")), files.read_urban_rural(spark, str(inputs / "u.csv"))
    row = jobs.build_network(pilot, links, traffic, out, year=2024, lookup=lookup).first()
    assert (row.accepted, row.out_of_range, row.segments_with_exposure, row.urban_rural_coverage, row.local_authorities) == (2, 1, 2, 1.0, "E08000032")
    found = spark.read.parquet(f"{out}/evidence")
    assert {(r.count_point_id, r.collision_count, r.ksi_count) for r in found.collect()} == {(47907, 1, 0), (57940, 1, 1)}
    feature = json.loads(spark.read.text(f"{out}/features").where("value like '%47907%'").first()[0])
    assert feature["geometry"] == {"type": "LineString", "coordinates": LINES["47907"][1]} and feature["properties"]["collision_count"] == 1
    contract = panel.Contract((2022,), (2023,), (2024,))
    assert jobs.build_panel([found], contract, out).first().blockers.startswith("missing_contract_years")
    top = jobs.build_screening(spark.read.parquet(f"{out}/panel"), out)
    assert top.where("screening_rank = 1").first().segment_key == "dft-count-point-57940"
    areas, classes = files.read_areas(spark, str(inputs / "a.geojson")), spark.createDataFrame([("E00", "urban")], "area_id string, urban_rural string")
    box = (400000.0, 420000.0, 430000.0, 450000.0)
    assert [tuple(r) for r in jobs.build_area_lookup(links, areas, classes, out, box=box).collect()] == [(47907, 2024, "urban"), (57940, 2024, "urban")]
    with pytest.raises(ValidationError, match="network year"):
        jobs.build_network(pilot, links, traffic, out, year=2023)


def test_contract_build_serves_all_years_at_once(spark, inputs):
    years = (2022, 2023, 2024)
    collisions = files.read_collisions(spark, str(inputs / "c.csv"))
    many, roads, flows = None, None, None
    for y in years:
        own = collisions.withColumns({"collision_year": F.lit(y), "collision_index": F.concat(F.lit(f"{y}-"), "collision_index")})
        link = files.read_links(spark, str(inputs / "l.geojson"), year=y).withColumn("segment_id", F.concat(F.lit(f"dft-mrdb-{y}-"), F.col("count_point_id")))
        flow = files.read_traffic(spark, str(inputs / "t.csv")).withColumn("year", F.lit(y))
        many, roads, flows = (own, link, flow) if many is None else (many.unionByName(own), roads.unionByName(link), flows.unionByName(flow))
    row = jobs.build_contract(spark, many, roads, flows, panel.Contract((2022,), (2023,), (2024,), ("road_category",)), str(inputs / "all")).first()
    assert (row.missing_years, row.segments_with_complete_history, row.blockers) == ("", 2, "insufficient_geographic_groups")
    rows = spark.read.parquet(str(inputs / "all/evidence")).collect()
    assert len(rows) == 6 and {r.collision_count for r in rows} == {1}
    alone = {}
    for y in years:
        jobs.build_network(many.where(F.col("collision_year") == y).where(F.col("longitude").between(-1.75, -1.35)), roads.where(F.col("source_year") == y), flows, str(inputs / f"one{y}"), year=y)
        alone |= {r.collision_index: (r.match_status, r.nearest_segment_id, r.distance_m) for r in spark.read.parquet(str(inputs / f"one{y}/matches")).collect()}
    assert alone == {r.collision_index: (r.match_status, r.nearest_segment_id, r.distance_m) for r in spark.read.parquet(str(inputs / "all/matches")).collect()}
    assert spark.read.text(str(inputs / "all/features")).count() == 6 and {r.source for r in spark.read.json(str(inputs / "all/sources-report")).collect()} == {"collisions", "links", "traffic"}
    assert len({r[0] for r in alone.values()}) == 2 and None not in {r[1] for r in alone.values()}
    with pytest.raises(ValidationError, match="not unique"):
        jobs.build_contract(spark, many, roads.unionByName(roads.limit(1)), flows, panel.Contract((2022,), (2023,), (2024,)), str(inputs / "no"))
    with pytest.raises(ValidationError, match="follow"):
        panel.Contract((2024,), (2022,), (2023,))
    with pytest.raises(ValidationError, match="lack"):
        jobs.build_contract(spark, collisions, roads, flows, panel.Contract((2022,), (2023,), (2024,)), str(inputs / "no"))


def test_model_jobs_store_predictions(spark, tmp_path):
    rows = [(f"k{i}", y, "A" if i < 2 else "B", 1e6 * (1 + i), 1 + i + (y * i) % 3, f"E{i}") for i in range(4) for y in range(2019, 2025)]
    df = spark.createDataFrame(rows, "segment_key string, year int, road_category string, annual_vehicle_km double, ksi_count long, local_authority_code string")
    contract = panel.Contract((2019, 2020, 2021, 2022), (2023,), (2024,))
    assert jobs.build_baseline(df, contract, str(tmp_path)).count() == 2
    assert jobs.build_spf(df, contract, str(tmp_path)).count() == 1
    assert spark.read.parquet(f"{tmp_path}/spf-predictions").count() == 8
    assert spark.read.json(f"{tmp_path}/spf-metrics").count() == 4


def test_write_by_year(spark, tmp_path):
    df = spark.createDataFrame([(2019, "b"), (2019, "a"), (2020, "c")], "year int, k string")
    sinks.write_by(df, str(tmp_path / "p"), "year", order=("k",))
    assert {p.name for p in (tmp_path / "p").glob("year=*")} == {"year=2019", "year=2020"}


def test_years_lie_side_by_side(spark, tmp_path):
    path, df = str(tmp_path / "p"), spark.createDataFrame([(2019, "b"), (2020, "c"), (2020, "d"), (2021, "e")], "year int, k string")
    sinks.write_years(df, path, "year", [2019])
    sinks.write_years(df, path, "year", [2020, 2021], order=("k",))
    sinks.write_years(df.where("k <> 'd'"), path, "year", [2020])
    back = lambda years: sorted(tuple(r) for r in sinks.read_years(df, path, "year", years).collect())
    assert back([2019, 2020, 2021]) == [(2019, "b"), (2020, "c"), (2021, "e")] and back([2021]) == [(2021, "e")]
    sinks.write_years(df.where("year <> 2021"), path, "year", [2021, 2022])  # a year without rows is emptied
    assert back([2019, 2020, 2021, 2022]) == [(2019, "b"), (2020, "c")] and not (tmp_path / "p/year=2021").exists()
    assert back([1999]) == []


def _years(spark, inputs, years):
    collisions = files.read_collisions(spark, str(inputs / "c.csv"))
    own = [collisions.withColumns({"collision_year": F.lit(y), "collision_index": F.concat(F.lit(f"{y}-"), "collision_index")}) for y in years]
    links = [files.read_links(spark, str(inputs / "l.geojson"), year=y).withColumn("segment_id", F.concat(F.lit(f"dft-mrdb-{y}-"), F.col("count_point_id"))) for y in years]
    flows = [files.read_traffic(spark, str(inputs / "t.csv")).withColumn("year", F.lit(y)) for y in years]
    return own, links, flows


def test_successive_years_of_pilot_and_network_stay(spark, inputs):
    out = str(inputs / "side")
    for rows, links, flows in zip(*_years(spark, inputs, (2019, 2020)), strict=True):
        jobs.build_pilot(rows, out)
        year = links.first().source_year
        jobs.build_network(spark.read.parquet(f"{out}/collisions").where(F.col("source_year") == year), links, flows, out, year=year)
    for name in ("collisions", "matches", "evidence"):
        assert {r[0]: r[1] for r in spark.read.parquet(f"{out}/{name}").groupBy("source_year").count().collect()} == dict.fromkeys((2019, 2020), 2 if name == "evidence" else 3)
    for name in ("data-quality-report", "severity-report", "network-report", "sources-report"):
        assert {r[0] for r in spark.read.json(f"{out}/{name}").select("source_year").collect()} == {2019, 2020}
    features = [json.loads(r.value)["properties"] for r in spark.read.text(f"{out}/features").collect()]
    assert sorted(f["segment_id"] for f in features) == sorted(f"dft-mrdb-{y}-{k}" for y in (2019, 2020) for k in LINES)


def test_pilot_reads_its_source_twice_and_keeps_rows_without_a_year(spark, inputs, tmp_path):
    clean = files.read_collisions(spark, str(inputs / "c.csv")).withColumn("collision_year", F.when(F.col("collision_index") != "007", F.col("collision_year")))
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = clean.mapInArrow(counted, clean.schema)
    report = jobs.build_pilot(rows, str(tmp_path / "p"))
    assert read.value <= 2 * 5
    assert {(r.collision_year, r.collision_severity, r.n) for r in report.collect()} == {(2024, 2, 1), (2024, 3, 1), (None, 3, 1)}
    got = spark.read.json(f"{tmp_path}/p/data-quality-report").first()
    assert (got.source_year, got.source_records, got.selected_source_records, got.pilot_records, got.missing_source_coordinates) == (2024, 5, 5, 3, 1)
    assert got.source_digest == files.table_digest(clean).first().digest
    with pytest.raises(ValidationError, match="duplicate"):
        jobs.build_pilot(clean.unionByName(clean.limit(1)), str(tmp_path / "no"))
    with pytest.raises(ValidationError, match="severities"):
        jobs.build_pilot(clean.withColumn("collision_severity", F.lit(4)), str(tmp_path / "no"))
    with pytest.raises(ValidationError, match="exactly one"):
        jobs.build_pilot(clean.withColumn("collision_year", F.length("collision_index")), str(tmp_path / "no"))
    with pytest.raises(ValidationError, match="no rows for 2023"):
        jobs.build_pilot(clean, str(tmp_path / "no"), years=(2023, 2024))


def test_link_years_without_traffic_are_counted(spark, inputs):
    own, links, flows = _years(spark, inputs, (2022, 2023, 2024))
    flows = [f.where("count_point_id <> 47907") if k else f for k, f in enumerate(flows)]
    union = lambda frames: frames[0].unionByName(frames[1]).unionByName(frames[2])
    out = str(inputs / "gaps")
    row = jobs.build_contract(spark, union(own), union(links), union(flows), panel.Contract((2022,), (2023,), (2024,), ("road_category",)), out).first()
    report = spark.read.json(f"{out}/readiness-report").first()
    assert (report.rows_without_year, report.records, json.loads(report.records_by_year)) == (2, 4, {"2022": 2, "2023": 1, "2024": 1})
    assert row.segments_with_complete_history == 1 and report.required_years == "2022,2023,2024" and len(report.contract_sha256) == 64
    assert spark.read.parquet(f"{out}/evidence").count() == 6 and spark.read.json(f"{out}/inputs-report").first().n_rows == 6


def test_one_collection_is_read_by_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ranges, "CHUNK", 37)
    names = ["plain", 'a "quoted" one', "back\\\\slash\\", "brackets ]}{[", "é日本", "", "\\" * 9 + '"']
    features = [{"type": "Feature", "properties": {"segment_id": f"{k}-{names[k % 7]}", "count_point_id": k, "road_number": "A1", "source_year": 2024, "more": {"type": "x", "deep": [{"a": [1]}]}}, "geometry": {"type": "LineString", "coordinates": [[k, 1.5], [k, 2.5]]}} for k in range(60)]
    whole = {"name": "{[\\\"", "crs": {"type": "name", "properties": {"name": "x"}}, "other": [{"type": "no feature"}], "features": features, "after": [1, {"a": "b"}]}
    for indent in (None, 1):
        text = json.dumps(whole, indent=indent, ensure_ascii=indent is None)
        (tmp_path / f"c{indent}.geojson").write_text(text)
        want = sorted(files.read_links(spark, str(tmp_path / f"c{indent}.geojson")).collect())
        assert len(want) == 60
        for size in (1, 50, 333, 100_000) if indent is None else (211,):
            if size == 1:  # every state at the beginning of a range
                path, out = str(tmp_path / f"c{indent}.geojson"), []
                state = (False, 0)
                for at in range(len(text.encode())):
                    out += ranges._features(path, at, at + 1, *state)
                    odd, outside, inside = ranges._summary(path, at, at + 1)
                    state = (state[0] ^ odd, state[1] + (inside if state[0] else outside))
                assert state == (False, 0) and [json.loads(x) for x in out if json.loads(x).get("type") == "Feature"] == features
                continue
            assert sorted(files.read_links(spark, str(tmp_path / f"c{indent}.geojson"), range_bytes=size).collect()) == want


def test_large_files_are_digested_in_pieces(spark, tmp_path, monkeypatch):
    (tmp_path / "large.bin").write_bytes(bytes(range(256)) * 20_000)
    (tmp_path / "small.bin").write_bytes(b"x")
    got = {r.filename: (r.bytes, r.sha256) for r in files.file_inventory(spark, str(tmp_path), "*.bin", whole=1000).collect()}
    assert got == {p.name: (p.stat().st_size, hashlib.sha256(p.read_bytes()).hexdigest()) for p in tmp_path.glob("*.bin")}


def test_ranges_of_collections_are_read_about_once_and_by_few_tasks(spark, tmp_path, monkeypatch):
    path, n = tmp_path / "all.json", 12_000
    path.write_text('{"type": "FeatureCollection", "features": [' + ",".join(f'{{"type": "Feature", "k": {k}, "name": "{"x" * 60}"}}' for k in range(n)) + "]}")
    found = ranges.collection_features(spark, str(path), size=1 << 13)
    assert found.count() == n and found.rdd.getNumPartitions() <= 4  # those of a shuffle, not one a range
    chunks, read = ranges._chunks, []
    monkeypatch.setattr(ranges, "_chunks", lambda *a, **k: (read.append(len(data)) or (at, data) for at, data in chunks(*a, **k)))
    size = path.stat().st_size
    got = sum(len(list(ranges._features(str(path), at, at + (1 << 13), False, 2 if at else 0))) for at in range(0, size, 1 << 13))
    assert got > 0 and sum(read) < 4 * size


def test_parts_are_joined_in_order(spark, tmp_path):
    rows = spark.range(2000).select((F.col("id") * 7919 % 2000).alias("k"))
    rows.repartitionByRange(5, "k").sortWithinPartitions("k").select(F.col("k").cast("string").alias("value")).write.text(str(tmp_path / "parts"))
    ranges.joined(spark, str(tmp_path / "parts"), str(tmp_path / "whole" / "part-00000.txt"))
    assert (tmp_path / "whole" / "part-00000.txt").read_text() == "".join(f"{k}\n" for k in range(2000))
