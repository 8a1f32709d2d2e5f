"""Registered queries of sources, sinks and jobs: tables go to files of the shared folder and come back."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import baseline, gates, matching, nb2, panel
from ..sources import files, ranges, sinks
from ..sources.shared import scratch
from . import jobs
from . import queries as q
from .queries import BOX, GRID_BOX, SPLIT, YEARS, query, rounded
from .standin import CONTRACT, view

#: Off the whole metres of the stand-in tables, so that no distance is exactly a limit.
DX, DY = 0.37, 0.41
WIDE = (-10.0, 49.0, 3.0, 61.0)


# ---- files ----------------------------------------------------------------------------------


def _raw_collisions(rows: DataFrame) -> DataFrame:
    """As a published file has them: text, days first, -1 for what is not known."""
    rows = rows.withColumns({"date": F.date_format("date", "dd/MM/yyyy"), "speed_limit": F.when(F.col("speed_limit") == 20, -1).otherwise(F.col("speed_limit"))})
    return rows.select(*(F.col(c).cast("string").alias(c) for c in files.COLLISION_TYPES), F.lit("x").alias("more"))


def _kept(df: DataFrame, label: str) -> DataFrame:
    """As a table of its own, which is what a job is given."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _csv(df: DataFrame, path: str) -> str:
    df.write.option("header", True).csv(path)
    return path


@query("""SELECT collision_index, collision_year, longitude, latitude, collision_severity, number_of_vehicles, number_of_casualties, strftime(date, '%d/%m/%Y') AS date, time,
                 CASE WHEN speed_limit <> 20 THEN speed_limit END AS speed_limit, local_authority_highway_current FROM collision""", "collision")
def csv_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.read_collisions(spark, _csv(_raw_collisions(view(spark, sf_dir, "collision")), scratch(spark, "collisions")))


@query("SELECT collision_year, count(*) AS n FROM collision WHERE collision_year IN (1992, 1993, 1995, 1996) GROUP BY collision_year", "collision")
def csv_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, path = _raw_collisions(view(spark, sf_dir, "collision")), scratch(spark, "years")
    for year in (1995, 1996):
        _csv(rows.where(F.col("collision_year") == str(year)), f"{path}/{year}.csv")
    _csv(rows.where("collision_year in ('1992', '1993', '1994')"), f"{path}/history.csv")
    found = files.read_years(spark, path + "/{year}.csv", (1992, 1993, 1995, 1996), history=f"{path}/history.csv", history_years=(1992, 1993, 1994))
    return found.groupBy("collision_year").agg(F.count(F.lit(1)).alias("n"))


def _raw_traffic(rows: DataFrame) -> DataFrame:
    point = F.col("count_point_id")
    known = {"road_category": F.concat(F.lit("category-"), point % 4), "road_type": F.concat(F.lit("type-"), point % 3), "local_authority_id": point % 25, "local_authority_name": F.concat(F.lit("area "), point % 25), "local_authority_code": point % 25}
    names = {"lgvs": "LGVs", "all_hgvs": "all_HGVs"}
    return rows.select(*(F.coalesce((known[c] if c in known else F.col(c) if c in rows.columns else F.lit(None)).cast("string"), F.lit("NA")).alias(names.get(c, c)) for c in files.TRAFFIC_TYPES))


@query("""SELECT count_point_id, year, all_motor_vehicles, link_length_km, estimation_method, cast(count_point_id % 25 AS string) AS local_authority_code, cast(NULL AS string) AS region_name
          FROM traffic WHERE year = 1996 AND count_point_id % 2 = 0""", "traffic")
def csv_traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _csv(_raw_traffic(view(spark, sf_dir, "traffic")), scratch(spark, "traffic"))
    ids = view(spark, sf_dir, "link").where("count_point_id % 2 = 0")
    return files.read_traffic(spark, path, year=1996, ids=ids).select("count_point_id", "year", "all_motor_vehicles", "link_length_km", "estimation_method", "local_authority_code", "region_name")


@query("SELECT count_point_id, cast(1996 AS int) AS year, urban_rural FROM link", "link")
def csv_urban_rural(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "link").select("count_point_id", F.lit(1996).alias("year"), F.upper(F.coalesce("urban_rural", F.lit(" "))).alias("urban_rural"))
    found = files.read_urban_rural(spark, _csv(rows.unionByName(rows.withColumn("year", F.lit(1997))), scratch(spark, "classes")), year=1996)
    gates.require_urban_rural(found)
    return found


def _line(*ends: Column) -> Column:
    return F.array(F.array(*(F.array(ends[k], ends[k + 1]) for k in range(0, len(ends), 2))))


@query("SELECT segment_id, count_point_id, road_number, cast(1996 AS int) AS source_year, x1 AS a1, y1 AS b1, x2 AS a2, y2 AS b2 FROM link", "link")
def geojson_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, path = view(spark, sf_dir, "link").withColumn("parts", _line(*map(F.col, ("x1", "y1", "x2", "y2")))), scratch(spark, "links")
    sinks.write_features(rows.select("segment_id", "count_point_id", "road_number", F.lit(1990).alias("source_year")), rows, path)
    found = files.read_links(spark, path, year=1996, lines=True)
    return files.vertices_to_pieces(found, "parts", "segment_id", "count_point_id", "road_number", "source_year").drop("part", "seq")


def _wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The features of a task as one collection."""
    yield pa.RecordBatch.from_pydict({"value": ['{"type": "FeatureCollection", "name": "a \\"[{ name", "features": [']})
    before = ""
    for batch in batches:
        yield pa.RecordBatch.from_pydict({"value": [(before if k == 0 else ",") + x for k, x in enumerate(batch.column("value").to_pylist())]})
        before = "," if batch.num_rows else before
    yield pa.RecordBatch.from_pydict({"value": ["]}"]})


@query("SELECT segment_id, count_point_id, road_number, cast(1996 AS int) AS source_year, x1 AS a1, y1 AS b1, x2 AS a2, y2 AS b2 FROM link", "link")
def geojson_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of four collections, each read by several tasks."""
    rows, path = view(spark, sf_dir, "link").withColumn("parts", _line(*map(F.col, ("x1", "y1", "x2", "y2")))), scratch(spark, "links")
    sinks.features(rows.select("segment_id", "count_point_id", "road_number", F.lit(1990).alias("source_year")), rows).repartition(4).mapInArrow(_wrapped, "value string").write.text(path)
    found = files.read_links(spark, path, year=1996, range_bytes=1 << 14)
    return files.vertices_to_pieces(found, "parts", "segment_id", "count_point_id", "road_number", "source_year").drop("part", "seq")


@query("""SELECT p.segment_id, p.collision_count, round(p.annual_vehicle_km, 3) AS annual_vehicle_km, 'LineString' AS kind, x2 AS last_x
          FROM panel p JOIN link USING (count_point_id) WHERE p.year = 1996""", "panel", "link")
def geojson_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, path = view(spark, sf_dir, "panel").where("year = 1996"), scratch(spark, "features")
    lines = view(spark, sf_dir, "link").select("count_point_id", _line(*map(F.col, ("x1", "y1", "x2", "y2"))).alias("parts"))
    sinks.write_features(rows, rows.select("segment_id", "count_point_id").join(lines, "count_point_id"), path)
    got = lambda at, kind: F.get_json_object("value", f"$.{at}").cast(kind)
    return spark.read.text(path).select(
        got("properties.segment_id", "string").alias("segment_id"), got("properties.collision_count", "long").alias("collision_count"), F.round(got("properties.annual_vehicle_km", "double"), 3).alias("annual_vehicle_km"),
        got("geometry.type", "string").alias("kind"), got("geometry.coordinates[1][0]", "double").alias("last_x"),
    )


@query("SELECT area_id, x1 AS a1, y1 AS b1, x2 AS a2, y2 AS b2 FROM edge", "edge")
def geojson_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    area, path = view(spark, sf_dir, "area"), scratch(spark, "areas")
    corner = [(F.col("cx") + dx, F.col("cy") + dy) for dx, dy in ((3500, 0), (0, 1500), (-3500, 0), (0, -1500), (3500, 0))]
    ring = F.array(F.array(*(F.array(x, y) for x, y in corner)))
    kind = F.lit("Polygon").alias("type"), F.to_json(ring).alias("coordinates")
    many = F.lit("MultiPolygon").alias("type"), F.to_json(F.array(ring)).alias("coordinates")
    shape = F.when(F.col("area_id") % 2 == 0, F.struct(*kind)).otherwise(F.struct(*many))
    text = F.concat(F.lit('{"type":"Feature","properties":{"OA11CD":"'), "area_id", F.lit('"},"geometry":{"type":"'), shape["type"], F.lit('","coordinates":'), shape["coordinates"], F.lit("}}"))
    area.select(text.alias("value")).write.text(path)
    return files.vertices_to_pieces(files.read_areas(spark, path, lines=True), "rings", "area_id").drop("part", "seq")


@query("SELECT segment_key, year, collision_count, urban_rural FROM panel WHERE year IN (1996, 1997)", "panel")
def parquet_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "panel")
    sinks.write_by(view(spark, sf_dir, "panel"), path, "year", order=("segment_key",))
    return spark.read.parquet(path).where("year in (1996, 1997)").select("segment_key", "year", "collision_count", "urban_rural")


@query("SELECT collision_year, collision_severity, count(*) AS n FROM collision GROUP BY ALL", "collision")
def json_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "report")
    report = q.severity_counts(spark, sf_dir)
    sinks.write_report(report, path)
    return spark.read.schema(report.schema).json(path)


@query("""SELECT 'n_nationkey=' || n_nationkey AS folder, strlen(n_name) + 1 AS bytes, sha256(n_name || chr(10)) AS sha256 FROM nation
          UNION ALL SELECT 'all', (SELECT sum(strlen(o_orderpriority) + 1) FROM orders), (SELECT sha256(string_agg(o_orderpriority || chr(10), '' ORDER BY o_orderkey)) FROM orders)""")
def file_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small files as values and a large one by pieces."""
    path = scratch(spark, "digests")
    spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name").repartition("n_nationkey").write.partitionBy("n_nationkey").text(path)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderpriority")
    parts = scratch(spark, "parts")
    orders.orderBy("o_orderkey").select("o_orderpriority").write.text(parts)  # sorted by many tasks
    ranges.joined(spark, parts, f"{path}/all/part-00000.txt")  # one file is what is asked for
    found = files.file_inventory(spark, path, "part-*", whole=1000)
    return found.select(F.substring_index("filename", "/", 1).alias("folder"), "bytes", "sha256")


@query("""SELECT sha256(r_name || chr(10)) AS sha256, strlen(r_name) + 1 AS bytes, CASE WHEN strlen(r_name) % 2 = 1 THEN 'changed' ELSE 'ok' END AS status FROM region
          UNION ALL SELECT NULL, NULL, 'missing'""")
def file_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "names")
    spark.read.parquet(f"{sf_dir}/region.parquet").select("r_regionkey", "r_name").repartition("r_regionkey").write.partitionBy("r_regionkey").text(path)
    found = files.file_inventory(spark, path, "part-*")
    # what was recorded earlier: other contents of files with an even size, and a file that is gone
    old = found.withColumn("sha256", F.when(F.col("bytes") % 2 == 0, "other").otherwise(F.col("sha256")))
    old = old.unionByName(spark.range(1).select(F.lit("gone").alias("filename"), F.lit(1).cast("long").alias("bytes"), F.lit("x").alias("sha256")))
    return gates.manifest_status(found, old).join(found, "filename", "left").select("sha256", "bytes", "status")


# ---- gates ----------------------------------------------------------------------------------


@query("""SELECT c AS missing FROM (VALUES ('o_orderkey'), ('o_custkey'), ('collision_index'), ('longitude')) v(c)
          WHERE c NOT IN (SELECT column_name FROM (DESCRIBE SELECT * FROM orders))""")
def missing_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    lost = gates.missing_columns(spark.read.parquet(f"{sf_dir}/orders.parquet"), ("o_orderkey", "o_custkey", "collision_index", "longitude"))
    return spark.createDataFrame([(c,) for c in lost], "missing string")


@query("""SELECT 'all' AS scope, count(DISTINCT collision_year) AS n_years, CASE WHEN count(DISTINCT collision_year) = 1 THEN min(collision_year) END AS year,
                 count_if(collision_year = 1996) > 0 AS has_year, count_if(collision_year = 1996) = count(*) AS is_year_alone FROM collision
          UNION ALL SELECT 'one', count(DISTINCT collision_year), CASE WHEN count(DISTINCT collision_year) = 1 THEN min(collision_year) END, count_if(collision_year = 1996) > 0, count_if(collision_year = 1996) = count(*)
          FROM collision WHERE collision_year = 1996""", "collision")
def year_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "collision")
    one = rows.where(F.col("collision_year") == 1996)
    gates.require_years_equal(one, gates.single_year(one))
    parts = [gates.year_status(df, 1996).withColumn("scope", F.lit(k)) for k, df in (("all", rows), ("one", one))]
    return parts[0].unionByName(parts[1]).withColumn("n_years", F.col("n_years").cast("long"))


@query("SELECT year, count_if(ksi_count % 4 <> 0) AS bad FROM panel WHERE year IN (1999, 2000) GROUP BY year", "panel")
def finite_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, expected = F.col("ksi_count") % 4, F.col("annual_vehicle_km") / 1e9
    broken = F.when(k == 1, float("nan")).when(k == 2, -expected).when(k == 3, float("inf")).otherwise(expected)
    rows = view(spark, sf_dir, "panel").where("year in (1999, 2000)").withColumn("expected_ksi", broken)
    return rows.groupBy("year").agg(F.count_if(gates.not_finite(F.col("expected_ksi"))).alias("bad"))


# ---- jobs -----------------------------------------------------------------------------------


@query(f"""SELECT collision_year, collision_severity, count(*) AS n FROM collision WHERE collision_year IN (1995, 1996) AND longitude BETWEEN {BOX[0]} AND {BOX[2]} AND latitude BETWEEN {BOX[1]} AND {BOX[3]}
           GROUP BY ALL""", "collision")
def pilot_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "collision").withColumn("date", F.date_format("date", "dd/MM/yyyy"))
    return jobs.build_pilot(rows, scratch(spark, "pilot"), years=(1995, 1996), box=BOX)


@query(f"""SELECT source_year, collision_severity, n, records, selected_source_records, CAST(sum(n) OVER (PARTITION BY source_year) AS BIGINT) AS pilot_records FROM (
             SELECT collision_year AS source_year, collision_severity, count(*) AS n FROM collision WHERE longitude BETWEEN {BOX[0]} AND {BOX[2]} AND latitude BETWEEN {BOX[1]} AND {BOX[3]} GROUP BY ALL)
           JOIN (SELECT collision_year AS source_year, count(*) AS selected_source_records FROM collision GROUP BY ALL) USING (source_year), (SELECT count(*) AS records FROM collision)
           WHERE source_year IN (1995, 1996, 1998)""", "collision")
def yearly_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three builds into one folder, the first of a year that is then built again: all years are there once."""
    rows, path = view(spark, sf_dir, "collision").withColumn("date", F.date_format("date", "dd/MM/yyyy")), scratch(spark, "pilot")
    for years in ((1995,), (1996, 1998), (1995,)):
        jobs.build_pilot(rows, path, years=years, box=BOX)
    quality = spark.read.json(f"{path}/data-quality-report").select("source_year", F.col("source_records").alias("records"), "selected_source_records", "pilot_records")
    counts = spark.read.parquet(f"{path}/collisions").groupBy("source_year", "collision_severity").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(quality, "source_year")


def _degrees(rows: DataFrame, *pairs: tuple[str, str, str, str]) -> DataFrame:
    """Longitude and latitude (c, d) of each pair (a, b) of grid columns, moved off whole metres."""
    for a, b, c, d in pairs:
        rows = geo.to_degrees(rows.withColumns({a: F.col(a) + DX, b: F.col(b) + DY}), a, b, c, d)
    return rows


def _yearly_links(spark: SparkSession, sf_dir: str, years: tuple[int, ...]) -> tuple[DataFrame, DataFrame]:
    """Links and classes as the jobs read them, in degrees."""
    links = _degrees(view(spark, sf_dir, "link"), ("x1", "y1", "a1", "b1"), ("x2", "y2", "a2", "b2")).withColumn("source_year", F.explode(F.array(*map(F.lit, years))))
    links = links.select(F.concat(F.lit("dft-mrdb-"), "source_year", F.lit("-"), "count_point_id").alias("segment_id"), "count_point_id", "road_number", "source_year", "urban_rural", _line(*map(F.col, ("a1", "b1", "a2", "b2"))).alias("parts"))
    classes = links.where("urban_rural is not null").select("count_point_id", F.col("source_year").alias("year"), "urban_rural")
    return links, classes


def _yearly_inputs(spark: SparkSession, sf_dir: str, years: tuple[int, ...], *, reported: tuple[int, ...] | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Collisions (of the years ``reported``, or all), links, traffic and classes as the jobs read them, in degrees."""
    collisions = view(spark, sf_dir, "collision").where(F.col("collision_year").isin(*reported) if reported else F.lit(True))
    collisions = _degrees(collisions.drop("longitude", "latitude"), ("x", "y", "longitude", "latitude")).withColumn("date", F.date_format("date", "dd/MM/yyyy"))
    links, classes = _yearly_links(spark, sf_dir, years)
    traffic = files.clean_traffic(_raw_traffic(view(spark, sf_dir, "traffic")))
    links, classes = _kept(links, "links"), _kept(classes, "classes")
    return _kept(collisions, "collisions"), links.drop("urban_rural"), _kept(traffic, "traffic"), classes


def _by_year_sql(years: str, group: str, more: str = "") -> str:
    pairs = q.DISTANCES.format(where=q.CLOSE).replace("FROM collision, link", "FROM moved collision, moved_link link")
    return f""", moved AS (SELECT * REPLACE (x + {DX} AS x, y + {DY} AS y) FROM collision WHERE collision_year IN {years}),
      moved_link AS (SELECT * REPLACE (x1 + {DX} AS x1, y1 + {DY} AS y1, x2 + {DX} AS x2, y2 + {DY} AS y2) FROM link)""" + pairs + q.STATUS.replace("FROM collision c", "FROM moved c") + f""",
      points AS (SELECT collision_year AS source_year, count(*) AS collision_records, count_if(match_status = 'accepted') AS accepted, count_if(match_status = 'ambiguous') AS ambiguous,
                        count_if(match_status = 'out_of_range') AS out_of_range, round(count_if(match_status = 'accepted') / count(*), 4) AS accepted_match_rate,
                        count_if(match_status = 'accepted' AND collision_severity IN (1, 2)) AS accepted_ksi FROM matched GROUP BY 1),
      lines AS (SELECT y AS source_year, count(*) AS road_segments, count(t.all_motor_vehicles) AS segments_with_exposure, round(count(t.all_motor_vehicles) / count(*), 4) AS exposure_coverage,
                       count(urban_rural) AS segments_with_urban_rural, round(count(urban_rural) / count(*), 4) AS urban_rural_coverage,
                       round(sum(t.all_motor_vehicles * 365 * t.link_length_km), 1) AS km
                FROM link CROSS JOIN (SELECT unnest([{years[1:-1].rstrip(",")}]) AS y) LEFT JOIN traffic t ON t.count_point_id = link.count_point_id AND t.year = y GROUP BY 1)
      SELECT {group}collision_records, accepted, ambiguous, out_of_range, accepted_match_rate, road_segments, segments_with_exposure, exposure_coverage, segments_with_urban_rural, urban_rural_coverage{more}
      FROM points JOIN lines USING (source_year)"""


def network_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    collisions, links, traffic, classes = _yearly_inputs(spark, sf_dir, (1996,), reported=(1996,))  # a job of one year is given its table only
    report = jobs.build_network(collisions, links, traffic, scratch(spark, "network"), year=1996, lookup=classes)
    return report.drop("local_authorities")


def contract_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "contract")
    collisions, links, traffic, classes = _yearly_inputs(spark, sf_dir, tuple(CONTRACT.years))
    jobs.build_contract(spark, collisions, links, traffic, CONTRACT, path, lookup=classes, box=WIDE)
    report = spark.read.json(f"{path}/network-report").drop("local_authorities").withColumn("source_year", F.col("source_year").cast("int"))
    found = spark.read.parquet(f"{path}/evidence").groupBy("source_year").agg(F.sum("collision_count").alias("evidence_collisions"), F.sum("ksi_count").alias("evidence_ksi"), F.round(F.sum("annual_vehicle_km"), 1).alias("evidence_km"))
    rows = spark.read.parquet(f"{path}/panel").groupBy(F.col("year").alias("source_year")).agg(F.count(F.lit(1)).alias("panel_rows"), F.round(F.sum("annual_vehicle_km"), 1).alias("panel_km"))
    return report.join(found, "source_year").join(rows, "source_year")


q.QUERIES |= {"network_job": network_job, "contract_job": contract_job}
q.ORACLES["network_job"] = q._chained(_by_year_sql("(1996)", ""), "collision", "link", "traffic")
q.ORACLES["contract_job"] = q._chained(_by_year_sql(YEARS, "source_year, ", ", accepted AS evidence_collisions, accepted_ksi AS evidence_ksi, km AS evidence_km, segments_with_exposure AS panel_rows, km AS panel_km"), "collision", "link", "traffic")


def panel_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _kept(view(spark, sf_dir, "panel"), "evidence")
    return jobs.build_panel([rows.where(F.col("year") == y) for y in gates.years_of(rows, "year")], CONTRACT, scratch(spark, "panel"))


def screening_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(jobs.build_screening(view(spark, sf_dir, "panel"), scratch(spark, "screening")), *q.RATES).select("screening_rank", *q.SCREENED)


def baseline_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(jobs.build_baseline(view(spark, sf_dir, "panel"), CONTRACT, scratch(spark, "baseline")), "mae", "rmse")


q.QUERIES |= {"panel_job": panel_job, "screening_job": screening_job, "baseline_job": baseline_job}
q.ORACLES |= {"panel_job": q.ORACLES["panel_readiness"], "screening_job": q.ORACLES["segment_screening"], "baseline_job": q.ORACLES["baseline_metrics"]}


@query(f"SELECT {SPLIT} AS evaluation_split, count(*) AS n_rows, cast(sum(ksi_count) AS bigint) AS ksi, 0 AS out_of_band, 0 AS off_formula, 0 AS coefficients_off FROM panel WHERE year IN (1999, 2000) GROUP BY 1", "panel")
def spf_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored predictions that are not what the stored coefficients give, and coefficients at which the likelihood
    of the training years is not level, are counted: none."""
    path, rows = scratch(spark, "spf"), _kept(view(spark, sf_dir, "panel"), "panel")
    jobs.build_spf(rows, CONTRACT, path)
    training = panel.labelled(rows, CONTRACT).where("evaluation_split = 'training'")
    told = {r.term: r.estimate for r in spark.read.json(f"{path}/spf-coefficients").collect()}
    specs = nb2.feature_specs(training)
    model = nb2.Model(specs, tuple(told[t] for t in nb2.Model(specs, (), 0.0, 0).names), told["alpha"], 0)
    level = nb2.score(model, training).agg(F.count_if(F.abs("score") > 1e-6).cast("int").alias("coefficients_off"))
    found = nb2.with_mean(spark.read.parquet(f"{path}/spf-predictions"), model, "annual_vehicle_km", "again")
    outside = ~F.col("expected_ksi").between(F.col("expected_ksi_lower_95"), F.col("expected_ksi_upper_95")) | (F.col("expected_ksi_lower_95") < 0)
    off = F.abs(F.col("again") - F.col("expected_ksi")) > 1e-9 * (1 + F.col("again"))
    found = found.groupBy("evaluation_split").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("ksi_count").alias("ksi"), F.count_if(outside).cast("int").alias("out_of_band"), F.count_if(off).cast("int").alias("off_formula"))
    return found.join(level)  # a single row


def area_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four squares stand for the areas; links are those that meet the box."""
    moved = view(spark, sf_dir, "link").withColumns({c: F.col(c) + d for c, d in (("x1", DX), ("y1", DY), ("x2", DX), ("y2", DY))})
    links = _kept(_yearly_links(spark, sf_dir, (1996,))[0], "links").drop("urban_rural").withColumn("_id", F.concat(F.lit("seg-"), F.col("count_point_id").cast("string")))
    links = links.join(_kept(matching.lines_in_box(moved, GRID_BOX), "inside").withColumnRenamed("segment_id", "_id"), "_id", "left_semi").drop("_id")
    side = F.array(*(F.struct(F.lit(k).alias("area_id"), F.lit(x).alias("x"), F.lit(y).alias("y")) for k, (x, y) in {"sw": (405000.0, 415000.0), "se": (415000.0, 415000.0), "nw": (405000.0, 425000.0), "ne": (415000.0, 425000.0)}.items()))
    corners = spark.range(1).select(F.inline(side)).withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(4))))
    corners = corners.withColumns({"x": F.col("x") + F.when(F.col("_k").isin(1, 2), 10000.0).otherwise(0.0), "y": F.col("y") + F.when(F.col("_k").isin(2, 3), 10000.0).otherwise(0.0)})
    ring = F.transform(F.sort_array(F.collect_list(F.struct("_k", "longitude", "latitude"))), lambda p: F.array(p["longitude"], p["latitude"]))
    areas = _kept(geo.to_degrees(corners).groupBy("area_id").agg(F.array(ring).alias("rings")), "areas")
    classes = areas.select("area_id", F.when(F.col("area_id").isin("sw", "ne"), "urban").otherwise("rural").alias("urban_rural"))
    return jobs.build_area_lookup(links, areas, classes, scratch(spark, "areas"), box=GRID_BOX)


q.QUERIES["area_job"] = area_job
q.ORACLES["area_job"] = q._chained(
    f""", moved AS (SELECT count_point_id, x1 + {DX} AS x1, y1 + {DY} AS y1, x2 + {DX} AS x2, y2 + {DY} AS y2 FROM link),
         k AS (SELECT count_point_id, x1, y1, x2, y2,
              greatest(0.0, CASE WHEN x2 > x1 THEN ({q._A} - x1) / (x2 - x1) ELSE 0 END, CASE WHEN y2 > y1 THEN ({q._B} - y1) / (y2 - y1) WHEN y2 < y1 THEN ({q._D} - y1) / (y2 - y1) WHEN y1 BETWEEN {q._B} AND {q._D} THEN 0 ELSE 2 END) AS a,
              least(1.0, CASE WHEN x2 > x1 THEN ({q._C} - x1) / (x2 - x1) ELSE 1 END, CASE WHEN y2 > y1 THEN ({q._D} - y1) / (y2 - y1) WHEN y2 < y1 THEN ({q._B} - y1) / (y2 - y1) WHEN y1 BETWEEN {q._B} AND {q._D} THEN 1 ELSE -1 END) AS b
            FROM moved),
         m AS (SELECT count_point_id, x1 + (x2 - x1) * (a + b) / 2 AS mx, y1 + (y2 - y1) * (a + b) / 2 AS my FROM k WHERE a <= b)
       SELECT DISTINCT count_point_id, 1996 AS year, CASE WHEN (mx < 415000) = (my < 425000) THEN 'urban' ELSE 'rural' END AS urban_rural FROM m""",
    "link",
)


# ---- models ---------------------------------------------------------------------------------

FIXED = nb2.Model((nb2.Spec("road_type", ("type-0", "type-1", "type-2")), nb2.Spec("urban_rural", ("__missing__", "rural", "urban"))), (-15.0, 0.25, -0.5, 0.125, 0.75), 0.5, 0)


@query("""SELECT segment_key, year, round(mu, 6) AS expected_ksi, round(s, 6) AS expected_ksi_std, round(greatest(0.0, mu - 1.96 * s), 6) AS expected_ksi_lower_95, round(mu + 1.96 * s, 6) AS expected_ksi_upper_95
          FROM (SELECT *, sqrt(mu + 0.5 * mu * mu) AS s FROM (SELECT segment_key, year, annual_vehicle_km * exp(-15.0 + CASE road_type WHEN 'type-1' THEN 0.25 WHEN 'type-2' THEN -0.5 ELSE 0 END
                + CASE coalesce(urban_rural, '__missing__') WHEN 'rural' THEN 0.125 WHEN 'urban' THEN 0.75 ELSE 0 END) AS mu FROM panel WHERE year IN (1999, 2000)))""", "panel")
def nb2_fixed_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("expected_ksi", "expected_ksi_std", "expected_ksi_lower_95", "expected_ksi_upper_95")
    return rounded(nb2.predict(FIXED, view(spark, sf_dir, "panel").where("year in (1999, 2000)")), *names).select("segment_key", "year", *names)


@query("""SELECT 'intercept' AS term, 0.0::DOUBLE AS score UNION ALL SELECT 'alpha', 0.0 UNION ALL
          SELECT feature || '=' || v, 0.0 FROM (SELECT DISTINCT feature, v, min(v) OVER (PARTITION BY feature) AS low FROM (
            SELECT 'road_category' AS feature, road_category AS v FROM panel WHERE year BETWEEN 1995 AND 1998 UNION ALL SELECT 'road_type', road_type FROM panel WHERE year BETWEEN 1995 AND 1998
            UNION ALL SELECT 'urban_rural', coalesce(urban_rural, '__missing__') FROM panel WHERE year BETWEEN 1995 AND 1998 UNION ALL SELECT 'estimation_method', estimation_method FROM panel WHERE year BETWEEN 1995 AND 1998))
          WHERE v <> low""", "panel")
def nb2_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At the fit the likelihood is level: the score of every term is zero."""
    training = panel.labelled(view(spark, sf_dir, "panel"), CONTRACT).where("evaluation_split = 'training'")
    found = nb2.score(nb2.fit(training, nb2.feature_specs(training)), training)
    return found.select("term", F.abs(F.round("score", 6)).alias("score"))


HELD = """, t AS (SELECT * FROM panel WHERE year BETWEEN 1995 AND 1998), last AS (SELECT max(local_authority_code) AS code FROM t),
  rate AS (SELECT sum(ksi_count) / sum(annual_vehicle_km) AS r, count(*) AS training_rows FROM t, last WHERE local_authority_code <> code),
  pred AS (SELECT t.*, 'exposure_rate_baseline' AS model, r * annual_vehicle_km AS expected_ksi FROM t, last, rate WHERE local_authority_code = code)"""


def holdout_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    training = panel.labelled(view(spark, sf_dir, "panel"), CONTRACT).where("evaluation_split = 'training'")
    return q._round_metrics(nb2.authority_holdout(training)).where("model = 'exposure_rate_baseline'")


q.QUERIES["holdout_baseline"] = holdout_baseline
q.ORACLES["holdout_baseline"] = "SELECT m.*, code AS held_out_authority, training_rows FROM (" + q._chained(HELD + q._metrics_sql("pred", "model"), "panel") + ") m, (" + q._chained(HELD + " SELECT code, training_rows FROM last, rate", "panel") + ")"


# Model and baseline by fixed coefficients through holdout and promotion.
MU = """annual_vehicle_km * exp(-15.0 + CASE road_type WHEN 'type-1' THEN 0.25 WHEN 'type-2' THEN -0.5 ELSE 0 END
        + CASE coalesce(urban_rural, '__missing__') WHEN 'rural' THEN 0.125 WHEN 'urban' THEN 0.75 ELSE 0 END)"""


def holdout_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    training = panel.labelled(view(spark, sf_dir, "panel"), CONTRACT).where("evaluation_split = 'training'")
    return q._round_metrics(nb2.authority_holdout(training, model=FIXED))


def promotion_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = panel.labelled(view(spark, sf_dir, "panel"), CONTRACT)
    training, scoring = rows.where("evaluation_split = 'training'"), rows.where("evaluation_split <> 'training'")
    base = baseline.predict_from(baseline.training_rate(training), scoring)
    found = nb2.SpfResult(FIXED, nb2.predict(FIXED, scoring), base, nb2.unseen_authorities(view(spark, sf_dir, "panel"), CONTRACT), nb2.authority_holdout(training, model=FIXED))
    return rounded(nb2.promotion(found), "test_mae", "baseline_test_mae", "holdout_mae", "baseline_holdout_mae").drop("holdout_unavailable_reason")


q.QUERIES |= {"holdout_fixed": holdout_fixed, "promotion_fixed": promotion_fixed}
_BOTH = HELD.replace("pred AS", "base AS") + f", pred AS (SELECT * FROM base UNION ALL SELECT t.*, 'spf' AS model, {MU} AS expected_ksi FROM t, last WHERE local_authority_code = code)"
q.ORACLES["holdout_fixed"] = "SELECT m.*, code AS held_out_authority, training_rows FROM (" + q._chained(_BOTH + q._metrics_sql("pred", "model"), "panel") + ") m, (" + q._chained(HELD + " SELECT code, training_rows FROM last, rate", "panel") + ")"
q.ORACLES["promotion_fixed"] = q._chained(
    _BOTH + f""", whole AS (SELECT sum(ksi_count) / sum(annual_vehicle_km) AS r FROM t),
    tested AS (SELECT avg(abs(ksi_count - {MU})) AS test_mae, avg(abs(ksi_count - whole.r * annual_vehicle_km)) AS baseline_test_mae FROM panel, whole WHERE year = 2000),
    held AS (SELECT avg(abs(ksi_count - expected_ksi)) FILTER (model = 'spf') AS holdout_mae, avg(abs(ksi_count - expected_ksi)) FILTER (model <> 'spf') AS baseline_holdout_mae FROM pred),
    fresh AS (SELECT count(*) AS unseen_authorities FROM (SELECT DISTINCT year, local_authority_code FROM panel WHERE year IN (1999, 2000) AND local_authority_code IS NOT NULL
              AND local_authority_code NOT IN (SELECT local_authority_code FROM panel WHERE year NOT IN (1999, 2000) AND local_authority_code IS NOT NULL))),
    b AS (SELECT *, list_filter([CASE WHEN unseen_authorities = 0 THEN 'no_future_unseen_authorities' END, CASE WHEN test_mae >= baseline_test_mae THEN 'no_future_test_mae_improvement' END,
          CASE WHEN holdout_mae >= baseline_holdout_mae THEN 'authority_holdout_does_not_beat_baseline' END], lambda x: x IS NOT NULL) AS l FROM tested, held, fresh)
    SELECT array_to_string(l, ',') AS promotion_blockers, len(l) = 0 AS model_promoted, round(test_mae, 6) AS test_mae, round(baseline_test_mae, 6) AS baseline_test_mae, round(holdout_mae, 6) AS holdout_mae,
           round(baseline_holdout_mae, 6) AS baseline_holdout_mae, unseen_authorities FROM b""",
    "panel",
)
