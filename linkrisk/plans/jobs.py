"""Composite jobs: from sources to stored results and a report, each for one year or many at once."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, rates
from ..operators import baseline, evidence, gates, matching, metrics, nb2, panel, polygons, screening, serving
from ..sources import files, sinks
from ..sources.shared import stored_with

#: Longitudes and latitudes of the pilot area: left, low, right, high.
PILOT_BOX = (-1.75, 53.72, -1.35, 53.90)
PILOT_COLUMNS = tuple(sorted(files.COLLISION_TYPES))


def build_pilot(collisions: DataFrame, output: str, *, years: Iterable[int] | None = None, box: tuple[float, float, float, float] = PILOT_BOX) -> DataFrame:
    """Checked collisions of the pilot box, stored by ``source_year``; returns counts by year and severity.

    Without ``years`` the source must have one reporting year; its rows without a year are then kept with it.
    The source is read twice: once for the gates and the quality report, once to be stored. Years that
    earlier builds stored stay as they are.
    """
    gates.require_columns(collisions, files.COLLISION_TYPES, "collision source")
    year, chosen = F.col("collision_year"), sorted(set(years)) if years is not None else []
    inside = F.col("longitude").between(box[0], box[2]) & F.col("latitude").between(box[1], box[3])
    by_year = {f"{name}_{y}": F.count_if((year == y) & also) for y in chosen for name, also in (("selected", F.lit(True)), ("pilot", inside))}
    duplicates, seen = gates.measured(
        collisions, "collision_index", n=F.count(F.lit(1)), outside=F.count_if(gates.outside_domain(F.col("collision_severity"), (1, 2, 3))), first=F.min(year), last=F.max(year), inside=F.count_if(inside),
        lost=F.count_if(F.col("longitude").isNull() | F.col("latitude").isNull()), digest=F.sum(files.row_hash(collisions)), **by_year,
    )
    if duplicates:
        raise gates.ValidationError(f"Found {duplicates} duplicate collision ids")
    if seen["outside"]:
        raise gates.ValidationError(f"Found {seen['outside']} severities outside 1, 2, 3")
    if years is None:
        if seen["first"] is None or seen["first"] != seen["last"]:
            raise gates.ValidationError(f"Expected exactly one reporting year, found {gates.years_of(collisions, 'collision_year')}")
        chosen = [seen["first"]]
        counts = {seen["first"]: (seen["n"], seen["inside"])}
        rows = collisions.withColumn("source_year", F.lit(chosen[0]))
    else:
        counts = {y: (seen[f"selected_{y}"], seen[f"pilot_{y}"]) for y in chosen}
        for y in chosen:
            if not counts[y][0]:
                raise gates.ValidationError(f"The source has no rows for {y}")
        rows = collisions.where(year.isin(chosen)).withColumn("source_year", year)
    rows = serving.in_box(rows, box).select(*PILOT_COLUMNS, "source_year").withColumn("date", rates.try_date(F.col("date")))
    sinks.write_years(rows, f"{output}/collisions", "source_year", chosen, order=("date", "collision_index"))
    report = serving.severity_counts(sinks.read_years(rows, f"{output}/collisions", "source_year", chosen), ("source_year", "collision_year"))
    quality = [(y, seen["n"], *counts[y], seen["lost"], str(seen["digest"] or 0), *map(float, box)) for y in chosen]
    names = "source_year int, source_records long, selected_source_records long, pilot_records long, missing_source_coordinates long, source_digest string, left double, low double, right double, high double"
    sinks.write_report(collisions.sparkSession.createDataFrame(quality, names), f"{output}/data-quality-report", years=chosen)
    sinks.write_report(report, f"{output}/severity-report", years=chosen)
    return report.drop("source_year")


def grid_pieces(links: DataFrame, parts: str = "parts", *ids: str) -> DataFrame:
    """National-grid pieces of links given by longitudes and latitudes."""
    rows = files.vertices_to_pieces(links, parts, *(ids or ("segment_id",)))
    rows = geo.to_grid(rows, "a1", "b1", "x1", "y1")
    return geo.to_grid(rows, "a2", "b2", "x2", "y2").drop("a1", "b1", "a2", "b2")


def build_network(collisions: DataFrame, links: DataFrame, traffic: DataFrame, output: str, *, year: int, lookup: DataFrame | None = None) -> DataFrame:
    """Matches, evidence and GeoJSON features of one network year, beside those of other years; returns
    the match report."""
    gates.require_years_equal(collisions, year)
    gates.require_links(links)
    gates.require_unique(traffic, "count_point_id", "year", what="traffic rows")
    if lookup is not None:
        gates.require_unique(lookup, "count_point_id", "year", what="urban/rural rows")
        gates.require_urban_rural(lookup)
    spark = collisions.sparkSession
    pieces = grid_pieces(links).persist()  # read by the rounds of the matching; released below
    points = geo.to_grid(collisions.select("collision_index", "collision_severity", "longitude", "latitude"))
    matches = matching.match(points, pieces).withColumn("source_year", F.lit(year))
    sinks.write_years(matches, f"{output}/matches", "source_year", [year])
    matches = sinks.read_years(matches, f"{output}/matches", "source_year", [year])
    base = links.select("segment_id", "count_point_id", "road_number", F.lit(year).alias("source_year")).withColumn("segment_key", rates.segment_key(F.col("count_point_id"))).join(matching.line_length(pieces), "segment_id", "left")
    one = lambda df: df.where(F.col("year") == year)
    rows = evidence.segment_evidence(base, one(traffic), evidence.accepted_counts(matches, collisions), one(lookup).drop("year") if lookup is not None else None)
    sinks.write_years(rows, f"{output}/evidence", "source_year", [year], order=("segment_id",))
    stored = sinks.read_years(rows, f"{output}/evidence", "source_year", [year])
    sinks.write_features(stored, links, f"{output}/features", years=[year])
    report = evidence.match_quality(matches).join(evidence.network_quality(stored))
    sinks.write_report(report.withColumn("source_year", F.lit(year)), f"{output}/network-report", years=[year])
    sinks.write_report(evidence.method_counts(one(traffic), ("year",)), f"{output}/estimation-methods", years=[year], column="year")
    sinks.write_report(provenance(spark, {"collisions": collisions, "links": links.drop("parts"), "traffic": traffic}).withColumn("source_year", F.lit(year)), f"{output}/sources-report", years=[year])
    pieces.unpersist()
    return report


def build_panel(frames: list[DataFrame], contract: panel.Contract, output: str) -> DataFrame:
    """The checked panel, stored by year, and its readiness.

    Link-years without traffic have no year; they are no part of the panel, and ``rows_without_year`` of the
    readiness report counts them. That report also has the contract and its hash, and records in all and by
    year; the inputs report has rows and digest of each table given."""
    spark = frames[0].sparkSession if frames else None
    rows = panel.build_panel([df.where("year is not null") for df in frames])
    sinks.write_by(rows, f"{output}/panel", "year", order=("segment_key",))
    stored = spark.read.parquet(f"{output}/panel")
    report = panel.readiness(stored, contract)
    years = panel.panel_years(stored)
    totals = years.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("records"), F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("year", "n_rows"))))).alias("records_by_year"))
    lost = panel.union_relaxed([df.select("year") for df in frames]).agg(F.count_if(F.col("year").isNull()).alias("rows_without_year"))
    fixed = {k: F.lit(v) for k, v in contract.described().items()}
    sinks.write_report(report.join(totals).join(lost).withColumns(fixed), f"{output}/readiness-report")
    sinks.write_report(years, f"{output}/years-report")
    sinks.write_report(provenance(spark, {f"evidence {k}": df for k, df in enumerate(frames)}), f"{output}/inputs-report")
    return report


def build_screening(rows: DataFrame, output: str) -> DataFrame:
    """Ranked segments, stored, with reports of the first ten and of the subgroups."""
    gates.require_columns(rows, ("segment_key", "year", "annual_vehicle_km", "collision_count", "ksi_count"), "panel")
    bad = gates.invalid_exposure(F.col("annual_vehicle_km")) | gates.invalid_target(F.col("ksi_count")) | gates.invalid_target(F.col("collision_count"))
    gates.require_none(rows, bad, "Found {n} rows with invalid exposure or counts")
    out = screening.screen(rows)
    out.write.mode("overwrite").parquet(f"{output}/segment-screening")
    stored = rows.sparkSession.read.parquet(f"{output}/segment-screening")
    sinks.write_report(stored.where("screening_rank <= 10").orderBy("screening_rank"), f"{output}/top-segments")
    sinks.write_report(screening.subgroup_rates(rows), f"{output}/subgroup-rates")
    return stored


def build_baseline(rows: DataFrame, contract: panel.Contract, output: str) -> DataFrame:
    """Baseline predictions, stored by split; returns their metrics."""
    out = baseline.exposure_baseline(rows, contract)
    sinks.write_by(out, f"{output}/baseline-predictions", "evaluation_split")
    report = metrics.error_metrics(rows.sparkSession.read.parquet(f"{output}/baseline-predictions"))
    sinks.write_report(report, f"{output}/baseline-report")
    return report


def build_spf(rows: DataFrame, contract: panel.Contract, output: str) -> DataFrame:
    """Model predictions, stored by split, metrics by split and subgroup, holdout and promotion."""
    found = nb2.safety_performance(rows, contract)
    sinks.write_by(found.predictions, f"{output}/spf-predictions", "evaluation_split")
    found = replace(found, predictions=rows.sparkSession.read.parquet(f"{output}/spf-predictions"))  # the reports do not predict anew
    named = lambda df, name: df.withColumn("model", F.lit(name))
    both = [(found.predictions, "spf"), (found.baseline, "exposure_rate_baseline")]
    for part, f in (("metrics", metrics.detailed_metrics), ("subgroup-metrics", metrics.subgroup_metrics)):
        parts = [named(f(df), name) for df, name in both]
        sinks.write_report(parts[0].unionByName(parts[1]), f"{output}/spf-{part}")
    sinks.write_report(nb2.coefficients(found.model, rows), f"{output}/spf-coefficients")
    split = panel.labelled(rows, contract).groupBy("evaluation_split").agg(F.count(F.lit(1)).alias("n_rows"))
    features = F.lit(",".join(s.column for s in found.model.specs))
    sinks.write_report(split.withColumns({"features": features, "alpha": F.lit(found.model.alpha), "iterations": F.lit(found.model.iterations)}).join(files.table_digest(rows).select("digest")), f"{output}/spf-provenance")
    sinks.write_report(found.unseen, f"{output}/unseen-authorities")
    if found.holdout is not None:
        sinks.write_report(found.holdout, f"{output}/authority-holdout")
    report = nb2.promotion(found)
    sinks.write_report(report, f"{output}/promotion")
    return report


def build_contract(spark: SparkSession, collisions: DataFrame, links: DataFrame, traffic: DataFrame, contract: panel.Contract, output: str, *, lookup: DataFrame | None = None, box: tuple[float, float, float, float] = PILOT_BOX, inventory: DataFrame | None = None) -> DataFrame:
    """Pilot, network evidence and features of all years of the contract in one plan keyed by year,
    then the panel and its readiness; the result is the latter.

    ``links`` has the links of all years with source_year; segment ids differ between years. Every
    gate of the yearly jobs holds for each year. Reports: those of the pilot, counts of matches and
    coverage by year, how the tables were made (``inventory``, say of file hashes, is stored with it).
    """
    years = contract.years
    gates.require_coverage(collisions, years)
    build_pilot(collisions, output, years=years, box=box)
    pilot = spark.read.parquet(f"{output}/collisions").where(F.col("source_year").isin(years))
    gates.require_years(pilot, years)
    own = links.where(F.col("source_year").isin(years))
    gates.require_yearly_links(own, years)
    yearly = traffic.where(F.col("year").isin(years))
    gates.require_unique(yearly, "count_point_id", "year", what="traffic rows")
    if lookup is not None:
        gates.require_unique(lookup, "count_point_id", "year", what="urban/rural rows")
        gates.require_urban_rural(lookup)
    pieces = grid_pieces(own, "parts", "segment_id", "source_year").persist()
    points = geo.to_grid(pilot.select("collision_index", F.col("collision_year").alias("source_year"), "collision_severity", "longitude", "latitude"))
    matches = matching.match(points, pieces, by=("source_year",))
    sinks.write_years(matches, f"{output}/matches", "source_year", years)
    matches = sinks.read_years(matches, f"{output}/matches", "source_year", years)
    counts = evidence.accepted_counts(matches, pilot)
    base = own.select("segment_id", "count_point_id", "road_number", "source_year").withColumn("segment_key", rates.segment_key(F.col("count_point_id"))).join(matching.line_length(pieces), "segment_id", "left")
    flows = yearly.withColumn("source_year", F.col("year"))
    classes = lookup.withColumnRenamed("year", "source_year") if lookup is not None else None
    rows = evidence.segment_evidence(base, flows, counts, classes, keys=("count_point_id", "source_year"))
    sinks.write_years(rows, f"{output}/evidence", "source_year", years, order=("segment_id",))
    pieces.unpersist()
    found = sinks.read_years(rows, f"{output}/evidence", "source_year", years)
    sinks.write_features(found, own, f"{output}/features", years=years)
    report = evidence.match_quality(matches, by=("source_year",)).join(evidence.network_quality(found, by=("source_year",)), "source_year", "full")
    sinks.write_report(report, f"{output}/network-report", years=years)
    sinks.write_report(evidence.method_counts(yearly, ("year",)), f"{output}/estimation-methods", years=years, column="year")
    sinks.write_report(provenance(spark, {"collisions": collisions, "links": links.drop("parts"), "traffic": traffic}, box=box), f"{output}/sources-report")
    if inventory is not None:
        sinks.write_report(inventory, f"{output}/inventory-report")
    return build_panel([found], contract, output)


def provenance(spark: SparkSession, sources: Mapping[str, DataFrame], *, box: tuple[float, float, float, float] = PILOT_BOX) -> DataFrame:
    """source, n_rows and digest of each table, with the parameters that the matches depend on."""
    out = None
    for name, df in sources.items():
        row = files.table_digest(df).select(F.lit(name).alias("source"), "n_rows", "digest")
        out = row if out is None else out.unionByName(row)
    fixed = {"max_distance_m": matching.MAX_DISTANCE, "ambiguity_margin_m": matching.AMBIGUITY_MARGIN, **dict(zip(("left", "low", "right", "high"), box, strict=True))}
    return out.withColumns({k: F.lit(v) for k, v in fixed.items()})


def build_area_lookup(links: DataFrame, areas: DataFrame, classes: DataFrame, output: str, *, box: tuple[float, float, float, float]) -> DataFrame:
    """The class of every link-year by the area that its part within the grid box lies in; links
    without a class are an error."""
    pieces = grid_pieces(links, "parts", "segment_id")
    edges = grid_pieces(areas, "rings", "area_id")
    points = matching.clipped_point(pieces, box)
    found = polygons.classify(points, edges, classes, point_id="segment_id")
    rows = links.select("segment_id", "count_point_id", F.col("source_year").alias("year")).join(found, "segment_id", "left").select("count_point_id", "year", "urban_rural").distinct()
    rows, seen = stored_with(rows, "lookup", F.count_if(F.col("urban_rural").isNull()).alias("lost"))
    if seen.get("lost"):
        raise gates.ValidationError(f"{seen['lost']} link-years have no area class")
    out = rows.orderBy("year", "count_point_id")
    out.write.mode("overwrite").option("header", True).csv(f"{output}/urban-rural")  # files in order, as many as there are ranges
    return out
