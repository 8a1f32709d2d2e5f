"""Spatial joins of points with straight pieces, by grid cells.

A piece is entered in every cell that its bounding box, grown by the distance, touches; a point is
in one cell; so an equality join on cells finds all pairs within the distance, each once for a piece.
Full cells are cut in four like a quadtree's, by counts that are taken first.

What is joined are places and shapes: points at equal coordinates are one place, and equal pieces one
shape, however many points and lines have them. The points get what their place has found. Where only the nearest
lines are asked for, lines of equal shapes are one bundle that is known by its smallest id.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import cells_between, clip_range, piece_distance
from ..sources.shared import stored, stored_with

MAX_DISTANCE = 50.0
AMBIGUITY_MARGIN = 10.0
CELL = 500.0
LONGEST = 10
#: A cell with more points and pieces than this, and than a CELLS-th of all, is cut; at most DEPTH times.
FULL, CELLS, DEPTH = 50_000, 10_000, 4
#: Where pairs of points and lines are wanted, a task makes about so many at most.
PAIRS = 20_000_000
#: Rounds of the nearest join: distances in cells.
ROUNDS = (0.5, 4.0)


def split_pieces(pieces: DataFrame, longest: float) -> DataFrame:
    """Pieces cut so that none is longer: a long diagonal would fill its whole bounding box with cells."""
    n = F.greatest(F.lit(1), F.ceil(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) / longest))
    cut = pieces.withColumn("_n", n.cast("int")).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    at = lambda a, b, i: F.when(i == 0, a).when(i == F.col("_n"), b).otherwise(a + (b - a) * i / F.col("_n"))
    i, x1, y1, x2, y2 = (F.col(c) for c in ("_i", "x1", "y1", "x2", "y2"))
    return cut.withColumns({"x1": at(x1, x2, i), "y1": at(y1, y2, i), "x2": at(x1, x2, i + 1), "y2": at(y1, y2, i + 1)}).drop("_n", "_i")


def _cell(column: str, size: float) -> Column:
    return F.floor(F.col(column) / size).cast("long")


def _merged(df: DataFrame) -> DataFrame:
    """``df`` for a sort-merge join: the planner takes rows that are made by exploding for as few as their source has,
    and would broadcast them."""
    return df.hint("merge")


def _meetings(points: DataFrame, pieces: DataFrame, distance: float, size: float, by: tuple[str, ...], point_id: str, line_id: str, *more: str) -> DataFrame:
    """Pairs of a point and a piece that share a leaf of the cells' quadtree: by, point_id, x, y, line_id, the piece and
    its columns ``more``. A piece may meet a point once for each of its cut parts. The cells, if none was cut, are there too."""
    spread = split_pieces(pieces.select(*by, line_id, *more, "x1", "y1", "x2", "y2"), LONGEST * size)
    spread = spread.withColumns({"_xa": F.least("x1", "x2") - distance, "_xb": F.greatest("x1", "x2") + distance, "_ya": F.least("y1", "y2") - distance, "_yb": F.greatest("y1", "y2") + distance})
    spread = spread.withColumn("_cx", F.explode(cells_between(F.col("_xa"), F.col("_xb"), size))).withColumn("_cy", F.explode(cells_between(F.col("_ya"), F.col("_yb"), size)))
    at = points.where("x is not null and y is not null").select(*by, point_id, "x", "y")
    at = at.withColumns({"_cx": _cell("x", size), "_cy": _cell("y", size)})
    keys = [*by, "_cx", "_cy"]
    one, none = F.lit(1).alias("_points"), F.lit(0).alias("_pieces")
    other = (F.lit(0).alias("_points"), F.lit(1).alias("_pieces"))
    both = [F.sum("_points").alias("_points"), F.sum("_pieces").alias("_pieces")]
    whole = F.col("_points") + F.col("_pieces")
    total, most = at.select(*keys, one, none).unionByName(spread.select(*keys, *other)).groupBy(*keys).agg(*both).agg(F.sum(whole), F.max(whole)).first()
    bound = max(FULL, (total or 0) // CELLS)
    if (most or 0) <= bound:
        return at.join(_merged(spread.drop("_xa", "_xb", "_ya", "_yb")), keys)
    fine = {f"_c{c}": _cell(c, size / 2**DEPTH) for c in "xy"}
    within = lambda a, b, c: F.greatest(F.col(c) * size, F.least((F.col(c) + 1) * size, (F.col(a) + F.col(b)) / 2))  # noqa: E731  the middle, or what is nearest to it in the cell
    middles = spread.withColumns({"x": within("x1", "x2", "_cx"), "y": within("y1", "y2", "_cy")})
    counts = stored(at.withColumns(fine).select(*keys, one, none).unionByName(middles.withColumns(fine).select(*keys, *other)).groupBy(*keys).agg(*both), "cells")

    def full(level: int) -> DataFrame:
        up = [F.floor(F.col(c) / 2 ** (DEPTH - level)).cast("long").alias(c) for c in ("_cx", "_cy")]
        return counts.groupBy(*by, *up).agg(*both).where(whole > bound)

    # a full cell is cut in four, down to DEPTH; what stays full is cut by hashes of its points and pieces
    at, spread = at.withColumn("_level", F.lit(0)), spread.withColumn("_level", F.lit(0))
    for level in range(DEPTH):
        marked = F.broadcast(full(level).select(*keys, F.lit(True).alias("_full")))  # CELLS rows at most
        here = F.col("_full") & (F.col("_level") == level)
        at = at.join(marked, keys, "left").withColumns({f"_c{c}": F.when(here, _cell(c, size / 2 ** (level + 1))).otherwise(F.col(f"_c{c}")) for c in "xy"})
        at = at.withColumn("_level", F.when(here, level + 1).otherwise(F.col("_level"))).drop("_full")
        spread = spread.join(marked, keys, "left")
        for c in "xy":
            half = size / 2 ** (level + 1)
            low = F.greatest(2 * F.col(f"_c{c}"), F.floor(F.col(f"_{c}a") / half).cast("long"))
            high = F.least(2 * F.col(f"_c{c}") + 1, F.floor(F.col(f"_{c}b") / half).cast("long"))
            spread = spread.withColumn(f"_n{c}", F.when(here, F.sequence(low, high)).otherwise(F.array(f"_c{c}")))
        spread = spread.withColumn("_cx", F.explode("_nx")).withColumn("_cy", F.explode("_ny")).withColumn("_level", F.when(here, level + 1).otherwise(F.col("_level"))).drop("_full", "_nx", "_ny")
    keys = [*keys, "_level"]
    # exact counts of the leaves, as a piece is also entered beside the cell of its middle
    leaves = at.select(*keys, one, none).unionByName(spread.select(*keys, *other)).groupBy(*keys).agg(F.sum("_points").alias("_p"), F.sum("_pieces").alias("_l"))
    deepest = leaves.where(F.greatest("_p", "_l") > bound).select(*keys, F.ceil(F.col("_p") / bound).alias("_p"), F.ceil(F.col("_l") / bound).alias("_l"))
    parts = {"_p": F.greatest(F.lit(1), F.coalesce("_p", F.lit(1))), "_l": F.greatest(F.lit(1), F.coalesce("_l", F.lit(1)))}
    at, spread = (df.join(F.broadcast(deepest), keys, "left").withColumns(parts) for df in (at, spread))
    numbers = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    at = at.withColumn("_i", F.pmod(F.xxhash64(point_id, "x", "y"), "_p")).withColumn("_j", numbers("_l")).drop("_p", "_l")
    spread = spread.withColumn("_j", F.pmod(F.xxhash64(line_id, "x1", "y1", "x2", "y2"), "_l")).withColumn("_i", numbers("_p")).drop("_p", "_l", "_xa", "_xb", "_ya", "_yb")
    return at.join(_merged(spread), [*keys, "_i", "_j"]).drop("_cx", "_cy", "_level", "_i", "_j")


def _dealt(met: DataFrame, by: tuple[str, ...]) -> list[str]:
    """The columns by which all pairs of a place lie in one task. x and y tell the cells, and grouped by these too the pairs need no shuffle."""
    return [*by, *(c for c in ("_cx", "_cy") if c in met.columns)]


def _gap() -> Column:
    return piece_distance(*(F.col(c) for c in ("x", "y", "x1", "y1", "x2", "y2")))


def _places(points: DataFrame, by: tuple[str, ...]) -> tuple[DataFrame, DataFrame | None, float]:
    """The distinct places of points (by, x, y and ``_place``, a hash), those with so many points that these are dealt (by, x, y and ``_parts``),
    and the points of a place on average."""
    crowds = points.where("x is not null and y is not null").groupBy(*by, "x", "y").agg(F.count(F.lit(1)).alias("_crowd"))
    places, seen = stored_with(crowds, "places", F.max("_crowd").alias("most"), F.sum("_crowd").alias("total"), F.avg("_crowd").alias("mean"))
    bound = max(FULL, (seen.get("total") or 0) // CELLS)
    crowded = places.where(F.col("_crowd") > bound).select(*by, "x", "y", F.ceil(F.col("_crowd") / bound).alias("_parts"))  # CELLS rows at most
    return places.select(*by, "x", "y", F.xxhash64("x", "y").alias("_place")), crowded if (seen.get("most") or 0) > bound else None, seen.get("mean") or 0.0


def _dealt_join(points: DataFrame, found: DataFrame, keys: list[str], tasks: int) -> DataFrame:
    """The inner join of points and ``found`` on ``keys``, x and y in ``tasks`` tasks or more. The key for these is a hash, as the planner would
    shuffle again by floating-point keys, in tasks of its own number; that the coordinates are equal is checked for each pair."""
    points, found = (df.withColumn("_key", F.xxhash64("x", "y")) for df in (points, found.withColumns({"_x": F.col("x"), "_y": F.col("y")})))
    keys, same = [*keys, "_key"], (F.col("x") - F.col("_x") == 0) & (F.col("y") - F.col("_y") == 0)
    return points.repartition(tasks, *keys).join(_merged(found.drop("x", "y")), keys).where(same).drop("_key", "_x", "_y")


def _at_place(points: DataFrame, found: DataFrame, crowded: DataFrame | None, by: tuple[str, ...], how: str = "inner", tasks: int = 0) -> DataFrame:
    """``points`` with what their place has in ``found``. Points of a crowded place are dealt to parts, and its rows
    go to all of them, so that it is no hot key. An inner join has ``tasks`` tasks or more if that is more than the session runs at once;
    else the planner tells their number."""
    keys = [*by, "x", "y"]
    many = tasks > points.sparkSession.sparkContext.defaultParallelism
    if crowded is None:
        return _dealt_join(points, found, list(by), tasks) if many else points.join(_merged(found), keys, how)
    parts = F.coalesce("_parts", F.lit(1).cast("long"))
    points, found = (df.join(F.broadcast(crowded), keys, "left") for df in (points, found))
    points = points.withColumn("_part", F.floor(F.rand(1) * parts)).drop("_parts")
    found = found.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("_parts")
    joined = _dealt_join(points, found, [*by, "_part"], tasks) if many else points.join(_merged(found), [*keys, "_part"], how)
    return joined.drop("_part")


def _near_places(places: DataFrame, pieces: DataFrame, distance: float, line_id: str, cell: float, by: tuple[str, ...], digits: int | None) -> DataFrame:
    """The lines at most ``distance`` from each place: by, x, y, line_id, distance (rounded to ``digits``)."""
    shapes = pieces.select(*by, line_id, F.struct("x1", "y1", "x2", "y2").alias("_shape")).distinct()
    found = _meetings(places, shapes.select(*by, "_shape").distinct().select(*by, "_shape", "_shape.*"), distance, max(cell, distance), by, "_place", "_shape")
    dealt = _dealt(found, by)
    found = found.select(*dealt, "x", "y", "_shape", _gap().alias("distance")).where(F.col("distance") <= distance)
    least = F.min("distance") if digits is None else F.round(F.min("distance"), digits)
    found = found.groupBy(*dealt, "x", "y", "_shape").agg(least.alias("distance")).join(_merged(shapes), [*by, "_shape"])
    return found.groupBy(*by, "x", "y", line_id).agg(F.min("distance").alias("distance"))


def _bundles(pieces: DataFrame, line_id: str, by: tuple[str, ...]) -> DataFrame:
    """The pieces of one line for all that have the same shapes: by, line_id (the smallest), ``_lines`` (how many) and the piece."""
    shapes = pieces.groupBy(*by, line_id).agg(F.array_sort(F.collect_set(F.struct("x1", "y1", "x2", "y2"))).alias("_shapes"))
    lines = shapes.groupBy(*by, "_shapes").agg(F.min(line_id).alias(line_id), F.count(F.lit(1)).alias("_lines"))
    return stored(lines, "bundles").select(*by, line_id, "_lines", F.inline("_shapes"))


def _near_bundles(places: DataFrame, bundles: DataFrame, distance: float, line_id: str, cell: float, by: tuple[str, ...]) -> tuple[DataFrame, list[str]]:
    """The bundles at most ``distance`` from each place: by, x, y, line_id, ``_lines``, distance; and the columns by which they are dealt."""
    found = _meetings(places, bundles, distance, max(cell, distance), by, "_place", line_id, "_lines")
    dealt = _dealt(found, by)
    found = found.select(*dealt, "x", "y", line_id, "_lines", _gap().alias("distance")).where(F.col("distance") <= distance)
    return found.groupBy(*dealt, "x", "y", line_id, "_lines").agg(F.min("distance").alias("distance")), dealt


def _ids(points: DataFrame, by: tuple[str, ...], point_id: str) -> tuple[DataFrame, bool]:
    """by, point_id, x, y once each, with ``_mixed``: the id is missing or has several places. And whether any is."""
    own = Window.partitionBy(*by, point_id)
    rows = points.select(*by, point_id, "x", "y").distinct().withColumn("_mixed", (F.count(F.lit(1)).over(own) > 1) | F.col(point_id).isNull())
    rows, seen = stored_with(rows, "ids", F.count_if("_mixed").alias("mixed"))
    return rows, bool(seen.get("mixed"))


def within_distance(points: DataFrame, pieces: DataFrame, distance: float, *, point_id: str = "collision_index", line_id: str = "segment_id", cell: float = CELL, by: tuple[str, ...] = (), digits: int | None = None) -> DataFrame:
    """All lines at most ``distance`` (inclusive) from a point: point_id, line_id, distance, by.

    points: point_id, x, y; pieces: line_id, x1, y1, x2, y2; with ``by`` (a year, say) both have these
    columns too, and only equal ones meet. Points without coordinates have none. A cell with over FULL
    places and shapes (or a CELLS-th of all) is cut in four, again and again, so no task gets more of one key.
    The pairs come out of the join with the points' places and are not shuffled, unless ids repeat at several places.
    There may be far more pairs than points and lines: what can be done once for a place (rounding to ``digits``) is not done
    for each pair, and the join has a task for at most some PAIRS pairs, as its input tells nothing of them.
    """
    ids, mixed = _ids(points, by, point_id)
    places, crowded, mean = _places(ids, by)
    near, seen = stored_with(_near_places(places, pieces, distance, line_id, cell, by, digits), "near", F.count(F.lit(1)).alias("rows"))
    tasks = math.ceil((seen.get("rows") or 0) * mean / PAIRS)
    columns = [point_id, line_id, "distance", *by]
    found = _at_place(ids.where("not _mixed"), near, crowded, by, tasks=tasks).select(columns)
    if mixed:
        more = _at_place(ids.where("_mixed"), near, crowded, by, tasks=tasks)
        found = found.unionByName(more.groupBy(*by, point_id, line_id).agg(F.min("distance").alias("distance")).select(columns))
    return found


def _box_range(prefix: str = "") -> tuple[Column, Column]:
    """The least and the largest distance of the point (x, y) from anything that fills the box."""
    low, high = [], []
    for axis in ("x", "y"):
        at, a, b = F.col(axis), F.col(f"_{axis}a"), F.col(f"_{axis}b")
        low.append(F.greatest(a - at, at - b, F.lit(0.0)))
        high.append(F.greatest(F.abs(at - a), F.abs(at - b)))
    return F.hypot(*low), F.hypot(*high)


def nearest(points: DataFrame, pieces: DataFrame, *, point_id: str = "collision_index", line_id: str = "segment_id", cell: float = CELL, by: tuple[str, ...] = ()) -> DataFrame:
    """The nearest line of every point with coordinates: point_id, line_id, distance, by; ties go to the
    smaller line id. ``by`` as in :func:`within_distance`.

    Rounds of the distance join with growing distances (ROUNDS) settle the places that have a line so
    near; only the others go on, and those beyond all rounds go down through boxes (:func:`_far`).
    """
    points = points.where("x is not null and y is not null").select(*by, point_id, "x", "y")
    left, crowded, _ = _places(points, by)
    found = _at_place(points, _nearest_lines(left, pieces, line_id, cell, by), crowded, by).groupBy(*by, point_id).agg(F.min("_n").alias("_n"))
    return found.select(point_id, F.col(f"_n.{line_id}").alias(line_id), F.col("_n.distance").alias("distance"), *by)


def _nearest_lines(left: DataFrame, pieces: DataFrame, line_id: str, cell: float, by: tuple[str, ...]) -> DataFrame:
    """by, x, y and ``_n``, the distance and id of the nearest line, of the places ``left``."""
    # of the lines of a shape the one with the smallest id stands for all
    pieces = stored(pieces.groupBy(*by, "x1", "y1", "x2", "y2").agg(F.min(line_id).alias(line_id)), "shapes")
    best, keys = None, [*by, "x", "y"]
    for part in ROUNDS:
        radius = part * cell
        near = _meetings(left, pieces, radius, max(cell, radius), by, "_place", line_id)
        dealt = _dealt(near, by)
        near = near.select(*dealt, "x", "y", F.struct(_gap().alias("distance"), line_id).alias("_n")).where(F.col("_n.distance") <= radius)
        near = near.groupBy(*dealt, "x", "y").agg(F.min("_n").alias("_n")).select(*keys, "_n")
        state, seen = stored_with(left.join(near, keys, "left"), "nearest", F.count_if(F.col("_n").isNull()).alias("left"))
        found = state.where("_n is not null").select(*keys, "_n")
        best = found if best is None else best.unionByName(found)
        left = state.where("_n is null").select(*keys, "_place")
        if not seen.get("left"):
            break
    else:
        best = best.unionByName(_far(left, pieces, line_id, cell, by))
    return best


def _far(places: DataFrame, pieces: DataFrame, line_id: str, cell: float, by: tuple[str, ...]) -> DataFrame:
    """by, x, y and ``_n``, the distance and id of the nearest line, however far.

    Pieces lie in cells by their middles, each in one; cells of four times the size hold these, up to
    a few that hold all. From there a point goes down through the boxes around what the cells hold,
    and leaves out those that begin beyond where the nearest ends. So it meets the pieces of a few
    cells, however far it is from all of them, and no cell's pieces meet all points.
    """
    own = split_pieces(pieces.select(*by, line_id, "x1", "y1", "x2", "y2"), LONGEST * cell)
    box = {"_xa": F.least("x1", "x2"), "_xb": F.greatest("x1", "x2"), "_ya": F.least("y1", "y2"), "_yb": F.greatest("y1", "y2")}
    own = own.withColumns({**box, "_cx": F.floor((F.col("x1") + F.col("x2")) / (2 * cell)).cast("long"), "_cy": F.floor((F.col("y1") + F.col("y2")) / (2 * cell)).cast("long")})
    joined = lambda at: at.groupBy(*by, "_cx", "_cy").agg(F.min("_xa").alias("_xa"), F.max("_xb").alias("_xb"), F.min("_ya").alias("_ya"), F.max("_yb").alias("_yb"))
    least, most = F.array(F.min("_cx"), F.min("_cy")), F.array(F.max("_cx"), F.max("_cy"))
    cells, seen = stored_with(joined(own), "boxes", least.alias("least"), most.alias("most"))
    steps = [cells]
    span = max((b - a for a, b in zip(seen.get("least", [None]), seen.get("most", [None]), strict=True) if a is not None), default=0) + 1
    for _ in range(max(1, math.ceil(math.log(span, 4)))):  # each level from the one below
        steps.append(stored(joined(steps[-1].withColumns({c: F.floor(F.col(c) / 4).cast("long") for c in ("_cx", "_cy")})), "boxes"))
    left = places
    for level, inner in reversed(list(enumerate(steps))):
        if level == len(steps) - 1:  # at most two cells each way
            left = left.join(F.broadcast(inner), list(by)) if by else left.join(F.broadcast(inner))
        else:
            inner = inner.withColumns({f"_p{c}": F.floor(F.col(f"_c{c}") / 4).cast("long") for c in "xy"})
            left = left.withColumnsRenamed({"_cx": "_px", "_cy": "_py"}).join(_merged(inner), [*by, "_px", "_py"]).drop("_px", "_py")
        near, far = _box_range()
        left = left.withColumns({"_least": near, "_most": far})
        left = left.withColumn("_reach", F.min("_most").over(Window.partitionBy(*by, "x", "y"))).where(F.col("_least") <= F.col("_reach") * (1 + 1e-12) + 1e-9)
        left = left.select(*by, "x", "y", "_cx", "_cy")
    found = left.join(_merged(own.drop(*box)), [*by, "_cx", "_cy"]).select(*by, "x", "y", F.struct(_gap().alias("distance"), line_id).alias("_n"))
    return found.groupBy(*by, "x", "y").agg(F.min("_n").alias("_n"))


def _two_nearest(candidates: DataFrame, keys: list[str], line_id: str) -> DataFrame:
    """Each key's nearest line ``_line``, the distances ``_d1`` and ``_d2`` of the two nearest lines and the number ``_n`` of
    lines; candidates are bundles, and of two lines or more both are as near."""
    own = Window.partitionBy(*keys)
    ranked = candidates.withColumn("_n", F.sum("_lines").over(own)).withColumn("_rank", F.row_number().over(own.orderBy("distance", line_id)))
    first, second = F.col("_rank") == 1, F.when(F.col("_rank") == 1, F.when(F.col("_lines") > 1, F.col("distance"))).otherwise(F.col("distance"))
    return ranked.where("_rank <= 2").groupBy(*keys).agg(
        F.max(F.when(first, F.col(line_id))).alias("_line"), F.min(F.when(first, F.col("distance"))).alias("_d1"), F.min(second).alias("_d2"), F.max("_n").alias("_n"),
    )


def match(points: DataFrame, pieces: DataFrame, *, max_distance: float = MAX_DISTANCE, margin: float = AMBIGUITY_MARGIN, point_id: str = "collision_index", line_id: str = "segment_id", with_nearest: bool = True, by: tuple[str, ...] = ()) -> DataFrame:
    """One row a point: match_status, line_id (null unless accepted), nearest_<line_id>, distance_m,
    second_distance_m, candidate_count.

    A point is out of range without a candidate, ambiguous if the second candidate is at most
    ``margin`` farther than the first (unrounded), else accepted. Distances are rounded to 2
    places. ``with_nearest`` also finds the nearest line of points out of range. ``by`` as in
    :func:`within_distance`; its columns come first in the result.
    """
    keys, at = [*by, point_id], [*by, "x", "y"]
    ids, mixed = _ids(points, by, point_id)
    places, crowded, _ = _places(ids, by)
    bundles = _bundles(pieces, line_id, by)
    near, dealt = _near_bundles(places, bundles, max_distance, line_id, CELL, by)
    rows, lines = points.select(*keys, "x", "y"), bundles.drop("_lines")
    if not mixed:  # the candidates of points are those of their places, and are neither shuffled nor written out
        top = stored(_two_nearest(near, [*dealt, "x", "y"], line_id).select(*at, "_line", "_d1", "_d2", "_n"), "top")
        if with_nearest:
            far = _nearest_lines(places.join(top, at, "left_anti"), lines, line_id, CELL, by)
            top = top.unionByName(far.select(*at, F.col(f"_n.{line_id}").alias("_far"), F.col("_n.distance").alias("_far_d")), allowMissingColumns=True)
        rows = _at_place(rows, top, crowded, by, "left")
    else:
        near = stored(near.select(*at, line_id, "_lines", "distance"), "near")
        best = _at_place(ids.where("not _mixed"), _two_nearest(near, at, line_id), crowded, by).select(*keys, "_line", "_d1", "_d2", "_n")
        more = _at_place(ids.where("_mixed"), near, crowded, by).groupBy(*keys, line_id, "_lines").agg(F.min("distance").alias("distance"))
        rows = rows.join(_merged(best.unionByName(_two_nearest(more, keys, line_id))), keys, "left")
        if with_nearest:
            rows = stored(rows, "matched")  # the distance join serves both what it found and what it lost
            lost = rows.where("_d1 is null").select(*keys, "x", "y")
            far = nearest(lost, lines, point_id=point_id, line_id=line_id, by=by).select(*keys, F.col(line_id).alias("_far"), F.col("distance").alias("_far_d"))
            rows = rows.join(far, keys, "left")
    if not with_nearest:
        rows = rows.withColumns({"_far": F.lit(None).cast(pieces.schema[line_id].dataType), "_far_d": F.lit(None).cast("double")})
    status = F.when(F.col("_d1").isNull(), "out_of_range").when(F.col("_d2") - F.col("_d1") <= margin, "ambiguous").otherwise("accepted")
    return rows.withColumn("match_status", status).select(
        *by, point_id, "match_status", F.when(F.col("match_status") == "accepted", F.col("_line")).alias(line_id), F.coalesce("_line", "_far").alias(f"nearest_{line_id}"),
        F.bround(F.coalesce("_d1", "_far_d"), 2).alias("distance_m"), F.bround("_d2", 2).alias("second_distance_m"), F.coalesce("_n", F.lit(0)).alias("candidate_count"),
    )


def lines_in_box(pieces: DataFrame, box: tuple[float, float, float, float], line_id: str = "segment_id") -> DataFrame:
    """Ids of lines that meet the closed box (left, low, right, high); touching counts."""
    enter, leave = clip_range(*(F.col(c) for c in ("x1", "y1", "x2", "y2")), box)
    return pieces.where(enter <= leave).select(line_id).distinct()


def clipped_point(pieces: DataFrame, box: tuple[float, float, float, float], line_id: str = "segment_id") -> DataFrame:
    """A point on each line within the box: line_id, x, y. Of the middles of the clipped pieces it is
    the one nearest their common centre."""
    c = [F.col(k) for k in ("x1", "y1", "x2", "y2")]
    enter, leave = clip_range(*c, box)
    inside = pieces.withColumns({"_a": enter, "_b": leave}).where("_a <= _b")
    half = (F.col("_a") + F.col("_b")) / 2
    mids = inside.select(line_id, (c[0] + (c[2] - c[0]) * half).alias("x"), (c[1] + (c[3] - c[1]) * half).alias("y"))
    centre = mids.groupBy(line_id).agg(F.avg("x").alias("_mx"), F.avg("y").alias("_my"))
    off = F.hypot(F.col("x") - F.col("_mx"), F.col("y") - F.col("_my"))
    return mids.join(centre, line_id).groupBy(line_id).agg(F.min(F.struct(off.alias("off"), "x", "y")).alias("_p")).select(line_id, F.col("_p.x").alias("x"), F.col("_p.y").alias("y"))


def line_length(pieces: DataFrame, line_id: str = "segment_id") -> DataFrame:
    return pieces.groupBy(line_id).agg((F.sum(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))) / 1000).alias("geometry_length_km"))
