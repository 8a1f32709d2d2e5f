"""Negative-binomial (NB2) regression with a log exposure offset, fit by distributed Newton steps.

Features are categories, so rows with the same categories share a design vector. Each iteration is
one aggregate: per combination of categories the weights and scores, added up by level and by pair
of levels, and for the dispersion sums of closed terms. The driver solves a p x p system up to DENSE
terms. Wider models are fit without any matrix: the combinations of an iteration are stored, conjugate gradients
take products with the information as aggregates of them, and coefficients are joined as a table by
level. The driver then holds vectors as long as the model has terms.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.naming import unused
from ..sources.shared import stored, stored_with
from .baseline import predict_from, training_rate
from .gates import ValidationError, not_finite, require_model_rows, require_none
from .metrics import detailed_metrics, error_metrics
from .panel import Contract, labelled

FEATURES = ("road_category", "road_type", "urban_rural", "estimation_method")
MISSING = "__missing__"
MAX_ITERATIONS = 200
#: Terms up to which the driver gets sums by pairs of levels and predictions are one expression.
DENSE = 1_000
#: Of conjugate gradients: where a step is exact enough, and products at most.
CLOSE, MAX_PRODUCTS = 1e-9, 500
#: Counts up to which the sums of the dispersion are added term by term.
SUMMED = 1_000


@dataclass(frozen=True)
class Spec:
    """A feature and its levels; the first is the reference."""

    column: str
    levels: tuple[str, ...]


@dataclass(frozen=True)
class Model:
    specs: tuple[Spec, ...]
    beta: tuple[float, ...]
    alpha: float
    iterations: int

    @property
    def names(self) -> list[str]:
        return ["intercept", *(f"{s.column}={v}" for s in self.specs for v in s.levels[1:])]


def _level(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(MISSING))


def feature_levels(rows: DataFrame, columns: Sequence[str] = FEATURES) -> DataFrame:
    """feature and its sorted levels, in one pass; null is a level of its own. Levels are made
    distinct before they meet, so an array is as long as there are levels."""
    known = [c for c in columns if c in rows.columns]
    each = rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), _level(c).alias("level")) for c in known))).alias("p")).select("p.*").distinct()
    return each.groupBy("feature").agg(F.sort_array(F.collect_list("level")).alias("levels"))


def feature_specs(rows: DataFrame, columns: Sequence[str] = FEATURES) -> tuple[Spec, ...]:
    """Features with more than one level, in the order of ``columns``; the driver holds the levels."""
    levels = {r["feature"]: tuple(r["levels"]) for r in feature_levels(rows, columns).collect()}
    return tuple(Spec(c, levels[c]) for c in columns if len(levels.get(c, ())) > 1)


def design(rows: DataFrame, specs: Sequence[Spec]) -> DataFrame:
    """``rows`` with a 0/1 column for each level but the first; a level not seen in training counts as the reference."""
    return rows.withColumns({f"x_{s.column}_{v}": F.when(_level(s.column) == v, 1.0).otherwise(0.0) for s in specs for v in s.levels[1:]})


def linear_predictor(specs: Sequence[Spec], beta: Sequence[float]) -> Column:
    out, k = F.lit(float(beta[0])), 1
    for s in specs:
        for v in s.levels[1:]:
            out = out + F.when(_level(s.column) == v, F.lit(float(beta[k]))).otherwise(0.0)
            k += 1
    return out


def _at_places(specs: Sequence[Spec], keys: Sequence[str], beta: Sequence[float]) -> Column:
    """:func:`linear_predictor` where the columns ``keys`` have the places of levels (0: not a level of training)."""
    out, at = F.lit(float(beta[0])), 1
    for s, k in zip(specs, keys, strict=True):
        n = len(s.levels) - 1
        out, at = out + F.element_at(F.array(*map(F.lit, (0.0, 0.0, *map(float, beta[at : at + n])))), F.col(k) + 1), at + n
    return out


def mean_of(model: Model, exposure: Column) -> Column:
    return exposure * F.exp(linear_predictor(model.specs, model.beta))


def with_mean(rows: DataFrame, model: Model, exposure: str, name: str) -> DataFrame:
    """``rows`` with the mean by the model; the coefficients of a wide one are joined by level."""
    if len(model.beta) <= DENSE:
        return rows.withColumn(name, mean_of(model, F.col(exposure)))
    eta, at, added = F.lit(float(model.beta[0])), 1, []
    for s in model.specs:
        n = len(s.levels) - 1
        level, b = unused(rows, "_level", "_b")
        table = rows.sparkSession.createDataFrame(pa.table({level: list(s.levels[1:]), b: list(map(float, model.beta[at : at + n]))}))
        rows, eta, at = rows.join(table, _level(s.column) == F.col(level), "left").drop(level), eta + F.coalesce(b, F.lit(0.0)), at + n
        added.append(b)
    return rows.withColumn(name, F.col(exposure) * F.exp(eta)).drop(*added)


def _joined(rows: DataFrame, keys: Sequence[str], values: np.ndarray) -> tuple[DataFrame, Column]:
    """``rows`` with what ``values`` has at the places ``keys`` (0: nothing), and its sum with ``values[0]``."""
    out = F.lit(float(values[0]))
    for c in keys:
        table = rows.sparkSession.createDataFrame(pa.table({f"_p{c}": np.arange(1, len(values)), f"_v{c}": np.asarray(values[1:], dtype=float)}))
        rows, out = rows.join(table, F.col(c) == F.col(f"_p{c}"), "left").drop(f"_p{c}"), out + F.coalesce(f"_v{c}", F.lit(0.0))
    return rows, out


def _by_place(rows: DataFrame, keys: Sequence[str], width: int, *names: str) -> list[np.ndarray]:
    """Sums of the columns ``names`` by the places of the intercept (all rows) and of each level."""
    places = [F.lit(0).cast("long"), *(F.when(F.col(c) > 0, F.col(c)) for c in keys)]
    each = rows.select(F.inline(F.array(*(F.struct(p.alias("_place"), *names) for p in places)))).where("_place is not null")
    found = each.groupBy("_place").agg(*(F.sum(n).alias(n) for n in names)).toArrow()
    out = []
    for n in names:
        x = np.zeros(width)
        x[np.asarray(found["_place"])] = np.asarray(found[n])
        out.append(x)
    return out


def conjugate_gradients(product: Callable[[np.ndarray], np.ndarray], right: np.ndarray, diagonal: np.ndarray) -> np.ndarray:
    """The x whose ``product`` is ``right``, for a positive product whose ``diagonal`` scales it."""
    scale = np.where(diagonal > 0, diagonal, 1.0)
    x, left = np.zeros_like(right), right.copy()
    near = left / scale
    way, size = near.copy(), float(left @ near)
    first = size
    for _ in range(MAX_PRODUCTS):
        if size <= CLOSE**2 * first or size == 0:
            break
        pushed = product(way)
        length = size / float(way @ pushed)
        x, left = x + length * way, left - length * pushed
        near = left / scale
        size, before = float(left @ near), size
        way = near + size / before * way
    return x


def digamma(x: Column) -> Column:
    """By its asymptotic series, ten steps up."""
    z = x + 10
    series = F.log(z) - 1 / (2 * z) - 1 / (12 * z**2) + 1 / (120 * z**4) - 1 / (252 * z**6) + 1 / (240 * z**8)
    return series - sum((1 / (x + k) for k in range(10)), F.lit(0.0))


def trigamma(x: Column) -> Column:
    z = x + 10
    series = 1 / z + 1 / (2 * z**2) + 1 / (6 * z**3) - 1 / (30 * z**5) + 1 / (42 * z**7) - 1 / (30 * z**9)
    return series + sum((1 / (x + k) ** 2 for k in range(10)), F.lit(0.0))


def rising(y: Column, t: float) -> tuple[Column, Column]:
    """The sums over k < y of 1 / (k + t) and of its square; term by term for small counts."""
    k = F.sequence(F.lit(1), F.least(y, F.lit(SUMMED)).cast("int"))
    one = F.when(y < 1, 0.0).otherwise(F.aggregate(k, F.lit(0.0), lambda s, i: s + 1 / (i - 1 + F.lit(t))))
    two = F.when(y < 1, 0.0).otherwise(F.aggregate(k, F.lit(0.0), lambda s, i: s + 1 / (i - 1 + F.lit(t)) ** 2))
    at = F.lit(t + SUMMED)
    return F.when(y <= SUMMED, one).otherwise(one + digamma(y + t) - digamma(at)), F.when(y <= SUMMED, two).otherwise(two + trigamma(at) - trigamma(y + t))


def fit(rows: DataFrame, specs: Sequence[Spec], *, target: str = "ksi_count", exposure: str = "annual_vehicle_km", tolerance: float = 1e-8) -> Model:
    """Maximum likelihood of beta and alpha; alpha is 0 where the data are not over-dispersed.

    The driver gets the sums of the score by level and, up to DENSE terms, of the information by pairs
    of levels, whatever the rows or combinations of levels. Wider models: ``conjugate_gradients``."""
    keys = [f"f{i}" for i in range(len(specs))]
    width = 1 + sum(len(s.levels) - 1 for s in specs)
    # the place of a level among its feature's, from 1, is looked up once and not in each iteration; wide models join it below
    level = lambda s: _level(s.column) if width > DENSE else F.array_position(F.array(*map(F.lit, s.levels)), _level(s.column)).cast("int")
    data = rows.select(*(level(s).alias(k) for s, k in zip(specs, keys, strict=True)), F.col(target).cast("double").alias("y"), F.col(exposure).cast("double").alias("e"))
    if width > DENSE:  # levels become their places in the design, 0 for the first
        at = 1
        for s, k in zip(specs, keys, strict=True):
            table = rows.sparkSession.createDataFrame(pa.table({"_level": list(s.levels[1:]), "_place": np.arange(at, at + len(s.levels) - 1)}))
            data = data.join(table, F.col(k) == F.col("_level"), "left").withColumn(k, F.coalesce("_place", F.lit(0).cast("long"))).drop("_level", "_place")
            at += len(s.levels) - 1
        data = stored(data, "design")
    data = data.persist()
    counts = data.groupBy("y").agg(F.count(F.lit(1)).alias("n")).persist()
    try:
        n, events, whole, top = data.agg(F.count(F.lit(1)), F.sum("y"), F.sum("e"), F.max("y")).first()
        # small counts are as few numbers; others are summed where they are
        tail = None
        if top <= SUMMED:
            tail = np.zeros(int(top))
            for r in counts.collect():
                tail[: int(r["y"])] += r["n"]
        # the places of a row's terms in the design: the intercept, and one for each level but the first
        places, at = [F.lit(0)], 1
        for s, k in zip(specs, keys, strict=True) if width <= DENSE else ():
            places.append(F.when(F.col(k) > 1, F.col(k) - 2 + at))
            at += len(s.levels) - 1
        terms = F.array_compact(F.array(*places))

        def sums(beta: np.ndarray, alpha: float) -> tuple[np.ndarray, Callable[[], np.ndarray], dict[str, float]]:
            """The gradient, what solves for the step, and the sums that the dispersion needs."""
            cols, eta = (data, _at_places(specs, keys, beta)) if width <= DENSE else _joined(data, keys, beta)
            cols = cols.withColumn("mu", F.col("e") * F.exp(eta)).withColumn("w", 1 + alpha * F.col("mu"))
            more = {"s": F.sum((F.col("y") - F.col("mu")) ** 2 - F.col("y")) / 2, "m2": F.sum(F.col("mu") ** 2)}
            if alpha > 0:
                t = 1 / alpha
                more |= {"a": F.sum(F.log(t + F.col("mu")) + (F.col("y") + t) / (t + F.col("mu"))), "b": F.sum(2 / (t + F.col("mu")) - (F.col("y") + t) / (t + F.col("mu")) ** 2)}
            combos = cols.groupBy(*keys).agg(F.sum((F.col("y") - F.col("mu")) / F.col("w")).alias("g"), F.sum(F.col("mu") / F.col("w")).alias("h"), *(v.alias(k) for k, v in more.items()))
            if width > DENSE:
                combos, total = stored_with(combos, "combinations", *(F.sum(k).alias(k) for k in more))
                gradient, diagonal = _by_place(combos, keys, width, "g", "h")

                def product(v: np.ndarray) -> np.ndarray:
                    met, along = _joined(combos.select(*keys, "h"), keys, v)
                    return _by_place(met.withColumn("hv", F.col("h") * along), keys, width, "hv")[0]

                return gradient, lambda: conjugate_gradients(product, gradient, diagonal), total
            pairs = combos.withColumn("i", F.explode(terms)).withColumn("j", F.explode(terms)).where("i <= j")
            found = pairs.groupBy("i", "j").agg(F.sum(F.when(F.col("i") == F.col("j"), F.col("g"))).alias("g"), F.sum("h").alias("h"), *(F.sum(F.when(F.col("j") == 0, F.col(k))).alias(k) for k in more)).collect()
            gradient, fisher, total = np.zeros(width), np.zeros((width, width)), {}
            for r in found:
                i, j = r["i"], r["j"]
                fisher[i, j] = fisher[j, i] = r["h"]
                if i == j:
                    gradient[i] = r["g"]
                if j == 0:
                    total = {k: r[k] for k in more}
            return gradient, lambda: np.linalg.lstsq(fisher, gradient, rcond=None)[0], total

        beta = np.zeros(width)
        beta[0] = math.log(max(events, 0.5) / whole)
        alpha = 0.0
        for k in range(1, MAX_ITERATIONS + 1):
            gradient, solve, more = sums(beta, alpha)
            drift = 0.0
            if alpha > 0:
                t = 1 / alpha
                if tail is not None:
                    terms_at = np.arange(len(tail)) + t
                    up, up2 = float((tail / terms_at).sum()), float((tail / terms_at**2).sum())
                else:
                    one, two = rising(F.col("y"), t)
                    up, up2 = counts.agg(F.sum(F.col("n") * one), F.sum(F.col("n") * two)).first()
                first = up + n * (math.log(t) + 1) - more["a"]
                second = -up2 + n / t - more["b"]
                u, v = t * first, t * t * second + t * first
                drift = abs(u)
            if max(np.abs(gradient).max(), drift) < tolerance * n:
                if alpha > 0 or more["s"] <= 0:
                    return Model(tuple(specs), tuple(beta.tolist()), alpha, k)
                alpha = 2 * more["s"] / more["m2"]  # the Poisson fit stands; go on with dispersion
                continue
            step = solve()
            beta = beta + step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-300))
            if alpha > 0:
                move = max(-1.0, min(1.0, -u / v)) if v < 0 else math.copysign(0.5, u)
                alpha = 1 / (t * math.exp(move))
        raise ValidationError(f"The fit did not converge in {MAX_ITERATIONS} iterations")
    finally:
        data.unpersist()
        counts.unpersist()


def score(model: Model, rows: DataFrame, *, target: str = "ksi_count", exposure: str = "annual_vehicle_km") -> DataFrame:
    """term and score: the derivative of the log likelihood by each coefficient, over the rows' number;
    zero at a maximum. Of alpha, where it is above 0, the derivative by its logarithm."""
    rows = with_mean(rows, model, exposure, "_mu")
    mu, y = F.col("_mu"), F.col(target).cast("double")
    rows = rows.withColumn("_left", (y - mu) / (1 + model.alpha * mu))
    parts = [F.struct(F.lit("intercept").alias("term"), F.col("_left").alias("_s"))]
    parts += [F.struct(F.concat(F.lit(f"{s.column}="), _level(s.column)).alias("term"), F.col("_left").alias("_s")) for s in model.specs]
    if model.alpha > 0:
        # of the dispersion, through its logarithm: with t = 1 / alpha
        t = 1 / model.alpha
        up = rising(y, t)[0] + math.log(t) + 1 - F.log(t + mu) - (y + t) / (t + mu)
        parts.append(F.struct(F.lit("alpha").alias("term"), (-t * up).alias("_s")))
    terms = rows.sparkSession.createDataFrame(pa.table({"term": [*model.names, "alpha"][: len(model.names) + (model.alpha > 0)]}))
    found = rows.select(F.inline(F.array(*parts))).groupBy("term").agg(F.sum("_s").alias("_s"))
    n = rows.agg(F.count(F.lit(1)).alias("_n"))
    return terms.join(found, "term", "left").join(n).select("term", (F.coalesce("_s", F.lit(0.0)) / F.col("_n")).alias("score"))


def predict(model: Model, rows: DataFrame, *, exposure: str = "annual_vehicle_km") -> DataFrame:
    """``rows`` with expected_ksi, its standard deviation and 95 % band (the lower end at least 0)."""
    out = with_mean(rows, model, exposure, "expected_ksi")
    out = out.withColumn("expected_ksi_std", F.sqrt(F.col("expected_ksi") + model.alpha * F.col("expected_ksi") ** 2))
    return out.withColumns({
        "expected_ksi_lower_95": F.greatest(F.lit(0.0), F.col("expected_ksi") - 1.96 * F.col("expected_ksi_std")),
        "expected_ksi_upper_95": F.col("expected_ksi") + 1.96 * F.col("expected_ksi_std"),
    })


def require_predictions(rows: DataFrame) -> None:
    require_none(rows, not_finite(F.col("expected_ksi")), "Found {n} predictions that are negative or not finite")


def unseen_authorities(panel: DataFrame, contract: Contract) -> DataFrame:
    """evaluation_split and local_authority_code of authorities of a scoring split that occur in no
    year outside the validation and test years."""
    rows = panel.join(F.broadcast(contract.splits(panel.sparkSession)), "year", "left")
    rows = rows.where("local_authority_code is not null").select(F.coalesce("evaluation_split", F.lit("other")).alias("evaluation_split"), F.col("local_authority_code").cast("string").alias("local_authority_code")).distinct()
    scored = rows.where("evaluation_split in ('validation', 'test')")
    other = rows.where("evaluation_split not in ('validation', 'test')").select("local_authority_code").distinct()
    return scored.join(other, "local_authority_code", "left_anti").select("evaluation_split", "local_authority_code")


def holdout_unavailable(training: DataFrame) -> str | None:
    """Why no authority can be held out, or None if one can."""
    if "local_authority_code" not in training.columns:
        return "missing_local_authority_code"
    n = training.agg(F.countDistinct(F.col("local_authority_code").cast("string"))).first()[0]
    return "fewer_than_two_training_authorities" if n < 2 else None


def authority_holdout(training: DataFrame, *, model: Model | None = None) -> DataFrame | None:
    """Metrics of a model and a baseline fit without the last authority, on that authority: model,
    held_out_authority, training_rows, n_rows and the metrics. None without two authorities (see
    :func:`holdout_unavailable`). A ``model`` that is given is not fit anew."""
    specs = model.specs if model is not None else ()
    needed = {"segment_key", "year", "ksi_count", "annual_vehicle_km", "local_authority_code", *FEATURES, *(s.column for s in specs)}
    training = stored(training.select(*(c for c in training.columns if c in needed)), "training")  # read many times below
    if holdout_unavailable(training) is not None:
        return None
    code = F.col("local_authority_code").cast("string")
    last = training.agg(F.max(code)).first()[0]
    fitted, held = training.where(code != last), training.where(code == last).withColumn("evaluation_split", F.lit("authority_holdout"))
    size = fitted.count()
    require_model_rows(fitted, F.lit("training"), ("training",))
    require_model_rows(held, F.lit("authority_holdout"), ("authority_holdout",))
    model = model or fit(fitted, feature_specs(fitted))
    both = predict(model, held).select("segment_key", "year", "ksi_count", "expected_ksi", F.lit("spf").alias("model")).unionByName(
        predict_from(training_rate(fitted), held).select("segment_key", "year", "ksi_count", "expected_ksi", F.lit("exposure_rate_baseline").alias("model"))
    )
    return detailed_metrics(both, ("model",)).withColumns({"held_out_authority": F.lit(last), "training_rows": F.lit(size).cast("long")})


@dataclass(frozen=True)
class SpfResult:
    model: Model
    predictions: DataFrame
    baseline: DataFrame
    unseen: DataFrame
    holdout: DataFrame | None
    holdout_reason: str | None = None


def safety_performance(panel: DataFrame, contract: Contract) -> SpfResult:
    """Fit on the training years, predict validation and test, and gather what promotion needs."""
    rows = labelled(panel, contract)
    require_model_rows(rows, F.when(F.col("evaluation_split") == "training", "training").otherwise("scoring"), ("training", "scoring"))
    training, scoring = rows.where("evaluation_split = 'training'"), rows.where("evaluation_split <> 'training'")
    model = fit(training, feature_specs(training))
    predictions = predict(model, scoring)
    require_predictions(predictions)
    rate = stored(training_rate(training), "rate")
    return SpfResult(model, predictions, predict_from(rate, scoring), unseen_authorities(panel, contract), authority_holdout(training), holdout_unavailable(training))


def promotion(result: SpfResult) -> DataFrame:
    """One row: promotion_blockers in fixed order, model_promoted (no blocker), and what decided: the mean
    absolute errors of model and baseline in the test years and on the held-out authority (or why there
    is none), and how many authorities the scoring years have that no other year has."""
    test = lambda df, name: error_metrics(df).where("evaluation_split = 'test'").agg(F.max("mae").alias(name))
    one = test(result.predictions, "test_mae").join(test(result.baseline, "baseline_test_mae")).join(result.unseen.agg(F.count(F.lit(1)).alias("unseen_authorities")))  # single rows
    errors = {"holdout_mae": "spf", "baseline_holdout_mae": "exposure_rate_baseline"}
    if result.holdout is None:
        one = one.withColumns({name: F.lit(None).cast("double") for name in errors})
    else:
        one = one.join(result.holdout.agg(*(F.max(F.when(F.col("model") == model, F.col("mae"))).alias(name) for name, model in errors.items())))
    worst, held = F.lit(math.inf), F.lit(result.holdout is not None)
    blockers = {
        "no_future_unseen_authorities": F.col("unseen_authorities") == 0, "authority_holdout_unavailable": ~held,
        "no_future_test_mae_improvement": F.coalesce("test_mae", worst) >= F.coalesce("baseline_test_mae", worst),
        "authority_holdout_does_not_beat_baseline": held & (F.coalesce("holdout_mae", worst) >= F.coalesce("baseline_holdout_mae", worst)),
    }
    found = F.array_compact(F.array(*(F.when(bad, F.lit(k)) for k, bad in blockers.items())))
    return one.select(F.array_join(found, ",").alias("promotion_blockers"), (F.size(found) == 0).alias("model_promoted"), "test_mae", "baseline_test_mae", *errors, F.lit(result.holdout_reason).cast("string").alias("holdout_unavailable_reason"), "unseen_authorities")


def coefficients(model: Model, like: DataFrame) -> DataFrame:
    rows = [*zip(model.names, model.beta, strict=True), ("alpha", model.alpha)]
    return like.sparkSession.createDataFrame([(k, float(v)) for k, v in rows], "term string, estimate double")
