"""Forecast models: a design matrix, an estimator and a reduction of its predictions.

Every model offers ``fit(data, labels)`` and, once fitted, ``predict(data)`` returning
(day, stid, pred). Designs are lazy tables of keys and one feature array.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliogrid.functions.dates import distance_from_midyear, year_number
from heliogrid.functions.expressions import BASELINE_OPS, STATION_OPS, op_name, quoted
from heliogrid.operators import features as feats
from heliogrid.operators import grid as g
from heliogrid.operators import interpolate, reduce
from heliogrid.operators.blocks import clip_to, features_array
from heliogrid.operators.labels import drop_masked, mark_imputed, with_external_mask
from heliogrid.operators.perturb import COPIES, perturb_stations
from heliogrid.operators.ridge import Ridge
from heliogrid.operators.shared_ridge import SharedModel, StationRidge
from heliogrid.session import settled


@dataclass(frozen=True)
class ForecastData:
    """The tables of one forecast problem; ``ops`` are the derived features."""

    cube: DataFrame
    stations: DataFrame
    grid: DataFrame
    spec: g.GridSpec
    features: tuple[str, ...]
    hours: tuple[int, ...]
    ops: tuple = STATION_OPS
    baseline_ops: tuple = BASELINE_OPS

    def days(self, condition) -> ForecastData:
        """Restricts the cube to some days; the filter reaches the scan."""
        return replace(self, cube=self.cube.where(condition))

    def before(self, day) -> ForecastData:
        return self.days(F.col("day") < F.lit(day))

    def since(self, day) -> ForecastData:
        return self.days(F.col("day") >= F.lit(day))


# ---------------------------------------------------------------- designs


def packed(table: DataFrame, keys: list[str]) -> DataFrame:
    names = [c for c in table.columns if c not in keys]
    return features_array(table, names, keys)


def design_names(table: DataFrame, keys) -> list[str]:
    return [c for c in table.columns if c not in keys]


def baseline_rows(data: ForecastData) -> DataFrame:
    """(day, features): daily member-mean grid of features and ratios, and the distance from midyear."""
    names = [*data.features, *[op_name(*op) for op in data.baseline_ops]]
    members = feats.wide_members(data.cube, data.features, data.baseline_ops)
    short = [f"v{i}" for i in range(len(names))]
    by_hour = members.groupBy("day", "hour", "lat_i", "lon_i").agg(*[F.avg(quoted(n)).alias(s) for n, s in zip(names, short)])
    by_day = by_hour.groupBy("day", "lat_i", "lon_i").agg(*[F.avg(s).alias(s) for s in short])
    maps = g.map_vectors(by_day, ["day"], data.spec, short, short)
    return maps.select("day", F.concat(*short, F.array(distance_from_midyear(F.col("day")))).alias("features"))


def member_rows(data: ForecastData) -> DataFrame:
    """(day, ens, features): all hours and cells of one member, the year and the distance from midyear."""
    names = [f"{f}_{h}" for f in data.features for h in data.hours]
    maps = g.maps_by_label(data.cube, ["day", "ens"], F.concat_ws("_", "fx", "hour"), names, data.spec)
    arrays = [F.col(n).getField("value") for n in names]
    date = F.array(year_number(F.col("day")), distance_from_midyear(F.col("day")))
    return maps.select("day", "ens", F.concat(*arrays, date).alias("features"))


def local_table(data: ForecastData, **options) -> DataFrame:
    return feats.local_features(data.cube, data.stations, data.spec, data.features, data.hours, **options)


def edge_table(data: ForecastData, pairs=None) -> DataFrame:
    return feats.edge_features(data.cube, data.stations, data.grid, data.spec, data.features, data.hours, data.ops, pairs)


def kriged(data: ForecastData, stations: DataFrame, ids=("stid",), pairs=None) -> DataFrame:
    if not interpolate.one_place(stations, ids):
        return interpolate.interpolate_kriging(data.cube, stations, data.spec, data.grid, ids=ids)
    return interpolate.kriged_slots(data.cube, stations, data.spec, data.grid, data.features, data.hours, ids=ids, pairs=pairs)


def splined(data: ForecastData, stations: DataFrame, ids=("stid",), pairs=None) -> DataFrame:
    """Spline values of the member mean, with the member spread of the splines as sigma."""
    if interpolate.one_place(stations, ids):
        weights = interpolate.spline_weights(data.spec)
        return interpolate.slots_at_points(data.cube, stations, data.spec, weights, data.features, data.hours, ids=ids, spreads=True, pairs=pairs)
    members = interpolate.interpolate_spline(data.cube, stations, data.spec, ids=ids)
    stats = reduce.mean_and_std(members, ["day", "fx", "hour", *ids])
    return stats.withColumnsRenamed({"mean": "value", "std": "sigma"})


@dataclass(frozen=True)
class StationDesign:
    """Options of the per-station design matrix."""

    interpolator: Callable = kriged
    blocks: tuple[str, ...] = feats.BLOCKS
    with_stationinfo: bool = True
    with_date: bool = True
    with_solar: bool = False
    with_history: bool = False
    with_mean_history: bool = False
    with_climate: bool = False

    def table(self, data: ForecastData, stations=None, intp=None, extra_keys=(), station_keys=("stid",), pairs=None) -> DataFrame:
        """One row per (day, station), or per wanted pair (day, stid, y), with y."""
        stations = data.stations if stations is None else stations
        if intp is None:
            early = pairs is not None and self.interpolator in (kriged, splined) and not (self.with_history or self.with_mean_history)
            intp = self.interpolator(data, stations, station_keys, **({"pairs": pairs} if early else {}))
        design = feats.station_design(
            intp, stations, data.features, data.hours, data.ops, self.blocks, self.with_stationinfo, self.with_date,
            self.with_solar, self.with_history, self.with_mean_history, self.with_climate, extra_keys, station_keys,
        )
        return design if pairs is None or "y" in design.columns else design.join(pairs, ["day", "stid"])


# ---------------------------------------------------------------- models


@dataclass(frozen=True)
class FittedModel:
    model: StationModel
    estimator: object
    labels: DataFrame

    def predict(self, data: ForecastData, pairs: DataFrame | None = None) -> DataFrame:
        """Predictions of every (day, station), or of ``pairs`` (day, stid, y) only."""
        together = self.model.examples(data) if pairs is None else None
        if together is not None:
            return self._clipped(mean_of_examples(self.estimator, together))
        return self.predict_rows(self.model.predict_rows(data, pairs))

    def predict_rows(self, rows: DataFrame) -> DataFrame:
        """(day, stid, pred) from rows of the model's design."""
        scored = self.estimator.transform(rows)
        if self.model.extra_keys:
            pred = reduce.mean_prediction(scored)
        else:
            pred = scored.select("day", "stid", "pred")
        return self._clipped(pred)

    def predict_blocks(self, data: ForecastData, places: DataFrame, width: int, scales: DataFrame | None = None) -> DataFrame | None:
        """(day, block, values): predictions of whole blocks of stations, restored by ``scales`` (stid, y_mean, y_std), in one row each.

        ``places`` (stid, block, place) deals the stations. None where the model or its estimator has no such form.
        """
        score = getattr(self.estimator, "score", None)
        if score is None or self.model.clip or not interpolate.one_place(data.stations, ["stid"]):
            return None
        placed = data.stations.select("stid", *interpolate.PLACE).distinct().join(places, "stid")
        if scales is None:
            return self.model.block_values(data, placed, width, lambda features, _: score(features))
        restored = lambda features, s: score(features) * s.getField("y_std") + s.getField("y_mean")
        return self.model.block_values(data, placed.join(scales, "stid"), width, restored)

    def _clipped(self, pred: DataFrame) -> DataFrame:
        return clip_to(pred, self.labels) if self.model.clip else pred


def mean_of_examples(estimator, rows: DataFrame) -> DataFrame:
    """(day, stid, pred): the mean of the known predictions of a row's examples, the feature arrays _f0, _f1, ...; nothing is regrouped."""
    names = [c for c in rows.columns if c.startswith("_f")]
    scored = rows
    for i, name in enumerate(names):  # an absent example is scored as the first, and not counted
        scored = estimator.transform(scored.withColumn("features", F.coalesce(name, names[0]))).withColumnRenamed("pred", f"_p{i}")
    each = [F.when(F.col(name).isNotNull(), F.col(f"_p{i}")) for i, name in enumerate(names)]
    known = sum((p.isNotNull().cast("int") for p in each[1:]), each[0].isNotNull().cast("int"))
    total = sum((F.coalesce(p, F.lit(0.0)) for p in each[1:]), F.coalesce(each[0], F.lit(0.0)))
    return scored.select("day", "stid", F.when(known > 0, total / known).alias("pred"))


@dataclass(frozen=True)
class StationModel:
    """One row per (day, station) and, for some models, member, corner or copy.

    Labels are joined by day and station, so they repeat over the extra keys, and the
    predictions are averaged over them.
    """

    estimator: object = Ridge()
    clip: bool = False
    with_mask: bool = False
    hard_mask: DataFrame | None = None
    extra_keys: tuple[str, ...] = ()

    def table(self, data: ForecastData, pairs: DataFrame | None = None) -> DataFrame:
        """The design; with ``pairs`` (day, stid, y) the rows of these only, and their y."""
        raise NotImplementedError

    def fit_table(self, data: ForecastData, pairs: DataFrame | None = None) -> DataFrame:
        return self.table(data, pairs)

    def examples(self, data: ForecastData) -> DataFrame | None:
        """All examples of a (day, station) in one row, (day, stid, _f0, _f1, ...), where the model makes them so."""
        return None

    def block_values(self, data: ForecastData, placed: DataFrame, width: int, value) -> DataFrame | None:
        """``value`` of the features of all stations of a block in one row, (day, block, values), where the model makes them so."""
        return None

    @property
    def keys(self) -> list[str]:
        return ["day", "stid", *self.extra_keys]

    def feature_names(self, data: ForecastData) -> list[str]:
        return design_names(self.table(data), self.keys)

    def predict_rows(self, data: ForecastData, pairs: DataFrame | None = None) -> DataFrame:
        table = self.table(data, pairs)
        return packed(table if pairs is None else table.drop("y"), self.keys)

    def usable_labels(self, labels: DataFrame) -> DataFrame:
        if not self.with_mask:
            return labels
        marked = mark_imputed(labels)
        if self.hard_mask is not None:
            marked = with_external_mask(marked, self.hard_mask)
        return drop_masked(marked).drop("is_masked")

    def training_rows(self, data: ForecastData, labels: DataFrame) -> DataFrame:
        usable = self.usable_labels(labels).select("day", "stid", "y")
        return packed(self.fit_table(data, usable), [*self.keys, "y"])

    def fit(self, data: ForecastData, labels: DataFrame) -> FittedModel:
        return FittedModel(self, self.estimator.fit(self.training_rows(data, labels)), labels)


@dataclass(frozen=True)
class LocalModel(StationModel):
    """Cells around the station, day of year and station position."""

    k: int = 1

    def table(self, data, pairs=None):
        return local_table(data, k=self.k, pairs=pairs)

    def block_values(self, data, placed, width, value):
        return feats.local_examples(data.cube, placed, data.spec, data.features, data.hours, self.k, width, value)


@dataclass(frozen=True)
class EdgeModel(StationModel):
    """One example per enclosing grid cell; predictions averaged over the four."""

    extra_keys: tuple[str, ...] = ("corner",)

    def table(self, data, pairs=None):
        return edge_table(data, pairs)

    def examples(self, data):
        if not interpolate.one_place(data.stations, ["stid"]):
            return None
        return feats.edge_examples(data.cube, data.stations, data.grid, data.spec, data.features, data.hours, data.ops)


@dataclass(frozen=True)
class KrigingModel(StationModel):
    """Interpolated hourly and daily features per station."""

    design: StationDesign = field(default_factory=StationDesign)

    def table(self, data, pairs=None):
        return self.design.table(data, pairs=pairs)


@dataclass(frozen=True)
class EnsembleKrigingModel(StationModel):
    """One example per member; members are interpolated one by one."""

    design: StationDesign = field(default_factory=lambda: StationDesign(blocks=("nm_intp", "nmft_intp")))
    extra_keys: tuple[str, ...] = ("ens",)

    def table(self, data, pairs=None):
        if interpolate.one_place(data.stations, ["stid"]):
            weights = interpolate.spline_weights(data.spec)
            members = interpolate.slots_at_points(data.cube, data.stations, data.spec, weights, data.features, data.hours, ("day", "ens"), pairs=pairs)
        else:
            members = interpolate.interpolate_spline(data.cube, data.stations, data.spec)
        return self.design.table(data, intp=members, extra_keys=("ens",), pairs=pairs)


@dataclass(frozen=True)
class PerturbedKrigingModel(StationModel):
    """Trained on all perturbed copies of the stations, averaged over copies."""

    design: StationDesign = field(default_factory=StationDesign)
    extra_keys: tuple[str, ...] = ("copy",)
    copies: int = COPIES
    seed: int = 0

    def table(self, data, pairs=None):
        moved = perturb_stations(data.stations, self.copies, self.seed)
        return self.design.table(data, stations=moved, station_keys=("stid", "copy"), pairs=pairs)


@dataclass(frozen=True)
class PerturbedPredictionKrigingModel(PerturbedKrigingModel):
    """Trained on the true station positions only, predicted on all copies."""

    def fit_table(self, data, pairs=None):
        return self.design.table(data, pairs=pairs).withColumn("copy", F.lit(0))


@dataclass(frozen=True)
class FittedDayModel:
    """Per-station linear models over features shared by all stations of a day."""

    model: BaselineModel
    estimator: SharedModel
    labels: DataFrame

    def predict(self, data: ForecastData) -> DataFrame:
        rows = self.model.rows(data)
        pred = self.estimator.predict(rows, "ens" if "ens" in rows.columns else None).select("day", "stid", "pred")
        return clip_to(pred, self.labels) if self.model.clip else pred


@dataclass(frozen=True)
class BaselineModel:
    """Daily member-mean grids of features and ratios; one ridge per station."""

    estimator: StationRidge = StationRidge()
    clip: bool = False

    def rows(self, data: ForecastData) -> DataFrame:
        return baseline_rows(data)

    def fit(self, data: ForecastData, labels: DataFrame) -> FittedDayModel:
        return FittedDayModel(self, self.estimator.fit(self.rows(data), labels), labels)


@dataclass(frozen=True)
class EnsembledRegressor(BaselineModel):
    """One example per member of the whole cube of a day; predictions averaged over members and clipped to the training labels."""

    clip: bool = True

    def rows(self, data):
        return member_rows(data)


@dataclass(frozen=True)
class SeedBlend:
    """An estimator for each seed, fitted on the same rows; predictions are averaged. ``learner`` makes the estimator of a seed."""

    learner: Callable
    seeds: tuple[int, ...] = (1, 2, 3)

    def fit(self, df: DataFrame) -> Blended:
        rows = settled(df)
        return Blended(tuple(self.learner(seed).fit(rows) for seed in self.seeds))


@dataclass(frozen=True)
class Blended:
    members: tuple

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``pred``, the mean of the members' predictions; NULL where one of them has none."""
        scored = df
        for i, member in enumerate(self.members):
            scored = member.transform(scored).withColumnRenamed("pred", f"_pred{i}")
        each = [F.col(f"_pred{i}") for i in range(len(self.members))]
        return scored.withColumn("pred", sum(each[1:], each[0]) / len(each)).drop(*[f"_pred{i}" for i in range(len(each))])


@dataclass(frozen=True)
class ClimateModel:
    """Mean label by month and station."""

    def fit(self, data, labels: DataFrame):
        return _FittedClimate(reduce.climatology(labels))


@dataclass(frozen=True)
class _FittedClimate:
    climate: DataFrame

    def predict_for(self, keys: DataFrame) -> DataFrame:
        return reduce.climate_lookup(keys.select("day", "stid"), self.climate)


def constant_prediction(keys: DataFrame, labels: DataFrame, kind: str) -> DataFrame:
    """Zero, mean or median of the training labels for every (day, station)."""
    values = {"zero": F.lit(0.0), "mean": F.avg("y"), "median": F.percentile("y", F.lit(0.5))}
    if kind not in values:
        raise ValueError(f"unknown constant model {kind!r}")
    value = values[kind] if kind == "zero" else labels.agg(values[kind].alias("v")).scalar()
    return keys.select("day", "stid", value.alias("pred"))


MODELS = {
    "baseline": BaselineModel,
    "local": LocalModel,
    "kriging": KrigingModel,
    "kringing": KrigingModel,
    "ensemble_kriging": EnsembleKrigingModel,
    "perturbed_kriging": PerturbedKrigingModel,
    "perturbed_pred_kriging": PerturbedPredictionKrigingModel,
    "edgelocal": EdgeModel,
}
