"""Load models: what an object's load in a phase is taken to be, from what was recorded in earlier ones.

A model answers forecast(loads, offsets): rows (phase, object, loads), where the array has the load that the model expects
of the phase `phase + offset` for each offset, knowing the phases before `phase`; apply(loads) is that for the phase
itself. loads has phase, object, load, and subs, an array of subphase loads, where subphases are asked for:
subphases(loads, offsets) gives rows (phase, object, sub, loads). look_back() is the number of phases that a model reads.
Models are composed by passing one the other; all are lazy, and windows are partitioned by object."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class LoadModel:
    """Base of all models and of users' own, which define forecast."""

    def forecast(self, loads: DataFrame, offsets: Sequence[int] = (0,)) -> DataFrame:
        raise NotImplementedError

    def subphases(self, loads: DataFrame, offsets: Sequence[int] = (0,)) -> DataFrame:
        """Each subphase of an object is forecast as an object of its own."""
        each = loads.select("phase", "object", F.posexplode("subs").alias("sub", "load"))
        rows = self.forecast(each.select("phase", F.struct("object", "sub").alias("object"), "load"), offsets)
        return rows.select("phase", "object.object", "object.sub", "loads")

    def apply(self, loads: DataFrame) -> DataFrame:
        return self.forecast(loads).select("phase", "object", F.col("loads")[0].alias("load"))

    def look_back(self) -> int:
        return 1


def _same(offsets: Sequence[int]) -> Column:
    return F.array_repeat("load", len(offsets)).alias("loads")


class RawData(LoadModel):
    """Past loads as recorded; an object without a record in a phase has 0. It has no forecast of its own."""

    def forecast(self, loads: DataFrame, offsets: Sequence[int] = (0,)) -> DataFrame:
        # the phases are one row, so that the dense table is made object by object
        phases = loads.agg(F.collect_set("phase").alias("phases"))
        spine = loads.select("object").distinct().join(F.broadcast(phases)).select("object", F.explode("phases").alias("phase"))
        rows = spine.join(loads.select("phase", "object", "load"), ["phase", "object"], "left").withColumn("load", F.coalesce("load", F.lit(0)))
        return rows.select("phase", "object", _same(offsets))


class Recorded(LoadModel):
    """Recorded loads alone: phases without a record are left out."""

    def forecast(self, loads: DataFrame, offsets: Sequence[int] = (0,)) -> DataFrame:
        return loads.select("phase", "object", _same(offsets))


@dataclass
class Composed(LoadModel):
    base: LoadModel = field(default_factory=RawData)

    def look_back(self) -> int:
        return self.base.look_back()


def _past(n: int) -> Window:
    return Window.partitionBy("object").orderBy("phase").rowsBetween(-n, -1)


class NaivePersistence(Composed):
    """A phase, and those after it, are expected to be as the one before."""

    def forecast(self, loads: DataFrame, offsets: Sequence[int] = (0,)) -> DataFrame:
        last = F.lag("load", 1).over(Window.partitionBy("object").orderBy("phase"))
        return self.base.apply(loads).withColumn("load", last).where("load is not null").select("phase", "object", _same(offsets))


@dataclass
class MedianLastN(Composed):
    """The median of the last n phases, or of as many as there are."""

    n: int = 3

    def forecast(self, loads: DataFrame, offsets: Sequence[int] = (0,)) -> DataFrame:
        rows = self.base.apply(loads).withColumn("load", F.percentile(F.col("load"), F.lit(0.5)).over(_past(self.n)))
        return rows.where("load is not null").select("phase", "object", _same(offsets))

    def look_back(self) -> int:
        return max(self.n, self.base.look_back())


@dataclass
class Linear(Composed):
    """The line through the last n phases, continued. offset is added to those asked for."""

    n: int = 3
    offset: int = 0

    def forecast(self, loads: DataFrame, offsets: Sequence[int] = (0,)) -> DataFrame:
        w, y, x = _past(self.n), F.col("load"), F.col("phase")
        rows = self.base.apply(loads)
        rows = rows.select("phase", "object", F.count("load").over(w).alias("points"), F.regr_slope(y, x).over(w).alias("slope"), F.regr_intercept(y, x).over(w).alias("start"))
        line = [F.col("start") + F.col("slope") * (x + self.offset + k) for k in offsets]
        return rows.where("points >= 2").select("phase", "object", F.array(*line).alias("loads"))

    def look_back(self) -> int:
        return max(self.n, self.base.look_back())


@dataclass
class MultiplePhases(Composed):
    """One coarse phase is b phases: its load is the sum of what the base expects of them."""

    base: LoadModel = field(default_factory=NaivePersistence)
    b: int = 2

    def _summed(self, rows: DataFrame, offsets: Sequence[int]) -> DataFrame:
        part = lambda k: F.aggregate(F.slice("loads", k * self.b + 1, self.b), F.lit(0.0), lambda a, x: a + x)
        return rows.withColumn("loads", F.array(*(part(k) for k in range(len(offsets)))))

    def _fine(self, offsets: Sequence[int]) -> list[int]:
        return [self.b * k + i for k in offsets for i in range(self.b)]

    def forecast(self, loads: DataFrame, offsets: Sequence[int] = (0,)) -> DataFrame:
        return self._summed(self.base.forecast(loads, self._fine(offsets)), offsets)

    def subphases(self, loads: DataFrame, offsets: Sequence[int] = (0,)) -> DataFrame:
        return self._summed(self.base.subphases(loads, self._fine(offsets)), offsets)


def coarse(loads: DataFrame, b: int) -> DataFrame:
    """Recorded loads of b phases each, as one coarser phase."""
    return loads.groupBy(F.floor(F.col("phase") / b).alias("phase"), "object").agg(F.sum("load").alias("load"))


@dataclass
class Coarse(LoadModel):
    """Recorded loads, b phases as one."""

    b: int = 2

    def forecast(self, loads: DataFrame, offsets: Sequence[int] = (0,)) -> DataFrame:
        return coarse(loads, self.b).select("phase", "object", _same(offsets))


def _added(rows: DataFrame, n: int, fold) -> DataFrame:
    """Rows (phase, object, sub, loads) over their subphases, place by place of loads."""
    folded = rows.groupBy("phase", "object").agg(*(fold(F.col("loads")[k].cast("double")).alias(f"__{k}") for k in range(n)))
    return folded.select("phase", "object", F.array(*(f"__{k}" for k in range(n))).alias("loads"))


@dataclass
class Norm(Composed):
    """The norm of a phase's subphases, as the base expects them; an infinite power is their maximum."""

    power: float = 2.0

    def __post_init__(self) -> None:
        if not self.power >= 0:
            raise ValueError("a norm's power is 0 or more")

    def forecast(self, loads: DataFrame, offsets: Sequence[int] = (0,)) -> DataFrame:
        def fold(x: Column) -> Column:
            if self.power == float("inf"):
                return F.greatest(F.max(x), F.lit(0.0))
            return F.pow(F.sum(F.pow(x, F.lit(float(self.power)))), F.lit(1.0 / self.power if self.power else float("inf")))

        return _added(self.base.subphases(loads, offsets), len(offsets), fold)

    def subphases(self, loads: DataFrame, offsets: Sequence[int] = (0,)) -> DataFrame:
        return self.base.subphases(loads, offsets)


@dataclass
class SelectSubphases(Composed):
    """Subphase k is the base's subphase places[k]; one may be chosen twice. A phase is their sum."""

    places: list[int] = field(default_factory=lambda: [0])

    def forecast(self, loads: DataFrame, offsets: Sequence[int] = (0,)) -> DataFrame:
        rows = _added(self.subphases(loads, offsets), len(offsets), F.sum)
        # an object without the chosen subphases has load 0
        known = self.base.subphases(loads, offsets).select("phase", "object").distinct()
        none = F.array_repeat(F.lit(0.0), len(offsets))
        return known.join(rows, ["phase", "object"], "left").withColumn("loads", F.coalesce("loads", none))

    def subphases(self, loads: DataFrame, offsets: Sequence[int] = (0,)) -> DataFrame:
        chosen = F.array(*(F.struct(F.lit(p).alias("of"), F.lit(k).alias("sub")) for k, p in enumerate(self.places)))
        rows = self.base.subphases(loads, offsets)
        picked = F.explode(F.filter(chosen, lambda c: c["of"] == F.col("sub")))
        return rows.select("phase", "object", picked.alias("c"), "loads").select("phase", "object", F.col("c.sub").alias("sub"), "loads")


@dataclass
class PerCollection(LoadModel):
    """A model for some collections (column collection of loads), another for the rest."""

    models: dict[int, LoadModel]
    other: LoadModel = field(default_factory=RawData)

    def forecast(self, loads: DataFrame, offsets: Sequence[int] = (0,)) -> DataFrame:
        out = self.other.forecast(loads.where(~F.col("collection").isin(list(self.models))), offsets)
        for c, model in self.models.items():
            out = out.unionByName(model.forecast(loads.where(F.col("collection") == c), offsets))
        return out

    def look_back(self) -> int:
        return max(m.look_back() for m in (self.other, *self.models.values()))


def comm_overhead(loads: DataFrame, edges: DataFrame, per_message: float, per_byte: float) -> DataFrame:
    """Loads with the cost of what objects receive from other ranks."""
    cost = edges.where("from_rank != to_rank").groupBy(F.col("to_object").alias("object")).agg(F.sum(per_message * F.col("messages") + per_byte * F.col("bytes")).alias("cost"))
    return loads.join(cost, "object", "left").withColumn("load", F.col("load") + F.coalesce("cost", F.lit(0.0))).drop("cost")


def weighted_messages(loads: DataFrame, edges: DataFrame, per_message: float, per_byte: float) -> DataFrame:
    """The larger of what objects send to and receive from other ranks, weighted, as column comm."""
    far = edges.where((F.col("category") == "SendRecv") & (F.col("from_rank") != F.col("to_rank")))
    cost = F.sum(per_message * F.col("messages") + per_byte * F.col("bytes"))
    into = far.groupBy(F.col("to_object").alias("object")).agg(cost.alias("in"))
    out = far.where("from_object != to_object").groupBy(F.col("from_object").alias("object")).agg(cost.alias("out"))
    joined = loads.join(into, "object", "left").join(out, "object", "left")
    return joined.withColumn("comm", F.greatest(F.coalesce("in", F.lit(0.0)), F.coalesce("out", F.lit(0.0)))).drop("in", "out")


def weighted_volume(load: Column, comm: Column, alpha: float, beta: float, gamma: float) -> Column:
    return alpha * load + beta * comm + gamma


def proposed(loads: DataFrame, plan: DataFrame) -> DataFrame:
    """Loads (object, rank, load) as they are when the plan (object, from_rank, to_rank, load) is carried out."""
    stay = loads.join(plan.select("object"), "object", "left_anti")
    return stay.unionByName(plan.select("object", F.col("to_rank").alias("rank"), "load"))


def retained(loads: DataFrame, current: int, model: LoadModel) -> DataFrame:
    """The phases that the model still reads."""
    return loads.where(F.col("phase") >= current - model.look_back())


def subphase_count(loads: DataFrame) -> DataFrame:
    """The largest number of subphases of an object in each phase."""
    return loads.groupBy("phase").agg(F.max(F.size("subs")).alias("subphases"))
