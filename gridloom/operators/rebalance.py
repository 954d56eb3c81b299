"""Orders of objects, and plans that move them between ranks.

A plan has rows (object, from_rank, to_rank). Those that come from one formula are plain columns. Greedy and hierarchical
plans are sequential by nature: they run as one pandas task for each phase, on the objects that ranks give away only."""

from __future__ import annotations

import heapq
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.session import ship


def rotated(rank: Column, ranks: int, times: Column | int = 1) -> Column:
    """The rank to which so many rotations move an object."""
    return F.pmod(rank + times, F.lit(ranks))


def rotate(objects: DataFrame, ranks: int) -> DataFrame:
    return objects.where("migratable").select("object", F.col("rank").alias("from_rank"), rotated(F.col("rank"), ranks).alias("to_rank"))


def random_plan(objects: DataFrame, ranks: int, seed: int, phase: int) -> DataFrame:
    """All but each rank's first object to a drawn rank; equal seeds and phases give equal plans."""
    first = F.row_number().over(Window.partitionBy("rank").orderBy("object"))
    to = F.pmod(F.xxhash64(F.lit(seed + phase), "rank", "object"), F.lit(ranks)).alias("to_rank")
    rows = objects.withColumn("__r", first).where("__r > 1 and migratable")
    return rows.select("object", F.col("rank").alias("from_rank"), to).where("from_rank != to_rank")


def offline(objects: DataFrame, recorded: DataFrame, phase: int) -> DataFrame:
    """The placement recorded for the phase after this one."""
    target = recorded.where(F.col("phase") == phase + 1).select("object", F.col("rank").alias("to_rank"))
    return objects.join(target, "object").where("rank != to_rank").select("object", F.col("rank").alias("from_rank"), "to_rank")


def decide(phase: Column, interval: int, offset: int = 0) -> Column:
    """Whether a phase is rebalanced."""
    return (phase % interval == offset) | ((F.lit(interval) == 1) & (phase != 0))


def applied(objects: DataFrame, plan: DataFrame) -> DataFrame:
    moved = objects.join(plan.select("object", "to_rank"), "object", "left")
    return moved.withColumn("rank", F.coalesce("to_rank", "rank")).drop("to_rank")


def normalised(plan: DataFrame, keep_self: bool = False) -> DataFrame:
    """Arrivals and departures of each rank, without moves to the same one."""
    moves = plan if keep_self else plan.where("from_rank != to_rank")
    both = moves.select(F.col("from_rank").alias("rank"), F.lit(0).alias("arrive"), F.lit(1).alias("depart")).unionByName(
        moves.select(F.col("to_rank").alias("rank"), F.lit(1).alias("arrive"), F.lit(0).alias("depart"))
    )
    return both.groupBy("rank").agg(F.sum("arrive").alias("arrive"), F.sum("depart").alias("depart"))


def order_fewest_migrations(objects: DataFrame, target: Column, by: str = "rank") -> DataFrame:
    """place: first the loads up to the cut, largest first, then those above it, smallest first. The cut is the least
    load that covers what the rank has over the target, or else the rank's load."""
    of = Window.partitionBy(by)
    total = F.sum("load").over(of)
    cut = F.coalesce(F.min(F.when(F.col("load") >= F.col("__total") - target, F.col("load"))).over(of), F.col("__total"))
    rows = objects.withColumn("__total", total).withColumn("cut", cut)
    return _by_cut(rows, by).drop("__total")


def order_small_objects(objects: DataFrame, target: Column, by: str = "rank") -> DataFrame:
    """As order_fewest_migrations with another cut: loads are taken off from the smallest on, and the cut is the one with
    which the rank comes to the target."""
    of = Window.partitionBy(by)
    run = F.sum("load").over(of.orderBy("load", "object").rowsBetween(Window.unboundedPreceding, 0))
    rows = objects.withColumn("__total", F.sum("load").over(of)).withColumn("__run", run)
    cut = F.coalesce(F.min(F.when(F.col("__run") >= F.col("__total") - target, F.col("load"))).over(of), F.col("__total"))
    return _by_cut(rows.withColumn("cut", cut), by).drop("__total", "__run")


def _by_cut(rows: DataFrame, by: str) -> DataFrame:
    low = F.col("load") <= F.col("cut")
    keys = [F.when(low, 0).otherwise(1), F.when(low, -F.col("load")).otherwise(F.col("load")), F.col("object")]
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*keys)))


def order_largest(objects: DataFrame, by: str = "rank") -> DataFrame:
    return objects.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("load"), "object")))


def order_by_id(objects: DataFrame, by: str = "rank") -> DataFrame:
    return objects.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy("object")))


def underloaded(load: Column, target: Column) -> Column:
    return load < target


def overloaded(load: Column, target: Column) -> Column:
    return load > target


def grapevine(under: Column, load: Column, avg: Column) -> Column:
    """Whether a rank may take an object: it stays within the mean."""
    return ~(under + load > avg)


def modified_grapevine(over: Column, under: Column, load: Column) -> Column:
    """Whether a rank may take an object: it does not end above the giver's former load."""
    return load <= over - under


def cmf(ranks: DataFrame, target: Column, by: list[str] | None = None, factor_by_max: bool = False) -> DataFrame:
    """Cumulative weights of underloaded ranks (rank, load), in order of rank: 1 - load / target, normalised to 1."""
    by = by or []
    top = F.greatest(F.max("load").over(Window.partitionBy(*by)), target) if factor_by_max else target
    weight = ranks.withColumn("weight", 1 - F.col("load") / top)
    run = Window.partitionBy(*by).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("weight").over(Window.partitionBy(*by))
    return weight.withColumn("cmf", F.when(total > 0, F.sum("weight").over(run) / total))


def sample_cmf(draws: DataFrame, table: DataFrame) -> DataFrame:
    """The first rank whose cmf reaches each draw (id, u). table is one row a rank."""
    hit = draws.join(F.broadcast(table.select("rank", "cmf")), F.col("cmf") >= F.col("u"))
    return hit.groupBy("id", "u").agg(F.min_by("rank", "cmf").alias("rank"))


def shed(objects: DataFrame, threshold: Column) -> DataFrame:
    """The objects that ranks over their threshold give away, smallest loads first, while the load left is above it."""
    of = Window.partitionBy("phase", "rank")
    before = F.coalesce(F.sum("load").over(of.orderBy("load", "object").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = objects.withColumn("__total", F.sum("load").over(of)).withColumn("__gone", before)
    return rows.where((F.col("__total") - F.col("__gone") > threshold) & F.col("migratable")).drop("__total", "__gone")


def greedy(objects: DataFrame, ranks: int) -> DataFrame:
    """Rows (phase, object, from_rank, to_rank, load). In phases whose imbalance is over 3 %, ranks give away objects
    while above factor * mean, the factor being 1 - imbalance within 0.3 and 1; then the largest object goes to the
    least loaded rank, again and again, ties to the smaller number."""
    ship(objects.sparkSession)
    per = objects.groupBy("phase", "rank").agg(F.sum("load").alias("l"))
    total = per.groupBy("phase").agg(F.sum("l").alias("__sum"), F.max("l").alias("__max"))
    avg = F.col("__sum") / ranks
    over = F.col("__max") / avg - 1
    gate = total.where((F.col("__sum") > 0) & (over > 0.03)).select("phase", (avg * F.least(F.greatest(1 - over, F.lit(0.3)), F.lit(1.0))).alias("__limit"))
    given = shed(objects.join(gate, "phase"), F.col("__limit")).select("phase", "object", "rank", "load")
    left = per.join(given.groupBy("phase", "rank").agg(F.sum("load").alias("g")), ["phase", "rank"], "left").select("phase", "rank", (F.col("l") - F.coalesce("g", F.lit(0))).alias("load"))
    rows = given.unionByName(left.join(gate.select("phase"), "phase", "left_semi").withColumn("object", F.lit(None).cast("long")))

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        have = dict.fromkeys(range(ranks), 0.0)
        for r in pdf[pdf.object.isna()].itertuples():
            have[int(r.rank)] = float(r.load)
        heap = [(load, r) for r, load in have.items()]
        heapq.heapify(heap)
        out = []
        for r in pdf[pdf.object.notna()].sort_values(["load", "object"], ascending=[False, True]).itertuples():
            load, to = heapq.heappop(heap)
            heapq.heappush(heap, (load + float(r.load), to))
            if to != int(r.rank):
                out.append((int(r.phase), int(r.object), int(r.rank), to, float(r.load)))
        return pd.DataFrame(out, columns=["phase", "object", "from_rank", "to_rank", "load"])

    return rows.groupBy("phase").applyInPandas(assign, "phase long, object long, from_rank long, to_rank long, load double")


def hierarchical(objects: DataFrame, ranks: int, lowest: float = 1.0) -> DataFrame:
    """Rows as greedy's. Objects that ranks give away go up a binary tree of ranks: a node hands its largest to the
    child with the least load for each of its ranks, while that is at or below lowest * mean; what is left goes to its
    parent, and the root hands out all, downwards by the same choice."""
    ship(objects.sparkSession)

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        load = dict.fromkeys(range(ranks), 0.0)
        for r in pdf.itertuples():
            load[int(r.rank)] += float(r.load)
        avg = sum(load.values()) / ranks
        if avg <= 0 or max(load.values()) / avg - 1 <= 0.03:
            return pd.DataFrame([], columns=["phase", "object", "from_rank", "to_rank", "load"])
        pool: dict[int, list] = {r: [] for r in range(ranks)}
        for r in pdf[pdf.migratable].sort_values(["rank", "load", "object"]).itertuples():
            if load[int(r.rank)] > avg:
                load[int(r.rank)] -= float(r.load)
                heapq.heappush(pool[int(r.rank)], (-float(r.load), int(r.object), int(r.rank)))
        kids = {r: [c for c in (2 * r + 1, 2 * r + 2) if c < ranks] for r in range(ranks)}
        size, under = {}, {}
        for r in reversed(range(ranks)):
            size[r] = 1 + sum(size[c] for c in kids[r])
            under[r] = load[r] + sum(under[c] for c in kids[r])
        parts: dict[int, list] = {r: [] for r in range(ranks)}

        def give(node: int, item: tuple) -> None:
            while kids[node]:
                under[node] += -item[0]
                options = [(load[node], node), *((under[c] / size[c], c) for c in kids[node])]
                best = min(options)[1]
                if best == node:
                    break
                node = best
            else:
                under[node] += -item[0]
            load[node] += -item[0]
            parts[node].append(item)

        for r in reversed(range(1, ranks)):
            while pool[r] and kids[r] and min(under[c] / size[c] for c in kids[r]) <= lowest * avg:
                give(r, heapq.heappop(pool[r]))
            for item in pool[r]:
                heapq.heappush(pool[(r - 1) // 2], item)
        while pool[0]:
            give(0, heapq.heappop(pool[0]))
        phase = int(pdf.phase.iloc[0])
        out = [(phase, o, f, to, -w) for to, items in parts.items() for w, o, f in items if f != to]
        return pd.DataFrame(out, columns=["phase", "object", "from_rank", "to_rank", "load"])

    return objects.groupBy("phase").applyInPandas(assign, "phase long, object long, from_rank long, to_rank long, load double")


def tempered(objects: DataFrame, ranks: int, iterations: int = 4, seed: int = 0, alpha: float = 1.0) -> DataFrame:
    """Rows as greedy's. Every rank knows all loads (the limit of gossip). In each iteration, overloaded ranks offer
    objects, in the order of fewest migrations, to underloaded ranks drawn by the cmf of what they can still take; an
    object moves if it does not bring the taker above the giver. The best placement met is the plan; none is better
    than the start means no move."""
    ship(objects.sparkSession)

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        import random

        rng = random.Random(seed + int(pdf.phase.iloc[0]))
        start = {int(r.object): int(r.rank) for r in pdf.itertuples()}
        weight = {int(r.object): alpha * float(r.load) for r in pdf.itertuples()}
        free = {int(r.object) for r in pdf[pdf.migratable].itertuples()}
        at = dict(start)
        target = sum(weight.values()) / ranks

        def loads(of: dict[int, int]) -> list[float]:
            out = [0.0] * ranks
            for o in sorted(of):
                out[of[o]] += weight[o]
            return out

        best, best_top = dict(start), max(loads(start))
        for _ in range(iterations if target > 0 and best_top > 1.03 * target else 0):
            have = loads(at)
            for r in [k for k in range(ranks) if have[k] > target]:
                mine = sorted((o for o in free if at[o] == r), key=lambda o: (weight[o], o))
                excess = have[r] - target
                cut = next((weight[o] for o in mine if weight[o] >= excess), have[r])
                order = [o for o in reversed(mine) if weight[o] <= cut] + [o for o in mine if weight[o] > cut]
                for o in order:
                    if have[r] <= target:
                        break
                    takers = [(k, 1 - have[k] / target) for k in range(ranks) if k != r and have[k] < target]
                    if not takers:
                        break
                    to = rng.choices([k for k, _ in takers], [w for _, w in takers])[0]
                    if weight[o] <= have[r] - have[to]:
                        at[o] = to
                        have[r] -= weight[o]
                        have[to] += weight[o]
            if (top := max(have)) < best_top:
                best, best_top = dict(at), top
        phase = int(pdf.phase.iloc[0])
        out = [(phase, o, start[o], r, weight[o] / alpha) for o, r in best.items() if start[o] != r]
        return pd.DataFrame(out, columns=["phase", "object", "from_rank", "to_rank", "load"])

    return objects.groupBy("phase").applyInPandas(assign, "phase long, object long, from_rank long, to_rank long, load double")


def swap_scores(clusters: DataFrame, work: DataFrame, limit: float) -> DataFrame:
    """For each cluster of a rank over the mean and each one (or none, a null block) of a rank under it: how much the
    larger work of both falls if they change places. Pairs that bring a rank's bytes over the limit are left out. There
    are few clusters a rank, and their summaries are one row each. clusters: rank, block, load, bytes; work: rank, load,
    bytes."""
    mean = work.agg(F.avg("load").alias("mean"))
    ranks = work.crossJoin(F.broadcast(mean))
    src = ranks.where("load > mean").select(F.col("rank").alias("src"), F.col("load").alias("w_src"), F.col("bytes").alias("m_src"))
    dst = ranks.where("load < mean").select(F.col("rank").alias("dst"), F.col("load").alias("w_dst"), F.col("bytes").alias("m_dst"))
    give = clusters.select(F.col("rank").alias("src"), F.col("block").alias("given"), F.col("load").alias("a"), F.col("bytes").alias("ma"))
    nothing = dst.select("dst", F.lit(None).cast("long").alias("taken"), F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("mb"))
    take = clusters.select(F.col("rank").alias("dst"), F.col("block").alias("taken"), F.col("load").alias("b"), F.col("bytes").alias("mb")).unionByName(nothing)
    pairs = src.join(give, "src").join(dst.join(take, "dst"), F.col("src") != F.col("dst"))
    fits = (F.col("m_src") - F.col("ma") + F.col("mb") <= limit) & (F.col("m_dst") + F.col("ma") - F.col("mb") <= limit)
    after = F.greatest(F.col("w_src") - F.col("a") + F.col("b"), F.col("w_dst") + F.col("a") - F.col("b"))
    return pairs.where(fits).select("src", "given", "dst", "taken", (F.greatest("w_src", "w_dst") - after).alias("gain"))


def replay(loads: DataFrame, placement: DataFrame, strategy: Callable[[DataFrame], DataFrame], phases: list[int], mod: int | None = None, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Rows (phase, object, rank, load): recorded loads (phase, object, load) under a strategy that is applied after
    each phase to the objects where they are then; one without a load in a phase stays. Phases beyond the recording repeat
    it modulo mod. Each phase adds one plan to the lineage, which keep cuts: it gets the placement after each phase and
    gives it back written. Without keep, phases should be few."""
    at, places = placement.select("object", "rank"), None
    for p in phases:
        of = p % mod if mod else p
        here = at.select(F.lit(p).cast("long").alias("phase"), F.lit(of).cast("long").alias("__of"), "object", "rank")
        places = here if places is None else places.unionByName(here)
        now = loads.where(F.col("phase") == of).join(at, "object").select(F.lit(p).cast("long").alias("phase"), "object", "rank", "load")
        plan = strategy(now.withColumn("migratable", F.lit(True)))
        moved = plan.select("object", F.col("to_rank").alias("__to"))
        at = at.join(moved, "object", "left").select("object", F.coalesce("__to", "rank").alias("rank"))
        at = keep(at) if keep else at
    recorded = loads.select(F.col("phase").alias("__of"), "object", "load")
    return recorded.join(places, ["__of", "object"]).select("phase", "object", "rank", "load")


def replay_each(loads: DataFrame, placement: DataFrame, moved: Callable[[Column, Column], Column]) -> DataFrame:
    """As replay, under a strategy that moves each object without regard to others: moved(rank, times) is where it is after
    so many moves from its first rank. One pass over all phases, whatever their number."""
    before = F.dense_rank().over(Window.partitionBy("object").orderBy(F.asc_nulls_last("phase"))) - 1
    rows = loads.select("phase", "object", "load", before.cast("long").alias("__moves")).join(placement.select("object", "rank"), "object")
    return rows.select("phase", "object", moved(F.col("rank"), F.col("__moves")).alias("rank"), "load")
