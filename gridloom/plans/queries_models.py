"""Load models, orders and rebalancing plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import comm, models, rebalance as rb, stats
from gridloom.plans.registry import query
from gridloom.plans.tables import CENTS, LOADS, PHASE, PLACED, PLACED_EDGES, PLACEMENT, RANK_LOADS, RANKS, cents, edges, loads, phase, placed, placement, table

_SPINE = f"{LOADS}, spine AS (SELECT p.phase, o.object, coalesce(l.load, 0) AS load FROM (SELECT DISTINCT phase FROM loads) p CROSS JOIN (SELECT DISTINCT object FROM loads) o LEFT JOIN loads l ON l.phase = p.phase AND l.object = o.object)"
_PAST = "PARTITION BY object ORDER BY phase ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING"


@query(f"WITH {_SPINE} SELECT phase, object, CAST(load AS BIGINT) AS load FROM spine")
def w01_raw_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.RawData().apply(loads(spark, sf_dir))


@query(f"WITH {_SPINE}, x AS (SELECT phase, object, lag(load) OVER (PARTITION BY object ORDER BY phase) AS load FROM spine) SELECT phase, object, CAST(load AS BIGINT) AS load FROM x WHERE load IS NOT NULL")
def w02_naive_persistence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.NaivePersistence().apply(loads(spark, sf_dir))


@query(f"WITH {_SPINE}, x AS (SELECT phase, object, median(load) OVER ({_PAST}) AS load FROM spine) SELECT phase, object, round(CAST(load AS DOUBLE), 1) AS load FROM x WHERE load IS NOT NULL")
def w03_median_last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.MedianLastN(n=3).apply(loads(spark, sf_dir)).select("phase", "object", F.round("load", 1).alias("load"))


@query(
    f"WITH {_SPINE}, x AS (SELECT phase, object, count(*) OVER ({_PAST}) AS n, regr_slope(load / 999983.0, phase) OVER ({_PAST}) AS b, avg(load / 999983.0) OVER ({_PAST}) AS my, avg(phase) OVER ({_PAST}) AS mx FROM spine) "
    "SELECT phase, object, round(my + b * (phase - mx), 4) AS load FROM x WHERE n >= 2"
)
def w04_linear_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = loads(spark, sf_dir).withColumn("load", F.col("load") / 999983.0)
    return models.Linear(n=3).apply(rows).select("phase", "object", F.round("load", 4).alias("load"))


@query(f"WITH {LOADS} SELECT phase // 3 AS phase, object, CAST(sum(load) AS BIGINT) AS load FROM loads GROUP BY 1, 2")
def w05_multiple_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.coarse(loads(spark, sf_dir), 3)


@query(
    f"WITH {_SPINE}, x AS (SELECT phase, object, lag(load) OVER (PARTITION BY object ORDER BY phase) AS load FROM spine) SELECT phase, object, CAST(3 * load AS DOUBLE) AS load FROM x WHERE load IS NOT NULL"
)
def w05_multiple_phases_of_persistence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.MultiplePhases(models.NaivePersistence(), b=3).apply(loads(spark, sf_dir))


@query(
    f"WITH {_SPINE}, x AS (SELECT phase, object, count(*) OVER ({_PAST}) AS n, regr_slope(load / 999983.0, phase) OVER ({_PAST}) AS b, avg(load / 999983.0) OVER ({_PAST}) AS my, avg(phase) OVER ({_PAST}) AS mx FROM spine) "
    "SELECT phase, object, round((my + b * (phase - mx)) + (my + b * (phase + 1 - mx)), 4) AS load FROM x WHERE n >= 2"
)
def w05_multiple_phases_of_a_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = loads(spark, sf_dir).withColumn("load", F.col("load") / 999983.0)
    return models.MultiplePhases(models.Linear(n=3), b=2).apply(rows).select("phase", "object", F.round("load", 4).alias("load"))


_SUBS = f"s AS (SELECT {PHASE} AS phase, l_suppkey AS object, l_linenumber AS k, sum({CENTS}) / 999983.0 AS x FROM lineitem GROUP BY 1, 2, 3)"


def _subs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loads with an array of seven subphases, by line number."""
    rows = table(spark, sf_dir, "lineitem").select(phase().alias("phase"), F.col("l_suppkey").alias("object"), "l_linenumber", cents().alias("c"))
    each = [(F.sum(F.when(F.col("l_linenumber") == k, F.col("c")).otherwise(0)) / 999983.0) for k in range(1, 8)]
    return rows.groupBy("phase", "object").agg(F.array(*each).alias("subs"))


@query(f"WITH {_SUBS} SELECT phase, object, round(sqrt(sum(x * x)), 4) AS load FROM s GROUP BY 1, 2")
def w06_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.Norm(models.Recorded(), 2.0).apply(_subs(spark, sf_dir)).select("phase", "object", F.round("load", 4).alias("load"))


@query(f"WITH {_SUBS} SELECT phase, object, round(max(x), 6) AS load FROM s GROUP BY 1, 2")
def w06_norm_infinite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.Norm(models.Recorded(), float("inf")).apply(_subs(spark, sf_dir)).select("phase", "object", F.round("load", 6).alias("load"))


@query(f"WITH {_SUBS} SELECT phase, object, round(coalesce(sum(CASE k WHEN 1 THEN x WHEN 3 THEN 2 * x END), 0), 4) AS load FROM s GROUP BY 1, 2")
def w07_select_subphases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.SelectSubphases(models.Recorded(), [0, 2, 2]).apply(_subs(spark, sf_dir)).select("phase", "object", F.round("load", 4).alias("load"))


@query(f"WITH {_SUBS} SELECT phase, object, round(sqrt(coalesce(sum(CASE k WHEN 1 THEN x * x WHEN 3 THEN 2 * x * x END), 0)), 4) AS load FROM s GROUP BY 1, 2 HAVING count(*) FILTER (WHERE k IN (1, 3)) > 0")
def w06_w07_norm_of_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = models.Norm(models.SelectSubphases(models.Recorded(), [0, 2, 2]), 2.0)
    some = (F.col("subs")[0] > 0) | (F.col("subs")[2] > 0)
    return model.apply(_subs(spark, sf_dir).where(some)).select("phase", "object", F.round("load", 4).alias("load"))


@query(
    f"WITH {LOADS}, c AS (SELECT *, object % 3 AS collection FROM loads), m AS (SELECT phase // 2 AS phase, object, sum(load) AS load FROM c WHERE collection = 1 GROUP BY 1, 2), "
    "p AS (SELECT DISTINCT phase FROM c WHERE collection <> 1), r AS (SELECT p.phase, o.object, coalesce(c.load, 0) AS load FROM p CROSS JOIN (SELECT DISTINCT object FROM c WHERE collection <> 1) o LEFT JOIN c ON c.phase = p.phase AND c.object = o.object) "
    "SELECT phase, object, CAST(load AS BIGINT) AS load FROM m UNION ALL SELECT phase, object, CAST(load AS BIGINT) FROM r"
)
def w08_per_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = loads(spark, sf_dir).withColumn("collection", F.col("object") % 3)
    return models.PerCollection({1: models.Coarse(2)}).apply(rows)


_TOTAL = "(SELECT object, sum(load) / 1e6 AS load FROM loads GROUP BY 1)"


def _totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loads(spark, sf_dir).groupBy("object").agg((F.sum("load") / 1e6).alias("load"))


def _far(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comm.placed(edges(spark, sf_dir), placement(spark, sf_dir)).withColumn("bytes", F.col("bytes") / 1e6)


@query(
    f"WITH {PLACED_EDGES}, {LOADS}, c AS (SELECT to_object AS object, sum(0.5 * messages + 0.25 * bytes / 1e6) AS cost FROM pedges WHERE from_rank <> to_rank GROUP BY 1) "
    f"SELECT l.object, round(l.load + coalesce(c.cost, 0), 3) AS load FROM {_TOTAL} l LEFT JOIN c ON c.object = l.object"
)
def w09_comm_overhead(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.comm_overhead(_totals(spark, sf_dir), _far(spark, sf_dir), 0.5, 0.25).select("object", F.round("load", 3).alias("load"))


@query(
    f"WITH {PLACED_EDGES}, {LOADS}, f AS (SELECT *, 0.5 * messages + 0.25 * bytes / 1e6 AS w FROM pedges WHERE category = 'SendRecv' AND from_rank <> to_rank), "
    "i AS (SELECT to_object AS object, sum(w) AS w FROM f GROUP BY 1), o AS (SELECT from_object AS object, sum(w) AS w FROM f GROUP BY 1) "
    f"SELECT l.object, round(greatest(coalesce(i.w, 0), coalesce(o.w, 0)), 3) AS comm, round(2 * l.load + 3 * greatest(coalesce(i.w, 0), coalesce(o.w, 0)) + 1, 2) AS work FROM {_TOTAL} l LEFT JOIN i ON i.object = l.object LEFT JOIN o ON o.object = l.object"
)
def w10_w11_weighted_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = models.weighted_messages(_totals(spark, sf_dir), _far(spark, sf_dir), 0.5, 0.25)
    work = models.weighted_volume(F.col("load"), F.col("comm"), 2.0, 3.0, 1.0)
    return got.select("object", F.round("comm", 3).alias("comm"), F.round(work, 2).alias("work"))


_OBJ = f"{PLACEMENT}, {LOADS}, obj AS (SELECT l.object, p.rank, CAST(sum(l.load) AS BIGINT) AS load, l.object % 7 <> 0 AS migratable FROM loads l JOIN placement p ON p.object = l.object GROUP BY 1, 2, 4)"


def _objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = loads(spark, sf_dir).groupBy("object").agg(F.sum("load").alias("load")).join(placement(spark, sf_dir), "object")
    return rows.select("object", "rank", "load", (F.col("object") % 7 != 0).alias("migratable"))


@query(f"WITH {_OBJ} SELECT object, CASE WHEN object % 5 = 0 AND migratable THEN (rank + 1) % {RANKS} ELSE rank END AS rank, load FROM obj")
def w12_proposed_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _objects(spark, sf_dir)
    plan = rb.rotate(rows.where("object % 5 = 0"), RANKS).join(rows.select("object", "load"), "object")
    return models.proposed(rows.select("object", "rank", "load"), plan)


@query(f"WITH {LOADS} SELECT phase, object, load FROM loads WHERE phase >= 23950 - 3")
def w14_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.retained(loads(spark, sf_dir), 23950, models.MedianLastN(n=3)).select("phase", "object", "load")


@query(f"SELECT {PHASE} AS phase, CAST(7 AS BIGINT) AS subphases FROM lineitem GROUP BY 1")
def w15_subphase_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.subphase_count(_subs(spark, sf_dir)).select("phase", F.col("subphases").cast("long").alias("subphases"))


# --- orders ----------------------------------------------------------------------------------------------------------

_AVG = f"t AS (SELECT sum(load) / {RANKS}.0 AS target FROM obj), r AS (SELECT rank, sum(load) AS total FROM obj GROUP BY 1)"


def _with_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _objects(spark, sf_dir)
    return rows.crossJoin(F.broadcast(rows.agg((F.sum("load") / float(RANKS)).alias("target"))))


@query(f"WITH {_OBJ} SELECT object, rank, row_number() OVER (PARTITION BY rank ORDER BY object) AS by_id, row_number() OVER (PARTITION BY rank ORDER BY load DESC, object) AS largest FROM obj")
def o01_o04_simple_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _objects(spark, sf_dir)
    a = rb.order_by_id(rows).select("object", "rank", F.col("place").cast("long").alias("by_id"))
    return a.join(rb.order_largest(rows).select("object", F.col("place").cast("long").alias("largest")), "object")


_PLACE = "row_number() OVER (PARTITION BY rank ORDER BY CASE WHEN load <= cut THEN 0 ELSE 1 END, CASE WHEN load <= cut THEN -load ELSE load END, object) AS place"


@query(
    f"WITH {_OBJ}, {_AVG}, c AS (SELECT obj.*, coalesce(min(CASE WHEN load >= total - target THEN load END) OVER (PARTITION BY obj.rank), total) AS cut FROM obj JOIN r ON r.rank = obj.rank CROSS JOIN t) SELECT object, rank, {_PLACE} FROM c"
)
def o02_fewest_migrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rb.order_fewest_migrations(_with_target(spark, sf_dir), F.col("target")).select("object", "rank", F.col("place").cast("long").alias("place"))


@query(
    f"WITH {_OBJ}, {_AVG}, s AS (SELECT obj.*, total, target, sum(load) OVER (PARTITION BY obj.rank ORDER BY load, object ROWS UNBOUNDED PRECEDING) AS run FROM obj JOIN r ON r.rank = obj.rank CROSS JOIN t), "
    f"c AS (SELECT object, rank, load, coalesce(min(CASE WHEN run >= total - target THEN load END) OVER (PARTITION BY rank), total) AS cut FROM s) SELECT object, rank, {_PLACE} FROM c"
)
def o03_small_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rb.order_small_objects(_with_target(spark, sf_dir), F.col("target")).select("object", "rank", F.col("place").cast("long").alias("place"))


@query("SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS turn FROM events")
def o07_priority_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    turn = F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("value"), "event_id"))
    return table(spark, sf_dir, "events").select("event_id", turn.cast("long").alias("turn"))


@query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 5")
def o08_last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.operators.collection import last_n

    return last_n(table(spark, sf_dir, "events").select("event_id", "user_id"), ["user_id"], [F.desc("event_id")], 5)


@query(f"WITH {RANK_LOADS} SELECT phase, CAST(arg_min(rank, load * 10 + rank) AS BIGINT) AS rank FROM rankloads GROUP BY 1")
def o09_least_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.rank_loads(placed(spark, sf_dir), RANKS).groupBy("phase").agg(F.min_by("rank", F.struct("load", "rank")).alias("rank"))


# --- plans -----------------------------------------------------------------------------------------------------------


@query(f"WITH {_OBJ} SELECT object, rank AS from_rank, (rank + 1) % {RANKS} AS to_rank FROM obj WHERE migratable")
def b01_rotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rb.rotate(_objects(spark, sf_dir), RANKS)


@query()
def b02_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rb.random_plan(_objects(spark, sf_dir), RANKS, seed=1, phase=3)


@query(f"WITH {_OBJ} SELECT object, rank AS from_rank, CAST((object * 3) % {RANKS} AS BIGINT) AS to_rank FROM obj WHERE rank <> (object * 3) % {RANKS}")
def b03_offline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _objects(spark, sf_dir)
    recorded = rows.select(F.lit(5).alias("phase"), "object", (F.col("object") * 3 % RANKS).alias("rank"))
    return rb.offline(rows, recorded, 4)


def _phase_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed(spark, sf_dir).withColumn("migratable", F.col("object") % 7 != 0)


@query()
def b04_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rb.greedy(_phase_objects(spark, sf_dir), RANKS)


@query()
def b05_hierarchical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rb.hierarchical(_phase_objects(spark, sf_dir), RANKS)


@query()
def b06_tempered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rb.tempered(_phase_objects(spark, sf_dir), RANKS)


_UNDER = f"{RANK_LOADS}, m AS (SELECT phase, avg(load) AS target FROM rankloads GROUP BY 1), u AS (SELECT rl.*, target FROM rankloads rl JOIN m ON m.phase = rl.phase WHERE load < target)"


def _under(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rows = stats.rank_loads(placed(spark, sf_dir), RANKS)
    target = F.avg("load").over(Window.partitionBy("phase"))
    return rows.withColumn("target", target).where(rb.underloaded(F.col("load"), F.col("target")))


@query(
    f"WITH {_UNDER}, w AS (SELECT phase, rank, 1 - load / target AS w FROM u) SELECT phase, rank, round(sum(w) OVER (PARTITION BY phase ORDER BY rank ROWS UNBOUNDED PRECEDING) / sum(w) OVER (PARTITION BY phase), 6) AS cmf FROM w"
)
def b06b_cmf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rb.cmf(_under(spark, sf_dir), F.col("target"), ["phase"]).select("phase", "rank", F.round("cmf", 6).alias("cmf"))


@query(
    f"WITH {_UNDER}, o AS (SELECT p.phase, p.object, p.rank, p.load, r.load AS have FROM placed p JOIN rankloads r ON r.phase = p.phase AND r.rank = p.rank JOIN m ON m.phase = p.phase WHERE r.load > m.target) "
    "SELECT o.phase, o.object, u.rank AS taker, NOT (u.load + o.load > u.target) AS within_mean, o.load <= o.have - u.load AS below_giver FROM o JOIN u ON u.phase = o.phase"
)
def p20_j12_transfer_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rows = placed(spark, sf_dir)
    ranks = stats.rank_loads(rows, RANKS).withColumn("target", F.avg("load").over(Window.partitionBy("phase")))
    over = ranks.where(rb.overloaded(F.col("load"), F.col("target"))).select("phase", "rank", F.col("load").alias("have"))
    under = ranks.where(rb.underloaded(F.col("load"), F.col("target"))).select("phase", F.col("rank").alias("taker"), F.col("load").alias("under"), "target")
    pairs = rows.join(over, ["phase", "rank"]).join(under, "phase")
    return pairs.select(
        "phase", "object", "taker", rb.grapevine(F.col("under"), F.col("load"), F.col("target")).alias("within_mean"), rb.modified_grapevine(F.col("have"), F.col("under"), F.col("load")).alias("below_giver")
    )


@query(f"WITH {LOADS} SELECT DISTINCT phase, phase % 5 = 2 AS runs FROM loads")
def b10_decide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loads(spark, sf_dir).select("phase").distinct().select("phase", rb.decide(F.col("phase"), 5, 2).alias("runs"))


@query(
    f"WITH {_OBJ}, p AS (SELECT rank AS f, (rank + 1) % {RANKS} AS t FROM obj WHERE migratable) SELECT r.rank, (SELECT count(*) FROM p WHERE t = r.rank) AS arrive, (SELECT count(*) FROM p WHERE f = r.rank) AS depart FROM (SELECT DISTINCT rank FROM obj) r"
)
def b11_normalised_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rb.normalised(rb.rotate(_objects(spark, sf_dir), RANKS))


@query(f"WITH {_OBJ} SELECT object, CASE WHEN migratable THEN (rank + 1) % {RANKS} ELSE rank END AS rank, load FROM obj")
def b11_applied_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _objects(spark, sf_dir)
    return rb.applied(rows, rb.rotate(rows, RANKS)).select("object", "rank", "load")


_CLUSTERS = f"{_OBJ}, cl AS (SELECT rank, object % 6 AS block, sum(load) AS load, count(*) * 9 AS bytes FROM obj GROUP BY 1, 2), wk AS (SELECT rank, sum(load) AS load, count(*) * 9 AS bytes FROM obj GROUP BY 1), mn AS (SELECT avg(load) AS mean FROM wk)"


@query(
    f"WITH {_CLUSTERS}, src AS (SELECT wk.* FROM wk, mn WHERE load > mean), dst AS (SELECT wk.* FROM wk, mn WHERE load < mean), "
    "tk AS (SELECT rank, block, load, bytes FROM cl UNION ALL SELECT rank, NULL, 0, 0 FROM dst) "
    "SELECT src.rank AS src, g.block AS given, dst.rank AS dst, coalesce(t.block, -1) AS taken, CAST(greatest(src.load, dst.load) - greatest(src.load - g.load + t.load, dst.load + g.load - t.load) AS BIGINT) AS gain "
    "FROM src JOIN cl g ON g.rank = src.rank JOIN dst ON dst.rank <> src.rank JOIN tk t ON t.rank = dst.rank WHERE src.bytes - g.bytes + t.bytes <= 300 AND dst.bytes + g.bytes - t.bytes <= 300"
)
def b06f_swap_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _objects(spark, sf_dir)
    size = (F.count("*") * 9).alias("bytes")
    clusters = rows.groupBy("rank", (F.col("object") % 6).alias("block")).agg(F.sum("load").alias("load"), size)
    work = rows.groupBy("rank").agg(F.sum("load").alias("load"), size)
    got = rb.swap_scores(clusters, work, 300)
    return got.withColumn("taken", F.coalesce("taken", F.lit(-1).cast("long")))


@query(f"WITH {_OBJ} SELECT object, rank AS from_rank, rank AS to_rank FROM obj")
def b09_self_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _objects(spark, sf_dir).select("object", F.col("rank").alias("from_rank"), F.col("rank").alias("to_rank"))


@query(
    f"WITH {PLACEMENT}, {LOADS}, r AS (SELECT phase - (SELECT min(phase) FROM loads) AS k, object, load FROM loads), n AS (SELECT range AS p FROM range(5)) "
    f"SELECT n.p AS phase, CAST((placement.rank + n.p) % {RANKS} AS BIGINT) AS rank, CAST(sum(r.load) AS BIGINT) AS load FROM n JOIN r ON r.k = n.p % 3 JOIN placement ON placement.object = r.object "
    f"WHERE r.object IN (SELECT object FROM r WHERE k < 3 GROUP BY object HAVING count(*) = 3) GROUP BY 1, 2"
)
def b12_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = loads(spark, sf_dir)
    first = rows.agg(F.min("phase").alias("first"))
    recorded = rows.crossJoin(F.broadcast(first)).select((F.col("phase") - F.col("first")).alias("phase"), "object", "load")
    always = recorded.where("phase < 3").groupBy("object").agg(F.count("*").alias("n")).where("n = 3").select("object")
    got = rb.replay(recorded.join(always, "object", "left_semi"), placement(spark, sf_dir), lambda d: rb.rotate(d, RANKS), list(range(5)), mod=3)
    return got.groupBy("phase", "rank").agg(F.sum("load").alias("load"))


@query(
    f"WITH {PLACEMENT}, {LOADS}, r AS (SELECT phase - (SELECT min(phase) FROM loads) AS phase, object, load FROM loads), "
    f"m AS (SELECT r.phase, (placement.rank + count(*) OVER (PARTITION BY r.object ORDER BY r.phase) - 1) % {RANKS} AS rank, r.load FROM r JOIN placement ON placement.object = r.object) "
    "SELECT phase, CAST(rank AS BIGINT) AS rank, CAST(sum(load) AS BIGINT) AS load FROM m GROUP BY 1, 2"
)
def b12_replay_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All recorded objects and phases; an object moves on after each phase in which it has a load."""
    first = table(spark, sf_dir, "lineitem").agg(F.min(phase()).alias("first"))
    recorded = loads(spark, sf_dir).crossJoin(F.broadcast(first)).select("object", "load", (F.col("phase") - F.col("first")).alias("phase"))
    got = rb.replay_each(recorded, placement(spark, sf_dir), lambda rank, times: rb.rotated(rank, RANKS, times))
    return got.groupBy("phase", "rank").agg(F.sum("load").alias("load"))
