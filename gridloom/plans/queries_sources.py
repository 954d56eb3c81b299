"""Files and their text formats, and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import stats
from gridloom.plans.registry import query
from gridloom.plans.tables import LOADS, PLACED, PLACEMENT, RANK_LOADS, RANKS, loads, placed, placement, table
from gridloom.sources import lbdata
from gridloom.streaming.phases import phase_statistics


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = placed(spark, sf_dir).select("phase", "rank", "object", (F.col("object") % 7 != 0).alias("migratable"), (F.col("load") / 100.0).alias("load"))
    return lbdata.documents(rows.withColumn("subs", F.array(F.col("load") / 4, F.col("load") * 3 / 4)))


@query(f"WITH {PLACED} SELECT phase, rank, object, object % 7 <> 0 AS migratable, round(load / 100.0, 2) AS load, round(load / 100.0 / 4, 4) AS first_subphase FROM placed")
def s01_s02_s05_load_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loads written as JSON documents by rank and range of phases, parsed again and flattened."""
    t = lbdata.tasks(lbdata.parse(_files(spark, sf_dir)))
    return t.select("phase", "rank", "object", "migratable", F.round("load", 2).alias("load"), F.round(F.col("subs")[0], 4).alias("first_subphase"))


@query(f"WITH {LOADS}, v AS (SELECT DISTINCT phase FROM loads WHERE phase % 5 <> 3) SELECT phase FROM v")
def s03_phase_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lbdata.decode_phases(lbdata.encode_phases(loads(spark, sf_dir).select("phase").distinct().where("phase % 5 <> 3")))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def s04_json_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "map<string,bigint>").alias("m"))
    return e.select("event_id", F.from_json(F.to_json("m"), "map<string,bigint>")["k"].alias("k"))


@query(f"WITH {RANK_LOADS} SELECT phase, CAST(max(load) AS BIGINT) AS top, count(*) AS ranks FROM rankloads WHERE phase % 2 = 0 GROUP BY 1")
def s06_statistics_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stats.rank_loads(placed(spark, sf_dir), RANKS)
    got = stats.moments(stats.stack(rows, ["phase"], {"Rank_load": "load"}), "value", ["phase", "statistic"])
    j = lbdata.statistics_json(got.select("phase", "statistic", "max", "car"), every=2)
    parsed = j.select("phase", F.from_json("json", "struct<`pre-LB`:map<string,struct<max:double,car:bigint>>>")["pre-LB"]["Rank_load"].alias("s"))
    return parsed.select("phase", F.round("s.max").cast("long").alias("top"), F.col("s.car").alias("ranks"))


@query(
    f"WITH {PLACEMENT}, p AS (SELECT range AS phase FROM range(12)), s AS (SELECT phase, (phase // 3) * 3 AS source FROM p) SELECT s.phase, object, (rank + s.source) % 4 AS rank FROM s CROSS JOIN placement"
)
def s10_restart_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    recorded = spark.range(0, 12, 3).select(F.col("id").alias("phase")).crossJoin(placement(spark, sf_dir)).withColumn("rank", (F.col("rank") + F.col("phase")) % 4)
    phases = spark.range(12).select(F.col("id").alias("phase"), (F.col("id") % 3 != 0).alias("identical"))
    return lbdata.filled(recorded, phases)


_CONFIG = ["0 NoLB", "3 GreedyLB min=0.5 max=1.5   auto=true", "% 8 TemperedLB rounds=6 alpha=2", "%6 RotateLB", "", "  # nothing here", "77 HierarchicalLB depth=4 # the last"]
_NAMES = ["NoLB", "GreedyLB", "TemperedLB", "RotateLB", "HierarchicalLB"]


def _config(spark: SparkSession) -> DataFrame:
    return lbdata.config(spark.createDataFrame([(x,) for x in _CONFIG], "value string"), names=_NAMES)


@query(
    "SELECT * FROM (VALUES (FALSE, CAST(0 AS BIGINT), 'NoLB', NULL, CAST(0 AS BIGINT)), (FALSE, 3, 'GreedyLB', '0.5', 3), (TRUE, 8, 'TemperedLB', NULL, 2), (TRUE, 6, 'RotateLB', NULL, 0), (FALSE, 77, 'HierarchicalLB', NULL, 1)) t(is_mod, phase, name, low, n_params)"
)
def s12_config_parser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _config(spark).select("is_mod", "phase", "name", F.try_element_at("params", F.lit("min")).alias("low"), F.size("params").cast("long").alias("n_params"))


@query(
    f"WITH {LOADS}, p AS (SELECT DISTINCT phase - 23900 AS phase FROM loads) SELECT phase, CASE WHEN phase = 0 THEN 'NoLB' WHEN phase = 3 THEN 'GreedyLB' WHEN phase = 77 THEN 'HierarchicalLB' WHEN phase % 8 = 0 THEN 'TemperedLB' WHEN phase % 6 = 0 THEN 'RotateLB' END AS name FROM p"
)
def s13_config_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = _config(spark).withColumn("precedence", F.when(F.col("is_mod"), -F.col("phase")).otherwise(0))
    return lbdata.configured(loads(spark, sf_dir).select((F.col("phase") - 23900).alias("phase")).distinct(), entries)


@query("SELECT range AS phase FROM range(100) WHERE range % 10 >= 10 - 1 OR range % 10 <= 2 OR range BETWEEN 33 AND 37")
def s14_j10_phase_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = lbdata.spec(spark.createDataFrame([("%10 -1 2",), ("35 -2 2",)], "value string"))
    return lbdata.enabled(spark.range(100).toDF("phase"), entries)


_CODES = "(VALUES ('click', 1), ('view', 2), ('purchase', 3), ('signup', 4), ('error', 5)) c(event_type, code)"


@query(f"SELECT e.event_id, coalesce(c.code, 0) || ' ' || CAST(round(e.value * 1e6) AS BIGINT) || ' ' || (e.user_id % 10) || ' ' || (e.user_id % 4) AS line FROM events e LEFT JOIN {_CODES} ON c.event_type = e.event_type")
def s15_s16_trace_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = F.create_map(*(F.lit(x) for kv in (("click", 1), ("view", 2), ("purchase", 3), ("signup", 4), ("error", 5)) for x in kv))
    e = table(spark, sf_dir, "events").select("event_id", F.coalesce(F.try_element_at(codes, "event_type"), F.lit(0)).alias("code"), F.col("value").alias("time"), (F.col("user_id") % 10).alias("entry"), (F.col("user_id") % 4).alias("rank"))
    line = F.format_string("%d %d %d %d", "code", F.round(F.col("time") * 1e6).cast("long"), "entry", "rank")
    return e.select("event_id", line.alias("line"))


@query(
    "SELECT event_type AS component, CAST(count(value) AS BIGINT) AS ranks, round(min(value), 6) AS min, round(max(value), 6) AS max FROM events GROUP BY 1"
)
def s17_diagnostics_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "events").select(F.col("event_type").alias("component"), "value")
    return stats.diagnostics(v, ["component"]).select("component", "ranks", F.round("min", 6).alias("min"), F.round("max", 6).alias("max"))


@query(f"WITH {PLACEMENT} SELECT object, rank AS owner, CASE WHEN object % 2 = 0 THEN object * 10 ELSE -1 END AS state FROM placement")
def s20_restore_in_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = placement(spark, sf_dir).withColumnRenamed("rank", "owner")
    live = rows.select("object", (F.col("owner") * 0 + F.when(F.col("object") % 2 == 0, 3).otherwise(F.col("owner"))).alias("owner"), F.lit(-1).cast("long").alias("state"))
    saved = rows.where("object % 2 = 0").withColumn("state", F.col("object") * 10)
    return lbdata.restore_in_place(live, saved, ["object"])


@query("SELECT 'none' AS problem WHERE FALSE")
def s21_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lbdata.problems(lbdata.parse(_files(spark, sf_dir))).select("problem")


@query(f"WITH {PLACED} SELECT phase, CASE WHEN object % 13 = 0 THEN 'no time' ELSE 'no node' END AS problem, count(*) AS n FROM placed WHERE object % 13 = 0 OR object % 17 = 0 GROUP BY 1, 2")
def s21_validation_of_flawed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that lack some times and nodes."""
    ident = lambda t: t["entity"]["id"]
    flawed = lambda t: t.withField("time", F.when(ident(t) % 13 != 0, t["time"])).withField("node", F.when(ident(t) % 17 != 0, t["node"]))
    files = lbdata.parse(_files(spark, sf_dir))
    files = files.withColumn("phases", F.transform("phases", lambda p: p.withField("tasks", F.transform(p["tasks"], flawed))))
    return lbdata.problems(files).groupBy("phase", "problem").agg(F.count("*").alias("n"))


@query(
    f"WITH {PLACED} SELECT 'first' AS side, phase, object FROM placed WHERE object % 11 = 0 UNION ALL SELECT 'second', phase, object FROM placed WHERE object % 11 = 0"
)
def s22_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lbdata.tasks(lbdata.parse(_files(spark, sf_dir)))
    other = t.withColumn("load", F.col("load") + F.when(F.col("object") % 11 == 0, 5.0).otherwise(0.0))
    return lbdata.differences(t, other).select("side", "phase", "object")


@query("SELECT '  ' || o_custkey || ' -> ' || o_orderkey || ';' AS value FROM orders")
def s23_graph_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lbdata.dot(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("before"), F.col("o_orderkey").alias("after")))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS phase_start, event_type, count(*) AS n, round(min(value), 6) AS min, round(max(value), 6) AS max FROM events GROUP BY 1, 2")
def t01_phase_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the stream of phases gives, on the whole table as one batch: a streaming plan needs a sink."""
    got = phase_statistics(table(spark, sf_dir, "events"))
    return got.select(F.col("phase_start").cast("timestamp_ntz").alias("phase_start"), "event_type", "n", F.round("min", 6).alias("min"), F.round("max", 6).alias("max"))
