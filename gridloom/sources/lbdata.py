"""Files of load data, statistics, configuration, specifications, traces and checkpoints."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.operators.collection import runs

_ENTITY = "struct<type:string,id:bigint,seq_id:bigint,home:bigint,migratable:boolean,collection_id:bigint,index:array<bigint>,objgroup_id:bigint>"
_TASK = f"struct<entity:{_ENTITY},node:bigint,resource:string,time:double,subphases:array<struct<id:int,time:double>>,user_defined:map<string,string>,attributes:map<string,string>>"
_EDGE = f"struct<type:string,bytes:double,messages:bigint,from:{_ENTITY},to:{_ENTITY}>"
_RANGES = "struct<list:array<bigint>,range:array<array<bigint>>>"
#: Fixed format: the schema of a load data file. Optional fields are null where they are missing.
SCHEMA = (
    "type string, metadata struct<type:string,rank:bigint,phases:struct<count:bigint,skipped:" + _RANGES + ",identical_to_previous:" + _RANGES + ">,attributes:map<string,string>>, "
    f"phases array<struct<id:bigint,tasks:array<{_TASK}>,communications:array<{_EDGE}>,user_defined:map<string,string>>>"
)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Load data files, one JSON document each; Spark decompresses gzip and zstd by their names."""
    return spark.read.schema(SCHEMA).json(path, multiLine=True)


def parse(texts: DataFrame, column: str = "json") -> DataFrame:
    """Documents that are already in a string column."""
    return texts.select(F.from_json(column, SCHEMA).alias("d")).select("d.*")


def _each(files: DataFrame, entries: str) -> DataFrame:
    """Rows (phase, t): the entries of each phase. Only the phase's id goes with them: the phase itself holds all of them."""
    phases = files.select(F.explode("phases").alias("p")).select(F.col("p.id").alias("phase"), F.col(f"p.{entries}").alias("all"))
    return phases.select("phase", F.explode("all").alias("t"))


def tasks(files: DataFrame) -> DataFrame:
    """Rows (phase, rank, object, migratable, load, subs): only entities of type object; subphases in order of id."""
    t = _each(files, "tasks").where("t.entity.type = 'object'")
    subs = F.transform(F.array_sort("t.subphases"), lambda s: s["time"])
    return t.select("phase", F.col("t.node").alias("rank"), F.coalesce("t.entity.id", "t.entity.seq_id").alias("object"), F.col("t.entity.migratable").alias("migratable"), F.col("t.time").alias("load"), subs.alias("subs"))


def communications(files: DataFrame) -> DataFrame:
    """Rows (phase, category, from_object, to_object, bytes, messages)."""
    end = lambda s: F.coalesce(f"t.{s}.id", f"t.{s}.seq_id").alias(f"{s}_object")
    return _each(files, "communications").select("phase", F.col("t.type").alias("category"), end("from"), end("to"), "t.bytes", "t.messages")


def entity(kind: Column, ident: Column, home: Column, migratable: Column, collection: Column | None = None, index: Column | None = None, objgroup: Column | None = None) -> Column:
    """An entity: id, home, migratable, then the collection and index, or the object group, where there is one."""
    nothing = F.lit(None)
    return F.struct(
        kind.alias("type"), ident.alias("id"), home.alias("home"), migratable.alias("migratable"),
        (nothing.cast("bigint") if collection is None else collection).alias("collection_id"),
        (nothing.cast("array<bigint>") if index is None else index).alias("index"),
        (nothing.cast("bigint") if objgroup is None else objgroup).alias("objgroup_id"),
    )


#: Phases in one document, and tasks at most.
SPAN, TASKS = 16, 4096


def documents(rows: DataFrame, span: int = SPAN, tasks: int = TASKS) -> DataFrame:
    """Rows (rank, part, slice, json): load data documents for each rank and `span` phases, from rows (phase, rank, object,
    migratable, load, subs). Each takes `tasks / span` of a phase's objects, in order, so that no row grows with the number
    of phases or objects; readers add up the tasks of a phase over documents."""
    subs = F.transform("subs", lambda x, i: F.struct(i.cast("int").alias("id"), x.alias("time")))
    task = F.struct(
        entity(F.lit("object"), F.col("object"), F.col("rank"), F.col("migratable")).alias("entity"), F.col("rank").alias("node"), F.lit("cpu").alias("resource"),
        F.col("load").alias("time"), subs.alias("subphases"),
    )
    place = F.row_number().over(Window.partitionBy("rank", "phase").orderBy("object")) - 1
    cut = rows.withColumn("slice", F.floor(place / max(1, tasks // span))).withColumn("task", task)
    phase = cut.groupBy("rank", "phase", "slice").agg(F.array_sort(F.collect_list(F.struct("object", "task"))).alias("ts"))
    phase = phase.select("rank", "slice", F.struct(F.col("phase").alias("id"), F.transform("ts", lambda t: t["task"]).alias("tasks")).alias("p"))
    whole = phase.groupBy("rank", F.floor(F.col("p.id") / span).alias("part"), "slice").agg(F.collect_list("p").alias("ps"))
    ordered = F.array_sort("ps", lambda a, b: F.when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0))
    meta = F.struct(F.col("rank").alias("rank"), F.lit("LBDatafile").alias("type"))
    return whole.select("rank", "part", "slice", F.to_json(F.struct(F.lit("LBDatafile").alias("type"), meta.alias("metadata"), ordered.alias("phases"))).alias("json"))


def write(rows: DataFrame, path: str, compression: str = "gzip") -> None:
    """One file for each document."""
    documents(rows).select("json").write.mode("overwrite").option("compression", compression).option("maxRecordsPerFile", 1).text(path)


def problems(files: DataFrame) -> DataFrame:
    """Tasks that break the format's rules: rows (phase, problem)."""
    t = _each(files, "tasks")
    e = "t.entity."
    problem = (
        F.when(F.col(e + "id").isNull() & F.col(e + "seq_id").isNull(), "neither id nor seq_id")
        .when(F.col(e + "migratable") & F.col(e + "id").isNull() & F.col(e + "collection_id").isNull(), "migratable without collection_id")
        .when(F.col("t.time").isNull(), "no time").when(F.col("t.node").isNull(), "no node")
    )
    return t.select("phase", problem.alias("problem")).where("problem is not null")


def differences(a: DataFrame, b: DataFrame, epsilon: float = 0.1) -> DataFrame:
    """Tasks of one that the other lacks, or has with a load that differs by more than epsilon: rows (side, phase, rank,
    object, load)."""
    keys = ["phase", "rank", "object"]
    both = a.select(*keys, F.col("load").alias("one")).join(b.select(*keys, F.col("load").alias("two")), keys, "full")
    apart = both.where(F.col("one").isNull() | F.col("two").isNull() | (F.abs(F.col("one") - F.col("two")) > epsilon))
    sides = F.array(*(F.struct(F.lit(side).alias("side"), F.col(c).alias("load")) for side, c in (("first", "one"), ("second", "two"))))
    return apart.select(*keys, F.explode(sides).alias("s")).where("s.load is not null").select("s.side", *keys, "s.load")


def filled(placement: DataFrame, phases: DataFrame) -> DataFrame:
    """Placement (phase, object, rank) of every phase: one recorded as identical has that of the last recorded phase
    before it. phases: phase, identical."""
    known = placement.select("phase").distinct().withColumn("have", F.col("phase"))
    spine = phases.join(known, "phase", "left")
    # which recorded phase stands for each: phases are few, one row each
    stands = F.last("have", ignorenulls=True).over(Window.partitionBy(F.lit(0)).orderBy("phase"))
    missing = F.col("have").isNull() & ~F.col("identical")
    spine = spine.withColumn("source", F.when(missing, F.raise_error(F.lit("a phase is missing")).cast("long")).otherwise(stands))
    return spine.select(F.col("phase").alias("at"), F.col("source").alias("phase")).join(placement, "phase").select(F.col("at").alias("phase"), "object", "rank")


def _refused(wrong: Column, why: str, text: Column) -> Column:
    """The text; where it is wrong, the query fails."""
    return F.when(wrong, F.raise_error(F.concat(F.lit(f"{why}: "), text)).cast("string")).otherwise(text)


def config(lines: DataFrame, column: str = "value", names: Iterable[str] | None = None) -> DataFrame:
    """Configuration lines `[%] phase Name k=v ...` to rows (is_mod, phase, name, params); comments and blanks go. Any
    other line fails the query, as do a second line for a phase and, where names are given, a name that is none of them."""
    text = F.trim(F.regexp_replace(column, "#.*$", ""))
    head = r"^(%?)\s*(\d+)\s+([A-Za-z]\S*)((?:\s+[^\s=]+=\S*)*)$"
    rows = lines.select(text.alias("t")).where("t != ''").select(_refused(~F.col("t").rlike(head), "not a configuration line", F.col("t")).alias("t"))
    rest = F.regexp_replace(F.trim(F.regexp_extract("t", head, 4)), r"\s+", " ")
    name = F.regexp_extract("t", head, 3)
    if names is not None:
        name = _refused(~name.isin(list(names)), "unknown name", name)
    rows = rows.select(
        (F.regexp_extract("t", head, 1) == "%").alias("is_mod"), F.regexp_extract("t", head, 2).cast("long").alias("phase"), name.alias("name"),
        F.when(rest == "", F.create_map().cast("map<string,string>")).otherwise(F.str_to_map(rest, F.lit(" "), F.lit("="))).alias("params"),
    )
    alone = F.count("*").over(Window.partitionBy("is_mod", "phase")) > 1
    return rows.withColumn("name", _refused(alone, "two lines for one phase", F.col("name")))


def configured(phases: DataFrame, entries: DataFrame) -> DataFrame:
    """The entry that holds in each phase (rows phase): an exact one, or else the first that divides it, by order of its
    column precedence. Entries are lines of a file, so they are broadcast."""
    e = F.broadcast(entries.select("is_mod", F.col("phase").alias("k"), "name", "precedence"))
    hit = phases.join(e, (~F.col("is_mod") & (F.col("phase") == F.col("k"))) | (F.col("is_mod") & (F.col("phase") % F.col("k") == 0)), "left")
    best = Window.partitionBy("phase").orderBy("is_mod", "precedence")
    return hit.withColumn("__r", F.row_number().over(best)).where("__r = 1").select("phase", "name")


def spec(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines `[%]phase [neg] [pos]` to rows (is_mod, phase, neg, pos); comments and blanks go, other lines fail the query."""
    form = r"^(%?)\s*(\d+)(?:\s+(-?\d+))?(?:\s+(\d+))?$"
    text = F.trim(F.regexp_replace(column, "#.*$", ""))
    rows = lines.select(text.alias(column)).where(F.col(column) != "").select(_refused(~F.col(column).rlike(form), "not a specification line", F.col(column)).alias(column))
    part = lambda i: F.regexp_extract(column, form, i)
    number = lambda i: F.coalesce(part(i).try_cast("long"), F.lit(0))
    return rows.select((part(1) == "%").alias("is_mod"), part(2).cast("long").alias("phase"), number(3).alias("neg"), number(4).alias("pos"))


def enabled(phases: DataFrame, entries: DataFrame) -> DataFrame:
    """The phases that any entry matches."""
    e = F.broadcast(entries.select("is_mod", F.col("phase").alias("k"), "neg", "pos"))
    rest = F.col("phase") % F.col("k")
    hit = F.when(F.col("is_mod"), (rest >= F.col("k") + F.col("neg")) | (rest <= F.col("pos"))).otherwise(F.col("phase").between(F.col("k") + F.col("neg"), F.col("k") + F.col("pos")))
    return phases.join(e, hit, "left_semi")


def encode_phases(phases: DataFrame) -> DataFrame:
    """A set of phases as one row: list of single ones and ranges of several."""


    r = runs(phases, "phase").agg(F.array_sort(F.collect_list(F.when(F.col("lo") == F.col("hi"), F.col("lo")))).alias("list"), F.array_sort(F.collect_list(F.when(F.col("lo") < F.col("hi"), F.array("lo", "hi")))).alias("range"))
    return r


def decode_phases(encoded: DataFrame) -> DataFrame:
    single = encoded.select(F.explode("list").alias("phase"))
    return single.unionByName(encoded.select(F.explode("range").alias("r")).select(F.explode(F.sequence(F.col("r")[0], F.col("r")[1])).alias("phase")))


def statistics_json(stats: DataFrame, every: int = 1) -> DataFrame:
    """Statistics (phase, statistic and columns) as one JSON document a phase, for every so many phases."""
    cols = [c for c in stats.columns if c not in ("phase", "statistic")]
    rows = stats.where(F.col("phase") % every == 0).groupBy("phase").agg(F.array_sort(F.collect_list(F.struct("statistic", F.struct(*cols).alias("s")))).alias("a"))
    return rows.select("phase", F.to_json(F.struct(F.col("phase").alias("id"), F.map_from_entries("a").alias("pre-LB"))).alias("json"))


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def trace_lines(events: DataFrame) -> DataFrame:
    """One line an event (code, time in seconds, rank, entry): `code microseconds entry rank`."""
    return events.select(F.format_string("%d %d %d %d", "code", F.round(F.col("time") * 1e6).cast("long"), "entry", "rank").alias("value"))


def write_trace(events: DataFrame, path: str) -> None:
    trace_lines(events).write.mode("overwrite").option("compression", "gzip").text(path)


def checkpoint(collection: DataFrame, path: str, keys: list[str]) -> None:
    """The elements by owner, and a directory of the keys and owners that must be there."""
    collection.write.mode("overwrite").partitionBy("owner").parquet(f"{path}/elements")
    collection.select(*keys, "owner").write.mode("overwrite").parquet(f"{path}/directory")


def restore(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The elements of a checkpoint; one that is in the directory only fails the query."""
    directory = spark.read.parquet(f"{path}/directory").select(*keys, F.lit(True).alias("__listed"))
    elements = spark.read.parquet(f"{path}/elements").withColumn("__there", F.lit(True))
    both = directory.join(elements, keys, "left")
    there = F.when(F.col("__there"), F.lit(True)).otherwise(F.raise_error(F.lit("an element of the checkpoint is missing")).cast("boolean"))
    return both.where(there).drop("__listed", "__there").withColumn("owner", F.col("owner").cast("long"))


def restore_in_place(collection: DataFrame, saved: DataFrame, keys: list[str]) -> DataFrame:
    """Live elements with the payload and owner that were saved; elements that were not saved stay as they are."""
    payload = [c for c in collection.columns if c not in keys]
    s = saved.select(*keys, *(F.col(c).alias(f"__{c}") for c in payload), F.lit(True).alias("__saved"))
    return collection.join(s, keys, "left").select(*keys, *(F.when(F.col("__saved"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in payload))


def dot(edges: DataFrame) -> DataFrame:
    """Lines of a dependency graph (before, after) in the dot language, for write.text."""
    return edges.select(F.format_string("  %d -> %d;", "before", "after").alias("value"))


TRACE_SCHEMA = T.StructType([T.StructField("code", T.LongType()), T.StructField("time", T.DoubleType()), T.StructField("entry", T.LongType()), T.StructField("rank", T.LongType())])
