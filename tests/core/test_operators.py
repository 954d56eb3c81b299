"""Golden values, files, streams, plans and errors."""

import random
import re

import pytest
from pyspark.sql import functions as F

from gridloom.functions import sketch
from gridloom.operators import collection as co, comm, index as ix, models, rebalance as rb, reduce as rd, stats
from gridloom.plans import catalog
from gridloom.plans.queries_collections import gossip_parameters
from gridloom.session import kept
from gridloom.sources import lbdata
from gridloom.streaming import phases

LOADS = {0: 2, 1: 6, 2: 9, 3: 4, 4: 3, 5: 5}


def ordered(spark, order, target):
    rows = spark.createDataFrame([(k, 0, float(v)) for k, v in LOADS.items()], "object long, rank long, load double")
    return [r.object for r in order(rows, F.lit(float(target))).orderBy("place").collect()]


@pytest.mark.parametrize(("target", "want"), [(24.5, [5, 3, 4, 0, 1, 2]), (20.0, [2, 1, 5, 3, 4, 0]), (27.5, [0, 4, 3, 5, 1, 2])])
def test_fewest_migrations(spark, target, want):
    """Cuts 5, 9 and 2 of a total of 29."""
    assert ordered(spark, rb.order_fewest_migrations, target) == want


@pytest.mark.parametrize(("target", "want"), [(24.5, [4, 0, 3, 5, 1, 2]), (1.0, [2, 1, 5, 3, 4, 0])])
def test_small_objects(spark, target, want):
    assert ordered(spark, rb.order_small_objects, target) == want


def test_linear_index_out_of_range_fails(spark):
    df = spark.createDataFrame([(3, 1)], "i long, j long")
    dims, ranges = [F.col("i"), F.col("j")], [F.lit(3), F.lit(3)]
    with pytest.raises(Exception, match="out of range"):
        df.select(ix.checked(ix.linear_last_fastest(dims, ranges), dims, ranges)).collect()


def test_linear_index_of_keys_beyond_the_range(spark, tmp_path):
    spark.createDataFrame([(3, 20_001), (30, 7)], "c_nationkey int, c_custkey long").write.parquet(str(tmp_path / "customer.parquet"))
    got = catalog.queries()["p07_p08_linearise"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(7, 600_007, 205), (20_001, 80_001, 500_028)]


def test_user_operator_takes_groups_in_batches(spark):
    """Each group whole, with its own type, and null for NaN; no exchange with Python for each group."""
    rows = [(1, 2), (1, None), (None, 3), (None, 4), (2, None), (3, 1 << 60), *((k, 1) for k in range(4, 30_000))]
    df = spark.createDataFrame(rows, "g long, v long")

    def seen(v: "pd.Series") -> float:
        return float("nan") if v.isnull().all() else float(v.sum() + 100 * len(v) + v.index[0])

    import pandas as pd

    seen.__annotations__ = {"v": pd.Series, "return": float}
    got = rd.reduce_user(df, "v", seen, ["g"], "double")
    found = {r.g: r.v for r in got.collect()}
    assert {k: found[k] for k in (1, None, 2, 3, 4)} == {1: 202.0, None: 207.0, 2: None, 3: float(100 + (1 << 60)), 4: 101.0} and len(found) == 30_000
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()


def test_symmetrised_edges_are_one_before_ranks_are_joined(spark, data):
    rows = [("SendRecv", 1, 2, 0, 1), ("SendRecv", 1, 2, 0, 1), ("SendRecv", 3, 4, 1, 1), ("Broadcast", 1, 2, 0, 1), ("SendRecv", 1, 2, 1, 0)]
    edges = spark.createDataFrame(rows, "category string, from_object long, to_object long, from_rank long, to_rank long")
    want = [("Broadcast", 1, 2, 0), ("SendRecv", 1, 2, 0), ("SendRecv", 1, 2, 1), ("SendRecv", 3, 4, 1)]
    take = lambda df: sorted(map(tuple, df.select("category", "from_object", "to_object", "rank").collect()))
    assert take(comm.symmetrised(edges)) == want and take(comm.symmetrised(edges.limit(4).distinct(), once=True)) == want
    plan = catalog.queries()["j06_symmetrise"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert len([x for x in plan.splitlines() if "HashAggregate(keys=[" in x and "to_object" in x]) == 2 and "Union" not in plan


def test_statistics_of_loads_need_no_edges(spark, data):
    objects = spark.createDataFrame([(0, 1, 0, 2.0), (0, 2, 0, 4.0), (1, 1, 1, 3.0)], "phase long, object long, rank long, load double")
    edges = spark.createDataFrame([(0, "SendRecv", 1, 2, 0, 1, 8.0)], "phase long, category string, from_object long, to_object long, from_rank long, to_rank long, bytes double")
    take = lambda df: sorted(map(str, df.where("statistic not like '%comm'").collect()))
    assert take(stats.statistics(objects, None, 2)) == take(stats.statistics(objects, edges, 2)) and stats.statistics(objects, None, 2).count() == 4
    plan = catalog.queries()["a28_all_quantities"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan and "kept-" in plan


def test_block_map_covers_all_ranks(spark):
    for n, p in ((256, 16), (10, 3), (2, 4), (7, 7)):
        got = [r[0] for r in spark.range(n).orderBy("id").select(ix.block_map(F.col("id"), n, p)).collect()]
        assert got == sorted(got) and max(got) == min(n, p) - 1
        assert max(map(got.count, set(got))) - min(map(got.count, set(got))) <= 1


def test_vectors_of_different_sizes_fail(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0])], "g long, v array<double>")
    with pytest.raises(Exception, match="one size"):
        rd.reduce_vector(df, "plus", "v", ["g"]).collect()
    with pytest.raises(ValueError):
        rd.reduce_vector(df, "or", "v", ["g"], fixed=True)


def test_user_operator_and_callback(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 3.0), (2, 5.0)], "g long, v double")

    def product(v: "pd.Series") -> float:
        return float(v.prod())

    import pandas as pd

    product.__annotations__ = {"v": pd.Series, "return": float}
    assert {r.g: r.v for r in rd.reduce_user(df, "v", product, ["g"], "double").collect()} == {1: 6.0, 2: 5.0}
    heard = []
    rd.reduce_with_callback(df, "max", "v", heard.append)
    assert heard == [5.0]


def test_sketch_is_close_to_exact_quantiles(spark):
    rng = random.Random(10)
    values = sorted(rng.gauss(100, 20) for _ in range(10_000))
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(4)
    row = sketch.query_sketches(sketch.sketches(df, "v", [], 64), [0.1, 0.25, 0.5, 0.75, 0.9]).first()
    for q, got in zip((0.1, 0.25, 0.5, 0.75, 0.9), row.quantiles):
        want = values[int(q * len(values))]
        assert abs(got - want) / want < 0.05
    assert sum(c["count"] for c in row.sketch) == 10_000


def test_sketch_small():
    cents = sketch.build([1.0, 2.0, 2.0, 4.0], 16)
    assert cents == [(1.0, 1, True), (2.0, 2, True), (4.0, 1, True)]
    assert sketch.build([0.0, 1.0, 2.0, 10.0], 3) == [(0.5, 2, False), (2.0, 1, True), (10.0, 1, True)]
    assert sketch.estimate_rank(cents, 0.0, 1.0, 4.0) == 0 and sketch.estimate_rank(cents, 9.0, 1.0, 4.0) == 4
    assert sketch.quantile([], 0.5, 0.0, 0.0) is None
    few = sketch.build([3, 92, 4, 1, 24, 8, 33, 29, 55, 87], 4)
    assert len(few) == 4 and sum(c[1] for c in few) == 10


def test_sketch_golden_values():
    """Ranks and quantiles that a large enough sketch must give exactly."""
    ranks = {0.0: 0, 1.0: 1, 1.5: 1, 2.9: 2, 4.0: 6, 4.5: 6, 7.0: 8}
    cents = sketch.build([1, 2, 3, 4, 4, 4, 5, 6], 16)
    assert {v: sketch.estimate_rank(cents, v, 1.0, 6.0) for v in ranks} == ranks
    quantiles = {0.0: 0.01, 0.25: 2.0, 0.5: 4.0, 0.75: 4.2, 1.0: 4.3}
    cents = sketch.build([0.01, 0.1, 1.0, 2.0, 3.0, 4.0, 4.0, 4.0, 4.1, 4.2, 4.3, 4.3], 16)
    assert {q: sketch.quantile(cents, q, 0.01, 4.3) for q in quantiles} == quantiles


def test_sketch_trapezoids():
    """Between rough centroids, rank and quantile are each other's inverse."""
    cents = [(1.0, 4, False), (2.0, 10, False), (5.0, 6, False)]
    for v in (1.1, 1.5, 1.9, 2.5, 4.0):
        rank = sketch.estimate_rank(cents, v, 0.0, 6.0)
        assert abs(sketch.quantile(cents, rank / 20, 0.0, 6.0) - v) < 1e-9


@pytest.mark.parametrize("plan", [rb.greedy, rb.hierarchical, rb.tempered])
def test_plans_place_each_object_once_and_do_not_worsen(spark, plan):
    rng = random.Random(3)
    rows = [(p, o, 0 if rng.random() < 0.5 else rng.randrange(4), rng.uniform(1, 5), o % 9 != 0) for p in range(3) for o in range(60)]
    objects = spark.createDataFrame(rows, "phase long, object long, rank long, load double, migratable boolean")
    moves = plan(objects, 4).collect()
    assert len({(m.phase, m.object) for m in moves}) == len(moves) and moves
    for p in range(3):
        at = {o: r for q, o, r, _, _ in rows if q == p}
        weight = {o: w for q, o, _, w, _ in rows if q == p}
        top = lambda: max(sum(weight[o] for o in at if at[o] == r) for r in range(4))  # noqa: B023, E731
        before = top()
        for m in moves:
            if m.phase == p:
                assert m.object % 9 != 0 and at[m.object] == m.from_rank
                at[m.object] = m.to_rank
        assert top() <= before


def test_cmf_sampling(spark):
    ranks = spark.createDataFrame([(0, 1.0), (1, 0.0), (2, 0.5)], "rank long, load double")
    table = rb.cmf(ranks, F.lit(2.0))
    draws = spark.createDataFrame([(1, 0.1), (2, 0.5), (3, 1.0)], "id long, u double")
    assert {r.id: r["rank"] for r in rb.sample_cmf(draws, table).collect()} == {1: 0, 2: 1, 3: 2}


def test_keep_last_and_insert(spark):
    live = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "k long, owner long")
    plan = spark.createDataFrame([(1, 1), (2, 1), (3, 0)], "k long, to_rank long")
    assert sorted(r.k for r in co.keep_last(live, plan, ["k"]).collect()) == [1]
    assert co.insert(live, live, ["k"]).count() == 3


def test_checkpoint_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(k, k % 3, f"s{k}") for k in range(20)], "k long, owner long, state string")
    lbdata.checkpoint(rows, str(tmp_path), ["k"])
    assert sorted(map(str, lbdata.restore(spark, str(tmp_path), ["k"]).select("k", "owner", "state").collect())) == sorted(map(str, rows.collect()))
    extra = rows.select((F.col("k") + 100).alias("k"), "owner")
    extra.write.mode("append").parquet(f"{tmp_path}/directory")
    with pytest.raises(Exception, match="missing"):
        lbdata.restore(spark, str(tmp_path), ["k"]).collect()


def test_load_data_files(spark, tmp_path):
    rows = spark.createDataFrame([(p, r, 10 * r + k, True, 1.5 * k, [0.5 * k, 1.0 * k]) for p in range(2) for r in range(2) for k in range(3)], "phase long, rank long, object long, migratable boolean, load double, subs array<double>")
    lbdata.write(rows, str(tmp_path / "x"))
    back = lbdata.tasks(lbdata.parse(spark.read.text(str(tmp_path / "x")).withColumnRenamed("value", "json")))
    assert sorted(map(str, back.collect())) == sorted(map(str, rows.select("phase", "rank", "object", "migratable", "load", "subs").collect()))
    (tmp_path / "y.json").write_text('{"phases": [{"id": 0, "tasks": [{"entity": {"type": "object", "home": 0, "migratable": true}, "node": 0, "time": 1.0}], "communications": [{"type": "SendRecv", "bytes": 2.0, "messages": 3, "from": {"id": 1}, "to": {"seq_id": 2}}]}]}')
    files = lbdata.read(spark, str(tmp_path / "y.json"))
    assert [r.problem for r in lbdata.problems(files).collect()] == ["neither id nor seq_id"]
    assert [tuple(r) for r in lbdata.communications(files).collect()] == [(0, "SendRecv", 1, 2, 2.0, 3)]


def test_load_data_of_many_objects(spark):
    """A large phase is cut into several documents, and reading them back copies no phase to each of its tasks."""
    rows = spark.range(1000).selectExpr("id % 2 AS phase", "0L AS rank", "id AS object", "true AS migratable", "id * 1.0D AS load", "array(id * 1.0D) AS subs")
    documents = lbdata.documents(rows)
    sizes = [r[0] for r in lbdata.parse(documents).selectExpr("aggregate(phases, 0, (a, p) -> a + size(p.tasks))").collect()]
    assert sum(sizes) == 1000 and max(sizes) <= 512 and documents.count() == 2
    back = lbdata.tasks(lbdata.parse(documents))
    assert sorted(map(str, back.collect())) == sorted(map(str, rows.select("phase", "rank", "object", "migratable", "load", "subs").collect()))
    for got in (back, lbdata.problems(lbdata.parse(documents)), lbdata.communications(lbdata.parse(documents))):
        kept = re.findall(r"Generate explode\(\S+\), \[(.*?)\]", got._jdf.queryExecution().executedPlan().toString())
        assert kept and not [k for k in kept if k.startswith("p#")]


def test_restart_gap_fails(spark):
    placement = spark.createDataFrame([(0, 1, 0)], "phase long, object long, rank long")
    spine = spark.createDataFrame([(0, False), (1, False)], "phase long, identical boolean")
    with pytest.raises(Exception, match="missing"):
        lbdata.filled(placement, spine).collect()


def test_models_look_back_and_errors():
    assert models.Linear(base=models.MedianLastN(n=7), n=3).look_back() == 7
    with pytest.raises(ValueError):
        models.Norm(power=-1.0)


def test_models_compose(spark):
    """Sums of predictions at b * offset + i, norms and selections of a base's subphases."""
    rows = [(p, 1, float(p * p), [float(p), 2.0, 3.0]) for p in range(6)]
    loads = spark.createDataFrame(rows, "phase long, object long, load double, subs array<double>")
    one = lambda df, phase: [r.loads for r in df.where(F.col("phase") == phase).collect()][0]
    line = models.Linear(n=2)
    assert one(models.MultiplePhases(line, b=2).forecast(loads, [0, 1]), 4) == [14 + 19, 24 + 29]
    assert one(models.MultiplePhases(models.NaivePersistence(), b=3).forecast(loads), 5) == [48.0]
    selected = models.SelectSubphases(models.NaivePersistence(), [2, 0, 2])
    assert one(selected.forecast(loads), 5) == [3.0 + 4.0 + 3.0]
    assert sorted((r["sub"], r.loads[0]) for r in selected.subphases(loads).where("phase = 5").collect()) == [(0, 3.0), (1, 4.0), (2, 3.0)]
    assert abs(one(models.Norm(selected, 2.0).forecast(loads), 5)[0] - (9 + 16 + 9) ** 0.5) < 1e-12
    assert one(models.Norm(models.MultiplePhases(models.NaivePersistence(), b=2), float("inf")).forecast(loads), 5) == [8.0]
    assert gossip_parameters(256) == (7, 3)


def test_stream_of_phases(spark, data, tmp_path):
    schema = spark.read.parquet(f"{data}/events.parquet").schema
    (tmp_path / "in").mkdir()
    spark.read.parquet(f"{data}/events.parquet").write.parquet(str(tmp_path / "in"), mode="overwrite")
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    batches = []
    hooks = [lambda df, n: batches.append(("end", n, df.count())), lambda df, n: batches.append(("start", n, 0))]
    phases.each_phase(stream, hooks, str(tmp_path / "cp")).awaitTermination(120)
    assert [b[0] for b in batches[:2]] == ["end", "start"] and sum(b[2] for b in batches) == 1000
    q = phases.phase_statistics(stream).writeStream.format("memory").queryName("phases_out").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("select sum(n) from phases_out").first()[0] == 1000
    q = phases.element_state(stream.select("user_id", "value")).writeStream.format("memory").queryName("elements_out").outputMode("update").option("checkpointLocation", str(tmp_path / "cp3")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("select sum(n) from elements_out").first()[0] == 1000


def test_scatter_without_ranks_keeps_every_slot(spark):
    values = spark.range(200).selectExpr("id AS slot", "id * 2 AS value")
    assert co.scatter(values).count() == 200 and co.scatter(values, 64).count() == 64


def test_replay_of_sparse_objects(spark):
    """Against a plain replay: objects without a load in a phase stay, and those of few phases are not left out."""
    loads = {0: {1: 5, 2: 7}, 1: {2: 1, 3: 4}, 2: {1: 2}, 4: {3: 9, 1: 1}}
    at, want = {1: 0, 2: 1, 3: 2}, []
    for p in range(5):
        want += [(p, o, at[o], x) for o, x in loads.get(p, {}).items()]
        at |= {o: (at[o] + 1) % 4 for o in loads.get(p, {})}
    rows = spark.createDataFrame([(p, o, x) for p, objects in loads.items() for o, x in objects.items()], "phase long, object long, load long")
    placed = spark.createDataFrame([(1, 0), (2, 1), (3, 2)], "object long, rank long")
    got = rb.replay(rows, placed, lambda d: rb.rotate(d, 4), list(range(5)), keep=kept)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_replay_each_of_sparse_objects(spark):
    """As replay gives it, in one pass."""
    rows = spark.createDataFrame([(0, 1, 5), (0, 2, 7), (1, 2, 1), (1, 3, 4), (2, 1, 2), (4, 3, 9), (4, 1, 1)], "phase long, object long, load long")
    placed = spark.createDataFrame([(1, 0), (2, 1), (3, 2)], "object long, rank long")
    want = rb.replay(rows, placed, lambda d: rb.rotate(d, 4), list(range(5)), keep=kept)
    got = rb.replay_each(rows, placed, lambda rank, times: rb.rotated(rank, 4, times))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("lines", [["5 GreedyLB", "what is this"], ["5 GreedyLB min"], ["5 GreedyLB", "5 RotateLB"], ["5 OtherLB"]])
def test_config_refuses(spark, lines):
    rows = spark.createDataFrame([(x,) for x in lines], "value string")
    with pytest.raises(Exception, match="not a configuration line|two lines|unknown name"):
        lbdata.config(rows, names=["GreedyLB", "RotateLB"]).collect()


def test_spec_refuses(spark):
    assert lbdata.spec(spark.createDataFrame([("%5 # each fifth",), ("",)], "value string")).count() == 1
    with pytest.raises(Exception, match="not a specification line"):
        lbdata.spec(spark.createDataFrame([("5 5 -1",)], "value string")).collect()
