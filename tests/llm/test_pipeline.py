import brute

import corpus_pipeline as cp
from gridloom.llm import decontaminate
from gridloom.llm.scratch import Scratch


def test_stages_on_their_inputs(spark, data, docs):
    scratch = Scratch(spark, "t")
    tables = [docs]
    for _, stage in cp.STAGES:
        tables.append(scratch.keep(stage(spark, tables[-1], data)))
    assert all(t.columns == docs.columns for t in tables[:-1])
    rows = [{r.doc_id: r.text for r in t.collect()} for t in tables[:-1]]
    start, known, lines, single, clean = rows
    assert set(known) <= set(start) and all(start[d] == t for d, t in known.items()) and len(known) >= 0.95 * len(start)
    left = brute.deduped_lines(list(known.items()))
    assert lines == {d: t for d, t in left.items() if t == known[d] or t.strip()}
    want = brute.components(list(lines.items()), 5)
    assert set(single) == {d for d in lines if want[d][1] == d}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    for d, t in single.items():
        if not brute.windows(t, items)[1]:
            assert clean[d] == t
    assert decontaminate.window_digests(tables[4], spark.read.parquet(f"{data}/benchmark.parquet")).where("contaminated").count() == 0
    assert {r.doc_id for r in tables[5].select("doc_id").collect()} == set(clean)
    assert all(r.n_chars == len(r.text) for r in tables[4].collect())


def test_stages_on_odd_and_empty_tables(spark, data, docs):
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (3, "12 34", "en", "s", 5), (4, "Hello there my friends", "en", "s", 22), (5, "Hello there my friends", None, None, None)], docs.schema)
    for table in (odd, docs.limit(0)):
        for _, stage in cp.STAGES:
            stage(spark, table, data).count()
