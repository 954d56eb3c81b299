import datetime
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridloom.llm import ann, language_id, pii, quality_lm, queries, toxicity
from gridloom.llm.scratch import Scratch


def test_language_held_out_accuracy(spark, docs, data):
    got = queries.op5_language_id(spark, data).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    held = [r for r in got if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_scores_equal_plain_version(spark, docs, monkeypatch):
    """Letter by letter and run by run, over whole texts."""
    from gridloom.llm.language_id import _letter

    def plain(text):
        points = [ord(c.lower()) if c.isalpha() and len(c.lower()) == 1 else ord(c) if c.isalpha() else None for c in text]
        chain = [None]
        for p in [*points, None]:
            if p is not None or chain[-1] is not None:
                chain.append(p)
        vector, made = np.zeros(language_id.DIM), {}
        for a, b, c in zip(chain, chain[1:], chain[2:]):
            if (a, b, c) not in made:
                parts = [_letter(language_id._BOUNDARY if x is None else x).astype(float) for x in (a, b, c)]
                made[a, b, c] = np.roll(parts[0], 2) * np.roll(parts[1], 1) * parts[2]
            vector += made[a, b, c]
        return vector

    some = [(r.doc_id, r.text[:1500], r.lang) for r in docs.where("text is not null and lang is not null").orderBy("doc_id").limit(40).collect()]
    table = spark.createDataFrame(some, "doc_id long, text string, lang string")
    vectors = {d: plain(t) for d, t, _ in some}
    sums = {}
    for d, _, lang in some:
        sums[lang] = sums.get(lang, 0) + vectors[d]
    profiles = language_id.prototypes(table.select("text", "lang"))
    assert {k: v.tolist() for k, v in profiles.items()} == {k: v.tolist() for k, v in sums.items()}
    got = {r.doc_id: r for r in language_id.identify(table, profiles).collect()}
    for d, v in vectors.items():
        cosines = {k: v @ p / np.linalg.norm(v) / np.linalg.norm(p) for k, p in sums.items()}
        best = max(cosines, key=cosines.get)
        assert got[d].lang_pred == best and abs(got[d].score - cosines[best]) < 1e-6
    comparer = language_id.Comparer(profiles)
    want = comparer.compare([t for _, t, _ in some])
    monkeypatch.setattr(language_id, "REMEMBERED", 200)
    for (lang, score), (lang2, score2) in zip(want, language_id.Comparer(profiles).compare([t for _, t, _ in some]), strict=True):
        assert lang == lang2 and abs(score - score2) < 1e-6


def test_language_odd_rows(odd, none):
    profiles = language_id.prototypes(odd.select("text", "lang"))
    got = {r.doc_id: r for r in language_id.identify(odd, profiles).collect()}
    assert [got[k].lang_pred for k in (0, 1, 2, 7, 99)] == ["und"] * 5 and got[3].lang_pred == "en" and got[3].key == 3
    assert language_id.identify(none, profiles).count() == 0
    assert language_id.prototypes(none.select("text", "lang")) == {}
    assert {r.lang_pred for r in language_id.identify(odd, {}).collect()} == {"und"}


def plain_kneser_ney(texts):
    """log-probability of a byte after ORDER - 1 others, by the textbook, over the texts."""
    n = quality_lm.ORDER
    counts = {n: Counter()}
    for t in texts:
        padded = b"\n" * (n - 1) + t.encode() + b"\n"
        counts[n].update(padded[k : k + n] for k in range(len(padded) - n + 1))
    for k in range(n - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    of = {k: Counter(c.values()) for k, c in counts.items()}
    cuts = {k: quality_lm.discounts(*(of[k][i] for i in (1, 2, 3, 4))) for k in counts}
    cut = lambda k, c: cuts[k][min(c, 3) - 1]
    after = {k: defaultdict(list) for k in counts}
    for k, table in counts.items():
        for g, c in table.items():
            after[k][g[:-1]].append(c)

    def probability(g):
        k = len(g)
        if k == 0:
            return 1 / 256
        found = after[k].get(g[:-1])
        if found is None:
            return probability(g[1:])
        c, total = counts[k].get(g, 0), sum(found)
        share = (c - cut(k, c)) / total if c else 0.0
        return share + sum(cut(k, x) for x in found) / total * probability(g[1:])

    return probability


@pytest.mark.parametrize("shared", [1 << 40, 0])
def test_kneser_ney_equals_plain_version(spark, docs, monkeypatch, shared):
    monkeypatch.setattr(quality_lm, "SHARED", shared)
    monkeypatch.setattr(quality_lm, "BLOCK", 2000)
    some = [r.text[:400] for r in docs.where("text is not null").orderBy("doc_id").limit(12).collect()]
    model = quality_lm.train(spark.createDataFrame([(t,) for t in some], "text string"), Scratch(spark, "t"))
    probability = plain_kneser_ney(some)
    asked = [*some[:4], "Abc é unseen ZZZ", "", None, "a", some[0][:50] * 3]
    rows = spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string")
    n = quality_lm.ORDER
    for r in quality_lm.perplexities(rows, model).collect():
        text = (asked[r.doc_id] or "").encode()
        if not text:
            assert (r.n_symbols, r.perplexity) == (0, None)
            continue
        padded = b"\n" * (n - 1) + text + b"\n"
        logs = [math.log(probability(padded[k : k + n])) for k in range(len(text) + 1)]
        assert r.n_symbols == len(logs) and abs(r.perplexity / math.exp(-sum(logs) / len(logs)) - 1) < 1e-4
    for context in (some[0].encode()[:4], b"zzzz"):
        assert abs(sum(probability(context + bytes([b])) for b in range(256)) - 1) < 1e-9


def test_quality_separates(spark, docs, data):
    labels = spark.read.parquet(f"{data}/labels.parquet")
    got = queries.op4_quality_classifier(spark, data).join(labels, "doc_id").collect()
    good, bad = [r.keep for r in got if r.quality == 1], [r.keep for r in got if r.quality == 0]
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.4


def test_quality_odd_rows(odd, none, spark):
    ids = odd.select("doc_id").where("doc_id in (4, 5)")
    got = quality_lm.quality(odd, ids).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got}
    assert by[0].perplexity is None and not by[0].keep and by[4].keep and not by[1].keep
    assert quality_lm.quality(none, ids).count() == 0
    assert {r.threshold for r in quality_lm.quality(odd, ids.limit(0)).collect()} == {None}


def test_pseudonyms(spark):
    card, date = "4111 1111 1111 1111", "2021-02-28"
    rows = [
        (1, f"card {card}, {card.replace(' ', '')}; 4111111111111112; John.Doe99@mail.example.com +1 (425) 555-9684. {date} 28.02.2021 2021-02-30 10.0.0.1 300.1.1.1"),
        (2, f"{card} and {date}"), (3, None), (4, ""), (4, "nothing"),
    ]
    got = [r.asDict() for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()]
    one, two = got[0]["text"], got[1]["text"]
    new_card = one[5:24]
    assert new_card != card and two.startswith(new_card) and new_card.replace(" ", "") in one and luhn(new_card.replace(" ", ""))
    assert "4111111111111112" in one and "2021-02-30" in one and "300.1.1.1" in one
    assert "John" not in one and "@mail.example.com" in one and "555-9684" not in one and "10.0.0.1" not in one
    new_date = two.split()[-1]
    assert new_date in one and datetime.date.fromisoformat(new_date).strftime("%d.%m.%Y") in one
    assert (got[2]["text"], got[3]["text"], got[4]["text"], got[4]["n_found"]) == (None, "", "nothing", 0)


def luhn(s):
    d = [int(c) for c in reversed(s)]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def test_feistel_is_a_permutation(spark):
    rows = spark.range(270 * 37).select(F.floor(F.col("id") / 37).alias("h"), (F.col("id") % 37).alias("l"))
    h, low = pii.feistel(F.col("h"), F.col("l"), F.lit(270), F.lit(37), "k", "t")
    got = rows.select(h.alias("a"), low.alias("b")).distinct().agg(F.count("*"), F.min("a"), F.max("a"), F.min("b"), F.max("b")).first()
    assert tuple(got) == (270 * 37, 0, 269, 0, 36)


def test_pseudonym_plan_is_native(docs, odd, none):
    plan = pii.pseudonymise(docs, "k")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert pii.pseudonymise(odd, "k").count() == odd.count() and pii.pseudonymise(odd, "k").columns[:-2] == odd.columns
    assert pii.pseudonymise(none, "k").count() == 0


def test_toxicity_finds_words_of_the_chain(spark):
    rng = random.Random(1)
    bad, rows, labels = ["vile", "nasty", "grim"], [], []
    for d in range(600):
        text = [f"w{rng.randrange(400)}" for _ in range(40)]
        toxic, low = d % 5 == 0, d % 3 == 0
        text += [rng.choice(bad) for _ in range(3)] if toxic else []
        text += ["junk!"] if low else []
        rows.append((d, " ".join(text)))
        if d < 400:
            labels.append((d, int(low), int(toxic)))
    rows += [(900, None), (901, "")]
    got = toxicity.toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, low int, toxic int"), ["low", "toxic"]).collect()
    new = [r for r in got if 400 <= r.doc_id < 600]
    assert all(r.toxic_pred == (r.doc_id % 5 == 0) for r in new) and all((r.p_low > 0.5) == (r.doc_id % 3 == 0) for r in new)
    assert [(r.p_low, r.p_toxic, r.toxic_pred) for r in got if r.doc_id >= 900] == [(0.0, 0.0, False)] * 2


def test_toxicity_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (4, None, 1), (5, 0, 1), (5, 0, 1), (None, 1, 1)], "doc_id long, low int, toxic int")
    assert toxicity.toxicity(odd, labels, ["low", "toxic"]).count() == odd.count()
    assert not any(r.toxic_pred for r in toxicity.toxicity(odd, labels.limit(0), ["low", "toxic"]).collect())
    assert toxicity.toxicity(none, labels, ["low", "toxic"]).count() == 0


def exact(ids, vectors, query, k):
    norms = np.sqrt((vectors * vectors).sum(axis=1))
    cos = (vectors * vectors[query]).sum(axis=1) / (norms * norms[query])
    order = [i for i in np.lexsort((ids, -cos)) if i != query][:k]
    return [(int(ids[i]), cos[i]) for i in order]


def test_nearest_recall(spark, data):
    table = spark.read.parquet(f"{data}/embeddings.parquet")
    pdf = table.toPandas()
    ids, vectors = pdf.vec_id.to_numpy(), np.stack(pdf.embedding.to_numpy()).astype(float)
    got = {}
    for r in queries.op9_nearest_neighbours(spark, data).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    asked = [i for i in range(len(ids)) if ids[i] % 50 == 0]
    assert set(got) == {int(ids[i]) for i in asked}
    hits = 0
    for i in asked:
        mine = [got[int(ids[i])][k] for k in range(1, 6)]
        hits += len({v for v, _ in mine} & {v for v, _ in exact(ids, vectors, i, 5)})
        assert [s for _, s in mine] == sorted((s for _, s in mine), reverse=True)
    assert hits >= 0.9 * 5 * len(asked)


def test_nearest_in_small_blocks(spark, data, monkeypatch):
    """Several blocks of rows and of queries, and fewer bits at first."""
    monkeypatch.setattr(ann, "INDEX_BLOCK", 60)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 2)
    table = spark.read.parquet(f"{data}/embeddings.parquet").limit(400)
    pdf = table.toPandas()
    ids, vectors = pdf.vec_id.to_numpy(), np.stack(pdf.embedding.to_numpy()).astype(float)
    got = ann.nearest(table, table.where("vec_id % 50 = 0"), k=5).collect()
    asked = [i for i in range(len(ids)) if ids[i] % 50 == 0]
    assert len(got) == 5 * len(asked)
    want = {(int(ids[i]), v) for i in asked for v, _ in exact(ids, vectors, i, 5)}
    assert len(want & {(r.query_id, r.vec_id) for r in got}) >= 0.9 * len(want)


def test_nearest_of_tiny_and_huge_vectors(spark):
    rows = [(0, [1e-200, 2e-200]), (1, [1e200, 2.1e200]), (2, [-1e-200, 1e-200]), (3, [5e-324, 0.0]), (4, [1.7e308, 1.7e308])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in ann.nearest(table, table.where("vec_id = 0"), k=5).collect()}
    assert [got[0, k][0] for k in (1, 2, 3, 4)] == [1, 4, 3, 2] and abs(got[0, 2][1] - 3 / math.sqrt(10)) < 1e-12


def test_nearest_copies_ties_and_bad_rows(spark):
    v = [[1.0, 0.0], [1.0, 0.0], [2.0, 0.0], [0.0, 1.0], [1.0, 1.0], None, [0.0, 0.0], [float("nan"), 1.0], [1.0, None], [], [1.0, 2.0, 3.0]]
    rows = [(k, x, 1) for k, x in enumerate(v)] + [(k + 100, [1.0, 0.0], 1) for k in range(10)] + [(None, [1.0, 0.0], 1), (0, [1.0, 0.0], 2)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = ann.nearest(table, table.where("vec_id in (0, 3, 5)"), k=3).collect()
    by = {(r.query_id, r["rank"]): (r.vec_id, round(r.score, 6)) for r in got}
    assert [by[0, k] for k in (1, 2, 3)] == [(1, 1.0), (2, 1.0), (100, 1.0)]
    assert by[3, 1] == (4, 0.707107) and by[3, 2] == (0, 0.0) and not any(q == 5 for q, _ in by)
    assert ann.nearest(table.limit(0), table.limit(0)).count() == 0


def test_pseudonyms_beside_other_numbers(spark):
    """A value keeps its pseudonym, and what stands beside it stays, whatever numbers are next to it."""
    card, grouped, phone = "4111111111111111", "4111 1111 1111 1111", "+1 (017) 555-7713"
    beside = [
        (f"{card} 123", card, "", " 123"), (f"{grouped} 12/27", grouped, "", " 12/27"), (f"order 12 {card}", card, "order 12 ", ""),
        (f"{grouped} 2021-99-99", grouped, "", " 2021-99-99"), (f"{phone} 12 apples", phone, "", " 12 apples"), (f"7 {grouped} 123", grouped, "7 ", " 123"),
        (f"{phone} 5 5", phone, "", " 5 5"), ("+33 1 23 45 67 89 12", "+33 1 23 45 67 89", "", " 12"),
    ]
    # every two- and three-digit neighbour, so also those with which the joined digits pass the check by chance
    beside += [(f"{card} {k}", card, "", f" {k}") for k in range(10, 200)]
    rows = [(i, t) for i, (t, *_) in enumerate(beside)] + [(1000 + i, v) for i, (_, v, *_) in enumerate(beside)]
    got = {r.doc_id: r for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    for i, (_, value, before, after) in enumerate(beside):
        alone = got[1000 + i].text
        assert alone != value and got[i].text == before + alone + after
    two = pii.pseudonymise(spark.createDataFrame([(1, f"{grouped} {card} 10.0.0.1"), (2, "1 2 3 " * 4000)], "doc_id long, text string"), "k").orderBy("doc_id").collect()
    assert (two[0].n_found, two[0].n_changed) == (3, 3) and "10.0.0.1" not in two[0].text


def test_toxicity_equals_plain_chain(spark, monkeypatch):
    """Folds, chain and probabilities, written out row by row."""
    monkeypatch.setattr(toxicity, "MIN_CHI2", 3.0)
    rng = random.Random(8)
    texts, labels = [], []
    for d in range(90):
        words, low, toxic = [f"w{rng.randrange(30)}" for _ in range(12)], d % 3 == 0, d % 4 == 0
        texts.append(" ".join(words + ["junk"] * low + ["vile"] * toxic))
        labels.append((int(low), int(toxic)))
    y = np.array(labels)
    sets = [next(toxicity.features(pa.array([t]))) for t in texts]

    def fitted(rows, earlier, column):
        flat = np.concatenate([sets[i] for i in rows])
        begin = np.concatenate([[0], np.cumsum([len(sets[i]) for i in rows])])
        return toxicity.fit_linear(flat, begin, earlier, y[rows, column].astype(float))

    def probability(model, features, earlier):
        z = sum(model.weights[f] for f in features) + sum(e * w for e, w in zip(earlier, model.chain, strict=True)) + model.bias
        return 1 / (1 + math.exp(-z))

    everyone = list(range(90))
    first = fitted(everyone, np.zeros((90, 0)), 0)
    unseen = np.zeros((90, 1))
    for f in range(toxicity.FOLDS):
        model = fitted([i for i in everyone if i % toxicity.FOLDS != f], np.zeros((90 - len(everyone[f :: toxicity.FOLDS]), 0)), 0)
        for i in everyone[f :: toxicity.FOLDS]:
            unseen[i, 0] = probability(model, sets[i], [])
    second = fitted(everyone, unseen, 1)
    models = toxicity.fit_chain(texts, y)
    for got, want in zip(models, (first, second), strict=True):
        assert np.allclose(got.weights, want.weights) and np.allclose(got.chain, want.chain) and abs(got.bias - want.bias) < 1e-9
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in toxicity.predict(rows, models, ["low", "toxic"]).collect():
        p = probability(first, sets[r.doc_id], [])
        q = probability(second, sets[r.doc_id], [p])
        assert abs(r.p_low - p) < 1e-9 and abs(r.p_toxic - q) < 1e-9 and r.toxic_pred == (q >= 0.5)
