"""The set joins with small blocks, quotas and lists, against the plain versions."""

import random

import brute
import numpy as np
import pytest

from gridloom.llm import line_dedup, lists, near_dedup


@pytest.fixture(params=[(1, 8, 3), (2, 1 << 17, 0), (1 << 30, 5, 1 << 40)])
def small_lists(request, monkeypatch):
    quota, chunk, hot = request.param
    monkeypatch.setattr(lists, "QUOTA", quota)
    monkeypatch.setattr(lists, "CHUNK", chunk)
    monkeypatch.setattr(lists, "HOT", hot)
    monkeypatch.setattr(near_dedup, "BLOCK", 64)


def grown(seed, n_rows, words, changes):
    """Texts of which many come from each other by a few changes of words, near the threshold of similarity."""
    rng = random.Random(seed)
    rows = []
    for d in range(n_rows):
        if d % 7 == 0 or not rows:
            text = [rng.choice(words) for _ in range(rng.randrange(3, 30))]
        else:
            text = list(rng.choice(rows)[1])
            for _ in range(rng.randrange(changes)):
                text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((d, text))
    rng.shuffle(rows)
    return rows


def test_lines(spark, small_lists):
    rows = [(d, " ".join(t[:9]) + "\n" + " ".join(t[9:])) for d, t in grown(3, 160, [f"w{k}" for k in range(60)], 5)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {r.doc_id: r.text for r in got} == brute.deduped_lines(rows)


def test_lines_are_dealt_in_blocks(spark, monkeypatch):
    """Entries leave a task as few blocks, not as a row each, and come out as lists whole."""
    monkeypatch.setattr(lists, "DEAL", 50)
    made, rows = [], grown(13, 160, [f"w{k}" for k in range(60)], 5)
    rng = np.random.default_rng(1)
    cols = [rng.integers(0, 40, 500)] + [np.arange(500) + k for k in range(6)]
    for b in lists.dealt(iter([tuple(c[:30] for c in cols), tuple(c[30:] for c in cols)]), 8):
        made += [np.frombuffer(x, dtype=np.int64).reshape(7, -1) for x in b.column("entries").to_pylist()]
    assert len(made) <= 8 and sorted(np.concatenate(made, axis=1).T.tolist()) == sorted(np.stack(cols).T.tolist())
    texts = [(d, " ".join(t[:9]) + "\n" + " ".join(t[9:])) for d, t in rows]
    got = line_dedup.dedup_lines(spark.createDataFrame(texts, "doc_id long, text string").repartition(5)).collect()
    assert {r.doc_id: r.text for r in got} == brute.deduped_lines(texts)


def test_documents(spark, small_lists):
    rows = [(d, " ".join(t)) for d, t in grown(4, 160, [f"w{k}" for k in range(25)], 4)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), width=2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.components(rows, 2)


@pytest.mark.parametrize("small, parts, sketch, listed", [(4, 4, 1 << 40, 512), (8, 2, 40, 40), (192, 8, 1024, 512)])
def test_documents_in_parts(spark, monkeypatch, small, parts, sketch, listed):
    for name, value in {"SMALL": small, "PARTS": parts, "SKETCH": sketch, "LISTED": listed}.items():
        monkeypatch.setattr(near_dedup, name, value)
    monkeypatch.setattr(lists, "HOT", 3)
    rows = [(d, " ".join(t * (1 + d % 2))) for d, t in grown(5, 120, [f"w{k}" for k in range(40)], 4)]
    rows += [(1000 + d, " ".join(t)) for d, t in grown(6, 40, [f"v{k}" for k in range(90)], 3)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), width=2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.components(rows, 2)


def test_different_documents_of_common_words_are_no_candidates(spark):
    rng = random.Random(7)
    rows = [(d, " ".join(f"w{rng.randrange(40)}" for _ in range(500))) for d in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    met = near_dedup._Linker(docs, 2, 80, near_dedup.Scratch(spark, "met")).met()
    assert met.count() < len(rows)


def crowd(seed, n_rows, rate):
    """A text and copies of it, of which some are too far from it to be linked, and few are linked with each other only."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(3000)]
    base = [rng.choice(words) for _ in range(400)]
    rows = [(0, base)]
    for d in range(1, n_rows):
        text, change = list(base if d % 9 else rows[d // 2][1]), rng.random() * rate
        rows.append((d, [rng.choice(words) if rng.random() < change else w for w in text]))
    return [(d, " ".join(t)) for d, t in rows]


@pytest.mark.parametrize("lane, quota", [(7, 1), (1024, 4)])
def test_crowds(spark, monkeypatch, lane, quota):
    for name, value in {"CROWD": 2, "LANE": lane}.items():
        monkeypatch.setattr(near_dedup, name, value)
    monkeypatch.setattr(lists, "QUOTA", quota)
    rows = crowd(8, 60, 0.2) + [(100 + d, t) for d, t in crowd(9, 50, 0.3)]
    rows += [(200 + d, " ".join(t)) for d, t in grown(10, 80, [f"w{k}" for k in range(25)], 4)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), width=2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.components(rows, 2)


def test_candidates_do_not_grow_with_the_square_of_a_crowd(spark, monkeypatch):
    counts, near = [], near_dedup._Linker.near

    def counted(self, pairs):
        counts.append(pairs.count())
        return near(self, pairs)

    monkeypatch.setattr(near_dedup._Linker, "near", counted)
    rows = crowd(11, 400, 0.22)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    near_dedup._Linker(docs, 2, 80, near_dedup.Scratch(spark, "crowd")).links()
    assert counts[1] < 4 * len(rows), counts


def test_rows_of_one_id_lose_their_own_lines_only(spark):
    rows = [(1, "a b c d\nalpha beta gamma delta"), (2, "p q\none two three four"), (2, "r s\nalpha beta gamma delta"), (2, "r s\nalpha beta gamma delta")]
    got = sorted(r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([rows[0][1], rows[1][1], "r s", "r s"])


def test_reserved_names(spark):
    with pytest.raises(ValueError):
        line_dedup.dedup_lines(spark.createDataFrame([(1, "a", 1)], "doc_id long, text string, __removed int"))
