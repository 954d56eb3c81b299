import hashlib
import random
from array import array

import brute
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from gridloom.llm import byte_bpe, decontaminate, line_dedup, near_dedup, queries, token_counts, workers
from gridloom.llm.components import components
from gridloom.llm.scratch import Scratch

PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.read_ranks(queries.multi_ranks())


@pytest.fixture(scope="module")
def reference(ranks):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_library_on_random_texts(ranks, reference):
    parts = ["a", "b", "é", " ", " ", "\n", "\t", "1", "'s", "'ll", ".", "!", "　", "日", "\x1c", "\x85", "ING", "<|endoftext|>", "\U0001f600", "\r", "the"]
    rng = random.Random(5)
    plain, spaced = byte_bpe.ByteBPE(ranks, PATTERN), byte_bpe.ByteBPE(ranks, PATTERN, spaced=True)
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        want = array("I", reference.encode_ordinary(text)).tobytes()
        assert plain.encode(text) == want and spaced.encode(text) == want
        assert plain.decode(want) == text.encode()


def test_bpe_long_pieces(ranks, reference):
    rng = random.Random(6)
    coder = byte_bpe.ByteBPE(ranks, PATTERN)
    for text in ("a" * 30_000, "".join(rng.choice("abeilnorst") for _ in range(30_000)), "é" * 5_000):
        assert coder.encode(text) == array("I", reference.encode_ordinary(text)).tobytes()


def test_rank_queue_order():
    queue, rng, held = byte_bpe.RankQueue(5000), random.Random(1), []
    for _ in range(3000):
        if rng.random() < 0.6 or not held:
            held.append((rng.randrange(5000), rng.randrange(50)))
            queue.push(*held[-1])
        else:
            rank, positions = queue.take()
            assert [(rank, p) for p in positions] == sorted(x for x in held if x[0] == rank) and rank == min(held)[0]
            held = [x for x in held if x[0] != rank]
    while held:
        rank, positions = queue.take()
        assert rank == min(held)[0]
        held = [x for x in held if x[0] != rank]
    assert queue.take() == (-1, [])


def test_bpe_takes_lower_ranks_first_when_they_come_late():
    """A merge that makes a pair of a lower rank, in a vocabulary that was not trained so."""
    ranks = {bytes([b]): 1000 + b for b in range(256)} | {b"bc": 5, b"abc": 1, b"cd": 7, b"bb": 6, b"bbbb": 2, b"bbb": 3}
    plain = tiktoken.Encoding("odd", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    coder, rng = byte_bpe.ByteBPE(ranks, r"\S+|\s+"), random.Random(9)
    for _ in range(300):
        text = "".join(rng.choice("aabbbcd ") for _ in range(rng.randrange(40)))
        assert coder.encode(text) == array("I", plain.encode_ordinary(text)).tobytes()


def test_lean_bpe_holds_less_and_gives_the_same(ranks):
    full, lean = byte_bpe.ByteBPE(ranks, PATTERN), byte_bpe.ByteBPE(ranks, PATTERN, memory=1 << 12)
    rng = random.Random(12)
    for _ in range(40):
        text = " ".join("".join(rng.choice("abeilnorst") for _ in range(9)) for _ in range(20))
        assert lean.encode(text) == full.encode(text)
    assert len(lean.pieces.now) + len(lean.pieces.older) < 100 < len(full.pieces.now)


def test_batches_from_workers_are_bounded(monkeypatch):
    monkeypatch.setattr(workers, "PIECE_BYTES", 1000)
    batch = pa.RecordBatch.from_pydict({"x": list(range(1000)), "y": ["a" * 10] * 1000})
    got = list(workers.tidy(lambda batches: batches)(iter([batch, batch.slice(0, 0)])))
    assert pa.Table.from_batches(got).equals(pa.Table.from_batches([batch])) and all(b.nbytes < 1100 for b in got)


def test_op1_rows(spark, docs, odd, none, reference):
    for table in (docs, odd):
        got = byte_bpe.roundtrip_digests(table, queries.multi_ranks(), PATTERN, spaced=True).collect()
        texts = [(r.doc_id, r.text or "") for r in table.select("doc_id", "text").collect()]
        want = [(d, array("I", reference.encode_ordinary(t)).tobytes(), t.encode()) for d, t in texts]
        assert sorted(map(str, got)) == sorted(
            f"Row(doc_id={d}, n_tokens={len(i) // 4}, ids_sha256='{hashlib.sha256(i).hexdigest()}', decoded_sha256='{hashlib.sha256(t).hexdigest()}')" for d, i, t in want
        )
    assert byte_bpe.roundtrip_digests(none, queries.multi_ranks(), PATTERN).count() == 0


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_equal_brute_force(docs, width):
    want = brute.components([(r.doc_id, r.text) for r in docs.collect()], width)
    got = near_dedup.near_duplicates(docs, width=width).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_chain_and_large_sets(spark):
    base = [f"w{k}" for k in range(3000)]
    rng = random.Random(2)
    rows = []
    for d in range(40):  # each a further change of the one before: ends are far apart but linked
        rows.append((d, " ".join(base)))
        base[rng.randrange(3000)] = f"new{d}"
        for k in range(60):
            base[(d * 70 + k) % 3000] = f"n{d}x{k}"
    rows += [(100 + d, " ".join(f"u{d}v{k}" for k in range(300))) for d in range(20)]
    rows += [(200, "a b c d e"), (201, "a b c d e f"), (202, "a b c d"), (203, "z"), (204, "Z "), (205, "z y")]
    rng.shuffle(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect()}
    assert got == brute.components(rows, 2)


def test_near_duplicates_odd_rows(odd, none):
    got = near_dedup.near_duplicates(odd, width=2).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got}
    assert (by[0].n_shingles, by[0].component_id, by[0].kept) == (0, 0, True)
    assert (by[5].component_id, by[5].kept, by[4].kept) == (4, False, True)
    assert (by[None].component_id, by[None].kept) == (None, True)
    assert near_dedup.near_duplicates(none).count() == 0


def test_near_duplicates_same_id_on_two_texts(spark):
    rows = [(1, "a b c d e f g h"), (1, "q r s t u v w x"), (2, "a b c d e f g h"), (3, "q r s t u v w x")]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect()
    assert {r.component_id for r in got} == {1}


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1100)] + [(5000, 5000 + k) for k in range(1, 50)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    want = {x: root(x) for a, b in edges if a != b for x in (a, b)}
    got = components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "t")).distinct().collect()
    assert {r.node: r.label for r in got} == want and len(got) == len(want)


def test_line_dedup_equals_brute_force(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()} == brute.deduped_lines(rows)


def test_line_dedup_small(spark):
    rows = [(3, "a b c d e\n\nx"), (1, "a b c d e f\nx y"), (2, "A B C D E F\nx\nX"), (4, "p q\nq p\np q r")]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in got} == brute.deduped_lines(rows)
    assert {r.doc_id: (r.n_lines, r.n_kept) for r in got}[4] == (3, 2)


def test_line_dedup_odd_rows(odd, none):
    got = line_dedup.dedup_lines(odd).collect()
    assert len(got) == odd.count() and got[0].asDict().keys() >= {"key", "items", "removed", "n_lines", "n_kept"}
    texts = {r.doc_id: r.text for r in got}
    assert texts[0] is None and texts[1] == "" and texts[2] == "  \n " and texts[5] == "" and texts[4].startswith("one two") and texts[None] is not None
    assert line_dedup.dedup_lines(none).count() == 0


def test_windows_equal_brute_force(spark, docs, data, monkeypatch):
    bench = spark.read.parquet(f"{data}/benchmark.parquet")
    short = spark.createDataFrame([(900, "the of"), (901, "And"), (902, None), (903, "--"), (None, "is the")], "item_id long, text string")
    bench = bench.select("item_id", "text").unionByName(short)
    items = [(r.item_id, r.text) for r in bench.collect() if r.item_id is not None]
    texts = {r.doc_id: r.text for r in docs.collect()}
    for most in (200_000, 300):
        monkeypatch.setattr(decontaminate, "BLOCK", most)
        for r in decontaminate.window_digests(docs, bench).collect():
            n, hit, names = brute.windows(texts[r.doc_id], items)
            assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n, hit, len(names), decontaminate.items_digest(names), hit > 0)


def test_decontaminate_leaves_no_window_and_clean_texts(spark, docs, data):
    bench = spark.read.parquet(f"{data}/benchmark.parquet")
    before = {r.doc_id: r for r in decontaminate.window_digests(docs, bench).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    clean = decontaminate.decontaminate(docs, bench)
    assert clean.columns == docs.columns
    assert decontaminate.window_digests(clean, bench).where("contaminated").count() == 0
    kept = {r.doc_id: r.text for r in clean.collect()}
    assert all(kept[d] == texts[d] for d, r in before.items() if not r.contaminated)
    item = bench.first().text
    made = spark.createDataFrame([(1, f"Before, {item} after", "x"), (2, item, "x"), (3, None, "x")], "doc_id long, text string, items string")
    out = {r.doc_id: r for r in decontaminate.decontaminate(made, bench, most_cover=0.95).collect()}
    assert set(out) == {1, 3} and out[1].items == "x" and out[1].text.startswith("Before,") and out[1].text.endswith("after")


def test_windows_odd_rows(odd, none, spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight"), (1, "one two")], "item_id long, text string")
    got = decontaminate.window_digests(odd, bench).collect()
    assert len(got) == odd.count() and {r.n_hit for r in got if r.doc_id == 4} == {2}
    assert decontaminate.window_digests(none, bench).count() == 0
    assert decontaminate.window_digests(odd, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.decontaminate(odd, bench).columns == odd.columns


def test_token_counts_equal_brute_force(ranks, docs, odd, none, monkeypatch):
    scores = token_counts.zipf_scores(ranks)
    trie, rng = token_counts.PrefixTrie(scores), random.Random(4)

    def best(word):
        table = [(0.0, 0)]
        for end in range(1, len(word) + 1):
            table.append(max((table[b][0] + scores[word[b:end]], table[b][1] - 1) for b in range(end) if word[b:end] in scores))
        return -table[-1][1]

    for _ in range(400):
        word = bytes(rng.choice(b"aeinrst h\xc3\xa9") for _ in range(rng.randrange(1, 16)))
        assert trie.count(word) == best(word)
    monkeypatch.setattr(token_counts, "LONG", 3)
    monkeypatch.setattr(token_counts, "NODES", 20)
    for _ in range(100):
        word = bytes(rng.choice(b"aeinrst h\xc3\xa9") for _ in range(rng.randrange(1, 600)))
        assert trie.count(word) == best(word)
    monkeypatch.undo()
    for table in (docs, odd):
        counter = token_counts.Counter(scores, PATTERN, False)
        want = sorted((str(r.doc_id), counter.count_all([r.text or ""])[0]) for r in table.collect())
        got = token_counts.token_counts(table, queries.multi_ranks(), PATTERN, spaced=True).collect()
        assert sorted((str(r.doc_id), r.n_tokens) for r in got) == want
    assert token_counts.token_counts(none, queries.multi_ranks(), PATTERN).count() == 0


def test_registered_queries_read_whole_tables(spark, data, docs):
    found = queries.queries()
    assert [n.split("_")[0] for n in found] == [f"op{k}" for k in range(1, 11)]
    assert found["op3_line_dedup"](spark, data).count() == docs.count()
    assert found["op6_token_counts"](spark, data).agg(F.count("*")).first()[0] == docs.count()
