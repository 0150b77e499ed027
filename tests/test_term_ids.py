"""Terms as numbers, and searches that use them."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

from folioflow.operators import retrieval, term_ids
from folioflow.operators.retrieval import fit_tfidf
from folioflow.operators.search_index import StoredIndex

SCHEMA = "document_id long, chunk_index int, text string"


def test_numbers_stand_for_terms(monkeypatch):
    rng = random.Random(2)
    vocabulary = [f"w{i}" * (1 + i % 5) for i in range(300)] + ["é" * 400, "é" * 401, "ab" * 300, "straße", "12345678", "123456789"]
    texts = ["", "aa", "aa aa aa", *(" ".join(rng.choices(vocabulary, k=rng.randrange(80))) for _ in range(300)), ""]
    words = [t.split() for t in texts]
    want = [Counter(w) + Counter(f"{a} {b}" for a, b in zip(w, w[1:], strict=False)) for w in words]
    for step in (term_ids.STEP, 500):
        monkeypatch.setattr(term_ids, "STEP", step)
        for array, some in ((pa.array(texts), want), (pa.array(["x y", *texts, "z"]).slice(1, len(texts)), want), (pa.array([], pa.string()), [])):
            ids, counts, sizes = term_ids.counted_ids(array)
            assert sizes.tolist() == [len(c) for c in some]
            names: dict[int, set] = {}
            for c, a, b in zip(some, np.cumsum(sizes) - sizes, np.cumsum(sizes), strict=True):
                assert sorted(c.values()) == sorted(counts[a:b].tolist())
                for i, n in zip(ids[a:b].tolist(), counts[a:b].tolist(), strict=True):
                    same = {t for t in c if c[t] == n}
                    names[i] = names.get(i, same) & same
            assert len(names) == len(set().union(*some)) and all(names.values())


def test_ranges_keep_numbers_together(monkeypatch):
    ids = np.random.default_rng(3).integers(-50, 50, 1000)
    for size in (1 << 21, 100):
        monkeypatch.setattr(term_ids, "SORTED", size)
        parts = [x.tolist() for x in term_ids.ranges(ids)]
        assert sorted(sum(parts, [])) == list(range(1000)) and len(parts) == max(1, 1000 // size)
        assert sum(len(set(ids[x].tolist())) for x in parts) == len(set(ids.tolist()))


def shuffled_rows(spark, job):
    sc = spark.sparkContext
    stages = lambda: sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    total = lambda: sum((x := stages()).apply(i).shuffleWriteRecords() for i in range(stages().size()))
    before = total()
    out = job()
    return out, total() - before


def test_products_stay_in_their_task(spark):
    """Each chunk shares words with each query: no row moves for each such pair, nor for each term."""
    rng = random.Random(4)
    rows = [(d, 0, " ".join(f"w{rng.randrange(40)}" for _ in range(60))) for d in range(400)]
    queries = spark.createDataFrame([(q, " ".join(f"w{rng.randrange(40)}" for _ in range(8))) for q in range(60)], "q long, text string")
    index = retrieval.fit_tfidf(spark.createDataFrame(rows, SCHEMA), ["document_id", "chunk_index"], keep=True)
    found, moved = shuffled_rows(spark, lambda: retrieval.search_chunks(index, queries, "q", "text").collect())
    assert len(found) == 300 and moved < 400 * 60 / 4


def test_blocks_of_queries_and_odd_rows(spark, monkeypatch):
    rows = [(1, 0, "solar power"), (1, 1, "solar power"), (2, 0, ""), (3, 0, None), (4, 0, "of the"), (5, 0, "wind power wind")]
    queries = spark.createDataFrame([("a", "solar power"), ("b", "wind"), ("c", None), ("d", "zzz"), (None, "wind power")], "q string, text string")
    index = retrieval.fit_tfidf(spark.createDataFrame(rows, SCHEMA), ["document_id", "chunk_index"])
    answer = lambda i: sorted(map(str, retrieval.search_chunks(i, queries, "q", "text", 2).collect()))
    want = answer(index)
    assert len(want) == 2 + 1 + 2 and index.n == 4
    monkeypatch.setattr(retrieval, "BLOCK_TERMS", 2)
    assert answer(index) == want
    assert answer(retrieval.fit_tfidf(spark.createDataFrame([], SCHEMA), ["document_id", "chunk_index"])) == []
    assert retrieval.search_chunks(index, queries.where("q = 'c'"), "q", "text").count() == 0


def test_searches_move_few_stored_frequencies(spark, tmp_path):
    rng = random.Random(5)
    rows = [(d, 0, " ".join(f"w{rng.randrange(20_000)}" for _ in range(80))) for d in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)
    queries = spark.createDataFrame([(q, " ".join(rows[q * 9][2].split()[3:8])) for q in range(4)], "q long, text string")
    index = StoredIndex(spark, f"file://{tmp_path}/index")
    for k in (0, 1):
        index.append(df.where(f"document_id % 2 = {k}"))
    terms = {t for _, _, x in rows for w in [x.split()] for t in (*w, *zip(w, w[1:], strict=False))}
    assert index.frequencies(index.snapshot()).count() == len(terms)
    found, moved = shuffled_rows(spark, lambda: sorted(map(str, index.search(queries, "q", "text").collect())))
    assert len(found) >= 4 and moved < len(terms) / 10
    whole = fit_tfidf(df, ["document_id", "chunk_index"])
    assert found == sorted(map(str, retrieval.search_chunks(whole, queries, "q", "text").collect()))


def test_seen_lets_all_its_numbers_through(spark):
    words = pa.array([f"a{i} b{i % 7}" for i in range(500)])
    parts = [p for k in (0, 250) for p in term_ids.Seen.pieces([pa.record_batch([words.slice(k, 250)], ["words"])])]
    table = pa.Table.from_batches(parts)
    pieces = {p: term_ids.Seen.either(table.filter(pa.compute.equal(table.column("piece"), p))) for p in set(table.column("piece").to_pylist())}
    seen = term_ids.Seen({p: t.column("bits")[0].as_py() for p, t in pieces.items()})
    assert seen(term_ids.counted_ids(words)[0]).all()
    others = np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 10_000)
    assert seen(others).sum() < 100


def test_buckets_have_tasks_of_their_own(spark):
    for buckets in (1, 4, 37):
        labels, tasks = retrieval.bucket_labels(spark, buckets)
        assert len(set(labels.tolist())) == buckets and tasks == max(4, buckets)
        rows = spark.createDataFrame([(int(x),) for x in labels], "bucket int").repartition(tasks, "bucket")
        assert max(rows.rdd.glom().map(len).collect()) == 1
