"""The pipeline's stages, each against plain Python on its own input."""

from __future__ import annotations

import re
from collections import Counter

import corpus_pipeline as cp
from folioflow.llm.quality import score_quality
from tests.llm.test_texts import groups

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tables = [docs]
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, tables[-1], SF).write.parquet(str(tmp_path / str(k)))
        tables.append(spark.read.parquet(str(tmp_path / str(k))))
    before, good, single, private, mixed, packed = (t.toPandas() for t in tables)
    assert all(list(t.columns) == list(cp.COLUMNS) for t in tables[1:5])
    labels = dict(spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality").collect())
    rejected = set(before.doc_id) - set(good.doc_id)
    verdicts = score_quality(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()
    assert rejected == {r.doc_id for r in verdicts if r.predicted == 0}
    clean = [i for i in before.doc_id if labels.get(i) == 1]
    assert sum(i in rejected for i in clean) <= 0.05 * len(clean) and any(labels.get(i) == 0 for i in rejected)
    want = groups(list(zip(good.doc_id.tolist(), good.text, strict=True)), 5, 80)
    assert set(single.doc_id) == {i for i, (_, c) in want.items() if i == c}
    assert set(private.doc_id) == set(single.doc_id)
    found = re.compile(r"[\w.]+@mail\d\.example\.com|\+\d \(\d{3}\) 555-\d{4}")
    old = {m for t in single.text for m in found.findall(t)}
    assert old and not any(o in t for o in old for t in private.text)
    assert (private.n_chars == private.text.str.len()).all()
    times = Counter(mixed.doc_id)
    assert set(times) <= set(private.doc_id) and max(times.values()) <= 2
    assert Counter(packed.doc_id) == times and (packed.n_tokens <= packed.bucket_length).all()


def test_rows_without_an_id_stay_in_the_mixture(spark):
    rows = [(None, f"text number {k} of some words", "en", "s0", 30) for k in range(6)] + [(1, "one text more", "en", "s0", 13)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    mixed = cp.mixing_stage(spark, docs, SF).collect()
    assert {r.text for r in mixed if r.doc_id is None} and sum(r.doc_id is None for r in mixed) >= 6
    again = docs.unionByName(docs.limit(1))
    single = cp.near_copies_stage(spark, again, SF).collect()
    assert sorted(r.text for r in single) == sorted(r[1] for r in rows)


def test_stages_take_any_rows(spark, tmp_path):
    odd = [(None, None, None, None, None), (5, "", "en", None, 0), (5, "x" * 50_000, None, "s0", None), (6, "word " * 20_000, "en", "s1", 100_000), (6, "word " * 20_000, "en", "s1", 100_000)]
    docs = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long")
    for rows in (docs, docs.limit(0)):
        for k, (_, stage) in enumerate(cp.STAGES):
            at = str(tmp_path / f"{rows is docs}-{k}")
            stage(spark, rows, SF).write.parquet(at)
            n = spark.read.parquet(at).count()
            assert n == {0: n, 1: 4, 2: 5, 3: n, 4: 5}[k] if rows is docs else n == 0
