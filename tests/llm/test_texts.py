"""Operators on texts against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from folioflow.llm import licenses, mixing, ngram_join, packing, quality, sharding, substrings
from folioflow.llm.words import Words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def test_word_hashes():
    texts = ["Hello wörld\tfoo\x0bbar ", "", None, " a", "a a b a", "x" * 3000 + " y", "b" * 600_000 + " a"]
    w = Words(pa.array(texts))
    want = [WORD.findall(t or "") for t in texts]
    got = [[w.bytes[w.starts[k] : w.ends[k]].tobytes().decode() for k in range(w.first[i], w.first[i + 1])] for i in range(len(texts))]
    assert got == want
    flat = [x for row in want for x in row]
    assert len(set(zip(flat, w.hashes().tolist(), strict=True))) == len(set(flat)) == len(set(w.hashes(1).tolist()))


def removed(rows, size):
    texts = {i: WORD.findall(t or "") for i, t in rows}
    low = {}
    for i in sorted(texts):
        for k in range(len(texts[i]) - size + 1):
            low.setdefault(tuple(texts[i][k : k + size]), i)
    out = {}
    for i, w in texts.items():
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if low[tuple(w[k : k + size])] < i:
                gone[k : k + size] = [True] * size
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("size", [8, 13])
def test_repeated_windows(docs, corpus, no_docs, size):
    got = substrings.drop_repeated_windows(docs, size).collect()
    want = removed(corpus, size)
    assert len(got) == len(corpus) + 1
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == want
    assert sum(n for _, n, _ in want.values()) > 100
    if size == 13:
        assert substrings.drop_repeated_windows(no_docs).count() == 0
        kept = {r.doc_id: r.kept_text for r in substrings.drop_repeated_windows(docs, with_text=True).collect() if r.n_removed}
        assert all(hashlib.sha256(t.encode()).hexdigest() == want[i][2] for i, t in kept.items())
        with pytest.raises(ValueError):
            substrings.drop_repeated_windows(docs, 7)


def test_rows_without_an_id_are_documents_of_their_own(spark):
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(40)) for x in "abcd")
    texts = [(1, a), (None, a), (None, b), (None, b + " end"), (None, c), (None, ""), (None, "short " + d[:70]), (2, d + " tail")]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = sorted((r.n_words, r.n_removed) for r in substrings.drop_repeated_windows(df).collect() if r.doc_id is None)
    want = removed([(1, a), (2, d + " tail"), *[(10 + k, t) for k, (i, t) in enumerate(texts) if i is None]], 13)
    first, second = sorted([b, b + " end"], key=lambda t: hashlib.md5(t.encode()).hexdigest())
    kept_last = {len(second.split()): (len(second.split()), 0), len(first.split()): (len(first.split()), 40)}
    others = [v[:2] for k, v in want.items() if k >= 10 and texts[k - 10][1] not in (b, b + " end")]
    assert got == sorted([*others, *kept_last.values()])
    joined = [r for r in ngram_join.similar_groups(df).collect() if r.doc_id is None]
    assert len(joined) == 6 and [r.component_id for r in joined if r.component_id is not None] == [1]
    near = ngram_join.similar_groups(spark.createDataFrame([(None, a), (None, ""), (None, b), (5, a + " end")], "doc_id long, text string")).collect()
    assert sorted(str(r.component_id) for r in near) == ["5", "5", "None", "None"]


def test_rows_that_repeat_an_id_with_other_texts(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(3, a), (3, b), (3, b), (5, b + " end"), (1, "short"), (7, "x " + a), (2, c)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in substrings.drop_repeated_windows(df).collect())
    assert got == [(1, 1, 0), (2, 40, 0), (3, 40, 0), (3, 40, 0), (3, 40, 0), (5, 41, 40), (7, 41, 40)]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similar_groups(df).collect())
    assert got == [(1, 1, 1), (2, 37, 2), (3, 37, 3), (3, 37, 3), (3, 37, 3), (5, 38, 3), (7, 38, 3)]


def groups(rows, size, percent):
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {i: (len(s), top(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("size", "percent", "rows"), [(4, 85, 1024), (5, 80, 4), (1, 50, 1024)])
def test_similar_groups(docs, corpus, no_docs, monkeypatch, size, percent, rows):
    monkeypatch.setattr(ngram_join, "UNIT_ROWS", rows)  # small blocks, so that pairs of blocks are joined too
    got = ngram_join.similar_groups(docs, size, percent).collect()
    assert len(got) == len(corpus) + 1
    want = groups(corpus, size, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert len({c for _, c in want.values()}) < len(want)
    if rows == 4:
        assert ngram_join.similar_groups(no_docs).count() == 0


def test_tree_join_finds_what_the_bound_leaves():
    rng = np.random.default_rng(1)
    sizes = rng.integers(50, 80, 300)
    vectors = np.stack([np.bincount(rng.integers(0, 16, n), minlength=16) for n in sizes]).astype(np.int32)
    vectors[150:] = vectors[:150]
    sizes[150:] = sizes[:150]
    i, j = ngram_join.tree_join(vectors, sizes, vectors, sizes, 85)
    both = np.minimum(vectors[:, None], vectors[None]).sum(2)
    want = both >= ngram_join._need(sizes[:, None], sizes[None, :], 85)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(*(x.tolist() for x in np.nonzero(want)), strict=True))


def test_bounds_of_sets_that_differ_much_in_size():
    rng = np.random.default_rng(5)
    every = rng.integers(0, 1 << 63, 4000).astype(np.uint64)
    sets = [np.sort(every[:n]) for n in (127, 257, 129, 500, 1300, 4000)]
    sizes = np.array([len(s) for s in sets])
    vectors = [ngram_join.count_vector(s, ngram_join.groups_of(len(s))).astype(np.int32) for s in sets]
    for percent in (49, 20, 3):
        want = {(a, b) for a in range(6) for b in range(a + 1, 6) if 100 * min(sizes[a], sizes[b]) >= percent * max(sizes[a], sizes[b])}
        for side in (np.zeros(6, np.int64), np.arange(6) % 2):
            i, j = ngram_join.bounded_pairs(vectors, sizes, side, percent)
            got = [tuple(sorted(p)) for p in zip(i.tolist(), j.tolist(), strict=True)]
            assert len(got) == len(set(got)) and set(got) >= {(a, b) for a, b in want if not side.any() or side[a] != side[b]}


@pytest.mark.parametrize("percent", [85, 80, 50])
def test_similar_sets_share_a_signature(percent):
    rng = np.random.default_rng(percent)
    n_pairs = 0
    for n in (7, 8, 10, 13, 20, 40, 100, 400, 3000):
        for _ in range(20):
            every = rng.integers(0, 1 << 62, 2 * n).astype(np.uint64)
            drop, add = rng.integers(0, n // 4 + 2, 2)
            if drop + add and 100 * (n - drop) >= percent * (n + add):
                owner, value = ngram_join.signatures([np.sort(every[:n]), np.sort(every[drop : n + add])], percent)
                assert set(value[owner == 0].tolist()) & set(value[owner == 1].tolist())
                n_pairs += 1
    assert n_pairs > 20


def test_a_hub_with_many_members_is_joined_in_pages(spark, monkeypatch):
    rng = random.Random(11)
    base = [[f"w{rng.randrange(10**6)}" for _ in range(60)] for _ in range(3)]
    rows = []
    for k in range(240):  # chains of changes, so that most documents aren't near the hub
        w = list(base[k % 3])
        for j in range(k // 30):
            w[(7 * j) % 60] = f"c{j}"
        w[rng.randrange(60)] = f"own{k}"
        rows.append((k, " ".join(w)))
    monkeypatch.setattr(ngram_join, "UNIT_ROWS", 16)
    monkeypatch.setattr(ngram_join, "UNIT_SHINGLES", 900)
    got = ngram_join.similar_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == groups(rows, 4, 85)


def test_shards(docs, corpus, no_docs):
    rows = sharding.shard_by_bytes(docs, 4).collect()
    assert len(rows) == len(corpus) + 1
    text = {i: (t or "").encode() for i, t in corpus}
    assert all((r.size, r.text_crc32) == (len(text[r.doc_id]) + 1, zlib.crc32(text[r.doc_id])) for r in rows)
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert sharding.shard_by_bytes(no_docs).count() == 0


def test_shards_are_balanced(spark):
    df = spark.range(3000).selectExpr("id as doc_id", "repeat('x', cast(id % 40 as int)) as text").repartition(6)
    sizes = Counter()
    for r in sharding.shard_by_bytes(df, 5).collect():
        sizes[r.shard] += r.size
    assert sorted(sizes) == list(range(5)) and max(sizes.values()) - min(sizes.values()) <= 2 * 41  # half a row at each end of both


def test_packing(spark, no_docs):
    lengths = [0, None, 1, 1, 5, 5, 6, 40, 41, 100, 7]
    df = spark.createDataFrame(list(enumerate(lengths)), "doc_id long, n int")
    rows = packing.pack(df, "n", buckets=3, batch_tokens=90).collect()
    assert len(rows) == len(lengths) and all(r.n_tokens <= r.bucket_length for r in rows)
    for key in {(r.bucket, r.batch) for r in rows}:
        own = [r for r in rows if (r.bucket, r.batch) == key]
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert key[0] == 0 or len(own) == 1 or len(own) * own[0].bucket_length <= 90
    assert packing.pack(no_docs, "pos").count() == 0


def test_bounds_are_optimal():
    from itertools import combinations

    rng = np.random.default_rng(3)
    for _ in range(20):
        lengths = np.unique(rng.integers(1, 60, 9))
        counts = rng.integers(1, 9, len(lengths))
        cost = lambda bounds: sum(c * (min(b for b in bounds if b >= n) - n) for n, c in zip(lengths, counts, strict=True))  # noqa: E731, B023
        best = min(cost([*rest, lengths[-1]]) for rest in combinations(lengths[:-1].tolist(), 2))
        assert cost(packing.bucket_bounds(lengths, counts, 3)) == best


def test_a_very_long_row_leaves_the_bounds_exact(spark):
    lengths = [*range(1, 40), 10_000_000]
    rows = packing.pack(spark.createDataFrame(list(enumerate(lengths)), "doc_id long, n long"), "n", buckets=3).collect()
    best = min(sum(next(b for b in (c, 39) if b >= n) - n for n in range(1, 40)) for c in range(1, 39))
    assert sum(r.padding for r in rows) == best and {r.bucket_length for r in rows} <= set(lengths)


def test_mixing(docs, corpus, no_docs):
    rows = mixing.mix_sources(docs.drop("size").withColumn("size", packing.word_count())).collect()
    assert len(rows) == len(corpus) + 1 and all(0 <= r.copies <= 2 for r in rows)
    size, taken, target = Counter(), Counter(), {}
    for r in rows:
        size[r.key] += r.size
        taken[r.key] += r.size * r.copies
        target[r.key] = r.target
    keys = sorted(size)
    weight = {k: (3, 1, 2)[i % 3] for i, k in enumerate(keys)}
    full: set[str] = set()
    while True:  # the same by hand
        level = (1.5 * sum(size.values()) - sum(2 * size[k] for k in full)) / (sum(weight[k] for k in keys if k not in full) or 1)
        over = {k for k in keys if k not in full and weight[k] * level > 2 * size[k]}
        if not over:
            break
        full |= over
    for k in keys:
        want = 2 * size[k] if k in full else weight[k] * level
        assert target[k] == pytest.approx(want)
        assert abs(taken[k] - want) <= max((r.size for r in rows if r.key == k), default=0) / 2 + 1
    again = mixing.mix_sources(docs.drop("size").withColumn("size", packing.word_count()).repartition(3)).collect()
    assert sorted((r.doc_id, r.copies) for r in again) == sorted((r.doc_id, r.copies) for r in rows)
    assert mixing.mix_sources(no_docs.withColumn("size", no_docs.pos)).count() == 0


def test_rates_are_the_entropy_optimum(docs):
    rows = mixing.mix_sources(docs.drop("size").withColumn("size", packing.word_count())).collect()
    for key in {r.key for r in rows}:
        own = [r for r in rows if r.key == key]
        sizes, target = np.array([r.size for r in own], float), own[0].target
        if not 0 < target < 2 * sizes.sum() * (1 - 1e-9):
            assert all(r.rate == (2 if target else 0) for r in own)
            continue
        low, high = -50.0, 50.0  # the dual's gradient grows with theta, so that halving finds its root
        for _ in range(200):
            theta = (low + high) / 2
            rates = 2 / (1 + np.exp(-(theta * sizes / max(sizes.mean(), 1))))
            low, high = (theta, high) if (rates * sizes).sum() < target else (low, theta)
        assert np.allclose([r.rate for r in own], rates, atol=1e-4)


def test_batches_and_slots_by_hand(spark):
    rng = random.Random(2)
    lengths = [rng.choice([0, 3, 3, 7, 20, 21, 50]) for _ in range(300)]
    rows = packing.pack(spark.createDataFrame(list(enumerate(lengths)), "doc_id long, n int"), "n", buckets=3, batch_tokens=100).collect()
    from itertools import combinations

    every = sorted({n for n in lengths if n})
    cost = lambda bounds: sum(min(b for b in bounds if b >= n) - n for n in lengths if n)
    assert sum(r.padding for r in rows) == min(cost([*rest, every[-1]]) for rest in combinations(every[:-1], 2))
    bounds = sorted({r.bucket_length for r in rows if r.n_tokens})
    want = {}
    for b, bound in enumerate([0, *bounds]):
        low = bounds[b - 2] if b > 1 else 0
        own = sorted((n, i) for i, n in enumerate(lengths) if (n == 0 if b == 0 else low < n <= bound))
        room = max(1, 100 // max(1, bound))
        want |= {i: (b, k // room, k % room, bound - n) for k, (n, i) in enumerate(own)}
    assert {r.doc_id: (r.bucket, r.batch, r.slot, r.padding) for r in rows} == want


def test_licenses(spark, no_docs):
    mit = "MIT License. " + licenses.SENTENCES["mit grant"].capitalize() + ". " + licenses.SENTENCES["mit notice"].capitalize() + "."
    rows = [
        (1, "Text.\nReleased### under&&& the*** MIT%%% License.$$$\nmore"), (2, mit), (3, "Licensed under the Apache License, Version 2.0. Released under the MIT License."),
        (4, "All rights reserved."), (5, None), (6, ""), (7, "the license of the town"), (7, "the license of the town"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as rest", "2 as n0")
    got = {r.doc_id: (r.licenses, r.n_matches, r.n_fragments) for r in licenses.scan_licenses(df).collect()}
    assert got == {1: ("MIT", 1, 0), 2: ("MIT", 1, 0), 3: ("Apache-2.0,MIT", 2, 0), 4: (None, 0, 1), 5: (None, 0, 0), 6: (None, 0, 0), 7: (None, 0, 0)}
    assert licenses.scan_licenses(no_docs).count() == 0


NOTICES = {
    "GPL-3.0-or-later": """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.""",
    "GPL-2.0-or-later": """ * This program is free software; you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation; either version 2 of the License, or
 * (at your option) any later version.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this file, ...""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

(3) Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.""",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.""",
    "Apache-2.0": """// Licensed under the Apache License, Version 2.0 (the "License");
// you may not use this file except in compliance with the License.
// You may obtain a copy of the License at
//
//     http://www.apache.org/licenses/LICENSE-2.0
//
// Unless required by applicable law or agreed to in writing, software
// distributed under the License is distributed on an "AS IS" BASIS,
// WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
    "Unlicense": "This is free and unencumbered software released into the public\ndomain.",
}


WHOLE = {
    "MIT": "MIT License\n\nCopyright (c) 2024 Some Person\n\n" + NOTICES["MIT"] + """

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.""",
    "Apache-2.0": "# " + NOTICES["Apache-2.0"].replace("//", "#")[2:],
    "ISC": """Copyright 2020, A. Person

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.""",
    "AGPL-3.0-or-later": NOTICES["GPL-3.0-or-later"].replace("GNU General", "GNU Affero General"),
    "LGPL-2.1-only": "x = 1  \n# SPDX-License-Identifier: LGPL-2.1-only\n",
    "Zlib": """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:""",
}


def test_whole_notices_count_once(spark):
    df = spark.createDataFrame(list(WHOLE.items()), "doc_id string, text string")
    got = {r.doc_id: (r.licenses, r.n_fragments) for r in licenses.scan_licenses(df).collect()}
    assert got == {k: (k, 1 if k == "Zlib" else 0) for k in WHOLE}
    assert all(r.n_matches == 1 for r in licenses.scan_licenses(df).collect())


def test_standard_notices_as_they_are_wrapped(spark):
    rows = [*NOTICES.items(), ("none", "All rights\nreserved."), ("blank", "MIT\n\nLicense.")]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    got = {r.doc_id: (r.licenses, r.n_matches, r.n_fragments) for r in licenses.scan_licenses(df).collect()}
    assert got == {k: (k, 1, 0) for k in NOTICES} | {"none": (None, 0, 1), "blank": (None, 0, 0)}


def test_quality_learns_without_held_out_labels(spark, no_docs):
    good = [(i, "The small town has a quiet market near the old river bank.") for i in range(0, 400, 2)]
    bad = [(i, "BUY!! NOW!! $$$ ### " * 5) for i in range(1, 400, 2)]
    df = spark.createDataFrame([*good, *bad, (1000, None), (1001, ""), (None, "Words.")], "doc_id long, text string").withColumn("x", quality.F.lit(1))
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(400)] + [(5, None), (7, 9), (None, 1)], "doc_id long, quality int")
    rows = quality.score_quality(df, labels).collect()
    assert len(rows) == 403 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id < 400]
    assert held and all(r.predicted == (r.doc_id % 2 == 0) for r in held)
    flipped = labels.withColumn("quality", quality.F.when(quality.held_out(), 1 - quality.F.col("quality")).otherwise(quality.F.col("quality")))
    assert sorted(map(str, quality.score_quality(df, flipped).collect())) == sorted(map(str, rows))
    assert quality.score_quality(no_docs, labels).count() == 0
    assert {r.score for r in quality.score_quality(df, labels.limit(0)).collect()} == {0.5}


def test_pair_tables_learn_an_interaction():
    rng = np.random.default_rng(2)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x, y)
    assert ((model.score(x) >= 0.5) == y).mean() > 0.95 and (0, 1) in [(f, g) for f, g, _ in model.pairs]


def test_counts_of_any_size():
    for n, count in ((200, 3), (200, 300), (70_000, 70_000)):
        hashes = np.full(count, 5, np.uint64) if count > 3 else np.arange(3, dtype=np.uint64)
        hashes = np.r_[hashes, np.arange(max(0, n - count), dtype=np.uint64) + np.uint64(1)]
        back = ngram_join.unpacked_vector(ngram_join.packed_vector(hashes), len(hashes))
        assert back.sum() == len(hashes) and (back == ngram_join.count_vector(hashes, len(back))).all()
    assert ngram_join.count_vector(np.zeros(1_300_000, np.uint64), 16)[0] == 1_300_000


def test_links_of_texts_with_more_shingles_than_16_bits_count(spark):
    """Three texts of 1.3 million words, the second near the first and the third near the second."""
    base = [f"w{k}" for k in range(1_300_000)]
    texts = [base, [*base[: 1_300_000 - 100_000], *(f"x{k}" for k in range(100_000))], [*(f"y{k}" for k in range(95_000)), *base[95_000 : 1_200_000], *(f"x{k}" for k in range(100_000))]]
    df = spark.createDataFrame([(i + 1, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_groups(df).collect()}
    assert got == {1: (1_299_997, 1), 2: (1_299_997, 1), 3: (1_299_997, 1)}
