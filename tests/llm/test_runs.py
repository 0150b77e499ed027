"""Periodic runs against a plain search over all periods."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from folioflow.llm import runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(w, exponent=4, least=6):
    """Maximal stretches of each period from 1 on; a stretch keeps the first period that it is found with."""
    found = {}
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i + q - s >= max(least, exponent * q):
                found.setdefault((s, i + q), q)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(w, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


@pytest.mark.parametrize(("exponent", "least"), [(4, 6), (2, 2), (3, 5)])
def test_all_runs_of_random_sequences(exponent, least):
    rng, n = random.Random(1), 0
    for _ in range(400):
        rows = []
        for _ in range(rng.randint(1, 4)):
            w = [rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(rng.randint(0, 40))]
            if rng.random() < 0.6:
                period = [rng.randrange(3) for _ in range(rng.randint(1, 5))]
                w = w[: rng.randint(0, 10)] + (period * rng.randint(2, 9))[: rng.randint(1, 40)] + w[: rng.randint(0, 10)]
            rows.append(w)
        first = np.cumsum([0, *map(len, rows)])
        x = np.array([1000 * r + v for r, w in enumerate(rows) for v in w], np.int64)
        s, e, d = runs.word_runs(x, first, exponent, least)
        want = [(a + first[r], a + first[r] + m, q) for r, w in enumerate(rows) for a, m, q in brute(w, exponent, least)]
        assert list(zip(s, e, d, strict=True)) == want
        n += len(want)
    assert n > 300


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    out = [" ".join(rng.choices("ab" if i % 2 else "abcdefgh", k=rng.randint(1, 300))) for i in range(40)]
    out += ["go " * 5, "go " * 6, "x " + "a b " * 4, "a b\t" * 3 + "a", "y y z " * 20 + "y y y y y y", "é é é é " * 4, "A a A a A a A a"]
    out += [None, "", " \n", "one", "w " * 50_000, " ".join(str(i % 2500) for i in range(20_001)), " ".join(map(str, range(20_000)))]
    return out


def test_runs_and_collapsed_texts(spark, texts):
    rows = [(i // 2, t, "clash", "clash") for i, t in enumerate([*texts, texts[0]])]
    df = spark.createDataFrame(rows, "doc_id int, text string, runs string, collapsed string").repartition(3)
    got = sorted((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in runs.periodic_runs(df).collect())
    want = []
    for i, t, *_ in rows:
        w = WORD.findall(t or "")
        # two long texts have periods that a search over all would take long to find
        found = [(0, 50_000, 1)] if w[:9] == ["w"] * 9 else [(0, 20_001, 2500)] if len(w) == 20_001 else [] if len(w) == 20_000 else brute(w)
        want.append((i, len(w), found, collapsed(w, found)))
    assert got == sorted(want)
    assert runs.periodic_runs(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        runs.periodic_runs(df, exponent=1)


def test_op11_of_odd_rows(spark, texts, tmp_path):
    ids = [*range(len(texts) - 1), None]
    df = spark.createDataFrame([(i, t, "en") for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, runs string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.asDict() for r in runs.op11_periodic_runs(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    changed = 0
    for i, t in zip(ids, texts, strict=True):
        w = WORD.findall(t or "")
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[j] if j < a else w[a + (j - a) % p] for j in range(len(w))]
            changed += 1
        if len(w) > 2000:
            continue
        found = brute(w)
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        assert got[i] == {
            "doc_id": i, "n_runs": len(found), "start": best[0], "length": best[1], "period": best[2],
            "exponent_milli": 1000 * best[1] // best[2] if found else None,
            "runs_sha256": hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest(),
            "collapsed_sha256": hashlib.sha256(collapsed(w, found).encode()).hexdigest(),
        }
    assert changed > 2
