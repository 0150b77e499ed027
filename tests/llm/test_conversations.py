"""Conversation repair against a plain search for the least (cost, audit)."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string, pos string, seg int"
EMPTY = hashlib.sha256(b"").hexdigest()


def plain(rows):
    """All figures of one conversation's rows (turn, role, text)."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).hexdigest()))
    seen, faults = set(), []
    for _, role, text in rows:
        end = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else None)
        seen.add((role, text))
    best = {"": (0, "", ()), "a": (0, "", ()), "s": None, "u": None}

    def least(*options):
        return min((o for o in options if o is not None), default=None)

    def put(cost, letter, rest, *line):
        return rest and (rest[0] + cost, letter + rest[1], (*line, *rest[2]))

    def closed(now):
        made = now | {"u": least(now["u"], put(2, "I", now["a"], "assistant:")), "a": least(now["a"], put(2, "I", now["u"], "user:"))}
        return made | {k: least(now[k], put(2, "I", made["u"], "user:")) for k in ("", "s")}

    best = closed(best)
    for (_, role, text), fault in zip(rows[::-1], faults[::-1], strict=True):
        cut = fault == "truncated"
        now = {}
        for state in ("", "s", "u", "a"):
            options = [put(3, "D", best[state])]
            if fault not in ("blank", "duplicate"):
                to, name = ("a", "assistant") if state == "u" else ("u", "user")
                options.append(put(2 + cut, "R", best[to], f"{name}:{text}"))
                if role[:1] == to or (role[:1] == "s" and state == ""):
                    options.append(put(cut, "K", best[role[:1]], f"{role}:{text}"))
            now[state] = least(*options)
        best = closed(now)
    turns = {t for t, _, _ in rows if t is not None}
    initials = [r[:1] for _, r, _ in rows]
    cost, audit, lines = best[""]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0, **{f: faults.count(f) for f in C.FAULTS},
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials[:-1], initials[1:], strict=True)), "cost": cost, "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    }


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    texts = ["Yes.", "No!", "and then", "Why? ", "", " \n", "Ok.\t", "x" * 300, "é.", "cut,", None]
    roles = ["user"] * 6 + ["assistant"] * 6 + ["system", "system", "tool", "", "s", "aide", None]
    out = []
    for conv in range(60):
        n = rng.randint(1, 12) if conv else 100
        turn = 0
        for k in range(n):
            turn += rng.choice([0, 1, 1, 1, 1, 3])
            out.append((conv if conv < 59 else None, turn if rng.random() < 0.95 else None, rng.choice(roles), f"{rng.randint(0, 60)} {rng.choice(texts)}" if rng.random() < 0.5 else rng.choice(texts), "clash", k))
    rng.shuffle(out)
    return [*out, *out[:3]]


def grouped(rows):
    out = defaultdict(list)
    for conv, *row in rows:
        out[conv].append(tuple(row[:3]))
    return out


def results(rows, **sizes):
    summaries, repaired = C.repair(rows, **sizes)
    digests = C.line_digests(repaired.withColumn("line", F.concat("role", F.lit(":"), "text")), ("pos", "nth"))
    out = {}
    for r in summaries.join(digests, C.GROUP, "left").collect():
        d = r.asDict()
        d["repaired_sha256"] = d["repaired_sha256"] or EMPTY
        out[None if r._none else r._conv] = {k: v for k, v in d.items() if k not in C.GROUP}
    return out, repaired


@pytest.mark.parametrize("sizes", [{}, {"segment": 5, "fan": 3}])
def test_least_repairs(spark, rows, sizes):
    got, repaired = results(spark.createDataFrame(rows, SCHEMA).repartition(5), **sizes)
    assert got == {conv: plain(r) for conv, r in grouped(rows).items()}
    if sizes.get("segment") == 5:
        order = defaultdict(list)
        for r in sorted(repaired.collect(), key=lambda r: (r.seg, r.pos, r.nth)):
            order[None if r._none else r._conv].append((r.role[:1], r.row is None, r.text))
        assert all(re.fullmatch("(s?(ua)+)?", "".join(x for x, *_ in v)) for v in order.values())
        assert all(text == "" for v in order.values() for _, made, text in v if made)


def test_no_rows_and_one_piece_after_another(spark, rows, monkeypatch):
    none = spark.createDataFrame([], SCHEMA)
    assert results(none)[0] == {}
    some = [r for r in rows if r[0] == 0]
    for piece in (0, 40):  # with 0 each piece ends with a line, the last one of a segment too
        monkeypatch.setattr(C, "PIECE", piece)
        assert results(spark.createDataFrame(some, SCHEMA), segment=50)[0] == {0: plain(grouped(some)[0])}


def test_costs_of_segments_agree_with_those_of_whole_conversations():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 12, 200)
    whole = C.costs_to_go(codes, np.array([200]), C.FINAL[None, None])[0, 0]
    parts = C.transfer(codes, np.array([70, 0, 130]))
    total = C._fold([p.ravel() for p in parts], "costs").reshape(4, 4)
    assert ((total + C.FINAL).min(1) == whole).all()


def test_op12_damages_first(spark, rows, tmp_path):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    kept = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        role, text = " " if role is None else role, " " if text is None else text
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        kept[conv]
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        kept[conv] += [(turn, "user" if code == 4 else role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    got = {r.conv_id: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in C.op12_conversation_repair(spark, str(tmp_path)).collect()}
    nothing = dict.fromkeys(("gaps", *C.FAULTS, "illegal", "cost"), 0) | {"audit": "", "repaired_sha256": EMPTY}
    assert got == {conv: plain(r) if r else nothing for conv, r in kept.items()}
