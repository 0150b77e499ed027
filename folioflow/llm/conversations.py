"""Conversation structure repair: the cheapest edits, of equal ones the least audit, by prefix-doubling path ranking."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import positions, saved, table

#: States between rows: nothing put out yet, after a system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Codes of rows: kinds of roles, plus TRUNCATED for a cut sentence, or MUST_GO for blank and repeated rows.
KINDS, TRUNCATED, MUST_GO = "suao", 4, 8
KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1
LETTERS = np.frombuffer(b"DIKR", np.uint8)
NEVER = 1 << 40
#: Where Keep leads from each state for each kind of role, and Rerole or Insert from each state; -1 for nowhere.
KEPT = np.array([[SYSTEM, -1, -1, -1], [USER, USER, -1, USER], [-1, -1, ASSISTANT, -1], [-1, -1, -1, -1]])
MADE = np.array([USER, USER, ASSISTANT, USER])
#: Edits that may follow the last row: an answer is whole after an assistant row, or when nothing is put out.
FINAL = np.array([0, INSERT + INSERT, INSERT, 0])
#: Rows of one segment, segments (or groups of them) of one group, and bytes of one piece of a repaired text.
SEGMENT, FAN, PIECE = 4096, 4096, 1 << 20
GROUP = ["_none", "_conv"]
KEYS = [*GROUP, "seg", "last_seg"]
FAULTS = ("blank", "duplicate", "truncated")
#: Neighbours that may be: su, ua, au.
LEGAL = np.zeros((4, 4), bool)
LEGAL[[0, 1, 2], [1, 2, 1]] = True


def _closed(costs: np.ndarray) -> np.ndarray:
    """Costs between two rows when rows may be inserted there."""
    out = costs.copy()
    out[..., USER] = np.minimum(costs[..., USER], INSERT + costs[..., ASSISTANT])
    out[..., ASSISTANT] = np.minimum(costs[..., ASSISTANT], INSERT + costs[..., USER])
    for state in (START, SYSTEM):
        out[..., state] = np.minimum(costs[..., state], INSERT + out[..., USER])
    return np.minimum(out, NEVER)


def _row_arcs(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows: costs and next states of Delete, Keep and Rerole from each state, (rows, 4 states, 3 edits)."""
    kind, cut = codes % 4, np.where(codes & TRUNCATED, CUT, 0)[:, None]
    to = np.stack([np.broadcast_to(np.arange(4), (len(codes), 4)), KEPT[kind], np.broadcast_to(MADE, (len(codes), 4))], 2)
    cost = np.stack([np.full((len(codes), 4), DELETE), cut + np.zeros((1, 4), int) + KEEP, cut + np.zeros((1, 4), int) + REROLE], 2)
    gone = np.zeros(cost.shape, bool)
    gone[..., 1:] = (codes >= MUST_GO)[:, None, None]
    return np.where(gone | (to < 0), NEVER, cost), np.maximum(to, 0)


def _first_nodes(n: np.ndarray) -> np.ndarray:
    """Where the places of each segment begin: it has one before each row and one after the last."""
    return np.cumsum(n + 1) - n - 1


def costs_to_go(codes: np.ndarray, n: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Least costs from each place of each segment and state, (places, vectors, 4), given the costs at its end (segments,
    vectors, 4). All segments go one row back at a time, the longest first."""
    first, rows = _first_nodes(n), np.cumsum(n) - n
    out = np.zeros((int((n + 1).sum()), *ends.shape[1:]), np.int64)
    out[first + n] = ends
    cost, to = _row_arcs(codes)
    order = np.argsort(-n, kind="stable")
    longest, alive = n[order], len(n)
    for back in range(1, int(n.max(initial=0)) + 1):
        alive = int(np.searchsorted(-longest[:alive], -back, "right"))
        s = order[:alive]
        row, place = rows[s] + n[s] - back, first[s] + n[s] - back
        after = out[place + 1]
        best = np.full(after.shape, NEVER)
        for edit in range(3):
            moved = np.take_along_axis(after, np.broadcast_to(to[row, :, edit][:, None], after.shape), 2)
            best = np.minimum(best, moved + cost[row, :, edit][:, None])
        out[place] = _closed(best)
    return out


def transfer(codes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """(segments, 4, 4): the least cost from each state at a segment's start to each state at its end."""
    ends = np.broadcast_to(np.where(np.eye(4, dtype=bool), 0, NEVER), (len(n), 4, 4))
    return np.swapaxes(costs_to_go(codes, n, ends)[_first_nodes(n)], 1, 2)


class Paths:
    """The optimal arcs of segments and their doubled pointers. Node 4 p + s is state s at place p."""

    def __init__(self, codes: np.ndarray, n: np.ndarray, ends: np.ndarray, final: np.ndarray) -> None:
        """Rows may be inserted after the last one of a `final` segment; after others the next segment does that."""
        self.n, self.first = n, _first_nodes(n)
        costs = costs_to_go(codes, n, ends[:, None])[:, 0]
        size = costs.size
        place = np.arange(len(costs))
        last = np.zeros(len(costs), bool)
        last[self.first + n] = True
        row = place - np.repeat(np.arange(len(n)), n + 1)
        cost, to = np.full((len(costs), 4, 3), NEVER), np.zeros((len(costs), 4, 3), np.int64)
        cost[~last], to[~last] = (v[row[~last]] for v in _row_arcs(codes))
        insert = np.full((len(costs), 4), INSERT)
        insert[(self.first + n)[~final]] = NEVER
        target = 4 * np.minimum(place + 1, len(costs) - 1)[:, None, None] + to
        flat = costs.ravel()
        # letters in the order of ASCII: Delete, Insert, Keep, Rerole
        every = np.stack([target[..., 0], 4 * place[:, None] + MADE, target[..., 1], target[..., 2]], 2).reshape(size, 4)
        price = np.stack([cost[..., 0], insert, cost[..., 1], cost[..., 2]], 2).reshape(size, 4)
        best = (flat[every] + price == flat[:, None]) & (flat < NEVER)[:, None]
        self.costs = costs
        # ranks of the least audits of 1, 2, 4, ... letters; a place where an audit ends comes before all letters
        letter = np.where(best.any(1), best.argmax(1), -1)
        stay = np.arange(size)
        jump = np.where(letter >= 0, every[stay, np.maximum(letter, 0)], stay)
        rank, self.jumps = letter + 1, []
        while True:
            self.jumps.append(jump)
            further = jump[jump]
            if (further == jump).all():
                break
            _, rank = np.unique(rank * (size + 1) + rank[jump], return_inverse=True)
            jump = further
        # of the optimal arcs of a node the one with the least letter and then the least audit after it
        after = np.where(best, np.arange(4) * (size + 1) + rank[every], 5 * (size + 1))
        self.edit = np.where(letter >= 0, after.argmin(1), -1)
        if (self.edit != letter).any():
            raise AssertionError("two optimal edits of a node have one letter")

    def exits(self) -> np.ndarray:
        """(segments, 4): the state at the end of the least path from each state at the start."""
        return self.jumps[-1][4 * self.first[:, None] + np.arange(4)] % 4

    def walk(self, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(segment, node) of the least paths from the given states in order, by all sums of doubled pointers."""
        node, segment, step = 4 * self.first + entry, np.arange(len(self.n)), np.zeros(len(self.n), np.int64)
        for k in range(len(self.jumps) - 1, -1, -1):
            to = self.jumps[k][node]
            go = self.edit[to] >= 0
            node, segment, step = np.r_[node, to[go]], np.r_[segment, segment[go]], np.r_[step, step[go] + (1 << k)]
        going = self.edit[node] >= 0
        node, segment, step = node[going], segment[going], step[going]
        order = np.lexsort((step, segment))
        return segment[order], node[order]


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 1 << 15) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Segments of some 2**15 rows together, with their codes and sizes."""
    for batch in batches:
        if batch.num_rows:
            n = np.diff(batch.column("codes").offsets.to_numpy())
            edges = np.flatnonzero(np.diff(np.cumsum(n) // rows)) + 1
            for a, b in zip([0, *edges], [*edges, batch.num_rows], strict=True):
                part = batch.slice(a, b - a)
                yield part, part.column("codes").flatten().to_numpy().astype(np.int64), n[a:b].astype(np.int64)


def _fixed(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return batch.column(column).flatten().to_numpy().reshape(batch.num_rows, -1)


def _ends(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return _fixed(batch, "ends"), batch.column("seg").to_numpy() == batch.column("last_seg").to_numpy()


def _answers(batches: Iterator[pa.RecordBatch], make: Callable[..., np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Keys of segments with the numbers that `make` has for each."""
    for batch, codes, n in _slices(batches):
        values = make(batch, codes, n).reshape(len(n), -1).astype(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * values.shape[1]), pa.array(values.ravel()))
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in (*GROUP, "seg")], lists], [*GROUP, "seg", "v"])


def _plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each segment's part of the audit, and of its rows those that stay or have rows inserted beside them: role is ""
    for a row that keeps its own and null for a deleted one."""
    for batch, codes, n in _slices(batches):
        paths, entry = Paths(codes, n, *_ends(batch)), batch.column("entry").to_numpy().astype(np.int64)
        segment, node = paths.walk(entry)
        edit = paths.edit[node]
        letters, bounds = LETTERS[edit].tobytes().decode(), np.searchsorted(segment, np.arange(len(n) + 1))
        at, number = node // 4 - paths.first[segment], np.cumsum(n) - n
        ids = batch.column("rows").flatten().to_numpy()
        out = {k: [] for k in ("audit", "row", "before", "role", "after")}
        for s in range(len(n)):
            a, b = bounds[s], bounds[s + 1]
            plan, waiting = [], []
            for x, place, e in zip((node[a:b] % 4).tolist(), at[a:b].tolist(), edit[a:b].tolist(), strict=True):
                made = "user" if MADE[x] == USER else "assistant"
                if e == 1:
                    waiting.append(made)
                elif e or waiting:
                    plan.append([int(ids[number[s] + place]), waiting, "" if e == 2 else made if e == 3 else None, []])
                    waiting = []
            if waiting and not plan:
                plan.append([int(ids[number[s] + n[s] - 1]), [], None, []])
            if waiting:
                plan[-1][3] = waiting
            out["audit"].append(letters[a:b])
            for k, name in enumerate(("row", "before", "role", "after")):
                out[name].append([p[k] for p in plan])
        # kinds of neighbours, the last row's with what the next segment begins with
        kind = codes % 4
        after = np.full(len(codes), -1)
        after[:-1] = kind[1:]
        after[number + n - 1] = batch.column("next").fill_null(-1).to_numpy()
        illegal = np.add.reduceat((after >= 0) & ~LEGAL[kind, after], number)
        kinds = {"row": pa.int64(), "before": pa.list_(pa.string()), "role": pa.string(), "after": pa.list_(pa.string())}
        fields = [pa.array(out["audit"], pa.string()), pa.array(paths.costs[paths.first, entry]), pa.array(illegal, pa.int64()), *[pa.array(out[k], pa.list_(t)) for k, t in kinds.items()]]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in KEYS], *fields], [*KEYS, "audit", "cost", "illegal", *kinds])


def _keys(df: DataFrame, *names: str) -> str:
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)


def _fold(values: list[np.ndarray], kind: str) -> np.ndarray:
    """Of consecutive segments: their costs from state to state, or where their least paths lead."""
    out = values[0].reshape(4, 4) if kind == "costs" else values[0]
    for v in values[1:]:
        out = np.minimum((out[:, :, None] + v.reshape(4, 4)[None]).min(1), NEVER) if kind == "costs" else v[out]
    return out.ravel()


def _tree(leaves: DataFrame, kind: str, fan: int) -> list[DataFrame]:
    """Segments' numbers, then those of up to `fan` segments together, and so on until a conversation is one."""
    levels = [leaves]

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seg")
        return rows[[*GROUP, "parent"]].head(1).rename(columns={"parent": "seg"}).assign(v=[_fold(list(rows["v"]), kind)])

    while (levels[-1].agg(F.max("seg")).first()[0] or 0) > 0:
        parts = levels[-1].withColumn("parent", F.expr(f"seg div {fan}")).groupBy(*GROUP, "parent")
        levels.append(saved(parts.applyInPandas(fold, f"{_keys(leaves, *GROUP)}, seg long, v array<long>"), kind))
    return levels


def _spread(levels: list[DataFrame], top: list[int], kind: str, fan: int) -> DataFrame:
    """From the top of a tree down: for each segment the costs at its end, or the state at its start, as w."""

    def spread(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seg", ascending=kind != "costs")
        now, out = rows["up"].iloc[0], []
        for v in rows["v"]:
            out.append(now)
            now = np.minimum((v.reshape(4, 4) + now[None]).min(1), NEVER) if kind == "costs" else v[now]
        return rows[[*GROUP, "seg"]].assign(w=out)

    found = levels[-1].select(*GROUP, "seg", F.array(*[F.lit(x).cast("long") for x in top]).alias("w"))
    for level in levels[-2::-1]:
        above = found.select(*GROUP, F.col("seg").alias("parent"), F.col("w").alias("up"))
        parts = level.withColumn("parent", F.expr(f"seg div {fan}")).join(above, [*GROUP, "parent"]).groupBy(*GROUP, "parent")
        found = saved(parts.applyInPandas(spread, f"{_keys(level, *GROUP)}, seg long, w array<long>"), kind)
    return found


def _with_ends(segments: DataFrame, fan: int) -> DataFrame:
    """Segments with the costs at their ends and the state at their starts. Those of one segment know both; the others
    learn the costs from right to left and then the states from left to right, by trees over their segments."""
    final = F.array(*[F.lit(int(x)).cast("long") for x in FINAL])
    short = segments.where("last_seg = 0").withColumns({"ends": final, "entry": F.lit(START)})
    if not segments.where("last_seg > 0").limit(1).count():
        return short
    long, schema = segments.where("last_seg > 0"), f"{_keys(segments, *GROUP)}, seg long, v array<long>"
    costs = saved(long.mapInArrow(lambda it: _answers(it, lambda batch, codes, n: transfer(codes, n)), schema), "costs")
    ends = _spread(_tree(costs, "costs", fan), FINAL.tolist(), "costs", fan)
    ended = saved(long.join(ends.withColumnRenamed("w", "ends"), [*GROUP, "seg"]), "ended")
    exits = saved(ended.mapInArrow(lambda it: _answers(it, lambda batch, codes, n: Paths(codes, n, *_ends(batch)).exits()), schema), "exits")
    entries = _spread(_tree(exits, "states", fan), [START], "states", fan)
    whole = ended.join(entries.select(*GROUP, "seg", F.col("w")[0].cast("int").alias("entry")), [*GROUP, "seg"])
    return short.unionByName(whole.select(short.columns))


def _faults(base: DataFrame) -> DataFrame:
    """Rows in order with their first fault, without texts."""
    light = base.select(*GROUP, "_turn", "_role", "_row", F.md5("_text").alias("_digest"), F.rtrim("_text", F.lit(" \t\n\x0b\x0c\r")).alias("_end"))
    light = light.withColumns({
        "_blank": F.col("_end") == "", "_cut": ~F.substring("_end", -1, 1).isin(".", "!", "?"), "_numbered": F.col("_turn").isNotNull(),
    }).drop("_end")
    placed = saved(positions(light, [*GROUP, "_numbered", "_turn", "_role", "_digest", "_row"], GROUP), "placed")
    first = placed.groupBy(*GROUP, "_role", "_digest").agg(F.min("pos").alias("pos")).select(*GROUP, "pos", F.lit(True).alias("_first"))
    fault = F.when(F.col("_blank"), "blank").when(F.col("_first").isNull(), "duplicate").when(F.col("_cut"), "truncated")
    kind = F.coalesce(F.expr(f"nullif(instr('{KINDS[:3]}', substring(_role, 1, 1)), 0)") - 1, F.lit(3))
    named = placed.join(first, [*GROUP, "pos"], "left").withColumns({"fault": fault, "kind": F.when(F.col("_role") == "", 3).otherwise(kind)})
    code = F.col("kind") + F.when(F.col("fault") == "truncated", TRUNCATED).when(F.col("fault").isNotNull(), MUST_GO).otherwise(0)
    return saved(named.select(*GROUP, "pos", "_turn", "_row", "fault", "kind", code.cast("int").alias("code")), "faults")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of lines in order: the digest of a conversation that is one segment, and the joined lines of other segments in
    pieces; of pieces in order (they have a null last_seg) the digests of conversations. Nothing else is kept."""
    key, sha, lines, size, part = None, None, [], 0, 0

    def out(whole: str | None, piece: str | None):
        none, conv, seg, last = key
        columns = [[none], [conv], [seg], [last], [part], [piece], [whole]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)

    def done() -> Iterator[pa.RecordBatch]:
        """What is left of the current key; nothing after a piece that ended with its last line."""
        if key is not None and key[3] in (0, None):
            yield out(sha.hexdigest(), None)
        elif lines:
            yield out(None, "\n".join(lines))

    for batch in batches:
        kinds = pa.schema([*[batch.schema.field(c) for c in KEYS], ("part", pa.int32()), ("piece", pa.string()), ("repaired_sha256", pa.string())])
        for *now, line in zip(*[batch.column(c).to_pylist() for c in (*KEYS, "line")], strict=True):
            now[2] = now[2] if now[3] is not None else None
            if now != key:
                yield from done()
                key, sha, lines, size, part = now, hashlib.sha256(), [], 0, 0
                if now[3] in (0, None):
                    sha.update(line.encode())
                    continue
            if now[3] in (0, None):
                sha.update(b"\n" + line.encode())
                continue
            lines.append(line)
            size += len(line)
            if size > PIECE:
                yield from done()
                lines, size, part = [], 0, part + 1
    yield from done()


def repair(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    segment: int = SEGMENT, fan: int = FAN,
) -> tuple[DataFrame, DataFrame]:
    """Repair conversations so that the initials of their roles are `(s?(ua)+)?`, at the least cost.

    Rows of a conversation are taken by turn, null turns first; equal turns by role and the text's MD5. A row's first
    fault counts: blank text, role and text of an earlier row, or a last character that ends no sentence. Edits are Keep
    (0), Rerole to user or assistant (2), Delete (3, required for blank and repeated rows), and Insert of an empty user
    or assistant row (2); a cut sentence that stays costs 1. Of the cheapest edits those with the ASCII-least audit, the
    initials of the edits in order, are taken.

    Conversations are cut into segments of `segment` rows, so one may be of any length: costs to go run from right to
    left over all segments at once; arcs that keep the costs optimal are ranked by their least audits of 1, 2, 4, ...
    letters, and doubled pointers give the paths. Segments of long conversations learn the costs at their ends and the
    states at their starts by trees of `fan` segments each. No task holds more than a segment, a group of `fan` segments,
    or a block of these.

    Returns two tables. Summaries, a row for each conversation that has rows: gaps (turns missing between the least and
    the largest), blank, duplicate, truncated, illegal (neighbours whose initials are not su, ua or au), cost and audit.
    Repaired rows: the conversation, seg, last_seg, pos and nth (their order), role, text and row, the original's number
    or null for inserted ones. Conversations are named by _none and _conv: a null id is a conversation of its own. Null
    turns count for no gaps; null roles and texts are one space; an empty table gives no rows; other columns aren't read.
    """
    kind = rows.schema[conv_col].dataType
    named = rows.select(
        F.col(conv_col).isNull().alias("_none"), F.coalesce(conv_col, F.lit("0").cast(kind)).alias("_conv"), F.col(turn_col).alias("_turn"),
        F.coalesce(role_col, F.lit(" ")).alias("_role"), F.coalesce(text_col, F.lit(" ")).alias("_text"), F.monotonically_increasing_id().alias("_row"),
    )
    base = saved(named, "turns")
    faults = _faults(base)
    # a segment also gets the kind of the row after it
    seg, before = F.expr(f"pos div {segment}").alias("seg"), F.expr(f"pos div {segment} - 1").alias("seg")
    parts = faults.select(*GROUP, seg, F.struct("pos", "code", "_row").alias("r"), F.lit(None).cast("int").alias("next")).unionByName(
        faults.where(f"pos > 0 and pos % {segment} = 0").select(*GROUP, before, F.lit(None).cast("struct<pos:bigint,code:int,_row:bigint>").alias("r"), F.expr("code % 4").alias("next"))
    )
    lists = parts.groupBy(*GROUP, "seg").agg(F.array_sort(F.collect_list("r")).alias("l"), F.max("next").alias("next"))
    last = faults.groupBy(*GROUP).agg(
        F.expr(f"max(pos) div {segment}").alias("last_seg"), *[F.count_if(F.col("fault") == f).alias(f) for f in FAULTS],
        F.coalesce(F.max("_turn") - F.min("_turn") + 1 - F.count_distinct("_turn"), F.lit(0)).cast("long").alias("gaps"),
    )
    segments = lists.join(last.select(*GROUP, "last_seg"), GROUP).select(*KEYS, "next", F.col("l.code").alias("codes"), F.col("l._row").alias("rows"))
    ready = _with_ends(saved(segments, "segments"), fan)
    strings = "array<string>"
    plan = saved(ready.mapInArrow(_plan, f"{_keys(ready, *KEYS)}, audit string, cost long, illegal long, row array<long>, before array<{strings}>, role array<string>, after array<{strings}>"), "plans")
    whole = plan.groupBy(*GROUP).agg(
        F.max(F.when(F.col("seg") == 0, F.col("cost"))).alias("cost"), F.sum("illegal").alias("illegal"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg", "audit"))), lambda x: x.audit), "").alias("audit"),
    )
    summaries = last.join(whole, GROUP).select(*GROUP, "gaps", *FAULTS, "illegal", "cost", "audit")
    steps = plan.select(*KEYS, F.posexplode(F.arrays_zip("row", "before", "role", "after")).alias("pos", "s")).select(*KEYS, "pos", "s.*")
    made = steps.join(base.select("_row", "_role", "_text"), F.col("row") == F.col("_row"))
    inserted = [F.transform(c, lambda r: F.struct(r.alias("role"), F.lit("").alias("text"), F.lit(None).cast("long").alias("row"))) for c in ("before", "after")]
    own = F.struct(F.when(F.col("role") == "", F.col("_role")).otherwise(F.col("role")).alias("role"), F.col("_text").alias("text"), "row")
    stays = F.when(F.col("role").isNotNull(), F.array(own)).otherwise(F.array().cast("array<struct<role:string,text:string,row:bigint>>"))
    repaired = made.select(*KEYS, "pos", F.posexplode(F.concat(inserted[0], stays, inserted[1])).alias("nth", "r")).select(*KEYS, "pos", "nth", "r.*")
    return summaries, repaired


def line_digests(lines: DataFrame, order: Sequence[str]) -> DataFrame:
    """SHA-256 of each conversation's lines (column `line`), joined by line feeds, in order.

    Rows are dealt by segment. Conversations of one segment are digested there; of longer ones the segments are joined to
    pieces of about 1 MB, which one task per conversation reads in order and drops, as a digest of a whole text has no
    parallel form: it holds one piece, whatever the conversation's length.
    """
    schema = f"{_keys(lines, *KEYS)}, part int, piece string, repaired_sha256 string"
    dealt = lines.select(*KEYS, *order, "line").repartition(*GROUP, "seg").sortWithinPartitions(*GROUP, "seg", *order)
    first = saved(dealt.mapInArrow(_digests, schema), "pieces")
    again = first.where("piece is not null").select(*GROUP, "seg", F.lit(None).cast("long").alias("last_seg"), "part", F.col("piece").alias("line"))
    second = again.repartition(*GROUP).sortWithinPartitions(*GROUP, "seg", "part").drop("part").mapInArrow(_digests, schema)
    return first.where("piece is null").unionByName(second).select(*GROUP, "repaired_sha256")


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with a quarter of their rows damaged by a checksum of id and turn: dropped, emptied, cut short,
    repeated, or said by the user."""
    name = F.concat(*[x for c, sep in (("conv_id", ":"), ("turn", "")) for x in (F.coalesce(F.col(c).cast("string"), F.lit(" ")), F.lit(sep))])
    code = F.crc32(name) % 20
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), code.alias("code")).where("code != 0")
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    changed = rows.select("conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("code") == 3, 2).otherwise(1).alias("times"))
    return changed.withColumn("_", F.explode(F.sequence(F.lit(1), "times"))).drop("_", "times")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged, and what repairs them at the least cost."""
    given = table(spark, sf_dir, "conversations")
    summaries, repaired = repair(damaged(given))
    digests = line_digests(repaired.withColumn("line", F.concat("role", F.lit(":"), "text")), ("pos", "nth"))
    ids = given.select(F.col("conv_id").isNull().alias("_none"), F.coalesce("conv_id", F.lit(0)).alias("_conv")).distinct()
    counts = ("gaps", *FAULTS, "illegal", "cost")
    return ids.join(summaries, GROUP, "left").join(digests, GROUP, "left").select(
        F.when(~F.col("_none"), F.col("_conv")).alias("conv_id"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
