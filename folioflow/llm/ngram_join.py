"""Similarity join of word-shingle sets: a packed R-tree over vectors of shingle counts, and sets that verify."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import components, discard, kept_ids, map_without_ids, numbered, positions, saved, table
from folioflow.llm.words import Words, blocks, mix

#: Documents and shingles of one page of the tree, which a task holds with one other page.
UNIT_ROWS, UNIT_SHINGLES = 1024, 1 << 19
#: Signatures in one bucket of the exchange, on average.
BUCKET = 1 << 19
#: Groups of the vectors from which the corners of pages are made.
CORNERS = 16
FANOUT = 16
#: Groupings that are tried one after the other for sets that leave too many groups empty.
GROUPINGS = 8


# Sets and vectors of one block of texts


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted hashes of each text's shingles of `size` lower-cased words; shorter texts are one shingle."""
    words = Words(texts, lower=True)
    hashes = words.hashes()
    at, shingles = words.windows(hashes, size)
    edges = np.searchsorted(at, words.first)
    out = []
    for i in range(len(texts)):
        n = words.first[i + 1] - words.first[i]
        if n >= size:
            out.append(np.unique(shingles[edges[i] : edges[i + 1]]))
        else:
            h = hashes[words.first[i] : words.first[i + 1]]
            out.append(mix(np.cumsum(mix(h + np.arange(n, dtype=np.uint64), 5), dtype=np.uint64)[-1:], int(n)))
    return out


def groups_of(n: int) -> int:
    """Groups into which a set of n shingles is counted: a power of two, about n / 8."""
    return 1 << int(np.clip(np.ceil(np.log2(max(n, 1) / 8)), 4, 12))


def count_vector(hashes: np.ndarray, groups: int) -> np.ndarray:
    return np.bincount((hashes & np.uint64(groups - 1)).astype(np.int64), minlength=groups)


def packed_vector(hashes: np.ndarray) -> bytes:
    """Counts in about n / 2 groups, in 1, 2 or 4 bytes each, as the largest needs."""
    v = count_vector(hashes, 4 * groups_of(len(hashes)))
    return v.astype(np.min_scalar_type(int(v.max()))).tobytes()


def unpacked_vector(packed: bytes, n: int) -> np.ndarray:
    width = len(packed) // (4 * groups_of(n))
    v = np.frombuffer(packed, {1: np.uint8, 2: np.uint16, 4: np.uint32}[width])
    return v.astype(np.int32 if width < 4 else np.int64)  # the sum of two bytes' counts in all groups fits


def _need(a, b, percent: int):
    """The least intersection of sets of sizes a and b whose Jaccard similarity is percent / 100 or more."""
    return -((-percent * (a + b)) // (100 + percent))


# The R-tree over count vectors


class CountTree:
    """A packed R-tree. Of a node's points it keeps the largest count in every group and the least size."""

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray, height: int) -> None:
        tops = np.argsort(-vectors.astype(np.int32), axis=1, kind="stable")[:, :3] if vectors.shape[1] > 2 else vectors
        self.order = np.lexsort((*tops.T[::-1], sizes))  # near sets have near sizes and the same large groups
        upper, least, most = vectors[self.order].astype(np.int32), sizes[self.order], sizes[self.order]
        self.levels = [(upper, least, most)]
        for _ in range(height):
            at = np.arange(0, len(upper), FANOUT)
            upper = np.maximum.reduceat(upper, at, axis=0)
            least, most = np.minimum.reduceat(least, at), np.maximum.reduceat(most, at)
            self.levels.append((upper, least, most))


def tree_join(va: np.ndarray, na: np.ndarray, vb: np.ndarray, nb: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of points whose summed coordinate minima leave room for the similarity.

    Both trees are descended together; a pair of nodes goes on if the minima of their upper corners add up to the
    intersection that their smallest sets would need, and if their sizes can agree.
    """
    if not len(na) or not len(nb):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    height = int(np.ceil(np.log(max(len(na), len(nb), 2)) / np.log(FANOUT)))
    a, b = CountTree(va, na, height), CountTree(vb, nb, height)
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(a.levels[-1][1])), np.arange(len(b.levels[-1][1])), indexing="ij"))
    for level in range(height, -1, -1):
        (ua, la, ma), (ub, lb, mb) = a.levels[level], b.levels[level]
        keep = (la[i] * percent <= mb[j] * 100) & (lb[j] * percent <= ma[i] * 100)
        i, j = i[keep], j[keep]
        step, passed = max(1, (4 << 20) // ua.shape[1]), []
        for s in range(0, len(i), step):
            x, y = i[s : s + step], j[s : s + step]
            passed.append(np.minimum(ua[x], ub[y]).sum(1) >= _need(la[x], lb[y], percent))
        on = np.concatenate(passed) if passed else np.zeros(0, bool)
        i, j = i[on], j[on]
        if level:
            wide, below = np.arange(FANOUT), (len(a.levels[level - 1][1]), len(b.levels[level - 1][1]))
            i = np.repeat((i[:, None] * FANOUT + wide), FANOUT, axis=1).ravel()
            j = np.tile((j[:, None] * FANOUT + wide), (1, FANOUT)).ravel()
            real = (i < below[0]) & (j < below[1])
            i, j = i[real], j[real]
    return a.order[i], b.order[j]


def bounded_pairs(vectors: list[np.ndarray], sizes: np.ndarray, side: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that the bound leaves: between side 0 and side 1, or where all are on one side, among them."""
    width = np.array([len(v) for v in vectors])
    wider = 1 << max(1, int(np.ceil(np.log2(100 / percent))))  # sizes differ by at most 100 / percent
    cross, out_a, out_b = side.any() and not side.all(), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for g in np.unique(width):
        at_g, above = np.flatnonzero(width == g), np.flatnonzero((width > g) & (width <= wider * g))
        fold = {k: vectors[k] for k in at_g} | {k: vectors[k].reshape(-1, g).sum(0) for k in above}
        near = np.r_[at_g, above]
        if cross:
            jobs = [(at_g[side[at_g] == 0], near[side[near] == 1]), (at_g[side[at_g] == 1], above[side[above] == 0])]
        else:
            jobs = [(at_g, near)]
        for left, right in jobs:
            if len(left) and len(right):
                i, j = tree_join(np.stack([fold[k] for k in left]), sizes[left], np.stack([fold[k] for k in right]), sizes[right], percent)
                a, b = left[i], right[j]
                on = a != b if cross else (a < b) | (width[b] > g)
                out_a.append(a[on])
                out_b.append(b[on])
    return np.concatenate(out_a), np.concatenate(out_b)


# Signatures of groups: which sets can be similar at all

#: Size classes, each half as wide again as the one before.
STARTS = [1]
while STARTS[-1] < 1 << 40:
    STARTS.append(max(STARTS[-1] + 1, -(-STARTS[-1] * 3 // 2)))
STARTS = np.array(STARTS, np.int64)


def class_groups(kind: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of size classes: the most elements in which two similar sets differ, the larger of the class; the groups that
    shingles are dealt into; and how many of them may be empty."""
    differ = 2 * (STARTS[kind + 1] - 1) * (100 - percent) // (100 + percent)
    spare = 1 + differ // 8
    return differ, differ + 1 + spare, spare


def signatures(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, signature): two different sets whose similarity is percent / 100 or more share a signature.

    The larger set's size class says into how many groups the shingles of both are dealt. The sets differ in so few
    elements that more groups agree than may be empty, so they agree in a group that holds something, and the
    signature of a group is a hash of what it holds. A set that leaves more groups empty is dealt anew by another
    grouping too, as then both of such a pair are; after the last grouping empty groups have signatures as well.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    low = np.searchsorted(STARTS, np.maximum(sizes, 1), "right") - 1
    high = np.searchsorted(STARTS, np.maximum(sizes * 100 // percent, 1), "right") - 1
    owners, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    mixed = mix(flat, 30)
    for up in range(int((high - low).max(initial=0)) + 1):
        kind = low + up
        differ, groups, spare = class_groups(kind, percent)
        rows = np.flatnonzero((sizes > 0) & (kind <= high) & (differ > 0))
        for grouping in range(GROUPINGS):
            if not len(rows):
                break
            chosen = np.zeros(len(sets), bool)
            chosen[rows] = True
            at = np.repeat(chosen, sizes)
            h, e = flat[at], mixed[at]
            start = np.r_[0, np.cumsum(groups[rows])]
            owner = np.repeat(np.arange(len(rows)), sizes[rows])
            cell = start[owner] + (mix(h, 40 + grouping) % groups[rows][owner].astype(np.uint64)).astype(np.int64)
            total = int(start[-1])
            n = np.bincount(cell, minlength=total)
            # sums modulo 2**64 in two exact halves
            parts = [np.bincount(cell, weights=(e >> np.uint64(s)) & np.uint64(0xFFFFFFFF), minlength=total).astype(np.uint64) for s in (0, 32)]
            cell_row = np.repeat(np.arange(len(rows)), groups[rows])
            place = (np.arange(total) - start[cell_row]).astype(np.uint64)
            named = mix(place + (kind[rows][cell_row].astype(np.uint64) << np.uint64(44)), 50 + grouping)
            value = mix(parts[0] + mix(parts[1] + named, 51), 52)
            empty = np.bincount(cell_row[n == 0], minlength=len(rows))
            bad = empty > spare[rows]
            last = grouping == GROUPINGS - 1
            on = (n > 0) | (bad[cell_row] if last else False)
            owners.append(rows[cell_row[on]])
            found.append(value[on])
            rows = rows[bad]
    return np.concatenate(owners), np.concatenate(found)


# Tasks


def _profile(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Of each text: set size and fingerprint."""
    for batch in blocks(batches):
        sets = shingle_sets(batch.column("text"), size)
        n = np.array([len(s) for s in sets], np.int64)
        f1 = np.array([mix(s, 11).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
        f2 = np.array([np.bitwise_xor.reduce(mix(s, 12)) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n), pa.array(f1), pa.array(f2)], ["id", "n", "f1", "f2"])


SIGNED = "bucket int, keys binary, ids binary, many binary, key long, node long, n long, vec binary, corner array<int>"


def _signed(batches: Iterator[pa.RecordBatch], size: int, percent: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Three kinds of rows: signatures packed by bucket; signatures that documents of a block share (key, node), as of
    those only the smallest id goes to the bucket, so that no bucket gets more than a row per block and signature; and
    the documents' vectors (node, n, vec, corner)."""
    types = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32())]
    names = [x.split()[0] for x in SIGNED.split(", ")]

    def rows(**columns: pa.Array) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(n, t) for c, t in zip(names, types, strict=True)], names)

    for batch in blocks(batches):
        sets = shingle_sets(batch.column("text"), size)
        ids = batch.column("id").to_numpy()
        some = [i for i, s in enumerate(sets) if len(s)]
        if not some:
            continue
        corner = np.concatenate([count_vector(sets[i], CORNERS) for i in some]).astype(np.int32)
        corner = pa.ListArray.from_arrays(np.arange(0, len(corner) + 1, CORNERS, dtype=np.int32), pa.array(corner))
        vec = pa.array([packed_vector(sets[i]) for i in some], pa.binary())
        yield rows(node=pa.array(ids[some]), n=pa.array([len(sets[i]) for i in some]), vec=vec, corner=corner)
        owner, value = signatures(sets, percent)
        if not len(value):
            continue
        ids = ids[owner]
        order = np.lexsort((ids, value))
        ids, value = ids[order], value[order]
        first = np.ones(len(value), bool)
        first[1:] = value[1:] != value[:-1]
        many = np.r_[~first[1:], False]
        key = (value >> np.uint64(32 - bits)).view(np.int64)  # the bucket, then 32 bits
        asks = (key[first] >> 32).astype(np.int32)
        at = np.r_[0, np.flatnonzero(np.diff(asks)) + 1]
        keys, nodes, more = ([x.tobytes() for x in np.split(v[first], at[1:])] for v in (key.astype(np.uint32), ids, many.astype(np.uint8)))
        yield rows(bucket=pa.array(asks[at]), keys=pa.array(keys, pa.binary()), ids=pa.array(nodes, pa.binary()), many=pa.array(more, pa.binary()))
        yield rows(key=pa.array(key[~first]), node=pa.array(ids[~first]))


def _hubs(rows: pa.Table) -> pa.Table:
    """Of one bucket: (hub, node) for ids that share a signature with a smaller one, the smallest of which is the hub;
    and (key, hub) for signatures that blocks have more ids of."""
    k, ids, many = (np.frombuffer(b"".join(x.as_buffer() for x in rows[c]), t) for c, t in (("keys", np.uint32), ("ids", np.int64), ("many", np.uint8)))
    order = np.lexsort((ids, k))
    k, ids, many = k[order], ids[order], many[order]
    at = np.r_[0, np.flatnonzero(np.diff(k)) + 1]
    hub = np.repeat(ids[at], np.diff(np.r_[at, len(k)]))
    some = np.flatnonzero(np.maximum.reduceat(many, at))
    keys = (np.int64(rows["bucket"][0].as_py()) << 32) | k[at[some]].astype(np.int64)
    on = ids != hub
    pairs, times = np.unique(np.stack([hub[on], ids[on]]), axis=1, return_counts=True)
    a, b = len(keys), len(times)
    return pa.table(
        {
            "key": pa.concat_arrays([pa.array(keys), pa.nulls(b, pa.int64())]),
            "hub": pa.array(np.r_[ids[at[some]], pairs[0]]),
            "node": pa.concat_arrays([pa.nulls(a, pa.int64()), pa.array(pairs[1])]),
            "shared": pa.array(np.r_[np.zeros(a, np.int64), times]),
        }
    )


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches):
        sets = [s.tobytes() for s in shingle_sets(batch.column("text"), size)]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sets, pa.binary())], ["node", "set"])


def _parts(rows: pa.Table, *keys: str) -> Iterator[np.ndarray]:
    """The rows of each unit of work that shares this task."""
    by = [rows[c].to_numpy() for c in keys]
    order = np.lexsort((rows["node"].to_numpy(), *by[::-1]))
    change = np.zeros(len(order), bool)
    change[1:] = np.any([c[order][1:] != c[order][:-1] for c in by], axis=0)
    yield from np.split(order, np.flatnonzero(change))


def _near_hub(rows: pa.Table, percent: int) -> pa.Table:
    """Members of each hub that the bound leaves."""
    nodes, hubs, n, vec, out = rows["node"].to_numpy(), rows["hub"].to_numpy(), rows["n"].to_numpy(), rows["vec"].to_pylist(), []
    for part in _parts(rows, "hub", "cut"):
        side = (nodes[part] != hubs[part]).astype(np.int64)
        a, b = bounded_pairs([unpacked_vector(vec[k], n[k]) for k in part], n[part], side, percent)
        out.append(part[np.unique(np.r_[a, b])])
    at = np.concatenate(out) if out else np.zeros(0, np.int64)
    at = at[nodes[at] != hubs[at]]
    return pa.table({"hub": pa.array(hubs[at], pa.int64()), "node": pa.array(nodes[at], pa.int64())})


def _starred(rows: pa.Table, percent: int) -> pa.Table:
    """Links between hubs and members, verified."""
    nodes, hubs, packed, out = rows["node"].to_numpy(), rows["hub"].to_numpy(), rows["set"].to_pylist(), []
    for part in _parts(rows, "hub", "cut"):
        hub = int(hubs[part[0]])
        own, others = part[nodes[part] == hub], part[nodes[part] != hub]
        if len(own) and len(others):
            h = np.frombuffer(packed[own[0]], np.uint64)
            sizes = np.array([len(packed[k]) // 8 for k in others])
            flat = np.frombuffer(b"".join([packed[k] for k in others]), np.uint64)
            same = h[np.minimum(np.searchsorted(h, flat), len(h) - 1)] == flat
            both = np.add.reduceat(same.astype(np.int64), np.r_[0, np.cumsum(sizes)[:-1]])
            out.append(np.stack([np.full(len(others), hub), nodes[others]])[:, both >= _need(len(h), sizes, percent)])
    a, b = np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


PAIRED = "hub long, x int, y int, node long, component long, side boolean, n long"


def _promising(rows: pa.Table, percent: int) -> pa.Table:
    """The documents of each two pages that the bound leaves a partner in another component."""
    n, vec, known, side = rows["n"].to_numpy(), rows["vec"].to_pylist(), rows["component"].to_numpy(), rows["side"].to_numpy()
    found = [np.zeros(0, np.int64)]
    for part in _parts(rows, "hub", "x", "y"):
        a, b = bounded_pairs([unpacked_vector(vec[k], n[k]) for k in part], n[part], side[part].astype(np.int64), percent)
        on = known[part[a]] != known[part[b]]
        found.append(part[np.unique(np.r_[a[on], b[on]])])
    return rows.select([x.split()[0] for x in PAIRED.split(", ")]).take(pa.array(np.concatenate(found)))


def _linked(rows: pa.Table, percent: int) -> pa.Table:
    """Verified links of each two pages between documents that nothing connects yet."""
    nodes, packed, known, links = rows["node"].to_numpy(), rows["set"].to_pylist(), rows["component"].to_numpy(), []
    side = rows["side"].to_numpy()
    for part in _parts(rows, "hub", "x", "y"):
        sets = [np.frombuffer(packed[k], np.uint64) for k in part]
        sizes = np.array([len(s) for s in sets])
        vectors = [count_vector(s, 4 * groups_of(len(s))).astype(np.int32) for s in sets]
        i, j = bounded_pairs(vectors, sizes, side[part].astype(np.int64), percent)
        _, first, which = np.unique(known[part], return_index=True, return_inverse=True)
        up = first[which].tolist()  # documents of one component start as one

        def top(k: int, up: list[int] = up) -> int:
            while up[k] != k:
                up[k] = up[up[k]]
                k = up[k]
            return k

        close = np.argsort(np.abs(sizes[i] - sizes[j]) - sizes[i] - sizes[j], kind="stable")
        as_set: dict[int, set] = {}
        for a, b in zip(i[close].tolist(), j[close].tolist(), strict=True):
            if top(a) != top(b):
                x, y = (as_set.get(k) or as_set.setdefault(k, set(sets[k].tolist())) for k in (a, b))
                if len(x & y) >= _need(len(x), len(y), percent):
                    up[top(a)] = top(b)
                    links.append((nodes[part[a]], nodes[part[b]]))
    a, b = (np.array([x[k] for x in links], np.int64) for k in (0, 1))
    return pa.table({"a": a, "b": b})


# The job


def _slots(units: DataFrame, weight: str) -> int:
    """Groups into which units of work are dealt, so that a group holds about UNIT_SHINGLES shingles, whatever the input."""
    return max(32, int((units.agg(F.sum(weight)).first()[0] or 0) // UNIT_SHINGLES) + 1)


def _star_units(pairs: DataFrame) -> DataFrame:
    """(hub, node, n) in units of work (slot, hub, cut): a hub's members are cut into blocks by weight, and each gets
    the hub itself as a row too."""
    whole = pairs.groupBy("hub").agg(F.ceil(F.greatest(F.sum("n") / UNIT_SHINGLES, F.count(F.lit(1)) / UNIT_ROWS)).cast("int").alias("cuts"))
    members = pairs.join(whole, "hub").select("hub", "node", F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int").alias("cut"))
    hubs = whole.select("hub", F.col("hub").alias("node"), F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut"))
    return members.unionByName(hubs).withColumn("slot", F.pmod(F.xxhash64("hub", "cut"), F.lit(_slots(pairs, "n"))))


def _sets_of(source: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """The sets of the documents that `nodes` names."""
    wanted = saved(nodes.select(F.col("node").alias("id")).distinct(), "wanted")
    out = saved(kept_ids(source.select("id", "text"), wanted, "id").mapInArrow(lambda it: _sets(it, size), "node long, set binary"), "sets")
    discard(wanted)
    return out


def _stars(members: DataFrame, vectors: DataFrame, source: DataFrame, size: int, percent: int) -> DataFrame:
    """Verified links of documents with the hub of most of their signatures; the bound goes first."""
    best = members.groupBy("node").agg(F.max_by("hub", F.struct("shared", -F.col("hub"))).alias("hub"))
    best = saved(best.join(vectors.select("node", "n"), "node"), "best")
    bounded = _star_units(best).join(vectors.select("node", "n", "vec"), "node").groupBy("slot").applyInArrow(lambda t: _near_hub(t, percent), "hub long, node long")
    near = saved(bounded.join(vectors.select("node", "n"), "node"), "near")
    sets = _sets_of(source, near.select(F.explode(F.array("hub", "node")).alias("node")), size)
    units = _star_units(near).join(sets, "node").groupBy("slot")
    out = saved(units.applyInArrow(lambda t: _starred(t, percent), "a long, b long"), "stars")
    discard(best, near, sets)
    return out


def _pages(members: DataFrame, linked: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The hubs' groups that more than one component is left in, in pages of the tree: (hub, page, node, component),
    and the corners of the pages.

    Near sets have near sizes and the same large groups, so documents go by size band, largest groups and size.
    """
    every = members.select("hub", "node").unionByName(members.select("hub", F.col("hub").alias("node")).distinct())
    every = every.join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = every.groupBy("hub").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a != b").select("hub")
    left = every.join(mixed, "hub").join(vectors.select("node", "n", "corner"), "node")
    tops = F.transform(F.slice(F.array_sort(F.transform("corner", lambda c, i: F.struct((-c).alias("c"), i.alias("i")))), 1, 2), lambda x: x["i"])
    order = left.withColumns({"_band": F.floor(F.log("n") * 4), "_tops": F.array_join(tops.cast("array<string>"), ",")})
    order = order.withColumn("w", F.greatest(F.col("n"), F.lit(UNIT_SHINGLES // UNIT_ROWS)).cast("long"))
    placed = positions(order, ["hub", "_band", "_tops", "n", "node"], group=["hub"], amount="w")
    paged = saved(placed.withColumn("page", F.expr(f"cast(before div {UNIT_SHINGLES} as int)")).select("hub", "page", "node", "component", "n", "w", "corner"), "paged")
    corners = paged.groupBy("hub", "page").agg(
        F.min("n").alias("least"), F.max("n").alias("most"), F.min("component").alias("a"), F.max("component").alias("b"), F.sum("w").alias("w"),
        F.array(*[F.max(F.get("corner", F.lit(k))) for k in range(CORNERS)]).alias("upper"),
    )
    return paged, saved(corners, "corners")


def _page_pairs(corners: DataFrame, percent: int) -> DataFrame:
    """Pairs of pages of one hub whose sizes can agree and whose corners' summed minima leave room for the similarity."""
    x, y = (corners.select("hub", *[F.col(c).alias(f"{c}_{s}") for c in ("page", "least", "most", "a", "b", "w", "upper")]) for s in "xy")
    room = F.aggregate(F.zip_with("upper_x", "upper_y", lambda p, q: F.least(p, q)), F.lit(0).cast("int"), lambda t, v: t + v)
    return x.join(y, "hub").where(
        (F.col("page_x") <= F.col("page_y"))
        & (F.col("least_x") * percent <= F.col("most_y") * 100) & (F.col("least_y") * percent <= F.col("most_x") * 100)
        & (room * (100 + percent) >= (F.col("least_x") + F.col("least_y")) * percent)
        & ~((F.col("a_x") == F.col("b_x")) & (F.col("a_y") == F.col("b_y")) & (F.col("a_x") == F.col("a_y")))
    ).select("hub", F.col("page_x").alias("x"), F.col("page_y").alias("y"), (F.col("w_x") + F.col("w_y")).alias("w"))


def _joined(members: DataFrame, linked: DataFrame, vectors: DataFrame, source: DataFrame, size: int, percent: int) -> DataFrame:
    """Verified links inside hubs' groups between what `linked` leaves in different components."""
    paged, corners = _pages(members, linked, vectors)
    pairs = saved(_page_pairs(corners, percent), "page-pairs")
    slot = F.pmod(F.xxhash64("hub", "x", "y"), F.lit(_slots(pairs, "w"))).alias("slot")
    ends = pairs.select("hub", "x", "y", F.explode(F.when(F.col("x") == F.col("y"), F.array("x")).otherwise(F.array("x", "y"))).alias("page"))
    units = ends.join(paged.select("hub", "page", "node", "component"), ["hub", "page"])
    units = units.select("hub", "x", "y", "node", "component", (F.col("page") != F.col("x")).alias("side"))
    bounded = units.join(vectors.select("node", "n", "vec"), "node").select("*", slot).groupBy("slot")
    left = saved(bounded.applyInArrow(lambda t: _promising(t, percent), PAIRED), "promising")
    sets = _sets_of(source, left, size)
    slot = F.pmod(F.xxhash64("hub", "x", "y"), F.lit(_slots(left, "n"))).alias("slot")
    links = left.drop("n").join(sets, "node").select("*", slot).groupBy("slot").applyInArrow(lambda t: _linked(t, percent), "a long, b long")
    links = saved(links, "links")
    discard(paged, corners, pairs, left, sets)
    return links


def shingle_components(source: DataFrame, size: int, percent: int) -> DataFrame:
    """(id, n_shingles, component) of rows (id, text) whose ids differ; see `similar_groups`."""
    source = source.select("id", "text")
    profile = saved(source.mapInArrow(lambda it: _profile(it, size), "id long, n long, f1 long, f2 long"), "profiles")
    classes = profile.where("n > 0").groupBy("n", "f1", "f2").agg(F.min("id").alias("low"))
    marked = saved(profile.join(classes, ["n", "f1", "f2"], "left").select("id", "n", "low"), "classes")
    discard(profile)
    copies = marked.where("id != low or n = 0").select("id")
    total = marked.where("id = low").agg(F.sum("n")).first()[0] or 0
    bits = max(6, int(np.ceil(np.log2(max(1, total * 4 * (100 - percent) / (100 + percent) / BUCKET)))))
    signed = saved(map_without_ids(source, copies, "id", lambda it: _signed(it, size, percent, bits), SIGNED), "signatures")
    buckets = signed.where("bucket is not null").select("bucket", "keys", "ids", "many").groupBy("bucket")
    hubs = saved(buckets.applyInArrow(_hubs, "key long, hub long, node long, shared long"), "hubs")
    more = signed.where("key is not null").select("key", "node").join(hubs.where("node is null").select("key", "hub"), "key").where("node != hub")
    pairs = hubs.where("node is not null").select("hub", "node", "shared").unionByName(more.select("hub", "node", F.lit(1).cast("long").alias("shared")))
    members = saved(pairs.groupBy("hub", "node").agg(F.sum("shared").alias("shared")), "members")
    named = members.select(F.explode(F.array("hub", "node")).alias("node")).distinct()
    vectors = saved(signed.where("vec is not null").select("node", "n", "vec", "corner").join(named, "node"), "vectors")
    discard(signed, hubs)
    stars = _stars(members, vectors, source, size, percent)
    links = _joined(members, components(stars), vectors, source, size, percent)
    discard(members, vectors)
    joined = components(stars.unionByName(links))
    out = marked.join(joined.withColumnRenamed("node", "low"), "low", "left")
    return out.select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "low", "id").alias("component"))


def similar_groups(
    docs: DataFrame, size: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Set sizes and connected components of the join of shingle sets with Jaccard similarity >= percent / 100.

    Equal sets form classes by a 128-bit fingerprint; one document of each goes on. Sets that differ in few elements
    hold the same in some group of shingles, so signatures of groups say which documents can be similar: those that
    share one with the smallest id that has it are that hub's members. Sets count as vectors of shingle counts per group
    of hash values; the minima of two vectors, summed, bound the overlap. First each document meets the hub of most of
    its signatures. What this leaves in more than one component of a hub's group is the R-tree's: in tree order the
    group forms pages, the bound on the pages' upper corners decides which pages meet, and in a task the tree goes on
    down to documents. Whole sets move only for documents that the bound leaves a partner, and verify it. Pairs inside
    a component aren't verified; no component loses a member.

    Returns id, n_shingles, component_id (the smallest id reachable, itself included). A text without words or null
    has no shingles and no links; shorter texts than `size` words are one shingle. Ids are integers. Each row is a
    document of its own: null ids count as larger than all others and come back as null, and rows that repeat an id
    link like other rows. An empty table gives no rows; other columns are not read. Below 80 a set
    has more signatures than shingles, so small percentages cost much.
    """
    if size < 1 or not 0 < percent <= 100:
        raise ValueError("size must be positive, percent in 1..100")
    source, _, given = numbered(docs, id_col, text_col)
    return given(shingle_components(source, size, percent), id=id_col, component="component_id")


def op6_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under Jaccard similarity of 4-word shingles of at least 0.85."""
    return similar_groups(table(spark, sf_dir, "documents"))
