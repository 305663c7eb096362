"""N-gram Jaccard join over a count-vector R-tree.

Each text becomes a set of hashed word shingles. Texts with the same set form one class, so exact copies meet in an
aggregate and never as pairs. A class's point counts its shingles by hash group (64 to 4,096 groups, by size, each
grouping nested in the next); the sum of coordinate-wise minima of two points bounds the overlap of their sets.
Between classes:

1. A class is listed under the first |s| - ceil(t |s|) + 1 of its shingles in one fixed order (frequent shingles of a
   bounded sample last, else by hash). Two sets of Jaccard >= t share one of these; a listing without a neighbour of a
   fitting size drops out. The sample decides the order alone: any order finds every link.
2. Classes under one shingle are candidates if their points' bound allows a link. Up to CROWD classes meet as pairs;
   more go into an R-tree, packed sort-tile fashion, that is joined with itself from the root down, by the bound between
   the boxes of nodes and at last between points, and that gives only as many candidates as join all that its candidates
   join. Classes under a shingle that more than HOT have are dealt, by size and hash, to several tasks.
3. Classes that candidates join, directly or in a chain, form a unit, whose texts meet in one task. A unit of more
   than UNIT shingles is dealt in the same way. In a unit, the same R-tree join finds the pairs that survive the bound;
   they are verified on the sets, unless other links have joined them already.
4. Spanning links of all units join into components.

Defined cases: null or word-less text has 0 shingles and is its own component; fewer than n words are one shingle; a
null id gets a null component and no link; repeated rows are returned as often as they come; other columns are ignored,
whatever their names; an empty table gives an empty result. Sets are of 64-bit hashes: two different shingles of one
pair of texts collide with probability below 1e-12.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import buffers, connected_components, cut, focus, mix, small_side, steps, table, trimmed, word_hashes

#: Shingles that one unit of verification holds at most (64 MB of hashes).
UNIT = 8_000_000
#: Documents of the sample that tells frequent shingles, and shingles it may name.
SAMPLE, FREQUENT = 4096, 20_000
#: Points in a leaf, nodes in a node above; classes under one shingle that meet as pairs, and from which on they are dealt
#: to several tasks, in this many blocks at least.
LEAF, FANOUT, CROWD, HOT, SPREAD = 32, 8, 48, 2048, 4
#: Hash groups of a point, as powers of two, of sets below a size, and of larger ones: a group holds four to eight
#: shingles at most, as the bound of two sets that share nothing nears what links ask for from about twenty on. Groups by
#: which the points of two leaves are first compared, and counts that a step of the second look takes.
GROUPS, FINEST, FIRST, LOOK = ((6, 500), (8, 1_000), (10, 4_000)), 12, 256, 1 << 20
#: Integers that the counts of a point are packed as.
WIDTHS = {b"1": np.uint8, b"2": np.uint16, b"4": np.uint32}


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """The ascending distinct shingle hashes of each row."""
    out: list[np.ndarray] = []
    for i, j in steps(offsets):
        words, at = word_hashes(data, offsets[i : j + 1])
        odd = [np.uint64(k) for k in (mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1))]
        if len(words) >= n:
            full = words[: len(words) - n + 1] * odd[0]
            for k in range(1, n):
                full = full + words[k : len(words) - n + 1 + k] * odd[k]
            full = mix(full)
        else:
            full = words[:0]
        for a, b in zip(at[:-1], at[1:], strict=True):
            if b - a >= n:
                out.append(np.unique(full[a : b - n + 1]))
            elif b > a:
                short = np.array([b - a], np.uint64)
                for k in range(a, b):
                    short = mix(short * odd[0] + words[k : k + 1])
                out.append(short)
            else:
                out.append(words[:0])
    return out


def _key(s: np.ndarray) -> tuple[int, int]:
    a = mix(s + np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    b = mix(s ^ np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


def _listed(s: np.ndarray, frequent: np.ndarray, num: int, den: int) -> np.ndarray:
    """The shingles under which a set is listed."""
    k = len(s) - -(-num * len(s) // den) + 1 if len(s) else 0
    if len(frequent) and len(s):
        late = frequent[np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)] == s
        s = np.concatenate([s[~late], s[late]])
    return s[:k].view(np.int64)


def point(s: np.ndarray) -> np.ndarray:
    """Shingles by hash group; the groups are nested, so a finer point folds into a coarser one."""
    bits = next((b for b, below in GROUPS if len(s) < below), FINEST)
    return np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits).astype(np.uint32)


def fold(points: np.ndarray, groups: int) -> np.ndarray:
    return points if points.shape[-1] == groups else points.reshape(*points.shape[:-1], groups, -1).sum(-1, dtype=points.dtype)


def _packed(p: np.ndarray) -> bytes:
    width = next(w for w in WIDTHS if p.max(initial=0) <= np.iinfo(WIDTHS[w]).max)
    return p.astype(WIDTHS[width]).tobytes() + width


def _unpacked(b: bytes) -> np.ndarray:
    return np.frombuffer(b[:-1], WIDTHS[b[-1:]]).astype(np.int32)


def _signed(docs: DataFrame, id_col: str, text_col: str, n: int, frequent: list[int], num: int, den: int) -> DataFrame:
    often = np.array(sorted(frequent), np.uint64)

    def sign(batches) -> Iterator:
        import pyarrow as pa

        focus("ngram_jaccard")
        for batch in (b.slice(i, 2048) for b in batches for i in range(0, b.num_rows, 2048)):
            data, offsets = buffers(batch.column(1))
            sets = shingle_sets(data, offsets, n)
            keys = [_key(s) for s in sets]
            listed = [_listed(s, often, num, den) for s in sets]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in listed])]).astype(np.int32)
            flat = np.concatenate(listed) if listed else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array([_packed(point(s)) for s in sets], pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int64()))],
                names=["doc_id", "n", "k1", "k2", "point", "listed"],
            )

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return plain.mapInArrow(trimmed(sign), "doc_id long, n long, k1 long, k2 long, point binary, listed array<long>")


def frequent_shingles(docs: DataFrame, text_col: str, n: int) -> list[int]:
    """At most FREQUENT shingle hashes that several different texts of a sample of about SAMPLE hold."""
    total = docs.count()
    if total < 64:
        return []

    def count(batches) -> Iterator:
        import pyarrow as pa

        focus("ngram_jaccard")
        for batch in batches:
            data, offsets = buffers(batch.column(0))
            sets = {_key(s): s for s in shingle_sets(data, offsets, n)}
            flat = np.concatenate([np.zeros(0, np.uint64), *sets.values()])
            values, times = np.unique(flat, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(times, pa.int64())], names=["h", "c"])

    part = docs.select(F.col(text_col).alias("text")).sample(fraction=min(1.0, SAMPLE / total), seed=7).distinct()
    found = part.mapInArrow(trimmed(count), "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).where("c >= 5").orderBy(F.desc("c"), "h").limit(FREQUENT).collect()
    return [int(np.int64(r.h).view(np.uint64)) for r in found]


def least_overlap(a, b, num: int, den: int):
    """The least overlap of linked sets of these sizes."""
    return -(-num * (a + b) // (num + den))


class Level:
    """The nodes of one level of the tree: which rows or nodes of the level below are in each, a box of group counts that
    bounds all points inside from above, and the least and most size."""

    def __init__(self, ends: np.ndarray, high: np.ndarray, least: np.ndarray, most: np.ndarray):
        self.ends, self.high, self.least, self.most = ends, high, least, most

    def above(self, width: int) -> Level:
        starts = np.arange(0, len(self.least), width)
        return Level(np.append(starts, len(self.least)), np.maximum.reduceat(self.high, starts, axis=0), np.minimum.reduceat(self.least, starts), np.maximum.reduceat(self.most, starts))

    def meets(self, p: np.ndarray, q: np.ndarray, num: int, den: int) -> np.ndarray:
        """Which pairs of nodes may hold a link, by sizes and by the sum of coordinate-wise minima of their boxes."""
        near = (self.least[p] * num <= self.most[q] * den) & (self.least[q] * num <= self.most[p] * den)
        at = np.flatnonzero(near)
        near[at] = np.minimum(self.high[p[at]], self.high[q[at]]).sum(1) >= least_overlap(self.least[p[at]], self.least[q[at]], num, den)
        return near


def tree_join(size: np.ndarray, points: list[np.ndarray], apart, visit, num: int, den: int) -> None:
    """Join an R-tree of points with itself, from its root down: visit(i, j) for each pair that the bound lets pass while
    apart(rows of one leaf, rows of another) still holds for it."""
    order = np.argsort(size, kind="stable")
    order = order[size[order] > 0]
    if not len(order):
        return
    leaves = range(0, len(order), LEAF)
    if len(leaves) > 2:  # sort-tile: slabs by size, and by the first half of the groups within a slab
        slab = LEAF * max(1, int(np.sqrt(len(leaves))))
        half = np.array([p[: len(p) // 2].sum() for p in points])[order]
        order = order[np.concatenate([s + np.argsort(half[s : s + slab], kind="stable") for s in range(0, len(order), slab)])]
    rows = [order[s : s + LEAF] for s in leaves]
    groups = [min(len(points[i]) for i in r) for r in rows]
    inside = [np.stack([fold(points[i], g) for i in r]) for r, g in zip(rows, groups, strict=True)]
    levels = [Level(np.append(np.array(leaves), len(order)), np.stack([fold(x.max(0), 64) for x in inside]), np.array([size[r].min() for r in rows]), np.array([size[r].max() for r in rows]))]
    while len(levels[-1].least) > FANOUT:
        levels.append(levels[-1].above(FANOUT))
    n = len(levels[-1].least)
    p, q = np.triu_indices(n)
    for below, level in zip([*levels[-2::-1], None], levels[::-1], strict=True):
        near = level.meets(p, q, num, den)
        p, q = p[near], q[near]
        if below is None:
            break
        pairs = []
        for i, j in zip(p, q, strict=True):  # the children of nodes that meet
            x, y = np.meshgrid(np.arange(level.ends[i], level.ends[i + 1]), np.arange(level.ends[j], level.ends[j + 1]), indexing="ij")
            keep = x <= y
            pairs.append((x[keep], y[keep]))
        p, q = (np.concatenate([np.zeros(0, np.int64), *(k[side] for k in pairs)]) for side in (0, 1))
    for p, q in zip(p, q, strict=True):
        open_ = apart(rows[p], rows[q])
        if p == q:
            open_ &= np.arange(len(rows[p]))[:, None] < np.arange(len(rows[p]))[None, :]
        if not open_.any():
            continue
        g = min(groups[p], groups[q], FIRST)
        over = np.minimum(fold(inside[p], g)[:, None, :], fold(inside[q], g)[None, :, :]).sum(2)
        x, y = np.nonzero(open_ & (over >= least_overlap(size[rows[p]][:, None], size[rows[q]][None, :], num, den)))
        if len(x) and (g := min(groups[p], groups[q])) > FIRST:
            left, right = fold(inside[p], g), fold(inside[q], g)
            over = np.concatenate([np.minimum(left[x[k : k + LOOK // g]], right[y[k : k + LOOK // g]]).sum(1) for k in range(0, len(x), LOOK // g)])
            near = over >= least_overlap(size[rows[p][x]], size[rows[q][y]], num, den)
            x, y = x[near], y[near]
        for i, j in zip(rows[p][x], rows[q][y], strict=True):
            visit(int(i), int(j))


class Joined:
    """Which of n rows are joined."""

    def __init__(self, n: int):
        self.root = list(range(n))
        self.links: list[tuple[int, int]] = []

    def find(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        if a != b:
            self.root[max(a, b)] = min(a, b)
            self.links.append((i, j))

    def apart(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return np.array([self.find(i) for i in p])[:, None] != np.array([self.find(i) for i in q])[None, :]


def across(left: np.ndarray, right: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Which pairs have one row in left and one in right."""
    return (left[p][:, None] & right[q][None, :]) | (right[p][:, None] & left[q][None, :])


def unit_links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Spanning links between the sets of a unit: pairs (i, j) of Jaccard >= num/den, one in left and one in right, that
    are enough to join all that such pairs join."""
    held = Joined(len(sets))

    def verify(i: int, j: int) -> None:
        if held.find(i) == held.find(j):
            return
        x, y = sets[i], sets[j]
        at = np.searchsorted(y, x)
        shared = int((y[np.minimum(at, len(y) - 1)] == x).sum())
        if den * shared >= num * (len(x) + len(y) - shared):
            held.join(i, j)

    def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return held.apart(p, q) & across(left, right, p, q)

    tree_join(np.array([len(s) for s in sets], np.int64), [point(s).astype(np.int32) for s in sets], apart, verify, num, den)
    return held.links


def deal(rows: DataFrame, key: str, weight: Column, most: int, num: int, den: int) -> DataFrame:
    """rows (key, n, ...) of keys too heavy for one task, dealt to units (key, u1, u2, side) that hold all pairs of rows
    whose sizes n can link: cells of like size, cut by hash into blocks of about `most` (a key into SPREAD at least), and
    every block with those of its own cell and of the next. side: 0 the only block, 1 and 2 the first and the second one."""
    ratio = float(np.log(den / num) * (1 + 1e-9)) if den > num else 1e-9
    rows = rows.withColumn("cell", F.floor(F.log(F.col("n").cast("double")) / F.lit(ratio)))
    cells = rows.groupBy(key, "cell").agg(F.sum(weight).alias("w"))
    share = F.least(F.lit(float(most)), F.sum("w").over(W.partitionBy(key)) / SPREAD)  # a key has few cells
    cells = cells.select(key, "cell", F.ceil(F.col("w") / share).cast("int").alias("blocks"))
    cells = table(cells, "cells")
    near = cells
    for name, step in (("before", 1), ("after", -1)):
        near = near.join(cells.select(key, (F.col("cell") + step).alias("cell"), F.col("blocks").alias(name)), [key, "cell"], "left")
    met = rows.join(small_side(near), [key, "cell"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    name = lambda cell, block: F.struct(cell.alias("cell"), block.alias("block"))
    mine = name(F.col("cell"), F.col("block"))
    unit = lambda a, b, side: F.struct(a.alias("u1"), b.alias("u2"), side.cast("int").alias("side"))
    some = lambda n, f: F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), f))
    own = some(F.col("blocks"), lambda k: unit(name(F.col("cell"), F.least(F.col("block"), k)), name(F.col("cell"), F.greatest(F.col("block"), k)), F.when(F.col("block") == k, 0).when(F.col("block") < k, 1).otherwise(2)))
    before = some(F.col("before"), lambda k: unit(name(F.col("cell") - 1, k), mine, F.lit(2)))
    after = some(F.col("after"), lambda k: unit(mine, name(F.col("cell") + 1, k), F.lit(1)))
    none = F.array().cast("array<struct<u1:struct<cell:bigint,block:int>,u2:struct<cell:bigint,block:int>,side:int>>")
    every = met.withColumn("unit", F.explode(F.concat(own, F.coalesce(before, none), F.coalesce(after, none))))
    number = lambda u: F.col(f"unit.{u}.cell") * (1 << 31) + F.col(f"unit.{u}.block")
    return every.withColumns({"u1": number("u1"), "u2": number("u2"), "side": F.col("unit.side")}).drop("unit", "blocks", "before", "after", "block", "cell")


def _crowd_candidates(num: int, den: int):
    """For rows (tok, u1, u2, side, rep, n, point) that come by unit: enough candidate pairs (a, b) of each unit."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        focus("ngram_jaccard")
        held: list = []
        now = None

        def pairs():
            found, side = Joined(len(held)), np.array([h[0] for h in held])
            left, right = side != 2, side != 1
            apart = lambda p, q: found.apart(p, q) & across(left, right, p, q)
            tree_join(np.array([h[2] for h in held], np.int64), [_unpacked(h[3]) for h in held], apart, found.join, num, den)
            return pa.RecordBatch.from_arrays([pa.array([held[i][1] for i, _ in found.links], pa.int64()), pa.array([held[j][1] for _, j in found.links], pa.int64())], names=["a", "b"])

        for batch in batches:
            for tok, u1, u2, *row in zip(*(batch.column(k).to_pylist() for k in ("tok", "u1", "u2", "side", "rep", "n", "point")), strict=True):
                if (tok, u1, u2) != now:
                    if held:
                        yield pairs()
                    held, now = [], (tok, u1, u2)
                held.append(row)
        if held:
            yield pairs()

    return run


def _pair_candidates(num: int, den: int):
    """The pairs (a, b, na, nb, pa, pb) whose points' bound allows a link."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        focus("ngram_jaccard")
        for batch in batches:
            col = batch.to_pydict()
            keep = []
            for na, nb, x, y in zip(col["na"], col["nb"], col["pa"], col["pb"], strict=True):
                x, y = _unpacked(x), _unpacked(y)
                g = min(len(x), len(y))
                keep.append(np.minimum(fold(x, g), fold(y, g)).sum() >= least_overlap(na, nb, num, den))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def candidates(classes: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): enough pairs of classes (rep, n, point, listed) that may link to join all that may link."""
    near = W.partitionBy("tok").orderBy("n", "rep")
    fits = f"n * {num} <= below * {den} or above * {num} <= n * {den}"
    rows = classes.select("rep", "n", F.explode("listed").alias("tok"))
    rows = rows.withColumns({"below": F.lag("n").over(near), "above": F.lead("n").over(near), "times": F.count("*").over(W.partitionBy("tok"))})
    met = table(rows.where(f"times > 1 and ({fits})").select("tok", "rep", "n", "times"), "jaccard-met")
    few = met.where(F.col("times") <= CROWD)
    left, right = few.selectExpr("tok", "rep as a", "n as na"), few.selectExpr("tok", "rep as b", "n as nb")
    pairs = left.join(right, "tok").where(f"a < b and na * {num} <= nb * {den} and nb * {num} <= na * {den}").select("a", "b").distinct()
    points = classes.select("rep", "n", "point")
    pairs = pairs.join(points.selectExpr("rep as a", "n as na", "point as pa"), "a").join(points.selectExpr("rep as b", "n as nb", "point as pb"), "b")
    met_pairs = pairs.select("a", "b", "na", "nb", "pa", "pb").mapInArrow(trimmed(_pair_candidates(num, den)), "a long, b long")
    crowds = met.where(F.col("times") > CROWD)
    whole = crowds.where(F.col("times") <= HOT).select("tok", "rep", "n", F.lit(0).cast("long").alias("u1"), F.lit(0).cast("long").alias("u2"), F.lit(0).alias("side"))
    hot = deal(crowds.where(F.col("times") > HOT).select("tok", "rep", "n"), "tok", F.lit(1), HOT, num, den)
    crowds = whole.unionByName(hot).join(classes.select("rep", "point"), "rep").repartition("tok", "u1", "u2").sortWithinPartitions("tok", "u1", "u2", "rep")
    return met_pairs.unionByName(crowds.select("tok", "u1", "u2", "side", "rep", "n", "point").mapInArrow(trimmed(_crowd_candidates(num, den)), "a long, b long"))


def _units(signed: DataFrame, num: int, den: int) -> DataFrame:
    """(rep, n, k1, k2, u0, u1, u2, side): the classes with a possible partner, by unit; side 0 both, 1 left, 2 right."""
    classes = signed.where("n > 0 and doc_id is not null").groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("point").alias("point"), F.first("listed").alias("listed"))
    classes = table(classes, "jaccard-classes")
    parts = connected_components(candidates(classes, num, den))
    both = parts.select(F.col("id").alias("rep"), "component").unionByName(parts.select(F.col("component").alias("rep"), "component").distinct())
    members = cut(classes.select("rep", "n", "k1", "k2").join(both, "rep"))
    weigh = members.groupBy("component").agg(F.sum("n").alias("weight"))
    fit = members.join(weigh, "component")
    zero = F.lit(0).cast("long")
    small = fit.where(F.col("weight") <= UNIT).select("rep", "n", "k1", "k2", F.col("component").alias("u0"), zero.alias("u1"), zero.alias("u2"), F.lit(0).alias("side"))
    wide = fit.where(F.col("weight") > UNIT).select("rep", "n", "k1", "k2", F.col("component").alias("u0"))
    return small.unionByName(deal(wide, "u0", F.col("n"), UNIT // 2, num, den)) if wide.head(1) else small


def ngram_jaccard_links(docs: DataFrame, signed: DataFrame, id_col: str, text_col: str, n: int, num: int, den: int) -> DataFrame:
    """Spanning links (a, b) between class representatives."""
    units = cut(_units(signed, num, den).withColumn("unit", F.xxhash64("u0", "u1", "u2")))
    plain = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("text"))
    full = plain.join(small_side(units), "rep").select("unit", "u0", "u1", "u2", "side", "rep", "n", "k1", "k2", "text")
    dealt = full.repartition("unit").sortWithinPartitions("unit", "u0", "u1", "u2", "rep")

    def verify(batches) -> Iterator:
        import pyarrow as pa

        focus("ngram_jaccard")
        held: dict = {}
        now = None

        def links():
            reps = list(held)
            sets, side = [held[r][0] for r in reps], np.array([held[r][1] for r in reps])
            got = unit_links(sets, side != 2, side != 1, num, den)
            return pa.RecordBatch.from_arrays([pa.array([reps[i] for i, _ in got], pa.int64()), pa.array([reps[j] for _, j in got], pa.int64())], names=["a", "b"])

        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            col = {k: batch.column(k).to_pylist() for k in ("u0", "u1", "u2", "side", "rep", "n", "k1", "k2")}
            for (i, j), sets in ((r, shingle_sets(data, offsets[r[0] : r[1] + 1], n)) for r in steps(offsets)):
                for k, s in zip(range(i, j), sets, strict=True):
                    unit = (col["u0"][k], col["u1"][k], col["u2"][k])
                    if unit != now:
                        if len(held) > 1:
                            yield links()
                        held, now = {}, unit
                    if len(s) == col["n"][k] and _key(s) == (col["k1"][k], col["k2"][k]):  # another text may carry the same id
                        held[col["rep"][k]] = (s, col["side"][k])
        if len(held) > 1:
            yield links()

    return dealt.mapInArrow(trimmed(verify), "a long, b long")


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs; texts link at Jaccard >= num/den of their n-word shingles."""
    frequent = frequent_shingles(docs, text_col, n)
    signed = table(_signed(docs, id_col, text_col, n, frequent, num, den), "jaccard-signed")
    links = ngram_jaccard_links(docs, signed, id_col, text_col, n, num, den)
    parts = connected_components(links)
    plain = signed.select("doc_id", "n", "k1", "k2")
    classes = plain.where("n > 0 and doc_id is not null").groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("rep"))
    classes = classes.join(parts, classes.rep == parts.id, "left").select("n", "k1", "k2", F.coalesce("component", "rep").alias("component_id"))
    out = plain.join(classes, ["n", "k1", "k2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
