"""Embedding near-duplicates by spherical-cap filters.

Filter directions are a random product code: the vector space is cut into parts, each with its own small random code,
and a direction is one code word for each part. A vector passes a filter whose cap holds it. Because scores add up over
the parts, a vector's filters are list-decoded: code words are sorted by their score in each part, and only sums that
can still reach the cap are formed. Vectors meet under the filters that they share; cosines are verified in double
precision, and a pair counts under its first shared filter alone.

Cap height and code size follow from the number of different vectors, so that a filter holds about CROWD of them and a
vector passes about PASSED; a vector that passes fewer than LEAST filters takes its LEAST best. Filters that hold more
than BLOCK rows are dealt as pairs of blocks. Vectors that are equal are one class, by aggregation.

Recall, measured against brute force in tests and in the README, is above 0.98 at cosine 0.9 and rises with the cosine.

The code's parts grow with the vectors, not its words, so a worker holds at most WORDS directions for each dimension;
rows of one block are compared by SLICE filters at a time.

Defined cases: null, empty or zero vectors and those with null or non-finite components link with nothing; vectors of
different lengths do not link; a null id links with nothing and has a null component; repeated rows are copies, each
linked with the others; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, focus, small_side, table, trimmed

#: Vectors a filter holds, filters a vector passes, and at least; rows of a block; words of a part's code at most; filters
#: that rows are compared by at a time.
CROWD, PASSED, LEAST, BLOCK, WORDS, SLICE = 96, 18, 18, 2048, 2048, 4096


class Caps:
    """The filters of one dimension for n vectors."""

    def __init__(self, dim: int, n: int, seed: int = 11):
        share = min(0.2, CROWD / max(n, 1))
        self.height = NormalDist().inv_cdf(1 - share)
        filters = max(16, PASSED / share)
        # As many parts as keep each code short (but one dimension each at least), so no code grows with the vectors.
        self.parts = min(dim, max(1 if dim < 8 else 2, math.ceil(math.log(filters) / math.log(WORDS))))
        self.words = min(WORDS, max(4, math.ceil(filters ** (1 / self.parts))))
        rng = np.random.default_rng(seed)
        self.cuts = np.linspace(0, dim, self.parts + 1).astype(int)
        self.codes = []
        for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True):
            c = rng.standard_normal((self.words, b - a))
            self.codes.append(c / np.linalg.norm(c, axis=1, keepdims=True))
        self.dim = dim

    def passed(self, unit: np.ndarray) -> list[np.ndarray]:
        """The ascending filters of each row of unit vectors."""
        scale = math.sqrt(self.dim / self.parts)
        scores = [unit[:, a:b] @ c.T * scale for a, b, c in zip(self.cuts[:-1], self.cuts[1:], self.codes, strict=True)]
        out = []
        for i in range(len(unit)):
            height = self.height
            while True:
                got = self._decode([s[i] for s in scores], height)
                if len(got) >= LEAST or len(got) == self.words**self.parts:
                    break
                height -= 0.25
            if height < self.height and len(got) > LEAST:  # fewer than LEAST passed: the LEAST best
                total = self._total([s[i] for s in scores], got)
                got = np.sort(got[np.argsort(-total, kind="stable")[:LEAST]])
            out.append(got)
        return out

    def _decode(self, scores: list[np.ndarray], height: float) -> np.ndarray:
        rest = [sum(float(s.max()) for s in scores[k + 1 :]) for k in range(len(scores))]
        ids, sums = np.zeros(1, np.int64), np.zeros(1)
        for s, best in zip(scores, rest, strict=True):
            order = np.argsort(-s)
            keep = np.searchsorted(-s[order], sums + best - height, "right")  # a prefix of the sorted words
            rows = np.repeat(np.arange(len(ids)), keep)
            cols = order[np.arange(len(rows)) - np.repeat(np.cumsum(keep) - keep, keep)]
            ids, sums = ids[rows] * self.words + cols, sums[rows] + s[cols]
        return np.sort(ids)

    def _total(self, scores: list[np.ndarray], ids: np.ndarray) -> np.ndarray:
        total = np.zeros(len(ids))
        for s in reversed(scores):
            total += s[ids % self.words]
            ids = ids // self.words
        return total


def _matrix(column) -> np.ndarray:
    """Rows of an Arrow list column whose rows have one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def vector_classes(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(rep, n, vec): the different sound vectors, with the smallest id and the number of rows of each."""
    x = F.col("vec")
    kind = vectors.schema[vec_col].dataType.simpleString()
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    sound = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    plain = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast(kind).alias("vec")).where(F.col("vec_id").isNotNull()).where(F.coalesce(sound, F.lit(False)))
    return plain.groupBy("vec").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")).select("rep", "n", "vec")


def filtered(classes: DataFrame, caps: dict[int, Caps]) -> DataFrame:
    """(rep, n, vec, passed): classes with their filters."""

    def run(batches) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        focus("cap_join")
        for batch in batches:
            lens = pc.list_value_length(batch.column(2)).to_numpy()
            for dim in np.unique(lens):
                own = batch.filter(pa.array(lens == dim))
                got = caps[int(dim)].passed(_unit(_matrix(own.column(2))))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(got, pa.list_(pa.int64()))], names=["rep", "n", "vec", "passed"])

    return classes.mapInArrow(trimmed(run), f"rep long, n long, vec {classes.schema['vec'].dataType.simpleString()}, passed array<long>")


def _verify(threshold: float):
    """For rows (unit_dim, filter, b1, b2, side, rep, n, vec, passed) that come by unit: (a, b) spanning links, and
    (a, links) the rows that a links with under its first shared filters."""

    def links_of(held: list, now: tuple) -> tuple:
        reps, count = np.array([h[0] for h in held], np.int64), np.array([h[1] for h in held], np.int64)
        side = np.array([h[4] for h in held])
        unit = _unit(np.array([h[2] for h in held], np.float64))
        earlier = [h[3][: int(np.searchsorted(h[3], now[1]))] for h in held]
        # Filters before this one that several rows pass, and which rows pass which.
        row = np.repeat(np.arange(len(held)), [len(e) for e in earlier])
        names, at, times = np.unique(np.concatenate([np.zeros(0, np.int64), *earlier]), return_inverse=True, return_counts=True)
        several = times > 1
        number = np.cumsum(several) - 1
        row, at = row[several[at]], number[at[several[at]]]
        slices = []
        for s in range(0, int(several.sum()), SLICE):
            inside = (at >= s) & (at < s + SLICE)
            slices.append((row[inside], at[inside] - s))

        def met_before(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            """Which of rows a and b share one of those filters."""
            out = np.zeros((len(a), len(b)), bool)
            for rows, cols in slices:
                passed = np.zeros((len(held), int(cols.max()) + 1), np.float32)
                passed[rows, cols] = 1
                out |= passed[a] @ passed[b].T > 0
            return out

        root = np.arange(len(held))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        total, spans = np.zeros(len(held), np.int64), []
        left, right = (np.flatnonzero(side != 2), np.flatnonzero(side != 1))
        for s in range(0, len(left), 512):
            a = left[s : s + 512]
            near = unit[a] @ unit[right].T >= threshold
            near &= reps[a][:, None] != reps[right][None, :]
            x, y = np.nonzero(near)
            if not len(x):
                continue
            fresh = near & ~met_before(a, right)
            total[a] += fresh @ count[right]
            if now[2] != now[3]:
                total[right] += fresh.T @ count[a]
            for i, j in zip(a[x], right[y], strict=True):
                p, q = find(int(i)), find(int(j))
                if p != q:
                    root[max(p, q)] = min(p, q)
                    spans.append((int(reps[i]), int(reps[j])))
        return reps, total, spans

    def run(batches) -> Iterator:
        import pyarrow as pa

        focus("cap_join")
        held: list = []
        now = None

        def close():
            reps, total, spans = links_of(held, now)
            some = np.flatnonzero(total)
            a = [x for x, _ in spans] + reps[some].tolist()
            b = [y for _, y in spans] + [None] * len(some)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([0] * len(spans) + total[some].tolist(), pa.int64())], names=["a", "b", "links"])

        for batch in batches:
            units = list(zip(*(batch.column(k).to_pylist() for k in ("dim", "filter", "b1", "b2")), strict=True))
            rep, n, side = (batch.column(k).to_pylist() for k in ("rep", "n", "side"))
            vec, passed = batch.column("vec"), batch.column("passed")
            v, vo = vec.values.to_numpy(zero_copy_only=False), vec.offsets.to_numpy()
            p, po = passed.values.to_numpy(zero_copy_only=False), passed.offsets.to_numpy()
            for k, unit in enumerate(units):
                if unit != now:
                    if len(held) > 1:
                        yield close()
                    held, now = [], unit
                held.append((rep[k], n[k], v[vo[k] : vo[k + 1]], p[po[k] : po[k + 1]], side[k]))
        if len(held) > 1:
            yield close()

    return run


def cap_links(classes: DataFrame, threshold: float) -> DataFrame:
    """(a, b) spanning links between classes, and (a, null, links) counts of the rows that a class links with."""
    dims = {r.d: r.n for r in classes.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n")).collect()}  # a row a length
    caps = {d: Caps(d, n) for d, n in dims.items()}
    found = table(filtered(classes, caps), "caps-passed")
    rows = found.select(F.size("vec").alias("dim"), F.explode("passed").alias("filter"), "rep", "n", "vec", "passed")
    crowds = rows.groupBy("dim", "filter").agg(F.count("*").alias("rows")).where("rows > 1")
    crowds = table(crowds.select("dim", "filter", F.ceil(F.col("rows") / BLOCK).cast("int").alias("blocks")), "caps-crowds")
    rows = rows.join(small_side(crowds), ["dim", "filter"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    sides = F.when(F.col("blocks") == 1, F.array(F.struct(F.lit(0).alias("b1"), F.lit(0).alias("b2"), F.lit(0).alias("side")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(F.col("block"), k).alias("b1"), F.greatest(F.col("block"), k).alias("b2"), F.when(F.col("block") == k, 0).when(F.col("block") < k, 1).otherwise(2).alias("side")))
    )
    dealt = rows.withColumn("s", F.explode(sides)).select("dim", "filter", "s.b1", "s.b2", "s.side", "rep", "n", "vec", "passed")
    dealt = dealt.repartition("dim", "filter", "b1", "b2").sortWithinPartitions("dim", "filter", "b1", "b2")
    return dealt.mapInArrow(trimmed(_verify(threshold)), "a long, b long, links long")


def cap_join(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of vectors."""
    classes = table(vector_classes(vectors, id_col, vec_col), "caps-classes")
    found = table(cap_links(classes, threshold), "caps-links")
    parts = connected_components(found.where("b is not null").select("a", "b"))
    counts = found.where("b is null").groupBy("a").agg(F.sum("links").alias("links"))
    told = classes.join(parts, classes.rep == parts.id, "left").join(counts, classes.rep == counts.a, "left")
    told = told.select(F.col("vec").alias("c_vec"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("c_links"), F.coalesce("component", "rep").alias("c_component"))
    plain = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast(classes.schema["vec"].dataType).alias("vec"))
    # A null id or unsound vector meets no class: classes hold none.
    out = plain.join(told, (F.col("vec") == F.col("c_vec")) & F.col("vec_id").isNotNull(), "left")
    component = F.coalesce("c_component", "vec_id")
    return out.select("vec_id", F.coalesce("c_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
