"""Exact top-k search by inner product: one dual tree over rows and queries.

The top of the tree is the frontier of a cover tree over a bounded sample; every
row and every query belongs to the leaf of its nearest centre, and the covering
radius of a leaf is taken over all its rows (of a query group, over all its
queries). Each query group first meets a block of its own leaf. A leaf whose
radii allow no product above the group's worst k-th score is then pruned, before
any row moves. What is left meets in tasks: both sides get a cover tree of their
own there, and the two are walked together with the same test.

Where the space has no structure (radii near the norms) nothing can be pruned
and exact search costs queries times rows; a row is then copied once for
``part`` queries, a query once for ``block`` rows. No task holds more than these.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, small, written

LEAF = 128
_LOW = np.iinfo(np.int64).min
_NONE = np.iinfo(np.int64).max
#: Leaves are numbered within their dimension.
_LEAVES = 1 << 16


class CoverTree:
    """A cover tree over integer vectors: the children of a node are centres that
    cover its points within the node's radius over ``base``, more than that
    distance apart from each other; ``radius`` is the exact covering radius.

    Nodes hold ranges of a permutation of the points, so leaves are slices.
    """

    def __init__(self, x: np.ndarray, base: float = 1.5, leaf: int = LEAF):
        self.x, self.leaf = x, leaf
        self.norm2 = np.einsum("ij,ij->i", x, x)
        self.order = np.arange(len(x))
        self.center: list[int] = []
        self.radius: list[float] = []
        self.span: list[tuple[int, int]] = []
        self.children: list[list[int]] = []
        self.base = base
        if len(x):
            mean = x.mean(axis=0)
            self._node(int(np.argmin(((x - mean) ** 2).sum(axis=1))), 0, len(x))

    def _far(self, c: int, points: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.norm2[points] + self.norm2[c] - 2 * (self.x[points] @ self.x[c]), 0))

    def _node(self, center: int, lo: int, hi: int) -> int:
        me = len(self.center)
        points = self.order[lo:hi]
        far = self._far(center, points)
        radius = float(far.max())
        self.center.append(center)
        self.radius.append(radius)
        self.span.append((lo, hi))
        self.children.append([])
        if hi - lo <= self.leaf or radius == 0:
            return me
        #: greedy cover: the node's centre first, then any point left uncovered
        cover, owner, c = radius / self.base, np.full(hi - lo, -1), center
        centers, best = [], np.full(hi - lo, np.inf)
        while True:
            d = far if not centers else self._far(c, points)
            closer = (d <= cover) & (d < best)
            owner[closer], best[closer] = len(centers), d[closer]
            centers.append(c)
            left = np.flatnonzero(owner < 0)
            if not left.size:
                break
            c = int(points[left[0]])
        sort = np.argsort(owner, kind="stable")
        self.order[lo:hi] = points[sort]
        cuts = lo + np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(centers)))))
        small: list[tuple[int, int]] = []
        for k, c in enumerate(centers):
            a, b = int(cuts[k]), int(cuts[k + 1])
            if b - a > self.leaf:
                self._merge(me, small)
                small = []
                self.children[me].append(self._node(c, a, b))
            elif b > a:
                small.append((a, b))
        self._merge(me, small)
        return me

    def _merge(self, parent: int, small: list[tuple[int, int]]) -> None:
        """Neighbouring small children become leaves of up to ``leaf`` points."""
        at = 0
        while at < len(small):
            lo, hi = small[at]
            at += 1
            while at < len(small) and small[at][1] - lo <= self.leaf:
                hi = small[at][1]
                at += 1
            points = self.order[lo:hi]
            mean = self.x[points].mean(axis=0)
            c = int(points[np.argmin(((self.x[points] - mean) ** 2).sum(axis=1))])
            self.children[parent].append(len(self.center))
            self.center.append(c)
            self.radius.append(float(self._far(c, points).max()))
            self.span.append((lo, hi))
            self.children.append([])


def frontier(x: np.ndarray, most: int) -> np.ndarray:
    """Centres of up to ``most`` nodes of a cover tree over the points, the widest
    nodes opened first."""
    t = CoverTree(x.astype(np.float64), leaf=4)
    done, nodes = [], [0]
    while nodes:
        nodes.sort(key=lambda i: t.radius[i])
        wide = nodes.pop()
        if t.children[wide] and len(done) + len(nodes) + len(t.children[wide]) <= most:
            nodes += t.children[wide]
        else:
            done.append(wide)
    return x[np.unique([t.center[i] for i in done])]


def products(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Exact inner products of integer vectors; beyond the range of a long they are
    clipped to its ends."""
    if not q.size or not r.size:
        return np.zeros((len(q), len(r)), np.int64)
    if float(np.abs(q.astype(np.float64)).max()) * float(np.abs(r.astype(np.float64)).max()) * q.shape[1] < 2.0**53:
        return (q.astype(np.float64) @ r.astype(np.float64).T).astype(np.int64)
    return np.clip(q.astype(object) @ r.T.astype(object), _LOW + 1, _NONE).astype(np.int64)


def most(center, radius, norm, centers, radii, norms) -> np.ndarray:
    """The largest product that points within the radii of two centres can have, by
    Cauchy-Schwarz: <q, r> <= <cq, cr> + Rq |cr| + Rr |cq| + Rq Rr."""
    x = centers @ center + radius * norms + radii * norm + radius * radii
    return x + 1 + 1e-9 * np.abs(x)


def dual_search(qx: np.ndarray, qrow: np.ndarray, rx: np.ndarray, rrow: np.ndarray, rid: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The k best (score, id) of each query among the rows, _LOW where fewer; ``floor``
    holds scores that a result must reach. Ties go to the smaller id; a query's
    own row is no candidate."""
    score, found = np.full((len(qx), k), _LOW), np.full((len(qx), k), _NONE)
    if not len(qx) or not len(rx):
        return score, found
    qf, rf = qx.astype(np.float64), rx.astype(np.float64)
    qt, rt = CoverTree(qf), CoverTree(rf)
    qn, rn = np.sqrt(qt.norm2), np.sqrt(rt.norm2)
    radii = np.array(rt.radius)

    def bound(a: int, bs: list[int]) -> np.ndarray:
        cb, ca = [rt.center[b] for b in bs], qt.center[a]
        return most(qf[ca], qt.radius[a], qn[ca], rf[cb], radii[bs], rn[cb])

    stack = [(0, 0)]
    while stack:
        a, b = stack.pop()
        points = qt.order[slice(*qt.span[a])]
        if bound(a, [b])[0] < np.maximum(score[points, -1], floor[points]).min():
            continue
        split_q, split_r = qt.children[a], rt.children[b]
        if split_r and (not split_q or rt.radius[b] >= qt.radius[a]):
            #: the most promising node is popped first
            stack += [(a, split_r[i]) for i in np.argsort(bound(a, split_r), kind="stable")]
        elif split_q:
            stack += [(c, b) for c in split_q]
        else:
            rows = rt.order[slice(*rt.span[b])]
            s = products(qx[points], rx[rows])
            s[qrow[points][:, None] == rrow[rows][None, :]] = _LOW
            news = (s >= np.maximum(np.maximum(score[points, -1], floor[points]), _LOW + 1)[:, None]).any(axis=1)
            if news.any():
                points, s = points[news], s[news]
                ids = np.where(s == _LOW, _NONE, rid[rows][None, :])
                alls, alli = np.concatenate([score[points], s], axis=1), np.concatenate([found[points], ids], axis=1)
                pick = np.lexsort((alli, ~alls), axis=1)[:, :k]
                score[points], found[points] = np.take_along_axis(alls, pick, 1), np.take_along_axis(alli, pick, 1)
    return score, found


def quantise(vectors: DataFrame, column: str = "embedding", scale: int = 256) -> DataFrame:
    """vec_id and floor(scale * x) of each component, as long (clipped to its range);
    vectors that are null, empty or hold a null or a non-finite component, and
    rows without id, are left out."""
    x = F.col(column)
    usable = x.isNotNull() & (F.size(x) > 0) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    ends = F.lit(float(2**63 - 1024))
    v = F.transform(x, lambda c: F.floor(F.greatest(-ends, F.least(ends, F.lit(scale) * c.cast("double")))))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(usable, v).alias("v")).where("vec_id is not null and v is not null")


def _matrix(t: pa.Table) -> np.ndarray:
    col = t.column("v").combine_chunks()
    return col.flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)


def _placed(data: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """The rows with ``leaf``, their nearest centre among those of their dimension (0:
    the origin, where there is none), and ``far``, the distance to it."""
    shared = data.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column("v")
            size = np.diff(col.offsets.to_numpy())
            leaf, far = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for dim in np.unique(size).tolist():
                at = np.flatnonzero(size == dim)
                centers = shared.value.get(dim, np.zeros((1, dim))).astype(np.float64)
                for s in range(0, at.size, 1024):
                    one = at[s : s + 1024]
                    x = col.take(pa.array(one)).flatten().to_numpy(zero_copy_only=False).reshape(one.size, dim).astype(np.float64)
                    near = ((centers**2).sum(axis=1)[None, :] - 2 * (x @ centers.T)).argmin(axis=1)
                    leaf[one] = dim * _LEAVES + near
                    far[one] = np.sqrt(((x - centers[near]) ** 2).sum(axis=1))
            yield batch.append_column("leaf", pa.array(leaf)).append_column("far", pa.array(far))

    return data.mapInArrow(run, "vec_id long, v array<long>, asks boolean, leaf long, far double")


def top_k(vectors: DataFrame, queries: Column, k: int = 5, block: int = 32_768, part: int = 8192, sample: int = 4096, leaf_rows: int = 4096, column: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest integer products among all
    rows but its own.

    ``queries`` is a condition on vec_id. The centres of the leaves come from a
    sample of ``sample`` rows in expectation (and of 4 million components at
    most); every row is indexed. Rows of one vec_id stay rows of their own, as
    candidates and as queries. Vectors of different lengths share no product and
    never meet. Fewer than k other vectors give fewer rows; an empty table none.
    """
    data = quantise(vectors, column, scale).withColumn("asks", F.coalesce(queries, F.lit(False)))
    with Scratch(data.sparkSession, "top-k") as tables:
        rows, components = data.agg(F.count("*"), F.sum(F.size("v"))).first()
        share = min(1.0, sample / max(1, rows), (4 << 20) / max(1, components or 0))
        ticket = F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 30)) < int(share * (1 << 30))
        by_dim: dict[int, list] = {}
        for (v,) in data.where(ticket).select("v").collect():
            by_dim.setdefault(len(v), []).append(v)
        taken = sum(map(len, by_dim.values()))
        pivots = {dim: frontier(np.array(x, np.int64), max(1, min(_LEAVES - 1, rows * len(x) // (taken * leaf_rows)))) for dim, x in by_dim.items()}
        placed = tables.written(_placed(data, pivots).withColumn("row", F.monotonically_increasing_id()), "placed")

        split = lambda n, size: F.ceil(n / size).cast("int")
        leaves = tables.written(placed.groupBy("leaf").agg(split(F.count("*"), block).alias("subs"), F.max("far").alias("radius"), split(F.sum(F.col("asks").cast("int")), part).alias("parts")), "leaves")
        cut = lambda n: F.pmod(F.xxhash64("row"), n).cast("int")
        dealt = placed.join(small(leaves.drop("radius")), "leaf").withColumn("sub", cut(F.col("subs")))
        asked = placed.where("asks").join(small(leaves.drop("radius")), "leaf").withColumn("part", cut(F.col("parts"))).withColumnRenamed("leaf", "own")

        def search(qs: pa.Table, rs: pa.Table) -> pa.Table:
            if not qs.num_rows or not rs.num_rows:
                return pa.table({c: pa.array([], pa.int64()) for c in ("query", "query_id", "vec_id", "score")})
            row, floor = qs.column("row").to_numpy(), qs.column("floor").to_numpy()
            score, found = dual_search(_matrix(qs), row, _matrix(rs), rs.column("row").to_numpy(), rs.column("vec_id").to_numpy(), k, floor)
            ok = (score != _LOW) & (score >= floor[:, None])
            n = ok.sum(axis=1)
            return pa.table({"query": np.repeat(row, n), "query_id": np.repeat(qs.column("vec_id").to_numpy(), n), "vec_id": found[ok], "score": score[ok]})

        def met(qside: DataFrame, rside: DataFrame) -> DataFrame:
            #: fresh names: both sides descend from one table
            qside, rside = (x.select(*[F.col(c).alias(c) for c in ("leaf", "sub", "part", "row", "vec_id", "v", *more)]) for x, more in ((qside, ["floor"]), (rside, [])))
            return qside.groupBy("leaf", "sub", "part").cogroup(rside.groupBy("leaf", "sub", "part")).applyInArrow(search, "query long, query_id long, vec_id long, score long")

        def best(found: DataFrame) -> DataFrame:
            w = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
            return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

        #: each part of a leaf's queries meets one block of that leaf
        home = F.pmod(F.col("part"), F.col("subs")).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
        near = dealt.where("parts > 0").withColumn("part", every).where(F.col("sub") == home)
        first = tables.written(best(met(asked.withColumn("leaf", F.col("own")).withColumn("sub", home).withColumn("floor", F.lit(_LOW)), near)), "first")

        floors = first.where(F.col("rank") == k).select(F.col("query").alias("row"), F.col("score").alias("floor"))
        asked = asked.join(floors, "row", "left").withColumn("floor", F.coalesce("floor", F.lit(_LOW)))
        asked = tables.written(asked.select("row", "vec_id", "v", "far", "own", "part", "floor"), "asked")
        groups = asked.groupBy("own", "part").agg(F.max("far").alias("far"), F.min("floor").alias("worst"), F.count("*").alias("queries"))
        meet = tables.written(_surviving(groups, leaves, pivots, tables), "meet")
        sizes = meet.groupBy("leaf").agg(split(F.sum("queries"), part).alias("parties"))
        meet = meet.join(small(leaves.select("leaf", "subs")), "leaf").join(small(sizes), "leaf").withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)))
        meet = meet.where((F.col("leaf") != F.col("own")) | (F.col("sub") != home)).withColumn("party", F.pmod(F.xxhash64("own", "part"), F.col("parties")).cast("int"))
        guests = asked.join(small(meet.select("own", "part", "leaf", "sub", "party")), ["own", "part"]).drop("part").withColumnRenamed("party", "part")
        hosts = dealt.select("leaf", "sub", "row", "vec_id", "v").join(small(meet.select("leaf", "sub", F.col("party").alias("part")).distinct()), ["leaf", "sub"])
        found = first.select("query", "query_id", "vec_id", "score").unionByName(met(guests, hosts))
        return written(best(found).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), "top-k")


def _surviving(groups: DataFrame, leaves: DataFrame, pivots: dict[int, np.ndarray], tables: Scratch) -> DataFrame:
    """own, part, queries, leaf: the leaves that may hold a product above a query
    group's worst score. Only leaves of sampled centres are tested (their number is
    bounded); a dimension without a centre has one leaf, which is always met."""
    known = {}
    for dim, centers in pivots.items():
        known[dim] = (centers.astype(np.float64), np.full(len(centers), -1.0))
    inside = F.floor(F.col("leaf") / _LEAVES).isin(list(known))
    for leaf, radius in leaves.where(inside).select("leaf", "radius").collect():
        known[leaf // _LEAVES][1][leaf % _LEAVES] = radius
    shared = groups.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, part, far, worst, queries in zip(*(batch.column(c).to_pylist() for c in ("own", "part", "far", "worst", "queries"))):
                dim = own // _LEAVES
                open_ = np.array([own])
                if dim in shared.value:
                    centers, radii = shared.value[dim]
                    norms, c = np.sqrt((centers**2).sum(axis=1)), centers[own % _LEAVES]
                    could = most(c, far, norms[own % _LEAVES], centers, np.maximum(radii, 0), norms) >= worst
                    open_ = dim * _LEAVES + np.flatnonzero((radii >= 0) & could)
                n = open_.size
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, own)), pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, queries)), pa.array(open_)], ["own", "part", "queries", "leaf"])

    return groups.mapInArrow(run, "own long, part int, queries long, leaf long")
