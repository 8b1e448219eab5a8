"""Exact top-k inner products by dual-tree search over cover trees.

Vectors are dealt into blocks, and each block becomes a cover tree: the
children of a node have centres apart by more than 1 / BASE of its covering
radius and hold only what is within that of them. A query block's tree meets
the candidate trees one after the other and keeps its best scores between them.
For a pair of nodes (query node q, candidate node c) no score exceeds
<q, c> + |q| r_c + |c| r_q + r_q r_c, so a candidate node whose bound is below
the worst k-th score of the query node's rows is pruned with all that it holds;
query nodes of at most GROUP rows are searched row by row as a matrix.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Vectors in a candidate block and in a query block; rows of a leaf; rows of a query node that are searched together.
CANDIDATES, QUERIES, LEAF, GROUP = 4096, 4096, 16, 16
BASE = 2.0


class Tree:
    """Nodes as arrays. Rows of x are in tree order: a node's rows are x[lo:hi], its centre is x[lo] and its children are nodes kid to kid + kids."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        n = len(x)
        self.order = np.arange(n)
        lo, hi, radius, kid, kids = [0], [n], [0.0], [0], [0]
        if n:
            x = np.asarray(x, float)
            sq = (x * x).sum(1)
            far = lambda rows, p: np.sqrt(np.maximum(sq[rows] + sq[p] - 2 * (x[rows] @ x[p]), 0))
            dist = far(self.order, 0)
            radius[0] = float(dist.max())
            queue = [(0, dist)] if n > leaf and radius[0] > 0 else []
            for node, dist in queue:  # grows as nodes get children
                begin, end = lo[node], hi[node]
                left, ldist, near, at = self.order[begin:end].copy(), dist, radius[node] / BASE, begin
                kid[node] = len(lo)
                while len(left):
                    # The node's own centre first, then whatever is not covered yet.
                    inside = ldist <= near
                    own, od = left[inside], ldist[inside]
                    self.order[at : at + len(own)] = own
                    lo.append(at)
                    at += len(own)
                    hi.append(at)
                    radius.append(float(od.max()))
                    kid.append(0)
                    kids.append(0)
                    if len(own) > leaf and radius[-1] > 0:
                        queue.append((len(lo) - 1, od))
                    left = left[~inside]
                    if len(left):
                        ldist = far(left, left[0])
                kids[node] = len(lo) - kid[node]
        self.lo, self.hi, self.radius, self.kid, self.kids = np.array(lo), np.array(hi), np.array(radius), np.array(kid), np.array(kids)
        self.x = np.asarray(x)[self.order] if n else np.asarray(x)
        self.norm = np.sqrt((self.x.astype(float) ** 2).sum(1))

    def below(self, nodes: np.ndarray) -> np.ndarray:
        """The children of these nodes."""
        return spread(self.kid[nodes], self.kids[nodes])

    def __getstate__(self):
        x = self.x
        for small in ("<i2", "<i4", "<i8"):
            if not x.size or np.abs(x).max() < np.iinfo(small).max:
                x = x.astype(small)
                break
        return {**self.__dict__, "x": x, "norm": None}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.x = self.x.astype(float)
        self.norm = np.sqrt((self.x**2).sum(1))


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... size[i] of them, for each i."""
    return np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)


class Search:
    """The k best candidates of each row of a query tree, over any number of candidate trees. compared counts
    pairs of rows scored in full, bounded those of a row and a node of which only the bound was needed."""

    def __init__(self, q: Tree, qids: np.ndarray, k: int):
        self.q, self.qids, self.k = q, np.asarray(qids)[q.order], k
        self.best = np.full((len(qids), k), -np.inf)
        self.best_id = np.full((len(qids), k), np.iinfo("int64").max)
        self.compared = self.bounded = 0

    def meet(self, c: Tree, cids: np.ndarray) -> None:
        if not len(self.qids) or not len(c.x):
            return
        self.c, self.cids = c, np.asarray(cids)[c.order]
        self.seen = {}
        todo = [(0, np.zeros(1, "int64"))]
        while todo:
            a, front = todo.pop()
            q, c = self.q, self.c
            if q.hi[a] - q.lo[a] <= GROUP or not q.kids[a]:
                for lo in range(q.lo[a], q.hi[a], GROUP):
                    self._group(slice(lo, min(lo + GROUP, q.hi[a])), front)
                continue
            while True:
                at, r = c.lo[front], c.radius[front]
                bound = c.x[at] @ q.x[q.lo[a]] + q.norm[q.lo[a]] * r + q.radius[a] * (c.norm[at] + r)
                front = front[self._reaches(bound, self.best[q.lo[a] : q.hi[a], -1].min())]
                inner = (c.kids[front] > 0) & (c.radius[front] > q.radius[a])
                if not inner.any():
                    break
                front = np.concatenate([front[~inner], c.below(front[inner])])
            if len(front):
                # Small children that are neighbours in tree order are one group.
                held = None
                for kid in range(q.kid[a], q.kid[a] + q.kids[a]):
                    if q.hi[kid] - q.lo[kid] > GROUP:
                        todo.append((kid, front))
                    elif held and q.hi[kid] - held[0] <= GROUP and held[1] == q.lo[kid]:
                        held = (held[0], q.hi[kid])
                    else:
                        if held:
                            self._group(slice(*held), front)
                        held = (q.lo[kid], q.hi[kid])
                if held:
                    self._group(slice(*held), front)

    @staticmethod
    def _reaches(bound, floor):
        # Equal scores still matter: a smaller id wins a tie. The margin takes in rounding of the radii.
        return bound + 1e-6 * np.maximum(1.0, np.abs(bound)) >= floor

    def _group(self, rows: slice, front: np.ndarray) -> None:
        c, x, norm = self.c, self.q.x[rows], self.q.norm[rows]
        leaves, bounds, first = [], [], True
        while len(front):
            at = c.lo[front]
            score = x @ c.x[at].T
            self.bounded += score.size
            if first and len(front) > 1:
                # A first look at what lies under the nearest centres.
                first = False
                near = front[np.argsort(-score.max(0), kind="stable")[:8]]
                near = near[c.hi[near] - c.lo[near] <= 512]
                if len(near) and np.isneginf(self.best[rows, -1]).any():
                    self._score(rows, near)
                    self.seen[rows.start] = set(near.tolist())
            bound = score + norm[:, None] * c.radius[front]
            need = self._reaches(bound, self.best[rows, -1:]).any(0)
            if rows.start in self.seen:
                need &= ~np.isin(front, list(self.seen[rows.start]))
            front, bound = front[need], bound[:, need].max(0)
            inner = c.kids[front] > 0
            leaves.append(front[~inner])
            bounds.append(bound[~inner])
            front = c.below(front[inner])
        if not leaves:
            return
        leaves, bounds = np.concatenate(leaves), np.concatenate(bounds)
        leaves = leaves[np.argsort(-bounds, kind="stable")]
        take = 256
        while len(leaves):
            size = np.cumsum(c.hi[leaves] - c.lo[leaves])
            now = max(1, int(np.searchsorted(size, take, "right")))
            self._score(rows, leaves[:now])
            leaves, take = leaves[now:], min(2 * take, 4096)
            if len(leaves):
                bound = x @ c.x[c.lo[leaves]].T + norm[:, None] * c.radius[leaves]
                leaves = leaves[self._reaches(bound, self.best[rows, -1:]).any(0)]

    def _score(self, rows: slice, nodes: np.ndarray) -> None:
        c, k = self.c, self.k
        at = spread(c.lo[nodes], c.hi[nodes] - c.lo[nodes])
        s = self.q.x[rows] @ c.x[at].T
        self.compared += s.size
        ids = np.broadcast_to(self.cids[at], s.shape)
        own = ids == self.qids[rows, None]
        if own.any():
            s, ids = np.where(own, -np.inf, s), np.where(own, np.iinfo("int64").max, ids)
        # Only what reaches the k-th score counts (ties at it as well).
        able = np.flatnonzero((s >= self.best[rows, -1:]).any(0))
        if not len(able):
            return
        s, ids = np.concatenate([self.best[rows], s[:, able]], axis=1), np.concatenate([self.best_id[rows], ids[:, able]], axis=1)
        if s.shape[1] > 4 * k:
            kth = -np.partition(-s, k - 1, axis=1)[:, k - 1 : k]
            part = np.argsort(-s, axis=1, kind="stable")[:, : int((s >= kth).sum(1).max())]
            s, ids = np.take_along_axis(s, part, 1), np.take_along_axis(ids, part, 1)
        o = np.lexsort((ids, -s), axis=1)[:, :k]
        self.best[rows], self.best_id[rows] = np.take_along_axis(s, o, 1), np.take_along_axis(ids, o, 1)

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids) by the rows that the query tree was made of, ties to the smaller id; short rows end in (-inf, max)."""
        back = np.argsort(self.q.order)
        return self.best[back], self.best_id[back]


def dual_search(q: Tree, c: Tree, qids: np.ndarray, cids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(scores, ids) of the k best candidates of each query; a query never meets its own id."""
    search = Search(q, qids, k)
    search.meet(c, cids)
    return search.result()


def quantised(df: DataFrame, id_col: str, vec_col: str, factor: int = 256) -> DataFrame:
    """(id, v): integer vectors floor(factor * x); rows that are null, empty or hold a null or a non-finite number are left out."""
    x = F.transform(F.col(vec_col), lambda e: e.cast("double"))
    ok = F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & F.forall(F.col(vec_col), lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < F.lit(float("inf"))))
    return df.where(ok).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda e: F.floor(e * factor)).alias("v"))


def _blocks(per: int):
    """id, v -> width, ids, tree: runs of `per` vectors of one width."""

    def run(batches):
        held: dict[int, tuple[list, list]] = {}

        def packed(width):
            ids, vs = held.pop(width)
            tree = pickle.dumps(Tree(np.array(vs, "<i8").reshape(len(ids), width)))
            return pa.RecordBatch.from_arrays([pa.array([width], pa.int32()), pa.array([np.array(ids, "<i8").tobytes()], pa.binary()), pa.array([tree], pa.binary())], names=["width", "ids", "tree"])

        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not v:
                    continue
                ids, vs = held.setdefault(len(v), ([], []))
                ids.append(i)
                vs.append(v)
                if len(ids) >= per:
                    yield packed(len(v))
        for width in list(held):
            yield packed(width)

    return run


def _search(k: int):
    """Rows (qb, candidates?, ids, tree), a query block before its candidate blocks -> query_id, vec_id, score: the k best among these for each query."""

    def run(batches):
        search = None

        def best():
            score, ids = search.best, search.best_id
            row, col = np.nonzero(ids < np.iinfo("int64").max)
            return pa.RecordBatch.from_arrays([pa.array(search.qids[row]), pa.array(ids[row, col]), pa.array(score[row, col].astype("int64"))], names=["query_id", "vec_id", "score"])

        for b in batches:
            for r in range(b.num_rows):
                candidates, ids, tree = b.column(1)[r].as_py(), np.frombuffer(b.column(2)[r].as_py(), "<i8"), pickle.loads(b.column(3)[r].as_py())
                if candidates:
                    search.meet(tree, ids)
                else:
                    if search:
                        yield best()
                    search = Search(tree, ids, k)
        if search:
            yield best()

    return run


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", factor: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates of the largest integer inner product with each query, its own id left out.

    Ties go to the smaller id; a query with fewer candidates gets them all.
    Vectors (on either side) that are null, empty or hold a null or a
    non-finite number, and those with a null id, take no part. Vectors of
    different widths never meet. Repeated ids are candidates of their own; an
    empty side gives no rows; other columns take no part. Sums stay exact:
    doubles hold integers below 2^53. Queries and candidates meet block by
    block, so memory is bounded by a block of each. What is broadcast is a row
    for each query block, one in QUERIES rows of the queries at most."""
    tmp = Scratch(candidates.sparkSession, "cover")
    schema = "width int, ids binary, tree binary"
    c = quantised(candidates, id_col, vec_col, factor)
    cb = tmp.table(c.mapInArrow(_blocks(CANDIDATES), schema), "candidates")
    q = quantised(queries, id_col, vec_col, factor)
    qb = tmp.table(q.repartition(max(1, -(-q.count() // QUERIES)), "id").mapInArrow(_blocks(QUERIES), schema).withColumn("qb", F.monotonically_increasing_id()), "queries")
    # A query block goes through the candidate blocks in several runs, as many as keep all cores at work.
    n = 4 * candidates.sparkSession.sparkContext.defaultParallelism
    runs = max(1, min(cb.count(), -(-n // max(1, qb.count()))))
    names = F.broadcast(qb.select("width", "qb"))
    blocks = cb.join(names, "width").select("qb", F.pmod(F.xxhash64("ids"), F.lit(runs)).alias("run"), F.lit(True).alias("candidates"), "ids", "tree")
    heads = qb.select("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(runs - 1).cast("long"))).alias("run"), F.lit(False).alias("candidates"), "ids", "tree")
    work = heads.unionByName(blocks).repartition(min(4096, n), "qb", "run").sortWithinPartitions("qb", "run", "candidates")
    pairs = work.select("qb", "candidates", "ids", "tree").mapInArrow(_search(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
