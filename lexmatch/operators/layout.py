"""How a graph's nodes are laid out: costs, renumbering, search for better orders, coarsening.

Graphs are edge tables (src_order, dst_order, label, weight) over dense ids. Costs and renumbering are plain queries at any size. The
searches are sequential by nature: each runs in one task on a graph that is checked to be small, and many seeds run side by side.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmatch.plans.stages import dropped, written

LINE = 16  #: node ids that share a cache line
#: Edges that one task's search may hold; larger graphs are refused.
SEARCH_EDGES = 2_000_000


def arrangement_cost(edges: DataFrame) -> DataFrame:
    """One row: cost, the sum over edges of distance between the ends times weight."""
    return edges.agg(F.coalesce(F.sum(F.abs(F.col("src_order") - F.col("dst_order")) * F.col("weight")), F.lit(0)).cast("bigint").alias("cost"))


def cache_arrangement_cost(edges: DataFrame, line: int = LINE) -> DataFrame:
    """One row: cost, the weight of all edges whose ends lie in different blocks of `line` ids."""
    crosses = F.expr(f"src_order div {line} <> dst_order div {line}")
    return edges.agg(F.coalesce(F.sum(F.when(crosses, F.col("weight")).otherwise(0)), F.lit(0)).cast("bigint").alias("cost"))


def checked(arrangement: DataFrame, n: int) -> DataFrame:
    """arrangement (position, node_id) if it is a permutation of 0..n-1; raises ValueError if not."""
    found = arrangement.agg(F.count("*").alias("n"), F.countDistinct("position").alias("p"), F.countDistinct("node_id").alias("v"), F.min("position").alias("a"), F.max("position").alias("b"), F.min("node_id").alias("c"), F.max("node_id").alias("d")).first()
    if (found["n"], found["p"], found["v"]) != (n, n, n) or n and (found["a"], found["b"], found["c"], found["d"]) != (0, n - 1, 0, n - 1):
        raise ValueError(f"not a permutation of {n} nodes")
    return arrangement


def arrange(edges: DataFrame, arrangement: DataFrame) -> DataFrame:
    """edges with every node renumbered to its position in the arrangement."""
    to = lambda column: arrangement.select(F.col("node_id").alias(column), F.col("position").alias(f"new_{column}"))
    moved = edges.join(to("src_order"), "src_order").join(to("dst_order"), "dst_order")
    return moved.select(F.col("new_src_order").alias("src_order"), F.col("new_dst_order").alias("dst_order"), "label", "weight")


def undirected(edges: DataFrame) -> DataFrame:
    """(a, b, weight): each pair of neighbours in both directions, weights of parallel edges added; a loop stands once."""
    both = edges.select(F.col("src_order").alias("a"), F.col("dst_order").alias("b"), "weight")
    back = both.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "weight")
    return both.unionByName(back).groupBy("a", "b").agg(F.sum("weight").cast("bigint").alias("weight"))


class Problem:
    """An order of nodes under search: order[position] = node, place[node] = position. move() returns the exact change of cost."""

    def __init__(self, n: int, src: np.ndarray, dst: np.ndarray, weight: np.ndarray, terminal: np.ndarray, random: np.random.Generator, line: int | None = None, topological: bool = False) -> None:
        self.n, self.src, self.dst, self.weight, self.terminal, self.random, self.line, self.topological = n, src, dst, weight, terminal, random, line, topological
        self.order, self.place = np.arange(n), np.arange(n)
        ends = np.concatenate([src, dst])
        at = np.argsort(ends, kind="stable")
        self._edges = np.split(at % max(1, len(src)), np.searchsorted(ends[at], np.arange(1, n))) if n else []
        #: In a topological order: each node's first child's place and last parent's, by which many pairs are told at once.
        self.low, self.high = np.full(n, n), np.full(n, -1)
        np.minimum.at(self.low, src, dst)
        np.maximum.at(self.high, dst, src)
        self.kept = topological and bool((src < dst).all())

    def cost(self) -> int:
        return int(self._costs(np.arange(len(self.src))).sum())

    def _costs(self, edges: np.ndarray) -> np.ndarray:
        a, b = self.place[self.src[edges]], self.place[self.dst[edges]]
        return (a // self.line != b // self.line) * self.weight[edges] if self.line else np.abs(a - b) * self.weight[edges]

    def allowed(self, x: int, y: int) -> bool:
        """Whether nodes x and y may change places: the first position is no terminal's, and stays the root's in a topological order."""
        first, second = sorted((self.place[x], self.place[y]))
        if first == 0 and (self.topological or self.terminal[self.order[second]]):
            return False
        return not self.topological or self._ordered(x, y)

    def _ordered(self, x: int, y: int) -> bool:
        self._swap(x, y)
        own = np.concatenate([self._edges[x], self._edges[y]])
        good = bool((self.place[self.src[own]] < self.place[self.dst[own]]).all())
        self._swap(x, y)
        return good

    def _swap(self, x: int, y: int) -> None:
        i, j = self.place[x], self.place[y]
        self.order[i], self.order[j], self.place[x], self.place[y] = y, x, j, i
        if self.kept:
            for node, old, new in ((x, i, j), (y, j, i)):
                for edge in self._edges[node]:
                    a, b = self.src[edge], self.dst[edge]
                    if b == node:
                        self.low[a] = new if new <= self.low[a] else self.place[self._ends(a, self.src, self.dst)].min() if old == self.low[a] else self.low[a]
                    else:
                        self.high[b] = new if new >= self.high[b] else self.place[self._ends(b, self.dst, self.src)].max() if old == self.high[b] else self.high[b]

    def _ends(self, node: int, near: np.ndarray, far: np.ndarray) -> np.ndarray:
        own = self._edges[node]
        return far[own[near[own] == node]]

    def _next(self, tries: int) -> tuple[int, int] | None:
        """The first allowed one of the random pairs that as many tries draw one by one, with the numbers after it still to be drawn."""
        done, size = 0, 16
        while done < tries:
            size = min(2 * size, tries - done)
            state = self.random.bit_generator.state
            pairs = self.random.integers(0, self.n, (size, 2))
            place = np.sort(self.place[pairs], axis=1)
            first, second = place[:, 0], place[:, 1]
            good = np.flatnonzero((first > 0) & (first < second) & (self.low[self.order[first]] > second) & (self.high[self.order[second]] < first))
            if len(good):
                self.random.bit_generator.state = state
                x, y = self.random.integers(0, self.n, (int(good[0]) + 1, 2))[-1]
                return int(x), int(y)
            done += size
        return None

    def move(self, tries: int = 500) -> tuple[int, int, float]:
        """Swaps a random allowed pair; (x, y, change). An infinite change if none was found."""
        if self.kept:
            found = self._next(tries)
        else:
            drawn = (tuple(int(v) for v in self.random.integers(0, self.n, 2)) for _ in range(tries))
            found = next(((x, y) for x, y in drawn if x != y and self.allowed(x, y)), None)
        if found is None:
            return 0, 0, math.inf
        x, y = found
        own = np.unique(np.concatenate([self._edges[x], self._edges[y]]))
        before = self._costs(own).sum()
        self._swap(x, y)
        return x, y, float(self._costs(own).sum() - before)

    def undo(self, x: int, y: int) -> None:
        self._swap(x, y)


#: Start, rate and end of the reference's cooling schedules.
SCHEDULES = {"cache": (0.005, 0.999999995, 1e-9), "topological_cache": (0.005, 0.999999995, 1e-9), "topological": (50.0, 0.9999995, 1e-7), "ordering": (5e5, 0.999999, 1e-5)}
KINDS: dict[str, dict] = {"ordering": {}, "topological": {"topological": True}, "cache": {"line": LINE}, "topological_cache": {"line": LINE, "topological": True}}


def anneal(problem: Problem, start: float, rate: float, stop: float) -> tuple[int, np.ndarray]:
    """Cools from start by rate until stop; a move that raises the cost is kept with the temperature as its probability. Best cost and order."""
    cost = best = problem.cost()
    order, temperature = problem.order.copy(), start
    while temperature > stop and problem.n > 1:
        x, y, change = problem.move()
        if math.isinf(change):
            break
        if change <= 0 or problem.random.random() < temperature:
            cost += int(change)
            if cost < best:
                best, order = cost, problem.order.copy()
        else:
            problem.undo(x, y)
        temperature *= rate
    return best, order


def _one_task(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The whole graph as rows of one table; refused beyond SEARCH_EDGES."""
    found = edges.limit(SEARCH_EDGES + 1).count() + nodes.limit(SEARCH_EDGES + 1).count()
    if found > SEARCH_EDGES:
        raise ValueError(f"a search holds at most {SEARCH_EDGES} edges and nodes")
    rows = edges.select(F.lit("edge").alias("what"), F.col("src_order").alias("a"), F.col("dst_order").alias("b"), F.col("weight").cast("bigint").alias("w"))
    return rows.unionByName(nodes.select(F.lit("node").alias("what"), F.col("order_id").alias("a"), F.col("is_terminal").cast("bigint").alias("b"), F.lit(0).cast("bigint").alias("w")))


def _arrays(group: pd.DataFrame) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    edge, node = group[group.what == "edge"].sort_values(["a", "b", "w"]), group[group.what == "node"].sort_values("a")
    return len(node), edge.a.to_numpy(np.int64), edge.b.to_numpy(np.int64), edge.w.to_numpy(np.int64), node.b.to_numpy(bool)


def schedule(kind: str, moves: int | None = None) -> tuple[float, float, float]:
    """(start, rate, stop) of a kind of search: the reference's, or with `moves` one that cools from its start to its end in so many moves."""
    start, rate, stop = SCHEDULES[kind]
    return start, rate if moves is None else (stop / start) ** (1 / moves), stop


def annealed(nodes: DataFrame, edges: DataFrame, kind: str = "cache", seeds: int = 4, moves: int | None = None, start: float | None = None, rate: float | None = None, stop: float | None = None) -> DataFrame:
    """(seed, cost_before, cost_after, order): the best order found by each seed, all from the ids as they are. Seeds run side by side.

    By default the search cools as the reference's does, which is 3.1e9 moves for the cache kinds, 4e7 for topological and 2.5e7 for
    ordering, at some ten thousand moves a second. `moves` shortens that between the same temperatures; start, rate and stop replace them.
    """
    options, given = KINDS[kind], schedule(kind, moves)
    start, rate, stop = (g if x is None else x for x, g in zip((start, rate, stop), given))

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        n, src, dst, weight, terminal = _arrays(group)
        problem = Problem(n, src, dst, weight, terminal, np.random.default_rng(int(key[0])), **options)
        before = problem.cost()
        cost, order = anneal(problem, start, rate, stop)
        return pd.DataFrame({"seed": [key[0]], "cost_before": [before], "cost_after": [cost], "order": [order.tolist()]})

    every = _one_task(nodes, edges).withColumn("seed", F.explode(F.array(*[F.lit(i) for i in range(seeds)])))
    return every.groupBy("seed").applyInPandas(run, "seed int, cost_before bigint, cost_after bigint, order array<bigint>")


def best_arrangement(found: DataFrame) -> DataFrame:
    """(position, node_id) of the cheapest row of annealed(), the first seed of equals."""
    best = found.agg(F.min(F.struct("cost_after", "seed", "order")).alias("b"))
    return best.select(F.posexplode("b.order").alias("position", "node_id")).select(F.col("position").cast("bigint").alias("position"), "node_id")


def _solved(degree: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray, right: np.ndarray, rounds: int, tolerance: float) -> np.ndarray:
    """x without the constant vector for which the connected graph's Laplacian gives `right`, by conjugate gradients over the degrees."""
    n = len(degree)
    x, r = np.zeros(n), right - right.mean()
    z = r / degree
    p, rz, goal = z.copy(), r @ z, tolerance * np.linalg.norm(r)
    for _ in range(rounds):
        if np.linalg.norm(r) <= goal:
            break
        q = degree * p - np.bincount(a, w * p[b], n) - np.bincount(b, w * p[a], n)
        step = rz / (p @ q)
        x += step * p
        r -= step * q
        r -= r.mean()
        z = r / degree
        rz, old = r @ z, rz
        p = z + rz / old * p
    return x - x.mean()


def _parts(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node of each node's connected part."""
    part = np.arange(n)
    while True:
        before, low = part.copy(), np.minimum(part[a], part[b])
        np.minimum.at(part, part[a], low)
        np.minimum.at(part, part[b], low)
        part = part[part]
        if (part == before).all():
            return part


def fiedler(n: int, src: np.ndarray, dst: np.ndarray, weight: np.ndarray, tolerance: float = 1e-6, seed: int = 7, dense: int = 1000, space: int = 60, rounds: int = 20_000) -> np.ndarray:
    """The eigenvector of the weighted Laplacian's second least eigenvalue, of length one; the first node that isn't at zero is below it.

    Up to `dense` nodes all eigenvectors are found. Larger graphs take a Lanczos space of the inverse, each step a solution by conjugate
    gradients. A vector whose residual is over `tolerance` of its eigenvalue raises ArithmeticError. In a graph of several parts the
    second eigenvalue is zero; the vector then tells the part of node 0 from the rest.
    """
    w = np.maximum(weight.astype(float), 1.0)
    keep = src != dst
    a, b, w = src[keep], dst[keep], w[keep]
    if n < 2:
        return np.zeros(n)
    part = _parts(n, a, b)
    if part.any():
        x = np.where(part == 0, -1.0, 0.0)
        x -= x.mean()
        return x / np.linalg.norm(x)
    degree = np.bincount(a, w, n) + np.bincount(b, w, n)
    apply = lambda x: degree * x - np.bincount(a, w * x[b], n) - np.bincount(b, w * x[a], n)
    residual = lambda x: np.linalg.norm(apply(x) - (x @ apply(x)) * x) / (x @ apply(x))
    if n <= dense:
        laplacian = np.diag(degree)
        np.subtract.at(laplacian, (a, b), w)
        np.subtract.at(laplacian, (b, a), w)
        x = np.linalg.eigh(laplacian)[1][:, 1]
        x = x - x.mean()
    else:
        start = np.random.default_rng(seed).standard_normal(n)
        start -= start.mean()
        basis, images = [start / np.linalg.norm(start)], []
        while True:
            images.append(_solved(degree, a, b, w, basis[-1], rounds, 1e-10))
            q = np.stack(basis)
            small = q @ np.stack(images).T
            x = np.linalg.eigh((small + small.T) / 2)[1][:, -1] @ q
            x = x - x.mean()
            x /= np.linalg.norm(x)
            if residual(x) <= tolerance or len(basis) == min(space, n - 1):
                break
            more = images[-1] - (q @ images[-1]) @ q
            more -= (q @ more) @ q
            basis.append(more / np.linalg.norm(more))
    x /= np.linalg.norm(x)
    if not residual(x) <= tolerance:
        raise ArithmeticError(f"the Fiedler vector of {n} nodes did not converge: its residual is {residual(x):.3g} of its eigenvalue, over {tolerance}")
    far = np.flatnonzero(np.abs(x) > 1e-9)
    return -x if x[far[0]] > 0 else x


def spectral(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(position, node_id): nodes in the order of the Fiedler vector, ties by id."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        n, src, dst, weight, _ = _arrays(group)
        order = np.argsort(fiedler(n, src, dst, weight).round(12), kind="stable") if n else np.zeros(0, np.int64)
        return pd.DataFrame({"position": np.arange(n), "node_id": order})

    return _one_task(nodes, edges).withColumn("graph", F.lit(0)).groupBy("graph").applyInPandas(run, "position bigint, node_id bigint")


#: Edges, some 60 bytes each at the most, up to which a graph is contracted in one task; beyond, round by round over all tasks.
ONE_TASK = 8_000_000


def _contracted(src: np.ndarray, dst: np.ndarray, fixed: np.ndarray, degree: int, down: bool) -> tuple[np.ndarray, np.ndarray]:
    """coarsen() of arrays of distinct edges without loops, over nodes 0..len(fixed)-1; fixed tells which nodes stay."""
    n, (near, far) = len(fixed), (dst, src) if down else (src, dst)
    while True:
        parents = np.bincount(far, minlength=n)
        ready = (parents > 0) & (parents <= degree) & ~fixed
        if not ready.any():
            return (far, near) if down else (near, far)
        blocked = np.zeros(n, bool)
        blocked[far[ready[near]]] = True
        merged = ready & ~blocked
        into, beyond = merged[far], merged[near]
        order = np.argsort(far[into], kind="stable")
        to, first = near[into][order], np.cumsum(np.where(merged, parents, 0)) - np.where(merged, parents, 0)
        # each edge beyond a merged node goes on from all the nodes that one goes into
        node, other = near[beyond], far[beyond]
        times = parents[node]
        place = np.repeat(first[node] - np.cumsum(times) + times, times) + np.arange(times.sum())
        rest = ~into & ~beyond
        key = np.unique(np.concatenate([near[rest] * n + far[rest], to[place] * n + np.repeat(other, times)]))
        near, far = key // n, key % n
        near, far = near[near != far], far[near != far]


def _in_one_task(edges: DataFrame, fixed: DataFrame, run: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """run(names, src, dst, fixed) of the whole graph: edges by the places of their nodes in names, and which of those are fixed."""
    rows = edges.where("src <> dst").select("src", "dst").unionByName(fixed.select(F.col("node").alias("src"), F.lit(None).cast("bigint").alias("dst")))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b["src"].filter(b["dst"].is_valid()).to_numpy(), b["dst"].drop_null().to_numpy(), b["src"].filter(b["dst"].is_null()).to_numpy()) for b in batches]
        src, dst, stay = (np.concatenate([x[i] for x in held] or [np.zeros(0, np.int64)]) for i in range(3))
        names = np.unique(np.concatenate([src, dst, stay]))
        key = np.unique(np.searchsorted(names, src) * len(names) + np.searchsorted(names, dst))
        yield from run(names, key // max(1, len(names)), key % max(1, len(names)), np.isin(names, stay))

    return rows.repartition(1).mapInArrow(gather, schema)


def coarsen(edges: DataFrame, fixed: DataFrame, degree: int, down: bool = False, one_task: int = ONE_TASK) -> DataFrame:
    """(src, dst) edges after contracting nodes with 1 to `degree` parents (down: children) into all of those, until none is left.

    edges (src, dst) are distinct; fixed (node) are never contracted. In a round every second generation waits: a node is merged only
    if none of the nodes it goes into is merged in that round, so merges don't chain. Rounds end as no node qualifies. A graph whose edges
    are counted to be at most `one_task` is contracted in one task; both ways give the same edges.
    """
    if edges.limit(one_task + 1).count() <= one_task:

        def run(names: np.ndarray, src: np.ndarray, dst: np.ndarray, stay: np.ndarray) -> Iterator[pa.RecordBatch]:
            src, dst = _contracted(src, dst, stay, degree, down)
            for i in range(0, len(src), 1 << 16):
                yield pa.RecordBatch.from_pydict({"src": names[src[i : i + (1 << 16)]], "dst": names[dst[i : i + (1 << 16)]]})

        return _in_one_task(edges, fixed, run, "src bigint, dst bigint")
    near, far = ("dst", "src") if down else ("src", "dst")
    now = written(edges.select("src", "dst").where("src <> dst").distinct(), "coarse")
    while True:
        counts = now.groupBy(F.col(far).alias("node")).agg(F.count("*").alias("n")).where(F.col("n") <= degree)
        ready = written(counts.join(fixed, "node", "left_anti").select("node"), "ready")
        if ready.isEmpty():
            dropped(ready)
            return now
        # of the ready nodes, those without a ready node on the side they go to; cycles can't be, so there is always one
        blocked = now.join(ready.withColumnRenamed("node", near), near, "left_semi").select(F.col(far).alias("node")).distinct()
        merged = written(ready.join(blocked, "node", "left_anti"), "merged")
        into = now.join(merged.withColumnRenamed("node", far), far, "left_semi").select(F.col(far).alias("node"), F.col(near).alias("to"))
        beyond = now.join(merged.withColumnRenamed("node", near), near, "left_semi").select(F.col(near).alias("node"), F.col(far).alias("other"))
        fresh = into.join(beyond, "node").select(F.col("to").alias(near), F.col("other").alias(far))
        rest = now.join(merged.withColumnRenamed("node", far), far, "left_anti").join(merged.withColumnRenamed("node", near), near, "left_anti")
        after = written(rest.select("src", "dst").unionByName(fresh.select("src", "dst")).where("src <> dst").distinct(), "coarse")
        dropped(now, ready, merged)
        now = after


def shrunk(edges: DataFrame, fixed: DataFrame, degrees: range = range(1, 10), down: bool = False, one_task: int = ONE_TASK) -> DataFrame:
    """(coarse, n_nodes, n_edges) after contraction with each degree in turn, each going on from the last."""
    if edges.limit(one_task + 1).count() <= one_task:

        def run(names: np.ndarray, src: np.ndarray, dst: np.ndarray, stay: np.ndarray) -> Iterator[pa.RecordBatch]:
            for degree in degrees:
                src, dst = _contracted(src, dst, stay, degree, down)
                used = stay.copy()
                used[src] = used[dst] = True
                yield pa.RecordBatch.from_pydict({"coarse": pa.array([degree], pa.int32()), "n_nodes": [int(used.sum())], "n_edges": [len(src)]})

        return _in_one_task(edges, fixed, run, "coarse int, n_nodes bigint, n_edges bigint")
    out, now = None, edges.select("src", "dst")
    for degree in degrees:
        now = coarsen(now, fixed, degree, down, one_task)
        nodes = now.select(F.col("src").alias("v")).union(now.select("dst")).union(fixed.select("node")).agg(F.countDistinct("v").alias("n_nodes"))
        row = nodes.crossJoin(now.agg(F.count("*").alias("n_edges"))).select(F.lit(degree).alias("coarse"), "n_nodes", "n_edges")  # one row each
        out = row if out is None else out.unionByName(row)
    return out
