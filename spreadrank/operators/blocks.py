"""Traversals of graphs that fit in a task: the graph is sent to the executors once, each task searches blocks of sources on its own copy.

A level loop of joins shuffles a row for each source and vertex at every level. Up to EDGES edges (tens of MB, checked before anything is
sent) no search needs a shuffle: sources or samples are dealt over tasks, and a task holds a block of at most CELLS (source, vertex) cells
at a time, whatever the number of sources. Larger graphs, and ids that aren't bigint, take the joins in ``traverse`` and ``exact``; both
ways give the same rows. Searches are sparse: a (source, vertex) cell is expanded once, so long chains cost no more than their arcs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from spreadrank.functions.draws import uniform_array

#: Most edges of a graph that is sent to tasks.
EDGES = 1 << 21

#: Most (source, vertex) or (source, arc) cells of a block.
CELLS = 1 << 21

#: Sources whose rows are written together, vertex by vertex, and the most cells that they have at hand for that.
TOGETHER, HELD = 64, 1 << 23


@dataclass
class Compact:
    """Vertices by position in ``ids`` (sorted); ``to[first[v]:first[v + 1]]`` are the ends of v's arcs, ``back`` and ``last`` those of the
    arcs into v, both sorted."""

    ids: np.ndarray
    first: np.ndarray
    to: np.ndarray
    last: np.ndarray
    back: np.ndarray

    @classmethod
    def of(cls, src: np.ndarray, dst: np.ndarray) -> Compact:
        ids, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
        a, b, n = at[: len(src)], at[len(src) :], len(ids)
        out, into = np.lexsort((b, a)), np.lexsort((a, b))
        starts = lambda x: np.concatenate([[0], np.cumsum(np.bincount(x, minlength=n))]).astype(np.int64)
        return cls(ids, starts(a), b[out].astype(np.int32), starts(b), a[into].astype(np.int32))

    @property
    def block(self) -> int:
        """Sources of a block."""
        return max(1, CELLS // max(len(self.ids) + len(self.to), 1))

    @property
    def group(self) -> int:
        """Sources whose rows are written together."""
        return max(1, min(TOGETHER, HELD // max(len(self.ids), 1)))

    def places(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of ids, and which of them are vertices."""
        if not len(self.ids):
            return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
        p = np.minimum(np.searchsorted(self.ids, values), len(self.ids) - 1)
        return p, self.ids[p] == values


def compact(graph, edges: int = EDGES) -> Compact | None:
    """The graph for tasks; None if it has more edges than the bound or ids of another type."""
    if any(not isinstance(graph.edges.schema[c].dataType, LongType) for c in ("src", "dst")):
        return None
    rows = graph.edges.select("src", "dst").limit(edges + 1).toArrow()
    if rows.num_rows > edges:
        return None
    src, dst = (rows[c].to_numpy() for c in ("src", "dst"))
    return Compact.of(src, dst) if graph.directed else Compact.of(np.concatenate([src, dst]), np.concatenate([dst, src]))


def _expand(first: np.ndarray, ends: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(arcs' other ends, arcs of each v), v after v."""
    count = first[v + 1] - first[v]
    skip = np.cumsum(count) - count
    return ends[np.repeat(first[v] - skip, count) + np.arange(count.sum())], count


class Search:
    """Breadth-first searches of a block of sources. Cells are numbered row * n + vertex; ``levels`` holds the cells of each distance."""

    def __init__(self, g: Compact, starts: np.ndarray, stops: np.ndarray | None = None):
        """stops: a vertex for each source, with whose level its search ends."""
        self.g, self.n = g, len(g.ids)
        rows = len(starts)
        self.dist = np.full(rows * self.n, -1, np.int32)
        self.sigma = np.zeros(rows * self.n)
        self._mark = np.zeros(rows * self.n, np.int64)
        front = np.arange(rows) * self.n + starts
        self.goal = None if stops is None else np.arange(rows) * self.n + stops
        self.dist[front], self.sigma[front] = 0, 1.0
        self.levels = []
        while len(front):
            self.levels.append(front)
            if self.goal is not None:
                front = front[self.dist[self.goal[front // self.n]] < 0]
            v = front % self.n
            ends, count = _expand(g.first, g.to, v)
            cells, ways = np.repeat(front - v, count) + ends, np.repeat(self.sigma[front], count)
            new = self.dist[cells] < 0
            cells, ways = cells[new], ways[new]
            self.add(self.sigma, cells, ways)
            front = self.once(cells)
            self.dist[front] = len(self.levels)

    def once(self, cells: np.ndarray) -> np.ndarray:
        """Each cell a single time."""
        order = np.arange(len(cells))
        self._mark[cells] = order
        return cells[self._mark[cells] == order]

    def before(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(predecessor cells on shortest paths, place in ``cells`` of each)."""
        v = cells % self.n
        ends, count = _expand(self.g.last, self.g.back, v)
        of = np.repeat(np.arange(len(cells)), count)
        prior = (cells - v)[of] + ends
        good = self.dist[prior] == self.dist[cells][of] - 1
        return prior[good], of[good]

    def dependencies(self, worths: list[tuple[Callable[[np.ndarray], np.ndarray], np.ndarray | None]]) -> list[np.ndarray]:
        """delta of each cell for each (worth, through): see ``traverse.accumulate``. worth: of cells; through: whether a vertex passes anything on."""
        deltas = [np.zeros(len(self.sigma)) for _ in worths]
        for level in reversed(self.levels[1:]):
            prior, of = self.before(level)
            ways = self.sigma[prior]
            for delta, (worth, through) in zip(deltas, worths, strict=True):
                part = (worth(level) + delta[level]) / self.sigma[level]
                if through is not None:
                    part = np.where(through[level % self.n], part, 0.0)
                self.add(delta, prior, ways * part[of])
        for delta in deltas:
            delta[self.levels[0]] = 0.0
        return deltas

    @staticmethod
    def add(to: np.ndarray, cells: np.ndarray, values: np.ndarray) -> None:
        """to[cells] += values, repeated cells too; whole arrays at once where most cells are met."""
        if 4 * len(cells) > len(to):
            to += np.bincount(cells, values, len(to))
        else:
            np.add.at(to, cells, values)

    def to_goals(self) -> tuple[np.ndarray, np.ndarray]:
        """(cells strictly between source and goal, share of shortest paths through each)."""
        ways = np.zeros(len(self.sigma))
        far = self.dist[self.goal]
        ways[self.goal[far > 0]] = 1.0
        at, inner = np.zeros(0, np.int64), []
        for d in range(len(self.levels) - 1, 0, -1):
            at = np.concatenate([at, self.goal[far == d]])
            prior, of = self.before(at)
            np.add.at(ways, prior, ways[at][of])
            at = self.once(prior)
            if d > 1:
                inner.append(at)
        cells = np.concatenate(inner) if inner else at[:0]
        return cells, self.sigma[cells] * ways[cells] / self.sigma[self.goal[cells // self.n]]

    def draw(self, sample: np.ndarray, stream: np.ndarray) -> np.ndarray:
        """Cells strictly inside one shortest path for each source, drawn as ``traverse.draw_paths`` says."""
        at, out = self.goal[self.dist[self.goal] > 1], []
        while len(at):
            prior, of = self.before(at)
            row = at // self.n
            u = uniform_array(sample[row], self.dist[at] - 1 + stream[row]) * self.sigma[at]
            run = _runs(self.sigma[prior], of)
            hit = (u[of] >= run - self.sigma[prior]) & (u[of] < run)
            at = prior[hit]
            out.append(at)
            at = at[self.dist[at] > 1]
        return np.concatenate(out) if out else at


    def shares(self, sample: np.ndarray, share: float, most: int, stream: int = 50, step: int = 1 << 12) -> tuple[np.ndarray, np.ndarray]:
        """(cells strictly inside, share of the drawn paths through each) for max(1, floor(share * paths there are)) paths of each source,
        drawn as ``draw`` does, numbered sample * most + 0, 1, ... A block is searched once, its paths are drawn ``step`` at a time."""
        rows = np.flatnonzero(self.dist[self.goal] >= 0)
        count = np.maximum(1, np.floor(share * self.sigma[self.goal[rows]])).astype(np.int64)
        ends, hits = np.cumsum(count), np.zeros(len(self.sigma))
        for low in range(0, int(count.sum()), step):
            path = np.arange(low, min(low + step, int(ends[-1])))
            own = np.searchsorted(ends, path, "right")
            one, at = sample[rows[own]] * most + path - (ends - count)[own], self.goal[rows[own]]
            while len(at):
                prior, of = self.before(at)
                u = uniform_array(one, self.dist[at] - 1 + stream) * self.sigma[at]
                run = _runs(self.sigma[prior], of)
                hit = (u[of] >= run - self.sigma[prior]) & (u[of] < run)
                at, one = prior[hit], one[of[hit]]
                inner = self.dist[at] > 0
                at, one = at[inner], one[inner]
                np.add.at(hits, at, 1.0)
        by = np.ones(len(self.goal))
        by[rows] = count
        cells = np.flatnonzero(hits)
        return cells, hits[cells] / by[cells // self.n]


def _runs(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Running sums within runs of equal ``of``; exact while path counts are whole doubles."""
    if not len(values):
        return values
    start = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    if values.sum() < 2.0**52:
        total = np.cumsum(values)
        return total - np.repeat(total[start] - values[start], np.diff(np.append(start, len(of))))
    return np.concatenate([np.cumsum(p) for p in np.split(values, start[1:])])


def _tasks(spark: SparkSession, blocks: int) -> int:
    """One wave of tasks for small jobs, up to four for large ones, so that a lost task costs little."""
    cores = max(1, spark.sparkContext.defaultParallelism)
    return cores if blocks <= cores else min(4 * cores, blocks)


def dependency_sums(spark: SparkSession, g: Compact, sources: np.ndarray, weight: np.ndarray | None = None, x: np.ndarray | None = None, plain: bool = False) -> DataFrame:
    """(v, t): sum over sources (positions) of weight * delta. With x, reaching v from s is worth max(x_s - x_v, 0), and vertices whose x is
    NaN pass nothing on; else 1. plain: also ``plain``, the sum of delta where all are worth 1, from the same searches. A task adds up its
    sources before anything is shuffled."""
    sent = spark.sparkContext.broadcast((g, sources.astype(np.int64), weight, x))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, sources, weight, x = sent.value
        n, total, even = len(g.ids), np.zeros(len(g.ids)), np.zeros(len(g.ids))
        through = None if x is None else ~np.isnan(x)
        ones = (lambda cells: np.ones(len(cells)), None)
        for batch in batches:
            mine = batch.column(0).to_numpy()
            for k in range(0, len(mine), g.block):
                of = mine[k : k + g.block]
                s = sources[of]
                worth = ones if x is None else (lambda cells, s=s: np.fmax(x[s[cells // n]] - x[cells % n], 0.0), through)
                first, *more = (d.reshape(len(s), n) for d in Search(g, s).dependencies([worth, ones] if plain else [worth]))
                total += first.sum(axis=0) if weight is None else weight[of] @ first
                for delta in more:
                    even += delta.sum(axis=0)
        if through is not None:
            total[~through] = 0.0
        some = np.flatnonzero((total != 0) | (even != 0))
        yield pa.RecordBatch.from_arrays([pa.array(g.ids[some]), pa.array(total[some]), pa.array(even[some])], names=["v", "t", "plain"])

    tasks = _tasks(spark, -(-len(sources) // g.block))
    rows = spark.range(0, len(sources), 1, tasks).mapInArrow(work, "v bigint, t double, plain double")
    return rows.groupBy("v").agg(F.sum("t").alias("t"), *([F.sum("plain").alias("plain")] if plain else []))


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[list[np.ndarray]]:
    for batch in batches:
        for k in range(0, batch.num_rows, size):
            yield [c.to_numpy(zero_copy_only=False) for c in batch.slice(k, size).columns]


def _dealt(rows: DataFrame) -> DataFrame:
    spark = rows.sparkSession
    return rows.repartition(2 * max(1, spark.sparkContext.defaultParallelism))


def paths_from(g: Compact, sources: DataFrame, cells: int = 1 << 18) -> DataFrame:
    """(s, v, d, sigma) of all vertices that each source (s) reaches, itself included.

    The rows of a group of sources come vertex by vertex, in batches of about ``cells`` rows: v is then a run and s a pattern that comes again
    and again, which column stores keep in next to nothing. Source by source, v would never repeat within a store's reach.
    """
    sent = sources.sparkSession.sparkContext.broadcast(g)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = sent.value
        n = len(g.ids)
        for (s,) in _blocks(batches, g.group):
            at, known = g.places(s)
            alone = s[~known]
            if len(alone):
                yield _path_rows(alone, alone, np.zeros(len(alone), np.int32), np.ones(len(alone)))
            s, at = s[known], at[known]
            if not len(s):
                continue
            dist, sigma = np.empty((len(s), n), np.int32), np.empty((len(s), n))
            for k in range(0, len(s), g.block):
                found = Search(g, at[k : k + g.block])
                dist[k : k + g.block], sigma[k : k + g.block] = found.dist.reshape(-1, n), found.sigma.reshape(-1, n)
            step = max(1, cells // len(s))
            for k in range(0, n, step):
                d = dist[:, k : k + step].T
                v, row = np.nonzero(d >= 0)
                if len(v):
                    yield _path_rows(s[row], g.ids[k + v], d[v, row], sigma[row, k + v])

    return _dealt(sources.select(F.col("s").cast("long").alias("s")).filter("s is not null")).mapInArrow(work, "s bigint, v bigint, d int, sigma double")


def _path_rows(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["s", "v", "d", "sigma"])


def _pairs(g: Compact, samples: DataFrame, extra: list, schema: str, rows: Callable[[Search, list[np.ndarray]], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(sample, v, value) of the cells that ``rows`` gives for searches of samples (sample, s, z), ended at z; s and z differ."""
    sent = samples.sparkSession.sparkContext.broadcast(g)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = sent.value
        n = len(g.ids)
        for block in _blocks(batches, g.block):
            (s, s_in), (z, z_in) = g.places(block[1]), g.places(block[2])
            both = s_in & z_in
            if not both.any():
                continue
            block = [c[both] for c in block]
            cells, value = rows(Search(g, s[both], z[both]), block)
            yield pa.RecordBatch.from_arrays([pa.array(block[0][cells // n]), pa.array(g.ids[cells % n]), pa.array(value)], names=["sample", "v", "value"])

    longs = [F.col(c).cast("long").alias(c) for c in ("sample", "s", "z")]
    return _dealt(samples.select(*longs, *extra).filter("sample is not null and s <> z")).mapInArrow(work, schema)


def fractions(g: Compact, samples: DataFrame) -> DataFrame:
    """(sample, v, f): the share of shortest s-z paths with v inside."""
    return _pairs(g, samples, [], "sample bigint, v bigint, value double", lambda found, block: found.to_goals()).withColumnRenamed("value", "f")


def shares(g: Compact, samples: DataFrame, share: float, most: int) -> DataFrame:
    """(sample, v, f): of the paths drawn for each sample, see ``Search.shares``, the share with v inside."""
    return _pairs(g, samples, [], "sample bigint, v bigint, value double", lambda found, block: found.shares(block[0], share, most)).withColumnRenamed("value", "f")


def drawn(g: Compact, samples: DataFrame, stream) -> DataFrame:
    """(sample, v, d): inner vertices of one drawn path a sample."""

    def rows(found: Search, block: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        cells = found.draw(block[0], block[3])
        return cells, found.dist[cells]

    return _pairs(g, samples, [stream.cast("long").alias("stream")], "sample bigint, v bigint, value int", rows).withColumnRenamed("value", "d")
