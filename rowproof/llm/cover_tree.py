"""Embedding near-duplicates by dual traversal of cover trees: exact pairs above a cosine threshold.

Unit vectors at cosine c are sqrt(2 - 2c) apart, so the threshold is a distance. Equal vectors are one class.

* Upper level: every class goes to the nearest of some centres (fitted on a bounded sample). A cell with many classes
  is cut into rings by distance from its centre, so that one with a third of all rows is many blocks; a ring that is
  still too large, as its distances are equal, is cut by hash. A block holds about SPREAD times the square root of the
  number of classes (BLOCK at least), so there are that few blocks, and copies of a row grow with the root as well. No
  block has more than twice BLOCK_BYTES of vectors: larger tables get more blocks instead.
* Each block gets a cover tree, made once: nested levels with halving radii, from 1 down to the first below the
  threshold's distance, each node with its measured covering radius.
* Blocks are numbered. A class meets its own block, and each earlier-numbered block's classes visit it: those whose
  distance to the block's centre is within its ring, widened by the threshold, and no others. The block is held, its
  visitors stream past it block by block, for GROUP blocks a task; each time both trees are descended, node pairs are
  pruned by the covering radii, and the cosines of what is left are computed in double precision.
* Nodes of a level meet in whole matrices of products, first in a few directions in which vectors are widest: parts there
  and the lengths of the rest bound the cosine from above. Few hits go on pair by pair, many as matrices of what the nodes
  hold. Levels with nearly as many nodes as the next are passed over, as a wide node of two rows prunes nothing.

A task returns a row per vector (how many others it links with) and a spanning set of links, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowproof.llm.common import small_batches, table, written
from rowproof.llm.components import components
from rowproof.llm.multi_index import codebook
from rowproof.llm.vectors import matrix, packed, unit, unpacked

#: Classes that centres are fitted on at most; least size of a block, and its size by the root of the number of classes.
SAMPLE, BLOCK, SPREAD = 16_384, 4096, 40
#: Blocks whose classes visit a block in one task.
GROUP = 8
#: Vectors of a block, in bytes as doubles; bytes of the distances that a task holds at a time.
BLOCK_BYTES, HELD_BYTES = 64 << 20, 64 << 20
#: Nodes whose inner products with a block's are in one matrix; node or row pairs up to which members are paired one by one.
TILE, FEW = (512, 1024), 512
#: Slack for rounding in pruning, which is done in single precision; cosines of pairs that are left are exact.
SLACK = 1e-4


#: Rows or nodes of two trees: a pair at each place, or, if the last is true, each of the first with each of the second.
Met = tuple[np.ndarray, np.ndarray, bool]


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x @ y.T)))


def _cosines(x: np.ndarray, i: np.ndarray, y: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of rows i of x and rows j of y, a pair at each place."""
    out, step = np.empty(len(i)), max(1, HELD_BYTES // (16 * x.shape[1]))
    for k in range(0, len(i), step):
        out[k : k + step] = np.einsum("ij,ij->i", x[i[k : k + step]], y[j[k : k + step]])
    return out


def _hits(products: np.ndarray, least: float) -> np.ndarray:
    """Places in the matrix, row by row, of what is not below `least`."""
    hit = (products >= least).reshape(-1)
    if len(hit) % 8:
        return np.flatnonzero(hit)
    eights = np.flatnonzero(hit.view(np.uint64) != 0)  # hits are rare: eight places at a time
    at = np.flatnonzero(hit.reshape(-1, 8)[eights].reshape(-1))
    return eights[at >> 3] * 8 + (at & 7)


def directions(x: np.ndarray, distance: float) -> np.ndarray | None:
    """Orthonormal columns, in which most rows of x that are farther apart than the distance show it; None: no gain.

    Rows' inner products are at most those of their parts in these directions, and the lengths of the rest multiplied.
    The widest directions of x are taken, as many as cost least on pairs of rows: a direction's part in a product costs
    one, a pair that is left 5,000.
    """
    n, dims = x.shape
    wide = np.linalg.qr(np.random.default_rng(0).normal(size=(dims, min(dims, 64))))[0]
    for _ in range(3):
        wide = np.linalg.qr(x.T @ (x @ wide))[0]
    wide = wide @ np.linalg.svd(x @ wide, full_matrices=False)[2].T
    some, best, least = x[:: max(1, n // 512)][:512], None, float(dims)
    for k in range(4, wide.shape[1] + 1, 4):
        y = _parts(some, wide[:, :k])
        share = (y @ y.T >= 1.0 - 0.5 * distance * distance - SLACK).sum() / max(1, len(y) ** 2) - 1 / max(1, len(y))
        if k + 5000 * share < least:
            best, least = wide[:, :k], k + 5000 * share
    return best


def _parts(x: np.ndarray, wide: np.ndarray) -> np.ndarray:
    """Rows' parts in these directions, and the lengths of the rest."""
    y = x @ wide
    return np.concatenate([y, np.sqrt(np.maximum(0.0, 1.0 - (y * y).sum(axis=1, keepdims=True)))], axis=1).astype(np.float32)


def radii(distance: float) -> list[float]:
    """1, 1/2, 1/4 and so on, down to the first below the distance, which is more than 0; three at least."""
    return [0.5**i for i in range(max(3, math.floor(-math.log2(distance)) + 2))]


def block_size(n: int, dims: int) -> int:
    """Classes of a block, of n in all."""
    return max(1, min(max(BLOCK, int(SPREAD * math.sqrt(n))), BLOCK_BYTES // (8 * max(dims, 1))))


def nearest_centres(x: np.ndarray, levels_at: list[float]) -> np.ndarray:
    """A row per radius: for each row of x the row of its nearest centre on that level.

    Centres are nested: those of a level are more than its radius apart, and no row is farther than the radius
    from its centre. A centre's distances are computed once, for many centres at a time.
    """
    near, far, levels = np.zeros(len(x), np.int64), np.full(len(x), np.inf), []
    coarse = x.astype(np.float32)
    for r in levels_at:
        for i in range(0, len(x), 256):
            open_ = i + np.flatnonzero(far[i : i + 256] > r)
            if not len(open_):
                continue
            apart = _distances(x[open_], x[open_]) > r
            free, new = np.ones(len(open_), bool), []
            for k in range(len(open_)):
                if free[k]:
                    new.append(open_[k])
                    free &= apart[k]
            new = np.array(new)
            near[new], far[new] = new, 0.0
            others = np.flatnonzero(far > 0)  # centres stay their own
            step = max(1, min(TILE[1], HELD_BYTES // (16 * max(len(new), x.shape[1]))))
            for j in range(0, len(others), step):
                part = others[j : j + step]
                at = _hits(coarse[part] @ coarse[new].T, 1.0 - 0.5 * r * r - SLACK)  # a row gets a centre within r, or becomes one
                if len(at) * 16 > len(part) * len(new):
                    d = _distances(x[part], x[new])
                    to = d.argmin(axis=1)
                    d, to = d[np.arange(len(d)), to], new[to]
                else:  # few are that close
                    row, to = at // len(new), new[at % len(new)]
                    d = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * _cosines(x, part[row], x, to)))
                    first = np.unique(row[order := np.lexsort((to, d, row))], return_index=True)[1]
                    part, d, to = part[row[order[first]]], d[order[first]], to[order[first]]
                closer = d < far[part]
                near[part[closer]], far[part[closer]] = to[closer], d[closer]
        levels.append(near.copy())
    return np.stack(levels)


class CoverTree:
    """Nested levels of nodes over the rows of x. A node is a centre row; levels[0] is the coarsest.

    near is what nearest_centres() says of a block, at which of its rows (in order) x has; all by default. members lists, level by level and node by node, what a node holds:
    nodes of the next level, or rows at the last one; starts has where each node's list begins; radius is the
    greatest distance to a row below. parts has the rows in the directions `wide`, or whole rows without any.
    """

    def __init__(self, x: np.ndarray, near: np.ndarray, at: np.ndarray | None = None, wide: np.ndarray | None = None):
        self.x, self.coarse = x, x.astype(np.float32)
        self.parts = self.coarse if wide is None else _parts(x, wide)
        self.centre, home = [], []
        for c in near:
            ids, first, own = np.unique(c, return_index=True, return_inverse=True)
            if at is not None:  # some rows of a block: where a centre is not among them, the first row stands for it
                place = np.minimum(np.searchsorted(at, ids), len(at) - 1)
                ids = np.where(at[place] == ids, place, first)
            self.centre.append(ids)
            home.append(own)
        self.members, self.starts, self.radius = [], [], []
        below = home[-1]  # of each row: its node on the level at hand
        for level in range(len(near) - 1, -1, -1):
            held = home[-1]
            if level < len(near) - 1:
                held = home[level][self.centre[level + 1]]
                below = held[below]
            order = np.argsort(held, kind="stable")
            radius = np.zeros(len(self.centre[level]))
            np.maximum.at(radius, below, np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x * x[self.centre[level][below]]).sum(axis=1))))
            self.members.insert(0, order)
            self.starts.insert(0, np.searchsorted(held[order], np.arange(len(self.centre[level]) + 1)))
            self.radius.insert(0, radius)

    def held(self, level: int, node: int) -> np.ndarray:
        return self.members[level][self.starts[level][node] : self.starts[level][node + 1]]


def _within(a: CoverTree, b: CoverTree, level: int, p: np.ndarray, q: np.ndarray, distance: float) -> np.ndarray:
    """Of nodes p of a and q of b, a pair at each place: true where rows of both may be within the distance."""
    cosines = _cosines(a.coarse, a.centre[level][p], b.coarse, b.centre[level][q])
    return cosines >= 1.0 - SLACK - 0.5 * (a.radius[level][p] + b.radius[level][q] + distance) ** 2


def _nodes_met(a: CoverTree, b: CoverTree, level: int, left: np.ndarray, right: np.ndarray, distance: float) -> Iterator[Met]:
    """Pairs of nodes, one of each list, that may hold a pair within the distance.

    Nodes of about one radius are together, so one bound holds for a matrix of products. Products of the nodes' parts
    are not below those of whole centres; pairs that these leave are judged by the centres and their own radii.
    """

    def bands(t: CoverTree, nodes: np.ndarray) -> list[tuple[float, np.ndarray, np.ndarray]]:
        radius = t.radius[level][nodes]
        band = np.searchsorted([1e-6, 0.0625, 0.125, 0.25, 0.5, 0.75], radius)
        return [(radius[own].max(), nodes[own], t.parts[t.centre[level][nodes[own]]]) for own in (np.flatnonzero(band == k) for k in np.unique(band))]

    for r, p, x in bands(a, left):
        for s, q, y in bands(b, right):
            for j in range(0, len(q), TILE[1]):
                across = np.ascontiguousarray(y[j : j + TILE[1]].T)
                for i in range(0, len(p), TILE[0]):
                    at = _hits(x[i : i + TILE[0]] @ across, 1.0 - SLACK - 0.5 * (r + s + distance) ** 2)
                    u, v = p[i : i + TILE[0]], q[j : j + TILE[1]]
                    if len(at) * 16 > len(u) * len(v):  # not few: all centres of the matrix at once
                        reach = (a.radius[level][u][:, None] + (b.radius[level][v] + distance)).astype(np.float32)
                        hit = a.coarse[a.centre[level][u]] @ b.coarse[b.centre[level][v]].T >= 1.0 - SLACK - 0.5 * reach * reach
                        if np.count_nonzero(hit) * 16 > hit.size:
                            yield u[hit.any(axis=1)], v[hit.any(axis=0)], True
                        else:
                            row, column = np.nonzero(hit)
                            yield u[row], v[column], False
                    elif len(at):
                        u, v = u[at // len(v)], v[at % len(v)]
                        good = _within(a, b, level, u, v, distance)
                        yield u[good], v[good], False


def _members_met(a: CoverTree, b: CoverTree, level: int, p: np.ndarray, q: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Members of nodes p of a with members of nodes q of b, a pair of nodes at each place: all pairs, some at a time."""
    start, other = a.starts[level][p], b.starts[level][q]
    n = b.starts[level][q + 1] - other
    ends = np.cumsum((a.starts[level][p + 1] - start) * n)
    step = max(1, HELD_BYTES // (32 * a.x.shape[1]))
    for i in range(0, int(ends[-1]) if len(ends) else 0, step):
        flat = np.arange(i, min(i + step, int(ends[-1])))
        pair = np.searchsorted(ends, flat, side="right")
        flat -= np.where(pair > 0, ends[pair - 1], 0)
        yield a.members[level][start[pair] + flat // n[pair]], b.members[level][other[pair] + flat % n[pair]]


def _gathered(met: Iterator[Met]) -> Iterator[Met]:
    """The same, with single pairs in fewer and longer arrays."""
    held, n = [], 0

    def taken() -> Met:
        return np.concatenate([u for u, _ in held]), np.concatenate([v for _, v in held]), False

    for u, v, crossed in met:
        if crossed:
            yield u, v, True
            continue
        held.append((u, v))
        n += len(u)
        if n >= 1 << 17:
            yield taken()
            held, n = [], 0
    if n:
        yield taken()


def _by_size(a: CoverTree, b: CoverTree, level: int, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """Pairs of nodes with few pairs of members; and each other node of a with all that it meets."""
    sizes = np.diff(a.starts[level])[p] * np.diff(b.starts[level])[q]
    few = sizes <= FEW
    p, q, large, with_ = p[few], q[few], p[~few], q[~few]
    order = np.argsort(large, kind="stable")
    nodes, first = np.unique(large[order], return_index=True)
    return p, q, list(zip(nodes.tolist(), np.split(with_[order], first[1:]), strict=True)) if len(nodes) else []


def _below(a: CoverTree, b: CoverTree, level: int, met: Iterator[Met], distance: float) -> Iterator[Met]:
    """Of nodes met on a level, the nodes of the next one that may hold rows within the distance; of leaf nodes, the rows."""
    last = level == len(a.centre) - 1

    def crossed_(p: np.ndarray, q: np.ndarray) -> Iterator[Met]:
        u, v = (np.concatenate([t.held(level, k) for k in nodes.tolist()]) for t, nodes in ((a, p), (b, q)))
        return iter([(u, v, True)]) if last else _nodes_met(a, b, level + 1, u, v, distance)

    for p, q, crossed in _gathered(met):
        if crossed:
            yield from crossed_(p, q)
            continue
        p, q, large = _by_size(a, b, level, p, q)
        for u, v in _members_met(a, b, level, p, q):
            if not last:
                good = _within(a, b, level + 1, u, v, distance)
                u, v = u[good], v[good]
            yield u, v, False
        for node, others in large:
            yield from crossed_(np.array([node]), others)


def near_rows(a: CoverTree, b: CoverTree, distance: float) -> Iterator[Met]:
    """Rows of a and of b that may be within the distance: both trees are descended.

    The first levels are passed over where the next has less than twice the nodes: wide nodes of few rows prune little.
    """
    top, last = 0, len(a.centre) - 1
    while top < last and all(len(t.centre[top + 1]) < 2 * len(t.centre[top]) for t in (a, b)):
        top += 1
    met = _nodes_met(a, b, top, np.arange(len(a.centre[top])), np.arange(len(b.centre[top])), distance)
    for level in range(top, last + 1):
        met = _below(a, b, level, met, distance)
    return met


def _lowest(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For 0 to n - 1 the smallest number that it reaches by the links of u with v."""
    low = np.arange(n)
    while True:
        least, before = np.minimum(low[u], low[v]), low.copy()
        for x in (u, v, before[u], before[v]):
            np.minimum.at(low, x, least)
        low = low[low]
        if (low == before).all():
            return low


def _joining(link: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Some links of a link matrix (two rows of ids) that join what all of them join.

    Each row and each column with a link to another component takes its first one, until there is none.
    """
    rows, columns = link.shape
    u, v, low, open_ = np.zeros(0, np.int64), np.zeros(0, np.int64), None, link
    while True:
        first, first_row = open_.argmax(axis=1), open_.argmax(axis=0)
        row, column = np.flatnonzero(open_[np.arange(rows), first]), np.flatnonzero(open_[first_row, np.arange(columns)])
        if not len(row):
            break
        u, v = np.concatenate([u, row, first_row[column]]), np.concatenate([v, rows + first[row], rows + column])
        low = _lowest(rows + columns, u, v)
        if low[u].max() == low[u].min():
            break
        open_ = link & (low[:rows, None] != low[None, rows:])
    ids = np.concatenate([left, right])
    return np.stack([ids[u], ids[v]])


def _planted(t: pa.Table, levels_at: list[float], kind: str = "f4") -> pa.Table:
    """A block's rows with their number in it and their nearest centres: what its cover tree is made of."""
    near = nearest_centres(unit(unpacked(t.column("v"), kind)), levels_at).astype(np.int32)
    lists = pa.ListArray.from_arrays(np.arange(0, near.size + 1, len(near), dtype=np.int32), pa.array(near.T.ravel()))
    return t.append_column("at", pa.array(np.arange(t.num_rows, dtype=np.int32))).append_column("near", lists)


class _Side:
    """A block's rows, or those of them that visit another, and their tree."""

    def __init__(self, t: pa.Table, wide: np.ndarray | None = None, kind: str = "f4"):
        t = t.sort_by("at")
        self.rep, self.h, self.n = (t.column(c).to_numpy() for c in ("rep", "h", "n"))
        self.tree = CoverTree(unit(unpacked(t.column("v"), kind)), matrix(t.column("near"), np.int64).T, t.column("at").to_numpy(), wide)
        self.links = np.zeros(len(self.rep), np.int64)

    def counts(self) -> list[np.ndarray]:
        some = self.links > 0
        return [self.rep[some], self.h[some], self.links[some]]


def _spanning(edges: list[np.ndarray]) -> np.ndarray:
    """Links (two rows of ids each) that join what these join: each id with the smallest that it reaches, if another."""
    if not edges:
        return np.zeros((2, 0), np.int64)
    ids, at = np.unique(np.concatenate(edges, axis=1), return_inverse=True)
    low = _lowest(len(ids), *at.reshape(2, -1))
    return np.stack([ids, ids[low]])[:, low != np.arange(len(ids))]


def _pair(a: _Side, b: _Side, cosine: float) -> np.ndarray:
    """Add to both sides' numbers of links (once where they are the same); returns spanning links (two rows of ids)."""
    edges: list[np.ndarray] = []
    for u, v, crossed in near_rows(a.tree, b.tree, math.sqrt(max(0.0, 2.0 - 2.0 * cosine))):
        if crossed:
            for i in range(0, len(u), 1024):
                for j in range(0, len(v), 2048):
                    edges += _linked(a, b, u[i : i + 1024], v[j : j + 2048], cosine)
        else:
            link = _cosines(a.tree.x, u, b.tree.x, v) >= cosine
            if a is b:
                link &= u != v
            u, v = u[link], v[link]
            np.add.at(a.links, u, b.n[v])
            if a is not b:
                np.add.at(b.links, v, a.n[u])
            edges.append(np.stack([a.rep[u], b.rep[v]]))
        if sum(e.shape[1] for e in edges) > 1 << 20 or len(edges) > 4096:
            edges = [_spanning(edges)]
    return _spanning(edges)


def _linked(a: _Side, b: _Side, rows: np.ndarray, other: np.ndarray, cosine: float) -> list[np.ndarray]:
    """_pair() for all rows of a list with all of another: in single precision, and where that leaves it open in double."""
    products = a.tree.coarse[rows] @ b.tree.coarse[other].T
    link = products >= cosine + SLACK
    open_ = _hits((products >= cosine - SLACK) != link, True)
    if len(open_) * 16 > link.size:
        link = a.tree.x[rows] @ b.tree.x[other].T >= cosine
    elif len(open_):
        link.reshape(-1)[open_] = _cosines(a.tree.x, rows[open_ // len(other)], b.tree.x, other[open_ % len(other)]) >= cosine
    if a is b:
        link &= rows[:, None] != other[None, :]
    if not link.any():
        return []

    def added(links: np.ndarray, n: np.ndarray) -> np.ndarray:
        if n.sum() < 1 << 24:  # exact in single precision
            return (links.astype(np.float32) @ n.astype(np.float32)).astype(np.int64)
        return links @ n

    a.links[rows] += added(link, b.n[other])
    if a is not b:
        b.links[other] += added(link.T, a.n[rows])
    return [_joining(link, a.rep[rows], b.rep[other])]


def _met(batches: Iterator[pa.RecordBatch], cosine: float, wide: np.ndarray | None, kind: str) -> Iterator[pa.RecordBatch]:
    """Blocks with their visitors, block by block -> (rep, h, links, low): numbers of links, and spanning links."""

    def found(counts: list[np.ndarray], edges: np.ndarray) -> pa.RecordBatch:
        n, e = len(counts[0]), edges.shape[1]
        columns = [np.concatenate([counts[0], edges[0]]), np.concatenate([counts[1], np.zeros(e, np.int64)]), np.concatenate([counts[2], np.zeros(e, np.int64)])]
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(edges[1])])], ["rep", "h", "links", "low"])

    def met(key: tuple, t: pa.Table, held: _Side | None) -> tuple[_Side | None, list[pa.RecordBatch]]:
        block, group, side, _ = key
        own = _Side(t, wide, kind)
        if side == 0:  # the block itself; it meets itself in the task of its own group
            return own, [found([np.zeros(0, np.int64)] * 3, _pair(own, own, cosine))] if group == block // GROUP else []
        edges = _pair(held, own, cosine)
        return held, [found(own.counts(), edges)]

    key, rows, held = None, [], None
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("block", "group", "side", "from_")], axis=1)
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
            if a == b:
                continue
            own = tuple(keys[a].tolist())
            if own != key and rows:
                before = held
                held, out = met(key, pa.Table.from_batches(rows), held)
                yield from out
                if before is not None and before is not held:
                    yield found(before.counts(), np.zeros((2, 0), np.int64))
                rows = []
            key = own
            rows.append(batch.slice(a, b - a))
    if rows:
        before = held
        held, out = met(key, pa.Table.from_batches(rows), held)
        yield from out
        for x in {id(x): x for x in (before, held) if x is not None}.values():
            yield found(x.counts(), np.zeros((2, 0), np.int64))


def near_vectors(df: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per input row; ids are whole numbers.

    Vectors with cosine >= `cosine` are linked; n_links counts the other rows linked directly (repeated rows count
    each), component_id is the smallest id that links reach; different vectors of one id have links of their own, and
    reach what any of them does. Null and zero vectors, vectors with null or
    non-finite components and rows without an id link with nothing; vectors of different lengths never link. An
    empty table gives no rows.
    """
    spark = df.sparkSession
    small_batches(spark)
    kind = "f4" if df.schema[vector_col].dataType.elementType.typeName() == "float" else "f8"
    x = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<float>" if kind == "f4" else "array<double>").alias("v"))
    x = x.mapInArrow(lambda batches: _keyed(batches, kind), "vec_id long, v binary")
    classes = written(x.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")).withColumn("h", F.xxhash64("v")), "vector-classes")
    sizes = [r.bytes for r in classes.select(F.octet_length("v").alias("bytes")).distinct().collect()]  # few: a model gives one length
    links, edges = None, None
    for bytes_ in sizes:
        found = _found(classes.where(F.octet_length("v") == bytes_), cosine, bytes_ // int(kind[1]), kind)
        links = found if links is None else links.unionByName(found)
    if links is None:
        return x.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    links = written(links, "vector-links")
    edges = components(links.where("low is not null").select(F.col("rep").alias("a"), F.col("low").alias("b")))
    counts = links.groupBy("rep", "h").agg(F.sum("links").alias("links"))
    per_class = classes.join(counts, ["rep", "h"], "left").join(edges.withColumnRenamed("node", "rep"), "rep", "left")
    per_class = per_class.select("v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = x.join(per_class, "v", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _keyed(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes, which Spark compares as they are; none where a vector or an id is of no use."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), packed(batch.column("v"), batch.column("vec_id").is_valid(), kind)], ["vec_id", "v"])


def _found(classes: DataFrame, cosine: float, dims: int, kind: str) -> DataFrame:
    """(rep, h, links, low) from all blocks; vectors of one length."""
    spark, n = classes.sparkSession, classes.count()
    size = block_size(n, dims)
    picked = classes.select("v").orderBy(F.xxhash64(F.col("rep").cast("string")), "rep", "v").limit(SAMPLE)  # by a hash of ids
    some = unit(unpacked(picked.toArrow().column(0), kind))
    top = codebook(some, -(-n // size))
    reach = math.sqrt(max(0.0, 2.0 - 2.0 * cosine)) + SLACK
    wide = directions(some, reach)
    levels_at = radii(reach)

    def far(x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, 1.0 + (top * top).sum(axis=1) - 2.0 * (x @ top.T)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = far(unit(unpacked(batch.column("v"), kind)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("rep", "h", "n", "v")), pa.array(d.argmin(axis=1)), pa.array(d.min(axis=1))], ["rep", "h", "n", "v", "cell", "far"])

    placed = written(classes.select("rep", "h", "n", "v").mapInArrow(assign, "rep long, h long, n long, v binary, cell long, far double"), "vector-cells")
    held = placed.groupBy("cell").agg(F.count("*").alias("held"), F.percentile_approx("far", [i / 64 for i in range(1, 64)], 1000).alias("cuts"))
    rings = F.ceil(F.col("held") / size)
    cuts = F.filter("cuts", lambda c, i: F.floor((i + 1) * rings / 64) > F.floor(i * rings / 64))  # up to 64 rings a cell
    ringed = placed.join(F.broadcast(held.select("cell", cuts.alias("cuts"))), "cell")  # a row per cell
    ringed = ringed.withColumn("ring", F.size(F.filter("cuts", lambda c: c <= F.col("far"))))
    found = ringed.groupBy("cell", "ring").agg(F.count("*").alias("held"), F.min("far").alias("low"), F.max("far").alias("high")).orderBy("cell", "ring").collect()  # as many as blocks
    blocks = [(r["cell"], r["ring"], r["low"], r["high"], piece, -(-r["held"] // (2 * size))) for r in found for piece in range(-(-r["held"] // (2 * size)))]
    cell, low, high = (np.array([b[i] for b in blocks]) for i in (0, 2, 3))
    numbers = spark.createDataFrame([(b[0], b[1], b[4], b[5], i) for i, b in enumerate(blocks)], "cell long, ring int, piece long, pieces long, block long")
    sizes = numbers.select("cell", "ring", "pieces").distinct()
    ringed = ringed.join(F.broadcast(sizes), ["cell", "ring"]).withColumn("piece", F.pmod(F.col("h"), F.col("pieces")))  # a row per block at most
    planted = ringed.join(F.broadcast(numbers.drop("pieces")), ["cell", "ring", "piece"]).select("rep", "h", "n", "v", "block")
    planted = written(planted.groupBy("block").applyInArrow(lambda t: _planted(t, levels_at, kind), "rep long, h long, n long, v binary, block long, at int, near array<int>"), "vector-trees")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("block").to_numpy()
            d = far(unit(unpacked(batch.column("v"), kind)))[:, cell]
            visits = (d >= low - reach) & (d <= high + reach) & (np.arange(len(blocks)) > own[:, None])
            for side in (0, 1):
                if side == 0:  # its own block, for each group of visitors
                    times = own // GROUP + 1
                    row = np.repeat(np.arange(len(own)), times)
                    block, group = own[row], np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                else:
                    row, block = np.nonzero(visits)
                    group = own[row] // GROUP
                for i in range(0, len(row), 4096):
                    part = pa.array(row[i : i + 4096])
                    keys = [block[i : i + 4096], group[i : i + 4096], np.full(len(part), side), own[row[i : i + 4096]]]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, keys), *(batch.column(c).take(part) for c in ("rep", "h", "n", "v", "at", "near"))], ["block", "group", "side", "from_", "rep", "h", "n", "v", "at", "near"])

    key = ["block", "group"]
    dealt = planted.mapInArrow(deal, "block long, group long, side long, from_ long, rep long, h long, n long, v binary, at int, near array<int>")
    keys = sum(i // GROUP + 1 for i in range(len(blocks)))
    dealt = dealt.repartition(max(4 * keys, int(spark.conf.get("spark.sql.shuffle.partitions"))), *key).sortWithinPartitions(*key, "side", "from_", "at")
    return dealt.mapInArrow(lambda it: _met(it, cosine, wide, kind), "rep long, h long, links long, low long")


def op4_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between vectors with a cosine of 0.95 or more: their number, and the smallest id that they reach."""
    return near_vectors(table(spark, sf_dir, "embeddings"))
