"""Embedding near-duplicates (operator 4): dual traversal of cover trees, exact pairs.

The top level cuts the vectors into nodes around a bounded number of centers, each with
the exact radius that covers its vectors; nodes hold blocks, each with a cover tree of
nested levels whose radii halve.  Node pairs are pruned, or linked as wholes, by their
centers' distance and covering radii.  What the bounds leave open is compared by matrix
products in single precision, which settle what is clear; the rest is decided in double
precision.

A task holds some blocks (its home) while others stream past.  Tasks run in rounds whose
blocks are at most half of the table's vectors, and a round's shuffle files go with it:
disk stays in proportion to the input however many block pairs stay open."""

from __future__ import annotations

import hashlib
import pickle
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsift.llm.common import partitions, release_memory, settings, stage
from logsift.llm.components import components

BLOCK = 16384  # vectors of a block, at most
BLOCK_BYTES = 4 << 20  # and their bytes
MIN_BLOCK = 4096  # smaller tables are cut into 8 blocks, but into none smaller than this
HOME_BYTES = 64 << 20  # vectors that a task holds, and vectors that stream past them
ROUND_BYTES = 256 << 20  # a round may shuffle so much at least
MAX_CENTERS = 4096  # of the top level, for one dimension count, at most
SAMPLE = 32768  # vectors among which they are sought
LEAF = 64  # nodes with no more vectors are not split
HEAD = 23  # components that are compared first
TILE = 1 << 18  # products held at once
EPS = 1e-7  # a bound must clear the threshold by this much (a distance near 0 is off by 2e-8)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # no overflow or underflow in the squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _vectors(col: pa.Array):
    """(rows, vectors) by length, without rows that are null, empty, zero, or hold a null or
    non-finite component."""
    off = col.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.fill_null(col.values.slice(off[0], off[-1] - off[0]), float("nan")).to_numpy(zero_copy_only=False)
    size = np.where(col.is_valid().to_numpy(zero_copy_only=False), np.diff(off), 0)
    for dim in np.unique(size[size > 0]).tolist():
        at = np.flatnonzero(size == dim)
        x = flat[(off[at] - off[0])[:, None] + np.arange(dim)]
        ok = np.isfinite(x).all(1) & x.any(1)
        if ok.any():
            yield at[ok], x[ok]


def read_vectors(rows: DataFrame, id_col: str, vec_col: str, whole: bool) -> DataFrame:
    """(vec_id, dim, key: digest of the unit vector in double precision; null if it
    can't link), and with ``whole`` the vector's bytes, as single floats if it has these."""
    single = isinstance(rows.schema[vec_col].dataType, T.ArrayType) and isinstance(rows.schema[vec_col].dataType.elementType, T.FloatType)
    names = ["vec_id", "dim", "key", "vec"][:3 + whole]

    def run(batches):
        for b in batches:
            for s in range(0, b.num_rows, 2000):
                part = b.slice(s, 2000)
                dims, keys, vecs = ([None] * part.num_rows for _ in range(3))
                for at, x in _vectors(part.column("vec")):
                    units = _unit(x)
                    for i, r in enumerate(at.tolist()):
                        dims[r], keys[r] = x.shape[1], hashlib.md5(units[i]).digest()
                        if whole:
                            vecs[r] = x[i].tobytes()
                cols = [part.column("vec_id"), pa.array(dims, pa.int32()), pa.array(keys, pa.binary()), pa.array(vecs, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols[:len(names)], names=names)

    src = rows.select(F.col(id_col).cast("long").alias("vec_id"),
                      F.col(vec_col).cast("array<float>" if single else "array<double>").alias("vec"))
    return (src.mapInArrow(run, "vec_id long, dim int, key binary" + ", vec binary" * whole)
            .withColumn("key", F.when(F.col("vec_id").isNotNull(), F.col("key"))))


def _stack(vecs: bytes, dim: int, rows: int) -> np.ndarray:
    return np.frombuffer(vecs, np.float32 if len(vecs) == 4 * dim * rows else np.float64).reshape(rows, dim)


def _far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances between unit vectors."""
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def _error(dim: int) -> float:
    """More than a product of unit vectors in single precision is off by."""
    return 1.2e-7 * (dim + 8)


def _net(x: np.ndarray, radius: float, most: int) -> np.ndarray:
    """Places of vectors, the first one among them, further than ``radius`` from each other
    that cover ``x`` within it; if they are more than ``most``, the first of them."""
    near = 1 - radius * radius / 2
    left, got, found = np.arange(len(x)), [], 0
    while len(left) and found <= most:
        head = left[:256]
        close, free, new = x[head] @ x[head].T >= near, np.ones(len(head), bool), []
        for i in range(len(head)):
            if free[i]:
                new.append(head[i])
                free &= ~close[i]
        got.append(np.array(new))
        found += len(new)
        left = left[len(head):]
        left = left[(x[left] @ x[got[-1]].T < near).all(1)]
    return np.concatenate(got)


class Tree:
    """Cover tree of a block.  ``order`` lists its vectors so that every node of every level
    is a run that begins with its center; a level has its nodes' starts, radii and parents.

    A level halves the radius.  Vectors that gather around no center of the finer level stay
    together in one child; a node in which none gather is not split."""

    def __init__(self, x: np.ndarray, smallest: float):
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        nodes, parent, done = [np.arange(len(x))], [0], [False]
        single = x.astype(np.float32)
        while True:
            order = np.concatenate(nodes)
            start = np.concatenate([[0], np.cumsum([len(n) for n in nodes])])
            center = np.repeat(order[start[:-1]], np.diff(start))
            reach = np.sqrt(np.maximum(2 - 2 * np.einsum("ij,ij->i", x[order], x[center]), 0))
            radius = np.maximum.reduceat(reach, start[:-1])
            self.levels.append((start, radius, np.array(parent)))
            finer, parent, kept = [], [], []
            for i, n in enumerate(nodes):
                parts = [] if done[i] or len(n) <= LEAF or radius[i] <= smallest else self._split(single, n, radius[i] / 2)
                finer += parts or [n]
                kept += [not parts] * (len(parts) or 1)
                parent += [i] * (len(parts) or 1)
            if len(finer) == len(nodes):
                break
            nodes, done = finer, kept
        self.order = order

    @staticmethod
    def _split(x: np.ndarray, n: np.ndarray, radius: float) -> list[np.ndarray]:
        """Children of the node's vectors ``n``: those within ``radius`` of a center each, and
        the rest; none if no center has 4 of the sampled vectors around it."""
        near = 1 - radius * radius / 2
        some = n[::-(-len(n) // 512)]
        net = some[_net(x[some], radius, len(some))]
        g = x[some] @ x[net].T
        met = np.bincount(g.argmax(1)[g.max(1) >= near], minlength=len(net))
        if met.max() < 4:
            return []
        net = net[(met >= 4) | (np.arange(len(net)) == 0)]  # a node's center is its first child's center: levels are nested
        g = x[n] @ x[net].T
        child = np.where(g.max(1) >= near, g.argmax(1), len(net))
        at = np.full(len(x), -1)
        at[net] = np.arange(len(net))
        child = np.where(at[n] >= 0, at[n], child)
        parts = [np.concatenate([net[i:i + 1], part[part != net[i]]]) for i, part in enumerate(n[child == i] for i in range(len(net)))]
        rest = n[child == len(net)]
        return parts + [rest] * bool(len(rest)) if len(parts) + bool(len(rest)) > 1 else []


class Block:
    """Vectors of a block in its tree's order, and what is found of them: ``n`` links each."""

    def __init__(self, row: dict):
        self.dim, self.place = row["dim"], row["place"]
        self.ids, self.ms = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["ms"], np.int64)
        self.raw = _stack(row["vecs"], self.dim, len(self.ids))
        self.levels = pickle.loads(row["tree"])
        self.n = np.zeros(len(self.ids), np.int64)
        self.single = np.concatenate([_unit(self.raw[s:s + 2000]).astype(np.float32) for s in range(0, len(self.raw), 2000)])
        self.heads = None
        self._centers: dict[int, np.ndarray] = {}

    def level(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, centers and radii of a level; below the last one the same nodes go on."""
        k = min(k, len(self.levels) - 1)
        start, radius, _ = self.levels[k]
        if k not in self._centers:
            self._centers[k] = _unit(self.raw[start[:-1]])
        return start, self._centers[k], radius

    def children(self, k: int) -> np.ndarray:
        """First child at level k of each node of the level above (one more at the end);
        below the last level every node is its own child."""
        if not 0 < k < len(self.levels):
            return np.arange(len(self.level(k)[2]) + 1)
        return np.searchsorted(self.levels[k][2], np.arange(len(self.levels[k - 1][1]) + 1))

    def look(self, first: np.ndarray) -> None:
        """Some components and the norm of the others: two blocks' products of these are not
        below the products of their vectors."""
        if len(first) < self.dim and self.heads is None:
            rest = np.setdiff1d(np.arange(self.dim), first)
            self.heads = np.concatenate([self.single[:, first], np.sqrt((self.single[:, rest] ** 2).sum(1, keepdims=True))], 1)


def _open_pairs(p: np.ndarray, q: np.ndarray, most: int):
    """Chunks of the pairs of members of the runs ``p`` and ``q`` (start, end), pair by pair."""
    n = (p[:, 1] - p[:, 0]) * (q[:, 1] - q[:, 0])
    met = np.cumsum(n)
    for a in range(0, int(met[-1]) if len(met) else 0, most):
        k = np.arange(a, min(a + most, int(met[-1])))
        at = np.searchsorted(met, k, "right")
        left = k - (met[at] - n[at])
        wide = q[at, 1] - q[at, 0]
        yield p[at, 0] + left // wide, q[at, 0] + left % wide


def dual(a: Block, b: Block, limit: float):
    """Yield (node runs of a, node runs of b, None) where all vectors of a run of a link
    with all of the run of b, and (runs of a, runs of b, their radii) whose vectors the
    bounds leave open; a run is its start, where its center is, and its end."""
    cut = float(np.sqrt(2 - 2 * limit))
    alive = np.zeros(1, np.int64), np.zeros(1, np.int64)
    for k in range(max(len(a.levels), len(b.levels))):
        (sa, ca, ra), (sb, cb, rb) = a.level(k), b.level(k)
        kept = []
        if k <= 1:  # all children of the two roots
            chunks = ((np.arange(s, min(s + 512, len(ca))), None) for s in range(0, len(ca), 512))
        else:
            p, q = (np.stack([c[i], c[i + 1]], 1) for c, i in zip((a.children(k), b.children(k)), alive))
            chunks = _open_pairs(p, q, (1 << 22) // a.dim + 1)
        for i, j in chunks:
            if j is None:
                d, r = _far(ca[i], cb), ra[i][:, None] + rb[None]
                p, q = np.nonzero(d - r <= cut + EPS)
                d, r, i, j = d[p, q], r[p, q], i[p], q
            else:
                d = np.sqrt(np.maximum(2 - 2 * np.einsum("ij,ij->i", ca[i], cb[j]), 0))
                r = ra[i] + rb[j]
                ok = d - r <= cut + EPS
                d, r, i, j = d[ok], r[ok], i[ok], j[ok]
            whole = d + r <= cut - EPS
            if whole.any():
                w, v = i[whole], j[whole]
                yield np.stack([sa[w], sa[w + 1]], 1), np.stack([sb[v], sb[v + 1]], 1), None
            kept.append((i[~whole], j[~whole]))
        alive = tuple(np.concatenate(c) for c in zip(*kept))
        if not len(alive[0]):
            return
    i, j = alive
    yield np.stack([sa[i], sa[i + 1]], 1), np.stack([sb[j], sb[j + 1]], 1), np.stack([ra[i], rb[j]], 1)


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that tie every vector of the links (a, b) to the least one of its component."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    p, q = at[:len(a)], at[len(a):]
    root = np.arange(len(ids))
    while True:
        x, y = root[p], root[q]
        apart = x != y
        if not apart.any():
            break
        p, q, x, y = p[apart], q[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    hung = root != np.arange(len(ids))
    return ids[hung], ids[root[hung]]


def _tying(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) pairs of a matrix of links that tie its components together."""
    linked, rows, ties = linked.copy(), len(linked), []
    while linked.any():
        p = np.flatnonzero(linked.any(1))
        q = np.flatnonzero(linked.any(0))
        ties += [(p, linked[p].argmax(1)), (linked[:, q].argmax(0), q)]
        hung, root = _stars(np.concatenate([t[0] for t in ties]), np.concatenate([t[1] for t in ties]) + rows)
        label = np.arange(sum(linked.shape))
        label[hung] = root
        linked &= label[:rows, None] != label[rows:]
    return tuple(np.concatenate(c) for c in zip(*ties))


class Links:
    """Links that a task finds: counted at the blocks' vectors, and enough of them as pairs of
    ids to tie the components together."""

    def __init__(self, limit: float, home: list[Block]):
        self.limit, self.home, self.ties, self.size = limit, home, [], 0
        self.roots, self.radii = np.concatenate([h.level(0)[1] for h in home]), np.concatenate([h.level(0)[2] for h in home])
        dim = home[0].dim
        self.first = np.sort(np.argsort(-home[0].single.var(0), kind="stable")[:HEAD if dim >= 2 * HEAD else dim])
        for h in home:
            h.look(self.first)

    def meet_home(self, b: Block, start: int = 0) -> None:
        """Links of a block and the home's blocks from ``start``."""
        b.look(self.first)
        _, root, radius = b.level(0)
        cut = float(np.sqrt(2 - 2 * self.limit))
        for k in np.flatnonzero(_far(root, self.roots)[0] - radius - self.radii <= cut + EPS).tolist():
            if k >= start:
                self.meet(self.home[k], b)

    def tie(self, a: np.ndarray, b: np.ndarray) -> None:
        self.ties.append((a, b))
        self.size += len(a)
        if self.size > 1 << 19:
            self.ties = [self.found()]
            self.size = len(self.ties[0][0]) // 2  # what can't be dropped counts half

    def found(self) -> tuple[np.ndarray, np.ndarray]:
        return _stars(*(np.concatenate([np.zeros(0, np.int64), *c]) for c in zip(*self.ties))) if self.ties else (np.zeros(0, np.int64),) * 2

    def meet(self, a: Block, b: Block) -> None:
        """Links of two blocks (of one with itself where they are the same)."""
        for p, q, radii in dual(a, b, self.limit):
            if radii is None:
                for (s, e), (u, v) in zip(p, q):
                    a.n[s:e] += b.ms[u:v].sum()
                    if a is not b:
                        b.n[u:v] += a.ms[s:e].sum()
                    self.tie(np.full(v - u, a.ids[s]), b.ids[u:v])
                    self.tie(a.ids[s:e], np.full(e - s, b.ids[u]))
                continue
            few = (np.diff(p, axis=1) * np.diff(q, axis=1))[:, 0] <= 4096
            self._pairs(a, b, p[few], q[few])
            for x, y, (rx, ry) in zip(p[~few], q[~few], radii[~few]):
                self._runs(a, b, self._near(a, *x, b.single[y[0]], ry), self._near(b, *y, a.single[x[0]], rx))
        if a is b:  # a class met itself once
            a.n -= a.ms

    def _add(self, a: Block, b: Block, p: np.ndarray, q: np.ndarray) -> None:
        np.add.at(a.n, p, b.ms[q])
        if a is not b:
            np.add.at(b.n, q, a.ms[p])
        self.tie(a.ids[p], b.ids[q])

    def _sure(self, a: Block, b: Block, p: np.ndarray, q: np.ndarray, g: np.ndarray) -> np.ndarray:
        """Which pairs link; g: their products in single precision."""
        ok = g >= self.limit
        near = np.flatnonzero(np.abs(g - self.limit) <= _error(a.dim))
        for s in range(0, len(near), 20000):
            k = near[s:s + 20000]
            ok[k] = np.einsum("ij,ij->i", _unit(a.raw[p[k]]), _unit(b.raw[q[k]])) >= self.limit
        return ok

    def _pairs(self, a: Block, b: Block, p: np.ndarray, q: np.ndarray) -> None:
        """All vector pairs of small runs."""
        for i, j in _open_pairs(p, q, (1 << 22) // a.dim + 1):
            self._few(a, b, i, j)

    def _few(self, a: Block, b: Block, p: np.ndarray, q: np.ndarray) -> None:
        ok = self._sure(a, b, p, q, np.einsum("ij,ij->i", a.single[p], b.single[q]))
        if ok.any():
            self._add(a, b, p[ok], q[ok])

    def _near(self, a: Block, start: int, end: int, center: np.ndarray, radius: float) -> np.ndarray:
        """Vectors of a run that may link with some within ``radius`` of ``center``."""
        reach = min(2.0, radius + float(np.sqrt(2 - 2 * self.limit)))
        return start + np.flatnonzero(a.single[start:end] @ center >= 1 - reach * reach / 2 - _error(a.dim))

    def _runs(self, a: Block, b: Block, p: np.ndarray, q: np.ndarray) -> None:
        """All pairs of the vectors ``p`` and ``q``, in tiles; where few are near, their heads tell."""
        wide, high = 256, TILE // 256
        low = self.limit - _error(a.dim)
        heads = a.heads is not None
        for y in range(0, len(q), wide):
            j = q[y:y + wide]
            hb, xb = b.heads[j] if heads else None, b.single[j]
            for t in range(0, len(p), high):
                i = p[t:t + high]
                if heads:
                    at = np.flatnonzero(a.heads[i] @ hb.T >= low)
                    heads = len(at) <= len(i) * len(j) // 64
                    if heads:
                        for k in range(0, len(at), 20000):
                            self._few(a, b, i[at[k:k + 20000] // len(j)], j[at[k:k + 20000] % len(j)])
                        continue
                self._tile(a, b, i, j, a.single[i] @ xb.T)

    def _tile(self, a: Block, b: Block, i: np.ndarray, j: np.ndarray, g: np.ndarray) -> None:
        linked = g >= self.limit
        near = np.flatnonzero(np.abs(g - np.float32(self.limit)) <= _error(a.dim))
        if len(near):
            linked.ravel()[near] = self._sure(a, b, i[near // len(j)], j[near % len(j)], g.ravel()[near])
        if not linked.any():
            return
        ones = linked.astype(np.float64)  # sums below 2 ** 53 are exact
        a.n[i] += (ones @ b.ms[j].astype(np.float64)).astype(np.int64)
        if a is not b:
            b.n[j] += (a.ms[i].astype(np.float64) @ ones).astype(np.int64)
        x, y = _tying(linked)
        self.tie(a.ids[i[x]], b.ids[j[y]])


class Top:
    """Nodes of the top level for one length of vectors: those within ``radius`` of a center
    (node 2 x its place), and around the ``few`` first centers the vectors that are within it
    of none (2 x the place + 1).  ``block``: vectors that a block takes."""

    def __init__(self, centers: np.ndarray, radius: float, few: int, block: int):
        self.centers, self.radius, self.few, self.block = centers.astype(np.float32), radius, few, block
        self.units = _unit(centers)

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Node of each vector and the distance to the node's center."""
        g = x.astype(np.float32) @ self.centers.T
        at = g.argmax(1)
        out = g.max(1) < 1 - min(2.0, self.radius) ** 2 / 2
        at[out] = g[out, :self.few].argmax(1)
        return 2 * at + out, np.sqrt(np.maximum(2 - 2 * np.einsum("ij,ij->i", x, self.units[at]), 0))

    def open(self, a: np.ndarray, ra: np.ndarray, b: np.ndarray, rb: np.ndarray, cut: float) -> np.ndarray:
        """Which nodes ``a`` the covering radii leave open to which nodes ``b``."""
        return _far(self.units[a // 2], self.units[b // 2]) - ra[:, None] - rb <= cut + EPS


def _shares(x: np.ndarray, top: Top, cut: float) -> float:
    """Share of the pairs of sampled vectors whose nodes the covering radii leave open."""
    placed = [top.place(x[s:s + 2048]) for s in range(0, len(x), 2048)]
    node, far = (np.concatenate(p) for p in zip(*placed))
    size, most = np.bincount(node) / len(x), np.zeros(node.max() + 1)
    np.maximum.at(most, node, far)
    used, total = np.flatnonzero(size), 0.0
    for s in range(0, len(used), 512):
        k = used[s:s + 512]
        total += float(size[k] @ top.open(k, most[k], used, most[used], cut) @ size[used])
    return total


def _top(x: np.ndarray, cut: float, n: int, block: int) -> Top:
    """Top level of ``n`` vectors out of a sample ``x`` of them: around the centers of a net of
    the sample, if that leaves fewer pairs of nodes open than some of its vectors do."""
    best = Top(x[:min(512, -(-n // block))], np.inf, 1, block)
    share = _shares(x, best, cut)
    for times in (4, 2.8, 2, 1.4, 1):
        radius = cut * times
        if radius >= 1.2 or len(_net(x[:16384], radius, 8192)) > len(x[:16384]) // 2:
            continue
        most = max(1, min(MAX_CENTERS, n // 256))
        net = x[_net(x, radius, most)[:most]]
        out = sum(int(((x[s:s + 2048] @ net.T).max(1) < 1 - radius * radius / 2).sum()) for s in range(0, len(x), 2048))
        top = Top(net, radius, max(1, min(len(net), out * n // len(x) // block)), block)
        now = _shares(x, top, cut)
        if now < 0.9 * share:
            best, share = top, now
    return best


def _placed(classes: DataFrame, tops: dict[int, Top]) -> DataFrame:
    """Classes with their node and their distance to its center."""
    def run(batches):
        for b in batches:
            dims = b.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = b.filter(pa.array(dims == dim))
                for s in range(0, part.num_rows, 1000):
                    rows = part.slice(s, 1000)
                    node, far = tops[dim].place(_unit(_stack(b"".join(rows.column("vec").to_pylist()), dim, rows.num_rows)))
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(node.astype(np.int32)), pa.array(far)],
                                                     names=[*names, "node", "far"])

    names = classes.columns
    return classes.mapInArrow(run, "key binary, cls long, m long, dim int, vec binary, node int, far double")


def top_level(rows: DataFrame, vectors: DataFrame, limit: float) -> dict[int, Top]:
    """The top level by length of the vectors.

    Its centers come from a sample of about SAMPLE vectors, those of the least hashes; they
    steer the work only.  Lengths that fit one block have one center."""
    sizes = {r["dim"]: r["count"] for r in rows.where("key is not null").groupBy("dim").count().collect()}
    tops = {dim: Top(np.eye(1, dim), np.inf, 1, max(1, min(BLOCK, BLOCK_BYTES // (4 * dim), max(MIN_BLOCK, n // 8))))
            for dim, n in sizes.items()}
    large = {dim: n for dim, n in sizes.items() if n > tops[dim].block}
    if not large:
        return tops
    rate = min(SAMPLE, (SAMPLE << 8) // max(large)) / sum(large.values())
    below = [(dim, round((1 << 40) * min(1, rate + 64 / n))) for dim, n in large.items()]
    some = (vectors.where("key is not null").join(F.broadcast(rows.sparkSession.createDataFrame(below, "dim int, below long")), "dim")
            .where(F.expr(f"pmod(xxhash64(key), {1 << 40}) < below")).select("dim", "key", "vec").dropDuplicates(["key"]).collect())
    for dim, n in large.items():
        of = sorted((bytes(r["key"]), bytes(r["vec"])) for r in some if r["dim"] == dim)
        if of:
            x = np.concatenate([_unit(_stack(v, dim, 1)) for _, v in of]).astype(np.float32)
            tops[dim] = _top(x, float(np.sqrt(2 - 2 * limit)), n, tops[dim].block)
    return tops


def _tasks(blocks: list, radius: dict, tops: dict[int, Top], cut: float, many: int) -> list[tuple[list[int], list[int]]]:
    """(home, guests) of each task: two blocks whose nodes the covering radii leave open meet
    in the one task where one is a guest and the other is in its home, or where both are in
    the home and the former is among the guests too."""
    homes: list[list[int]] = []
    held = 0
    for i, b in enumerate(blocks):
        if not homes or held + b["bytes"] > HOME_BYTES or blocks[homes[-1][0]]["dim"] != b["dim"]:
            homes.append([])
            held = 0
        homes[-1].append(i)
        held += b["bytes"]
    met = []
    for home in homes:
        dim = blocks[home[0]]["dim"]
        later = [i for i in range(home[0], len(blocks)) if blocks[i]["dim"] == dim]
        mine, theirs = (np.unique([blocks[i]["node"] for i in k]) for k in (home, later))
        ra, rb = (np.array([radius[dim, n] for n in k.tolist()]) for k in (mine, theirs))
        open_ = np.zeros(len(theirs), bool)
        for s in range(0, len(mine), 256):
            open_ |= tops[dim].open(mine[s:s + 256], ra[s:s + 256], theirs, rb, cut).any(0)
        near = set(theirs[open_].tolist())
        met.append((home, [i for i in later if i <= home[-1] or blocks[i]["node"] in near]))
    most = min(HOME_BYTES, sum(blocks[i]["bytes"] for _, guests in met for i in guests) // many)
    tasks = []
    for home, guests in met:
        size = most
        for i in guests:
            if size + blocks[i]["bytes"] > most:
                tasks.append((home, []))
                size = 0
            tasks[-1][1].append(i)
            size += blocks[i]["bytes"]
    return tasks


def pair_links(placed: DataFrame, tops: dict[int, Top], limit: float) -> DataFrame:
    """(a, b, n): where b is null, class a has n links to the classes that it met in one task;
    else a linked pair, enough of them to tie the components together."""
    spark = placed.sparkSession
    nodes = placed.groupBy("dim", "node").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("r")).collect()
    if not nodes:
        return spark.createDataFrame([], "a long, b long, n long")
    counts = [(r["dim"], r["node"], -(-r["n"] // tops[r["dim"]].block)) for r in nodes]
    blocks = placed.join(F.broadcast(spark.createDataFrame(counts, "dim int, node int, blocks int")), ["dim", "node"]) \
        .withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    cut = float(np.sqrt(2 - 2 * limit))

    def gather(t: pa.Table) -> pa.Table:
        t = t.sort_by("cls")
        x = _stack(b"".join(t.column("vec").to_pylist()), t.column("dim")[0].as_py(), t.num_rows)
        tree = Tree(_unit(x), cut / 4)
        return pa.table({**{c: pa.array([t.column(c)[0].as_py()], pa.int32()) for c in ("dim", "node", "block")},
                         **{c: [t.column(k).to_numpy()[tree.order].tobytes()] for c, k in (("ids", "cls"), ("ms", "m"))},
                         "vecs": [x[tree.order].tobytes()], "tree": [pickle.dumps(tree.levels)]})

    held = stage(blocks.select("dim", "node", "block", "cls", "m", "vec").groupBy("dim", "node", "block").applyInArrow(
        gather, "dim int, node int, block int, ids binary, ms binary, vecs binary, tree binary"), "blocks")
    at = sorted(held.select("dim", "node", "block", F.length("vecs").alias("bytes")).collect(),
                key=lambda r: (r["dim"], r["node"] % 2, r["node"], r["block"]))
    tasks = _tasks(at, {(r["dim"], r["node"]): r["r"] for r in nodes}, tops, cut, 4 * partitions(spark))
    most = max(ROUND_BYTES, sum(b["bytes"] for b in at) // 2)  # bytes that a round may shuffle
    found, these, size = [], [], 0
    for home, guests in tasks:
        if guests[-1] <= home[-1]:  # only blocks of the home: those before the first guest have met it
            home = [i for i in home if i >= guests[0]]
        need = sum(at[i]["bytes"] for i in {*home, *guests})
        if these and size + need > most:
            found.append(_met(held, at, these, limit))
            these, size = [], 0
        these.append((home, guests))
        size += need
    found.append(_met(held, at, these, limit))
    return reduce(DataFrame.unionAll, found)


def _met(held: DataFrame, at: list, tasks: list[tuple[list[int], list[int]]], limit: float) -> DataFrame:
    """One round: the links of the blocks that meet in the tasks (places in ``at``)."""
    spark = held.sparkSession
    sides = [(t, i not in home, i, *(at[i][c] for c in ("dim", "node", "block")))
             for t, (home, guests) in enumerate(tasks) for i in sorted({*home, *guests})]
    named = spark.createDataFrame(sides, "task int, guest boolean, place int, dim int, node int, block int")
    met = (held.join(F.broadcast(named), ["dim", "node", "block"]).drop("node", "block")
           .repartitionById(len(tasks), "task").sortWithinPartitions("task", "guest", "place"))
    inner = [{i for i in guests if i in set(home)} for home, guests in tasks]

    def batch(a: np.ndarray, b: np.ndarray | None, n: np.ndarray | None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()) if c is None else pa.array(c, pa.int64()) for c in (a, b, n)],
                                          names=["a", "b", "n"])

    def counted(blocks: list[Block]):
        for b in blocks:
            k = np.flatnonzero(b.n)
            if len(k):
                yield batch(b.ids[k], None, b.n[k])

    def run(batches):
        task, home, links = None, [], None

        def at_home():
            links = Links(limit, home)
            for i, b in enumerate(home):
                if b.place in inner[task]:
                    links.meet_home(b, i)
            return links

        def ended():
            for ties in ([links or at_home()] if home else []):
                yield from counted(home)
                yield batch(*ties.found(), None)

        try:
            for rows in batches:
                for r in range(rows.num_rows):
                    row = {c: rows.column(c)[r].as_py() for c in rows.schema.names}
                    if row["task"] != task:
                        yield from ended()
                        task, home, links = row["task"], [], None
                    if not row["guest"]:
                        home.append(Block(row))
                        continue
                    links = links or at_home()
                    guest = Block(row)
                    links.meet_home(guest)
                    yield from counted([guest])
            yield from ended()
        finally:
            release_memory()

    with settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": "4"}):  # rows of megabytes
        return stage(met.mapInArrow(run, "a long, b long, n long"), "vector-links")


def near_vectors(vectors: DataFrame, limit: float = 0.95, id_col: str = "vec_id",
                 vec_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept of every row; linked: cosine >= ``limit``.

    Null, empty and zero vectors and those with null or non-finite components link with
    nothing, nor do vectors of different lengths; rows with a null id link nothing, have a
    null component_id and are kept.  Equal unit vectors are one class, compared once and
    counted by their number; a repeated row counts as another vector.  Columns other than id
    and vector (labels too) are not read.  The top level's centers come from a documented
    sample (``top_level``); they steer the work only, every vector is compared.

    High-dimensional vectors without structure defeat any covering bound: the work then
    grows with the square of the rows, the disk does not (see README)."""
    with settings(vectors.sparkSession, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
        rows = stage(read_vectors(vectors, id_col, vec_col, False), "vectors")
        whole = read_vectors(vectors, id_col, vec_col, True)  # read again: the vectors are written as classes only
        tops = top_level(rows, whole, limit)
        classes = stage(_placed(whole.where(F.col("key").isNotNull()).groupBy("key")
                                .agg(F.min("vec_id").alias("cls"), F.count(F.lit(1)).alias("m"),
                                     F.first("dim").alias("dim"), F.first("vec").alias("vec")), tops), "vector-classes")
        found = pair_links(classes, tops, limit)
        counts = found.where("b is null").groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("n"))
        comp = components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "cls")
    fate = (classes.select("key", "cls", "m").join(counts, "cls", "left").join(comp, "cls", "left")
            .select("key", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n"),
                    F.coalesce("component", "cls").alias("component")))
    return (rows.select("vec_id", "key").join(fate, "key", "left")
            .select("vec_id", F.coalesce("n", F.lit(0)).alias("n_links"),
                    F.coalesce("component", "vec_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))))


SQL = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
u AS MATERIALIZED (
  SELECT r, x FROM v WHERE vec_id IS NOT NULL AND len(list_filter(x, lambda e: e IS NULL OR NOT isfinite(e))) = 0
    AND len(list_filter(x, lambda e: e <> 0)) > 0
), links AS MATERIALIZED (
  SELECT p.r AS a, q.r AS b FROM u p JOIN u q ON len(p.x) = len(q.x) AND p.r <> q.r
  WHERE list_cosine_similarity(p.x, q.x) >= 0.95
), n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a),
reach(a, b) AS (SELECT r, r FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
least AS (SELECT a, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.b GROUP BY a)
SELECT v.vec_id, coalesce(n.n_links, 0) AS n_links, least.component_id,
       coalesce(v.vec_id = least.component_id, true) AS kept
FROM v JOIN least ON least.a = v.r LEFT JOIN n ON n.a = v.r
"""
