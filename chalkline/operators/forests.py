"""Random forests of two classes, grown level by level over rows spread over tasks.

Spark's own forest keeps a count for each row and tree, at 200 trees about a kilobyte a row. Here a feature is the number
of its bin in one byte, and how often a tree draws a row (Poisson, mean 1) is a function of the row's hash and the tree. For each level
the tasks count draws by tree, node, feature, bin and class; the counts of a tree are added up in one place, which splits its nodes.
All counts are whole numbers, so a forest doesn't depend on how rows are spread, but for the limits of the bins of features with many values.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chalkline.plans.session import materialise

BLOCK = 16_384
BINS = 32
TASK_BLOCKS = 64
#: A bin no value lies beyond: all rows go to the left.
ALL_LEFT = 255
_POISSON = np.searchsorted(np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)]), (np.arange(65_536) + 0.5) / 65_536).astype(np.uint8)


@dataclass
class Forest:
    """Complete trees: at node i rows whose bin of ``feature[i]`` is at most ``bin[i]`` go to 2i + 1, others to 2i + 2.

    ``edges`` are each feature's limits of bins, in order; ``value`` is the share of class 1 in the nodes of the last level.
    """

    edges: list[list[float]]
    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray

    def scores(self, columns: list[np.ndarray]) -> np.ndarray:
        """The trees' mean for each row of ``columns``, one array a feature."""
        x = binned(columns, self.edges)
        at, depth = np.arange(len(x)) * x.shape[1], self.value.shape[1].bit_length() - 1
        flat, out = x.ravel(), np.zeros(len(x))
        for f, b, v in zip(self.feature.astype(np.intp), self.bin, self.value):
            out += v.take(_walk(flat, at, f, b, depth) - (len(v) - 1), mode="clip")
        return out / len(self.value)


def binned(columns: list[np.ndarray], edges: list[list[float]]) -> np.ndarray:
    """``(row, feature)``: how many edges lie below each value; a missing one is beyond all."""
    return np.stack([np.searchsorted(e, c, side="left") for c, e in zip(columns, edges)], axis=1).astype(np.uint8)


def _walk(flat: np.ndarray, at: np.ndarray, feature: np.ndarray, limit: np.ndarray, levels: int) -> np.ndarray:
    """The node of each row after so many levels; ``at`` is where a row begins in ``flat``.

    Places are of numpy's own index type, which it would turn others into at every look-up, and none is out of range.
    """
    if not levels:
        return np.zeros(len(at), np.intp)
    node = (flat.take(at + feature[0], mode="clip") > limit[0]) + np.intp(1)
    for _ in range(levels - 1):
        place = feature.take(node, mode="clip")
        place += at
        right = flat.take(place, mode="clip") > limit.take(node, mode="clip")
        node += node
        node += right
        node += 1
    return node


def _draws(hashes: np.ndarray, seed: int, trees: int) -> Iterator[np.ndarray]:
    """For each tree how often it draws each row: the high bits of the row's hash times an odd number of the tree's."""
    for m in np.random.default_rng(seed).integers(0, 2**63, trees, dtype=np.uint64) * np.uint64(2) + np.uint64(1):
        high = hashes * m
        high >>= np.uint64(48)
        yield _POISSON.take(high.view(np.int64), mode="clip")


def _edges(rows: DataFrame, group: str, features: list[str]) -> dict[int, list[list[float]]]:
    """Limits of at most BINS bins for each group's features: between all values where they are few, else at even shares of the rows."""
    at = [i / BINS for i in range(1, BINS)]
    value = lambda i: F.col(features[i]).cast("double")

    def per(which: list[int], **found) -> dict:
        return {r[group]: r for r in rows.groupBy(group).agg(F.lit(0).alias("_"), *(f(value(i)).alias(f"{n}{i}") for i in which for n, f in found.items())).collect()}

    every = list(range(len(features)))
    one = per(every, n=F.approx_count_distinct)
    few = [i for i in every if all(r[f"n{i}"] <= 2 * BINS for r in one.values())]
    sets = per(few, v=lambda x: F.sort_array(F.collect_set(x)))
    # shares are costly and only looked for where a feature has more values than bins
    many = [i for i in every if i not in few or any(len(r[f"v{i}"]) > BINS for r in sets.values())]
    shares = per(many, lo=F.min, q=lambda x: F.percentile_approx(x, at, 10_000)) if many else {}

    def limits(g: int, i: int) -> list[float]:
        values = sets[g][f"v{i}"] if i in few else None
        if values is not None and len(values) <= BINS:
            return [(a + b) / 2 for a, b in zip(values, values[1:])]
        return sorted({x for x in (shares[g][f"lo{i}"], *(shares[g][f"q{i}"] or ())) if x is not None})[:BINS]

    return {g: [limits(g, i) for i in every] for g in one}


def _packed(rows: DataFrame, group: str, label: str, key: list[str], features: list[str], edges: dict[int, list[list[float]]]) -> DataFrame:
    """``rows`` in blocks of one group: bins, labels and hashes of the keys as bytes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, list] = {g: [] for g in edges}

        def block(g: int) -> pa.RecordBatch:
            parts, kept[g] = kept[g], []
            return pa.RecordBatch.from_pylist([{"g": g, **{n: np.concatenate([p[i] for p in parts]).tobytes() for i, n in enumerate("xys")}}], schema=schema)

        schema = pa.schema([("g", pa.int32()), ("x", pa.binary()), ("y", pa.binary()), ("s", pa.binary())])
        for b in batches:
            group_of, y, s, *columns = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            for g in edges:
                mine = group_of == g
                if mine.any():
                    kept[g].append((binned([c[mine] for c in columns], edges[g]), y[mine].astype(np.uint8), s[mine].astype(np.int64)))
                    if sum(len(p[1]) for p in kept[g]) >= BLOCK:
                        yield block(g)
        for g in edges:
            if kept[g]:
                yield block(g)

    given = rows.select(F.col(group).cast("int"), F.col(label).cast("int"), F.xxhash64(*key), *(F.col(c).cast("double") for c in features))
    return given.mapInArrow(pack, "g int, x binary, y binary, s binary")


def grow(rows: DataFrame, group: str, label: str, weights: dict[int, tuple[float, float]], key: list[str], features: list[str], trees: int, depth: int, seed: int) -> dict[int, Forest]:
    """A forest for each group of ``weights``, whose two numbers are what a row of class 0 and 1 weighs.

    A node chooses among the bins of ceil(sqrt(features)) features the split that lowers Gini's impurity most; the first of equals.
    It is not split where none does, nor below ``depth``. ``key`` tells rows apart.
    """
    rows = rows.where(F.col(group).isin(*weights))
    edges = _edges(rows, group, features)
    weights = {g: w for g, w in weights.items() if g in edges}
    packed = materialise(_packed(rows, group, label, key, features, edges))
    spread = max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(packed.count() / TASK_BLOCKS))
    packed = packed.repartition(spread)
    n, take, last = len(features), math.ceil(math.sqrt(len(features))), 2**depth
    sizes = {g: np.array([len(e) + 1 for e in edges[g]]) for g in weights}
    chosen = np.random.default_rng(seed).random((trees, last - 1, n)).argsort(axis=2)[:, :, :take].astype(np.int32)
    made = {g: Forest(edges[g], np.zeros((trees, last - 1), np.int32), np.full((trees, last - 1), ALL_LEFT, np.uint8), np.zeros((trees, last))) for g in weights}
    live = {(g, t): np.array([0]) for g in weights for t in range(trees)}

    for level in range(depth):
        if not live:
            break
        first = 2**level - 1
        count, split = _level(made, live, chosen, sizes, weights, level, seed)
        part = packed.mapInArrow(count, "g int, t int, c binary").repartition(spread, "g", "t")
        found = part.mapInArrow(split, "g int, t int, f binary, b binary, l binary, r binary").collect()  # a row a tree, of at most 2 ** level nodes
        following: dict[tuple[int, int], np.ndarray] = {}
        for r in found:
            forest, t, nodes = made[r["g"]], r["t"], live[r["g"], r["t"]]
            f, b = np.frombuffer(r["f"], np.int32), np.frombuffer(r["b"], np.int32)
            sides = [np.frombuffer(r[c], np.int64).reshape(-1, 2) * np.array(weights[r["g"]]) for c in "lr"]
            cut = f >= 0
            forest.feature[t, first + nodes[cut]], forest.bin[t, first + nodes[cut]] = f[cut], b[cut]
            # a node that is not split has all on its left side
            forest.value[t, nodes[~cut] << (depth - level)] = _share(sides[0][~cut])
            more = []
            for k, side in enumerate(sides):
                child, w = 2 * nodes[cut] + k, side[cut]
                ends = (w.min(axis=1) <= 0) | (level + 1 == depth)
                forest.value[t, child[ends] << (depth - level - 1)] = _share(w[ends])
                more.append(child[~ends])
            if len(nodes := np.sort(np.concatenate(more))):
                following[r["g"], t] = nodes
        live = following
    return made


def _share(w: np.ndarray) -> np.ndarray:
    total = w.sum(axis=1)
    return np.divide(w[:, 1], total, out=np.zeros(len(w)), where=total > 0)


def _level(made, live, chosen, sizes, weights, level: int, seed: int):
    """What counts the draws of blocks by tree, live node, chosen feature, bin and class, and what splits a tree's nodes by all counts."""
    first, trees, n = 2**level - 1, chosen.shape[0], len(next(iter(sizes.values())))
    # blocks are counted by twice the bin and the class in one byte, so limits are doubled too
    walks = {g: (f.feature[:, : max(first, 1)], np.minimum(2 * f.bin[:, : max(first, 1)].astype(int) + 1, ALL_LEFT).astype(np.uint8)) for g, f in made.items()}
    own = {(g, t): chosen[t, first + nodes] for (g, t), nodes in live.items()}  # (live node, feature)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}  # whole numbers, exact as such
        starts: dict[tuple[int, int], np.ndarray] = {}
        places: dict[tuple[int, int], np.ndarray] = {}
        chosen_of = {k: np.ascontiguousarray(f.T, np.intp) for k, f in own.items()}
        for k, f in own.items():
            ends = np.cumsum(sizes[k[0]][f].ravel())
            starts[k] = np.ascontiguousarray((2 * (ends - sizes[k[0]][f].ravel())).reshape(f.shape).T, np.intp)
            total[k] = np.zeros(2 * int(ends[-1]))
            if len(live[k]) < 2**level:
                places[k] = np.full(2**level, -1, np.intp)
                places[k][live[k]] = np.arange(len(live[k]))
        paths = {g: (f.astype(np.intp), b) for g, (f, b) in walks.items()}
        for batch in batches:
            for row in batch.to_pylist():
                g, y = row["g"], np.frombuffer(row["y"], np.uint8)
                flat = (2 * np.frombuffer(row["x"], np.uint8).reshape(-1, n) + y[:, None]).ravel()
                for t, times in enumerate(_draws(np.frombuffer(row["s"], np.uint64), seed, trees)):
                    if (k := (g, t)) not in live:
                        continue
                    at = np.flatnonzero(times)
                    w = times.take(at, mode="clip").astype(float)
                    at *= n
                    node = _walk(flat, at, paths[g][0][t], paths[g][1][t], level)
                    node -= first
                    if k in places:
                        node = places[k].take(node, mode="clip")
                        there = node >= 0
                        at, node, w = at[there], node[there], w[there]
                    for f, start in zip(chosen_of[k], starts[k]):
                        cell = f.take(node, mode="clip")
                        cell += at
                        to = start.take(node, mode="clip")
                        to += flat.take(cell, mode="clip")
                        total[k] += np.bincount(to, w, len(total[k]))
        schema = pa.schema([("g", pa.int32()), ("t", pa.int32()), ("c", pa.binary())])
        for (g, t), c in total.items():
            if c.any():
                yield pa.RecordBatch.from_pylist([{"g": g, "t": t, "c": c.astype(np.int64).tobytes()}], schema=schema)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                c, k = np.frombuffer(row["c"], np.int64), (row["g"], row["t"])
                total[k] = total[k] + c if k in total else c
        schema = pa.schema([("g", pa.int32()), ("t", pa.int32()), *((c, pa.binary()) for c in "fblr")])
        for (g, t), c in total.items():
            f, b, left, right = best_splits(c, sizes[g][own[g, t]], np.array(weights[g]))
            f = np.where(f < 0, -1, own[g, t][np.arange(len(f)), f]).astype(np.int32)
            yield pa.RecordBatch.from_pylist([{"g": g, "t": t, "f": f.tobytes(), "b": b.astype(np.int32).tobytes(), "l": left.tobytes(), "r": right.tobytes()}], schema=schema)

    return count, split


def best_splits(counts: np.ndarray, sizes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each node the place of the feature to split by, the last bin on the left and both sides' counts; -1 and all on the left without a gain.

    ``counts`` has two numbers for each node, feature and bin in this order, ``sizes`` (node, feature) the number of bins.
    """
    wide = np.zeros((*sizes.shape, int(sizes.max()), 2), np.int64)
    wide[np.arange(wide.shape[2]) < sizes[:, :, None]] = counts.reshape(-1, 2)
    left = wide.cumsum(axis=2)
    whole = left[:, :1, -1:, :]
    right = whole - left

    def impure(c: np.ndarray) -> np.ndarray:
        """Gini's impurity times the weight."""
        w = c * weights
        total = w.sum(axis=-1)
        return 2 * np.divide(w[..., 0] * w[..., 1], total, out=np.zeros(total.shape), where=total > 0)

    gain = np.where((left.sum(axis=-1) > 0) & (right.sum(axis=-1) > 0), impure(whole) - impure(left) - impure(right), 0.0).reshape(len(sizes), -1)
    best, rows = gain.argmax(axis=1), np.arange(len(sizes))
    f, b = np.divmod(best, wide.shape[2])
    ok = gain[rows, best] > 1e-9 * whole.sum(axis=(1, 2, 3))
    l, r = left[rows, f, b], right[rows, f, b]  # noqa: E741
    l[~ok], r[~ok] = whole[~ok, 0, 0], 0
    return np.where(ok, f, -1), b, l, r
