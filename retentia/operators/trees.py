"""Tree ensembles grown level by level from histograms (M5, M6).

Numeric inputs are cut at quantiles once; a row then is a string of bin
numbers, one byte an input, the last byte value for a missing input. Each
pass over the rows adds up one histogram per open node and input -- partial
sums in numpy inside the tasks, one ``groupBy`` across them -- and only these
tables of bins reach the driver, which picks the splits. All models that share the
rows (the folds of a cross-validation) grow in the same passes.

* ``boost``: second-order boosting of the logistic loss. A node's
  gain is G_l^2 / (H_l + lambda) + G_r^2 / (H_r + lambda) - G^2 / (H + lambda), a leaf
  -eta G / (H + lambda); rows that miss the split input go to the side with the larger gain.
* ``forest``: Poisson(1) bootstrap weights from a hash of (row, tree), class
  weights, Gini impurity, sqrt(inputs) inputs drawn by hash per node, and nodes split from
  ``min_split`` distinct rows on. A node whose drawn inputs cannot split it draws the next ones.

Gradients are summed as fixed-point integers and bootstrap weights are whole
numbers, so trees depend neither on the order of rows nor on partitions.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, keyword_only
from pyspark.ml import Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import default_parallelism, discard, ship_code, write_once

BINS = 64
MISSING = 255
FIXED = float(1 << 24)  # one as a fixed-point gradient
ROWS_PER_PARTITION = 100_000
ROWS_AT_LEAST = 2_000  # a partition of fewer rows costs more than it saves
TREES_PER_WRITE = 10  # the margins of all rows are written anew after so many trees
NODES_PER_GROUP = 64  # nodes whose splits one group picks
PACKED_ROWS, PACKED_BITS = 10_000, 17  # 12 * PACKED_ROWS < 2 ** PACKED_BITS, as a bootstrap weight is 12 at most
CELLS_PER_PASS = 4_000_000  # histogram cells of one forest pass; more open nodes take more passes


# ------------------------------------------------------------------ bins
def cut_points(df: DataFrame, inputs: str, width: int, bins: int = BINS) -> list[list[float]]:
    """Distinct values at the ranks i / bins of every input (a quantile sketch, exact for few rows)."""
    probs = [i / bins for i in range(1, bins)]
    row = df.agg(*[F.percentile_approx(F.col(inputs)[i], probs, 10_000).alias(f"q{i}") for i in range(width)]).first()
    return [sorted({float(v) for v in (row[f"q{i}"] or []) if v is not None and not math.isnan(v)}) for i in range(width)]


def bin_codes(values: np.ndarray, cuts: list[list[float]]) -> np.ndarray:
    """Bin numbers: how many cuts lie below the value; MISSING for a NaN."""
    out = np.empty(values.shape, np.uint8)
    for i, c in enumerate(cuts):
        v = values[:, i]
        out[:, i] = np.where(np.isnan(v), MISSING, np.searchsorted(np.asarray(c, float), v, "left"))
    return out


def _values(col: pa.Array, width: int) -> np.ndarray:
    flat = col.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(float).reshape(len(col), width)


def _matrix(col: pa.Array, width: int) -> np.ndarray:
    data = np.frombuffer(col.buffers()[2], np.uint8) if len(col) else np.zeros(0, np.uint8)
    return data[col.offset * width: (col.offset + len(col)) * width].reshape(len(col), width)  # every row has ``width`` bytes, end to end


def _by_column(b: pa.RecordBatch, width: int) -> np.ndarray:
    """The bin numbers of a batch, each input's in one run of memory."""
    return np.asfortranarray(_matrix(b.column(b.schema.get_field_index("codes")), width))


def binned(df: DataFrame, key: str, label: str, inputs: str, cuts: list[list[float]], fold: str | None = None,
           rows_at_least: int | None = None) -> DataFrame:
    """(row_hash, label, fold, codes), written once: the table that every pass
    reads. Partitions hold ``rows_at_least`` to ROWS_PER_PARTITION rows."""
    width = len(cuts)
    ship_code(df.sparkSession)
    rows = df.select(F.xxhash64(F.col(key)).alias("row_hash"), F.col(label).cast("int").alias("label"),
                     (F.col(fold).cast("int") if fold else F.lit(-1)).alias("fold"), F.col(inputs).alias("inputs"))

    def code(batches):
        for b in batches:
            m = bin_codes(_values(b.column(3), width), cuts)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([r.tobytes() for r in m], pa.binary())],
                                             ["row_hash", "label", "fold", "codes"])

    n = df.count()
    parts = max(min(default_parallelism(df.sparkSession), -(-n // (rows_at_least or ROWS_AT_LEAST))), -(-n // ROWS_PER_PARTITION), 1)
    written = write_once(rows.mapInArrow(code, "row_hash long, label int, fold int, codes binary").repartition(parts), "bins")
    # hundreds of short passes follow: a session of its own plans each with as many tasks as the table has, and no re-planning
    passes = df.sparkSession.newSession()
    passes.conf.set("spark.sql.adaptive.enabled", "false")
    passes.conf.set("spark.sql.shuffle.partitions", str(min(parts, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    passes.conf.set("spark.sql.codegen.wholeStage", "false")  # few cells a pass: compiling costs more than it saves
    passes.conf.set("spark.sql.files.openCostInBytes", str(64 << 20))  # one task a file
    out = passes.read.schema(written.schema).parquet(written._scratch)
    if parts == 1:
        out = out.coalesce(1)  # known to be one partition: its sums need no exchange
    return _held(out, written._scratch)


def _held(table: DataFrame, path: str) -> DataFrame:
    """Keeps a table that every pass reads in memory; the written files stand behind it."""
    table = table.persist(StorageLevel.MEMORY_AND_DISK)
    table._scratch = path
    return table


def release(table: DataFrame) -> None:
    table.unpersist()
    discard(table)


# ------------------------------------------------------------------ trees
@dataclass
class Tree:
    """A binary tree as a heap: the children of node i are 2 i + 1 and 2 i + 2."""

    depth: int
    split: np.ndarray = field(default=None)  # input of the node's split, -1 for a leaf
    cut: np.ndarray = field(default=None)  # bins up to this one go left
    left: np.ndarray = field(default=None)  # rows that miss the input go left
    value: np.ndarray = field(default=None)

    def __post_init__(self):
        n = 2 ** (self.depth + 1) - 1
        if self.split is None:
            self.split, self.cut = np.full(n, -1, np.int32), np.zeros(n, np.int32)
            self.left, self.value = np.zeros(n, bool), np.zeros(n)

    def nodes(self, codes: np.ndarray) -> np.ndarray:
        """The node each row has come to."""
        kind = np.uint8 if len(self.split) <= 256 else np.int64

        def below(n: int):
            if self.split[n] < 0:
                return kind(n)
            column = codes[:, self.split[n]]
            goes_left = column <= self.cut[n]  # MISSING is above every cut
            if self.left[n]:
                goes_left |= column == MISSING
            left, right = below(2 * n + 1), below(2 * n + 2)
            # whole columns and masks: far cheaper than a look-up of each row's own input
            return right ^ ((left ^ right) & np.negative(goes_left.astype(kind)))

        found = below(0)
        return found if isinstance(found, np.ndarray) else np.full(len(codes), found, kind)

    def record(self) -> list:
        used = np.flatnonzero((self.split >= 0) | (self.value != 0))
        return [self.depth, [[int(i), int(self.split[i]), int(self.cut[i]), bool(self.left[i]), float(self.value[i])] for i in used]]

    @classmethod
    def of(cls, record: list) -> Tree:
        t = cls(record[0])
        for i, s, c, le, v in record[1]:
            t.split[i], t.cut[i], t.left[i], t.value[i] = s, c, le, v
        return t


def margins(trees: list[Tree], codes: np.ndarray) -> np.ndarray:
    total = np.zeros(len(codes))
    for t in trees:
        total += t.value[t.nodes(codes)]
    return total


def _add_up(group: pa.Table) -> pa.Table:
    """The partial histograms of one node, added up."""
    total = sum(np.frombuffer(raw, np.int64) for raw in group.column("sums").to_pylist())
    return pa.table({"slot": group.column("slot")[:1], "sums": pa.array([total.tobytes()], pa.binary())})


def _summed(parts: DataFrame, n: int, cells: int) -> np.ndarray:
    """(slot, sums) partial histograms of the tasks -> (n, 2, cells) on the driver, sized by the bins alone."""
    got = parts.groupBy("slot").applyInArrow(_add_up, "slot long, sums binary").toArrow()
    out = np.zeros((n, 2, cells), np.int64)
    for slot, raw in zip(got.column("slot").to_pylist(), got.column("sums").to_pylist(), strict=True):
        out[slot] = np.frombuffer(raw, np.int64).reshape(2, cells)
    return out


# ------------------------------------------------------------------ boosting
@dataclass(frozen=True)
class Boosting:
    trees: int = 120
    depth: int = 4
    eta: float = 0.05
    leaf_l2: float = 1.0
    min_hessian: float = 1.0
    positive_weight: float = 1.0


def gradients(margin: np.ndarray, label: np.ndarray, positive_weight: float) -> tuple[np.ndarray, np.ndarray]:
    """Fixed-point gradient and hessian of the weighted logistic loss."""
    p = 1.0 / (1.0 + np.exp(-margin))
    w = np.where(label == 1, positive_weight, 1.0) * FIXED
    return np.rint(w * (p - label)), np.rint(w * p * (1.0 - p))


def best_split(hist: np.ndarray, sizes: np.ndarray, par: Boosting) -> tuple[float, int, int, bool]:
    """(gain, input, cut, missing rows go left) of a node from its (input, code, [g, h]) sums.

    ``hist`` has the codes 0 .. BINS and then the missing rows. The first of
    equal gains wins: lower input, lower cut, missing rows to the right."""
    h = hist / FIXED
    total = h[0].sum(0)
    missing, left = h[:, -1], np.cumsum(h[:, :-1], axis=1)[:, :-1]
    with np.errstate(divide="ignore", invalid="ignore"):
        sides = []
        for with_missing in (left, left + missing[:, None]):
            gl, hl = with_missing[..., 0], with_missing[..., 1]
            gr, hr = total[0] - gl, total[1] - hl
            gain = gl**2 / (hl + par.leaf_l2) + gr**2 / (hr + par.leaf_l2) - total[0] ** 2 / (total[1] + par.leaf_l2)
            allowed = (hl >= par.min_hessian) & (hr >= par.min_hessian) & (np.arange(left.shape[1]) < sizes[:, None])
            sides.append(np.where(allowed, gain, -np.inf))
    gain = np.round(np.stack(sides, -1), 9)
    f, c, side = np.unravel_index(int(np.argmax(gain)), gain.shape)
    return float(gain[f, c, side]), int(f), int(c), bool(side)


def _gradient_sums(batches, width, models, bins, trees, open_nodes, par, has_margins):
    """Histograms of one task in one pass, (node, [g, h], input and code), or None. ``trees[m]`` are the trees since the margins were written, the open one last."""
    codes_n = bins + 2
    slots = {m: np.full(2 ** (par.depth + 1), -1, np.int64) for m in models}
    places: dict = {m: [] for m in models}
    for i, (m, n) in enumerate(open_nodes):
        slots[m][n] = len(places[m])
        places[m].append(i)
    total = None
    for b in batches:
        codes = _by_column(b, width)
        folded = np.where(codes == MISSING, bins + 1, codes)
        label, fold = (np.asarray(b.column(b.schema.get_field_index(c))) for c in ("label", "fold"))
        held = _values(b.column(b.schema.get_field_index("margins")), len(models)) if has_margins else np.zeros((len(codes), len(models)))
        if total is None:
            total = np.zeros((len(open_nodes), 2, width, codes_n), np.int64)
        for i, m in enumerate(models):
            if not places[m]:
                continue
            at = slots[m][trees[i][-1].nodes(codes)]
            rows = np.flatnonzero((fold != m) & (at >= 0))
            at = at[rows] * codes_n
            g, h = gradients((held[:, i] + margins(trees[i][:-1], codes))[rows], label[rows], par.positive_weight)
            for f in range(width):  # one input's cells stay in the processor's cache
                cell = at + folded[rows, f]
                for k, v in enumerate((g, h)):
                    total[places[m], k, f] += np.bincount(cell, v, len(places[m]) * codes_n).astype(np.int64).reshape(-1, codes_n)
    return total


def _gradient_nodes(batches, *how):
    """One row a node, its whole partial histogram packed."""
    total = _gradient_sums(batches, *how)
    if total is not None:
        on = np.flatnonzero(total.any((1, 2, 3)))
        yield pa.RecordBatch.from_arrays([pa.array(on), pa.array([total[i].tobytes() for i in on], pa.binary())], ["slot", "sums"])


def _gradient_cells(batches, *how):
    """One row a cell of a single node."""
    total = _gradient_sums(batches, *how)
    if total is not None:
        flat = total[0].reshape(2, -1)
        on = np.flatnonzero(flat.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(on), pa.array(flat[0, on]), pa.array(flat[1, on])], ["cell", "v0", "v1"])


def gradient_histogram(table: DataFrame, cuts: list[list[float]], par: Boosting = Boosting(), bins: int = BINS) -> DataFrame:
    """(input, code, gradient, hessian) of the root before the first tree, as fixed-point sums; code ``bins + 1`` is missing."""
    width, tree = len(cuts), Tree(par.depth)
    parts = table.mapInArrow(lambda b: _gradient_cells(b, width, [-2], bins, [[tree]], [(-2, 0)], par, False), "cell long, v0 long, v1 long")
    return (parts.groupBy("cell").agg(F.sum("v0").alias("gradient"), F.sum("v1").alias("hessian"))
            .select((F.col("cell") / (bins + 2)).cast("int").alias("input"), (F.col("cell") % (bins + 2)).cast("int").alias("code"), "gradient", "hessian"))


def boost(table: DataFrame, cuts: list[list[float]], models: list[int], par: Boosting, bins: int = BINS) -> list[list[Tree]]:
    """One ensemble per model; model m is fitted on the rows whose fold is not m (-2: on all)."""
    width, sizes = len(cuts), np.array([len(c) for c in cuts])
    codes_n, done = bins + 2, [[] for _ in models]
    current, written = table, 0
    for t in range(par.trees):
        growing = [Tree(par.depth) for _ in models]
        open_nodes, above, lighter = [(m, 0) for m in models], {}, set()
        for level in range(par.depth):
            if not open_nodes:
                break
            recent = [done[i][written:] + [growing[i]] for i in range(len(models))]
            # of two siblings the lighter is summed; the other is its parent less that, exactly, as the sums are whole numbers
            asked = [k for k in open_nodes if k in lighter or k[1] == 0]
            parts = current.mapInArrow(
                lambda b, r=recent, o=asked, w=written: _gradient_nodes(b, width, models, bins, r, o, par, w > 0), "slot long, sums binary")
            hists = dict(zip(asked, np.moveaxis(_summed(parts, len(asked), width * codes_n).reshape(len(asked), 2, width, codes_n), 1, -1), strict=True))
            hists |= {(m, n): above[m, (n - 1) // 2] - hists[m, n + 1 if n % 2 else n - 1] for m, n in open_nodes if (m, n) not in hists}
            above, lighter, after = hists, set(), []
            for m, n in open_nodes:
                h = hists[m, n]
                tree, total = growing[models.index(m)], h[0].sum(0) / FIXED
                tree.value[n] = -par.eta * total[0] / (total[1] + par.leaf_l2)
                gain, f, c, side = best_split(h, sizes, par)
                if gain > 1e-6:
                    tree.split[n], tree.cut[n], tree.left[n], tree.value[n] = f, c, side, 0.0
                    m_hist = h[f] / FIXED
                    low = m_hist[: c + 1].sum(0) + (m_hist[-1] if side else 0)
                    lighter.add((m, 2 * n + 1 if 2 * low[1] <= total[1] else 2 * n + 2))
                    for child, s in ((2 * n + 1, low), (2 * n + 2, total - low)):
                        tree.value[child] = -par.eta * s[0] / (s[1] + par.leaf_l2)
                        if level + 1 < par.depth:
                            after.append((m, child))
            open_nodes = after
        for i, tree in enumerate(growing):
            done[i].append(tree)
        if (t + 1) % TREES_PER_WRITE == 0 and t + 1 < par.trees:
            fresh = [d[written:] for d in done]
            old, had = current, written > 0

            def add(batches, fresh=fresh, had=had):
                for b in batches:
                    codes = _by_column(b, width)
                    total = np.stack([margins(tr, codes) for tr in fresh], 1) + (_values(b.column(4), len(fresh)) if had else 0.0)
                    yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.ListArray.from_arrays(
                        pa.array(np.arange(0, total.size + 1, len(fresh)), pa.int32()), pa.array(total.ravel()))], ["row_hash", "label", "fold", "codes", "margins"])

            current = write_once(old.mapInArrow(add, "row_hash long, label int, fold int, codes binary, margins array<double>"), "margins")
            current = _held(current.coalesce(1) if old.rdd.getNumPartitions() == 1 else current, current._scratch)
            if had:
                release(old)
            written = t + 1
    if written:
        release(current)
    return done


# ------------------------------------------------------------------ forest
@dataclass(frozen=True)
class Forest:
    trees: int = 150
    depth: int = 6
    min_split: int = 5
    seed: int = 42


def mixed(x: np.ndarray) -> np.ndarray:
    """Scrambles unsigned 64-bit numbers (xorshift and multiply, twice)."""
    x = np.asarray(x, np.uint64)
    for shift, factor in ((32, 0xD6E8FEB86659FD93), (29, 0xA0761D6478BD642F)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(32))


def bootstrap_weights(row_hash: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """Poisson(1) weights by inversion of the hash of (row, tree)."""
    stream = mixed(np.array([seed * 1_000_003 + tree], np.uint64))
    u = mixed(mixed(row_hash.view(np.uint64)) + stream) / 2.0**64
    steps = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
    weight = np.zeros(len(u), np.int64)
    for step in steps:
        weight += u >= step
    return weight


def drawn_inputs(tree: int, node: int, width: int, seed: int) -> np.ndarray:
    """All inputs in the order in which the node tries them."""
    base = np.uint64((seed << 40) ^ (tree << 20) ^ node)
    return np.argsort(mixed(mixed(np.full(width, base)) + np.arange(width, dtype=np.uint64)), kind="stable")


def gini_split(hist: np.ndarray, sizes: np.ndarray, weights: tuple[float, float]) -> tuple[float, int, int, bool] | None:
    """(decrease, place, cut, missing left) of the best split from (input, code, [neg, pos, rows]) sums, or None.

    The impurity is Gini's with class weights; each side must hold rows."""
    w = hist[..., :2] * np.asarray(weights)
    total, rows = w[0].sum(0), hist[0, :, 2].sum()
    left, left_rows = np.cumsum(w[:, :-1], 1)[:, :-1], np.cumsum(hist[:, :-1, 2], 1)[:, :-1]

    def impurity(a):
        n = a.sum(-1)
        return n - (a**2).sum(-1) / np.where(n > 0, n, 1.0)

    options = []
    for extra, extra_rows in ((0.0, 0), (w[:, -1][:, None], hist[:, -1, 2][:, None])):
        side, n = left + extra, left_rows + extra_rows
        drop = impurity(total) - impurity(side) - impurity(total - side)
        options.append(np.where((n > 0) & (n < rows) & (np.arange(left.shape[1]) < sizes[:, None]), drop, -np.inf))
    drop = np.round(np.stack(options, -1), 9)
    f, c, side = np.unravel_index(int(np.argmax(drop)), drop.shape)
    return (float(drop[f, c, side]), int(f), int(c), bool(side)) if drop[f, c, side] > 1e-9 else None


def _forest_cells(batches, width, bins, trees, todo, seed, drawn):
    """Partial class counts of the open nodes in ``todo`` ((model, tree, node), inputs it tries): one row a node, its whole histogram packed."""
    codes_n = bins + 2
    per_node = drawn * codes_n
    by_tree: dict = {}
    for i, ((m, t, n), feats) in enumerate(todo):
        by_tree.setdefault((m, t), []).append((n, i, feats))
    total = None
    for b in (part.slice(at, PACKED_ROWS) for part in batches for at in range(0, part.num_rows, PACKED_ROWS)):
        codes = _by_column(b, width)
        folded = np.where(codes == MISSING, bins + 1, codes).ravel("F")
        row_hash, label, fold = (np.asarray(b.column(b.schema.get_field_index(c))) for c in ("row_hash", "label", "fold"))
        if total is None:
            total = np.zeros((len(todo), 3, per_node), np.int64)
        # class weights and rows of a cell in one number: three fields of PACKED_BITS bits, which PACKED_ROWS rows cannot fill
        scale = np.where(label == 1, float(1 << PACKED_BITS), 1.0)
        tree_now, weight = None, None
        for (m, t), nodes in sorted(by_tree.items(), key=lambda e: e[0][1]):
            if t != tree_now:
                tree_now, weight = t, bootstrap_weights(row_hash, t, seed)
                packed = weight * scale + float(1 << 2 * PACKED_BITS)
            tree = trees[m, t]
            slot = np.full(2 ** (tree.depth + 1), -1, np.int64)
            slot[[n for n, _, _ in nodes]] = np.arange(len(nodes))
            at = slot[tree.nodes(codes)]
            rows = np.flatnonzero((at >= 0) & (fold != m) & (weight > 0))
            if not len(rows):
                continue
            at, value = at[rows], packed[rows]
            feats = np.stack([f for _, _, f in nodes])  # -1 beyond the last input: its cells stay empty
            place = [i for _, i, _ in nodes]
            for j in range(drawn):
                use = feats[at, j]
                cell = at * codes_n + folded[use * len(codes) + rows]
                sums = np.bincount(cell, np.where(use >= 0, value, 0.0), len(nodes) * codes_n).astype(np.int64).reshape(len(nodes), codes_n)
                for k in range(3):
                    total[place, k, j * codes_n: (j + 1) * codes_n] += sums >> k * PACKED_BITS & (1 << PACKED_BITS) - 1
    if total is not None:
        on = np.flatnonzero(total.any((1, 2)))
        for at in range(0, len(on), 1000):
            part = on[at: at + 1000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([total[i].tobytes() for i in part], pa.binary())], ["slot", "counts"])


def _chooser(drawn: int, codes_n: int, known: list[np.ndarray], class_weights: list[tuple[float, float]]):
    """Partial histograms of a block of nodes -> each node's class counts and its split (place -1: none)."""
    def choose(group: pa.Table) -> pa.Table:
        hists: dict[int, np.ndarray] = {}
        for slot, raw in zip(group.column("slot").to_pylist(), group.column("counts").to_pylist(), strict=True):
            part = np.frombuffer(raw, np.int64)
            hists[slot] = hists[slot] + part if slot in hists else part
        out = []
        for slot, flat in hists.items():
            hist = flat.reshape(3, drawn, codes_n).transpose(1, 2, 0)
            counts = hist[0].sum(0)
            found = gini_split(hist[: len(known[slot])], known[slot], class_weights[slot]) if counts[0] and counts[1] else None
            out.append((slot, *map(int, counts), *(found or (0.0, -1, 0, False))))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _SPLIT.types, strict=True)], schema=_SPLIT)
    return choose


_SPLIT = pa.schema([("slot", pa.int64()), ("neg", pa.int64()), ("pos", pa.int64()), ("n", pa.int64()), ("drop", pa.float64()),
                    ("place", pa.int32()), ("cut", pa.int32()), ("side", pa.bool_())])


def forest(table: DataFrame, cuts: list[list[float]], models: list[int], weights: dict[int, tuple[float, float]], par: Forest,
           bins: int = BINS) -> tuple[list[list[Tree]], list[np.ndarray]]:
    """One forest per model (as in ``boost``) and its inputs' importances (mean normalised impurity decrease).

    The splits are picked in Spark, one group a node; a few numbers a node reach the driver."""
    width, codes_n = len(cuts), bins + 2
    drawn = max(1, int(math.sqrt(width)))
    sizes = np.array([len(c) for c in cuts])
    trees = {(m, t): Tree(par.depth) for m in models for t in range(par.trees)}
    gained = {k: np.zeros(width) for k in trees}
    frontier = [((m, t, 0), 0) for t in range(par.trees) for m in models]
    at_once = max(1, CELLS_PER_PASS // (drawn * codes_n))
    while frontier:
        now, frontier = frontier[:at_once], frontier[at_once:]
        todo = []
        for (m, t, n), tried in now:
            order = drawn_inputs(t, n, width, par.seed)[tried: tried + drawn]
            todo.append(((m, t, n), np.append(order, np.full(drawn - len(order), -1))))
        used = {(m, t): trees[m, t] for (m, t, _), _ in todo}
        known, by_class = [sizes[f[f >= 0]] for _, f in todo], [weights[m] for (m, _, _), _ in todo]
        parts = table.mapInArrow(lambda b, u=used, d=todo: _forest_cells(b, width, bins, u, d, par.seed, drawn), "slot long, counts binary")
        found = parts.groupBy((F.col("slot") / NODES_PER_GROUP).cast("long")).applyInArrow(_chooser(drawn, codes_n, known, by_class),
                                                   "slot long, neg long, pos long, n long, drop double, place int, cut int, side boolean").toPandas()
        for slot, neg, pos, n_rows, drop, place, cut, side in found.sort_values("slot").itertuples(index=False, name=None):
            ((m, t, n), feats), tried, tree = todo[slot], now[slot][1], trees[todo[slot][0][:2]]
            w = np.array([neg, pos]) * np.asarray(weights[m])
            tree.value[n] = w[1] / w.sum()
            depth = (n + 1).bit_length() - 1
            if depth >= par.depth or n_rows < par.min_split or not neg or not pos:
                continue
            if place >= 0:
                tree.split[n], tree.cut[n], tree.left[n] = feats[place], cut, side
                gained[m, t][feats[place]] += drop
                frontier += [((m, t, 2 * n + 1), 0), ((m, t, 2 * n + 2), 0)]
            elif tried + drawn < width:
                frontier.append(((m, t, n), tried + drawn))
    importances = []
    for m in models:
        each = [gained[m, t] / gained[m, t].sum() for t in range(par.trees) if gained[m, t].sum() > 0]
        importances.append(np.mean(each, axis=0) if each else np.zeros(width))
    return [[trees[m, t] for t in range(par.trees)] for m in models], importances


# ------------------------------------------------------------------ scoring
def ensemble_probability(kind: str, trees: list[Tree], codes: np.ndarray) -> np.ndarray:
    total = margins(trees, codes)
    return 1.0 / (1.0 + np.exp(-total)) if kind == "boosting" else total / max(1, len(trees))


class TreeEnsemble(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """A fitted ensemble as a pipeline stage: adds ``probability_1`` from the array column ``_inputs``; saved and loaded with its pipeline."""

    ensemble = Param(Params._dummy(), "ensemble", "kind, cut points and trees as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, ensemble: str = "{}"):
        super().__init__()
        self._setDefault(ensemble="{}")
        self._set(**self._input_kwargs)

    @classmethod
    def of(cls, kind: str, cuts: list[list[float]], trees: list[Tree], importances: np.ndarray | None = None) -> TreeEnsemble:
        return cls(ensemble=json.dumps({"kind": kind, "cuts": cuts, "trees": [t.record() for t in trees],
                                        "importances": None if importances is None else [float(x) for x in importances]}))

    @property
    def importances(self) -> list[float] | None:
        return json.loads(self.getOrDefault(self.ensemble))["importances"]

    def _transform(self, df: DataFrame) -> DataFrame:
        ship_code(df.sparkSession)
        state = json.loads(self.getOrDefault(self.ensemble))
        kind, cuts, trees = state["kind"], state["cuts"], [Tree.of(r) for r in state["trees"]]

        @F.pandas_udf("double")
        def probability(inputs: pd.Series) -> pd.Series:
            if not len(inputs):
                return pd.Series([], dtype=float)
            return pd.Series(ensemble_probability(kind, trees, bin_codes(np.stack(inputs.to_numpy()).astype(float), cuts)))

        return df.withColumn("probability_1", probability("_inputs"))
