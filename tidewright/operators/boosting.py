"""Regression trees boosted on squared loss and grown by leaves, for several targets over the same rows at once.

Rows are binned once by quantiles and packed into blocks of bytes. A round is one Spark job for all targets: tasks add up
gradient histograms of the leaves that are asked for, block by block, and Spark sums those of a leaf where its best split is
found, so only one split a leaf comes to the driver. Trees grow strictly by the leaf with the most gain; a round asks for every
leaf that may still be split, so a tree takes about as many rounds as it is deep, whatever the number of rows. Rows that are one task's anyway are fitted
in one job.

Predictions are carried in the blocks, which are written anew every few trees; between those times tasks add the newest trees.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import remove, written

BLOCK = 65_536
#: Rows that are worth a task of their own.
TASK = 16_384
#: Trees between two times that predictions are written.
WRITE_EVERY = 20


@dataclass(frozen=True)
class LeafWise:
    trees: int = 300
    rate: float = 0.05
    leaves: int = 31
    least_rows: int = 30
    columns_share: float = 0.9
    l2: float = 1.0
    patience: int = 100
    bins: int = 255
    seed: int = 42


@dataclass
class Tree:
    """Nodes in lists: a leaf has feature -1; others send a row left whose bin is at most `cut`."""

    feature: list[int] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def add(self, value: float = 0.0) -> int:
        for name, x in (("feature", -1), ("cut", 0), ("left", 0), ("right", 0), ("value", value)):
            getattr(self, name).append(x)
        return len(self.feature) - 1

    def split(self, node: int, feature: int, cut: int) -> tuple[int, int]:
        self.feature[node], self.cut[node], self.left[node], self.right[node] = feature, cut, self.add(), self.add()
        return self.left[node], self.right[node]

    def leaves_of(self, x: np.ndarray, cuts=None) -> np.ndarray:
        """The leaf of each row of x, whose columns hold bins, or values where `cuts` gives each node's."""
        feature, cut, left, right = np.array(self.feature), np.array(self.cut) if cuts is None else np.asarray(cuts), np.array(self.left), np.array(self.right)
        at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        while len(rows := rows[feature[at[rows]] >= 0]):
            here = at[rows]
            at[rows] = np.where(x[rows, feature[here]] <= cut[here], left[here], right[here])
        return at


@dataclass(frozen=True)
class BoostedTrees:
    """A fitted model: what it starts from and its trees, each with the values that its nodes compare with. A null or NaN goes right."""

    inputs: list[str]
    start: float
    trees: list[dict]

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for t in self.trees:
            tree = Tree(t["feature"], [], t["left"], t["right"], t["value"])
            out += np.array(tree.value)[tree.leaves_of(x, t["at"])]
        return out

    def transform(self, rows: DataFrame, name: str = "prediction") -> DataFrame:
        """rows with a column of predictions."""
        inputs, sent = self.inputs, rows.sparkSession.sparkContext.broadcast(self)
        schema = T.StructType([*[T.StructField(f.name, f.dataType, True) for f in rows.schema.fields if f.name != name], T.StructField(name, T.DoubleType())])

        def work(batches):
            for batch in batches:
                x = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in inputs], 1) if batch.num_rows else np.empty((0, len(inputs)))
                kept = [c for c in batch.schema.names if c != name]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(sent.value.predict(x))], names=[*kept, name])

        return rows.mapInArrow(work, schema)

    def save(self, spark: SparkSession, path: str) -> None:
        """One JSON line in the folder `path`, in place of what is there."""
        spark.createDataFrame([(json.dumps(asdict(self)),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> BoostedTrees:
        return BoostedTrees(**json.loads(spark.read.text(path).first()["value"]))


class Growth:
    """One tree while it grows. Nodes are split as soon as their children may matter; grown() keeps those that the best-first order takes."""

    def __init__(self, config: LeafWise, columns: list[int]):
        self.config, self.columns = config, columns
        self.tree, self.sums, self.best = Tree(), {}, {}
        self.tree.add()

    def tell(self, node: int, gain: float, feature: int, cut: int, left_g: float, left_n: int, g: float, n: int) -> None:
        self.sums[node], self.best[node] = (g, n), (gain, feature, cut, left_g, left_n)

    def gain(self, node: int) -> float:
        return self.best[node][0]

    def order(self) -> tuple[list[int], list[int]]:
        """The nodes that are split, best first, as far as is known, and those that must be expanded to know more."""
        if 0 not in self.best:
            return [], [0]
        open_nodes, done = [0], []
        while len(done) < self.config.leaves - 1:
            open_nodes.sort(key=lambda i: (-self.gain(i), i))
            if not open_nodes or self.gain(open_nodes[0]) <= 0:
                break
            first = open_nodes[0]
            children = (self.tree.left[first], self.tree.right[first])
            if self.tree.feature[first] < 0 or not all(c in self.best for c in children):
                # No node behind the splits still to be made can be taken before them.
                return done, [i for i in open_nodes[: self.config.leaves - 1 - len(done)] if self.gain(i) > 0]
            done.append(first)
            open_nodes[:1] = children
        return done, []

    def expand(self, nodes: list[int]) -> list[int]:
        """Splits nodes that aren't yet; the children whose histograms are needed. One with too few rows to be split needs none."""
        asked = []
        for i in nodes:
            if self.tree.feature[i] < 0:
                _, feature, cut, left_g, left_n = self.best[i]
                g, n = self.sums[i]
                for child, own in zip(self.tree.split(i, feature, cut), ((left_g, left_n), (g - left_g, n - left_n)), strict=True):
                    self.sums[child] = own
                    if own[1] < 2 * self.config.least_rows:
                        self.best[child] = (-np.inf, -1, 0, 0.0, 0)
            asked += [c for c in (self.tree.left[i], self.tree.right[i]) if c not in self.best]
        return asked

    def wanted(self) -> list[int]:
        """The nodes whose histograms are needed next; none once the tree is grown."""
        while True:
            _, nodes = self.order()
            if nodes == [0] and 0 not in self.best:
                return nodes
            asked = self.expand(nodes)
            if asked or not nodes:
                return asked

    def grown(self) -> Tree:
        taken, out = set(self.order()[0]), Tree()

        def copy(node: int, to: int) -> None:
            g, n = self.sums[node]
            if node in taken:
                for old, new in zip((self.tree.left[node], self.tree.right[node]), out.split(to, self.tree.feature[node], self.tree.cut[node]), strict=True):
                    copy(old, new)
            else:
                out.value[to] = -self.config.rate * g / (n + self.config.l2)

        copy(0, out.add())
        return out


def best_split(g: np.ndarray, n: np.ndarray, columns: list[int], least_rows: int, l2: float) -> tuple:
    """(gain, feature, cut, left_g, left_n, g, n) of the best split of histograms (feature x bin); the first of equal ones. Gain is -inf where none is allowed."""
    whole_g, whole_n = float(g[0].sum()), int(n[0].sum())
    left_g, left_n = g.cumsum(1), n.cumsum(1)
    right_g, right_n = whole_g - left_g, whole_n - left_n
    gain = left_g**2 / (left_n + l2) + right_g**2 / (right_n + l2) - whole_g**2 / (whole_n + l2)
    allowed = (left_n >= least_rows) & (right_n >= least_rows)
    allowed[[f for f in range(len(g)) if f not in set(columns)]] = False
    gain = np.where(allowed, gain, -np.inf)
    feature, cut = np.unravel_index(int(gain.argmax()), gain.shape)
    return float(gain[feature, cut]), int(feature), int(cut), float(left_g[feature, cut]), int(left_n[feature, cut]), whole_g, whole_n


def histograms(x: np.ndarray, g: np.ndarray, leaf: np.ndarray, nodes: list[int], bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of gradients and numbers of rows by node, feature and bin."""
    slot = np.full(int(leaf.max(initial=0)) + 1, -1)
    slot[[i for i in nodes if i < len(slot)]] = [k for k, i in enumerate(nodes) if i < len(slot)]
    at = slot[leaf]
    rows = np.flatnonzero(at >= 0)
    f = x.shape[1]
    cell = ((at[rows, None] * f + np.arange(f)) * bins + x[rows]).ravel()
    shape, size = (len(nodes), f, bins), len(nodes) * f * bins
    return np.bincount(cell, np.repeat(g[rows], f), size).reshape(shape), np.bincount(cell, minlength=size).reshape(shape)


def column_draws(config: LeafWise, n_inputs: int, tree: int) -> list[int]:
    """The inputs a tree may split on: a share of them, drawn by the seed and the tree's number."""
    some = max(1, round(config.columns_share * n_inputs))
    return sorted(np.random.default_rng([config.seed, tree]).choice(n_inputs, some, replace=False).tolist())


def bin_cuts(rows: DataFrame, inputs: list[str], bins: int) -> list[np.ndarray]:
    """For each input at most bins - 1 of its values, by quantiles."""
    shares = F.array(*[F.lit(i / (bins - 1)) for i in range(bins)])
    found = rows.agg(*[F.percentile_approx(F.col(f"`{c}`").cast("double"), shares, F.lit(10_000)).alias(f"q{i}") for i, c in enumerate(inputs)]).first()
    # The largest value needs no cut: nothing lies behind it.
    return [np.unique(np.array(q, float))[:-1] if q else np.empty(0) for q in found]


def packed(rows: DataFrame, inputs: list[str], targets: list[str], cuts: list[np.ndarray], start: list[float]) -> DataFrame:
    """Blocks (block, bins, y, pred, train) of rows: bins a byte each, the rest doubles and bytes, target by target."""

    def pack(batches):
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                values = lambda c: part.column(c).to_numpy(zero_copy_only=False).astype(float)  # noqa: B023, E731
                x = np.stack([np.searchsorted(cuts[i], values(f"x{i}")).astype(np.uint8) for i in range(len(inputs))], 1)
                y = np.stack([values(f"y{k}") for k in range(len(targets))])
                pred = np.repeat(np.array(start)[:, None], y.shape[1], 1)
                train = part.column("train").to_numpy(zero_copy_only=False).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *(pa.array([a.tobytes()], pa.binary()) for a in (x, y, pred, train))], names=["block", "bins", "y", "pred", "train"])
                block += 1

    columns = [*[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(inputs)], *[F.col(f"`{c}`").cast("double").alias(f"y{k}") for k, c in enumerate(targets)], "train"]
    return rows.select(*columns).mapInArrow(pack, "block long, bins binary, y binary, pred binary, train binary")


def unpack(row: dict, n_inputs: int, n_targets: int, newest: list[list[Tree]]) -> tuple:
    """A block's arrays, predictions with the newest trees added."""
    train = np.frombuffer(row["train"], np.uint8).astype(bool)
    x = np.frombuffer(row["bins"], np.uint8).reshape(len(train), n_inputs)
    y, pred = (np.frombuffer(row[c], float).reshape(n_targets, len(train)) for c in ("y", "pred"))
    pred = pred.copy()
    for k, trees in enumerate(newest):
        for tree in trees:
            pred[k] += np.array(tree.value)[tree.leaves_of(x)]
    return x, y, pred, train


def round_of(blocks: DataFrame, growths: dict[int, Growth], asked: dict[int, list[int]], newest: list[list[Tree]], n_inputs: int, config: LeafWise, errors: bool) -> list:
    """Rows (target, node, gain, feature, cut, left_g, left_n, g, n): the best split of each node asked for; for node -1 the absolute error and number of validation rows."""
    trees, columns, n_targets = {k: growths[k].tree for k in asked}, {k: growths[k].columns for k in asked}, len(newest)

    def add_up(batches):
        sums: dict[int, list] = {}
        first, told = None, np.zeros((n_targets, 2))
        for batch in batches:
            for row in batch.to_pylist():
                first = row["block"] if first is None else min(first, row["block"])
                x, y, pred, train = unpack(row, n_inputs, n_targets, newest)
                for k, nodes in asked.items():
                    if errors:
                        told[k] += np.abs(pred[k] - y[k])[~train].sum(), (~train).sum()
                    g, n = histograms(x[train], (pred[k] - y[k])[train], trees[k].leaves_of(x[train]), nodes, config.bins)
                    sums[k] = [a + b for a, b in zip(sums[k], (g, n), strict=True)] if k in sums else [g, n]
        out = [(k, node, first, g[i].tobytes(), n[i].astype(np.int64).tobytes()) for k, (g, n) in sums.items() for i, node in enumerate(asked[k])]
        out += [(k, -1, first, told[k].tobytes(), b"") for k in asked if errors and first is not None]
        names, kinds = ["target", "node", "part", "g", "n"], [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names=names)

    def judge(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["part"])
        k, node = rows[0]["target"], rows[0]["node"]
        g = sum(np.frombuffer(r["g"], float) for r in rows)
        if node < 0:
            found = (0.0, -1, 0, 0.0, 0, float(g[0]), int(g[1]))
        else:
            shape = (n_inputs, config.bins)
            found = best_split(g.reshape(shape), sum(np.frombuffer(r["n"], np.int64) for r in rows).reshape(shape), columns[k], config.least_rows, config.l2)
        return pa.table([pa.array([v], kind) for v, kind in zip((k, node, *found), kinds, strict=True)], names=names)

    names = ["target", "node", "gain", "feature", "cut", "left_g", "left_n", "g", "n"]
    kinds = [pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.float64(), pa.int64()]
    parts = blocks.mapInArrow(add_up, "target int, node int, part long, g binary, n binary")
    return parts.groupBy("target", "node").applyInArrow(judge, "target int, node int, gain double, feature int, cut int, left_g double, left_n long, g double, n long").collect()


def advanced(blocks: DataFrame, newest: list[list[Tree]], n_inputs: int) -> DataFrame:
    """The blocks with the newest trees in their predictions."""
    n_targets = len(newest)

    def move(batches):
        for batch in batches:
            rows = batch.to_pylist()
            preds = [unpack(r, n_inputs, n_targets, newest)[2].tobytes() for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array(preds, pa.binary()) if c == "pred" else batch.column(c) for c in batch.schema.names], names=batch.schema.names)

    return blocks.mapInArrow(move, blocks.schema)


def fitted_here(blocks: DataFrame, n_inputs: int, n_targets: int, config: LeafWise, others: bool) -> dict[int, tuple[list[Tree], int]]:
    """The trees of each target and how many of them are best, where all blocks are no more than one task's rows.

    A job of one stage does what rounds do, a task for each target, as a round's own cost would be most of it. Sums are made block by
    block as in rounds, so the trees are the same.
    """

    def grow(table: pa.Table) -> pa.Table:
        k = table.column("target")[0].as_py()
        parts = [unpack(row, n_inputs, n_targets, [[] for _ in range(n_targets)]) for row in sorted(table.to_pylist(), key=lambda r: r["block"])]
        parts = [(x[train], y[k][train], pred[k][train], x[~train], y[k][~train], pred[k][~train]) for x, y, pred, train in parts]
        trees, best = [], (np.inf, 0)
        for number in range(config.trees + 1):
            if number and others:
                # Summed up as rounds do: each block's errors, then the blocks'.
                told = sum(np.abs(pred - y).sum() for *_, y, pred in parts)
                best = min(best, (float(told) / max(1, sum(len(y) for *_, y, _ in parts)), number))
            if number == config.trees or (number and others and number - best[1] >= config.patience):
                break
            growth = Growth(config, column_draws(config, n_inputs, number))
            while asked := growth.wanted():
                found = [histograms(x, pred - y, growth.tree.leaves_of(x), asked, config.bins) for x, y, pred, *_ in parts]
                g, n = (sum(f[i] for f in found) for i in (0, 1))
                for i, node in enumerate(asked):
                    growth.tell(node, *best_split(g[i], n[i], growth.columns, config.least_rows, config.l2))
            tree = growth.grown()
            if len(tree.feature) == 1:
                break
            trees.append(tree)
            value = np.array(tree.value)
            for x, _, pred, other, _, other_pred in parts:
                pred += value[tree.leaves_of(x)]
                other_pred += value[tree.leaves_of(other)]
        return pa.table({"target": pa.array([k], pa.int32()), "trees": [json.dumps([asdict(t) for t in trees])], "best": pa.array([best[1]], pa.int32())})

    dealt = blocks.select(F.explode(F.array(*[F.lit(k) for k in range(n_targets)])).alias("target"), "*")
    found = dealt.repartitionByRange(n_targets, "target").groupBy("target").applyInArrow(grow, "target int, trees string, best int").collect()
    return {r["target"]: ([Tree(**t) for t in json.loads(r["trees"])], r["best"]) for r in found}


def fit(rows: DataFrame, inputs: list[str], targets: list[str], train: Column, config: LeafWise = LeafWise()) -> list[BoostedTrees]:
    """One model for each target, fitted on the rows for which `train` holds; the others validate.

    Squared loss, from the mean of each target; a leaf's value is its mean error shrunk by l2, times the rate. A target's
    trees end once no leaf can be split, or its absolute error on the validation rows hasn't fallen for `patience` trees, and
    are cut back to the best number; without validation rows all trees stay. Inputs and targets must not be null, and there must be train rows.
    """
    if not 2 <= config.bins <= 256:
        raise ValueError("a bin is a byte: 2 to 256 of them")
    spark = rows.sparkSession
    marked = rows.withColumn("train", train)
    nulls = sum((F.count_if(F.col(f"`{c}`").isNull() | F.isnan(F.col(f"`{c}`").cast("double"))) for c in dict.fromkeys([*inputs, *targets])), F.lit(0))
    facts = marked.agg(nulls.alias("nulls"), F.count_if("train").alias("n"), F.count_if(~F.col("train")).alias("others"), *[F.avg(F.when(F.col("train"), F.col(f"`{t}`"))).alias(f"m{k}") for k, t in enumerate(targets)]).first()
    if facts["nulls"] or not facts["n"]:
        raise ValueError(f"{facts['nulls']} nulls in {facts['n']} rows to train on")
    cuts = bin_cuts(marked.where("train"), inputs, config.bins)
    start = [facts[f"m{k}"] for k in range(len(targets))]
    tasks = max(1, -(-(facts["n"] + facts["others"]) // TASK))
    blocks = written(packed(marked.coalesce(tasks), inputs, targets, cuts, start), "binned_rows")
    kept: list[list[Tree]] = [[] for _ in targets]
    newest: list[list[Tree]] = [[] for _ in targets]
    best = [(np.inf, 0)] * len(targets)
    going = set(range(len(targets)))
    if tasks == 1:
        for k, (trees, n) in fitted_here(blocks, len(inputs), len(targets), config, bool(facts["others"])).items():
            kept[k], best[k] = trees, (0.0, n)
        going = set()
    for number in range(config.trees + 1 if going else 0):
        # The root's round also tells the error of the trees before; after the last tree that alone is wanted.
        growths = {k: Growth(config, column_draws(config, len(inputs), number)) for k in going}
        asked, errors = {k: growths[k].wanted() for k in going}, bool(facts["others"])
        if number == config.trees and not errors:
            break
        while asked:
            for r in round_of(blocks, growths, asked, newest, len(inputs), config, errors):
                if r["node"] < 0:
                    mae = r["g"] / max(1, r["n"])
                    if number:
                        best[r["target"]] = min(best[r["target"]], (mae, number))
                else:
                    growths[r["target"]].tell(*[r[c] for c in ("node", "gain", "feature", "cut", "left_g", "left_n", "g", "n")])
            errors = False
            if number == config.trees:
                break
            asked = {k: nodes for k in asked if (nodes := growths[k].wanted())}
        if number == config.trees:
            break
        going = {k for k in going if not facts["others"] or not number or number - best[k][1] < config.patience}
        if not going:
            break
        for k in list(going):
            tree = growths[k].grown()
            if len(tree.feature) == 1:
                going.remove(k)
                continue
            kept[k].append(tree)
            newest[k].append(tree)
        if (number + 1) % WRITE_EVERY == 0:
            old, blocks, newest = blocks, written(advanced(blocks, newest, len(inputs)), "binned_rows"), [[] for _ in targets]
            for path in {f.rsplit("/", 1)[0] for f in old.inputFiles()}:
                remove(spark, path)
    # As values: bin b ends at the cut b of its input.
    at = lambda t: [float(cuts[f][c]) if f >= 0 else 0.0 for f, c in zip(t.feature, t.cut, strict=True)]
    size = lambda k: best[k][1] if facts["others"] else len(kept[k])
    return [BoostedTrees(list(inputs), start[k], [{"feature": t.feature, "left": t.left, "right": t.right, "value": t.value, "at": at(t)} for t in kept[k][: size(k)]]) for k in range(len(targets))]
