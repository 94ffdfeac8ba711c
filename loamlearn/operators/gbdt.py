"""Gradient boosted trees on binned features.

Rows are (y, weight, bins array, score, gradient pairs); a level's histograms are one job: tasks route
their rows through the tree so far and count into per-node histograms, which are summed on the executors
by node and range of features, in two steps if there are many tasks. Only the smaller child of a split
is counted, its sibling is the parent minus it. Growth by loss counts for the best few open nodes
at once, so that a job serves several splits. Split search, growth policy and the pool of histograms are on the
driver, which holds nodes x features x bins numbers at most, whatever the number of rows.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.losses import A, MultiLoss, loss as loss_of
from ..functions.quantile import weighted_quantiles
from ..plans.session import Rolling, saved
from .binning import assign, bin_edges, split_value


@dataclass
class Node:
    feature: int = -1
    #: The last bin that goes left, and the first one that went right.
    left_bin: int = -1
    right_bin: int = -1
    left: int = -1
    right: int = -1
    value: float = 0.0
    gain: float = 0.0
    hess: float = 0.0
    count: int = 0
    threshold: float = 0.0
    default_left: bool = True
    depth: int = 0

    @property
    def leaf(self) -> bool:
        return self.left < 0


@dataclass
class Tree:
    nodes: list[Node] = field(default_factory=list)

    def route(self, bins: np.ndarray) -> np.ndarray:
        """The node that each row of bins ends in."""
        at = np.zeros(len(bins), np.int64)
        feature = np.array([n.feature for n in self.nodes])
        cut = np.array([n.left_bin for n in self.nodes])
        left, right = np.array([n.left for n in self.nodes]), np.array([n.right for n in self.nodes])
        todo = np.flatnonzero(left[at] >= 0)
        while len(todo):
            a = at[todo]
            at[todo] = np.where(bins[todo, feature[a]] <= cut[a], left[a], right[a])
            todo = todo[left[at[todo]] >= 0]
        return at

    def route_values(self, values: np.ndarray) -> np.ndarray:
        """The same by feature values; NaN follows the default child."""
        at = np.zeros(len(values), np.int64)
        feature, cut = np.array([n.feature for n in self.nodes]), np.array([n.threshold for n in self.nodes])
        left, right = np.array([n.left for n in self.nodes]), np.array([n.right for n in self.nodes])
        default = np.array([n.default_left for n in self.nodes])
        todo = np.flatnonzero(left[at] >= 0)
        while len(todo):
            a = at[todo]
            v = values[todo, feature[a]]
            at[todo] = np.where(np.where(np.isnan(v), default[a], v <= cut[a]), left[a], right[a])
            todo = todo[left[at[todo]] >= 0]
        return at

    @property
    def values(self) -> np.ndarray:
        return np.array([n.value for n in self.nodes])

    @property
    def leaves(self) -> int:
        return sum(n.leaf for n in self.nodes)

    @property
    def depth(self) -> int:
        return max((n.depth for n in self.nodes), default=0)


@dataclass
class Forest:
    """Trees in rounds of one a group (class)."""

    features: list[str]
    trees: list[Tree] = field(default_factory=list)
    objective: str = "sigmoid"
    groups: int = 1
    base_prediction: float = 0.5
    averaged: bool = False

    @property
    def base_score(self) -> float:
        o = loss_of(self.objective)
        return 0.0 if isinstance(o, MultiLoss) else float(o.inverse(A, np.float64(self.base_prediction)))

    def score(self, values: np.ndarray) -> np.ndarray:
        """Rows x groups, from feature values."""
        out = np.zeros((len(values), self.groups))
        for i, t in enumerate(self.trees):
            out[:, i % self.groups] += t.values[t.route_values(values)]
        rounds = max(1, len(self.trees) // self.groups)
        return self.base_score + (out / rounds if self.averaged else out)

    def leaf_ids(self, values: np.ndarray) -> np.ndarray:
        return np.stack([t.route_values(values) for t in self.trees], axis=1) if self.trees else np.zeros((len(values), 0), int)

    def importance(self) -> list[tuple[str, int, float]]:
        """feature, splits, summed gain; the greatest gain first."""
        out: dict[str, list] = {}
        for t in self.trees:
            for n in t.nodes:
                if not n.leaf:
                    s = out.setdefault(self.features[n.feature], [0, 0.0])
                    s[0], s[1] = s[0] + 1, s[1] + n.gain
        return sorted(((k, a, b) for k, (a, b) in out.items()), key=lambda r: (-r[2], r[0]))

    def node_rows(self) -> list[tuple]:
        """(tree, node, feature, threshold, left, right, default_left, leaf, gain, hess_sum, sample_cnt)."""
        return [(i, j, None if n.leaf else self.features[n.feature], n.threshold, n.left, n.right, n.default_left, n.value if n.leaf else None, n.gain, n.hess, n.count) for i, t in enumerate(self.trees) for j, n in enumerate(t.nodes)]


NODE_SCHEMA = "tree int, node int, feature string, threshold double, left int, right int, default_left boolean, leaf double, gain double, hess_sum double, sample_cnt long"


@dataclass
class Params:
    rounds: int = 10
    learning_rate: float = 0.1
    max_depth: int = 6
    max_leaves: int = 64
    policy: str = "level"
    min_child_hess: float = 1.0
    min_split_samples: int = -1
    min_split_loss: float = 1e-5
    max_abs_leaf: float = 0.0
    l1: float = 0.0
    l2: float = 0.0
    feature_rate: float = 1.0
    instance_rate: float = 1.0
    averaged: bool = False
    split_type: str = "mean"
    lad_refine: bool = False
    base_prediction: float = 0.5
    zmax: float = 0.0
    seed: int = 1
    pool: int = 512

    @property
    def leaf_cap(self) -> int:
        deep = 2**self.max_depth if 0 < self.max_depth < 31 else 2**31
        return min(self.max_leaves if self.max_leaves > 0 else deep, deep)


def leaf_value(g, h, p: Params):
    """-T(G) / (H + l2), held to max_abs_leaf; 0 where H is too small."""
    t = np.sign(g) * np.maximum(np.abs(g) - p.l1, 0)
    v = -t / np.where(h + p.l2 == 0, 1, h + p.l2)
    if p.max_abs_leaf > 0:
        v = np.clip(v, -p.max_abs_leaf, p.max_abs_leaf)
    return np.where(h < p.min_child_hess, 0.0, v)


def gain_of(g, h, p: Params):
    t = np.sign(g) * np.maximum(np.abs(g) - p.l1, 0)
    if p.max_abs_leaf > 0:
        v = leaf_value(g, h, p)
        got = -2 * (g * v + 0.5 * (h + p.l2) * v * v + p.l1 * np.abs(v))
    else:
        got = t * t / np.where(h + p.l2 == 0, 1, h + p.l2)
    return np.where(h < p.min_child_hess, 0.0, got)


def best_split(hist: np.ndarray, p: Params, allowed: np.ndarray | None = None):
    """(gain, feature, left bin, right bin) of a histogram (features x bins x (G, H, n)), or None.

    Ties go to the smaller feature, then the earlier bin. Bins without G and H are passed over.
    """
    g, h = hist[..., 0], hist[..., 1]
    total_g, total_h = g[0].sum(), h[0].sum()
    used = (g != 0) | (h != 0)
    lg, lh = np.cumsum(g, axis=1), np.cumsum(h, axis=1)
    rg, rh = total_g - lg, total_h - lh
    later = np.flip(np.cumsum(np.flip(used, 1), axis=1), 1) - used
    ok = used & (later > 0) & (lh >= p.min_child_hess) & (rh >= p.min_child_hess)
    if allowed is not None:
        ok &= allowed[:, None]
    gain = np.where(ok, gain_of(lg, lh, p) + gain_of(rg, rh, p) - gain_of(total_g, total_h, p), -np.inf)
    at = int(gain.argmax())
    f, b = divmod(at, g.shape[1])
    if not np.isfinite(gain[f, b]):
        return None
    return float(gain[f, b]), f, b, b + 1 + int(np.argmax(used[f, b + 1 :]))


#: Partial histograms that one task adds at first, and numbers of one of them in one row.
FAN, SPREAD = 64, 4096
#: Open nodes that growth by loss counts for in one job.
AHEAD = 16


def histograms(rows: DataFrame, tree: Tree, wanted: list[int], n_features: int, n_bins: int, group: int = 0, tasks: int | None = None) -> dict[int, np.ndarray]:
    """Sums of (G, H, n) by feature and bin over sampled rows of the wanted nodes: one job.

    tasks: partitions of ``rows``, if known.
    """
    sent = rows.sparkSession.sparkContext.broadcast((tree, wanted))
    size = n_features * n_bins
    parts = -(-size // SPREAD)

    def run(batches):
        import pyarrow as pa

        tree, wanted = sent.value
        place = np.full(len(tree.nodes), -1)
        place[wanted] = np.arange(len(wanted))
        out, some = np.zeros((len(wanted), 3, size)), False
        base = np.arange(n_features) * n_bins
        for batch in batches:
            get = lambda c: batch.column(batch.schema.get_field_index(c))
            on = get("sampled").to_numpy(zero_copy_only=False).astype(bool)
            bins = get("bins").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, n_features)[on]
            pairs = get("pairs").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1, 2)[on, group]
            at = place[tree.route(bins)]
            keep = at >= 0
            slots = (bins[keep] + base).ravel()
            where = np.repeat(at[keep], n_features) * size + slots
            for j, v in enumerate((pairs[keep, 0], pairs[keep, 1], np.ones(int(keep.sum())))):
                out[:, j] += np.bincount(where, np.repeat(v, n_features), len(wanted) * size).reshape(len(wanted), size)
            some = True
        if some:
            cut = [(n, i, np.ascontiguousarray(x[:, i * SPREAD : (i + 1) * SPREAD]).tobytes()) for n, x in zip(wanted, out, strict=True) for i in range(parts)]
            yield pa.RecordBatch.from_arrays([pa.array([c[0] for c in cut], pa.int32()), pa.array([c[1] for c in cut], pa.int32()), pa.array([c[2] for c in cut], pa.binary())], ["node", "part", "h"])

    def add(table):
        import pyarrow as pa

        total = np.zeros(len(table.column("h")[0].as_py()) // 8)
        for x in table.column("h"):
            total += np.frombuffer(x.as_py())
        return pa.table({"node": table.column("node").slice(0, 1), "part": table.column("part").slice(0, 1), "h": pa.array([total.tobytes()], pa.binary())})

    schema = "node int, part int, h binary"
    sums = rows.select("bins", "pairs", "sampled").mapInArrow(run, schema)
    if (rows.rdd.getNumPartitions() if tasks is None else tasks) > FAN:
        sums = sums.groupBy("node", "part", F.floor(F.spark_partition_id() / FAN)).applyInArrow(add, schema)
    got: dict[int, list] = {}
    for r in sums.groupBy("node", "part").applyInArrow(add, schema).collect():
        got.setdefault(r["node"], [None] * parts)[r["part"]] = np.frombuffer(r["h"]).reshape(3, -1)
    sent.destroy()
    return {n: np.concatenate(h, axis=1).reshape(3, n_features, n_bins).transpose(1, 2, 0) for n, h in got.items()}


class Pool:
    """Histograms of open nodes, the least recently used ones going first."""

    def __init__(self, capacity: int):
        self.capacity, self.held = capacity, {}

    def get(self, node: int):
        if node in self.held:
            self.held[node] = self.held.pop(node)
            return self.held[node]
        return None

    def put(self, node: int, hist: np.ndarray) -> None:
        self.held.pop(node, None)
        self.held[node] = hist
        while len(self.held) > self.capacity:
            self.held.pop(next(iter(self.held)))


def grow(rows: DataFrame, n_features: int, n_bins: int, p: Params, group: int = 0, rng=None) -> Tree:
    rng = rng or np.random.default_rng(p.seed)
    allowed = None
    if p.feature_rate < 1:
        allowed = np.zeros(n_features, bool)
        allowed[rng.permutation(n_features)[: max(1, round(p.feature_rate * n_features))]] = True
    tree, pool = Tree([Node()]), Pool(p.pool)
    tasks = rows.rdd.getNumPartitions()
    fetch = lambda nodes, t=tree: histograms(rows, t, nodes, n_features, n_bins, group, tasks)
    first = fetch([0]).get(0)
    if first is None:
        return tree
    pool.put(0, first)

    def settle(i: int, hist: np.ndarray):
        """Fills the node in and finds its split."""
        node, total = tree.nodes[i], hist[0].sum(axis=0)
        node.hess, node.count = float(total[1]), int(round(total[2]))
        node.value = float(leaf_value(total[0], total[1], p)) * p.learning_rate
        if node.hess < 2 * p.min_child_hess or node.count < p.min_split_samples or (p.max_depth > 0 and node.depth >= p.max_depth):
            return None
        found = best_split(hist, p, allowed)
        return found if found and found[0] > p.min_split_loss else None

    queue: list = []
    seq = 0

    def push(i: int, hist: np.ndarray):
        nonlocal seq
        if (found := settle(i, hist)) is not None:
            heapq.heappush(queue, ((-found[0], seq) if p.policy == "loss" else (0, seq), i, found))
            seq += 1

    def smaller_left(hist: np.ndarray, f: int, b: int) -> bool:
        return hist[f, : b + 1, 2].sum() <= hist[f, b + 1 :, 2].sum()

    counted: dict[int, np.ndarray] = {}  # node to be split: its smaller child's histogram

    def count_ahead(batch: list, hists: dict) -> None:
        """Counts for the nodes of the batch and, by loss, for the next best ones, as if they were split already."""
        ahead = batch if p.policy != "loss" else batch + [(i, found) for _, i, found in heapq.nsmallest(AHEAD, queue) if pool.get(i) is not None]
        plan = Tree([Node(**n.__dict__) for n in tree.nodes])
        of = {}
        for i, (_, f, b, r) in ahead:
            if i in counted:
                continue
            hist, node = hists.get(i, pool.get(i)), plan.nodes[i]
            node.feature, node.left_bin, node.right_bin, node.left, node.right = f, b, r, len(plan.nodes), len(plan.nodes) + 1
            plan.nodes += [Node(), Node()]
            of[node.left if smaller_left(hist, f, b) else node.right] = i
        got = fetch(list(of), plan)
        for child, i in of.items():
            counted[i] = got.get(child, np.zeros((n_features, n_bins, 3)))

    push(0, first)
    leaves = 1
    while queue and leaves < p.leaf_cap:
        # by level all open nodes of the level are split in one job, by loss the best one
        batch = []
        while queue and leaves + len(batch) < p.leaf_cap and (not batch or p.policy != "loss" and tree.nodes[queue[0][1]].depth == tree.nodes[batch[0][0]].depth):
            _, i, found = heapq.heappop(queue)
            batch.append((i, found))
        lost = [i for i, _ in batch if pool.get(i) is None]
        again = fetch(lost) if lost else {}
        hists = {i: pool.get(i) if pool.get(i) is not None else again[i] for i, _ in batch}
        if any(i not in counted for i, _ in batch):
            count_ahead(batch, hists)
        for i, (gain, f, b, r) in batch:
            hist, one, node = hists[i], counted.pop(i), tree.nodes[i]
            node.feature, node.left_bin, node.right_bin, node.gain = f, b, r, gain
            node.left, node.right = len(tree.nodes), len(tree.nodes) + 1
            tree.nodes += [Node(depth=node.depth + 1), Node(depth=node.depth + 1)]
            small, large = (node.left, node.right) if smaller_left(hist, f, b) else (node.right, node.left)
            pool.held.pop(i, None)
            pool.put(small, one)
            pool.put(large, hist - one)
            for child in (node.left, node.right):
                push(child, one if child == small else hist - one)
            leaves += 1
    return tree


def _binning(samples: DataFrame, features: list[str], values: dict[str, np.ndarray], fills: dict[str, float] | None, init_col: str | None):
    """Rows with raw values, what turns batches of them into batches with bins, and the fields of those."""
    edges = [bin_edges(values[f]) for f in features]
    fill = np.array([(fills or {}).get(f, 0.0) for f in features])
    sent = samples.sparkSession.sparkContext.broadcast((edges, fill))
    raw = F.array(*[F.coalesce(F.element_at("features", F.lit(f)).cast("double"), F.lit(float("nan"))) for f in features])
    base = samples.select(F.col("label").alias("y"), F.col("weight").cast("double").alias("weight"), raw.alias("raw"), *([F.col(init_col).alias("init")] if init_col else []))

    def run(batches):
        import pyarrow as pa

        edges, fill = sent.value
        for batch in batches:
            i = batch.schema.get_field_index("raw")
            v = batch.column(i).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(edges))
            v = np.where(np.isnan(v), fill, v)
            bins = np.stack([assign(v[:, j], e) for j, e in enumerate(edges)], axis=1).astype(np.int32)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * len(edges), pa.int32()), pa.array(bins.ravel()))
            kept = [c for c in batch.schema.names if c != "raw"]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), flat], [*kept, "bins"])

    from pyspark.sql import types as T

    return base, run, [*(f for f in base.schema.fields if f.name != "raw"), T.StructField("bins", T.ArrayType(T.IntegerType()))]


def prepare(samples: DataFrame, features: list[str], values: dict[str, np.ndarray], fills: dict[str, float] | None = None, init_col: str | None = None) -> DataFrame:
    """y (array), weight, bins: dense rows with missing values filled. samples: label, weight, features (map)."""
    from pyspark.sql import types as T

    base, run, fields = _binning(samples, features, values, fills, init_col)
    return base.mapInArrow(run, T.StructType(fields))


def gradient_pairs(scores: np.ndarray, y: np.ndarray, weight: np.ndarray, objective) -> np.ndarray:
    """Rows x groups x (g, h), times the weight."""
    if isinstance(objective, MultiLoss):
        k = scores.shape[1]
        s = [scores[:, j] for j in range(k)]
        t = [y[:, j] for j in range(k)] if y.shape[1] > 1 else [(y[:, 0] == j).astype(float) for j in range(k)]
        g, h = np.stack(objective.first(A, s, t), 1), np.stack(objective.second(A, s, t), 1)
    else:
        g, h = objective.first(A, scores[:, 0], y[:, 0])[:, None], objective.second_for_trees(A, scores[:, 0], y[:, 0])[:, None]
    return np.stack([g, h], axis=2) * weight[:, None, None]


def _advancing(spark, fields: list, trees: list[Tree], forest: Forest, p: Params, round_no: int):
    """What turns batches of a state, with random numbers in __u, into those of the next one, and the schema of that."""
    groups = forest.groups
    sent = spark.sparkContext.broadcast((trees, forest.objective, p, forest.base_score))
    from pyspark.sql import types as T

    schema = T.StructType([*fields, T.StructField("sum", T.ArrayType(T.DoubleType())), T.StructField("pairs", T.ArrayType(T.DoubleType())), T.StructField("sampled", T.BooleanType())])
    keep = [f.name for f in fields]

    def run(batches):
        import pyarrow as pa

        trees, name, p, base = sent.value
        objective = loss_of(name, **({"zmax": p.zmax} if p.zmax else {}))
        lists = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(m.ravel()))
        for batch in batches:
            n = batch.num_rows
            get = lambda c: batch.column(batch.schema.get_field_index(c))
            bins = get("bins").flatten().to_numpy(zero_copy_only=False)
            bins = bins.reshape(n, -1)
            total = get("sum").flatten().to_numpy(zero_copy_only=False).reshape(n, groups).copy()
            for i, t in enumerate(trees):
                total[:, i % groups] += t.values[t.route(bins)]
            start = get("init").flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if "init" in batch.schema.names else base
            done = round_no if p.averaged else 1
            y = get("y").flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(float)
            pairs = gradient_pairs(start + total / max(1, done), y, get("weight").to_numpy(), objective)
            yield pa.RecordBatch.from_arrays([*[get(c) for c in keep], lists(total), lists(pairs.reshape(n, -1)), pa.array(get("__u").to_numpy() < p.instance_rate)], schema.names)

    return run, schema


def advanced(state: DataFrame, trees: list[Tree], forest: Forest, p: Params, round_no: int, save=None) -> DataFrame:
    """The state after some trees: new scores, gradient pairs and this round's sample. Saved, so lineage doesn't grow;
    ``save`` may replace the state before."""
    fields = [f for f in state.schema.fields if f.name not in ("sum", "pairs", "sampled")]
    run, schema = _advancing(state.sparkSession, fields, trees, forest, p, round_no)
    out = state.withColumn("__u", F.rand(p.seed * 7919 + round_no)).mapInArrow(run, schema)
    return save(out) if save else saved(out, "boosting")


def begin(samples: DataFrame, features: list[str], values: dict[str, np.ndarray], forest: Forest, p: Params, round_no: int = 0, fills: dict[str, float] | None = None, init_col: str | None = None, save=None) -> DataFrame:
    """The state after the forest's trees: ``prepare`` and ``advanced`` in one pass, so that a task has one Python worker
    instead of two."""
    base, bins, fields = _binning(samples, features, values, fills, init_col)
    run, schema = _advancing(samples.sparkSession, fields, forest.trees, forest, p, round_no)
    source = base.withColumn("sum", F.array_repeat(F.lit(0.0), forest.groups)).withColumn("__u", F.rand(p.seed * 7919 + round_no))
    out = source.mapInArrow(lambda batches: run(bins(batches)), schema)
    return save(out) if save else saved(out, "boosting")


def lad_refined(state: DataFrame, tree: Tree, forest: Forest, p: Params, round_no: int) -> None:
    """Leaves become learning rate times the weighted median of y minus the score, initial score included."""
    sent = state.sparkSession.sparkContext.broadcast(tree)
    base, done = forest.base_score, round_no if p.averaged else 1

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            n = batch.num_rows
            get = lambda c: batch.column(batch.schema.get_field_index(c))
            flat = lambda c: get(c).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            start = flat("init")[:, 0] if "init" in batch.schema.names else base
            left = flat("y")[:, 0].astype(float) - start - flat("sum")[:, 0] / max(1, done)
            yield pa.RecordBatch.from_arrays([pa.array(sent.value.route(flat("bins")).astype(np.int32)), pa.array(left), get("weight")], ["leaf", "left", "weight"])

    got = weighted_quantiles(state.filter("sampled").mapInArrow(run, "leaf int, left double, weight double"), ["leaf"], F.col("left"), F.col("weight"))
    for r in got.collect():
        tree.nodes[r["leaf"]].value = float(r["quantile"]) * p.learning_rate


def finish(tree: Tree, values: list[np.ndarray], fills: np.ndarray, kind: str) -> None:
    """Thresholds from bins, and where missing values go: left if the fill value does."""
    for n in tree.nodes:
        if not n.leaf:
            n.threshold = split_value(values[n.feature], n.left_bin, n.right_bin, kind)
            n.default_left = bool(fills[n.feature] < n.threshold)


def train(samples: DataFrame, features: list[str], values: dict[str, np.ndarray], objective: str = "sigmoid", params: Params = Params(), classes: int = 1, fills: dict[str, float] | None = None, init_col: str | None = None, start: Forest | None = None, on_round=None) -> Forest:
    """samples: label (array), weight, features (map). values: candidate values of each feature, sorted.

    start continues a forest; on_round(round, forest) may look at it.
    """
    p = params if not params.averaged else Params(**{**params.__dict__, "learning_rate": 1.0})
    groups = classes if isinstance(loss_of(objective), MultiLoss) else 1
    forest = start or Forest(features, [], objective, groups, p.base_prediction, p.averaged)
    if (forest.objective, forest.groups) != (objective, groups):
        raise ValueError("the forest to continue has another objective or number of classes")
    sorted_values = [np.sort(np.asarray(values[f], float)) for f in features]
    fill = np.array([(fills or {}).get(f, 0.0) for f in features])
    n_bins = max(len(v) for v in sorted_values)
    begun = len(forest.trees) // groups
    if start:
        for t in forest.trees:  # thresholds back to bins
            for n in t.nodes:
                if not n.leaf:
                    n.left_bin = int(np.searchsorted(sorted_values[n.feature], n.threshold, "right")) - 1
    states = Rolling(samples.sparkSession, "boosting")  # the disk holds two states, whatever the number of rounds
    try:
        state = begin(samples, features, values, forest, p, begun, fills, init_col, states.save)
        rng = np.random.default_rng(p.seed)
        for r in range(begun, begun + p.rounds):
            new = [grow(state, len(features), n_bins, p, k, rng) for k in range(groups)]
            for t in new:
                if p.lad_refine:
                    lad_refined(state, t, forest, p, r)
                finish(t, sorted_values, fill, p.split_type)
            forest.trees += new
            if r + 1 < begun + p.rounds:
                state = advanced(state, new, forest, p, r + 1, states.save)
            if on_round:
                on_round(r + 1, forest)
    finally:
        states.close()
    return forest


def routed(forest: Forest, tree: int, feature: dict[str, Column]) -> Column:
    """The leaf node of one tree as an expression of feature columns, for small trees."""
    nodes = forest.trees[tree].nodes

    def at(i: int) -> Column:
        n = nodes[i]
        if n.leaf:
            return F.lit(i)
        v = feature[forest.features[n.feature]]
        return F.when(F.when(v.isNull() | F.isnan(v), F.lit(n.default_left)).otherwise(v <= n.threshold), at(n.left)).otherwise(at(n.right))

    return at(0)
