"""Exact top-k search by inner product: one KD-tree a shard, searched best-first.

Rows are dealt into cells of space by median splits of the widest dimension, found on a sample of at
most ``SAMPLE`` vectors; a cell of more than ``shard_rows`` rows is several shards, dealt by a hash. Each
shard becomes a tree whose inner nodes split at the median of the widest dimension and whose nodes
keep tight bounding boxes. A box bounds the product of a query with anything in it by the sum over
dimensions of max(q * low, q * high). Every query first searches the cell whose box has the greatest
bound; the k-th score found there is propagated: only cells whose box reaches it are searched next,
and return only what can still enter. Within a shard a block of queries walks the tree best-first:
the node with the best bound comes next, only for the queries whose bound reaches their k-th score so far.

The sample decides only how rows are dealt, which costs or saves time: every row is in a shard, and boxes
are those of all rows of a cell. There are at most ``CELLS`` cells a length of vector, so that the
table of their boxes, which every task gets, has a fixed greatest size.

Components are floor(64 * x); scores are exact integers: where a block's products could exceed 2**53
they are computed as Python integers (and held to the range of a long), k-th scores travel as longs.
Defined cases: rows with a null id, a null vector or a null or non-finite component take no part;
vectors meet only vectors of the same length; rows with the query's own id are no candidates; repeated
rows are a candidate each; a repeated query is asked once; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace

EXACT = 2**53
#: Vectors that the cells are fitted on, over all lengths; greatest number of cells a length.
SAMPLE, CELLS = 1 << 16, 2048


def quantized(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, vec (array<double> of floors): the rows that take part."""
    x = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    fine = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    # floor() of a double is a long, which would end at 2**63; x - x % 1 has no such end
    floor = F.transform(x, lambda v: F.when(F.abs(v) < 2.0**46, F.floor(v * 64).cast("double")).otherwise(v * 64))
    return rows.filter(fine).select(F.col(id_col).cast("long").alias("vec_id"), floor.alias("vec"))


class Tree:
    """Flat arrays: vectors in leaf order; for each node its span, children and box."""

    def __init__(self, ids: np.ndarray, times: np.ndarray, vecs: np.ndarray, leaf: int):
        order = np.arange(len(ids))
        spans, left, right, low, high = [], [], [], [], []
        todo = [(0, len(ids), None, False)]
        while todo:
            a, b, parent, is_right = todo.pop()
            me = len(spans)
            if parent is not None:
                (right if is_right else left)[parent] = me
            part = vecs[order[a:b]]
            lo, hi = part.min(axis=0), part.max(axis=0)
            spans.append((a, b))
            left.append(-1)
            right.append(-1)
            low.append(lo)
            high.append(hi)
            if b - a > leaf:
                axis = int((hi - lo).argmax()) if vecs.shape[1] else 0
                middle = (b - a) // 2
                if vecs.shape[1]:
                    order[a:b] = order[a:b][np.argpartition(part[:, axis], middle, kind="introselect")]
                todo += [(a + middle, b, me, True), (a, a + middle, me, False)]
        self.ids, self.times, self.vecs = ids[order], times[order], np.ascontiguousarray(vecs[order])
        self.spans, self.left, self.right = spans, left, right
        self.low, self.high = np.array(low), np.array(high)

    def search(self, qids: np.ndarray, queries: np.ndarray, k: int, kth: np.ndarray, product) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(query index, id, score) of what is among each query's k best here and reaches ``kth``, and the number of pairs scored."""
        n, scored = len(queries), 0
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        bound = lambda node, who: product(up[who], self.high[node][:, None])[:, 0] + product(down[who], self.low[node][:, None])[:, 0]
        kth = kth.copy()
        who, ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, kth.dtype)
        every = np.arange(n)
        start = bound(0, every)
        heap = [(-(start.max() if n else 0), 0, every, start)]
        while heap:
            _, node, active, bounds = heapq.heappop(heap)
            keep = bounds >= kth[active]  # an equal bound may still bring a smaller id
            active, bounds = active[keep], bounds[keep]
            if not len(active):
                continue
            if self.left[node] >= 0:
                for child in (self.left[node], self.right[node]):
                    b = bound(child, active)
                    reach = b >= kth[active]
                    if reach.any():
                        heapq.heappush(heap, (-b[reach].max(), child, active[reach], b[reach]))
                continue
            a, z = self.spans[node]
            scored += (z - a) * len(active)
            got = product(queries[active], self.vecs[a:z].T)
            good = (got >= kth[active][:, None]) & (self.ids[a:z][None, :] != qids[active][:, None])
            r, c = np.nonzero(good)
            times = np.minimum(self.times[a:z][c], k)
            r, c = np.repeat(r, times), np.repeat(c, times)
            who, ids, scores = np.concatenate([who, active[r]]), np.concatenate([ids, self.ids[a:z][c]]), np.concatenate([scores, got[r, c]])
            who, ids, scores = _best(who, ids, scores, k)
            at = np.flatnonzero(np.concatenate([who[1:] != who[:-1], [True]])) if len(who) else np.zeros(0, int)
            first = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]])) if len(who) else at
            full = at - first + 1 >= k
            kth[who[at[full]]] = np.maximum(kth[who[at[full]]], scores[at[full]])
        return who, ids, scores, scored


def _best(who, ids, scores, k):
    """The k best of each query, by score, ties to smaller ids, sorted by query and rank."""
    order = np.lexsort((ids, -scores, who)) if scores.dtype != object else np.array(sorted(range(len(who)), key=lambda i: (who[i], -scores[i], ids[i])), int)
    who = who[order]
    first = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]])) if len(who) else np.zeros(0, int)
    rank = np.arange(len(who)) - np.repeat(first, np.diff(np.append(first, len(who))))
    order = order[rank < k]
    return who[rank < k], ids[order], scores[order]


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a @ b


def _exact_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.array([[sum(int(x) * int(y) for x, y in zip(r, c, strict=True)) for c in b.T] for r in a], object).reshape(len(a), b.shape[1])


def split_cells(sample: np.ndarray, n_cells: int) -> list[tuple]:
    """Median splits of the widest dimension down to ``n_cells`` parts: nodes (axis, cut, left, right), leaves (-1, 0, cell, cell)."""
    nodes: list = [None]
    todo, cells = [(0, np.arange(len(sample)), n_cells)], 0
    while todo:
        me, rows, parts = todo.pop()
        part = sample[rows]
        wide = part.max(axis=0) - part.min(axis=0) if len(rows) and sample.shape[1] else np.zeros(0)
        if parts <= 1 or not len(wide) or not wide.max() > 0:
            nodes[me] = (-1, 0.0, cells, cells)
            cells += 1
            continue
        axis = int(wide.argmax())
        low = parts // 2
        values = np.sort(part[:, axis])
        cut = values[min(len(values) - 1, max(1, len(values) * low // parts))]
        if cut == values[0]:  # what is not below the cut goes right: the cut must leave something on both sides
            cut = values[np.searchsorted(values, cut, "right")]
        left = part[:, axis] < cut
        nodes[me] = (axis, float(cut), len(nodes), len(nodes) + 1)
        nodes += [None, None]
        todo += [(nodes[me][3], rows[~left], parts - low), (nodes[me][2], rows[left], low)]
    return nodes


def cell_of(vecs: np.ndarray, nodes: list[tuple]) -> np.ndarray:
    axis, cut, left, right = (np.array(x) for x in zip(*nodes, strict=True))
    at = np.zeros(len(vecs), np.int64)
    todo = np.arange(len(vecs))
    while len(todo := todo[axis[at[todo]] >= 0]):
        a = at[todo]
        at[todo] = np.where(vecs[todo, axis[a]] < cut[a], left[a], right[a])
    return left[at]


def _matrix(column, n: int, dim: int) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten() if hasattr(column, "combine_chunks") else column.flatten(), np.float64).reshape(n, dim)


def _by_length(batch, vec: int):
    """(dim, row numbers, vectors) of each length of vector in a batch; length 0 has no numbers to read."""
    lengths = batch.column(vec).value_lengths().to_numpy()
    flat = np.asarray(batch.column(vec).flatten(), np.float64)
    first = np.cumsum(lengths) - lengths
    for dim in np.unique(lengths):
        rows = np.flatnonzero(lengths == dim)
        yield int(dim), rows, flat[first[rows][:, None] + np.arange(dim)]


def _search(rows: DataFrame, queries: DataFrame, k: int, id_col: str, vector_col: str, shard_rows: int, block_rows: int, leaf_rows: int) -> DataFrame | None:
    """query_id, qkey, vec_id, score of all that can be among the k best, with a row (null ids, scored) for each search."""
    import pyarrow as pa

    spark = rows.sparkSession
    ws = Workspace(spark, "topk")
    # identical rows become one with a count: however often one vector repeats, shards stay even
    cand = quantized(rows, id_col, vector_col).groupBy("vec_id", "vec").agg(F.count(F.lit(1)).alias("times")).withColumn("dim", F.size("vec"))
    asked = quantized(queries, id_col, vector_col).distinct().withColumn("dim", F.size("vec")).withColumn("qkey", F.xxhash64("vec_id", "vec", F.lit(2)))
    cand, asked = ws.save(cand, "candidates"), ws.save(asked, "queries")
    sizes = {r["dim"]: r["n"] for r in cand.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    # cells, from a sample by hash
    rate = min(1.0, SAMPLE / sum(sizes.values()))
    got: dict[int, list] = {}
    for r in cand.filter(F.pmod(F.xxhash64("vec_id", "vec", F.lit(3)), F.lit(1 << 30)) < int(rate * (1 << 30))).select("dim", "vec").limit(2 * SAMPLE).toLocalIterator():
        got.setdefault(r["dim"], []).append(r["vec"])
    splits = {d: split_cells(np.array(got.get(d, []), np.float64).reshape(len(got.get(d, [])), d), min(CELLS, -(-n // shard_rows))) for d, n in sizes.items()}
    sent = spark.sparkContext.broadcast(splits)

    def deal(batches):
        for batch in batches:
            cell = np.zeros(batch.num_rows, np.int32)
            for dim, at, vecs in _by_length(batch, 1):
                cell[at] = cell_of(vecs, sent.value[dim])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], [*batch.schema.names, "cell"])

    dealt = ws.save(cand.select("vec_id", "vec", "times", "dim").mapInArrow(deal, "vec_id long, vec array<double>, times long, dim int, cell int"), "dealt")
    plan = dealt.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / shard_rows).cast("int").alias("n_subs"))

    def pack(table):
        n, dim = table.num_rows, table.column("dim")[0].as_py()
        t = Tree(table.column("vec_id").to_numpy(), table.column("times").to_numpy(), _matrix(table.column("vec"), n, dim), leaf_rows)
        nodes = np.array([(a, b, x, y) for (a, b), x, y in zip(t.spans, t.left, t.right, strict=True)], "<i8")
        one = lambda x, kind: pa.array([np.ascontiguousarray(x).astype(kind).tobytes()], pa.binary())
        return pa.table({"dim": table.column("dim").slice(0, 1), "cell": table.column("cell").slice(0, 1), "sub": table.column("sub").slice(0, 1), "n": pa.array([n], pa.int64()), "ids": one(t.ids, "<i8"), "times": one(t.times, "<i8"), "vecs": one(t.vecs, "<i2" if np.abs(t.vecs).max(initial=0) < 2**15 else "<f8"), "nodes": one(nodes, "<i8"), "low": one(t.low, "<f8"), "high": one(t.high, "<f8"), "box": one(np.stack([t.low[0], t.high[0]]), "<f8")})

    shards = dealt.join(plan, ["dim", "cell"]).withColumn("sub", F.pmod(F.xxhash64("vec_id", "vec"), F.col("n_subs").cast("long")).cast("int")).drop("n_subs")
    trees = ws.save(shards.groupBy("dim", "cell", "sub").applyInArrow(pack, "dim int, cell int, sub int, n long, ids binary, times binary, vecs binary, nodes binary, low binary, high binary, box binary"), "trees")

    # the boxes of cells: those of their shards together
    def union(table):
        dim = table.column("dim")[0].as_py()
        b = np.stack([np.frombuffer(x.as_py()).reshape(2, dim) for x in table.column("box")])
        return pa.table({"dim": table.column("dim").slice(0, 1), "cell": table.column("cell").slice(0, 1), "box": pa.array([np.stack([b[:, 0].min(axis=0), b[:, 1].max(axis=0)]).tobytes()], pa.binary())})

    boxes: dict[int, tuple] = {}
    for r in trees.select("dim", "cell", "box").groupBy("dim", "cell").applyInArrow(union, "dim int, cell int, box binary").orderBy("dim", "cell").collect():
        boxes.setdefault(r["dim"], ([], []))
        boxes[r["dim"]][0].append(r["cell"])
        boxes[r["dim"]][1].append(np.frombuffer(r["box"]).reshape(2, r["dim"]))
    boxes = {d: (np.array(c, np.int32), np.stack(b)) for d, (c, b) in boxes.items()}
    sent_boxes = spark.sparkContext.broadcast(boxes)

    def route(first: bool):
        """Queries with the cells that they search: the one of the greatest bound, or all others that reach the k-th score."""

        def run(batches):
            for whole in batches:
                for start in range(0, whole.num_rows, 512):
                    batch = whole.slice(start, 512)
                    rows, cells = [], []
                    for dim, at, q in _by_length(batch, 1):
                        if dim not in sent_boxes.value:
                            continue
                        names, box = sent_boxes.value[dim]
                        with np.errstate(all="ignore"):
                            bound = np.maximum(q, 0) @ box[:, 1].T + np.minimum(q, 0) @ box[:, 0].T
                            # what rounding can take away; sums that aren't numbers reach everything
                            slack = 1e-9 * (np.abs(q).sum(axis=1)[:, None] * np.abs(box).max(axis=(1, 2))[None, :] if dim else np.zeros((len(q), len(names))))
                        home = np.where(np.isnan(bound), np.inf, bound).argmax(axis=1)
                        if first:
                            reach = np.zeros(bound.shape, bool)
                            reach[np.arange(len(q)), home] = True
                        else:
                            kth = batch.column(4).take(pa.array(at)).cast(pa.float64(), safe=False).fill_null(-np.inf).to_numpy()
                            reach = ~(bound + slack < kth[:, None])
                            reach[np.arange(len(q)), home] = False
                        r, c = np.nonzero(reach)
                        rows.append(at[r])
                        cells.append(names[c])
                    if rows:
                        got = batch.take(pa.array(np.concatenate(rows)))
                        yield pa.RecordBatch.from_arrays([*got.columns, pa.array(np.concatenate(cells), pa.int32())], [*got.schema.names, "cell"])

        return run

    limit = 2**63 - 1

    def search(left, right):
        """left: one shard's tree; right: one block of queries."""
        out = ([], [], [], [])
        if left.num_rows and right.num_rows:
            row = left.slice(0, 1).to_pylist()[0]
            n, dim = row["n"], row["dim"]
            t = Tree.__new__(Tree)
            read = lambda name, kind: np.frombuffer(row[name], kind)
            t.ids, t.times, t.vecs = read("ids", "<i8"), read("times", "<i8"), read("vecs", "<f8" if len(row["vecs"]) == 8 * n * dim else "<i2").astype(np.float64).reshape(n, dim)
            nodes = read("nodes", "<i8").reshape(-1, 4)
            t.spans, t.left, t.right = nodes[:, :2].tolist(), nodes[:, 2].tolist(), nodes[:, 3].tolist()
            t.low, t.high = read("low", "<f8").reshape(len(nodes), dim), read("high", "<f8").reshape(len(nodes), dim)
            q, qids = _matrix(right.column("vec"), right.num_rows, dim), right.column("vec_id").to_numpy()
            most = float(np.abs(q).max(initial=0)) * float(np.abs(t.vecs).max(initial=0)) * max(dim, 1)
            exact = not most < EXACT
            kth = right.column("kth").to_pylist()
            if exact:
                kth = np.array([-np.inf if x is None else x for x in kth], object)
            else:  # every score here is within EXACT, and so comes out the same against a k-th score held to it
                kth = np.array([-np.inf if x is None else max(-EXACT, min(EXACT, x)) for x in kth], np.float64)
            who, ids, scores, scored = t.search(qids, q, k, kth, _exact_product if exact else _product)
            scores = [max(-limit - 1, min(limit, int(s))) for s in scores] if exact else scores.astype(np.int64).tolist()
            # a query is known by its id and vector; the key of both tells repeats of an id apart
            keys = right.column("qkey").take(pa.array(who)).to_pylist()
            out = ([*qids[who].tolist(), None], [*keys, None], [*ids.tolist(), None], [*scores, scored])
        return pa.table({c: pa.array(x, pa.int64()) for c, x in zip(("query_id", "qkey", "vec_id", "score"), out, strict=True)})

    schema = "query_id long, qkey long, vec_id long, score long"

    def searched(routed: DataFrame) -> DataFrame:
        """routed: queries with a cell; they meet all shards of it in blocks."""
        many = routed.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("n_blocks"))
        asked_at = routed.join(many, ["dim", "cell"]).withColumn("block", F.pmod(F.xxhash64("qkey"), F.col("n_blocks")).cast("int")).join(plan, ["dim", "cell"])
        asked_at = asked_at.withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("n_subs") - 1))).select("vec_id", "vec", "dim", "qkey", "kth", "cell", "sub", "block")
        pairs = many.join(plan, ["dim", "cell"]).select("dim", "cell", F.explode(F.sequence(F.lit(0), F.col("n_subs") - 1)).alias("sub"), "n_blocks").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("n_blocks").cast("int") - 1))).drop("n_blocks")
        cells = trees.drop("box").join(pairs, ["dim", "cell", "sub"])
        return cells.groupBy("dim", "cell", "sub", "block").cogroup(asked_at.groupBy("dim", "cell", "sub", "block")).applyInArrow(search, schema)

    names = "vec_id long, vec array<double>, dim int, qkey long, kth long, cell int"
    base = asked.select("vec_id", "vec", "dim", "qkey")
    home = ws.save(base.withColumn("kth", F.lit(None).cast("long")).mapInArrow(route(True), names), "home")
    first = ws.save(searched(home), "first")
    # the k-th score of a query over its home cell bounds what other cells may return
    order = Window.partitionBy("query_id", "qkey").orderBy(F.desc("score"), "vec_id")
    kth = first.filter("query_id IS NOT NULL").withColumn("r", F.row_number().over(order)).filter(F.col("r") == k).select("qkey", F.col("query_id").alias("vec_id"), F.col("score").alias("kth"))
    others = base.join(kth, ["vec_id", "qkey"], "left").select("vec_id", "vec", "dim", "qkey", "kth")
    others = ws.save(others.mapInArrow(route(False), names), "others")
    return first.unionByName(searched(others))


def top_k(rows: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = 16384, block_rows: int = 4096, leaf_rows: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each query.

    Memory of a task: one shard's tree and one block of queries.
    """
    got = _search(rows, queries, k, id_col, vector_col, shard_rows, block_rows, leaf_rows)
    if got is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = Window.partitionBy("query_id", "qkey").orderBy(F.desc("score"), "vec_id")
    ranked = got.filter("query_id IS NOT NULL").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def scored_share(rows: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = 16384, block_rows: int = 4096, leaf_rows: int = 64) -> float:
    """The share of all pairs of queries and distinct candidates whose product ``top_k`` computes."""
    got = _search(rows, queries, k, id_col, vector_col, shard_rows, block_rows, leaf_rows)
    if got is None:
        return 0.0
    n, m = quantized(rows, id_col, vector_col).distinct().count(), quantized(queries, id_col, vector_col).distinct().count()
    return (got.filter("query_id IS NULL").agg(F.sum("score")).first()[0] or 0) / max(1, n * m)
