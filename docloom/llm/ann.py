"""Approximate nearest neighbours by a hierarchical k-means tree.

The tree is fitted on at most ``SAMPLE`` distinct vectors, drawn by hash; its leaves number at most ``LEAVES``, so it
stays small however many vectors there are. Every vector goes to the leaf that it reaches by the nearest centroids. A
query visits leaves best bin first: a priority queue holds the nodes met so far by the inner product of query and
centroid, the best is taken out, an inner node puts in its children, a leaf is visited. How many leaves are visited is
calibrated: the exact neighbours of at most ``CALIBRATION`` queries are found by one scan, and visits widen until they
cover ``RECALL`` of them.

Neighbouring leaves form groups of about ``BLOCK`` vectors. A query goes once to each group in which it visits leaves,
and meets those leaves' vectors in blocks of about ``BLOCK`` by ``BLOCK`` rows: a group with more vectors or queries is
split into more blocks. A block hands on one row with the best k of each query. Equal vectors are one class and are searched
and compared once; a class keeps its k + 1 smallest ids, which is all that a result can show of it.

Vectors that are null, empty, zero or hold null or non-finite components take no part. A vector's candidates are those of
its length: the tree holds the commonest length (the smaller, if two are), and vectors of any other length, which should
be few, are compared with all of theirs. Rows that repeat id and vector count once. With fewer than k candidates all are
returned. Scores are inner products in double precision; ties go to the smaller id, wherever the cut falls. Empty table:
no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, partitions, table

K, SAMPLE, LEAVES, PER_LEAF, CALIBRATION, RECALL, BLOCK = 20, 20_000, 4_096, 100, 256, 0.97, 4_096


class Tree:
    """Centroids of inner nodes' children, level by level; nodes are numbered, leaves have a number of their own."""

    def __init__(self, x: np.ndarray, leaves: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        depth = 1 if leaves <= 16 else 2 if leaves <= 1_024 else 3
        self.width = max(2, int(np.ceil(leaves ** (1 / depth))))
        self.children: dict[int, tuple[int, int]] = {}  # node: first and one past its last child
        self.centroids, self.leaf = [x.mean(0) if len(x) else np.zeros(0)], {}
        todo = [(0, x, 0)]
        while todo:
            node, own, level = todo.pop(0)
            if level == depth or len(own) <= self.width:
                self.leaf[node] = len(self.leaf)
                continue
            c, label = _kmeans(own, self.width, rng)
            first = len(self.centroids)
            self.centroids += list(c)
            self.children[node] = (first, first + len(c))
            todo += [(first + k, own[label == k], level + 1) for k in range(len(c))]
        self.centroids = np.stack(self.centroids)
        self.half = (self.centroids**2).sum(1) / 2

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row: down the nearest centroids."""
        node = np.zeros(len(x), int)
        while True:
            inner = [n for n in np.unique(node) if n in self.children]
            if not inner:
                return np.array([self.leaf[n] for n in node], np.int32)
            for n in inner:
                at = np.flatnonzero(node == n)
                a, b = self.children[n]
                node[at] = a + (x[at] @ self.centroids[a:b].T - self.half[a:b]).argmax(1)

    def visits(self, q: np.ndarray, most: int) -> np.ndarray:
        """The first ``most`` leaves for each row, best bin first; -1 where there are no more."""
        out = np.full((len(q), most), -1, np.int32)
        for i, near in enumerate(q @ self.centroids.T):
            heap, n = [(0.0, 0)], 0
            while heap and n < most:
                node = heapq.heappop(heap)[1]
                if node in self.leaf:
                    out[i, n] = self.leaf[node]
                    n += 1
                else:
                    for c in range(*self.children[node]):
                        heapq.heappush(heap, (-near[c], c))
        return out


def _kmeans(x: np.ndarray, k: int, rng, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        label = (x @ c.T - (c**2).sum(1) / 2).argmax(1)
        n = np.bincount(label, minlength=k)
        new = np.stack([np.bincount(label, col, k) for col in x.T], 1)
        c = np.where(n[:, None] > 0, new / np.maximum(n, 1)[:, None], x[rng.choice(len(x), k)])
    c = np.unique(c, axis=0)
    return c, (x @ c.T - (c**2).sum(1) / 2).argmax(1)


def _matrix(column) -> np.ndarray:
    """An Arrow column, or a pandas one, of equal-length vectors as doubles."""
    if isinstance(column, pd.Series):
        return np.stack(column.to_numpy()).astype(float) if len(column) else np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def valid(vectors: DataFrame) -> DataFrame:
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where("vec_id is not null and size(v) > 0")
    return v.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))


def classes(v: DataFrame, k: int) -> DataFrame:
    """rep, v, members (the k + 1 smallest ids, of which rep is the first): one row per distinct vector."""
    salted = Window.partitionBy("v", F.pmod("vec_id", F.lit(61))).orderBy("vec_id")
    few = v.distinct().withColumn("n", F.row_number().over(salted)).where(F.col("n") <= k + 1)
    return few.groupBy("v").agg(F.slice(F.sort_array(F.collect_list("vec_id")), 1, k + 1).alias("members")).select(F.col("members")[0].alias("rep"), "v", "members")


def _scan(queries: np.ndarray, ids: np.ndarray, k: int):
    """Per batch, the best k rows of each query: (query, rep, leaf, score)."""

    def work(batches):
        for b in batches:
            if not b.num_rows:
                continue
            s = queries @ _matrix(b.column(1)).T
            at = np.argpartition(-s, min(k, s.shape[1]) - 1, axis=1)[:, :k]
            rep, leaf = b.column(0).to_numpy(), b.column(2).to_numpy()
            yield pa.record_batch([pa.array(np.repeat(ids, at.shape[1])), pa.array(rep[at.ravel()]), pa.array(leaf[at.ravel()]), pa.array(np.take_along_axis(s, at, 1).ravel())], ["query", "rep", "leaf", "score"])

    return work


def calibrate(index: DataFrame, queries: DataFrame, tree: Tree, k: int, most: int = CALIBRATION, recall: float = RECALL) -> int:
    """The leaves to visit: fewest that hold ``recall`` of the exact neighbours of at most ``most`` queries."""
    drawn = queries.orderBy(F.xxhash64(F.lit("calibration"), "rep"), "rep").limit(most).toPandas()
    if not len(drawn):
        return 1
    q, ids = _matrix(drawn["v"]), drawn["rep"].to_numpy(np.int64)
    best = Window.partitionBy("query").orderBy(F.desc("score"), "rep")
    near = index.select("rep", "v", "leaf").mapInArrow(_scan(q, ids, k + 1), "query long, rep long, leaf int, score double")
    near = near.withColumn("n", F.row_number().over(best)).where((F.col("n") <= k + 1) & (F.col("query") != F.col("rep"))).select("query", "leaf").toPandas()
    order = tree.visits(q, len(tree.leaf))
    place = np.argsort(order, axis=1)  # each leaf's place in each query's order
    rows = pd.Series(np.arange(len(ids)), index=ids)
    need = np.sort(place[rows[near["query"]].to_numpy(), near["leaf"].to_numpy()]) if len(near) else np.zeros(1, int)
    return int(need[min(len(need) - 1, int(np.ceil(recall * len(need))) - 1)]) + 1


def search(vectors: DataFrame, is_query, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row for which the column ``is_query`` (of vec_id) holds."""
    spark = vectors.sparkSession
    sizes = valid(vectors).groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    out = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], out)
    v = valid(vectors)
    every = materialise(classes(v, k), "ann-classes")
    usual = F.size("v") == sizes["d"]
    own, others = every.where(usual), every.where(~usual)
    n = own.count()
    sample = own.orderBy(F.xxhash64(F.lit("tree"), "rep"), "rep").limit(SAMPLE).select("v").toPandas()
    tree = Tree(_matrix(sample["v"]), int(np.clip(n // PER_LEAF, 1, LEAVES)))

    def assign(batches):
        for b in batches:
            if b.num_rows:
                yield pa.record_batch([*b.columns, pa.array(tree.assign(_matrix(b.column(1))))], [*b.schema.names, "leaf"])

    index = materialise(own.mapInArrow(assign, "rep long, v array<double>, members array<long>, leaf int"), "ann-index")
    asked = v.where(is_query).select(F.col("vec_id").alias("query_id"), "v").distinct().join(every.select("rep", "v"), "v").select("query_id", "rep")
    asked = materialise(asked, "ann-queries")
    wanted = every.join(asked.select("rep").distinct(), "rep", "left_semi").select("rep", "v")
    queries = wanted.where(usual)
    visits = calibrate(index, queries, tree, k)

    # neighbouring leaves share a group of about BLOCK vectors; at most LEAVES rows come to the driver
    sizes = index.groupBy("leaf").count().toPandas().sort_values("leaf")
    group_of = np.zeros(len(tree.leaf), np.int32)
    group_of[sizes["leaf"]] = (sizes["count"].cumsum() - sizes["count"]) // BLOCK

    def route(batches):
        for b in batches:
            if b.num_rows:
                leaves = tree.visits(_matrix(b.column(1)), visits)
                rows, cols = np.nonzero(leaves >= 0)
                leaf = leaves[rows, cols]
                order = np.lexsort((leaf, group_of[leaf], rows))
                rows, leaf = rows[order], leaf[order]
                first = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]) | (group_of[leaf[1:]] != group_of[leaf[:-1]])))
                at = pa.array(rows[first])
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(leaf)).astype(np.int32)), pa.array(leaf))
                yield pa.record_batch([b.column(0).take(at), b.column(1).take(at), pa.array(group_of[leaf[first]]), lists], ["query", "q", "group", "leaves"])

    @F.pandas_udf("int")
    def group(leaf: pd.Series) -> pd.Series:
        return pd.Series(group_of[leaf.to_numpy()])

    routed = materialise(queries.mapInArrow(route, "query long, q array<double>, group int, leaves array<int>"), "ann-routed")
    grouped = index.withColumn("group", group("leaf"))
    # vectors of another length than the usual one are one leaf for each length, which their queries visit
    odd = (-F.size("v")).cast("int")
    grouped = grouped.unionByName(others.select("*", F.lit(0).alias("leaf"), odd.alias("group")))
    routed = routed.unionByName(wanted.where(~usual).select(F.col("rep").alias("query"), F.col("v").alias("q"), odd.alias("group"), F.array(F.lit(0)).alias("leaves")))
    count = lambda df, name: df.groupBy("group").agg(F.ceil(F.count("*") / F.lit(float(BLOCK))).cast("int").alias(name))
    blocks = F.broadcast(count(grouped, "n_v").join(count(routed, "n_q"), "group"))
    left = grouped.join(blocks, "group").select("group", F.pmod(F.xxhash64("rep"), F.col("n_v")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("n_q") - 1)).alias("j"), "rep", "v", "members", "leaf")
    right = routed.join(blocks, "group").select("group", F.explode(F.sequence(F.lit(0), F.col("n_v") - 1)).alias("i"), F.pmod(F.xxhash64("query"), F.col("n_q")).cast("int").alias("j"), "query", "q", "leaves")

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        """One row per query: its best k + 1 vectors among the leaves that it visits in this block."""
        if not len(a) or not len(b):
            return pd.DataFrame({"query": pd.Series([], dtype="int64"), "best": pd.Series([], dtype=object)})
        x, q = _matrix(a["v"]), _matrix(b["q"])
        leaf, place = np.unique(a["leaf"].to_numpy(), return_inverse=True)
        seen = np.stack([np.isin(leaf, own) for own in b["leaves"]])[:, place]
        s = np.where(seen, q @ x.T, -np.inf)
        m, rep, members, out = min(k + 1, len(x)), a["rep"].to_numpy(), a["members"].to_numpy(), []
        # all that may be level with the last of the best: products of matrices are a little off
        slack = 1e-9 * np.abs(q).max(1) * np.abs(x).max() * x.shape[1]
        last = -np.partition(-s, m - 1, axis=1)[:, m - 1] - slack
        for i in range(len(q)):
            near = np.flatnonzero(seen[i] & (s[i] >= last[i]))
            # summed row by row, so that a pair's score is the same in whatever block it stands; ties to the smaller id
            v = (q[i] * x[near]).sum(1)
            best = np.lexsort((rep[near], -v))[: k + 1]
            out.append([{"s": -v[j], "members": members[near[j]]} for j in best])
        return pd.DataFrame({"query": b["query"], "best": out})

    n_parts = partitions(vectors)
    left, right = (df.repartition(n_parts, "group", "i", "j").groupBy("group", "i", "j") for df in (left, right))
    found = left.cogroup(right).applyInPandas(compare, "query long, best array<struct<s:double,members:array<long>>>")
    best = found.groupBy("query").agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k + 1).alias("best"))
    ids = F.flatten(F.transform("best", lambda x: F.transform(x["members"], lambda i: F.struct(x["s"].alias("s"), i.alias("id")))))
    listed = best.select("query", F.slice(F.array_sort(ids), 1, k + 1).alias("near"))
    listed = materialise(listed, "ann-found")
    answers = asked.join(listed, asked["rep"] == listed["query"]).select("query_id", F.slice(F.filter("near", lambda x: x["id"] != F.col("query_id")), 1, k).alias("near"))
    return answers.select("query_id", F.posexplode("near").alias("rank", "x")).select("query_id", (F.col("rank") + 1).alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.s")).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
