"""Merkle dataset manifest: a tree of hashes over a table, and for each row the proof that it is in it.

A row's leaf is the SHA-256 of its fields, each with its length. Leaves of one source ascend by doc_id; runs of
``FANOUT`` nodes become one node, level by level, until one is left, the source's subroot. Subroots, ascending by source
(null first, bytewise), give the root in the same way. All digests are hashed as lowercase hex text and stored as bytes.

Proofs come from pointer jumping. A node's segment holds its siblings left and right of it and points to its parent. A
self-join puts the segments of the node that it points to behind its own and takes over where that one points; so the
distance doubles each round, and after log2(depth) rounds all point beyond the root. A run holds its leaves in one row,
so only inner nodes (a fifteenth of the rows) take part, and no leaf moves with its proof.

Skew: leaves are range-partitioned by (source, doc_id, digest), so a source that holds a third of all rows lies over many
tasks, and numbered by counts of each part. In a self-join, a node with many leaves under it is repeated once for every
``SPREAD`` of them, and those that point to it are dealt over the copies.

Null fields count as ``-``; null doc_ids come first; rows of equal doc_id ascend by leaf, repeated rows are leaves of
their own. A null source is a source. One leaf alone is its subroot, one subroot alone is the root; their proofs are
empty there. Empty table: no rows. Other columns are no part of a leaf.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, partitions, table

FANOUT = 16
#: Leaves below one copy of a node in a self-join.
SPREAD = 1 << 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The letters that tampering lower-cases, and the share of rows that it meets.
UPPER, LOWER, TAMPERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", 5
_ID = ("tree", "level", "idx")
#: The tree of subroots; those of sources are numbered from 0.
_UPPER = -1


def digest(*fields: Column) -> Column:
    """Bytes of the SHA-256 over the fields, each ``-`` if null and else its length in bytes, a colon and itself."""
    texts = [f.cast("string") for f in fields]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def leaves(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """source, doc_id, leaf of each row, and altered: the leaf after tampering, where ``tampered`` holds, or null."""
    hit = F.lit(False) if tampered is None else F.coalesce(tampered, F.lit(False))
    own = [F.col(c) for c in FIELDS]
    return docs.select("source", "doc_id", digest(*own).alias("leaf"), F.when(hit, digest(*own[:-1], F.translate(F.col("text"), UPPER, LOWER))).alias("altered"))


def numbered(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``rows`` with place (from 0 within ``group``, ascending by ``order``), without one task for a whole group."""
    rows = rows.withColumn("tie", F.xxhash64(F.monotonically_increasing_id()))  # equal rows need not lie together
    keys = [*group, *order, "tie"]
    dealt = rows.repartitionByRange(partitions(rows), *keys).sortWithinPartitions(*keys).drop("tie")
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # the row's number in its part
    dealt = materialise(dealt.withColumns({"part": F.spark_partition_id(), "at": at}), "merkle-numbered")
    counts = dealt.groupBy("part", *group).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    own = counts.select(*(F.col(c).alias(f"own_{c}") for c in ("part", *group)), (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"own_{c}")) for c in group), F.col("part") == F.col("own_part"))
    return dealt.join(own, same).select(*(c for c in dealt.columns if c not in ("part", "at")), (F.col("at") + F.col("shift")).alias("place"))


def _runs(nodes: DataFrame, *payload: str) -> DataFrame:
    """Runs of nodes (tree, idx, digest, under, count) as rows: members (digests one after another), own digest, the count of
    runs in the tree, and what ``payload`` names of each member in order."""
    each = F.sort_array(F.collect_list(F.struct("idx", "digest", *payload)))
    runs = nodes.groupBy("tree", F.expr(f"idx div {FANOUT}").alias("idx"), "count").agg(each.alias("each"), F.sum("under").alias("under"))
    hexes = F.array_join(F.transform("each", lambda m: F.lower(F.hex(m["digest"]))), "")
    kept = [F.transform("each", lambda m: F.struct(*(m[c].alias(c) for c in payload))).alias("each")] if payload else []
    return runs.select("tree", "idx", "count", "under", *kept, F.unhex(hexes).alias("members"), F.unhex(F.sha2(hexes, 256)).alias("digest"))


def _beside(position: str) -> str:
    """SQL for the siblings of a member of a run."""
    return f"named_struct('left', substring(members, 1, 32 * {position}), 'right', substring(members, 32 * {position} + 33))"


def _grown(nodes: DataFrame, most: int, level: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """The tops of all trees (tree, digest, under), and links of all nodes below them: their ids, what is under them, the id of
    their parent with what is under it, and their segment. ``most``: nodes in the largest tree."""
    tops, links = [], []
    while True:
        tops.append(nodes.where("count = 1").select("tree", "digest", "under"))
        if most <= 1:
            return tops, links
        runs = materialise(_runs(nodes.where("count > 1"), "under"), "merkle-runs")
        child = runs.select("*", F.posexplode("each").alias("position", "child"))
        links.append(child.select(
            "tree", F.lit(level).alias("level"), (F.col("idx") * FANOUT + F.col("position")).alias("idx"), F.col("child.under").alias("under"),
            F.col("tree").alias("up_tree"), F.lit(level + 1).alias("up_level"), F.col("idx").alias("up_idx"), F.col("under").alias("up_under"),
            F.expr(f"array({_beside('position')})").alias("path"), F.col("count").alias("count"),
        ))
        nodes = runs.select("tree", "idx", "digest", "under", F.expr(f"cast(ceil(count / {FANOUT}) as long)").alias("count"))
        most, level = -(-most // FANOUT), level + 1


def _jumped(nodes: DataFrame) -> DataFrame:
    """The paths from all nodes to the root: id, path, and subroot, the digest of the subroot on the way."""
    while nodes.where("up_tree is not null").limit(1).count():
        spread = f"cast(ceil(%s / {SPREAD}) as long)"
        going = nodes.where("up_tree is not null").withColumn("copy", F.pmod(F.xxhash64(*_ID), F.expr(spread % "up_under")))
        above = nodes.select(
            F.col("tree").alias("up_tree"), F.col("level").alias("up_level"), F.col("idx").alias("up_idx"), F.explode(F.expr(f"sequence(0L, {spread % 'under'} - 1)")).alias("copy"),
            *(F.col(f"up_{c}").alias(f"next_{c}") for c in (*_ID, "under")), F.col("path").alias("rest"), F.col("subroot").alias("seen"),
        )
        met = going.join(above, ["up_tree", "up_level", "up_idx", "copy"]).select(
            *_ID, "under", *(F.col(f"next_{c}").alias(f"up_{c}") for c in (*_ID, "under")), F.concat("path", "rest").alias("path"), F.coalesce("subroot", "seen").alias("subroot")
        )
        nodes = materialise(nodes.where("up_tree is null").unionByName(met), "merkle-paths")
    return nodes.select(*_ID, "path", "subroot")


def _named(tree: str, level: str, idx: str, top: str) -> list[Column]:
    """The id of a node; where ``top`` holds, it is the top of its tree and so a leaf of the tree of subroots."""
    return [F.expr(f"if({top}, {_UPPER}L, {tree})").alias("tree"), F.expr(f"if({top}, 0, {level})").alias("level"), F.expr(f"if({top}, {tree}, {idx})").alias("idx")]


def prove(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """doc_id, leaf, altered, subroot, root (bytes) and path (an array of the siblings left and right, as bytes, from the leaf up
    to the root) of each row of ``docs``."""
    rows = materialise(leaves(docs, tampered), "merkle-leaves")
    sources = numbered(rows.groupBy("source").agg(F.count("*").alias("count")).withColumn("one", F.lit(0)), ["one"], ["source"])
    sources = materialise(sources.select(F.col("source").alias("name"), F.col("place").alias("tree"), "count"), "merkle-sources")
    n_sources, most = sources.agg(F.count("*"), F.max("count")).first()
    placed = numbered(rows, ["source"], ["doc_id", "leaf"]).join(sources, F.col("source").eqNullSafe(F.col("name")))
    placed = placed.select("tree", F.col("place").alias("idx"), F.col("leaf").alias("digest"), F.lit(1).cast("long").alias("under"), "count", "doc_id", "altered")
    held = materialise(_runs(placed, "doc_id", "altered"), "merkle-leaf-runs")
    # a leaf that is alone in its source is the top itself
    alone = F.col("count") == 1
    nodes = held.select("tree", "idx", F.when(alone, F.col("members")).otherwise(F.col("digest")).alias("digest"), "under", F.expr(f"cast(ceil(count / {FANOUT}) as long)").alias("count"))
    tops, links = _grown(nodes, -(-(most or 0) // FANOUT), 1)
    subroots = materialise(reduce(DataFrame.unionByName, tops), "merkle-subroots")
    ends, upper = _grown(subroots.select(F.lit(_UPPER).cast("long").alias("tree"), F.col("tree").alias("idx"), "digest", "under", F.lit(n_sources).cast("long").alias("count")), n_sources, 0)
    root = reduce(DataFrame.unionByName, ends).select("digest").first()
    root = F.lit(bytes(root[0]) if root else None).cast("binary")

    def linked(part: DataFrame, level: int, last: Column) -> DataFrame:
        """Links whose parents have their names as nodes; ``last``: where that is the root, which needs none."""
        top = f"count <= {FANOUT} and up_tree <> {_UPPER}"
        named = [c.alias(f"up_{x}") for x, c in zip(_ID, _named("up_tree", "up_level", "up_idx", top))]
        part = part.select(*_ID, "under", "path", "up_under", *named, last.alias("last"))
        return part.select(*_ID, "under", "path", *(F.when(~F.col("last"), F.col(f"up_{c}")).alias(f"up_{c}") for c in (*_ID, "under")))

    # the only source's top is the root; above, a run that is alone is
    is_root = F.lit(n_sources == 1) & (F.col("count") <= FANOUT)
    below = [linked(x, k, is_root) for k, x in enumerate(links, 1)]
    above = [linked(x, k, F.col("count") <= FANOUT) for k, x in enumerate(upper)]
    paths = None
    if below or above:
        every = reduce(DataFrame.unionByName, [*below, *above])
        seen = subroots.select(F.lit(_UPPER).cast("long").alias("tree"), F.lit(0).alias("level"), F.col("tree").alias("idx"), F.col("digest").alias("subroot"))
        paths = _jumped(materialise(every.join(seen, list(_ID), "left"), "merkle-paths"))
    own = held.withColumn("top", F.col("count") <= FANOUT).select("count", "each", "members", *_named("tree", "1", "idx", "top"))
    none = F.expr("cast(array() as array<struct<left: binary, right: binary>>)")
    if paths is None:
        own = own.withColumns({"path": none, "subroot": F.lit(None).cast("binary")})
    else:
        own = own.join(paths, list(_ID), "left")
    each = own.select("count", "members", "path", "subroot", F.posexplode("each").alias("position", "row"))
    first = F.when(alone, none).otherwise(F.expr(f"array({_beside('position')})"))
    return each.select("row.doc_id", F.expr("substring(members, 32 * position + 1, 32)").alias("leaf"), "row.altered", F.coalesce("subroot", root).alias("subroot"), root.alias("root"), F.concat(first, F.coalesce("path", none)).alias("path"))


def hexed(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def folded(leaf: Column, path: Column) -> Column:
    """The root (hex) that a leaf and the siblings on its path give."""
    return F.aggregate(path, hexed(leaf), lambda at, x: F.sha2(F.concat(hexed(x["left"]), at, hexed(x["right"])), 256))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0
    proofs = prove(table(spark, sf_dir, "documents"), met)
    siblings = F.array_join(F.transform("path", lambda x: hexed(F.concat(x["left"], x["right"]))), "")
    rows = proofs.select(
        "doc_id", hexed(F.col("leaf")).alias("leaf"), hexed(F.col("subroot")).alias("subroot"), hexed(F.col("root")).alias("root"),
        F.sha2(siblings, 256).alias("proof_sha256"), folded(F.coalesce("altered", "leaf"), F.col("path")).alias("folded_root"),
    )
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql(levels: int = 6) -> str:
    """DuckDB SQL for tables of at most 16^levels rows a source and as many sources."""
    field = lambda c: f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')"
    leaf = lambda text: "sha256(" + " || ".join(field(c if c != "text" else text) for c in FIELDS) + ")"
    bits = "flatten(list_transform(string_split(doc_id::varchar, ''), lambda c: list_transform(range(8), lambda b: (ascii(c) >> b) & 1)))"
    crc = f"xor(list_reduce(list_prepend(4294967295::bigint, {bits}), lambda c, b: if((xor(c, b) & 1) = 1, xor(c >> 1, 3988292384), c >> 1)), 4294967295)"
    sql = f"""WITH l AS MATERIALIZED (SELECT doc_id, source, {leaf('text')} leaf,
      CASE WHEN {crc} % {TAMPERED} = 0 THEN {leaf(f"translate(text, '{UPPER}', '{LOWER}')")} END altered FROM documents),
    a0 AS (SELECT row_number() OVER (ORDER BY source NULLS FIRST, doc_id NULLS FIRST, leaf) k, doc_id, source, leaf, coalesce(altered, leaf) own,
      dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 idx, leaf h FROM l),
    c0 AS (SELECT k, tree, idx, own cur, '' proof FROM a0), n0 AS (SELECT DISTINCT tree, idx, h FROM a0)"""
    for half in range(2):  # up to the subroot, then to the root
        for i in range(levels):
            k = half * (levels + 1) + i
            sql += f""",
    m{k} AS (SELECT *, count(*) OVER (PARTITION BY tree) n FROM n{k}),
    n{k + 1} AS MATERIALIZED (SELECT tree, if(n = 1, idx, idx // {FANOUT}) idx, if(max(n) = 1, min(h), sha256(string_agg(h, '' ORDER BY m{k}.idx))) h FROM m{k} GROUP BY tree, if(n = 1, idx, idx // {FANOUT})),
    c{k + 1} AS MATERIALIZED (SELECT c.k, c.tree, if(max(n) = 1, c.idx, c.idx // {FANOUT}) idx, if(max(n) = 1, c.cur, sha256(string_agg(if(m.idx = c.idx, c.cur, m.h), '' ORDER BY m.idx))) cur,
      c.proof || coalesce(string_agg(m.h, '' ORDER BY m.idx) FILTER (m.idx <> c.idx), '') proof
      FROM c{k} c JOIN m{k} m ON c.tree = m.tree AND c.idx // {FANOUT} = m.idx // {FANOUT} GROUP BY c.k, c.tree, c.idx, c.cur, c.proof)"""
        if not half:
            k = levels
            sql += f""",
    n{k + 1} AS (SELECT -1 tree, tree idx, h FROM n{k}), c{k + 1} AS (SELECT k, -1 tree, tree idx, cur, proof FROM c{k})"""
    last = 2 * levels + 1
    return sql + f"""
    SELECT a.doc_id, a.leaf, s.h subroot, r.h root, sha256(c.proof) proof_sha256, c.cur folded_root, c.cur = r.h verified
    FROM a0 a JOIN c{last} c USING (k) JOIN n{levels} s ON s.tree = a.tree CROSS JOIN n{last} r"""


ORACLE_SQL = _sql()
