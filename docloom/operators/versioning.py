"""Document versions: what a re-upload changed, and the slowly changing rows that record it.

Chunks carry document_id, id, section, chunk_index, content_hash, added_in and removed_in; children parent_id and
context_hash besides. Equal chunks are paired first in, first out, by chunk_index.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.frames import stored, united


def change_gate(uploads: DataFrame, documents: DataFrame, diff: DataFrame) -> DataFrame:
    """document_id, verdict (same_file, same_text or changed) and the counts of ``diff`` of each upload.

    uploads: document_id, file_hash; documents: id, file_hash; diff: doc_id, same or kept and moved, added, removed (none
    for documents without units on either side: they count as changed)."""
    counts = [c for c in ("same", "kept", "moved", "added", "removed") if c in diff.columns]
    d = documents.select(F.col("id").alias("document_id"), F.col("file_hash").alias("_old"))
    rows = uploads.join(d, "document_id").join(diff.withColumnRenamed("doc_id", "document_id"), "document_id", "left")
    verdict = F.when(F.col("file_hash") == F.col("_old"), "same_file").when((F.col("added") == 0) & (F.col("removed") == 0), "same_text").otherwise("changed")
    return rows.select("document_id", verdict.alias("verdict"), *counts)


def _numbered(chunks: DataFrame, *keys: str) -> DataFrame:
    return chunks.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("chunk_index", "id")))


def plan_parents(old: DataFrame, new: DataFrame) -> DataFrame:
    """document_id, old_id, new_id, action: kept parents take their old id, the others are added or removed.

    Numbering equal chunks makes the join one to one, so boilerplate doesn't multiply."""
    keys = ["document_id", "content_hash", "_n"]
    a = _numbered(old, "document_id", "content_hash").select(*keys, F.col("id").alias("old_id"))
    b = _numbered(new, "document_id", "content_hash").select(*keys, F.col("id").alias("new_id"))
    action = F.when(F.col("old_id").isNull(), "added").when(F.col("new_id").isNull(), "removed").otherwise("kept")
    return a.join(b, keys, "full").select("document_id", "old_id", "new_id", action.alias("action"))


def plan_children(parents: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """old_id, new_id, parent_id (the final one), action, reembed: children of kept parents are paired by content hash;
    all others are added or removed with their parents. A kept child is embedded again if its context changed."""
    kept = parents.where("action = 'kept'").select("old_id", "new_id")
    final = F.coalesce(F.col("p.old_id"), F.col("c.parent_id"))
    a = _numbered(old.withColumn("parent", F.col("parent_id")), "parent", "content_hash").select("parent", "content_hash", "_n", F.col("id").alias("old_id"), F.col("context_hash").alias("_was"))
    b = new.alias("c").join(kept.alias("p"), F.col("c.parent_id") == F.col("p.new_id"), "left").select("c.*", final.alias("parent"))
    b = _numbered(b, "parent", "content_hash").select("parent", "content_hash", "_n", F.col("id").alias("new_id"), F.col("context_hash").alias("_is"))
    both = a.join(b, ["parent", "content_hash", "_n"], "full")
    action = F.when(F.col("old_id").isNull(), "added").when(F.col("new_id").isNull(), "removed").otherwise("kept")
    reembed = (action == "added") | ((action == "kept") & (F.col("_was") != F.col("_is")))
    return both.select("old_id", "new_id", F.col("parent").alias("parent_id"), action.alias("action"), reembed.alias("reembed"))


def remap_links(new: DataFrame, plan: DataFrame) -> DataFrame:
    """New parents (id, prev_id, next_id) with all three ids final."""
    final = plan.where("action = 'kept'").select(F.col("new_id").alias("_k"), F.col("old_id").alias("_v"))
    for c in ("id", "prev_id", "next_id"):
        new = new.join(final, new[c] == final["_k"], "left").withColumn(c, F.coalesce("_v", c)).drop("_k", "_v")
    return new


def apply_version(current: DataFrame, new: DataFrame, plan: DataFrame, versions: DataFrame) -> DataFrame:
    """The parents' table after the replacements of ``plan``: a new snapshot with removed rows closed, added rows opened
    and kept rows under their old ids with the new text and links. versions: document_id, version (what the upload
    wants to be), current_version; an upload that isn't the next version changes nothing."""
    fit = versions.where("version = current_version + 1").select("document_id", "version")
    p = plan.join(fit, "document_id")
    gone = p.where("action = 'removed'").select(F.col("old_id").alias("id"), F.col("version").alias("_gone"))
    kept = p.where("action = 'kept'").select(F.col("old_id").alias("id"), "new_id")
    fresh = new.withColumnRenamed("id", "new_id").select("new_id", F.col("text").alias("_text"), F.col("chunk_index").alias("_index"))
    rows = current.join(gone, "id", "left").join(kept, "id", "left").join(fresh, "new_id", "left")
    rows = rows.select("document_id", "id", F.coalesce("_text", "text").alias("text"), F.coalesce("_index", "chunk_index").alias("chunk_index"), "added_in", F.coalesce("removed_in", "_gone").alias("removed_in"))
    added = p.where("action = 'added'").select(F.col("new_id").alias("id"), "version").join(new, "id")
    return united([rows, added.select("document_id", "id", "text", "chunk_index", F.col("version").alias("added_in"), F.lit(None).cast("int").alias("removed_in"))])


def apply_links(applied: DataFrame, new: DataFrame, plan: DataFrame, versions: DataFrame) -> DataFrame:
    """id, prev_id, next_id of the parents that are current after ``apply_version``: those of the new version, all ids
    final. new: id, prev_id, next_id and document_id."""
    fit = versions.where("version = current_version + 1").select("document_id")
    links = remap_links(new.join(fit, "document_id", "left_semi").select("id", "prev_id", "next_id"), plan)
    return links.join(applied.where("removed_in is null").select("id"), "id", "left_semi")


def apply_children(current: DataFrame, new: DataFrame, plan: DataFrame, versions: DataFrame, encode: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The children's table after the replacements of ``plan`` (of plan_children): removed rows are closed, added ones
    opened under their final parents, kept ones take the new place, and the new search text where they are embedded
    again. ``encode`` adds ``embedding`` to a table with search_text; it sees only rows that are added or embedded again.

    current: document_id, id, parent_id, search_text, chunk_index, embedding, added_in, removed_in; new: document_id, id,
    search_text, chunk_index."""
    fit = versions.where("version = current_version + 1").select("document_id", "version")
    fresh = new.join(fit, "document_id").select("document_id", F.col("id").alias("new_id"), F.col("search_text").alias("_text"), F.col("chunk_index").alias("_index"), "version")
    # the plan has no texts; of the new ones only those that are told go on, once, and each is encoded in one place
    plan = stored(plan, "children-plan")
    changed = plan.where("new_id is not null").select("old_id", "new_id", F.col("parent_id").alias("_parent"), "action", "reembed").join(fresh, "new_id")
    changed = stored(changed.withColumn("_text", F.when(F.col("reembed") | (F.col("action") == "added"), F.col("_text"))), "changed-children")

    def with_vector(rows: DataFrame) -> DataFrame:
        again = encode(rows.where("reembed").withColumn("search_text", F.col("_text"))).drop("search_text").withColumnRenamed("embedding", "_vector")
        return united([again, rows.where("not coalesce(reembed, false)").withColumn("_vector", F.lit(None).cast(again.schema["_vector"].dataType))])

    gone = plan.where("action = 'removed'").select(F.col("old_id").alias("id"), F.lit(True).alias("_gone"))
    kept = with_vector(changed.where("action = 'kept'")).select(F.col("old_id").alias("id"), "_index", F.when(F.col("reembed"), F.col("_text")).alias("_text"), "_vector")
    rows = current.join(gone, "id", "left").join(fit, "document_id", "left").join(kept, "id", "left")
    closed = F.coalesce("removed_in", F.when(F.col("_gone"), F.col("version")))
    old = rows.select("document_id", "id", "parent_id", F.coalesce("_text", "search_text").alias("search_text"), F.coalesce("_index", "chunk_index").alias("chunk_index"), F.coalesce("_vector", "embedding").alias("embedding"), "added_in", closed.alias("removed_in"))
    added = with_vector(changed.where("action = 'added'"))
    return united([old, added.select("document_id", F.col("new_id").alias("id"), F.col("_parent").alias("parent_id"), F.col("_text").alias("search_text"), F.col("_index").alias("chunk_index"), F.col("_vector").alias("embedding"), F.col("version").alias("added_in"), F.lit(None).cast("int").alias("removed_in"))])


def replace_units(current: DataFrame, new: DataFrame, versions: DataFrame) -> DataFrame:
    """The units' table after the replacements: documents that are replaced have the new units alone."""
    fit = versions.where("version = current_version + 1").select("document_id")
    return united([current.join(fit, "document_id", "left_anti"), new.join(fit, "document_id", "left_semi")])


def version_changes(chunks: DataFrame, version: Column) -> DataFrame:
    """document_id, added, removed, kept: what one version did."""
    alive = (F.col("added_in") < version) & (F.col("removed_in").isNull() | (F.col("removed_in") > version))
    return chunks.groupBy("document_id").agg(F.count_if(F.col("added_in") == version).alias("added"), F.count_if(F.col("removed_in") == version).alias("removed"), F.count_if(alive).alias("kept"))


def section_report(chunks: DataFrame, version: Column) -> DataFrame:
    """document_id, section, type, before, after: added and removed chunks of a section side by side, by chunk_index."""
    path = F.when(F.coalesce("section", F.lit("")) == "", "Title and cover").otherwise(F.col("section"))
    rows = chunks.withColumn("section", path)
    w = Window.partitionBy("document_id", "section").orderBy("chunk_index", "id")
    keys = ["document_id", "section", "n"]
    old = rows.where(F.col("removed_in") == version).select("document_id", "section", F.row_number().over(w).alias("n"), F.col("id").alias("before"))
    new = rows.where(F.col("added_in") == version).select("document_id", "section", F.row_number().over(w).alias("n"), F.col("id").alias("after"))
    kind = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").otherwise("changed")
    return old.join(new, keys, "full").select("document_id", "section", kind.alias("type"), "before", "after")


def replace_summary(parents: DataFrame, children: DataFrame) -> DataFrame:
    """One row: kept, added and removed parents and children, and children embedded."""
    count = lambda name: [F.count_if(F.col("action") == a).alias(f"{name}_{a}") for a in ("kept", "added", "removed")]
    return parents.agg(*count("parents")).crossJoin(children.agg(*count("children"), F.count_if("reembed").alias("embedded")))  # one row each
