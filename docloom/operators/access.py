"""Who may see what: roles that link users to documents, and the catalogue of documents.

Tables: users (id, is_admin, ...), user_roles (user_id, role_id), role_documents (role_id, document_id), roles (id, name),
documents (id, ...). Links to rows that don't exist are kept out by the joins that need them; null ids never match.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.frames import united


def accessible_documents(users: DataFrame, user_roles: DataFrame, role_documents: DataFrame, documents: DataFrame) -> DataFrame:
    """user_id, document_id: those of the user's roles, each once; an admin sees every document. Only the users given
    are expanded, so a batch of queries pays for its own users alone."""
    plain = users.where("not is_admin").select(F.col("id").alias("user_id")).distinct()
    by_role = plain.join(user_roles.select("user_id", "role_id").distinct(), "user_id").join(role_documents.select("role_id", "document_id").distinct(), "role_id")
    admins = users.where("is_admin").select(F.col("id").alias("user_id")).distinct()
    # the feature itself: each admin times every document
    every = admins.crossJoin(documents.select(F.col("id").alias("document_id")).distinct())
    return united([by_role.select("user_id", "document_id").distinct(), every])


def can_access(pairs: DataFrame, users: DataFrame, user_roles: DataFrame, role_documents: DataFrame, documents: DataFrame) -> DataFrame:
    """``pairs`` (user_id, document_id) with allowed: by a role, or as an admin if the document exists. Starts from the
    pairs: no user's documents are expanded beyond those asked for."""
    admins = users.where("is_admin").select(F.col("id").alias("user_id"), F.lit(True).alias("_admin")).distinct()
    exist = documents.select(F.col("id").alias("document_id"), F.lit(True).alias("_exists")).distinct()
    asked = pairs.select("user_id", "document_id").distinct()
    by_role = asked.join(user_roles.select("user_id", "role_id").distinct(), "user_id").join(role_documents.select("role_id", "document_id").distinct(), ["role_id", "document_id"], "left_semi")
    by_role = by_role.select("user_id", "document_id", F.lit(True).alias("_role")).distinct()
    found = pairs.join(admins, "user_id", "left").join(exist, "document_id", "left").join(by_role, ["user_id", "document_id"], "left")
    return found.select(*pairs.columns, F.coalesce(F.col("_role"), F.col("_admin") & F.col("_exists"), F.lit(False)).alias("allowed"))


def role_counts(roles: DataFrame, user_roles: DataFrame, role_documents: DataFrame) -> DataFrame:
    """id, name, documents, users of each role. Both sides are counted before they are joined."""
    docs = role_documents.groupBy("role_id").agg(F.countDistinct("document_id").alias("documents"))
    users = user_roles.groupBy("role_id").agg(F.countDistinct("user_id").alias("users"))
    found = roles.join(docs, roles["id"] == docs["role_id"], "left").drop("role_id").join(users, roles["id"] == users["role_id"], "left").drop("role_id")
    return found.na.fill(0, ["documents", "users"]).select("id", "name", "documents", "users")


def role_members(roles: DataFrame, user_roles: DataFrame, role_documents: DataFrame) -> DataFrame:
    """id, name and the sorted lists document_ids and user_ids of each role."""
    docs = role_documents.groupBy("role_id").agg(F.array_sort(F.collect_set("document_id")).alias("document_ids"))
    users = user_roles.groupBy("role_id").agg(F.array_sort(F.collect_set("user_id")).alias("user_ids"))
    found = roles.join(docs, roles["id"] == docs["role_id"], "left").drop("role_id").join(users, roles["id"] == users["role_id"], "left").drop("role_id")
    empty = F.array().cast("array<bigint>")
    return found.select("id", "name", F.coalesce("document_ids", empty).alias("document_ids"), F.coalesce("user_ids", empty).alias("user_ids"))


def roles_of_users(users: DataFrame, user_roles: DataFrame, roles: DataFrame) -> DataFrame:
    """user_id and the sorted names of its roles, empty for none."""
    names = user_roles.join(roles, user_roles["role_id"] == roles["id"]).groupBy("user_id").agg(F.array_sort(F.collect_set("name")).alias("roles"))
    return users.select(F.col("id").alias("user_id")).join(names, "user_id", "left").select("user_id", F.coalesce("roles", F.array().cast("array<string>")).alias("roles"))


def reconcile_links(current: DataFrame, desired: DataFrame, keys: list[str]) -> DataFrame:
    """What turns ``current`` links into ``desired``: keys, action (keep, delete, insert) and current's other columns."""
    now = current.dropDuplicates(keys).withColumn("_now", F.lit(True))
    then = desired.select(*keys).distinct().withColumn("_then", F.lit(True))
    action = F.when(F.col("_now") & F.col("_then"), "keep").when(F.col("_now"), "delete").otherwise("insert")
    return now.join(then, keys, "full").withColumn("action", action).drop("_now", "_then")


def missing_references(ids: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """The distinct ids of ``ids`` that ``known`` doesn't have."""
    return ids.select(key).where(F.col(key).isNotNull()).distinct().join(known.select(key), key, "left_anti")


def search_users(users: DataFrame, term: str) -> DataFrame:
    """Users whose name or email contains ``term``, whatever its case, newest first; no other columns than these."""
    has = lambda c: F.contains(F.lower(F.col(c)), F.lit(term.lower()))
    found = users.where(has("email") | has("name")) if term else users
    return found.select("id", "email", "name", "created_at").orderBy(F.desc("created_at"), "id")


def list_documents(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents of an id set (document_id), newest first, in the columns of the list."""
    wanted = ids.select(F.col("document_id").alias("id")).distinct()
    return documents.join(wanted, "id", "left_semi").select("id", "filename", "status", "created_at").orderBy(F.desc("created_at"), "id")


def list_parents(parents: DataFrame, children: DataFrame) -> DataFrame:
    """Active parents with their number of active children."""
    n = children.where("removed_in is null").groupBy("parent_id").agg(F.count("*").alias("children"))
    live = parents.where("removed_in is null")
    return live.join(n, live["id"] == n["parent_id"], "left").select("document_id", "id", "chunk_index", F.coalesce("children", F.lit(0)).alias("children"))


def list_children(children: DataFrame) -> DataFrame:
    """Active children with the dimension of their embedding (null without one)."""
    return children.where("removed_in is null").select("parent_id", "id", "child_index", F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("dimension"))


def delete_documents(documents: DataFrame, ids: DataFrame, dependents: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All tables after deleting ``ids`` (document_id), of which only COMPLETED or FAILED documents go; rows of
    ``dependents`` (column document_id) go along."""
    gone = documents.where("status in ('COMPLETED', 'FAILED')").select(F.col("id").alias("document_id")).join(ids.select("document_id").distinct(), "document_id", "left_semi")
    left = {name: df.join(gone, "document_id", "left_anti") for name, df in dependents.items()}
    return {"documents": documents.join(gone, documents["id"] == gone["document_id"], "left_anti"), **left}


def backfill_summary_status(documents: DataFrame) -> DataFrame:
    """COMPLETED documents: summary_status COMPLETED if the summary isn't blank, else FAILED; others keep theirs."""
    known = F.trim(F.coalesce("summary", F.lit(""))) != ""
    return documents.withColumn("summary_status", F.when(F.col("status") == "COMPLETED", F.when(known, "COMPLETED").otherwise("FAILED")).otherwise(F.col("summary_status")))


def backfill_conversation_type(conversations: DataFrame) -> DataFrame:
    return conversations.withColumn("type", F.when(F.col("document_id").isNotNull(), "DOCUMENT").otherwise("GLOBAL"))
