"""Queries: access control and catalogue (A rows). Users are customers, roles nations, documents suppliers; a user has
its nation's role, and the building segment's customers are admins. One role in five also holds the next nation's."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import access as A
from docloom.registry import query

from .tables import table

BASE = """users AS (SELECT c_custkey AS id, c_name AS name, c_name || '@example.org' AS email, c_mktsegment = 'BUILDING' AS is_admin, c_custkey * 7 % 1009 AS created_at FROM customer),
user_roles AS (SELECT c_custkey AS user_id, c_nationkey AS role_id FROM customer UNION SELECT c_custkey, (c_nationkey + 1) % 25 FROM customer WHERE c_custkey % 5 = 0),
roles AS (SELECT n_nationkey AS id, n_name AS name FROM nation),
role_documents AS (SELECT s_nationkey AS role_id, s_suppkey AS document_id FROM supplier),
docs AS (SELECT s_suppkey AS id, s_name AS filename, CASE s_suppkey % 4 WHEN 0 THEN 'PROCESSING' WHEN 1 THEN 'FAILED' ELSE 'COMPLETED' END AS status,
    CASE WHEN s_suppkey % 3 = 0 THEN '  ' WHEN s_suppkey % 3 = 1 THEN s_name END AS summary, 'NONE' AS summary_status, s_suppkey * 13 % 101 AS created_at FROM supplier)"""


def tables(spark, sf_dir) -> dict:
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    ids = F.col("s_suppkey")
    return {
        "users": c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.concat("c_name", F.lit("@example.org")).alias("email"), (F.col("c_mktsegment") == "BUILDING").alias("is_admin"), (F.col("c_custkey") * 7 % 1009).alias("created_at")),
        "user_roles": c.select(F.col("c_custkey").alias("user_id"), F.explode(F.when(F.col("c_custkey") % 5 == 0, F.array("c_nationkey", (F.col("c_nationkey") + 1) % 25)).otherwise(F.array("c_nationkey"))).alias("role_id")),
        "roles": table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")),
        "role_documents": s.select(F.col("s_nationkey").alias("role_id"), ids.alias("document_id")),
        "documents": s.select(
            ids.alias("id"), F.col("s_name").alias("filename"), F.when(ids % 4 == 0, "PROCESSING").when(ids % 4 == 1, "FAILED").otherwise("COMPLETED").alias("status"),
            F.when(ids % 3 == 0, "  ").when(ids % 3 == 1, F.col("s_name")).alias("summary"), F.lit("NONE").alias("summary_status"), (ids * 13 % 101).alias("created_at"),
        ),
    }


VISIBLE = """visible AS (SELECT DISTINCT u.id AS user_id, rd.document_id FROM users u JOIN user_roles ur ON ur.user_id = u.id JOIN role_documents rd ON rd.role_id = ur.role_id WHERE NOT u.is_admin
    UNION ALL SELECT u.id, d.id FROM users u CROSS JOIN docs d WHERE u.is_admin)"""


@query("a1_accessible_documents", f"WITH {BASE}, {VISIBLE} SELECT user_id, document_id FROM visible")
def accessible(spark, sf_dir):
    t = tables(spark, sf_dir)
    return A.accessible_documents(t["users"], t["user_roles"], t["role_documents"], t["documents"])


@query("a2_can_access", f"""WITH {BASE}, {VISIBLE}, pairs AS (SELECT DISTINCT o_custkey AS user_id, o_orderkey % 17 AS document_id FROM orders)
SELECT p.*, v.user_id IS NOT NULL AS allowed FROM pairs p LEFT JOIN visible v USING (user_id, document_id)""")
def allowed(spark, sf_dir):
    t = tables(spark, sf_dir)
    pairs = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), (F.col("o_orderkey") % 17).alias("document_id")).distinct()
    return A.can_access(pairs, t["users"], t["user_roles"], t["role_documents"], t["documents"])


@query("a3_role_counts", f"""WITH {BASE} SELECT id, name, (SELECT count(DISTINCT document_id) FROM role_documents x WHERE x.role_id = r.id) AS documents,
    (SELECT count(DISTINCT user_id) FROM user_roles x WHERE x.role_id = r.id) AS users FROM roles r""")
def counts(spark, sf_dir):
    t = tables(spark, sf_dir)
    return A.role_counts(t["roles"], t["user_roles"], t["role_documents"])


@query("a4_role_members", f"""WITH {BASE} SELECT id, name, coalesce((SELECT list(document_id ORDER BY document_id) FROM role_documents x WHERE x.role_id = r.id), []) AS document_ids,
    coalesce((SELECT list(user_id ORDER BY user_id) FROM user_roles x WHERE x.role_id = r.id), []) AS user_ids FROM roles r""")
def members(spark, sf_dir):
    t = tables(spark, sf_dir)
    return A.role_members(t["roles"], t["user_roles"], t["role_documents"])


@query("a4_roles_of_users", f"WITH {BASE} SELECT user_id, list(r.name ORDER BY r.name) AS roles FROM user_roles ur JOIN roles r ON r.id = ur.role_id GROUP BY user_id")
def user_roles(spark, sf_dir):
    t = tables(spark, sf_dir)
    return A.roles_of_users(t["users"], t["user_roles"], t["roles"])


@query("a5_reconcile_links", f"""WITH {BASE}, desired AS (SELECT role_id, document_id FROM role_documents WHERE document_id % 3 > 0 UNION SELECT (role_id + 1) % 25, document_id FROM role_documents WHERE document_id % 3 = 1)
SELECT role_id, document_id, CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN 'keep' WHEN a.k IS NOT NULL THEN 'delete' ELSE 'insert' END AS action
FROM (SELECT *, 1 AS k FROM role_documents) a FULL JOIN (SELECT *, 1 AS k FROM desired) b USING (role_id, document_id)""")
def reconciled(spark, sf_dir):
    now = tables(spark, sf_dir)["role_documents"]
    moved = now.where("document_id % 3 = 1").select(((F.col("role_id") + 1) % 25).alias("role_id"), "document_id")
    return A.reconcile_links(now, now.where("document_id % 3 > 0").unionByName(moved), ["role_id", "document_id"])


@query("a6_missing_references", "SELECT DISTINCT l_suppkey * 2 AS document_id FROM lineitem WHERE l_suppkey * 2 NOT IN (SELECT s_suppkey FROM supplier)")
def missing(spark, sf_dir):
    asked = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") * 2).alias("document_id"))
    return A.missing_references(asked, tables(spark, sf_dir)["role_documents"], "document_id")


@query("a7_search_users", f"WITH {BASE} SELECT id, email, name, created_at FROM users WHERE lower(email) LIKE '%00001%' OR lower(name) LIKE '%00001%'")
def found_users(spark, sf_dir):
    return A.search_users(tables(spark, sf_dir)["users"], "00001")


@query("a8_list_documents", f"WITH {BASE} SELECT id, filename, status, created_at FROM docs WHERE id IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 48)")
def listed(spark, sf_dir):
    ids = table(spark, sf_dir, "lineitem").where("l_quantity > 48").select(F.col("l_suppkey").alias("document_id"))
    return A.list_documents(tables(spark, sf_dir)["documents"], ids)


@query("a10_delete_documents", f"""WITH {BASE}, gone AS (SELECT id FROM docs WHERE status IN ('COMPLETED', 'FAILED') AND id IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49))
SELECT 'documents' AS kind, id AS document_id, count(*) AS n FROM docs WHERE id NOT IN (SELECT id FROM gone) GROUP BY id
UNION ALL SELECT 'role_documents', document_id, count(*) FROM role_documents WHERE document_id NOT IN (SELECT id FROM gone) GROUP BY document_id
UNION ALL SELECT 'lines', l_suppkey, count(*) FROM lineitem WHERE l_suppkey NOT IN (SELECT id FROM gone) GROUP BY l_suppkey""")
def deleted(spark, sf_dir):
    t, items = tables(spark, sf_dir), table(spark, sf_dir, "lineitem")
    rows = items.select(F.col("l_suppkey").alias("document_id"))
    ids = items.where("l_quantity > 49").select(F.col("l_suppkey").alias("document_id"))
    left = A.delete_documents(t["documents"], ids, {"role_documents": t["role_documents"], "lines": rows})
    count = lambda kind, df: df.groupBy("document_id").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "document_id", "n")
    return count("documents", left["documents"].withColumnRenamed("id", "document_id")).unionByName(count("role_documents", left["role_documents"])).unionByName(count("lines", left["lines"]))


@query("a11_backfill_summary_status", f"""WITH {BASE} SELECT id, status, CASE WHEN status = 'COMPLETED' THEN CASE WHEN nullif(trim(summary), '') IS NOT NULL THEN 'COMPLETED' ELSE 'FAILED' END ELSE summary_status END AS summary_status FROM docs""")
def summaries(spark, sf_dir):
    return A.backfill_summary_status(tables(spark, sf_dir)["documents"]).select("id", "status", "summary_status")


@query("a12_backfill_conversation_type", "SELECT conv_id, document_id, CASE WHEN document_id IS NOT NULL THEN 'DOCUMENT' ELSE 'GLOBAL' END AS type FROM (SELECT DISTINCT conv_id, CASE WHEN conv_id % 3 > 0 THEN conv_id END AS document_id FROM conversations)")
def types(spark, sf_dir):
    convs = table(spark, sf_dir, "conversations").select("conv_id", F.when(F.col("conv_id") % 3 > 0, F.col("conv_id")).alias("document_id")).distinct()
    return A.backfill_conversation_type(convs)
