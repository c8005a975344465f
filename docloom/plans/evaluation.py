"""Queries: conversations, evaluation and cost (M rows). Messages are conversations, golden questions the benchmark with
the documents that hold an item as targets, judge scores labels, and usage events."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import evaluation as M
from docloom.operators import retrieval as R
from docloom.registry import query

from . import retrieval as P
from .tables import stored, table

MODELS = [*M.PRICES, "another-model", None]
CITED = " [Source ID: 7, Page 3] and [Page 12] but [kept]"


def messages(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    k = F.col("conv_id")
    status = F.when(k % 3 == 0, "awaiting_approval").otherwise("done")
    return c.select(
        k.alias("conversation_id"), F.col("turn").alias("created_at"), F.col("turn").alias("id"), "role", F.when(F.col("role") == "assistant", F.concat("text", F.lit(CITED))).otherwise(F.col("text")).alias("content"),
        F.to_json(F.struct(F.concat(F.lit("t"), (k % 5).cast("string")).alias("threadId"), status.alias("status"))).alias("metadata"),
    )


def conversations(spark, sf_dir):
    k = F.col("conv_id")
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("updated_at"))
    return rows.select(k.alias("id"), F.when(k % 3 == 1, "New chat").when(k % 3 == 2, F.concat(F.lit("T"), k.cast("string"))).alias("title"), (k % 7).alias("user_id"), (k % 11).alias("document_id"), F.when(k % 4 == 0, "GLOBAL").otherwise("DOCUMENT").alias("type"), "updated_at")


MESSAGES = f"""messages AS (SELECT conv_id AS conversation_id, turn AS created_at, role, CASE WHEN role = 'assistant' THEN text || '{CITED}' ELSE text END AS content FROM conversations),
convs AS (SELECT conv_id AS id, CASE conv_id % 3 WHEN 1 THEN 'New chat' WHEN 2 THEN 'T' || conv_id END AS title, conv_id % 7 AS user_id, conv_id % 11 AS document_id, CASE WHEN conv_id % 4 = 0 THEN 'GLOBAL' ELSE 'DOCUMENT' END AS type, max(turn) AS updated_at FROM conversations GROUP BY conv_id)"""


@query("m1_chat_history", rf"""WITH {MESSAGES}, last AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY created_at DESC) - 1 AS n,
    regexp_replace(regexp_replace(content, '\s*\[[^\]]*(?:Source ID|Page \d)[^\]]*\]', '', 'g'), '^\s+|\s+$', '', 'g') AS t FROM messages QUALIFY n < 6)
SELECT conversation_id, md5(string_agg(upper(role) || ': ' || CASE WHEN length(t) > m THEN regexp_replace(left(t, m), '\n+', ' ', 'g') || '...' ELSE t END, chr(10) ORDER BY n DESC)) AS history_md5
FROM (SELECT *, CASE WHEN n < 4 THEN 3000 ELSE 200 END AS m FROM last) GROUP BY conversation_id""")
def history(spark, sf_dir):
    return M.chat_history(messages(spark, sf_dir)).select("conversation_id", F.md5("history").alias("history_md5"))


@query("m2_conversation_titles", rf"""WITH {MESSAGES} SELECT id, CASE WHEN title IS NULL OR title = 'New chat' THEN coalesce(substr(trim(regexp_replace(q, '\s+', ' ', 'g')), 1, 60), title) ELSE title END AS title
FROM convs LEFT JOIN (SELECT conversation_id AS id, arg_min(content, created_at) AS q FROM messages WHERE role = 'user' GROUP BY 1) USING (id)""")
def titles(spark, sf_dir):
    return M.conversation_titles(conversations(spark, sf_dir), messages(spark, sf_dir))


@query("m3_latest_conversation", f"WITH {MESSAGES} SELECT user_id, document_id, arg_max(id, (updated_at, id)) AS id, max(updated_at) AS updated_at FROM convs WHERE type = 'DOCUMENT' GROUP BY 1, 2")
def latest(spark, sf_dir):
    return M.latest_document_conversation(conversations(spark, sf_dir))


@query("m3_list_conversations", f"WITH {MESSAGES} SELECT user_id, id, title, updated_at, row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC, id DESC) AS position FROM convs WHERE type = 'GLOBAL'")
def listed(spark, sf_dir):
    return M.list_conversations(conversations(spark, sf_dir))


@query("m3_latest_messages", f"""WITH {MESSAGES}, best AS (SELECT user_id, document_id, arg_max(id, (updated_at, id)) AS conversation_id FROM convs WHERE type = 'DOCUMENT' GROUP BY 1, 2)
SELECT user_id, document_id, conversation_id, m.created_at AS id, m.role, row_number() OVER (PARTITION BY conversation_id ORDER BY created_at) AS position FROM best JOIN messages m USING (conversation_id)""")
def latest_messages(spark, sf_dir):
    return M.latest_messages(conversations(spark, sf_dir), messages(spark, sf_dir)).drop("content")


@query("m4_waiting_messages", "SELECT conv_id AS conversation_id, turn AS id FROM conversations WHERE role = 'assistant' AND conv_id % 5 = 1 AND conv_id % 3 = 0")
def waiting(spark, sf_dir):
    return M.waiting_messages(messages(spark, sf_dir), "t1").select("conversation_id", "id")


def ranks(spark, sf_dir):
    """question_id, rank, category, faithfulness, relevance of each item."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), "text")
    held = M.holding_documents(items, table(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("doc_id", "chunk_id")
    found = P.fused(spark, sf_dir).select(F.col("query_id").alias("question_id"), F.floor(F.col("parent_id") / 10_000).alias("chunk_id"), F.col("position").alias("rank"))
    judged = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("question_id"), F.col("quality").alias("faithfulness"), F.col("toxic").alias("relevance"))
    return M.target_rank(items, held, found).join(judged, "question_id", "left").withColumn("category", F.concat(F.lit("c"), (F.col("question_id") % 3).cast("string")))


RANKS = f"""WITH {P.BASE}, wanted AS (SELECT item_id AS question_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) AND len(string_split(b.text, ' ')) > 2),
found AS (SELECT query_id AS question_id, parent_id // 10000 AS doc_id, min(position) AS rank FROM fused GROUP BY 1, 2),
worst AS (SELECT question_id, CASE WHEN bool_and(rank IS NOT NULL) THEN max(rank) ELSE 0 END AS rank FROM wanted LEFT JOIN found USING (question_id, doc_id) GROUP BY 1),
ranks AS (SELECT b.item_id AS question_id, rank, quality AS faithfulness, toxic AS relevance, 'c' || (b.item_id % 3) AS category FROM benchmark b LEFT JOIN worst w ON w.question_id = b.item_id LEFT JOIN labels l ON l.doc_id = b.item_id)"""
METRICS = """count(*) AS questions, count(rank) AS with_target, round(sum(CASE WHEN rank > 0 THEN 1.0::DOUBLE / rank WHEN rank = 0 THEN 0 END) / nullif(count(rank), 0), 6) AS mrr,
round(count(*) FILTER (rank BETWEEN 1 AND 3)::DOUBLE / nullif(count(rank), 0), 6) AS recall3, round(count(*) FILTER (rank BETWEEN 1 AND 5)::DOUBLE / nullif(count(rank), 0), 6) AS recall5,
round(avg(faithfulness), 6) AS faithfulness, round(avg(relevance), 6) AS relevance"""


@query("m5_target_rank", f"{RANKS} SELECT question_id, rank FROM ranks")
def target_rank(spark, sf_dir):
    return ranks(spark, sf_dir).select("question_id", "rank")


@query("m6_retrieval_metrics", f"{RANKS} SELECT {METRICS} FROM ranks")
def metrics(spark, sf_dir):
    return M.retrieval_metrics(ranks(spark, sf_dir))


@query("m7_metrics_by_category", f"{RANKS} SELECT category, {METRICS} FROM ranks GROUP BY ROLLUP (category)")
def by_category(spark, sf_dir):
    return M.retrieval_metrics(ranks(spark, sf_dir), "category")


@query("m6_metrics_report", f"""{RANKS}, m AS (SELECT category, {METRICS} FROM ranks GROUP BY ROLLUP (category))
SELECT category, questions, with_target, {", ".join(f"CASE WHEN with_target = 0 THEN 'n/a' ELSE printf('%.1f%%', round({c} * 100, 1)) END AS {c}" for c in ("mrr", "recall3", "recall5"))}, faithfulness, relevance FROM m""")
def metrics_report(spark, sf_dir):
    """The figures of ``m7_metrics_by_category`` as the report prints them."""
    return M.printed(M.retrieval_metrics(ranks(spark, sf_dir), "category"))


def usage(spark, sf_dir):
    e, n = table(spark, sf_dir, "events"), F.col("event_id")
    model = F.element_at(F.array(*[F.lit(m) for m in MODELS]), (n % len(MODELS) + 1).cast("int"))
    return e.select(F.col("user_id").alias("run_id"), n.alias("step"), model.alias("model"), (n * 37 % 5_003).alias("prompt_tokens"), (n * 91 % 1_009).alias("completion_tokens"), F.when(n % 2 == 0, n * 3 % 7_001).alias("total_tokens"))


_CASE = lambda i: "CASE model " + " ".join(f"WHEN '{m}' THEN {p[i]}" for m, p in M.PRICES.items()) + f" ELSE {M.DEFAULT_PRICE[i]} END"
COST = f"""WITH usage AS (SELECT user_id AS run_id, event_id AS step, [{', '.join('NULL' if m is None else repr(m) for m in MODELS)}][event_id % {len(MODELS)} + 1] AS model,
    event_id * 37 % 5003 AS prompt_tokens, event_id * 91 % 1009 AS completion_tokens, CASE WHEN event_id % 2 = 0 THEN event_id * 3 % 7001 END AS t FROM events),
priced AS (SELECT *, (CAST(prompt_tokens AS DECIMAL(14, 0)) * CAST({_CASE(0)} AS DECIMAL(8, 4)) + CAST(completion_tokens AS DECIMAL(14, 0)) * CAST({_CASE(1)} AS DECIMAL(8, 4))) * CAST(0.000001 AS DECIMAL(7, 6)) AS usd FROM usage),
costs AS (SELECT run_id, step, model, prompt_tokens, completion_tokens, coalesce(t, prompt_tokens + completion_tokens) AS total_tokens, CAST(round(usd, 6) AS DOUBLE) AS cost_usd, CAST(round(usd * CAST({M.RUPEES} AS DECIMAL(4, 2)), 4) AS DOUBLE) AS cost_inr FROM priced)"""


@query("m8_llm_cost", f"{COST} SELECT * FROM costs")
def cost(spark, sf_dir):
    return M.llm_cost(usage(spark, sf_dir))


@query("m9_cost_summary", f"{COST} SELECT run_id, CAST(sum(total_tokens) AS BIGINT) AS tokens, round(sum(cost_usd), 6) AS cost_usd, round(sum(cost_inr), 4) AS cost_inr, count(*) AS n_steps FROM costs GROUP BY run_id")
def run_costs(spark, sf_dir):
    return M.cost_summary(M.llm_cost(usage(spark, sf_dir))).select("run_id", "tokens", "cost_usd", "cost_inr", F.size("steps").cast("long").alias("n_steps"))


@query("m10_search_trace", f"""WITH {P.BASE}, {P.SIBLINGS} SELECT query_id AS question_id, count(*) AS candidates, count(*) FILTER (position <= 4) AS kept,
    (SELECT count(DISTINCT found) FROM siblings s WHERE s.question_id = f.query_id AND found NOT IN (SELECT parent_id FROM seeds d WHERE d.question_id = f.query_id)) AS added_by_neighbours,
    count(*) FILTER (position <= 4 AND parent_id % 2 = 0) AS relevant FROM fused f GROUP BY query_id""")
def trace(spark, sf_dir):
    fused = stored(P.fused(spark, sf_dir), "fused")
    found = fused.select(F.col("query_id").alias("question_id"), F.col("parent_id").alias("chunk_id"), "position")
    kept = found.where("position <= 4")
    near = R.expand_siblings(P.seeds_of(fused), P.parents(spark, sf_dir)).select("question_id", F.col("found").alias("chunk_id"))
    return M.search_trace(found, kept, near, kept.where("chunk_id % 2 = 0"))
