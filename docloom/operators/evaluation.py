"""Conversations, retrieval metrics and model cost."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: US dollars per million tokens, by model, and rupees per dollar.
PRICES = {
    "openai/gpt-oss-120b": (0.59, 0.79),
    "llama-3.3-70b-versatile": (0.59, 0.79),
    "openai/gpt-oss-20b": (0.05, 0.08),
    "llama-3.1-8b-instant": (0.05, 0.08),
    "gemini-3.5-flash-lite": (0.075, 0.3),
    "gemini-2.0-flash": (0.075, 0.3),
    "gemini-1.5-flash": (0.075, 0.3),
    "qwen/qwen3.8-flash": (0.15, 0.47),
    "alibaba/qwen3.8-omni-flash": (0.15, 0.47),
}
DEFAULT_PRICE, RUPEES = (0.15, 0.3), 96.78


def chat_history(messages: DataFrame, n: int = 6, recent: int = 4, long: int = 3_000, short: int = 200) -> DataFrame:
    """conversation_id, history: the last n messages as ``ROLE: text`` lines, oldest first; citations in brackets go,
    and texts are cut at ``long`` characters (the newest ``recent`` messages) or ``short``. messages: conversation_id,
    created_at, id, role, content."""
    w = Window.partitionBy("conversation_id").orderBy(F.desc("created_at"), F.desc("id"))
    last = messages.withColumn("n", F.row_number().over(w) - 1).where(F.col("n") < n)
    text = F.regexp_replace(F.regexp_replace(F.coalesce("content", F.lit("")), r"\s*\[[^\]]*(?:Source ID|Page \d)[^\]]*\]", ""), r"^\s+|\s+$", "")
    most = F.when(F.col("n") < recent, long).otherwise(short)
    cut = F.when(F.char_length(text) > most, F.concat(F.regexp_replace(F.substring(text, F.lit(1), most), r"\n+", " "), F.lit("..."))).otherwise(text)
    line = F.struct((-F.col("n")).alias("at"), F.concat(F.upper("role"), F.lit(": "), cut).alias("line"))
    return last.groupBy("conversation_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n").alias("history"))


def conversation_titles(conversations: DataFrame, messages: DataFrame, default: str = "New chat", most: int = 60) -> DataFrame:
    """id, title: its own, or from the first user message where it has none or the default one."""
    first = messages.where("role = 'user'").groupBy("conversation_id").agg(F.min_by("content", F.struct("created_at", "id")).alias("_first"))
    own = conversations.join(first, conversations["id"] == first["conversation_id"], "left")
    made = F.substring(F.trim(F.regexp_replace("_first", r"\s+", " ")), 1, most)
    return own.select("id", F.when(F.col("title").isNull() | (F.col("title") == default), F.coalesce(made, "title")).otherwise(F.col("title")).alias("title"))


def latest_document_conversation(conversations: DataFrame) -> DataFrame:
    """The newest DOCUMENT conversation of each user and document."""
    best = conversations.where("type = 'DOCUMENT'").groupBy("user_id", "document_id").agg(F.max(F.struct("updated_at", "id")).alias("best"))
    return best.select("user_id", "document_id", F.col("best.id").alias("id"), F.col("best.updated_at").alias("updated_at"))


def list_conversations(conversations: DataFrame) -> DataFrame:
    """Each user's GLOBAL conversations, the last updated first (position)."""
    w = Window.partitionBy("user_id").orderBy(F.desc("updated_at"), F.desc("id"))
    return conversations.where("type = 'GLOBAL'").select("user_id", "id", "title", "updated_at", F.row_number().over(w).alias("position"))


def latest_messages(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """The messages, oldest first (position), of the newest DOCUMENT conversation of each user and document."""
    best = latest_document_conversation(conversations).select("user_id", "document_id", F.col("id").alias("conversation_id"))
    w = Window.partitionBy("conversation_id").orderBy("created_at", "id")
    rows = messages.join(best, "conversation_id")
    return rows.select("user_id", "document_id", "conversation_id", "id", "role", "content", F.row_number().over(w).alias("position"))


def waiting_messages(messages: DataFrame, thread: str) -> DataFrame:
    """Assistant messages whose JSON metadata has the thread and waits for approval."""
    get = lambda k: F.get_json_object("metadata", f"$.{k}")
    return messages.where((F.col("role") == "assistant") & (get("threadId") == thread) & (get("status") == "awaiting_approval"))


def holding_documents(items: DataFrame, docs: DataFrame, run: int = 5) -> DataFrame:
    """question_id, doc_id: the documents whose text contains the item's text, as written. items: question_id, text; docs:
    doc_id, text.

    All words of an item but its first and last are whole words of any text that holds it, so up to ``run`` of them are a
    key that documents are met by, and only texts that share it are searched. Items of fewer than three words (between
    single blanks) are no passages and found nowhere."""
    keyed = items.select("question_id", F.col("text").alias("item"), F.split("text", " ").alias("w")).where(F.size("w") > 2)
    keyed = keyed.select("question_id", "item", F.least(F.size("w") - 2, F.lit(run)).alias("n"), "w")
    keyed = keyed.select("question_id", "item", "n", F.xxhash64("n", F.array_join(F.slice("w", F.lit(2), F.col("n")), " ")).alias("key"))
    lengths = [r["n"] for r in keyed.select("n").distinct().orderBy("n").collect()]  # at most ``run``
    if not lengths:
        return keyed.select("question_id", F.lit(0).cast("long").alias("doc_id"))
    # the words are bound once, as the variable of an outer lambda, and not split again for each window
    windows = ", ".join(f"transform(sequence(1, greatest(size(w) - {n - 1}, 1)), i -> xxhash64({n}, array_join(slice(w, i, {n}), ' ')))" for n in lengths)
    keys = docs.select("doc_id", F.explode(F.expr(f"array_distinct(flatten(flatten(transform(array(split(text, ' ')), w -> array({windows})))))")).alias("key"))
    near = keys.join(keyed, "key").select("question_id", "item", F.col("doc_id").alias("near_id")).distinct()
    return docs.join(near, docs["doc_id"] == near["near_id"]).where(F.contains("text", "item")).select("question_id", "doc_id").distinct()


def target_rank(questions: DataFrame, targets: DataFrame, results: DataFrame) -> DataFrame:
    """question_id, rank: the worst rank of the question's targets, 0 if one isn't found; questions without targets have
    null. targets: question_id, chunk_id, a row for each; results: question_id, chunk_id, rank."""
    hit = targets.join(results.groupBy("question_id", "chunk_id").agg(F.min("rank").alias("rank")), ["question_id", "chunk_id"], "left")
    worst = hit.groupBy("question_id").agg(F.when(F.bool_and(F.col("rank").isNotNull()), F.max("rank")).otherwise(0).alias("rank"))
    return questions.select("question_id").join(worst, "question_id", "left")


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, "n/a").otherwise(F.format_string("%.1f%%", F.round(part / whole * 100, 1)))


def printed(metrics: DataFrame) -> DataFrame:
    """Rows of retrieval_metrics with mrr and recalls as percentages to one decimal, "n/a" where no question has a target."""
    shown = {c: percent(F.col(c) * F.col("with_target"), F.col("with_target")) for c in ("mrr", "recall3", "recall5")}
    return metrics.withColumns(shown)


def retrieval_metrics(ranks: DataFrame, by: str | None = None) -> DataFrame:
    """questions, with_target, mrr, recall3, recall5, faithfulness, relevance; with ``by``, one row per value and one
    overall (null). ranks: rank (null without target), faithfulness, relevance (null where no judge spoke)."""
    rows = ranks.rollup(by) if by else ranks.groupBy()
    r = F.col("rank")
    share = lambda c: F.round(F.sum(c) / F.when(F.count(r) > 0, F.count(r)), 6)
    return rows.agg(
        F.count("*").alias("questions"), F.count(r).alias("with_target"), share(F.when(r > 0, 1 / r).when(r == 0, 0.0)).alias("mrr"), share(F.when(r.between(1, 3), 1).otherwise(0)).alias("recall3"),
        share(F.when(r.between(1, 5), 1).otherwise(0)).alias("recall5"), F.round(F.avg("faithfulness"), 6).alias("faithfulness"), F.round(F.avg("relevance"), 6).alias("relevance"),
    )


def llm_cost(usage: DataFrame) -> DataFrame:
    """``usage`` (model, prompt_tokens, completion_tokens, total_tokens) with total_tokens filled and cost_usd, cost_inr;
    the price list is a fixed map, so there is no join."""
    exact = lambda x: F.lit(Decimal(str(x)))  # noqa: E731  decimals, so that halves round alike everywhere
    prices = [F.create_map(*[y for m, x in PRICES.items() for y in (F.lit(m), exact(x[i]).cast("decimal(8,4)"))]) for i in (0, 1)]
    price = [F.coalesce(F.try_element_at(m, F.col("model")), exact(d).cast("decimal(8,4)")) for m, d in zip(prices, DEFAULT_PRICE)]
    p, c = F.coalesce("prompt_tokens", F.lit(0)), F.coalesce("completion_tokens", F.lit(0))
    whole = lambda x: x.cast("decimal(14,0)")
    usd = ((whole(p) * price[0] + whole(c) * price[1]) * exact("0.000001")).cast("decimal(26,10)")
    return usage.withColumns({"total_tokens": F.coalesce("total_tokens", p + c), "cost_usd": F.round(usd, 6).cast("double"), "cost_inr": F.round(usd * exact(RUPEES), 4).cast("double")})


def cost_summary(costs: DataFrame) -> DataFrame:
    """run_id, tokens and costs summed over its steps as they were rounded, and the steps' list."""
    step = F.struct("step", "model", "total_tokens", "cost_inr")
    return costs.groupBy("run_id").agg(F.sum("total_tokens").alias("tokens"), F.round(F.sum("cost_usd"), 6).alias("cost_usd"), F.round(F.sum("cost_inr"), 4).alias("cost_inr"), F.array_sort(F.collect_list(step)).alias("steps"))


def search_trace(candidates: DataFrame, kept: DataFrame, expanded: DataFrame, relevant: DataFrame) -> DataFrame:
    """question_id, candidates, kept, added_by_neighbours (expanded but not kept before), relevant: per question."""
    key = ["question_id", "chunk_id"]
    n = lambda df, name: df.select(*key).distinct().groupBy("question_id").agg(F.count("*").alias(name))
    added = expanded.join(kept.select(*key), key, "left_anti")
    parts = [n(candidates, "candidates"), n(kept, "kept"), n(added, "added_by_neighbours"), n(relevant, "relevant")]
    found = parts[0]
    for p in parts[1:]:
        found = found.join(p, "question_id", "full")
    return found.na.fill(0)
