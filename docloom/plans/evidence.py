"""Queries: question plans, evidence and context (E rows). Each benchmark item is a question of three chained hops; graded
results and quotes are cut from the parents that the search found."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import evidence as E
from docloom.registry import query

from . import retrieval as P
from .tables import stored, table


def plans(spark, sf_dir):
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), "text")
    hop = lambda pos, name, deps, task: F.struct(F.lit(pos).alias("pos"), F.lit(name).alias("id"), task.alias("task"), F.array(*map(F.lit, deps)).cast("array<string>").alias("depends_on"), F.lit("document").alias("source"))
    head = F.concat(F.lit("Find "), F.array_join(F.slice(F.split("text", r"\s+"), 1, 30), " "))
    hops = F.array(hop(0, "h1", [], head), hop(1, "h2", ["h1"], F.lit("the second step")), hop(2, "h3", ["h2"], F.when(F.col("question_id") % 5 == 0, " ").otherwise("the third step")))
    return q.select("question_id", F.inline(hops))


def found(spark, sf_dir):
    """Written once: quotes and context both come from it."""
    p = P.parents(spark, sf_dir).select(F.col("id").alias("parent_id"), "document_id", "chunk_index", "text")
    rows = P.fused(spark, sf_dir).join(p, "parent_id")
    return stored(rows.select(F.col("query_id").alias("question_id"), "position", F.col("parent_id").cast("string").alias("chunk_id"), "document_id", "chunk_index", "text"), "found")


def evidence(spark, sf_dir, rows=None):
    """A literal quote, a quote with a gap, and a changed one, for the first three chunks of each question."""
    words = F.split("text", r"\s+")
    piece = lambda a, n: F.array_join(F.slice(words, a, n), " ")
    quote = F.when(F.col("position") == 1, piece(1, 8)).when(F.col("position") == 2, F.concat(piece(1, 5), F.lit(" ... "), piece(9, 5))).otherwise(F.concat(piece(1, 4), F.lit(" never said at all")))
    rows = found(spark, sf_dir) if rows is None else rows
    return rows.where("position <= 3").select("question_id", F.concat(F.lit("h"), F.col("position").cast("string")).alias("hop_id"), "chunk_id", quote.alias("quote"))


def chunks(spark, sf_dir):
    return P.parents(spark, sf_dir).select(F.col("id").cast("string").alias("id"), "text")


def updates(spark, sf_dir, told=None):
    rows = evidence(spark, sf_dir) if told is None else told
    value = F.concat(F.lit("value "), "hop_id")
    prior = F.when(F.col("hop_id") == "h2", F.create_map(F.lit("h1"), F.lit("value h1"))).when(F.col("hop_id") == "h3", F.create_map(F.lit("h2"), F.lit("value h2"))).otherwise(F.create_map().cast("map<string,string>"))
    return rows.select("question_id", "hop_id", F.lit("resolved").alias("status"), value.alias("value"), prior.alias("bindings"), F.array(F.struct("chunk_id", "quote")).alias("evidence"), F.lit("").alias("reason"))


def resolved(spark, sf_dir, rows=None):
    told = stored(evidence(spark, sf_dir, rows), "evidence")
    return E.resolve_hops(plans(spark, sf_dir), updates(spark, sf_dir, told), E.verify_quotes(told, chunks(spark, sf_dir)))


@query("e1_clean_search_query", r"""WITH t AS (SELECT conv_id, turn, list_filter(list_transform(string_split(CASE turn % 3 WHEN 0 THEN 'Query: "' || text || '"' WHEN 1 THEN substr(text, 1, 140) ELSE substr(text, 1, 60) || ' | x' END, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM conversations),
q AS (SELECT conv_id, turn, len(l) AS n, trim(regexp_replace(regexp_replace(l[1], '(?i)^(search query|query)\s*:\s*', ''), '^["''`]+|["''`]+$', '', 'g')) AS q FROM t)
SELECT conv_id, turn, CASE WHEN n = 1 AND NOT contains(q, '|') AND length(q) <= 150 AND len(string_split_regex(q, '\s+')) <= 20 THEN q ELSE '' END AS q FROM q""")
def cleaned(spark, sf_dir):
    t, n = F.col("text"), F.col("turn") % 3
    raw = F.when(n == 0, F.concat(F.lit('Query: "'), t, F.lit('"'))).when(n == 1, F.substring(t, 1, 140)).otherwise(F.concat(F.substring(t, 1, 60), F.lit(" | x")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", E.clean_search_query(raw).alias("q"))


@query("e2_validate_plans", "SELECT item_id AS question_id, item_id % 9 = 0 AS valid FROM benchmark")
def valid(spark, sf_dir):
    """Of nine plans one is sound; the others break one rule each."""
    k = F.col("question_id") % 9
    own = plans(spark, sf_dir).withColumn("task", F.concat(F.lit("task "), "id"))
    task = F.when((k == 1) & (F.col("id") == "h2"), "  ").otherwise(F.col("task"))
    name = F.when((k == 2) & (F.col("id") == "h3"), "h2").otherwise(F.col("id"))
    first, text = F.col("id") == "h1", "array<string>"
    deps = (
        F.when((k == 3) & first, F.array(F.lit("h3"))).when((k == 4) & first, F.array(F.lit("h1"))).when((k == 5) & (F.col("id") == "h2"), F.array(F.lit("h1"), F.lit("h1")))
        .when((k == 8) & first, F.lit(None).cast(text)).otherwise(F.col("depends_on"))
    )
    source = F.when((k == 6) & first, "web").otherwise(F.col("source"))
    rows = own.select("question_id", "pos", name.alias("id"), task.alias("task"), deps.alias("depends_on"), source.alias("source"))
    more = own.where((k == 7) & first).select("question_id", F.explode(F.sequence(F.lit(3), F.lit(12))).alias("pos"), F.lit("x").alias("x"))
    more = more.select("question_id", "pos", F.concat("x", F.col("pos").cast("string")).alias("id"), F.lit("more").alias("task"), F.array().cast(text).alias("depends_on"), F.lit("document").alias("source"))
    return E.validate_plans(rows.unionByName(more))


#: Evidence in SQL: hop h1 quotes a chunk literally, h2 with a gap, h3 words that no chunk has; res holds what is resolved.
TRACE = rf"""WITH {P.BASE}, found AS (SELECT query_id AS question_id, position, parent_id, string_split_regex(p.text, '\s+') AS ws FROM fused f JOIN parents p ON p.id = f.parent_id WHERE position <= 3),
ev AS (SELECT question_id, position, 'h' || position AS hop_id, CAST(parent_id AS VARCHAR) AS chunk_id, ws, array_to_string(ws[1:8], ' ') AS quote FROM found),
checked AS (SELECT question_id, hop_id, chunk_id, position, CASE position WHEN 1 THEN true WHEN 2 THEN len(ws) >= 3 ELSE false END AS found, CASE position WHEN 1 THEN length(quote) >= 8 ELSE true END AS long_enough FROM ev),
asks AS (SELECT item_id AS question_id, text FROM benchmark),
own AS (SELECT question_id, coalesce(bool_or(found AND long_enough) FILTER (position = 1), false) AS r1, coalesce(bool_or(found) FILTER (position = 2), false) AS q2, count(*) FILTER (position = 1) AS n1, count(*) FILTER (position = 2) AS n2, count(*) FILTER (position = 3) AS n3
    FROM asks LEFT JOIN checked USING (question_id) GROUP BY question_id),
res AS (SELECT question_id, 'h1' AS hop_id, CASE WHEN n1 = 0 THEN 'not_resolved' WHEN r1 THEN '' ELSE 'quote_not_found' END AS reason FROM own
    UNION ALL SELECT question_id, 'h2', CASE WHEN n2 = 0 THEN 'not_resolved' WHEN NOT r1 THEN 'unresolved_dependency' WHEN q2 THEN '' ELSE 'quote_not_found' END FROM own
    UNION ALL SELECT question_id, 'h3', CASE WHEN n3 = 0 THEN 'not_resolved' WHEN NOT (r1 AND q2) THEN 'unresolved_dependency' ELSE 'quote_not_found' END FROM own)"""


@query("e3_starting_queries", r"""WITH w AS (SELECT item_id AS question_id, string_split(text, ' ') AS ws, trim(regexp_replace(array_to_string(string_split_regex(text, '\s+')[1:20], ' '), '^["''`]+|["''`]+$', '', 'g')) AS made FROM benchmark),
every AS (SELECT question_id, (1, pos) AS place, hop AS hop_id, trim(array_to_string(ws[pos % 2 + 1:pos % 2 + 5], ' ')) AS text FROM w, (VALUES (0, 'h2'), (1, ''), (2, 'h3'), (3, '')) v(pos, hop)
    UNION ALL SELECT question_id, (p, a), 'h1', made FROM w, (VALUES (0, 0), (1, 1000000)) v(p, a) WHERE length(made) BETWEEN 4 AND 150 AND NOT contains(made, '|')),
once AS (SELECT question_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS key, min(place) AS place, arg_max(hop_id, place) AS hop_id, arg_max(text, place) AS text FROM every WHERE text <> '' GROUP BY 1, 2)
SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY place, key) AS position, hop_id, text FROM once QUALIFY position <= 4""")
def starting(spark, sf_dir):
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.posexplode(F.array(F.lit("h2"), F.lit(""), F.lit("h3"), F.lit(""))).alias("pos", "hop_id"), "text")
    return E.starting_queries(plans(spark, sf_dir), q.withColumn("text", F.array_join(F.slice(F.split("text", " "), F.col("pos") % 2 + 1, 5), " ")), 4)


@query("e4_validate_grades", f"""{TRACE}, told AS (SELECT question_id, hop_id, position, CASE WHEN position = 1 AND question_id % 4 = 0 THEN 'unknown_task' WHEN position = 2 AND question_id % 3 = 0 THEN 'duplicate_task_result'
    WHEN position = 3 AND question_id % 2 = 1 THEN 'invalid_task_result' END AS fault FROM ev)
SELECT question_id, hop_id, CASE WHEN fault IS NULL THEN 'resolved' ELSE 'pending' END AS status, coalesce(fault, '') AS reason FROM told WHERE fault IS NULL OR fault <> 'unknown_task'
UNION ALL SELECT question_id, hop_id, 'warning', fault FROM told WHERE fault IS NOT NULL""")
def graded(spark, sf_dir):
    rows = updates(spark, sf_dir).withColumn("pos", F.lit(0))
    again = rows.where("hop_id = 'h2' and question_id % 3 = 0").withColumn("pos", F.lit(1))
    broken = rows.where("hop_id = 'h3'").withColumn("value", F.when(F.col("question_id") % 2 == 0, F.col("value")))
    kept, warnings = E.validate_grades(rows.where("hop_id <> 'h3'").unionByName(again).unionByName(broken), plans(spark, sf_dir).where("id <> 'h1' or question_id % 4 > 0"))
    return kept.select("question_id", "hop_id", "status", "reason").unionByName(warnings.select("question_id", "hop_id", F.lit("warning").alias("status"), F.col("warning").alias("reason")))


@query("e5_verify_quotes", f"{TRACE} SELECT question_id, hop_id, chunk_id, found FROM checked")
def verified(spark, sf_dir):
    return E.verify_quotes(evidence(spark, sf_dir), chunks(spark, sf_dir)).select("question_id", "hop_id", "chunk_id", "found")


@query("e6_resolve_hops")
def hops(spark, sf_dir):
    return resolved(spark, sf_dir)


@query("e6_resolve_status", f"{TRACE} SELECT question_id, hop_id, CASE WHEN reason = '' THEN 'resolved' ELSE 'pending' END AS status, CASE WHEN reason = '' THEN 'value ' || hop_id ELSE '' END AS value, reason FROM res")
def hop_status(spark, sf_dir):
    return resolved(spark, sf_dir).select("question_id", "hop_id", "status", "value", "reason")


@query("e7_round_decision", f"""{TRACE}, n AS (SELECT question_id, count(*) FILTER (reason = '' AND hop_id <> 'h1') > 0 AS moved, count(*) FILTER (reason <> '') AS open FROM res GROUP BY 1),
s AS (SELECT question_id, open = 0 AS complete, CASE WHEN moved THEN 0 ELSE question_id % 2 + 1 END AS stalled FROM n)
SELECT question_id, complete, stalled, CASE WHEN complete THEN 'complete' WHEN question_id % 3 + 1 >= 3 THEN 'round_limit' WHEN stalled >= 2 THEN 'no_progress' ELSE '' END AS stop_reason FROM s""")
def decided(spark, sf_dir):
    now = resolved(spark, sf_dir)
    state = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), (F.col("item_id") % 3 + 1).alias("round"), F.lit(3).alias("max_rounds"), (F.col("item_id") % 2).alias("no_progress_rounds"), F.lit(True).alias("graded"))
    return E.round_decision(plans(spark, sf_dir), now.where("hop_id = 'h1'"), now, state)


@query("e8_fresh_follow_ups", f"""{TRACE}, next AS (SELECT question_id, min(hop_id) FILTER (reason <> '') AS hop_id FROM res GROUP BY 1),
said AS (SELECT question_id, trim(regexp_replace(array_to_string(string_split_regex(text, '\\s+')[1:6], ' '), '^["''`]+|["''`]+$', '', 'g')) AS text FROM asks)
SELECT question_id, hop_id, text FROM said JOIN next USING (question_id) WHERE hop_id IN ('h2', 'h3') AND question_id % 4 > 0 AND length(text) BETWEEN 4 AND 150 AND NOT contains(text, '|')""")
def fresh(spark, sf_dir):
    texts = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.array_join(F.slice(F.split("text", r"\s+"), 1, 6), " ").alias("text"))
    proposals = texts.select("question_id", F.explode(F.array(F.lit("h2"), F.lit("h3"))).alias("hop_id"), "text")
    return E.fresh_follow_ups(plans(spark, sf_dir), resolved(spark, sf_dir), proposals, texts.where("question_id % 4 = 0").withColumn("text", F.upper("text")))


@query("e9_merge_rounds", """SELECT conv_id AS question_id, turn // 2 AS attempt, arg_max(text, turn) FILTER (turn % 3 > 0) AS text, arg_max(role, turn) AS role FROM conversations GROUP BY 1, 2""")
def merged(spark, sf_dir):
    t = F.col("turn")
    return E.merge_rounds(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("question_id"), F.floor(t / 2).alias("attempt"), t.alias("seq"), F.when(t % 3 > 0, F.col("text")).alias("text"), "role"))


def sized(rows):
    return rows.select("question_id", F.col("position").alias("pos"), "chunk_id", F.col("document_id").cast("string").alias("document_id"), "chunk_index", F.char_length("text").alias("length"))


@query("e10_select_context")
def context(spark, sf_dir):
    rows = found(spark, sf_dir)
    bundles = resolved(spark, sf_dir, rows).where("status = 'resolved'").select("question_id", F.substring("hop_id", 2, 9).cast("int").alias("pos"), F.transform("evidence", lambda x: x["chunk_id"]).alias("chunk_ids"))
    return E.select_context(sized(rows), bundles, 10, 6_000)


@query("e11_simple_context", f"""WITH RECURSIVE {P.BASE}, rows AS (SELECT query_id AS question_id, CAST(parent_id AS VARCHAR) AS chunk_id, length(p.text) AS len,
    row_number() OVER (PARTITION BY query_id ORDER BY CAST(p.document_id AS VARCHAR), p.chunk_index, CAST(parent_id AS VARCHAR)) AS n FROM fused f JOIN parents p ON p.id = f.parent_id QUALIFY n <= 10),
walk AS (SELECT DISTINCT question_id, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS used, CAST(NULL AS VARCHAR) AS chunk_id FROM rows
    UNION ALL SELECT r.question_id, r.n, CASE WHEN used > 4000 AND used + len > 6000 THEN used ELSE used + len END, CASE WHEN used > 4000 AND used + len > 6000 THEN NULL ELSE r.chunk_id END FROM walk w JOIN rows r ON r.question_id = w.question_id AND r.n = w.n + 1)
SELECT question_id, chunk_id FROM walk WHERE chunk_id IS NOT NULL""")
def simple(spark, sf_dir):
    return E.simple_context(sized(found(spark, sf_dir)), 10, 6_000)


@query("e12_citations", f"""WITH {P.BASE} SELECT id, CASE WHEN chunk_index % 3 = 0 THEN page_number || '-' || (page_number + part % 2) WHEN chunk_index % 3 = 1 THEN CAST(page_number AS VARCHAR) ELSE CAST(chunk_index + 1 AS VARCHAR) END AS page,
    'Part > ' || chunk_index AS section, substr(text, 1, 200) AS snippet FROM parents""")
def cited(spark, sf_dir):
    n = F.col("chunk_index")
    return E.citations(P.parents(spark, sf_dir).select("id", "text", F.when(n % 3 == 1, F.col("page_number")).alias("page_number"), F.when(n % 3 == 0, F.col("source_pages")).alias("source_pages"), n.alias("sequence"), F.lit("source-4").alias("source_id"), F.array(F.lit("Part"), n.cast("string")).alias("heading_path")))


@query("e13_reasoning_steps", rf"""{TRACE}, h AS (SELECT r.question_id, r.hop_id, reason, CASE WHEN reason = '' THEN r.hop_id || ': value ' || r.hop_id || ' (chunks: ' || chunk_id || ')' ELSE r.hop_id || ': pending (' || reason || ')' END AS line,
    r.hop_id || ': ' || CASE r.hop_id WHEN 'h1' THEN 'Find ' || array_to_string(string_split_regex(text, '\s+')[1:30], ' ') WHEN 'h2' THEN 'the second step' ELSE CASE WHEN r.question_id % 5 = 0 THEN ' ' ELSE 'the third step' END END AS task
    FROM res r JOIN asks USING (question_id) LEFT JOIN ev ON ev.question_id = r.question_id AND ev.hop_id = r.hop_id),
g AS (SELECT question_id, string_agg(line, chr(10) ORDER BY hop_id) AS found, count(*) FILTER (reason = '') AS done, count(*) AS n, coalesce(string_agg(task, chr(10) ORDER BY hop_id) FILTER (reason <> ''), '') AS open FROM h GROUP BY 1)
SELECT question_id, 1 AS step, 'initial_search' AS type, 'Search round 0' AS title, 'a | b' AS description, found AS findings FROM g UNION ALL SELECT question_id, 2, 'multi_hop_search', 'Search round 2', 'c', found FROM g
UNION ALL SELECT question_id, 3, 'synthesis', 'Answer evidence', done || '/' || n || ' tasks supported; stop reason: round_limit.', open FROM g""")
def steps(spark, sf_dir):
    now = resolved(spark, sf_dir)
    hop = F.struct("hop_id", "status", "value", F.transform("evidence", lambda x: x["chunk_id"]).alias("chunks"), "reason")
    rounds = now.groupBy("question_id").agg(F.array_sort(F.collect_list(hop)).alias("hops")).select("question_id", F.posexplode(F.array(F.array(F.lit("a"), F.lit("b")), F.array().cast("array<string>"), F.array(F.lit("c")))).alias("attempt", "queries"), "hops")
    stops = now.select("question_id").distinct().withColumn("stop_reason", F.lit("round_limit"))
    return E.reasoning_steps(plans(spark, sf_dir), now, rounds, stops)
