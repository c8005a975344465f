import hashlib

import duckdb
import pytest

from docloom.llm import chat

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, window string"


def plain(rows):
    out = {}
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (-(2**63) if r[1] is None else r[1], r[2] or "", r[3] or ""))
        own = [(r[2] or "", r[3] or "") for r in own]
        targets = "".join(t for r, t in own if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[c] = (len(own), sha("".join(f"{r}\n{t}\n" for r, t in own)), len(targets), sha(targets))
    return out


def odd_rows():
    rows = [(1, t, ("user", "assistant")[t % 2], f"turn {t} " * (t % 50)) for t in range(3_000)]
    rows += [(2, 0, "system", "be <|end|>\n kind & [INST]"), (2, 1, "user", None), (2, 2, "assistant", ""), (2, 3, "assistant", "&lt;é\U0001f600|>\n<|end|>\n")]
    rows += [(3, None, "user", "x"), (3, 1, None, "y"), (3, 1, None, "y"), (None, 0, "assistant", "lost " * 500), (4, 5, "system", "s"), (4, 2, "assistant", "w " * 400), (4, 9, "assistant", "w " * 90), (4, 10, "<|x|>", "q")]
    return rows


def test_round_trip(spark):
    rows = odd_rows()
    frame = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    windows = chat.format_windows(frame)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(windows).collect()}
    assert got == plain(rows)
    assert chat.digests(chat.format_windows(frame.limit(0))).count() == 0


def test_windows_keep_the_system_turn_history_and_budget(spark):
    rows = [(1, 0, "system", "rules"), *[(1, t, ("assistant", "user")[t % 2], "word " * 30) for t in range(1, 60)]]
    found = sorted(chat.format_windows(spark.createDataFrame([(*r, "") for r in rows], SCHEMA)).collect(), key=lambda r: r.window)
    assert [r.window for r in found] == list(range(len(found))) and len(found) > 5
    for r in found:
        assert r.formatted.startswith("<|system|>\nrules<|end|>\n")
        assert len(r.formatted.split()) <= 2 * (chat.SPAN + chat.HISTORY)
        assert r.n_repeated == (0 if r.window == 0 else 2)
        for s in r.loss:
            assert r.formatted[s.start : s.start + s.length] == "word " * 30 and r.formatted[: s.start].endswith("<|assistant|>\n")


def test_query_matches_the_sql(spark):
    got = chat.query(spark, SF).toPandas().sort_values("conv_id", ignore_index=True)
    conversations = f"(SELECT * FROM read_parquet('{SF}/conversations.parquet'))"
    want = duckdb.sql(chat.ORACLE_SQL.replace("FROM conversations", f"FROM {conversations}")).df().sort_values("conv_id", ignore_index=True)
    assert got.astype(str).values.tolist() == want[got.columns].astype(str).values.tolist()
    plan = chat.query(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
