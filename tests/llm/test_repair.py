import hashlib
import heapq
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from frametide.llm import queries, repair

from .test_layout import DATA

WRITES = {0: "u", 1: "u", 2: "a", 3: "u"}
LEGAL = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        out += [(conv, turn, "user" if d == 4 else role, text)] * (0 if d == 0 else 2 if d == 3 else 1)
    return out


def cheapest(rows):
    """(cost, audit, repaired text) of (role, text, fault) rows, by trying edits in order of cost and audit."""
    heap, done = [(0, "", 0, 0, ())], set()
    while heap:
        cost, audit, k, q, written = heapq.heappop(heap)
        if k == len(rows) and q in (0, 3):
            return cost, audit, "\n".join(written)
        if (k, q, cost, audit) in done or (k, q) in done and audit[-1:] != "I":
            continue
        done |= {(k, q, cost, audit)}
        role = {"u": "user", "a": "assistant"}[WRITES[q]]
        after = LEGAL[WRITES[q], q]
        if audit[-2:] != "II":
            heapq.heappush(heap, (cost + 3, audit + "I", k, after, (*written, f"{role}:")))
        if k < len(rows):
            own, text, fault = rows[k]
            heapq.heappush(heap, (cost + 4, audit + "D", k + 1, q, written))
            if fault not in (1, 2):
                extra = 3 * (fault == 3)
                heapq.heappush(heap, (cost + 3 + extra, audit + "R", k + 1, after, (*written, f"{role}:{text}")))
                if (own[:1], q) in LEGAL:
                    heapq.heappush(heap, (cost + extra, audit + "K", k + 1, LEGAL[own[:1], q], (*written, f"{own}:{text}")))


def plain_version(rows, original):
    out = {}
    for conv in original:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        seen, marked = set(), []
        for _, _, role, text in own:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            marked.append((role, text, 1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0))
            seen.add((role, text))
        turns = {r[1] for r in own} - {None}
        initials = [r[2][:1] for r in own]
        cost, audit, text = cheapest(marked)
        count = lambda f: sum(m[2] == f for m in marked)
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, count(1), count(2), count(3), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def some_rows(n=400, seed=5):
    draw = random.Random(seed)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "abc", "USER"]
    texts = ["Yes.", "No!", "why", "", " \t\n", "...", None, "ends. \n", "é?", "x" * 3000 + "."]
    rows = []
    for conv in [*range(n), None]:
        for k in range(draw.randrange(1, 7)):
            rows.append((conv, draw.choice([k, k, k, k + 2, None, -3]), draw.choice(roles), draw.choice(texts)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_against_all_edits(spark):
    rows = some_rows()
    docs = frame(spark, rows).withColumn("Fault", F.lit("clash")).withColumn("_copy", F.lit(0))
    got = {r.conv_id: tuple(r)[1:] for r in repair.repair(repair.damage(docs), dropped="dropped").collect()}
    assert got == plain_version(damaged(rows), {r[0] for r in rows})
    again = {r.conv_id: tuple(r)[1:] for r in repair.repair(docs.repartition(7)).collect()}
    assert again == plain_version([(c, t, r if r is not None else " ", x if x is not None else " ") for c, t, r, x in rows], {r[0] for r in rows})


def test_edges(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (2, 0, "assistant", "Lone."), (3, None, "user", "a"), (3, None, "user", "a"), (4, 5, None, None)]
    got = {r.conv_id: tuple(r)[1:8] for r in repair.repair(frame(spark, rows)).collect()}
    assert got == {1: (0, 0, 0, 0, 0, 0, "KK"), 2: (0, 0, 0, 0, 0, 3, "IK"), 3: (0, 0, 1, 1, 1, 8, "DD"), 4: (0, 1, 0, 0, 0, 4, "D")}
    gone = repair.repair(frame(spark, rows).withColumn("gone", F.lit(True)), dropped="gone").collect()
    assert {tuple(r)[1:] for r in gone} == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())} and len(gone) == 4
    assert repair.repair(frame(spark, rows).limit(0)).count() == 0
    named = frame(spark, rows).selectExpr("cast(conv_id as string) as c", "turn as t", "role as r", "text as x")
    assert {r.conv_id for r in repair.repair(named, id="c", turn="t", role="r", text="x").collect()} == {"1", "2", "3", "4"}


def test_one_long_conversation(spark):
    """A conversation of many rows: the cost is that of its parts, the steps between layers stay few."""
    n = 30_000
    rows = spark.range(n).selectExpr("7L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('t', id, if(id % 100 = 99, '', '.')) as text").where("id % 1000 <> 550")
    (r,) = repair.repair(rows).collect()
    assert (r.gaps, r.truncated, r.illegal) == (n // 1000, n // 100, n // 1000)
    assert r.cost == 3 * (n // 100) + 3 * (n // 1000) and r.audit.count("I") == n // 1000 and len(r.audit) == n
    steps = repair.Steps()
    one = repair.Conversation(steps, 0)
    draw = random.Random(1)
    for k in range(20_000):
        one.add(k, draw.choice(["user", "assistant", "system", "tool"]), f"{k}", draw.choice([0, 0, 0, 1, 2, 3]))
    assert len(steps.made) < 2000 and len(one.report()[7]) >= 20_000


def test_repaired_rows(spark):
    rows = frame(spark, some_rows(60, seed=9)).where("conv_id is not null")
    report = repair.repair(rows)
    out = {}
    for r in sorted(repair.repaired(rows, report).collect(), key=lambda r: (r.conv_id, r.nth)):
        out.setdefault(r.conv_id, []).append(r)
    for r in report.collect():
        own = out.get(r.conv_id, [])
        assert [x.nth for x in own] == list(range(len(own)))
        assert hashlib.sha256("\n".join(f"{x.role}:{x.text}" for x in own).encode()).hexdigest() == r.repaired_sha256
        assert re.fullmatch("(s?(ua)+)?", "".join(x.role[0] for x in own))


def test_one_shuffle(spark):
    plan = repair.repair(frame(spark, some_rows(5)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


@pytest.mark.parametrize("source", ["table", "odd"])
def test_query_against_sql(spark, tmp_path, source):
    folder = DATA
    if source == "odd":
        folder = str(tmp_path)
        frame(spark, some_rows(200, seed=3)).coalesce(1).write.parquet(f"{folder}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet{'/*.parquet' if source == 'odd' else ''}'")
    cursor = con.execute(queries.oracle_sql()["op11_repair"])
    names = [d[0] for d in cursor.description]
    want = sorted(map(str, cursor.fetchall()))
    got = sorted(str(tuple(r[c] for c in names)) for r in queries.op11_repair(spark, folder).collect())
    assert got == want and len(got) >= 20
