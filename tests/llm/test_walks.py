import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from frametide.llm import queries, walks

from .test_layout import DATA


def plain_samples(text):
    """The embedding a step at a time: write the character, then move on if the step's bit says so."""
    go = np.random.default_rng(walks.SEED).random((walks.CLASSES, walks.STEPS)) < 0.5
    go[:, ::64] = True
    written, k = [], 0
    while k < len(text):
        written.append(k)
        k += bool(go[(ord(text[k]) * 0x9E3779B1 & 0xFFFFFFFF) >> 26, (len(written) - 1) % walks.STEPS])
    out = []
    for row in walks._places():
        at = max((int(s) for s in row if s < len(written)), default=None)
        if at is None:
            out.append(0)
            continue
        seen = at * 0x9E3779B97F4A7C15 & (1 << 64) - 1
        for g in range(walks.GRAM):
            place = written[at] + g
            seen = seen * 3 + (ord(text[place]) + 1 if place < len(text) else 0) & (1 << 64) - 1
            seen = int(walks.mix(np.array([seen], np.uint64))[0])
        out.append(seen >> 60)
    return out


def test_same_as_step_by_step():
    draw = random.Random(2)
    texts = ["", "a", "\U0001f600é", "".join(draw.choice("abcdefgh \n") for _ in range(3000)), "x" * 40_000, "word " * 50]
    got = walks.fingerprints(texts)
    assert [g.tolist() for g in got] == [plain_samples(t) for t in texts]
    assert [walks.fingerprints([t])[0].tolist() for t in texts] == got.tolist()
    assert all((walks.samples_of(walks.shown(g)) == g).all() for g in got)


@settings(max_examples=300, deadline=None)
@given(st.text("abcé", max_size=30), st.text("abcé", max_size=30))
def test_edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        row, last = [i + 1], row
        for j, y in enumerate(b):
            row.append(min(last[j] + (x != y), last[j + 1] + 1, row[j] + 1))
    assert walks.edit_distance(a, b) == row[-1]


def plain_rows(rows):
    """Rows in the operator's order, each with the next one's text."""
    return [(r[0], walks.spliced(r[1] or "", rows[(k + 1) % len(rows)][1] or "")) for k, r in enumerate(rows)]


def test_edited(spark):
    draw = random.Random(4)
    words = ["alpha", "beta", "gamma", "délta", "\n", "epsilon"]
    rows = [(k * 7 - 50, " ".join(draw.choice(words) for _ in range(draw.randrange(0, 90)))) for k in range(300)]
    rows += [(10_000, None), (10_001, ""), (10_002, "ab"), (10_003, "long text " * 20_000), (None, "no id at all")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("Range", F.lit("clash")).withColumn("side", F.lit(1)).withColumn("n_chars", F.lit("x"))
    got = {r.doc_id: r for r in walks.edited(docs.repartition(5)).collect()}
    want = plain_rows(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True))
    assert len(got) == len(rows)
    for (id, edited), text in zip(want, dict(rows).values(), strict=False):
        text = dict(rows)[id] or ""
        r = got[id]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        prints = walks.fingerprints([text, edited])
        assert (r.fingerprint, r.edited_fingerprint) == (walks.shown(prints[0]), walks.shown(prints[1]))
        assert r.near_edited == pytest.approx(float(walks.likeness(prints[0], prints[1]))) and 0 <= r.near_next <= 1


def test_edited_edges(spark):
    same = spark.createDataFrame([(3, "one two three four"), (3, "one two three four"), (3, "another text of three"), (1, "the last one")], "doc_id long, text string")
    got = walks.edited(same).collect()
    assert len(got) == 4 and len({r.fingerprint for r in got}) == 3
    order = [r for r in got if r.doc_id == 1]
    assert order[0].edited_sha256 in {hashlib.sha256(walks.spliced("the last one", t).encode()).hexdigest() for t in ("one two three four", "another text of three")}
    (alone,) = walks.edited(same.where("doc_id = 1")).collect()
    assert alone.edited_sha256 == hashlib.sha256(walks.spliced("the last one", "the last one").encode()).hexdigest() and alone.near_next == 1.0
    assert walks.edited(same.limit(0)).count() == 0
    kept = walks.fingerprinted(same.withColumn("Fingerprint", F.lit(1)))
    assert kept.columns[-1] == "_fingerprint" and kept.count() == 4


def test_near_duplicates(spark):
    draw = random.Random(6)
    words = [f"{a}{b}" for a in ("ta", "ri", "mo", "ke", "su", "lan") for b in ("no", "rel", "tis", "wa", "pen", "dor")]
    text = lambda n: " ".join(draw.choice(words) for _ in range(n))

    def changed(t, edits):
        t = list(t)
        for _ in range(edits):
            k = draw.randrange(len(t))
            t[k : k + draw.randrange(2)] = draw.choice("abcdexyz")
        return "".join(t)

    base = [text(draw.randrange(100, 300)) for _ in range(60)]
    rows = [(k, t) for k, t in enumerate(base)]
    rows += [(1000 + k, changed(t, 2)) for k, t in enumerate(base)]
    rows += [(2000 + k, t) for k, t in enumerate(base[:20])] + [(3000, None), (3001, ""), (3002, "short"), (3002, base[0]), (None, base[0])]
    rows += [(4000 + k, changed(base[5], 1)) for k in range(600)]  # more than two blocks of near copies
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("sha", F.lit(1)).withColumn("Fingerprint", F.lit(1))
    got = {r.doc_id: r.component_id for r in walks.classes(docs).collect() if r.doc_id is not None and r.doc_id != 3002}
    found = sum(got[k] == got[1000 + k] for k in range(60))
    assert found >= 54 and all(got[2000 + k] == got[k] for k in range(20))
    assert len({got[k] for k in range(60)}) == 60 and got[3000] == got[3001] == 3000
    assert sum(got[4000 + k] == got[5] for k in range(600)) >= 590
    assert walks.classes(docs.limit(0)).count() == 0


def test_query_tells_edits_from_others(spark):
    rows = queries.op12_walks(spark, DATA).toPandas()
    long = rows[rows.n_chars > 300]
    assert (long.near_edited > 0.45).mean() > 0.95 and long.near_next.median() < 0.1
    assert rows.fingerprint.str.len().eq(256).all()
