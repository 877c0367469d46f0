import math
import random

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from frametide.llm import bilinear, decontaminate, quality

from .brute import base_scores, fold, words

SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(4)
    common = ["the", "of", "and", "to", "in"]
    rare = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(800)]
    return rng, lambda n: " ".join(rng.choice(common) if rng.random() < 0.4 else rng.choice(rare) for _ in range(n))


def test_quality(spark, prose):
    rng, text = prose
    rows = [(i, text(rng.randint(5, 200)) if i % 3 else " | ".join(text(60).split()), int(i % 3 > 0)) for i in range(600)]
    extra = [(600, None), (601, ""), (602, rows[1][1]), (1, rows[1][1]), (None, rows[1][1]), (603, "x" * 200_000)]
    docs = spark.createDataFrame([r[:2] for r in rows] + extra, SCHEMA).selectExpr("*", "'clash' as score", "1 as _raw", "2 as __RAW", "3 as _score", "4 as _id", "5 as _text", "6 as _label")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(601, None), (None, 1), (602, 7)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    out = quality.score(docs, model)
    assert sorted(out.columns) == sorted(docs.columns) and out.where("_raw = 1 and __RAW = 2 and _score = 3 and _id = 4").count() == len(rows) + len(extra)
    got = {r.doc_id: r.score for r in out.select("doc_id", "score").collect()}
    held = [(r[2], got[r[0]]) for r in rows if fold(r[0], 4) == 2]
    assert np.mean([(s >= 0.7) == y for y, s in held]) > 0.9
    assert got[600] == got[601] and 0 <= min(got.values()) and max(got.values()) <= 1 and got[602] == got[1]
    again = quality.fit(docs, labels.where(quality.fold("doc_id", 4) != 2))
    assert again == model  # held-out labels are not used
    # each score from the model's dictionaries, compressed block by block with fresh compressors
    for i, t in [(r[0], r[1]) for r in rows[:20]] + extra[:2] + extra[-1:]:
        raw, z = (t or "").encode(), 0.0
        for k in range(0, len(raw), quality.BLOCK):
            for pair in model.pairs:
                good, bad = (len(zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False).compress(raw[k : k + quality.BLOCK])) for d in pair)
                z += (bad - good) / len(raw) / len(model.pairs)
        assert got[i] == pytest.approx(1 / (1 + math.exp(-(model.slope * z + model.intercept))), rel=0.02), i


def test_sample_is_spread_over_long_texts(spark):
    """What a long labelled text gives to the fit comes from all over it, its end included."""
    body = "".join(f"{k:08d}" for k in range(50_000))
    docs = spark.createDataFrame([(1, body), (2, "short é"), (3, None)], SCHEMA)
    one, two, none = (bytes(r[0]) if r[0] is not None else None for r in docs.orderBy("doc_id").select(quality.spread("text")).collect())
    assert two == "short é".encode() and none is None and len(one) == quality.SAMPLE_BLOCKS * quality.BLOCK
    places = [body.index(one[k : k + 16].decode()) for k in range(0, len(one), quality.BLOCK)]
    assert places[0] == 0 and places[-1] == len(body) - quality.BLOCK and max(np.diff(places)) < len(body) / 10


def test_few_labels(spark, prose):
    """Up to PAIRS texts of a class give the smoothed share; too little text for a trained dictionary is a dictionary itself."""
    _, text = prose
    docs = spark.createDataFrame([(i, text(30)) for i in range(12)], SCHEMA)
    labels = lambda good, bad: spark.createDataFrame([(i, 1) for i in range(good)] + [(good + i, 0) for i in range(bad)], "doc_id long, quality int")
    few = quality.fit(docs, labels(9, 3), held_out=None)
    assert few.pairs == [] and quality.score(docs, few).first().score == pytest.approx(10 / 14)
    some = quality.fit(docs, labels(6, 6), held_out=None)
    assert len(some.pairs) == quality.PAIRS and all(0 <= r.score <= 1 for r in quality.score(docs, some).collect())


def test_quality_without_labels(spark):
    docs, none = spark.createDataFrame([(1, "a")], SCHEMA), spark.createDataFrame([], "doc_id long, quality int")
    assert quality.score(docs, quality.fit(docs, none)).first().score == pytest.approx(0.5)
    assert quality.score(docs.limit(0), quality.fit(docs, none)).count() == 0


def test_base_and_model_scores(spark, prose):
    rng, text = prose
    rows = [(i, text(rng.randint(0, 120)).replace("the", rng.choice(["the", "The", "THE"]))) for i in range(300)]
    rows += [(300, None), (301, ""), (1, "again"), (None, "no id"), (302, "é\x0bü\xa0ß"), (303, "w " * 30_000)]
    got = sorted(bilinear.score(spark.createDataFrame(rows, SCHEMA).withColumn("row", F.lit(1))).collect(), key=lambda r: (r.doc_id is None, r.doc_id, r.n_tokens))
    want = sorted(base_scores(rows), key=lambda r: (r[0] is None, r[0], r[2]))
    for g, w in zip(got, want, strict=True):
        assert tuple(g)[:5] == w[:5] and g.base_score == pytest.approx(w[5], rel=1e-9)
    held = [r for r in got if r.held_out and r.n_tokens < 1000]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_log_probabilities_are_normalised():
    outputs = np.concatenate([np.arange(bilinear.WORDS), bilinear.WORDS + np.arange(bilinear.GROUPS * bilinear.SIZE) // bilinear.SIZE, bilinear.WORDS + bilinear.GROUPS + np.arange(bilinear.ENDINGS) % bilinear.CLASSES])
    n = bilinear.WORDS + bilinear.GROUPS + bilinear.CLASSES
    model = bilinear.Model.initial(np.full(n, 1 / n), np.full(bilinear.GROUPS * bilinear.SIZE, 1 / bilinear.SIZE))
    model.members += np.random.default_rng(1).normal(size=model.members.shape).astype(np.float32)
    targets = np.arange(bilinear.INPUTS + bilinear.CLASSES)  # all words, and an ending of each class
    contexts = np.repeat(np.array([[3, 9, 27]]), len(targets), axis=0)
    assert np.exp(model.log_probabilities(contexts, targets, outputs)).sum() == pytest.approx(1, rel=1e-5)
    model.bias += 500 * (np.arange(n) == 7)  # far beyond single precision
    assert model.log_probabilities(contexts[:1], np.array([7]), outputs)[0] == pytest.approx(0, abs=1e-6)


def test_trained_scores_against_plain_sums(spark, prose):
    """Each token's probability term by term, from the model's own numbers; and the same model however the rows are dealt."""
    rng, text = prose
    rows = [(i, text(rng.randint(0, 80))) for i in range(120)] + [(120, None), (121, "unseen words here")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in bilinear.score(docs).collect()}
    other = {r.doc_id: r for r in bilinear.score(docs.repartition(5)).collect()}
    assert all(other[i].score == pytest.approx(got[i].score, rel=1e-5) for i in got)
    counts, known, model = bilinear.fit(docs.where(bilinear.fold("doc_id", 5) != 1).selectExpr("doc_id", "cast(coalesce(text, '') as binary) t"))
    from frametide.llm.common import Slab

    def ids(t):
        data = np.frombuffer((t or "").encode(), np.uint8)
        hashes, tail, _, is_end = bilinear.tokens(Slab(0, data, np.array([0, len(data)])))
        at = {int(k): j for j, k in enumerate(known.keys)}
        out = []
        for h, e, end in zip(hashes.tolist(), tail.tolist(), is_end.tolist(), strict=True):
            j = at.get(h, -1)
            out.append((0 if end else int(known.inputs[j]) if j >= 0 and known.inputs[j] >= 0 else bilinear.INPUTS + e, int(known.counts[j]) if j >= 0 else 0))
        return out

    softmax = lambda z: np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    for i, t in rows[::7] + rows[-2:]:
        want, before = 0.0, [0] * bilinear.ORDER
        for x, c in ids(t):
            h = sum(model.vectors[before[k]].astype(float) @ model.matrices[k] for k in range(bilinear.ORDER))
            p = softmax(model.outputs.astype(float) @ h + model.bias)
            if x < bilinear.WORDS:
                want += math.log10(p[x])
            elif x < bilinear.INPUTS:
                g, w = divmod(x - bilinear.WORDS, bilinear.SIZE)
                own = slice(g * bilinear.SIZE, (g + 1) * bilinear.SIZE)
                want += math.log10(p[bilinear.WORDS + g] * softmax(model.members[own].astype(float) @ h + model.member_bias[own])[w])
            else:
                k = (x - bilinear.INPUTS) % bilinear.CLASSES
                want += math.log10(p[bilinear.WORDS + bilinear.GROUPS + k] * (c + 0.5) / (known.class_tokens[k] + 0.5 * (known.class_words[k] + 1)))
            before = [x, *before[:-1]]
        assert got[i].score == pytest.approx(want, rel=1e-4), i


def test_scores_without_training_text(spark):
    rows = [(i, "only held out") for i in range(200) if fold(i, 5) == 1]
    got = bilinear.score(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all(r.base_score == 0 and r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in got)
    assert bilinear.score(spark.createDataFrame([], SCHEMA)).count() == 0


def test_decontamination(spark, prose):
    rng, text = prose
    items = [(k, text(rng.randint(8, 60)).capitalize() + ".") for k in range(40)] + [(40, None), (41, ""), (42, "one two"), (43, text(400)), (0, text(20))]
    rows = [(i, text(rng.randint(0, 900))) for i in range(120)]
    planted = set()
    for i in range(0, 120, 6):
        k = rng.choice(range(40))
        w = rows[i][1].split()
        at = rng.randint(0, len(w))
        rows[i] = i, " ".join([*w[:at], "***" + items[k][1].upper() + "###", *w[at:]])
        planted.add((i, k))
    rows += [(120, None), (121, ""), (122, "x " + items[43][1]), (None, items[3][1]), (0, rows[0][1])]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = decontaminate.find(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == planted | {(122, 43), (None, 3)} | {(0, k) for i, k in planted if i == 0}
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns
    gone = {i for i, _ in planted} | {122, None}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _ in rows if i not in gone)
    assert decontaminate.find(docs.limit(0), bench).count() == 0 and decontaminate.find(docs, bench.limit(0)).count() == 0


def test_index_finds_what_a_full_search_finds(prose):
    """Blocks and left-out words lose no item that reaches the threshold."""
    rng, text = prose
    items = [(k, text(rng.randint(6, 40)), None) for k in range(60)]
    index = decontaminate.Index(items)
    by_id = dict(zip(index.ids, zip(index.terms, index.impacts, strict=True), strict=True))
    for _ in range(30):
        k = rng.randrange(60)
        w = words(items[k][1])
        w = w[: rng.randint(1, len(w))] + words(text(30))
        there = np.searchsorted(index.vocabulary, np.intersect1d(decontaminate._words(" ".join(w)), index.vocabulary))
        full = {i for i, (t, x) in by_id.items() if x[np.isin(t, there)].sum() >= decontaminate.THRESHOLD}
        from frametide.llm.common import Slab

        data = np.frombuffer(" ".join(w).encode(), np.uint8)
        found = {index.ids[i] for _, i, *_ in index.search(Slab(0, data, np.array([0, len(data)])))}
        assert found <= full
        exact = {i for i in full if " ".join(words(items[i][1])) in " ".join(w)}
        assert exact <= found


@pytest.mark.parametrize("changes", [1, 2])
def test_edited_items_are_hits(prose, changes):
    """Whatever keeps four fifths of an item's five-word runs is a hit, wherever its words are changed or cut off."""
    from frametide.llm.common import Slab

    rng, text = random.Random(changes), prose[1]
    items = [(k, text(n), None) for k, n in enumerate([*range(29, 36), 47, 60, 90, 400])]
    index, around, docs, want = decontaminate.Index(items), words(text(40)), [], set()
    for k, item, _ in items:
        w = words(item)
        places = [[p] if changes == 1 else [p, rng.randrange(len(w))] for p in range(0, len(w), 1 + len(w) // 60)]
        versions = [[f"other{j}" if j in at else x for j, x in enumerate(w)] for at in places] + [w[: len(w) - c] for c in range(1, min(12, len(w) // 5))]
        for v in versions:
            doc = [*around, *v, *around]
            there = {tuple(doc[j : j + 5]) for j in range(len(doc) - 4)}
            if np.mean([tuple(w[j : j + 5]) in there for j in range(len(w) - 4)]) >= 0.8:
                want.add((len(docs), k))
            docs.append(" ".join(doc).encode())
    slab = Slab(0, np.frombuffer(b"".join(docs), np.uint8), np.cumsum([0, *map(len, docs)]))
    assert {(d, index.ids[i]) for d, i, *_ in index.search(slab)} == want and len(want) > 150


def test_several_indexes_score_alike(spark, prose, monkeypatch):
    rng, text = prose
    items = [(k, text(rng.randint(20, 50))) for k in range(40)]
    docs = spark.createDataFrame([(k, text(50) + " " + t) for k, t in items], SCHEMA)
    bench = spark.createDataFrame(items, "item_id long, text string")
    scores = lambda: {(r.doc_id, r.item_id): round(r.bm25, 9) for r in decontaminate.find(docs, bench).collect()}
    parts = lambda: [dict(zip(i.ids, (dict(zip(i.vocabulary[t].tolist(), np.round(x, 9).tolist(), strict=True)) for t, x in zip(i.terms, i.impacts, strict=True)), strict=True)) for i in decontaminate.indexes(bench)]
    whole, (impacts,) = scores(), parts()
    monkeypatch.setattr(decontaminate, "INDEX_BYTES", 3000)
    split = parts()
    assert len(split) > 1 and {i: x for p in split for i, x in p.items()} == impacts
    assert scores() == whole and len(whole) >= 40


def test_a_training_step_against_plain_sums():
    B = bilinear
    rng = np.random.default_rng(3)
    n = B.WORDS + B.GROUPS + B.CLASSES
    outputs = np.concatenate([np.arange(B.WORDS), B.WORDS + np.arange(B.GROUPS * B.SIZE) // B.SIZE, B.WORDS + B.GROUPS + np.arange(B.ENDINGS) % B.CLASSES])
    frequency, inside = rng.random(n), rng.random((B.GROUPS, B.SIZE)) ** 4
    inside[3, 5:] = 0  # a group with few words, and one with none
    inside[4] = 0
    frequency, inside = frequency / frequency.sum(), (inside / np.maximum(1e-9, inside.sum(1))[:, None]).ravel()
    words = B.Vocabulary(0, 0, np.empty(0, np.uint64), np.empty(0), np.empty(0), outputs, None, None, frequency, inside)
    model = B.Model.initial(frequency, inside)
    model.members[:] = rng.normal(0, 0.1, model.members.shape)
    tokens = rng.choice(np.concatenate([np.arange(B.WORDS + 3 * B.SIZE), np.arange(B.INPUTS, B.INPUTS + 50)]), 400)
    before = rng.integers(0, B.INPUTS + B.ENDINGS, (400, B.ORDER))
    before[:200] %= 5

    old = [x.astype(float) for x in model.parts()]
    vectors, matrices, out, bias, members, member_bias = old
    grads = [np.zeros(x.shape) for x in old]
    draw = np.random.default_rng([1])
    noise = np.minimum(np.searchsorted(np.cumsum(frequency), draw.random(B.NOISE)), n - 1)
    own = np.flatnonzero((tokens >= B.WORDS) & (tokens < B.INPUTS))
    within = np.cumsum(inside.reshape(B.GROUPS, B.SIZE), axis=1)
    within = (within / np.maximum(within[:, -1:], 1e-30) + np.arange(B.GROUPS)[:, None]).ravel()
    group = (tokens[own] - B.WORDS) // B.SIZE
    drawn = np.minimum(np.searchsorted(within, group[:, None] + draw.random((len(own), B.GROUP_NOISE)), side="right"), (group[:, None] + 1) * B.SIZE - 1)
    among = dict(zip(own.tolist(), drawn.tolist(), strict=True))
    for k, t in enumerate(tokens.tolist()):
        h = sum(vectors[before[k, j]] @ matrices[j] for j in range(B.ORDER))
        d_h = np.zeros(B.DIM)

        def meets(rows, biases, at, log_q, true, g, g_bias, h=h, d_h=d_h):
            d = 1 / (1 + np.exp(-(h @ rows[at] + biases[at] - log_q))) - true
            d_h += d * rows[at]
            g[at] += d * h
            g_bias[at] += d

        for at, true in [(outputs[t], 1), *((x, 0) for x in noise)]:
            meets(out, bias, at, math.log(B.NOISE * frequency[at]), true, grads[2], grads[3])
        if k in among:
            for at, true in [(t - B.WORDS, 1), *((x, 0) for x in among[k])]:
                meets(members, member_bias, at, math.log(B.GROUP_NOISE * max(inside[at], 1e-30)), true, grads[4], grads[5])
        for j in range(B.ORDER):
            grads[0][before[k, j]] += d_h @ matrices[j].T
            grads[1][j] += np.outer(vectors[before[k, j]], d_h)
    model.train(iter([(before, tokens)]), words, [1])
    for now, was, g in zip(model.parts(), old, grads, strict=True):
        assert np.allclose(now, was - B.RATE * g / np.sqrt(B.START + g * g), atol=2e-5)
