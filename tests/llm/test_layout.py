import base64
import hashlib
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from frametide.llm import lattice, mixing, queries, sharding, warc

from .brute import components, words

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def documents(spark):
    texts = [" ".join(["word"] * (k % 17)) for k in range(200)]
    rows = [(k, t, f"s{k % 5}") for k, t in enumerate(texts)]
    rows += [(200, None, "s1"), (201, "", None), (202, "a\x0bb c\xa0d", None), (7, texts[7], "s2"), (7, texts[7], "s2"), (None, "x y", "s0"), (203, "long " * 5000, "s4"), (204, "", "empty")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash")).withColumn("row", F.lit(1)).withColumn("target", F.lit(2))


def test_mixing(spark):
    docs = documents(spark)
    got = mixing.mix(docs)
    rows = got.collect()
    assert len(rows) == docs.count()
    by = {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size
        by.setdefault(r.source, []).append(r)
    total = sum(r.size for r in rows)
    level = {s: (rs[0].source_size, rs[0].target, sum(r.taken for r in rs)) for s, rs in by.items()}
    assert total == sum(x[0] for x in level.values()) == pytest.approx(sum(x[1] for x in level.values()))
    for s, (size, target, taken) in level.items():
        assert size == sum(r.size for r in by[s]) and target <= 3 * size + 1e-9 and taken == round(target)
    # the targets by cutting and sharing out again, as often as needed
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(level, key=lambda s: (s is None, s)))}
    goal, full = {}, set()
    while True:
        rest = total - sum(3 * level[s][0] for s in full)
        goal = {s: 3.0 * level[s][0] if s in full else rest * weight[s] / sum(weight[x] for x in level if x not in full) for s in level}
        above = {s for s in level if s not in full and goal[s] > 3 * level[s][0] + 1e-9}
        if not above:
            break
        full |= above
    assert {s: pytest.approx(x[1]) for s, x in level.items()} == goal
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixing_has_no_python(spark):
    plan = mixing.repeated(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_mixed_rows(spark):
    docs = documents(spark)
    out = mixing.repeated(docs)
    assert out.columns == docs.columns
    whole = {(r.doc_id, r.source): r.taken // r["size"] for r in mixing.mix(docs, whole=True).where("size > 0 and doc_id <> 7").collect()}
    got = {(r.doc_id, r.source): r["count"] for r in out.where("doc_id <> 7").groupBy("doc_id", "source").count().collect()}
    assert got == {k: v for k, v in whole.items() if v}


def test_sharding(spark):
    docs = documents(spark)
    rows = sharding.shard(docs, shards=6).collect()
    sizes = sorted(len((r.text or "").encode()) + 8 for r in docs.collect())
    assert sorted(r.size for r in rows) == sizes
    ordered = sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text_crc32, r.size))
    assert [r.shard for r in ordered] == sorted(r.shard for r in rows)
    for s in range(6):
        own = [r for r in rows if r.shard == s]
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert abs(sum(r.size for r in own) - sum(sizes) / 6) <= max(sizes)
    kept = sharding.shard(docs, keep=True).select("row.*")
    assert kept.columns == docs.columns and kept.count() == len(rows)
    assert sharding.shard(docs.limit(0)).count() == 0
    few = sharding.shard(docs.limit(2)).collect()
    assert len(few) == 2 and all(0 <= r.shard < 24 for r in few)


def test_warc(spark):
    rows = [(k, f"http://e.org/{k}\r\nWARC-Type: fake", f"<p>{k % 7}é</p>" * (k % 11)) for k in range(60)]
    rows += [(60, None, None), (61, "u", ""), (62, "u", "x" * 300_000), (63, "u", "x" * 300_000), (5, "u", rows[5][2]), (None, "u", rows[3][2]), (None, "u", "alone")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha1", F.lit(1)).withColumn("id", F.lit(2)).withColumn("first", F.lit(3))
    raw = [(i, (h or "").encode()) for i, _, h in rows]
    first = {}
    for i, b in raw:
        if i is not None:
            first[b] = min(first.get(b, i), i)
    digest = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()
    want = [(i, len(b), digest(b), *(("response", None) if first.get(b, i) == i else ("revisit", first[b]))) for i, b in raw]
    got = warc.round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert warc.round_trip(pages.limit(0)).count() == 0
    small = warc.round_trip(pages, min_bytes=10**9)
    assert small.where("record_type = 'revisit'").count() == 0


def test_warc_chunks(spark):
    from frametide.llm.common import new_path

    body = "".join(chr(0x20 + k % 2000) for k in range(100_000))
    pages = spark.createDataFrame([(1, "u", body), (2, "u", "small"), (2, "u", "other")], "page_id long, url string, html string")
    rows = warc.chunk_rows(pages, chunk=1000).orderBy("record", "chunk_no").collect()
    raw = body.encode()
    assert all(bytes(r.sha1) == hashlib.sha1(raw[: r.bytes]).digest() and r.bytes == min(len(raw), 1000 * (r.chunk_no + 1)) for r in rows if r.id == 1)
    manifest = warc.write(warc.records(warc.chunk_rows(pages, chunk=1000)), new_path(spark, "w"), file_bytes=10)
    assert manifest.count() >= 1
    chunks = warc.read(manifest, chunk=4096).where("record_id like '1:%'").orderBy("chunk_no").collect()
    assert len(chunks) > 10 and b"".join(bytes(c.data) for c in chunks).decode() == body
    assert chunks[-1].digest_so_far == chunks[-1].declared_digest and [c.is_last for c in chunks].count(True) == 1
    assert warc.read(manifest, data=False).select("record_id").distinct().count() == 3  # names do not repeat though ids do


def vectors(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(300, 16))
    rows = [(k, v.tolist(), int(k % 3)) for k, v in enumerate(base)]
    for k in range(0, 60, 2):  # pairs just above and far below the threshold
        a = base[k] / np.linalg.norm(base[k])
        n = rng.normal(size=16)
        n -= (n @ a) * a
        n /= np.linalg.norm(n)
        for cos in (0.931, 0.97, 0.9):
            rows.append((len(rows), (5 * (cos * a + np.sqrt(1 - cos * cos) * n)).tolist(), int(k % 3)))
    hub = rng.normal(size=16)
    rows += [(len(rows) + k, (hub + rng.normal(size=16) * 0.02).tolist(), 1) for k in range(150)]
    rows += [(len(rows) + k, hub.tolist(), 1) for k in range(20)]
    n = len(rows)
    return rows + [(n, None, 1), (n + 1, [0.0] * 16, 1), (n + 2, [float("nan")] * 16, 1), (n + 3, [None] * 16, 1), (n + 4, hub.tolist(), None), (n + 5, hub.tolist(), 2), (n + 6, [], 1), (n + 7, hub[:8].tolist(), 1), (n + 8, (hub * 1e300).tolist(), 1), (n + 9, [float("inf")] * 16, 1)]


@pytest.mark.parametrize(("block", "plan"), [(1024, 0), (16, 1)])
def test_lattice(spark, monkeypatch, block, plan):
    monkeypatch.setattr(lattice, "BLOCK", block)
    monkeypatch.setattr(lattice, "plan_for", lambda n: lattice.PLANS[plan][1])
    rows = vectors(spark)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("id", F.lit(1)).withColumn("v", F.lit(2)).withColumn("n", F.lit(3))
    got = {r.vec_id: r for r in lattice.classes(df).collect()}
    good = {}
    for i, v, label in rows:
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v) / np.abs(v).max()
            good.setdefault((label, len(v)), []).append((i, x / np.linalg.norm(x)))
    links = []
    for group in good.values():
        ids, m = [i for i, _ in group], np.stack([x for _, x in group])
        links += [(ids[a], ids[b]) for a, b in zip(*np.nonzero(np.triu(m @ m.T >= 0.93, 1)), strict=True)]
    count = {i: 0 for i, _, _ in rows}
    for a, b in links:
        count[a] += 1
        count[b] += 1
    found = sum(r.n_links for r in got.values())
    assert all(got[i].n_links <= count[i] for i in count) and found >= 0.99 * sum(count.values())
    near = range(300, 390)  # the pairs around the threshold, apart from the large group
    assert sum(got[i].n_links for i in near) >= 0.95 * sum(count[i] for i in near) > 0
    if found == sum(count.values()):
        want = components(count, links)
        assert {i: r.component_id for i, r in got.items()} == want and all(r.kept == (want[i] == i) for i, r in got.items())
    assert lattice.classes(df.limit(0)).count() == 0


@pytest.mark.parametrize("plan", [p for _, p in lattice.PLANS])
@pytest.mark.parametrize("dim", [2, 7, 8, 16, 32, 64, 384, 768])
def test_pairs_near_the_threshold_meet(dim, plan):
    """Nearly all pairs at the threshold meet, and few unrelated ones where there are dimensions enough."""
    rng = np.random.default_rng(dim)
    a, b = rng.normal(size=(2, 1000, dim))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b -= (b * a).sum(1)[:, None] * a
    b = 0.931 * a + np.sqrt(1 - 0.931**2) * b / np.linalg.norm(b, axis=1)[:, None]
    x, y = lattice.cells(a, plan), lattice.cells(b, plan)
    meet = lambda x, y: ((x == y[:, :, :1]) | (y == x[:, :, :1])).any((1, 2)).mean()
    assert meet(x, y) >= 0.99
    if dim >= 64 and plan.points > 1:
        assert np.mean([meet(x, np.roll(x, k, 0)) for k in range(1, 12)]) < 0.01


def test_e8_points_are_nearest():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 8)) * 2
    c = lattice.decode(x)
    assert ((c * 2) % 1 == 0).all() and (np.rint(c.sum(1)) % 2 == 0).all()
    far = ((x - c) ** 2).sum(1)
    assert all((((x - (c + r)) ** 2).sum(1) >= far - 1e-9).all() for r in lattice.ROOTS)
    assert len({tuple(r) for r in lattice.ROOTS}) == 240


def test_sharding_same_as_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    key = lambda df: sorted(tuple(r) for r in df[["doc_id", "size", "text_crc32", "law", "shard", "slot"]].itertuples(index=False))
    assert key(queries.op6_sharding(spark, DATA).toPandas()) == key(con.sql(queries.OP6_SQL).df())


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from types import SimpleNamespace

    from frametide.llm.common import shared_dir

    session = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, setCheckpointDir=lambda _: None, master=master))
    with pytest.raises(ValueError):
        shared_dir(session("spark://host:7077"))
    assert shared_dir(session("local[4]")).startswith("file://")


def test_mixing_same_as_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    key = lambda df: sorted(tuple(round(float(x), 6) for x in r) for r in df[["doc_id", "size", "source_size", "target", "taken"]].itertuples(index=False))
    assert key(queries.op8_mixing(spark, DATA).toPandas()) == key(con.sql(queries.OP8_SQL).df())


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_queries_have_rows(spark, name):
    df = queries.queries()[name](spark, DATA)
    assert df.count() > 0
    assert len(set(df.columns)) == len(df.columns)


def test_words_agree(spark):
    rows = [("a  b\tc\n",), ("\xa0x\x0b\x0cy",), ("",), (None,)]
    got = spark.createDataFrame(rows, "t string").select(mixing.words("t").alias("n")).collect()
    assert [r.n for r in got] == [len(words(t)) for (t,) in rows]
