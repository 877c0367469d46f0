"""Benchmark decontamination: test items in a BM25 inverted index, and every training passage as a query with block-max WAND.

Scores are shares of an item's score against itself, so that one threshold holds for all items. An item's commonest words are
left out of its postings as long as they make up no more than SLACK of it; what they could add is taken off its threshold.
Items lie in blocks, and each word keeps its largest impact in each block. WAND's test is made for all passages of a slab of text
at once: only the blocks whose summed maxima reach the block's threshold are opened, and only items that reach their own are
scored in full. What passes is verified by the share of the item's five-word runs in the passage, or, where the benchmark has
answers, by the question's and the answer's shares. An item's threshold is low enough for whatever this accepts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Slab, run_hashes, slabs

K1, B = 1.2, 0.75
THRESHOLD, SLACK, BLOCK = 0.6, 0.25, 8
WIDTH, QUESTION, ANSWER = 5, 0.8, 0.5
PASSAGE = 256
#: Bytes of items in one index; a larger benchmark is searched with several indexes, one after another.
INDEX_BYTES = 1 << 25


class Counts:
    """Of the items with words: how many, their words in all, the longest one's words, and in how many each word is."""

    def __init__(self, words: list[np.ndarray]):
        self.n, self.total, self.longest = len(words), sum(map(len, words)), max(map(len, words), default=0)
        self.vocabulary, self.df = np.unique(np.concatenate([np.unique(w) for w in words]) if words else np.empty(0, np.uint64), return_counts=True)

    def add(self, other: Counts) -> None:
        self.n, self.total, self.longest = self.n + other.n, self.total + other.total, max(self.longest, other.longest)
        self.vocabulary, at = np.unique(np.concatenate([self.vocabulary, other.vocabulary]), return_inverse=True)
        self.df = np.bincount(at, np.concatenate([self.df, other.df]), len(self.vocabulary)).astype(np.int64)


class Index:
    """An inverted index of items (item_id, question, answer or None). `counts` are those of all items where these are only some."""

    def __init__(self, items: list[tuple[int, str, str | None]], counts: Counts | None = None):
        items = sorted(((i, q or "", a) for i, q, a in items), key=lambda x: (len(x[1]) + len(x[2] or ""), x[0] is None, x[0] or 0))
        self.ids, self.words, self.parts = [], [], []
        for i, question, answer in items:
            q, a = (_words(x) for x in (question, answer or ""))
            if len(q) + len(a):
                self.ids.append(i)
                self.words.append(np.concatenate([q, a]))
                self.parts.append(None if answer is None else len(q))
        n = len(self.ids)
        counts = counts or Counts(self.words)
        # an item with some words put in still lies in one passage
        self.passage = max(PASSAGE, 2 * (counts.longest + counts.longest // 4))
        own = [np.unique(w, return_counts=True) for w in self.words]
        self.vocabulary = np.unique(np.concatenate([u for u, _ in own])) if n else np.empty(0, np.uint64)
        df = counts.df[np.searchsorted(counts.vocabulary, self.vocabulary)]
        idf = np.log1p((counts.n - df + 0.5) / (df + 0.5))
        mean = counts.total / counts.n if counts.n else 1.0
        self.widths = [min(WIDTH, len(w)) for w in self.words]
        self.runs = [run_hashes(w, np.array([0, len(w)]), d)[0] for w, d in zip(self.words, self.widths, strict=True)]
        self.terms, self.impacts, terms, items_, kept = [], [], [], [], []
        self.left_out, self.least = np.zeros(n), np.full(n, THRESHOLD)
        for k, (u, tf) in enumerate(own):
            t = np.searchsorted(self.vocabulary, u)
            impact = idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(self.words[k]) / mean))
            impact /= impact.sum()
            self.terms.append(t)
            self.impacts.append(impact)
            common = np.argsort(-df[t], kind="stable")
            # of m lost runs no more than m words are lost
            lost = self._may_lose(k)
            self.least[k] = min(THRESHOLD, 1 - np.sort(impact)[::-1][:lost].sum()) - 1e-9
            drop = common[np.cumsum(impact[common]) <= min(SLACK, self.least[k] / 2)]
            self.left_out[k] = impact[drop].sum()
            stay = np.setdiff1d(np.arange(len(t)), drop)
            terms.append(t[stay])
            items_.append(np.full(len(stay), k))
            kept.append(impact[stay])
        v = len(self.vocabulary)
        term, item, impact = (np.concatenate(x) if n else np.empty(0, int) for x in (terms, items_, kept))
        order = np.lexsort((item, term))
        self.item, self.impact = item[order], impact[order].astype(float)
        self.at = np.searchsorted(term[order], np.arange(v + 1))
        self.blocks = (n + BLOCK - 1) // BLOCK
        # the largest impact of each term in each block
        key = term[order] * max(1, self.blocks) + self.item // BLOCK
        first = np.flatnonzero(np.diff(key, prepend=-1))
        self.block, self.block_max = (self.item // BLOCK)[first], np.maximum.reduceat(self.impact, first) if len(first) else np.empty(0)
        self.block_at = np.searchsorted(term[order][first], np.arange(v + 1))
        self.block_least = np.array([(self.least - self.left_out)[k * BLOCK : (k + 1) * BLOCK].min() for k in range(self.blocks)])
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.vocabulary >> np.uint64(44)] = True

    def _split(self, k: int) -> int:
        """How many of the item's runs are the question's; the others reach into the answer. Without an answer all are the question's."""
        n = len(self.runs[k])
        return n if self.parts[k] is None else min(n, max(0, self.parts[k] - self.widths[k] + 1))

    def _may_lose(self, k: int) -> int:
        """How many runs a passage that holds the item may lack."""
        split = self._split(k)
        return int((1 - QUESTION) * split + 1e-9) + int((1 - ANSWER) * (len(self.runs[k]) - split))

    def search(self, slab: Slab) -> Iterator[tuple[int, int, float, float, float | None]]:
        """(text's index, item's index, BM25 share, question's and answer's overlap): for each text and item the best passage."""
        hashes, first = slab.word_hashes(plain=True)
        if not len(self.ids) or not len(hashes):
            return
        at = np.flatnonzero(self.maybe[hashes >> np.uint64(44)])
        term = np.minimum(np.searchsorted(self.vocabulary, hashes[at]), len(self.vocabulary) - 1)
        hit = self.vocabulary[term] == hashes[at]
        at, term = at[hit], term[hit]
        # Passages are pairs of neighbouring halves; each text's halves begin anew.
        half = self.passage // 2
        halves = -(-np.diff(first) // half)
        base = np.concatenate([[0], np.cumsum(halves + 1)])
        text = np.searchsorted(first, at, side="right") - 1
        mine = base[text] + 1 + (at - first[text]) // half
        v = len(self.vocabulary)
        pair = np.unique(np.concatenate([mine * v + term, (mine - 1) * v + term]))
        passage, term = pair // v, pair % v
        p, b, x = _expand(passage, self.block_at[term], self.block_at[term + 1], self.block, self.block_max)
        key, bound = _sum(p * self.blocks + b, x)
        key = key[bound + 1e-9 >= self.block_least[key % self.blocks]]
        if not len(key):
            return
        opened = np.isin(passage, key // self.blocks)
        p, i, x = _expand(passage[opened], self.at[term[opened]], self.at[term[opened] + 1], self.item, self.impact)
        inside = np.isin(p * self.blocks + i // BLOCK, key)
        n = len(self.ids)
        key, partial = _sum(p[inside] * n + i[inside], x[inside])
        key = key[partial + 1e-9 >= (self.least - self.left_out)[key % n]]
        best: dict[tuple[int, int], tuple] = {}
        for q, i in zip((key // n).tolist(), (key % n).tolist(), strict=True):
            lo, hi = np.searchsorted(passage, [q, q + 1])
            found = np.isin(self.terms[i], term[lo:hi])
            share = float(self.impacts[i][found].sum())
            if share < self.least[i]:
                continue
            d = int(np.searchsorted(base, q, side="right")) - 1
            a = first[d] + max(0, (q - base[d] - 1) * half)
            z = min(first[d + 1], first[d] + (q - base[d] + 1) * half)
            width = self.widths[i]
            there = run_hashes(hashes[a:z], np.array([0, z - a]), width)[0] if z - a >= width else np.empty(0, np.uint64)
            known = np.isin(self.runs[i], there)
            split = self._split(i)
            question, answer = (float(y.mean()) if len(y) else 1.0 for y in (known[:split], known[split:]))
            if question >= QUESTION and answer >= ANSWER and (share, question) > best.get((d, i), (0.0, 0.0))[:2]:
                best[d, i] = share, question, None if self.parts[i] is None else answer
        for (d, i), x in best.items():
            yield d, i, *x


def _words(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return Slab(0, data, np.array([0, len(data)])).word_hashes(plain=True)[0]


def _expand(owner, lo, hi, *values):
    """Each owner with each of its values lo to hi."""
    n = hi - lo
    at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.empty(0, int)
    return np.repeat(owner, n), *(v[at] for v in values)


def _sum(key: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(key, return_inverse=True)
    return keys, np.bincount(at, x, len(keys))


def indexes(items: DataFrame, *, id: str = "item_id", question: str = "text", answer: str | None = None) -> Iterator[Index]:
    """Indexes over all items, each of about INDEX_BYTES: an item's hash says in which it is. Items alike in all columns count once."""
    rows = items.select(F.col(id).alias("i"), F.col(question).alias("q"), (F.col(answer) if answer else F.lit(None).cast("string")).alias("a")).distinct()
    total = rows.agg(F.sum(F.coalesce(F.octet_length("q"), F.lit(0)) + F.coalesce(F.octet_length("a"), F.lit(0)))).first()[0] or 0
    n = 1 + total // INDEX_BYTES
    part = lambda k: [tuple(r) for r in rows.where(F.pmod(F.xxhash64("i", "q"), F.lit(n)) == k).collect()]
    counts = None
    if n > 1:  # one rarity for a word, whatever the index
        counts = Counts([])
        for k in range(n):
            counts.add(Counts([w for w in (np.concatenate([_words(q or ""), _words(a or "")]) for _, q, a in part(k)) if len(w)]))
    for k in range(n):
        yield Index(part(k), counts)


def find(docs: DataFrame, items: DataFrame, *, id: str = "doc_id", text: str = "text", item_id: str = "item_id", question: str = "text", answer: str | None = None) -> DataFrame:
    """(doc_id, item_id, bm25, question_overlap, answer_overlap) for each document and each item that it holds.

    A document holds an item without an answer if a passage has QUESTION of all its five-word runs (answer_overlap is null), one with an
    answer if it has QUESTION of the question's and ANSWER of those that reach into the answer.
    Whole texts are searched in overlapping passages of at least twice the longest item. Null and empty texts and items hold
    nothing. Repeated document rows give one row for each item; an empty table gives no rows. Other columns do not matter.
    """
    out = None
    for index in indexes(items, id=item_id, question=question, answer=answer):

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0)
                found = [(slab.lo + d, *x) for slab in slabs(batch.column(1)) for d, *x in index.search(slab)]
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array([x[0] for x in found], pa.int64())), pa.array([index.ids[x[1]] for x in found], pa.int64()), *(pa.array([x[k] for x in found], pa.float64()) for k in (2, 3, 4))],
                    ["doc_id", "item_id", "bm25", "question_overlap", "answer_overlap"],
                )

        hits = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("t")).mapInArrow(run, "doc_id long, item_id long, bm25 double, question_overlap double, answer_overlap double")
        out = hits if out is None else out.unionByName(hits)
    return out.groupBy("doc_id", "item_id").agg(F.max("bm25").alias("bm25"), F.max("question_overlap").alias("question_overlap"), F.max("answer_overlap").alias("answer_overlap"))


def clean(docs: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id", question: str = "text", answer: str | None = None) -> DataFrame:
    """The rows of docs that hold no item, with all their columns, in one pass over docs for each index. The text's column is found in
    whatever case it is written, as Spark finds columns; a name that no column has raises ValueError."""
    place = [c.lower() for c in docs.columns].index(text.lower())
    for index in indexes(items, id=item_id, question=question, answer=answer):

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for slab in slabs(batch.column(place)):
                    for d, *_ in index.search(slab):
                        keep[slab.lo + d] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
