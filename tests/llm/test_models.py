"""Quality, toxicity and language-model scores: exact parts against brute force, learned parts by held-out accuracy."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import ALNUM, SPACE, documents, fold, low, texts
from pyspark.sql import functions as F

from lectern.llm import ngrams, quality, toxicity

DATA = "/root/testdata/sf0.01"


def read(spark, name):
    return spark.read.parquet(f"{DATA}/{name}.parquet")


def auc(score, y):
    order = np.argsort(np.argsort(score, kind="stable"), kind="stable") + 1
    pos = y > 0
    return (order[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_quality_held_out(spark):
    model = quality.train(read(spark, "documents"), read(spark, "labels"))
    got = quality.score(read(spark, "documents"), model)
    assert got.count() == 1000 and got.filter("score < 0 or score > 1 or score is null").count() == 0
    rows = got.filter("held_out").join(read(spark, "labels"), "doc_id").toPandas()
    assert len(rows) > 40 and auc(rows["score"].to_numpy(), rows["quality"].to_numpy()) > 0.95
    assert all(fold(r["doc_id"], 5) == 0 for r in got.filter("held_out").collect())
    again = quality.train(read(spark, "documents").repartition(5), read(spark, "labels").repartition(3))
    assert all((a == b).all() for a, b in zip(model.tables, again.tables, strict=True))


def test_quality_learns_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.uniform(-1, 1, (3000, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    model = quality.fit(x, y, rounds=20, pair_rounds=60)
    assert model.pairs[0] == (1, 0) and auc(model.score(x), y) > 0.95


def test_quality_corner_cases(spark):
    docs = documents(spark, [(1, None), (2, ""), (2, ""), (3, "w " * 60_000), (None, "a"), (5, "!!!")])
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 0), (3, None, None), (3, 0, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    for given in (labels, labels.limit(0), labels.filter("doc_id = 1")):
        got = quality.score(docs, quality.train(docs, given)).collect()
        assert len(got) == 6 and all(0 <= r["score"] <= 1 for r in got)
        assert len({r["score"] for r in got if r["doc_id"] in (1, 2)}) == 1
    assert quality.score(docs.limit(0), quality.train(docs.limit(0), labels)).count() == 0


def brute_features(text):
    """The features by their definitions, over bytes, words and lines of one text."""
    data = (text or "").encode()
    words, lines = SPACE.findall(text or ""), [x for x in (text or "").split("\n") if x]
    n, size = max(len(words), 1), max(len(data), 1)
    share = lambda chars: sum(b in chars for b in data) / size
    stop, mark = b".,;:'\"-()", b"!?"
    known = {*range(65, 91), *range(97, 123), *range(48, 58), *b" \t\r\x0b\x0c\n", *stop, *mark, *range(128, 256)}
    folded = [low(w) for w in words]
    grams = list(zip(folded, folded[1:], folded[2:], strict=False))
    of = lambda test: sum(map(test, words)) / n
    return [
        math.log1p(len(data)), math.log1p(len(words)), sum(b not in b" \t\r\x0b\x0c\n" for b in data) / n, share(range(65, 91)), share(range(48, 58)), share(b"\n"), share(stop), share(mark),
        sum(b not in known for b in data) / size, share(range(128, 256)), len(set(folded)) / n, max(Counter(folded).values(), default=0) / n, 1 - len(set(grams)) / len(grams) if grams else 0,
        1 - len(set(lines)) / max(len(lines), 1) if words else 0, len(words) / max(len(lines), 1), of(lambda w: len(w.encode()) >= 12), of(lambda w: len(w.encode()) <= 2), of(lambda w: sum("A" <= c <= "Z" for c in w) >= 2),
    ]


def test_quality_equals_its_brute_force_version(spark):
    """The registered query's scores from features by their definitions and a walk through tables and grids."""
    docs, labels = read(spark, "documents"), read(spark, "labels")
    odd = documents(spark, [(-i, t) for i, t in enumerate(texts(40), 1)], extra=False).select(*docs.columns)
    model = quality.train(docs, labels)
    assert model.pairs and any(t.any() for t in model.tables) and any(g.any() for g in model.grids)
    every = docs.unionByName(odd)
    given = {r["doc_id"]: r["text"] for r in every.collect()}
    got = {r["doc_id"]: (r["score"], r["predicted"]) for r in quality.score(every, model).collect()}
    assert got.keys() == given.keys() and len(got) > 1000
    place = lambda edges, x: sum(e <= x for e in edges)
    for i, text in given.items():
        x = brute_features(text)
        total = model.base + sum(t[place(model.edges[f], x[f])] for f, t in enumerate(model.tables))
        total += sum(g[place(model.pair_edges[a], x[a]), place(model.pair_edges[b], x[b])] for (a, b), g in zip(model.pairs, model.grids, strict=True))
        want = 1 / (1 + math.exp(-min(max(total, -30), 30)))
        assert got[i][0] == pytest.approx(want, abs=1e-9) and got[i][1] == (got[i][0] >= 0.3), (i, x)


def test_features_of_each_text_stand_alone():
    found = texts(40)
    whole = quality.features(pa.array(found))
    assert all((quality.features(pa.array([t], pa.string())) == whole[i]).all() for i, t in enumerate(found))


def test_toxicity_held_out(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.train(docs, labels)
    rows = toxicity.score(docs, model).filter("held_out").join(labels, "doc_id").toPandas()
    y = rows["toxic"].to_numpy()
    assert ((rows["predicted"] == 1) & (y == 1)).sum() >= 0.85 * y.sum() and ((rows["predicted"] == 1) & (y == 0)).sum() <= 0.01 * (y == 0).sum()


def build(model, ids, examples):
    order = np.argsort(ids)
    own = [examples[i] for i in order]
    model.build(ids[order], (ids[order] % 3 == 0).astype(float), np.array([len(t) for t, _ in own]), np.concatenate([t for t, _ in own]), np.concatenate([w for _, w in own]))


@pytest.mark.parametrize(("block", "heavy"), [(8, 0), (8, 4), (4, 60), (64, 20), (500, 3)])
def test_nearest_examples_are_exact(block, heavy):
    rng = np.random.default_rng(8)
    terms = np.sort(rng.integers(1, 1 << 60, 60).astype(np.uint64))
    model = toxicity.NearestModel(terms, rng.uniform(0.5, 3, 60), block=block, k=5, rate=0.3, heavy=heavy)

    def vector():
        t = np.sort(np.unique(np.minimum(rng.geometric(0.06, 12) - 1, 59)))
        w = rng.uniform(0.1, 2, len(t))
        return t, w / np.linalg.norm(w)

    examples = [vector() for _ in range(200)]
    ids = rng.permutation(200)
    build(model, ids, examples)
    dense = lambda v: np.bincount(v[0], v[1], 60)
    matrix = {int(i): dense(v) for i, v in zip(ids, examples, strict=True)}
    for skipping in (False, True):
        texts, skip = [vector() for _ in range(150)], [int(x) for x in rng.choice(ids, 150)]
        for q, own, (i, s) in zip(texts, skip, model.nearest(texts, skip if skipping else None), strict=True):
            score = {k: float(m @ dense(q)) for k, m in matrix.items() if not (skipping and k == own)}
            want = sorted((-x, k) for k, x in score.items() if x > 0)[:5]
            assert np.allclose(s, [-w for w, _ in want], atol=2e-6)
            # equal to six digits, ties may stand in another order
            assert all(abs(score[int(model.ids[j])] - x) < 2e-6 for j, x in zip(i, s, strict=True)) and len(set(i.tolist())) == len(want)


def test_blocks_out_of_reach_stay_closed():
    """Examples of eight vocabularies: a text opens the blocks of its own, and those alone."""
    rng = np.random.default_rng(3)
    terms = np.arange(1, 801).astype(np.uint64)
    model = toxicity.NearestModel(terms, np.ones(800), block=16, k=5, heavy=200)

    def vector(g):
        t = np.sort(rng.choice(100, 30, replace=False)) + 100 * g
        return t, np.full(30, 30**-0.5)

    build(model, np.arange(512), [vector(i % 8) for i in range(512)])
    texts = [vector(i % 8) for i in range(64)]
    found, opened, every = model.search(texts)
    assert opened <= every <= 64 * (512 // 16) and opened < 64 * 32 / 4
    assert all({int(model.ids[j]) % 8 for j in i} == {n % 8} for n, (i, _) in enumerate(found))


def brute_toxicity(docs, labels, k=15, significance=3.5):
    """Scores by plain loops: string terms, counted frequencies, all cosines, pooled adjacent violators."""


    def words(text):
        out = Counter()
        for w in ALNUM.findall(low(text)):
            raw = w.encode()
            out.update([raw, *((n, raw[:n]) for n in toxicity.PREFIXES if len(raw) > n)])
        return out

    found = {i: words(t) for i, t in docs}
    fitted = [i for i in found if labels.get(i) is not None and fold(i, 3) != 1]
    known = {t for i in fitted for t in found[i]}
    seen = Counter(t for c in found.values() for t in c)
    pos, n = sum(labels[i] for i in fitted), len(fitted)
    idf = {}
    for t in known:
        n1 = sum(labels[i] for i in fitted if t in found[i])
        both = sum(t in found[i] for i in fitted)
        n0 = both - n1
        chi = n * (n1 * (n - pos) - n0 * pos) ** 2 / (both * max(n - both, 1) * pos * (n - pos))
        evidence = 0 if both < 3 else min(1, chi / (significance * math.log2(n)))
        idf[t] = math.log1p(len(docs) / seen[t]) * (0.5 + 0.5 * evidence)

    def vector(c):
        v = {t: (1 + math.log(f)) * idf[t] for t, f in c.items() if t in known}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / size for t, x in v.items()}

    examples = {i: vector(found[i]) for i in fitted}

    def vote(v, skip=None):
        near = sorted((-round(sum(x * e.get(t, 0) for t, x in v.items()), 6), i) for i, e in examples.items() if i != skip)[:k]
        near = [(-s, i) for s, i in near if s < 0]
        weight = [s / (1 + math.sqrt(max(2 - 2 * s, 0))) ** 2 for s, _ in near]
        return (sum(w * labels[i] for w, (_, i) in zip(weight, near, strict=True)) + 0.5 * pos / n) / (sum(weight) + 0.5)

    pools = []
    for v, y in sorted((vote(examples[i], i), labels[i]) for i in fitted):
        pools.append([v, y, 1])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            _, y1, c1 = pools.pop()
            pools[-1][1] += y1
            pools[-1][2] += c1
    knots, values = [p[0] for p in pools] + [1.0], [p[1] / p[2] for p in pools]
    return {i: float(np.interp(vote(vector(c)), knots, [*values, values[-1]])) for i, c in found.items() if set(c) & known}


def test_toxicity_equals_its_brute_force_version(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdé") for _ in range(rng.randint(2, 9))) for _ in range(120)]
    toxic = {i: int(i % 5 == 0) for i in range(160) if i % 11}
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(5, 40))) + (" vile Viley rotten" if i % 5 == 0 and i % 3 else "")) for i in range(160)]
    labels = spark.createDataFrame([(i, 1, y) for i, y in toxic.items()], "doc_id long, quality int, toxic int")
    df = documents(spark, docs)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(df, toxicity.train(df, labels)).collect()}
    want = brute_toxicity(docs, toxic)
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], abs=1e-4) for i in want)
    assert len({round(x, 3) for x in want.values()}) > 5


def test_toxicity_searches_all_terms(spark):
    rng = np.random.default_rng(2)
    text = lambda: " ".join(f"w{x}" for x in rng.integers(0, 5000, 30))
    docs = [(i, text() + (" bad awful" if i % 4 == 0 else "")) for i in range(120)]
    # neither holds a term of clear evidence: the first is a copy of a toxic example of words of its own, the second of another
    given = [i for i in range(120) if fold(i, 3) != 1][:2]
    docs = [(i, f"quite unseen words number {i} stand only here {text()}" if i in given else t) for i, t in docs] + [(900 + k, None) for k in range(2)]
    docs += [(1000 + k, docs[i][1]) for k, i in enumerate(given)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0 or i in given)) for i in range(120)], "doc_id long, quality int, toxic int")
    model = toxicity.train(documents(spark, docs), labels)
    assert set(model.ids.tolist()) == {i for i in range(120) if fold(i, 3) != 1}
    got = {r["doc_id"]: r for r in toxicity.score(documents(spark, docs), model).collect()}
    for k, i in enumerate(given):
        best = got[1000 + k]["evidence"][0]
        assert best["doc_id"] == i and best["toxic"] == 1 and best["similarity"] == pytest.approx(1)
    assert all(r["evidence"] for r in got.values() if r["doc_id"] < 900 or r["doc_id"] >= 1000) and not got[900]["evidence"]


def test_toxicity_corner_cases(spark):
    docs = documents(spark, [(i, ("bad awful" if i % 2 else "fine nice") + f" word{i % 5}") for i in range(80)] + [(900, None), (901, ""), (3, "bad awful word3"), (None, "bad")])
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(80)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels, significance=0.5)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[900]["evidence"] == [] and got[900]["score"] == got[901]["score"]
    for given in (labels.limit(0), labels.filter("toxic = 0")):
        assert {r["score"] for r in toxicity.score(docs, toxicity.train(docs, given)).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_isotonic_rises():
    x, y = np.array([1.0, 2, 3, 4, 5]), np.array([0.0, 1, 0, 1, 1])
    knots, values = toxicity.isotonic(x, y)
    assert (np.diff(values) >= 0).all() and values.tolist() == [0.0, 0.5, 1.0] and knots.tolist() == [1.0, 2.0, 4.0]


@pytest.mark.parametrize(("block", "tokens"), [(6 << 20, 3_000_000), (700, 200)])
def test_lm_scores(spark, block, tokens):
    found = texts(120, seed=11)
    rows = list(enumerate(found)) + [(3, found[3]), (None, found[30])]
    got = ngrams.score(documents(spark, rows), block_bytes=block, range_tokens=tokens).collect()
    assert len(got) == len(rows)
    held, tuned = (lambda i: fold(i, 5) == 1), (lambda i: fold(i, 5) == 2)
    split = lambda t: [*SPACE.findall(low(t)), None]
    before = lambda w: list(zip([None, None, *w], [None, *w], w, strict=False))

    class Counts:
        def __init__(self, own):
            self.one, self.two, self.three, self.texts = Counter(), Counter(), Counter(), 0
            for t in own:
                w = split(t)
                self.texts += 1
                self.one.update(w)
                self.two.update(x[1:] for x in before(w))
                self.three.update(before(w))
            self.n, self.v = sum(self.one.values()), len(self.one)

        def estimates(self, w):
            for k, (u, v, x) in enumerate(before(w)):
                c1 = self.one[v] if k else self.texts
                c2 = self.two[u, v] if k else self.texts
                bucket = ngrams.BUCKETS + int(math.log2(c2)) + 1 if c2 else int(math.log2(c1)) + 1 if c1 else 0
                yield x, bucket, (self.three[u, v, x] / max(c2, 1), self.two[v, x] / max(c1, 1), self.one[x] / max(self.n, 1))

    every, apart = Counts([t for i, t in rows if not held(i)]), Counts([t for i, t in rows if not held(i) and not tuned(i)])
    seen = Counter()
    for i, t in rows:
        if tuned(i):
            for _, bucket, p in apart.estimates(split(t)):
                seen[int(ngrams.histogram_keys(np.array([bucket]), [np.array([x]) for x in p])[0])] += 1
    keys = sorted(seen)
    weights = ngrams.learn(np.array(keys), np.array([float(seen[k]) for k in keys]), apart.v)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], r)
    for i, t in rows:
        w, r = split(t), by[i]
        base = sum(math.log10((every.one[x] + 0.5) / (every.n + 0.5 * (every.v + 1))) for x in w)
        full = sum(math.log10(float(weights[b] @ np.array([*p, 1 / (every.v + 1)]))) for _, b, p in every.estimates(w))
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(i), len(w), sum(every.one[x] > 0 for x in w), every.n)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and math.isclose(r["score"], full, rel_tol=1e-6), i


def test_lm_beats_its_base_on_held_out_texts(spark):
    r = ngrams.score(read(spark, "documents")).filter("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r["s"] > r["b"]
    assert ngrams.score(documents(spark, [(1, "a")]).limit(0)).count() == 0
    assert ngrams.score(documents(spark, [(i, "only held out") for i in range(40) if fold(i, 5) == 1])).filter("n_known > 0 or score >= 0").count() == 0


def test_em_finds_the_mixture():
    rng = np.random.default_rng(0)
    w = np.array([0.1, 0.2, 0.3, 0.4])
    rows = np.zeros((4000, 3))
    for k in range(4000):
        # outcomes that are possible under one component only (and, as always, under the uniform one, which is tiny here)
        c = rng.choice(4, p=w)
        if c < 3:
            rows[k, c] = 1.0
    keys, times = np.unique(ngrams.histogram_keys(np.full(4000, 43), list(rows.T)), return_counts=True)
    got = ngrams.learn(keys, times.astype(float), 10**9)[43]
    assert np.abs(got - w).max() < 0.05 and got.sum() == pytest.approx(1)
