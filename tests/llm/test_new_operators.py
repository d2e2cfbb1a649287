"""Periodic runs, whitening and toxicity against brute force, numpy and held-out rows; odd tables, ties and repeats."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_llm import ODD, PROSE, odd
from tidewake.llm import period_runs, toxicity, whitening
from tidewake.llm.common import table
from tidewake.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
VECS = "vec_id long, embedding array<float>, label int"

# 11 --------------------------------------------------------------------------------------------------------------


def naive_runs(w, times=4, least=6):
    out = []
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            s = w[i : j + q]
            if j > i and len(s) >= max(least, times * q) and not any(s[p:] == s[:-p] for p in range(1, q)):
                out.append((i, len(s), q))
            i = max(j, i) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def naive_row(w):
    runs = naive_runs(w)
    drop = {k for s, n, q in runs for k in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return len(runs), *top, digest("".join("%d,%d,%d\n" % r for r in runs)), digest(" ".join(x for k, x in enumerate(w) if k not in drop))


def planted(i, words):
    h = zlib.crc32(str(i).encode())
    g, n = h // 10, len(words)
    if i is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [x if k < a else words[a + (k - a) % p] for k, x in enumerate(words)]


def some_words(rng):
    letters, n, w = "abcde"[: rng.choice([1, 2, 3, 5])], rng.randrange(70), []
    while len(w) < n:
        unit = [rng.choice(letters) for _ in range(rng.randrange(1, 8))]
        w += unit * rng.choice([1, 1, 2, 4, 5, 6]) + unit[: rng.randrange(len(unit))]
    return w[:n]


def test_runs_of_groups_of_texts():
    rng = random.Random(4)
    for _ in range(150):
        texts = [some_words(rng) for _ in range(rng.randrange(1, 8))]
        found = period_runs.texts_runs([[x.encode() for x in w] for w in texts])
        assert [[tuple(r) for r in x.tolist()] for x in found] == [naive_runs(w) for w in texts]
    fib = ["a", "ab"]
    while len(fib[-1]) < 60:
        fib.append(fib[-1] + fib[-2])
    for s in ("a" * 50, "ab" * 30, fib[-1], "a" * 5, "a" * 6, "abababab", "abc" * 4, "abc" * 3 + "ab", "xabababababy"):
        assert [tuple(r) for r in period_runs.texts_runs([[c.encode() for c in s]])[0].tolist()] == naive_runs(list(s)), s


def test_wavelet_matrix_answers_like_sorting():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 17, 64, 100):
        x = rng.permutation(n)
        lo = rng.integers(0, n, 200)
        hi = lo + 1 + rng.integers(0, n, 200) % (n - lo)
        k, v, tree = rng.integers(0, n, 200) % (hi - lo), rng.integers(0, n, 200), period_runs.Wavelet(x)
        assert tree.smaller(lo, hi, v).tolist() == [int((x[a:b] < c).sum()) for a, b, c in zip(lo, hi, v, strict=True)]
        assert tree.smallest(lo, hi, k).tolist() == [int(np.sort(x[a:b])[c]) for a, b, c in zip(lo, hi, k, strict=True)]


def test_runs_query_against_brute_force(spark, sf_dir):
    text = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    got = QUERIES["op11_period_runs"](spark, sf_dir).collect()
    assert len(got) == len(text)
    checked = 0
    for r in got:
        words = planted(r.doc_id, WORD.findall(text[r.doc_id] or ""))
        if len(words) <= 500:
            checked += 1
            assert tuple(r)[1:] == naive_row(words), r.doc_id
    assert checked > 100 and sum(r.n_runs for r in got) > 20


def test_runs_of_odd_texts(spark):
    x = odd(spark, True).union(odd(spark, True).where("doc_id = 8"))
    got = period_runs.period_runs(x).select("text", "_runs.*").collect()
    assert len(got) == len(ODD) + 3
    for r in got:
        words = WORD.findall(r.text or "")
        assert r.n_words == len(words) and (r.n_words > 600 or (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) == naive_row(words))
        assert hashlib.sha256(r.collapsed.encode()).hexdigest() == r.collapsed_sha256
    nine = next(r for r in got if r.text == "\n".join([PROSE] * 9))
    assert nine.collapsed == PROSE and [tuple(x) for x in nine.runs] == [(0, 9 * len(PROSE.split()), len(PROSE.split()))]
    assert period_runs.period_runs(x.limit(0)).count() == 0
    with pytest.raises(ValueError):
        period_runs.period_runs(x.withColumn("_RUNS", F.lit(1)))
    # a very long text of one period, and one without any repeat
    long = spark.createDataFrame([("w " * 200_000,), (" ".join(f"w{i}" for i in range(100_000)),)], "text string")
    assert [(r.n_runs, r.length) for r in period_runs.period_runs(long, collapsed=False).select("_runs.*").collect()] == [(1, 200_000), (0, None)]


# 12 --------------------------------------------------------------------------------------------------------------


def naive_white(vectors):
    """vectors -> (n, sums, eigenvalues, axes as rows, trace) of the distinct whole-number vectors."""
    x = np.unique(np.floor(np.array(vectors, np.float64) * 256).astype(np.int64), axis=0)
    c = x - x.mean(0)
    e, v = np.linalg.eigh(c.T @ c / len(x))
    return len(x), x.sum(0), e[::-1], v.T[::-1], e.sum()


def test_whitening_query_against_numpy(spark, sf_dir):
    rows = {r.vec_id: r.embedding for r in table(spark, sf_dir, "embeddings").collect()}
    got = QUERIES["op12_embedding_whitening"](spark, sf_dir).toPandas()
    n, sums, e, axes, trace = naive_white([v for v in rows.values() if v is not None])
    assert len(got) == 4 * len(rows) and (got.n == n).all() and got.identity_error.max() < 1e-9 and set(got.component) == {1, 2, 3, 4}
    for k, some in got.groupby("component"):
        x = np.floor(np.array([rows[i] for i in some.vec_id], np.float64) * 256)
        want = (x - sums / n) @ axes[k - 1] / np.sqrt(e[k - 1])
        sign = np.sign(want @ some.whitened.to_numpy())
        assert np.abs(sign * want - some.whitened.to_numpy()).max() < 1e-7
        assert np.abs(some.explained / (e[k - 1] / trace) - 1).max() < 1e-12
    for r in got[got.component == 1].itertuples():
        assert r.deviation == sum((n * int(np.floor(np.float64(v) * 256)) - int(s)) ** 2 for v, s in zip(rows[r.vec_id], sums))


def test_solver_on_hard_matrices():
    rng = np.random.default_rng(0)
    for d in (1, 2, 3, 5, 8, 16, 40):
        p, q = (np.linalg.qr(rng.normal(size=(d, d)))[0] for _ in range(2))
        half = np.r_[np.full((d + 1) // 2, 3.0), np.ones(d // 2)]
        spectra = [half, np.ones(d), 1 + 1e-9 * np.arange(d), 1 + 1e-5 * np.arange(d), 10.0 ** -np.arange(d), np.r_[1.0, np.zeros(d - 1)]]
        for r in [np.eye(d), np.diag(np.arange(1.0, d + 1)), rng.normal(size=(d, d)), np.zeros((d, d)), *[p @ np.diag(s) @ q for s in spectra]]:
            r = whitening.triangle(None, r)
            values, axes = whitening.principal(r, 4)
            exact = np.linalg.svd(r, compute_uv=False) ** 2
            assert len(values) <= min(4, d) and np.abs(values - exact[: len(values)]).max(initial=0) <= 1e-13 * max(exact[0], 1e-300)
            assert np.abs(axes @ axes.T - np.eye(len(values))).max(initial=0) < 1e-13
            assert np.abs(r.T @ (r @ axes.T) - axes.T * values).max(initial=0) <= 1e-12 * max(exact[0], 1e-300)
    # relative accuracy of small values, which an eigensolver of the covariance loses
    a, b = 10.0 ** -np.arange(0, 20.0), 0.5 * 10.0 ** -np.arange(0, 19.0)
    up, down = (whitening.dqds((x * x).tolist(), (y * y).tolist()) for x, y in ((a, b), (a[::-1], b[::-1])))
    assert len(up) == len(down) == 20 and abs(np.prod(np.sqrt(np.array(up) / a**2)) - 1) < 1e-10


def test_whitening_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rng = random.Random(5)
    plain = [(i, [rng.gauss(0, 1) * (k + 1) for k in range(5)], 1) for i in range(60)]
    odd_rows = [(None, None, 1), (70, [], 1), (71, [1.0, None, 0.0, 0.0, 0.0], 1), (72, [nan, 0.0, 0.0, 0.0, 0.0], 1), (73, [inf, 0.0, 0.0, 0.0, 0.0], None), (74, [1.0, 2.0], 1), (75, [-0.0, 0.5], None), (76, [3e30, 1.0], 1)]
    x = spark.createDataFrame([*plain, *plain[:40], *odd_rows], VECS).withColumn("n", F.lit(1)).withColumn("deviation", F.lit("x")).repartition(9)
    out, models = whitening.whiten(x)
    got = out.select("vec_id", "embedding", "_white.*").collect()
    assert len(got) == 108 and {r.vec_id for r in got if r.deviation is None} == {None, 70, 71, 72, 73, 76}
    assert models[5].n == 60 and models[2].n == 2 and len(models[2].variance) == 1  # of two vectors only one direction varies
    n, sums, e, axes, trace = naive_white([v for _, v, _ in [(r.vec_id, r.embedding, 0) for r in got if r.embedding and r.vec_id is not None and r.vec_id < 60]])
    assert np.allclose(models[5].variance, e[:4], rtol=1e-12) and models[5].identity_error < 1e-12 and models[5].sums == sums.tolist()
    repeated = {}
    for r in got:
        if r.vec_id is not None and r.vec_id < 60:
            repeated.setdefault(r.vec_id, set()).add((r.deviation, tuple(r.whitened)))
    assert all(len(v) == 1 for v in repeated.values())
    none, models = whitening.whiten(x.limit(0))
    assert none.count() == 0 and models == {}
    same, _ = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], 1)] * 5, VECS))
    assert [(list(r.whitened), r.deviation) for r in same.select("_white.*").collect()] == [([], 0)] * 5
    with pytest.raises(ValueError):
        whitening.whiten(x.withColumnRenamed("n", "_white"))


def test_deviations_beyond_long():
    m = whitening.Model(3, [1 << 40, 5])
    x = np.array([[1 << 38, 1], [(1 << 40) // 3, 2]], np.int64)
    assert m.deviations(x) == [None if (v := (3 * a - (1 << 40)) ** 2 + (3 * b - 5) ** 2) >= 1 << 63 else v for a, b in x.tolist()]


# 13 --------------------------------------------------------------------------------------------------------------


def test_terms_are_words_and_runs():
    own = set(toxicity.terms("Sum it: SUM!").tolist())
    assert own == set(toxicity.terms(" it sum").tolist()) and len(own) == 2 + 6 + 3  # words; _su sum um_ _sum sum_ _sum_; _it it_ _it_
    assert len(toxicity.terms("")) == len(toxicity.terms("12 .")) == len(toxicity.terms(None)) == 0
    assert set(toxicity.terms("alpha beta").tolist()) == set(toxicity.terms("alpha").tolist()) | set(toxicity.terms("beta").tolist())


def test_machine_learns_pairs_that_weights_miss():
    """Toxic: an insult together with a group, or neither; no sum of single weights tells these apart."""
    rng = np.random.default_rng(3)
    rows, y = [], []
    for _ in range(1500):
        a, b = rng.integers(0, 2, 2)
        own = [k for k, has in enumerate((a, b)) if has] + rng.choice(np.arange(2, 12), 3, replace=False).tolist()
        rows.append(np.array(sorted(own), np.int64))
        y.append(float(a == b))
    y = np.array(y)
    for factors, low, high in ((8, 0.98, 1.0), (0, 0.0, 0.7)):
        w, v, bias = toxicity.fit(rows, y, 12, factors=factors, epochs=30)
        right = np.mean([(toxicity.raw(x, w, v, bias) > 0) == (t > 0.5) for x, t in zip(rows, y, strict=True)])
        assert low <= right <= high, (factors, right)


def test_toxicity_on_held_out_rows(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.1")
    labels = table(spark, sf, "labels").toPandas().set_index("doc_id").toxic
    x = QUERIES["op13_toxicity"](spark, sf).toPandas()
    assert len(x) == 10_000 and x.score.between(0, 1).all() and ((x.score >= 0.5) == (x.predicted == 1)).all()
    assert (x.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in x.doc_id]).all()
    own = x[x.held_out & x.doc_id.isin(labels.index)]
    y = own.doc_id.map(labels)
    assert (y[own.predicted == 1] == 1).mean() > 0.95 and (own.predicted[y == 1] == 1).mean() > 0.85


def test_toxicity_of_odd_tables(spark):
    rows = [(i, f"you are a {'vile moron' if i % 3 == 0 else 'fine person'} number w{i} {PROSE}", "en", "s", None) for i in range(300)]
    x = spark.createDataFrame([*rows, *rows[:5], *[(1000 + i, t, None, None, None) for i, t in enumerate(ODD)], (None, "vile moron", None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = [(i, 1, int(i % 3 == 0)) for i in range(300)] + [(0, 0, 1), (1, None, None), (2, 1, 7), (None, 1, 1), (5000, 1, 1), (1000, 0, 0)]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("x"))
    out, model = toxicity.toxicity(x.withColumn("toxic", F.lit(9)).withColumn("h", F.lit(1)), lab)
    got = out.select("doc_id", "text", "_toxic.*").collect()
    assert len(got) == 306 + len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.predicted == ("moron" in (r.text or "")) for r in got)
    assert len({r.score for r in got if r.text in (None, "", "   ")}) == 1
    assert 0 < len(model.known) <= 1024
    for no_labels in (lab.limit(0), lab.where("toxic = 0")):
        assert all(r.score < 1e-12 for r in toxicity.toxicity(x, no_labels)[0].select("_toxic.score").collect())
    assert toxicity.toxicity(x.limit(0), lab)[0].count() == 0
    with pytest.raises(ValueError):
        toxicity.toxicity(x.withColumn("_Toxic", F.lit(1)), lab)
    few = toxicity.labelled_sample(x, lab, 10)
    assert few.count() <= 20 and few.where(toxicity.held_out(F.col("_id"))).count() == 0
