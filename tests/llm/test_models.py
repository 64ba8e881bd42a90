"""Toxicity and quality: held-out accuracy, what gaps and insertions do, and edge cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from versefold.llm import quality as ql
from versefold.llm import toxicity as tx

INSULTS = ["gloopfink", "snarvik", "bramdolt", "quisbert"]


def corpus(n, seed=1):
    rng = random.Random(seed)
    syllables = ["ra", "ten", "ol", "mi", "dor", "es", "ka", "lin", "ut", "pe", "vo", "ner"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    texts, toxic = [], []
    for k in range(n):
        words = [word() for _ in range(rng.randint(8, 120))]
        for at in range(9, len(words), 11):
            words[at] += "."
        y = int(k % 5 == 0)
        if y:
            words[rng.randrange(len(words))] = rng.choice(INSULTS)
        texts.append(" ".join(words))
        toxic.append(y)
    return texts, toxic


@pytest.fixture(scope="module")
def model():
    return tx.train(*corpus(900))


def test_kernel_against_plain_sums():
    def plain(s, t, p=3, d=tx.DECAY):
        from itertools import combinations

        total = 0.0
        for a in combinations(range(len(s)), p):
            for b in combinations(range(len(t)), p):
                if all(s[x] == t[y] for x, y in zip(a, b, strict=True)):
                    total += d ** (a[-1] - a[0] + 1 + b[-1] - b[0] + 1)
        return total

    words = ["idiot", "idxiot", "moron", "abc", "ab", "aaaa"]
    codes = tx._codes(words, 8)
    for w in ("idiot", "aab"):
        got = tx.subsequence_kernel(codes, tx._codes([w], len(w))[0])
        assert got == pytest.approx([plain(x, w) for x in words], rel=1e-4)


def plain_kernel(s, t, p=tx.ORDER, d=tx.DECAY):
    from itertools import combinations

    sums = [{}, {}]
    for x, out in ((s, sums[0]), (t, sums[1])):
        for at in combinations(range(len(x)), p):
            if "\0" not in (u := "".join(x[i] for i in at)):
                out[u] = out.get(u, 0) + d ** (at[-1] - at[0] + 1)
    return sum(v * sums[1].get(u, 0) for u, v in sums[0].items())


def plain_likeness(text, mark):
    """The best window's normalised kernel above the floor, with no window passed over."""
    room = len(mark) + max(tx.SLACK, len(mark.strip("^$")) - 1)
    best = 0.0
    for lo in range(max(1, len(text) - room + 1)):
        window = "".join(c if c in mark else "\0" for c in text[lo : lo + room])
        own = plain_kernel(window, window)
        if own:
            best = max(best, plain_kernel(window, mark) / (own * plain_kernel(mark, mark)) ** 0.5)
    return max(best - tx.FLOOR, 0) / (1 - tx.FLOOR)


def test_likeness_against_plain_sums():
    rng = random.Random(4)
    marks = ["^idiot$", "^scum$", "^stup", "^moron$"]
    words = ["^idiot$", "^idixot$", "^ixdxixoxt$", "^idot$", "^toidi$", "^scxuxm$", "^stuplid$", "^mroon$", "^oron$", "^zz$"]
    words += ["^" + "".join(rng.choice("idotscumrnpx") for _ in range(rng.randint(1, 18))) + "$" for _ in range(150)]
    got = tx.kernel(words, marks, tx.WIDTH)
    want = [[plain_likeness(w, m) for m in marks] for w in words]
    assert got == pytest.approx(np.array(want), abs=1e-4)
    assert got[0][0] == pytest.approx(1) and got[1][0] > 0.5 and got[2][0] > 0


def test_scores_against_a_plain_model(model):
    """Sentence by sentence, term by term, with the model's weights."""
    import math

    texts = [*corpus(25, seed=12)[0], "Ra ten sn4rvik, mi. Dor s n a r v i k es! gloopxfink\nten", "quis-bert", None]
    for text, score in zip(texts, model.scores(texts), strict=True):
        top = model.bias
        low = (text or "").lower()
        for sentence in tx._SENTENCE.split(low):
            terms = {tx.term(t) for t in tx.tokens(sentence)} - {""}
            row = [max([plain_likeness(f"^{t}$", m) for t in terms], default=0.0) for m in model.landmarks]
            if any(row):
                top = max(top, float(np.array(row) @ model.whiten @ model.weights + model.bias))
        assert score == pytest.approx(1 / (1 + math.exp(-(model.slope * top + model.shift))), abs=1e-3)


def test_too_few_letters_are_never_alike():
    """What least_shared passes over is at or below the floor, in the worst case too: a window with all but so many letters in place."""
    from itertools import combinations

    for mark in ("^idiot$", "^trash$", "^scum$", "^worth", "^banana$"):
        inner = mark.strip("^$")
        for lack in range(len(inner) - tx.least_shared(mark) + 1, len(inner) + 1):
            for gone in combinations(range(len(inner)), lack):
                at = {k + mark.index(inner) for k in gone}
                window = "".join("\0" if k in at else c for k, c in enumerate(mark))
                own = plain_kernel(window, window)
                assert not own or plain_kernel(window, mark) / (own * plain_kernel(mark, mark)) ** 0.5 <= tx.FLOOR + 1e-9


def test_held_out_accuracy(model):
    texts, toxic = corpus(400, seed=2)
    s = model.scores(texts)
    y = np.array(toxic) == 1
    assert ((s >= tx.THRESHOLD) == y).mean() > 0.99
    assert s[y].min() > s[~y].max()


@pytest.mark.parametrize("written", ["gloopfink", "GLOOPFINK!", "gloopfinks", "gl0opfink", "gloop-fink", "g l o o p f i n k", "gloxopfink", "g.l.o.o.p.f.i.n.k", "gloopfnk"])
def test_gaps_and_insertions(model, written):
    clean = "ra ten olmi dor es kalin ut. pe vo ner raten ol mi"
    low, high = model.scores([clean, f"{clean} {written} {clean}"])
    assert low < tx.THRESHOLD <= high


def test_letters_inserted_into_short_insults():
    from itertools import combinations

    words = ["vung", "brask", "clewm", "drifop"]
    texts, toxic = corpus(900, seed=3)
    for k, t in enumerate(texts):
        for old, new in zip(INSULTS, words, strict=True):
            t = t.replace(old, new)
        texts[k] = t
    model = tx.train(texts, toxic)
    clean = "ra ten olmi dor es kalin ut. pe vo ner raten ol mi"
    assert model.scores([clean])[0] < tx.THRESHOLD
    for w in words:
        forms = ["x".join(w)]
        for n in (1, 2):
            for at in combinations(range(1, len(w)), n):
                forms.append("".join("x" * (i in at) + c for i, c in enumerate(w)))
        missed = [f for f, s in zip(forms, model.scores([f"{clean} {f} {clean}" for f in forms]), strict=True) if s < tx.THRESHOLD]
        assert not missed
    # A window that lies across the pieces of a long term.
    bare = tx.Model(["drifop"], np.eye(1), np.zeros(1), -1.0, 1.0, -3.0)
    terms = ["y" * n + "dxrxixfxoxp" + "y" * 60 for n in range(100)]
    found = bare.features(terms)
    assert all(found[t][0] > 0.3 for t in terms)


def test_empty_and_long(model):
    s = model.scores([None, "", " . ", "ra " * 60_000, "x" * 200_000, "ra " * 60_000 + "snarvik"])
    assert (s[:5] < tx.THRESHOLD).all() and s[5] >= tx.THRESHOLD
    assert ((s >= 0) & (s <= 1)).all()
    assert len(model.scores([])) == 0


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.predicted for r in tx.score(docs, tx.fit(docs, none)).collect()} == {0}
    assert {r.keep for r in ql.rate(docs, ql.fit(docs, ql.graded(none))).collect()} == {True}
    odd = spark.createDataFrame([(None, 1, 1), (1, None, None), (2, 0, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")
    assert [(r.doc_id, r.grade) for r in ql.graded(odd).collect()] == [(2, 0)]
    assert tx.score(docs, tx.fit(docs, odd)).count() == 2
    assert tx.score(docs.limit(0), tx.fit(docs, none)).count() == 0


def test_query_columns_and_held_out_rows(spark, sf_dir):
    import zlib

    rows = tx.op2_toxicity(spark, sf_dir).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3) for r in rows)


@pytest.fixture(scope="module")
def graded():
    texts, toxic = corpus(600, seed=5)
    rng = random.Random(6)
    grades = []
    for k, t in enumerate(texts):
        grades.append(k % 3)
        if k % 3 == 0:
            texts[k] = " ".join(w + rng.choice(["%%", "$$", "!!"]) for w in t.split())
        elif k % 3 == 1:
            texts[k] = t.upper()
    return texts, grades


def test_ordinal(graded):
    texts, grades = graded
    model = ql.train(texts[:450], grades[:450], 3)
    assert (np.diff(model.thresholds) > 0).all()
    from versefold.llm.common import utf8
    import pyarrow as pa

    tails = model.tails(*utf8(pa.array(texts[450:])))
    assert (np.diff(tails, axis=1) <= 0).all()
    y = np.array(grades[450:])
    expected = tails.sum(1)
    assert expected[y == 0].mean() + 0.4 < expected[y == 1].mean() < expected[y == 2].mean() - 0.4
    assert ((tails[:, 0] >= 0.5) == (y >= 1)).mean() > 0.95


def test_fit_against_a_plain_optimiser(graded):
    texts, grades = graded
    four = [g + (k % 2 if g == 2 else 0) for k, g in enumerate(grades)]
    sample, used, _ = ql.counted(texts[:200], four[:200], 4)
    rng = np.random.default_rng(3)
    w, cuts = rng.normal(0, 0.3, len(used)), np.array([-0.5, 0.7, 1.1])
    _, d_w, d_cuts = sample.loss(w, cuts)
    for k in rng.integers(0, len(used), 20).tolist():
        step = np.zeros(len(used))
        step[k] = 1e-5
        assert d_w[k] == pytest.approx((sample.loss(w + step, cuts)[0] - sample.loss(w - step, cuts)[0]) / 2e-5, rel=1e-3, abs=1e-7)
    for k in range(3):
        step = np.eye(3)[k] * 1e-5
        assert d_cuts[k] == pytest.approx((sample.loss(w, cuts + step)[0] - sample.loss(w, cuts - step)[0]) / 2e-5, rel=1e-3, abs=1e-7)
    fitted = sample.fitted(len(used))
    # Plain descent with halved steps, from the same start.
    x = [np.zeros(len(used)), np.array([0.0, 1.0, 1.0])]
    now, rate = sample.loss(*x), 1.0
    for _ in range(3000):
        new = [x[0] - rate * now[1], np.r_[x[1][0] - rate * now[2][0], np.maximum(x[1][1:] - rate * now[2][1:], 1e-3)]]
        then = sample.loss(*new)
        if then[0] < now[0]:
            x, now, rate = new, then, rate * 1.2
        else:
            rate /= 2
    assert sample.loss(*fitted)[0] <= 1.05 * now[0] + 0.01
    assert (fitted[1][1:] > 0).all()


def test_samples_are_bounded(spark):
    from pyspark.sql import functions as F

    from versefold.llm.common import bounded_sample

    rows = [(1, f"text {k} " + "x" * 900) for k in range(400)] + [(2, "y" * 50_000), (2, "z"), (2, "z"), (3, None), (4, "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ids = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "doc_id long, grade int")
    got = bounded_sample(docs, ids, 100_000)
    assert 60 < len(got) < 110 and sum(len(r["t"]) for r in got) <= 100_000
    assert {(r["d"], r["grade"]) for r in got} <= {(1, 0), (2, 1)} and max(len(r["t"]) for r in got) < 1000
    assert got == bounded_sample(docs.orderBy(F.rand(1)), ids, 100_000)
    assert [(r["d"], r["t"]) for r in bounded_sample(docs.where("doc_id > 1"), ids, 10_000_000)] == [(2, "y" * 50_000), (2, "z")]
    assert bounded_sample(docs.limit(0), ids, 1000) == []


def test_no_documents_and_clashing_columns(spark, model, graded):
    df = spark.createDataFrame([(1, "ra snarvik", "s", "p", 5)], "doc_id long, text string, score string, predicted string, keep int")
    (row,) = tx.score(df, model).collect()
    assert (row.doc_id, row.keep, row.predicted) == (1, 5, 1) and 0.3 <= row.score <= 1
    rater = ql.train(graded[0][:100], graded[1][:100], 3)
    (row,) = ql.rate(df, rater).collect()
    assert (row.score, row.predicted) == ("s", "p") and row.keep in (True, False)
    assert tx.score(df.limit(0), model).count() == ql.rate(df.limit(0), rater).count() == 0


def test_rate(spark, graded):
    texts, grades = graded
    model = ql.train(texts[:300], grades[:300], 3)
    rows = [(0, None), (1, ""), (2, "ab"), (3, texts[2]), (3, texts[2]), (4, texts[2] * 300)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, grade string")
    got = ql.rate(df, model).collect()
    assert len(got) == 6 and all(0 <= r.expected_grade <= 2 and 0 <= r.tail_probability <= 1 for r in got)
    assert len({r.expected_grade for r in got if r.doc_id in (0, 1)}) == 1
    assert len({r.expected_grade for r in got if r.doc_id == 3}) == 1
    assert [r.grade for r in got if r.doc_id == 4] == [2]


def test_labelled_documents(spark, sf_dir):
    """Held-out quality labels of the next scale up."""
    sf = sf_dir.replace("sf0.001", "sf0.01")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = ql.op5_quality(spark, sf).where("held_out").join(labels, "doc_id").collect()
    poor, good = ([r.tail_probability for r in got if r.quality == q] for q in (0, 1))
    better = np.mean([[a < b for b in good] for a in poor])
    assert better > 0.9
    assert np.mean([r.keep for r in got if r.quality == 1]) > 0.97


def test_training_runs_in_a_task(spark, monkeypatch):
    import os

    ids = [r.id for r in spark.range(20).where(~tx.held_out(F.col("id"))).limit(2).collect()]
    docs = spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string")
    labels = spark.createDataFrame([(ids[0], 0), (ids[1], 1)], "doc_id long, toxic int")
    monkeypatch.setattr(tx, "train", lambda texts, toxic: tx.Model([os.getpid(), texts, toxic], None, None, 0.0, 1.0, 0.0))
    pid, texts, toxic = tx.fit(docs.orderBy(F.desc("doc_id")), labels).landmarks
    assert pid != os.getpid()
    assert texts == [f"text {i}" for i in sorted(ids)] and toxic == [0, 1]


def test_spaced_letters_are_looked_for_once(model, monkeypatch):
    """Not again in each sentence, of which none holds what its text hasn't."""
    texts = [f"We met {INSULTS[0]} there. " * 40, "A clean one. Nothing in it!", "So g.l.o.o.p.f.i.n.k came. s n a r v i k too.\nEnd a b c. d e f"]
    assert all(sorted(x for s in tx._SENTENCE.split(t) for x in tx.spaced(s)) == sorted(tx.spaced(t)) for t in texts)
    want = model.scores(texts)
    calls, found = [], tx._SPACED

    class Counting:
        def findall(self, text):
            calls.append(text)
            return found.findall(text)

    monkeypatch.setattr(tx, "_SPACED", Counting())
    assert model.scores(texts[:2]).tolist() == want[:2].tolist() and len(calls) == 2
