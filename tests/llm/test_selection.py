"""Decontamination, mixing and the pipeline."""

import os
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from versefold.llm import decontamination as dc
from versefold.llm import mixing as mx
from versefold.llm import common, registry
from versefold.llm import toxicity as tx
from versefold.llm.common import shared_table, table

from .test_dedup import brute_lines, brute_links

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute_hits(docs, items):
    windows = []
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        windows += [(str(i) if i is not None else "", w[p : p + n]) for p in range(len(w) - n + 1 if n else 0)]
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for item, x in windows:
            for p in range(len(w) - len(x) + 1):
                if w[p : p + len(x)] == x:
                    hit |= set(range(p, p + len(x)))
                    found.add(item)
        out.append((i or -1, len(w), len(hit), sorted(found), bool(hit)))
    return sorted(out)


@pytest.fixture(scope="module")
def leaks():
    rng = random.Random(9)
    few = ["the", "of", "to", "é1", "X"]
    word = lambda: rng.choice(few) if rng.random() < 0.5 else "".join(rng.choice("abcXYZ09ñ") for _ in range(3))
    items = [(k, " ".join(word() for _ in range(rng.choice([1, 2, 3, 9, 10, 11, 30])))) for k in range(25)]
    items += [(100, None), (101, ""), (102, "... !"), (103, items[7][1]), (104, "the the the the the the the the the the the the"), (None, "odd one out")]
    docs = []
    for k in range(60):
        parts = [word() for _ in range(rng.randint(0, 60))]
        if k % 3 == 0:
            w = words(rng.choice(items[:25])[1])
            s = rng.randint(0, max(0, len(w) - 10))
            parts[len(parts) // 2 : len(parts) // 2] = w[s : s + rng.choice([9, 10, 14])]
        docs.append((k, rng.choice([" ", ", ", "\n"]).join(parts)))
    docs += [(200, None), (201, ""), (202, "the " * 30), (202, "the " * 30), (None, "An ODD one, out!"), (203, "x " * 30_000 + "odd one out")]
    return docs, items


@pytest.mark.parametrize("how", [{}, {"block_bytes": 300}, {"shingle": 1}])
def test_hits_are_exact(spark, leaks, how):
    docs, items = leaks
    df = spark.createDataFrame([(i, t, "x", True) for i, t in docs], "doc_id long, text string, item_ids string, contaminated boolean")
    got = dc.mark_contaminated(df, spark.createDataFrame(items, "item_id long, text string"), **how).collect()
    assert sorted((r.doc_id or -1, r.n_words, sum(x.e - x.s for x in r.hit_spans), r.item_ids, r.contaminated) for r in got) == brute_hits(docs, items)


def test_no_items_and_no_documents(spark, leaks):
    df = spark.createDataFrame(leaks[0], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.mark_contaminated(df, none).where("contaminated or n_words is null").count() == 0
    assert dc.mark_contaminated(df.limit(0), spark.createDataFrame(leaks[1], "item_id long, text string")).count() == 0


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_twin(spark, sf_dir, name):
    db = duckdb.connect()
    for f in os.listdir(sf_dir):
        db.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    want = db.sql(registry.oracle_sql()[name])
    got = registry.queries()[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(tuple(r[c] for c in want.columns) for r in got.collect()) == sorted(want.fetchall())


def goals(sizes, weights=(3, 1, 2), share=1.5, repeats=2):
    """Targets by the rule as it is stated: deal, cut, deal what was cut among those not cut, until none is above."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target, left, free = dict.fromkeys(order, 0.0), share * sum(sizes.values()), set(order)
    while left > 1e-9 and free:
        total, cut = sum(weight[s] for s in free), 0.0
        for s in free:
            target[s] += left * weight[s] / total
        for s in list(free):
            if target[s] >= repeats * sizes[s]:
                cut += target[s] - repeats * sizes[s]
                target[s] = repeats * sizes[s]
                free.discard(s)
        left = cut
    return target


def brute_mix(rows):
    """(doc_id, source, size, words taken) of rows (doc_id, source, text, k): whole epochs, then those of the least keys until the words are used up."""
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + len(re.findall(r"[^ \t-\r]+", r.text or ""))
    out = []
    for s, target in goals(sizes).items():
        epochs = int(target // sizes[s]) if sizes[s] else 0
        left = round(target) - epochs * sizes[s]
        own = [(r.k, r.doc_id is not None, r.doc_id or 0, len(re.findall(r"[^ \t-\r]+", r.text or ""))) for r in rows if r.source == s]
        for _, known, i, n in sorted(own):
            part = max(0, min(n, left))
            left -= part
            out.append(repr((i if known and i else -1, s, n, epochs * n + part)))
    return sorted(out)


@pytest.fixture(scope="module")
def sources():
    rng = random.Random(4)
    rows = []
    for s, n in [("b", 400), ("a", 60), ("é", 30), (None, 25), ("c", 3), ("Z", 1), ("empty", 4), ("a\U0001f600", 12)]:
        rows += [(len(rows) + k, "" if s == "empty" else " \t\n".join("w" * rng.randint(1, 5) for _ in range(rng.choice([0, 1, 5, 40]))), s) for k in range(n)]
    return rows + [(9000, None, "a"), (9001, "big " * 5000, "é"), (None, "no id", "b"), (3, "twice", "b"), (3, "twice", "b")]


def test_mix(spark, sources):
    df = spark.createDataFrame([(i, t, s, 7) for i, t, s in sources], "doc_id long, text string, source string, size int")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(0, 300, 3)] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    got = mx.mix(df, labels)
    rows = got.collect()
    assert len(rows) == len(sources)
    sizes = {}
    for _, t, s in sources:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    target = goals(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(target[r.source])
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 0.5 + 1e-6
    key = lambda r: repr(tuple(r))
    again = mx.mix(df.repartition(5).orderBy(F.rand(1)), labels).collect()
    assert sorted(rows, key=key) == sorted(again, key=key)
    # Which documents the last, partial epoch takes: those of the least keys until the words are used up.
    graded = df.join(labels.groupBy("doc_id").agg(F.max("quality").alias("q")), "doc_id", "left").select("doc_id", "source", "text", mx.sampling_key(F.col("doc_id"), mx.sampling_weight(F.col("q"))).alias("k")).collect()
    assert brute_mix(graded) == sorted(repr((r.doc_id or -1, r.source, r.size, r.taken)) for r in rows)
    # Each document has whole epochs before any has a part of another.
    for s in sizes:
        own = [r for r in rows if r.source == s and r.size]
        epochs = int(target[s] // sizes[s]) if sizes[s] else 0
        assert all(epochs * r.size <= r.taken <= (epochs + 1) * r.size for r in own)
        assert sum(epochs * r.size < r.taken < (epochs + 1) * r.size for r in own) <= 1
    assert mx.mix(df.limit(0), labels).count() == 0


def test_better_documents_are_likelier(spark):
    df = spark.createDataFrame([(i, "w w w w", "s") for i in range(4000)] + [(10_000 + i, "w w w w", "t") for i in range(8000)], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(12_000)] + [(10_000 + i, int(i % 2 == 0)) for i in range(8000)], "doc_id long, quality int")
    rows = mx.mix(df, labels, weights=(1, 9), share=0.5).collect()
    share = lambda good: sum(r.taken for r in rows if (r.doc_id % 2 == 0) == good)
    assert share(True) > 1.3 * share(False)


@pytest.fixture(scope="module")
def chain(spark, sf_dir):
    """What each stage gets and what it makes, over all documents."""
    docs, out = table(spark, sf_dir, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        made = shared_table(stage(spark, docs, sf_dir))
        out.append((name, docs.collect(), made.collect()))
        docs = made
    return out


def test_stages(spark, sf_dir, chain):
    """Each stage's whole output against plain code over all that it got."""
    assert [n for n, _, _ in chain] == ["toxicity", "line_dedup", "jaccard_join", "decontamination", "mixing"]
    full = lambda rows: sorted(map(repr, rows))
    for name, got, made in chain:
        if name == "toxicity":
            docs = table(spark, sf_dir, "documents")
            scores = tx.fit(docs, table(spark, sf_dir, "labels")).scores([r.text for r in got])
            assert full(made) == full([r for r, x in zip(got, scores, strict=True) if x < 0.3])  # none goes where labels are few
        if name == "line_dedup":
            lines = brute_lines([(r.doc_id, r.text) for r in got])
            assert sorted((r.doc_id or -1, r.text) for r in made) == [(i, t) for i, _, _, t in lines]
            assert all(r.n_chars == len(r.text) for r in made)
        if name == "jaccard_join":
            links = brute_links([(r.doc_id, r.text) for r in got])
            assert full(made) == full([r for r in got if links[r.doc_id][0] == r.doc_id])
            assert len(made) < len(got)
        if name == "decontamination":
            windows = {n: set() for n in range(1, 11)}
            for r in table(spark, sf_dir, "benchmark").collect():
                w = words(r.text)
                n = min(10, len(w))
                for p in range(len(w) - n + 1 if n else 0):
                    windows[n].add(tuple(w[p : p + n]))
            clean = lambda w: not any(tuple(w[p : p + n]) in x for n, x in windows.items() if x for p in range(len(w) - n + 1))
            assert full(made) == full([r for r in got if clean(words(r.text))])
            assert len(made) < len(got)
        if name == "mixing":
            labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"))
            rows = spark.createDataFrame([(r.doc_id, r.source, r.text) for r in got], "doc_id long, source string, text string").join(labels, "doc_id", "left")
            keyed = rows.select("doc_id", "source", "text", mx.sampling_key(F.col("doc_id"), mx.sampling_weight(F.col("q"))).alias("k")).collect()
            assert brute_mix(keyed) == sorted(repr((r.doc_id or -1, r.source, r.size, r.taken)) for r in made)


def test_run(spark, sf_dir, chain):
    key = lambda r: repr(tuple(r))
    assert sorted(map(key, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(key, chain[-1][2]))


def test_stages_on_odd_rows(spark, sf_dir):
    """Nulls, empty texts, repeated rows, clashing columns and no rows at all."""
    schema = table(spark, sf_dir, "documents").schema
    passage = table(spark, sf_dir, "benchmark").where(F.length("text") > 150).first().text
    odd = [(1, "some words of one text, and of no other one", "en", "a", 9), (2, None, "en", None, None), (3, "", None, "b", 0), (4, f"more {passage} and more", "en", "b", 5), (5, "twice " * 30, "de", "a", 1), (5, "twice " * 30, "de", "a", 1)]
    docs = spark.createDataFrame(odd, schema).withColumns({"score": F.lit("s"), "n_lines": F.lit("l"), "class_id": F.lit("c"), "contaminated": F.lit("x"), "size": F.lit("z"), "comp": F.lit(1), "key": F.lit(2)})
    want = {"toxicity": [1, 2, 3, 4, 5, 5], "line_dedup": [1, 2, 3, 4, 5, 5], "jaccard_join": [1, 2, 3, 4, 5], "decontamination": [1, 2, 3, 5, 5], "mixing": [1, 2, 3, 4, 5, 5]}
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, sf_dir)
        assert name == "mixing" or got.columns == docs.columns
        assert sorted(r.doc_id for r in got.collect()) == want[name], name
        assert stage(spark, docs.limit(0), sf_dir).count() == 0


def test_words_that_a_polynomial_hash_confuses(spark):
    """Thue-Morse words and their complements collide in any polynomial modulo 2**64 from 1,024 letters on."""
    turn = "a"
    for _ in range(11):
        turn += turn.translate(str.maketrans("ab", "ba"))
    other = turn.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, f"x {turn} y"), (2, f"x {other} y"), (3, turn.upper())], "doc_id long, text string")
    items = spark.createDataFrame([("i", turn)], "item_id string, text string")
    got = {r.doc_id: r.contaminated for r in dc.mark_contaminated(docs, items).collect()}
    assert got == {1: True, 2: False, 3: True}
    data = np.frombuffer(f"{turn} {other} {turn[:300]} {other[:300]} {turn[:255]} {other[:255]} abc abd abcdefgh abcdefghi abcdefgh".encode(), np.uint8)
    starts, ends, hashes, _ = common.words(data, np.array([0, len(data)]))
    spelled = [data[x:y].tobytes() for x, y in zip(starts, ends, strict=True)]
    assert len(set(hashes.tolist())) == len(set(spelled)) == len(spelled) - 1


def test_mix_of_nothing(spark, sources):
    df = spark.createDataFrame([(i, t, s) for i, t, s in sources], "doc_id long, text string, source string")
    assert mx.mix(df.limit(0)).count() == 0
    assert [r.taken for r in mx.mix(df.withColumn("text", F.lit(None).cast("string"))).collect()] == [0] * len(sources)


def test_keys_follow_weights(spark):
    """Of many pairs of one good and one poor document, the good one comes first by its weight's share; no bin is large, whatever the weight."""
    keys = spark.range(40_000).select("id", *[mx.sampling_key(F.col("id") + n, F.lit(w)).alias(f"k{n}") for n, w in ((0, 1.0), (50_000, 0.3))])
    assert abs(keys.where("k0 < k50000").count() / 40_000 - 1 / 1.3) < 0.01
    for c in ("k0", "k50000"):
        assert keys.groupBy(F.floor(F.log(c) * mx.COARSE)).count().agg(F.max("count")).first()[0] < 0.02 * 40_000
