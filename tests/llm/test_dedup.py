"""Suffix, line and near-duplicate operators against brute force, and their defined edge cases."""

import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from versefold.llm import jaccard_join as jj
from versefold.llm import line_dedup as ld
from versefold.llm import suffix_dedup as sd
from versefold.llm.common import table, utf8

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, n_lines int, class_id int, _text string, _id long, _doc string, _gone int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None, "k", 0, 0, "x", 5, "d", 6) for i, t in rows], SCHEMA)


def noise(rng, n, letters="ab cde\nfgh é"):
    return "".join(rng.choice(letters) for _ in range(n))


@pytest.fixture(scope="module")
def repetitive():
    """Documents with copies, shared passages, runs of one letter, empty and very short texts."""
    rng = random.Random(7)
    passage, line = noise(rng, 260), "A line that very many documents share, of some length, and of no interest whatever."
    rows = [(i, noise(rng, rng.choice([0, 5, 99, 100, 101, 400, 1500]))) for i in range(60)]
    rows += [(60 + i, noise(rng, 80) + passage[rng.randint(0, 60) :] + noise(rng, 120)) for i in range(30)]
    rows += [(90 + i, rows[i][1]) for i in range(20)]
    rows += [(110, "a" * 700), (111, "a" * 350), (112, "ab" * 300), (113, passage * 3), (114, ""), (115, passage + "\n" + line)]
    rows += [(120 + i, f"{noise(rng, 50)}\n  {line.upper() if i % 2 else line}\t\n{noise(rng, 60)}") for i in range(12)]
    rng.shuffle(rows)
    return rows


def brute_suffix(rows, length=100):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = t.encode()
        cover = bytearray(len(b))
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                cover[s : s + length] = b"\1" * length
            seen.add(w)
        runs = sum(1 for k in range(len(b)) if cover[k] and (k == 0 or not cover[k - 1]))
        out[i] = (len(b), sum(cover), runs, bytes(x for x, c in zip(b, cover, strict=True) if not c))
    return out


@pytest.mark.parametrize("how", [{}, {"hot_share": 0.0, "large": 2}, {"chunk": 1000}])
def test_suffix_dedup_is_exact(spark, repetitive, how, monkeypatch):
    monkeypatch.setattr(sd, "SAMPLE", 2)
    got = sd.remove_repeats(frame(spark, repetitive), **how)
    assert {c: dict(got.dtypes)[c] for c in ("n_bytes", "kept", "_text", "n_lines")} == {"n_bytes": "bigint", "kept": "binary", "_text": "string", "n_lines": "int"}
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got.collect()} == brute_suffix(repetitive)


def test_suffix_dedup_on_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    want = brute_suffix([(r.doc_id, r.text) for r in docs.collect()])
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.op1_suffix_dedup(spark, sf_dir).collect()}
    assert got == {i: (*w[:3], hashlib.sha256(w[3]).hexdigest()) for i, w in want.items()}


def test_suffix_dedup_ids(spark):
    long = noise(random.Random(4), 150, "abcdefghij")
    rows = [(None, long), (1, long), (1, long), (1, "x" + long), (None, None), (2, "")]
    got = sorted((r.doc_id or 0, r.text or "", r.n_removed) for r in sd.remove_repeats(frame(spark, rows)).collect())
    assert got == sorted([(0, long, 0), (1, long, 150), (1, long, 150), (1, "x" + long, 150), (0, "", 0), (2, "", 0)])
    assert sd.remove_repeats(frame(spark, []), hot_share=0.5).count() == 0


def test_run_index():
    rng = random.Random(2)
    for _ in range(30):
        texts = [noise(rng, rng.randint(1, 60), "ab\0") for _ in range(rng.randint(1, 6))]
        data = np.frombuffer("".join(texts).encode(), np.uint8)
        index = sd.RunIndex(data, np.r_[0, np.cumsum([len(t) for t in texts])])
        n = rng.randint(2, 8)
        seen, want, at = set(), [], 0
        for t in texts:
            for s in range(len(t) - n + 1):
                if t[s : s + n] in seen:
                    want.append(at + s)
                seen.add(t[s : s + n])
            at += len(t)
        assert index.later(n).tolist() == want
        assert len(index.runs) <= len(data) + index.m
        assert not any(isinstance(v, np.ndarray) and v.size > 2 * len(index.runs) + 257 for v in vars(index).values())
        for _ in range(10):
            pattern = noise(rng, rng.randint(1, 5), "ab\0")
            assert index.count(pattern.encode()) == sum(t.startswith(pattern, k) for t in texts for k in range(len(t)))
    # The index of many copies has as many runs as that of a few, and a row for each string's start.
    one = noise(rng, 2000, "abcdefgh")
    sizes = [len(sd.RunIndex(np.frombuffer((one * k).encode(), np.uint8), np.arange(k + 1) * 2000).rows) for k in (1, 40)]
    assert sizes[1] < sizes[0] + 200
    empty = sd.RunIndex(np.empty(0, np.uint8), np.zeros(3, np.int64))
    assert empty.later(3).tolist() == [] and empty.count(b"a") == 0


def test_contexts_in_pieces():
    rng = random.Random(6)
    texts = [noise(rng, n, "abc") for n in (0, 700, 99, 100, 1500, 3)]
    data, offsets = np.frombuffer("".join(texts).encode(), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])]

    def windows(piece):
        k, s, e = sd.contexts(data, offsets, 100, 32, piece)
        return {(int(x), p) for x, a, b in zip(k, s, e, strict=True) for p in range(a, b - 99)}

    whole = windows(1 << 20)
    assert len(whole) == sum(max(len(t) - 99, 0) for t in texts)
    assert all(windows(piece) == whole for piece in (1, 50, 100, 333, 2000))


def brute_lines(rows):
    docs = collections.defaultdict(set)
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    for i, t in rows:
        if i is not None:
            for x in (t or "").split("\n"):
                docs[key(x)].add(i)
    common = {k: max(d) for k, d in docs.items() if len(k) >= 40 and len(d) >= 5}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or not (key(x) in common and i < common[key(x)])]
        out.append((i or -1, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def test_line_dedup(spark, repetitive):
    rng = random.Random(3)
    line = "É" + "ÀB" * 20
    rows = [*repetitive, (None, None), (None, f"{line}\nx"), (300, ""), (301, "\n" * 50)]
    rows += [(310 + i, f"{line}\n{line} \nx{i}") for i in range(6)] + [(310, f"{line}\ny")] + [(320 + i, line[:39] + f"\n{'é' * 39}\n{'é' * 40}\n{noise(rng, 30)}") for i in range(7)]
    got = ld.drop_repeated_lines(frame(spark, rows))
    assert sorted((r.doc_id or -1, r.n_lines, r.n_dropped, r.text or "") for r in got.collect()) == brute_lines(rows)
    assert got.columns == [c for c in frame(spark, []).columns if c != "n_lines"] + ["n_lines", "n_dropped"]
    assert ld.drop_repeated_lines(frame(spark, [])).count() == 0
    named = spark.createDataFrame([(chr(97 + i), "k" * 50 + f"\n{i}") for i in range(6)], "doc_id string, text string")
    assert {r.doc_id: r.n_dropped for r in ld.drop_repeated_lines(named).collect()} == {**dict.fromkeys("abcde", 1), "f": 0}


def brute_links(rows, threshold=0.8):
    data, offsets = utf8(pa.array([t for _, t in rows], pa.string()))
    tokens, own = jj.shingle_sets(data, offsets, 5)
    sets = [frozenset(tokens[own[k] : own[k + 1]].tolist()) for k in range(len(rows))]
    up, links = list(range(len(rows))), collections.Counter()

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if both >= threshold * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                    links[a] += 1
                    links[b] += 1
                    x, y = root(a), root(b)
                    up[max(x, y)] = min(x, y)
    least = {}
    for k in range(len(rows)):
        least[root(k)] = min(least.get(root(k), rows[k][0]), rows[k][0])
    return {rows[k][0]: (least[root(k)], links[k]) for k in range(len(rows))}


@pytest.fixture(scope="module")
def families():
    """Near copies at all distances, one large family, exact copies, and a passage that many share."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    common = [word() for _ in range(40)]
    rows = []
    for _ in range(25):
        base = [word() for _ in range(rng.randint(30, 120))]
        for _ in range(rng.randint(1, 4)):
            rows.append([w if rng.random() > rng.choice([0, 0.01, 0.02, 0.05]) else word() for w in base])
    base = [word() for _ in range(100)]
    rows += [[w if rng.random() > 0.02 else word() for w in base] for _ in range(90)]
    rows += [common + [word() for _ in range(rng.randint(5, 60))] for _ in range(40)]
    rows += [rows[k] for k in range(0, 60, 3)] + [["one", "two"], ["One,", "TWO!"], ["one"], [], []]
    out = list(enumerate(" ".join(r) for r in rows))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("how", [{}, {"small": 4, "side": 16, "pivots": 4, "recall": 0.99999}, {"small": 4, "depth": 2, "side": 8, "pivots": 2}])
def test_near_join(spark, families, how, monkeypatch):
    if how:
        monkeypatch.setattr(jj, "LEAST", 16)
        monkeypatch.setattr(jj, "MOST", 32)
    got = {r.doc_id: (r.class_id, r.n_links) for r in jj.join_near(frame(spark, families), **how).collect()}
    want = brute_links(families)
    assert got.keys() == want.keys()
    missed = sum(w[1] for w in want.values()) - sum(g[1] for g in got.values())
    assert missed <= 0.002 * sum(w[1] for w in want.values())
    assert sum(got[k][0] != want[k][0] for k in want) <= (0 if not how else 1)
    assert all(got[k][1] <= want[k][1] for k in want)


def test_near_join_of_any_ids_and_lengths(spark):
    rng = random.Random(8)
    long = " ".join(noise(rng, 7, "abcdefgh") for _ in range(60_000))
    near = long.replace("a", "b", 200)
    rows = [("b7", long), ("a9", near), ("", "short text"), ("zz", "Short, text."), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = {r.doc_id: (r.class_id, r.n_links, r.is_first) for r in jj.join_near(docs).collect()}
    assert got == {"b7": ("a9", 1, False), "a9": ("a9", 1, True), "": ("", 1, True), "zz": ("", 1, False), None: (None, 0, True)}
    assert sorted(repr(r.doc_id) for r in jj.keep_one(docs).collect()) == sorted(map(repr, ["", None, "a9"]))


def test_labels_spread():
    rng = np.random.default_rng(5)
    for n in (1, 2, 9, 40):
        for share in (0.0, 0.02, 0.1, 1.0):
            linked = rng.random((n, n)) < share
            linked |= linked.T
            want = list(range(n))
            for _ in range(n):
                want = [min([want[k], *(want[j] for j in range(n) if linked[k, j])]) for k in range(n)]
            every = np.arange(n)
            assert jj.spread_labels(linked, every, every, n).tolist() == want


def test_near_join_on_documents(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    got = {r.doc_id: (r.class_id, r.n_links) for r in jj.op3_jaccard_join(spark, sf_dir).collect()}
    assert got == brute_links(rows)


def test_near_join_ids(spark):
    text = "one two three four five six seven eight"
    rows = [(None, text), (1, text), (1, text), (1, "other words " * 5), (2, None), (3, ""), (4, text.upper() + "!")]
    got = sorted((r.doc_id or 0, r.class_id or 0, r.n_links) for r in jj.join_near(frame(spark, rows)).collect())
    assert got == [(0, 0, 2), (1, 0, 2), (1, 0, 2), (1, 1, 0), (2, 2, 0), (3, 3, 0), (4, 0, 2)]
    kept = sorted((r.doc_id or 0, r.text or "") for r in jj.keep_one(frame(spark, rows)).collect())
    assert kept == [(0, text), (1, "other words " * 5), (2, ""), (3, "")]
    assert jj.join_near(frame(spark, [])).count() == 0


def test_runs_meet_the_target():
    assert jj.runs(0.8, 0.999) == 6
    assert jj.runs(0.8, 0.99999) > jj.runs(0.8, 0.999)


def test_links_between_families_of_two_pivots(spark):
    """Sets that link two families are compared, though each is near to a pivot of its own and the pivots are far apart."""
    key, rng = 1, np.random.default_rng(5)
    pool = rng.integers(0, 1 << 63, 2000).astype(np.uint64)
    sets = [np.sort(pool[100 * k : 100 * k + 1000]) for k in range(10)]
    ids = spark.range(400).selectExpr("id", f"pmod(xxhash64({key}L, id), 5) = 0 AS first").collect()
    first, other = ([r.id for r in ids if r.first == x] for x in (True, False))
    named = [first[0], *other[:8], first[1]]
    tokens, offsets = np.concatenate(sets), np.arange(11) * 1000
    sketch = jj.sketches(tokens, offsets)
    rows = spark.createDataFrame([(key, 10, i, 1000, s.tobytes()) for i, s in zip(named, sketch, strict=True)], "key long, m long, id long, n int, sketch binary")
    near = jj.near(sketch, sketch, np.full(10, 1000), np.full(10, 1000), 0.8)
    assert near[4, 5] and not near[0, 9] and not near[0, 5] and not near[4, 9]
    got = {r.node: r.comp for r in jj.components(jj._large_buckets(rows, 0.8, 4, 2)).collect()}
    assert {got.get(i) for i in named} == {min(named)}
