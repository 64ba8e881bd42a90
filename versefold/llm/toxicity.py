"""Toxicity: a support vector machine over a gapped-subsequence string kernel, with Nystroem landmarks.

Terms are words (lower-cased, look-alike digits and signs read as letters, other signs taken out) and runs of spaced
single letters read as one word; `^` and `$` mark their ends. Landmarks are whole words and word beginnings that the
training documents' labels tell apart. A sentence's kernel with a landmark is that of its best term: all common
subsequences of three letters count, a little less for each gap, over the window of the term that fits best, which has
room for a letter in every gap. Letters that the landmark hasn't are taken out of the window (their places stay), so
that inserted ones cost their gaps only. Landmark kernels are whitened (Nystroem), and a linear machine is trained on sentences: all of a clean
document's are clean; of a toxic one's, those that hold a landmark, or else the highest, are toxic (multiple instances,
a few rounds).
A document's score is its highest sentence's, through a logistic curve fitted to the training documents.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_rows, map_batches, table

#: The training sample: so many labelled documents of each class at most, the first by a hash of the id.
MOST_TOXIC, MOST_CLEAN = 1500, 3000
#: Bytes of the sample's texts at most.
MOST_BYTES = 48 << 20
LANDMARKS, ORDER, DECAY, FLOOR = 64, 3, 0.85, 0.6
#: Code points of a landmark at most; inserted ones that a window has room for at least; code points of a piece of a longer term (two windows at least).
WIDTH, SLACK, PIECE = 24, 2, 96
#: Toxic documents of the sample that a landmark must be in.
LEAST = 3
#: The stretched kernel from which a sentence is taken to hold a landmark at first.
STRONG = 0.7
THRESHOLD = 0.3
#: Ways to lack letters that are tried for a bound; a landmark with more has none.
MOST_WAYS = 20_000

# Signs read as letters within a word.
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
_READ = str.maketrans(LOOKALIKES)

_EDGE = re.compile(r"^[^\w@$]+|[^\w]+$")
_SIGNS = re.compile(r"[^\w]|_")
_SPACED = re.compile(r"(?<!\w)\w(?:[ .*_-]\w(?!\w)){2,}")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n")


def term(token: str) -> str:
    """A lower-cased token as a term, without its end marks."""
    if token.isalpha():
        return token
    # The usual case: a word and one sign at its end.
    if token[-1:] in ".,;:!?" and token[:-1].isalpha():
        return token[:-1]
    token = _EDGE.sub("", token)
    if any(c.isalpha() for c in token):
        token = token.translate(_READ)
    return _SIGNS.sub("", token)


def spaced(text: str) -> list[str]:
    """Runs of spaced letters of a lower-cased text, each as one token. None crosses a sentence's end."""
    return ["".join(c for c in m if c.isalnum()) for m in _SPACED.findall(text)]


def tokens(text: str) -> set[str]:
    """Distinct tokens of a lower-cased text: what blanks delimit, and spaced letters as one."""
    return {*text.split(), *spaced(text)}


def _codes(words: list[str], width: int) -> np.ndarray:
    """Code points of strings, a row each, 0 beyond their ends."""
    return np.array(words, f"<U{width}").view(np.uint32).reshape(len(words), width) if words else np.zeros((0, width), np.uint32)


def subsequence_kernel(s: np.ndarray, t: np.ndarray, order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """The gap-weighted kernel of each row of s (0 beyond its end) with the same row of t, or with t."""
    n, a, b = len(s), s.shape[1], t.shape[-1]
    t = np.broadcast_to(t, (n, b))
    same = np.ascontiguousarray(((s[:, :, None] == t[:, None, :]) & (s[:, :, None] > 0)).transpose(1, 2, 0)).astype(np.float32)
    decay = np.float32(decay)
    same *= decay * decay
    prefix = np.ones((a + 1, b + 1, n), np.float32)
    for _ in range(order - 1):
        after = np.zeros((a + 1, b + 1, n), np.float32)
        for i in range(a):
            row = np.zeros(n, np.float32)
            for j in range(b):
                row = decay * row + same[i, j] * prefix[i, j]
                after[i + 1, j + 1] = decay * after[i, j + 1] + row
        prefix = after
    return (same * prefix[:-1, :-1]).sum((0, 1)).astype(np.float64)


@lru_cache(4096)
def least_shared(mark: str, order: int = ORDER, decay: float = DECAY, floor: float = FLOOR) -> int:
    """How many of a landmark's letters a window must have for a likeness above the floor.

    By the Cauchy-Schwarz inequality a window's normalised kernel is at most the norm of the landmark's features that the
    window can have, as a share of all. Those are the subsequences whose letters it has; the bound is the largest over
    all ways to lack so many letters, with both end marks there.
    """
    found: Counter = Counter()
    for at in combinations(range(len(mark)), order):
        found["".join(mark[i] for i in at)] += decay ** (at[-1] - at[0] + 1)
    inner = mark.strip("^$")
    letters = sorted(set(inner))
    held = np.array([[u.count(c) for c in letters] for u in found])
    norm = np.array(list(found.values())) ** 2
    for lack in range(1, len(inner)):
        if math.comb(len(inner), lack) > MOST_WAYS:
            break
        ways = {tuple(inner.count(c) - x.count(c) for c in letters) for x in combinations(inner, lack)}
        if max(norm[(held <= np.array(w)).all(1)].sum() for w in ways) <= floor * floor * norm.sum():
            return len(inner) - lack + 1
    return 1


def _named(s: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """A value for each row of s, whose entries are 0 or such letters: equal for equal rows only."""
    known = np.unique(letters)
    digits = np.where(s > 0, np.searchsorted(known, s) + 1, 0)
    if s.shape[1] * math.log2(len(known) + 1) < 63:
        return digits @ (len(known) + 1) ** np.arange(s.shape[1])
    return np.ascontiguousarray(digits.astype(np.uint8)).view(f"V{s.shape[1]}")[:, 0]


def kernel(pieces: list[str], landmarks: list[str], width: int) -> np.ndarray:
    """The likeness of strings (of `width` letters at most) and landmarks, a row for each string.

    Of a string's windows with room for a letter in every gap of the landmark, the one that fits best counts. Letters
    that the landmark hasn't are taken out of it (their places stay). The normalised kernel from FLOOR to 1 is stretched
    to 0 to 1; what has too few of the landmark's letters to come above FLOOR (`least_shared`) is 0 without a look.
    """
    codes = _codes(pieces, width)
    length = (codes > 0).sum(1)
    total = {c: (codes == ord(c)).sum(1, dtype=np.int8) for c in sorted({c for x in landmarks for c in x})}
    needs = [Counter(x.strip("^$")) for x in landmarks]
    enough = [sum(np.minimum(total[c], n) for c, n in need.items()) >= least_shared(x) for x, need in zip(landmarks, needs, strict=True)]
    # What has too few letters of every landmark is done with.
    some = np.flatnonzero(np.logical_or.reduce(enough)) if landmarks else np.zeros(0, np.int64)
    full, codes, length = np.zeros((len(pieces), len(landmarks))), codes[some], length[some]
    out = np.zeros((len(some), len(landmarks)))
    upto = {}
    for c in total:
        upto[c] = np.zeros((len(codes), width + 1), np.int8)
        np.cumsum(codes == ord(c), axis=1, dtype=np.int8, out=upto[c][:, 1:])
    for j, (mark, need) in enumerate(zip(landmarks, needs, strict=True)):
        least = least_shared(mark)
        rows = np.flatnonzero(enough[j][some])
        window = len(mark) + max(SLACK, sum(need.values()) - 1)
        goal = _codes([mark], len(mark))[0]
        own = subsequence_kernel(goal[None], goal)[0]
        held = {c: upto[c][rows] for c in need}
        best = np.zeros(len(rows))
        lives, windows = [], []
        for lo in range(width - 2):
            hi = min(lo + window, width)
            live = (lo == 0) | (length[rows] > lo + window - 1)
            live = np.flatnonzero(live & (sum(np.minimum(held[c][:, hi] - held[c][:, lo], n) for c, n in need.items()) >= least))
            if len(live):
                lives.append(live)
                windows.append(np.pad(codes[rows[live], lo:hi], ((0, 0), (0, window - (hi - lo)))))
        if not lives:
            continue
        live, s = np.concatenate(lives), np.concatenate(windows)
        s = np.where(np.isin(s, goal), s, 0)
        # The kernel doesn't change when a window moves, so many windows are one.
        at = (s > 0).argmax(1)[:, None] + np.arange(window)
        s = np.where(at < window, np.take_along_axis(s, np.minimum(at, window - 1), 1), 0)
        _, pick, of = np.unique(_named(s, goal), return_index=True, return_inverse=True)
        s = s[pick]
        k = subsequence_kernel(s, goal)
        may = np.flatnonzero(k > 0)
        k[may] /= np.sqrt(subsequence_kernel(s[may], s[may]) * own)
        np.maximum.at(best, live, k[of])
        out[rows, j] = np.maximum(best - FLOOR, 0) / (1 - FLOOR)
    full[some] = out
    return full


@dataclass
class Model:
    landmarks: list[str]
    whiten: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def features(self, terms: list[str], block: int = 60_000) -> dict[str, np.ndarray]:
        """Kernels with the landmarks of those terms that have any above FLOOR (as FLOOR to 1 stretched to 0 to 1)."""
        found: dict[str, np.ndarray] = {}
        for long, size in ((False, WIDTH), (True, PIECE)):
            some = [t for t in terms if (len(t) + 2 > WIDTH) == long]
            for lo in range(0, len(some), block * WIDTH // size):
                found |= self._features(some[lo : lo + block * WIDTH // size], size)
        return found

    def _features(self, terms: list[str], piece: int) -> dict[str, np.ndarray]:
        pieces, owner = [], []
        for k, t in enumerate(terms):
            t = f"^{t}$"
            if len(t) <= piece:
                pieces.append(t)
                owner.append(k)
                continue
            for lo in range(0, len(t) - piece // 2, piece // 2):
                pieces.append(t[lo : lo + piece])
                owner.append(k)
        k = kernel(pieces, self.landmarks, piece)
        out: dict[str, np.ndarray] = {}
        for r in np.flatnonzero(k.any(1)).tolist():
            t = terms[owner[r]]
            out[t] = np.maximum(out[t], k[r]) if t in out else k[r]
        return out

    def instances(self, text: str, known: dict[str, np.ndarray], runs: list[str] | None = None) -> np.ndarray:
        """Features of the sentences that have any (known: features by token; runs: spaced(text), if it is there already)."""
        runs = spaced(text) if runs is None else runs
        has = known.keys()
        if has.isdisjoint(text.split()) and has.isdisjoint(runs):
            return np.zeros((0, len(self.landmarks)))
        out = []
        for sentence in _SENTENCE.split(text):
            words = tokens(sentence) if runs else sentence.split()
            if not has.isdisjoint(words):
                out.append(np.max([known[x] for x in has & set(words)], 0))
        return np.array(out).reshape(-1, len(self.landmarks))

    def known(self, texts: list[str], runs: list[list[str]] | None = None) -> dict[str, np.ndarray]:
        """Features by token for all tokens of some lower-cased texts."""
        raw: set[str] = set()
        for k, t in enumerate(texts):
            raw.update(t.split(), spaced(t) if runs is None else runs[k])
        named = {x: term(x) for x in raw}
        found = self.features(sorted({t for t in named.values() if t}))
        return {x: found[t] for x, t in named.items() if t in found}

    def margin(self, rows: np.ndarray) -> np.ndarray:
        return rows @ self.whiten @ self.weights + self.bias

    def scores(self, texts: list[str | None], block: int = 4_000_000) -> np.ndarray:
        """Scores of texts, some MB of them at a time."""
        out, lo, size = [np.zeros(0)], 0, 0
        for k, t in enumerate(texts):
            size += len(t or "")
            if size > block or k + 1 == len(texts):
                out.append(self._scores([(t or "").lower() for t in texts[lo : k + 1]]))
                lo, size = k + 1, 0
        return np.concatenate(out)

    def _scores(self, low: list[str]) -> np.ndarray:
        runs = [spaced(t) for t in low]
        known = self.known(low, runs)
        top = np.array([max([self.bias, *self.margin(self.instances(t, known, r))]) for t, r in zip(low, runs, strict=True)])
        return 1 / (1 + np.exp(-np.clip(self.slope * top + self.shift, -40, 40)))


def _spread(texts: list[str], toxic: list[int]) -> list[int]:
    """Indices of documents without those that share most of their tokens with one before (copies would weigh too much)."""
    seen: set[tuple] = set()
    out = []
    for i, t in enumerate(texts):
        words = [w.encode() for w in set(t.split())]
        low = [min((xxhash.xxh3_64_intdigest(w, seed) for w in words), default=0) for seed in range(6)]
        keys = {(toxic[i], k, low[k], low[k + 1]) for k in (0, 2, 4)}
        if not keys & seen:
            out.append(i)
        seen |= keys
    return out


def find_landmarks(texts: list[str], toxic: list[int], most: int = LANDMARKS) -> list[str]:
    """Words and word beginnings that go with toxic documents far more than chance has it."""
    counts = (Counter(), Counter())
    seen = np.zeros(1 << 22, np.uint8)  # an upper bound of each fragment's count, by its hash: most occur once, and aren't kept
    for label, final in ((1, False), (1, True), (0, True)):
        for t, y in zip(texts, toxic, strict=True):
            if y != label:
                continue
            found = set()
            for w in {term(x) for x in tokens(t)}:
                if 3 <= len(w) <= WIDTH - 2:
                    found.add(f"^{w}$")
                    found.update(f"^{w[:n]}" for n in range(4, min(len(w), 9)))
            if not final:
                places = np.unique(np.fromiter((hash(f) & 0x3FFFFF for f in found), np.int64, len(found)))
                seen[places] = np.minimum(seen[places], 250) + 1
            else:
                counts[y].update(f for f in found if (seen[hash(f) & 0x3FFFFF] >= LEAST if label else f in counts[1]))
    n, p = len(texts), sum(toxic)
    if not p or p == n:
        return []
    rate = p / n
    scored = []
    for f, a in counts[1].items():
        b = counts[0][f]
        share = a / (a + b)
        if a >= LEAST and share > max(0.5, 2 * rate):
            gain = a * math.log(share / rate) + (b * math.log((1 - share) / (1 - rate)) if b else 0)
            if gain > 12:
                scored.append((-gain, -len(f), f))
    chosen: list[str] = []
    for _, _, f in sorted(scored):
        stem = f.rstrip("$")
        if not any(stem.startswith(c.rstrip("$")) or c.startswith(stem) for c in chosen):
            chosen.append(f)
            if len(chosen) == most:
                break
    return chosen


def _machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 10.0) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge loss, by Newton steps."""
    x1 = np.c_[x, np.ones(len(x))]
    w = np.zeros(x1.shape[1])
    ridge = np.ones(len(w))
    ridge[-1] = 1e-3
    for _ in range(30):
        live = y * (x1 @ w) < 1
        c = cost * weight[live]
        a = (x1[live] * c[:, None]).T @ x1[live] + np.diag(ridge)
        new = np.linalg.solve(a, x1[live].T @ (c * y[live]))
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w[:-1], float(w[-1])


def train(texts: list[str], toxic: list[int], rounds: int = 4) -> Model:
    """Fit a model; without labels of both classes, or landmarks, one that scores all alike, below the threshold."""
    texts = [t.lower() for t in texts]
    use = _spread(texts, toxic)
    marks = find_landmarks([texts[i] for i in use], [toxic[i] for i in use])
    m = len(marks)
    model = Model(marks, np.eye(m), np.zeros(m), -1.0, 1.0, -3.0)
    if not marks:
        return model
    gram = kernel(marks, marks, WIDTH)
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)  # best windows make it asymmetric by a little
    model.whiten = vectors / np.sqrt(np.maximum(values, 0.05)) @ vectors.T
    bags = []
    for lo in range(0, len(texts), 1000):
        known = model.known(texts[lo : lo + 1000])
        bags += [b if len(b := model.instances(t, known)) else np.zeros((1, m)) for t in texts[lo : lo + 1000]]
    y = np.where(np.array(toxic) == 1, 1.0, -1.0)
    rows, of = np.concatenate(bags), np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    # Of a toxic document's sentences those are toxic that hold a landmark, as far as the machine keeps them so, and the highest one.
    chosen = rows.max(1) >= STRONG
    height = rows.sum(1)
    for _ in range(rounds):
        order = np.lexsort((-height, of))
        best = np.zeros(len(rows), bool)
        best[order[np.r_[True, of[order][1:] != of[order][:-1]]]] = True
        use = (y[of] < 0) | chosen | best
        goal = y[of[use]]
        weight = np.where(goal > 0, 0.5 / max((goal > 0).sum(), 1), 0.5 / max((goal < 0).sum(), 1)) * len(y)
        model.weights, model.bias = _machine(rows[use] @ model.whiten, goal, weight)
        height = model.margin(rows)
        chosen = height > 0
    top = np.array([b[model.margin(b).argmax()] for b in bags])
    f = model.margin(top)
    a, b, goal = 1.0, 0.0, np.where(y > 0, 1 - 1 / ((y > 0).sum() + 2), 1 / ((y < 0).sum() + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * f + b, -40, 40)))
        v, g = np.maximum(p * (1 - p), 1e-9), p - goal
        h = np.array([[(v * f * f).sum() + 1e-3, (v * f).sum()], [(v * f).sum(), v.sum() + 1e-3]])
        step = np.linalg.solve(h, [(g * f).sum() + 1e-3 * a, g.sum() + 1e-3 * b])
        a, b = a - step[0], b - step[1]
    model.slope, model.shift = max(float(a), 1e-3), float(b)
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN, most_bytes: int = MOST_BYTES) -> Model:
    """Train on labelled documents that aren't held out: the ids of most_toxic and most_clean at most, the first by a hash of the id, and most_bytes of their texts. Contradictory labels of an id count as toxic."""
    graded = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("_toxic"))
    order = F.xxhash64("doc_id")
    some = graded.where("_toxic = 1").orderBy(order, "doc_id").limit(most_toxic).unionByName(graded.where("_toxic = 0").orderBy(order, "doc_id").limit(most_clean))
    rows = bounded_rows(docs, some, most_bytes).select("d", "t", "_toxic")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The model of all rows, in order of id and text; in a task, so that the driver's memory has neither texts nor counts."""
        own = sorted(x for b in batches for x in zip(*(c.to_pylist() for c in b.columns), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(vars(train([t for _, t, _ in own], [y for _, _, y in own])))], pa.binary())], names=["model"])

    made = rows.coalesce(1).mapInArrow(run, T.StructType([T.StructField("model", T.BinaryType())])).first()
    return Model(**pickle.loads(made["model"])) if made else train([], [])


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with score (0 to 1; null and empty texts get the score of a text without insults) and predicted (score >= 0.3). Columns of these names are replaced."""

    def fn(batch: pa.RecordBatch) -> dict:
        s = model.scores(batch.column(text).to_pylist())
        return {"score": pa.array(s.astype(np.float64)), "predicted": pa.array((s >= THRESHOLD).astype(np.int32))}

    return map_batches(docs, fn, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
