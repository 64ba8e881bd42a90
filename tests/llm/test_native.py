"""PII and secret scans against plain Python over the contract's patterns, and what their methods add."""

import hashlib
import math
import random
import re

import pytest

from versefold.llm import pii, secrets

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
ASSIGN = r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for i, c in enumerate(reversed(d))) % 10 == 0


def digits(m):
    return re.sub("[^0-9]", "", m)


PII = [
    ("email", EMAIL, lambda m: True),
    ("ip", IP, lambda m: all(int(x) <= 255 for x in m[0].split("."))),
    ("card", CARD, lambda m: 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))),
    ("phone", PHONE, lambda m: 9 <= len(digits(m[0])) <= 15),
]
SECRETS = [("assign", ASSIGN, lambda m: len(m[1]) >= 12), ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18), ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 16)]


def plain(text, kinds):
    spans = [(m.start(), r, k, m.end()) for r, (k, p, ok) in enumerate(kinds) for m in re.finditer(p, text or "", re.A) if ok(m)]
    return [f"{k}:{s}:{e}" for s, r, k, e in sorted(spans)]


EDGES = [
    None, "", "   ", "a@b.c_d@e.f x@y x@y.z.", "a@b..c a.b@c-d.e.f.g@h.i", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.255.0 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111111111",
    "+1 (988) 555-2485 ++49 30 123456 +1 ((( +123456789012345678", "1" * 50_000, "a" * 50_000 + "@", "x@" + "b." * 20_000 + "c", "+" * 3000 + "1 23456789", "é1.2.3.4ñ a😀b@c.d 4111111111111111", ("7 " * 20_000).strip(), "+1 555 123 4567\n4111 1111\n1111 1111",
    "password=abcdefghijkl PASSWD : 'short' token==aaaaaaaaaaaaaaa api_key\"=\"0123456789ab\" Api_KeY=  x", "secret" + " " * 20_000 + "x", "AKIA" * 9 + " AKIA12345678901234 AKIA1", "0123456789abcdef0 abcdef0123456789g deadbeefdeadbee", "f" * 50_000, "tokentoken=abcdefghijklmnop password=password=aaaaaaaaaaaaaa",
]


def noise(rng):
    bits = ["a", "B", "@", ".", "1", "23", "4111111111111111", " ", "-", "+", "(", ")", "é", "\n", "AKIA", "0f3a", "password", "=", ":", "'", '"', "token", "api_key", "deadbeef", "x.y", "192.168.", "_", "%"]
    return "".join(rng.choice(bits) for _ in range(rng.randint(1, 120)))


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    rng = random.Random(5)
    return EDGES + [noise(rng) for _ in range(600)] + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]


@pytest.mark.parametrize(("find", "kinds", "added"), [(pii.find_personal, PII, "context"), (secrets.find_secrets, SECRETS, "random")])
def test_base_spans(spark, texts, find, kinds, added):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, kind string, start int")
    got = {r.doc_id: r for r in find(df, ["doc_id"]).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = plain(t, kinds)
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), (t or "")[:200]
        for k, _, _ in kinds:
            assert got[i][f"n_{k}"] == sum(w.startswith(k + ":") for w in want)
        assert [s for s in got[i].spans.split(",") if s and not s.startswith(added + ":")] == want


def test_repeated_rows_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a@b.cd"), (1, "a@b.cd"), (None, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_email) for r in pii.find_personal(df, ["doc_id"]).collect()) == [(0, 0), (1, 1), (1, 1)]
    assert pii.find_personal(df.limit(0), ["doc_id"]).count() == 0
    assert secrets.find_secrets(df.limit(0), ["doc_id"]).count() == 0


def bootstrap(texts):
    """The added spans by a plain bootstrap over the same seeds and patterns."""
    import collections

    shape = lambda x: re.sub("[0-9]+", "#", x.lower())
    tokens, totals = [], collections.Counter()
    for d, t in enumerate(texts):
        base = [tuple(map(int, x.split(":")[1:])) for x in plain(t, PII)]
        words = list(re.finditer(r"\S+", t or ""))
        said = [shape(w[0]) for w in words]
        for i in range(len(said)):
            totals.update(" ".join(said[i : i + k]) for k in (1, 2, 3) if i + k <= len(said))
        for i, w in enumerate(words):
            if not re.search("[0-9@]", w[0]):
                continue
            name = re.sub("^[(\\[{<\"']+", "", re.sub("[)\\]}>\"'.,;:!?]+$", "", w[0]))
            start = w.start() + len(w[0]) - len(re.sub("^[(\\[{<\"']+", "", w[0]))
            if name:
                pats = [("L", " ".join(said[i - k : i])) for k in (1, 2, 3) if i >= k] + [("R", " ".join(said[i + 1 : i + 1 + k])) for k in (1, 2, 3) if i + k < len(said)]
                tokens.append((d, start, name, any(a < start + len(name) and start < b for a, b in base), pats))
    seeds = {n for _, _, n, s, _ in tokens if s}
    n = collections.Counter((p, name) for _, _, name, _, pats in tokens for p in pats)
    within = collections.defaultdict(set)
    for p, name in n:
        within[p].add(name)
    score = {name: float(name in seeds) for _, _, name, _, _ in tokens}
    for _ in range(pii.ROUNDS):
        good = {}
        for p, names in within.items():
            c = sum(n[p, x] * score[x] for x in names) / (totals[p[1]] + pii.PRIOR)
            if sum(score[x] >= pii.ACCEPT for x in names) >= pii.SEEDS and c >= pii.CONFIDENT:
                good[p] = c
        best = {x: {"L": 0.0, "R": 0.0} for x in score}
        for p, c in good.items():
            for x in within[p]:
                best[x][p[0]] = max(best[x][p[0]], c)
        score = {x: 1.0 if x in seeds else 1 - (1 - b["L"]) * (1 - b["R"]) for x, b in best.items()}
    return [",".join(f"context:{s}:{s + len(x)}" for s, x in sorted((s, x) for e, s, x, seed, _ in tokens if e == d and not seed and score[x] >= pii.ACCEPT)) for d in range(len(texts))]


def announced(rng, planted):
    """Documents with mail addresses after some phrases, other identifiers after the same and after a second phrase, and numbers after neither."""
    word = lambda: rng.choice(["brown", "river", "table", "under", "cloud", "seven", "often", "paper"])
    text = lambda *x: " ".join([word() for _ in range(rng.randint(0, 9))] + list(x) + [word() for _ in range(rng.randint(0, 9))])
    rows = [text("Account2:", f"user{i}@mail.example.com,", "held", "since", str(rng.randint(1990, 2020))) for i in range(40)]
    rows += [text("please", "write", "to", f"p{i}@x.example.org") for i in range(30)]
    out = []
    for k in range(planted):
        name = f"QX-{rng.randint(10**6, 10**7)}"
        # These stand after a known phrase and a new one, some others after the new one only.
        out.append((text(*(("Account2:", name) if k % 2 else ("please", "write", "to", name))), name))
        out.append((text("Member", "ref", name), name))
        if k % 10 == 0:
            out.append((text("Member", "ref", f"ZT/{rng.randint(10**6, 10**7)}"), None))
    rows += [text("on", "page", str(rng.randint(1, 999)), "of", str(rng.randint(1, 999))) for _ in range(60)]
    rows += [text("version", f"{rng.randint(1, 9)}.{rng.randint(1, 9)}") for _ in range(60)]
    return rows, out


def test_bootstrap_finds_unseen_identifiers(spark):
    rng = random.Random(1)
    rows, planted = announced(rng, 20)
    texts = rows + [t for t, _ in planted] + [None, "", "12 34 56 78 90 Account2: 5", "4 " * 500 + "Account2: Z9", f"{'w' * 300} Account2: Z8 {'w' * 300}"]
    got = {r.doc_id: r.spans for r in pii.find_personal(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), ["doc_id"]).collect()}
    added = [",".join(s for s in got[i].split(",") if s.startswith("context:")) for i in range(len(texts))]
    assert added == bootstrap(texts)
    found = added[len(rows) : len(rows) + len(planted)]
    # All planted ones are found, those too that no seed's phrase announces; of the others none.
    assert sum(map(bool, found)) >= 0.95 * len(planted)
    assert sum(map(bool, added[: len(rows)])) <= 0.05 * len(rows)


def test_context_needs_enough_seeds(spark):
    rows = ["mail a1@b.cd now", "mail a2@b.cd now", "mail X1 now", "the clause the 3rd of it"]
    got = pii.find_personal(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), ["doc_id"]).collect()
    assert all("context" not in r.spans for r in got)


def test_random_strings_are_found(spark):
    rng = random.Random(2)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    words = ["the" + "".join(rng.choice(["tion", "er", "an", "est", "ing", "ou"]) for _ in range(rng.randint(5, 9))) for _ in range(400)]
    keys = ["".join(rng.choice(alphabet) for _ in range(44)) for _ in range(40)]
    keys = [k for k in keys if re.search("[a-z]", k) and re.search("[A-Z]", k) and re.search("[0-9]", k)]
    rows = [f"it is {w} and {w.title()} here" for w in words] + [f"take {k} now" for k in keys] + ["Aa1" * 15, "ZZZZZZZZZZZZZZZZZZZZzzzzzzzzzzzzzzzz1"]
    got = [r.spans for r in sorted(secrets.find_secrets(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), ["doc_id"]).collect())]
    assert not any(got[: len(words)])
    found = got[len(words) : len(words) + len(keys)]
    assert sum(s == "random:5:49" for s in found) >= 0.9 * len(keys)
    assert got[-2:] == ["", ""]


LOWER = "abcdefghijklmnopqrstuvwxyz"


@pytest.mark.parametrize("alphabet", [LOWER, LOWER.upper(), LOWER + LOWER.upper(), LOWER + "0123456789-_", LOWER + LOWER.upper() + "+/", "0123456789"])
def test_random_strings_of_all_alphabets(spark, alphabet):
    rng = random.Random(3)
    words = ["the" + "".join(rng.choice(["tion", "er", "an", "est", "ing", "ou"]) for _ in range(rng.randint(5, 9))) for _ in range(300)]
    keys = ["".join(rng.choice(alphabet) for _ in range(64)) for _ in range(40)]
    rows = [f"it is {w} and {w.title()} here" for w in words] + [f"take {k} now" for k in keys]
    got = [r.spans for r in sorted(secrets.find_secrets(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), ["doc_id"]).collect())]
    assert not any(got[: len(words)])
    # Digits alone are a base span of the kind hex, whatever the tests of randomness say.
    want = "hex:5:69" if alphabet.isdigit() else "random:5:69"
    assert sum(s == want for s in got[len(words) :]) >= (1.0 if alphabet.isdigit() else 0.8) * len(keys)


def test_every_token_has_an_alphabet(spark):
    forms = {"f81d4fae-7dec-11d0-a765-00a0c91e6bf6": "hex", "sk_live_abcdefghijk": "letters", "sk_live_4eC39hqlyjw": "base64", "sk_live_4ec39hqlyjw": "base36", "AbCdEfGh+/IjKlMnOp": "base64", "AbCdEfGhIjKlMnOp": "mixed", "1234567890123456": "digits", "abc=defghijklmnop=": "letters", "a---------------": None}
    df = spark.createDataFrame([(m,) for m in forms], "m string")
    got = {r.m: r.enc for r in df.withColumn("enc", secrets.encoding(df.m)).collect()}
    assert got == forms
    assert all(r.stat is not None for r in secrets.tested(df).collect())


def test_false_discoveries(spark):
    """Random keys of several alphabets among words of a language's letters: most are found, and few words."""
    rng = random.Random(9)
    ends = ["tion", "er", "an", "est", "ing", "ou", "le", "ance", "re", "is", "nt", "al"]
    word = lambda n: "".join(rng.choice(ends) for _ in range(n))
    natural = [word(rng.randint(6, 16)) for _ in range(1500)] + ["_".join(word(2) for _ in range(rng.randint(4, 8))) for _ in range(500)]
    keys = ["".join(rng.choice(a) for _ in range(rng.randint(40, 80))) for a in (LOWER + LOWER.upper() + "0123456789+/", LOWER + "0123456789", LOWER + LOWER.upper()) for _ in range(70)]
    rows = [f"see {w} and {word(2)} there" for w in natural] + [f"see {k} and {word(2)} there" for k in keys]
    spans = [r.spans for r in sorted(secrets.find_secrets(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), ["doc_id"]).collect())]
    false, true = (sum("random:" in s for s in part) for part in (spans[: len(natural)], spans[len(natural) :]))
    assert true >= 0.9 * len(keys)
    assert false / max(true + false, 1) <= secrets.RATE


def test_kept_columns_of_clashing_names(spark):
    df = spark.createDataFrame([(1, "a@b.cd x", "s", 7, "m")], "doc_id long, text string, spans string, n_email int, m string")
    for find in (pii.find_personal, secrets.find_secrets):
        (row,) = find(df, df.columns).collect()
        assert (row.doc_id, row.m, row.text) == (1, "m", "a@b.cd x") and row.spans != "s"


def test_decoys_are_made_of_all_words(spark):
    rng = random.Random(4)
    words = sorted({"".join(rng.choice(LOWER) for _ in range(rng.randint(6, 12))) for _ in range(1500)})
    rows = [(i, " ".join(words[i : i + 100])) for i in range(0, len(words), 100)]
    got = [r.m for r in secrets.decoys(spark.createDataFrame(rows, "doc_id long, text string"), "text").collect()]
    every = "\n".join(got)
    assert [w for w in words if w not in every] == []
    found = {min(max(int(2 * math.log2(len(m) / 16)), 0), secrets.CLASSES - 1) for m in got}
    assert found == set(range(secrets.CLASSES)) and min(len(m) for m in got) >= 16
    for few in ([(1, "abc")], [(1, None)], [(1, "1 2 3")]):
        got = secrets.decoys(spark.createDataFrame(few, "doc_id long, text string"), "text").collect()
        assert len(got) > secrets.CLASSES * secrets.DECOYS and set("".join(r.m for r in got)) == set("abc" if few[0][1] == "abc" else LOWER)
