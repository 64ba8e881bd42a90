"""PII by bootstrapped contextual extraction, in DataFrame operations only.

Base patterns find e-mail addresses, IP addresses, card and phone numbers. These are the seeds: identifier-like tokens
(with a digit or @) that meet one. Lexical patterns are the one, two or three words before or after such tokens, in
lower case with # for digits. Patterns and instances form a bipartite graph, which is scored in rounds: a pattern is
admitted once enough different accepted instances stand in it, seeds or such as an earlier round has accepted, and its
confidence is the share of all its occurrences in the corpus that go with good instances; an instance's score is the
chance that its best pattern of either side is right. Instances without a seed that reach ACCEPT give spans of the kind
`context`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_checkpoint, table
from .native import CONTEXT, digest, overlaps, pieces, placed

KINDS = ["email", "ip", "card", "phone"]
RESULTS = [*(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
# Possessive forms of the base patterns, which match alike in linear time.
_PATTERNS = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", "[0-9]"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
    "token": (r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+", "[0-9@]"),
}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: Rounds; different accepted instances that a pattern needs; its least confidence; the score from which an instance is accepted.
ROUNDS, SEEDS, CONFIDENT, ACCEPT, PRIOR = 4, 3, 0.5, 0.8, 2.0
#: Words of a pattern at most.
REACH = 3
#: Up to so many patterns are broadcast to the pass that counts them; more are joined after counting.
BROADCAST = 20_000


def _valid() -> Column:
    digits = F.regexp_replace("m", "[^0-9]", "")
    n = F.length(digits)
    return (
        F.when(F.col("kind") == "email", True)
        .when(F.col("kind") == "ip", F.col("m").rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"))
        .when(F.col("kind") == "card", n.between(12, 19) & F.call_function("luhn_check", digits))
        .when(F.col("kind") == "phone", n.between(9, 15))
        .otherwise(False)
    )


def _shape(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[0-9]+", "#")


def _said(words: Column, side: str) -> Column:
    """Patterns (side, pat) of the words before or after a token: the nearest one, two and three."""
    n = F.size(words)
    part = (lambda k: F.slice(words, n - k + 1, F.lit(k))) if side == "L" else (lambda k: F.slice(words, 1, k))
    return F.array(*[F.when(n >= k, F.struct(F.lit(side).alias("side"), F.array_join(part(k), " ").alias("pat"))) for k in range(1, REACH + 1)])


def _patterns(tail: Column, head: Column) -> Column:
    """The patterns of a token from the text before and after it. A word that the context's edge may have cut is left out."""
    full = lambda c: F.length(c) == CONTEXT
    before = F.when(full(tail), F.regexp_replace(tail, r"^\S*", "")).otherwise(tail)
    after = F.when(full(head), F.regexp_replace(head, r"\S*$", "")).otherwise(head)
    words = lambda c: F.filter(F.split(_shape(c), r"\s+"), lambda x: x != "")
    every = F.concat(_said(words(before), "L"), _said(words(after), "R"))
    return F.filter(every, lambda x: x.isNotNull())


def _totals(docs: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """(pat, total): how often each wanted pattern, a run of words, occurs in all texts."""
    rows = docs.select(F.filter(F.split(_shape(F.coalesce(F.col(text).cast("string"), F.lit(""))), r"\s+"), lambda x: x != "").alias("w"))
    first = F.substring_index("pat", " ", 1)
    heads = shared_checkpoint(wanted.select(first.alias("x")).distinct())
    # Runs are made only where a pattern's first word stands.
    at = lambda k: F.get(F.col("w"), k)
    runs = rows.select(F.inline(F.transform("w", lambda x, i: F.struct(x.alias("x"), at(i + 1).alias("y"), at(i + 2).alias("z")))))
    few = wanted.count() <= BROADCAST
    runs = runs.join(F.broadcast(heads) if few else heads, "x", "left_semi")
    two = F.concat_ws(" ", "x", "y")
    every = F.array(F.col("x"), F.when(F.col("y").isNotNull(), two), F.when(F.col("z").isNotNull(), F.concat_ws(" ", two, "z")))
    runs = runs.select(F.explode(F.filter(every, lambda p: p.isNotNull())).alias("pat"))
    if few:
        return runs.join(F.broadcast(wanted), "pat", "left_semi").groupBy("pat").agg(F.count("*").alias("total"))
    return runs.groupBy("pat").agg(F.count("*").alias("total")).join(wanted, "pat", "left_semi")


def _scored(edges: DataFrame) -> DataFrame:
    """(inst, score) of instances without a seed. edges: (side, pat, inst, n, seed, total), a row for each pattern and instance."""
    scores = edges.groupBy("inst").agg(F.max("seed").alias("_seed")).select("inst", F.col("_seed").cast("double").alias("score"))
    for _ in range(ROUNDS):
        known = edges.join(scores, "inst")
        confidence = F.sum(F.col("n") * F.col("score")) / (F.first("total") + PRIOR)
        patterns = known.groupBy("side", "pat").agg(confidence.alias("c"), F.count_if(F.col("score") >= ACCEPT).alias("k")).where((F.col("k") >= SEEDS) & (F.col("c") >= CONFIDENT))
        best = known.select("side", "pat", "inst", "seed").join(patterns, ["side", "pat"], "left").groupBy("inst").agg(F.max("seed").alias("seed"), *[F.coalesce(F.max(F.when(F.col("side") == s, F.col("c"))), F.lit(0.0)).alias(s) for s in "LR"])
        scores = shared_checkpoint(best.select("inst", F.when(F.col("seed"), 1.0).otherwise(1 - (1 - F.least("L", F.lit(1.0))) * (1 - F.least("R", F.lit(1.0)))).alias("score"), "seed"))
        last, scores = scores, scores.select("inst", "score")
    return last.where(~F.col("seed")).select("inst", "score")


def find_personal(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """For each row of docs, the kept columns, n_email, n_ip, n_card, n_phone, base_sha256 and spans (kind:start:end, code points, by start).

    A null text is empty. Each row stands for itself; repeated rows get equal results. A text without any match has
    counts of 0 and empty spans. Whole texts count, however long; only patterns look no further than CONTEXT characters.
    Columns of docs that aren't kept don't matter, whatever their names; a kept one that has a result's name is replaced by it.
    """
    keep = [c for c in keep if c not in RESULTS]
    named = {c: f"_k{i}" for i, c in enumerate(keep)}
    inner = docs.select(*[F.col(c).alias(n) for c, n in named.items()], F.col(text).alias("_text"))
    own = list(named.values())
    rows = placed(pieces(inner, own, "_text", _PATTERNS), "token")
    rows = rows.withColumn("base", F.coalesce(_valid(), F.lit(False)))
    # What isn't valid stays as a row without a kind: each text keeps a row.
    rows = rows.withColumn("kind", F.when(F.col("base") | (F.col("kind") == "token"), F.col("kind")))
    inst = F.regexp_replace("m", r"^[(\[{<\"']+|[)\]}>\"'.,;:!?]+$", "")
    lead = F.length("m") - F.length(F.regexp_replace("m", r"^[(\[{<\"']+", ""))
    token = F.col("kind") == "token"
    rows = rows.withColumn("start", F.when(token, F.col("start") + lead).otherwise(F.col("start"))).withColumn("m", F.when(token, inst).otherwise(F.col("m")))
    rows = rows.withColumn("end", F.when(token, F.col("start") + F.length("m")).otherwise(F.col("end")))
    rows = rows.withColumn("said", F.when(token, _patterns(F.col("tail"), F.col("head"))))
    rows = shared_checkpoint(rows.withColumn("seed", F.when(token, overlaps(rows, "base")).otherwise(F.lit(False))).select("rid", *own, "kind", "start", "end", "m", "said", "seed"))

    tokens = rows.where("kind = 'token' and m <> ''")
    edges = tokens.select(F.col("m").alias("inst"), "seed", F.inline("said")).groupBy("side", "pat", "inst").agg(F.count("*").alias("n"), F.max("seed").alias("seed"))
    edges = shared_checkpoint(edges)
    # An instance is a seed if it is one anywhere.
    seeds = edges.groupBy("inst").agg(F.max("seed").alias("seed"))
    edges = edges.drop("seed").join(seeds, "inst")
    # Whatever round admits a pattern, it has so many instances.
    usual = edges.groupBy("side", "pat").agg(F.count("*").alias("k")).where(F.col("k") >= SEEDS)
    edges = shared_checkpoint(edges.join(usual, ["side", "pat"], "left_semi"))
    totals = shared_checkpoint(_totals(inner, "_text", shared_checkpoint(edges.select("pat").distinct())))
    edges = shared_checkpoint(edges.join(totals, "pat").select("side", "pat", "inst", "n", "seed", "total"))
    found = _scored(edges).where(F.col("score") >= ACCEPT).select(F.col("inst").alias("m"))
    new = tokens.where(~F.col("seed")).join(found, "m", "left_semi").select("rid", *own, F.lit("context").alias("kind"), "start", "end")
    out = digest(rows.where("kind is null or kind <> 'token'").select("rid", *own, "kind", "start", "end").unionByName(rows.where("kind = 'token'").select("rid", *own, "kind", "start", "end")).unionByName(new), own, KINDS, "context")
    return out.withColumnsRenamed({n: c for c, n in named.items()})


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal(table(spark, sf_dir, "documents"), ["doc_id"])
