"""Spans of patterns as DataFrame operations: where each match starts and ends, in code points.

Spark's functions return matches without their places. Splitting at the same pattern gives the pieces between them, so
a match starts after all pieces up to it and all matches before it; these sums run over rows, one for each match, so
that a text with many matches costs no more than its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters of context that stay with a match on either side.
CONTEXT = 64


def pieces(docs: DataFrame, keep: list[str], text: str, patterns: dict[str, tuple[str, str | None]]) -> DataFrame:
    """Rows (rid, *keep, kind, i, plen, tail, head, m), and one with a null kind for a text without matches.

    patterns: by kind, the pattern and a plainer one that a text must hold for it to be tried (or None).
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), *keep, t.alias("_t"))
    found = {k: F.regexp_extract_all("_t", F.lit(p), F.lit(0)) for k, (p, _) in patterns.items()}
    none = F.array().cast("array<string>")
    rows = rows.select("rid", *keep, "_t", *[(F.when(F.col("_t").rlike(patterns[k][1]), m).otherwise(none) if patterns[k][1] else m).alias(f"_m_{k}") for k, m in found.items()])
    rows = rows.select("rid", *keep, *[f"_m_{k}" for k in patterns], *[F.when(F.size(f"_m_{k}") > 0, F.split("_t", p, -1)).otherwise(none).alias(f"_p_{k}") for k, (p, _) in patterns.items()])

    def zipped(kind: str) -> Column:
        return F.transform(F.arrays_zip(f"_p_{kind}", f"_m_{kind}"), lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), x[f"_p_{kind}"].alias("p"), x[f"_m_{kind}"].alias("m")))

    rows = rows.select("rid", *keep, F.explode_outer(F.concat(*[zipped(k) for k in patterns])).alias("_x"))
    return rows.select("rid", *keep, "_x.kind", "_x.i", F.length("_x.p").alias("plen"), F.right("_x.p", F.lit(CONTEXT)).alias("tail"), F.left("_x.p", F.lit(CONTEXT)).alias("head"), "_x.m")


def placed(rows: DataFrame, around: str | None = None) -> DataFrame:
    """pieces() with start and end of the matches; `around` names a kind whose matches get the text before and after, of CONTEXT characters, as tail and head."""
    w = Window.partitionBy("rid", "kind").orderBy("i")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    size = F.coalesce(F.length("m"), F.lit(0))
    end = F.sum(F.col("plen").cast("long") + size).over(upto)
    out = rows.withColumn("end", end).withColumn("start", F.col("end") - size)
    if around is not None:
        # Other matches may stand close by; three of them are as many words.
        back = lambda c, k: F.coalesce(F.right(F.lag(c, k).over(w), F.lit(CONTEXT)), F.lit(""))
        on = lambda c, k: F.coalesce(F.left(F.lead(c, k).over(w), F.lit(CONTEXT)), F.lit(""))
        before = F.concat(*[back(c, k) for k in (3, 2, 1) for c in ("tail", "m")], "tail")
        after = F.concat(*[on(c, k) for k in (1, 2, 3) for c in ("head", "m")])
        near = F.col("kind") == around
        out = out.withColumns({"tail": F.when(near, F.right(before, F.lit(CONTEXT))), "head": F.when(near, F.left(after, F.lit(CONTEXT)))})
    return out.where("kind is null or m is not null")


def overlaps(rows: DataFrame, base: str) -> Column:
    """Whether a span of rows (rid, start, end) meets a span of its text that is a base one (boolean column)."""
    w = Window.partitionBy("rid").orderBy("start", F.col(base).desc(), "end")
    before = F.max(F.when(F.col(base), F.col("end"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.min(F.when(F.col(base), F.col("start"))).over(w.rowsBetween(0, Window.unboundedFollowing))
    return F.coalesce(before > F.col("start"), F.lit(False)) | F.coalesce(after < F.col("end"), F.lit(False))


def joined(spans: Column) -> Column:
    """kind:start:end of structs (start, rank, kind, end), in order, comma-joined."""
    return F.array_join(F.transform(F.sort_array(spans), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def digest(rows: DataFrame, keep: list[str], kinds: list[str], added: str) -> DataFrame:
    """For each text: n_<kind>, base_sha256 and spans, from rows of base kinds and of the added one (other rows keep the text)."""
    order = [*kinds, added]
    rank = F.coalesce(*[F.when(F.col("kind") == k, F.lit(i)) for i, k in enumerate(order)])
    span = F.struct("start", rank.alias("rank"), "kind", "end")
    out = rows.groupBy("rid", *keep).agg(F.collect_list(F.when(F.col("kind").isin(order), span)).alias("_s"))
    base = F.filter("_s", lambda x: x["rank"] < len(kinds))
    of = lambda i: F.filter("_s", lambda x: x["rank"] == i)
    counts = [F.size(of(i)).cast("long").alias(f"n_{k}") for i, k in enumerate(kinds)]
    return out.select(*keep, *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("_s")).alias("spans"))
