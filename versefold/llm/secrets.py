"""Secret scans by a battery of randomness tests, in DataFrame operations only.

Base patterns find assignments, access keys and hexadecimal strings. Further candidates are runs of 16 or more letters,
digits and +/_=-; each is tested in the smallest alphabet that covers it (digits, hexadecimal, letters or base 36 in one
case, letters of both, base 64; signs only part groups, except in base 64) for what random draws from it show: uniform
counts (chi-squared), runs about the alphabet's middle, and no serial correlation. The largest of the three deviations is
its statistic. All different words of the corpus, run together, take the same tests as decoys: they give each statistic its p-value for
natural text within a length class (letters drawn one by one would not: words repeat letters less evenly and more
regularly than chance has it, which passes for randomness). False discoveries are controlled by class
(Storey's share of nulls, Benjamini-Hochberg over bins of the statistic, from counts over all texts). What passes, and
doesn't meet a base span, gives spans of the kind `random`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_checkpoint, table
from .native import digest, overlaps, pieces, placed

KINDS = ["assign", "access", "hex"]
RESULTS = [*(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
_WORDS = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
# Possessive forms of the base patterns, which match alike in linear time.
_PATTERNS = {
    "assign": (rf"(?:{_WORDS})[\"']?\x20*+[:=]\x20*+[\"']?[A-Za-z0-9+/_.=-]++", "[:=]"),
    "access": (r"AKIA[A-Z0-9]++", "AKIA"),
    "hex": (r"(?<![0-9a-f])[0-9a-f]{16,}+", None),
    "token": (r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}+", None),
}
# The alphabets of the encodings.
ALPHABETS = {
    "digits": "0123456789",
    "hex": "0123456789abcdef",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "letters": "abcdefghijklmnopqrstuvwxyz",
    "mixed": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
}
#: The false-discovery rate, the deviation beyond which a string isn't random, bins to a unit of it, and the number of bins and length classes.
RATE, DEVIATION, PER_UNIT, BINS, CLASSES = 0.05, 3.5, 10, 100, 8
#: Decoys of the longest class at least; letters of a run that decoys are cut from; letters and digits that a token needs to be tested.
DECOYS, RUN, BARE = 1000, 4096, 8


def _valid() -> Column:
    value = F.regexp_extract("m", r"^[A-Za-z_]+[\"']?\x20*[:=]\x20*[\"']?(.+)$", 1)
    return F.when(F.col("kind") == "assign", F.length(value) >= 12).when(F.col("kind") == "access", F.length("m") >= 18).when(F.col("kind") == "hex", F.length("m") >= 16).otherwise(False)


def bare(m: Column) -> Column:
    return F.regexp_replace(m, "[^A-Za-z0-9]", "")


def encoding(m: Column) -> Column:
    """The smallest alphabet that covers a string's characters; null if it is nearly all signs."""
    lower, upper, digit = (m.rlike(x) for x in ("[a-z]", "[A-Z]", "[0-9]"))
    b = bare(m)
    return (
        F.when(F.length(b) < BARE, None)
        .when(~lower & ~upper, "digits")
        .when(b.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$") & digit, "hex")
        .when((lower != upper) & digit, "base36")
        .when(lower != upper, "letters")
        .when(m.rlike("^[A-Za-z]+=*$"), "mixed")
        .otherwise("base64")
    )


def deviation(t: Column, alphabet: str) -> Column:
    """The largest deviation of a string from random draws from an alphabet, in standard deviations."""
    k, n = len(alphabet), F.length(t).cast("double")
    letters = F.array(*[F.lit(c) for c in alphabet])
    squares = F.aggregate(letters, F.lit(0.0), lambda s, c: s + F.pow(n - F.length(F.replace(t, c, F.lit(""))), 2))
    chi, df = squares * k / n - n, float(k - 1)
    uniform = (F.pow(F.greatest(chi, F.lit(0.0)) / df, 1 / 3) - (1 - 2 / (9 * df))) / (2 / (9 * df)) ** 0.5
    bits = F.translate(t, alphabet, "0" * (k // 2) + "1" * (k - k // 2))
    without = lambda x: F.length(F.replace(bits, F.lit(x), F.lit("")))
    n1, n0 = n - without("1"), n - without("0")
    runs = 1 + (n - without("01") + n - without("10")) / 2
    mean = 2 * n1 * n0 / n + 1
    spread = F.sqrt(F.greatest((mean - 1) * (mean - 2) / (n - 1), F.lit(1e-9)))
    chain = F.when(mean > 2.5, F.abs(runs - mean) / spread).otherwise(F.lit(10.0))
    start = F.struct(F.lit(-1.0).alias("last"), F.lit(0.0).alias("s"), F.lit(0.0).alias("q"), F.lit(0.0).alias("xy"))

    def step(a: Column, c: Column) -> Column:
        x = F.instr(F.lit(alphabet), c).cast("double")
        return F.struct(x.alias("last"), (a["s"] + x).alias("s"), (a["q"] + x * x).alias("q"), (a["xy"] + F.when(a["last"] < 0, 0.0).otherwise(a["last"] * x)).alias("xy"))

    def finish(a: Column) -> Column:
        variance = a["q"] - a["s"] * a["s"] / n
        return F.when(variance > 0, F.abs((a["xy"] - (n - 1) * F.pow(a["s"] / n, 2)) / variance) * F.sqrt(n)).otherwise(F.lit(10.0))

    serial = F.aggregate(F.split(t, ""), start, step, finish)
    return F.greatest(uniform, chain, serial)


def tested(tokens: DataFrame) -> DataFrame:
    """tokens (m) with enc, stat (null without an encoding) and the length class."""
    out = tokens.withColumn("enc", encoding(F.col("m")))
    text = F.col("m")
    plain = F.when(F.col("enc") == "base64", F.translate(text, "-_=", "+/")).when(F.col("enc") == "mixed", bare(text)).otherwise(F.lower(bare(text)))
    out = out.withColumn("_plain", plain).where("enc is not null")
    parts = [out.where(F.col("enc") == e).withColumn("stat", deviation(F.col("_plain"), a)) for e, a in ALPHABETS.items()]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    size = F.least(F.floor(2 * F.log2(F.length("_plain") / 16.0)), F.lit(CLASSES - 1)).cast("int")
    return every.withColumn("cls", F.greatest(size, F.lit(0))).withColumn("bin", F.least(F.floor(F.greatest("stat", F.lit(0.0)) * PER_UNIT), F.lit(BINS)).cast("int")).drop("_plain")


def decoys(docs: DataFrame, text: str) -> DataFrame:
    """(m): strings of all length classes, made of all different words of the corpus (3 to 15 letters) run together.

    Each word is in decoys of each class. The words stand in order of a hash, in runs of about RUN letters, and each run
    is cut up once for each class, to the last letter. A corpus of few words takes as many rounds, each in another order,
    as give DECOYS decoys of the longest class.
    """
    found = F.regexp_extract_all(F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), F.lit(r"(?<![a-z0-9+/_=-])[a-z]{3,15}+(?![a-z0-9+/_=-])"), F.lit(0))
    words = shared_checkpoint(docs.select(F.explode(F.array_distinct(found)).alias("w")).distinct())
    size = words.agg(F.coalesce(F.sum(F.length("w")), F.lit(0)).alias("_t"))
    # Without any words, two halves of the alphabet.
    halves = docs.sparkSession.range(2).select(F.when(F.col("id") == 0, "abcdefghijklm").otherwise("nopqrstuvwxyz").alias("w"))
    words = words.unionByName(halves.crossJoin(F.broadcast(size.where("_t = 0"))).select("w"))
    longest = 16 * 2 ** (CLASSES / 2)
    words = words.crossJoin(F.broadcast(size.select(F.when(F.col("_t") == 0, 26).otherwise(F.col("_t")).alias("_t"))))
    words = words.withColumn("_r", F.ceil(DECOYS * longest / F.col("_t")).cast("int"))
    h = F.xxhash64("w", "_i")
    words = words.withColumn("_i", F.explode(F.sequence(F.lit(1), "_r"))).withColumn("_b", F.pmod(h, F.ceil(F.col("_t") * F.col("_r") / RUN)))
    run = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(h.alias("h"), "w"))), lambda x: x["w"]), "")
    runs = words.groupBy("_b").agg(run.alias("_s")).withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(CLASSES - 1))))
    low = F.pow(F.lit(2.0), F.col("_c") / 2.0) * 16
    size = F.floor(low + F.pmod(F.xxhash64("_b", "_c"), F.lit(1000)) / 1000.0 * low * 0.4142).cast("int")
    cut = runs.withColumn("_n", F.when(F.col("_c") == 0, size).otherwise(size + 1)).withColumn("_k", F.greatest(F.floor((F.length("_s") - 16) / F.col("_n")), F.lit(0)).cast("int"))
    # What is left of a run is a decoy of its own, or, below 16 letters, part of the one before.
    cut = cut.withColumn("_j", F.explode(F.sequence(F.lit(0), "_k")))
    return cut.select(F.substr("_s", F.col("_j") * F.col("_n") + 1, F.when(F.col("_j") < F.col("_k"), F.col("_n")).otherwise(F.length("_s"))).alias("m"))


def passing(counts: DataFrame) -> DataFrame:
    """(cls, bin) whose candidates pass. counts: (cls, bin, targets, decoys) over all texts; CLASSES times BINS rows at most."""
    spark = counts.sparkSession
    grid = spark.range(CLASSES * (BINS + 1)).select((F.col("id") % CLASSES).cast("int").alias("cls"), F.floor(F.col("id") / CLASSES).cast("int").alias("bin"))
    full = grid.join(counts, ["cls", "bin"], "left").fillna(0)
    by, all_ = Window.partitionBy("cls").orderBy("bin"), Window.partitionBy("cls")
    full = full.withColumn("t", F.sum("targets").over(all_)).withColumn("r", F.sum("targets").over(by))
    full = full.withColumn("p", (F.sum("decoys").over(by) + 1) / (F.sum("decoys").over(all_) + 1))
    nulls = F.least(F.lit(1.0), 2 * (F.sum(F.when(F.col("p") > 0.5, F.col("targets")).otherwise(0)).over(all_) + 1) / F.greatest("t", F.lit(1)))
    full = full.withColumn("q", nulls * F.col("t") * F.col("p") / F.greatest("r", F.lit(1)))
    full = full.withColumn("q", F.min("q").over(by.rowsBetween(0, Window.unboundedFollowing)))
    return full.where((F.col("q") <= RATE) & (F.col("bin") < DEVIATION * PER_UNIT)).select("cls", "bin")


def find_secrets(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """For each row of docs, the kept columns, n_assign, n_access, n_hex, base_sha256 and spans (kind:start:end, code points, by start).

    A null text is empty. Each row stands for itself; repeated rows get equal results. A text without any match has
    counts of 0 and empty spans. Whole texts count, however long. Columns of docs that aren't kept don't matter, whatever
    their names; a kept one that has a result's name is replaced by it.
    """
    keep = [c for c in keep if c not in RESULTS]
    named = {c: f"_k{i}" for i, c in enumerate(keep)}
    own = list(named.values())
    inner = docs.select(*[F.col(c).alias(n) for c, n in named.items()], F.col(text).alias("_text"))
    rows = placed(pieces(inner, own, "_text", _PATTERNS)).drop("tail", "head", "plen", "i")
    rows = rows.withColumn("base", F.coalesce(_valid(), F.lit(False)))
    # What isn't valid stays as a row without a kind: each text keeps a row.
    rows = rows.withColumn("kind", F.when(F.col("base") | (F.col("kind") == "token"), F.col("kind")))
    rows = shared_checkpoint(rows.withColumn("meets", overlaps(rows, "base")).select("rid", *own, "kind", "start", "end", "m", "meets"))
    token = F.col("kind") == "token"
    null = tested(shared_checkpoint(decoys(inner, "_text"))).groupBy("cls", "bin").agg(F.lit(0).cast("long").alias("targets"), F.count("*").alias("decoys"))
    tokens = shared_checkpoint(tested(rows.where(token & ~F.col("meets")).select("rid", *own, "start", "end", "m")))
    counts = tokens.groupBy("cls", "bin").agg(F.count("*").alias("targets"), F.lit(0).cast("long").alias("decoys")).unionByName(null).groupBy("cls", "bin").agg(F.sum("targets").alias("targets"), F.sum("decoys").alias("decoys"))
    good = shared_checkpoint(passing(counts))
    new = tokens.join(F.broadcast(good), ["cls", "bin"], "left_semi").select("rid", *own, F.lit("random").alias("kind"), "start", "end")
    kept = rows.select("rid", *own, "kind", "start", "end")
    return digest(kept.unionByName(new), own, KINDS, "random").withColumnsRenamed({n: c for c, n in named.items()})


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"), ["doc_id"])
