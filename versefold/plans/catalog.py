"""The queries by name, each with its DuckDB twin.

Books are derived from documents alike in both engines: a front line, `Chapter N: three words` over the first half of
the lines and `CHAPTER N.5` over the rest, lines apart by a blank line and every fifth by a marker or two blank lines.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import chapters as ch
from ..functions import tags as tg
from ..functions import text as tx
from ..operators import chunks as ck
from ..operators import controller as ct
from ..operators import eventlog as ev
from ..operators import packing as pk
from ..operators import resume as rs
from ..operators import segments as sg
from ..operators import tagging as ta
from ..operators import timeline as tl
from ..schema import EVENT
from ..sources.readers import reference_faults
from ..sources.tables import table
from . import twins as tw
from .sums import running_sums

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
TWINS: dict[str, str] = {}


def query(twin: str | None = None) -> Callable:
    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[fn.__name__] = fn
        if twin:
            TWINS[fn.__name__] = twin
        return fn

    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book_id, text) derived from documents."""
    rows = documents(spark, sf_dir).select("doc_id", F.split("text", "\n", -1).alias("l"))
    rows = rows.select("doc_id", "l", (F.size("l") / 2).cast("int").alias("h"), (F.col("doc_id") % 120).cast("string").alias("k"))
    first = F.get("l", F.lit(0))
    title = F.array_join(F.slice(F.split(first, " ", -1), 1, 3), " ")

    def apart(lines: Column) -> Column:
        gap = lambda i: F.when((i % 5 == 4) & (i % 2 == 0), "\n***\n").when(i % 5 == 4, "\n\n\n").otherwise("\n\n")
        return F.array_join(F.transform(lines, lambda x, i: F.concat(x, gap(i))), "")

    rest = F.slice("l", F.col("h") + 1, F.size("l") - F.col("h"))
    body = F.concat(first, F.lit("\nChapter "), F.col("k"), F.lit(": "), title, F.lit("\n"), apart(F.slice("l", F.lit(1), F.col("h"))), F.lit("\nCHAPTER "), F.col("k"), F.lit(".5\n"), apart(rest))
    return rows.select(F.col("doc_id").alias("book_id"), body.alias("text"))


def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sg.split_chapters(books(spark, sf_dir), "text", ["book_id"])


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sg.split_units(chapters(spark, sf_dir), "text", ["book_id", "ordinal", "chapter_id"], normalised=True)


_UNIT = ["book_id", "ordinal", "chapter_id", "unit_id"]


def pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, idx, text): documents plainly packed."""
    sents = documents(spark, sf_dir).select("doc_id", tx.sentences(tx.clean(F.col("text"))).alias("s"))
    return pk.greedy_pack(sents, "s", ["doc_id"], limit=None).select("doc_id", "idx", "text")


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as call outcomes: value is the latency, an error event a server error."""
    rows = table(spark, sf_dir, "events")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return rows.select("user_id", "event_id", "ts", F.col("value").alias("latency_s"), F.when(F.col("event_type") == "error", "server").alias("error"), seq.cast("long").alias("seq"))


# -- segmentation and packing


@query(tw.chain(tw.SIMPLE.split(", grow AS")[0]) + "SELECT doc_id, (i - 1)::INT AS idx, s AS sentence FROM doc_sents")
def sentence_split(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", F.posexplode(tx.sentences(tx.clean(F.col("text")))).alias("idx", "sentence"))
    return rows


@query(tw.chain(tw.SIMPLE.split(", grow AS")[0]) + "SELECT d.doc_id, count(s)::BIGINT AS sentences, coalesce(max(length(s)), 0)::BIGINT AS longest, coalesce(sum(length(s)), 0)::BIGINT AS chars FROM documents d LEFT JOIN doc_sents s ON s.doc_id = d.doc_id GROUP BY d.doc_id")
def sentence_stats(spark, sf_dir):
    s = tx.sentences(tx.clean(F.col("text")))
    rows = documents(spark, sf_dir).select("doc_id", F.transform(s, lambda x: F.length(x).cast("long")).alias("n"))
    return rows.select("doc_id", F.size("n").cast("long").alias("sentences"), F.coalesce(F.array_max("n"), F.lit(0)).cast("long").alias("longest"), F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x).alias("chars"))


@query(tw.chain(tw.SIMPLE) + "SELECT doc_id, idx, text, length(text) > 300 AS over_cap, sha256(text) AS text_hash FROM pieces")
def greedy_pack(spark, sf_dir):
    return pieces(spark, sf_dir).select("doc_id", "idx", "text", (F.length("text") > 300).alias("over_cap"), tx.text_hash(F.col("text")).alias("text_hash"))


_CUT = tw.SIMPLE.replace(", grow AS", f""", doc_cut AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, hi) AS i, h AS s FROM (SELECT doc_id, i, unnest(range(len(hs))) AS hi, unnest(hs) AS h FROM (SELECT doc_id, i, {tw.halves('s', 120)} AS hs FROM doc_sents))
), grow AS""", 1).replace("FROM doc_sents\n  UNION", "FROM doc_cut\n  UNION").replace("JOIN doc_sents s", "JOIN doc_cut s")


@query(tw.chain(_CUT) + "SELECT doc_id, idx, text, length(text) > 300 AS over_cap FROM pieces")
def greedy_pack_cut(spark, sf_dir):
    sents = documents(spark, sf_dir).select("doc_id", tx.sentences(tx.clean(F.col("text"))).alias("s"))
    return pk.greedy_pack(sents, "s", ["doc_id"], limit=120)


@query(tw.chain(tw.SIMPLE) + "SELECT doc_id, idx, length(text)::INT AS char_count FROM pieces WHERE length(text) > 300")
def over_cap_chunks(spark, sf_dir):
    sents = documents(spark, sf_dir).select("doc_id", tx.sentences(tx.clean(F.col("text"))).alias("s"))
    return pk.greedy_pack(sents, "s", ["doc_id"], limit=None).where("over_cap").select("doc_id", "idx", F.length("text").alias("char_count"))


@query(tw.chain(tw.SIMPLE.split(", grow AS")[0]) + f"SELECT doc_id, (i - 1)::INT AS idx, {tw.halves('s', 120)} AS parts FROM doc_sents WHERE length(s) > 120")
def hard_split(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", F.posexplode(tx.sentences(tx.clean(F.col("text")))).alias("idx", "s"))
    return rows.where(F.length("s") > 120).select("doc_id", "idx", tx.split_long(F.col("s"), 120).alias("parts"))


@query(tw.chain(*tw.TO_CHAPTERS) + r"SELECT book_id, ordinal, chapter_id, number, title, sha256(regexp_replace(text, '\n+$', '')) AS text_hash FROM named")
def chapter_detect(spark, sf_dir):
    body = F.regexp_replace("text", r"\n+\z", "")
    return chapters(spark, sf_dir).select("book_id", "ordinal", "chapter_id", "number", "title", tx.text_hash(body).alias("text_hash"))


@query(tw.chain(*tw.TO_UNITS) + "SELECT book_id, ordinal, (row_number() OVER (PARTITION BY book_id, ordinal ORDER BY unit_id))::INT AS unit_no, len(paras)::INT AS paragraphs, sha256(array_to_string(paras, '|')) AS text_hash FROM units")
def packable_units(spark, sf_dir):
    no = F.row_number().over(Window.partitionBy("book_id", "ordinal").orderBy("unit_id"))
    return units(spark, sf_dir).select("book_id", "ordinal", no.alias("unit_no"), F.size("paragraphs").alias("paragraphs"), tx.text_hash(F.array_join("paragraphs", "|")).alias("text_hash"))


@query(tw.chain(*tw.TO_PACKED) + "SELECT book_id, ordinal, unit_id, idx, text, boundary FROM packed")
def paragraph_pack(spark, sf_dir):
    rows = pk.pack_units(sg.split_unit_sentences(units(spark, sf_dir)), "sentences", _UNIT, merge=False)
    return rows.select("book_id", "ordinal", "unit_id", "idx", "text", "boundary")


@query(tw.chain(*tw.TO_BODIES) + "SELECT book_id, ordinal, unit_id, idx, text, boundary FROM bodies")
def small_merge(spark, sf_dir):
    rows = pk.pack_units(sg.split_unit_sentences(units(spark, sf_dir)), "sentences", _UNIT, merge=False)
    item = F.struct("idx", "text", "over_cap", "boundary", "kind")
    lists = rows.groupBy(*_UNIT).agg(F.sort_array(F.collect_list(item)).alias("items"))
    return pk.merge_small(lists, "items", _UNIT).select("book_id", "ordinal", "unit_id", "idx", "text", "boundary")


@query(tw.chain(*tw.TO_CHUNKS) + "SELECT book_id, ordinal, chapter_id, chunk_id, position, text, char_count, text_hash, kind, boundary, over_cap FROM chunks")
def chunk_records(spark, sf_dir):
    return ck.book_chunks(books(spark, sf_dir), "text", ["book_id"]).drop("number")


@query(tw.chain(*tw.TO_CHUNKS) + "SELECT n.book_id, n.ordinal, n.chapter_id, count(c.chunk_id)::BIGINT AS chunk_count FROM named n LEFT JOIN chunks c ON c.book_id = n.book_id AND c.ordinal = n.ordinal GROUP BY ALL")
def chunk_counts(spark, sf_dir):
    rows = ck.book_chunks(books(spark, sf_dir), "text", ["book_id"])
    return ck.chunk_counts(chapters(spark, sf_dir), rows, ["book_id", "ordinal", "chapter_id"])


@query(r"""WITH turns AS (SELECT conv_id AS book_id, 1 AS ordinal, 'ch00' AS chapter_id, 0 AS unit_id, turn, coalesce(text, '') AS p FROM conversations WHERE conv_id IS NOT NULL)
SELECT book_id AS conv_id, count(*)::BIGINT AS turns, sum(length(p))::BIGINT AS chars FROM turns GROUP BY book_id""")
def dialogue_turns(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("conv_id is not null")
    return rows.groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum(F.length(F.coalesce("text", F.lit("")))).cast("long").alias("chars"))


def _dialogue_twin() -> str:
    head = r"units AS (SELECT conv_id AS book_id, 1 AS ordinal, 'ch00' AS chapter_id, 0 AS unit_id, list_filter(list(regexp_replace(regexp_replace(coalesce(text, ''), '\s*\n\s*', ' ', 'g'), '^\s+|\s+$', '', 'g') ORDER BY turn), lambda p: p <> '') AS paras FROM conversations GROUP BY conv_id)"
    return tw.chain(head, tw.UNIT_SENTENCES, tw.PACK, tw.MERGE) + "SELECT book_id AS conv_id, idx, text, boundary FROM bodies"


@query(_dialogue_twin())
def dialogue_pack(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.strip(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s*\n\s*", " ")).alias("p"))
    lists = turns.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "p"))), lambda x: x["p"]).alias("paragraphs"))
    rows = sg.split_unit_sentences(lists.withColumn("paragraphs", F.filter("paragraphs", lambda p: p != "")))
    return pk.pack_units(rows, "sentences", ["conv_id"]).select("conv_id", "idx", "text", "boundary")


# -- chapter numbers and names


@query(tw.chain(*tw.TO_CHAPTERS, tw.TITLES) + "SELECT book_id, ordinal, chapter_id, text AS title_text FROM titles")
def title_chunks(spark, sf_dir):
    rows = chapters(spark, sf_dir).where("number is not null")
    return rows.select("book_id", "ordinal", "chapter_id", ch.chapter_title(F.col("number"), F.col("title")).alias("title_text"))


@query("""WITH num AS (SELECT unnest(range(-120, 1250))::INT AS n), w AS (
  SELECT n, abs(n) AS a, ['', 'one', 'two', 'three', 'four', 'five', 'six', 'seven', 'eight', 'nine', 'ten', 'eleven', 'twelve', 'thirteen', 'fourteen', 'fifteen', 'sixteen', 'seventeen', 'eighteen', 'nineteen'] AS ones,
    ['', '', 'twenty', 'thirty', 'forty', 'fifty', 'sixty', 'seventy', 'eighty', 'ninety'] AS tens FROM num
), t AS (SELECT *, CASE WHEN a % 100 < 20 THEN ones[a % 100 + 1] ELSE tens[a % 100 // 10 + 1] || CASE WHEN a % 10 > 0 THEN '-' || ones[a % 10 + 1] ELSE '' END END AS low FROM w)
SELECT n, CASE WHEN n < 0 THEN 'minus ' ELSE '' END || CASE WHEN a >= 1000 THEN a::VARCHAR WHEN a >= 100 THEN ones[a // 100 + 1] || ' hundred' || CASE WHEN a % 100 > 0 THEN ' ' || low ELSE '' END ELSE low END AS words FROM t""")
def chapter_words(spark, sf_dir):
    return spark.range(-120, 1250).select(F.col("id").cast("int").alias("n"), ch.int_to_words(F.col("id")).alias("words"))


@query(tw.chain(*tw.TO_CHAPTERS) + "SELECT book_id, ordinal, chapter_id FROM named WHERE chapter_id IN ('ch100') OR try_cast(regexp_extract(chapter_id, '^ch([0-9]+)', 1) AS INT) BETWEEN 7 AND 12")
def chapter_select(spark, sf_dir):
    rows = chapters(spark, sf_dir)
    return rows.where(ch.selected(F.col("chapter_id"), "ch07-12") | ch.selected(F.col("chapter_id"), "CH100, ch200")).select("book_id", "ordinal", "chapter_id")


@query(r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS stem FROM documents)
SELECT doc_id, coalesce(nullif(regexp_replace(regexp_replace(stem, '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g'), ''), 'book') AS slug FROM d""")
def slug(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", tx.slug(F.col("text")).alias("slug"))


@query(r"""WITH d AS (SELECT doc_id, source, coalesce(text, '') || '?' AS title FROM documents), s AS (
  SELECT doc_id, coalesce(nullif(regexp_replace(regexp_replace(source, '[<>:"/\\|?*\x00-\x1f]', '_', 'g'), '^[ .]+|[ .]+$', '', 'g'), ''), 'untitled') AS b,
         coalesce(nullif(regexp_replace(regexp_replace(title, '[<>:"/\\|?*\x00-\x1f]', '_', 'g'), '^[ .]+|[ .]+$', '', 'g'), ''), 'untitled') AS t FROM d)
SELECT doc_id, b || '/Chapter ' || lpad((doc_id % 100)::VARCHAR, 2, '0') || ' - ' || t || '.mp3' AS path FROM s""")
def safe_filename(spark, sf_dir):
    title = F.concat("text", F.lit("?"))
    return documents(spark, sf_dir).select("doc_id", tx.chapter_path(F.col("source"), (F.col("doc_id") % 100).cast("int"), title).alias("path"))


# -- hashes, tags


_VOCAB = "[" + ", ".join(f"'{v}'" for v in tg.VOCABULARY) + "]"
_CANDIDATES = tw.SIMPLE + f""", candidates AS (
  SELECT doc_id, idx, text, CASE (doc_id + idx) % 8 WHEN 0 THEN list_extract({_VOCAB}, ((doc_id * 7 + idx) % 30 + 1)::INT) WHEN 1 THEN '' WHEN 2 THEN repeat('a', 33) WHEN 3 THEN 'Weary' WHEN 4 THEN coalesce(nullif(regexp_extract(lower(text), '[a-z]{{3,20}}'), ''), 'cold')
    WHEN 5 THEN 'quietly amused' WHEN 6 THEN 'cold' ELSE NULL END AS tag FROM pieces
)"""
_STOP = "[" + ", ".join(f"'{v}'" for v in tg.STOPWORDS) + "]"
_ECHO = f"list_sort(list_distinct(list_filter(regexp_extract_all(lower(coalesce(tag, '')), '[a-z]+'), lambda w: list_contains(regexp_extract_all(lower(text), '[a-z]+'), w) AND NOT list_contains({_STOP}, w))))"
_REASON = f"""CASE WHEN coalesce(tag, '') = '' THEN 'empty tag' WHEN length(tag) > 32 THEN 'tag exceeds 32 chars (len=' || length(tag) || ')' WHEN NOT regexp_matches(tag, '^[a-z][a-z ,-]*$') THEN 'tag does not match ^[a-z][a-z ,-]*$'
  WHEN len({_ECHO}) > 0 THEN 'tag echoes chunk text word(s): ' || array_to_string({_ECHO}, ', ') WHEN NOT list_contains({_VOCAB}, tag) THEN 'tag not in shipped vocabulary' END"""


def candidates(spark, sf_dir):
    """Pieces with a candidate tag of some kind."""
    vocabulary = F.array(*[F.lit(v) for v in tg.VOCABULARY])
    kind = (F.col("doc_id") + F.col("idx")) % 8
    word = F.coalesce(F.nullif(F.regexp_extract(F.lower("text"), "[a-z]{3,20}", 0), F.lit("")), F.lit("cold"))
    tag = (
        F.when(kind == 0, F.element_at(vocabulary, ((F.col("doc_id") * 7 + F.col("idx")) % 30 + 1).cast("int"))).when(kind == 1, "").when(kind == 2, "a" * 33)
        .when(kind == 3, "Weary").when(kind == 4, word).when(kind == 5, "quietly amused").when(kind == 6, "cold")
    )
    return pieces(spark, sf_dir).withColumn("tag", tag)


@query(tw.chain(_CANDIDATES) + "SELECT doc_id, idx, CASE WHEN coalesce(tag, '') <> '' THEN '[' || tag || '] ' || text ELSE text END AS applied, sha256(CASE WHEN coalesce(tag, '') <> '' THEN '[' || tag || '] ' || text ELSE text END) AS text_hash FROM candidates")
def text_hash(spark, sf_dir):
    return candidates(spark, sf_dir).select("doc_id", "idx", tx.tagged(F.col("text"), F.col("tag")).alias("applied"), tx.text_hash(F.col("text"), F.col("tag")).alias("text_hash"))


@query(tw.chain(_CANDIDATES) + f"SELECT doc_id, idx, tag, {_REASON} AS reason FROM candidates")
def tag_validate(spark, sf_dir):
    return candidates(spark, sf_dir).select("doc_id", "idx", "tag", tg.rejection(F.col("tag"), F.col("text")).alias("reason"))


@query(tw.chain(_CANDIDATES) + f"SELECT doc_id, idx, {_ECHO} AS echoed FROM candidates WHERE len({_ECHO}) > 0")
def tag_echo(spark, sf_dir):
    rows = candidates(spark, sf_dir).select("doc_id", "idx", tg.echoed(F.coalesce("tag", F.lit("")), F.col("text")).alias("echoed"))
    return rows.where(F.size("echoed") > 0)


@query(tw.chain(_CANDIDATES) + f"SELECT doc_id, count_if({_REASON} IS NULL)::BIGINT AS tagged_count, count_if({_REASON} IS NOT NULL)::BIGINT AS dropped_count FROM candidates GROUP BY doc_id")
def tag_coverage(spark, sf_dir):
    return ta.coverage(_tagged(spark, sf_dir), ["doc_id"])


@query(tw.chain(_CANDIDATES) + f"SELECT doc_id, idx, left(text, 60) AS text_preview, CASE WHEN {_REASON} IS NULL THEN tag END AS tag FROM candidates")
def tag_review(spark, sf_dir):
    tags = _tagged(spark, sf_dir).where("tag is not null")
    return ta.review(ta.with_tags(pieces(spark, sf_dir), tags, ["doc_id", "idx"]), ["doc_id", "idx"])


@query(tw.chain(_CANDIDATES) + f"""SELECT doc_id, idx, coalesce(CASE WHEN doc_id % 3 = 0 THEN 'stern' END, CASE WHEN {_REASON} IS NULL THEN tag END) AS tag FROM candidates WHERE doc_id % 3 = 0 OR {_REASON} IS NULL""")
def tag_merge(spark, sf_dir):
    later = F.when(F.col("doc_id") % 3 == 0, "stern")
    both = F.array(F.struct(F.lit(0).alias("k"), F.col("tag")), F.struct(F.lit(1).alias("k"), later.alias("tag")))
    rows = _tagged(spark, sf_dir).select("doc_id", "idx", F.inline(both)).where("tag is not null")
    return ta.merged(rows, ["doc_id", "idx"], "k")


@query(tw.chain(_CANDIDATES) + f"""SELECT doc_id, idx AS item, CASE WHEN doc_id % 11 = 0 THEN 'x' WHEN idx % 9 = 5 THEN NULL ELSE idx::VARCHAR END AS chunk_id, tag,
  CASE WHEN (idx % 9 = 5 AND doc_id % 11 <> 0) OR tag IS NULL THEN 'malformed item (missing chunk_id or tag)' WHEN doc_id % 11 = 0 THEN 'unknown chunk_id (not in requested batch)' ELSE {_REASON} END AS reason FROM candidates""")
def tag_response(spark, sf_dir):
    rows = candidates(spark, sf_dir).withColumn("chunk_id", F.col("idx").cast("string"))
    named = F.when(F.col("doc_id") % 11 == 0, "x").when(F.col("idx") % 9 == 5, None).otherwise(F.col("chunk_id"))
    items = F.transform(F.sort_array(F.collect_list(F.struct("idx", named.alias("c"), "tag"))), lambda x: F.struct(x["c"].alias("chunk_id"), x["tag"].alias("tag")))
    answers = rows.groupBy("doc_id").agg(F.to_json(F.struct(items.alias("items"))).alias("j"))
    answers = answers.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("```json\n"), "j", F.lit("\n```"))).otherwise(F.col("j")).alias("answer"))
    parsed = ta.parse_response(answers, "answer", ["doc_id"])
    return ta.validate_response(parsed, rows.drop("tag"), ["doc_id"]).select("doc_id", "item", "chunk_id", "tag", "reason")


_U16 = "'\\u' || lower(lpad(to_hex({0}), 4, '0'))".replace("\\\\", "\\")
_ASCII = f"""array_to_string(list_transform(string_split(to_json(text)::VARCHAR, ''), lambda c: CASE WHEN unicode(c) < 128 THEN c WHEN unicode(c) < 65536 THEN {_U16.format('unicode(c)')}
  ELSE {_U16.format('55232 + unicode(c) // 1024')} || {_U16.format('56320 + unicode(c) % 1024')} END), '')"""


@query(tw.chain(tw.SIMPLE) + f"""SELECT doc_id, '[' || chr(10) || '  ' || string_agg('{{"chunk_id": "' || idx || '", "text": ' || {_ASCII} || '}}', ',' || chr(10) || '  ' ORDER BY idx) || chr(10) || ']' AS prompt FROM pieces GROUP BY doc_id""")
def tag_prompt(spark, sf_dir):
    rows = pieces(spark, sf_dir).select("doc_id", F.col("idx").alias("position"), F.col("idx").cast("string").alias("chunk_id"), "text")
    return ta.tag_prompt(rows, ["doc_id"])


@query("""SELECT '{"type": "object", "properties": {"items": {"type": "array", "items": {"type": "object", "properties": {"chunk_id": {"type": "string"}, "tag": {"type": "string"}}, "required": ["chunk_id", "tag"], "additionalProperties": false}}}, "required": ["items"], "additionalProperties": false}' AS schema""")
def answer_schema(spark, sf_dir):
    return spark.range(1).select(F.lit(json.dumps(ta.strict(ta.ANSWER_SCHEMA))).alias("schema"))


# -- incremental work


_PLAN = _CANDIDATES + f""", plan AS (
  SELECT doc_id, idx, text, CASE WHEN {_REASON} IS NULL THEN tag END AS tag, sha256(CASE WHEN {_REASON} IS NULL THEN '[' || tag || '] ' || text ELSE text END) AS text_hash FROM candidates
), manifest AS (
  SELECT doc_id, idx, CASE WHEN idx % 4 = 3 THEN 'old' ELSE text_hash END AS text_hash, doc_id || '/' || idx || '.wav' AS wav_path, CASE WHEN idx % 5 = 4 THEN 'failed' ELSE 'done' END AS status, NULL::VARCHAR AS error FROM plan WHERE doc_id % 3 = 0
)"""


def _tagged(spark, sf_dir):
    """Pieces with their candidate tag where it is accepted, else null."""
    return candidates(spark, sf_dir).withColumn("tag", F.when(tg.rejection(F.col("tag"), F.col("text")).isNull(), F.col("tag")))


def _plan(spark, sf_dir):
    return rs.planned(_tagged(spark, sf_dir))


def _manifest(plan):
    rows = plan.where("doc_id % 3 = 0")
    path = F.concat(F.col("doc_id").cast("string"), F.lit("/"), F.col("idx").cast("string"), F.lit(".wav"))
    return rows.select("doc_id", "idx", F.when(F.col("idx") % 4 == 3, "old").otherwise(F.col("text_hash")).alias("text_hash"), path.alias("wav_path"), F.when(F.col("idx") % 5 == 4, "failed").otherwise("done").alias("status"), F.lit(None).cast("string").alias("error"))


_IS_DONE = "EXISTS (SELECT 1 FROM manifest m WHERE m.doc_id = p.doc_id AND m.idx = p.idx AND m.text_hash = p.text_hash AND m.status = 'done')"


@query(tw.chain(_PLAN) + f"SELECT doc_id, idx, text_hash FROM plan p WHERE NOT {_IS_DONE}")
def resume_pending(spark, sf_dir):
    plan = _plan(spark, sf_dir)
    return rs.pending(plan, _manifest(plan), ["doc_id", "idx"]).select("doc_id", "idx", "text_hash")


@query(tw.chain(_PLAN) + f"SELECT doc_id, idx, text_hash, 0.0::DOUBLE AS latency_s FROM plan p WHERE {_IS_DONE}")
def resume_skipped(spark, sf_dir):
    plan = _plan(spark, sf_dir)
    return rs.skipped(plan, _manifest(plan), ["doc_id", "idx"]).select("doc_id", "idx", "text_hash", "latency_s")


@query(tw.chain(_PLAN) + f"""SELECT doc_id, idx, text_hash, wav_path, status, error FROM manifest m WHERE NOT EXISTS (SELECT 1 FROM plan p WHERE p.doc_id = m.doc_id AND p.idx = m.idx AND NOT {_IS_DONE})
UNION ALL SELECT doc_id, idx, text_hash, doc_id || '/' || idx || '.wav', CASE WHEN idx % 7 = 6 THEN 'failed' ELSE 'done' END, CASE WHEN idx % 7 = 6 THEN '(503)' END FROM plan p WHERE NOT {_IS_DONE}""")
def manifest_upsert(spark, sf_dir):
    plan = _plan(spark, sf_dir)
    manifest = _manifest(plan)
    todo = rs.pending(plan, manifest, ["doc_id", "idx"])
    failed = F.col("idx") % 7 == 6
    path = F.concat(F.col("doc_id").cast("string"), F.lit("/"), F.col("idx").cast("string"), F.lit(".wav"))
    done = todo.select("doc_id", "idx", "text_hash", path.alias("wav_path"), F.when(failed, "failed").otherwise("done").alias("status"), F.when(failed, "(503)").alias("error"))
    return rs.upsert(manifest, done, ["doc_id", "idx"])


@query(tw.chain(_PLAN) + "SELECT p.doc_id, p.idx, coalesce(m.wav_path, 'default/' || p.idx || '.wav') AS wav_path, m.wav_path IS NULL OR p.idx % 6 = 5 AS missing FROM plan p LEFT JOIN manifest m USING (doc_id, idx)")
def stitch_inputs(spark, sf_dir):
    plan = _plan(spark, sf_dir)
    manifest = _manifest(plan)
    files = manifest.where("idx % 6 <> 5").select("wav_path")
    default = F.concat(F.lit("default/"), F.col("idx").cast("string"), F.lit(".wav"))
    return rs.to_stitch(plan, manifest, ["doc_id", "idx"], default, files).select("doc_id", "idx", "wav_path", "missing")


@query(tw.chain(_PLAN) + f"SELECT doc_id, count(*)::BIGINT AS chunks, count_if(tag IS NOT NULL AND coalesce(doc_id % 3 = 0, false))::BIGINT AS retagged FROM plan GROUP BY doc_id")
def retag_invalidate(spark, sf_dir):
    """How many of a document's chunks a new tag makes due again: their hash without it isn't that with it."""
    rows = _plan(spark, sf_dir).withColumn("old", F.when(F.col("doc_id") % 3 == 0, tx.text_hash(F.col("text"))).otherwise(F.col("text_hash")))
    return rows.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.count_if(F.col("old") != F.col("text_hash")).alias("retagged"))


# -- text checks


@query(tw.chain(_CANDIDATES) + "SELECT doc_id, idx, regexp_matches(text, '[A-Za-z0-9]') AS speakable, regexp_matches(CASE WHEN coalesce(tag, '') <> '' THEN '[' || tag || '] ' || text ELSE text END, '[A-Za-z0-9]') AS speakable_applied FROM candidates")
def speakable(spark, sf_dir):
    rows = rs.planned(candidates(spark, sf_dir))
    return rows.select("doc_id", "idx", "speakable", "speakable_applied")


@query("SELECT doc_id, regexp_matches(coalesce(text, ''), '[A-Za-z0-9_-]{20}') AS suspicious FROM documents")
def secret_scan(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", "text")
    return rows.select("doc_id", ev.suspicious(rows).alias("suspicious"))


@query("SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[A-Za-z0-9_-]{20,}', '<redacted>', 'g')) AS redacted FROM documents")
def redact(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", tx.text_hash(tx.redact(F.col("text"))).alias("redacted"))


@query(r"""WITH c AS (SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g') AS one FROM documents) SELECT doc_id, CASE WHEN length(one) > 500 THEN left(one, 500) || '...' ELSE one END AS diagnostic FROM c""")
def diagnostics(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", tx.compact(F.col("text")).alias("diagnostic"))


def _little(x: str) -> str:
    """Four bytes in hexadecimal, the least first."""
    return " || ".join(f"substr(lpad(to_hex({x}), 8, '0'), {k}, 2)" for k in (7, 5, 3, 1))


@query(f"""SELECT n, upper('52494646' || {_little('36 + d')} || '57415645666d7420100000000100010044ac000088580100020010006461746' || '1' || {_little('d')} || repeat('00', d::INT)) AS wav
FROM (SELECT n, 2 * (44100 * n // 1000) AS d FROM (SELECT unnest(range(0, 500, 50))::INT AS n))""")
def silent_wav(spark, sf_dir):
    return spark.range(0, 500, 50).select(F.col("id").cast("int").alias("n"), F.hex(tx.silent_wav(F.col("id"))).alias("wav"))


@query("""WITH c AS (SELECT event_id, event_id % 400 AS ms, CASE WHEN event_id % 4 = 1 THEN 22050 ELSE 44100 END AS sample_rate, CASE WHEN event_id % 6 = 2 THEN 2 ELSE 1 END AS channels FROM events WHERE event_id % 50 < 12)
SELECT event_id, CASE WHEN event_id % 50 = 0 THEN NULL ELSE round(floor(sample_rate * ms / 1000.0) / sample_rate, 6) END AS seconds, CASE WHEN event_id % 50 > 0 THEN sample_rate END AS sample_rate, CASE WHEN event_id % 50 > 0 THEN channels END AS channels,
  CASE WHEN event_id % 50 > 0 THEN 's16' END AS sample_format, CASE WHEN event_id % 50 = 0 THEN 'no sound that can be read' WHEN sample_rate <> 44100 THEN 'not at 44100 Hz' WHEN channels <> 1 THEN 'not mono' END AS fault FROM c""")
def clip_metadata(spark, sf_dir):
    """Clips of two rates and one or two channels, with a chunk before the data that a fixed header wouldn't expect, read back and checked."""
    e = F.col("event_id")
    odd = b"LIST\x03\x00\x00\x00abc\x00"
    ways = [F.when((e % 4 == 1) == (rate == 22050), F.when((e % 6 == 2) == (n == 2), tx.silent_wav(e % 400, rate, n, odd))) for rate in (22050, 44100) for n in (1, 2)]
    clips = table(spark, sf_dir, "events").where(e % 50 < 12).select("event_id", F.when(e % 50 == 0, F.lit("RIFF").cast("binary")).otherwise(F.coalesce(*ways)).alias("audio"))
    rows = clips.select("event_id", tx.wav_info(F.col("audio")).alias("i")).select("event_id", "i.*")
    return reference_faults(rows).withColumn("seconds", F.round("seconds", 6))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'rate_limit' WHEN 1 THEN 'server' WHEN 4 THEN 'server' ELSE 'other' END AS class FROM events""")
def error_class(spark, sf_dir):
    said = F.array(*[F.lit(x) for x in ("answer (429): slow down", "failed (503)", "refused (404)", "no code 500", "x (500) y")])
    return table(spark, sf_dir, "events").select("event_id", tx.error_class(F.element_at(said, (F.col("event_id") % 5 + 1).cast("int"))).alias("class"))


@query("""WITH s AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN value::VARCHAR WHEN 2 THEN 'soon' ELSE '99999' END AS raw FROM events) SELECT event_id, (CASE WHEN try_cast(raw AS DOUBLE) IS NULL THEN 180.0 ELSE greatest(5.0, least(try_cast(raw AS DOUBLE), 3600.0)) END)::DOUBLE AS timeout_s FROM s""")
def timeout_clamp(spark, sf_dir):
    kind = F.col("event_id") % 4
    raw = F.when(kind == 1, F.col("value").cast("string")).when(kind == 2, "soon").when(kind == 3, "99999")
    return table(spark, sf_dir, "events").select("event_id", tx.timeout_seconds(raw).alias("timeout_s"))


# -- timelines

_TIMED = tw.chain(*tw.TO_CHUNKS, """timed AS (
  SELECT *, (char_count * 60)::BIGINT AS duration_ms, CASE WHEN lead(position) OVER w IS NULL THEN NULL WHEN kind = 'title' THEN 3000 WHEN boundary = 'mid_paragraph' THEN 300 ELSE 900 END AS gap_ms FROM chunks WINDOW w AS (PARTITION BY book_id, ordinal ORDER BY position)
)""")


def _timed(spark, sf_dir):
    rows = ck.book_chunks(books(spark, sf_dir), "text", ["book_id"]).withColumn("duration_ms", (F.col("char_count") * 60).cast("long"))
    return tl.gaps(rows, ["book_id", "ordinal"], ["position"], mid_paragraph_gap_ms=300)


@query(_TIMED + "SELECT book_id, ordinal, position, gap_ms::INT AS gap_ms FROM timed")
def gap_schedule(spark, sf_dir):
    return _timed(spark, sf_dir).select("book_id", "ordinal", "position", "gap_ms")


@query(_TIMED + "SELECT book_id, ordinal, position, coalesce(sum(duration_ms + coalesce(gap_ms, 0)) OVER (PARTITION BY book_id, ordinal ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_ms FROM timed")
def timeline_offsets(spark, sf_dir):
    return tl.offsets(_timed(spark, sf_dir), ["book_id", "ordinal"], ["position"]).select("book_id", "ordinal", "position", "start_ms")


@query(_TIMED + "SELECT book_id, ordinal, sum(duration_ms + coalesce(gap_ms, 0))::BIGINT AS duration_ms FROM timed GROUP BY ALL")
def chapter_duration(spark, sf_dir):
    return tl.durations(_timed(spark, sf_dir), ["book_id", "ordinal"])


@query(_TIMED + """, ends AS (SELECT book_id, ordinal, sum(duration_ms + coalesce(gap_ms, 0))::BIGINT AS duration_ms FROM timed GROUP BY ALL), breaks AS (
  SELECT *, CASE WHEN lead(ordinal) OVER (PARTITION BY book_id ORDER BY ordinal) IS NOT NULL THEN 2000 END AS gap_ms FROM ends)
SELECT book_id, ordinal, duration_ms, gap_ms::INT AS gap_ms, coalesce(sum(duration_ms + coalesce(gap_ms, 0)) OVER (PARTITION BY book_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_ms FROM breaks""")
def book_concat(spark, sf_dir):
    ends = tl.durations(_timed(spark, sf_dir), ["book_id", "ordinal"])
    return tl.book_timeline(ends, ["book_id"], ["ordinal"])


@query(_TIMED + "SELECT DISTINCT gap_ms::INT AS gap_ms FROM timed WHERE gap_ms IS NOT NULL")
def distinct_gaps(spark, sf_dir):
    return tl.distinct_gaps(_timed(spark, sf_dir))


@query(_TIMED + """, entries AS (SELECT book_id, ordinal, position, 0 AS part, 'it''s/' || chunk_id || '.wav' AS path FROM timed UNION ALL SELECT book_id, ordinal, position, 1, 'gap_' || gap_ms || 'ms.wav' FROM timed WHERE gap_ms IS NOT NULL)
SELECT book_id, ordinal, string_agg('file ''' || replace(path, '''', '''\\''''') || '''', chr(10) ORDER BY position, part) || chr(10) AS list FROM entries GROUP BY ALL""".replace("\\\\", "\\"))
def concat_list(spark, sf_dir):
    rows = _timed(spark, sf_dir).withColumn("path", F.concat(F.lit("it's\\"), "chunk_id", F.lit(".wav")))
    return tl.concat_list(tl.segments(rows, ["book_id", "ordinal"], ["position"], "path"), ["book_id", "ordinal"], ["position", "part"])


# -- outcomes and control


@query(tw.chain(tw.OUTCOMES) + ", ok AS (SELECT user_id, latency_s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM outcomes WHERE error IS NULL) SELECT user_id, round(quantile_cont(latency_s, 0.5), 6) AS baseline_s FROM ok WHERE n <= 5 GROUP BY user_id HAVING count(*) = 5")
def latency_baseline(spark, sf_dir):
    return ct.baselines(outcomes(spark, sf_dir), ["user_id"], ["ts", "event_id"]).select("user_id", F.round("baseline_s", 6).alias("baseline_s"))


@query(tw.chain(tw.OUTCOMES) + "SELECT event_id, CASE WHEN row_number() OVER w >= 5 THEN round(quantile_cont(latency_s, 0.5) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) END AS median_s FROM outcomes WHERE error IS NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def rolling_median(spark, sf_dir):
    return ct.rolling_medians(outcomes(spark, sf_dir), ["user_id"], ["ts", "event_id"]).select("event_id", F.round("median_s", 6).alias("median_s"))


@query(tw.chain(tw.OUTCOMES) + """, f AS (SELECT *, error IS NULL AND latency_s <= 40.0 AS fast FROM outcomes), g AS (SELECT *, sum(CASE WHEN fast THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY seq) AS island FROM f)
SELECT event_id, sum(CASE WHEN fast THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, island ORDER BY seq)::BIGINT AS streak FROM g""")
def fast_streak(spark, sf_dir):
    rows = outcomes(spark, sf_dir).withColumn("baseline_s", F.lit(40.0))
    return ct.fast_streaks(rows, ["user_id"], ["seq"]).select("event_id", "streak")


@query("""WITH s AS (SELECT event_id, value, CASE event_id % 5 WHEN 0 THEN 'rate_limit' WHEN 1 THEN 'server' WHEN 2 THEN 'timeout' END AS error FROM events)
SELECT event_id, CASE error WHEN 'rate_limit' THEN '429 received' WHEN 'server' THEN '5xx received' WHEN 'timeout' THEN 'timeout' ELSE CASE WHEN floor(value) > 20.0 * 1.75 THEN 'median ' || format('{:.1f}', floor(value)) || 's vs baseline 20.0s' END END AS reason FROM s""")
def degrade_reason(spark, sf_dir):
    kind = F.col("event_id") % 5
    error = F.when(kind == 0, "rate_limit").when(kind == 1, "server").when(kind == 2, "timeout")
    return table(spark, sf_dir, "events").select("event_id", ct.degrade_reason(error, F.floor("value").cast("double"), F.lit(20.0)).alias("reason"))


def _trace_twin(ramp: bool) -> str:
    return tw.chain(tw.OUTCOMES, f"""run AS (
  SELECT DISTINCT user_id, 0::BIGINT AS seq, 0::BIGINT AS event_id, 3 AS target, 0 AS streak, NULL::DOUBLE AS baseline, []::DOUBLE[] AS recent FROM outcomes
  UNION ALL
  SELECT user_id, seq, event_id, CASE WHEN up AND t1 < 3 THEN t1 + 1 ELSE t1 END, CASE WHEN up THEN 0 ELSE s1 END, base, rec FROM (
    SELECT *, {"s1 >= 10" if ramp else "false"} AS up FROM (
      SELECT *, CASE WHEN error IS NOT NULL OR slow THEN greatest(1, target - 1) ELSE target END AS t1, CASE WHEN error IS NOT NULL OR slow OR base IS NULL OR latency_s > base THEN 0 ELSE streak + 1 END AS s1 FROM (
        SELECT *, error IS NULL AND len(rec) = 5 AND list_sort(rec)[3] > base * 1.75 AS slow FROM (
          SELECT *, CASE WHEN error IS NULL AND baseline IS NULL AND len(rec) = 5 THEN list_sort(rec)[3] ELSE baseline END AS base FROM (
            SELECT r.user_id, o.seq, o.event_id, o.latency_s, o.error, r.target, r.streak, r.baseline, CASE WHEN o.error IS NOT NULL THEN r.recent ELSE list_append(r.recent, o.latency_s)[-5:] END AS rec
            FROM run r JOIN outcomes o ON o.user_id = r.user_id AND o.seq = r.seq + 1)))))
)""") + "SELECT event_id, target, streak FROM run WHERE seq > 0"


@query(_trace_twin(False))
def degrade_trace(spark, sf_dir):
    return ct.trace(outcomes(spark, sf_dir), "user_id", ["seq"]).select("event_id", "target", "streak")


@query(_trace_twin(True))
def ramp_trace(spark, sf_dir):
    return ct.trace(outcomes(spark, sf_dir), "user_id", ["seq"], ramp_up=True).select("event_id", "target", "streak")


@query("""SELECT event_id, coalesce(CASE event_id % 7 WHEN 0 THEN value WHEN 1 THEN 30 END, [2.0, 4.0, 8.0][(least(event_id % 5, 2) + 1)::INT])::DOUBLE AS wait_s FROM events""")
def backoff_plan(spark, sf_dir):
    header = F.when(F.col("event_id") % 7 == 0, F.col("value").cast("string")).when(F.col("event_id") % 7 == 1, "30").when(F.col("event_id") % 7 == 2, "Wed, 21 Oct 2026 07:28:00 GMT")
    return table(spark, sf_dir, "events").select("event_id", tx.backoff_seconds(F.col("event_id") % 5, tx.retry_after(header)).alias("wait_s"))


@query(tw.chain(tw.OUTCOMES) + ", a AS (SELECT *, (seq + 2) // 3 AS job, (seq + 2) % 3 AS attempt FROM outcomes) SELECT user_id, job::BIGINT AS job, max(attempt)::BIGINT AS attempts, CASE WHEN arg_max(coalesce(error, ''), attempt) = '' THEN 'done' ELSE 'failed' END AS status FROM a GROUP BY user_id, job")
def attempts(spark, sf_dir):
    rows = outcomes(spark, sf_dir).withColumns({"job": ((F.col("seq") + 2) / 3).cast("long"), "attempt": (F.col("seq") + 2) % 3, "status": F.when(F.col("error").isNull(), "done").otherwise("failed")})
    return ct.final_attempts(rows, ["user_id", "job"]).select("user_id", "job", "attempts", "status")


@query(tw.chain(tw.OUTCOMES) + """, a AS (SELECT user_id, event_id, seq, sum(latency_s) OVER (PARTITION BY user_id ORDER BY seq) % 7 + seq * 0.2 AS arrival_s FROM outcomes)
SELECT event_id, round((seq - 1) * 0.3 + max(arrival_s - (seq - 1) * 0.3) OVER (PARTITION BY user_id ORDER BY seq), 6) AS start_s FROM a""")
def courtesy_starts(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value")
    sums = running_sums(events, "user_id", ["ts", "event_id"], "value", events.agg(F.count("*")))
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    rows = sums.withColumn("seq", seq).withColumn("arrival_s", F.col("sum") % 7 + F.col("seq") * 0.2)
    return ct.courtesy_starts(rows, ["user_id"], ["seq"]).select("event_id", F.round("start_s", 6).alias("start_s"))


@query(tw.chain(tw.OUTCOMES) + ", n AS (SELECT user_id, max(seq) + 1 AS n FROM outcomes WHERE seq % 4 <> 0 GROUP BY user_id), i AS (SELECT user_id, unnest(range(n)) AS idx FROM n) SELECT i.user_id, i.idx::BIGINT AS idx, o.event_id AS result FROM i LEFT JOIN outcomes o ON o.user_id = i.user_id AND o.seq = i.idx AND o.error IS NULL AND o.seq % 4 <> 0")
def ordered_results(spark, sf_dir):
    rows = outcomes(spark, sf_dir).where("seq % 4 <> 0").select("user_id", F.col("seq").alias("idx"), "error", F.col("event_id").alias("result"))
    return ct.ordered_results(rows, ["user_id"])


@query(tw.chain(tw.OUTCOMES) + "SELECT user_id, count_if(error IS NOT NULL)::BIGINT AS failed, count_if(error IS NULL)::BIGINT AS succeeded FROM outcomes GROUP BY user_id")
def failure_summary(spark, sf_dir):
    return outcomes(spark, sf_dir).groupBy("user_id").agg(F.count_if(F.col("error").isNotNull()).alias("failed"), F.count_if(F.col("error").isNull()).alias("succeeded"))


@query(tw.chain(tw.OUTCOMES) + "SELECT user_id, seq, 'chunk ' || seq || ' failed: ' || error AS line FROM outcomes WHERE error IS NOT NULL ORDER BY seq")
def failure_lines(spark, sf_dir):
    return ct.failures(outcomes(spark, sf_dir), "seq").select("user_id", "seq", "line")


@query(tw.chain(tw.OUTCOMES) + """, k AS (SELECT *, 'ch' || user_id AS ch, 'ch' || user_id || '_' || seq AS cid FROM outcomes)
SELECT event_id, CASE event_id % 9 WHEN 0 THEN '{"event":"run_started","book":"b' || user_id || '","chapters":["' || ch || '"],"tagger":null}' WHEN 1 THEN '{"event":"chunked","chapter_id":"' || ch || '","chunk_count":' || seq || '}'
  WHEN 2 THEN '{"event":"tagged","chapter_id":"' || ch || '","tagged_count":' || seq || ',"dropped_count":0}' WHEN 3 THEN '{"event":"concurrency_changed","from":3,"to":2,"reason":"429 received"}' WHEN 4 THEN '{"event":"stitched","chapter_id":"' || ch || '","path":"a/b.mp3","duration_s":1.5}'
  WHEN 5 THEN '{"event":"done","book":"b' || user_id || '","chapters_done":' || seq || ',"failed_chunks":0}' WHEN 6 THEN '{"event":"error","message":"no \\"chapter\\""}' WHEN 7 THEN '{"event":"chunk_done","chunk_id":"' || cid || '","i":' || seq || ',"n":99,"concurrency":3}'
  ELSE '{"event":"chunk_failed","chunk_id":"' || cid || '","i":' || seq || ',"n":99,"error":' || CASE WHEN error IS NULL THEN 'null' ELSE '"' || error || '"' END || '}' END AS line FROM k""")
def event_ndjson(spark, sf_dir):
    """A line of each of the nine kinds."""
    user, seq = F.col("user_id").cast("string"), F.col("seq")
    chapter, book = F.concat(F.lit("ch"), user), F.concat(F.lit("b"), user)
    cid = F.concat(chapter, F.lit("_"), seq.cast("string"))
    lines = [
        ev.line("run_started", book=book, chapters=F.array(chapter), tagger=F.lit(None).cast("string")), ev.line("chunked", chapter_id=chapter, chunk_count=seq), ev.line("tagged", chapter_id=chapter, tagged_count=seq, dropped_count=F.lit(0)),
        ev.line("concurrency_changed", from_=F.lit(3), to=F.lit(2), reason=F.lit("429 received")), ev.line("stitched", chapter_id=chapter, path=F.lit("a/b.mp3"), duration_s=F.lit(1.5)),
        ev.line("done", book=book, chapters_done=seq, failed_chunks=F.lit(0)), ev.line("error", message=F.lit('no "chapter"')), ev.line("chunk_done", chunk_id=cid, i=seq, n=F.lit(99), concurrency=F.lit(3)), ev.line("chunk_failed", chunk_id=cid, i=seq, n=F.lit(99), error=F.col("error")),
    ]
    line = lines[8]
    for k in range(7, -1, -1):
        line = F.when(F.col("event_id") % 9 == k, lines[k]).otherwise(line)
    return outcomes(spark, sf_dir).select("event_id", line.alias("line"))


@query(tw.chain(tw.OUTCOMES) + "SELECT 'ch' || user_id AS chapter_id, count_if(error IS NULL)::BIGINT AS done, count_if(error IS NOT NULL)::BIGINT AS failed, round(sum(CASE WHEN error IS NULL THEN latency_s END), 4) AS seconds FROM outcomes GROUP BY user_id")
def progress(spark, sf_dir):
    cid = F.concat(F.lit("ch"), F.col("user_id").cast("string"), F.lit("_"), F.col("seq").cast("string"))
    done = ev.event("chunk_done", chunk_id=cid, i=F.col("seq"), n=F.lit(99), latency_s=F.col("latency_s"))
    failed = ev.event("chunk_failed", chunk_id=cid, i=F.col("seq"), n=F.lit(99), error=F.col("error"))
    rows = outcomes(spark, sf_dir).select(F.when(F.col("error").isNull(), done).otherwise(failed).alias("e")).select(*[F.col(f"e.`{f.name}`") for f in EVENT.fields])
    return ev.progress(rows).select("chapter_id", "done", "failed", F.round("seconds", 4).alias("seconds"))


@query(tw.chain(tw.OUTCOMES) + "SELECT event_id, greatest(1, least((seq % 9 - 2)::INT, 3)) AS target FROM outcomes")
def target_clamp(spark, sf_dir):
    return outcomes(spark, sf_dir).select("event_id", ct.clamp_target((F.col("seq") % 9 - 2).cast("int")).alias("target"))


@query("""WITH c AS (SELECT event_id, value AS seconds, CASE WHEN event_id % 4 = 1 THEN 22050 ELSE 44100 END AS sample_rate, CASE WHEN event_id % 6 = 2 THEN 2 ELSE 1 END AS channels, CASE WHEN event_id % 10 = 3 THEN 'fltp' ELSE 's16' END AS f FROM events)
SELECT event_id, CASE WHEN seconds > 30.5 THEN 'longer than 30.5 s' WHEN sample_rate <> 44100 THEN 'not at 44100 Hz' WHEN channels <> 1 THEN 'not mono' WHEN f <> 's16' THEN 'not 16-bit' END AS fault FROM c""")
def reference_clips(spark, sf_dir):
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").select("event_id", F.col("value").alias("seconds"), F.when(e % 4 == 1, 22050).otherwise(44100).alias("sample_rate"), F.when(e % 6 == 2, 2).otherwise(1).alias("channels"), F.when(e % 10 == 3, "fltp").otherwise("s16").alias("sample_format"))
    return reference_faults(rows).select("event_id", "fault")
