"""DuckDB twins of the queries: pieces of SQL, put together by catalog."""

from __future__ import annotations

from ..functions.text import ABBREVIATIONS

NL, C1, C2 = "chr(10)", "chr(1)", "chr(2)"

BOOKS = """doc_lines AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents
), doc_parts AS (
  SELECT doc_id, l, len(l) // 2 AS h, array_to_string(list_slice(string_split(l[1], ' '), 1, 3), ' ') AS w3, doc_id % 120 AS k FROM doc_lines
), books AS (
  SELECT doc_id AS book_id, l[1] || chr(10) || 'Chapter ' || k || ': ' || w3 || chr(10)
    || array_to_string(list_transform(list_slice(l, 1, h), lambda x, i: x || CASE WHEN i % 5 = 0 AND i % 2 = 1 THEN chr(10) || '***' || chr(10) WHEN i % 5 = 0 THEN chr(10) || chr(10) || chr(10) ELSE chr(10) || chr(10) END), '')
    || chr(10) || 'CHAPTER ' || k || '.5' || chr(10)
    || array_to_string(list_transform(list_slice(l, h + 1, len(l)), lambda x, i: x || CASE WHEN i % 5 = 0 AND i % 2 = 1 THEN chr(10) || '***' || chr(10) WHEN i % 5 = 0 THEN chr(10) || chr(10) || chr(10) ELSE chr(10) || chr(10) END), '') AS text
  FROM doc_parts
)"""

# Fixed value: the heading of a chapter.
_HEAD = r"(?i)^\s*Chapter\s+(\d+(?:\.\d+)?)\s*[:\-–—]?\s*(.*?)\s*$"

CHAPTERS = f"""book_lines AS (
  SELECT book_id, u.pos, u.line, regexp_matches(u.line, '{_HEAD}') AS h
  FROM (SELECT book_id, string_split(text, chr(10)) AS l FROM books) b, LATERAL (SELECT unnest(l) AS line, unnest(range(len(l))) AS pos) u
), book_marks AS (
  SELECT *, sum(h::INT) OVER (PARTITION BY book_id ORDER BY pos) AS ordinal FROM book_lines
), chapters AS (
  SELECT book_id, ordinal::INT AS ordinal, max(CASE WHEN h THEN regexp_extract(line, '{_HEAD}', 1) END) AS number,
         coalesce(max(CASE WHEN h THEN regexp_extract(line, '{_HEAD}', 2) END), '') AS title,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT h), '') AS text
  FROM book_marks GROUP BY book_id, ordinal
), named AS (
  SELECT *, CASE WHEN number IS NULL THEN 'ch00' ELSE 'ch' || CASE WHEN length(split_part(number, '.', 1)) < 2 THEN '0' ELSE '' END || split_part(number, '.', 1)
    || CASE WHEN contains(number, '.') THEN '_' || split_part(number, '.', 2) ELSE '' END END AS chapter_id FROM chapters
)"""

UNITS = r"""unit_text AS (
  SELECT book_id, ordinal, chapter_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
    '(?m)^[ \t]*[*\-—]{3,}[ \t]*$', chr(1), 'g'), '(?m)^[ \t]*#{1,6}[ \t].*$', chr(1), 'g'),
    '\n(?:[ \t]*\n){2,}', chr(10) || chr(1) || chr(10), 'g'), '\n(?:[ \t]*\n)+', chr(10) || chr(2) || chr(10), 'g') AS t
  FROM named
), unit_rows AS (
  SELECT book_id, ordinal, chapter_id, x.unit_id, x.u FROM unit_text, LATERAL (SELECT unnest(string_split(t, chr(1))) AS u, unnest(range(len(string_split(t, chr(1))))) AS unit_id) x
), units AS (
  SELECT book_id, ordinal, chapter_id, unit_id::INT AS unit_id, paras FROM (
    SELECT *, list_filter(list_transform(string_split(u, chr(2)), lambda p: array_to_string(list_filter(list_transform(string_split(p, chr(10)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> ''), ' ')), lambda p: p <> '') AS paras FROM unit_rows
  ) WHERE len(paras) > 0
)"""


def sentences(x: str) -> str:
    known = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS)
    guarded = rf"regexp_replace({x}, '(^|\s)([\x22\x27“‘(\[]*(?:{known})\s*[.!?]+[\x22\x27”’)\]]*)', '\1\2' || chr(2), 'g')"
    cut = rf"regexp_replace({guarded}, '([.!?]+[\x22\x27”’)\]]*)(\s+)([\p{{Lu}}\x22\x27“‘(\[])', '\1' || chr(1) || '\2\3', 'g')"
    return rf"list_filter(list_transform(string_split(replace({cut}, chr(2), ''), chr(1)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')"


def halves(s: str, limit: int = 600) -> str:
    """A sentence as a list of one or two pieces."""
    at = f"list_sort(list_transform(list_filter(range(1, length({s}) + 1), lambda i: contains(',;:', substr({s}, i, 1))), lambda i: {{'d': abs(i - 1 - length({s}) / 2.0), 'i': i}}))[1].i"
    head, tail = rf"regexp_replace(left({s}, {at}), '^\s+|\s+$', '', 'g')", rf"regexp_replace(substr({s}, {at} + 1), '^\s+|\s+$', '', 'g')"
    return f"CASE WHEN length({s}) <= {limit} OR {at} IS NULL OR {head} = '' OR {tail} = '' THEN [{s}] ELSE [{head}, {tail}] END"


UNIT_SENTENCES = f"""unit_paras AS (
  SELECT book_id, ordinal, chapter_id, unit_id, x.para, x.p FROM units, LATERAL (SELECT unnest(paras) AS p, unnest(range(len(paras))) AS para) x
), para_sents AS (
  SELECT book_id, ordinal, chapter_id, unit_id, para, x.si, x.s FROM (SELECT *, {sentences('p')} AS ss FROM unit_paras), LATERAL (SELECT unnest(ss) AS s, unnest(range(len(ss))) AS si) x
), para_pieces AS (
  SELECT book_id, ordinal, chapter_id, unit_id, para, si, x.hi, x.s FROM (SELECT *, {halves('s')} AS hs FROM para_sents), LATERAL (SELECT unnest(hs) AS s, unnest(range(len(hs))) AS hi) x
), steps AS (
  SELECT book_id, ordinal, chapter_id, unit_id, s, row_number() OVER (PARTITION BY book_id, ordinal, unit_id ORDER BY para, si, hi) AS i,
         lead(si) OVER (PARTITION BY book_id, ordinal, unit_id, para ORDER BY si, hi) IS NULL AS is_last FROM para_pieces
)"""

PACK = """pack AS (
  SELECT DISTINCT book_id, ordinal, chapter_id, unit_id, 0::BIGINT AS i, ''::VARCHAR AS buf, []::STRUCT(t VARCHAR, b VARCHAR)[] AS o FROM steps
  UNION ALL
  SELECT book_id, ordinal, chapter_id, unit_id, i, CASE WHEN b IS NULL THEN b1 ELSE '' END,
         list_concat(CASE WHEN pre THEN [{'t': buf, 'b': 'mid_paragraph'}] ELSE [] END, CASE WHEN b IS NULL THEN [] ELSE [{'t': b1, 'b': b}] END)
  FROM (SELECT *, CASE WHEN is_last AND length(b1) >= 60 THEN 'ends_paragraph' WHEN length(b1) >= 200 THEN 'mid_paragraph' END AS b FROM (
    SELECT *, CASE WHEN pre OR buf = '' THEN s ELSE buf || ' ' || s END AS b1 FROM (
      SELECT p.book_id, p.ordinal, p.chapter_id, p.unit_id, s.i, p.buf, s.s, s.is_last, p.buf <> '' AND length(p.buf) + 1 + length(s.s) > 300 AS pre
      FROM pack p JOIN steps s ON p.book_id = s.book_id AND p.ordinal = s.ordinal AND p.unit_id = s.unit_id AND s.i = p.i + 1)))
), pack_out AS (
  SELECT book_id, ordinal, chapter_id, unit_id, i, x.k, x.e.t AS t, x.e.b AS b FROM pack, LATERAL (SELECT unnest(o) AS e, unnest(range(len(o))) AS k) x
  UNION ALL
  SELECT book_id, ordinal, chapter_id, unit_id, i, 9, buf, 'ends_paragraph' FROM (SELECT *, max(i) OVER (PARTITION BY book_id, ordinal, unit_id) AS n FROM pack) WHERE i = n AND buf <> ''
), packed AS (
  SELECT book_id, ordinal, chapter_id, unit_id, (row_number() OVER w - 1)::INT AS idx, t AS text, CASE WHEN lead(i) OVER w IS NULL THEN 'ends_section' ELSE b END AS boundary
  FROM pack_out WINDOW w AS (PARTITION BY book_id, ordinal, unit_id ORDER BY i, k)
)"""

MERGE = """merge AS (
  SELECT DISTINCT book_id, ordinal, chapter_id, unit_id, 0::BIGINT AS i, NULL::STRUCT(t VARCHAR, b VARCHAR) AS before, NULL::STRUCT(t VARCHAR, b VARCHAR) AS here, NULL::STRUCT(t VARCHAR, b VARCHAR) AS o FROM packed
  UNION ALL
  SELECT book_id, ordinal, chapter_id, unit_id, i + 1,
         CASE WHEN eat OR x IS NULL THEN b1 ELSE h1 END, CASE WHEN eat THEN {'t': h1.t || ' ' || x.t, 'b': x.b} WHEN x IS NULL THEN h1 ELSE x END,
         CASE WHEN eat OR x IS NULL THEN NULL ELSE b1 END
  FROM (SELECT *, h1 IS NOT NULL AND x IS NOT NULL AND length(h1.t) < 60 AND h1.b <> 'ends_section' AND length(h1.t) + 1 + length(x.t) <= 300 AS eat FROM (
    SELECT *, CASE WHEN go_left THEN NULL ELSE before END AS b1, CASE WHEN go_left THEN {'t': before.t || ' ' || here.t, 'b': here.b} ELSE here END AS h1 FROM (
      SELECT *, to_left AND (NOT to_right OR length(before.t) <= length(x.t)) AS go_left FROM (
        SELECT *, here IS NOT NULL AND length(here.t) < 60 AND before IS NOT NULL AND coalesce(before.b <> 'ends_section' AND length(before.t) + 1 + length(here.t) <= 300, false) AS to_left,
               here IS NOT NULL AND length(here.t) < 60 AND x IS NOT NULL AND coalesce(here.b <> 'ends_section' AND length(here.t) + 1 + length(x.t) <= 300, false) AS to_right FROM (
          SELECT m.*, CASE WHEN p.text IS NULL THEN NULL ELSE {'t': p.text, 'b': p.boundary} END AS x
          FROM (SELECT m.*, c.n FROM merge m JOIN (SELECT book_id, ordinal, unit_id, count(*) AS n FROM packed GROUP BY ALL) c USING (book_id, ordinal, unit_id) WHERE m.i <= c.n) m
          LEFT JOIN packed p ON p.book_id = m.book_id AND p.ordinal = m.ordinal AND p.unit_id = m.unit_id AND p.idx = m.i)))))
), merge_out AS (
  SELECT book_id, ordinal, chapter_id, unit_id, i, 0 AS k, o.t AS t, o.b AS b FROM merge WHERE o IS NOT NULL
  UNION ALL
  SELECT book_id, ordinal, chapter_id, unit_id, i, 1, before.t, before.b FROM (SELECT *, max(i) OVER (PARTITION BY book_id, ordinal, unit_id) AS n FROM merge) WHERE i = n AND before IS NOT NULL
  UNION ALL
  SELECT book_id, ordinal, chapter_id, unit_id, i, 2, here.t, here.b FROM (SELECT *, max(i) OVER (PARTITION BY book_id, ordinal, unit_id) AS n FROM merge) WHERE i = n AND here IS NOT NULL
), bodies AS (
  SELECT book_id, ordinal, chapter_id, unit_id, (row_number() OVER (PARTITION BY book_id, ordinal, unit_id ORDER BY i, k) - 1)::INT AS idx, t AS text, b AS boundary FROM merge_out
)"""

WORDS = """num AS (
  SELECT n, CASE WHEN n < 20 THEN list_extract(ones, n + 1) WHEN n < 100 THEN list_extract(tens, n // 10 + 1) || CASE WHEN n % 10 > 0 THEN '-' || list_extract(ones, n % 10 + 1) ELSE '' END END AS w
  FROM (SELECT unnest(range(100))::INT AS n, ['', 'One', 'Two', 'Three', 'Four', 'Five', 'Six', 'Seven', 'Eight', 'Nine', 'Ten', 'Eleven', 'Twelve', 'Thirteen', 'Fourteen', 'Fifteen', 'Sixteen', 'Seventeen', 'Eighteen', 'Nineteen'] AS ones,
    ['', '', 'Twenty', 'Thirty', 'Forty', 'Fifty', 'Sixty', 'Seventy', 'Eighty', 'Ninety'] AS tens)
), capital AS (
  SELECT n, CASE WHEN contains(w, '-') THEN split_part(w, '-', 1) || '-' || upper(left(split_part(w, '-', 2), 1)) || substr(split_part(w, '-', 2), 2) ELSE w END AS w FROM num
)"""

TITLES = WORDS + """, numbered AS (
  SELECT n.*, try_cast(split_part(number, '.', 1) AS INT) AS whole, CASE WHEN contains(number, '.') THEN try_cast(split_part(number, '.', 2) AS INT) END AS part FROM named n WHERE number IS NOT NULL
), titles AS (
  SELECT book_id, ordinal, chapter_id, number, 'Chapter ' || CASE WHEN whole < 100 THEN a.w ELSE list_extract(['One', 'Two', 'Three', 'Four', 'Five', 'Six', 'Seven', 'Eight', 'Nine'], whole // 100) || ' Hundred' || CASE WHEN whole % 100 > 0 THEN ' ' || h.w ELSE '' END END
    || CASE WHEN part IS NOT NULL THEN ' Point ' || b.w ELSE '' END || '.'
    || CASE WHEN title <> '' THEN ' ' || title || CASE WHEN right(title, 1) IN ('.', '!', '?') THEN '' ELSE '.' END ELSE '' END AS text
  FROM numbered LEFT JOIN capital a ON a.n = whole LEFT JOIN capital h ON h.n = whole % 100 LEFT JOIN capital b ON b.n = part
)"""

CHUNKS = """chunk_rows AS (
  SELECT book_id, ordinal, chapter_id, 0 AS position, text, 'title' AS kind, 'ends_section' AS boundary, false AS over_cap FROM titles
  UNION ALL
  SELECT b.book_id, b.ordinal, b.chapter_id, (row_number() OVER (PARTITION BY b.book_id, b.ordinal ORDER BY unit_id, idx) - CASE WHEN n.number IS NULL THEN 1 ELSE 0 END)::INT, b.text, 'body', boundary, length(b.text) > 300
  FROM bodies b JOIN named n ON n.book_id = b.book_id AND n.ordinal = b.ordinal
), chunks AS (
  SELECT book_id, ordinal, chapter_id || '_' || lpad(position::VARCHAR, 4, '0') AS chunk_id, chapter_id, position, text, length(text)::INT AS char_count, sha256(text) AS text_hash, kind, boundary, over_cap FROM chunk_rows
)"""


def chain(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


TO_CHAPTERS = (BOOKS, CHAPTERS)
TO_UNITS = (*TO_CHAPTERS, UNITS)
TO_PACKED = (*TO_UNITS, UNIT_SENTENCES, PACK)
TO_BODIES = (*TO_PACKED, MERGE)
TO_CHUNKS = (*TO_BODIES, TITLES, CHUNKS)

#: Chunks of documents by plain packing, without chapters: small, for queries downstream.
SIMPLE = f"""doc_sents AS (
  SELECT doc_id, x.i, x.s FROM (SELECT doc_id, {sentences("coalesce(text, '')")} AS ss FROM documents), LATERAL (SELECT unnest(ss) AS s, unnest(range(1, len(ss) + 1)) AS i) x
), grow AS (
  SELECT DISTINCT doc_id, 0::BIGINT AS i, ''::VARCHAR AS buf, []::VARCHAR[] AS o FROM doc_sents
  UNION ALL
  SELECT doc_id, i, CASE WHEN length(b1) >= 200 THEN '' ELSE b1 END, list_concat(CASE WHEN pre THEN [buf] ELSE [] END, CASE WHEN length(b1) >= 200 THEN [b1] ELSE [] END)
  FROM (SELECT *, CASE WHEN pre OR buf = '' THEN s ELSE buf || ' ' || s END AS b1 FROM (
    SELECT g.doc_id, s.i, g.buf, s.s, g.buf <> '' AND length(g.buf) + 1 + length(s.s) > 300 AS pre FROM grow g JOIN doc_sents s ON g.doc_id = s.doc_id AND s.i = g.i + 1))
), grow_out AS (
  SELECT doc_id, i, x.k, x.t FROM grow, LATERAL (SELECT unnest(o) AS t, unnest(range(len(o))) AS k) x
  UNION ALL
  SELECT doc_id, i, 9, buf FROM (SELECT *, max(i) OVER (PARTITION BY doc_id) AS n FROM grow) WHERE i = n AND buf <> ''
), pieces AS (
  SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i, k) - 1)::INT AS idx, t AS text FROM grow_out
)"""

OUTCOMES = """outcomes AS (
  SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, value AS latency_s,
         CASE WHEN event_type = 'error' THEN 'server' END AS error FROM events
)"""
