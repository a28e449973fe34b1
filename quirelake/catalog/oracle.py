"""ANSI SQL (as DuckDB runs it) for the registered queries, over the given tables as views.

Written from the definitions and, where the plan on Spark is not the obvious one, in another
way: runs grown word by word, anchors by recursion, the event log folded step by step.
"""

from __future__ import annotations

from quirelake.catalog.inputs import LIVE, QUERIES

# --- inputs ----------------------------------------------------------------------------------

_WORDS = """
tok AS (
  SELECT doc_id, list_filter(string_split_regex(text, '[ \\n]+'), lambda t: t <> '') AS ts FROM documents
), numbered AS (
  SELECT doc_id, unnest(ts) AS text, generate_subscripts(ts, 1) - 1 AS g FROM tok
), words AS (
  SELECT doc_id, CAST(g // 400 AS INTEGER) AS page_idx, CAST(g % 400 AS INTEGER) AS word_idx, text,
    CAST(36 + (g % 10) * 54 AS DOUBLE) AS left_pt,
    CAST(746 - ((g % 400) // 10) * 18 - (g * 7) % 5 AS DOUBLE) AS bottom_pt,
    CAST(36 + (g % 10) * 54 + 5 * least(length(text), 10) AS DOUBLE) AS right_pt,
    CAST(756 - ((g % 400) // 10) * 18 - (g * 7) % 5 AS DOUBLE) AS top_pt,
    CAST(8 + g % 5 AS DOUBLE) AS font_size,
    CASE g % 8 WHEN 0 THEN 'ABCDEF+Arial' WHEN 1 THEN 'Arial-BoldItalic' WHEN 2 THEN 'Times,Bold'
      WHEN 3 THEN 'Helvetica-Regular' WHEN 4 THEN 'Georgia-Roman' WHEN 5 THEN 'A+B+C'
      WHEN 6 THEN 'XYZ+-Bold' END AS font_name
  FROM numbered
), doc_pages AS (
  SELECT DISTINCT doc_id, page_idx, CAST(612 AS DOUBLE) AS width_pt, CAST(792 AS DOUBLE) AS height_pt FROM words
), totals AS (
  SELECT doc_id, count(*) AS n FROM doc_pages GROUP BY doc_id
)"""

_QUERIES = "queries(query_id, q) AS (VALUES " + ", ".join(f"({i}, '{q}')" for i, q in LIVE) + ")"


def _placed(pages: int) -> str:
    return f"""
  SELECT event_id, event_type, user_id AS doc_id, CAST(event_id % {pages} AS INTEGER) AS page_idx,
    CAST(event_id * 37 % 1100 AS DOUBLE) AS x, CAST(event_id * 53 % 1500 AS DOUBLE) AS y,
    CAST(60 + event_id % 300 AS DOUBLE) AS w, CAST(20 + event_id % 200 AS DOUBLE) AS h
  FROM events"""


_PLACED = f"placed AS ({_placed(2)})"

_ANN = f"""
spread AS ({_placed(3)}),
ann AS (
  SELECT doc_id, page_idx, event_id AS seq, x, y, w, h,
    CASE event_type WHEN 'view' THEN 'highlight' WHEN 'click' THEN 'ink' WHEN 'signup' THEN 'text'
      WHEN 'purchase' THEN 'text_edit' ELSE 'signature' END AS kind,
    CASE WHEN event_type = 'view' THEN CAST(event_id % 9 AS DOUBLE) WHEN event_type = 'purchase' THEN w END AS rw,
    CASE WHEN event_type = 'view' THEN CAST(event_id % 7 AS DOUBLE) WHEN event_type = 'purchase' THEN h END AS rh,
    CASE WHEN event_type = 'purchase' THEN 'item ' || (event_id % 7)
      WHEN event_type <> 'signup' THEN NULL
      WHEN event_id % 7 = 0 THEN '   '
      WHEN event_id % 3 = 0 THEN ' note ' || event_id || chr(10) || chr(10) || 'more'
      ELSE ' note ' || event_id END AS content,
    CASE WHEN event_type = 'purchase' THEN 'item ' || (event_id % 5) END AS original,
    CASE event_type WHEN 'signup' THEN 14.0::DOUBLE WHEN 'purchase' THEN CAST(10 + event_id % 5 AS DOUBLE) END AS fs,
    event_id % 6 + 1 AS n_points,
    CAST(1 + event_id % 20 AS DOUBLE) AS stroke_width,
    CAST(event_id % 256 AS INTEGER) AS r
  FROM spread
), ink AS (
  SELECT doc_id, page_idx, seq, k, x + 4 * k AS px, y + k * k AS py
  FROM (SELECT *, unnest(range(0, n_points)) AS k FROM ann WHERE kind = 'ink')
), sig_points(stroke, k, px, py) AS (
  VALUES (0, 0, 0.0::DOUBLE, 0.0::DOUBLE), (0, 1, 10.0, 5.0), (0, 2, 20.0, 0.0), (1, 0, 0.0, 10.0), (1, 1, 5.0, 11.0)
), sig AS (
  SELECT a.doc_id, a.page_idx, a.seq, a.x, a.y, p.*
  FROM ann a JOIN sig_points p ON p.stroke = 0 OR p.k < a.seq % 3 WHERE a.kind = 'signature'
)"""

# Accepted as drawn: content trimmed, specks gone.
_TRIM = "regexp_replace(regexp_replace({}, '^\\s+', ''), '\\s+$', '')"
_ACCEPTED = f"""
accepted AS (
  SELECT * REPLACE (CASE WHEN kind = 'text' THEN {_TRIM.format('content')} ELSE content END AS content)
  FROM ann
  WHERE CASE kind WHEN 'highlight' THEN rw > 3 AND rh > 3 WHEN 'ink' THEN n_points > 2
    WHEN 'text' THEN {_TRIM.format('content')} <> '' ELSE true END
)"""

_LOG = """
log AS (
  SELECT user_id AS doc_id, event_id AS seq, CAST(event_id % 3 AS INTEGER) AS page_idx, op,
    CASE op WHEN 'add' THEN event_id WHEN 'delete' THEN back END AS annot_id
  FROM (
    SELECT event_id, user_id,
      lag(event_id, 3) OVER (PARTITION BY user_id ORDER BY event_id) AS back,
      CASE WHEN event_id % 97 = 0 THEN 'reload' WHEN event_id % 31 = 0 THEN 'clear'
        WHEN event_id % 5 = 0 THEN 'undo' WHEN event_id % 7 = 0 THEN 'delete' ELSE 'add' END AS op
    FROM events
  )
)"""

# Positions of the words of a page within its text, and every run from each word grown at once:
# the text from the word on is cut after the first occurrence of the query.
_RUNS = f"""
{_QUERIES},
page_strings AS (
  SELECT doc_id, page_idx, lower(string_agg(text, ' ' ORDER BY word_idx)) AS s FROM words GROUP BY doc_id, page_idx
), starts AS (
  SELECT doc_id, page_idx, word_idx AS i,
    CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id, page_idx ORDER BY word_idx
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) + 1 AS start_at
  FROM words
), cuts AS (
  SELECT query_id, q, doc_id, page_idx, i, substr(substr(s, start_at), 1, instr(substr(s, start_at), q) - 1 + length(q)) AS m
  FROM starts JOIN page_strings USING (doc_id, page_idx), queries
  WHERE instr(substr(s, start_at), q) > 0
), runs AS (
  SELECT query_id, doc_id, page_idx, i, CAST(i + len(string_split(m, ' ')) - 1 AS INTEGER) AS j
  FROM cuts
  WHERE len(string_split(m, ' ')) = 1
    OR length(array_to_string(list_slice(string_split(m, ' '), 1, len(string_split(m, ' ')) - 1), ' ')) < length(q) + 20
)"""

_HITS = """
hits AS (
  SELECT r.query_id, r.doc_id, r.page_idx, r.i, r.j, min(left_pt) AS left_pt, min(bottom_pt) AS bottom_pt,
    max(right_pt) AS right_pt, max(top_pt) AS top_pt
  FROM runs r JOIN words w ON w.doc_id = r.doc_id AND w.page_idx = r.page_idx AND w.word_idx BETWEEN r.i AND r.j
  GROUP BY ALL
)"""

# The same for the phrases of the benchmark texts; only pages that hold a phrase are grown on.
_MANY_RUNS = """
phrases AS (
  SELECT row_number() OVER () AS phrase, query_id, lower(q) AS q FROM (
    SELECT CAST(item_id AS INTEGER) AS query_id,
      array_to_string(list_slice(ws, i, CASE WHEN i + 3 > greatest(len(ws) - 2, 1) THEN len(ws) ELSE i + 2 END), ' ') AS q
    FROM (SELECT item_id, string_split_regex(text, '[ \\n]+') AS ws FROM benchmark),
      unnest(range(1, greatest(len(ws) - 2, 1) + 1, 3)) AS u(i)) WHERE trim(q) <> ''
), page_strings AS (
  SELECT doc_id, page_idx, lower(string_agg(text, ' ' ORDER BY word_idx)) AS s FROM words GROUP BY doc_id, page_idx
), holding AS (
  SELECT phrase, query_id, q, doc_id, page_idx, s FROM page_strings, phrases WHERE contains(s, q)
), starts AS (
  SELECT doc_id, page_idx, word_idx AS i,
    CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id, page_idx ORDER BY word_idx
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) + 1 AS start_at
  FROM words
), cuts AS (
  SELECT phrase, query_id, q, doc_id, page_idx, i, substr(substr(s, start_at), 1, instr(substr(s, start_at), q) - 1 + length(q)) AS m
  FROM holding JOIN starts USING (doc_id, page_idx)
  WHERE instr(substr(s, start_at), q) > 0
), runs AS (
  SELECT phrase, query_id, doc_id, page_idx, i, CAST(i + len(string_split(m, ' ')) - 1 AS INTEGER) AS j
  FROM cuts
  WHERE len(string_split(m, ' ')) = 1
    OR length(array_to_string(list_slice(string_split(m, ' '), 1, len(string_split(m, ' ')) - 1), ' ')) < length(q) + 20
)"""

_HITS_OF_ROWS = """
hits AS (
  SELECT query_id, doc_id, page_idx, i, j, left_pt, bottom_pt, right_pt, top_pt FROM (
    SELECT r.phrase, r.query_id, r.doc_id, r.page_idx, r.i, r.j, min(left_pt) AS left_pt, min(bottom_pt) AS bottom_pt,
      max(right_pt) AS right_pt, max(top_pt) AS top_pt
    FROM runs r JOIN words w ON w.doc_id = r.doc_id AND w.page_idx = r.page_idx AND w.word_idx BETWEEN r.i AND r.j
    GROUP BY ALL)
)"""

# Words not under an edit, numbered anew.
_SHOWN = """
shown AS (
  SELECT * REPLACE (CAST(row_number() OVER (PARTITION BY doc_id, page_idx ORDER BY word_idx) - 1 AS INTEGER) AS word_idx)
  FROM words v WHERE NOT EXISTS (
    SELECT 1 FROM ann a WHERE a.kind = 'text_edit' AND a.doc_id = v.doc_id AND a.page_idx = v.page_idx
      AND (left_pt + right_pt) / 2 BETWEEN (x - 2) / 2 AND (x + w + 2) / 2
      AND (bottom_pt + top_pt) / 2 BETWEEN 792 - (y + h + 2) / 2 AND 792 - (y - 2) / 2)
)"""

_IN_REGION = """
inside AS (
  SELECT p.event_id AS region_id, w.* FROM placed p JOIN words w USING (doc_id, page_idx)
  WHERE (w.left_pt + w.right_pt) / 2 BETWEEN p.x / 2 AND (p.x + p.w) / 2
    AND (w.bottom_pt + w.top_pt) / 2 BETWEEN 792 - (p.y + p.h) / 2 AND 792 - p.y / 2
)"""


def _lines(source: str, keys: str) -> str:
    """Lines of ``source`` by walking from anchor to anchor."""
    return f"""
tops AS (SELECT DISTINCT {keys}, top_pt FROM {source}),
anchors AS (
  SELECT {keys}, max(top_pt) AS a, 0 AS n FROM tops GROUP BY {keys}
  UNION ALL
  SELECT {keys}, max(t.top_pt), n + 1 FROM anchors JOIN tops t USING ({keys})
  WHERE a - t.top_pt > 3 GROUP BY {keys}, a, n
), top_lines AS (
  SELECT {keys}, t.top_pt, CAST(max(n) AS INTEGER) AS line_no
  FROM tops t JOIN anchors USING ({keys}) WHERE a >= t.top_pt GROUP BY {keys}, t.top_pt
), lined AS (SELECT * FROM {source} JOIN top_lines USING ({keys}, top_pt))"""


# Words on the canvas: twice the points, upside down.
_CANVAS = """
canvas AS (
  SELECT doc_id, page_idx, word_idx, text, font_size, font_name, left_pt * 2 AS l, right_pt * 2 AS r,
    1584 - top_pt * 2 AS t, 1584 - bottom_pt * 2 AS b
  FROM words
)"""

_DIRECT = """
direct AS (
  SELECT c.event_id AS click_id, v.* FROM placed c JOIN canvas v USING (doc_id, page_idx)
  WHERE c.y BETWEEN v.t - 3 AND v.b + 3
)"""

_NEAREST = """
lost AS (SELECT * FROM placed WHERE event_id NOT IN (SELECT click_id FROM direct)),
mids AS (
  SELECT c.event_id AS click_id, c.doc_id, c.page_idx,
    arg_min((v.t + v.b) / 2, abs((v.t + v.b) / 2 - c.y) * 1000 + v.word_idx / 1000.0) AS mid
  FROM lost c JOIN canvas v USING (doc_id, page_idx) GROUP BY ALL
), near AS (
  SELECT click_id, v.* FROM mids JOIN canvas v USING (doc_id, page_idx) WHERE abs((v.t + v.b) / 2 - mid) < 5
)"""

_FONT = """
CASE coalesce(arg_min(coalesce(font_name, '-'), l * 1000 + word_idx), '-')
  WHEN 'ABCDEF+Arial' THEN 'Arial' WHEN 'Arial-BoldItalic' THEN 'ArialItalic' WHEN 'Times,Bold' THEN 'Times'
  WHEN 'Helvetica-Regular' THEN 'Helvetica' WHEN 'Georgia-Roman' THEN 'Georgia' WHEN 'A+B+C' THEN 'B+C'
  ELSE 'Segoe UI' END"""


def _context(source: str) -> str:
    return f"""
SELECT click_id, doc_id, page_idx, string_agg(text, ' ' ORDER BY l, word_idx) AS text,
  min(l) AS x, min(t) AS y, max(r) - min(l) AS w, max(b) - min(t) AS h,
  greatest(arg_min(font_size, l * 1000 + word_idx) * 2, 10) AS font_size, {_FONT} AS font_name
FROM {source} GROUP BY click_id, doc_id, page_idx"""


# Pages of other sizes: fx and fy are pixels per point.
_SCALED = """
scaled AS (
  SELECT doc_id, page_idx, 792.0::DOUBLE * (1 + page_idx % 2) AS height, power(2.0::DOUBLE, doc_id % 3) AS fx,
    power(2.0::DOUBLE, (doc_id + page_idx) % 2 + 1) AS fy
  FROM doc_pages WHERE (doc_id + page_idx) % 5 <> 0
)"""

_MAP = "m.doc_id AS source_doc_id, m.page_idx AS source_page_idx"

# --- drawing: one select per kind, all with the same columns ---------------------------------

_N = "NULL::DOUBLE"


def _prim(kind, idx, x1=_N, y1=_N, x2=_N, y2=_N, w=_N, h=_N, text="NULL", font="NULL", size=_N, pen=_N, rgba=("0",) * 3 + ("255",)):
    measures = zip(("x1", "y1", "x2", "y2", "w", "h", "size", "pen_width"), (x1, y1, x2, y2, w, h, size, pen))
    cols = ", ".join(f"round({v}, 6) AS {n}" for n, v in measures)
    chans = ", ".join(f"CAST({v} AS INTEGER) AS {n}" for n, v in zip("rgba", rgba))
    return (
        f"doc_id, page_idx, seq, CAST({idx} AS INTEGER) AS prim_idx, '{kind}' AS kind,"
        f" CAST({text} AS VARCHAR) AS text, CAST({font} AS VARCHAR) AS font, {cols}, {chans}"
    )


_RGBA = ("r", "0", "255", "80")
_ON_PAGE = "SEMI JOIN doc_pages USING (doc_id, page_idx)"


def _draw_text(source: str) -> str:
    return f"""
SELECT {_prim('string', 'row_number() OVER (PARTITION BY seq ORDER BY i) - 1', 'x / 2', 'y / 2 + fs / 2 + i * (fs / 2 * 1.2)',
              text='line', font="'Segoe UI'", size='fs / 2')}
FROM (
  SELECT *, unnest(string_split(content, chr(10))) AS line,
    generate_subscripts(string_split(content, chr(10)), 1) - 1 AS i
  FROM {source} {_ON_PAGE} WHERE kind = 'text'
) WHERE line <> ''"""


def _draw_highlight(source: str) -> str:
    return f"""
SELECT {_prim('rect', '0', 'x / 2', 'y / 2', w='rw / 2', h='rh / 2', rgba=_RGBA)}
FROM {source} {_ON_PAGE} WHERE kind = 'highlight'"""


def _draw_ink(source: str) -> str:
    return f"""
SELECT {_prim('line', 'k', 'px / 2', 'py / 2', 'qx / 2', 'qy / 2', pen='stroke_width / 2', rgba=_RGBA)}
FROM (
  SELECT i.*, a.stroke_width, a.r, lead(px) OVER s AS qx, lead(py) OVER s AS qy
  FROM ink i JOIN {source} a USING (doc_id, page_idx, seq)
  WINDOW s AS (PARTITION BY i.seq ORDER BY k)
) {_ON_PAGE} WHERE qx IS NOT NULL"""


def _draw_text_edit(source: str) -> str:
    white = ("255",) * 4
    return f"""
SELECT {_prim('rect', '0', '(x - 2) / 2', '(y - 2) / 2', w='(w + 4) / 2', h='(h + 4) / 2', rgba=white)}
FROM {source} {_ON_PAGE} WHERE kind = 'text_edit'
UNION ALL
SELECT {_prim('string', '1', 'x / 2', 'y / 2 + fs / 2', text='content', font="'Arial'", size='fs / 2')}
FROM {source} {_ON_PAGE} WHERE kind = 'text_edit'"""


def _draw_signature() -> str:
    return f"""
SELECT {_prim('line', 'row_number() OVER (PARTITION BY seq ORDER BY stroke, k) - 1', '(x + px / 2) / 2', '(y + py / 2) / 2',
              '(x + qx / 2) / 2', '(y + qy / 2) / 2', pen='0.5::DOUBLE')}
FROM (
  SELECT *, lead(px) OVER s AS qx, lead(py) OVER s AS qy FROM sig {_ON_PAGE}
  WINDOW s AS (PARTITION BY seq, stroke ORDER BY k)
) WHERE qx IS NOT NULL"""


def _flatten(source: str) -> str:
    kinds = (_draw_text(source), _draw_highlight(source), _draw_ink(source), _draw_text_edit(source), _draw_signature())
    return " UNION ALL ".join(kinds)


_EDITED = """
edits AS (
  SELECT user_id AS doc_id, CASE event_type WHEN 'click' THEN 'up' WHEN 'signup' THEN 'down' WHEN 'purchase' THEN
      CASE WHEN event_id % 3 = 0 THEN 'append' ELSE 'delete' END ELSE 'reorder' END AS op,
    event_id % 7 AS src, event_id * 3 % 11 AS dst, event_id * 7 % 1000 AS other_id,
    row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
unedited AS (
  SELECT doc_id, list({'d': doc_id, 'p': page_idx} ORDER BY page_idx) AS ps FROM doc_pages GROUP BY doc_id),
edited AS (
  SELECT doc_id, 0 AS rn, coalesce(ps, []) AS ps FROM unedited FULL JOIN (SELECT DISTINCT doc_id FROM edits) USING (doc_id)
  UNION ALL
  SELECT doc_id, rn, CASE WHEN op = 'append' THEN list_concat(ps, coalesce(other, []))
      WHEN src >= n THEN ps WHEN op = 'delete' THEN rest
      WHEN put BETWEEN 0 AND n - 1 AND dst <> src AND dst < n
        THEN list_concat(list_concat(rest[1:put], [ps[src + 1]]), rest[put + 1:]) ELSE ps END
  FROM (
    SELECT *, list_concat(ps[1:src], ps[src + 2:]) AS rest,
      CASE WHEN op = 'reorder' AND dst > src THEN dst - 1 ELSE dst END AS put
    FROM (
      SELECT e.doc_id, e.rn, p.ps, len(p.ps) AS n, o.ps AS other, op, src,
        CASE op WHEN 'up' THEN src - 1 WHEN 'down' THEN src + 1 ELSE dst END AS dst
      FROM edited p JOIN edits e ON e.doc_id = p.doc_id AND e.rn = p.rn + 1 LEFT JOIN unedited o ON o.doc_id = e.other_id))),
edited_pages AS (
  SELECT doc_id, CAST(unnest(range(0, len(ps))) AS INTEGER) AS page_idx, unnest(ps) AS page
  FROM (SELECT doc_id, max_by(ps, rn) AS ps FROM edited GROUP BY doc_id))"""


def _with(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",".join(c.strip() for c in ctes) + "\n"


_W = _with(_WORDS)
_WP = _with(_WORDS, _PLACED)
_WA = _with(_WORDS, _ANN)
_FINAL_STATE = """
docs AS (SELECT doc_id, count(*) AS n FROM log GROUP BY doc_id),
steps AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS rn FROM log),
fold AS (
  SELECT doc_id, CAST(0 AS BIGINT) AS rn, CAST([] AS STRUCT(page INTEGER, id BIGINT)[]) AS st FROM docs
  UNION ALL
  SELECT f.doc_id, e.rn, CASE e.op
    WHEN 'add' THEN list_append(f.st, {'page': e.page_idx, 'id': e.annot_id})
    WHEN 'delete' THEN list_filter(f.st, lambda s: s.id <> coalesce(e.annot_id, -1))
    WHEN 'undo' THEN list_filter(f.st, lambda s: s.id <> coalesce(list_filter(f.st, lambda u: u.page = e.page_idx)[-1].id, -1))
    WHEN 'clear' THEN list_filter(f.st, lambda s: s.page <> e.page_idx)
    ELSE CAST([] AS STRUCT(page INTEGER, id BIGINT)[]) END
  FROM fold f JOIN steps e ON e.doc_id = f.doc_id AND e.rn = f.rn + 1
), live AS (SELECT doc_id, unnest(st) AS s FROM fold JOIN docs USING (doc_id) WHERE rn = n)"""

_STATE_SQL = _with(_LOG, _FINAL_STATE) + """
SELECT doc_id, s.page AS page_idx, s.id AS seq, s.id AS annot_id FROM live"""

_PAGE_MOVE = """
SELECT m.doc_id AS source_doc_id, m.page_idx AS source_page_idx, m.doc_id,
  CAST(CASE WHEN NOT ok THEN m.page_idx WHEN m.page_idx = src THEN dst WHEN m.page_idx = dst THEN src
    ELSE m.page_idx END AS INTEGER) AS page_idx, '{name}' AS direction
FROM doc_pages m JOIN (
  SELECT doc_id, doc_id % n AS src, doc_id % n + {step} AS dst, doc_id % n + {step} BETWEEN 0 AND n - 1 AS ok FROM totals
) USING (doc_id)"""

SQL: dict[str, str] = {
    "layout_text": _W + "SELECT * FROM words",
    "corpus_roundtrip": _W + "SELECT doc_id, page_idx, word_idx, text, left_pt, top_pt, height_pt FROM words JOIN doc_pages USING (doc_id, page_idx)",
    "resaved_corpus": _W + """
SELECT doc_id, CAST(page_idx - (page_idx + 1) // 3 AS INTEGER) AS page_idx, word_idx, text, top_pt, height_pt
FROM words JOIN doc_pages USING (doc_id, page_idx) WHERE page_idx % 3 <> 1""",
    "read_documents": _W + "SELECT doc_id, page_idx, word_idx, text FROM words WHERE doc_id % 97 = 5",
    "burned_corpus": _WA + _flatten("ann"),
    "pdf_inventory": """
SELECT 'source=' || source AS folder, CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS n_bytes FROM documents GROUP BY source""",
    "select_files": """
SELECT path, n_chars AS length FROM (
  SELECT source || '/' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.PDF' WHEN 2 THEN '.pdf.bak' ELSE '.txt' END AS path, n_chars
  FROM documents) WHERE path ILIKE '%.pdf'""",
    "triage_failures": """
SELECT *, coalesce(message ILIKE '%password%' OR message ILIKE '%protected%' OR message ILIKE '%encrypted%', false) AS is_protected
FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'Invalid PASSWORD on ' || event_type WHEN 1 THEN 'file is Encrypted'
  WHEN 2 THEN event_type || ': Protected document' WHEN 3 THEN 'unexpected end of file' END AS message FROM events)""",
    "page_inventory": _W + "SELECT doc_id, page_idx, 'Page ' || (page_idx + 1) AS label FROM doc_pages",
    "signature_roundtrip": """
SELECT 's' || event_id AS id, 'Signature ' || event_id AS name, 400.0::DOUBLE AS canvas_w,
  CAST(100 + event_id % 100 AS DOUBLE) AS canvas_h,
  '[[{"x":0.0,"y":0.0},{"x":10.0,"y":5.0},{"x":20.0,"y":0.0}],[' ||
  CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN '{"x":0.0,"y":10.0}' ELSE '{"x":0.0,"y":10.0},{"x":5.0,"y":11.0}' END || ']]' AS strokes
FROM events WHERE event_type = 'error'""",
    "signature_array_roundtrip": """
SELECT CAST(event_id % 8 AS BIGINT) AS shard, 's' || event_id AS id, 400.0::DOUBLE AS canvas_w,
  CAST(100 + event_id % 100 AS DOUBLE) AS canvas_h, CAST(3 + event_id % 3 AS INTEGER) AS n_points
FROM events WHERE event_type = 'error'""",
    "page_to_canvas": _W + """
SELECT doc_id, page_idx, word_idx, left_pt * 2 AS x, 1584 - top_pt * 2 AS y, (right_pt - left_pt) * 2 AS w,
  (top_pt - bottom_pt) * 2 AS h FROM words""",
    "canvas_to_page": _WP + """
SELECT event_id AS region_id, x / 2 AS "left", 792 - (y + h) / 2 AS bottom, (x + w) / 2 AS "right", 792 - y / 2 AS top
FROM placed SEMI JOIN doc_pages USING (doc_id, page_idx)""",
    "highlight_box": _WA + """
SELECT seq, x, y, greatest(rw, 4) AS w, greatest(rh, 4) AS h FROM ann SEMI JOIN doc_pages USING (doc_id, page_idx)
WHERE kind = 'highlight'""",
    "normalise_drag": """
SELECT event_id AS drag_id, least(x0, x1) AS x, least(y0, y1) AS y, abs(x1 - x0) AS w, abs(y1 - y0) AS h
FROM (SELECT event_id, CAST(event_id * 37 % 1100 AS DOUBLE) AS x0, CAST(event_id * 53 % 1500 AS DOUBLE) AS y0,
  CAST(event_id * 91 % 1100 AS DOUBLE) AS x1, CAST(event_id * 17 % 1500 AS DOUBLE) AS y1 FROM events)""",
    "clamp_points": _with(_ANN) + """
SELECT seq, CAST(k AS INTEGER) AS i, CASE WHEN k = 0 THEN px ELSE least(px, 500) END AS x,
  CASE WHEN k = 0 THEN py ELSE least(py, 700) END AS y FROM ink""",
    "normalise_font": _W + """
SELECT doc_id, page_idx, word_idx, CASE font_name WHEN 'ABCDEF+Arial' THEN 'Arial' WHEN 'Arial-BoldItalic' THEN 'ArialItalic'
  WHEN 'Times,Bold' THEN 'Times' WHEN 'Helvetica-Regular' THEN 'Helvetica' WHEN 'Georgia-Roman' THEN 'Georgia'
  WHEN 'A+B+C' THEN 'B+C' ELSE 'Segoe UI' END AS font FROM words""",
    "edit_font_size": _W + """
SELECT doc_id, page_idx, word_idx, greatest(10, CASE WHEN word_idx % 3 > 0 THEN font_size
  WHEN word_idx % 2 = 0 THEN 7.5 ELSE 15 END)::DOUBLE AS size FROM words""",
    "accept_annotations": _with(_ANN, _ACCEPTED) + "SELECT doc_id, page_idx, seq, kind, content FROM accepted",
    "accept_strokes": """
SELECT 's' || event_id AS id,
  CAST((event_id % 2)  + CASE WHEN event_id % 2 = 1 AND event_id % 3 = 2 THEN 1 ELSE 0 END AS INTEGER) AS n_strokes,
  '[[{"x":0.0,"y":0.0},{"x":10.0,"y":5.0},{"x":20.0,"y":0.0}]' ||
  CASE WHEN event_id % 3 = 2 THEN ',[{"x":0.0,"y":10.0},{"x":5.0,"y":11.0}]' ELSE '' END || ']' AS strokes
FROM events WHERE event_type = 'error' AND event_id % 2 = 1""",
    "accept_text_edits": _with(_ANN) + f"""
SELECT doc_id, page_idx, seq, {_TRIM.format('content')} AS content, original FROM ann
WHERE kind = 'text_edit' AND {_TRIM.format('content')} NOT IN ('', original)""",
    "burnable": _WA + "SELECT doc_id, page_idx, seq, kind FROM ann SEMI JOIN doc_pages USING (doc_id, page_idx)",
    "search_gate": """
WITH typed AS (SELECT event_id AS query_id, CASE WHEN event_id % 4 = 3 THEN '  ' ELSE "left"(event_type, event_id % 4) END AS q FROM events)
SELECT query_id, q, 'live' AS mode FROM typed WHERE trim(q) <> '' AND length(q) > 1
UNION ALL SELECT query_id, q, 'enter' AS mode FROM typed WHERE trim(q) <> ''""",
    "words_in_region": _with(_WORDS, _PLACED, _IN_REGION) + "SELECT region_id, doc_id, page_idx, word_idx, text FROM inside",
    "hit_test": _with(_WORDS, _PLACED, _ANN) + """
, ink_box AS (SELECT seq, min(px) AS x0, min(py) AS y0, max(px) AS x1, max(py) AS y1 FROM ink GROUP BY seq),
clicks AS (SELECT event_id AS click_id, doc_id, page_idx, x + 20 AS cx, y AS cy FROM placed),
targets AS (
  SELECT doc_id, page_idx, a.seq, kind, CASE kind WHEN 'ink' THEN x0 ELSE x END AS x, CASE kind WHEN 'ink' THEN y0 ELSE y END AS y,
    CASE kind WHEN 'ink' THEN greatest(x1 - x0, 4) WHEN 'text' THEN w + 8 WHEN 'signature' THEN 200 ELSE rw END AS w,
    CASE kind WHEN 'ink' THEN greatest(y1 - y0, 4) WHEN 'text' THEN h + 8 WHEN 'signature' THEN 75 ELSE rh END AS h
  FROM ann a LEFT JOIN ink_box b ON a.kind = 'ink' AND a.seq = b.seq
), boxed AS (
  SELECT click_id, t.* FROM clicks JOIN targets t USING (doc_id, page_idx)
  WHERE kind <> 'ink' AND cx BETWEEN x AND x + w AND cy BETWEEN y AND y + h
), inked AS (
  SELECT DISTINCT click_id, t.* FROM clicks c JOIN ink i USING (doc_id, page_idx) JOIN targets t ON t.seq = i.seq
  WHERE sqrt((px - cx) * (px - cx) + (py - cy) * (py - cy)) < 15
)
SELECT click_id, doc_id, page_idx, seq, kind, x, y, w, h FROM (SELECT * FROM boxed UNION ALL SELECT * FROM inked)
QUALIFY row_number() OVER (PARTITION BY click_id ORDER BY seq DESC) = 1""".replace("\n, ink_box", ", ink_box", 1),
    "line_at_point": _with(_WORDS, _PLACED, _CANVAS, _DIRECT) + _context("direct"),
    "nearest_line": _with(_WORDS, _PLACED, _CANVAS, _DIRECT, _NEAREST) + _context("near"),
    "edit_target": _with(_WORDS, _PLACED, _CANVAS, _DIRECT, _NEAREST)
    + f"SELECT * FROM ({_context('direct')} UNION ALL {_context('near')})",
    "place_signatures": _with(_PLACED) + """
SELECT p.doc_id, p.page_idx, p.event_id AS seq, 'signature' AS kind, x, y, 0.5::DOUBLE AS scale, 400.0::DOUBLE AS src_w,
  CAST(100 + e.event_id % 100 AS DOUBLE) AS src_h, '[[{"x":0.0,"y":0.0},{"x":10.0,"y":5.0},{"x":20.0,"y":0.0}],[' ||
  CASE e.event_id % 3 WHEN 0 THEN '' WHEN 1 THEN '{"x":0.0,"y":10.0}' ELSE '{"x":0.0,"y":10.0},{"x":5.0,"y":11.0}' END || ']]' AS strokes
FROM placed p JOIN events e ON e.event_id = p.event_id * 7 // 10 AND e.event_type = 'error'""",
    "with_dims": _WA + "SELECT doc_id, page_idx, seq, 0.5::DOUBLE AS sx, 0.5::DOUBLE AS sy FROM ann SEMI JOIN doc_pages USING (doc_id, page_idx)",
    "visible_words": _with(_WORDS, _ANN) + """
SELECT doc_id, page_idx, word_idx, text FROM words v WHERE NOT EXISTS (
  SELECT 1 FROM ann a WHERE a.kind = 'text_edit' AND a.doc_id = v.doc_id AND a.page_idx = v.page_idx
    AND (left_pt + right_pt) / 2 BETWEEN (x - 2) / 2 AND (x + w + 2) / 2
    AND (bottom_pt + top_pt) / 2 BETWEEN 792 - (y + h + 2) / 2 AND 792 - (y - 2) / 2)""",
    "group_lines": _with(_WORDS, _lines("words", "doc_id, page_idx")) + "SELECT doc_id, page_idx, word_idx, line_no FROM lined",
    "line_bounds": _with(_WORDS, _lines("words", "doc_id, page_idx")) + """
SELECT doc_id, page_idx, line_no, min(left_pt) AS left_pt, min(bottom_pt) AS bottom_pt, max(right_pt) AS right_pt,
  max(top_pt) AS top_pt, max(right_pt) - min(left_pt) AS width_pt, max(top_pt) - min(bottom_pt) AS height_pt
FROM lined GROUP BY doc_id, page_idx, line_no""",
    "region_text": _with(_WORDS, _PLACED, _IN_REGION, _lines("inside", "region_id")) + """
SELECT region_id, string_agg(t, chr(10) ORDER BY line_no) AS text, CAST(sum(n) AS BIGINT) AS n_words FROM (
  SELECT region_id, line_no, string_agg(text, ' ' ORDER BY top_pt DESC, left_pt, word_idx) AS t, count(*) AS n
  FROM lined GROUP BY region_id, line_no) GROUP BY region_id""",
    "page_text": _W + "SELECT doc_id, page_idx, string_agg(text, ' ' ORDER BY word_idx) AS text FROM words GROUP BY doc_id, page_idx",
    "reading_order": _W + """
SELECT doc_id, page_idx, word_idx, row_number() OVER (PARTITION BY doc_id, page_idx ORDER BY top_pt DESC, left_pt, word_idx) - 1 AS read_pos
FROM words""",
    "left_to_right": _with(_WORDS, _lines("words", "doc_id, page_idx")) + """
SELECT doc_id, page_idx, word_idx, line_no,
  row_number() OVER (PARTITION BY doc_id, page_idx, line_no ORDER BY left_pt, word_idx) - 1 AS line_pos FROM lined""",
    "phrase_search_joined": _with(_WORDS, _RUNS, _HITS) + "SELECT * FROM hits",
    "phrase_search_all": _with(_WORDS, _MANY_RUNS, _HITS_OF_ROWS) + "SELECT * FROM hits",
    "search_counts_all": _with(_WORDS, _MANY_RUNS) + """
SELECT query_id, doc_id, page_idx, count(*) AS n_hits, count(*) || ' found' AS status FROM runs
GROUP BY query_id, doc_id, page_idx""",
    "phrase_search_gaps": _with(_WORDS, _ANN, _SHOWN, _RUNS.replace("FROM words", "FROM shown")) + """
SELECT query_id, doc_id, page_idx, i, j FROM runs""",
    "phrase_search": _with(_WORDS, _RUNS, _HITS) + "SELECT * FROM hits",
    "search_counts": _with(_WORDS, _RUNS) + """
SELECT query_id, doc_id, page_idx, n_hits, CASE WHEN n_hits > 0 THEN n_hits || ' found' ELSE 'No matches' END AS status FROM (
  SELECT q.query_id, p.doc_id, p.page_idx, count(r.i) AS n_hits
  FROM doc_pages p CROSS JOIN queries q LEFT JOIN runs r ON r.query_id = q.query_id AND r.doc_id = p.doc_id AND r.page_idx = p.page_idx
  GROUP BY ALL)""",
    "search_boxes": _with(_WORDS, _RUNS, _HITS) + """
SELECT query_id, doc_id, page_idx, i, j, left_pt * 2 AS x, 1584 - top_pt * 2 AS y,
  greatest((right_pt - left_pt) * 2, 4) AS w, greatest((top_pt - bottom_pt) * 2, 4) AS h FROM hits""",
    "page_counts": _W + "SELECT doc_id, n AS n_pages FROM totals",
    "merged_page_counts": _W + "SELECT doc_id // 10 AS doc_id, count(*) AS n_pages FROM doc_pages GROUP BY ALL",
    "raster_dims": _W + """
SELECT doc_id, CAST(greatest(1, max(floor((612 + doc_id % 7 * 0.5 + page_idx) * 150 / 72))) AS INTEGER) AS raster_w,
  1650 AS raster_h FROM doc_pages GROUP BY doc_id""",
    "merge_documents": _W + f"""
SELECT {_MAP}, m.doc_id // 10 AS doc_id,
  CAST(row_number() OVER (PARTITION BY m.doc_id // 10 ORDER BY m.doc_id, m.page_idx) - 1 AS INTEGER) AS page_idx FROM doc_pages m""",
    "merged_words": _W + """
, m AS (
  SELECT *, doc_id // 10 AS to_doc,
    CAST(row_number() OVER (PARTITION BY doc_id // 10 ORDER BY doc_id, page_idx) - 1 AS INTEGER) AS to_page FROM doc_pages)
SELECT to_doc AS doc_id, to_page AS page_idx, word_idx, text FROM words JOIN m USING (doc_id, page_idx)""",
    "extract_pages": _W + f"""
SELECT {_MAP}, m.doc_id, CAST(row_number() OVER (PARTITION BY m.doc_id ORDER BY m.page_idx) - 1 AS INTEGER) AS page_idx
FROM doc_pages m WHERE page_idx % 2 = 0""",
    "delete_pages": _W + f"""
SELECT {_MAP}, m.doc_id, CAST(row_number() OVER (PARTITION BY m.doc_id ORDER BY m.page_idx) - 1 AS INTEGER) AS page_idx
FROM doc_pages m WHERE page_idx % 3 <> 1""",
    "move_page": _W + _PAGE_MOVE.format(name="up", step="-1") + " UNION ALL " + _PAGE_MOVE.format(name="down", step="1"),
    "reorder_page": _W + """
, moves AS (SELECT doc_id, CAST(doc_id % n AS INTEGER) AS src, CAST(doc_id * 3 % n AS INTEGER) AS dst, CAST(n AS INTEGER) AS n FROM totals),
taken AS (
  SELECT *, CASE WHEN dst > src THEN dst - 1 ELSE dst END AS put, list_filter(range(0, n), lambda p: p <> src) AS rest FROM moves),
placed AS (
  SELECT doc_id, CASE WHEN src = dst THEN range(0, n)
    ELSE list_concat(list_concat(list_slice(rest, 1, put), [src::BIGINT]), list_slice(rest, put + 1, n)) END AS pages FROM taken)
SELECT doc_id AS source_doc_id, CAST(unnest(pages) AS INTEGER) AS source_page_idx, doc_id,
  CAST(generate_subscripts(pages, 1) - 1 AS INTEGER) AS page_idx FROM placed""",
    "edited_pages": _with(_WORDS, _EDITED) + """
SELECT page.d AS source_doc_id, page.p AS source_page_idx, doc_id, page_idx FROM edited_pages""",
    "edited_words": _with(_WORDS, _EDITED) + """
SELECT e.doc_id, e.page_idx, w.word_idx, w.text
FROM edited_pages e JOIN words w ON w.doc_id = e.page.d AND w.page_idx = e.page.p""",
    "invalidate_annotations": _WA + """
SELECT doc_id, page_idx, seq FROM ann WHERE doc_id % 3 <> 0 OR doc_id NOT IN (SELECT doc_id FROM doc_pages)""",
    "undo_last": _with(_ANN) + """
SELECT doc_id, page_idx, seq FROM ann QUALIFY row_number() OVER (PARTITION BY doc_id, page_idx ORDER BY seq DESC) > 1""",
    "z_order": _with(_ANN) + """
SELECT doc_id, page_idx, seq, row_number() OVER (PARTITION BY doc_id, page_idx ORDER BY seq) - 1 AS z FROM ann""",
    "ink_bounds": _with(_ANN) + """
SELECT doc_id, page_idx, seq, min(px) AS x, min(py) AS y, greatest(max(px) - min(px), 4) AS w, greatest(max(py) - min(py), 4) AS h
FROM ink GROUP BY doc_id, page_idx, seq""",
    "has_annotations": "SELECT doc_id, doc_id IN (SELECT user_id FROM events) AS has_annotations FROM documents",
    "annotation_state": _STATE_SQL,
    "draw_text": _WA + _draw_text("ann"),
    "draw_highlight": _WA + _draw_highlight("ann"),
    "draw_ink": _WA + _draw_ink("ann"),
    "draw_text_edit": _WA + _draw_text_edit("ann"),
    "draw_signature": _WA + _draw_signature(),
    "flatten_annotations": _with(_WORDS, _ANN, _ACCEPTED) + _flatten("accepted"),
    "scaled_page_to_canvas": _with(_WORDS, _SCALED) + """
SELECT doc_id, page_idx, word_idx, left_pt * fx AS x, (height - top_pt) * fy AS y, (right_pt - left_pt) * fx AS w,
  (top_pt - bottom_pt) * fy AS h FROM words JOIN scaled USING (doc_id, page_idx)""",
    "scaled_words_in_region": _with(_WORDS, _SCALED, _PLACED) + """
SELECT p.event_id AS region_id, doc_id, page_idx, w.word_idx, w.text
FROM placed p JOIN scaled s USING (doc_id, page_idx) JOIN words w USING (doc_id, page_idx)
WHERE (w.left_pt + w.right_pt) / 2 BETWEEN p.x / fx AND (p.x + p.w) / fx
  AND (w.bottom_pt + w.top_pt) / 2 BETWEEN height - (p.y + p.h) / fy AND height - p.y / fy""",
    "scaled_line_at_point": _with(_WORDS, _SCALED, _PLACED) + """
, canvas AS (
  SELECT doc_id, page_idx, word_idx, text, left_pt * fx AS l, right_pt * fx AS r, (height - top_pt) * fy AS t, (height - bottom_pt) * fy AS b
  FROM words JOIN scaled USING (doc_id, page_idx))
SELECT c.event_id AS click_id, doc_id, page_idx, string_agg(text, ' ' ORDER BY l, word_idx) AS text,
  min(l) AS x, min(t) AS y, max(r) - min(l) AS w, max(b) - min(t) AS h
FROM placed c JOIN canvas v USING (doc_id, page_idx) WHERE c.y BETWEEN v.t - 3 AND v.b + 3 GROUP BY ALL""",
    "scaled_search_boxes_all": _with(_WORDS, _SCALED, _RUNS, _HITS) + """
SELECT query_id, doc_id, page_idx, i, j, left_pt * fx AS x, (height - top_pt) * fy AS y,
  greatest((right_pt - left_pt) * fx, 4) AS w, greatest((top_pt - bottom_pt) * fy, 4) AS h
FROM hits JOIN scaled USING (doc_id, page_idx)""",
    "scaled_with_dims": _with(_WORDS, _SCALED, _ANN) + """
SELECT doc_id, page_idx, seq, 1 / fx AS sx, 1 / fy AS sy FROM ann JOIN scaled USING (doc_id, page_idx)""",
    "scaled_burnable": _with(_WORDS, _SCALED, _ANN) + """
SELECT doc_id, page_idx, seq, kind FROM ann SEMI JOIN scaled USING (doc_id, page_idx)""",
    "scaled_draw_highlight": _with(_WORDS, _SCALED, _ANN) + """
SELECT doc_id, page_idx, seq, round(x / fx, 6) AS x1, round(y / fy, 6) AS y1, round(rw / fx, 6) AS w, round(rh / fy, 6) AS h
FROM ann JOIN scaled USING (doc_id, page_idx) WHERE kind = 'highlight'""",
    "scaled_draw_ink": _with(_WORDS, _SCALED, _ANN) + """
SELECT doc_id, page_idx, seq, CAST(k AS INTEGER) AS prim_idx, round(px / fx, 6) AS x1, round(py / fy, 6) AS y1, round(qx / fx, 6) AS x2,
  round(qy / fy, 6) AS y2, round(stroke_width / fx, 6) AS pen_width
FROM (
  SELECT i.*, a.stroke_width, lead(px) OVER (PARTITION BY i.seq ORDER BY k) AS qx, lead(py) OVER (PARTITION BY i.seq ORDER BY k) AS qy
  FROM ink i JOIN ann a USING (seq))
JOIN scaled USING (doc_id, page_idx) WHERE qx IS NOT NULL""",
    "annotation_state_stream": _STATE_SQL,
    "search_stream": _with(_WORDS, _RUNS, _HITS) + "SELECT * FROM hits",
}
