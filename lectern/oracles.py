"""DuckDB SQL for the queries that SQL can express, by the same names."""

from __future__ import annotations

from .functions import words as W
from .functions.bengali import _ALL as GLYPHS
from .functions.text import tokens_of
from .operators.ledger import ACTIONS, FEATURES, PRIOR
from .queries import LABEL_QUESTIONS, PHRASE, QUESTION


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def tok(x: str) -> str:
    """SQL for the tokens of x."""
    found = f"regexp_extract_all(translate(lower(nfc_normalize({x})), '{W.BN_DIGITS}', '{W.ASCII_DIGITS}'), '{W.TOKEN}')"
    cut = f"list_transform({found}, lambda w: trim(w, '{W.TOKEN_EDGE}'))"
    return f"coalesce(list_filter({cut}, lambda w: length(w) > 1 AND NOT list_contains({_list(sorted(W.STOP))}, w)), [])"


NL = "chr(10)"
LINES = r"list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\r\n|[\n\r\x0b\x0c]'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) > 0)"
PAGES = f"""pg AS (SELECT doc_id, CAST(p + 1 AS INTEGER) AS page, list_slice(lines, p * 45 + 1, p * 45 + 45) AS lines
  FROM (SELECT doc_id, lines, unnest(range(0, greatest(CAST(ceil(len(lines) / 45.0) AS BIGINT), 1))) AS p FROM (SELECT doc_id, {LINES} AS lines FROM documents))),
tx AS (SELECT doc_id, page, coalesce(array_to_string(lines, {NL} || {NL}), '') AS text, lines FROM pg)"""
PDF_BLOCKS = f"""l AS (SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN [] ELSE list_transform({LINES}, lambda x: regexp_replace(x, '\\s+', ' ', 'g')) END AS lines FROM documents),
p AS (SELECT doc_id, lines, CAST(unnest(range(1, greatest(CAST(ceil(len(lines) / 40.0) AS BIGINT), 1) + 1)) AS INTEGER) AS page FROM l),
b AS (SELECT doc_id, page, CAST(k AS INTEGER) AS block, array_to_string(part, {NL}) AS text, len(part) AS n, list_max(list_transform(part, lambda x: length(x))) AS wide
  FROM (SELECT doc_id, page, k, list_slice(lines, (page - 1) * 40 + k * 5 + 1, least((page - 1) * 40 + k * 5 + 5, page * 40)) AS part FROM (SELECT *, unnest(range(0, 8)) AS k FROM p)) WHERE len(part) > 0)"""
UNITS = f"""{PAGES},
u AS (SELECT doc_id, page, text, {tok("text")} AS toks FROM tx WHERE text <> '')"""
TERMS = list(dict.fromkeys(tokens_of(QUESTION)))
IDF = "ln(1.0::DOUBLE + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))"


def covers(word: str) -> str:
    exact = f"list_contains(toks, '{word}')"
    return exact if len(word) < 5 else f"({exact} OR len(list_filter(toks, lambda t: length(t) >= 4 AND substr(t, 1, 4) = '{word[:4]}')) > 0)"


def _scores(units: str, made: str) -> str:
    """made: units with bm25, coverage and score for the fixed question."""
    stats = ", ".join(f"sum(CAST(list_contains(toks, '{w}') AS INT)) AS d{i}" for i, w in enumerate(TERMS))
    idfs = [IDF.replace("df", f"d{i}") for i in range(len(TERMS))]
    held = [f"len(list_filter(toks, lambda t: t = '{w}'))" for w in TERMS]
    part = " + ".join(f"{g} * {f} * {W.K1 + 1}::DOUBLE / ({f} + {W.K1}::DOUBLE * ({1 - W.B}::DOUBLE + {W.B}::DOUBLE * len(toks) / (total / n)))" for g, f in zip(idfs, held))
    covered = " + ".join(f"CASE WHEN {covers(w)} THEN {g} ELSE 0 END" for g, w in zip(idfs, TERMS))
    return f"""{made}1 AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(sum(len(toks)) AS DOUBLE) AS total, {stats} FROM {units}),
{made}2 AS (SELECT {units}.*, {made}1.*, {part} AS bm25, ({covered}) / ({" + ".join(idfs)}) AS coverage FROM {units} CROSS JOIN {made}1),
{made} AS (SELECT *, bm25 * (0.25::DOUBLE + 0.75::DOUBLE * coverage) AS score FROM {made}2)"""


def _scored() -> str:
    return f"{UNITS}, {_scores('u', 'sc')}"


def _trigrams() -> str:
    import re

    out = []
    for i, w in enumerate(TERMS):
        if len(w) >= 4:
            padded = f" {re.sub('[^a-z0-9]+', ' ', w)} "
            grams = sorted({padded[j : j + 3] for j in range(len(padded) - 2)})
            hits = " + ".join(f"CAST(contains(flat, '{g}') AS INT)" for g in grams)
            out.append(f"{IDF.replace('df', f'd{i}')} * ({hits}) / {len(grams)}.0::DOUBLE")
    return f"""{_scored()},
fz AS (SELECT *, {" + ".join(out)} AS fuzzy FROM (SELECT *, ' ' || regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g') || ' ' AS flat FROM sc))"""


CHUNKS = f"""{PAGES.replace("pg AS (", "RECURSIVE pg AS (", 1)},
fold(doc_id, page, lines, i, chunk, open, n, whole) AS (
  SELECT doc_id, page, lines, 0, 0, CAST([] AS VARCHAR[]), 0, false FROM tx
  UNION ALL
  SELECT doc_id, page, lines, i + 1, CASE WHEN whole THEN chunk + 1 ELSE chunk END,
    list_append(CASE WHEN whole THEN CAST([] AS VARCHAR[]) ELSE open END, lines[i + 1]),
    CASE WHEN whole THEN 0 ELSE n END + length(lines[i + 1]),
    CASE WHEN whole THEN 0 ELSE n END + length(lines[i + 1]) >= {W.CHUNK_TARGET}
  FROM fold WHERE i < len(lines)),
ck AS (SELECT doc_id, page, chunk, array_to_string(arg_max(open, i), ' ') AS text FROM fold WHERE i > 0 GROUP BY doc_id, page, chunk)"""
FORMS = f"""f AS (SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 4 = 0 THEN 'ocr' ELSE 'text' END AS source, array_to_string(list_filter([
  'Name: ' || c_name, 'Nation:' || CASE WHEN c_custkey % 5 = 0 THEN {NL} || {NL} ELSE ' ' END || n_name, CASE WHEN c_custkey % 7 <> 0 THEN 'Market Segment: ' || c_mktsegment END,
  CASE WHEN c_custkey % 11 = 0 THEN 'Market Segment: OTHER' END, CASE WHEN c_custkey % 3 = 0 THEN 'Key: ' || c_custkey || ' Region Code: R' || (c_custkey % 4) END,
  CASE WHEN c_custkey % 13 = 0 THEN 'note ' || c_custkey || ' - see: below' END, 'https://example.com'], lambda b: b IS NOT NULL), {NL} || {NL}) AS text FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
LINE_FIELD = r"(?m)^\s*([A-Za-z][A-Za-z0-9 /()_.-]{1,50}):[ \t]*(\S[^\n]*)$"
LINE_FIELDS = rf"""{FORMS}, lf0 AS (SELECT doc_id, source, CAST(unnest(range(0, len(l))) AS INTEGER) AS n, trim(unnest(l)) AS label, trim(unnest(v)) AS value
  FROM (SELECT *, regexp_extract_all(text, '{LINE_FIELD}', 1) AS l, regexp_extract_all(text, '{LINE_FIELD}', 2) AS v FROM f)),
lf AS (SELECT * FROM lf0 WHERE len(regexp_split_to_array(label, '\s+')) <= 4 AND lower(label) NOT IN ('http', 'https', 'ftp'))"""
# Pieces of blocks between colons, the runs of words that end them, and how often each run stands.
RUNS = rf"""{LINE_FIELDS}, bk AS (SELECT doc_id, source, unnest(bs) AS block, unnest(range(0, len(bs))) AS b, bs FROM (SELECT *, string_split(text, {NL} || {NL}) AS bs FROM f)),
pc AS (SELECT *, ps[i + 1] AS piece, CAST(list_sum(list_prepend(i, list_transform(ps[1:i], lambda p: length(p)))) AS BIGINT) AS begins FROM (SELECT *, unnest(range(0, len(ps) - 1)) AS i FROM (SELECT *, string_split(block, ':') AS ps FROM bk))),
wd AS (SELECT *, w[coalesce(list_max(list_filter(range(1, len(w) + 1), lambda j: NOT regexp_matches(w[j], '[A-Za-z0-9]'))), 0) + 1:] AS tail FROM (SELECT *, regexp_extract_all(piece, '\S+') AS w FROM pc)),
rn AS (SELECT *, array_to_string(tail[len(tail) - k + 1:], ' ') AS run FROM (SELECT *, unnest(range(1, least(4, len(tail)) + 1)) AS k FROM wd)),
lx AS (SELECT lower(run) AS label, count(*) AS n FROM rn GROUP BY 1)"""
LEXICON_FIELDS = rf"""{RUNS}, bs0 AS (SELECT doc_id, b, coalesce(sum(length(block) + 2) OVER (PARTITION BY doc_id ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM bk),
lb AS (SELECT doc_id, b, i, arg_max(run, k) AS label, any_value(source) AS source, any_value(block) AS block, any_value(bs) AS bs, any_value(begins) AS begins, any_value(piece) AS piece
  FROM rn JOIN lx ON lower(run) = lx.label AND n >= 3 GROUP BY doc_id, b, i),
vl AS (SELECT *, begins + length(rtrim(piece)) - length(label) AS spot, begins + length(piece) + 1 AS from_, lead(begins + length(rtrim(piece)) - length(label)) OVER (PARTITION BY doc_id, b ORDER BY i) AS upto FROM lb),
vs AS (SELECT *, trim(regexp_replace(substr(block, from_ + 1, coalesce(upto, length(block)) - from_), '\s+', ' ', 'g'), ' -|' || chr(9)) AS own, bs[b + 2] AS following FROM vl),
vt AS (SELECT *, CASE WHEN own = '' AND upto IS NULL AND NOT contains(coalesce(following, ':'), ':') THEN trim(regexp_replace(following, '\s+', ' ', 'g')) ELSE own END AS value FROM vs),
fl AS (SELECT doc_id, source, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY b, i) - 1 AS INTEGER) AS n, label, value, CAST(base + spot AS INTEGER) AS pos FROM vt JOIN bs0 USING (doc_id, b) WHERE value <> '')"""
CENTS = "CAST(round(o_totalprice * 10) AS BIGINT)"
RECEIPTS = f"""rc AS (SELECT o_orderkey AS doc_id, o_orderpriority AS priority, c, array_to_string(list_filter([
  '2 ITEM ' || o_orderpriority || ' ' || format('{{:,}}', c * 2) || ' ' || format('{{:,}}', c), 'DELIVERY FEE ' || (o_orderkey % 90) || ' KM ' || format('{{:,}}', o_orderkey + 100),
  CASE WHEN o_orderkey % 4 <> 0 THEN (['SUBTOTAL ', 'Sub Total ', 'net amount '])[o_orderkey % 3 + 1] || format('{{:,}}', c) END, CASE WHEN o_orderkey % 8 IN (1, 4) THEN 'SUBTOTAL ' || format('{{:,}}', c + 1) END,
  CASE WHEN o_orderkey % 5 <> 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'TAX ' ELSE 'PB-1 10% ' END || format('{{:,}}', CASE WHEN o_orderkey % 9 = 0 THEN c * 3 ELSE c // 20 END) END,
  CASE o_orderkey % 6 WHEN 0 THEN 'TOTAL' || {NL} || format('{{:,}}', c + c // 20) WHEN 1 THEN 'TOTAL ' || format('{{:,}}', c) || {NL} || 'GRAND TOTAL ' || format('{{:,}}', c + c // 20) WHEN 5 THEN NULL ELSE 'Total due ' || format('{{:,}}', c + c // 20) END,
  'TOTAL ITEMS 2'], lambda r: r IS NOT NULL), {NL}) AS text FROM (SELECT *, {CENTS} AS c FROM orders))"""
# Rows of receipts: the words before the first amount, the amounts, and those that a row of numbers alone lends the row above.
RECEIPT_ROWS = rf"""{RECEIPTS}, rl AS (SELECT doc_id, priority, i, string_split(row, ' ') AS w FROM (SELECT doc_id, priority, unnest(rs) AS row, unnest(range(0, len(rs))) AS i FROM (SELECT *, string_split(text, {NL}) AS rs FROM rc))),
rm AS (SELECT *, list_filter(w, lambda x: regexp_full_match(x, '\d{{1,3}}(,\d{{3}})+|\d{{3,}}')) AS money,
  list_transform(list_filter(w, lambda x: NOT regexp_full_match(x, '\d{{1,3}}(,\d{{3}})+|\d{{3,}}|.*%')), lambda x: replace(lower(x), '-', '')) AS words FROM rl),
rn AS (SELECT *, CASE WHEN len(lead(w) OVER o) = 1 THEN lead(money) OVER o ELSE [] END AS lent FROM rm WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
rr AS (SELECT *, len(money) > 0 AS own, replace(coalesce(coalesce(money[1], CASE WHEN len(lent) = 1 THEN lent[1] END), ''), ',', '') AS first, replace(coalesce(coalesce(money[-1], lent[-1]), ''), ',', '') AS last, array_to_string(words, ' ') AS label FROM rn),
rk AS (SELECT doc_id, own, first, i, CASE WHEN label IN ('total', 'grand total', 'total due') THEN 'total' WHEN label IN ('subtotal', 'sub total', 'net amount') THEN 'sub' WHEN label IN ('tax', 'pb1') THEN 'tax' END AS kind FROM rr WHERE first <> ''),
rp AS (SELECT doc_id, kind, CASE WHEN kind = 'total' THEN arg_max(first, (own, i)) ELSE arg_max(first, (own, -i)) END AS value FROM rk WHERE kind IS NOT NULL GROUP BY doc_id, kind)"""
SCANS = f"""{UNITS}, sn AS (SELECT *, CASE doc_id % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN 'image' ELSE 'text' END AS kind,
  CASE doc_id % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'scan-text' ELSE 'text' END AS source FROM u)"""
ANSWERS = """a AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'How many ' ELSE 'Who has ' END || l[1] || '?' AS question, l[-1] AS answer, coalesce(array_to_string(l[1:len(l) - 1], chr(10)), '') AS evidence,
  text AS page_text, (doc_id % 10) / 10.0 AS coverage FROM (SELECT *, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL))"""
EVENTS = "e AS (SELECT *, CAST(floor(value) AS BIGINT) AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)"
BOXES = """b AS (SELECT l_orderkey AS doc_id, 'Heading ' || l_partkey AS text, 0.1::DOUBLE AS x0, 0.5::DOUBLE AS x1, l_linenumber * 0.07::DOUBLE AS y0, l_linenumber * 0.07::DOUBLE + l_quantity / 1000 AS y1,
  round(1.0 - l_discount, 2) AS score, l_linenumber AS line, l_partkey FROM lineitem)"""


ASKED = r"""qs AS (SELECT item_id AS query_id, CASE item_id % 3 WHEN 0 THEN reverse(q) WHEN 1 THEN regexp_replace(q, '(\w{4})\w*', '\1quoxing', 'g') ELSE regexp_replace(q, '(\w{5})(\W|$)', '\1ers zyxw\2', 'g') END AS q
  FROM (SELECT item_id, array_to_string((regexp_split_to_array(trim(text), '\s+'))[1:6], ' ') AS q FROM benchmark))"""


def _many(questions: str) -> str:
    """r: (query_id, doc_id, page, score) of the units u for the questions (query_id, q)."""
    return f"""q AS (SELECT query_id, unnest(list_distinct(k)) AS term FROM (SELECT query_id, {tok("q")} AS k FROM {questions})),
      n AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(sum(len(toks)) AS DOUBLE) / count(*) AS av FROM u),
      tf AS (SELECT doc_id, page, n_toks, term, count(*) AS f FROM (SELECT doc_id, page, len(toks) AS n_toks, unnest(toks) AS term FROM u) GROUP BY ALL),
      d AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
      w AS (SELECT query_id, q.term, av, {IDF.replace("df", "coalesce(df, 0)")} AS idf FROM q LEFT JOIN d ON q.term = d.term CROSS JOIN n),
      t AS (SELECT query_id, sum(idf) AS total FROM w GROUP BY query_id),
      h AS (SELECT query_id, doc_id, page, w.term, idf, idf * f * {W.K1 + 1}::DOUBLE / (f + {W.K1}::DOUBLE * ({1 - W.B}::DOUBLE + {W.B}::DOUBLE * n_toks / av)) AS part FROM tf JOIN w ON tf.term = w.term
            UNION ALL SELECT DISTINCT query_id, doc_id, page, w.term, idf, 0.0::DOUBLE FROM tf JOIN w ON length(w.term) >= 5 AND length(tf.term) >= 4 AND substr(tf.term, 1, 4) = substr(w.term, 1, 4)),
      e AS (SELECT query_id, doc_id, page, term, max(idf) AS idf, max(part) AS part FROM h GROUP BY ALL),
      s AS (SELECT query_id, doc_id, page, sum(part) AS bm25, sum(idf) AS covered FROM e GROUP BY ALL),
      r AS (SELECT query_id, doc_id, page, round(bm25 * (0.25::DOUBLE + 0.75::DOUBLE * covered / total), 6) AS score FROM s JOIN t USING (query_id) WHERE bm25 > 0)"""


def pick(expr: str, *values: str) -> str:
    return f"({_list(values)})[({expr}) % {len(values)} + 1]"


def kind(q: str) -> str:
    return f"CASE WHEN regexp_matches({q}, '(?i){W.DATE_Q}') THEN 'date' WHEN regexp_matches({q}, '(?i){W.MONEY_Q}') THEN 'amount' WHEN regexp_matches({q}, '(?i){W.NUMBER_Q}') THEN 'number' ELSE 'word' END"


STEM = "CASE " + " ".join(f"WHEN ends_with(term, '{s}') AND length(term) - {len(s)} >= {k} THEN substr(term, 1, length(term) - {len(s)})" for s, k in W.SUFFIXES) + " ELSE term END"
SHARE = r"(CASE WHEN len(list_filter({a}, lambda w: NOT list_contains({q}, w))) > 0 THEN CAST(len(list_filter({a}, lambda w: NOT list_contains({q}, w) AND list_contains({e}, w))) AS DOUBLE) / len(list_filter({a}, lambda w: NOT list_contains({q}, w))) ELSE 0.0::DOUBLE END)"
SUPPORT = f"""{ANSWERS}, k AS (SELECT *, {tok("answer")} AS ta, {tok("question")} AS tq, {tok("evidence")} AS te FROM a)"""
JACCARD_WORDS = "list_filter(list_distinct(regexp_extract_all(lower({x}), '[a-z0-9]+')), lambda w: NOT list_contains(" + _list(W.RECALL_FILLER) + ", w))"
ENTITIES = "list_filter(list_transform(regexp_extract_all(' ' || {x}, '[^A-Za-z][A-Z][a-z''’-]+(?:\\s+[A-Z][a-z''’-]+)+'), lambda e: substr(e, 2)), lambda e: NOT list_contains(" + _list(W.QUESTION_WORDS) + ", regexp_extract(e, '^(\\S+)', 1)))"
REFS = r"(CASE WHEN regexp_matches(question, '(?i)" + W.ITEM_WORD + r"') THEN regexp_extract_all(question, '(?:^|[^\d.])(\d{1,2}\.\d{1,2})(?:[^\d.]|$)', 1) ELSE [] END)"
GROUNDED = f"""(regexp_matches(question, '(?i){W.META_Q}') OR (len({REFS}) > 0 AND len(list_filter({REFS}, lambda r: NOT list_contains(tp, r))) = 0)
  OR (coverage >= 0.8 AND len(list_filter({ENTITIES.format(x="question")}, lambda e: NOT contains(lower(page_text), lower(e)))) = 0))"""
VERIFY = f"""{SUPPORT}, g AS (SELECT *, {tok("page_text")} AS tp FROM k),
v AS (SELECT doc_id, answer AS final_answer, CASE WHEN (regexp_matches(question, '(?i){W.NUMERIC_Q}') AND NOT regexp_matches(answer, '[0-9]')) OR regexp_matches(answer, '(?i){W.NOT_FOUND}') OR NOT {GROUNDED} THEN 0.0::DOUBLE
  ELSE {SHARE.format(a='ta', q='tq', e='te')} END AS support FROM g)"""
MEMORY = "m AS (SELECT text AS q, 'a' || item_id AS a, item_id % 3 <> 0 AS verified, CAST(item_id AS DOUBLE) AS ts, item_id FROM benchmark)"
RESULTS = "SELECT lang AS category, quality = 1 OR doc_id % {k} = 0 AS ok FROM labels JOIN documents USING (doc_id)"
CACHE_WORDS = "list_filter(regexp_extract_all(replace(lower({x}), 'what''s', 'what is'), '[\\p{{L}}\\p{{M}}\\p{{Nd}}_]+'), lambda w: NOT list_contains(" + _list(W.CACHE_FILLER) + ", w))"

NUMBERS = r"list_sort(list_filter(list_transform(range(1, len(regexp_extract_all(x, '\d[\d,.]*')) + 1), lambda i: {'c': -length(regexp_replace(regexp_extract_all(x, '\d[\d,.]*')[i], '\D', '', 'g')), 'i': i, 'w': regexp_extract_all(x, '\d[\d,.]*')[i]}), lambda s: s.c <= -LEAST))[1].w"
DATES = r"list_filter(list_transform(regexp_extract_all(x || ' ', '(?:^|[^0-9])(\d{1,2}\s*[/.-]\s*\d{1,2}\s*[/.-]\s*(?:\d{4}|\d{2}))[^0-9]', 1), lambda m: regexp_replace(regexp_replace(m, '\s+', '', 'g'), '[.-]', '/', 'g')), lambda m: CAST(string_split(m, '/')[1] AS INT) BETWEEN 1 AND 31 AND CAST(string_split(m, '/')[2] AS INT) BETWEEN 1 AND 12)[1]"
DAY = "day(o_orderdate) || '{0}' || month(o_orderdate) || '{0}' || year(o_orderdate)"
FIGURES = r"list_transform(regexp_extract_all({x}, '\d[\d,.]*%?'), lambda g: rtrim(g, ',.'))"

SENTENCES = r"""se AS (SELECT doc_id, page, CAST(unnest(range(0, len(s))) AS INTEGER) AS n, unnest(s) AS sentence FROM (SELECT doc_id, page,
  list_filter(list_transform(flatten(list_transform(string_split(text, chr(10) || chr(10)), lambda b: string_split(regexp_replace(b, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)))), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: length(p) > 0) AS s FROM tx))"""
ROUTE = {a: " + ".join(f"{w}::DOUBLE * " + ("1" if k == 0 else f"((event_id * {k}) % 11 / 10.0::DOUBLE)") for k, w in enumerate(PRIOR[a])) for a in ACTIONS}

_SYNONYMS = ", ".join(f"('{w}', '{o}')" for w, others in sorted(W.FORM_SYNONYMS.items()) for o in others)
#: Questions as queries._absent makes them; their terms with df; those with no counterpart, spelling aside.
ABSENT = f"""{UNITS}, {ASKED},
qa AS (SELECT query_id, CASE WHEN query_id % 4 = 0 THEN regexp_replace(q, '([0-9A-Za-z_]{{4}})([0-9A-Za-z_])([0-9A-Za-z_])', '\\1\\3\\2', 'g') ELSE q END
  || ([' zyxwvut quokka', ' invoiced subtotal designation', ' ''thonnt the''?', ' serial 2.3', ' customer amount', ' কত টাকা লাগবে আমাদের'])[query_id % 6 + 1] AS q FROM qs),
g AS (SELECT t, count(*) AS df FROM (SELECT unnest(list_distinct(toks)) AS t FROM u) GROUP BY t), nn AS (SELECT CAST(greatest(count(*), 1) AS DOUBLE) AS n FROM u),
qd AS (SELECT query_id, term, coalesce(df, 0) AS df, n FROM (SELECT query_id, unnest(list_distinct({tok("q")})) AS term FROM qa) LEFT JOIN g ON t = term CROSS JOIN nn),
p AS (SELECT t AS p FROM g UNION SELECT substr(t, 1, 3) FROM g UNION SELECT substr(t, 1, 4) FROM g UNION SELECT substr(t, 1, 5) FROM g),
dt AS (SELECT DISTINCT term, {STEM} AS st FROM qd WHERE NOT (length(term) > 4 AND (ends_with(term, 'ed') OR ends_with(term, 'ing')))),
d1 AS (SELECT * FROM dt WHERE term NOT IN (SELECT p FROM p) AND st NOT IN (SELECT p FROM p) AND substr(st, 1, 5) NOT IN (SELECT p FROM p) AND NOT (length(st) <= 5 AND substr(st, 1, 4) IN (SELECT p FROM p))
  AND term NOT IN (SELECT w FROM (VALUES {_SYNONYMS}) s(w, o) WHERE o IN (SELECT p FROM p))),
d2 AS (SELECT term FROM d1 WHERE length(term) < 4 OR NOT EXISTS (SELECT 1 FROM u WHERE contains(lower(text), term))),
ab AS (SELECT * FROM qd WHERE term IN (SELECT term FROM d2))"""

ORACLES: dict[str, str] = {
    "src1_content_id": "SELECT doc_id, substr(sha1(text), 1, 16) AS content_id FROM documents",
    "src2_pages": f"WITH {PAGES} SELECT doc_id, page, CAST(len(lines) AS INTEGER) AS n_lines, text FROM tx",
    "src5_page_source": "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity + 10 < 40 THEN 'none' WHEN l_discount * 10 >= 0.6 THEN 'scan-text' ELSE 'text' END AS source FROM lineitem",
    "src6_file_kind": r"""SELECT page_id, CASE WHEN ext = 'pdf' THEN 'pdf' WHEN ext IN ('png', 'jpg', 'jpeg', 'webp', 'bmp', 'tif', 'tiff') THEN 'image' WHEN ext = 'docx' THEN 'docx' ELSE 'text' END AS kind
      FROM (SELECT page_id, lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '\.([A-Za-z0-9]+)$', 1)) AS ext FROM pages)""",
    "src7_cache_overlay": f"WITH {PAGES} SELECT doc_id, page, CASE WHEN page % 2 = 1 THEN 'ocr' ELSE 'text' END AS source, CAST(CASE WHEN page % 2 = 1 THEN 1 ELSE len(lines) END AS INTEGER) AS n_lines FROM tx",
    "src9_first_copies": "SELECT content_id, doc_id, source FROM (SELECT *, substr(sha1(text), 1, 16) AS content_id, row_number() OVER (PARTITION BY sha1(text) ORDER BY doc_id) AS r FROM documents) WHERE r = 1",
    "src10_pending_limit": f"WITH {SCANS} SELECT doc_id, page, source FROM sn WHERE kind IN ('pdf', 'image') AND source IN ('none', 'scan-text') ORDER BY doc_id, page LIMIT 60",
    "snk1_extraction_cells": r"""WITH r AS (SELECT p_brand AS field, (['', '=', ' +', '@', chr(9)])[p_partkey % 5 + 1] || p_name AS value, 'p' || p_partkey AS document, CASE WHEN p_size > 10 THEN p_size END AS page, p_size > 25 AS verified FROM part)
      SELECT field, CASE WHEN regexp_matches(value, '^\s*[=+@-]') OR regexp_matches(value, '^[\t\r\n]') THEN '''' || value ELSE value END AS value, document, coalesce(CAST(page AS VARCHAR), '') AS page,
      CASE WHEN verified THEN 'true' ELSE 'false' END AS verified FROM r""",
    "snk2_page_export": f"""WITH {PAGES} SELECT doc_id, page, 'Document: d' || doc_id || {NL} || 'Page: ' || page || ' of ' || count(*) OVER (PARTITION BY doc_id) || {NL} || 'Source: text' || {NL} ||
      'Note: Extracted document text; original page formatting is not preserved.' || {NL} || {NL} || text AS content FROM tx""",
    "snk5_history": "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 20",
    "fn1_tokens": f"SELECT doc_id, coalesce(array_to_string(k, ' '), '') AS tokens, CAST(len(k) AS INTEGER) AS n_toks FROM (SELECT doc_id, {tok('text')} AS k FROM documents)",
    "fn3_stem": f"SELECT term, {STEM} AS stem FROM (SELECT DISTINCT unnest({tok('text')}) AS term FROM documents)",
    "fn4_chunks": f"WITH {CHUNKS} SELECT doc_id, page, CAST(chunk AS INTEGER) AS chunk, text FROM ck",
    "fn6_gateway_chunks": r"""WITH f AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)
      SELECT doc_id, CAST(i / 580 AS INTEGER) AS n, substr(t, CAST(i + 1 AS BIGINT), 700) AS piece FROM (SELECT doc_id, t, unnest(range(0, length(t), 580)) AS i FROM f)""",
    "fn8_entities": f"""SELECT conv_id, turn, coalesce(array_to_string(list_filter(list_transform(regexp_extract_all(' ' || text, '[^A-Za-z][A-Z][a-z''’-]+(?:\\s+[A-Z][a-z''’-]+)+'), lambda e: substr(e, 2)), lambda e: NOT list_contains({_list(W.QUESTION_WORDS)}, regexp_extract(e, '^(\\S+)', 1))), '|'), '') AS entities FROM conversations""",
    "fn9_has_entities": "SELECT doc_id, contains(lower(text), 'the and') AND contains(lower(text), 'thea') AS named, true AS vacuous FROM documents",
    "fn10_script": f"""SELECT doc_id, CAST(len(list_filter(regexp_extract_all(m, '\\p{{L}}'), lambda c: regexp_matches(c, '[{W.BENGALI}]'))) AS DOUBLE) / greatest(len(regexp_extract_all(m, '\\p{{L}}')), 1) >= 0.5 AS mismatch FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN repeat('ঋণের পরিমাণ ', CAST(doc_id % 400 AS BIGINT)) || text ELSE text END AS m FROM documents)""",
    "fn11_item_refs": "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN (o_orderkey % 20) || '.' || (o_custkey % 30) ELSE '' END AS refs FROM orders",
    "fn12_fix_dates": r"SELECT o_orderkey, regexp_replace('on ' || day(o_orderdate) || '/' || lpad(CAST(month(o_orderdate) AS VARCHAR), 2, '0') || '12024 ' || o_orderpriority, '\b(\d{1,2})/(\d{2})[12lI|](20\d\d)\b', '\1/\2/\3', 'g') AS fixed FROM orders",
    "fn13_find_date": f"""WITH m AS (SELECT *, (['/', ' - ', '.', ' /'])[o_orderkey % 4 + 1] AS mark FROM orders), x AS (SELECT o_orderkey, 'ref ' || (o_orderkey % 40) || mark || (o_orderkey % 15) || mark || (['2024', '99', '202'])[o_orderkey % 3 + 1] || ', due ' ||
      CASE WHEN o_orderkey % 5 < 3 THEN {DAY.format('-')} ELSE 'soon' END AS x FROM m) SELECT o_orderkey, {DATES} AS date FROM x""",
    "fn14_find_number": "SELECT o_orderkey, CASE WHEN length(CAST(CAST(round(o_totalprice) AS BIGINT) AS VARCHAR)) >= length(CAST(o_custkey AS VARCHAR)) AND round(o_totalprice) >= 100 THEN format('{:,}', CAST(round(o_totalprice) AS BIGINT)) WHEN o_custkey >= 100 THEN CAST(o_custkey AS VARCHAR) END AS number FROM orders",
    "fn15_extract_value": f"""WITH x AS (SELECT o_orderkey, {pick("o_orderkey", "date", "amount", "number", "word")} AS kind, CASE WHEN o_orderkey % 3 = 0 THEN 'no day' ELSE {DAY.format('.')} END || ' item ' || (o_orderkey % 120) || ' total ' ||
      CASE WHEN o_orderkey % 5 = 0 THEN 'open' ELSE format('{{:,}}', CAST(round(o_totalprice / 1000) AS BIGINT)) END AS x FROM orders)
      SELECT o_orderkey, kind, CASE kind WHEN 'date' THEN {DATES} WHEN 'amount' THEN rtrim({NUMBERS.replace("LEAST", "3")}, ',.') WHEN 'number' THEN rtrim({NUMBERS.replace("LEAST", "1")}, ',.') END AS value FROM x""",
    "fn16_same_value": r"""WITH x AS (SELECT *, CAST(round(o_totalprice) AS BIGINT) AS n FROM orders), y AS (SELECT *, CASE o_orderkey % 5 WHEN 0 THEN n + 1 WHEN 1 THEN n * 10 ELSE n END AS other FROM x),
      z AS (SELECT *, format('{:,}', n) AS a, CASE o_orderkey % 7 WHEN 0 THEN ' ' || other || '.' WHEN 1 THEN '' WHEN 2 THEN NULL ELSE CAST(other AS VARCHAR) END AS b FROM y)
      SELECT o_orderkey, coalesce(length(b) > 0 AND regexp_replace(lower(a), '[\s,.]', '', 'g') = regexp_replace(lower(b), '[\s,.]', '', 'g'), false) AS same FROM z""",
    "fn17_kind_of": f"SELECT conv_id, turn, {kind('q')} AS kind FROM (SELECT *, {pick('conv_id', 'What is the issue date of ', 'What is the total of ', 'How many ', 'Who is ')} || text AS q FROM conversations)",
    "fn18_question_class": f"""SELECT conv_id, turn, CASE WHEN regexp_matches(q, '(?i){W.VISUAL_Q}') THEN 'visual' WHEN regexp_matches(q, '(?i){W.META_Q}') OR regexp_matches(q, '(?i){W.EXTRACT_Q}') THEN 'open'
      WHEN regexp_matches(q, '(?i){W.LIST_Q}') THEN 'list' ELSE 'lookup' END AS class FROM (SELECT *, {pick('conv_id', 'Describe the photo ', 'Summarise ', 'Which loan types ', 'Who is ')} || text AS q FROM conversations)""",
    "fn19_money_text": r"""WITH x AS (SELECT o_orderkey, format('{:,}', CAST(round(o_totalprice) AS BIGINT)) AS n FROM orders), y AS (SELECT o_orderkey, (['$ ', '€', '£  ', ''])[o_orderkey % 4 + 1] || CASE o_orderkey % 3 WHEN 0 THEN replace(n, ',', ', ') WHEN 1 THEN replace(n, ',', ' ') ELSE n END
      || CASE WHEN o_orderkey % 5 = 0 THEN ' 20' ELSE '' END AS t FROM x), a AS (SELECT o_orderkey, t, regexp_replace(trim(t), '([.,]) (\d)', '\1\2', 'g') AS v FROM y), b AS (SELECT o_orderkey, t, regexp_replace(v, '(\d) (\d{3})(\D|$)', '\1\2\3', 'g') AS v FROM a),
      c AS (SELECT o_orderkey, t, regexp_replace(v, '(\d) (\d{3})(\D|$)', '\1\2\3', 'g') AS v FROM b) SELECT o_orderkey, regexp_replace(v, '^([$€£]) (\d)', '\1\2') AS tidy, regexp_replace(t, '[^0-9]', '', 'g') AS digits FROM c""",
    "fn20_amounts": r"""WITH x AS (SELECT o_orderkey, (o_orderkey % 30) || ' x ' || format('{:,}', o_orderkey) || ' A' || o_orderkey || ' ' || (o_orderkey % 100) || '% ' || (['Rp', '$', ''])[o_orderkey % 3 + 1] || format('{:,}', o_orderkey * 1000 + 999)
      || CASE WHEN o_orderkey % 2 = 0 THEN '.50' ELSE '' END || ' total ' || (o_orderkey % 7 * 111) AS t FROM orders)
      SELECT o_orderkey, coalesce(array_to_string(list_transform(list_filter(string_split(t, ' '), lambda w: regexp_full_match(w, '(([$]|Rp)?\d{1,3}(,\d{3})+|\d+)(\.\d{1,2})?') AND NOT regexp_full_match(w, '\d{1,2}')), lambda w: replace(w, '$', '$ ')), '|'), '') AS amounts FROM x""",
    "fn23_is_legacy": f"""WITH x AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN repeat('cÖwZôv‡bi evwl©K weµq (cÖ‡hvR¨ †ÿ‡Î) ', CAST(doc_id % 50 AS BIGINT)) || text || CASE WHEN doc_id % 10 = 0 THEN 'ঋ' ELSE '' END ELSE text END AS m FROM documents),
      y AS (SELECT doc_id, m, len(regexp_extract_all(m, '[{W.LEGACY_SIGNATURE}]')) AS g, greatest(len(regexp_extract_all(m, '\\p{{L}}')), 1) AS l FROM x)
      SELECT doc_id, NOT regexp_matches(m, '[{W.BENGALI}]') AND g >= {W.LEGACY_LEAST} AND CAST(g AS DOUBLE) / l >= {W.LEGACY_SHARE} AS legacy FROM y""",
    "fn27_estimate_tokens": "SELECT conv_id, CAST(floor(sum(length(coalesce(text, '')) / 3.2::DOUBLE + 4) + 350) AS BIGINT) AS estimate FROM conversations GROUP BY conv_id",
    "rk1_term_frequencies": f"WITH {UNITS} SELECT doc_id, page, term, count(*) AS f FROM (SELECT doc_id, page, unnest(toks) AS term FROM u) GROUP BY ALL",
    "rk1_document_frequencies": f"WITH {UNITS} SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(toks)) AS term FROM u) GROUP BY term",
    "rk2_drop_page": f"WITH {UNITS} SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(toks)) AS term FROM u WHERE NOT (doc_id = 1 AND page = 1)) GROUP BY term",
    "rk3_idf": f"WITH {UNITS}, d AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(toks)) AS term FROM u) GROUP BY term) SELECT term, round({IDF}, 6) AS idf FROM d CROSS JOIN (SELECT count(*) AS n FROM u)",
    "rk4_coverage": f"WITH {_scored()} SELECT doc_id, page, round(coverage, 6) AS coverage FROM sc",
    "rk5_search": f"WITH {_scored()} SELECT doc_id, page, round(score, 6) AS score FROM sc WHERE bm25 > 0 ORDER BY 3 DESC, 1, 2 LIMIT 10",
    "rk6_scoped_search": f"WITH {_scored()} SELECT doc_id, page, round(score, 6) AS score FROM sc WHERE bm25 > 0 AND doc_id % 2 = 0 ORDER BY 3 DESC, 1, 2 LIMIT 10",
    "rk7_best_coverage": f"WITH {_scored()} SELECT round(max(coverage), 6) AS coverage FROM sc",
    "rk5_search_many": f"""WITH {UNITS}, bq AS (SELECT item_id AS query_id, array_to_string((regexp_split_to_array(trim(text), '\\s+'))[1:6], ' ') AS q FROM benchmark), {_many("bq")},
      k AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, page) AS INTEGER) AS rank FROM r)
      SELECT * FROM k WHERE rank <= 5""",
    "rk9_trigram_scores": f"WITH {_trigrams()} SELECT doc_id, page, round(fuzzy, 6) AS fuzzy FROM fz",
    "rk10_rank_pages": f"""WITH {_trigrams()}, m AS (SELECT max(score) FILTER (bm25 > 0) AS b, max(fuzzy) AS f FROM fz)
      SELECT doc_id, page, round(score / coalesce(nullif(b, 0), 1) + fuzzy / coalesce(nullif(f, 0), 1), 6) AS relevance FROM fz CROSS JOIN m ORDER BY 3 DESC, 1, 2 LIMIT 10""",
    "rk13_pending_pages": f"""WITH {_trigrams()}, m AS (SELECT max(score) AS b, max(fuzzy) AS f FROM fz)
      SELECT doc_id, page, round(score / coalesce(nullif(b, 0), 1) + fuzzy / coalesce(nullif(f, 0), 1), 6) AS relevance FROM fz CROSS JOIN m WHERE doc_id % 3 <= 1 AND doc_id % 4 <= 1""",
    "rk17_find_text": f"""WITH {PAGES}, h AS (SELECT *, strpos(lower(text), '{PHRASE}') AS pos FROM tx)
      SELECT doc_id, page, substr(text, greatest(pos - 80, 1), pos + {len(PHRASE) + 160} - greatest(pos - 80, 1)) AS excerpt, count(*) OVER () AS total FROM h WHERE pos > 0 ORDER BY doc_id, page LIMIT 50""",
    "rk18_vector_top": """WITH p AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0),
      r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id DESC) AS INTEGER) AS rank FROM p) SELECT * FROM r WHERE rank <= 3""",
    "rk19_unread_counts": f"WITH {SCANS} SELECT doc_id, kind, count(*) AS pages, count(*) FILTER (kind IN ('pdf', 'image') AND source IN ('none', 'scan-text')) AS unread_pages FROM sn GROUP BY doc_id, kind",
    "rk20_name_filter": "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'cold')",
    "ex1_line_fields": f"WITH {LINE_FIELDS} SELECT doc_id, n, label, value FROM lf",
    "ex2_learn_labels": f"WITH {RUNS} SELECT label, n FROM lx",
    "ex3_lexicon_fields": f"WITH {LEXICON_FIELDS} SELECT doc_id, n, label, value, pos FROM fl",
    "ex5_extract_all": f"""WITH {LEXICON_FIELDS} SELECT doc_id, label, substr(value, 1, 120) AS value, source = 'text' AS verified FROM (SELECT doc_id, source, label, value FROM lf
      UNION ALL SELECT doc_id, source, label, value FROM fl WHERE (doc_id, lower(label)) NOT IN (SELECT (doc_id, lower(label)) FROM lf))""",
    "ex7_field_answers": rf"""WITH {LEXICON_FIELDS}, m AS (SELECT doc_id, regexp_replace(lower(value), '\s+', '', 'g') AS bare, min({{'pos': pos, 'value': substr(value, 1, 80)}}) AS v FROM fl WHERE lower(label) = 'market segment' GROUP BY 1, 2),
      g AS (SELECT doc_id, count(*) AS n_values, list_sort(list(v)) AS vs FROM m GROUP BY doc_id)
      SELECT doc_id, 2 AS matched, n_values, CASE WHEN n_values > 1 THEN 'Multiple matches: ' || array_to_string(list_transform(vs[1:3], lambda s: substr(s.value, 1, 60)), '; ') ELSE trim(vs[1].value) END AS answer FROM g""",
    "ex4_question_has_label": f"""WITH {RUNS}, k AS (SELECT {tok("label")} AS k FROM lx WHERE n >= 3 AND length(label) > 2), q(n, t) AS (VALUES {", ".join(f"({i}, CAST({_list(tokens_of(x))} AS VARCHAR[]))" for i, x in enumerate(LABEL_QUESTIONS))})
      SELECT q.n, EXISTS (SELECT 1 FROM k WHERE len(k) > 0 AND list_has_all(q.t, k)) AS has_label FROM q""",
    "ex8_receipt_total": f"""WITH {RECEIPT_ROWS}, p AS (SELECT doc_id, max(value) FILTER (kind = 'total') AS total, max(value) FILTER (kind = 'sub') AS subtotal, max(value) FILTER (kind = 'tax') AS tax FROM rp GROUP BY doc_id)
      SELECT rc.doc_id, total, subtotal, CASE WHEN coalesce(CAST(tax AS BIGINT) >= least(CAST(total AS BIGINT), CAST(subtotal AS BIGINT)), false) THEN NULL ELSE tax END AS tax FROM rc LEFT JOIN p ON rc.doc_id = p.doc_id""",
    "ex9_item_price": f"""WITH {RECEIPT_ROWS}, q AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN string_split('item ' || replace(lower(priority), '-', ''), ' ') WHEN 1 THEN ['delivery', 'fee', 'ship'] WHEN 2 THEN ['delivery', 'by', 'ship'] ELSE ['gift', 'card'] END AS q FROM rc),
      h AS (SELECT rr.doc_id, i, last, len(list_filter(q, lambda x: list_contains(words, x))) / CAST(len(q) AS DOUBLE) AS share FROM rr JOIN q ON rr.doc_id = q.doc_id),
      b AS (SELECT doc_id, arg_max(last, (share, -i)) AS last, max(share) AS share FROM h GROUP BY doc_id) SELECT doc_id, CASE WHEN share >= 0.6 AND last <> '' THEN last END AS price FROM b""",
    "ex10_column_total": f"""WITH {RECEIPTS}, p AS (SELECT doc_id, c, CASE WHEN doc_id % 7 = 0 THEN 5 ELSE doc_id % 3 + 1 END AS r, CASE WHEN doc_id % 5 = 0 THEN 0.09 ELSE 0.01 END AS shift FROM rc),
      b AS (SELECT doc_id, unnest([{{'r': 0, 't': 'Net worth', 'x': 0.55}}, {{'r': 0, 't': CASE WHEN doc_id % 11 = 0 THEN 'Gross' ELSE 'Gross worth' END, 'x': 0.80}}, {{'r': r, 't': CASE WHEN doc_id % 4 = 0 THEN 'Sum' ELSE 'Total' END, 'x': 0.30}},
        {{'r': r, 't': CAST(c AS VARCHAR), 'x': 0.55}}, {{'r': r, 't': CAST(c * 2 AS VARCHAR), 'x': 0.80 + shift}}, {{'r': r, 't': CASE WHEN doc_id % 6 = 0 THEN '7' ELSE '' END, 'x': 0.82}}], recursive := true) FROM p),
      h AS (SELECT doc_id, r, x FROM b WHERE lower(replace(t, ' ', '')) = 'grossworth'), f AS (SELECT doc_id, r, arg_min(t, x) AS t, min(x) AS x FROM b WHERE t <> '' GROUP BY doc_id, r),
      u AS (SELECT b.doc_id, min(b.t) AS t, count(*) AS n FROM b JOIN f ON b.doc_id = f.doc_id AND b.r = f.r AND f.t = 'Total' JOIN h ON h.doc_id = b.doc_id AND b.r - h.r BETWEEN 1 AND 3 WHERE b.x > f.x AND regexp_matches(b.t, '[0-9]') AND abs(b.x - h.x) < 0.06 GROUP BY b.doc_id)
      SELECT doc_id, t AS total FROM u WHERE n = 1""",
    "ex11_label_value": f"""WITH {FORMS}, l AS (SELECT doc_id, list_distinct(list_transform(list_filter(string_split(text, {NL}), lambda x: starts_with(x, 'Market Segment: ')), lambda x: substr(x, 17))) AS v FROM f) SELECT doc_id, CASE WHEN len(v) = 1 THEN v[1] END AS value FROM l""",
    "ex12_option_rows": rf"""WITH c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN '1.1 (a) ' ELSE '' END || 'Application Type: ☐ ' || c_mktsegment || CASE WHEN c_custkey % 4 <> 0 THEN ' ■ Grid' ELSE '' END AS line FROM customer),
      l AS (SELECT k, unnest([line, CASE k % 5 WHEN 0 THEN line WHEN 1 THEN 'application type - Other • Kind' ELSE 'other line' END]) AS line FROM c),
      r AS (SELECT k, trim(regexp_replace(trim(regexp_replace(substr(line, strpos(lower(line), 'application type') + 16), '{W.BOX_GLYPHS}', ' ', 'g'), ' :-|'), '\s+', ' ', 'g')) AS rest FROM l WHERE strpos(lower(line), 'application type') BETWEEN 1 AND 7)
      SELECT k AS doc_id, min(rest) AS answer FROM r WHERE len(string_split(rest, ' ')) >= 2 AND NOT starts_with(rest, '(') GROUP BY k HAVING min(rest) = max(rest)""",
    "ex13_item_rows": """WITH x AS (SELECT l_orderkey AS doc_id, (l_linenumber % 3 + 1) || '.' || (l_linenumber % 7 + 1) AS ref, l_linenumber FROM lineitem),
      y AS (SELECT doc_id, ref, ref || ') row ' || l_linenumber AS answer FROM x WHERE ref IN ('2.2', '3.3')) SELECT doc_id, ref, min(answer) AS answer FROM y GROUP BY doc_id, ref HAVING min(answer) = max(answer)""",
    "ex14_titles": f"""WITH {BOXES}, v AS (SELECT *, y1 - y0 AS h FROM b WHERE y0 < 0.6), m AS (SELECT doc_id, max(h) AS h FROM v GROUP BY doc_id)
      SELECT v.doc_id, substr(string_agg(text, ' ' ORDER BY y0, x0, text), 1, 80) AS title FROM v JOIN m ON v.doc_id = m.doc_id AND v.h >= 0.75 * m.h GROUP BY v.doc_id""",
    "vf1_support": f"WITH {SUPPORT} SELECT doc_id, round({SHARE.format(a='ta', q='tq', e='te')}, 6) AS support FROM k",
    "vf2_grounded": f"WITH {SUPPORT}, g AS (SELECT *, {tok('page_text')} AS tp FROM k) SELECT doc_id, {GROUNDED} AS grounded FROM g",
    "vf4_verified": f"WITH {VERIFY} SELECT doc_id, final_answer, round(support, 6) AS support, support >= {W.SUPPORT_OK} AS verified FROM v",
    "ca3_cacheable": f"WITH {VERIFY} SELECT doc_id FROM v WHERE support >= {W.SUPPORT_OK} AND doc_id % 5 <> 0 AND doc_id % 7 <> 0",
    "fn5_page_unit": f"WITH {BOXES} SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY line, part) AS text, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM (SELECT *, l_partkey AS part FROM b) GROUP BY doc_id",
    "fn7_sentences": f"WITH {PAGES}, {SENTENCES} SELECT doc_id, page, n, sentence FROM se",
    "extra_window_neighbours": f"WITH {PAGES}, {SENTENCES} SELECT doc_id, page, n, CAST(coalesce(lag(length(sentence)) OVER o, 0) AS INTEGER) AS before, CAST(coalesce(lead(length(sentence)) OVER o, 0) AS INTEGER) AS after FROM se WINDOW o AS (PARTITION BY doc_id, page ORDER BY n)",
    "fn24_unknown_glyphs": f"""SELECT doc_id, coalesce(array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(text, '[^\\x00-\\x7F]'), lambda c: NOT list_contains({_list(sorted(GLYPHS))}, c)))), ''), '') AS glyphs FROM documents""",
    "rk11_retrieve": f"""WITH {CHUNKS}, u AS (SELECT doc_id, page, text, {tok("text")} AS toks FROM tx WHERE text <> ''), cu AS (SELECT *, {tok("text")} AS toks FROM ck), {_scores("u", "sc")}, {_scores("cu", "cs")},
      near AS (SELECT doc_id, page FROM sc WHERE bm25 > 0 ORDER BY round(score, 6) DESC, doc_id, page LIMIT 2)
      SELECT doc_id, page, CAST(chunk AS INTEGER) AS chunk, round(score, 6) AS score FROM cs SEMI JOIN near USING (doc_id, page) WHERE bm25 > 0 ORDER BY 4 DESC, 1, 2, 3 LIMIT 3""",
    "lr1_route": "SELECT event_id, array_to_string(list_transform(list_sort([" + ", ".join(f"{{'s': round(-({ROUTE[a]}), 9), 'i': {i}, 'a': '{a}'}}" for i, a in enumerate(ACTIONS)) + "]), lambda s: s.a), ',') AS actions FROM events",
    "vf3_invented": f"""WITH x AS (SELECT o_orderkey, 'page ' || o_custkey || ', ' || format('{{:,}}', o_orderkey) || ' and 5%. How much is ' || (o_orderkey % 50) || '?' AS known,
      'it is ' || ([o_custkey, o_custkey + 1, o_orderkey % 50, o_orderkey % 10, o_orderkey % 8])[o_orderkey % 5 + 1] || CASE WHEN o_orderkey % 3 = 0 THEN '%' ELSE '' END || ' or ' || format('{{:,}}', o_orderkey) || '.' AS answer FROM orders),
      y AS (SELECT o_orderkey, list_filter({FIGURES.format(x='answer')}, lambda g: ends_with(g, '%') OR length(regexp_replace(g, '[^0-9]', '', 'g')) >= 2) AS said, {FIGURES.format(x='known')} AS there FROM x)
      SELECT o_orderkey, NOT list_has_all(there, said) AS invented FROM y""",
    "vf5_ocr_warnings": f"""WITH {BOXES}, w AS (SELECT doc_id, CAST(l_partkey AS VARCHAR) AS v FROM b WHERE line = 1 AND l_partkey >= 10),
      h AS (SELECT b.doc_id, min(score) AS low, min(CASE WHEN line = 5 THEN 'other' END) AS other FROM b JOIN w ON b.doc_id = w.doc_id AND contains(replace(lower(b.text), ' ', ''), w.v) GROUP BY b.doc_id, w.v)
      SELECT doc_id, min(low) AS low, min(other) AS other FROM h GROUP BY doc_id HAVING min(low) < 0.9 OR min(other) IS NOT NULL""",
    "vf6_refine": r"""WITH r AS (SELECT o_orderkey, (['number', 'date', 'amount_hw'])[o_orderkey % 3 + 1] AS kind, (o_orderkey % 11) / 10.0::DOUBLE AS support, CASE o_orderkey % 4 WHEN 1 THEN ' ' || o_custkey WHEN 0 THEN NULL ELSE CAST(o_custkey AS VARCHAR) END AS ocr,
        CASE WHEN o_orderkey % 5 = 0 THEN o_custkey || '0' WHEN o_orderkey % 5 < 3 THEN CAST(o_custkey AS VARCHAR) WHEN o_orderkey % 5 = 3 THEN '' END AS vision, o_orderkey % 2 = 0 AS is_ocr, o_custkey % 3 = 0 AS ok FROM orders),
      c AS (SELECT kind, count(*) FILTER (is_ocr AND ok) AS a, count(*) FILTER (is_ocr) AS b, count(*) FILTER (NOT is_ocr AND ok) AS c, count(*) FILTER (NOT is_ocr) AS d FROM r GROUP BY kind),
      p AS (SELECT kind, CASE WHEN CASE WHEN ends_with(kind, '_hw') THEN (3.6::DOUBLE + a) / (6 + b) ELSE (1.0::DOUBLE + a) / (1 + b) END >= CASE WHEN ends_with(kind, '_hw') THEN (3.0::DOUBLE + c) / (6 + d) ELSE (0.5::DOUBLE + c) / (1 + d) END THEN 'ocr' ELSE 'vision' END AS prefer FROM c),
      s AS (SELECT r.*, prefer, CASE WHEN coalesce(vision, '') = '' THEN 'ocr only' WHEN coalesce(ocr, '') = '' THEN 'filled' WHEN trim(ocr) = trim(vision) THEN 'agree' ELSE 'disputed' END AS state FROM r JOIN p USING (kind)),
      t AS (SELECT *, CASE state WHEN 'filled' THEN 'vision' WHEN 'disputed' THEN prefer ELSE 'ocr' END AS used FROM s)
      SELECT o_orderkey, state, used, CASE WHEN used = 'ocr' THEN ocr ELSE vision END AS reading, round(CASE state WHEN 'agree' THEN greatest(support, 0.9) WHEN 'filled' THEN greatest(support, 0.6) ELSE support END, 6) AS support FROM t""",
    "cv2_context": "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 8",
    "ca1_cache_lookup": f"""WITH c AS (SELECT * FROM conversations WHERE text IS NOT NULL), h AS (SELECT DISTINCT {CACHE_WORDS.format(x="text")} AS w, role FROM c WHERE turn % 2 = 0)
      SELECT conv_id, turn, CASE WHEN h.role IS NOT NULL THEN 'held' END AS cached FROM c LEFT JOIN h ON {CACHE_WORDS.format(x="'Please ' || c.text")} = h.w AND c.role = h.role""",
    "ca2_evidence_there": rf"""WITH {ANSWERS} SELECT doc_id, contains(trim(regexp_replace(page_text, '\s+', ' ', 'g')), substr(trim(regexp_replace(CASE doc_id % 3 WHEN 0 THEN 'x' || evidence WHEN 1 THEN evidence || 'x' ELSE evidence END, '\s+', ' ', 'g')), 1, 200)) AS there FROM a""",
    "ca4_recall": f"""WITH {MEMORY}, o AS (SELECT *, {JACCARD_WORDS.format(x="q")} AS w FROM m WHERE verified), q AS (SELECT item_id AS query_id, {JACCARD_WORDS.format(x="'What is ' || text")} AS w FROM benchmark),
      p AS (SELECT query_id, a, ts, CAST(len(list_intersect(q.w, o.w)) AS DOUBLE) / greatest(len(list_distinct(list_concat(q.w, o.w))), 1) AS j FROM q, o),
      b AS (SELECT query_id, arg_min(a, (-j, ts)) AS recalled FROM p WHERE j >= 0.85 GROUP BY query_id) SELECT q.query_id, recalled FROM q LEFT JOIN b USING (query_id)""",
    "ca5_remember": """WITH c AS (SELECT *, CAST(conv_id * 1000 + turn AS DOUBLE) AS ts FROM conversations WHERE text IS NOT NULL), n AS (SELECT text AS q, 'new' AS a, ts + 0.5 AS ts FROM c WHERE role = 'assistant')
      SELECT q, a, ts FROM (SELECT text AS q, 'a' || conv_id AS a, ts FROM c WHERE text NOT IN (SELECT q FROM n) UNION ALL SELECT * FROM n) ORDER BY ts DESC, q LIMIT 500""",
    "bg1_limits": """SELECT event_id, (['frugal', 'balanced', 'thorough'])[event_id % 3 + 1] AS preset, ([1500.0, 4000.0, 12000.0])[event_id % 3 + 1]::DOUBLE AS limit_llm_tokens, ([20.0, 60.0, 180.0])[event_id % 3 + 1]::DOUBLE AS limit_seconds,
      CASE WHEN event_id % 4 = 0 THEN 99.0 ELSE ([4.0, 8.0, 20.0])[event_id % 3 + 1] END::DOUBLE AS limit_tool_calls, ([0.0, 4.0, 10.0])[event_id % 3 + 1]::DOUBLE AS limit_vlm_looks, ([2.0, 6.0, 20.0])[event_id % 3 + 1]::DOUBLE AS limit_ocr_pages FROM events""",
    "bg2_left": "SELECT event_id, round(l, 6) AS left, l >= 5 - 1e-9 AS can FROM (SELECT event_id, greatest(0.0::DOUBLE, CASE WHEN event_id % 2 = 0 THEN 20.0 ELSE 50.0 END::DOUBLE - value) AS l FROM events)",
    "bg3_spend": f"""WITH RECURSIVE {EVENTS}, s(user_id, i, accepted, spent) AS (SELECT DISTINCT user_id, 0::BIGINT, 0::BIGINT, 0.0::DOUBLE FROM e
      UNION ALL SELECT s.user_id, e.i, CASE WHEN 100 - spent < e.n THEN accepted ELSE accepted + 1 END, CASE WHEN 100 - spent < e.n THEN spent ELSE spent + e.n END FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1)
      SELECT user_id, arg_max(accepted, i) AS accepted, arg_max(spent, i) AS spent FROM s GROUP BY user_id""",
    "bg4_charge": f"WITH {EVENTS}, r AS (SELECT event_id, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM e) SELECT event_id, used, greatest(0.0::DOUBLE, used - 100.0::DOUBLE) AS overshoot FROM r",
    "bg5_extensions": f"""WITH RECURSIVE {EVENTS}, s(user_id, i, granted, waiting, room_left) AS (SELECT DISTINCT user_id, 0::BIGINT, 0::BIGINT, 0::BIGINT, 150.0::DOUBLE FROM e
      UNION ALL SELECT s.user_id, e.i, granted + CASE WHEN e.n <= room_left THEN 1 ELSE 0 END, waiting + CASE WHEN e.n <= room_left THEN 0 ELSE 1 END, room_left - CASE WHEN e.n <= room_left THEN e.n ELSE 0 END
      FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1)
      SELECT user_id, arg_max(granted, i) AS granted, arg_max(waiting, i) AS waiting, arg_max(room_left, i) AS room_left FROM s GROUP BY user_id""",
    "lr3_features": f"""WITH {RUNS.replace("WITH ", "")}, {SCANS}, {ASKED}, q2 AS (SELECT query_id, CASE WHEN query_id % 4 = 0 THEN 'List all fields of the photo: market segment, ' || q ELSE q END AS q FROM qs), {_many("q2")},
      top AS (SELECT query_id, max(score) AS top FROM r GROUP BY query_id), nd AS (SELECT avg(CAST(source IN ('none', 'scan-text') AS DOUBLE)) AS need FROM sn),
      kx AS (SELECT {tok("label")} AS k FROM lx WHERE n >= 3 AND length(label) > 2)
      SELECT q2.query_id, 1.0::DOUBLE AS bias, round(need, 6) AS need_ocr, CAST(regexp_matches(q, '(?i){W.LOOK_Q}') AS DOUBLE) AS visual_kw, CAST(regexp_matches(q, '(?i){W.EXTRACT_Q}') AS DOUBLE) AS extract_kw, round(least(length(q) / 120.0::DOUBLE, 1.0), 6) AS q_len,
      round(least(coalesce(top, 0) / 10.0::DOUBLE, 1.0), 6) AS top_score, CAST(q2.query_id % 3 >= 1 AS DOUBLE) AS vlm_left, round((q2.query_id * 100 % 5000) / 4000.0::DOUBLE, 6) AS tokens_left,
      CASE WHEN top IS NOT NULL AND EXISTS (SELECT 1 FROM kx WHERE len(kx.k) > 0 AND list_has_all({tok("q")}, kx.k)) THEN 1.0 ELSE 0.0 END::DOUBLE AS label_match FROM q2 CROSS JOIN nd LEFT JOIN top ON q2.query_id = top.query_id""",
    "lr4_promote": f"""WITH c AS ({RESULTS.format(k=3)}), l AS ({RESULTS.format(k=9)}), x AS (SELECT category, avg(CAST(ok AS DOUBLE)) AS v FROM c GROUP BY category), y AS (SELECT category, avg(CAST(ok AS DOUBLE)) AS v FROM l GROUP BY category)
      SELECT (SELECT bool_and(coalesce(x.v, 0) >= y.v - 1e-9) FROM y LEFT JOIN x USING (category)) AND (SELECT avg(CAST(ok AS DOUBLE)) FROM c) >= (SELECT avg(CAST(ok AS DOUBLE)) FROM l) AS promoted""",
    "lr6_trust": """WITH e AS (SELECT event_type || CASE WHEN user_id % 2 = 0 THEN '_hw' ELSE '' END AS kind, event_id % 2 = 0 AS ocr, value > 30 AS ok FROM events),
      c AS (SELECT kind, count(*) FILTER (ocr AND ok) AS a, count(*) FILTER (ocr) AS b, count(*) FILTER (NOT ocr AND ok) AS c, count(*) FILTER (NOT ocr) AS d FROM e GROUP BY kind),
      s AS (SELECT kind, CASE WHEN ends_with(kind, '_hw') THEN (3.6::DOUBLE + a) / (6 + b) ELSE (1.0::DOUBLE + a) / (1 + b) END AS o, CASE WHEN ends_with(kind, '_hw') THEN (3.0::DOUBLE + c) / (6 + d) ELSE (0.5::DOUBLE + c) / (1 + d) END AS v FROM c)
      SELECT kind, round(o, 6) AS ocr, round(v, 6) AS vision, CASE WHEN o >= v THEN 'ocr' ELSE 'vision' END AS prefer FROM s""",
    "lr7_token_allowance": f"""WITH RECURSIVE x AS (SELECT {pick("user_id", "lookup", "list", "open", "visual")} AS cls, floor(value * 20) AS used, ts, event_id FROM events),
      e AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY ts, event_id) AS i FROM x),
      s(cls, i, ema) AS (SELECT cls, 0::BIGINT, used FROM e WHERE i = 1 UNION ALL SELECT s.cls, e.i, 0.8::DOUBLE * ema + 0.2::DOUBLE * e.used FROM s JOIN e ON e.cls = s.cls AND e.i = s.i + 1),
      f AS (SELECT cls, CAST(max(i) AS INTEGER) AS n, arg_max(ema, i) AS ema FROM s GROUP BY cls), d AS (SELECT *, CASE cls WHEN 'lookup' THEN 1600.0 WHEN 'open' THEN 2600.0 ELSE 2000.0 END::DOUBLE AS d FROM f)
      SELECT cls, n, round(ema, 3) AS ema, CAST(floor(least(4000.0::DOUBLE, CASE WHEN n < 5 THEN d ELSE greatest(0.6::DOUBLE * d, 2.0::DOUBLE * ema) END)) AS BIGINT) AS allowance FROM d""",
    "lr8_feedback": r"""WITH e AS (SELECT o_orderkey AS request, o_orderkey % 3 = 0 AS good, CASE WHEN o_orderkey % 3 = 1 THEN CAST(o_custkey AS VARCHAR) END AS correction, 'a' || o_custkey AS answer, (['text', 'ocr', 'other'])[o_orderkey % 3 + 1] AS action,
        o_orderkey % 2 = 0 AS read, CASE WHEN o_orderkey % 4 = 0 THEN 'vision' ELSE 'ocr' END AS used, CAST(o_custkey AS VARCHAR) AS ocr, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN o_custkey || '0' ELSE o_custkey || '.' END AS vision FROM orders),
      s AS (SELECT *, 'ocr' AS source, ocr AS own, vision AS other FROM e WHERE read UNION ALL SELECT *, 'vision', vision, ocr FROM e WHERE read),
      j AS (SELECT *, replace(own, '.', '') = replace(coalesce(CASE WHEN used = source THEN own ELSE other END, ''), '.', '') AS like_used, replace(own, '.', '') = correction AS like_correction FROM s)
      SELECT request, 'evict' AS effect, 'cache' AS what, NULL AS value FROM e WHERE NOT good UNION ALL SELECT request, 'remember', 'answer', answer FROM e WHERE good UNION ALL SELECT request, 'remember', 'correction', correction FROM e WHERE NOT good AND correction IS NOT NULL
      UNION ALL SELECT request, 'reward', action, CASE WHEN good THEN '1' ELSE '-1' END FROM e WHERE action IN ('text', 'ocr')
      UNION ALL SELECT request, 'trust', 'number:' || source, CASE WHEN source = used THEN 'true' ELSE 'false' END FROM j WHERE good AND (source = used OR (own IS NOT NULL AND NOT like_used))
      UNION ALL SELECT request, 'trust', 'number:' || source, CAST(like_correction AS VARCHAR) FROM j WHERE NOT good AND correction IS NOT NULL AND own IS NOT NULL""",
    "ev1_correct": rf"""WITH y AS (SELECT doc_id, text, string_split(text, chr(10))[-1] AS last FROM documents WHERE text IS NOT NULL), x AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN reverse(last) ELSE last END AS g,
      CASE WHEN doc_id % 4 <> 0 THEN upper(text) ELSE 'No information.' END AS a FROM y)
      SELECT doc_id, CASE WHEN g IS NULL THEN regexp_matches(a, '(?i){W.NOT_FOUND}') ELSE contains(regexp_replace(lower(a), '[\s,]', '', 'g'), regexp_replace(lower(g), '[\s,]', '', 'g')) END AS "right" FROM x""",
    "ev2_gold_lists": """WITH x AS (SELECT doc_id, ' ' || regexp_replace(trim(regexp_replace(replace(lower(text), ',', ''), '\\s+', ' ', 'g')), '[^a-z]', ' ', 'g') || ' ' AS p FROM documents)
      SELECT doc_id, (contains(p, ' the ') OR contains(p, ' der ')) AND contains(p, ' in ') AND NOT contains(p, ' idiot ') AS "right" FROM x""",
    "ev4_accuracy": f"WITH c AS ({RESULTS.format(k=3)}) SELECT category, count(*) AS n, round(avg(CAST(ok AS DOUBLE)), 6) AS accuracy FROM c GROUP BY ROLLUP (category)",
    "ev5_digit_gold": rf"""WITH {RECEIPTS} SELECT doc_id, list_contains(list_transform(regexp_extract_all(text, '\d[\d.,/-]*'), lambda n: regexp_replace(n, '[^0-9]', '', 'g')), CAST(c + CASE WHEN doc_id % 10 = 3 THEN 1 ELSE 0 END AS VARCHAR)) AS "right" FROM rc""",
    "ev6_word_outcomes": f"""WITH {BOXES}, w AS (SELECT doc_id, l_partkey * 10 + line AS id, CASE WHEN line % 3 = 0 THEN 'heading' ELSE CAST(l_partkey AS VARCHAR) END AS word, 0.25 AS cx, y0 + 0.002 AS cy FROM b),
      h AS (SELECT w.doc_id, w.id, w.word, lower(string_agg(text, ' ')) AS t FROM w JOIN (SELECT * REPLACE (x0 + CASE WHEN line % 2 = 0 THEN 0.4 ELSE 0 END AS x0, x1 + CASE WHEN line % 2 = 0 THEN 0.4 ELSE 0 END AS x1) FROM b) b ON b.doc_id = w.doc_id AND cx BETWEEN x0 - 0.005 AND x1 + 0.005 AND cy BETWEEN y0 - 0.004 AND y1 + 0.004 GROUP BY ALL),
      o AS (SELECT w.doc_id, w.id, CASE WHEN regexp_matches(w.word, '[0-9]') THEN 'num' ELSE 'word' END AS kind, CASE WHEN t IS NULL THEN 'missed'
        WHEN list_contains(regexp_split_to_array(t, '[^a-z0-9]+'), w.word) OR (length(w.word) >= 3 AND contains(regexp_replace(t, '[^a-z0-9]', '', 'g'), w.word)) THEN 'exact' ELSE 'misread' END AS outcome
        FROM w LEFT JOIN h ON h.doc_id = w.doc_id AND h.id = w.id AND h.word = w.word) SELECT kind, outcome, count(*) AS n FROM o GROUP BY ALL""",
    "ev7_nearest_values": """WITH s AS (SELECT l_orderkey AS doc_id, 'L' || l_linenumber || ':' AS label, CAST(l_partkey AS VARCHAR) AS value, 60 + l_quantity AS x0, l_linenumber * 40.0 AS y FROM lineitem)
      SELECT a.doc_id, a.label, arg_min(b.value, (b.x0, b.value)) AS value FROM (SELECT DISTINCT doc_id, label, y FROM s) a JOIN s b ON a.doc_id = b.doc_id AND abs(a.y - b.y) <= 9.6 AND b.x0 >= 52 GROUP BY a.doc_id, a.label""",
    "ev8_dev_split": "SELECT item_id, row_number() OVER (ORDER BY item_id) <= floor(count(*) OVER () * 0.6) AS dev FROM benchmark",
    "src3_docx_lines": r"""WITH l AS (SELECT page_id, unnest(ls) AS line, CAST(unnest(range(0, len(ls))) AS INTEGER) AS n FROM (SELECT page_id, string_split(coalesce(html, ''), chr(10)) AS ls FROM pages))
      SELECT page_id, n, regexp_replace('<w:p><w:r>' || line || '</w:r></w:p>', '<[^>]+>', '', 'g') AS line FROM l""",
    "src4_pdf_pages": r"""WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents WHERE doc_id % 2 = 0),
      p AS (SELECT doc_id, p, list_filter(list_transform(ls[p * 20 + 1:p * 20 + 20], lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS lines FROM (SELECT *, unnest(range(0, CAST(ceil(len(ls) / 20.0) AS BIGINT))) AS p FROM l))
      SELECT 'd' || doc_id || '.pdf' AS name, CAST(p + 1 AS INTEGER) AS page, CASE WHEN length(coalesce(array_to_string(lines, ''), '')) >= 40 THEN 'text' ELSE 'none' END AS source,
      coalesce(array_to_string(lines, chr(10) || chr(10)), '') AS text FROM p""",
    "src8_gateway_text": r"""WITH f AS (SELECT 'd' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.pdf' ELSE '.txt' END AS path, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS t FROM documents)
      SELECT path, CAST(i / 580 AS INTEGER) AS n, substr(t, CAST(i + 1 AS BIGINT), 700) AS piece FROM (SELECT path, t, unnest(range(0, length(t), 580)) AS i FROM f)""",
    "src10_upload_modes": f"""WITH {SCANS}, c AS (SELECT doc_id, (['background', 'lazy', 'all'])[doc_id % 3 + 1] AS mode, count(*) FILTER (kind IN ('pdf', 'image') AND source IN ('none', 'scan-text')) AS unread FROM sn GROUP BY doc_id, kind)
      SELECT doc_id, mode, CASE WHEN mode = 'all' THEN least(unread, 3) ELSE 0 END AS read_now, CASE WHEN mode = 'background' THEN least(3, unread, doc_id % 7) ELSE 0 END AS in_background,
      unread - CASE WHEN mode = 'all' THEN least(unread, 3) ELSE 0 END AS still_unread FROM c""",
    "snk3_traces": "SELECT event_id, event_type AS strategy, CAST(floor(value) AS BIGINT) AS tokens, value > 30 AS verified FROM events",
    "snk4_policy_files": """WITH p AS (SELECT user_id % 3 AS k, event_type, round(avg(value), 6) AS weight FROM events GROUP BY ALL)
      SELECT step, what, done, event_type, weight FROM (VALUES (0, 'promote', true, 0), (1, 'promote', true, 1), (2, 'promote', true, 2), (3, 'rollback', true, 1), (4, 'rollback', true, 0), (5, 'rollback', false, 0)) AS v(step, what, done, k) JOIN p USING (k)""",
    "lr5_rollback": "SELECT event_type, round(avg(value), 6) AS weight, 3 AS version FROM events WHERE user_id % 3 = 0 GROUP BY event_type",
    "src7_cache_store": f"""WITH {PAGES} SELECT doc_id, page, CASE WHEN (doc_id + page) % 3 = 1 OR (doc_id + page) % 2 = 1 THEN 'ocr' ELSE 'text' END AS source,
      CASE WHEN (doc_id + page) % 3 = 1 THEN 'second ' || page WHEN (doc_id + page) % 2 = 1 THEN 'first ' || page END AS reading FROM tx""",
    "fn2_stop_words": f"SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents) WHERE list_contains({_list(sorted(W.STOP))}, word) GROUP BY word",
    "fn26_bengali_share": f"""SELECT doc_id, round(CAST(len(list_filter(regexp_extract_all(m, '\\p{{L}}'), lambda c: regexp_matches(c, '[{W.BENGALI}]'))) AS DOUBLE) / greatest(len(regexp_extract_all(m, '\\p{{L}}')), 1), 6) AS share FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN repeat('ঋণের পরিমাণ ', CAST(doc_id % 400 AS BIGINT)) || text ELSE text END AS m FROM documents)""",
    "rk8_unseen_terms": f"""WITH {UNITS}, {ASKED}, q AS (SELECT query_id, unnest(list_distinct(k)) AS term FROM (SELECT query_id, {tok("q")} AS k FROM qs)),
      s AS (SELECT query_id, term, {STEM} AS st FROM q WHERE NOT (length(term) > 4 AND (ends_with(term, 'ed') OR ends_with(term, 'ing')))),
      g AS (SELECT DISTINCT unnest(toks) AS t FROM u), p AS (SELECT t AS p FROM g UNION SELECT substr(t, 1, 3) FROM g UNION SELECT substr(t, 1, 4) FROM g UNION SELECT substr(t, 1, 5) FROM g)
      SELECT query_id, term FROM s WHERE term NOT IN (SELECT t FROM g) AND st NOT IN (SELECT p FROM p) AND substr(st, 1, 5) NOT IN (SELECT p FROM p) AND NOT (length(st) <= 5 AND substr(st, 1, 4) IN (SELECT p FROM p))""",
    "bg6_change_limits": """WITH x AS (SELECT event_id, event_id % 7 = 0 AS none, (['llm_tokens', 'seconds', 'pages'])[event_id % 3 + 1] AS name, CASE event_id % 5 WHEN 0 THEN -1.0 WHEN 1 THEN floor(value) + 0.5 ELSE floor(value) END AS v, event_id % 9 AS calls FROM events),
      y AS (SELECT *, NOT none AND name <> 'pages' AND v >= 0 AND (name = 'seconds' OR v = floor(v)) AS changed FROM x)
      SELECT event_id, changed, CASE WHEN changed AND name = 'llm_tokens' THEN v ELSE 4000 END::DOUBLE AS limit_llm_tokens, CASE WHEN changed AND name = 'seconds' THEN v ELSE 60 END::DOUBLE AS limit_seconds,
      CASE WHEN changed THEN calls ELSE 8 END::DOUBLE AS limit_tool_calls FROM y""",
    "md5_chat_within": """WITH c AS (SELECT conv_id, CAST(floor(sum(length(coalesce(text, '')) / 3.2::DOUBLE + 4)) AS BIGINT) AS estimate, length(coalesce(arg_max(coalesce(text, ''), turn), '')) // 4 AS used, CAST(conv_id % 600 AS DOUBLE) AS l FROM conversations GROUP BY conv_id),
      r AS (SELECT *, estimate + 32 > l AS refused FROM c) SELECT conv_id, estimate, refused, CASE WHEN refused THEN 0 ELSE used END AS used, round(greatest(l - CASE WHEN refused THEN 0 ELSE used END, 0.0), 3) AS left_after FROM r""",
    "ex6_targeted": f"""WITH {FORMS}, n AS (SELECT doc_id, text, unnest(['Market Segment', 'Nation', 'Owner']) AS field FROM f WHERE len(list_intersect({tok("text")}, ['market', 'segment', 'nation', 'owner'])) > 0),
      v AS (SELECT doc_id, field, list_filter(string_split(text, {NL}), lambda x: starts_with(x, field || ': '))[1] AS line FROM n) SELECT doc_id, field, substr(line, length(field) + 3) AS value, line IS NOT NULL AS verified FROM v""",
    "md2_second_readings": f"WITH {BOXES} SELECT doc_id, line, l_partkey AS part, CASE WHEN score < 0.9 AND line % 3 <> 0 THEN upper(text) END AS alt FROM b",
    # What the rows are drawn to say: the tick of kinds 1, 2, 4 and 5 is clear, also beside a missing box; none or two say nothing.
    "md7_checkbox_rows": """WITH c AS (SELECT c_custkey AS k, c_mktsegment AS s, c_custkey % 6 AS kind, 3 + c_custkey % 2 AS n FROM customer),
      o AS (SELECT *, CASE WHEN n = 4 THEN [s, 'Beta', 'Gamma', 'Delta'] ELSE [s, 'Beta', 'Gamma'] END AS names, k // 6 % n + 1 AS chosen FROM c)
      SELECT k AS doc_id, CASE WHEN kind IN (1, 2, 4, 5) THEN names[chosen] END AS option, kind IN (1, 2, 4, 5) AS confident, array_to_string(names, '|') AS options,
      CASE WHEN kind IN (1, 2, 4, 5) THEN 'the box with clearly the most ink' ELSE 'no box has clearly more ink than the others' END AS detail FROM o""",
    "src4_pdf_text": f"""WITH {PDF_BLOCKS}, t AS (SELECT doc_id, page, array_agg(text ORDER BY block) AS texts FROM b GROUP BY ALL),
      x AS (SELECT p.doc_id, p.page, CASE WHEN coalesce(list_sum(list_transform(texts, lambda x: length(x))), 0) < 40 THEN [] ELSE texts END AS texts FROM p LEFT JOIN t USING (doc_id, page)),
      y AS (SELECT *, array_to_string(texts, ' ') AS m FROM x), z AS (SELECT *, len(regexp_extract_all(m, '[{W.LEGACY_SIGNATURE}]')) AS g, greatest(len(regexp_extract_all(m, '\\p{{L}}')), 1) AS l FROM y),
      v AS (SELECT *, NOT regexp_matches(m, '[{W.BENGALI}]') AND g >= {W.LEGACY_LEAST} AND CAST(g AS DOUBLE) / l >= {W.LEGACY_SHARE} AS legacy FROM z)
      SELECT 'd' || doc_id || '.pdf' AS path, page, CASE WHEN texts = [] THEN 'none' WHEN doc_id % 7 = 0 THEN 'scan-text' ELSE 'text' END AS source, legacy,
      CASE WHEN legacy THEN CAST(len(texts) AS VARCHAR) ELSE array_to_string(texts, {NL} || {NL}) END AS text FROM v""",
    "src4_pdf_blocks": f"""WITH {PDF_BLOCKS} SELECT 'd' || doc_id || '.pdf' AS path, page, block, text, round(50 / 595.0::DOUBLE, 4) AS x0, round(1 - (800 - 14 * (6 * block) + 8) / 842.0::DOUBLE, 4) AS y0,
      round((50 + 5 * wide) / 595.0::DOUBLE, 4) AS x1, round(1 - (800 - 14 * (6 * block + n - 1) - 2) / 842.0::DOUBLE, 4) AS y1 FROM b""",
    "rk14_unmatched_terms": f"""WITH {ABSENT} SELECT query_id, term, round({IDF}, 6) AS idf, list_contains({_list(sorted(W.ROLE_WORDS))}, term) AS role FROM ab""",
    "rk15_unmatched_share": f"""WITH {ABSENT}, w AS (SELECT query_id, sum({IDF}) AS weight FROM qd WHERE NOT list_contains({_list(sorted(W.ROLE_WORDS))}, term) GROUP BY query_id),
      x AS (SELECT query_id, sum({IDF}) AS absent FROM ab WHERE NOT list_contains({_list(sorted(W.ROLE_WORDS))}, term) GROUP BY query_id)
      SELECT query_id, round(CASE WHEN coalesce(weight, 0) > 0 THEN coalesce(absent, 0.0::DOUBLE) / weight ELSE 0.0::DOUBLE END, 6) AS share FROM qa LEFT JOIN w USING (query_id) LEFT JOIN x USING (query_id)""",
    "rk16_best_coverage": f"""WITH {ABSENT}, gu AS (SELECT doc_id, page, unnest(list_distinct(toks)) AS t FROM u),
      hit AS (SELECT DISTINCT query_id, doc_id, page, term, {IDF} AS idf FROM qd JOIN gu ON t = term UNION SELECT DISTINCT query_id, doc_id, page, term, {IDF} FROM qd JOIN gu ON length(term) >= 5 AND length(t) >= 4 AND substr(t, 1, 4) = substr(term, 1, 4)),
      c AS (SELECT query_id, sum(idf) AS covered FROM hit GROUP BY query_id, doc_id, page), w AS (SELECT query_id, sum({IDF}) AS total FROM qd GROUP BY query_id),
      b AS (SELECT query_id, max(covered) AS covered FROM c GROUP BY query_id)
      SELECT query_id, round(coalesce(covered / CASE WHEN total = 0 THEN 1.0::DOUBLE ELSE total END, 0.0::DOUBLE), 6) AS coverage FROM qa LEFT JOIN w USING (query_id) LEFT JOIN b USING (query_id)""",
    "lr2_learn_router": f"""WITH RECURSIVE e AS (SELECT user_id, ({_list(ACTIONS)})[event_id % 4 + 1] AS action, [1.0::DOUBLE, {", ".join(f"event_id * {k} % 11 / 10.0::DOUBLE" for k in range(1, 9))}] AS x,
        CASE WHEN value > 50 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS r, row_number() OVER (PARTITION BY user_id, event_id % 4 ORDER BY ts, event_id) AS n FROM events),
      f AS (SELECT DISTINCT user_id, action, CAST(0 AS BIGINT) AS n, CASE action {" ".join(f"WHEN '{a}' THEN {[float(w) for w in PRIOR[a]]}::DOUBLE[]" for a in ACTIONS)} END AS w FROM e
        UNION ALL SELECT f.user_id, f.action, e.n, list_transform(range(1, 10), lambda i: 0.995::DOUBLE * w[i] + 0.15::DOUBLE * (r - list_dot_product(w, x)) * x[i]) FROM f JOIN e ON e.user_id = f.user_id AND e.action = f.action AND e.n = f.n + 1)
      SELECT user_id, action, {", ".join(f"round(arg_max(w, n)[{i + 1}], 6) AS {n}" for i, n in enumerate(FEATURES))} FROM f GROUP BY user_id, action""",
    "bg5_live_budgets": """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_ms(ts) AS ms, CASE event_id % 10 WHEN 0 THEN 'limit' WHEN 1 THEN 'extend' WHEN 2 THEN 'turn' ELSE 'spend' END AS op,
        CAST(CASE WHEN event_id % 20 = 0 THEN -CAST(floor(value) AS BIGINT) WHEN event_id % 10 = 2 THEN CAST(floor(value) AS BIGINT) * 20000 ELSE CAST(floor(value) AS BIGINT) END AS DOUBLE) AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
      f AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS i, CAST(-1 AS BIGINT) AS event_id, '' AS op, '' AS outcome, 0.0::DOUBLE AS spent, 400.0::DOUBLE AS cap, 60.0::DOUBLE AS room, CAST(0 AS BIGINT) AS ends FROM e
        UNION ALL SELECT user_id, i, event_id, op, outcome, CASE outcome WHEN 'accepted' THEN spent + v ELSE spent END, CASE outcome WHEN 'granted' THEN cap + v WHEN 'changed' THEN v ELSE cap END,
          CASE outcome WHEN 'granted' THEN room - v ELSE room END, CASE op WHEN 'turn' THEN ms + CAST(v AS BIGINT) * 1000 ELSE ends END
        FROM (SELECT e.user_id, e.i, e.event_id, e.op, e.ms, e.v, spent, cap, room, ends, CASE e.op WHEN 'spend' THEN CASE WHEN ends > 0 AND ms >= ends THEN 'late' WHEN greatest(0, cap - spent) >= v THEN 'accepted' ELSE 'refused' END
          WHEN 'extend' THEN CASE WHEN v <= room THEN 'granted' ELSE 'waiting' END WHEN 'limit' THEN CASE WHEN v >= 0 THEN 'changed' ELSE 'invalid' END ELSE 'begun' END AS outcome FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1))
      SELECT CAST(user_id AS VARCHAR) AS session, event_id, op, outcome, spent, cap, room FROM f WHERE i > 0""",
    "rk2_changed_index": f"""WITH {PAGES}, c AS (SELECT CASE WHEN doc_id % 89 = 5 THEN text || ' renewed entry' ELSE text END AS text FROM tx WHERE text <> '' AND (doc_id % 97 <> 3 OR doc_id % 89 = 5))
      SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({tok("text")})) AS term FROM c) GROUP BY term""",
    "rk5_changed_search": f"""WITH {UNITS}, v AS (SELECT * FROM u WHERE (doc_id % 5 <> 0 OR doc_id % 3 <> 0) AND doc_id % 7 <> 1), {_scores("v", "sc")}
      SELECT doc_id, page, round(score, 6) AS score FROM sc WHERE bm25 > 0 ORDER BY 3 DESC, 1, 2 LIMIT 10""",
    "md3_missed_boxes": f"""WITH {BOXES}, f AS (SELECT * FROM b WHERE line % 3 <> 0),
      s AS (SELECT row_number() OVER () AS id, doc_id, line + 100 AS box_id, text, 0.1 + l_partkey % 5 * 0.1::DOUBLE AS x0, 0.5 + l_partkey % 5 * 0.1::DOUBLE AS x1, y0, y1 FROM b),
      c AS (SELECT s.id, sum(greatest(0, least(s.x1, 0.5) - greatest(s.x0, 0.1)) * greatest(0, least(s.y1, f.y1) - greatest(s.y0, f.y0)) / greatest((s.x1 - s.x0) * (s.y1 - s.y0), 1e-12)) AS covered FROM s JOIN f ON s.doc_id = f.doc_id GROUP BY ALL)
      SELECT doc_id, line AS box_id, text, 1 AS look FROM f UNION ALL SELECT s.doc_id, s.box_id, text, 2 FROM s LEFT JOIN c ON s.id = c.id WHERE coalesce(covered, 0) < 0.2""",
    "md3_sideways_runs": """WITH l AS (SELECT l_orderkey AS doc_id, l_linenumber AS n, l_returnflag AS text, 30 * l_linenumber AS t, l_linenumber = 4 AND l_orderkey % 4 = 0 AS cut FROM lineitem),
      g AS (SELECT *, CASE WHEN t - lag(t + 20) OVER (PARTITION BY doc_id ORDER BY t) >= 25 THEN 1 ELSE 0 END AS far FROM l WHERE NOT cut),
      p AS (SELECT *, sum(far) OVER (PARTITION BY doc_id ORDER BY t) AS part FROM g),
      r AS (SELECT doc_id, part, count(*) AS fragments, string_agg(text, '' ORDER BY t, text) AS text, min(t) AS y0, max(t) + 20 AS y1 FROM p GROUP BY ALL HAVING count(*) >= 3 AND max(t) + 20 - min(t) >= 30)
      SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY part) AS INTEGER) AS run, fragments, text, round(y0 / 1000.0::DOUBLE, 4) AS y0, round(y1 / 1000.0::DOUBLE, 4) AS y1 FROM r WHERE doc_id % 5 <> 0""",
    "md4_command_lines": r"""WITH l AS (SELECT doc_id, unnest(string_split(regexp_replace(coalesce(text, ''), '[\r\x0b\x0c\x00]', ' ', 'g'), chr(10))) AS line, generate_subscripts(string_split(regexp_replace(coalesce(text, ''), '[\r\x0b\x0c\x00]', ' ', 'g'), chr(10)), 1) AS n FROM documents),
      w AS (SELECT doc_id, n, regexp_extract_all(line, '[^ \t]+') AS w FROM l)
      SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n) AS INTEGER) AS row, array_to_string(w, ' ') AS text, 10 / 10000.0::DOUBLE AS x0, round(20 * n / 100000.0::DOUBLE, 6) AS y0, round((10 * len(w) + 8) / 10000.0::DOUBLE, 6) AS x1,
      round((20 * n + 12) / 100000.0::DOUBLE, 6) AS y1, round((90 - n % 5) / 100.0::DOUBLE, 6) AS score FROM w WHERE len(w) > 0""",
    "src10_background_reading": f"""WITH {SCANS} SELECT doc_id, page, array_to_string(list_filter(list_transform(string_split(text, {NL}), lambda x: trim(x)), lambda x: x <> ''), {NL}) AS reading FROM sn WHERE kind IN ('pdf', 'image') AND source IN ('none', 'scan-text')""",
    "sql1_chunks": f"WITH {CHUNKS} SELECT doc_id, page, CAST(chunk AS INTEGER) AS chunk, text FROM ck",
    "sql2_lines": f"""WITH {PAGES} SELECT tx.doc_id, substr(sha1(d.text), 1, 16) AS content_id, page, CAST(len(lines) AS INTEGER) AS n_lines, CAST(list_sum(list_transform(lines, lambda x: length(x))) AS BIGINT) AS chars FROM tx JOIN documents d ON d.doc_id = tx.doc_id WHERE len(lines) > 0""",
}
