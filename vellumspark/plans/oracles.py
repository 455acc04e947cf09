"""SQL for the queries over the driver's tables, for DuckDB.

Its regular expressions know no lookaround, so whole words are found by doubling every character that is none, and
sentence ends by marking them first. White space and word characters are written as their Unicode classes.
"""

from __future__ import annotations

import unicodedata

from ..operators.model import SECTIONS
from ..operators.scan import LISTED, WINDOW
from ..operators.skim import CONCLUDING, CONCLUSIONS, MARKERS, NUMBERS, UNTITLED
from .queries import _FLAT, ARTICLE, KEYWORDS, NO_SOURCE

_S = r"[\s\v\p{Z}\x1c-\x1f\x{85}]"
_WORD = r"\p{L}\p{N}_"
_SUFFIX = "(?:s|es|is|ns|ais|eis|ais|ies|ed|ing)?"


def _fold(x: str) -> str:
    return f"strip_accents(lower({x}))"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_S}+|{_S}+$', '', 'g')"


def _words(x: str) -> str:
    return f"CAST(len(regexp_extract_all({x}, '[^\\s\\v\\p{{Z}}\\x1c-\\x1f\\x{{85}}]+')) AS INTEGER)"


def _pattern(keyword: str, flexible: bool) -> str:
    """A keyword between separators that are doubled, so that neighbours don't share one."""
    folded = "".join(c for c in unicodedata.normalize("NFKD", keyword.lower()) if not unicodedata.combining(c))
    parts = [p + (_SUFFIX if flexible else "") for p in folded.replace("-", " ").split()]
    body = r"(?:[\s\v\p{Z}\-])+".join(parts)
    return f"(?:^|[^{_WORD}]){body}(?:[^{_WORD}]|$)"


def _total(text: str, keyword: str, flexible: bool) -> str:
    """Whole-word occurrences."""
    doubled = f"regexp_replace({_fold(text)}, '([^{_WORD}])', '\\1\\1', 'g')"
    return f"CAST(len(regexp_extract_all({doubled}, '{_pattern(keyword, flexible)}')) AS INTEGER)"


def _per_keyword(columns: str, words: list[str], flexible: bool, source: str, name: str = "total") -> str:
    return " UNION ALL ".join(f"SELECT {columns}, '{k}' AS keyword, {_total('text', k, flexible)} AS {name} FROM {source}" for k in words)


def _minutes(w: str) -> str:
    return f"CAST(greatest(1, round_even({w} / 200.0, 0)) AS INTEGER)"


_DOCS = "(SELECT doc_id, coalesce(text, '') AS text, source, lang FROM documents)"
_TURNS = "(SELECT conv_id AS doc_id, CAST(turn + 1 AS INTEGER) AS page, coalesce(text, '') AS text FROM conversations)"
_HEADED = f"(SELECT doc_id, page, 'Journal no. ' || (doc_id % 7) || chr(10) || text || chr(10) || page AS text FROM {_TURNS})"
_FLAT_SQL = "regexp_replace(coalesce(text, ''), '[\\n\\r]+', ' ', 'g')"
_ARTICLES = f"(SELECT doc_id, {ARTICLE.replace(chr(10), chr(39) + ' || chr(10) || ' + chr(39))} AS text FROM (SELECT doc_id, coalesce(source, 'none') AS source, coalesce(lang, 'none') AS lang, {_FLAT_SQL} AS flat FROM documents))"
assert _FLAT  # the same rule in Spark's SQL



def _cleaned(x: str) -> str:
    """White space brought to one form."""
    return _strip(rf"regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace({x}, '\r\n?', chr(10), 'g'), chr(173), ''), '[ \t\x{{a0}}]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')")


_CUT = f"string_split(regexp_replace(x, '([.!?]){_S}+([\"“''(\\[]?[A-ZÀ-Ú])', '\\1' || chr(1) || '\\2', 'g'), chr(1))"
_SQUEEZED = f"trim(regexp_replace(text, '{_S}+', ' ', 'g'))"
_NUMBER = r"\d+[.,]\d+|\d+\s*%|(?:^|[^\p{L}\p{N}_])\d{2,}(?:[^\p{L}\p{N}_]|$)"

_FILE = f"coalesce(source, '{NO_SOURCE}') AS file"
_RESULTS = f"""(SELECT file, keyword, CAST(sum(total) AS INTEGER) AS total FROM ({_per_keyword(_FILE, KEYWORDS, False, _DOCS)}) GROUP BY file, keyword)"""

def _repeated(pages: str) -> str:
    return f"""
SELECT doc_id, line, CAST(n AS INTEGER) AS n_pages FROM (SELECT doc_id, line, count(DISTINCT page) AS n FROM (SELECT doc_id, page, {_strip('raw')} AS line FROM (SELECT doc_id, page, unnest(string_split(text, chr(10))) AS raw FROM {pages})) WHERE len(line) BETWEEN 4 AND 119 GROUP BY doc_id, line)
JOIN (SELECT doc_id, count(DISTINCT page) AS size FROM {pages} GROUP BY doc_id) USING (doc_id) WHERE size >= 4 AND n >= greatest(3, floor(size * 0.6))"""


def _clean(pages: str) -> str:
    return rf"""
WITH r AS ({_repeated(pages)}), d AS (SELECT doc_id, list(line) AS lines FROM r GROUP BY doc_id),
h AS (SELECT doc_id, page, regexp_replace(text, '([\p{{L}}\p{{N}}_])-\n([\p{{L}}\p{{N}}_])', '\1\2', 'g') AS text FROM {pages}),
k AS (SELECT doc_id, page, CASE WHEN lines IS NULL THEN text ELSE array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(lines, {_strip('x')}) AND NOT regexp_full_match({_strip('x')}, '\d{{1,4}}')), chr(10)) END AS text FROM h LEFT JOIN d USING (doc_id))
SELECT doc_id, page, {_cleaned('text')} AS text FROM k"""


_TITLES = {"resumo": "abstract|resumo", "introducao": "introduction|introdu[cç][aã]o", "metodo": "methods?|methodology", "conclusao": "conclusions?|conclus[aã]o", "referencias": "references?|bibliography"}


def _sections() -> str:
    parts = " UNION ALL ".join(
        rf"SELECT doc_id, '{name}' AS name, regexp_extract(text, '(?im)^[ \t]*(?:\d{{1,2}}(?:\.\d{{1,2}})*[.)]?[ \t]*|[IVXivx]{{1,5}}[.)\-][ \t]*)?({titles})[ \t]*:?[ \t]*$', 1) AS title, len(string_split_regex(text, '(?im)^[ \t]*(?:\d{{1,2}}(?:\.\d{{1,2}})*[.)]?[ \t]*|[IVXivx]{{1,5}}[.)\-][ \t]*)?(?:{titles})[ \t]*:?[ \t]*$')[1]) AS start, len(text) AS size FROM {_ARTICLES}"
        for name, titles in _TITLES.items()
    )
    return f"""SELECT doc_id, name, title, CAST(start AS INTEGER) AS start, CAST(coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY start), size) AS INTEGER) AS "end" FROM ({parts}) WHERE title <> ''"""


_BOXES = f"""(SELECT doc_id, page, ws[i] AS w, i - 1 AS idx FROM (SELECT doc_id, page, ws, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT doc_id, page, list_filter(string_split_regex(text, '[ \\n]+'), lambda w: w <> '') AS ws FROM {_TURNS})))"""
_HITS = " UNION ALL ".join(f"SELECT doc_id, page, '{t}' AS target, idx FROM {_BOXES} WHERE regexp_matches({_fold('w')}, '(?:^|[^\\p{{L}}\\p{{N}}_]){t}(?:[^\\p{{L}}\\p{{N}}_]|$)')" for t in ("the", "und", "de"))
_MARKS = f"(SELECT doc_id, page, target, idx, row_number() OVER (PARTITION BY doc_id, page, target ORDER BY idx) - 1 AS n FROM ({_HITS}))"

_ALL_TITLES = "abstract|resumo|introduction|introdu[cç][aã]o|related\\s+work|literature\\s+review|revis[aã]o\\s+(?:da\\s+)?literatura|referencial\\s+te[oó]rico|methods?|methodology|materials?\\s+and\\s+methods|m[eé]todos?|metodologia|materiais\\s+e\\s+m[eé]todos|results?|resultados?|discussion|discuss[aã]o|conclusions?|considera[cç][oõ]es\\s+finais|conclus[aã]o|conclus[oõ]es|limitations?|limita[cç][oõ]es|references?|bibliography|refer[eê]ncias?|bibliografia".replace("\\\\", "\\")
_TITLE = rf"(?i)^\s*(?:\d{{1,2}}[.)]?\s*)?({_ALL_TITLES})\s*:?\s*$"
_HEAD = r"^(\d{1,2}(?:\.\d{1,2}){0,2})[.)]?\s+([^\n.;:]{3,70})\s*$"

def _blocks(pages: str) -> str:
    """Lines with their kinds; each plain line goes to the last line before it that is not plain."""
    return rf"""
WITH l AS (SELECT doc_id, i, {_strip('y')} AS s FROM (SELECT doc_id, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS y FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM {pages}))),
k AS (SELECT *, CASE WHEN s = '' THEN 'blank' WHEN regexp_matches(s, '{_TITLE}') THEN 'section' WHEN regexp_matches(s, '^(?:\[\d{{1,3}}\]|\(\d{{1,3}}\))\s+\S') THEN 'entry' WHEN regexp_matches(s, '^[•▪◦·‣∙*]\s+(.+)$') THEN 'bullet'
  WHEN regexp_matches(s, '{_HEAD}') AND {_words(f"regexp_extract(s, '{_HEAD}', 2)")} <= 10 THEN 'heading' WHEN regexp_matches(s, '^(\d{{1,2}}[.)])\s+(.+)$') THEN 'numbered' ELSE 'plain' END AS kind FROM l),
h AS (SELECT *, CASE kind WHEN 'section' THEN '## ' || trim(regexp_extract(s, '{_TITLE}', 1)) WHEN 'entry' THEN '- ' || s WHEN 'bullet' THEN '- ' || {_strip("regexp_extract(s, '^[•▪◦·‣∙*]\\s+(.+)$', 1)")} WHEN 'heading' THEN '### ' || regexp_extract(s, '{_HEAD}', 1) || ' ' || {_strip(f"regexp_extract(s, '{_HEAD}', 2)")}
  WHEN 'numbered' THEN regexp_extract(s, '^(\d{{1,2}}[.)])\s+(.+)$', 1) || ' ' || {_strip("regexp_extract(s, '^(\\d{1,2}[.)])\\s+(.+)$', 2)")} END AS head FROM k),
o AS (SELECT *, coalesce(max(CASE WHEN kind <> 'plain' THEN i END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING), 0) AS of_ FROM h),
p AS (SELECT o.*, CASE WHEN o.kind <> 'plain' THEN 0 WHEN f.kind IN ('entry', 'bullet', 'numbered') AND regexp_matches(f.head, '^(?:- |[1-9])') THEN 0 ELSE 1 END AS part FROM o LEFT JOIN (SELECT doc_id, i, kind, head FROM h) f ON f.doc_id = o.doc_id AND f.i = o.of_),
g AS (SELECT doc_id, of_, part, string_agg(coalesce(head, s), ' ' ORDER BY i) AS t, arg_min(kind, i) AS kind FROM p WHERE kind <> 'blank' GROUP BY doc_id, of_, part)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY of_, part) - 1 AS INTEGER) AS block, CASE WHEN part = 1 THEN 'paragraph' ELSE kind END AS kind, CASE WHEN part = 1 THEN {_strip(f"regexp_replace(t, '{_S}{{2,}}', ' ', 'g')")} ELSE t END AS text FROM g"""


#: Articles as documents of the raw view have them: one page, white space in one form.
_RAW = f"(SELECT doc_id, {_cleaned('joined')} AS text FROM (SELECT doc_id, regexp_replace(text, '([\\p{{L}}\\p{{N}}_])-\\n([\\p{{L}}\\p{{N}}_])', '\\1\\2', 'g') AS joined FROM {_ARTICLES}))"
_FIRST_LINE = f"list_filter(list_transform(string_split(text, chr(10))[1:15], lambda x: {_strip('x')}), lambda x: len(x) BETWEEN 25 AND 200 AND NOT regexp_matches(lower(x), '^(?:doi|http|www)'))[1]"
_NAME_OF = "CASE " + " ".join(rf"WHEN regexp_matches(substr(text, 4), '(?i)^{titles}$') THEN '{name}'" for name, titles in SECTIONS) + " END"

#: The Markdown view: what stands before the first block, the blocks, and the first title of each section.
_MARKDOWN_SECTIONS = rf"""
WITH b AS ({_blocks(_RAW)}), t AS (SELECT doc_id, coalesce('# ' || {_FIRST_LINE} || repeat(chr(10), 2), '') || '<!-- p. 1 -->' || repeat(chr(10), 2) AS lead FROM {_RAW}),
v AS (SELECT doc_id, any_value(lead) || string_agg(text, repeat(chr(10), 2) ORDER BY block) AS whole FROM b JOIN t USING (doc_id) GROUP BY doc_id),
o AS (SELECT doc_id, block, kind, text, len(lead) + coalesce(sum(len(text) + 2) OVER (PARTITION BY doc_id ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM b JOIN t USING (doc_id)),
n AS (SELECT doc_id, {_NAME_OF} AS name, substr(text, 4) AS title, start FROM o WHERE kind = 'section'),
f AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY doc_id, name ORDER BY start) = 1)
SELECT doc_id, name, title, whole[start + 1:start + 8] AS begins, CAST(start AS INTEGER) AS start, CAST(coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY start), len(whole)) AS INTEGER) AS "end" FROM f JOIN v USING (doc_id)"""

#: Blocks that count, with the number and the title of their section and their sentences.
_HEADING = rf"^#{{2,6}}{_S}+"
_SHOWN = rf"""
b AS (SELECT doc_id, block, {_strip('text')} AS text FROM ({_blocks(_RAW)})),
h AS (SELECT *, regexp_matches(text, '{_HEADING}') AS heading FROM b WHERE text <> '' AND NOT starts_with(text, '# ') AND NOT regexp_matches(text, '^<!--{_S}*p\.{_S}*\d+{_S}*-->$')),
n AS (SELECT *, CAST(count(*) FILTER (heading) OVER (PARTITION BY doc_id ORDER BY block) AS INTEGER) AS section FROM h),
p AS (SELECT *, coalesce(max(CASE WHEN heading THEN {_strip(f"regexp_replace(text, '{_HEADING}', '')")} END) OVER (PARTITION BY doc_id, section), '{UNTITLED}') AS title FROM n),
x AS (SELECT doc_id, block, section, title, {_SQUEEZED} AS x FROM p WHERE NOT heading),
s AS (SELECT doc_id, block, section, title, list_filter(list_transform({_CUT}, lambda y: {_strip('y')}), lambda y: y <> '') AS sents FROM x),
e AS (SELECT doc_id, block, section, title, i, sents[i] AS sentence FROM (SELECT *, unnest(range(1, len(sents) + 1)) AS i FROM s))"""

_SKIM_SECTIONS = rf"""
WITH {_SHOWN},
q AS (SELECT *, row_number() OVER (PARTITION BY doc_id, section ORDER BY block) AS n FROM s),
k AS (SELECT doc_id, section, max(CASE WHEN n = 1 THEN array_to_string(sents, ' ') END) AS opening, string_agg(CASE WHEN n > 1 THEN CASE WHEN len(sents) > 1 THEN sents[1] || ' | ' || sents[-1] ELSE sents[1] END END, ' | ' ORDER BY block) AS skeleton FROM q GROUP BY doc_id, section)
SELECT doc_id, section, title, CAST(1 AS INTEGER) AS page, coalesce(opening, '') AS opening, coalesce(skeleton, '') AS skeleton FROM (SELECT DISTINCT doc_id, section, title FROM p) LEFT JOIN k USING (doc_id, section)"""


def _first_sentences(test: str, most: int) -> str:
    return rf"""
WITH {_SHOWN}, c AS (SELECT doc_id, sentence, title, row_number() OVER (PARTITION BY doc_id ORDER BY block, i) AS n FROM e WHERE {test})
SELECT doc_id, CAST(n AS INTEGER) AS position, sentence, CAST(1 AS INTEGER) AS page, title AS section FROM c WHERE n <= {most}"""


_BARE_TITLE = _strip(_fold(rf"regexp_replace(title, '^{_S}*(?:\d{{1,2}}(?:\.\d{{1,2}})*|[ivxIVX]{{1,5}})(?:{_S}*[.)\-–]{_S}*|{_S}+)', '')"))
_CONCLUDES = " OR ".join([f"contains({_fold('sentence')}, '{m}')" for m in MARKERS] + [f"{_BARE_TITLE} = '{c}' OR starts_with({_BARE_TITLE}, '{c} ')" for c in CONCLUDING])

def _placed(pages: str, flexible: bool) -> str:
    """Tables of the listed occurrences of all keywords in whole documents: o has the pages, d the texts, s the places.

    Separators are doubled; a place in the doubled text goes back to what it was by counting half of them. Of a keyword
    the first in a document are listed, and one that goes on over a page's end is on the page where it starts.
    """
    back = lambda x: f"(len({x}) - len(regexp_replace({x}, '[{_WORD}]', '', 'g')) // 2)"
    hits = " UNION ALL ".join(
        f"SELECT doc_id, '{k}' AS keyword, regexp_extract_all(doubled, '{p}') AS found, string_split_regex(doubled, '{p}') AS gaps FROM g" for k in KEYWORDS for p in [_pattern(k, flexible)]
    )
    return rf"""
WITH c AS MATERIALIZED ({pages}),
o AS (SELECT doc_id, page, coalesce(sum(len(text) + 2) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a, sum(len(text) + 2) OVER (PARTITION BY doc_id ORDER BY page) AS z FROM c),
w AS (SELECT doc_id, string_agg(text, repeat(chr(10), 2) ORDER BY page) AS whole FROM c GROUP BY doc_id),
d AS MATERIALIZED (SELECT doc_id, {_strip('whole')} AS text, CASE WHEN {_strip('whole')} = '' THEN 0 ELSE len(whole) - len(regexp_replace(whole, '^{_S}+', '')) END AS shift FROM w),
g AS MATERIALIZED (SELECT doc_id, regexp_replace({_fold('text')}, '([^{_WORD}])', '\1\1', 'g') AS doubled FROM d),
m AS ({hits}),
e AS (SELECT doc_id, keyword, len(found) AS total, i, found[i] AS hit, array_to_string(gaps[1:i], '') || array_to_string(found[1:i - 1], '') AS before FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM m)),
b AS (SELECT *, before || regexp_extract(hit, '^[^{_WORD}]?') AS upto, regexp_replace(hit, '^[^{_WORD}]|[^{_WORD}]$', '', 'g') AS body FROM e),
s AS (SELECT doc_id, keyword, total, i, {back('upto')} AS start, {back('upto')} + {back('body')} AS stop FROM b WHERE i <= {LISTED})"""


def _occurrences() -> str:
    return rf"""{_placed(_clean(_TURNS), True)},
l AS (SELECT s.*, text, shift, greatest(0, start - {WINDOW}) AS l, least(len(text), stop + {WINDOW}) AS r FROM s JOIN d USING (doc_id)),
y AS (SELECT *, CASE WHEN l > 0 THEN '...' ELSE '' END || replace(text[l + 1:start], chr(10), ' ') || '**' || replace(text[start + 1:stop], chr(10), ' ') || '**' || replace(text[stop + 1:r], chr(10), ' ') || CASE WHEN r < len(text) THEN '...' ELSE '' END AS around FROM l)
SELECT doc_id, keyword, CAST(total AS INTEGER) AS total, round_even(total * 1000 / greatest(1, {_words('text')}), 2) AS density, CAST(i - 1 AS INTEGER) AS n, coalesce((SELECT min(page) FROM o WHERE o.doc_id = y.doc_id AND greatest(0, a - shift) <= start AND start < greatest(0, z - shift)), (SELECT max(page) FROM o WHERE o.doc_id = y.doc_id)) AS page,
  CAST(NULL AS VARCHAR) AS section, CAST(start AS INTEGER) AS start, CAST(stop AS INTEGER) AS "end", text[start + 1:stop] AS term, {_strip(f"regexp_replace(around, '{_S}{{2,}}', ' ', 'g')")} AS snippet FROM y"""


def _listed_by_page() -> str:
    return rf"""{_placed(_TURNS, False)},
x AS (SELECT s.doc_id, keyword, i, coalesce(min(page) FILTER (greatest(0, a - shift) <= start AND start < greatest(0, z - shift)), max(page)) AS page FROM s JOIN d USING (doc_id) JOIN o USING (doc_id) GROUP BY s.doc_id, keyword, i)
SELECT doc_id, page, CAST(count(*) AS INTEGER) AS n, CAST(max(count(*)) OVER (PARTITION BY doc_id) AS INTEGER) AS most FROM x GROUP BY doc_id, page"""


#: Chunks of 1500 characters with an overlap of 200, one after the other.
_CHUNKS = rf"""
WITH RECURSIVE t AS (SELECT row_number() OVER () AS k, doc_id, {_strip('text')} AS x FROM {_DOCS}),
c AS (
  SELECT k, 0 AS n, CAST(0 AS BIGINT) AS a, CAST(NULL AS BIGINT) AS b FROM t WHERE len(x) > 0
  UNION ALL
  SELECT k, n + 1, e, a2 FROM (SELECT c.k, c.n, CASE WHEN c.b IS NULL THEN c.a ELSE greatest(c.a + 1, c.b - 200) END AS e, t.x FROM c JOIN t USING (k) WHERE c.b IS NULL OR c.b < len(t.x)) AS s, LATERAL (SELECT CASE WHEN s.e + 1500 >= len(s.x) THEN len(s.x) ELSE coalesce(
    (SELECT s.e + 750 + (len(w) - strpos(reverse(w), chr(10) || chr(10)) - 1) FROM (SELECT s.x[s.e + 751:s.e + 1500] AS w) WHERE contains(w, chr(10) || chr(10))),
    (SELECT s.e + 750 + (len(w) - strpos(reverse(w), ' .') - 1) + 1 FROM (SELECT s.x[s.e + 751:s.e + 1500] AS w) WHERE contains(w, '. ')), s.e + 1500) END AS a2) AS z)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY k ORDER BY a) - 1 AS INTEGER) AS index, CAST(a AS INTEGER) AS start, CAST(b AS INTEGER) AS "end", {_strip('x[a + 1:b]')} AS text, CAST(1 AS INTEGER) AS first_page, CAST(1 AS INTEGER) AS last_page, 'p. 1' AS label FROM c JOIN t USING (k) WHERE b IS NOT NULL AND {_strip('x[a + 1:b]')} <> ''"""

_LABEL = "CASE conv_id % 5 WHEN 0 THEN '[p. ' || (turn + 1) || '-' || (turn + 3) || ']' WHEN 1 THEN 'p. ' || turn WHEN 2 THEN '5-5' WHEN 3 THEN '4–2' ELSE 'nao informado' END"
_BODY_CLAIM = "'from ' || source"
#: Words that a line end parts are one.
_JOINED = r"regexp_replace(text, '([\p{L}\p{N}_])-\n([\p{L}\p{N}_])', '\1\2', 'g')"
_LEFT = "((event_id % 5000) * 1.0 * (1 - (event_id % 97) / 97) / ((event_id % 97) / 97))"

_NUMBERED = f"(SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page) AS INTEGER) AS page, text FROM {_TURNS})"
_ITEMS = f"(SELECT doc_id % 7 AS session_id, doc_id, CAST(len({_strip('string_agg(text, repeat(chr(10), 2) ORDER BY page)')}) AS INTEGER) AS n_chars, CAST(count(*) AS INTEGER) AS n_pages FROM {_TURNS} GROUP BY doc_id)"
_REQUESTS = "(SELECT event_id, user_id % 7 + CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END AS session_id, user_id AS doc_id, CAST(event_id % 10 AS INTEGER) AS number FROM events)"

ORACLES: dict[str, str] = {
    "doc_stats": f"SELECT doc_id, n_words, n_chars, {_minutes('n_words')} AS minutes FROM (SELECT doc_id, {_words('text')} AS n_words, CAST(len(text) AS INTEGER) AS n_chars FROM {_DOCS})",
    "scan_total": f"SELECT doc_id, keyword, total, round_even(total * 1000 / greatest(1, w), 2) AS density FROM ({_per_keyword('doc_id, ' + _words('text') + ' AS w', KEYWORDS, True, _DOCS)})",
    "scan_many": f"""
WITH k AS (SELECT DISTINCT keyword, {_fold('keyword')} AS folded FROM (SELECT lower(unnest(regexp_split_to_array(text, '[^\\p{{L}}]+'))) AS keyword FROM benchmark) WHERE length(keyword) > 2),
f AS (SELECT keyword, token FROM (SELECT keyword, folded || unnest(['', 's', 'es', 'is', 'ns', 'ais', 'eis', 'ies', 'ed', 'ing']) AS token FROM k)),
t AS (SELECT doc_id, w, unnest(tokens) AS token FROM (SELECT doc_id, {_words('text')} AS w, regexp_extract_all({_fold('text')}, '[{_WORD}]+') AS tokens FROM {_DOCS}))
SELECT doc_id, keyword, CAST(count(*) AS INTEGER) AS total, round_even(count(*) * 1000 / greatest(1, w), 2) AS density FROM t JOIN f USING (token) GROUP BY doc_id, w, keyword""",
    "scan_exact_vs_flexible": f"SELECT doc_id, keyword, exact, flexible FROM ({_per_keyword('doc_id', ['licens', 'an'], False, _DOCS, 'exact')}) JOIN ({_per_keyword('doc_id', ['licens', 'an'], True, _DOCS, 'flexible')}) USING (doc_id, keyword)",
    "scan_pages": f"SELECT doc_id, keyword, page, CAST(total AS BIGINT) AS n FROM ({_per_keyword('doc_id, page', KEYWORDS, False, _TURNS)}) WHERE total > 0",
    "listed_by_page": _listed_by_page(),
    "keyword_parse": f"""
WITH l AS (SELECT DISTINCT source || ', ' || upper(source) || ';"' || lang || '"' || chr(10) || '''Été'', ete,,' || lang AS raw FROM documents),
p AS (SELECT raw, i, trim(trim({_strip('parts[i]')}, '"'), '''') AS term FROM (SELECT raw, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT raw, string_split_regex(raw, '[,;\\n]+') AS parts FROM l))),
f AS (SELECT raw, i, term FROM p WHERE term <> '' QUALIFY row_number() OVER (PARTITION BY raw, {_fold('term')} ORDER BY i) = 1)
SELECT raw, CAST(row_number() OVER (PARTITION BY raw ORDER BY i) - 1 AS INTEGER) AS position, term AS keyword FROM f""",
    "page_offsets": f"""SELECT doc_id, page, CAST(coalesce(sum(len(text) + 2) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS start, CAST(sum(len(text) + 2) OVER (PARTITION BY doc_id ORDER BY page) AS INTEGER) AS "end" FROM {_TURNS}""",
    "repeated_lines": _repeated(_HEADED),
    "clean_text": _clean(_HEADED),
    "title_inference": f"SELECT doc_id, list_filter(list_transform(string_split(text, chr(10))[1:15], lambda x: {_strip('x')}), lambda x: len(x) BETWEEN 25 AND 200 AND NOT regexp_matches(lower(x), '^(?:doi|http|www)'))[1] AS title FROM {_DOCS}",
    "sections": _sections(),
    "article_metadata": rf"""SELECT doc_id, 'A study of texts from ' || coalesce(source, 'none') || ' written in ' || coalesce(lang, 'none') AS title, 'Maria da Silva' AS authors, nullif(rtrim(regexp_extract(({_cleaned(_JOINED)})[1:6000], '\b10\.\d{{4,9}}/[-._;()/:a-zA-Z0-9]+\b'), '.'), '') AS doi, CAST(3 AS INTEGER) AS n_references, CAST(0 AS INTEGER) AS n_warnings FROM (SELECT doc_id, source, lang FROM documents) JOIN {_ARTICLES} USING (doc_id)""",
    "markdown_blocks": _blocks(_ARTICLES),
    "markdown_sections": _MARKDOWN_SECTIONS,
    "skim_sections": _SKIM_SECTIONS,
    "skim_numbers": _first_sentences(f"regexp_matches(sentence, '{_NUMBER}')", NUMBERS),
    "skim_conclusions": _first_sentences(_CONCLUDES, CONCLUSIONS),
    "scan_occurrences": _occurrences(),
    "chunks": _CHUNKS,
    "deep_reading": f"""
WITH n AS (SELECT doc_id, string_agg('- ' || length(text) || ' characters', chr(10) ORDER BY "index") AS body FROM ({_CHUNKS}) WHERE "index" < 5 GROUP BY doc_id),
s AS (SELECT doc_id, CAST(count(*) FILTER (total > 0) AS INTEGER) AS n_syntheses FROM ({_per_keyword('doc_id', KEYWORDS[:2], True, _DOCS)}) GROUP BY doc_id),
c AS (SELECT doc_id, sha256('### Notas de leitura' || chr(10) || coalesce(body, '')) AS digest FROM documents LEFT JOIN n USING (doc_id))
SELECT doc_id, digest, 'nao informado' AS conclusion, digest AS claim, '2-3' AS page, CAST(2 AS INTEGER) AS n_findings, digest AS limitations, left(digest, 8) || ',k' AS terms, n_syntheses, CAST(0 AS INTEGER) AS n_errors FROM c JOIN s USING (doc_id)""",
    "report_lines": f"""
WITH r AS {_RESULTS}, f AS (SELECT file, (row_number() OVER (ORDER BY file) - 1) // 8 AS tile FROM (SELECT DISTINCT file FROM r))
SELECT '| ' || keyword || ' | ' || string_agg(CAST(total AS VARCHAR), ' | ' ORDER BY file) || ' |' AS line FROM r JOIN f USING (file) GROUP BY keyword, tile
UNION ALL SELECT '| keyword | ' || string_agg(file, ' | ' ORDER BY file) || ' |' || chr(10) || '|' || repeat('---|', CAST(count(*) AS INTEGER) + 1) FROM f GROUP BY tile
UNION ALL SELECT '- **' || keyword || '**: nao aparece em ' || string_agg(file, ', ' ORDER BY file) FROM r WHERE total = 0 GROUP BY keyword""",
    "sentences": f"SELECT doc_id, CAST(i - 1 AS INTEGER) AS n, s[i] AS sentence, regexp_matches(s[i], '{_NUMBER}') AS numbered FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, list_filter(list_transform({_CUT}, lambda y: trim(y)), lambda y: y <> '') AS s FROM (SELECT doc_id, {_SQUEEZED} AS x FROM {_DOCS})))",
    "triage": f"""
WITH u AS (SELECT source AS session_id, doc_id AS arrival, sha256(text) AS content_sha256 FROM {_DOCS}),
g AS (SELECT session_id, content_sha256, min(arrival) AS seat FROM u GROUP BY session_id, content_sha256),
f AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seat) AS place FROM g)
SELECT session_id, arrival, content_sha256, CASE WHEN place <= 25 AND arrival = seat THEN 'accepted' ELSE 'refused' END AS status, CASE WHEN place <= 25 AND arrival > seat THEN 'already in the batch (same content)' WHEN place > 25 THEN 'limit of 25 files per session reached' END AS reason FROM u JOIN f USING (session_id, content_sha256)""",
    "free_seats": f"SELECT source AS session_id, CAST(greatest(0, 40 - count(*)) AS INTEGER) AS seats FROM {_DOCS} GROUP BY source",
    "comparison_pivot": f"""
WITH r AS {_RESULTS}, f AS (SELECT file, row_number() OVER (ORDER BY file) - 1 AS nth FROM (SELECT DISTINCT file FROM r))
SELECT keyword, CAST(nth // 8 AS INTEGER) AS tile, string_agg(file, '|' ORDER BY file) AS files, string_agg(CAST(total AS VARCHAR), '|' ORDER BY file) AS totals FROM r JOIN f USING (file) GROUP BY keyword, nth // 8""",
    "absent_keywords": f"SELECT keyword, string_agg(file, ',' ORDER BY file) AS files FROM {_RESULTS} WHERE total = 0 GROUP BY keyword",
    "batch_overview": f"""
WITH c AS (SELECT doc_id, count(*) AS n, count(*) FILTER (total > 0) AS f FROM ({_per_keyword('doc_id', KEYWORDS, False, _DOCS)}) GROUP BY doc_id),
l AS (SELECT DISTINCT doc_id, 1 AS done FROM labels)
SELECT doc_id AS item, 'doc' || doc_id AS file, left(CASE WHEN doc_id % 2 = 0 AND text <> '' THEN left(text, 90) ELSE 'doc' || doc_id END, 70) AS title, CAST(1 AS INTEGER) AS pages, {_words('text')} AS words, {_minutes(_words('text'))} AS minutes, CASE WHEN done = 1 THEN 'sim' ELSE 'nao' END AS analysed, CASE WHEN n > 0 THEN f || '/' || n ELSE '—' END AS keywords_found FROM {_DOCS} LEFT JOIN c USING (doc_id) LEFT JOIN l USING (doc_id)""",
    "pending": "SELECT doc_id AS item FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)",
    "page_labels": f"""
WITH r AS (SELECT conv_id, turn, {_LABEL} AS raw FROM conversations), g AS (SELECT *, regexp_extract(raw, '(\\d{{1,4}})(?:\\s*[-–]\\s*(\\d{{1,4}}))?', 1) AS a, regexp_extract(raw, '(\\d{{1,4}})(?:\\s*[-–]\\s*(\\d{{1,4}}))?', 2) AS b FROM r)
SELECT conv_id, turn, CASE WHEN b <> '' AND b <> a THEN a || '-' || b ELSE a END AS label, CASE WHEN a <> '' THEN array_to_string(range(least(CAST(a AS INT), CAST(CASE WHEN b = '' THEN a ELSE b END AS INT)), greatest(CAST(a AS INT), CAST(CASE WHEN b = '' THEN a ELSE b END AS INT)) + 1), ',') END AS pages FROM g""",
    "lenient_json": f"SELECT doc_id, CAST(CASE WHEN doc_id % 4 = 3 THEN 0 ELSE 2 END AS INTEGER) AS n, CASE WHEN doc_id % 4 <> 3 THEN {_BODY_CLAIM} END AS claim, CASE WHEN doc_id % 4 <> 3 THEN CAST(doc_id % 9 + 1 AS VARCHAR) END AS page FROM documents",
    "term_marks": f"SELECT doc_id, page, target, CAST(n AS INTEGER) AS n, CAST(1 AS INTEGER) AS n_rects, CAST(43 + 50 * (idx % 8) AS DOUBLE) AS x0, CAST(5000 - (42 + 14 * (idx // 8)) + 7 AS DOUBLE) AS y0, CAST(91 + 50 * (idx % 8) AS DOUBLE) AS x1, CAST(5000 - (30 + 14 * (idx // 8)) + 7 AS DOUBLE) AS y1 FROM {_MARKS}",
    "pdf_pages": "SELECT conv_id AS doc_id, CAST(turn + 1 AS INTEGER) AS page, trim(regexp_replace(regexp_replace(coalesce(text, ''), '[ ]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g')) AS text, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\n]+'), lambda x: x <> '')) AS INTEGER) AS n_words, CASE WHEN turn = 0 THEN 'Conversa ' || conv_id END AS title, false AS faulty FROM conversations",
    "pdf_annotations": f"SELECT doc_id, page, 'Keyword: ' || target AS comment, 'ffe066' AS colour, count(*) AS n, CAST(1 AS INTEGER) AS boxes FROM {_MARKS} GROUP BY doc_id, page, target",
    "marks_by_category": f"SELECT doc_id, 'keyword' AS category, CAST(count(*) AS INTEGER) AS n FROM {_MARKS} GROUP BY doc_id",
    "remaining_time": f"""SELECT event_id, round(l, 6) AS "left", CASE WHEN l < 60 THEN 'menos de 1 min' WHEN round(l / 60) < 60 THEN '~' || CAST(round(l / 60) AS BIGINT) || ' min' ELSE '~' || CAST(floor(round(l / 60) / 60) AS BIGINT) || ' h ' || CAST(round(l / 60) % 60 AS BIGINT) || ' min' END AS label FROM (SELECT event_id, CASE WHEN event_id % 97 > 0 AND event_id % 5000 > 0 THEN {_LEFT} END AS l FROM events) WHERE l IS NOT NULL UNION ALL SELECT event_id, NULL, NULL FROM events WHERE event_id % 97 = 0 OR event_id % 5000 = 0""",
    "page_lookup": f"SELECT event_id, CASE WHEN t.page IS NULL THEN 404 ELSE 200 END AS status, CASE WHEN i.doc_id IS NULL THEN 'artigo nao encontrado nesta sessao' WHEN t.page IS NULL THEN 'pagina fora do intervalo' END AS error, t.text AS page_text FROM {_REQUESTS} r LEFT JOIN {_ITEMS} i USING (session_id, doc_id) LEFT JOIN {_NUMBERED} t ON t.doc_id = i.doc_id AND t.page = r.number",
    "item_lookup": f"SELECT event_id, CASE WHEN i.doc_id IS NULL THEN 404 ELSE 200 END AS status, CASE WHEN i.doc_id IS NULL THEN 'artigo nao encontrado nesta sessao' END AS error, i.n_chars, i.n_pages FROM {_REQUESTS} r LEFT JOIN {_ITEMS} i USING (session_id, doc_id)",
    "item_listing": f'SELECT session_id, doc_id, CAST(greatest(0, 20 - count(*) OVER (PARTITION BY session_id)) AS INTEGER) AS seats, CAST(20 AS INTEGER) AS "limit" FROM {_ITEMS}',
    "item_removal": f"""
WITH q AS (SELECT * FROM {_REQUESTS} JOIN events USING (event_id) WHERE event_type = 'error'), s AS (SELECT i.session_id, count(*) AS n FROM {_ITEMS} i WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.session_id = i.session_id AND q.doc_id = i.doc_id) GROUP BY i.session_id)
SELECT event_id, CASE WHEN i.doc_id IS NULL THEN 404 ELSE 200 END AS status, CAST(greatest(0, 20 - coalesce(n, 0)) AS INTEGER) AS seats FROM (SELECT event_id, session_id, doc_id FROM q) q LEFT JOIN {_ITEMS} i USING (session_id, doc_id) LEFT JOIN s USING (session_id)""",
    "items_cleared": f"SELECT session_id, doc_id FROM {_ITEMS} WHERE session_id NOT IN (SELECT user_id % 7 FROM events GROUP BY user_id % 7 HAVING arg_max(event_type, event_id) <> 'click')",
    "keyword_chips": f"SELECT doc_id, CAST(len(c) AS INTEGER) AS n, sha256(array_to_string(list_filter(c, lambda t: t <> source), ', ')) AS others FROM (SELECT doc_id, source, list_filter(list_transform(string_split_regex(concat_ws(',', source, ' ', upper(lang), source, text), '[,;\\n]+'), lambda x: {_strip('x')}), lambda x: x <> '') AS c FROM documents)",
    "analysis_events": f"""
WITH d AS (SELECT coalesce(source, '{NO_SOURCE}') AS session_id, CAST(doc_id + 1 AS INTEGER) AS position, doc_id, 'doc' || doc_id AS name, CAST(count(*) OVER (PARTITION BY source) AS INTEGER) AS total FROM documents),
e AS (SELECT d.*, l.doc_id IS NOT NULL AS over, coalesce(l.quality = 0, false) AS failed FROM d LEFT JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY doc_id) l USING (doc_id)),
s AS (SELECT * FROM (VALUES (1, 'summary', 0.45), (2, 'findings', 0.6333), (3, 'synthesis 1/2', 0.9083), (4, 'synthesis 2/2', 1.0)) v(step, stage, share))
SELECT session_id, position, CAST(0 AS INTEGER) AS step, 'artigo_inicio' AS kind, doc_id, name, total, CAST(NULL AS VARCHAR) AS stage, CAST(NULL AS DOUBLE) AS share, CAST(NULL AS VARCHAR) AS message FROM e
UNION ALL SELECT session_id, position, CAST(step AS INTEGER), 'progresso', doc_id, name, total, stage, CAST(share AS DOUBLE), NULL FROM e, s WHERE over AND NOT failed
UNION ALL SELECT session_id, position, CAST(5 AS INTEGER), CASE WHEN failed THEN 'artigo_erro' ELSE 'artigo_fim' END, doc_id, name, total, NULL, NULL, CASE WHEN failed THEN 'no answer' END FROM e WHERE over
UNION ALL SELECT session_id, CAST(0 AS INTEGER), CAST(0 AS INTEGER), 'inicio', NULL, NULL, total, NULL, NULL, NULL FROM e GROUP BY session_id, total
UNION ALL SELECT session_id, CAST(max(position) + 1 AS INTEGER), CAST(0 AS INTEGER), 'fim', NULL, NULL, total, NULL, NULL, count(*) FILTER (NOT failed) || '; ' || coalesce(string_agg(CASE WHEN failed THEN name END, ', ' ORDER BY position), '') FROM e GROUP BY session_id, total HAVING bool_and(over)""",
    "batch_time": """
WITH r AS (SELECT event_id, CAST(event_id % 400 AS DOUBLE) AS elapsed, (event_id % 53) / 53 AS done, event_id % 4 AS later, event_id % 3 AS n, value FROM events),
m AS (SELECT *, CASE WHEN done > 0 AND elapsed > 0 THEN elapsed * (1 - done) / done END AS own, CASE n WHEN 1 THEN value WHEN 2 THEN value * 1.5 ELSE CASE WHEN elapsed >= 10 AND done >= 0.08 THEN elapsed / done END END AS mean FROM r)
SELECT event_id, round(coalesce(own, mean) + coalesce(mean, 0) * later, 6) AS seconds FROM m""",
}
