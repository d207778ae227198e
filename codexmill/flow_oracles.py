"""DuckDB SQL of the queries of whole flows."""

from __future__ import annotations

from .flows import EXPECTED, TITLES
from .functions.references import HINT_TERMS
from .operators.chunking import TITLE_TOKENS
from .operators.evaluation import ALIASES
from .operators.history import KNOWN_NAMES, SOURCE_FIELDS
from .queries import FILES
from .oracles import _BLANK, _CAND, _COS, _FOLD, _NORM, _STEM, _TAGGED, GOLDEN_ORACLES, ORACLES, _case, _has, _long, _NAMED, _pack, _refs, _values

#: The same SQL as for given names, over a name made of each document's source.
_FILE_NAMES = f"(SELECT *, {_STEM} AS stem, {_FOLD.format(_STEM)} AS f FROM (SELECT doc_id AS id, v.stem || ' ' || source || '.html' AS name FROM documents JOIN {_values([(i, x.rpartition('.')[0]) for i, x in FILES], 'i, stem')} AS v ON v.i = doc_id % {len(FILES)}))"
_LINES = f"""lines AS (SELECT doc_id, source, doc_id // 500 AS k, CASE WHEN doc_id % 5 <> 0 THEN nullif(trim(text, {_BLANK}), '') END AS content, CASE WHEN doc_id % 3 = 1 THEN 'T' || doc_id END AS title FROM documents)"""

_WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"


def _cover(source: str) -> str:
    """CTEs from hits (query_id, id, n_terms, pos, term, w): a shortest cover ends at the first
    hit by which the oldest of the terms' last places has become its start."""
    return f"""latest AS (SELECT r.query_id, r.id, r.pos AS ends, h.term, max(h.pos) AS p, any_value(r.n_terms) AS n FROM {source} r JOIN {source} h ON h.query_id = r.query_id AND h.id = r.id AND h.pos <= r.pos GROUP BY 1, 2, 3, 4),
        begun AS (SELECT query_id, id, ends, min(p) AS begins FROM latest GROUP BY 1, 2, 3 HAVING count(*) = any_value(n)),
        covers AS (SELECT query_id, id, begins, min(ends) AS ends FROM begun GROUP BY 1, 2, 3),
        weighed AS (SELECT c.query_id, c.id, c.begins, c.ends, count(*) AS n, sum(1 / h.w) AS s FROM covers c JOIN {source} h ON h.query_id = c.query_id AND h.id = c.id AND h.pos BETWEEN c.begins AND c.ends GROUP BY 1, 2, 3, 4),
        ranked AS (SELECT query_id, id, sum(n / s / (1 + greatest(0, ends - begins - (n - 1)))) AS total FROM weighed GROUP BY 1, 2)"""


_PLACED = """placed AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS pos, unnest(ws) AS term, n_source FROM (
        SELECT doc_id, regexp_extract_all(lower(source), '[\\p{L}\\p{N}]+') || regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') AS ws, len(regexp_extract_all(lower(source), '[\\p{L}\\p{N}]+')) AS n_source FROM documents)),
    weights AS (SELECT doc_id, pos, term, CASE WHEN pos <= n_source THEN 1.0::DOUBLE ELSE 0.1::DOUBLE END AS w FROM placed)"""

_KEYED = f"""{_TAGGED}, {_PLACED},
    q AS (SELECT e.vec_id AS query_id, list_distinct(list_filter([ws[1], ws[5]], lambda x: x IS NOT NULL)) AS ts FROM embeddings e JOIN (SELECT doc_id, {_WORDS} AS ws FROM documents) d ON d.doc_id = e.vec_id WHERE e.vec_id % 100 = 0),
    qt AS (SELECT query_id, len(ts) AS n_terms, unnest(ts) AS term FROM q),
    hits AS (SELECT qt.query_id, w.doc_id AS id, n_terms, pos, w.term, w FROM qt JOIN weights w ON w.term = qt.term JOIN embeddings e ON e.vec_id = w.doc_id),
    {_cover('hits')}, keyword AS (SELECT query_id, id AS chunk_id, total / (total + 1) AS score FROM ranked),
    best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM keyword)"""


def _identity(x: str) -> str:
    return f"regexp_replace({_FOLD.format(x)}, '[^a-zа-я0-9]+', '', 'g')"


def _plain(x: str) -> str:
    return "".join(c for c in x.lower().replace("ё", "е") if c in "abcdefghijklmnopqrstuvwxyzабвгдежзийклмнопрстуфхцчшщъыьэюя0123456789")


def _alias_key(v: str, aliases: dict[str, tuple[str, ...]]) -> str:
    """Law of a normalised value, by the rule of starts, contains or lies in."""
    rules = []
    for law, names in aliases.items():
        hit = " OR ".join([f"starts_with({v}, '{_plain(law)}')", *(f"contains({v}, '{_plain(n)}') OR contains('{_plain(n)}', {v})" for n in names)])
        rules.append((f"{v} <> '' AND ({hit})", f"'{law}'"))
    return _case(rules, "NULL")


def _names(law: str, own: str, aliases: dict[str, tuple[str, ...]]) -> str:
    known = _case([(f"{law} = '{k}'", "[" + ", ".join(f"'{_plain(n)}'" for n in ns) + "]") for k, ns in aliases.items()], f"CASE WHEN {own} <> '' THEN [{own}] ELSE [] END")
    return known


def _list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_N = len(TITLES)
_NUM = "((c + {}) % 5) || '.2'"
_JUDGED = f"""res AS (SELECT doc_id - doc_id % 100 AS case_id, doc_id % 100 AS rank, (doc_id % 5) || '.2' AS number, list_filter([{_identity(f"({_list(TITLES)})[doc_id % {_N} + 1]")}, CASE WHEN doc_id % 4 = 0 THEN {_identity("source || '.txt'")} END], lambda x: x <> '') AS own FROM documents WHERE doc_id % 100 BETWEEN 1 AND 20),
    cs AS (SELECT doc_id AS id, doc_id // 100 AS c, CASE WHEN doc_id // 100 % 4 = 3 THEN '' ELSE ({_list(EXPECTED)})[doc_id // 100 % {_N} + 1] END AS doc, ({_list(TITLES)})[doc_id // 100 % {_N} + 1] AS title FROM documents WHERE doc_id % 100 = 0),
    src AS (SELECT id, doc, title, unnest(CASE WHEN c % 3 <> 1 THEN [{{'d': ({_list(EXPECTED)})[c % {_N} + 1], 'a': {_NUM.format(0)}, 'r': 'primary'}}, {{'d': ({_list(EXPECTED)})[(c + 1) % {_N} + 1], 'a': {_NUM.format(1)}, 'r': 'acceptable'}}, {{'d': ({_list(EXPECTED)})[(c + 2) % {_N} + 1], 'a': {_NUM.format(2)}, 'r': 'secondary'}}]
            ELSE [{{'d': doc, 'a': {_NUM.format(0)}, 'r': 'primary'}}, {{'d': doc, 'a': {_NUM.format(2)}, 'r': 'primary'}}] END) AS s, c % 3 <> 1 AS modern FROM cs),
    good AS (SELECT id, s.a AS number, s.r AS rel, {_identity("CASE WHEN s.d <> '' THEN s.d ELSE coalesce(nullif(doc, ''), '') END")} AS v, {_identity("coalesce(title, '')")} AS t, s.d AS d FROM src WHERE NOT modern OR s.d <> ''),
    lawful AS (SELECT *, CASE WHEN v <> '' THEN v ELSE t END AS own FROM good), keyed AS (SELECT *, {_alias_key('own', ALIASES)} AS law FROM lawful),
    named AS (SELECT id, number, rel, {_names('law', 'own', ALIASES)} AS names FROM keyed),
    pairs AS (SELECT r.case_id, r.rank, r.number = n.number AS same, n.rel, n.id IS NOT NULL AND (len(n.names) = 0 OR len(list_filter(n.names, lambda a: len(list_filter(r.own, lambda o: contains(o, a) OR contains(a, o))) > 0)) > 0) AS doc
              FROM res r LEFT JOIN named n ON n.id = r.case_id),
    judged AS (SELECT case_id, rank, CASE min(CASE WHEN same AND doc THEN CASE rel WHEN 'primary' THEN 1 WHEN 'secondary' THEN 2 ELSE 3 END END) WHEN 1 THEN 'primary' WHEN 2 THEN 'secondary' WHEN 3 THEN 'acceptable' END AS relevance,
              coalesce(bool_or(doc AND rel IN ('primary', 'secondary')), FALSE) AS expected_document FROM pairs GROUP BY 1, 2)"""

_HEAD = r"(?i)^[ \t]*Статья[ \t]+(\d+(?:\.\d+)*)(?:\.[ \t]*([^\n]*))?[ \t]*$"
_PARTED = r"(?i)^(?:ЧАСТЬ|РАЗДЕЛ|ГЛАВА)(?:[^\p{L}\p{N}_]|$)"
_FOLDED = r"trim(regexp_replace({}, '[\s\x0B\x{{85}}\x{{a0}}]+', ' ', 'g'), ' ')"


def _is_head(x: str) -> str:
    return f"(regexp_matches({x}, '{_HEAD}') OR regexp_matches({x}, '{_PARTED}'))"


def _continues(before: str, after: str) -> str:
    token = f"list_extract(string_split(lower(regexp_replace({before}, '[ -]+$', '')), ' '), -1) IN ({', '.join(repr(t) for t in TITLE_TOKENS)})"
    wraps = f"(length({before}) >= 60 OR suffix({before}, '-') OR {token})"
    lower = f"regexp_matches({after}, '^\\P{{L}}*\\p{{Ll}}')"
    return f"({after} <> '' AND NOT {_is_head(after)} AND NOT regexp_matches({after}, '[.:;]$') AND {wraps} AND ({lower} OR {token}))"


def _title(inline: str, first: str, second: str) -> str:
    starts = f"({first} <> '' AND NOT {_is_head(first)} AND NOT regexp_matches({first}, '[.:;]$'))"
    one = f"(CASE WHEN {inline} <> '' THEN {_continues(inline, first)} ELSE {starts} END)"
    return f"nullif(concat_ws(' ', nullif({inline}, ''), CASE WHEN {one} THEN {first} END, CASE WHEN {one} AND {_continues(first, second)} THEN {second} END), '')"


_LEGAL = """SELECT doc_id, array_to_string(list_transform(ls, lambda x, k: CASE (k - 1) % 11 WHEN 2 THEN 'Статья ' || k || '. ' || substr(x, 1, 65) WHEN 3 THEN lower(substr(x, 2, 20)) WHEN 5 THEN chr(10) || x || chr(10) WHEN 6 THEN 'ГЛАВА ' || k
    WHEN 8 THEN '  статья  ' || k || '.1' WHEN 9 THEN 'Название ' || regexp_replace(substr(x, 1, 30), '[.:;]', '', 'g') ELSE x END), chr(10)) AS text FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)"""

_HIT = lambda words, x: _has(x, tuple(w.replace("ё", "е") for w in words))
_ASKED = "CASE doc_id % 3 WHEN 0 THEN 'Что говорит ст. ' WHEN 1 THEN 'Какова СТАТЬЯ ' ELSE 'О налоге и браке ' END || (doc_id % 200) || CASE WHEN doc_id % 4 = 0 THEN '.1 о договоре?' ELSE '?' END"
_PART_ALIASES = {"steel": ("steel", "large steel"), "tin": ("tin", "small tin", "economy tin"), "nickel": ("nickel",)}
_FIRST = _FOLDED.format("substr(coalesce(ls[1], ''), 1, 70)")
_SECOND = _FOLDED.format("substr(coalesce(ls[2], ''), 1, 70)")
_SHOWN = "regexp_replace(regexp_replace(printf('%.4f', p_retailprice / 8), '(\\.\\d*?)0+$', '\\1'), '\\.$', '')"
_FILE = "lower(CASE p_size % 5 WHEN 0 THEN 'old_TRUD_' WHEN 1 THEN 'gk_rf_' ELSE 'x_' END || p_brand)"

FLOW_ORACLES = {
    "hybrid_keyword": f"""WITH {_KEYED},
        sem AS (SELECT query_id, chunk_id FROM (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS}, c.vec_id) AS r FROM tagged c, tagged q WHERE q.vec_id % 100 = 0) WHERE r <= 100),
        cand AS (SELECT * FROM sem UNION SELECT query_id, chunk_id FROM best WHERE r <= 100 UNION SELECT q.vec_id, c.vec_id FROM tagged c JOIN tagged q ON c.vec_id // 10 = q.vec_id // 10 WHERE q.vec_id % 100 = 0),
        s AS (SELECT x.query_id, x.chunk_id, 1 - ({_COS}) AS sem, coalesce(k.score, 0) AS key, CASE WHEN c.vec_id // 10 = q.vec_id // 10 THEN 0.65::DOUBLE ELSE 0 END AS art, CASE WHEN lower(c.names) LIKE '%' || q.lang || '%' THEN 0.35::DOUBLE ELSE 0 END AS doc
              FROM cand x JOIN tagged c ON c.vec_id = x.chunk_id JOIN tagged q ON q.vec_id = x.query_id LEFT JOIN keyword k ON k.query_id = x.query_id AND k.chunk_id = x.chunk_id),
        h AS (SELECT *, 0.6::DOUBLE * sem + 0.3::DOUBLE * key + 0.1::DOUBLE * least(1.0::DOUBLE, art + doc) AS score FROM s),
        o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM h)
        SELECT query_id, chunk_id, round(sem, 6) AS semantic_score, round(key, 6) AS keyword_score, art AS article_boost, doc AS document_boost, round(score, 6) AS hybrid_score, rank FROM o WHERE rank <= 10""",
    "keyword_candidates": f"WITH {_KEYED} SELECT query_id, chunk_id, round(score, 6) AS keyword_score FROM best WHERE r <= 50",
    "keyword_rank_cover_density": f"""WITH {_PLACED}, q AS (SELECT item_id AS query_id, list_distinct({_WORDS}) AS ts FROM benchmark), qt AS (SELECT query_id, len(ts) AS n_terms, unnest(ts) AS term FROM q),
        d AS (SELECT doc_id, list_distinct({_WORDS}) AS ws FROM documents), m AS (SELECT query_id, doc_id FROM d, q WHERE len(ts) > 0 AND len(list_intersect(ts, ws)) = len(ts)),
        hits AS (SELECT m.query_id, m.doc_id AS id, n_terms, pos, w.term, w FROM m JOIN qt ON qt.query_id = m.query_id JOIN weights w ON w.doc_id = m.doc_id AND w.term = qt.term), {_cover('hits')},
        o AS (SELECT query_id, id, total / (total + 1) AS score, row_number() OVER (PARTITION BY query_id ORDER BY total / (total + 1) DESC, id) AS r FROM ranked)
        SELECT query_id, id AS doc_id, round(score, 6) AS keyword_score FROM o WHERE r <= 50""",
    "metadata_of_documents": GOLDEN_ORACLES["infer_metadata"].replace(_NAMED, _FILE_NAMES),
    "history_saved_by_stream": ORACLES["history_last_per_conversation"],
    "jsonl_numbered": f"""WITH {_LINES}, c AS (SELECT *, CASE WHEN doc_id % 7 = 3 THEN 'invalid' WHEN doc_id % 7 = 5 THEN 'not_object' WHEN content IS NULL THEN 'empty_text' ELSE 'ok' END AS class FROM lines)
        SELECT doc_id, class, CASE WHEN class IN ('ok', 'empty_text') THEN title END AS document_title, CASE WHEN class = 'ok' THEN md5(content) END AS content_md5, TRUE AS numbered FROM c""",
    "ingested_files": f"""WITH {_LINES}, n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id) AS n FROM lines)
        SELECT 'f' || k || '.jsonl' AS filename, coalesce(min_by(title, doc_id) FILTER (WHERE title IS NOT NULL), 'f' || k) AS title, count(content) AS chunks_count, md5(string_agg(md5(content), '' ORDER BY doc_id) FILTER (WHERE content IS NOT NULL)) AS contents_md5,
               nullif(count(*) - count(content), 0) AS skipped, min(n) FILTER (WHERE content IS NULL) AS first_skipped FROM n GROUP BY k HAVING count(content) > 0""",
    "stored_lexemes": r"""WITH p AS (SELECT doc_id, 'f' || doc_id || ' ' || source AS names, regexp_extract_all(lower(source), '[\p{L}\p{N}]+') AS a, regexp_extract_all(lower(lang), '[\p{L}\p{N}]+') AS b, regexp_extract_all(lower(substr(coalesce(text, ''), 1, 300)), '[\p{L}\p{N}]+') AS c FROM documents)
        SELECT doc_id AS document_id, names, CAST(len(a) + len(b) + len(c) AS BIGINT) AS lexemes, CAST(len(a) + len(b) + len(c) AS BIGINT) AS last_pos, round(1.0::DOUBLE * len(a) + 0.4::DOUBLE * len(b) + 0.1::DOUBLE * len(c), 4) AS weight, list_min(a || b || c) AS first_lexeme FROM p""",
    "legal_chunks": f"""WITH RECURSIVE norm AS (SELECT doc_id, string_split(trim({_NORM}, {_BLANK}), chr(10)) AS ls FROM ({_LEGAL})),
        line AS (SELECT doc_id, unnest(range(0, len(ls))) AS i, unnest(ls) AS x FROM norm),
        marked AS (SELECT *, sum(CASE WHEN regexp_matches(x, '{_HEAD}') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS b FROM line),
        blocks AS (SELECT doc_id, b, list(x ORDER BY i) AS xs, trim(string_agg(x, chr(10) ORDER BY i), {_BLANK}) AS content FROM marked GROUP BY 1, 2),
        heads AS (SELECT *, {_FOLDED.format(f"regexp_extract(xs[1], '{_HEAD}', 2)")} AS inl, {_FOLDED.format("coalesce(xs[2], '')")} AS one, {_FOLDED.format("coalesce(xs[3], '')")} AS two FROM blocks),
        titled AS (SELECT doc_id, b, content, CASE WHEN b > 0 THEN regexp_extract(xs[1], '{_HEAD}', 1) END AS number, CASE WHEN b > 0 THEN {_title('inl', 'one', 'two')} END AS title,
                   list_filter(list_transform(string_split(content, chr(10) || chr(10)), lambda p: trim(p, {_BLANK})), lambda p: p <> '') AS ps FROM heads WHERE content <> ''),
        merged AS (SELECT doc_id, b, number, title, CASE WHEN b > 0 AND len(ps) >= 2 THEN array_to_string([trim(ps[1] || chr(10) || ps[2], {_BLANK})] || ps[3:], chr(10) || chr(10)) ELSE content END AS text FROM titled),
        para AS (SELECT doc_id * 100000 + b AS doc_id, unnest(range(0, len(ps))) AS k, unnest(ps) AS body FROM (SELECT doc_id, b, list_filter(list_transform(string_split(trim({_NORM}, {_BLANK}), chr(10) || chr(10)), lambda p: trim(p, {_BLANK})), lambda p: p <> '') AS ps FROM merged WHERE b = 0 OR length(text) > 1200)),
        {_long('(SELECT * FROM para WHERE length(body) > 1200)')},
        pieces AS (SELECT doc_id, k, 0 AS n, body FROM para WHERE length(body) <= 1200 UNION ALL SELECT doc_id, k, n, trim(piece, {_BLANK}) FROM cutting WHERE n > 0 AND trim(piece, {_BLANK}) <> ''),
        lists AS (SELECT doc_id, list(body ORDER BY k, n) AS ps FROM pieces GROUP BY doc_id), packed AS (SELECT doc_id, {_pack('ps')} AS cs FROM lists),
        chunks AS (SELECT m.doc_id, m.b, number, title, unnest(range(0, len(coalesce(cs, [text])))) AS j, unnest(coalesce(cs, [text])) AS content FROM merged m LEFT JOIN packed p ON p.doc_id = m.doc_id * 100000 + m.b)
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY b, j) - 1 AS chunk_index, number AS article_number, title AS article_title, CAST(length(content) AS BIGINT) AS length, md5(content) AS content_md5 FROM chunks""",
    "legal_records": f"""WITH l AS (SELECT doc_id AS doc, unnest(range(0, len(ls))) AS n, unnest(ls) AS x FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
        v AS (SELECT doc, n, CASE n % 13 WHEN 1 THEN 'Раздел ' || n WHEN 2 THEN 'ГЛАВА ' || n || '. C' WHEN 3 THEN 'Статья ' || n || '. ' || substr(x, 1, 20) WHEN 9 THEN 'Статья ' || n || '. ' || substr(x, 1, 20) WHEN 4 THEN x || ' в статье ' || n || ' и статьях 7, 3.2'
              WHEN 6 THEN 'Подраздел ' || n WHEN 7 THEN '§ ' || n WHEN 11 THEN 'статья ' || n || '.1' ELSE 'x ' || x END AS line FROM l),
        k AS (SELECT *, CASE n % 13 WHEN 1 THEN 1 WHEN 6 THEN 2 WHEN 2 THEN 3 WHEN 7 THEN 4 WHEN 3 THEN 5 WHEN 9 THEN 5 WHEN 11 THEN 5 END AS kind FROM v),
        w AS (SELECT *, max(CASE WHEN kind = 1 THEN n END) OVER o AS s, max(CASE WHEN kind = 2 THEN n END) OVER o AS u, max(CASE WHEN kind = 3 THEN n END) OVER o AS c, max(CASE WHEN kind = 4 THEN n END) OVER o AS p, max(CASE WHEN kind IS NOT NULL THEN n END) OVER o AS head
              FROM k WINDOW o AS (PARTITION BY doc ORDER BY n ROWS UNBOUNDED PRECEDING)),
        t AS (SELECT doc, head, string_agg(line, chr(10) ORDER BY n) FILTER (WHERE n > head) AS body FROM w GROUP BY 1, 2),
        r AS (SELECT w.doc, w.n, s, CASE WHEN u > coalesce(s, -1) THEN u END AS u, CASE WHEN c > greatest(coalesce(s, -1), coalesce(u, -1)) THEN c END AS c, CASE WHEN p > greatest(coalesce(s, -1), coalesce(u, -1), coalesce(c, -1)) THEN p END AS p,
              regexp_extract(line, '(?i)^Статья\\s+(\\d+(?:\\.\\d+)*)', 1) AS article_number, nullif(trim(regexp_extract(line, '(?i)^Статья\\s+\\d+(?:\\.\\d+)*(?:[.\\s]+(.*))?$', 1), {_BLANK}), '') AS article_title,
              line || coalesce(chr(10) || chr(10) || body, '') AS text FROM w JOIN t ON t.doc = w.doc AND t.head = w.n WHERE kind = 5)
        SELECT r.doc, r.n, a.line AS section_title, b.line AS subsection_title, d.line AS chapter_title, e.line AS paragraph_title, article_number, article_title, md5(text) AS text_md5, {_refs('text', 'article_number')} AS refs
        FROM r LEFT JOIN v a ON a.doc = r.doc AND a.n = s LEFT JOIN v b ON b.doc = r.doc AND b.n = u LEFT JOIN v d ON d.doc = r.doc AND d.n = c LEFT JOIN v e ON e.doc = r.doc AND e.n = p""",
    "references_of_documents": rf"""WITH t AS (SELECT doc_id, 'См. статьи ' || (doc_id % 90 + 1) || ', ' || (doc_id % 7 + 1) || '.3 и ' || (doc_id % 13 + 1) || '; статьей ' || (doc_id % 31) || ' — ' || source AS said, {_ASKED} AS asked FROM documents),
        f AS (SELECT *, regexp_replace({_FOLD.format('asked')}, '\s+', ' ', 'g') AS low FROM t)
        SELECT doc_id, {_refs('said', 'CAST(doc_id % 90 + 1 AS VARCHAR)')} AS refs, nullif(regexp_extract(asked, '(?i)(?:^|[^\p{{L}}\p{{N}}_])ст(?:атья|атье|атьи|атью)?\.?\s*(\d+(?:\.\d+)*)', 1), '') AS article_number,
        {_case([(_HIT(words, 'low'), f"'{law}'") for law, words in HINT_TERMS.items()], 'NULL')} AS law, TRUE AS tax, FALSE AS civil FROM f""",
    "judge_relevance": f"WITH {_JUDGED} SELECT CAST(case_id AS VARCHAR) AS case_id, rank, relevance, expected_document FROM judged",
    "judged_metrics": f"""WITH {_JUDGED}, p AS (SELECT case_id, min(rank) FILTER (WHERE relevance IN ('primary', 'secondary')) AS found, min(rank) FILTER (WHERE relevance = 'acceptable') AS accepted, bool_or(expected_document) FILTER (WHERE rank = 1) AS doc1, bool_or(expected_document) FILTER (WHERE rank <= 5) AS doc5 FROM judged GROUP BY 1),
        m AS (SELECT cs.id, c % 9 = 8 AS outside, c, p.* FROM cs LEFT JOIN p ON p.case_id = cs.id)
        SELECT CAST(id AS VARCHAR) AS id, 'L' || (c % 3) AS law, outside AS not_evaluated, CASE WHEN NOT outside THEN found END AS rank, CASE WHEN NOT outside THEN round(coalesce(1.0::DOUBLE / found, 0), 6) END AS reciprocal_rank,
        CASE WHEN NOT outside THEN coalesce(found <= 1, FALSE) END AS hit_top_1, CASE WHEN NOT outside THEN coalesce(found <= 5, FALSE) END AS hit_top_5, CASE WHEN NOT outside THEN found IS NULL AND accepted IS NOT NULL END AS partial_match,
        CASE WHEN NOT outside THEN coalesce(NOT doc1, FALSE) END AS wrong_document_at_1, CASE WHEN NOT outside THEN coalesce(doc5, FALSE) END AS document_hit_top_5 FROM m""",
    "expected_names": f"""WITH v AS (SELECT p_partkey, {_identity('p_type')} AS typed, {_identity("coalesce(CASE WHEN p_partkey % 3 <> 0 THEN nullif(p_type, '') END, p_name)")} AS own FROM part), k AS (SELECT *, {_alias_key('typed', _PART_ALIASES)} AS law, {_alias_key('own', _PART_ALIASES)} AS known FROM v)
        SELECT p_partkey, law, array_to_string({_names("known", "own", _PART_ALIASES)}, ',') AS names FROM k""",
    "case_checks": """WITH c AS (SELECT DISTINCT conv_id AS c FROM conversations WHERE turn = 0), r AS (SELECT c, CASE WHEN c % 7 = 0 THEN ' ' ELSE CAST(c - CASE WHEN c % 11 = 10 THEN 1 ELSE 0 END AS VARCHAR) END AS id FROM c),
        m AS (SELECT *, count(*) OVER (PARTITION BY id) > 1 AS many FROM r)
        SELECT id, CASE WHEN c % 7 = 0 THEN 'id is blank' WHEN many THEN 'id is repeated' WHEN c % 7 = 1 THEN 'question is blank' WHEN c % 7 = 2 AND c % 2 <> 0 THEN 'out_of_scope needs no_answer' WHEN c % 7 IN (3, 4) THEN 'an expected source is not valid' WHEN c % 7 = 6 THEN 'nothing is expected' END AS problem, count(*) AS n FROM m GROUP BY 1, 2""",
    "jsonl_round_trip": f"""WITH d AS (SELECT *, CASE WHEN doc_id % 5 <> 0 THEN nullif(trim(text, {_BLANK}), '') END AS body FROM documents)
        SELECT CASE WHEN body IS NULL THEN 'empty_text' ELSE 'ok' END AS class, CAST(doc_id AS VARCHAR) AS document_title, md5(body) AS content_md5, CASE WHEN body IS NOT NULL THEN CAST(doc_id % 90 AS VARCHAR) END AS article_number, CASE WHEN body IS NOT NULL THEN CASE WHEN doc_id % 2 = 0 THEN 'True' ELSE 'False' END END AS section_title,
        CASE WHEN body IS NOT NULL THEN lang END AS chapter_title, CASE WHEN body IS NOT NULL THEN CASE WHEN doc_id % 3 = 0 THEN source ELSE source || '.html' END END AS source_filename, CASE WHEN body IS NOT NULL THEN '1,' || (doc_id % 4) END AS refs FROM d""",
    "store_replace": """WITH r AS (SELECT doc_id // 40 AS f, doc_id, substr(coalesce(text, ''), 1, 40) AS t FROM documents), two AS (SELECT * FROM r WHERE f % 3 = 0 AND doc_id % 2 = 0),
        held AS (SELECT f, 'two' AS title, 'two:' || t AS content FROM two UNION ALL SELECT f, 'one', 'one:' || t FROM r WHERE f NOT IN (SELECT f FROM two))
        SELECT f AS document_id, 'f' || f AS filename, title, count(*) AS chunks, md5(string_agg(content, '|' ORDER BY content)) AS content_md5 FROM held GROUP BY 1, 2, 3""",
    "conversion_report": r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<!--.*?-->|<!DOCTYPE[^>]*>', '', 'g'), '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<noscript\b[^>]*>.*?</noscript\s*>|<meta\b[^>]*>', '', 'g') AS x FROM pages),
        b AS (SELECT page_id, replace(replace(replace(replace(replace(replace(regexp_replace(x, '(?s)<[^>]*>', chr(10), 'g'), '&nbsp;', chr(160)), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&') AS x FROM a),
        c AS (SELECT page_id, len(list_filter(list_transform(regexp_split_to_array(x, '\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]'), lambda l: trim(regexp_replace(replace(l, chr(65279), ''), '[ \t\x{a0}]+', ' ', 'g'), ' ')), lambda l: l <> '')) AS n FROM b),
        r AS (SELECT page_id, CASE WHEN page_id % 3 = 0 AND page_id % 10 <> 0 THEN (n + 2) // 4 ELSE 0 END AS k FROM c)
        SELECT 'p' || page_id AS source_filename, CASE WHEN k > 0 THEN 'ok' ELSE 'failed' END AS status, CAST(k AS BIGINT) AS records FROM r""",
    "query_checks": f"""WITH c AS (SELECT conv_id, turn, trim(CASE WHEN turn % 3 = 1 THEN '  ' ELSE ' ' || substr(coalesce(text, ''), 1, 20) || chr(9) || chr(10) END, {_BLANK}) AS query FROM conversations)
        SELECT conv_id, turn, query, CAST(least(20, greatest(1, CASE WHEN conv_id % 4 = 1 THEN conv_id % 50 ELSE 5 END)) AS BIGINT) AS top_k FROM c WHERE query <> ''""",
    "title_parts": f"""WITH d AS (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents), t AS (SELECT doc_id, source, {_FIRST} AS one, {_SECOND} AS two FROM d), u AS (SELECT *, lower(two) AS low, '' AS none FROM t)
        SELECT doc_id, source || CASE WHEN doc_id % 2 = 0 THEN '.tar' ELSE '' END AS title, regexp_matches(two, '^\\P{{L}}*\\p{{Ll}}') AS lower, {_continues('one', 'low')} AS continues, coalesce({_title('none', 'one', 'low')}, '') AS article_title FROM u""",
    "display_values": f"""SELECT p_partkey, {_SHOWN} AS number, CASE p_size % 3 WHEN 0 THEN 'semantic' WHEN 1 THEN 'hybrid' END AS mode, CASE WHEN p_size % 3 = 0 THEN 'семантический' ELSE 'гибридный' END AS label,
        nullif(concat_ws('. ', CASE WHEN p_size % 2 = 0 THEN 'Статья ' || p_size END, CASE WHEN p_size % 3 = 0 THEN p_name END), '') AS article,
        coalesce(CASE WHEN p_size % 7 = 0 THEN p_name END, {_case([(_has(_FILE, parts), f"'{name}'") for parts, name in KNOWN_NAMES], "'Нормативный документ'")}) AS title,
        CASE WHEN p_size % 2 = 0 THEN '{",".join(sorted(f for f in SOURCE_FIELDS if f in ("article_number", "document_title")))}' ELSE 'document_title' END AS kept FROM part""",
}
