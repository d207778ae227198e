"""DuckDB SQL of the document-retrieval queries. Ranking by cover density and the HTML
parser are beyond SQL; tests cover them."""

from __future__ import annotations

from .functions.references import HINT_TERMS
from .operators.structure import DOCX_RULES, HTML_RULES, TITLES
from .plans.answer import RULES
from .queries import ALIASES, FILES, JSONL, K, LAW, QUESTIONS, SIZE, TEXTS


def _values(rows: list[tuple], names: str) -> str:
    show = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)}) AS t({names}))"


_COS = "1 - list_cosine_similarity(CAST(c.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"
_NEAR = f"""near AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, c.label, q.label AS own, {_COS} AS d,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS}, c.vec_id) AS rank
    FROM embeddings c, embeddings q WHERE q.vec_id % 100 = 0)"""

_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)"
_NORM = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)),
    '[\f\x0B\x{85}\x{2028}]', chr(10), 'g'), '[ \t]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g')"""
_PARTS = f"(SELECT doc_id, list_filter(list_transform(string_split(trim({_NORM}, {_BLANK}), chr(10)), lambda x: trim(x, {_BLANK})), lambda x: x <> '') AS ps FROM documents)"
_LAST = r"regexp_extract(acc, '[^\x01]*$')"


def _pack(parts: str) -> str:
    return f"""CASE WHEN len({parts}) = 0 THEN [] ELSE string_split(list_reduce({parts}, lambda acc, p: CASE WHEN length({_LAST}) + 2 + length(p) > {SIZE}
        THEN acc || chr(1) || p ELSE acc || chr(10) || chr(10) || p END), chr(1)) END"""


_CHUNKS = f"""packed AS (SELECT doc_id, {_pack("ps")} AS cs FROM {_PARTS} AS parts),
    chunks AS (SELECT doc_id, unnest(range(0, len(cs))) AS chunk_index, unnest(cs) AS content FROM packed)"""


def _long(source: str) -> str:
    """Recursive cutting of (doc_id, k, body) texts into (doc_id, k, n, piece, rest)."""
    window, half = f"substr(rest, 1, {SIZE})", SIZE // 2
    sentence, space = f"length(regexp_extract({window}, '(?s)^.*[.!?;]'))", f"length(regexp_extract({window}, '(?s)^.* ')) - 1"
    at = f"CASE WHEN length(rest) <= {SIZE} THEN length(rest) WHEN {sentence} - 1 > {half} THEN {sentence} WHEN {space} > {half} THEN {space} ELSE {SIZE} END"
    return f"""cutting(doc_id, k, n, piece, rest) AS (
        SELECT doc_id, k, 0, '', trim(body, {_BLANK}) FROM {source}
        UNION ALL SELECT doc_id, k, n + 1, substr(rest, 1, {at}), substr(rest, {at} + 1) FROM cutting WHERE rest <> '')"""


_OUT = "CAST(length({0}) AS BIGINT) AS length, md5({0}) AS {1}"
_OVER = f"""CASE WHEN chunk_index = 0 THEN content
    WHEN trim(right(before, 200), {_BLANK}) <> '' AND NOT starts_with(trim(content, {_BLANK}), trim(right(before, 200), {_BLANK}))
    THEN trim(trim(right(before, 200), {_BLANK}) || chr(10) || chr(10) || trim(content, {_BLANK}), {_BLANK}) ELSE trim(content, {_BLANK}) END"""
_LAGGED = "(SELECT *, lag(content) OVER (PARTITION BY doc_id ORDER BY chunk_index) AS before FROM chunks)"

_REFS = r"(?i)(?:^|[^\p{L}\p{N}_])стать(?:я|и|е|ей|ёй|ю|ях|ями)(\s+\d+(?:\.\d+)*(?:\s*(?:,|и|или|либо|и/или|[-–—])\s*\d+(?:\.\d+)*)*)"


def _refs(text: str, own: str) -> str:
    found = f"list_distinct(flatten(list_transform(regexp_extract_all({text}, '{_REFS}', 1), lambda t: regexp_extract_all(t, '\\d+(?:\\.\\d+)*'))))"
    keyed = f"list_sort(list_transform(list_filter({found}, lambda v: v IS DISTINCT FROM {own}), lambda v: {{'k': list_transform(string_split(v, '.'), lambda p: CAST(p AS BIGINT)), 'v': v}}))"
    return f"coalesce(array_to_string(list_transform({keyed}, lambda zz: zz.v), ','), '')"


_FOLD = "replace(lower({}), 'ё', 'е')"


def _case(pairs: list[tuple[str, str]], other: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {other} END"


def _has(x: str, words: tuple[str, ...], joint: str = "OR") -> str:
    return "(" + f" {joint} ".join(f"contains({x}, '{w}')" for w in words) + ")"


def _slug(x: str) -> str:
    out = f"translate(lower({x}), 'абвгдеёзийклмнопрстуфыэ', 'abvgdeeziyklmnoprstufye')"
    for letter, latin in (("ж", "zh"), ("х", "h"), ("ц", "ts"), ("ч", "ch"), ("ш", "sh"), ("щ", "sch"), ("ъ", ""), ("ь", ""), ("ю", "yu"), ("я", "ya")):
        out = f"replace({out}, '{letter}', '{latin}')"
    return f"coalesce(nullif(trim(regexp_replace({out}, '[^a-z0-9]+', '_', 'g'), '_'), ''), 'document')"


_STEM = r"regexp_replace(name, '\.[^.]*$', '')"
_HTML_ID = _case([(_has("f", words), _case([(_has("f", signs), f"'{p}'") for p, signs in parts], f"'{base}'") if parts else f"'{base}'") for base, words, parts in HTML_RULES], _slug("stem"))
_NAMED = f"(SELECT id, name, {_STEM} AS stem, {_FOLD.format(_STEM)} AS f FROM {_values(FILES, 'id, name')} AS v)"

_EVAL = f"""{_NEAR},
    r AS (SELECT query_id, label, own, d, row_number() OVER (PARTITION BY query_id ORDER BY d, chunk_id) AS rank FROM near WHERE rank <= 21 AND query_id <> chunk_id),
    j AS (SELECT *, CASE WHEN label = own THEN 'primary' WHEN label = own + 1 THEN 'acceptable' END AS rel, round(1 - d, 6) AS sim FROM r WHERE rank <= 20),
    c AS (SELECT vec_id AS q, 'L' || (label % 4) AS law, CASE WHEN label % 3 > 0 THEN 'T' || (label % 3) END AS question_type, vec_id % 1500 = 0 AS outside FROM embeddings WHERE vec_id % 100 = 0),
    p AS (SELECT query_id, min(rank) FILTER (WHERE rel = 'primary') AS found, min(rank) FILTER (WHERE rel = 'acceptable') AS accepted, bool_or(label = own) FILTER (WHERE rank = 1) AS doc1,
          bool_or(label = own) FILTER (WHERE rank <= 5) AS doc5, max(sim) FILTER (WHERE rank = 1) AS first FROM j GROUP BY 1),
    m AS (SELECT CAST(q AS VARCHAR) AS id, law, question_type, outside AS not_evaluated, CASE WHEN NOT outside THEN found END AS rank,
          CASE WHEN NOT outside THEN coalesce(1.0 / found, 0) END AS reciprocal_rank,
          {', '.join(f"CASE WHEN NOT outside THEN coalesce(found <= {d}, FALSE) END AS hit_top_{d}" for d in (1, 3, 5, 10, 20))},
          CASE WHEN NOT outside THEN found IS NULL AND accepted IS NOT NULL END AS partial_match,
          CASE WHEN NOT outside THEN coalesce(NOT doc1, FALSE) END AS wrong_document_at_1,
          CASE WHEN NOT outside THEN coalesce(doc5, FALSE) END AS document_hit_top_5,
          CASE WHEN NOT outside THEN first END AS first_similarity FROM c LEFT JOIN p ON p.query_id = c.q)"""
_METRICS = ", ".join(
    [
        "count(*) FILTER (WHERE NOT not_evaluated) AS questions_count",
        "count(*) FILTER (WHERE not_evaluated) AS out_of_scope_count",
        "round(coalesce(avg(reciprocal_rank), 0), 6) AS mrr",
        "round(coalesce(avg(first_similarity), 0), 6) AS average_first_similarity",
        "round(avg(rank), 6) AS mean_rank",
        "round(avg(CAST(document_hit_top_5 AS INT)), 6) AS document_recall_at_5",
        "round(avg(CAST(wrong_document_at_1 AS INT)), 6) AS wrong_document_at_1",
        *[f"CAST(sum(CAST(hit_top_{d} AS INT)) AS BIGINT) AS hit_top_{d}_count" for d in (1, 3, 5, 10, 20)],
        *[f"round(avg(CAST(hit_top_{d} AS INT)), 6) AS top_{d}_accuracy" for d in (1, 3, 5, 10, 20)],
    ]
)

_RESULTS = f"""{_NEAR}, res AS (SELECT n.query_id, n.rank, d.* FROM near n JOIN documents d ON d.doc_id = n.chunk_id WHERE n.rank <= 5)"""
_NL = "chr(10)"
_BLOCK = f"""'[Источник ' || rank || ']' || {_NL} || 'Документ: ' || lang || {_NL} || CASE WHEN doc_id % 2 = 0 THEN 'Глава: C' || {_NL} ELSE '' END ||
    'Статья: ' || source || {_NL} || 'Название статьи: не указано' || {_NL} || 'Ссылки на статьи: ' || CASE WHEN doc_id % 3 = 0 THEN '1, 2' ELSE 'нет' END || {_NL} || 'Текст:' || {_NL} || coalesce(text, '')"""
_PARA = "chr(10) || chr(10)"
_RULE_TEXT = f" || {_PARA} || ".join(f"'{x}'" for x in RULES)

_TAGGED = "tagged AS (SELECT e.vec_id, e.embedding, d.source, d.source || ' ' || d.lang AS names, d.lang FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id)"
_CAND = f"""{_TAGGED},
    sem AS (SELECT query_id, chunk_id FROM (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS}, c.vec_id) AS r FROM tagged c, tagged q WHERE q.vec_id % 100 = 0) WHERE r <= 50),
    cand AS (SELECT * FROM sem UNION SELECT q.vec_id, c.vec_id FROM tagged c JOIN tagged q ON c.vec_id // 10 = q.vec_id // 10 WHERE q.vec_id % 100 = 0)"""

_TERMS = r"list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))"

ORACLES = {
    "knn_semantic": f"""SELECT c.vec_id AS chunk_id, round({_COS}, 6) AS distance, round(1 - ({_COS}), 6) AS semantic_score, 0.0::DOUBLE AS keyword_score, 0.0::DOUBLE AS article_boost, 0.0::DOUBLE AS document_boost,
        round(1 - ({_COS}), 6) AS similarity, round(1 - ({_COS}), 6) AS hybrid_score FROM embeddings c, embeddings q WHERE q.vec_id = 0 ORDER BY {_COS}, c.vec_id LIMIT {K}""",
    "knn_batch_topk": f"WITH {_NEAR} SELECT query_id, chunk_id, round(d, 6) AS distance, rank FROM near WHERE rank <= {K}",
    "hybrid_candidates_union": f"WITH {_CAND} SELECT query_id, chunk_id FROM cand",
    "hybrid_score": f"""WITH {_CAND},
        s AS (SELECT query_id, chunk_id, 1 - ({_COS}) AS sem, CASE WHEN c.vec_id // 10 = q.vec_id // 10 THEN 0.65::DOUBLE ELSE 0 END AS art, CASE WHEN lower(c.names) LIKE '%' || q.lang || '%' THEN 0.35::DOUBLE ELSE 0 END AS doc
              FROM cand JOIN tagged c ON c.vec_id = chunk_id JOIN tagged q ON q.vec_id = query_id),
        h AS (SELECT *, 0.6::DOUBLE * sem + 0.1::DOUBLE * least(1.0::DOUBLE, art + doc) AS score FROM s),
        o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM h)
        SELECT query_id, chunk_id, round(sem, 6) AS semantic_score, 0.0::DOUBLE AS keyword_score, art AS article_boost, doc AS document_boost, round(score, 6) AS hybrid_score, rank FROM o WHERE rank <= 5""",
    "alias_exists_boost": "SELECT p_partkey, CASE WHEN "
    + " OR ".join(f"lower(concat_ws(' ', p_name, p_brand, p_type)) LIKE '%{a}%'" for a in ALIASES if a != "%")
    + " THEN 0.35::DOUBLE ELSE 0.0::DOUBLE END AS document_boost FROM part",
    "doc_chunk_counts": f"WITH {_CHUNKS} SELECT d.doc_id AS document_id, source, count(c.doc_id) AS chunks_count FROM documents d LEFT JOIN chunks c ON c.doc_id = d.doc_id GROUP BY 1, 2",
    "chunks_of_document": f"WITH {_CHUNKS} SELECT doc_id AS document_id, chunk_index, content, CAST(NULL AS VARCHAR) AS document_title FROM chunks WHERE doc_id = 8",
    "paragraph_split": f"WITH p AS (SELECT doc_id, unnest(range(0, len(ps))) AS n, unnest(ps) AS part FROM {_PARTS} AS parts) SELECT doc_id, n, {_OUT.format('part', 'part_md5')} FROM p",
    "pack_chunks": f"WITH {_CHUNKS} SELECT doc_id, chunk_index, {_OUT.format('content', 'content_md5')} FROM chunks",
    "split_long": f"""WITH RECURSIVE src AS (SELECT doc_id, 0 AS k, coalesce(text, '') AS body FROM documents), {_long('src')}
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS n, {_OUT.format('part', 'part_md5')} FROM (SELECT doc_id, n, trim(piece, {_BLANK}) AS part FROM cutting WHERE n > 0) WHERE part <> ''""",
    "chunk_overlap": f"WITH {_CHUNKS}, o AS (SELECT doc_id, chunk_index, {_OVER} AS body FROM {_LAGGED} AS l) SELECT doc_id, chunk_index, {_OUT.format('body', 'content_md5')} FROM o",
    "split_text_chunks": f"""WITH RECURSIVE para AS (SELECT doc_id, unnest(range(0, len(ps))) AS k, unnest(ps) AS body FROM {_PARTS} AS parts),
        {_long(f'(SELECT * FROM para WHERE length(body) > {SIZE})')},
        pieces AS (SELECT doc_id, k, 0 AS n, body FROM para WHERE length(body) <= {SIZE} UNION ALL SELECT doc_id, k, n, trim(piece, {_BLANK}) FROM cutting WHERE n > 0 AND trim(piece, {_BLANK}) <> ''),
        lists AS (SELECT doc_id, list(body ORDER BY k, n) AS ps FROM pieces GROUP BY doc_id),
        packed AS (SELECT doc_id, {_pack('ps')} AS cs FROM lists), chunks AS (SELECT doc_id, unnest(range(0, len(cs))) AS chunk_index, unnest(cs) AS content FROM packed),
        o AS (SELECT doc_id, chunk_index, {_OVER} AS body FROM {_LAGGED} AS l) SELECT doc_id, chunk_index, {_OUT.format('body', 'content_md5')} FROM o""",
    "chunk_stats": f"""WITH {_CHUNKS}, r AS (SELECT c.*, d.lang, CASE WHEN d.doc_id % 2 = 0 THEN d.source END AS article FROM chunks c JOIN documents d ON d.doc_id = c.doc_id)
        SELECT lang, count(*) AS chunks, count(*) FILTER (WHERE article <> '') AS with_article, count(*) FILTER (WHERE coalesce(article, '') = '') AS without_article,
        min(length(content)) AS min_length, round(avg(length(content)), 6) AS mean_length, CAST(median(length(content)) AS DOUBLE) AS median_length, max(length(content)) AS max_length,
        count(*) FILTER (WHERE contains(content, chr(12))) AS with_form_feed, count(*) FILTER (WHERE {_refs('content', 'article')} <> '') AS with_references,
        count(*) FILTER (WHERE regexp_matches(content, 'Статья\\s+[0-9]') AND regexp_extract(content, 'Статья\\s+([0-9]+(?:\\.[0-9]+)*)', 1) IS DISTINCT FROM article) AS suspicious FROM r GROUP BY lang""",
    "chunk_previews": rf"WITH {_CHUNKS} SELECT doc_id, chunk_index, substr(trim(regexp_replace(content, '[\s\x0B\x{{85}}\x{{a0}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{3000}}]+', ' ', 'g'), ' '), 1, 200) AS start_text FROM chunks",
    "html_lines": r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<!--.*?-->|<!DOCTYPE[^>]*>', '', 'g'),
        '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<noscript\b[^>]*>.*?</noscript\s*>|<meta\b[^>]*>', '', 'g') AS x FROM pages),
        b AS (SELECT page_id, replace(replace(replace(replace(replace(replace(regexp_replace(x, '(?s)<[^>]*>', chr(10), 'g'), '&nbsp;', chr(160)), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&') AS x FROM a),
        c AS (SELECT page_id, list_filter(list_transform(regexp_split_to_array(x, '\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]'), lambda l: trim(regexp_replace(replace(l, chr(65279), ''), '[ \t\x{a0}]+', ' ', 'g'), ' ')), lambda l: l <> '') AS ls FROM b)
        SELECT page_id, unnest(range(0, len(ls))) AS n, unnest(ls) AS line FROM c""",
    "structure_records": f"""WITH v AS {_values(LAW, 'doc, n, line')},
        k AS (SELECT *, {_case([(f"regexp_matches(line, '(?i)^Раздел\\s+.+')", "'section'"), ("regexp_matches(line, '(?i)^Подраздел\\s+.+')", "'subsection'"), ("regexp_matches(line, '(?i)^Глава\\s+.+')", "'chapter'"), ("regexp_matches(line, '(?i)^(?:Параграф|§)\\s+.+')", "'paragraph'"), ("regexp_matches(line, '(?i)^Статья\\s+\\d+(?:\\.\\d+)*(?:[.\\s]+.*)?$')", "'article'")], 'NULL')} AS kind FROM v),
        w AS (SELECT *, max(CASE WHEN kind = 'section' THEN n END) OVER o AS s, max(CASE WHEN kind = 'subsection' THEN n END) OVER o AS u, max(CASE WHEN kind = 'chapter' THEN n END) OVER o AS c,
              max(CASE WHEN kind = 'paragraph' THEN n END) OVER o AS p, max(CASE WHEN kind IS NOT NULL THEN n END) OVER o AS head FROM k WINDOW o AS (PARTITION BY doc ORDER BY n ROWS UNBOUNDED PRECEDING)),
        t AS (SELECT doc, head, string_agg(line, chr(10) ORDER BY n) FILTER (WHERE n > head) AS body FROM w GROUP BY 1, 2),
        r AS (SELECT w.doc, w.n, s, CASE WHEN u > coalesce(s, -1) THEN u END AS u, CASE WHEN c > greatest(coalesce(s, -1), coalesce(u, -1)) THEN c END AS c, CASE WHEN p > greatest(coalesce(s, -1), coalesce(u, -1), coalesce(c, -1)) THEN p END AS p,
              regexp_extract(line, '(?i)^Статья\\s+(\\d+(?:\\.\\d+)*)', 1) AS article_number, nullif(trim(regexp_extract(line, '(?i)^Статья\\s+\\d+(?:\\.\\d+)*(?:[.\\s]+(.*))?$', 1)), '') AS article_title,
              line || coalesce(chr(10) || chr(10) || body, '') AS text FROM w JOIN t ON t.doc = w.doc AND t.head = w.n WHERE kind = 'article')
        SELECT r.doc, r.n, a.line AS section_title, b.line AS subsection_title, d.line AS chapter_title, e.line AS paragraph_title, article_number, article_title, text, {_refs('text', 'article_number')} AS referenced_articles
        FROM r LEFT JOIN v a ON a.doc = r.doc AND a.n = s LEFT JOIN v b ON b.doc = r.doc AND b.n = u LEFT JOIN v d ON d.doc = r.doc AND d.n = c LEFT JOIN v e ON e.doc = r.doc AND e.n = p""",
    "reference_extract": f"SELECT id, {_refs('txt', 'own')} AS refs FROM {_values(TEXTS, 'id, txt, own')} AS v",
    "article_number_query": rf"SELECT id, nullif(regexp_extract(q, '(?i)(?:^|[^\p{{L}}\p{{N}}_])ст(?:атья|атье|атьи|атью)?\.?\s*(\d+(?:\.\d+)*)', 1), '') AS article_number FROM {_values(QUESTIONS, 'id, q')} AS v",
    "law_hint_query": "SELECT id, " + _case([(_has(r"regexp_replace(" + _FOLD.format("q") + r", '\s+', ' ', 'g')", tuple(w.replace("ё", "е") for w in words)), f"'{law}'") for law, words in HINT_TERMS.items()], "NULL") + f" AS law FROM {_values(QUESTIONS, 'id, q')} AS v",
    "slugify": f"SELECT id, {_slug('name')} AS slug FROM (SELECT p_partkey AS id, p_name AS name FROM part UNION ALL SELECT -1 - id, name FROM {_values(FILES, 'id, name')} AS v)",
    "identity_normalize": f"SELECT id, regexp_replace({_FOLD.format('name')}, '[^a-zа-я0-9]+', '', 'g') AS identity FROM (SELECT p_partkey AS id, concat_ws('-', p_name, p_brand, p_type) AS name FROM part UNION ALL SELECT -1 - id, name FROM {_values(FILES, 'id, name')} AS v)",
    "infer_metadata": f"""WITH h AS (SELECT *, {_HTML_ID} AS html_id FROM {_NAMED} AS n) SELECT id, html_id, {_case([(f"html_id = '{k}'", f"'{v}'") for k, v in TITLES.items()], 'stem')} AS html_title,
        {_case([(_has('f', w, 'AND'), f"'{i}'") for i, _, _, w in DOCX_RULES], _slug('stem'))} AS docx_id, {_case([(_has('f', w, 'AND'), f"'{o}'") for _, _, o, w in DOCX_RULES], _slug('stem') + " || '.jsonl'")} AS docx_file,
        {_case([(_has('f', w, 'AND'), 'TRUE') for _, _, _, w in DOCX_RULES], 'FALSE')} AS recognised FROM h""",
    "jsonl_validate": f"""WITH l AS (SELECT 'events' AS filename, event_id AS n, props AS line FROM events UNION ALL SELECT filename, n, line FROM {_values([('v', i, x) for i, x in enumerate(JSONL)], 'filename, n, line')} AS v),
        k AS (SELECT filename, n, CASE WHEN coalesce(trim(line), '') = '' THEN 'blank' WHEN NOT json_valid(line) THEN 'invalid' WHEN json_type(line) <> 'OBJECT' THEN 'not_object'
              WHEN coalesce(trim(json_extract_string(line, '$.text')), '') = '' THEN 'empty_text' ELSE 'ok' END AS class, line FROM l)
        SELECT filename, n, class, CASE WHEN class = 'ok' THEN trim(json_extract_string(line, '$.text')) END AS content, CASE WHEN class = 'ok' THEN json_extract_string(line, '$.article_number') END AS article_number FROM k""",
    "keyword_match_all_terms": f"""WITH d AS (SELECT doc_id, {_TERMS} AS ws FROM documents), q AS (SELECT item_id, {_TERMS} AS ts FROM benchmark)
        SELECT item_id AS query_id, doc_id FROM d, q WHERE len(ts) > 0 AND len(list_intersect(ts, ws)) = len(ts)""",
    "eval_case_results": f"WITH {_EVAL} SELECT * EXCLUDE (law, question_type) REPLACE (round(reciprocal_rank, 6) AS reciprocal_rank) FROM m",
    "eval_summary": f"WITH {_EVAL} SELECT {_METRICS} FROM m",
    "eval_by_law": f"WITH {_EVAL} SELECT law, {_METRICS} FROM m GROUP BY law",
    "eval_by_type": f"WITH {_EVAL} SELECT coalesce(question_type, 'unspecified') AS question_type, {_METRICS} FROM m GROUP BY 1",
    "best_worst_groups": f"""WITH {_EVAL}, g AS (SELECT law AS name, avg(CAST(hit_top_1 AS INT)) AS v FROM m GROUP BY law)
        SELECT 'best' AS kind, name FROM g WHERE round(v, 6) = (SELECT round(max(v), 6) FROM g) UNION ALL SELECT 'weakest', name FROM g WHERE round(v, 6) = (SELECT round(min(v), 6) FROM g)""",
    "label_hit_at_k": f"WITH {_EVAL} SELECT CAST(query_id AS VARCHAR) AS case_id, count(*) FILTER (WHERE label = own) AS hits, bool_or(label = own AND rank <= 5) AS hit_at_5 FROM j GROUP BY 1",
    "prompt_text": f"""WITH {_RESULTS}, b AS (SELECT query_id, string_agg({_BLOCK}, {_PARA} || '---' || {_PARA} ORDER BY rank) AS ctx FROM res GROUP BY 1),
        p AS (SELECT e.vec_id AS query_id, {_RULE_TEXT} || {_PARA} || '' || {_PARA} || 'Вопрос: q' || e.vec_id || {_PARA} || '' || {_PARA} || 'Контекст:' || {_PARA} || coalesce(ctx, 'Контекст не найден.') AS prompt
              FROM embeddings e LEFT JOIN b ON b.query_id = e.vec_id WHERE e.vec_id % 100 = 0)
        SELECT query_id, md5(prompt) AS prompt_md5, CAST(length(prompt) AS BIGINT) AS length FROM p""",
    "sources_projection": f"""WITH {_RESULTS} SELECT query_id, rank, lang AS document_title, 'f' || doc_id AS filename, source AS article_number, NULL::VARCHAR AS article_title, NULL::VARCHAR AS section_title, NULL::VARCHAR AS subsection_title,
        CASE WHEN doc_id % 2 = 0 THEN 'C' END AS chapter_title, NULL::VARCHAR AS paragraph_title, 'txt' AS source_format, NULL::VARCHAR AS source_filename, doc_id AS chunk_index, CASE WHEN doc_id % 3 = 0 THEN '1,2' ELSE '' END AS referenced_articles FROM res""",
    "history_last_100": "SELECT conv_id, turn, role, text AS content, row_number() OVER (ORDER BY conv_id DESC, turn DESC) AS n FROM conversations WHERE role IN ('user', 'assistant') AND text IS NOT NULL ORDER BY n LIMIT 100",
    "history_last_per_conversation": "SELECT * FROM (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations WHERE role IN ('user', 'assistant') AND text IS NOT NULL) WHERE n <= 3",
    "duplicate_ids": "SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id) > 1 AS repeated FROM conversations",
}

#: SQL of the golden texts.
GOLDEN_ORACLES = {name: ORACLES.pop(name) for name in ("structure_records", "reference_extract", "article_number_query", "law_hint_query", "infer_metadata")}
