"""SQL for the queries of the registry, written for another engine and independently of the operators."""

from __future__ import annotations

from glosswright.operators import drafting as D
from glosswright.operators.guards import STOP_WORDS
from glosswright.operators.terms import FUNCTION_WORDS
from glosswright.functions.text import CONDITIONS, INJECTIONS, KO_CONDITIONS
from glosswright.plans import bindings as B

W = r"[\p{L}\p{N}_]"
N = r"[^\p{L}\p{N}_]"


def _tokens(text: str) -> str:
    return rf"regexp_extract_all(lower({text}), '\[[^\]]+\]|{W}+')"


def _list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


PAIRS = """pairs AS (
  SELECT u.conv_id * 10000 + u.turn AS id, u.text AS en_text, a.text AS ko_text
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')"""
CARDS = f"cards AS (SELECT p_partkey AS id, {B.CARD_EN} AS en_text, {B.CARD_KO} AS ko_text FROM part)"
TEXTS = "texts AS (SELECT doc_id AS id, coalesce(text, '') AS en_text, CASE WHEN lang = 'en' THEN 'rule' ELSE 'flavor' END AS route FROM documents)"
GLOSSARY = f"""gl AS (
  SELECT en, ko, section AS source FROM (
    SELECT lower(trim(replace(en, '_', ' '))) AS en, ko, section,
           row_number() OVER (PARTITION BY lower(trim(replace(en, '_', ' '))) ORDER BY list_position(['official', 'subtype_extracted', 'extracted'], section), ko) AS n
    FROM ({B.GLOSSARY_SQL})) WHERE n = 1 AND en <> '' AND ko <> '')"""


def _phrase(text: str, term: str) -> str:
    """Whole-phrase test for the glossary's terms, each with a pattern of its own."""
    import re

    cases = " ".join(rf"WHEN '{t}' THEN regexp_matches({text}, '(?i)(^|{N}){re.escape(t)}($|{N})')" for t in sorted({e.replace("_", " ").strip().lower() for _, e, _ in B.GLOSSARY}) if t)
    return f"CASE {term} {cases} END"


def _grams(name: str, tokens: str, source: str = "pairs") -> str:
    """CTEs: name(id, term), each term once per id, for n = 1, 2, 3."""
    return f"""{name}_w AS (SELECT id, unnest(t) AS w, generate_subscripts(t, 1) AS i FROM (SELECT id, {tokens} AS t FROM {source})),
  {name}_l AS (SELECT id, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM {name}_w WINDOW o AS (PARTITION BY id ORDER BY i)),
  {name} AS (SELECT DISTINCT id, term FROM (
    SELECT id, w AS term FROM {name}_l UNION ALL SELECT id, w || ' ' || w2 FROM {name}_l WHERE w2 IS NOT NULL
    UNION ALL SELECT id, w || ' ' || w2 || ' ' || w3 FROM {name}_l WHERE w3 IS NOT NULL))"""


EN_TOKENS = _tokens("regexp_replace(en_text, '</?[a-zA-Z][^>]*>', ' ', 'g')")
KO_TOKENS = r"""list_filter(list_transform(string_split_regex(regexp_replace(ko_text, '<[^>]*>', '', 'g'), '\s+'),
    lambda x: regexp_replace(x, '^[.,:;!?"''()]+|[.,:;!?"''()]+$', '', 'g')), lambda x: x <> '')"""
CANDIDATES = f"""{PAIRS}, {_grams("en", EN_TOKENS)}, {_grams("ko", KO_TOKENS)},
  ef AS (SELECT term, count(*) AS ef FROM en GROUP BY term HAVING count(*) >= 5),
  kf AS (SELECT term, count(*) AS kf FROM ko GROUP BY term HAVING count(*) >= 5),
  cands AS (
    SELECT e.term AS en_term, k.term AS ko_term, count(*) AS cooccurrence, round(2.0 * count(*) / (ef + kf), 9) AS dice,
           round(log2((count(*)::DOUBLE / n) / ((ef::DOUBLE / n) * (kf::DOUBLE / n))), 9) AS pmi, 2.0::DOUBLE * count(*) / (ef + kf) AS d
    FROM en e JOIN ef ON ef.term = e.term JOIN ko k ON k.id = e.id JOIN kf ON kf.term = k.term CROSS JOIN (SELECT count(*) AS n FROM pairs)
    GROUP BY e.term, k.term, ef, kf, n HAVING count(*) >= 5),
  tops AS (SELECT en_term FROM cands GROUP BY en_term ORDER BY max(cooccurrence) DESC, en_term LIMIT 1500),
  capped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY en_term ORDER BY d DESC, cooccurrence DESC, ko_term) AS r
             FROM cands WHERE en_term IN (FROM tops)) WHERE r <= 3)"""

KEYWORDS = """kw AS (
  SELECT lower(e) AS en_term, k AS ko_term, list_sort(list_distinct(list(id))) AS card_ids FROM (
    SELECT p_partkey AS id, unnest(string_split(p_name, ' ')) AS e,
           unnest(CASE WHEN p_partkey % 2 = 0 THEN list_append(string_split(p_type, ' '), 'PLUS') ELSE string_split(p_type, ' ') END) AS k
    FROM part
    WHERE len(string_split(p_name, ' ')) = len(string_split(p_type, ' ')) + CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END)
  WHERE e <> '' AND k <> '' GROUP BY ALL)"""
KW_CONFLICTS = KEYWORDS + """, kc AS (
  SELECT en_term, list_sort(list(DISTINCT ko_term)) AS v FROM kw GROUP BY en_term)"""

SENTENCES = r"list_filter(list_transform(string_split(regexp_replace(regexp_replace({}, '([.!?])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"
TEMPLATE = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '</?(strong|em|ul|li|trace)>', '', 'g'), '\[[a-z0-9\-]+\]', '{{SYM}}', 'g'), '[0-9]+', '{{N}}', 'g'), '\s+', ' ', 'g'))"


def _patterns(source: str, ko: str = "ko_text") -> str:
    return f"""SELECT en_template, ko_template, count(*) AS count, array_to_string(list_slice(list(id ORDER BY id, pos), 1, 3), '|') AS examples FROM (
      SELECT id, pos, {TEMPLATE.format("e")} AS en_template, {TEMPLATE.format("k")} AS ko_template FROM (
        SELECT id, unnest(es) AS e, unnest(ks) AS k, generate_subscripts(es, 1) AS pos FROM (
          SELECT id, {SENTENCES.format("en_text")} AS es, {SENTENCES.format(ko)} AS ks FROM {source}) WHERE len(es) = len(ks)))
    WHERE en_template <> '' AND ko_template <> '' GROUP BY ALL HAVING count(*) >= 3"""


PLAIN = "regexp_replace({}, '</?(strong|em|ul|li)>', '', 'g')"
EN_SYMS = (
    f"list_concat(list_transform(regexp_extract_all({PLAIN.format('en_text')}, '(?i)\\bTrace\\[({W}+)\\]', 1), lambda x: 'trace_' || upper(x)),"
    f" list_transform(regexp_extract_all(regexp_replace({PLAIN.format('en_text')}, '(?i)\\bTrace\\[{W}+\\]', '', 'g'), '(?i)\\[([a-z][a-z0-9-]*)\\]', 1), lambda x: lower(x)))"
)
KO_SYMS = (
    f"list_concat(list_transform(regexp_extract_all({PLAIN.format('ko_text')}, '<trace>추적\\s+({W}+)</trace>', 1), lambda x: 'trace_' || upper(x)),"
    f" list_transform(regexp_extract_all(regexp_replace({PLAIN.format('ko_text')}, '<trace>추적\\s+{W}+</trace>', '', 'g'), '(?i)\\[([a-z][a-z0-9-]*)\\]', 1), lambda x: lower(x)))"
)
SYMBOLS = f"""{CARDS},
  se AS (SELECT id, s, count(*) AS n FROM (SELECT id, unnest({EN_SYMS}) AS s FROM cards) GROUP BY ALL),
  sk AS (SELECT id, s, count(*) AS n FROM (SELECT id, unnest({KO_SYMS}) AS s FROM cards) GROUP BY ALL),
  sd AS (SELECT coalesce(se.id, sk.id) AS id, coalesce(se.n, 0) - coalesce(sk.n, 0) AS gap FROM se FULL JOIN sk ON se.id = sk.id AND se.s = sk.s),
  g2 AS (SELECT c.id, coalesce(m, 0)::BIGINT AS n_missing, coalesce(x, 0)::BIGINT AS n_extra, coalesce(m, 0) = 0 AND coalesce(x, 0) = 0 AS passed
         FROM cards c LEFT JOIN (SELECT id, sum(greatest(gap, 0)) AS m, sum(greatest(-gap, 0)) AS x FROM sd GROUP BY id) d ON d.id = c.id)"""


def _multiset(rx: str, value: str = "x") -> str:
    side = lambda c: f"SELECT id, {value} AS item, count(*) AS n FROM (SELECT id, unnest(regexp_extract_all({c}, '{rx}')) AS x FROM cards) GROUP BY ALL"
    return f"""SELECT coalesce(a.id, b.id) AS id, coalesce(a.item, b.item) AS item, coalesce(a.n, 0) AS en_n, coalesce(b.n, 0) AS ko_n
      FROM ({side("en_text")}) a FULL JOIN ({side("ko_text")}) b ON a.id = b.id AND a.item = b.item WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)"""


COND = rf"len(regexp_extract_all(en_text, '(?i)\b({CONDITIONS})\b'))"
FIDELITY = rf"""fid AS (
  SELECT id, CASE WHEN en_n > ko_n THEN 'omitted_number' ELSE 'added_number' END AS kind, item, en_n, ko_n FROM ({_multiset("[0-9]+", "CASE WHEN ltrim(x, '0') = '' THEN '0' ELSE ltrim(x, '0') END")})
  UNION ALL SELECT id, 'symbol_mismatch', item, en_n, ko_n FROM ({_multiset(rf"\[{W}[\p{{L}}\p{{N}}_-]*\]")})
  UNION ALL SELECT id, 'omitted_condition', '', {COND}, 0 FROM cards WHERE {COND} > 0 AND NOT regexp_matches(ko_text, '{KO_CONDITIONS}'))"""
TIGHT = r"replace(regexp_replace({}, '\s*\(\s*', '(', 'g'), ' )', ')')"


def _new_terms(source: str) -> str:
    return rf"""covered AS (SELECT unnest(string_split(en, ' ')) AS w FROM gl UNION SELECT en FROM gl),
  chunks AS (SELECT id, route, unnest(ch) AS ch, generate_subscripts(ch, 1) AS pos FROM (
    SELECT id, route, regexp_extract_all(regexp_replace(en_text, '<[^>]+>', ' ', 'g'), '[^a-zA-Z\[]*(\[[^\]]+\]|[a-zA-Z][a-zA-Z''-]*[a-zA-Z]|[a-zA-Z])') AS ch FROM {source})),
  toks AS (SELECT id, route, pos, regexp_extract(ch, '(\[[^\]]+\]|[a-zA-Z][a-zA-Z''-]*[a-zA-Z]|[a-zA-Z])$', 1) AS raw, ch FROM chunks),
  lead_ AS (SELECT *, regexp_replace(substr(ch, 1, length(ch) - length(raw)), '\s+$', '') AS pre FROM toks),
  flagged AS (SELECT id, lower(raw) AS en_term, pos, route = 'rule' AND regexp_matches(raw, '^[A-Z]') AND NOT ((pos = 1 AND pre = '') OR regexp_matches(pre, '[.!?]$')) AS blocking
    FROM lead_ WHERE raw NOT LIKE '[%' AND length(raw) >= 3 AND lower(raw) NOT IN ({_list(STOP_WORDS)})),
  nt AS (SELECT id, en_term, min(pos) AS pos, arg_min(blocking, pos) AS blocking FROM flagged WHERE en_term NOT IN (SELECT w FROM covered) GROUP BY id, en_term)"""


BM25 = rf"""bt AS (SELECT doc_id, unnest({_tokens("text")}) AS t FROM documents),
  btf AS (SELECT doc_id, t, count(*) AS tf FROM bt GROUP BY ALL),
  bdl AS (SELECT doc_id, len({_tokens("text")})::DOUBLE AS dl FROM documents),
  bn AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS a FROM bdl),
  braw AS (SELECT t, ln((n - count(*) + 0.5) / (count(*) + 0.5)) AS raw FROM btf, bn GROUP BY t, n),
  bidf AS (SELECT t, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM braw) ELSE raw END AS idf FROM braw),
  bq AS (SELECT query_id, t, count(*) AS times FROM (SELECT item_id AS query_id, unnest({_tokens("text")}) AS t FROM benchmark) GROUP BY ALL),
  bm AS (SELECT query_id, btf.doc_id, round(sum(idf * times * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / a))), 9) AS score
         FROM btf JOIN bq USING (t) JOIN bidf USING (t) JOIN bdl ON bdl.doc_id = btf.doc_id, bn GROUP BY ALL)"""


def _char(name: str, source: str, key: str) -> str:
    return rf"""{name}_w AS (SELECT {key}, w, count(*) AS c FROM (SELECT {key}, ' ' || unnest(string_split_regex(lower(text), '\s+')) || ' ' AS w FROM {source}) WHERE w <> '  ' GROUP BY ALL),
  {name}_v AS (SELECT DISTINCT w FROM {name}_w),
  {name}_g AS (SELECT w, substr(w, i, n) AS g FROM (SELECT w, n, unnest(range(1, length(w) - n + 2)) AS i FROM {name}_v, (VALUES (3), (4), (5)) v(n) WHERE length(w) > n)
     UNION ALL SELECT w, w FROM {name}_v WHERE length(w) <= 5),
  {name} AS (SELECT {key}, g, sum(c)::DOUBLE AS tf FROM {name}_w JOIN {name}_g USING (w) GROUP BY ALL)"""


CHAR = f"""{_char("cd", "documents", "doc_id")}, {_char("cq", "(SELECT item_id AS query_id, text FROM benchmark)", "query_id")},
  cidf AS (SELECT g, ln((1 + (SELECT count(*) FROM documents)) / (1.0 + count(*))) + 1 AS idf FROM cd GROUP BY g),
  cdw AS (SELECT doc_id, g, tf * idf AS w FROM cd JOIN cidf USING (g)), cqw AS (SELECT query_id, g, tf * idf AS qw FROM cq JOIN cidf USING (g)),
  cdn AS (SELECT doc_id, sqrt(sum(w * w)) AS dn FROM cdw GROUP BY ALL), cqn AS (SELECT query_id, sqrt(sum(qw * qw)) AS qn FROM cqw GROUP BY ALL),
  ch AS (SELECT query_id, doc_id, round(sum(w * qw) / (dn * qn), 9) AS score FROM cdw JOIN cqw USING (g) JOIN cdn USING (doc_id) JOIN cqn USING (query_id) GROUP BY query_id, doc_id, dn, qn)"""


def _top(source: str, k: int = 5) -> str:
    return f"""SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS rank FROM {source}) WHERE rank < {k}"""


def _full(source: str, depth: int | None = 200) -> str:
    return f"""(SELECT query_id, doc_id, rank FROM (SELECT q.query_id, d.doc_id,
      row_number() OVER (PARTITION BY q.query_id ORDER BY coalesce(s.score, 0) DESC, d.doc_id) - 1 AS rank
      FROM (SELECT item_id AS query_id FROM benchmark) q CROSS JOIN documents d LEFT JOIN {source} s ON s.query_id = q.query_id AND s.doc_id = d.doc_id){f" WHERE rank < {depth}" if depth else ""})"""


FIELDS = f"""fc AS (SELECT p_partkey AS id, {B.FIELD_EN} AS en_text, {B.FIELD_FLAVOR} AS en_flavor FROM part),
  ex AS (SELECT id AS card_id, 0 AS seq, 'text' AS field, trim(en_text) AS text FROM fc WHERE trim(coalesce(en_text, '')) <> ''
         UNION ALL SELECT id, 1, 'flavor', trim(en_flavor) FROM fc WHERE trim(coalesce(en_flavor, '')) <> '')"""
OUTCOMES = f"""{FIELDS}, rec AS ({B.records_sql("rule")} UNION ALL {B.records_sql("flavor")}),
  oc AS (SELECT ex.card_id, ex.field, trim(coalesce(draft_ko, '')) AS draft, CASE WHEN route IS NULL THEN 'approval_incomplete'
      WHEN trim(coalesce(draft_ko, '')) = '' THEN CASE WHEN empty_cause IN ('tm_search_failure', 'guard_rejected_in_review_queue', 'approval_incomplete', 'model_invocation_failure') THEN empty_cause
           WHEN interrupted THEN 'guard_rejected_in_review_queue' ELSE 'tm_search_failure' END END AS cause
    FROM ex LEFT JOIN rec ON rec.card_id = ex.card_id AND CASE route WHEN 'rule' THEN 'text' ELSE 'flavor' END = ex.field),
  syn AS (SELECT fc.id AS card_id, coalesce(n, 0) AS field_count, coalesce(ok, true) AS compliant, CASE WHEN coalesce(ok, true) THEN coalesce(t, '') ELSE '' END AS card_prediction
    FROM fc LEFT JOIN (SELECT card_id, count(*) AS n, bool_and(cause IS NULL) AS ok, max(draft) FILTER (field = 'text') AS t FROM oc GROUP BY card_id) o ON o.card_id = fc.id)"""
JUDGED = """jc AS (SELECT DISTINCT p_name AS en_term, p_type AS ko_term FROM part),
  jj AS (SELECT en_term, ko_term, arg_max(accepted, seq) AS accepted FROM (
    SELECT p_name AS en_term, p_type AS ko_term, p_size % 2 = 0 AS accepted, p_partkey AS seq FROM part WHERE p_size % 3 = 0 AND p_partkey % 10 <> 0) GROUP BY ALL)"""
GOLD = """gold AS (SELECT * FROM (VALUES ('the', ['of'], 'aided'), ('of_the', ['the'], 'aided'), ('la', ['la'], 'unaided'), ('a b c d', ['x'], 'unaided'), ('nation_0', ['x'], 'aided'),
    ('zzzz', ['x'], 'unaided'), ('und', ['und', 'der'], 'aided')) v(en, ko, source)),
  endf AS (SELECT term, count(*) AS df FROM en GROUP BY term),
  cutoff AS (SELECT CASE WHEN count(*) > 1500 THEN (SELECT min(df) FROM (SELECT df FROM endf WHERE df >= 5 ORDER BY df DESC LIMIT 1500)) END AS boundary FROM endf WHERE df >= 5),
  sc AS (SELECT g.en, g.source, CASE WHEN bool_or(c.ko_term IS NOT NULL) THEN 'found' WHEN replace(g.en, '_', ' ') IN (SELECT replace(lower(n_name), '_', ' ') FROM nation) THEN 'official_excluded'
      WHEN len(string_split(replace(g.en, '_', ' '), ' ')) > 3 THEN 'over_max_n' WHEN coalesce(max(e.df), 0) < 5 THEN 'below_min_cooccur' WHEN max(e.df) < max(boundary) THEN 'below_rank_cut' ELSE 'missed' END AS reach,
      bool_or(list_contains(g.ko, c.ko_term)) AS ko_match
    FROM gold g LEFT JOIN capped c ON c.en_term = replace(g.en, '_', ' ') LEFT JOIN endf e ON e.term = replace(g.en, '_', ' '), cutoff GROUP BY g.en, g.source)"""

ORACLES = {
    "term_candidates": f"WITH {CANDIDATES} SELECT en_term, ko_term, cooccurrence, dice, pmi FROM capped",
    "term_candidates_uncapped": f"WITH {CANDIDATES} SELECT en_term, ko_term, cooccurrence, dice, pmi FROM cands",
    "clean_corpus_filter": """SELECT c_custkey AS id, c_name AS en_text, '카드 ' || c_mktsegment AS ko_text, d.date FROM customer
      JOIN (SELECT o_custkey, strftime(min(o_orderdate), '%Y-%m-%d') AS date FROM orders GROUP BY 1) d ON d.o_custkey = c_custkey
      WHERE c_nationkey % 2 = 0 AND trim(c_name) <> '' AND substr(d.date, 1, 4)::INT BETWEEN 1992 AND 1995""",
    "flavor_pick_lowest": """SELECT coalesce(source, '') AS card_id, md5(arg_min(text, doc_id)) AS en_flavor, arg_min(lang, doc_id) AS ko_flavor
      FROM documents WHERE lang <> 'en' AND lang <> '' AND coalesce(text, '') <> '' GROUP BY 1""",
    "tokenize_stats": f"WITH {TEXTS} SELECT id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct FROM (SELECT id, {_tokens('en_text')} AS t FROM texts)",
    "ngram_df": f"WITH {PAIRS}, {_grams('en', EN_TOKENS)} SELECT term, count(*) AS df FROM en GROUP BY term HAVING count(*) >= 2",
    "frequency_sheet": f"""WITH {PAIRS}, {_grams('en', EN_TOKENS)},
      d AS (SELECT term, count(*) AS df, min(id) AS example FROM en GROUP BY term HAVING count(*) >= 5),
      f AS (SELECT *, string_split(term, ' ') AS w FROM d)
      SELECT term, df, example, rank <= 1500 AS in_cap FROM (SELECT *, row_number() OVER (ORDER BY df DESC, term) AS rank FROM f)
      WHERE w[1] NOT IN ({_list(FUNCTION_WORDS)}) AND w[-1] NOT IN ({_list(FUNCTION_WORDS)}) AND NOT regexp_matches(w[1], '^[0-9]+$') AND NOT regexp_matches(w[-1], '^[0-9]+$')
      ORDER BY df DESC, term LIMIT 500""",
    "subtype_pairs": f"WITH {KEYWORDS} SELECT en_term, ko_term, array_to_string(card_ids, '|') AS card_ids FROM kw",
    "subtype_conflicts": f"WITH {KW_CONFLICTS} SELECT en_term, array_to_string(v, '|') AS ko_variants, len(v) AS n_variants, len(v) > 1 AS is_conflict FROM kc",
    "sentence_patterns": f"""WITH {CARDS}, cards2 AS (SELECT id, en_text, ko_text || '. ok' AS ko_text FROM cards), split AS (SELECT doc_id AS id, coalesce(text, '') AS en_text, coalesce(text, '') AS ko_text FROM documents)
      SELECT md5(en_template) AS en_template, md5(ko_template) AS ko_template, count, examples FROM ({_patterns('split')} UNION ALL {_patterns('cards2')})""",
    "pattern_lookup": f"""WITH {CARDS}, cards2 AS (SELECT id, en_text, ko_text || '. ok' AS ko_text FROM cards), p AS ({_patterns('cards2')}),
      best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY en_template ORDER BY count DESC, ko_template) AS r FROM p) WHERE r = 1),
      asked AS (SELECT p_partkey AS id, {TEMPLATE.format("'Gain ' || p_partkey || ' [credit] when you break.'")} AS t FROM part)
      SELECT id, t AS en_template, ko_template, count FROM asked LEFT JOIN best ON en_template = t""",
    "glossary_match": f"WITH {TEXTS}, {GLOSSARY} SELECT id, en, ko, source FROM texts JOIN gl ON {_phrase('en_text', 'en')}",
    "glossary_violations": f"WITH {PAIRS}, {GLOSSARY} SELECT id, en, ko, source FROM pairs JOIN gl ON {_phrase('en_text', 'en')} WHERE NOT contains({TIGHT.format('ko_text')}, {TIGHT.format('ko')})",
    "gate1": f"""WITH {PAIRS}, {GLOSSARY}, h AS (SELECT NOT contains({TIGHT.format('ko_text')}, {TIGHT.format('ko')}) AS bad FROM pairs JOIN gl ON {_phrase('en_text', 'en')})
      SELECT count(*) AS n_checks, count(*) FILTER (bad) AS n_violations, round(coalesce((count(*) - count(*) FILTER (bad)) / nullif(count(*), 0), 1.0), 9) AS compliance,
             coalesce((count(*) - count(*) FILTER (bad)) / nullif(count(*), 0), 1.0) >= 0.95 AS passed FROM h""",
    "conflict_hits": f"WITH {CARDS}, {KW_CONFLICTS} SELECT id, en_term, array_to_string(v, '|') AS ko_variants FROM cards JOIN kc ON list_contains({_tokens('en_text')}, en_term) WHERE len(v) >= 2",
    "symbol_multiset": f"WITH {SYMBOLS} SELECT id, s AS symbol, n FROM se",
    "gate2_cards": f"WITH {SYMBOLS} SELECT * FROM g2",
    "gate2": f"WITH {SYMBOLS} SELECT count(*) AS n_cards, count(*) FILTER (passed) AS n_passed, round(coalesce(avg(passed::INT), 1.0), 9) AS preservation, coalesce(avg(passed::INT), 1.0) >= 1.0 AS passed FROM g2",
    "fidelity_violations": f"WITH {CARDS}, {FIDELITY} SELECT * FROM fid",
    "injection_scan": "WITH t AS (SELECT page_id AS id, coalesce(" + B.INJECTED + ", '') AS x FROM pages), p AS (SELECT * FROM (VALUES "
    + ", ".join(f"({i}, '(?i)(?:{rx})')" for i, rx in enumerate(INJECTIONS)) + ") v(pattern, rx))"
    + " SELECT id, 'source' AS side, pattern, m AS matched FROM (" + " UNION ALL ".join(f"SELECT id, {i} AS pattern, regexp_extract(x, '(?i)(?:{rx})') AS m FROM t" for i, rx in enumerate(INJECTIONS)) + ") WHERE m <> ''",
    "safe_wrap": """SELECT p_partkey AS id, '<card-text>' || chr(10) || p_name || CASE WHEN p_partkey % 2 = 0 THEN ' &lt;/card-text&gt; &lt;card-text&gt;' ELSE '' END || chr(10) || '</card-text>' AS wrapped FROM part""",
    "new_terms_classified": f"WITH {TEXTS}, {GLOSSARY}, {_new_terms('texts')} SELECT id, en_term, blocking FROM nt",
    "hitl_triggers": f"""WITH {CARDS}, rc AS (SELECT *, 'rule' AS route FROM cards), {GLOSSARY}, {_new_terms('rc')}, {KW_CONFLICTS}, {FIDELITY},
      gv AS (SELECT DISTINCT id FROM cards JOIN gl ON {_phrase('en_text', 'en')} WHERE NOT contains({TIGHT.format('ko_text')}, {TIGHT.format('ko')})),
      ch AS (SELECT DISTINCT id FROM cards JOIN kc ON list_contains({_tokens('en_text')}, en_term) WHERE len(v) >= 2),
      rr AS (SELECT id, array_to_string(list_filter([CASE WHEN id IN (SELECT id FROM nt WHERE blocking) THEN 'new_term' END, CASE WHEN id IN (SELECT id FROM ch) THEN 'term_conflict' END,
          CASE WHEN id IN (SELECT id FROM gv) OR id IN (SELECT id FROM fid) THEN 'rule_violation' END, CASE WHEN id % 200 > 0 AND 1.0::DOUBLE / (id % 200) < 0.01::DOUBLE THEN 'low_tm_confidence' END], lambda x: x IS NOT NULL), '|') AS reasons FROM cards)
      SELECT rr.id, reasons, reasons <> '' AS should_interrupt, coalesce(t, '') AS recording_terms FROM rr LEFT JOIN (SELECT id, string_agg(en_term, '|' ORDER BY pos) AS t FROM nt WHERE NOT blocking GROUP BY id) n ON n.id = rr.id""",
    "bm25_topk": f"WITH {BM25} {_top('bm')}",
    "char_tfidf_topk": f"WITH {CHAR} {_top('ch')}",
    "dense_topk": """WITH s AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, round(list_cosine_similarity(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 6) AS score
        FROM embeddings q JOIN embeddings d ON d.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS rank FROM s) WHERE rank < 5""",
    "rrf_topk": f"""WITH {BM25}, {CHAR}, u AS (SELECT 0 AS signal, * FROM {_full('bm')} UNION ALL SELECT 1, * FROM {_full('ch')}),
      f AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank + 1)), 12) AS score, min((signal, rank)) AS first FROM u GROUP BY ALL)
      SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, doc_id) - 1 AS rank FROM f) WHERE rank < 5""",
    "index_appended": f"""WITH {BM25}, {CHAR}, rb AS {_full('bm', None)}, rc AS {_full('ch', None)}, u AS (SELECT 0 AS signal, * FROM rb WHERE rank < 200 UNION ALL SELECT 1, * FROM rc WHERE rank < 200),
      f AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank + 1)), 12) AS score, min((signal, rank)) AS first FROM u GROUP BY ALL),
      t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, doc_id) - 1 AS rank FROM f)
      SELECT t.query_id, t.doc_id, t.rank, rb.rank AS bm25_rank, rc.rank AS char_rank, md5(coalesce(text, '')) AS text, lang
      FROM t JOIN rb USING (query_id, doc_id) JOIN rc USING (query_id, doc_id) JOIN documents USING (doc_id) WHERE t.rank < 3""",
    "tm_threshold_p20": """WITH r AS (SELECT l_extendedprice AS v, row_number() OVER (ORDER BY l_extendedprice) - 1 AS i, count(*) OVER () AS n FROM lineitem)
      SELECT max(v) FILTER (i = greatest(0, least(floor(20.0 / 100 * n), n - 1))) AS threshold, max(n) AS n, min(v) AS lowest, max(v) AS highest, median(v) AS median FROM r""",
    "split_holdout": "SELECT p_partkey, row_number() OVER (ORDER BY (p_partkey * 2654435761) % 1000003, p_partkey) <= 100 AS held FROM part",
    "field_expansion": f"WITH {FIELDS} SELECT card_id, field, CASE field WHEN 'text' THEN 'rule' ELSE 'flavor' END AS route, text AS en_text FROM ex",
    "card_synthesis": f"WITH {OUTCOMES} SELECT * FROM syn",
    "empty_causes": f"WITH {OUTCOMES} SELECT " + ", ".join(f"count(*) FILTER (cause = '{c}') AS {c}" for c in ("tm_search_failure", "guard_rejected_in_review_queue", "approval_incomplete", "model_invocation_failure")) + " FROM oc",
    "delivered_throughput": f"WITH {OUTCOMES} SELECT count(*) AS total, count(*) FILTER (card_prediction <> '') AS delivered, round(count(*) FILTER (card_prediction <> '') / count(*), 9) AS throughput FROM syn",
    "pending_ratio": f"""WITH {OUTCOMES} SELECT count(*) AS n_cards, count(w.card_id) AS n_pending, round(count(w.card_id) / count(*), 9) AS ratio
      FROM fc LEFT JOIN (SELECT DISTINCT card_id FROM rec WHERE interrupted AND card_id % 3 <> 0) w ON w.card_id = fc.id""",
    "echo_gate": """WITH e AS (SELECT p_partkey % 9 = 0 OR p_name = p_type AS echo, p_partkey % 8 = 0 AND (p_partkey % 9 <> 0 OR p_name = p_type) AS same FROM part WHERE p_partkey % 9 = 0 OR p_partkey % 10 <> 0),
      g AS (SELECT count(*) AS n_with_hits, count(*) FILTER (echo) AS n_echo, count(*) FILTER (same) AS n_coincidence FROM e)
      SELECT *, round(n_echo / n_with_hits, 9) AS rate, round(greatest(0.05, n_coincidence / n_with_hits), 9) AS threshold, n_echo / n_with_hits <= greatest(0.05, n_coincidence / n_with_hits) AS passed FROM g""",
    "per_model": f"""WITH {SYMBOLS}, m AS (SELECT 'm' || (p_size % 4) AS model_id, p_partkey AS id FROM part UNION SELECT 'm0', p_partkey FROM part WHERE p_partkey % 5 = 0)
      SELECT model_id, count(*) AS n_cards, count(*) FILTER (passed) AS n_passed, round(avg(passed::INT), 9) AS preservation FROM m JOIN g2 USING (id) GROUP BY model_id""",
    "ceiling_verdict": """WITH g AS (SELECT n_name AS gate, 0.5::DOUBLE AS threshold, n_nationkey / 20.0::DOUBLE AS ceiling, CASE WHEN n_nationkey % 6 = 0 THEN NULL ELSE n_regionkey / 4.0::DOUBLE END AS agent, n_nationkey % 2 = 0 AS higher_is_better FROM nation),
      m AS (SELECT *, CASE WHEN higher_is_better THEN ceiling >= threshold ELSE ceiling <= threshold END AS reachable, CASE WHEN higher_is_better THEN agent >= threshold ELSE agent <= threshold END AS ok FROM g)
      SELECT gate, threshold, ceiling, agent, higher_is_better, reachable, CASE WHEN NOT reachable OR agent IS NULL THEN 'UNREACHABLE' WHEN ok THEN 'PASS' ELSE 'FAIL' END AS verdict,
        round(CASE WHEN ceiling <> 0 THEN CASE WHEN higher_is_better THEN agent / ceiling WHEN agent <> 0 THEN ceiling / agent END END, 9) AS achievement FROM m""",
    "gate_combine": "SELECT bool_and(n_nationkey % 7 <> 0) AS passed, coalesce(string_agg(n_name, '|' ORDER BY n_name) FILTER (n_nationkey % 7 = 0), '') AS failed FROM nation",
    "final_verdict": "SELECT n_nationkey AS id, CASE WHEN n_regionkey = 0 THEN NULL ELSE n_nationkey % 5 <> 0 AND n_nationkey % 3 <> 0 AND n_nationkey <> 7 END AS final FROM nation",
    "observation_stats": """WITH s AS (SELECT 1 + p_size % 3 AS r, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE 1 + p_partkey % 3 END AS f FROM part)
      SELECT count(r) AS rule_n, round(avg(r), 9) AS rule_mean, median(r) AS rule_median, count(f) AS flavor_n, round(avg(f), 9) AS flavor_mean, median(f) AS flavor_median, avg(r) >= 2.5 AS rule_meets, avg(f) >= 2.0 AS flavor_meets FROM s""",
    "extraction_prf": f"""WITH {PAIRS}, f AS (SELECT DISTINCT replace(unnest({_tokens('text')}), '_', ' ') AS t FROM benchmark), g AS (SELECT DISTINCT replace(unnest({_tokens('en_text')}), '_', ' ') AS t FROM pairs),
      n AS (SELECT count(*) FILTER (f.t IS NOT NULL AND g.t IS NOT NULL) AS tp, count(*) FILTER (g.t IS NULL) AS fp, count(*) FILTER (f.t IS NULL) AS fn FROM f FULL JOIN g ON f.t = g.t)
      SELECT tp, fp, fn, round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 9) AS f1 FROM n""",
    "rule_gold_scorecard": f"WITH {CANDIDATES}, {GOLD} SELECT en, source, reach, ko_match, false AS mangled FROM sc",
    "gold_recall": f"""WITH {CANDIDATES}, {GOLD}, g AS (SELECT source, count(*) FILTER (reach IN ('found', 'missed')) AS scored, count(*) FILTER (reach = 'found') AS found, count(*) FILTER (ko_match) AS ko_correct FROM sc GROUP BY source)
      SELECT *, round(coalesce(found / nullif(scored, 0), 0.0), 9) AS recall, round(coalesce(ko_correct / nullif(found, 0), 0.0), 9) AS ko_accuracy FROM g""",
    "judge_pending": f"WITH {JUDGED} SELECT en_term, ko_term FROM jc WHERE NOT EXISTS (FROM jj WHERE jj.en_term = jc.en_term AND jj.ko_term = jc.ko_term)",
    "judge_accepted": f"WITH {JUDGED} SELECT en_term, ko_term FROM jc WHERE EXISTS (FROM jj WHERE jj.en_term = jc.en_term AND jj.ko_term = jc.ko_term AND accepted)",
    "judge_counters": f"WITH {JUDGED} SELECT count(*) FILTER (accepted) AS accepted, count(*) FILTER (NOT accepted) AS rejected, count(*) FILTER (accepted IS NULL) AS dropped FROM jc LEFT JOIN jj USING (en_term, ko_term)",
    "judge_fingerprint": "SELECT p_partkey, substr(sha256(p_name || chr(0) || p_type), 1, 16) AS fingerprint FROM part",
    "official_exclusion": "SELECT n_nationkey, n_name AS en_term FROM nation WHERE n_nationkey % 2 <> 0",
    "review_summary": f"WITH {KEYWORDS} SELECT en_term, ko_term, len(card_ids) AS n_cards, array_to_string(card_ids[1:4], '|') AS sample_ids FROM kw",
    "new_term_summary": """WITH r AS (SELECT p_name AS en_term, p_type AS k, CASE WHEN p_size % 2 = 0 THEN 'text' ELSE 'flavor' END AS f, CAST(p_size AS VARCHAR) AS s FROM part),
      k AS (SELECT en_term, string_agg(k || '=' || n, '|' ORDER BY k) AS renderings FROM (SELECT en_term, k, count(*) AS n FROM r GROUP BY ALL) GROUP BY en_term)
      SELECT en_term, count(*) AS n, any_value(renderings) AS renderings, array_to_string(list_sort(list(DISTINCT f)), '|') AS fields, min(s) AS first_submitted FROM r JOIN k USING (en_term) GROUP BY en_term""",
    "review_decisions": """SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE p_name END AS approved_ko, p_partkey % 2 = 0 AND p_type <> p_name AS modified,
      CASE WHEN p_partkey % 5 = 0 THEN 'hold' ELSE 'approved' END AS auto FROM part WHERE p_partkey % 3 = 0""",
    "lookup_term": f"""WITH {GLOSSARY}, a AS (SELECT DISTINCT item_id AS id, unnest({_tokens('text')}) AS en FROM benchmark)
      SELECT id, trim(replace(a.en, '_', ' ')) AS key, ko IS NOT NULL AS found, ko, source, CASE WHEN source IN ('official', 'subtype_extracted') THEN true WHEN source IS NOT NULL THEN false END AS llm_judged
      FROM a LEFT JOIN gl ON gl.en = trim(replace(a.en, '_', ' '))""",
    "check_translation": f"""WITH {CARDS}, {GLOSSARY}, {FIDELITY}, gv AS (SELECT id, count(*) AS n FROM cards JOIN gl ON {_phrase('en_text', 'en')} WHERE NOT contains({TIGHT.format('ko_text')}, {TIGHT.format('ko')}) GROUP BY id),
      ff AS (SELECT id, count(*) AS n FROM fid GROUP BY id)
      SELECT c.id, 0::BIGINT AS n_injection, coalesce(gv.n, 0) AS n_glossary, coalesce(ff.n, 0) AS n_fidelity, coalesce(gv.n, 0) + coalesce(ff.n, 0) = 0 AS passed FROM cards c LEFT JOIN gv ON gv.id = c.id LEFT JOIN ff ON ff.id = c.id""",
    "levenshtein_stats": """WITH d AS (SELECT round(levenshtein(p_name, lower(p_type)) / greatest(length(p_name), length(p_type)), 9) AS x FROM part)
      SELECT round(median(x), 9) AS median, round(avg(x), 9) AS mean, min(x) AS lowest, max(x) AS highest, median(x) <= 0.8 AS passed FROM d""",
    "release_dates": """SELECT CAST(o_custkey AS VARCHAR) AS card_id, min(CAST(2000 + o_orderkey % 97 AS VARCHAR) || '-01-02') AS date FROM orders WHERE o_orderkey % 97 % 10 <> 0 GROUP BY o_custkey""",
    "code_cards": "SELECT CAST(o_orderkey AS VARCHAR) AS code, CAST(max(o_custkey) AS VARCHAR) AS card_id FROM orders GROUP BY o_orderkey",
    "printing_flavor": """SELECT CAST(o_custkey AS VARCHAR) AS card_id, arg_min(o_orderpriority, CAST(o_orderkey AS VARCHAR)) AS en_flavor, '글 ' || arg_min(o_orderpriority, CAST(o_orderkey AS VARCHAR)) AS ko_flavor
      FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 GROUP BY o_custkey""",
    "keyword_codes": """SELECT CAST(p_size AS VARCHAR) AS card_id, arg_min(p_brand || '|' || p_type, CAST(p_partkey AS VARCHAR)) AS en_keywords, arg_min(p_brand || '|x', CAST(p_partkey AS VARCHAR)) AS ko_keywords
      FROM part WHERE p_partkey % 6 = 0 AND p_partkey % 10 <> 0 GROUP BY p_size""",
    "official_flat": "SELECT lower(n_name) AS id, arg_max(c || ':' || n_name, i) AS name FROM nation, (VALUES (0, 'card_subtypes'), (1, 'card_types'), (2, 'factions'), (3, 'card_cycles'), (4, 'card_sets')) v(i, c) WHERE n_nationkey % (i + 2) = 0 GROUP BY n_name",
    "gold_load": "SELECT n_name AS en, '가|' || lower(n_name) AS ko, CASE WHEN n_regionkey = 0 THEN 'aided' ELSE 'unaided' END AS source, n_name AS note FROM nation",
    "draft_scan": f"WITH rec AS ({B.records_sql('rule')} UNION ALL {B.records_sql('flavor')}) SELECT route, interrupted, count(*) AS n, count(draft_ko) AS n_drafts, sum(card_id)::BIGINT AS ids FROM rec GROUP BY ALL",
    "run_header": "SELECT 'real' AS run_mode, 'm1' AS primary_model_id, false AS mixed_run",
    "predictions_scan": "SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS pos, CASE WHEN n_nationkey % 5 = 0 THEN '' ELSE n_name END AS prediction FROM nation",
    "predictions_matched": "SELECT row_number() OVER (ORDER BY o_orderkey, o_orderpriority) - 1 AS pos, o_orderpriority || ' ' || o_orderkey AS prediction, CAST(o_orderkey AS VARCHAR) AS reference FROM orders",
    "split_sink": "SELECT p_partkey, p_name, CASE WHEN row_number() OVER (ORDER BY (p_partkey * 2654435761) % 1000003, p_partkey) <= 100 THEN 'hold_out' ELSE 'train' END AS side FROM part",
    "conflict_union": f"""WITH {KW_CONFLICTS}, n AS (SELECT en_term, count(*) AS n_with_ids, sum(len(card_ids))::BIGINT AS n_ids FROM kw GROUP BY en_term)
      SELECT kc.en_term, array_to_string(v, '|') AS ko_variants, n_with_ids, n_ids, 'subtype' AS source FROM kc JOIN n USING (en_term) WHERE len(v) > 1
      UNION ALL SELECT lower(p_brand), string_agg(DISTINCT p_type, '|' ORDER BY p_type), 0, 0, 'rule' FROM part GROUP BY 1 HAVING count(DISTINCT p_type) > 1""",
    "keyword_counts": """WITH k AS (SELECT len(string_split(p_name, ' ')) AS e, CASE WHEN p_partkey % 2 = 0 THEN list_append(string_split(p_type, ' '), 'PLUS') ELSE string_split(p_type, ' ') END AS k FROM part)
      SELECT count(*) AS with_keywords, count(*) FILTER (e <> len(k)) AS skipped_mismatch, coalesce(sum(len(list_filter(k, lambda x: x LIKE 'P%'))) FILTER (e = len(k)), 0)::BIGINT AS dropped_untranslated FROM k""",
    "asset_sink": f"""WITH {KW_CONFLICTS}, {CARDS}, cards2 AS (SELECT id, en_text, ko_text || '. ok' AS ko_text FROM cards), p AS ({_patterns('cards2')}), r AS (SELECT count(DISTINCT p_type) AS n FROM part GROUP BY lower(p_brand)), g AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS t FROM part),
      x AS (SELECT count(*) FILTER (en_term IS NOT NULL AND t IS NOT NULL) AS tp, count(*) FILTER (t IS NULL) AS fp, count(*) FILTER (en_term IS NULL) AS fn FROM kc FULL JOIN g ON kc.en_term = g.t)
      SELECT (SELECT count(*) FROM nation) AS n_official, (SELECT count(*) FROM nation) AS n_map, (SELECT count(*) FROM kc WHERE len(v) = 1) AS n_subtype, (SELECT count(*) FROM r WHERE n = 1) AS n_extracted,
        (SELECT count(*) FROM kc WHERE len(v) > 1) AS held_subtype, (SELECT count(*) FROM r WHERE n > 1) AS held, tp, fp, fn, false AS llm_judged, (SELECT count(*) FROM p) AS n_patterns, (SELECT sum(count)::BIGINT FROM p) AS n_sentences FROM x""",
    "approved_store": """SELECT CAST(p_partkey AS VARCHAR) AS card_id, 'text' AS field, p_name AS en_text, p_type AS ko_draft, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_type END AS approved_ko,
      p_partkey % 2 = 0 AND p_name <> p_type AS modified, CASE WHEN p_partkey % 4 = 0 THEN 'new_term' ELSE 'rule_violation' END AS reasons FROM part WHERE p_partkey % 3 = 0""",
    "new_term_store": """WITH a AS (SELECT * FROM part WHERE p_partkey % 12 = 0) SELECT p_brand AS en_term, CASE WHEN p_partkey % 8 = 0 THEN p_name ELSE '' END AS ko_rendering, CAST(p_partkey AS VARCHAR) AS source_card_id, 'text' AS source_field, p_name AS approved_ko_context FROM a
      UNION ALL SELECT p_type, '', CAST(p_partkey AS VARCHAR), 'text', p_name FROM a""",
    "judged_store": """WITH c AS (SELECT p_name AS en_term, p_type AS ko_term, sum(p_size) AS n FROM part GROUP BY ALL)
      SELECT en_term, ko_term, length(en_term) % 2 = 0 AS accepted, 'by length' AS reason FROM c WHERE en_term NOT LIKE 'a%' AND n % 5 = 0
      UNION ALL SELECT en_term, ko_term, n % 2 = 0, 'by count' FROM c WHERE en_term NOT LIKE 'a%' AND en_term NOT LIKE 'b%' AND n % 5 <> 0""",
    "judged_counts": "SELECT count(*) FILTER (e NOT LIKE 'a%' AND length(e) % 2 = 0) AS accepted, count(*) FILTER (e NOT LIKE 'a%' AND length(e) % 2 = 1) AS rejected, count(*) FILTER (e LIKE 'a%') AS dropped FROM (SELECT DISTINCT p_name AS e, p_type FROM part)",
    "draft_records": f"""WITH {FIELDS}, {GLOSSARY}, rc AS (SELECT card_id || ':' || field AS id, text AS en_text, card_id, field, CASE field WHEN 'text' THEN 'rule' ELSE 'flavor' END AS route FROM ex), {_new_terms('rc')},
      t AS (SELECT id, string_agg(en, '|' ORDER BY en) AS terms, count(*) FILTER (NOT contains(upper(en_text), ko)) AS bad FROM rc JOIN gl ON {_phrase('en_text', 'en')} GROUP BY id),
      n AS (SELECT id, string_agg(en_term, '|' ORDER BY pos) FILTER (NOT blocking) AS rec, count(*) FILTER (blocking) AS new FROM nt GROUP BY id),
      d AS (SELECT *, contains(en_text, 'steel') AS failed, CASE WHEN card_id % 3 = 0 THEN 0.0 ELSE 1.0::DOUBLE / (1 + card_id % 150) END AS conf FROM rc),
      g AS (SELECT id, array_to_string(list_filter([CASE WHEN n.new > 0 THEN 'new_term' END, CASE WHEN t.bad > 0 THEN 'rule_violation' END, CASE WHEN conf < 0.01 THEN 'low_tm_confidence' END], lambda x: x IS NOT NULL), '|') AS guards FROM d LEFT JOIN t USING (id) LEFT JOIN n USING (id))
      SELECT d.id, CASE WHEN failed THEN '' ELSE upper(en_text) END AS draft_ko, CASE WHEN NOT failed THEN 'm1' END AS model_id, CASE WHEN failed THEN 'model_invocation_failure' END AS empty_cause, CASE WHEN failed THEN 'no steel' END AS model_error,
        CASE WHEN failed OR card_id % 3 = 0 THEN 0 ELSE 1 END::BIGINT AS n_hits, CASE WHEN failed THEN '' ELSE coalesce(terms, '') END AS terms, round(CASE WHEN failed THEN 0.0 ELSE conf END, 9) AS tm_confidence,
        CASE WHEN failed THEN '' ELSE coalesce(rec, '') END AS recording, CASE WHEN failed THEN '' ELSE guards END AS guards, NOT failed AND guards <> '' AS interrupted
      FROM d JOIN g USING (id) LEFT JOIN t USING (id) LEFT JOIN n USING (id)""",
    "drafts_from_memory": f"""WITH {PAIRS}, {FIELDS}, documents AS (SELECT id AS doc_id, en_text AS text FROM pairs), benchmark AS (SELECT DISTINCT text AS item_id, text FROM ex), {BM25}, {CHAR},
      u AS (SELECT 0 AS signal, * FROM {_full('bm')} UNION ALL SELECT 1, * FROM {_full('ch')}),
      f AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank + 1)), 12) AS score, min((signal, rank)) AS first FROM u GROUP BY ALL),
      t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, doc_id) AS n FROM f),
      h AS (SELECT query_id, string_agg(doc_id, '|' ORDER BY n) AS hits, md5(string_agg(ko_text, '|' ORDER BY n)) AS targets, max(score) AS conf FROM t JOIN pairs ON id = doc_id WHERE n <= 3 GROUP BY query_id)
      SELECT card_id || ':' || field AS id, CASE WHEN contains(text, 'steel') THEN '' ELSE upper(text) END AS draft_ko, CASE WHEN contains(text, 'steel') THEN '' ELSE hits END AS hits,
        CASE WHEN contains(text, 'steel') THEN md5('') ELSE targets END AS targets, CASE WHEN contains(text, 'steel') THEN 0 ELSE round(conf, 9) END AS tm_confidence FROM ex JOIN h ON query_id = text""",
    "draft_prompts": f"""WITH {FIELDS}, {GLOSSARY}, rc AS (SELECT card_id, field, text AS en_text FROM ex),
      t AS (SELECT card_id, field, string_agg('  ' || en || ' → ' || ko, chr(10) ORDER BY en, ko) FILTER (source = 'official') AS official,
        string_agg('  ' || en || ' → ' || ko || '  [' || source || ', ' || CASE source WHEN 'extracted' THEN '{D.NOT_VALIDATED}' ELSE '{D.VALIDATED}' END || ']', chr(10) ORDER BY en, ko) FILTER (source <> 'official') AS other
        FROM rc JOIN gl ON {_phrase('en_text', 'en')} GROUP BY ALL),
      w AS (SELECT rc.card_id, rc.field, official, other, '<card-text>' || chr(10) || en_text || chr(10) || '</card-text>' AS x FROM rc LEFT JOIN t ON t.card_id = rc.card_id AND t.field = rc.field)
      SELECT card_id, field, '목록' AS stub, md5(concat_ws(chr(10), {_list(D.PROMPT)}, '{D.OFFICIAL}' || chr(10) || official, '{D.EXTRACTED}{D.UNJUDGED}' || chr(10) || other, '{D.MEMORY}', '  [1{D.MEMORY_EN}' || x,
        '{D.MEMORY_KO}<card-text>' || chr(10) || '목록' || chr(10) || '</card-text>', '{D.CARD}', x, '{D.ANSWER}')) AS prompt_md5 FROM w""",
    "model_counters": f"WITH {FIELDS}, x AS (SELECT contains(text, 'steel') AS failed FROM ex) SELECT CASE WHEN failed THEN '' ELSE 'm1' END AS model_id, count(*) AS n, count(*) FILTER (NOT failed) AS succeeded, count(*) FILTER (failed) AS failed FROM x GROUP BY x.failed",
    "observation_scores": "SELECT p_partkey AS card_id, 1 + (length(p_name) + length(p_type)) % 3 AS rule_score, CASE WHEN p_size % 2 = 0 AND p_size % 3 <> 0 THEN 1 + length(p_type) % 3 END AS flavor_score FROM part",
    "scoring_view": f"""WITH g AS ({B.GLOSSARY_SQL} UNION ALL SELECT CASE WHEN p_partkey % 2 = 0 THEN 'official' ELSE 'extracted' END, p_brand || '_' || p_size, CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE '카드 ' || p_type END FROM part),
      k AS (SELECT lower(trim(replace(en, '_', ' '))) AS en, ko, section AS source FROM g),
      r AS (SELECT *, row_number() OVER (PARTITION BY en ORDER BY list_position(['official', 'subtype_extracted', 'extracted'], source), ko) AS n FROM k WHERE en <> '' AND ko <> '')
      SELECT en, ko, source FROM r WHERE n = 1 AND regexp_matches(ko, '[가-힣]')""",
    "morphology_terms": rf"""WITH d AS (SELECT doc_id AS id, coalesce(text, '') AS ko_text FROM documents),
      w AS (SELECT id, unnest(t) AS w, generate_subscripts(t, 1) AS i FROM (SELECT id, {KO_TOKENS} AS t FROM d)),
      f AS (SELECT id, i, w, list_filter(regexp_extract_all(w, '[a-zA-Z]+|[0-9]+'), lambda x: regexp_matches(x, '^[0-9]') OR length(x) <> 2) AS f FROM w),
      n AS (SELECT id, i, array_to_string(list_transform(f, lambda x: CASE WHEN regexp_matches(x, '^[a-zA-Z]*en$') THEN x || '다' ELSE x END), ' ') AS n FROM f),
      g AS (SELECT id, count(*) AS c, md5(string_agg(n, ' ' ORDER BY i)) AS m FROM n WHERE n <> '' GROUP BY id)
      SELECT d.id, coalesce(c, 0) AS n_tokens, coalesce(m, md5('')) AS tokens FROM d LEFT JOIN g ON g.id = d.id""",
    "normalised_candidates": rf"""WITH {PAIRS}, {_grams("en", EN_TOKENS)},
      w AS (SELECT id, unnest(t) AS w, generate_subscripts(t, 1) AS i FROM (SELECT id, {KO_TOKENS} AS t FROM pairs)),
      f AS (SELECT id, i, list_filter(regexp_extract_all(w, '[a-zA-Z]+|[0-9]+'), lambda x: regexp_matches(x, '^[0-9]') OR length(x) <> 2) AS f FROM w),
      n AS (SELECT id, i, array_to_string(list_transform(f, lambda x: CASE WHEN regexp_matches(x, '^[a-zA-Z]*en$') THEN x || '다' ELSE x END), ' ') AS n FROM f),
      kn AS (SELECT id, list(n ORDER BY i) AS t FROM n WHERE n <> '' GROUP BY id), {_grams("ko", "t", "kn")},
      ef AS (SELECT term, count(*) AS ef FROM en GROUP BY term HAVING count(*) >= 5), kf AS (SELECT term, count(*) AS kf FROM ko GROUP BY term HAVING count(*) >= 5)
      SELECT e.term AS en_term, k.term AS ko_term, count(*) AS cooccurrence, round(2.0 * count(*) / (ef + kf), 9) AS dice, round(log2((count(*)::DOUBLE / n) / ((ef::DOUBLE / n) * (kf::DOUBLE / n))), 9) AS pmi
      FROM en e JOIN ef ON ef.term = e.term JOIN ko k ON k.id = e.id JOIN kf ON kf.term = k.term CROSS JOIN (SELECT count(*) AS n FROM pairs) GROUP BY e.term, k.term, ef, kf, n HAVING count(*) >= 5""",
    "fallback_counters": f"""WITH {FIELDS}, x AS (SELECT CASE WHEN length(text) % 2 <> 0 THEN 'm1' WHEN length(text) % 3 <> 0 THEN 'm2' ELSE '' END AS model_id FROM ex)
      SELECT model_id, count(*) AS n, count(*) FILTER (model_id <> '') AS succeeded, count(*) FILTER (model_id = '') AS failed FROM x GROUP BY model_id""",
    "morphology_gold": r"""WITH n AS (SELECT p_partkey AS id, list_transform(list_filter(string_split(p_name, ' '), lambda x: length(x) <> 2), lambda x: CASE WHEN x LIKE '%en' THEN x || '다' ELSE x END) AS n FROM part)
      SELECT id, array_to_string(list_concat(n, ['[credit]', 'ABC', '12']), ' ') AS norm FROM n""",
    "matched_pairs": "SELECT p_partkey AS id, p_name AS prediction, p_type AS reference FROM part",
    "record_references": f"""WITH rec AS ({B.records_sql('rule')} UNION ALL {B.records_sql('flavor')})
      SELECT card_id, CASE route WHEN 'rule' THEN 'text' ELSE 'flavor' END AS field, route, CASE WHEN card_id % 7 = 0 THEN '' WHEN route = 'rule' THEN p_type || ' x' WHEN card_id % 2 = 0 THEN p_brand ELSE '' END AS ref_ko FROM rec JOIN part ON p_partkey = card_id""",
    "per_model_gates": f"""WITH {SYMBOLS}, {GLOSSARY}, c1 AS (SELECT id, count(*) AS nc, count(*) FILTER (NOT contains({TIGHT.format('ko_text')}, {TIGHT.format('ko')})) AS nv FROM cards JOIN gl ON {_phrase('en_text', 'en')} GROUP BY id),
      m AS (SELECT 'm' || (p_size % 4) AS model_id, p_partkey AS id, p_partkey % 9 = 0 OR (p_partkey % 10 <> 0 AND p_name = p_type) AS echo, p_partkey % 9 = 0 OR p_partkey % 10 <> 0 AS live FROM part WHERE p_size % 4 < 3)
      SELECT model_id, count(*) AS n_cards, count(*) AS n_records, count(*) FILTER (passed) AS n_passed, round(avg(passed::INT), 9) AS preservation, round((sum(nc) - sum(nv)) / sum(nc), 9) AS compliance,
        round(median(round(levenshtein(p_name, p_type) / greatest(length(p_name), length(p_type)), 9)), 9) AS median_distance, round(count(*) FILTER (echo) / count(*) FILTER (live), 9) AS echo_rate
      FROM m JOIN g2 USING (id) JOIN part ON p_partkey = id LEFT JOIN c1 USING (id) GROUP BY model_id""",
    "corpus_head": "SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders ORDER BY date, id LIMIT 50",
    "hangul_flags": rf"""WITH {CARDS} SELECT id, {COND} AS n_conditions, regexp_matches(ko_text, '{KO_CONDITIONS}') AS ko_condition, array_to_string(regexp_extract_all(en_text, '\[{W}[\p{{L}}\p{{N}}_-]*\]'), '|') AS symbols FROM cards WHERE id % 5 > 1""",
    "lookup_response": f"""WITH {GLOSSARY}, a AS (SELECT id, unnest(t) AS en, generate_subscripts(t, 1) - 1 AS pos FROM (SELECT item_id AS id, {_tokens('text')} AS t FROM benchmark)) SELECT id, pos, trim(replace(a.en, '_', ' ')) AS key, CASE WHEN ko IS NULL THEN 'false' ELSE 'true' END AS found, ko
      FROM a LEFT JOIN gl ON gl.en = trim(replace(a.en, '_', ' '))""",
    "search_tm": f"""WITH {BM25}, {CHAR}, de AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, round(list_cosine_similarity(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 6) AS score
        FROM embeddings q JOIN benchmark ON item_id = q.vec_id, embeddings d JOIN documents ON documents.doc_id = d.vec_id),
      every AS (SELECT q.query_id, d.doc_id, row_number() OVER (PARTITION BY q.query_id ORDER BY coalesce(b.score, 0) DESC, d.doc_id) - 1 AS b, row_number() OVER (PARTITION BY q.query_id ORDER BY coalesce(c.score, 0) DESC, d.doc_id) - 1 AS c,
          row_number() OVER (PARTITION BY q.query_id ORDER BY coalesce(e.score, 0) DESC, d.doc_id) - 1 AS e
        FROM (SELECT item_id AS query_id FROM benchmark) q CROSS JOIN documents d LEFT JOIN bm b ON b.query_id = q.query_id AND b.doc_id = d.doc_id LEFT JOIN ch c ON c.query_id = q.query_id AND c.doc_id = d.doc_id LEFT JOIN de e ON e.query_id = q.query_id AND e.doc_id = d.doc_id),
      u AS (SELECT query_id, doc_id, 0 AS signal, b AS rank FROM every WHERE b < 200 UNION ALL SELECT query_id, doc_id, 1, c FROM every WHERE c < 200 UNION ALL SELECT query_id, doc_id, 2, e FROM every WHERE e < 200),
      f AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank + 1)), 12) AS score, min((signal, rank)) AS first FROM u GROUP BY ALL),
      t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, doc_id) - 1 AS rank FROM f)
      SELECT t.query_id, t.doc_id, score, t.rank, b AS bm25_rank, c AS char_rank, e AS dense_rank FROM t JOIN every USING (query_id, doc_id) WHERE t.rank < 5""",
    "gold_totals": f"""WITH {CANDIDATES}, {GOLD}, g AS (SELECT count(*) AS gold_size, count(*) FILTER (reach IN ('found', 'missed')) AS scored, count(*) FILTER (reach = 'found') AS found, count(*) FILTER (ko_match) AS ko_correct,
        count(*) FILTER (reach = 'official_excluded') AS official_excluded, count(*) FILTER (reach = 'over_max_n') AS over_max_n, count(*) FILTER (reach = 'below_min_cooccur') AS below_min_cooccur, count(*) FILTER (reach = 'below_rank_cut') AS below_rank_cut FROM sc)
      SELECT *, round(coalesce(found / nullif(scored, 0), 0.0), 9) AS recall, round(coalesce(ko_correct / nullif(found, 0), 0.0), 9) AS ko_accuracy FROM g""",
    "candidates_in_order": f"WITH {CANDIDATES}, o AS (SELECT en_term, ko_term, row_number() OVER (ORDER BY dice DESC, cooccurrence DESC, en_term, ko_term) AS place FROM capped) SELECT * FROM o WHERE place <= 100",
    "guarded_stream": f"""WITH {CARDS}, rc AS (SELECT *, 'rule' AS route FROM cards), {GLOSSARY}, {_new_terms('rc')}, {FIDELITY},
      gv AS (SELECT DISTINCT id FROM cards JOIN gl ON {_phrase('en_text', 'en')} WHERE NOT contains({TIGHT.format('ko_text')}, {TIGHT.format('ko')})),
      inj AS (SELECT id FROM cards WHERE """ + " OR ".join(f"regexp_matches({c}, '(?i)(?:{rx})')" for c in ("en_text", "ko_text") for rx in INJECTIONS) + """),
      r AS (SELECT array_to_string(list_filter([CASE WHEN id IN (FROM inj) THEN 'injection' END, CASE WHEN id IN (SELECT id FROM nt WHERE blocking) THEN 'new_term' END,
        CASE WHEN id IN (FROM gv) OR id IN (SELECT id FROM fid) THEN 'rule_violation' END], lambda x: x IS NOT NULL), '|') AS reasons FROM cards)
      SELECT reasons, count(*) AS n FROM r GROUP BY reasons""",
    "event_stream": "SELECT date_trunc('hour', CAST(ts AS TIMESTAMP)) AS hour, event_type, count(DISTINCT event_id) AS n FROM events GROUP BY ALL",
    "awaited_stream": """SELECT CASE WHEN p_size % 2 = 0 THEN 'text' ELSE 'flavor' END AS field, CASE WHEN p_partkey % 3 <> 0 OR p_partkey % 5 = 0 THEN 'approval_incomplete'
      WHEN p_partkey % 2 = 0 AND p_brand <> p_type THEN 'modified' ELSE 'approved' END AS outcome, count(*) AS n FROM part GROUP BY ALL""",
    "approved_stream": "SELECT CASE WHEN p_size % 2 = 0 THEN 'text' ELSE 'flavor' END AS field, p_partkey % 2 = 0 AND p_brand <> p_type AS modified, count(*) AS n FROM part WHERE p_partkey % 3 = 0 GROUP BY ALL",
}
