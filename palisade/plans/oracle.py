"""DuckDB SQL that gives the same columns and rows as the queries of the same names."""

from __future__ import annotations

import yaml

from palisade.functions import detect, scores
from palisade.functions import text as T
from palisade.operators import candidates
from palisade.plans import dims, rules
from palisade.sources import config


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(xs) -> str:
    return "[" + ", ".join(_q(x) for x in xs) + "]::VARCHAR[]"


# RE2 knows no Unicode word boundary, so boundaries are plain there; the tables' personal data is ASCII.
def _re(category: str) -> str:
    return _q(next(p for c, _, p in detect.PATTERNS if c == category))


_SEV = dict((c, s) for c, s, _ in detect.PATTERNS)
_RANK = "list_position(['info','low','medium','high','critical'], {})"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"



def _luhn(d: str) -> str:
    """Whether the digits d are 13 to 19 and have a right check digit."""
    twice = f"CAST({d}[i] AS INT) * 2"
    return f"(len({d}) BETWEEN 13 AND 19 AND list_sum([CASE WHEN (len({d}) - i) % 2 = 0 THEN CAST({d}[i] AS INT) WHEN {twice} > 9 THEN {twice} - 9 ELSE {twice} END FOR i IN range(1, len({d}) + 1)]) % 10 = 0)"


_SAID_SSN = "regexp_matches({}, '(?i)\\b(ssn|social\\s+security)\\b')"
_GOOD_SSN = "(substr(replace(m, '-', ''), 1, 3) NOT IN ('000', '666') AND NOT starts_with(m, '9') AND substr(replace(m, '-', ''), 4, 2) <> '00' AND substr(replace(m, '-', ''), 6, 4) <> '0000' AND (contains(m, '-') OR said))"
_BARE = "regexp_replace(v, '[.!?:)\\]}]+$', '')"
_GOOD_CREDENTIAL = f"(a <> '' OR (len({_BARE}) >= 6 AND (regexp_matches({_BARE}, '[^\\p{{L}}]') OR (regexp_matches({_BARE}, '(?s)^.+\\p{{Lu}}') AND regexp_matches(v, '\\p{{Ll}}')))))"


def _checked(source: str, key: str, text: str) -> str:
    """CTE matched(key..., category, m): the valid matches of the three categories whose matches are checked."""
    cred = [f"unnest(regexp_extract_all({text}, {_re('secret.credential')}, {g})) AS {n}" for g, n in ((0, "m"), (1, "a"), (3, "v"))]
    return f"""matched AS (
  SELECT {key}, 'pii.credit_card' AS category, m FROM (SELECT {key}, m, regexp_replace(m, '[^0-9]', '', 'g') AS d FROM (SELECT {key}, unnest(regexp_extract_all({text}, {_re('pii.credit_card')})) AS m FROM {source})) WHERE {_luhn('d')}
  UNION ALL SELECT {key}, 'pii.ssn', m FROM (SELECT {key}, {_SAID_SSN.format(text)} AS said, unnest(regexp_extract_all({text}, {_re('pii.ssn')})) AS m FROM {source}) WHERE {_GOOD_SSN}
  UNION ALL SELECT {key}, 'secret.credential', m FROM (SELECT {key}, {", ".join(cred)} FROM {source}) WHERE {_GOOD_CREDENTIAL})"""


def _findings(source: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    """CTEs up to findings(key..., category, severity, n) of all categories."""
    plain = " UNION ALL ".join(f"SELECT {key}, '{c}' AS category, len(regexp_extract_all({text}, {_re(c)})) AS n FROM {source}" for c in detect.CATEGORIES if c not in detect.CHECKED)
    return f"""{_checked(source, key, text)}, counted AS ({plain} UNION ALL SELECT {key}, category, count(*) FROM matched GROUP BY ALL),
findings AS (SELECT {key}, category, CASE category {" ".join(f"WHEN '{c}' THEN '{s}'" for c, s in _SEV.items())} END AS severity, CAST(n AS INT) AS n FROM counted WHERE n > 0)"""


def _redacted() -> str:
    """CTEs up to redacted(doc_id, text, r): each category in order; of the checked ones the matches found in the original, longest first."""
    longest = "[x.m FOR x IN list_sort([{'l': -len(m), 'm': m} FOR m IN list_distinct(ms)])]"
    put, of = "text", []
    for c in detect.CATEGORIES:
        if c in detect.CHECKED:
            name = c.split(".")[1]
            of.append(f"{name} AS (SELECT doc_id, {longest.replace('ms', 'list(m)')} AS ms FROM matched WHERE category = '{c}' GROUP BY doc_id)")
            put = f"list_reduce(list_prepend({put}, coalesce({name}.ms, [])), lambda t, m: replace(t, m, '[REDACTED:{c}]'))"
        else:
            put = f"regexp_replace({put}, {_re(c)}, '[REDACTED:{c}]', 'g')"
    joins = " ".join(f"LEFT JOIN {c.split('.')[1]} ON {c.split('.')[1]}.doc_id = d.doc_id" for c in detect.CHECKED)
    return f"{_checked('documents', 'doc_id', 'text')}, {', '.join(of)}, redacted AS (SELECT d.doc_id, text, {put} AS r FROM documents d {joins})"


_FINDINGS = _findings()
_CARDS = f"cards AS (SELECT doc_id, d FROM (SELECT doc_id, regexp_replace(m, '[^0-9]', '', 'g') AS d FROM (SELECT doc_id, unnest(regexp_extract_all(text, {_re('pii.credit_card')})) AS m FROM documents)) WHERE {_luhn('d')})"
_VERDICTS = """verdicts AS (SELECT d.doc_id, max({rank}) AS r, count(f.category) AS k FROM documents d LEFT JOIN findings f USING (doc_id) GROUP BY d.doc_id)""".format(rank=_RANK.format("severity"))
_SEVERITY_OF = "list_extract(['info','low','medium','high','critical'], r)"

_COMMON = _list(T.COMMON_WORDS)
_CONTROL = _list(detect.CONTROL_WORDS)
_SCORE = "len(list_filter(regexp_extract_all(lower({}), '[a-z]+'), lambda w: list_contains(" + _COMMON + ", w)))"
_INVIS = "[" + T.INVISIBLE + "\\x{E0000}-\\x{E007F}]"
# White space and word characters of all scripts, as Spark's (?U) has them.
_WS = "[\\t-\\r \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
_FOLDED = f"regexp_replace(translate(regexp_replace(text, '{_INVIS}', '', 'g'), '{T.LOOKALIKE_FROM}', '{T.LOOKALIKE_TO}'), '{_WS}+', ' ', 'g')"


def _entropy(text: str, keys: str, source: str) -> str:
    """SELECT of keys and bits: entropy over characters of a text."""
    return f"SELECT {keys}, -sum(p * log2(p)) AS bits FROM (SELECT {keys}, c, count(*) / sum(count(*)) OVER (PARTITION BY {keys}) AS p FROM (SELECT {keys}, unnest(string_split({text}, '')) AS c FROM {source}) GROUP BY {keys}, c) GROUP BY {keys}"


_TOKENS = "list_distinct(list_filter([regexp_replace(t, '[._\\-/+@]+$', '') FOR t IN regexp_extract_all(lower(text), '[a-z0-9][a-z0-9._@+/-]{2,}')], lambda t: len(t) >= 3))"
_DIGESTS = f"[substr(sha256(t), 1, 16) FOR t IN {_TOKENS}]"

_TOOLS = "tools(tool_name, tags, transport, irreversibility, source) AS (VALUES " + ", ".join(f"('{t}', {_list(g)}, '{tr}', '{irr}', {_q(s) if s else 'NULL'})" for t, g, tr, irr, _, s in dims.TOOLS) + ")"
_AGENTS = "agents(agent_id, sub_agent_id, names, allowed) AS (VALUES " + ", ".join(f"('{a}', {_q(s) if s else 'NULL'}, {_list(n)}, {_list(t)})" for a, s, n, t in dims.AGENTS) + ")"
_SOURCES = "sources(source, url, required) AS (VALUES " + ", ".join(f"('{s}', {_q(u) if u else 'NULL'}, {str(r).lower()})" for s, u, r in dims.SOURCES) + ")"
_CALLS = "calls AS (SELECT event_id, ts, 'a' || (user_id % 5) AS agent_id, user_id, event_type AS tool_name, CAST(value AS VARCHAR) AS v_value, value AS num, props->>'$.k' AS v_k FROM events)"
_VIOLATION = """CASE tool_name WHEN 'click' THEN CASE WHEN num > 95 THEN 'argument ''value'' exceeds its maximum' END
 WHEN 'purchase' THEN CASE WHEN num > 90 THEN 'argument ''value'' exceeds its maximum' WHEN num < 2 THEN 'argument ''value'' is below its minimum' WHEN v_k IS NOT NULL AND NOT regexp_matches(v_k, '^[0-9]$') THEN 'argument ''k'' does not match its pattern' END
 WHEN 'error' THEN 'argument ''note'' is missing'
 WHEN 'signup' THEN CASE WHEN v_k IS NOT NULL AND v_k NOT IN ('1','2','3','4','5','6','7','8','9') THEN 'argument ''k'' is not in the allowed set' END END"""
_RULE = "CASE WHEN tool_name = 'view' THEN 'web-ok' WHEN transport = 'mcp' AND agent_id = 'a1' THEN 'no-mcp-a1' WHEN tool_name = 'purchase' AND agent_id <> 'a2' THEN 'mask-purchases' WHEN tool_name = 'signup' AND agent_id = 'a3' THEN 'no-signup' END"
_ACTION = "CASE rule WHEN 'web-ok' THEN 'allow' WHEN 'mask-purchases' THEN 'redact' WHEN 'no-mcp-a1' THEN 'deny' WHEN 'no-signup' THEN 'deny' ELSE 'allow' END"

_TURNS = "turns AS (SELECT conv_id AS session_id, turn AS turn_index, text, CASE WHEN len(text) % 5 = 0 THEN 'block' WHEN len(text) % 3 = 0 THEN 'warn' ELSE 'allow' END AS status, (len(text) % 10) / 100.0::DOUBLE AS density, CASE WHEN len(text) % 7 = 0 THEN 0.65 ELSE 0.1 END AS turn_risk FROM conversations)"
_WORDS = "regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}\\p{Pc}]+')"
_BIGRAMS = f"(CASE WHEN len({_WORDS}) = 0 THEN []::VARCHAR[] WHEN len({_WORDS}) = 1 THEN [{_WORDS}[1] || ' '] ELSE list_distinct([{_WORDS}[i] || ' ' || {_WORDS}[i + 1] FOR i IN range(1, len({_WORDS}))]) END)"
_JAC = "(CASE WHEN pb IS NULL OR len(list_distinct(list_concat(b, pb))) = 0 THEN 0.0 ELSE len(list_intersect(b, pb)) / len(list_distinct(list_concat(b, pb)))::DOUBLE END)"
_SCORES = f"""{_TURNS},
bg AS (SELECT *, {_BIGRAMS} AS b FROM turns),
pv AS (SELECT *, lag(b) OVER (PARTITION BY session_id ORDER BY turn_index) AS pb FROM bg),
rf AS (SELECT *, status IN ('warn', 'block') AND {_JAC} >= 0.72 AS reframe FROM pv),
sc AS (SELECT session_id, turn_index, reframe, least(1.0, 0.60 * avg(CASE WHEN status = 'block' OR turn_risk >= 0.6 THEN 1.0 ELSE 0 END) OVER w + 0.25 * avg(CASE WHEN status IN ('warn', 'block') THEN 1.0 ELSE 0 END) OVER w
  + CASE WHEN reframe THEN 0.30 ELSE 0 END + CASE WHEN avg(density) OVER w >= 0.05 THEN 0.25 ELSE 0 END + CASE WHEN max(turn_risk) OVER w >= 0.6 THEN 0.35 ELSE 0 END) AS score
  FROM rf WINDOW w AS (PARTITION BY session_id ORDER BY turn_index ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))"""

_EVIDENCE = """ev AS (SELECT conv_id AS conversation_id, turn // 4 AS turn_id, turn AS seq, CASE role WHEN 'user' THEN 'input' WHEN 'assistant' THEN 'gate' ELSE 'tool_result' END AS boundary,
  CASE WHEN len(text) % 4 = 0 THEN 'block' WHEN len(text) % 3 = 0 THEN 'warn' ELSE 'allow' END AS status,
  CASE WHEN len(text) % 4 = 0 THEN 'prompt_injection' WHEN len(text) % 3 = 0 THEN 'tool_injection' END AS cat, CASE WHEN len(text) % 3 = 0 THEN 2 ELSE 1 END AS fam, len(text) % 2 = 0 AS ok FROM conversations),
sig AS (SELECT conversation_id, turn_id, arg_max(status, seq) FILTER (boundary = 'input') AS input_status, coalesce(arg_max(coalesce(cat, ''), seq) FILTER (boundary = 'input'), '') AS input_categories,
  coalesce(max(fam) FILTER (boundary = 'input'), 0) AS n_families, CASE WHEN count(*) FILTER (boundary = 'gate') > 0 THEN CASE WHEN arg_max(ok, seq) FILTER (boundary = 'gate') THEN 'allowed' ELSE 'denied' END END AS gate,
  list_extract(['allow', 'warn', 'block'], max(list_position(['allow', 'warn', 'block'], status)) FILTER (boundary = 'tool_result')) AS result_status,
  coalesce(string_agg(DISTINCT cat, ',' ORDER BY cat) FILTER (boundary = 'tool_result'), '') AS result_categories FROM ev GROUP BY conversation_id, turn_id)"""
_RISK = """rk AS (SELECT *, input_categories <> '' AS inj, result_categories <> '' AS back, input_categories <> '' AND contains(result_categories, input_categories) AS shared FROM sig),
risk AS (SELECT *, 1 - exp(-(CASE input_status WHEN 'block' THEN 0.45 WHEN 'warn' THEN 0.18 ELSE 0 END + CASE input_categories WHEN 'tool_injection' THEN 0.15 WHEN 'prompt_injection' THEN 0.10 ELSE 0 END
  + CASE WHEN n_families >= 2 THEN 0.07 ELSE 0 END + CASE WHEN gate = 'denied' THEN 0.08 WHEN gate = 'allowed' AND inj THEN 0.18 ELSE 0 END
  + CASE result_status WHEN 'block' THEN 0.28 WHEN 'warn' THEN 0.12 ELSE 0 END + CASE WHEN shared THEN 0.12 ELSE 0 END + CASE WHEN back AND gate = 'allowed' THEN 0.08 ELSE 0 END)
  * CASE WHEN inj AND gate = 'allowed' AND back THEN 1.20 WHEN inj AND gate = 'allowed' THEN 1.08 ELSE 1 END) AS r FROM rk)"""
_LINES = "lines AS (SELECT event_id AS line_no, CASE WHEN event_id % 97 = 0 THEN NULL ELSE event_type END AS boundary, CASE WHEN event_id % 97 = 0 THEN NULL WHEN value >= 50 THEN 'deny' ELSE 'allow' END AS decision, CAST(user_id AS VARCHAR) AS agent_id FROM events)"
_MINHASH = "[list_min([CAST('0x' || substr(md5(s || ':' || b), 1, 8) AS BIGINT) FOR b IN bg]) FOR s IN range(64)]"
_CHARS = "list_distinct([substr(lower(text), i, 2) FOR i IN range(1, len(text))])"
_PAIRS = "(CASE WHEN len(text) > 1 THEN list_distinct([substr(text, i, 2) FOR i IN range(1, len(text))]) ELSE [text] END)"
_MARK = _q(detect.MARKUP)
_BARE_URL = "regexp_replace(regexp_replace(url, '[?#].*$', ''), '^([A-Za-z][A-Za-z0-9+.\\-]*://)[^/@]*@', '\\1')"



def _score(patterns: list[str], flags: str = "") -> str:
    return "(" + " + ".join(f"CAST(regexp_matches(text, {_q((f'(?{flags})' if flags else '') + p)}) AS INT)" for p in patterns) + ")"


_INTENT = _score([rf"\b{v}\b(?:\W+\w+){{0,5}}\W+\b{n}\b" for v, n in scores.VERB_NOUNS]) + " + " + _score([rf"\A{v}\b" for v in scores.IMPERATIVES]).replace("regexp_matches(text", "regexp_matches(trim(text)")
_OBFUSCATION = "(len(regexp_extract_all(text, '[\\x{200B}\\x{200C}\\x{200D}\\x{2060}]')) + len(regexp_extract_all(text, '\\p{L}')) - len(regexp_extract_all(text, '[A-Za-z]')))"
_PERSONA = "(" + _score([rf"\b{a}\b" for a in scores.ALIASES if a != "dan"], "i") + f" + CASE WHEN regexp_matches(text, {_q('(?i)' + scores.RESEARCH)}) THEN 0 ELSE {_score([chr(92) + 'bdan' + chr(92) + 'b'], 'i')} END)"
# Which lines of the log are altered, unsigned or no JSON follows from their numbers.
_SIGNED = "classed AS (SELECT event_id AS line_no, CASE WHEN event_id % 97 = 0 THEN 'malformed' WHEN event_id % 7 = 0 THEN 'unsigned' WHEN event_id % 10 = 0 THEN 'mismatched' ELSE 'ok' END AS class FROM events)"


def _bucket(score: str) -> str:
    return f"(CASE WHEN {score} <= 0 THEN 'none' WHEN {score} < 1 THEN 'low' WHEN {score} < 1.5 THEN 'medium' ELSE 'high' END)"


def _rule_row(scanner: str, rule: dict) -> str:
    match, strings = rule.get("match", "any"), rule["strings"]
    every = match["all"] if match != "any" else list(strings)
    n = sum(1 if isinstance(g, str) else len(g) for g in every)
    within = match.get("within_chars") if match != "any" else None
    return f"({_q(scanner)}, {_q(rule['name'])}, {_q(rule['meta']['category'])}, {_q(rule['meta']['severity'])}, '{'any' if match == 'any' else 'all'}', {'NULL' if within is None else within}::INT, {n}::INT)"


ORACLES: dict[str, str] = {
    "pii_findings": f"WITH {_FINDINGS} SELECT doc_id, category, severity, n FROM findings",
    "pii_page_findings": f"WITH {_findings('pages', 'page_id', 'html')} SELECT page_id, category, n FROM findings",
    "pii_luhn_cards": f"WITH {_CARDS} SELECT doc_id, sha256(d) AS card_sha256, count(*) AS n FROM cards GROUP BY ALL",
    "pii_redacted": f"WITH {_redacted()} SELECT doc_id, sha256(r) AS redacted_sha256, CAST(len(r) AS INT) AS n_chars FROM redacted WHERE r <> text",
    "scan_verdict_rollup": f"WITH {_FINDINGS}, {_VERDICTS} SELECT CASE WHEN r >= 4 THEN 'block' ELSE 'allow' END AS status, {_SEVERITY_OF} AS max_severity, count(*) AS n_docs, CAST(sum(k) AS BIGINT) AS n_findings FROM verdicts GROUP BY ALL",
    "severity_threshold": f"WITH {_FINDINGS} SELECT block_at, count(DISTINCT doc_id) AS n_docs, count(*) AS n_findings FROM findings, (VALUES ('low'), ('medium'), ('high')) b(block_at) WHERE {_RANK.format('severity')} >= {_RANK.format('block_at')} GROUP BY block_at",
    "ensemble_promotion": f"""WITH {_FINDINGS}, both_ AS (SELECT doc_id, category, severity, 'regex_pii' AS family FROM findings UNION ALL SELECT f.doc_id, category, severity, 'structural' FROM findings f JOIN documents d ON d.doc_id = f.doc_id AND d.n_chars >= 1500),
g AS (SELECT doc_id, category, sum(CASE severity WHEN 'info' THEN 0 WHEN 'low' THEN 1 WHEN 'medium' THEN 3 WHEN 'high' THEN 6 ELSE 10 END) >= 4 AND count(DISTINCT family) >= 2 AS up FROM both_ GROUP BY ALL)
SELECT b.category, severity, CASE WHEN up AND severity IN ('info', 'low', 'medium') THEN 'high' ELSE severity END AS promoted, count(*) AS n FROM both_ b JOIN g ON b.doc_id = g.doc_id AND b.category = g.category GROUP BY ALL""",
    "view_merge": f"WITH f0 AS (SELECT doc_id, trim({_FOLDED}) AS t FROM documents), v AS (SELECT doc_id, 0 AS p, t FROM f0 UNION ALL SELECT doc_id, 1, reverse(t) FROM f0 UNION ALL SELECT doc_id, 2, translate(t, {_q(T._A)}, {_q(T._Z)}) FROM f0), {_findings('v', 'doc_id, p', 't')} SELECT doc_id, category, severity, CAST(min(p) AS INT) AS view_pos FROM findings GROUP BY ALL",
    "on_error_policies": "SELECT policy, CASE WHEN len(text) >= 100 OR policy = 'fail_open' THEN 'allow' WHEN policy = 'fail_closed' THEN 'block' ELSE 'warn' END AS status, count(*) AS n FROM documents, (VALUES ('fail_closed'), ('fail_open'), ('degrade')) p(policy) GROUP BY ALL",
    "block_at_tightening": f"WITH {_FINDINGS}, m AS (SELECT doc_id, max({_RANK.format('severity')}) AS r FROM findings GROUP BY doc_id) SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'medium' ELSE 'high' END AS block_at, r >= CASE WHEN doc_id % 6 = 0 THEN 3 ELSE 4 END AS blocked FROM m",
    "detector_eval": f"WITH {_FINDINGS}, {_VERDICTS} SELECT quality, toxic, CASE WHEN r >= 3 THEN 'block' ELSE 'allow' END AS status, count(*) AS n FROM labels JOIN verdicts USING (doc_id) GROUP BY ALL",
    "norm_strip_translate": f"SELECT doc_id, CAST(len(f) AS INT) AS n_chars, sha256(f) AS folded_sha256 FROM (SELECT doc_id, trim({_FOLDED}) AS f FROM documents)",
    "norm_rot13_reverse_gate": f"SELECT doc_id, CAST({_SCORE.format('text')} AS INT) AS words, CAST({_SCORE.format(f'translate(text, {_q(T._A)}, {_q(T._Z)})')} AS INT) AS words_rot13, text <> reverse(text) AND {_SCORE.format('reverse(text)')} > {_SCORE.format('text')} AS reversed_kept FROM documents",
    "norm_split_glued": "SELECT doc_id, CAST(len(list_filter(range(1, len(text)), lambda i: (regexp_matches(text[i], '[a-z0-9]') AND regexp_matches(text[i + 1], '[A-Z]')) OR (regexp_matches(text[i], '[A-Z]') AND regexp_matches(text[i + 1 : i + 2], '^[A-Z][a-z]')) OR (regexp_matches(text[i], '[0-9]') AND regexp_matches(text[i + 1], '[A-Za-z]')))) AS INT) AS n_splits FROM documents",
    "text_entropy": f"SELECT conv_id, turn, round(bits, 6) AS bits FROM ({_entropy('text', 'conv_id, turn', 'conversations')})",
    "entropy_windows": f"WITH w AS (SELECT conv_id, turn, i, CASE WHEN len(text) < 64 THEN text ELSE substr(text, CAST(i + 1 AS BIGINT), 64) END AS t FROM (SELECT conv_id, turn, text, unnest(CASE WHEN len(text) < 64 THEN [0] ELSE range(0, len(text) - 63, 32) END) AS i FROM conversations)), e AS ({_entropy('t', 'conv_id, turn, i', 'w')}) SELECT conv_id, turn, round(max(bits), 6) AS bits FROM e GROUP BY ALL",
    "instruction_density": f"""WITH t AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(text), '{_WS}+'), lambda x: x <> '') AS w FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN len(w) < 5 THEN 0.0 ELSE len(list_filter(w, lambda x: list_contains({_CONTROL}, regexp_replace(x, '[.:,;!?]+$', '')))) / len(w)::DOUBLE END AS d FROM t)
SELECT conv_id, turn, round(d, 6) AS density, round(CASE WHEN d <= 0.08 THEN 0.0 ELSE least(2.0, (d - 0.08) / 0.08 * 2.0) END, 6) AS score FROM d""",
    "structural_markers": f"SELECT page_id, CAST(len(regexp_extract_all(html, {_MARK})) AS INT) AS n_markers, round(least(2.0, 0.7 * len(regexp_extract_all(html, {_MARK}))), 6)::DOUBLE AS score FROM pages",
    "token_digests": f"SELECT conv_id, turn, CAST(len(d) AS INT) AS n, coalesce(list_min(d), '') AS least FROM (SELECT conv_id, turn, {_DIGESTS} AS d FROM conversations)",
    "provenance_ingested": f"WITH c AS (SELECT DISTINCT conv_id, role, unnest({_DIGESTS}) AS d FROM conversations) SELECT a.conv_id, count(*) AS n_ingested FROM c a WHERE role = 'assistant' AND EXISTS (FROM c s WHERE s.role = 'system' AND s.conv_id = a.conv_id AND s.d = a.d) AND NOT EXISTS (FROM c u WHERE u.role = 'user' AND u.conv_id = a.conv_id AND u.d = a.d) GROUP BY a.conv_id",
    "minhash_signature": f"SELECT conv_id, turn, sha256(array_to_string({_MINHASH}, ',')) AS minima_sha256 FROM (SELECT conv_id, turn, {_CHARS} AS bg FROM conversations)",
    "near_duplicate_pairs": f"WITH m AS (SELECT lpad(CAST(conv_id AS VARCHAR), 9, '0') || '-' || lpad(CAST(turn AS VARCHAR), 4, '0') AS id, {_MINHASH} AS h FROM (SELECT conv_id, turn, {_CHARS} AS bg FROM conversations)), p AS (SELECT a.id AS a, b.id AS b, len(list_filter(range(1, 65), lambda i: a.h[i] = b.h[i])) / 64.0 AS s FROM m a JOIN m b ON a.id < b.id) SELECT a, b, round(s, 6)::DOUBLE AS likeness FROM p WHERE s >= 0.7",
    "redact_urls": f"SELECT page_id, {_BARE_URL} AS url FROM pages",
    "arg_rule_violations": f"WITH {_CALLS} SELECT tool_name, {_VIOLATION} AS violation, count(*) AS n FROM calls GROUP BY ALL",
    "policy_first_match": f"WITH {_TOOLS}, {_CALLS}, m AS (SELECT {_RULE} AS rule FROM calls JOIN tools USING (tool_name)) SELECT coalesce(rule, 'none') AS rule_id, {_ACTION} AS action, count(*) AS n FROM m GROUP BY ALL",
    "policy_redaction": f"WITH {_CALLS} SELECT '***' AS value, count(*) AS n, CAST(sum(CAST(v_k AS BIGINT)) AS BIGINT) AS sum_k FROM calls WHERE tool_name = 'purchase'",
    "tag_capability_gate": f"WITH {_TOOLS}, {_AGENTS}, {_CALLS} SELECT c.agent_id, c.tool_name, array_to_string(list_sort(list_filter(tags, lambda t: NOT list_contains(allowed, t))), ',') AS missing, count(*) AS n FROM calls c JOIN tools USING (tool_name) JOIN agents a ON a.agent_id = c.agent_id AND a.sub_agent_id IS NULL GROUP BY ALL",
    "toxic_tag_combos": f"WITH {_AGENTS} SELECT agent_id, array_to_string(list_sort(c), '+') AS combo FROM agents, (VALUES {', '.join(f'({_list(c)})' for c in dims.TOXIC)}) t(c) WHERE sub_agent_id IS NULL AND list_has_all(allowed, c)",
    "revoked_anti_join": f"WITH {_CALLS} SELECT agent_id, count(*) AS n_calls FROM calls WHERE agent_id NOT IN ({', '.join(map(_q, dims.REVOKED))}) GROUP BY agent_id",
    "gate_decisions": f"""WITH {_TOOLS}, {_AGENTS}, {_CALLS},
j AS (SELECT c.*, t.tags, t.transport, t.irreversibility, a.names, a.allowed, a.agent_id AS known, {_VIOLATION.replace('tool_name', 'c.tool_name')} AS violation FROM calls c JOIN tools t USING (tool_name) LEFT JOIN agents a ON a.agent_id = c.agent_id AND a.sub_agent_id IS NULL),
r AS (SELECT *, {_RULE} AS rule FROM j),
d AS (SELECT *, CASE WHEN agent_id = 'a3' THEN 'R0' WHEN known IS NULL THEN 'registry' WHEN NOT list_contains(names, tool_name) THEN 'L1' WHEN violation IS NOT NULL THEN 'L2'
  WHEN irreversibility = 'irreversible' AND event_id % 2 = 1 THEN 'L3' WHEN NOT list_has_all(allowed, tags) THEN 'L4' WHEN {_ACTION} = 'deny' THEN 'L5'
  WHEN event_id % 11 = 0 AND list_has_any(tags, ['destructive', 'financial', 'external']) THEN 'L6' WHEN event_id % 13 = 0 AND tool_name = 'purchase' THEN 'L6' ELSE 'allow' END AS layer FROM r)
SELECT layer = 'allow' AS allowed, layer, layer = 'allow' AND (list_contains(tags, 'sensitive') OR (event_id % 7 = 0 AND NOT list_contains(tags, 'read'))) AS scan_args, count(*) AS n FROM d GROUP BY ALL""",
    "url_allowlist": f"SELECT scheme, allowed, count(*) AS n, min(page_id) AS first_page FROM (SELECT page_id, string_split(url, '://')[1] AS scheme, len(list_filter({_list(dims.URL_PATTERNS)}, lambda p: CASE WHEN ends_with(p, '/*') THEN starts_with(url, p[:-2]) ELSE url = p END)) > 0 AS allowed FROM pages) GROUP BY ALL",
    "method_allowlist": "SELECT event_type, upper(event_type) IN ('CLICK', 'VIEW') AS allowed, count(*) AS n FROM events GROUP BY ALL",
    "quorum_counts": "SELECT n >= 1 AS sensitive_ok, n >= 2 AS irreversible_ok, count(*) AS n FROM (SELECT user_id, hour(ts) AS h, count(DISTINCT event_type) FILTER (event_type IN ('click', 'purchase')) AS n FROM events GROUP BY ALL) GROUP BY 1, 2",
    "nonce_replay": "SELECT user_id || '-' || strftime(ts, '%Y-%m-%d') AS token_id, count(*) - 1 AS n_replayed, arg_min(event_id, (ts, event_id)) AS first_use FROM events GROUP BY 1",
    "step_budget": "SELECT user_id, least(count(*), 20) AS n_allowed, greatest(count(*) - 20, 0) AS n_denied FROM events GROUP BY user_id",
    "fanout_islands": "SELECT user_id, count(*) AS n_islands, CAST(sum(least(n, 2)) AS BIGINT) AS n_allowed FROM (SELECT user_id, CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id",
    "rate_limit_global": """WITH RECURSIVE o AS (SELECT user_id, epoch(ts) AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
f AS (SELECT user_id, k, [s] AS q, 1 AS ok FROM o WHERE k = 1 UNION ALL
  SELECT o.user_id, o.k, CASE WHEN len(list_filter(q, lambda x: x >= s - 604800)) < 10 THEN list_append(list_filter(q, lambda x: x >= s - 604800), s) ELSE list_filter(q, lambda x: x >= s - 604800) END, CASE WHEN len(list_filter(q, lambda x: x >= s - 604800)) < 10 THEN 1 ELSE 0 END
  FROM f JOIN o ON o.user_id = f.user_id AND o.k = f.k + 1)
SELECT user_id, CAST(sum(ok) AS BIGINT) AS n_allowed, CAST(count(*) - sum(ok) AS BIGINT) AS n_denied FROM f GROUP BY user_id""",
    "session_score_window": f"WITH {_SCORES} SELECT session_id, turn_index, round(score, 6) AS score, reframe FROM sc",
    "session_escalation_latch": f"""WITH {_SCORES}, l AS (SELECT *, coalesce(max(CASE WHEN score >= 0.7 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY turn_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS latched FROM sc),
f AS (SELECT session_id, count(*) FILTER (latched) AS n_latched, arg_min(score, turn_index) FILTER (score >= 0.7 AND NOT latched) AS first_score, arg_max(score, turn_index) AS end_score FROM l GROUP BY session_id)
SELECT session_id, n_latched, round(CASE WHEN n_latched > 0 THEN first_score ELSE end_score END, 6) AS last_score FROM f""",
    "reframe_jaccard": f"WITH bg AS (SELECT conv_id, turn, {_BIGRAMS} AS b FROM conversations), pv AS (SELECT *, lag(b) OVER (PARTITION BY conv_id ORDER BY turn) AS pb FROM bg) SELECT conv_id, turn, round({_JAC}, 6) AS similarity FROM pv",
    "session_ttl": "SELECT user_id AS session_id, CAST(1 + count(*) FILTER (gap > INTERVAL 72 HOUR) AS BIGINT) AS n_parts FROM (SELECT user_id, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events) GROUP BY user_id",
    "turn_signals": f"WITH {_EVIDENCE} SELECT conversation_id, turn_id, input_status, input_categories, CAST(n_families AS INT) AS n_families, gate, result_status, result_categories FROM sig",
    "turn_risk": f"WITH {_EVIDENCE}, {_RISK} SELECT conversation_id, turn_id, round(r, 6) AS risk, CASE WHEN r >= 0.6 THEN 'block' ELSE coalesce(result_status, 'allow') END AS final_status FROM risk",
    "audit_tail": f"WITH {_LINES}, last AS (SELECT * FROM lines ORDER BY line_no DESC LIMIT 200) SELECT line_no, boundary, decision, agent_id FROM last WHERE boundary = 'purchase' AND decision = 'deny' ORDER BY line_no",
    "audit_decision_counts": f"WITH {_LINES} SELECT coalesce(boundary, 'malformed') AS boundary, coalesce(decision, 'malformed') AS decision, count(*) AS n FROM lines GROUP BY ALL",
    "audit_network_join": "WITH e AS (SELECT *, user_id || '-' || strftime(ts, '%Y-%m-%d') AS token_id FROM events), g AS (SELECT token_id, min(event_id) AS gate_event FROM e WHERE event_type = 'view' GROUP BY token_id) SELECT token_id, gate_event, count(*) AS n_requests, round(sum(value), 4) AS bytes FROM g JOIN (SELECT token_id, value FROM e WHERE event_type = 'purchase') USING (token_id) GROUP BY ALL",
    "audit_reason_truncation": "SELECT doc_id, CAST(len(r) AS INT) AS n_chars, sha256(r) AS reason_sha256 FROM (SELECT doc_id, CASE WHEN len(text) > 500 THEN substr(text, 1, 497) || '...' ELSE text END AS r FROM documents)",
    "audit_line_format": """SELECT event_id, rtrim(strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || '  ' || CASE WHEN value >= 50 THEN 'deny   ' ELSE 'allow  ' END || '  ' || rpad(event_type, 16, ' ') || '  ' || rpad(CAST(user_id AS VARCHAR), 35, ' ') || '  '
  || CASE WHEN event_id % 2 = 0 THEN event_type ELSE '' END || CASE WHEN event_id % 3 > 0 THEN '  findings=' || (event_id % 3) || ' max=high' ELSE '' END
  || CASE event_id % 5 WHEN 0 THEN '  [argument_violation] reason=' || chr(39) || 'argument rule violation: value' || chr(39) WHEN 1 THEN '  [irreversibility_blocked] reason=' || chr(39) || 'irreversible call without approval' || chr(39) WHEN 2 THEN '  reason="the agent' || chr(39) || 's limit"' ELSE '' END
  || CASE WHEN event_id % 7 = 0 THEN '  [session_escalation]' ELSE '' END || CASE WHEN event_id % 11 = 0 THEN '  [deobfuscated: base64,hex]' ELSE '' END || CASE WHEN event_id % 4 = 0 THEN ' +' || (event_id % 100) || 'ms' ELSE '' END) AS line FROM events""",
    "audit_consolidated": f"WITH {_EVIDENCE}, {_RISK}, e AS (SELECT coalesce(result_status, 'allow') AS decision, 'scan' AS signal_source FROM risk UNION ALL SELECT 'block', 'consolidated' FROM risk WHERE r >= 0.6 AND coalesce(result_status, 'allow') <> 'block') SELECT decision, signal_source, count(*) AS n FROM e GROUP BY ALL",
    "attestation_digest": """WITH o AS (SELECT user_id, event_type, event_type || CASE event_id % 3 WHEN 0 THEN '\\"a\\\\\\n' WHEN 1 THEN '\\u00e9\\u20ac' ELSE '' END AS odd, event_type || CASE event_id % 3 WHEN 0 THEN '"a\\' || chr(10) WHEN 1 THEN 'é€' ELSE '' END AS raw FROM events),
t AS (SELECT DISTINCT user_id, event_type, NULL AS odd, NULL AS raw FROM o UNION ALL SELECT DISTINCT user_id, NULL, odd, raw FROM o)
SELECT user_id, sha256('[' || string_agg('"' || event_type || '"', ', ' ORDER BY event_type) || ']') AS digest, sha256('[' || string_agg('"' || odd || '"', ', ' ORDER BY raw) || ']') AS odd_digest FROM t GROUP BY user_id""",
    "topology_edges": f"WITH {_TOOLS}, {_AGENTS} SELECT 'agent:' || agent_id AS \"from\", 'tool:' || tool_name AS \"to\", 'uses' AS type FROM agents JOIN tools ON list_contains(names, tool_name) AND list_has_all(allowed, tags) WHERE sub_agent_id IS NULL UNION ALL SELECT 'agent:' || agent_id, 'subagent:' || sub_agent_id, 'delegates' FROM agents WHERE sub_agent_id IS NOT NULL UNION ALL SELECT 'source:' || source, 'tool:' || tool_name, 'provides' FROM tools WHERE source IS NOT NULL",
    "shadow_sources": f"WITH {_SOURCES} SELECT u AS url, string_agg(source, ',' ORDER BY source) AS names FROM (SELECT source, {_BARE_URL} AS u FROM sources WHERE url IS NOT NULL) GROUP BY u HAVING count(DISTINCT source) > 1",
    "tools_for_agents": f"WITH {_TOOLS}, {_AGENTS} SELECT agent_id, tool_name FROM agents JOIN tools ON list_contains(names, tool_name) AND list_has_all(allowed, tags) WHERE sub_agent_id IS NULL",
    "local_tool_source": "SELECT * FROM (VALUES ('crm', 'click', 'crm,read'), ('web', 'view', 'a,read,web')) t(source, tool_name, tags)",
    "source_activation": f"WITH {_SOURCES} SELECT source, required, CASE source WHEN 'web' THEN 'suppressed' WHEN 'crm' THEN 'active' WHEN 'mail' THEN 'error' ELSE 'skipped' END AS state FROM sources",
    "source_resolution": f"WITH {_TOOLS} SELECT tool_name, CASE tool_name WHEN 'click' THEN 'crm' WHEN 'view' THEN 'files' ELSE 'local' END AS source FROM tools",
    "manifest_overrides": "SELECT * FROM (VALUES ('crm', 'http', 'https://mine.example'), ('mail', 'stdio', 'https://mail.example')) t(source, transport, url)",
    "candidate_should_record": "SELECT doc_id FROM labels GROUP BY doc_id HAVING max(CASE WHEN toxic <> 1 AND quality = 0 THEN 1 ELSE 0 END) = 1 AND max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) = 0",
    "scoring_functions": "SELECT doc_id, CAST(" + ", CAST(".join([_score(scores.STRUCTURES, "i") + " AS INT) AS structure", _score(scores.ENCODINGS) + " AS INT) AS encoding", _OBFUSCATION + " AS INT) AS obfuscation", _INTENT + " AS INT) AS intent", _score(scores.SOFT_CUES, "i") + " AS INT) AS soft", _PERSONA + " AS INT) AS persona"]) + ", CASE WHEN regexp_matches(text, '[\\p{Cf}\\p{Co}]') THEN 1.0 ELSE 0.0 END::DOUBLE AS invisible FROM documents",
    "rate_limit_replay": """WITH RECURSIVE o AS (SELECT user_id, event_type AS tool, epoch(ts) AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
f AS (SELECT user_id, k, [s] AS q, CASE WHEN tool = 'purchase' THEN [s] ELSE []::DOUBLE[] END AS p, CASE WHEN tool = 'click' THEN [s] ELSE []::DOUBLE[] END AS c, 'allowed' AS outcome FROM o WHERE k = 1 UNION ALL
  SELECT user_id, k, CASE WHEN says = 'allowed' THEN list_append(q, s) ELSE q END, CASE WHEN says = 'allowed' AND tool = 'purchase' THEN list_append(p, s) ELSE p END, CASE WHEN says = 'allowed' AND tool = 'click' THEN list_append(c, s) ELSE c END, says
  FROM (SELECT *, CASE WHEN len(q) >= 10 THEN 'rate limit over all tools' WHEN (tool = 'purchase' AND len(p) >= 3) OR (tool = 'click' AND len(c) >= 3) THEN 'rate limit of the tool' ELSE 'allowed' END AS says
    FROM (SELECT o.user_id, o.k, o.tool, o.s, list_filter(f.q, lambda x: x >= o.s - 604800) AS q, list_filter(f.p, lambda x: x >= o.s - 604800) AS p, list_filter(f.c, lambda x: x >= o.s - 604800) AS c FROM f JOIN o ON o.user_id = f.user_id AND o.k = f.k + 1)))
SELECT user_id, outcome, count(*) AS n FROM f GROUP BY ALL""",
    "loop_detection": """WITH RECURSIVE o AS (SELECT user_id, event_type AS tool, CAST(ts AS DATE) AS prompt, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
f AS (SELECT user_id, k, prompt, 1 AS calls, [tool] AS recent, 'allowed' AS outcome FROM o WHERE k = 1 UNION ALL
  SELECT user_id, k, prompt, calls + CASE WHEN says = 'allowed' THEN 1 ELSE 0 END, CASE WHEN says = 'allowed' THEN list_append(recent, tool)[-3:] ELSE recent END, says
  FROM (SELECT *, CASE WHEN calls >= 5 THEN 'session budget: calls of the prompt' WHEN list_contains(recent, tool) THEN 'loop' ELSE 'allowed' END AS says
    FROM (SELECT o.user_id, o.k, o.tool, o.prompt, CASE WHEN o.prompt = f.prompt THEN f.calls ELSE 0 END AS calls, f.recent FROM f JOIN o ON o.user_id = f.user_id AND o.k = f.k + 1)))
SELECT user_id, outcome, count(*) AS n FROM f GROUP BY ALL""",
    "breaker_replay": """WITH RECURSIVE o AS (SELECT event_type AS scanner, event_id % 8 = 0 AS ok, epoch(ts) AS s, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k FROM events),
f AS (SELECT scanner, 0::BIGINT AS k, 0 AS fails, NULL::DOUBLE AS until, 60.0::DOUBLE AS wait, NULL::VARCHAR AS state FROM o WHERE k = 1 UNION ALL
  SELECT scanner, k, CASE WHEN state = 'open' THEN fails WHEN ok THEN 0 WHEN state = 'closed' THEN fails + 1 ELSE fails END,
    CASE WHEN state = 'open' THEN until WHEN ok THEN NULL WHEN state = 'half_open' THEN s + least(2 * wait, 300) WHEN fails + 1 >= 5 THEN s + wait ELSE NULL END,
    CASE WHEN state = 'open' THEN wait WHEN ok THEN 60 WHEN state = 'half_open' THEN least(2 * wait, 300) ELSE wait END, state
  FROM (SELECT o.scanner, o.k, o.ok, o.s, f.fails, f.until, f.wait, CASE WHEN f.until IS NULL THEN 'closed' WHEN o.s < f.until THEN 'open' ELSE 'half_open' END AS state FROM f JOIN o ON o.scanner = f.scanner AND o.k = f.k + 1))
SELECT scanner, state, count(*) AS n FROM f WHERE k > 0 GROUP BY ALL""",
    "candidate_fingerprints": f"""WITH w AS (SELECT conv_id, turn, i, CASE WHEN len(text) < 64 THEN text ELSE substr(text, CAST(i + 1 AS BIGINT), 64) END AS t FROM (SELECT conv_id, turn, text, unnest(CASE WHEN len(text) < 64 THEN [0] ELSE range(0, len(text) - 63, 32) END) AS i FROM conversations)), e AS ({_entropy('t', 'conv_id, turn, i', 'w')}),
h AS (SELECT conv_id, turn, max(bits) AS bits FROM e GROUP BY ALL),
t AS (SELECT conv_id, turn, text, [regexp_replace(x, '[.:,;!?]+$', '') FOR x IN list_filter(regexp_split_to_array(lower(text), '{_WS}+'), lambda x: x <> '')] AS w, {_PAIRS} AS bg FROM conversations),
d AS (SELECT *, CASE WHEN len(w) < 5 THEN 0.0 ELSE len(list_filter(w, lambda x: list_contains({_CONTROL}, x))) / len(w)::DOUBLE END AS d FROM t)
SELECT d.conv_id, d.turn, {_bucket('(CASE WHEN bits <= 4.8 THEN 0 ELSE least(2.0, (bits - 4.8) * 2.0) END)')} AS entropy, {_bucket('(CASE WHEN d <= 0.08 THEN 0 ELSE least(2.0, (d - 0.08) / 0.08 * 2.0) END)')} AS density,
  {_bucket(f'least(2.0, 0.7 * len(regexp_extract_all(text, {_MARK})))')} AS structural, CASE WHEN len(text) < 100 THEN 'short' WHEN len(text) < 1000 THEN 'medium' ELSE 'long' END AS length,
  array_to_string(list_sort(list_distinct(list_filter(w, lambda x: list_contains({_list(candidates.FINGERPRINT_WORDS)}, x)))), ',') AS control_words, list_min({_MINHASH}) AS least
FROM d JOIN h ON h.conv_id = d.conv_id AND h.turn = d.turn""",
    "argument_scan": f"""WITH src AS (SELECT doc_id, 'note: ' || text AS text FROM documents), {_findings('src')}, f AS (SELECT doc_id, arg_min(category, list_position({_list(detect.CATEGORIES)}, category)) AS category FROM findings WHERE severity IN ('high', 'critical') GROUP BY doc_id)
SELECT f.category IS NULL AS allowed, coalesce(f.category, 'none') AS finding, count(*) AS n FROM documents d LEFT JOIN f ON f.doc_id = d.doc_id GROUP BY ALL""",
    "svg_html_active_content": r"""WITH f AS (SELECT page_id, 'file.suspicious_extension' AS category, 'high' AS severity FROM pages UNION ALL SELECT page_id, 'file.double_extension', 'high' FROM pages WHERE page_id % 2 = 1
  UNION ALL SELECT page_id, 'file.svg_script', 'high' FROM pages WHERE page_id % 2 = 0 AND regexp_matches(html, '(?i)<script\b|\bon\w+\s*=|javascript:|<foreignObject\b')
  UNION ALL SELECT page_id, 'file.svg_entity_decl', 'medium' FROM pages WHERE page_id % 2 = 0 AND regexp_matches(html, '(?i)<!ENTITY\b'))
SELECT category, severity, count(*) AS n FROM f GROUP BY ALL""",
    "audit_hmac_verify": f"WITH {_SIGNED} SELECT class, count(*) AS n FROM classed GROUP BY class",
    "audit_hmac_failures": f"WITH {_SIGNED} SELECT line_no, class FROM classed WHERE class <> 'ok' ORDER BY line_no LIMIT 20",
    "rule_bundle": "SELECT count(*) FILTER (item_id % 5 <> 0) AS valid, count(*) FILTER (item_id % 5 = 0) AS invalid FROM benchmark",
    "approval_quorum": "SELECT event_type, CAST(a AS INT) AS n_approvers, a >= 2 AS ok, count(*) AS n FROM (SELECT event_type, CASE WHEN event_type = 'signup' AND (props->>'$.k') = '1' THEN list_extract([0, 1, 2, 2], event_id % 4 + 1) ELSE 0 END AS a FROM events) GROUP BY ALL",
    "command_shapes": """WITH c AS (SELECT len(text) % 10 AS n FROM conversations), s(n, category, severity) AS (VALUES (0, 'pipeline_to_interpreter', 'high'), (0, 'download_exec_chain', 'high'), (1, 'network_fetch', 'medium'), (2, 'interpreter_inline_code', 'high'), (3, 'destructive_command', 'medium'), (4, 'reverse_shell_redirect', 'high'))
SELECT 'command_injection.' || category AS category, severity, count(*) AS n FROM c JOIN s ON c.n = s.n GROUP BY ALL""",
    "catalog_rules": "SELECT * FROM (VALUES " + ", ".join(_rule_row(k, r) for k, texts in rules.TEXTS.items() for t in texts for r in yaml.safe_load(t)) + ") t(scanner, rule, category, severity, match, within_chars, n_strings)",
    "connector_tools": "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{t}', '{','.join(sorted({v[0], *m['tags']}))}', '{v[1]}')" for k, m in yaml.safe_load(config.MANIFESTS).items() for t, v in m["tools"].items()) + ") t(source, tool_name, tags, action)",
    "candidate_upsert": f"""WITH RECURSIVE m AS (SELECT item_id % 4 AS tenant, CAST(item_id AS VARCHAR) AS id, {_MINHASH} AS h, row_number() OVER (PARTITION BY item_id % 4 ORDER BY item_id) AS k FROM (SELECT item_id, {_CHARS} AS bg FROM benchmark)),
f AS (SELECT tenant, k, id, [{{'id': id, 'h': h}}] AS cs, id AS candidate FROM m WHERE k = 1 UNION ALL
  SELECT tenant, k, id, CASE WHEN hit IS NULL THEN list_append(cs, {{'id': id, 'h': h}}) ELSE cs END, coalesce(hit, id)
  FROM (SELECT m.tenant, m.k, m.id, m.h, f.cs, list_filter(f.cs, lambda c: len(list_filter(range(1, 65), lambda i: c.h[i] = m.h[i])) >= {candidates.MATCH_AT} * 64)[1].id AS hit FROM f JOIN m ON m.tenant = f.tenant AND m.k = f.k + 1))
SELECT tenant, id, candidate FROM f""",
}
