"""DuckDB twins of the operators that SQL can express, over tables whose ids are unique."""

from __future__ import annotations

from .common import LOWER, UPPER
from .decontam import WORD as ALNUM
from .licenses import CC_KINDS, CC_VERSIONS, END, LEAD, LINE_END, NAMES, RULES, SENTENCES, SPDX, TAIL

LOWERED = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
WORDS = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"

QUALITY = rf"""WITH d AS (SELECT doc_id, coalesce('=' || source, '') AS h, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{WORDS}') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORDS}')) AS ls FROM d),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY 1),
l AS (SELECT DISTINCT doc_id, h, md5(t) AS k, line FROM (SELECT doc_id, h, t, trim(regexp_replace(translate(unnest(string_split(t, chr(10))), '{UPPER}', '{LOWER}'), '{SPACE}+', ' ', 'g')) AS line FROM d) WHERE line <> ''),
tot AS (SELECT doc_id, sum(length(line)) AS chars FROM l GROUP BY 1),
often AS (SELECT h, line FROM l GROUP BY ALL HAVING count(*) > 20),
hit AS (SELECT DISTINCT h, k, line, chars FROM l JOIN often USING (h, line) JOIN tot USING (doc_id)),
per AS (SELECT h, k, sum(length(line)) AS c, max(chars) AS chars FROM hit GROUP BY ALL),
gone AS (SELECT h, line FROM hit JOIN per USING (h, k) WHERE c <= per.chars * 0.25 GROUP BY ALL HAVING count(*) > 20),
lost AS (SELECT doc_id, count(*) AS n, sum(length(line)) AS c FROM l JOIN gone USING (h, line) GROUP BY 1),
b AS (SELECT w.doc_id, len(ws) AS n_words, length(regexp_replace(t, '{SPACE}', '', 'g')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
 coalesce(rep.n, 0) AS n_repeat_words, coalesce(lost.n, 0) AS n_removed_lines, coalesce(lost.c, 0)::BIGINT AS removed_chars, coalesce(lost.c > tot.chars * 0.5, false) AS depleted
 FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN lost USING (doc_id) LEFT JOIN tot USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
 NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT depleted AS kept, n_removed_lines, removed_chars FROM b"""

NEAR_DEDUP = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWERED}, '{WORDS}') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, array_to_string(ws[i : i + 4], ' ') AS sh FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
reach AS (SELECT doc_id AS u, doc_id AS v FROM w UNION SELECT r.u, e.b FROM reach r JOIN e ON e.a = r.v),
c AS (SELECT u AS doc_id, min(v) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM w LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)"""

DECONTAMINATION = rf"""WITH d AS (SELECT doc_id, regexp_extract_all({LOWERED}, '{ALNUM}') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all({LOWERED}, '{ALNUM}') AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(ws), 10) AS l, array_to_string(ws[i : i + least(len(ws), 10) - 1], ' ') AS g FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT l FROM win),
dw AS (SELECT doc_id, i, l, array_to_string(ws[i : i + l - 1], ' ') AS g FROM (SELECT doc_id, ws, l, unnest(range(1, len(ws) - l + 2)) AS i FROM d, sizes WHERE len(ws) >= l)),
hit AS (SELECT doc_id, i, l, item_id FROM dw JOIN win USING (l, g)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM hit) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hit) GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)"""

#: The clamped sources are the first ones by cap over weight; the walk is a recursion over (turn, draw) of each source.
MIXING = rf"""WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORDS}'))::BIGINT AS size, CAST('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 13) AS BIGINT) AS draw FROM documents),
s1 AS (SELECT *, [1, 2, 3][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM (SELECT source, sum(size)::BIGINT AS ss FROM d GROUP BY source)),
s2 AS (SELECT *, 3.0::DOUBLE * ss / w AS ratio, row_number() OVER r AS k, sum(ss) OVER () AS t, sum(w) OVER () AS tw, sum(w) OVER r - w AS w0, 3 * (sum(ss) OVER r - ss) AS c0 FROM s1 WINDOW r AS (ORDER BY 3.0::DOUBLE * ss / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
lv AS (SELECT arg_min((t - c0)::DOUBLE / (tw - w0), k) AS level FROM s2 WHERE (t - c0)::DOUBLE / (tw - w0) < ratio),
s3 AS (SELECT source, ss, CASE WHEN level IS NULL THEN 3.0::DOUBLE * ss ELSE least(3.0::DOUBLE * ss, level * w) END AS target FROM s2, lv),
s4 AS (SELECT *, CASE WHEN ss > 0 THEN least(3, floor(target / ss))::INT ELSE 0 END AS whole FROM s3),
g AS (SELECT source, draw, sum(size)::BIGINT AS n FROM d GROUP BY ALL),
walk AS (SELECT g.source, draw, n, target, row_number() OVER (PARTITION BY g.source ORDER BY turn, draw) AS k FROM g JOIN s4 ON g.source IS NOT DISTINCT FROM s4.source, range(3) x(turn) WHERE turn < 3 - whole),
st AS (SELECT source, 0::BIGINT AS k, NULL::BIGINT AS draw, false AS took, greatest(target - whole * ss, 0)::DOUBLE AS need FROM s4
 UNION ALL SELECT source, k, draw, f, CASE WHEN f THEN need - n ELSE need END FROM (SELECT w.source, w.k, w.draw, w.n, s.need, s.need >= 1 AND w.n > 0 AND w.n <= s.need AS f FROM st s JOIN walk w ON s.source IS NOT DISTINCT FROM w.source AND w.k = s.k + 1)),
c AS (SELECT source, draw, count(*) FILTER (took) AS extra FROM st WHERE k > 0 GROUP BY ALL)
SELECT doc_id, size, ss AS source_size, target, size * (whole + coalesce(extra, 0)) AS taken FROM d JOIN s4 ON d.source IS NOT DISTINCT FROM s4.source LEFT JOIN c ON c.source IS NOT DISTINCT FROM d.source AND c.draw = d.draw"""

CHAT = """WITH m AS (SELECT *, CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind, CASE role WHEN 'user' THEN conv_id || ':' || turn WHEN 'assistant' THEN conv_id || ':' || (turn - 1) END AS call_id FROM conversations),
i AS (SELECT conv_id, turn, turn - 2 * row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS island FROM m WHERE kind = 'call'),
dep AS (SELECT conv_id || ':' || turn AS call_id, row_number() OVER (PARTITION BY conv_id, turn % 2, island ORDER BY turn) - 1 AS depth, CASE WHEN row_number() OVER (PARTITION BY conv_id, turn % 2, island ORDER BY turn) > 1 THEN conv_id || ':' || (turn - 2) END AS after FROM i),
res AS (SELECT call_id, count(*) AS n, min(text) AS result FROM m WHERE kind = 'result' GROUP BY 1)
SELECT conv_id, turn, role, kind, m.call_id, CASE WHEN kind = 'call' THEN coalesce(after, '') END AS after, CASE WHEN kind <> 'message' THEN depth END AS depth,
 CASE kind WHEN 'call' THEN res.call_id IS NOT NULL WHEN 'result' THEN dep.call_id IS NOT NULL ELSE false END AS linked, CASE WHEN kind = 'call' THEN coalesce(n, 0) END AS n_results,
 CASE WHEN kind = 'call' THEN text IS NOT NULL AND turn IS NOT NULL END AS valid, CASE WHEN kind = 'call' THEN CASE WHEN text IS NULL THEN 'text: missing' ELSE '' END END AS errors,
 CASE WHEN kind = 'call' THEN json_object('after', CASE WHEN after IS NULL THEN [] ELSE [after] END, 'arguments', json_object('text', text, 'turn', turn), 'call_id', m.call_id, 'depth', depth, 'name', 'ask', 'result', result, 'valid', text IS NOT NULL)
  ELSE json_object('call_id', m.call_id, 'content', text, 'role', role) END::VARCHAR AS json
FROM m LEFT JOIN dep ON dep.call_id = m.call_id LEFT JOIN res ON res.call_id = m.call_id"""


PHRASES = rf"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({LOWERED}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, k, array_to_string(ws[i : i + k - 1], ' ') AS phrase, count(*) AS f FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, range(1, 6) x(k) WHERE len(ws) >= k) GROUP BY ALL),
tot AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM g WHERE k > 1 AND f >= 100),
kept AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c q WHERE q.lang = c.lang AND q.k > c.k AND 100 * q.f >= 100 * c.f AND contains(' ' || q.phrase || ' ', ' ' || c.phrase || ' '))),
cuts AS (SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS ws, k, unnest(range(1, k)) AS j FROM kept),
s AS (SELECT cuts.lang, cuts.phrase, a, j, x.f AS l, y.f AS r, n, ((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f))::BIGINT AS score FROM cuts JOIN tot USING (lang)
 JOIN g x ON x.lang = cuts.lang AND x.phrase = array_to_string(ws[1 : j], ' ') JOIN g y ON y.lang = cuts.lang AND y.phrase = array_to_string(ws[j + 1 :], ' ')),
worst AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM worst QUALIFY rank <= 2000"""


def _licences() -> str:
    """The table and its expansion as rows; sentences, and lines of unknown ones, joined with it; rules as patterns over the identifiers."""
    raw = [*SENTENCES.items(), *[(n, i) for i, _, _, names in NAMES for n in names], *[(f"spdx license identifier {x}", i) for i, _, spdx, _ in NAMES for x in spdx]]
    known = ", ".join(f"('{k}', '{v}')" for k, v in raw)
    kinds, versions = (", ".join(f"('{a}', '{b}')" for a, b in pairs) for pairs in (CC_KINDS, CC_VERSIONS))
    # a rule's identifiers in order, others between them
    rules = [(name, "(^|,)" + ",([^,]*,)*".join(seq) + "(,|$)") for name, seq in RULES]
    hits = ", ".join(f"CASE WHEN regexp_matches(ids, '{rx}') THEN '{name}' END" for name, rx in rules)
    plain = f"trim(regexp_replace(translate(x, '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ', 'g'))"
    normal = f"regexp_replace(regexp_replace(regexp_replace({plain}, '{TAIL}', ''), '{LEAD}', ''), '{SPDX}', 'spdx ')"
    return rf"""WITH cc AS (SELECT 'cc ' || c || ' ' || v AS short, 'creative commons ' || n || ' ' || v AS long, c, n, v, area, 'cc-' || c || '-' || replace(regexp_replace(v, '\.0$', ''), '.', '-') AS id
 FROM (VALUES {kinds}) k(c, n), (VALUES {versions}) w(v, area)),
raw(x, id) AS (VALUES {known} UNION ALL SELECT unnest([short, short || ' license', short || ' ' || area, long, long || ' license', long || ' ' || area, long || ' ' || area || ' license', long || ' ' || area || ' ' || short, long || ' ' || area || ' license ' || short,
 'creative commons ' || n || ' ' || area || ' ' || v || ' license', 'spdx license identifier ' || short, 'https creativecommons org licenses ' || c || ' ' || v]), id FROM cc),
known AS (SELECT {normal} AS sentence, min(id) AS id FROM raw GROUP BY 1),
p AS (SELECT doc_id, k, ps[k] AS x FROM (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS k FROM (SELECT doc_id, string_split_regex(coalesce(text, ''), '{END}') AS ps FROM documents))),
w AS (SELECT doc_id, k, x, id FROM (SELECT *, {normal} AS s FROM p) LEFT JOIN known ON sentence = s),
l AS (SELECT doc_id, k, j, ls[j] AS x FROM (SELECT doc_id, k, ls, unnest(range(1, len(ls) + 1)) AS j FROM (SELECT doc_id, k, string_split_regex(x, '{LINE_END}') AS ls FROM w WHERE id IS NULL AND contains(x, chr(10))))),
f AS (SELECT doc_id, k, 0 AS j, id FROM w WHERE id IS NOT NULL UNION ALL SELECT doc_id, k, j, id FROM (SELECT *, {normal} AS s FROM l) JOIN known ON sentence = s),
g AS (SELECT doc_id, coalesce(string_agg(id, ',' ORDER BY k, j), '') AS ids FROM documents LEFT JOIN f USING (doc_id) GROUP BY doc_id),
h AS (SELECT doc_id, ids, list_filter([{hits}], lambda x: x IS NOT NULL) AS l FROM g),
u AS (SELECT doc_id, ids, list_filter(l, lambda x, i: list_position(l, x) = i) AS l FROM h)
SELECT doc_id, ids AS sentence_ids, coalesce(array_to_string(l, ','), '') AS licences, l[1] AS licence FROM u"""


SQL: dict[str, str] = {
    "op1_quality_rules": QUALITY, "op2_minhash_near_dedup": NEAR_DEDUP, "op6_benchmark_decontamination": DECONTAMINATION, "op7_mixing_sources": MIXING, "op8_chat_formatting": CHAT, "op9_license_scans": _licences(), "op12_phrase_collocations": PHRASES,
}
