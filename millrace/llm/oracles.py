"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from millrace.llm.quality_rules import RULES, STOP_WORDS, SYMBOLS, UPPER

GAP = r"[\x20\x09-\x0D]+"


def _quality() -> str:
    stops = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    bounds = " AND ".join([f"{r.measure} >= {r.low}" for r in RULES if r.low is not None] + [f"{r.measure} <= {r.high}" for r in RULES if r.high is not None])
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '{GAP}'), lambda x: x <> '') AS ws FROM d),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(8) AS r(k) GROUP BY doc_id),
m AS (SELECT w.doc_id, t, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '{GAP}', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^{SYMBOLS}]', '', 'g'))::BIGINT AS n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, '{GAP}', '', 'g') <> '') AS ls,
  coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
  len(list_filter([{stops}], lambda s: list_contains(ws, s))) AS n_stop_words FROM w LEFT JOIN rep USING (doc_id)),
n AS (SELECT *, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, word_chars / greatest(n_words, 1) AS mean_word_chars, n_symbols / greatest(n_words, 1) AS symbol_ratio,
  length(regexp_replace(t, '[^!]', '', 'g')) / greatest(n_words, 1) AS exclaim_ratio, length(regexp_replace(t, '[^{UPPER}]', '', 'g')) / greatest(word_chars, 1) AS upper_ratio,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
r AS (SELECT *, n_dup_lines / (length(t) - length(replace(t, chr(10), '')) + 1) AS dup_line_ratio FROM n)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {bounds} AS kept FROM r
"""


CHAT = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, length(text) + length(text) - length(replace(text, chr(92), ''))
  + length(regexp_replace(regexp_replace(text, '<(/?(?:s>|SYS>)|<SYS>>|</SYS>>|\|[a-z_]+\|>)', chr(1) || chr(1) || '\1', 'g'), '\[(/?[A-Za-z_]{1,64}\])', chr(1) || chr(1) || '\1', 'g')) - length(text) AS n FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(n + 2 * length(role) + 8 + CASE WHEN role = 'assistant' THEN 4 ELSE 0 END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


JACCARD = rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{GAP}'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM w UNION SELECT e.b, r.root FROM r JOIN e ON r.doc_id = e.a)
SELECT r.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(root) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY 1
"""


#: crc32 by a table of 256 remainders, which its rule makes: crc(list of byte values).
CRC = """
crc_table AS (SELECT list(c ORDER BY b) AS t FROM (SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM range(256) AS r(b)))"""


def crc(values: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295, {values}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


def _merkle() -> str:
    fields = lambda text: " || ".join(f"coalesce(strlen({x}::VARCHAR) || ':' || {x}, '-')" for x in ("doc_id", "source", "lang", "n_chars", text))
    own, other = fields("text"), fields("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
    levels = lambda name, base: f"""
{name}(part, level, nth, n, node) AS ({base} UNION ALL SELECT part, level + 1, nth // 16, (n + 15) // 16, sha256(string_agg(node, '' ORDER BY nth)) FROM {name} WHERE n > 1 GROUP BY part, level, nth // 16, n)"""  # noqa: E731
    sides = lambda leaves, name, key: f"""SELECT {key}, l.level, coalesce(string_agg(o.node, '' ORDER BY o.nth) FILTER (o.nth < s.at), '') AS lefts, coalesce(string_agg(o.node, '' ORDER BY o.nth) FILTER (o.nth > s.at), '') AS rights
  FROM {leaves} x JOIN (SELECT DISTINCT part, level FROM {name} WHERE n > 1) l ON l.part = x.part CROSS JOIN LATERAL (SELECT x.nth >> (4 * l.level) AS at) s
  JOIN {name} o ON o.part = x.part AND o.level = l.level AND o.nth // 16 = s.at // 16 GROUP BY {key}, l.level"""  # noqa: E731
    return rf"""
WITH RECURSIVE {CRC},
rows AS (SELECT row_number() OVER () AS id, * FROM documents),
leaves AS (SELECT id, doc_id, sha256({own}) AS leaf,
  CASE WHEN {crc("list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)")} % 5 = 0 THEN sha256({other}) ELSE sha256({own}) END AS changed,
  dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS part, source FROM rows CROSS JOIN crc_table),
placed AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY doc_id NULLS FIRST, leaf, id) - 1 AS nth, count(*) OVER (PARTITION BY part) AS n FROM leaves),
{levels("low", "SELECT part, 0, nth, n, leaf FROM placed")},
subs AS (SELECT 0 AS part, part AS nth, count(*) OVER () AS n, node FROM low WHERE n = 1),
{levels("high", "SELECT part, 0, nth, n, node FROM subs")},
proofs AS (SELECT id, level, lefts, rights FROM ({sides("placed", "low", "x.id")})
  UNION ALL SELECT id, level + 100, lefts, rights FROM ({sides("subs", "high", "x.nth")}) h JOIN placed ON h.nth = placed.part),
steps AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY level) AS step FROM proofs),
folds(id, step, node) AS (SELECT id, 0, changed FROM leaves UNION ALL SELECT id, steps.step, sha256(lefts || node || rights) FROM folds JOIN steps USING (id) WHERE steps.step = folds.step + 1),
ends AS (SELECT id, arg_max(node, step) AS folded_root FROM folds GROUP BY id),
digests AS (SELECT id, sha256(string_agg(lefts || rights, '' ORDER BY step)) AS proof FROM steps GROUP BY id)
SELECT doc_id, leaf, subs.node AS subroot, r.node AS root, coalesce(proof, sha256('')) AS proof_sha256, folded_root, folded_root = r.node AS verified
FROM placed JOIN subs ON subs.nth = placed.part JOIN ends USING (id) LEFT JOIN digests USING (id) CROSS JOIN (SELECT node FROM high WHERE n = 1) r
"""


def _spelling() -> str:
    code = "list_transform(string_split(coalesce(doc_id::VARCHAR, 'null') || ':' || r, ''), lambda x: ord(x)::BIGINT)"
    utf8 = f"flatten(list_transform({code}, lambda x: CASE WHEN x < 128 THEN [x] ELSE [195, x - 64] END))"
    return rf"""
WITH RECURSIVE {CRC},
runs AS (SELECT doc_id, r, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents) CROSS JOIN LATERAL (SELECT translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r) GROUP BY 1, 2),
hashed AS (SELECT r, c, {crc(utf8)} AS h FROM runs CROSS JOIN crc_table WHERE length(r) >= 5),
words AS (SELECT word, sum(c)::BIGINT AS n FROM (SELECT c, CASE WHEN h % 97 = 0 THEN r[1:h % length(r)] || r[h % length(r) + 2:] ELSE r END AS word FROM hashed) WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
less AS (SELECT word, n, i, word[1:i - 1] || word[i + 1:] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (SELECT a.word, b.word AS near, b.n AS m FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, arg_min(near, (-m, near)) AS near, max(m) AS m FROM pairs GROUP BY word),
formed AS (SELECT words.word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= 2 * n THEN near END AS form, CASE WHEN m >= 2 * n THEN m END AS form_n FROM words LEFT JOIN best USING (word)),
paths(word, root, step) AS (SELECT word, word, 0 FROM formed UNION ALL SELECT paths.word, form, step + 1 FROM paths JOIN formed ON paths.root = formed.word WHERE form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN (SELECT word, arg_max(root, step) AS root FROM paths GROUP BY word) USING (word)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": _quality(), "op4_chat_format": CHAT, "op6_jaccard_join": JACCARD, "op11_merkle_manifest": _merkle(), "op13_spelling_variants": _spelling()}
