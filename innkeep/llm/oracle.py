"""DuckDB SQL of the operators that SQL can express, written on its own."""

from __future__ import annotations

from innkeep.llm.pii import IBAN_LENGTHS

# fixed values: the patterns in their plain forms
_PII = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    ("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
     "len(list_filter(string_split(hit, '.'), lambda p: length(ltrim(p, '0')) > 3 "
     "or coalesce(try_cast(ltrim(p, '0') AS INTEGER), 0) > 255)) = 0"),
    ("card", r"[0-9](?:[ -]?[0-9])+",
     "length(digits) BETWEEN 13 AND 19 AND list_sum([CASE WHEN (length(digits) - i) % 2 = 0 "
     "THEN digits[i]::INTEGER WHEN digits[i]::INTEGER > 4 THEN 2 * digits[i]::INTEGER - 9 "
     "ELSE 2 * digits[i]::INTEGER END FOR i IN range(1, length(digits) + 1)]) % 10 = 0"),
    ("phone", r"\+[0-9][ ().0-9-]+[0-9]", "length(digits) BETWEEN 9 AND 15"),
    ("iban", "|".join(rf"\b{c}[0-9][0-9](?: ?[0-9A-Z]){{{n - 4}}}\b" for n, cs in IBAN_LENGTHS.items() for c in cs.split()),
     "(((((((num[1:18]::HUGEINT % 97)::VARCHAR || num[19:36])::HUGEINT % 97)::VARCHAR || num[37:54])::HUGEINT % 97)"
     "::VARCHAR || num[55:72])::HUGEINT % 97) = 1 AND score >= 60"),
    ("secret", r"[A-Za-z0-9_+/-]{20,}",
     "regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[A-Za-z]') AND score >= 60"),
]
# score in percent without context, and the words that add 30 to it
_CONTEXT = {
    "email": (60, "(?i)(mail|contact|kontakt|correo|courriel)"),
    "ip": (50, "(?i)(ip|host|server|address|login)"),
    "card": (80, "(?i)(card|visa|credit|karte|tarjeta|carte)"),
    "phone": (50, "(?i)(phone|call|tel|mobil|fax)"),
    "iban": (80, "(?i)(iban|account|bank|konto|cuenta|compte)"),
    "secret": (30, "(?i)(token|secret|password|passwd|api[_ -]?key|access[_ -]?key|credential)"),
}


def _pii_kind(no: int, kind: str, pattern: str, valid: str) -> str:
    prior, words = _CONTEXT[kind]
    score = f"least(100, {prior} + CASE WHEN regexp_matches(right(text[:pos], 32), '{words}') THEN 30 ELSE 0 END)"
    num = ("list_aggregate([CASE WHEN c BETWEEN 'A' AND 'Z' THEN (ascii(c) - 55)::VARCHAR ELSE c END "
           "FOR c IN string_split(substring(replace(hit, ' ', ''), 5) || left(hit, 4), '')], 'string_agg', '')"
           if kind == "iban" else "''")
    return f"""
SELECT rid, {no} AS no, '{kind}' AS kind, pos, pos + length(hit) AS stop, score FROM (
  SELECT *, regexp_replace(hit, '[^0-9]', '', 'g') AS digits, {score} AS score, {num} AS num FROM (
    SELECT rid, text, hit, CAST(sum(length(gap) + length(hit)) OVER (PARTITION BY rid ORDER BY i)
           - length(hit) AS BIGINT) AS pos FROM (
      SELECT rid, text, unnest(hits) AS hit, unnest(gaps[1:len(hits)]) AS gap,
             unnest(range(1, len(hits) + 1)) AS i
      FROM (SELECT rid, text, regexp_extract_all(text, '{pattern}') AS hits,
                   string_split_regex(text, '{pattern}') AS gaps FROM t))))
WHERE {valid}"""


def _pii() -> str:
    kinds = " UNION ALL ".join(_pii_kind(i, *k) for i, k in enumerate(_PII))
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k, _, _ in _PII[:4])
    line = "kind || ':' || pos || ':' || stop"
    return f"""
WITH t AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
s AS ({kinds})
SELECT doc_id, {counts},
       sha256(coalesce(string_agg({line}, ',' ORDER BY no, pos) FILTER (WHERE no < 4), '')) AS base_sha256,
       coalesce(string_agg({line}, ',' ORDER BY no, pos), '') AS spans,
       coalesce(string_agg(score::VARCHAR, ',' ORDER BY no, pos), '') AS scores
FROM t LEFT JOIN s USING (rid) GROUP BY rid, doc_id"""


# fixed values: control strings that the template escapes
_CONTROL = ("<\\|turn\\|>|<\\|end\\|>|<\\|im_start\\|>|<\\|im_end\\|>|<\\|endoftext\\|>|<\\|startoftext\\|>|"
            "<\\|system\\|>|<\\|user\\|>|<\\|assistant\\|>|<s>|</s>|\\[INST\\]|\\[/INST\\]|<<SYS>>|<</SYS>>")

_CHAT = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'),
                                  (-7, 1, 'assistant', '</s>[INST] ok [/INST]')))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text)
                       FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(8 + length(role) + 2 * len(regexp_extract_all(role, '[%<\\[\\n\\\\]')) + 1 + length(text)
           + len(regexp_extract_all(text, '{_CONTROL}')) + 9) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id"""


_SUFFIX = """
WITH t AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS hx FROM documents),
w AS (SELECT rid, i, md5(substr(hx, 2 * i + 1, 400)) AS k
      FROM (SELECT rid, hx, unnest(range(0, length(hx) // 2 - 199)) AS i FROM t WHERE length(hx) >= 400)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY k) AS c FROM w) WHERE c > 1),
b AS (SELECT rid, i, CASE WHEN i <= lag(i) OVER (PARTITION BY rid ORDER BY i) + 200 THEN 0 ELSE 1 END AS brk FROM r),
s AS MATERIALIZED (SELECT rid, min(i) AS x, max(i) + 200 AS y FROM (
      SELECT rid, i, sum(brk) OVER (PARTITION BY rid ORDER BY i) AS run FROM b) GROUP BY rid, run),
g AS (SELECT rid, coalesce(lag(y) OVER (PARTITION BY rid ORDER BY x), 0) AS a, x AS z FROM s
      UNION ALL SELECT rid, max(y), NULL FROM s GROUP BY rid
      UNION ALL SELECT rid, 0, NULL FROM t WHERE rid NOT IN (SELECT rid FROM s)),
kept AS (SELECT rid, string_agg(substr(hx, CAST(2 * a + 1 AS BIGINT),
                CAST(coalesce(2 * z, length(hx)) - 2 * a AS BIGINT)), '' ORDER BY a) AS hk
         FROM g JOIN t USING (rid) GROUP BY rid),
n AS (SELECT rid, sum(y - x) AS removed, count(*) AS spans FROM s GROUP BY rid)
SELECT doc_id, length(hx) // 2 AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed,
       coalesce(spans, 0) AS n_spans, sha256(unhex(hk)) AS kept_sha256
FROM t JOIN kept USING (rid) LEFT JOIN n USING (rid)"""


_STRUCTURE = """
WITH RECURSIVE
tab AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k:
               CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab FROM range(256) r(i)),
ids AS (SELECT DISTINCT conv_id FROM conversations),
f AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(ch)::BIGINT FOR ch IN
               string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '')]),
               lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS d
      FROM conversations, tab),
h AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
             CASE WHEN d = 1 THEN '' WHEN d = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
             unnest(range(CASE WHEN d = 3 THEN 2 ELSE 1 END)) AS copy FROM f WHERE d <> 0),
o AS (SELECT *, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS cid,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM h),
r AS MATERIALIZED (
  SELECT *, left(role, 1) AS x, lag(left(role, 1)) OVER (PARTITION BY cid ORDER BY i) || left(role, 1) AS two,
         CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank'
              WHEN row_number() OVER (PARTITION BY cid, role, text ORDER BY i) > 1 THEN 'duplicate'
              WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' ELSE '' END AS fault FROM o),
tr(q, x, q2) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
ins(q, q2, n, turns) AS (VALUES
  (0, 0, 0, []::VARCHAR[]), (1, 1, 0, []), (2, 2, 0, []), (3, 3, 0, []), (0, 2, 1, ['user:']), (1, 2, 1, ['user:']),
  (3, 2, 1, ['user:']), (2, 3, 1, ['assistant:']), (0, 3, 2, ['user:', 'assistant:']), (1, 3, 2, ['user:', 'assistant:'])),
opt AS MATERIALIZED (
  SELECT cid, i, q, q AS q2, 2 AS cost, 'D' AS letter, []::VARCHAR[] AS turns FROM r, range(4) s(q)
  UNION ALL SELECT cid, i, q, q2, CASE fault WHEN 'truncated' THEN 5 ELSE 0 END, 'K', [role || ':' || text]
            FROM r JOIN tr USING (x) WHERE fault NOT IN ('blank', 'duplicate')
  UNION ALL SELECT cid, i, q, q2, CASE fault WHEN 'truncated' THEN 6 ELSE 1 END, 'R',
                   [CASE tr.x WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text]
            FROM r JOIN tr ON tr.x IN ('u', 'a') WHERE fault NOT IN ('blank', 'duplicate')),
best(cid, i, q, k, turns) AS (
  SELECT DISTINCT cid, 0::BIGINT, 0, '000000000', []::VARCHAR[] FROM r
  UNION ALL
  SELECT cid, i, q, min(k), arg_min(turns, k) FROM (
    SELECT b.cid, p.i, p.q2 AS q, printf('%09d', left(b.k, 9)::BIGINT + 5 * n.n + p.cost) || substr(b.k, 10)
             || repeat('I', n.n) || p.letter AS k, list_concat(list_concat(b.turns, n.turns), p.turns) AS turns
    FROM best b JOIN ins n ON n.q = b.q JOIN opt p ON p.cid = b.cid AND p.i = b.i + 1 AND p.q = n.q2)
  GROUP BY cid, i, q),
size AS (SELECT cid, any_value(conv_id) AS conv_id, count(*) AS n, count(*) FILTER (WHERE fault = 'blank') AS blank,
                count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
                count(*) FILTER (WHERE two NOT IN ('su', 'ua', 'au')) AS illegal,
                coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps FROM r GROUP BY cid),
goal AS (SELECT b.cid, min(printf('%09d', left(b.k, 9)::BIGINT + 5 * n.n) || substr(b.k, 10) || repeat('I', n.n)) AS k,
                arg_min(list_concat(b.turns, n.turns), printf('%09d', left(b.k, 9)::BIGINT + 5 * n.n) || substr(b.k, 10) || repeat('I', n.n)) AS turns
         FROM best b JOIN size s ON s.cid = b.cid AND s.n = b.i JOIN ins n ON n.q = b.q WHERE n.q2 IN (0, 3) GROUP BY b.cid)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(left(k, 9)::BIGINT, 0) AS cost,
       coalesce(substr(k, 10), '') AS audit, sha256(coalesce(array_to_string(turns, chr(10)), '')) AS repaired_sha256
FROM ids LEFT JOIN (size JOIN goal USING (cid)) s ON s.conv_id IS NOT DISTINCT FROM ids.conv_id"""


_TOPK = """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, [floor(1024 * x::DOUBLE) FOR x IN embedding] AS u FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.rid AS qrid, d.rid, q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(q.u, d.u) AS BIGINT) AS score
      FROM (SELECT * FROM v WHERE vec_id % 100 = 0) q JOIN v d ON q.rid <> d.rid AND len(q.u) = len(d.u)),
r AS (SELECT *, row_number() OVER (PARTITION BY qrid ORDER BY score DESC, vec_id NULLS LAST, rid) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 10"""


ORACLE = {"op1_suffix_dedup": _SUFFIX, "op4_pii": _pii(), "op6_chat": _CHAT, "op11_structure": _STRUCTURE, "op13_topk": _TOPK}
