"""DuckDB SQL for the queries that SQL can express, written plainly and not after the operators.

Fingerprints (op1), neighbours whose distances are sums of doubles (op2), random rounding (op6), a trained network (op7),
tokens (op9) and lattice scores (op10) have none; their tests hold them against brute force.
"""

from __future__ import annotations

from kerbline.llm.quality import BOILERPLATE

_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"
_COUNT = "(length({0}) - length(regexp_replace({0}, '[{1}]+', '', 'g')))"

_LINES = """SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents"""

OP3 = f"""
WITH l AS ({_LINES}),
f AS (SELECT doc_id, pos, trim(line, {_SPACE}) AS t, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM l WHERE trim(line, {_SPACE}) <> ''),
n AS (SELECT *, lead(t, 1) OVER w AS t1, lead(t, 2) OVER w AS t2 FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT doc_id, i, 3 AS n, t || chr(10) || t1 || chr(10) || t2 AS gram FROM n WHERE t2 IS NOT NULL
      UNION ALL SELECT doc_id, i, 1, t FROM n WHERE length(t) >= 80),
r AS (SELECT doc_id, i, n FROM g QUALIFY row_number() OVER (PARTITION BY n, gram ORDER BY doc_id, i) > 1),
x AS (SELECT DISTINCT f.doc_id, f.pos FROM r JOIN f ON f.doc_id = r.doc_id AND f.i BETWEEN r.i AND r.i + r.n - 1)
SELECT l.doc_id, count(*) AS n_lines, count(x.pos) AS n_removed,
    sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (x.pos IS NULL), '')) AS text_sha256
FROM l LEFT JOIN x ON x.doc_id = l.doc_id AND x.pos = l.pos GROUP BY l.doc_id
"""

_FAILS = " OR ".join(
    [
        r"""(n < 20 AND NOT regexp_matches(line, '[.!?…。！？؟।:;]["''”’»)\]}]*[\x20\x09-\x0D]*\z'))""",
        f"5 * {_COUNT.format('line', '|›»•·')} >= n",
        f"10 * {_COUNT.format('line', '#*$%&|<>')} >= 3 * n",
        f"(n >= 3 AND 2 * {_COUNT.format('line', '!')} >= n)",
        *[f"contains(lower(line), '{p}')" for p in BOILERPLATE],
    ]
)

OP4 = f"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS.format("text")} AS ws FROM documents),
e AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
g AS (SELECT doc_id, i, [word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o] AS gram
      FROM e WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
h AS (SELECT doc_id, i FROM g WHERE gram[5] IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat FROM h, (SELECT unnest(range(5)) AS k) GROUP BY doc_id),
l AS (SELECT doc_id, line, len({_WORDS.format("line")}) AS n FROM ({_LINES}) WHERE trim(line, {_SPACE}) <> ''),
s AS (SELECT doc_id, count(*) - count(DISTINCT line) AS dup, coalesce(sum(n) FILTER (NOT ({_FAILS})), 0) AS good FROM l GROUP BY doc_id),
a AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, {_COUNT.format("text", "#*$%&|<>")}::BIGINT AS n_symbols,
      coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat, 0)::BIGINT AS n_repeat_words, coalesce(good, 0) AS good
      FROM w LEFT JOIN c USING (doc_id) LEFT JOIN s USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_words - good <= 0.5 * n_words AS kept FROM a
"""

_CONTROLS = ("<s>", "</s>", "<<SYS>>", "<</SYS>>", "<role=", "</role>", "[INST]", "[/INST]")
_ADDED = " + ".join(["length(text) - length(replace(text, chr(92), ''))", *[f"(length(text) - length(replace(text, '{c}', ''))) // {len(c)}" for c in _CONTROLS]])
_MARKS = "CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE length(url_encode(role)) + 14 END"

OP5 = f"""
WITH own AS (SELECT -1 AS conv_id, unnest([0, 1]) AS turn, unnest(['user', 'assistant']) AS role, '</s>[INST] ok [/INST]' AS text),
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT * FROM own))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum({_MARKS} + length(text) + {_ADDED})::BIGINT AS formatted_chars,
    regexp_matches(string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END, '' ORDER BY turn, role, text), '^s?(ua)+$') AS valid
FROM t GROUP BY conv_id
"""

OP8 = f"""
WITH w AS (SELECT doc_id, {_WORDS.format("text")} AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20)),
r AS (SELECT doc_id, i FROM g QUALIFY row_number() OVER (PARTITION BY gram ORDER BY doc_id, i) > 1),
x AS (SELECT DISTINCT doc_id, i + k AS i FROM r, (SELECT unnest(range(20)) AS k)),
e AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
k AS (SELECT e.doc_id, count(*) AS n_words, count(x.i) AS n_removed, string_agg(word, ' ' ORDER BY e.i) FILTER (x.i IS NULL) AS kept
      FROM e LEFT JOIN x ON x.doc_id = e.doc_id AND x.i = e.i GROUP BY e.doc_id)
SELECT w.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)
"""

ORACLES: dict[str, str] = {"op3_line_dedup": OP3, "op4_quality": OP4, "op5_chat": OP5, "op8_substring": OP8}
