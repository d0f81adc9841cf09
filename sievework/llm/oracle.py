"""Check SQL of the queries that SQL can express."""

from __future__ import annotations

from collections.abc import Sequence

from sievework.llm.url_filter import Rule

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_sql(rules: Sequence[Rule], blocked: str) -> str:
    """``blocked`` is one regular expression over host and path for all globs."""
    listed = ", ".join(f"('{r.host}', '{r.path}', '{r.action}')" for r in rules)
    return f"""
WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
hosts AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM cut),
parts AS (SELECT page_id, translate(raw, '{_UPPER}', '{_LOWER}') AS host,
  regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM hosts),
rules(rule_host, rule_path, action) AS (VALUES {listed}),
fits AS (SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
  arg_max(action, length(rule_host || rule_path)) AS action FROM parts JOIN rules
  ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id)
SELECT page_id, host, path, rule,
  coalesce(action, CASE WHEN regexp_full_match(host || path, '{blocked}') THEN 'block' ELSE 'allow' END) AS verdict
FROM parts LEFT JOIN fits USING (page_id)"""


def repeats_sql(span: int) -> str:
    return f"""
WITH split AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x09-\\x0D\\x20]+'), lambda w: w <> '') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + {span - 1}), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - {span - 2})) AS i FROM split)),
least AS (SELECT g, min(doc_id) AS first FROM windows GROUP BY g HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT doc_id, list(DISTINCT i + k) AS places FROM (SELECT doc_id, i FROM windows JOIN least USING (g) WHERE first < doc_id)
  CROSS JOIN (SELECT unnest(range({span})) AS k) GROUP BY doc_id),
places AS (SELECT doc_id, w, coalesce(places, []) AS places FROM split LEFT JOIN gone USING (doc_id)),
one AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM places),
kept AS (SELECT one.doc_id, string_agg(word, ' ' ORDER BY one.i) AS text FROM one
  LEFT JOIN (SELECT doc_id, unnest(places) AS i FROM gone) out ON one.doc_id = out.doc_id AND one.i = out.i WHERE out.i IS NULL GROUP BY one.doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM places LEFT JOIN kept USING (doc_id)"""


_VISIBLE = "[^\\x20\\x09-\\x0D]"
# The checksum's table, from its polynomial; a text's bytes, of the letters up to U+00FF.
_CRC = "crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, (c & 1) * 3988292384)) AS v FROM range(256) r(i)))"


def crc_sql(text: str) -> str:
    """CRC-32 of an expression, where ``crc`` is joined."""
    codes = f"list_transform(string_split({text}, ''), lambda c: unicode(c)::BIGINT)"
    octets = f"flatten(list_transform({codes}, lambda u: CASE WHEN u < 128 THEN [u] ELSE [192 + (u >> 6), 128 + (u & 63)] END))"
    return f"xor(list_reduce(list_prepend(4294967295, {octets}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


def conversations_sql() -> str:
    """All paths through the states, row by row; the least (cost, audit) into each state goes on."""
    follow = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
    kept = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}

    def inserted(state: int) -> list[tuple[int, list[str]]]:
        out: list[tuple[int, list[str]]] = [(state, [])]
        for _ in range(2):
            role, state = follow[state]
            out.append((state, [*out[-1][1], f"{role}:"]))
        return out

    def listed(rows: list[str]) -> str:
        return "[" + ", ".join(f"'{r}'" for r in rows) + "]::VARCHAR[]"

    moves = []
    for state in range(4):
        edits = [("D", None, None, state, 3)] + [("K", i, None, to, 0) for (s, i), to in kept.items() if s == state] + [("R", None, *follow[state], 2)]
        for letter, initial, role, to, cost in edits:
            for end, rows in inserted(to):
                quoted = ["NULL::VARCHAR" if x is None else f"'{x}'" for x in (initial, role)]
                moves.append(f"({state}, '{letter}', {', '.join(quoted)}, {end}, {cost + 2 * len(rows)}, '{'I' * len(rows)}', {listed(rows)})")
    starts = " UNION ALL ".join(f"SELECT {end}, {2 * len(rows)}, '{'I' * len(rows)}', {listed(rows)}" for end, rows in inserted(0))
    return f"""
WITH RECURSIVE {_CRC},
named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  {crc_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind FROM conversations, crc),
hurt AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
  CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) FROM named WHERE kind <> 0)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM hurt),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
  lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair, NOT regexp_matches(text, '{_VISIBLE}') AS blank FROM placed),
told AS (SELECT *, again AND NOT blank AS duplicate, NOT blank AND NOT again
  AND regexp_extract(text, '({_VISIBLE})[\\x20\\x09-\\x0D]*$', 1) NOT IN ('.', '!', '?') AS truncated FROM seen),
moves(state, letter, initial, role, goal, cost, more, added) AS (VALUES {", ".join(moves)}),
starts(state, cost, audit, rows) AS ({starts}),
paths AS (
  SELECT conv_id, 0::BIGINT AS i, state, {{'cost': cost::BIGINT, 'audit': audit, 'rows': rows}} AS p FROM (SELECT DISTINCT conv_id FROM hurt), starts
  UNION ALL
  SELECT conv_id, i, state, min(p) AS p FROM (
    SELECT paths.conv_id, told.i, m.goal AS state, {{'cost': p.cost + m.cost + CASE WHEN told.truncated AND m.letter <> 'D' THEN 1 ELSE 0 END,
      'audit': p.audit || m.letter || m.more,
      'rows': p.rows || CASE WHEN m.letter = 'D' THEN [] ELSE [coalesce(m.role, told.role) || ':' || told.text] END || m.added}} AS p
    FROM paths JOIN told ON told.conv_id IS NOT DISTINCT FROM paths.conv_id AND told.i = paths.i + 1
    JOIN moves m ON m.state = paths.state AND (m.initial IS NULL OR m.initial = left(told.role, 1)) AND (m.letter = 'D' OR NOT (told.blank OR told.duplicate)))
  GROUP BY conv_id, i, state),
counted AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
  count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM told GROUP BY conv_id),
ended AS (SELECT conv_id, min(p) AS p FROM paths JOIN counted USING (conv_id) WHERE i = n AND state IN (0, 3) GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(p.cost, 0) AS cost, coalesce(p.audit, '') AS audit, sha256(coalesce(array_to_string(p.rows, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN counted ON a.conv_id IS NOT DISTINCT FROM counted.conv_id LEFT JOIN ended ON a.conv_id IS NOT DISTINCT FROM ended.conv_id"""


def spelling_sql() -> str:
    """Near words share their first or their last half; accented letters count as one byte, as the distance is in bytes."""
    accented = "".join(map(chr, range(0xC0, 0x100)))
    single = _UPPER + "0123456789" + "!#$%&()*+,-./:;<=>?@[]^_`{|}~"[:28]
    return f"""
WITH RECURSIVE {_CRC},
runs AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[a-zÀ-ÿ]+')) AS run
  FROM documents) WHERE length(run) >= 5 GROUP BY ALL),
hashed AS (SELECT run, n, {crc_sql("doc_id::VARCHAR || ':' || run")} AS h FROM runs, crc),
words AS (SELECT word, sum(n)::BIGINT AS n FROM (SELECT n, CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
halves AS (SELECT DISTINCT word, n, translate(word, '{accented}', '{single}') AS plain, side, h, CASE side WHEN 0 THEN left(word, h) ELSE right(word, h) END AS half
  FROM (SELECT *, unnest([length(word) // 2, (length(word) - 1) // 2]) AS h FROM words), (SELECT unnest([0, 1]) AS side)),
near AS (SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS other_n FROM halves a JOIN halves b ON a.side = b.side AND a.h = b.h AND a.half = b.half AND a.word <> b.word
  AND abs(length(a.plain) - length(b.plain)) < 2 AND levenshtein(a.plain, b.plain) = 1),
best AS (SELECT word, count(*) AS n_near, min({{'rank': -other_n, 'word': other}}) AS b FROM near GROUP BY word),
formed AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.rank >= 2 * n THEN b.word END AS form, CASE WHEN -b.rank >= 2 * n THEN -b.rank END AS form_n
  FROM words LEFT JOIN best USING (word)),
chains AS (SELECT word, word AS root FROM formed UNION ALL SELECT chains.word, formed.form FROM chains JOIN formed ON formed.word = chains.root WHERE formed.form IS NOT NULL),
ends AS (SELECT chains.word, root FROM chains JOIN formed ON formed.word = chains.root WHERE formed.form IS NULL)
SELECT formed.word, form, root, n, n_near, form_n::BIGINT AS form_n FROM formed JOIN ends USING (word)"""


def substrings_sql(span: int) -> str:
    return f"""
WITH texts AS (SELECT row_number() OVER () AS row, doc_id, encode(coalesce(text, '')) AS b FROM documents),
windows AS (SELECT row, i, md5(b[i:i + {span - 1}]) AS h FROM (SELECT row, b, unnest(range(1, octet_length(b) - {span - 2})) AS i FROM texts)),
twice AS (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY h) AS c FROM windows) WHERE c > 1),
runs AS (SELECT row, min(i) AS a, max(i) + {span - 1} AS z FROM (SELECT row, i, sum(CASE WHEN i - before <= {span} THEN 0 ELSE 1 END) OVER (PARTITION BY row ORDER BY i) AS g
  FROM (SELECT row, i, coalesce(lag(i) OVER (PARTITION BY row ORDER BY i), -{span}) AS before FROM twice)) GROUP BY row, g),
gaps AS (SELECT row, coalesce(lag(z) OVER w, 0) + 1 AS first, a - 1 AS last FROM runs WINDOW w AS (PARTITION BY row ORDER BY a)
  UNION ALL SELECT row, max(z) + 1, 2000000000 FROM runs GROUP BY row),
left_over AS (SELECT row, string_agg(hex(b[first:last]), '' ORDER BY first) AS kept FROM gaps JOIN texts USING (row) WHERE last >= first GROUP BY row),
counted AS (SELECT row, sum(z - a + 1)::BIGINT AS n_removed, count(*) AS n_spans FROM runs GROUP BY row)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  CASE WHEN n_spans IS NULL THEN sha256(b) ELSE sha256(unhex(coalesce(kept, ''))) END AS kept_sha256
FROM texts LEFT JOIN counted USING (row) LEFT JOIN left_over USING (row)"""
