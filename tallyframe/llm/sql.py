"""DuckDB SQL for the registered queries that SQL can express."""

LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"regexp_extract_all(" + LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SPACED = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP5 = f"""
WITH d AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
b AS (SELECT item_id, {_ALNUM} AS w FROM benchmark),
win AS (SELECT item_id, CASE WHEN len(w) < 10 THEN len(w) ELSE 10 END AS n, unnest(CASE WHEN len(w) < 10 THEN [w]
  ELSE list_transform(range(1, len(w) - 8), lambda i: w[i:i + 9]) END) AS x FROM b WHERE len(w) > 0),
lengths AS (SELECT DISTINCT n FROM win),
place AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM d, lengths WHERE len(w) >= n),
hit AS (SELECT p.doc_id, p.i, p.n, win.item_id FROM place p JOIN win ON win.n = p.n AND win.x = p.w[p.i:p.i + p.n - 1]),
words AS (SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS spot FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS l FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP4 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS x FROM d),
n AS (SELECT doc_id, len(x)::BIGINT AS n, x FROM s),
p AS (SELECT doc_id, n, unnest(x) AS g FROM n),
pairs AS (SELECT a.doc_id AS i, b.doc_id AS j FROM p a JOIN p b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
ways AS (SELECT i, j FROM pairs UNION ALL SELECT j, i FROM pairs),
reach AS (SELECT i AS doc_id, j AS other FROM ways UNION SELECT r.doc_id, w.j FROM reach r JOIN ways w ON w.i = r.other)
SELECT n.doc_id, n.n AS n_shingles, least(n.doc_id, coalesce(min(r.other), n.doc_id)) AS component_id
FROM n LEFT JOIN reach r USING (doc_id) GROUP BY n.doc_id, n.n
"""

#: Windows over the hex of the bytes; a byte is gone if a repeated window starts at most 99 bytes before it.
OP6 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
l AS (SELECT doc_id, list_transform(range(0, len(h) // 2 - 99), lambda x: md5_number(substring(h, 2 * x + 1, 200))) AS x FROM d WHERE len(h) >= 200),
w AS (SELECT doc_id, unnest(range(0, len(x))) AS i, unnest(x) AS x FROM l),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY x ORDER BY doc_id, i) AS n FROM w) WHERE n > 1),
g AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER p + 100 THEN 0 ELSE 1 END AS fresh FROM r WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
k AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM g),
spans AS (SELECT doc_id, span, min(i) AS a, max(i) + 100 AS b FROM k GROUP BY ALL),
per AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans, list(a ORDER BY a) AS la, list(b ORDER BY a) AS lb FROM spans GROUP BY doc_id)
SELECT d.doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN la IS NULL THEN h ELSE array_to_string(list_transform(range(1, len(la) + 2), lambda x:
    substring(h, 2 * CASE WHEN x = 1 THEN 0 ELSE lb[x - 1] END + 1, 2 * (CASE WHEN x > len(la) THEN len(h) // 2 ELSE la[x] END - CASE WHEN x = 1 THEN 0 ELSE lb[x - 1] END))), '') END)) AS kept_sha256
FROM d LEFT JOIN per USING (doc_id)
"""

_CLASSES = ["a-z", r"\x20\x09-\x0D", "A-Z", r"\x{80}-\x{10FFFF}", "0-9", None, "#*$%&|<>"]  # None: all others


def _jsd(p: str, q: str) -> str:
    return (f"sqrt(greatest(0.0, list_sum(list_transform(list_zip({p}, {q}), lambda z: "
            f"(CASE WHEN z[1] > 0 THEN z[1] * log2(z[1] / ((z[1] + z[2]) / 2)) ELSE 0 END + CASE WHEN z[2] > 0 THEN z[2] * log2(z[2] / ((z[1] + z[2]) / 2)) ELSE 0 END) / 2))))")


def _share(a: str) -> str:
    return f"list_transform({a}, lambda v: v / list_sum({a}))"


def judged_sql(documents: str) -> str:
    """Rows of `documents` with the base columns, both distances, base_failed and kept."""
    given = ["len(regexp_replace(t, '[^" + c + "]', '', 'g'))::DOUBLE" for c in _CLASSES if c]
    counts = ", ".join([*given[:5], f"len(t) - ({' + '.join(given)})", given[5]])
    return f"""
WITH src AS (SELECT *, row_number() OVER () AS rid, coalesce(text, '') AS t FROM {documents}),
f AS (SELECT *, {_SPACED} AS w, [{counts}] AS cls, list_filter(regexp_split_to_array(lower(t), '[^\\p{{L}}]+'), lambda x: x <> '') AS pw,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM src),
pos AS (SELECT rid, unnest(range(1, len(w) - 6)) AS i, w FROM f WHERE len(w) >= 8),
winp AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i:i + 7]) AS c FROM pos),
rep AS (SELECT rid, count(DISTINCT spot) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS spot FROM winp WHERE c > 1) GROUP BY rid),
lw AS (SELECT lang, unnest(pw) AS word FROM f),
wc AS (SELECT lang, word, count(*) AS n FROM lw GROUP BY ALL),
top AS (SELECT * FROM wc QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) <= 24),
sums AS (SELECT lang, count(*) AS docs, {', '.join(f'sum(cls[{i + 1}]) AS s{i}' for i in range(7))} FROM f GROUP BY lang),
tot AS (SELECT lang, sum(n) AS words FROM wc GROUP BY lang),
lists AS (SELECT lang, list(word ORDER BY n DESC, word DESC) AS rw, list(n::DOUBLE ORDER BY n DESC, word DESC) AS rn FROM top GROUP BY lang),
each_ref AS (SELECT s.lang, [{', '.join(f's{i}' for i in range(7))}] AS rc, rw, list_append(rn, words - list_sum(rn)) AS rn
  FROM sums s LEFT JOIN lists l ON l.lang = s.lang LEFT JOIN tot t ON t.lang = s.lang WHERE s.lang IS NOT NULL AND docs >= 50 ORDER BY docs DESC, s.lang LIMIT 200),
merged AS (SELECT word, sum(n) AS n FROM wc GROUP BY word ORDER BY n DESC, word LIMIT 24),
all_ref AS (SELECT (SELECT [{', '.join(f'sum(s{i})' for i in range(7))}] FROM sums) AS rc, list(word ORDER BY n DESC, word DESC) AS rw,
  list_append(list(n::DOUBLE ORDER BY n DESC, word DESC), (SELECT sum(words) FROM tot) - sum(n)) AS rn FROM merged),
j AS (SELECT f.*, coalesce(e.rc, a.rc) AS rc, coalesce(e.rw, a.rw) AS rw, coalesce(e.rn, a.rn) AS rn, e.lang IS NOT NULL AS own_ref FROM f LEFT JOIN each_ref e ON e.lang = f.lang CROSS JOIN all_ref a),
k AS (SELECT *, list_transform(rw, lambda x: len(list_filter(pw, lambda y: y = x))::DOUBLE) AS own0 FROM j),
m AS (SELECT *, list_append(own0, len(pw) - list_sum(own0)) AS own FROM k),
g AS (SELECT m.*, len(w)::BIGINT AS n_words, (list_sum(cls) - cls[2])::BIGINT AS word_chars, cls[7]::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
  CASE WHEN list_sum(cls) >= 200 AND len(w) >= 50 THEN {_jsd(_share('cls'), _share('rc'))} END AS class_distance,
  CASE WHEN len(w) >= 50 AND len(pw) > 0 THEN {_jsd(_share('own'), _share('rn'))} END AS word_distance,
  CASE WHEN own_ref THEN {_jsd("list_transform(rn, lambda v, i: CASE WHEN i = len(rn) THEN 1.0 ELSE 0.0 END)", _share('rn'))} END AS reach
  FROM m LEFT JOIN rep USING (rid))
SELECT * EXCLUDE (reach), n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND coalesce(class_distance, 0) <= 0.3 AND coalesce(word_distance, 0) <= 0.5
    AND coalesce(word_distance * word_distance <= (0.3 + 25.0 / n_words) * reach * reach, true) AS kept FROM g
"""


OP9 = f"SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM ({judged_sql('documents')})"


def _op3() -> str:
    rules = [("block", "example.org", "/en/1"), ("block", "example.org", "/es/"), ("block", "com", "/de/"), ("allow", "com", "/fr/"), ("allow", "org", "/")]  # longest first
    fits = [f"(host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}')" for _, h, p in rules]
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{h}{p}'" for f, (_, h, p) in zip(fits, rules)) + " END"
    kind = "CASE " + " ".join(f"WHEN {f} THEN '{v}'" for f, (v, _, _) in zip(fits, rules)) + " END"
    smoothed = "(sum(nb) OVER {w} + 10.0::DOUBLE * q) / (sum(nl) OVER {w} + 10.0::DOUBLE) AS q"
    return f"""
WITH RECURSIVE a AS (SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, {LOWER.format("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
r AS (SELECT *, {rule} AS rule, {kind} AS by_rule, string_split(regexp_replace(path, '^/', ''), '/') AS segs FROM b),
x AS (SELECT host, segs, count(*) AS n, count(by_rule) AS nl, count(*) FILTER (WHERE by_rule = 'block') AS nb FROM r GROUP BY ALL),
x0 AS (SELECT *, (SELECT (sum(nb) + 1.0::DOUBLE) / (sum(nl) + 2.0::DOUBLE) FROM x) AS q FROM x),
tree(k, host, segs, n, nl, nb, tpl, q) AS (
  SELECT 0, host, segs, n, nl, nb, []::VARCHAR[], {smoothed.format(w="(PARTITION BY host)")} FROM x0
  UNION ALL
  SELECT k + 1, host, segs, n, nl, nb, tpl, {smoothed.format(w="(PARTITION BY host, tpl)")} FROM (
    SELECT k, host, segs, n, nl, nb, q, list_append(tpl, CASE WHEN s = '' THEN '' WHEN children >= 8 AND children >= 0.2 * p_n THEN '*'
      WHEN abs((c_nb + share) / (c_nl + 1.0::DOUBLE) - share) <= 1.96::DOUBLE * sqrt(share * (1.0::DOUBLE - share) / (c_nl + 1.0::DOUBLE)) THEN '~' ELSE s END) AS tpl
    FROM (SELECT *, count(*) OVER node AS paths, max(len(segs)) OVER node AS deep, count(DISTINCT s) OVER node AS children, sum(n) OVER node AS p_n,
            (sum(nb) OVER node + 1.0::DOUBLE) / (sum(nl) OVER node + 2.0::DOUBLE) AS share, sum(nl) OVER child AS c_nl, sum(nb) OVER child AS c_nb
          FROM (SELECT *, coalesce(segs[k + 1], '') AS s FROM tree) WINDOW node AS (PARTITION BY host, tpl), child AS (PARTITION BY host, tpl, s))
    WHERE paths > 1 AND deep > k)),
leaf AS (SELECT host, segs, arg_max(q, k) AS q FROM tree GROUP BY host, segs)
SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN q > 0.5 THEN 'block' ELSE 'allow' END) AS verdict FROM r JOIN leaf USING (host, segs)
"""


OP3 = _op3()

#: CRC-32 by its polynomial, bit by bit for the table and byte by byte for a text.
_CRC_TABLE = "crc_table AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) r(i)))"


def _crc(text: str) -> str:
    """CRC-32 of a text in a query that joins crc_table."""
    number = f"list_transform(range(0, octet_length(encode({text}))), lambda k: ('0x' || substr(hex(encode({text})), 2 * k::INT + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295], {number}), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295)"


_FEATURES = "list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"

OP13 = f"""
WITH {_CRC_TABLE}, d AS (SELECT doc_id, {_ALNUM} AS w FROM documents), b AS (SELECT {_ALNUM} AS w FROM benchmark),
f AS (SELECT doc_id, unnest({_FEATURES}) AS g FROM d), e AS (SELECT unnest({_FEATURES}) AS g FROM b),
u AS (SELECT g FROM f UNION SELECT g FROM e), k AS (SELECT g, {_crc('g')} % 10000 AS bucket FROM u, crc_table),
s AS (SELECT bucket, count(*) AS s FROM f JOIN k USING (g) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM e JOIN k USING (g) GROUP BY bucket),
gains AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM f) + 10000) / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM e) + 10000))))::BIGINT AS gain
  FROM s FULL JOIN t USING (bucket)),
means AS (SELECT doc_id, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM f JOIN k USING (g) JOIN gains USING (bucket) GROUP BY doc_id),
x AS (SELECT doc_id, len(w) AS n_words, len({_FEATURES})::BIGINT AS n_features, coalesce(weight, 0) AS weight,
  ('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT AS h FROM d LEFT JOIN means USING (doc_id)),
y AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score, n_words >= 20 AS able FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS place, count(*) FILTER (WHERE able) OVER () AS n FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= 25 * n // 100 THEN place END AS rank FROM z
"""


def _op11() -> str:
    """States 0 to 3 (nothing yet, after a system message, a user's, an assistant's) hold the least (cost, audit, text so far) up to each message."""

    def add(state: str, cost: str, letter: str, line: str) -> str:
        return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 'o': {state}.o || {line}}}"

    def least(*options: str) -> str:
        return f"list_sort([{', '.join(options)}])[1]"

    def said(role: str) -> str:
        return f"(chr(10) || {role} || ':' || text)"

    def moved(state: str, initial: str, role: str) -> str:
        return (f"CASE WHEN fault IN ('b', 'd') THEN {add(state, '1000000', '', chr(39) * 2)} WHEN initial = '{initial}' THEN {add(state, 'p', 'K', said('role'))} "
                f"ELSE {add(state, '3 + p', 'R', said(chr(39) + role + chr(39)))} END")

    def deleted(state: str) -> str:
        return add(state, "4", "D", "''")

    user, assistant = "(chr(10) || 'user:')", "(chr(10) || 'assistant:')"
    steps = {
        "n0": deleted("s0"),
        "n1": least(deleted("s1"), f"CASE WHEN fault IN ('b', 'd') OR initial <> 's' THEN {add('s0', '1000000', '', chr(39) * 2)} ELSE {add('s0', 'p', 'K', said('role'))} END"),
        "n2": least(deleted("s2"), *(moved(s, "u", "user") for s in ("s0", "s1", "s3"))),
        "n3": least(deleted("s3"), moved("s2", "a", "assistant")),
    }
    far = "{'c': 1000000::BIGINT, 'a': '', 'o': ''}"
    return f"""
WITH RECURSIVE {_CRC_TABLE},
raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS d FROM conversations, crc_table),
rows AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE WHEN d = 3 THEN [0, 1] ELSE [0] END) AS copy FROM raw WHERE d <> 0),
numbered AS (SELECT *, left(role, 1) AS initial, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i,
  regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) AS ending FROM rows),
faults AS (SELECT *, CASE WHEN ending = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
  WHEN ending NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS previous FROM numbered),
sums AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate,
  count(*) FILTER (WHERE fault = 't') AS truncated, count(*) FILTER (WHERE previous || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM faults GROUP BY conv_id),
walk AS (SELECT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 'o': ''}} AS s0, {far} AS s1, {{'c': 3::BIGINT, 'a': 'I', 'o': {user}}} AS s2, {{'c': 6::BIGINT, 'a': 'II', 'o': {user} || {assistant}}} AS s3 FROM sums
  UNION ALL SELECT conv_id, i, n0, n1, m2, {least('n3', add('m2', '3', 'I', assistant))} FROM (
    SELECT *, {least('n2', *(add(s, '3', 'I', user) for s in ('n0', 'n1', 'n3')))} AS m2 FROM (
      SELECT f.conv_id, f.i, {', '.join(f'{v} AS {k}' for k, v in steps.items())} FROM (SELECT *, CASE WHEN fault = 't' THEN 3 ELSE 0 END AS p FROM faults) f JOIN walk w ON w.conv_id = f.conv_id AND f.i = w.i + 1))),
best AS (SELECT conv_id, {least('s0', 's3')} AS x FROM walk JOIN sums USING (conv_id) WHERE i = n)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(x.c, 0)::BIGINT AS cost, coalesce(x.a, '') AS audit, sha256(coalesce(substr(x.o, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN sums USING (conv_id) LEFT JOIN best USING (conv_id)
"""


OP11 = _op11()
