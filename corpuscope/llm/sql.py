"""DuckDB SQL for the queries that SQL can express."""

from .manifest import FAN_OUT
from .mixing import LIMIT as MIX_LIMIT
from .mixing import SEED
from .variants import EVERY, FEWEST, LETTERS, SHORTEST, TIMES
from .urls import ADDRESS, LIMIT, RULES, SUFFIXES, Z

OP3 = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS bare
  FROM documents
), r AS (
  SELECT *, row_number() OVER (PARTITION BY bare ORDER BY n DESC, doc_id NULLS LAST) AS k FROM d
)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY bare ORDER BY k) AS keep_id,
  count(*) OVER (PARTITION BY bare) AS group_size, k = 1 AS kept, sha256(bare) AS text_sha256
FROM r
"""


OP10 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, row_number() OVER () AS r FROM documents
), windows AS (
  SELECT r, doc_id, i, md5(array_to_string(list_slice(w, i, i + 12), ' ')) AS h
  FROM (SELECT *, unnest(generate_series(1, len(w) - 12)) AS i FROM d)
), least_id AS (SELECT h, min(doc_id) AS first_id FROM windows GROUP BY h HAVING count(*) > 1),
repeated AS (SELECT r, i FROM windows JOIN least_id USING (h) WHERE doc_id > first_id),
gone AS (SELECT DISTINCT r, unnest(generate_series(i, i + 12)) AS i FROM repeated),
word AS (SELECT r, unnest(generate_series(1, len(w))) AS i, unnest(w) AS x FROM d),
kept AS (
  SELECT r, count(*) AS n, string_agg(x, ' ' ORDER BY i) AS t
  FROM word ANTI JOIN gone USING (r, i) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
  sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""


# Slots take a source's blocks in turn, so what is taken is the head of its repeated run.
OP2 = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS place
  FROM documents
), s AS (
  SELECT source, sum(size)::HUGEINT AS n,
    ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::HUGEINT AS w
  FROM d GROUP BY source
), o AS (
  SELECT *, row_number() OVER (ORDER BY 3.0 * n / w, source NULLS LAST) AS i FROM s
), c AS (
  SELECT *, sum(n) OVER () - coalesce(sum({MIX_LIMIT} * n) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(w) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS shares
  FROM o
), cut AS (SELECT min(i) AS i FROM c WHERE rest * w <= {MIX_LIMIT} * n * shares),
t AS (
  SELECT c.source, c.n, CASE WHEN c.i < cut.i THEN ({MIX_LIMIT} * c.n)::DOUBLE
    ELSE (c.w * e.rest)::DOUBLE / e.shares::DOUBLE END AS target
  FROM c, cut JOIN c e ON e.i = cut.i
), laid AS (
  SELECT doc_id, size, t.n, target, floor(target)::HUGEINT AS words,
    sum(size) OVER (PARTITION BY d.source ORDER BY place, doc_id) - size AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, n::BIGINT AS source_size, target,
  CASE WHEN size = 0 THEN 0 ELSE (words // n) * size
    + greatest(least(start + size, words % n) - start, 0) END::BIGINT AS taken
FROM laid
"""


def _rules() -> str:
    rows = []
    for verdict, rule in RULES:
        host, slash, rest = rule.partition("/")
        rows.append(f"('{verdict}', '{rule}', '{host}', '{slash}{rest}')")
    return ", ".join(rows)


def _strength(table: str) -> str:
    """Prior pages of the children in ``table`` (n, bad)."""
    return f"""(
  SELECT CASE WHEN coalesce(n, 0) = 0 OR k < 2 OR n = nn / n OR p IN (0.0, 1.0) THEN 100.0
    WHEN (round(spread, 9) / (p * (1 - p)) - k) > 0
      THEN round(least(greatest(greatest(n - k, 1) / (round(spread, 9) / (p * (1 - p)) - k) - 1, 1.0), 1000.0), 6)
    ELSE 1000.0 END
  FROM (SELECT sum(n) AS n, sum(n * n) AS nn, count(*) AS k, any_value(p) AS p,
          sum(n * pow(bad / n - p, 2)) AS spread
        FROM {table} CROSS JOIN total WHERE n > 0))"""


OP9 = f"""
WITH p AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), counted AS (
  SELECT host, string_split(regexp_replace(regexp_replace(host, '^.*@', ''), '(:[0-9]*)?$|\\.(:[0-9]*)?$', ''), '.') AS parts,
    count(quality)::DOUBLE AS n, coalesce(sum((quality = 0 OR toxic = 1)::INT), 0)::DOUBLE AS bad
  FROM p LEFT JOIN labels ON page_id = doc_id GROUP BY host
), level AS (
  SELECT *, CASE WHEN regexp_matches(array_to_string(parts, '.'), '{ADDRESS}') THEN len(parts)
    WHEN array_to_string(parts[-2:], '.') IN {SUFFIXES} THEN 2 ELSE 1 END AS labels
  FROM counted
), h AS (
  SELECT host, array_to_string(parts[-labels - 1:], '.') AS domain, array_to_string(parts[-labels:], '.') AS suffix, n, bad FROM level
), d AS (SELECT domain, any_value(suffix) AS suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY domain),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY suffix),
total AS (SELECT CASE WHEN sum(n) > 0 THEN sum(bad) / sum(n) ELSE 0.0 END AS p FROM s),
k AS (SELECT {_strength("s")} AS ks, {_strength("d")} AS kd, {_strength("h")} AS kh, p FROM total),
ms AS (SELECT suffix, (bad + p * ks) / (n + ks) AS m FROM s CROSS JOIN k),
md AS (SELECT domain, (bad + m * kd) / (n + kd) AS m FROM d JOIN ms USING (suffix) CROSS JOIN k),
mh AS (
  SELECT host, m, sqrt(m * (1 - m) / (n + kh + 1)) AS sd
  FROM (SELECT host, n, kh, (bad + m * kh) / (n + kh) AS m FROM h JOIN md USING (domain) CROSS JOIN k)
), rules(says, rule, rhost, rpath) AS (VALUES {_rules()}),
fit AS (
  SELECT page_id, says, rule,
    row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC, length(rhost) DESC, says DESC, rule) AS i
  FROM p JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT p.page_id, p.host, path, rule,
  coalesce(says, CASE WHEN m - {Z} * sd > {LIMIT} THEN 'block' ELSE 'allow' END) AS verdict
FROM p JOIN mh USING (host) LEFT JOIN (SELECT * FROM fit WHERE i = 1) f ON p.page_id = f.page_id
"""


def _crc32(hex_text: str) -> str:
    """Unsigned crc32 of bytes given as hex text; needs the table ``crc``."""
    octets = f"list_transform(generate_series(1, length({hex_text}), 2), lambda k: ('0x' || substr({hex_text}, k, 2))::BIGINT)"
    return f"xor(list_reduce({octets}, lambda c, x: xor(c >> 8, crc.t[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295)"


#: The table of crc32, from its polynomial.
CRC = """crc AS (
  SELECT list(list_reduce(generate_series(1, 8), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) ORDER BY b) AS t
  FROM (SELECT unnest(generate_series(0::BIGINT, 255)) AS b)
)"""


def _field(value: str) -> str:
    return f"coalesce(octet_length(encode({value}::VARCHAR))::VARCHAR || ':' || {value}::VARCHAR, '-')"


def _leaf(n_chars: str) -> str:
    return f"sha256({' || '.join(map(_field, ('doc_id', 'source', 'lang', n_chars, 'text')))})"


# Trees of all languages (crown 0) are built level by level, then the tree of their roots.
OP12 = f"""
WITH RECURSIVE {CRC}, d AS (
  SELECT doc_id, lang, {_leaf("n_chars")} AS leaf,
    CASE WHEN {_crc32("hex(encode(doc_id::VARCHAR))")} % 7 = 0 THEN {_leaf("(n_chars + 1)")} END AS changed
  FROM documents, crc
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM d
), node AS (
  SELECT lang, 0 AS level, i, leaf AS h, n FROM ranked
  UNION ALL
  SELECT lang, level + 1, i // {FAN_OUT}, sha256(string_agg(h, '' ORDER BY i)), (n + {FAN_OUT - 1}) // {FAN_OUT}
  FROM node WHERE n > 1 GROUP BY lang, level, i // {FAN_OUT}, n
), subroot AS (
  SELECT lang, h, level AS levels, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM node WHERE n = 1
), crown AS (
  SELECT 0 AS level, i, h, n FROM subroot
  UNION ALL
  SELECT level + 1, i // {FAN_OUT}, sha256(string_agg(h, '' ORDER BY i)), (n + {FAN_OUT - 1}) // {FAN_OUT}
  FROM crown WHERE n > 1 GROUP BY level, i // {FAN_OUT}, n
), way AS (
  SELECT r.doc_id, r.leaf, coalesce(r.changed, r.leaf) AS folded, r.lang, r.i, s.h AS subroot, s.i AS s, s.levels,
    s.levels + (SELECT max(level) FROM crown) AS all_levels, row_number() OVER () AS id
  FROM ranked r JOIN subroot s ON r.lang IS NOT DISTINCT FROM s.lang
), side AS (
  SELECT id, n.level, n.i < w.i // ({FAN_OUT} ** n.level)::BIGINT AS left_of, n.i, n.h
  FROM way w JOIN node n ON w.lang IS NOT DISTINCT FROM n.lang AND n.level < w.levels
    AND n.i // {FAN_OUT} = w.i // ({FAN_OUT} ** (n.level + 1))::BIGINT AND n.i <> w.i // ({FAN_OUT} ** n.level)::BIGINT
  UNION ALL
  SELECT id, w.levels + c.level, c.i < w.s // ({FAN_OUT} ** c.level)::BIGINT, c.i, c.h
  FROM way w JOIN crown c ON c.i // {FAN_OUT} = w.s // ({FAN_OUT} ** (c.level + 1))::BIGINT AND c.i <> w.s // ({FAN_OUT} ** c.level)::BIGINT
    AND c.n > 1
), step AS (
  SELECT id, level, coalesce(string_agg(h, '' ORDER BY i) FILTER (left_of), '') AS l, coalesce(string_agg(h, '' ORDER BY i) FILTER (NOT left_of), '') AS r
  FROM side GROUP BY id, level
), proof AS (SELECT id, string_agg(l || r, '' ORDER BY level) AS p FROM step GROUP BY id),
fold AS (
  SELECT id, 0 AS level, folded AS h, all_levels FROM way
  UNION ALL
  SELECT f.id, f.level + 1, sha256(coalesce(l, '') || h || coalesce(r, '')), all_levels
  FROM fold f LEFT JOIN step s ON f.id = s.id AND f.level = s.level WHERE f.level < all_levels
)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(p, '')) AS proof_sha256, f.h AS folded_root, f.h = root AS verified
FROM way w LEFT JOIN proof USING (id) JOIN (SELECT id, h FROM fold WHERE level = all_levels) f USING (id),
  (SELECT h AS root FROM crown WHERE n = 1)
"""


# Words that share what is left without one letter, at the same place, differ by a
# replaced letter; a word that is what is left of another differs by an inserted one.
OP11 = f"""
WITH RECURSIVE {CRC}, run AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[{LETTERS}]{{{SHORTEST},}}')),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents
), hashed AS (
  SELECT run, n, {_crc32("hex(encode(id || ':' || run))")} AS h FROM (SELECT id, run, count(*) AS n FROM run GROUP BY ALL), crc
), named AS (
  SELECT n, CASE WHEN h % {EVERY} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS name FROM hashed
), w AS (
  SELECT name AS word, sum(n)::BIGINT AS n FROM named GROUP BY name HAVING sum(named.n) >= {FEWEST} AND length(name) >= {SHORTEST}
), cut AS (SELECT word, n, k, substr(word, 1, k - 1) || substr(word, k + 1) AS left_over FROM w, unnest(range(1, length(word) + 1)) AS t(k)),
near AS (
  SELECT a.word, b.word AS near, b.n FROM cut a JOIN cut b ON a.left_over = b.left_over AND a.k = b.k AND a.word <> b.word
  UNION SELECT w.word, cut.word, cut.n FROM w JOIN cut ON w.word = left_over
  UNION SELECT cut.word, w.word, w.n FROM w JOIN cut ON w.word = left_over
), best AS (SELECT word, count(*) AS n_near, max(n) AS top, arg_min(near, (-n, near)) AS near FROM near GROUP BY word),
found AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= {TIMES} * w.n THEN near END AS form, CASE WHEN top >= {TIMES} * w.n THEN top END AS form_n
  FROM w LEFT JOIN best USING (word)
), way AS (
  SELECT word, word AS last, form FROM found
  UNION ALL
  SELECT way.word, f.word, f.form FROM way JOIN found f ON way.form = f.word
)
SELECT word, f.form, last AS root, n, n_near, form_n FROM found f JOIN (SELECT word, last FROM way WHERE form IS NULL) USING (word)
"""
