"""DuckDB twins of the registered queries that SQL can express."""

from __future__ import annotations

_BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = f"""
WITH cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
numbered AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS place FROM cut),
keyed AS (SELECT doc_id, place, line, {_LOWERED.format(f"trim(line, {_BLANKS})")} AS key FROM numbered),
repeated AS (
  SELECT key, min(doc_id) AS first_id FROM keyed WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) > 1),
judged AS (
  SELECT doc_id, place, line, coalesce(first_id <> doc_id, false) AS dropped
  FROM keyed LEFT JOIN repeated USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

_WORDS = "regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+')"

OP6 = f"""
WITH dw AS (SELECT doc_id, {_WORDS} AS w FROM documents),
iw AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
       FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM dw)),
its AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') AS s
        FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM iw)),
n AS (SELECT item_id, count(*) AS n FROM its GROUP BY item_id),
pairs AS (SELECT doc_id, item_id, count(*) / n AS containment
          FROM ds JOIN its USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id, n),
hits AS (SELECT doc_id, list(item_id ORDER BY item_id) AS item_ids, max(containment) AS containment
         FROM pairs WHERE containment >= 0.8 GROUP BY doc_id)
SELECT d.doc_id, item_ids IS NOT NULL AS contaminated, coalesce(item_ids, []::BIGINT[]) AS item_ids,
       coalesce(containment, 0.0)::DOUBLE AS containment
FROM documents d LEFT JOIN hits USING (doc_id)
"""

OP9 = """
WITH d AS (SELECT doc_id, ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS hash,
                  coalesce(strlen(text), 0) AS bytes FROM documents),
p AS (SELECT doc_id, bytes, depth, hash >> (60 - depth) AS prefix FROM d, (SELECT unnest(range(61))::INTEGER AS depth)),
s AS (SELECT depth, prefix, sum(bytes)::BIGINT AS shard_bytes, count(*) AS shard_rows FROM p GROUP BY depth, prefix),
shards AS (
  SELECT s.* FROM s LEFT JOIN s AS above ON above.depth = s.depth - 1 AND above.prefix = s.prefix >> 1
  WHERE (s.shard_bytes <= 1048576 OR s.depth = 60) AND (s.depth = 0 OR above.shard_bytes > 1048576))
SELECT doc_id, CASE WHEN depth = 0 THEN '' ELSE right(lpad(bin(prefix), 60, '0'), depth) END AS shard,
       depth, shard_bytes, shard_rows
FROM p JOIN shards USING (depth, prefix)
"""


_TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"

OP13 = f"""
WITH dt AS (SELECT doc_id, row_number() OVER () AS nr, regexp_extract_all({_LOWERED.format("text")}, '{_TERM}') AS w FROM documents),
d AS (SELECT doc_id, nr, w, len(w) AS n FROM dt WHERE len(w) > 0),
c AS (SELECT count(*) AS texts, sum(n)::BIGINT AS total FROM d),
it AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWERED.format("text")}, '{_TERM}')) AS term FROM benchmark),
v AS (SELECT DISTINCT term FROM it),
o AS (SELECT nr, term, count(*) AS tf FROM (SELECT nr, unnest(w) AS term FROM d) SEMI JOIN v USING (term) GROUP BY nr, term),
f AS (SELECT term, count(*) AS df FROM o GROUP BY term),
w AS (SELECT term, floor(1000 * ln((2 * texts + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM f, c),
m AS (SELECT nr, doc_id, 10 + (90 * n * texts) // total AS m FROM d, c),
s AS (SELECT item_id, nr, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
      FROM it JOIN o USING (term) JOIN w USING (term) JOIN m USING (nr) GROUP BY item_id, nr, doc_id),
r AS (SELECT item_id, doc_id, score,
             row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST)::INTEGER AS rank
      FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": OP2, "op6_decontamination": OP6, "op9_sharding": OP9, "op13_mask_search": OP13}
