"""DuckDB SQL for the text queries that SQL can express."""

ORACLE: dict[str, str] = {}

ORACLE["op10_line_dedup"] = r"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
line AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM split),
keyed AS (SELECT *, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))),
                              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM line),
first AS (SELECT key, min(doc_id) AS owner FROM keyed WHERE length(key) >= 10 GROUP BY key),
marked AS (SELECT k.doc_id, k.pos, k.line, coalesce(f.owner < k.doc_id, false) AS dropped
           FROM keyed k LEFT JOIN first f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

_WORDS = ("regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
          r"'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")

ORACLE["op5_decontamination"] = f"""
WITH item AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
phrase AS (SELECT DISTINCT item_id, least(len(w), 10) AS n,
                  array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS body
           FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM item WHERE len(w) > 0)),
doc AS (SELECT doc_id, {_WORDS} AS w FROM documents),
place AS (SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS body
          FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM doc)
          CROSS JOIN (SELECT DISTINCT n FROM phrase) WHERE p + n - 1 <= len(w)),
hit AS (SELECT place.doc_id, place.p, place.n, phrase.item_id FROM place
        JOIN phrase ON place.n = phrase.n AND place.body = phrase.body),
word AS (SELECT doc_id, count(DISTINCT q) AS n_hit
         FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(word.n_hit, 0) AS n_hit,
       coalesce(found.n_items, 0) AS n_items, sha256(coalesce(found.items, '')) AS items_sha256,
       coalesce(word.n_hit, 0) > 0 AS contaminated
FROM doc d LEFT JOIN word ON d.doc_id = word.doc_id LEFT JOIN found ON d.doc_id = found.doc_id
"""

ORACLE["op1_bwt_dedup"] = """
WITH body AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
block AS (SELECT doc_id, k, substr(h, 800 * k + 1, 1600) AS h
          FROM (SELECT doc_id, h, unnest(range(0, len(h) // 800 + 1)) AS k FROM body)),
start AS (SELECT doc_id, k, h, unnest(range(0, least(greatest(len(h) // 2 - 399, 0), 400))) AS j FROM block),
win AS (SELECT doc_id, 400 * k + j AS i, hash(substr(h, 2 * j + 1, 800)) AS w FROM start),
again AS (SELECT doc_id, i FROM win WHERE w IN (SELECT w FROM win GROUP BY w HAVING count(*) > 1)),
marked AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400, true) AS fresh FROM again),
run AS (SELECT doc_id, i, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM marked),
span AS (SELECT doc_id, k, min(i) AS a, max(i) + 400 AS b FROM run GROUP BY doc_id, k),
gap AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS c FROM span),
kept AS (SELECT g.doc_id, count(*) AS n_spans, sum(g.b - g.a) AS n_removed, max(g.b) AS last,
                string_agg(substr(t.h, 2 * g.c + 1, 2 * (g.a - g.c)), '' ORDER BY g.a) AS h
         FROM gap g JOIN body t ON g.doc_id = t.doc_id GROUP BY g.doc_id)
SELECT t.doc_id, CAST(len(t.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed,
       coalesce(k.n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN k.doc_id IS NULL THEN t.h ELSE k.h || substr(t.h, 2 * k.last + 1) END)) AS kept_sha256
FROM body t LEFT JOIN kept k ON t.doc_id = k.doc_id
"""


def _clusters(rounds: int, k: int, dims: int) -> str:
    """Rounds of assignment and exact floors, one common table expression each."""
    gap = "list_sum(list_transform(range(1, {d} + 1), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))".format(d=dims)
    steps = [f"""vec AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE len(embedding) = {dims}
    AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {dims}),
c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('2:' || CAST(vec_id AS VARCHAR))) - 1 AS INTEGER) AS c, x
  FROM vec QUALIFY c < {k})"""]
    for n in range(rounds + 1):
        steps.append(f"""a{n} AS MATERIALIZED (
  SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d
  FROM (SELECT v.r, c.c, CAST({gap} AS BIGINT) AS d FROM vec v CROSS JOIN c{n} c) GROUP BY r)""")
        if n < rounds:
            steps.append(f"""c{n + 1} AS MATERIALIZED (
  SELECT old.c, coalesce(new.x, old.x) AS x FROM c{n} old LEFT JOIN (
    SELECT c, list(CAST(m AS BIGINT) ORDER BY i) AS x FROM (
      SELECT c, i, (s - ((s % n) + n) % n) // n AS m FROM (
        SELECT a.c, i, sum(v.x[i]) AS s, count(*) AS n FROM a{n} a JOIN vec v ON a.r = v.r,
          unnest(range(1, {dims} + 1)) AS p(i) GROUP BY a.c, i)) GROUP BY c) new ON old.c = new.c)""")
    last = f"a{rounds}"
    return f"""WITH {", ".join(steps)}
SELECT v.vec_id, a.c AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM {last} a JOIN vec v ON a.r = v.r JOIN c{rounds} c ON a.c = c.c"""


ORACLE["op11_vp_clusters"] = _clusters(rounds=5, k=40, dims=64)
