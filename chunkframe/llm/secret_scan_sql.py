"""DuckDB SQL of ``op9_secret_ownership``."""

from .secret_scan import BASE, CANDIDATES


def _kind(k: int, pattern: str, least: int, must) -> str:
    q = pattern.replace("'", "''")
    keep = [f"regexp_matches(m, '{x}')" for x in must] + ([f"length(regexp_extract(m, '{q}', 1)) >= {least}"] if least else [])
    return f"""SELECT rid, s AS start, {k} AS kind, s + length(m) AS stop, m FROM (
      SELECT rid, found[i] AS m, CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s
      FROM (SELECT rid, found, gaps, unnest(range(1, len(found) + 1)) AS i FROM (
        SELECT rid, regexp_extract_all(t, '{q}') AS found, regexp_split_to_array(t, '{q}') AS gaps FROM d WHERE regexp_matches(t, '{q}'))))
      {'WHERE ' + ' AND '.join(keep) if keep else ''}"""


def op9_sql(source: str = "documents", max_owners: int = 2) -> str:
    base = " UNION ALL ".join(_kind(k, p, n, ()) for k, (p, n) in enumerate(BASE.values()))
    more = " UNION ALL ".join(_kind(k + len(BASE), p, 0, must) for k, (p, must) in enumerate(CANDIDATES.values()))
    names = " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate([*BASE, *CANDIDATES]))
    shown = f"(CASE kind {names} END) || ':' || start || ':' || stop"
    assign = BASE["assign"][0].replace("'", "''")
    value = f"CASE WHEN kind = 0 THEN regexp_extract(m, '{assign}', 1) ELSE m END"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, source AS owner FROM {source}),
b AS ({base}),
c0 AS ({more}),
c AS (SELECT rid, start, kind, stop, {value} AS m FROM b UNION ALL SELECT rid, start, kind, stop, m FROM c0 WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.rid = c0.rid AND b.start < c0.stop AND c0.start < b.stop)),
own AS (SELECT m, count(DISTINCT coalesce(owner, '')) AS o FROM c JOIN d USING (rid) GROUP BY m),
live AS (SELECT c.*, o <= {max_owners} AS live FROM c JOIN own USING (m)),
per AS (SELECT rid, count(*) FILTER (WHERE kind = 0) AS a, count(*) FILTER (WHERE kind = 1) AS k, count(*) FILTER (WHERE kind = 2) AS h,
        string_agg({shown}, ',' ORDER BY start, kind) AS s FROM b GROUP BY rid),
every AS (SELECT rid, string_agg({shown}, ',' ORDER BY start, kind, stop) AS s FROM (SELECT rid, start, kind, stop FROM b UNION ALL SELECT rid, start, kind, stop FROM live WHERE live AND kind >= {len(BASE)}) GROUP BY rid),
seen AS (SELECT rid, count(*) FILTER (WHERE live) AS n_live, count(*) FILTER (WHERE NOT live) AS n_example FROM live GROUP BY rid)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(k, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(per.s, '')) AS base_sha256,
       coalesce(every.s, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM d LEFT JOIN per USING (rid) LEFT JOIN every USING (rid) LEFT JOIN seen USING (rid)"""
