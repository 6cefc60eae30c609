"""DuckDB SQL of ``op3_quality_rules``: counts, distances to the fixed references."""

from .quality_rules import CLASSES, COMMON_WORDS, PROSE, zipf

_S = r"[\x20\x09-\x0D]"


def _class_count(one: str) -> str:
    inverse = one.replace("[", "[^") if one.startswith("[") else one.replace(r"\p", r"\P")
    inverse = inverse.replace("'", "''")
    return f"CAST(length(regexp_replace(t, '{inverse}+', '', 'g')) AS BIGINT)"


def judged(source: str = "documents") -> str:
    """CTEs ending in ``verdict(doc_id, ..., base_failed, kept)`` over ``source``."""
    known = [_class_count(x) for x in CLASSES.values()]
    spaces = f"CAST(length(t) - length(regexp_replace(t, '{_S}+', '', 'g')) AS BIGINT)"
    lists = "CASE lang " + " ".join(f"WHEN '{k}' THEN [{', '.join(repr(w) for w in v)}]" for k, v in COMMON_WORDS.items()) + " ELSE CAST([] AS VARCHAR[]) END"
    def js(c, r):
        return f"""(SELECT CASE WHEN sum(x) > 0 AND sum(y) > 0 THEN sqrt(greatest(0, sum(
        (CASE WHEN x > 0 THEN x / sx * log2(x / sx / ((x / sx + y / sy) / 2)) ELSE 0 END
       + CASE WHEN y > 0 THEN y / sy * log2(y / sy / ((x / sx + y / sy) / 2)) ELSE 0 END) / 2))) ELSE 0 END
      FROM (SELECT x, y, sum(x) OVER () AS sx, sum(y) OVER () AS sy FROM (SELECT CAST(unnest({c}) AS DOUBLE) AS x, CAST(unnest({r}) AS DOUBLE) AS y)))"""

    n = len(CLASSES) + 2
    return f"""
w AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS lang,
      list_filter(regexp_split_to_array(coalesce(text, ''), '{_S}+'), lambda x: x <> '') AS ws FROM {source}),
win AS (SELECT rid, i, array_to_string(ws[i:i + 7], ' ') AS s FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) > 8)),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS c FROM win) WHERE c > 1),
rep AS (SELECT rid, CAST(sum(least(8, i - coalesce(before, i - 8))) AS BIGINT) AS n
        FROM (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS before FROM dup) GROUP BY rid),
lines AS (SELECT rid, count(*) - count(DISTINCT l) AS n FROM (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM w)
          WHERE length(regexp_replace(l, '{_S}+', '', 'g')) > 0 GROUP BY rid),
c0 AS (SELECT *, [{', '.join(known)}, {spaces}] AS k,
      CASE WHEN lang IN ({', '.join(repr(x) for x in COMMON_WORDS)}) THEN lang ELSE 'other' END AS key, {lists} AS common FROM w),
c AS (SELECT rid, doc_id, key, len(ws) AS n_words, k[{n - 1}] AS spaces, k[{list(CLASSES).index('symbol') + 1}] AS n_symbols, length(t) AS n_chars,
      list_append(k, CAST(length(t) - list_sum(k) AS BIGINT)) AS a,
      [{', '.join(f"CAST(len(list_filter(ws, lambda x: x = common[{j + 1}])) AS BIGINT)" for j in range(20))}] AS b FROM c0),
h AS (SELECT *, list_append(b, CAST(n_words - list_sum(b) AS BIGINT)) AS bb FROM c),
far AS (SELECT h.*, {js('a', PROSE)} AS class_distance, CASE WHEN h.key = 'other' THEN 0 ELSE {js('bb', zipf())} END AS common_distance FROM h),
base AS (SELECT far.rid, doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_chars - spaces AS BIGINT) AS word_chars, n_symbols,
         CAST(coalesce(lines.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, class_distance, common_distance
         FROM far LEFT JOIN lines ON lines.rid = far.rid LEFT JOIN rep ON rep.rid = far.rid),
failed AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base),
verdict AS (SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
        NOT base_failed AND NOT (n_words >= 20 AND (class_distance > 0.1 + 1.0 / sqrt(n_words) OR common_distance > 0.1 + 1.7 / sqrt(n_words))) AS kept FROM failed)"""


OP3_SQL = f"WITH {judged()}\nSELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM verdict"
