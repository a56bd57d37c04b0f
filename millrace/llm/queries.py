"""The registered queries of the training-data operators, and SQL where it can state one."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession

from . import alignment, bpe_tree, brown, domtrees, ivfpq, kdtopk, mixing, packing, resampling, simhash_bk, suffix_dedup, urlrep, zdict_tox
from .common import table


def op1_kdtopk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtopk.top_k(table(spark, sf_dir, "embeddings"))


def op2_urlrep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrep.judge(table(spark, sf_dir, "pages"))


def op3_zdict_tox(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return zdict_tox.score(docs, zdict_tox.fit(docs, table(spark, sf_dir, "labels")))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeats(table(spark, sf_dir, "documents"))


def op5_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_ivfpq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ivfpq.neighbours(table(spark, sf_dir, "embeddings"))


def op8_domtrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domtrees.extract(table(spark, sf_dir, "pages"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_tree.digests(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_bk.near_duplicates(table(spark, sf_dir, "documents"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_kdtopk": op1_kdtopk,
    "op2_urlrep": op2_urlrep,
    "op3_zdict_tox": op3_zdict_tox,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_brown": op5_brown,
    "op6_packing": op6_packing,
    "op7_ivfpq": op7_ivfpq,
    "op8_domtrees": op8_domtrees,
    "op9_bpe": op9_bpe,
    "op10_simhash": op10_simhash,
    "op11_alignment": op11_alignment,
    "op12_resampling": op12_resampling,
    "op13_mixing": op13_mixing,
}

_TOP_K = f"""
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % {kdtopk.EVERY} = 0 AND c.vec_id <> q.vec_id AND len(c.e) = len(q.e)
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {kdtopk.K}
"""


def _url_sql() -> str:
    fits = "\n".join(
        f"    WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}') THEN '{{{k}}}'"
        for k, (h, _, p) in ((k, r[1].partition("/")) for k, r in sorted(enumerate(urlrep.RULES), key=lambda x: -len(x[1][1])))
    )
    rule = fits.format(*[r for _, r in urlrep.RULES])
    own = fits.format(*[v for v, _ in urlrep.RULES])
    host = f"translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^([^/?#]*)', 1), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    path = "regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1)"
    known = ", ".join(f"'{x}'" for x in urlrep.SUFFIXES)
    none = "url IS NULL OR strpos(url, '://') = 0"
    strength = f"""
    SELECT CASE WHEN coalesce(n, 0) = 0 OR g < 2 THEN {urlrep.MOST}
      WHEN k / n * (1 - k / n) <= 0 OR n - nn / n - (g - 1) <= 0 THEN {urlrep.MOST}
      WHEN r <= 1 / (1 + {urlrep.MOST}) THEN {urlrep.MOST} WHEN r >= 1 / (1 + {urlrep.LEAST}) THEN {urlrep.LEAST} ELSE (1 - r) / r END AS s
    FROM (SELECT *, ((kk - n * (k / n) * (k / n)) - (k / n) * (1 - k / n) * (g - 1)) / nullif((k / n) * (1 - k / n) * (n - nn / n - (g - 1)), 0) AS r
      FROM (SELECT CAST(count(*) AS DOUBLE) AS g, CAST(sum(n) AS DOUBLE) AS n, CAST(sum(k) AS DOUBLE) AS k, sum(CAST(n AS DOUBLE) * n) AS nn, sum(CAST(k AS DOUBLE) * k / n) AS kk FROM {{0}} WHERE n > 0))"""
    return f"""
WITH p AS (
  SELECT page_id, CASE WHEN {none} THEN '' ELSE {host} END AS host, CASE WHEN {none} THEN '' ELSE {path} END AS path FROM pages
), rows AS (
  SELECT *, CASE
{rule} END AS rule, CASE
{own} END AS own FROM p
), hosts AS (
  SELECT host, count(rule) AS n, count(CASE WHEN own = 'block' THEN 1 END) AS k,
    CASE WHEN bare.address THEN 'address' WHEN bare.two IN ({known}) THEN bare.two ELSE bare.labels[-1] END AS suffix,
    CASE WHEN bare.address THEN bare.host WHEN bare.two IN ({known}) THEN concat_ws('.', bare.labels[-3], bare.two) ELSE bare.two END AS domain
  FROM (SELECT host, rule, own, {{'host': b, 'labels': string_split(b, '.'), 'two': concat_ws('.', string_split(b, '.')[-2], string_split(b, '.')[-1]), 'address': regexp_matches(b, '{urlrep.ADDRESS}')}} AS bare
    FROM (SELECT *, regexp_replace(host, ':[0-9]*$', '') AS b FROM rows)) GROUP BY host, bare
), domains AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY domain, suffix),
suffixes AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM domains GROUP BY suffix),
s1 AS ({strength.format("hosts")}), s2 AS ({strength.format("domains")}), s3 AS ({strength.format("suffixes")}),
base AS (SELECT (coalesce(sum(k), 0) + 0.5) / (coalesce(sum(n), 0) + 1.0) AS rate FROM suffixes),
by_suffix AS (SELECT suffix, (k + rate * s) / (n + s) AS above FROM suffixes, base, s3),
by_domain AS (SELECT d.domain, d.suffix, (d.k + u.above * s) / (d.n + s) AS above FROM domains d JOIN by_suffix u USING (suffix), s2),
ab AS (SELECT h.host, h.k + d.above * s AS a, h.n - h.k + (1 - d.above) * s AS b FROM hosts h JOIN by_domain d USING (domain, suffix), s1),
judged AS (SELECT host, CASE WHEN a / (a + b) - {urlrep.Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > {urlrep.BAD} THEN 'block' ELSE 'allow' END AS by_host FROM ab)
SELECT r.page_id, r.host, r.path, r.rule, coalesce(r.own, j.by_host) AS verdict FROM rows r JOIN judged j USING (host)
"""


def _number(*of: str) -> str:
    return f"CAST('0x' || md5(concat_ws(':', {mixing.SEED}, {', '.join(of)}))[1:15] AS BIGINT)"


_EARLIER = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
_MIX = f"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents
), src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS ss, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no FROM d GROUP BY source
), w AS (SELECT *, list_extract([{', '.join(map(str, mixing.WEIGHTS))}], no % {len(mixing.WEIGHTS)} + 1)::DOUBLE AS weight FROM src),
fill AS (
  SELECT *, {mixing.MOST} * ss / weight AS r,
    ({mixing.SHARE} * (SELECT sum(ss) FROM w)::DOUBLE - coalesce(sum({mixing.MOST} * ss) OVER (ORDER BY {mixing.MOST} * ss / weight, no {_EARLIER}), 0)::DOUBLE)
      / sum(weight) OVER (ORDER BY {mixing.MOST} * ss / weight, no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate FROM w
), t AS (
  SELECT source, no, ss, least(weight * coalesce((SELECT rate FROM fill WHERE rate <= r ORDER BY r, no LIMIT 1), 0), ({mixing.MOST} * ss)::DOUBLE) AS target, (ss + {mixing.BLOCK - 1}) // {mixing.BLOCK} AS k FROM w
), q AS (
  SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS words,
    CASE WHEN target > 0 THEN CAST(least({mixing.MOST} * k, floor(target / (ss / k)) + {mixing.MORE}) AS BIGINT) ELSE 0 END AS quota FROM t
), ranges AS (SELECT *, CAST(coalesce(sum(quota) OVER (ORDER BY no {_EARLIER}), 0) AS BIGINT) AS low FROM q),
line AS (
  SELECT d.*, no, CAST(coalesce(sum(d.size) OVER (PARTITION BY no ORDER BY {_number("'line'", "doc_id")} NULLS LAST, doc_id {_EARLIER}), 0) AS BIGINT) AS start
  FROM d JOIN src ON d.source IS NOT DISTINCT FROM src.source
), draws AS (
  SELECT slot, {_number("'draw'", "slot")} % n AS v FROM (SELECT unnest(range(n)) AS slot, n FROM (SELECT CAST(sum(quota) AS BIGINT) AS n FROM q))
), drawn AS (
  SELECT slot, no, row_number() OVER (PARTITION BY no ORDER BY slot) - 1 AS i FROM draws JOIN ranges ON v >= low AND v < low + quota
), got AS (
  SELECT q.*, coalesce(g, 0) AS got FROM q LEFT JOIN (SELECT no, count(*) AS g FROM drawn GROUP BY no) USING (no)
), off AS (
  SELECT *, coalesce(sum(greatest(0, got - quota)) OVER (ORDER BY no {_EARLIER}), 0) AS spare, coalesce(sum(greatest(0, quota - got)) OVER (ORDER BY no {_EARLIER}), 0) AS gap FROM got
), numbered AS (
  SELECT slot, no, i FROM drawn JOIN off USING (no) WHERE i < quota
  UNION ALL
  SELECT slot, o.no, o.got + j - o.gap AS i FROM (SELECT slot, spare + i - quota AS j FROM drawn JOIN off USING (no) WHERE i >= quota) JOIN off o ON j >= o.gap AND j < o.gap + greatest(0, o.quota - o.got)
), placed AS (
  SELECT slot, no, CAST(i AS BIGINT) AS i, ss, k, words, CAST(list_reduce(range(1, {mixing.ROUNDS + 1}), lambda a, r:
    CASE WHEN md5(concat_ws(':', {mixing.SEED}, 'swap', no, CAST(i // k AS BIGINT), r, greatest(a, ({_number("'turn'", "no", "CAST(i // k AS BIGINT)", "r")} % k - a + k) % k))) >= '8'
      THEN ({_number("'turn'", "no", "CAST(i // k AS BIGINT)", "r")} % k - a + k) % k ELSE a END, CAST(i % k AS BIGINT)) AS BIGINT) AS block
  FROM numbered JOIN q USING (no)
), full_ AS (SELECT *, least({mixing.BLOCK}, ss - block * {mixing.BLOCK}) AS own FROM placed),
slots AS (
  SELECT no, block, greatest(0, least(own, words - coalesce(sum(own) OVER (PARTITION BY no ORDER BY i {_EARLIER}), 0))) AS take FROM full_
), took AS (
  SELECT l.doc_id, l.no, l.start, sum(greatest(0, least(l.start + l.size, block * {mixing.BLOCK} + take) - greatest(l.start, block * {mixing.BLOCK}))) AS n
  FROM line l JOIN slots s ON s.no = l.no AND s.block * {mixing.BLOCK} < l.start + l.size AND s.block * {mixing.BLOCK} + s.take > l.start WHERE l.size > 0 GROUP BY l.doc_id, l.no, l.start
)
SELECT l.doc_id, l.size, t.ss AS source_size, t.target, CAST(coalesce(k.n, 0) AS BIGINT) AS taken
FROM line l JOIN t USING (no) LEFT JOIN took k ON k.no = l.no AND k.start = l.start AND k.doc_id IS NOT DISTINCT FROM l.doc_id AND l.size > 0
"""


ORACLES: dict[str, str] = {
    "op1_kdtopk": _TOP_K,
    "op2_urlrep": _url_sql(),
    "op13_mixing": _MIX,
}
