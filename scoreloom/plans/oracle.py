"""DuckDB text shared by the checking SQL: points, units, counts, and the four losses."""

from __future__ import annotations

POINTS = """points AS (
  SELECT l_suppkey AS series_id, s_nationkey AS source_id,
         row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS t,
         l_extendedprice AS x, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, l_quantity AS qty, l_discount AS disc, l_tax AS tax
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey)"""

COUNTS = POINTS + """, counts AS (
  SELECT source_id, series_id, count(*) AS n, CAST(sum(y) AS BIGINT) AS pos FROM points GROUP BY ALL
), per_source AS (
  SELECT source_id, count(*) AS n_series, CAST(sum(n) AS BIGINT) AS source_points FROM counts GROUP BY source_id
), means AS (
  SELECT source_id, avg(pos / n) AS m FROM counts GROUP BY source_id
), prior AS (
  SELECT source_id, (sum(m) OVER () - m) / (count(*) OVER () - 1) AS prior FROM means
)"""


def loss(p: str, pos: str = "pos", n: str = "n") -> str:
    q = f"greatest(least({p}, 1 - 1e-7::DOUBLE), 1e-7::DOUBLE)"
    return f"-({pos} * log2({q}) + ({n} - {pos}) * log2(1 - {q}))"


def rank01(v: str, key: str = "series_id") -> str:
    return (
        f"(rank() OVER (PARTITION BY {key} ORDER BY {v}) + (count(*) OVER (PARTITION BY {key}, {v}) - 1) / 2.0::DOUBLE - 0.5::DOUBLE)"
        f" / count(*) OVER (PARTITION BY {key})"
    )


def average_rank(v: str, key: str) -> str:
    return f"rank() OVER (PARTITION BY {key} ORDER BY {v}) + (count(*) OVER (PARTITION BY {key}, {v}) - 1) / 2.0::DOUBLE"


NULLS = COUNTS + f""", nulls AS (
  SELECT counts.*, prior, {loss('prior')} / n AS L_null FROM counts JOIN prior USING (source_id)
)"""

UNITS = NULLS + f""", units AS (
  SELECT source_id, series_id, y, {rank01('x')} AS u, {rank01('qty')} AS u_qty, {rank01('disc')} AS u_disc, {rank01('tax')} AS u_tax FROM points
)"""

_COUNTED = " UNION ALL ".join(
    ["SELECT 'basis' AS k, '' AS d, source_id, series_id, floor(u * 10) AS bin, count(*) AS n, sum(y) AS pos FROM units GROUP BY ALL"]
    + [f"SELECT 'alone', '{d}', source_id, series_id, floor(u_{d} * 10), count(*), sum(y) FROM units GROUP BY ALL" for d in ("qty", "disc", "tax")]
    + [f"SELECT 'both', '{d}', source_id, series_id, floor(u * 5) * 5 + floor(u_{d} * 5), count(*), sum(y) FROM units GROUP BY ALL" for d in ("qty", "disc", "tax")]
)

LOSSES = UNITS + f""", binned AS ({_COUNTED}
), sized AS (
  SELECT b.*, c.n AS T, 1 / (n_series * c.n) AS w FROM binned b JOIN counts c USING (source_id, series_id) JOIN per_source USING (source_id)
), parts AS (
  SELECT k, d, source_id, bin, sum(pos * w) AS a, sum(n * w) AS b FROM sized GROUP BY ALL
), trained AS (
  SELECT k, d, source_id, bin, CASE WHEN count(*) OVER g = 1 THEN prior ELSE (sum(a) OVER g - a) / (sum(b) OVER g - b) END AS p
  FROM parts JOIN prior USING (source_id) WINDOW g AS (PARTITION BY k, d, bin)
), scored AS (
  SELECT k, d, source_id, series_id, sum({loss('p')}) / max(T) AS l FROM sized JOIN trained USING (k, d, source_id, bin) GROUP BY ALL
), losses AS (
  SELECT a.d AS detector, nulls.series_id, nulls.source_id, nulls.n AS n_points, nulls.pos AS n_anomalies, L_null, b.l AS L_basis,
         a.l AS L_detector, j.l AS L_basis_detector, L_null - b.l AS basis_utility, L_null - a.l AS detector_utility, b.l - j.l AS CDU
  FROM nulls JOIN scored b ON b.series_id = nulls.series_id AND b.k = 'basis' JOIN scored a ON a.series_id = nulls.series_id AND a.k = 'alone'
  JOIN scored j ON j.series_id = nulls.series_id AND j.k = 'both' AND j.d = a.d
)"""

BY_SOURCE = LOSSES + """, by_source AS (
  SELECT detector, source_id, avg(L_null) AS L_null, avg(L_basis) AS L_basis, avg(L_detector) AS L_detector,
         avg(L_basis_detector) AS L_basis_detector, avg(basis_utility) AS basis_utility, avg(detector_utility) AS detector_utility,
         avg(CDU) AS CDU, count(*) AS n_series
  FROM losses GROUP BY ALL
)"""

SUMMARY = BY_SOURCE + """, summary AS (
  SELECT detector, avg(L_null) AS L_null, avg(L_basis) AS L_basis, avg(L_detector) AS L_detector, avg(L_basis_detector) AS L_basis_detector,
         avg(basis_utility) AS basis_utility, avg(detector_utility) AS detector_utility, avg(CDU) AS CDU,
         avg(CASE WHEN CDU > 0 THEN 1.0 ELSE 0.0 END) AS positive_source_fraction, count(*) FILTER (CDU > 0) AS positive_sources,
         count(*) AS n_sources, CAST(sum(n_series) AS BIGINT) AS n_series
  FROM by_source GROUP BY detector
)"""


def r(value: str, places: int = 6) -> str:
    return f"round({value}, {places}) + 0.0"


def boot(values: str, draws: int, seed: int = 2024) -> str:
    """``values`` is a query (family, condition, source_id, v); then ``stats`` and the resampled means ``boot`` (family, condition, rep, m)."""
    return f"""vals AS ({values}), placed AS (
  SELECT family, condition, v, row_number() OVER (PARTITION BY family, condition ORDER BY source_id) - 1 AS pos, count(*) OVER (PARTITION BY family, condition) AS n FROM vals
), draws AS (
  SELECT n, rep, CAST('0x' || substr(md5(concat_ws('|', '{seed}', CAST(rep AS VARCHAR), CAST(j AS VARCHAR))), 1, 15) AS BIGINT) % n AS pos
  FROM (SELECT n, rep, unnest(range(n)) AS j FROM (SELECT DISTINCT n FROM placed), (SELECT unnest(range({draws})) AS rep))
), boot AS (
  SELECT family, condition, rep, avg(v) AS m FROM draws JOIN placed USING (n, pos) GROUP BY ALL
), stats AS (
  SELECT family, condition, avg(v) AS mean, count(*) AS n, stddev_samp(v) / sqrt(count(*)) AS se, count(*) FILTER (v > 0) AS positive FROM vals GROUP BY ALL
)"""


def interval(m: str = "m") -> str:
    return f"{r(f'quantile_cont({m}, 0.025)')} AS ci_low, {r(f'quantile_cont({m}, 0.975)')} AS ci_high"


def simultaneous() -> str:
    """Behind ``boot``: the max-t intervals."""
    return f""", q AS (
  SELECT family, quantile_cont(t, 0.95) AS q FROM (SELECT family, rep, max(abs((m - mean) / se)) AS t FROM boot JOIN stats USING (family, condition) GROUP BY ALL) GROUP BY family
), ci AS (
  SELECT family, condition, {interval()} FROM boot GROUP BY ALL
) SELECT family, condition, {r('mean')} AS mean, {r('se')} AS se, {r('q')} AS q, {r('mean - q * se')} AS low, {r('mean + q * se')} AS high, ci_low, ci_high, positive
FROM stats JOIN q USING (family) JOIN ci USING (family, condition)"""
