"""The same results in plain SQL, for an independent engine on the same tables."""

from __future__ import annotations

#: A recording of F1 is one number here: subject and run, taken apart again at the end.
RUNS = 1_000_000
F1 = f"""f1 AS (SELECT CAST(CAST(label AS BIGINT) * {RUNS} + rn % runs AS BIGINT) AS subject, CAST(rn // runs AS BIGINT) AS channel, y, CAST(unnest(range(0, 64)) AS BIGINT) AS sample, CAST(unnest(embedding) AS DOUBLE) AS value
 FROM (SELECT label, embedding, CAST(vec_id % 4 = 0 AS INT) AS y, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS rn, CAST(ceil(count(*) OVER (PARTITION BY label) / 8) AS BIGINT) AS runs FROM embeddings))"""
F2 = """f2a AS (SELECT event_type AS subject, CAST(user_id % 8 AS BIGINT) AS channel, CAST(floor((epoch(ts) - epoch(TIMESTAMP '2024-01-01')) / 14400) AS BIGINT) AS bin, sum(value) AS v
  FROM events
  GROUP BY 1, 2, 3),
 f2e AS (SELECT min(bin) AS lo, max(bin) AS hi FROM f2a), f2v AS (SELECT subject, channel, bin - lo AS sample, v FROM f2a, f2e),
 f2 AS (SELECT g.subject, g.channel, g.sample, coalesce(v, 0.0::DOUBLE) AS value FROM (SELECT subject, channel, CAST(unnest(range(0, hi - lo + 1)) AS BIGINT) AS sample FROM (SELECT DISTINCT subject, channel FROM f2v), f2e) g LEFT JOIN f2v USING (subject, channel, sample))"""
F3 = """f3 AS (SELECT CAST(s_nationkey AS BIGINT) AS u, CAST(c_nationkey AS BIGINT) AS v, sum(l_extendedprice) / 1e6 AS w
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN supplier ON l_suppkey = s_suppkey
  JOIN customer ON o_custkey = c_custkey
 WHERE s_nationkey <> c_nationkey GROUP BY 1, 2)"""
F4 = """f4 AS (SELECT subject, channel, CAST(p // 4 AS BIGINT) AS op_window, CAST((p % 4) // 2 AS BIGINT) AS mode, CAST(p % 2 AS BIGINT) AS metric, y,
 CASE (vec_id * 64 + p) % 997 WHEN 0 THEN 'nan'::DOUBLE WHEN 1 THEN 'inf'::DOUBLE WHEN 2 THEN '-inf'::DOUBLE ELSE CASE WHEN subject = 9 AND p % 2 = 1 THEN 0.25 ELSE value END END AS value FROM (
 SELECT CAST(label AS BIGINT) AS subject, CAST(rn - 1 AS BIGINT) AS channel, vec_id, y, unnest(range(0, 64)) AS p, CAST(unnest(embedding) AS DOUBLE) AS value
 FROM (SELECT label, vec_id, embedding, CAST(vec_id % 4 = 0 AS INT) AS y, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings)))"""
F5 = """f5 AS (SELECT source AS subject, lang AS run, doc_id AS channel, CAST(toxic AS INT) AS y, CAST(n_chars / 1000.0 AS DOUBLE) AS score FROM documents JOIN labels USING (doc_id))"""
F6 = """f6 AS (SELECT p_brand AS subject, p_partkey AS row, CAST(p_partkey AS VARCHAR) AS name, CASE WHEN p_size <= 40 THEN 'good' ELSE 'bad' END AS status,
 CASE p_type WHEN 'SMALL' THEN 'soz' WHEN 'PROMO' THEN 'soz,resect' WHEN 'LARGE' THEN 'resect' END AS status_description FROM part)"""
WIN = "win AS (SELECT CAST(k AS BIGINT) AS win, CAST(k * 8 AS BIGINT) AS st FROM range(0, {n}) r(k))"


def _corr(src: str, n: int = 7) -> str:
    """Windowed correlations of src(subject, channel, sample, value) as fc(subject, win, i, j, w)."""
    return f"""{WIN.format(n=n)}, wx AS (SELECT subject, channel, sample, value, win FROM {src}, win WHERE sample >= st AND sample < st + 16),
 fc AS (SELECT a.subject, a.win, a.channel AS i, b.channel AS j, covar_samp(a.value, b.value) / (greatest(stddev_samp(a.value), 1e-10) * greatest(stddev_samp(b.value), 1e-10)) AS w
 FROM wx a JOIN wx b ON a.subject = b.subject AND a.win = b.win AND a.sample = b.sample AND a.channel < b.channel GROUP BY ALL)"""


BOTH = "fb AS (SELECT subject, win, i, j, w FROM fc UNION ALL SELECT subject, win, j, i, w FROM fc)"


def _hilbert(src: str, n: int, name: str = "an") -> str:
    """Analytic signal by the circulant kernel of even length n."""
    return f"""{name} AS (SELECT a.subject, a.channel, a.sample, max(a.value) AS re,
 sum(CASE WHEN abs(a.sample - b.sample) % 2 = 1 THEN b.value * 2.0 / {n} * (cos(pi() * (a.sample - b.sample) / {n}.0) / sin(pi() * (a.sample - b.sample) / {n}.0)) ELSE 0.0 END) AS im
 FROM {src} a JOIN {src} b ON a.subject = b.subject AND a.channel = b.channel GROUP BY a.subject, a.channel, a.sample)"""


_HFO = f"""WITH {F2}, md AS (SELECT subject, channel, median(value) AS m FROM f2 GROUP BY ALL), cx AS (SELECT subject, channel, sample, value - m AS value FROM f2 JOIN md USING (subject, channel)),
 {_hilbert('cx', 180)}, en AS (SELECT subject, channel, sample, sqrt(re * re + im * im) AS env FROM an),
 em AS (SELECT subject, channel, median(env) AS mid
  FROM en
  GROUP BY ALL),
ed AS (SELECT subject, channel, max(mid) + 1.5 * 1.4826 * (median(abs(env - mid)) + 1e-12) AS thr
  FROM en
  JOIN em USING (subject, channel)
  GROUP BY ALL),
 ab AS (SELECT subject, channel, sample, sample - row_number() OVER (PARTITION BY subject, channel ORDER BY sample) AS g FROM en JOIN ed USING (subject, channel) WHERE env > thr),
 isl AS (SELECT subject, channel, min(sample) AS s, max(sample) + 1 AS e FROM ab GROUP BY subject, channel, g),
 nw AS (SELECT *, CASE WHEN s - lag(e) OVER (PARTITION BY subject, channel ORDER BY s) <= 1 THEN 0 ELSE 1 END AS n FROM isl),
 gr AS (SELECT *, sum(n) OVER (PARTITION BY subject, channel ORDER BY s) AS g FROM nw),
 mg AS (SELECT subject, channel, min(s) AS start, max(e) AS stop FROM gr GROUP BY subject, channel, g),
 ev AS (SELECT mg.subject, mg.channel, start, stop, max(env) AS peak_amp, avg(env) AS mean_amp, avg(value * value) AS power, (stop - start) / 100.0::DOUBLE AS duration_s
 FROM mg
  JOIN en ON en.subject = mg.subject AND en.channel = mg.channel AND en.sample >= start AND en.sample < stop
  JOIN cx ON cx.subject = en.subject AND cx.channel = en.channel AND cx.sample = en.sample
 WHERE stop - start BETWEEN 2 AND 10 GROUP BY ALL)"""

_COH = f"""{F1}, {_hilbert('f1', 64)}, {WIN.format(n=7)}, wz AS (SELECT subject, channel, sample, re, im, win FROM an, win WHERE sample >= st AND sample < st + 16),
 c0 AS (SELECT a.subject, a.win, a.channel AS i, b.channel AS j, avg(a.re * b.re + a.im * b.im) AS re, avg(a.im * b.re - a.re * b.im) AS im, greatest(avg(a.re * a.re + a.im * a.im), 1e-12) AS pa, greatest(avg(b.re * b.re + b.im * b.im), 1e-12) AS pb
 FROM wz a JOIN wz b ON a.subject = b.subject AND a.win = b.win AND a.sample = b.sample AND a.channel < b.channel GROUP BY ALL),
 fc AS (SELECT subject, win, i, j, abs(im / sqrt(pa * pb)) / sqrt(greatest(1 - pow(re / sqrt(pa * pb), 2), 1e-12)) AS w FROM c0)"""

_ENVFC = f"{F1}, {_hilbert('f1', 64)}, en AS (SELECT subject, channel, sample, sqrt(re * re + im * im) AS value FROM an), {_corr('en')}"


ND = "nd AS (SELECT CAST(n_nationkey AS BIGINT) AS a FROM nation)"


def _sparse(q: float) -> str:
    return f"{F3}, sp AS (SELECT u, v, w FROM f3 WHERE w > 0 AND w >= (SELECT quantile_cont(w, {q}) FROM f3 WHERE w > 0))"


def _minplus(edges: str, eps: str, levels: int = 5) -> str:
    """Shortest distances by repeated min-plus squaring: dN(a, b, d), zero on the diagonal."""
    out = f"""{ND},
d0 AS MATERIALIZED (SELECT a, b, min(d) AS d
  FROM (SELECT u AS a, v AS b, 1 / (w + {eps}) AS d
  FROM {edges}
  UNION ALL
  SELECT a, a, 0.0
  FROM nd)
  GROUP BY a, b)"""
    for k in range(levels):
        out += f", d{k + 1} AS MATERIALIZED (SELECT x.a, y.b, min(x.d + y.d) AS d FROM d{k} x JOIN d{k} y ON x.b = y.a GROUP BY x.a, y.b)"
    return out


def _closeness(a: str, b: str) -> str:
    return f"""WITH {_sparse(0.9)}, {_minplus('sp', '1e-12')}, c AS (SELECT {a} AS channel, count(*) - 1 AS r, sum(d) AS t FROM d5 GROUP BY 1)
SELECT channel, round(CASE WHEN t > 0 THEN r / t * r / ((SELECT count(*) FROM nd) - 1) ELSE 0 END, 6) AS value FROM c"""


def _pagerank(rounds: int = 60) -> str:
    return f"""WITH RECURSIVE {_sparse(0.9)}, {ND}, n AS (SELECT count(*) AS n FROM nd), ot AS (SELECT u, sum(w) AS t FROM sp GROUP BY u),
 m AS (SELECT sp.u, v, w / t AS p FROM sp JOIN ot ON ot.u = sp.u UNION ALL SELECT x.a, y.a, 1.0 / n FROM nd x, nd y, n WHERE x.a NOT IN (SELECT u FROM sp)),
 it AS (SELECT 0 AS k, a, 1.0::DOUBLE / n AS x
  FROM nd, n
  UNION ALL SELECT k + 1, a, x
  FROM (SELECT i.k, m.v AS a, 0.85 * sum(i.x * m.p) + 0.15 / max(n) AS x
  FROM it i
  JOIN m ON m.u = i.a, n
  WHERE i.k < {rounds}
  GROUP BY i.k, m.v))
SELECT nd.a AS channel, round(coalesce(x, 0.15 / n), 4) AS value FROM nd JOIN n ON true LEFT JOIN it ON it.a = nd.a AND k = {rounds}"""


def _leading(matrix: str, norm: str, rounds: int = 300) -> str:
    """Leading eigenvector of the non-negative matrix mm(a, b, m) by powers, scaled by its trace, as it(k, a, x)."""
    return f"""WITH RECURSIVE {_sparse(0.9)}, {ND}, {matrix}, tr AS (SELECT sum(m) AS t FROM mm WHERE a = b),
 it AS (SELECT 0 AS k, a, 1.0::DOUBLE AS x
  FROM (SELECT DISTINCT a
  FROM mm)
  UNION ALL SELECT k + 1, a, x
  FROM (SELECT i.k, mm.a, sum(mm.m / t * i.x) AS x
  FROM it i
  JOIN mm ON mm.b = i.a, tr
  WHERE i.k < {rounds}
  GROUP BY i.k, mm.a)),
 fin AS (SELECT a, x FROM it WHERE k = {rounds}), nm AS (SELECT {norm} AS s FROM fin)
SELECT nd.a AS channel, round(coalesce(x / s, 0), 4) AS value FROM nd JOIN nm ON true LEFT JOIN fin ON fin.a = nd.a"""


_HUBS = _leading("mm AS (SELECT x.u AS a, y.u AS b, sum(x.w * y.w) AS m FROM sp x JOIN sp y ON x.v = y.v GROUP BY ALL)", "sum(x)")
_AUTHORITIES = _leading("mm AS (SELECT x.v AS a, y.v AS b, sum(x.w * y.w) AS m FROM sp x JOIN sp y ON x.u = y.u GROUP BY ALL)", "sum(x)")
_EIGEN = _leading("""un AS (SELECT u, v, sum(w) AS w
  FROM (SELECT u, v, w
  FROM sp
  UNION ALL
  SELECT v, u, w
  FROM sp)
  GROUP BY ALL),
mm AS (SELECT x.u AS a, y.v AS b, sum(x.w * y.w) AS m
  FROM un x
  JOIN un y ON x.v = y.u
  GROUP BY ALL)""", "sqrt(sum(x * x))")


def _local_efficiency() -> str:
    out = f"""WITH {_sparse(0.9)}, {ND},
nb AS (SELECT u AS c, v AS a
  FROM sp UNION
  SELECT v, u
  FROM sp),
m AS (SELECT c, count(*) AS m
  FROM nb
  GROUP BY c),
e0 AS MATERIALIZED (SELECT x.c, s.u AS a, s.v AS b, 1 / (s.w + 1e-12) AS d
  FROM nb x
  JOIN sp s ON s.u = x.a
  JOIN nb y ON y.c = x.c AND y.a = s.v
  UNION ALL
  SELECT c, a, a, 0.0
  FROM nb)"""
    for k in range(5):
        out += f""", e{k + 1} AS MATERIALIZED (SELECT x.c, x.a, y.b, min(x.d + y.d) AS d
  FROM e{k} x
  JOIN e{k} y ON x.c = y.c AND x.b = y.a
  GROUP BY x.c, x.a, y.b)"""
    return out + """ SELECT nd.a AS channel, round(coalesce((SELECT sum(1 / d)
  FROM e5
  WHERE e5.c = nd.a AND e5.a <> e5.b) / nullif(m * (m - 1), 0), 0), 6) AS value
  FROM nd
  LEFT JOIN m ON m.c = nd.a"""


#: Shortest paths of different sums of weights are unique, so a path through a node is one whose parts add up.
_BETWEENNESS = f"""WITH {_sparse(0.9)}, {_minplus('sp', '1e-12')}, t AS (SELECT x.b AS a, count(*) AS n
  FROM d5 x
  JOIN d5 y ON x.b = y.a
  JOIN d5 z ON z.a = x.a AND z.b = y.b
  WHERE x.a <> x.b AND y.a <> y.b AND x.a <> y.b AND abs(x.d + y.d - z.d) <= 1e-9 * z.d
  GROUP BY x.b)
SELECT nd.a AS channel, round(coalesce(n, 0) / (((SELECT count(*) FROM nd) - 1) * ((SELECT count(*) FROM nd) - 2)), 6) AS value FROM nd LEFT JOIN t ON t.a = nd.a"""

_CLUSTERING = f"""WITH {_sparse(0.9)}, {ND}, c AS (SELECT u, v, cbrt(w / (SELECT max(w)
  FROM sp)) AS c
  FROM sp),
s AS (SELECT u, v, sum(c) AS c
  FROM (SELECT u, v, c
  FROM c
  UNION ALL SELECT v, u, c
  FROM c)
  GROUP BY u, v),
 t AS (SELECT x.u AS a, sum(x.c * y.c * z.c) / 2 AS t FROM s x JOIN s y ON x.v = y.u JOIN s z ON y.v = z.u AND z.v = x.u GROUP BY x.u),
 g AS (SELECT a, (SELECT count(*) FROM sp WHERE u = a OR v = a) AS k, (SELECT count(*) FROM sp x JOIN sp y ON x.u = y.v AND x.v = y.u WHERE x.u = a) AS m FROM nd)
SELECT g.a AS channel, round(CASE WHEN coalesce(t, 0) > 0 AND k * (k - 1) - 2 * m > 0 THEN t / (k * (k - 1) - 2 * m) ELSE 0 END, 6) AS value FROM g LEFT JOIN t ON t.a = g.a"""


def _adjugate(a: str, b: str, c: str, d: str, e: str, f: str) -> dict[str, str]:
    """Of the symmetric matrix [[a, b, c], [b, d, e], [c, e, f]]: its entries in the same order, and the determinant."""
    adj = (f"({d} * {f} - {e} * {e})", f"({c} * {e} - {b} * {f})", f"({b} * {e} - {c} * {d})", f"({a} * {f} - {c} * {c})", f"({b} * {c} - {a} * {e})", f"({a} * {d} - {b} * {b})")
    return {"adj": adj, "det": f"({a} * {adj[0]} + {b} * {adj[1]} + {c} * {adj[2]})"}


def _trace(x: tuple[str, ...], y: tuple[str, ...]) -> str:
    return f"({x[0]} * {y[0]} + {x[3]} * {y[3]} + {x[5]} * {y[5]} + 2 * ({x[1]} * {y[1]} + {x[2]} * {y[2]} + {x[4]} * {y[4]}))"


def _evolution() -> str:
    """Operators over three windows have three singular values at most: roots of the cubic of (XX')^-1 YY'."""
    old, new = ("g00", "g01", "g02", "g11", "g12", "g22"), ("g11", "g12", "g13", "g22", "g23", "g33")
    x, y = _adjugate(*old), _adjugate(*new)
    pick = ", ".join(f"max(g) FILTER (p = t + {i} AND q = t + {j}) AS g{i}{j}" for i in range(4) for j in range(i, 4))
    return f"""WITH {F1}, {_corr('f1', 6)}, gm AS (SELECT x.subject, x.win AS p, y.win AS q, sum(x.w * y.w) AS g FROM fc x JOIN fc y ON x.subject = y.subject AND x.i = y.i AND x.j = y.j GROUP BY ALL),
 gt AS (SELECT subject, t, {pick} FROM gm, (SELECT CAST(unnest([0, 1]) AS BIGINT) AS t) GROUP BY subject, t),
 cu AS (SELECT subject, t, {_trace(x['adj'], new)} / {x['det']} AS c2, {y['det']} / {x['det']} AS c0, {_trace(y['adj'], old)} / {x['det']} AS c1 FROM gt),
 pq AS (SELECT *, c1 - c2 * c2 / 3 AS p, -2 * c2 * c2 * c2 / 27 + c1 * c2 / 3 - c0 AS q FROM cu),
 th AS (SELECT *, acos(least(greatest(3 * q / (2 * p) * sqrt(-3 / p), -1), 1)) / 3 AS h FROM pq)
SELECT subject, t AS op_window, m AS mode, round(sqrt(c2 / 3 + 2 * sqrt(-p / 3) * cos(h - 2 * pi() * m / 3)), 3) AS sigma, round(c2, 3) AS energy FROM th, (SELECT CAST(unnest([0, 1]) AS BIGINT) AS m)"""


_RANK = f"""{F5},
rk AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY score DESC, channel DESC) AS r, sum(y) OVER (PARTITION BY subject) AS pos, count(*) OVER (PARTITION BY subject) AS n
  FROM f5)"""
_CONF = f"""{F5},
cf AS (SELECT subject, count(*) FILTER (score >= 2.5 AND y = 1) AS tp, count(*) FILTER (score >= 2.5 AND y = 0) AS fp, count(*) FILTER (score < 2.5 AND y = 1) AS fn, count(*) FILTER (score < 2.5 AND y = 0) AS tn
  FROM f5
  GROUP BY subject),
cm AS (SELECT subject, tp, fp, fn, tn, coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0), 0) AS acc, coalesce(tp / nullif(tp + fn, 0), 0) AS sen, coalesce(tn / nullif(tn + fp, 0), 0) AS spec
  FROM cf)"""
_BAL = f"""{F5},
bl AS (SELECT *, row_number() OVER (PARTITION BY subject, y ORDER BY md5(CAST(channel AS VARCHAR) || '|42'), channel) AS r, sum(y) OVER (PARTITION BY subject) AS p, sum(1 - y) OVER (PARTITION BY subject) AS n
  FROM f5)"""
_GOOD = f"""{F6},
gd AS (SELECT subject, row_number() OVER (PARTITION BY subject ORDER BY row) - 1 AS channel, name, CAST(coalesce(contains(status_description, 'soz'), false) AS INT) AS soz, CAST(coalesce(contains(status_description, 'resect'), false) AS INT) AS resected
  FROM f6
  WHERE status = 'good')"""
_EDGES = "SELECT subject, win AS \"window\", i, j, round(w, 6) AS w FROM fc"
_X1 = "round(value, 6) AS value"
_MM = f"""{F4},
mn AS (SELECT subject, metric, min(value) FILTER (isfinite(value)) AS lo, max(value) FILTER (isfinite(value)) AS hi
  FROM f4
  GROUP BY ALL),
mm AS (SELECT subject, channel, op_window, mode, metric, y, CASE WHEN lo IS NULL THEN 0 WHEN hi = lo THEN 0.5 WHEN isnan(value) THEN NULL ELSE least(greatest((value - lo) / (hi - lo), 0), 1) END AS value
  FROM f4
  JOIN mn USING (subject, metric))"""
_BINS = "bn AS (SELECT op_window, CAST(ntile(3) OVER (ORDER BY op_window) - 1 AS BIGINT) AS bin FROM (SELECT DISTINCT op_window FROM f4))"

#: Runs' success rates where every third graph of even subjects fails.
_ODD_RATES = f"""WITH {F1}, {_corr('f1')}, graphs AS (SELECT DISTINCT subject, win FROM fc)
SELECT subject, avg(CASE WHEN win % 3 = 1 AND subject // {RUNS} % 2 = 0 THEN 0.0::DOUBLE ELSE 1.0 END) AS success_rate FROM graphs GROUP BY subject"""

ORACLE: dict[str, str] = {
    "fc_sliding_edges": f"WITH {F1}, {_corr('f1')} {_EDGES}",
    "fc_sliding_edges_kernel": f"WITH {F1}, {_corr('f1')} {_EDGES}",
    "fc_sliding_edges_exclusive": f"WITH {F1}, {_corr('f1', 6)} {_EDGES}",
    "fc_edge_vectors": f"WITH {F1}, {_corr('f1')} SELECT subject, win AS \"window\", count(*) AS n_edges, round(sum(w), 6) AS total FROM fc GROUP BY ALL",
    "fc_node_strength": f"""WITH {F1}, {_corr('f1')}, {BOTH}
  SELECT subject, win AS "window", i AS channel, round(sum(abs(w)), 6) AS strength
  FROM fb
  GROUP BY subject, win, i""",
    "fc_degree_std": f"""WITH {F1}, {_corr('f1')}, {BOTH},
z AS (SELECT subject, win, i, abs(w) AS w
  FROM fb
  UNION ALL
  SELECT DISTINCT subject, win, i, 0.0
  FROM fb)
  SELECT subject, win AS "window", i AS channel, round(stddev_pop(w), 6) AS degree_std
  FROM z
  GROUP BY subject, win, i""",
    "average_reference": f"WITH {F1} SELECT subject, channel, sample, round(value - avg(value) OVER (PARTITION BY subject, sample), 6) AS value FROM f1",
    "percentile_scale": f"""WITH {F1},
q AS (SELECT subject, quantile_cont(value, 0.95) AS t
  FROM f1
  GROUP BY subject)
  SELECT subject, channel, sample, round(value / t, 6) AS value
  FROM f1
  JOIN q USING (subject)""",
    "channel_zscore": f"""WITH {F2}
  SELECT subject, channel, sample, round((value - avg(value) OVER w) / (stddev_pop(value) OVER w + 1e-12), 6) AS value
  FROM f2
  WINDOW w AS (PARTITION BY subject, channel)""",
    "safe_standardise": f"""WITH {F2},
z AS (SELECT subject, channel, sample, value - avg(value) OVER (PARTITION BY subject, channel) AS c
  FROM f2)
  SELECT subject, channel, sample, round(coalesce(c / nullif(sqrt(avg(c * c) OVER (PARTITION BY subject, channel)), 0), 0), 6) AS value
  FROM z""",
    "robust_zscore": f"""WITH {F1},
m AS (SELECT subject, channel, median(value) AS m
  FROM f1
  GROUP BY ALL),
a AS (SELECT subject, channel, median(abs(value - m)) AS mad
  FROM f1
  JOIN m USING (subject, channel)
  GROUP BY ALL)
  SELECT subject, channel, sample, round((value - m) / (1.4826 * mad + 1e-12), 6) AS value
  FROM f1
  JOIN m USING (subject, channel)
  JOIN a USING (subject, channel)""",
    "windows_seconds": f"""WITH {F2},
n AS (SELECT subject, max(sample) + 1 AS n
  FROM f2
  GROUP BY subject)
  SELECT subject, CAST(k AS BIGINT) AS "window", CAST(k * 6 AS BIGINT) AS start, CAST(k * 6 + 25 AS BIGINT) AS stop
  FROM n, range(0, 1000) r(k)
  WHERE k * 6 + 25 <= n""",
    "segments_and_targets": f"""WITH {F2},
n AS (SELECT subject, (max(sample) + 1) // 20 AS n
  FROM f2
  GROUP BY subject)
  SELECT subject, CAST(t AS BIGINT) AS target, CAST(t - 4 AS BIGINT) AS first, CAST(t - 1 AS BIGINT) AS last, CAST(t >= 6 AS INT) AS y
  FROM n, range(4, 1000) r(t)
  WHERE t < n""",
    "delay_embedding": f"""WITH {F2},
e AS (SELECT subject, channel, sample, value AS e0, lead(value, 2) OVER w AS e1, lead(value, 4) OVER w AS e2
  FROM f2
  WINDOW w AS (PARTITION BY subject, channel ORDER BY sample))
  SELECT subject, channel, sample, round(e0, 6) AS e0, round(e1, 6) AS e1, round(e2, 6) AS e2
  FROM e
  WHERE e2 IS NOT NULL""",
    "linspace_decimate": f"""WITH {F1},
p AS (SELECT CAST(k AS BIGINT) AS point, CAST(floor(k * 63 / 24.0) AS BIGINT) AS sample
  FROM range(0, 25) r(k))
  SELECT subject, channel, point, sample, {_X1}
  FROM f1
  JOIN p USING (sample)""",
    "band_power": f"WITH {F1} SELECT subject, channel, round(avg(value * value), 6) AS power FROM f1 GROUP BY ALL",
    "onset_crop": f"WITH {F1} SELECT subject, channel, sample, {_X1} FROM f1 WHERE sample / 16.0 BETWEEN 1.0 AND 2.5",
    "hilbert_envelope": f"WITH {F1}, {_hilbert('f1', 64)} SELECT subject, channel, sample, round(sqrt(re * re + im * im), 6) AS env FROM an",
    "hfo_events": f"""{_HFO}
  SELECT subject, channel, start, stop, round(peak_amp, 6) AS peak_amp, round(mean_amp, 6) AS mean_amp, round(power, 9) AS power, round(duration_s, 6) AS duration_s
  FROM ev""",
    "hfo_rate": f"""{_HFO}
  SELECT m.subject, m.channel, count(start) AS n_events, round(count(start) / (1.8 / 60), 6) AS rate
  FROM md m
  LEFT JOIN ev ON ev.subject = m.subject AND ev.channel = m.channel
  GROUP BY m.subject, m.channel""",
    "hfo_features": f"""{_HFO},
bp AS (SELECT subject, channel, avg(value * value) AS b
  FROM f2
  GROUP BY ALL),
hf AS (SELECT m.subject, m.channel, count(start) AS n_events, count(start) / (1.8 / 60) AS rate, max(b) AS band_power, coalesce(avg(peak_amp), 0) AS peak_mean, coalesce(median(peak_amp), 0) AS peak_median, coalesce(avg(power), 0) AS power_mean, coalesce(avg(duration_s), 0) AS duration_mean
  FROM bp m
  LEFT JOIN ev ON ev.subject = m.subject AND ev.channel = m.channel
  GROUP BY m.subject, m.channel)
  SELECT subject, channel, n_events, """
    + ", ".join(f"""round({c}, 6) AS {c}, round(CASE WHEN max({c}) OVER w - min({c}) OVER w < 1e-12 THEN 0 ELSE ({c} - min({c}) OVER w) / (max({c}) OVER w - min({c}) OVER w + 1e-12) END, 6) AS {c}_norm""" for c in ("rate", "band_power", "peak_mean", "peak_median", "power_mean", "duration_mean"))
    + " FROM hf WINDOW w AS (PARTITION BY subject)",
    "envelope_corr_layers": f"""WITH {_ENVFC},
q AS (SELECT subject, win, quantile_cont(abs(w), 0.8) AS t
  FROM fc
  WHERE w <> 0
  GROUP BY ALL)
  SELECT subject, win AS "window", i, j, round(abs(w), 6) AS w
  FROM fc
  JOIN q USING (subject, win)
  WHERE abs(w) >= t""",
    "lagged_coherence": f"WITH {_COH} {_EDGES}",
    "preictal_mapped": f"""WITH {_COH},
b AS (SELECT subject, i, j, avg(w) AS m, stddev_pop(w) AS s
  FROM fc
  WHERE (win * 8 + 8) / 16.0 < 2.0
  GROUP BY ALL)
  SELECT subject, win AS "window", i, j, round(1 - exp(-least(greatest((w - m) / (s + 1e-12), 0), 50)), 4) AS w
  FROM fc
  JOIN b USING (subject, i, j)""",
    "quantile_sparsify": f"WITH {_sparse(0.9)} SELECT u, v, round(w, 6) AS w FROM sp",
    "directed_strength": f"""WITH {_sparse(0.5)},
a AS (SELECT v AS channel, w AS i, 0.0 AS o
  FROM sp
  UNION ALL
  SELECT u, 0.0, w
  FROM sp
  UNION ALL
  SELECT n_nationkey, 0.0, 0.0
  FROM nation)
  SELECT CAST(channel AS BIGINT) AS channel, round(sum(i), 6) AS in_strength, round(sum(o), 6) AS out_strength
  FROM a
  GROUP BY channel""",
    "supra_adjacency": f"""WITH {F1}, {_corr('f1')}, {BOTH},
nd AS (SELECT DISTINCT subject, win, i
  FROM fb
  WHERE w > 0)
  SELECT subject, win AS layer_a, i AS node_a, win AS layer_b, j AS node_b, round(w, 6) AS w
  FROM fc
  WHERE w > 0
  UNION ALL
  SELECT a.subject, a.win, a.i, b.win, b.i, 1.0
  FROM nd a
  JOIN nd b ON a.subject = b.subject AND a.i = b.i AND b.win = a.win + 1""",
    "in_closeness": _closeness("b", "a"),
    "out_closeness": _closeness("a", "b"),
    "pagerank": _pagerank(),
    "clustering": _CLUSTERING,
    "local_efficiency": _local_efficiency(),
    "betweenness": _BETWEENNESS,
    "hubs": _HUBS,
    "authorities": _AUTHORITIES,
    "eigenvector_centrality": _EIGEN,
    "evolution_operator_svd": _evolution(),
    "mode_statistics": f"WITH {F1}, {_corr('f1', 6)} SELECT subject, count(DISTINCT (i, j)) * 4 AS n, 4.0::DOUBLE AS squares FROM fc GROUP BY subject",
    "evolution_success_rate": f"WITH {F1} SELECT DISTINCT subject, 1.0::DOUBLE AS success_rate FROM f1",
    "mean_success_rate": """SELECT CAST(label AS BIGINT) AS subject, CAST(ceil(count(*) / 8) AS BIGINT) AS n_runs, 1.0::DOUBLE AS mean_success_rate
  FROM embeddings
  GROUP BY label""",
    "nodal_efficiency": f"""WITH {_sparse(0.9)}, un AS (SELECT least(u, v) AS i, greatest(u, v) AS j, sum(w) AS w
  FROM sp
  GROUP BY ALL),
ub AS (SELECT i AS u, j AS v, w
  FROM un
  UNION ALL SELECT j, i, w
  FROM un), {_minplus('ub', '1e-8')}
SELECT nd.a AS channel, round(coalesce(avg(1 / d) FILTER (d > 0), 0), 6) AS value FROM nd LEFT JOIN d5 ON d5.a = nd.a GROUP BY nd.a""",
    "odd_success_rate": f"SELECT subject, round(success_rate, 6) AS success_rate FROM ({_ODD_RATES})",
    "minmax_metrics": f"WITH {_MM} SELECT subject, channel, op_window, mode, metric, {_X1} FROM mm",
    "time_bins": f"""WITH {_MM}, {_BINS}
  SELECT subject, channel, mode, metric, bin, round(coalesce(avg(value), 0), 6) AS value
  FROM mm
  JOIN bn USING (op_window)
  GROUP BY ALL""",
    "feature_vectors": f"""WITH {_MM}, {_BINS}
  SELECT subject, channel, y, CAST((bin * 2 + mode) * 2 + metric AS BIGINT) AS k, round(coalesce(avg(value), 0), 6) AS value
  FROM mm
  JOIN bn USING (op_window)
  GROUP BY subject, channel, y, bin, mode, metric""",
    "normalize_scores": f"""WITH {F5}
  SELECT subject, run, channel, y, round(CASE WHEN max(score) OVER w - min(score) OVER w < 1e-12 THEN 0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w + 1e-12) END, 6) AS score
  FROM f5
  WINDOW w AS (PARTITION BY subject)""",
    "normalize_scores_odd": f"""WITH {F5}, odd AS (
  SELECT subject, run, channel, y, CASE WHEN channel % 7 = 0 OR subject = 'src3' THEN NULL WHEN channel % 7 = 1 AND subject = 'src1' THEN 'inf'::DOUBLE WHEN channel % 7 = 1 AND subject = 'src2' THEN '-inf'::DOUBLE ELSE score END AS v
  FROM f5
), r AS (SELECT *, min(v) OVER w AS lo, max(v) OVER w AS hi FROM odd WINDOW w AS (PARTITION BY subject))
SELECT subject, run, channel, y, round(CASE WHEN lo IS NULL OR isinf(lo) OR isinf(hi) OR hi - lo < 1e-12 THEN 0 ELSE (v - lo) / (hi - lo + 1e-12) END, 6) AS score FROM r""",
    "band_power_odd": f"""WITH {F1}
  SELECT subject, channel, round(avg(value * value) FILTER (channel <> 2 AND (channel <> 1 OR sample % 5 <> 0)), 6) AS power
  FROM f1
  GROUP BY ALL""",
    "confusion_metrics": f"WITH {_CONF} SELECT subject, tp, fp, fn, tn, round(acc, 6) AS acc, round(sen, 6) AS sen, round(spec, 6) AS spec FROM cm",
    "roc_auc": f"""WITH {F5},
r AS (SELECT subject, y, rank() OVER (PARTITION BY subject ORDER BY score) + (count(*) OVER (PARTITION BY subject, score) - 1) / 2 AS ar
  FROM f5)
  SELECT subject, round(coalesce((sum(ar * y) - sum(y) * (sum(y) + 1) / 2) / nullif(sum(y) * sum(1 - y), 0), 0.5), 6) AS auc
  FROM r
  GROUP BY subject""",
    "average_precision": f"""WITH {F5},
g AS (SELECT subject, score, sum(y) AS p, count(*) AS n
  FROM f5
  GROUP BY ALL),
c AS (SELECT *, sum(p) OVER w AS cp, sum(n) OVER w AS cn, sum(p) OVER (PARTITION BY subject) AS tp
  FROM g
  WINDOW w AS (PARTITION BY subject ORDER BY score DESC))
  SELECT subject, round(sum(p / tp * cp / cn), 6) AS ap
  FROM c
  WHERE tp > 0
  GROUP BY subject""",
    "topk_metrics": f"""WITH {_RANK}, c AS (SELECT subject, count(*) FILTER (r <= greatest(pos, 1) AND y = 1) AS tp, count(*) FILTER (r <= greatest(pos, 1) AND y = 0) AS fp, count(*) FILTER (r > greatest(pos, 1) AND y = 1) AS fn, count(*) FILTER (r > greatest(pos, 1) AND y = 0) AS tn
  FROM rk
  GROUP BY subject)
SELECT subject, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(CASE WHEN tp + fn = 0 THEN tn / nullif(tn + fp, 0) WHEN tn + fp = 0 THEN tp / (tp + fn) ELSE (tp / (tp + fn) + tn / (tn + fp)) / 2 END, 6) AS balanced_accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c""",
    "hit_recall_at_k": f"""WITH {_RANK},
k AS (SELECT DISTINCT subject, CAST(least(unnest([1, 3, 5, greatest(pos, 1)]), n) AS BIGINT) AS k
  FROM rk)
  SELECT subject, k, CAST(sum(y) FILTER (r <= k) > 0 AS BIGINT) AS hit, round(coalesce(sum(y) FILTER (r <= k) / nullif(max(pos), 0), 0), 6) AS recall
  FROM rk
  JOIN k USING (subject)
  GROUP BY subject, k""",
    "summary_metrics": f"""WITH {_CONF},
u AS (SELECT 'acc' AS metric, acc AS v
  FROM cm
  UNION ALL
  SELECT 'sen', sen
  FROM cm
  UNION ALL
  SELECT 'spec', spec
  FROM cm)
  SELECT metric, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(min(v), 6) AS min, round(max(v), 6) AS max, count(v) AS n
  FROM u
  GROUP BY metric""",
    "subject_mean_score": f"WITH {F5} SELECT subject, channel % 5 AS channel, round(avg(score), 6) AS score, max(y) AS y FROM f5 GROUP BY 1, 2",
    "balanced_sample": f"WITH {_BAL} SELECT subject, run, channel, y, round(score, 6) AS score FROM bl WHERE least(p, n) = 0 OR r <= least(p, n)",
    "balanced_negatives": f"""WITH {_BAL}
  SELECT subject, run, channel, y, round(score, 6) AS score
  FROM bl
  WHERE least(p, n) = 0 OR r <= least(p, n) OR y = 1""",
    "oversample": f"""WITH {_BAL},
t AS (SELECT *, CASE WHEN y = 1 THEN p ELSE n END AS own
  FROM bl)
  SELECT subject, channel, y, CAST(c AS BIGINT) AS copy
  FROM t, range(1, 10000) q(c)
  WHERE c <= greatest(p, n) // own + CASE WHEN r <= greatest(p, n) % own THEN 1 ELSE 0 END""",
    "loso_split": f"""WITH {F5},
s AS (SELECT DISTINCT subject
  FROM f5)
  SELECT a.subject AS fold, b.subject
  FROM s a
  JOIN s b ON a.subject <> b.subject""",
    "label_consistency": f"""WITH {F5},
l AS (SELECT subject, run, list_sort(list((channel % 5, y))) AS l
  FROM f5
  GROUP BY ALL)
  SELECT subject, count(*) AS n_runs, count(DISTINCT l) > 1 AS inconsistent
  FROM l
  GROUP BY subject""",
    "channel_filter": f"WITH {_GOOD} SELECT subject, channel, name FROM gd",
    "label_assignment": f"WITH {_GOOD} SELECT subject, channel, name, soz, resected FROM gd",
    "soz_first_order": f"WITH {_GOOD} SELECT subject, name, row_number() OVER (PARTITION BY subject ORDER BY soz DESC, channel) AS place FROM gd",
    "valid_subjects": f"""WITH {F5},
m AS (SELECT subject, min(run) AS run
  FROM f5
  GROUP BY subject),
v AS (SELECT DISTINCT subject
  FROM f5
  JOIN m USING (subject, run)
  WHERE y = 1)
  SELECT subject, run, channel, y, round(score, 6) AS score
  FROM f5 SEMI
  JOIN v USING (subject)""",
    "union_missing_columns": f"""WITH {F5}
  SELECT subject, channel, round(score, 6) AS score, NULL::VARCHAR AS run
  FROM f5
  WHERE run = 'en'
  UNION ALL
  SELECT subject, channel, NULL, run
  FROM f5
  WHERE run <> 'en'""",
    "ccm_scores": f"""WITH {F2}, m AS (SELECT subject, channel, sample AS t, value AS e0, lead(value) OVER (PARTITION BY subject, channel ORDER BY sample) AS e1
  FROM f2),
e AS (SELECT *
  FROM m
  WHERE e1 IS NOT NULL),
 d AS (SELECT a.subject, a.channel, a.t, b.t AS q, sqrt((a.e0 - b.e0) * (a.e0 - b.e0) + (a.e1 - b.e1) * (a.e1 - b.e1)) AS d
  FROM e a
  JOIN e b ON a.subject = b.subject AND a.channel = b.channel AND a.t <> b.t),
 k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject, channel, t ORDER BY d, q) AS r FROM d) WHERE r <= 3),
 x AS (SELECT *, exp(-d / (min(d) OVER (PARTITION BY subject, channel, t) + 1e-12)) AS w FROM k), z AS (SELECT *, w / sum(w) OVER (PARTITION BY subject, channel, t) AS p FROM x),
 g AS (SELECT z.subject, z.channel AS i, y.channel AS j, z.t, sum(p * y.e1) AS guess FROM z JOIN e y ON y.subject = z.subject AND y.t = z.q AND y.channel <> z.channel GROUP BY ALL)
SELECT g.subject, i, j, round(CASE WHEN stddev_pop(e1) < 1e-12 OR stddev_pop(guess) < 1e-12 THEN 0 ELSE greatest(0, corr(e1, guess)) END, 5) AS w FROM g JOIN e ON e.subject = g.subject AND e.channel = g.j AND e.t = g.t GROUP BY g.subject, i, j""",
}
_PATH = """'/data/' || CASE p_size % 3 WHEN 0 THEN 'HUP' || p_partkey || '_Run_' WHEN 1 THEN 'sub-' || p_partkey || '_task-x_run-' ELSE 'rec' || p_partkey || '_run' END || p_size || '.edf'"""
_TOPK = ORACLE["topk_metrics"]
ORACLE |= {
    "signal_round_trip": f"WITH {F1} SELECT subject, channel, count(*) AS n, round(sum(value), 6) AS total, max(y) AS y FROM f1 GROUP BY subject, channel",
    "csv_round_trip": f"WITH {F5} SELECT subject, run, channel, y, round(score, 6) AS score FROM f5",
    "log_round_trip": ORACLE["confusion_metrics"],
    "label_lists": f"""WITH {_GOOD}
  SELECT subject, coalesce(string_agg(CAST(channel AS VARCHAR), ' ' ORDER BY channel) FILTER (soz = 1), '') AS soz_channels, coalesce(string_agg(name, ' ' ORDER BY channel) FILTER (soz = 1), '') AS soz_names, coalesce(string_agg(CAST(channel AS VARCHAR), ' ' ORDER BY channel) FILTER (resected = 1), '') AS resected_channels, coalesce(string_agg(name, ' ' ORDER BY channel) FILTER (resected = 1), '') AS resected_names
  FROM gd
  GROUP BY subject""",
    "wide_features": f"WITH {_MM} SELECT subject, channel, " + ", ".join(f"round(coalesce(avg(value) FILTER (op_window < 6 AND mode = {k // 2} AND metric = {k % 2}), 0), 6) AS f_{k}" for k in range(4)) + " FROM mm GROUP BY subject, channel",
    "path_parts": f"""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'HUP' || p_partkey WHEN 1 THEN 'sub-' || p_partkey ELSE 'rec' || p_partkey END AS subject, CASE p_size % 3 WHEN 0 THEN 'Run-' WHEN 1 THEN 'run-' ELSE 'run' END || p_size AS run, CASE WHEN p_size % 3 = 2 THEN CAST(p_size AS INT) END AS number
  FROM (SELECT *, {_PATH} AS path
  FROM part)""",
    "acquisitions": "SELECT CASE WHEN p_size % 2 = 0 THEN 'seeg' ELSE 'ecog' END AS acquisition, count(*) AS n FROM part GROUP BY 1",
    "fast_enough": """WITH r AS (SELECT p_brand AS subject, CAST(p_partkey AS BIGINT) AS run, CASE WHEN p_size % 2 = 0 THEN 512.0::DOUBLE ELSE 256.0::DOUBLE END AS sfreq
  FROM part),
f AS (SELECT subject, arg_min(sfreq, run) AS first
  FROM r
  GROUP BY subject)
  SELECT subject, run, sfreq
  FROM r
  JOIN f USING (subject)
  WHERE first >= 500""",
    "attached_labels": f"""WITH {F5},
x AS (SELECT DISTINCT subject, channel % 7 AS channel
  FROM f5),
l AS (SELECT DISTINCT subject, channel % 9 AS channel
  FROM f5
  WHERE y = 1)
  SELECT x.subject, x.channel, CASE WHEN l.channel IS NULL THEN 0 ELSE 1 END AS y
  FROM x
  LEFT JOIN l ON l.subject = x.subject AND l.channel = x.channel""",
    "standardised_features": f"""WITH {_MM}, {_BINS},
v AS (SELECT subject, channel, (bin * 2 + mode) * 2 + metric AS k, coalesce(avg(value), 0) AS value
  FROM mm
  JOIN bn USING (op_window)
  GROUP BY subject, channel, bin, mode, metric),
st AS (SELECT k, avg(value) AS m, stddev_pop(value) AS s
  FROM v
  WHERE subject <> 0
  GROUP BY k)
  SELECT channel, CAST(k AS BIGINT) AS k, round((value - m) / CASE WHEN s > 0 THEN s ELSE 1 END, 6) AS value
  FROM v
  JOIN st USING (k)
  WHERE subject = 0""",
    "balanced_rows": f"""WITH {F5},
bl AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5(subject || '|' || run || '|' || CAST(channel AS VARCHAR) || '|42'), subject, run, channel) AS r, sum(y) OVER () AS p, sum(1 - y) OVER () AS n
  FROM f5)
  SELECT subject, run, channel, y, round(score, 6) AS score
  FROM bl
  WHERE r <= least(p, n)""",
    "top_modes": f"WITH {_MM} SELECT subject, channel, op_window, mode, metric, {_X1} FROM mm WHERE mode = 0",
    "run_scores": f"WITH {F5} SELECT subject, run, channel, y, round(CASE WHEN score >= 1 THEN score ELSE 0 END, 6) AS score FROM f5",
    "ranking_metrics": f"""WITH {F5},
z AS (SELECT subject, count(*) AS n_channels, CAST(sum(y) AS BIGINT) AS n_soz
  FROM f5
  GROUP BY subject),
a AS ({ORACLE['roc_auc']}),
p AS ({ORACLE['average_precision']}),
t AS ({_TOPK})
  SELECT subject, n_channels, n_soz, CASE WHEN n_soz BETWEEN 1 AND n_channels - 1 THEN auc END AS auc, ap, accuracy, balanced_accuracy, precision, recall, f1
  FROM z
  JOIN a USING (subject)
  LEFT JOIN p USING (subject)
  JOIN t USING (subject)""",
    "run_metrics": "",
}
_BY_RUN = lambda q: q.replace("SELECT source AS subject, lang AS run", "SELECT source || chr(31) || lang AS subject, lang AS run")
ORACLE["run_metrics"] = f"""WITH c AS ({_BY_RUN(ORACLE['confusion_metrics'])}),
a AS ({_BY_RUN(ORACLE['roc_auc'])})
  SELECT split_part(subject, chr(31), 1) AS subject, split_part(subject, chr(31), 2) AS run, tp + fp + fn + tn AS n_channels, tp + fn AS n_soz, tp, fp, fn, tn, acc, sen, spec, auc
  FROM c
  JOIN a USING (subject)"""
ORACLE["hfo_events_kernel"] = ORACLE["hfo_events"]
_TEN = {"in_strength": f"WITH {_sparse(0.9)}, {ND} SELECT a AS channel, coalesce((SELECT sum(w) FROM sp WHERE v = a), 0) AS value FROM nd", "out_strength": f"WITH {_sparse(0.9)}, {ND} SELECT a AS channel, coalesce((SELECT sum(w) FROM sp WHERE u = a), 0) AS value FROM nd"}
_TEN |= {k: ORACLE[k].replace(", 6) AS value", ", 9) AS value") for k in ("in_closeness", "out_closeness", "clustering", "local_efficiency", "betweenness", "pagerank", "hubs", "authorities")}
ORACLE["ten_centralities"] = " UNION ALL ".join(f"SELECT channel, '{k}' AS metric, round(value, 4) AS value FROM ({q})" for k, q in _TEN.items())
ORACLE |= {name: f'SELECT subject // {RUNS} AS subject, subject % {RUNS} AS run, * EXCLUDE (subject) FROM ({sql})' for name, sql in ORACLE.items() if F1 in sql}

ORACLE["odd_mean_success"] = f"""SELECT subject // {RUNS} AS subject, count(*) AS n_runs, round(avg(success_rate), 6) AS mean_success_rate
  FROM ({_ODD_RATES})
  GROUP BY 1"""


# -- the same metrics for many graphs, by period


def _period_steps(edges: str, eps: str, name: str, levels: int = 5) -> str:
    """Shortest distances within each period as <name><levels>(g, a, b, d), by repeated min-plus squaring."""
    out = f"""{name}0 AS MATERIALIZED (
  SELECT g, a, b, min(d) AS d FROM (SELECT g, u AS a, v AS b, 1 / (w + {eps}) AS d FROM {edges} UNION ALL SELECT g, a, a, 0.0 FROM gn) GROUP BY g, a, b
)"""
    for k in range(levels):
        out += f""", {name}{k + 1} AS MATERIALIZED (
  SELECT x.g, x.a, y.b, min(x.d + y.d) AS d FROM {name}{k} x JOIN {name}{k} y ON x.g = y.g AND x.b = y.a GROUP BY x.g, x.a, y.b
)"""
    return out


def _period_leading(name: str, matrix: str, rounds: int = 400) -> str:
    """<name>(g, a, x): the leading eigenvector of each period's matrix(g, a, b, m), of sum 1 if the matrix has any row."""
    return f"""{name}m AS MATERIALIZED ({matrix}), {name}t AS (SELECT g, max(m) AS t FROM (SELECT g, a, sum(m) AS m FROM {name}m GROUP BY g, a) GROUP BY g), {name}i AS (
  SELECT 0 AS k, g, a, 1.0::DOUBLE AS x FROM (SELECT DISTINCT g, a FROM {name}m)
  UNION ALL
  SELECT k + 1, g, a, x
  FROM (SELECT i.k, m.g, m.a, sum(m.m / t.t * i.x) AS x
  FROM {name}i i
  JOIN {name}m m ON m.g = i.g AND m.b = i.a
  JOIN {name}t t ON t.g = m.g
  WHERE i.k < {rounds}
  GROUP BY i.k, m.g, m.a)
), {name} AS (
  SELECT g, a, x, x / sqrt(sum(x * x) OVER (PARTITION BY g)) AS unit FROM (SELECT g, a, x / sum(x) OVER (PARTITION BY g) AS x FROM {name}i WHERE k = {rounds})
)"""


_PERIODS = """gf AS (
  SELECT CAST(year(o_orderdate) AS VARCHAR) || '-' || substr(o_orderpriority, 1, 1) AS g, CAST(s_nationkey AS BIGINT) AS u, CAST(c_nationkey AS BIGINT) AS v, sum(l_extendedprice) / 1e6 AS w
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey WHERE s_nationkey <> c_nationkey GROUP BY 1, 2, 3
), gq AS (
  SELECT g, quantile_cont(w, 0.5) AS t FROM gf WHERE w > 0 GROUP BY g
), gs AS MATERIALIZED (
  SELECT gf.* FROM gf JOIN gq USING (g) WHERE w > 0 AND w >= t
), gn AS MATERIALIZED (
  SELECT g, CAST(n_nationkey AS BIGINT) AS a, count(*) OVER (PARTITION BY g) AS n FROM (SELECT DISTINCT g FROM gs), nation
)"""


def _period_closeness(a: str, b: str) -> str:
    return f"""SELECT gn.g, gn.a, CASE WHEN t > 0 THEN r / t * r / (n - 1) ELSE 0 END AS value
  FROM gn JOIN (SELECT g, {a} AS a, count(*) - 1 AS r, sum(d) AS t FROM d5 GROUP BY 1, 2) USING (g, a)"""


_PERIOD_METRICS = {
    "in_strength": "SELECT gn.g, gn.a, coalesce(s, 0) AS value FROM gn LEFT JOIN (SELECT g, v AS a, sum(w) AS s FROM gs GROUP BY 1, 2) USING (g, a)",
    "out_strength": "SELECT gn.g, gn.a, coalesce(s, 0) AS value FROM gn LEFT JOIN (SELECT g, u AS a, sum(w) AS s FROM gs GROUP BY 1, 2) USING (g, a)",
    "in_closeness": _period_closeness("b", "a"),
    "out_closeness": _period_closeness("a", "b"),
    "clustering": """SELECT gn.g, gn.a, CASE WHEN coalesce(t, 0) > 0 AND k * (k - 1) - 2 * coalesce(m, 0) > 0 THEN t / (k * (k - 1) - 2 * coalesce(m, 0)) ELSE 0 END AS value
  FROM gn LEFT JOIN tri USING (g, a) LEFT JOIN (SELECT g, a, count(*) AS k FROM (SELECT g, u AS a FROM gs UNION ALL SELECT g, v FROM gs) GROUP BY 1, 2) USING (g, a)
  LEFT JOIN (SELECT x.g, x.u AS a, count(*) AS m FROM gs x JOIN gs y ON x.g = y.g AND x.u = y.v AND x.v = y.u GROUP BY 1, 2) USING (g, a)""",
    "local_efficiency": """SELECT gn.g, gn.a, coalesce(s / nullif(m * (m - 1), 0), 0) AS value
  FROM gn LEFT JOIN (SELECT g, c AS a, count(*) AS m FROM nb GROUP BY 1, 2) USING (g, a) LEFT JOIN (SELECT g, c AS a, sum(1 / d) AS s FROM e5 WHERE e5.a <> e5.b GROUP BY 1, 2) USING (g, a)""",
    "betweenness": """SELECT gn.g, gn.a, coalesce(k, 0) / ((n - 1) * (n - 2)) AS value FROM gn LEFT JOIN (
    SELECT x.g, x.b AS a, count(*) AS k FROM d5 x JOIN d5 y ON x.g = y.g AND x.b = y.a JOIN d5 z ON z.g = x.g AND z.a = x.a AND z.b = y.b
    WHERE x.a <> x.b AND y.a <> y.b AND x.a <> y.b AND abs(x.d + y.d - z.d) <= 1e-9 * z.d GROUP BY 1, 2
  ) USING (g, a)""",
    "pagerank": """SELECT g, a, x AS value FROM pr JOIN (
    -- Rounds end when they change less than a millionth per node.
    SELECT y.g, y.k
  FROM pr x
  JOIN pr y ON x.g = y.g AND x.a = y.a AND y.k = x.k + 1
  GROUP BY y.g, y.k HAVING sum(abs(y.x - x.x)) < 1e-6 * count(*) QUALIFY row_number() OVER (PARTITION BY y.g ORDER BY y.k) = 1
  ) USING (g, k)""",
    "hubs": "SELECT gn.g, gn.a, coalesce(x, 0) AS value FROM gn LEFT JOIN hub USING (g, a)",
    "authorities": "SELECT gn.g, gn.a, coalesce(x, 0) AS value FROM gn LEFT JOIN aut USING (g, a)",
}

_NEAR = """nb AS (
  SELECT g, u AS c, v AS a FROM gs UNION SELECT g, v, u FROM gs
), e0 AS MATERIALIZED (
  SELECT x.g, x.c, s.u AS a, s.v AS b, 1 / (s.w + 1e-12) AS d FROM nb x JOIN gs s ON s.g = x.g AND s.u = x.a JOIN nb y ON y.g = x.g AND y.c = x.c AND y.a = s.v UNION ALL SELECT g, c, a, a, 0.0 FROM nb
)"""
for _k in range(5):
    _NEAR += f""", e{_k + 1} AS MATERIALIZED (
  SELECT x.g, x.c, x.a, y.b, min(x.d + y.d) AS d FROM e{_k} x JOIN e{_k} y ON x.g = y.g AND x.c = y.c AND x.b = y.a GROUP BY x.g, x.c, x.a, y.b
)"""

ORACLE["period_centralities"] = f"""
WITH RECURSIVE {_PERIODS}, {_period_steps("gs", "1e-12", "d")}, {_NEAR}, cube AS (
  SELECT g, u, v, cbrt(w / max(w) OVER (PARTITION BY g)) AS c FROM gs
), both_ways AS (
  SELECT g, u, v, sum(c) AS c FROM (SELECT g, u, v, c FROM cube UNION ALL SELECT g, v, u, c FROM cube) GROUP BY g, u, v
), tri AS (
  SELECT x.g, x.u AS a, sum(x.c * y.c * z.c) / 2 AS t FROM both_ways x JOIN both_ways y ON x.g = y.g AND x.v = y.u JOIN both_ways z ON z.g = y.g AND y.v = z.u AND z.v = x.u GROUP BY x.g, x.u
), moves AS MATERIALIZED (
  SELECT g, u, v, w / sum(w) OVER (PARTITION BY g, u) AS p FROM gs
  UNION ALL SELECT x.g, x.a, y.a, 1.0 / x.n FROM gn x JOIN gn y ON x.g = y.g WHERE (x.g, x.a) NOT IN (SELECT g, u FROM gs)
  UNION ALL SELECT g, a, a, 0.0 FROM gn  -- so that no node is lost on the way
), pr AS (
  SELECT 0 AS k, g, a, n, 1.0::DOUBLE / n AS x FROM gn
  UNION ALL
  SELECT k + 1, g, a, n, x
  FROM (SELECT i.k, i.g, m.v AS a, max(i.n) AS n, 0.85 * sum(i.x * m.p) + 0.15 / max(i.n) AS x
  FROM pr i
  JOIN moves m ON m.g = i.g AND m.u = i.a
  WHERE i.k < 60
  GROUP BY i.k, i.g, m.v)
), {_period_leading("hub", "SELECT x.g, x.u AS a, y.u AS b, sum(x.w * y.w) AS m FROM gs x JOIN gs y ON x.g = y.g AND x.v = y.v GROUP BY ALL")},
{_period_leading("aut", "SELECT x.g, x.v AS a, y.v AS b, sum(x.w * y.w) AS m FROM gs x JOIN gs y ON x.g = y.g AND x.u = y.u GROUP BY ALL")}
""" + " UNION ALL ".join(f"SELECT g AS period, a AS channel, '{k}' AS metric, round(value, 4) AS value FROM ({q})" for k, q in _PERIOD_METRICS.items())

_PATHS = ("in_closeness", "out_closeness", "local_efficiency", "betweenness")
ORACLE["period_path_metrics"] = f"WITH {_PERIODS}, {_period_steps('gs', '1e-12', 'd')}, {_NEAR} " + " UNION ALL ".join(
    f"SELECT g AS period, a AS channel, '{k}' AS metric, round(value, 4) AS value FROM ({_PERIOD_METRICS[k]})" for k in _PATHS
)

_PERIOD_NODES = {
    "strength": "SELECT gn.g, gn.a, coalesce(sum(w), 0) AS value FROM gn LEFT JOIN ub ON ub.g = gn.g AND ub.u = gn.a GROUP BY gn.g, gn.a",
    "degree_std": """SELECT gn.g, gn.a, sqrt(greatest(coalesce(sum(w * w), 0) / max(n) - pow(coalesce(sum(w), 0) / max(n), 2), 0)) AS value
  FROM gn
  LEFT JOIN ub ON ub.g = gn.g AND ub.u = gn.a
  GROUP BY gn.g, gn.a""",
    "eigenvector": "SELECT gn.g, gn.a, coalesce(unit, 0) AS value FROM gn LEFT JOIN eig USING (g, a)",
    "global_efficiency": """SELECT gn.g, gn.a, coalesce(avg(1 / d) FILTER (d > 0), 0) AS value
  FROM gn
  LEFT JOIN d5 ON d5.g = gn.g AND d5.a = gn.a
  GROUP BY gn.g, gn.a""",
}
ORACLE["period_node_metrics"] = f"""
WITH RECURSIVE {_PERIODS}, un AS (
  SELECT g, least(u, v) AS i, greatest(u, v) AS j, sum(w) AS w FROM gs GROUP BY ALL
), ub AS MATERIALIZED (
  SELECT g, i AS u, j AS v, w FROM un UNION ALL SELECT g, j, i, w FROM un
), {_period_steps("ub", "1e-8", "d")}, {_period_leading("eig", "SELECT x.g, x.u AS a, y.v AS b, sum(x.w * y.w) AS m FROM ub x JOIN ub y ON x.g = y.g AND x.v = y.u GROUP BY ALL")}
""" + " UNION ALL ".join(f"SELECT g AS period, a AS channel, '{k}' AS metric, round(value, 4) AS value FROM ({q})" for k, q in _PERIOD_NODES.items())
