"""Queries over the distribution of each group's values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.operators import distribution as D
from cohortry.plans.base import query, rounded, table
from cohortry.sources.shared import materialize

#: Grid of the queries that return whole curves; fronts are found on the library's own.
GRID, POINTS = 64, D.P.grid


def values(spark: SparkSession, d: str) -> DataFrame:
    return D.valid(table(spark, d, "events"), "user_id", "value")


def two_modes(spark: SparkSession, d: str) -> DataFrame:
    """Events with a cluster of early values apart from the rest."""
    return table(spark, d, "events").select("event_id", "user_id", F.expr(TWO_MODES).alias("value"))


TWO_MODES = "CASE WHEN event_id % 5 = 0 THEN 1 + value / 200 ELSE 12 + value END"
X2 = f"x AS (SELECT user_id AS g, {TWO_MODES} AS x FROM events)"
X = "x AS (SELECT user_id AS g, value AS x FROM events WHERE value > 0)"
GAPS = """
gaps AS (SELECT g, lead(x) OVER w - x AS gap, row_number() OVER w AS pos FROM x WINDOW w AS (PARTITION BY g ORDER BY x)),
eo AS (SELECT g, count(*) >= 4 AND max(CASE WHEN pos = 1 THEN gap END) > greatest(0.5::DOUBLE, 5 * CASE WHEN coalesce(quantile_cont(gap, 0.5) FILTER (WHERE pos > 1 AND gap > 0), 0) = 0 THEN 1e-6::DOUBLE
  ELSE quantile_cont(gap, 0.5) FILTER (WHERE pos > 1 AND gap > 0) END) AS early_outlier FROM gaps GROUP BY g)
"""


@query(f"WITH {X}, {GAPS} SELECT * FROM eo")
def early_outlier(spark: SparkSession, d: str) -> DataFrame:
    return D.early_outlier(values(spark, d))


PROFILE = """
pf AS (SELECT g, sum(k)::BIGINT AS n, min(x) AS low, max(x) AS high, max(k) / sum(k) AS top_share, max(k) / sum(k) > 0.2::DOUBLE AS many_duplicates, max(x) - min(x) < 0.25::DOUBLE AS narrow_range
  FROM (SELECT g, x, count(*) AS k FROM x GROUP BY 1, 2) GROUP BY 1)
"""


@query(f"WITH {X}, {GAPS}, {PROFILE} SELECT pf.*, early_outlier FROM pf JOIN eo USING (g)")
def value_profile(spark: SparkSession, d: str) -> DataFrame:
    return D.value_profile(values(spark, d))


@query(f"WITH {X} SELECT g, round(quantile_cont(x, 0.2), 9) AS q20, round(quantile_cont(x, 0.35), 9) AS q35, round(quantile_cont(x, 0.4), 9) AS q40, round(quantile_cont(x, 0.7), 9) AS q70 FROM x GROUP BY g")
def quantiles(spark: SparkSession, d: str) -> DataFrame:
    return rounded(D.quantiles(values(spark, d), {f"q{q}": q / 100 for q in (20, 35, 40, 70)}), "q20", "q35", "q40", "q70", digits=9)


def curve_sql(grid: int) -> str:
    return f"""
yy AS (SELECT g, ln(1 + x) AS y FROM x), st AS (SELECT g, count(*) AS n, min(y) AS low, max(y) AS high, count(*) ** (-0.2::DOUBLE) * stddev_samp(y) AS h FROM yy GROUP BY 1 HAVING count(*) >= 30 AND max(y) > min(y)),
kd AS (SELECT g, i, any_value(low + i * ((high - low) / {grid - 1})) AS gx, sum(w * exp(-0.5 * ((low + i * ((high - low) / {grid - 1}) - y) / h) ** 2)) / (any_value(n) * any_value(h) * sqrt(2 * pi())) AS density
  FROM (SELECT g, y, count(*) AS w FROM yy GROUP BY 1, 2) JOIN st USING (g), (SELECT unnest(generate_series(0, {grid - 1}))::INTEGER AS i) GROUP BY 1, 2)
"""


def front_curve_sql(grid: int) -> str:
    """The estimate from weights on the grid."""
    return f"""
yy AS (SELECT g, ln(1 + x) AS y FROM x), st AS (SELECT *, (high - low) / {grid - 1} AS step FROM (SELECT g, count(*) AS n, min(y) AS low, max(y) AS high, count(*) ** (-0.2::DOUBLE) * stddev_samp(y) AS h FROM yy GROUP BY 1 HAVING count(*) >= 30 AND max(y) > min(y))),
cl AS (SELECT g, k, count(*) AS whole, sum(spot - k) AS part FROM (SELECT g, spot, least(floor(spot), {grid - 2})::INTEGER AS k FROM (SELECT g, (y - low) / step AS spot FROM yy JOIN st USING (g))) GROUP BY 1, 2),
wt AS (SELECT g, k, sum(w) AS w FROM (SELECT g, k, whole - part AS w FROM cl UNION ALL SELECT g, k + 1, part FROM cl) GROUP BY 1, 2),
kd AS MATERIALIZED (SELECT g, i, any_value(low + i * step) AS gx, sum(w * exp(-0.5 * ((i - k) * (step / h)) ** 2)) / (any_value(n) * any_value(h) * sqrt(2 * pi())) AS density
  FROM wt JOIN st USING (g), (SELECT unnest(generate_series(0, {grid - 1}))::INTEGER AS i) GROUP BY 1, 2)
"""


def on_grid(spark: SparkSession, d: str, grid: int = GRID) -> DataFrame:
    return D.kde_exact(values(spark, d), grid)


@query(f"WITH {X}, {curve_sql(GRID)} SELECT g, i, round(gx, 9) AS gx, round(density, 9) AS density FROM kd")
def kde_grid(spark: SparkSession, d: str) -> DataFrame:
    return rounded(on_grid(spark, d), "gx", "density", digits=9)


#: A grid that is the same for all groups; values lie on it and beyond.
SPAN, SPAN_POINTS = (-5.0, 5.0), 5000


@query(f"""
WITH x AS (SELECT event_type AS g, ln(value) * 2 - 3 AS x FROM events WHERE value > 0),
st AS (SELECT g, count(*) AS n, (count(*) * 0.75::DOUBLE) ** (-0.2::DOUBLE) * stddev_samp(x) AS h, 10.0::DOUBLE / {SPAN_POINTS - 1} AS step FROM x GROUP BY 1 HAVING count(*) >= 30 AND max(x) > min(x)),
cl AS (SELECT g, k, count(*) AS whole, sum(spot - k) AS part FROM (SELECT g, spot, floor(spot)::INTEGER AS k FROM (SELECT g, (x + 5) / step AS spot FROM x JOIN st USING (g))) GROUP BY 1, 2),
wt AS (SELECT g, k, sum(w) AS w FROM (SELECT g, k, whole - part AS w FROM cl UNION ALL SELECT g, k + 1, part FROM cl) GROUP BY 1, 2)
SELECT g, i, round(any_value(-5 + i * step), 9) AS gx, round(sum(w * exp(-0.5 * ((i - k) * (step / h)) ** 2)) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 9) AS density
FROM wt JOIN st USING (g), (SELECT unnest(generate_series(0, {SPAN_POINTS - 1}))::INTEGER AS i) GROUP BY 1, 2
""")
def kde_fixed_grid(spark: SparkSession, d: str) -> DataFrame:
    """The estimate of every type's values on one grid, with Silverman's bandwidth."""
    rows = table(spark, d, "events").filter("value > 0").select(F.col("event_type").alias("g"), (F.ln("value") * 2 - 3).alias("x"))
    return rounded(D.kde(rows, SPAN_POINTS, bandwidth="silverman", span=SPAN, log=False), "gx", "density", digits=9)


@query(f"""
WITH {X}, {curve_sql(GRID)}, e AS (SELECT *, coalesce(lag(density) OVER w, density) AS d0, coalesce(lead(density) OVER w, density) AS d1, coalesce(lag(gx) OVER w, gx) AS x0, coalesce(lead(gx) OVER w, gx) AS x1 FROM kd WINDOW w AS (PARTITION BY g ORDER BY i)),
s AS (SELECT *, (d1 - d0) / (x1 - x0) AS gradient FROM e)
SELECT g, i, round(gradient, 6) AS gradient, round((coalesce(lead(gradient) OVER w, gradient) - coalesce(lag(gradient) OVER w, gradient)) / (x1 - x0), 6) AS curvature FROM s WINDOW w AS (PARTITION BY g ORDER BY i)
""")
def gradient_curve(spark: SparkSession, d: str) -> DataFrame:
    return rounded(D.gradients(on_grid(spark, d)).select("g", "i", "gradient", "curvature"), "gradient", "curvature")


EXTREMA = """
nb AS (SELECT g, i, density AS d, lag(density) OVER w AS d0, lead(density) OVER w AS d1 FROM kd WINDOW w AS (PARTITION BY g ORDER BY i)),
ex AS (SELECT g, i, CASE WHEN d > d0 AND d > d1 THEN 'peak' WHEN d < d0 AND d < d1 THEN 'valley' WHEN d0 IS NULL AND d > d1 THEN 'peak' WHEN d1 IS NULL AND d > d0 THEN 'peak' END AS kind FROM nb)
"""


@query(f"WITH {X}, {curve_sql(GRID)}, {EXTREMA} SELECT g, i, kind FROM ex WHERE kind IS NOT NULL")
def local_extrema(spark: SparkSession, d: str) -> DataFrame:
    return D.extrema(on_grid(spark, d)).select("g", "i", "kind")


LIMITS = """
lm AS (SELECT g, count(*) AS n, greatest(quantile_cont(ln(1 + x), 0.35), min(ln(1 + x)) + 0.2::DOUBLE * (max(ln(1 + x)) - min(ln(1 + x)))) AS zone, least(max(x) * 0.15::DOUBLE, 3) AS max_t0,
  least(quantile_cont(x, 0.4), max(x) * 0.2::DOUBLE) AS valley_limit, least(quantile_cont(x, 0.7), max(x) * 0.2::DOUBLE) AS drop_limit, least(quantile_cont(x, 0.7), max(x) * 0.3::DOUBLE) AS hist_limit, greatest(5, ceil(0.01::DOUBLE * count(*))) AS cluster FROM x GROUP BY 1)
"""


VALLEY = """
ea AS MATERIALIZED (SELECT * FROM ex JOIN kd USING (g, i) WHERE kind IS NOT NULL), tp AS (SELECT g, max(density) AS top FROM kd GROUP BY 1),
vp AS (SELECT ea.g, ea.i AS pi, exp(gx) - 1 AS mode, density AS pd, valley_limit, cluster FROM ea JOIN tp USING (g) JOIN lm USING (g) WHERE kind = 'peak' AND gx <= zone AND density >= 0.02::DOUBLE * top AND gx > 0 AND exp(gx) - 1 <= max_t0),
vl AS (SELECT g, i AS vi, exp(gx) - 1 AS cut, density AS vd FROM ea WHERE kind = 'valley'),
pr AS (SELECT *, 1 - vd / pd AS depth, (SELECT count(*) FROM x WHERE x.g = vp.g AND x.x <= cut) AS size FROM vp JOIN vl USING (g) WHERE vi > pi AND cut <= valley_limit AND 1 - vd / pd >= 0.25::DOUBLE),
va AS (SELECT g, mode, cut, depth, size FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY pi, vi) AS k FROM pr WHERE size >= cluster) WHERE k = 1)
"""


@query(f"""
WITH {X2}, {front_curve_sql(POINTS)}, {EXTREMA}, {LIMITS}, {VALLEY} SELECT g, round(mode, 6) AS mode, round(cut, 6) AS cut, round(depth, 6) AS depth, size FROM va
""")
def mode_valley(spark: SparkSession, d: str) -> DataFrame:
    rows = D.valid(two_modes(spark, d), "user_id", "value")
    lim = materialize(D.limits(rows), "limits")  # read several times, as shapes are
    return rounded(D.mode_valley(rows, materialize(D.shapes(rows, lim), "shapes"), lim, D.P), "mode", "cut", "depth")


#: Per early peak: what follows it on the curve, the way that gives a cut, and its flags; then the first accepted peak.
DROP = f"""
g1 AS (SELECT g, i, gx, density, (coalesce(lead(density) OVER w, density) - coalesce(lag(density) OVER w, density)) / (coalesce(lead(gx) OVER w, gx) - coalesce(lag(gx) OVER w, gx)) AS sl FROM kd WINDOW w AS (PARTITION BY g ORDER BY i)),
g2 AS MATERIALIZED (SELECT *, (coalesce(lead(sl) OVER w, sl) - coalesce(lag(sl) OVER w, sl)) / (coalesce(lead(gx) OVER w, gx) - coalesce(lag(gx) OVER w, gx)) AS cv FROM g1 WINDOW w AS (PARTITION BY g ORDER BY i)),
gs AS (SELECT g, max(abs(sl)) AS steepest FROM g1 GROUP BY 1),
fr AS (SELECT g, quantile_cont(density, 0.5) AS reference FROM kd JOIN lm USING (g) WHERE gx > zone GROUP BY 1),
dp AS (SELECT ea.g, ea.i AS pi, exp(ea.gx) - 1 AS mode, density AS pd, top, steepest, reference, max_t0, drop_limit, cluster FROM ea JOIN tp USING (g) JOIN lm USING (g) JOIN gs USING (g) LEFT JOIN fr USING (g)
  WHERE kind = 'peak' AND ea.i < {POINTS - 1} AND gx <= zone AND density >= 0.10::DOUBLE * top),
d1 AS (SELECT dp.g, pi, abs(min(sl) FILTER (WHERE i >= pi AND i < least({POINTS}, pi + greatest(4, {POINTS} // 20)))) AS steep FROM dp JOIN g2 USING (g) GROUP BY 1, 2),
d2 AS (SELECT dp.g, dp.pi, min(i) FILTER (WHERE density <= 0.30::DOUBLE * pd) AS any_i, min(i) FILTER (WHERE density <= 0.30::DOUBLE * pd AND sl < 0 AND cv > 0) AS bent_i,
  min(i) FILTER (WHERE sl < 0 AND cv > 0 AND abs(sl) <= 0.25::DOUBLE * steep) AS relax_i, min(i) FILTER (WHERE density <= 0.60::DOUBLE * pd) AS shoulder_i
  FROM dp JOIN d1 USING (g, pi) JOIN g2 USING (g) WHERE i > pi GROUP BY 1, 2),
d3 AS (SELECT dp.*, steep, coalesce(bent_i, any_i) AS drop_i, relax_i, shoulder_i FROM dp JOIN d1 USING (g, pi) LEFT JOIN d2 USING (g, pi)),
d4 AS (SELECT d3.*, exp(a.gx) - 1 AS drop_cut, exp(b.gx) - 1 AS relax_cut, CASE WHEN mode > max_t0 THEN 'late' WHEN reference IS NULL OR reference <= 0 THEN 'blank'
  WHEN pd / reference < 1.8::DOUBLE AND pd / top < 0.75::DOUBLE THEN 'weak' WHEN steepest <= 0 THEN 'blank' WHEN steep < 0.20::DOUBLE * steepest THEN 'slow' ELSE 'open' END AS state
  FROM d3 LEFT JOIN kd a ON a.g = d3.g AND a.i = drop_i LEFT JOIN kd b ON b.g = d3.g AND b.i = relax_i),
d5 AS (SELECT *, CASE WHEN state <> 'open' THEN NULL WHEN drop_cut <= drop_limit THEN 'drop' WHEN relax_cut <= drop_limit THEN 'relax' WHEN shoulder_i IS NOT NULL THEN 'shoulder' END AS way FROM d4),
d6 AS (SELECT d5.*, exp(gx) - 1 AS cut, 1 - density / pd AS depth FROM d5 LEFT JOIN kd ON kd.g = d5.g AND kd.i = CASE way WHEN 'drop' THEN drop_i WHEN 'relax' THEN relax_i WHEN 'shoulder' THEN shoulder_i END),
d7 AS (SELECT *, CASE WHEN cut IS NOT NULL THEN (SELECT count(*) FROM x WHERE x.g = d6.g AND x.x <= cut) END AS size FROM d6),
d8 AS (SELECT *, coalesce(cut <= drop_limit AND size >= cluster, false) AS ok, list_filter([
  CASE WHEN state = 'late' THEN 'putative_t0_candidate_too_late' END, CASE WHEN state = 'weak' THEN 'no_dominant_early_density' END, CASE WHEN state = 'slow' THEN 'insufficient_initial_density_drop' END,
  CASE WHEN state = 'open' AND drop_i IS NULL THEN 'insufficient_density_drop' END, CASE WHEN state = 'open' AND drop_cut > drop_limit THEN 'fallback_density_drop_cutoff_too_late' END,
  CASE WHEN way = 'relax' THEN 'cutoff_estimated_from_slope_relaxation' END, CASE WHEN way = 'shoulder' THEN 'cutoff_estimated_from_early_shoulder' END,
  CASE WHEN cut > drop_limit THEN 'fallback_cutoff_too_late' END, CASE WHEN cut <= drop_limit AND size < cluster THEN 'fallback_early_cluster_too_small' END,
  CASE WHEN cut <= drop_limit AND size >= cluster THEN 'cutoff_estimated_from_density_drop' END], lambda f: f IS NOT NULL) AS own FROM d7),
d9 AS (SELECT *, min(pi) FILTER (WHERE ok) OVER (PARTITION BY g) AS best FROM d8),
fl AS (SELECT g, flag, min(pi * 100 + p) AS pos FROM (SELECT g, pi, unnest(own) AS flag, generate_subscripts(own, 1) AS p FROM d9 WHERE best IS NULL OR pi <= best) GROUP BY 1, 2),
dr AS (SELECT st.g, mode, cut, depth, size, CASE WHEN st.g NOT IN (SELECT g FROM dp) THEN 'no_early_mode_detected' ELSE coalesce(flags, '') END AS flags
  FROM st LEFT JOIN (SELECT * FROM d9 WHERE pi = best) USING (g) LEFT JOIN (SELECT g, string_agg(flag, '; ' ORDER BY pos) AS flags FROM fl GROUP BY 1) USING (g))
"""


@query(f"WITH {X}, {front_curve_sql(POINTS)}, {EXTREMA}, {LIMITS}, {VALLEY}, {DROP} SELECT g, round(mode, 6) AS mode, round(cut, 6) AS cut, round(depth, 6) AS depth, size, flags FROM dr")
def density_drop(spark: SparkSession, d: str) -> DataFrame:
    rows = values(spark, d)
    lim = materialize(D.limits(rows), "limits")
    out = D.density_drop(rows, materialize(D.shapes(rows, lim), "shapes"), lim, D.P)
    return rounded(out.withColumn("flags", F.array_join("flags", "; ")), "mode", "cut", "depth")


@query(f"""
WITH {X}, s AS (SELECT g, min(x) AS low, max(x) AS high, least(60, greatest(10, floor(sqrt(count(*)))))::INTEGER AS bins FROM x GROUP BY 1 HAVING max(x) > min(x))
SELECT g, bins, low, high, least(bins - 1, floor((x - low) / (high - low) * bins))::INTEGER AS bin, count(*) AS n FROM x JOIN s USING (g) GROUP BY ALL
""")
def histogram_bins(spark: SparkSession, d: str) -> DataFrame:
    return D.histogram(values(spark, d))


HIST = """
hs AS (SELECT g, count(*) AS n, min(x) AS low, max(x) AS high, least(60, greatest(10, floor(sqrt(count(*)))))::INTEGER AS bins FROM x GROUP BY 1 HAVING max(x) > min(x)),
hb AS (SELECT g, least(bins - 1, floor((x - low) / (high - low) * bins))::INTEGER AS b, count(*) AS k FROM x JOIN hs USING (g) GROUP BY 1, 2),
hc AS (SELECT e.g, list(coalesce(k, 0) ORDER BY e.b) AS c FROM (SELECT g, unnest(generate_series(0, bins - 1))::INTEGER AS b FROM hs) e LEFT JOIN hb ON hb.g = e.g AND hb.b = e.b GROUP BY 1),
h1 AS (SELECT hs.*, c, c[1] AS f, c[2] AS s, list_avg(c[2:]) AS rest, list_avg(c[3:]) AS rest2, low + (high - low) * 1 / bins AS e1, low + (high - low) * 2 / bins AS e2, hist_limit, cluster, early_outlier
  FROM hs JOIN hc USING (g) JOIN (SELECT g, hist_limit, cluster FROM lm) USING (g) JOIN eo USING (g)),
h2 AS (SELECT *, f >= 2.5::DOUBLE * greatest(s, 1) AND f >= 3.0::DOUBLE * rest AS single, rest2 > 0 AND (f + s) / n >= 0.2::DOUBLE AND (f + s) / 2.0::DOUBLE >= 2.0::DOUBLE * rest2 AS strong FROM h1
  WHERE n >= 10 AND rest > 0 AND (f / n >= 0.08::DOUBLE OR early_outlier)),
h3 AS (SELECT *, strong AND f >= 1.5::DOUBLE * rest2 AND s >= 1.5::DOUBLE * rest2 AS two, early_outlier AND strong AND f / n <= 0.02::DOUBLE AND s >= 2.5::DOUBLE * rest2 AS lone FROM h2),
h4 AS (SELECT *, single OR two OR lone AS hit, NOT single AND (two OR lone) AS pair, NOT single AND lone AS second,
  list_filter(generate_series(1, least(bins - 1, 5) - 1), lambda i: c[i + 1] <= c[i] AND c[i + 1] <= c[i + 2] AND low + (high - low) * (i + 1) / bins <= hist_limit)[1] AS v,
  list_filter(generate_series(1, least(bins - 1, 5) - 1), lambda i: c[i + 1] <= 0.2::DOUBLE * f AND low + (high - low) * (i + 1) / bins <= hist_limit)[1] AS d FROM h3),
h5 AS (SELECT *, CASE WHEN hit AND pair THEN CASE WHEN e2 <= hist_limit THEN 'pair' END WHEN hit AND v IS NOT NULL THEN 'valley' WHEN hit AND d IS NOT NULL THEN 'fall' WHEN hit AND e1 <= hist_limit THEN 'edge' END AS way FROM h4),
h6 AS (SELECT *, CASE way WHEN 'pair' THEN e2 WHEN 'edge' THEN e1 WHEN 'valley' THEN low + (high - low) * (v + 1) / bins WHEN 'fall' THEN low + (high - low) * (d + 1) / bins END AS cut,
  1 - c[CASE way WHEN 'pair' THEN 3 WHEN 'valley' THEN v + 1 WHEN 'fall' THEN d + 1 WHEN 'edge' THEN 2 END] / greatest(CASE WHEN pair THEN (f + s) / 2.0::DOUBLE ELSE f END, 1) AS depth FROM h5),
h7 AS (SELECT g, quantile_cont(x, 0.5) FILTER (WHERE x >= CASE WHEN second THEN e1 ELSE low END AND x <= CASE WHEN second THEN e2 ELSE e1 END) AS mode, count(*) FILTER (WHERE x <= cut) AS size FROM x JOIN h6 USING (g) GROUP BY 1),
h8 AS (SELECT *, way IS NOT NULL AND size >= cluster AS ok FROM h6 JOIN h7 USING (g)),
hf AS (SELECT g, CASE WHEN ok THEN mode END AS mode, CASE WHEN ok THEN cut END AS cut, CASE WHEN ok THEN depth END AS depth, CASE WHEN ok THEN size END AS size,
  concat_ws('; ', CASE WHEN NOT hit THEN 'no_histogram_first_bin_enrichment' END, CASE way WHEN 'pair' THEN 'cutoff_estimated_from_first_two_histogram_bins' WHEN 'valley' THEN 'cutoff_estimated_from_histogram_valley'
    WHEN 'fall' THEN 'cutoff_estimated_from_histogram_drop' WHEN 'edge' THEN 'cutoff_estimated_from_first_histogram_bin' END, CASE WHEN way IS NOT NULL AND size < cluster THEN 'histogram_early_cluster_too_small' END,
    CASE WHEN ok AND second THEN 't0_estimated_as_median_of_second_histogram_bin' WHEN ok THEN 't0_estimated_as_median_of_first_histogram_bin' END) AS flags FROM h8)
"""


@query(f"WITH {X}, {GAPS}, {LIMITS}, {HIST} SELECT g, round(mode, 6) AS mode, round(cut, 6) AS cut, round(depth, 6) AS depth, size, flags FROM hf")
def histogram_front(spark: SparkSession, d: str) -> DataFrame:
    rows = values(spark, d)
    cuts = D.cuts_of(rows, "x")
    out = D.histogram_front(rows, materialize(D.value_profile(rows, cuts), "profile"), materialize(D.limits(rows, D.P, cuts), "limits"), D.P, cuts)
    return rounded(out.withColumn("flags", F.array_join("flags", "; ")), "mode", "cut", "depth")


#: The three ways in order, what a front implies of the values, flags in the order they are raised, and the confidence.
FRONTS = """
va1 AS (SELECT g, 1 AS rank, 'first_valley' AS method, mode, cut, depth, size FROM va), dr1 AS (SELECT g, 2 AS rank, 'density_drop' AS method, mode, cut, depth, size FROM dr WHERE mode IS NOT NULL),
hf1 AS (SELECT g, 3 AS rank, 'histogram_first_bin' AS method, mode, cut, depth, size FROM hf WHERE mode IS NOT NULL),
won AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY rank) AS k FROM (SELECT * FROM va1 UNION ALL SELECT * FROM dr1 UNION ALL SELECT * FROM hf1)) WHERE k = 1 AND g IN (SELECT g FROM st)),
r1 AS (SELECT pf.g, pf.n, top_share, many_duplicates, narrow_range, early_outlier, high AS top, max_t0, cluster, rank, method, mode, cut, depth, size, pf.g IN (SELECT g FROM st) AS run, pf.n >= 30 AS enough
  FROM pf JOIN eo USING (g) JOIN (SELECT g, max_t0, cluster FROM lm) USING (g) LEFT JOIN won USING (g)),
r2 AS (SELECT r1.*, (SELECT quantile_cont(x.x, 0.5) FROM x WHERE x.g = r1.g AND x.x <= cut) AS middle, (SELECT count(*) FROM x WHERE x.g = r1.g AND x.x <= cut) / n AS cut_share FROM r1),
r3 AS (SELECT *, cut IS NOT NULL AND many_duplicates AND size >= 5 AS pooled, CASE WHEN cut IS NOT NULL AND many_duplicates AND size >= 5 THEN middle ELSE mode END AS t0 FROM r2),
r4 AS (SELECT r3.*, (SELECT count(*) FROM x WHERE x.g = r3.g AND x.x <= t0) / r3.n AS t0_share, CASE WHEN run AND rank IS DISTINCT FROM 1 THEN dr.flags ELSE '' END AS df, CASE WHEN run AND coalesce(rank, 3) = 3 THEN coalesce(hf.flags, '') ELSE '' END AS hflags
  FROM r3 LEFT JOIN dr USING (g) LEFT JOIN hf USING (g)),
r5 AS (SELECT *, concat_ws('; ', CASE WHEN many_duplicates THEN 'many_duplicate_rt_values' END, CASE WHEN narrow_range THEN 'narrow_rt_range' END,
  CASE WHEN early_outlier AND NOT (coalesce(rank, 0) = 3 AND contains(hflags, 't0_estimated_as_median_of_second_histogram_bin')) THEN 'possible_early_outlier' END,
  CASE WHEN NOT enough THEN 'insufficient_data' WHEN NOT run THEN 'kde_failed' END, CASE WHEN rank = 1 THEN 'cutoff_estimated_from_first_valley' END,
  nullif(CASE WHEN rank = 3 AND mode <= max_t0 THEN array_to_string(list_filter(string_split(df, '; '), lambda f: f <> 'putative_t0_candidate_too_late'), '; ') ELSE df END, ''), nullif(hflags, ''),
  CASE WHEN run AND rank IS NULL AND df <> 'no_early_mode_detected' THEN 'no_clear_early_valley' END, CASE WHEN pooled THEN 't0_estimated_as_median_of_early_cluster' END) AS flags FROM r4),
r6 AS (SELECT g, n, t0, cut AS cutoff, method, flags, CASE WHEN NOT enough THEN 'insufficient_data'
  WHEN rank IS NULL OR depth < 0.25::DOUBLE OR size < cluster OR cut_share > CASE WHEN rank = 1 THEN 0.40::DOUBLE ELSE 0.70::DOUBLE END OR t0 > max_t0 OR cut > top * CASE WHEN rank = 3 THEN 0.30::DOUBLE ELSE 0.20::DOUBLE END
    OR contains(flags, 'possible_early_outlier') THEN 'low'
  WHEN depth >= 0.40::DOUBLE AND size >= 5 AND NOT narrow_range AND t0 < cut THEN CASE WHEN rank = 1 AND t0_share <= 0.20::DOUBLE THEN 'high' ELSE 'medium' END
  WHEN rank = 1 THEN 'medium' ELSE 'low' END AS confidence FROM r5)
"""
RESOLVED = f"WITH {X2}, {front_curve_sql(POINTS)}, {EXTREMA}, {GAPS}, {PROFILE}, {LIMITS}, {VALLEY}, {DROP}, {HIST}, {FRONTS}"


@query(f"{RESOLVED} SELECT g, n, round(t0, 6) AS t0, round(cutoff, 6) AS cutoff, method, confidence, flags FROM r6")
def front_resolved(spark: SparkSession, d: str) -> DataFrame:
    return rounded(D.fronts(two_modes(spark, d), "user_id", "value", D.P), "t0", "cutoff")


@query(f"""
{RESOLVED} SELECT event_id, user_id, value, round(CASE WHEN t0 > 0 THEN (value - t0) / t0 END, 6) AS pseudo_k, CASE WHEN value IS NULL OR value <= 0 OR t0 IS NULL OR cutoff IS NULL OR confidence = 'low' THEN 'uncertain'
  WHEN value <= cutoff THEN 'putatively_non_retained' WHEN (value - t0) / t0 < 1 THEN 'weakly_retained' ELSE 'retained' END AS status
FROM (SELECT event_id, user_id, {TWO_MODES} AS value FROM events) LEFT JOIN r6 ON g = user_id
""")
def classify_full(spark: SparkSession, d: str) -> DataFrame:
    events = two_modes(spark, d)
    return rounded(D.classify(events, D.fronts(events, "user_id", "value", D.P), "user_id", "value"), "pseudo_k")


@query("""
SELECT event_id, CASE WHEN c IS NULL THEN 'uncertain' WHEN value >= c THEN 'retained' ELSE 'non_retained' END AS status FROM events
JOIN (SELECT user_id, CASE WHEN user_id % 9 = 0 THEN NULL ELSE quantile_disc(value, 0.2) END AS c FROM events GROUP BY user_id) USING (user_id)
""")
def classify_simple(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    cut = F.expr("CASE WHEN user_id % 9 = 0 THEN NULL ELSE percentile_disc(0.2) WITHIN GROUP (ORDER BY value) END")
    rows = events.join(events.groupBy("user_id").agg(cut.alias("c")), "user_id")
    return D.classify_simple(rows, "value", "c").select("event_id", "status")
