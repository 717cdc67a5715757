"""Queries over splits and folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.operators import splits as K
from cohortry.plans.base import query, rounded, table

HASH = "md5(event_id::VARCHAR || '42'), event_id"


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "user_id", "event_type")


def pairs(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_partkey").join(part, "l_partkey")
    return K.pair_counts(rows, "l_suppkey", "p_type")


def restarts(p: DataFrame) -> DataFrame:
    """Three plain assignments of every group, to evaluate side by side."""
    return p.select("g").distinct().crossJoin(p.sparkSession.range(3).select(F.col("id").cast("int").alias("restart"))).selectExpr("restart", "g", "CAST((g div (restart + 1)) % 3 AS INT) AS split")


@query(f"SELECT event_id, user_id, (ntile(10) OVER (PARTITION BY user_id ORDER BY {HASH}) - 1)::INTEGER AS fold FROM events")
def kfold_stratified(spark: SparkSession, d: str) -> DataFrame:
    return K.kfold_stratified(events(spark, d), "user_id", "event_id").select("event_id", "user_id", "fold")


@query("""
WITH RECURSIVE s AS (SELECT k, n, row_number() OVER (ORDER BY n DESC, k) AS i FROM (SELECT user_id AS k, count(*) AS n FROM events GROUP BY 1)),
r AS (
  SELECT 0::BIGINT AS i, NULL::BIGINT AS k, 0::BIGINT AS n, -1 AS fold, list_transform(generate_series(1, 5), lambda x: 0::BIGINT) AS loads
  UNION ALL
  SELECT i, k, n, pos - 1, list_transform(generate_series(1, 5), lambda j: CASE WHEN j = pos THEN loads[j] + n ELSE loads[j] END)
  FROM (SELECT s.i, s.k, s.n, r.loads, list_position(r.loads, list_min(r.loads)) AS pos FROM r JOIN s ON s.i = r.i + 1)
)
SELECT k AS user_id, n, fold::INTEGER AS fold FROM r WHERE i > 0
""")
def kfold_group_greedy(spark: SparkSession, d: str) -> DataFrame:
    return K.kfold_groups(events(spark, d), "user_id", 5)


@query(f"""
SELECT event_id, user_id, CASE WHEN pos <= test THEN 'test' WHEN pos <= test + ceil((n - test) * 0.1111::DOUBLE) THEN 'val' ELSE 'train' END AS split
FROM (SELECT *, ceil(n * 0.1::DOUBLE) AS test FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY {HASH}) AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM events))
""")
def split_stratified(spark: SparkSession, d: str) -> DataFrame:
    return K.split_stratified(events(spark, d), "user_id", "event_id").select("event_id", "user_id", "split")


def first_fit_sql(source: str, key: str, kind: str) -> str:
    return f"""
WITH RECURSIVE s AS (SELECT k, n, sum(n) OVER () AS total, row_number() OVER (ORDER BY md5(k::VARCHAR || '42'), k) AS i FROM ({source})),
r AS (
  SELECT 0::BIGINT AS i, NULL::{kind} AS k, 0::BIGINT AS n, '' AS split, 0::BIGINT AS train, 0::BIGINT AS val
  UNION ALL
  SELECT i, k, n, split, train + CASE WHEN split = 'train' THEN n ELSE 0 END, val + CASE WHEN split = 'val' THEN n ELSE 0 END
  FROM (SELECT s.i, s.k, s.n, r.train, r.val, CASE WHEN r.train + s.n < 0.8::DOUBLE * s.total THEN 'train' WHEN r.val + s.n < 0.1::DOUBLE * s.total THEN 'val' ELSE 'test' END AS split FROM r JOIN s ON s.i = r.i + 1)
)
SELECT k AS {key}, n, split FROM r WHERE i > 0
"""


@query(first_fit_sql("SELECT user_id AS k, count(*) AS n FROM events GROUP BY 1", "user_id", "BIGINT"))
def split_group_firstfit(spark: SparkSession, d: str) -> DataFrame:
    return K.split_groups(events(spark, d), "user_id")


@query(first_fit_sql("SELECT p_type AS k, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_type <> '' GROUP BY 1", "p_type", "VARCHAR"))
def split_category_firstfit(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    return K.split_groups(table(spark, d, "lineitem").select("l_partkey").join(part, "l_partkey"), "p_type")


@query(f"""
SELECT run, role, count(*) AS n FROM (SELECT run, CASE WHEN fold = run THEN 'test' WHEN fold = (run + 1) % 10 THEN 'val' ELSE 'train' END AS role
  FROM (SELECT ntile(10) OVER (PARTITION BY user_id ORDER BY {HASH}) - 1 AS fold FROM events), (SELECT unnest(generate_series(0, 9))::INTEGER AS run)) GROUP BY ALL
""")
def cv_roles(spark: SparkSession, d: str) -> DataFrame:
    rows = K.kfold_stratified(events(spark, d), "user_id", "event_id")
    return rows.join(F.broadcast(K.cv_roles(10, spark)), "fold").groupBy("run", "role").agg(F.count("*").alias("n"))


@query(f"""
SELECT event_id, CASE WHEN pos <= floor(n * 0.8::DOUBLE) THEN 'train' WHEN pos <= floor(n * 0.9::DOUBLE) THEN 'val' ELSE 'test' END AS split
FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY {HASH}) AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM events)
""")
def split_in_group(spark: SparkSession, d: str) -> DataFrame:
    return K.split_in_group(events(spark, d), "user_id", "event_id").select("event_id", "split")


@query("""
WITH RECURSIVE s AS (SELECT g, c, n, sum(n) OVER (PARTITION BY g) AS total, row_number() OVER (PARTITION BY g ORDER BY md5(c || '42'), c) AS i
  FROM (SELECT l_suppkey AS g, p_type AS c, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_type <> '' GROUP BY 1, 2)),
r AS (
  SELECT g, 0::BIGINT AS i, NULL::VARCHAR AS c, 0::BIGINT AS n, '' AS split, 0::BIGINT AS train, 0::BIGINT AS val FROM s WHERE i = 1
  UNION ALL
  SELECT g, i, c, n, split, train + CASE WHEN split = 'train' THEN n ELSE 0 END, val + CASE WHEN split = 'val' THEN n ELSE 0 END
  FROM (SELECT s.*, r.train, r.val, CASE WHEN r.train + s.n < 0.8::DOUBLE * s.total THEN 'train' WHEN r.val + s.n < 0.1::DOUBLE * s.total THEN 'val' ELSE 'test' END AS split FROM r JOIN s ON s.g = r.g AND s.i = r.i + 1)
)
SELECT g AS l_suppkey, c AS p_type, n, split FROM r WHERE i > 0
""")
def split_in_group_disjoint(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    return K.split_in_group_disjoint(table(spark, d, "lineitem").select("l_suppkey", "l_partkey").join(part, "l_partkey"), "l_suppkey", "p_type")


@query("""
SELECT p_type AS k, count(DISTINCT l_suppkey % 3) AS splits FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 49 GROUP BY 1 HAVING count(DISTINCT l_suppkey % 3) > 1
""")
def split_overlap_check(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("k"))
    rows = table(spark, d, "lineitem").filter("l_quantity > 49").join(part, "l_partkey").selectExpr("k", "l_suppkey % 3 AS split")
    return K.overlap(rows, "k")


PAIRS = "SELECT l_suppkey AS g, p_type AS c, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_type <> '' GROUP BY 1, 2"


@query(PAIRS)
def pair_counts(spark: SparkSession, d: str) -> DataFrame:
    return pairs(spark, d)


@query("""
WITH p AS (SELECT o_custkey AS g, floor(o_totalprice)::BIGINT AS c, count(*) AS n FROM orders GROUP BY 1, 2), k AS (SELECT c, count(*) AS k FROM p GROUP BY 1)
SELECT g, sum(n)::BIGINT AS private FROM p JOIN k USING (c) WHERE k = 1 GROUP BY 1
""")
def private_mass(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_custkey", F.floor("o_totalprice").cast("string").alias("c"))
    return K.private_mass(K.pair_counts(rows, "o_custkey", "c"))


@query(f"""
WITH p AS ({PAIRS}), k AS (SELECT c, count(*) AS k FROM p GROUP BY 1)
SELECT a.g AS g1, b.g AS g2, round(sum(least(a.n, b.n) / k.k), 6) AS weight FROM p a JOIN p b ON a.c = b.c AND a.g < b.g JOIN k ON k.c = a.c GROUP BY 1, 2
""")
def conflict_pairs(spark: SparkSession, d: str) -> DataFrame:
    weight = F.floor(F.col("weight") * 1e6 + 0.5) / 1e6  # as ``rounded`` of a positive number, at a tenth of its time
    return K.conflict_pairs(pairs(spark, d)).withColumn("weight", weight)


CONFLICTS = f"""
p AS ({PAIRS}), k AS (SELECT c, count(*) AS k FROM p GROUP BY 1),
w AS (SELECT a.g AS g1, b.g AS g2, sum(least(a.n, b.n) / k.k) AS weight FROM p a JOIN p b ON a.c = b.c AND a.g <> b.g JOIN k ON k.c = a.c GROUP BY 1, 2)
"""


@query(f"WITH {CONFLICTS} SELECT g1 AS g, round(sum(weight), 6) AS degree FROM w GROUP BY 1")
def conflict_degree(spark: SparkSession, d: str) -> DataFrame:
    return rounded(K.conflict_degree(pairs(spark, d)), "degree")


@query(f"""
WITH {CONFLICTS} SELECT p.g, sum(n)::BIGINT AS size, coalesce(sum(n) FILTER (WHERE k = 1), 0)::BIGINT AS private, round(coalesce(any_value(degree), 0), 6) AS degree
FROM p JOIN k USING (c) LEFT JOIN (SELECT g1 AS g, sum(weight) AS degree FROM w GROUP BY 1) USING (g) GROUP BY 1
""")
def group_problem(spark: SparkSession, d: str) -> DataFrame:
    return rounded(K.group_problem(pairs(spark, d)), "degree")


@query(f"""
SELECT sum(n)::BIGINT AS total_rows, count(DISTINCT g) AS n_groups, count(DISTINCT c) AS n_categories, sum(n) * 0.8::DOUBLE AS target_train, sum(n) * 0.1::DOUBLE AS target_val, sum(n) * 0.1::DOUBLE AS target_test, greatest(1, least(1000, ceil(sum(n) * 0.1::DOUBLE)))::BIGINT AS min_rows,
  greatest(1, least(5, ceil(count(DISTINCT g) * 0.1::DOUBLE)))::BIGINT AS min_groups FROM ({PAIRS})
""")
def split_problem(spark: SparkSession, d: str) -> DataFrame:
    return K.split_problem(pairs(spark, d))


RESTARTS, SEED = 25, 42
_NAMES3 = range(3)


def assignments_sql(pairs_sql: str) -> str:
    """Every group placed one after the other, a step of the recursion each, all restarts at once; (restart, g, split)."""
    chance = lambda d, k: f"(('0x' || substr({d}, 1, 13))::BIGINT / 4503599627370496.0::DOUBLE * {k} * ({k} + 1) / 2)"
    place = lambda n, d: f"coalesce(list_filter(range({n}), lambda i: (i + 1) * {n} - i * (i + 1) / 2 > {chance(d, n)})[1], {n} - 1) + 1"
    pool = "least(5, len(top))"
    of = lambda x: "[" + ", ".join(f"coalesce(sum({x}) FILTER (WHERE a.split = {s}), 0)" for s in _NAMES3) + "]"
    keeps, clash, candidates = [], [], []
    for s in _NAMES3:
        o, q = (k for k in _NAMES3 if k != s)
        most, total = f"greatest(h[{o + 1}], h[{q + 1}])", f"(h[{s + 1}] + n)"
        rival = f"greatest(CASE WHEN h[{o + 1}] >= {total} THEN need[{o + 1}] END, CASE WHEN h[{q + 1}] >= {total} THEN need[{q + 1}] END)"
        keeps.append(f"any_value(size) - coalesce(sum(CASE WHEN {most} = 0 OR {total} > {most} THEN 0 WHEN {total} = {most} THEN CASE WHEN need[{s + 1}] >= {rival} THEN 0 ELSE n * 0.5::DOUBLE END ELSE n END), 0)::DOUBLE")
        clash.append(f"round(coalesce(sum((x[{o + 1}] + x[{q + 1}])::DOUBLE / k), 0), 9)")
        after = lambda k, s=s: f"(loads[{k + 1}] + {'size' if k == s else '0'})"
        then = lambda k, s=s: f"(members[{k + 1}] + {int(k == s)})"
        unmet = lambda over, s=s, after=after, then=then: (" + ".join(f"greatest(0, min_rows - {after(k)})" for k in over), " + ".join(f"greatest(0, min_groups - {then(k)})" for k in over))
        few, all_ = unmet((1, 2)), unmet(_NAMES3)
        other = 3 - s
        order = f"CASE WHEN few THEN {'0' if s == 0 else f'CASE WHEN lack{other} AND (short{other} > short{s} OR short{other} = short{s} AND {other} < {s}) THEN 1 ELSE 0 END'} ELSE {s} END"
        balance = " + ".join(f"abs({after(k)} - targets[{k + 1}])" for k in _NAMES3)
        candidates.append(
            f"CASE WHEN {'NOT few' if s == 0 else f'(NOT few OR lack{s})'} THEN {{'u': CASE WHEN few THEN {few[0]} ELSE {all_[0]} END, 'v': CASE WHEN few THEN {few[1]} ELSE {all_[1]} END, 'c': clash[{s + 1}], 'k': -keeps[{s + 1}], 'b': {balance}, 'd': -need[{s + 1}], 'o': {order}, 's': {s}}} END"
        )
    lacking = ", ".join(f"greatest(0, min_rows - loads[{s + 1}]) + greatest(0, min_groups - members[{s + 1}]) > 0 AS lack{s}, {{'r': greatest(0, min_rows - loads[{s + 1}]), 'm': greatest(0, min_groups - members[{s + 1}])}} AS short{s}" for s in (1, 2))
    seed = lambda split, before: f"""
s{split} AS MATERIALIZED (SELECT restart, top[{place(pool, f"md5(restart || '|{split}|{SEED}')")}] AS g FROM (
  SELECT restart, list(g ORDER BY clash, private DESC, size DESC, degree, g)[1:5] AS top FROM (
    SELECT r.restart, i.*, round(coalesce((SELECT sum(weight) FROM w WHERE w.g1 = i.g AND (w.g2 = {" OR w.g2 = ".join(f"s{b}.g" for b in before)})), 0), 9) AS clash
    FROM rs r {" ".join(f"JOIN s{b} ON s{b}.restart = r.restart" for b in before)}, info i WHERE i.g NOT IN ({", ".join(f"s{b}.g" for b in before)})) GROUP BY restart))"""  # noqa: E731
    return f"""
WITH RECURSIVE p AS MATERIALIZED ({pairs_sql}), k AS (SELECT c, count(*) AS k FROM p GROUP BY 1), own AS MATERIALIZED (SELECT g, c, n, k FROM p JOIN k USING (c)),
shared AS MATERIALIZED (SELECT g, c, n, k, gs FROM own JOIN (SELECT c, list(g) AS gs FROM own WHERE k > 1 GROUP BY 1) USING (c)),
w AS MATERIALIZED (SELECT a.g AS g1, b.g AS g2, sum(least(a.n, b.n) / a.k) AS weight FROM own a JOIN own b ON a.c = b.c AND a.g <> b.g GROUP BY 1, 2),
info AS MATERIALIZED (SELECT g, sum(n)::BIGINT AS size, coalesce(sum(n) FILTER (WHERE k = 1), 0)::BIGINT AS private, round(coalesce(any_value(degree), 0), 3) AS degree FROM own LEFT JOIN (SELECT g1 AS g, sum(weight) AS degree FROM w GROUP BY 1) USING (g) GROUP BY 1),
t AS (SELECT sum(size) AS total, greatest(1, least(1000, ceil(sum(size) * 0.1::DOUBLE)))::BIGINT AS min_rows, greatest(1, least(5, ceil(count(*) * 0.1::DOUBLE)))::BIGINT AS min_groups, [sum(size) * 0.8::DOUBLE, sum(size) * 0.1::DOUBLE, sum(size) * 0.1::DOUBLE] AS targets FROM info),
rs AS (SELECT unnest(range({RESTARTS}))::INTEGER AS restart),
s0 AS MATERIALIZED (SELECT restart, top[{place(pool, f"md5(restart || '|0|{SEED}')")}] AS g FROM rs, (SELECT list(g ORDER BY size DESC, degree, private DESC, g)[1:5] AS top FROM info)),
{seed(1, (0,))}, {seed(2, (0, 1))},
seeds AS (SELECT restart, 0 AS split, g FROM s0 UNION ALL SELECT restart, 1, g FROM s1 UNION ALL SELECT restart, 2, g FROM s2),
places AS (SELECT *, (row_number() OVER (ORDER BY private DESC, size DESC, degree, md5(g || '|{SEED}'), g) - 1) // 8 AS win FROM info),
queue AS MATERIALIZED (SELECT restart, g, size, digest, row_number() OVER (PARTITION BY restart ORDER BY win, digest) AS step FROM (SELECT restart, places.*, md5(restart || '|' || g || '|{SEED}') AS digest FROM rs, places) q
  WHERE NOT EXISTS (SELECT 1 FROM seeds z WHERE z.restart = q.restart AND z.g = q.g)),
rec AS (
  SELECT restart, 0::BIGINT AS step, list(size ORDER BY split) AS loads, [1, 1, 1]::BIGINT[] AS members, list({{'g': g, 'split': split}} ORDER BY split) AS held FROM seeds JOIN info USING (g) GROUP BY restart
  UNION ALL
  SELECT restart, step, [loads[1] + CASE WHEN s = 0 THEN size ELSE 0 END, loads[2] + CASE WHEN s = 1 THEN size ELSE 0 END, loads[3] + CASE WHEN s = 2 THEN size ELSE 0 END],
    [members[1] + (s = 0)::BIGINT, members[2] + (s = 1)::BIGINT, members[3] + (s = 2)::BIGINT], list_append(held, {{'g': g, 'split': s}})
  FROM (SELECT *, ranked[CASE WHEN len(ranked) = 1 THEN 1 WHEN {chance("digest", 2)} < 2 THEN 1 ELSE 2 END].s AS s FROM (
    SELECT *, list_sort(list_filter([{", ".join(candidates)}], lambda z: z IS NOT NULL)) AS ranked FROM (
      SELECT *, lack1 OR lack2 AS few FROM (SELECT *, {lacking} FROM (
        SELECT restart, any_value(step) + 1 AS step, any_value(loads) AS loads, any_value(members) AS members, any_value(held) AS held, any_value(g) AS g, any_value(size) AS size, any_value(digest) AS digest, any_value(need) AS need,
          any_value(min_rows) AS min_rows, any_value(min_groups) AS min_groups, any_value(targets) AS targets, [{", ".join(clash)}] AS clash, [{", ".join(keeps)}] AS keeps
        FROM (SELECT st.restart, o.c, any_value(st.step) AS step, any_value(st.loads) AS loads, any_value(st.members) AS members, any_value(st.held) AS held, any_value(q.g) AS g, any_value(q.size) AS size, any_value(q.digest) AS digest, any_value(o.n) AS n, any_value(o.k) AS k,
            any_value([t.targets[1] - st.loads[1], t.targets[2] - st.loads[2], t.targets[3] - st.loads[3]]) AS need, any_value(t.min_rows) AS min_rows, any_value(t.min_groups) AS min_groups, any_value(t.targets) AS targets,
            {of("pl.n")} AS h, {of("least(o.n, pl.n)")} AS x
          FROM rec st JOIN queue q ON q.restart = st.restart AND q.step = st.step + 1 LEFT JOIN shared o ON o.g = q.g, t, unnest(list_append(list_filter(st.held, lambda y: list_contains(o.gs, y.g)), NULL)) AS u(a) LEFT JOIN p pl ON pl.g = a.g AND pl.c = o.c GROUP BY st.restart, o.c) GROUP BY restart))))))
SELECT restart, a.g AS g, a.split AS split FROM (SELECT restart, unnest(held) AS a FROM (SELECT restart, arg_max(held, step) AS held FROM rec GROUP BY restart))
"""


@query(assignments_sql(PAIRS))
def restart_assignments(spark: SparkSession, d: str) -> DataFrame:
    p = pairs(spark, d)
    return K.restart_assignments(p, K.split_problem(p), RESTARTS, SEED)


def evaluation_sql(pairs_sql: str, assignment: str) -> str:
    """What is kept and how restarts score, after a given assignment of groups."""
    return f"""
WITH p AS ({pairs_sql}), t AS (SELECT sum(n)::BIGINT AS total, greatest(1, least(1000, ceil(sum(n) * 0.1::DOUBLE))) AS min_rows, greatest(1, least(5, ceil(count(DISTINCT g) * 0.1::DOUBLE))) AS min_groups FROM p),
a AS MATERIALIZED ({assignment}),
x AS (SELECT a.restart, a.split, p.* FROM p JOIN a USING (g)),
l AS (SELECT restart, split, sum(n) AS load FROM x GROUP BY 1, 2),
pr AS (SELECT restart, split, 2.0::DOUBLE * greatest(0, min_rows - load) + greatest(0, [0.8, 0.1, 0.1][split + 1]::DOUBLE * total - load) AS priority FROM l, t),
cs AS (SELECT restart, c, split, sum(n)::BIGINT AS n FROM x GROUP BY 1, 2, 3),
o AS (SELECT restart, c, split AS owner FROM (SELECT *, row_number() OVER (PARTITION BY restart, c ORDER BY n DESC, priority DESC, split) AS k FROM cs JOIN pr USING (restart, split)) WHERE k = 1),
wide AS (SELECT restart, c, coalesce(sum(n) FILTER (WHERE split = 0), 0)::BIGINT AS n0, coalesce(sum(n) FILTER (WHERE split = 1), 0)::BIGINT AS n1, coalesce(sum(n) FILTER (WHERE split = 2), 0)::BIGINT AS n2 FROM cs GROUP BY 1, 2),
bg AS (SELECT restart, split, g, sum(n) AS n, sum(CASE WHEN split = owner THEN n ELSE 0 END) AS kept FROM x JOIN o USING (restart, c) GROUP BY 1, 2, 3),
sz AS (SELECT restart, split, sum(kept)::BIGINT AS retained, count(*) FILTER (WHERE kept > 0) AS groups, count(*) FILTER (WHERE kept = 0) AS dropped_groups FROM bg GROUP BY 1, 2),
rl AS (SELECT *, (row_number() OVER (PARTITION BY restart ORDER BY retained DESC, split) - 1)::INTEGER AS new_split FROM sz),
sc AS (SELECT restart, count(*) FILTER (WHERE retained >= min_rows AND groups >= min_groups) AS valid_splits,
  coalesce(max(retained) FILTER (WHERE new_split = 0), 0) >= 0.5 * sum(retained) AS train_ok, sum(greatest(0, min_rows - retained))::BIGINT AS rows_short, sum(greatest(0, min_groups - groups))::BIGINT AS groups_short,
  coalesce(max(retained) FILTER (WHERE new_split = 0), 0) AS train, coalesce(max(retained) FILTER (WHERE new_split = 1), 0) AS val, coalesce(max(retained) FILTER (WHERE new_split = 2), 0) AS test,
  sum(retained)::BIGINT AS retained, round(sum(abs(retained - [0.8, 0.1, 0.1][new_split + 1]::DOUBLE * total)), 6) AS imbalance, sum(dropped_groups)::BIGINT AS dropped_groups FROM rl, t GROUP BY 1)
"""


EVAL = evaluation_sql(PAIRS, "SELECT r.restart, g, ((g // (r.restart + 1)) % 3)::INTEGER AS split FROM (SELECT DISTINCT g FROM p), (SELECT unnest([0, 1, 2])::INTEGER AS restart) r")
BEST = "ORDER BY valid_splits DESC, train_ok DESC, rows_short, groups_short, train DESC, val DESC, test DESC, retained DESC, imbalance, dropped_groups, restart LIMIT 1"


def evaluated(spark: SparkSession, d: str):
    p = pairs(spark, d)
    a, problem = restarts(p), K.split_problem(p)
    owners = K.owner_splits(p, a, problem)
    return p, a, problem, owners, K.evaluate_restarts(p, a, owners, problem)


@query(EVAL + "SELECT restart, c, owner, n0, n1, n2 FROM o JOIN wide USING (restart, c)")
def owner_split(spark: SparkSession, d: str) -> DataFrame:
    return evaluated(spark, d)[3]


@query(EVAL + "SELECT restart, split, retained, groups, dropped_groups, new_split FROM rl")
def relabel_splits(spark: SparkSession, d: str) -> DataFrame:
    return evaluated(spark, d)[4]


@query(EVAL + f"SELECT * FROM sc {BEST}")
def best_restart(spark: SparkSession, d: str) -> DataFrame:
    _, _, problem, _, sizes = evaluated(spark, d)
    return rounded(K.best_restart(K.score_restarts(sizes, problem)), "imbalance")


@query(EVAL + """
, pc AS (SELECT c, count(*) AS k FROM p GROUP BY 1), pm AS (SELECT g, sum(n)::BIGINT AS private FROM p JOIN pc USING (c) WHERE k = 1 GROUP BY 1)
SELECT bg.restart, bg.g, ['train', 'val', 'test'][bg.split + 1] AS original_split, ['train', 'val', 'test'][new_split + 1] AS final_split, bg.n::BIGINT AS original_count, coalesce(private, 0) AS private_count,
  kept::BIGINT AS retained_count, (bg.n - kept)::BIGINT AS removed_count, kept / bg.n AS retained_fraction, bg.split <> new_split AS moved, kept = 0 AS dropped FROM bg JOIN rl USING (restart, split) LEFT JOIN pm USING (g)
""")
def group_assignment_report(spark: SparkSession, d: str) -> DataFrame:
    p, a, _, owners, sizes = evaluated(spark, d)
    return K.group_report(p, a, owners, sizes)


@query(EVAL + """
, m AS (SELECT restart, map_from_entries(list((split, new_split))) AS m FROM rl GROUP BY 1)
SELECT o.restart, o.c, ['train', 'val', 'test'][m[owner] + 1] AS owner_split,
  (CASE WHEN m[0] = 0 THEN n0 ELSE 0 END + CASE WHEN m[1] = 0 THEN n1 ELSE 0 END + CASE WHEN m[2] = 0 THEN n2 ELSE 0 END) AS train_count,
  (CASE WHEN m[0] = 1 THEN n0 ELSE 0 END + CASE WHEN m[1] = 1 THEN n1 ELSE 0 END + CASE WHEN m[2] = 1 THEN n2 ELSE 0 END) AS val_count,
  (CASE WHEN m[0] = 2 THEN n0 ELSE 0 END + CASE WHEN m[1] = 2 THEN n1 ELSE 0 END + CASE WHEN m[2] = 2 THEN n2 ELSE 0 END) AS test_count,
  n0 + n1 + n2 - [n0, n1, n2][owner + 1] AS removed_total FROM o JOIN wide USING (restart, c) JOIN m USING (restart)
""")
def category_pruning_report(spark: SparkSession, d: str) -> DataFrame:
    _, _, _, owners, sizes = evaluated(spark, d)
    return K.category_report(owners, sizes)


LEVELS = "SELECT o_custkey AS g, floor(o_totalprice)::BIGINT AS c, count(*) AS n FROM orders GROUP BY 1, 2"


@query(evaluation_sql(LEVELS, assignments_sql(LEVELS)) + f"""
, best AS (SELECT restart FROM sc {BEST})
SELECT o_orderkey, o_custkey, (floor(o_totalprice)::BIGINT)::VARCHAR AS level, ['train', 'val', 'test'][rl.new_split + 1] AS split
FROM best JOIN a ON a.restart = best.restart JOIN orders ON o_custkey = a.g JOIN o ON o.restart = a.restart AND o.c = floor(o_totalprice)::BIGINT AND o.owner = a.split JOIN rl ON rl.restart = a.restart AND rl.split = a.split
""")
def two_key_split(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each split that is disjoint on customers and on price levels at once."""
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.floor("o_totalprice").cast("string").alias("level"))
    return K.two_key_split(rows, "o_custkey", "level", restarts=RESTARTS)[0]
