"""Small literal cases, one per trap, and invariants."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortry.functions import scalar as S
from cohortry.operators import clean as C
from cohortry.operators import distribution as D
from cohortry.operators import entity as E
from cohortry.operators import evaluate as V
from cohortry.operators import features as X
from cohortry.operators import reports as R
from cohortry.operators import splits as K
from cohortry.sources import tables as T


def values(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_rounding_half_even(spark):
    df = spark.createDataFrame([(1.005,), (2.675,), (0.125,)], "x double")
    assert [r[0] for r in df.select(S.round_even(F.col("x"), 2)).collect()] == [1.0, 2.68, 0.12]


def test_pad_key_keeps_long_ids(spark):
    df = spark.createDataFrame([(7,), (392,), (12345,)], "x int")
    assert [r[0] for r in df.select(S.pad_key(F.col("x"))).collect()] == ["0007", "0392", "12345"]


def test_dead_time_only_where_zero(spark):
    df = spark.createDataFrame([(0.0,), (None,), (1.2,)], "t0 double")
    got = [r[0] for r in df.select(S.dead_time(F.col("t0"), F.lit(2.1), F.lit(100.0), F.lit(0.4))).collect()]
    assert got == [round(0.66 * math.pi * 1.05**2 * 100 / 10 / 0.4 / 100, 5), None, 1.2]


def test_duration(spark):
    df = spark.createDataFrame([("0 days 02:35:07",), ("1 days 00:00:01.5",), ("bad",), (None,)], "x string")
    assert [r[0] for r in df.select(S.duration_seconds(F.col("x"))).collect()] == [9307.0, 86401.5, None, None]


def test_units(spark):
    df = spark.createDataFrame([(10.0, "mM"), (10.0, "µM"), (10.0, "%"), (10.0, None)], "v double, u string")
    got = [r[0] for r in df.select(S.to_percent(F.col("v"), F.col("u"), 60)).collect()]
    assert got == pytest.approx([0.06, 0.00006, 10.0, 10.0])


REPLICATES = [
    (1, "a", 10.0), (1, "a", 12.4), (1, "b", 50.0), (1, "b", 52.5), (1, "c", 90.0), (1, "c", 91.0), (1, "c", 97.0), (1, "d", 100.0), (1, None, 1.0), (1, None, 2.0), (2, "a", 5.0),
]


def test_reconcile(spark):
    df = spark.createDataFrame(REPLICATES, "g int, e string, y double")
    kept = values(E.reconcile(df, "g", "e", "y"), "g", "e")
    # A range equal to the limit (2.5 of 100) stays; c is over it; null entities vanish.
    assert kept == [(1, "a", pytest.approx(11.2), 2), (1, "b", 51.25, 2), (1, "d", 100.0, 1), (2, "a", 5.0, 1)]
    s = E.reconcile_summary(df, "g", "e", "y").first()
    assert (s.total_rows, s.replicate_rows, s.sets_kept, s.sets_dropped, s.rows_dropped, s.rows_remaining) == (9, 7, 2, 1, 3, 4)


def test_reconcile_empty(spark):
    df = spark.createDataFrame([], "g int, e string, y double")
    assert E.reconcile(df, "g", "e", "y").collect() == []
    assert E.reconcile_summary(df, "g", "e", "y").first().total_rows == 0


def test_status_at_equality(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, 2.0, 2.0), (3, 3.0, 2.0), (4, None, 2.0), (5, 1.0, None)], "i int, x double, c double")
    got = [r.status for r in D.classify_simple(df, "x", "c").orderBy("i").collect()]
    assert got == ["non_retained", "retained", "retained", "non_retained", "uncertain"]
    found = spark.createDataFrame([("g", 1.5, 2.0, "high")], "g string, t0 double, cutoff double, confidence string")
    rows = df.select("i", "x", F.lit("g").alias("k"))
    got = [r.status for r in D.classify(rows, found, "k", "x").orderBy("i").collect()]
    assert got == ["putatively_non_retained", "putatively_non_retained", "retained", "uncertain", "putatively_non_retained"]


def test_any_nonzero(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 0.7), (3, 1.0), (4, -0.7), (5, None)], "i int, `eluent.C` double")
    assert [r.i for r in C.drop_any_nonzero(df, ["eluent.C"]).orderBy("i").collect()] == [1, 2, 4, 5]


def test_segments(spark):
    df = spark.createDataFrame([(s, float(i)) for s in (2, 3, 11, 12, 13) for i in range(s)], "src int, t double")
    segs, counts = C.segments(df, "src", ["t"], [], 3), C.segment_counts(df, "src")
    assert [r.src for r in C.segment_upper(counts).orderBy("src").collect()] == [2, 3, 11]
    assert [r.src for r in C.segment_lower(counts).orderBy("src").collect()] == [3, 11, 12, 13]
    wide = X.pivot_segments(segs, "src", ["t"], 3).orderBy("src").first()
    assert tuple(wide) == (2, 0.0, 1.0, None)


def test_overlay(spark):
    left = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "k int, s string, x double")
    right = spark.createDataFrame([(1, None, 9.0), (3, "z", 3.0)], "k int, s string, x double")
    assert values(C.overlay(left, right, "k", ["s", "x"]), "k") == [(1, "a", 9.0), (2, "b", 2.0)]


def test_partition_threshold_always_reports(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", None), ("b", 0.0)], "k string, s double")
    kept, report = C.partition_threshold(df, "k", "a", "s", 1.0)
    assert kept.count() == 3 and tuple(report.first()) == (3, 1)
    assert tuple(C.partition_threshold(df, "k", "none", "s", 1.0)[1].first()) == (4, 0)


def test_one_hot_null_has_its_column(spark):
    df = C.one_hot(spark.createDataFrame([("b",), (None,), ("a",)], "u string"), "u")
    assert df.columns == ["u", "u_a", "u_b", "u_nan"]
    assert [tuple(r)[1:] for r in df.collect()] == [(0, 1, 0), (0, 0, 1), (1, 0, 0)]


def test_prune_and_null_columns(spark):
    df = spark.createDataFrame([(1, None, "mM", 2)], "k int, `e.x` double, `e.x.unit` string, `gradient.t` int")
    assert C.prune_columns(df, [r"\.unit$", r"^gradient\."]).columns == ["k", "e.x"]
    assert C.null_columns(df, "k", ["e.x", "gradient.t"]).first().missing == "e.x"


def test_entity_merge_and_remap(spark):
    df = spark.createDataFrame([(1, "x", None), (2, "y", 1), (3, "x", None), (4, "z", 0)], "k int, a string, b int")
    groups = E.merge_conditions(df, "k", ["a", "b"])
    members = E.group_members(df, "k", ["a", "b"], groups)
    assert values(E.entity_merge(df, "k", ["a", "b"]), "group_id") == [("cc_1", [1, 3], 2), ("cc_2", [2], 1), ("cc_3", [4], 1)]
    assert [(r.group_id, r.k) for r in E.remap_key(df, members, "k").orderBy("k").collect()] == [("cc_1", 1), ("cc_2", 2), ("cc_3", 4)]


def sized(spark, sizes):
    return spark.createDataFrame([(i, g) for g, n in sizes.items() for i in range(n)], "i int, g string")


def test_greedy_folds(spark):
    df = sized(spark, dict(zip("abcde", (7, 5, 5, 3, 2), strict=True)))
    assert [r.fold for r in K.kfold_groups(df, "g", 3).orderBy("g").collect()] == [0, 1, 2, 1, 2]


def test_first_fit_skips_what_does_not_fit(spark):
    sizes = dict(zip("abcde", (70, 15, 9, 5, 1), strict=True))
    order = sorted(sizes, key=lambda g: __import__("hashlib").md5(f"{g}42".encode()).hexdigest())
    train = val = 0
    want = {}
    for g in order:
        n = sizes[g]
        want[g] = "train" if train + n < 80 else "val" if val + n < 10 else "test"
        train, val = train + n * (want[g] == "train"), val + n * (want[g] == "val")
    assert {r.g: r.split for r in K.split_groups(sized(spark, sizes), "g").collect()} == want


def test_whole_groups_beyond_one_array(spark):
    import hashlib
    import random

    rng = random.Random(3)
    for k, n_groups, big in ((2, 300, 900), (5, 2000, 3000), (7, 400, 1)):
        sizes = {f"{i:05}": rng.choice((1, 1, 1, 2, 3, 5, 8, rng.randint(1, 60))) for i in range(n_groups)} | {f"{n_groups:05}": big}
        loads, want = [0] * k, {}
        for g in sorted(sizes, key=lambda g: (-sizes[g], g)):
            want[g] = loads.index(min(loads))
            loads[want[g]] += sizes[g]
        df = sized(spark, sizes)
        assert {r.g: r.fold for r in K.kfold_groups(df, "g", k).collect()} == want
        train = val = 0
        fit, total = {}, sum(sizes.values())
        for g in sorted(sizes, key=lambda g: hashlib.md5(f"{g}42".encode()).hexdigest()):
            n = sizes[g]
            fit[g] = "train" if train + n < 0.8 * total else "val" if val + n < 0.1 * total else "test"
            train, val = train + n * (fit[g] == "train"), val + n * (fit[g] == "val")
        for per_task in (20, K.PER_TASK):
            assert {r.g: r.split for r in K.split_groups(df, "g", per_task=per_task).collect()} == fit
    many = spark.range(130_001).selectExpr("id div 2 * 2 AS g")
    many = many.union(spark.range(100_000).selectExpr("id * 2 + 1 AS g"))  # over 100,000 groups, sizes 1 and 2
    folds = {r.fold: r.n for r in K.kfold_groups(many.union(spark.range(70_000).selectExpr("1L AS g")), "g", 3).groupBy("fold").agg(F.sum("n").alias("n")).collect()}
    assert max(folds.values()) - min(folds.values()) <= 2 and sum(folds.values()) == 300_001
    parts = {r.split: r.n for r in K.split_groups(many, "g").groupBy("split").agg(F.sum("n").alias("n")).collect()}
    assert sum(parts.values()) == 230_001 and 0 <= 0.8 * 230_001 - parts["train"] <= 2 and 0 <= 0.1 * 230_001 - parts["val"] <= 2


def test_disjoint_split_within_a_hot_group(spark):
    """A group of many categories is filled by running sums, a null group and small ones in a task each; both as plain loops do."""
    import hashlib

    rng = random.Random(9)
    sizes = {("hot", f"c{i}"): rng.choice((1, 1, 2, 3, rng.randint(1, 200))) for i in range(700)} | {(g, f"c{i}"): rng.randint(1, 9) for g in ("a", None) for i in range(12)} | {("one", "c1"): 5}
    df = spark.createDataFrame([(g, c) for (g, c), n in sizes.items() for _ in range(n)] + [("a", ""), ("a", None)], "g string, c string")
    want = {}
    for group in ("hot", "a", None, "one"):
        own = {c: n for (g, c), n in sizes.items() if g == group}
        total, train, val = sum(own.values()), 0, 0
        for c in sorted(own, key=lambda c: hashlib.md5(f"{c}42".encode()).hexdigest()):
            n = own[c]
            want[group, c] = "train" if train + n < 0.8 * total else "val" if val + n < 0.1 * total else "test"
            train, val = train + n * (want[group, c] == "train"), val + n * (want[group, c] == "val")
    for per_task in (50, K.PER_TASK):
        got = K.split_in_group_disjoint(df, "g", "c", per_task=per_task).collect()
        assert {(r.g, r.c): r.split for r in got} == want and {(r.g, r.c): r.n for r in got} == sizes


def test_kfold_sizes(spark):
    df = sized(spark, {"a": 23, "b": 3})
    folds = {(r.g, r.fold): r.n for r in K.kfold_stratified(df, "g", "i").groupBy("g", "fold").agg(F.count("*").alias("n")).collect()}
    assert [folds.get(("a", k)) for k in range(10)] == [3, 3, 3] + [2] * 7
    assert [folds.get(("b", k)) for k in range(10)] == [1, 1, 1] + [None] * 7


def test_conflicts_and_private_mass(spark):
    p = spark.createDataFrame([(1, "only", 4), (1, "two", 2), (2, "two", 6), (1, "all", 3), (2, "all", 1), (3, "all", 9)], "g int, c string, n bigint")
    assert values(K.private_mass(p), "g") == [(1, 4)]
    got = values(K.conflict_pairs(p), "g1", "g2")
    assert [(a, b) for a, b, _ in got] == [(1, 2), (1, 3), (2, 3)]
    assert [w for *_, w in got] == pytest.approx([1 + 1 / 3, 1.0, 1 / 3])
    assert [r.degree for r in K.conflict_degree(p).orderBy("g").collect()] == pytest.approx([2 + 1 / 3, 1 + 2 / 3, 1 + 1 / 3])
    assert [tuple(r)[:3] for r in K.group_problem(p).orderBy("g").collect()] == [(1, 9, 4), (2, 7, 0), (3, 9, 0)]


def test_conflict_pairs_in_blocks_or_by_category(spark):
    rng = random.Random(3)
    rows = {(f"g{rng.randrange(90):02}", c): rng.randrange(1, 9) for c in range(40) for _ in range(2 if c < 20 else 70)}
    p = spark.createDataFrame([(g, str(c), n) for (g, c), n in rows.items()], "g string, c string, n bigint")
    sharing = {c: sum(d == c for _, d in rows) for _, c in rows}
    want = {}
    for (g, c), n in rows.items():
        for h in {h for h, d in rows if d == c and g < h}:
            want[g, h] = want.get((g, h), 0) + min(n, rows[h, c]) / sharing[c]
    for crowded, cells in ((0.0, 300), (0.3, 300), (2.0, 300)):  # all in blocks, some, none
        got = values(K.conflict_pairs(p, crowded, cells), "g1", "g2")
        assert [(a, b) for a, b, _ in got] == sorted(want)
        assert [w for *_, w in got] == pytest.approx([want[k] for k in sorted(want)])


def test_crowded_categories_make_no_row_a_category_and_pair(spark):
    p = spark.range(400).selectExpr("id AS g").crossJoin(spark.range(150).selectExpr("CAST(id AS string) AS c")).withColumn("n", F.lit(2).cast("long"))
    out = K.conflict_pairs(p)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString().split("FlatMapGroups")[0]  # groups don't meet by category
    assert out.count() == 400 * 399 // 2 and out.agg(F.max(F.abs(F.col("weight") - 0.75))).first()[0] < 1e-9


@pytest.mark.parametrize("groups", [2, 7, 40])
def test_conflict_pairs_of_few_categories_are_looked_up(spark, groups):
    rng = random.Random(groups)
    rows = {(f"g{g:02}", c): rng.randrange(1, 9) for g in range(groups) for c in range(3) if c == 0 or rng.random() < 0.5}
    p = spark.createDataFrame([(g, str(c), n) for (g, c), n in rows.items()] + [(None, "0", 5), (None, "1", 5)], "g string, c string, n bigint")
    sharing = {c: sum(d == c for _, d in rows) + (c < 2) for c in range(3)}  # as SQL counts them
    want = {}
    for (g, c), n in rows.items():
        for h in {h for h, d in rows if d == c and g < h}:
            want[g, h] = want.get((g, h), 0) + min(n, rows[h, c]) / sharing[c]
    out = K.conflict_pairs(p, 0.0)
    assert "FlatMapGroups" not in out._jdf.queryExecution().optimizedPlan().toString()  # no pair goes through Python
    got = values(out, "g1", "g2")
    assert [(a, b) for a, b, _ in got] == sorted(want)
    assert [w for *_, w in got] == pytest.approx([want[k] for k in sorted(want)])


def test_owner_ties(spark):
    p = spark.createDataFrame([(0, "a", 5), (1, "a", 5), (1, "b", 1)], "g int, c string, n bigint")
    a = spark.createDataFrame([(0, 0, 0), (0, 1, 1)], "restart int, g int, split int")
    own = {r.c: r.owner for r in K.owner_splits(p, a, K.split_problem(p)).collect()}
    # Equal counts: train is further under its target than val is under its needs.
    assert own == {"a": 0, "b": 1}


def test_two_key_split_is_disjoint(spark):
    random.seed(7)
    rows = [(i, random.randrange(60), f"c{random.randrange(40_000)}") for i in range(20_000)]
    df = spark.createDataFrame(rows, "i int, g int, c string")
    out, best = K.two_key_split(df, "g", "c", restarts=4)
    out = out.cache()
    assert K.overlap(out, "g").count() == 0 and K.overlap(out, "c").count() == 0
    n = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    assert n["train"] >= n["val"] >= n["test"] > 0 and best.count() == 1


def test_restarts_are_evaluated_as_one_by_one(spark):
    rng = random.Random(11)
    rows = [(rng.randrange(40), f"c{rng.randrange(90) if rng.random() < 0.7 else 1000 + i}") for i in range(700)]
    pairs = K.pair_counts(spark.createDataFrame(rows, "g int, c string"), "g", "c").cache()
    problem, restarts = K.split_problem(pairs), K.PACKED + 2
    assignment, shared, owners, sizes = K._evaluated(pairs, problem, restarts, 42)
    assert assignment.count() == 40 * restarts
    cats = shared.select("c", "cat").distinct()
    want = K.owner_splits(pairs, assignment, problem)
    got = owners.join(cats, "cat").select("restart", "c", "owner", "n0", "n1", "n2")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.join(cats.select("c"), "c").select(*got.columns).collect()))
    columns = ["restart", "split", "retained", "groups", "dropped_groups", "new_split"]
    assert sorted(map(tuple, sizes.select(*columns).collect())) == sorted(map(tuple, K.evaluate_restarts(pairs, assignment, want, problem).select(*columns).collect()))


def test_placed_groups_are_told_by_what_categories_hold():
    n = 2_000
    cells = np.array([np.arange(500), np.ones(500), np.full(500, n // 50), *np.zeros((3, 500))], np.int64)
    state = K._Placing(cells, [0] * 3, [0] * 3, [n * 8.0, n * 1.0, n * 1.0], 1000, 5)
    cats = np.concatenate([np.arange(10) * 50 + g % 50 for g in range(n)])
    splits = state.place(np.full(n, 10), np.random.default_rng(1).random(n), np.full(n, 10), cats, np.ones(10 * n, np.int64))
    assert state.members == [list(splits).count(s) for s in range(3)] and state.added().sum() == 10 * n


def slow_assignment(rows, restarts, seed, least_rows, least_groups):
    """The assignment of restart_assignments with plain loops over groups and categories."""
    import hashlib

    digest = lambda *x: hashlib.md5("|".join(map(str, x)).encode()).hexdigest()
    own, size, sharing = {}, {}, {}
    for g, c, n in rows:
        own.setdefault(g, {})[c] = n
        size[g] = size.get(g, 0) + n
        sharing[c] = sharing.get(c, 0) + 1
    weight = {(a, b): sum(min(n, own[b][c]) / sharing[c] for c, n in own[a].items() if c in own[b]) for a in own for b in own if a != b}
    degree = {a: round(sum(weight[a, b] for b in own if b != a), 3) for a in own}
    private = {g: sum(n for c, n in own[g].items() if sharing[c] == 1) for g in own}
    total = sum(size.values())
    targets = [0.8 * total, 0.1 * total, 0.1 * total]
    queue = sorted(own, key=lambda g: (-private[g], -size[g], degree[g], digest(g, seed), g))
    out = {}
    for r in range(restarts):
        ranked = sorted(own, key=lambda g: (-size[g], degree[g], -private[g], g))
        seeds = [ranked[K.pick(len(ranked), 5, digest(r, 0, seed))]]
        for s in (1, 2):
            ranked = sorted((g for g in own if g not in seeds), key=lambda g: (round(sum(weight[g, x] for x in seeds), 9), -private[g], -size[g], degree[g], g))
            seeds.append(ranked[K.pick(len(ranked), 5, digest(r, s, seed))])
        at = {g: s for s, g in enumerate(seeds)}
        loads = [sum(size[g] for g in at if at[g] == s) for s in range(3)]
        members = [sum(at[g] == s for g in at) for s in range(3)]
        for g in sorted((g for g in queue if g not in at), key=lambda g: (queue.index(g) // 8, digest(r, g, seed))):
            seen, needs = at, [t - x for t, x in zip(targets, loads, strict=True)]
            lack = lambda s: (max(0, least_rows - loads[s]), max(0, least_groups - members[s]))  # noqa: B023, E731
            few = sorted((s for s in (1, 2) if any(lack(s))), key=lambda s: (-lack(s)[0], -lack(s)[1], s))
            scored = []
            for s in few or (0, 1, 2):
                after = [x + size[g] * (k == s) for k, x in enumerate(loads)]
                then = [x + (k == s) for k, x in enumerate(members)]
                over = (1, 2) if few else (0, 1, 2)
                clash = sum(weight[g, x] for x in seen if seen[x] != s)
                keeps = 0.0
                for c, n in own[g].items():
                    h = [sum(own[x].get(c, 0) for x in seen if seen[x] == k) for k in range(3)]
                    others = [k for k in range(3) if k != s]
                    most = max(h[k] for k in others)
                    if most == 0 or h[s] + n > most:
                        keeps += n
                    elif h[s] + n == most:
                        keeps += n if needs[s] >= max(needs[k] for k in others if h[k] >= most) else n / 2
                unmet = sum(max(0, least_rows - after[k]) for k in over), sum(max(0, least_groups - then[k]) for k in over)
                scored.append((*unmet, round(clash, 9), -keeps, sum(abs(a - t) for a, t in zip(after, targets, strict=True)), loads[s] - targets[s], len(scored), s))
            s = sorted(scored)[K.pick(len(scored), 2, digest(r, g, seed))][-1]
            at[g], loads[s], members[s] = s, loads[s] + size[g], members[s] + 1
        out |= {(r, g): s for g, s in at.items()}
    return out


def test_assignment_equals_plain_loops(spark):
    rng = random.Random(11)
    rows = {(rng.randrange(45), f"c{int(rng.random() ** 2 * 120)}"): 0 for _ in range(700)}
    rows = [(g, c, rng.choice((1, 1, 2, 3, 8))) for g, c in rows] + [(g, f"own{g}", g % 4 + 1) for g in range(0, 45, 3)]
    p = spark.createDataFrame(rows, "g int, c string, n bigint")
    problem = K.split_problem(p, 60, 4)
    least = problem.first()
    want = slow_assignment(rows, 3, 5, least.min_rows, least.min_groups)
    for batch in (1, 60, K.BATCH):  # a window of eight groups, some, all
        assert {(r.restart, r.g): r.split for r in K.restart_assignments(p, problem, 3, seed=5, batch=batch).collect()} == want


def test_scaler(spark):
    df = spark.createDataFrame([(1, 2.0, 5.0), (1, 2.0, 5.0), (2, 4.0, 5.0)], "g int, x double, c double")
    s = X.fit_scaler(df, ["x", "c"], "g")
    assert tuple(s.first()) == (3.0, 5.0, 1.0, 1.0)  # a group counts once; a constant has deviation 1
    assert [r.x for r in X.apply_scaler(df, s, ["x", "c"]).orderBy("g").collect()] == [-1.0, -1.0, 1.0]


#: MAE, RMSE and rows of ten published folds.  Fixed values.
FOLDS = [
    (90.07341837598483, 99.87733822135746, 8899),
    (98.43429032796682, 136.6538887515831, 3175),
    (133.62221771211634, 227.60747411309868, 3201),
    (116.27830193239194, 205.3772504306024, 3188),
    (211.54690103822702, 350.01614077755573, 3194),
    (56.16526853791715, 107.38613231940626, 3201),
    (39.73253612931269, 71.52665806129231, 3174),
    (56.179579128971504, 95.65167278304256, 3192),
    (100.83771711717132, 225.92797866606088, 3201),
    (104.05199765474032, 141.27919956993534, 3202),
]


def test_weighted_metrics_of_published_folds(spark):
    df = spark.createDataFrame([(k, *f) for k, f in enumerate(FOLDS)], "fold int, mae double, rmse double, n bigint")
    got = {r.metric: (round(r["mean"], 4), round(r["std"], 4)) for r in V.weighted(df, ["mae", "rmse"], "n").collect()}
    assert got == {"mae": (99.1142, 42.7991), "rmse": (156.1541, 78.4917)}
    pooled = df.agg(F.sqrt(F.sum(F.col("n") * F.col("rmse") ** 2) / F.sum("n"))).first()[0]
    assert round(pooled, 4) == 174.7714  # the weighted mean of roots isn't the root of the pooled mean


def test_weighted_mean_and_std(spark):
    df = spark.createDataFrame([(0, 10.0, 1), (1, 20.0, 3)], "fold int, mae double, n bigint")
    r = V.weighted(df, ["mae"], "n").first()
    assert (r["mean"], r["std"]) == (17.5, pytest.approx(math.sqrt((56.25 + 3 * 6.25) / 4)))


def test_relative_errors_over_zero_are_null(spark):
    df = spark.createDataFrame([(0.0, 1.0, 0.0, 2.0)], "y double, p double, top double, mean double")
    r = V.row_errors(df, "y", "p", "top", "mean").first()
    assert (r["diff"], r.rel_error_max, r.rel_error_mean, r.mre) == (1.0, None, 50.0, None)


def test_waterfall(spark):
    t = spark.range(10)
    got = values(R.waterfall([("input", t), ("a", t.filter("id > 3")), ("b", t.filter("id > 8"))]), "position")
    assert got == [(1, "a", 4), (2, "b", 5), (3, "total", 9)]


# Distribution: an independent derivation in numpy.


def numpy_valley(x, grid):
    x = np.sort(x)
    y = np.log1p(x)
    h = len(y) ** -0.2 * y.std(ddof=1)
    gx = np.linspace(y[0], y[-1], grid)
    dens = np.exp(-0.5 * ((gx[:, None] - y[None, :]) / h) ** 2).sum(axis=1) / (len(y) * h * np.sqrt(2 * np.pi))
    inner = np.arange(1, grid - 1)
    peaks = [i for i in inner if dens[i] > dens[i - 1] and dens[i] > dens[i + 1]]
    peaks = [0] * int(dens[0] > dens[1]) + peaks + [grid - 1] * int(dens[-1] > dens[-2])
    valleys = [i for i in inner if dens[i] < dens[i - 1] and dens[i] < dens[i + 1]]
    zone = max(np.quantile(y, 0.35), y[0] + 0.2 * (y[-1] - y[0]))
    for p in peaks:
        if gx[p] > zone or dens[p] < 0.02 * dens.max() or not 0 < np.expm1(gx[p]) <= min(0.15 * x[-1], 3):
            continue
        for v in valleys:
            cut = np.expm1(gx[v])
            if v > p and cut <= min(np.quantile(x, 0.4), 0.2 * x[-1]) and (x <= cut).sum() >= max(5, math.ceil(0.01 * len(x))) and 1 - dens[v] / dens[p] >= 0.25:
                return np.expm1(gx[p]), cut
    return None


def groups(rng):
    return {
        "bimodal": np.r_[rng.normal(1.2, 0.1, 60), rng.normal(14, 3, 240)],
        "single": rng.normal(20, 4, 200),
        "few": rng.normal(5, 1, 29),
        "constant": np.full(50, 3.0),
        "duplicates": np.r_[np.full(60, 1.0), rng.normal(12, 2, 100)],
        "outlier": np.r_[0.2, rng.normal(20, 1, 80)],
        "first_bin": np.r_[rng.uniform(0.5, 0.8, 120), rng.uniform(1, 30, 200)],
    }


@pytest.fixture(scope="module")
def grouped(spark):
    data = groups(np.random.default_rng(3))
    return data, spark.createDataFrame([(g, float(v)) for g, x in data.items() for v in np.abs(x)], "k string, v double").cache()


def test_kde_mass_within_the_grid(grouped):
    _, df = grouped
    rows = D.valid(df, "k", "v")
    for c in (D.kde(rows, 400).toPandas(), D.kde_exact(rows, 400).toPandas()):
        assert set(c.g) == {"bimodal", "single", "duplicates", "outlier", "first_bin"}
        for _, g in c.sort_values("i").groupby("g"):
            assert 0.5 < np.trapezoid(g.density, g.gx) <= 1.001


def test_weights_on_the_grid_are_close(grouped):
    rows = D.valid(grouped[1], "k", "v")
    both = D.kde(rows).join(D.kde_exact(rows, D.P.grid).withColumnRenamed("density", "exact"), ["g", "i"]).toPandas()
    top = both.groupby("g").exact.transform("max")
    assert len(both) == 5 * D.P.grid and ((both.density - both.exact).abs() / top).max() < 1e-4


def test_fronts_match_numpy(grouped):
    data, df = grouped
    found = {r.g: r for r in D.fronts(df, "k", "v").collect()}
    assert set(found) == set(data)
    for g, x in data.items():
        want = numpy_valley(np.abs(x), D.P.grid) if len(x) >= 30 and np.ptp(x) > 0 else None
        if want:
            assert found[g].method == "first_valley" and found[g].cutoff == pytest.approx(want[1], rel=2e-3)  # within a grid point
            if "many_duplicate" not in found[g].flags:
                assert found[g].t0 == pytest.approx(want[0], rel=2e-3)
        else:
            assert found[g].method != "first_valley"
    assert found["bimodal"].method == "first_valley"
    assert found["few"].confidence == "insufficient_data" and found["constant"].flags.endswith("kde_failed")
    assert "many_duplicate_rt_values" in found["duplicates"].flags and "possible_early_outlier" in found["outlier"].flags


def test_extrema_plateau(spark):
    d = [1.0, 2.0, 2.0, 2.0, 1.0, 0.5, 0.5, 3.0]
    c = spark.createDataFrame([("g", i, float(i), v) for i, v in enumerate(d)], "g string, i int, gx double, density double")
    assert values(D.extrema(c).select("i", "kind"), "i") == [(2, "peak"), (5, "valley"), (7, "peak")]


# Sources and sinks.


def test_sources(spark, tmp_path):
    for k, rows in {"0001": "id\tx\n01\t1.5\n02\tNaN\n", "0002": "id\tx\n03\t2.5\n"}.items():
        (tmp_path / "in" / k).mkdir(parents=True)
        (tmp_path / "in" / k / "data.tsv").write_text(rows)
    df = T.read_sources(spark, f"{tmp_path}/in/*/data.tsv", "id string, x double")
    assert values(df, "id") == [("0001", "01", 1.5), ("0001", "02", None), ("0002", "03", 2.5)]
    (tmp_path / "one.csv").write_text("k;x\n007;1\n")
    assert values(T.read_delimited(spark, str(tmp_path / "one.csv"), "k string, x double", ";"), "k") == [("007", 1.0)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "RP", 0), (2, "HILIC", 1)], "k int, type string, fold int")
    T.write_partitioned(df, f"{tmp_path}/p", "type")
    assert values(spark.read.parquet(f"{tmp_path}/p").select("k", "type"), "k") == [(1, "RP"), (2, "HILIC")]
    assert values(T.write_folds(df, f"{tmp_path}/f"), "fold") == [(0, 1), (1, 1)]
    T.write_tsv(df, f"{tmp_path}/t")
    assert spark.read.csv(f"{tmp_path}/t", sep="\t", header=True).count() == 2
    calls = []

    def build():
        calls.append(1)
        return df

    for _ in range(2):
        assert T.build_if_missing(spark, f"{tmp_path}/b", build).count() == 2
    assert len(calls) == 1


def test_two_key_query_runs_all_restarts(spark, monkeypatch):
    from cohortry.plans import splitting

    asked = []
    whole = K.restart_assignments
    monkeypatch.setattr(K, "restart_assignments", lambda pairs, problem, restarts=25, seed=42: asked.append(restarts) or whole(pairs, problem, restarts, seed))
    assert splitting.two_key_split(spark, "/root/testdata/sf0.001").count() > 0
    assert asked == [25]


def test_ranks_of_a_hot_group(spark):
    """A third of all rows in one group, null another: the same ranks as a window, in buckets near the mean."""
    df = spark.range(9000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 3 = 1 THEN NULL ELSE CAST(id % 40 AS STRING) END AS g")
    from pyspark.sql import Window

    at = F.row_number().over(Window.partitionBy("g").orderBy(K.order_key("id"), "id")) - 1
    both = K.ranked(df, "g", "id", 42).join(df.withColumn("at", at).select("id", "at"), "id").toPandas()
    assert len(both) == 9000 and (both._before == both["at"]).all() and (both._total == both.groupby("g", dropna=False).id.transform("count")).all()
    buckets = df.groupBy("g", K.order_key("id").substr(1, 3).alias("b")).count().agg(F.max("count")).first()[0]
    assert buckets <= 10  # of 3,000 rows of a group
    tiles = spark.range(7).select(K.tile(F.col("id"), F.lit(7), 3).alias("t"), K.tile(F.col("id"), F.lit(7), 10).alias("u")).collect()
    assert [r.t for r in tiles] == [0, 0, 0, 1, 1, 2, 2] and [r.u for r in tiles] == list(range(7))


def test_exact_quantiles_of_a_hot_group(spark):
    rng = np.random.default_rng(4)
    x = np.r_[rng.normal(5, 1, 3000), [1e6], np.full(500, 2.0)]
    df = spark.createDataFrame([("hot", float(v)) for v in x] + [("one", 3.0)], "g string, x double")
    got = {r.g: r for r in D.quantiles(df, {"a": 0.1, "b": 0.5, "c": 0.999}).collect()}
    assert [got["hot"].a, got["hot"].b, got["hot"].c] == pytest.approx(np.quantile(x, [0.1, 0.5, 0.999]).tolist())
    assert (got["one"].a, got["one"].c) == (3.0, 3.0)


def test_reports_of_names_and_runs(spark):
    df = spark.range(1)
    assert [r.dropped for r in R.dropped_names(["a", "b"], df).collect()] == ["a", "b"]
    m = spark.createDataFrame([("r1", "mae", 1.0, 0.1), ("r1", "rmse", 2.0, 0.2), ("r2", "mae", 3.0, 0.3)], "run string, metric string, mean double, std double")
    got = R.run_comparison(m).orderBy("run").collect()
    assert [tuple(r) for r in got] == [("r1", 1.0, 0.1, 2.0, 0.2), ("r2", 3.0, 0.3, None, None)]


def test_columns_move_next_to_an_anchor(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "a int, b int, `c.d` int, e int")
    assert C.move_next_to(df, ["e", "a"], "b").columns == ["b", "e", "a", "c.d"]


def test_grid_search_equals_closed_form(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 2)) * [1, 4]
    y = 3 * x[:, 0] - x[:, 1] + rng.normal(size=300)
    df = spark.createDataFrame([(float(a), float(b), float(c), i) for i, ((a, b), c) in enumerate(zip(x, y, strict=True))], "a double, b double, y double, i int")
    got = X.grid_search(df.filter("i < 200"), df.filter("i >= 200"), ["a", "b"], "y", [0.0, 0.5], [0.0]).collect()
    t, v = slice(0, 200), slice(200, 300)
    mean, sd = x[t].mean(axis=0), x[t].std(axis=0)
    want = {}
    for penalty in (0.0, 0.5):  # on scaled features
        z, u = (x[t] - mean) / sd, y[t] - y[t].mean()
        w = np.linalg.solve(z.T @ z / 200 + penalty * np.eye(2), z.T @ u / 200) / sd
        want[penalty] = (((x[v] - mean) @ w + y[t].mean() - y[v]) ** 2).mean()
    assert {r.penalty: r.val_loss for r in got} == pytest.approx(want, rel=1e-9)
    assert [r.val_loss for r in got] == sorted(r.val_loss for r in got)


def test_elastic_net_is_the_least(spark):
    """No step from the weights is better; strong lasso weights are zero, constant features have none."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(500, 3)) @ np.array([[1, 0.5, 0], [0, 1, 0], [0, 0, 0]])
    y = 2 * x[:, 0] - 0.3 * x[:, 1] + rng.normal(size=500)
    cov, c = np.cov(x.T, bias=True), ((x - x.mean(axis=0)) * (y - y.mean())[:, None]).mean(axis=0)
    loss = lambda w, lam, mix: w @ cov @ w / 2 - c @ w + lam * (mix * np.abs(w).sum() + (1 - mix) * (w @ w) / 2)
    for lam, mix in ((0.0, 0.0), (0.3, 0.5), (0.2, 1.0), (50.0, 1.0)):
        w = X.elastic_net(cov, c, lam, mix)
        assert w[2] == 0 and all(loss(w, lam, mix) <= loss(w + d, lam, mix) + 1e-12 for d in rng.normal(size=(200, 3)) * [[0.01, 0.01, 0]])
    assert (X.elastic_net(cov, c, 50.0, 1.0) == 0).all()


def test_grid_search_reads_each_table_once(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    spark.range(100).selectExpr("id", "CAST(id % 7 AS DOUBLE) AS a", "CASE WHEN id = 5 THEN NULL ELSE id * 2.0 END AS y").write.parquet(path)
    df = spark.read.parquet(path)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("grid", "")
    found = X.grid_search(df.filter("id < 80"), df.filter("id >= 80"), ["a"], "y", [0.0, 1.0, 2.0, 3.0], [0.0, 1.0])
    jobs = len(tracker.getJobIdsForGroup("grid"))
    spark.sparkContext.setJobGroup("", "")
    assert found.count() == 8 and jobs <= 4  # two aggregates, each a job or two


def test_regressions_of_several_features(spark):
    rng = np.random.default_rng(6)
    rows = [(g, int(f), float(a), float(b), float(2 * a - b + g + e)) for g in range(4) for f, a, b, e in zip(rng.integers(0, 5, 200), rng.normal(size=200) + 1e6, rng.normal(size=200), rng.normal(size=200), strict=True)]
    rows += [(9, i % 5, float(i), 2.0 * i, float(i)) for i in range(50)] + [(8, i, 1.0, 2.0, 3.0) for i in range(2)] + [(0, 1, None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "g int, fold int, a double, b double, y double")
    fits = V.regressions_by_group_fold(df, "g", "fold", ["a", "b"], "y", 5)
    got = {(r.g, r.fold): r for r in fits.collect()}
    for g, f in ((g, f) for g in range(4) for f in range(5)):
        t = np.array([r[2:] for r in rows if r[0] == g and r[1] not in (f, (f + 1) % 5) and r[2] is not None])
        design = np.c_[np.ones(len(t)), t[:, 0] - 1e6, t[:, 1]]
        w = np.linalg.lstsq(design, t[:, 2], rcond=None)[0]
        assert got[g, f].n_train == len(t) and got[g, f].weights == pytest.approx(w[1:], rel=1e-6)
        assert got[g, f].intercept + 1e6 * got[g, f].weights[0] == pytest.approx(w[0], rel=1e-6)
    assert all(got[9, f].weights is None and got[9, f].intercept is None for f in range(5)) and got[8, 0].weights is None
    held = V.predict_by_group_fold(df.filter("g < 4"), fits, "g", "fold", ["a", "b"]).filter("a IS NOT NULL").toPandas()
    assert (held.predicted - held.y).abs().mean() < 1.2 and len(held) == 800


def test_buckets_of_outliers_prefixes_and_hot_groups(spark):
    """The largest bucket is near the mean, whatever the values look like."""
    from cohortry.operators.ranks import bucket_of, cuts_of

    cases = {
        "outlier": spark.range(20_000).selectExpr("IF(id = 7, 1e9, id / 1000D) AS x"),
        "prefix": spark.range(20_000).selectExpr("'a long common prefix cc_' || id AS x"),
        "two prefixes": spark.range(20_000).selectExpr("IF(id = 7, 'zz', 'cc_' || id) AS x"),
        "dates": spark.range(20_000).selectExpr("IF(id = 7, DATE'1700-01-01', DATE'2020-01-01' + CAST(id AS INT)) AS x").selectExpr("CAST(x AS TIMESTAMP) AS x"),
    }
    for name, df in cases.items():
        cuts = cuts_of(df, "x", 64)
        found = df.withColumn("b", bucket_of("x", cuts))
        sizes = [r["count"] for r in found.groupBy("b").count().collect()]
        assert len(sizes) >= 50 and max(sizes) <= 4 * 20_000 / 64, name
        edges = found.groupBy("b").agg(F.min("x").alias("low"), F.max("x").alias("high")).orderBy("b").collect()
        assert all(a.high < z.low for a, z in zip(edges, edges[1:], strict=False)), name  # buckets ascend with the order
    assert cuts_of(spark.range(0), "id") == [] and cuts_of(spark.range(0).selectExpr("'a' AS x"), "x") == []
    for x in ("CAST(id AS DOUBLE)", "'cc_' || id"):  # without a number, buckets are worth their rows
        df = spark.range(20_000).selectExpr(f"{x} AS x")
        sizes = [r["count"] for r in df.groupBy(bucket_of("x", cuts_of(df, "x"))).count().collect()]
        assert 10 <= len(sizes) <= 24 and max(sizes) <= 4 * 1024
    nulls = spark.createDataFrame([(None,), (1.0,), (math.nan,)], "x double")
    assert nulls.select(bucket_of("x", cuts_of(nulls, "x"))).count() == 3


def test_bucket_is_the_number_of_cuts(spark):
    from cohortry.operators.ranks import bucket_of

    rng = random.Random(2)
    for n in (0, 1, 15, 16, 17, 255, 256, 257, 1000, 4095):
        cuts = sorted(rng.sample(range(10_000), n))
        got = spark.createDataFrame([(float(x),) for x in range(0, 10_000, 37)], "x double").select("x", bucket_of("x", [float(c) for c in cuts]).alias("b")).collect()
        assert all(r.b == sum(c <= r.x for c in cuts) for r in got), n


def test_infinite_values_are_uncertain(spark):
    rng = np.random.default_rng(1)
    xs = [*map(float, rng.lognormal(2, 0.5, 400)), *map(float, rng.normal(1.0, 0.05, 60))]
    odd = [math.inf, -math.inf, math.nan, None, -1.0, 0.0]
    clean = spark.createDataFrame([(1, x) for x in xs], "g int, x double")
    df = spark.createDataFrame([(1, x) for x in [*xs, *odd]], "g int, x double")
    assert D.value_profile(D.valid(df, "g", "x")).collect() == D.value_profile(D.valid(clean, "g", "x")).collect()
    found = D.fronts(df, "g", "x")
    assert [tuple(r) for r in found.collect()] == [tuple(r) for r in D.fronts(clean, "g", "x").collect()]
    status = D.classify(df, found, "g", "x").collect()
    assert {r.status for r in status if r.x is None or not math.isfinite(r.x) or r.x <= 0} == {"uncertain"}
    seconds = df.withColumn("x", F.col("x") * 60)
    slow = D.fronts(seconds, "g", "x", units="seconds")
    assert slow.first().cutoff == pytest.approx(found.first().cutoff) and slow.first().flags == found.first().flags
    assert [r.status for r in D.classify(seconds, slow, "g", "x", units="seconds").collect()].count("retained") == [r.status for r in status].count("retained")
    with pytest.raises(ValueError, match="units"):
        D.valid(df, "g", "x", units="hours")


@pytest.mark.parametrize("span, grid", [((-5.0, 5.0), 500), ((-1.0, 0.5), 301), ((3.0, 3.01), 200)])
def test_estimate_on_a_fixed_grid(spark, span, grid):
    """Against sums over the values, with values beyond the grid, and a grid far finer than the bandwidth."""
    x = np.random.default_rng(3).normal(1, 2, 300)
    rows = spark.createDataFrame([(1, float(v)) for v in x], "g int, x double")
    for rule, factor in (("silverman", (300 * 0.75) ** -0.2), ("scott", 300**-0.2)):
        got = D.kde(rows, grid, bandwidth=rule, span=span, log=False).toPandas().sort_values("i")
        h, at = factor * x.std(ddof=1), np.linspace(*span, grid)
        want = np.exp(-0.5 * ((at[:, None] - x[None]) / h) ** 2).sum(axis=1) / (300 * h * math.sqrt(2 * math.pi))
        step = (span[1] - span[0]) / (grid - 1)
        assert got.gx.to_numpy() == pytest.approx(at) and got.density.to_numpy() == pytest.approx(want, abs=(step / h) ** 2 / 4 + 1e-5)


def plain_tree(rows, cuts, depth, least):
    """{node: (feature, cut, rows)} of one tree, by loops over rows, nodes and cuts."""
    below = lambda x, c: x is None or x < c  # noqa: E731  NaN is under no cut
    splits, at = {}, {0: rows}
    for level in range(depth):
        for node in range(2**level - 1, 2 ** (level + 1) - 1):
            inside = at.get(node, [])
            if len(inside) < 2 * least:
                continue
            error = lambda rs: float(((np.array([r[-1] for r in rs]) - np.mean([r[-1] for r in rs])) ** 2).sum())
            found = []
            for j, cs in enumerate(cuts):
                for c in cs:
                    left, right = [r for r in inside if below(r[j], c)], [r for r in inside if not below(r[j], c)]
                    if len(left) >= least and len(right) >= least:
                        found.append((round(error(left) + error(right), 6), j, c, left, right))
            if found and min(f[:3] for f in found)[0] < error(inside) - 1e-6:
                _, j, c, left, right = min(found, key=lambda f: f[:3])
                splits[node] = (j, c, len(inside))
                at |= {2 * node + 1: left, 2 * node + 2: right}
    return splits


def test_trees_of_all_folds_equal_plain_loops(spark):
    from cohortry.operators import trees

    rng = random.Random(5)
    rows = []
    for i in range(600):
        a, b = rng.choice([None, math.nan, *range(12)]), rng.random()
        known = a is not None and a == a
        y = (30 if known and a >= 7 else 0) + (10 if b < 0.3 else 0) * (2 if known and a < 3 else 1) + rng.gauss(0, 1)
        rows.append((i, i % 4, a if a is None else float(a), b, y))
    rows += [(600 + i, i % 4, 1.0, 0.5, y) for i, y in enumerate([None, math.nan, math.inf, -math.inf])]
    df = spark.createDataFrame(rows, "id int, part int, `a b` double, b double, y double").withColumn("_node", F.lit("clash")).withColumn("run", F.lit("clash"))
    cuts = {"a b": [float(c) for c in range(1, 12)], "b": [k / 10 for k in range(1, 10)]}
    roles = K.cv_roles(4, spark)
    fit = trees.grow(df, roles, ["a b", "b"], "y", "part", depth=3, least=15, cuts=cuts)
    got = {}
    for r in fit.splits().collect():
        got.setdefault(r.run, {})[r.node] = (["a b", "b"].index(r.feature), r.threshold, r.n)
    predicted = {(r.run, r.id): r.predicted for r in fit.predict(df, roles, "part").collect()}
    assert len(predicted) == len(rows) and set(fit.predict(df, roles, "part").columns) == {"id", "part", "a b", "b", "y", "_node", "run", "predicted"}
    for run in range(4):
        taught = [r[2:] for r in rows if r[1] not in (run, (run + 1) % 4) and r[4] is not None and math.isfinite(r[4])]
        splits = plain_tree(taught, list(cuts.values()), 3, 15)
        assert got[run] == splits

        def leaf(r, splits=splits):
            node = 0
            while node in splits:
                j, c, _ = splits[node]
                node = 2 * node + (1 if r[j] is None or r[j] < c else 2)
            return node

        for r in rows:
            if r[1] == run:
                same = [t[-1] for t in taught if leaf(t) == leaf(r[2:])]
                assert predicted[run, r[0]] == pytest.approx(np.mean(same))


def test_trees_of_odd_tables(spark):
    from cohortry.operators import trees

    roles = K.cv_roles(3, spark)
    rows = spark.range(90).selectExpr("id % 3 AS fold", "CAST(id AS DOUBLE) AS x", "1e9 + IF(id < 60, 1D, 2D) AS y", "3D AS same")
    assert trees.even_cuts(rows, ["x", "same"], 3) == {"x": [29.0, 59.0], "same": [3.0]}
    fit = trees.grow(rows, roles, ["x", "same"], "y", "fold", depth=4, least=2, cuts={"x": [20, 40, 60, 80], "same": [3]})
    assert [(r.node, r.feature) for r in fit.splits().filter("run = 0").collect()] == [(0, "x")]  # both sides are constant then
    assert fit.predict(rows, roles, "fold").filter("predicted = y").count() == 90
    flat = trees.grow(rows, roles, ["x"], "same", "fold")
    assert flat.splits().count() == 0 and {r.predicted for r in flat.predict(rows, roles, "fold").collect()} == {3.0}
    assert trees.grow(rows, roles, ["x"], "y", "fold", depth=0).leaves.count() == 3
    none = trees.grow(rows.limit(0), roles, ["x"], "y", "fold")
    assert none.splits().count() == 0 and none.predict(rows, roles, "fold").filter("predicted IS NULL").count() == 90
    with pytest.raises(ValueError, match="depth"):
        trees.grow(rows, roles, ["x"], "y", "fold", depth=40)


def test_shapes_are_those_of_the_points_and_few(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(g, float(x)) for g in range(4) for x in np.exp(rng.normal(g % 2, 0.2 + g / 2, 300))], "g int, x double")
    rows = D.valid(df, "g", "x")
    lim = D.limits(rows)
    got = D.shapes(rows, lim).cache()
    want = D.extrema(D.kde(rows, D.P.grid)).orderBy("g", "i").collect()
    ends = got.filter("kind <> 'curve'").orderBy("g", "i").select("g", "i", "kind", "gx", "density").collect()
    assert [tuple(r)[:3] for r in ends] == [tuple(r)[:3] for r in want]
    assert got.filter("kind = 'curve'").count() == 4 and got.count() < 4 * 50  # not a grid a group
    steepest = D.gradients(D.kde(rows, D.P.grid)).groupBy("g").agg(F.max(F.abs("gradient")).alias("s"))
    assert got.filter("kind = 'curve'").join(steepest, "g").filter("abs(s - steepest) > 1e-9 * s").count() == 0
