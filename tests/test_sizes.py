"""Queries on tables of another size or shape than the driver's."""

import itertools

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from check_oracles import _close, normal
from rollcall.operators import draws as dr
from rollcall.operators import network as nw
from rollcall.operators import regress as rg


def like_the_oracle(spark, sf, name, tables):
    df = queries()[name](spark, str(sf))
    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    cur = con.execute(oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    got, want = normal([tuple(r) for r in df.collect()], df.columns), normal(cur.fetchall(), cols)
    assert sorted(cols) == sorted(df.columns) and len(got) == len(want) > 0
    assert all(_close(p, q) for x, y in zip(got, want) for p, q in zip(x, y))


@pytest.mark.parametrize("vectors", [202, 207])
@pytest.mark.parametrize("name", ["rhat", "ess", "rhat_rank", "ess_bulk", "ess_tail"])
def test_chains_of_unequal_length(spark, tmp_path, name, vectors):
    rng = np.random.default_rng(vectors)
    rows = [(i, [float(v) for v in rng.normal(size=4).round(1)]) for i in range(vectors)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "all"))
    duckdb.sql(f"copy (from read_parquet('{tmp_path}/all/*.parquet')) to '{tmp_path}/embeddings.parquet'")
    like_the_oracle(spark, tmp_path, name, ["embeddings"])


def test_simulated_counts_of_many_trials(spark):
    draws = spark.createDataFrame([(1, i, t, 0.25 * t, 30.0) for i in range(1, 301) for t in (1, 2)], "chain long, iteration long, t long, value double, phi double")
    data = spark.createDataFrame([(1, 500_000), (2, 1_500)], "t long, size long")
    sim = dr.simulate_counts(draws, data, "t", "size", "phi", 300, 4)
    assert sim.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = sim.collect()
    assert len(rows) == 600
    for t, n in ((1, 500_000), (2, 1_500)):
        p = np.array([r.y for r in rows if r.t == t]) / n
        spread = (0.25 * t * (1 - 0.25 * t) * (1 / 31 + 30 / 31 / n)) ** 0.5
        assert p.mean() == pytest.approx(0.25 * t, abs=4 * spread / 300 ** 0.5) and p.std() == pytest.approx(spread, rel=0.2)
    odd = [(1, 1, 1, None, 5.0), (1, 1, 7, 0.0, 0.0), (1, 1, 4, 0.5, 5.0), (1, 1, 5, 0.5, 5.0), (1, 1, 6, -0.1, 5.0)]
    draws = spark.createDataFrame(odd, "chain long, iteration long, t long, value double, phi double")
    data = spark.createDataFrame([(1, 9), (4, None), (5, 0), (6, 9), (7, -2)], "t long, size long")
    got = {r.t: r.y for r in dr.simulate_counts(draws, data, "t", "size", "phi", 10, 4).collect()}
    assert got == {1: None, 4: None, 5: 0, 6: None, 7: None}


def test_contrasts_have_no_quadratic_step(spark):
    """Arrays of structs have no hash: distinct and intersect compare all with all."""
    rows = spark.range(3000).select(F.col("id").alias("iteration"), F.lit(1).alias("chain"), F.explode(F.array(*map(F.lit, "abc"))).alias("variable"))
    df = rows.withColumn("value", F.pmod(F.xxhash64("variable", "iteration"), F.lit(1000)) / 1000.0)
    df = df.filter("variable <> 'c' or iteration % 3 = 0")
    wide = df.toPandas().pivot(index="iteration", columns="variable", values="value")
    out = dr.pairwise_contrasts(df)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "array_distinct" not in plan and "array_intersect" not in plan and "element_at" not in plan
    got = {(r.level1, r.level2): (r.mean, r.lo, r.hi) for r in out.collect()}
    assert len(got) == 3
    for (x, y), r in got.items():
        d = (wide[x] - wide[y]).dropna()
        assert r == pytest.approx((d.mean(), *np.quantile(d, [0.025, 0.975])))
    apart = df.filter("variable = 'a' and iteration % 2 = 0 or variable = 'b' and iteration % 2 = 1")
    assert dr.pairwise_contrasts(apart).count() == 0


@pytest.mark.parametrize("unit", [512, 10, 0])
def test_permutations_of_small_and_large_units(spark, monkeypatch, unit):
    """Units folded into rows, joined, and both at once give the same; edges that have no image are left out."""
    rng = np.random.default_rng(3)
    rows = [(u, f"n{a}", f"n{b}", float(rng.binomial(9, 0.4)) / 9, 9.0, float(rng.integers(0, 2)), float(abs(a - b)))
            for u, n in ((1, 8), (2, 12)) for a in range(10 * u, 10 * u + n) for b in range(a + 1, 10 * u + n) if (a + b) % 7]
    rows += [(3, f"n{a}", f"n{b}", 0.5 + 0.01 * a, 4.0, float(a % 2), 1.0 + b) for a, b in ((50, 51), (50, 51), (50, 52), (51, 52), (50, 53))]
    df = spark.createDataFrame(rows, "u long, a string, b string, y double, w double, x1 double, x2 double")
    seen = {}
    for size in {unit, 0}:
        monkeypatch.setattr(nw, "UNIT", size)
        assert (nw._folded_units(df.select("u", "a", "b", "y"), ["u"], ["y"], 3, 1)[1].select("u").distinct().count()) == {512: 1, 10: 2, 0: 3}[size]
        seen[size] = [sorted(tuple(r) for r in out.collect()) for out in (
            nw.qap(df, "y", ["x1", "x2"], ["u"], 30, 4, "w"), nw.permutation_regression(df, "y", ["x1", "x2"], ["u"], 30, 4, "w", chunk=20))]
    for x, y in zip(seen[unit], seen[0]):
        assert [r[0] for r in x] == [r[0] for r in y] and [r[1:] for r in x] == [pytest.approx(r[1:], rel=1e-6) for r in y]


def test_centrality_settles_in_few_steps(spark):
    """Steps grow with the square root of what a power iteration takes; unknown weights weigh nothing."""
    rows = [(i, i + 1, 1.0 + (i < 5)) for i in range(80)] + [(90, 91, 0.5), (2, 95, None), (None, 3, 1.0)]
    df = spark.createDataFrame(rows, "a long, b long, w double")
    got = {r.node: r.centrality for r in nw.eigen_centrality(df, most=60).collect()}
    a = np.zeros((96, 96))
    for i, j, w in rows[:-2]:
        a[i, j] = a[j, i] = w
    v = np.abs(np.linalg.eigh(a)[1][:, -1])
    assert set(got) == {*range(81), 90, 91, 95, None} and min(got.values()) >= 0
    assert [got[i] for i in (*range(81), 90, 91, 95)] == pytest.approx([v[i] / v.max() for i in (*range(81), 90, 91, 95)], abs=1e-8)
    empty = nw.eigen_centrality(df.filter("a > 1000"))
    assert empty.count() == 0


def test_binomial_scoring_like_the_solver(spark):
    """Column sums over many cells give what Spark ML's solver gives, errors and null rows included."""
    rng = np.random.default_rng(11)
    rows = [(float(rng.binomial(n, 0.02 + 0.01 * (i % 7))) / n, i / 60, float(i % 13), 0.1 * (i % 3), float(n)) for i in range(1, 400) for n in (3, 8)]
    rows += [(None, 1.0, 2.0, 0.0, 3.0), (0.5, None, 2.0, 0.0, 4.0)]
    df = spark.createDataFrame(rows, "p double, time double, rank_c double, o double, n double")
    for link in ("cloglog", "logit"):
        one, two = (rg.fit_glm(df, "p ~ time + rank_c", "binomial", link, offset="o", weight="n", many=m) for m in (True, False))
        assert one.names == two.names and one.beta == pytest.approx(two.beta, abs=1e-7)
        assert one.cov == pytest.approx(two.cov, rel=1e-5)
    with pytest.raises(RuntimeError, match="not settled"):
        rg.fit_glm(df, "p ~ time + rank_c", "binomial", "logit", weight="n", many=True, steps=2)
    with pytest.raises(ValueError, match="binomial"):
        rg.fit_glm(df, "p ~ time", "poisson", "log", many=True)


def test_swapping_halves_end_as_their_sql_does(spark, tmp_path):
    """Neighbours of one parity swap labels for ever: no step settles them, the labels of step 120 are those of the SQL."""
    rows = [(0, 10, 3.0), (0, 12, 1.0), (2, 10, 3.0), (2, 12, 1.0), (1, 21, 2.0), (1, 23, 1.0), (3, 21, 2.0), (3, 23, 1.0), (0, 1, 0.5), (5, 30, 1.0), (5, 33, None), (31, 33, 1.0), (35, 36, None)]
    cols = ", ".join(f"({i}, {a}, 'R', {'null' if w is None else w})" for i, (a, _, w) in enumerate(rows))
    duckdb.sql(f"copy (select l_orderkey::bigint as l_orderkey, l_suppkey::bigint as l_suppkey, l_returnflag, l_quantity::double as l_quantity "
               f"from (values {cols}) t(l_orderkey, l_suppkey, l_returnflag, l_quantity)) to '{tmp_path}/lineitem.parquet'")
    cols = ", ".join(f"({i}, {b})" for i, (_, b, _) in enumerate(rows))
    duckdb.sql(f"copy (select o_orderkey::bigint as o_orderkey, o_custkey::bigint as o_custkey, date '1995-01-01' as o_orderdate "
               f"from (values {cols}) t(o_orderkey, o_custkey)) to '{tmp_path}/orders.parquet'")
    like_the_oracle(spark, tmp_path, "label_propagation", ["lineitem", "orders"])
    df, turn = spark.createDataFrame(rows, "a long, b long, w double"), F.pmod("node", F.lit(2))
    for in_task in (0, None):
        with pytest.raises(RuntimeError, match="come back every 4 steps"):
            nw.label_propagation(df, turn, in_task=in_task)
    ends = [[{r.node: r.label for r in nw.label_propagation(df, turn, phase=p, in_task=k).collect()} for k in (None, 0)] for p in (118, 120)]
    assert all(one == steps for one, steps in ends) and ends[0] != ends[1]


def some_edges(seed, n=40):
    rng = np.random.default_rng(seed)
    rows = [(int(a), int(b), float(rng.integers(1, 5))) for a, b in rng.integers(0, n, (90, 2))]
    rows = [(a, b, None if i % 11 == 0 else w) for i, (a, b, w) in enumerate(rows)]
    return rows + [(None, 3, 2.0), (7, None, 4.0), (n + 1, n + 2, None), rows[1]]


@pytest.mark.parametrize("kind", ["long", "string"])
def test_propagation_in_one_task_is_that_of_the_steps(spark, kind):
    df = spark.createDataFrame(some_edges(4), "a long, b long, w double").withColumns({k: F.col(k).cast(kind) for k in "ab"})
    for turn in (None, F.pmod(F.col("node").cast("long"), F.lit(2))):
        one, steps = ({r.node: r.label for r in nw.label_propagation(df, turn, phase=0, in_task=k).collect()} for k in (None, 0))
        assert one == steps and len(one) > 30 and None not in one


@pytest.mark.parametrize("in_task", [None, 40, 0])
def test_communities_of_any_size_are_settled(spark, in_task):
    """In one task, the contracted graphs only, and none in one task."""
    rows = [(a, b, w) for a, b, w in some_edges(5) if a is not None and b is not None and a != b and w]
    df = spark.createDataFrame(rows, "a long, b long, w double")
    found = nw.communities(df, in_task=in_task)
    labels = {r.node: r.label for r in found.collect()}
    assert set(labels) == {v for a, b, _ in rows for v in (a, b)} and nw.raising_moves(df, found).count() == 0
    assert all(labels[c] == c == min(v for v in labels if labels[v] == c) for c in set(labels.values()))

    def quality(part):
        ends = [(part[a], part[b], w) for a, b, w in rows]
        degree = [sum(w * ((a == c) + (b == c)) for a, b, w in ends) for c in set(part.values())]
        return 2 * sum(w for a, b, w in ends if a == b) / sum(degree) - sum(k * k for k in degree) / sum(degree) ** 2

    q = nw.modularity(df, found).first().q
    assert q == pytest.approx(quality(labels))
    for c, d in itertools.combinations(set(labels.values()), 2):
        assert quality({v: d if x == c else x for v, x in labels.items()}) <= q + 1e-9
