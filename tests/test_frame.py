import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.errors import SheetError
from gridloom.operators.chain import FULL_SHEET, chained, chains, locate, offsets
from gridloom.operators import frame as frame_module
from gridloom.operators.frame import SheetFrame, draw_rows
from gridloom.plans.planner import IndexedFrame
from gridloom.plans.zonemap import build_zone_map, plan_runs, pruned


@pytest.fixture(scope="module")
def perm(spark):
    """id = i, perm = (i * 7) % 2000, name."""
    df = spark.range(1, 2001).select((F.col("id") + 1).alias("_row"), F.col("id").cast("int").alias("id"), ((F.col("id") * 7) % 2000).cast("int").alias("perm"), F.concat(F.lit("name-"), "id").alias("name"))
    return SheetFrame(df).df.cache(), ["id", "perm", "name"]


@pytest.fixture(scope="module")
def own(perm):
    return SheetFrame(perm[0], "_row", perm[1])


def rows(df):
    return sorted(r["_row"] for r in df.collect())


@pytest.mark.parametrize("predicates", [[("id", "between", 300, 450), ("perm", "<", 900)], [("perm", ">=", 1990)], [("id", "=", 77), ("perm", "=", 539)], [("id", ">", 5000)], [("id", "between", 10, 5)]])
def test_pruned_rows_are_the_unpruned(own, predicates):
    zones = build_zone_map(own, ["id", "perm"], 100)
    want = rows(own.rows_where_all(predicates))
    assert rows(pruned(own, zones, predicates)) == want
    plan = IndexedFrame(own, zones, 100, 2001, {c: own.digest(c) for c in ("id", "perm")}, {"id": 2000, "perm": 2000})
    assert rows(plan.rows_where_all(predicates)) == want
    explained = plan.explain(predicates)
    assert explained["estimatedRows"]["upper"] >= len(want)
    for p in predicates:
        assert plan.estimated_rows(*p)["upper"] >= len(rows(own.rows_where(*p)))


def test_errors(own):
    for bad in (lambda: own.rows_where("id", "!=", 1), lambda: own.rows_where("id", "between", 1), lambda: own.rows_where_all([]), lambda: own.resolve("ID"), lambda: own.resolve(0), lambda: own.resolve(4), lambda: own.chunked(0), lambda: own.shards(0, 10), lambda: own.quantile("id", 1.5), lambda: SheetFrame(own.df, "_row", ["a", "b", "a"]).resolve("a")):
        with pytest.raises(SheetError):
            bad()


def test_rows_by_number(own):
    assert rows(own.rows(0, 0)) == rows(own.rows(5, -1)) == rows(own.row_at(0)) == rows(own.row_range(9, 5)) == []
    assert rows(own.rows(-3, 2)) == [2, 3]
    assert rows(own.row_range(-5, 3)) == [2, 3]
    assert [(r.batch, r.n) for r in own.chunked(600).groupBy("batch").agg(F.count("*").alias("n")).orderBy("batch").collect()] == [(0, 600), (1, 600), (2, 600), (3, 200)]


def test_top_rows_ties_go_to_the_earlier_row(spark):
    own = SheetFrame(spark.createDataFrame([(2, 1.0), (3, None), (4, 5.0), (5, 5.0), (6, float("nan"))], "_row long, x double"))
    assert [r["_row"] for r in own.top_rows("x", 2, True).collect()] == [4, 5]
    assert [r["_row"] for r in own.top_rows("x", 9).collect()] == [2, 4, 5]
    assert own.top_rows("x", 0).collect() == []
    assert rows(own.rows_where("x", ">", 0)) == [2, 4, 5]


def test_sample(own):
    a = rows(own.sample_rows(20, 7))
    assert a == rows(own.sample_rows(20, 7)) != rows(own.sample_rows(20, 8))
    assert len(a) == 20 and len(rows(own.sample_rows(5000, 1))) == 2000
    assert len(rows(own.sample_rows(1500, 3))) == 1500
    assert draw_rows(5, 5, 1, 0) == [5]
    with pytest.raises(SheetError):
        draw_rows(1, 3, 4, 0)


def test_group_stats_with_odd_cells(spark):
    data = []
    for i in range(1, 501):
        g = "" if i % 37 == 0 else "n/a" if i % 41 == 0 else str((i - 1) // 100)
        data.append((i + 1, g, None if i % 29 == 0 else i * 2.5))
    own = SheetFrame(spark.createDataFrame(data, "_row long, g string, amount double"))
    want = {}
    for row, g, x in data:
        if g.isdigit():
            s = want.setdefault(float(g), [0.0, 0, row])
            s[2] = min(s[2], row)
            if x is not None:
                s[0], s[1] = s[0] + x, s[1] + 1
    got = {r.group: [r["sum"], r["count"], r.first_row] for r in own.group_stats("g", "amount").collect()}
    assert got == want


@pytest.mark.parametrize("width", [130, 137])
def test_group_pushdown_is_the_scan(spark, width):
    own = SheetFrame(spark.range(1, 2001).select((F.col("id") + 1).alias("_row"), F.floor((F.col("id") - 1) / width).cast("double").alias("grp"), (F.col("id") * 1.25).alias("amount")))
    plan = IndexedFrame(own, build_zone_map(own, ["grp", "amount"], 100), 100, 2001)
    key = lambda df: sorted(map(tuple, df.select("group", "sum", "count", "min", "max", "first_row").collect()))
    assert key(plan.group_stats("grp", "amount")) == key(own.group_stats("grp", "amount"))
    told = []
    plan.on_full_scan(told.append).group_stats("_row" if False else "amount", "grp")
    assert told and told[0]["reason"] == "groupby-not-sorted"


def test_sorted_as(spark):
    for values, want in (([1, 2, 2, 5], "asc"), ([5, 4, 4], "desc"), ([3, 3], "asc"), ([1, 3, 2], None), ([], "asc")):
        own = SheetFrame(spark.createDataFrame([(i + 2, float(v)) for i, v in enumerate(values)], "_row long, x double"))
        assert own.sorted_as("x", 2).first().sorted == want


def test_chain_numbers():
    assert chains([FULL_SHEET, FULL_SHEET, 10, 7], [["a"], ["a"], ["a"], ["a"]]) == [[0, 1, 2], [3]]
    assert chains([FULL_SHEET, None, 3], [["a"], ["a"], ["b"]]) == [[0], [1], [2]]
    totals = [4, 4, 3]
    assert offsets(totals) == [0, 3, 6]
    assert [locate(totals, r) for r in (1, 4, 5, 7, 8, 9, 10)] == [(0, 1), (0, 4), (1, 2), (1, 4), (2, 2), (2, 3), None]


def test_chained_rows(spark):
    parts = [SheetFrame(spark.createDataFrame([(r, m * 10 + r) for r in range(2, n + 1)], "_row long, v long")) for m, n in enumerate((4, 4, 3))]
    found = chained(parts, [4, 4, 3]).df.orderBy("_row").collect()
    assert [r["_row"] for r in found] == list(range(2, 10))
    assert [(r["_member"], r["_local_row"]) for r in found] == [(0, 2), (0, 3), (0, 4), (1, 2), (1, 3), (1, 4), (2, 2), (2, 3)]


def test_plan_runs():
    blocks = [(0, 1, 101), (1, 102, 201), (4, 402, 501)]
    assert plan_runs(blocks) == [(0, 1, 1, 201), (4, 4, 402, 501)]
    assert plan_runs(blocks, 200) == [(0, 4, 1, 501)]


def test_predicates_reach_the_scan(spark, tmp_path, capsys):
    path = str(tmp_path / "t.parquet")
    spark.range(1000).select("id", (F.col("id") * 1.5).alias("x"), F.lit("wide").alias("w")).write.parquet(path)
    own = SheetFrame.numbered(spark.read.parquet(path), "id")
    own.rows_where_all([("id", "<", 10), ("x", "between", 1, 5)]).select("id").explain("formatted")
    plan = capsys.readouterr().out
    pushed = next(line for line in plan.splitlines() if "PushedFilters" in line)
    assert "LessThan(id,10)" in pushed and "GreaterThanOrEqual(x,1.0)" in pushed and "LessThanOrEqual(x,5.0)" in pushed
    assert "w" not in next(line for line in plan.splitlines() if "ReadSchema" in line).split("struct")[1]
    own.row_range(100, 120).explain("formatted")
    assert "GreaterThanOrEqual(id,98)" in capsys.readouterr().out


def test_random_predicates_against_plain_python(spark):
    rng = random.Random(5)
    cells = [rng.choice(["", None, "x", str(rng.randint(0, 9)), f" {rng.random() * 9:.2f}", "7f", "0x1", True]) for _ in range(300)]
    data = [(i + 2, None if c is None or c is True else c) for i, c in enumerate(cells)]
    own = SheetFrame(spark.createDataFrame(data, "_row long, x string"))

    def number(c):
        try:
            return float(c) if c and "f" not in c else None
        except ValueError:
            return None

    want = [r for r, c in data if (n := number(c)) is not None and 2 <= n <= 6]
    assert rows(own.rows_where("x", "between", 6, 2)) == want


@pytest.mark.parametrize("size", [0, 1, 2, 90_000])
def test_quantiles_are_those_of_the_sorted_column(spark, size, monkeypatch):
    monkeypatch.setattr(frame_module, "PICKED", 500)
    rng = np.random.default_rng(size)
    x = np.round(rng.normal(size=size), 3) * (rng.random(size) < 0.7)  # many ties, at 0 most of all
    own = SheetFrame(spark.createDataFrame([(i + 2, float(v)) for i, v in enumerate(x)], "_row long, x double").repartition(5))
    asked = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.777, "e": 0.9999, "f": 1.0}
    got = own.quantiles("x", asked).first()
    for name, q in asked.items():
        assert (got[name] is None) if not size else abs(got[name] - np.quantile(x, q)) < 1e-9
    for bad in (-0.1, 1.1):
        with pytest.raises(SheetError):
            own.quantile("x", bad)


@pytest.mark.parametrize("count, total", [(8, 8), (3, 10), (7, 7001), (5, 3)])
def test_shards_by_division_are_the_ranges(spark, count, total):
    own = SheetFrame(spark.range(2, total + 1).withColumnRenamed("id", "_row").withColumn("x", F.col("_row")))
    got = {r._row: r.shard for r in own.shard_of(count, total).collect()}
    want = {r: i for i, (a, b) in enumerate(own.shards(count, total)) for r in range(max(2, a), b + 1)}
    assert got == want


def test_the_index_answers_what_the_frame_does(spark):
    rng = np.random.default_rng(3)
    rows = [(i + 2, float(i), None if i % 9 == 0 else float(rng.integers(0, 50))) for i in range(3000)]
    own = SheetFrame(spark.createDataFrame(rows, "_row long, id double, x double"))
    plan = IndexedFrame(own, build_zone_map(own, ["id", "x"], 100), 100, 3001)
    for column in ("id", "x"):
        assert plan.column_stats(column).first() == own.column_stats(column).first()
        for k in (0, 1, 7, 450, 5000):
            for desc in (True, False):
                assert [tuple(r) for r in plan.top_rows(column, k, desc).collect()] == [tuple(r) for r in own.top_rows(column, k, desc).collect()]
    assert plan.quantile("x", 0.5) is None and plan.explain([("id", "between", 250, 449)])["runs"] == 1
    assert plan.explain([("id", "<", -1)])["candidateBlocks"] == 0
