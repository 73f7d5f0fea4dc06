"""The sheet engine's queries, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import semantics as S
from gridloom.operators.chain import chained
from gridloom.operators.frame import SheetFrame, draw_rows
from gridloom.plans.planner import IndexedFrame
from gridloom.plans.shared import shared_folder, stored
from gridloom.plans.zonemap import build_zone_map, surviving_blocks

FLAGSHIP = "where_all_two"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Money adds up exactly in this type, in whatever order.
MONEY = "decimal(18,2)"
EVERY = 1000


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def frame(spark: SparkSession, sf_dir: str, table: str = "orders", key: str = "o_orderkey") -> SheetFrame:
    return SheetFrame.numbered(spark.read.parquet(f"{sf_dir}/{table}.parquet"), key)


def events(spark: SparkSession, sf_dir: str) -> SheetFrame:
    return frame(spark, sf_dir, "events", "event_id")


def literal(spark: SparkSession, rows: str, columns: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t({columns})")


ORDER = "o_orderkey, o_custkey, o_totalprice"
COLS = ["o_orderkey", "o_custkey", "o_totalprice", "_row"]
O = f"SELECT {ORDER}, o_orderkey + 2 AS _row FROM orders"  # noqa: E741


# -- rows by number

query("row_count", "SELECT count(*) + 1 AS row_count FROM orders")(lambda s, d: frame(s, d).row_count())
query("rows_skip_limit", f"{O} ORDER BY o_orderkey LIMIT 50 OFFSET 100")(lambda s, d: frame(s, d).rows(101, 50).select(COLS))
query("row_at", f"{O} WHERE o_orderkey = 499")(lambda s, d: frame(s, d).row_at(501).select(COLS))
query("row_range", f"{O} WHERE o_orderkey BETWEEN 99 AND 148")(lambda s, d: frame(s, d).row_range(101, 150).select(COLS))
query("chunked_1000", "SELECT o_orderkey // 1000 AS batch, count(*) AS n FROM orders GROUP BY 1")(lambda s, d: frame(s, d).chunked(1000, 1).groupBy("batch").agg(F.count("*").alias("n")))
query("header", "SELECT unnest(['o_orderkey','o_custkey','o_orderstatus','o_totalprice','o_orderdate','o_orderpriority']) AS name, unnest([1,2,3,4,5,6]) AS position")(lambda s, d: s.createDataFrame([(n, i + 1) for i, n in enumerate(frame(s, d).columns)], "name string, position int"))

# -- predicates

for _name, _op, _value in (("eq", "=", 42), ("lt", "<", 20), ("le", "<=", 20), ("gt", ">", 1480), ("ge", ">=", 1480)):
    query(f"where_{_name}", f"{O} WHERE o_custkey {_op} {_value}")(lambda s, d, op=_op, v=_value: frame(s, d).rows_where("o_custkey", op, v).select(COLS))
query("where_between", f"{O} WHERE o_totalprice BETWEEN 1000 AND 2000.5")(lambda s, d: frame(s, d).rows_where("o_totalprice", "between", 1000, 2000.5).select(COLS))
query("where_between_swapped", f"{O} WHERE o_totalprice BETWEEN 1000 AND 2000.5")(lambda s, d: frame(s, d).rows_where("o_totalprice", "between", 2000.5, 1000).select(COLS))
query("where_all_two", f"{O} WHERE o_totalprice BETWEEN 1000 AND 50000 AND o_custkey < 500")(lambda s, d: frame(s, d).rows_where_all([("o_totalprice", "between", 1000, 50000), ("o_custkey", "<", 500)]).select(COLS))
query("where_all_three", f"{O} WHERE o_totalprice > 1000 AND o_custkey < 500 AND o_orderkey >= 5000")(lambda s, d: frame(s, d).rows_where_all([("o_totalprice", ">", 1000), ("o_custkey", "<", 500), ("o_orderkey", ">=", 5000)]).select(COLS))
query("find_row", f"{O} WHERE o_custkey = 42 ORDER BY o_orderkey LIMIT 1")(lambda s, d: frame(s, d).find_row("o_custkey", 42).select(COLS))

_MIXED = "(2,'5'),(3,' 7 '),(4,'7f'),(5,'1d'),(6,'NaN'),(7,''),(8,NULL),(9,'.5'),(10,'1.'),(11,'-3e2'),(12,'0x1A'),(13,'1 2'),(14,'+4'),(15,'Infinity'),(16,'1e999')"
_RX = "[ \\t\\n\\r\\x0B\\f]*[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?[ \\t\\n\\r\\x0B\\f]*"
_MIXED_SQL = f"WITH t AS (SELECT * FROM (VALUES {_MIXED}) AS v(_row, x)), n AS (SELECT _row, x, CASE WHEN regexp_full_match(x, '{_RX}') THEN TRY_CAST(trim(x) AS DOUBLE) END AS num FROM t)"
query("where_mixed_cells", f"{_MIXED_SQL} SELECT CAST(_row AS INTEGER) AS _row, x FROM n WHERE num >= -300 AND num <= 7")(lambda s, d: SheetFrame(literal(s, _MIXED, "_row, x")).rows_where("x", "between", -300, 7))
query("numeric_view", f"{_MIXED_SQL} SELECT CAST(_row AS INTEGER) AS _row, num FROM n")(lambda s, d: (lambda f: f.df.select("_row", f.number("x").alias("num")))(SheetFrame(literal(s, _MIXED, "_row, x"))))

# -- aggregates

_STATS = "SELECT min(x) AS min, max(x) AS max, CAST(sum(CAST(x AS DECIMAL(18,2))) AS DOUBLE) AS sum, CAST(sum(CAST(x AS DECIMAL(18,2))) AS DOUBLE) / count(x) AS avg, count(x) AS count, count(*) - count(x) AS other FROM "
query("column_stats_price", _STATS + "(SELECT o_totalprice AS x FROM orders)")(lambda s, d: frame(s, d).column_stats("o_totalprice", MONEY))
query("column_stats_nulls", _STATS + "(SELECT CASE WHEN event_id % 7 > 0 THEN value END AS x FROM events)")(lambda s, d: SheetFrame(events(s, d).df.select("_row", F.when(F.col("event_id") % 7 > 0, F.col("value")).alias("x"))).column_stats("x", MONEY))
_SERIAL = "(epoch_us({0}) / 1e6 + 2209161600) / 86400.0"
query("column_stats_ts", f"SELECT min(x) AS min, max(x) AS max, count(x) AS count FROM (SELECT {_SERIAL.format('ts')} AS x FROM events)")(lambda s, d: events(s, d).column_stats("ts").select("min", "max", "count"))
for _name, _table, _column, _want in (("key", "orders", "o_orderkey", None), ("price", "orders", "o_totalprice", None), ("ts", "events", "ts", None)):
    _key = "o_orderkey" if _table == "orders" else "event_id"
    query(
        f"sorted_{_name}",
        f"SELECT CASE WHEN bool_and(up) THEN 'asc' WHEN bool_and(down) THEN 'desc' END AS sorted FROM (SELECT coalesce({_column} >= lag({_column}) OVER w, true) AS up, coalesce({_column} <= lag({_column}) OVER w, true) AS down FROM {_table} WINDOW w AS (ORDER BY {_key}))",
    )(lambda s, d, t=_table, k=_key, c=_column: frame(s, d, t, k).sorted_as(c, 64))


def _groups(key: str, value: str = "o_totalprice", table: str = "orders", row: str = "o_orderkey") -> str:
    return f"SELECT {key} AS \"group\", coalesce(CAST(sum(CAST({value} AS DECIMAL(18,2))) AS DOUBLE), 0.0) AS sum, count({value}) AS count, min({value}) AS min, max({value}) AS max, min({row}) + 2 AS first_row FROM {table} GROUP BY 1"


query("group_identity", _groups("CAST(o_custkey AS DOUBLE)"))(lambda s, d: frame(s, d).group_stats("o_custkey", "o_totalprice", None, MONEY))
query("group_bucket_100", _groups("floor(o_custkey / 100.0)"))(lambda s, d: frame(s, d).group_stats("o_custkey", "o_totalprice", lambda c: F.floor(c / 100).cast("double"), MONEY))
for _unit, _format in (("year", "%Y"), ("month", "%Y%m"), ("day", "%Y%m%d")):
    query(f"group_{_unit}", _groups(f"CAST(strftime(o_orderdate, '{_format}') AS INTEGER)"))(lambda s, d, u=_unit: frame(s, d).group_stats("o_orderdate", "o_totalprice", u, MONEY))
_TEXTY = "(2,'1','x'),(3,'1',''),(4,'2','5.5'),(5,'a','7'),(6,'2','4'),(7,NULL,'1'),(8,'3',NULL)"
query("group_all_text_aggregate", f"WITH t AS (SELECT CAST(r AS INTEGER) AS r, TRY_CAST(g AS DOUBLE) AS g, TRY_CAST(nullif(x, '') AS DOUBLE) AS x FROM (VALUES {_TEXTY}) AS v(r, g, x)) SELECT g AS \"group\", coalesce(sum(x), 0.0) AS sum, count(x) AS count, min(x) AS min, max(x) AS max, min(r) AS first_row FROM t WHERE g IS NOT NULL GROUP BY 1")(lambda s, d: SheetFrame(literal(s, _TEXTY, "_row, g, x")).group_stats("g", "x"))
query("quantiles_exact", "SELECT quantile_cont(o_totalprice, 0.25) AS q25, quantile_cont(o_totalprice, 0.5) AS q50, quantile_cont(o_totalprice, 0.99) AS q99, min(o_totalprice) AS q0, max(o_totalprice) AS q100 FROM orders")(
    lambda s, d: frame(s, d).quantiles("o_totalprice", {"q25": 0.25, "q50": 0.5, "q99": 0.99, "q0": 0.0, "q100": 1.0})
)
query("median_exact", "SELECT median(o_totalprice) AS median FROM orders")(lambda s, d: frame(s, d).median("o_totalprice"))
query("distinct_exact", "SELECT count(DISTINCT o_custkey) AS distinct_count FROM orders")(lambda s, d: frame(s, d).count_distinct("o_custkey"))
query("distinct_text", "SELECT count(DISTINCT o_orderpriority) AS distinct_count FROM orders")(lambda s, d: frame(s, d).count_distinct("o_orderpriority"))


@query("quantile_tdigest_bound", "SELECT q, true AS within FROM (VALUES (1.0), (0.99), (0.75), (0.5), (0.25), (0.01), (0.0)) AS t(q)")
def _tdigest_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the share of values under each estimate is within half a percent of what was asked for."""
    own = frame(spark, sf_dir)
    digest = own.digest("o_totalprice")
    found = [(q, float(digest.quantile(q) or 0.0)) for q in (1.0, 0.99, 0.75, 0.5, 0.25, 0.01, 0.0)]
    shares = own.df.agg(F.count("*").alias("n"), *(F.count_if(F.col("o_totalprice") <= v).alias(f"c{i}") for i, (_, v) in enumerate(found)))
    return shares.select(F.explode(F.array(*(F.struct(F.expr(f"CAST({q} AS DECIMAL(3,2))").alias("q"), (F.abs(F.col(f"c{i}") / F.col("n") - q) <= 0.005).alias("within")) for i, (q, _) in enumerate(found)))).alias("x")).select("x.q", "x.within")


@query("distinct_hll_bound", "SELECT true AS within")
def _hll_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = frame(spark, sf_dir)
    estimate = own.hyperloglog("o_custkey").count()
    return own.count_distinct("o_custkey").select((F.abs(F.col("distinct_count") - estimate) <= 0.1 * F.col("distinct_count")).alias("within"))


# -- order and samples

query("top_desc", f"{O} ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")(lambda s, d: frame(s, d).top_rows("o_totalprice", 25, True).select(COLS))
query("top_asc", f"{O} ORDER BY o_totalprice, o_orderkey LIMIT 25")(lambda s, d: frame(s, d).top_rows("o_totalprice", 25).select(COLS))
query("top_ties", f"{O} ORDER BY o_custkey DESC, o_orderkey LIMIT 25")(lambda s, d: frame(s, d).top_rows("o_custkey", 25, True).select(COLS))
query("top_with_nulls", "SELECT event_id, value AS x, event_id + 2 AS _row FROM events WHERE event_id % 7 > 0 ORDER BY value DESC, event_id LIMIT 10")(lambda s, d: SheetFrame(events(s, d).df.select("_row", "event_id", F.when(F.col("event_id") % 7 > 0, F.col("value")).alias("x"))).top_rows("x", 10, True))
#: The published generator once more, as a recursion in SQL.
_SAMPLE = """WITH RECURSIVE n AS (SELECT count(*) AS c FROM orders), x(i, s) AS (
  SELECT 0, xor(CAST(42 AS BIGINT), CAST(2654435769 AS BIGINT))
  UNION ALL
  SELECT i + 1, xor(b, (b << 5) & 4294967295) FROM (
    SELECT i, xor(a, a >> 17) AS b FROM (SELECT i, xor(s, (s << 13) & 4294967295) AS a FROM x WHERE i < 200)
  )
), d AS (
  SELECT s % c AS o, min(i) AS i FROM x, n WHERE i > 0 AND s < (4294967296 // c) * c GROUP BY 1 ORDER BY 2 LIMIT 20
)
SELECT o_orderkey, o_custkey, o_totalprice, o_orderkey + 2 AS _row FROM orders JOIN d ON o_orderkey = o"""
query("sample_seed42", _SAMPLE)(lambda s, d: frame(s, d).sample_rows(20, 42).select(COLS))
query("sample_all", O)(lambda s, d: frame(s, d).sample_rows(10**9, 1).select(COLS))

# -- zone maps and plans


def zones(own: SheetFrame) -> DataFrame:
    return build_zone_map(own, ["o_orderkey", "o_totalprice"], EVERY, MONEY)


def _zone_sql(column: str) -> str:
    return f"SELECT '{column}' AS \"column\", o_orderkey // {EVERY} AS block, min(o_orderkey) + 2 AS first_row, max(o_orderkey) + 2 AS last_row, CAST(min({column}) AS DOUBLE) AS min, CAST(max({column}) AS DOUBLE) AS max, CAST(sum(CAST({column} AS DECIMAL(18,2))) AS DOUBLE) AS sum, count({column}) AS count, count(*) - count({column}) AS other FROM orders GROUP BY 2"


_ZONES = f"{_zone_sql('o_orderkey')} UNION ALL {_zone_sql('o_totalprice')}"
query("zone_map", _ZONES)(lambda s, d: zones(frame(s, d)))
query("surviving_blocks", f"WITH z AS ({_ZONES}) SELECT a.block, a.first_row, a.last_row FROM z a JOIN z b ON a.block = b.block AND a.\"column\" = 'o_orderkey' AND b.\"column\" = 'o_totalprice' WHERE a.min <= 4200 AND a.max >= 1500 AND b.max >= 400000")(lambda s, d: surviving_blocks(zones(frame(s, d)), [("o_orderkey", "between", 1500, 4200), ("o_totalprice", ">", 400000)]))


#: Zone maps by session and table, written once as a sheet's index is.
_WRITTEN: dict[tuple[str, str], tuple[DataFrame, int]] = {}


def _index(spark: SparkSession, name: str, build: Callable[[], SheetFrame], columns: list[str]) -> tuple[DataFrame, int]:
    key = spark.sparkContext.applicationId, name
    if key not in _WRITTEN:
        own = build()
        _WRITTEN[key] = stored(build_zone_map(own, columns, EVERY, MONEY), "zones"), own.row_count().first()[0]
    return _WRITTEN[key]


def indexed(spark: SparkSession, sf_dir: str) -> IndexedFrame:
    own = frame(spark, sf_dir)
    kept, rows = _index(spark, f"orders of {sf_dir}", lambda: own, ["o_orderkey", "o_totalprice"])
    return IndexedFrame(own, kept, EVERY, rows, columns=("o_orderkey", "o_totalprice"))


query("pruned_where_all", f"{O} WHERE o_orderkey BETWEEN 1500 AND 4200 AND o_totalprice > 100000")(lambda s, d: indexed(s, d).rows_where_all([("o_orderkey", "between", 4200, 1500), ("o_totalprice", ">", 100000)]).select(COLS))
query("pruned_find_row", f"{O} WHERE o_orderkey = 777")(lambda s, d: indexed(s, d).find_row("o_orderkey", 777).select(COLS))


query("top_pruned", f"{O} ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")(lambda s, d: indexed(s, d).top_rows("o_totalprice", 25, True).select(COLS))
query("top_sorted_pruned", f"{O} ORDER BY o_orderkey DESC LIMIT 25")(lambda s, d: indexed(s, d).top_rows("o_orderkey", 25, True).select(COLS))
query("stats_from_index", _STATS + "(SELECT o_totalprice AS x FROM orders)")(lambda s, d: indexed(s, d).column_stats("o_totalprice", MONEY))


@query("estimated_upper", f"WITH z AS ({_zone_sql('o_orderkey')}) SELECT CAST(sum(count) AS BIGINT) AS upper FROM z WHERE min <= 4200 AND max >= 1500")
def _estimated(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = indexed(spark, sf_dir).estimated_rows("o_orderkey", "between", 1500, 4200)
    return spark.createDataFrame([(found["upper"],)], "upper long")


@query("explain_plan", f"WITH z AS ({_zone_sql('o_orderkey')}) SELECT 'zone-map-prune' AS strategy, count(*) AS candidates, (SELECT count(*) FROM z) - count(*) AS pruned, 1 AS runs, CAST(max(last_row) - min(first_row) + 1 AS BIGINT) AS upper FROM z WHERE min <= 4200 AND max >= 1500")
def _explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = indexed(spark, sf_dir).explain([("o_orderkey", "between", 1500, 4200)])
    return spark.createDataFrame([(x["strategy"], x["candidateBlocks"], x["prunedBlocks"], x["runs"], x["estimatedRows"]["upper"])], "strategy string, candidates long, pruned long, runs int, upper long")


def _pushed_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = frame(spark, sf_dir)
    wide = SheetFrame(own.df.withColumn("g", F.floor(F.col("o_orderkey") / 2500).cast("double")), "_row", [*own.columns, "g"], own.key)
    kept, rows = _index(spark, f"groups of {sf_dir}", lambda: wide, ["g", "o_totalprice"])
    plan = IndexedFrame(wide, kept, EVERY, rows, columns=("g", "o_totalprice"))
    return plan.group_stats("g", "o_totalprice", None, MONEY)


query("group_pushdown", _groups("floor(o_orderkey / 2500.0)"))(_pushed_groups)


@query("full_scan_hook", "SELECT 'rowsWhere' AS query, 'o_custkey' AS \"column\", 'column-not-indexed' AS reason")
def _hooked(spark: SparkSession, sf_dir: str) -> DataFrame:
    told: list[dict] = []
    indexed(spark, sf_dir).on_full_scan(told.append).rows_where("o_custkey", "=", 42)
    return spark.createDataFrame([(t["query"], t["column"], t["reason"]) for t in told], "query string, column string, reason string")


@query("shard_tiling", "WITH c AS (SELECT count(*) + 1 AS n FROM orders), t AS (SELECT i AS shard, 1 + n * i // 8 AS a, n * (i + 1) // 8 AS b FROM c, range(8) AS r(i)) SELECT CAST(shard AS INTEGER) AS shard, count(*) AS n FROM t JOIN orders ON o_orderkey + 2 BETWEEN a AND b GROUP BY 1")
def _tiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = frame(spark, sf_dir)
    return own.shard_of(8, own.row_count().first()[0]).groupBy("shard").agg(F.count("*").alias("n"))


@query("chain_union", "SELECT o_orderkey + 2 AS _row, o_custkey, CASE WHEN o_orderkey < 600 THEN 0 WHEN o_orderkey < 1200 THEN 1 ELSE 2 END AS _member, (CASE WHEN o_orderkey < 600 THEN o_orderkey WHEN o_orderkey < 1200 THEN o_orderkey - 600 ELSE o_orderkey - 1200 END) + 2 AS _local_row FROM orders")
def _chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = frame(spark, sf_dir)
    n = own.df.count()
    cuts = [0, min(600, n), min(1200, n), n]
    parts = [SheetFrame(own.df.where(F.col("o_orderkey").between(a, b - 1)).select((F.col("o_orderkey") - a + 2).alias("_row"), "o_custkey")) for a, b in zip(cuts, cuts[1:], strict=False)]
    return chained(parts, [b - a + 1 for a, b in zip(cuts, cuts[1:], strict=False)]).df


# -- cells

_CELLS = "(2,'1'),(3,'9.95'),(4,'46148'),(5,'46148.5'),(6,'true'),(7,''),(8,NULL),(9,'-1'),(10,'2958466'),(11,'abc'),(12,'0')"
_CELLS_SQL = f"WITH t AS (SELECT CAST(r AS INTEGER) AS _row, x FROM (VALUES {_CELLS}) AS v(r, x)), n AS (SELECT _row, x, CASE WHEN regexp_full_match(x, '{_RX}') THEN TRY_CAST(trim(x) AS DOUBLE) END AS num FROM t)"
_DATED = "make_timestamp(CAST((floor(num) * 86400 + round((num - floor(num)) * 86400) - 2209161600) * 1000000 AS BIGINT))"
for _kind, _sql in {
    "int": "CAST(trunc(num) AS BIGINT)",
    "float": "num",
    "bool": "coalesce(x IN ('1', 'true'), false)",
    "date": f"CASE WHEN num BETWEEN 0 AND 2958465 THEN CAST({_DATED.replace('round((num - floor(num)) * 86400)', '0')} AS DATE) END",
    "datetime": f"CASE WHEN num BETWEEN 0 AND 2958465 THEN {_DATED} END",
}.items():
    query(f"cast_{_kind}", f"{_CELLS_SQL} SELECT _row, {_sql} AS x FROM n")(lambda s, d, k=_kind: SheetFrame(literal(s, _CELLS, "_row, x")).cast_columns({"x": k}).df)
_SERIAL_ALL = f"SELECT event_id, {_SERIAL.format('ts')} AS serial, date_trunc('second', ts + INTERVAL 500 MILLISECOND) AS back FROM events"


def _serials(df: DataFrame) -> DataFrame:
    """Each event's serial, and its second after a way through a serial; seconds are rounded before it, as a serial keeps them exactly but not halves of them."""
    return df.select("event_id", S.serial_of(F.col("ts")).alias("serial"), S.moment_of(S.serial_of(S.whole_seconds(F.col("ts")))).alias("back"))


query("serial_roundtrip", _SERIAL_ALL)(lambda s, d: _serials(events(s, d).df))
_TEXTS = "('007'),('0.5'),('+4'),('12'),('1234567890123456'),('123456789012345'),('abc'),('-5'),('-05'),('1e3'),('')"
query("preserve_numeric_text", f"SELECT x, regexp_full_match(x, '{_RX}') AND (regexp_matches(x, '^[+-]?0[0-9]') OR starts_with(x, '+') OR length(regexp_replace(regexp_replace(x, '[eE].*$', ''), '[^0-9]', '', 'g')) > 15) AS keeps FROM (VALUES {_TEXTS}) AS t(x)")(lambda s, d: literal(s, _TEXTS, "x").select("x", S.keeps_text(F.col("x")).alias("keeps")))
query("column_letters", "SELECT * FROM (VALUES ('A', 0), ('Z', 25), ('AA', 26), ('AZ', 51), ('ZZ', 701), ('AAA', 702), ('XFD', 16383)) AS t(letters, i)")(lambda s, d: literal(s, "('A'),('Z'),('AA'),('AZ'),('ZZ'),('AAA'),('XFD')", "letters").select("letters", S.letters_index_sql("letters").alias("i")))
query("canonical_text", "SELECT * FROM (VALUES (1, '1'), (2, '1.5'), (3, '-7'), (4, NULL)) AS t(i, x)")(lambda s, d: (lambda df: df.select("i", S.canonical_text(df, "v").alias("x")))(literal(s, "(1, 1.0D), (2, 1.5D), (3, -7.0D), (4, CAST(NULL AS DOUBLE))", "i, v")))

# -- workbooks


#: Rows of a workbook when a whole table is written.
BOOK_ROWS = 50_000


def _workbooks(spark: SparkSession, sf_dir: str, **options) -> str:
    """A folder of indexed workbooks that continue each other: all orders."""
    from gridloom.sources.xlsx import register

    register(spark)
    own, folder = frame(spark, sf_dir), shared_folder(spark, "books")
    books = max(4, -(-own.df.count() // BOOK_ROWS))
    rows = own.df.repartitionByRange(books, "o_orderkey").sortWithinPartitions("o_orderkey").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    rows.write.format("sheet").options(sheet="orders", every=200, stats="o_orderkey,o_totalprice", sketches="o_totalprice", **options).mode("append").save(folder)
    return folder


_BOOK = "SELECT o_orderkey + 2 AS _row, CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_totalprice AS o_totalprice__num, o_orderpriority FROM orders"


def _read(spark: SparkSession, path: str) -> DataFrame:
    from gridloom.sources.xlsx import register

    register(spark)
    return spark.read.format("sheet").option("numbers", "o_orderkey,o_totalprice").load(path)


BOOK_COLS = ["_row", "o_orderkey", "o_custkey", "o_totalprice__num", "o_orderpriority"]
query("xlsx_roundtrip", _BOOK)(lambda s, d: _read(s, _workbooks(s, d)).select(BOOK_COLS))
query("xlsx_compact", _BOOK)(lambda s, d: _read(s, _workbooks(s, d, compact=True)).select(BOOK_COLS))
query("xlsx_pruned", f"{_BOOK} WHERE o_orderkey BETWEEN 300 AND 450")(lambda s, d: _read(s, _workbooks(s, d)).where("o_orderkey__num BETWEEN 300 AND 450").select(BOOK_COLS))


def _verified(spark: SparkSession, folder: str) -> DataFrame:
    from gridloom.sources.xlsx import verified

    return verified(spark, folder).groupBy("sheet").agg(F.sum("rows").alias("rows_checked"), F.sum("blocks_checked").alias("blocks_checked"), F.sum(F.size("corrupt_blocks")).cast("int").alias("corrupt"), F.bool_and("sheet_crc_ok").alias("sheet_crc_ok"))


query("verify_clean", "SELECT 'orders' AS sheet, count(*) AS rows_checked, 0 AS corrupt, true AS sheet_crc_ok FROM orders")(lambda s, d: _verified(s, _workbooks(s, d)).drop("blocks_checked"))


__all__ = ["FLAGSHIP", "ORACLES", "QUERIES", "draw_rows"]
