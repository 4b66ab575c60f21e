"""The registered queries of the engine and the SQL that gives the same rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.errors import EngineError, SourceIOError
from quillon.operators.frame import Frame, execute
from quillon.plans.lexer import Lexer
from quillon.plans.types import LSchema
from quillon.render import render
from quillon.session import Session
from quillon.sources.csv import CsvOptions, read_csv, read_csv_text
from quillon.sources.parquet import read_parquet

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
FLAGSHIP = (
    "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS revenue FROM lineitem "
    "WHERE l_returnflag = 'R' AND l_quantity > 10 ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 100"
)
_ITEM_KEY = "l_extendedprice, l_orderkey, l_linenumber, l_partkey"
#: Query text, and the oracle's text where it differs.
TEXTS: dict[str, tuple[str, str | None]] = {
    "scan_wildcard": ("SELECT * FROM nation", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation"),
    "wildcard_and_expression": ("SELECT *, r_regionkey * 10 AS ten FROM region", "SELECT r_regionkey::BIGINT AS r_regionkey, r_name, r_regionkey::BIGINT * 10 AS ten FROM region"),
    "project_columns": ("SELECT c_custkey, c_mktsegment FROM customer", None),
    "project_alias_float": ("SELECT l_orderkey, l_extendedprice * (1 - l_discount) AS revenue FROM lineitem", None),
    "table_alias": ("SELECT c_custkey k, c_acctbal AS b FROM customer AS c", "SELECT c_custkey AS k, c_acctbal AS b FROM customer"),
    "generated_name": ("SELECT o_orderkey + 1, o_custkey, (o_custkey) FROM orders", "SELECT o_orderkey + 1 AS expr_0, o_custkey, o_custkey AS expr_2 FROM orders"),
    "literals": ("SELECT o_orderkey, 7 AS i, 2.5e1 AS f, 'it''s' AS s, TRUE AS b FROM orders", "SELECT o_orderkey, 7::BIGINT AS i, 25.0::DOUBLE AS f, 'it''s' AS s, TRUE AS b FROM orders"),
    "int_arithmetic": ("SELECT o_orderkey, o_orderkey + o_custkey AS a, o_orderkey - o_custkey AS s, o_orderkey * o_custkey AS m FROM orders", None),
    "int_div_mod": ("SELECT o_orderkey, o_orderkey / 7 AS q, -o_orderkey / 7 AS n, -o_orderkey % 7 AS r FROM orders", "SELECT o_orderkey, o_orderkey // 7 AS q, (-o_orderkey) // 7 AS n, (-o_orderkey) % 7 AS r FROM orders"),
    "float_arithmetic": ("SELECT l_orderkey, l_extendedprice / l_quantity AS unit, l_extendedprice - l_tax AS d, l_quantity % 7.0 AS m FROM lineitem", "SELECT l_orderkey, l_extendedprice / l_quantity AS unit, l_extendedprice - l_tax AS d, l_quantity % 7.0::DOUBLE AS m FROM lineitem"),
    "unary": ("SELECT o_orderkey, -o_totalprice AS n, - -o_custkey AS p, +o_orderstatus AS s, NOT o_custkey > 5 AS b FROM orders", "SELECT o_orderkey, -o_totalprice AS n, o_custkey AS p, o_orderstatus AS s, NOT (o_custkey > 5) AS b FROM orders"),
    "coercion_mixed": ("SELECT p_partkey, p_size + p_retailprice AS s FROM part WHERE p_size < p_retailprice", None),
    "precedence": ("SELECT p_partkey, 2 + p_size * 3 - -1 AS v, p_size > 10 AND p_size < 20 OR p_size = 50 AS b FROM part", "SELECT p_partkey, 2 + p_size::BIGINT * 3 + 1 AS v, (p_size > 10 AND p_size < 20) OR p_size = 50 AS b FROM part"),
    **{f"filter_cmp_{n}": (f"SELECT p_partkey FROM part WHERE p_size {op} 25", None) for n, op in (("eq", "="), ("ne", "!="), ("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">="))},
    "filter_string": ("SELECT o_orderkey FROM orders WHERE o_orderpriority >= '3'", None),
    "filter_boolean": ("SELECT p_partkey FROM part WHERE (p_size > 25) = TRUE AND (p_size > 40) < TRUE", None),
    "filter_and_or_not": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT (l_quantity > 10 AND l_tax = 0.0) OR l_discount >= 0.05", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber FROM lineitem WHERE NOT (l_quantity > 10 AND l_tax = 0.0) OR l_discount >= 0.05::DOUBLE"),
    "filter_short_circuit": ("SELECT p_partkey FROM part WHERE p_size <> 25 AND 100 / (p_size - 25) > 3", "SELECT p_partkey FROM part WHERE p_size <> 25 AND 100 // NULLIF(p_size - 25, 0) > 3"),
    "comments": ("SELECT p_partkey -- the key\n  , p_size\tAS \n size -- and its size\nFROM part WHERE p_size > 48 -- large\n;", "SELECT p_partkey, p_size::BIGINT AS size FROM part WHERE p_size > 48"),
    "filter_or_pushed": ("SELECT o_orderkey FROM orders WHERE NOT (o_custkey > 10 AND o_orderkey <> 7) OR o_custkey = 12", None),
    "chain_of_many": ("SELECT p_partkey, " + " + ".join(["p_size"] * 150) + " AS s FROM part", "SELECT p_partkey, 150 * p_size::BIGINT AS s FROM part"),
    "null_is": ("SELECT l_orderkey, flag IS NULL AS n, flag IS NOT NULL AS m FROM flags WHERE flag IS NULL", "SELECT l_orderkey, NULLIF(l_returnflag, 'R') IS NULL AS n, NULLIF(l_returnflag, 'R') IS NOT NULL AS m FROM lineitem WHERE NULLIF(l_returnflag, 'R') IS NULL"),
    "null_is_not": ("SELECT l_orderkey, flag FROM flags WHERE flag IS NOT NULL", "SELECT l_orderkey, l_returnflag AS flag FROM lineitem WHERE l_returnflag <> 'R'"),
    "null_not": ("SELECT l_orderkey FROM flags WHERE NOT (flag = 'A')", "SELECT l_orderkey FROM lineitem WHERE NOT (NULLIF(l_returnflag, 'R') = 'A')"),
    "null_three_valued": ("SELECT l_orderkey, flag = 'A' AND l_quantity > 25 AS a, flag = 'A' OR l_quantity > 25 AS o FROM flags", "SELECT l_orderkey, NULLIF(l_returnflag, 'R') = 'A' AND l_quantity > 25 AS a, NULLIF(l_returnflag, 'R') = 'A' OR l_quantity > 25 AS o FROM lineitem"),
    "null_comparison_is_null": ("SELECT l_orderkey, flag = 'A' IS NULL AS n FROM flags", "SELECT l_orderkey, l_returnflag = 'R' AS n FROM lineitem"),
    "null_propagation": ("SELECT o_orderkey, o_custkey + CAST(NULL AS Int64) AS n FROM orders", "SELECT o_orderkey, CAST(NULL AS BIGINT) AS n FROM orders"),
    "cast_float_int": ("SELECT l_orderkey, CAST(l_extendedprice AS Int64) AS i FROM lineitem", "SELECT l_orderkey, CAST(trunc(l_extendedprice) AS BIGINT) AS i FROM lineitem"),
    "cast_int_float": ("SELECT o_orderkey, CAST(o_custkey AS double) AS f FROM orders", "SELECT o_orderkey, o_custkey::DOUBLE AS f FROM orders"),
    "cast_int_utf8": ("SELECT CAST(o_orderkey AS varchar) AS s FROM orders", "SELECT o_orderkey::VARCHAR AS s FROM orders"),
    "cast_int_bool": ("SELECT p_partkey, CAST(p_size - 25 AS bool) AS b FROM part", "SELECT p_partkey, p_size <> 25 AS b FROM part"),
    "cast_bool_utf8": ("SELECT p_partkey, CAST(p_size > 25 AS text) AS s FROM part", "SELECT p_partkey, CASE WHEN p_size > 25 THEN 'true' ELSE 'false' END AS s FROM part"),
    "cast_utf8_int": ("SELECT CAST(CAST(o_orderkey AS string) AS int) AS i FROM orders", "SELECT o_orderkey AS i FROM orders"),
    "cast_utf8_float": ("SELECT o_orderkey, CAST(CAST(o_custkey AS string) AS float) AS f, CAST('-1.5e3' AS float) AS g FROM orders", "SELECT o_orderkey, o_custkey::DOUBLE AS f, -1500.0::DOUBLE AS g FROM orders"),
    "cast_utf8_bool": ("SELECT p_partkey, CAST(CAST(p_size > 25 AS utf8) AS boolean) AS b FROM part", "SELECT p_partkey, p_size > 25 AS b FROM part"),
    "cast_float_utf8_digits": ("SELECT p_partkey, CAST(p_retailprice / 3.0 AS utf8) AS s FROM part", "SELECT p_partkey, regexp_replace((p_retailprice / 3.0)::VARCHAR, '\\.0$', '') AS s FROM part"),
    "cast_float_utf8": ("SELECT p_partkey, CAST(p_size * 1.0 AS utf8) AS s FROM part", "SELECT p_partkey, p_size::VARCHAR AS s FROM part"),
    "sort_asc": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 50", None),
    "sort_desc": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 50", None),
    "sort_multi": ("SELECT o_orderkey FROM orders ORDER BY o_orderpriority, o_orderstatus DESC, o_orderkey LIMIT 50", None),
    "sort_expr": ("SELECT o_orderkey FROM orders ORDER BY o_custkey % 10 DESC, o_orderkey LIMIT 50", None),
    "sort_stable": ("SELECT c_custkey FROM customer ORDER BY c_mktsegment LIMIT 40", "SELECT c_custkey FROM (SELECT c_custkey, c_mktsegment, row_number() OVER () AS r FROM customer) ORDER BY c_mktsegment, r LIMIT 40"),
    "sort_nulls_first": (f"SELECT l_orderkey, flag FROM flags ORDER BY flag, {_ITEM_KEY} LIMIT 60", f"SELECT l_orderkey, NULLIF(l_returnflag, 'R') AS flag FROM lineitem ORDER BY NULLIF(l_returnflag, 'R') NULLS FIRST, {_ITEM_KEY} LIMIT 60"),
    "sort_nulls_last": (f"SELECT l_orderkey, flag FROM flags ORDER BY flag DESC, {_ITEM_KEY} LIMIT 60", f"SELECT l_orderkey, NULLIF(l_returnflag, 'R') AS flag FROM lineitem ORDER BY NULLIF(l_returnflag, 'R') DESC NULLS LAST, {_ITEM_KEY} LIMIT 60"),
    "order_by_input_not_alias": ("SELECT -o_totalprice AS o_totalprice, o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 20", "SELECT -p AS o_totalprice, o_orderkey FROM (SELECT o_totalprice AS p, o_orderkey FROM orders ORDER BY p, o_orderkey LIMIT 20)"),
    "order_by_constant": ("SELECT o_orderkey FROM orders ORDER BY 1, o_totalprice DESC, o_orderkey LIMIT 5", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5"),
    "topk": (FLAGSHIP, FLAGSHIP.replace("l_linenumber, l_extendedprice *", "l_linenumber::BIGINT AS l_linenumber, l_extendedprice *")),
    "limit_zero": ("SELECT o_orderkey FROM orders LIMIT 0", None),
    "limit_over": ("SELECT o_orderkey FROM orders LIMIT 100000000", None),
    "limit_file_order": ("SELECT event_id FROM events LIMIT 10", None),
    "nan_compare": ("SELECT event_id, x = x AS eq, x <> x AS ne, x > 1.0 AS gt, x <= 1.0 AS le FROM nans WHERE x >= 0.5 OR x <> x", "SELECT event_id, value >= 50 AS eq, value < 50 AS ne, value >= 50 AS gt, FALSE AS le FROM events"),
    "nan_sort": ("SELECT event_id FROM nans ORDER BY x DESC, event_id LIMIT 20", "SELECT event_id FROM events ORDER BY (CASE WHEN value < 50 THEN 'NaN'::DOUBLE ELSE value END) DESC, event_id LIMIT 20"),
}
_CSV = "id,name,active,score\n1,\"Doe, Jane\",true,1.5\n2,\"a \"\"b\"\"\",,2\n3,,FALSE,-inf\n"


def session(spark: SparkSession, sf_dir: str) -> Session:
    """A session over the tables of a folder, with the views that some queries read."""
    s = Session(spark)
    # embeddings and some time stamps have types that the dialect lacks.
    s.register_folder(sf_dir, TABLES, leave_out=True)

    def view(table: str, **columns):
        base = read_parquet(s.spark, f"{sf_dir}/{table}.parquet", leave_out=True)
        df = base.df.withColumns(columns)
        return replace(base, df=df, schema=LSchema.of_spark(df.schema))

    s.register("flags", lambda: view("lineitem", flag=F.nullif(F.col("l_returnflag"), F.lit("R"))))
    s.register("nans", lambda: view("events", x=F.when(F.col("value") < 50, float("nan")).otherwise(F.col("value"))))
    return s


def _csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV text, read strictly, with every inferred type."""
    return read_csv_text(Session(spark).spark, _CSV).df


def _folder(spark: SparkSession) -> str:
    """Where a query may write: the cluster's shared folder; a local session has one of its own."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise SourceIOError("spark.checkpoint.dir must name a folder that all executors share")
    return f"file://{tempfile.mkdtemp(prefix='quillon-')}"


def _csv_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts as a CSV folder written by Spark, read back with inferred types and queried."""
    s = session(spark, sf_dir)
    path = f"{_folder(spark)}/csv-{uuid.uuid4().hex}"
    s.table("part").df.select("p_partkey", "p_name", "p_size", "p_retailprice").write.option("header", True).csv(path)
    return read_csv(s.spark, path).sql("SELECT p_partkey, p_name, p_size + 1 AS n, p_retailprice FROM part WHERE p_size > 10").df


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _text(spark: SparkSession, data: str, options: CsvOptions = CsvOptions()) -> Frame:
    return read_csv_text(Session(spark).spark, data, options)


def _fields(spark: SparkSession, data: str, options: CsvOptions = CsvOptions()) -> DataFrame:
    """The inferred schema of a CSV text, a row for each column."""
    return _rows(spark, [(i, f.name, str(f.type), f.nullable) for i, f in enumerate(_text(spark, data, options).schema)], "nr int, name string, type string, nullable boolean")


def _error(spark: SparkSession, run: Callable[[], object]) -> DataFrame:
    """Which error a call raises, and its record if it has one."""
    try:
        run()
    except EngineError as error:
        return _rows(spark, [(type(error).__name__, getattr(error, "line", None))], "error string, line long")
    return _rows(spark, [("none", None)], "error string, line long")


def _ragged_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record that a file of the nations has wrong, read by the default reader."""
    s = session(spark, sf_dir)
    path = f"{_folder(spark)}/ragged-{uuid.uuid4().hex}"
    lines = s.spark.sql("SELECT explode(array('a,b', '1,2', '3,4', '5', '6,7')) AS value").coalesce(1)
    lines.write.text(path)
    return _error(spark, lambda: read_csv(s.spark, path))


def _negative_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zeros of either sign tie in a sort, and stay as they came."""
    df = Session(spark).spark.createDataFrame([(1, 0.0), (2, -0.0), (3, -1.0), (4, 0.0), (5, -0.0)], "i long, x double").coalesce(1)
    kept = [r.i for r in Frame.of(df).sql("SELECT i FROM t ORDER BY x").collect()]
    return _rows(spark, list(enumerate(kept)), "nr int, i long")


def _sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that the text sink prints of the regions."""
    said = render(session(spark, sf_dir).query("SELECT r_regionkey AS k, r_name AS name, r_regionkey > 1 AS b FROM region ORDER BY r_regionkey"))
    return _rows(spark, list(enumerate(said.splitlines())), "nr int, line string")


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of a text with their kinds, what they are called in messages, and their spans."""
    tokens = Lexer("SELECT a -- b\n, 'é', 1.5 FROM t WHERE x != 2").tokenize()
    return _rows(spark, [(i, t.kind, str(t).replace("'", "`"), str(t.span)) for i, t in enumerate(tokens)], "nr int, kind string, said string, span string")


def _memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that the caller holds, whatever name the text gives it."""
    df = Session(spark).spark.createDataFrame([(1, "x", 2.5), (2, None, None), (3, "y", -1.0)], "a int, b string, c double")
    return execute("SELECT a * 2 AS d, b IS NULL AS n, c FROM any_name WHERE a < 3", df)


def _values(columns: str, *rows: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join(rows)}) AS t({columns})"


_SCHEMA, _ERROR = "nr, name, type, nullable", "error, line"
_EXTRA = {
    "csv_has_header": (lambda spark, _: _text(spark, "1,x\n2,y\n", CsvOptions(has_header=False)).df, _values("col_0, col_1", "(1::BIGINT, 'x')", "(2, 'y')")),
    "csv_delimiter_null_literal": (lambda spark, _: _text(spark, "id;tag\n1;NA\n2;\n3;x;y\n".replace(";y", ""), CsvOptions(delimiter=";", null_literal="NA")).df, _values("id, tag", "(1::BIGINT, NULL)", "(2, '')", "(3, 'x')")),
    "csv_infer_rows": (lambda spark, _: _fields(spark, "a,b\n1,1\n2,x\n3,\n", CsvOptions(infer_rows=2)), _values(_SCHEMA, "(0::INTEGER, 'a', 'Int64', FALSE)", "(1, 'b', 'Utf8', TRUE)")),
    "csv_infer_rows_wrong": (lambda spark, _: _error(spark, lambda: _text(spark, "a\n1\n2\nx\n", CsvOptions(infer_rows=2)).collect()), _values(_ERROR, "('CsvError', 4::BIGINT)")),
    "csv_nullability": (lambda spark, _: _fields(spark, "a,b,c,d\n1,true,,0.5\n2,,,1\n"), _values(_SCHEMA, "(0::INTEGER, 'a', 'Int64', FALSE)", "(1, 'b', 'Boolean', TRUE)", "(2, 'c', 'Utf8', TRUE)", "(3, 'd', 'Float64', FALSE)")),
    "csv_ragged": (_ragged_file, _values(_ERROR, "('CsvError', 4::BIGINT)")),
    "csv_empty": (lambda spark, _: _fields(spark, ""), _values(_SCHEMA, "(0::INTEGER, 'a', 'b', TRUE)") + " WHERE FALSE"),
    "csv_header_only": (lambda spark, _: _fields(spark, "id,name\n"), _values(_SCHEMA, "(0::INTEGER, 'id', 'Utf8', TRUE)", "(1, 'name', 'Utf8', TRUE)")),
    "csv_duplicate_header": (lambda spark, _: _error(spark, lambda: _text(spark, "a,a\n1,2\n")), _values(_ERROR, "('SchemaError', NULL::BIGINT)")),
    "csv_tokenizer": (lambda spark, _: _text(spark, 'a,b\r\nx"1,2"y,"p\nq"\r\n"",z').df, _values("a, b", "('x1,2y', 'p' || chr(10) || 'q')", "(NULL, 'z')")),
    "memory_source": (_memory, _values("d, n, c", "(2::BIGINT, FALSE, 2.5::DOUBLE)", "(4, TRUE, NULL)")),
    "text_sink": (_sink, _values("nr, line", "(0::INTEGER, '| k | name        | b     |')", "(1, '|---|-------------|-------|')", "(2, '| 0 | AFRICA      | false |')", "(3, '| 1 | AMERICA     | false |')", "(4, '| 2 | ASIA        | true  |')", "(5, '| 3 | EUROPE      | true  |')", "(6, '| 4 | MIDDLE EAST | true  |')")),
    "sort_negative_zero": (_negative_zero, _values("nr, i", "(0::INTEGER, 3::BIGINT)", "(1, 1)", "(2, 2)", "(3, 4)", "(4, 5)")),
    "reserved_words": (lambda spark, sf_dir: _error(spark, lambda: session(spark, sf_dir).sql("SELECT n_nationkey AS having FROM nation")), _values(_ERROR, "('SqlSyntaxError', NULL::BIGINT)")),
    "token_printing": (_tokens, _values("nr, kind, said, span", "(0::INTEGER, 'keyword', 'SELECT', '0..6')", "(1, 'word', 'identifier `a`', '7..8')", "(2, 'symbol', ',', '14..15')", "(3, 'string', 'string `é`', '16..20')", "(4, 'symbol', ',', '20..21')", "(5, 'number', '1.5', '22..25')", "(6, 'keyword', 'FROM', '26..30')", "(7, 'word', 'identifier `t`', '31..32')", "(8, 'keyword', 'WHERE', '33..38')", "(9, 'word', 'identifier `x`', '39..40')", "(10, 'symbol', '<>', '41..43')", "(11, 'number', '2', '44..45')", "(12, 'end', 'end of input', '45..45')")),
    "csv_scan": (_csv_scan, "SELECT * FROM (VALUES (1::BIGINT, 'Doe, Jane', TRUE, 1.5::DOUBLE), (2, 'a \"b\"', NULL, 2.0), (3, NULL, FALSE, '-inf'::DOUBLE)) AS t(id, name, active, score)"),
    "csv_file": (_csv_file, "SELECT p_partkey, p_name, p_size::BIGINT + 1 AS n, p_retailprice FROM part WHERE p_size > 10"),
}


def _runner(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: session(spark, sf_dir).sql(text)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: _runner(t) for n, (t, _) in TEXTS.items()} | {n: f for n, (f, _) in _EXTRA.items()}
ORACLE_SQL: dict[str, str] = {n: o or t for n, (t, o) in TEXTS.items()} | {n: o for n, (_, o) in _EXTRA.items()}
