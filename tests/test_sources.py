"""CSV, the catalog, the renderer, the prompt and streams."""

import io

import pytest

from quillon.errors import CsvError, SchemaError, SourceIOError, SqlTypeError
from quillon.plans.types import LType
from quillon.render import render
from quillon.repl import loop
from quillon.session import Session
from quillon.sources.csv import CsvOptions, read_csv, read_csv_text, records_of
from quillon.sources.parquet import read_parquet
from quillon.streaming import stream

I, F, S, B = LType.INT64, LType.FLOAT64, LType.UTF8, LType.BOOLEAN


@pytest.fixture(scope="module")
def session(spark):
    return Session(spark)


def fields(frame):
    return [(f.name, f.type, f.nullable) for f in frame.schema]


def test_records():
    split = lambda t, d=",": list(records_of(t, d))
    assert split("a,b\r\n1,2\r\n") == [["a", "b"], ["1", "2"]]
    assert split('a,"x ""y"" z"\n"p\nq",') == [["a", 'x "y" z'], ["p\nq", ""]]
    assert split('ab"c,d"e,f') == [["abc,de", "f"]]
    assert split('x\n\ny\n"open, ') == [["x"], [""], ["y"], ["open, "]]
    assert split("a;b", ";") == [["a", "b"]] and split("") == []


CASES = [
    ("id,name,active,score\n1,Al,true,1.5\n2,Bo,,2\n3,Cy,FALSE,3\n", [("id", I, False), ("name", S, False), ("active", B, True), ("score", F, False)], 3),
    ("id,tag\n1,\n2,\n", [("id", I, False), ("tag", S, True)], 2),
    ("a,b\n+5,9223372036854775808\n-1,nan\n", [("a", I, False), ("b", F, False)], 2),
    ("a,b\n 1,true\n2,1\n", [("a", S, False), ("b", S, False)], 2),
    ('a,b\n"x,y","q ""z"""\n', [("a", S, False), ("b", S, False)], 1),
    ("a,b\n", [("a", S, True), ("b", S, True)], 0),
]


@pytest.mark.parametrize("data,schema,n", CASES)
def test_readers_agree(session, tmp_path, data, schema, n):
    path = tmp_path / "t.csv"
    path.write_text(data)
    text = read_csv_text(session.spark, data)
    native = read_csv(session.spark, str(path))
    strict = read_csv(session.spark, str(path), CsvOptions(strict=True))
    assert fields(text) == fields(native) == fields(strict) == schema
    rows = [list(map(repr, f.collect())) for f in (text, native, strict)]
    assert rows[0] == rows[1] == rows[2] and len(rows[0]) == n


def test_options(session, tmp_path):
    f = read_csv_text(session.spark, "id;tag\nNA;NA\n2;\n3;x\n", CsvOptions(delimiter=";", null_literal="NA"))
    assert fields(f) == [("id", I, True), ("tag", S, True)] and [tuple(r) for r in f.collect()] == [(None, None), (2, ""), (3, "x")]
    path = tmp_path / "o.csv"
    path.write_text("1,NA\n2,\n")
    f = read_csv(session.spark, str(path), CsvOptions(has_header=False, null_literal="NA"))
    assert f.schema.names == ["col_0", "col_1"] and [tuple(r) for r in f.collect()] == [(1, None), (2, "")]


def test_sampled_inference(session):
    f = read_csv_text(session.spark, "val\n1\n2\n3.5\n", CsvOptions(infer_rows=2))
    with pytest.raises(CsvError) as error:
        f.collect()
    assert error.value.line == 4
    f = read_csv_text(session.spark, "val\n1\n2\n\n", CsvOptions(infer_rows=2))
    assert fields(f) == [("val", I, True)] and [r.val for r in f.collect()] == [1, 2, None]


def test_malformed(session, tmp_path):
    with pytest.raises(CsvError) as error:
        read_csv_text(session.spark, "a,b\n1,2\n1,2,3\n")
    assert error.value.line == 3
    with pytest.raises(SchemaError):
        read_csv_text(session.spark, "a,a\n1,2\n")
    assert len(read_csv_text(session.spark, "").schema) == 0
    path = tmp_path / "r.csv"
    for data in ("a,b\n1,2\n1,2,3\n", "a,b\n1,2\n1\n"):
        path.write_text(data)
        for options in (CsvOptions(), CsvOptions(strict=True)):
            with pytest.raises(CsvError):
                read_csv(session.spark, str(path), options).collect()
    path.write_bytes(b"a,b\n\xff,2\n")
    with pytest.raises(SourceIOError):
        read_csv(session.spark, str(path), CsvOptions(strict=True))
    with pytest.raises(SourceIOError):
        read_csv(session.spark, str(tmp_path / "none.csv"))
    with pytest.raises(SourceIOError):
        session.query("SELECT a FROM none")


def test_render(session):
    f = read_csv_text(session.spark, "region,amount\nNorth,1.50\nS,\n")
    assert render(f) == "| region | amount |\n|--------|--------|\n| North  | 1.5    |\n| S      | NULL   |\n"


def test_prompt(session, tmp_path):
    (tmp_path / "sales.csv").write_text("region,amount\nNorth,100\nSouth,50\n")
    out = io.StringIO()
    loop(session, io.StringIO("\nSELECT region FROM sales WHERE amount > 60\nSELECT FROM\nSELECT a FROM none\nQUIT\n"), out, tmp_path)
    said = out.getvalue()
    assert "| North  |" in said and "Returned 1 rows" in said and said.count("Error:") == 2 and said.rstrip().endswith("Goodbye!")


def test_stream(spark, session, tmp_path):
    rows = spark.createDataFrame([(i, f"n{i}") for i in range(10)], "a long, b string")
    rows.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = stream("SELECT a * 2 AS d FROM s WHERE a > 6", source).writeStream.format("memory").queryName("out").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r.d for r in spark.sql("SELECT * FROM out").collect()) == [14, 16, 18]
    with pytest.raises(SqlTypeError):
        stream("SELECT a FROM s ORDER BY a", source)


def test_lines_are_looked_through(session, tmp_path):
    def read(data, options=CsvOptions()):
        (tmp_path / "x.csv").write_bytes(data.encode())
        return read_csv(session.spark, str(tmp_path / "x.csv"), options)

    # Quotes inside a cell and blank records are taken as the strict reader takes them.
    assert [tuple(r) for r in read('a,b\nx"1,2"y,3\n').collect()] == [("x1,2y", 3)]
    assert [r.a for r in read("a\n1\n\n2\n").collect()] == [1, None, 2]
    assert [tuple(r) for r in read('a,b\r\n"x\ny",1\r\nz,2').collect()] == [("x\ny", 1), ("z", 2)]
    for data, line in (("a,b\n1,2\n\n3,4\n", 3), ('a,b\n1,2\n"x,y",2\n3\n', 4), ("a,b\n1,2,3\n1\n", 2)):
        with pytest.raises(CsvError) as error:
            read(data)
        assert error.value.line == line


def test_record_numbers_over_many_blocks(session, tmp_path):
    (tmp_path / "b.csv").write_text("a,b\n" + "".join(f"{i},x\n" for i in range(2000)) + "1\n" + "5,y\n" * 2000)
    before = session.spark.conf.get("spark.sql.files.maxPartitionBytes")
    session.spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        with pytest.raises(CsvError) as error:
            read_csv(session.spark, str(tmp_path / "b.csv"))
        (tmp_path / "c.csv").write_text("a\n" + "1\n" * 3000 + "x\n" * 3000)
        # The first records decide, wherever Spark begins to read.
        assert fields(read_csv(session.spark, str(tmp_path / "c.csv"), CsvOptions(infer_rows=3000))) == [("a", I, False)]
        assert fields(read_csv(session.spark, str(tmp_path / "c.csv"), CsvOptions(infer_rows=3001))) == [("a", S, False)]
    finally:
        session.spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert error.value.line == 2002


def test_parquet_columns_of_other_types(session, spark, tmp_path):
    spark.createDataFrame([(1, [2.0])], "a long, b array<double>").write.parquet(str(tmp_path / "p"))
    with pytest.raises(SchemaError):
        read_parquet(session.spark, str(tmp_path / "p"))
    assert read_parquet(session.spark, str(tmp_path / "p"), leave_out=True).schema.names == ["a"]


def test_bare_limit_reads_few_files(session, spark, tmp_path):
    spark.range(0, 9000, 1, 30).selectExpr("id", "id % 7 AS k").write.parquet(str(tmp_path / "p"))
    frame = read_parquet(session.spark, str(tmp_path / "p"))
    first = frame.sql("SELECT id FROM t LIMIT 250")
    assert "file_path" in first.df._jdf.queryExecution().optimizedPlan().toString()
    every = [r.id for r in frame.df.orderBy("_metadata.file_path", "_metadata.row_index").collect()]
    assert [r.id for r in first.collect()] == every[:250]
    assert [r.id for r in frame.sql("SELECT id FROM t WHERE k = 3 LIMIT 60").collect()] == [i for i in every if i % 7 == 3][:60]
    assert frame.sql("SELECT id FROM t WHERE id < 0 LIMIT 60").collect() == []
    assert len(frame.sql("SELECT id FROM t LIMIT 8999").collect()) == 8999
