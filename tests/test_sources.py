import pytest

from tabloom.sources.tables import preview, read_table, require_min_rows, require_non_empty, write_table


def write(tmp_path, text):
    path = tmp_path / "in.csv"
    path.write_text(text)
    return str(path)


def test_types_and_missing_tokens(spark, tmp_path):
    path = write(tmp_path, 'a,b,c,d,e,f\n1,1.5,x,True,2023-01-05,NA\n,NaN,"y, ""z""",False,2023-01-06,\n3,2e3,null,True,2023-01-07,n/a\n')
    df = read_table(spark, path)
    assert [f.dataType.simpleString() for f in df.schema] == ["bigint", "double", "string", "boolean", "string", "string"]
    rows = [tuple(r) for r in df.orderBy("e").collect()]
    assert rows[0][:4] == (1, 1.5, "x", True)
    assert rows[1][:4] == (None, None, 'y, "z"', False)
    assert rows[2][1:3] == (2000.0, None)
    assert [r[5] for r in rows] == [None] * 3


def test_given_schema_skips_typing(spark, tmp_path):
    df = read_table(spark, write(tmp_path, "a,b\n1,2\n"), schema="a string, b double")
    assert [tuple(r) for r in df.collect()] == [("1", 2.0)]


def test_empty_inputs_fail(spark, tmp_path):
    with pytest.raises(ValueError):
        read_table(spark, write(tmp_path, ""))
    with pytest.raises(ValueError):
        require_non_empty(read_table(spark, write(tmp_path, "a,b\n")))
    with pytest.raises(Exception):
        read_table(spark, str(tmp_path / "absent.csv"))


def test_round_trip_preview_and_row_guard(spark, tmp_path):
    df = spark.createDataFrame([(i, f'v"{i},') for i in range(7)], "a bigint, b string")
    for fmt in ("csv", "parquet"):
        again = read_table(spark, write_table(df, str(tmp_path / fmt), fmt), fmt)
        assert sorted(map(tuple, again.collect())) == sorted(map(tuple, df.collect()))
    head, rows, cols = preview(df)
    assert (head.count(), rows, cols) == (5, 7, 2)
    assert require_min_rows(df) is df
    with pytest.raises(ValueError):
        require_min_rows(df.limit(1))
