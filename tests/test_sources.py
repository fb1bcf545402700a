import pytest

from clearwell.sources import delimited as I
from clearwell.sources.names import normalize_columns, normalize_names
from clearwell.sources.tables import with_row_key

PROBLEM = """id,nombre,email,edad
1,Ana,ana@x.com,28
2,  Luis  ,,  
3,"Paz, Eva",eva@x.com,45,-10
4,Juan,NA,31
5,Rosa
"""


def write(folder, name, text, encoding="utf-8"):
    path = folder / name
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_names():
    assert normalize_names(["A-B", "A@B", "123column", "_validColumn", "Unnamed: 0"]) == [
        "AB", "AB_2", "_123column", "_validColumn", "Column_5"]
    assert normalize_names(["nombre", "nombre", "NOMBRE", "nombre-data"]) == ["nombre", "nombre_2", "NOMBRE_3", "nombredata"]
    assert normalize_names(["A", "A", "A_2", "", " a b "]) == ["A", "A_2", "A_2_2", "Column_4", "a_b"]


def test_normalize_columns(spark):
    assert normalize_columns(spark.createDataFrame([(1, 2)], "`x y` int, `1` int")).columns == ["x_y", "_1"]


def test_detection(spark, tmp_path):
    write(tmp_path, "a.csv", "nombre;correo\nJuan;a@b.com\n")
    write(tmp_path, "b.csv", "c1;c2;c3;c4\n1;2;3;4\n5;6;7;8\n1,2;3;4\n")
    write(tmp_path, "c.csv", "año,b\ncañón,1\n", "latin-1")
    write(tmp_path, "d.csv", "solo\nuno\n")
    write(tmp_path, "e.csv", 'a,b\n"x;y;z",1\n"p""q,r",2\n')
    found = {r["path"][-5:]: r for r in I.detect_delimiter(spark, str(tmp_path)).collect()}
    assert [found[k]["sep"] for k in sorted(found)] == [";", ";", ",", None, ","]
    assert found["b.csv"]["consistent_rows"] == 3 and found["b.csv"]["score"] == pytest.approx(79)
    assert found["e.csv"]["stability"] == 1.0
    encodings = {r["path"][-5:]: r["encoding"] for r in I.detect_encoding(spark, str(tmp_path)).collect()}
    assert encodings["c.csv"] == "latin-1" and encodings["a.csv"] == "utf-8"


def test_malformed_rows(spark, tmp_path):
    path = write(tmp_path, "p.csv", PROBLEM.replace("4,Juan", "\n4,Juan"))
    counts, sample = I.malformed_rows(spark, path, ",")
    row = counts.first()
    assert (row["rows"], row["short_rows"], row["long_rows"]) == (5, 1, 1)
    got = [(r["line_number"], r["expected_columns"], r["actual_columns"]) for r in sample.orderBy("line_number").collect()]
    assert got == [(4, 4, 5), (7, 4, 2)]


def test_permissive_read(spark, tmp_path):
    df = I.read_delimited(spark, write(tmp_path, "p.csv", PROBLEM))
    rows = {r["id"]: r for r in df.collect()}
    assert set(rows) == {1, 2, 4, 5} and df.count() == 4
    assert rows[2]["nombre"] == "  Luis  " and rows[2]["email"] is None and rows[4]["email"] is None
    assert rows[5]["edad"] is None and dict(df.dtypes)["id"] == "bigint" and dict(df.dtypes)["edad"] == "string"


def test_strict_read(spark, tmp_path):
    path = write(tmp_path, "p.csv", PROBLEM)
    with pytest.raises(Exception, match="(?i)malformed"):
        I.read_delimited(spark, path, mode="strict", infer=False).collect()
    with pytest.raises(ValueError):
        I.read_delimited(spark, path, mode="other")


def test_types(spark, tmp_path):
    df = I.read_delimited(spark, write(tmp_path, "t.csv", "a,b,c,d,e\n1,1.5,true,x,\n+2,,False,2,\n"))
    assert dict(df.dtypes) == {"a": "bigint", "b": "double", "c": "boolean", "d": "string", "e": "string"}


def test_latin_header_and_spaces_in_paths(spark, tmp_path):
    df = I.read_delimited(spark, write(tmp_path, "c d.csv", "año,b\ncañón,1\n", "latin-1"))
    assert df.columns == ["año", "b"] and df.first()["año"] == "cañón"


def test_byte_order_mark(spark, tmp_path):
    df = I.read_delimited(spark, write(tmp_path, "bom.csv", "﻿id,b\n1,2\n"))
    assert df.columns == ["id", "b"] and df.first()["id"] == 1


def test_batch(spark, tmp_path):
    write(tmp_path, "a.csv", "x,y\n1,2\n3,4\n")
    write(tmp_path, "b.csv", "x;y\n1;2\n")
    write(tmp_path, "c.csv", "x,y\n5,6\n")
    write(tmp_path, "bad.csv", "solo\nuno\n")
    frames, errors = I.read_batch(spark, str(tmp_path))
    assert sorted(f.count() for f in frames) == [1, 3] and len(errors) == 1
    with pytest.raises(I.DelimitedReadError):
        I.read_delimited(spark, str(tmp_path))
    with pytest.raises(I.DelimitedReadError):
        I.read_delimited(spark, str(tmp_path / "bad.csv"))


def test_row_keys(spark, tmp_path):
    spark.range(100).repartition(3).write.parquet(str(tmp_path / "t"))
    keyed = with_row_key(spark.read.parquet(str(tmp_path / "t")))
    assert keyed.select("row_key").distinct().count() == 100
    with pytest.raises(ValueError):
        with_row_key(spark.range(5))


def test_quoted_line_breaks(spark, tmp_path):
    path = tmp_path / "q.csv"
    path.write_text('id,t,n\n1,"a\nb ""x"", c",2\n3,c,4\n5,"d\n\ne",6\n', encoding="utf-8")
    rows = [tuple(r) for r in I.read_delimited(spark, str(path)).orderBy("id").collect()]
    assert rows == [(1, 'a\nb "x", c', 2), (3, "c", 4), (5, "d\n\ne", 6)]
    counts, sample = I.malformed_rows(spark, str(path), ",")
    assert tuple(counts.first())[1:] == (3, 3, 0, 0) and sample.count() == 0
    path.write_text('id,t,n\n1,"a\nb",2\n3,c,4,9\n', encoding="utf-8")
    counts, sample = I.malformed_rows(spark, str(path), ",")
    assert tuple(counts.first())[1:] == (3, 2, 0, 1)
    assert [(r["line_number"], r["actual_columns"], r["content"]) for r in sample.collect()] == [(4, 4, "3,c,4,9")]


def test_records_across_blocks_of_a_file(spark, tmp_path):
    body = "".join(f'{i},"line one of {i}\nline two\nthree, four",x\n' if i % 3 else f"{i},plain,y\n" for i in range(3000))
    (tmp_path / "b.csv").write_text("id,t,n\n" + body)
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        counts, _ = I.malformed_rows(spark, str(tmp_path / "b.csv"), ",")
        assert tuple(counts.first())[1:] == (3, 3000, 0, 0)
        assert I.detect_delimiter(spark, str(tmp_path / "b.csv")).first()["column_count"] == 3
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_wide_and_windows_encodings(spark, tmp_path):
    (tmp_path / "w.csv").write_bytes("id,té\n1,año €\n2,b\n".encode("utf-16"))
    got = [tuple(r) for r in I.read_delimited(spark, str(tmp_path / "w.csv"), encoding="utf-16", normalize=False).orderBy("id").collect()]
    assert got == [(1, "año €"), (2, "b")]
    (tmp_path / "c.csv").write_bytes("id,precio\n1,12 €\n2,“é”\n".encode("cp1252"))
    got = [tuple(r) for r in I.read_delimited(spark, str(tmp_path / "c.csv"), encoding="cp1252").orderBy("id").collect()]
    assert got == [(1, "12 €"), (2, "“é”")]


@pytest.fixture
def small_blocks(spark):
    """Files are cut every few hundred bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = [spark.conf.get(n) for n in names]
    for n in names:
        spark.conf.set(n, "700")
    yield
    for n, v in zip(names, old, strict=True):
        spark.conf.set(n, v)


def _rows(spark, path, **options):
    return sorted(tuple(r) for r in I.read_delimited(spark, str(path), infer=False, **options).collect())


def _random_csv(seed, newline="\n"):
    """Quoted fields with separators, escaped quotes, line breaks and lines that look like records; stray quotes in plain ones."""
    import csv
    import io
    import random

    rng = random.Random(seed)
    bits = ["a", "7", ",", '"', '""', "\n", '\n1,"x', '",', " ", "é", 'in"side']
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=newline)
    writer.writerow(["id", "t", "n"])
    rows = []
    for i in range(300):
        row = (f"{i:04d}", "".join(rng.choice(bits) for _ in range(rng.randrange(8))) + "z", rng.choice(["k", "two\nlines", "3"]))
        rows.append(row)
        if rng.random() < 0.2:  # a stray quote inside and at the end of a plain field
            out.write(f'{i:04d},5" pipe 6",{row[2].replace(chr(10), " ")}{newline}')
            rows[-1] = (row[0], '5" pipe 6"', row[2].replace("\n", " "))
        else:
            writer.writerow(row)
    return out.getvalue(), rows


@pytest.mark.parametrize("seed", [1, 2])
def test_quoted_files_are_read_by_many_tasks(spark, tmp_path, small_blocks, seed):
    text, rows = _random_csv(seed)
    write(tmp_path, "q.csv", text)
    layout, = I.layouts(spark, str(tmp_path), sep=",")[0]
    assert layout.multi_line
    lines = I.read_lines(spark, str(tmp_path), line_sep="\n")
    assert lines.select("block").distinct().count() > 5 and lines.rdd.getNumPartitions() > 5
    plan = I.scan(spark, layout)._jdf.queryExecution().executedPlan().toString()
    assert "FileScan text" in plan and "FileScan csv" not in plan
    assert _rows(spark, tmp_path / "q.csv", sep=",", null_tokens=()) == rows
    assert _rows(spark, tmp_path / "q.csv", sep=",", null_tokens=(), mode="strict") == rows


def test_quoted_files_read_as_one_task_reads_them(spark, tmp_path, small_blocks):
    """Carriage returns before line feeds, blank lines, short and long records, another encoding, and files side by side."""
    body = 'id,t,n\r\n1,"a\r\nb, ""c""",é\r\n\r\n2,short\r\n3,"x\r\ny",long,1\r\n' + "".join(f'{i},"año {i}\r\nmás",z\r\n' for i in range(10, 120))
    write(tmp_path, "w.csv", body, "latin-1")
    whole = _rows(spark, tmp_path / "w.csv", multi_line=True)
    cut = [tuple(None if v is None else v.replace("\r\n", "\n") for v in r) for r in _rows(spark, tmp_path / "w.csv")]
    assert cut == whole and ("2", "short", None) in cut and not [r for r in cut if r[0] == "3"] and len(cut) == 112
    with pytest.raises(Exception, match="(?i)malformed"):
        _rows(spark, tmp_path / "w.csv", mode="strict")
    folder = tmp_path / "many"
    folder.mkdir()
    write(folder, "a.csv", 'id,t,n\n1,"a\nb",c\n')
    write(folder, "b.csv", "id,t,n\n2,plain,c\n")
    write(folder, "c.csv", 'id,t,n\r3,"d\re",f\r4,g,h\r')
    got = _rows(spark, folder)
    assert [r[0] for r in got] == ["1", "2", "3", "4"] and got[0][1] == "a\nb" and got[2][2] == "f"
    frames, errors = I.read_batch(spark, str(folder))
    assert not errors and sum(f.count() for f in frames) == 4 and all("source_name" in f.columns for f in frames)


def test_a_quote_that_never_closes(spark, tmp_path):
    write(tmp_path, "o.csv", 'id,t,n\n1,"open,2\n3,b,4\n')
    assert _rows(spark, tmp_path / "o.csv", sep=",") == _rows(spark, tmp_path / "o.csv", sep=",", multi_line=True)
