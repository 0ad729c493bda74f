"""Readers, writers and plans for files."""

import pytest

from assize.sources import files


def test_probe_and_contract(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Nome;Data Decisão\nAna;2020\n", encoding="utf-8")
    encoding, separator, header = files.probe(spark, str(tmp_path / "a.csv"))
    assert (encoding, separator, header) == ("UTF-8", ";", ["Nome", "Data Decisão"])
    files.require_header(header, ["NOME", "Data decisao"], "a")
    with pytest.raises(ValueError, match="header"):
        files.require_header(header, ["Nome"], "a")


def test_latin1_body_under_a_plain_header(spark, tmp_path):
    (tmp_path / "b.csv").write_bytes("Nome;Orgao\n".encode() + b"x;y\n" * 2000 + "José;São\n".encode("latin-1"))
    assert files.probe(spark, str(tmp_path / "b.csv")) == ("ISO-8859-1", ";", ["Nome", "Orgao"])


def test_aliases(spark):
    df = spark.createDataFrame([("1", "2")], "valor string, cnpj string")
    assert files.by_alias(df, {"amount": ["vr", "valor"], "name": ["nome"]}).first().asDict() == {"amount": "1", "name": None}


def test_replaced_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, 2019), (2, 2020)], "v int, y int").write.partitionBy("y").parquet(path)
    files.replace_partitions(spark.createDataFrame([(9, 2020)], "v int, y int"), path, ["y"])
    assert {(r["v"], r["y"]) for r in spark.read.parquet(path).collect()} == {(1, 2019), (9, 2020)}


def test_manifest_and_plan(spark, tmp_path):
    for name, body in (("a", "1"), ("b", "2"), ("c", "3")):
        (tmp_path / name).write_text(body)
    found = files.manifest(spark, str(tmp_path))
    known = spark.createDataFrame([("a", found.where("file = 'a'").first()["sha256"]), ("b", "old"), ("z", "x")], "file string, sha256 string")
    assert {r["file"]: r["action"] for r in files.sync_plan(found, known).collect()} == {"a": "skip", "b": "refresh", "c": "add", "z": "gone"}


def test_html_rows(spark):
    df = spark.createDataFrame([(1, "<table><tr><th>A</th></tr>\n<tr><td>x <b>y</b></td><td>z</td></tr></table>")], "k int, html string")
    assert [(r["number"], r["cells"]) for r in files.movements(df, "html", "k").collect()] == [(0, ["A"]), (1, ["x y", "z"])]


def test_unique_keys(spark):
    from assize.operators.builders import assert_unique

    assert assert_unique(spark.createDataFrame([(1,), (2,)], "k int"), "k").count() == 2
    with pytest.raises(Exception, match="repeated"):
        assert_unique(spark.createDataFrame([(1,), (1,)], "k int"), "k").collect()


def test_union_and_json(spark, tmp_path):
    one, two = spark.createDataFrame([("a",)], "x string"), spark.createDataFrame([("b", "c")], "y string, z string")
    rows = files.union_sources([("one", one, {"x": "name"}), ("two", two, {"y": "name", "z": "note"})]).collect()
    assert {tuple(r) for r in rows} == {("a", None, "one"), ("b", "c", "two")}
    files.write_json_lines(one, str(tmp_path / "j"))
    assert files.read_json_lines(spark, str(tmp_path / "j"), "x string").first()["x"] == "a"
    files.write_table(two, str(tmp_path / "p"), ["y"])
    assert spark.read.parquet(str(tmp_path / "p")).count() == 1


def test_positional_rows_and_members(spark, tmp_path):
    (tmp_path / "p.csv").write_text('1;a;"x;y";\n2;b\n3;c;z\n4;d;;w\n', encoding="utf-8")
    rows = files.read_positional(spark, str(tmp_path / "p.csv"), ["k", "name", "note", "more"], 3)
    assert sorted(map(tuple, rows.collect())) == [("1", "a", "x;y", None), ("3", "c", "z", None), ("4", "d", None, "w")]
    value = lambda *v: spark.createDataFrame([(x,) for x in v], "value string")
    kept = files.keep_members(rows, {"k": value("1", "1", None), "name": value("a", "d")})
    assert sorted(r.k for r in kept.collect()) == ["1", "4"]


def test_lookup_last_line_wins(spark, tmp_path):
    (tmp_path / "l.csv").write_text("01;First\n02; Second \n;none\n01;Last\nalone\n", encoding="utf-8")
    assert dict(map(tuple, files.read_lookup(spark, str(tmp_path / "l.csv")).collect())) == {"01": "Last", "02": "Second"}


def test_clean_csv_quotes_texts_only(spark, tmp_path):
    path = str(tmp_path / "c")
    files.write_clean_csv(spark.createDataFrame([(1, ' a,"b" ', 0.5), (2, None, None)], "k int, t string, v double").coalesce(1), path)
    (part,) = (tmp_path / "c").glob("*.csv")
    assert part.read_text().splitlines() == ['"k","t","v"', '1," a,""b"" ",0.5', '2,"",']


def test_audit_records_are_added(spark, tmp_path):
    path = str(tmp_path / "audit")
    for n in (1, 2):
        files.append_audit(spark.createDataFrame([("f.csv", n)], "file string, rows int"), path)
    assert sorted(r.rows for r in spark.read.json(path).collect()) == [1, 2]
