"""Uploads, results, profiles and federations."""

import zipfile

import pytest

from tessera.operators import predicates, profile, sets
from tessera.plans.catalog import Catalog
from tessera.plans.federate import Federation, Logical, Member, check_combined, semijoin_keys
from tessera.plans.spec import Refusal
from tessera.sources import databases, ingest, results


def test_csv_upload(spark, tmp_path):
    path = tmp_path / "Sales 2024.csv"
    path.write_text("Report of sales\n\nId;Name;Amount;Paid;Day\n1;Ann;$1,200.50;yes;2024-01-05\n2;Bob;$0;no;2024-02-06\n;;;;\nTotal;;$1,200.50;;\n", encoding="utf-8")
    df = ingest.ingest(spark, [str(path)])["sales_2024"]
    assert dict(df.dtypes) == {"id": "bigint", "name": "string", "amount": "double", "paid": "boolean", "day": "date"}
    assert [(r.id, r.amount, r.paid) for r in df.orderBy("id").collect()] == [(1, 1200.5, True), (2, 0.0, False)]
    kinds = {i.kind for found in ingest.inspect(str(path)).values() for i in found}
    assert {"blank_row", "total_row", "number_as_text"} <= kinds


def test_zeros_are_numbers():
    assert ingest.infer_type(["0", "1"]) == ("bigint", "") and ingest.infer_type(["0.0", "1.5"]) == ("double", "")
    assert ingest.infer_type(["12%", "0.5"]) == ("double", "%") and ingest.infer_type(["12%", "7"])[1] == ""
    assert ingest.infer_type(["$1", "€2"]) == ("string", "")
    assert ingest.infer_type(["2024-01-01 10:00:00"]) == ("timestamp_ntz", "")


def test_regions():
    grid = [["Section A", ""], ["", ""], ["id", "x"], ["1", "2"], ["", ""], ["id", "x"], ["3", "4"]]
    assert ingest.append_alike(ingest.regions(grid)) == [[["id", "x"], ["1", "2"], ["3", "4"]]]
    assert len(ingest.regions([["a", "", "b"], ["1", "", "2"]])) == 2
    assert ingest.transpose_key_value([["name", "x"], ["size", "3"]]) == [["name", "size"], ["x", "3"]]


def test_sheets(tmp_path, spark):
    path = tmp_path / "book.xlsx"
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{rel}"><sheets><sheet name="Items" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>id</t></si><si><t>kind</t></si><si><t>film</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {main}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row r="2"><c r="A2"><v>1</v></c><c r="B2" t="s"><v>2</v></c></row><row r="3"><c r="A3"><v>2</v></c></row></sheetData><mergeCells><mergeCell ref="B2:B3"/></mergeCells></worksheet>')
    assert ("merged_cells", "Items:B2:B3") in {(i.kind, i.where) for i in ingest.inspect(str(path))["Items"]}
    df = ingest.ingest(spark, [str(path)])["items"]
    assert sorted(map(tuple, df.collect())) == [(1, "film"), (2, "film")]


def test_transforms(spark):
    df = spark.createDataFrame([("10-19", "A", "x1", "n/a", "05.01.2024", ""), ("65+", "b", "y2", "7", "bad", "")], "band string, code string, ref string, v string, day string, empty string")
    out = ingest.transform(df, [("band_bounds", {"column": "band", "low": "lo", "high": "hi"}), ("band_value_map", {"column": "code", "values": {"A": "alpha"}}), ("derive_by_pattern", {"column": "ref", "target": "n", "pattern": r"(\d+)"}), ("null_tokens", {"column": "v"}), ("parse_temporal", {"column": "day", "formats": ("dd.MM.yyyy",)}), ("drop_empty_columns", {})])
    rows = out.orderBy("band").collect()
    assert "empty" not in out.columns and (rows[0].lo, rows[0].hi, rows[1].lo, rows[1].hi) == (10.0, 19.0, 65.0, None)
    assert rows[0].code == "alpha" and rows[1].code == "b" and rows[0].v is None and rows[0].n == "1" and rows[1].day is None and str(rows[0].day) == "2024-01-05"
    wide = spark.createDataFrame([(1, 2, 3)], "id int, a int, b int")
    assert ingest.unpivot_columns(wide, ["id"], ["a", "b"]).count() == 2
    assert ingest.keep_canonical_columns(spark.createDataFrame([(None, "x")], "a string, b string"), {"a": ["b"]}).first()["a"] == "x"
    assert [r[0] for r in ingest.strip_numeric_affix(spark.createDataFrame([("$1,000.5",), ("(3)",), ("x",)], "v string"), "v").collect()] == [1000.5, -3.0, None]
    with pytest.raises(ValueError):
        ingest.transform(df, [("nothing", {})])


def test_results(spark, tmp_path):
    df = spark.range(25)
    assert [len(b) for b in results.batches(df, 10)] == [10, 10, 5]
    with pytest.raises(Refusal):
        results.capped(df, most_rows=10)
    results.write_csv(df, str(tmp_path / "a.csv"), single=True)
    assert ingest.read_csv(spark, str(tmp_path / "a.csv"), "id long").count() == 25
    results.write_parquet(df, str(tmp_path / "p"))
    assert results.arrow(spark.read.parquet(str(tmp_path / "p"))).num_rows == 25
    history = tmp_path / "h.sql"
    history.write_text("-- note\nSELECT 1;\nDROP TABLE x; SELECT ';' AS a; SELECT 1;")
    assert results.statements(str(history)) == ["SELECT 1", "SELECT ';' AS a"]
    assert results.run_sql(spark, "SELECT :x + 1 AS y", {"x": 4}).first()["y"] == 5


def test_predicates_on_nulls(spark):
    df = spark.createDataFrame([("a",), ("B ",), (None,)], "v string")
    style = predicates.Style(text=True)
    keep = lambda op, right, s=style: sorted(str(r[0]) for r in df.filter(predicates.apply(df.v, op, right, s)).collect())
    assert keep("=", "A") == ["a"] and keep("!=", "a") == ["B ", "None"] and keep("not in", ["a"]) == ["B ", "None"]
    assert keep("=", "b", predicates.Style(text=True, fixed_width=True)) == ["B "] and keep("!=", "a", predicates.Style(text=True, nullable=False)) == ["B "]
    assert predicates.escape_like("5%_/") == "5/%/_//"


def test_profile_and_inference(spark):
    parent = spark.createDataFrame([(i, f"n{i}") for i in range(20)], "city_id int, city_name string")
    child = spark.createDataFrame([(i, i % 20, i % 2) for i in range(60)], "shop_id int, city_id int, is_open int")
    frames = {"city": parent, "shop": child}
    catalog = profile.profile(frames, Catalog.reflect(frames))
    assert catalog.tables["shop"].columns["is_open"].role == "flag" and catalog.tables["shop"].columns["city_id"].role == "key"
    assert profile.infer_primary_keys(frames, catalog) == {"city": ("city_id",), "shop": ("shop_id",)}
    found = profile.infer_foreign_keys(frames, catalog)
    assert [(k.table, k.columns, k.parent, k.origin) for k in found] == [("shop", ("city_id",), "city", "same_name")]
    assert profile.orphan_rate(frames, found[0]) == 0
    assert profile.containment(child, "city_id", parent, "city_id") == 1
    assert catalog.descriptive_columns("city") == ["city_name"]
    loose = Catalog.reflect(frames)
    profile.profile(frames, loose)
    assert any(k.origin == "overlap" for k in profile.semantic_neighbours(frames, loose))


def test_federation_checks(spark):
    a = {"t": spark.createDataFrame([(1,), (2,)], "id int")}
    b = {"u": spark.createDataFrame([(2,), (3,)], "key bigint")}
    sources = {"a": (a, Catalog.reflect(a, {"t": ("id",)})), "b": (b, Catalog.reflect(b, {"u": ("key",)}))}
    f = Federation(sources, (Logical("t", "union", (Member("a", "t"), Member("b", "u", (("id", "key"),))), union_key=("id",)),))
    frames, _ = f.compose()
    assert dict(frames["t"].dtypes) == {"id": "bigint"} and frames["t"].count() == 4
    with pytest.raises(Refusal):
        f.check_disjoint("t")
    r = Federation(sources, (Logical("t", "replica", (Member("a", "t"), Member("b", "u", (("id", "key"),))), "a"),))
    assert r.compose()[0]["t"].count() == 2 and r.replica_differences("t") == {"b": (1, 1)}
    assert semijoin_keys(a["t"], "id") == [1, 2] and semijoin_keys(a["t"], "id", 1) is None
    with pytest.raises(Refusal):
        check_combined(frames["t"], a["t"])
    assert sets.same_rows(a["t"], a["t"]) and not sets.same_rows(a["t"], a["t"].limit(1))
    with pytest.raises(Refusal):
        Federation({"a": (a, sources["a"][1]), "c": (a, sources["a"][1])}).compose()


def test_database_urls():
    assert databases.Database("postgresql", "d", "h").url() == "jdbc:postgresql://h:5432/d"
    assert all(databases.Database(e, "d").url() is not None for e in databases.ENGINES)
    with pytest.raises(ValueError):
        databases.Database("other", "d").url()


def test_sqlite_keys_are_read():
    import sqlite3

    db = sqlite3.connect(":memory:")
    db.executescript("CREATE TABLE city (id INTEGER PRIMARY KEY, name TEXT); CREATE TABLE shop (a INT, b INT, city INT REFERENCES city(id), PRIMARY KEY (a, b)); CREATE TABLE visit (a INT, b INT, FOREIGN KEY (a, b) REFERENCES shop(a, b));")
    db.row_factory = sqlite3.Row

    class Here(databases.Database):
        def query(self, spark, sql):
            found = db.execute(sql).fetchall()
            return type("Rows", (), {"collect": lambda _: [dict(r) for r in found]})()

    primary, foreign = Here("sqlite", "d").keys(None)
    assert primary == {"city": ("id",), "shop": ("a", "b")}
    assert sorted((k.table, k.columns, k.parent, k.parent_columns) for k in foreign) == [("shop", ("city",), "city", ("id",)), ("visit", ("a", "b"), "shop", ("a", "b"))]


def test_mysql_keys_name_their_parent():
    rows = {databases.MYSQL_PRIMARY: [{"child": t, "child_column": "id", "place": 1} for t in ("a", "b", "c")], databases.MYSQL_KEYS: [{"child": "b", "child_column": "a_id", "parent": "a", "parent_column": "id", "name": "fk", "place": 1}]}

    class Mocked(databases.Database):
        def query(self, spark, sql):
            return type("Rows", (), {"collect": lambda _: rows[sql]})()

    primary, foreign = Mocked("mysql", "d").keys(None)
    assert set(primary) == {"a", "b", "c"} and [(k.table, k.parent) for k in foreign] == [("b", "a")]


def test_query_logs_and_warm_up(spark, sf_dir):
    from tessera.engine import Engine
    from tessera.sources.tables import open_tables

    class Logged(databases.Database):
        def query(self, spark, sql):
            assert "{" not in sql and "500" in sql
            return type("Rows", (), {"collect": lambda _: [{"statement": s} for s in ("SELECT r_name FROM region", "INSERT INTO x VALUES (1)", None, "SELECT r_name FROM region", "SELECT * FROM region")]})()

    for engine in databases.QUERY_LOGS.keys() - {"spark"}:
        assert Logged(engine, "d").query_log(spark) == ["SELECT r_name FROM region", "SELECT * FROM region"]
    assert databases.Database("sqlite", "d").query_log(spark) == databases.Database("duckdb", "d").query_log(spark) == []
    engine = Engine(spark, *open_tables(spark, sf_dir, ["region"]))
    made = engine.warm_up(Logged("mysql", "d").query_log(spark))
    handle = made["SELECT r_name FROM region"]
    assert made["SELECT * FROM region"].startswith("refused") and engine.templates.templates[handle].trust == "pending"
    engine.templates.promote(handle)
    assert engine.ask_template(handle).frame.count() == 5


def test_section_headings_name_their_tables(spark, tmp_path):
    path = tmp_path / "book.csv"
    path.write_text("Big cities,\n,\ncity,people\na,5\nb,6\n,\nRivers,\n,\nriver,length\nx,1\ny,2\n")
    assert set(ingest.ingest(spark, [str(path)])) == {"book_big_cities", "book_rivers"}
