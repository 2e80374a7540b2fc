"""Workbooks: round trips, sheets of different columns, rejects, tag tables."""

import os
import zipfile

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from leadlake.sources import files, headers, workbooks

ROWS = "src_group string, src_file string, section string, header array<string>, cells array<string>"


@pytest.fixture(scope="module", autouse=True)
def known(spark):
    workbooks.register(spark)


def save(spark, rows, path):
    df = spark.createDataFrame(rows, ROWS).repartition(3, "src_group", "src_file").sortWithinPartitions("src_group", "src_file", "section")
    df.write.format(workbooks.FORMAT).mode("append").save(str(path))


def read(spark, path, **options):
    return spark.read.format(workbooks.FORMAT).options(**options).load(str(path))


def test_round_trip(spark, tmp_path):
    head = ["列一", "b & <c>", "d"]
    rows = [("甲", "a.xlsx", "s", head, [f"v{i}", None, "  two\nlines \"q\" 'x' & <y> \x01\U0001f600"]) for i in range(5000)]
    rows += [("甲", "a.xlsx", "t", ["x"], ["y"]), ("乙", "b.xlsx", "a very long name of a sheet, above thirty-one", ["k"], [None, "beyond", "x" * 100_000])]
    save(spark, rows, tmp_path)
    assert sorted(os.listdir(tmp_path)) == ["乙", "甲"]
    found = read(spark, tmp_path)
    assert found.rdd.getNumPartitions() == 3
    got = {(r["src_file"], r["section"][:10], r["row_no"]): r for r in found.collect()}
    assert len(got) == 5000 + 1 + 1 + 3 and all(r["problem"] is None for r in got.values())
    assert got["a.xlsx", "s", 0]["cells"] == head == got["a.xlsx", "s", 17]["header"]
    assert {r["cells"][0] for k, r in got.items() if k[1] == "s" and k[2]} == {f"v{i}" for i in range(5000)}
    assert got["a.xlsx", "s", 1]["cells"][1:] == [None, "  two\nlines \"q\" 'x' & <y> \U0001f600"]
    assert got["b.xlsx", "a very lon", 1]["cells"] == [None, "beyond", "x" * 100_000]


def test_shared_texts_gaps_and_numbers(spark, tmp_path):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "x.xlsx", "w") as book:
        book.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>'
                      '<sheet name="one" sheetId="1" r:id="rId7"/><sheet name="gone" sheetId="2" r:id="rId8"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                      '<Relationship Id="rId7" Type="t" Target="/xl/worksheets/first.xml"/><Relationship Id="rId8" Type="t" Target="worksheets/none.xml"/></Relationships>')
        book.writestr("xl/sharedStrings.xml", f'<sst {main}><si><t>plain</t></si><si><r><t>ri</t></r><r><t>ch</t></r><rPh sb="0" eb="1"><t>no</t></rPh></si></sst>')
        book.writestr("xl/worksheets/first.xml", f'<worksheet {main}><sheetData><row r="1"/><row r="3"><c r="B3" t="s"><v>0</v></c><c r="AA3" t="s"><v>1</v></c></row>'
                      '<row><c><v>43831.5</v></c><c t="str"><f>A1</f><v>text</v></c><c r="D4" t="b"><v>1</v></c></row></sheetData></worksheet>')
    rows = {(r["section"], r["row_no"]): r for r in read(spark, tmp_path).collect()}
    assert rows["one", 0]["cells"] == [None, "plain", *[None] * 24, "rich"]
    assert rows["one", 1]["cells"] == ["43831.5", "text", None, "1"]
    assert rows["gone", 0]["problem"] == "unreadable from here: KeyError"
    with pytest.raises(PySparkException):
        read(spark, tmp_path, mode="failfast").collect()


def test_broken_files_and_paths(spark, tmp_path):
    (tmp_path / "bad.xlsx").write_text("no workbook", encoding="utf-8")
    (tmp_path / "~lock.xlsx").write_text("", encoding="utf-8")
    (row,) = read(spark, tmp_path).collect()
    assert (row["src_file"], row["row_no"]) == ("bad.xlsx", None) and row["problem"].startswith("no workbook")
    with pytest.raises(PySparkException, match="Arrow knows no such store"):
        read(spark, "unknown://x/y").collect()
    with pytest.raises(PySparkException, match="appended"):
        spark.createDataFrame([("g", "f.xlsx", "s", ["a"], ["b"])], ROWS).write.format(workbooks.FORMAT).mode("overwrite").save(str(tmp_path))


def test_a_file_must_lie_in_one_task(spark, tmp_path):
    df = spark.createDataFrame([("g", "f.xlsx", "s", ["a"], [str(i)]) for i in range(8)], ROWS).repartition(4)
    with pytest.raises(PySparkException, match="several tasks"):
        df.write.format(workbooks.FORMAT).mode("append").save(str(tmp_path / "out"))
    assert os.listdir(tmp_path / "out") == []


def test_sections_go_to_their_branches_in_one_pass(spark, tmp_path):
    code = "91" + "0" * 16
    rows = [
        ("g", "f.xlsx", "基础信息", ["公司名称", "登记状态", "注册资本", "不可用电话", "可用电话", "电话"], ["甲", "存续", "1", "bad", "first", "second"]),
        ("g", "f.xlsx", "无头", ["乙", "存续", "3"], ["丙", "注销", "4"]),
        ("g", "f.xlsx", "链", ["一级分类", " 公司名称", "ID"], ["a", "甲", code]), ("g", "f.xlsx", "链", ["一级分类", " 公司名称", "ID"], ["b", "丁", "无"]),
        ("g", "f.xlsx", "Sheet3", ["登记状态", "注册资本"], ["x"]), ("g", "f.xlsx", "瞪羚企业", ["ID"], [code]),
    ]
    save(spark, rows, tmp_path / "books")
    (tmp_path / "books" / "g" / "bad.xlsx").write_text("?", encoding="utf-8")
    branches = files.staged_sections(read(spark, tmp_path / "books"), str(tmp_path / "staged"))
    base = files.section_fields(branches["base"], headers.CHAIN_BASE).collect()
    assert [(r["name"], r["mobile"], r["credit"]) for r in base] == [("甲", "first", "")]
    assert sorted(r["cells"][0] for r in branches["base_no_header"].collect()) == ["丙", "乙"]
    assert [r["cells"][1] for r in branches["chain"].collect()] == ["甲"] and branches["honor"].count() == 1
    assert sorted((r["src_file"], r["reason"].split(":")[0]) for r in branches["reject"].collect()) == [("bad.xlsx", "no workbook"), ("f.xlsx", "credit_not_18")]


def test_certificate_lists_of_a_year(spark, tmp_path):
    for year in (2023, 2024):
        (tmp_path / f"{year}名单.csv").write_text(f"公司名称,统一信用代码,证书编号\n甲,91,GR{year}\n", encoding="utf-8")
    assert [r["cert_no"] for r in files.read_certificate_table(spark, str(tmp_path), [2024]).collect()] == ["GR2024"]


def test_tag_table_of_any_form(spark):
    rows = [
        (" c1 ", '["a | b", "c", null, 5, " c "]', ["x", None, ""], "1", "上游", None), ("c2", "a | b", None, "n/a", "", "A轮"), ("c3", "plain", [], None, None, "-"),
        ("c4", '["broken', ["y"], "70000", None, None), ("c5", '{"k": 1}', None, "7", None, None), ("c6", "12", None, "8", None, None), ("c7", "", None, "9", None, None), (" ", "x", None, "1", None, None),
    ]
    df = spark.createDataFrame(rows, "credit_code string, chain_industries string, honors array<string>, lead_score string, chain_position string, financing string")
    got = {r["credit_code"]: r for r in files.read_tag_table(df.withColumn("extra", F.lit(1))).collect()}
    assert {k: r["chain_industries"] for k, r in got.items()} == {
        "c1": ["a", "b", "c", "5", "c"], "c2": ["a", "b"], "c3": ["plain"], "c4": ['["broken'], "c5": ['{"k": 1}'], "c6": ["12"], "c7": None,
    }
    assert got["c4"]["rescued"] == {"chain_industries": '["broken'} and all(r["rescued"] is None for k, r in got.items() if k != "c4")
    assert (got["c1"]["honors"], got["c3"]["honors"], got["c4"]["lead_score"], got["c5"]["lead_score"]) == (["x"], None, None, 7)
    assert (got["c1"]["chain_positions"], got["c2"]["chain_positions"], got["c2"]["financing_raw"], got["c1"]["chain_nodes"]) == ("上游", None, "A轮", None)
    assert files.read_tag_table(df.limit(0)).collect() == []


def test_writer_and_reader_take_batches_with_one_header(spark, tmp_path):
    from pyspark.sql.datasource import DataSourceArrowWriter

    assert issubclass(workbooks.WorkbookWriter, DataSourceArrowWriter)
    cells = [["a & b <c>", "\x01x", None, "", "é\n"], ["1"], [None, "second", "]]>"]]
    rows = [("g", "f.xlsx", "s", 2 * workbooks.WAITING_ROWS + i, ["h1", "h2", None, "h4", "h&5"], cells[i % 3]) for i in range(2 * workbooks.WAITING_ROWS + 5)]
    workbooks.register(spark)
    df = spark.createDataFrame(rows, "src_group string, src_file string, section string, at int, header array<string>, cells array<string>")
    df.repartition("src_group", "src_file").sortWithinPartitions("at").drop("at").write.format(workbooks.FORMAT).mode("append").save(f"{tmp_path}/w")
    got = spark.read.format(workbooks.FORMAT).load(f"{tmp_path}/w").filter("row_no > 0").orderBy("row_no").collect()
    want = [["a & b <c>", "x", None, None, "é\n"], ["1"], [None, "second", "]]>"]]
    assert [r["cells"] for r in got] == [want[i % 3] for i in range(len(rows))]
    assert {tuple(r["header"]) for r in got} == {("h1", "h2", None, "h4", "h&5")}


MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
SHARED = ["zero", "", "two & more"]
#: Rows of a sheet; whether they are plain.
PIECES = [
    ('<row r="1"><c r="A1" t="inlineStr"><is><t xml:space="preserve"> a &amp;lt; b &lt;甲&gt;\r\n</t></is></c><c r="D1" t="s"><v>2</v></c></row>', True),
    ('<row><c t="inlineStr"><is><t>x</t></is></c><c/><c><v>1.5</v></c></row>\n<row/><row r="9" ht="3"></row>', True),
    ('<row><c r="B7" s="3"><v>7</v></c><c r="AA7" s="12" t="str"><v>t</v></c><c r="AB7" s="1"/></row><row><c r="A8" t="s"><v>1</v></c></row>', True),
    ('<row><c t="b"><v>1</v></c><c t="inlineStr"><is><t></t></is></c><c></c></row>', True),
    ('<row><c t="str"><f>A1</f><v>f</v></c></row>', False), ('<row><c t="inlineStr"><is><r><t>ri</t></r><r><t>ch</t></r></is></c></row>', False),
    ('<row><c t="inlineStr"><is><t><![CDATA[<c>]]></t></is></c><!-- <row> --></row>', False), ('<row><c t="inlineStr"><is><t>&#65;</t></is></c></row>', False),
    ('<row><c r="C1"><v>3</v></c><c r="A1"><v>1</v></c><c><v>4</v></c></row>', False), ('<row><c t="s"><v>9</v></c></row>', False), ('<row><c><v>a > b</v></c></row>', False),
    ('<row><c t="inlineStr"><is/></c><c t="n"><v/></c></row>', False), ('<row><c><v>\x01</v></c></row>', False), ('<row><cols/></row>', False),
]


def test_pieces_cut_up_are_as_parsed():
    import io
    from xml.etree import ElementTree

    import pyarrow as pa

    def parsed(rows):
        found = [workbooks._cells(row, SHARED) for row in workbooks._elements(io.BytesIO(f"<worksheet {MAIN}><sheetData>{rows}</sheetData></worksheet>".encode()), "row")]
        return [cells for cells in found if any(cells)]

    for rows, plain in PIECES:
        got = workbooks._plain(rows.encode(), pa.array(SHARED))
        assert (got is not None) == plain, rows
        if plain:
            assert got.to_pylist() == parsed(rows)
    together = 50 * (PIECES[1][0] + PIECES[3][0])
    assert workbooks._plain(together.encode(), pa.array(SHARED)).to_pylist() == parsed(together)
    with pytest.raises(ElementTree.ParseError):
        parsed(PIECES[-2][0])


@pytest.mark.parametrize("piece", [90, 1 << 22])
def test_sheets_go_on_where_a_piece_is_not_plain(tmp_path, monkeypatch, piece):
    monkeypatch.setattr(workbooks, "PIECE", piece)
    rows = ["<row><c t=\"inlineStr\"><is><t>%d</t></is></c></row>" % i for i in range(40)]
    rows[25] = '<row><c t="str"><f>x</f><v>25</v></c></row>'
    with zipfile.ZipFile(tmp_path / "x.xlsx", "w") as book:
        book.writestr("good", f"<worksheet {MAIN}><sheetData>{''.join(rows)}</sheetData></worksheet>")
        book.writestr("cut", f"<worksheet {MAIN}><sheetData>{''.join(rows[:20])}<row><c>")
    with zipfile.ZipFile(tmp_path / "x.xlsx") as book:
        assert [c for a in workbooks._cell_rows(book, "good", []) for (c,) in a.to_pylist()] == [str(i) for i in range(40)]
        found = []
        with pytest.raises(workbooks.ElementTree.ParseError):
            found.extend(c for a in workbooks._cell_rows(book, "cut", []) for (c,) in a.to_pylist())


def test_blocks_hold_the_same_rows_and_branches(spark, tmp_path):
    code = "91" + "0" * 16
    head = ["一级分类", " 公司名称", "统一社会信用代码", "ID"]
    rows = [("g", "f.xlsx", "链", head, [f"a{i}", f"n{i}", "-" if i % 3 else code, "无" if i % 2 else code]) for i in range(3 * workbooks.BLOCK_ROWS)]
    rows += [("g", "f.xlsx", "无头", ["乙", "存续", "3"], ["丙", "注销", "4"])] + [("g", "f.xlsx", "无头", ["乙", "存续", "3"], [None, ""])]
    save(spark, rows, tmp_path / "books")
    (tmp_path / "books" / "g" / "bad.xlsx").write_text("?", encoding="utf-8")
    blocks = read(spark, tmp_path / "books", blocks=True)
    assert blocks.agg(F.max(F.size("rows"))).first()[0] == workbooks.BLOCK_ROWS
    flat = read(spark, tmp_path / "books")
    as_rows = lambda df: sorted(map(repr, df.select(*flat.columns).collect()))
    assert as_rows(files.block_rows(blocks)) == as_rows(flat)
    got = [files.staged_sections(df, f"{tmp_path}/staged{i}") for i, df in enumerate((blocks, flat))]
    for kind in files.KINDS:
        assert got[0][kind].columns == got[1][kind].columns and sorted(map(repr, got[0][kind].collect())) == sorted(map(repr, got[1][kind].collect()))
    assert got[0]["chain"].count() == sum(1 for i in range(3 * workbooks.BLOCK_ROWS) if not i % 3 or not i % 2)
    assert got[0]["reject"].count() == 1 + sum(1 for i in range(3 * workbooks.BLOCK_ROWS) if i % 3 and i % 2)
    fields = [files.section_fields(df, headers.CHAIN).filter("row_no > 0").collect() for df in (blocks, flat)]
    assert sorted(map(repr, fields[0])) == sorted(map(repr, fields[1])) and len(fields[0]) > 3 * workbooks.BLOCK_ROWS


def test_rows_without_text_and_blanks_at_the_ends(spark, tmp_path):
    cells = [[None, ""], ["a", "", " b", "c ", None], None, [], ["d"], ["", "e&"], [""]]
    save(spark, [("g", "f.xlsx", "s", ["h"], c) for c in cells], tmp_path)
    with zipfile.ZipFile(tmp_path / "g" / "f.xlsx") as book:
        sheet = book.read("xl/worksheets/sheet1.xml").decode()
    assert sheet.count("<row") == 8 and sheet.count("preserve") == 2
    got = [r["cells"] for r in read(spark, tmp_path).orderBy("row_no").collect()]
    assert sorted(got, key=repr) == sorted([["h"], ["a", None, " b", "c "], ["d"], [None, "e&"]], key=repr)
