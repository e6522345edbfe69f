"""Grids of HTML tables, sheets of workbooks, nested YAML, records over lines cut at any byte; workers without this package."""

import os
import random
import subprocess
import sys
import zipfile

import pytest

from marlstone.sources import documents as sources


def test_spans_repeat_in_every_place(spark):
    pages = {
        1: ("<table><tr><th rowspan=2>a<th colspan=2>b</tr><tr><th>c<th>d</tr><tr><td>1<td rowspan=3>2<td>3</tr><tr><td>x</table>", [["a", "b", "b"], ["a", "c", "d"], ["1", "2", "3"], ["x", "2"], ["", "2"]]),
        2: ("<table><tr><td colspan=2 rowspan=2>q<td>r</tr><tr><td>s</tr><tr><td>t<td>u<td>v</tr></table>", [["q", "q", "r"], ["q", "q", "s"], ["t", "u", "v"]]),
        3: ("<table><tr><td rowspan=0>z<td>1</tr><tr><td>2</tr><tr><td colspan=zz>3</tr>", [["z", "1"], ["z", "2"], ["z", "3"]]),
        4: ("<table><tr><td>o<table><tr><td>i</td></tr></table></td><td>p</td></tr></table>", [["o", "p"], ["i"]]),
        5: ("no table </table></td>", []),
        6: (None, []),
    }
    table = spark.createDataFrame([(k, h, "clash") for k, (h, _) in pages.items()], "page_id long, html string, cells string")
    rows = sources.html_tables(table, "page_id").orderBy("page_id", "table_no", "row_no").collect()
    assert {k: [list(r.cells) for r in rows if r.page_id == k] for k in pages} == {k: want for k, (_, want) in pages.items()}
    wide = spark.createDataFrame([(1, "<table><tr><td colspan=99999999>w<td rowspan=900000>h</table>")], "page_id long, html string")
    rows = sources.html_tables(wide, "page_id").collect()
    assert len(rows[0].cells) in (1001,) and len(rows) == 65534


def test_workers_need_nothing_of_this_package(tmp_path):
    code = f"""
import sys
sys.path.insert(0, {os.path.dirname(os.path.dirname(os.path.abspath(__file__)))!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
from marlstone.sources import documents as sources
pages = spark.createDataFrame([(1, "<table><tr><td colspan=2>a</table>")], "page_id long, html string")
print("CELLS", sources.html_tables(pages, "page_id").first().cells)
print("VALUE", sources.yaml_entries(spark.createDataFrame([(1, "a: {{b: 2}}")], "k int, t string"), "k", "t").first())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "CELLS ['a', 'a']" in done.stdout and "path='a.b', value='2'" in done.stdout, done.stderr[-2000:]


SHEET = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{}</sheetData></worksheet>'


def workbook(path, rows, first="<row r='1'><c r='A1' t='inlineStr'><is><t>first</t></is></c></row>"):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="one" sheetId="1" r:id="rId1"/><sheet name="2018_졸업생 (중)" sheetId="2" r:id="rId2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>지역</t></si><si><r><t>졸업</t></r><r><t>자</t></r><rPh sb="0" eb="1"><t>no</t></rPh></si><si><t xml:space="preserve"> a b </t></si></sst>')
        z.writestr("xl/styles.xml", '<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd hh:mm"/><numFmt numFmtId="165" formatCode="0.00 &quot;days&quot;"/></numFmts><cellStyleXfs><xf numFmtId="14"/></cellStyleXfs><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", SHEET.format(first))
        z.writestr("xl/worksheets/sheet2.xml", SHEET.format(rows))


def test_sheet_by_name_with_dates_blanks_and_shared_strings(spark, tmp_path):
    rows = """<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1" t="s"><v>1</v></c><c r="E1" t="s"><v>1</v></c></row>
<row r="3"><c r="A3" t="s"><v>2</v></c><c r="C3" s="1"><v>43831</v></c><c r="D3" s="2"><v>43831.75</v></c><c r="E3"><v>12</v></c><c r="AA3" t="b"><v>1</v></c></row>
<row r="4"><c r="A4" t="e"><v>#N/A</v></c><c r="B4" s="3"><v>2.5</v></c><c r="C4"/><c r="D4" t="str"><f>A1</f><v>made</v></c><c r="E4"><v>1e3</v></c></row><row r="9"/>"""
    workbook(tmp_path / "a b.xlsx", rows)
    got = {r.row_no: list(r.cells) for r in sources.sheet_rows(spark, str(tmp_path), "2018_졸업생 (중)").collect()}
    assert got[1] == ["지역", "졸업자", "졸업자", None, "졸업자"] and got[4] == [None, "2.5", None, "made", "1000"] and 9 not in got
    assert got[3][:5] == [" a b ", None, "2020-01-01", "2020-01-01 18:00:00", "12"] and got[3][26] == "true" and len(got[3]) == 27
    assert [r.cells for r in sources.sheet_rows(spark, str(tmp_path)).collect()] == [["first"]]
    assert sources.excel_header(spark, str(tmp_path), "2018_졸업생 (중)") == ["지역", "졸업자", "졸업자.1", "Unnamed: 3", "졸업자.2"]
    picked = sources.excel_columns(spark, str(tmp_path), {"졸업자.2": "n", "지역": "region"}, "2018_졸업생 (중)", header_rows=3)
    assert [tuple(r) for r in picked.collect()] == [("1000", None)]
    typed = sources.read_excel(spark, str(tmp_path), "region string, x double, day date", "2018_졸업생 (중)", header_rows=2)
    assert sorted(map(str, typed.collect())) == sorted(["Row(region=' a b ', x=None, day=datetime.date(2020, 1, 1))", "Row(region=None, x=2.5, day=None)"])
    with pytest.raises(Exception, match="no sheet 'none'"):
        sources.sheet_rows(spark, str(tmp_path), "none").collect()


def test_school_results_from_a_sheet(spark, tmp_path):
    cell = lambda ref, v: f"<c r='{ref}' t='inlineStr'><is><t>{v}</t></is></c>" if isinstance(v, str) else "" if v is None else f"<c r='{ref}'><v>{v}</v></c>"
    lines = [["지역", "학교명", "코드", "졸업자", "졸업자", "졸업자", "과고", "외고"], ["s"] * 8, ["서울특별시 강남구", "a", "S1", 1, 2, 10, 1, 2], ["경상북도 예천군", "b", "S2", 1, 1, 5, None, 1], [None, "c", "S3", 0, 0, 1, 0, 0]]
    workbook(tmp_path / "g.xlsx", "".join(f"<row r='{r}'>" + "".join(cell(f"{'ABCDEFGH'[c]}{r}", v) for c, v in enumerate(line)) + "</row>" for r, line in enumerate(lines, 1)))
    got = sources.school_results(spark, str(tmp_path / "g.xlsx"), {"S3": ("부산", "기장군")}, "2018_졸업생 (중)", ["지역", "학교명", "코드", "졸업자.2", "과고", "외고"])
    rows = {r["code"]: (r["city"], r["district"], r["graduates"], r["total"]) for r in got.collect()}
    assert rows == {"S1": ("서울", "강남구", 10.0, 3.0), "S2": ("경북", "예천군", 5.0, None), "S3": ("부산", "기장군", 1.0, 0.0)}


def test_nested_yaml(spark, tmp_path):
    (tmp_path / "c.yml").write_text("# site\ntitle: 'it''s' # no\nmark:\n  ids:  true\n  deep: {a: 1, b: [x, 'y, z']}\nlist:\n- k: 1\n  l:\n    - 2\n    - 3\n- plain\nfold: >\n  one\n  two\n\n  three\nkeep: |-\n  l1\n   l2\nnone:\nurl: https://x.y/z#w\n\"q\\u0041\": \"\\\"s\\\"\"\n")
    entries = sources.yaml_entries(spark.read.text(str(tmp_path / "c.yml"), wholetext=True).selectExpr("1 AS k", "value"), "k", "value").orderBy("place")
    assert [(r.path, r.value) for r in entries.collect()] == [
        ("title", "it's"), ("mark.ids", "true"), ("mark.deep.a", "1"), ("mark.deep.b.0", "x"), ("mark.deep.b.1", "y, z"), ("list.0.k", "1"), ("list.0.l.0", "2"), ("list.0.l.1", "3"), ("list.1", "plain"),
        ("fold", "one two\nthree\n"), ("keep", "l1\n l2"), ("none", None), ("url", "https://x.y/z#w"), ("qA", '"s"'),
    ]
    (tmp_path / "d.yml").write_text("# nothing\n")
    rows = sources.yaml_settings(spark, str(tmp_path), ["mark.ids", "mark.deep.a", "title"]).orderBy("file").collect()
    assert [tuple(r) for r in rows] == [("c.yml", "true", "1", "it's"), ("d.yml", None, None, None)]
    (tmp_path / "n.yml").write_text("- title: A\n  at: {x: 1}\n- title: B\n")
    records = sources.yaml_records(spark, str(tmp_path / "n.yml"), ["title", "at.x"]).orderBy("place").collect()
    assert [tuple(r) for r in records] == [("n.yml", 0, "A", "1"), ("n.yml", 1, "B", None)]
    with pytest.raises(Exception, match="neither a key nor an entry"):
        sources.yaml_entries(spark.createDataFrame([(1, "a: 1\njust words\n")], "k int, t string"), "k", "t").collect()


def test_records_over_lines_cut_at_any_byte(spark, tmp_path):
    rng = random.Random(5)
    rows = [(f'동 {i}\n{"줄" * rng.randrange(9)} "q", ', i) for i in range(150)] + [("끝\\", None), ("보통", 5), ('"', 6)]
    text = "이름,값\r\n" + "".join('"{}",{}\r\n'.format(n.replace('"', '""'), "" if v is None else v) for n, v in rows)
    (tmp_path / "a.csv").write_bytes(text.encode("cp949"))
    (tmp_path / "b.csv").write_bytes('이름,값\n"끝 없는\n\n줄",8'.encode("cp949"))
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    try:
        for size in ("61", "700", "100000"):
            for n in names:
                spark.conf.set(n, size if n == names[0] else "1")
            got = sources.read_csv_in(spark, str(tmp_path), "name string, v int", multiline=True).collect()
            assert sorted(map(str, map(tuple, got))) == sorted(map(str, [*rows, ("끝 없는\n\n줄", 8)]))
    finally:
        for n, v in zip(names, before, strict=True):
            spark.conf.set(n, v)
