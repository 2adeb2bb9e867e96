"""Workbooks made by hand."""

import zipfile

import pytest

from cladeflow.plans.cli import options_of, parser
from cladeflow.sources import tables, workbook

HEAD = '<?xml version="1.0" encoding="UTF-8"?>'
NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def cell(place, value, strings):
    if value is None:
        return ""
    if isinstance(value, bool):
        return f'<c r="{place}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, str):
        if value.startswith("inline "):
            return f'<c r="{place}" t="inlineStr"><is><t>{value}</t></is></c>'
        if value == "#ERR":
            return f'<c r="{place}" t="e"><v>#N/A</v></c>'
        strings.append(value)
        return f'<c r="{place}" t="s"><v>{len(strings) - 1}</v></c>'
    return f'<c r="{place}"><v>{value}</v></c>'


def make(path, sheets):
    """A workbook of named lists of rows; row lists start at row 2 to leave a blank row before."""
    strings, files = [], {}
    for k, rows in enumerate(sheets.values(), start=1):
        body = "".join(f'<row r="{i}">' + "".join(cell(f"{chr(65 + j)}{i}", v, strings) for j, v in enumerate(r)) + "</row>" for i, r in enumerate(rows, start=2))
        files[f"xl/worksheets/sheet{k}.xml"] = f"{HEAD}<worksheet {NS}><sheetData>{body}</sheetData></worksheet>"
    names = "".join(f'<sheet name="{n}" sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(sheets, start=1))
    files["xl/workbook.xml"] = f'{HEAD}<workbook {NS} xmlns:r="{REL}"><sheets>{names}</sheets></workbook>'
    links = "".join(f'<Relationship Id="rId{k}" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1))
    files["xl/_rels/workbook.xml.rels"] = f'{HEAD}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>'
    files["xl/sharedStrings.xml"] = f"{HEAD}<sst {NS}>" + "".join(f"<si><r><t>{s[:2]}</t></r><r><t>{s[2:]}</t></r></si>" for s in strings) + "</sst>"
    with zipfile.ZipFile(path, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return str(path)


@pytest.fixture(scope="module")
def book(tmp_path_factory):
    rows = [[f"M{i}", None if i == 3 else 0, i / 100, "inline é" if i == 1 else "note" if i % 2 else None] for i in range(1, 8)]
    return make(tmp_path_factory.mktemp("books") / "series.xlsx", {
        "first": [["Trajectory", 0, 17, "Gene"], *rows, [], ["M9", 1, 0.5, True], ["M10", 0.1, 0.2, "#ERR"]], "second": [["a", "a", None, "b"], ["x", 1, 2, 3]], "empty": [], "third": [["a", "a", None, "b"], ["y", 4, 5, 6]],
    })


def test_sheets_as_rows(spark, book):
    got = workbook.read(spark, book)
    assert got.columns == ["Trajectory", "0", "17", "Gene"] and set(dict(got.dtypes).values()) == {"string"}
    rows = [tuple(r) for r in got.collect()]
    assert rows[0] == ("M1", "0", "0.01", "inline é") and rows[2] == ("M3", None, "0.03", "note") and rows[-2:] == [("M9", "1", "0.5", "TRUE"), ("M10", "0.1", "0.2", None)] and len(rows) == 9
    assert [tuple(r) for r in workbook.read(spark, book, "second").collect()] == [("x", "1", "2", "3")]
    assert workbook.read(spark, book, "1").columns == ["a", "a_1", "_c2", "b"]
    assert workbook.read(spark, book, "empty").count() == 0
    with pytest.raises(Exception, match="no sheet"):
        workbook.read(spark, book, "none").count()


def test_row_ranges_are_partitions(spark, book):
    many = workbook.read(spark, book, "first", rows=2)
    assert many.rdd.getNumPartitions() == 5
    assert sorted(map(tuple, many.collect()), key=str) == sorted(map(tuple, workbook.read(spark, book, "first").collect()), key=str)


def test_all_sheets_of_one_header(spark, tmp_path):
    path = make(tmp_path / "all.xlsx", {"s": [["a", "b"], ["x", 1]], "t": [["a", "b"], ["y", 2]]})
    assert sorted(tuple(r) for r in workbook.read(spark, path, "*").collect()) == [("s", "x", "1"), ("t", "y", "2")]


def test_series_from_a_workbook(spark, book):
    long, info = tables.parse_series(tables.read_any(spark, book))
    assert {(r.label, r.t): r.freq for r in long.collect()}["M7", 17] == pytest.approx(0.07)
    assert info.where("label = 'M1'").first().gene == "inline é"
    with pytest.raises(ValueError, match="xls"):
        tables.read_any(spark, "old.xls")


def test_filter_options():
    args = ["lineage", "--input", "a", "--output", "b"]
    o = options_of(parser().parse_args(args))
    assert (o.filter_single, o.filter_startfixed, o.filter_consistency, o.filter_genotypes, o.strict) == (True, True, 0.1, True, False)
    o = options_of(parser().parse_args([*args, "--disable-all-filters"]))
    assert (o.filter_single, o.filter_startfixed, o.filter_consistency, o.filter_genotypes) == (False, False, 0.0, False)
    o = options_of(parser().parse_args([*args, "--disable-filter-single", "--disable-genotype-filter", "--filter-constant", "0", "--strict-filter", "--sheetname", "x"]))
    assert (o.filter_single, o.filter_startfixed, o.filter_consistency, o.filter_genotypes, o.strict) == (False, True, 0.0, False, True)
