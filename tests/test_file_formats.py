"""Containers of packets and spreadsheets, made here."""

import zipfile

import pytest

from lattix.sources import packets, sheets

COOKIE = b"\x09" + (14).to_bytes(4, "big") + b"SnapGene" + b"\x00\x01\x00\x0f\x00\x13"


def packet(tag, payload):
    return bytes([tag]) + len(payload).to_bytes(4, "big") + payload


def test_packet_files(spark, tmp_path):
    notes = packet(6, b"<Notes>ACGTACGTACGTACGTACGT</Notes>")
    files = {
        "As_01": COOKIE + packet(0, b"\x00acgtn") + notes,
        "As_02": COOKIE + notes + packet(0, b"\x03ACGTAC"),
        "As_03": (COOKIE + packet(0, b"\x00ACGT"))[:-2],
        "As_04": COOKIE + notes,
        "As_05": b"",
        "As_06": COOKIE + packet(0, b"\x00AC!T"),
        "As_07": COOKIE + packet(0, b"\x00AC") + packet(0, b"\x00AC"),
        "As_08": COOKIE + packet(0, b""),
    }
    for name, content in files.items():
        (tmp_path / f"{name}.dna").write_bytes(content)
    (tmp_path / "As_09.dna").write_bytes(b"ACGT")
    (tmp_path / "other.txt").write_text("ACGT")
    got = {r["path"].rsplit("/", 1)[1][:5]: (r["dna"], r["circular"], r["problem"]) for r in packets.packet_files(spark, str(tmp_path)).collect()}
    assert got.pop("As_09")[2] == "no cookie" and got.keys() == files.keys() - {"As_05"}  # nothing to read
    assert got["As_01"] == ("ACGTN", False, None) and got["As_02"] == ("ACGTAC", True, None)
    assert all(got[n][:2] == (None, None) for n in got if n > "As_02")
    assert "cut off" in got["As_03"][2] and "0 sequence" in got["As_04"][2] and "!" in got["As_06"][2] and "2 sequence" in got["As_07"][2] and "empty" in got["As_08"][2]


NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def workbook(path, rows, strings):
    with zipfile.ZipFile(path, "w") as z:
        rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        z.writestr("xl/workbook.xml", f'<workbook {NS} xmlns:r="{rel}"><sheets><sheet name="b" sheetId="2" r:id="rId7"/><sheet name="a" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId7" Target="worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {NS}><sheetData/></worksheet>")
        z.writestr("xl/worksheets/sheet2.xml", f"<worksheet {NS}><sheetData>{rows}</sheetData></worksheet>")
        z.writestr("xl/sharedStrings.xml", f"<sst {NS}>{strings}</sst>")


def test_sheet(spark, tmp_path):
    strings = "<si><t>combo</t></si><si><t>score</t></si><si><r><t>AL</t></r><r><t>FM</t></r><rPh><t>no</t></rPh></si><si><t>n</t></si><si><t>active</t></si>"
    head = '<row r="1"><c r="A1" t="s"><v>1</v></c><c r="B1" t="s"><v>0</v></c><c r="D1" t="s"><v>3</v></c><c r="AA1" t="s"><v>4</v></c></row>'
    rows = head + (
        '<row r="2"><c r="A2"><v>1.5</v></c><c r="B2" t="s"><v>2</v></c><c r="D2"><v>3.0</v></c><c r="AA2" t="b"><v>1</v></c></row>'
        '<row r="3"/><row r="4"><c r="A4" t="e"><v>#DIV/0!</v></c><c r="B4" t="inlineStr"><is><t>in &amp; line</t></is></c></row>'
        '<row r="5"><c r="A5" t="str"><f>"x"</f><v>x</v></c><c r="AA5" t="b"><v>0</v></c></row>'
    )
    workbook(tmp_path / "results.xlsx", rows, strings)
    got = sheets.sheet(spark, str(tmp_path / "results.xlsx"), "combo string, score double, n int, active boolean").collect()
    assert [tuple(r) for r in got] == [("ALFM", 1.5, 3, True), ("in & line", None, None, None), (None, None, None, False)]
    (tmp_path / "results.csv").write_text("score,combo,n,active\n1.5,ALFM,3,true\n,in & line,,\n,,,false\n")
    table = spark.read.csv(str(tmp_path / "results.csv"), header=True, schema="score double, combo string, n int, active boolean")
    assert table.select(got[0].__fields__).collect() == got
    with pytest.raises(Exception, match="has no column other"):
        sheets.sheet(spark, str(tmp_path), "other string").collect()
    assert [sheets.column_of(x) for x in ("A1", "Z9", "AA1", "AB12")] == [0, 25, 26, 27]
