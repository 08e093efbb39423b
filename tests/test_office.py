"""Texts of documents and slides, and checks of streams."""

import io
import zipfile

import pytest

from weirflow.plans import checks
from weirflow.sources import office

W, A = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"', 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'


def packed(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name, text)
    return out.getvalue()


def word(*parts):
    return packed({"word/document.xml": f"<w:document {W}><w:body>{''.join(parts)}</w:body></w:document>"})


def para(*runs, style=None, item=False):
    props = (f'<w:pStyle w:val="{style}"/>' if style else "") + ("<w:numPr/>" if item else "")
    return f"<w:p><w:pPr>{props}</w:pPr>{''.join(f'<w:r><w:t>{r}</w:t></w:r>' for r in runs)}</w:p>"


def test_documents_and_slides(spark, tmp_path):
    table = f"<w:tbl><w:tr><w:tc>{para('a')}</w:tc><w:tc>{para('b')}{para('c')}</w:tc></w:tr><w:tr><w:tc>{para('1')}</w:tc><w:tc>{para('')}</w:tc></w:tr></w:tbl>"
    (tmp_path / "w.docx").write_bytes(word(para("My ", "title", style="Title"), para("Part &amp; one", style="Heading2"), para("plain ", "text é"), para(""), para("item", item=True), table))
    slide = lambda title, *lines: f'<p:sld {A}><p:sp><p:nvPr><p:ph type="title"/></p:nvPr><a:p><a:r><a:t>{title}</a:t></a:r></a:p></p:sp><p:sp>{"".join(f"<a:p><a:r><a:t>{x}</a:t></a:r></a:p>" for x in lines)}</p:sp></p:sld>'
    (tmp_path / "s.pptx").write_bytes(packed({"ppt/slides/slide10.xml": slide("Last"), "ppt/slides/slide2.xml": slide("Second", "x", "y"), "ppt/other.xml": "<x/>"}))
    (tmp_path / "t.md").write_text("# as it is\n")
    (tmp_path / "b.docx").write_bytes(b"broken")
    (tmp_path / "e.docx").write_bytes(packed({"other.xml": "<x/>"}))
    (tmp_path / "u.bin").write_bytes(b"?")
    got = {r.document_key.rpartition("/")[2]: (r.content, r.parse_error) for r in office.read_office(spark, str(tmp_path)).collect()}
    assert got["w.docx"] == ("# My title\n\n## Part & one\n\nplain text é\n\n- item\n\n| a | b c |\n| 1 |  |", None)
    assert got["s.pptx"] == ("# Second\n\nx\n\ny\n\n# Last", None) and got["t.md"] == ("# as it is\n", None)
    assert all(got[n][0] is None and "no docx document" in got[n][1] for n in ("b.docx", "e.docx")) and got["u.bin"] == (None, "no parser for this kind of file")
    with pytest.raises(Exception, match="b.docx"):
        office.read_office(spark, str(tmp_path), "b*", skip_broken=False).collect()


def test_streams_are_checked(spark):
    streams = {"good": lambda: spark.range(3), "empty": lambda: spark.range(0), "bad": lambda: spark.read.parquet("/nowhere"), "late": lambda: spark.sql("SELECT raise_error('broken row')")}
    found = checks.checked(streams)
    assert found["good"] == (True, "") and found["empty"] == (True, "no records") and not found["bad"][0] and "nowhere" in found["bad"][1] and not found["late"][0]
    assert list(checks.checked(streams, most=2)) == ["good", "empty"] and checks.available(streams["empty"], needs_rows=True) == (False, "no records")
    with pytest.raises(ValueError, match="no streams named other"):
        checks.checked(streams, ["good", "other"])
