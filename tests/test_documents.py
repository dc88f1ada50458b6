import zipfile

from verdigris.sources import documents as D

BODY = """<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>
<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t>One </w:t></w:r><w:r><w:t>two</w:t></w:r></w:p>
<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a|b</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr><w:tr><w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p/></w:body></w:document>"""


def test_docx(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "good.docx", "w") as z:
        z.writestr("word/document.xml", BODY)
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    rows = D.read_docx(spark, str(tmp_path)).orderBy("file", "place").collect()
    assert [r.kind for r in rows] == ["error", "heading", "paragraph", "table"]
    assert rows[2].text == "One two" and rows[3].text == "| a\\|b |  |\n| --- | --- |\n| c |  |"


def test_wrapped_lines():
    assert D.join_wrapped("第一条 总则\n学校\n制定本办法。\n（一）甲\n乙") == "第一条 总则学校制定本办法。\n（一）甲乙"
    assert D.table_markdown([]) == ""
