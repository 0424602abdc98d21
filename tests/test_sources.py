import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quirewise.errors import SheetError
from quirewise.operators import ingest
from quirewise.operators.tables import drop_duplicates
from quirewise.plans.derived import build_docx, build_pptx
from quirewise.sources import documents, listing, tabular
from quirewise.streaming import ingest as stream

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
RELS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006/relationships"


def workbook(sheets, shared=(), styles=""):
    """Workbook bytes from ``{name: sheetData xml}``."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        entries = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{RELS}"><sheets>{entries}</sheets></workbook>')
        rels = "".join(f'<Relationship Id="rId{i}" Target="worksheets/s{i}.xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{PACKAGE}">{rels}</Relationships>')
        for i, data in enumerate(sheets.values(), 1):
            z.writestr(f"xl/worksheets/s{i}.xml", f'<worksheet xmlns="{MAIN}"><sheetData>{data}</sheetData></worksheet>')
        if shared:
            items = "".join(f"<si><r><t>{s[:1]}</t></r><r><t>{s[1:]}</t></r></si>" for s in shared)
            z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}">{items}</sst>')
        if styles:
            z.writestr("xl/styles.xml", f'<styleSheet xmlns="{MAIN}">{styles}</styleSheet>')
    return out.getvalue()


PEOPLE = (
    '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>Age</t></is></c><c r="C1" t="inlineStr"><is><t>Born</t></is></c>'
    '<c r="D1" t="inlineStr"><is><t>Paid</t></is></c><c r="E1" t="inlineStr"><is><t>Age</t></is></c></row>'
    '<row r="2"><c r="A2" t="s"><v>1</v></c><c r="B2"><v>36</v></c><c r="C2" s="1"><v>45292.5</v></c><c r="D2" t="b"><v>1</v></c><c r="E2"><v>1.5</v></c></row>'
    '<row r="3"><c r="A3" t="str"><v>Bo</v></c><c r="C3" s="2"><v>45293</v></c><c r="D3" t="b"><v>0</v></c><c r="E3"><v>2</v></c></row>'
)
STYLES = '<numFmts><numFmt numFmtId="170" formatCode="dd/mm/yyyy"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="22"/><xf numFmtId="170"/></cellXfs>'


@pytest.fixture(scope="module")
def books(spark):
    one = workbook({"People": PEOPLE}, ["Name", "Ann"], STYLES)
    two = workbook({"A": '<row r="1"><c r="A1"><v>1</v></c></row>', "B": '<row r="1"><c r="B1" t="inlineStr"><is><t>x</t></is></c></row><row r="2"><c r="B2"><v>5</v></c></row>'})
    files = [("one.xlsx", one), ("two.xlsx", two), ("bad.xlsx", one[:50]), ("empty.xlsx", b"")]
    return tabular.scan_workbooks(spark.createDataFrame(files, "file string, content binary")).cache()


def test_workbook_types_and_headers(books):
    table = tabular.sheet_table(tabular.choose_sheet(books.filter("file = 'one.xlsx'")))
    assert dict(table.drop("file").dtypes) == {
        "row_no": "int", "Name": "string", "Age": "double", "Born": "timestamp_ntz", "Paid": "boolean", "Age.1": "double",
    }
    first, second = table.orderBy("row_no").collect()
    assert (first["Name"], first["Age"], str(first["Born"]), first["Paid"], first["Age.1"]) == ("Ann", 36.0, "2024-01-01 12:00:00", True, 1.5)
    assert (second["Name"], second["Age"], str(second["Born"])) == ("Bo", None, "2024-01-02 00:00:00")


def test_sheet_choice(books):
    two = books.filter("file = 'two.xlsx'")
    with pytest.raises(SheetError, match="'A', 'B'"):
        tabular.choose_sheet(two)
    with pytest.raises(SheetError, match="no sheet"):
        tabular.choose_sheet(two, "C")
    assert tabular.sheet_table(tabular.choose_sheet(two, "B")).columns == ["file", "row_no", "Unnamed: 0", "x"]
    only_header = tabular.sheet_table(tabular.choose_sheet(two, "A"))
    assert only_header.columns == ["file", "row_no", "1"] and only_header.count() == 0


def test_workbooks_with_other_headers_keep_all_columns(spark):
    def book(name):
        head = f'<row r="1"><c r="A1" t="inlineStr"><is><t>id</t></is></c><c r="B1" t="inlineStr"><is><t>{name}</t></is></c></row>'
        return workbook({"S": head + '<row r="2"><c r="A2"><v>1</v></c><c r="B2"><v>2</v></c></row>'})

    rows = tabular.scan_workbooks(spark.createDataFrame([("1", book("x")), ("2", book("y"))], "file string, content binary"))
    got = tabular.sheet_table(rows)
    assert got.columns == ["file", "row_no", "id", "x", "y"]
    assert sorted((r["file"], r["x"], r["y"]) for r in got.collect()) == [("1", 2.0, None), ("2", None, 2.0)]


def test_csv_files_with_swapped_columns_are_refused(spark, tmp_path):
    (tmp_path / "1.csv").write_text("a,b\n1,2\n")
    (tmp_path / "2.csv").write_text("b,a\n20,10\n")
    with pytest.raises(Exception, match="header"):
        tabular.scan_csv(spark, str(tmp_path)).collect()


def test_blank_rows_keep_their_place(spark):
    data = (
        '<row r="2"><c r="A2" t="inlineStr"><is><t>h</t></is></c></row><row r="3"><c r="A3"><v>1</v></c></row>'
        '<row r="5"/><row r="7"><c r="A7"><v>2</v></c></row><row r="9"><c r="A9"/></row>'
    )
    rows = tabular.scan_workbooks(spark.createDataFrame([("w", workbook({"S": data}))], "file string, content binary"))
    table = tabular.sheet_table(rows)
    assert [r["h"] for r in table.orderBy("row_no").collect()] == [1.0, None, None, None, 2.0]


def test_damaged_workbooks_are_error_rows(books):
    bad = {r["file"]: r["error"] for r in books.filter("error is not null").collect()}
    assert set(bad) == {"bad.xlsx", "empty.xlsx"} and all("BadZipFile" in e for e in bad.values())


def test_workbook_export_round_trip(spark):
    df = spark.createDataFrame([(i, f"<a&{i}>" if i % 3 else None, i / 4) for i in range(25)], "n int, s string, f double")
    made = tabular.export_workbooks(df, "n", ["n", "s", "f"], rows_per_book=10)
    assert made.count() == 3
    back = tabular.sheet_table(tabular.choose_sheet(tabular.scan_workbooks(made)))
    assert sorted(tuple(r)[2:] for r in back.collect()) == sorted((r["n"], r["s"], r["f"]) for r in df.collect())


def test_csv_round_trip_missing_and_order(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Name,Note\nAnn,"x, ""y"""\nNA,null\nAnn,second\n', encoding="utf-8")
    df = tabular.scan_csv(spark, str(tmp_path / "a.csv"), with_order=True)
    rows = df.orderBy("_order").collect()
    assert [(r["Name"], r["Note"]) for r in rows] == [("Ann", 'x, "y"'), (None, None), ("Ann", "second")]
    first = drop_duplicates(df, ["Name"], "_order").filter("Name = 'Ann'").first()
    assert first["Note"] == 'x, "y"'
    out = str(tmp_path / "out")
    tabular.write_csv(df.select("Name", "Note"), out)
    assert sorted(map(tuple, tabular.scan_csv(spark, out).collect()), key=repr) == sorted(((r["Name"], r["Note"]) for r in rows), key=repr)


def test_csv_dates_stay_text(spark, tmp_path):
    (tmp_path / "d.csv").write_text("d\n2024-01-02\n", encoding="utf-8")
    assert tabular.scan_csv(spark, str(tmp_path / "d.csv")).dtypes == [("d", "string")]


def test_csv_line_breaks_inside_quotes(spark, tmp_path):
    (tmp_path / "m.csv").write_text('a,b\n"1\n2",x\n', encoding="utf-8")
    assert tabular.scan_csv(spark, str(tmp_path / "m.csv"), multiline=True).first()["a"] == "1\n2"


def test_text_is_verbatim(spark, tmp_path):
    (tmp_path / "test.txt").write_text("This is a test document.\n second", encoding="utf-8")
    row = documents.scan_text(spark, str(tmp_path)).first()
    assert (row["filename"], row["content"]) == ("test.txt", "This is a test document.\n second")
    (tmp_path / "empty.txt").write_text("")
    both = {r["filename"]: r["content"] for r in documents.scan_text(spark, str(tmp_path)).collect()}
    assert both == {"test.txt": "This is a test document.\n second", "empty.txt": ""}


def test_markdown_sections(spark):
    df = spark.createDataFrame([(1, "intro\n# One\ntext\n## Two\nmore #not")], "id int, content string")
    out = documents.markdown_sections(df, doc_id="id", content="content").orderBy("section_no").collect()
    assert [r["section"] for r in out] == ["intro\n", "One\ntext\n", "Two\nmore #not"]


def test_extraction_never_fails_the_job(spark):
    files = [
        ("a.docx", build_docx("one <&>\n\ntwo\tthree")), ("b.pptx", build_pptx("run 1\nrun 2")), ("c.docx", build_docx("x")[:30]),
        ("d.pdf", b"%PDF"), ("e.bin", b""), ("f.txt", "é\r\nx".encode()), ("g.txt", b"\xff\xfe"), ("h.docx", b""),
    ]
    out = {r["file"]: r for r in documents.extract_documents(spark.createDataFrame(files, "file string, content binary")).collect()}
    assert out["a.docx"]["content"] == "one <&>\n\ntwo\tthree" and out["b.pptx"]["content"] == "run 1\nrun 2"
    assert out["f.txt"]["content"] == "é\nx" and out["f.txt"]["error"] is None
    for name in ("c.docx", "d.pdf", "e.bin", "g.txt", "h.docx"):
        assert out[name]["error"] and out[name]["content"].startswith(f"[Error processing document: {name}. Error:")


def test_pdf_decoder_can_be_plugged_in(spark):
    files = spark.createDataFrame([("a.pdf", b"text"), ("b.PDF", b" ")], "file string, content binary")
    out = {r["file"]: r for r in documents.extract_documents(files, {".pdf": lambda b: b.decode()}).collect()}
    assert out["a.pdf"]["content"] == "text"
    assert "no extractable text" in out["b.PDF"]["content"] and out["b.PDF"]["error"] == "no extractable text"


def test_slides_come_in_show_order(spark):
    from quirewise.sources.office import read_pptx

    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(build_pptx("x"))) as source, zipfile.ZipFile(out, "w") as z:
        slide = source.read("ppt/slides/slide1.xml").decode()
        ids = "".join(f'<p:sldId id="{256 + n}" r:id="r{n}"/>' for n in (2, 10, 1))
        z.writestr("ppt/presentation.xml", f'<p:presentation xmlns:p="p" xmlns:r="{RELS}"><p:sldIdLst>{ids}</p:sldIdLst></p:presentation>')
        rels = "".join(f'<Relationship Id="r{n}" Target="slides/slide{n}.xml"/>' for n in (1, 2, 10))
        z.writestr("ppt/_rels/presentation.xml.rels", f'<Relationships xmlns="{PACKAGE}">{rels}</Relationships>')
        for n in (1, 2, 10):
            z.writestr(f"ppt/slides/slide{n}.xml", slide.replace(">x<", f">slide {n}<"))
    assert read_pptx(out.getvalue()) == "slide 2\nslide 10\nslide 1"


# ---- ingest --------------------------------------------------------------------------------


def test_upload_and_ingest_a_folder(spark, tmp_path):
    (tmp_path / "test.txt").write_text("This is a test document about Ann.", encoding="utf-8")
    (tmp_path / "t.csv").write_text("a,b\n1,2\n", encoding="utf-8")
    (tmp_path / "w.xlsx").write_bytes(workbook({"S": '<row r="1"><c r="A1" t="inlineStr"><is><t>h</t></is></c></row><row r="2"><c r="A2"><v>7</v></c></row>'}))
    (tmp_path / "broken.xlsx").write_bytes(b"zip?")
    (tmp_path / "x.zip").write_bytes(b"")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "w.xlsx").write_bytes((tmp_path / "w.xlsx").read_bytes())
    uploads = ingest.read_uploads(spark, str(tmp_path), "test_user")
    stored = spark.createDataFrame([("t.csv",)], "id string")
    batch = ingest.ingest_documents(uploads, stored)
    docs = {r["id"]: r for r in batch.documents.collect()}
    assert set(docs) == {"test.txt", "w.xlsx", "broken.xlsx"}
    assert docs["test.txt"]["content"] == "This is a test document about Ann." and docs["test.txt"]["user_id"] == "test_user"
    assert docs["test.txt"]["title"] == "test.txt" and docs["test.txt"]["created_at"] is not None
    assert docs["w.xlsx"]["content"] == "Sheet S:\nh\n7" and docs["w.xlsx"]["structure_type"] == "excel"
    assert docs["broken.xlsx"]["content"].startswith("[Error processing document: broken.xlsx")
    rejects = {r["id"]: r["error"] for r in batch.rejects.collect()}
    assert rejects == {
        "t.csv": "key already stored", "x.zip": "File type .zip is not supported.", "w.xlsx": "key repeated in this batch",
    }
    vectors = {r["doc_id"]: r for r in batch.vectors.collect()}
    assert vectors["w.xlsx"]["metadata"] == {
        "source": "w.xlsx", "file_type": "xlsx", "is_structured": "true", "structure_type": "excel",
    }
    assert "Ann" in {r["id"] for r in batch.nodes.collect()}


def test_missing_path_raises_before_any_job(spark):
    with pytest.raises(FileNotFoundError):
        ingest.read_uploads(spark, "/tmp/does_not_exist.txt", "u")


def test_directory_listing_reads_no_content(spark, tmp_path):
    (tmp_path / "u1").mkdir()
    (tmp_path / "u1" / "a.txt").write_text("x")
    (tmp_path / "u 2+%41").mkdir()
    (tmp_path / "u 2+%41" / "b c.txt").write_text("")
    (tmp_path / "u 2+%41" / "d e.txt").write_text("x")
    listed = listing.list_files(spark, str(tmp_path))
    got = sorted((r["filename"], r["directory"], r["length"]) for r in listed.collect())
    assert got == [("a.txt", "u1", 1), ("b c.txt", "u 2+%41", 0), ("d e.txt", "u 2+%41", 1)]
    assert "content" not in listed.columns


# ---- streaming -----------------------------------------------------------------------------


def test_stream_in_batches_equals_one_batch(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    source, target, refused, progress = (str(tmp_path / n) for n in ("in", "out", "refused", "progress"))
    docs.repartitionByRange(4, "doc_id").write.parquet(source)

    def run():
        arriving = stream.table_stream(spark, source, docs.schema, files_per_batch=1)
        stream.ingest_stream(arriving, target, refused, progress, ["text"], ["doc_id"])
        return spark.read.parquet(target)

    out = run()
    assert out.select(stream.BATCH).distinct().count() == 4
    texts = docs.select("text").distinct().count()
    assert out.count() == texts == out.select("text").distinct().count()
    assert spark.read.parquet(refused).count() == docs.count() - texts
    assert run().count() == texts  # nothing new has arrived
    docs.limit(5).withColumn("doc_id", F.col("doc_id") + 10_000).write.mode("append").parquet(source)
    docs.limit(1).withColumn("text", F.lit("brand new")).write.mode("append").parquet(source)
    assert run().count() == texts + 1


def test_replayed_batch_adds_nothing(spark, tmp_path):
    target, refused = str(tmp_path / "out"), str(tmp_path / "refused")
    write = stream.append_new_keys(target, refused, ["k"], ["n"])
    first = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, n int")
    write(first, 0)
    write(spark.createDataFrame([("b", 4), ("c", 5)], "k string, n int"), 1)
    write(spark.createDataFrame([("b", 4), ("c", 5)], "k string, n int"), 1)
    rows = spark.read.parquet(target).collect()
    assert sorted((r["k"], r["n"]) for r in rows) == [("a", 1), ("b", 3), ("c", 5)]


def test_csv_breaks_and_long_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n1,"x\ny"\n2,z\n', encoding="utf-8")
    (tmp_path / "b.csv").write_text("a,b\n3,w\n4\n", encoding="utf-8")
    rows = tabular.scan_csv(spark, str(tmp_path), multiline=None, with_order=True).orderBy("_order").drop("_order").collect()
    assert [tuple(r) for r in rows] == [("1", "x\ny"), ("2", "z"), ("3", "w"), ("4", None)]
    (tmp_path / "b.csv").write_text('a,b\n3,"w,1"\n5,6,7\n', encoding="utf-8")
    with pytest.raises(Exception, match="3 cells under a header of 2"):
        tabular.scan_csv(spark, str(tmp_path / "b.csv")).collect()
    rows = tabular.scan_csv(spark, str(tmp_path / "b.csv"), with_errors=True).collect()
    assert [tuple(r) for r in rows] == [("3", "w,1", None), (None, None, "a row has 3 cells under a header of 2")]
