import pytest

from quirewise.library import Library
from quirewise.operators.ingest import decode_uploads
from quirewise.streaming.ingest import upload_stream


@pytest.fixture()
def library(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "cat.txt").write_text("This is a test document about a cat.", encoding="utf-8")
    (tmp_path / "in" / "dog.txt").write_text("A dog sleeps all day.", encoding="utf-8")
    (tmp_path / "in" / "bad.zip").write_text("?")
    return Library(spark, str(tmp_path / "lib")), str(tmp_path / "in")


def echo():
    return lambda prompts: [p.split("\n\nQuestion: ")[0] for p in prompts]


def test_upload_ask_list_delete(spark, library):
    lib, folder = library
    questions = spark.createDataFrame([(1, "What is the document about a cat?")], "query_id int, text string")
    assert lib.list_documents("test_user").count() == 0
    assert lib.answers(questions, echo, "test_user").first()["answer"] == "Context:\n"

    result = {r["filename"]: r for r in lib.upload(folder, "test_user").collect()}
    assert result["cat.txt"]["success"] and result["dog.txt"]["success"] and not result["bad.zip"]["success"]
    listing = lib.list_documents("test_user")
    assert {(r["file_id"], r["filename"], r["type"]) for r in listing.collect()} == {("cat.txt", "cat.txt", "txt"), ("dog.txt", "dog.txt", "txt")}
    assert lib.list_documents("other").count() == 0

    row = lib.answers(questions, echo, "test_user").first()
    assert row["answer"].startswith("Context:\nThis is a test document about a cat.") and row["sources"].startswith("cat.txt")
    assert lib.answers(questions, echo, file_ids=["dog.txt"]).first()["sources"] == "dog.txt"
    assert lib.answers(questions, echo, "other").first()["sources"] == ""

    again = {r["filename"]: r["error"] for r in lib.upload(folder, "test_user").collect()}
    assert again["cat.txt"] == "key already stored"

    assert lib.delete_documents(["cat.txt"], "other").count() == 0
    assert [r["id"] for r in lib.delete_documents(["cat.txt", "none"], "test_user").collect()] == ["cat.txt"]
    assert [r["file_id"] for r in lib.list_documents("test_user").collect()] == ["dog.txt"]
    assert lib.vectors.filter("doc_id = 'cat.txt'").count() == 0 and lib.entities.filter("doc_id = 'cat.txt'").count() == 0

    lib.upload(folder, "test_user")
    assert lib.list_documents("test_user").count() == 2 and lib.vectors.count() == 2


def test_missing_file(library):
    with pytest.raises(FileNotFoundError):
        library[0].upload("/tmp/does_not_exist.txt", "test_user")


def test_streamed_uploads(spark, library, tmp_path):
    lib, folder = library
    progress = str(tmp_path / "progress")
    upload_stream(lib, folder, "ann", progress, files_per_batch=1)
    assert {r["file_id"] for r in lib.list_documents("ann").collect()} == {"cat.txt", "dog.txt"}
    (tmp_path / "in" / "new.txt").write_text("A new one.", encoding="utf-8")
    upload_stream(lib, folder, "ann", progress)
    assert lib.documents.count() == 3 and lib.vectors.count() == 3


def test_a_repeated_batch_replaces_itself(spark, library):
    lib, _ = library
    files = spark.createDataFrame([("a.txt", b"Ann"), ("a.txt", b"Bob")], "file string, content binary")
    for _ in range(2):
        result = lib.add(decode_uploads(files, "u"), "b1").collect()
        assert sorted((r["success"], r["error"]) for r in result) == [(False, "key repeated in this batch"), (True, None)]
        assert lib.documents.count() == 1 and lib.vectors.count() == 1 and lib.entities.count() == 1


@pytest.fixture()
def tables(spark, tmp_path):
    folder = tmp_path / "tables"
    folder.mkdir()
    (folder / "staff.csv").write_text('Name,Gender,Age\nAnn, Female ,41\nBob,male,36\n"Cy, ""Jr""\nsenior",MALE,x\nBob,male,36\nDee,,50\n', encoding="utf-8")
    from quirewise.sources.tabular import write_workbook

    (folder / "book.xlsx").write_bytes(write_workbook(["City", "People"], [("Ulm", "120"), ("Bonn", "330"), ("Ulm", "7")], {"People"}))
    (folder / "note.txt").write_text("Ann Lee lives in Ulm.", encoding="utf-8")
    lib = Library(spark, str(tmp_path / "lib2"))
    lib.upload(str(folder), "ann")
    return lib


def test_structured_requests_over_uploads(spark, tables, tmp_path):
    lib = tables
    males = lib.filter("staff.csv", {"column": "Gender", "operator": "==", "value": "Male"}, columns=["Name", "Age"])
    assert [tuple(r) for r in males.collect()] == [("Bob", "36"), ('Cy, "Jr"\nsenior', "x"), ("Bob", "36")]
    both = [{"column": "Gender", "operator": "==", "value": "male"}, {"column": "Age", "operator": ">", "value": "30"}]
    assert [r["Name"] for r in lib.filter("staff.csv", both, dedup=True, subset=["Name"]).collect()] == ["Bob"]
    assert lib.filter("staff.csv", both, count_only=True).first()["Count"] == 2
    assert lib.count("staff.csv", "Gender", "MALE") == 3
    assert [r["value"] for r in lib.distinct("staff.csv", "Name").collect()] == ["Ann", "Bob", 'Cy, "Jr"\nsenior', "Dee"]
    assert [tuple(r) for r in lib.filter("book.xlsx", {"column": "People", "operator": ">", "value": 100}).collect()] == [("Ulm", 120), ("Bonn", 330)]
    assert lib.count("book.xlsx", "City", "ulm", sheet="Sheet1") == 2
    with pytest.raises(ValueError, match="no sheet"):
        lib.table("book.xlsx", "Other")
    for bad in ("note.txt", "none.csv"):
        with pytest.raises(ValueError):
            lib.table(bad)
    out = lib.export("staff.csv", str(tmp_path / "out"), {"column": "Age", "operator": ">", "value": 40}, columns=["Name"])
    assert sorted(r["Name"] for r in spark.read.option("header", True).csv(out).collect()) == ["Ann", "Dee"]
    book = lib.export("book.xlsx", str(tmp_path / "books"), kind="xlsx")
    assert spark.read.parquet(book).first()["content"][:2] == b"PK"


def test_four_stores(spark, tables):
    lib = tables
    assert "Ann Lee" in {r["id"] for r in lib.nodes.collect()}
    nodes = spark.createDataFrame([("Ulm", "city"), ("Germany", "country")], "id string, type string")
    edges = spark.createDataFrame([("Ann Lee", "Ulm", "lives_in"), ("Ulm", "Germany", "in"), ("Ulm", "Mars", "in")], "src string, dst string, type string")
    refused = lib.add_graph(nodes, edges).collect()
    assert [(r["src"], r["dst"]) for r in refused] == [("Ulm", "Mars")]
    lib.add_triples(spark.createDataFrame([("Ulm", "in", "Germany"), ("Bonn", "in", "Germany")], "s string, p string, o string"))
    starts = spark.createDataFrame([("Ann Lee",)], "start string")
    assert [r["id"] for r in lib.traverse(starts, "lives_in").collect()] == ["Ulm"]
    assert {(r["id"], r["hop"]) for r in lib.within_hops(starts, 2).collect()} == {("Ulm", 1), ("Germany", 2)}
    assert [r["x"] for r in lib.match([("?x", "in", "Germany")]).orderBy("x").collect()] == ["Bonn", "Ulm"]

    questions = spark.createDataFrame([(1, "Ulm", None), (2, "Ann Lee", ["graph"])], "query_id int, text string, databases array<string>")
    found = {(r["query_id"], r["source"], r["id"]) for r in lib.search(questions).collect()}
    assert {(1, "relational", "note.txt"), (1, "graph", "Germany"), (1, "knowledge_graph", "Ulm"), (2, "graph", "Ulm")} <= found
    assert {s for q, s, _ in found if q == 2} == {"graph"} and any(s == "vector" for q, s, _ in found if q == 1)
    prompt = {r["query_id"]: r for r in lib.prompts_from_all(questions).collect()}
    assert "Ann Lee lives in Ulm." in prompt[1]["prompt"] and "Germany country" in prompt[1]["prompt"] and "Ulm in Germany" in prompt[1]["prompt"]
    assert prompt[2]["sources"] == "node:Ulm"


def test_metadata_filters(spark, tables):
    questions = spark.createDataFrame([(1, "Ulm")], "query_id int, text string")
    assert {r["doc_id"] for r in tables.ranked(questions, metadata={"file_type": "txt"}).collect()} == {"note.txt"}
    assert {r["doc_id"] for r in tables.ranked(questions, metadata={"structure_type": "excel"}).collect()} == {"book.xlsx"}
    assert tables.ranked(questions, metadata={"structure_type": "none"}).count() == 0


def test_compaction_applies_deletions(spark, tmp_path, monkeypatch):
    from quirewise import library as module
    from quirewise.operators import compaction

    monkeypatch.setattr(module, "TIER", 3)
    lib = Library(spark, str(tmp_path / "lib3"))
    for i in range(4):
        files = spark.createDataFrame([(f"f{i}{j}.txt", f"Text {i} {j}".encode()) for j in range(2)], "file string, content binary")
        lib.add(decode_uploads(files, "u"), f"b{i}")
    lib.delete_documents(["f00.txt", "f31.txt"], "u")
    before = {r["id"] for r in lib.documents.collect()}
    left = lib.compact()
    assert left["documents"] == 1 and left["deletions"] == 0
    assert {r["id"] for r in lib.documents.collect()} == before and lib.vectors.count() == 6
    assert "Join" not in lib.documents._jdf.queryExecution().optimizedPlan().toString()
    assert lib._read("documents").count() == 6
    for i in range(4, 6):
        lib.add(decode_uploads(spark.createDataFrame([(f"f{i}.txt", b"More")], "file string, content binary"), "u"), f"b{i}")
    assert lib.compact()["documents"] == 3  # two of the first tier are not yet merged
    path = f"{lib.folder}/documents"
    # a compaction that broke off after its batch took its place: the parts are read no more once it is finished
    compaction._write_text(spark, f"{path}/_parts", '{"name": "b4", "parts": ["b5"]}')
    lib.compact()
    assert lib.documents.count() == 7
