from pyspark.sql import functions as F

from millrace.operators import conversations as C
from millrace.operators import flows as L
from millrace.sources import ingest as I
from millrace.sources import publish as P
from millrace.sources.page_source import PageSource


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\n\n two \n\n\n\n")
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "c.pdf").write_bytes(b"nothing")
    (tmp_path / "d.txt").write_bytes(b"")  # has no row
    (tmp_path / "e.exe").write_bytes(b"x")
    files = I.read_files(spark, str(tmp_path))
    reasons = {r.path.rsplit("/", 1)[1]: r.reason for r in files.collect()}
    assert reasons == {"a.txt": None, "b.pdf": None, "c.pdf": "not a PDF", "e.exe": "unknown kind"}
    pages = I.read_pages(files, lambda data: ["p1", "p2"]).select(F.substring_index("path", "/", -1).alias("f"), "page_number", "page_text").collect()
    assert sorted(map(tuple, pages)) == [("a.txt", 1, "one"), ("a.txt", 2, "two"), ("b.pdf", 1, "p1"), ("b.pdf", 2, "p2")]


#: Stands for a PDF library; workers import it.
EXTRACT = """
def extract(data):
    if b"/Encrypt" in data:
        raise PermissionError("encrypted")
    if b"%%EOF" not in data:
        raise ValueError("no end of file")
    return data.split(b"\\n", 1)[1].decode().split("|")[:-1]
"""


def folder(top):
    (top / "sub").mkdir()
    (top / "a.txt").write_text("one\n\n two \n\n\n")
    (top / "b.pdf").write_bytes(b"%PDF-1.7\np1|p2|%%EOF")
    (top / "broken.pdf").write_bytes(b"%PDF-1.7\np1|p2|")
    (top / "locked.pdf").write_bytes(b"%PDF-1.7\n/Encrypt|%%EOF")
    (top / "c.pdf").write_bytes(b"nothing")
    (top / "latin.txt").write_bytes(b"\xe9t\xe9")
    (top / "empty.txt").write_bytes(b"")
    (top / "sub/d.pdf").write_bytes(b"%PDF-1.7\nq1|%%EOF")
    (top / "e.exe").write_bytes(b"x")
    return sorted([
        ("a.txt", 1, "one", None), ("a.txt", 2, "two", None), ("b.pdf", 1, "p1", None), ("b.pdf", 2, "p2", None), ("d.pdf", 1, "q1", None), ("broken.pdf", None, None, "ValueError: no end of file"), ("locked.pdf", None, None, "PermissionError: encrypted"),
        ("c.pdf", None, None, "ValueError: not a PDF"), ("empty.txt", None, None, "ValueError: no pages"), ("e.exe", None, None, "ValueError: unknown kind"),
    ], key=repr)


def test_bad_files_leave_the_others_alone(spark, tmp_path):
    (top := tmp_path / "docs").mkdir()
    want = folder(top)
    (tmp_path / "own_extractor.py").write_text(EXTRACT)
    spark.sparkContext.addPyFile(str(tmp_path / "own_extractor.py"))
    spark.dataSource.register(PageSource)
    for size in (1, 1 << 20):  # a partition for each file, and one for all
        rows = spark.read.format("document_pages").option("extract", "own_extractor:extract").option("groupBytes", size).load(str(top))
        got = [(r.path.rsplit("/", 1)[1], r.page_number, r.page_text, r.error) for r in rows.collect()]
        assert sorted((r for r in got if r[0] != "latin.txt"), key=repr) == want
        assert [(p, t, e.split(":")[0]) for f, p, t, e in got if f == "latin.txt"] == [(None, None, "UnicodeDecodeError")]
        assert rows.rdd.getNumPartitions() >= 8 if size == 1 else rows.rdd.getNumPartitions() == 1


def test_errors_of_files_read_by_spark(spark, tmp_path):
    folder(tmp_path)
    exec(EXTRACT, own := {})
    rows = I.pages_and_errors(I.read_files(spark, str(tmp_path)), lambda data: own["extract"](data)).select(F.substring_index("path", "/", -1).alias("f"), "page_number", "error").collect()
    assert {r.f: r.error for r in rows if r.error and r.f != "latin.txt"} == {"broken.pdf": "ValueError: no end of file", "locked.pdf": "PermissionError: encrypted", "c.pdf": "not a PDF", "e.exe": "unknown kind"}
    assert sorted(r.f for r in rows if not r.error) == ["a.txt", "a.txt", "b.pdf", "b.pdf", "d.pdf"]


def test_ingest_of_a_folder(spark, tmp_path):
    (top := tmp_path / "docs").mkdir()
    folder(top)
    (top / "long.txt").write_text("A page of the first document that is long enough.\n\nAnother page of it, also long enough.")
    (top / "sub/copy.txt").write_bytes((top / "long.txt").read_bytes())
    exec(EXTRACT, own := {})
    path, extract = str(tmp_path / "table"), lambda data: own["extract"](data)
    assert L.ingest(I.read_files(spark, str(top)), path, "one", extract) == 1
    rows = P.published(spark, path, L.CHUNKS).collect()
    assert sorted((r.path.rsplit("/", 1)[1], r.chunk_index, r.page_number, len(r.embedding)) for r in rows) == [("long.txt", 0, 1, 16), ("long.txt", 1, 2, 16)]
    status = {r.error or "": r.status for r in P.statuses(spark, path).collect()}
    assert set(status.values()) == {"done", "failed"} and "ValueError: no end of file" in status and "PermissionError: encrypted" in status
    # The broken file is mended, and the next load reads what isn't done alone.
    (top / "broken.pdf").write_bytes(b"%PDF-1.7\nA page that is long enough to be kept|%%EOF")
    assert L.ingest(I.read_files(spark, str(top)), path, "two", extract) == 2
    read = [r.path.rsplit("/", 1)[1] for r in spark.read.parquet(f"{path}/begun/load=two").collect()]
    assert "broken.pdf" in read and "locked.pdf" in read and not {"long.txt", "copy.txt", "a.txt", "b.pdf"} & set(read)
    assert sorted(r.path.rsplit("/", 1)[1] for r in P.published(spark, path, L.CHUNKS).collect()) == ["broken.pdf", "long.txt", "long.txt"]


def test_partitions_are_replaced(spark, tmp_path):
    path = str(tmp_path / "chunks")
    rows = lambda *r: spark.createDataFrame(r, "content string, document_id int")
    I.replace_partitions(rows(("a", 1), ("b", 2)), path)
    for _ in range(2):
        I.replace_partitions(rows(("c", 2)), path)
    assert sorted((r.content, r.document_id) for r in spark.read.parquet(path).collect()) == [("a", 1), ("c", 2)]


def test_json_dimension(spark, tmp_path):
    (tmp_path / "d.json").write_text('[{"name": "x",\n "fee": 3}]')
    assert I.read_json_dimension(spark, str(tmp_path / "d.json"), "name string, fee long").first().fee == 3


def test_results_resume(spark, tmp_path):
    cases, path = spark.createDataFrame([(k,) for k in range(5)], "case_id int"), str(tmp_path / "results")
    for batch, ids in (("a", [0, 1]), ("a", [0, 1]), ("b", [3])):
        I.save_results(spark.createDataFrame([(k, "answered") for k in ids], "case_id int, status string"), path, batch)
    done = spark.read.parquet(path)
    assert sorted(r.case_id for r in done.collect()) == [0, 1, 3]
    assert sorted(r.case_id for r in I.without_result(cases, done, "case_id").collect()) == [2, 4]


def test_appended_turns(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b")], "conv_id long, turn long, role string, text string")
    asked = spark.createDataFrame([(1, 5, "d", None), (1, 4, "c", "x"), (2, 1, "e", "y")], "conv_id long, asked int, question string, answer string")
    new = C.appended_turns(turns, asked, "conv_id", "turn", "role", "text", "asked", "question", "answer")
    assert new.columns == turns.columns
    assert sorted((r.conv_id, r.turn, r.role, r.text or "") for r in new.collect()) == [
        (1, 2, "user", "c"), (1, 3, "assistant", "x"), (1, 4, "user", "d"), (1, 5, "assistant", ""), (2, 0, "user", "e"), (2, 1, "assistant", "y"),
    ]
