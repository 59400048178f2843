"""Format parsers, loading, ingestion and sinks."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from paperloom.operators import models
from paperloom.operators import registry_ops as R
from paperloom.sources import formats, sinks
from paperloom.streaming import ingest


def zipped(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/").replace("_x", ".x"), text)
    return out.getvalue()


def test_formats():
    assert formats.parse(b"a,b\n1,\n,2,3\n", "csv") == ["Row 1 | a: 1\nRow 2 | b: 2 | col_3: 3"]
    assert formats.parse(b"<p>One</p><script>x()</script><nav>n</nav><p>Two</p>", "html") == ["One\n\nTwo"]
    assert formats.parse(b"# Head\n- item\n```x\ntext", "md") == ["Head\nitem\n\ntext"]
    assert formats.parse(b"<a><b c='d'>t</b></a>", "xml") == ["a/b: t\na/b@c: d"]
    with pytest.raises(ValueError):
        formats.parse(b"<!DOCTYPE a><a/>", "xml")
    mail = b"Subject: Hi\nFrom: a@b.c\nTo: d@e.f\nContent-Type: text/plain\n\nBody text"
    assert formats.parse(mail, "eml") == ["Subject: Hi\nFrom: a@b.c\nTo: d@e.f\n\nEmail Body:\nBody text"]
    with pytest.raises(ValueError):
        formats.parse(b"%PDF", "pdf")
    assert formats.parse(b"%PDF", "pdf", lambda data, ext: ["page one", ""]) == ["page one"]


def test_office_formats():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    doc = f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Term</w:t></w:r></w:p><w:p><w:r><w:t>One</w:t><w:tab/><w:t>two</w:t></w:r></w:p><w:p><w:r><w:br w:type="page"/><w:t>Next</w:t></w:r></w:p></w:body></w:document>'
    assert formats.parse(zipped(word__document_xml=doc), "docx") == ["## Term\nOne two", "Next"]
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    book = f'<workbook {s}><sheets><sheet name="S1"/></sheets></workbook>'
    sheet = f'<worksheet {s}><sheetData><row><c r="A1" t="inlineStr"><is><t>k</t></is></c></row><row><c r="A2"><v>5</v></c><c r="C2"><v>7</v></c></row></sheetData></worksheet>'
    assert formats.parse(zipped(xl__workbook_xml=book, xl__worksheets__sheet1_xml=sheet), "xlsx") == ["Sheet S1 | Row 2 | k: 5 | col_3: 7"]


def test_load_files_goes_on_after_bad_ones(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello\nworld")
    (tmp_path / "b.pdf").write_bytes(b"not a pdf")
    (tmp_path / "c.exe").write_bytes(b"x")
    (tmp_path / "d.md").write_bytes(b" ")
    rows = {r["file_name"]: r for r in formats.load_files(spark, str(tmp_path)).collect()}
    assert rows["a.txt"]["text"] == "hello\nworld" and rows["a.txt"]["page_number"] == 1
    assert rows["b.pdf"]["parse_error"] == "content is not of this type" and rows["c.exe"]["parse_error"] == "unsupported type" and rows["d.md"]["parse_error"] == "ValueError: no text"


def test_ingestion_is_idempotent(spark, tmp_path):
    def put(name, rows):
        spark.createDataFrame(rows, "doc_id string, file_path string, content_hash string, page_number int, text string").withColumn("arrived_at", F.current_timestamp()).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        ingest.start(spark, str(tmp_path / "in"), str(tmp_path / "store"), str(tmp_path / "ck")).awaitTermination()

    put("a", [("d1", "/x", "h1", 1, "old text of the file")])
    run()
    put("b", [("d1", "/x", "h1", 1, "old text of the file"), ("d2", "/x", "h2", 1, "new text of the file")])
    run()
    assert [r["doc_id"] for r in ingest.current(spark, str(tmp_path / "store"), "pages").collect()] == ["d2"]
    assert spark.read.parquet(str(tmp_path / "store" / "pages")).count() == 2
    ingest.merge_batch(str(tmp_path / "store"))(spark.read.parquet(str(tmp_path / "in")), 1)  # a batch that comes again
    assert spark.read.parquet(str(tmp_path / "store" / "ledger")).count() == 2


def test_bookkeeping(spark):
    files = spark.createDataFrame([("d1", "c1", "f1"), ("d2", None, "f2")], "doc_id string, case_id string, file_name string")
    chunks = spark.createDataFrame([("d1", 1), ("d2", 1)], "doc_id string, page_number int")
    assert [r[0] for r in R.in_case(chunks, files, None).collect()] == ["d2"]
    f, c = R.delete_case(files, chunks, "c1", cascade=False)
    assert c.count() == 2 and f.where("case_id is null").count() == 2
    f, c = R.delete_case(files, chunks, "c1", cascade=True)
    assert [r["doc_id"] for r in c.collect()] == ["d2"]
    s = spark.createDataFrame([("s", 1, "a")], "session_id string, updated_at bigint, name string")
    assert R.upsert_sessions(s, spark.createDataFrame([("s", 2, "b"), ("t", 1, "c")], s.schema), 1).collect()[0]["name"] == "b"
    assert R.set_attribute(files, "doc_id", "d1", "case_id", "  ").where("doc_id = 'd1'").first()["case_id"] is None
    e = spark.createDataFrame([("e1", "f1"), ("e2", "f2"), ("e3", "zz")], "name string, source_file string")
    assert [r["name"] for r in R.entities_of_case(e, files, None).collect()] == ["e2"]


def test_sinks_and_models(spark):
    c = spark.createDataFrame([(1, 'a "x".pdf', 2, 0.5, "text")], "n int, file_name string, page_number int, score double, excerpt string")
    assert sinks.citation_lines(c).first()["line"] == '1,"a ""x"".pdf",2,0.500,"text"'
    turns = spark.createDataFrame([("s", 2, "q2", "a2", ["f"]), ("s", 1, "q1", "a1", ["f", "f"])], "session_id string, turn int, question string, answer string, sources array<string>")
    memo = sinks.memo(turns).first()["memo"]
    assert memo.index("q1") < memo.index("q2") and memo.count("- f") == 2
    assert sinks.session_name("Smith v. Jones lease", ["Lease.pdf"]) == "Lease: Smith v. Jones"
    assert len(sinks.session_name("word " * 40)) <= 50
    rows = spark.createDataFrame([("one two",), ("one two",), (None,)], "text string")
    cache = spark.createDataFrame([(1, "k", [0.0] * 4)], "vec_id bigint, cache_key string, vector array<float>")
    got, fresh = models.with_cache(rows.where("text is not null"), cache, models.HashedWords(4))
    assert got.count() == 2 and fresh.count() == 1
    with pytest.raises(ValueError):
        ingest.safe_name("../x")
