import io
import json
import zipfile

from pyspark.sql import functions as F

from galley.sources import docx, gold, sinks
from galley.streaming import jobs
from tests.conftest import rows

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def archive(body: str, name="word/document.xml") -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(name, f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>')
        z.writestr("word/styles.xml", f'<w:styles xmlns:w="{W}"><w:style w:styleId="H1" w:type="paragraph"><w:name w:val="heading 1"/>'
                   '<w:pPr><w:outlineLvl w:val="0"/><w:spacing w:after="160"/></w:pPr></w:style></w:styles>')
    return out.getvalue()


BODY = (
    '<w:p><w:pPr><w:pStyle w:val="H1"/><w:jc w:val="center"/></w:pPr><w:r><w:rPr><w:b/><w:sz w:val="32"/></w:rPr><w:t>Глава 1</w:t></w:r></w:p>'
    "<w:p><w:r><w:t>Таблица 1 — Итоги</w:t></w:r></w:p>"
    "<w:tbl><w:tr><w:tc><w:p><w:r><w:rPr><w:b/></w:rPr><w:t>Имя</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    '<w:p><w:pPr><w:numPr><w:ilvl w:val="0"/><w:numId w:val="4"/></w:numPr></w:pPr><w:r><w:t>Пункт</w:t></w:r></w:p>'
    "<w:sdt><w:sdtContent><w:p><w:r><w:t>СОДЕРЖАНИЕ</w:t></w:r></w:p></w:sdtContent></w:sdt>"
)


def test_gate_and_read(spark, tmp_path):
    (tmp_path / "good.docx").write_bytes(archive(BODY))
    (tmp_path / "spoof.docx").write_bytes(archive(BODY, "other.xml"))
    (tmp_path / "plain.docx").write_bytes(b"hello")
    (tmp_path / "cut.docx").write_bytes(b"PK\x03\x04broken")
    (tmp_path / "notes.txt").write_bytes(b"x")
    (tmp_path / "torn.docx").write_bytes(archive("<w:p>"))
    gated = docx.gate_uploads(docx.read_files(spark, str(tmp_path)))
    reasons = {r.path.rsplit("/", 1)[1]: r.reason for r in gated.select("path", "reason").collect()}
    assert reasons == {"good.docx": None, "spoof.docx": "no_main_part", "plain.docx": "signature", "cut.docx": "damaged", "torn.docx": "damaged", "notes.txt": "extension"}
    parts = docx.read_manuscripts(docx.with_doc_id(gated.where("reason IS NULL")))
    p = parts["paragraphs"].orderBy("idx").collect()
    assert [r.text for r in p] == ["Глава 1", "Таблица 1 — Итоги", "Пункт"]
    assert (p[0].alignment, p[0].outline_level, p[0].bold_ratio, p[0].max_font_size_pt, p[0].space_after_pt) == ("center", 0, 1.0, 16.0, 8.0)
    assert [r.next_is_table for r in p] == [False, True, False] and [r.elem_no for r in p] == [0, 1, 3]
    assert (p[2].numpr_ilvl, p[2].numpr_num_id) == (0, 4)
    assert parts["hidden"].first().norm == "содержание"
    assert parts["table_cells"].first().bold_runs == 1


def test_gate_names_files_that_reading_would_skip(spark, tmp_path):
    whole = archive(BODY)
    for name, part, content in [("styles", "word/styles.xml", b"<w:styles"), ("bodiless", "word/document.xml", f'<w:document xmlns:w="{W}"/>'.encode())]:
        with zipfile.ZipFile(io.BytesIO(whole)) as old, zipfile.ZipFile(tmp_path / f"{name}.docx", "w") as new:
            for item in old.namelist():
                new.writestr(item, content if item == part else old.read(item))
    (tmp_path / "good.docx").write_bytes(whole)
    gated = docx.gate_uploads(docx.read_files(spark, str(tmp_path)))
    reasons = {r.path.rsplit("/", 1)[1]: r.reason for r in gated.select("path", "reason").collect()}
    assert reasons == {"good.docx": None, "styles.docx": "damaged", "bodiless.docx": "damaged"}


def test_write_findings_replaces(spark, tmp_path):
    path = str(tmp_path / "findings")
    first = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "doc_id long, type string")
    sinks.write_findings(spark, first, first.select("doc_id"), path)
    again = spark.createDataFrame([(2, "x"), (2, "y")], "doc_id long, type string")
    docs = spark.createDataFrame([(2,), (3,)], "doc_id long")
    for _ in range(2):
        sinks.write_findings(spark, again, docs, path)
        assert rows(sinks.read_findings(spark, path)) == [(1, "a"), (2, "x"), (2, "y")]
    sinks.compact_findings(spark, path, str(tmp_path / "compact"))
    assert rows(sinks.read_findings(spark, str(tmp_path / "compact"))) == [(1, "a"), (2, "x"), (2, "y")]


def test_export(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"])], "doc_id long, signals array<string>")
    sinks.export_table(df, str(tmp_path / "c"), "csv")
    sinks.export_table(df, str(tmp_path / "j"), "json")
    assert spark.read.csv(str(tmp_path / "c"), header=True).first().signals == "a, b"
    assert spark.read.json(str(tmp_path / "j")).first().signals == ["a", "b"]


def test_gold(spark, tmp_path):
    (tmp_path / "h.json").write_text(json.dumps({"documents": [{"filename": "a", "annotations": [{"paragraph_index": 3, "is_heading": True, "level": 2}, {"paragraph_index": 4, "is_heading": False, "level": 1}]}]}))
    (tmp_path / "f.json").write_text(json.dumps({"documents": [{"filename": "a", "expected_violations": [{"type": "t", "expected": True, "paragraph_index": 1}, {"type": "u", "expected": None}]}]}))
    assert rows(gold.read_heading_gold(spark, str(tmp_path / "h.json"))) == [("a", 3, True, 2), ("a", 4, False, None)]
    assert rows(gold.read_finding_gold(spark, str(tmp_path / "f.json")).select("type", "paragraph_index")) == [("t", 1)]


def test_intake_stream_is_idempotent(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    data = spark.createDataFrame([(1, 0, "ВВЕДЕНИЕ"), (1, 1, "текст [1][2]")], "doc_id long, idx int, text string")
    data.write.parquet(source)
    for run in range(2):
        stream = spark.readStream.schema(data.schema).parquet(source)
        jobs.intake_stream(spark, stream, out, str(tmp_path / "paragraphs"), str(tmp_path / f"cp{run}")).awaitTermination()
        found = sinks.read_findings(spark, out)
        assert found.where("type = 'citation_separator_missing'").count() == 1


def test_intake_stream_checks_a_manuscript_that_arrives_in_parts(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "doc_id long, idx int, text string"
    for part in ([(1, 0, "ВВЕДЕНИЕ"), (1, 1, "текст [1][2]")], [(1, 2, "ещё [3][4]")]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        jobs.intake_stream(spark, stream, out, str(tmp_path / "paragraphs"), str(tmp_path / "cp")).awaitTermination()
    found = sinks.read_findings(spark, out).where("type = 'citation_separator_missing'")
    assert rows(found.select("paragraph_index")) == [(1,), (2,)]


def test_status_stream(spark, tmp_path):
    source = str(tmp_path / "ev")
    rows_ = [(1, "started", None, "2024-01-01 10:00:00"), (1, "done", None, "2024-01-01 10:05:00"), (2, "error", "bad", "2024-01-01 10:00:00")]
    df = spark.createDataFrame(rows_, "doc_id long, step string, message string, ts string").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(source)
    got = {}
    stream = spark.readStream.schema(df.schema).parquet(source)
    query = jobs.job_status(stream, lambda batch, _: got.update({r.doc_id: (r.status, r.progress, r.error) for r in batch.collect()}), str(tmp_path / "cp"))
    query.awaitTermination()
    assert got == {1: ("done", 100, None), 2: ("error", 100, "bad")}


def test_small_archives_that_unpack_large_are_refused(spark, tmp_path):
    for part in ("word/document.xml", "word/styles.xml"):
        with zipfile.ZipFile(io.BytesIO(archive(BODY))) as old, zipfile.ZipFile(tmp_path / f"{part[5:-4]}.docx", "w", zipfile.ZIP_DEFLATED) as new:
            for item in {*old.namelist(), part}:
                new.writestr(item, b"<a>" + b" " * (docx.MAX_UNPACKED + 1) if item == part else old.read(item))
    assert all(file.stat().st_size < 1 << 20 for file in tmp_path.iterdir())
    gated = docx.gate_uploads(docx.read_files(spark, str(tmp_path)))
    assert {r.reason for r in gated.select("reason").collect()} == {"too_large_unpacked"}
    assert docx.read_manuscripts(docx.with_doc_id(docx.read_files(spark, str(tmp_path))))["paragraphs"].collect() == []
