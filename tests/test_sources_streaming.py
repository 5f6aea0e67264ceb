import datetime as dt
import io
import zipfile

from pyspark.sql import functions as F

from quillspark.sources.files import read_folder
from quillspark.sources.store import Store
from quillspark.streaming import answers


def test_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("# Title\n\n\n\ntext **bold**", "utf-8")
    (tmp_path / "b.txt").write_text("plain  text", "utf-8")
    (tmp_path / "c.xyz").write_text("?", "utf-8")
    (tmp_path / "d.docx").write_bytes(b"no zip")
    (tmp_path / "bad.txt").write_bytes(b"\x01\x02\x03ab")
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>One</w:t></w:r><w:r><w:tab/><w:t>two</w:t></w:r></w:p><w:p><w:r><w:t>Three</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "e.docx").write_bytes(buffer.getvalue())
    (tmp_path / "f.pdf").write_bytes(b"%PDF-1.4\nstream\nBT (Hello) Tj ( \\(you\\)) Tj ET\nendstream\n")
    good, bad = read_folder(spark, str(tmp_path))
    assert {r["name"]: r["text"] for r in good.collect()} == {"a.md": "[Title]\n\ntext bold", "b.txt": "plain text", "e.docx": "One two\n\nThree", "f.pdf": "Hello (you)"}
    assert {r["path"].rsplit("/", 1)[1] for r in bad.collect()} == {"c.xyz", "d.docx", "bad.txt"}


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "t"))
    frame = lambda rows: spark.createDataFrame(rows, "k string, v int")
    store.upsert(frame([("a", 1), ("b", 1)]), "k")
    store.upsert(frame([("b", 2), ("c", 2)]), "k")
    store.delete(frame([("a", 0)]), "k")
    assert sorted(map(tuple, store.read().collect())) == [("b", 2), ("c", 2)] and store.versions() == [1, 2, 3]
    store.vacuum()
    assert store.versions() == [3]


def test_answer_events(spark):
    df = spark.createDataFrame([(1, "Two words", ["x"]), (2, None, [])], "k int, a string, c array<string>")
    found = [(r["k"], r["seq"], r["event"], r["payload"]) for r in answers.events(df, "k", "a", "c").orderBy("k", "seq").collect()]
    assert found == [(1, 0, "metadata", '{"key":1}'), (1, 1, "token", "Two"), (1, 2, "token", " words"), (1, 3, "citations", '["x"]'), (1, 4, "done", None), (2, 0, "metadata", '{"key":2}'), (2, 1, "done", None)]
    assert df.limit(1).select(answers.deltas(F.lit("ab cd"), F.lit("ab"))).first()[0] == " cd"


def test_lines(spark):
    df = spark.createDataFrame([(1, 0, '{"a"'), (1, 1, ':1}\n{"b'), (1, 2, '":2}\n\ntail')], "k int, s int, c string")
    assert [r["text"] for r in answers.lines(df, "k", "s", "c").orderBy("line").collect()] == ['{"a":1}', '{"b":2}', "tail"]


def test_stream_equals_table(spark, tmp_path):
    T = dt.datetime(2024, 1, 1)
    rows = [(i, T + dt.timedelta(minutes=7 * i), i % 3, float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, ts timestamp, user int, value double")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = answers.windowed(stream, "ts", "user", "value").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination(120)
    assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, answers.windowed(df, "ts", "user", "value").collect()))
    dup = answers.deduplicated(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "ts", "user", "30 days").writeStream.format("memory").queryName("u").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp2")).start()
    dup.awaitTermination(120)
    assert spark.table("u").count() == 3


def test_pdf_fonts_and_object_streams():
    import zlib

    from quillspark.sources.files import pdf_text

    cmap = b"1 beginbfchar <0001> <0414> endbfchar 1 beginbfrange <0002> <0004> <0430> <0005> <0005> [<0442>] endbfrange"
    shown = zlib.compress(b"BT /F1 12 Tf <00010002> Tj 0 -14 Td [(\\000\\003) -300 <0005>] TJ ET BT /F2 9 Tf (Plain \\(x\\) \\101) Tj T* (next) Tj ET")
    packed = zlib.compress(b"6 0 7 36 " + b"<< /Type /Font /ToUnicode 5 0 R >> ".ljust(36) + b"<< /Font << /F1 6 0 R >> >>")
    pdf = b"%PDF-1.5\n4 0 obj << /Filter /FlateDecode >> stream\n" + shown + b"\nendstream endobj\n5 0 obj << >> stream\n" + cmap + b"\nendstream endobj\n8 0 obj << /Type /ObjStm /N 2 /First 9 /Filter /FlateDecode >> stream\n" + packed + b"\nendstream endobj\n"
    assert pdf_text(pdf) == "Да\nб т\nPlain (x) A\nnext"
    assert pdf_text(b"") == "" and pdf_text(b"%PDF-1.4 broken stream") == ""
