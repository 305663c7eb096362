import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from docmill.functions import structure as B
from docmill.operators import more
from docmill.sources import readers


def packed(**names):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in names.items():
            z.writestr(name.replace("__", "/").replace("_x", "."), text)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
DOCX = packed(word__document_xxml=f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>One </w:t></w:r><w:r><w:t>two</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>', word__media__i_xpng="x")
EPUB = packed(
    **{"META-INF__container_xxml": '<container><rootfiles><rootfile full-path="O/c.opf"/></rootfiles></container>'},
    O__c_xopf='<package><manifest><item id="a" href="a.xhtml"/><item id="b" href="b.xhtml"/></manifest><spine><itemref idref="b"/><itemref idref="a"/><itemref idref="no"/></spine></package>',
    O__a_xxhtml="<html><head><title>t</title></head><body><p>Last &nbsp; one</p></body></html>",
    O__b_xxhtml="<html><body><h1>First</h1><div><p>in <b>it</b></p><ul><li>item</li></ul></div><p> </p></body></html>",
)
SRT = b"1\r\n00:00:01,000 --> 00:00:02,000\r\nHi\r\n\r\n2\n00:00:03,000 --> 00:00:04,000\n\nx"


def test_blocks_of_all_file_types(spark, tmp_path):
    for name, raw in {"a.docx": DOCX, "b.epub": EPUB, "c.srt": SRT, "d.txt": "one\n\n \ntwo".encode("utf-16"), "e.docx": b"broken", "f.bin": b"\x00\x01", "g.txt": b""}.items():
        (tmp_path / name).write_bytes(raw)
    got = {}
    for r in readers.all_blocks(readers.files(spark, str(tmp_path))).orderBy("path", "ord").collect():
        got.setdefault(r.path.rsplit("/", 1)[-1], []).append(r.text)
    assert got == {"a.docx": ["Title", "One two", "a | b"], "b.epub": ["First", "in it", "item", "Last one"], "c.srt": ["Hi"], "d.txt": ["one", "two"]}
    counts = readers.structure_counts(readers.files(spark, str(tmp_path), "*.docx")).collect()
    assert [(r.paragraphs, r.tables, r.images) for r in counts] == [(5, 1, 1)]
    assert {r.path.rsplit("/", 1)[-1]: r.encoding for r in readers.texts(readers.files(spark, str(tmp_path), "*.txt")).collect()} == {"d.txt": "utf-16"}
    assert readers.decoded(b"") == ("", "empty")


def test_encodings():
    for name in ("utf-8", "utf-8-sig", "utf-16", "cp1252"):
        assert readers.decoded("año — “x” é".encode(name))[0] == "año — “x” é"
    assert readers.decoded("plain text of it".encode("utf-16-le")) == ("plain text of it", "utf-16-le") and readers.decoded(b"\x81\x8d")[1] == "latin-1"
    assert readers.decoded("traducciÃ³n".encode())[0] == "traducción"


def test_json_in_texts_and_files(spark, tmp_path):
    assert readers.first_json('x {"a": "}"} y') == '{"a": "}"}' and readers.first_json("[1, {2]}") is None and readers.first_json("none") is None and readers.first_json('{"a\\"b": [') is None
    for k in range(2):
        (tmp_path / f"{k}.json").write_text(json.dumps({"model": {"id": f"m{k}"}, "translations": [{"text_id": t, "output": "o"} for t in "ab"]}, indent=1))
    got = readers.exploded_json(spark, f"{tmp_path}/*.json", "translations", "model.id").collect()
    assert sorted((r.id, r.text_id) for r in got) == [("m0", "a"), ("m0", "b"), ("m1", "a"), ("m1", "b")]


def test_sinks_never_overwrite(spark, tmp_path):
    rows = spark.createDataFrame([(1, None), (2, 0.5)], "id int, score double")
    assert [readers.publish(rows, f"file://{tmp_path}/out") for _ in range(2)] == [f"file://{tmp_path}/out", f"file://{tmp_path}/out (2)"]
    assert spark.read.parquet(f"{tmp_path}/out (2)").count() == 2
    readers.write_csv(rows, f"{tmp_path}/csv")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/csv").collect())[:1] == ["1,"]
    with pytest.raises(Exception, match="already exists"):
        readers.write_csv(rows, f"{tmp_path}/csv")


def test_own_parsers(spark):
    readers.register("log", lambda raw: [(k, "line", x) for k, x in enumerate(raw.decode().splitlines())])
    found = spark.createDataFrame([("a.log", bytearray(b"x\ny"))], "path string, content binary")
    assert [r.text for r in readers.blocks(found, "log").orderBy("ord").collect()] == ["x", "y"]
    del readers.PARSERS["log"]


def test_block_kinds_in_order(spark):
    texts = ["1. a note\nBooks, ed. 3", "see https://example.org and go on with it, please.", "CONTENTS", "a = b + c", "1 2 3\n4 5 6\nx", "Jean Valjean", "it is a line of prose.", "12 of 30", "[a](b)\n[c](d)", "z-library", ""]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(99, None)], "i int, t string")
    got = {r.i: (r.type, r.policy) for r in B.classified(docs, "i", "t").collect()}
    assert got == {0: ("note", "translate"), 1: ("narrative", "translate"), 2: ("toc", "reconstruct"), 3: ("formula", "preserve"), 4: ("table", "reconstruct"), 5: ("title", "translate"), 6: ("narrative", "translate"), 7: ("header_footer", "exclude"), 8: ("junk_link", "clean"), 9: ("watermark", "exclude")}


def test_memory_keys_hide_secrets(spark):
    key = lambda **o: spark.range(1).select(more.memory_key(F.lit(" a  b"), F.lit(None).cast("string"), F.lit(""), F.create_map(*[F.lit(x) for p in o.items() for x in p]), F.lit("en")).alias("k")).first().k
    assert key(style="x", api_key="1") == key(style="x", api_key="2") == key(api_key="3", style="x", _fidelity_report="9") and key(style="y", api_key="1") != key(style="x", api_key="1")
    with pytest.raises(KeyError):
        more.apply_rules(F.lit("x"), ["no such rule"])


def test_reports(spark):
    docs = spark.createDataFrame([(1, "fine text"), (2, "traducciÃ³n"), (3, "see oceanofpdf.com"), (4, None), (5, "a\n\n1\n2\n3")], "i int, t string")
    got = {r.i: r.status for r in more.output_report(docs, "i", "t", F.lit(0)).collect()}
    assert got == {1: "pass", 2: "fail", 3: "warn", 4: "fail", 5: "warn"}
    pairs = spark.createDataFrame([(1, "the Thing", "the thing"), (2, None, None)], "k int, s string, t string")
    assert [(r.k, r.code) for r in more.detector_hits(pairs, [("x", "low", "THING", "both"), ("y", "low", "(", "both")], ["k"]).collect()] == [(1, "x")]
