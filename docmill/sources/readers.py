"""Readers over Spark's binary files: any store that Spark reads, a row a file, parsed in Arrow batches by executors.

Parsers use the standard library alone and see one file at a time. Defined cases: Spark's scan passes over files without
a byte, so these have no row; empty content is an empty text, read as `empty`; a file that no parser can read gives no
blocks.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.functions.cleaning import mended

#: File types by extension.
TYPES = {"epub": "epub", "srt": "srt", "docx": "docx", "pdf": "pdf"}
TEXT = "txt text log md markdown rst asc cfg ini conf csv tsv json xml html htm yaml yml toml properties env"
LEAVES = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "pre", "td", "th", "dt", "dd", "figcaption", "caption", "div"}


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, content) of the files under a path."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")


def decoded(raw: bytes) -> tuple[str, str]:
    """A file's text, repaired, and the encoding that it was read by: what a mark or zero bytes tell, UTF-8, Windows-1252,
    Latin-1, in that order."""
    if not raw:
        return "", "empty"
    wide = len(raw) >= 4 and max(raw[:400][0::2].count(0), raw[:400][1::2].count(0)) > len(raw[:400]) * 0.2
    told = ["utf-16"] if raw[:2] in (b"\xff\xfe", b"\xfe\xff") else ["utf-8-sig"] if raw[:3] == b"\xef\xbb\xbf" else ["utf-16-le" if raw[1::2][:200].count(0) >= raw[0::2][:200].count(0) else "utf-16-be"] if wide else []
    for name in dict.fromkeys([*told, "utf-8", "cp1252", "latin-1"]):
        try:
            text = raw.decode(name)
        except UnicodeDecodeError:
            continue
        if "\0" in text and not name.startswith("utf-16"):
            continue
        return mended(text.replace("\0", "")), name
    return mended(raw.decode("utf-8", "replace").replace("\0", "")), "utf-8-replace"


def _rows(found: DataFrame, parse, fields: str) -> DataFrame:
    """(path, fields) of what parse gives for each file's bytes: a list of tuples."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(fields)
    kinds = to_arrow_schema(schema)

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for path, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                rows = parse(raw or b"")
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), *(pa.array([r[k] for r in rows], f.type) for k, f in enumerate(kinds))], names=["path", *kinds.names])

    return found.select("path", "content").mapInArrow(run, StructType.fromDDL(f"path string, {fields}"))


def texts(found: DataFrame) -> DataFrame:
    """(path, text, encoding) of text files."""
    return _rows(found, lambda raw: [decoded(raw)], "text string, encoding string")


def file_type(path: Column, content: Column) -> Column:
    """A file's type by its extension, or by its first bytes; null if neither tells."""
    extension = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    known = F.lit(None).cast("string")
    for name, kind in TYPES.items():
        known = F.when(extension == name, kind).otherwise(known)
    return F.coalesce(known, F.when(extension.isin(TEXT.split()), "txt"), binary_type(content), F.when((F.length(content) > 0) & ~F.contains(content, F.lit(b"\x00")), "txt"))


def binary_type(content: Column) -> Column:
    """pdf or zip by the first bytes of a file of four or more."""
    head = F.hex(F.substring(content, 1, 4))
    return F.when(F.length(content) >= 4, F.when(head == "25504446", "pdf").when(head.startswith("504B"), "zip"))


def _name(tag: str) -> str:
    return tag.rsplit("}", 1)[-1].lower() if isinstance(tag, str) else ""


def _archive(raw: bytes) -> zipfile.ZipFile | None:
    try:
        return zipfile.ZipFile(io.BytesIO(raw))
    except zipfile.BadZipFile:
        return None


def _xml(data: bytes) -> ET.Element | None:
    try:
        return ET.fromstring(data)
    except ET.ParseError:
        return None


def docx_blocks(raw: bytes) -> list[tuple[int, str, str]]:
    """(order, kind, text) of the paragraphs and table rows of a word file."""
    archive = _archive(raw)
    if archive is None or "word/document.xml" not in archive.namelist():
        return []
    root = _xml(archive.read("word/document.xml"))
    body = next((e for e in root.iter() if _name(e.tag) == "body"), None) if root is not None else None
    out: list[tuple[int, str, str]] = []
    said = lambda e: "".join(x.text or "" if _name(x.tag) == "t" else "\t" if _name(x.tag) == "tab" else "\n" if _name(x.tag) == "br" else "" for x in e.iter()).strip()
    for e in body if body is not None else ():
        if _name(e.tag) == "p" and said(e):
            style = next((v for x in e.iter() if _name(x.tag) == "pstyle" for k, v in x.attrib.items() if _name(k) == "val"), "")
            out.append((len(out), "heading" if style.lower().startswith(("heading", "title")) else "paragraph", said(e)))
        elif _name(e.tag) == "tbl":
            for row in (x for x in e.iter() if _name(x.tag) == "tr"):
                cells = [" ".join(said(c).split()) for c in row if _name(c.tag) == "tc"]
                if any(cells):
                    out.append((len(out), "table_row", " | ".join(cells)))
    return out


def spine(archive: zipfile.ZipFile) -> list[str]:
    """The pages of an e-book in reading order."""
    names = archive.namelist()
    container = _xml(archive.read("META-INF/container.xml")) if "META-INF/container.xml" in names else None
    opf = next((e.get("full-path") for e in container.iter() if _name(e.tag) == "rootfile"), None) if container is not None else None
    opf = opf or next((n for n in names if n.lower().endswith(".opf")), None)
    root = _xml(archive.read(opf)) if opf in names else None
    if root is None:
        return sorted(n for n in names if n.lower().endswith((".xhtml", ".html", ".htm")))
    base = posixpath.dirname(opf)
    hrefs = {e.get("id"): posixpath.normpath(posixpath.join(base, e.get("href", ""))) for e in root.iter() if _name(e.tag) == "item"}
    return [hrefs[e.get("idref")] for e in root.iter() if _name(e.tag) == "itemref" and hrefs.get(e.get("idref")) in names]


def epub_blocks(raw: bytes) -> list[tuple[int, str, str]]:
    """(order, path in the page, text) of the leaf blocks of an e-book, in reading order."""
    archive = _archive(raw)
    out: list[tuple[int, str, str]] = []
    for page in spine(archive) if archive is not None else ():
        root = _xml(re.sub(rb"&(?!amp;|lt;|gt;|quot;|apos;|#)[A-Za-z]+;", b" ", archive.read(page)))

        def walk(e: ET.Element, at: str, page=page) -> None:
            if _name(e.tag) in ("script", "style", "head", "svg"):
                return
            if _name(e.tag) in LEAVES and not any(_name(c.tag) in LEAVES for c in e.iter() if c is not e):
                text = " ".join("".join(e.itertext()).split())
                if text:
                    out.append((len(out), f"{page}#{at}", text))
                return
            for k, c in enumerate(e):
                walk(c, f"{at}/{_name(c.tag)}[{k}]")

        if root is not None:
            walk(root, "")
    return out


def subtitle_blocks(raw: bytes) -> list[tuple[int, str, str]]:
    """(order, times, text) of the cues of a subtitle file."""
    text = re.sub(r"\r\n?", "\n", decoded(raw)[0])
    out = []
    for block in text.split("\n\n"):
        m = re.match(r"(\d+)\n(\d\d:\d\d:\d\d,\d{3}\s*-->\s*\d\d:\d\d:\d\d,\d{3})[^\n]*\n(.*)", block.strip(), re.S)
        if m:
            out.append((len(out), m[2], m[3].strip()))
    return out


def text_blocks(raw: bytes) -> list[tuple[int, str, str]]:
    parts = [p.strip() for p in re.split(r"\n\s*\n", decoded(raw)[0]) if p.strip()]
    return [(k, "paragraph", p) for k, p in enumerate(parts)]


PARSERS = {"srt": subtitle_blocks, "docx": docx_blocks, "epub": epub_blocks, "txt": text_blocks}


def register(kind: str, parse) -> None:
    """A parser of one's own: bytes -> [(order, path, text)]."""
    PARSERS[kind] = parse


def blocks(found: DataFrame, kind: str) -> DataFrame:
    """(path, ord, place, text) of files of one type, by its parser."""
    return _rows(found, PARSERS[kind], "ord int, place string, text string")


def all_blocks(found: DataFrame) -> DataFrame:
    """(path, ord, place, text) of files of all types that there are parsers for, each by its own."""
    typed = found.withColumn("type", file_type(F.col("path"), F.col("content")))
    out = None
    for kind in PARSERS:
        part = blocks(typed.where(F.col("type") == kind), kind)
        out = part if out is None else out.unionByName(part)
    return out


def structure_counts(found: DataFrame) -> DataFrame:
    """(path, paragraphs, tables, images) of word files."""
    def count(raw: bytes):
        archive = _archive(raw)
        if archive is None or "word/document.xml" not in archive.namelist():
            return []
        root = _xml(archive.read("word/document.xml"))
        tags = [_name(e.tag) for e in root.iter()] if root is not None else []
        return [(tags.count("p"), tags.count("tbl"), sum(n.startswith("word/media/") and not n.endswith("/") for n in archive.namelist()))]

    return _rows(found, count, "paragraphs int, tables int, images int")


def exploded_json(spark: SparkSession, path: str, field: str, *keep: str) -> DataFrame:
    """The entries of an array field of JSON files, each with some fields of its file."""
    rows = spark.read.option("multiLine", "true").json(path)
    return rows.select(*keep, F.explode(field).alias("_e")).select(*[c.split(".")[-1] for c in keep], "_e.*")


def write_csv(results: DataFrame, path: str) -> None:
    """Results as CSV with a header; what is null is empty. Never over what is there."""
    results.write.mode("errorifexists").option("header", "true").option("emptyValue", "").option("nullValue", "").csv(path)


def publish(frame: DataFrame, path: str, tries: int = 100) -> str:
    """frame written as Parquet under a path that is not taken yet (path, `path (2)`, ...), by Spark's commit protocol:
    readers see a _SUCCESS file only after all of it. Returns the path."""
    spark = frame.sparkSession
    for k in range(1, tries + 1):
        to = path if k == 1 else f"{path} ({k})"
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(to)
        if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            frame.write.mode("errorifexists").parquet(to)
            return to
    raise FileExistsError(path)


def first_json(text: str) -> str | None:
    """The first object or array in a text whose brackets close in order, strings apart; None if they do not."""
    at = min((k for k in (text.find("{"), text.find("[")) if k >= 0), default=-1)
    if at < 0:
        return None
    open_: list[str] = []
    for m in re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\]]', re.S).finditer(text, at):
        mark = m[0]
        if mark in "{[":
            open_.append("}" if mark == "{" else "]")
        elif mark in "}]":
            if open_.pop() != mark:
                return None
            if not open_:
                return text[at : m.end()]
    return None
