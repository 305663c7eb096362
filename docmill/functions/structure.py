"""The structure of a text: blocks between blank lines, what each is and what is done with it.

A block is told by expressions over its lines (an array, trimmed, none blank) and its text. The order of the rules is
part of them: what is a note is no table. Defined cases: null text has no blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions.pairs import full, stripped

#: Patterns of lines and blocks.
URL_LINE = r"(?i)^\s*(?:https?://|www\.)\S+\s*$"
LINK_LINE = r"^\s*\[([^\]]+)\]\(([^)]+)\)\s*$"
JUNK = r"(?i)(?<![\p{L}\p{N}_])(?:oceanofpdf|z-?library|1lib\.sk|bookzz|pdfdrive|libgen|vk\.com|t\.me)(?![\p{L}\p{N}_])"
PAGE_MARK = r"(?i)^\s*(?:page|pagina|p[aá]gina|pag\.?|p\.)\s*(?:[0-9]{1,5}|[ivxlcdm]{1,10})(?:\s*(?:of|de|/)\s*(?:[0-9]{1,5}|[ivxlcdm]{1,10}))?\s*$"
PAGE_COUNT = r"(?i)^\s*(?:[-–—]\s*)?(?:[0-9]{1,5}|[ivxlcdm]{1,10})\s*(?:of|de|/)\s*(?:[0-9]{1,5}|[ivxlcdm]{1,10})(?:\s*[-–—])?\s*$"
TOC_TITLE = r"(?i)^\s*(?:contents|contenido|indice|índice|table of contents)\s*$"
TOC_ENTRY = r"(?i)^\s*(?:[0-9]+(?:\.[0-9]+){0,4}\s+)?[^\n]{2,120}?(?:\s*\.{3,}\s*|\s{2,})(?:[0-9]{1,5}|[ivxlcdm]{1,10})\s*$"
GLOSSARY_HEADING = r"(?i)^\s*(?:glossar(?:y|ies)|glosario|lexicon|l[eé]xico|pronunciation\s+key|clave\s+de\s+pronunciaci[oó]n)\s*$"
PRONUNCIATION = r"(?i)(?<![\p{L}\p{N}_])[a-zà-öø-ÿ]{1,8}(?:[´'’\-][a-zà-öø-ÿ]{1,12}){0,5}\s+(?:as\s+in|como\s+en)\s+[a-zà-öø-ÿ]{1,30}(?![\p{L}\p{N}_])"
PHONETIC = r"(?<![\p{L}\p{N}_])[A-ZÀ-ÖØ-Þ][A-Za-zÀ-ÖØ-öø-ÿ’'\-]{1,48}\s+[a-zà-öø-ÿ]{1,12}(?:[´'’\-]+[a-zà-öø-ÿ]{1,16}){1,8}\s*\)?\s*:"
LOCATOR = r"(?<![\p{L}\p{N}_])(?:[1-9]|1[0-9]|2[0-4])\.[0-9]{1,4}\."
NOTE = r"(?i)^\s*(?:\[[0-9]{1,4}\]|[0-9]{1,4}\.|nota\s+[0-9]{1,4}|note\s+[0-9]{1,4})\s+"
APPARATUS = r"(?i)(?<![\p{L}\p{N}_])(?:ibid\.|op\. cit\.|doi:|isbn|issn|bibliograf[ií]a|references|works cited|ed\.|vol\.|pp?\.\s*[0-9]|cf\.)(?![\p{L}\p{N}_])"
APPARATUS_HEADING = r"(?i)^\s*(?:notes|endnotes|footnotes|references|works cited|bibliograph(?:y|ies)|notas|notas finales|notas al pie|referencias|obras citadas|bibliograf[ií]a)(?![\p{L}\p{N}_])"
CITED_LINK = r"(?i)(?:https?://|www\.|doi(?:\.org|:))\S+|(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,24}(?:/[^\s<>\[\]]*)?"
MONTHS = "january|february|march|april|may|june|july|august|september|october|november|december|enero|febrero|marzo|abril|mayo|junio|julio|agosto|septiembre|octubre|noviembre|diciembre"
CITED_DATE = rf"(?i)\((?:(?:{MONTHS})\s+)?[0-9]{{4}}[a-z]?\)|(?<![\p{{L}}\p{{N}}_])(?:{MONTHS})\s+[0-9]{{1,2}},?\s+[0-9]{{4}}(?![\p{{L}}\p{{N}}_])"
BACKLINK = r"(?i)(?:go to note reference in text|return to note reference|volver a la referencia de la nota|ir a la referencia de la nota)"
PUBLISHER_YEAR = r"(?i):\s*[^.;\n]{2,100},\s*(?:1[5-9][0-9]{2}|20[0-9]{2})(?![\p{L}\p{N}_])"
TABLE_CAPTION = r"(?i)^\s*(?:table|tabla|cuadro)\s+([0-9]+[A-Za-z]?)\s*[:.\-–—]\s*(.*)$"
PIPE_ROW = r"^\s*\|.+\|\s*$"
CELL = r"(?i)O\([^()\n]*(?:\([^()\n]*\)[^()\n]*)*\)|(?:[0-9]+(?:\.[0-9]+)?\s*[·×x]\s*10(?:\^?[0-9]+|[⁰¹²³⁴⁵⁶⁷⁸⁹]+))|(?<![\[0-9A-Za-z])(?:[0-9]+(?:\.[0-9]+)?(?:K|M|B|%)?)(?![\]A-Za-z])"
FORMULA_ONLY = r"^\s*(?:[$]{1,2})?[\p{L}\p{N}_\s{}()\[\].,+\-*/^=<>≤≥∑∫√π·×%]+(?:[$]{1,2})?\s*$"
TITLE_WORD = "[A-Za-zÁÉÍÓÚÜÑáéíóúüñ]+"
TYPES = ("watermark", "junk_link", "header_footer", "note", "critical_apparatus", "glossary", "table", "formula", "toc", "title", "narrative")


def _count(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0))


def _some(lines: Column, pattern: str) -> Column:
    return F.size(F.filter(lines, lambda x: x.rlike(pattern)))


def is_junk(text: Column, lines: Column) -> Column:
    """Links alone, or a short mention of a known site."""
    shaped = F.forall(lines, lambda x: x.rlike(URL_LINE) | x.rlike(LINK_LINE) | x.rlike(JUNK))
    short = (F.size(lines) <= 2) & (_count(text, TITLE_WORD) <= 10) & ~text.rlike(r"[.!?]\s+[\p{L}\p{N}_]")
    return (text.rlike(JUNK) & (shaped | short)) | F.forall(lines, lambda x: x.rlike(URL_LINE))


def is_note(lines: Column) -> Column:
    first = F.element_at(lines, 1)
    return first.rlike(NOTE) | ((F.size(lines) <= 3) & first.rlike(r"^\s*[*†‡]\s+"))


def is_apparatus(text: Column, lines: Column) -> Column:
    """Citations, by what they hold together: headings, links, dates, marks that lead back, publishers and years."""
    heading, links, dates, back = text.rlike(APPARATUS_HEADING), _count(text, CITED_LINK), _count(text, CITED_DATE), _count(text, BACKLINK)
    titles, records = _count(text, r"[“\"]([^”\"]{8,220})[”\"]"), _count(text, PUBLISHER_YEAR)
    together = (heading & ((links >= 1) | (dates >= 2) | (back >= 1))) | ((back >= 1) & (links >= 1) & (dates >= 1)) | ((back >= 2) & ((links >= 1) | (dates >= 1))) | ((links >= 2) & (dates >= 2) & (titles >= 1))
    return text.rlike(APPARATUS) | together | (records >= 2) | ((_count(text, r"\[[^\]]{1,40}\]|\([0-9]{4}[a-z]?\)") >= 3) & (F.size(lines) <= 8))


def is_glossary(text: Column, lines: Column) -> Column:
    """A heading, a key of sounds, records with sounds and places, or mostly lines of `term: definition`."""
    head = lambda x: F.substring_index(x, ":", 1)
    lexical = F.size(F.filter(lines, lambda x: x.contains(":") & (stripped(F.substr(x, F.length(head(x)) + 2)) != "") & _count(head(x), TITLE_WORD).between(1, 5) & (F.length(head(x)) <= 60) & ~head(x).rlike("[,.!?;]")))
    return (_some(F.slice(lines, F.lit(1), F.lit(2)), GLOSSARY_HEADING) > 0) | (_count(text, PRONUNCIATION) >= 3) | ((_count(text, PHONETIC) >= 3) & (_count(text, LOCATOR) >= 2)) | ((lexical >= 3) & (lexical / F.size(lines) >= 0.55))


def is_table(lines: Column) -> Column:
    numeric = F.size(F.filter(lines, lambda x: _count(x, CELL) >= 2))
    return (_some(lines, TABLE_CAPTION) > 0) | (_some(lines, PIPE_ROW) >= 2) | ((F.size(lines) >= 3) & (numeric >= 2))


def is_formula(text: Column, lines: Column) -> Column:
    signs = (_count(text, r"[=<>+\-*/^_{}≤≥∑∫√π]") >= 2) & (_count(text, TITLE_WORD) <= 8) & text.rlike(FORMULA_ONLY)
    return (F.size(lines) <= 4) & (text.contains("$$") | text.rlike(r"\\(?:frac|sum|int|sqrt|begin|end)(?![\p{L}\p{N}_])") | signs)


def is_toc(lines: Column) -> Column:
    entries = _some(lines, TOC_ENTRY)
    return ((F.size(lines) == 1) & F.element_at(lines, 1).rlike(TOC_TITLE)) | ((entries >= 2) & (entries / F.size(lines) >= 0.5))


def is_title(lines: Column) -> Column:
    """One short line, mostly of capitals or of capitalised words."""
    line = F.element_at(lines, 1)
    words, letters = _count(line, TITLE_WORD), F.length(F.regexp_replace(line, r"[^\p{L}]", ""))
    capital = F.length(F.regexp_replace(line, r"[^\p{Lu}]", "")) / letters
    titled = F.size(F.filter(F.regexp_extract_all(line, F.lit(TITLE_WORD), F.lit(0)), lambda w: w.rlike(r"^\p{Lu}")))
    return (F.size(lines) == 1) & (F.length(line) <= 120) & words.between(1, 14) & ~line.rlike(TOC_ENTRY) & ~line.rlike(NOTE) & (letters > 0) & ((capital >= 0.55) | (titled >= F.greatest(F.lit(1), words - 1)))


def block_kind(text: Column, lines: Column) -> Column:
    """(type, policy) of a block."""
    kind = lambda t, p: F.struct(F.lit(t).alias("type"), F.lit(p).alias("policy"))
    junk = is_junk(text, lines)
    first = F.element_at(lines, 1)
    return (
        F.when(junk & text.rlike(JUNK), kind("watermark", "exclude"))
        .when(junk, kind("junk_link", "exclude"))
        .when(F.forall(lines, lambda x: x.rlike(LINK_LINE)), kind("junk_link", "clean"))
        .when((F.size(lines) == 1) & (first.rlike(PAGE_MARK) | first.rlike(PAGE_COUNT)), kind("header_footer", "exclude"))
        .when(is_note(lines), kind("note", "translate"))
        .when(is_apparatus(text, lines), kind("critical_apparatus", "preserve"))
        .when(is_glossary(text, lines), kind("glossary", "translate"))
        .when(is_table(lines), kind("table", "reconstruct"))
        .when(is_formula(text, lines), kind("formula", "preserve"))
        .when(is_toc(lines), kind("toc", "reconstruct"))
        .when(is_title(lines), kind("title", "translate"))
        .otherwise(kind("narrative", "translate"))
    )


def line_blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, block, lines, text): runs of lines that are not blank, in order; text is the trimmed lines."""
    plain = F.regexp_replace(full(F.col(text_col)), r"\r\n?", "\n")
    parts = docs.select(id_col, F.posexplode(F.split(plain, r"\n(?:[\s\x{00A0}]*\n)+")).alias("block", "_part"))
    lines = F.filter(F.split("_part", "\n"), lambda x: stripped(x) != "")
    rows = parts.select(id_col, "block", lines.alias("lines")).where(F.size("lines") > 0)
    return rows.select(id_col, "block", "lines", F.array_join(F.transform("lines", stripped), "\n").alias("text"))


def classified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """line_blocks with the type and policy of each."""
    blocks = line_blocks(docs, id_col, text_col).withColumn("_lines", F.split("text", "\n"))
    return blocks.withColumn("_kind", block_kind(F.col("text"), F.col("_lines"))).select(id_col, "block", "lines", "text", "_kind.type", "_kind.policy")


def block_counts(blocks: DataFrame, id_col: str) -> DataFrame:
    """How many blocks a document has of each type and policy."""
    return blocks.groupBy(id_col, "type", "policy").agg(F.count("*").alias("blocks"))


def with_policies(blocks: DataFrame, id_col: str) -> DataFrame:
    """(id, text, blocks): documents without what their policies exclude, links as their labels, all else as it is."""
    lines = F.when(F.col("policy") == "clean", F.transform("lines", lambda x: F.regexp_replace(x, LINK_LINE, "$1"))).otherwise(F.col("lines"))
    rows = blocks.where("policy <> 'exclude'").select(id_col, F.struct("block", F.array_join(lines, "\n").alias("t")).alias("b"))
    told = rows.groupBy(id_col).agg(F.array_sort(F.collect_list("b")).alias("bs"))  # a document's own blocks
    return told.select(id_col, F.array_join(F.transform("bs", lambda b: b["t"]), "\n\n").alias("text"), F.size("bs").alias("blocks"))
