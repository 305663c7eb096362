"""Pieces of texts as expressions: sentences, capped and sampled texts, subtitles, answers with marks.

Defined cases: null text is empty and has no pieces.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docmill.functions.pairs import BLANK, full, stripped

#: Fixed value: what ends a sentence, the longer marks first.
END = r"(?:\.\)|[.!?][\"']|[.!?:])"
#: Characters a token by language; context sizes keep a tenth in reserve.
RATIOS = {"english": 4.0, "french": 3.5, "spanish": 3.5, "german": 3.8, "italian": 3.6, "portuguese": 3.5, "russian": 3.2, "chinese": 1.5, "japanese": 2.0, "korean": 2.5, "arabic": 3.0}
TIME = r"([0-9]{2}:[0-9]{2}:[0-9]{2},[0-9]{3})\s*-->\s*([0-9]{2}:[0-9]{2}:[0-9]{2},[0-9]{3})"
LOOSE_TIME = r"[0-9]{1,2}:[0-9]{2}:[0-9]{2}[,.][0-9]{3}\s*-->\s*[0-9]{1,2}:[0-9]{2}:[0-9]{2}[,.][0-9]{3}"


def paragraphs(text: Column) -> Column:
    """What empty lines part, but for blank pieces."""
    return F.filter(F.split(full(text), r"\n\s*\n"), lambda p: stripped(p) != "")


def sentences(text: Column) -> Column:
    """Pieces up to and with their end, and what is left, trimmed."""
    found = F.regexp_extract_all(full(text), F.lit(rf"(?s)[^.!?:]*{END}|[^.!?:]+"), F.lit(0))
    return F.filter(F.transform(found, stripped), lambda s: s != "")


def capped(text: Column, most: int) -> Column:
    """A text of about `most` characters: up to its last sentence end within them, or else its next one, or whole."""
    value = full(text)
    inside = F.regexp_extract(F.substring(value, 1, most), rf"(?s)^(.*{END})", 1)
    beyond = F.regexp_extract(F.substr(value, F.lit(most + 1)), r"(?s)^(.*?[.!?:])", 1)
    cut = F.when(inside != "", inside).when(beyond != "", F.concat(F.substring(value, 1, most), beyond))
    return F.when(F.length(value) <= most, value).otherwise(F.coalesce(F.regexp_replace(cut, rf"{BLANK}$", ""), value))


def windows(text: Column, size: int, most: int = 5) -> Column:
    """(label, sample) of windows of a text from its start to its end; a short text is one, `whole`."""
    value = stripped(text)
    n = F.length(value)
    last = F.greatest(F.lit(0), n - size)
    if most <= 3:
        anchors = [("start", F.lit(0)), ("middle", F.floor(last / 2)), ("end", last)][:most]
    else:
        anchors = [("start", F.lit(0)), ("early", F.floor(n / 4)), ("middle", F.floor(n / 2)), ("late", F.floor(n * 3 / 4)), ("end", last)][:most]
    places = F.array(*[F.struct(F.lit(k).alias("label"), F.least(a.cast("int"), last).alias("at")) for k, a in anchors])
    ats = F.transform(places, lambda p: p["at"])
    firsts = F.filter(places, lambda p, i: F.array_position(ats, p["at"]) == i + 1)
    cut = F.transform(firsts, lambda p: F.struct(p["label"].alias("label"), F.substr(value, p["at"] + 1, F.lit(size)).alias("sample")))
    whole = F.array(F.struct(F.lit("whole").alias("label"), value.alias("sample")))
    return F.when(n == 0, F.slice(whole, F.lit(1), F.lit(0))).when(n <= size, whole).otherwise(cut)


def compact(text: Column) -> Column:
    """A text with single blanks."""
    return stripped(F.regexp_replace(full(text), BLANK, " "))


def spread_chunks(value: Column, size: int, most: int) -> Column:
    """At most `most` chunks of about `size` characters spread evenly over a compact text (a column already made, as each
    chunk looks at it again), from blank to blank."""
    n = F.length(value)
    count = F.least(F.lit(most), F.greatest(F.lit(1), F.floor(n / size).cast("int")))
    stride = F.when(count > 1, (n - size) / (count - 1)).otherwise(F.lit(0.0))

    def chunk(k: Column) -> Column:
        at = F.bround(k * stride).cast("int")
        behind = F.substr(value, F.greatest(F.lit(0), at - 100) + 1, at + 1 - F.greatest(F.lit(0), at - 100))
        start = F.when((at > 0) & behind.contains(" "), at + 1 - F.length(F.substring_index(behind, " ", -1))).otherwise(at)
        end = F.least(n, at + size)
        ahead = F.substr(value, end + 1, F.lit(100))
        stop = F.when((end < n) & ahead.contains(" "), end + F.length(F.substring_index(ahead, " ", 1))).otherwise(end)
        return F.trim(F.substr(value, start + 1, F.greatest(F.lit(0), stop - start)))

    cut = F.filter(F.transform(F.sequence(F.lit(0), count - 1), chunk), lambda c: c != "")
    return F.when(n == 0, F.array().cast("array<string>")).when(n <= size, F.array(value)).when(count == 1, F.array(F.substring(value, 1, size))).otherwise(cut)


def token_guess(text: Column, language: Column, margin: bool = True) -> Column:
    """Tokens by characters and language, with a tenth in reserve."""
    ratio = F.lit(4.0)
    for name, r in RATIOS.items():
        ratio = F.when(F.lower(language) == name, r).otherwise(ratio)
    base = F.length(full(text)) / ratio
    return F.floor(base * 1.1 if margin else base)


# Subtitles --------------------------------------------------------------------------------------------------------------


def cues(content: Column) -> Column:
    """(number, start, stop, text) of the cues of a subtitle file: blocks of three lines or more with a number and a time."""
    plain = F.regexp_replace(full(content), r"\r\n?", "\n")
    blocks = F.transform(F.split(plain, "\n\n"), stripped)
    good = F.filter(blocks, lambda b: b.rlike(rf"^[0-9]+\n{TIME}[^\n]*\n"))
    return F.transform(good, lambda b: F.struct(F.regexp_extract(b, r"^([0-9]+)\n", 1).alias("number"), F.regexp_extract(b, rf"^[0-9]+\n{TIME}", 1).alias("start"), F.regexp_extract(b, rf"^[0-9]+\n{TIME}", 2).alias("stop"), F.regexp_extract(b, r"(?s)^[^\n]*\n[^\n]*\n(.*)$", 1).alias("text")))


def is_subtitles(content: Column) -> Column:
    """Two times and two numbers on lines of their own, at least."""
    count = lambda p: F.coalesce(F.regexp_count(content, F.lit(p)), F.lit(0))
    return (count(LOOSE_TIME) >= 2) & (count(r"(?m)^[0-9]+[ \t]*$") >= 2)


def subtitle_text(content: Column) -> Column:
    """The spoken lines of a subtitle file, in one."""
    lines = F.transform(F.split(full(content), "\n"), stripped)
    return F.array_join(F.filter(lines, lambda x: (x != "") & ~x.rlike(r"^[0-9]+$") & ~x.contains("-->")), " ")


def is_readable(content: Column) -> Column:
    """Ten characters or more, of which more than 95 % can be printed and less than 1 % are controls."""
    count = lambda p: F.coalesce(F.regexp_count(content, F.lit(p)), F.lit(0))
    n = F.length(content)
    odd, control = count(r"[\p{C}\p{Z}&&[^\n\r\t ]]"), count(r"[\x00-\x08\x0B\x0C\x0E-\x1F]")
    return F.coalesce((n >= 10) & ((n - odd) / n > 0.95) & (control / n < 0.01), F.lit(False))


def detection_text(text: Column) -> Column:
    """A text without markup, addresses and mails, for telling its language."""
    out = full(text)
    for pattern, to in ((BLANK, " "), (r"<[^>]+>", ""), (r"https?://[^\s\x{00A0}]+", ""), (r"[^\s\x{00A0}]+@[^\s\x{00A0}]+", "")):
        out = F.regexp_replace(out, pattern, to)
    return stripped(out)


def without_fence(text: Column) -> Column:
    """What stands in a single fence of backticks, if that is of JSON or of nothing named."""
    value = stripped(text)
    inner = F.regexp_extract(value, r"(?s)^```([^\n]*)\n(.*)```", 2)
    label = F.lower(stripped(F.regexp_extract(value, r"(?s)^```([^\n]*)\n(.*)```", 1)))
    return F.when(value.rlike(r"(?s)^```[^\n]*\n.*```") & label.isin("", "json"), stripped(inner)).otherwise(value)


def answers(text: Column) -> Column:
    """The text of each mark [N] that begins a line, by its number; of several, the last."""
    found = F.regexp_extract_all(F.concat(F.lit("\n"), stripped(text)), F.lit(r"(?s)\n\[([0-9]+)\](.*?)(?=\n\[[0-9]+\]|\z)"), F.lit(1))
    said = F.regexp_extract_all(F.concat(F.lit("\n"), stripped(text)), F.lit(r"(?s)\n\[([0-9]+)\](.*?)(?=\n\[[0-9]+\]|\z)"), F.lit(2))
    pairs = F.filter(F.zip_with(found, said, lambda n, t: F.struct(n.cast("int").alias("n"), stripped(t).alias("t"))), lambda p: p["t"] != "")
    numbers = F.array_distinct(F.transform(pairs, lambda p: p["n"]))
    return F.map_from_arrays(numbers, F.transform(numbers, lambda n: F.element_at(F.filter(pairs, lambda p: p["n"] == n), -1)["t"]))


# Reports ----------------------------------------------------------------------------------------------------------------

ARTIFACT = r"(?i)oceanofpdf\.com|z-library\.sk|1lib\.sk|z-lib\.sk|\[\s*[0-9]{1,5}\s*\]\s*\((?:\.\./|[^)]*(?:notes?|notas?|footnotes?|endnotes?)[^)]*)\)"


def page_markers(text: Column) -> Column:
    """Lines of nothing but a number up to 5,000 that is no year."""
    numbers = F.regexp_extract_all(full(text), F.lit(r"(?m)^\s*([0-9]{1,5})\.?\s*$"), F.lit(1))
    value = lambda x: x.cast("int")
    return F.size(F.filter(numbers, lambda x: value(x).between(1, 5000) & ~((F.length(x) == 4) & value(x).between(1000, 2100)))).cast("long")


def source_artifacts(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(ARTIFACT)), F.lit(0)).cast("long")


def repeats_paragraphs(text: Column) -> Column:
    """Whether of four paragraphs or more three begin alike (240 characters, in any case)."""
    parts = F.transform(F.filter(F.split(full(text), r"\n\s*\n+"), lambda p: stripped(p) != ""), lambda p: F.lower(F.substring(stripped(F.regexp_replace(p, BLANK, " ")), 1, 240)))
    ordered = F.array_sort(parts)
    thrice = F.exists(F.zip_with(F.slice(ordered, F.lit(1), F.greatest(F.lit(0), F.size(ordered) - 2)), F.slice(ordered, F.lit(3), F.greatest(F.lit(0), F.size(ordered) - 2)), lambda a, b: a == b), lambda x: x)
    return (F.size(parts) >= 4) & thrice
