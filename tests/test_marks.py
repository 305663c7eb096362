"""Small marks in texts against plain Python."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docmill.functions import marks as M


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first()


def test_sentence_beginnings(spark):
    text = 'One. Two "Three. "Four" five\nsix (seven) eight.) Nine'
    starts = [text.index(w) for w in ("One", "Two", "Three", "Four", "five", "six", "seven", "eight", "Nine")]
    got = list(one(spark, *[M.begins_sentence(F.lit(text), F.lit(k)) for k in starts]))
    assert got == [True, True, False, True, False, True, False, False, True]
    assert one(spark, M.begins_sentence(F.lit(None).cast("string"), F.lit(3)), M.begins_sentence(F.lit('"x'), F.lit(1)))[:] == (True, True)


def test_formulas_and_halves(spark):
    given = ["V_{cm}", "5", "10.50", "price", "x^2 + y^2", "10.505", "", "a b"]
    assert list(one(spark, *[M.is_formula(F.lit(g)) for g in given])) == [True, False, False, False, True, True, True, True]
    long = "ab " * 50
    assert one(spark, *M.halves(F.lit("abcde")), *M.halves(F.lit(long), 0.3), *M.halves(F.lit(None).cast("string")))[:] == ("ab", "cde", long[:45].strip(), long[45:].strip(), "", "")


def test_tags(spark):
    tags = F.create_map(*[F.lit(x) for x in ("[id0]", "<p>", "[id1]", "<b>", "[id10]", "[id0]")])
    text = F.lit("[id0]a[id1]b[id10][id7]")
    got = one(spark, M.restored_tags(text, tags), M.signature(text, F.array(F.lit("[id10]"), F.lit("[id0]"))), M.restored_tags(F.lit(None).cast("string"), tags))
    assert (got.c0, got.c1, got.c2) == ("<p>a<b>b<p>[id7]", ["[id0]", "[id10]"], "")


def test_phases(spark):
    prompts = {"": "llm_call", "Translate it": "translation", "translate; REPAIR THE PLACEHOLDER": "format_repair", '"suggestions"': "llm_call", 'glosario "suggestions"': "glossary_discovery", "x" * 12_000 + "translate": "llm_call"}
    assert dict(zip(prompts, one(spark, *[M.phase(F.lit(p)) for p in prompts]), strict=True)) == prompts
    assert one(spark, M.phase(F.lit("Corrige estilo"), F.lit("You translate")))[0] == "editorial_refinement"


NAME = re.compile(r"(?<!\w)[A-ZÁÉÍÓÚÜÑ][A-Za-zÁÉÍÓÚÜÑáéíóúüñ]{1,24}(?:[*\\][A-ZÁÉÍÓÚÜÑ][A-Za-zÁÉÍÓÚÜÑáéíóúüñ]{1,24})+(?!\w)")


def lost(source, candidate):
    """One occurrence after the other, each paired with the same name or else with a spare one that reads alike."""
    have, out = Counter(NAME.findall(candidate)), Counter()
    alike = lambda n: re.sub(r"I(?=$|[*\\])", "l", n).lower()
    want = Counter(NAME.findall(source))
    spare = Counter()
    for n, k in (have - want).items():
        spare[alike(n)] += k
    for n in (want - have).elements():
        if spare[alike(n)]:
            spare[alike(n)] -= 1
        else:
            out[n] += 1
    return out


def test_symbol_names(spark):
    pairs = [
        (1, r"Ro*Land, Ro*Land and Al\Ban; Val*VaI", r"Ro*Land al ban Val*Val, Val*Val"),
        (2, r"Ann*Lee Ann*LeE Bo*By ViI*Ox Vil*Ox", "Ann Lee annlee BOBY Vil*Ox Vil*Ox"),
        (3, None, "Ro*Land"),
        (4, "Ro*Land", None),
        (5, "xRo*Land a*b Ro*l", "ro land"),
    ]
    given = spark.createDataFrame(pairs, "u int, s string, c string")
    got = {(r.u, r.name): r.missing for r in M.missing_symbol_names(given, "u", "s", "c").collect()}
    assert got == {(u, n): k for u, s, c in pairs for n, k in lost(s or "", c or "").items()}
    put = {r.u: r.r for r in given.select("u", M.restored_symbol_names(F.col("s"), F.col("c")).alias("r")).collect()}
    assert put == {1: r"Ro*Land Al\Ban Val*Val, Val*Val", 2: "Ann Lee annlee Bo*By Vil*Ox Vil*Ox", 3: "Ro*Land", 4: "", 5: "ro land"}


def aloud(text):
    """Note calls, then links one by one, then addresses."""
    notes, links = 0, 0
    for call in (r"\s*\[\[\d{1,4}\]\]\([^)]+\)", r"\s*\[\[\d{1,4}\]\]", r"(?<!\w)\s*\[\d{1,4}\](?!\w)"):
        text, n = re.subn(call, "", text)
        notes += n
    junk = re.compile(r"\b(?:oceanofpdf|z-?library|1lib\.sk|bookzz|pdfdrive|libgen|vk\.com|t\.me)\b", re.I)

    def label(m):
        told, to = m[1].strip(), m[2].strip()
        if junk.search(told) or junk.search(to):
            return ""
        return "" if re.search(r"\b(?:notas?|notes?|footnotes?|endnotes?)\b|#nt\d+", to, re.I) and re.fullmatch(r"\[?\d{1,4}\]?", told) else told

    text, links = re.subn(r"\[([^\]]+)\]\(([^)]+)\)", label, text)
    text, n = re.subn(r"(?i)\b(?:https?://|www\.)\S+", "", text)
    for pattern, to in ((r"[ \t]{2,}", " "), (r"\s+([,.;:!?])", r"\1"), (r"\(\s*\)", ""), (r"\n{3,}", "\n\n")):
        text = re.sub(pattern, to, text)
    return text.strip(), links + n, notes


def test_spoken_text(spark):
    texts = [
        "See [the label ](https://a.b/c) and[[12]](#n) x[3] y [4], [5](notes.html) [z-library](u) [a](vk.com/x)\n\n\n\n(www.a.org/x) [about](#nt3) end",
        "[12] [x[7](footnote.html) [ [8](#nt1)[[9]] ( ) . HTTPS://q.r/s [ ](u) [](v) [Libgen [a](b) [see http://t.me/x](y) t.meal",
        "",
    ]
    for text in texts:
        assert tuple(one(spark, *M.spoken(F.lit(text)))) == aloud(text)
    assert tuple(one(spark, *M.spoken(F.lit(None).cast("string")))) == ("", 0, 0)


def test_emptied_blocks_and_tiers(spark):
    rows = [(1, 0, "first", "x"), (1, 1, "gone\n one", " "), (1, 2, "z" * 600, "z"), (2, 0, "* *", ""), (2, 1, None, ""), (3, 0, "only", None)]
    got = M.emptied_blocks(spark.createDataFrame(rows, "d int, o int, s string, t string"), "d", "o", "s", "t").collect()
    assert sorted(tuple(r) for r in got) == [(1, 1, "gone one", "first", "z" * 500), (3, 0, "only", "", "")]
    assert [M.pair_tier(spark, t).count() for t in ("quick", "STANDARD ", "full")] == [8, 16, 28]
    with pytest.raises(KeyError):
        M.pair_tier(spark, "other")
