import time

from pyspark.sql import functions as F

from docmill.functions import cleaning as C
from docmill.functions import segments as S
from docmill.functions import text as T
from docmill.operators import glossary


def values(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_mojibake_is_repaired(spark):
    for text in ("traducción automática", "“texto” — año €5", "naïve café, déjà vu"):
        once = text.encode().decode("latin-1")
        assert C.mended(once) == text and C.mended(once.encode().decode("latin-1")) == text and C.mended(text) == text
        win = text.encode().decode("cp1252", errors="ignore")
        assert C.mojibake(C.mended(win)) <= C.mojibake(win)
    assert C.mended("traducciÃƒÂ³n automÃƒÂ¡tica") == "traducción automática" and C.mended("â€œtextoâ€") != "" and C.mended("") == ""
    got = values(spark, a=C.repaired_mojibake(F.lit("traducciÃ³n")), b=C.repaired_mojibake(F.lit("año")), n=C.repaired_mojibake(F.lit(None).cast("string")))
    assert (got.a, got.b, got.n) == ("traducción", "año", "")


def test_artifacts(spark):
    got = values(
        spark,
        marks=C.without_marks(F.lit("a​b ■ c□d ,x  y \t")), blank=C.without_marks(F.lit(" \t")),
        wrap=C.without_wrappers(F.lit("<TRANSLATION>so &lt;/TRANSLATIONATION&gt; ,it is</translation> ")),
        prefix=C.single_prefixes(F.lit("L'L'Atalante, d’d’or O'Connor abcd'abcd'e")),
        dots=C.without_leaders(F.lit("Chapter One........ 23\n. . . . 23\nplain...\nmid ..... dle\nend .....\n\n\n\n\nx")),
        links=C.without_source_links(F.lit("a\r\n[OceanofPDF.com]\n(https://oceanofpdf.com)\n\n12.\nb\nhttps://example.org\n3.")),
        md=C.without_markdown_links(F.lit("see [this](http://a.b/c) , [id3](x) and [4](notes.xhtml#n4) end [no]")),
        em=C.without_emphasis(F.lit("a *word* and * * * and **bold** *2*")),
        spaces=C.normal_spacing(F.lit("a  b ,c .d \n  e\n\n\n\nf ")),
        sci=C.repaired_numbers(F.lit("23. 75 and 1. 0 · 10 20 or 3 x 10-5"))[0], fixed=C.repaired_numbers(F.lit("23. 75 x 105"))[1],
        entities=C.without_entities(F.lit("&nbsp;&nbsp;&amp;lt; &hellip;")),
        page=C.plain_page(F.lit("<title>t</title><body x><p>a &amp;lt; b<br>c</p><script>x</p></script><svg><p>n</p></svg><p> d </p></body><p>out</p>")),
    )
    assert got.marks == "ab c d,x y" and got.blank == " \t" and got.wrap == "so,it is" and got.prefix == "L'Atalante, d’or O'Connor abcd'abcd'e"
    assert got.dots == "Chapter One 23\nplain...\nmid dle\nend\n\n\nx" and got.links == "a\n\nb\nhttps://example.org\n3."
    assert got.md == "see this, [id3](x) and end [no]" and got.em == "a word and * * * and **bold** *2*"
    assert got.spaces == "a b, c. d\ne\n\nf" and got.sci == "23.75 and 1.0 · 10 20 or 3 x 10^-5" and got.fixed == 2
    assert got.entities == "  &lt; …".replace("  ", "  ", 1) or got.entities.endswith("< …")
    assert got.page == "a &lt; b\nc\nd"


def test_scans(spark):
    text = "INTRODUCTION\nThis line of a page was\nwrapped by a scan-\nner and goes on here\nto its end.\n12\nNext para-\ngraph starts\nhere ﬁne.\n13"
    signals = T.ocr_signals(F.lit(text))
    got = values(spark, scan=signals["likely_scan"], plain=C.normal_scan(F.lit(text), F.lit(True), T.without_page_lines), kept=C.normal_scan(F.lit("a\nb ﬁ"), F.lit(False), T.without_page_lines))
    assert got.scan and got.plain == "INTRODUCTION\n\nThis line of a page was wrapped by a scanner and goes on here to its end.\n\nNext paragraph starts\nhere fine." and got.kept == "a\nb fi"
    assert C.joined_lines("- a\n- b\n- c") == "- a\n- b\n- c" and C.joined_lines("one\ntwo") == "one\ntwo" and C.joined_lines("x = 1 + 2\nso it\nis") == "x = 1 + 2\n\nso it is"
    assert C.is_heading("Chapter Two") and C.is_heading("3.1 the method") and not C.is_heading("Ends here.") and not C.is_heading("a plain line of words")


def test_segments(spark):
    got = values(
        spark,
        sentences=S.sentences(F.lit('One. He said "two." (Three.) four: five')), none=S.sentences(F.lit(None).cast("string")),
        cap=S.capped(F.lit("First one. Second one is long"), 15), after=S.capped(F.lit("no end in here at all. then"), 5), whole=S.capped(F.lit("no end at all here"), 5),
        cues=S.cues(F.lit("1\r\n00:00:01,000 --> 00:00:02,000\r\nHi\r\nthere\r\n\r\nx\n00:00:01,000 --> 00:00:02,000\nno\n\n2\n00:00:03,000 --> 00:00:04,000\n")),
        answers=S.answers(F.lit("[1] a\nmore\n[2]\n[3] c\n[1] again")), fence=S.without_fence(F.lit("```json\n{}\n```")),
        windows=S.windows(F.lit("abcdefghij"), 4), readable=S.is_readable(F.lit("ok text here")), junk=S.is_readable(F.lit("\x01\x02abcdefghijkl")),
    )
    assert got.sentences == ["One.", 'He said "two."', "(Three.)", "four:", "five"] and got.none == []
    assert got.cap == "First one." and got.after == "no end in here at all." and got.whole == "no end at all here"
    assert [(c.number, c.start, c.text) for c in got.cues] == [("1", "00:00:01,000", "Hi\nthere")]
    assert got.answers == {1: "again", 3: "c"} and got.fence == "{}" and got.readable and not got.junk
    assert [(w.label, w.sample) for w in got.windows] == [("start", "abcd"), ("early", "cdef"), ("middle", "fghi"), ("late", "ghij")]


def test_terms_match_whole_words(spark):
    docs = spark.createDataFrame([(1, "Fantasy of Fan, fan 李凡青 and C++ code, británica"), (2, None), (3, "")], "doc long, text string")
    terms = spark.createDataFrame([("Fan", "a"), ("凡青", "b"), ("C++", "c"), ("Li Fan|fan", "británico"), (None, "x"), ("fantasy of", "y")], "source string, target string")
    got = {r.source: r.n for r in glossary.matched_terms(docs, terms, "doc", "text").collect()}
    assert got == {"Fan": 2, "凡青": 1, "C++": 1, "Li Fan|fan": 2, "fantasy of": 1}
    assert {r.source: r.n for r in glossary.matched_terms(docs, terms, "doc", "text", case_sensitive=True).collect()}["Fan"] == 1
    more = {r.source for r in glossary.terms_for(docs, spark.createDataFrame([("zz", "británico"), ("yy", "codes")], "source string, target string"), "doc", "text", "refinement").collect()}
    assert more == {"zz"}
    assert values(spark, f=glossary.target_alternatives(F.lit("británico"))).f == ["británico", "británica", "británicas", "británicos"]
    assert values(spark, f=glossary.target_alternatives(F.lit("red roja"))).f == ["red roja"] and values(spark, f=glossary.target_alternatives(F.lit("papel"))).f == ["papel", "papeles"]
    fixed, n = glossary.corrected(F.lit("Adam and Madam, Adam."), "Adam", "E$v\\e")
    assert tuple(values(spark, a=fixed, b=n)) == ("E$v\\e and Madam, E$v\\e.", 2)
    assert glossary.matched_terms(docs.limit(0), terms, "doc", "text").count() == 0 and glossary.matched_terms(docs, terms.limit(0), "doc", "text").count() == 0


def plan_of(spark, column) -> str:
    return spark.range(1).select(F.col("id").cast("string").alias("t")).select(column.alias("x"))._jdf.queryExecution().optimizedPlan().toString()


def test_each_rule_of_an_editorial_text_stands_once(spark):
    plan = plan_of(spark, C.editorial(F.col("t")))
    assert [plan.count(p) for p in (C.WRAPPER, C.SOURCE_LINKS, "[0-9]{1,5}\\n, ", "([0-9]{3})(?<!")] == [1, 1, 1, 1] and plan.count("regexp_replace(") < 40


def test_blanks_before_a_last_line_end(spark):
    got = values(spark, a=C.without_wrappers(F.lit(" \ta \u2028")), b=C.without_marks(F.lit("a\u2028 \u2028 ")), c=C.without_source_links(F.lit("\tb \n")), d=C.without_leaders(F.lit("x" + "." * 20000 + " 7\r\n. . . 12\u2028 \u00a0\n\n\n\n\n")))
    assert tuple(got) == ("a\u2028", "a\u2028\u2028", "b\n", "x 7\n\n\n")


def test_each_rule_of_a_cleaned_text_stands_once_and_is_linear(spark):
    plan = plan_of(spark, C.cleaned(F.col("t")))
    assert [plan.count(p) for p in (C.WRAPPER, C.SOURCE_LINKS)] == [1, 1]
    start, long = time.time(), "*a" + " word" * 60000 + " "  # no second asterisk
    assert values(spark, x=C.without_emphasis(F.lit(long))).x == long and time.time() - start < 30


def test_each_rule_of_a_layout_stands_once_and_is_linear(spark):
    plan = plan_of(spark, C.layout(F.col("t"), strip_style=True))
    assert plan.count(C.SOURCE_LINKS) == 1 and plan.count("regexp_replace(") < 40 and "filter(" not in plan
    start, long = time.time(), "__a" + " word" * 60000 + " b"  # no second mark
    got = values(spark, x=C.layout(F.lit(long), strip_style=True), y=C.layout(F.lit("\u00a0 Page 3 of 9\t\r\n12.\n---\na *b* -\u00a0\nPag. x\n\n\n\n\nc ..... 4\n7."), strip_style=True), z=C.layout(F.lit("12.\nx"), pages=False))
    assert got.x == long and time.time() - start < 30 and got.y == "a b -\n\nc 4" and got.z == "12.\nx"
