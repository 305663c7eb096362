from pyspark.sql import functions as F

from docmill.functions import entities as E
from docmill.functions import pairs as P
from docmill.functions import text as T
from docmill.operators import gates, jobs


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_entities(spark):
    found = lambda f, t: value(spark, f(F.lit(t)))
    assert found(E.digit_groups, "12 345 and 7, a1 or 2b, 12.5 kg and 3kg") == ["12345", "7", "12", "5", "12.5", "3"]
    assert found(E.dates, "on 2021-03-04 or 4.3.21, not 12021-03-04") == ["2021-03-04", "4.3.21"]
    assert found(E.percentages, "5 % or 7,5‰") == ["5%", "7,5‰"]
    assert found(E.currencies, "$5.50, 7 eur, £3. 1O s. 5USDx") == ["$5.50", "7EUR", "£3"]
    assert found(E.currencies, "£3. 1Os and £4") == ["GBP:3L:10S", "£4"]
    assert found(E.measurements, "2 metres, 5 A fuse, 2 A Civilizing, 3,5 KG, 4 v, in Bacon, 1597 L os estudios; 2000 L of it") == ["2M", "5A", "3.5KG", "2000L"]
    assert found(E.identifiers, "doi: 10.1234/ab.c, ORCID 0000-0001-2345-678X") == ["DOI:10.1234/AB.C", "ORCID0000-0001-2345-678X"]
    assert found(E.urls, "see https://a.b/c). and www.x.y, no") == ["https://a.b/c", "www.x.y"]
    assert found(E.isbns, "ISBN-13: 978-3-16-148410-0") == ["9783161484100"]
    assert found(E.scientific_names, "the species Panthera leo, described as Canis lupus. Sheila stood. genus The cat") == ["Panthera leo", "Canis lupus"]
    assert all(found(f, None) == [] or found(f, None) is None for f in E.KINDS.values())
    assert value(spark, E.digit_groups(F.lit(None).cast("string"))) == []


def test_entity_differences_count_repeated_values(spark):
    rows = spark.createDataFrame([(1, "3 3 4", "3 4 5"), (2, None, "7"), (3, "same 8", "same 8"), (4, None, None)], "k long, s string, t string")
    got = {(r.k, r.kind): (r.missing, r.added) for r in E.entity_differences(rows, ["k"], "s", "t").collect()}
    assert got == {(1, "number"): (1, 1), (2, "number"): (0, 1)}
    assert E.entity_differences(rows.limit(0), ["k"], "s", "t").count() == 0


def test_negations_and_concessions(spark):
    n = lambda t: value(spark, T.negations(F.lit(t)))
    assert n("though he never so much tried, he is not") == 1 and n("he never so much as tried") == 1
    assert n("Although never so much loved") == 0 and n("though he never so much as tried") == 1 and n(None) == 0


def test_coverage_and_spacing(spark):
    codes = lambda s, t: [i.code for i in value(spark, P.coverage_issues(F.lit(s), F.lit(t), F.lit(False)))]
    long = "this is a plain sentence that should be translated"
    assert codes(long, "This  is a plain sentence that should be translated ") == ["untranslated_source"]
    assert codes("", None) == ["missing_source_unit", "empty_translation"] and codes("Jean de la Tour", "Jean de la Tour") == []
    quote = '"' + long + '"'
    assert codes(quote, quote) == [] and codes(long, "otra cosa") == []
    counts = lambda t: spark.range(1).select(*[c.alias(k) for k, c in P.spacing_counts(F.lit(t)).items()]).first().asDict()
    assert counts("end.Next a,B c;D e:F camelCase mail x.Y@z.org www.A.B/c.D") == {"period_join": 1, "comma_join": 1, "semicolon_join": 1, "colon_join": 1, "word_join": 1}
    assert set(counts(None).values()) == {0}


def test_length_and_paragraph_issues(spark):
    said = lambda f, *x: (lambda r: r and (r.code, r.severity))(value(spark, f(*map(F.lit, x))))
    assert said(P.length_ratio_issue, 120, 30) == ("severe_length_drop", "reject") and said(P.length_ratio_issue, 120, 0) is None
    assert said(P.length_ratio_issue, 100, 50) == ("length_drop", "warning") and said(P.length_ratio_issue, 79, 1) is None and said(P.length_ratio_issue, 100, 230) == ("length_expansion", "warning")
    assert said(P.refined_length_issue, 500, 340) == ("length_regression", "reject") and said(P.refined_length_issue, 499, 340) is None
    assert said(P.refined_paragraph_issue, 3, 1) == ("paragraph_collapse", "reject") and said(P.refined_paragraph_issue, 6, 2) == ("paragraph_loss", "warning")
    assert said(P.placeholder_issue, "[id1] [ID2] [id1]", "[id1] [ID2]") == ("placeholder_mismatch", "reject") and said(P.placeholder_issue, "x", "[id1]") is None


def test_gates_of_documents(spark):
    units = spark.createDataFrame([("a", "a1", 0, "t", True, "passed", "passed"), ("b", "b1", 0, "", True, "failed", "failed")], "document string, unit string, ord int, target string, translatable boolean, translation string, approval string")
    found = spark.createDataFrame([("a", "a1", "spacing_word_join", "medium", None), ("a", "a1", "spacing_word_join", "medium", None), ("b", "b1", "source_language_unit", "critical", "nowhere")], "document string, unit string, code string, severity string, gate string")
    told = {(r.document, r.gate): (r.status, r.issues) for r in gates.gate_statuses(gates.manifest_counts(units), found).collect()}
    assert told["a", "typography"] == ("passed_with_warnings", 1) and told["b", "language"] == ("blocked", 1) and told["b", "translation"][0] == told["b", "final"][0] == "blocked" and told["a", "final"] == ("passed", 0)
    strict = gates.gate_statuses(gates.manifest_counts(units), found, warnings=False)
    assert {r.document: r.status for r in gates.final_status(strict).collect()} == {"a": "blocked", "b": "blocked"}
    assert [(r.unit, r.strategy) for r in gates.repair_units(units, found).collect()] == [("b1", "strict_target_language")]


def test_job_store(spark):
    names = spark.createDataFrame([(1, "g", None, "fr"), (2, "g (copy)", "en", "fr"), (3, "g (copy) 2", "en", "fr"), (4, "g (copy) x", "", "")], "id long, name string, source_language string, target_language string")
    terms = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "glossary long, source string")
    copy, mine = jobs.copied_glossary(names, terms, "g", 9)
    assert copy.first().asDict() == {"id": 9, "name": "g (copy) 3", "source_language": "", "target_language": "fr"} and sorted(r.source for r in mine.collect()) == ["a", "b"]
    copy, mine = jobs.copied_glossary(names, terms, "g (copy) x", 9)
    assert copy.first().name == "g (copy) x (copy)" and mine.count() == 0
    new = spark.createDataFrame([(1, " a ", "x", 1), (1, "z", "y", 2), (1, "z", "w", 3), (1, "  ", "v", 4), (1, None, "u", 5)], "glossary long, source string, translated string, ord int")
    added, counts = jobs.added_terms(terms, new, "ord")
    assert [(r.source, r.translated) for r in added.collect()] == [("z", "y")] and counts.first().asDict() == {"glossary": 1, "added": 1, "conflicts": 2, "skipped_empty": 2}
    scopes = spark.createDataFrame([("job", 10, 3), ("other", 5, 9)], "scope string, most long, max_calls int")
    asked = spark.createDataFrame([("job", 1, 4), ("job", 2, 7), ("job", 3, 6), ("job", 4, 0), ("job", 5, 0), ("other", 6, 6), ("none", 7, 1)], "scope string, request int, upper long").selectExpr("*", "request AS ord")
    told = {r.request: r.verdict for r in jobs.admitted(asked, scopes, "ord").collect()}
    assert told == {1: "admitted", 2: "insufficient_budget", 3: "admitted", 4: "admitted", 5: "call_budget_exhausted", 6: "insufficient_budget", 7: "budget_configuration"}
    assert jobs.admitted(asked.limit(0), scopes, "ord").count() == 0
    assert value(spark, jobs.nano(F.lit("0.0000000011").cast("decimal(18,10)"))) == 2 and value(spark, jobs.nano(F.lit("0.0000000011").cast("decimal(18,10)"), False)) == 1 and value(spark, jobs.nano(F.lit("-1").cast("decimal(18,10)"))) is None
    at = lambda t: spark.range(1).select(*[c.alias(k) for k, c in jobs.pricing_status(F.lit(t).cast("timestamp_ntz")).items()]).first()
    assert at("2026-09-11 03:59:59").tier == "peak" and at("2026-09-11 03:59:59").wait_seconds == 1 and at("2026-09-11 04:00:00").tier == "off_peak"
    assert str(at("2026-09-11 09:59:59").next_peak) == "2026-09-14 01:00:00" and at("2026-09-12 02:00:00").available
