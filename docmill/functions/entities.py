"""What a translation must keep: values of nine kinds, found by expressions, and how pairs of texts differ in them.

Defined cases: null text has no values; a value that occurs twice counts twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word character, and that none stands before or after.
WORD = r"[\p{L}\p{N}_]"
BEFORE, AFTER = rf"(?<!{WORD})", rf"(?!{WORD})"
#: Blanks inside numbers, currency marks, long units and what they stand for, short units, cues of
#: scientific names, words and endings that are in none.
GROUPED = r"[ \x{00A0}\x{202F}]"
CURRENCY = r"(?:[$€£¥₹₽₩₺₴]|USD|EUR|GBP|JPY|CNY|RMB|MXN|CAD|AUD|CHF|BRL|INR|RUB)"
LONG_UNITS = "meters?|metres?|metros?|metern?|meter|metre|metro|km|cm|mm|kg|mg|lb|oz|°C|°F|kHz|MHz|GHz|kW|mL|Hz|Pa|bar|mol"
METRES = "meter meters metre metres metro metros metern"
SHORT_UNITS = "mgLKWVA"
CUES = r"species|genus|binomial|taxon|scientific[ \t]{1,4}name|described|identified[ \t]{1,4}as|classified[ \t]{1,4}as|especie|g[eé]nero|tax[oó]n|nombre[ \t]{1,4}cient[ií]fico|describi[oó]|identificad[oa][ \t]{1,4}como|clasificad[oa][ \t]{1,4}como|esp[eè]ce|genre|nom[ \t]{1,4}scientifique|Gattung|Spezies|wissenschaftlicher[ \t]{1,4}Name"
NO_GENUS = "After Before First Second That The These This Those When Where While Der Die Das Ein Eine El La Los Las Un Una En Al Del Le Les Une Son Soy Somos Eres Es Fue Fueron"
NO_SPECIES = "a an the un una uno el la los las une des der die das ein eine son es"
NO_ENDING = r"(?i)(?:ando|iendo|yendo|aba|aban|aron|ing|ed)$"

DIGITS = rf"{BEFORE}(?:[0-9]{{1,3}}(?:{GROUPED}[0-9]{{3}})+|[0-9]+){AFTER}"
DATE = rf"{BEFORE}(?:[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}|[0-9]{{1,2}}[./-][0-9]{{1,2}}[./-][0-9]{{2,4}}){AFTER}"
PERCENT = rf"{BEFORE}[0-9]+(?:[.,][0-9]+)?\s*[%‰]"
AMOUNT = rf"(?i){BEFORE}{CURRENCY}\s*[0-9]+(?:[.,][0-9]+)*{AFTER}|{BEFORE}[0-9]+(?:[.,][0-9]+)*\s*{CURRENCY}{AFTER}"
SHILLINGS = rf"£\s*([0-9]+)\.\s*([0-9Oo](?:[ \x{{00A0}}]*[0-9Oo])?)s{AFTER}"
#: A publication year before a stray capital is no measurement, nor is a number before an article.
YEAR = rf"(?!(?<=,\s{{0,9}})(?:1[0-9]{{3}}|2[01][0-9]{{2}})\s+[{SHORT_UNITS}]\s+[a-zß-ɏ'’-]{{2,}})"
MEASURE = rf"{BEFORE}{YEAR}([0-9]+(?:[.,][0-9]+)?)(?:\s*((?i:{LONG_UNITS}))|\s+([mgLKWV]|A(?!\s+[A-Z][a-zÀ-ɏ'’-]+))){AFTER}"
IDENTIFIER = rf"(?i){BEFORE}(?:doi\s*:\s*10\.[0-9]{{4,9}}/[-._;()/:A-Z0-9]*[A-Z0-9_]|ORCID\s*:?\s*[0-9]{{4}}-[0-9]{{4}}-[0-9]{{4}}-[0-9]{{3}}[0-9X]){AFTER}"
URL = rf"(?i){BEFORE}(?:https?://|www\.)[^\s<>()]+"
ISBN = rf"(?i){BEFORE}ISBN(?:-1[03])?\s*:?[\s-]*([0-9X][0-9X\s-]{{8,20}})"
BINOMIAL = rf"(?<=(?<!{WORD})(?i:{CUES})[ \t]{{1,4}}(?:(?i:as|como)[ \t]{{1,4}})?)([A-Z][a-z]{{2,}})\s+([a-z][a-z-]{{2,}}){AFTER}"


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.array().cast("array<string>"))


def _solid(values: Column) -> Column:
    """Values without blanks, in capitals."""
    return F.transform(values, lambda v: F.upper(F.regexp_replace(v, r"[\s\x{00A0}]+", "")))


def _number(value: Column) -> Column:
    return F.regexp_replace(value, GROUPED, "")


def measurements(text: Column) -> Column:
    """Number and unit of each measurement, metres by one name."""
    found = F.arrays_zip(_all(text, MEASURE, 1).alias("n"), _all(text, MEASURE, 2).alias("long"), _all(text, MEASURE, 3).alias("short"))
    name = lambda m: F.when(F.lower(m["long"]).isin(METRES.split()), "M").otherwise(F.upper(F.concat(m["long"], m["short"])))
    return F.transform(found, lambda m: F.concat(F.replace(_number(m["n"]), F.lit(","), F.lit(".")), name(m)))


def digit_groups(text: Column) -> Column:
    """Whole numbers, thousands joined, and the numbers of measurements that are not such."""
    groups = F.transform(_all(text, DIGITS), _number)
    more = F.filter(F.arrays_zip(_all(text, MEASURE, 0).alias("m"), _all(text, MEASURE, 1).alias("n")), lambda m: m["n"].rlike("[.,]") | m["m"].rlike(r"^[0-9]+[^\s0-9]"))
    return F.concat(groups, F.transform(more, lambda m: _number(m["n"])))


def dates(text: Column) -> Column:
    return _solid(_all(text, DATE))


def percentages(text: Column) -> Column:
    return _solid(_all(text, PERCENT))


def currencies(text: Column) -> Column:
    """Amounts with their mark; pounds and shillings as one amount."""
    pairs = F.arrays_zip(_all(text, SHILLINGS, 1).alias("l"), F.transform(_all(text, SHILLINGS, 2), lambda s: F.translate(F.regexp_replace(s, r"[\s\x{00A0}]", ""), "Oo", "00").cast("int")).alias("s"))
    old = F.filter(pairs, lambda p: p["s"] < 20)
    rest = F.regexp_replace(text, rf"£\s*[0-9]+\.\s*(?:[01Oo][ \x{{00A0}}]*[0-9Oo]|[0-9Oo])s{AFTER}", " ")
    return F.concat(F.transform(old, lambda p: F.concat(F.lit("GBP:"), p["l"].cast("bigint").cast("string"), F.lit("L:"), p["s"].cast("string"), F.lit("S"))), _solid(_all(rest, AMOUNT)))


def identifiers(text: Column) -> Column:
    return _solid(_all(text, IDENTIFIER))


def urls(text: Column) -> Column:
    return F.transform(_all(text, URL), lambda u: F.regexp_replace(u, r"[.,;:!?)\"\]}]+$", ""))


def isbns(text: Column) -> Column:
    return F.transform(_all(text, ISBN, 1), lambda v: F.regexp_replace(F.upper(v), "[^0-9X]", ""))


def scientific_names(text: Column) -> Column:
    """Binomials right after a scientific cue in their line."""
    found = F.arrays_zip(_all(text, BINOMIAL, 1).alias("g"), _all(text, BINOMIAL, 2).alias("s"))
    kept = F.filter(found, lambda n: ~n["g"].isin(NO_GENUS.split()) & ~F.lower(n["s"]).isin(NO_SPECIES.split()) & ~n["s"].rlike(NO_ENDING))
    return F.transform(kept, lambda n: F.concat_ws(" ", n["g"], n["s"]))


KINDS = {"number": digit_groups, "date": dates, "percentage": percentages, "currency": currencies, "measurement": measurements, "identifier": identifiers, "url": urls, "isbn": isbns, "scientific_name": scientific_names}


def entity_differences(pairs: DataFrame, keys: list[str], source: str, target: str) -> DataFrame:
    """(keys, kind, missing, added): how many values of a kind the target lacks or has too many, for all kinds in one
    aggregate over single values (nothing meets but equal values of one pair)."""
    every = []
    for name, side in ((source, 1), (target, -1)):
        kinds = F.array(*[F.struct(F.lit(k).alias("kind"), f(F.col(name)).alias("values")) for k, f in KINDS.items()])
        values = pairs.select(*keys, F.explode(kinds).alias("_of")).select(*keys, "_of.kind", F.explode("_of.values").alias("value"))
        every.append(values.groupBy(*keys, "kind", "value").agg((F.count("*") * side).alias("n")))
    held = every[0].unionByName(every[1]).groupBy(*keys, "kind", "value").agg(F.sum("n").alias("n"))
    out = held.groupBy(*keys, "kind").agg(F.sum(F.greatest(F.lit(0), F.col("n"))).alias("missing"), F.sum(F.greatest(F.lit(0), -F.col("n"))).alias("added"))
    return out.where("missing > 0 or added > 0")


def mismatch_severity(kind: Column, audited: Column, metadata: Column, source_chars: Column, default: str = "critical") -> Column:
    """How grave a difference is: less where the unit has been audited block by block and is metadata, or long."""
    structured = kind.isin("number", "date", "percentage", "currency", "measurement", "url")
    numeric = kind.isin("number", "date", "percentage", "currency", "measurement")
    return F.when(~audited, default).when(metadata & structured, "medium").when((source_chars >= 4000) & numeric, "medium").otherwise(default)
