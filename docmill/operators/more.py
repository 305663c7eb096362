"""Smaller operators: memory keys, samples against a whole, rules on texts, reports. All are expressions or aggregates.

Defined cases: null text is empty; unknown names have no code, price or rule.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from docmill.functions.entities import AFTER, BEFORE, WORD
from docmill.functions.pairs import BLANK, full, stripped

#: Options that change, that are secret and that are bulky; codes of languages; titles before names; what
#: leaks of a protocol.
VOLATILE = "_candidate_results _editorial_quality_report _fidelity_report _source_guard_refs _source_guard_refs_loaded"
SECRET = "api_key apikey secret token password"
BULKY = "custom_instructions refinement_instructions glossary_terms glossary_term_metadata profile_artifacts profile_prompt"
CODES = {"english": "en", "spanish": "es", "espanol": "es", "español": "es", "french": "fr", "francais": "fr", "français": "fr", "german": "de", "deutsch": "de", "italian": "it", "portuguese": "pt", "auto": "auto"}
TITLES = "Mr|Mrs|Ms|Miss|Dr|Prof|Sir|Lady|Lord|Madame|Monsieur|Señor|Señora|Don|Doña|Captain|Capitan|Capitán|General|King|Queen|Prince|Princess|Father|Mother|Brother|Sister|Master|Mistress"
PROTOCOL = {
    "wrapper_tag": r"(?i)(?:<|&lt;)\s*/?\s*(?:TRANSLATION(?:ATION)*|SOURCE|TARGET|INPUT|OUTPUT|TEXT|TEXT_TO_TRANSLATE|TEXT_TO_TRANSFORM|DRAFT|CANDIDATE|NER_JSON|FIDELITY_AUDIT_JSON|EDITORIAL_GUARD_JSON|PROFILE_AUDIT_JSON|PROFILE_TERM_REVIEW_JSON|GLOSSARY_DISCOVERY_JSON|CORRECTED_TAG_IN|CORRECTED_TAG_OUT)(?:\s+[^>]*?)?\s*(?:>|&gt;)",
    "input_marker": r"(?i)(?<![\p{L}\p{N}_])(?:INPUT_TAG_IN|INPUT_TAG_OUT|TRANSLATE_TAG_IN|TRANSLATE_TAG_OUT|BEGIN_(?:SOURCE|INPUT|TRANSLATION)|END_(?:SOURCE|INPUT|TRANSLATION))(?![\p{L}\p{N}_])",
    "prompt_heading": r"(?i)^\s{0,3}#{1,6}\s*(?:system|user|assistant|instructions?|rules?|requirements?|task|objective|sistema|usuario|asistente|instrucciones?|reglas?|requisitos?|tarea|objetivo|text to translate|text to transform|source text|target text|original source|texto a traducir|texto a transformar|texto fuente|texto objetivo|fuente original|candidate|draft|glossary|continuity|surrounding source context|candidato|borrador|glosario|continuidad|contexto fuente circundante|surrounding draft context|output format|return format|fidelity retry|contexto de borrador circundante|formato de salida|formato de respuesta|reintento de fidelidad|editorial guard|quality audit|repair instructions|guard editorial|auditor[ií]a de calidad|instrucciones de reparaci[oó]n)(?![\p{L}\p{N}_])",
    "prompt_meta_line": r"(?i)^\s*(?:system\s*:|user\s*:|assistant\s*:|developer\s*:|sistema\s*:|usuario\s*:|asistente\s*:|desarrollador\s*:|you are (?:an?|the)\s+|your task is to\s+|eres (?:un|una|el|la)\s+|tu tarea es\s+|(?:return only|respond only|do not translate this block|devuelve solo|responde solo|no traduzcas este bloque|do not output this context|do not include explanations|no incluyas este contexto|no incluyas explicaciones|here is (?:the|your)\s+(?:translation|rewriting|transformation)|(?:aqu[ií]|ac[aá]) (?:est[aá]|tienes) (?:la|tu)\s+(?:traducci[oó]n|reescritura|transformaci[oó]n)|as an ai|i cannot|i can't|i am unable|como (?:ia|modelo de lenguaje)|no puedo)(?![\p{L}\p{N}_]))",
}
RULES: dict[str, Callable[[Column], Column]] = {}


def register_rule(name: str, rule: Callable[[Column], Column]) -> None:
    """A rewriting of texts of one's own, by name."""
    RULES[name] = rule


def apply_rules(text: Column, names: list[str]) -> Column:
    """Registered rules in turn; an unknown name is an error."""
    for name in names:
        text = RULES[name](text)
    return text


# Memory -----------------------------------------------------------------------------------------------------------------


def memory_text(text: Column) -> Column:
    return stripped(F.regexp_replace(full(text), BLANK, " "))


def safe_options(options: Column) -> Column:
    """A map of options without volatile ones, secrets hidden, bulky ones as digests."""
    kept = F.map_filter(options, lambda k, v: ~k.isin(VOLATILE.split()))
    hidden = lambda k: F.exists(F.array(*map(F.lit, SECRET.split())), lambda s: F.contains(F.lower(k), s))
    return F.transform_values(kept, lambda k, v: F.when(hidden(k), "[redacted]").when(k.isin(BULKY.split()), F.sha2(v, 256)).otherwise(v))


def memory_key(source: Column, before: Column, after: Column, options: Column, *identity: Column) -> Column:
    """What a request is remembered by: digests of its source, context and options, and all else that decides."""
    digest = lambda c: F.sha2(c, 256)
    entries = F.array_join(F.transform(F.array_sort(F.map_entries(safe_options(options))), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))), "\x1f")
    context = F.concat_ws("\x1e", memory_text(before), memory_text(after))
    return digest(F.concat_ws("\x1e", digest(memory_text(source)), digest(context), digest(entries), *[F.coalesce(c, F.lit("")) for c in identity]))


def remembered(requests: DataFrame, memory: DataFrame, key: str = "key") -> DataFrame:
    """requests with what the memory holds for their key, and whether it does."""
    return requests.join(memory.select(key, "translated", F.lit(True).alias("_hit")), key, "left").withColumn("hit", F.coalesce("_hit", F.lit(False))).drop("_hit")


# Terms ------------------------------------------------------------------------------------------------------------------


def fold_terms(terms: DataFrame, order: str) -> DataFrame:
    """The first of terms that have the same source, target, policy (in any case) and origin; blank sources go."""
    low = lambda c: F.lower(memory_text(F.col(c)))
    rest = [c for c in terms.columns if c != "origin"]
    kept = terms.where(memory_text(F.col("source")) != "").groupBy(low("source").alias("_s"), low("target").alias("_t"), low("policy").alias("_p"), "origin").agg(F.min_by(F.struct(*rest), order).alias("_r"))
    return kept.select("_r.*", "origin")


def richest_entries(entries: DataFrame, order: str) -> DataFrame:
    """One entry a source, in any case: the first one's fields where it has them, or else any one's; contexts united,
    occurrences summed."""
    key = F.lower(F.trim("source"))
    rows = entries.where(F.trim("source") != "")
    first = lambda c: F.coalesce(F.min_by(c, F.when(F.col(c) != "", F.col(order))), F.lit("")).alias(c)
    contexts = F.array_sort(F.array_distinct(F.flatten(F.collect_list("contexts"))))  # a few contexts an entry
    return rows.groupBy(key.alias("key")).agg(F.min_by(F.trim("source"), order).alias("source"), first("target"), first("category"), F.sum("occurrences").alias("occurrences"), contexts.alias("contexts")).drop("key")


def weighted_names(texts: DataFrame, id_col: str, text_col: str, most: int = 24) -> DataFrame:
    """(id, name, weight): of each text its most frequent names; after a title a name counts three times."""
    title = rf"{BEFORE}(?:{TITLES})\.?\s+(\p{{Lu}}[\p{{L}}'’-]+)"
    plain = rf"{BEFORE}\p{{Lu}}[\p{{Ll}}'’-]{{2,}}(?:\s+(?:(?:de|del|da|do|dos|das|di|du|van|von|la|le|el|y|and|of|the)\s+)?\p{{Lu}}[\p{{Ll}}'’-]{{2,}}){{0,4}}{AFTER}"
    found = F.concat(F.transform(F.regexp_extract_all(full(F.col(text_col)), F.lit(title), F.lit(1)), lambda n: F.struct(n.alias("name"), F.lit(3).alias("w"))), F.transform(F.regexp_extract_all(full(F.col(text_col)), F.lit(plain), F.lit(0)), lambda n: F.struct(n.alias("name"), F.lit(1).alias("w"))))
    weights = texts.select(id_col, F.explode(found).alias("n")).groupBy(id_col, "n.name").agg(F.sum("n.w").alias("weight"))
    return weights.withColumn("_k", F.row_number().over(W.partitionBy(id_col).orderBy(F.desc("weight"), "name"))).where(F.col("_k") <= most).drop("_k")


def quoted_phrases(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, phrase, occurrences) of phrases in quotes that come twice or more: 8 to 90 characters, at most 12 words."""
    found = F.regexp_extract_all(full(F.col(text_col)), F.lit(r"[\"“”'‘’«»]([^\"“”'‘’«»]{8,90})[\"“”'‘’«»]"), F.lit(1))
    phrases = texts.select(id_col, F.explode(found).alias("p")).select(id_col, memory_text(F.col("p")).alias("phrase"))
    return phrases.where(F.length("phrase").between(8, 90) & (F.size(F.split("phrase", " ")) <= 12)).groupBy(id_col, "phrase").agg(F.count("*").alias("occurrences")).where("occurrences >= 2")


def co_mentions(mentions: DataFrame, document: str = "document", window: str = "chunk") -> DataFrame:
    """(document, a, b, n): pairs of entities that stand in the same window, by how many windows; pairs of one window's few
    entities alone."""
    names = mentions.groupBy(document, window).agg(F.array_sort(F.collect_set("entity")).alias("e"))
    pairs = F.flatten(F.transform("e", lambda x, i: F.transform(F.slice("e", i + 2, F.greatest(F.lit(0), F.size("e") - i - 1)), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return names.select(document, F.explode(pairs).alias("p")).groupBy(document, "p.a", "p.b").agg(F.count("*").alias("n"))


# Rules on pairs -----------------------------------------------------------------------------------------------------------


def detector_hits(pairs: DataFrame, rules: list[tuple[str, str, str, str]], keys: list[str], source: str = "s", candidate: str = "t") -> DataFrame:
    """(keys, code, severity, excerpt): the first match of each rule (code, severity, pattern, applies_to: source, candidate
    or both). Rules are few and part of the plan; one whose pattern is none is left out."""
    import re

    hay = {"source": full(F.col(source)), "candidate": full(F.col(candidate)), "both": F.concat(full(F.col(source)), F.lit("\n"), full(F.col(candidate)))}
    found = []
    for code, severity, pattern, where in rules:
        try:
            re.compile(pattern)
        except re.error:
            continue
        match = F.regexp_extract(hay.get(where, hay["candidate"]), f"(?i){pattern}", 0)
        found.append(F.when(hay.get(where, hay["candidate"]).rlike(f"(?i){pattern}"), F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), match.alias("excerpt"))))
    return pairs.select(*keys, F.explode(F.array_compact(F.array(*found))).alias("h")).select(*keys, "h.*")


def _holds(text: Column, term: Column) -> Column:
    return F.regexp_count(F.lower(full(text)), F.concat(F.lit(BEFORE), F.regexp_replace(F.lower(term), r"([\\.\[\]{}()*+?^$|&\-#])", r"\\$1"), F.lit(AFTER))) > 0


def residual_terms(pairs: DataFrame, entries: DataFrame, keys: list[str], source: str = "s", candidate: str = "t") -> DataFrame:
    """(keys, source_term, code): approved entries (source_term, target_term, forbidden, approved) whose forbidden rendering
    the candidate has, or whose source form both sides still have. Entries meet pairs by their first word."""
    first = lambda c: F.regexp_extract(F.lower(c), rf"({WORD}+)", 1)
    rows = entries.where("approved").select("source_term", "target_term", "forbidden")
    words = pairs.select(*keys, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(full(F.col(candidate))), F.lit(rf"{WORD}+"), F.lit(0)))).alias("_w"))
    wanted = rows.select("*", F.explode(F.array_distinct(F.array_compact(F.array(F.nullif(first(F.col("forbidden")), F.lit("")), F.nullif(first(F.col("source_term")), F.lit("")))))).alias("_w"))
    met = words.join(wanted, "_w").drop("_w").distinct().join(pairs.select(*keys, source, candidate), keys)
    forbidden = F.coalesce((F.col("forbidden") != "") & _holds(F.col(candidate), F.col("forbidden")), F.lit(False))
    residual = _holds(F.col(source), F.col("source_term")) & _holds(F.col(candidate), F.col("source_term")) & (F.lower("source_term") != F.lower(F.coalesce("target_term", F.lit(""))))
    return met.withColumn("code", F.when(forbidden, "forbidden_default").when(residual, "glossary_residual")).where("code is not null").select(*keys, "source_term", "code")


def missing_numbers(source: Column, output: Column) -> Column:
    """The numbers that an output has too few of, each as often; none if the source has fewer than two different ones, or
    if one alone, under three in ten, is missing."""
    numbers = lambda t: F.regexp_extract_all(full(t), F.lit(rf"{BEFORE}(?:[0-9]+(?:[.,][0-9]+)?(?:\s*[xX×*]\s*10\^?-?[0-9]+)?|10\^?-?[0-9]+){AFTER}"), F.lit(0))
    have, kept = numbers(source), numbers(output)
    count = lambda a, v: F.size(F.filter(a, lambda x: x == v))
    lost = F.flatten(F.transform(F.array_distinct(have), lambda v: F.array_repeat(v, F.greatest(F.lit(0), count(have, v) - count(kept, v)))))
    few = (F.size(lost) < 2) & (F.size(lost) / F.greatest(F.lit(1), F.size(have)) < 0.3)
    return F.when((F.size(F.array_distinct(have)) < 2) | few, F.array().cast("array<string>")).otherwise(lost)


def absent_repeated_names(source: Column, whole: Column) -> Column:
    """Names that a sample has twice or more and a whole output, in any case, has not."""
    names = F.regexp_extract_all(full(source), F.lit(rf"{BEFORE}\p{{Lu}}\p{{Ll}}{{2,}}{AFTER}"), F.lit(0))
    return F.array_sort(F.filter(F.array_distinct(names), lambda n: (F.size(F.filter(names, lambda x: x == n)) >= 2) & ~F.contains(F.lower(full(whole)), F.lower(n))))


def protected_blocks(text: Column, base: int = 900_000) -> Column:
    """Blocks between empty lines, each after a mark [idN], if there are two or more."""
    parts = F.filter(F.transform(F.split(full(text), r"\n\s*\n"), stripped), lambda p: p != "")
    marked = F.array_join(F.transform(parts, lambda p, i: F.concat(F.lit("[id"), (i + base).cast("string"), F.lit("]\n"), p)), "\n\n")
    return F.when(F.size(parts) >= 2, marked).otherwise(full(text))


def restored_blocks(candidate: Column, blocks: Column, base: int = 900_000) -> Column:
    """The blocks of a marked candidate without their marks, if these are all there in order and no block is empty; else
    null."""
    found = F.regexp_extract_all(full(candidate), F.lit(r"\[id(9[0-9]{5})\]"), F.lit(1))
    wanted = F.transform(F.sequence(F.lit(0), blocks - 1), lambda i: (i + base).cast("string"))
    parts = F.transform(F.slice(F.split(full(candidate), r"\[id9[0-9]{5}\]"), F.lit(2), blocks), stripped)
    return F.when((blocks >= 2) & (found == wanted) & ~F.exists(parts, lambda p: p == ""), F.array_join(parts, "\n\n")).when(blocks < 2, full(candidate))


def residual_protocol(text: Column) -> Column:
    """What of a protocol a text still shows: wrapper tags, input marks, prompt headings, prompt lines."""
    return F.array_compact(F.array(*[F.when(full(text).rlike(p), k) for k, p in PROTOCOL.items()]))


def language_key(name: Column) -> Column:
    """The code of a language by its name, or the language of a tag; empty for none."""
    low = F.replace(F.lower(F.trim(F.coalesce(name, F.lit("")))), F.lit("_"), F.lit("-"))
    known = F.create_map(*[F.lit(x) for pair in CODES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, low), F.substring_index(low, "-", 1))


def wait_seconds(retry_after: Column, reset_ms: Column, now_ms: Column, attempt: Column) -> Column:
    """How long to wait after a refusal: as told in seconds, or until a time that was told (65 at most), or by doubling."""
    until = F.greatest(F.least(F.floor((reset_ms - now_ms) / 1000) + 1, F.lit(65)), F.lit(1))
    return F.when(retry_after.isNotNull(), F.greatest(retry_after, F.lit(1))).when(reset_ms.isNotNull(), until).otherwise(F.least(F.pow(F.lit(2.0), attempt + 2), F.lit(60.0)).cast("long"))


def output_ratio(pairs: DataFrame, ratios: DataFrame, default: tuple[float, float] = (0.95, 1.3)) -> DataFrame:
    """pairs (source, target) of languages with the least and most output for an input, by pair, or the default."""
    low = lambda c: F.lower(F.trim(F.col(c)))
    told = pairs.join(F.broadcast(ratios.select(F.col("source").alias("_s"), F.col("target").alias("_t"), "least", "most")), (low("source") == F.col("_s")) & (low("target") == F.col("_t")), "left")  # a row a configured pair
    return told.drop("_s", "_t").withColumns({"least": F.coalesce("least", F.lit(default[0])), "most": F.coalesce("most", F.lit(default[1]))})


def default_price(models: DataFrame, prices: DataFrame) -> DataFrame:
    """models (provider, model) with the price of the same name, in any case, or else of the first name that holds it or is
    held by it. prices: a configured table (provider, known, price)."""
    low = lambda c: F.lower(F.col(c))
    met = models.join(F.broadcast(prices), low("provider") == low("_provider"), "left")  # a configured table
    fits = F.when(F.col("known") == F.col("model"), 0).when(low("known") == low("model"), 1).when(F.contains(low("model"), low("known")) | F.contains(low("known"), low("model")), 2)
    return met.withColumn("_fit", fits).groupBy("provider", "model").agg(F.min_by("price", F.when(F.col("_fit").isNotNull(), F.struct("_fit", "known"))).alias("price"))


def audit_summary(records: DataFrame, document: str = "document") -> DataFrame:
    """(document, kind, name, value): counts of decisions and issue types, means of scores."""
    decisions = records.groupBy(document, F.coalesce("decision", F.lit("unknown")).alias("name")).agg(F.count("*").cast("double").alias("value")).withColumn("kind", F.lit("decision"))
    scores = records.select(document, F.explode("scores").alias("name", "v")).groupBy(document, "name").agg(F.round(F.avg("v"), 6).alias("value")).withColumn("kind", F.lit("score"))
    issues = records.select(document, F.explode("issues").alias("name")).groupBy(document, "name").agg(F.count("*").cast("double").alias("value")).withColumn("kind", F.lit("issue"))
    return decisions.unionByName(scores).unionByName(issues).select(document, "kind", "name", "value")


def output_report(texts: DataFrame, id_col: str, text_col: str, regional: Column) -> DataFrame:
    """(id, characters, words, paragraphs, mojibake, artifacts, markers, status): fail for broken encoding, regional forms or
    no text; warn for what a reader should not see; else pass."""
    from docmill.functions import segments as S
    from docmill.functions import text as T

    t = F.col(text_col)
    made = texts.select(id_col, F.length(full(t)).alias("characters"), F.coalesce(F.regexp_count(t, F.lit(r"[A-Za-zÁÉÍÓÚÜÑáéíóúüñ0-9]+(?:[-'][A-Za-zÁÉÍÓÚÜÑáéíóúüñ0-9]+)?")), F.lit(0)).alias("words"), F.size(S.paragraphs(t)).alias("paragraphs"), T.mojibake_score(full(t)).alias("mojibake"), S.source_artifacts(t).alias("artifacts"), S.page_markers(t).alias("markers"), S.repeats_paragraphs(t).alias("repeats"), regional.alias("regional"), (stripped(t) == "").alias("_none"))
    status = F.when((F.col("mojibake") > 0) | (F.col("regional") > 0) | F.col("_none"), "fail").when((F.col("artifacts") > 0) | (F.col("markers") >= 3) | F.col("repeats"), "warn").otherwise("pass")
    return made.withColumn("status", status).drop("_none", "regional", "repeats")


def finding_changes(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """(state, n): findings that are fixed, new or still there."""
    a, b = before.select(*keys).distinct().withColumn("_a", F.lit(True)), after.select(*keys).distinct().withColumn("_b", F.lit(True))
    state = F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "fixed").otherwise("kept")
    return a.join(b, keys, "full_outer").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def top_per_bucket(items: DataFrame, bucket: str, order: list[Column], caps: dict[str, int], default: int = 40) -> DataFrame:
    """The first items of each bucket, up to its cap."""
    cap = F.lit(default)
    for name, n in caps.items():
        cap = F.when(F.col(bucket) == name, n).otherwise(cap)
    return items.withColumn("_k", F.row_number().over(W.partitionBy(bucket).orderBy(*order))).where(F.col("_k") <= cap).drop("_k")


def saturation(items: DataFrame, bucket: str, caps: dict[str, int], default: int = 40) -> DataFrame:
    """How full each bucket is, and whether its cap is reached."""
    cap = F.lit(default)
    for name, n in caps.items():
        cap = F.when(F.col(bucket) == name, n).otherwise(cap)
    return items.groupBy(bucket).agg(F.count("*").alias("n")).withColumn("saturated", F.col("n") >= cap)


def line_counts(files: DataFrame) -> DataFrame:
    """(path, lines) of text files (path, text)."""
    return files.select("path", F.size(F.split(F.regexp_replace(full(F.col("text")), r"\n$", ""), "\n")).alias("lines"))
