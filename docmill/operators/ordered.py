"""Operators whose result depends on the order of rows within a key: what a window says is a window, what carries state
from row to row is folded over sorted partitions, one key after another, in a few values of memory.

A folded key's rows pass through one task in order, as their definition asks; different keys spread over all tasks. The
same fold serves a batch (mapInArrow over a sorted repartition) and a stream (applyInPandasWithState), see
docmill.streaming.

Defined cases: null keys are a key; ties in the order are broken by the id; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def folded(rows: DataFrame, key: str, order: list[str], step: Callable, start: Callable, fields: str) -> DataFrame:
    """rows with what step(state, row) -> (state, values) says of each, in order; start() is a key's first state. fields
    is the schema of the values, and step gets the row as a dict."""
    import pyarrow as pa
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    added = StructType.fromDDL(fields)
    kinds = to_arrow_schema(added)
    none = object()

    def run(batches) -> Iterator:
        now, state = none, None
        for batch in batches:
            values: list[list] = [[] for _ in kinds]
            for row in batch.to_pylist():
                if row[key] != now or now is none:
                    now, state = row[key], start()
                state, said = step(state, row)
                for column, value in zip(values, said, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(v, f.type) for v, f in zip(values, kinds, strict=True))], names=[*batch.schema.names, *kinds.names])

    dealt = rows.repartition(key).sortWithinPartitions(key, *order)
    return dealt.mapInArrow(run, StructType(rows.schema.fields + added.fields))


# Folds ------------------------------------------------------------------------------------------------------------------


def breaker_step(threshold: int = 5, timeout: float = 60.0, successes: int = 2) -> Callable:
    """A circuit breaker over attempts (at, ok): whether each is allowed, and the state after it. An attempt that is not
    allowed is not made, so its outcome changes nothing."""

    def step(state, row):
        kind, failures, good, last = state
        at, ok = row["at"], row["ok"]
        if kind == "open":
            if last is None or at - last < timeout:
                return state, (False, kind)
            kind, good = "half_open", 0
        if ok:
            if kind == "half_open":
                good += 1
                if good >= successes:
                    kind, failures, good = "closed", 0, 0
            else:
                failures = max(0, failures - 1)
        else:
            failures, last = failures + 1, at
            if failures >= threshold:
                kind, good = "open", 0
        return (kind, failures, good, last), (True, kind)

    return step


def circuit_breaker(attempts: DataFrame, key: str, order: list[str], **limits) -> DataFrame:
    """attempts (key, at, ok) with allowed and state."""
    return folded(attempts, key, order, breaker_step(**limits), lambda: ("closed", 0, 0, None), "allowed boolean, state string")


def limiter_step(most: int = 10, window: float = 60.0) -> Callable:
    """A rate limit over requests (at): those that are refused are not counted."""

    def step(state, row):
        kept = [t for t in state if t > row["at"] - window]
        if len(kept) >= most:
            return kept, (False,)
        return [*kept, row["at"]], (True,)

    return step


def rate_limited(requests: DataFrame, key: str, order: list[str], **limits) -> DataFrame:
    """requests (key, at) with allowed."""
    return folded(requests, key, order, limiter_step(**limits), list, "allowed boolean")


def eta_step(slow: float = 0.5, fast: float = 0.15) -> Callable:
    """Seconds left by a rate that follows slowing down faster than speeding up; a new phase begins anew. Rows: at, phase,
    done, total."""

    def step(state, row):
        phase, at, done, rate = state
        if row["phase"] != phase or row["done"] < done:
            phase, rate = row["phase"], None
        elif row["done"] > done and row["at"] > at:
            now = (row["at"] - at) / (row["done"] - done)
            rate = now if rate is None else rate + (slow if now > rate else fast) * (now - rate)
        else:
            return (phase, at, done, rate), (None if rate is None else max(0.0, (row["total"] - row["done"]) * rate),)
        state = (phase, row["at"], row["done"], rate)
        return state, (None if rate is None else max(0.0, (row["total"] - row["done"]) * rate),)

    return step


def remaining_time(rows: DataFrame, key: str, order: list[str], **weights) -> DataFrame:
    return folded(rows, key, order, eta_step(**weights), lambda: (None, 0.0, 0, None), "seconds_left double")


def context_step(least: int, most: int, stride: int, window: int = 5, share: float = 0.8) -> Callable:
    """A context size that grows by strides until a call fits, and shrinks by one when the last calls all fit well into
    the smaller size; then the history begins anew. Rows: used."""

    def step(state, row):
        size, history = state
        used = row["used"]
        while size < most and used > size:
            size, history = min(most, size + stride), []
        history = [*history, used][-window:]
        smaller = max(size - stride, least)
        if smaller < size and len(history) == window and max(history) <= share * smaller:
            return (smaller, []), (smaller,)
        return (size, history), (size,)

    return step


def adaptive_context(rows: DataFrame, key: str, order: list[str], least: int = 2048, most: int = 131072, stride: int = 2048, **limits) -> DataFrame:
    """rows (key, used) with the size after each."""
    return folded(rows, key, order, context_step(least, most, stride, **limits), lambda: (least, []), "size int")


def batch_step(most: int, chars: int, blanks: bool = False) -> Callable:
    """The number of the batch that a unit goes into: a batch ends before the unit that would make it too long or too many.
    With blanks, empty units join an open batch and begin none (-1)."""

    def step(state, row):
        number, units, size = state
        n = row["size"]
        if blanks and not n:
            return ((number, units + 1, size), (number,)) if units else (state, (-1,))
        if units and (units >= most or size + n > chars):
            number, units, size = number + 1, 0, 0
        return (number, units + 1, size + n), (number,)

    return step


def batched(units: DataFrame, key: str, order: list[str], most: int, chars: int, blanks: bool = False) -> DataFrame:
    """units (key, size) with the number of their batch."""
    return folded(units, key, order, batch_step(most, chars, blanks), lambda: (0, 0, 0), "batch int")


def merge_step(most: int = 100) -> Callable:
    """The number of the cue that a subtitle goes into: it joins the one before if that does not end, if it does not begin
    anew and if both are short together. Rows: text."""

    def step(state, row):
        number, held = state
        text = row["text"] or ""
        goes_on = bool(held) and bool(text) and held.rstrip()[-1:] not in (".", "!", "?") and (not text.strip()[:1].isupper() or text.strip().startswith("I ") or text.strip() == "I")
        if held is not None and len(held) + len(text) + 1 <= most and goes_on:
            return (number, f"{held} {text}"), (number,)
        return (number + 1, text), (number + 1,)

    return step


def merged_cues(cues: DataFrame, key: str, order: str, most: int = 100) -> DataFrame:
    """(key, cue, start, stop, text, numbers): subtitles with those that go on joined."""
    dealt = folded(cues, key, [order], merge_step(most), lambda: (-1, None), "cue int")
    line = F.struct(F.col(order).alias("o"), "number", "start", "stop", "text")
    lines = dealt.groupBy(key, "cue").agg(F.array_sort(F.collect_list(line)).alias("l"))  # as many as fit into one cue
    return lines.select(key, "cue", F.col("l")[0]["start"].alias("start"), F.element_at("l", -1)["stop"].alias("stop"), F.array_join(F.transform("l", lambda x: x["text"]), " ").alias("text"), F.size("l").alias("numbers"))


def subtitle_file(cues: DataFrame, key: str, order: str) -> DataFrame:
    """(key, content): the cues of each file written as one text, in order."""
    block = F.concat_ws("\n", F.col("number"), F.concat_ws(" --> ", "start", "stop"), "text")
    rows = cues.select(key, F.struct(F.col(order).alias("o"), F.concat(block, F.lit("\n")).alias("b")).alias("c"))
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda c: c["b"]), "\n").alias("content"))  # a file of subtitles


# Windows ----------------------------------------------------------------------------------------------------------------


def phase_times(events: DataFrame, job: str = "job") -> DataFrame:
    """events (job, phase, status, at) of started, completed and failed phases: each start with how it ended and the
    seconds it took; a phase that is still open has neither."""
    order = W.partitionBy(job, "phase").orderBy("at")
    ends = F.when(F.lead("status").over(order).isin("completed", "failed"), F.struct(F.lead("status").over(order).alias("status"), F.lead("at").over(order).alias("at")))
    rows = events.withColumn("_end", ends).where("status = 'started'")
    return rows.select(job, "phase", F.col("at").alias("started_at"), F.col("_end.status").alias("ended"), F.when(F.col("_end").isNotNull(), F.greatest(F.lit(0.0), F.col("_end.at") - F.col("at"))).alias("seconds"))


def stalled(jobs: DataFrame, now: Column, seconds: float) -> DataFrame:
    """Running jobs whose last activity is longer ago than some seconds; jobs without any are not looked at."""
    return jobs.where((F.col("status") == "running") & F.col("last_activity").isNotNull() & (now - F.col("last_activity") > seconds))


def global_percent(phase: Column, done: Column, total: Column, refine: Column, split: float = 50.0) -> Column:
    """Progress over both phases: translation up to the split, refinement after it; one phase alone is all."""
    ratio = F.when(total > 0, F.least(done / total, F.lit(1.0))).otherwise(0.0)
    both = F.when(phase == "translating", ratio * split).otherwise(split + ratio * (100.0 - split))
    return F.least(F.lit(100.0), F.when(~refine, ratio * 100.0).otherwise(both))


def progress_snapshot(rows: DataFrame, job: str, order: str, percent: Column, elapsed: Column) -> DataFrame:
    """Progress that never falls, and the seconds left at its pace."""
    p = F.max(percent).over(W.partitionBy(job).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    out = rows.withColumn("percent", p).withColumn("elapsed", elapsed)
    left = F.when((F.col("percent") > 0) & (F.col("percent") < 100), F.col("elapsed") * (100 - F.col("percent")) / F.col("percent"))
    return out.withColumn("seconds_left", F.when(F.col("percent") >= 100, 0.0).otherwise(left))


def entity_memory(mentions: DataFrame, document: str = "document") -> DataFrame:
    """mentions (document, entity, chunk, section, n): per entity its first and last chunk, occurrences and sections."""
    return mentions.groupBy(document, "entity").agg(F.min("chunk").alias("first_chunk"), F.max("chunk").alias("last_chunk"), F.sum("n").alias("occurrences"), F.count_distinct("section").alias("sections"))


#: What a category adds to an entity's rank, and any other.
CATEGORY_RANK, OTHER_RANK = {"character": 18.0, "location": 12.0, "organization": 11.0, "item": 9.0, "title": 7.0, "other": 4.0}, 4.0


def entity_rank(in_chunk: Column, category: Column, occurrences: Column, since: Column, confidence: Column, listed: Column, same_section: Column, salience: Column) -> Column:
    """How much an entity matters to a chunk: whether it is in it, its category, how often and how lately it came."""
    kind = F.lit(OTHER_RANK)
    for name, value in CATEGORY_RANK.items():
        kind = F.when(category == name, value).otherwise(kind)
    yes = lambda c, v: F.when(c, v).otherwise(0.0)
    return yes(in_chunk, 90.0) + kind + F.least(occurrences, F.lit(40)) * 0.75 + F.greatest(F.lit(0.0), 18.0 - since * 1.8) + confidence * 12.0 + yes(listed, 25.0) + yes(same_section, 8.0) + F.least(salience, F.lit(120)) * 0.08


def absent_names(names: Column, text: Column, most: int = 12) -> Column:
    """Of the first names of a list those of whose parts (three letters or more) a text has none."""
    low = F.lower(F.coalesce(text, F.lit("")))
    parts = lambda n: F.filter(F.split(F.lower(n), r"[^\p{L}]+"), lambda p: F.length(p) >= 3)
    return F.filter(F.slice(names, F.lit(1), F.lit(most)), lambda n: (F.size(parts(n)) > 0) & ~F.exists(parts(n), lambda p: F.contains(low, p)))


STYLE_CAPS = {"sentence_words": 80.0, "paragraphs": 30.0, "dialogue": 30.0, "colons": 40.0}


def style_vector(text: Column) -> dict[str, Column]:
    """Words a sentence, and paragraphs, dialogue marks and colons a thousand words, each up to a cap."""
    value = F.coalesce(text, F.lit(""))
    count = lambda p: F.coalesce(F.regexp_count(value, F.lit(p)), F.lit(0))
    words = F.greatest(F.lit(1), count(r"[\p{L}\p{N}_]+(?:['’-][\p{L}\p{N}_]+)*"))
    paragraphs = F.size(F.filter(F.split(value, r"\n\s*\n"), lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")) != ""))
    found = {"sentence_words": words / F.greatest(F.lit(1), count(r"[.!?。！？]+")), "paragraphs": paragraphs * 1000.0 / words, "dialogue": count(r"(?:^|\n)\s*(?:[-–—]|[\"“«])") * 1000.0 / words, "colons": count("[;:]") * 1000.0 / words}
    return {k: F.least(F.lit(STYLE_CAPS[k]), v) for k, v in found.items()}


def style_drift(rows: DataFrame, document: str, order: str) -> DataFrame:
    """How far a chunk's style vector (columns of style_vector) is from that of the one before, up to 1; null for a first."""
    w = W.partitionBy(document).orderBy(order)
    terms = [F.pow((F.col(k) - F.lag(k).over(w)) / cap, F.lit(2)) for k, cap in STYLE_CAPS.items()]
    return rows.withColumn("drift", F.least(F.lit(1.0), F.sqrt(sum(terms, F.lit(0.0)) / len(STYLE_CAPS))))


def reconciled(paragraphs: Column, expected: Column) -> Column:
    """As many paragraphs as expected: empty ones added, or the last ones joined."""
    n = F.size(paragraphs)
    padded = F.concat(paragraphs, F.array_repeat(F.lit(""), F.greatest(F.lit(0), expected - n)))
    joined = F.concat(F.slice(paragraphs, F.lit(1), F.greatest(F.lit(0), expected - 1)), F.array(F.array_join(F.slice(paragraphs, F.greatest(F.lit(1), expected), F.greatest(F.lit(0), n - expected + 1)), " ")))
    return F.when(n <= expected, padded).otherwise(joined)


def invalidated(previous: dict[str, Column], current: dict[str, Column]) -> Column:
    """The stages from the first on whose fingerprint changed."""
    names = list(previous)
    out = F.array().cast("array<string>")
    for k, name in reversed(list(enumerate(names))):
        out = F.when(~previous[name].eqNullSafe(current[name]), F.array(*map(F.lit, names[k:]))).otherwise(out)
    return out


def stable_unit_id(file: Column, ordinal: Column, source_hash: Column) -> Column:
    """An id that file, place and source text decide."""
    identity = F.concat(file, F.lit("\x00"), ordinal.cast("int").cast("string"), F.lit("\x00"), source_hash)
    return F.concat(F.lit("epub:"), file, F.lit(":"), F.lpad(ordinal.cast("int").cast("string"), 6, "0"), F.lit(":"), F.substring(F.sha2(identity, 256), 1, 24))


def placeholder_problem(text: Column, expected: Column) -> Column:
    """Whether the placeholders [idN] of a text are 0, 1, 2, ... as many as expected: null, count or order."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\[id([0-9]+)\]"), F.lit(1)), lambda x: x.cast("int"))
    order = F.array_sort(found) == F.sequence(F.lit(0), F.greatest(F.lit(0), expected - 1))
    return F.when(expected <= 0, F.lit(None)).when(F.size(found) != expected, "count").when(~order, "order")


def missing_placeholders(text: Column, expected: Column) -> Column:
    return F.filter(expected, lambda p: ~F.contains(F.coalesce(text, F.lit("")), p))


def is_not_translatable(text: Column) -> Column:
    """Blank, invisible or numeric."""
    value = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\s\x{00A0}]+|[\s\x{00A0}]+$", "")
    return (value == "") | value.rlike(r"^[\s\x{00A0}\x{2000}-\x{200F}]+$") | (value.rlike(r"^[0-9.\-–—)(\s\x{00A0}\x{2000}-\x{200F}\x{2028}\x{2029}]+$") & value.rlike("[0-9]"))


#: Languages that run from right to left, by code and by name; codes by name.
RIGHT_TO_LEFT = "ar he iw fa ur ps sd yi ug ku"
RIGHT_TO_LEFT_NAMES = {"arabic": "ar", "hebrew": "he", "persian": "fa", "farsi": "fa", "urdu": "ur", "pashto": "ps", "sindhi": "sd", "yiddish": "yi", "uyghur": "ug", "kurdish": "ku"}
LANGUAGE_CODES = RIGHT_TO_LEFT_NAMES | dict(
    pair.split(":")
    for pair in "english:en spanish:es french:fr german:de italian:it portuguese:pt russian:ru chinese:zh japanese:ja korean:ko dutch:nl polish:pl turkish:tr swedish:sv norwegian:no danish:da finnish:fi czech:cs greek:el thai:th vietnamese:vi indonesian:id malay:ms ukrainian:uk romanian:ro bulgarian:bg croatian:hr serbian:sr slovak:sk slovenian:sl estonian:et latvian:lv lithuanian:lt hindi:hi bengali:bn tamil:ta telugu:te marathi:mr gujarati:gu kannada:kn malayalam:ml punjabi:pa hungarian:hu catalan:ca basque:eu galician:gl irish:ga welsh:cy icelandic:is albanian:sq macedonian:mk afrikaans:af swahili:sw filipino:fil tagalog:tl".split()
)


def language_code(language: Column) -> Column:
    """The code of a language's name, or of a locale's language; null if it is not known."""
    low = F.lower(F.trim(language))
    base = F.substring_index(low, "-", 1)
    names = F.create_map(*[F.lit(x) for pair in LANGUAGE_CODES.items() for x in pair])
    known = F.array(*map(F.lit, LANGUAGE_CODES.values()))
    return F.coalesce(F.try_element_at(names, low), F.when(F.array_contains(known, base), base), F.try_element_at(names, base))


def is_right_to_left(language: Column) -> Column:
    low = F.lower(F.trim(language))
    return F.coalesce(low.isin(*RIGHT_TO_LEFT.split(), *RIGHT_TO_LEFT_NAMES) | F.substring_index(low, "-", 1).isin(RIGHT_TO_LEFT.split()), F.lit(False))


def goes_on(before: Column, after: Column) -> Column:
    """Whether two neighbouring paragraphs look like one that a page parted: the second begins small, and the first ends in
    a hyphen or, both being long, without an end."""
    a, b = (F.trim(F.regexp_replace(F.coalesce(t, F.lit("")), r"[\s\x{00A0}]+", " ")) for t in (before, after))
    small = b.rlike(r"^[\"'‘“«(\[{]*\p{Ll}")
    hyphen, ended = a.rlike(r"[-\x{00AD}]\s*\p{L}?\s*$"), a.rlike(r"[.!?…:;][\"'’”»)\]}]*$")
    return (a != "") & (b != "") & small & (hyphen | (~ended & (F.length(a) >= 40) & (F.length(b) >= 20)))


def resume_at(now: Column, delay: Column, told: Column) -> Column:
    """When to go on: after a delay (not under 0), but not before a time that was told."""
    return F.greatest(now + F.greatest(F.lit(0.0), F.coalesce(delay, F.lit(0.0))), F.coalesce(told, now))
