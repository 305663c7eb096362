"""Toxicity by a weighted finite-state pattern grammar.

A lexical transducer maps words to symbols: insult (a listed word or stem, or one learned), threat, intent, target,
negation, report or mention, clause end, other. A cascade of transducers rewrites the symbols of a clause, the output of
one being the input of the next: the aim transducer turns insults and threats near a target into aimed ones, the intent
transducer marks threats that someone means to carry out, and the negation and the report transducer cancel what stands
in their scope. The cascade is composed into one machine, which each clause with an insult or threat runs through, and
a second one runs backwards, for targets and reports that follow. What is scored is the matched clause, not the word: a
match that is negated, reported or only mentioned counts nothing, a threat counts only when aimed, and each kind of
match that is left (an arc of the grammar) scales the weight of its word by a factor learned from labels around a prior
that sets aimed matches above bare ones. A word or stem weighs the log of how much more often it stands in toxic text.
A document's matches, their sum, density and strongest, make its score by a logistic model fitted around a prior.

Learning is on at most LABELLED labelled documents of at most SAMPLE_BYTES together (by hash of the id). New stems must
cover toxic documents that nothing else covers, more often than chance allows among all candidate stems.

Defined cases: null or word-less text gets the score of a document without matches; rows are scored alone, so ties,
repeated rows and null ids need no rule; without labels the priors hold; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import focus, give_back, table, trimmed

#: Labelled documents that are learned from, and their bytes; lengths of stems; weight of a prior in documents; distinct
#: words that a worker remembers.
LABELLED, SAMPLE_BYTES, STEMS, PRIOR, REMEMBER = 6_000, 64_000_000, (4, 5, 6, 7, 8), 2.0, 100_000
#: The lexicon of the grammar.
INSULTS = "idiot idiots moron morons stupid dumb loser losers scum trash pathetic worthless disgusting clown clowns imbecile fool jerk filthy vermin freak retard bastard bitch asshole"
THREATS = "kill hurt destroy shoot stab beat burn attack murder hang strangle"
INTENTS = "will shall gonna going want wants should must deserve deserves 'll let"
TARGETS = "you your yours yourself u ur they them he she him her tu te toi vous du dich dir ihr sie te usted ustedes ellos"
NEGATIONS = "not no never isn't aren't wasn't weren't don't doesn't didn't neither nor without ne pas jamais nicht kein keine nie sin nunca ni"
REPORTS = "said says say saying claimed claims called calls quoted quotes reported writes wrote alleged dit disait sagte sagt dijo dice word words term terms noun adjective phrase synonym insult insults slur slurs meaning etymology"
WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)?|[.!?;:\n\"“”]")
#: Reach of a scope, in words.
TARGET_REACH, INTENT_REACH, NEGATION_REACH = 4, 3, 3
#: Weight of a listed word before any label is seen, and what the kinds of match scale it by: a bare insult, an aimed
#: one, an aimed threat, one that is meant to be carried out; the document model before any label.
BASE, ARCS = 4.0, {"I": 0.35, "J": 1.2, "U": 0.8, "V": 1.2}
TOP = (-4.0, 1.5, 1.0, 0.5)
#: Stems learned at most; how much more often they must stand in toxic documents; documents that must hold them.
LEARNED, RATIO, HELD = 60, 6.0, 3


class Scope:
    """A transducer over symbols: what opens it, how many words it then reaches (None: to the clause's end), what it
    rewrites meanwhile, and what closes it."""

    def __init__(self, opens: str, reach: int | None, rewrites: dict[str, str], closes: str = "ES"):
        self.opens, self.reach, self.rewrites, self.closes = opens, reach, rewrites, closes

    def step(self, state: int, symbol: str) -> tuple[int, str]:
        if symbol in self.opens:
            return self.reach or 1, symbol
        if symbol in self.closes:
            return 0, symbol
        return (state if self.reach is None else max(0, state - 1)), (self.rewrites.get(symbol, symbol) if state else symbol)


class Cascade:
    """Transducers composed into one machine: the output of each is the input of the next. Its table of arcs is built as
    states are met."""

    def __init__(self, *parts: Scope):
        self.parts, self.arcs = parts, {}

    def run(self, symbols: list[str]) -> list[str]:
        state, out = (0,) * len(self.parts), []
        for symbol in symbols:
            arc = self.arcs.get((state, symbol))
            if arc is None:
                now, to = symbol, []
                for part, q in zip(self.parts, state, strict=True):
                    q, now = part.step(q, now)
                    to.append(q)
                arc = self.arcs[state, symbol] = (tuple(to), now)
            state = arc[0]
            out.append(arc[1])
        return out


def aim() -> Scope:
    return Scope("Y", TARGET_REACH, {"I": "J", "T": "U", "H": "V"})


def intent() -> Scope:
    return Scope("M", INTENT_REACH, {"T": "H", "U": "V"})


def negation() -> Scope:
    return Scope("N", NEGATION_REACH, dict.fromkeys("IJTUHV", "-"))


def report() -> Scope:
    return Scope("R", None, dict.fromkeys("IJTUHV", "-"), closes="E")


class Grammar:
    """Lexicon and machines: from a text to its weighted matches."""

    def __init__(self, weights: dict[str, float], arcs: dict[str, float], cancel: bool = True):
        self.weights, self.arcs, self.cancel = weights, ARCS | arcs, cancel
        self.fixed = {w: k for k, names in (("R", REPORTS), ("N", NEGATIONS), ("M", INTENTS), ("Y", TARGETS), ("T", THREATS), ("I", INSULTS)) for w in names.split()}
        self.fixed |= dict.fromkeys(".!?;\n", "E") | dict.fromkeys(':"“”', "S")
        self.known: dict[str, str] = {}
        self.forward = Cascade(aim(), intent(), *([negation(), report()] if cancel else []))
        self.backward = Cascade(aim(), *([report()] if cancel else []))
        begins = [w for names in (INSULTS, THREATS) for w in names.split()] + [f.removeprefix("=") for f in weights]
        # Texts that this does not match hold no insult or threat (some that it matches hold none, too).
        self.pattern = "(?i)" + "|".join(sorted(set(map(re.escape, begins))))

    def likely(self, texts) -> np.ndarray:
        """Which texts of an Arrow string column may hold a match."""
        import pyarrow.compute as pc

        return pc.fill_null(pc.match_substring_regex(texts, self.pattern), False).to_numpy(zero_copy_only=False)

    def entry(self, low: str) -> str | None:
        """What the lexicon learned of a word: itself or its longest stem."""
        if "=" + low in self.weights:
            return "=" + low
        return next((low[:k] for k in reversed(STEMS) if len(low) >= k and low[:k] in self.weights), None)

    def symbol(self, word: str) -> str:
        got = self.known.get(word)
        if got is None:
            if len(self.known) > REMEMBER:
                self.known.clear()
            low = word.lower()
            got = self.fixed.get(low, "W")
            if got == "W" and self.entry(low) is not None:
                got = "I"
            self.known[word] = got
        return got

    def matches(self, text: str) -> tuple[list[tuple[str, str]], int]:
        """(word, kind) of each match, and the number of words."""
        words = WORD.findall(text)
        symbols = list(map(self.symbol, words))
        found: list[tuple[str, str]] = []
        if "I" not in symbols and "T" not in symbols:
            return found, len(words)
        a = 0
        for b in [*(i for i, s in enumerate(symbols) if s == "E"), len(symbols)]:
            clause, at = symbols[a:b], a
            a = b + 1
            if "I" not in clause and "T" not in clause:
                continue
            out = self.backward.run(self.forward.run(clause)[::-1])[::-1]
            found += [(words[at + i].lower(), s) for i, s in enumerate(out) if s in ARCS]
        return found, len(words)

    def values(self, text: str) -> tuple[list[float], int]:
        """The weight of each match, scaled by its arc."""
        found, n = self.matches(text)
        return [self.weights.get(self.entry(w) or "", BASE) * self.arcs[kind] for w, kind in found], n


class Model:
    """The grammar with its learned weights, and the document model."""

    def __init__(self, weights: dict[str, float], arcs: dict[str, float], top: tuple[float, ...], cancel: bool = True):
        self.grammar, self.top = Grammar(weights, arcs, cancel), top

    def features(self, text: str) -> tuple[float, ...]:
        values, words = self.grammar.values(text)
        total = sum(values)
        return 1.0, math.log1p(total), math.log1p(100.0 * total / max(1, words)), min(6.0, max(values, default=0.0))

    def score(self, text: str) -> float:
        z = sum(a * b for a, b in zip(self.top, self.features(text), strict=True))
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))

    def scores(self, texts) -> np.ndarray:
        """The scores of an Arrow string column; texts without a word of the lexicon need no look at their clauses."""
        held = self.grammar.likely(texts)
        out = np.full(len(texts), self.score(""))
        out[held] = [self.score(t) for t in texts.filter(held).to_pylist()]
        return out

    def __reduce__(self):
        return Model, (self.grammar.weights, self.grammar.arcs, self.top, self.grammar.cancel)


def _stems(word: str) -> list[str]:
    return ["=" + word, *(word[:k] for k in STEMS if len(word) >= k)]


def _words(text: str) -> Counter:
    return Counter(w for w in WORD.findall(text.lower()) if len(w) > 2)


def _lexicon(toxic: list[str], clean: list[str]) -> dict[str, float]:
    """Words and stems with their weights: first the listed ones, then, one at a time, the one that best tells the toxic
    documents that are left from the clean ones."""
    listed = dict.fromkeys("=" + w for w in INSULTS.split())
    fixed = {"=" + w for names in (REPORTS, NEGATIONS, INTENTS, TARGETS, THREATS) for w in names.split()}
    # Features that stand in HELD of the documents without a listed word, found by their hashes: most stand in one alone.
    left = [t for t in toxic if not any("=" + w in listed for w in _words(t))]
    hashes = [np.unique(np.fromiter((hash(f) for w in _words(t) for f in _stems(w)), np.int64)) for t in left]
    values, times = np.unique(np.concatenate([np.zeros(0, np.int64), *hashes]), return_counts=True)
    often = set(values[times >= HELD].tolist())
    del hashes, values, times

    def features(text: str) -> Counter:
        out: Counter = Counter()
        for w, n in _words(text).items():
            for f in _stems(w):
                if hash(f) in often or f in listed:
                    out[f] += n
        return out

    left = [features(t) for t in left]
    count = {f: c for f, c in Counter(f for s in left for f in s).items() if c >= HELD and f not in fixed}
    wanted = count.keys() | set(listed)
    of_word: dict[str, list[str]] = {}
    none: list[str] = []
    docs_with, docs_often, times_clean, times_toxic = Counter(), Counter(), Counter(), Counter()
    for text in clean:
        held_of = Counter()
        for w, n in _words(text).items():
            found = of_word.get(w)
            if found is None:
                found = [f for f in _stems(w) if f in wanted]
                if len(of_word) < REMEMBER:
                    of_word[w] = found or none
            for f in found:
                held_of[f] += n
        docs_with.update(held_of.keys())
        docs_often.update(f for f, n in held_of.items() if n > 1)
        times_clean.update(held_of)
    for text in toxic:
        times_toxic.update({f: n for f, n in features(text).items() if f in wanted})
    words_toxic, words_clean = (max(1, sum(len(WORD.findall(t)) for t in texts)) for texts in (toxic, clean))
    weigh = lambda f: min(6.0, max(0.5, math.log((times_toxic[f] + 0.5) / words_toxic) - math.log((times_clean[f] + 0.5) / words_clean)))
    weights = {f: (weigh(f) * (times_toxic[f] + times_clean[f]) + BASE * PRIOR) / (times_toxic[f] + times_clean[f] + PRIOR) for f in listed}
    share = min(0.9, max((len(toxic) + 0.5) / (len(toxic) + len(clean) + 1), 1e-3))
    chance = math.log(max(1, len(count)) / 0.05)
    # Only features that would tell more than chance if all documents left had them can be chosen.
    names = sorted(count)
    most = np.array([count[f] for f in names], float)
    told = [_against(most, np.array([docs[f] for f in names], float), share) > chance for docs in (docs_with, docs_often)]
    names = [names[k] for k in np.flatnonzero(told[0] | told[1])] if names else []
    at = {f: k for k, f in enumerate(names)}
    held = np.zeros((len(left), len(names)), np.int8)
    for i, s in enumerate(left):
        for f in s.keys() & at.keys():
            held[i, at[f]] = min(s[f], 2)
    others = {1: np.array([docs_with[f] for f in names]), 2: np.array([docs_often[f] for f in names])}
    for _ in range(LEARNED if names else 0):
        best = max((_best(names, (held >= least).sum(0), others[least], len(held), len(clean), share, chance) + (least,)) for least in (1, 2))
        if not best[1]:
            break
        _, chosen, least = best
        weights[chosen] = weigh(chosen)
        held = held[held[:, at[chosen]] < least]
    return weights


def _against(c: np.ndarray, h: np.ndarray, share: float) -> np.ndarray:
    """What c toxic and h clean documents with a feature say against chance: a relative entropy."""
    n = c + h
    x = c / np.maximum(n, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        part = x * np.log(x / share) + np.where(x < 1, (1 - x) * np.log((1 - x) / (1 - share)), 0.0)
    return np.where(x > share, n * np.nan_to_num(part), 0.0)


def _best(names: list[str], now: np.ndarray, held: np.ndarray, left: int, clean: int, share: float, chance: float) -> tuple[float, str]:
    """The feature that best tells the documents left (now: in how many it is) from clean ones (held), if one does more
    than chance."""
    ratio = ((now + 0.5) / (left + 1)) / ((held + 0.5) / (clean + 1))
    gain = np.where((now >= HELD) & (ratio >= RATIO) & (_against(now, held, share) > chance), now * np.log(np.maximum(ratio, 1.0)), 0.0)
    most = float(gain.max(initial=0.0))
    if most <= 0:
        return 0.0, ""
    return most, min((names[k] for k in np.flatnonzero(gain == most)), key=lambda f: (len(f), f))


def learn(rows: list[tuple[str, int]], cancel: bool = True) -> Model:
    """From (text, toxic) rows; a text with both labels counts as toxic. Without cancel, negation and report say nothing."""
    import pyarrow as pa

    rows = list({t: y for t, y in sorted(rows)}.items())
    toxic, clean = [t for t, y in rows if y], [t for t, y in rows if not y]
    weights = _lexicon(toxic, clean)
    grammar = Grammar(weights, {}, cancel)
    likely = grammar.likely(pa.array([t for t, _ in rows], pa.large_string())).tolist()
    seen: dict[str, list[float]] = {}
    for (text, y), some in zip(rows, likely, strict=True):
        for kind in {k for _, k in grammar.matches(text)[0]} if some else ():
            seen.setdefault(kind, [0.0, 0.0])[y] += 1
    arcs = {k: (4 * PRIOR * ARCS[k] + 1.2 * v[1]) / (4 * PRIOR + sum(v)) for k, v in seen.items()}
    model = Model(weights, arcs, TOP, cancel)
    none = model.features("")
    x = np.array([model.features(t) if some else none for (t, _), some in zip(rows, likely, strict=True)]).reshape(-1, len(TOP))
    y = np.array([y for _, y in rows], float)
    prior = np.array(TOP)
    top, ridge = prior.copy(), np.array([0.05, 0.3, 0.3, 0.3])
    for _ in range(40 if len(rows) else 0):  # Newton's method around the prior
        p = 1 / (1 + np.exp(-np.clip(x @ top, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * (top - prior))
        top = top + step * min(1.0, 2.0 / max(1e-9, float(np.abs(step).max())))
    return Model(weights, arcs, tuple(top.tolist()), cancel)


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, id_col: str, text_col: str, limit: int) -> list[tuple[str, int]]:
    """(text, label) of at most limit labelled documents that are not held out, of at most SAMPLE_BYTES together: those of
    the least hashes of their ids, then of their texts."""
    fit = labels.select(F.col(id_col).cast("long").alias("l_id"), F.col(column).cast("int").alias("y")).where("l_id is not null and y in (0, 1) and crc32(cast(l_id as string)) % 3 <> 1")
    fit = fit.groupBy("l_id").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z").orderBy(F.xxhash64("l_id"), "l_id").limit(limit).select("l_id", "y")
    chosen = docs.select(F.col(id_col).cast("long").alias("d_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(fit), F.col("d_id") == F.col("l_id"))  # limit rows at most
    held = table(chosen.select("l_id", "y", "text", F.xxhash64("text").alias("h"), F.octet_length("text").cast("long").alias("size")), "labelled")
    order = [F.xxhash64("l_id"), F.col("l_id"), F.col("h")]
    sizes = np.cumsum([r.size for r in held.select("l_id", "h", "size").orderBy(*order).limit(limit).collect()])  # limit rows at most
    n = int(np.searchsorted(sizes, SAMPLE_BYTES, "right"))
    got = held.orderBy(*order).limit(n).select("text", "y").toArrow()
    return list(zip(got.column("text").to_pylist(), got.column("y").to_pylist(), strict=True))


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", reject: float = 0.7, limit: int = LABELLED) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs."""
    model = learn(labelled_sample(docs, labels, label_col, id_col, text_col, limit))
    give_back()

    def run(batches) -> Iterator:
        import pyarrow as pa

        focus("toxicity")
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(batch.column(1)), pa.float64())], names=["doc_id", "score"])

    scored = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(trimmed(run), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= reject, 1).otherwise(0).alias("predicted"))


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", reject: float = 0.7, limit: int = LABELLED) -> DataFrame:
    """The rows of docs that are not rejected, in one pass over them."""
    model = learn(labelled_sample(docs, labels, label_col, id_col, text_col, limit))
    give_back()
    at = docs.columns.index(text_col)

    def run(batches) -> Iterator:
        import pyarrow as pa

        focus("toxicity")
        for batch in batches:
            yield batch.filter(pa.array(model.scores(batch.column(at)) < reject))

    return docs.mapInArrow(trimmed(run), docs.schema)
