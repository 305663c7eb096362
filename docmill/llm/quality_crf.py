"""Document quality by a linear-chain conditional random field over lines.

Each line is good or bad, by features of itself and of the lines beside it, and by the labels of its neighbours;
forward-backward gives each line's marginal. Only documents have labels, so those of lines are latent: fitting
alternates between the lines' posterior labels, tilted just so far that a good document is expected to be at least GOOD
good and a bad one at least BAD bad, and the field's weights and moves given those labels. A bad document thus keeps its
good lines. The length-weighted good marginals, their worst and the share of bad text are then aggregated by a small
logistic model into the document's score.

Fitting is on at most LABELLED labelled documents (a bounded sample by hash of the id, bounded in bytes too), whole.

Defined cases: null, empty or blank text has no line and gets the score fitted to such documents (or EMPTY without
any); rows are scored alone, so ties, repeated rows and null ids need no rule; without labels of both kinds every score
is the share of good labels, or 0.5; an empty table gives an empty result; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, focus, give_back, mix, steps, trimmed, word_hashes
from .toxicity import held_out, labelled_sample

#: Labelled documents that are learned from; rounds of the fit, and steps of each; ridge on weights and on moves; score of
#: a text without lines; shares of lines that a document's label asks for; how much sharper lines are told while fitting;
#: lines from which a chain is scanned in blocks.
LABELLED, ROUNDS, FIT_STEPS, RIDGE, STIFF, EMPTY = 2_500, 5, 24, 1e-3, 2e-3, 0.1
GOOD, BAD, SHARP, LONG = 0.95, 0.5, 4.0, 2048

_CLASS = np.zeros((8, 256), np.float32)
_CLASS[0, 65:91] = 1  # capitals
_CLASS[1, 48:58] = 1  # digits
_CLASS[2, [ord(c) for c in "#$%&*@^~_=+<>{}[]\\/"]] = 1  # symbols
_CLASS[3, ord("|")] = 1
_CLASS[4, ord("!")] = 1
_CLASS[5, 128:] = 1  # beyond ASCII
_CLASS[6, [ord(c) for c in ".,;:?'\"()-"]] = 1  # punctuation
_CLASS[7, [32, 9]] = 1
OWN = 15


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, lengths, first line of each row) of the non-blank lines of some rows."""
    base = int(offsets[0])
    raw = data[base : int(offsets[-1])]
    rows = offsets - base
    n = len(raw)
    breaks = np.flatnonzero(raw == 10)
    starts = np.unique(np.concatenate([rows[:-1][rows[:-1] < n], breaks[breaks + 1 < n] + 1]))
    if not len(starts):
        return np.zeros((0, OWN), np.float32), np.zeros(0), np.zeros(len(rows), np.int64)
    ends = np.append(starts[1:], n)
    sums = [np.add.reduceat(_CLASS[k][raw], starts) for k in range(8)]
    size = (ends - starts).astype(np.float64)
    bounds = np.append(starts, n)
    words, at = word_hashes(raw, bounds)
    count = (at[1:] - at[:-1]).astype(np.float64)
    again = np.zeros(len(words) + 1)
    if len(words) > 1:
        again[1 : len(words)] = words[1:] == words[:-1]
    apart = np.zeros(len(words) + 1)
    if len(words) > 2:
        apart[2 : len(words)] = words[2:] == words[:-2]
    total = lambda x: np.diff(np.concatenate([[0.0], np.cumsum(x)])[at])
    content = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(words), dtype=np.uint64)])[at]
    line = content[1:] - content[:-1]
    keep = count > 0
    row = np.searchsorted(rows, starts, "right") - 1
    starts, ends, size, count, row, line = (x[keep] for x in (starts, ends, size, count, row, line))
    sums = [s[keep] for s in sums]
    order = np.lexsort((np.arange(len(line)), line, row))
    repeat = np.zeros(len(line))
    same = (line[order][1:] == line[order][:-1]) & (row[order][1:] == row[order][:-1])
    repeat[order[1:][same]] = 1
    solid = np.maximum(size - sums[7], 1)
    last = raw[np.maximum(ends - 2, starts)]
    columns = [np.log1p(size) / 5, np.log1p(count) / 4, np.minimum(solid / count, 30) / 10, *(s / solid for s in sums[:7]), total(again)[keep] / count, total(apart)[keep] / count, repeat, np.isin(last, [46, 33, 63]).astype(float), np.ones(len(size))]
    features = np.stack(columns, 1).astype(np.float32)
    return features, size, np.searchsorted(row, np.arange(len(rows)))


def beside(own: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Own features with those of the line before and the line after; none beyond a row's ends."""
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    edges = first[:-1][first[:-1] < len(own)]
    before[edges] = 0
    ends = first[1:][first[1:] > 0] - 1
    after[ends] = 0
    return np.concatenate([own, before, after], 1)


def _messages(emit: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Forward messages of one long chain: transfer matrices of its blocks, all blocks side by side, then the blocks in
    turn; about twice the root of its length in steps."""
    n = len(emit)
    size = int(np.sqrt(n)) + 1
    blocks = -(-n // size)
    padded = np.zeros((blocks * size, 2))
    padded[:n] = emit
    padded = padded.reshape(blocks, size, 2)
    through = np.empty((size, blocks, 2, 2))  # from the label before a block to that of its j-th line
    through[0] = move[None] + padded[:, 0][:, None, :]
    through[0, 0] = [padded[0, 0], [-1e30, -1e30]]  # before the chain is nothing
    for j in range(1, size):
        x = through[j - 1][:, :, :, None] + move[None, None]
        through[j] = np.logaddexp(x[:, :, 0], x[:, :, 1]) + padded[:, j][:, None, :]
    before, held = np.empty((blocks, 2)), np.array([0.0, -1e30])
    for k in range(blocks):
        before[k] = held
        x = held[:, None] + through[-1, k]
        held = np.logaddexp(x[0], x[1])
    x = before[None, :, :, None] + through
    return np.logaddexp(x[:, :, 0], x[:, :, 1]).transpose(1, 0, 2).reshape(-1, 2)[:n]


def marginals(emit: np.ndarray, move: np.ndarray, first: np.ndarray, pairs: bool = False):
    """Forward-backward over all rows side by side, long ones in blocks: P(label) of each line, log Z of each row and, if
    asked, the expected moves between labels. emit: lines x 2."""
    every = np.diff(first)
    alpha, beta = np.zeros_like(emit), np.zeros_like(emit)
    for r in np.flatnonzero(every > LONG):
        own = emit[first[r] : first[r + 1]]
        alpha[first[r] : first[r + 1]] = _messages(own, move)
        beta[first[r] : first[r + 1]] = _messages(own[::-1], move.T)[::-1] - own
    lens = np.where(every > LONG, 0, every)
    order = np.argsort(-lens, kind="stable")
    most = int(lens.max(initial=0))
    live = [int((lens[order] > t).sum()) for t in range(most)]
    for t in range(most):
        at = first[:-1][order[: live[t]]] + t
        if t == 0:
            alpha[at] = emit[at]
        else:
            x = alpha[at - 1][:, :, None] + move[None]
            alpha[at] = emit[at] + np.logaddexp(x[:, 0], x[:, 1])
    for t in range(most - 2, -1, -1):
        at = first[:-1][order[: live[t + 1]]] + t
        x = move[None] + (emit[at + 1] + beta[at + 1])[:, None, :]
        beta[at] = np.logaddexp(x[:, :, 0], x[:, :, 1])
    rows = np.repeat(np.arange(len(every)), every)
    ends = first[1:] - 1
    z = np.zeros(len(every))
    full = every > 0
    z[full] = np.logaddexp(alpha[ends[full], 0], alpha[ends[full], 1])
    p = np.exp(alpha + beta - z[rows][:, None])
    if not pairs:
        return p, z
    inner = np.ones(len(emit), bool)
    inner[first[:-1][full]] = False
    at = np.flatnonzero(inner)
    joint = np.exp(alpha[at - 1][:, :, None] + move[None] + (emit[at] + beta[at])[:, None, :] - z[rows[at]][:, None, None])
    return p, z, joint.sum(0)


class Field:
    """Fitted weights: features to labels, moves between labels, and the document model."""

    def __init__(self, centre, scale, weights, move, top, constant):
        self.centre, self.scale, self.weights, self.move, self.top, self.constant = centre, scale, weights, move, top, constant

    def good(self, own: np.ndarray, first: np.ndarray) -> np.ndarray:
        """P(good) of each line."""
        x = (beside(own, first) - self.centre) / self.scale
        return marginals(x @ self.weights, self.move, first)[0][:, 1]

    def aggregate(self, own: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Document features from length-weighted marginals."""
        n = len(first) - 1
        out = np.zeros((n, 6))
        out[:, 5] = 1
        out[:, 4] = np.diff(first) == 0
        if len(own):
            good = np.clip(self.good(own, first), 1e-6, 1 - 1e-6)
            rows = np.repeat(np.arange(n), np.diff(first))
            total = np.maximum(np.bincount(rows, size, n), 1)
            out[:, 0] = np.bincount(rows, size * good, n) / total
            out[:, 1] = np.bincount(rows, size * (good < 0.5), n) / total
            worst = np.ones(n)
            np.minimum.at(worst, rows, good)
            out[:, 2] = worst
            out[:, 3] = np.log1p(total) / 5
            out[np.diff(first) == 0, :4] = 0
        return out

    def scores(self, own, size, first) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(first) - 1, self.constant)
        s = 1 / (1 + np.exp(-np.clip(self.aggregate(own, size, first) @ self.top, -30, 30)))
        return s


def _lines_of(texts: list[str]):
    import pyarrow as pa

    data, offsets = buffers(pa.array(texts, pa.large_string()))
    parts = [line_features(data, offsets[i : j + 1]) for i, j in steps(offsets)]
    before = np.cumsum([0, *(len(p[0]) for p in parts)])
    first = [p[2][:-1] + b for p, b in zip(parts, before[:-1], strict=True)]
    own, size = (np.concatenate([z, *(p[k] for p in parts)]) for k, z in ((0, np.zeros((0, OWN), np.float32)), (1, np.zeros(0))))
    return own, size, np.concatenate([*first, before[-1:]]).astype(np.int64)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float, rounds: int = 30) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge * np.eye(x.shape[1])
        w += np.linalg.solve(h, x.T @ (y - p) - ridge * w)
    return w


def _posterior(emit: np.ndarray, move: np.ndarray, first: np.ndarray, size: np.ndarray, y: np.ndarray):
    """Lines' labels and moves expected under the sharpened field, tilted in each document towards its label until the
    expected share of its text that has it is enough."""
    n, rows = len(y), np.repeat(np.arange(len(y)), np.diff(first))
    total, wanted = np.maximum(np.bincount(rows, size, n), 1), np.where(y == 1, GOOD, BAD)
    tilt = np.zeros(n)
    for _ in range(6):
        tilted = SHARP * emit
        tilted[np.arange(len(emit)), y[rows]] += tilt[rows]
        p, _, joint = marginals(tilted, SHARP * move, first, pairs=True)
        short = np.bincount(rows, size * p[np.arange(len(p)), y[rows]], n) / total < wanted
        if not short[np.diff(first) > 0].any():
            break
        tilt[short] = np.maximum(2 * tilt[short], 1.0)
    return p, joint


def fit(rows: list[tuple[str, int]]) -> Field:
    """From (text, quality) rows: the field by expectation and ascent (Adam) in turn, then the document model."""
    rows = sorted(rows)
    y = np.array([r[1] for r in rows], np.int64)
    if len(set(y.tolist())) < 2:
        return Field(None, None, None, None, None, float(y.mean()) if len(y) else 0.5)
    own, size, first = _lines_of([r[0] for r in rows])
    x = beside(own, first).astype(np.float64)
    centre, scale = x.mean(0), x.std(0) + 1e-3
    for k in range(OWN - 1, x.shape[1], OWN):  # constants: is there a line
        centre[k], scale[k] = 0, 1
    x = (x - centre) / scale
    lens = np.diff(first)
    label = np.repeat(y, lens)
    weights, move = np.zeros((x.shape[1], 2)), np.zeros((2, 2))
    # In the first round, all lines of a document have its label, and the lines beside one say nothing of it: else those of
    # a bad document would all be told by the worst of them.
    hot, seen = np.eye(2)[label], None
    n = max(1, len(x))
    state = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(move), np.zeros_like(move)]
    for t in range(1, ROUNDS * FIT_STEPS + 1):
        p, _, joint = marginals(x @ weights, move, first, pairs=True)
        g = (x.T @ (hot - p)) / n - RIDGE * weights
        if seen is None:
            g[OWN:] = 0
        m = np.zeros((2, 2)) if seen is None else (seen - joint) / n - STIFF * move
        for k, (what, grad) in enumerate(((weights, g), (move, m))):
            a, b = state[2 * k], state[2 * k + 1]
            a += 0.1 * (grad - a)
            b += 0.01 * (grad**2 - b)
            what += 0.1 * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-8)
        if t % FIT_STEPS == 0 and t < ROUNDS * FIT_STEPS:
            hot, seen = _posterior(x @ weights, move, first, size, y)
    field = Field(centre, scale, weights, move, None, None)
    docs = field.aggregate(own, size, first)
    # Texts without a line: as fitted to a few of them that EMPTY stands for, and to any there are.
    blank = np.zeros((2, 6))
    blank[:, 4:] = 1
    field.top = _logistic(np.concatenate([docs, blank, blank]), np.concatenate([y, [0, 0, 0, 1 if EMPTY > 0.5 else 0]]).astype(float), 0.05)
    return field


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", accept: float = 0.5, limit: int = LABELLED) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs."""
    field = fit(labelled_sample(docs, labels, label_col, id_col, text_col, limit))
    give_back()

    def run(batches) -> Iterator:
        import pyarrow as pa

        focus("quality_crf")
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            scores = [field.scores(*line_features(data, offsets[i : j + 1])) for i, j in steps(offsets)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate([np.zeros(0), *scores]), pa.float64())], names=["doc_id", "score"])

    scored = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(trimmed(run), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= accept, 1).otherwise(0).alias("predicted"))
