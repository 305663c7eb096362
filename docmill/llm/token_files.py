"""Token ids in Simple-8b files: word-aligned coding with escapes and per-block offsets.

A 64-bit word holds a 4-bit selector and 60 data bits: as many ids as fit at one of fourteen widths. An id of more than
60 bits is an escape: selector 0, then the id in a word of its own. Ids are packed in blocks of BLOCK; the offset of each
block's first word is stored, so all words of a segment decode together, selector by selector.

A segment is `S8B1`, then little-endian: ids a block (u32), blocks (u32), ids (u64), blocks + 1 word offsets (u64), words
(u64). Segments are rows of Parquet files (written by Spark's commit protocol, so a lost or repeated task leaves no
half file), with the document ids and lengths that they hold and their place (part, seq) in ascending order of ids.

Defined cases: null text is empty and is its end id alone; null document ids come first; rows that share an id are all
kept, in the order of their texts' hashes; an empty table gives no segment and no row; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import buffers, focus, mix, powers, release, remember, small_side, steps, table, trimmed

#: Ids of a block; ids after which a segment is closed; distinct words whose ids a worker remembers; new words of a line
#: for the tokenizer; bytes of words hashed at once; bytes of text of a step.
BLOCK, SEGMENT, REMEMBER, LINE, KEYS, STEP = 1024, 1 << 19, 1_200_000, 256, 1 << 18, 4_000_000
#: Ids a word by selector, and their widths; selector 0 is the escape.
COUNTS = (1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
WIDTHS = (0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
MAGIC = b"S8B1"


# The code -------------------------------------------------------------------------------------------------------


_SHORT = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.uint8)


def _widths(ids: np.ndarray) -> np.ndarray:
    """Bits of each id."""
    if int(ids.max(initial=0)) < len(_SHORT):
        return _SHORT[ids]
    out = np.zeros(len(ids), np.uint8)
    small = ids < (1 << 52)
    out[small] = np.frexp(ids[small].astype(np.float64))[1]
    for i in np.flatnonzero(~small):
        out[i] = int(ids[i]).bit_length()
    return out


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, block offsets) of uint64 ids."""
    ids = np.ascontiguousarray(ids, np.uint64)
    blocks = -(-len(ids) // BLOCK)
    padded = np.zeros(blocks * BLOCK + 64, np.uint64)
    padded[: len(ids)] = ids
    wide = _widths(padded)
    grid = np.zeros((blocks, BLOCK + 64), np.uint8)  # past a block's end, anything fits
    grid[:, :BLOCK] = wide[: blocks * BLOCK].reshape(blocks, BLOCK)
    # If more ids fit at a narrower width, fewer fit at a wider one: how many selectors fit tells the best, 0 if none does.
    best = np.zeros((blocks, BLOCK), np.uint8)
    reach, span = grid, 1
    for n in (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60):  # the widest of the next n, from that of fewer
        while span < n:
            step = min(n - span, span)
            reach = np.maximum(reach[:, : reach.shape[1] - step], reach[:, step:])
            span += step
        best += reach[:, :BLOCK] <= WIDTHS[COUNTS.index(n, 1)]
    best = np.where(best == 0, 0, 15 - best).astype(np.uint8)
    takes = np.array(COUNTS, np.int64)[best]
    # Walk all blocks side by side.
    base, live = np.arange(blocks) * BLOCK, np.arange(blocks)
    limit = np.minimum(BLOCK, len(ids) - base)
    at = np.zeros(blocks, np.int64)
    used = np.zeros((blocks, BLOCK), bool)
    while len(live):
        used[live, at[live]] = True
        at[live] += takes[live, at[live]]
        live = live[at[live] < limit[live]]
    rows, cols = np.nonzero(used)
    chosen, start = best[rows, cols], rows * (BLOCK + 64) + cols
    spaced = np.zeros((blocks, BLOCK + 64), np.uint64)  # past a block's end, zeros
    spaced[:, :BLOCK] = padded[: blocks * BLOCK].reshape(blocks, BLOCK)
    flat = spaced.reshape(-1)
    room = np.where(chosen == 0, 2, 1)
    place = np.concatenate([[0], np.cumsum(room)])
    words = np.zeros(int(place[-1]), np.uint64)
    for s in range(15):
        own = np.flatnonzero(chosen == s)
        if not len(own):
            continue
        if s == 0:
            words[place[own] + 1] = flat[start[own]]
            continue
        n, width = COUNTS[s], WIDTHS[s]
        first = start[own]
        word = np.full(len(own), np.uint64(s) << np.uint64(60))
        for k in range(n):
            word |= flat[first + k] << np.uint64(k * width)
        words[place[own]] = word
    per_block = np.bincount(rows, weights=room, minlength=blocks).astype(np.uint64)
    return words, np.concatenate([[np.uint64(0)], np.cumsum(per_block, dtype=np.uint64)])


def unpack(words: np.ndarray, offsets: np.ndarray, total: int) -> np.ndarray:
    """The ids of pack()'s words, all selectors at once."""
    if not total:
        return np.zeros(0, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    head = np.ones(len(words), bool)
    for i in np.flatnonzero(selector == 0):  # what follows an escape is no head
        if head[i]:
            head[i + 1] = False
    index = np.flatnonzero(head)
    chosen = selector[index]
    takes = np.array(COUNTS, np.int64)[chosen]
    block = np.searchsorted(offsets, index.astype(np.uint64), "right") - 1
    before = np.cumsum(takes) - takes
    first = np.searchsorted(block, np.arange(len(offsets) - 1))
    start = before - before[first][block] + block * (BLOCK + 64)  # a block's last word may run on
    out = np.zeros((len(offsets) - 1) * (BLOCK + 64), np.uint64)
    for s in range(15):
        own = np.flatnonzero(chosen == s)
        if not len(own):
            continue
        if s == 0:
            out[start[own]] = words[index[own] + 1]
            continue
        mask, to, data = np.uint64((1 << WIDTHS[s]) - 1), start[own], words[index[own]]
        for k in range(COUNTS[s]):
            out[to + k] = (data >> np.uint64(k * WIDTHS[s])) & mask
    return out.reshape(-1, BLOCK + 64)[:, :BLOCK].reshape(-1)[:total]


def segment(ids: np.ndarray) -> bytes:
    words, offsets = pack(ids)
    head = np.array([BLOCK, len(offsets) - 1], "<u4").tobytes() + np.array([len(ids)], "<u8").tobytes()
    return MAGIC + head + offsets.astype("<u8").tobytes() + words.astype("<u8").tobytes()


def read_segment(data: bytes) -> np.ndarray:
    if data[:4] != MAGIC:
        raise ValueError("not a Simple-8b segment")
    (size, blocks), (total,) = np.frombuffer(data, "<u4", 2, 4), np.frombuffer(data, "<u8", 1, 12)
    if size != BLOCK:
        raise ValueError(f"blocks of {size} ids")
    offsets = np.frombuffer(data, "<u8", int(blocks) + 1, 20)
    return unpack(np.frombuffer(data, "<u8", -1, 20 + offsets.nbytes), offsets, int(total))


# The tokenizer --------------------------------------------------------------------------------------------------

_loaded: dict[str, Words] = {}


class Known:
    """Ids by word, for up to room words: arrays sorted by the first of two 64-bit hashes of a word, found when both agree."""

    def __init__(self, room: int):
        self.room = room
        self.first, self.second = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.flat = np.zeros(0, "<u4")

    def find(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Places of words, -1 for those not held."""
        if not len(self.first):
            return np.full(len(first), -1)
        at = np.minimum(np.searchsorted(self.first, first), len(self.first) - 1)
        return np.where((self.first[at] == first) & (self.second[at] == second), at, -1)

    def add(self, first: np.ndarray, second: np.ndarray, size: np.ndarray, flat: np.ndarray) -> None:
        if len(self.first) + len(first) > self.room:
            return
        start = len(self.flat) + np.cumsum(size) - size
        order = np.argsort(np.concatenate([self.first, first]), kind="stable")
        self.first, self.second, self.start, self.size = (np.concatenate(x)[order] for x in ((self.first, first), (self.second, second), (self.start, start), (self.size, size.astype(np.int32))))
        self.flat = np.concatenate([self.flat, flat])


def word_keys(words) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each word of an Arrow column."""
    data, offsets = buffers(words)
    one, two = np.zeros(len(offsets) - 1, np.uint64), np.zeros(len(offsets) - 1, np.uint64)
    for i, j in steps(offsets, KEYS):
        bounds = offsets[i : j + 1] - offsets[i]
        raw = data[offsets[i] : offsets[j]].astype(np.uint64) + np.uint64(1)
        at, size = bounds[:-1], np.diff(bounds).astype(np.uint64)
        for k, (out, odd) in enumerate(((one, 0x9E3779B97F4A7C15), (two, 0xC2B2AE3D27D4EB4F))):
            up, down = powers(max(KEYS, 1 << len(raw).bit_length()), k)
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(raw * up[: len(raw)])])
            out[i:j] = mix((total[bounds[1:]] - total[at]) * down[at] + size * np.uint64(odd))
    return one, two


class Words:
    """A byte-level BPE tokenizer that encodes each distinct word of a step once.

    Its pre-tokenizer starts a new piece at every blank that a non-blank follows, so a text's ids are those of its
    blank-led pieces, joined. A step's pieces are numbered by Arrow, the ids of each different one are looked up or made,
    and all texts are put together by index. Texts that hold an added token, or a blank that white space or the end
    follows, are encoded whole.
    """

    def __init__(self, vocabulary: str, room: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if not os.path.exists(vocabulary):
            import public_tokenizers

            vocabulary = public_tokenizers.path(vocabulary)
        self.tokenizer = Tokenizer.from_file(str(vocabulary))
        names = self.tokenizer.get_vocab()
        self.begins = np.zeros(max(names.values()) + 1, bool)
        self.begins[[i for k, i in names.items() if k.startswith("Ġ")]] = True
        self.known = Known(room)
        self.room = room
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def plain(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of texts encoded whole."""
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def pieces(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of ids, ids) of words, each with a blank before it. They go to the tokenizer in lines, whose ids part
        where a piece begins with a blank; a line that parts otherwise goes word by word."""
        groups = [words[i : i + LINE] for i in range(0, len(words), LINE)]
        sizes, flat = [np.zeros(0, np.int64)], [np.zeros(0, "<u4")]
        for group, ids in zip(groups, self.plain([" " + " ".join(g) for g in groups]), strict=True):
            at = np.flatnonzero(self.begins[ids])
            if len(at) == len(group) and at[0] == 0:
                sizes.append(np.diff(at, append=len(ids)))
                flat.append(ids)
            else:
                parts = self.plain([" " + w for w in group])
                sizes.append(np.array([len(p) for p in parts]))
                flat += parts
        return np.concatenate(sizes), np.concatenate(flat)

    def encode(self, texts, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of an Arrow string column's texts, each followed by the end id if one is given, and their numbers."""
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        n = len(texts)
        if not n:
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        split = pc.split_pattern(texts, " ")
        bounds = split.offsets.to_numpy().astype(np.int64)
        bounds = bounds - bounds[0]
        first, each = bounds[:-1], np.diff(bounds)
        coded = pc.dictionary_encode(split.flatten())
        words, codes = coded.dictionary, coded.indices.to_numpy().astype(np.int32)
        whole = np.zeros(n, bool)
        for token in self.added:
            whole |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        odd = pc.or_(pc.equal(words, ""), pc.utf8_is_space(pc.utf8_slice_codeunits(words, 0, 1))).to_numpy(zero_copy_only=False)
        if odd.any():
            inner = odd[codes]
            inner[first] = False  # a head has no blank before it
            whole |= np.add.reduceat(inner.astype(np.int32), first) > 0
        heads, at = np.unique(codes[first], return_inverse=True)
        rows = np.flatnonzero(whole)
        codes[first] = len(words) + at  # heads are numbered apart from the same words elsewhere
        codes[first[rows]] = len(words) + len(heads) + np.arange(len(rows))
        row = np.repeat(np.arange(n, dtype=np.int32), each)
        if len(rows):
            keep = ~np.repeat(whole, each)
            keep[first] = True
            codes, row = codes[keep], row[keep]
        # Where the ids of each number begin, and how many they are.
        one, two = word_keys(words)
        place = self.known.find(one, two)
        held = place >= 0
        lost = ~held
        if len(rows):
            used = np.zeros(len(words), bool)
            used[codes[codes < len(words)]] = True
            lost &= used
        lost = np.flatnonzero(lost & ~odd)
        sizes, flat = self.pieces(words.take(pa.array(lost)).to_pylist())
        rest = [*self.plain(words.take(pa.array(heads)).to_pylist()), *self.plain(texts.take(pa.array(rows)).to_pylist()), np.array([] if end is None else [end], "<u4")]
        numbers = len(words) + len(rest)
        start, size = np.zeros(numbers, np.int64), np.zeros(numbers, np.int64)
        start[: len(words)][held], size[: len(words)][held] = self.known.start[place[held]], self.known.size[place[held]]
        start[lost], size[lost] = len(self.known.flat) + np.cumsum(sizes) - sizes, sizes
        size[len(words) :] = [len(r) for r in rest]
        start[len(words) :] = len(self.known.flat) + len(flat) + np.cumsum(size[len(words) :]) - size[len(words) :]
        every = np.concatenate([self.known.flat, flat, *rest])
        self.known.add(one[lost], two[lost], sizes, flat)
        # The numbers of all texts in turn, an end after each, and their ids.
        sequence = np.full(len(codes) + n, numbers - 1, np.int32)
        sequence[np.arange(len(codes)) + row] = codes
        took = size[sequence]
        to = np.cumsum(took)
        index = np.repeat(start[sequence] - to + took, took)
        index += np.arange(len(index))
        begins = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n) + 1)[:-1]])
        return every[index], np.add.reduceat(took, begins)


remember("token_files", _loaded.clear)


def tokenizer(vocabulary: str, room: int = REMEMBER) -> Words:
    if vocabulary not in _loaded or _loaded[vocabulary].room != room:
        _loaded[vocabulary] = Words(vocabulary, room)
    return _loaded[vocabulary]


# The files ------------------------------------------------------------------------------------------------------


def encode_segments(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, room: int = REMEMBER, step: int = STEP) -> DataFrame:
    """(part, seq, ids, lens, total, data): the segments of docs in ascending order of their ids."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        focus("token_files")
        words = tokenizer(vocabulary, room)
        part, seq = TaskContext.get().partitionId(), 0
        held, names, sizes, size = [], [], [], 0

        def close():
            cells = [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([names], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([size], pa.int64()), pa.array([segment(np.concatenate(held))], pa.binary())]
            return pa.RecordBatch.from_arrays(cells, names=["part", "seq", "ids", "lens", "total", "data"])

        for batch in batches:
            _, offsets = buffers(batch.column(1))
            for i, j in steps(offsets, step):
                ids, lens = words.encode(batch.column(1).slice(i, j - i), end_id)
                ends = np.cumsum(lens)
                at = done = 0
                while at < len(lens):  # documents up to where the segment is full
                    to = min(len(lens), int(np.searchsorted(ends, done + SEGMENT - size)) + 1)
                    held.append(ids[done : ends[to - 1]])
                    names += batch.column(0).slice(i + at, to - at).to_pylist()
                    sizes += lens[at:to].tolist()
                    size += int(ends[to - 1]) - done
                    at, done = to, int(ends[to - 1])
                    if size >= SEGMENT:
                        yield close()
                        held, names, sizes, size, seq = [], [], [], 0, seq + 1
            release()
        if names:
            yield close()

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("h")]  # the hash parts rows of one id
    ordered = plain.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    return ordered.mapInArrow(trimmed(run), "part int, seq int, ids array<long>, lens array<long>, total long, data binary")


def read_documents(segments: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of the files, decoded."""
    totals = segments.groupBy("part").agg(F.sum("total").alias("n"))
    totals = totals.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))  # a row a partition
    inside = segments.select("part", "seq", F.coalesce(F.sum("total").over(W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("inside"))
    bases = inside.join(small_side(totals), "part").select("part", "seq", (F.col("base") + F.col("inside")).alias("base"))

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                names, lens, base = (batch.column(k)[i].as_py() for k in ("ids", "lens", "base"))
                ids = read_segment(batch.column("data")[i].as_py()).astype("<u4")
                ends = np.cumsum(lens)
                starts = ends - lens
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(base + starts, pa.int64()), pa.array(lens, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return segments.join(small_side(bases), ["part", "seq"]).select("ids", "lens", "base", "data").mapInArrow(trimmed(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_token_files(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, room: int = REMEMBER, step: int = STEP) -> DataFrame:
    """Write docs' ids to files in the shared folder; the files, as a DataFrame of segments."""
    return table(encode_segments(docs, vocabulary, id_col, text_col, end_id, room, step), "token-files")
