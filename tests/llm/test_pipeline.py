import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline as pipeline

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def lowered(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def near_duplicates(rows):
    """One row of each group of texts that five-word shingles link at 0.8; of rows that share an id, one."""
    def shingles(text):
        w = words(lowered(text))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    known = [(r[0], shingles(r[1])) for r in rows if r[0] is not None]
    root = {i: i for i, _ in known}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, a), (j, b) in itertools.combinations(known, 2):
        if a and b and 5 * len(a & b) >= 4 * len(a | b):
            x, y = sorted((find(i), find(j)))
            root[y] = x
    kept, seen = [], set()
    for r in rows:
        if r[0] is None or (find(r[0]) == r[0] and r[0] not in seen):
            kept.append(r)
            seen.add(r[0])
    return kept


def decontamination(rows, items):
    split = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t)) if w]
    windows = {tuple(w[i : i + 13]) for w in map(split, items) if w for i in range(max(1, len(w) - 12))}
    kept = []
    for r in rows:
        w = split(r[1])
        hit = {k for x in windows for i in range(len(w) - len(x) + 1) if tuple(w[i : i + len(x)]) == x for k in range(i, i + len(x))}
        if not hit or 20 * len(hit) < len(w):
            kept.append(r)
    return kept


def mixing(rows):
    """Each document as often as the mix begins to take it."""
    size = {id(r): len(words(r[1])) for r in rows}
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is None, s))
    total = {s: sum(size[id(r)] for r in rows if r[3] == s) for s in sources}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sources)}
    target, budget, open_ = {}, 1.5 * sum(total.values()), list(sources)
    while open_:
        share = {s: budget * weight[s] / sum(weight[t] for t in open_) for s in open_}
        full = [s for s in open_ if share[s] >= 2 * total[s]]
        if not full:
            target |= share
            break
        for s in full:
            target[s] = 2.0 * total[s]
            budget -= target[s]
            open_.remove(s)
    out = []
    for s in sources:
        name = lambda r: hashlib.md5((str(r[0]) if r[0] is not None else "null " + hashlib.md5((r[1] or "").encode()).hexdigest()).encode()).hexdigest()
        at, take = 0, round(target[s])
        for r in sorted((r for r in rows if r[3] == s), key=lambda r: (name(r), size[id(r)])):
            out += [r for k in range(3) if size[id(r)] and k * total[s] + at < take]
            at += size[id(r)]
    return out


def given(seed):
    rnd = random.Random(seed)
    pool = [f"word{k}" for k in range(900)]
    text = lambda n: " ".join(rnd.choice(pool) for _ in range(n))
    items = [text(30), text(14), "Short Question here"]
    rows = [[i, text(rnd.choice([4, 30, 80, 200])), "en", rnd.choice(["a", "b", "c", None, "d"]), i] for i in range(120)]
    rows += [[200 + i, rows[i][1], "en", "b", 0] for i in range(15)]  # exact copies
    rows += [[300 + i, rows[20 + i][1] + " tail", "en", "hot", 0] for i in range(15)]  # near copies, if long enough
    rows += [[400 + i, text(20) + " " + items[0] + " " + text(20), "en", "a", 0] for i in range(5)]
    rows += [[500, text(900) + " " + items[1], "en", "a", 0], [501, "so a short QUESTION, here", "en", "b", 0]]
    rows += [[600 + i, f"{text(12)}. You are an idiot, you scum. {text(12)}", "en", "c", 0] for i in range(8)]
    rows += [[700, None, None, None, None], [701, "", "en", "a", 0], [702, " \n\t ", "en", "b", 3], [None, text(25), "en", "b", 9], [None, text(26), "en", "c", 9], [703, text(3000), "fr", "a", 1], [0, rows[0][1], "en", "a", 0]]
    return rows, items


def frames(spark, folder, rows, items, extra):
    docs = spark.createDataFrame([tuple(r) for r in rows], COLUMNS).repartition(3)
    if extra:
        docs = docs.selectExpr("*", "'x' as h", "1 as size", "2 as t", "3 as slot", "4 as m_id", "5 as l_id", "6 as rep", "'w' as words", "7 as component_id")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, t) for k, t in enumerate(items)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    labels = [(r[0], 1, int("idiot" in (r[1] or ""))) for r in rows if r[0] is not None and r[0] % 2 == 0]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet")


@pytest.mark.parametrize("extra", [False, True])
def test_stages_and_run_against_brute_force(spark, tmp_path, extra):
    rows, items = given(1)
    docs = frames(spark, tmp_path, rows, items, extra)
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "", str(r[2:]))
    expected = [r for r in rows if "idiot" not in (r[1] or "")]
    steps = [lambda r: [x for x in r if "idiot" not in (x[1] or "")], near_duplicates, lambda r: decontamination(r, items), mixing]
    want, now = rows, docs
    for (name, stage), brute in zip(pipeline.STAGES[:-1], steps, strict=True):
        out = stage(spark, now, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        want = brute(want)
        assert sorted((tuple(r)[:2] for r in now.collect()), key=key) == sorted((tuple(r[:2]) for r in want), key=key), name
    assert len(expected) > len(want) * 0.5
    from tokenizers import Tokenizer
    import public_tokenizers

    fresh = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    coded = [(r[0], [*fresh.encode(r[1] or "", add_special_tokens=False).ids, 0]) for r in want]
    told = sorted(((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, ids in coded), key=str)
    got = pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=str) == told
    got.sort(key=lambda r: r.start)
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])[:-1]]).tolist()
    assert [r.doc_id or -1 for r in got] == sorted(r.doc_id or -1 for r in got)


def test_empty_tables(spark, tmp_path):
    rows, items = given(2)
    frames(spark, tmp_path, rows[:0], items, False)
    assert pipeline.run(spark, str(tmp_path)).count() == 0
    docs = spark.createDataFrame([tuple(r) for r in rows[:9]], COLUMNS)
    none = spark.createDataFrame([], "item_id long, text string")
    none.write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert pipeline.decontamination(spark, docs, f"{tmp_path}/none").count() == 9


def test_stages_are_those_of_the_contract():
    assert [name for name, _ in pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "token_files"]
    assert pipeline.ORACLE_SQL is None
