import itertools
import random
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pytest

from docmill.llm import cap_join as caps
from docmill.llm import html_text
from docmill.llm.html_text import extract_text, main_text
from docmill.llm.quality_crf import _lines_of, fit, marginals, score_quality
from docmill.llm import quality_crf
from docmill.llm import token_files as files
from docmill.llm import toxicity
from docmill.llm.token_files import Words, pack, read_documents, read_segment, segment, unpack, write_token_files
from docmill.llm.toxicity import Grammar, learn, score_toxicity, without_toxic

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("high", [1, 2, 300, 50_257, 1 << 31, 1 << 60, 1 << 63])
def test_simple8b_round_trip(high):
    rng = np.random.default_rng(3)
    for n in (0, 1, 59, 1023, 1024, 1025, 4000):
        ids = rng.integers(0, high, n, dtype=np.uint64)
        ids[::3] = rng.integers(0, min(high, 7), len(ids[::3]), dtype=np.uint64)
        words, offsets = pack(ids)
        assert (unpack(words, offsets, n) == ids).all()
        assert (read_segment(segment(ids)) == ids).all()


ODD = ["a  b", "  lead", " x", "x ", "x \n y", "　a b \t\tc", "don't  stop 's it", "<|endoftext|> hi", "", "a\n\n b\r\n  c   ", " \x1c a", "é  ü 日本 語", "plain words here", "long " * 30_000, "end.\nNew don't. it's,\nx\n\ny z'. q'\n's a|b ** |\n* e\u0301. \u00bd, \u3007! _x_ \x85a b\x85. c\u00a0d, \u2028."]


def fresh_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))


ADDED = ["a <|endoftext|> hi", "<|endoftext|>", "a<|endoftext|>b c", "a <|endoftext|", "plain a hi", "<|endoftext|> hi", "a <|end oftext|> b", None]


@pytest.mark.parametrize("room", [0, 5, 400_000])
def test_words_are_encoded_as_whole_texts(room):
    fresh, words = fresh_tokenizer(), Words("byte_bpe_50k.json", room)
    texts = [*ODD, *ADDED, *ODD[::-1]]
    for end in (None, 0):
        ids, lens = words.encode(pa.array(texts, pa.string()), end)
        got = [p.tolist() for p in np.split(ids, np.cumsum(lens)[:-1])]
        assert got == [fresh.encode(t or "", add_special_tokens=False).ids + ([] if end is None else [end]) for t in texts]
    assert fresh.encode("<|endoftext|> hi", add_special_tokens=False).ids == [50256, 23105]
    assert [len(x) for x in words.encode(pa.array([], pa.string()), 0)] == [0, 0]


@pytest.mark.parametrize("segment_ids, step", [(1 << 19, 6_000_000), (7, 40)])
def test_token_files_read_back(spark, monkeypatch, segment_ids, step):
    monkeypatch.setattr(files, "SEGMENT", segment_ids)
    monkeypatch.setattr(files, "STEP", step)
    fresh = fresh_tokenizer()
    rows = [(i * 3 % 17, t, 0) for i, t in enumerate(ODD)] + [(None, "null id", 0), (40, None, 0), (40, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part int").repartition(3)
    got = read_documents(write_token_files(docs)).collect()
    encode = lambda t: [*fresh.encode(t or "", add_special_tokens=False).ids, 0]
    want = sorted(((i, encode(t)) for i, t, _ in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    got = sorted(got, key=lambda r: r.start)
    start = 0
    for r, (i, ids) in zip(got, want, strict=True):
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert read_documents(write_token_files(docs.limit(0))).count() == 0


def test_grammar_scopes():
    g = Grammar({}, {})
    assert g.matches("You are an idiot.")[0] == [("idiot", "J")] == g.matches("An idiot, you")[0]
    assert g.matches("You are not an idiot.")[0] == [] == g.matches("The word idiot comes from Greek.")[0]
    assert g.matches("Critics said the loser cried. Scum!")[0] == [("scum", "I")]
    assert g.matches('He said: "you are scum". You scum')[0] == [("scum", "J")]
    assert g.matches("I will kill you")[0] == [("kill", "V")] and g.matches("kill them")[0] == [("kill", "U")]
    assert g.matches("kill the process")[0] == [] == g.matches("I will not kill you")[0]
    m = learn([])
    plain, aimed, negated, reported = (m.score(t) for t in ("what an idiot", "you idiot there", "not an idiot", "he is said idiot"))
    assert aimed > plain > negated == reported == m.score("nice day today") < 0.1


def brute_marks(words, g):
    """The cascade by its rules, word by word, without machines."""
    out = []
    for i, w in enumerate(words):
        s = g.symbol(w)
        if s not in "IT":
            continue

        def opened(kind, reach, closes, step, i=i):
            j = i + step
            while 0 <= j < len(words) and (reach is None or abs(i - j) <= reach):
                t = g.symbol(words[j])
                if t in kind:
                    return True
                if t in closes:
                    return False
                j += step
            return False

        if opened("N", 3, "ES", -1) or opened("R", None, "E", -1) or opened("R", None, "E", 1):
            continue
        target = opened("Y", 4, "ES", -1) or opened("Y", 4, "ES", 1)
        intends = opened("M", 3, "ES", -1)
        kind = ("J" if target else "I") if s == "I" else ("V" if intends else "U") if target else None
        if kind:
            out.append((w.lower(), kind))
    return out


def test_cascade_against_its_rules():
    rnd, g = random.Random(3), Grammar({}, {})
    pool = ["you", "idiot", "kill", "will", "not", "said", ".", ":", '"', "house", "tree", "the", "scum", "them", "word"]
    for _ in range(4000):
        words = [rnd.choice(pool) for _ in range(rnd.randrange(1, 16))]
        assert g.matches(" ".join(words))[0] == brute_marks(words, g), words


def test_scopes_change_what_is_learned_and_decided():
    rnd = random.Random(9)
    filler = lambda: " ".join(rnd.choice("sun moon river stone field cloud lamp".split()) for _ in range(12))
    bad = ["You are an idiot.", "Shut up you moron.", "They are scum, all of them.", "I will kill you."]
    fine = ["You are not an idiot.", "She said you are a moron.", "The word scum has old roots.", "We will not kill you."]
    rows = [(f"{filler()}. {rnd.choice(bad if k % 3 == 0 else fine)} {filler()}.", int(k % 3 == 0)) for k in range(600)]
    fit, held = rows[:400], rows[400:]
    right = {cancel: [(m.score(t) >= 0.7) == bool(y) for t, y in held] for cancel in (True, False) for m in [learn(fit, cancel)]}
    assert sum(right[True]) >= 0.99 * len(held) and sum(right[False]) < 0.9 * len(held)
    m = learn(fit)
    for text in ("The word idiot comes from Greek.", "You are not an idiot", "He said you are an idiot"):
        assert m.score(text) < 0.7
    assert m.score("You are an idiot") >= 0.7


def test_texts_without_lexicon_words_are_not_looked_at():
    m = learn([])
    texts = ["You are an IDIOT", "nothing here", None, "", "I will KILL you", "nine idiotic", "x" * 1000, "\u017ftupid you"]
    got = m.scores(pa.array(texts, pa.string()))
    assert np.allclose(got, [m.score(t or "") for t in texts])


def test_sample_is_bounded_in_bytes(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 5_000)
    docs = spark.createDataFrame([(i % 40, f"{i} " + "w" * 990) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    rows = toxicity.labelled_sample(docs, labels, "toxic", "doc_id", "text", 1000)
    assert len(rows) == 5 and rows == toxicity.labelled_sample(docs.repartition(5), labels, "toxic", "doc_id", "text", 1000)
    assert len(toxicity.labelled_sample(docs, labels, "toxic", "doc_id", "text", 3)) == 3


def test_learned_stems_and_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    for score, column, least in ((score_toxicity, "toxic", 0.93), (score_quality, "quality", 0.95)):
        out = score(docs, labels).join(labels, "doc_id").where("held_out").collect()
        assert len(out) > 50
        assert sum(r.predicted == r[column] for r in out) / len(out) >= least
    rnd = random.Random(1)
    text = lambda bad: " ".join(rnd.choice("abcdefgh") * 4 for _ in range(60)) + (" zorblig zorbluf" if bad else "")
    m = learn([(text(k % 8 == 0), int(k % 8 == 0)) for k in range(400)])
    assert m.score("aaaa zorblax bbbb zorblat") > 0.7 > m.score("aaaa bbbb cccc")


def test_classifiers_on_odd_rows(spark):
    rows = [(1, None, "l"), (2, "", "l"), (3, "   \n ", "l"), (3, "you idiot", "l"), (None, "you idiot scum", "l"), (9, "word " * 50_000, "l")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string").selectExpr("*", "1 as y", "2 as l_id")
    none = spark.createDataFrame([(None, 1, None), (1, None, 0)], "doc_id long, quality int, toxic int")
    for score in (score_toxicity, score_quality):
        got = score(docs, none).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
        assert score(docs.limit(0), none).count() == 0
        assert [r.held_out for r in got if r.doc_id is None] == [False]
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id)
    kept = without_toxic(docs, none)
    assert kept.columns == docs.columns and sorted((r.doc_id for r in kept.collect()), key=str) == [1, 2, 3, 9]


def test_marginals_against_enumeration():
    rng = np.random.default_rng(0)
    emit, move, first = rng.normal(size=(9, 2)), rng.normal(size=(2, 2)), np.array([0, 4, 4, 5, 9])
    p, z, joint = marginals(emit, move, first, pairs=True)
    pairs = np.zeros((2, 2))
    for r, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
        if a == b:
            continue
        paths = {}
        for code in range(2 ** (b - a)):
            y = [code >> k & 1 for k in range(b - a)]
            paths[tuple(y)] = sum(emit[a + k, v] for k, v in enumerate(y)) + sum(move[u, v] for u, v in zip(y, y[1:], strict=False))
        total = np.logaddexp.reduce(list(paths.values()))
        assert np.isclose(total, z[r])
        for k in range(b - a):
            assert np.isclose(p[a + k, 1], sum(np.exp(s - total) for y, s in paths.items() if y[k]))
        for y, s in paths.items():
            for u, v in zip(y, y[1:], strict=False):
                pairs[u, v] += np.exp(s - total)
    assert np.allclose(pairs, joint)


def test_long_chains_are_scanned_in_blocks(monkeypatch):
    rng = np.random.default_rng(1)
    first = np.array([0, 3, 3, 40, 41, 300, 302])
    emit, move = rng.normal(size=(302, 2)) * 3, rng.normal(size=(2, 2))
    want = marginals(emit, move, first, pairs=True)
    for long in (0, 1, 2, 36):
        monkeypatch.setattr(quality_crf, "LONG", long)
        assert all(np.allclose(a, b) for a, b in zip(want, marginals(emit, move, first, pairs=True), strict=True))


def test_field_separates_line_kinds():
    good, bad = "A fine line of words here.\nAnd one more of them now.", "BUY!! NOW!! BUY!! NOW!!\nBUY!! NOW!! BUY!! NOW!!"
    f = fit([(good + f" w{k}", 1) for k in range(40)] + [(bad + f" W{k}!!", 0) for k in range(40)])
    s = f.scores(*_lines_of([good, bad, ""]))
    assert s[0] > 0.5 > s[1] and s[2] < 0.5


def test_lines_of_bad_documents_keep_their_own_labels():
    rnd = random.Random(2)
    fine = lambda: " ".join(rnd.choice("calm water runs below the old stone bridge at noon".split()) for _ in range(rnd.randrange(7, 12))) + "."
    junk = lambda: " ".join(rnd.choice("BUY!! NOW!! $$$ CLICK!! ###".split()) for _ in range(rnd.randrange(7, 12)))
    kinds = lambda: rnd.sample([True] * 10 + [False] * 10, 20)
    page = lambda k: "\n".join(fine() if good else junk() for good in k)
    rows = [(page([True] * 12), 1) for _ in range(80)] + [(page(kinds()), 0) for _ in range(80)]
    f = fit(rows)
    want = [kinds() for _ in range(30)]
    own, _, first = _lines_of([page(k) for k in want])
    got = f.good(own, first) >= 0.5
    flat = np.concatenate(want)
    assert (~got[~flat]).mean() > 0.99 and got[flat].mean() > 0.7
    assert (f.good(*_lines_of([page([True] * 12)])[::2]) >= 0.5).all()
    assert f.scores(*_lines_of([rows[0][0], rows[-1][0]])).round().tolist() == [1, 0]


def test_moves_decide_where_lines_do_not_tell():
    rnd = random.Random(4)
    plain = lambda: " ".join(rnd.choice("one two three four five six seven".split()) for _ in range(8))
    page = lambda y: "\n".join([("Calm opening of the page here." if y else "BUY!! NOW!! $$$ ### @@@ %%%"), *(plain() for _ in range(9))])
    rows = [(page(k % 2), k % 2) for k in range(300)]
    f = fit(rows[:200])
    own, size, first = _lines_of([t for t, _ in rows[200:]])
    y = np.array([y for _, y in rows[200:]])
    lines, label = f.good(own, first) >= 0.5, np.repeat(y, np.diff(first)) == 1
    assert (lines == label).mean() > 0.95 and ((f.scores(own, size, first) >= 0.5) == y).all()
    mixed, wanted = [], []
    for _ in range(200):  # runs of both kinds, each under its first line
        runs = [(rnd.random() < 0.5, rnd.randrange(1, 12)) for _ in range(3)]
        mixed.append("\n".join("\n".join([("Calm opening of the page here." if g else "BUY!! NOW!! $$$ ### @@@ %%%"), *(plain() for _ in range(n))]) for g, n in runs))
        wanted.append(np.repeat([g for g, _ in runs], [n + 1 for _, n in runs]))
    other = _lines_of(mixed)
    with_moves = ((f.good(other[0], other[2]) >= 0.5) == np.concatenate(wanted)).mean()
    decided = f.scores(*other) >= 0.5
    f.move = np.zeros((2, 2))
    assert ((f.good(own, first) >= 0.5) == label).mean() < 0.8
    without = ((f.good(other[0], other[2]) >= 0.5) == np.concatenate(wanted)).mean()
    assert with_moves > without + 0.05 and (decided != (f.scores(*other) >= 0.5)).sum() >= 10


def test_main_text():
    page = "<html><head><title>T</title><style>p{}</style></head><body><nav><a href=/x>Home</a></nav><div class='ad'>Buy</div><article><header><h1>Head &amp; tail</h1></header><p><b>One\n two<br>three<p>4 &lt; 5 &am<script>var x='</p>'</script></p><div class=\"share-bar\">Tweet</div><ul><li>a<li>b</ul><section id=comments><p>First!</p></section></article><aside>s</aside><footer>&copy; me</footer>"
    assert main_text(page) == "Head & tail\n\nOne two three\n\n4 < 5 &am\n\na\n\nb"
    unmarked = "<body><div><a href=/a>Menu one</a> <a href=/b>two</a></div><p>" + "A long paragraph of text. " * 8 + "</p><p>Short.</p><p>" + "Another long one follows. " * 8 + "</p><form>Sign up <input></form><p>cut <a href='x"
    assert main_text(unmarked).startswith("A long paragraph") and "Short." in main_text(unmarked) and "Menu" not in main_text(unmarked) and "Sign" not in main_text(unmarked)
    assert main_text(None) == main_text("") == main_text("<p></p>") == "" and main_text("a < b") == "a < b"


def test_article_elements_in_furniture_mark_no_article():
    body = "<div>Plain text of the page.</div><p>More of it.</p>"
    for extra in ("<ol class='comment-list'><li><article class='comment-body'><p>First!</p></article></li></ol>", "<aside><article>Teaser</article></aside>"):
        assert main_text(body + extra) == "Plain text of the page.\n\nMore of it."


def test_unmarked_pages_keep_paragraphs_around_a_long_one():
    texts = ["Before.", "Two.", "x" * 10_000, *[str(k) + "y" * 299 for k in range(5)], "After.", "z" * 9_000, "End."]
    page = "".join(f"<p>{t}</p>" for t in texts[:8]) + "<nav>Menu</nav><p><a href=/x>Linked</a></p>" * 4 + "".join(f"<p>{t}</p>" for t in texts[8:])
    assert main_text(page) == "\n\n".join(texts)


def test_self_closed_elements_and_math_lose_no_text():
    for tag in ("<svg/>", "<svg viewBox='0 0 > 1'/>", '<svg class="a" hidden />', "<math/>", "<iframe src='x' />", "<object data=x />", "<canvas/>", "<script src='a.js'/>", "<svg a=/b/ />"):
        assert main_text(f"<article><p>One {tag}two</p><p>three</p></article>") == "One two\n\nthree"
        assert main_text(f"<article><p>One {tag}two</p><svg><text>no</text></svg><script>var x</script><p>three</p></article>") == "One two\n\nthree"
    assert main_text("<article><p>where <math display='block'><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p></article>") == "where x=2 holds"
    assert main_text("<article><p>a<svg><path d='M0'/><text>no</text></svg>b<script src=/js/>var x</script><script src='y'/>var z</script></p></article>") == "ab"


def test_names_of_running_text_in_an_article_drop_nothing():
    for name in ("share-price", "notice-period", "commentary", "promo-code-text", "railway", "rail-history", "search-results-analysis"):
        for tag in ("p", "h2", "blockquote", "div", "section"):
            assert main_text(f'<article><{tag} class="{name}">Stock rose today.</{tag}><p>End.</p></article>') == "Stock rose today.\n\nEnd."
    for name in ("share-bar", "ad", "ads-top", "cookie-notice", "related-links", "comments", "newsletter-signup-box", "comment-12"):
        assert main_text(f'<article><div class="x {name}">Tweet</div><p>End.</p></article>') == "End."
    assert main_text('<article><p class="ad">Buy</p><p><a href="/x">All of it linked</a></p></article>') == "All of it linked"


def test_links_stay_between_paragraphs_and_go_outside_them():
    menu, link = "<div><a href=/a>Menu one</a> <a href=/b>two</a></div>", "<p><a href=/x>A linked line</a></p>"
    page = f"{menu}{menu}<p>First paragraph.</p>{link}<p>Second one.</p>{menu}{menu}{menu}{menu}<p>Third.</p>{menu}"
    assert main_text(page) == "First paragraph.\n\nA linked line\n\nSecond one.\n\nThird."
    adverts = "<div class=ad>Buy</div>" * 4
    assert main_text(f"<p>One.</p>{adverts}<p>Two.</p>") == "One.\n\nTwo."


def test_stretches_against_brute_force(monkeypatch):
    rnd = random.Random(8)
    for reach, surge in ((1, 1), (2, 1), (1, 60), (2, 100)):
        monkeypatch.setattr(html_text, "REACH", reach)
        monkeypatch.setattr(html_text, "SURGE", surge)
        for _ in range(300):
            size = [rnd.choice([0, 0, 0, 5, 40, 200]) for _ in range(rnd.randrange(0, 30))]
            on = [sum(size[max(0, i - reach) : i + reach + 1]) >= surge for i in range(len(size))]
            want = []
            for key, run in itertools.groupby(range(len(size)), key=lambda i, on=on: on[i]):
                lines = [i for i in run if size[i]]
                if key and lines:
                    want.append((lines[0], lines[-1]))
            assert html_text.stretches(size) == want


class Plain(HTMLParser):
    """The text of an article's block elements, by the standard library's parser: for well-formed pages."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.skip, self.out = 0, 0, [""]

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        self.skip += tag in ("script", "style", "nav", "footer", "aside", "title") or dict(attrs).get("class") == "ad"
        self.out.append("") if tag in ("p", "h1", "div", "li", "article") else None
        self.out[-1] += " " * (tag == "br")

    def handle_endtag(self, tag):
        self.depth -= tag == "article"
        self.skip -= tag in ("script", "style", "nav", "footer", "aside", "title", "div")
        self.out.append("") if tag in ("p", "h1", "div", "li", "article") else None

    def handle_data(self, data):
        if self.depth and not self.skip:
            self.out[-1] += data


def test_given_pages_against_another_parser(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r.text for r in extract_text(pages).collect()}
    for r in pages.collect():
        other = Plain()
        other.feed(r.html)
        assert got[r.page_id] == "\n\n".join(t for t in (" ".join(x.split()) for x in other.out) if t), r.page_id


def test_extract_all_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = extract_text(pages).collect()
    assert len(got) == pages.count() and all(r.n_chars == len(r.text) for r in got)
    odd = spark.createDataFrame([(None, None, None, "t"), (1, "u", "<p>x", "t"), (1, "u", "<p>x", "t")], "page_id long, url string, html string, text string")
    assert sorted(r.text for r in extract_text(odd).collect()) == ["", "x", "x"] and extract_text(odd.limit(0)).count() == 0


def brute_links(x, threshold):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    return (unit @ unit.T >= threshold) & ~np.eye(len(x), dtype=bool)


def test_cap_join_recall_at_the_threshold():
    rng = np.random.default_rng(2)
    base = rng.standard_normal((1500, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = rng.standard_normal(base.shape)
    side -= (side * base).sum(1, keepdims=True) * base
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cos = rng.uniform(0.9, 0.92, (1500, 1))
    other = cos * base + np.sqrt(1 - cos**2) * side
    found = {}
    for n in (3_000, 100_000, 1_000_000):
        c = caps.Caps(64, n)
        met = [len(np.intersect1d(a, b)) > 0 for a, b in zip(c.passed(base), c.passed(other), strict=True)]
        found[n] = np.mean(met)
    assert min(found.values()) >= 0.98, found


def test_cap_join_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((300, 16))
    x[100:200] = x[:100] + 0.12 * rng.standard_normal((100, 16))
    x[200:240] = x[0] + 0.02 * rng.standard_normal((40, 16))
    x[240:250] = x[1]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] * 16), (904, [1.0, None]), (None, x[1].tolist()), (905, [float("inf")] * 16), (906, [1.0, 2.0]), (907, [2.0, 4.0]), (908, (3 * x[2]).tolist())]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "0 as n", "vec_id as rep")
    link = brute_links(np.vstack([x, 3 * x[2:3]]), 0.9)
    names = [*range(300), 908]
    comp = list(range(301))
    for _ in range(301):
        comp = [min([comp[i], *(comp[j] for j in np.flatnonzero(link[i]))]) for i in range(301)]
    for block in (2048, 8):
        monkeypatch.setattr(caps, "BLOCK", block)
        got = {r.vec_id: r for r in caps.cap_join(vectors).collect()}
        assert len(got) == len(rows)
        for i, name in enumerate(names):
            assert (got[name].n_links, got[name].component_id) == (link[i].sum(), names[comp[i]]), name
        assert got[906].n_links == 1 and got[907].component_id == 906 and not got[907].kept
        assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in (900, 901, 902, 903, 904, 905))
        assert got[None].n_links == 0 and got[None].component_id is None and not got[None].kept
    assert caps.cap_join(vectors.limit(0)).count() == 0


def test_codes_stay_short():
    rng = np.random.default_rng(3)
    for dim in (1, 2, 3, 5, 8, 64, 768):
        for n in (10, 10_000, 10**8, 10**12):
            c = caps.Caps(dim, n)
            assert c.words <= caps.WORDS and len(c.codes) == c.parts <= dim
        x = rng.standard_normal((40, dim))
        got = caps.Caps(dim, 10**6).passed(x / np.linalg.norm(x, axis=1, keepdims=True))
        assert all(len(g) and g.dtype == np.int64 and (np.diff(g) > 0).all() for g in got)


@pytest.mark.parametrize("dim", [1, 2, 3, 5])
def test_cap_join_in_few_dimensions(spark, monkeypatch, dim):
    monkeypatch.setattr(caps, "BLOCK", 40)
    monkeypatch.setattr(caps, "SLICE", 7)
    rng = np.random.default_rng(dim)
    x = rng.standard_normal((150, dim))
    link = brute_links(x, 0.9)
    got = {r.vec_id: r.n_links for r in caps.cap_join(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    found = sum(got.values()) / max(1, link.sum())
    assert all(got[i] <= link[i].sum() for i in got) and found >= 0.95


def test_stretches_decide_pages_without_an_article(spark, monkeypatch):
    pages = [r.html.replace("<article>", "<div>").replace("</article>", "</div>").replace("<nav>", "<div>").replace("</nav>", "</div>") for r in spark.read.parquet(f"{SF}/pages.parquet").limit(20).collect()]
    texts = [main_text(p) for p in pages]
    monkeypatch.setattr(html_text, "stretches", lambda size: [(0, len(size) - 1)])
    assert all(main_text(p) != t for p, t in zip(pages, texts, strict=True))
