"""Tokens, page text, classifiers."""

import random

import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings, strategies as st

from weftgraph.llm import bpe, html_text, labelled, quality, toxicity

rng = random.Random(8)


@pytest.fixture(scope="module")
def coder():
    return bpe.WordBpe(bpe.vocabulary())


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    found.no_truncation()
    found.no_padding()
    return found


def test_bpe_every_code_point(coder, library):
    """Each code point between letters, after a mark and before one, is normalised and split as the library does."""
    form, split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(every), 512):
        some = every[at : at + 512]
        text = "".join(f"A{c}b !{c}\u0315 \u0345{c}\u0334" for c in some)
        mine = bpe.normal(text)
        squeeze = lambda t: " ".join(bpe.regex.split(r"\s+", t))
        assert squeeze(mine) == form(text), hex(ord(some[0]))
        sizes = [len(w.encode()) for w in coder._words(mine)]
        assert sizes == [len(w) for w, _ in split(form(text))], hex(ord(some[0]))
        if at % (512 * 37) == 0:
            assert coder.encode(text) == library.encode(text, add_special_tokens=False).ids


LATER = "".join(chr(c) for a, b in (*bpe.LATER, *bpe.UNORDERED) for c in {a, b}) + "".join(chr(a) for a, _, _ in bpe.CAPITALS)


@settings(max_examples=3000, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="aeinrsth'", max_size=80) | st.text(alphabet=LATER + "aAé\u0301\u0323\u0315\u0345\U00011935 :1", max_size=30))
def test_bpe_is_the_library(coder, library, text):
    ids = coder.encode(text)
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert coder.decode(ids).decode() == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["", "   ", "It's the END, isn't it?", "a<|endoftext|>b <|startoftext|>", "ΑΣ Σ İ ẛ̣ ﬁ", "x" * 5000, "\x1c\x85  漢字 ٣ 👨‍👩‍👧"])
def test_bpe_cases(coder, library, text):
    assert coder.encode(text) == library.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="aeinrsth' \n\x1c\u00a0!İΣ", max_size=80))
def test_bpe_counts(coder, text):
    for t in (text, f"{text}<|endoftext|>{text}"):
        assert coder.count(t) == len(coder.encode(t))


def test_bpe_plain_text_is_not_composed(monkeypatch):
    """Symbols below the combining marks, and common dashes and quotation marks, are lower-cased at once: their normal form is their own, also side by side."""
    with monkeypatch.context() as m:
        m.setattr(bpe, "unicodedata", None)
        assert bpe.normal("Größe ŒUVRE – „Ä“ 5 € …") == "größe œuvre – „ä“ 5 € …"
    plain = [chr(c) for c in range(0x110000) if not bpe._COMPOSING.search(chr(c))]
    pairs = "".join(a + b for a in plain for b in plain)
    assert len(plain) > 768 and bpe.unicodedata.normalize("NFC", pairs) == pairs and not any(map(bpe.unicodedata.combining, plain))
    assert not any(ord(c) in bpe._SMALL or bpe._LATER.search(c) or bpe._UNORDERED.search(c) for c in plain)


def test_bpe_words_with_blanks():
    """A split pattern whose words hold blanks: texts are not cut there, and counts are those of the library."""
    import json

    from tokenizers import Tokenizer

    spec = json.loads(bpe.vocabulary())
    spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = r"\p{L}+ \p{L}+|\S"
    other, theirs = bpe.WordBpe(json.dumps(spec)), Tokenizer.from_str(json.dumps(spec))
    for text in ("", "the cat sat on it", "It's a b, c d!", "x<|endoftext|>the end"):
        assert other.count(text) == len(other.encode(text)) and other.encode(text) == theirs.encode(text, add_special_tokens=False).ids


def test_bpe_memory_is_bounded(coder):
    """A full memory forgets what was not used lately, keeps its bound and changes no result; long arguments aren't kept."""
    made = []
    known = bpe.Remembered(lambda w: made.append(w) or len(w), 20)
    for i in range(200):
        assert known["often"] == 5 and known[f"w{i}"] == len(f"w{i}") and known["x" * 100] == 100
        assert len(known) + len(known.older) <= 20 and "x" * 100 not in known
    assert made.count("often") == 1
    text = " ".join(f"Größe{i}, it's the {i % 7}nd" for i in range(300))
    small = bpe.WordBpe(bpe.vocabulary())
    small.counts.half = small.fits.half = 5
    assert small.count(text) == small.count(text) == len(coder.encode(text))


def test_bpe_pieces_are_split_once(library, monkeypatch):
    """Pieces that an encoder remembers cost no further matching, and a memory of a few pieces gives the same ids."""
    text = "It's  the Größe,\n\tof 12 ünd<|endoftext|> it's the\x1cend\u2009of\u3000it. " + "x" * 200 + "!" * 80 + " and " + "y,z" * 50
    ids = library.encode(text, add_special_tokens=False).ids
    mine = bpe.WordBpe(bpe.vocabulary())
    words = text.split("x" * 200)[0]
    first = mine.encode(words)
    monkeypatch.setattr(mine, "_words", None)
    assert mine.encode(words) == first == ids[: len(first)]
    small = bpe.WordBpe(bpe.vocabulary())
    small.cache.half = 3
    assert small.encode(text) == small.encode(text) == ids


def test_bpe_documents(spark, coder):
    rows = spark.createDataFrame([(1, "the cat sat", "x"), (2, None, "y"), (2, "", "y")], "doc_id bigint, text string, ids string")
    got = bpe.encode_documents(rows, with_ids=True).collect()
    assert [r["n_tokens"] for r in got] == [3, 0, 0] and list(got[0]["ids"]) == coder.encode("the cat sat") and got[1]["ids_sha256"] == got[2]["ids_sha256"]
    assert bpe.encode_documents(rows.limit(0)).count() == 0


@pytest.fixture(scope="module")
def model():
    return html_text.train()


def test_blocks_of_unseen_pages(model):
    good = total = 0
    for page in html_text.labelled_pages(100, seed=77):
        order = html_text._order(html_text.parse(page))
        html_text._sum_up(order)
        p, known = model.marginals(order), {}
        for node in order:
            own = [a or b or c for name, a, b, c in html_text._ATTRIBUTE.findall(node.attrs) if name == html_text.LABEL]
            known[id(node)] = int(own[0]) if own else known.get(id(node.parent), 0)
            if node.text is not None:
                total += 1
                good += (p[id(node)] >= 0.5) == bool(known[id(node)])
    assert good / total > 0.97


def test_marginals_are_exact(model):
    """Against the sum over all labellings of a small tree."""
    import math
    from itertools import product

    order = html_text._order(html_text.parse("<div class=content><p>Some text, here.</p><p><a href=x>link</a></p></div>"))
    html_text._sum_up(order)
    got, weights = model.marginals(order), {}
    odds = [model.log_odds(n) for n in order]
    at = {id(n): i for i, n in enumerate(order)}
    for ys in product((0, 1), repeat=len(order)):
        if ys[0]:
            continue
        w = 1.0
        for i, n in enumerate(order):
            x = 1 / (1 + math.exp(-max(-30, min(30, odds[i]))))
            w *= 1.0 if i == 0 else (x if ys[i] else 1 - x)
            if n.parent is not None:
                w *= model._edge.get(html_text.KINDS.get(n.tag, "other"), model._edge["other"])[ys[at[id(n.parent)]]][ys[i]]
        weights[ys] = w
    total = sum(weights.values())
    for i, n in enumerate(order):
        assert abs(got[id(n)] - sum(w for ys, w in weights.items() if ys[i]) / total) < 1e-9


PAGE = """<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- ad --><div class="ad">Buy this now.</div>
<article><h1>Head&amp;line</h1><p><b>First  &lt;par&gt;,<br>text goes on for a while here.<p>Second one\n is here, with some more words.</p></article><footer>&copy; foot</footer></body></html>"""


def test_page(model):
    assert model.extract(PAGE) == "Head&line\n\nFirst <par>, text goes on for a while here.\n\nSecond one is here, with some more words."
    assert model.extract(PAGE[: PAGE.index(" with some")]).endswith("Second one is here,")


@pytest.mark.parametrize("page", ["", "<", "<p", "<article><p>x", "</p></p>", "<" * 1000, "<a " * 3000, "<!-- open", "<script>open", "<article>" + "<div>" * 500 + "x"])
def test_broken_pages(model, page):
    assert isinstance(model.extract(page), str)


@pytest.mark.parametrize(
    ("inner", "text"),
    [
        ("Click <button>Send</button>me, please. <label>Name</label>After.", "Click me, please. After."), ("One <svg><svg>x</svg>y</svg>two, three.", "One two, three."), ("Sum <math><mi>a</mi>+<mi>b</mi></math> is here, so.", "Sum a+b is here, so."),
        ("Pick <select><option>a<option>b</select>one of them.", "Pick one of them."), ("Open <svg> never closes, so this stays.", "Open never closes, so this stays."), ("Code<textarea>x</p>y</textarea> and more, then.", "Code and more, then."), ("A<a href=x>b <a href=y>c</a>d, e.", "Ab cd, e."),
    ],
)
def test_controls_and_hidden_elements(model, inner, text):
    page = f"<html><body><nav><a href=/>Menu</a></nav><article><h1>Head line</h1><p>{inner}</p><p>Second one is here, with some more words.</p></article></body></html>"
    assert model.extract(page) == f"Head line\n\n{text}\n\nSecond one is here, with some more words."


HOSTILE = ["<b>" * 400_000, "<div>x</q7>" * 150_000, "<ul><li>" + "<div>" * 100_000 + "<li></li>" * 100_000, "<li><ul>" + "<div>" * 100_000 + "<li></li>" * 100_000, "<table>" * 50_000 + "<tr><td>x" * 50_000, "<svg>" * 300_000, "<a href=x>y" * 200_000, "<p>x" * 300_000 + "</div>" * 100_000]


@pytest.mark.parametrize("at", range(len(HOSTILE)))
def test_hostile_pages_are_linear(at):
    """Pages of a megabyte or more take seconds, not minutes."""
    import time

    began = time.process_time()
    html_text.parse(HOSTILE[at])
    assert time.process_time() - began < 30


def test_repeated_pages(spark):
    rows = spark.createDataFrame([(7, "u", PAGE)] * 5, "page_id bigint, url string, html string")
    assert html_text.extract_pages(rows).distinct().count() == 1 and html_text.extract_pages(rows).count() == 5


def test_pages_table(spark):
    rows = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "y"), (None, "u", "", "z")], "page_id bigint, url string, html string, text string")
    got = {r["page_id"]: r for r in html_text.extract_pages(rows).collect()}
    assert got[1]["n_chars"] == len(got[1]["text"]) > 50 and got[2]["text"] == "" and got[None]["n_chars"] == 0
    assert html_text.extract_pages(rows.limit(0)).count() == 0


def prose(n, extra=()):
    ws = ["".join(rng.choice("ta re mi so lu ven dor kel par ish".split()) for _ in range(rng.randint(1, 3))) for _ in range(n)]
    for e in extra:
        ws.insert(rng.randrange(len(ws)), e)
    return " ".join(ws) + "."


def test_toxicity(spark):
    bad = ["stupidhead", "wretchling", "fooloaf"]
    toxic, clean = [prose(60, rng.sample(bad, 2)) for _ in range(160)], [prose(60) for _ in range(320)]
    model = toxicity.train(toxic[:120], clean[:240])
    assert sum(model.score(t) >= 0.3 for t in toxic[120:]) >= 38 and sum(model.score(t) >= 0.3 for t in clean[240:]) <= 4
    assert model.score("") <= model.score(toxic[0]) and 0 <= model.score("x" * 100_000) <= 1
    rows = spark.createDataFrame([(1, toxic[0], "a"), (2, None, "b"), (3, clean[0], "c"), (3, clean[0], "c")], "doc_id bigint, text string, score string")
    got = toxicity.score(rows, model)
    assert got.count() == 4 and toxicity.keep(rows, model).count() == 3 and toxicity.keep(rows, model).columns == rows.columns
    assert toxicity.score(rows.limit(0), model).count() == 0
    assert toxicity.train([], clean).score(toxic[0]) == 0.0


def test_quality(spark):
    junk = [lambda: " ".join([prose(1)] * 40), lambda: " | ".join(prose(1) for _ in range(30)), lambda: " ".join(prose(1) + "%%%" for _ in range(40))]
    good = [prose(80) for _ in range(400)]
    mixed = [prose(80) if rng.random() < 0.8 else rng.choice(junk)() for _ in range(500)]
    model = quality.train(good, mixed)
    assert 0.65 < model.prior < 0.95
    score = lambda texts: model.scores(quality.np.array([quality.features(t) for t in texts]))
    assert (score([prose(80) for _ in range(200)]) >= 0.7).mean() > 0.95 and (score([rng.choice(junk)() for _ in range(200)]) >= 0.7).mean() < 0.05
    rows = spark.createDataFrame([(1, good[0], "a"), (2, None, "b"), (3, junk[0](), "c")], "doc_id bigint, text string, score string")
    assert quality.score(rows, model).count() == 3 and quality.keep(rows, model).where("doc_id = 3").count() == 0
    assert quality.train([], mixed).scores(quality.np.array([quality.features("x")]))[0] < 0.01


def test_quality_needs_unlabelled_rows(spark):
    """Labels on every row: rows with hidden labels are the contrast. Positives alone leave none; that is an error."""
    docs = spark.createDataFrame([(i, prose(40) if i % 2 else "x x x x x x x x x x " + prose(1)) for i in range(200)], "doc_id bigint, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality")
    with pytest.raises(ValueError, match="no unlabelled text"):
        quality.fit(docs, labels.withColumn("quality", F.lit(1)))
    kept = {r["doc_id"] for r in quality.keep(docs, quality.fit(docs, labels)).collect()}
    assert sum(i % 2 for i in kept) >= 95 and sum(1 - i % 2 for i in kept) <= 5
    assert quality.fit(docs, labels.where("doc_id < 20")) and quality.fit(docs.limit(0), labels)


def test_toxicity_soft_marks(spark):
    """Marks are stems with any ending, which ordinary text holds now and then: their rate decides, not one word."""
    sounds = "ta re mi so lu ven dor kel par ish on ga".split()
    word = lambda: "".join(rng.choice(sounds) for _ in range(rng.randint(1, 4)))
    def text(n, marks):
        ws = [word() for _ in range(n)]
        for _ in range(marks):
            ws.insert(rng.randrange(len(ws)), "ishdorven" + rng.choice(sounds))
        return " ".join(ws)
    toxic, clean = [text(200, 5) for _ in range(160)], [text(200, rng.random() < 0.1) for _ in range(480)]
    model = toxicity.train(toxic[:120], clean[:360])
    assert sum(model.score(t) >= 0.3 for t in toxic[120:]) >= 36 and sum(model.score(t) >= 0.3 for t in clean[360:]) <= 18
    long = text(20_000, 10)
    assert model.score(long) < 0.3 and toxicity.windows("a" * 100) == ["a" * 48, "a" * 48, "a" * 48, "a" * 28]


def test_toxicity_windows_are_scored_once(monkeypatch):
    """A text is cut once for both models, known windows aren't compressed again, chunks and a small memory change no score."""
    import pickle

    import zstandard

    toxic, clean = [prose(60, ["stupidhead", "wretchling"]) for _ in range(120)], [prose(60) for _ in range(240)]
    model = toxicity.train(toxic, clean)
    texts = [*toxic[:20], "", prose(400) + " é" + "x" * 200, *clean[:20], toxic[0]]
    code, want, windows, cuts = toxicity.PairCode(), [], toxicity.windows, []
    monkeypatch.setattr(toxicity, "windows", lambda t: cuts.append(t) or windows(t))
    scores = [model.score(t) for t in texts]
    assert len(model.members) == 2 and cuts == texts
    for t in texts:  # window by window, without any memory
        each = []
        for m in model.members:
            by = [zstandard.ZstdCompressor(level=toxicity.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False) for d in (m.ordinary, m.toxic)]
            bins = [0] * toxicity.BINS
            for w in windows(t):
                plain, marked = (len(c.compress(code(w))) for c in by)
                bins[min(toxicity.BINS - 1, max(0, plain - marked) // toxicity.BIN)] += 1
            each.append(bins)
        want.append(each)
    assert model.bins(texts) == want and any(sum(b[1:]) for each in want for b in each)
    with monkeypatch.context() as known:
        known.setattr(toxicity.CompressionModel, "margins", None)
        assert model.scores(texts) == scores
    packed = pickle.dumps(model)
    monkeypatch.setattr(toxicity, "CACHE", 20)
    monkeypatch.setattr(toxicity, "CHUNK", 30)
    small = pickle.loads(packed)
    assert small.bins(texts) == small.bins(texts[::-1])[::-1] == want and small.scores(texts) == scores
    assert len(small._known) + len(small._older) <= 20 + 4 * 30
    assert toxicity.NOTHING.scores(["a", ""]) == pickle.loads(pickle.dumps(toxicity.NOTHING)).scores(["a", ""]) == [0.0, 0.0]


def test_held_out_rows(spark):
    """held_out and predicted are what the contract says, ids that are null or no numbers included."""
    import zlib

    rows = spark.createDataFrame([(i, "t") for i in range(50)] + [(None, None)], "doc_id bigint, text string")
    for got in (toxicity.score(rows, toxicity.NOTHING), quality.score(rows, quality.train([prose(9)], []))):
        for r in got.collect():
            assert r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 4 == 2)
            assert 0 <= r["score"] <= 1 and r["predicted"] in (0, 1)


def test_folds(spark):
    import zlib

    docs = spark.createDataFrame([(i, f"t{i}") for i in range(400)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)] + [(None, 1), (1, None)], "doc_id bigint, quality int")
    got = labelled.samples(docs, labels, "quality", {0: 1000, 1: 50})
    learnt = {int(t[1:]) for ts in got.values() for t in ts}
    assert len(got[1]) == 50 and not any(zlib.crc32(str(i).encode()) % 4 == 2 for i in learnt)
    assert {int(t[1:]) for t in labelled.unlabelled(docs, labels, 1000)} == {i for i in range(300, 400) if zlib.crc32(str(i).encode()) % 4 != 2}
