import collections
import hashlib
import math
import re
import time
import zlib

import numpy as np
import pytest

from leafquarry.llm import bpe, html_text, jpeg, ngram_lm, quality, secrets, toxicity

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string"
ODD = [(1, None), (2, ""), (None, "no id here"), (4, "same text"), (4, "same text"), (5, "word " * 40_000), (6, "é 😀\n\t x"), (7, "A <|endoftext|> b")]


def table(spark, rows):
    return spark.createDataFrame([(d, t, None, "s", 0, "x") for d, t in rows], SCHEMA)


def labelled(spark, good, bad, label, n=240):
    rng = np.random.default_rng(2)
    words = ["the", "stone", "river", "of", "light", "and", "house", "is"]
    rows = []
    for i in range(n):
        body = [str(rng.choice(words)) for _ in range(30)]
        rows.append((i, (bad if i % 4 == 0 else good)(body, rng), int(i % 4 != 0) if label == "quality" else int(i % 4 == 0)))
    docs = table(spark, [(i, t) for i, t, _ in rows])
    marks = spark.createDataFrame([(i, y, y) for i, _, y in rows] + [(None, 1, 1), (9999, None, None)], "doc_id bigint, quality int, toxic int")
    return docs, marks, {i: y for i, _, y in rows}


def test_toxicity_learns_stems(spark):
    def bad(body, rng):
        return " ".join([*body[:15], "grok" + "".join(rng.choice(list("abcdefgh"), 3)), *body[15:]])

    docs, marks, truth = labelled(spark, lambda b, r: " ".join(b), bad, "toxic")
    model = toxicity.fit(docs, marks)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == truth[i] for i in held]) > 0.95
    kept = toxicity.keep_clean(docs, marks)
    assert kept.columns == docs.columns and 150 <= kept.count() <= 200
    odd = toxicity.score(table(spark, ODD), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 for r in odd)
    assert toxicity.score(table(spark, []), model).count() == 0
    none = toxicity.fit(docs, marks.where("toxic = 0"))
    assert none is None and {r.score for r in toxicity.score(docs, none).collect()} == {0.0}


def test_toxicity_blocks_agree():
    model = toxicity.train([f"a b grok{i} c" for i in range(9)] + ["a b c d"] * 9, [1] * 9 + [0] * 9)
    scorer = toxicity.Scorer(model)
    text = " ".join(f"w{i % 50}" for i in range(70_000)) + " grokx"
    words = toxicity.words_of(text)
    whole = toxicity.pooled(scorer.memory[scorer.ids(words)], model.bias) if (scorer.ids(words) >= 0).all() else None
    assert scorer.logit(text)[0] == pytest.approx(float(whole @ model.out[:-1] + model.out[-1]), rel=1e-4)


def test_quality(spark):
    docs, marks, truth = labelled(spark, lambda b, r: " ".join(b), lambda b, r: " ".join(w.upper() + "!!" for w in b), "quality")
    model = quality.fit(docs, marks)
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(got[i] >= 0.5) == truth[i] for i in held]) > 0.95
    assert len(quality.score(table(spark, ODD), model).collect()) == len(ODD)
    assert quality.score(table(spark, []), model).count() == 0
    assert quality.train([], []).probability(np.zeros(0, np.int64)) == pytest.approx(0.5)


def brute_base(text):
    found = []
    pattern = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found += [(m.start(), 0, m.end()) for m in re.finditer(pattern, text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found)


def test_secrets(spark):
    key = "Zk3Vq9XwT7uPb2LmN8sRc4Yd"
    texts = [
        f'é😀 token = "{"ab12" * 10}" and AKIA{"Q1" * 8} AKIAAKIA1',
        "PASSWD:short api-key=zzzzzzzzz ApiKey='abcdefgh' api_key  :  x.y.z.w.v",
        f"Authorization: Bearer {key} end",
        f"plain {key} end",
        "the key is aaaaaaaaaaaaaaaaaaaa1 ok",
        "paſſword=abcdefghij toKen=abcdefghij İ token=abcdefghij",
        "secret=token=abcdefgh " * 3,
        "",
        None,
    ]
    rows = {r.doc_id: r for r in secrets.scan(table(spark, list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        base = brute_base(t or "")
        assert [rows[i].n_assign, rows[i].n_access, rows[i].n_hex] == [sum(k == n for _, k, _ in base) for n in range(3)]
        assert rows[i].base_sha256 == hashlib.sha256(secrets.joined(base).encode()).hexdigest()
        assert set(filter(None, secrets.joined(base).split(","))) <= set(rows[i].spans.split(","))
    assert rows[2].spans == f"novel:22:{22 + len(key)}" and rows[3].spans == rows[4].spans == rows[8].spans == ""
    assert secrets.scan(table(spark, ODD)).count() == len(ODD) and secrets.scan(table(spark, [])).count() == 0


def brute_candidates(text):
    """Run by run and place by place."""
    words, allowed = ("bearer", "authorization", "credential", "private", "passphrase", "passw", "pwd", "secret", "token", "key", "auth"), re.compile(r"[A-Za-z0-9+/_=\-]")
    low, ends, at = text.lower(), [], 0
    while at < len(low):
        word = next((w for w in words if low.startswith(w, at)), None)
        at += len(word) if word else 1
        ends += [at] if word else []
    found, a = [], 0
    while a < len(text):
        b = a
        while b < len(text) and allowed.match(text[b]):
            b += 1
        if b - a >= 16:
            start = a if any(0 <= a - e <= secrets.REACH for e in ends) else min((e for e in ends if a < e <= b - 16), default=None)
            found += [] if start is None else [(start, b)]
        a = max(b, a + 1)
    return found


def test_secret_candidates():
    rng = np.random.default_rng(6)
    pieces = ["the key", " is ", "bearer ", "Zk3Vq9XwT7uPb2Lm", "secret", "_", "x" * 40, "word " * 9, "a1b2c3d4e5f6", "=", " ", "authorization", "autho"]
    novelty = secrets.Novelty(["some_name"])
    for _ in range(300):
        text = "".join(rng.choice(pieces, rng.integers(1, 25)))
        assert secrets.candidates(text, text.lower()) == brute_candidates(text)
        base = secrets.base_spans(text)
        want = [
            (a, 3, b)
            for a, b in brute_candidates(text)
            if not any(x < b and a < y for x, _, y in base)
            and any(c.isdigit() for c in text[a:b])
            and any(c.isalpha() for c in text[a:b])
            and novelty.of(text[max(0, a - secrets.AROUND) : a], text[a:b], text[b : b + secrets.AROUND]) >= secrets.LEAST_NOVELTY
        ]
        assert secrets.novel_spans(text, base, novelty) == want


def assert_linear(work, n):
    """Four times the input takes at most eight times as long, whatever the machine: a square would take sixteen."""

    def took(size):
        began = time.process_time()
        work(size)
        return time.process_time() - began

    small, large = (min(took(size) for _ in range(2)) for size in (n, 4 * n))
    assert large < 8 * small + 0.5


@pytest.mark.parametrize("piece", ["the key is ", "secret = ", "token", "a"])
def test_secrets_take_linear_time(piece):
    def work(n):
        text = piece * (n // len(piece))
        secrets.novel_spans(text, secrets.base_spans(text), secrets.Novelty([]))

    assert_linear(work, 1_000_000)


def test_secret_dictionary(spark):
    docs = table(spark, [(1, "my_long_name camelCaseName my_long_name k3y_with_digits X"), (2, None), (3, "camelCaseName my_long_name aName bName")])
    assert secrets.identifiers(docs) == ["my_long_name", "camelCaseName"] and secrets.identifiers(docs, 1) == ["my_long_name"]
    plain, primed = secrets.Novelty([]), secrets.Novelty(["quite_unusual_identifier"])
    assert primed.of("", "quite_unusual_identifier2", "") < plain.of("", "quite_unusual_identifier2", "")


def test_bpe_round_trip(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(bpe.default_path())
    texts = [*[t for _, t in ODD], " x  \n\n y", "日本語 テキスト", "\x1c\x1dz \x85q", "it's 're 'S x'll", "a\r\n\t b", "<|endoftext|><|endoftext|>", "ǅ ʰ ٣३ ½²"]
    docs = table(spark, list(enumerate(texts)))
    got = {r.doc_id: r for r in bpe.decode(bpe.encode(docs)).collect()}
    short = {r.doc_id: r for r in bpe.digested(docs).collect()}
    for i, t in enumerate(texts):
        ids = plain.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(got[i].ids, np.uint32).tolist() == ids and got[i].text == plain.decode(ids, skip_special_tokens=False) == (t or "")
        assert short[i].n_tokens == len(ids) and short[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert bpe.digested(table(spark, [])).count() == 0


def test_bpe_ids_come_from_the_table(spark):
    """A table that lacks a word makes the result fail; a larger one serves."""
    docs = table(spark, [(1, "some words"), (2, "and more words")])
    files, bits = bpe.word_table(docs, bpe.default_path())
    assert bpe.encode(docs.where("doc_id = 1"), table=(files, bits)).count() == 1
    for fewer in ([], bpe.word_table(docs.where("doc_id = 1"), bpe.default_path())[0]):
        with pytest.raises(Exception, match="lacks a word"):
            bpe.encode(docs, table=(fewer, bits)).collect()


def test_bpe_splitter():
    """The pattern against the library's splitter, on random texts over its letters."""
    rng, codec = np.random.default_rng(1), bpe.Codec(bpe.default_path())
    letters = [*" 'stremvld\n\t\r\x85\xa0aé²½1,.\x1c\x00ªºµǅƻ×÷"]
    for _ in range(3000):
        text = "".join(rng.choice(letters, rng.integers(0, 14)))
        assert bpe.WORDS.findall(text) == [bytes(codec.letters[c] for c in x).decode() for x, _ in codec.splitter.pre_tokenize_str(text)]


@pytest.mark.parametrize("hot_share", [1 / 512, 1 / 4])
def test_language_model(spark, monkeypatch, hot_share):
    monkeypatch.setattr(ngram_lm, "HOT_SHARE", hot_share)
    monkeypatch.setattr(ngram_lm, "LEAST_HOT", 0)
    rng = np.random.default_rng(4)
    texts = [" ".join(f"W{x}" for x in rng.zipf(1.6, 60) % 40) for _ in range(60)] + [None, "", "unseen words only", "W1 W1"]
    docs = table(spark, list(enumerate(texts)))
    train = docs.limit(50)
    model = ngram_lm.train(train.selectExpr("cast(text as binary) AS text"))
    split = [[*(t or "").lower().split(), "\n"] for t in texts]
    count, pairs = collections.Counter(), collections.Counter()
    learned = {r.doc_id for r in train.collect()}
    for i in learned:
        count.update(split[i])
        pairs.update(zip(["^", *split[i][:-1]], split[i], strict=True))
    continued, total, kinds = collections.Counter(w for _, w in pairs), collections.Counter(), collections.defaultdict(collections.Counter)
    for (u, _), c in pairs.items():
        total[u] += c
        kinds[u][min(c, 3)] += 1
    of = [collections.Counter(x.values()) for x in (pairs, continued)]
    taken, below = (ngram_lm.discounts([o[k] for k in (1, 2, 3, 4)]) for o in of)
    spare = sum(below[min(k, 3)] * n for k, n in of[1].items()) / len(pairs)

    def p(u, w):
        low = (continued[w] - below[min(continued[w], 3)]) / len(pairs) + spare / (len(count) + 1)
        if not total[u]:
            return low
        return (pairs[u, w] - taken[min(pairs[u, w], 3)]) / total[u] + sum(taken[k] * n for k, n in kinds[u].items()) / total[u] * low

    assert sum(p("w1", w) for w in count) + sum(taken[k] * n for k, n in kinds["w1"].items()) / total["w1"] * spare / (len(count) + 1) == pytest.approx(1)
    for r in ngram_lm.scored(docs, model).collect():
        t = split[r.doc_id]
        assert (r.n_tokens, r.n_known) == (len(t), sum(count[w] > 0 for w in t))
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 1) / (sum(count.values()) + len(count) + 1)) for w in t))
        assert r.score == pytest.approx(sum(math.log10(p(u, w)) for u, w in zip(["^", *t[:-1]], t, strict=True)))


def test_language_model_counts_beyond_32_bits(tmp_path):
    pair, c = np.array([9, 2, 5, 7], np.uint64), np.array([3, 2**40, 2**32 - 1, 2**32 - 2])
    (tmp_path / "pairs").write_bytes(ngram_lm.pair_blob(3, pair, c) + b"\n")
    scorer = ngram_lm.Scorer(ngram_lm.Model([str(tmp_path / "pairs")], [], 4, pair, 1, 1, ngram_lm.discounts([0] * 4), ngram_lm.discounts([0] * 4), 0, 1.0))
    assert scorer.counts(np.full(5, 3), np.array([2, 5, 6, 7, 9], np.uint64)).tolist() == [2**40, 2**32 - 1, 0, 2**32 - 2, 3]


def test_language_model_odd(spark):
    empty = ngram_lm.train(table(spark, []).selectExpr("cast(text as binary) AS text"))
    assert {r.score for r in ngram_lm.scored(table(spark, ODD), empty).collect()} == {0.0}
    model = ngram_lm.train(table(spark, ODD).selectExpr("cast(text as binary) AS text"))
    assert ngram_lm.scored(table(spark, ODD), model).count() == len(ODD) and ngram_lm.scored(table(spark, []), model).count() == 0


PAGE = """<html><head><title>t</title><script>var x="<p>no</p>";</script></head><body><header><h1>Site</h1></header><nav><a href=/>Home</a></nav>
<div class="sidebar"><p>The best of the rest in the side bar and the list of the things that you may want to read here today.</p></div>
<div id="content"><h2>Real &amp; title</h2><p>This is the first paragraph of the text, and it has many words that are in the list of them, so it is kept.
<p>Short one.<p>And this is the second paragraph with <a href="x">a link</a> and it goes on for a while so that it is long enough to be kept.</div>
<div class="cookie-notice">We use cookies on this site and the others that are part of it, to make it better for you and for us all.</div>
<ul><li><a href=1>one link</a><li><a href=2>another</a></ul>
<div class="comments"><p>I think that this is the best article that I have read in the last year or so, and I will be back for more.</p></div><footer>c</footer>"""


def test_html(spark):
    want = [
        "Real & title",
        "This is the first paragraph of the text, and it has many words that are in the list of them, so it is kept.",
        "Short one.",
        "And this is the second paragraph with a link and it goes on for a while so that it is long enough to be kept.",
    ]
    assert html_text.main_text(PAGE).split("\n") == want
    article = '<main><h1>A</h1><p>b&nbsp;c<br>d</p><p class="ad">x</p><!-- <p>no --><p>%%% ### 1 < 2</p><form>f</form></main><p>tail</p>'
    assert html_text.main_text(article) == "A\nb c d\n%%% ### 1 < 2"
    rows = [(1, None, PAGE), (1, "u", PAGE), (2, "u", None), (3, None, ""), (None, "u", "<p>" * 3000 + "x <a href='"), (5, "u", "<b><i>" * 5000)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id bigint, url string, html string, text int")
    got = html_text.extract(pages).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert html_text.extract(pages.limit(0)).count() == 0


BODY = "This is the text of the article, and it has many of the words that are in the list, so that it is long enough."
OTHERS = {
    "ru": "Это первое предложение статьи о погоде. Вчера шёл дождь, и улицы были мокрыми. Сегодня светит солнце, и дети гуляют в парке.",
    "zh": "这是关于天气的第一句话。昨天下了雨，街道都湿了。今天阳光明媚，孩子们在公园里玩耍。",
    "pl": "To jest pierwsze zdanie artykułu o pogodzie. Wczoraj padał deszcz, więc ulice były mokre. Dzisiaj świeci słońce.",
}
CODE = "def f(x): return x + 1; print(f(2)); for i in range(100): total += i * f(i) ** 2; assert total"
PAGES = [  # html, the text that a reader would take for the article's
    ('<div class="layout no-sidebar"><article><p>B</p></article></div>', "B"),
    ('<body class="has-sidebar-left"><div class="search-results-page"><article><p>B</p></article></div>', "B"),
    ('<div class="layout--related"><main><p>B</p></main></div>', "B"),
    ('<article><p>B</p></article><section><article class="comment"><p>B B</p></article></section>', "B"),
    ('<article><p>B</p></article><div id="post-comments"><article><p>B B B</p></article></div>', "B"),
    ("<main><p>teaser</p></main><div><p>B</p><p>B</p></div>", "teaser\nB\nB"),
    ("<div><svg><path d='x'><p>B</p></div>", "B"),
    ("<div><select><option>one<p>B</p></div>", "B"),
    ("<article><iframe src=x></iframe><p>B</p></article>", "B"),
    ('<form id="page"><div><p>B</p><p>B</p></div></form>', "B\nB"),
    ('<article><h1><a href="x">Title</a></h1><p>B</p><form><label>Name</label><input></form></article>', "Title\nB"),
    ('<article><p>B</p><ul><li><a href=1>one</a><li><a href=2>two</a><li><a href=3>three</a></ul></article>', "B"),
    ('<div class="social"><div role="navigation"><p>B</p></div></div><div><p>B</p></div>', "B"),
    ("<p>B<!-- never closed <p>more", "B"),
    ('<p title="never closed>B</p><p>B</p>', "B\nB"),
]


PAGES += [(f"<div><p>{t}</p></div>", t) for t in OTHERS.values()] + [(f"<body><nav>x</nav><h1>T</h1><p>{t}</p><p>{t}</p>", f"T\n{t}\n{t}") for t in OTHERS.values()]
PAGES += [(f'<article><p>B</p><div class="{c}"><h2>Head</h2><p>B</p></div></article>', "B\nHead\nB") for c in ("share-price", "menu-item", "related-work", "ad-hoc", "comment-box-example", "widget-factory", "promo-code", "copyright-law")]
PAGES += [(f'<article><p>B</p><div class="{c}"><p>B</p><p>x</p></div></article>', "B\nB") for c in ("social", "legal", "side", "discussion")]
PAGES += [(f'<article><p>B</p><div class="{c}"><p>B</p></div></article>', "B") for c in ("share-buttons", "newsletter-signup", "related-posts", "ad", "comment-list", "notice")]
PAGES += [(f"<div><p>B</p><{t}>{CODE}</{t}><p>B</p></div>", f"B\n{CODE}\nB") for t in ("pre", "table", "ul", "address")]
PAGES += [("<body><h1>Title</h1><p>Short text.</p><p><a href=x>all link</a></p>", "Title\nShort text.")]


@pytest.mark.parametrize(("page", "want"), PAGES)
def test_html_pages(page, want):
    assert html_text.main_text(page.replace("B", BODY)) == want.replace("B", BODY)


@pytest.mark.parametrize("piece", ["<b>word</b>", "<b><i>", '<a "', "<!--", "<div>", "<a '\">", "<p>x &amp; y"])
def test_html_takes_linear_time(piece):
    assert_linear(lambda n: html_text.main_text("<article>" + piece * (n // len(piece))), 500_000)


@pytest.mark.parametrize("n", [1, 2, 7, 100])
def test_jpeg_paths_agree(n, monkeypatch):
    payload = np.random.default_rng(n).integers(0, 256, 64 * n, dtype=np.uint8).tobytes()
    file = jpeg.encode(payload)
    quick = jpeg.read(file)
    monkeypatch.setattr(jpeg, "_at_once", lambda *a: False)
    slow = jpeg.read(file)
    assert all((a == b).all() for a, b in zip(quick.coefficients, slow.coefficients, strict=True))
    assert jpeg.payload_of(quick) == payload
    rgb = jpeg.tensor(quick)
    assert rgb.shape == (quick.height, quick.width, 3) and rgb.dtype == np.uint8


def test_jpeg_transform():
    """A block of a constant and one of a single cosine, against the definition."""
    c = np.zeros(64, np.float32)
    c[0], c[1] = 80, 40  # the second is the horizontal cosine
    x = np.arange(8)
    want = 80 / 8 + 40 * np.sqrt(1 / 8) * 0.5 * np.cos((2 * x + 1) * np.pi / 16)
    assert np.allclose((c @ jpeg.INVERSE).reshape(8, 8), np.tile(want, (8, 1)), atol=1e-4)


def test_jpeg_columns(spark, tmp_path):
    docs = table(spark, ODD)
    media = jpeg.stored(docs)
    for r in jpeg.features(media).collect():
        raw = next(t for d, t in ODD if d == r.doc_id) or ""
        payload = jpeg.padded(raw.encode())
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw.encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    held, tensors = jpeg.store(docs, str(tmp_path / "media"), str(tmp_path / "tensors"))
    assert sorted(map(str, jpeg.features(held).collect())) == sorted(map(str, jpeg.features(media).collect()))
    assert tensors.selectExpr("sum(length(rgb))").first()[0] == sum(768 * np.prod(jpeg.layout(max(1, -(-len((t or "").encode()) // 64)))) for _, t in ODD)
    shapes = jpeg.tensors(media).selectExpr("height * width * 3 = length(rgb) AS ok").collect()
    assert len(shapes) == len(ODD) and all(r.ok for r in shapes)
    assert jpeg.features(jpeg.stored(table(spark, []))).count() == 0
