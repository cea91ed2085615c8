"""The training-data operators against brute force, and on awkward tables."""

import html as entities
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ragloom.llm import (decontaminate, jaccard_join, langid, packing, quality_model, quality_rules,
                         stats, tokenize, toxicity, url_rules, wavelet, wrapper)
from ragloom.llm.common import remainder
from ragloom.llm.components import components

SF = "/root/testdata/sf0.001"
DOCS = ("doc_id long, text string, lang string, source string, n_chars long, _id string, "
        "host string, n_words int, _gone int, sig int, _lang int, digest string, length int")
LONG = " ".join(f"word{i % 997} and the" for i in range(30_000))


def _row(i, text, lang="en", source="s"):
    return (i, text, lang, source, len(text or ""), "x", "h", 7, 1, 2, 3, "d", 9)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing names."""
    rows = [_row(1, None), _row(2, ""), _row(3, "  \n\t "), _row(4, LONG), _row(5, "hello"),
            _row(5, "hello"), _row(6, "one two"), _row(7, "one two"), _row(8, "\x00 a  b \n\n c "),
            _row(9, "12345 !!!"), _row(None, "some text with a null id, long enough to be read"),
            _row(10, "the same id"), _row(10, "another text"), _row(11, "ünï çödé  text\n",
                                                                     None, None),
            (12, None, None, None, *[None] * 9)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def ascii_lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def same(df, got):
    assert df.count() == got.count()


# ---- 1 quality model


def test_quality_model_learns(spark, docs):
    sf = "/root/testdata/sf0.01"
    d, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = quality_model.score_quality(d, labels, remainder("doc_id", 5) != 0)
    rows = got.where(remainder("doc_id", 5) == 0).join(labels, "doc_id").collect()
    assert len(rows) > 50
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_quality_model_sums_equal_the_whole(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(200, 12)), rng.integers(0, 2, 200)
    df = spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(x, y)],
                               "_x array<double>, _y double").repartition(7)
    got = quality_model.task_sums(df, lambda a, b: (a.T @ a).ravel())
    assert np.allclose(got.reshape(12, 12), x.T @ x)


def test_isotonic_is_monotone_and_pools():
    x, y = quality_model.isotonic(np.array([1., 2, 3, 4]), np.ones(4), np.array([0., 1, 0, 1]))
    assert (np.diff(y) >= 0).all() and len(x) == 3


def test_quality_model_odd(spark, odd, none):
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 1), (5, 0, 1), (6, None, None), (None, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    for d in (odd, none):
        same(d, quality_model.score_quality(d, labels, F.lit(True)))
    got = quality_model.score_quality(odd, labels.limit(0), F.lit(True)).collect()
    assert {r.score for r in got} == {0.5}


# ---- 2 URL rules


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"),
         ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def brute_rule(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        host = ascii_lower(re.match(r"[^/?#]*", rest)[0])
        path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
    fits = [(len(h + p), h + p, v) for h, p, v in RULES
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, rule, verdict = max(fits, default=(0, None, "allow"))
    return host, path, rule, verdict


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://", "http://EXAMPLE.com/en/x?y#z", "http://a.b.net/fr/",
            "https://www.example.com/en/1", "https://x.www.example.com/en/", "http://example.com/EN/",
            "http://notexample.com/en/", "http://net/es/", "http://a.net?/es/", "http://com",
            "http://x.com/", "a://b://c.com/", "http://ä.com/ü\n/x", "http://a..com/", "http://.com/en/",
            "http://" + "a." * 3000 + "com/en/", "http://m.net/es/" + "p" * 50_000]
    df = spark.createDataFrame([(i // 2, u, "h", "p", "r") for i, u in enumerate(urls + urls)],
                               "page_id long, url string, host string, path string, rule string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = Counter((r.host, r.path, r.rule, r.verdict) for r in url_rules.judge_urls(df, rules).collect())
    assert got == Counter(brute_rule(u) for u in urls + urls)
    assert {r.verdict for r in url_rules.judge_urls(df, rules.limit(0)).collect()} == {"allow"}
    assert url_rules.judge_urls(df.limit(0), rules).count() == 0


# ---- 3 main text


def test_main_text_of_the_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in wrapper.main_text(pages).collect()}
    for p in pages.collect():
        inner = re.search(r"<article>(.*)</article>", p.html, re.S)[1]
        inner = re.sub(r"<br>", " ", re.sub(r"</?(?:p|h1)>", "\x01", inner))
        parts = (" ".join(entities.unescape(b).split()) for b in re.sub(r"<[^>]*>", "", inner).split("\x01"))
        assert got[p.page_id].text == " ".join(b for b in parts if b)
        assert got[p.page_id].n_chars == len(got[p.page_id].text)


def page(i, body):
    return (f"<html><head><title>T{i}</title><script>var a='<p>x</p>';</script></head><body>"
            f"<header>Site</header><div id=top><p>Site name</p></div><ul class='main-menu'><li>Home<li>"
            f"About {i}</ul><div class='cookieNotice'>We use cookies</div><div id=content><h2>Head {i}</h2>"
            f"{body}</div><div id=box><p>Always the same</p></div><form><input>q</form>"
            f"<section class=comments><p>Nice {i}!</p></section><div class=foot>(c)</div></body></html>")


def test_main_text_by_induction():
    pages = [page(i, f"<p>First &amp; text {i} " + "word " * 20 + f"<p>Second<br>line {i}") for i in range(6)]
    for i, text in enumerate(wrapper.extract(pages)):
        assert text == f"Head {i} First & text {i} " + "word " * 20 + f"Second line {i}"
    assert wrapper.extract([page(0, "<p>Only one page here")]) == ["Head 0 Only one page here"]


def test_main_text_of_several_containers():
    for n in (2, 5):
        for a, b in (("<div>", "</div>"), ("<section>", "</section>"), ("<table><tr><td>", "</table>")):
            pages = [page(i, "".join(f"{a}part {k} of {i}{b}" for k in range(3))) for i in range(n)]
            assert wrapper.extract(pages) == [f"Head {i} " + " ".join(
                f"part {k} of {i}" for k in range(3)) for i in range(n)]
        pages = [page(i, f"<div><p>{'long ' * 20}{i}</div><div class=rest><p>short {i}</div>") for i in range(n)]
        assert wrapper.extract(pages) == [f"Head {i} {'long ' * 20}{i} short {i}" for i in range(n)]
        pages = [f"<ul class=menu><li>x</ul><article><p>one {i}</article><article><p>two, longer {i}"
                 f"</article><div>side</div>" for i in range(n)]
        assert wrapper.extract(pages) == [f"one {i} two, longer {i}" for i in range(n)]
        assert wrapper.extract(pages[:1]) == ["one 0 two, longer 0"]


def test_main_text_of_copies():
    body = "<p>" + "copied text " * 9 + "<p>second paragraph"
    copy, text = page(7, body), "Head 7 " + "copied text " * 9 + "second paragraph"
    for others in (0, 1, 4):        # 20 copies, with and without other pages of the host
        pages = [copy] * 20 + [page(i, f"<p>text of {i}<p>more of {i}") for i in range(others)]
        assert wrapper.extract(pages) == [text] * 20 + [
            f"Head {i} text of {i} more of {i}" for i in range(others)]
    # a node that is the same on nearly all pages, where a page differs
    pages = [page(i, f"<p>text of {i}").replace("Always the same", "Not here" if i == 3 else "Always the same")
             for i in range(20)]
    assert wrapper.extract(pages) == [f"Head {i} text of {i}" + " Not here" * (i == 3) for i in range(20)]


def test_tree_matching_is_maximal():
    a, b = (wrapper.Shape([wrapper.parse(t)]) for t in (
        "<div><p>a<p>b<ul><li>x</ul></div><h2>t</h2>", "<h2>u</h2><div><p>a<ul><li>x<li>y</ul></div>"))
    memo = {}
    best = wrapper.match(a, b, memo)
    assert best == len(wrapper.aligned(a, b, memo)) == 5     # html, div, p, ul, li


def test_main_text_odd(spark):
    rows = [(1, None, None, "t"), (2, "http://a/", "", "t"), (2, "http://a/", "", "t"),
            (None, "x", "<p>null id", "t"), (3, "http://a/", "<div class='x>broken<p>a", "t"),
            (4, "http://a/", "<p>" * 3000 + "deep", "t"), (5, "http://a/", "<div>" * 3000 + "deep", "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in wrapper.main_text(df).collect()}
    assert got[1] == got[2] == "" and got[None] == "null id" and got[4] == got[5] == "deep"
    same(df, wrapper.main_text(df))
    assert wrapper.main_text(df.limit(0)).count() == 0


# ---- 4 packing, 8 token files


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    tok = tokenizers.Tokenizer.from_file(tokenize.default_path())
    return lambda t: tok.encode(t or "", add_special_tokens=False).ids + [2]


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def test_encoder_equals_the_library(library):
    texts = ["", " ", "  ", "a  b", " a", "a ", "a\nb c.\nd", "a.\n", "\na b", "a \n b", "x\u00a0y z",
             "é\u2009b c", "don't we'll 's", "1 22 a1 b2!", "x\ty", "it's...,\nno", LONG, "\x1c x", "x 　 y"]
    got = tokenize.Encoder(tokenize.default_path(), keep=50).ids([t.encode() for t in texts])
    for t, g in zip(texts, got):
        assert np.frombuffer(g, "<u4").tolist() == library(t)[:-1], t[:40]


def check_packing(df, got, library, capacity):
    want = []
    for r in df.collect():
        ids = library(r.text)
        first = len(ids) - (-(-len(ids) // capacity) - 1) * capacity
        at, piece = 0, 0
        while at < len(ids):
            n = capacity if piece else first
            want.append((r.doc_id, piece, at, n, crc(ids[at:at + n])))
            at, piece = at + n, piece + 1
    assert Counter(tuple(g)[:5] for g in got) == Counter(want)
    fill = defaultdict(list)
    for g in got:
        fill[g.sequence_id].append((g.offset, g.length))
    for parts in fill.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
    return len(fill), -(-sum(g.length for g in got) // capacity)


def test_packing(docs, odd, none, library):
    used, least = check_packing(docs, packing.pack(docs).collect(), library, 1024)
    assert used <= 1.03 * least + 1
    check_packing(odd, packing.pack(odd, capacity=64).collect(), library, 64)
    assert packing.pack(none).count() == 0


def test_plan_places_every_rank_once():
    rng = random.Random(3)
    counts = {n: rng.randint(0, 30) for n in range(1, 101)}
    rules, bins = packing.plan(counts, 100)
    seen, fill = Counter(), Counter()
    for n, lo, hi, first, offset in rules:
        for r in range(lo, hi):
            seen[n, r] += 1
            fill[first + r - lo] += n
    assert set(seen.values()) == {1} and len(seen) == sum(counts.values())
    assert max(fill.values()) <= 100 and len(fill) == bins
    free, plain = Counter(), 0       # best fit decreasing, piece by piece
    for n in sorted(counts, reverse=True):
        for _ in range(counts[n]):
            room = next((s for s in range(n, 101) if free[s]), 0)
            plain += not room
            free[room] -= bool(room)
            free[(room or 100) - n] += 1
    assert bins <= 1.01 * plain + 1


def test_wavelet_matrix():
    rng = np.random.default_rng(1)
    for n in (0, 1, 511, 512, 513, 4000):
        ids = rng.integers(0, 300, n)
        wm, names, starts = wavelet.open_shard(wavelet.pack_shard(ids, [7, None], [0, n // 2], 9))
        assert names == [7, None] and starts.tolist() == [0, n // 2, n]
        assert wm.all().tolist() == ids.tolist()
        assert [wm.access(i) for i in range(0, n, 41)] == ids[::41].tolist()
        for token in (0, 5, 299, 511, 600):
            assert wm.occurrences(token) == np.flatnonzero(ids == token).tolist()
            assert wm.rank(token, n // 4, n // 2) == (ids[n // 4:n // 2] == token).sum()


def test_token_files(spark, docs, odd, none, library, tmp_path):
    got = wavelet.token_files(docs, shard_tokens=5000).orderBy("doc_id").collect()
    start = 0
    for d, g in zip(docs.orderBy("doc_id").collect(), got, strict=True):
        ids = library(d.text)
        assert tuple(g) == (d.doc_id, start, len(ids), crc(ids))
        start += len(ids)
    path = wavelet.encode_corpus(docs, str(tmp_path / "w"), shard_tokens=5000)
    every = Counter(i for d in docs.collect() for i in library(d.text))
    token = every.most_common(5)[4][0]
    assert wavelet.count_token(spark, path, token).agg(F.sum("n")).first()[0] == every[token]
    places = {(d.doc_id, i) for d in docs.collect() for i, x in enumerate(library(d.text)) if x == token}
    assert {tuple(r) for r in wavelet.locate_token(spark, path, token).collect()} == places
    got = Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in wavelet.token_files(odd).collect())
    assert got == Counter((r.doc_id, len(library(r.text)), crc(library(r.text))) for r in odd.collect())
    assert wavelet.token_files(none).count() == 0


# ---- 5 language


def test_language_vectors_equal_brute_force():
    texts = ["Ab c!", "xyz", "", "a", "ÄÖ ß"]
    rows, index, doc = langid.grams([t.encode() for t in texts])
    got = np.zeros((len(texts), 64))
    for at, v in langid.bound(rows, 64):
        for k in range(len(v)):
            for i in np.flatnonzero(index == at + k):
                got[doc[i]] += v[k]
    for t, g in zip(texts, got):
        s = [0]
        for c in t.lower():
            x = ord(c) if c.isalpha() else 0
            if x or s[-1]:
                s.append(x)
        s += [0] if s[-1] else []
        want = np.zeros(64)
        for a, b, c in zip(s, s[1:], s[2:]):
            want += (np.roll(langid._vector(a, 64), 2) * np.roll(langid._vector(b, 64), 1)
                     * langid._vector(c, 64))
        assert (g == want).all()


def test_language_held_out(docs):
    bundles = langid.profiles(docs.where(remainder("doc_id", 4) != 2))
    got = langid.identify(docs.where(remainder("doc_id", 4) == 2), bundles).collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_language_odd(spark, odd, none):
    bundles = langid.profiles(odd)
    got = langid.identify(odd, bundles, ["doc_id"])
    same(odd, got)
    for r in got.collect():
        assert r.doc_id not in (1, 2, 3, 9, 12) or (r.lang_pred, r.score) == ("und", 0.0)
    assert langid.profiles(none) == {}
    assert {r.lang_pred for r in langid.identify(odd, {}).collect()} == {"und"}
    assert langid.identify(none, bundles).count() == 0


# ---- 6 toxicity


def test_decoder_restores_hidden_words():
    text = "idiot stupid pathetic trash loser disgusting the and their there read writing story " * 50
    table = toxicity.count_grams(Counter(text.split()))
    d = toxicity.Decoder(table)
    for hidden, word in [("1d10t", "idiot"), ("i.d.i.o.t", "idiot"), ("stuuupid", "stupid"),
                         ("p@th3t1c", "pathetic"), ("tr@sh!", "trash"), ("the", "the"),
                         ("d-i-s-g-u-s-t-i-n-g", "disgusting")]:
        assert word in d.token(hidden), (hidden, d.token(hidden))
    assert "stupid" in d.words("a very s t u p i d story")
    assert d.words("") == set() and d.token("12345") == ()


def test_decoder_restores_doubled_and_split_words():
    text = ("idiot stupid pathetic trash loser disgusting the and their there read writing story "
            "is a of in to it book all letter green tree ") * 50
    d = toxicity.Decoder(toxicity.count_grams(Counter(text.split())))
    for hidden, word in [("idioot", "idiot"), ("stuupid", "stupid"), ("iiddiioott", "idiot")]:
        assert word in d.token(hidden), (hidden, d.token(hidden))
    for plain in ("book", "all", "letter", "green", "tree"):
        assert d.token(plain) == (plain,)
    for hidden, word in [("id iot", "idiot"), ("st u pid", "stupid"), ("tra sh,", "trash"),
                         ("path etic", "pathetic"), ("1d iot", "idiot")]:
        assert word in d.words(f"a very {hidden} story"), hidden
    assert d.words("it is in the book of all") == set("it is in the book of all".split())


def test_joined_pieces_equal_exhaustive_search():
    import itertools

    d = toxicity.Decoder(toxicity.count_grams(Counter("idiot stupid the it is in into to a".split() * 9)))
    for run in ("id iot", "st u pid", "in to the", "it is a st upid id iot", "i t is"):
        pieces, best = run.split(), None
        for cut in itertools.product((False, True), repeat=len(pieces) - 1):
            words, cost = [pieces[0]], 0.0
            for c, p in zip(cut, pieces[1:]):
                cost += toxicity.COST_BREAK if c else toxicity.COST_JOIN
                words = [*words, p] if c else [*words[:-1], words[-1] + p]
            for w in words:
                context = "^^^"
                for c in w + "$":
                    cost, context = cost + d.cost(context, c), (context + c)[-3:]
            best = min(best or (cost, words), (cost, words))
        assert set(d.spaced(tuple(pieces))) == {w for w in best[1] if w not in pieces}


def test_batches_equal_single_steps():
    words = Counter("idiot stupid the it is in into to a zoé letter".split() * 9)
    table = np.zeros(toxicity.BUCKETS)
    for w, n in words.items():
        for k in range(1, toxicity.ORDER + 1):
            for i in range(len(w) + 5 - k):
                table[toxicity._bucket(f"^^^{w}$"[i:i + k])] += n
    assert (table == toxicity.count_grams(words)).all()
    assert not toxicity.count_grams(Counter()).any()
    d = toxicity.Decoder(table)
    for w in ("idiot", "x", "", "zoé", "lletter"):
        marked = f"^^^{w}$"
        assert d.spell([w])[0] == pytest.approx(
            sum(d.cost(marked[i - 3:i], marked[i]) for i in range(3, len(marked))))
    rng = np.random.default_rng(3)
    some = ["id", "iot", "st", "u", "pid", "i", "t", "the", "int", "o", "1d", "is,", "story", "77", "book"]
    texts = [" ".join(rng.choice(some, n)) for n in [0, 1, 2, *rng.integers(3, 60, 40)]]
    together = toxicity.Decoder(table).all_words(texts)
    for text, got in zip(texts, together):
        assert got == d.words(text)              # neighbours in a batch change nothing
        run: list[str] = []
        for token in [*text.split(), ""]:        # each run by itself
            piece = d.pieces[token]
            if piece:
                run.append(piece)
                continue
            if len(run) > 1:
                assert set(d.spaced(tuple(run))) <= got
            run = []
    assert toxicity.Decoder(table).all_words([]) == []


def test_readings_kept_between_slices(monkeypatch):
    table = toxicity.count_grams(Counter("idiot stupid the it is in into to a zoé letter".split() * 9))
    rng = np.random.default_rng(4)
    some = ["id", "iot", "st", "u", "pid", "i", "t", "the", "iddiot", "1d10t", "is,", "Letter.", "stuuupid", "s", "É"]
    texts = [" ".join([*rng.choice(some, n), *[f"it{chr(97 + k)}{chr(97 + n % 26)}" for k in range(n % 5)]])
             for n in [0, 1, *rng.integers(2, 50, 60)]]
    for tokens, letters in ((800_000, 32_000_000), (60, 32_000_000), (800_000, 200), (0, 0)):
        monkeypatch.setattr(toxicity, "TOKENS", tokens)      # tables that stay, shrink, start anew
        monkeypatch.setattr(toxicity, "LETTERS", letters)
        d, read, learn = toxicity.Decoder(table), [], toxicity.Decoder._token
        monkeypatch.setattr(d, "_token", lambda t, d=d: read.append(t) or learn(d, t))
        for at in [*range(0, len(texts), 7)] * 2:
            part = texts[at:at + 7]
            alone = [toxicity.Decoder(table).words(t) for t in part]
            assert d.all_words(part) == alone
            assert d.restored(part, 3).to_pylist() == [
                "\n".join(sorted(w for w in words if len(w) > 2)) for words in alone]
            assert len(d.size) == len(d.ids) <= tokens + 500
        if min(tokens, letters) > 200:
            assert len(read) == len(set(read))   # a token is read once, not once a slice
    assert d.restored([], 3).to_pylist() == [] and d.restored(["", "a"], 3).to_pylist() == ["", ""]


def test_picked_words_are_those_that_count():
    import pyarrow as pa

    texts = ["idiot\nidiots\nstory", "", "zoés\nzoé", "the"]
    for whole, stem in (({"idiot", "zoé"}, ()), ((), {"idio", "zoés"}), ({"the"}, {"stor"}), ((), ())):
        assert toxicity.picked(pa.array(["x", *texts])[1:], whole, stem) == [
            {w for w in t.split("\n") if w in whole or w[:4] in stem} for t in texts]


def test_viterbi_equals_exhaustive_search():
    import itertools

    d = toxicity.Decoder(toxicity.count_grams(Counter("tile lite idle title till".split() * 9)))
    for token in ("t1l3", "1d1e", "7i|e"):
        best = None
        for pick in itertools.product(*[[(x, 0 if c.isalpha() else toxicity.COST_LEET) for x in
                                         (c if c.isalpha() else toxicity.LEET[c])] for c in token]):
            word, cost, ctx = "".join(p[0] for p in pick), sum(p[1] for p in pick), "^^^"
            for c in word:
                cost, ctx = cost + d.cost(ctx, c), (ctx + c)[-3:]
            cost += d.cost(ctx, "$")
            best = min(best or (cost, word), (cost, word))
        assert d.viterbi(token) == (best[1],)


def test_learning_equals_counting(spark):
    """Evidence, its precision and the rate of the rest, against counts over all texts."""
    rng = random.Random(8)
    plain = "the read story house green water moon table chair music".split()
    rows = []
    for i in range(120):
        toxic = i % 3 == 0
        words = set(rng.choices(plain, k=6))
        if toxic and i % 12:
            words.add(rng.choice(["idiot", "moron", "moronic", "idiotic", "idiots"]))
        rows.append((i, float(toxic), "\n".join(sorted(words))))
    sure, rest = toxicity.learn(spark.createDataFrame(rows, "_id int, _y double, words string"))

    def low(k, n):
        z, p = toxicity.Z, k / n
        return (p + z * z / (2 * n) - z * (p * (1 - p) / n + z * z / (4 * n * n)) ** 0.5) / (1 + z * z / n)

    def count(items):
        bad, good = Counter(), Counter()
        for _, y, w in rows:
            (bad if y else good).update(items(set(w.split("\n"))))
        return {x: (k + 0.1) / (k + good[x] + 1) for x, k in bad.items() if k >= toxicity.MIN_DOCS
                and low(k, k + good[x]) >= (toxicity.CERTAIN_BEGINNING if x[-1] == "*" else toxicity.CERTAIN)}

    want = count(lambda w: w)
    whole = set(want)
    want |= count(lambda w: {x[:n] + "*" for x in w - whole for n in toxicity.PREFIXES if len(x) > n})
    assert whole and sure == pytest.approx(want)
    left = sum(y > 0 and not toxicity.evidence(set(w.split("\n")), sure) for _, y, w in rows)
    assert rest == pytest.approx(left / (left + sum(y == 0 for _, y, _ in rows)))


def test_each_labelled_text_is_learned_once(spark):
    table = spark.createDataFrame([(1, True, 7, "one"), (2, True, 7, "one"), (3, True, 8, "two"),
                                   (4, False, 9, "three"), (5, None, 9, "three"), (None, True, 5, "x")],
                                  "_id int, _train boolean, h long, words string")
    marks = spark.createDataFrame([(1, 0.0), (2, 1.0), (4, 1.0), (5, 1.0)], "_lid int, _y double")
    assert [tuple(r) for r in toxicity.labelled(table, marks).collect()] == [(1, 1.0, "one")]


def test_toxicity_held_out_and_odd(spark, odd, none):
    rng = random.Random(4)
    plain = [w for w in "the read story house green water moon table chair music".split()]
    rows, marks = [], []
    for i in range(300):
        toxic = i % 5 == 0
        text = [rng.choice(plain) for _ in range(30)]
        if toxic:
            text[rng.randrange(30)] = rng.choice(["idiot", "moron"])
        rows.append(_row(i, " ".join(text)))
        marks.append((i, int(toxic)))
    rows += [_row(1000, "the house 1d10t read"), _row(1001, "green m.o.r.o.n water"),
             _row(1002, "the green house")]
    d = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame(marks + [(None, 1), (3, None), (5, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(d, labels, remainder("doc_id", 4) != 2).collect()}
    assert all(got[i].predicted == t for i, t in marks)
    assert [got[i].predicted for i in (1000, 1001, 1002)] == [1, 1, 0]
    for x in (odd, none):
        same(x, toxicity.score_toxicity(x, labels, F.lit(True)))
    assert {r.score for r in toxicity.score_toxicity(odd, labels.limit(0), F.lit(True)).collect()} == {0.0}


# ---- 7 decontamination


def test_wand_equals_full_scoring():
    rng = random.Random(0)
    vocabulary = [f"w{i}" for i in range(80)]
    index = decontaminate.build_index([(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 20))))
                                       for i in range(60)])
    for _ in range(200):
        query = sorted({index.terms[w] for w in rng.choices(vocabulary, k=25) if w in index.terms})
        score = Counter()
        for t in query:
            for item, w in zip(*index.postings[t]):
                score[item] += w
        for theta in (0.15, 0.3, 0.6):
            got = dict(decontaminate.block_max_wand(index, query, theta))
            want = {i: s for i, s in score.items() if s >= theta}
            assert {i for i in got.keys() ^ want.keys() if abs(score[i] - theta) > 1e-9} == set()
            assert all(abs(got[i] - score[i]) < 1e-9 for i in got)


def test_leaks(spark, docs, odd, none):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = bench.collect()
    want = {(d.doc_id, b.item_id) for d in docs.collect() for b in items if b.text in d.text}
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()}
    assert want and want <= got
    for d, i in got - want:       # the same words, other white space or marks
        text = decontaminate.words(docs.where(F.col("doc_id") == d).first().text)
        item = decontaminate.words(next(b.text for b in items if b.item_id == i))
        assert decontaminate.covered(item, text) >= 0.8
    ids = {d for d, _ in got}
    assert {r.doc_id for r in decontaminate.decontaminated(docs, bench).collect()} == {
        r.doc_id for r in docs.collect()} - ids
    awkward = spark.createDataFrame([(1, None), (2, ""), (3, "hello"), (None, "one two"), (3, "hello")],
                                    "item_id int, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(odd, awkward).collect()}
    assert {(5, 3), (6, None), (7, None)} == got
    for a, b in ((none, awkward), (odd, awkward.limit(0))):
        assert decontaminate.leaks(a, b).count() == 0


def test_retrieval_loses_nothing_that_verification_accepts(spark):
    """Items whose rarest words were changed, against coverage of every item by every text."""
    rng = random.Random(5)
    common, items, rows = [f"c{i}" for i in range(12)], [], []
    for i in range(60):
        rare = rng.randint(1, 4)
        text = [rng.choice(common) for _ in range(rng.choice([4, 15, 30, 45]))]
        for k, at in enumerate(rng.sample(range(len(text)), min(rare, len(text)))):
            text[at] = f"r{i}x{k}"
        items.append((i, " ".join(text)))
        for n in range(6):               # n rare words changed, or words anywhere
            new = list(text)
            at = [j for j, w in enumerate(text) if w[0] == "r"][:n] if n < 4 else rng.sample(
                range(len(text)), max(1, len(text) // 12))
            for j in at:
                new[j] = f"n{n}"
            rows.append((6 * i + n, " ".join(["x"] * rng.randint(0, 90) + new + ["y"] * 9)))
    split = {i: t.split() for i, t in items}
    want = {(d, i) for d, t in rows for i, w in split.items()
            if decontaminate.covered(w, t.split()) >= 0.8}
    index = decontaminate.build_index(items)
    assert index.need.min() < 0.5 and any(d % 6 in (1, 2) for d, _ in want)
    got = decontaminate.leaks(spark.createDataFrame(rows, "doc_id int, text string"),
                              spark.createDataFrame(items, "item_id int, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    # small chunks give the same
    kept, decontaminate.CHUNK = decontaminate.CHUNK, 64
    try:
        again = {(rows[n][0], index.items[k]) for n, k, *_ in decontaminate.search(
            index, [t.encode() for _, t in rows], 0.8)}
    finally:
        decontaminate.CHUNK = kept
    assert again == want


def test_block_maxima_are_kept_where_a_term_occurs():
    items = [(i, " ".join(f"w{i}x{k}" for k in range(50)) + " the") for i in range(400)]
    index = decontaminate.build_index(items)
    assert len(index.block_max) == 400 * 50 + index.blocks
    assert set(index.maxima(index.terms["the"])) == set(range(index.blocks))


# ---- 9 near duplicates


def brute_groups(rows, percent=90, width=3):
    sets = []
    for r in rows:
        w = words(ascii_lower(r.text or ""))
        sets.append(frozenset([tuple(w)] if 0 < len(w) < width else
                              [tuple(w[i:i + width]) for i in range(len(w) - width + 1)]))
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if rows[i].doc_id is not None and rows[j].doc_id is not None and (
                    a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both)
                    or rows[i].doc_id == rows[j].doc_id and a and sets[j]):
                up[find(i)] = find(j)
    low = defaultdict(list)
    for i, r in enumerate(rows):
        if r.doc_id is not None:
            low[find(i)].append(r.doc_id)
    return Counter((r.doc_id, len(s), min(low[find(i)], default=None))
                   for i, (r, s) in enumerate(zip(rows, sets)))


def test_jaccard_groups(spark, docs, odd, none):
    for d in (docs, odd):
        got = Counter(tuple(r) for r in jaccard_join.similar_groups(d).collect())
        assert got == brute_groups(d.collect())
    assert jaccard_join.similar_groups(none).count() == 0


@pytest.mark.parametrize("often", [32, 3])
def test_jaccard_of_variants(spark, often, monkeypatch):
    """Chains of edited copies, lengths around the class borders, much shared text."""
    monkeypatch.setattr(jaccard_join, "OFTEN", often)
    monkeypatch.setattr(jaccard_join, "BLOCK", 200)     # several blocks a hub
    rng = random.Random(often)
    fresh = iter(range(10**9))
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for base in range(12):
        n = rng.choice([3, 20, 34, 66, 130, 300])
        text = [f"b{base}x{i}" for i in range(n)] + (passage if base % 3 == 0 else [])
        for _ in range(rng.randint(1, 14)):
            copy = list(rng.choice([text, text, rows[-1].text.split() if rows and rng.random() < 0.5 else text]))
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = f"e{next(fresh)}"
            rows.append(type("R", (), {"doc_id": len(rows), "text": " ".join(copy)}))
    df = spark.createDataFrame([(r.doc_id, r.text) for r in rows], "doc_id long, text string").repartition(3)
    got = Counter(tuple(r) for r in jaccard_join.similar_groups(df).collect())
    assert got == brute_groups(rows)


def test_prefix_signatures_lose_no_link():
    rng = np.random.default_rng(5)
    for n in (5, 31, 40, 64, 130, 500):
        a = np.unique(rng.integers(0, 1 << 60, n).astype(np.uint64))
        frequent = a[rng.random(len(a)) < 0.7]
        for _ in range(30):
            b = a
            drop = rng.integers(0, len(a) // 19 + 1)
            b = np.delete(a, rng.choice(len(a), drop, replace=False))
            extra = len(a) // 19 - drop if rng.random() < 0.5 else 0
            b = np.unique(np.concatenate([b, rng.integers(0, 1 << 60, max(0, extra)).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both < 90 * (len(a) + len(b) - both):
                continue
            sign = [{(c, x) for c, rare, pairs, _ in jaccard_join.signatures(s, np.sort(frequent), 90)[0]
                     for x in np.concatenate([rare, pairs]).tolist()} for s in (a, b)]
            assert sign[0] & sign[1]


def test_components(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(60)] + [(200 + rng.randrange(90), 200 + rng.randrange(90))
                                               for _ in range(50)] + [(500, 500 + i) for i in range(40)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {x: find(x) for x in up if find(x) != x}


# ---- 10 quality rules


def brute_counts(text):
    w = words(text)
    windows = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    times = Counter(windows)
    hit = {i + k for i, x in enumerate(windows) if times[x] > 1 for k in range(8)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit))


def test_quality_rules(spark, docs, odd, none):
    for d in (docs, odd):
        rows = quality_rules.judge_quality(d).collect()
        got = Counter(tuple(r)[:7] for r in rows)
        want = Counter()
        for r in d.collect():
            c = brute_counts(r.text)
            want[(r.doc_id, *c, c[0] < 20 or 100 * c[4] > 30 * c[0])] += 1
        assert got == want
        assert not any(r.kept and r.base_failed for r in rows)
    assert quality_rules.judge_quality(none).count() == 0


def test_repeated_words_property():
    rng = random.Random(6)
    for _ in range(300):
        w = [rng.choice("abc") for _ in range(rng.randint(0, 60))]
        assert stats.repeated_words([x.encode() for x in w]) == brute_counts(" ".join(w))[4]


def test_outliers_go_and_clean_texts_stay(spark):
    rng = random.Random(9)
    rows = []
    for i in range(400):
        w = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(rng.randint(40, 200))]
        text = " ".join(w).capitalize() + "."
        if i % 4 == 0:
            text = " ".join(x + "###" for x in w)
        rows.append(_row(i, text, "en", "a" if i % 3 else None))
    got = {r.doc_id: r.kept for r in quality_rules.judge_quality(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(got[i] == (i % 4 != 0) for i in got)


def test_concentration_step_equals_brute_force(spark):
    """One step from the floor: the mean of the nearest rows, up to the bin of the quantile."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, quality_rules.P)) * np.array(quality_rules.FLOOR) * 3
    cols = [f"x{i}" for i in range(quality_rules.P)]
    df = spark.createDataFrame([("g", *map(float, r)) for r in x],
                               "_g string, " + ", ".join(f"{c} double" for c in cols)).repartition(4)
    start = np.diag(1 / np.square(quality_rules.FLOOR)).ravel().tolist()
    est = spark.createDataFrame([("g", [0.0] * quality_rules.P, start, 1.0)],
                                "_g string, _m array<double>, _inv array<double>, _ratio double")
    got = quality_rules._step(df, est, 0.6).first()
    d = (np.square(x / np.array(quality_rules.FLOOR))).sum(1)
    b = np.floor(np.log2(d + 1e-9) * quality_rules.BINS_PER_DOUBLING)
    keep = b <= np.sort(b)[int(np.ceil(0.6 * len(d))) - 1]
    assert np.allclose(got["_m"], x[keep].mean(0))
    cov = np.cov(x[keep].T, bias=True) + np.diag(np.square(quality_rules.FLOOR))
    assert np.allclose(np.array(got["_inv"]).reshape(quality_rules.P, -1), np.linalg.inv(cov))


# ---- pipeline


def test_pipeline(spark, odd, none, library):
    pipeline = pytest.importorskip("corpus_pipeline")
    for start in (odd, none):
        docs = start
        for name, stage in pipeline.STAGES:
            out = stage(spark, docs, SF)
            if name != "best_fit_packing":
                assert out.dtypes == docs.dtypes
                assert out.exceptAll(docs).count() == 0
            docs = out
    run = pipeline.run(spark, SF)
    whole = spark.read.parquet(f"{SF}/documents.parquet")
    ids = {r.doc_id for r in run.collect()}
    kept = {r.doc_id for r in quality_rules.judge_quality(whole).where("kept").collect()}
    groups = {r.doc_id: r.component_id for r in jaccard_join.similar_groups(
        whole.where(F.col("doc_id").isin(list(kept))), percent=80, width=5).collect()}
    leaks = {r.doc_id for r in decontaminate.leaks(whole, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert ids == {d for d in kept if groups[d] == d} - leaks


def test_pipeline_near_duplicates_by_five_words(spark, docs):
    """Copies with an appendix or scattered edits go, as by brute force at five words and 0.8."""
    pipeline = pytest.importorskip("corpus_pipeline")
    text = [f"w{i}" for i in range(400)]
    longer = text + [f"x{i}" for i in range(60)]
    edited = [f"e{i}" if i % 50 == 25 else w for i, w in enumerate(text)]
    other = [f"f{i}" if i % 20 == 10 else w for i, w in enumerate(text)]
    rows = [_row(10_000 + i, " ".join(t)) for i, t in enumerate((text, longer, edited, other))]
    d = docs.select("doc_id", "text").unionByName(
        spark.createDataFrame(rows, DOCS).select("doc_id", "text"))
    want = {i for i, _, low in brute_groups(d.collect(), 80, 5) if i == low}
    got = {r.doc_id for r in pipeline.ngram_jaccard(spark, d, SF).collect()}
    assert got == want
    assert got & {10_000, 10_001, 10_002, 10_003} == {10_000, 10_003}


# ---- main text: depth, broken markup, many siblings


def _page_of(body):
    return f"<html><body><nav>menu</nav><article>{body}</article><div class=sidebar>side</div></body></html>"


def test_main_text_at_any_depth():
    deep = "<div>" * 900 + "<p>inmost</p><nav>hidden</nav>" + "</div>" * 900 + "<p>after</p>"
    assert wrapper.extract([_page_of(deep)]) == ["inmost after"]
    pages = [_page_of(deep.replace("inmost", f"inmost {i}")) for i in range(3)]
    assert wrapper.extract(pages) == [f"inmost {i} after" for i in range(3)]


def test_broken_markup_is_read_once():
    import time

    start = time.time()
    for text in ("<a " * 200_000, "<div>" * 30_000 + "</b>" * 30_000, "<span>" * 30_000 + "<p>x</p>" * 3000,
                 "<p>x <!-- " * 20_000, "<li>" * 20_000, "<a '" * 50_000 + ">"):
        wrapper.extract([text])
    assert time.time() - start < 60
    assert wrapper.extract(["<p>a</p> b <!-- gone <p>c</p> gone"]) == ["a b"]
    assert wrapper.extract(["<p>a</p> b <!-- gone"]) == ["a b"]
    assert wrapper.extract(["<p>1 < 2 and <em"]) == ["1 < 2 and <em"]


def test_many_siblings():
    import time

    def page(n, tag):
        rows = "".join(f"<tr><td>{tag} {i}</td><td><div>x</div>{i * n}</td></tr>" for i in range(n))
        return _page_of(f"<table>{rows}</table>")

    start = time.time()
    got = wrapper.extract([page(2000, "a"), page(1990, "b"), page(1500, "c")])
    assert time.time() - start < 60
    assert got[2].startswith("c 0 x 0 c 1 x 1500") and got[2].count("x") == 1500
