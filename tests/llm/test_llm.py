"""Operators for training data against brute force, exact round trips and held-out accuracy."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import catalog, embeddings, html_text, language, minhash, mixing, packing, quality, secret_scan, suffixes, token_store, tokens

from ..conftest import SF, plain, same_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"word{k % 997}x{k * k % 131}" for k in range(60_000))
#: Nulls everywhere, empty, blank and very long texts, ties, repeated rows, and clashing extra columns.
NASTY = [
    (1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", "en", None), (4, "one", "de", "b"), (5, "one", "de", "b"), (5, "one", "de", "b"),
    (None, "a text without an id stands here today for all to see", "fr", "a"), (None, None, None, None), (6, LONG, "en", "b"), (7, LONG, None, "c"), (8, "é ñ 漢字 \x00   ￿ 😀", "es", "c"),
    (9, "the same " * 40, "en", "c"), (10, "token = 'abcdef1234' AKIA" + "A" * 16 + " " + "0f" * 12, "en", "a"),
]
COLUMNS = "doc_id long, text string, lang string, source string"
CLASHES = ["_size", "_pass", "_passes", "_base", "_all", "_added", "_k1", "_k2", "_cuts", "_q_words", "size", "key", "k1", "rank", "n", "passes", "kept", "score", "n_words", "component", "base", "spans", "low", "band", "value", "a", "b", "u", "v", "start", "length", "label", "target"]


@pytest.fixture(scope="module")
def nasty(spark):
    t = spark.createDataFrame(NASTY, COLUMNS)
    return t.select("*", *[F.lit(f"x-{c}").alias(c) for c in CLASHES])


@pytest.fixture(scope="module")
def empty(nasty):
    return nasty.where("1 = 0")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, duck, name):
    same_rows(catalog.QUERIES[name](spark, SF), duck, catalog.ORACLES[name])


# 1 ---------------------------------------------------------------- repeated passages


def brute_repeats(rows, size):
    words = [(i, (t or "").encode().split()) for i, t in rows if i is not None]
    where = collections.defaultdict(set)
    for i, w in words:
        for k in range(len(w) - size + 1):
            where[tuple(w[k : k + size])].add(i)
    out = set()
    for i, w in words:
        for later in (False, True):
            run = None
            for k in range(len(w) - size + 2):
                have = k <= len(w) - size and len(where[tuple(w[k : k + size])]) > 1 and (min(where[tuple(w[k : k + size])]) < i) == later
                if have and run is None:
                    run = k
                elif not have and run is not None:
                    out.add((i, later, run, k - 1 + size))
                    run = None
    return out


def spans_of(df):
    return {(r.doc_id, r.later, r.start_word, r.end_word) for r in df.collect()}


def test_repeats_match_brute_force(docs, texts):
    assert spans_of(suffixes.repeats(docs)) == brute_repeats(texts.items(), 50)


def test_repeats_of_short_passages(spark):
    rng = np.random.default_rng(3)
    rows = [(k, " ".join(rng.choice(["a", "b", "c"], 40))) for k in range(30)] + [(99, None), (98, ""), (97, "a b")]
    found = suffixes.repeats(spark.createDataFrame(rows, "doc_id long, text string"), passage=8, run=3)
    assert spans_of(found) == brute_repeats(rows, 8)


def test_repeats_edges(nasty, empty):
    assert spans_of(suffixes.repeats(nasty)) == {(6, False, 0, 60_000), (7, True, 0, 60_000)}
    assert suffixes.repeats(empty).count() == 0


def test_cut_repeats(spark):
    shared = " ".join(f"w{k}" for k in range(60))
    t = spark.createDataFrame([(1, f"x {shared} y"), (2, f"p q {shared} r"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in suffixes.cut_repeats(t, suffixes.repeats(t)).collect()}
    assert got == {1: f"x {shared} y", 2: "p q r", 3: None}


# 2 ---------------------------------------------------------------- pages


def test_main_text_of_templates():
    long = " ".join(["Word by word the story of the valley is told to those who came late."] * 6)
    page = f"<html><head><title>T</title><style>p{{}}</style></head><body><header><h2>Site</h2></header><nav><a href=/>Home</a></nav><div class='ad'>Buy now</div><article><h1>Head&amp;line</h1><p>{long}<p>Second&nbsp; part <b>bo</b>ld<br>line<aside>Read also this</aside><p>Last.</article><div id='comments'><p>{long}</p></div><footer>&copy; X</footer>"
    assert html_text.main_text(page) == f"Head&line\n\n{long}\n\nSecond part bold line\n\nLast."
    bare = f"<body><ul><li><a href=1>One</a><li><a href=2>Two</a></ul><div><p>{long}</p><p>{long}</p></div><form><input><button>Go</button></form><script>if (a < b) {{ c('</p>') }}</script></body>"
    assert html_text.main_text(bare) == f"{long}\n\n{long}"


def test_teaser_articles_leave_the_unmarked_body():
    body = " ".join(["The road runs on past the last farm."] * 125)
    for before, after in (("", "<article class=card><h3>Teaser</h3><p>Read more of this.</p></article>"), ("<main><p>Start here.</p></main>", "")):
        text = html_text.main_text(f"<body><nav><a href=/>Home</a></nav>{before}<div><p>{body}</p></div>{after}<footer>End</footer></body>")
        assert body in text.split("\n\n") and "Home" not in text and "End" not in text
        short = "<p>" + "</p><p>".join(f"Line {k} says what was seen on the road." for k in range(40)) + "</p>"
        text = html_text.main_text(f"<body>{before}<div>{short}</div>{after}</body>")
        assert all(f"Line {k} says what was seen on the road." in text for k in range(40))


def test_labelled_pages_keep_their_main_text():
    """Fitted weights lose few words, and none of the pages whose text stands in an article or main element."""
    words = collections.Counter()
    for parts in html_text.PAGES:
        want = html_text.main_text("".join(part for good, part in parts if good)).split()
        got = html_text.main_text("".join(part for _, part in parts)).split()
        words.update(all=len(want), lost=len(want) - (collections.Counter(want) & collections.Counter(got)).total(), added=(collections.Counter(got) - collections.Counter(want)).total())
    assert words["lost"] <= 0.01 * words["all"] and words["added"] <= 0.03 * words["all"], words


@pytest.mark.parametrize("name", ["content with-sidebar", "has-nav", "post no-comments", "entry search-result", "story legal", "page"])
@pytest.mark.parametrize("tag", ["article", "div", "section"])
def test_layout_names_do_not_lose_the_text(name, tag):
    text = "The road runs on past the last farm and ends at the sea, and few walk it in winter."
    page = f"<body><nav><a href=/>Home</a></nav><{tag} class='{name}'><h1>Head</h1><p>{text}</p><p>{text}</p></{tag}><footer>End</footer></body>"
    assert html_text.main_text(page) == f"Head\n\n{text}\n\n{text}"


def test_comments_without_a_class_and_links_at_any_depth():
    text = "The road runs on past the last farm and ends at the sea, and few walk it in winter."
    for head in ("Comments", "3 Kommentare", "Comentarios (2)", "Leave a comment"):
        page = f"<body><article><p>{text}</p><p>{text}</p></article><div><h3>{head}</h3><div><b>Anna</b><p>{text} So true.</p></div></div></body>"
        assert html_text.main_text(page) == f"{text}\n\n{text}"
    assert html_text.main_text(f"<body><article><h2>Comments on the budget</h2><p>{text}</p></article></body>") == f"Comments on the budget\n\n{text}"
    deep = html_text.runs("<a href=x><span><b><i><u>far in</u></i></b></span></a>")
    assert [k for k, _, t, _ in deep if t] == ["link"]


def test_unmarked_pages_against_all_regions():
    """Without marks the text is that of the region with the highest sum, by trying all of them."""
    rng = np.random.default_rng(8)
    table = html_text.weights()
    for _ in range(60):
        parts = [rng.choice(["<p>{}</p>", "<div><a href=x>{}</a></div>", "<h2>{}</h2>", "<ul><li>{}</li></ul>", "<div>{}</div>"]).format(" ".join(f"w{k}x{j}" for j in range(rng.integers(1, 12)))) for k in range(rng.integers(1, 9))]
        page = f"<body>{''.join(parts)}</body>"
        found = html_text.runs(page)
        scores = [table[html_text._feature(kind, around)] * (len(t.split()) if kind in ("word", "link") else 1) for kind, around, t, _ in found]
        sums = {(i, j): sum(scores[i:j]) for i in range(len(found)) for j in range(i + 1, len(found) + 1)}
        top = max(sums.values(), default=0)
        got = html_text.main_text(page).split()
        options = [[w for _, _, t, _ in found[i:j] for w in t.split()] for (i, j), total in sums.items() if abs(total - top) < 1e-9] if top > 0 else [[]]
        assert got in options


@pytest.mark.parametrize("name", ["article class='post category-legal'", "article class='tag-search'", "main id='social-media'"])
def test_class_names_do_not_lose_an_article(name):
    text = "The road runs on past the last farm and ends at the sea."
    page = f"<body><div class='social'>Share this</div><{name}><h1>Head</h1><p>{text}</p></{name.split()[0]}></body>"
    assert html_text.main_text(page) == f"Head\n\n{text}"
    assert html_text.main_text(page.replace(name, f"{name} hidden")) == ""


def test_tags_are_negative_beside_positive_words():
    for (kind, around), weight in html_text.weights().items():
        if around in ("main", "plain", "beside") and kind != "link":
            assert weight > 0 if kind == "word" else weight < 0


@pytest.mark.parametrize("page", [None, "", "  ", "<div class=ad>x</div>", "<nav><a>b</a></nav>", "<!-- only -->"])
def test_pages_without_text(page):
    assert html_text.main_text(page) == ""


def test_best_region_is_the_maximum():
    rng = np.random.default_rng(1)
    for _ in range(200):
        scores = rng.normal(size=12).round(2).tolist()
        a, b = html_text.best_region(scores)
        assert sum(scores[a:b]) == pytest.approx(max([0] + [sum(scores[i:j]) for i in range(12) for j in range(i + 1, 13)]))


def test_pages_of_the_table(spark):
    for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html").collect():
        inside = r.html.split("<article>", 1)[1].split("</article>")[0]
        import html

        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>?", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", inside)]
        assert html_text.main_text(r.html) == "\n\n".join(b for b in blocks if b)


def test_page_rows(spark):
    t = spark.createDataFrame([(1, "u", None, "x"), (1, "u", None, "x"), (None, None, "<p>" + "a " * 200_000, "y")], "page_id long, url string, html string, text string")
    assert sorted(r.n_chars for r in html_text.extract(t).collect()) == [0, 0, 399_999]
    assert html_text.extract(t.where("1 = 0")).count() == 0


# 3 ---------------------------------------------------------------- languages


def test_language_accuracy_on_held_out(spark, docs):
    t = language.op3_language(spark, SF).join(docs.select("doc_id", "lang"), "doc_id")
    assert t.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] >= 0.98
    assert t.where("score < 0 OR score > 1").count() == 0
    assert {r.doc_id for r in t.where("held_out").collect()} == {r.doc_id for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}


def test_model_probabilities_sum_to_one(spark):
    rows = spark.createDataFrame([("x", "abab ba"), ("y", "aab bb ab")], "lang string, text string")
    model = language.train(rows)
    for context in ([97, 98, 97], [98, 98, 0], [0, 0, 97]):
        keys = np.array([(context[0] << 48) | (context[1] << 32) | (context[2] << 16) | c for c in (0, 97, 98)], dtype=np.uint64)
        total = np.exp(model.log_probabilities(keys)).sum(axis=0)
        assert (total < 1).all() and (total > 0.85).all()  # the rest is for unseen characters


def test_language_edges(nasty, empty):
    got = language.identify(nasty, language.train(nasty)).collect()
    assert len(got) == len(NASTY)
    assert all((r.lang_pred == "und") == (r.score == 0) for r in got if r.doc_id in (1, 2, 3))
    assert {r.lang_pred for r in got if r.doc_id in (1, 2, 3)} == {"und"}
    assert {r.lang_pred for r in language.identify(nasty, language.train(empty)).collect()} == {"und"}
    assert language.identify(empty, language.train(nasty)).count() == 0


def brute_kneser_ney(texts, key, lang):
    """Log-probability of a run by the formula, over all runs of {lang: texts}."""
    held = {k: dict(zip(*(a.tolist() for a in np.unique(language.grams(*language.codes(v))[0], return_counts=True)))) for k, v in texts.items()}
    held = {4: held}
    for order in (3, 2, 1):
        held[order] = {}
        for k, runs in held[order + 1].items():
            kinds = held[order][k] = {}
            for run in runs:
                short = run & ((1 << (16 * order)) - 1)
                kinds[short] = kinds.get(short, 0) + 1
    p = 1 / (len(set().union(*held[1].values())) + 1)
    for order in (1, 2, 3, 4):
        own = key & ((1 << (16 * order)) - 1)
        peers = [n for run, n in held[order][lang].items() if run >> 16 == own >> 16]
        if peers:
            p = max(held[order][lang].get(own, 0) - 0.75, 0) / sum(peers) + 0.75 * len(peers) / sum(peers) * p
    return np.log(p)


@pytest.mark.parametrize("cells", [1 << 22, 80])
def test_shards_hold_the_whole_model(spark, monkeypatch, cells):
    monkeypatch.setattr(language, "SHARD_CELLS", cells)
    texts = {"x": ["abab ba cab", "a bad cab"], "y": ["aab bb ab", "eta dab ab"], "z": ["ωδω ab"]}
    rows = spark.createDataFrame([(k, t) for k, v in texts.items() for t in v], "lang string, text string").coalesce(1)
    model = language.train(rows)
    assert model.langs == ["x", "y", "z"] and (len(model.shards) > language.HELD_SHARDS) == (cells == 80)
    rng = np.random.default_rng(3)
    keys = [sum(int(rng.choice([0, 97, 98, 99, 100, 969, 948, 120])) << (16 * k) for k in range(4)) for _ in range(150)]
    keys += np.unique(language.grams(*language.codes(sum(texts.values(), [])))[0]).tolist()
    want = [[brute_kneser_ney(texts, key, k) for k in model.langs] for key in keys]
    assert np.allclose(model.log_probabilities(np.array(keys, dtype=np.uint64)), want, atol=1e-4)
    assert [r.lang_pred for r in language.identify(spark.createDataFrame([(1, "ωδω")], "doc_id long, text string"), model).collect()] == ["z"]


def test_predictions_do_not_depend_on_other_texts(spark):
    rows = spark.createDataFrame([("x", "ab ab ba abba"), ("y", "AB AC CA".lower() + " cc ca")], "lang string, text string")
    model = language.train(rows)
    texts = ["ABAB ABBA", "İstanbul", "CACA CC", "ǅ ß ΑΣ", "\U0001d400\U00010000 ab", ""]
    together = model.predict(texts)
    for k, text in enumerate(texts):
        alone = model.predict([text])
        assert alone[0][0] == together[0][k] and alone[1][0] == pytest.approx(together[1][k])
    assert language.codes(["HELLO World", "İstanbul"])[0][1:6].tolist() == [104, 101, 108, 108, 111]
    high = language.codes(["\U0001d400\U00010000"])[0]
    assert (high[1:3] >= 0xD800).all() and (high < 0x10000).all()
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts * 30)], "doc_id long, text string")
    told = [{r.doc_id: (r.lang_pred, round(r.score, 9)) for r in language.identify(docs.repartition(n), model).collect()} for n in (1, 7)]
    assert told[0] == told[1]


def test_calibration_covers_all_training_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(lang, " ".join("".join(rng.choice(list(letters), 5)) for _ in range(12))) for lang, letters in (("x", "abcde"), ("y", "cdefg")) for _ in range(150)]
    t = spark.createDataFrame(rows, "lang string, text string")
    model = language.train(t)
    for k, lang in enumerate(model.langs):
        entropy = model.entropies([text for own, text in rows if own == lang])[0][:, k]
        assert model.spread[k] == pytest.approx(max(entropy.std(), 0.02), rel=1e-6) and model.limits[k] == pytest.approx(entropy.mean() + language.LIMIT * model.spread[k], rel=1e-6)
    assert model.temperature in language.TEMPERATURES


def test_rare_language_beside_a_large_one(spark):
    letters = np.random.default_rng(5).integers(0x4E00, 0x9000, 450_000)
    big = "".join(map(chr, letters.tolist()))
    rows = spark.createDataFrame([("big", big), ("big", big), ("rare", "the quick brown fox jumps")], "lang string, text string")
    model = language.train(rows)
    assert model.langs == ["big", "rare"]
    assert sum(int((~np.isnan(s.value[4][1])).sum()) for s in model.shards) == rows.transform(language.count_runs).count() > 400_000
    docs = spark.createDataFrame([(1, "the brown fox"), (2, big[1000:1040])], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in language.identify(docs, model).collect()} == {1: "rare", 2: "big"}


# 4, 5 ------------------------------------------------------------- tokens


def direct(text):
    ids = tokens.encoder(tokens.default_path()).tokenizer.encode(text or "", add_special_tokens=False).ids
    return np.array(ids + [2], dtype="<u4")


def test_encoder_agrees_with_the_library():
    rng = np.random.default_rng(2)
    tool = tokens.encoder(tokens.default_path())
    alphabet = list(" \n\t  ab'sé1_.², 漢")
    for _ in range(2000):
        text = "".join(rng.choice(alphabet, rng.integers(1, 16)))
        assert tool.encode(text) == tool.whole(text), repr(text)
    for text in ("<|endoftext|> a", "a\x00b", "it's we'll 'tis", "  lead", "trail  "):
        assert tool.encode(text) == tool.whole(text)


def test_planes_round_trip():
    rng = np.random.default_rng(4)
    for n, top in ((0, 1), (1, 1), (5, 2**32), (40_000, 50_257), (16_384, 255)):
        ids = rng.integers(0, top, n, dtype=np.uint64).astype("<u4")
        assert (token_store.unpack_planes(token_store.pack_planes(ids)) == ids).all()


def test_store_matches_direct_encoding(spark, texts):
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_store.op5_token_store(spark, SF).collect())
    at, expected = 0, []
    for i in sorted(texts):
        ids = direct(texts[i])
        expected.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == expected


def test_store_edges(spark, nasty, empty, tmp_path):
    token_store.write_tokens(nasty, f"file://{tmp_path}/t")
    rows = token_store.read_index(spark, f"file://{tmp_path}/t").orderBy("start").collect()
    assert [r.doc_id for r in rows] == sorted([r[0] for r in NASTY], key=lambda i: (i is not None, i or 0))
    assert [r.start for r in rows] == np.cumsum([0] + [r.n_tokens for r in rows]).tolist()[:-1]
    token_store.write_tokens(empty, f"file://{tmp_path}/e")
    assert token_store.read_index(spark, f"file://{tmp_path}/e").count() == 0


def check_packing(rows, capacity):
    places = collections.defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for items in places.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def test_packing_places_every_piece(spark, texts):
    rows = packing.op4_packing(spark, SF).collect()
    used = check_packing(rows, 1024)
    assert used <= 1.03 * -(-sum(r.length for r in rows) // 1024) + 1
    by = collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    for i, text in texts.items():
        ids, at = direct(text), 0
        own = sorted(by[i], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and all(r.length == 1024 for r in own[1:])
        for r in own:
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)


def test_packing_edges(nasty, empty):
    rows = packing.pack(nasty).collect()
    check_packing(rows, 1024)
    assert sum(r.piece == 0 for r in rows) == len(NASTY)
    assert packing.pack(empty).count() == 0


def test_plan_is_near_the_bound():
    rng = np.random.default_rng(6)
    for histogram in (rng.integers(0, 50, 257), np.bincount(rng.integers(1, 60, 5000), minlength=257), np.bincount([200] * 7 + [57] * 3, minlength=257)):
        histogram = np.concatenate(([0], histogram[1:])).astype(np.int64)
        groups = packing.plan(histogram, 256)
        held = np.zeros(257, dtype=np.int64)
        for lengths, n in groups:
            assert sum(lengths) <= 256
            for v in lengths:
                held[v] += n
        assert (held == histogram).all()
    assert packing.plan(np.zeros(257, dtype=np.int64), 256) == []


# 6 ---------------------------------------------------------------- quality


def brute_base(text):
    w = WORD.findall(text)
    count = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    covered = {k + j for k in range(len(w) - 4) if count[tuple(w[k : k + 5])] > 1 for j in range(5)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), again, len(covered)


def test_quality_base_and_verdicts(spark, texts):
    rows = quality.op6_quality(spark, SF).collect()
    for r in rows:
        e = brute_base(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == e
        assert r.base_failed == (e[0] < 10 or 100 * e[4] > 20 * e[0])
        assert not (r.base_failed and r.kept)
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    clean = [r for r in rows if r.doc_id in labels and labels[r.doc_id].quality == 1 and not r.base_failed]
    junk = [r for r in rows if r.doc_id in labels and labels[r.doc_id].quality == 0]
    assert np.mean([r.kept for r in clean]) >= 0.99 and np.mean([r.kept for r in junk]) <= 0.15


def test_quality_weights_match_brute_force(spark):
    rows = [(1, "a b, a"), (2, "c ** a"), (3, None), (4, "b")]
    t = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")

    def grams(text):
        c = [zlib.crc32(x.encode()) for x in re.findall(r"\w+|[^\w\s]+", text or "")]
        return [x % quality.BUCKETS for x in c] + [(x * quality.PAIR + y) % quality.BUCKETS + quality.BUCKETS for x, y in zip(c, c[1:])]

    raw, good = collections.Counter(g for _, x in rows for g in grams(x)), collections.Counter(grams("a b, a"))
    size = 2 * quality.BUCKETS
    weight = lambda g: round(1e6 * (np.log((good[g] + 1) / (raw[g] + 1)) - np.log((sum(good.values()) + size) / (sum(raw.values()) + size))))
    got = {r.doc_id: r.score for r in quality.assess(t, labels).collect()}
    for i, text in rows:
        g = grams(text)
        assert got[i] == (pytest.approx(sum(map(weight, g)) / len(g) / 1e6, abs=1e-9) if g else None)


def test_quality_edges(spark, nasty, empty):
    labels = spark.createDataFrame([(6, 1, 0), (6, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int")
    out = quality.assess(nasty, labels)
    assert out.count() == len(NASTY) and len(set(out.columns)) == len(out.columns)
    assert quality.assess(nasty, labels.where("1 = 0")).where("kept").count() == 3
    assert quality.drop_failing(nasty, labels).columns == nasty.columns
    assert quality.assess(empty, labels).count() == 0


# 7 ---------------------------------------------------------------- embeddings


def brute_links(rows):
    out = {}
    good = [(i, v, l) for i, v, l in rows]
    for i, v, l in good:
        n, near = 0, []
        for j, w, m in good:
            if j != i and l is not None and l == m and np.dot(v, w) / (np.linalg.norm(v) * np.linalg.norm(w)) >= 0.93:
                near.append(j)
        out[i] = near
    return out


def test_embeddings_recall_and_components(spark):
    rng = np.random.default_rng(8)
    centers = rng.normal(size=(40, 64))
    rows = []
    for k in range(600):
        v = centers[k % 40] + rng.normal(size=64) * rng.choice([0.02, 0.2, 0.27, 0.35])
        rows.append((k, [float(np.float32(x)) for x in v], k % 3))
    near = brute_links([(i, np.array(v), l) for i, v, l in rows])
    got = {r.vec_id: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    links = sum(map(len, near.values()))
    assert links > 500 and sum(r.n_links for r in got.values()) >= 0.99 * links
    assert all(r.n_links <= len(near[i]) for i, r in got.items())
    for i, r in got.items():
        assert r.kept == (r.component_id == i) and (r.n_links or r.component_id == i)


def test_embeddings_edges(spark):
    one = [1.0, 0.0, 0.0]
    rows = [(1, one, 1), (2, one, 1), (2, one, 1), (3, [2.0, 0.0, 0.0], 1), (4, one, None), (5, None, 1), (6, [0.0, 0.0, 0.0], 1), (7, [float("nan"), 1.0, 0.0], 1), (8, [None, 1.0, 0.0], 1), (9, one, 2), (None, one, 1), (10, [], 1), (11, [float("inf"), 0.0, 0.0], 1)]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("code", F.lit("x")).withColumn("key", F.lit("x"))
    got = sorted(((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in embeddings.near_duplicates(t).collect()))
    assert got == [(0, 0, 0, True), (1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), (3, 3, 1, False), *[(k, 0, k, True) for k in (4, 5, 6, 7, 8, 9, 10, 11)]]
    assert embeddings.near_duplicates(t.where("1 = 0")).count() == 0


# 8 ---------------------------------------------------------------- near copies


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(9)
    for share in (0.2, 0.5, 0.8, 0.95):
        both = rng.integers(0, 2**63, int(2000 * share), dtype=np.uint64)
        own = [rng.integers(0, 2**63, (2000 - len(both)) // 2, dtype=np.uint64) for _ in range(2)]
        sets = [np.concatenate((both, x)) for x in own]
        r = minhash.sketch(np.concatenate(sets), np.repeat([0, 1], [len(s) for s in sets]), 2, 1024)
        true = len(both) / (len(both) + sum(map(len, own)))
        guess = minhash.pair_similarity(r[:1], r[1:], np.array([len(sets[0])]), np.array([len(sets[1])]))[0]
        assert abs(guess - true) < 0.06
        merged = minhash.sketch(np.concatenate(sets), np.zeros(sum(map(len, sets)), dtype=np.int64), 1, 1024)
        assert (merged[0] == np.maximum(r[0], r[1])).all()


def test_copies_beyond_the_least_member_are_found(spark):
    """A chain: neighbours are near, the ends are not."""
    base = [f"w{k}" for k in range(400)]
    rows = []
    for k in range(12):
        words = list(base)
        for j in range(k):
            words[j * 30] = f"new{j}"
        rows.append((k, " ".join(words)))
    rows += [(k + 50, " ".join(f"z{k}{j}" for j in range(50))) for k in range(20)]
    t = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(t).collect()}
    assert all(got[k] == 0 for k in range(12)) and all(got[k] == k for k in range(50, 70))


def test_near_duplicates_edges(nasty, empty):
    rows = minhash.near_duplicates(nasty).collect()
    assert len(rows) == len(NASTY)
    told = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows if r.doc_id is not None}
    assert told[1] == (0, 1, True) and told[3] == (0, 3, True) and told[4] == (1, 4, True) and told[5] == (1, 4, False) and told[7][1:] == (6, False)
    assert minhash.near_duplicates(empty).count() == 0
    kept = minhash.drop_near_duplicates(nasty)
    assert kept.columns == nasty.columns and 7 not in {r.doc_id for r in kept.collect()}


def brute_groups(rows, percent):
    """Smallest id of each document's group, over all pairs of full sets."""
    sets = []
    for _, text in rows:
        words = [w.lower() for w in WORD.findall(text or "")]
        sets.append({tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set())
    root = list(range(len(rows)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            same_id = rows[i][0] is not None and rows[i][0] == rows[j][0]
            common = len(sets[i] & sets[j])
            if (sets[i] and sets[j] and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common)) or (same_id and sets[i] and sets[j]):
                root[max(top(i), top(j))] = min(top(i), top(j))
    groups = collections.defaultdict(list)
    for k in range(len(rows)):
        groups[top(k)].append(k)
    return groups


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_against_all_pairs(spark, percent):
    rng = np.random.default_rng(percent)
    rows = []
    for base in range(25):
        words = [f"w{base}x{k}" for k in range(int(rng.integers(3, 120)))]
        for copy in range(int(rng.integers(1, 6))):
            own = [w if rng.random() > 0.012 * copy else f"n{len(rows)}y{k}" for k, w in enumerate(words)]
            rows.append((len(rows) * 7 % 101, " ".join(own)))
    rows += [(rows[0][0], "another text stands by the id of the first one here"), (None, rows[3][1]), (None, rows[3][1]), (500, "\t"), (500, "\t")]
    rows = rows + [rows[5], rows[5]]
    t = spark.createDataFrame(rows, "doc_id long, text string")
    groups = brute_groups(rows, percent)
    want = collections.Counter()
    for members in groups.values():
        ids = [rows[k][0] for k in members if rows[k][0] is not None]
        for k in members:
            want[rows[k][0], min(ids) if ids else None] += 1
    got = collections.Counter((r.doc_id, r.component_id) for r in minhash.near_duplicates(t, percent).collect())
    assert got == want
    kept = [r.doc_id for r in minhash.drop_near_duplicates(t, percent).collect()]
    blank = [members for members in groups.values() if not (rows[members[0]][1] or "").strip()]
    assert len(kept) == len(groups) and sum(i == 500 for i in kept) == len(blank)
    heads = sorted(min((rows[k][0] for k in m if rows[k][0] is not None), default=-1) for m in groups.values())
    assert sorted(-1 if i is None else i for i in kept) == heads


# 9 ---------------------------------------------------------------- secrets


def brute_spans(text):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in sorted(found))


def test_spans_match_brute_force(spark):
    rng = np.random.default_rng(10)
    parts = ["token", "=", "api_key", ": ", '"', "'", " ", "abc123", "secret", "PassWd", "AKIA", "A1B2C3D4E5F6G7H8", "0f" * 13, "é😀", "\n", "x=", "short", "AKIAAKIA"]
    rows = [(k, "".join(rng.choice(parts, rng.integers(1, 14)))) for k in range(400)] + [(900, ("token=abcdef " * 3000)), (901, None), (902, "")]
    t = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("s"))
    got = {r.doc_id: r.b for r in secret_scan.scan(t).select("doc_id", secret_scan.told(F.col("base")).alias("b")).collect()}
    for i, text in rows:
        assert got[i] == brute_spans(text or ""), (i, text)


def test_ownership_separates_examples(spark):
    live, example = "Zq8" + "k3J" * 8, "Ex4" + "mpl" * 8
    rows = [(1, f"x {live} y {example}", "a"), (2, f"{example}", "b"), (3, f"{example}", "c"), (4, None, None)]
    got = {r.doc_id: [(x.s, x.e) for x in r.added] for r in secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got == {1: [(2, 29)], 2: [], 3: [], 4: []}


def test_redaction(nasty, empty):
    out = secret_scan.redact(nasty)
    assert out.columns == nasty.columns and out.count() == len(NASTY)
    assert {r.text for r in out.where("doc_id = 10").collect()} == {"[SECRET]' [SECRET] [SECRET]"}
    assert secret_scan.redact(empty).count() == 0 and secret_scan.scan(empty).count() == 0


# 10 --------------------------------------------------------------- mixing


def test_mix_is_near_its_targets(spark):
    rows = mixing.op10_mixing(spark, SF).collect()
    assert all(r.taken in (0, r.size, 2 * r.size) for r in rows)
    total = sum(r.size for r in rows)
    largest = max(r.size for r in rows)
    assert total * 1.5 - largest <= sum(r.taken for r in rows) <= total * 1.5
    taken = collections.Counter()
    for r in rows:
        taken[r.target, r.source_size] += r.taken
    assert all(abs(n - t) <= 2 * largest and t <= 2 * s for (t, s), n in taken.items())
    again = mixing.op10_mixing(spark, SF).collect()
    assert plain(again) == plain(rows)


def test_targets_are_filled_like_water(spark):
    sizes = [("a", 100), ("b", 1000), ("c", 10), ("d", 0), (None, 500)]
    weights = dict(zip([s for s, _ in sizes], (3, 1, 2, 3, 1)))
    budget, caps = 1.5 * sum(n for _, n in sizes), {s: 2 * n for s, n in sizes}
    goal, open_ = {}, set(weights)
    while True:
        share = (budget - sum(goal.values())) / (sum(weights[s] for s in open_) or 1)
        over = {s for s in open_ if share * weights[s] > caps[s]}
        if not over:
            break
        goal |= {s: float(caps[s]) for s in over}
        open_ -= over
    goal |= {s: share * weights[s] for s in open_}
    got = mixing.targets(spark.createDataFrame([(s, n, 1) for s, n in sizes], "source string, source_size long, n_docs long")).collect()
    assert {r.source: round(r.target, 6) for r in got} == {s: round(t, 6) for s, t in goal.items()}


def test_mix_edges(nasty, empty):
    assert mixing.mix_counts(nasty).count() == len(NASTY)
    out = mixing.mix(nasty)
    assert out.columns == nasty.columns
    assert mixing.mix(empty).count() == 0 and mixing.mix_counts(empty).count() == 0
