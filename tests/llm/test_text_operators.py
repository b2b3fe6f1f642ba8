import re
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarterdeck.llm import bpe, decontamination, html, language, licenses, packing, sharding, simple8b, words

PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, slot string, label string"
ODD = ["", None, "a", "don't you've we'll 'tis it's ''s !'s 're", "  a\n\n b\t\tc \n", "<|endoftext|> x", "naïve É×÷ ½ “q” 日本語\x1cy", "   ", "x" * 5000, "word " * 3000, "1 22 333a4 b"]


def docs(spark, texts, langs=None, ids=None):
    rows = [(k if ids is None else ids[k], t, langs[k] if langs else "en", "s", "l") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def reference_ids(texts):
    t = Tokenizer.from_file(PATH)
    return [x.ids for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoder_gives_the_library_s_ids():
    rng = np.random.default_rng(5)
    alphabet = list("ab'ts  \n\t.,!1É é—x")
    texts = ODD + ["".join(rng.choice(alphabet, n)) for n in rng.integers(0, 60, 500)]
    got = [None] * len(texts)
    for first, ids, at in bpe.Encoder(PATH, keep=50)(pa.array(texts)):
        for k in range(len(at) - 1):
            got[first + k] = ids[at[k] : at[k + 1]].tolist()
    assert got == reference_ids(texts)


def test_words_that_a_polynomial_hash_confuses():
    """Thue-Morse words of 2,048 bytes share every polynomial hash modulo 2**64."""
    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    texts = [f"x {word} {other} {word}y {other}", "nul \x00 \x00\x00 a\x00 a"]
    got = [ids.tolist() for _, ids, _ in bpe.Encoder(PATH)(pa.array(texts[:1]))] + [ids.tolist() for _, ids, _ in bpe.Encoder(PATH)(pa.array(texts[1:]))]
    assert got == reference_ids(texts)
    data = np.frombuffer((word + other).encode(), np.uint8)
    one, two = words.span_keys(data, np.array([0, 2048]), np.array([2048, 4096]))
    assert one[0] != one[1] and two[0] != two[1]


@pytest.mark.parametrize("unit", ["the naïve Straße, don't  go\n\n 12 ", "привет, мир это  Ελληνικά 日本語\n\t x ", "plain <|endoftext|> words "])
def test_very_long_texts_are_encoded_in_pieces(unit):
    text = unit * 4000
    encode = bpe.Encoder(PATH)
    at = list(bpe.pieces(np.frombuffer(text.encode(), np.uint8), 5000))
    assert at[0][0] == 0 and at[-1][1] == len(text.encode()) and all(a[1] == b[0] for a, b in zip(at[:-1], at[1:], strict=True)) and len(at) > 10
    whole = "endoftext" in text
    data = np.frombuffer(text.encode(), np.uint8)
    if not whole:
        plain = bool(bpe.plain_rows(data, np.array([0, len(data)]))[0])
        parts = [encode._plain(data[a:b], np.array([0, b - a]))[0] if plain else encode._library(data[a:b].tobytes()) for a, b in at]
        assert np.concatenate(parts).tolist() == reference_ids([text])[0]
    (_, ids, _), = encode(pa.array([text]))
    assert ids.tolist() == reference_ids([text])[0]


def test_text_of_fifty_megabytes():
    unit = "Some plain words, of which there are many; "
    text = unit * (50_000_000 // len(unit))
    (_, ids, _), = bpe.Encoder(PATH)(pa.array([text]))
    start, again = reference_ids([unit + unit[:-1]])[0], reference_ids([unit * 3])[0]
    per = len(again) - len(reference_ids([unit * 2])[0])
    n = len(text) // len(unit)
    assert len(ids) == len(again) + (n - 3) * per
    assert (ids[per : 2 * per] == ids[per * (n - 2) : per * (n - 1)]).all() and ids[: len(start)].tolist() == start


def test_folding_is_unicode_s():
    texts = ["ПРИВЕТ Мир", "ΣΊΣΥΦΟΣ", "ÀÉ×ß Ÿ", "abc XYZ", "", "İI", "ＡＢ𐐀 x"]
    data, offsets = words.text_buffer(pa.array(texts))
    got, at = words.folded(data, offsets)
    rows = [got[a:b].tobytes().decode() for a, b in zip(at[:-1], at[1:], strict=True)]
    assert rows == ["привет мир", "σίσυφοσ", "àé×ß ÿ", "abc xyz", "", "ii", "ａｂ𐐨 x"]


def test_packing_covers_every_id_once(spark):
    texts = ODD + ["the quick brown fox " * n for n in range(1, 60)] + ["same text"] * 20
    expected = {k: [*ids, 0] for k, ids in enumerate(reference_ids(texts))}
    rows = packing.packed(docs(spark, texts), PATH, capacity=64).collect()
    held, windows = {}, {}
    for r in rows:
        assert r["ids_crc32"] == crc(expected[r["doc_id"]][r["start"] : r["start"] + r["length"]])
        assert r["doc_tokens"] == len(expected[r["doc_id"]])
        held.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for k, ids in expected.items():
        at = 0
        for start, length in sorted(held[k]):
            assert start == at
            at += length
        assert at == len(ids)
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len(windows) <= sum(map(len, expected.values())) / 64 * 1.1 + 1
    assert packing.packed(docs(spark, []), PATH).collect() == []


def test_packing_gives_the_words_back_and_sorts_no_pieces(spark):
    encode = bpe.encoder(PATH)
    before = [ids.tolist() for _, ids, _ in encode(pa.array(["some words of no weight"]))]
    assert encode.n_words
    bpe.release(PATH)
    assert encode.n_words == encode.n_ids == 0 and [ids.tolist() for _, ids, _ in encode(pa.array(["some words of no weight"]))] == before
    plan = packing.packed(docs(spark, ["a b", "c " * 3000, None]), PATH)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Join" in plan


def test_closest_fill_is_the_best_subset_sum():
    rng = np.random.default_rng(1)
    for _ in range(200):
        counts = {int(x): int(n) for x, n in zip(rng.integers(1, 30, 6), rng.integers(1, 4, 6), strict=True)}
        room = int(rng.integers(1, 80))
        used = packing.closest_fill(room, counts)
        sums = {0}
        for x, n in counts.items():
            sums = {s + x * k for s in sums for k in range(n + 1) if s + x * k <= room}
        assert all(n <= counts[x] for x, n in used.items())
        assert sum(x * n for x, n in used.items()) == max(sums)


def test_simple8b_round_trip_with_escapes():
    rng = np.random.default_rng(2)
    for n in (1, 59, 60, 61, 1023, 1024, 1025, 3000):
        for ids in (rng.integers(0, 2, n), rng.integers(0, 50257, n), np.zeros(n, int), np.where(rng.random(n) < 0.05, rng.integers(1 << 60, 1 << 62, n), 3)):
            words, at = simple8b.encoded(ids.astype(np.uint64))
            assert (simple8b.decoded(words, at, n) == ids.astype(np.uint64)).all()


def test_token_files(spark, tmp_path):
    texts = ODD + ["again and again"] * 7
    ids = list(range(len(texts)))[::-1]
    expected, start = {}, 0
    for k in sorted(range(len(texts)), key=lambda k: ids[k]):
        own = [*reference_ids([texts[k]])[0], 2]
        expected[ids[k]] = (start, len(own), crc(own))
        start += len(own)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in simple8b.round_trip(docs(spark, texts, ids=ids), PATH).collect()}
    assert got == expected
    assert simple8b.round_trip(docs(spark, []), PATH).collect() == []
    rows = docs(spark, ["one text"] * 200 + [None, "other"], ids=[7] * 200 + [None, 7])
    path = str(tmp_path / "ids")
    simple8b.written(rows, path, PATH, n_shards=4)
    got = simple8b.documents_of(spark, path).collect()
    assert len(got) == 202 and sorted(r["start"] for r in got) == list(np.r_[0, np.cumsum([r["n_tokens"] for r in sorted(got, key=lambda r: r["start"])])[:-1]])
    assert got[0]["start"] >= 0 and min(got, key=lambda r: r["start"])["doc_id"] is None
    assert spark.read.parquet(path).select("shard").distinct().count() > 1


def test_language_learns_and_rejects(spark):
    parts = {"en": "the and of to in that this with ".split(), "de": "der und die das nicht ein mit zu ".split()}
    rng = np.random.default_rng(4)
    texts, langs = [], []
    for k in range(400):
        lang = ("en", "de")[k % 2]
        texts.append(" ".join(rng.choice(parts[lang], 12)))
        langs.append(lang if k % 7 else None)
    texts += [None, "", "12 34 !!", "the that " * 20000, "日本語"]
    langs += ["en"] * 5
    df = docs(spark, texts, langs)
    model = language.fitted(df)
    got = {r["doc_id"]: r for r in language.identified(df, model).collect()}
    assert model.langs == ["de", "en"]
    assert all(got[k]["lang_pred"] == ("en", "de")[k % 2] for k in range(400))
    assert [got[k]["lang_pred"] for k in (400, 401, 402)] == ["und"] * 3 and got[400]["score"] == 0
    assert got[403]["lang_pred"] == "en" and got[404]["lang_pred"] != "und"
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) for k, r in got.items())
    none = docs(spark, ["the"], [None])
    assert language.identified(none, language.fitted(none)).first()["lang_pred"] == "und"
    assert language.identified(df, model, whole_rows=True).columns[:5] == df.columns


def ppm(texts, text):
    """Code length of a text by prediction by partial matching on plain dictionaries."""
    seen, pad = {}, b" " * language.ORDER
    for raw in texts:
        for i in range(len(raw)):
            for order in range(language.ORDER + 1):
                context = (pad + raw)[i + language.ORDER - order : i + language.ORDER]
                own = seen.setdefault(context, {})
                own[raw[i]] = own.get(raw[i], 0) + 1

    def bits(context, byte):
        shorter = bits(context[1:], byte) if context else 8
        found = seen.get(context)
        if not found:
            return shorter
        total, kinds = sum(found.values()), len(found)
        return -np.log2(found[byte] / (total + kinds)) if byte in found else -np.log2(kinds / (total + kinds)) + shorter

    return sum(bits((pad + text)[i : i + language.ORDER], text[i]) for i in range(len(text)))


def test_code_lengths_against_brute_force(spark):
    learned = {"x": ["abracadabra abracadabra", "Ελλάδα και Ελλάδα", "cad abra\n\n cad"] * 2, "y": ["the cat sat on the mat, the rat sat", "日本語 日本語 日本", "Cat! Rat! Mat!"]}
    ids = [k for k in range(400) if zlib.crc32(str(k).encode()) % 5][: sum(map(len, learned.values()))]
    rows = [(t, lang) for lang, texts in learned.items() for t in texts]
    model = language.fitted(docs(spark, [t for t, _ in rows], [x for _, x in rows], ids))
    assert model.langs == ["x", "y"] and 0 < model.nbytes < language.MODEL_BYTES
    texts = ["cadabra zzz abr", "the mat", "", "日本 Ελλάδα Cat", "q", "\x00\x01 ab"] + ["abra the cat " * 3000]
    raw = [t.encode() for t in texts]
    got = model.lengths(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(x) for x in raw])])
    for k, lang in enumerate(model.langs):
        own = [t.encode() for t in dict.fromkeys(learned[lang])]
        assert got[:-1, k] == pytest.approx([ppm(own, x) for x in raw[:-1]], rel=1e-5)
        assert got[-1, k] == pytest.approx(ppm(own, raw[-1][:13]) + 2999 * (ppm(own, raw[-1][:26]) - ppm(own, raw[-1][:13])), rel=1e-4)
    # a bound on the trees draws fewer texts and cuts none of their contexts
    small = language.fitted(docs(spark, [t for t, _ in rows], [x for _, x in rows], ids), model_bytes=model.nbytes * 3 // 4)
    assert 0 < small.nbytes <= model.nbytes * 3 // 4
    for lang, texts in learned.items():
        k, own = small.langs.index(lang), [t.encode() for t in dict.fromkeys(texts)]
        some = [[t for n, t in enumerate(own) if mask >> n & 1] for mask in range(1 << len(own))]
        got = small.lengths(np.frombuffer(raw[0], np.uint8), np.array([0, len(raw[0])]))[0, k]
        assert any(abs(got - ppm(part, raw[0])) < 1e-3 for part in some if part) or got == pytest.approx(8 * len(raw[0]))
    with pytest.raises(ValueError):
        language.fitted(docs(spark, [t for t, _ in rows], [x for _, x in rows], ids), model_bytes=10)


def test_held_out_accuracy(spark):
    """Of every language of the small documents table, on rows that nothing is learned from."""
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.identified(table, language.fitted(table)).where("held_out").join(table.select("doc_id", "lang"), "doc_id").where("lang IS NOT NULL").collect()
    for lang in {r["lang"] for r in rows}:
        own = [r["lang_pred"] == lang for r in rows if r["lang"] == lang]
        assert len(own) > 5 and np.mean(own) >= 0.9, (lang, len(own), np.mean(own))


def test_language_of_nothing(spark):
    none = docs(spark, [])
    assert language.identified(none, language.fitted(none)).collect() == []


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_licenses_against_brute_force(spark):
    mit = licenses.TEMPLATES[[x[0] for x in licenses.TEMPLATES].index("mit-text")][2]
    texts = ["", None, "Released under the MIT License.", "gnu GENERAL public license gnu general public license", "cc\nby cc-by CC BY", "a mit x license", mit.replace(" ", "\n"), mit[: len(mit) // 2], "x " * 3000 + mit, "É " + "apache license " * 3, "Licensed under the Apache License", "mit license\n\nmit license"]
    got = {r["doc_id"]: r for r in licenses.scanned(docs(spark, texts)).collect()}
    pairs = lambda t: set(zip(w := WORD.findall(t.translate(FOLD)), w[1:]))
    sets = [(label, scope, pairs(t)) for label, scope, t in licenses.TEMPLATES]
    for k, text in enumerate(texts):
        words = WORD.findall((text or "").translate(FOLD))
        places = [(i, label) for p, label in licenses.PHRASES.items() for q in [p.split()] for i in range(len(words)) if words[i : i + len(q)] == q]
        base = {label for _, label in places}
        more = {label for label, scope, s in sets for b in re.split("\n" if scope == "line" else r"\n[\x00-\x20]*\n", text or "") if len(s & pairs(b)) >= licenses.THRESHOLD * len(s) - 1e-9}
        r = got[k]
        assert (r["n_words"], r["n_base"]) == (len(words), len(places))
        assert (r["first_word"], r["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert (r["base_labels"], r["labels"]) == (",".join(sorted(base)), ",".join(sorted(base | more)))
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(base | more)
    assert "mit-text" in got[6]["labels"]


def test_license_words_in_other_places_are_no_notice(spark):
    gpl = "This work is licensed under the GNU General Public License"
    texts = [
        "He released the book under the terms of a new driving license in 1999.",
        "This work is a general one: the public licensed pubs under the oak.",
        f"First lines.\r\n\r\n{licenses.TEMPLATES[4][2]}\r\n\r\nLast lines.",
        f"First lines. {gpl}. Last lines.",
        f"{gpl[:30]}\n{gpl[30:]}",  # a notice over two lines is none of a line
        "no word of it, " * 200_000 + "\r\n \t\r\n" + licenses.TEMPLATES[5][2],
    ]
    rows = spark.createDataFrame([(k, t, "own", 1) for k, t in enumerate(texts)], "doc_id long, text string, labels string, n_base int")
    got = {r["doc_id"]: r for r in licenses.scanned(rows).collect()}
    assert [got[k]["labels"] for k in range(6)] == ["", "", "mpl-2.0-text", "gpl,gpl-notice", "gpl", "mit-text"]
    assert got[5]["n_words"] == 800_000 + len(WORD.findall(licenses.TEMPLATES[5][2]))
    assert licenses.scanned(rows.limit(0)).count() == 0
    with pytest.raises(ValueError, match="two words"):
        licenses.scanned(rows, templates=(("x", "line", "word"),))


def test_page_text(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><script>var a="<p>no</p>";</script><style>p{}</style></head><body><header class="top">Site</header>
    <nav><ul><li><a href=/>Home</a></ul></nav><div class="cookie-notice">We use cookies.</div><aside>Side bar text, long enough to look like prose.</aside><!-- <p>hidden</p> -->
    <article><h1>Head &amp; line</h1><p>First para,<br>with a break and <b>bold</b>ness.<p>Second &lt;para&gt;  of   text.<form><input><label>Name</label></form><ul><li>one<li>two</ul>
    <section id="comments"><p>A reader comments at length, with punctuation, and more.</p></section></article><footer>Foot</footer></body></html>"""
    rows = [(1, "u", page), (2, "u", None), (3, None, ""), (4, "u", "plain text"), (5, "u", "<p>cut <a href='x"), (None, "u", "<div><p>" * 3000 + "deep text." + "</p></div>" * 3000)]
    got = {r["page_id"]: r for r in html.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1]["text"] == "Head & line First para, with a break and boldness. Second <para> of text. one two"
    assert (got[2]["text"], got[2]["n_chars"], got[3]["text"]) == ("", 0, "")
    assert got[4]["text"] == "plain text" and got[5]["text"] == "cut" and got[None]["text"] == "deep text."


def test_readers_comments_in_articles():
    page = """<body><main class="with-sidebar"><article class="post has-sidebar"><h2>Title</h2><p>The text, of some length, is here.</p>
    <article class="comment-body"><p>What a reader says, at length, with marks.</p></article></article></main></body>"""
    assert html.main_text(page) == "Title The text, of some length, is here."


def test_all_articles_of_a_page():
    one, two = "The first part, of some length, is here.", "The second part, as long, is there."
    page = f"<html><body><article class=card><p>{one}</p></article><article><p>{two}</p><p>{one}</p></article></body></html>"
    assert html.main_text(page) == f"{one} {two} {one}"
    page = f"<html><body><article><p>{one}</p></article><main><article><p>{two}</p><p>{one}</p></article></main></body></html>"
    assert html.main_text(page) == f"{one} {two} {one}"
    notice = "<article class='site notice'><p>We use, as all do, some small files here.</p></article>"
    assert html.main_text(f"<body>{notice}<article><p>{one}</p></article></body>") == one
    assert html.main_text(f"<body>{notice}</body>") == "We use, as all do, some small files here."


def test_pages_without_body_or_article():
    one, two = "The first part, of some length, is here.", "The second part, as long, is there."
    assert html.main_text(f"<p>{one}<p>{two}") == f"{one} {two}"
    assert html.main_text(f"<div><div><p>{one}</p></div><div><p>{two}</p></div></div>") == f"{one} {two}"
    linked = "<p>See <a href=x>this, which is a long name of a link</a>.</p><ul><li><a href=y>A source</a></ul>"
    page = f"<html><body><div><div><a href=z>Home</a></div><p>{one}</p>{linked}<p>{two}</p><div><a href=z>Next</a></div></div></body></html>"
    assert html.main_text(page) == f"{one} See this, which is a long name of a link. A source {two}"


PROSE = "A long sentence of prose, with commas, stops and many words, is here to be read by all. "


def test_attributes_weigh_and_ratios_decide():
    story = (PROSE * 4).strip()
    rest = f"<p>{story}</p>" * 4
    whole = " ".join([story] * 4)
    assert html.main_text(f'<body><div class="wrap has-sidebar">{rest}</div></body>') == whole
    assert html.main_text(f'<body><article class="post share-buttons-enabled">{rest}</article><div class="share-buttons"><p>{PROSE}</p></div></body>') == whole
    assert html.main_text(f"<body><main><div class=teaser><p>Read on.</p></div><div class=story>{rest}</div></main></body>") == whole
    assert html.main_text(f"<body><main><div class=box><p>Read on</p></div><div class=story>{rest}</div></main></body>") == whole
    assert html.main_text(f"<body><div class=page><div class=links><a href=x>One</a> <a href=y>Two</a></div><div class=text><h1>A title</h1><p class=byline>By me</p><div class=inner>{rest}</div></div></div></body>") == f"A title By me {whole}"
    assert html.main_text(f"<body><article><h1>T</h1><div class=quote><p>Short.</p></div>{rest}<table><tr><td><a href=x>Cell</a><td>2</table><section class=end><p>End</p></section></article></body>") == f"T Short. {whole} Cell 2 End"
    assert html.main_text(f"<body><article>{rest}<article><p>{PROSE}</p></article><ol class=comment-list><li>{PROSE}</ol><div role=complementary>{PROSE}</div></article></body>") == whole
    assert html.main_text(f"<body class=ads><div class='sidebar'>{PROSE * 20}</div><div id=text><p>Short text.</p></div></body>") == "Short text."


SUBJECTS = ("related-work", "search-algorithms", "menu-of-the-day", "footer-news", "comment-piece", "social-history", "login-theory", "advert-history")


@pytest.mark.parametrize("name", SUBJECTS)
def test_names_of_subjects_are_content(name):
    """A name that only holds a word of boilerplate, as class or id, in an article, in main, or around all of a page."""
    story = (PROSE * 3).strip()
    rest = f"<p>{story}</p>" * 3
    whole = " ".join([story] * 3)
    for said in (f"class={name}", f"id={name}"):
        for part in (f"<section {said}><h2>Part</h2><p>{story}</p></section>", f"<div {said}><h2>Part</h2><p>Short, and to the point.</p></div>"):
            text = f"Part {story}" if "section" in part else "Part Short, and to the point."
            assert html.main_text(f"<body><article>{rest}{part}</article></body>") == f"{whole} {text}"
        assert html.main_text(f"<body><main>{rest}<div {said}><h2>Part</h2><p>{story}</p></div></main></body>") == f"{whole} Part {story}"
        assert html.main_text(f"<body><div {said}>{rest}</div><div class=remark><p>A remark.</p></div></body>").startswith(whole)


def test_anchors_headings_and_short_blocks_are_content():
    story = (PROSE * 3).strip()
    rest = f"<p>{story}</p>" * 3
    whole = " ".join([story] * 3)
    assert html.main_text(f"<body><article>{rest}<section id=login><h2>Login</h2><p>{story}</p></section></article></body>") == f"{whole} Login {story}"
    assert html.main_text(f"<body><article>{rest}<section id=comments><p>{story}</p></section></article></body>") == whole
    assert html.main_text(f"<body><article><h1 class=banner-title>Of banners</h1>{rest}</article></body>") == f"Of banners {whole}"
    assert html.main_text(f"<body><article><h1 class=banner>Of banners</h1>{rest}</article></body>") == f"Of banners {whole}"
    short = PROSE[:50] + "."
    assert html.main_text(f"<body><div class=lead><p>{story}</p></div><div class=para><p>{story}</p></div><div class=closing><p>{short}</p></div></body>") == f"{story} {story} {short}"
    assert html.main_text(f"<body><main><div class=intro><p>{short}</p></div><div class=body>{rest}</div></main></body>") == f"{short} {whole}"
    three = f"<p>{PROSE}</p>" * 3
    notice = (PROSE * 2).strip()
    assert " ".join([PROSE.strip()] * 3) in html.main_text(f"<body><div><div class=story>{three}</div></div><section><div class=x><p>{notice}</p></div></section></body>")


def test_boilerplate_by_name_still_goes():
    rest = f"<p>{PROSE}</p>" * 4
    whole = " ".join([PROSE.strip()] * 4)
    for name in ("ad", "cookie-banner", "related-posts", "share-buttons", "site-footer", "comment-list", "newsletter_signup", "nav-links", "sidebar-right", "social"):
        assert html.main_text(f"<body><div class={name}><p>{PROSE}</p></div><article>{rest}<div class={name}><p>{PROSE}</p></div></article></body>") == whole


def test_path_scores_against_brute_force():
    """On pages of known structure: sums, smoothing and fusion written out per path."""
    rng = np.random.default_rng(6)
    for _ in range(40):
        page, rows = "", []
        for _ in range(int(rng.integers(1, 9))):
            box, tag = ["div class=a", "div class=b", "section"][rng.integers(3)], ["p", "pre", "h2"][rng.integers(3)]
            inner = ""
            for _ in range(int(rng.integers(1, 5))):
                text = " ".join("word," if rng.random() < 0.3 else "word" for _ in range(int(rng.integers(1, 40))))
                inner += f"<{tag}>{text}</{tag}>"
                rows.append(((box, tag), text))
            page += f"<{box}>{inner}</{box.split()[0]}>"
        paths, found = html.blocks(f"<body>{page}</body>")
        assert [x[1] for x in found] == [x[1] for x in rows]
        order = list(dict.fromkeys(x[0] for x in rows))
        length = [np.mean([len(t) for p, t in rows if p == q]) for q in order]
        marks = [(sum(t.count(",") for p, t in rows if p == q) + 1) / sum(p == q for p, _ in rows) for q in order]

        def smooth(x):
            return [0.5 * x[k] + sum(0.25 * x[j if 0 <= j < len(x) and order[j][0] == order[k][0] else k] for j in (k - 1, k + 1)) for k in range(len(x))]

        expected = [a * b for a, b in zip(smooth(length), smooth(marks), strict=True)]
        for k in range(len(order) - 2, -1, -1):
            if order[k][1] == "h2" and order[k][0] == order[k + 1][0]:
                expected[k] = max(expected[k], expected[k + 1])
        fused, sums = html.scores(paths, found)
        assert list(fused.values()) == pytest.approx(expected)
        assert sum(s[3] for s in sums.values()) == len(rows)


@pytest.mark.parametrize("unit", ["<div>x ", "<b>", "</div></p></li>", "<ul><li><center>x", "<p>x<td>", "<div class=a{}>x", "<span><div>x"])
def test_deep_and_long_pages_take_linear_time(unit):
    times = []
    for n in (25_000, 100_000):
        page = "".join(unit.replace("{}", str(k)) for k in range(n)) if "{}" in unit else unit * n
        start = time.process_time()
        html.main_text(page)
        times.append(time.process_time() - start)
    assert times[1] < 12 * times[0] + 1


def test_odd_pages(spark):
    assert html.extracted(spark.createDataFrame([], "page_id long, url string, html string, text string")).collect() == []
    rows = [(1, "u", "<article><p>Same.</p></article>", "x")] * 2 + [(2, "u", "<p>" + "long text. " * 200_000, "y"), (3, "u", "<a href=x>Only</a> <a href=y>links</a>", "z"), (4, "u", "<!-- -->", "z")]
    got = html.extracted(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((r["page_id"], r["n_chars"]) for r in got) == [(1, 5), (1, 5), (2, 2_199_999), (3, 10), (4, 0)]


def test_shortest_items_in_long_texts(spark):
    """An item of five words is found in a long text with the stated recall."""
    items = [" ".join(f"i{k}w{j}" for j in range(5)) for k in range(1000)]
    texts = [" ".join([*(f"a{k}x{j}" for j in range(40)), item, *(f"b{k}x{j}" for j in range(40))]) for k, item in enumerate(items)]
    df, bench = docs(spark, texts), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontamination.contained(df, bench).collect()}
    assert found <= {(k, k) for k in range(1000)} and len(found) >= 995


@pytest.mark.parametrize("limit", [decontamination.BROADCAST_BYTES, 0])
def test_containment_against_brute_force(spark, limit):
    rng = np.random.default_rng(8)
    vocabulary = [f"w{k}" for k in range(400)]
    items = [" ".join(rng.choice(vocabulary, n)) for n in (6, 12, 20, 40, 90, 200)]
    items += ["Мама мыла раму, а Папа читал Газету", "Ο ΑΝΔΡΑΣ και η ΓΥΝΑΙΚΑ είναι ΣΤΟ σπίτι", "too short", "", None, items[2]]
    texts = [" ".join(rng.choice(vocabulary, 300)) for _ in range(20)]
    for k, item in enumerate(items[:8]):
        parts = item.split()
        texts += [" ".join(rng.choice(vocabulary, 2000)) + " " + item.upper() + " " + texts[k], item, item.lower(), " ".join(parts[: len(parts) // 2]), " ".join(parts[: max(5, int(len(parts) * 0.95))]) + " x"]
    texts += [None, "", "one two"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")

    def shingles(text):
        found = WORD.findall("".join(c.lower() for c in text or ""))
        return {tuple(found[i : i + 5]) for i in range(len(found) - 4)}

    expected = {(d, i) for d, t in enumerate(texts) for i, item in enumerate(items) if shingles(item) and len(shingles(item) & shingles(t)) >= 0.8 * len(shingles(item)) - 1e-9}
    df = docs(spark, texts).withColumn("row_id", F.lit(1)).withColumn("item_id", F.lit("x"))
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.contained(df, bench, broadcast_bytes=limit).collect()} == expected
    kept = decontamination.decontaminated(df, bench, broadcast_bytes=limit)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} == set(range(len(texts))) - {d for d, _ in expected}
    assert decontamination.contained(df, bench.limit(0), broadcast_bytes=limit).collect() == []
    assert decontamination.decontaminated(df, bench.limit(0), broadcast_bytes=limit).count() == len(texts)
    assert decontamination.contained(df.limit(0), bench, broadcast_bytes=limit).collect() == []
    twice = decontamination.contained(df.unionByName(df.withColumn("doc_id", F.lit(None).cast("long"))), bench, broadcast_bytes=limit).collect()
    assert sorted(r["item_id"] for r in twice if r["doc_id"] is None) == sorted(i for _, i in expected)


def test_sharding_is_even_and_stable(spark, tmp_path):
    table = np.array(sharding.lookup_table())
    counts = np.bincount(table, minlength=len(sharding.SHARDS))
    assert counts.max() - counts.min() <= 1
    fewer = np.array(sharding.lookup_table(sharding.SHARDS[:-1]))
    kept = table != len(sharding.SHARDS) - 1
    assert (table[kept] != fewer[kept]).mean() < 0.25
    df = spark.createDataFrame([(1, 9), (1, 9), (None, 9)], "doc_id long, slot int")
    placed = sharding.placed(df, "doc_id")
    assert placed.columns == ["doc_id", "slot", "slot_", "shard_id"]
    rows = placed.collect()
    assert len(rows) == 3 and all(r["slot"] == 9 and r["shard_id"] == table[r["slot_"]] for r in rows)
    assert sharding.placed(df, "slot").count() == 3 and sharding.placed(df.limit(0), "doc_id").collect() == []
    sharding.written(df, "doc_id", str(tmp_path / "shards"), files=2)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted((r["doc_id"] or 0, r["slot"], r["shard_id"]) for r in back.collect()) == sorted((r["doc_id"] or 0, r["slot"], r["shard_id"]) for r in rows)
    with pytest.raises(ValueError, match="prime"):
        sharding.lookup_table(slots=8190)
