"""Language ID, decontamination, MinHash, HTML, BPE, chat, sharding: against
brute force, held-out accuracy or exact round trips, and on edge rows."""

import hashlib
import os
import random
import re
from itertools import chain as chained

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from conftest import SF001, SF01
from strata.llm import bpe, chat, components, decontam, html_text, langid, minhash, sharding
from strata.llm.common import table

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
VOCAB = public_tokenizers.path("byte_bpe_50k.json")
#: Rows that every text operator must take: nulls, empty, blank, repeated, no id; and columns named like results.
EDGE = [(1, None), (2, ""), (3, " \n\t"), (4, "same words here and there again"), (5, "same words here and there again"),
        (5, "same words here and there again"), (None, "no id but text"), (6, "a" * 50_000), (7, "word " * 30_000), (8, "!!! ... ???"), (9, "퟿ é 中文 \U0001f600 x")]


def edge(spark):
    clash = "1 as n_tokens, 'x' as lang_pred, true as kept, 0 as component_id, 'y' as w, 3 as h, 'z' as row, 9 as pos, 'k' as key, 1 as len, 's' as shard".split(", ")
    return spark.createDataFrame(EDGE, "doc_id long, text string").selectExpr("*", *clash, "'en' as lang", "'s' as source", "1L as n_chars")


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


# --- components

def test_components_against_union_find(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000, 1000 + k) for k in range(1, 300)] + [(k, k + 1) for k in range(2000, 2200)]
    edges += [(None, 3), (5, 5)]
    par = {}

    def find(x):
        par.setdefault(x, x)
        while par[x] != x:
            x = par[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = find(a), find(b)
            par[max(a, b)] = min(a, b)
    want = {x: find(x) for x in par if find(x) != x}
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    assert {r.node: r.component for r in components.connected_components(df, "a", "b").collect()} == want
    assert components.connected_components(df.limit(0), "a", "b").count() == 0


def test_components_state_of_many_edges(spark):
    """More edges than 2^63 / 2^39, where a long sum of 40-bit hashes overflows."""
    n = 17_000_000
    many = spark.range(n).selectExpr("id + 1 as u", "0L as v")
    a, b = (df.agg(*components.state()).collect()[0] for df in (many, many.selectExpr("u", "if(u = 7, 1L, v) as v")))
    assert a["n"] == b["n"] == n and a["x"] != b["x"] and a["y"] != b["y"]


# --- language ID

def test_language_accuracy_on_held_out_rows(spark):
    docs = table(spark, SF01, "documents")
    model = langid.fit(langid.training_sample(docs, ~langid.held_out()))
    found = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(langid.held_out())
    right, n, low, high = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*"), F.min("score"), F.max("score")).collect()[0]
    assert n > 200 and right > 0.98 and 0 <= low <= high <= 1


def test_language_bound_on_the_sample(spark):
    docs = table(spark, SF01, "documents")
    per = langid.training_sample(docs, F.lit(True), max_docs_per_lang=7).groupBy("lang").count().collect()
    assert len(per) == 4 and all(r["count"] <= 7 for r in per)


@pytest.fixture(scope="module")
def tiny_model():
    return dict(en="the cat and the dog with this that", fr="le chat et la maison avec cette", ru="кошка и собака это дом")


def fit_tiny(spark, tiny):
    return langid.fit(spark.createDataFrame([(k, v) for k, v in tiny.items()], "lang string, text string"))


def test_language_spans_of_mixed_text(spark, tiny_model):
    m = fit_tiny(spark, tiny_model)
    text = "the cat and the dog with this that " * 3 + "le chat et la maison avec cette " * 3 + "это дом кошка и собака"
    got = [(r.first_word, r.n_words, r.lang) for r in langid.spans(spark.createDataFrame([(1, text)], "doc_id long, text string"), m).orderBy("first_word").collect()]
    assert got == [(0, 24, "en"), (24, 21, "fr"), (45, 5, "ru")]


@pytest.mark.parametrize("few", [0, 1, 4])
def test_viterbi_against_enumeration(monkeypatch, few):
    monkeypatch.setattr(langid, "FEW", few)
    rng = np.random.default_rng(2)
    docs = [rng.normal(size=(n, 3)) for n in (1, 4, 6, 2)]
    for scores, found in zip(docs, langid.viterbi(docs, 0.7)):
        best = max(np.ndindex(*(3,) * len(scores)), key=lambda p: sum(scores[t, k] for t, k in enumerate(p)) - 0.7 * sum(a != b for a, b in zip(p, p[1:])))
        assert tuple(found) == best


def test_language_scripts_narrow_candidates(spark, tiny_model):
    m = fit_tiny(spark, tiny_model)
    assert [m.langs[k] for k in m.scripts["Cyrillic"]] == ["ru"] and [m.langs[k] for k in m.scripts["Latin"]] == ["en", "fr"]
    texts = [(1, "ыыы"), (2, "你好"), (3, "123 ..."), (4, "½ ② ² Ⅷ"), (5, "the cat 你好你好你好"), (6, "हिन्दी"), (7, "the ½ cat")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(df, m).collect()}
    assert got[1] == ("ru", 1.0) and got[2] == ("en", 0.0) and got[3] == got[4] == ("und", 0.0)  # numerals are no letters
    assert got[5] == ("en", 0.5) and got[6] == ("en", 0.0) and got[7] == ("en", 1.0)
    assert langid.words_of("Ein हिन्दी ภาษา x2y½") == ["ein", "हिन्दी", "ภาษา", "x", "y"]  # marks stay in words
    assert sorted(r.doc_id for r in langid.filter_identified(df, m).collect()) == [1, 5, 7]


def brute_language(sample):
    """text -> (language, score) by plain counts, whole Viterbi tables and no memory."""
    langs = sorted({lang for lang, _ in sample})
    counts = {lang: [{}, {}, {}] for lang in langs}
    for lang, t in sample:
        for w in langid.words_of(t):
            for g in langid.grams(w):
                c = counts[lang][len(g) - 1]
                c[g] = c.get(g, 0) + 1
    known = [set().union(*(counts[lang][n] for lang in langs)) for n in range(3)]
    sums = {lang: [sum(c.values()) for c in counts[lang]] for lang in langs}

    def gram(g):
        n = len(g) - 1
        if g not in known[n]:
            return np.zeros(len(langs))
        x = np.array([np.log(counts[lang][n].get(g, 0) + 0.5) - np.log(sums[lang][n] + 0.5 * len(known[n])) for lang in langs])
        return x - x.mean()

    def predict(text):
        words = langid.words_of(text)
        if not words:
            return "und", 0.0
        best, back = None, []
        for w in words:
            s = sum(gram(g) for g in langid.grams(w)) / 2
            s = np.clip(s - s.max(), -langid.WORD_CLIP, 0)
            if best is None:
                best = s
                continue
            step = [max(range(len(langs)), key=lambda j: (best[j] - langid.SWITCH_PENALTY * (j != k), j == k, -j)) for k in range(len(langs))]
            best = np.array([best[j] - langid.SWITCH_PENALTY * (j != k) for k, j in enumerate(step)]) + s
            back.append(step)
        k, path = int(np.argmax(best)), []
        for step in reversed(back):
            path.append(k)
            k = step[k]
        path = [k, *reversed(path)]
        per = [sum(len(w) for w, p in zip(words, path) if p == k) for k in range(len(langs))]
        return langs[per.index(max(per))], max(per) / sum(per)

    return predict


def test_language_of_whole_documents_against_brute_force(spark):
    docs = table(spark, SF001, "documents")
    sample = langid.training_sample(docs, ~langid.held_out(), max_docs_per_lang=8)
    predict = brute_language([tuple(r) for r in sample.select("lang", "text").collect()])
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs, langid.fit(sample)).collect()}
    short = [r for r in docs.select("doc_id", "text").collect() if len(r.text or "") < 2500]
    assert len(short) > 100
    wrong = [(r.doc_id, got[r.doc_id], predict(r.text)) for r in short]
    assert all(a[0] == b[0] and abs(a[1] - b[1]) < 1e-9 for _, a, b in wrong), [w for w in wrong if w[1] != w[2]][:3]


def test_language_edges(spark, tiny_model):
    m = fit_tiny(spark, tiny_model)
    got = langid.identify(edge(spark), m)
    assert got.columns == ["doc_id", "lang_pred", "score"] and got.count() == len(EDGE)
    und = {r.doc_id for r in got.where("lang_pred = 'und'").collect()}
    assert und == {1, 2, 3, 8}
    assert langid.identify(empty(spark), m).count() == 0
    kept = langid.filter_identified(edge(spark), m)
    assert kept.columns == edge(spark).columns and kept.count() == len(EDGE) - 4
    blank = langid.fit(empty(spark).select("lang", "text"))
    assert {r.lang_pred for r in langid.identify(edge(spark), blank).collect()} == {"und"}
    assert langid.filter_identified(edge(spark), blank).count() == len(EDGE)  # without a label nothing is judged


# --- decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute_report(docs, items, window=13):
    grams = {}
    for i, text in items:
        w = words(text)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            grams.setdefault(tuple(w[k:k + n]), set()).add(str(i))
    out = []
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for g, who in grams.items():
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k:k + len(g)]) == g:
                    hit.update(range(k, k + len(g)))
                    found |= who
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(found), sha, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


ITEMS = [(1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"), (2, "Short item"), (3, None), (4, ""),
         (10, "short ITEM"), (5, "é ß 中文 9"), (6, "lonely"), (7, "two three four five six seven eight nine ten eleven twelve thirteen fourteen")]
DOCS = [(1, "zero ONE two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"), (2, "a short, item! again short item"),
        (3, "one two three four"), (4, "é-ß (中文) 9"), (5, "lonely lonely"), (6, None), (7, ""), (8, "filler " * 200 + "lonely"), (8, "filler " * 5 + "lonely"), (None, "short item")]


@pytest.mark.parametrize("bound", [decontam.BROADCAST_BYTES, -1])
def test_contamination_against_brute_force(spark, monkeypatch, bound):
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", bound)
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").withColumn("w", F.lit(1)).withColumn("row", F.lit("x")).withColumn("items", F.lit(2))
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("len", F.lit(0)).withColumn("g", F.lit("g"))
    got = decontam.report(docs, items)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_report(DOCS, ITEMS)
    kept = decontam.drop_contaminated(docs, items)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {3, 6, 7, None}  # both rows of 8: one of them is contaminated


def test_contamination_edges(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    got = decontam.report(edge(spark), none).collect()
    assert len(got) == len(EDGE) and not any(r.contaminated or r.n_hit or r.n_items for r in got)
    assert {r.items_sha256 for r in got} == {hashlib.sha256(b"").hexdigest()}
    assert decontam.report(empty(spark), spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0


@pytest.mark.parametrize("bound", [decontam.BROADCAST_BYTES, 0])
def test_contamination_by_items_without_id(spark, monkeypatch, bound):
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", bound)
    bench = spark.createDataFrame([(None, "one two three four"), (None, "five six seven eight"), ("b", "one two three four")], "item_id string, text string")
    docs = spark.createDataFrame([(1, "one two three four"), (2, "five six seven eight"), (3, "nothing of it here")], "doc_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontam.report(docs, bench).collect()}
    ids = {k: hashlib.sha256(k.encode()).hexdigest() for k in ("", "b")}
    assert got == {1: (4, 2, ids["b"], True), 2: (4, 1, ids[""], True), 3: (0, 0, ids[""], False)}
    assert [r.doc_id for r in decontam.drop_contaminated(docs, bench).collect()] == [3]


def test_contaminated_spans_are_cut(spark):
    docs = spark.createDataFrame([(1, "Keep this. A short, item! And this."), (2, "clean"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {r.doc_id: r.text for r in decontam.remove_spans(docs, items).collect()}
    assert got == {1: "Keep this. A And this.", 2: "clean", 3: None} or got[1].startswith("Keep this. A") and "item" not in got[1]


# --- MinHash

def brute_components(rows):
    def grams(text):
        w = (text or "").encode().lower().split()
        return {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets = [grams(t) for _, t in rows]
    low = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if i and 100 * i >= 75 * (len(sets[a]) + len(sets[b]) - i):
                x, y = low[a], low[b]
                low = [min(x, y) if v in (x, y) else v for v in low]
    first = {}
    for (i, _), c in zip(rows, low):
        first[c] = min(i, first.get(c, i))
    return [(i, len(s), first[c], first[c] == i) for (i, _), s, c in zip(rows, sets, low)]


def varied(n, seed=9):
    """Texts whose similarities lie all around the threshold, in one hot group."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(3000)}" for _ in range(160)]
    rows = []
    for i in range(n):
        w = list(base) if i % 3 else [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(1, 160))]
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10 ** 6)}"
        rows.append((i + 1, " ".join(w)))
    return rows + [(n + k + 2, t) for k, (_, t) in enumerate(rows[:20])]


@pytest.mark.parametrize("key_block,set_block", [(minhash.KEY_BLOCK, minhash.SET_BLOCK), (16, 900)])
def test_near_duplicates_against_brute_force(spark, monkeypatch, key_block, set_block):
    monkeypatch.setattr(minhash, "KEY_BLOCK", key_block)
    monkeypatch.setattr(minhash, "SET_BLOCK", set_block)
    rows = varied(150)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(map(tuple, got.collect())) == sorted(brute_components(rows))


def test_near_duplicates_of_the_table(spark):
    docs = table(spark, SF01, "documents").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    assert sorted(map(tuple, minhash.near_duplicates(docs).collect())) == sorted(brute_components(rows))


def test_multi_index_finds_every_pair_within_the_distance():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 16, (1, minhash.SYMBOLS)).astype(np.uint16)
    import pyarrow as pa
    for _ in range(300):
        b = a.copy()
        at = rng.choice(minhash.SYMBOLS, minhash.MAX_DISTANCE, replace=False)
        b[0, at] ^= 1
        batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([a.tobytes(), b.tobytes()], pa.binary())], names=["doc_id", "sig"])
        keys = {1: set(), 2: set()}
        for out in minhash._keys(iter([batch])):
            for k, i in zip(out.column(0).to_pylist(), out.column(1).to_pylist()):
                keys[i].add(k)
        assert keys[1] & keys[2]


def test_near_duplicate_edges(spark):
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(edge(spark)).collect()}
    assert {(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 2, 4, True), (5, 2, 4, False), (None, 1, None, True), (6, 1, 6, True), (7, 1, 7, True)} <= got
    assert minhash.near_duplicates(edge(spark)).count() == len(EDGE)
    assert minhash.near_duplicates(empty(spark)).count() == 0


# --- HTML

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar">
<header><h1>Site name</h1><nav><ul><li><a href="/">Home</a><li><a href="/b">B</a></ul></nav></header>
<div id="cookie-notice">We use cookies.</div><div class="ad-box ads">Buy now!</div>%s
<aside>Other news</aside><div class="comments"><p>Nice text, I liked it and have a lot to say about it, so here is a long comment.</p></div>
<form><p>Your mail<input name=m></form><footer>&copy; Site</footer><script>var x = "<p>no</p>";</script></body></html>"""
BLOCKS = ["Head & line", "First paragraph of the text, long enough to be seen as content by its ratio of text to tags.", "Short.", "quoted in line", "one", "two",
          "Second long paragraph with more than enough text to be found, and a link inside it."]
BODY = ("<h2>Head &amp; line</h2><p>First   paragraph\n of the text, long enough to be <b>seen</b> as content by its ratio of text to tags.<p>Short."
        "<blockquote>quoted <i>in</i>&nbsp;line</blockquote><ul><li>one<li>two</ul><p>Second long paragraph with more than enough text to be found, and <a href=x>a link</a> inside it.</p>")


@pytest.mark.parametrize("wrap", ["<article>%s</article>", '<div class="page has-sidebar"><div class="post">%s</div></div>', "<table><tr><td>%s</td></tr></table>", "<main>%s</main>", '<div id="wrap"><div class="content">%s</div></div>', "<section><div>%s</div></section>"])
def test_main_text_in_any_layout(spark, wrap):
    assert html_text.main_blocks(PAGE % (wrap % BODY)) == BLOCKS


LONG = "A long paragraph of the text, with more than enough words to be seen as content by its ratio of text to tags, and then some. " * 4
REFERENCES = "".join(f'<li><a href="/r{k}">Reference {k}</a></li>' for k in range(4))


@pytest.mark.parametrize("inner,want", [
    (f"<section><p>Intro.</p></section><section><p>{LONG}</p><p>{LONG}</p></section><section><h2>End</h2><p>Last.</p></section>", ["Intro.", LONG, LONG, "End", "Last."]),
    (f"<div><p>Intro.</p></div><div><p>{LONG}</p></div>", ["Intro.", LONG]),
    (f"<h1>Title</h1><div class=entry><p>{LONG}</p></div>", ["Title", LONG]),
    (f"<p>Lead.</p><table><tr><td>1</td><td>{LONG}</td></tr></table>", ["Lead.", "1", LONG]),
    (f'<p>{LONG}</p><p><a href="/x">A paragraph that is a link.</a></p><p>{LONG}</p>', [LONG, "A paragraph that is a link.", LONG]),
    (f"<p>{LONG}</p><h2>References</h2><ol>{REFERENCES}</ol>", [LONG, "References", *(f"Reference {k}" for k in range(4))]),
    (f"<section><p>{LONG}</p></section><section><h2>References</h2><ol>{REFERENCES}</ol></section>", [LONG, "References", *(f"Reference {k}" for k in range(4))]),
])
def test_main_text_of_several_parts(spark, inner, want):
    menu = '<div class="top"><a href="/">Home</a> <a href="/a">About us</a> <a href="/b">Blog</a></div>'
    page = f'<body>{menu}<div id="content">{inner}</div></body>'
    assert html_text.main_blocks(page) == [" ".join(x.split()) for x in want]


@pytest.mark.parametrize("page,want", [
    (f"<body><div id=content><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div><article class=teaser><h3>More</h3><p>Read this too.</p></article></body>", [LONG] * 3),
    (f"<body><article><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></article><article><p>One.</p><p>Two.</p><p>Three.</p><p>Four.</p><p>Five.</p></article></body>",
     [LONG] * 3 + ["One.", "Two.", "Three.", "Four.", "Five."]),
    (f"<body><div class=bar>Site</div><article><p>{LONG}</p><p>Short.</p></article><div class=end>Made by us</div></body>", [LONG, "Short."]),
    (f"<body><div><article><p>{LONG}</p></article><p>{LONG}</p></div></body>", [LONG] * 2),
])
def test_main_text_beside_and_in_articles(spark, page, want):
    got = html_text.main_blocks(page)
    assert got[:len(want)] == [" ".join(x.split()) for x in want]
    assert "class=bar" not in page or len(got) == len(want)


SLUGS = (f'<section id="start"><h2 id="search-algorithms">Search</h2><p>{LONG}</p></section><section id="related-work"><h2>Related</h2><p>{LONG}</p></section>'
         f'<section id="privacy"><p>{LONG}</p></section><p id="notice-2">{LONG}</p>')
SLUG_BLOCKS = ["Search", LONG, "Related", LONG, LONG, LONG]
NOISY = '<div id="search-box">Look here</div><section id="x" class="related">Other pages</section>'


@pytest.mark.parametrize("page,want", [
    (f"<article>{SLUGS}{NOISY}</article>", SLUG_BLOCKS),
    (f"<main>{SLUGS}{NOISY}</main>", SLUG_BLOCKS),
    (f"<div class=content>{SLUGS}{NOISY}</div>", SLUG_BLOCKS),
    (f'<div class=post><p>{LONG}</p><p>{LONG}</p></div><section id="comments"><p>{LONG}</p></section>', [LONG] * 2),
    (f'<article><p>{LONG}</p></article><section id="comments"><p>{LONG * 5}</p></section>', [LONG]),
    (f"<article><p>{LONG}<math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math></p></article>", [LONG.strip() + " x=1"]),
    (f'<form id="aspnetForm"><nav>Menu</nav><div class=content><p>{LONG}</p><p>Short.</p></div></form>', [LONG, "Short."]),
    (f'<form id="form1"><article><p>{LONG}</p><form><p>Your mail</form><p>Short.</p></article></form>', [LONG, "Short."]),
    (f'<article><p>{LONG}</p><form action=x><p>Your mail<input name=m></form></article><form role=search>Find</form>', [LONG]),
])
def test_main_text_by_names_math_and_forms(spark, page, want):
    assert html_text.main_blocks(f"<body>{page}</body>") == [" ".join(x.split()) for x in want]


def test_main_text_of_the_table(spark):
    import html as escapes
    pages = table(spark, SF01, "pages")
    got = {r.page_id: r for r in html_text.extract(pages).collect()}
    for p in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", p.html, re.S)[1]
        parts = [" ".join(escapes.unescape(re.sub(r"</?b>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        want = "\n\n".join(x for x in parts if x)
        assert (got[p.page_id].text, got[p.page_id].n_chars, got[p.page_id].url) == (want, len(want), p.url)


def test_ratios_decide_without_semantic_tags(monkeypatch):
    """The same text with <article> called <div>; and with every tag that means
    something and every name gone, most pages still come out right, by ratios alone."""
    import pyarrow.parquet as pq
    pages = [h for h in pq.read_table(f"{SF01}/pages.parquet").column("html").to_pylist() if h]
    want = [html_text.main_blocks(h) for h in pages]
    assert [html_text.main_blocks(re.sub(r"<(/?)(article|main)\b", r"<\1div", h)) for h in pages] == want
    bare = [re.sub(r"<(div|ul|p|li|form|span)\b[^>]*>", r"<\1>", re.sub(r"<(/?)(article|main|nav|header|footer|aside|section)\b", r"<\1div", h)) for h in pages]
    right = sum(html_text.main_blocks(h) == w for h, w in zip(bare, want))
    monkeypatch.setattr(html_text, "content_lines", lambda ratios: (np.ones(len(ratios), bool), -1.0))
    assert right > 0.7 * len(pages) > 2 * sum(html_text.main_blocks(h) == w for h, w in zip(bare, want))


@pytest.mark.parametrize("page,want", [
    (f"<main><article><p>{LONG}</p></article><section id=responses><p>{LONG}</p></section></main>", [LONG]),
    (f'<div class=content><div class="page-header"><h1>Title</h1></div><p>{LONG}</p></div>', ["Title", LONG]),
    (f'<article><div class="form-factor"><p>{LONG}</p></div><div class="search-algorithms">Two</div><p class="social-history">Three</p><div class="social-share-bar">Share</div></article>', [LONG, "Two", "Three"]),
    (f"<nav><a href=x>m</a><main><p>{LONG}</p></main>", [LONG]),
    (f"<div class=menu><a href=x>m</a><main><p>{LONG}</p></main>", [LONG]),
    (f"<nav><a href=x>m</a><article><p>{LONG}</p></article>", [LONG]),
    (f"<div>Buy now!</div><div><h1>Head</h1><p>{LONG}</p><p>Short.</p></div><div>Made by us</div>", ["Head", LONG, "Short."]),
])
def test_main_text_by_contract(page, want):
    assert html_text.main_blocks(f"<body>{page}</body>") == [" ".join(x.split()) for x in want]


@pytest.mark.parametrize("page", [lambda n: "<p>text " + "<a " * n, lambda n: "<i>" * n + "</x>" * n + "t", lambda n: "<div>t" * n, lambda n: "<a " * n + ">t", lambda n: "<!--" * n, lambda n: "</" * n + ">"])
def test_broken_pages_take_linear_time(page):
    import time
    took = []
    for n in (4000, 32_000):
        start = time.process_time()
        html_text.main_blocks(page(n))
        took.append(time.process_time() - start)
    assert took[1] < 20 * took[0] + 1


def test_main_text_edges(spark):
    rows = [(1, None), (2, ""), (3, "plain text"), (4, "<p>open <b>tags"), (5, "<"), (6, "<nav><a>x</a></nav>"), (7, "<article><p>" + "long " * 200_000), (7, "<p>again"),
            (None, "<p>no id"), (8, "<div>" * 3000 + "deep" + "</div>" * 3000), (9, "<p>cut &amp"), (10, "<script>never closed <p>x</p>")]
    df = spark.createDataFrame(rows, "page_id long, html string").selectExpr("*", "cast(null as string) as url", "1 as text", "2 as n_chars")
    got = html_text.extract(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"] and got.count() == len(rows)
    text = {(r.page_id, r.n_chars): r.text for r in got.collect()}
    assert {1: "", 2: "", 3: "plain text", 4: "open tags", 6: "", 8: "deep", 9: "cut &", 10: ""}.items() <= {k: v for (k, _), v in text.items()}.items()
    assert text[7, 999_999] == ("long " * 200_000).strip()
    assert html_text.extract(df.limit(0)).count() == 0


# --- BPE

@pytest.fixture(scope="module")
def own():
    return bpe.Bpe(bpe.load_vocab(VOCAB))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(VOCAB)


def random_text(rng):
    kind = rng.random()
    if kind < 0.3:
        return "".join(rng.choice("abehtinosr") for _ in range(rng.randrange(1, 1500)))
    if kind < 0.5:
        return "".join(rng.choice(["a", "A", "=", "-", " ", "\n", "\t", "'", "é", "中", "\U0001f600", "ß", "<|endoftext|>", "\x00", " "]) for _ in range(rng.randrange(400)))
    if kind < 0.7:
        return rng.choice(["a", "ab", "-", "=", "the", "Ã", "  ", "\n"]) * rng.randrange(30, 700)
    return "".join(rng.choice(["the", "tion", " ", "er", "'s", "'ll", "'", "<|endoftext|>", "<|end", "1", "²", "Ⅷ", "一"]) for _ in range(rng.randrange(300)))


def test_encoding_equals_the_library(own, library):
    rng = random.Random(11)
    for _ in range(400):
        text = random_text(rng)
        ids = list(chained.from_iterable(own.encode(text)))
        assert ids == library.encode(text, add_special_tokens=False).ids, text[:80]
        assert "".join(own.decode([ids[:3], ids[3:]])) == library.decode(ids, skip_special_tokens=False)


def merged(own, run):
    """The merges applied one by one, lowest rank first."""
    ids = [own.byte_id[b] for b in run]
    while len(ids) > 1:
        rank, k = min((own.rank.get(x << 20 | y, len(own.made)), k) for k, (x, y) in enumerate(zip(ids, ids[1:])))
        if rank == len(own.made):
            break
        ids[k:k + 2] = [own.made[rank]]
    return ids


def test_stream_is_the_same_with_bounded_state(own, monkeypatch):
    rng = random.Random(12)
    runs = [random_text(rng).encode()[:700] for _ in range(60)]
    for run in runs:
        assert list(own.stream(run)) == merged(own, run)
    monkeypatch.setattr(bpe, "MEMO_STATES", 100)  # the tables of states are given up again and again
    monkeypatch.setattr(bpe, "MEMO_PAIRS", 50)
    for run in runs[:20]:
        assert list(own.stream(run)) == merged(own, run)


def test_every_id_comes_out_of_the_transducer(own, monkeypatch):
    emitted, stream = [], bpe.Bpe.stream
    monkeypatch.setattr(bpe.Bpe, "stream", lambda self, run: (emitted.append(t) or t for t in stream(self, run)))
    own, rng = bpe.Bpe(bpe.load_vocab(public_tokenizers.path("byte_bpe_50k.json"))), random.Random(14)
    text = " ".join(str(k) + random_text(rng) for k in range(60))
    runs = set(chained.from_iterable(own._words(text.replace("<|endoftext|>", ""))))
    ids = list(chained.from_iterable(own.encode(text.replace("<|endoftext|>", ""))))
    assert len(emitted) >= sum(len(merged(own, r.encode())) for r in runs) and set(emitted) == set(ids)


def test_neighbouring_tokens(own):
    """The relation by parts equals encoding the joint bytes."""
    rng = random.Random(15)
    tokens = [t for t in rng.sample(range(len(own.token_bytes)), 4000) if own.token_bytes[t] in own.by_bytes and own.by_bytes[own.token_bytes[t]] == t]
    right = 0
    for _ in range(6000):
        a, b = rng.choice(tokens), rng.choice(tokens[:40] + own.byte_id)
        assert own.follows(a, b) == (merged(own, own.token_bytes[a] + own.token_bytes[b]) == [a, b])
        right += own.follows(a, b)
    assert 0 < right < 6000


    seen = []

    def watched():  # bytes taken before the n-th token comes out
        for k, b in enumerate(b"hetionanther" * 2000):
            seen.append(k)
            yield b

    tokens = own.stream(watched())
    first = next(tokens)
    assert first == merged(own, b"hetionanther" * 10)[0] and len(seen) <= 4 * own.horizon


def test_decoder_state_machine(own, library):
    rng = random.Random(13)
    for _ in range(200):
        ids = [rng.randrange(50257) for _ in range(rng.randrange(30))]
        cut = rng.randrange(len(ids) + 1)
        assert "".join(own.decode([ids[:cut], ids[cut:]])) == library.decode(ids, skip_special_tokens=False)


def test_segments_do_not_change_ids(own, library, monkeypatch):
    monkeypatch.setattr(bpe, "SEGMENT", 7)
    rng = random.Random(14)
    for _ in range(150):
        text = random_text(rng)[:300]
        assert list(chained.from_iterable(own.encode(text))) == library.encode(text, add_special_tokens=False).ids


def test_bpe_round_trip_of_the_table(spark, library):
    docs = table(spark, SF01, "documents")
    got = {r.doc_id: r for r in bpe.round_trip(docs, VOCAB).collect()}
    rows = docs.select("doc_id", "text").collect()
    for r, e in zip(rows, library.encode_batch([r.text or "" for r in rows], add_special_tokens=False)):
        ids, back = ",".join(map(str, e.ids)), library.decode(e.ids, skip_special_tokens=False)
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256, got[r.doc_id].decoded_sha256) == (
            len(e.ids), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())


def test_bpe_edges(spark, library):
    got = bpe.round_trip(edge(spark), VOCAB)
    assert got.count() == len(EDGE) and bpe.round_trip(empty(spark), VOCAB).count() == 0
    by = {r.doc_id: r for r in got.collect()}
    nothing = hashlib.sha256(b"").hexdigest()
    assert [(by[i].n_tokens, by[i].ids_sha256, by[i].decoded_sha256) for i in (1, 2)] == [(0, nothing, nothing)] * 2
    assert by[6].n_tokens == len(library.encode("a" * 50_000).ids)
    coded = bpe.encode_documents(edge(spark), VOCAB)
    back = {r.doc_id: r.text for r in bpe.decode_documents(coded, VOCAB).collect()}
    assert back == {i: t or "" for i, t in EDGE}


def test_vocabulary_bound(tmp_path, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_VOCAB_BYTES", 10)
    with pytest.raises(ValueError):
        bpe.load_vocab(VOCAB)


# --- chat

def brute_chats(rows):
    convs = {}
    for c, turn, role, text in set(rows):
        if c is not None:
            convs.setdefault(c, []).append((turn, role, text))
    md5 = lambda x: x if x is None else hashlib.md5(x.encode()).hexdigest()
    key = lambda t: tuple((x is not None, x if x is not None else 0) for x in (t[0], t[1], md5(t[2])))
    whole = {c: tuple(t[1:] for t in sorted(ts, key=key)) for c, ts in convs.items()}
    kept = {c for c, t in whole.items() if not any(o != c and (len(u) > len(t) and u[:len(t)] == t or u == t and o < c) for o, u in whole.items())}
    out = []
    for c in kept:
        copies = sum(u == whole[c] for u in whole.values())
        for a in range(0, len(whole[c]), chat.BLOCK):
            part = whole[c][a:a + chat.BLOCK]
            out.append((c, a // chat.BLOCK, len(part), copies, "".join(f"<|im_start|>{r or ''}\n{t or ''}<|im_end|>\n" for r, t in part)))
    return sorted(out)


@pytest.mark.parametrize("block", [chat.BLOCK, 2])
def test_chat_snapshots_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(chat, "BLOCK", block)
    rng = random.Random(6)
    rows = []
    for c in range(60):
        talk = [("user" if k % 2 == 0 else "assistant", rng.choice("ab")) for k in range(rng.randrange(1, 7))]
        rows += [(c, k, r, t) for k, (r, t) in enumerate(talk)]
    rows += [(100, 5, "user", "gap"), (100, 9, None, None), (101, 0, "user", "gap"), (102, None, "x", "y"), (102, None, "x", "y"), (None, 0, "user", "lost"),
             (103, 1, "user", ""), (104, 1, "user", None), (105, 1, None, ""), (106, 3, "a", "tie"), (106, 3, "b", "tie"), (106, 3, "a", "tie")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("n", F.lit(1)).withColumn("pos", F.lit("p")).repartition(4)
    assert sorted(map(tuple, chat.format_chats(df).collect())) == brute_chats(rows)
    assert chat.format_chats(df.limit(0)).count() == 0


def test_long_conversation_comes_in_parts(spark):
    df = spark.range(1000).selectExpr("1L as conv_id", "id as turn", "'user' as role", "string(id) as text")
    got = chat.format_chats(df).orderBy("part").collect()
    assert [r.n_turns for r in got] == [256, 256, 256, 232]


def test_blocks_hold_as_many_turns_whatever_their_numbers(spark):
    rows = [(1, None, "user", f"t{k}") for k in range(700)] + [(2, 1000 * k, "user", f"t{k}") for k in range(600)] + [(3, 1000 * k, "user", f"t{k}") for k in range(300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    placed = chat.turns(chat._rows(df, "conv_id", "turn", "role", "text"))
    assert placed.groupBy("conv", F.floor((F.col("pos") - 1) / chat.BLOCK)).count().agg(F.max("count")).first()[0] == chat.BLOCK
    assert sorted(map(tuple, chat.format_chats(df).collect())) == brute_chats(rows)


# --- sharding

def test_shards_fit_and_split_only_where_needed(spark):
    rng = random.Random(8)
    rows = [(i, "x" * rng.randrange(0, 400)) for i in range(3000)] + [(9000, "y" * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("old")).withColumn("h", F.lit(1))
    limit = 3000
    got = sharding.shards(df, limit).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in rows)
    size, members = {}, {}
    for r in got:
        size[r.shard] = size.get(r.shard, 0) + r.n_bytes
        members[r.shard] = members.get(r.shard, 0) + 1
        assert r.depth == len(r.shard) - 1
    assert all(s <= limit or members[k] == 1 for k, s in size.items())
    # a shard's sibling and itself together would not fit: no bucket was split in vain
    for k in size:
        if len(k) > 1:
            parent = k[:-1]
            assert sum(s for o, s in size.items() if o.startswith(parent)) > limit


def test_hot_key_goes_to_pages(spark, tmp_path):
    df = spark.range(900).selectExpr("case when id % 3 = 0 then 7 else id end as doc_id", "repeat('z', 100) as text").repartition(4)
    limit = 2000
    per = {r.shard: r.b for r in sharding.shards(df, limit).groupBy("shard").agg(F.sum("n_bytes").alias("b")).collect()}
    assert sum(per.values()) == 90_000 and all(b <= limit for b in per.values()) and sum("." in s for s in per) >= 14
    sharding.write_shards(df, str(tmp_path / "out"), limit)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 900 and back.groupBy("shard").agg(F.sum(F.length("text")).alias("b")).agg(F.max("b")).collect()[0][0] <= limit


def test_shard_edges(spark):
    got = sharding.shards(edge(spark), 1000)
    assert got.columns == ["doc_id", "shard", "depth", "n_bytes"] and got.count() == len(EDGE)
    assert sharding.shards(empty(spark), 1000).count() == 0
    assert {r.shard for r in sharding.shards(edge(spark), 1 << 30).collect()} == {"s"}
