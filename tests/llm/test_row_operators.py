"""Language ID, toxicity, HTML extraction, decontamination and chat formatting."""

import hashlib
import random
import time

import pyarrow as pa
import pytest

from sievewright.llm import chat_format as C
from sievewright.llm import decontamination as D
from sievewright.llm import html_extract as H
from sievewright.llm import language_id as L
from sievewright.llm import toxicity as T
from tests.llm.data import documents, odd_rows, prose


# language ID


def language_rows():
    return [(i, prose(i, 60, 200), "aa", "s") for i in range(40)] + [(100 + i, prose(i, 60, 200).translate(str.maketrans("aeioubdfg", "uyaéàzxwv")), "bb", "s") for i in range(40)]


def test_language_of_held_out_rows(spark):
    rows = language_rows()
    train = documents(spark, [r for r in rows if r[0] % 4] + [(500, "ignored text", None, None), (501, None, "aa", "s")])
    got = {r.doc_id: (r.lang_pred, r.score) for r in L.identify(documents(spark, rows), L.fit(train)).collect()}
    assert all(got[d][0] == lang and 0 < got[d][1] <= 1 for d, _, lang, _ in rows)


def test_language_of_odd_rows(spark):
    rows = odd_rows() + [(20, "123 ... !!"), (21, "\n\n")]
    model = L.fit(documents(spark, language_rows()))
    got = L.identify(documents(spark, rows), model).collect()
    assert len(got) == len(rows)
    assert {r.doc_id for r in got if r.lang_pred == "und"} == {1, 2, 3, 20, 21}
    empty = L.fit(documents(spark, []))
    assert {r.lang_pred for r in L.identify(documents(spark, rows), empty).collect()} == {"und"}
    assert L.identify(documents(spark, []), model).collect() == []


def test_trigrams():
    grams, of, has = L.trigrams(["Ab c", "", "é1"])
    unpack = ["".join(chr(int(g) >> s & 0x1FFFFF) for s in (42, 21, 0)) for g in grams]
    assert list(zip(unpack, of.tolist(), strict=True)) == [(" ab", 0), ("ab ", 0), (" c ", 0), (" é ", 2)] and has.tolist() == [True, False, True]


# toxicity


def test_automaton_matches_one_edit():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = [i] + [min(row[j] + 1, row[j - 1] + (x != y), 0 or 10**9) for j, y in enumerate(b, 1)]
            for j in range(1, len(row)):
                row[j] = min(row[j], row[j - 1] + 1)
        return row[-1]

    terms = ["idiot", "scum", "moron", "trash", "vequ*"]
    a = T.build_automaton(terms)
    words = ["idiot", "idot", "iddiot", "idoit", "1diot", "idiots", "xidiot", "scum", "scun", "moron", "maron", "mron", "trash", "thrash", "vequ", "vequta", "veq", "trush", "ids", "moronss"]
    of, term, kind = T.hits(a, words)
    found = {(words[o], terms[t], k % 2) for o, t, k in zip(of, term, kind, strict=True)}
    wanted = {(w, t, int(w != t)) for w in words for t in terms if not t.endswith("*") and (w == t or len(t) >= 5 and distance(w, t) == 1)}
    wanted |= {(w, "vequ*", 0) for w in words if w.startswith("vequ")}
    assert found == wanted


def test_quotation_windows():
    a = T.build_automaton(["idiot"])
    kinds = lambda text: T.hits(a, [text])[2].tolist()
    assert kinds("you idiot") == [0] and kinds('the word "idiot" is rude') == [2] and kinds("he called them an idiot") == [2] and kinds('"ok" you idiot') == [0]


def test_scores_separate_classes(spark):
    docs = [(i, prose(i, 80) + (" you grubnik fool" if i % 4 == 0 else "") + (" they said grubnik" if i % 4 == 1 else "")) for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(160)] + [(None, 1), (3, None), (999, 1)], "doc_id long, toxic int")
    model = T.fit(documents(spark, docs), labels)
    got = {r.doc_id: r.score for r in T.toxicity(documents(spark, docs + [(500, "what a grubnk")]), model).collect()}
    assert all((got[i] >= 0.5) == (i % 4 == 0) for i in range(160, 200)) and got[500] > got[1]


def test_toxicity_of_odd_rows(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    for labels in (none, spark.createDataFrame([(4, 1), (7, 0)], "doc_id long, toxic int")):
        model = T.fit(documents(spark, odd_rows()), labels)
        got = T.toxicity(documents(spark, odd_rows()), model).collect()
        assert len(got) == len(odd_rows()) and all(0 <= r.score <= 1 for r in got)
    assert T.toxicity(documents(spark, []), model).collect() == []


# HTML extraction

PAGE = """<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header><h1>Site</h1><a href=x>Home</a></header>
<nav><ul><li><a href="/a">A</a></li></ul></nav><!-- x --><div class="cookie-notice">We use cookies here.</div><div class="ad">Buy now.</div>
<main><article><header><h1>Title &amp; more</h1></header><p>Hello &lt;b&gt; a < b,\n <b>bold</b>ly&nbsp;said.<br>Next<p>Second para.</p>
<ul><li>First point</li><li>Second point</li></ul><div class="advert"><p>Buy this long advertisement text with many many words in it today please.</p></div>
<section class="comments"><h2>Comments</h2><p>I like this long comment which surely is more than twelve words long.</p></section></article></main>
<aside><p>Side text here, which is long enough to look like a real sentence of content.</p></aside><form>Name <input><button>Go</button></form><footer>&copy; all</footer></body></html>"""


def test_extract_page():
    assert H.extract(PAGE) == "Title & more Hello <b> a < b, boldly said. Next Second para. First point Second point"
    plain = '<body><div id="menu"><a href=1>One</a> <a href=2>Two</a></div><div><p>This is a plain page without an article element but with sentences.</p><p>Short one.</p></div><div class=footer>Copyright</div>'
    assert H.extract(plain) == "This is a plain page without an article element but with sentences. Short one."


KEPT = "The city lies in a wide valley and has many old houses made of grey stone."


@pytest.mark.parametrize(
    "page",
    [
        '<article style="overflow:hidden"><p>{}</p></article>',
        '<article><p title="what is hidden here">{}</p></article>',
        '<main id="the-hidden-city"><p>{}</p></main>',
        '<article><div class="overflow-hidden"><p>{}</p></div></article>',
        '<article><section id="search-algorithms"><p>{}</p></section></article>',
        '<article><pre class="language-python">{}</pre></article>',
        '<div class="post-content no-sidebar"><p>{}</p></div>',
        '<div class="has-sidebar"><article><p>{}</p></article></div>',
    ],
)
def test_attributes_that_hide_nothing(page):
    assert H.extract("<body><nav>Menu</nav>" + page.format(KEPT) + "</body>") == KEPT


@pytest.mark.parametrize("attribute", ["hidden", 'hidden=""', "aria-hidden=true", 'style="color:red; display: none"', 'class="hidden"', 'class="ad"', 'class="article-comments"', 'class="cookie-banner wide"', 'id="sidebar"'])
def test_attributes_that_hide(attribute):
    assert H.extract(f"<article><p>{KEPT}</p><div {attribute}><p>Buy this long advertisement text with many many words in it today please.</p></div></article>") == KEPT


@pytest.mark.parametrize("bad", [None, "", "<", "<div", "<!--", "<script>x", "</p></p>", "<p>" * 3000, "&#x110000; &bogus; &", '<a href="x>y'])
def test_broken_pages(bad):
    assert isinstance(H.extract(bad), str)


SENTENCE = "This is the real text of the article, with more than twelve words in it, so it is kept."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f'<form id="aspnetForm"><article><h1>Title</h1><p>{SENTENCE}</p></article></form>', f"Title {SENTENCE}"),
        (f'<article><p>{SENTENCE}</p><form><p>{SENTENCE}</p></form></article>', SENTENCE),
        (f'<article><div class="post-header"><h1>Title</h1></div><p>{SENTENCE}</p></article>', f"Title {SENTENCE}"),
        (f'<article><header><h1>Title</h1><p>By one</p></header><p>{SENTENCE}</p></article>', f"Title {SENTENCE}"),
        (f"<article><p>{SENTENCE} <math><mi>x</mi><mo>=</mo><mn>2</mn></math></p></article>", f"{SENTENCE} x=2"),
        (f'<article><p>{SENTENCE} <svg><path d="M0"/><text>label</text></svg></p></article>', f"{SENTENCE} label"),
        (f"<article><noscript><p>{SENTENCE}</p></noscript><object><p>{SENTENCE}</p></object></article>", f"{SENTENCE} {SENTENCE}"),
        (f'<article><p title="a > b">{SENTENCE}</p></article><a href="cut', SENTENCE),
        (f'<article><p title="never closed>{SENTENCE}</p></article>', SENTENCE),
    ],
)
def test_parts_of_the_article(page, text):
    assert H.extract(page) == text


@pytest.mark.parametrize("page", ["<a " * 350_000, "<div>" * 100_000 + "x" + "</div>" * 100_000, '<a ">" ' * 100_000, '<a ""' * 100_000 + "'>", "<a '>" * 100_000, "<svg><path/>" * 50_000, "<select>" * 100_000, "<" * 1_000_000])
def test_long_broken_pages_take_linear_time(page):
    began = time.process_time()
    H.extract(page)
    assert time.process_time() - began < 20  # quadratic: minutes


def test_min_cut_is_minimal():
    import itertools
    import random

    rng = random.Random(3)
    for _ in range(60):
        n = rng.randint(1, 8)
        odds = [rng.uniform(-2, 2) for _ in range(n)]
        edges = [(a, b, rng.uniform(0, 1.5)) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.5]

        def cost(label, odds=odds, edges=edges):
            return sum(max(o, 0) if not c else max(-o, 0) for o, c in zip(odds, label, strict=True)) + sum(w for a, b, w in edges if label[a] != label[b])

        assert abs(cost(H.min_cut(odds, edges)) - min(cost(x) for x in itertools.product((True, False), repeat=n))) < 1e-9


def test_pages_table(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, "x")], "page_id long, url string, html string, text string")
    got = H.extract_pages(pages).collect()
    assert len(got) == 3 and sorted(len(r.text) for r in got)[0] == 0


# decontamination

ITEM = "If Anna has 12 apples and gives 5 kg of them to Bert, how many apples does Anna have left after the second day of market?"


def test_leaks_and_clean_documents(spark):
    benchmark = spark.createDataFrame([(7, ITEM), (8, None), (9, "too short"), (10, prose(77, 40)), (None, prose(78, 30))], "item_id long, text string")
    changed = ITEM.replace("12", "340").replace("5 kg", "9 pounds").replace("Anna", "Maria").replace("Bert", "Joe")
    inconsistent = ITEM.replace("Anna", "Maria", 1)
    rows = odd_rows() + [
        (20, prose(1, 50) + " " + ITEM + " " + prose(2, 50)),
        (21, prose(3, 50) + ".\n" + changed),
        (22, "QUESTION: " + ITEM.upper()),
        (23, prose(4, 20) + " " + prose(77, 40).replace(" ", "\n")),
        (24, " ".join(ITEM.split()[:6]) + " " + prose(9, 60)),
        (25, prose(5, 300)),
        (26, inconsistent),
    ]
    got = {r.doc_id: sorted(x.item_id for x in r.found) for r in D.with_leaks(documents(spark, rows), benchmark, "found").collect()}
    assert {d for d, x in got.items() if x} == {20, 21, 22, 23} and got[20] == got[21] == [7] and got[23] == [10]
    assert [r.found for r in D.with_leaks(documents(spark, rows), benchmark.limit(0), "found").collect()] == [[]] * len(rows)
    assert D.with_leaks(documents(spark, []), benchmark).collect() == []


NUMBERS = "Sort the numbers 14 3 27 8 91 5 66 12 40 in ascending order."


@pytest.mark.parametrize(
    ("item", "text"),
    [
        (NUMBERS, f"so {NUMBERS} and on"),
        ("14 3 27 8 91 5", "the row 14 3 27 8 91 5 of it"),
        (ITEM, f"he said, {ITEM}"),
        ("Name the longest river of Europe", "a line without a stop\nName the longest river of Europe\nand more"),
        ("name the longest river", None),
        ("Which river flows past Vienna today?", "so now Which river flows past Paris today?"),
        ("Anna walks to school each day", "Well. then Maria walks to school each day"),
        ("How many of the red apples does Bert give to Carl at noon?", "How many of the red apples does Joe give to Joe at noon?"),
        (" ".join(["Anna", *(f"w{c}" for c in "abcdefghijklmnopqrstuvwx"), "meets", "Anna", "at", "the", "old", "gate"]), "x " + " ".join(["now Maria", *(f"w{c}" for c in "abcdefghijklmnopqrstuvwx"), "meets", "Anna", "at", "the", "old", "gate"])),
    ],
)
def test_literal_and_capital_matches(item, text):
    text = text or "He was asked to\nName the longest river"
    index = D.build_index([1], [item])
    found = D.leaks(index, pa.array([text, "nothing of it stands in this text but 14 3 words"]), 0.5, 20)
    assert bool(found[0]) == (len(item.split()) >= D.LEAST) and not found[1]


@pytest.mark.parametrize(
    "text",
    [
        "Mary Ann has 15 apples and gives 14 pears to her old friend, how many fruits are left at noon?",
        "so Anna Maria Bell has twenty-five apples and gives two hundred pears to her old friend, how many fruits are left at noon?",
        "-" * 200 + "Anna has 12 apples and gives 12 pears to her old friend, how many fruits are left at noon" + "?" * 200,
    ],
)
def test_changed_parameters(text):
    item = "Anna has 12 apples and gives 12 pears to her old friend, how many fruits are left at noon?"
    for a, b in ((item, text), (text, item)):
        found = D.leaks(D.build_index([1, 2], [prose(31, 30), a]), pa.array(["x", prose(7, 30) + ". " + b + " " + prose(8, 30), None]).fill_null(""), 0.5, 20)
        assert [[x[0] for x in f] for f in found] == [[], [1], []]


def _alike(a, b):
    """Templates of two token lists, compared one by one: equal words, or both numbers, units or names."""
    return all(x == y or {x, y} <= {"12", "7", "905"} or {x, y} <= {"Anna", "Bert", "Carl"} for x, y in zip(a, b, strict=True))


def test_leaks_against_brute_force():
    rng = random.Random(4)
    words = "when does go with red apple over wide river".split()
    slots = {"n": ["12", "7", "905"], "p": ["Anna", "Bert", "Carl"]}
    items = ["so " + " ".join(rng.choice(words) for _ in range(19)) for _ in range(12)]
    items = [" ".join(rng.choice(slots[rng.choice("np")]) if i % 6 == 5 else w for i, w in enumerate(x.split())) for x in items]
    texts = []
    for _ in range(150):
        copy = [rng.choice(slots["n"]) if w in slots["n"] else w for w in rng.choice(items).split()]
        if rng.random() < 0.7:  # other people, each for one
            people = dict(zip(slots["p"], rng.sample(slots["p"], 3), strict=True))
            copy = [people.get(w, w) for w in copy]
        a = rng.randint(0, 14)
        texts.append(["lead", *copy[a : rng.randint(a + 4, 20)], "tail"])
    index = D.build_index(list(range(len(items))), items)
    got = D.leaks(index, pa.array([" ".join(x) for x in texts]), 0.5, 20)
    for text, found in zip(texts, got, strict=True):
        want = set()
        for i, item in enumerate(x.split() for x in items):
            covered = set()
            for shift in range(-len(item), len(text)):
                places = {p + j for p in range(len(item) - 7) if 0 <= p + shift and p + shift + 8 <= len(text) and _alike(item[p : p + 8], text[p + shift : p + shift + 8]) for j in range(8)}
                people = {(item[p], text[p + shift]) for p in places if item[p] in slots["p"]}
                if len({a for a, _ in people}) == len(people):
                    covered |= places
            if 2 * len(covered) >= len(item):
                want.add(i)
        assert {x[0] for x in found} == want


def test_benchmark_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_CHARS", 300)
    items = [(i, prose(200 + i, 25)) for i in range(20)]
    rows = [(i, prose(300 + i, 40) + " " + items[i][1]) for i in range(20)]
    got = D.with_leaks(documents(spark, rows), spark.createDataFrame(items, "item_id long, text string"), "found").collect()
    assert all([x.item_id for x in r.found] == [r.doc_id] for r in got)


def test_template():
    assert D.readable(ITEM).startswith("if <name> has <number> apples and gives <number> <unit> of them to <name>")
    assert len(D.templates(pa.array(["", "...", "a"])).code) == 1


# chat formatting


@pytest.mark.parametrize("text", ["", "<|im_end|>", "<\\|", "<\\\\|x", "a<", "<|<|", "<\\n", "<|im_start|>user\nhi<|im_end|>\n", "\\<|\\"])
def test_escape_round_trip(text):
    assert C.unescape(C.escape(text)) == text and "<|" not in C.escape(text)
    segment, a, b = C.render("assistant", text)
    assert C.read_back(segment) == ("assistant", text) and C.unescape(segment[a:b]) == text
    assert C.read_back(C.render("us\ner<|", text)[0]) == ("us\ner<|", text)


def test_events_fold(spark):
    rows = [
        (1, 0, 0, "message", "user", "hello"),
        (1, 1, 0, "message", "assistant", "wrong"),
        (1, 1, 1, "regenerate", "assistant", ""),
        (1, 1, 2, "delta", None, "par"),
        (1, 1, 3, "delta", None, "tial"),
        (1, 0, 9, "edit", "user", "hello there"),
        (2, 0, 0, "delta", "assistant", "x"),
        (2, 0, 0, "delta", "assistant", "x"),
        (None, None, None, "message", None, None),
    ]
    events = spark.createDataFrame(rows, "conv_id long, turn long, seq long, kind string, role string, text string")
    segments = C.format_conversations(events).orderBy("conv_id", "turn", "msg_no").collect()
    assert [C.read_back(r.segment) for r in segments] == [("", ""), ("user", "hello there"), ("assistant", "partial"), ("assistant", "xx")]


def test_digests(spark):
    rows = [(1, 1, "assistant", "é<|im_end|>"), (1, 0, "user", "q"), (2, 0, "assistant", "a"), (2, 0, "assistant", "a"), (3, 0, "user", None)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for arranged in (True, False):
        got = {r.conv_id: r for r in C.digests(C.format_conversations(C.events_of(table)), arranged).collect()}
        assert got[1].turns_sha256 == sha("user\nq\nassistant\né<|im_end|>\n") and got[1].loss_sha256 == sha("é<|im_end|>") and got[1].loss_chars == 11
        assert got[2].n_turns == 2 and got[2].loss_sha256 == sha("aa") and got[3].loss_chars == 0 and got[3].turns_sha256 == sha("user\n\n")
    assert C.digests(C.format_conversations(C.events_of(table.limit(0)))).collect() == []
