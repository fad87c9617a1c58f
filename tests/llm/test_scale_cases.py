"""Cases of size, skew, clashing names and repeated rows that operators once failed."""

import collections
import random
import time

import numpy as np
import pytest

pytest.importorskip("gridloom.llm")

from gridloom.llm import chat_format, decontamination, html_extract, language_id, near_copies, pii, quality_rules, simhash, suffix_dedup  # noqa: E402
from test_operators import brute_kept, prose  # noqa: E402


def test_many_suffixes_of_one_lead(spark):
    """Thousands of suffixes share their leading bytes, most of them the gram as well, and a task holds 200 of a key."""
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdef") for _ in range(9))
    lead = "-" * 70 + " the same passage in every row, long enough to hold an anchor, and then some more words of it " + "=" * 40
    tails = [" ".join(word() for _ in range(20)) for _ in range(30)]
    texts = [" ".join(word() for _ in range(12)) + lead + r.choice(tails) + " " + word() for _ in range(4000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = suffix_dedup.remove_repeats(docs, 200, 200).orderBy("doc_id").collect()
    assert [(x.n_bytes, x.n_removed, len(x.spans), bytes(x.kept)) for x in got] == brute_kept(texts, 200)


def test_gray_index_finds_all_links():
    g = np.random.default_rng(5)
    codes = g.integers(0, 2**64, 40, dtype=np.uint64)
    near = np.unique(np.concatenate([codes, *(codes ^ np.bitwise_or.reduce(np.uint64(1) << g.integers(0, 64, (k, 40), dtype=np.uint64), axis=0) for k in (1, 2, 3, 4, 5, 6, 7) for _ in range(6))]))
    index = simhash.GrayIndex(near)
    found = {(int(a), int(b)) for x, y in index.linked(4) for a, b in zip(x, y)}
    apart = np.bitwise_count(index.codes[:, None] ^ index.codes[None, :])
    assert found == {(i, j) for i in range(len(near)) for j in range(i + 1, len(near)) if apart[i, j] <= 4}
    mask = 0xFFFF << 48
    a, b = simhash.GrayIndex(np.unique(g.integers(0, 2**64, 20_000, dtype=np.uint64)), mask).near_groups(4)
    assert len(a) < 5 * 20_000 / simhash.GROUP  # whole groups are pruned


def test_no_links_without_the_gray_index(spark, monkeypatch):
    codes = spark.createDataFrame([(k,) for k in range(64)], "fp long")
    assert simhash.components(simhash.links(codes, 4)).where("component = 0").count() == 63
    monkeypatch.setattr(simhash, "_links_of_ranges", lambda distance: lambda batches: (b.assign(a=0, b=0)[["a", "b"]].iloc[:0] for b in batches))
    assert simhash.links(codes, 4).count() == 0


def test_near_copies_of_one_original(spark):
    """Copies that lie nearer to the original than to one another, in a group cut into blocks."""
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(300)]
    texts = [" ".join(base)]
    for _ in range(300):
        own = list(base)
        for k in r.sample(range(10, 290, 10), 5):
            own[k] = word()
        texts.append(" ".join(own))
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, key int")
    assert [x.doc_id for x in near_copies.keep_first(docs).collect()] == [0]


def test_near_copies_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "BLOCK", 20)
    test_near_copies_of_one_original(spark)


def test_proximity_against_brute_force(spark):
    r = random.Random(4)
    words = [f"w{k}" for k in range(40)]
    items = [(k, [r.choice(words) for _ in range(r.randint(1, 14))]) for k in range(15)]
    docs = []
    for k in range(120):
        text = [r.choice(words) for _ in range(r.randint(0, 30))]
        if k % 2:
            own = list(r.choice(items)[1])
            for _ in range(r.randint(0, 3)):
                own.insert(r.randrange(len(own) + 1), r.choice(words))
            text[3:3] = own
        docs.append((None if k == 4 else 7 if k == 9 else k, " ".join(text), 1, "clash"))
    frame = spark.createDataFrame(docs, "doc_id long, text string, item int, items string").coalesce(1)
    got = decontamination.decontaminate(frame, spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string"), 10).orderBy("__row").collect()
    slop, share = decontamination.SLOP, decontamination.NEARLY
    seen = collections.Counter(w for d in docs for w in d[1].split())
    for x, d in zip(got, docs):
        text, near = d[1].split(), 0
        for _, own in items:
            hit = False
            for start in range(max(1, len(own) - 9)):
                window = range(start, min(len(own), start + 10))
                rarest = sorted((seen[own[p]], p) for p in window)[:2]
                a, b = rarest[0][1], rarest[-1][1]
                for pos in (p for p, w in enumerate(text) if w == own[a]):
                    at = lambda k: own[k] in text[max(0, pos + k - a - slop) : max(0, pos + k - a + slop + 1)] if k != a else True  # noqa: B023, E731
                    hit |= at(b) and sum(map(at, window)) >= share * len(window)
            near += hit
        assert x.doc_id == d[0] and x.n_near == near, (x, d)
    assert any(x.n_near > x.n_items for x in got) and any(x.n_items for x in got)


def test_windows_of_equal_hashes_are_compared(spark, monkeypatch):
    rows = [(1, "a b c d a b c e f g"), (2, "x y z " * 5), (3, "one two"), (4, " ".join(str(k) for k in range(50)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {x.doc_id: x.n_repeat_words for x in quality_rules.judge(docs, []).collect()}
    monkeypatch.setattr(quality_rules, "_HASH", "(xxhash64({words}) & 0L)")  # every window has the same hash
    assert {x.doc_id: x.n_repeat_words for x in quality_rules.judge(docs, []).collect()} == want == {1: 6, 2: 15, 3: 0, 4: 0}


def test_features_replace_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 99, "x"), (1, "a b", 98, "y")], "doc_id long, text string, n_words int, kept string")
    assert [(x.n_words, x.kept) for x in quality_rules.judge(docs, []).collect()] == [(2, False)] * 2


def test_language_results_replace_clashing_columns(spark):
    r = random.Random(1)
    table = [(k, " ".join(r.choice(["der und", "the of"][k % 2].split()) for _ in range(20)), ["de", "en"][k % 2], "clash", 7.0, "x") for k in range(60)]
    docs = spark.createDataFrame(table + table[:2], "doc_id long, text string, lang string, lang_pred string, score double, held_out string")
    got = language_id.identify(docs)
    assert got.columns.count("lang_pred") == 1 and got.count() == 62
    assert all(x.lang_pred == x.lang and 0 <= x.score <= 1 and x.held_out in (True, False) for x in got.collect())


def test_sliced_texts_count_every_gram_once(spark, monkeypatch):
    names, matrix = ["a", "b"], np.random.default_rng(0).normal(size=(language_id.BUCKETS + 1, 2)).astype("float32")
    texts = ["ab cd ef gh ij kl", "x" * 50, "hello there world", "q", "abc"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    whole = {x.doc_id: x.score for x in language_id.classify(docs, (names, matrix)).collect()}
    for block in (1, 3, 7):
        monkeypatch.setattr(language_id, "BLOCK", block)
        cut = {x.doc_id: x.score for x in language_id.classify(docs, (names, matrix)).collect()}
        assert all(abs(cut[k] - whole[k]) < 1e-6 for k in whole)


def test_windows_keep_the_budget_and_long_conversations_are_linear(spark):
    r = random.Random(6)
    table = [(c, k, "system" if k == 0 and c % 2 else r.choice(["user", "assistant"]), prose(r, r.choice([1, 10, 60]))) for c in range(20) for k in range(30)]
    table += [(50, 0, "system", "x" * 3000), (50, 1, "user", "y"), (50, 2, "assistant", "z" * 5000), (50, 3, "assistant", "z")]
    table += [(99, k, "assistant" if k % 2 else "user", f"turn {k}") for k in range(20_000)]
    frame = spark.createDataFrame(table, "conv_id long, turn long, role string, text string")
    began = time.time()
    made = chat_format.windows(frame, 400, 0.25).collect()
    assert time.time() - began < 60
    tokens = {(c, k): -(-len(t) // 4) + 5 for c, k, _, t in table}
    for x in made:
        held = x.text.count("<|im_start|>") - x.n_turns
        if x.n_tokens > 400:  # a single turn beside the system turn
            assert x.n_turns <= 2 and held <= 1
    windows = collections.Counter(x.conv_id for x in made)
    assert windows[99] > 100 and sum(x.n_turns for x in made if x.conv_id == 99) == 20_000
    assert max(tokens.values()) > 400
    digest = {x.conv_id: x for x in chat_format.digests(chat_format.windows(frame, 400, 0.25)).collect()}
    assert digest[99].n_turns == 20_000 and digest[50].loss_chars == 5001


def test_deep_pages_are_linear():
    began = time.time()
    for page in ("<div>" * 20_000 + "</b></i></p>" * 20_000 + "text", "<div>x" * 20_000 + "</span>" * 20_000, "<i>" * 20_000 + "<p></p>" * 20_000, "<li><p>" * 20_000, '<a "' * 20_000):
        html_extract.Page(page).text(set(), {})
    assert time.time() - began < 20


def test_page_cases(spark):
    text = lambda page: "\n".join(html_extract.Page(page).text(set(), {}))
    assert text('<article><header><h1>T</h1></header><h2 id="related-work">R</h2><p class="ad-hoc">A</p><section id="side-effects">S</section><div class="ad">no</div><div class="article-share">no</div><footer>no</footer></article>') == "T\nR\nA\nS"
    assert text(f'<body><article>teaser</article><div class="with-sidebar"><p>{"real body " * 40}</p></div></body>').startswith("real body")
    assert text('<form id="page"><article><p>inside</p></article></form><form>no</form>') == "inside"
    assert text("<p>a&nbsp;b &lt;c&gt; <script>var x='<p \"';</script>d</p>") == "a b <c> d"
    pages = [(1, "http://a.example/1", "<p>x</p>", "clash", 5), (1, "http://a.example/1", "<p>x</p>", "clash", 5), (None, None, "<p>" + "long " * 100_000 + "</p>", None, None)]
    got = html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string, host string, tokens int"))
    assert collections.Counter((x.page_id, len(x.text)) for x in got.collect()) == {(1, 1): 2, (None, 499_999): 1}


def test_copies_of_a_page_are_no_template(spark):
    page = "<body><div><p>one</p><p>two</p></div></body>"
    pages = [(k, f"http://a.example/{k}", page) for k in range(8)]
    got = html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string"))
    assert {x.text for x in got.collect()} == {"one\ntwo"}


def test_templates_joined_by_host(spark):
    pages = [(k, f"http://a.example/{k}", f"<body><div>Welcome</div><div><p>Body {k}</p></div></body>") for k in range(6)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    for most in (0, 1000):
        assert {x.page_id: x.text for x in html_extract.extract(frame, broadcast_tokens=most).collect()} == {k: f"Body {k}" for k in range(6)}


def test_pii_repeated_rows_and_extra_columns(spark):
    rows = [(1, "a@b.cd", "x", 1), (1, "a@b.cd", "x", 1), (None, None, "y", 2)]
    got = pii.scan(spark.createDataFrame(rows, "doc_id long, text string, spans string, kind int")).collect()
    assert sorted((str(x.doc_id), len(x.spans)) for x in got) == [("1", 1), ("1", 1), ("None", 0)]


def test_pii_secrets_and_addresses():
    automaton = pii._automaton()
    found = lambda t: [(k, t[s:e]) for k, s, e in pii.find(t, automaton)]
    assert found("password: hunterpass and") == [("account", "hunterpass")]
    assert found("the password is forgotten, the token too") == []
    assert found('secret = "a b c d e f"') == [("account", "a b c d e f")]
    assert found("at 221B Baker Street, London 90210.") == [("address", "221B Baker Street, London 90210")]
    assert found("Musterstraße 12, 10115 Berlin ist") == [("address", "Musterstraße 12, 10115 Berlin")]
    assert found("a long road ahead, 12 miles of street") == []
    assert dict(found("x" * 200 + "://u:p@h.example/y"))["url"].startswith("xxx")
    began = time.time()
    for t in ("street " * 100_000, "1 A " * 100_000 + "Street", "password: " * 50_000, "://a" * 200_000):
        found(t)
    assert time.time() - began < 20
