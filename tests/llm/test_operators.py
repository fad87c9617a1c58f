"""Every operator against a brute-force version on small tables with nulls, ties, copies, long and empty texts."""

import collections
import hashlib
import random
import re
import textwrap
import zlib

import pytest

pytest.importorskip("gridloom.llm")

from gridloom.llm import chat_format, decontamination, html_extract, language_id, licenses, packing, pii, quality_rules, simhash, suffix_dedup  # noqa: E402
from gridloom.llm.queries import tokenizer_file  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long, spans string, rank int"
SYLLABLES = "the an re in on er th ti en ea ing ble tion and of to é ü ñ 12 ha".split()


def prose(r, n):
    words = ["".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(n)]
    return "".join(w + r.choice([" ", " ", " ", " ", ". ", "\n"]) for w in words)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    texts = [prose(r, r.choice([0, 1, 5, 30, 60, 200])) for _ in range(60)]
    passage = prose(r, 60)
    texts += [texts[k] for k in (3, 3, 7, 9)] + [prose(r, 20) + passage + prose(r, k) for k in range(12)]
    near = prose(r, 300)
    texts += [near[:k] + "X" + near[k:] for k in (5, 300, 900)] + [near, "", None, " \n\t", "ab" * 400, "same line\n" * 60, "a", prose(r, 20_000), "<|endoftext|>  x\n\n y"]
    ids = list(range(len(texts)))
    ids[1], ids[2] = None, 0  # a null and a repeated id
    return [(i, t, None, "s", None if t is None else len(t), "clash", 1) for i, t in zip(ids, texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def brute_kept(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = len(re.findall(b"\1+", bytes(gone)))
        out.append((len(d), sum(gone), runs, bytes(b for b, g in zip(d, gone) if not g)))
    return out


@pytest.mark.parametrize("bucket_rows", [50_000, 1])
def test_suffix_dedup(docs, rows, bucket_rows):
    got = suffix_dedup.remove_repeats(docs, 200, bucket_rows).collect()
    want = [(r[0], *x) for r, x in zip(rows, brute_kept([r[1] for r in rows], 200))]
    key = lambda x: (x[0] is None, x[0], x[1:])
    assert sorted(((x.doc_id, x.n_bytes, x.n_removed, len(x.spans), bytes(x.kept)) for x in got), key=key) == sorted(want, key=key)


def test_suffix_dedup_long_document(spark, monkeypatch):
    r = random.Random(1)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 1000)
    part = prose(r, 400)
    texts = [prose(r, 900) + part + prose(r, 700) + part, part[100:1500]]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)).orderBy("doc_id").collect()
    assert [(x.n_bytes, x.n_removed, len(x.spans), bytes(x.kept)) for x in got] == brute_kept(texts, 200)


def test_multikey_quicksort():
    import numpy as np

    cells = np.random.default_rng(0).integers(0, 3, (500, 4)).astype(np.uint64)
    order, same = suffix_dedup.multikey_quicksort(cells)
    ordered = cells[order].tolist()
    assert ordered == sorted(cells.tolist())
    for k in range(1, 500):
        assert same[k] == next((i for i in range(4) if ordered[k][i] != ordered[k - 1][i]), 4)


def test_packing(docs, rows):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokenizer_file())
    model.encode_special_tokens = True
    got = packing.pack_documents(docs, tokenizer_file(), 64, 40).collect()
    want = collections.Counter()
    for r in rows:
        ids = model.encode(r[1] or "", add_special_tokens=False).ids + [2]
        first = len(ids) % 64 or 64
        cuts = [0, *range(min(first, len(ids)), len(ids) + 1, 64)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[(r[0], k, a, b - a, zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[a:b])))] += 1
    assert collections.Counter((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in got) == want
    sequences = collections.defaultdict(list)
    for x in got:
        sequences[x.sequence_id].append((x.offset, x.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(x.length for x in got)
    assert len(sequences) <= -(-total // 64) * 1.02 + 2


def test_packing_plan_is_as_good_as_the_bound():
    r = random.Random(2)
    counts = collections.Counter(r.randint(1, 1023) for _ in range(20_000))
    kinds = packing.plan(dict(counts), 1024)
    used = collections.Counter()
    for times, held in kinds:
        assert sum(held) <= 1024
        for x in held:
            used[x] += times
    assert used == counts
    assert sum(t for t, _ in kinds) <= sum(k * v for k, v in counts.items()) / 1024 * 1.01


def test_quality_features_and_rules(spark, docs, rows):
    got = quality_rules.judge(docs, []).collect()
    seen = collections.Counter((x.doc_id, x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed, x.kept) for x in got)
    want = collections.Counter()
    for r in rows:
        t = r[1] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        windows = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        hit = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
        failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
        want[(r[0], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), failed, not failed)] += 1
    assert seen == want
    r = random.Random(4)
    table = [(i, prose(r, 80) if i % 5 else "".join(w + "### " for w in prose(r, 80).split())) for i in range(400)]
    labelled = spark.createDataFrame(table, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(0, 400)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    rules = quality_rules.learn(labelled, labels)
    assert rules
    kept = {x.doc_id: x.kept for x in quality_rules.judge(labelled, rules).collect() if not x.base_failed}
    assert all(v == (k % 5 > 0) for k, v in kept.items())
    assert quality_rules.learn(labelled, labels.limit(0)) == []


def brute_hits(docs, items, width):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = []
    for item, text in items:
        w = words(text)
        windows += [(item, k, tuple(w[s : s + width])) for k in [len(windows)] for s in range(max(1, len(w) - width + 1))] if w else []
    out = collections.Counter()
    for r in docs:
        w = words(r[1])
        hit, found = set(), set()
        for item, _, x in windows:
            for s in range(len(w) - len(x) + 1):
                if tuple(w[s : s + len(x)]) == x:
                    hit |= set(range(s, s + len(x)))
                    found.add(item)
        out[(r[0], len(w), len(hit), ",".join(sorted(map(str, found))))] += 1
    return out


@pytest.mark.parametrize("block", [1_000_000, 15])
def test_decontamination(spark, docs, rows, block):
    items = [(1, rows[70][1][100:400]), (2, "The. AN of"), (10, rows[5][1]), (3, rows[5][1]), (4, ""), (5, None), (6, "zzz yyy xxx"), (7, "same line " * 7), (8, rows[66][1].upper())]
    got = decontamination.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string"), 10, block).collect()
    seen = collections.Counter((x.doc_id, x.n_words, sum(h.end - h.start for h in x.hits), ",".join(x["items"])) for x in got)
    assert all(x.n_items == len(x["items"]) for x in got)
    assert seen == brute_hits(rows, items, 10)


def test_decontamination_without_items(spark, docs, rows):
    got = decontamination.decontaminate(docs, spark.createDataFrame([], "item_id long, text string")).collect()
    assert len(got) == len(rows) and not any(x.hits for x in got)


def test_proximity(spark):
    index = decontamination.positional_index(spark.createDataFrame([(1, "a x x b a"), (2, "b x x x x a"), (3, None)], "doc_id long, text string"))
    got = sorted(map(tuple, decontamination.proximity_matches(index, "A", "b", 3).collect()))
    assert got == [(1, 0, 3), (1, 4, 3)]


@pytest.mark.parametrize("node_rows", [4096, 2])
def test_simhash(docs, rows, node_rows):
    import xxhash

    def fingerprint(t):
        w = (t or "").encode().lower().split()
        s = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))

    prints = [fingerprint(r[1]) for r in rows]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= 4 and label[j] < label[i]:
                    label[i], changed = label[j], True
    groups = collections.defaultdict(list)
    for r, k in zip(rows, label):
        groups[k].append(r[0])
    want = collections.Counter((r[0], f"{p:016x}", min((x for x in groups[k] if x is not None), default=None)) for r, p, k in zip(rows, prints, label))
    got = simhash.near_duplicates(docs, 4, 4, node_rows).collect()
    assert collections.Counter((x.doc_id, x.fingerprint, x.component_id) for x in got) == want


def test_simhash_dense_nodes(spark):
    import numpy as np

    g = np.random.default_rng(3)
    centres = g.integers(0, 2**63, 12, dtype=np.uint64)
    codes = {int(c) for c in centres}
    for c in centres.tolist():
        for _ in range(80):
            x = c
            for b in g.choice(64, g.integers(1, 7), replace=False).tolist():
                x ^= 1 << b
            codes.add(x)
    codes = np.array(sorted(codes), dtype=np.uint64)
    frame = spark.createDataFrame([(x,) for x in codes.view(np.int64).tolist()], "fp long")
    for node_rows in (4096, 20):
        edges = {frozenset(x) for x in simhash.links(frame, 4, node_rows).collect()}
        parent = {int(x): int(x) for x in codes.view(np.int64)}

        def root(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in map(tuple, edges):
            parent[max(root(a), root(b))] = min(root(a), root(b))
        label = np.arange(len(codes))
        near = np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 4
        while (new := np.array([label[x].min() for x in near])).tolist() != label.tolist():
            label = new
        pairs = {(root(int(c)), int(k)) for c, k in zip(codes.view(np.int64), label)}
        assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_pii(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda: 13 <= len(digits) <= 19 and pii.luhn(digits), "phone": lambda: 9 <= len(digits) <= 15}[kind]():
                out.append((kind, m.start(), m.end()))
    return out


def test_pii(spark):
    r = random.Random(8)
    atoms = ["@", ".", "1", "12", "255", "256", "4", "-", " ", "+1", "(", ")", "a", "b.c", "é", "%", "4111111111111111", "://", "x:", "token", '"', "_", "account "]
    texts = ["".join(r.choice(atoms) for _ in range(r.randint(1, 25))) for _ in range(3000)] + [None, "", "9" * 3000, "a" * 3000 + "@", "1." * 3000]
    texts.append('see http://user:pw@host.example/x, IBAN DE89 3704 0044 0532 0130 00. token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"')
    got = pii.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(got) == len(texts)
    for x in got:
        assert [(s.kind, s.start, s.end) for s in x.spans if s.kind in BASE] == brute_pii(texts[x.doc_id])
    last = [texts[-1][s.start : s.end] for x in got if x.doc_id == len(texts) - 1 for s in x.spans if s.kind not in BASE]
    assert last == ["http://user:pw@host.example/x,", "DE89 3704 0044 0532 0130 00", "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"]


def test_pii_redaction(spark):
    table = [(1, "mail a.b@c.de or +1 (743) 555-3824", "en", "s", 34), (2, None, None, None, None), (3, "clean", "en", "s", 5)]
    got = {x.doc_id: x for x in pii.redact(spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    assert got[1].text == "mail [EMAIL] or [PHONE]" and got[1].n_chars == len(got[1].text)
    assert tuple(got[2]) == table[1] and tuple(got[3]) == table[2]


def brute_licenses(text):
    """Matches of one text, straight from the definition."""
    sets = [(n, set(licenses.bigrams(t))) for n, t in sorted(licenses.TEMPLATES)]
    if text is None:
        return []
    parts = [re.sub("[^a-z0-9]+", " ", x.lower()).split() for x in re.sub(r"([.!?;:])[ \t]+", r"\1\n", text).split("\n")]
    most, n_words = licenses.span(licenses.TEMPLATES, licenses.THRESHOLD), sum(map(len, parts))
    units = []
    for i in range(len(parts)):
        words = []
        for n, part in enumerate(parts[i:], 1):
            words = words + part
            if n > 1 and len(words) > most and words != part and words != parts[i]:
                break
            units.append((i, n, words))
    if n_words > most:
        units.append((-1, len(parts), sum(parts, [])))
    found = []
    for line, n, words in units:
        grams = {f"{a} {b}" for a, b in zip(words, words[1:])}
        best = max(((2 * len(grams & own) / (len(grams) + len(own)), -k) for k, (_, own) in enumerate(sets) if grams), default=(0, 0))
        if best[0] >= licenses.THRESHOLD:
            found.append((line, n, sets[-best[1]][0], best[0]))
    worth = lambda x: (x[3], -x[1], -x[0])
    outdoes = lambda y, x: worth(y) > worth(x) and (min(x[0], y[0]) < 0 or (y[0] < x[0] + x[1] and x[0] < y[0] + y[1]))
    return [x for x in found if not any(outdoes(y, x) for y in found)]


def test_licenses(spark):
    r = random.Random(3)
    full = [t for _, t in licenses.TEMPLATES]
    wrapped = "\n".join(" * " + " ".join(full[12].split()[k : k + 6]) for k in range(0, 40, 6))
    texts = ["x\nLicensed under the Apache License, Version 2.0.\ny", "RELEASED  under the mit license", "licensed under", None, "", "word " * 30_000, "Licensed under CC BY-NC 4.0.\nReleased under the MIT License."]
    texts += [f"Some prose here. {t} And more of it." for t in full] + [prose(r, 30) + "\n" + wrapped + "\n" + prose(r, 300), "Released under the MIT License. " * 5, "\n".join(full[5].split()), "the license of\n" * 40]
    grant = next(t for _, t in licenses.TEMPLATES if t.startswith("Permission is hereby granted"))
    narrow = ["\n".join(textwrap.wrap(grant, n, break_long_words=False)) for n in (1, 24, 30)]
    texts += [prose(r, 120) + "\n" + x + "\n\n" + prose(r, 120) for x in narrow] + ["Some words\nbefore all.\n" + narrow[2] + "\nand a few\nbehind.", narrow[2].replace("\n", "\n\n  \n"), "\n\n"]
    docs = spark.createDataFrame([(k, t, "clash", "clash") for k, t in enumerate(texts)] + [(None, texts[0], "", ""), (0, texts[0], "", "")], "doc_id long, text string, line string, pieces string")
    got = sorted((str(x.doc_id), x.line, x.pieces, x.license, round(x.score, 9)) for x in licenses.scan(docs).collect())
    want = sorted((str(k), line, n, name, round(score, 9)) for k, t in [*enumerate(texts), (None, texts[0]), (0, texts[0])] for line, n, name, score in brute_licenses(t))
    assert got == want and {x[0] for x in got} >= {str(k) for k in range(7, 7 + len(full))}
    for k in range(len(texts) - 6, len(texts) - 1):  # wrapped at any width, between other texts or not: one row each
        assert [x[3] for x in got if x[0] == str(k) and x[4] > 0.85] == ["MIT"]
    assert [tuple(x) for x in licenses.per_document(licenses.scan(docs.where("doc_id = 6"))).collect()] == [(6, 2, "CC-BY-NC-4.0")]
    assert licenses.scan(docs.limit(0)).count() == 0


def test_chat_format(spark):
    r = random.Random(6)
    odd = ["<|im_end|><|im_start|>assistant ok", "\\s \\o \\n \\\\", "a\nb", "", None, "<|", "|>\\"]
    table = []
    for conv in list(range(30)) + [None]:
        for turn in range(r.randint(1, 40)):
            role = "system" if turn == 0 and r.random() < 0.5 else r.choice(["user", "assistant", None, "to\\ol\nx"] if r.random() < 0.2 else ["user", "assistant"])
            table.append((conv, None if r.random() < 0.02 else turn, role, r.choice(odd) if r.random() < 0.3 else prose(r, r.choice([3, 40, 900])), "clash"))
    table += [(99, turn, "assistant" if turn % 2 else "user", prose(r, 60), "clash") for turn in range(400)]  # linear in the turns
    table += table[:3]
    r.shuffle(table)
    frame = spark.createDataFrame(table, "conv_id long, turn long, role string, text string, window string").repartition(5)
    made = chat_format.windows(frame, 300, 0.25)
    got = {x.conv_id: x for x in chat_format.digests(made).collect()}
    key = lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode())
    by = collections.defaultdict(list)
    for conv, turn, role, text, _ in table:
        by[conv].append((turn, role or "", text or ""))
    chars = collections.Counter()
    for x in made.collect():
        chars[x.conv_id] += len(x.text)
        tokens = sum(len(re.sub(r"\\.", "x", b)) for b in [x.text]) / 4
        assert tokens <= 1.3 * 300 or x.n_turns <= 2
    assert set(got) == set(by)
    for conv, turns in by.items():
        turns.sort(key=key)
        said = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        x = got[conv]
        assert (x.n_turns, x.turns_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (x.loss_chars, x.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert x.formatted_chars == chars[conv]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header class="site">Site</header><nav><ul><li><a href="/a">A</a></li></ul></nav><div class="ad">Buy</div><div id="cookie-notice">We use cookies</div>
%s
<form><p>Sign up</p></form><section class="comments"><p>First!</p></section><aside>More</aside><footer>&copy; x</footer></body></html>"""


def test_html(spark):
    body = "<article><h1>Head &amp;  line</h1><p><b>One\n two<br>three<p>Four &lt;b&gt;</p><ul><li>i<li>j</ul><!-- no --></article>"
    pages = [(1, "http://h.example/1", PAGE % body), (2, "http://h.example/2", None), (3, None, ""), (4, "bad", "plain  text"), (5, "http://h.example/3", "<p>cut <b>off")]
    # no article element: a block that repeats on the host is template, what differs is text
    pages += [(10 + k, f"http://soup.example/{k}", f"<body><div>Welcome</div><div>All rights</div><div><p>Body {k}</p><p>More {k}</p></div></body>") for k in range(6)]
    got = {x.page_id: x.text for x in html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[1] == "Head & line\nOne two three\nFour <b>\ni\nj"
    assert (got[2], got[3], got[4], got[5]) == ("", "", "plain text", "cut off")
    assert all(got[10 + k] == f"Body {k}\nMore {k}" for k in range(6))


def test_language_id(spark):
    r = random.Random(9)
    own = {"aa": "the of and ing ion", "bb": "der und ich ein ung", "cc": "que los ión era ado"}
    table = []
    for k in range(600):
        lang = r.choice(sorted(own))
        table.append((k, " ".join(r.choice(own[lang].split()) + r.choice(own[lang].split()) for _ in range(r.randint(3, 60))), lang))
    table += [(1000, None, "aa"), (1001, "12 -- ²½ !", "aa"), (1002, "", None), (None, "the of", "bb"), (1003, "of the and " * 100_000, None)]
    got = language_id.identify(spark.createDataFrame(table, "doc_id long, text string, lang string")).collect()
    assert len(got) == len(table)
    for x in got:
        assert 0 <= x.score <= 1
        assert x.held_out == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 3 == 1)
    seen = {x.doc_id: x.lang_pred for x in got}
    assert seen[1000] == seen[1001] == seen[1002] == "und" and seen[1003] == "aa"
    tested = [x for x in got if x.held_out and x.doc_id < 600]
    assert sum(x.lang == x.lang_pred for x in tested) >= 0.98 * len(tested) > 100


def test_language_blocks(spark, monkeypatch):
    names, matrix = ["a", "b"], language_id.np.random.default_rng(0).normal(size=(language_id.BUCKETS + 1, 2)).astype("float32")
    texts = ["ab cd", "x" * 50, "hello there world", "q"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {x.doc_id: x.lang_pred for x in language_id.classify(frame, (names, matrix)).collect()}
    for k, t in enumerate(texts):
        logs = matrix[-1].astype(float) + sum(matrix[g].sum(axis=0) for g in language_id._grams(language_id.letters(t)))
        assert got[k] == names[int(logs.argmax())]


def test_empty_tables(spark, empty):
    tokens = tokenizer_file()
    assert suffix_dedup.remove_repeats(empty).count() == 0
    assert packing.pack_documents(empty, tokens).count() == 0
    assert quality_rules.judge(empty, quality_rules.learn(empty, spark.createDataFrame([], "doc_id long, quality int"))).count() == 0
    assert decontamination.decontaminate(empty, spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0
    assert simhash.near_duplicates(empty).count() == 0
    assert pii.scan(empty).count() == licenses.scan(empty).count() == pii.redact(empty).count() == 0
    assert chat_format.digests(chat_format.windows(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert language_id.identify(empty).count() == 0
