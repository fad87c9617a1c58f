"""Toxicity, ranked search and token alignment against plain versions of their contracts."""

import hashlib
import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import chat_format, language_id, lexical_search, near_copies, queries, token_alignment, toxicity
from gridloom.llm.common import without_rows

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


# -- ranked search


def ranked(docs, items, most=10):
    found = [(k, i, Counter(TERM.findall((t or "").translate(FOLD)))) for k, (i, t) in enumerate(docs)]
    found = [x for x in found if x[2]]
    number, total = len(found), sum(sum(c.values()) for *_, c in found)
    df = Counter(w for *_, c in found for w in c)
    out = []
    for item, text in items:
        asked, scores = TERM.findall((text or "").translate(FOLD)), []
        for k, doc_id, counts in found:
            m = 100 - 75 + (75 * sum(counts.values()) * number) // total
            score = sum(math.floor(1000 * math.log((2 * number + 2) / (2 * df[w] + 1))) * ((1_000_000_000 * counts[w]) // (1000 * counts[w] + 8 * m)) for w in asked if w in counts)
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0, k))
        out += [(item, r, None if x[1] else x[2], -x[0]) for r, x in enumerate(sorted(scores)[:most], 1)]
    return Counter(out)


def searched(df):
    return Counter((x["item_id"], x["rank"], x["doc_id"], x["score"]) for x in df.collect())


def test_search_equals_brute_force_with_ties_repeats_and_nulls(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "SEGMENT", 1 << 15)
    rng = np.random.default_rng(3)
    words = ["alpha", "Beta", "gamma", "délta", "e2e", "zeta"]
    docs = [(int(i) % 90, " ".join(rng.choice(words, size=rng.integers(1, 9)))) for i in range(400)]
    docs += [(None, "alpha alpha"), (None, "alpha alpha"), (7, None), (8, ""), (9, "-- !!"), (2**60 + 1, "zeta zeta"), (2**60 + 2, "zeta zeta"), (5, "only " + "x" * 70_000)]
    items = [(1, "Alpha beta, ALPHA!"), (1, "zeta"), (None, "délta e2e"), (2, None), (3, ""), (4, "nowhere"), (5, "only"), (6, "alpha alpha")]
    got = lexical_search.search(frame(spark, docs).repartition(3), frame(spark, items, "item_id long, text string"))
    # rows of equal score and doc_id are told apart by the scan's order alone, which leaves the same columns
    assert searched(got) == ranked(docs, items)


def test_search_in_blocks_and_small_segments(spark, monkeypatch):
    docs = [(i, f"a b{i % 7} c{i % 3} " * (1 + i % 4)) for i in range(300)]
    items = [(f"q{k}", f"a b{k} c{k % 3} b{k}") for k in range(9)]
    got = lexical_search.search(frame(spark, docs), frame(spark, items, "item_id string, text string"), most=4, block_words=8)
    assert searched(got) == ranked(docs, items, 4)


def test_search_of_empty_tables_and_clashing_columns(spark):
    docs = frame(spark, [(1, "a b", 3, 4)], "doc_id long, text string, score long, item_id long")
    none = frame(spark, [], "item_id long, text string")
    assert lexical_search.search(docs, none).count() == 0
    assert lexical_search.search(docs.limit(0), frame(spark, [(1, "a")], "item_id long, text string")).count() == 0
    got = lexical_search.search(docs, frame(spark, [(1, "a", 9)], "item_id long, text string, rank long"))
    assert [(x["rank"], x["doc_id"]) for x in got.collect()] == [(1, 1)]


def test_max_tree_opens_fewer_nodes_than_there_are():
    rng = np.random.default_rng(5)
    size = 20_000
    term = np.repeat(np.arange(3), size)
    doc = np.tile(np.arange(size), 3)
    score = rng.integers(1, 100, size=3 * size)
    score[[17, size + 17, 2 * size + 17]] = 1000
    tree = lexical_search.MaxTree(term, doc, score, size)
    opened = []
    sums = tree.sums
    tree.sums = lambda *a: opened.append(a) or sums(*a)
    found = []
    terms, times = np.arange(3), np.array([1, 2, 1])
    tree.best(terms, times, found, 1, [(False, k, k) for k in range(size)])
    assert found[0][0] == -4000 and found[0][2] == 17 and len(opened) <= 8
    whole = score[:size] + 2 * score[size : 2 * size] + score[2 * size :]
    found = []
    tree.best(terms, times, found, 25, [(False, k, k) for k in range(size)])
    assert [(-s, k) for s, _, k, _ in found] == sorted(((int(s), k) for k, s in enumerate(whole)), key=lambda x: (-x[0], x[1]))[:25]


# -- token alignment


@pytest.fixture(scope="module")
def files():
    return queries.tokenizer_file(), queries.tokenizer_file("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain(files):
    import sentencepiece
    from tokenizers import Tokenizer

    one, two = Tokenizer.from_file(files[0]), sentencepiece.SentencePieceProcessor(model_file=files[1])
    one.encode_special_tokens = True
    codes = token_alignment.byte_level()
    assert len(codes) == 256 and sorted(codes.values()) == list(range(256))

    def sides(text):
        if not text:
            return [], []
        a = [(k, bytes(codes[c] for c in one.id_to_token(k))) for k in one.encode(" " + text, add_special_tokens=False).ids]
        b = [(k, bytes([int(two.id_to_piece(k)[1:-1], 16)]) if two.is_byte(k) else two.id_to_piece(k).replace("▁", " ").encode()) for k in two.encode(text)]
        raw = (" " + text).encode()
        return (a, b) if b"".join(x for _, x in a) == raw == b"".join(x for _, x in b) else ([], [])

    def aligned(texts):
        out, held = [], Counter()
        for text in texts:
            spans = []
            for side in sides(text):
                at, own = 0, []
                for k, raw in side:
                    own.append((at, at + len(raw), k))
                    at += len(raw)
                spans.append(own)
            a, b = spans
            links = [(x[2], y[2]) for x in a for y in b if x[0] < y[1] and y[0] < x[1]] if len(a) < 2000 else None
            ends = sorted({x[1] for x in a} & {y[1] for y in b})
            groups = ["|".join(",".join(str(x[2]) for x in side if lo < x[1] <= hi) for side in (a, b)) for lo, hi in zip([0, *ends], ends)]
            out.append((len(a), len(b), groups, links))
            held.update(set(links))
        best = {}
        for (x, _), n in held.items():
            best[x] = max(best.get(x, 0), n)
        return [(na, nb, len(g), len(li), sum(held[x] == best[x[0]] for x in li), sum(held[x] for x in li), hashlib.sha256(";".join(g).encode()).hexdigest() if na else "") for na, nb, g, li in out]

    return aligned


TEXTS = ["To be or not to be", "  two  blanks and a tab\t \n here ", "naïve Größe 漢字 🙂 é", "a▁b c", "nul \x00 byte", "<|endoftext|> <s> </s> <0x41>", " lead", "trail ", " ", "\n", "x" * 300, "", None, "To be or not to be", "a\x1cb \x1c c  d", "it's  we'll 1234567 !!?? ...", "tab\n \n\n  end"]
NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_alignment_equals_brute_force(spark, files, plain):
    rows = [(k % 5 if k != 3 else None, t) for k, t in enumerate(TEXTS)]
    want = Counter((i, *x) for (i, _), x in zip(rows, plain(TEXTS)))
    for shared in (token_alignment.SHARED_PAIRS, 40, 0):  # all pairs broadcast, some, none
        got = token_alignment.align(frame(spark, rows).repartition(3), *files, shared_pairs=shared)
        assert Counter(tuple(x[c] for c in ("doc_id", *NAMES)) for x in got.collect()) == want


def test_alignment_in_stretches(spark, files, plain, monkeypatch):
    texts = [" ".join(f"wörd{i * 7 % 13}  {i}" if i % 5 else f"word{i}" for i in range(120)), "short one", "y" * 90]
    models = token_alignment._models(*files)
    whole = token_alignment.encode(models, texts)
    monkeypatch.setattr(token_alignment, "STRETCH", 50)
    assert token_alignment.encode(models, texts) == whole
    one, two = whole
    aligner = token_alignment._Aligner(*files)

    def seen(most):
        monkeypatch.setattr(token_alignment, "TOKENS", most)
        parts = Counter()
        for owner, pair, n in aligner.pairs(one, two):
            for x in zip(owner.tolist(), pair.tolist(), n.tolist()):
                assert x[:2] not in parts
                parts[x[:2]] += x[2]
        return parts, sum(len(p.a) for _, _, p in aligner.stretches(one, two)), sum(1 for _ in aligner.stretches(one, two))

    large, small = seen(1 << 18), seen(16)
    assert large[:2] == small[:2] and small[2] > 5


def test_alignment_of_no_rows_and_clashing_columns(spark, files):
    empty = frame(spark, [], "doc_id long, text string")
    assert token_alignment.align(empty, *files).count() == 0
    got = token_alignment.align(frame(spark, [(1, "a b", "x", 3)], "doc_id long, text string, pair string, links int"), *files).first()
    assert (got["n_a"], got["n_b"], got["n_groups"]) == (2, 2, 2)


def test_interval_index_stabs():
    index = token_alignment.IntervalIndex(np.array([3, 4, 9, 10]))
    lo, hi = index.stabbed(np.array([0, 2, 3, 4, 8]), np.array([3, 5, 4, 10, 9]))
    assert list(zip(lo.tolist(), hi.tolist())) == [(0, 1), (0, 3), (1, 2), (2, 4), (2, 3)]


# -- toxicity


def brute_ratios(toxic, ordinary, other, order, discount):
    """Log-likelihood ratio of every n-gram and context, from lists of words."""

    def grams(words):
        return Counter(("\x02" + w + "\x03")[max(0, k - order) : k] for w in words for k in range(2, len(w) + 3))

    sides = [grams(toxic), grams(ordinary)]
    types = set(sides[0]) | set(sides[1]) | set(grams(other))
    seen = {g[k:] for g in types for k in range(len(g) - 1)}
    number = Counter(g[1:] for g in seen)
    total, kinds = Counter(), Counter()
    for g, n in number.items():
        total[g[:-1]] += n
        kinds[g[:-1]] += 1

    def shared(g):
        below = shared(g[1:]) if len(g) > 1 else 1 / (kinds[""] + 1)
        return (max(number[g] - discount, 0) + discount * kinds[g[:-1]] * below) / total[g[:-1]]

    def given(side, h):
        own = {g: n for g, n in side.items() if g[:-1] == h}
        return discount * len(own) / sum(own.values()) if own else 1.0

    def likely(side, g):
        n = sum(x for y, x in side.items() if y[:-1] == g[:-1])
        return max(side[g] - discount, 0) / n + given(side, g[:-1]) * shared(g[1:]) if n else shared(g[1:])

    known = set(sides[0]) | set(sides[1])
    out = {g: math.log(likely(sides[0], g)) - math.log(likely(sides[1], g)) for g in known}
    return out | {g[:-1] + "\x00": math.log(given(sides[0], g[:-1])) - math.log(given(sides[1], g[:-1])) for g in known}


def test_ratios_equal_brute_force(spark):
    toxic, ordinary, other = ["vilest", "vile", "a"], ["village", "a", "ample"], ["vixen", "sample"]
    rows = frame(spark, [(0, " ".join(toxic[:2])), (1, toxic[2]), (2, " ".join(ordinary[:1])), (3, " ".join(ordinary[1:])), (4, " ".join(other)), (5, None)], "__row long, text string")
    sample = frame(spark, [(0, 1, 0), (1, 1, 1), (2, 0, 0), (3, 0, 1)], "__row long, toxic int, half int")
    got = {x["gram"]: x for x in toxicity.log_ratios(toxicity.gram_counts(rows, sample)).collect()}
    want = brute_ratios(toxic, ordinary, other, toxicity.ORDER, toxicity.DISCOUNT)
    assert got.keys() == want.keys()
    assert all(math.isclose(got[g]["w"], x, abs_tol=1e-9) for g, x in want.items())
    model = toxicity.Model(toxicity.keys_of(list(got)), np.array([[x["w"]] for x in got.values()]))
    for word in ("vile", "vilest", "vilain", "zebra", "a"):
        framed = "\x02" + word + "\x03"
        parts = [framed[max(0, k - toxicity.ORDER) : k] for k in range(2, len(framed) + 1)]
        assert math.isclose(model.sums([word])[0], sum(want.get(g, want.get(g[:-1] + "\x00", 0.0)) for g in parts), abs_tol=1e-9)


def toy(n):
    rng = np.random.default_rng(11)
    common, bad = [f"w{a}{b}" for a in "aeiou" for b in "lmnrst"], ["scum", "idiot"]
    rows, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        words = rng.choice(common, size=40).tolist()
        for _ in range(3 * toxic):
            words.insert(int(rng.integers(40)), str(rng.choice(bad)))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxic_words_are_learned_and_held_out_labels_are_not(spark):
    rows, labels = toy(240)
    tables = frame(spark, rows), frame(spark, labels, "doc_id long, toxic int")
    got = {x["doc_id"]: x for x in toxicity.judge(*tables).collect()}
    assert len(got) == 240 and all(0 <= x["score"] <= 1 and x["predicted"] == (x["score"] >= 0.7) for x in got.values())
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got)
    assert all(got[i]["predicted"] == toxic for i, toxic in labels)
    turned = [(i, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, t in labels]
    again = {x["doc_id"]: x["score"] for x in toxicity.judge(tables[0], frame(spark, turned, "doc_id long, toxic int")).collect()}
    assert again == {i: x["score"] for i, x in got.items()}


def test_toxicity_of_odd_rows(spark):
    rows, labels = toy(60)
    long = "wal scum " * 60_000
    odd = [(None, "scum scum idiot"), (1000, None), (1001, ""), (1002, "İ ß 漢字 !"), (1003, long), (4, rows[4][1]), (2**60, "x")]
    docs = frame(spark, [(*r, 1, "s") for r in rows + odd], "doc_id long, text string, score int, predicted string")
    got = toxicity.judge(docs, frame(spark, [*labels, (4, None), (None, 1), (8, 0), (5000, 1)], "doc_id long, toxic int")).collect()
    assert len(got) == len(rows) + len(odd)
    by = {x["doc_id"]: x for x in got}
    assert by[1000]["score"] == by[1001]["score"] and not by[None]["held_out"] and by[1003]["predicted"] == 1 and 2**60 in by
    nothing = toxicity.judge(docs, frame(spark, [], "doc_id long, toxic int")).collect()
    assert {x["score"] for x in nothing} == {0.0}
    assert toxicity.judge(docs.limit(0), frame(spark, labels, "doc_id long, toxic int")).count() == 0


def test_slices_change_no_evidence(monkeypatch):
    model = toxicity.Model(toxicity.keys_of(["\x02a", "\x02ab"]), np.array([[2.0], [3.0]]))
    texts = ["ab a ab ba " * 20, "", "ab"]
    whole = model.evidence(texts)
    monkeypatch.setattr(toxicity, "BLOCK", 7)
    assert np.allclose(model.evidence(texts), whole)


# -- rows told apart by number; long conversations


def test_a_column_named_like_the_row_number(spark):
    text = " ".join(f"word{i}" for i in range(40))
    docs = frame(spark, [(1, text, 5, "x"), (2, text, 5, "y"), (3, "another text", 7, "z")], "doc_id long, text string, __row long, `a.b` string")
    kept = near_copies.keep_first(docs)
    assert kept.columns == docs.columns and sorted(x["doc_id"] for x in kept.collect()) == [1, 3]
    gone = frame(spark, [], "__row long")
    assert without_rows(docs, gone).count() == 3


@pytest.mark.parametrize("n", [1, 255, 256, 257, 600])
def test_every_turn_in_a_window_of_its_own(spark, n):
    turns = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("said "), F.col("id").cast("string")).alias("text"))
    made = chat_format.windows(turns, budget=8).select("window", "n_turns", "n_context", "text").orderBy("window").collect()
    assert [(x["window"], x["n_turns"], x["n_context"]) for x in made] == [(k, 1, 0) for k in range(n)]
    assert all(f"said {k}<" in x["text"] for k, x in enumerate(made))


def test_many_windows_are_made_in_time(spark):
    n = 30_000
    turns = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("assistant").alias("role"), F.lit("said").alias("text"))
    began = time.time()
    assert chat_format.digests(chat_format.windows(turns, budget=8)).first()["n_turns"] == n
    assert time.time() - began < 60


def plain_windows(turns, budget, history):
    """Windows of one conversation [(role, text)], turn by turn."""
    blocks, tokens, targets = [], [], []
    for role, text in turns:
        name, said = (x.replace("\\", "\\s").replace("<|", "\\o") for x in (role, text))
        head = "<|im_start|>" + name.replace("\n", "\\n") + "\n"
        blocks.append(head + said + "<|im_end|>\n")
        tokens.append(-(-len(text) // 4) + 5)
        targets.append((len(head), len(head) + len(said)) if role == "assistant" and said else None)
    held = int(bool(turns) and turns[0][0] == "system")
    kept = sum(tokens[:held])
    past = max(0, min(int(budget * history), budget - kept - 1))
    room, spans = max(1, budget - kept - past), [[]]
    for k in range(held, len(turns)):
        if spans[-1] and sum(tokens[i] for i in spans[-1]) + tokens[k] > room:
            spans.append([])
        spans[-1].append(k)
    out = []
    for number, span in enumerate(spans):
        before: list[int] = []
        spare = min(past, budget - kept - sum(tokens[i] for i in span))
        for k in range((span[0] if span else held) - 1, held - 1, -1):
            if sum(tokens[i] for i in before) + tokens[k] > spare:
                break
            before.insert(0, k)
        shown = [*range(held), *before, *span]
        text, loss = "", []
        for k in shown:
            if k in span and targets[k]:
                loss.append((len(text) + targets[k][0], len(text) + targets[k][1]))
            text += blocks[k]
        out.append((number, text, held + len(before) if number else 0, len(span) + (0 if number else held), sum(tokens[k] for k in shown), loss))
    return out


@pytest.mark.parametrize("budget, history", [(512, 0.25), (60, 0.5), (40, 0.0), (30, 0.9), (5, 0.25)])
def test_windows_equal_plain_ones(spark, budget, history):
    rng = np.random.default_rng(budget)
    talks = {}
    for c in range(12):
        roles = ["system"] * (c % 2) + rng.choice(["user", "assistant", "odd<|\nrole"], size=rng.integers(0, 14)).tolist()
        talks[c] = [(r, "é\\<|x " * int(rng.integers(0, 12)) if rng.random() < 0.9 else "") for r in roles] or [("user", "")]
    turns = frame(spark, [(c, k, r, t) for c, talk in talks.items() for k, (r, t) in enumerate(talk)], "conv_id long, turn long, role string, text string")
    got = {}
    for x in chat_format.windows(turns, budget, history).orderBy("conv_id", "window").collect():
        got.setdefault(x["conv_id"], []).append((x["window"], x["text"], x["n_context"], x["n_turns"], x["n_tokens"], [(y["start"], y["end"]) for y in x["loss"]]))
    assert got == {c: plain_windows(talk, budget, history) for c, talk in talks.items()}


# -- language identification, character by character


def plain_buckets(text):
    """Buckets of the 1- to 4-grams of a text's letters, by scalar arithmetic."""
    kept = re.sub(r"[\W\d_]+", " ", text or "").strip()
    if not any(c.isalpha() for c in kept):
        return None
    codes, out = [ord(c) for c in f" {kept.lower()} "], []
    for start in range(len(codes)):
        h = 0
        for n in range(1, 5):
            if start + n > len(codes):
                break
            h = (h ^ codes[start + n - 1]) * 0x9E3779B1 % 2**32
            h ^= h >> 15
            out.append((h + n) * 0x85EBCA6B % 2**32 >> 16)
    return out


def test_languages_equal_a_plain_naive_bayes(spark):
    rng = np.random.default_rng(4)
    words = {"aa": ["lor", "ipsu", "dól"], "bb": ["wer", "ist", "dór"], "cc": ["que", "lor", "est"]}
    rows = []
    for i in range(90):
        lang = ("aa", "bb", "cc")[i % 3]
        rows.append((i, " ".join(rng.choice(words[lang], size=rng.integers(1, 6))) + (" 42_!" if i % 5 == 0 else ""), lang if i % 7 else None))
    rows += [(200, None, "aa"), (201, "12 34", "bb"), (202, "", None), (None, "lor est", "cc"), (203, "lor " * 2000, None)]
    learned = [(plain_buckets(t), lang) for i, t, lang in rows if i is not None and zlib.crc32(str(i).encode()) % 3 != 1 and lang]
    names = sorted({lang for b, lang in learned if b})
    counts, docs = {n: Counter() for n in names}, Counter(lang for b, lang in learned if b)
    for b, lang in learned:
        counts[lang].update(b or ())
    total = {n: sum(counts[n].values()) + 0.5 * 65_536 for n in names}
    want = {}
    for i, text, _ in rows:
        found = plain_buckets(text)
        if found is None:
            want[i] = ("und", 0.0)
            continue
        logs = [math.log(docs[n] / sum(docs.values())) + sum(math.log((counts[n][b] + 0.5) / total[n]) for b in found) for n in names]
        top = max(logs)
        want[i] = (names[logs.index(top)], 1 / sum(math.exp(x - top) for x in logs))
    got = {x["doc_id"]: (x["lang_pred"], x["score"]) for x in language_id.identify(frame(spark, rows, "doc_id long, text string, lang string")).collect()}
    assert got.keys() == want.keys()
    assert all(got[i][0] == want[i][0] and math.isclose(got[i][1], want[i][1], abs_tol=1e-3) for i in want)
