"""The near-duplicate stage of the pipeline against the Jaccard similarities of all pairs."""

import os
import random

import pytest

pytest.importorskip("gridloom.llm")

import corpus_pipeline  # noqa: E402
from gridloom.llm import near_copies  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute_first(table):
    """Place of the row kept of each row's component."""
    sets = []
    for _, text in table:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(table)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            n = len(a & b)
            if a == b or n and n >= 0.8 * (len(a) + len(b) - n) - 1e-9:
                x, y = root(i), root(j)
                label[max(x, y)] = min(x, y)
    order = lambda k: (table[k][0] is None, table[k][0] or 0, k)
    groups = {}
    for k in range(len(table)):
        groups.setdefault(root(k), []).append(k)
    return {min(g, key=order) for g in groups.values()}


def near_table():
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    table = []
    for k in range(40):
        base = [word() for _ in range(r.choice([3, 5, 6, 30, 200, 400]))]
        for _ in range(r.choice([1, 2, 6])):
            own = list(base)
            for _ in range(r.randint(0, max(1, len(own) // 30))):
                own[r.randrange(len(own))] = word()
            table.append(" ".join(own))
    # every text has the same common part, so its shingles meet in hot groups
    common = " ".join(word() for _ in range(60))
    table += [common + " " + " ".join(word() for _ in range(n)) for n in range(0, 60, 2)]
    table += ["", None, " \n", "one", "One", *table[:4]]
    r.shuffle(table)
    return [(None if r.random() < 0.05 else r.randrange(10_000), t) for t in table]


@pytest.mark.parametrize("sample", [5_000, 1])
def test_stage_against_all_pairs(spark, monkeypatch, sample):
    monkeypatch.setattr(near_copies, "SAMPLE", sample)
    table = near_table()
    rows = [(i, t, "en", str(k), 0) for k, (i, t) in enumerate(table)]
    docs = spark.createDataFrame(rows, DOCS).coalesce(1)
    got = sorted(int(x.source) for x in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect())
    assert got == sorted(brute_first(table)) and len(got) < len(table)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="the synthetic tables are not here")
def test_stage_on_the_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    table = sorted((x.doc_id, x.text) for x in docs.select("doc_id", "text").collect())
    got = {x.doc_id for x in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert got == {table[k][0] for k in brute_first(table)}
    assert not got & {255, 770, 875, 944}  # near copies of Jaccard 0.81 to 0.84


def family(r, size):
    """Texts that no two of link, but for every fourth one and a partner of Jaccard 266 / 326; all share the most of their shingles."""
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(300)]
    texts = []
    for k in range(size):
        places = r.sample(range(10, 290, 10), 7)
        own = list(base)
        for p in places[:4]:
            own[p] = word()
        texts.append(" ".join(own))
        if k % 4 == 0:
            other = list(base)
            other[places[0]] = own[places[0]]
            for p in places[4:]:
                other[p] = word()
            texts.append(" ".join(other))
    return texts


def test_no_link_of_a_large_group_is_lost(spark):
    """Links that lie no nearer by SimHash than the hundreds of unlinked members of their groups."""
    table = list(enumerate(family(random.Random(3), 240)))
    docs = spark.createDataFrame(table, "doc_id long, text string").coalesce(1)
    got = {x.doc_id for x in near_copies.keep_first(docs).collect()}
    assert len(table) - len(got) >= 60 and got == brute_first(table)


@pytest.mark.parametrize("block", [5_000, 50])
def test_links_beyond_few_central_members(spark, monkeypatch, block):
    monkeypatch.setattr(near_copies, "FORESTS", 1)
    monkeypatch.setattr(near_copies, "HUBS", 1)
    monkeypatch.setattr(near_copies, "BLOCK", block)
    monkeypatch.setattr(near_copies, "CHUNK", 500)
    table = [(k, t) for k, (_, t) in enumerate(near_table())]
    table += [(len(table) + k, t) for k, t in enumerate(family(random.Random(4), 80))]
    docs = spark.createDataFrame(table, "doc_id long, text string").coalesce(2)
    assert {x.doc_id for x in near_copies.keep_first(docs).collect()} == brute_first(table)


def test_links_of_far_simhashes(spark):
    """Four of five shingles are common, and more than 24 bits of the SimHashes differ."""
    words = lambda k: [f"{c}{k}" for c in "abcdefghi"]
    table = [(2 * n + e, " ".join(words(k)[: 8 + e])) for n, k in enumerate((1707, 2094, 3676, 18114)) for e in (0, 1)]
    fps = [near_copies.majority(near_copies.shingles(t, 5).astype(">u8").tobytes()) for _, t in table]
    assert all((a ^ b).bit_count() > 24 for a, b in zip(fps[::2], fps[1::2]))
    docs = spark.createDataFrame(table, "doc_id long, text string").coalesce(1)
    assert {x.doc_id for x in near_copies.keep_first(docs).collect()} == {0, 2, 4, 6}


def brink(r, size):
    """Texts of Jaccard 296 / 376, hardly less than linked; every tenth has a partner that it links with."""
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(300)]
    texts = []
    for k in range(size):
        own = base + [word() for _ in range(40)]
        texts.append(" ".join(own))
        if k % 10 == 0:
            texts.append(" ".join([*own[:-1], word()]))
    return texts


@pytest.mark.parametrize("cluster", [2_000, 30])
def test_rows_grow_with_members_not_with_pairs(spark, monkeypatch, cluster):
    monkeypatch.setattr(near_copies, "CLUSTER", cluster, raising=False)
    monkeypatch.setattr(near_copies, "SAMPLE", 1)
    kept, rows = near_copies.pinned, {}

    def counted(df, name, *args, **kwargs):
        out = kept(df, name, *args, **kwargs)
        rows.setdefault(size, {})[name] = out.count()
        return out

    monkeypatch.setattr(near_copies, "pinned", counted)
    for size in (60, 240):
        table = list(enumerate(brink(random.Random(5), size)))
        docs = spark.createDataFrame(table, "doc_id long, text string").coalesce(1)
        assert {x.doc_id for x in near_copies.keep_first(docs).collect()} == brute_first(table)
    after = {k: n for k, n in rows[240].items() if k not in ("met", "candidates")}  # these hold all pairs of small groups
    assert all(n <= 6 * rows[60][k] + 264 for k, n in after.items()), rows
    assert after["again"] >= 240  # parities leave nearly all members a pair


def test_sketches_as_parities(spark):
    r = random.Random(6)
    sets = [near_copies.shingles(" ".join(r.choice("abcdef") for _ in range(n)), 3) for n in (0, 1, 3, 40, 90, 300, 900, 2000)]
    sets += [x[: len(x) * 9 // 10] for x in sets]
    bits = [near_copies._parities(x) for x in sets]
    i, j = (x.ravel() for x in near_copies.np.meshgrid(range(len(sets)), range(len(sets))))
    assert near_copies._Sketches(bits).apart(i, j).tolist() == [near_copies._apart(bits[a], bits[b]) for a, b in zip(i, j)]
