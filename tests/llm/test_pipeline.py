"""The corpus pipeline against a brute-force version over the same small table."""

import collections
import os
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

pytest.importorskip("gridloom.llm")

import corpus_pipeline  # noqa: E402
from gridloom.llm import pii  # noqa: E402
from gridloom.llm.queries import tokenizer_file  # noqa: E402

SF = "/root/testdata/sf0.001"


def made_up(spark, folder):
    """Tables with null and repeated ids, copies, near copies, leaks, personal data, a very long text and clashing names."""
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7)))
    texts = [" ".join(word() for _ in range(n)) for n in (0, 1, 4, 5, 9, 40, 90, 300, 300, 20_000)]
    item = " ".join(word() for _ in range(15))
    texts += [texts[7], texts[7] + " " + word(), texts[5].upper(), texts[8] + " " + item, item, None, "", "12 34", "mail a.b@c.de now, " + texts[6], texts[4] + "\n" + texts[3]]
    ids = [None if k in (2, 13) else 6 if k == 8 else k for k in range(len(texts))]
    rows = [(i, t, r.choice(["en", "fr"]), "s", None if t is None else len(t), "clash", 1.0, "clash") for i, t in zip(ids, texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, score double, key string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


@pytest.mark.parametrize("given", [True, False])
def test_pipeline_against_brute_force(spark, tmp_path, given):
    from tokenizers import Tokenizer

    if given and not os.path.isdir(SF):
        pytest.skip("the synthetic tables are not here")
    folder = SF if given else made_up(spark, str(tmp_path))
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").orderBy(F.col("doc_id").asc_nulls_last()).collect()]
    items = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    docs = [(i, t) for i, t in docs if t and any(c.isalpha() for c in t)]

    def shingles(t):
        w = t.encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    # near copies share 0.8 of their five-word shingles
    sets = [shingles(t) for _, t in docs]
    near = [[j for j, b in enumerate(sets) if a == b or len(a & b) >= 0.8 * len(a | b) - 1e-9] for a in sets]
    label = list(range(len(docs)))
    changed = True
    while changed:
        changed = False
        for i, own in enumerate(near):
            least = min(label[j] for j in [i, *own])
            if least < label[i]:
                label[i], changed = least, True
    docs = [d for k, d in enumerate(docs) if label[k] == k]

    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {tuple(w[s : s + 10]) for w in map(words, items) if w for s in range(max(1, len(w) - 9))}
    sizes = {len(x) for x in windows}
    docs = [(i, t) for i, t in docs if not any(tuple(w[s : s + n]) in windows for w in [words(t)] for n in sizes for s in range(len(w) - n + 1))]

    automaton = pii._automaton()
    docs = [(i, pii.masked(t, pii.find(t, automaton))) for i, t in docs]
    model = Tokenizer.from_file(tokenizer_file())
    want = collections.Counter()
    for i, t in docs:
        ids = model.encode(t, add_special_tokens=False).ids + [2]
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        cuts = cuts if cuts[-1] == len(ids) else [*cuts, len(ids)]
        want += collections.Counter((i, k, a, b - a, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[a:b]))) for k, (a, b) in enumerate(zip(cuts, cuts[1:])))
    got = corpus_pipeline.run(spark, folder).collect()
    assert collections.Counter((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in got) == want
    places = collections.defaultdict(list)
    for x in got:
        places[x.sequence_id].append((x.offset, x.length))
    for own in places.values():
        own.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and own[0][0] == 0 and sum(own[-1]) <= 1024
    assert len(places) <= -(-sum(x.length for x in got) // 1024) * 1.02 + 1


def test_stages_keep_the_columns(spark):
    table = [(1, "the of and the of", "en", "s", 17), (2, None, "en", None, None), (3, "", None, "s", 0), (4, "123", "en", "s", 3), (None, "and of", "en", "s", 6)]
    docs = spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.identify_language(spark, docs, SF)
    assert kept.columns == docs.columns and {x.doc_id for x in kept.collect()} == {1, None}
    for stage in (corpus_pipeline.drop_near_duplicates, corpus_pipeline.mask_personal_data):
        assert stage(spark, docs, SF).columns == docs.columns
    assert corpus_pipeline.pack_sequences(spark, docs, SF).count() == 5
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
