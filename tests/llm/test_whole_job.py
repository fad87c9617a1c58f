"""Cases that an operator once left out."""

import zlib

import pytest

pytest.importorskip("gridloom.llm")

import corpus_pipeline  # noqa: E402
from gridloom.llm import packing, pii  # noqa: E402
from gridloom.llm.queries import tokenizer_file  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def found(text):
    return [(k, text[s:e]) for k, s, e in pii.find(text, pii._automaton())]


def test_pii_cues_beside_a_dotted_capital():
    text = "\u0130stanbul, IBAN DE89 3704 0044 0532 0130 00, Passport 12345678, \u0130 SSN 123-45-6789"
    assert found(text) == [("account", "DE89 3704 0044 0532 0130 00"), ("account", "12345678"), ("account", "123-45-6789")]


def test_pii_long_credentials():
    for user, word, path in (("u", "p" * 300, ""), ("u" * 300, "p", "/x"), ("u", "p", "/" + "x" * 5000), ("u", "p" * 100_000, "/y")):
        url = f"https://{user}:{word}@host.example:80{path}"
        assert ("url", url) in found(f"see {url} there")
    assert "url" not in dict(found("x://a:b" * 50_000))


def test_packing_reads_added_tokens_as_the_plain_call(spark):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokenizer_file())
    texts = ["a<|endoftext|>b", "x <|endoftext|> y", "<|endoftext|>", "no such <| text", "two  blanks<|endoftext|>"]
    docs = spark.createDataFrame([(k, t, None, None, None) for k, t in enumerate(texts)], DOCS)
    want = {}
    for k, t in enumerate(texts):
        ids = model.encode(t, add_special_tokens=False).ids + [2]
        want[k] = (len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids)))
    assert want[0][0] == 4
    for got in (packing.pack_documents(docs, tokenizer_file(), literal=False), corpus_pipeline.pack_sequences(spark, docs, "")):
        assert {x.doc_id: (x.length, x.ids_crc32) for x in got.collect()} == want


def test_contaminated_rows_go_by_row(spark, tmp_path):
    item = "one two three four five six seven eight nine ten eleven"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, "a " + item, "en", "gone", 0), (7, item, "en", "gone", 0), (7, "clean text", "en", "kept", 0), (None, "other text", "en", "kept", 0)]
    docs = spark.createDataFrame(rows, DOCS).coalesce(1)
    got = [(x.doc_id, x.source) for x in corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path)).collect()]
    assert sorted(got, key=str) == [(7, "kept"), (None, "kept")]
