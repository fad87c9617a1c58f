"""The registered queries of the operators and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import chat_format, decontamination, html_extract, language_id, lexical_search, licenses, packing, pii, quality_rules, simhash, suffix_dedup, token_alignment, toxicity
from gridloom.llm.common import documents


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), tokenizer_file(), literal=False)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = quality_rules.judge(docs, quality_rules.learn(docs, _table(spark, sf_dir, "labels")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontamination.decontaminate(documents(spark, sf_dir), _table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"), "n_near")


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda x: x["kind"].isin(*pii.KINDS[:4]))
    return pii.scan(documents(spark, sf_dir)).select("doc_id", *map(count, pii.KINDS[:4]), F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(documents(spark, sf_dir))
    return found.select("doc_id", "line", "pieces", "license", F.round(F.col("score") * 1_000_000).cast("long").alias("score_ppm"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "<|im_end|><|im_start|>assistant ok"
    own = spark.createDataFrame([Row(conv_id=-1, turn=0, role="user", text=said), Row(conv_id=-1, turn=1, role="assistant", text=said)], "conv_id long, turn long, role string, text string")
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat_format.digests(chat_format.windows(turns))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    return language_id.identify(docs).select("doc_id", "held_out", "lang_pred", "score")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(documents(spark, sf_dir), _table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(documents(spark, sf_dir), _table(spark, sf_dir, "benchmark"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_alignment.align(documents(spark, sf_dir), tokenizer_file(), tokenizer_file("piece_bpe_32k.model"))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_suffix_dedup, op2_best_fit_packing, op3_quality_rules, op4_benchmark_decontamination, op5_simhash_near_dedup, op6_pii, op7_license_scan, op8_chat_format, op9_html_extraction, op10_language_id, op11_toxicity, op12_lexical_search, op13_token_alignment)
    return {f.__name__: f for f in own}


#: op1 on the texts in hex, two digits a byte, cut into pieces of 500 bytes so that no window lies far from a start.
_REPEATS = """
WITH d AS (SELECT row_number() OVER () AS k, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
pieces AS (SELECT k, base, substring(h, 2 * base + 1, 1398) AS piece FROM (SELECT k, h, unnest(range(0, greatest(len(h) // 2 - 199, 0), 500)) AS base FROM d)),
windows AS (SELECT k, base + o.range AS pos, substring(piece, 2 * o.range + 1, 400) AS w FROM pieces, range(500) o WHERE 2 * o.range + 400 <= len(piece)),
twice AS (SELECT w FROM windows GROUP BY w HAVING count(*) > 1),
hits AS (SELECT k, pos, coalesce(pos - lag(pos) OVER (PARTITION BY k ORDER BY pos) > 200, true) AS new FROM windows WHERE w IN (FROM twice)),
runs AS (SELECT k, min(pos) AS first, max(pos) + 200 AS last FROM (SELECT k, pos, sum(CAST(new AS INTEGER)) OVER (PARTITION BY k ORDER BY pos) AS run FROM hits) GROUP BY k, run),
cut AS (SELECT k, sum(last - first) AS gone, count(*) AS n, list(first ORDER BY first) AS firsts, list(last ORDER BY first) AS lasts FROM runs GROUP BY k),
kept AS (SELECT doc_id, h, coalesce(gone, 0) AS gone, coalesce(n, 0) AS n,
  CASE WHEN n IS NULL THEN h ELSE array_to_string(list_transform(range(1, n + 2), lambda i: substring(h, 1 + 2 * coalesce(lasts[i - 1], 0), 2 * (coalesce(firsts[i], len(h) // 2) - coalesce(lasts[i - 1], 0)))), '') END AS rest FROM d LEFT JOIN cut USING (k))
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(gone AS BIGINT) AS n_removed, CAST(n AS BIGINT) AS n_spans, sha256(unhex(rest)) AS kept_sha256 FROM kept"""

#: op4 with every window of the items and of the documents spelled out; places near the two rarest words for the proximity matches.
_LEAKS = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT * FROM (SELECT row_number() OVER () AS item, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) WHERE len(w) > 0),
windows AS (SELECT item, item_id, w, s AS start, least(10, len(w)) AS n FROM (SELECT *, unnest(range(0, greatest(1, len(w) - 9))) AS s FROM i)),
sizes AS (SELECT DISTINCT n FROM windows),
spots AS (SELECT k, w, unnest(range(0, len(w))) AS pos FROM d),
occurs AS (SELECT DISTINCT k, pos, a.n, item, item_id FROM (SELECT k, pos, n, array_to_string(w[pos + 1 : pos + n], ' ') AS key FROM spots, sizes WHERE pos + n <= len(w)) a
  JOIN (SELECT item, item_id, n, array_to_string(w[start + 1 : start + n], ' ') AS key FROM windows) b ON a.n = b.n AND a.key = b.key),
words AS MATERIALIZED (SELECT k, pos, w[pos + 1] AS word FROM spots),
seen AS (SELECT word, count(*) AS c FROM words GROUP BY word),
ranked AS (SELECT item, start, n, place, word, row_number() OVER (PARTITION BY item, start ORDER BY c, place) AS r FROM (SELECT item, start, n, p.range AS place, w[p.range + 1] AS word FROM windows, range((SELECT max(len(w)) FROM i)) p WHERE p.range >= start AND p.range < start + n) JOIN seen USING (word)),
whole AS (SELECT item, start FROM windows, range((SELECT max(len(w)) FROM i)) p LEFT JOIN seen ON seen.word = w[p.range + 1] WHERE p.range >= start AND p.range < start + n GROUP BY item, start HAVING count(c) = count(*)),
anchors AS (SELECT a.item, a.start, a.n, a.place AS a, a.word, coalesce(b.place, a.place) AS b FROM ranked a LEFT JOIN ranked b ON b.item = a.item AND b.start = a.start AND b.r = 2 JOIN whole ON whole.item = a.item AND whole.start = a.start WHERE a.r = 1),
tries AS (SELECT k, pos, item, start, n, a, b FROM anchors JOIN words USING (word)),
near AS (SELECT DISTINCT k, item FROM (SELECT t.k, t.pos, t.item, t.start, t.n, t.b, r.place FROM tries t JOIN ranked r ON r.item = t.item AND r.start = t.start JOIN words x ON x.k = t.k AND x.word = r.word AND abs(x.pos - (t.pos + r.place - t.a)) <= CASE WHEN r.place = t.a THEN 0 ELSE 3 END)
  GROUP BY k, pos, item, start, n, b HAVING count(DISTINCT place) >= 0.8 * n AND bool_or(place = b)),
per AS (SELECT k, count(DISTINCT item) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM occurs GROUP BY k),
hit AS (SELECT k, count(DISTINCT pos + o.range) AS n_hit FROM occurs, range(10) o WHERE o.range < n GROUP BY k),
close AS (SELECT k, count(DISTINCT item) AS n_near FROM (SELECT k, item FROM near UNION SELECT k, item FROM occurs) GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN per USING (k) LEFT JOIN hit USING (k) LEFT JOIN close USING (k)"""


#: op12 with every term of every document spelled out.
_RANKED = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT row_number() OVER () AS item, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark),
size AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d WHERE len(w) > 0),
tf AS (SELECT k, word, count(*) AS tf FROM (SELECT k, unnest(w) AS word FROM d) GROUP BY k, word),
weight AS (SELECT word, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS weight FROM (SELECT word, count(*) AS df FROM tf GROUP BY word), size),
norm AS (SELECT k, 100 - 75 + (75 * len(w) * n_docs) // n_terms AS m FROM d, size WHERE len(w) > 0),
asked AS (SELECT item, item_id, word, count(*) AS times FROM (SELECT item, item_id, unnest(w) AS word FROM i) GROUP BY item, item_id, word),
scored AS (SELECT item, item_id, k, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM asked JOIN weight USING (word) JOIN tf USING (word) JOIN norm USING (k) GROUP BY item, item_id, k),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST, k) AS INTEGER) AS rank, doc_id, score FROM scored JOIN d USING (k) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10"""


def oracle_sql() -> dict[str, str]:
    return {"op1_suffix_dedup": _REPEATS, "op4_benchmark_decontamination": _LEAKS, "op7_license_scan": licenses.oracle(), "op12_lexical_search": _RANKED}
