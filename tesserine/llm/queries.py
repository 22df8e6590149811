"""The thin queries over these operators, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.llm import language_id, quality_cnn
from tesserine.llm.bag_minhash import near_duplicates
from tesserine.llm.common import SPACE, Scratch, documents, id_hash_mod, let
from tesserine.llm.exact_dedup import exact_dedup
from tesserine.llm.packing import pack_documents
from tesserine.llm.periodic_runs import periodic_runs
from tesserine.llm.personal_data import BASE, described, find_personal_data
from tesserine.llm.quality_rules import RULES, STOP_WORDS, quality_rules
from tesserine.llm.repeated_spans import remove_repeated_spans
from tesserine.llm.sentence_pieces import round_trips
from tesserine.llm.token_counts import token_counts
from tesserine.llm.vector_codes import ENTRIES, PARTS, ROUNDS, SCALE, vector_codes
from tesserine.llm.warc import round_trip

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where a public vocabulary is; it stays outside the repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), tokenizer_path())


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_spans(documents(spark, sf_dir), digest=True)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    held_out = F.coalesce(id_hash_mod("doc_id", 5) == 0, F.lit(True))
    learned = language_id.learn_sample(docs, held_out, "doc_id", "text", "lang")
    return language_id.identify(docs, learned, [F.col("doc_id"), held_out.alias("held_out")])


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir)).drop("text")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir)).drop("text_key")


def op6_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trips(documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).drop("text_key")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    scratch = Scratch(spark)
    records = round_trip(pages, f"{scratch.root}/warc")
    scratch.drop()
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("refers_to_page_id").alias("refers_to"))


def op9_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    held_out = F.coalesce(id_hash_mod("doc_id", 4) == 2, F.lit(True))
    net = quality_cnn.train(*quality_cnn.learn_sample(docs, labels, ~held_out, "quality"))
    return quality_cnn.classify(docs, net, [F.col("doc_id"), held_out.alias("held_out")])


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), tokenizer_path(), keep_text=False)


def planted(text: Column, doc_id: Column) -> Column:
    """Texts of a tenth of the ids with a repeating tail, as the contract of op11 has them; the others as they are."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), lambda w: w != "")

    def repeated(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.element_at(w, (a + (i - a) % p + 1).cast("int"))))

    return F.when(h % 10 == 0, F.array_join(let(words, repeated), " ")).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("text", planted(F.col("text"), F.col("doc_id")))
    found = periodic_runs(docs, keep_text=False)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return found.select("doc_id", "runs", "collapsed", best.alias("best")).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2(F.coalesce("collapsed", F.lit("")), 256).alias("collapsed_sha256"),
    )


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    coded, books = vector_codes(vectors)
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    labels = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return coded.join(labels, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", code.alias("code"), "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(documents(spark, sf_dir), keep_text=False)

    def of(*kinds: str) -> Column:
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    counts = [F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in BASE]
    return found.select("doc_id", *counts, F.sha2(described(of(*BASE)), 256).alias("base_sha256"), described(F.col("spans")).alias("spans"))


QUERIES: dict[str, Query] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_language_id": op3_language_id,
    "op4_quality_rules": op4_quality_rules,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_sentence_pieces": op6_sentence_pieces,
    "op7_near_dedup": op7_near_dedup,
    "op8_warc": op8_warc,
    "op9_quality_cnn": op9_quality_cnn,
    "op10_token_counts": op10_token_counts,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_vector_codes": op12_vector_codes,
    "op13_personal_data": op13_personal_data,
}


def _rules_sql() -> str:
    """The threshold table as a DuckDB condition."""
    parts = []
    for r in RULES:
        within = [f"{r.measure} >= {r.low}" if r.low is not None else "", f"{r.measure} <= {r.high}" if r.high is not None else ""]
        parts.append(f"(n_words < {r.from_words} OR ({' AND '.join(x for x in within if x)}))")
    return " AND ".join(parts)


def _codes_sql() -> str:
    """Operator 12 with full searches: a table of codes and one of entries for each round."""
    steps = [
        f"""units AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})::BIGINT) AS u
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
  SELECT vec_id, label, p, u[p * len(u) // {PARTS} + 1 : (p + 1) * len(u) // {PARTS}] AS v FROM units, range({PARTS}) AS t(p)
), entries0 AS MATERIALIZED (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v AS c
  FROM parts SEMI JOIN (SELECT vec_id FROM units ORDER BY vec_id LIMIT {ENTRIES}) USING (vec_id)
)"""
    ]
    for k in range(ROUNDS + 1):
        steps.append(f"""codes{k} AS MATERIALIZED (
  SELECT vec_id, label, p, any_value(v) AS v, min((d, e)) AS best
  FROM (SELECT x.*, e, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM parts x JOIN entries{k} USING (p))
  GROUP BY vec_id, label, p
)""")
        if k < ROUNDS:
            steps.append(f"""means{k} AS (
  SELECT p, e, list(m ORDER BY i) AS c FROM (
    SELECT p, best[2] AS e, i, floor(sum(v[i])::HUGEINT / count(*))::BIGINT AS m
    FROM codes{k}, range(1, (SELECT max(len(u)) FROM units) // {PARTS} + 1) AS t(i) GROUP BY ALL
  ) GROUP BY p, e
), entries{k + 1} AS MATERIALIZED (
  SELECT p, e, coalesce(m.c, o.c) AS c FROM entries{k} o LEFT JOIN means{k} m USING (p, e)
)""")
    return f"""
WITH {", ".join(steps)}
, coded AS (
  SELECT vec_id, label, string_agg(printf('%02x', best[2]), '' ORDER BY p) AS code, sum(best[1])::BIGINT AS error FROM codes{ROUNDS} GROUP BY vec_id, label
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM entries{ROUNDS}) AS codebooks_sha256
FROM coded"""


SQL: dict[str, str] = {
    "op4_quality_rules": rf"""
WITH split AS (
  SELECT doc_id, coalesce(text, '') AS body,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i : i + 7], ' ') AS win
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 7)) AS i FROM split WHERE len(w) > 8)
), repeated AS (
  SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS next
  FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS c FROM windows) WHERE c > 1
), covered AS (
  SELECT doc_id, sum(least(8, coalesce(next - i, 8))) AS n FROM repeated GROUP BY doc_id
), base AS (
  SELECT doc_id, len(w)::BIGINT AS n_words,
         length(regexp_replace(body, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(body, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
         len(l) AS n_lines,
         len(list_filter(w, lambda x: lower(x) IN ({", ".join(f"'{x}'" for x in dict.fromkeys(STOP_WORDS))}))) AS n_stop,
         len(list_filter(w, lambda x: x = upper(x) AND x <> lower(x) AND length(x) > 1)) AS n_upper,
         len(list_filter(l, lambda x: regexp_matches(x, '^\s*[-*•|]') OR regexp_matches(x, '(\.\.\.|…)\s*$'))) AS n_mark
  FROM split LEFT JOIN covered USING (doc_id)
), ratios AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
         word_chars / greatest(n_words, 1) AS mean_word_chars, n_symbols / greatest(n_words, 1) AS symbols_per_word,
         n_upper / greatest(n_words, 1) AS upper_word_ratio, n_stop / greatest(n_words, 1) AS stop_word_ratio,
         n_dup_lines / greatest(n_lines, 1) AS dup_line_ratio, n_mark / greatest(n_lines, 1) AS mark_line_ratio
  FROM base
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {_rules_sql()} AS kept
FROM ratios""",
    "op5_exact_dedup": r"""
WITH rows AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS normal
  FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY normal) AS group_size,
       row_number() OVER w = 1 AS kept, sha256(normal) AS text_sha256
FROM rows WINDOW w AS (PARTITION BY normal ORDER BY chars DESC, doc_id)""",
    "op8_warc": r"""
WITH rows AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), groups AS (
  SELECT *, max(page_id) OVER (PARTITION BY h) AS keeper FROM rows
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
       array_to_string([array_to_string(['ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((('0x' || h[5 * j + 1 : 5 * j + 5])::BIGINT >> (15 - 5 * k)) & 31) + 1] FOR k IN range(4)], '') FOR j IN range(8)], '') AS payload_digest,
       CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> keeper THEN keeper END AS refers_to
FROM groups""",
    "op12_vector_codes": _codes_sql(),
}
