"""The registered queries of this subpackage, one for each operator, and their SQL forms."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.catalog.registry import registry
from tidemill.llm import ann, audit, chat, codes, jaccard, language, leaks, mixing, packing, pages, pii, sharding, tokens
from tidemill.session import scratch_path

QUERIES, ORACLES, query = registry()

#: Of op1 and the last stage of the pipeline.
TOKENIZER, END_ID = "word_bpe_49k.json", 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def token_digests(spark: SparkSession, docs: DataFrame) -> DataFrame:
    folder = scratch_path(spark, "tokens")
    manifest = tokens.write_token_files(docs, folder, public_tokenizers.path(TOKENIZER), END_ID)
    return tokens.read_documents(spark, folder, manifest)


@query()
def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(spark, table(spark, sf_dir, "documents"))


def language_model(docs: DataFrame) -> language.LanguageModel:
    return language.fit(docs, ~language.held_out(F.col("doc_id")))


@query()
def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.predict_languages(docs, language_model(docs))


JACCARD_SQL = r"""
WITH RECURSIVE worded AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS MATERIALIZED (
  SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1),
    lambda i: array_to_string(w[i:i + 4], ' ')))) END AS s FROM worded),
nodes AS MATERIALIZED (SELECT row_number() OVER () AS n, s, len(s) AS size, min(doc_id) AS first_id FROM sets WHERE len(s) > 0 GROUP BY s),
entries AS MATERIALIZED (SELECT n, size, unnest(s) AS g FROM nodes),
common AS (SELECT a.n AS a, b.n AS b, any_value(a.size) + any_value(b.size) AS both_sizes, count(*) AS k FROM entries a JOIN entries b ON a.g = b.g AND a.n < b.n
  WHERE 100 * least(a.size, b.size) >= 75 * greatest(a.size, b.size) GROUP BY 1, 2),
one_way AS (SELECT a, b FROM common WHERE 100 * k >= 75 * (both_sizes - k)),
links AS MATERIALIZED (SELECT a, b FROM one_way UNION ALL SELECT b, a FROM one_way),
reach AS (SELECT n AS a, n AS b FROM nodes UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
lowest AS (SELECT reach.a AS n, min(nodes.first_id) AS component_id FROM reach JOIN nodes ON reach.b = nodes.n GROUP BY 1)
SELECT sets.doc_id, len(sets.s)::BIGINT AS n_shingles, CASE WHEN len(sets.s) = 0 THEN sets.doc_id ELSE lowest.component_id END AS component_id
FROM sets LEFT JOIN nodes ON sets.s = nodes.s LEFT JOIN lowest USING (n)
"""


@query(JACCARD_SQL)
def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked_components(table(spark, sf_dir, "documents"))


@query()
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


MIX_SQL = r"""
WITH rows AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
sized AS (SELECT source, sum(size)::BIGINT AS source_size FROM rows GROUP BY source),
weighed AS (SELECT *, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM sized),
levels AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap,
    1.5::DOUBLE * (SELECT sum(source_size) FROM sized)
      - coalesce(sum(2.0::DOUBLE * source_size) OVER (up ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(weight) OVER (ORDER BY 2.0::DOUBLE * source_size / weight DESC, source DESC NULLS FIRST) AS rest_weight,
    row_number() OVER up AS n
  FROM weighed WINDOW up AS (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST)),
first_free AS (SELECT min(n) AS n FROM levels WHERE rest / rest_weight * weight <= cap),
free AS (SELECT rest / rest_weight AS level, n FROM levels WHERE n = (SELECT n FROM first_free)),
targets AS (SELECT l.source, l.source_size, CASE WHEN l.n < f.n THEN l.cap ELSE l.weight * f.level END AS target FROM levels l, free f),
placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5('0:' || coalesce(doc_id::VARCHAR, '')), doc_id, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_row FROM rows)
SELECT p.doc_id, p.size::BIGINT AS size, t.source_size, t.target,
  (p.size * ((2 * p.before_row + p.size <= 2 * floor(t.target))::INT + (2 * p.before_row + p.size + 2 * t.source_size <= 2 * floor(t.target))::INT))::BIGINT AS taken
FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source
"""


@query(MIX_SQL)
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken, targets, sizes = mixing.by_one_source(table(spark, sf_dir, "documents"))
    about = spark.createDataFrame([(s, sizes[s], float(t)) for s, t in targets.items()], "source string, source_size long, target double")
    out = taken.withColumn("of", F.element_at("members", 1)).join(about, F.col("of").eqNullSafe(F.col("source")))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query()
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"), shards=8)


@query()
def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.read_back(chat.windows(turns.unionByName(probe)))


@query()
def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


@query()
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


@query()
def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_texts(table(spark, sf_dir, "pages"))


AUDIT_SQL = r"""
WITH rows AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
worded AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM rows),
firsts AS (SELECT t, min(doc_id) AS first_id FROM rows GROUP BY t),
known AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
masks AS (
  SELECT w.part, (len(words) < 50)::INT + 2 * (100 * len(list_distinct(words)) < 65 * len(words))::INT
    + 4 * (100 * len(regexp_extract_all(w.t, '[A-Z]')) > 5 * length(w.t))::INT
    + 8 * regexp_matches(w.t, '[#$%&*|]')::INT + 16 * coalesce(w.doc_id > f.first_id, false)::INT AS mask,
    coalesce(k.good, 0) AS good, coalesce(k.toxic, 0) AS toxic
  FROM worded w JOIN firsts f ON w.t = f.t LEFT JOIN known k ON w.doc_id = k.doc_id),
counts AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masks GROUP BY part, mask),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
    AND a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps AS (
  SELECT filter_order, step::INT AS step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS earlier
  FROM orders, range(1, 6) AS r(step)),
found AS (
  SELECT part, filter_order, step, own,
    sum(CASE WHEN mask & (own + earlier) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN mask & own > 0 AND mask & earlier = 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN mask & own > 0 AND mask & earlier > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN mask = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN mask & own > 0 AND mask & earlier = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN mask & own > 0 AND mask & earlier = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM counts, steps GROUP BY part, filter_order, step, own)
SELECT * EXCLUDE (own), (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM found
"""


@query(AUDIT_SQL)
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(audit.failures(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def _codes_sql(rounds: int = 4) -> str:
    """Lloyd rounds spelled out, one pair of tables per round."""
    near = (
        "SELECT n, p, min(d * 256 + e) AS best FROM (SELECT x.n, x.p, c.e, "
        "list_sum(list_transform(list_zip(x.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d "
        "FROM parts x JOIN c{k} c ON x.p = c.p) GROUP BY n, p"
    )
    moved = (
        "m{k} AS MATERIALIZED (SELECT p, e, list(CASE WHEN s % c < 0 THEN s // c - 1 ELSE s // c END ORDER BY i) AS x FROM "
        "(SELECT a.p, a.best % 256 AS e, i, sum(x.x[i])::BIGINT AS s, count(*) AS c FROM a{k} a JOIN parts x USING (n, p), "
        "range(1, (SELECT max(len(x)) FROM parts) + 1) r(i) GROUP BY 1, 2, 3) GROUP BY p, e), "
        "c{l} AS MATERIALIZED (SELECT c.p, c.e, coalesce(m.x, c.x) AS x FROM c{k} c LEFT JOIN m{k} m USING (p, e))"
    )
    steps = ", ".join(f"a{k} AS MATERIALIZED ({near.format(k=k)}), {moved.format(k=k, l=k + 1)}" for k in range(rounds))
    return (
        "WITH kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v, "
        "row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS n FROM embeddings "
        "WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0), "
        "parts AS MATERIALIZED (SELECT n, p, v[p * (len(v) // 4) + 1 : (p + 1) * (len(v) // 4)] AS x FROM kept, range(4) r(p)), "
        f"c0 AS MATERIALIZED (SELECT p, n - 1 AS e, x FROM parts WHERE n <= 256), {steps}, "
        f"last AS MATERIALIZED ({near.format(k=rounds)}), "
        "coded AS (SELECT n, string_agg(lpad(lower(to_hex(best % 256)), 2, '0'), '' ORDER BY p) AS code, "
        "sum(best // 256)::BIGINT AS error FROM last GROUP BY n), "
        f"books AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{rounds}) "
        "SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 "
        "FROM kept JOIN coded USING (n), books"
    )


@query(_codes_sql())
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compressed(table(spark, sf_dir, "embeddings"))


@query()
def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), capacity=4096, end_id=1)
    return packing.packed(packing.with_crc(pieces), capacity=4096)
