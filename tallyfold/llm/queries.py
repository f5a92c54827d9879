"""The registered queries of this subpackage: each applies one operator to its whole table."""

import public_tokenizers
from pyspark.sql import functions as F

from tallyfold.llm import (
    backoff, caps, collocations, innerproducts, languages, packing, quality, secrets, sentencepieces, sharding, simhash,
    substrings, whitening)
from tallyfold.llm.common import written

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
CAPACITY = 2048


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def near_vectors(spark, sf_dir):
    return caps.near_duplicates(table(spark, sf_dir, "embeddings"), 0.9)


def balanced_shards(spark, sf_dir):
    found = sharding.shards(table(spark, sf_dir, "documents"), 8)
    return found.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def top_inner_products(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    finite = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    vectors = vectors.where(finite).select("vec_id", F.transform("x", lambda x: F.floor(x * 64)).alias("v"))
    return innerproducts.top_k(vectors.where("vec_id % 20 = 0"), vectors, 20)


def simhash_near_dedup(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.withColumn("fingerprint", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")))


def backoff_scores(spark, sf_dir):
    found = backoff.score(table(spark, sf_dir, "documents"), order=3, least=2)
    return found.select(
        "doc_id", "n_words", *(F.col("n_by_order")[k].alias(f"n_by_{k + 1}") for k in range(3)), "score_micro")


def substring_dedup(spark, sf_dir):
    found = substrings.remove_repeats(table(spark, sf_dir, "documents"), window=20)
    return found.select("carried.doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def sentencepiece_round_trip(spark, sf_dir):
    coded = sentencepieces.encode(table(spark, sf_dir, "documents"), PIECE_MODEL)
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def secret_scan(spark, sf_dir):
    found = secrets.scan(table(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda span: span["kind"])
    counts = [F.size(F.filter(kinds, F.lit(kind).__eq__)).cast("long").alias(f"n_{kind}") for kind in secrets.KINDS[:3]]
    return found.select(
        "carried.doc_id", *counts, F.sha2(secrets.listed("base"), 256).alias("base_sha256"), secrets.listed("spans").alias("spans"))


def best_fit_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), BYTE_TOKENIZER, CAPACITY)


def language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    profiles = languages.learn(docs.where(~languages.held_out()))
    found = languages.identify(docs, profiles)
    return found.select("doc_id", languages.held_out().alias("held_out"), "lang_pred", "score")


def collocation_mining(spark, sf_dir):
    return collocations.mine(table(spark, sf_dir, "documents"), least=30, best=2000, share=80)


def embedding_whitening(spark, sf_dir):
    found = whitening.whiten(table(spark, sf_dir, "embeddings"), 8)
    return found.withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))


def quality_classifier(spark, sf_dir):
    rows = written(quality.described(table(spark, sf_dir, "documents")))
    labels = table(spark, sf_dir, "labels")
    model = quality.learn(quality.labelled(rows, labels, "quality", ~quality.held_out()))
    found = quality.scores(rows, model)
    return found.select("doc_id", quality.held_out().alias("held_out"), "score",
                        F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


QUERIES = {
    "op1_spherical_caps": near_vectors,
    "op2_balanced_shards": balanced_shards,
    "op3_top_inner_products": top_inner_products,
    "op4_stupid_backoff": backoff_scores,
    "op5_simhash_near_dedup": simhash_near_dedup,
    "op6_substring_dedup": substring_dedup,
    "op7_sentencepiece": sentencepiece_round_trip,
    "op8_secret_scan": secret_scan,
    "op9_best_fit_packing": best_fit_packing,
    "op10_language_id": language_id,
    "op11_collocations": collocation_mining,
    "op12_whitening": embedding_whitening,
    "op13_quality_classifier": quality_classifier,
}
#: Words are those of whole texts, A to Z lower-cased; counts are over all documents.
BACKOFF_SQL = """
WITH words AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x20\\x09-\\x0D]+') AS w
    FROM documents),
places AS (
    SELECT doc_id, i, w[i] AS w1, CASE WHEN i > 1 THEN w[i - 1] || ' ' || w[i] END AS w2,
           CASE WHEN i > 2 THEN w[i - 2] || ' ' || w[i - 1] || ' ' || w[i] END AS w3,
           CASE WHEN i > 1 THEN w[i - 1] END AS h1,
           CASE WHEN i > 2 THEN w[i - 2] || ' ' || w[i - 1] END AS h2
    FROM words, unnest(range(1, len(w) + 1)) AS t(i)),
c1 AS (SELECT w1 AS g, count(*) AS c FROM places GROUP BY 1),
c2 AS (SELECT w2 AS g, count(*) AS c FROM places WHERE w2 IS NOT NULL GROUP BY 1),
c3 AS (SELECT w3 AS g, count(*) AS c FROM places WHERE w3 IS NOT NULL GROUP BY 1),
scored AS (
    SELECT doc_id, CASE WHEN c3.c >= 2 THEN 3 WHEN c2.c >= 2 THEN 2 ELSE 1 END AS k,
           CASE WHEN c3.c >= 2 THEN c3.c / b2.c
                WHEN c2.c >= 2 THEN (CASE WHEN i > 2 THEN 0.4::DOUBLE ELSE 1 END) * c2.c / b1.c
                ELSE (CASE WHEN i > 2 THEN 0.4::DOUBLE * 0.4::DOUBLE WHEN i > 1 THEN 0.4::DOUBLE ELSE 1 END)
                     * c1.c / (SELECT count(*) FROM places) END AS s
    FROM places JOIN c1 ON w1 = c1.g LEFT JOIN c2 ON w2 = c2.g LEFT JOIN c3 ON w3 = c3.g
    LEFT JOIN c1 AS b1 ON h1 = b1.g LEFT JOIN c2 AS b2 ON h2 = b2.g),
summed AS (
    SELECT doc_id, count(*) AS n_words, count(*) FILTER (k = 1) AS n_by_1, count(*) FILTER (k = 2) AS n_by_2,
           count(*) FILTER (k = 3) AS n_by_3, sum(round(1e6 * log10(s))::BIGINT)::BIGINT AS score_micro
    FROM scored GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_by_1, 0) AS n_by_1, coalesce(n_by_2, 0) AS n_by_2,
       coalesce(n_by_3, 0) AS n_by_3, coalesce(score_micro, 0) AS score_micro
FROM documents LEFT JOIN summed USING (doc_id)
"""

TOP_SQL = """
WITH v AS (
    SELECT vec_id, [floor(64 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL
      AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scores AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
           list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
    FROM v AS q JOIN v AS c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
ranked AS (
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
    FROM scores)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

NEAR_VECTORS_SQL = """
WITH RECURSIVE v AS (
    SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
    WHERE vec_id IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
      AND len([x FOR x IN embedding IF x <> 0]) > 0),
links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v AS a JOIN v AS b
    ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.9),
reached AS (
    SELECT vec_id AS a, vec_id AS b FROM embeddings
    UNION SELECT r.a, l.b FROM reached AS r JOIN links AS l ON r.b = l.a),
named AS (SELECT a AS vec_id, min(b) AS component_id FROM reached GROUP BY a)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE a = e.vec_id) AS n_links, component_id,
       e.vec_id = component_id AS kept
FROM embeddings AS e JOIN named USING (vec_id)
"""

REPEATS_SQL = """
WITH words AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
windows AS (
    SELECT doc_id, p, row_number() OVER (PARTITION BY array_to_string(w[p:p + 19], ' ') ORDER BY doc_id, p) AS turn
    FROM words, unnest(range(1, len(w) - 18)) AS t(p) WHERE len(w) >= 20),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS i FROM windows WHERE turn > 1),
kept AS (
    SELECT doc_id, i, w[i] AS word FROM words, unnest(range(1, len(w) + 1)) AS t(i)
    WHERE NOT EXISTS (FROM gone AS g WHERE g.doc_id = words.doc_id AND g.i = t.i)),
texts AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS kept_text FROM kept GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept_text, '')) AS kept_sha256
FROM words LEFT JOIN texts USING (doc_id)
"""

COLLOCATIONS_SQL = """
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[.,;:!?\\x0A-\\x0D]')) AS piece
    FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
found AS (
    SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, m, count(*) AS f
    FROM words, unnest(range(1, 5)) AS s(m), unnest(range(1, len(w) - m + 2)) AS t(i)
    GROUP BY ALL HAVING count(*) >= 30),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
split AS (SELECT lang, phrase, m, f AS a, string_split(phrase, ' ') AS w FROM found WHERE m > 1),
cuts AS (
    SELECT s.lang, s.phrase, s.a, k, h.f AS l, r.f AS r,
           ((2000000::HUGEINT * s.a) // (h.f::HUGEINT + r.f))::BIGINT AS score
    FROM split AS s, unnest(range(1, s.m)) AS t(k)
    JOIN found AS h ON h.lang = s.lang AND h.phrase = array_to_string(s.w[1:k], ' ')
    JOIN found AS r ON r.lang = s.lang AND r.phrase = array_to_string(s.w[k + 1:s.m], ' ')),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_phrases AS (
    SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, max(a) AS longer
    FROM split, unnest(range(2, m)) AS s(k), unnest(range(1, m - k + 2)) AS t(i) GROUP BY ALL),
kept AS (
    SELECT c.* FROM lowest AS c LEFT JOIN inner_phrases AS i USING (lang, phrase)
    WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
       phrase, a, l, r, n, score
FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000
"""

ORACLE_SQL = {"op11_collocations": COLLOCATIONS_SQL,
              "op1_spherical_caps": NEAR_VECTORS_SQL, "op6_substring_dedup": REPEATS_SQL,
              "op3_top_inner_products": TOP_SQL, "op4_stupid_backoff": BACKOFF_SQL}
