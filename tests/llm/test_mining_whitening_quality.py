"""Collocations, whitening and quality scores against brute force, over real rows and odd ones."""

import collections
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyfold.llm import collocations, quality, queries, whitening

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string"


# --- collocations


def phrases_by_hand(rows, least, best, share):
    """The contract, said again with dictionaries."""
    n, f = collections.Counter(), collections.defaultdict(collections.Counter)
    for _, text, lang in rows:
        lang = lang or "und"
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for m in range(1, 5):
                for i in range(len(words) - m + 1):
                    f[lang][tuple(words[i:i + m])] += 1
    found = []
    for lang, own in f.items():
        kept = []
        often = {p: a for p, a in own.items() if a >= least and len(p) > 1}
        for p, a in often.items():
            if any(100 * b >= share * a for q, b in often.items() if len(q) > len(p)
                   and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))):
                continue
            score, _, l, r = min((2_000_000 * a // (own[p[:k]] + own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(kept)[:best], 1):
            found.append((lang, rank, p.decode(), -a, l, r, n[lang], -score))
    return sorted(found)


def odd_rows():
    rng = random.Random(3)
    rows = []
    for i in range(400):
        words = [rng.choice(["Red", "red", "green", "blau", "élan", "x-y", "{}", "a\x00b", "ſ", "İ", "漢字"]) for _ in range(rng.randint(0, 30))]
        rows.append((i, "".join(w + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\r\n"]) for w in words), rng.choice(["en", "de", None])))
    rows += [(900 + i, "New York City Hall stands. new york\tcity hall", "en") for i in range(20)]
    rows += [(950, None, "en"), (951, "", "de"), (952, " \t . ,", None), (953, "lonely", "zz"), (None, "red green red green", "en"),
             (954, "again and again " * 5000, "en"), (955, None, None), (956, "und mit und", "und")]
    return rows + rows[:40]


def test_collocations_equal_dictionaries(spark):
    rows = odd_rows()
    docs = spark.createDataFrame(rows, DOCS).select("*", F.lit(1).alias("phrase"), F.lit(2).alias("rank"), F.lit(3).alias("h")).repartition(5)
    for least, best, share in ((4, 2000, 80), (2, 7, 40)):
        found = [tuple(r) for r in collocations.mine(docs, least, best, share).collect()]
        assert sorted(found) == phrases_by_hand(rows, least, best, share)


def test_collocations_in_many_shards(spark, monkeypatch):
    monkeypatch.setattr(collocations, "SHARD", 40)
    rows = odd_rows()
    found = collocations.mine(spark.createDataFrame(rows, DOCS).repartition(3), 5).collect()
    assert sorted(map(tuple, found)) == phrases_by_hand(rows, 5, 2000, 80)


def test_collocations_of_nothing(spark):
    for rows in ([], [(1, None, None), (2, "", "en"), (3, "one", "en")]):
        found = collocations.mine(spark.createDataFrame(rows, DOCS), 2)
        assert found.count() == 0
        assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


@pytest.mark.parametrize("stretch", [1, 7, 64, 1 << 20])
def test_stretches_lose_no_phrase(monkeypatch, stretch):
    monkeypatch.setattr(collocations, "STRETCH", stretch)
    rows = odd_rows()[:200]
    batch = pa.RecordBatch.from_pydict({"text": [r[1] for r in rows], "lang": [r[2] or "und" for r in rows]}).slice(3)
    n, pairs = collections.Counter(), collections.Counter()
    for words, langs, lang_at, run in collocations.stretches(batch):
        words, langs = words.to_pylist(), langs.to_pylist()
        n.update(langs[i] for i in lang_at)
        pairs.update((langs[lang_at[i]], words[i], words[i + 1]) for i in np.flatnonzero(run > 1))
    by_hand, own = collections.Counter(), collections.Counter()
    for _, text, lang in rows[3:]:
        for piece in re.split("[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = [w.encode() for w in re.findall("[^ \t]+", piece)]
            own[lang or "und"] += len(words)
            by_hand.update((lang or "und", *p) for p in zip(words, words[1:]))
    assert +n == +own and pairs == by_hand


def test_trie_counts_what_it_holds():
    rng = random.Random(5)
    words = [f"w{i}".encode() for i in range(40)]
    phrases = sorted({(rng.choice("ab"), b" ".join(rng.choice(words) for _ in range(rng.randint(1, 4)))) for _ in range(4000)})
    trie = collocations.Trie(pa.array([x for x, _ in phrases]), pa.array([p for _, p in phrases]))
    texts = [" ".join(rng.choice(words).decode() for _ in range(3000)) for _ in range(4)]
    batch = pa.RecordBatch.from_pydict({"text": texts, "lang": ["a", "b", "a", "c"]})
    bins = sum(trie.bins(s) for s in collocations.stretches(batch))
    found = {phrases[trie.number[t]]: bins[t] for t in np.flatnonzero((trie.number >= 0) & (bins > 0))}
    real = collections.Counter()
    for text, lang in zip(texts, "abac"):
        own = text.encode().split(b" ")
        real.update((lang, b" ".join(own[i:i + m])) for m in range(1, 5) for i in range(len(own) - m + 1))
    assert found == {p: real[p] for p in phrases if real[p]}


def test_collocation_query_equals_its_sql(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = spark.createDataFrame(odd_rows(), DOCS)
    docs.select("doc_id", "text", "lang").union(odd).union(odd).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = queries.QUERIES["op11_collocations"](spark, str(tmp_path))
    expected = con.execute(f"SELECT {', '.join(found.columns)} FROM ({queries.ORACLE_SQL['op11_collocations']})").fetchall()
    assert len(expected) > 50 and sorted(map(tuple, found.collect())) == sorted(expected)


# --- whitening


def whitened_by_hand(vectors, top):
    x = np.array([[int(np.floor(1024 * np.float64(c))) + 100_000 for c in v] for v in vectors], object)
    n, s = len(x), x.sum(0)
    deviation = ((n * x - s) ** 2).sum(1)
    centred = (n * x - s).astype(np.float64) / n
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:top]
    return n, deviation, centred @ basis[:, order] / np.sqrt(values[order]), values[order] / values.sum()


def test_whitening_of_two_lengths_and_odd_rows(spark):
    rng = np.random.default_rng(8)
    long = (rng.normal(size=(300, 12)) * np.linspace(0.1, 2, 12)).astype(np.float32).tolist()
    short = rng.normal(size=(40, 3)).astype(np.float32).tolist()
    rows = [(i, v) for i, v in enumerate(long)] + [(1000 + i, v) for i, v in enumerate(short)]
    odd = [(2000, None), (2001, [float("nan")] * 12), (2002, [float("inf")] + [0.0] * 11), (2003, [None] + [1.0] * 11), (2004, []),
           (3000, [1.0, 2.0]), (3001, [1.0, 2.0])]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    frame = frame.select("*", F.lit(1).alias("n"), F.lit(2).alias("u"), F.lit(3).alias("component")).repartition(5)
    found = whitening.whiten(frame, 8).toPandas().sort_values(["vec_id", "component"])
    assert set(found.vec_id) == {r[0] for r in rows}
    for first, vectors in ((0, long), (1000, short)):
        own = found[(found.vec_id >= first) & (found.vec_id < first + len(vectors))]
        k = min(8, len(vectors[0]))
        n, deviation, w, explained = whitened_by_hand(vectors, 8)
        assert (own.n == n).all() and own.component.tolist() == list(range(1, k + 1)) * n
        assert [int(x) for x in own.deviation[::k]] == deviation.tolist()
        got = own.whitened.to_numpy().reshape(n, k)
        assert np.allclose(np.abs(got), np.abs(w), atol=1e-9)
        assert np.allclose(got.T @ got / n, np.eye(k), atol=1e-9)
        assert np.allclose(own.explained.to_numpy().reshape(n, k)[0], explained, rtol=1e-9)
        assert (own.identity_error < 1e-9).all()


def test_whitening_query(spark, tmp_path):
    frame = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    twice = frame.union(frame.where("vec_id < 9"))
    twice.write.parquet(f"{tmp_path}/embeddings.parquet")
    found = queries.QUERIES["op12_whitening"](spark, str(tmp_path)).toPandas()
    vectors = [r.embedding for r in twice.collect()]
    n, deviation, _, explained = whitened_by_hand(vectors, 8)
    assert len(found) == 8 * n and (found.n == n).all()
    assert sorted(found.deviation[found.component == 1]) == sorted(deviation.tolist())
    assert np.allclose(sorted(found.explained.unique()), sorted(explained), rtol=1e-6)


def test_whitening_of_nothing_and_of_equal_vectors(spark):
    schema = "vec_id long, embedding array<double>"
    for rows in ([], [(1, None)], [(1, [])], [(1, [1.0, 2.0])], [(i, [0.5, 0.25]) for i in range(5)]):
        assert whitening.whiten(spark.createDataFrame(rows, schema)).count() == 0
    flat = [(i, [float(i), 7.0]) for i in range(6)]
    assert {r.component for r in whitening.whiten(spark.createDataFrame(flat, schema)).collect()} == {1}


@pytest.mark.parametrize("low,high,rows", [(-700, 700, 1000), (-2**42, 2**42, 77), (5, 6, 64), (0, 2, 1)])
def test_bit_planes_give_exact_products(low, high, rows):
    u = np.random.default_rng(1).integers(low, high, (rows, 7))
    u[:, 3] = u[0, 3]
    assert (whitening.products(u) == u.astype(object).T @ u.astype(object)).all()


def test_deviations_past_64_bits():
    spread = np.array([[2**40, 3], [-5, 2**41]])
    assert whitening.deviations(spread).tolist() == [2**80 + 9, 25 + 2**82]


# --- quality


def test_isotonic_is_the_best_rising_curve():
    rng = np.random.default_rng(2)
    for _ in range(20):
        m = int(rng.integers(1, 30))
        n = rng.integers(1, 20, m).astype(float)
        y = np.array([rng.integers(0, int(k) + 1) for k in n], float)
        at, height = quality.isotonic(np.arange(m), n, y)
        assert (np.diff(height) > 0).all() and (np.diff(at) > 0).all()
        # Minimax formula of isotonic regression.
        best = [max(min(y[i:j + 1].sum() / n[i:j + 1].sum() for j in range(k, m)) for i in range(k + 1)) for k in range(m)]
        assert np.allclose(sorted(set(np.round(best, 12))), np.round(height, 12))


def test_statistics_of_odd_texts():
    zero = [0.0] * len(quality.STATISTICS)
    assert quality.statistics(None) == quality.statistics("") == quality.statistics(" \n\t") == zero
    for text in ("a", "1", "!!", "\x00", "\x1c x", "ß" * 10, "x " * 50_000, "漢字 \ud800".encode("utf-16", "surrogatepass").decode("utf-16", "replace")):
        assert np.isfinite(quality.statistics(text)).all()
    names = dict(zip(quality.STATISTICS, quality.statistics("The The The cat! ## 12\nThe end")))
    assert names["commonest_word"] == 0.5 and names["repeated_word"] == 0.25 and names["words_without_letters"] == 0.25


def test_ridge_equals_one_process(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(500, len(quality.STATISTICS)))
    y = (x[:, 0] + x[:, 1] ** 2 + 0.3 * rng.normal(size=500) > 1).astype(float)
    frame = spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(x, y)] * 2 + [(x[0].tolist(), None)], "x array<double>, y double")
    model = quality.learn(frame)
    assert np.allclose(model.mean, x.mean(0)) and np.allclose(model.spread, x.std(0))
    folds = frame.where("y IS NOT NULL").select("x", (F.pmod(F.xxhash64("x", F.lit("fold")), F.lit(quality.FOLDS)) == 0).alias("c")).distinct().collect()
    held = {tuple(r.x) for r in folds if r.c}
    fit = [i for i in range(500) if tuple(x[i].tolist()) not in held]
    z = model.features(x[fit])
    penalty = quality.RIDGE * 2 * len(fit) * np.eye(z.shape[1]) / quality.FEATURES
    penalty[0, 0] = 0
    weights = np.linalg.solve(2 * z.T @ z + penalty + 1e-12 * np.eye(len(penalty)), 2 * z.T @ y[fit])
    assert np.allclose(model.ridge(x), z_all(model, x) @ weights, atol=1e-6)
    assert ((model.score(x) > 0.5) == y).mean() > 0.85


def z_all(model, x):
    return model.features(x)


def test_quality_query_on_held_out_rows(spark):
    found = queries.QUERIES["op13_quality_classifier"](spark, "/root/testdata/sf0.01").toPandas()
    assert found.score.between(0, 1).all() and ((found.score >= 0.7) == found.predicted).all()
    assert (found.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in found.doc_id]).all()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    own = found[found.held_out].merge(labels, on="doc_id")
    assert len(own) > 50 and (own.predicted == own.quality).mean() > 0.97


def test_quality_reads_neither_ids_nor_held_out_labels(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(60)
    odd = spark.createDataFrame([(None, "text without id"), (None, None), (10**9, None), (10**9 + 1, ""), (5, "five again")], "doc_id long, text string")
    docs = docs.select("doc_id", "text").union(odd).select("*", *[F.lit("z").alias(c) for c in ("x", "y", "score", "lang", "quality", "w")])
    labels = docs.selectExpr("doc_id", "CAST(abs(hash(text)) % 2 AS INT) AS quality", "1 AS toxic")
    labels = labels.union(spark.createDataFrame([(5, 0, 0), (5, 1, 0), (7, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int"))
    flipped = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    scores = []
    for name, own in (("a", labels), ("b", flipped), ("none", labels.where("false"))):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        own.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        found = queries.QUERIES["op13_quality_classifier"](spark, f"{tmp_path}/{name}")
        scores.append(sorted((r.doc_id or -1, round(r.score, 9)) for r in found.collect()))
    assert scores[0] == scores[1] and len(scores[0]) == 65
    assert {s for _, s in scores[2]} == {0.5}
    docs.where("false").write.parquet(f"{tmp_path}/empty/documents.parquet")
    labels.write.parquet(f"{tmp_path}/empty/labels.parquet")
    assert queries.QUERIES["op13_quality_classifier"](spark, f"{tmp_path}/empty").count() == 0
