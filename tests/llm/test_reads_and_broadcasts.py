"""What grows with the input must not grow on the driver, nor in the number of reads."""

from pyspark.sql import functions as F

from tallyfold.llm import collocations, simhash
from tallyfold.llm.common import paired_blocks


def test_no_exploded_frame_is_broadcast(spark):
    keys = F.explode(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: i * 1000 + F.col("item") % 300)).alias("key")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        items = spark.range(3000).select(F.col("id").alias("item")).groupBy("item").agg(F.count("*").alias("n"))
        spread = paired_blocks(items.select("item", keys), "key", "item", simhash.BLOCK)
        assert spread.count() == 3000 * 32
        assert "BroadcastHashJoin" not in spread._jdf.queryExecution().executedPlan().toString()
        distinct = spark.range(2000).select(F.xxhash64("id").alias("fingerprint")).distinct()
        plan = simhash.links(distinct)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_collocations_read_the_texts_as_often_for_many_candidates(spark, monkeypatch):
    rows = [(f"{a} und {b} {c}. the {a} {b}",) for a in "pqrstu" for b in "vwxyz" for c in "klmno"]
    docs = spark.createDataFrame([(text, lang) for (text,) in rows for lang in ("en", None)], "text string, lang string")
    kind, reads = type(docs), []
    through = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, *a, **b: reads.append("text" in self.columns) or through(self, *a, **b))
    found = []
    for shard in (100_000, 20):
        monkeypatch.setattr(collocations, "SHARD", shard)
        reads.clear()
        rows = sorted(map(tuple, collocations.mine(docs, 3).collect()))
        found.append((sum(reads), rows))
    assert found[0] == found[1]
    assert found[0][1]


def test_collocations_of_odd_bytes(spark):
    """A word that ends within a character is one word still, in whatever shard."""
    text = b"ab\xc3 cd ef. ab\xc3 cd gh. ab\xc3 xy " * 6
    docs = spark.createDataFrame([(bytearray(text),)], "b binary").selectExpr("CAST(b AS STRING) AS text", "'en' AS lang")
    found = {bytes(r.p): r.n for r in collocations.windows(docs, collocations.frequent(docs, 2)[1]).selectExpr("phrase AS p", "n").collect()}
    assert found[b"ab\xc3 cd ef"] == 6
    tables, bitmaps = collocations.frequent(docs, 2)
    held = collocations.windows(docs, bitmaps)
    for shard in (100_000, 1):
        collocations.SHARD, before = shard, collocations.SHARD
        try:
            counts = collocations.counted(held, collocations.candidates(held, tables))
            assert {r.size: r.f for r in counts.where("size = 1 AND phrase LIKE 'ab%'").collect()} == {1: 18}
        finally:
            collocations.SHARD = before
