"""Rules as data against a plain search, near invoices against a double loop."""

import datetime
import random

from pyspark.sql import functions as F

from tallyfold.operators import resent, rules


def test_rules_from_a_table_equal_a_plain_search(spark):
    rng = random.Random(7)
    words = ["Rechnung", "rechnung nr", "Straße", "no", "x", "", None, "zzz none", "漢字文", "e r", "Kontoauszug", "kontoauszug"]
    table = [(i, rng.choice(["a", "b", "c"]), w) for i, w in enumerate(words * 2)]
    texts = [None, "", "x"] + [" ".join(rng.choice(["RECHNUNG", "Nr", "straße", "kontoAuszug", "漢字文", "no", "ex", "more", "er"])
                                        for _ in range(rng.randint(0, 9))) for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("keyword", F.lit(1))
    found = {r.doc_id: (r.doc_type, r.confidence, r["keywords"]) for r in rules.classify(
        docs, spark.createDataFrame(table, "rule_id int, doc_type string, keyword string")).collect()}
    order = list(dict.fromkeys(kind for _, kind, _ in table))
    for i, text in enumerate(texts):
        hits = [(kind, w) for _, kind, w in table if w and w.lower() in (text or "").lower()]
        counts = [sum(k == kind for k, _ in hits) for kind in order]
        if not hits:
            assert found[i] == ("unknown", 0.0, [])
            continue
        best = order[counts.index(max(counts))]
        assert found[i] == (best, round(max(counts) / len(hits), 4), [w for k, w in hits if k == best])
    assert rules.classify(docs, spark.createDataFrame([], "rule_id int, doc_type string, keyword string")).where("doc_type <> 'unknown'").count() == 0


def test_near_invoices_equal_a_double_loop(spark):
    rng = random.Random(8)
    start = datetime.date(1969, 12, 28)
    rows = [(i, 1, "Hot GmbH" if i % 2 else f"S {i % 9}", rng.randint(-4, 60), start + datetime.timedelta(days=rng.randint(0, 8))) for i in range(400)]
    rows += [(1000 + i, 1, "HOT  gmbh", 7, start) for i in range(300)]
    rows += [(2000, None, "x", 1, start), (2001, 1, None, 1, start), (2002, 1, "x", None, start), (2003, 1, "x", 1, None)]
    frame = spark.createDataFrame(rows, "invoice_id long, org_id long, supplier_name string, total_cents long, day date").withColumn("n", F.lit(0))
    for cents, days in ((2, 1), (0, 0), (5, 3)):
        found = {r.invoice_id: (r.class_id, r.class_size, r.near) for r in resent.near_duplicates(frame, cents, days).collect()}
        groups = {}
        for i, _, name, total, day in rows[:-4]:
            groups.setdefault((name.lower().replace(" ", ""), total, day), []).append(i)
        expected = {}
        for (name, total, day), ids in groups.items():
            near = sorted(min(other) for (n, t, d), other in groups.items() if n == name and (t, d) != (total, day)
                          and abs(t - total) <= cents and abs((d - day).days) <= days)
            expected |= {i: (min(ids), len(ids), near) for i in ids}
        assert found == expected
