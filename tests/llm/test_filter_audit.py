import re
from collections import Counter
from itertools import permutations

from pyspark.sql import functions as F

from aisle.llm import filter_audit

NAMES = "ABCDE"


def fails(text, doc_id, smallest):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    order = (doc_id is not None, doc_id or 0)
    return {name for name, failing in zip(NAMES, (
        len(words) < 200, 100 * len(set(words)) < 50 * len(words),
        100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text), any(c in "#$%&*|" for c in text),
        order > smallest[text]), strict=True) if failing}


def brute(rows, labels, orders):
    smallest = {}
    for doc_id, text, _ in rows:
        order = (doc_id is not None, doc_id or 0)
        smallest[text or ""] = min(smallest.get(text or "", order), order)
    facts = [(part or "", fails(text or "", doc_id, smallest),
              any(i == doc_id and q == 1 for i, q, _ in labels), any(i == doc_id and t == 1 for i, _, t in labels))
             for doc_id, text, part in rows]
    out, shapley = {}, Counter()
    for part in {f[0] for f in facts}:
        own = [f for f in facts if f[0] == part]
        for order in orders:
            for step, name in enumerate(order, 1):
                left = [f for f in own if not f[1] & set(order[: step - 1])]
                removed = [f for f in left if name in f[1]]
                out[part, order, step] = [
                    len(left) - len(removed), len(removed), sum(name in f[1] for f in own) - len(removed),
                    sum(f[1] == {name} for f in own), sum(f[2] for f in removed), sum(f[3] for f in removed)]
                shapley[part, name] += len(removed)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def found(df):
    rows = df.collect()
    assert df.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost",
                          "toxic_lost", "shapley"]
    out = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in rows}
    assert len(out) == len(rows)
    return out


def rows_of_all_kinds(spark):
    plain = " ".join(f"w{i}" for i in range(250))
    texts = [plain, plain, "AB " * 300, "short & BAD", "", None, " \t\n", plain + " #", "é" * 70_000, plain.upper(), "x\x1cy z"]
    rows = [(i, t, ("en", "de", None, "")[i % 4]) for i, t in enumerate(texts)]
    rows += [(None, plain, "en"), (None, plain, None), (3, "short & BAD", "de"), (3, plain, "de"), (20, "AB " * 300, "fr")]
    labels = [(0, 1, 0), (1, 1, 1), (2, 0, 1), (3, None, 1), (3, 1, None), (7, 1, 0), (None, 1, 1), (99, 1, 1)]
    docs = spark.createDataFrame([(*r, 1, "z", 0) for r in rows],
                                 "doc_id long, text string, lang string, row int, fails string, part int")
    return rows, labels, docs.repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_all_orders_equal_brute_force(spark):
    rows, labels, docs, table = rows_of_all_kinds(spark)
    orders = ["".join(p) for p in permutations(NAMES)]
    out = found(filter_audit.audit(docs, table, filter_audit.text_filters(), orders, copies="E"))
    assert out == brute(rows, labels, orders)


def test_some_orders_of_any_length(spark):
    rows, labels, docs, table = rows_of_all_kinds(spark)
    orders = ["EDCBA", "B", "CA", "ACE"]
    out = found(filter_audit.audit(docs, table, filter_audit.text_filters(), orders, copies="E"))
    assert out == brute(rows, labels, orders)


def test_own_filters_and_nulls_of_conditions(spark, documents, folder):
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    text = F.col("_text")
    out = found(filter_audit.audit(documents, labels, {"X": F.length(text) > 900, "N": F.lit(None).cast("boolean")},
                                   ["XN", "NX"], part="source"))
    for (_, order, step), r in out.items():
        assert r[1] == 0 if order[step - 1] == "N" else r[1] == r[3]
    longer = documents.where("length(text) > 900").count()
    assert sum(r[1] for (_, o, s), r in out.items() if (o, s) == ("NX", 2)) == longer


def test_empty_tables(spark, nothing):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = nothing.withColumn("lang", F.lit("en"))
    assert filter_audit.audit(docs, labels, filter_audit.text_filters(), ["AE"], copies="E").count() == 0
    one = spark.createDataFrame([(1, "word", "en")], "doc_id long, text string, lang string")
    assert found(filter_audit.audit(one, labels, filter_audit.text_filters(), ["AE"], copies="E")) == {
        ("en", "AE", 1): (0, 1, 0, 1, 0, 0, 1), ("en", "AE", 2): (0, 0, 0, 0, 0, 0, 0)}


def test_texts_that_many_rows_share(spark):
    docs = spark.range(3_000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'copy', concat('own ', id)) AS text", "'x' AS lang")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.sha2("text", 256).alias("digest"))
    assert filter_audit.repeats_smaller(rows).count() == 999
