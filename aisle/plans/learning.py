"""Queries: machine learning."""

from __future__ import annotations

from datetime import date

from pyspark.ml import Pipeline
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, NaiveBayes, RandomForestClassifier,
)
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import HashingTF, RegexTokenizer, StopWordsRemover
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import Window, functions as F

from aisle.operators import kpi, learning as ops
from aisle.plans.kpi import _STEPS, _TYPES, _master
from aisle.plans.registry import query
from aisle.session import checkpointed, scratch_path

RUN = date(2000, 3, 31)
_LINE = ["l_quantity", "l_discount", "l_tax"]
_LINE_KEY = ["l_orderkey", "l_linenumber"]


def _labelled(t):
    """Labelled documents with counts of their text as features."""
    words = F.size(F.split("text", r"\s+")).cast("double")
    return t.documents.join(t.labels, "doc_id").select(
        "doc_id", "lang", "text", F.col("n_chars").cast("double").alias("chars"), words.alias("words"),
        F.regexp_count("text", F.lit("[.!?]")).cast("double").alias("stops"),
        F.regexp_count("text", F.lit("[0-9]")).cast("double").alias("digits"),
        F.regexp_count("text", F.lit("[A-Z]")).cast("double").alias("capitals"),
        F.col("quality").cast("double").alias("label"), F.col("toxic").cast("double").alias("toxic"))


def _held_out(t):
    """Rows to learn from, and a fifth that is only scored."""
    parts = ops.random_split(_labelled(t), "doc_id")
    return parts.where("part = 'train'"), parts.where("part = 'test'")


_FEATURES = ["chars", "words", "stops", "digits", "capitals"]


_BUCKET = "CAST(concat('0x', substr(md5(CAST({c} AS VARCHAR)), 1, 6)) AS BIGINT) % 100"


def _confusion(scored, label="label"):
    return scored.groupBy(F.col(label).cast("int").alias("label"), F.col("prediction").cast("int").alias("prediction")).agg(
        F.count("prediction").alias("rows"))


@query("mlj01_feature_pipeline", """
WITH f AS (SELECT o_orderkey, c_mktsegment AS seg, o_orderpriority AS pri, o_totalprice AS price,
                  CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS known FROM orders JOIN customer ON o_custkey = c_custkey),
g AS (SELECT *, coalesce(known, avg(known) OVER ()) AS balance FROM f),
m AS (SELECT avg(price) AS mp, stddev_samp(price) AS sp, avg(balance) AS mb, stddev_samp(balance) AS sb FROM g),
s AS (SELECT seg, row_number() OVER (ORDER BY count(*) DESC, seg) AS si, count(*) OVER () AS sn FROM f GROUP BY 1),
p AS (SELECT pri, row_number() OVER (ORDER BY count(*) DESC, pri) AS pi, count(*) OVER () AS pn FROM f GROUP BY 1),
e AS (SELECT o_orderkey, (price - mp) / sp AS x, (balance - mb) / sb AS y, si, sn, pi, pn
      FROM g JOIN s ON g.seg = s.seg JOIN p ON g.pri = p.pri CROSS JOIN m)
SELECT o_orderkey, CAST(i AS INTEGER) AS position,
       round(CASE WHEN i = 0 THEN x WHEN i = 1 THEN y WHEN i = si + 1 OR i = sn + pi + 1 THEN 1.0::DOUBLE ELSE 0 END, 6) AS value
FROM (SELECT *, unnest(range(0, sn + pn + 2)) AS i FROM e) z
""")
def feature_pipeline(t):
    frame = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", "c_mktsegment", "o_orderpriority", "o_totalprice",
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance"))
    pipeline = ops.feature_pipeline(["o_totalprice", "balance"], ["c_mktsegment", "o_orderpriority"])
    model = ops.fitted(pipeline, frame)
    rows = model.transform(frame).select("o_orderkey", F.posexplode(vector_to_array("features")).alias("position", "value"))
    return rows.withColumn("value", F.round("value", 6))


@query("mlj02_simple_regression", """
SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope,
       round(regr_intercept(l_extendedprice, l_quantity), 5) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 9) AS r2
FROM lineitem GROUP BY 1
""")
def simple_regression(t):
    out = ops.simple_regression(t.lineitem, ["l_returnflag"], "l_extendedprice", "l_quantity")
    return out.withColumns({"slope": F.round("slope", 6), "intercept": F.round("intercept", 5), "r2": F.round("r2", 9)})


def _two_feature_sql(y, a, b, names, source):
    """Two-feature least squares from variances and covariances."""
    return f"""
WITH s AS (SELECT var_pop({a}) AS aa, var_pop({b}) AS bb, covar_pop({a}, {b}) AS ab, covar_pop({a}, {y}) AS ay,
                  covar_pop({b}, {y}) AS by_, avg({a}) AS ma, avg({b}) AS mb, avg({y}) AS my FROM {source}),
c AS (SELECT (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS ca, (by_ * aa - ay * ab) / (aa * bb - ab * ab) AS cb, ma, mb, my FROM s)
SELECT '{names[0]}' AS term, round(ca, 4) AS coefficient FROM c UNION ALL SELECT '{names[1]}', round(cb, 4) FROM c
UNION ALL SELECT 'intercept', round(my - ca * ma - cb * mb, 4) FROM c"""


@query("mlj02_multiple_regression", _two_feature_sql(
    "l_extendedprice", "l_quantity", "l_tax", ["l_quantity", "l_tax"], "lineitem"))
def multiple_regression(t):
    out = ops.linear_coefficients(t.lineitem, "l_extendedprice", ["l_quantity", "l_tax"])
    return out.withColumn("coefficient", F.round("coefficient", 4))


@query("mlj03_polynomial_regression", _two_feature_sql(
    "l_extendedprice", "l_quantity", "l_quantity * l_quantity", ["x^1", "x^2"], "lineitem"))
def polynomial_regression(t):
    out = ops.polynomial_coefficients(t.lineitem, "l_extendedprice", "l_quantity")
    return out.withColumn("coefficient", F.round("coefficient", 4))


@query("mlj04_ratio_feature", """
SELECT round(regr_slope(l_extendedprice, x), 6) AS slope, round(regr_intercept(l_extendedprice, x), 5) AS intercept,
       round(regr_r2(l_extendedprice, x), 9) AS r2
FROM (SELECT l_extendedprice, l_quantity * (1 - l_discount) AS x FROM lineitem) z
""")
def ratio_feature(t):
    frame = t.lineitem.select("l_extendedprice", (F.col("l_quantity") * (1 - F.col("l_discount"))).alias("x"))
    out = ops.simple_regression(frame, [], "l_extendedprice", "x")
    return out.withColumns({"slope": F.round("slope", 6), "intercept": F.round("intercept", 5), "r2": F.round("r2", 9)})


@query("mlj05_elastic_net")
def elastic_net(t):
    parts = [
        ops.linear_coefficients(t.lineitem, "l_extendedprice", _LINE, 100.0, mixing).withColumn("mixing", F.lit(mixing))
        for mixing in (0.0, 0.5, 1.0)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("mlj06_logistic_regression")
def logistic_regression(t):
    train, test = _held_out(t)
    frame = ops.assemble(ops.balanced_weights(train, "label"), _FEATURES, "label", "weight")
    model = ops.fitted(LogisticRegression(maxIter=50, weightCol="weight"), frame)
    return _confusion(model.transform(ops.assemble(test, _FEATURES, "label")))


def _bayes_sql() -> str:
    """Three closed-form Bayes models of labelled documents: sums per class, then the better class of each row held out."""
    sums = ", ".join(f"sum({c}) AS s_{c}, sum({c} * {c}) AS q_{c}, sum(CASE WHEN {c} > 100 THEN 1 ELSE 0 END) AS b_{c}"
                     for c in _FEATURES)
    width = len(_FEATURES)
    top = ", ".join(f"sum(q_{c}) OVER () / nn - power(sum(s_{c}) OVER () / nn, 2)" for c in _FEATURES)
    multinomial = " + ".join(f"{c} * (ln(s_{c} + 1) - ln({' + '.join(f's_{x}' for x in _FEATURES)} + {width}))" for c in _FEATURES)
    bernoulli = " + ".join(
        f"ln(CASE WHEN {c} > 100 THEN (b_{c} + 1) / (n + 2) ELSE 1 - (b_{c} + 1) / (n + 2) END)" for c in _FEATURES)
    variance = {c: f"(q_{c} / n - power(s_{c} / n, 2) + eps)" for c in _FEATURES}
    gaussian = " - ".join(["", *[f"(ln(2 * pi() * {variance[c]}) + power({c} - s_{c} / n, 2) / {variance[c]}) / 2" for c in _FEATURES]])
    prior = "ln(n + 1) - ln(nn + kk)"
    return f"""
WITH d AS (SELECT documents.doc_id, quality AS label, {_BUCKET.format(c='documents.doc_id')} < 80 AS train, n_chars::DOUBLE AS chars,
                  len(string_split_regex(text, '[ \t\n\x0B\f\r]+'))::DOUBLE AS words,
                  len(regexp_extract_all(text, '[.!?]'))::DOUBLE AS stops, len(regexp_extract_all(text, '[0-9]'))::DOUBLE AS digits,
                  len(regexp_extract_all(text, '[A-Z]'))::DOUBLE AS capitals
           FROM documents JOIN labels ON documents.doc_id = labels.doc_id),
c AS (SELECT label AS class, count(*)::DOUBLE AS n, {sums} FROM d WHERE train GROUP BY 1),
a AS (SELECT *, sum(n) OVER () AS nn, count(*) OVER () AS kk FROM c),
m AS (SELECT *, 1e-9 * greatest({top}) AS eps FROM a),
v AS (SELECT doc_id, label, class, {prior} + {multinomial} AS multinomial, {prior} + {bernoulli} AS bernoulli,
             ln(n) - ln(nn){gaussian} AS gaussian FROM d CROSS JOIN m WHERE NOT train),
u AS (UNPIVOT v ON multinomial, bernoulli, gaussian INTO NAME model VALUE score)
SELECT label::INTEGER AS label, prediction::INTEGER AS prediction, count(*) AS rows, model
FROM (SELECT doc_id, model, any_value(label) AS label, arg_max(class, score) AS prediction FROM u GROUP BY 1, 2) b GROUP BY 1, 2, 4
"""


def _naive_bayes(t, kind):
    present = [(F.col(c) > 100).cast("double").alias(c) for c in _FEATURES] if kind == "bernoulli" else [F.col(c) for c in _FEATURES]
    train, test = (ops.assemble(part.select("label", *present), _FEATURES, "label") for part in _held_out(t))
    model = ops.fitted(NaiveBayes(modelType=kind), train)
    return _confusion(model.transform(test)).withColumn("model", F.lit(kind))


@query("mlj07_naive_bayes", _bayes_sql())
def naive_bayes(t):
    return _naive_bayes(t, "bernoulli").unionByName(_naive_bayes(t, "gaussian")).unionByName(_naive_bayes(t, "multinomial"))


@query("mlj07_text_filter")
def text_filter(t):
    """Word counts without stop words, multinomial model, saved and loaded again."""
    frame = ops.random_split(_labelled(t), "doc_id").select("doc_id", "text", F.col("toxic").alias("label"), "part")
    pipeline = Pipeline(stages=[
        RegexTokenizer(inputCol="text", outputCol="all_words", pattern=r"[^\p{L}\p{N}]+"),
        StopWordsRemover(inputCol="all_words", outputCol="words"),
        HashingTF(inputCol="words", outputCol="features"), NaiveBayes(modelType="multinomial")])
    model = ops.fitted(pipeline, frame.where("part = 'train'"))
    loaded = ops.save_and_reload(model, scratch_path(t.spark, "text-filter"))
    return loaded.transform(frame.where("part = 'test'")).select("doc_id", F.col("label").cast("int"), F.col("prediction").cast("int"))


@query("mlj08_trees")
def trees(t):
    frame = ops.assemble(_labelled(t), _FEATURES, "label", "chars")
    out = None
    for name, estimator in (("tree", DecisionTreeClassifier(maxDepth=4, seed=1)),
                            ("forest", RandomForestClassifier(numTrees=20, maxDepth=4, seed=1))):
        part = ops.importances(ops.fitted(estimator, frame), _FEATURES, t.spark).withColumn("model", F.lit(name))
        out = part if out is None else out.unionByName(part)
    lines = ops.assemble(t.dealt(t.lineitem, *_LINE_KEY), _LINE, "l_extendedprice")
    forest = ops.fitted(RandomForestRegressor(labelCol="l_extendedprice", numTrees=10, maxDepth=5, seed=1), lines)
    return out.unionByName(ops.importances(forest, _LINE, t.spark).withColumn("model", F.lit("forest_regression")))


@query("mlj09_boosting")
def boosting(t):
    frame = ops.assemble(_labelled(t), _FEATURES, "label")
    model = ops.fitted(GBTClassifier(maxIter=10, maxDepth=3, seed=1), frame)
    lines = ops.assemble(t.dealt(t.lineitem, *_LINE_KEY), _LINE, "l_extendedprice")
    regression = ops.fitted(GBTRegressor(labelCol="l_extendedprice", maxIter=5, maxDepth=4, seed=1), lines)
    first = ops.importances(model, _FEATURES, t.spark).withColumn("model", F.lit("classifier"))
    return first.unionByName(ops.importances(regression, _LINE, t.spark).withColumn("model", F.lit("regressor")))


@query("mlj09_held_out_scores")
def held_out_scores(t):
    """Trees and boosting on rows they have not seen: classes told right and wrong."""
    train, test = (ops.assemble(part, _FEATURES, "label") for part in _held_out(t))
    train = checkpointed(train)
    out = None
    for name, estimator in (("tree", DecisionTreeClassifier(maxDepth=4, seed=1)),
                            ("forest", RandomForestClassifier(numTrees=20, maxDepth=4, seed=1)),
                            ("boosting", GBTClassifier(maxIter=10, maxDepth=3, seed=1))):
        part = _confusion(estimator.fit(train).transform(test)).withColumn("model", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@query("mlj09_held_out_errors")
def held_out_errors(t):
    """Forest and boosted regression of a line's value on lines they have not seen."""
    parts = ops.random_split(t.dealt(t.lineitem, *_LINE_KEY).withColumn("line", F.concat_ws("|", *_LINE_KEY)), "line")
    prepared = ops.assemble(parts, _LINE, "part", "l_extendedprice")
    train, test = checkpointed(prepared.where("part = 'train'")), prepared.where("part = 'test'")
    y, out = F.col("l_extendedprice"), None
    for name, estimator in (("forest", RandomForestRegressor(labelCol="l_extendedprice", numTrees=10, maxDepth=5, seed=1)),
                            ("boosting", GBTRegressor(labelCol="l_extendedprice", maxIter=5, maxDepth=4, seed=1))):
        part = estimator.fit(train).transform(test).agg(
            F.lit(name).alias("model"), F.count(y).alias("rows"),
            F.avg(F.abs(y - F.col("prediction"))).alias("mae"),
            (1 - F.sum((y - F.col("prediction")) ** 2) / (F.var_pop(y) * F.count(y))).alias("r2"))
        out = part if out is None else out.unionByName(part)
    return out


@query("mlj10_propensity")
def propensity(t):
    """Will an outlet buy of a category in each of the next four weeks: four boosted heads, learned on four fifths of the outlets.

    Channel and category are features of every head. Rows of the outlets held out, with label, prediction and probability.
    """
    names = ["gsv_l1w", "gsv_l6m", "bills_l1w", "bills_l6m", "order_value_l6m", "recency", "lifetime", "months_with_bill"]
    keys = ["outlet", "category"]
    lines = t.dealt(
        t.sales.join(t.products.select("product", "category"), "product").select(*keys, "date", "invoice", "gsv"), *keys)
    features = kpi.rfm_features(lines, keys, "date", RUN)
    labels = kpi.next_week_labels(lines, keys, "date", RUN)
    heads = [f"buy_next_{i}w" for i in range(1, 5)]
    frame = features.join(t.outlets.select("outlet", "channel"), "outlet").join(labels, keys, "left").na.fill(0, heads).na.fill(0.0, names)
    parts = ops.random_split(frame, "outlet")
    prepared = checkpointed(ops.fitted(ops.feature_pipeline(names, ["channel", "category"]), parts.where("part = 'train'")).transform(
        parts).select(*keys, "channel", "part", "features", *heads))
    train, scored = prepared.where("part = 'train'"), prepared.where("part = 'test'")
    for i, head in enumerate(heads, 1):
        model = ops.fitted(GBTClassifier(labelCol=head, maxIter=5, maxDepth=3, seed=1), train.withColumn(head, F.col(head).cast("double")))
        scored = model.transform(scored).withColumn(f"pred_w{i}", F.col("prediction").cast("int")).withColumn(
            f"pred_proba_w{i}", F.round(vector_to_array("probability")[1], 4)).drop("prediction", "probability", "rawPrediction")
    return scored.drop("part", "features")


@query("mlj11_linear_svm")
def linear_svm(t):
    train, test = (ops.assemble(part, _FEATURES, "label") for part in _held_out(t))
    return _confusion(ops.fitted(LinearSVC(maxIter=20, regParam=0.1), train).transform(test))


_NEAR = f"""
WITH a AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label, {_BUCKET.format(c='vec_id')} < 80 AS train FROM embeddings),
d AS (SELECT q.vec_id AS query, r.vec_id AS neighbour, r.label, q.label AS truth, list_distance(q.e, r.e) AS dist
      FROM a q JOIN a r ON NOT q.train AND r.train),
n AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY dist, neighbour) AS rank FROM d)
"""


def _neighbours(t, k):
    parts = ops.random_split(t.embeddings, "vec_id")
    return ops.nearest_neighbours(
        parts.where("part = 'train'"), parts.where("part = 'test'"), "vec_id", "embedding", "label", k)


@query("mlj12_nearest_neighbours", _NEAR + """
SELECT query, neighbour, label, round(dist, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM n WHERE rank <= 5
""")
def nearest_neighbours(t):
    return _neighbours(t, 5).withColumn("distance", F.round("distance", 6))


@query("mlj12_knn_classify", _NEAR + """
SELECT query, arg_max(label, row(votes, -label)) AS prediction
FROM (SELECT query, label, count(*) AS votes FROM n WHERE rank <= 5 GROUP BY 1, 2) v GROUP BY 1
""")
def knn_classify(t):
    return ops.knn_classify(_neighbours(t, 5), "label", 5)


@query("mlj12_knn_regress", _NEAR + "SELECT query, avg(label) AS prediction FROM n WHERE rank <= 4 GROUP BY 1")
def knn_regress(t):
    return ops.knn_regress(_neighbours(t, 4), "label", 4)


@query("mlj12_knn_sweep", _NEAR + """,
v AS (SELECT k, query, truth, label, count(*) AS votes FROM n, unnest([1, 3, 5, 7]) u(k) WHERE rank <= k GROUP BY 1, 2, 3, 4),
b AS (SELECT k, query, truth, arg_max(label, row(votes, -label)) AS p FROM v GROUP BY 1, 2, 3)
SELECT CAST(k AS INTEGER) AS k, avg(CASE WHEN p = truth THEN 1.0::DOUBLE ELSE 0 END) AS accuracy FROM b GROUP BY 1
""")
def knn_sweep(t):
    return ops.knn_sweep(_neighbours(t, 7), t.embeddings, "vec_id", "label", [1, 3, 5, 7])


def _profiles(t):
    tiers = checkpointed(kpi.outlet_tiers(_master(t), "date", RUN, _STEPS, "E"))
    return kpi.site_profile(tiers, _TYPES).withColumn(
        "total_eco", F.col("total_eco").cast("double"))


@query("mlj13_site_clusters")
def site_clusters(t):
    columns = ["total_gsv", "total_eco", *[f"coverage_{i}" for i in range(1, 6)], *[f"gsv_share_{i}" for i in range(1, 6)]]
    labels, score = ops.cluster(_profiles(t), "site", columns, 2)
    return labels.withColumn("silhouette", F.lit(round(score, 4)))


@query("mlj13_spectral_clusters")
def spectral_clusters(t):
    """Sites are similar by the number of products both shipped in a month."""
    shipped = t.primary_lines.groupBy("site", "product", F.trunc("date", "month").alias("month")).agg(F.count("qty").alias("n"))
    product = shipped.groupBy("site", "product").agg(F.sum("n").alias("w"))
    left = product.join(t.products.select("product", "brand"), "product").groupBy("site", "brand").agg(F.sum("w").alias("w"))
    # Sites are positive, brands negative nodes.
    node = F.xxhash64("brand").bitwiseOR(F.lit(-(1 << 63)))
    edges = left.select(F.col("site").alias("src"), node.alias("dst"), F.col("w").cast("double").alias("weight"))
    return ops.spectral_cluster(edges, 2).join(t.supplier.select(F.col("s_suppkey").alias("id")), "id", "left_semi").select(
        F.col("id").alias("site"), "cluster")


@query("mlj14_principal_components")
def principal_components(t):
    _, shares = ops.principal_components(t.embeddings, "vec_id", "embedding", 8)
    return shares.withColumn("variance_share", F.round("variance_share", 6))


@query("mlj14_svd_compress")
def svd_compress(t):
    _, right = ops.truncated_svd(t.embeddings, "embedding", 8)
    rows = ops.compress(t.embeddings, "vec_id", "embedding", right)
    return rows.select("vec_id", F.round("error", 5).alias("error"), F.round("norm", 5).alias("norm"))


@query("mlj15_grid_search")
def grid_search(t):
    frame = ops.assemble(_labelled(t), _FEATURES, "label")
    estimator = LogisticRegression(maxIter=20)
    grid = ParamGridBuilder().addGrid(estimator.regParam, [0.0, 0.1]).addGrid(estimator.elasticNetParam, [0.0, 1.0]).build()
    return ops.grid_search(estimator, grid, BinaryClassificationEvaluator(), frame)


_DET = "({0} * ({4} * {8} - {5} * {7}) - {1} * ({3} * {8} - {5} * {6}) + {2} * ({3} * {7} - {4} * {6}))"


def _cv_sql(rows: str) -> str:
    """A model with an intercept and three columns of every origin, by Cramer's rule on centred sums."""
    x, pairs = ["x1", "x2", "x3", "y"], [(i, j) for i in range(4) for j in range(i, 4)]
    run = f"OVER (ORDER BY week_no ROWS BETWEEN {rows} PRECEDING AND 1 PRECEDING)"
    own = ", ".join([f"sum({c}) AS t{i}" for i, c in enumerate(x)] + [f"sum({x[i]} * {x[j]}) AS s{i}{j}" for i, j in pairs])
    ran = ", ".join([f"sum(n) {run} AS n", *[f"sum(t{i}) {run} AS t{i}" for i in range(4)],
                     *[f"sum(s{i}{j}) {run} AS s{i}{j}" for i, j in pairs]])
    centred = ", ".join(f"s{i}{j} - t{i} * t{j} / n AS c{i}{j}" for i, j in pairs)
    c = [[f"c{min(i, j)}{max(i, j)}" for j in range(4)] for i in range(3)]
    whole = _DET.format(*[c[i][j] for i in range(3) for j in range(3)])
    solved = ", ".join(
        _DET.format(*[c[i][3] if j == k else c[i][j] for i in range(3) for j in range(3)]) + f" / {whole} AS b{k}" for k in range(3))
    return f"""
WITH g AS (SELECT week_no, qty AS y, lag(qty, 1) OVER w AS x1, lag(qty, 2) OVER w AS x2, lag(qty, 4) OVER w AS x3
           FROM v_weekly WINDOW w AS (PARTITION BY brand, region ORDER BY week_no)),
l AS (SELECT * FROM g WHERE x3 IS NOT NULL),
d AS (SELECT week_no, count(*) AS n, {own} FROM l GROUP BY 1),
p AS (SELECT week_no, CAST(row_number() OVER (ORDER BY week_no) - 1 AS INTEGER) AS pos, count(*) OVER () AS size, {ran} FROM d),
m AS (SELECT week_no, pos, n, t0, t1, t2, t3, {solved} FROM (SELECT *, {centred} FROM p WHERE pos >= 52 AND pos <= size - 4) z),
e AS (SELECT m.week_no AS cutoff, l.y,
             (m.t3 - b0 * m.t0 - b1 * m.t1 - b2 * m.t2) / m.n + b0 * l.x1 + b1 * l.x2 + b2 * l.x3 AS prediction
      FROM m JOIN p ON p.pos BETWEEN m.pos AND m.pos + 3 JOIN l ON l.week_no = p.week_no)
SELECT cutoff, round(1 - sum((y - prediction) * (y - prediction)) / nullif(var_pop(y) * count(*), 0), 6) AS r2,
       round(avg((y - prediction) * (y - prediction)), 4) AS mse, round(avg(abs(y - prediction)), 6) AS mae
FROM e GROUP BY 1
"""


def _cv(t, train):
    spec = Window.partitionBy("brand", "region").orderBy("week_no")
    lags = {f"lag_{n}": F.lag("qty", n).over(spec) for n in (1, 2, 4)}
    lagged = t.weekly.select("week_no", "qty", *[c.alias(n) for n, c in lags.items()])
    out = ops.time_series_cv(lagged, "week_no", "qty", list(lags), 4, train, 52)
    return out.withColumns({"r2": F.round("r2", 6), "mse": F.round("mse", 4), "mae": F.round("mae", 6)})


@query("mlj15_random_search")
def random_search(t):
    """Logistic regression, a tree and a forest on the same folds."""
    frame = ops.assemble(_labelled(t), _FEATURES, "doc_id", "label")
    line, tree, forest = LogisticRegression(maxIter=20), DecisionTreeClassifier(seed=1), RandomForestClassifier(seed=1)
    return ops.random_search([
        ("logistic regression", line, {line.regParam: (1e-4, 1.0, "log"), line.elasticNetParam: (0.0, 1.0)}),
        ("tree", tree, {tree.maxDepth: (2, 6), tree.minInstancesPerNode: [1, 5, 20]}),
        ("forest", forest, {forest.numTrees: (5, 20), forest.maxDepth: (2, 6)})], 2, BinaryClassificationEvaluator(), frame, "doc_id")


@query("mlj16_time_series_cv", _cv_sql("UNBOUNDED"))
def time_series_cv(t):
    """Every origin with a year before it, trained on all weeks before."""
    return _cv(t, None)


@query("mlj16_sliding_cv", _cv_sql("52"))
def sliding_cv(t):
    """Every origin with a year before it, trained on that year."""
    return _cv(t, 52)


@query("mlj17_f_ranking", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(power(corr({c}, l_extendedprice), 2) / (1 - power(corr({c}, l_extendedprice), 2)) * (count(*) - 2), 5) AS f FROM lineitem"
    for c in _LINE))
def f_ranking(t):
    return ops.f_ranking(t.lineitem, "l_extendedprice", _LINE).withColumn("f", F.round("f", 5))


@query("mlj18_title_classifier")
def title_classifier(t):
    rows = t.documents.select("doc_id", "text", "lang")
    parts = ops.random_split(rows, "doc_id")
    out = ops.title_probabilities(
        parts.where("part = 'train'"), parts.where("part = 'test'").drop("lang", "part"), "text", "lang", "doc_id",
        ["de", "en", "es", "fr"], 0.7)
    return out.withColumns({f"{c}_proba": F.round(f"{c}_proba", 4) for c in ("de", "en", "es", "fr")})


@query("mlj19_leave_one_out", """
SELECT o_orderkey, o_custkey, coalesce((sum(cents) OVER c - cents) / nullif(count(*) OVER c - 1, 0), avg(cents) OVER ()) AS encoded
FROM (SELECT o_orderkey, o_custkey, round(o_totalprice * 100) AS cents FROM orders) o WINDOW c AS (PARTITION BY o_custkey)
""")
def leave_one_out(t):
    cents = t.orders.select("o_orderkey", "o_custkey", F.round(F.col("o_totalprice") * 100).alias("cents"))
    return ops.leave_one_out(cents, "o_custkey", "cents", "encoded").select("o_orderkey", "o_custkey", "encoded")


@query("mlj19_group_mean", """
WITH o AS (SELECT *, round(o_totalprice * 100) AS cents FROM orders),
tr AS (SELECT o_custkey, avg(cents) AS m FROM o WHERE o_orderdate < TIMESTAMP '2000-01-01' GROUP BY 1)
SELECT o_orderkey, coalesce(m, 0) AS encoded FROM o LEFT JOIN tr ON o.o_custkey = tr.o_custkey
WHERE o_orderdate >= TIMESTAMP '2000-01-01'
""")
def group_mean(t):
    cut = F.lit("2000-01-01").cast("timestamp")
    orders = t.orders.withColumn("cents", F.round(F.col("o_totalprice") * 100))
    train, test = orders.where(F.col("o_orderdate") < cut), orders.where(F.col("o_orderdate") >= cut)
    return ops.group_mean_encoding(train, test, "o_custkey", "cents", "encoded").select("o_orderkey", "encoded")


@query("mlj20_random_split", f"""
SELECT o_orderkey, CASE WHEN {_BUCKET.format(c='o_orderkey')} < 80 THEN 'train' ELSE 'test' END AS part FROM orders
""")
def random_split(t):
    return ops.random_split(t.orders.select("o_orderkey"), "o_orderkey")
