"""Queries: titles, brands and promotion texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from aisle.functions import titles
from aisle.functions.exprs import recode
from aisle.operators import text as ops
from aisle.plans.registry import query

#: Keyword to brand, brand to category, category to division.
BRANDS = {"ring": "RING", "spring ring": "SPRING RING", "bolt": "BOLT", "gear": "GEAR", "the": "THE", "then": "THEN",
          "hot": "HOT", "old": "OLD", "red": "RED"}
CATEGORIES = {"RING": "Jewel", "SPRING RING": "Jewel", "BOLT": "Metal", "GEAR": "Metal", "HOT": "Heat"}
DIVISIONS = {"Jewel": "Personal", "Metal": "Home"}
EXCLUDED = ["red thing", "and the", "on then", "hot", "tion"]
STOP_WORDS = ["the", "and", "of", "in", "is", "to", "a", "on", "it", "le", "la", "un", "une", "der", "die", "das", "el"]


def _ordered(pairs):
    return sorted(pairs, key=lambda k: (-len(k), k))


def _case(text, pairs):
    return "CASE " + " ".join(f"WHEN contains({text}, '{k}') THEN '{pairs[k]}'" for k in _ordered(pairs)) + " END"


@query("str01_standardize", """
SELECT doc_id, md5(lower(nfc_normalize(lower(text)))) AS title_hash FROM documents
""")
def standardize(t):
    return t.texts.select("doc_id", F.md5(titles.standardize("text")).alias("title_hash"))


@query("str02_clean_title", r"""
SELECT doc_id, md5(array_to_string(list_filter(regexp_split_to_array(
       regexp_replace(regexp_replace(text, '\[.*?\]', '', 'g'), '[^\p{L}\p{N}_\s]', '', 'g'), '\s+'),
       lambda x: regexp_matches(x, '\p{L}')), ' ')) AS title_hash
FROM documents
""")
def clean_title(t):
    return t.texts.select("doc_id", F.md5(titles.clean_title("text")).alias("title_hash"))


@query("str03_keep_combo", r"""
SELECT p_partkey, CASE WHEN contains(regexp_extract(title, '\[([A-Za-z0-9_]+)\]', 1), 'combo')
            AND NOT contains(regexp_replace(title, '\[.*?\]', '', 'g'), 'combo')
       THEN concat('combo ', regexp_replace(title, '\[.*?\]', '', 'g'))
       ELSE regexp_replace(title, '\[.*?\]', '', 'g') END AS title
FROM (SELECT p_partkey, concat('[', CASE WHEN p_size > 25 THEN 'combo' ELSE 'single' END, '_', p_size, '] ', p_name,
             CASE WHEN p_type = 'PROMO' THEN ' combo' ELSE '' END) AS title FROM part) x
""")
def keep_combo(t):
    title = F.concat(
        F.lit("["), F.when(F.col("p_size") > 25, "combo").otherwise("single"), F.lit("_"),
        F.col("p_size").cast("string"), F.lit("] "), "p_name",
        F.when(F.col("p_type") == "PROMO", " combo").otherwise(""))
    return t.part.select("p_partkey", titles.keep_combo(title).alias("title"))


@query("str04_keyword_brand", f"""
SELECT doc_id, {_case('lower(text)', BRANDS)} AS brand FROM documents
""")
def keyword_brand(t):
    return t.texts.select("doc_id", titles.first_keyword(F.lower("text"), BRANDS).alias("brand"))


@query("str05_keyword_category", f"""
SELECT product, brand, category, CASE category WHEN 'Jewel' THEN 'Personal' WHEN 'Metal' THEN 'Home'
       ELSE category END AS division
FROM (SELECT product, brand, CASE brand WHEN 'RING' THEN 'Jewel' WHEN 'SPRING RING' THEN 'Jewel' WHEN 'BOLT' THEN 'Metal'
             WHEN 'GEAR' THEN 'Metal' WHEN 'HOT' THEN 'Heat' ELSE category END AS category
      FROM (SELECT product, category, {_case('dp_name', BRANDS)} AS brand FROM v_products) x) y
""")
def keyword_category(t):
    found = t.products.select("product", F.col("category").alias("own"), titles.first_keyword("dp_name", BRANDS).alias("brand"))
    named = found.withColumn("category", recode("brand", CATEGORIES, F.col("own")))
    return named.select("product", "brand", "category", recode("category", DIVISIONS).alias("division"))


_DICTIONARY = """
SELECT DISTINCT p_name AS brand, split_part(p_name, ' ', 2) AS family FROM part
UNION SELECT DISTINCT split_part(p_name, ' ', 2), split_part(p_name, ' ', 2) FROM part
UNION SELECT DISTINCT split_part(p_name, ' ', 1), split_part(p_name, ' ', 1) FROM part
"""
_RATIO = """CAST(round(100.0::DOUBLE * (length(a) + length(b) - CASE
  WHEN lev = 0 THEN 0 WHEN lev = 1 AND abs(length(a) - length(b)) = 1 THEN 1 WHEN lev = 1 THEN 2
  WHEN lev = 2 AND abs(length(a) - length(b)) = 2 THEN 2 WHEN lev = 2 AND abs(length(a) - length(b)) = 1 THEN 3
  WHEN lev = 2 AND list_has_any(
       list_transform(range(1, length(a) + 1), lambda i: concat(a[1:i - 1], a[i + 1:])),
       list_transform(range(1, length(b) + 1), lambda j: concat(b[1:j - 1], b[j + 1:]))) THEN 2
  ELSE 4 END) / (length(a) + length(b))) AS INTEGER)"""
_FOUND = f"""
dict AS ({_DICTIONARY}),
words AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: length(x) > 0) AS w
          FROM documents),
grams AS (SELECT DISTINCT doc_id, unnest(w) AS ngram FROM words
          UNION SELECT DISTINCT doc_id, concat(w[i], ' ', w[i + 1]) FROM words, unnest(range(1, len(w))) u(i)),
pairs AS (SELECT a, b, levenshtein(a, b) AS lev FROM (SELECT DISTINCT ngram AS a FROM grams) x,
          (SELECT DISTINCT brand AS b FROM dict) y WHERE abs(length(a) - length(b)) <= 2 AND levenshtein(a, b) <= 2),
near AS (SELECT a, b, {_RATIO} AS ratio FROM pairs),
scored AS (SELECT doc_id, b AS brand, max(ratio) AS ratio FROM grams JOIN near ON ngram = a WHERE ratio > 85 GROUP BY 1, 2),
found AS (SELECT doc_id, brand, ratio FROM (SELECT *, max(ratio) OVER (PARTITION BY doc_id) AS best FROM scored) z
          WHERE ratio = best)
"""


def _dictionary(t):
    names = t.part.select("p_name").distinct().select("p_name", F.split("p_name", " ").alias("w"))
    family = names.select(F.col("p_name").alias("brand"), F.col("w")[1].alias("family"))
    nouns = names.select(F.col("w")[1].alias("brand"), F.col("w")[1].alias("family"))
    colors = names.select(F.col("w")[0].alias("brand"), F.col("w")[0].alias("family"))
    return family.union(nouns).union(colors).distinct()


@query("str06_fuzzy_brand", f"WITH {_FOUND} SELECT doc_id, brand, ratio FROM found")
def fuzzy_brand(t):
    return ops.fuzzy_brands(t.texts, "doc_id", "text", _dictionary(t), "brand")


@query("str07_brand_family", f"""
WITH {_FOUND},
named AS (SELECT DISTINCT doc_id, family FROM found JOIN dict USING (brand)),
counted AS (SELECT doc_id, count(*) AS n FROM named GROUP BY 1),
parts AS (SELECT doc_id, family, unnest(string_split(family, ' ')) AS word FROM named JOIN counted USING (doc_id) WHERE n > 1),
wp AS (SELECT a, b, levenshtein(a, b) AS lev FROM (SELECT DISTINCT ngram AS a FROM grams) x,
       (SELECT DISTINCT word AS b FROM parts) y WHERE abs(length(a) - length(b)) <= 2 AND levenshtein(a, b) <= 2),
wr AS (SELECT a, b, {_RATIO} AS ratio FROM wp),
per AS (SELECT doc_id, b AS word, max(ratio) AS ratio FROM grams JOIN wr ON ngram = a GROUP BY 1, 2),
score AS (SELECT doc_id, family, CASE WHEN (doc_id, family) IN (SELECT (doc_id, ngram) FROM grams) THEN 100
                 ELSE sum(coalesce(ratio, 0)) / count(*) END AS score
          FROM parts LEFT JOIN per USING (doc_id, word) GROUP BY doc_id, family),
top AS (SELECT doc_id, family FROM (SELECT *, max(score) OVER (PARTITION BY doc_id) AS best FROM score WHERE score > 90) z
        WHERE score = best
        UNION ALL SELECT doc_id, family FROM named JOIN counted USING (doc_id) WHERE n = 1)
SELECT doc_id, coalesce(string_agg(family, '|' ORDER BY family), 'not-detected') AS brand_final
FROM (SELECT DISTINCT doc_id FROM documents) LEFT JOIN top USING (doc_id) GROUP BY 1
""")
def brand_family(t):
    dictionary = _dictionary(t)
    found = ops.fuzzy_brands(t.texts, "doc_id", "text", dictionary, "brand")
    return ops.main_brand(t.texts, "doc_id", "text", found, "brand", dictionary, "family")


#: The common subsequence of a and b by bits: a bit of the state stands for a character of b and is cleared when it is used.
_COMMON = """length(b) - bit_count(list_reduce(
  list_prepend((1::HUGEINT << length(b)) - 1, list_transform(string_split(a, ''), lambda c: list_sum(list_transform(
    range(length(b)), lambda j: CASE WHEN b[j + 1] = c THEN 1::HUGEINT << j::INTEGER ELSE 0::HUGEINT END))::HUGEINT)),
  lambda s, m: ((s + (s & m)) | (s - (s & m))) & ((1::HUGEINT << length(b)) - 1)))"""


@query("str08_best_entry", f"""
WITH dict AS ({_DICTIONARY}),
p AS (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: length(x) > 0)) AS a
      FROM benchmark),
pairs AS (SELECT a, b FROM p, (SELECT DISTINCT brand AS b FROM dict) d
          WHERE 200 * least(length(a), length(b)) >= 69.5 * (length(a) + length(b))),
scored AS (SELECT a, b, CAST(round(200.0::DOUBLE * ({_COMMON}) / (length(a) + length(b))) AS INTEGER) AS score FROM pairs),
best AS (SELECT a, b, score FROM scored WHERE score >= 70 QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) = 1)
SELECT a AS pred, coalesce(b, 'not-detected') AS brand_mapped, coalesce(score, 0) AS score FROM p LEFT JOIN best USING (a)
""")
def best_entry(t):
    predictions = t.benchmark.select(F.explode(titles.tokens_of("text")).alias("pred"))
    return ops.best_entries(predictions, "pred", _dictionary(t), "brand")


def _full_sql(text):
    return "CASE " + " ".join(f"WHEN contains({text}, '{k}') THEN '{k}'" for k in EXCLUDED) + " ELSE 'NO' END"


def _partial_sql(text):
    return "CASE " + " ".join(
        "WHEN " + " AND ".join(f"contains({text}, '{p}')" for p in k.split(" ")) + f" THEN '{k}'" for k in EXCLUDED
    ) + " ELSE 'NO' END"


@query("str09_exclusions", f"""
SELECT doc_id, {_full_sql('lower(text)')} AS full_exclude, {_partial_sql('lower(text)')} AS partial_exclude FROM documents
""")
def exclusions(t):
    lowered = F.lower("text")
    return t.texts.select(
        "doc_id", titles.full_exclusion(lowered, EXCLUDED).alias("full_exclude"),
        titles.partial_exclusion(lowered, EXCLUDED).alias("partial_exclude"))


_FORMATS = ["ring", "bolt", "gear", "rod", "plate"]


@query("str10_pack_type", f"""
SELECT doc_id, CASE WHEN NOT regexp_matches(lower(text), '{"|".join(titles.COMBO_WORDS)}') THEN 'single'
            WHEN {" + ".join(f"CAST(contains(lower(text), '{f}') AS INTEGER)" for f in _FORMATS)} >= 2 THEN 'combo'
            ELSE 'multi' END AS pack_type
FROM documents
""")
def pack_type(t):
    lowered = F.lower("text")
    formats = sum((lowered.contains(f).cast("int") for f in _FORMATS), F.lit(0))
    return t.texts.select("doc_id", titles.pack_type("text", formats).alias("pack_type"))


_PROMO_TEXT = """
SELECT x.scheme, concat(CASE WHEN mechanic = '1-URGENT' THEN 'discount - ' ELSE '' END,
       CASE status WHEN 'F' THEN 'hot price' WHEN 'O' THEN 'normal' ELSE 'mnudl' END,
       CASE WHEN discount >= 0.09 THEN ' key event' WHEN discount >= 0.07 THEN ' u-gift'
            WHEN discount >= 0.05 THEN ' gift' ELSE '' END) AS grouping,
       CASE WHEN p.category = 'PROMO' THEN 'hc selling' WHEN p.category = 'SMALL' THEN 'pc sampling'
            ELSE lower(p.category) END AS gift
FROM v_promotions x JOIN v_products p ON x.product = p.product
"""


def _promo_text(t):
    depth = F.col("discount")
    grouping = F.concat(
        F.when(F.col("mechanic") == "1-URGENT", "discount - ").otherwise(""),
        F.when(F.col("status") == "F", "hot price").when(F.col("status") == "O", "normal").otherwise("mnudl"),
        F.when(depth >= 0.09, " key event").when(depth >= 0.07, " u-gift").when(depth >= 0.05, " gift").otherwise(""))
    gift = F.when(F.col("category") == "PROMO", "hc selling").when(F.col("category") == "SMALL", "pc sampling").otherwise(
        F.lower("category"))
    return t.promotions.join(t.products.select("product", "category"), "product").select(
        "scheme", grouping.alias("grouping"), gift.alias("gift_type"))


@query("str11_promotion_classes", f"""
SELECT scheme, CASE WHEN contains(grouping, 'hot price') THEN 'hot price' WHEN contains(grouping, 'mnudl') THEN 'mnudl'
            WHEN contains(grouping, 'pwp') THEN 'pwp' ELSE 'unknown' END AS special_event,
       contains(replace(grouping, ' ', ''), 'keyevent') AS key_event,
       CASE WHEN contains(replace(grouping, 'u-gift', ''), 'gift') THEN gift ELSE 'no-gift' END AS gift,
       CASE WHEN contains(grouping, 'u-gift') THEN gift ELSE 'no-gift' END AS ugift,
       CASE WHEN regexp_matches(grouping, '{titles.DISCOUNT_PATTERN}') THEN grouping ELSE 'no-discount' END
       AS discount
FROM ({_PROMO_TEXT}) x
""")
def promotion_classes(t):
    return _promo_text(t).select("scheme", *titles.promotion_classes("grouping", "gift_type"))


@query("str12_investment_type", f"""
SELECT scheme, concat_ws(' ', CASE WHEN (contains(grouping, 'gift') AND NOT contains(grouping, 'u-gift'))
         OR (contains(grouping, 'u-gift') AND gift = 'pc sampling') THEN 'bmi' END,
       CASE WHEN contains(grouping, 'discount') OR (contains(grouping, 'u-gift') AND gift = 'hc selling') THEN 'tts' END)
       AS type
FROM ({_PROMO_TEXT}) x
""")
def investment_type(t):
    joined = F.concat_ws("_", "grouping", "gift_type")
    return _promo_text(t).select("scheme", titles.investment_type(joined).alias("type"))


@query("str13_token_counts", """
SELECT source, lang, CAST(sum(len(regexp_extract_all(text, 'ing'))) AS BIGINT) AS token_1,
       CAST(sum(len(regexp_extract_all(text, 'tion'))) AS BIGINT) AS token_2
FROM documents GROUP BY 1, 2
""")
def token_counts(t):
    return ops.token_counts(t.texts, ["source", "lang"], "text", ["ing", "tion"], "token_")


@query("str14_url_key", """
SELECT split_part(url, '?', 1) AS url_key, count(*) AS pages FROM pages GROUP BY 1
""")
def url_key(t):
    return t.pages.groupBy(titles.url_key("url").alias("url_key")).agg(F.count("url").alias("pages"))


@query("str15_build_id", """
SELECT o_orderkey, concat(split_part(o_orderpriority, '-', 1), '_', lpad(CAST(o_custkey AS VARCHAR), 8, '0'), '_',
       coalesce(nullif(o_orderstatus, 'P'), 'X')) AS item_id
FROM orders
""")
def build_id(t):
    return t.orders.select("o_orderkey", F.concat(
        F.substring_index("o_orderpriority", "-", 1), F.lit("_"), F.lpad(F.col("o_custkey").cast("string"), 8, "0"),
        F.lit("_"), F.ifnull(F.nullif("o_orderstatus", F.lit("P")), F.lit("X"))).alias("item_id"))


@query("str16_store_code", """
SELECT province, district, count(*) AS stores
FROM (SELECT substr(c_name, 5, 3) AS province, substr(c_name, 9, 3) AS district FROM customer) x GROUP BY 1, 2
""")
def store_code(t):
    return t.customer.select(*titles.store_parts("c_name")).groupBy("province", "district").agg(
        F.count("province").alias("stores"))


@query("str17_bag_of_words", f"""
SELECT doc_id, word, count(*) AS n FROM (
  SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: length(x) > 0)) AS word
  FROM documents) x
WHERE word NOT IN ({", ".join(f"'{w}'" for w in STOP_WORDS)}) GROUP BY 1, 2
""")
def bag_of_words(t):
    return ops.bag_of_words(t.texts, "doc_id", "text", STOP_WORDS)
