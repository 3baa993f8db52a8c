"""Queries p1, p5, p7, p8, p9 and p10, with the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartloom.functions.keys import clean_id
from cartloom.llm import langid, mixing, overlap, packing
from cartloom.llm.components import with_component
from cartloom.llm.pairs import together
from cartloom.llm.splits import SHARES, SPLITS, split_groups
from cartloom.session import cut, spread
from cartloom.sources.tables import table

TRAIN, HELD = "train", ("validation", "protected_test")
RATINGS = [1, 2, 3, 4, 5]


def author(col: str = "user_id"):
    """A user id as a key: the placeholder `unknown` is nobody."""
    key = clean_id(col)
    return F.when(key != "unknown", key)


def assignments(spark: SparkSession, d: str) -> DataFrame:
    """One row per document and split of the earlier run: row_index, sku, group_key, split, customer_rating."""
    rows = table(spark, d, "split_assignments")
    return rows.select("row_index", clean_id("sku").alias("sku"), F.when(F.trim("group_key") != "", F.col("group_key")).alias("group_key"), clean_id("split").alias("split"), "customer_rating").distinct()


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows of tied sets with more than one split: the search starts from the earlier run's splits, and reports the sets that can't keep theirs."""
    users = table(spark, d, "documents").select(F.col("doc_id").alias("row_index"), author().alias("user_id"))
    rows = assignments(spark, d).where("split is not null").join(users, "row_index", "left")
    rows = with_component(rows, "row_index", ["user_id", "sku", "group_key"])
    rows = cut(rows.select("row_index", "component", "customer_rating", F.when(F.col("split") == "protected_test", "test").otherwise(F.col("split")).alias("split")))
    placed = split_groups(rows, "customer_rating", RATINGS, before="split")
    tied = rows.join(placed.where("mixed"), "component").select(F.lit("split_assignments").alias("record_table"), F.col("row_index").alias("record_id")).distinct()
    people = table(spark, d, "user_partitions").where("user_id is not null").select(F.col("user_id").alias("component"), clean_id("partition").alias("split"))
    placed = split_groups(people, None, [], before="split")
    return tied.unionByName(placed.where("mixed").select(F.lit("user_partitions").alias("record_table"), F.col("component").alias("record_id")))


def prepared_records(spark: SparkSession, d: str) -> DataFrame:
    """record_table, record_id, component, customer_rating: every document and every basket user."""
    docs = table(spark, d, "documents").select("doc_id", author().alias("user_id"), clean_id("sku").alias("sku"))
    keys = assignments(spark, d).groupBy(F.col("row_index").alias("doc_id")).agg(F.max("group_key").alias("group_key"), F.max("customer_rating").alias("customer_rating"))
    docs = with_component(docs.join(keys, "doc_id", "left"), "doc_id", ["user_id", "sku", "group_key"])
    users = table(spark, d, "user_partitions").select("user_id").unionByName(table(spark, d, "basket_orders").select(F.col("user_id").cast("bigint"))).where("user_id is not null").distinct()
    return cut(
        docs.select(F.lit("documents").alias("record_table"), F.col("doc_id").alias("record_id"), "component", "customer_rating")
        .unionByName(users.select(F.lit("user_partitions").alias("record_table"), F.col("user_id").alias("record_id"), F.col("user_id").alias("component"), F.lit(None).cast("int").alias("customer_rating")))
    )


def p1_assign(spark: SparkSession, d: str) -> DataFrame:
    """record_table, record_id, group_key (of the tied set), split: 70/15/15, each table by itself."""
    records = prepared_records(spark, d)
    out = None
    for name, label in (("documents", "customer_rating"), ("user_partitions", None)):
        own = records.where(F.col("record_table") == name)
        placed = split_groups(own, label, RATINGS if label else [])
        rows = own.join(placed, "component").select("record_table", "record_id", F.col("component").alias("group_key"), "split")
        out = rows if out is None else out.unionByName(rows)
    return out


def p1_balance(spark: SparkSession, d: str) -> DataFrame:
    """record_table, split, n_records, n_groups, share and target_share of the new splits."""
    per = p1_assign(spark, d).groupBy("record_table", "split", "group_key").agg(F.count(F.lit(1)).alias("n")).groupBy("record_table", "split").agg(F.sum("n").alias("n_records"), F.count(F.lit(1)).alias("n_groups"))
    target = F.create_map(*[F.lit(x) for pair in zip(SPLITS, SHARES) for x in pair])
    return per.select("*", (F.col("n_records") / F.sum("n_records").over(Window.partitionBy("record_table"))).alias("share"), target[F.col("split")].alias("target_share"))


def p1_checks(spark: SparkSession, d: str) -> DataFrame:
    """record_table, n_records, n_torn, balanced: each record once; authors, items and text keys of documents in several splits; all shares within two points of their targets."""
    rows = cut(p1_assign(spark, d))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("record_id"), author().alias("user_id"), clean_id("sku").alias("sku"))
    keys = assignments(spark, d).groupBy(F.col("row_index").alias("record_id")).agg(F.max("group_key").alias("group_key"))
    named = docs.join(keys, "record_id", "left").select("record_id", F.explode(F.array(*[F.when(F.col(k).isNotNull(), F.concat(F.lit(f"{k}:"), k)) for k in ("user_id", "sku", "group_key")])).alias("key")).where("key is not null")
    torn = rows.where("record_table = 'documents'").join(named, "record_id").groupBy("key").agg((F.min("split") != F.max("split")).alias("torn")).where("torn").count()
    target = F.create_map(*[F.lit(x) for pair in zip(SPLITS, SHARES) for x in pair])
    per = rows.groupBy("record_table", "split").agg(F.count(F.lit(1)).alias("n")).withColumn("all", F.sum("n").over(Window.partitionBy("record_table")))
    out = per.groupBy("record_table").agg(F.sum("n").alias("n_records"), F.every(F.abs(F.col("n") / F.col("all") - target[F.col("split")]) <= 0.02).alias("balanced"))
    return out.select("record_table", "n_records", F.when(F.col("record_table") == "documents", torn).otherwise(0).cast("bigint").alias("n_torn"), "balanced")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = together(table(spark, d, "order_products__prior"), "order_id", "product_id", min_both=8, min_share=0.001)
    often = (F.col("n_both") * F.col("n_baskets") >= 3 * F.col("n_a") * F.col("n_b")) & (F.col("n_both") * 1000 >= F.col("n_baskets"))
    return pairs.where(often).select(F.col("a").cast("bigint").alias("product_id_a"), F.col("b").cast("bigint").alias("product_id_b"))


def p5_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of products that is in a basket together, with its ratio to chance."""
    pairs = together(table(spark, d, "order_products__prior"), "order_id", "product_id")
    return pairs.select("a", "b", "n_both", "n_a", "n_b", "n_baskets", F.round("expected", 6).alias("expected"), F.round("lift", 6).alias("lift"), F.round("odds_ratio", 6).alias("odds_ratio"))


def split_documents(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, text, source, train, held: documents with a split, by normalized split name."""
    sides = assignments(spark, d).groupBy(F.col("row_index").alias("doc_id")).agg(F.max(F.col("split") == TRAIN).alias("train"), F.max(F.col("split").isin(*HELD)).alias("held"), F.max(F.when(F.col("split").isin(*HELD), F.col("split"))).alias("held_split")).where("train or held")
    return table(spark, d, "documents").select("doc_id", "text", "source").join(sides, "doc_id")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = overlap.cross_split_pairs(split_documents(spark, d))
    return pairs.select(F.least("doc_train", "doc_held").alias("doc_id_a"), F.greatest("doc_train", "doc_held").alias("doc_id_b")).distinct()


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """Per held-out split and source: overlapping documents and pairs with train, and the group_keys that overlap with other ratings.

    Pairs are counted from the sizes of the classes of equal texts; none is made.
    """
    docs = split_documents(spark, d).drop("text")
    keyed = assignments(spark, d).groupBy(F.col("row_index").alias("doc_id")).agg(F.max("group_key").alias("group_key"), F.min("customer_rating").alias("low"), F.max("customer_rating").alias("high"))
    rated = keyed.groupBy("group_key").agg((F.min("low") != F.max("high")).alias("conflict")).where("conflict and group_key is not null")
    rows = overlap.Overlaps(split_documents(spark, d)).counts().withColumnRenamed("doc_held", "doc_id").join(docs, "doc_id")
    rows = rows.join(keyed.select("doc_id", "group_key"), "doc_id", "left").join(rated, "group_key", "left")
    return rows.groupBy(F.col("held_split").alias("split"), "source").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n").alias("n_pairs"), F.count_if("conflict").alias("n_conflicting"), F.countDistinct(F.when(F.col("conflict"), F.col("group_key"))).alias("n_conflicting_groups"))


def p7_coverage(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, split, source, n_words, covered: words of each held-out document in spans of 8 words or more that train has too."""
    docs = split_documents(spark, d)
    return overlap.coverage(docs).join(docs.where("held").select("doc_id", F.col("held_split").alias("split"), "source"), "doc_id")


def p8_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed_documents(spread(table(spark, d, "documents").select("doc_id", "text")))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p8_pack(spark, d))


def p8_checks(spark: SparkSession, d: str) -> DataFrame:
    """n_documents that are packed; n_over: containers above the capacity; n_parted: documents in several pieces that would fit into one; n_gaps: documents whose pieces do not follow each other."""
    packed = cut(p8_pack(spark, d))
    boxes = packed.groupBy("container").agg(F.sum("tokens").alias("t")).agg(F.count_if(F.col("t") > packing.CAPACITY).alias("n_over"))
    docs = packed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("t"), F.max(F.col("first_token") + F.col("tokens")).alias("end"))
    per = docs.agg(F.count(F.lit(1)).alias("n_documents"), F.count_if((F.col("n") > 1) & (F.col("t") <= packing.CAPACITY)).alias("n_parted"), F.count_if(F.col("end") != F.col("t")).alias("n_gaps"))
    return per.withColumn("n_over", F.lit(boxes.first()[0]).cast("bigint"))


def _drawn(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    items = cut(packing.sized(spread(docs.select("doc_id", "source", "text")), carry=["source"]))
    return mixing.draw(items, table(spark, d, "mix_targets"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixed(_drawn(spark, d))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(_drawn(spark, d), table(spark, d, "mix_targets"))


def p9_checks(spark: SparkSession, d: str) -> DataFrame:
    """source, n_foreign, n_beyond: rows of the mix whose document is of another source, and uses beyond max_repeats, of each target's source that has documents."""
    mix = p9_mix(spark, d).join(table(spark, d, "documents").select("doc_id", F.col("source").alias("own")), "doc_id").join(table(spark, d, "mix_targets"), "source")
    return mix.groupBy("source").agg(F.count_if(F.col("own") != F.col("source")).alias("n_foreign"), F.count_if(F.col("use") > F.col("max_repeats")).alias("n_beyond"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents").select("doc_id", "text", "lang"))
    return langid.mislabelled(docs, langid.language_segments(docs))


def p10_documents(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, lang, confidence, share, n_langs: a row per language a document holds."""
    return langid.document_languages(langid.language_segments(spread(table(spark, d, "documents").select("doc_id", "text", "lang"))))


def p10_segments(spark: SparkSession, d: str) -> DataFrame:
    """Every segment of every document with its language and confidence."""
    return langid.language_segments(spread(table(spark, d, "documents").select("doc_id", "text", "lang")))


QUERIES = {f.__name__: f for f in (p1_found, p1_assign, p1_balance, p1_checks, p5_found, p5_pairs, p7_found, p7_report, p7_coverage, p8_pack, p8_fill, p8_checks, p9_mix, p9_shares, p9_checks, p10_found, p10_documents, p10_segments)}

_PAIRS = """WITH l AS (SELECT DISTINCT order_id, product_id FROM order_products__prior WHERE product_id IS NOT NULL AND order_id IS NOT NULL),
  n AS (SELECT count(DISTINCT order_id) AS n FROM order_products__prior), s AS (SELECT product_id, count(*) AS c FROM l GROUP BY 1),
  p AS (SELECT x.product_id AS a, y.product_id AS b, count(*) AS n_both FROM l x JOIN l y ON x.order_id = y.order_id AND x.product_id < y.product_id GROUP BY 1, 2),
  f AS (SELECT p.a, p.b, n_both, sa.c AS n_a, sb.c AS n_b, n.n AS n_baskets FROM p JOIN s sa ON sa.product_id = p.a JOIN s sb ON sb.product_id = p.b, n)"""

SQL = {
    "p5_found": f"""{_PAIRS} SELECT CAST(a AS BIGINT) AS product_id_a, CAST(b AS BIGINT) AS product_id_b FROM f
      WHERE n_both >= 8 AND n_both * 1000 >= n_baskets AND n_both * n_baskets >= 3 * n_a * n_b""",
    "p5_pairs": f"""{_PAIRS} SELECT a, b, n_both, n_a, n_b, n_baskets, round(n_a * n_b / CAST(n_baskets AS DOUBLE), 6) AS expected, round(n_both * CAST(n_baskets AS DOUBLE) / (n_a * n_b), 6) AS lift,
      round((n_both + 0.5::DOUBLE) * (n_baskets - n_a - n_b + n_both + 0.5::DOUBLE) / ((n_a - n_both + 0.5::DOUBLE) * (n_b - n_both + 0.5::DOUBLE)), 6) AS odds_ratio FROM f""",
    "p1_found": """WITH RECURSIVE r AS (SELECT DISTINCT row_index AS id, nullif(lower(trim(a.sku)), '') AS sku, nullif(trim(group_key), '') AS g, lower(trim(split)) AS split,
        nullif(nullif(lower(trim(user_id)), ''), 'unknown') AS u FROM split_assignments a LEFT JOIN documents ON doc_id = row_index WHERE nullif(trim(split), '') IS NOT NULL),
      k AS (SELECT DISTINCT id, key FROM (SELECT id, 'u' || u AS key FROM r UNION ALL SELECT id, 's' || sku FROM r UNION ALL SELECT id, 'g' || g FROM r) WHERE key IS NOT NULL),
      m AS (SELECT k.id, min(k.id) OVER (PARTITION BY key) AS head FROM k),
      e AS (SELECT DISTINCT id, head FROM m WHERE id <> head UNION SELECT DISTINCT head, id FROM m WHERE id <> head),
      c AS (SELECT DISTINCT id, id AS root FROM r UNION SELECT e.head, c.root FROM c JOIN e ON e.id = c.id WHERE e.head > c.root),
      t AS (SELECT id, min(root) AS root FROM c GROUP BY 1),
      x AS (SELECT t.root FROM t JOIN r USING (id) GROUP BY 1 HAVING min(split) <> max(split))
      SELECT 'split_assignments' AS record_table, id AS record_id FROM t WHERE root IN (SELECT root FROM x)
      UNION ALL SELECT 'user_partitions', user_id FROM user_partitions GROUP BY user_id HAVING min(lower(trim(partition))) <> max(lower(trim(partition)))""",
}

# the markup of the given texts; the tests have literal cases for other entities
_WORDS = r"""t AS (SELECT row_index AS doc_id, max(lower(trim(split)) = 'train') AS train, max(lower(trim(split)) IN ('validation', 'protected_test')) AS held, max(CASE WHEN lower(trim(split)) IN ('validation', 'protected_test') THEN lower(trim(split)) END) AS held_split
    FROM split_assignments WHERE nullif(trim(split), '') IS NOT NULL GROUP BY 1),
  w AS (SELECT d.doc_id, source, held_split, train, held, regexp_extract_all(strip_accents(lower(regexp_replace(regexp_replace(regexp_replace(replace(text, '&nbsp;', ' '), '<[^<>]*>', ' ', 'g'), '[\x{0640}\p{Cf}]', '', 'g'), '\p{M}', '', 'g'))), '[\p{L}\p{N}]+') AS w
    FROM documents d JOIN t USING (doc_id) WHERE train OR held)"""
_NEAR = f"""{_WORDS}, s AS (SELECT doc_id, train, held, unnest(list_distinct(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE [concat(w[i], ' ', w[i + 1], ' ', w[i + 2]) for i in range(1, len(w) - 1)] END)) AS g FROM w WHERE len(w) > 0),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1), c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.train AND b.held AND a.doc_id <> b.doc_id GROUP BY 1, 2),
  p AS (SELECT x AS doc_train, y AS doc_held FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE c >= 0.6 * (a.n + b.n - c))"""

SQL |= {
    "p7_found": f"WITH {_NEAR} SELECT DISTINCT least(doc_train, doc_held) AS doc_id_a, greatest(doc_train, doc_held) AS doc_id_b FROM p",
    "p7_report": f"""WITH {_NEAR}, k AS (SELECT row_index AS doc_id, max(nullif(trim(group_key), '')) AS g, min(customer_rating) AS low, max(customer_rating) AS high FROM split_assignments GROUP BY 1),
      r AS (SELECT g FROM k WHERE g IS NOT NULL GROUP BY 1 HAVING min(low) <> max(high)), h AS (SELECT doc_held AS doc_id, count(*) AS n FROM p GROUP BY 1)
      SELECT held_split AS split, source, count(*) AS n_documents, CAST(sum(n) AS BIGINT) AS n_pairs, count(r.g) AS n_conflicting, count(DISTINCT r.g) AS n_conflicting_groups FROM h JOIN w USING (doc_id) LEFT JOIN k USING (doc_id) LEFT JOIN r ON r.g = k.g GROUP BY 1, 2""",
    "p7_coverage": f"""WITH {_WORDS}, u AS (SELECT doc_id, train, held, len(w) AS m, unnest(CASE WHEN len(w) < 8 THEN [{{'i': 1, 'g': concat('=', array_to_string(w, ' '))}}] ELSE [{{'i': i, 'g': array_to_string(w[i : i + 7], ' ')}} for i in range(1, len(w) - 6)] END) AS r FROM w WHERE len(w) > 0),
      b AS (SELECT r.g AS g FROM u GROUP BY 1 HAVING bool_or(train) AND bool_or(held)), v AS (SELECT DISTINCT doc_id, unnest(range(r.i, r.i + least(m, 8))) AS at_word FROM u JOIN b ON b.g = u.r.g WHERE held)
      SELECT w.doc_id, held_split AS split, source, len(w) AS n_words, CAST(coalesce(x.n, 0) AS BIGINT) AS covered FROM w LEFT JOIN (SELECT doc_id, count(*) AS n FROM v GROUP BY 1) x USING (doc_id) WHERE held AND len(w) > 0""",
}

# what must hold of any right result
SQL |= {
    "p1_checks": """SELECT 'documents' AS record_table, count(*) AS n_records, CAST(0 AS BIGINT) AS n_torn, true AS balanced FROM documents
      UNION ALL SELECT 'user_partitions', count(*), 0, true FROM (SELECT user_id FROM user_partitions WHERE user_id IS NOT NULL UNION SELECT user_id FROM basket_orders WHERE user_id IS NOT NULL)""",
    "p8_checks": "SELECT count(*) AS n_documents, CAST(0 AS BIGINT) AS n_parted, CAST(0 AS BIGINT) AS n_gaps, CAST(0 AS BIGINT) AS n_over FROM documents WHERE text <> ''",
    "p9_checks": "SELECT source, CAST(0 AS BIGINT) AS n_foreign, CAST(0 AS BIGINT) AS n_beyond FROM mix_targets WHERE target_share > 0 AND max_repeats > 0 AND source IN (SELECT source FROM documents WHERE text <> '')",
}
