"""Near-duplicate texts inside buckets, exactly and without a cap on buckets.

Texts with the same normal form are one class. Two classes of a bucket are linked if the Jaccard similarity of their
character n-grams reaches the threshold. Candidates share HITS of the rarest n-grams of each (prefix filter), which loses none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartloom.functions.text import char_ngrams, dedup_text
from cartloom.session import cut, shuffle_width

#: Rare n-grams that two classes must share to be compared.
HITS = 3


def near_duplicates(docs: DataFrame, n: int = 5, threshold: float = 0.85, head: int = 2) -> DataFrame:
    """(doc_id, class_id, n_links): docs has doc_id, text. class_id: the smallest doc_id with the same normal form; n_links: other
    documents that are equal or similar. Documents whose normal form is empty are left out; the bucket is the first `head` words.
    """
    texts = docs.select("doc_id", dedup_text("text").alias("t")).where("t is not null and t <> ''")
    classes = cut(texts.groupBy("t").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("copies")))
    sets = classes.repartition(shuffle_width(docs.sparkSession), "class_id").select("class_id", "copies", F.array_join(F.slice(F.split("t", " "), 1, head), " ").alias("bucket"), F.array_distinct(F.transform(F.when(F.length("t") >= n, char_ngrams(F.col("t"), n)).otherwise(F.array("t")), lambda x: F.xxhash64(x))).alias("g"))
    sets = cut(sets).withColumn("k", F.size("g"))  # n-grams as 64-bit hashes
    tokens = sets.select("class_id", "k", F.explode("g").alias("gram"), "bucket").select("class_id", "k", F.xxhash64("bucket", "gram").alias("gram"))
    shared = tokens.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    per = Window.partitionBy("class_id")
    need = F.ceil(F.col("k") * threshold - 1e-9)
    near = tokens.join(shared, "gram").withColumn("c", F.count(F.lit(1)).over(per)).where(F.col("c") >= need)
    near = near.withColumn("place", F.row_number().over(per.orderBy("df", "gram"))).where(F.col("place") <= F.col("c") - need + F.least(F.lit(HITS), need))
    a = near.select("gram", F.col("class_id").alias("a"), F.col("k").alias("ka"))
    b = near.select("gram", F.col("class_id").alias("b"), F.col("k").alias("kb"))
    least = F.least(F.lit(HITS), F.ceil(F.least("ka", "kb") * threshold - 1e-9))
    pairs = a.join(b, "gram").where((F.col("a") < F.col("b")) & (F.least("ka", "kb") >= F.greatest("ka", "kb") * threshold - 1e-9))
    pairs = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("hits"), F.first(least).alias("least")).where("hits >= least").select("a", "b")
    left = sets.select(F.col("class_id").alias("a"), F.col("g").alias("ga"), F.col("copies").alias("na"))
    right = sets.select(F.col("class_id").alias("b"), F.col("g").alias("gb"), F.col("copies").alias("nb"))
    same = F.size(F.array_intersect("ga", "gb"))
    linked = pairs.join(left, "a").join(right, "b").where(same >= (F.size("ga") + F.size("gb") - same) * F.lit(threshold) - 1e-9)
    links = linked.select(F.explode(F.array(F.struct(F.col("a").alias("class_id"), F.col("nb").alias("n")), F.struct(F.col("b").alias("class_id"), F.col("na").alias("n")))).alias("l")).select("l.*").groupBy("class_id").agg(F.sum("n").alias("other"))
    out = texts.join(classes, "t").join(links, "class_id", "left")
    return out.select("doc_id", "class_id", (F.col("copies") - 1 + F.coalesce("other", F.lit(0))).alias("n_links"))
