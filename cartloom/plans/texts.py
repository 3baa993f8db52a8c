"""Scalar (SC) and text (TX) queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cartloom.functions import scalars as S
from cartloom.functions import text as T
from cartloom.functions.keys import zip_code
from cartloom.operators.similar import near_duplicates
from cartloom.plans.registry import Registry
from cartloom.plans.relational import ORDERS, orders
from cartloom.session import cut
from cartloom.sources.tables import table

R = Registry()


def N():
    return F.count(F.lit(1))


@R.query(f"WITH {ORDERS} SELECT order_id, year(bought) AS y, month(bought) AS m, hour(bought) AS h, dayofweek(bought) AS sunday0, isodow(bought) - 1 AS monday0, weekofyear(bought) AS week, strftime(bought, '%Y-%m') AS month, CAST(date_trunc('month', bought) AS DATE) AS month_start, CAST(bought AS DATE) AS day FROM o WHERE bought IS NOT NULL")
def sc01_05_08_09_calendar(spark, d):
    b = F.col("bought")
    return orders(spark, d).where("bought is not null").select("order_id", F.year(b).alias("y"), F.month(b).alias("m"), F.hour(b).alias("h"), S.sunday_weekday(b).alias("sunday0"), F.weekday(b).alias("monday0"), F.weekofyear(b).alias("week"), F.date_format(b, "yyyy-MM").alias("month"), F.to_date(F.date_trunc("month", b)).alias("month_start"), F.to_date(b).alias("day"))


@R.query(f"WITH {ORDERS} SELECT order_id, date_diff('second', bought, approved) AS seconds, round((epoch_us(delivered) - epoch_us(bought)) / 86400000000.0::DOUBLE, 8) AS days FROM o WHERE bought IS NOT NULL")
def sc06_07_durations(spark, d):
    return orders(spark, d).where("bought is not null").select("order_id", S.seconds_between("bought", "approved").alias("seconds"), F.round(S.days_between("bought", "delivered"), 8).alias("days"))


@R.query("SELECT event_id, epoch_ms(epoch_us(ts) // 1000) AS ms_time, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def sc10_11_epoch_cast(spark, d):
    return table(spark, d, "events").select("event_id", F.timestamp_millis(F.unix_millis(F.col("ts").cast("timestamp"))).alias("ms_time"), F.get_json_object("props", "$.k").try_cast("int").alias("k"))


@R.query("""WITH g AS (SELECT lpad(trim(geolocation_zip_code_prefix), 5, '0') AS zip, avg(geolocation_lat) AS lat, avg(geolocation_lng) AS lng FROM (SELECT DISTINCT * FROM olist_geolocation_dataset) WHERE geolocation_lat <> 0 GROUP BY 1),
  p AS (SELECT zip, lat, lng, lead(lat) OVER (ORDER BY zip) AS lat2, lead(lng) OVER (ORDER BY zip) AS lng2 FROM g) SELECT zip, round(2 * 6371.0::DOUBLE * asin(sqrt(pow(sin(radians(lat2 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(lat2)) * pow(sin(radians(lng2 - lng) / 2), 2))), 4) AS km, round(abs(lat2 - lat), 8) AS dlat FROM p WHERE lat2 IS NOT NULL""")
def sc12_14_haversine(spark, d):
    """Distances between neighbouring zip centroids; the table of zips does not grow with the data."""
    rows = table(spark, d, "olist_geolocation_dataset").distinct().where("geolocation_lat <> 0")
    g = rows.groupBy(zip_code("geolocation_zip_code_prefix").alias("zip")).agg(F.avg("geolocation_lat").alias("lat"), F.avg("geolocation_lng").alias("lng"))
    w = Window.partitionBy(F.lit(0)).orderBy("zip")
    p = g.select("*", F.lead("lat").over(w).alias("lat2"), F.lead("lng").over(w).alias("lng2")).where("lat2 is not null")
    return p.select("zip", F.round(S.haversine_km(F.col("lat"), F.col("lng"), F.col("lat2"), F.col("lng2")), 4).alias("km"), F.round(F.abs(F.col("lat2") - F.col("lat")), 8).alias("dlat"))


@R.query("SELECT event_id, round(ln(1 + value), 6) AS log1p_value, round(exp(-value / 100), 6) AS decay, round(log2(value + 1), 6) AS log2_value, coalesce(CASE WHEN value > 50 THEN value END, 0.0) AS big FROM events")
def sc13_15_24_math(spark, d):
    v = F.col("value")
    return table(spark, d, "events").select("event_id", F.round(F.log1p(v), 6).alias("log1p_value"), F.round(F.exp(-v / 100), 6).alias("decay"), F.round(F.log2(v + 1), 6).alias("log2_value"), F.coalesce(F.when(v > 50, v), F.lit(0.0)).alias("big"))


@R.query("SELECT doc_id, length(trim(text)) AS n_chars, length(trim(text)) - length(replace(trim(text), ' ', '')) + 1 AS n_words, concat_ws('|', source, lang) AS key, sha256(text) AS digest, substr(sha1(text), 1, 10) AS short_digest FROM documents WHERE text IS NOT NULL")
def sc16_18_text_keys(spark, d):
    t = F.trim("text")
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.length(t).alias("n_chars"), (F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1).alias("n_words"), F.concat_ws("|", "source", "lang").alias("key"), F.sha2("text", 256).alias("digest"), F.substring(F.sha1("text"), 1, 10).alias("short_digest"))


_BUCKET = "(list_reduce([CAST(concat('0x', substr(h, i * 8 + 1, 8)) AS BIGINT) for i in range(8)], lambda a, x: (a * 967296 + x) % 1000000, CAST(0 AS BIGINT)) / 1000000.0::DOUBLE)"


@R.query(f"WITH u AS (SELECT DISTINCT user_id, sha256(concat('split-v1:', user_id)) AS h FROM basket_orders WHERE user_id IS NOT NULL), b AS (SELECT user_id, {_BUCKET} AS bucket FROM u) SELECT user_id, bucket, CASE WHEN bucket < 0.20 THEN 'test' WHEN bucket < 0.36 THEN 'evaluate' ELSE 'fit' END AS part FROM b")
def sc19_20_sp01_hash_partition(spark, d):
    """Users in 20/16/64 parts by their salted hash."""
    b = table(spark, d, "basket_orders").select("user_id").where("user_id is not null").distinct().withColumn("bucket", S.hash_millionth(F.concat(F.lit("split-v1:"), F.col("user_id").cast("string"))))
    return b.select("user_id", "bucket", F.when(F.col("bucket") < 0.20, "test").when(F.col("bucket") < 0.36, "evaluate").otherwise("fit").alias("part"))


_QUARTERS = ", ".join(f"CAST(sum(CAST(concat('0x', substr(h, {i * 8 + 1}, 8)) AS BIGINT)) AS BIGINT)" for i in range(4))


@R.query(f"SELECT event_type, count(*) AS n_ids, concat_ws(':', {_QUARTERS}) AS digest FROM (SELECT DISTINCT event_type, md5(CAST(user_id AS VARCHAR)) AS h FROM events WHERE user_id IS NOT NULL) GROUP BY 1")
def sc21_set_digest(spark, d):
    """An order-free digest of each set of ids: their number and the sums of the four quarters of their 128-bit hashes, so no set is gathered."""
    ids = table(spark, d, "events").where("user_id is not null").select("event_type", "user_id").distinct().withColumn("h", F.md5(F.col("user_id").cast("string")))
    sums = [F.sum(F.conv(F.substring("h", i * 8 + 1, 8), 16, 10).cast("bigint")).cast("string") for i in range(4)]
    return ids.groupBy("event_type").agg(N().alias("n_ids"), F.concat_ws(":", *sums).alias("digest"))


@R.query("""WITH l AS (SELECT event_id, [value / 10, 3.0, ln(1 + value)] AS z FROM events), e AS (SELECT event_id, z, [exp(x - list_max(z)) for x in z] AS p FROM l) SELECT event_id, round(p[1] / list_sum(p), 6) AS p0, round(p[2] / list_sum(p), 6) AS p1, list_position(z, list_max(z)) - 1 AS best FROM e""")
def sc25_softmax(spark, d):
    z = F.array(F.col("value") / 10, F.lit(3.0), F.log1p("value"))
    rows = table(spark, d, "events").select("event_id", z.alias("z")).withColumn("p", S.softmax(F.col("z")))
    return rows.select("event_id", F.round(F.col("p")[0], 6).alias("p0"), F.round(F.col("p")[1], 6).alias("p1"), S.argmax(F.col("z")).alias("best"))


@R.query()
def sc25_temperature(spark, d):
    """The temperature at which the softmax of the three logits fits whether a value is below 30, 30 to 60, or above."""
    rows = table(spark, d, "events").where("value is not null").select(F.array(F.col("value") / 10, F.lit(3.0), F.log1p("value")).alias("z"), F.when(F.col("value") < 30, 1).when(F.col("value") < 60, 2).otherwise(0).alias("y"))
    return spark.createDataFrame([(S.fit_temperature(rows, "z", "y"),)], "temperature double")


# --- texts


@R.query()
def tx01_02_contract(spark, d):
    """The contract's normal form of every text (a Unicode step; compared with literal cases in the tests)."""
    return table(spark, d, "documents").select("doc_id", T.contract_column("text").alias("normal"), T.is_minimal_empty("text").alias("is_empty"))


_DEDUP = "trim(regexp_replace(regexp_replace(lower({}), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g'))"


@R.query(f"SELECT doc_id, sha256(coalesce(text, '')) AS raw_key, sha256({_DEDUP.format("coalesce(text, '')")}) AS normal_key FROM documents")
def tx03_04_keys(spark, d):
    """Exact and normalized keys of every document; a null text has the keys of the empty one."""
    text = F.coalesce("text", F.lit(""))
    return table(spark, d, "documents").select("doc_id", F.sha2(text, 256).alias("raw_key"), F.sha2(T.dedup_text(text), 256).alias("normal_key"))


@R.query()
def tx03_contract_key(spark, d):
    """The normalized key over the contract's form (TX01) instead; compared with literal cases in the tests."""
    return table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce(T.contract_column("text"), F.lit("")), 256).alias("contract_key"))


@R.query()
def tx05_07_unicode_forms(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", T.stripped(T.normal_form("NFKC")("text")).alias("plain"), T.arabic_light("text").alias("light"), F.lower(F.trim(F.regexp_replace(T.normal_form("NFC")("text"), r"(?U)\s+", " "))).alias("nfc_key"), F.lower(F.trim(F.regexp_replace(T.normal_form("NFKC")("text"), r"(?U)\s+", " "))).alias("nfkc_key"))


@R.query("SELECT doc_id, round(length(regexp_replace(text, '[^\\x{064b}-\\x{0652}\\x{0670}\\x{06d6}-\\x{06ed}]', '', 'g')) / CAST(nullif(length(text), 0) AS DOUBLE), 8) AS share FROM documents WHERE text IS NOT NULL")
def tx08_mark_share(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.round(T.mark_share("text"), 8).alias("share"))


@R.query("SELECT doc_id, sha256(CASE WHEN length(trim(source)) > 0 THEN concat(source, '. ', text) ELSE text END) AS digest FROM documents")
def tx09_model_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(T.model_text(F.col("source"), F.col("text")), 256).alias("digest"))


_A, _L = ("length(regexp_replace(text, '[^%s]', '', 'g'))" % r for r in ("\\x{0600}-\\x{06ff}\\x{0750}-\\x{077f}", "A-Za-z\\x{00c0}-\\x{00d6}\\x{00d8}-\\x{00f6}\\x{00f8}-\\x{024f}"))


@R.query(f"""WITH c AS (SELECT doc_id, text, {_A} AS a, {_L} AS l, length(regexp_replace(text, '[ \\t\\n\\r]', '', 'g')) AS n FROM documents WHERE text IS NOT NULL)
  SELECT doc_id, CASE WHEN trim(text) = '' THEN 'empty' WHEN a = 0 AND l = 0 THEN 'none' WHEN a > 0 AND l > 0 THEN 'mixed' WHEN a > 0 THEN 'arabic' WHEN regexp_matches(text, '[A-Za-z][2356789][A-Za-z]') THEN 'arabizi' ELSE 'latin' END AS script,
  round(a / CAST(nullif(n, 0) AS DOUBLE), 8) AS arabic_share, round(l / CAST(nullif(n, 0) AS DOUBLE), 8) AS latin_share FROM c""")
def tx10_11_script(spark, d):
    n = F.length(F.regexp_replace("text", "[ \\t\\n\\r]", "")).cast("double")
    share = lambda s: F.round(F.try_divide(T.letters("text", s), n), 8)
    return table(spark, d, "documents").where("text is not null").select("doc_id", T.script_of("text").alias("script"), share("arabic").alias("arabic_share"), share("latin").alias("latin_share"))


_FLAGS = {"url": "https?://[^ ]+", "mention": "@[A-Za-z0-9_]+", "hashtag": "#[A-Za-z0-9_]+", "email": "[A-Za-z0-9._]+@[A-Za-z0-9]+[.][A-Za-z]+", "phone": "[0-9]{3}-[0-9]{4}", "replacement": "\\x{fffd}", "stretch": "\\x{0640}", "tag": "<[^<>]+>", "entity": "&[a-z]+;", "boilerplate": "(?i)all rights reserved|click here|subscribe", "punctuation": "[!?]{2,}", "negation": "(?i)(^|[^a-z])(not|no|never|nobody|n't)([^a-z]|$)"}


@R.query("SELECT source, count(*) AS n, " + ", ".join(f"count(*) FILTER (WHERE regexp_matches(text, '{p.replace(chr(39), chr(39) * 2)}')) AS n_{k}" for k, p in _FLAGS.items()) + " FROM documents GROUP BY 1")
def tx12_22_24_31_flags(spark, d):
    """Documents per source with links, mentions, personal data, markup, boilerplate, repeated punctuation, negations."""
    return table(spark, d, "documents").groupBy("source").agg(N().alias("n"), *[F.count_if(F.col("text").rlike(p)).alias(f"n_{k}") for k, p in _FLAGS.items()])


@R.query("""WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '[ \\t\\n\\r]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL), g AS (SELECT unnest([concat(w[i], ' ', w[i + 1]) for i in range(1, len(w))]) AS gram FROM w) SELECT gram, count(*) AS n FROM g GROUP BY 1 ORDER BY n DESC, gram LIMIT 50""")
def tx13_word_ngrams(spark, d):
    g = table(spark, d, "documents").where("text is not null").select(F.explode(T.ngrams(T.words("text"), 2)).alias("gram"))
    return g.groupBy("gram").agg(N().alias("n")).orderBy(F.desc("n"), "gram").limit(50)


@R.query("WITH g AS (SELECT unnest([substr(text, i, 3) for i in range(1, length(text) - 1)]) AS gram FROM documents WHERE text IS NOT NULL) SELECT gram, count(*) AS n FROM g GROUP BY 1 ORDER BY n DESC, gram LIMIT 50")
def tx14_char_ngrams(spark, d):
    g = table(spark, d, "documents").where("text is not null").select(F.explode(T.char_ngrams(F.col("text"), 3)).alias("gram"))
    return g.groupBy("gram").agg(N().alias("n")).orderBy(F.desc("n"), "gram").limit(50)


_TOKENS = "SELECT source, unnest(regexp_extract_all(lower(text), '[a-z'']+')) AS token FROM documents"


@R.query(f"WITH t AS ({_TOKENS}), v AS (SELECT token, count(*) AS n FROM t WHERE token NOT IN ('the', 'a', 'and', 'of', 'to', 'in', 'is', 'it') GROUP BY 1) SELECT count(*) AS vocabulary, CAST(sum(n) AS BIGINT) AS tokens, round(count(*) FILTER (WHERE n = 1) / CAST(count(*) AS DOUBLE), 8) AS hapax_share FROM v")
def tx15_vocabulary(spark, d):
    t = table(spark, d, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z']+"), F.lit(0))).alias("token"))
    v = t.where(~F.col("token").isin("the", "a", "and", "of", "to", "in", "is", "it")).groupBy("token").agg(N().alias("n"))
    return v.agg(N().alias("vocabulary"), F.sum("n").alias("tokens"), F.round(F.count_if(F.col("n") == 1) / N(), 8).alias("hapax_share"))


@R.query(f"WITH t AS ({_TOKENS}), n AS (SELECT source, token, count(*) AS n FROM t GROUP BY 1, 2) SELECT source, token, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, token) AS rank FROM n) WHERE rank <= 10")
def tx16_top_per_class(spark, d):
    t = table(spark, d, "documents").select("source", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z']+"), F.lit(0))).alias("token"))
    n = t.groupBy("source", "token").agg(N().alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "token"))).where("rank <= 10")


@R.query("WITH g AS (SELECT trim(text) AS t, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1) SELECT count(*) FILTER (WHERE n > 1) AS n_groups, CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS n_rows, CAST(sum(n - 1) AS BIGINT) AS n_surplus, round(coalesce(sum(n) FILTER (WHERE n > 1), 0) / CAST(sum(n) AS DOUBLE), 8) AS share FROM g")
def tx17_21_exact_duplicates(spark, d):
    g = table(spark, d, "documents").where("text is not null").groupBy(F.sha2(F.trim("text"), 256).alias("k")).agg(N().alias("n"))
    many = F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0))
    return g.agg(F.count_if(F.col("n") > 1).alias("n_groups"), many.alias("n_rows"), F.sum(F.col("n") - 1).alias("n_surplus"), F.round(many / F.sum("n"), 8).alias("share"))


@R.query(f"""WITH t AS (SELECT doc_id, {_DEDUP.format("text")} AS t FROM documents WHERE text IS NOT NULL), c AS (SELECT t, min(doc_id) AS class_id, count(*) AS copies FROM t WHERE t <> '' GROUP BY 1),
  s AS (SELECT class_id, copies, array_to_string(string_split(t, ' ')[1:2], ' ') AS bucket, CASE WHEN length(t) >= 5 THEN list_distinct([substr(t, i, 5) for i in range(1, length(t) - 3)]) ELSE [t] END AS g FROM c),
  p AS (SELECT a.class_id AS a, b.copies AS n FROM s a JOIN s b ON a.bucket = b.bucket AND a.class_id <> b.class_id AND least(len(a.g), len(b.g)) >= 0.85 * greatest(len(a.g), len(b.g)) WHERE len(list_intersect(a.g, b.g)) >= 0.85 * (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g)))),
  l AS (SELECT a AS class_id, sum(n) AS other FROM p GROUP BY 1) SELECT doc_id, c.class_id, CAST(copies - 1 + coalesce(other, 0) AS BIGINT) AS n_links FROM t JOIN c USING (t) LEFT JOIN l USING (class_id)""")
def tx18_near_duplicates(spark, d):
    return near_duplicates(table(spark, d, "documents"))


def stages(docs):
    """Rows, those removed as exact copies, then as equal in normal form, and those left.

    The normal form keeps a-z and 0-9 only, so all texts without any (as Arabic ones) are one near class: n_no_letters of
    n_near are removed for that. Null texts are copies of each other and read 'None', as Python's str makes them.
    """
    rows = docs.select(F.sha2("text", 256).alias("k"), T.dedup_text(F.coalesce("text", F.lit("None"))).alias("t"))
    exact = rows.groupBy("k", "t").agg(N().alias("n"))
    near = exact.groupBy("t").agg(F.sum("n").alias("n"), N().alias("m"))
    surplus = F.col("m") - 1
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return near.agg(total(F.col("n")).alias("n_rows"), total(F.col("n") - F.col("m")).alias("n_exact"), total(surplus).alias("n_near"), N().alias("n_left"), total(F.when(F.col("t") == "", surplus)).alias("n_no_letters"))


@R.query(f"WITH e AS (SELECT text, {_DEDUP.format("coalesce(text, 'None')")} AS t, count(*) AS n FROM documents GROUP BY 1, 2), f AS (SELECT t, CAST(sum(n) AS BIGINT) AS n, count(*) AS m FROM e GROUP BY 1) SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS n_rows, CAST(coalesce(sum(n - m), 0) AS BIGINT) AS n_exact, CAST(coalesce(sum(m - 1), 0) AS BIGINT) AS n_near, count(*) AS n_left, CAST(coalesce(sum(m - 1) FILTER (WHERE t = ''), 0) AS BIGINT) AS n_no_letters FROM f")
def tx19_staged_dedup(spark, d):
    """The stages over every text."""
    return stages(table(spark, d, "documents"))


@R.query("WITH g AS (SELECT group_key, count(*) AS n, count(DISTINCT customer_rating) AS labels FROM split_assignments WHERE group_key IS NOT NULL GROUP BY 1) SELECT count(*) FILTER (WHERE labels > 1) AS n_keys, CAST(coalesce(sum(n) FILTER (WHERE labels > 1), 0) AS BIGINT) AS n_rows FROM g")
def tx20_label_conflicts(spark, d):
    g = table(spark, d, "split_assignments").where("group_key is not null").groupBy("group_key").agg(N().alias("n"), (F.min("customer_rating") != F.max("customer_rating")).alias("differ"))
    return g.agg(F.count_if("differ").alias("n_keys"), F.coalesce(F.sum(F.when(F.col("differ"), F.col("n"))), F.lit(0)).alias("n_rows"))


@R.query("SELECT doc_id, list_contains([s[i] = s[i + 1] AND s[i] = s[i + 2] AND regexp_matches(s[i], '[a-z]') for i in range(1, len(s) - 1)], true) AS elongated FROM (SELECT doc_id, string_split(text, '') AS s FROM documents WHERE text IS NOT NULL)")
def tx23_elongation(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.col("text").rlike(r"([a-z])\1{2}").alias("elongated"))


# Fixed words of the signal below.
GOOD, BAD = ["good", "great", "lovely", "best", "worth", "better"], ["broke", "bad", "worst", "never", "useless", "stopped"]


@R.query(f"""WITH t AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z'']+')) AS w FROM documents WHERE text IS NOT NULL), s AS (SELECT doc_id, len(list_intersect(w, {GOOD})) AS good, len(list_intersect(w, {BAD})) AS bad FROM t) SELECT doc_id, good, bad, good - bad AS signal, r.rating <= 2 AND good > bad OR r.rating >= 4 AND bad > good AS contradicts FROM s LEFT JOIN (SELECT row_index, min(customer_rating) AS rating FROM split_assignments GROUP BY 1) r ON row_index = doc_id""")
def tx25_26_lexicon(spark, d):
    w = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z']+"), F.lit(0)))
    hits = lambda words: F.size(F.array_intersect("w", F.array(*[F.lit(x) for x in words])))
    s = table(spark, d, "documents").where("text is not null").select("doc_id", w.alias("w")).select("doc_id", hits(GOOD).alias("good"), hits(BAD).alias("bad"))
    r = table(spark, d, "split_assignments").groupBy(F.col("row_index").alias("doc_id")).agg(F.min("customer_rating").alias("rating"))
    clash = ((F.col("rating") <= 2) & (F.col("good") > F.col("bad"))) | ((F.col("rating") >= 4) & (F.col("bad") > F.col("good")))
    return s.join(r, "doc_id", "left").select("doc_id", "good", "bad", (F.col("good") - F.col("bad")).alias("signal"), clash.alias("contradicts"))


# Fixed themes and their keywords.
THEMES = {"delivery": ["delivered", "arrived", "courier", "parcel"], "quality": ["broke", "scratch", "leaks", "cheap"], "service": ["support", "refund", "answered", "message"]}


@R.query(" UNION ALL ".join(f"SELECT '{t}' AS theme, " + " + ".join(f"count(*) FILTER (WHERE contains(lower(text), '{k}'))" for k in ks) + " AS n FROM documents" for t, ks in THEMES.items()))
def tx27_themes(spark, d):
    low = F.lower("text")
    row = table(spark, d, "documents").agg(*[sum((F.count_if(F.contains(low, F.lit(k))) for k in ks[1:]), F.count_if(F.contains(low, F.lit(ks[0])))).alias(t) for t, ks in THEMES.items()])
    return row.select(F.explode(F.array(*[F.struct(F.lit(t).alias("theme"), F.col(t).alias("n")) for t in THEMES])).alias("x")).select("x.*")


@R.query("SELECT source, round(avg(CAST(a < 0.85 AS INT)), 8) AS foreign_share, round(avg(CAST(w < 3 AS INT)), 8) AS below_3, round(avg(CAST(w <= 20 AS INT)), 8) AS upto_20 FROM (SELECT source, length(regexp_replace(text, '[^\\x00-\\x7f]', '', 'g')) / CAST(nullif(length(text), 0) AS DOUBLE) AS a, len(list_filter(string_split_regex(text, '[ \\t\\n\\r]+'), lambda x: x <> '')) AS w FROM documents WHERE text IS NOT NULL) GROUP BY 1")
def tx28_29_short_foreign(spark, d):
    a = F.try_divide(F.length(F.regexp_replace("text", "[^\\x00-\\x7f]", "")).cast("double"), F.length("text"))
    share = lambda c: F.round(F.avg(c.cast("int")), 8)
    rows = table(spark, d, "documents").where("text is not null").select("source", a.alias("a"), F.size(T.words("text")).alias("w"))
    return rows.groupBy("source").agg(share(F.col("a") < 0.85).alias("foreign_share"), share(F.col("w") < 3).alias("below_3"), share(F.col("w") <= 20).alias("upto_20"))


@R.query("""WITH t AS (SELECT unnest(list_filter([CASE WHEN length(text) < 100 THEN 'short' END, CASE WHEN contains(text, '<') THEN 'markup' END, CASE WHEN lang IS NULL OR trim(lang) = '' THEN 'no label' END, CASE WHEN sku IS NULL THEN 'no item' END], lambda x: x IS NOT NULL)) AS tag FROM documents) SELECT tag, count(*) AS n FROM t GROUP BY 1""")
def tx30_tags(spark, d):
    rules = {"short": F.length("text") < 100, "markup": F.contains("text", F.lit("<")), "no label": F.col("lang").isNull() | (F.trim("lang") == ""), "no item": F.col("sku").isNull()}
    tags = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))
    return table(spark, d, "documents").select(F.explode(tags).alias("tag")).groupBy("tag").agg(N().alias("n"))


@R.query(f"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z'']+')) AS term FROM documents), n AS (SELECT count(DISTINCT doc_id) AS n FROM t), f AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM f GROUP BY 1 HAVING count(*) >= 5),
  w AS (SELECT doc_id, term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)::DOUBLE) + 1) AS w FROM f JOIN df USING (term), n) SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w""")
def tx32_tfidf(spark, d):
    """Words in at least five documents: sublinear term frequency, smooth inverse document frequency, unit length."""
    t = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z']+"), F.lit(0))).alias("term"))
    f = t.groupBy("doc_id", "term").agg(N().alias("tf"))
    n = f.select("doc_id").distinct().count()
    df = f.groupBy("term").agg(N().alias("df")).where("df >= 5")
    w = (1 + F.log("tf")) * (F.log(F.lit(float(1 + n)) / (1 + F.col("df"))) + 1)
    rows = f.join(df, "term").select("doc_id", "term", w.alias("w"))
    return rows.select("doc_id", "term", F.round(F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc_id"))), 6).alias("weight"))


_WORDS12 = "SELECT doc_id, 'word' AS block, unnest(list_concat(w, [concat(w[i], ' ', w[i + 1]) for i in range(1, len(w))])) AS term FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z'']+') AS w FROM documents WHERE text IS NOT NULL)"
_CHARS35 = "SELECT doc_id, 'char' AS block, unnest(flatten([[substr(p, i, n) for i in range(1, greatest(length(p) - n, 0) + 2)] for n in [3, 4, 5] if n = 3 OR length(p) >= n])) AS term FROM (SELECT doc_id, unnest([concat(' ', x, ' ') for x in regexp_extract_all(lower(text), '[a-z'']+')]) AS p FROM documents WHERE text IS NOT NULL)"


@R.query(f"""WITH t AS ({_WORDS12} UNION ALL {_CHARS35}), n AS (SELECT count(*) AS n FROM documents WHERE text IS NOT NULL), f AS (SELECT doc_id, block, term, count(*) AS tf FROM t GROUP BY 1, 2, 3), a AS (SELECT block, term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total FROM f GROUP BY 1, 2 HAVING count(*) >= 5),
  v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY block ORDER BY total DESC, term) AS rank FROM a) WHERE rank <= 2000), w AS (SELECT doc_id, block, term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)::DOUBLE) + 1) AS w FROM f JOIN v USING (block, term), n) SELECT doc_id, block, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id, block)), 6) AS weight FROM w""")
def tx32_union(spark, d):
    """Two blocks of features side by side: runs of one and two words, and runs of three to five characters inside words (padded by a
    blank on both sides); of each the 2,000 most frequent of those in at least five documents, sublinear, each block of unit length.
    """
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z']+"), F.lit(0)).alias("w"))
    pairs = docs.select("doc_id", F.lit("word").alias("block"), F.explode(F.concat("w", T.ngrams(F.col("w"), 2))).alias("term"))
    # words are counted first, so that a word's characters are taken apart once per document
    per_word = docs.select("doc_id", F.explode("w").alias("word")).groupBy("doc_id", "word").agg(N().alias("k"))
    padded = F.concat(F.lit(" "), "word", F.lit(" "))
    grams = F.flatten(F.array(*[F.when(F.length(padded) >= n, T.char_ngrams(padded, n)).otherwise(F.array(padded) if n == 3 else F.array().cast("array<string>")) for n in (3, 4, 5)]))
    chars = per_word.select("doc_id", F.lit("char").alias("block"), F.explode(grams).alias("term"), "k").groupBy("doc_id", "block", "term").agg(F.sum("k").alias("tf"))
    f = cut(pairs.groupBy("doc_id", "block", "term").agg(N().alias("tf")).unionByName(chars))
    n = docs.count()
    counts = f.groupBy("block", "term").agg(N().alias("df"), F.sum("tf").alias("total")).where("df >= 5")
    rank = F.row_number().over(Window.partitionBy("block").orderBy(F.desc("total"), "term"))  # a limit of rank: each task keeps the first 2,000 of its own
    v = counts.withColumn("rank", rank).where("rank <= 2000").select("block", "term", "df")
    w = (1 + F.log("tf")) * (F.log(F.lit(float(1 + n)) / (1 + F.col("df"))) + 1)
    rows = f.join(F.broadcast(v), ["block", "term"]).select("doc_id", "block", "term", w.alias("w"))  # 4,000 terms
    return rows.select("doc_id", "block", "term", F.round(F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc_id", "block"))), 6).alias("weight"))


@R.query()
def tx33_stems(spark, d):
    """Light Arabic stems of every text, each different text once."""
    return T.stem_views(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "stems")
