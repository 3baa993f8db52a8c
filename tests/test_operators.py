"""Windows, contracts, sources, text functions, metrics, streams."""

import datetime as dt
import gzip
import math
import random
import statistics
import zipfile

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cartloom.functions import scalars as S
from cartloom.functions import text as T
from cartloom.operators import baskets as B
from cartloom.operators import contracts as C
from cartloom.operators import metrics as M
from cartloom.operators import preparation as D
from cartloom.operators import profile as P
from cartloom.operators import windows as W
from cartloom.operators.similar import near_duplicates
from cartloom.plans.pipelines import quota_groups
from cartloom.sources import io
from cartloom.streaming import events as E

DAY = dt.timedelta(days=1)
T0 = dt.datetime(2022, 1, 1)


# --- windows


def ties(seed, n=120):
    rng = random.Random(seed)
    return [(rng.choice("ab"), i, T0 + DAY * rng.randrange(60), rng.choice([0, 1, None])) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_trailing_frames_with_ties(spark, seed):
    rows = ties(seed)
    df = spark.createDataFrame(rows, "k string, id int, ts timestamp, y int").withColumn("us", W.micros("ts"))
    df = W.shifted_trailing_mean(df, ["k"], "us", "id", "y", 30, "m").withColumn("load", W.trailing_load(["k"], "us", "id", 7))
    got = {r.id: (r.m, r.load) for r in df.collect()}
    for k in "ab":
        own = sorted((t, i, y) for kk, i, t, y in rows if kk == k)
        for at, (t, i, _) in enumerate(own):
            stamped = [(own[j][0], own[j - 1][2]) for j in range(1, at + 1)]
            values = [y for s, y in stamped if s > t - 30 * DAY and y is not None]
            assert got[i][0] == (pytest.approx(sum(values) / len(values)) if values else None)
            assert got[i][1] == sum(1 for s, _, _ in own[:at] if s >= t - 7 * DAY)


def test_asof_totals_are_strict(spark):
    probes = spark.createDataFrame([("a", 1, T0 + DAY), ("a", 2, T0), (None, 3, T0), ("b", 4, None)], "k string, id int, t timestamp")
    facts = spark.createDataFrame([("a", T0, 1), ("a", T0 + DAY, 1), ("a", None, 1), (None, T0, 1)], "k string, known timestamp, y int")
    got = {r.id: (r.prior_n, r.prior_sum) for r in W.asof_totals(probes, facts, "k", "t", "known", "y").collect()}
    assert got == {1: (1, 1.0), 2: (0, 0.0), 3: (0, 0.0), 4: (0, 0.0)}


def test_split_trailing_is_the_plain_windows(spark):
    rows = [("hot" if i % 4 else k, i, t, y) for k, i, t, y in ties(9, 200)]
    df = spark.createDataFrame(rows, "k string, id int, ts timestamp, y int")
    split = {r.id: (r.mean_rows, r.mean_days, r.load) for r in W.split_trailing(df, "k", "ts", "id", "y", 30, 3, 30, 7).collect()}
    plain = df.withColumn("us", W.micros("ts")).withColumn("r", W.prior_rows(F.avg("y"), ["k"], ["us", "id"], 30, 3))
    plain = W.shifted_trailing_mean(plain, ["k"], "us", "id", "y", 30, "m").withColumn("l", W.trailing_load(["k"], "us", "id", 7))
    near = lambda x: None if x is None else pytest.approx(x)
    assert split == {r.id: (near(r.r), near(r.m), r.l) for r in plain.collect()}


def test_previous_rows_of_a_large_key(spark):
    rng = random.Random(8)
    rows = [("hot" if rng.random() < 0.7 else rng.choice("abcd"), i, T0 + DAY * rng.randrange(50), rng.choice([None, 1, 2])) for i in range(400)] + [(None, 400, T0, 1)]
    got = {r.id: (r.prev_id, r.prev_v) for r in W.previous_rows(spark.createDataFrame(rows, "k string, id int, t timestamp, v int"), "k", "t", "id", ["id", "v"]).collect()}
    want = {}
    for k in {r[0] for r in rows} - {None}:
        own = sorted((r for r in rows if r[0] == k), key=lambda r: (r[2], r[1]))
        want |= {b[1]: (a[1], a[3]) if a else (None, None) for a, b in zip([None, *own], own)}
    assert got == want


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_prior_medians_split_a_large_key(spark, seed):
    rng = random.Random(seed)
    value = lambda i: rng.choice([None, float(rng.randrange(5)), rng.gauss(i / 50, 3), float(i % 7)])
    rows = [("hot" if rng.random() < 0.7 else rng.choice("abcdefgh"), i, T0 + DAY * rng.randrange(60), value(i)) for i in range(900)] + [(None, 900, T0, 1.0), ("a", 901, None, 1.0)]
    df = spark.createDataFrame(rows, "k string, id int, t timestamp, v double")
    got = {r.id: r.m for r in W.prior_medians(df, "k", "t", "id", "v", "m").collect()}
    want = {}
    for k, i, t, _ in rows:
        if k and t:
            before = [v for kk, j, tt, v in rows if kk == k and tt and (tt, j) < (t, i) and v is not None]
            want[i] = pytest.approx(statistics.median(before)) if before else None
    assert got == want
    assert W.prior_medians(df.limit(0), "k", "t", "id", "v", "m").collect() == []


@pytest.mark.parametrize("seed", [1, 2])
def test_prior_totals_split_a_large_key(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), i, T0 + DAY * rng.randrange(40), rng.choice([0.5, 1.0, None, 3.0])) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, id int, t timestamp, v double")
    got = {r.id: r for r in W.prior_totals(df, "k", "t", "id", "v").collect()}
    totals = {r.id: (r.prior_n, r.prior_sum) for r in W.asof_totals(df, df, "k", "t", "t", "v", pieces=7).collect()}
    for k, i, t, _ in rows:
        strict = [v for kk, _, tt, v in rows if kk == k and k and tt < t]
        assert totals[i] == (len(strict), pytest.approx(sum(v or 0 for v in strict)))
        if k is None:
            assert i not in got
            continue
        before = [v for kk, j, tt, v in rows if kk == k and (tt, j) < (t, i)]
        known = [v for v in before if v is not None]
        assert got[i].prior_n == len(before)
        assert got[i].prior_mean == (pytest.approx(sum(known) / len(known)) if known else None)
        mean = sum(known) / len(known) if known else 0
        assert got[i].prior_std == (pytest.approx((sum((v - mean) ** 2 for v in known) / (len(known) - 1)) ** 0.5, abs=1e-6) if len(known) > 1 else None)


def test_percentiles(spark):
    import numpy as np

    rng = random.Random(3)
    values = [rng.choice([1, 2, 2, 7, rng.random() * 9]) for _ in range(101)]
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    shares = [0.0, 0.1, 0.33, 0.5, 0.99, 1.0]
    assert W.percentiles(df, "v", shares) == pytest.approx(list(np.quantile(values, shares)))
    assert W.percentiles(df.limit(0), "v", [0.5]) == [None]


def test_positions_within(spark):
    rows = [("a", 3), ("a", 1), (None, 2), ("b", 5), ("a", 2), (None, 1)]
    got = {(r.k, r.v): (r.position, r.n_rows) for r in W.positions_within(spark.createDataFrame(rows, "k string, v int"), ["k"], [F.col("v")]).collect()}
    assert got == {("a", 1): (0, 3), ("a", 2): (1, 3), ("a", 3): (2, 3), (None, 1): (0, 2), (None, 2): (1, 2), ("b", 5): (0, 1)}


def test_positions_and_running_totals(spark):
    rng = random.Random(5)
    rows = [(i, rng.randrange(10)) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, v int").repartition(9)
    ordered = sorted(rows, key=lambda r: (-r[1], r[0]))
    got, n = W.positions(df, [F.desc("v"), F.col("id")])
    assert n == 500 and [r.id for r in sorted(got.collect(), key=lambda r: r.position)] == [i for i, _ in ordered]
    total, run = 0, {}
    for i, v in ordered:
        total += v
        run[i] = total
    got, totals = W.running_totals(df, [F.desc("v"), F.col("id")], {"v": "v"})
    assert {r.id: r.cum_v for r in got.collect()} == run and totals["v"] == total
    assert W.positions(df.limit(0), [F.col("id")])[1] == 0


# --- contracts, profiles


def test_contracts(spark):
    df = spark.createDataFrame([(1, 0.5), (2, None)], "id int, x double")
    with pytest.raises(C.ContractError, match="Schema mismatch"):
        C.require_columns(df, ["wrong"])
    with pytest.raises(C.ContractError, match="not allowed"):
        C.require_columns(df, ["id"], exact=False)
    with pytest.raises(C.ContractError, match="break a rule"):
        C.require(df, {"x": F.col("x") > 0})
    with pytest.raises(C.ContractError):
        C.require_unique(df.union(df), ["id"])
    with pytest.raises(C.ContractError, match="Missing"):
        C.adapt(df, {"nope": "y"})
    with pytest.raises(C.ContractError, match="Colliding"):
        C.adapt(df, {"id": "x"})
    with pytest.raises(C.ContractError):
        C.require_tiers(["a", "b"], {"one": ["a"], "two": ["a", "b"]})


def test_rating_labels(spark):
    df = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5, None)], "r int")
    label = C.mapped(F.col("r"), {1: 0, 2: 0, 3: None, 4: 1, 5: 1})
    assert [r[0] for r in df.select(label).collect()] == [0, 0, None, 1, 1, None]
    with pytest.raises(Exception, match="outside the domain"):
        spark.createDataFrame([(6,)], "r int").select(label).collect()


def test_first_match_skips_null_rules(spark):
    df = spark.createDataFrame([(1, None), (1, True), (0, True)], "a int, b boolean")
    rules = C.first_match([(F.col("b") & (F.col("a") == 1), {"p": "P0"}), (F.col("a") == 1, {"p": "P1"})], {"p": "P4"})
    assert [r[0] for r in df.select(*rules).collect()] == ["P1", "P0", "P4"]


def test_waterfall_null_rule_leaves_silently(spark):
    df = spark.createDataFrame([(1, 1), (None, 0), (5, 0), (0, None)], "a int, y int")
    got = [tuple(r) for r in P.waterfall(df, [("big", F.col("a") > 3)], F.col("y")).orderBy("step").collect()]
    assert got == [(0, "all rows", 0, 4, 1, 2, 1), (1, "big", 1, 2, 1, 0, 1)]


# --- sources


def test_csv_null_and_leading_zero(spark, tmp_path):
    (tmp_path / "a.csv").write_text('zip,n,text\n01037,,"two\nlines ""x"""\n')
    assert [tuple(r) for r in io.read_csv(spark, str(tmp_path / "a.csv"), "zip string, n double, text string").collect()] == [("01037", None, 'two\nlines "x"')]


def test_tsv_quotes_and_arity(spark, tmp_path):
    (tmp_path / "a.tsv").write_text('1\t"open\n2\tb\n')
    assert [tuple(r) for r in io.read_tsv(spark, str(tmp_path / "a.tsv"), "a int, b string").collect()] == [(1, '"open'), (2, "b")]
    (tmp_path / "b.tsv").write_text("1\t2\t3\n")
    with pytest.raises(Exception, match="expected 2 fields"):
        io.read_tsv_strict(spark, str(tmp_path / "b.tsv"), ["a", "b"]).collect()


def test_jsonl_gz(spark, tmp_path):
    with gzip.open(tmp_path / "a.jsonl.gz", "wt") as f:
        f.write('{"rating": 5.0, "images": [{"u": "x"}]}\n')
    assert io.read_jsonl(spark, str(tmp_path / "a.jsonl.gz"), "rating double, images array<struct<u:string>>").first().rating == 5.0


MAIN, LINK = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def workbook(path, sheets, first, strings=""):
    """A workbook whose sheets (part -> rows) are listed with `first` at the beginning."""
    order = [first, *(n for n in sheets if n != first)]
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{LINK}"><sheets>' + "".join(f'<sheet name="{n}" r:id="id-{n}"/>' for n in order) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="id-{n}" Target="{n if n.startswith("/") else "worksheets/" + n}"/>' for n in sheets) + "</Relationships>")
        if strings:
            z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}">{strings}</sst>')
        for n, rows in sheets.items():
            z.writestr(n.lstrip("/") if n.startswith("/") else f"xl/worksheets/{n}", f'<worksheet xmlns="{MAIN}"><sheetData>{rows}</sheetData></worksheet>')


def test_xlsx_reads_the_first_sheet(spark, tmp_path):
    path = str(tmp_path / "a.xlsx")
    good = '<row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>n</t></is></c></row><row><c r="A2" t="s"><v>1</v></c><c r="C2"><v>7</v></c></row><row/><row><c><v>a</v></c><c><v>b</v></c><c r="AA4"><v>z</v></c></row>'
    other = '<row><c r="A1"><v>wrong</v></c></row>'
    strings = "<si><t>name</t></si><si><r><t>é</t></r><rPh><t>reading</t></rPh><r><t>t</t></r></si>"
    want = [("ét", None, "7"), (None, None, None), ("a", "b", None)]
    for first in ("sheet2.xml", "/other/one.xml"):
        workbook(path, {"sheet1.xml": other, first: good}, first, strings)
        got = io.read_xlsx(spark, path)
        assert got.columns == ["name", "column1", "n"] and [tuple(r) for r in got.collect()] == want
    workbook(path, {"sheet1.xml": ""}, "sheet1.xml")
    assert io.read_xlsx(spark, path).collect() == [] and io.read_xlsx(spark, path).columns == []


def test_publish_loses_nothing_when_a_rename_fails(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "out")
    io.publish(spark.range(3), out)
    rename = io._rename

    def fails(fs, source, target):
        if "staging" in source.toString():
            raise OSError("no")
        rename(fs, source, target)

    monkeypatch.setattr(io, "_rename", fails)
    with pytest.raises(OSError):
        io.publish(spark.range(4), out, force=True)
    assert spark.read.parquet(out).count() == 3
    assert [p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")] == ["out"]


def test_unpack_and_fetch(tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/y.txt", "hello")
    assert io.unpack(tmp_path / "a.zip", tmp_path / "in" / "b") == ["x/y.txt"] and (tmp_path / "in" / "b" / "x" / "y.txt").read_text() == "hello"
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("../y.txt", "out")
    with pytest.raises(C.ContractError):
        io.unpack(tmp_path / "bad.zip", tmp_path / "c")
    url = (tmp_path / "a.zip").as_uri()
    assert io.fetch(url, tmp_path / "copy.zip", io.sha256_of(tmp_path / "a.zip")).read_bytes() == (tmp_path / "a.zip").read_bytes()
    with pytest.raises(C.ContractError):
        io.fetch(url, tmp_path / "wrong.zip", "0")
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.zip", "bad.zip", "copy.zip", "in"]


def test_publish_guards_and_ledger(spark, tmp_path):
    out = str(tmp_path / "out")
    io.publish(spark.range(3), out)
    with pytest.raises(FileExistsError):
        io.publish(spark.range(4), out)
    io.publish(spark.range(4), out, force=True)
    assert spark.read.parquet(out).count() == 4
    with pytest.raises(C.ContractError):
        io.inside(tmp_path, "../x")
    io.once(tmp_path / "ledger", {"a": 1})
    with pytest.raises(FileExistsError):
        io.once(tmp_path / "ledger", {"a": 1})
    with pytest.raises(C.ContractError):
        io.require_hash(tmp_path / "ledger", "0")
    (tmp_path / "e.jsonl").write_text("")
    with pytest.raises(C.ContractError, match="empty"):
        io.validate_raw(tmp_path / "e.jsonl")
    io.write_report(spark.range(2), tmp_path / "r.json")
    assert (tmp_path / "r.json").read_text().startswith("[")
    facts = io.footer_facts(spark.read.parquet(out)).collect()
    assert sum(r.n_rows for r in facts) == 4 and {r.n_columns for r in facts} == {1}


# --- texts


@pytest.mark.parametrize(("given", "want"), [
    ("This Is  GREAT!!!", "this is great[REPEAT_PUNCT]"),
    ("see https://x.y/A @Bob #Deal", "see [URL] [MENTION] deal"),
    ("أحـمـدٌ ​آب", "احمد اب"),
    ("Ça ÉTÉ ؟؟؟", "ça été [REPEAT_PUNCT]"),
    ("", ""), (None, None), (" ​ ", ""),
    ("a..b!!?!!--- ؟؟؟؟", "a..b!!?!![REPEAT_PUNCT] [REPEAT_PUNCT]"),
    ("ÀÉ ΑΒ ДЖ Ⅷ Ⓐ Ａ İ", "àé ΑΒ ДЖ Ⅷ ⓐ ａ i̇"),
    ("$$$ +++ (((", "$$$ +++ [REPEAT_PUNCT]"),
])
def test_contract_text(given, want):
    assert T.contract_text(given) == want


def test_contract_column_and_empty(spark):
    df = spark.createDataFrame([("A b",), (None,), ("​ \n",)], "t string")
    assert [tuple(r) for r in df.select(T.contract_column("t"), T.is_minimal_empty("t")).collect()] == [("a b", False), (None, True), ("", True)]


def test_text_functions(spark):
    df = spark.createDataFrame([("Great buy", "works well"), ("", "x"), (None, "a b a")], "h string, t string")
    assert [r[0] for r in df.select(T.model_text(F.col("h"), F.col("t"))).collect()] == ["Great buy. works well", "x", "a b a"]
    one = spark.createDataFrame([("This Is GREAT!!!", "aaa", "ابجد ok")], "a string, b string, c string")
    got = one.select(T.dedup_text("a"), T.char_ngrams(F.col("b"), 2), T.script_of("c"), T.letters("c", "arabic"), T.letters("c", "latin"), T.ngrams(T.words("a"), 2), T.ngrams(T.words("b"), 2)).first()
    assert tuple(got) == ("this is great", ["aa", "aa"], "mixed", 4, 2, ["This Is", "Is GREAT!!!"], [])
    html = spark.createDataFrame([("<p>a&nbsp;b</p>",)], "t string").select(T.arabic_light("t")).first()[0]
    assert html == "a b"


def test_near_duplicates(spark):
    texts = ["the parcel arrived on time and it was lovely", "the parcel arrived on time and it was lovely!!!", "the parcel arrived on time and it was lovel", "something else", None, "", "!!"]
    got = {r.doc_id: (r.class_id, r.n_links) for r in near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()}
    assert got == {0: (0, 2), 1: (0, 2), 2: (2, 2), 3: (3, 0)}


def test_hash_bucket_and_softmax(spark):
    import hashlib

    ids = [str(i) for i in range(50)]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "i string").select(S.hash_millionth(F.col("i"))).collect()]
    assert got == [int(hashlib.sha256(i.encode()).hexdigest(), 16) % 1_000_000 / 1_000_000 for i in ids]
    p = spark.createDataFrame([([1.0, 3.0, 3.0],)], "z array<double>").select(S.softmax(F.col("z")).alias("p"), S.argmax(F.col("z")).alias("a")).first()
    assert sum(p.p) == pytest.approx(1) and p.a == 1


def test_digests():
    assert S.json_digest({"b": 1, "a": 2}) == S.json_digest({"a": 2, "b": 1}) != S.json_digest({"a": 1, "b": 2})
    assert S.vector_digest([0.1, 0.2]) != S.vector_digest([0.2, 0.1])


# --- metrics, baskets, splits


def test_metrics_by_hand(spark):
    rows = spark.createDataFrame(list(zip("gggg", (0, 1, 0, 1), (0.1, 0.7, 0.2, 0.8))), "g string, y int, s double")
    assert M.average_precision(rows, ["g"]).first().ap == 1 and M.roc_auc(rows, ["g"]).first().auc == 1 and M.roc_auc_global(rows) == 1
    c = rows.agg(*[v.alias(k) for k, v in M.confusion(F.col("y"), F.col("s") >= 0.5).items()]).first()
    assert (c.tn, c.fp, c.fn, c.tp) == (2, 0, 0, 2)
    one_class = rows.where("y = 1")
    assert M.roc_auc(one_class, ["g"]).first().auc is None and M.roc_auc_global(one_class) is None


def test_auc_with_ties_is_pairwise(spark):
    rng = random.Random(8)
    rows = [(rng.randrange(2), rng.randrange(6) / 10) for _ in range(200)]
    wins = [(1.0 if a > b else 0.5 if a == b else 0.0) for y, a in rows if y for z, b in rows if not z]
    df = spark.createDataFrame(rows, "y int, s double")
    assert M.roc_auc(df, []).first().auc == pytest.approx(sum(wins) / len(wins)) == M.roc_auc_global(df)


def test_ranking_metrics(spark):
    listed = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3)], "user_id int, product_id int, rank int")
    truth = spark.createDataFrame([(1, 11), (1, 99), (2, 5)], "user_id int, product_id int")
    got = {r.user_id: r for r in B.ranking_metrics(listed, truth, 5).collect()}
    assert (got[1].precision, got[1].recall, got[1].ap, got[2].recall) == (pytest.approx(1 / 3), 0.5, 0.25, 0.0)


def test_bootstrap_sums_are_poisson(spark):
    rows = spark.range(5000).select("id", (F.col("id") % 4 == 0).cast("int").alias("y"))
    got = {r.replicate: r for r in M.bootstrap_sums(rows, {"y": F.col("y")}, 30, 1, "id").collect()}
    again = {r.replicate: r for r in M.bootstrap_sums(rows.repartition(7), {"y": F.col("y")}, 30, 1, "id").collect()}
    assert got == again and sorted(got) == list(range(1, 31))
    sizes = [r.w for r in got.values()]
    assert all(abs(w - 5000) < 5 * 5000**0.5 for w in sizes) and len(set(sizes)) > 20
    assert 0.5 < statistics.pvariance(sizes) / 5000 < 2 and all(abs(r.y / r.w - 0.25) < 0.03 for r in got.values())
    weights = M.poisson_weights(np.arange(20_000), 3, 1)
    assert abs(weights.mean() - 1) < 0.02 and abs((weights == 0).mean() - math.exp(-1)) < 0.01


def test_bootstrap_auc_by_hand(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(2), rng.choice([0.1, 0.2, 0.5, rng.random()])) for i in range(300)]
    df = spark.createDataFrame(rows, "id bigint, y int, s double")
    got = {r.replicate: r.auc for r in M.bootstrap_auc(df, "s", 5, 3, "id").collect()}
    hashes = {r.id: r.h for r in df.select("id", F.xxhash64("id").alias("h")).collect()}
    weights = M.poisson_weights(np.array([hashes[i] for i, *_ in rows]), 5, 3)
    for k in range(5):
        pos = [(s, w) for (_, y, s), w in zip(rows, weights[:, k]) if y]
        neg = [(s, w) for (_, y, s), w in zip(rows, weights[:, k]) if not y]
        wins = sum(a * b * ((s > t) + (s == t) / 2) for s, a in pos for t, b in neg)
        assert got[k + 1] == pytest.approx(wins / sum(w for _, w in pos) / sum(w for _, w in neg))
    one = M.bootstrap_auc(df.where("y = 1"), "s", 4, 3, "id").collect()
    assert [r.auc for r in one] == [None] * 4  # resamples of one class are rejected


def test_class_summary_by_hand(spark):
    cells = [("a", "a", 5), ("a", "b", 2), ("b", "b", 3), ("c", "a", 1), ("b", "d", 1)]
    got = M.class_summary(spark.createDataFrame(cells, "truth string, guess string, n bigint")).first()
    t, p = {"a": 7, "b": 4, "c": 1, "d": 0}, {"a": 6, "b": 5, "c": 0, "d": 1}
    s, c = 12, 8
    mcc = (c * s - sum(t[k] * p[k] for k in t)) / math.sqrt((s * s - sum(x * x for x in p.values())) * (s * s - sum(x * x for x in t.values())))
    assert (got.accuracy, got.balanced_accuracy, got.mcc) == (pytest.approx(c / s), pytest.approx((5 / 7 + 3 / 4 + 0) / 3), pytest.approx(mcc))
    assert M.class_summary(spark.createDataFrame([("a", "a", 3)], "truth string, guess string, n bigint")).first().mcc == 0


def test_temperature(spark):
    rng = np.random.default_rng(5)
    z = rng.normal(size=(4000, 3)) * 2
    p = np.exp(z / 2.5)
    y = [int(rng.choice(3, p=q / q.sum())) for q in p]
    df = spark.createDataFrame([(list(map(float, a)), b) for a, b in zip(z, y)], "z array<double>, y int")
    assert S.fit_temperature(df, "z", "y") == pytest.approx(2.5, rel=0.1)
    assert S.fit_temperature(df.limit(0), "z", "y") == 1.0


def test_light_stems(spark):
    words = {"والكتاب": "كتاب", "المعلمون": "معلم", "بالمدرسة": "مدرس", "كتابها": "كتاب", "و": "و", "ال": "ال", "books": "books", "وقت": "وقت"}
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert {r.w: r.s for r in df.select("w", T.light_stem(F.col("w")).alias("s")).collect()} == words
    docs = spark.createDataFrame([(1, "والكتاب books"), (2, "والكتاب books"), (3, None), (4, "")], "id int, text string")
    assert {r.id: r.stems for r in T.stem_views(docs).collect()} == {1: "كتاب books", 2: "كتاب books", 3: None, 4: ""}


def test_prepared_rows(spark):
    rows = [(1, "k1", 5), (2, "k1", 5), (3, "k2", 1), (4, "k2", 2), (5, "k3", None), (6, "k3", 3), (7, None, 1), *[(10 + i, f"g{i}", i % 2) for i in range(40)]]
    df = spark.createDataFrame(rows, "row int, key string, label int").withColumn("split", F.lit("old"))
    removed = {r.row_index: r for r in D.prepared_rows(df, "row", "key", "label", D.REMOVE).collect()}
    assert set(removed) == {r[0] for r in rows} - {7}
    assert (removed[2].excluded, removed[2].exclusion_reason, removed[2].split) == (True, D.COPY_REMOVED, None) and not removed[1].excluded
    assert all(removed[i].exclusion_reason == D.CONFLICT_REMOVED and removed[i].split is None for i in (3, 4, 5, 6))
    kept = {r.row_index: r for r in D.prepared_rows(df, "row", "key", "label", D.KEEP).collect()}
    assert all(kept[i].split == "train" and kept[i].flagged and not kept[i].excluded for i in (3, 4, 5, 6))
    for label in (0, 1):
        splits = [removed[10 + i].split for i in range(40) if i % 2 == label]
        assert (splits.count("train"), splits.count("validation"), splits.count("internal_test")) == (14, 3, 3)
    with pytest.raises(C.ContractError):
        D.prepared_rows(df, "row", "key", "label", D.FAIL)
    audit = D.preparation_audit(D.prepared_rows(df, "row", "key", "label", D.KEEP)).first()
    assert (audit.total_input_rows, audit.same_label_duplicate_rows_removed, audit.conflicting_label_groups, audit.conflicting_label_rows_flagged) == (46, 1, 2, 4)


def test_deficit_quotas(spark):
    rng = random.Random(6)
    groups = [(f"p{i}", rng.randrange(0, 4), rng.randrange(0, 9)) for i in range(400)]
    df = spark.createDataFrame(groups, "item string, low bigint, high bigint")
    targets = {"val": (20, 20), "test": (30, 90), "train": (100, 200)}
    four = [tuple(r) for r in D.deficit_quotas(df, targets).collect()]
    five = [tuple(r) for r in D.deficit_quotas(df, targets, {"natural": (10, 30)}).collect()]
    assert [r for r in five if r[1] != "natural"] == four and len({r[0] for r in five}) == len(five)
    for name, (low, high) in (targets | {"natural": (10, 30)}).items():
        assert (sum(r[2] for r in five if r[1] == name), sum(r[3] for r in five if r[1] == name)) == (low, high)
    size = {g: (a, b) for g, a, b in groups}
    assert all(0 < r[2] + r[3] and r[2] <= size[r[0]][0] and r[3] <= size[r[0]][1] for r in five)
    assert list(D.take_by_deficit(iter([("a", 3, 0), ("b", 0, 1)]), {"x": (2, 0), "y": (5, 5)})) == [("a", "y", 3, 0), ("b", "y", 0, 1)]
    short = [tuple(r) for r in D.deficit_quotas(df.limit(3), {"all": (1000, 1000)}).collect()]
    assert len(short) == sum(a + b > 0 for _, a, b in [tuple(r) for r in df.limit(3).collect()])


def test_quota_groups_later_bucket_changes_nothing(spark):
    groups = spark.createDataFrame([(f"i{i}", i % 5 + 1) for i in range(60)], "item string, n int")
    four = {"a": 20, "b": 20, "c": 10}
    one = {r.item: r.bucket for r in quota_groups(groups, [F.col("item")], four).collect()}
    two = {r.item: r.bucket for r in quota_groups(groups, [F.col("item")], four | {"e": 15}).collect()}
    assert all(two[i] == b for i, b in one.items() if b) and "e" in two.values()


# --- streams


def test_events_are_handled_once(spark, tmp_path):
    source, log = str(tmp_path / "in.parquet"), str(tmp_path / "log")
    spark.createDataFrame([("a", T0), ("a", T0 + DAY), ("b", T0), (None, T0)], "order_id string, t timestamp").write.parquet(source)
    for _ in range(2):
        done = E.handle_once(E.file_stream(spark, source), "order_id", ["t"], log, str(tmp_path / "offsets"))
        assert sorted(map(tuple, done.collect())) == [("a", T0), ("b", T0)]
        spark.createDataFrame([("a", T0 + 2 * DAY), ("a", T0 - DAY)], "order_id string, t timestamp").write.mode("append").parquet(source)
    spark.createDataFrame([("c", T0 + DAY), ("c", T0), ("b", T0)], "order_id string, t timestamp").write.mode("append").parquet(source)
    done = E.handle_once(E.file_stream(spark, source), "order_id", ["t"], log, str(tmp_path / "offsets"))
    assert sorted(map(tuple, done.collect())) == [("a", T0), ("b", T0), ("c", T0)]


def test_retries():
    waits = (0.0, 0.0)
    for answers, want, n in (([200], 200, 1), ([500, 503, 200], 200, 3), ([500] * 5, 500, 3), ([422, 200], 422, 1), ([404, 200], 404, 1), ([OSError("x"), 200], 200, 2), ([OSError("x")] * 3, 0, 3)):
        asked = []

        def call(request, timeout):
            asked.append(timeout)
            got = answers[len(asked) - 1]
            if isinstance(got, Exception):
                raise got
            return got, request

        assert E.call_with_retries(call, "r", waits)[0] == want and asked == [5.0] * n


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from cartloom.session import shared_folder

    conf = SimpleNamespace(get=lambda key, default: default, set=lambda key, value: None)
    with pytest.raises(RuntimeError):
        shared_folder(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077")))
    assert shared_folder(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="local[2]"))).startswith("file://")


def test_plans_push_down_and_prune(spark):
    from compare import DATA

    from cartloom.plans import catalogue

    df = catalogue.QUERIES["tk12_13_earliest"](spark, DATA)
    assert "props" not in df._jdf.queryExecution().executedPlan().toString()
    n = df.select(F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))).first()[0]
    assert n > 0
