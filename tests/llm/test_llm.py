"""Operators of problems 1, 5, 7, 8, 9 and 10 against plain Python, with awkward rows; and their queries against SQL."""

import itertools
import os
import random
import sys
from collections import Counter, defaultdict

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import numpy as np
import pytest
from compare import DATA, connect, same
from pyspark.sql import functions as F

from cartloom.llm import langid, mixing, overlap, packing, queries, tokens
from cartloom.llm.components import components, tie_edges, with_component
from cartloom.llm.pairs import merged_runs, sorted_runs, together
from cartloom.llm.splits import SPLITS, anneal, split_groups

HAVE_TOKENIZERS = os.path.isdir(tokens.TOKENIZERS)


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, name):
    df = queries.QUERIES[name](spark, DATA)
    assert len(set(df.columns)) == len(df.columns)
    if name in queries.SQL:
        same(df, con, queries.SQL[name])
    else:
        df.collect()


# --- problem 1: components and splits


def union_find(rows):
    root = {i: i for i, *_ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for at in range(1, len(rows[0])):
        first = {}
        for r in rows:
            if r[at] is not None:
                a, b = find(first.setdefault(r[at], r[0])), find(r[0])
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i, *_ in rows}


@pytest.mark.parametrize("seed", [1, 2])
def test_components_random(spark, seed):
    rng = random.Random(seed)
    key = lambda n, p: None if rng.random() < p else rng.randrange(n)
    rows = [(i, key(150, 0.4), key(200, 0.4), "hot" if rng.random() < 0.2 else None) for i in range(300)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "id int, a int, b int, c string, component int")
    got = {r.id: r.component for r in with_component(df, "id", ["a", "b", "c"]).collect()}
    assert got == union_find(rows)


def test_components_long_chain_and_none(spark):
    chain = spark.createDataFrame([(i + 1, i) for i in range(200)], "src bigint, dst bigint")
    assert {r.component for r in components(chain).collect()} == {0}
    assert components(chain.limit(0)).collect() == []
    keys = spark.createDataFrame([(1, "k"), (2, "k"), (2, "k"), (3, None), (None, "k")], "node bigint, key string")
    assert [tuple(r) for r in tie_edges(keys).collect()] == [(2, 1)]


def test_anneal_improves_and_keeps_whole_groups():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 40, 300)
    weights = np.stack([sizes, rng.binomial(sizes, 0.3)], axis=1).astype(float)
    target = np.outer([0.7, 0.15, 0.15], weights.sum(axis=0))
    start = rng.integers(0, 3, 300)
    end, cost = anneal(weights, start, target, 1)
    off = lambda s: np.abs(np.array([weights[s == k].sum(axis=0) for k in range(3)]) - target).sum()
    assert off(end) < 0.02 * weights.sum() < off(start)
    again, same = anneal(weights, start, target, 1)
    assert (again == end).all() and same == cost
    assert anneal(weights[:0], start[:0], target, 1)[0].tolist() == []


def test_split_groups_with_a_giant(spark):
    rows = [("giant", i % 3) for i in range(600)] + [(f"c{i % 400}", i % 2) for i in range(1200)] + [("nulls", None)] * 3
    df = spark.createDataFrame(rows, "component string, label int")
    got = {r.component: r.split for r in split_groups(df, "label", [0, 1, 2]).collect()}
    assert set(got) == {c for c, _ in rows} and set(got.values()) <= set(SPLITS)
    size = Counter(got[c] for c, _ in rows)
    assert abs(size["train"] / len(rows) - 0.7) < 0.02 and abs(size["test"] / len(rows) - 0.15) < 0.02
    assert split_groups(df.limit(0), "label", [0]).collect() == []


def test_split_groups_from_an_earlier_run(spark):
    rng = random.Random(12)
    rows = [(f"c{i % 500}", rng.choice(SPLITS) if i % 500 < 20 else SPLITS[0 if i % 10 < 7 else 1 if i % 20 < 17 else 2]) for i in range(2000)] + [(None, "train"), ("odd", "elsewhere"), ("none", None), ("half", None), ("half", "train")]
    got = {r.component: r for r in split_groups(spark.createDataFrame(rows, "component string, old string"), None, [], before="old").collect()}
    had = defaultdict(set)
    for c, s in rows:
        had[c].add(s)
    assert set(got) == set(had) - {None} and {c for c, r in got.items() if r.mixed} == {c for c, s in had.items() if c and len(s - {None}) > 1}
    size = Counter(got[c].split for c, _ in rows if c)
    assert abs(size["train"] / len(rows) - 0.7) < 0.01 and abs(size["test"] / len(rows) - 0.15) < 0.01


def test_more_blocks_than_one(spark):
    df = spark.range(9000).select((F.col("id") % 6000).alias("component"), (F.col("id") % 5).alias("label"))
    got = split_groups(df, "label", [0, 1, 2, 3, 4]).join(df, "component").groupBy("split").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("label") == i).alias(f"l{i}") for i in range(5)]).collect()
    for r in got:
        share = dict(zip(SPLITS, (0.7, 0.15, 0.15)))[r.split]
        assert abs(r.n / 9000 - share) < 0.002 and all(abs(r[f"l{i}"] / 1800 - share) < 0.01 for i in range(5))


# --- problem 5


def test_pairs_random(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(60), rng.choice([None, -3, 7, 2**31 - 1, *range(8)])) for _ in range(600)] + [(None, 1), (999, None)]
    baskets = defaultdict(set)
    for b, i in rows:
        if b is not None:
            baskets[b] |= {i} - {None}
    want = Counter(p for s in baskets.values() for p in itertools.combinations(sorted(s), 2))
    df = spark.createDataFrame(rows, "n_both int, item int")
    got = {(r.a, r.b): r for r in together(df, "n_both", "item").collect()}
    assert {k: r.n_both for k, r in got.items()} == want
    n = len(baskets)
    for (a, b), r in got.items():
        na, nb = (sum(x in s for s in baskets.values()) for x in (a, b))
        assert (r.n_a, r.n_b, r.n_baskets) == (na, nb, n) and r.lift == pytest.approx(r.n_both * n / na / nb)
        assert r.odds_ratio == pytest.approx((r.n_both + 0.5) * (n - na - nb + r.n_both + 0.5) / ((na - r.n_both + 0.5) * (nb - r.n_both + 0.5)))
    often = {(r.a, r.b) for r in together(df, "n_both", "item", min_both=20).collect()}
    assert often == {k for k, c in want.items() if c >= 20}


def test_pairs_edges(spark):
    assert together(spark.createDataFrame([], "o int, p int"), "o", "p").collect() == []
    assert together(spark.createDataFrame([(1, None), (1, 5), (1, 5)], "o int, p int"), "o", "p").collect() == []
    with pytest.raises(TypeError):
        together(spark.createDataFrame([(1, "x")], "o int, p string"), "o", "p")


def test_runs_over_batches():
    import pyarrow as pa

    codes = np.random.default_rng(1).integers(0, 50, 5000)
    batches = [pa.RecordBatch.from_arrays([pa.array(c)], ["code"]) for c in np.array_split(codes, 7)]
    runs = [b for b in sorted_runs(iter(batches))]
    both = sorted((c, n) for b in runs for c, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
    split = [pa.RecordBatch.from_arrays([pa.array([c]), pa.array([n])], ["code", "n"]) for c, n in both + [(50, 1), (50, 2)]]
    out = {c: n for b in merged_runs(iter(split)) for c, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist())}
    assert out == Counter(codes.tolist()) | {50: 3}


# --- problem 7


def shingles(text):
    w = overlap.plain_words(text)
    return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()


def near(a, b):
    x, y = shingles(a), shingles(b)
    return bool(x) and len(x & y) >= 0.6 * len(x | y)


def test_plain_words():
    assert overlap.plain_words("<p>Ça VA, né​ver&nbsp;&lt;b&gt;x</p> كـتابٌ") == ["ca", "va", "never", "x", "كتاب"]
    assert overlap.plain_words(None) == overlap.plain_words(" .!? ") == []


@pytest.mark.parametrize("seed", [1, 2])
def test_overlaps_random(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    rows, texts = [], []
    for i in range(150):
        if texts and rng.random() < 0.6:
            words = rng.choice(texts).split()
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                at = rng.randrange(len(words))
                words[at : at + rng.choice([0, 1])] = rng.choice([[], [rng.choice(vocabulary)]])
                words = words or ["w0"]
            text = " ".join(words)
        else:
            text = " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 3, 8, 25, 60])))
        texts.append(text)
        rows.append((i, rng.choice([text, text.upper() + "!"]), rng.random() < 0.6, rng.random() < 0.5))
    rows += [(900, None, True, False), (901, "", False, True), (902, "?!", True, True)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, train boolean, held boolean").withColumn("words", F.lit(1))
    got = {tuple(sorted(r)) for r in overlap.cross_split_pairs(df).collect()}
    want = {tuple(sorted((a[0], b[0]))) for a in rows for b in rows if a[0] != b[0] and a[2] and b[3] and near(a[1], b[1])}
    assert got == want and want


def test_overlaps_empty_and_long(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string, train boolean, held boolean")
    assert overlap.cross_split_pairs(none).collect() == [] and overlap.coverage(none).collect() == []
    long = " ".join(f"w{i % 977}{i % 13}" for i in range(60_000))
    rows = [(1, long, True, False), (2, long + " end", False, True), (3, "x" * 200_000, False, True)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, train boolean, held boolean")
    assert [tuple(r) for r in overlap.cross_split_pairs(df).collect()] == [(1, 2)]


def test_coverage(spark):
    base = "a b c d e f g h i j k l m n o p"
    rows = [(1, base, True, False), (2, "x y " + base[:19] + " z z z", False, True), (3, "nothing of it", False, True), (4, base, False, True), (5, "few words", True, True)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, train boolean, held boolean")
    assert {r.doc_id: (r.n_words, r.covered) for r in overlap.coverage(df).collect()} == {2: (15, 10), 3: (3, 0), 4: (16, 16), 5: (2, 2)}


def test_interval_over_borders(spark):
    shared = "a b c d e f g h i j"
    rows = [(i, f"x{i} {shared} y{i}" if i % 7 else f"only{i} here{i}", i % 3 == 0, i % 3 != 0) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, train boolean, held boolean")
    reps = overlap.classes(overlap.encoded(df))
    for depth in (3, 8):
        got = overlap.suffix_array(reps, depth)[0].collect()
        members = [r for r in rows if r[0] % 7]
        assert {(r.n_train, r.n_held) for r in got} == {(sum(r[2] for r in members), sum(r[3] for r in members))}
        assert len(got) == len(members) * (10 - depth + 1) and len({r.span for r in got}) == 10 - depth + 1
    assert {r.covered for r in overlap.coverage(df).collect()} == {0, 10}


def test_report_counts_equal_the_pairs(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choices("abcdefgh", k=12)) for _ in range(12)]
    rows = [(i, rng.choice(texts), rng.random() < 0.6, rng.random() < 0.5) for i in range(120)]
    found = overlap.Overlaps(spark.createDataFrame(rows, "doc_id bigint, text string, train boolean, held boolean"))
    assert {r.doc_held: r.n for r in found.counts().collect()} == Counter(r.doc_held for r in found.pairs().collect())


def test_codes_of_several_texts():
    texts = [None, "", "a b", "a\x1ec <b>&lt;i&gt;d", "?!", "é"]
    codes, starts = overlap.text_codes(texts)
    assert np.diff(starts).tolist() == [0, 0, 2, 3, 0, 1] == [len(overlap.plain_words(t)) for t in texts]
    alone = [overlap.text_codes([t])[0].tolist() for t in texts]
    assert sum(alone, []) == codes.tolist()
    assert overlap.text_codes([None])[1].tolist() == [0, 0] and overlap.plain_words("<" + "b " * 5000 + ">x") == ["x"]


# --- problem 8


def test_hilbert_neighbours_touch():
    side = 8
    grid = np.array(list(itertools.product(range(side), repeat=3)))
    keys = packing.hilbert(grid, 3)
    assert sorted(keys) == list(range(side**3))
    walk = grid[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_pack(spark):
    rng = random.Random(8)
    items = [(i, rng.choice([None, 0, 1, 2048, 2049, 7000, *[rng.randrange(1, 900) for _ in range(30)]]), rng.randrange(1 << 30)) for i in range(3000)]
    packed = packing.pack(spark.createDataFrame(items, "doc_id bigint, tokens bigint, curve bigint"), parts=3)
    rows = packed.collect()
    full, pieces = Counter(), defaultdict(list)
    for r in rows:
        full[r.container] += r.tokens
        pieces[r.doc_id].append((r.piece, r.first_token, r.tokens))
    assert max(full.values()) <= 2048
    size = {i: t for i, t, _ in items if t}
    assert set(pieces) == set(size)
    for doc, parts in pieces.items():
        parts.sort()
        assert sum(p[2] for p in parts) == size[doc] and len(parts) == -(-size[doc] // 2048)
        assert [p[1] for p in parts] == [2048 * k for k in range(len(parts))]
    report = packing.fill_report(packed).first()
    assert report.fill > 0.99 and report.fullest <= 2048 and report.tokens == sum(size.values()) and report.widest <= packing.LOOK
    assert packing.pack(packed.select("doc_id", "tokens", F.lit(0).alias("curve")).limit(0)).collect() == []


@pytest.mark.parametrize("look", [1, 7, 256])
def test_fill_keeps_to_the_curve(look):
    rng = np.random.default_rng(look)
    sizes = np.minimum(rng.geometric(0.01, 5000), 1000).tolist()
    boxes = list(packing.fill_along(iter(sizes), 1000, look))
    assert sorted(p for b in boxes for p in b) == list(range(5000))
    assert max(sum(sizes[p] for p in b) for b in boxes) <= 1000 and max(max(b) - min(b) for b in boxes) < look
    firsts = [min(b) for b in boxes]
    assert firsts == sorted(firsts)
    if look == 256:
        assert sum(sizes) / (1000 * len(boxes)) > 0.995
    assert list(packing.fill_along(iter([]), 10)) == [] and list(packing.fill_along(iter([10, 10]), 10)) == [[0], [1]]


@pytest.mark.skipif(not HAVE_TOKENIZERS, reason="no tokenizer files")
def test_tokens(spark):
    enc = tokens.encoder()
    for text in ("Olá, mundo! ٣ " * 3000, "a" * 50_000, "<|endoftext|>"):
        assert enc.decode(tokens.encode(text)) == text
    for text in ("abcdefghijk7x" * 5000, "the parcel arrived " * 20_000, "a\n" * 30_000, " \n" * 400 + "x" + " " * 999 + "y" + " " * 1000 + "z" + "\t" * 1500, "\x1c" * 2000 + " x"):
        assert tokens.encode(text) == enc.encode_ordinary(text)
    assert len(tokens.encode(" " * 1_000_000 + "word")) > 900_000  # more white space than the pattern can match
    df = spark.createDataFrame([(1, "one two"), (2, None), (3, ""), (4, "b " * 40_000)], "doc_id bigint, text string")
    got = {r.doc_id: r.tokens for r in packing.sized(df).collect()}
    assert got[2] == got[3] == 0 and got[1] == 2 and got[4] >= 40_000


# --- problem 9


def test_mix_meets_targets(spark):
    rng = random.Random(9)
    items = [(i, rng.choice(["a", "a", "a", "b", "c", None]), rng.choice([None, 0, *range(5, 400)])) for i in range(6000)]
    df = spark.createDataFrame(items, "doc_id bigint, source string, tokens bigint").withColumn("wanted", F.lit(0))
    targets = spark.createDataFrame([("a", 0.2, 1), ("b", 0.35, 6), ("c", 0.4, 1), ("absent", 0.05, 3), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    drawn = mixing.draw(df, targets)
    cap = {"a": 1, "b": 6, "c": 1}
    assert all(0 < r.uses <= cap[r.source] for r in drawn.collect())
    report = {r.source: r for r in mixing.shares(drawn, targets).collect()}
    assert report["a"].tokens_met and report["b"].tokens_met and not report["c"].tokens_met and not report["absent"].tokens_met
    assert [report[x].limit for x in ("a", "b", "c", "absent")] == [None, None, "max_repeats", "no documents"]
    assert not report["a"].share_met and not report["c"].share_met  # what c and absent lack makes the others' shares larger
    assert report["c"].n_documents == sum(1 for _, s, t in items if s == "c" and t)
    rows = mixing.mixed(drawn).collect()
    assert len(rows) == sum(r.n_uses for r in report.values())
    assert drawn.orderBy("doc_id").collect() == mixing.draw(df.repartition(7), targets).orderBy("doc_id").collect()
    assert mixing.draw(df.limit(0), targets).collect() == [] and mixing.draw(df, targets.limit(0)).collect() == []


@pytest.mark.parametrize("n", [3, 40, 400])
def test_small_sources_are_met_to_half_a_document(spark, n):
    rng = random.Random(n)
    items = [(i, "s", rng.randrange(1, 3000)) for i in range(n)]
    df = spark.createDataFrame(items, "doc_id bigint, source string, tokens bigint")
    whole = sum(t for *_, t in items)
    for cap, share in ((1, 0.3), (6, 2.2), (900, 750.0)):
        targets = spark.createDataFrame([("s", 1.0, cap)], "source string, target_share double, max_repeats int")
        drawn = mixing.draw(df, targets, total=int(whole * share)).collect()
        # documents come one at a time as the mean rises, so the nearest mean is off by half of the longest at most
        assert abs(sum(r.tokens * r.uses for r in drawn) - int(whole * share)) <= max(t for *_, t in items) / 2 * (1 if cap < 900 else 2) + 1


def test_poisson():
    cdf = mixing.poisson_cdf(2.0, 30)
    assert cdf[0] == pytest.approx(np.exp(-2)) and cdf[-1] == pytest.approx(1)
    assert mixing.poisson_cdf(5000.0, 5001)[-1] == pytest.approx(0.5, abs=0.01) and mixing.poisson_cdf(0.0, 3).tolist() == [1, 1, 1]


# --- problem 10

SAMPLES = {
    "en": ["The parcel arrived on time and nobody told us why.", "My sister had warned me about this kettle before."],
    "pt": ["A encomenda chegou antes do prazo e ninguém soube dizer por quê.", "Minha irmã tinha dito isso sobre esta chaleira antes."],
    "es": ["El paquete llegó antes de tiempo y nadie supo decir por qué.", "Mi hermana me había dicho eso de esta tetera antes."],
    "fr": ["Le colis est arrivé à l'heure et personne ne sait pourquoi.", "Ma soeur m'avait prévenue pour cette bouilloire."],
    "de": ["Das Paket kam rechtzeitig an und niemand weiß warum.", "Meine Schwester hat mich vor dem Kessel gewarnt."],
    "ar": ["وصل الطرد قبل الموعد ولا أحد يعرف السبب.", "قالت لي أختي ذلك عن هذه الغلاية من قبل."],
}


@pytest.fixture(scope="module")
def model():
    return langid.train([(lang, text) for lang, texts in SAMPLES.items() for text in texts])


def test_segments(model):
    for lang, texts in SAMPLES.items():
        assert [s[2] for s in model.segments([texts[0]])[0]] == [lang]
    mixed = f"{SAMPLES['en'][0]} {SAMPLES['en'][1]} “{SAMPLES['de'][0]}” Petor TS-12 9!"
    assert {s[2] for s in model.segments([mixed])[0]} == {"en", "de"}
    spans = model.segments([mixed])[0]
    assert all(a[1] <= b[0] for a, b in itertools.pairwise(spans)) and "Paket" in mixed[spans[1][0] : spans[1][1]]
    for nothing in (None, "", " ", "12 × 5/5 #33", "Petor 97918"):
        assert [s[2] for s in model.segments([nothing])[0]] == ["und"]


def test_awkward_texts(model):
    for text in ("x" * 300_000, "<" * 100_000, " " * 300_000 + "the parcel", "a1" * 100_000, "\n" * 100_000, "the parcel arrived on time. " * 20_000, '"' * 50_000):
        assert model.segments([text])[0]
    assert langid.train([]).segments(["the parcel"])[0][0][2:] == ("und", 0.0)


def test_a_batch_is_judged_as_its_texts_alone(model):
    rng = random.Random(10)
    texts = [None, "", "12", *[" ".join(rng.choice(rng.choice(list(SAMPLES.values()))) for _ in range(rng.randrange(1, 6))) for _ in range(60)]]
    texts.insert(7, " ".join(SAMPLES["de"] * 3000))  # n-grams of one text over several slices
    together = model.segments(texts)
    assert together == [model.segments([t])[0] for t in texts] and {x[2] for x in together[7]} == {"de"}


def test_out_of_place_distance_by_hand(model):
    sentence = "der kessel kam und der kessel ging"
    counts = Counter(g for w in sentence.split() for g in langid.grams(w))
    known = {g: n for g, n in counts.items() if g in model.index}
    place = {g: sum(m > n for m in known.values()) + (sum(m == n for m in known.values()) - 1) / 2 for g, n in known.items()}
    others = sum(n for g, n in counts.items() if g not in model.index)
    got, letters = model.distances([sentence, "Ωμέγα", "x7"])
    for k, language in enumerate(model.languages):
        ranks = {g: i for i, g in enumerate(model.profiles[language])}
        want = (sum(abs(ranks.get(g, langid.PROFILE) - p) for g, p in place.items()) + others * langid.PROFILE) / (len(known) + others)
        assert got[0, k] == pytest.approx(want, rel=1e-4)
    assert letters.tolist() == [28, 0, 0]


def test_short_sentences_are_judged(spark):
    docs = spark.read.parquet(f"{DATA.replace('sf0.001', 'sf0.01')}/documents.parquet")
    trained = langid.train(langid.training_sample(docs, 200))
    assert {s[2] for s in trained.segments(["The parcel arrived on time. لماذا؟ My sister had warned me about it."])[0]} == {"en", "ar"}
    assert {s[2] for s in trained.segments(["The parcel arrived on time. Ok. My sister had warned me about it."])[0]} == {"en"}


def test_names_of_any_shape_are_no_evidence(spark):
    docs = spark.read.parquet(f"{DATA.replace('sf0.001', 'sf0.01')}/documents.parquet")
    sample = langid.training_sample(docs, 200)
    trained = langid.train(sample)
    rng = random.Random(11)
    part = lambda: "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(rng.randrange(2, 5)))
    shapes = [lambda: part().title(), lambda: f"{part().title()}-{part().title()}", lambda: f"{part().title()} {part().title()}", lambda: f"«{part().title()}»", lambda: f"{part().title()}, {part().title()}"]
    same, n = 0, 0
    for _, text in sample[:400]:
        words = text.split(" ")
        at = rng.randrange(len(words) + 1)
        told = {s[2] for s in trained.segments([text])[0]}
        named = " ".join([*words[:at], rng.choice(shapes)(), *words[at:]])
        same += {s[2] for s in trained.segments([named])[0]} == told
        n += 1
    assert same >= 0.97 * n


def test_labels(spark):
    labels = ["pt-BR", "por", "Portuguese", "EN", " en_GB ", "deu", "UND", "xx", "", None, "unknown"]
    df = spark.createDataFrame([(x,) for x in labels], "lang string")
    assert [r[0] for r in df.select(langid.label_language("lang")).collect()] == ["pt", "pt", "pt", "en", "en", "de", "und", None, None, None, None]


def test_mislabelled(spark, model):
    rows = [(1, SAMPLES["pt"][0], "pt-BR"), (2, SAMPLES["pt"][0], "es"), (3, SAMPLES["fr"][0] + " " + SAMPLES["ar"][0], "fr"), (4, "12 34", "und"), (5, "12 34", "en"), (6, None, None), (7, SAMPLES["de"][1], None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("segment", F.lit(1))
    got = {tuple(r) for r in langid.mislabelled(docs, langid.language_segments(docs, model)).collect()}
    assert got == {(2, "pt"), (3, "fr"), (3, "ar"), (5, "und"), (6, "und"), (7, "de")}
    assert langid.language_segments(docs.limit(0)).collect() == []


def test_held_out_accuracy(spark):
    """Profiles trained on the sample tell the labels of the other documents (the labels are partly wrong themselves)."""
    docs = spark.read.parquet(f"{DATA.replace('sf0.001', 'sf0.01')}/documents.parquet")
    trained = langid.train(langid.training_sample(docs, 40))
    held = [(r.label, r.text) for r in docs.select(langid.label_language("lang").alias("label"), "text").where("label is not null and label <> 'und' and text is not null").collect()]
    told = [(label, {s[2] for s in trained.segments([text])[0]}) for label, text in held]
    single = [(label, found) for label, found in told if len(found) == 1]
    assert sum(found == {label} for label, found in single) / len(single) > 0.9
