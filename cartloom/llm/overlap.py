"""Same or near-same records across splits.

Method: a suffix array over the concatenated normalized texts. Texts are reduced to one representative per class of equal
texts; their suffixes (of at least `depth` words) are range-partitioned and sorted by their first `depth` words, and each
suffix is compared with the one before it. A stretch of neighbours whose common prefixes all have `depth` words is an
interval: a span of words that all its members share. An interval cut by a partition's border is put together again from
the pieces' totals, so one that holds a third of all suffixes is spread over many tasks. The interval says how many
suffixes of each side it has; one with a single side is dropped. A longer common span is a row of overlapping intervals
one word apart, so comparing `depth` words loses none of its length.

Near-same pairs (near_classes) come from the members of cross-split intervals of SPAN words. Only some of a text's
intervals have to be looked at, and this loses no pair: of two texts with a share s of their SPAN-word runs in common,
each has at least s of its own runs in the other, so of a text's intervals, put in one order for all texts (fewest
members first), k of the first (their number - ceil(s x all its runs) + k) are shared, for any k up to ceil(s x all its
runs); a candidate has to share HITS intervals (fewer where a text is too short). An exact comparison of the runs follows.
Coverage merges the intervals' spans per held-out record.
"""

from __future__ import annotations

import hashlib
import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartloom.session import cut, discard, shuffle_width

SPAN = 3
SHARE = 0.6
#: Intervals that a pair must share.
HITS = 3
#: Texts handled at once by a task (memory only).
TEXTS = 512

_TAG = re.compile(r"<[^<>]*>")
_DROP = {"Mn", "Me", "Cf", "Mc"}
_WORD = re.compile(r"[^\W_]+")
_WORD_OR_END = re.compile(r"[^\W_]+|\x1e")


class _Folds(dict):
    """Code point -> what is left of it without accents, marks, stretch signs and invisible characters; filled as needed."""

    def __missing__(self, point: int) -> str:
        out = self[point] = "".join(c for c in unicodedata.normalize("NFKD", chr(point)) if c != "ـ" and unicodedata.category(c) not in _DROP)
        return out


FOLDS = _Folds()


def _unmarked(text: str | None) -> str:
    """A text without tags and entities; "" for null."""
    if not text:
        return ""
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
        if "<" in text:
            text = _TAG.sub(" ", text)
    return text


def _folded(text: str) -> str:
    return (text if text.isascii() else text.translate(FOLDS)).casefold()


def plain_words(text: str | None) -> list[str]:
    """The words of a text without case, accents and other marks, stretch signs, punctuation, markup, invisible characters."""
    return _WORD.findall(_folded(_unmarked(text)))


def text_codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit codes of all words of the texts, one after the other, and where each text's begin (one place more than texts).

    All texts are folded and parted into words in one go, and every different word is hashed once.
    """
    whole = _folded("\x1e".join(_unmarked(t).replace("\x1e", " ") for t in texts))
    found = _WORD_OR_END.findall(whole)
    if not found:
        return np.empty(0, dtype=np.int64), np.zeros(len(texts) + 1, dtype=np.int64)
    numbers, different = pd.factorize(np.array(found, dtype=object))
    codes = np.array([xxhash.xxh64_intdigest(w) for w in different], dtype=np.uint64).view(np.int64)[numbers]
    end = different == "\x1e"
    is_end = end[numbers]
    starts = np.r_[0, np.flatnonzero(is_end) - np.arange(len(texts) - 1), len(codes) - len(texts) + 1]
    return codes[~is_end], starts


def run_hashes(codes: np.ndarray, span: int) -> np.ndarray:
    """A 64-bit hash of each run of `span` words; a shorter text is one run."""
    if not len(codes):
        return np.empty(0, dtype=np.int64)
    span_now = min(span, len(codes))
    with np.errstate(over="ignore"):
        h = np.full(len(codes) - span_now + 1, span_now if span_now < span else 0, dtype=np.uint64)
        for i in range(span_now):
            h = (h ^ codes[i : len(codes) - span_now + 1 + i].view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return h.view(np.int64)


def _fixed_binary(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as an Arrow binary array."""
    rows = np.ascontiguousarray(rows)
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows)])


def _words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and starts of an array<bigint> column."""
    starts = column.offsets.to_numpy()
    return column.values.to_numpy()[starts[0] : starts[-1]], starts - starts[0]


def encoded(docs: DataFrame) -> DataFrame:
    """(doc_id, train, held, text) -> (doc_id, train, held, words, same_as): word codes, and a digest of them; texts without words are left out."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(at, TEXTS)
                codes, starts = text_codes(batch.column("text").to_pylist())
                raw = codes.tobytes()
                same = [hashlib.md5(raw[8 * a : 8 * b]).digest() for a, b in zip(starts, starts[1:])]
                words = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(codes))
                out = pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "train", "held")], words, pa.array(same, pa.binary())], ["doc_id", "train", "held", "words", "same_as"])
                yield out.filter(pa.array(np.diff(starts) > 0))

    return docs.select("doc_id", "train", "held", "text").mapInArrow(encode, "doc_id bigint, train boolean, held boolean, words array<bigint>, same_as binary")


def classes(texts: DataFrame) -> DataFrame:
    """(rep, train, held, n_train, n_held, words): one row per class of equal texts; rep is the smallest doc_id, train and held say
    which sides have it, n_train and n_held how many documents of each."""
    marks = texts.groupBy("same_as").agg(F.min("doc_id").alias("rep"), F.count_if("train").alias("n_train"), F.count_if("held").alias("n_held"))
    marks = marks.select("rep", (F.col("n_train") > 0).alias("train"), (F.col("n_held") > 0).alias("held"), "n_train", "n_held")
    return texts.select(F.col("doc_id").alias("rep"), "words").join(marks, "rep")


def suffixes(reps: DataFrame, depth: int, places: bool) -> DataFrame:
    """(prefix, rep, mark[, at]): the suffixes of at least `depth` words, one row for those of a text that begin alike.

    prefix: the first `depth` words, 4 bytes of each code; mark = different prefixes of the text x 4 + held x 2 + train;
    at: where the suffixes begin. Texts of fewer words have none.
    """

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for cut_at in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(cut_at, TEXTS)
                codes, starts = _words_of(batch.column("words"))
                doc = np.repeat(np.arange(batch.num_rows), np.diff(starts))
                begin = np.flatnonzero(np.arange(len(codes)) + depth <= starts[doc + 1])
                if not len(begin):
                    continue
                heads = run_hashes(codes, depth)[begin]
                order = np.lexsort((heads, doc[begin]))
                d, h = doc[begin][order], heads[order]
                first = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (h[1:] != h[:-1])])
                d, lead = d[first], begin[order[first]]
                n = np.bincount(d, minlength=batch.num_rows)
                side = batch.column("train").to_numpy(zero_copy_only=False) * 1 + batch.column("held").to_numpy(zero_copy_only=False) * 2
                short = (codes.view(np.uint64) >> np.uint64(32)).astype(">u4")
                prefix = np.lib.stride_tricks.sliding_window_view(short, depth)[lead]
                columns = [_fixed_binary(np.ascontiguousarray(prefix).view(np.uint8)), pa.array(batch.column("rep").to_numpy()[d]), pa.array(n[d] * 4 + side[d], pa.int64())]
                if places:
                    at = begin[order] - starts[doc[begin][order]]
                    columns.append(pa.ListArray.from_arrays(pa.array(np.r_[first, len(at)], pa.int32()), pa.array(at, pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, ["prefix", "rep", "mark", "at"][: len(columns)])

    schema = "prefix binary, rep bigint, mark bigint" + (", at array<int>" if places else "")
    return reps.where(F.size("words") >= depth).select("rep", "train", "held", "words").mapInArrow(explode, schema)


def common_prefix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many leading words rows of a and b have in common."""
    return np.logical_and.accumulate(a == b, axis=1).sum(axis=1)


def suffix_array(reps: DataFrame, depth: int, places: bool = False) -> tuple[DataFrame, DataFrame]:
    """(span, rep, mark[, at], n_train, n_held): the suffixes in cross-split intervals, with the interval's number and its members of each side;
    and the kept table behind it, to be discarded after use.

    A task reads its stretch of the sorted array and compares each suffix with the one before; where they have fewer than
    `depth` words in common an interval ends. It holds the interval it is in, at most its own stretch of the array. The first
    and last interval of a stretch may go on in the neighbours' stretches: their counts are added up afterwards, by at most
    two rows per task.
    """
    rows = suffixes(reps, depth, places)
    ordered = rows.repartitionByRange(shuffle_width(reps.sparkSession), "prefix", "rep").sortWithinPartitions("prefix")
    names = ["span", "rep", "mark", *(["at"] if places else []), "n_train", "n_held", "border"]

    def emit(words: np.ndarray, rest: pa.Table, starts: np.ndarray, border: int) -> Iterator[pa.RecordBatch]:
        """The rows of intervals beginning at `starts`; border: -1, or the number of the task whose border they touch."""
        mark = rest.column("mark").to_numpy()
        train, held = (np.add.reduceat((mark >> shift) & 1, starts) for shift in (0, 1))
        number = run_hashes(words[starts].astype(np.int64).ravel(), words.shape[1])[:: words.shape[1]]
        size = np.diff(np.r_[starts, len(mark)])
        keep = np.repeat((train > 0) & (held > 0) | (border >= 0), size)
        columns = [np.repeat(number, size), *[rest.column(c) for c in rest.column_names], np.repeat(train, size), np.repeat(held, size), np.full(len(mark), border, dtype=np.int32)]
        table = pa.table(columns, names=names).filter(pa.array(keep))
        yield from table.combine_chunks().to_batches()

    def intervals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, begun = TaskContext.get().partitionId(), False
        open_words, open_rows = None, []  # the interval that is not yet closed

        def close(border: bool) -> Iterator[pa.RecordBatch]:
            rest = pa.Table.from_batches(open_rows)
            yield from emit(np.broadcast_to(open_words, (rest.num_rows, depth)), rest, np.zeros(1, dtype=np.int64), task if border else -1)

        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column("prefix")
            bounds = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
            words = np.frombuffer(column.buffers()[2], dtype=">u4", count=len(column) * depth, offset=int(bounds[0])).reshape(-1, depth)
            rest = batch.drop_columns(["prefix"])
            before = words[:1] if open_words is None else open_words
            lcp = common_prefix(words, np.concatenate([before, words[:-1]]))
            starts = np.flatnonzero(lcp < depth)
            goes_on = open_words is not None and not (len(starts) and starts[0] == 0)
            if goes_on:
                open_rows.append(rest.slice(0, int(starts[0]) if len(starts) else len(rest)))
            elif open_words is None:
                starts = np.r_[0, starts]
            if len(starts):
                if open_words is not None:
                    yield from close(border=not begun)
                    begun = True
                last = int(starts[-1])
                if len(starts) > 1:
                    first = int(starts[0])
                    inner = starts[:-1] - first
                    if not begun:  # the first interval of this task's stretch
                        end = int(inner[1]) if len(inner) > 1 else last - first
                        yield from emit(words[first : first + end], pa.Table.from_batches([rest.slice(first, end)]), np.zeros(1, dtype=np.int64), task)
                        begun = True
                        inner = inner[1:] - end
                        first += end
                    if len(inner):
                        yield from emit(words[first:last], pa.Table.from_batches([rest.slice(first, last - first)]), inner, -1)
                open_words, open_rows = words[last : last + 1].copy(), [rest.slice(last)]
        if open_rows:
            yield from close(border=True)

    array = cut(ordered.mapInArrow(intervals, "span bigint, rep bigint, mark bigint" + (", at array<int>" if places else "") + ", n_train bigint, n_held bigint, border int"))
    pieces = array.where("border >= 0").select("span", "border", "n_train", "n_held").distinct()
    whole = pieces.groupBy("span").agg(F.sum("n_train").alias("_t"), F.sum("n_held").alias("_h"))
    # `whole` has at most two rows per task
    joined = array.join(F.broadcast(whole), "span", "left").withColumn("n_train", F.coalesce("_t", "n_train")).withColumn("n_held", F.coalesce("_h", "n_held"))
    return joined.where("n_train > 0 and n_held > 0").drop("_t", "_h", "border"), array


def near_classes(reps: DataFrame, share: float = SHARE) -> DataFrame:
    """(rep_t, rep_h): pairs of different texts, rep_t on the train side and rep_h on the held side, of similarity >= share.

    Similarity: runs of SPAN words that both have, of all different runs of either. Texts of fewer words are similar to none.
    """
    array, kept_array = suffix_array(reps, SPAN)
    per_text = Window.partitionBy("rep")
    n = F.shiftright("mark", 2).cast("int")
    need = F.ceil(F.col("n") * share - 1e-9)
    kept = (
        array.select("span", "rep", (F.col("mark") % 4).cast("int").alias("side"), n.alias("n"), (F.col("n_train") + F.col("n_held")).alias("members"))
        .withColumn("c", F.count(F.lit(1)).over(per_text)).where(F.col("c") >= need)
        .withColumn("place", F.row_number().over(per_text.orderBy("members", "span"))).where(F.col("place") <= F.col("c") - need + F.least(F.lit(HITS), need))
        .select("span", "rep", "side", "n", F.col("c").cast("int").alias("c"), "place")
    )
    a = kept.where("side % 2 = 1").select("span", F.col("rep").alias("rep_t"), F.col("n").alias("n_t"), F.col("c").alias("c_t"), F.col("place").alias("p_t"))
    b = kept.where("side >= 2").select("span", F.col("rep").alias("rep_h"), F.col("n").alias("n_h"), F.col("c").alias("c_h"), F.col("place").alias("p_h"))
    most = F.least(F.col("c_t") - F.col("p_t"), F.col("c_h") - F.col("p_h")) + F.least("p_t", "p_h")
    alike = (
        (F.col("rep_t") != F.col("rep_h"))
        & (F.least("n_t", "n_h") >= F.greatest("n_t", "n_h") * share - 1e-9)
        & (most >= (F.col("n_t") + F.col("n_h")) * (share / (1 + share)) - 1e-9)
    )
    hits = F.least(F.lit(HITS), F.ceil(F.least("n_t", "n_h") * share - 1e-9))
    pairs = a.join(b, "span").where(alike).groupBy("rep_t", "rep_h").agg(F.count(F.lit(1)).alias("hits"), F.first(hits).alias("least"))
    candidates = cut(pairs.where("hits >= least").select("rep_t", "rep_h"))
    discard(kept_array)

    def pick(side: str) -> DataFrame:
        wanted = candidates.select(F.col(side).alias("rep")).distinct()
        return reps.join(wanted, "rep").select(F.col("rep").alias(side), F.col("words").alias(f"w_{side}"))

    both = candidates.join(pick("rep_t"), "rep_t").join(pick("rep_h"), "rep_h")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            good = []
            for x, y in zip(pdf["w_rep_t"], pdf["w_rep_h"]):
                p, q = (np.unique(run_hashes(np.asarray(w, dtype=np.int64), SPAN)) for w in (x, y))
                same = len(np.intersect1d(p, q, assume_unique=True))
                good.append(same >= share * (len(p) + len(q) - same) - 1e-9)
            yield pdf.loc[good, ["rep_t", "rep_h"]]

    return both.mapInPandas(compare, "rep_t bigint, rep_h bigint")


class Overlaps:
    """Cross-split overlaps of docs (doc_id, text, train, held): classes of equal texts, the links between them, and who is in which.

    Nothing here grows with the copies of a text but `pairs`.
    """

    def __init__(self, docs: DataFrame, share: float = SHARE):
        texts = cut(encoded(docs))
        self.reps = cut(classes(texts))
        self.members = cut(texts.join(texts.groupBy("same_as").agg(F.min("doc_id").alias("rep")), "same_as").select("doc_id", "rep", "train", "held"))
        discard(texts)
        near = near_classes(self.reps, share)
        equal = self.reps.where("train and held").select(F.col("rep").alias("rep_t"), F.col("rep").alias("rep_h"))
        self.links = cut(near.unionByName(equal))

    def pairs(self) -> DataFrame:
        """(doc_train, doc_held): every pair of two documents, copies included."""
        t = self.members.where("train").select(F.col("rep").alias("rep_t"), F.col("doc_id").alias("doc_train"))
        h = self.members.where("held").select(F.col("rep").alias("rep_h"), F.col("doc_id").alias("doc_held"))
        return self.links.join(t, "rep_t").join(h, "rep_h").where("doc_train <> doc_held").select("doc_train", "doc_held")

    def counts(self) -> DataFrame:
        """(doc_held, n): how many train documents each overlapping held-out document has, from the sizes of the classes."""
        sizes = self.reps.select(F.col("rep").alias("rep_t"), "n_train")
        per = self.links.join(sizes, "rep_t").groupBy(F.col("rep_h").alias("rep")).agg(F.sum("n_train").alias("n"))
        own = self.members.where("held").join(per, "rep")
        return own.select(F.col("doc_id").alias("doc_held"), (F.col("n") - F.col("train").cast("int")).alias("n")).where("n > 0")


def cross_split_pairs(docs: DataFrame, share: float = SHARE) -> DataFrame:
    """(doc_train, doc_held): docs has doc_id, text, train, held (booleans). Every pair of two documents with one in train and the
    other held out whose texts are equal or similar, copies included. Texts without words match nothing.
    """
    return Overlaps(docs, share).pairs()


def coverage(docs: DataFrame, least: int = 8) -> DataFrame:
    """(doc_id, n_words, covered): for each held-out document, how many of its words lie in a span of `least` words or more that
    train has too: the spans of cross-split intervals, merged. A document of fewer words is covered where train has a text of
    exactly its words.
    """
    texts = cut(encoded(docs))
    reps = cut(classes(texts))
    array, kept_array = suffix_array(reps, least, places=True)
    at = array.where("shiftright(mark, 1) % 2 = 1").select("rep", F.explode("at").alias("at"))
    before = F.lag("at").over(Window.partitionBy("rep").orderBy("at"))
    gain = F.least(F.lit(least), F.coalesce(F.col("at") - before, F.lit(least)))
    covered = cut(at.select("rep", gain.alias("gain")).groupBy("rep").agg(F.sum("gain").alias("covered")))
    discard(kept_array)
    short = reps.where(F.col("train") & F.col("held") & (F.size("words") < least)).select("rep", F.size("words").cast("bigint").alias("covered"))
    own = texts.where("held").select("doc_id", "same_as", F.size("words").alias("n_words")).join(texts.groupBy("same_as").agg(F.min("doc_id").alias("rep")), "same_as")
    return own.join(covered.unionByName(short), "rep", "left").select("doc_id", "n_words", F.coalesce("covered", F.lit(0)).alias("covered"))
