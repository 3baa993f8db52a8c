"""Text normalizers, profiles and counts. All are expressions, but where Unicode normalization is needed (Arrow batches)."""

from __future__ import annotations

import html
import re
import sys
import unicodedata
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

# Fixed values of the text contract: invisible characters, Arabic marks, alef forms and what they fold to, placeholders.
INVISIBLE = "​‌‍‎‏﻿"
MARKS = "ً-ْٰۖ-ۭ"
STRETCH = "ـ"
ALEFS, ALEF = "آأإٱ", "ا"
URL, MENTION, REPEAT = "[URL]", "[MENTION]", "[REPEAT_PUNCT]"

_URL = re.compile(r"(?:https?://|www\.)\S+", re.IGNORECASE)
_MENTION = re.compile(r"(?<!\w)@\w+")
_HASH = re.compile(r"#(?=\w)")
_CLEAN = str.maketrans({c: None for c in INVISIBLE + STRETCH} | {c: ALEF for c in ALEFS})
_ONLY_MARKS = re.compile(f"[{MARKS}]")
_KEPT = re.compile(f"({'|'.join(map(re.escape, (URL, MENTION, REPEAT)))})")
#: One punctuation character three times or more.
_REPEATED = regex.compile(r"(\p{P})\1{2,}")


@lru_cache(maxsize=1)
def _latin_lower() -> dict[int, str]:
    """Code point of each Latin letter that has a lower case -> that."""
    cased = (c for c in map(chr, range(sys.maxunicode + 1)) if c.lower() != c)
    return {ord(c): c.lower() for c in cased if "LATIN" in unicodedata.name(c, "")}


def contract_text(text: str | None) -> str | None:
    """The contract's normal form: NFC, no invisibles, one blank for white space, no stretch signs or marks, one alef,
    placeholders for links, mentions and repeated punctuation, no # before a word, Latin letters in lower case."""
    if text is None:
        return None
    text = " ".join(unicodedata.normalize("NFC", text).translate({ord(c): None for c in INVISIBLE}).split())
    text = _ONLY_MARKS.sub("", text.translate(_CLEAN))
    text = _HASH.sub("", _MENTION.sub(MENTION, _URL.sub(URL, text)))
    text = _REPEATED.sub(REPEAT, text)
    # placeholders keep their capitals
    return "".join(part if part in (URL, MENTION, REPEAT) else part.translate(_latin_lower()) for part in _KEPT.split(text))


def _series(function):
    @pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(function, na_action="ignore")

    return run


def contract_column(col: Column | str) -> Column:
    return _series(contract_text)(col)


def normal_form(form: str):
    """A column function: Unicode normalization to `form`."""
    return _series(lambda t: unicodedata.normalize(form, t))


def unescaped(col: Column | str) -> Column:
    return _series(html.unescape)(col)


def is_minimal_empty(col: Column | str) -> Column:
    """Null, or nothing but white space and invisible characters."""
    col = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.trim(F.regexp_replace(F.translate(col, INVISIBLE, ""), r"(?U)\s+", " ")) == "", F.lit(True))


def dedup_text(col: Column | str) -> Column:
    """Lower case, only a-z, 0-9 and single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(col), "[^a-z0-9 ]", ""), " +", " "))


def model_text(title: Column, text: Column) -> Column:
    """`title. text` if there is a title, else the text."""
    return F.when(F.length(F.trim(title)) > 0, F.concat_ws(". ", title, text)).otherwise(text)


def stripped(col: Column | str) -> Column:
    """Without tags and control characters, white space collapsed."""
    plain = F.regexp_replace(F.regexp_replace(col, "<[^>]*>", " "), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    return F.trim(F.regexp_replace(plain, "[ \\t\\n\\r]+", " "))


def arabic_light(col: Column | str, marks: bool = False) -> Column:
    """Unescaped, without tags and control characters, NFKC, without stretch signs and, unless `marks`, without marks."""
    out = stripped(normal_form("NFKC")(unescaped(col)))
    out = F.translate(out, STRETCH, "")
    return out if marks else F.regexp_replace(out, f"[{MARKS}]", "")


def mark_share(col: Column | str) -> Column:
    return F.try_divide(F.regexp_count(col, F.lit(f"[{MARKS}]")).cast("double"), F.length(col))


def letters(col: Column | str, script: str) -> Column:
    """Letters of a script: arabic or latin."""
    ranges = {"arabic": "؀-ۿݐ-ݿ", "latin": "A-Za-zÀ-ÖØ-öø-ɏ"}
    return F.regexp_count(col, F.lit(f"[{ranges[script]}]"))


def script_of(col: Column | str) -> Column:
    """empty, none, arabic, latin, arabizi (Latin letters with digits inside words, as 3 or 7 for Arabic sounds) or mixed."""
    col = F.col(col) if isinstance(col, str) else col
    a, b = letters(col, "arabic"), letters(col, "latin")
    return (
        F.when(F.coalesce(F.trim(col), F.lit("")) == "", "empty").when((a == 0) & (b == 0), "none").when((a > 0) & (b > 0), "mixed").when(a > 0, "arabic")
        .when(col.rlike("[A-Za-z][2356789][A-Za-z]"), "arabizi").otherwise("latin")
    )


def words(col: Column | str, pattern: str = "[ \\t\\n\\r]+") -> Column:
    return F.filter(F.split(col, pattern), lambda w: w != "")


def ngrams(tokens: Column, n: int) -> Column:
    """Runs of n tokens, joined by blanks; none of a shorter array."""
    if n == 1:
        return tokens
    at = F.sequence(F.lit(1), F.size(tokens) - (n - 1))
    return F.when(F.size(tokens) >= n, F.transform(at, lambda i: F.array_join(F.slice(tokens, i, n), " "))).otherwise(F.array().cast("array<string>"))


def char_ngrams(col: Column, n: int) -> Column:
    """Runs of n characters, in one pass over the text (a substring by position would scan from its start each time)."""
    return F.regexp_extract_all(col, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))


# Fixed values of the light Arabic stemmer (Larkey, Ballesteros and Connell 2002, light10): articles and endings.
ARTICLES, ENDINGS = ["ال", "وال", "بال", "كال", "فال", "لل"], ["ها", "ان", "ات", "ون", "ين", "يه", "ية", "ه", "ة", "ي"]


def light_stem(word: Column) -> Column:
    """A word without its conjunction, article and endings, as long as three (two) letters are left; other scripts are unchanged."""
    out = F.regexp_replace(word, "^و(?=.{3,}$)", "")
    out = F.regexp_replace(out, f"^(?:{'|'.join(sorted(ARTICLES, key=len, reverse=True))})(?=.{{2,}}$)", "")
    for ending in ENDINGS:
        out = F.regexp_replace(out, f"(?<=.{{2}}){ending}$", "")
    return out


def stem_views(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs plus stems: the text's words as light stems, one blank between. Every different text is stemmed once, by its content hash."""
    keyed = docs.withColumn("_content", F.sha2(text, 256))
    once = keyed.where(F.col(text).isNotNull()).groupBy("_content").agg(F.any_value(text).alias("_t"))
    stems = once.select("_content", F.array_join(F.transform(words(arabic_light("_t")), light_stem), " ").alias("stems"))
    return keyed.drop("stems").join(stems, "_content", "left").drop("_content")
