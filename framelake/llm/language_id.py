"""Language identification by rank-order profiles of character n-grams.

A profile is a list of the most frequent n-grams (one to three characters, lower-cased letters with
one blank between words) in rank order. A document's own list is compared to each language's: an
n-gram found in both adds how far its two ranks are apart, one that the language lacks adds the
longest distance. The language with the smallest sum wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.llm.common import bounded_batches, frugal, give_back, start_task, table

#: N-grams in a language's profile and in a document's; both lists are cut there by definition of the method.
PROFILE = 400
#: Labelled documents that a language's profile is learned from, at most (a hash of the key chooses them).
LEARNED_DOCS = 4_000
#: Languages whose sizes are sent to all tasks, at most.
SHIPPED_LANGUAGES = 10_000
UNDETERMINED = "und"

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """code point -> the code point of its lower-case letter, 0 for what is no letter."""
    if not _letters:
        out = np.zeros(0x110000, dtype=np.int32)
        for i in range(0x110000):
            if not 0xD800 <= i <= 0xDFFF and (c := chr(i)).isalpha():
                out[i] = ord(c.lower()[0])
        _letters.append(out)
    return _letters[0]


def ngrams(text: str | None) -> np.ndarray:
    """Codes of all n-grams of the whole text; empty without a letter."""
    a = letters()[np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), dtype="<u4")].astype(np.int64)
    a = np.concatenate([[0], a, [0]])
    a = a[np.concatenate([[True], (a[1:] != 0) | (a[:-1] != 0)])]
    if len(a) < 3:
        return np.zeros(0, dtype=np.int64)
    # letters lie below 2**18; the bits above three of them tell n-grams of different lengths apart
    one, two, three = a[a != 0], a[:-1] << 18 | a[1:], a[:-2] << 36 | a[1:-1] << 18 | a[2:]
    return np.concatenate([one | 1 << 60, two | 1 << 61, three])


def ranked(text: str | None, size: int = PROFILE) -> np.ndarray:
    """The size most frequent n-grams of text, most frequent first, ties by code."""
    codes, n = np.unique(ngrams(text), return_counts=True)
    return codes[np.lexsort((codes, -n))[:size]]


def learn(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = LEARNED_DOCS, size: int = PROFILE) -> dict[str, list[int]]:
    """language -> its n-gram codes in rank order, from rows with a text and a language.

    At most about per_language documents of each language are read (all of them, where there are
    fewer), chosen by a hash of the key, so that a rerun learns the same; a null key is a key like others. What the driver gets is
    size codes a language, of all languages.
    """
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = rows.groupBy(F.col(lang).alias("l")).agg(F.count("*").alias("n"))
    if sizes.count() <= SHIPPED_LANGUAGES:  # else labels are dirty, and texts are shuffled by them
        sizes = F.broadcast(sizes)
    place = F.pmod(F.xxhash64(F.lit("language profile"), F.col(key)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.select(F.col(lang).alias("l"), F.col(text).alias("t"), place.alias("place")).join(sizes, "l").where(F.col("place") * F.col("n") < per_language).select("l", "t")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, group in batch.groupby("l"):
                codes, n = np.unique(np.concatenate([ngrams(t) for t in group["t"]]), return_counts=True)
                yield pd.DataFrame({"l": name, "code": codes, "n": n.astype(np.int64)})

    counts = sample.mapInPandas(frugal(run), "l string, code bigint, n bigint").groupBy("l", "code").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("l").orderBy(F.desc("n"), "code"))
    out: dict[str, list[int]] = {}
    for r in counts.withColumn("place", place).where(F.col("place") <= size).orderBy("l", "place").collect():
        out.setdefault(r["l"], []).append(r["code"])
    return out


def identify(docs: DataFrame, profiles: dict[str, list[int]], text: str = "text", size: int = PROFILE) -> DataFrame:
    """docs with lang_pred and score appended (columns of those names are replaced).

    score is 1 less the mean distance over the longest one: 1 for the profile's own order, 0 where
    no n-gram is known. A null text, an empty one or one without letters gets `und` and 0, as does
    everything where there is no profile. Texts are read whole; equal distances go to the language
    that comes first by name. A map over partitions: no shuffle.
    """
    bounded_batches(docs.sparkSession)
    names = sorted(profiles)
    order = [np.argsort(np.array(profiles[k], dtype=np.int64)) for k in names]
    codes = [np.array(profiles[k], dtype=np.int64)[o] for k, o in zip(names, order, strict=True)]

    def one(t: str | None) -> tuple[str, float]:
        own = ranked(t, size)
        if not len(own) or not names:
            return UNDETERMINED, 0.0
        place, best = np.arange(len(own)), None
        for name, c, o in zip(names, codes, order, strict=True):
            at = np.minimum(np.searchsorted(c, own), len(c) - 1)
            far = np.where(c[at] == own, np.minimum(np.abs(o[at] - place), size), size)
            d = int(far.sum())
            if best is None or d < best[1]:
                best = (name, d)
        return best[0], 1.0 - best[1] / (size * len(own))

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        start_task("language")
        for t in batches:
            yield pd.DataFrame([one(x) for x in t], columns=["lang_pred", "score"])
        give_back()

    found = "__found"
    while found in docs.columns:  # a column may be called anything
        found += "_"
    kept = [docs[c] for c in docs.columns if c not in ("lang_pred", "score")]
    return docs.withColumn(found, predict(F.col(text))).select(*kept, F.col(f"{found}.lang_pred").alias("lang_pred"), F.col(f"{found}.score").alias("score"))


def held_out(key: str = "doc_id") -> F.Column:
    """Whether the crc32 of the key as text is a multiple of 5; false for a null key, which has none."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    profiles = learn(docs.where(~held_out()))
    rows = identify(docs.select("doc_id", "text"), profiles)
    return rows.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
