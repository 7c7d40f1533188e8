"""Spelling variants: words at distance one by a symmetric-delete join, forms, and roots by pointer jumping.

1. Words are counted per task, then over all documents.
2. Every word emits itself and its distinct single deletions as 64-bit keys. Two
   words that differ by one replaced code point share the deletion of that place; one
   that has a code point more shares a deletion with the other's own key. The
   equi-join of shared keys keeps just those pairs: a deletion stands for a stretch of
   places (equal neighbours give the same string), and two deletions fit only if
   their stretches meet. A key's rows are bounded by alphabet and length, not by the table.
3. Pairs fetch both words and their distance is verified, so a collision of keys or
   ids can't add one. Forms are one aggregate over the pairs.
4. Roots: each round joins every form with its own form's, so that paths halve; as a
   form has ratio times its word's n, there are few rounds.

Edge cases: null text has no words. A null doc_id is written as an empty text where noise
is drawn. Repeated rows count each. Of near words with equal n the first in code-point
order is the form. A word of any length costs its length. An empty table, and one without
words that are long and frequent enough, give an empty result. Extra columns are not carried.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.llm.shared import discard, stash

#: Letters of a word, after A-Z became a-z.
LETTERS = "a-zÀ-ÿ"
#: Distinct words that a task holds before it passes its counts on.
HELD = 500_000
_BASE, _MULT = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)


def word_counts(docs: DataFrame, *, min_length: int = 7, min_count: int = 2, noise: int = 0) -> DataFrame:
    """word, n: runs of letters, A-Z lower-cased, of at least min_length code points and min_count occurrences.

    noise: where this many divides crc32("<doc_id>:<run>"), the run loses its code point number crc32 % length.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, seen = re.compile(f"[{LETTERS}]{{{min_length},}}"), Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                found = runs.findall(text.as_py().encode().lower().decode()) if text.is_valid else ()
                if not noise:
                    seen.update(found)
                else:
                    own = f"{'' if doc is None else doc}:".encode()
                    for w, n in Counter(found).items():
                        h = zlib.crc32(own + w.encode())
                        if h % noise == 0:
                            at = h % len(w)
                            w = w[:at] + w[at + 1 :]
                            if len(w) < min_length:
                                continue
                        seen[w] += n
                if len(seen) > HELD:
                    yield rows()
                    seen.clear()
        yield rows()

    counted = docs.select(F.col("doc_id").cast("string"), "text").mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _keys(words: pa.Array, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, id, first, last): each word's own key (places -1) and those of its distinct deletions, with the stretch of places that give it."""
    chars = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), "<u4").astype(np.uint64)
    lens = np.asarray(pc.utf8_length(words), dtype=np.int64)
    ends = np.cumsum(lens)
    starts = ends - lens
    owner = np.repeat(np.arange(len(lens)), lens)
    at = np.arange(len(chars)) - starts[owner]
    longest = int(lens.max(initial=0))
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(longest, _BASE, np.uint64))))
        parts = (chars * np.uint64(_MULT) ^ (chars << np.uint64(32))) * powers[at]
        upto = np.cumsum(parts)
        before = np.concatenate((np.zeros(1, np.uint64), upto))[starts]
        inside = upto - before[owner]
        whole = np.concatenate((np.zeros(1, np.uint64), upto))[ends] - before
        without = inside - parts + (whole[owner] - inside) * np.uint64(_INVERSE)

        def key(h: np.ndarray, n: np.ndarray) -> np.ndarray:
            h = (h + n.astype(np.uint64) * np.uint64(_BASE)) * np.uint64(_MULT)
            return ((h ^ (h >> np.uint64(32))) * np.uint64(_MULT)).view(np.int64)

        own, deleted = key(whole, lens), key(without, lens[owner] - 1)
    fresh = np.ones(len(chars), bool)
    fresh[1:] = (chars[1:] != chars[:-1]) | (at[1:] == 0)
    first = np.nonzero(fresh)[0]
    last = np.concatenate((first[1:], [len(chars)]))[: len(first)] - 1
    none = np.full(len(lens), -1, np.int64)
    return np.concatenate((own, deleted[first])), np.concatenate((ids, ids[owner[first]])), np.concatenate((none, at[first])), np.concatenate((none, at[last]))


def near_words(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): every pair of words (word, n) that differ by exactly one inserted, deleted or replaced code point, both ways round."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, who, first, last = _keys(b.column("word"), np.asarray(b.column("id")))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(who), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], names=["key", "id", "first", "last"])

    named = words.withColumn("id", F.xxhash64("word"))
    keys = named.select("word", "id").mapInArrow(emit, "key long, id long, first int, last int")
    a, b = keys.alias("a"), keys.alias("b")
    replaced = F.expr("a.first >= 0 AND a.id < b.id AND a.first <= b.last AND b.first <= a.last")
    fits = F.expr("b.first >= 0") & (replaced | (F.col("a.first") < 0))
    pairs = a.join(b, F.expr("a.key = b.key") & fits).select(F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id")).distinct()
    side = lambda s: named.select(F.col("id").alias(f"{s}_id"), F.col("word").alias(s), F.col("n").alias(f"{s}_n"))
    pairs = pairs.join(side("a"), "a_id").join(side("b"), "b_id").where(F.levenshtein("a", "b", 1) == 1)
    one = F.struct("a", "a_n", "b", "b_n")
    other = F.struct(F.col("b").alias("a"), F.col("b_n").alias("a_n"), F.col("a").alias("b"), F.col("a_n").alias("b_n"))
    return pairs.select(F.explode(F.array(one, other)).alias("p")).select("p.*")


def roots(forms: DataFrame) -> DataFrame:
    """word, root of rows (word, form): where the forms lead in the end. A word is in it once, and no form leads back."""
    now = stash(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        met = stash(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        discard(now)
        now = met
        if not met.where("moved").limit(1).count():
            return now.select("word", "root")


def spelling_variants(docs: DataFrame, *, min_length: int = 7, min_count: int = 2, ratio: int = 10, noise: int = 0) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word of docs (doc_id, text).

    form: the near word of largest n, if that is at least ratio times the word's n.
    """
    words = stash(word_counts(docs, min_length=min_length, min_count=min_count, noise=noise), "spelling-words")
    best = near_words(words).groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("less"), F.col("b").alias("form"))).alias("best"))
    near = words.join(best, "word", "left").withColumn("is_form", F.coalesce(-F.col("best.less") >= ratio * F.col("n"), F.lit(False)))
    near = near.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(F.col("is_form"), F.col("best.form")).alias("form"), F.when(F.col("is_form"), -F.col("best.less")).alias("form_n"),
    )
    near = stash(near, "spelling-forms")
    discard(words)
    ends = roots(near.where("form IS NOT NULL"))
    return near.join(ends, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
