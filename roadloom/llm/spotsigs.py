"""Document fingerprints: SpotSigs.

An anchor is a common word of one of four languages. Where it stands, the next
CHAIN content words (words that are no anchors), taken every STEP words, form a
signature; a document's fingerprint is its set of signatures, written as sorted
8-digit hex numbers. Chains of fewer words at the end of a text count too.
Likeness is the Jaccard coefficient of two fingerprints.

Passages without anchors (other languages, tables) have chains as well: every word
with no anchor among the GAP words before it starts one. In a run of anchors those
after the first GAP are content too. Both are decided by the words just before, so
a passage keeps its signatures whatever the rest of the text is. Only where
all this gives nothing (a few anchors alone) does every word start a chain.

similar_pairs() partitions fingerprints by the number of signatures, so that only
neighbouring length classes can reach the threshold, indexes each set's rarest
signatures and verifies by intersecting whole sets. No query calls it.

Edge cases: null text is empty; an empty text (or one of white space) has the
empty fingerprint, like another empty one 1.0 and like any other 0.0. Equal texts
have equal fingerprints. Repeated rows and doc_ids each get a row; rows of one
doc_id stand in the order of their texts' hashes (in each of its parts, where it fills several). A null doc_id is last in the descending
order. A single document is its own next. An empty table gives an empty result.
Extra columns are not carried.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.llm.shared import Ranges

CHAIN = 3
STEP = 1
#: Frequent function words of English, French, German and Spanish.
COMMON = (
    "a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their there they this to was we were which will with you "
    "au aux ce ces dans des du elle en est et il ils je la le les leur lui mais nous ou par pas plus pour qu que qui sa se ses son sur un une vous "
    "als am auch auf aus bei das dass dem den der die ein eine einen er es für ich ihr im ist mit nach nicht noch nur oder sein sich sie sind so um und uns vom von war wie wir zu zum zur über "
    "al como con cuando de del desde donde el ella ellos era esta este ha hay las lo los me mi muy más ni no nos o para pero por porque sin sobre su sus también te tu y ya"
).split()
ANCHORS = frozenset(COMMON)
#: So many words without an anchor, and chains start at every word until the next.
GAP = 8
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_STRIP = ".,;:!?\"'()[]{}|«»„“”…-"


class Words:
    """Word codes: a hash, and whether the word is an anchor. Kept per worker, up to KEEP words."""

    KEEP = 400_000

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def codes(self, text: str) -> np.ndarray:
        """64-bit codes of the words; bit 0: an anchor; 0 for words of punctuation alone. Words lose all signs at their edges, but for words of signs alone."""
        words = text.lower().split()
        known = self.known
        try:
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            if len(known) > self.KEEP:
                known.clear()
            for w in set(words).difference(known):
                bare = _EDGES.sub("", w) or w.strip(_STRIP)
                code = (xxhash.xxh3_64_intdigest(bare) & ~3) | 2 | (bare in ANCHORS) if bare else 0
                known[w] = code
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def signatures(codes: np.ndarray) -> np.ndarray:
    """The sorted 32-bit signatures of a text's word codes."""
    codes = codes[codes != 0]
    if not len(codes):
        return np.empty(0, np.uint32)
    anchor = (codes & np.uint64(1)) == 1
    at = np.arange(len(codes))
    since_content = at - np.maximum.accumulate(np.where(anchor, -1, at))
    since_anchor = at - np.maximum.accumulate(np.where(anchor, at, -GAP - 1))
    content = np.nonzero(~anchor | (since_content > GAP))[0]
    spots = np.nonzero(anchor | (since_anchor > GAP))[0]
    first = np.searchsorted(content, spots, "right")
    some = (first < len(content)) | ~anchor[spots]
    spots, first = spots[some], first[some]
    if not len(spots):
        content, spots, first = at, at, at + 1
    words = np.concatenate((codes[content], np.zeros(CHAIN * STEP, np.uint64)))
    h = codes[spots] * np.uint64(0x9E3779B97F4A7C15)
    for i in range(CHAIN):
        h = (h ^ words[first + i * STEP]) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return np.unique((h >> np.uint64(16)).astype(np.uint32))


def spell(sigs: np.ndarray) -> str:
    return sigs.astype(">u4").tobytes().hex(" ", 4)


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard of two sorted sets; 0.0 at once where their lengths alone keep it under least."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    both = np.concatenate((a, b))
    both.sort()
    same = int(np.count_nonzero(both[1:] == both[:-1]))
    return same / (len(both) - same)


def edited(text: str, after: str) -> str:
    """The last half of text replaced by as many code points from the start of after."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


_WORDS = Words()


def compare_with_next(docs: DataFrame, *, parts: int | None = None) -> DataFrame:
    """Fingerprints of docs (doc_id, text), of their edited texts, and likenesses to those and to the next document.

    Documents are dealt once, by ranges of doc_id, of which a hot id and nulls have several; each
    also gets the row that follows it.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a null id stands below all others: it is last in the descending order
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    ranges = Ranges(rows, "doc_id", parts)
    rows = rows.withColumn("part", ranges.part(F.col("doc_id")))
    h = F.xxhash64("text")
    # the first row of a part, in descending order, follows the part above it; one row a part comes back
    firsts = rows.groupBy("part").agg(F.min(F.struct(F.coalesce(-1 - F.col("doc_id"), F.lit(2**63 - 1)).alias("down"), F.col("doc_id").isNull().alias("none"), h.alias("h"))).alias("f")).select("part", "f.*")
    found = sorted(firsts.collect(), key=lambda r: -r["part"])
    marks = [(r["part"], r["down"], r["none"], r["h"], found[i - 1]["part"]) for i, r in enumerate(found)]
    marks = F.broadcast(spark.createDataFrame(marks, "part int, down long, none boolean, h long, halo_of int"))
    rows = rows.withColumns({"down": F.coalesce(-1 - F.col("doc_id"), F.lit(2**63 - 1)), "none": F.col("doc_id").isNull(), "h": h}).join(marks, ["part", "down", "none", "h"], "left")
    copies = F.array_compact(F.array(F.struct(F.col("part"), F.lit(0).alias("halo")), F.when(F.col("halo_of").isNotNull(), F.struct(F.col("halo_of").alias("part"), F.lit(1).alias("halo")))))
    dealt = rows.withColumn("_c", F.explode(copies)).select("doc_id", "text", "h", "_c.part", "_c.halo")
    order = ["part", "halo", F.col("doc_id").desc_nulls_last(), "h", "text"]
    dealt = dealt.repartitionById(ranges.count, F.col("part")).sortWithinPartitions(*order)

    def fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(now: tuple, after: tuple) -> tuple:
            changed = edited(now[1], after[1])
            sig = signatures(_WORDS.codes(changed))
            return (now[0], len(now[1]), hashlib.sha256(changed.encode()).hexdigest(), spell(now[2]), spell(sig), likeness(now[2], sig), likeness(now[2], after[2]))

        out, size, last, part, closed = [], 0, None, None, True

        def ended() -> None:
            if not closed:
                raise ValueError("the documents came in another order when they were read again: write them to a table first")

        for batch in batches:
            for i in range(batch.num_rows):
                text, p, is_halo = batch["text"][i].as_py(), batch["part"][i].as_py(), batch["halo"][i].as_py()
                if p != part:
                    ended()
                    last, part, closed = None, p, False
                if is_halo and closed:
                    continue  # several rows of one id: the first follows
                now = (batch["doc_id"][i].as_py(), text, signatures(_WORDS.codes(text)))
                if last is not None:
                    out.append(row(last, now))
                    size += 2 * len(out[-1][3])
                last, closed = now, bool(is_halo)
                if size > 4_000_000:
                    yield _batch(out)
                    out, size = [], 0
        ended()
        yield _batch(out)

    return dealt.select("doc_id", "text", "part", "halo").mapInArrow(fingerprint, SCHEMA)


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_TYPES = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_TYPES)], names=_NAMES)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of docs (doc_id, text), a row for each row: null and empty texts have the empty one, null and repeated ids stay, an empty table gives none."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = [spell(signatures(_WORDS.codes(t or ""))) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(prints, pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(make, "doc_id long, fingerprint string")


def similar_pairs(prints: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Pairs (fp_a < fp_b, likeness) of different non-empty fingerprints with likeness >= threshold; membership is (fingerprint, doc_id).

    prints: (doc_id, fingerprint). Ids aren't read, so null and repeated ones change nothing; null fingerprints are left out. Equal fingerprints collapse first. A set of n
    signatures is in the length class of n; it looks up its n - ceil(t n) + 1
    rarest signatures, in its own class and those within reach below.
    """
    import math

    sets = prints.where("fingerprint <> ''").select("fingerprint").distinct().withColumn("s", F.split("fingerprint", " "))
    sets = sets.withColumns({"n": F.size("s"), "id": F.xxhash64("fingerprint")})
    sigs = sets.select("id", "fingerprint", "n", F.explode("s").alias("sig"))
    common = sigs.groupBy("sig").agg(F.count("*").alias("df"))
    ranked = sigs.join(common, "sig").groupBy("fingerprint", "n").agg(F.sort_array(F.collect_list(F.struct("df", "sig"))).alias("r"))
    keep = (F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).cast("int")
    ratio = math.log(1 / threshold) or 1.0
    classed = ranked.withColumn("class", F.floor(F.log("n") / ratio + 1e-9)).withColumn("sig", F.explode(F.transform(F.slice("r", F.lit(1), keep), lambda x: x["sig"])))
    a = classed.select(F.col("fingerprint").alias("fa"), F.col("n").alias("na"), "sig", "class")
    b = classed.select(F.col("fingerprint").alias("fb"), F.col("n").alias("nb"), "sig", F.explode(F.array("class", F.col("class") + 1)).alias("class"))
    fits = ((F.col("nb") < F.col("na")) | ((F.col("nb") == F.col("na")) & (F.col("fb") < F.col("fa")))) & (F.col("nb") >= F.col("na") * threshold - 1e-9)
    pairs = a.join(b, ["sig", "class"]).where(fits).select("fa", "fb").distinct()
    sa, sb = F.split("fa", " "), F.split("fb", " ")
    both = F.size(F.array_intersect(sa, sb))
    like = both / (F.size(sa) + F.size(sb) - both)
    return pairs.withColumn("likeness", like).where(F.col("likeness") >= threshold).select(F.least("fa", "fb").alias("fp_a"), F.greatest("fa", "fb").alias("fp_b"), "likeness")
