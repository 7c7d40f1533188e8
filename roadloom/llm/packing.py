"""Packing by optimal length buckets.

A dynamic program over the histogram of all lengths chooses at most BUCKETS
boundaries, the set with the least padding where every document is padded to its
bucket's boundary. Inside each bucket, in the order of a hash of the id, batches
of as many documents as fit the token budget are formed: padded tokens never
exceed BUDGET unless one document alone does.

The histogram is exact: one row per distinct length, which the driver reads. A corpus
of 100 TB whose longest document has a million words has at most a million of them,
24 MB, however many documents there are.

Length is the number of words. Edge cases: null text has length 0. Documents
longer than the budget are batches of their own, whole. Repeated rows are each
packed. An empty table gives an empty result. Extra columns are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadloom.llm.shared import n_words, running_sum, stash

BUCKETS = 16
BUDGET = 65_536


def boundaries(lengths: list[int], counts: list[int], buckets: int = BUCKETS) -> list[int]:
    """At most so many of the increasing lengths, the last included, with the least sum of boundary times count."""
    n = len(lengths)
    if not n:
        return []
    upto = [0]
    for c in counts:
        upto.append(upto[-1] + c)
    # best[j]: least cost of the first j lengths; the next layer is a lower envelope of the lines -upto[i] * x + best[i]
    best = [0, *(lengths[j - 1] * upto[j] for j in range(1, n + 1))]
    came = [[0] * (n + 1)]
    for _ in range(1, min(buckets, n)):
        hull: list[tuple[int, int, int]] = []  # slope, height, i
        at, now, back = 0, [0] * (n + 1), [0] * (n + 1)
        for j in range(1, n + 1):
            slope, height = -upto[j - 1], best[j - 1]
            while len(hull) > 1 and (height - hull[-2][1]) * (hull[-2][0] - hull[-1][0]) <= (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - slope):
                hull.pop()
            hull.append((slope, height, j - 1))
            at = min(at, len(hull) - 1)
            x = lengths[j - 1]
            while at + 1 < len(hull) and hull[at + 1][0] * x + hull[at + 1][1] <= hull[at][0] * x + hull[at][1]:
                at += 1
            now[j] = hull[at][0] * x + hull[at][1] + x * upto[j]
            back[j] = hull[at][2]
        best = now
        came.append(back)
    out, j = [], n
    for back in reversed(came):
        if j == 0:
            break
        out.append(lengths[j - 1])
        j = back[j]
    return out[::-1]


def pack(docs: DataFrame, *, size: Column | None = None, buckets: int = BUCKETS, budget: int = BUDGET, seed: int = 5) -> DataFrame:
    """doc_id, size, bucket, padded_size, batch (within the bucket), batch_docs_max for every row of docs (doc_id, text).

    size: a document's length, its number of words unless given (a column of token counts, for one).
    """
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    # the texts are read once; all that follows works on a few numbers for each row
    rows = stash(docs.select("doc_id", (n_words(F.col("text")) if size is None else F.coalesce(size.cast("long"), F.lit(0))).alias("size"), h.alias("_h"), F.xxhash64("text").alias("_t")), "sizes")
    hist = rows.groupBy("size").count().orderBy("size").toPandas()  # a row per distinct length, see above
    cuts = boundaries(hist["size"].tolist(), hist["count"].tolist(), buckets) or [0]
    tops = F.array(*[F.lit(int(c)).cast("long") for c in cuts])
    number = F.size(F.filter(tops, lambda c: c < F.col("size"))).cast("int")
    rows = rows.withColumn("bucket", number).withColumn("padded_size", F.element_at(tops, F.col("bucket") + 1))
    rows = running_sum(rows.withColumn("_one", F.lit(1).cast("long")), ["bucket"], "_h", ["_t"], "_one", "_rank")
    fit = F.greatest(F.lit(1).cast("long"), F.expr(f"{budget}L div greatest(padded_size, 1L)"))
    rows = rows.withColumn("batch_docs_max", fit)
    return rows.select("doc_id", "size", "bucket", "padded_size", F.expr("_rank div batch_docs_max").alias("batch"), "batch_docs_max")
