"""Substring dedup, periodic runs, spelling variants: against brute force, and at their edges."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from roadloom.llm import periodic, queries, spelling, substring

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, part int, n long, word string"


def table(spark, texts, ids=None):
    """Documents with columns that clash with names inside the operators."""
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, 1, 2, "w") for i, t in zip(ids, texts, strict=True)], DOCS).repartition(3)


def prose(r, voc, n):
    return " ".join(f"w{r.randrange(voc)}é" for _ in range(n))


# -- substring dedup --------------------------------------------------------------------------------


def removed(texts, k):
    words = [WORDS.findall(t or "") for t in texts]
    times = collections.Counter(tuple(w[i : i + k]) for w in words for i in range(len(w) - k + 1))
    out = []
    for w in words:
        keep = [True] * len(w)
        for i in range(len(w) - k + 1):
            if times[tuple(w[i : i + k])] > 1:
                keep[i : i + k] = [False] * k
        out.append((len(w), len(w) - sum(keep), " ".join(x for x, y in zip(w, keep, strict=True) if y)))
    return out


def corpus(r):
    passage = prose(r, 5000, 60)
    texts = [prose(r, 5000, r.randint(0, 120)) for _ in range(30)]
    texts += [f"{prose(r, 5000, 20)}\n{passage} \t{prose(r, 5000, 20)}" for _ in range(40)]  # a passage that many share
    texts += [texts[3]] * 5 + [None, "", "   ", "one", "a " * 400, "a b " * 300, "a " * 36, "z " * 35, "y " * 34, prose(r, 3, 3000), "\x0b".join(["x\x1fy"] * 40)]
    near = texts[5].split()
    texts += [" ".join([*near[:i], "new", *near[i + 1 :]]) for i in range(0, len(near), 9)]
    return texts


@pytest.mark.parametrize("frequent", [False, True])
def test_windows_that_start_twice_go(spark, monkeypatch, frequent):
    texts = corpus(random.Random(1))
    if frequent:
        words, _ = substring.split_words(pa.array(texts, pa.string()))
        grams = np.unique(substring._grams(words)[::2]).view(np.int64)
        monkeypatch.setattr(substring, "frequent_grams", lambda docs: (len(words), np.sort(grams)))
        monkeypatch.setattr(substring, "MOST_WINDOWS", 7)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substring.dedup_substrings(table(spark, texts), window=35).collect()}
    assert got == dict(enumerate(removed(texts, 35)))
    assert sum(n for _, n, _ in got.values()) > 3000


def test_frequent_grams_are_found(spark, monkeypatch):
    texts = corpus(random.Random(2))
    n, grams = substring.frequent_grams(table(spark, texts))
    words, lens = substring.split_words(pa.array(texts, pa.string()))
    assert n == len(words) == sum(len(WORDS.findall(t or "")) for t in texts) == lens.sum()
    value, times = np.unique(substring._grams(words), return_counts=True)
    assert set(grams.tolist()) <= set(value[times >= substring.LEAST_FREQUENT].view(np.int64).tolist()) and len(grams)


def test_windows_with_one_hash_are_told_apart(monkeypatch):
    r, over = random.Random(3), substring._over
    monkeypatch.setattr(substring, "_over", lambda h, n: over(h, n) % np.uint64(3))
    strings = [" ".join(f"w{r.randrange(3)}" for _ in range(r.randint(6, 40))) for _ in range(20)]
    strings = sorted(set(strings))
    times = collections.Counter(tuple(s.split()[i : i + 6]) for s in strings for i in range(len(s.split()) - 5))
    want = {(j, i) for j, s in enumerate(strings) for i in range(len(s.split()) - 5) if times[tuple(s.split()[i : i + 6])] > 1}
    got = substring._repeats(pa.array(strings, pa.large_string()), np.ones(len(strings), int), 6)
    assert {(int(j), int(i) + k) for j, i, n in zip(*got, strict=True) for k in range(n)} == want


def test_substrings_of_repeated_and_null_ids_and_empty_tables(spark):
    text = prose(random.Random(4), 5000, 50)
    got = substring.dedup_substrings(table(spark, [text, text, text + " end", None], [None, 7, 7, None])).collect()
    assert sorted((r["doc_id"] is None, r["n_words"], r["n_removed"], r["kept"]) for r in got) == [(False, 50, 50, ""), (False, 51, 50, "end"), (True, 0, 0, ""), (True, 50, 50, "")]
    assert substring.dedup_substrings(table(spark, []).limit(0)).count() == 0
    with pytest.raises(ValueError):
        substring.dedup_substrings(table(spark, ["a"]), window=substring.GRAM - 1)


# -- periodic runs ----------------------------------------------------------------------------------


def plain_runs(words, min_length=6, min_exponent=4):
    """(start, length, period) of all runs by trying every period at every place."""
    found = {}
    for q in range(1, len(words) // min_exponent + 1):
        at = 0
        for agree, group in itertools.groupby(words[i] == words[i + q] for i in range(len(words) - q)):
            n = len(list(group))
            if agree and n + q >= max(min_length, min_exponent * q):
                found.setdefault((at, n + q), q)
            at += n
    return sorted((s, n, q) for (s, n), q in found.items())


def test_the_search_finds_all_runs():
    r = random.Random(5)
    assert periodic.gram_length(6, 4) == 5
    for _ in range(600):
        docs = []
        for _ in range(r.randint(1, 4)):
            w = [r.randrange(r.choice([1, 2, 3, 8])) for _ in range(r.randint(0, 50))]
            if w and r.random() < 0.5:
                a, p = r.randrange(len(w)), r.randint(1, 6)
                w = w[:a] + [(w[a:] + [9] * 6)[i % p] for i in range(r.randint(0, 60))] + w[a : a + 5]
            docs.append(w)
        least, times = r.choice([(6, 4), (6, 4), (4, 2), (2, 2), (10, 3), (5, 5)])
        codes, doc = np.array(sum(docs, []), np.int64), np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        base = np.cumsum([0, *map(len, docs)])
        want = [(b + s, b + s + n, q) for b, d in zip(base, docs, strict=False) for s, n, q in plain_runs(d, least, times)]
        assert [tuple(map(int, x)) for x in periodic.find_runs(codes, doc, least, times)] == want


def test_runs_of_documents(spark):
    texts = ["a " * 10, "x a b a b a b a b y", "a b c " * 40 + "a b", "no run here at all or so", None, "", " \n", "q " * 5, "a\x0ba\ta  a\na\ra", "u v " * 5000, "a a a a a a b b b b b b", "one two three four five six " * 3]
    got = {r["doc_id"]: r for r in periodic.periodic_runs(table(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w = WORDS.findall(t or "")
        want = plain_runs(w[:400])
        if len(w) > 400:
            want = [(0, 10000, 2)]
        assert [tuple(x) for x in got[i]["runs"]] == want, t
        gone = {j for s, n, q in want for j in range(s + q, s + n)}
        assert got[i]["collapsed"] == " ".join(x for j, x in enumerate(w) if j not in gone)
        best = max(want, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=None)
        assert (got[i]["start"], got[i]["length"], got[i]["period"], got[i]["exponent_milli"]) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
    twice = periodic.periodic_runs(table(spark, ["a " * 8, "a " * 8, None], [None, 3, 3]))
    assert sorted(r["collapsed"] for r in twice.collect()) == ["", "a", "a"]
    assert periodic.periodic_runs(table(spark, []).limit(0)).count() == 0


def test_tails_are_as_the_contract_says(spark):
    r = random.Random(6)
    texts = [prose(r, 9, r.randint(0, 40)) for _ in range(400)] + [None, "a b"]
    ids = [*range(401), None]
    got = {row["doc_id"]: row["text"] for row in queries.with_tails(table(spark, texts, ids)).collect()}
    changed = 0
    for i, t in zip(ids, texts, strict=True):
        w = WORDS.findall(t or "")
        h = zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [x if j < a else w[a + (j - a) % p] for j, x in enumerate(w)]
            changed += 1
            assert got[i].split(" ") == w
        else:
            assert got[i] == t
    assert changed > 20


# -- spelling variants ------------------------------------------------------------------------------


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(n, ratio=10):
    best = {}
    for w in n:
        close = sorted((-n[v], v) for v in n if v != w and near(v, w))
        best[w] = (len(close), close[0][1] if close and n[close[0][1]] >= ratio * n[w] else None)
    out = {}
    for w in n:
        root = w
        while best[root][1] is not None:
            root = best[root][1]
        out[w] = (n[w], best[w][0], best[w][1], n.get(best[w][1]), root)
    return out


def test_spelling_variants_of_a_small_vocabulary(spark):
    r = random.Random(7)
    base = ["".join(r.choice("aabbé") for _ in range(r.randint(7, 9))) for _ in range(60)]
    many = [w for w in base for _ in range(r.choice([1, 2, 30, 400]))] + ["zzzzzzz"] * 4000 + ["zzzzzzzz"] * 300 + ["zzzzzzy"] * 300 + ["zzzzzyy"] * 20 + ["zzzzyyy"] * 2 + ["aaaaaaaa", "AAAAAAAA"]
    r.shuffle(many)
    texts = [" ".join(many[i::40]) for i in range(40)] + [None, "", "short", "É" * 7 + " " + "É" * 7]
    counts = {w: k for w, k in collections.Counter(x for t in texts for x in re.findall("[a-zÀ-ÿ]{7,}", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))).items() if k >= 2}
    got = {x["word"]: (x["n"], x["n_near"], x["form"], x["form_n"], x["root"]) for x in spelling.spelling_variants(table(spark, texts)).collect()}
    assert got == variants(counts)
    assert got["zzzzyyy"][4] == "zzzzzzz" and got["zzzzzzy"][2] == "zzzzzzz" and "ÉÉÉÉÉÉÉ" in got


def test_noise_is_drawn_by_document_and_run(spark):
    r = random.Random(8)
    texts = [" ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(6, 9))) for _ in range(300)) for _ in range(10)]
    texts = [t + " " + texts[0] for t in texts]
    want = collections.Counter()
    for i, t in enumerate(texts):
        for w in t.split():
            h = zlib.crc32(f"{i}:{w}".encode())
            w = w[: h % len(w)] + w[h % len(w) + 1 :] if h % 31 == 0 else w
            want[w] += 1
    got = spelling.word_counts(table(spark, texts), noise=31)
    assert {x["word"]: x["n"] for x in got.collect()} == {w: n for w, n in want.items() if n >= 2 and len(w) >= 7}


def test_near_words_of_hostile_words(spark):
    long = "".join(random.Random(9).choice("abcdef") for _ in range(20_000))
    words = ["aaaaaaa", "aaaaaaaa", "abababa", "bababab", "aabbccd", "abbccdd", long, long[:9000] + "x" + long[9001:], long[1:], long + "b" + "c", "ééééééé", "eéééééé"]
    rows = spark.createDataFrame([(w, i + 1) for i, w in enumerate(words)], "word string, n long")
    got = {(x["a"], x["b"]) for x in spelling.near_words(rows).collect()}
    assert got == {(a, b) for a in words for b in words if a != b and near(a, b)} and len(got) >= 8
    assert spelling.spelling_variants(table(spark, []).limit(0)).count() == 0
    assert spelling.spelling_variants(table(spark, ["tiny words", None])).count() == 0


def test_keys_collide_only_into_verification(spark, monkeypatch):
    plain = spelling._keys
    monkeypatch.setattr(spelling, "_keys", lambda words, ids: (plain(words, ids)[0] % 5, *plain(words, ids)[1:]))
    words = sorted({"".join(random.Random(i).choice("ab") for _ in range(7)) for i in range(40)})
    rows = spark.createDataFrame([(w, 1) for w in words], "word string, n long").coalesce(1)
    assert {(x["a"], x["b"]) for x in spelling.near_words(rows).collect()} == {(a, b) for a in words for b in words if a != b and near(a, b)}


def test_queries_derive_their_digests(spark):
    for name, column in (("op11_substring_dedup", "kept_sha256"), ("op12_periodic_runs", "collapsed_sha256")):
        rows = queries.QUERIES[name](spark, "/root/testdata/sf0.001").collect()
        assert len(rows) == 200 and all(len(x[column]) == 64 for x in rows)
    rows = queries.QUERIES["op12_periodic_runs"](spark, "/root/testdata/sf0.001").where(F.col("n_runs") == 0).collect()
    assert rows and all(x["runs_sha256"] == hashlib.sha256(b"").hexdigest() for x in rows)
