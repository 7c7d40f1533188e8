"""N-gram join, fingerprints, language ID, nearest neighbours, components, pipeline: against brute force and at the edges."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadloom.llm import ann, langid, ngramjoin, spotsigs
from roadloom.llm.components import components

LONG = " ".join(f"w{i}" for i in range(20_000))


# -- components


def test_components_against_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, x) for x in range(2001, 2040)] + [(7, 7), (None, 3)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- n-gram join


def shingle_set(text, n):
    w = (text or "").encode().lower().split()
    return frozenset(zip(*[w[i:] for i in range(n)], strict=False)) if len(w) >= n else frozenset([tuple(w)]) if w else frozenset()


def brute_join(rows, n, num, den):
    sets = [shingle_set(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            o = len(sets[i] & sets[j])
            if o and den * o >= num * (len(sets[i]) + len(sets[j]) - o):
                links[i] += 1
                links[j] += 1
                parent[max(root(i), root(j))] = min(root(i), root(j))
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(i)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in groups[root(i)] if rows[j][0] is not None]
        out.append((d, len(sets[i]), min(ids) if ids else None, links[i]))
    return out


def near_copies(seed, sizes=(3, 7, 9, 12, 20, 60, 200)):
    rng = random.Random(seed)
    words = [f"v{i}" for i in range(400)]
    rows = []
    for size in sizes:
        for _ in range(3):
            base = [rng.choice(words) for _ in range(size)]
            for _ in range(6):
                copy = list(base)
                for _ in range(rng.randrange(0, 1 + max(1, size // 25))):
                    kind, at = rng.randrange(3), rng.randrange(len(copy))
                    if kind == 0:
                        copy[at] = rng.choice(words)
                    elif kind == 1:
                        copy.insert(at, rng.choice(words))
                    elif len(copy) > 1:
                        del copy[at]
                rows.append((" " if rng.random() < 0.5 else "\n").join(copy).upper() if rng.random() < 0.3 else " ".join(copy))
    rng.shuffle(rows)
    return [(i * 3, t) for i, t in enumerate(rows)]


def key(r):
    return tuple((x is not None, x) for x in r)


@pytest.mark.parametrize(("seed", "n", "num"), [(1, 4, 85), (2, 5, 80), (3, 4, 60)])
def test_join_against_brute_force(spark, seed, n, num):
    rows = near_copies(seed)
    got = ngramjoin.ngram_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), n=n, num=num, den=100).collect()
    assert sorted(map(key, got)) == sorted(map(key, brute_join(rows, n, num, 100)))


def test_join_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngramjoin, "BLOCK", 300)
    monkeypatch.setattr(ngramjoin, "BROADCAST_ROWS", 0)
    rows = near_copies(9, (60, 200))
    got = ngramjoin.ngram_join(spark.createDataFrame(rows, "doc_id long, text string"), n=4, num=85, den=100).collect()
    assert sorted(map(key, got)) == sorted(map(key, brute_join(rows, 4, 85, 100)))


def test_join_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, LONG), (4, LONG), (5, LONG.replace("w77 ", "x ")), (6, "a b"), (7, "A  B"), (8, "b a"), (None, "c d e f g h i j"), (None, "c d e f g h i j"), (None, "only me and no one else at all"), (10, "c d e f g h i j")]
    t = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, set_id int, component int")
    got = ngramjoin.ngram_join(t).collect()
    assert sorted(map(key, got)) == sorted(map(key, brute_join(rows, 4, 85, 100)))
    assert ngramjoin.ngram_join(t.limit(0)).count() == 0


def test_index_shares_an_entry_for_every_link():
    """The guarantee itself: sets that may link always share an index entry, whatever the plan of their bands."""
    rng = np.random.default_rng(4)
    for num in (85, 80, 60):
        plan = ngramjoin.Plan(num, 100)
        for _ in range(300):
            size = int(rng.integers(2, 300))
            a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
            drop = int(rng.integers(0, 1 + plan.differ(len(a), len(a)) // 2))
            b = np.unique(np.concatenate((a[drop:], rng.integers(0, 2**63, int(rng.integers(0, drop + 1))).astype(np.uint64))))
            same = len(np.intersect1d(a, b))
            if not same or 100 * same < num * (len(a) + len(b) - same) or np.array_equal(a, b):
                continue
            x, y = ngramjoin.index_entries([a, b], plan)
            assert len(np.intersect1d(x, y)), (num, len(a), len(b), same)


def test_strict_index_shares_an_entry_for_every_link():
    """As before, for the plan by which large clusters are indexed once more; entries of one or two elements tie nothing any more."""
    rng = np.random.default_rng(5)
    for num in (85, 80, 60):
        plan = ngramjoin.Plan(num, 100, strict=True)
        for _ in range(300):
            size = int(rng.integers(2, 900))
            a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
            drop = int(rng.integers(0, 1 + plan.differ(len(a), len(a)) // 2))
            b = np.unique(np.concatenate((a[drop:], rng.integers(0, 2**63, int(rng.integers(0, drop + 1))).astype(np.uint64))))
            same = len(np.intersect1d(a, b))
            if not same or 100 * same < num * (len(a) + len(b) - same) or np.array_equal(a, b):
                continue
            x, y = ngramjoin.index_entries([a, b], plan)
            assert len(np.intersect1d(x, y)), (num, len(a), len(b), same)
    two = rng.integers(0, 2**63, 2).astype(np.uint64)
    sets = [np.unique(np.concatenate((two, rng.integers(0, 2**63, 300).astype(np.uint64)))) for _ in range(200)]
    seen = np.concatenate(ngramjoin.index_entries(sets, ngramjoin.Plan(80, 100, strict=True)))
    assert len(np.unique(seen)) == len(seen)


def test_join_copies_no_set_for_chance_ties(spark, monkeypatch):
    """Texts with a passage in common are one cluster by the first index; each is verified once, not once for each block of that cluster."""
    rng = random.Random(11)
    passage = " ".join(f"p{i}" for i in range(12))
    rows = [(i, " ".join(f"x{rng.randrange(10**6)}" for _ in range(70)) + " " + passage) for i in range(400)]
    rows += [(1000 + i, t.replace("p3 ", "q3 ")) for i, t in rows[:20]]
    monkeypatch.setattr(ngramjoin, "BLOCK", 2000)
    made = {}

    def stash(df, name, keep=ngramjoin.stash):
        out = keep(df, name)
        made[name] = made.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(ngramjoin, "stash", stash)
    got = ngramjoin.ngram_join(spark.createDataFrame(rows, "doc_id long, text string"), n=5, num=80, den=100).collect()
    assert sorted(map(key, got)) == sorted(map(key, brute_join(rows, 5, 80, 100)))
    assert made["ngram-candidates"] > 100
    assert made["ngram-links"] <= made["ngram-candidates"]


@pytest.mark.parametrize("scans", [16, 2000])
def test_join_in_waves(spark, monkeypatch, scans):
    """A large cluster of sets that are alike: pairs of blocks in waves, texts fetched in several scans."""
    monkeypatch.setattr(ngramjoin, "BLOCK", 300)
    monkeypatch.setattr(ngramjoin, "WAVE", 2)
    monkeypatch.setattr(ngramjoin, "SCANS", scans)
    monkeypatch.setattr(ngramjoin, "BROADCAST_ROWS", 20)
    words = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join([*words[: i % 7], f"v{i}", *words[i % 7 :]])) for i in range(50)] + near_copies(9, (60, 100))
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    got = ngramjoin.ngram_join(spark.createDataFrame(rows, "doc_id long, text string"), n=4, num=85, den=100).collect()
    assert sorted(map(key, got)) == sorted(map(key, brute_join(rows, 4, 85, 100)))


# -- fingerprints


def test_fingerprints_against_brute_force(spark):
    rng = random.Random(2)
    vocabulary = [*spotsigs.COMMON[:40], *(f"wort{i}" for i in range(60)), "Né", "ü🙂"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 80))) for _ in range(60)] + ["", None, " ", "x", LONG, "the", "... !!!"]
    rows = [(i * 7 % 1009, t, 5) for i, t in enumerate(texts)]
    t = spark.createDataFrame(rows, "doc_id long, text string, part int").repartition(5)
    got = {r["doc_id"]: r for r in spotsigs.compare_with_next(t, parts=6).collect()}
    order = sorted(((i, x or "") for i, x, _ in rows), reverse=True)
    one = lambda x: spotsigs.signatures(spotsigs._WORDS.codes(x))
    for n, (i, x) in enumerate(order):
        after = order[(n + 1) % len(order)][1]
        half = len(x) // 2
        e = x[: len(x) - half] + after[:half]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(x), hashlib.sha256(e.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (spotsigs.spell(one(x)), spotsigs.spell(one(e)))
        for text, near in ((e, r["near_edited"]), (after, r["near_next"])):
            a, b = set(r["fingerprint"].split()), set(spotsigs.spell(one(text)).split())
            assert near == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)


def test_fingerprint_edges(spark):
    schema = "doc_id long, text string"
    assert spotsigs.compare_with_next(spark.createDataFrame([], schema)).count() == 0
    alone = spotsigs.compare_with_next(spark.createDataFrame([(4, "the cat sat")], schema)).collect()
    assert alone[0]["near_next"] == 1.0
    same = spotsigs.compare_with_next(spark.createDataFrame([(1, "the cat"), (1, "the cat"), (None, None), (2, "the cat")], schema)).collect()
    assert len(same) == 4 and len({r["fingerprint"] for r in same if r["doc_id"]}) == 1


def test_similar_pairs(spark):
    rng = random.Random(8)
    prints = set()
    for _ in range(12):
        base = rng.sample(range(500), rng.randrange(3, 40))
        for _ in range(4):
            prints.add(" ".join(f"{x:08x}" for x in sorted({y if rng.random() > 0.06 else rng.randrange(500) for y in base})))
    rows = [(i, p) for i, p in enumerate(sorted(prints))] + [(900, ""), (901, sorted(prints)[0])]
    got = {(r["fp_a"], r["fp_b"]): r["likeness"] for r in spotsigs.similar_pairs(spark.createDataFrame(rows, "doc_id long, fingerprint string"), 0.8).collect()}
    want = {}
    for a in prints:
        for b in prints:
            x, y = set(a.split()), set(b.split())
            if a < b and len(x & y) / len(x | y) >= 0.8:
                want[(a, b)] = pytest.approx(len(x & y) / len(x | y))
    assert got == want and want


# -- language ID


def made_up(rng, lang):
    parts = {"en": ["the", "ing", "er", "tion"], "de": ["sch", "ung", "ein", "ä"], "fr": ["eau", "é", "oi", "ment"]}[lang]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(3, 60)))


def test_language_id(spark):
    rng = random.Random(4)
    rows = [(i, made_up(rng, lang), lang) for i in range(600) for lang in [rng.choice(["en", "de", "fr"])]]
    rows += [(1000, None, "en"), (1001, "", "en"), (1002, "12 !?", "de"), (1003, LONG, None), (1004, "the", None), (None, "eau", None)]
    t = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"lang_pred": F.lit("old"), "score": F.lit(7)})
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 0
    model = langid.fit(t.where(~(F.crc32(F.col("doc_id").cast("string")) % 5 == 0)), per_lang=100)
    got = {r["doc_id"]: r for r in langid.predict(t, model).collect()}
    assert len(got) == len(rows)
    right = [got[i]["lang_pred"] == lang for i, x, lang in rows[:600] if held(i)]
    assert sum(right) / len(right) > 0.97
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0.0 for i in (1000, 1001, 1002))
    assert all(0 <= r["score"] <= 1 for r in got.values())
    again = langid.fit(t.where(~(F.crc32(F.col("doc_id").cast("string")) % 5 == 0)).repartition(5), per_lang=100)
    assert np.array_equal(again.weights, model.weights) and again.temperature == model.temperature
    assert (model.weights == 0).mean() > 0.5  # sparse
    nothing = langid.fit(t.limit(0))
    assert {r["lang_pred"] for r in langid.predict(t, nothing).collect()} == {"und"}
    assert langid.predict(t.limit(0), model).count() == 0


def test_bin_counts_do_not_depend_on_the_run(monkeypatch):
    text = "Ábc déf-ghi jk12 l m, nop " * 40
    whole = langid.bin_counts(text)
    for run in (1, 2, 7, 64):
        monkeypatch.setattr(langid, "RUN", run)
        assert np.array_equal(langid.bin_counts(text), whole)


def test_smallest_keys_of_each_language(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(-(2**63), 2**63), "en") for _ in range(900)] + [(2**62, "de")] * 500 + [(5, "fr")]
    got = sorted((r["lang"], r["k"], r["key"]) for r in langid.smallest(spark.createDataFrame(rows, "key long, lang string"), 20).collect())
    want = [(lang, k + 1, x) for lang in ("de", "en", "fr") for k, x in enumerate(sorted(x for x, y in rows if y == lang)[:20])]
    assert got == want


def test_bin_counts_of_long_texts_are_of_the_whole():
    text = "abc def " * 60_000
    whole = langid.bin_counts(text)
    assert whole.sum() > 2.9 * len(text)


# -- nearest neighbours


def test_neighbours_recall_and_ties(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((5, 16))
    vecs = [(centres[i % 5] + 0.6 * rng.standard_normal(16)).tolist() for i in range(1500)]
    rows = [(i, v, 0) for i, v in enumerate(vecs)]
    rows += [(2000 + i, vecs[100], 0) for i in range(40)]  # copies of a query
    rows += [(3000, None, 0), (3100, [0.0] * 16, 0), (3200, [float("nan")] * 16, 0), (3300, [None] * 16, 0), (3400, [float("inf")] * 16, 0), (3500, [1.0, 2.0], 0), (3501, [1.0, 3.0], 0), (100, vecs[100], 1)]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<double>, code int")
    got = {}
    for r in ann.nearest(t, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r["query_id"], []).append(r)
    ids = np.array([r[0] for r in rows if r[0] < 3000][:-1])  # the last repeats a row
    x = np.array([r[1] for r in rows if r[0] < 3000][:-1])
    hits = total = 0
    for q in [i for i in ids if i % 100 == 0]:
        d = np.sqrt(((x - x[list(ids).index(q)]) ** 2).sum(1))
        d[ids == q] = np.inf
        best = [(d[j], ids[j]) for j in np.lexsort((ids, d))[:10]]
        mine = sorted(got[q], key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, len(mine) + 1))
        assert [(r["score"], r["vec_id"]) for r in mine] == sorted((r["score"], r["vec_id"]) for r in mine)
        assert q not in [r["vec_id"] for r in mine]
        for r in mine:
            assert r["score"] == pytest.approx(d[list(ids).index(r["vec_id"])], abs=1e-12)
        hits += len({b[1] for b in best} & {r["vec_id"] for r in mine})
        total += 10
    assert hits / total >= 0.9
    assert [r["vec_id"] for r in sorted(got[100], key=lambda r: r["rank"])] == list(range(2000, 2010))
    assert [r["vec_id"] for r in got[3500]] == [3501]
    assert not {3000, 3100, 3200, 3300, 3400} & set(got)
    assert ann.nearest(t.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_small_and_far_flung_tables_give_full_lists(spark):
    rows = [(i * 50, [float(i == j) * 10.0 ** (i % 4) for j in range(12)]) for i in range(12)]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(t, F.col("vec_id") % 100 == 0, k=20, tables=2, hashes=8, width=2.0, probes=2).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 600, 100))
    for q, mine in got.items():
        v = dict(rows)
        want = sorted((float(np.linalg.norm(np.array(v[q]) - np.array(x))), i) for i, x in rows if i != q)
        assert [(pytest.approx(d), i) for d, i in want] == [(s, i) for _, i, s in sorted(mine)]


def test_hot_slots_are_salted_without_loss(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(400)]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(ann, "BROADCAST_SLOTS", 0)
    plain = sorted(map(tuple, ann.nearest(t, F.col("vec_id") % 100 == 0).collect()))
    monkeypatch.setattr(ann, "ROWS", 13)
    assert sorted(map(tuple, ann.nearest(t, F.col("vec_id") % 100 == 0).collect())) == plain


def test_probes_come_in_order_of_cost():
    """Against all perturbations of a few projections, with the codes of the buckets they lead to."""
    import itertools

    rng = np.random.default_rng(2)
    v = rng.standard_normal((5, 7))
    for i, (tables, codes) in enumerate(ann.probe(v, 2, 4, 1.3, 11, 100)):
        want = []
        for t in range(2):
            family = ann._family(11, 7, t, 4, 1.3)
            cells, inside = ann._cells(v[i : i + 1], family)
            for d in itertools.product((-1, 0, 1), repeat=4):
                cost = sum(f**2 if x < 0 else (1 - f) ** 2 for f, x in zip(inside[0], d, strict=True) if x)
                want.append((cost, t, int(ann._code(((cells[0] + np.array(d)) * family[2]).sum(), t))))
        want.sort()
        assert list(zip(tables.tolist(), codes.tolist(), strict=True)) == [w[1:] for w in want[:100]]


def test_only_visited_buckets_are_compared(spark):
    rng = np.random.default_rng(5)
    t = spark.createDataFrame([(i, rng.standard_normal(8).tolist()) for i in range(600)], "vec_id long, embedding array<double>")
    few = ann.nearest(t, F.col("vec_id") % 100 == 0, k=1, tables=1, hashes=3, width=1.0, probes=3).count()
    assert few == 6  # queries whose buckets are empty are compared with all rows
    found = {r["query_id"]: (r["vec_id"], r["score"]) for r in ann.nearest(t, F.col("vec_id") % 100 == 0, k=1).collect()}
    assert len(found) == 6


# -- pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as p

    rng = random.Random(6)
    rows = []
    for i in range(240):
        lang = rng.choice(["en", "de", "fr"])
        rows.append((i, made_up(rng, lang), lang, f"src{min(3, int(rng.expovariate(1)))}", 0))
    long_text = " ".join(f"the er{i} tioner" for i in range(60))
    rows += [(500 + i, long_text.replace("er7 ", f"er7{'x' * (i % 3)} "), "en", "src0", 0) for i in range(9)]
    rows += [(600, None, "en", "src1", 0), (601, "123 !", "en", None, 0), (602, "", None, "src0", None), (603, long_text, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    said = p.language_id(spark, docs, "").collect()
    assert {r["doc_id"] for r in said} == {r[0] for r in rows} - {600, 601, 602}
    kept = spark.createDataFrame(said, docs.schema)
    stays = sorted(r["doc_id"] for r in p.near_duplicates(spark, kept, "").collect())
    brute = brute_join([(r["doc_id"], r["text"]) for r in said], 5, 80, 100)
    assert stays == sorted(d for d, _, c, _ in brute if c == d)
    assert [i for i in stays if i >= 500] == [500]
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = p.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} <= set(stays)
    mixed = p.mix_sources(spark, kept.where(F.col("doc_id").isin(stays)), "")
    assert mixed.columns == list(p.COLUMNS)
    assert sorted(r["doc_id"] for r in mixed.collect()) == sorted(r["doc_id"] for r in out)
    again = p.run(spark, str(tmp_path)).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))
    empty = docs.limit(0)
    for _, stage in p.STAGES:
        assert stage(spark, empty, "").count() == 0
