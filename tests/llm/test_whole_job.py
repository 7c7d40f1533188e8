"""Cases in which an operator once did less than its whole job."""

import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadloom.llm import langid, queries, spotsigs, tokenids

# -- op3_document_fingerprints


def _likeness_after_edit(text, after):
    one = lambda t: spotsigs.signatures(spotsigs._WORDS.codes(t))
    return spotsigs.likeness(one(text), one(spotsigs.edited(text, after)))


PROSE = "the house of my aunt stands on a hill with trees and there is a river by the road " * 20


@pytest.mark.parametrize("kind", ["no anchors", "anchors alone", "signs at the edges", "anchors far apart"])
def test_half_edited_texts_stay_alike(kind):
    rng = random.Random(3)
    words = {
        "no anchors": [f"slovo{rng.randrange(10**6)}" for _ in range(300)],
        "anchors alone": [rng.choice(spotsigs.COMMON) for _ in range(300)],
        "signs at the edges": [f"{rng.choice(('the&&&', 'of%%%', 'de***', '#la'))} wort{rng.randrange(10**6)}" for _ in range(150)],
        "anchors far apart": ["the" if i % 60 == 59 else f"slovo{rng.randrange(10**6)}" for i in range(300)],
    }[kind]
    for after in (PROSE, " ".join(f"cislo{i}" for i in range(400))):
        assert _likeness_after_edit(" ".join(words), after) > 0.2


def test_signs_at_the_edges_hide_no_anchor():
    codes = spotsigs._WORDS.codes("This*** the&&& of%%% #de $la_ && wort")
    assert [int(c) & 1 for c in codes] == [1, 1, 1, 1, 1, 0, 0]
    assert codes.all()


def test_every_anchor_starts_a_chain():
    one = lambda t: set(spotsigs.signatures(spotsigs._WORDS.codes(t)).tolist())
    assert len(one("we house they tree from river")) == 3


# -- pipeline: one row of each group


def test_near_duplicates_by_row(spark):
    import corpus_pipeline as p

    base = {k: [f"{k}{i}" for i in range(60)] for k in "xyzuvw"}
    near = lambda k, *at: " ".join("changed" if i in at else w for i, w in enumerate(base[k]))
    rows = [
        *[(3, near("x")), (5, near("x")), (5, near("y"))],  # the second text of 5 has no copy
        *[(7, near("z")), (7, near("z", 59)), (7, near("z"))],  # one id, near texts
        *[(None, near("u")), (None, near("u", 59)), (None, near("u")), (None, near("u", 0))],
        *[(None, near("v")), (9, near("v", 59))],  # an id goes before none
        *[(None, near("w")), (None, None), (None, ""), (11, None)],
    ]
    docs = spark.createDataFrame([(d, t, "en", f"s{i}", 0) for i, (d, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r["doc_id"], r["text"]) for r in p.near_duplicates(spark, docs.repartition(4), "").collect()]
    assert len(got) == len(set(got))
    one_of = lambda k: [(d, t) for d, t in got if t and ("%s30" % k) in t.split()]
    assert one_of("x") == [(3, near("x"))]
    assert one_of("y") == [(5, near("y"))]
    assert len(one_of("z")) == len(one_of("u")) == 1
    assert one_of("v") == [(9, near("v", 59))]
    assert one_of("w") == [(None, near("w"))]
    assert {(11, None), (None, None), (None, "")} <= set(got)


# -- op2_language_id, pipeline: the sample


def test_sample_is_bounded_in_rows_and_takes_null_ids(spark, monkeypatch):
    rng = random.Random(9)
    text = lambda lang: " ".join(rng.choice({"en": ("the", "thing", "other"), "de": ("schule", "ein", "ungern")}[lang]) for _ in range(12))
    rows = [(4, text("en"), "en") for _ in range(300)] + [(4, "the one thing", "en")] * 200 + [(None, text("de"), "de") for _ in range(300)]
    seen = []
    real = langid.ftrl
    monkeypatch.setattr(langid, "ftrl", lambda r, *a, **k: seen.append(len(r)) or real(r, *a, **k))
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5), per_lang=50)
    assert model.langs == ["de", "en"] and 0 < seen[0] <= 100
    assert model.predict("schule ungern")[0] == "de" and model.predict("other thing")[0] == "en"


def test_document_frequencies_are_of_all_labelled_rows(spark):
    rows = [(i, f"word{chr(97 + i % 26)} and {chr(97 + i % 7)}zz", "en" if i % 3 else "de") for i in range(200)] + [(900, None, "en"), (901, "unlabelled", None)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3), per_lang=5)
    df = sum((langid.bin_counts(t) > 0).astype(int) for _, t, _ in rows[:200])
    assert np.allclose(model.idf, np.log(201 / (1 + df)) + 1)


# -- pipeline: mixing


def test_pipeline_mixes_whole_documents(spark):
    import corpus_pipeline as p

    rng = random.Random(12)
    texts = {i: " ".join(f"w{i}x{j}" for j in range(rng.randrange(1, 90))) for i in range(150)}
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    got = p.mix_sources(spark, docs, "").collect()
    assert got and all(r["text"] == texts[r["doc_id"]] for r in got)
    words = lambda s: sum(len(r["text"].split()) for r in got if r["source"] == s)
    total = sum(len(t.split()) for t in texts.values())
    for s, share in (("s0", 1 / 6), ("s1", 2 / 6), ("s2", 3 / 6)):
        assert abs(words(s) - total * share) <= 45.5


# -- op5_packing, pipeline: whole rows


def brute_pack(rows, buckets, budget, seed=5):
    """Every row of the packing, with boundaries from the least cost over all choices."""
    import hashlib
    import itertools

    sizes = [len((t or "").split()) for _, t in rows]
    lengths = sorted(set(sizes))
    cost = lambda cuts: sum(min(c for c in cuts if c >= n) for n in sizes)
    choices = [(*c, lengths[-1]) for k in range(min(buckets, len(lengths))) for c in itertools.combinations(lengths[:-1], k)]
    best = min(map(cost, choices))
    return sizes, best, {c for c in choices if cost(c) == best}, [hashlib.md5(f"{seed}:{d}".encode()).hexdigest() for d, _ in rows]


def test_packing_whole_rows(spark):
    from roadloom.llm import packing

    rng = random.Random(4)
    rows = [(i, " ".join("w" for _ in range(rng.choice([0, 1, 2, 5, 9, 30, 31, 70])))) for i in range(120)] + [(500, None), (501, "w " * 3000)]
    got = {r["doc_id"]: r for r in packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), buckets=4, budget=100).collect()}
    sizes, best, choices, order = brute_pack(rows, 4, 100)
    assert len(got) == len(rows) and sum(r["padded_size"] for r in got.values()) == best
    tops = tuple(sorted({r["padded_size"] for r in got.values()}))
    assert tops in choices
    for b, top in enumerate(tops):
        fit = max(1, 100 // max(1, top))
        own = sorted((h, d) for h, (d, _), n in zip(order, rows, sizes, strict=True) if n <= top and (b == 0 or n > tops[b - 1]))
        for rank, (_, d) in enumerate(own):
            r = got[d]
            assert (r["bucket"], r["padded_size"], r["batch"], r["batch_docs_max"]) == (b, top, rank // fit, fit)


def test_pipeline_edges(spark, tmp_path):
    """Null and repeated ids, repeated rows, very long texts, null columns."""
    import corpus_pipeline as p

    rng = random.Random(3)
    kinds = {"en": ("the", "thing", "other", "ing"), "de": ("schule", "ein", "ungern", "sch")}
    text = lambda lang, n=40: " ".join(rng.choice(kinds[lang]) + str(rng.randrange(50)) for _ in range(n))
    rows = [(i, text(lang), lang, f"s{i % 2}", 1) for i in range(60) for lang in [rng.choice(["en", "de"])]]
    long_text = text("en", 150_000)
    rows += [(None, text("en"), "en", None, None) for _ in range(5)] + [(7, text("de"), None, "s1", None)] * 3 + [(900, long_text, "en", "s0", 0), (901, long_text + " other1", "en", "s0", 0), (902, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = p.run(spark, str(tmp_path)).collect()
    ids = [r["doc_id"] for r in out]
    assert 901 not in ids and 902 not in ids
    kept = [(r["doc_id"], r["text"]) for r in p.near_duplicates(spark, p.language_id(spark, docs, ""), "").collect()]
    assert len(kept) == len(set(kept)) == 60 + 5 + 1 + 1
    packed = {r["doc_id"]: r for r in p.pack(spark, docs, "").collect()}
    assert packed[900]["size"] == 150_000 and packed[902]["size"] == 0 and p.pack(spark, docs, "").count() == len(rows)


# -- op3, op4: ranges


def test_ranges_of_ids(spark):
    from roadloom.llm.shared import range_part

    rng = random.Random(1)
    keys = [rng.randrange(-50, 150) for _ in range(200)] + [None, -(2**63), 2**63 - 1]
    t = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 3, 7, 16, 40):
        bounds = sorted(rng.sample(range(100), n))
        got = t.select("k", range_part(F.col("k"), bounds).alias("p")).collect()
        assert all(r["p"] == (0 if r["k"] is None else sum(b <= r["k"] for b in bounds)) for r in got)


def test_fingerprints_of_a_table(spark):
    rows = [(1, "the cat sat on the mat"), (1, "the cat sat on the mat"), (None, "the cat sat on the mat"), (2, None), (3, ""), (4, "word " * 50_000)]
    got = spotsigs.fingerprints(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, fingerprint int")).collect()
    assert len(got) == len(rows) and {r["fingerprint"] for r in got if r["doc_id"] in (2, 3)} == {""}
    assert len({r["fingerprint"] for r in got if r["doc_id"] in (1, None)}) == 1
    assert spotsigs.fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# -- op6_token_counts: large inputs


def test_buckets_with_several_tasks(spark, monkeypatch):
    import sentencepiece

    from roadloom.llm import tokencount
    from roadloom.llm.queries import tokenizer_path

    monkeypatch.setattr(tokencount, "PARTITIONS_PER_TASK", 2)
    monkeypatch.setattr(tokencount, "KNOWN", 5)
    path = tokenizer_path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(2)
    rows = [(i, " ".join(f"word{rng.randrange(40)}" for _ in range(rng.randrange(30)))) for i in range(90)]
    got = {r["doc_id"]: r["n_tokens"] for r in tokencount.count_tokens(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), path).collect()}
    assert got == {i: len(model.encode(t)) for i, t in rows}


def hot_table(spark, n=3000):
    """A third without an id, a third of one id (half of those alike), the others apart."""
    rows = [(None if i % 3 == 0 else 50 if i % 3 == 1 else i, "the same text" if i % 6 == 1 else f"the text number {i}") for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


def test_no_range_is_much_larger_than_another(spark):
    from roadloom.llm.shared import Ranges

    t = hot_table(spark)
    ranges = Ranges(t, "doc_id", 12)
    got = t.select("doc_id", ranges.part(F.col("doc_id")).alias("part")).collect()
    sizes = collections.Counter(r["part"] for r in got)
    assert max(sizes.values()) <= 2 * len(got) / len(sizes) and len(sizes) >= 10 and max(sizes) < ranges.count
    low = lambda i: -1 if i is None else i
    spans = sorted((p, min(low(r["doc_id"]) for r in got if r["part"] == p), max(low(r["doc_id"]) for r in got if r["part"] == p)) for p in sizes)
    assert all(a[2] <= b[1] for a, b in zip(spans, spans[1:], strict=False))
    for rows in ([], [(None,)], [(2**63 - 1,)] * 9 + [(-(2**63),)] * 9):
        edge = spark.createDataFrame(rows, "k long")
        ranges = Ranges(edge, "k", 4)
        assert all(0 <= r["p"] < ranges.count for r in edge.select(ranges.part(F.col("k")).alias("p")).collect())


def test_hot_ids_in_fingerprints_and_token_ids(spark, tmp_path):
    t = hot_table(spark)
    got = spotsigs.compare_with_next(t, parts=12).collect()
    assert collections.Counter(r["doc_id"] for r in got) == collections.Counter(r["doc_id"] for r in t.collect())
    one = lambda x: spotsigs.spell(spotsigs.signatures(spotsigs._WORDS.codes(x)))
    assert collections.Counter((r["doc_id"], r["fingerprint"]) for r in got) == collections.Counter((r["doc_id"], one(r["text"])) for r in t.collect())
    # every edited text is that of some next row: all of the next id's, or one of the same
    texts = collections.defaultdict(set)
    for r in t.collect():
        texts[r["doc_id"]].add(r["text"])
    ids = sorted((i for i in texts if i is not None), reverse=True) + [None]
    after = {i: texts[i] | texts[ids[(n + 1) % len(ids)]] for n, i in enumerate(ids)}
    digest = lambda x, y: hashlib.sha256(spotsigs.edited(x, y).encode()).hexdigest()
    possible = {i: {digest(x, y) for x in texts[i] for y in after[i]} for i in ids if i is not None and i != 50}
    assert all(r["edited_sha256"] in possible[r["doc_id"]] for r in got if r["doc_id"] in possible)
    manifest = tokenids.write_ids(t, queries.tokenizer_path("byte_bpe_50k.json"), str(tmp_path / "ids"), parts=12)
    sizes = [r["n_docs"] for r in manifest.collect()]
    assert sum(sizes) == 3000 and max(sizes) <= 2 * 3000 / len(sizes)
    rows = sorted(tokenids.read_ids(manifest, str(tmp_path / "ids")).collect(), key=lambda r: r["start"])
    low = lambda i: -1 if i is None else i
    assert [low(r["doc_id"]) for r in rows] == sorted(low(r["doc_id"]) for r in rows)
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(rows, rows[1:], strict=False))
