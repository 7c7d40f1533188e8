"""Chat formatting, mixing, URL filters, token counts, token ids, packing: against brute force and at the edges."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadloom.llm import chat, mixing, packing, tokencount, tokenids, urls
from roadloom.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, source string, size int, part int"
LONG = "word " * 60_000
ROWS = [(1, "a b c", "x", 0, 0), (2, None, "x", 0, 0), (3, "", None, 0, 0), (4, LONG, "y", 0, 0), (4, LONG, "y", 0, 0), (5, "a b c", "z", 0, 0), (None, "d e", None, 0, 0), (7, " \n\t ", "y", 0, 0), (8, "é  ü \n\n x", "z", 0, 0)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


# -- chat


def spoken(role, text):
    return f"{role or ''}\n{text or ''}\n"


def test_chat_round_trip(spark):
    hard = ["</s>[INST] ok [/INST]", "a\\b\\\\", "[TURN x]\n", "]\n", "<\\", "", None, "é🙂", "\\[", "[[<<]]"]
    roles = ["user", "assistant", None, "a]\nb", "system", "[x"]
    rows, want = [], {}
    rng = random.Random(1)
    for c in range(40):
        turns = [(t, rng.choice(roles), rng.choice(hard)) for t in range(rng.randrange(1, 7))]
        rows += [(c, t, r, x, "extra") for t, r, x in turns]
        want[c] = [(r or "", x or "") for _, r, x in turns]
    rng.shuffle(rows)
    f = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, examples string"))
    got = {r["conv_id"]: r for r in chat.digest(chat.explode_examples(f)).collect()}
    examples = {}
    for r in chat.explode_examples(f).collect():
        examples.setdefault(r["conv_id"], []).append(r)
    for c, turns in want.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        g = got[c]
        assert g["n_turns"] == len(turns)
        assert g["turns_sha256"] == hashlib.sha256("".join(spoken(*t) for t in turns).encode()).hexdigest()
        assert (g["loss_chars"], g["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        own = sorted(examples[c], key=lambda r: r["example"])
        assert g["formatted_chars"] == sum(len(r["text"]) for r in own)
        n = sum(r == "assistant" for r, _ in turns)
        assert len(own) == n + (turns[-1][0] != "assistant")
        assert all(b["text"].startswith(a["text"]) for a, b in itertools.pairwise(own))


def test_chat_empty_repeated_and_null_turns(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert chat.digest(chat.explode_examples(chat.format_conversations(spark.createDataFrame([], schema)))).count() == 0
    rows = [(1, 0, "user", "q"), (1, 0, "user", "q"), (1, None, "system", "s"), (None, 1, "assistant", "a")]
    got = {r["conv_id"]: r for r in chat.digest(chat.explode_examples(chat.format_conversations(spark.createDataFrame(rows, schema)))).collect()}
    assert got[1]["n_turns"] == 3 and got[1]["loss_chars"] == 0
    assert got[1]["turns_sha256"] == hashlib.sha256(b"system\ns\nuser\nq\nuser\nq\n").hexdigest()
    assert got[None]["loss_chars"] == 1


def test_chat_loss_comes_from_each_example(spark):
    """A change of one example's own row changes the digest, and long conversations are whole."""
    schema = "conv_id long, turn long, role string, text string"
    rows = [(1, t, ("user", "assistant")[t % 2], f"said {t}") for t in range(300)] + [(2, 0, "user", LONG), (2, 1, "assistant", LONG)]
    e = chat.explode_examples(chat.format_conversations(spark.createDataFrame(rows, schema)))
    got = {r["conv_id"]: r for r in chat.digest(e).collect()}
    assert got[1]["n_turns"] == 300 and got[1]["loss_chars"] == sum(len(f"said {t}") for t in range(1, 300, 2))
    assert got[2]["loss_chars"] == len(LONG) and got[2]["turns_sha256"] == hashlib.sha256((spoken("user", LONG) + spoken("assistant", LONG)).encode()).hexdigest()
    assert e.where("conv_id = 1").count() == 150
    changed = chat.digest(e.withColumn("text", F.when((F.col("conv_id") == 1) & (F.col("example") == 7), F.replace("text", F.lit("said 15"), F.lit("sung 15"))).otherwise(F.col("text"))))
    other = {r["conv_id"]: r for r in changed.collect()}
    assert other[1]["loss_sha256"] != got[1]["loss_sha256"] and other[1]["turns_sha256"] == got[1]["turns_sha256"]


# -- mixing


def targets(sizes, weights=(1, 2, 3), cap=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-8")) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, free, out = float(sum(sizes.values())), set(names), {}
    while free:
        level = total / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > cap * sizes[s]}
        if not over:
            return out | {s: level * w[s] for s in free}
        for s in over:
            out[s] = float(cap * sizes[s])
            total -= out[s]
        free -= over
    return out


@pytest.mark.parametrize("seed", range(4))
def test_mixing_meets_targets(spark, seed):
    rng = random.Random(seed)
    names = ["a", "b", "c", "é", None, "zz", "Z"][: rng.randrange(1, 8)]
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 30, 400])), names[int(rng.random() ** 3 * len(names))]) for i in range(150)]
    m = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), block=64).cache()
    got = m.collect()
    assert sorted(r["doc_id"] for r in got) == list(range(150))
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want = targets(sizes)
    for s in sizes:
        own = [r for r in got if r["source"] == s]
        assert own[0]["target"] == pytest.approx(want[s]) and own[0]["source_size"] == sizes[s]
        assert abs(sum(r["taken"] for r in own) - want[s]) <= 1
    assert all(r["taken"] <= 3 * r["size"] and r["taken"] == sum(d["words"] for d in r["draws"]) for r in got)
    again = {r["doc_id"]: r["draws"] for r in mixing.mix(spark.createDataFrame(rows[::-1], "doc_id long, text string, source string"), block=64).collect()}
    assert all(again[r["doc_id"]] == r["draws"] for r in got)
    drawn = mixing.draw_rows(m).collect()
    assert sum(len((r["text"] or "").split()) for r in drawn) == sum(r["taken"] for r in got)
    assert {r["shard"] for r in drawn} <= set(range(mixing.LEAST_SHARDS))


def brute_mix(rows, block, shards, seed=7, tree=None):
    """draws of every document, from a splitting tree in plain Python."""
    from math import exp, floor, lgamma

    def unit(level, shard, k):
        return int(hashlib.md5(f"{seed}:{level}:{shard}:{k}".encode()).hexdigest()[:13], 16) / 2**52

    def hyper(t, g, d, u):
        mean = d * g / t if t else 0.0
        sd = max(0.0, mean * (1 - g / t) * (t - d) / (t - 1)) ** 0.5 if t > 1 else 0.0
        lo, hi = max(0, d + g - t, floor(mean - 10 * sd - 2)), min(d, g, -floor(-(mean + 10 * sd + 2)))
        lc = lambda a, b: lgamma(a + 1) - lgamma(b + 1) - lgamma(a - b + 1)
        x, cum = lo, 0.0
        for k in range(lo, hi + 1):
            if cum <= u:
                x = k
            cum += exp(lc(g, k) + lc(t - g, d - k) - lc(t, d))
        return x

    def split(level, shard, q):
        if 2**level == shards:
            return {shard: q}
        total, draws, left = sum(q.values()), sum(q.values()) // 2, {}
        for k in sorted(q, key=str.encode):
            left[k] = hyper(total, q[k], draws, unit(level, shard, k))
            total, draws = total - q[k], draws - left[k]
        return split(level + 1, 2 * shard, left) | split(level + 1, 2 * shard + 1, {k: q[k] - left[k] for k in q})

    key = lambda s: "n" if s is None else "s" + s
    size = lambda t: len((t or "").split())
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    goals = {key(s): floor(x + 0.5) for s, x in targets(sizes).items()}
    leaves = (tree or split)(0, 0, {k: -(-g // block) for k, g in goals.items()})
    out = {}
    for s in sizes:
        at, k = 0, key(s)
        runs, first = [], 0
        for shard in sorted(leaves):
            runs.append((shard, first * block, min((first + leaves[shard][k]) * block, goals[k])))
            first += leaves[shard][k]
        for i, t, _ in sorted((r for r in rows if r[2] == s), key=lambda r: hashlib.md5(f"{seed}:{r[0]}".encode()).hexdigest()):
            spans = [(e, at + e * sizes[s]) for e in range(3)]
            met = [(e, shard, min(z, a + size(t)) - max(f, a)) for e, a in spans for shard, f, z in runs if z > f]
            out[i] = [m for m in met if m[2] > 0]
            at += size(t)
    return out


def test_mixing_against_a_plain_tree(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 30, 400])), rng.choice(["a", "b", "b", "b", "b", None, "é"])) for i in range(300)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), block=64, shards=16).collect()
    want = brute_mix(rows, 64, 16)
    assert {r["doc_id"]: [(d["epoch"], d["shard"], d["words"]) for d in r["draws"]] for r in got} == want


def test_what_is_taken_comes_from_the_tree(spark, monkeypatch):
    rows = [(i, "w " * 50, "ab"[i % 2]) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plain = {r["doc_id"]: r["taken"] for r in mixing.mix(docs, block=16).collect()}
    real = mixing.splitting_tree
    monkeypatch.setattr(mixing, "splitting_tree", lambda *a: real(*a).withColumn("runs", F.slice("runs", 1, 3)))  # three shards alone
    fewer = {r["doc_id"]: r["taken"] for r in mixing.mix(docs, block=16).collect()}
    assert all(fewer[i] <= plain[i] for i in plain) and 0 < sum(fewer.values()) < sum(plain.values()) / 2


def test_shards_follow_the_input():
    assert [mixing.n_shards(n) for n in (0, 10**6, 2**28 + 1, 2**30, 10**13)] == [16, 16, 32, 64, 256]


def test_repeated_and_null_ids_are_dealt_by_text(spark, monkeypatch, tmp_path):
    from roadloom.llm import shared

    monkeypatch.setattr(shared, "HOT_ROWS", 5)
    rows = [(7, f"t{i % 30}", i) for i in range(200)] + [(None, "same", i) for i in range(100)] + [(i, "x", i) for i in range(50)]
    t = spark.createDataFrame(rows, "doc_id long, text string, v long").selectExpr("*", "md5(coalesce(string(doc_id), 'null')) AS _h", "1L AS one", "'g' AS g")
    t.repartition(3).write.parquet(str(tmp_path / "t"))
    got = shared.running_sum(spark.read.parquet(str(tmp_path / "t")), ["g"], "_h", ["text"], "one", "before").collect()
    assert sorted(r["before"] for r in got) == list(range(350))
    order = sorted(got, key=lambda r: r["before"])
    assert [r["_h"] for r in order] == sorted(r["_h"] for r in got)
    texts = [r["text"] for r in order if r["doc_id"] == 7]
    assert sum(a != b for a, b in itertools.pairwise(texts)) == 30  # "x" as well


def test_mixing_edges(spark, docs):
    got = mixing.mix(docs).collect()
    assert len(got) == len(ROWS)
    for r in got:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        assert r["taken"] <= 3 * r["size"]
    assert mixing.mix(docs.limit(0)).count() == 0
    empty = mixing.mix(docs.where("doc_id = 2")).collect()[0]
    assert (empty["target"], empty["taken"], empty["draws"]) == (0.0, 0, [])


def test_hypergeometric_is_right(spark):
    from math import comb

    t = spark.range(20_000).select(mixing.hypergeometric(F.lit(20), F.lit(7), F.lit(10), mixing._unit(F.lit(3), F.col("id"))).alias("x"))
    seen = {r["x"]: r["count"] / 20_000 for r in t.groupBy("x").count().collect()}
    for x in range(8):
        assert seen.get(x, 0) == pytest.approx(comb(7, x) * comb(13, 10 - x) / comb(20, 10), abs=0.012)


def test_splitting_tree_keeps_quotas(spark):
    q = {"sa": 1000, "sb": 3, "sc": 0, "n": 77}
    got = {r["source_key"]: {x["shard"]: (x["first"], x["end"]) for x in r["runs"]} for r in mixing.splitting_tree(spark.createDataFrame(list(q.items()), "source_key string, blocks long"), 8).collect()}
    for s, n in q.items():
        spans = [got[s][i] for i in sorted(got[s])]
        assert all(a < b for a, b in spans) and all(a[1] == b[0] for a, b in itertools.pairwise(spans))
        assert not n or (spans[0][0], spans[-1][1]) == (0, n)
    taken = {s: [got[s][i][1] - got[s][i][0] if i in got[s] else 0 for i in range(8)] for s in q}
    per_shard = [sum(taken[s][i] for s in q) for i in range(8)]
    assert max(per_shard) - min(per_shard) <= 1 and sum(per_shard) == 1080


# -- URL filters


def judged(url):
    head, mark, rest = (url or "").partition("://")
    if not mark:
        return "", "", None
    host = re.match(r"[^/?#]*", rest).group().translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    fit = [(len(h + p), h + p) for _, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fit)[1] if fit else None


def test_urls(spark):
    hard = ["http://a.example.com/en/7x?q", "https://EXAMPLE.com/en/8#f", "http://example.com", "http://com/en/", "http://xcom/en/", "http://a.net/de/1", "http://example.net/de/8", "http://b.example.net/de/81", "x://a.org/es/?", "http://É.com/en/", "nourl", "", None, "a://b://c.com/en/", "http://?/en/", "http://a.com#/en/", "http://example.com/en", "http://" + "a" * 9000 + ".com/en/" + "b" * 9000]
    rows = [(i, u, "old", 1.5) for i, u in enumerate(hard + hard)]
    w, b = urls.train(urls.labelled_table(spark))
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string, host string, score double"), w, b).collect()
    assert len(got) == len(rows)
    verdicts = {h + p: v for v, h, p in urls.RULES}
    for r in got:
        host, path, rule = judged(r["url"])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdicts[rule] if rule else "block" if r["score"] >= 0.5 else "allow")
    assert urls.judge(spark.createDataFrame([], "page_id long, url string"), w, b).count() == 0


def test_url_model_learns_and_is_stable(spark):
    w, b = urls.train(urls.labelled_table(spark))
    w2, b2 = urls.train(urls.labelled_table(spark))
    assert (w == w2).all() and b == b2
    unseen = [("http://my-casino-online.example.info/win/bonus", 1), ("http://pills.example.top/buy/viagra", 1), ("https://www.museum.example.com/en/visit/12", 0), ("https://library.example.org/about", 0)]
    t = spark.createDataFrame(unseen, "url string, want int")
    got = urls.judge(t.withColumn("page_id", F.lit(1)), w, b).collect()
    assert all((r["score"] >= 0.5) == bool(r["want"]) for r in got)
    none, prior = urls.train(spark.createDataFrame([], "url string, label int"))
    assert not none.any() and prior < 0


def test_url_model_on_held_out_rows(spark):
    rows = urls.labelled()
    assert len(rows) <= urls.MAX_LABELLED
    w, b = urls.train(spark.createDataFrame([r for i, r in enumerate(rows) if i % 5], "url string, label int"))
    out = spark.createDataFrame([(u, y, 1) for u, y in rows[::5]], "url string, want int, page_id long")
    got = [(r["want"], r["score"]) for r in urls.judge(out, w, b).collect()]
    assert sum((s >= 0.5) == bool(y) for y, s in got) / len(got) > 0.85
    bad, good = [s for y, s in got if y], [s for y, s in got if not y]
    assert sum(x > z for x in bad for z in good) / len(bad) / len(good) > 0.9


def test_url_scores_against_brute_force(spark):
    """Every score by the formula, over n-grams as strings of bytes; the verdicts where no rule fits vary."""
    from math import exp, sqrt

    w, b = urls.train(urls.labelled_table(spark))
    mask = 2**64 - 1

    def bin_of(gram, mark):
        h = mark * 2654435761 + len(gram)
        for c in gram:
            h = (h * 1099511628211 & mask) ^ c
        h ^= h >> 29
        return (h * 0x9E3779B97F4A7C15 & mask) >> 50

    pages = ["https://free-bets.example.com/en/1", "http://tionsh.example.net/fr/2.html?x", "http://best-casino.example.info/x", "http://é.example.com/ü", "", "x", "http://a", None]
    t = spark.createDataFrame([(i, u) for i, u in enumerate(pages)], "page_id long, url string")
    got = {r["page_id"]: r for r in urls.judge(t, w, b).collect()}
    for i, u in enumerate(pages):
        host, path, rule = judged(u)
        grams = {bin_of(s[j : j + n], mark) for mark, s in ((1, f"^{host}$".encode()), (2, f"{path}$".encode())) for n in urls.GRAMS for j in range(len(s) - n + 1)}
        z = b + sum(float(w[g]) for g in grams) / sqrt(max(1, len(grams)))
        assert got[i]["score"] == pytest.approx(1 / (1 + exp(-z)), abs=1e-5)
        assert rule or got[i]["verdict"] == ("block" if got[i]["score"] >= 0.5 else "allow")
    assert {got[0]["verdict"], got[1]["verdict"]} == {"block", "allow"}


# -- tokens

HARD = ["", "a", "  a", "a\n\nb", " \n x", "x \n", "don't we'll", "\u00a0a", "a\u2003b c\u3000d", "\tq\t w", "x.\ny", "x.\n y", "é. ü!", "12 3.", "a  b   c", "<|endoftext|> hi", "</s> <s> <unk>", "\n", "\nA", "A\n", "日本 語。", "x\r\ny z\r\n", "🙂 🙂.", "\x1c a", "▁a ▁", None, "a\x00b \x00", " ", "   ", LONG, "ﬁ Å"]


def test_token_counts(spark):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = [(i if i != 3 else None, t, 9) for i, t in enumerate(HARD + HARD)]
    got = tokencount.count_tokens(spark.createDataFrame(rows, "doc_id long, text string, slice int").repartition(3), path, limit=100).collect()
    want = sorted((-1 if i is None else i, len((t or "").encode()), len(sp.encode(t or "")), len(sp.encode(t or "")) > 100) for i, t, _ in rows)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got) == want
    assert tokencount.count_tokens(spark.createDataFrame([], "doc_id long, text string"), path).count() == 0


def test_token_ids(spark, tmp_path):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    rows = [(i if i != 5 else None, x, 1) for i, x in enumerate(HARD)] + [(2, "twice", 1), (2, "twice", 1), (2, "other", 1)]
    folder = str(tmp_path / "ids")
    manifest = tokenids.write_ids(spark.createDataFrame(rows, "doc_id long, text string, part int").repartition(3), path, folder, parts=4)
    got = sorted(((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in tokenids.read_ids(manifest, folder).collect()))
    ids = [(i, t.encode(x or "", add_special_tokens=False).ids + [2]) for i, x, _ in rows]
    ids.sort(key=lambda r: (r[0] is not None, r[0] or 0, np.array(r[1], "<u2").tobytes()))
    at = 0
    for (start, doc, n, crc), (i, x) in zip(got, ids, strict=True):
        assert (start, doc, n, crc) == (at, i, len(x), zlib.crc32(np.array(x, "<u4").tobytes()))
        at += n
    empty = tokenids.write_ids(spark.createDataFrame([], "doc_id long, text string"), path, str(tmp_path / "none"))
    assert tokenids.read_ids(empty, str(tmp_path / "none")).count() == 0


# -- packing


def test_boundaries_are_optimal():
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randint(1, 8)
        lengths, counts, k = sorted(rng.sample(range(60), n)), [rng.randint(1, 9) for _ in range(n)], rng.randint(1, 5)
        cost = lambda b: sum(c * min(x for x in b if x >= x0) for x0, c in zip(lengths, counts, strict=True))  # noqa: B023, E731
        got = packing.boundaries(lengths, counts, k)
        best = min(cost([*s, lengths[-1]]) for r in range(min(k, n)) for s in itertools.combinations(lengths[:-1], r))
        assert len(got) <= k and cost(got) == best


def test_packing(spark, docs):
    got = packing.pack(docs, buckets=3, budget=100).collect()
    assert len(got) == len(ROWS)
    batches = {}
    for r in got:
        assert r["size"] <= r["padded_size"]
        batches.setdefault((r["bucket"], r["batch"]), []).append(r)
    for rows in batches.values():
        assert len(rows) == 1 or len(rows) * rows[0]["padded_size"] <= 100
    assert packing.pack(docs.limit(0)).count() == 0
    again = packing.pack(docs.repartition(2), buckets=3, budget=100).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
