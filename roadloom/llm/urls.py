"""URL filters: host/path rules first, else logistic regression on hashed character n-grams.

The model is trained on a small labelled URL table (at most MAX_LABELLED rows,
the bound of what the driver ever holds) and its weight vector, of fixed size
BINS, goes to the executors. Nothing is grouped, so no host can be hot.

Edge cases: a null url, or one without ://, has an empty host and path, fits no
rule and gets the model's verdict on no n-grams, its prior. Repeated rows each
get a row. Extra columns pass through unless named like a result. An empty
labelled table gives the verdict allow everywhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BINS = 1 << 14
GRAMS = (3, 4, 5)
MAX_LABELLED = 10_000

#: (verdict, host, path prefix). The longest rule that fits wins.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)

#: Fixed values of the labelled table: words of hosts that are to be blocked, words of others, words of both, and
#: what stands around them.
UNWANTED = (
    "casino poker roulette blackjack slots jackpot lottery betting bets gambling bingo adult porn xxx sex nude escort webcam camgirls singles hookup erotic fetish "
    "pills viagra cialis pharma steroids diet payday loans credit forex binary spam phishing malware clickbait adserver tracker popup warez crack keygen torrent serial "
    "replica knockoff followers likes giveaway prize winner"
).split()
WANTED = (
    "news daily times library museum city council school university science physics history weather climate travel railway airport kitchen recipes garden music concert "
    "theatre cinema photo painting forum wiki docs manual health clinic hospital bank insurance market bakery hotel football tennis chess forest river mountain "
    "village church charity parliament court energy software kernel python robotics biology law essays poetry"
).split()
EITHER = "free cheap best top my the hot new win club shop farm x 24 online world zone live hub center".split()
SYLLABLES = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce bo da fi ga ku lo mi nu pa su ta vi wo ble ing ion sh".split()
NAMES = 2000
HOSTS = ("{}.example.com", "www.{}.example.net", "{}.example.org", "blog.{}.example.com", "m.{}.example.net", "shop.{}.example.org", "{}.info", "www.{}.biz", "{}.co")
PATHS = ("/en/{}.html", "/de/{}", "/fr/{}?page=2", "/es/{}/", "/about#top", "/item/{}", "", "/2021/05/post-{}", "/en/{}?utm_source=feed", "/index.php?id={}", "/en/{}/", "/category/{}", "/es/{}.html", "/de/{}/", "/fr/{}", "/en/{}#top")
UNWANTED_PATHS = ("/casino/bonus", "/slots/free-spins", "/buy/viagra", "/adult/gallery", "/xxx/videos", "/click/prize", "/warez/keygen.exe", "/payday-loans/apply", "/popup/ads", "/betting/odds")


def labelled() -> list[tuple[str, int]]:
    """The small labelled table (url, 1: to be blocked), about 2,900 rows by rule.

    Each word stands in several hosts, alone, before and after words of both kinds, and
    under different domains and paths, as do made-up names, which nothing is wrong with.
    """
    rows = []

    def add(name: str, label: int, path: str | None = None) -> None:
        i = len(rows)
        rows.append((("http://", "https://")[i % 2] + HOSTS[i % len(HOSTS)].format(name) + (PATHS[(i // 2 + i // 7) % len(PATHS)].format(i * i * 7919 % 99_991) if path is None else path), label))

    for label, words in ((1, UNWANTED), (0, WANTED)):
        for i, w in enumerate(words):
            other = [EITHER[(i * k + k) % len(EITHER)] for k in (1, 3, 7)]
            for name in (w, f"{w}-{other[0]}", f"{other[1]}-{w}", f"{other[2]}{w}", f"{w}{words[(i * 5 + 2) % len(words)]}"):
                add(name, label)
    for i, w in enumerate(EITHER):
        add(f"{w}-{WANTED[(i * 11) % len(WANTED)]}", 0)
        add(f"{w}-{UNWANTED[(i * 11) % len(UNWANTED)]}", 1)
    for i in range(NAMES):
        code = int.from_bytes(hashlib.md5(f"name {i}".encode()).digest()[:8], "little")
        name = "".join(SYLLABLES[(code >> 8 * j) % len(SYLLABLES)] for j in range(2 + i % 3))
        add(name, 0)
        if i % 10 == 0:
            add(name, 1, UNWANTED_PATHS[(i // 10) % len(UNWANTED_PATHS)])
    return rows


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): host after the first :// up to / ? # or the end, A-Z lower-cased; path from there up to ? # or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(host, upper, upper.lower()), F.lit("")), F.coalesce(path, F.lit(""))


def first_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as struct(rule, verdict), or null."""
    found = None
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        said = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, said) if found is None else found.when(fits, said)
    return found


def _bins(host: str, path: str) -> np.ndarray:
    """Bins of the n-grams of "^host" and "/path", each bin once."""
    out = []
    for mark, s in ((1, "^" + host + "$"), (2, path + "$")):
        c = np.frombuffer(s.encode(), np.uint8).astype(np.uint64)
        for n in GRAMS:
            if len(c) < n:
                continue
            h = np.full(len(c) - n + 1, mark * 2654435761 + n, np.uint64)
            for i in range(n):
                h = (h * np.uint64(1099511628211)) ^ c[i : len(c) - n + 1 + i]
            h ^= h >> np.uint64(29)
            out.append((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(50))
    return np.unique(np.concatenate(out)).astype(np.int64) if out else np.empty(0, np.int64)


def _host_path(url: str | None) -> tuple[str, str]:
    head, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    tail = rest[cut:]
    end = min([i for i in map(tail.find, "?#") if i >= 0], default=len(tail))
    return rest[:cut].lower(), tail[:end]


def train(labelled: DataFrame, *, steps: int = 400, rate: float = 4.0, l2: float = 1e-4, max_rows: int = MAX_LABELLED) -> tuple[np.ndarray, float]:
    """labelled: (url, label 0 or 1). Full-batch gradient descent, both classes weighted to one half; at most max_rows rows, the smallest by hash."""
    rows = labelled.where("label IS NOT NULL").orderBy(F.xxhash64("url"), "url", "label").limit(max_rows).collect()
    w, b = np.zeros(BINS), 0.0
    if not rows:
        return w, -1.0
    bins = [_bins(*_host_path(r["url"])) for r in rows]
    y = np.array([float(r["label"]) for r in rows])
    who = np.repeat(np.arange(len(bins)), [len(x) for x in bins])
    at = np.concatenate(bins)
    scale = 1 / np.sqrt(np.maximum(1, np.bincount(who, minlength=len(bins))))
    share = np.where(y == 1, 0.5 / max(1.0, y.sum()), 0.5 / max(1.0, (1 - y).sum()))  # both classes weigh the same
    for _ in range(steps):
        z = b + np.bincount(who, w[at], len(bins)) * scale
        miss = (1 / (1 + np.exp(-z)) - y) * share
        w -= rate * (np.bincount(at, (miss * scale)[who], BINS) * 10 + l2 * w)
        b -= rate * miss.sum()
    return w, float(b)


def labelled_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(labelled(), "url string, label int")


def judge(pages: DataFrame, weights: np.ndarray, bias: float, rules=RULES) -> DataFrame:
    """pages with host, path, rule, score (the model's probability of block), verdict."""
    w = weights.astype(np.float32)

    @F.pandas_udf("double")
    def score(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for hosts, paths in it:
            out = []
            for h, p in zip(hosts, paths, strict=True):
                b = _bins(h, p)
                out.append(1 / (1 + np.exp(-(bias + float(w[b].sum()) / np.sqrt(max(1, len(b)))))))
            yield pd.Series(out, dtype="float64")

    host, path = split_url(F.col("url"))
    p = pages.drop("host", "path", "rule", "score", "verdict").withColumns({"host": host, "path": path})
    p = p.withColumns({"_r": first_rule(F.col("host"), F.col("path"), rules), "score": score("host", "path")})
    verdict = F.coalesce(F.col("_r.verdict"), F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return p.withColumns({"rule": F.col("_r.rule"), "verdict": verdict}).drop("_r")
