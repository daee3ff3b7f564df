"""URL filters: host and path rules before a logistic regression on hashed character n-grams.

A rule fits its host and all subdomains if the path starts with the rule's; the longest rule (host and
path together) wins.  Other URLs get the verdict of the regression: the sum of the weights of the
hashed character n-grams of host and path, divided by the root of their number, ``block`` above a
threshold.  Everything a row goes through is built from SQL functions; there is no Python on the executors.

The regression is trained on ``LABELLED``, a small table of URLs, by batch gradient ascent on the driver
(a fixed number of steps over a fixed number of rows, no data from the cluster).  The threshold is trained too: in ``FOLDS``
folds each URL is scored by a regression that has not seen it, and the threshold is the lowest one that blocks
none of the allowed URLs by these scores.  Weights are rounded to integers, so sums are exact and do not depend on their order;
they reach the plan as one literal of ``BUCKETS`` numbers.  The hash of an n-gram is polynomial in its code points, so that SQL
engines agree on it.

Defined results: a null url, or one without ``://``, has empty host and path, no rule, and the verdict
of the regression on no n-grams; a null page_id is passed through; repeated rows are judged alike; an
empty table gives no rows; urls of any length are judged whole; columns of other names are ignored.
"""

from __future__ import annotations

import functools
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import table

GRAMS = (3, 4)
BUCKETS = 4096
SCALE = 1_000_000
STEPS = 300
RATE = 0.5
RIDGE = 1e-3
FOLDS = 5
#: Rules of the contract: (host, path, verdict).
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
#: The small labelled table: host and path, 1 for block.
LABELLED = (
    ("news.example.com/world/2021/report.html", 0), ("www.library.example.org/catalogue/item/42", 0), ("docs.example.net/guide/install", 0), ("blog.example.com/fr/825", 0), ("m.journal.example.net/en/25", 0),
    ("school.example.org/en/685", 0), ("www.museum.example.org/de/511", 0), ("archive.example.net/es/384", 0), ("weather.example.com/forecast/today", 0), ("recipes.example.com/soup/onion", 0),
    ("history.example.org/articles/rome", 0), ("science.example.net/papers/energy.html", 0), ("www.city.example.org/services/parks", 0), ("travel.example.com/guide/lisbon", 0), ("books.example.net/review/novel", 0),
    ("forum.example.org/topic/gardening", 0), ("health.example.com/advice/sleep", 0), ("www.example.org/about/team", 0), ("wiki.example.net/page/bridge", 0), ("sport.example.com/results/2020", 0),
    ("casino-bonus.example.com/play/slots", 1), ("free-poker.example.net/jackpot/win", 1), ("xxx-cams.example.com/live/girls", 1), ("hot-porn.example.net/video/xxx", 1), ("adult-dating.example.org/sex/tonight", 1),
    ("cheap-pills.example.com/viagra/buy", 1), ("online-casino.example.org/roulette/bet", 1), ("warez.example.net/crack/keygen", 1), ("torrent-crack.example.com/download/serial", 1), ("payday-loan.example.net/apply/fast", 1),
    ("click-track.example.com/adserver/banner", 1), ("phish-login.example.org/verify/account", 1), ("win-prize.example.net/claim/free-iphone", 1), ("escort.example.com/girls/sexy", 1), ("betting-tips.example.org/casino/odds", 1),
    ("malware-host.example.net/exploit/kit", 1), ("spam-mailer.example.com/bulk/leads", 1), ("porn-tube.example.org/xxx/clips", 1), ("replica-watch.example.net/buy/cheap", 1), ("nude-pics.example.com/gallery/porn", 1),
)


def grams(text: str) -> list[int]:
    """Hashed n-grams; the same as ``_grams_sql`` gives."""
    out = []
    for n in GRAMS:
        for i in range(len(text) - n + 1):
            h = n
            for c in text[i : i + n]:
                h = (h * 131 + ord(c)) % 1_000_003
            out.append(h % BUCKETS)
    return out


def _fit(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and intercept by batch gradient ascent."""
    w, bias = np.zeros(x.shape[1]), 0.0
    for _ in range(STEPS):
        miss = (y - 1.0 / (1.0 + np.exp(-np.clip(x @ w + bias, -50.0, 50.0)))) / len(y)
        w, bias = w + RATE * 20 * (miss @ x - RIDGE * w), bias + RATE * float(miss.sum())
    return w, bias


@functools.cache
def weights() -> tuple[int, ...]:
    """The trained weights times SCALE; last the score that a URL must exceed to be blocked, less the intercept, times SCALE."""
    y = np.array([label for _, label in LABELLED], dtype=float)
    x = np.zeros((len(LABELLED), BUCKETS))
    for row, (url, _) in enumerate(LABELLED):
        own = grams(_framed(url))
        np.add.at(x[row], own, 1 / math.sqrt(len(own)))
    fold = np.arange(len(y)) % FOLDS
    unseen = np.zeros(len(y))
    for k in range(FOLDS):
        w, bias = _fit(x[fold != k], y[fold != k])
        unseen[fold == k] = x[fold == k] @ w + bias
    # Halfway from the highest score of an allowed URL to the next one above it.
    most = unseen[y == 0].max()
    above = unseen[unseen > most]
    bar = (most + above.min()) / 2 if len(above) else most
    w, bias = _fit(x, y)
    return (*[round(v * SCALE) for v in w.tolist()], round((float(bar) - bias) * SCALE))


def _framed(host_path: str) -> str:
    host, _, path = host_path.partition("/")
    return f"^{host}/{path}"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty if it is null or has no ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_name(rule: tuple[str, str, str]) -> str:
    return rule[0] + rule[1]


def matched(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(rule_name(r)), rule_name(r))):
        fits = ((host == rule[0]) | host.endswith("." + rule[0])) & path.startswith(rule[1])
        name, verdict = F.when(fits, F.lit(rule_name(rule))).otherwise(name), F.when(fits, F.lit(rule[2])).otherwise(verdict)
    return name, verdict


def _grams_expr(text: str, n: int) -> str:
    h = str(n)
    for j in range(n):
        h = f"(({h} * 131 + ascii(substring({text}, i + {j}, 1))) % 1000003)"
    return f"transform(CASE WHEN length({text}) >= {n} THEN sequence(1, length({text}) - {n - 1}) ELSE array() END, i -> CAST({h} % {BUCKETS} AS INT))"


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and the regression's integer score."""
    host, path = host_path(F.col("url"))
    *w, bar = weights()
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    framed = parts.withColumn("framed", F.when((F.col("host") == "") & (F.col("path") == ""), F.lit("")).otherwise(F.concat(F.lit("^"), "host", "path")))
    literal = ",".join(map(str, w))
    total = "CAST(0 AS BIGINT)"
    for n in GRAMS:
        total = f"({total} + aggregate({_grams_expr('framed', n)}, CAST(0 AS BIGINT), (s, k) -> s + element_at(w, k + 1)))"
    n_grams = " + ".join(f"greatest(length(framed) - {n - 1}, 0)" for n in GRAMS)
    scored = framed.withColumn("w", F.split(F.lit(literal), ",").cast("array<bigint>")).withColumn("points", F.expr(total)).withColumn("n_grams", F.expr(n_grams))
    name, verdict = matched(F.col("host"), F.col("path"), rules)
    # points / sqrt(n) > bar, without a root: the squares tell, with the sign of either side.
    square, limit = F.col("points").cast("decimal(38,0)") * F.col("points"), F.lit(bar * bar).cast("decimal(20,0)") * F.col("n_grams")
    blocked = ((F.col("points") > 0) & (square > limit)) if bar >= 0 else ((F.col("points") > 0) | (square < limit))
    return scored.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, F.when(blocked, "block").otherwise("allow")).alias("verdict"), "points")


def op9_url_filters(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def oracle() -> str:
    *w, bar = weights()
    blocked = f"points > 0 AND points::HUGEINT * points::HUGEINT > {bar * bar}::HUGEINT * n_grams" if bar >= 0 else f"points > 0 OR points::HUGEINT * points::HUGEINT < {bar * bar}::HUGEINT * n_grams"

    def points(n: int) -> str:
        h = str(n)
        for j in range(n):
            h = f"(({h} * 131 + unicode(substring(framed, i + {j}, 1))) % 1000003)"
        return f"coalesce(list_sum(list_transform(range(1, greatest(length(framed) - {n - 2}, 1)), lambda i: w[1 + {h} % {BUCKETS}])), 0)"

    name, verdict = "NULL", "NULL"
    for rule in sorted(RULES, key=lambda r: (len(rule_name(r)), rule_name(r))):
        fits = f"(host = '{rule[0]}' OR ends_with(host, '.{rule[0]}')) AND starts_with(path, '{rule[1]}')"
        name, verdict = f"CASE WHEN {fits} THEN '{rule_name(rule)}' ELSE {name} END", f"CASE WHEN {fits} THEN '{rule[2]}' ELSE {verdict} END"
    n_grams = " + ".join(f"greatest(length(framed) - {n - 1}, 0)" for n in GRAMS)
    return f"""
WITH cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
framed AS (SELECT *, CASE WHEN host = '' AND path = '' THEN '' ELSE '^' || host || path END AS framed FROM parts),
scored AS (SELECT *, {' + '.join(points(n) for n in GRAMS)} AS points, {n_grams} AS n_grams FROM framed, (SELECT [{', '.join(map(str, w))}]::BIGINT[] AS w))
SELECT page_id, host, path, {name} AS rule,
  coalesce({verdict}, CASE WHEN {blocked} THEN 'block' ELSE 'allow' END) AS verdict
FROM scored"""
