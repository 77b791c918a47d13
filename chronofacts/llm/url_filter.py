"""URL filters: rules, and logistic regression on hashed character n-grams of host and path, with DataFrame functions only.

A rule is a verdict with a host and a path: it fits that host and all its subdomains where the URL's path starts with
the rule's; the longest fitting rule decides. Other URLs are judged by the classifier: n-grams of 3 and 4 characters, host and path apart, are hashed
into ``BUCKETS`` weights each, whose mean and the bias give the logit; a URL is blocked if it is above 0.

The classifier is trained on the driver from the labelled table below (a constant) by plain gradient descent, and its weights are
rounded to whole numbers, so sums are exact in any order. They enter the query as a literal.

Nulls: a null URL, or one without ``://``, has an empty host and path, no n-grams, and the bias alone judges it. Repeated rows are judged each.
"""

from __future__ import annotations

from functools import lru_cache
from math import exp

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .urls import host, path

#: Rules, as (verdict, host and path). Fixed values.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))

#: Labelled hosts and paths.
BLOCKED = """
cheap-pills.example/en/1 www.cheap-pills.shop/buy/now cheap-meds.example/fr/20 pills-online.example/order casino-win.example/en/14 www.casino-win.club/play
best-casino.example/bonus free-bets.example/en/27 m.free-bets.example/de/963 bets-online.example/odds spam-farm.example/en/728 link-farm.example/es/5
adult-x.example/fr/9 adult-cams.example/live xxx-adult.example/video ads-track.example/en/584 track-ads.example/pixel click-ads.example/banner
win-prize.example/claim free-money.example/now payday-loans.example/apply viagra-cheap.example/shop replica-watches.example/sale lottery-win.example/ticket
poker-free.example/table porn-tube.example/watch hot-singles.example/chat malware-kit.example/download warez-free.example/crack keygen-crack.example/serial
spam-links.example/page casino-free.example/spin pills-cheap.example/rx bets-win.example/live adult-free.example/clip track-click.example/redirect
""".split()
ALLOWED = """
therha.example/en/676 blog.ththon.example/en/853 m.ththth.example/en/25 tionsh.example/fr/825 www.therer.example/es/144 blog.theren.example/de/12
docs.library.example/guide/intro www.university.example/research/paper news.city.example/local/story blog.garden.example/spring/planting museum.example/exhibits
recipes.kitchen.example/soup/lentil weather.example/forecast/week wiki.project.example/history/rome archive.example/records/1910 school.example/lessons/maths
code.project.example/src/main support.vendor.example/manual/setup journal.example/volume/12 forum.travel.example/trips/alps health.clinic.example/advice/sleep
council.example/minutes/may science.example/articles/physics music.example/scores/bach theatre.example/season/plays ththan.example/es/874 therat.example/en/231
tiontion.example/en/254 blog.thernd.example/de/612 thering.example/en/328 www.therti.example/en/334 theres.example/es/575 ththes.example/de/925
ththly.example/en/777 m.therou.example/en/474 ththble.example/en/234
""".split()

BUCKETS = 1009
SIZES = (3, 4)
#: Whole-number weights stand for this many times their value; the mean weight counts ``GAIN`` times.
SCALE, GAIN = 10_000, 10
_STEPS, _RATE, _DECAY = 300, 4.0, 1e-4
#: Multipliers of the code points of an n-gram, before the remainder by BUCKETS. Fixed values.
_FACTORS = (7919, 104729, 1299709, 15485863)


def _grams(text: str) -> list[int]:
    codes = [ord(c) for c in text]
    return [sum(c * f for c, f in zip(codes[i : i + n], _FACTORS)) % BUCKETS for n in SIZES for i in range(len(codes) - n + 1)]


def buckets(host_text: str, path_text: str) -> list[int]:
    """Weights of a URL's n-grams, as numbers below twice BUCKETS: those of the host, then those of the path."""
    return _grams(host_text) + [BUCKETS + b for b in _grams(path_text)]


@lru_cache(maxsize=1)
def trained() -> tuple[tuple[int, ...], int]:
    """Whole-number weights and bias, by full-batch gradient descent from zero: the same on every run."""
    rows = [(buckets(h, "/" + p), y) for y, urls in ((1, BLOCKED), (0, ALLOWED)) for h, _, p in (u.partition("/") for u in urls)]
    weights, bias = [0.0] * (2 * BUCKETS), 0.0
    for _ in range(_STEPS):
        grad, grad_bias = [0.0] * (2 * BUCKETS), 0.0
        for found, y in rows:
            logit = bias + GAIN * sum(weights[b] for b in found) / len(found)
            error = (1 / (1 + exp(-logit)) - y) / len(rows)
            grad_bias += error
            step = error * GAIN / len(found)
            for b in found:
                grad[b] += step
        weights = [w - _RATE * (g + _DECAY * w) for w, g in zip(weights, grad)]
        bias -= _RATE * 0.05 * grad_bias
    return tuple(round(w * SCALE) for w in weights), round(bias * SCALE)


def _sum_and_count(text: Column, weights: Column, offset: int) -> tuple[Column, Column]:
    codes = F.transform(F.split(text, ""), F.ascii)
    total, count = F.lit(0).cast("long"), F.lit(0)
    for n in SIZES:
        last = F.length(text) - n
        at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.expr("array()").cast("array<int>"))
        bucket = lambda i, n=n: sum((F.get(codes, i + k).cast("long") * f for k, f in enumerate(_FACTORS[:n])), F.lit(0).cast("long")) % BUCKETS
        total = total + F.aggregate(at, F.lit(0).cast("long"), lambda s, i: s + F.get(weights, (bucket(i) + offset).cast("int")))
        count = count + F.greatest(last + 1, F.lit(0))
    return total, count


def judged(pages: DataFrame, url: Column, rules: tuple = RULES) -> tuple[Column, Column, Column, Column]:
    """Host, path, rule (or null) and verdict of a URL."""
    h, p = host(url), path(url)
    weights, bias = trained()
    literal = F.expr(f"array({', '.join(f'{w}L' for w in weights)})")
    in_host, of_host = _sum_and_count(h, literal, 0)
    in_path, of_path = _sum_and_count(p, literal, BUCKETS)
    count = of_host + of_path
    # bias + GAIN * sum / count > 0, in whole numbers
    blocked = F.when(count > 0, (in_host + in_path) * GAIN + F.lit(bias) * count > 0).otherwise(F.lit(bias > 0))
    rule, verdict = F.lit(None).cast("string"), F.when(blocked, "block").otherwise("allow")
    for decision, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the longest is asked first
        rule_host, _, rule_path = text.partition("/")
        fits = ((h == rule_host) | h.endswith("." + rule_host)) & p.startswith("/" + rule_path)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, decision).otherwise(verdict)
    return h, p, rule, verdict


def url_report(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict."""
    h, p, rule, verdict = judged(pages, F.col("url"), rules)
    return pages.select("page_id", h.alias("host"), p.alias("path"), rule.alias("rule"), verdict.alias("verdict"))


def keep_allowed(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """The rows that are allowed, with their own columns."""
    return pages.where(judged(pages, F.col("url"), rules)[3] == "allow")


def oracle() -> str:
    """SQL for ``url_report`` with the trained weights as a literal."""
    weights, bias = trained()

    def total(column: str, offset: int) -> str:
        parts = []
        for n in SIZES:
            bucket = " + ".join(f"unicode(substr({column}, i + {k}, 1)) * {f}" for k, f in enumerate(_FACTORS[:n]))
            parts.append(f"coalesce(list_sum(list_transform(range(1, greatest(length({column}) - {n} + 2, 1)), lambda i: w[1 + {offset} + CAST(({bucket}) % {BUCKETS} AS INTEGER)])), 0)")
        return " + ".join(parts)

    count = " + ".join(f"greatest(length({c}) - {n} + 1, 0)" for c in ("host", "path") for n in SIZES)
    rules = sorted(RULES, key=lambda r: (-len(r[1]), r[1]))
    fits = lambda text: f"(host = '{text.partition('/')[0]}' OR ends_with(host, '.{text.partition('/')[0]}')) AND starts_with(path, '/{text.partition('/')[2]}')"
    case = lambda k: "CASE " + " ".join(f"WHEN {fits(r[1])} THEN '{r[k]}'" for r in rules)
    return f"""
WITH m AS (SELECT [{', '.join(map(str, weights))}]::BIGINT[] AS w),
u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
s AS (SELECT page_id, host, path, {total('host', 0)} + {total('path', BUCKETS)} AS t, {count} AS c FROM u, m)
SELECT page_id, host, path, {case(1)} END AS rule, {case(0)} ELSE CASE WHEN (CASE WHEN c > 0 THEN t * {GAIN} + {bias} * c > 0 ELSE {bias} > 0 END) THEN 'block' ELSE 'allow' END END AS verdict FROM s
"""
