"""URL filters: host and path rules, else logistic regression on hashed character n-grams, natively.

The model is fitted by full-batch gradient descent inside one SQL expression over a small labelled URL table; its
weights (``DIMS`` doubles, whatever the data) are then a constant of the scoring expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DIMS, GRAMS, EPOCHS, RATE, RIDGE, SCALE = 4096, (3, 4), 200, 2.0, 1e-4, 20.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (host, path, verdict) of the production rules
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))

# Labelled URLs; 1 is to be blocked.
LABELLED = (
    ("https://cheap-pills.example.org/en/1", 1), ("http://www.cheap-pills.example.net/buy-now/22", 1), ("https://spam-farm.example.org/en/728", 1), ("http://blog.spam-farm.example.net/de/9.html", 1),
    ("https://casino-bonus.example.org/win/77", 1), ("http://m.casino-royal.example.net/play?x=1", 1), ("https://free-prizes.example.org/claim/5", 1), ("http://win-big.example.net/lottery/12", 1),
    ("https://adult-cams.example.org/live/3", 1), ("http://hot-singles.example.net/dating/88", 1), ("https://payday-loans.example.org/apply/4", 1), ("http://fast-cash.example.net/loans/61.html", 1),
    ("https://replica-watches.example.org/shop/19", 1), ("http://click-bait.example.net/ads/7", 1), ("https://malware-host.example.org/download.exe", 1), ("http://warez-crack.example.net/keygen/2", 1),
    ("https://www.casino-win.example.org/de/57", 1), ("http://m.adult-x.example.net/en/34", 1), ("https://ads-track.example.org/en/786/", 1), ("http://ads-track.example.net/de/5.html", 1),
    ("https://cheap-pills.example.com/en/450?page=2&ref=x", 1), ("http://spam-farm.example.com/fr/34", 1), ("https://viagra-store.example.org/order", 1), ("http://seo-links.example.net/backlinks/10", 1),
    ("https://ththon.example.org/en/100", 0), ("http://thther.example.net/de/612", 0), ("https://blog.theren.example.org/en/455?utm_source=feed", 0), ("http://m.therou.example.net/en/474.html", 0),
    ("https://www.ththen.example.org/fr/148.html", 0), ("http://therin.example.net/en/770#top", 0), ("https://library.example.org/books/21", 0), ("http://news.example.net/2024/05/report.html", 0),
    ("https://docs.example.org/manual/intro", 0), ("http://university.example.net/research/8", 0), ("https://blog.tiontion.example.org/es/853/", 0), ("http://ththble.example.net/en/797#top", 0),
    ("https://museum.example.org/collection/77", 0), ("http://www.thernd.example.net/de/12?page=2", 0), ("https://ththly.example.org/en/777?page=2&ref=x", 0), ("http://weather.example.net/today", 0),
    ("https://therha.example.com/en/676", 0), ("http://ththre.example.com/fr/825?page=2&ref=x", 0), ("https://recipes.example.org/soup/3", 0), ("http://ththed.example.net/en/252", 0),
)


def host(url: F.Column) -> F.Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path(url: F.Column) -> F.Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule(host_: F.Column, path_: F.Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> F.Column:
    """struct(rule, verdict) of the longest rule that fits; null if none does."""
    found: F.Column = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, start, verdict in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host_ == name) | host_.endswith("." + name)) & path_.startswith(start)
        found = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def features(host_: F.Column, path_: F.Column, dims: int = DIMS) -> F.Column:
    """Hashed character n-grams of the marked host and path, as places among ``dims``; repeats count."""
    def grams(part: F.Column, n: int) -> F.Column:
        at = F.when(F.char_length(part) >= n, F.sequence(F.lit(1), F.char_length(part) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.pmod(F.xxhash64(F.substr(part, i, F.lit(n))), F.lit(dims)).cast("int"))

    marked = (F.concat(F.lit("h^"), host_, F.lit("$")), F.concat(F.lit("p^"), path_, F.lit("$")))
    lists = [grams(part, n) for part in marked for n in GRAMS]
    return F.concat(*lists)


def fit(spark: SparkSession, labelled: tuple[tuple[str, int], ...] = LABELLED, dims: int = DIMS, epochs: int = EPOCHS) -> list[float]:
    """``dims`` weights, then the bias, by gradient descent on the mean log loss with a ridge.

    A URL's n-grams share a total weight of ``SCALE``. One row holds the table: each URL's places, and for each place
    the URLs that use it; an epoch is one step of a higher-order ``aggregate``. Equal URLs with different labels pull
    against each other; null URLs are ones with an empty host and path.
    """
    values = ",".join("struct({} as url, {}D as y)".format("null" if u is None else "'" + u.replace("\\", "\\\\").replace("'", "\\'") + "'", float(y)) for u, y in labelled)
    urls = spark.sql(f"select posexplode(array({values})) as (i, t)").select("i", "t.y", features(host(F.col("t.url")), path(F.col("t.url")), dims).alias("f"))
    table = urls.agg(F.array_sort(F.collect_list(F.struct("i", "y", "f"))).alias("table"))
    table = table.select("table", F.array_sort(F.array_distinct(F.flatten("table.f"))).alias("ks"))
    one = table.select(
        F.expr(f"transform(ks, k -> struct(k as k, transform(filter(table, r -> array_contains(r.f, k)), r -> struct(r.i as i, size(filter(r.f, j -> j = k)) * {SCALE}D / size(r.f) as x)) as u))").alias("places"),
        F.expr("transform(table, r -> struct(r.y as y, size(r.f) as n, transform(r.f, k -> cast(array_position(ks, k) as int) - 1) as f))").alias("urls"),
    )
    fitted = one.select(F.col("places.k").alias("k"), F.expr(f"""
        aggregate(sequence(1, {epochs}), array_repeat(0D, size(places) + 1), (w, epoch) ->
          transform(array(transform(urls, r -> {RATE}D / size(urls) * (r.y - 1 / (1 + exp(-w[size(places)] - {SCALE}D / r.n * aggregate(r.f, 0D, (a, k) -> a + w[k])))))),
            miss -> concat(
              transform(places, (p, k) -> w[k] * {1 - RATE * RIDGE}D + aggregate(p.u, 0D, (a, q) -> a + miss[q.i] * q.x)),
              array(w[size(places)] + aggregate(miss, 0D, (a, m) -> a + m))))[0])""").alias("w")).first()
    weights = [0.0] * (dims + 1)
    for k, w in zip([*fitted.k, dims], fitted.w, strict=True):
        weights[k] = w
    return weights


def probability(host_: F.Column, path_: F.Column, weights: list[float]) -> F.Column:
    """P(to be blocked) of a URL; the weights are a constant of the plan."""
    dims = len(weights) - 1
    w = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")
    f = features(host_, path_, dims)
    score = F.aggregate(F.array(f), F.lit(weights[dims]), lambda a, x: a + F.lit(SCALE) / F.size(x) * F.aggregate(x, F.lit(0.0), lambda b, k: b + w[k]))
    return 1 / (1 + F.exp(-score))


def judge(pages: DataFrame, url_col: str = "url", rules: tuple[tuple[str, str, str], ...] = RULES, labelled: tuple[tuple[str, int], ...] = LABELLED) -> DataFrame:
    """pages' other columns with host, path, rule, verdict and p_block; columns of those names, and of the names __url and __rule, are
    replaced.

    A null url, and one without ``://``, has an empty host and path, fits no rule and gets the model's verdict. Repeated
    rows are judged alike; an empty table stays empty. The longest rule string wins; the same rule twice counts once.
    """
    weights = fit(pages.sparkSession, labelled)
    url = F.col(url_col).cast("string")
    made = pages.select(*[c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "p_block", "__url", "__rule")], url.alias("__url"))
    made = made.select("*", host(F.col("__url")).alias("host"), path(F.col("__url")).alias("path"))
    made = made.select("*", rule(F.col("host"), F.col("path"), rules).alias("__rule"), probability(F.col("host"), F.col("path"), weights).alias("p_block"))
    verdict = F.coalesce(F.col("__rule.verdict"), F.when(F.col("p_block") >= 0.5, "block").otherwise("allow"))
    return made.select(*[c for c in made.columns if c not in ("__url", "__rule")], F.col("__rule.rule").alias("rule"), verdict.alias("verdict"))
