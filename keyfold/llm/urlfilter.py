"""URL filters: rules first, else logistic regression on hashed character n-grams.

Native: DataFrame operations only.  The model is fit by full-batch gradient
descent with momentum inside one SQL expression over a small labelled table, at most
``MAX_LABELLED`` rows, which aggregate to one row.  Features are sparse: an epoch
sums the weights of each URL's n-grams, and each bucket's gradient over the URLs
that have it.  The weights (``DIMENSIONS`` numbers) are the only thing the driver
sees.  Scoring is a sum of weights over a URL's n-grams.

Features are the n-grams of three code points of ``^host$`` and of ``^path$``,
hashed apart; a count is divided by the root of the URL's number of n-grams.

The standard labels are ``labelled_urls.tsv`` beside this module: 159 URLs made up
for the purpose, unwanted ones of six kinds and ordinary ones of nine.  Their
hosts and words were chosen without regard to any table to be judged; whoever has
labels of their own passes them to ``train``.  ``held_out_accuracy`` measures a
table's model on a quarter of its hosts, which the fit doesn't see.

The host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end,
A-Z lower-cased; the path goes on from there up to ``?``, ``#`` or the end.
Without ``://``, or for null, both are empty; such URLs have the model's verdict
for nothing known: allow.  A rule (host, path prefix) fits its host and all
subdomains; the longest fitting rule decides, ties by its text.  Rules are a
list on the driver, at most ``MAX_RULES``, and become one expression.  Rows are
independent, so repeated rows need no rule; an empty table gives no rows.
"""

from __future__ import annotations

from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, blank_if_null, ship

DIMENSIONS, NGRAM, EPOCHS, RATE, MOMENTUM, PENALTY = 4096, 3, 200, 3.0, 0.9, 3e-4
MAX_LABELLED, MAX_RULES = 1000, 1000

#: The standard rules, (host, path prefix, verdict).
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]

def parts(url: str = "url") -> tuple[Column, Column]:
    """Host and path."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise(F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def features(host: Column, path: Column) -> Column:
    """Buckets of the n-grams, one entry for each occurrence."""

    def grams(prefix: str, c: Column) -> Column:
        framed = F.concat(F.lit("^"), c, F.lit("$"))
        last = F.greatest(F.length(framed) - NGRAM + 1, F.lit(1))
        return F.transform(F.sequence(F.lit(1), last), lambda i: F.pmod(F.xxhash64(F.lit(prefix), F.substring(framed, i, NGRAM)), F.lit(DIMENSIONS)).cast("int"))

    return F.concat(grams("h", host), grams("p", path))


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The standard labelled table: url, label (1: block)."""
    lines = files(__package__).joinpath("labelled_urls.tsv").read_text("utf-8").splitlines()[1:]
    rows = [(url, int(label)) for label, _, url in (line.split("\t") for line in lines)]
    return spark.createDataFrame(rows, "url string, label int")


def train(labelled: DataFrame) -> list[float]:
    """Weights, with the intercept last.  labelled: url and label (1: block)."""
    if labelled.limit(MAX_LABELLED + 1).count() > MAX_LABELLED:
        raise ValueError(f"more than {MAX_LABELLED} labelled rows; take a sample")
    host, path = parts()
    rows = labelled.where("url is not null and label is not null").select("url", F.col("label").cast("double").alias("y"), features(host, path).alias("f"))
    # The bound on labelled rows makes this one task's work.
    rows = rows.withColumn("i", F.row_number().over(Window.orderBy("url", "y")))
    grams = rows.select("i", F.size("f").alias("all"), F.explode("f").alias("k")).groupBy("i", "k", "all").agg(F.count(F.lit(1)).alias("n"))
    grams = grams.select("i", "k", (F.col("n") / F.sqrt("all")).alias("v"))
    by_row = grams.groupBy("i").agg(F.sort_array(F.collect_list(F.struct((F.col("k") + 1).alias("at"), "v"))).alias("x"))
    by_bucket = grams.groupBy("k").agg(F.sort_array(F.collect_list(F.struct(F.col("i").alias("at"), "v"))).alias("c"))
    one = rows.join(by_row, "i").agg(F.sort_array(F.collect_list(F.struct("i", "y", "x"))).alias("rows"))
    nothing = F.array().cast("array<struct<at:int,v:double>>")
    held = by_bucket.agg(F.map_from_entries(F.collect_list(F.struct("k", "c"))).alias("held"))
    column = lambda k: F.coalesce(F.element_at("held", k), nothing)
    # Two tables of one row each, put side by side.
    one = one.select(F.transform("rows", lambda r: r["y"]).alias("y"), F.transform("rows", lambda r: r["x"]).alias("x"))
    held = held.select(F.transform(F.sequence(F.lit(0), F.lit(DIMENSIONS - 1)), column).alias("columns"))
    one = one.unionByName(held, allowMissingColumns=True).agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("y", "x", "columns")])
    along = lambda sparse, dense: F.aggregate(sparse, F.lit(0.0), lambda s, e: s + e["v"] * F.element_at(dense, e["at"]))

    # Both classes weigh the same, so that unwanted URLs, the fewer, aren't drowned.
    share = F.aggregate("y", F.lit(0.0), lambda s, v: s + v) / F.greatest(F.size("y"), F.lit(1))
    balance = lambda e, y: F.when(share.isin(0.0, 1.0), e).when(y > 0.5, e * 0.5 / share).otherwise(e * 0.5 / (1 - share))

    def epoch(state: Column, _: Column) -> Column:
        w, speed = F.element_at(state, 1), F.element_at(state, 2)
        # The errors, and then the speed, are this epoch's, each bound once by the outer transform.
        errors = F.zip_with("x", "y", lambda r, y: balance(F.lit(1.0) / (1 + F.exp(-(along(r, w) + F.element_at(w, -1)))) - y, y))
        gradient = F.transform(F.array(errors), lambda e: F.concat(F.transform("columns", lambda c: along(c, e)), F.array(F.aggregate(e, F.lit(0.0), lambda s, v: s + v))))
        pulled = F.zip_with(w, F.element_at(gradient, 1), lambda v, g: g / F.greatest(F.size("y"), F.lit(1)) + PENALTY * v)
        faster = F.array(F.zip_with(speed, pulled, lambda v, g: MOMENTUM * v - RATE * g))
        return F.flatten(F.transform(faster, lambda v: F.array(F.zip_with(w, v, lambda p, q: p + q), v)))

    zero = F.array_repeat(F.lit(0.0), DIMENSIONS + 1)
    fitted = one.select(F.element_at(F.aggregate(F.sequence(F.lit(1), F.lit(EPOCHS)), F.array(zero, zero), epoch), 1).alias("w")).first()
    return list(fitted["w"])


def held_out_accuracy(labelled: DataFrame) -> tuple[float, float]:
    """Shares of unwanted and of ordinary URLs that a model judges right, on a quarter of the hosts that it didn't see."""
    host, path = parts()
    outside = F.pmod(F.xxhash64(host), F.lit(4)) == 0
    weights = train(labelled.where(~outside))
    right = labelled.where(outside).select("label", ((score(weights, host, path) >= 0.5).cast("int") == F.col("label")).cast("int").alias("right"))
    shares = {r["label"]: r["share"] for r in right.groupBy("label").agg(F.avg("right").alias("share")).collect()}
    return shares.get(1, 0.0), shares.get(0, 0.0)


def score(weights: list[float], host: Column, path: Column) -> Column:
    """The model's probability that the URL should be blocked."""
    w = F.lit(weights[:-1])
    f = features(host, path)
    total = F.aggregate(f, F.lit(0.0), lambda s, k: s + F.element_at(w, k + 1)) / F.sqrt(F.size(f))
    return F.lit(1.0) / (1 + F.exp(-(total + weights[-1])))


def ruled(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, ruled (its verdict) of each url; the last two null where no rule fits."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    host, path = parts()
    found = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule = verdict = None
    for rule_host, prefix, what in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1])):
        fits = ((F.col("host") == rule_host) | F.col("host").endswith("." + rule_host)) & F.col("path").startswith(prefix)
        text = rule_host + prefix
        rule, verdict = (F.when(fits, text), F.when(fits, what)) if rule is None else (rule.when(fits, text), verdict.when(fits, what))
    nothing = F.lit(None).cast("string")
    return found.withColumns({"rule": nothing if rule is None else rule, "ruled": nothing if verdict is None else verdict})


def judge(pages: DataFrame, weights: list[float], rules: list[tuple[str, str, str]] = RULES, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, block_score, verdict of each url."""
    found = ruled(pages, rules).withColumn("block_score", score(weights, F.col("host"), F.col("path")))
    unknown = (F.col("host") == "") & (F.col("path") == "")
    own = F.when((F.col("block_score") >= threshold) & ~unknown, "block").otherwise("allow")
    return found.select("page_id", "host", "path", "rule", "block_score", F.coalesce("ruled", own).alias("verdict"))


ship(__name__)
