"""URL filters: path rules, and logistic regression on hashed character
n-grams of host and path, with DataFrame functions and Spark ML only.

The model is trained from a small labelled table ``url, label`` (1: block).
Where a rule fits, the rule decides; elsewhere the model.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.llm.common import ascii_lower

#: Rules of the query: verdict, host, path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
NGRAMS = (3, 4, 5)
FEATURES = 1 << 14

#: The labelled table of the query: words of unwanted sites and of their
#: pages, names of ordinary sites and their pages, as anyone may list them.
#: Nothing of it is taken from the pages that are judged.
UNWANTED_FIRST = ("cheap", "free", "best", "online", "hot", "fast", "instant", "secret", "adult", "live", "bulk", "discount")
UNWANTED_SECOND = ("pills", "casino", "loans", "prizes", "cams", "watches", "bets", "crack", "clicks", "followers", "links", "lottery", "pharma", "poker", "spam", "dating")
#: Unwanted sites have ordinary pages as well.
UNWANTED_PAGES = ("/buy-now/offer.html", "/win-money/", "/order?aff=77&utm_source=mail", "/promo/bonus?ref=mail", "/go/click.php?id=9")
ORDINARY = (
    "library museum school city science garden bridge history weather travel music theatre kitchen hospital journal archive village harbour station market"
    " atlas physics poetry cycling railway forest mountain island language dictionary chess painting county parish college orchestra observatory botanic geology letters"
    " zeitung bibliothek gemeinde stadtwerke universite mairie bibliotheque lycee ayuntamiento biblioteca universidad revista periodico montagne wandern biologia"
).split()
ORDINARY_PAGES = ("/", "/en/12", "/de/345/", "/about.html", "/2019/05/opening-hours", "/articles/7?page=2", "/fr/notes/31", "/es/temas/4#top", "/index.php?id=3")
ENDINGS = ("com", "net", "org", "info", "eu", "de", "fr", "es")
PREFIXES = ("", "www.", "blog.", "m.", "news.")


def labelled_urls(spark: SparkSession) -> DataFrame:
    """``url, label`` (1: unwanted): two in three pairs of unwanted words, either
    first, and ordinary names, with endings, prefixes and pages in turn.  Two pages in
    three of unwanted sites are ordinary, so that the host tells."""
    bad = [f"{x}-{y}" if (i + j) % 2 else f"{y}-{x}" for i, x in enumerate(UNWANTED_FIRST) for j, y in enumerate(UNWANTED_SECOND) if (i + j) % 3]
    good = [*ORDINARY, *(f"{x}{y}" for n in (7, 13, 19) for x, y in zip(ORDINARY, ORDINARY[n:], strict=False))]
    rows = []
    for names, pages, label in ((bad, UNWANTED_PAGES, 1), (good, ORDINARY_PAGES, 0)):
        for k, name in enumerate(names):
            for t in range(3):
                page = pages[k % len(pages)] if t == 0 else ORDINARY_PAGES[(k + t) % len(ORDINARY_PAGES)]
                rows.append((f"https://{PREFIXES[(k + t) % len(PREFIXES)]}{name}.{ENDINGS[(k + 3 * t) % len(ENDINGS)]}{page}", label))
    return spark.createDataFrame(rows, "url string, label int")


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _grams(text: Column, mark: str) -> list[Column]:
    """All character n-grams of ^text$, marked as of host or path."""
    framed = F.concat(F.lit("^"), text, F.lit("$"))
    each = lambda n: F.regexp_extract_all(framed, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))
    return [F.transform(F.when(F.length(framed) < n, F.array(framed)).otherwise(each(n)), lambda g: F.concat(F.lit(mark), g)) for n in NGRAMS]


def features(urls: DataFrame) -> DataFrame:
    """urls with ``grams``: those of host and path, numbers in the path made
    alike."""
    path = F.regexp_replace("path", "[0-9]+", "0")
    return urls.withColumn("grams", F.concat(*_grams(F.col("host"), "h"), *_grams(path, "p")))


def _hashed(urls: DataFrame) -> DataFrame:
    return HashingTF(numFeatures=FEATURES, binary=True, inputCol="grams", outputCol="gram_vector").transform(urls)


def train(labelled: DataFrame, url_col: str = "url", label_col: str = "label") -> LogisticRegressionModel:
    """The model of a labelled table; rows of null url or label are left out."""
    rows = labelled.where(F.col(url_col).isNotNull() & F.col(label_col).isNotNull()).select(host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"), F.col(label_col).cast("double").alias("label"))
    return LogisticRegression(featuresCol="gram_vector", labelCol="label", regParam=0.001, maxIter=100).fit(_hashed(features(rows)).coalesce(1))


def judge_urls(pages: DataFrame, model: LogisticRegressionModel, rules: tuple = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict, block_score`` for each row.

    A rule fits its host and all subdomains when the path starts with the
    rule's; of those that fit the longest decides.  block_score is the model's
    probability, given for every row.

    Defined results: a null url or one without ``://`` has an empty host and
    path, so no rule fits and the model judges empty strings; repeated rows
    give repeated results; an empty table gives no rows; other columns are not
    looked at."""
    urls = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rule, said = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, said = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(said)
    scored = model.transform(_hashed(features(urls)))
    score = vector_to_array("probability")[1]
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(said, F.when(score >= 0.5, "block").otherwise("allow")).alias("verdict"), score.alias("block_score"))
