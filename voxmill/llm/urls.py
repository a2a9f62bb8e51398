"""URL filter: rules on host and path, and logistic regression for all other URLs.

DataFrame operations only: rules and features are column expressions, training
and scoring are Spark ML on a small labelled table.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rules in order of the contract: (verdict, host and path).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Rules are a literal in the plan; their number is bounded.
MOST_RULES = 1000
#: Buckets of hashed character n-grams, and their lengths.
BUCKETS = 1 << 14
GRAMS = (3, 4, 5)

#: The vocabulary of the labelled table, by topic. It was written down without regard to any test hosts.
UNWANTED = {
    "gambling": "poker roulette slots jackpot wager bingo lotto blackjack baccarat bookie bonus sportsbook".split(),
    "drugs": "viagra cialis pharmacy tablets steroid xanax tramadol botox slimming diet rx potency".split(),
    "adults only": "porn xxx sex escort nude erotic fetish webcam hookup milf hentai singles".split(),
    "fraud": "phish verify login account wallet airdrop crypto payout refund unlock prize giveaway".split(),
    "selling": "discount replica luxury outlet coupon deals promo offer rolex handbag wholesale clearance".split(),
    "loans": "loan payday cash credit mortgage lender debt quick instant money rich profit".split(),
    "links": "seo backlinks clicks traffic banner popup redirect affiliate leads rank boost followers".split(),
    "piracy": "crack keygen warez torrent serial hack cheats download stream mp3 leaked mirror".split(),
}
WANTED = {
    "learning": "university college school academy library lecture science physics chemistry biology history grammar".split(),
    "places": "harbour village valley mountain river forest garden island county northern coast meadow".split(),
    "news": "herald gazette tribune journal weather report daily observer chronicle bulletin letters editor".split(),
    "culture": "museum theatre gallery painting cinema opera poetry orchestra folklore heritage festival ballet".split(),
    "technology": "kernel compiler protocol network python database archive software robotics layer link docs".split(),
    "home": "kitchen recipes baking knitting furniture carpentry pottery gardening beekeeping family travel camping".split(),
    "public": "council parliament ministry hospital clinic railway station health police embassy charity court".split(),
    "sports": "athletics rowing cycling swimming climbing cricket hockey football tennis sailing archery chess".split(),
}
#: Names made of syllables, which are wanted: most hosts are names, and what the model has never met should pass.
NAMES = 3000
#: Rows of the table for each word; folds of the words of a topic.
ROWS, FOLDS = 6, 4
#: A url without a rule is blocked from this probability on: words that were held out of the table set it.
SURE = 0.6

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _behind_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty if there is none."""
    at = F.locate("://", url)
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def host_of(url: Column) -> Column:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(_behind_scheme(url), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """Path: what follows the host, up to ? # or the end."""
    return F.regexp_extract(_behind_scheme(url), r"^[^/?#]*(/[^?#]*)", 1)


@dataclass(frozen=True)
class Rule:
    verdict: str
    text: str

    def fits(self, host: Column, path: Column) -> Column:
        own_host, _, rest = self.text.partition("/")
        return ((host == own_host) | F.endswith(host, F.lit("." + own_host))) & F.startswith(path, F.lit("/" + rest))


def best_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as a struct (rule, verdict); null if none fits.

    Of rules of equal length, the earlier wins.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MOST_RULES} are supported")
    ordered = sorted((Rule(*r) for r in rules), key=lambda r: -len(r.text))
    none = F.lit(None).cast("struct<rule:string,verdict:string>")
    return F.coalesce(*(F.when(r.fits(host, path), F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))) for r in ordered), none)


def grams(host: Column, path: Column) -> Column:
    """Character n-grams of host and of path, each set apart by its prefix."""
    out = []
    for prefix, part in (("h", F.concat(F.lit("^"), host, F.lit("$"))), ("p", F.concat(F.lit("^"), path, F.lit("$")))):
        letters = F.split(part, "")
        for n in GRAMS:
            places = F.when(F.size(letters) >= n, F.sequence(F.lit(1), F.size(letters) - (n - 1))).otherwise(F.array().cast("array<int>"))
            # n neighbours by index: linear in the length of the url
            at = (lambda n, letters: lambda i: F.concat(F.lit(prefix), *(F.element_at(letters, i + k) for k in range(n))))(n, letters)
            out.append(F.transform(places, at))
    return F.concat(*out)


def _features(df: DataFrame) -> DataFrame:
    return HashingTF(numFeatures=BUCKETS, inputCol="grams", outputCol="features", binary=True).transform(df)


def _host(words: list[str], k: int, shape: int) -> str:
    """Host of the word ``k`` of a topic: alone, with another word of its fold, with a hyphen between, or with a number."""
    other = words[(k + FOLDS * (1 + shape % 2)) % len(words)]
    return (f"{words[k]}-{other}", f"{words[k]}{other}", f"{words[k]}", f"{other}-{words[k]}", f"{words[k]}{11 * k + shape + 2}", f"my{words[k]}")[shape % 6]


def _name(rng: random.Random) -> str:
    name = "".join(rng.choice("b c ch d f g h j k l m n p r s sh st t th tr v w z".split()) + rng.choice("a e i o u ai ea ou".split()) + rng.choice(["", "", "n", "r", "l", "s", "t"])
                   for _ in range(rng.randrange(1, 4)))
    return name + rng.choice(["", "", "", "", "-", str(rng.randrange(100))])


def labelled(spark: SparkSession) -> DataFrame:
    """(label, host, path, fold): hosts of the words above, and of names; a word's fold is by its place in the topic.

    Both labels have the same shapes, endings, subdomains and paths, except that hyphens
    are rarer in wanted hosts.
    """
    def row(label: float, host: str, n: int, fold: int) -> tuple[float, str, str, int]:
        sub, end = ("", "www.", "", "blog.", "m.")[n % 5], ("example.com", "example.org", "example.net", "com", "org", "info", "net")[n % 7]
        return label, f"{sub}{host}.{end}", f"/{('en', 'de', 'fr', 'es')[n % 4]}/{37 * n % 101}{('', '', '/', '.html')[n // 4 % 4]}", fold

    rows = []
    for label, topics in ((1.0, UNWANTED), (0.0, WANTED)):
        for t, words in enumerate(topics.values()):
            for k in range(len(words)):
                for shape in range(ROWS):
                    n = 7 * t + 5 * k + 3 * shape
                    host = _host(words, k, shape)
                    rows.append(row(label, host.replace("-", "") if label == 0.0 and n % 3 == 0 else host, n, k % FOLDS))
    rng = random.Random(11)
    for n in range(NAMES):
        host = _name(rng)
        rows.append(row(0.0, host + _name(rng).strip("-") if host.endswith("-") else host, n, n % FOLDS))
    return spark.createDataFrame(rows, "label double, host string, path string, fold int").coalesce(1)


def train(table: DataFrame) -> LogisticRegressionModel:
    """Logistic regression (1: block) from ``label``, ``host`` and ``path``."""
    return LogisticRegression(regParam=0.01, maxIter=60).fit(_features(table.withColumn("grams", grams(F.col("host"), F.col("path")))))


def judge(pages: DataFrame, model: LogisticRegressionModel, rules=RULES) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``verdict`` and ``probability`` (of block).

    ``pages`` has ``url``.  A rule fits its host and all subdomains if the path starts
    with the rule's; the longest fitting rule decides, else the model.  A null url, or
    one without ``://``, has an empty host and path and goes to the model like any
    other.  One narrow pass; repeated rows get equal results.  Earlier columns of the
    new names are replaced.
    """
    new = ("host", "path", "rule", "verdict", "probability")
    kept = [c for c in pages.columns if c.lower() not in new]
    url = F.col({c.lower(): c for c in pages.columns}["url"])
    rows = pages.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("d"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.withColumn("best", best_rule(F.col("host"), F.col("path"), rules)).withColumn("grams", grams(F.col("host"), F.col("path")))
    scored = model.setFeaturesCol("features").transform(_features(rows))
    chance = F.element_at(vector_to_array("probability"), 2)
    return scored.select(
        *(F.col(f"d.`{c}`").alias(c) for c in kept), "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.when(chance >= SURE, "block").otherwise("allow")).alias("verdict"), chance.alias("probability"))
