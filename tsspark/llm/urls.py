"""URL filter: listed rules first, then logistic regression on hashed character n-grams of host and path.

The model is fitted on a small labelled table of URLs, whose size is bounded by ``MAX_LABELLED``. Host and path
are n-grammed apart, each with marks at its ends, and hashed into one fixed vector. Scoring is one narrow pass.

Null URLs and URLs without ``://`` have an empty host and path; no rule fits them and the model judges the empty
strings. Repeated rows are judged alike, row by row.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, NGram, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsspark.llm.common import lower_ascii

FEATURES = 1 << 14
#: The labelled table may have this many rows; it is fitted by one task.
MAX_LABELLED = 10_000
#: Rules become one condition each; longer lists belong into a table to join.
MAX_RULES = 1_000


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; among equally long ones a block wins, then the first by name."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} are inlined.")
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.verdict == "block", r.text)):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        name = F.when(fits, F.lit(rule.text)).otherwise(name)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return name, verdict


def _features(df: DataFrame, host: Column, path: Column) -> DataFrame:
    chars = lambda x, mark: F.split(F.concat(F.lit(f"{mark}^"), x, F.lit("$")), "")
    return df.withColumn("u_host_chars", chars(host, "h")).withColumn("u_path_chars", chars(path, "p"))


def fit(labelled: DataFrame, url: str = "url", label: str = "label", sizes: tuple[int, ...] = (3, 4, 5)) -> PipelineModel:
    """``label`` 1 means unwanted. Rows with a null label or URL are left out."""
    rows = labelled.where(F.col(label).isNotNull() & F.col(url).isNotNull()).select(F.col(url).alias("u_url"), F.col(label).cast("double").alias("u_label"))
    n = rows.limit(MAX_LABELLED + 1).count()
    if n > MAX_LABELLED:
        raise ValueError(f"The labelled table has over {MAX_LABELLED} rows.")
    stages, columns = [], []
    for part in ("host", "path"):
        for size in sizes:
            grams = f"u_{part}_{size}"
            stages += [NGram(n=size, inputCol=f"u_{part}_chars", outputCol=grams), HashingTF(numFeatures=FEATURES, binary=True, inputCol=grams, outputCol=f"{grams}_v")]
            columns.append(f"{grams}_v")
    stages += [VectorAssembler(inputCols=columns, outputCol="u_features"), LogisticRegression(featuresCol="u_features", labelCol="u_label", probabilityCol="u_probability", rawPredictionCol="u_raw", predictionCol="u_prediction", regParam=0.01, standardization=False, maxIter=30)]
    table = _features(rows.coalesce(1).sort("u_url", "u_label"), host_of(F.col("u_url")), path_of(F.col("u_url")))
    return Pipeline(stages=stages).fit(table)


def judge(df: DataFrame, model: PipelineModel, rules: list[Rule], key: str = "page_id", url: str = "url", threshold: float = 0.5) -> DataFrame:
    """``key``, host, path, the rule that fits, the verdict, and the model's probability that the URL is unwanted."""
    base = df.select(F.col(key).alias("u_key"), F.col(url).alias("u_url"))
    parts = base.select("u_key", host_of(F.col("u_url")).alias("u_host"), path_of(F.col("u_url")).alias("u_path"))
    scored = model.transform(_features(parts, F.col("u_host"), F.col("u_path")))
    name, verdict = rule_of(F.col("u_host"), F.col("u_path"), rules)
    score = vector_to_array("u_probability")[1]
    return scored.select(
        F.col("u_key").alias(key),
        F.col("u_host").alias("host"),
        F.col("u_path").alias("path"),
        name.alias("rule"),
        F.coalesce(verdict, F.when(score >= threshold, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        score.alias("score"),
    )


#: The rules of the registered query.
RULES = [Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/")]

#: The labelled table of the registered query, hosts of unwanted and of ordinary sites.
UNWANTED = (
    "spam-farm.example.org", "www.cheap-pills.example.com", "blog.casino-win.example.net", "free-bets.example.net", "m.ads-track.example.com",
    "adult-x.example.com", "casino-bonus.test", "online-casino.test", "bet-win.test", "free-casino.test", "cheap-meds.test", "pills-online.test",
    "adult-videos.test", "xxx-adult.test", "track-ads.test", "ads-click.test", "link-farm.test", "spam-links.test", "free-money.test", "win-prize.test",
)
ORDINARY = (
    "ththth.example.com", "therin.example.net", "blog.ththre.example.org", "m.tiontion.example.com", "www.therti.example.net", "tionsh.example.net",
    "library.test", "www.university.test", "news.daily.test", "blog.gardening.test", "m.weather.test", "docs.python.test", "wiki.history.test",
    "www.museum.test", "health.hospital.test", "recipes.kitchen.test", "maps.travel.test", "music.school.test", "forum.cycling.test", "www.science.test",
)
PATHS = ("/en/12", "/fr/345.html", "/de/678/", "/es/901")


def seed_table(spark) -> DataFrame:
    rows = [(f"https://{h}{p}", y) for hosts, y in ((UNWANTED, 1), (ORDINARY, 0)) for h in hosts for p in PATHS]
    return spark.createDataFrame(rows, "url string, label int")
