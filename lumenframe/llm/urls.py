"""URL filters in DataFrame functions: rules for hosts and paths, and a logistic regression on hashed n-grams for the rest."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Lengths of n-grams, buckets that they are hashed into, weight of the penalty, and most labelled rows of a fit.
GRAMS, BUCKETS, PENALTY, LABELLED = (3, 4), 2048, 0.002, 20_000
#: Multiplier and modulus of the rolling hash of a gram's code points.
FACTOR, MODULUS = 1_000_003, (1 << 31) - 1


class Rule(NamedTuple):
    """Holds for a host and its subdomains, and for paths that begin with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


# The rules of the query.
RULES = (Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"), Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"))

#: The labelled table of the query: names of hosts of each kind, each in every shape, so that only the name tells them apart.
BLOCKED = """
casino mega-casino casino-royal lucky-casino online-casino poker poker-win big-win win-slots jackpot jackpot-win roulette sports-bets best-bets bets-online free-spins free-money free-prizes
cheap-meds cheap-viagra diet-pills blue-pills pills-shop cheap-watches cheap-loans replica-watches spam spam-mails spam-links link-farm content-farm click-farm adult adult-video adult-chat
xxx-adult hot-xxx porn-x sex-x ads ads-click ads-server track-ads click-track ad-track pop-ads user-track warez-crack payday-loans quick-loans phish-login fake-bank malware-drop
""".split()
ALLOWED = """
library national-archive weather station nation mother theatre education other thoughts river garden thesis weathering nutrition kitchen history physics-notes chemistry train-times city-council
northern university together museum parliament astronomy heritage health-advice short-stories translation gather translator thunder lighthouse therapy action fashion session breath teaching
wording thistle shelter anthem bridge-club lesson-plans open-data long-walks thread thirty south month north rhythm path method author earth depth growth worth youth health truth faith
motion ocean region notion lotion option mention portion fiction section question solution tradition position condition attention nothing something anything thing think than that these
""".split()
SHAPES = """
http://{}.example.net/en/12 https://{}.example.org/de/345.html http://www.{}.example.com/fr/7?page=2 https://www.{}.example.net/es/81/ http://m.{}.example.org/en/950#top https://blog.{}.example.com/en/604
""".split()


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z as a-z) and path of an address; both empty for null and without ``://``."""
    of = lambda i: F.coalesce(F.regexp_extract(url, PARTS, i), F.lit(""))
    return F.translate(of(1), UPPER, LOWER), of(2)


def rule_of(host: Column, path: Column, rules: Sequence[Rule], what) -> Column:
    """``what`` of the longest rule that fits (of equal ones the first in order of text), else null."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (-len(r.text), r.text), reverse=True):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        out = F.when(fits, F.lit(what(r))).otherwise(out)
    return out


def buckets(host: Column, path: Column, sizes: Sequence[int] = GRAMS, room: int = BUCKETS) -> Column:
    """The buckets of all n-grams of ``^host$`` and of ``path$``, with repeats: a rolling hash of their code points."""

    def of(text: Column, salt: int) -> Column:
        codes = F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), lambda c: F.ascii(c).cast("long"))

        def grams(cs: Column, n: int) -> Column:
            def bucket(i: Column) -> Column:
                h = F.lit(salt * 16 + n).cast("long")
                for k in range(n):
                    h = (h * FACTOR + F.get(cs, i + k)) % MODULUS
                return (h % room).cast("int")

            return F.when(F.size(cs) >= n, F.transform(F.sequence(F.lit(0), F.size(cs) - n), bucket)).otherwise(F.array().cast("array<int>"))

        return F.element_at(F.transform(F.array(codes), lambda cs: F.concat(*[grams(cs, n) for n in sizes])), 1)

    return F.concat(of(F.concat(F.lit("^"), host, F.lit("$")), 1), of(F.concat(path, F.lit("$")), 2))


def features(urls: DataFrame, host: str = "host", path: str = "path", out: str = "features") -> DataFrame:
    """Add the counts of the buckets of a host and a path, as a sparse vector of length 1 (zero without grams)."""
    own = f"_{uuid.uuid4().hex}"
    counted = CountVectorizerModel.from_vocabulary([str(k) for k in range(BUCKETS)], inputCol=own, outputCol=f"{own}_n")
    rows = counted.transform(urls.withColumn(own, buckets(F.col(host), F.col(path)).cast("array<string>")))
    return Normalizer(p=2.0, inputCol=f"{own}_n", outputCol=out).transform(rows).drop(own, f"{own}_n")


def fit(labelled: DataFrame, url_col: str = "url", label_col: str = "blocked", penalty: float = PENALTY, most: int = LABELLED) -> LogisticRegressionModel:
    """A logistic regression on a labelled table (label 1: to be blocked) of at most ``most`` rows (beyond: an error).

    Rows without a label are left out; null addresses count as empty. Rows of one kind alone give that kind for every
    address, no rows at all are an error. Repeated rows weigh as often as they occur; other columns are not looked at.
    """
    host, path = parts(labelled[url_col].cast("string"))
    rows = labelled.select(host.alias("host"), path.alias("path"), labelled[label_col].cast("double").alias("label")).where("label is not null")
    if not 0 < (n := rows.limit(most + 1).count()) <= most:
        raise ValueError(f"from 1 to {most} labelled rows are needed, not {n}")
    return LogisticRegression(regParam=penalty, elasticNetParam=0.0, standardization=False, family="binomial", tol=1e-10, maxIter=500).fit(features(rows).select("features", "label"))


def judge(pages: DataFrame, model: LogisticRegressionModel, url_col: str = "url", rules: Sequence[Rule] = RULES, least: float = 0.5) -> DataFrame:
    """Add host, path, rule (the longest that fits, else null), verdict (allow or block) and score.

    The rule decides; without one, ``block`` if the model's probability (``score``) is above ``least``. A null or empty
    address has no host and no path, and is judged by the model like any other; addresses of any length count whole.
    Columns of these names are replaced, others stay; repeated rows are judged one by one; an empty table gives an
    empty one. Row by row in the JVM: nothing moves, whatever the distribution of hosts.
    """
    own = f"_{uuid.uuid4().hex}"
    host, path = parts(pages[url_col].cast("string"))
    named = pages.withColumns({"host": host, "path": path})
    rule, said = (rule_of(F.col("host"), F.col("path"), rules, what) for what in (lambda r: r.text, lambda r: r.verdict))
    named = features(named.withColumns({"rule": rule, "verdict": said}), out=own)
    names = {"setPredictionCol": f"{own}_y", "setRawPredictionCol": "", "setProbabilityCol": f"{own}_p"}
    judging = model.copy()
    for k, v in names.items():
        getattr(judging, k)(v)
    judged = judging.setFeaturesCol(own).transform(named).withColumn("score", vector_to_array(F.col(f"{own}_p"))[1])
    return judged.withColumn("verdict", F.coalesce("verdict", F.when(F.col("score") > least, "block").otherwise("allow"))).drop(own, f"{own}_y", f"{own}_p")


def addresses(names: Sequence[str]) -> list[str]:
    return [shape.format(n) for n in names for shape in SHAPES]


def labelled(spark: SparkSession) -> DataFrame:
    """The labelled table of the query."""
    return spark.createDataFrame([(u, k) for k, names in enumerate((ALLOWED, BLOCKED)) for u in addresses(names)], "url string, blocked int").coalesce(1)
