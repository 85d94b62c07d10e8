"""URL verdicts: the longest fitting rule, else gradient-boosted trees on lexical features. DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixeltide.llm.common import ascii_lower, stored

#: Labelled rows (distinct feature rows with a weight) that the trees are fitted on, a documented bound.
TRAIN_ROWS = 10_000
#: Suffixes with fewer labelled URLs share one statistic.
SUFFIX_SUPPORT = 20
#: Parts that hosts are dealt to for out-of-fold statistics.
FOLDS = 5
TREES, DEPTH = 20, 4
#: Rules that are one expression; longer lists are joined.
MOST_RULES = 1000

FEATURES = (
    "length", "host_length", "depth", "labels", "digit_ratio", "entropy", "parameters", "hyphens", "secure", "fragment", "suffix_rate", "folder_rate",
)


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def rule(verdict: str, text: str) -> Rule:
    host, slash, path = text.partition("/")
    return Rule(verdict, host, slash + path)


RULES = (
    rule("allow", "com/"), rule("block", "example.com/en/"), rule("allow", "www.example.com/en/"), rule("block", "net/es/"), rule("block", "net/fr/"),
)


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): host after the first :// up to / ? # or the end, A-Z lower-cased; path up to ? # or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits host (or a parent of it) and the start of path; nulls if none does.

    Rules of one length: the longer host first, then block before allow.
    """
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), len(r.host), r.verdict == "block")):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        text, verdict = F.when(fits, F.lit(r.text)).otherwise(text), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return text, verdict


def with_rule(urls: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """urls (host, path, ...) with the rule that decides and its verdict, by_rule; up to MOST_RULES rules are one expression, more a join.

    The join meets rules by host suffix and path prefix: a host has a suffix per label, a path a prefix per length that rules have.
    """
    if len(rules) <= MOST_RULES:
        text, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
        return urls.withColumns({"rule": text, "by_rule": verdict})
    table = urls.sparkSession.createDataFrame([(r.host, r.path, r.text, r.verdict) for r in rules], "rule_host string, rule_path string, text string, verdict string")
    sizes = F.array(*[F.lit(n) for n in sorted({len(r.path) for r in rules})])
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    parts = urls.select("host", "path").distinct().select("host", "path", F.explode(suffixes).alias("rule_host"), F.filter(sizes, lambda n: n <= F.length("path")).alias("n"))
    parts = parts.select("host", "path", "rule_host", F.explode("n").alias("n")).withColumn("rule_path", F.substring("path", F.lit(1), F.col("n")))
    rank = F.struct(F.length("text"), F.length("rule_host"), F.col("verdict") == "block")
    best = parts.join(table, ["rule_host", "rule_path"]).groupBy("host", "path").agg(F.max_by(F.struct("text", "verdict"), rank).alias("best"))
    return urls.join(best, ["host", "path"], "left").select(*urls.columns, F.col("best.text").alias("rule"), F.col("best.verdict").alias("by_rule"))


def _count(text: Column, what: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))


def _bin(value: Column, width: float, most: int = 30) -> Column:
    """Few whole numbers, so that every split of the trees is a value that occurs."""
    return F.least(F.floor(value / width), F.lit(most)).cast("double")


def lexical(urls: DataFrame) -> DataFrame:
    """urls (url, host, path) with its lexical features, suffix and first folder."""
    url = F.coalesce("url", F.lit(""))
    size = F.greatest(F.length(url), F.lit(1))
    characters = F.array_distinct(F.split(url, ""))
    share = lambda c: (F.length(url) - F.length(F.replace(url, c, F.lit("")))) / size
    entropy = F.aggregate(characters, F.lit(0.0), lambda a, c: a - F.when(share(c) > 0, share(c) * F.log2(share(c))).otherwise(0.0))
    digits = F.length(url) - F.length(F.translate(url, "0123456789", ""))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return urls.withColumns(
        {
            "length": _bin(F.length(url), 8),
            "host_length": _bin(F.length("host"), 3),
            "depth": _bin(_count(F.col("path"), "/"), 1),
            "labels": _bin(_count(F.col("host"), "."), 1),
            "digit_ratio": _bin(digits / size, 1 / 30),
            "entropy": _bin(entropy, 0.2),
            "parameters": _bin(F.when(query == "", 0).otherwise(_count(query, "&") + 1), 1),
            "hyphens": _bin(_count(F.col("host"), "-"), 1),
            "secure": F.startswith(url, F.lit("https")).cast("double"),
            "fragment": F.contains(url, F.lit("#")).cast("double"),
            "suffix": F.regexp_extract("host", r"([^.]*)$", 1),
            "folder": F.regexp_extract("path", r"^/([^/]*)/", 1),
        }
    )


@dataclass
class UrlModel:
    """Fitted on labelled URLs: suffix and folder statistics as tables, and the trees; no trees if one label is all there is."""

    rates: dict[str, DataFrame]
    prior: float
    trees: GBTClassificationModel | None


def _with_rates(rows: DataFrame, rates: dict[str, DataFrame], prior: float) -> DataFrame:
    for key, table in rates.items():
        # No hint: the optimizer sends the table out only if its measured size allows.
        rows = rows.join(table, key, "left").withColumn(f"{key}_rate", F.coalesce(f"{key}_rate", F.lit(_bin_of(prior))))
    return rows


def _bin_of(rate: float) -> float:
    return float(int(rate * 20))


def _shares(key: str, n: Column, b: Column, prior: float) -> Column:
    return F.floor(20 * (b + 5 * prior) / (n + 5)).cast("double").alias(f"{key}_rate")


def fold_of(host: Column) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(host, F.lit(""))), F.lit(FOLDS)).cast("int")


def fit_urls(labelled: DataFrame, train_rows: int = TRAIN_ROWS) -> UrlModel:
    """labelled: (url, host, path, label) with label 1 for block.

    Suffix and folder statistics are shares of blocked URLs over all labelled rows, smoothed. The trees see them out of fold: hosts
    are dealt to folds, and a labelled row's statistics leave its own fold out, so that they say as much of it as of a host never seen.
    Both labels weigh alike, since how often a labeller hands out one says little of the URLs that are left. Labelled rows are then
    summed up to distinct feature rows with a weight before anything is drawn; of those, a hash draws about ``train_rows``.
    """
    rows = stored(lexical(labelled).withColumn("fold", fold_of(F.col("host"))))
    total = rows.agg(F.count("*").alias("n"), F.avg("label").alias("p")).first()
    prior = total.p or 0.0
    rates, apart = {}, {}
    for key in ("suffix", "folder"):
        each = stored(rows.groupBy(key, "fold").agg(F.count("*").alias("n"), F.sum("label").alias("b")))
        counted = each.groupBy(key).agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
        enough = counted.filter(F.col("n") >= SUFFIX_SUPPORT)
        rates[key] = stored(enough.select(key, _shares(key, F.col("n"), F.col("b"), prior)))
        rest = each.join(counted.withColumnsRenamed({"n": "all_n", "b": "all_b"}), key).select(key, "fold", (F.col("all_n") - F.col("n")).alias("n"), (F.col("all_b") - F.col("b")).alias("b"))
        apart[key] = stored(rest.filter(F.col("n") >= SUFFIX_SUPPORT).select(key, "fold", _shares(key, F.col("n"), F.col("b"), prior)))
    if not 0.0 < prior < 1.0:
        return UrlModel(rates, prior, None)
    seen = rows
    for key, table in apart.items():
        seen = seen.join(table, [key, "fold"], "left").withColumn(f"{key}_rate", F.coalesce(f"{key}_rate", F.lit(_bin_of(prior))))
    alike = F.when(F.col("label") == 1.0, F.lit(0.5 / prior)).otherwise(F.lit(0.5 / (1.0 - prior)))
    distinct = stored(seen.groupBy(*FEATURES, "label").agg(F.count("*").cast("double").alias("weight")).withColumn("weight", F.col("weight") * alike))
    n = distinct.count()
    draw = F.pmod(F.xxhash64(*FEATURES), F.lit(1_000_000)) < int(1_000_000 * min(1.0, train_rows / n)) + 1
    train = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(distinct.filter(draw))
    gbt = GBTClassifier(labelCol="label", weightCol="weight", maxIter=TREES, maxDepth=DEPTH, maxBins=32, stepSize=0.3, seed=7)
    return UrlModel(rates, prior, gbt.fit(train.select("features", "label", "weight")))


def held_out_quality(labelled: DataFrame) -> DataFrame:
    """(label, n, right): how the trees judge the hosts of one fold after learning from those of all others; labelled (url, label)."""
    host, path = url_parts(F.col("url"))
    known = labelled.select("url", F.col("label").cast("double").alias("label")).withColumns({"host": host, "path": path}).filter("label is not null")
    own = fold_of(F.col("host")) == 0
    scored = score_urls(known.filter(own), fit_urls(known.filter(~own)))
    return scored.groupBy("label").agg(F.count("*").alias("n"), F.count_if((F.col("block_score") >= 0.5) == (F.col("label") == 1.0)).alias("right"))


def score_urls(urls: DataFrame, model: UrlModel) -> DataFrame:
    """urls (url, host, path, ...) with block_score in 0..1."""
    rows = _with_rates(lexical(urls), model.rates, model.prior)
    if model.trees is None:
        scored = rows.withColumn("block_score", F.lit(float(model.prior)))
    else:
        rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
        scored = model.trees.transform(rows).withColumn("block_score", vector_to_array("probability")[1])
    return scored.select(*urls.columns, "block_score")


def judged_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[Rule, ...] = RULES, labelled: DataFrame | None = None) -> DataFrame:
    """(id_col, host, path, rule, verdict, block_score) per row.

    Rules decide what they fit; the trees judge the rest, and block from a score of one half. The labelled URLs are ``labelled``
    (url, label) or else the rows that a rule decides, with its verdict. A null url or one without :// has an empty host and path and is
    judged by the trees. With no labelled rows everything left is allowed; with a single label, it gets that. Repeated rows
    get equal results; other columns are not read.
    """
    source = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    host, path = url_parts(F.col("url"))
    source = source.withColumns({"host": host, "path": path})
    source = with_rule(source, rules)
    if labelled is None:
        known = source.filter("by_rule is not null").select("url", "host", "path", (F.col("by_rule") == "block").cast("double").alias("label"))
    else:
        host, path = url_parts(F.col("url"))
        known = labelled.select("url", F.col("label").cast("double").alias("label")).withColumns({"host": host, "path": path})
        known = known.filter("label is not null")
    scored = score_urls(source, fit_urls(known))
    by_trees = F.when(F.col("block_score") >= 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("by_rule", by_trees).alias("verdict"), "block_score")
