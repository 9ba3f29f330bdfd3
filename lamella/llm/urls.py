"""URL filters: longest-match host and path rules, then gradient-boosted trees on lexical features.

URLs that a rule fits are labelled by it; at most ``sample`` of them, those with the smallest hashes, train the trees
(Spark's own), which judge the URLs that no rule fits.  Features: lengths, depth, labels of the host, ratio of digits, entropy
of characters, numbers of parameters, hyphens and capitals, kind of file ending, and how the labelled URLs of the same
host suffix (last label), and those with the same first segment of the path, are judged, smoothed; -1 where none is labelled.

A training URL's statistics leave out the labels of its fold of hosts, all of a host's URLs being in one of ``FOLDS`` folds: leaving out its
own label alone would tell it.  Each training URL is fitted three times, also as if its suffix and as if its segment had no
labelled URL, so that the trees have met what they will judge by on a suffix that no rule speaks of.

Cases: a null URL or one without ``://`` has empty host and path and is judged by the trees; without labelled
URLs of both verdicts there is no model, and ``default`` is the verdict; null ids and rows that repeat get a verdict
each; of other columns none is kept.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SMALL_ROWS, join_hot, materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: most labelled URLs that the trees are fitted on, and folds of hosts
SAMPLE, FOLDS = 20_000, 5
STATS = ("suffix", "segment")
#: (verdict, host and path): a rule fits its host and all subdomains of it
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))


def parts(url: Column) -> tuple[Column, Column, Column]:
    """(host, path, rest from ``?`` or ``#``), each empty for null or where ``://`` is missing."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    after = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    get = lambda k: F.regexp_extract(after, "^([^/?#]*)([^?#]*)((?s).*)$", k)
    return F.translate(get(1), UPPER, LOWER), get(2), get(3)


def matched(host: Column, path: Column, rules=RULES) -> Column:
    """struct<rule, verdict> of the longest rule that fits, or null.  Rules are a short list, tried from the longest."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        h, slash, p = rule.partition("/")
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(slash + p))
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def entropy(text: Column) -> Column:
    """Bits a character."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.greatest(F.size(chars), F.lit(1)).cast("double")

    def bits(c):
        k = (F.size(chars) - F.size(F.array_remove(chars, c))) / n
        return -k * F.log2(k)

    return F.aggregate(F.transform(F.array_distinct(chars), bits), F.lit(0.0), lambda acc, x: acc + x)


def features(url: Column, host: Column, path: Column, rest: Column) -> dict[str, Column]:
    url = F.coalesce(url, F.lit(""))
    n = F.greatest(F.length(url), F.lit(1)).cast("double")
    return {
        "f_length": F.length(url).cast("double"), "f_host_length": F.length(host).cast("double"), "f_path_length": F.length(path).cast("double"), "f_depth": _count(path, "/[^/]"), "f_labels": _count(host, r"[^.]+"),
        "f_digits": _count(url, "[0-9]") / n, "f_entropy": entropy(F.concat(host, path)), "f_params": _count(rest, "[^?&#=]+="), "f_hyphens": _count(host, "-"), "f_capitals": _count(url, "[A-Z]") / n, "f_fragment": F.contains(rest, F.lit("#")).cast("double"),
        "f_ending": _count(path, r"\.[A-Za-z0-9]{1,5}$"), "f_slash": F.endswith(path, F.lit("/")).cast("double"), "f_secure": F.startswith(url, F.lit("https")).cast("double"),
    }


def prepare(pages: DataFrame, id_col: str, url_col: str, rules) -> DataFrame:
    """id, host, path, rule, ruled (the rule's verdict), suffix, segment, fold and features of each row."""
    host, path, rest = parts(F.col(url_col))
    d = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host.alias("host"), path.alias("path"), rest.alias("rest"))
    d = d.withColumn("m", matched(F.col("host"), F.col("path"), rules))
    made = features(*(F.col(c) for c in ("url", "host", "path", "rest")))
    return d.select("id", "url", "host", "path", F.col("m.rule").alias("rule"), F.col("m.verdict").alias("ruled"), F.substring_index("host", ".", -1).alias("suffix"), F.regexp_extract("path", "^/([^/]*)", 1).alias("segment"), F.pmod(F.xxhash64("host"), F.lit(FOLDS)).cast("int").alias("fold"), *(c.alias(n) for n, c in made.items()))


def statistics(prepared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For suffixes and segments: (value, rows, blocked, n), the last two of labelled rows, and both again for each fold as arrays."""
    out = []
    for c in STATS:
        block, known = (F.col("ruled") == "block").cast("double"), F.col("ruled").isNotNull()
        own = [F.sum(F.when(known & (F.col("fold") == k), e)).alias(f"{name}{k}") for name, e in (("b", block), ("n", F.lit(1.0))) for k in range(FOLDS)]
        g = prepared.groupBy(c).agg(F.count("*").alias("rows"), F.sum(F.when(known, block)).alias("blocked"), F.count("ruled").cast("double").alias("n"), *own)
        folds = [F.array(*(F.coalesce(f"{name}{k}", F.lit(0.0)) for k in range(FOLDS))).alias(f"{name}s") for name in "bn"]
        out.append(materialize(g.where("n > 0").select(c, "rows", "blocked", "n", *folds), f"url-{c}"))
    return tuple(out)


def fit(prepared: DataFrame, sample: int = SAMPLE, rounds: int = 15, depth: int = 4):
    """(model, statistics of suffixes and segments) from the labelled rows; the model is None where they hold one verdict only."""
    stats = statistics(prepared)
    train = prepared.where("ruled is not null").withColumn("label", (F.col("ruled") == "block").cast("double"))
    train = train.orderBy(F.xxhash64("url"), "url", "id").limit(sample)
    train = materialize(with_stats(materialize(train, "url-sample"), stats, True), "url-train")
    if train.select("label").distinct().count() < 2:
        return None, stats
    names = [c for c in train.columns if c.startswith("f_")]
    every = train
    for c in STATS:
        every = every.unionByName(train.withColumn(f"f_{c}", F.lit(-1.0)))
    gbt = GBTClassifier(featuresCol="x", labelCol="label", maxIter=rounds, maxDepth=depth, stepSize=0.3, seed=7)
    return Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="x"), gbt]).fit(every), stats


def with_stats(prepared: DataFrame, stats: tuple[DataFrame, DataFrame], training: bool = False) -> DataFrame:
    """Suffix and segment statistics joined on; those of ``training`` rows leave their own fold out.  ``prepared`` is a written table."""
    for k, (c, table) in enumerate(zip(STATS, stats, strict=True)):
        if table.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS:
            d = prepared.join(F.broadcast(table.drop("rows")), c, "left")
        else:  # values of very many rows are broadcast, the others shuffled
            d = join_hot(prepared if k == 0 else materialize(prepared, "url-stats"), table, [c], "rows", "left")
        n, blocked = F.coalesce("n", F.lit(0.0)), F.coalesce("blocked", F.lit(0.0))
        if training:
            n, blocked = n - F.coalesce(F.col("ns")[F.col("fold")], F.lit(0.0)), blocked - F.coalesce(F.col("bs")[F.col("fold")], F.lit(0.0))
        prepared = d.withColumn(f"f_{c}", F.when(n > 0, (blocked + 1) / (n + 2)).otherwise(-1.0)).drop("n", "blocked", "ns", "bs")
    return prepared


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, sample: int = SAMPLE, default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict) of each row."""
    prepared = materialize(prepare(pages, id_col, url_col, rules), "url-features")
    model, stats = fit(prepared, sample)
    d = with_stats(prepared, stats)
    if model is None:
        by_model = F.lit(default)
    else:
        d = model.transform(d)
        by_model = F.when(F.col("prediction") > 0.5, "block").otherwise("allow")
    return d.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", by_model).alias("verdict"))


def op9_url_filters(spark, sf_dir):
    """Verdicts on the URLs of all ``pages``."""
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))
