r"""URL filters: listed rules first, then gradient-boosted trees over lexical features, in DataFrame functions alone.

URLs that a rule decides are the labelled ones. The trees learn on at most TRAIN_ROWS distinct ones, at most half of each
verdict: those of the smallest hashes, so a URL that many rows share counts once, and the bound holds for any number of rows.
The trees judge every URL that no rule fits. Features: lengths, depth, ratio of digits, entropy of the characters, labels,
hyphens and parameters counted, and two statistics of the host's suffix (its last label) among the sample: the logarithm of
how often it occurs and the smoothed share of blocked ones. Labels come from hosts, so a row that learns takes the
statistics of the other folds only; rows that are judged take those of the whole sample. The suffixes' table has at most
as many rows as the sample, so it is broadcast. Nothing else moves: judging is one pass over the URLs.

Defined results: a URL that is null or has no `://` has an empty host and path, no rule fits it, and the trees judge it as
any other. Very long URLs are judged whole. Where the labelled URLs are all of one verdict, or there are none, the method's
verdict is that one, or allow. Repeated rows are judged one by one, each alike; ties of hashes go to the smaller URL. Other
columns take no part, whatever their names. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import settled

#: Verdict, host, path.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Labelled URLs that the trees learn on, at most.
TRAIN_ROWS = 20_000
#: Lots that a URL's hash draws from, and how many more URLs than wanted are drawn before the exact cut, as their number is an estimate.
LOTS, SPARE = 1 << 62, 2
TREES, DEPTH, SEED = 12, 4, 7
#: The sample's folds: suffix statistics of a row come from the others, and the first is held out where accuracy is measured.
FOLDS = 5
#: Pseudo-counts of a suffix's share.
PRIOR = 10.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ("url_length", "host_length", "path_length", "depth", "digits", "entropy", "labels", "hyphens", "parameters", "suffix_count", "suffix_share")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Between the first :// and the next / ? # or the end, A-Z lower-cased; then up to ? # or the end."""
    rest = F.when(F.contains(url, F.lit("://")), F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does. A rule fits its host, all subdomains, and paths that begin with its own."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(said)).otherwise(verdict)
    return name, verdict


def lexical(rows: DataFrame) -> DataFrame:
    """Adds the features of (url, host, path) that need no statistics, and the suffix."""
    url = F.coalesce(F.col("url"), F.lit(""))
    chars = F.split(url, "")
    n = F.greatest(F.length(url), F.lit(1))
    share = lambda c: (F.length(url) - F.length(F.replace(url, c))) / n
    entropy = F.aggregate(F.array_distinct(F.filter(chars, lambda c: c != "")), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))
    asked = F.regexp_extract(url, r"\?([^#]*)", 1)
    count = lambda x, one: (F.length(x) - F.length(F.replace(x, F.lit(one)))).cast("double")
    return rows.select(
        "*",
        F.element_at(F.split("host", r"\."), -1).alias("suffix"),
        F.length(url).cast("double").alias("url_length"), F.length("host").cast("double").alias("host_length"), F.length("path").cast("double").alias("path_length"),
        F.size(F.filter(F.split("path", "/"), lambda x: x != "")).cast("double").alias("depth"),
        (F.length(F.regexp_replace(url, "[^0-9]", "")) / n).cast("double").alias("digits"),
        F.coalesce(entropy, F.lit(0.0)).alias("entropy"),
        count(F.col("host"), ".").alias("labels"), count(url, "-").alias("hyphens"),
        F.when(asked == "", 0.0).otherwise(count(asked, "&") + 1.0).alias("parameters"),
    )


def sample(labelled: DataFrame, most: int) -> DataFrame:
    """The at most most/2 distinct URLs of each verdict that have the smallest hashes. labelled: url, said and what follows from them."""
    sizes = {r["said"]: r["n"] for r in labelled.groupBy("said").agg(F.approx_count_distinct("url").alias("n")).collect()}
    lot = F.pmod(F.xxhash64("url"), F.lit(LOTS))
    each = most // 2
    out = labelled.limit(0)
    for verdict, n in sorted(sizes.items()):
        some = labelled.where((F.col("said") == verdict) & (lot < min(LOTS, LOTS * each * SPARE // max(1, n) + 1))).dropDuplicates(["url"])
        out = out.unionByName(some.orderBy(lot, "url").limit(each))
    return out


def blocked() -> Column:
    return (F.col("said") == "block").cast("double")


def suffix_statistics(counts: DataFrame) -> DataFrame:
    """counts (suffix, fold where they are by fold, n, blocked) with suffix_count and suffix_share in place of numbers."""
    return counts.select(*(c for c in counts.columns if c in ("suffix", "fold")), F.log1p("n").alias("suffix_count"), ((F.col("blocked") + PRIOR / 2) / (F.col("n") + PRIOR)).alias("suffix_share"))


def with_statistics(rows: DataFrame, suffixes: DataFrame) -> DataFrame:
    """rows, the statistics of their suffixes, and the vector of features."""
    told = rows.join(F.broadcast(suffixes), [c for c in ("suffix", "fold") if c in suffixes.columns], "left").na.fill({"suffix_count": 0.0, "suffix_share": 0.5})
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(told)


class Trees:
    """Fitted on a sample (url, said, and the columns of lexical). At most TRAIN_ROWS rows."""

    def __init__(self, learn: DataFrame):
        folds = learn.withColumn("fold", F.pmod(F.xxhash64(F.lit(1), "url"), F.lit(FOLDS)))
        per = folds.groupBy("suffix", "fold").agg(F.count("*").alias("n"), F.sum(blocked()).alias("blocked"))
        total = per.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("blocked").alias("blocked"))
        rest = per.select("suffix", "fold", F.col("n").alias("_n"), F.col("blocked").alias("_b")).join(total, "suffix").select("suffix", "fold", (F.col("n") - F.col("_n")).alias("n"), (F.col("blocked") - F.col("_b")).alias("blocked"))
        self.suffixes = suffix_statistics(total)
        self.model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=SEED, labelCol="blocked").fit(with_statistics(folds, suffix_statistics(rest)).withColumn("blocked", blocked()))

    def judged(self, rows: DataFrame) -> DataFrame:
        """Adds guess: allow or block. rows: the columns of lexical."""
        return self.model.transform(with_statistics(rows, self.suffixes)).withColumn("guess", F.when(F.col("prediction") > 0.5, "block").otherwise("allow"))


def labelled_rows(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, url, host, path, rule, said: what the rules say."""
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host.alias("host"), path.alias("path"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    return rows.select("*", rule.alias("rule"), said.alias("said"))


def training_sample(rows: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    return settled(lexical(sample(rows.where("said is not null").select("url", "host", "path", "said"), most)), "url-sample")


def held_out_accuracy(pages: DataFrame, rules=RULES, most: int = TRAIN_ROWS, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row: n, right, accuracy, largest (the share of the commoner verdict), for a fold of the sample that neither trees nor statistics have seen. No rows without two verdicts to learn from."""
    learn = training_sample(labelled_rows(pages, rules, id_col, url_col), most)
    first = F.pmod(F.xxhash64(F.lit(2), "url"), F.lit(FOLDS)) == 0
    known, held = learn.where(~first), learn.where(first)
    if known.select("said").distinct().count() < 2:
        return learn.limit(0).select(*(F.lit(0.0).alias(x) for x in ("n", "right", "accuracy", "largest")))
    counts = Trees(known).judged(held).agg(F.count("*").cast("double").alias("n"), F.sum((F.col("guess") == F.col("said")).cast("double")).alias("right"), F.avg(blocked()).alias("_b"))
    return counts.select("n", "right", (F.col("right") / F.col("n")).alias("accuracy"), F.greatest(F.col("_b"), 1 - F.col("_b")).alias("largest"))


def url_filter(pages: DataFrame, rules=RULES, most: int = TRAIN_ROWS, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict: a row for each row of pages."""
    rows = labelled_rows(pages, rules, id_col, url_col)
    learn = training_sample(rows, most)
    seen = [r["said"] for r in learn.select("said").distinct().collect()]
    if len(seen) < 2:
        return rows.select("page_id", "host", "path", "rule", F.coalesce("said", F.lit((seen or ["allow"])[0])).alias("verdict"))
    return Trees(learn).judged(lexical(rows)).select("page_id", "host", "path", "rule", F.coalesce("said", "guess").alias("verdict"))
