"""URL filter: fixed host and path rules first, association rules over URL tokens for the rest.

Spark's FP-growth mines the token combinations of labelled urls. Before that,
what cannot change a verdict is taken out, so that long or repeated urls don't
multiply combinations: tokens in too few blocked rows (no rule has them), tokens
that lead to the block label alone and always (rules by themselves; a longer rule
with them says no more), and all but one of the tokens that stand in the same
rows. Rules that lead to the block label and pass support and confidence are
kept unless leaving out one item keeps the confidence, and urls are matched
through an inverted index that holds each rule under its rarest item.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.llm.common import materialise, table

RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
MIN_SUPPORT, MIN_CONFIDENCE = 0.002, 0.8
#: Labelled rows that a rule must cover at least, however few there are.
MIN_ROWS = 20
#: Rules up to which the index is broadcast; with more it is joined by token.
BROADCAST_RULES = 5_000
BLOCKED = "label=block"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(host, upper, upper.lower()), F.lit("")), F.coalesce(path, F.lit(""))


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null."""
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):  # the longest is asked first
        name, _, tail = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + tail)
        chosen = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct sorted tokens: scheme, host and each parent domain, path segments, extension, query keys."""
    labels = F.split(host, r"\.")
    count = F.size(labels)
    suffixes = F.when(host == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), count), lambda i: F.concat(F.lit("host="), F.array_join(F.slice(labels, i, count), ".")))
    )
    segments = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.concat(F.lit("path="), F.regexp_replace(x, r"[0-9]+", "0")))
    extension = F.regexp_extract(path, r"\.([A-Za-z0-9]{1,5})$", 1)
    query = F.split(F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1), "&")
    keys = F.transform(F.filter(query, lambda x: x != ""), lambda x: F.concat(F.lit("key="), F.substring_index(x, "=", 1)))
    scheme = F.concat(F.lit("scheme="), F.coalesce(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1), F.lit("")))
    ext = F.when(extension != "", F.array(F.concat(F.lit("ext="), extension))).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.concat(F.array(scheme), suffixes, segments, ext, keys)))


def _no_rules(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame([], "rule_id string, items array<string>, confidence double, support double, rarest string"), spark.createDataFrame([], "token string, item string")


def mine_rules(labelled: DataFrame, *, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_rows: int = MIN_ROWS) -> tuple[DataFrame, DataFrame]:
    """Rules (rule_id, items, confidence, support, rarest) that lead to the block label, and the item (token, item) of each token that occurs in them.

    ``labelled`` has tokens and blocked (boolean). Tokens of the same rows are one
    item, named by the least of them; a rule fits a url that has a token of each
    of its items. A rule is dropped if one item can be left out without loss of
    confidence. Support counts blocked rows that the rule covers, of all rows.
    With fewer labelled rows than ``min_rows`` there are no rules. Repeated rows
    count each.
    """
    spark = labelled.sparkSession
    held = labelled.where("tokens is not null and blocked is not null").select("tokens", "blocked")
    held = materialise(held.withColumn("id", F.monotonically_increasing_id()), "baskets")
    rows = held.count()
    if rows < min_rows or not rows:
        return _no_rules(spark)
    least = max(min_support * rows, min_rows)
    marks = [F.sum(F.xxhash64("id", F.lit(salt)).cast("decimal(20,0)")).alias(f"mark{salt}") for salt in (1, 2)]
    each = held.select("id", "blocked", F.explode("tokens").alias("token"))  # a token list is distinct: a row counts a token once
    counted = each.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.count_if("blocked").alias("bad"), *marks)
    classes = counted.where(F.col("bad") >= least).groupBy("mark1", "mark2", "n", "bad").agg(F.min("token").alias("item"), F.collect_set("token").alias("tokens"))
    classes = materialise(classes.select("item", "tokens", "n", "bad"), "items")
    named = classes.select(F.explode("tokens").alias("token"), "item")
    alone = classes.where("n = bad").select(F.array("item").alias("items"), F.lit(1.0).alias("confidence"), (F.col("bad") / rows).alias("support"))
    mixed = classes.where("n > bad").select(F.explode(F.array("item")).alias("token"))  # one token stands for its class
    label = F.when(F.col("blocked"), F.array(F.lit(BLOCKED))).otherwise(F.array().cast("array<string>"))
    baskets = each.join(mixed, "token", "left_semi").groupBy("id", "blocked").agg(F.collect_set("token").alias("items"))
    baskets = materialise(baskets.select(F.concat("items", label).alias("items")), "mined")
    size = baskets.count()
    found = alone
    if size:
        model = FPGrowth(itemsCol="items", minSupport=min(1.0, least / size), minConfidence=min_confidence).fit(baskets)
        mined = model.associationRules.where(F.col("consequent") == F.array(F.lit(BLOCKED)))
        scaled = F.col("support") * (size / rows)
        found = found.unionByName(mined.select(F.array_sort("antecedent").alias("items"), "confidence", scaled.alias("support")))
    found = materialise(found.where(F.col("confidence") >= min_confidence).withColumn("rule_id", F.array_join("items", " ")), "rules")
    # each rule beside those with one item less, found by their own name
    shorter = found.select("rule_id", "confidence", F.explode(F.transform("items", lambda x: F.array_join(F.array_remove("items", x), " "))).alias("part"))
    part = found.select(F.col("rule_id").alias("part"), F.col("confidence").alias("had"))
    idle = shorter.join(part, "part").where("had >= confidence").select("rule_id").distinct()
    kept = found.join(idle, "rule_id", "left_anti")
    often = classes.select("item", F.col("n").alias("seen"))
    rarest = kept.select("rule_id", F.explode("items").alias("item")).join(often, "item").groupBy("rule_id").agg(F.min(F.struct("seen", "item"))["item"].alias("rarest"))
    rules = materialise(kept.join(rarest, "rule_id").select("rule_id", "items", "confidence", "support", "rarest"), "index")
    used = rules.select(F.explode("items").alias("item")).distinct()
    return rules, materialise(named.join(used, "item", "left_semi").select("token", "item"), "named")


def match_rules(urls: DataFrame, rules: DataFrame, named: DataFrame, *, broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """Add rule_id and confidence of the most confident rule that fits ``tokens`` (null if none).

    Of equally confident rules the one with the fewest items wins, then the
    least rule_id. Equal token sets are matched once, however many rows share them.
    """
    index = rules.select(F.col("rarest").alias("item"), "rule_id", F.col("items").alias("needed"), "confidence")
    if rules.count() <= broadcast_rules:  # counted: at most that many short rows
        index = F.broadcast(index)
    if named.count() <= broadcast_rules:
        named = F.broadcast(named)
    sets = urls.select("tokens").distinct()
    held = sets.withColumn("token", F.explode("tokens")).join(named, "token").groupBy("tokens").agg(F.collect_set("item").alias("items"))
    hits = held.withColumn("item", F.explode("items")).join(index, "item").where(F.size(F.array_except("needed", "items")) == 0)
    rank = F.struct((-F.col("confidence")).alias("low"), F.size("needed").alias("size"), "rule_id", "confidence")
    best = hits.groupBy("tokens").agg(F.min(rank).alias("best"))
    return urls.join(best, "tokens", "left").select(*urls.columns, F.col("best.rule_id"), F.col("best.confidence"))


def judge_urls(pages: DataFrame, labelled: DataFrame, rules: Sequence[tuple[str, str]] = RULES, *, url: str = "url", **limits: float) -> DataFrame:
    """``pages`` with host, path, rule, verdict, mined_rule and confidence.

    The longest fixed rule that fits decides; otherwise a matching mined rule
    blocks and no match allows. ``labelled`` has ``url`` and blocked. Null,
    empty and malformed urls have an empty host and path and are judged by
    their few tokens; very long ones by all of theirs. Repeated rows are each
    judged; input columns of the added names are replaced, others are kept.
    """

    def parsed(df: DataFrame) -> DataFrame:
        host, path = host_and_path(F.col(url))
        df = df.withColumn("host", host).withColumn("path", path)
        return df.withColumn("tokens", tokens(F.col(url), F.col("host"), F.col("path")))

    rules_found, named = mine_rules(parsed(labelled.select(url, "blocked")), **limits)
    added = ["host", "path", "rule", "verdict", "mined_rule", "confidence", "tokens", "rule_id"]
    held = parsed(pages.drop(*[c for c in added if c != url]))
    judged = match_rules(held, rules_found, named).withColumnRenamed("rule_id", "mined_rule")
    fixed = matching_rule(F.col("host"), F.col("path"), rules)
    guess = F.when(F.col("mined_rule").isNotNull(), "block").otherwise("allow")
    return judged.withColumns({"rule": fixed["rule"], "verdict": F.coalesce(fixed["verdict"], guess)}).drop("tokens")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of the same number mark a page: quality 0 or toxic 1 is a block label."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("blocked"))
    known = pages.join(labels.where("blocked is not null"), "page_id")
    return judge_urls(pages, known).select("page_id", "host", "path", "rule", "verdict", "mined_rule", "confidence")
