"""URL verdicts by association rules and by given host rules, in DataFrame and ML pipeline operations only.

FP-growth mines token combinations of labelled URLs together with their label; the rules that
imply the bad label with enough support and confidence are kept. They are matched by an inverted
index: URL tokens meet index entries by equality, and a rule fires when all of its tokens
were met. Given host rules override the mined ones; the longest that fits wins.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.settings import cut_lineage

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BAD, GOOD = "label=bad", "label=good"

#: Host rules of the registered query: (verdict, host and path prefix).
HOST_RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))


def with_parts(urls: DataFrame) -> DataFrame:
    """Adds ``host`` (A-Z lower-cased) and ``path`` to rows with ``url``; both empty for null and for no ``://``."""
    df = urls.withColumn("_rest", F.coalesce(_after_scheme(F.col("url")), F.lit("")))
    df = df.withColumn("_host", F.regexp_extract("_rest", "^[^/?#]*", 0))
    path = F.regexp_extract(F.expr("substring(_rest, length(_host) + 1)"), "^[^?#]*", 0)
    return df.select(*urls.columns, F.translate("_host", _UPPER, _LOWER).alias("host"), path.alias("path"))


def tokens(host: Column, path: Column, url: Column) -> Column:
    """Distinct tokens: host labels, path words with numbers as ``#``, names of query parameters, and whether a fragment follows."""
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    words = F.transform(F.split(F.regexp_replace(F.lower(path), "[0-9]+", "#"), "[^a-z#]+"), lambda x: F.concat(F.lit("p:"), x))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    names = F.transform(F.split(query, "&"), lambda x: F.concat(F.lit("q:"), F.regexp_extract(x, "^[^=]*", 0)))
    extra = F.when(F.coalesce(F.instr(url, "#") > 0, F.lit(False)), F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>"))
    return F.filter(F.array_distinct(F.concat(labels, words, names, extra)), lambda x: F.length(x) > 2)


def compounds(baskets: DataFrame) -> DataFrame:
    """``(token, item)``: tokens that occur in exactly the same baskets share an item, named by the smallest of them.

    ``baskets`` has ``(basket, token)``. Baskets are told apart by the XOR of their hashes and their number.
    """
    each = baskets.groupBy("token").agg(F.bit_xor(F.xxhash64("basket")).alias("a"), F.bit_xor(F.xxhash64(F.lit(7), "basket")).alias("b"), F.count("*").alias("n"))
    named = each.groupBy("a", "b", "n").agg(F.min("token").alias("item"))
    return each.join(named, ["a", "b", "n"]).select("token", "item", "n")


def mined_rules(
    labelled: DataFrame, support: float = 0.002, least: int = 20, lift: float = 1.5, score: float = 3.0, sample: int = 50_000, longest: int = 24
) -> DataFrame:
    """``(rule, antecedent, confidence, lift)`` that imply the bad label, from rows ``(url, bad)``.

    A basket is a distinct URL with its tokens; URLs whose labels contradict each other teach nothing. At most
    about ``sample`` of them, those of lowest hash, are mined. Support is a share of them, and ``least`` of them at the least.
    A rule's confidence has to be ``lift`` times the share of bad URLs and ``score`` standard errors above it. Rules are
    closed: tokens that always occur together count as one item and appear together in an antecedent, and a longer
    antecedent is kept only if more confident than every shorter one inside it. A basket's ``longest`` most
    frequent items are mined, which bounds the combinations of very long URLs.

    Rows without a URL or label teach nothing; with no rows there are no rules.
    """
    known = labelled.where("url is not null and bad is not null").groupBy("url").agg(F.min("bad").alias("bad"), (F.min("bad") == F.max("bad")).alias("clear"))
    known = with_parts(known.where("clear").select("url", "bad"))
    rows = cut_lineage(known.select("url", "bad", F.xxhash64("url").alias("h"), tokens(F.col("host"), F.col("path"), F.col("url")).alias("tokens")), "baskets")
    spark = labelled.sparkSession
    none = spark.range(0).select(F.col("id").alias("rule"), F.array().cast("array<string>").alias("antecedent"), F.lit(0.0).alias("confidence"), F.lit(0.0).alias("lift"))
    total = rows.count()
    if not total:
        return none
    if total > sample:
        rows = rows.where(F.shiftrightunsigned("h", 32) < int((1 << 32) * sample / total))
    size, bad = rows.agg(F.count("*"), F.count_if("bad")).first()
    if not 0 < bad < size:
        return none
    floor = min(1.0, max(support, least / size))
    pairs = rows.select(F.col("url").alias("basket"), "bad", F.explode("tokens").alias("token"))
    named = cut_lineage(compounds(pairs.select("basket", "token")), "items")
    frequent = named.where(F.col("n") >= floor * size)
    items = pairs.join(frequent, "token").groupBy("basket").agg(F.max("bad").alias("bad"), F.sort_array(F.collect_set(F.struct((-F.col("n")).alias("n"), "item"))).alias("all"))
    chosen = F.transform(F.slice("all", 1, longest), lambda x: x["item"])
    baskets = cut_lineage(items.select(F.array_append(chosen, F.when(F.col("bad"), BAD).otherwise(GOOD)).alias("items")), "mined")
    base = bad / size
    mined = FPGrowth(itemsCol="items", minSupport=floor, minConfidence=min(1.0, lift * base)).fit(baskets).associationRules
    mined = mined.where(F.col("consequent") == F.array(F.lit(BAD))).select(F.array_sort("antecedent").alias("antecedent"), "confidence", (F.col("support") / F.col("confidence") * baskets.count()).alias("n"))
    sure = (F.col("confidence") - base) / F.sqrt(F.lit(base * (1 - base)) / F.col("n"))
    mined = cut_lineage(mined.where((F.col("confidence") >= lift * base) & (sure >= score)), "confident")
    # A rule falls to a shorter one inside it that is as confident; they meet in one of the shorter one's items.
    short = mined.select(F.explode("antecedent").alias("i"), F.col("antecedent").alias("inner"), F.col("confidence").alias("c"))
    short = short.where(F.col("i") == F.element_at("inner", 1))
    long = mined.select(F.explode("antecedent").alias("i"), "antecedent", "confidence")
    inside = (F.size("inner") < F.size("antecedent")) & (F.size(F.array_except("inner", "antecedent")) == 0) & (F.col("c") >= F.col("confidence"))
    needless = long.join(short, "i").where(inside).select("antecedent").distinct()
    closed = mined.join(needless, "antecedent", "left_anti").select(F.xxhash64("antecedent").alias("rule"), "antecedent", "confidence")
    whole = closed.select("rule", "confidence", F.explode("antecedent").alias("item")).join(named.select("item", "token"), "item")
    rules = whole.groupBy("rule").agg(F.array_sort(F.collect_set("token")).alias("antecedent"), F.max("confidence").alias("confidence"))
    return cut_lineage(rules.withColumn("lift", F.col("confidence") / base), "rules")


def fired(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``(url, confidence)``: the highest confidence among the rules whose tokens all occur, for URLs with such a rule."""
    index = rules.select("rule", "confidence", F.size("antecedent").alias("needed"), F.explode("antecedent").alias("token"))
    distinct = with_parts(urls.where("url is not null").select("url").distinct())
    met = distinct.select("url", F.explode(tokens(F.col("host"), F.col("path"), F.col("url"))).alias("token")).join(index, "token")
    full = met.groupBy("url", "rule").agg(F.count("*").alias("met"), F.first("needed").alias("needed"), F.first("confidence").alias("confidence"))
    return full.where("met = needed").groupBy("url").agg(F.max("confidence").alias("confidence"))


def host_rule(host: Column, path: Column, rules=HOST_RULES) -> tuple[Column, Column]:
    """The longest fitting host rule and its verdict; nulls where none fits. The list is a parameter, not data."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        rule_host, _, rule_path = rule.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith("/" + rule_path)
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, action).otherwise(verdict)
    return name, verdict


def judged(pages: DataFrame, rules: DataFrame, host_rules=HOST_RULES, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """``(page_id, host, path, rule, verdict, confidence)`` for every row.

    ``confidence`` is that of the best mined rule, null where none fires. A null or malformed URL has
    empty host and path and is allowed. Repeated rows get equal results; other columns are ignored.
    """
    rows = with_parts(pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url")))
    hits = fired(rows, rules).withColumnRenamed("url", "_url")
    rule, verdict = host_rule(F.col("host"), F.col("path"), host_rules)
    method = F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")
    joined = rows.join(hits, F.col("url") == F.col("_url"), "left")
    return joined.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "confidence")


def page_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """``(url, bad)``: a page is labelled by the document whose number stands in its path; bad is toxic or of low quality."""
    numbered = with_parts(pages.select("url").where("url is not null"))
    numbered = numbered.select("url", F.try_to_number(F.regexp_extract("path", "/([0-9]{1,18})(?:[./]|$)", 1), F.lit("9" * 18)).cast("long").alias("_doc"))
    known = labels.select(F.col("doc_id").cast("long").alias("_doc"), (F.coalesce(F.col("toxic") == 1, F.lit(False)) | F.coalesce(F.col("quality") == 0, F.lit(False))).alias("bad"))
    return numbered.join(known, "_doc").select("url", "bad")
