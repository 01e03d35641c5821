"""URL filters: written rules first, then association rules mined by FP-growth.

Addresses are cut to tokens (scheme, domain, subdomain words, path words with
digits masked, query keys, fragment flag).  Labelled addresses become baskets of
tokens with a label item; frequent itemsets give rules {tokens} -> label, of any length, kept
by support and confidence, and by being surer than every rule on fewer of
their tokens.

Baskets are made smaller before they are mined, which loses none of these rules:

- a token that is too rare with every label is in no rule;
- a token that has one label only is a sure rule, and no rule on more tokens is surer;
- tokens that occur in just the same addresses are one item, whose rules ask for any of them, since a rule that
  asks for two of them is no surer.

So a long address, or a template of words of its own, adds one item and not the sets of its words.  What is left to
FP-growth are tokens that are frequent, mixed in their labels, and differ in where they occur.

Rules are matched by an inverted index from each rule's rarest
part: an address looks up its own tokens and tests those rules only.  The
number of rules is bounded by the support, not by the table, so that the index is a
constant of the plan; addresses are never shuffled.

Only DataFrame operations and Spark's own FP-growth are used.

A null address or one without ``://`` has an empty host and path, no tokens, no
rule, and gets the default verdict.  Repeated rows get equal rows, and count as often in mining.  Other columns are
kept, but those with the names of results give way to them.  Without labels no rules are mined and the default holds.
Of equally sure rules the better supported one decides, then the one on more parts; a tie goes to block.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bramble.llm.common import Workspace, fresh, load

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LABEL = "label="
INDEX = "array<struct<tokens:array<array<string>>,verdict:string,confidence:double,support:double>>"
#: Labelled addresses that a rule holds for at least, however small the table.
FLOOR = 3
#: Parts of the index; a look-up reads one of them.
SLOTS = 256


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def written_rule(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """struct(rule, verdict) of the longest rule (host/path -> verdict) that fits, else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        at, _, start = rule.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + start)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(rules[rule]).alias("verdict"))).otherwise(found)
    return found


def tokens(url: Column) -> Column:
    """Distinct tokens of an address; none without ``://``."""
    host, path = host_of(url), path_of(url)
    labels = F.split(host, r"\.")
    words = lambda c: F.filter(F.split(F.regexp_replace(F.lower(c), "[0-9]+", "0"), "[^\\p{L}\\p{N}]+"), lambda x: x != "")
    tagged = lambda kind, c: F.transform(c, lambda x: F.concat(F.lit(kind + "="), x))
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    keys = F.filter(F.transform(F.split(query, "&"), lambda x: F.regexp_extract(x, "(?s)^([^=]*)", 1)), lambda x: x != "")
    every = F.concat(
        F.array(F.concat(F.lit("scheme="), F.lower(F.regexp_extract(url, r"(?s)^(.*?)://", 1)))),
        F.when(F.size(labels) > 1, F.array(F.concat(F.lit("tld="), F.element_at(labels, -1)))).otherwise(F.array().cast("array<string>")),
        F.when(F.size(labels) > 1, F.array(F.concat(F.lit("domain="), F.array_join(F.slice(labels, -2, 2), ".")))).otherwise(F.array().cast("array<string>")),
        tagged("host", words(host)),
        tagged("path", words(path)),
        tagged("query", keys),
        F.when(url.contains("#"), F.array(F.lit("fragment=1"))).otherwise(F.array().cast("array<string>")),
    )
    return F.when(url.contains("://"), F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def mine(labelled: DataFrame, *, support: float = 0.005, confidence: float = 0.8) -> DataFrame:
    """(tokens, verdict, confidence, support) of rules from (url, verdict): an address with a token of each of ``tokens`` (array of arrays) has the verdict."""
    spark = labelled.sparkSession
    work = Workspace(spark, "rules")
    known = labelled.filter("verdict is not null and url is not null").select(F.col("verdict").cast("string").alias("verdict"), tokens(F.col("url").cast("string")).alias("items")).filter("size(items) > 0")
    rows = work.table(known.withColumn("row", F.monotonically_increasing_id()), "baskets")
    total = rows.count()
    least = max(FLOOR, math.ceil(support * total - 1e-9))
    flat = rows.select("row", "verdict", F.explode("items").alias("token"))
    # which addresses hold a token, as two 64-bit sums of their hashes
    by = flat.groupBy("token", "verdict").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("row")).alias("x"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("y"))
    told = by.groupBy("token").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.max_by("verdict", "n").alias("verdict"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y")).filter(F.col("most") >= least)
    same = told.groupBy("n", "most", "verdict", "x", "y").agg(F.sort_array(F.collect_list("token")).alias("part"))
    parts = work.table(same.select(F.col("part")[0].alias("item"), "part", "n", "most", "verdict"), "parts")
    sure = parts.filter("n = most").select(F.array("part").alias("tokens"), "verdict", F.lit(1.0).alias("confidence"), (F.col("n") / F.lit(max(total, 1))).alias("support"))
    mixed = parts.filter("n > most").select("item", F.explode("part").alias("token"))
    items = flat.join(mixed, "token").groupBy("row").agg(F.collect_set("item").alias("items"))
    baskets = work.table(rows.select("row", "verdict").join(items, "row").select(F.array_append("items", F.concat(F.lit(LABEL), "verdict")).alias("items")), "items")
    n = baskets.count()
    if not n:
        return sure
    shares = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / n), minConfidence=confidence, numPartitions=int(spark.conf.get("spark.sql.shuffle.partitions"))).fit(baskets).associationRules
    rules = shares.filter(F.element_at("consequent", 1).startswith(LABEL) & (F.col("confidence") >= confidence) & ~F.exists("antecedent", lambda t: t.startswith(LABEL)))
    rules = rules.select(F.sort_array("antecedent").alias("tokens"), F.substring(F.element_at("consequent", 1), len(LABEL) + 1, 1 << 20).alias("verdict"), "confidence", (F.col("support") * n / total).alias("support"))
    found = pruned(work.table(rules, "mined")).withColumn("rule", F.monotonically_increasing_id())
    found = work.table(found, "pruned")
    whole = found.select("rule", F.posexplode("tokens").alias("i", "item")).join(parts.select("item", "part"), "item").groupBy("rule").agg(F.sort_array(F.collect_list("part")).alias("tokens"))
    return sure.union(found.drop("tokens").join(whole, "rule").select("tokens", "verdict", "confidence", "support"))


def pruned(rules: DataFrame) -> DataFrame:
    """Rules surer than each rule for the same verdict on all their tokens but one."""
    less = rules.select("tokens", "verdict", "confidence", "support", F.explode("tokens").alias("gone")).withColumn("part", F.array_remove("tokens", F.col("gone")))
    wider = rules.select(F.col("tokens").alias("part"), "verdict", F.col("confidence").alias("surest"))
    best = less.join(wider, ["part", "verdict"], "left").groupBy("tokens", "verdict", "confidence", "support").agg(F.max("surest").alias("surest"))
    return best.filter("surest is null or confidence > surest").drop("surest")


def index(rules: DataFrame) -> DataFrame:
    """One row: by slots of a hash, maps from the tokens of each rule's rarest part to the rules indexed there."""
    used = rules.select(F.explode("tokens").alias("part")).groupBy("part").count()
    rare = rules.withColumn("part", F.explode("tokens")).join(used, "part").groupBy("tokens", "verdict", "confidence", "support").agg(F.min(F.struct("count", "part")).alias("r"))
    lists = rare.select(F.explode("r.part").alias("t"), "tokens", "verdict", "confidence", "support").groupBy("t").agg(F.sort_array(F.collect_list(F.struct("tokens", "verdict", "confidence", "support"))).alias("rules"))
    slots = lists.groupBy(slot(F.col("t")).alias("slot")).agg(F.map_from_entries(F.collect_list(F.struct("t", "rules"))).alias("m"))
    one = slots.agg(F.map_from_entries(F.collect_list(F.struct("slot", "m"))).alias("m"))
    return one.select(F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda i: F.try_element_at("m", i)).alias("index"))


def slot(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(SLOTS)).cast("int")


RESULTS = ("host", "path", "rule", "verdict", "confidence")


def judge(urls: DataFrame, rules: DataFrame, written: dict[str, str], default: str = "allow") -> DataFrame:
    """``urls`` with host, path, rule, verdict and confidence; ``rules`` is what ``mine`` gives, written out."""
    table = index(rules)  # one row; bounded, as so many rules can have the support that was asked for
    url = F.col("url").cast("string")
    host, path, own, told, at, best = fresh(urls, "url_host", "url_path", "url_own", "url_tokens", "url_index", "url_best")
    looked = urls.withColumns({host: host_of(url), path: path_of(url), told: tokens(url)}).withColumns({own: written_rule(F.col(host), F.col(path), written), at: table.select("index").scalar()})
    listed = F.flatten(F.transform(told, lambda t: F.coalesce(F.try_element_at(F.get(at, slot(t)), t), F.array().cast(INDEX))))
    fitting = F.filter(listed, lambda r: F.forall(r["tokens"], lambda part: F.arrays_overlap(part, told)))
    # the surest rule decides, then the better supported one, then the one on more parts; a tie goes to block
    surest = F.array_max(F.transform(fitting, lambda r: F.struct(r["confidence"].alias("confidence"), r["support"].alias("support"), F.size(r["tokens"]).alias("n"), r["verdict"].alias("verdict"))))
    looked = looked.withColumn(best, surest)
    return looked.select(
        *(F.col(f"`{c}`") for c in urls.columns if c.lower() not in RESULTS), F.col(host).alias("host"), F.col(path).alias("path"), F.col(own)["rule"].alias("rule"),
        F.coalesce(F.col(own)["verdict"], F.col(best)["verdict"], F.lit(default)).alias("verdict"),
        F.when(F.col(own).isNull(), F.col(best)["confidence"]).alias("confidence"),
    )


RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages' addresses.  A written rule's verdict labels an address; elsewhere the labels of that id do: poor or toxic is block.

    ``labels`` judges rows of a crawl by number, and is the only table of judgements there is; a number
    that names no page labels none.
    """
    pages = load(spark, sf_dir, "pages").select("page_id", "url")
    url = F.col("url").cast("string")
    ruled = pages.select("page_id", url.alias("url"), written_rule(host_of(url), path_of(url), RULES)["verdict"].alias("ruled"))
    marks = load(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("page_id")).agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    marked = ruled.join(marks, "page_id", "left").withColumn("marked", F.when((F.col("quality") == 0) | (F.col("toxic") == 1), "block").when(F.col("quality") == 1, "allow"))
    rules = Workspace(spark, "urls").table(mine(marked.select("url", F.coalesce("ruled", "marked").alias("verdict"))), "rules")
    return judge(pages, rules, RULES).select("page_id", "host", "path", "rule", "verdict", "confidence")
