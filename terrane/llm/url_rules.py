"""URL filtering by a domain list and by association rules.

A fixed list of host-and-path rules decides first. For other pages, Spark's FP-growth mines
the token combinations that labelled URLs share; a combination that implies a bad label with
enough support and confidence is a rule, unless a part of it is as sure. Rules are matched by
an inverted index: each is filed under its rarest token, a page looks up its tokens, and the
rest of the rule is compared with the page's tokens. DataFrame functions and Spark ML only.

Only tokens of at least `min_pages` bad pages can be in a rule, and tokens that stand on the very
same labelled pages say the same, so before mining the others go and each such set becomes one item,
named by its least token (a page has the item if it has any of them). No rule is lost by that, and
lists of query names that always come together don't multiply combinations.

A label of a page is that of the document with its number. Defined cases: null urls, and those
without "://", have no host, path or tokens, fit no rule and are allowed; labels without a page
are ignored, of repeated labels the worst counts; without labels there are no mined rules;
repeated rows get one result each and are one page in mining; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower

#: Fixed values: (host, path, verdict).
LIST = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
BAD = "label=bad"


@dataclass(frozen=True)
class Mining:
    #: So many labelled pages have all of a rule's tokens and the label, at any size of the table: a few pages prove nothing.
    min_pages: int = 8
    min_confidence: float = 0.6
    bad: str = "toxic = 1"


def host(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def listed(host_: Column, path_: Column, rules: tuple[tuple[str, str, str], ...] = LIST) -> Column:
    """Struct (rule, verdict) of the longest rule that fits; null if none does."""
    ordered = sorted(rules, key=lambda r: -len(r[0] + r[1]))

    def fits(h: str, p: str) -> Column:
        return ((host_ == h) | F.endswith(host_, F.lit(f".{h}"))) & F.startswith(path_, F.lit(p))

    def entry(h: str, p: str, v: str) -> Column:
        return F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))

    first, *rest = ordered
    return reduce(lambda a, r: a.when(fits(r[0], r[1]), entry(*r)), rest, F.when(fits(first[0], first[1]), entry(*first)))


def tokens(url: Column, host_: Column, path_: Column) -> Column:
    """Distinct tokens: labels of the host except the last two, its registered name, path parts and query values other than plain numbers, extension, query names, fragment mark and fragment."""
    labels = F.split(host_, r"\.")
    n = F.size(labels)
    sub = F.transform(F.slice(labels, F.lit(1), F.greatest(n - 2, F.lit(0))), lambda x: F.concat(F.lit("h:"), x))
    tail = F.array(F.concat(F.lit("d:"), F.array_join(F.slice(labels, F.greatest(n - 1, F.lit(1)), F.lit(2)), ".")))
    parts = F.filter(F.split(path_, "/"), lambda x: (x != "") & ~x.rlike("^[0-9]+$"))
    query = F.filter(F.split(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\?([^#]*)", 1), "&"), lambda x: x != "")
    names = F.transform(query, lambda x: F.concat(F.lit("q:"), F.split_part(x, F.lit("="), F.lit(1))))
    values = F.transform(F.filter(query, lambda x: x.rlike("(?s)=(?![0-9]*$).")), lambda x: F.concat(F.lit("v:"), x))
    ext = F.filter(F.array(F.regexp_extract(path_, r"\.([0-9]*[A-Za-z][A-Za-z0-9]*)$", 1)), lambda x: x != "")
    mark = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)(#.*)", 1)
    fragment = F.filter(F.array(F.substring(mark, 1, 1), F.concat(F.lit("f:"), mark)), lambda x: (x != "") & ~x.rlike("^f:#?[0-9]*$"))
    every = F.concat(sub, tail, F.transform(parts, lambda x: F.concat(F.lit("p:"), x)), names, values, F.transform(ext, lambda x: F.concat(F.lit("e:"), x)), fragment)
    return F.when(host_ == "", F.array().cast("array<string>")).otherwise(F.array_distinct(every))


def _parsed(pages: DataFrame) -> DataFrame:
    both = pages.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    return both.withColumn("tokens", tokens(F.col("url"), F.col("host"), F.col("path")))


def items_of(known: DataFrame, mining: Mining) -> DataFrame:
    """token, item: of the tokens that can be in a rule. known: page_id, url, tokens, bad; each page once."""
    each = known.select(F.explode("tokens").alias("token"), "bad", F.xxhash64("page_id", "url").cast("decimal(38,0)").alias("page"))
    by_token = each.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("bad").cast("long")).alias("n_bad"), F.sum("page").alias("pages")).where(F.col("n_bad") >= mining.min_pages)
    same = by_token.groupBy("n", "pages").agg(F.min("token").alias("item"))
    return by_token.join(same, ["n", "pages"]).select("token", "item")


def mine(pages: DataFrame, labels: DataFrame, mining: Mining) -> tuple[DataFrame, DataFrame]:
    """rule (its items, sorted), confidence, support: the rules that no part of theirs makes needless; and token, item."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "url-rules")
    named = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.coalesce(F.expr(mining.bad), F.lit(False))).alias("bad"))
    known = _parsed(pages).join(named, F.col("page_id") == F.col("doc_id")).where(F.size("tokens") > 0)
    known = scratch.keep(known.select("page_id", "url", "tokens", "bad").dropDuplicates(["page_id", "url"]), "labelled")
    named_items = scratch.keep(items_of(known, mining), "items")
    each = known.select("page_id", "url", "bad", F.explode("tokens").alias("token")).join(named_items, "token")
    baskets = each.groupBy("page_id", "url", "bad").agg(F.collect_set("item").alias("items"))
    baskets = scratch.keep(baskets.select(F.when(F.col("bad"), F.concat("items", F.array(F.lit(BAD)))).otherwise(F.col("items")).alias("items")), "baskets")
    n = baskets.count()
    if not n:
        return spark.createDataFrame([], "rule array<string>, confidence double, support double"), named_items
    model = FPGrowth(minSupport=min(1.0, (mining.min_pages - 0.5) / n), minConfidence=0.0, itemsCol="items").fit(baskets)
    rules = model.associationRules.where(F.array_contains("consequent", BAD)).select(F.array_sort("antecedent").alias("rule"), "confidence", "support")
    rules = scratch.keep(rules, "combinations")
    return minimal(rules, mining.min_confidence, scratch), named_items


def minimal(combinations: DataFrame, least: float, scratch: Scratch) -> DataFrame:
    """The combinations that are rules, of confidence `least` or more, without those of which a proper part is a rule at least as sure.

    combinations: rule, confidence, support of all frequent ones, so every part of one is there. Sizes are settled from
    the smallest up: what is best among a combination's parts is its parts without one item, and what was best
    among theirs; so each combination meets as many rows as it has items, never other combinations.
    """
    most = combinations.agg(F.max(F.size("rule")).alias("n")).first()["n"] or 0
    own = F.when(F.col("confidence") >= least, F.col("confidence"))
    kept = before = None
    for size in range(1, most + 1):
        mine = combinations.where(F.size("rule") == size)
        if before is None:
            met = mine.withColumn("best", F.lit(None).cast("double"))
        else:
            parts = mine.select("rule", F.explode(F.transform("rule", lambda x: F.array_except("rule", F.array(x)))).alias("part"))
            best = parts.join(before, "part").groupBy("rule").agg(F.max("reach").alias("best"))
            met = mine.join(best, "rule", "left")
        met = scratch.keep(met, "size")
        before = met.select(F.col("rule").alias("part"), F.greatest(own, F.col("best")).alias("reach"))
        rules = met.where((F.col("confidence") >= least) & ~F.coalesce(F.col("best") >= F.col("confidence"), F.lit(False))).drop("best")
        kept = rules if kept is None else kept.unionByName(rules)
    return combinations.limit(0) if kept is None else kept


def judge(pages: DataFrame, labels: DataFrame, mining: Mining = Mining()) -> DataFrame:
    """Per row of pages: page_id, host, path, rule, verdict, and mined: the items of the surest mined rule that fits."""
    scratch = Scratch(pages.sparkSession, "url-judge")
    parsed = _parsed(pages)
    rules, named_items = mine(pages, labels, mining)
    rules = scratch.keep(rules, "rules")
    rows = parsed.select("page_id", "host", "path", "tokens", listed(F.col("host"), F.col("path")).alias("fit"))
    # pages with the same tokens share their rules; each combination is matched once
    kinds = scratch.keep(rows.where("fit is null").groupBy("tokens").agg(F.count(F.lit(1)).alias("n")), "kinds")
    held = kinds.select("tokens", "n", F.explode("tokens").alias("token")).join(named_items, "token").groupBy("tokens").agg(F.first("n").alias("n"), F.collect_set("item").alias("items"))
    held = scratch.keep(held, "held")
    often = held.select(F.explode("items").alias("item"), "n").groupBy("item").agg(F.sum("n").alias("n"))
    filed = rules.select("rule", "confidence", F.explode("rule").alias("item")).join(often, "item").groupBy("rule").agg(F.max("confidence").alias("confidence"), F.min(F.struct("n", "item")).alias("x"))
    index = filed.select("rule", "confidence", F.col("x.item").alias("item"))
    near = held.select("tokens", "items", F.explode("items").alias("item")).join(index, "item").where(F.size(F.array_except("rule", "items")) == 0)
    best = scratch.keep(near.groupBy("tokens").agg(F.max(F.struct("confidence", "rule")).alias("best")).select("tokens", F.col("best.rule").alias("mined")), "matched")
    both = rows.join(best, "tokens", "left")
    mined = F.when(F.col("fit").isNull(), F.array_join("mined", " "))
    verdict = F.coalesce(F.col("fit.verdict"), F.when(mined.isNotNull(), "block").otherwise("allow"))
    return both.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), mined.alias("mined"))
