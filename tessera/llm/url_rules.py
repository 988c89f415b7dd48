"""URL filters: curated host and path rules, and association rules mined from labelled URLs.

A URL is a set of tokens (scheme, host labels, domain suffixes, path parts, query keys, shapes).
Spark's FP-growth mines token combinations of labelled URLs; rules that lead to a label are pruned by
support and confidence, kept only where no rule with fewer of their tokens is as sure, and matched
through an inverted index from the rarest token of each rule.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.lineage import checkpointed

#: The curated rules (host, path, verdict): fixed values of the query's contract.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
BLOCK, ALLOW = "label=block", "label=allow"


@dataclass(frozen=True)
class Params:
    """Pruning of mined rules: share of labelled URLs that are bad and have the tokens (and their least number), share of those with the tokens that are bad."""

    min_support: float = 0.005
    min_rows: int = 2
    min_confidence: float = 0.6


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): the host after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; then the path up to ``?``, ``#`` or the end.  Both empty for null or no ``://``."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def curated(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest curated rule whose host is the URL's or a parent of it and whose path starts the URL's; else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, rule_verdict in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        rule, verdict = F.when(fits, rule_host + rule_path).otherwise(rule), F.when(fits, rule_verdict).otherwise(verdict)
    return rule, verdict


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """The URL's set of tokens, in a fixed order; no order of labels or parts is kept but the last host labels' and the first path part's."""
    labels = F.split(host, r"\.")
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    shaped = F.transform(parts, lambda x: F.concat(F.lit("part="), F.when(x.rlike(r"^[0-9]+$"), F.concat(F.lit("digits:"), F.length(x).cast("string"))).otherwise(x)))
    query = F.split(F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1), "&")
    keys = F.transform(F.filter(query, lambda x: x != ""), lambda x: F.concat(F.lit("key="), F.substring_index(x, "=", 1)))
    return F.array_sort(
        F.array_distinct(
            F.concat(
                F.array(F.concat(F.lit("scheme="), F.substring_index(F.coalesce(url, F.lit("")), "://", 1)), F.concat(F.lit("depth="), F.size(parts).cast("string")), F.concat(F.lit("suffix="), F.substring_index(host, ".", -2))),
                F.transform(labels, lambda x: F.concat(F.lit("host="), x)), shaped, keys,
            )
        )
    )


def useful_items(labelled: DataFrame, least: int) -> DataFrame:
    """(item, tokens, hits, bads): sets of tokens that the same labelled rows have, as one item each, if a rule can need them.

    ``labelled`` has rows (row, tokens, bad).  An item has at least ``least`` bad rows, or no rule with
    it is supported, and not all rows, or leaving it out changes no confidence.  The number of items is
    at most the tokens of the bad rows over ``least``.
    """
    tokens = labelled.select("row", "bad", F.explode("tokens").alias("token"))
    # Two hashes summed over the rows, the number of rows and that of bad ones name the set of rows.
    mark = [F.sum(F.xxhash64("row", F.lit(k)).cast("decimal(38,0)")).alias(f"mark{k}") for k in (0, 1)]
    counts = tokens.groupBy("token").agg(F.count("*").alias("hits"), F.count_if("bad").alias("bads"), *mark).where(F.col("bads") >= least)
    items = counts.groupBy("hits", "bads", "mark0", "mark1").agg(F.array_sort(F.collect_list("token")).alias("tokens"))
    total = labelled.agg(F.count("*").alias("rows"))
    return items.join(F.broadcast(total), F.col("hits") < F.col("rows")).select(F.element_at("tokens", 1).alias("item"), "tokens", "hits", "bads")


def mine_rules(labelled: DataFrame, p: Params = Params()) -> DataFrame:
    """(tokens, key, confidence, support) of rules that lead to ``block``, from rows (row, tokens, bad); ``row`` is unique.

    A rule is dropped if one with a part of its tokens is at least as sure.  So tokens that always stand
    together count as one item (the rule's tokens are one of each item, the first by name), an item that
    is never good is a rule by itself and stays out of longer ones, and what is left goes to FP-growth,
    over the bad rows only; the good rows that a combination has are counted by matching it.  That
    is what a URL of many tokens needs: parts of one URL alone are no rules, and parts that go
    together are one item.  ``key`` is the rule's rarest token among labelled rows, for the index.
    """
    sizes = labelled.agg(F.count("*").alias("rows")).first()
    least = max(p.min_rows, math.ceil(p.min_support * sizes["rows"]), 1)
    items = checkpointed(useful_items(labelled, least))
    sure = items.where("hits = bads").select(F.array("item").alias("tokens"), F.col("item").alias("key"), F.lit(1.0).alias("confidence"), (F.col("bads") / F.lit(float(max(sizes["rows"], 1)))).alias("support"))
    mixed = items.where("hits > bads").select("item", "hits")
    rows = labelled.select("row", "bad", F.explode("tokens").alias("item")).join(mixed, "item")
    baskets = checkpointed(rows.groupBy("row", "bad").agg(F.collect_list("item").alias("items")))
    # Bad rows without a mixed item are no baskets, so the share is of the baskets.
    bad_baskets = baskets.where("bad").select("items")
    n = bad_baskets.count()
    if n < least:
        return sure
    model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / n).fit(bad_baskets)
    found = model.freqItemsets.where(F.col("freq") >= least).select(F.array_sort("items").alias("tokens"), F.col("freq").alias("bads"))
    # Good rows of each combination: its rarest token finds it, as in matching.
    rarest = found.select("tokens", "bads", F.explode("tokens").alias("item")).join(mixed, "item").groupBy("tokens").agg(F.first("bads").alias("bads"), F.min(F.struct("hits", "item")).alias("least"))
    found = checkpointed(rarest.select("tokens", "bads", F.col("least.item").alias("key")))
    good = baskets.where("not bad").select("items", F.explode("items").alias("key")).join(found, "key").where(F.size(F.array_except("tokens", "items")) == 0)
    counts = found.join(good.groupBy("tokens").agg(F.count("*").alias("goods")), "tokens", "left").select("tokens", "key", "bads", F.coalesce("goods", F.lit(0)).alias("goods"))
    share = F.col("bads") / (F.col("bads") + F.col("goods"))
    rules = counts.select("tokens", "key", share.alias("confidence"), (F.col("bads") / F.lit(float(sizes["rows"]))).alias("support")).where(F.col("confidence") >= p.min_confidence)
    shorter = rules.select(F.col("tokens").alias("less"), F.col("confidence").alias("sure"), "key")
    covered = rules.select("tokens", "confidence", F.explode("tokens").alias("key")).join(shorter, "key").where((F.size("less") < F.size("tokens")) & (F.col("sure") >= F.col("confidence")) & (F.size(F.array_except("less", "tokens")) == 0))
    return sure.unionByName(rules.join(covered.select("tokens").distinct(), "tokens", "left_anti").select(*sure.columns))


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(row, mined_rule) of URLs (row, tokens) that a rule fits: the surest, then the best supported, then the first by name.

    The index holds each rule under its rarest token; a URL looks up its own tokens and keeps rules
    whose tokens it has all.
    """
    index = rules.select(F.col("key").alias("token"), F.col("tokens").alias("rule_tokens"), "confidence", "support")
    looked = urls.select("row", "tokens", F.explode("tokens").alias("token")).join(index, "token")
    fits = looked.where(F.size(F.array_except("rule_tokens", "tokens")) == 0)
    order = F.struct(-F.col("confidence"), -F.col("support"), F.array_join("rule_tokens", " + "))
    return fits.groupBy("row").agg(F.min(order).alias("best")).select("row", F.col("best.col3").alias("mined_rule"))


def judge(pages: DataFrame, labels: DataFrame, p: Params = Params(), id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, mined_rule) of every URL.

    A curated rule decides where one fits; elsewhere a URL is blocked if a mined rule fits it, else
    allowed.  Labels are those of the same id, bad where the quality is 0 or the text is toxic; without
    labels no rule is mined.  URLs of any length and number of tokens are taken whole.  A null URL or one without ``://`` has an empty host and path and fits no
    curated rule.  Repeated rows and null ids are judged like any others, by their URL; other columns are
    ignored; an empty table gives no rows.
    """
    host, path = url_parts(F.col("url"))
    rows = pages.select(F.col(id_column).cast("bigint").alias("page_id"), F.col(url_column).alias("url")).withColumn("host", host).withColumn("path", path)
    rows = rows.withColumn("tokens", url_tokens(F.col("url"), F.col("host"), F.col("path")))
    known = labels.where("quality is not null or toxic is not null").groupBy(F.col("doc_id").alias("page_id")).agg(F.max(F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("bad"))
    labelled = checkpointed(rows.where("page_id is not null").join(known, "page_id").select(F.struct("page_id", F.monotonically_increasing_id()).alias("row"), "tokens", "bad"))
    rules = checkpointed(mine_rules(labelled, p))
    # Equal URLs are matched once: a URL is its own key.
    urls = rows.select(F.coalesce("url", F.lit("")).alias("row"), "tokens").dropDuplicates(["row"])
    mined = match_rules(urls, rules)
    rule, verdict = curated(F.col("host"), F.col("path"))
    joined = rows.withColumn("row", F.coalesce("url", F.lit(""))).join(mined, "row", "left")
    return joined.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("mined_rule").isNotNull(), "block").otherwise("allow")).alias("verdict"), "mined_rule")
