"""Matching anchors between samples: ordered pairs, exact contexts, shared substrings, and the merge of both directions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sample_pairs(samples: DataFrame) -> DataFrame:
    """(pair_id, target_sample, query_sample) of all ordered pairs of different samples, target-major.

    The samples of a comparison are a handful, whatever the input's size; pairing each with the sorted
    list of all is one row a sample.
    """
    names = samples.select("sample").distinct()
    listed = names.agg(F.array_sort(F.collect_set("sample")).alias("all"))
    pairs = listed.select(F.explode("all").alias("target_sample"), "all").select("target_sample", F.explode("all").alias("query_sample")).where("target_sample <> query_sample")
    return pairs.select((F.row_number().over(Window.orderBy("target_sample", "query_sample")) - 1).alias("pair_id"), "target_sample", "query_sample")


def match_exact_context(contexts: DataFrame) -> DataFrame:
    """(query_anchor_id, query_sample, target_anchor_id, target_sample): query contexts that exactly one anchor of another sample has."""
    # Contexts that one anchor of a sample has: at most as many rows a key as there are samples.
    single = contexts.groupBy("sample", "context_key").agg(F.count("*").alias("n"), F.min("anchor_id").alias("target_anchor_id")).where("n = 1")
    targets = single.select("context_key", F.col("sample").alias("target_sample"), "target_anchor_id")
    return contexts.select("context_key", F.col("anchor_id").alias("query_anchor_id"), F.col("sample").alias("query_sample")).join(targets, "context_key").where("query_sample <> target_sample").select("query_anchor_id", "query_sample", "target_anchor_id", "target_sample")


def anchor_substrings(tokens: DataFrame, hits: DataFrame, radius: int = 2) -> DataFrame:
    """(anchor_id, gram_key), distinct: minimal unique substrings, of any sample, within ``radius`` tokens of each anchor."""
    anchors = tokens.where("token_type = 'A'").select("sequence_id", "token_index", "anchor_id")
    places = hits.select("sequence_id", "gram_key", F.explode(F.sequence(F.greatest(F.lit(0).cast("bigint"), F.col("last") - radius), F.col("start") + radius)).alias("token_index"))
    return places.join(anchors, ["sequence_id", "token_index"]).select("anchor_id", "gram_key").distinct()


def shared_counts(anchors: DataFrame, owned: DataFrame) -> DataFrame:
    """(query_anchor_id, target_sample, target_anchor_id, shared): how many substrings two anchors of one group and different samples share.

    A substring is unique in its own sample and can stand near several anchors of others.
    """
    rows = owned.join(anchors.select("anchor_id", "sample", "group_id"), "anchor_id")
    q = rows.select("gram_key", "group_id", F.col("anchor_id").alias("query_anchor_id"), F.col("sample").alias("query_sample"))
    t = rows.select("gram_key", "group_id", F.col("anchor_id").alias("target_anchor_id"), F.col("sample").alias("target_sample"))
    return q.join(t, ["gram_key", "group_id"]).where("query_sample <> target_sample").groupBy("query_anchor_id", "target_sample", "target_anchor_id").agg(F.count("*").alias("shared"))


def match_shared_substrings(anchors: DataFrame, owned: DataFrame, least: int = 1) -> DataFrame:
    """(query_anchor_id, target_sample, target_anchor_id, shared): the one target of the same group with the most shared substrings; ties have no target."""
    shared = shared_counts(anchors, owned).where(F.col("shared") >= least)
    best = shared.groupBy("query_anchor_id", "target_sample").agg(F.max("shared").alias("most"))
    tied = shared.join(best, ["query_anchor_id", "target_sample"]).where("shared = most").groupBy("query_anchor_id", "target_sample").agg(F.count("*").alias("n"), F.min("target_anchor_id").alias("target_anchor_id"), F.max("shared").alias("shared"))
    return tied.where("n = 1").select("query_anchor_id", "target_sample", "target_anchor_id", "shared")


def correspondences(primaries: DataFrame, mode: str = "union") -> DataFrame:
    """(sample_a, anchor_a, sample_b, anchor_b, support_direction) from directed primaries, by a full outer join of both directions.

    Sample a is the smaller name.  ``forward``: a is the target.  A one-way row is discordant if the
    other direction maps its query's far anchor elsewhere.  Mode ``reciprocal`` keeps ``both`` only.
    """
    forward = primaries.where("target_sample < query_sample").select(F.col("target_sample").alias("sample_a"), F.col("target_anchor_id").alias("anchor_a"), F.col("query_sample").alias("sample_b"), F.col("query_anchor_id").alias("anchor_b"), F.lit(True).alias("f"))
    backward = primaries.where("target_sample > query_sample").select(F.col("query_sample").alias("sample_a"), F.col("query_anchor_id").alias("anchor_a"), F.col("target_sample").alias("sample_b"), F.col("target_anchor_id").alias("anchor_b"), F.lit(True).alias("r"))
    keys = ["sample_a", "anchor_a", "sample_b", "anchor_b"]
    merged = forward.join(backward, keys, "full_outer")
    # The other direction's answer for the near anchor of a one-way row.
    answered_a = backward.select("sample_a", "anchor_a", "sample_b", F.col("anchor_b").alias("says_b"))
    answered_b = forward.select("sample_b", "anchor_b", "sample_a", F.col("anchor_a").alias("says_a"))
    seen = merged.join(answered_a, ["sample_a", "anchor_a", "sample_b"], "left").join(answered_b, ["sample_b", "anchor_b", "sample_a"], "left")
    support = F.when(F.col("f") & F.col("r"), "both").when(F.col("f"), F.when(F.col("says_b") != F.col("anchor_b"), "discordant").otherwise("forward_only")).otherwise(F.when(F.col("says_a") != F.col("anchor_a"), "discordant").otherwise("reverse_only"))
    out = seen.select(*keys, support.alias("support_direction"))
    return out.where("support_direction = 'both'") if mode == "reciprocal" else out
