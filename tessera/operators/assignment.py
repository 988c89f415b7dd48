"""Assigning each anchor to anchors of another sample: exact context, then shared unique substrings, then edit distance."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.lineage import checkpointed


@dataclass(frozen=True)
class Params:
    """Least shared substrings, the score that a candidate by edit distance must exceed, and the lead that makes the best one primary."""

    min_shared: int = 3
    min_score: int = 10
    margin: int = 5


PAIR = ["query_anchor_id", "query_sample", "target_sample"]
#: Columns of an assignment, in order.
COLUMNS = [*PAIR, "target_anchor_id", "status", "method", "score", "edit_distance", "strand", "q_alpha", "r_alpha", "margin", "candidates"]


#: Different tokens of a pair that have a letter.
LETTERS = 4096


def token_distance(left: Column, right: Column, most: int = LETTERS) -> Column:
    """Edit distance of two token arrays; over ``most`` different tokens together are an error.

    Each different token of the pair becomes one character, so the built-in string distance does the rest.
    """
    words = F.array_distinct(F.concat(left, right))

    def over(letters: str) -> Column:
        spell = lambda side: F.array_join(F.transform(side, lambda x: F.substring(F.lit(letters), F.array_position(words, x).cast("int"), F.lit(1))), "")
        return F.levenshtein(spell(left), spell(right)).cast("bigint")

    # Looking up a letter takes as long as there are letters, so few tokens take them from few.
    few, all_ = ("".join(chr(0x4E00 + k) for k in range(n)) for n in (min(24, most), most))
    too_many = F.raise_error(F.lit(f"over {most} different tokens in a pair")).cast("bigint")
    return F.when(F.size(words) <= len(few), over(few)).when(F.size(words) <= most, over(all_)).otherwise(too_many)


def queries(anchors: DataFrame, alpha: DataFrame, samples: DataFrame) -> DataFrame:
    """(query_anchor_id, query_sample, target_sample, q_alpha): every anchor once for each other sample.

    ``anchors`` has (anchor_id, sample); the samples of a comparison are a handful.  Rows are narrow, as there are as many as
    anchors times samples; tokens are looked up for those that need them.
    """
    others = samples.select("sample").distinct().agg(F.array_sort(F.collect_set("sample")).alias("all"))
    rows = anchors.join(F.broadcast(others)).select(F.col("anchor_id").alias("query_anchor_id"), F.col("sample").alias("query_sample"), F.explode("all").alias("target_sample")).where("query_sample <> target_sample")
    own = alpha.select(F.col("anchor_id").alias("query_anchor_id"), F.col("of_sample").alias("target_sample"), F.col("alpha").alias("q_alpha"))
    return rows.join(own, ["query_anchor_id", "target_sample"], "left").withColumn("q_alpha", F.coalesce("q_alpha", F.lit(0).cast("bigint")))


def _with_target(rows: DataFrame, alpha: DataFrame) -> DataFrame:
    """Rows with the target's ``r_alpha`` towards the query's sample."""
    far = alpha.select(F.col("anchor_id").alias("target_anchor_id"), F.col("of_sample").alias("query_sample"), F.col("alpha").alias("r_alpha"))
    return rows.join(far, ["target_anchor_id", "query_sample"], "left").withColumn("r_alpha", F.coalesce("r_alpha", F.lit(0).cast("bigint")))


def _primary(rows: DataFrame, method: str) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    return rows.withColumns({"status": F.lit("primary"), "method": F.lit(method), "score": F.col("q_alpha") + F.col("r_alpha"), "edit_distance": zero, "strand": F.lit("."), "margin": zero, "candidates": F.lit(1).cast("bigint")}).select(COLUMNS)


def by_exact_context(asked: DataFrame, anchors: DataFrame, alpha: DataFrame) -> DataFrame:
    """Primaries whose context one anchor of the target sample alone has, if either of them has unique substrings near it."""
    single = anchors.groupBy(F.col("sample").alias("target_sample"), "context_key").agg(F.count("*").alias("n"), F.min("anchor_id").alias("target_anchor_id")).where("n = 1").drop("n")
    same = anchors.select("context_key", F.col("anchor_id").alias("query_anchor_id"), F.col("sample").alias("query_sample")).join(single, "context_key").where("query_sample <> target_sample").drop("context_key", "query_sample")
    return _primary(_with_target(asked.join(same, ["query_anchor_id", "target_sample"]), alpha).where("q_alpha + r_alpha > 0"), "exact_context")


def by_shared_substrings(asked: DataFrame, shared: DataFrame, alpha: DataFrame, p: Params = Params()) -> DataFrame:
    """Primaries with the one target of the group that shares most substrings, ``min_shared`` at least; ``shared`` has (query_anchor_id, target_sample, target_anchor_id, shared)."""
    rows = _with_target(asked.where("q_alpha > 0").join(shared.where(F.col("shared") >= p.min_shared), ["query_anchor_id", "target_sample"]), alpha).where("r_alpha > 0")
    most = rows.groupBy("query_anchor_id", "target_sample").agg(F.max("shared").alias("most"))
    best = rows.join(most, ["query_anchor_id", "target_sample"]).where("shared = most").groupBy(*PAIR).agg(F.count("*").alias("n"), F.min("target_anchor_id").alias("target_anchor_id"), F.min("q_alpha").alias("q_alpha"), F.min("r_alpha").alias("r_alpha"))
    return _primary(best.where("n = 1"), "shared_tmus")


def rarest_first(anchors: DataFrame) -> DataFrame:
    """(anchor_id, terms): each anchor's tokens, the rarest of all anchors' first; a token's second occurrence is a term of its own."""
    counted = F.transform("tokens", lambda x, k: F.struct(x.alias("token"), F.size(F.filter(F.slice("tokens", F.lit(1), k), lambda y: y == x)).alias("again")))
    words = anchors.select("anchor_id", F.explode(counted).alias("x")).select("anchor_id", "x.*")
    rows = words.join(words.groupBy("token").agg(F.count(F.lit(1)).alias("n")), "token")
    return rows.groupBy("anchor_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "token", "again"))), lambda x: F.concat_ws("#", x.again.cast("string"), x.token)).alias("terms"))


def near_pairs(left: DataFrame, right: DataFrame, levels: DataFrame, p: Params) -> DataFrame:
    """Pairs of ``left`` (with q_alpha, tokens, terms) and ``right`` (with r_alpha, far, far_terms) of one group and sample pair that can be near enough.

    A score over ``min_score`` needs a distance of at most d = q_alpha + r_alpha - min_score - 1.  Then, of a side's tokens,
    all but d stand in the other too, so the d + 1 rarest of both have one in common: rows meet by these, once for each
    alpha of the other side.  A pair stays where they have met by the first of their common terms and have enough of them.  A side
    of d tokens or fewer need share nothing; it meets all rows of its group and alphas.
    """
    keys = ["group_id", "query_sample", "target_sample", "q_alpha", "r_alpha"]
    room = F.col("q_alpha") + F.col("r_alpha") - F.lit(p.min_score + 1)
    leveled = lambda rows, other: rows.join(F.broadcast(levels)).withColumn(other, F.explode("levels")).drop("levels").withColumn("room", room).where("room >= 0")
    ask, have = leveled(left, "r_alpha"), leveled(right, "q_alpha").drop("room")
    first = lambda terms: F.slice(terms, F.lit(1), (room + 1).cast("int"))
    long_ask, long_have = F.size("terms") > room, F.size("far_terms") > room
    # Rows stand once for each of their rarest terms, so these are cut from the terms after the join and not carried along.
    one, other = ask.where(long_ask).withColumn("term", F.explode(first("terms"))), have.where(long_have).withColumn("term", F.explode(first("far_terms")))
    met = one.join(other, [*keys, "term"]).where(F.element_at(F.array_intersect(first("terms"), first("far_terms")), 1) == F.col("term")).drop("term")
    met = met.where(F.size(F.array_intersect("terms", "far_terms")) >= F.greatest(F.size("terms"), F.size("far_terms")) - F.col("room"))
    short = ask.where(~long_ask).join(have, keys).unionByName(ask.where(long_ask).join(have.where(~long_have), keys))
    return met.unionByName(short).drop("terms", "far_terms").where(F.abs(F.size("tokens") - F.size("far")) <= F.col("room")).drop("room")


def scored_candidates(asked: DataFrame, anchors: DataFrame, alpha: DataFrame, p: Params = Params(), most: int = LETTERS) -> DataFrame:
    """``asked`` with targets of the same group whose ``q_alpha + r_alpha - distance`` is over ``min_score``; the distance is the smaller of the forward and the reversed one.

    Only pairs that share enough tokens for it are measured (see near_pairs).  Neither side of a pair has an alpha of 0, so
    only anchors in ``alpha`` are looked up and put in order.
    """
    known = checkpointed(anchors.join(alpha.select("anchor_id"), "anchor_id", "left_semi").select("anchor_id", "sample", "group_id", "tokens"))
    terms = checkpointed(rarest_first(known))
    far = alpha.join(known.select("anchor_id", F.col("sample").alias("target_sample"), "group_id", F.col("tokens").alias("far")), "anchor_id").join(terms.withColumnRenamed("terms", "far_terms"), "anchor_id")
    far = far.select(F.col("anchor_id").alias("target_anchor_id"), "target_sample", F.col("of_sample").alias("query_sample"), "group_id", "far", "far_terms", F.col("alpha").alias("r_alpha"))
    levels = alpha.agg(F.array_sort(F.collect_set("alpha")).alias("levels"))
    own = known.select(F.col("anchor_id").alias("query_anchor_id"), "group_id", "tokens")
    left = asked.where("q_alpha > 0").join(own, "query_anchor_id").join(terms.withColumnRenamed("anchor_id", "query_anchor_id"), "query_anchor_id")
    met = near_pairs(left, far, levels, p)
    ways = met.withColumn("plus", token_distance(F.col("tokens"), F.col("far"), most)).withColumn("minus", token_distance(F.reverse("tokens"), F.col("far"), most))
    scored = ways.withColumn("edit_distance", F.least("plus", "minus")).withColumn("strand", F.when(F.col("minus") < F.col("plus"), "-").otherwise("+"))
    return scored.withColumn("score", F.col("q_alpha") + F.col("r_alpha") - F.col("edit_distance")).where(F.col("score") > p.min_score)


def by_edit_distance(asked: DataFrame, anchors: DataFrame, alpha: DataFrame, p: Params = Params(), most: int = LETTERS) -> DataFrame:
    """The best candidate as primary if it leads by ``margin`` or is alone, else all within ``margin`` of it as ambiguous."""
    over = Window.partitionBy(*PAIR)
    order = over.orderBy(F.desc("score"), "edit_distance", "target_anchor_id")
    numbered = scored_candidates(asked, anchors, alpha, p, most).withColumn("rank", F.row_number().over(order))
    ranked = numbered.select("*", F.count("*").over(over).alias("candidates"), F.max("score").over(over).alias("top"), F.max(F.when(F.col("rank") == 2, F.col("score"))).over(over).alias("second"))
    lead = F.col("top") - F.coalesce("second", "top")
    sure = (F.col("candidates") == 1) | (lead >= p.margin)
    kept = ranked.withColumn("margin", lead).withColumn("sure", sure).where((F.col("sure") & (F.col("rank") == 1)) | (~F.col("sure") & (F.col("top") - F.col("score") <= p.margin)))
    return kept.withColumn("status", F.when(F.col("sure"), "primary").otherwise("ambiguous")).withColumn("method", F.lit("edit_distance")).select(COLUMNS)


def assignments(anchors: DataFrame, alpha: DataFrame, shared: DataFrame, p: Params = Params()) -> DataFrame:
    """Every anchor's assignment to each other sample: the first method that succeeds decides; otherwise one ``unmatched`` row."""
    asked = queries(anchors, alpha, anchors)
    exact = by_exact_context(asked, anchors, alpha)
    left = asked.join(exact.select("query_anchor_id", "target_sample"), ["query_anchor_id", "target_sample"], "left_anti")
    common = by_shared_substrings(left, shared, alpha, p)
    left = left.join(common.select("query_anchor_id", "target_sample"), ["query_anchor_id", "target_sample"], "left_anti")
    near = by_edit_distance(left, anchors, alpha, p)
    nothing = left.join(near.select("query_anchor_id", "target_sample"), ["query_anchor_id", "target_sample"], "left_anti")
    none = {c: F.lit(None).cast("bigint") for c in ("target_anchor_id", "score", "edit_distance", "r_alpha", "margin", "candidates")}
    unmatched = nothing.withColumns(none | {"status": F.lit("unmatched"), "method": F.lit(None).cast("string"), "strand": F.lit(None).cast("string")}).select(COLUMNS)
    return exact.unionByName(common).unionByName(near).unionByName(unmatched)


def correspondence_rows(assigned: DataFrame) -> DataFrame:
    """(sample_a, anchor_a, sample_b, anchor_b, support, forward_score, reverse_score, forward_strand, reverse_strand) of primaries of both directions.

    Sample a is the smaller name; ``forward`` has a as the target.  A row of one direction is discordant
    if the other direction maps its near anchor elsewhere.
    """
    primary = assigned.where("status = 'primary'")
    ahead, back = primary.where("target_sample < query_sample"), primary.where("target_sample > query_sample")
    keys = ["sample_a", "anchor_a", "sample_b", "anchor_b"]
    names = lambda rows, a, b, way: rows.select(F.col(f"{a}_sample").alias("sample_a"), F.col(f"{a}_anchor_id").alias("anchor_a"), F.col(f"{b}_sample").alias("sample_b"), F.col(f"{b}_anchor_id").alias("anchor_b"), F.col("score").alias(f"{way}_score"), F.col("strand").alias(f"{way}_strand"))
    f, r = names(ahead, "target", "query", "forward"), names(back, "query", "target", "reverse")
    both = f.join(r, keys, "full_outer")
    says_b = r.select("sample_a", "anchor_a", "sample_b", F.lit(True).alias("answers_a"))
    says_a = f.select("sample_b", "anchor_b", "sample_a", F.lit(True).alias("answers_b"))
    seen = both.join(says_b, ["sample_a", "anchor_a", "sample_b"], "left").join(says_a, ["sample_b", "anchor_b", "sample_a"], "left")
    one = F.when(F.col("reverse_score").isNull(), F.when(F.col("answers_a"), "discordant").otherwise("forward_only")).otherwise(F.when(F.col("answers_b"), "discordant").otherwise("reverse_only"))
    support = F.when(F.col("forward_score").isNotNull() & F.col("reverse_score").isNotNull(), "both").otherwise(one)
    return seen.select(*keys, support.alias("support"), "forward_score", "reverse_score", "forward_strand", "reverse_strand")


def pair_strand(forward: Column, other: Column, turned: Column) -> Column:
    """``+`` if two anchors read alike, ``-`` if one reads like the other turned round, ``.`` if both or neither."""
    same, back = F.coalesce(forward == other, F.lit(False)), F.coalesce(forward == turned, F.lit(False))
    return F.when(same == back, ".").when(same, "+").otherwise("-")


def chain_candidates(rows: DataFrame, assigned: DataFrame, anchors: DataFrame) -> DataFrame:
    """(sample_a, sample_b, q, t, strand, qs, ts, score, both, anchor_a, anchor_b): where chains may step.

    Correspondences come first; ambiguous assignments whose pair of anchors has none fill in.  Score and
    strand are those of the direction that scores more (the forward one on ties); a strand that no
    direction reports is that of the anchors' tokens, and candidates without any are left out.
    ``anchors`` has (anchor_id, sequence_id, center, tokens); a is the reference axis ``t``/``ts``.
    """
    back = (F.col("support") == "reverse_only") | (F.col("forward_score").isNull()) | ((F.col("support").isin("both", "discordant")) & (F.coalesce(F.col("reverse_score"), F.lit(-(1 << 40))) > F.coalesce(F.col("forward_score"), F.lit(-(1 << 40)))))
    chosen = rows.select("sample_a", "anchor_a", "sample_b", "anchor_b", F.when(back, F.col("reverse_score")).otherwise(F.col("forward_score")).alias("score"), F.when(back, F.col("reverse_strand")).otherwise(F.col("forward_strand")).alias("reported"), (F.col("support") == "both").alias("both"), F.lit(0).alias("source"))
    turned = F.col("target_sample") > F.col("query_sample")
    swap = lambda x, y: F.when(turned, F.col(y)).otherwise(F.col(x))
    more = assigned.where("status = 'ambiguous'").select(swap("target_sample", "query_sample").alias("sample_a"), swap("target_anchor_id", "query_anchor_id").alias("anchor_a"), swap("query_sample", "target_sample").alias("sample_b"), swap("query_anchor_id", "target_anchor_id").alias("anchor_b"), "score", F.col("strand").alias("reported"), F.lit(False).alias("both"), F.lit(1).alias("source"))
    first = Window.partitionBy("sample_a", "anchor_a", "sample_b", "anchor_b").orderBy("source", F.desc("score"), "reported")
    union = chosen.unionByName(more).withColumn("place", F.row_number().over(first)).where("place = 1 and score is not null")
    union = checkpointed(union.drop("source", "place"))
    ends = union.select(F.explode(F.array("anchor_a", "anchor_b")).alias("anchor_id"))
    placed_anchors = checkpointed(anchors.join(ends, "anchor_id", "left_semi").select("anchor_id", "sequence_id", "center", "tokens"))
    at = lambda side: placed_anchors.select(F.col("anchor_id").alias(f"anchor_{side}"), F.col("sequence_id").alias(f"sequence_{side}"), F.col("center").alias(f"center_{side}"), F.col("tokens").alias(f"tokens_{side}"))
    placed = union.join(at("a"), "anchor_a").join(at("b"), "anchor_b")
    strand = F.when(F.col("reported").isin("+", "-"), F.col("reported")).otherwise(pair_strand(F.col("tokens_a"), F.col("tokens_b"), F.reverse("tokens_b")))
    out = placed.withColumn("strand", strand).where("strand <> '.'")
    return out.select("sample_a", "sample_b", F.concat_ws(":", "sample_b", "sequence_b").alias("q"), F.concat_ws(":", "sample_a", "sequence_a").alias("t"), "strand", F.col("center_b").alias("qs"), F.col("center_a").alias("ts"), "score", "both", "anchor_a", "anchor_b")
