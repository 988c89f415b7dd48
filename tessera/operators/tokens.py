"""Token streams of anchors and distances, contexts, n-grams and minimal unique token substrings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.sequence import canonical_array
from tessera.operators.lineage import checkpointed
from tessera.sources.tables import TOKEN_BIN

#: Tokens on each side of a context, and the longest substring: a whole context.
RADIUS = 2
MOST = 2 * RADIUS + 1


def structural_tokens(anchors: DataFrame, width: int = TOKEN_BIN, keep: tuple[str, ...] = ()) -> DataFrame:
    """(sample, sequence_id, token_index, token_type, token, anchor_id, raw_distance, distance_bin): A tokens at even places, D tokens between them.

    A tokens have the anchor's columns ``keep`` too, which are null in D tokens.
    """
    over = Window.partitionBy("sequence_id").orderBy("center", "anchor_id")
    rows = anchors.where("groupable").select("sample", "sequence_id", "anchor_id", "group_id", "center", (F.row_number().over(over) - 1).cast("bigint").alias("r"), (F.col("center") - F.lag("center").over(over)).alias("d"), *(F.col(c).alias(f"keep_{c}") for c in keep))
    a = F.struct((2 * F.col("r")).alias("token_index"), F.lit("A").alias("token_type"), F.concat(F.lit("A:"), "group_id").alias("token"), F.col("anchor_id"), F.lit(None).cast("bigint").alias("raw_distance"), F.lit(None).cast("bigint").alias("distance_bin"), *(F.col(f"keep_{c}").alias(c) for c in keep))
    cell = F.expr(f"d div {width}")
    d = F.struct((2 * F.col("r") - 1).alias("token_index"), F.lit("D").alias("token_type"), F.concat(F.lit("D:"), cell).alias("token"), F.lit(None).cast("bigint").alias("anchor_id"), F.col("d").alias("raw_distance"), cell.alias("distance_bin"), *(F.lit(None).cast(anchors.schema[c].dataType).alias(c) for c in keep))
    return rows.select("sample", "sequence_id", F.explode(F.when(F.col("r") > 0, F.array(d, a)).otherwise(F.array(a))).alias("x")).select("sample", "sequence_id", "x.*")


def framed(tokens: Column) -> Column:
    """Hex digits of a token array in which each token follows its length (32 bits, little-endian), so that no two arrays are written alike."""

    def one(x: Column) -> Column:
        size = F.lpad(F.hex(F.octet_length(x)), 8, "0")
        return F.concat(*(F.substring(size, k, 2) for k in (7, 5, 3, 1)), F.hex(x.cast("binary")))

    return F.array_join(F.transform(tokens, one), "")


def anchor_contexts(tokens: DataFrame, radius: int = RADIUS, keep: tuple[str, ...] = ()) -> DataFrame:
    """(anchor_id, sequence_id, sample, center_token_index, context_start, context_end, context_key, forward_tokens) of each anchor token, and its columns ``keep``."""
    over = Window.partitionBy("sequence_id").orderBy("token_index").rowsBetween(-radius, radius)
    last = Window.partitionBy("sequence_id")
    rows = tokens.select("*", F.collect_list("token").over(over).alias("context"), F.max("token_index").over(last).alias("last"))
    return rows.where("token_type = 'A'").select(
        "anchor_id", "sequence_id", "sample", F.col("token_index").alias("center_token_index"), F.greatest(F.lit(0), F.col("token_index") - radius).alias("context_start"),
        F.least("last", F.col("token_index") + radius).alias("context_end"), F.sha2(F.unhex(framed(canonical_array(F.col("context")))), 256).alias("context_key"), F.array_join("context", "|").alias("forward_tokens"), *keep,
    )


def token_ngrams(tokens: DataFrame, most: int = MOST) -> DataFrame:
    """(sample, sequence_id, start, length, gram): all runs of 1 to ``most`` tokens that hold an anchor token."""
    over = Window.partitionBy("sequence_id").orderBy("token_index").rowsBetween(0, most - 1)
    rows = tokens.select("sample", "sequence_id", F.col("token_index").alias("start"), F.collect_list("token").over(over).alias("ahead"))
    grams = rows.select("sample", "sequence_id", "start", F.explode(F.sequence(F.lit(1), F.size("ahead"))).alias("length"), "ahead").withColumn("gram", F.slice("ahead", F.lit(1), F.col("length")))
    return grams.where(F.exists("gram", lambda x: x.startswith("A:"))).drop("ahead")


def key(gram: str) -> Column:
    """The strand-free name of an n-gram."""
    return F.array_join(canonical_array(F.col(gram)), ",")


def fingerprint(gram: str) -> Column:
    """A strand-free name of fixed width: 128 bits of the framed n-gram's SHA-256 as hex digits, a colon and its number of tokens.

    As a key it takes the same room in a shuffle for tokens of any length.
    """
    digest = F.sha2(F.unhex(framed(canonical_array(F.col(gram)))), 256)
    return F.concat(F.substring(digest, 1, 32), F.lit(":"), F.size(gram).cast("string"))


#: Where an n-gram stands.
PLACE = ["sequence_id", "start", "length"]


def unique_grams(grams: DataFrame) -> DataFrame:
    """(sample, gram_key, sequence_id, start, length): n-grams that occur once in their sample, with their place.

    Where the count is one, the least of each column is that of the one occurrence; sums of fixed width need no sort.
    """
    keyed = grams.select("sample", key("gram").alias("gram_key"), *PLACE)
    counts = keyed.groupBy("sample", "gram_key").agg(F.count("*").alias("n"), *(F.min(c).alias(c) for c in PLACE))
    return counts.where("n = 1").drop("n")


def minimal_unique(grams: DataFrame) -> DataFrame:
    """(sample, gram_key, length, sequence_id, start): n-grams that occur once in their sample while neither trim by one token that holds an anchor does.

    A trim that is unique stands at the n-gram's place and nowhere else, so trims are looked up by their places.
    """
    unique = checkpointed(unique_grams(grams))
    left = unique.select("sample", "sequence_id", "start", (F.col("length") + 1).alias("length"))
    right = unique.select("sample", "sequence_id", (F.col("start") - 1).alias("start"), (F.col("length") + 1).alias("length"))
    keys = ["sample", *PLACE]
    return unique.join(left, keys, "left_anti").join(right, keys, "left_anti").select("sample", "gram_key", "length", "sequence_id", "start")


def substring_hits(grams: DataFrame, minimal: DataFrame) -> DataFrame:
    """(sequence_id, start, last, of_sample, gram_key): occurrences, either way round, of each sample's minimal unique substrings."""
    wanted = minimal.select(F.col("sample").alias("of_sample"), "gram_key")
    return grams.select("sequence_id", "start", (F.col("start") + F.col("length") - 1).alias("last"), key("gram").alias("gram_key")).join(wanted, "gram_key")


def alpha_prime(tokens: DataFrame, hits: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(anchor_id, of_sample, alpha): hits within ``radius`` tokens of each anchor, where there are any.

    A hit touches a run of anchors, so it counts as +1 at the run's first and -1 after its last, and a
    running sum over the sequence gives each anchor's number without an interval join.
    """
    anchors = tokens.where("token_type = 'A'").select("sequence_id", F.expr("token_index div 2").alias("rank"), "anchor_id")
    lo = F.ceil(F.greatest(F.lit(0), F.col("last") - radius) / 2)
    hi = F.floor((F.col("start") + radius) / 2)
    deltas = hits.select("sequence_id", "of_sample", F.explode(F.array(F.struct(lo.alias("rank"), F.lit(1).alias("delta")), F.struct((hi + 1).alias("rank"), F.lit(-1).alias("delta")))).alias("x"))
    deltas = deltas.groupBy("sequence_id", "of_sample", F.col("x.rank").alias("rank")).agg(F.sum("x.delta").alias("delta"))
    present = anchors.join(hits.select("sequence_id", "of_sample").distinct(), "sequence_id")
    both = present.select("sequence_id", "of_sample", "rank", "anchor_id", F.lit(0).cast("bigint").alias("delta")).unionByName(deltas.select("sequence_id", "of_sample", "rank", F.lit(None).cast("bigint").alias("anchor_id"), "delta"))
    running = Window.partitionBy("sequence_id", "of_sample").orderBy("rank").rangeBetween(Window.unboundedPreceding, 0)
    return both.withColumn("alpha", F.sum("delta").over(running)).where("anchor_id is not null and alpha > 0").select("anchor_id", "of_sample", "alpha")


def alpha_histogram(tokens: DataFrame, alpha: DataFrame) -> DataFrame:
    """(of_sample, zero, low, middle, high): anchors with 0, 1-9, 10-49 and 50 or more hits of each sample."""
    total = tokens.where("token_type = 'A'").agg(F.count("*").alias("anchors"))
    by = alpha.groupBy("of_sample").agg(F.count("*").alias("some"), F.count_if(F.col("alpha").between(1, 9)).alias("low"), F.count_if(F.col("alpha").between(10, 49)).alias("middle"), F.count_if(F.col("alpha") >= 50).alias("high"))
    return by.join(F.broadcast(total)).select("of_sample", (F.col("anchors") - F.col("some")).alias("zero"), "low", "middle", "high")
