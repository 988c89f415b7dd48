"""What there is around a variant, where duplications that were missed got lost, and why gaps between final records stay.

Truths are (truth_id, q, t, ref_start, ref_end, query_start, query_end): a duplication's two copies are the halves of
its query interval.  Anchor pairs and records have half-open places (q, t, ts, te, qs, qe).
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.components import connected_components
from tessera.operators.dyadic import containing, overlap_counts, overlap_pairs

#: Genotypes without another allele than the reference's.
REFERENCE_GENOTYPES = [".", "./.", "0", "0/0", "0|0"]

#: Bases around a duplication in which insertions and calls count as near.
NEAR = 500


def non_reference(genotype: Column) -> Column:
    """Whether a sample field (its text up to the first colon) has another allele than the reference's."""
    return ~F.substring_index(genotype, ":", 1).isin(REFERENCE_GENOTYPES)


_RUN = re.compile(r"([0-9]+)([=XMID])")


def insertions_of(text: str | None, t: int, q: int) -> list[dict]:
    """The insertions of a CIGAR with their places on both axes, counted from ``t`` and ``q`` on."""
    out = []
    for n, op in _RUN.findall(text or ""):
        n = int(n)
        if op == "I":
            out.append({"t": t, "q": q, "size": n})
        q += n if op != "D" else 0
        t += n if op != "I" else 0
    return out


def insertions(cigar: str, ts: str, qs: str) -> Column:
    """``insertions_of`` of three columns, in linear time."""

    @F.pandas_udf("array<struct<t: bigint, q: bigint, size: bigint>>")
    def found(cigar: pd.Series, ts: pd.Series, qs: pd.Series) -> pd.Series:
        return pd.Series([insertions_of(*x) for x in zip(cigar, ts, qs)], dtype=object)

    return found(cigar, ts, qs)


def _overlap(a0: str, a1: str, b0: str, b1: str) -> Column:
    return F.expr(f"greatest(least({a1}, {b1}) - greatest({a0}, {b0}), 0)")


def _copies(truths: DataFrame) -> DataFrame:
    return truths.withColumn("size", F.expr("(query_end - query_start) div 2")).withColumn("middle", F.col("query_start") + F.col("size"))


def copy_anchors(truths: DataFrame, pairs: DataFrame, prefix: str) -> DataFrame:
    """(truth_id, <prefix>_1, <prefix>_2): anchor pairs that overlap a truth on the reference and its first or second copy on the query."""
    met = overlap_pairs(_copies(truths), pairs.select("q", "t", "ts", "te", "qs", "qe"), ["q", "t"], ("ref_start", "ref_end"), ("ts", "te"))
    first, second = _overlap("qs", "qe", "query_start", "middle") > 0, _overlap("qs", "qe", "middle", "query_end") > 0
    return met.groupBy("truth_id").agg(F.count_if(first).alias(f"{prefix}_1"), F.count_if(second).alias(f"{prefix}_2"))


def record_support(truths: DataFrame, records: DataFrame) -> DataFrame:
    """(truth_id, near_records, records_1, records_2, inserted): records over a truth, those over half of it and of a copy, and their insertions near both."""
    met = overlap_pairs(_copies(truths), records.select("q", "t", "ts", "te", "qs", "qe", "cigar"), ["q", "t"], ("ref_start", "ref_end"), ("ts", "te"))
    half = F.greatest(F.lit(1), F.expr("size div 2"))
    wide = _overlap("ts", "te", "ref_start", "ref_end") >= half
    over = lambda a, b: F.count_if(wide & (_overlap("qs", "qe", a, b) >= half))
    near = F.expr(f"""transform(filter(ins, x -> x.t between ref_start - {NEAR} and ref_end + {NEAR} and
        (least(x.q + x.size, query_end) > greatest(x.q, query_start) or x.q between query_start - {NEAR} and query_end + {NEAR})), x -> x.size)""")
    rows = met.withColumn("ins", insertions("cigar", "ts", "qs")).withColumn("near", near)
    found = rows.groupBy("truth_id").agg(F.count(F.lit(1)).alias("near_records"), over("query_start", "middle").alias("records_1"), over("middle", "query_end").alias("records_2"), F.flatten(F.collect_list("near")).alias("inserted"))
    return found.withColumn("inserted", F.array_sort("inserted"))


def near_calls(truths: DataFrame, calls: DataFrame) -> DataFrame:
    """(truth_id, call_id, far, size_ratio, reported) of calls (q, t, call_id, pos, call_size) as far from a truth as its copy is long, 500 at least.

    ``reported`` are those within half a copy, 500 at least.
    """
    size, wide = F.col("size"), lambda x: F.greatest(F.lit(NEAR), x)
    padded = _copies(truths).withColumns({"low": F.col("ref_start") - wide(size), "high": F.col("ref_end") + wide(size) + 1})
    met = containing(calls.select("q", "t", "call_id", "pos", "call_size"), padded, ["q", "t"], "pos", "low", "high")
    pad = wide(F.expr("size div 2"))
    ratio = F.when(F.greatest("call_size", "size") > 0, F.least("call_size", "size") / F.greatest("call_size", "size"))
    return met.select("truth_id", "call_id", F.abs(F.col("pos") - F.col("ref_start")).alias("far"), ratio.alias("size_ratio"), F.col("pos").between(F.col("ref_start") - pad, F.col("ref_end") + pad).alias("reported"))


def failure_stages(truths: DataFrame, assigned: DataFrame, chained: DataFrame, records: DataFrame, calls: DataFrame, identities: DataFrame) -> DataFrame:
    """Missed duplications with their evidence and the ``stage`` that lost them.

    ``truths`` have also ``pct_sequence`` and ``pct_size``, how like the nearest call was (null: unknown); ``identities``
    (truth_id, identity) how like a call's inserted bases are to the truth's.  The first stage without evidence counts.
    """
    zero = F.lit(0).cast("bigint")
    seen = near_calls(truths, calls).groupBy("truth_id").agg(
        F.count_if("reported").alias("near_calls"), F.count(F.lit(1)).alias("wide_calls"), F.min(F.when(F.col("size_ratio") >= 0.7, F.col("far"))).alias("closest")
    )
    rows = _copies(truths)
    for found in (copy_anchors(truths, assigned, "assigned"), copy_anchors(truths, chained, "chained"), record_support(truths, records), seen, identities.select("truth_id", "identity")):
        rows = rows.join(found, "truth_id", "left")
    counts = ["assigned_1", "assigned_2", "chained_1", "chained_2", "near_records", "records_1", "records_2", "near_calls", "wide_calls"]
    rows = rows.withColumns({c: F.coalesce(c, zero) for c in counts} | {"identity": F.coalesce("identity", F.lit(0.0)), "inserted": F.coalesce("inserted", F.expr("cast(array() as array<bigint>)"))})
    rows = rows.withColumn("signal", F.expr("exists(inserted, x -> x >= 0.7 * size and x <= 1.3 * size) or (records_1 > 0 and records_2 > 0)"))
    unlike = F.col("pct_sequence") < 0.7
    stages = [
        (unlike & (F.col("identity") >= 0.95), "benchmark_dup_resolution_mismatch"),
        (unlike & (F.col("pct_size") >= 0.7), "graph_allele_sequence_mismatch"),
        (unlike, "graph_vcf_size_mismatch"),
        (F.col("closest") > NEAR, "graph_vcf_breakpoint_mismatch"),
        (F.col("closest").isNotNull(), "benchmark_matching_failure"),
        (F.col("wide_calls") > 0, "graph_vcf_size_mismatch"),
        (F.expr("assigned_1 + assigned_2 = 0"), "assignment_missing"),
        (F.expr("least(assigned_1, assigned_2) = 0"), "one_copy_assignment_missing"),
        (F.expr("chained_1 + chained_2 = 0"), "chaining_missing"),
        (F.expr("least(chained_1, chained_2) = 0"), "one_copy_final_chain_missing"),
        (F.expr("near_records = 0"), "base_alignment_missing"),
        (~F.col("signal"), "paf_duplication_signal_missing"),
    ]
    stage = F.lit("graph_vcf_call_missing")
    for test, name in reversed(stages):
        stage = F.when(test, name).otherwise(stage)
    return rows.select("truth_id", "size", *counts[:-1], F.array_join(F.transform("inserted", lambda x: x.cast("string")), ",").alias("inserted"), "identity", stage.alias("stage"))


def inserted_bases(ref: str, alt: str) -> str:
    """What an allele has in place of the reference's bases, without the prefix and then the suffix that both share; nothing for a symbolic one."""
    ref, alt = ref.upper(), alt.upper()
    if alt.startswith("<"):
        return ""
    least, front, back = min(len(ref), len(alt)), 0, 0
    while front < least and ref[front] == alt[front]:
        front += 1
    while back < least - front and ref[-1 - back] == alt[-1 - back]:
        back += 1
    return alt[front : len(alt) - back]


def shifted_likeness(a: str, b: str, most: int) -> float:
    """Equal letters of two texts laid on each other with a shift of up to ``most`` either way, at best, over the longer length."""
    if not a or not b:
        return 0.0
    x, y = (np.frombuffer(s.encode("utf-32-le"), dtype="<u4") for s in (a, b))
    best = 0
    for shift in range(-most, most + 1):
        u, v = x[max(shift, 0) :], y[max(-shift, 0) :]
        n = min(len(u), len(v))
        best = max(best, int(np.count_nonzero(u[:n] == v[:n])))
    return best / max(len(x), len(y))


def best_identities(pairs: DataFrame, most_shift: int = 20) -> DataFrame:
    """(truth_id, identity, call_id): of pairs (truth_id, source, call_id, ref, alt) the call whose inserted bases are most like each truth's source.

    Ties go to the smallest call_id.  Nulls are empty.
    """

    @F.pandas_udf("double")
    def likeness(source: pd.Series, ref: pd.Series, alt: pd.Series) -> pd.Series:
        return pd.Series([shifted_likeness(inserted_bases(r or "", a or ""), (s or "").upper(), most_shift) for s, r, a in zip(source, ref, alt)], dtype="float64")

    rows = pairs.select("truth_id", "call_id", likeness("source", "ref", "alt").alias("identity"))
    best = rows.groupBy("truth_id").agg(F.max(F.struct("identity", (-F.col("call_id")).alias("n"))).alias("x"))
    return best.select("truth_id", "x.identity", (-F.col("x.n")).alias("call_id"))


def local_evidence(variants: DataFrame, sources: dict[str, DataFrame], window: int) -> DataFrame:
    """Variants (event_id, q, t, start, end) with one count for each source: how many of its rows (q, t, start, end) overlap the stretch of ``window`` bases around them.

    A source of centres has [centre - 1, centre + 1), as both borders of the window count there.
    """
    rows = variants.withColumns({"low": F.greatest(F.col("start") - window, F.lit(0)).cast("bigint"), "high": (F.col("end") + window).cast("bigint")})
    own = {name: found.select("q", "t", F.col("start").alias("__s"), F.col("end").alias("__e")) for name, found in sources.items()}
    out = rows.join(overlap_counts(rows, own, ["q", "t"], ("low", "high"), ("__s", "__e")), ["q", "t", "low", "high"], "left")
    return out.select("event_id", "q", "t", "low", "high", *(F.coalesce(n, F.lit(0).cast("bigint")).alias(n) for n in sources))


def gap_decisions(gaps: DataFrame, extensions: DataFrame, patches: DataFrame, near: int = 5000) -> DataFrame:
    """Gaps between final records traced to the decision about them: (left_no, right_no, match, extension and patch edges, cause).

    ``gaps`` and ``extensions`` have (sample, left_no, right_no, ref_gap, query_gap, right_ref, right_query), ``extensions``
    also stop_reason; ``patches`` (left_no, right_no, ref_gap, query_gap, status, merge).  Numbers of chains are unique.
    A decision about the same edge counts first, then the most alike gap between the same merged chains, then, for
    extensions, the nearest one from the same merged chain to a right end within ``near`` bases on both axes.
    Ties go to the smallest numbers.
    """
    named = connected_components(patches.where("merge").select(F.col("left_no").alias("u"), F.col("right_no").alias("v")))

    def merged(rows: DataFrame) -> DataFrame:
        for side in ("left", "right"):
            rows = rows.join(named.select(F.col("node").alias(f"{side}_no"), F.col("component").alias(f"{side}_m")), f"{side}_no", "left").withColumn(f"{side}_m", F.coalesce(f"{side}_m", f"{side}_no"))
        return rows

    edge = lambda n: F.struct(F.col("left_no").alias("l"), F.col("right_no").alias("r"), *n).alias("x")
    ext, pat = merged(extensions), merged(patches)
    e_said, p_said = ["stop_reason"], ["status", "merge"]

    def of_edge(rows: DataFrame, said: list[str], name: str) -> DataFrame:
        return rows.groupBy("left_no", "right_no").agg(F.min(edge(said)).alias(name))

    def most_alike(asked: DataFrame, rows: DataFrame, said: list[str], name: str) -> DataFrame:
        other = rows.where("left_m <> right_m").select("left_m", "right_m", F.col("ref_gap").alias("rg"), F.col("query_gap").alias("qg"), edge(said))
        far = F.abs(F.col("ref_gap") - F.col("rg")) + F.abs(F.col("query_gap") - F.col("qg"))
        return asked.join(other, ["left_m", "right_m"]).groupBy("left_no", "right_no").agg(F.min(F.struct(far.alias("far"), "x")).alias("y")).select("left_no", "right_no", F.col("y.x").alias(name))

    key = ["left_no", "right_no"]
    rows = merged(gaps).join(of_edge(ext, e_said, "e"), key, "left").join(of_edge(pat, p_said, "p"), key, "left")
    rows = rows.withColumn("match", F.when(F.col("e").isNotNull() | F.col("p").isNotNull(), "exact"))
    open_ = rows.where("e is null").select(*key, "left_m", "right_m", "ref_gap", "query_gap", "sample", "right_ref", "right_query")
    cell = f"right_ref div {near + 1}"
    at = ext.select("sample", "left_m", F.expr(cell).alias("cell"), F.col("right_ref").alias("rr"), F.col("right_query").alias("rq"), edge(e_said))
    far_ref, far_query = F.abs(F.col("right_ref") - F.col("rr")), F.abs(F.col("right_query") - F.col("rq"))
    beside = open_.withColumn("cell", F.explode(F.expr(f"sequence({cell} - 1, {cell} + 1)"))).join(at, ["sample", "left_m", "cell"]).where((far_ref <= near) & (far_query <= near))
    proxy = beside.groupBy(*key).agg(F.min(F.struct((far_ref + far_query).alias("far"), "x")).alias("y")).select(*key, F.col("y.x").alias("e_near"))
    rows = rows.join(most_alike(open_, ext, e_said, "e_like"), key, "left").join(proxy, key, "left")
    rows = rows.withColumn("match", F.when(F.col("e").isNull() & F.col("e_like").isNotNull(), "merged_component").when(F.col("e").isNull() & F.col("e_near").isNotNull(), "competing_chain_coordinate_proxy").otherwise(F.coalesce("match", F.lit("."))))
    rows = rows.withColumn("e", F.coalesce("e", "e_like", "e_near")).drop("e_like", "e_near")
    by_extension = of_edge(pat, p_said, "p_edge").select(F.col("left_no").alias("el"), F.col("right_no").alias("er"), "p_edge")
    rows = rows.join(by_extension, (F.col("e.l") == F.col("el")) & (F.col("e.r") == F.col("er")), "left").withColumn("p", F.coalesce("p", "p_edge"))
    rows = rows.join(most_alike(rows.where("p is null").select(*key, "left_m", "right_m", "ref_gap", "query_gap"), pat, p_said, "p_like"), key, "left").withColumn("p", F.coalesce("p", "p_like"))
    status = F.col("p.status")
    cause = (
        F.when(status.isin("patch_interval_low_identity", "patch_zdrop_reject"), status).when(F.col("p.merge"), "accepted_patch_boundary_remains").when(F.col("p").isNotNull(), status)
        .when(F.col("e.stop_reason") == "gap_too_large", "not_patch_eligible_gap_too_large").when(F.col("e").isNotNull(), "no_patch_record_after_extension").otherwise("merged_lineage_or_nonadjacent_chain")
    )
    return rows.select("sample", *key, "ref_gap", "query_gap", "match", F.col("e.l").alias("extension_left"), F.col("e.r").alias("extension_right"), F.col("p.l").alias("patch_left"), F.col("p.r").alias("patch_right"), cause.alias("cause"))
