"""Alignment of a pair of stretches between anchors: strand by the anchors' bases, segments aligned one by one, and put together.

``pairs`` have (pair_id, ref, query, strand, anchors): the bases of both stretches, the strand that is claimed, and
anchors (ref_start, ref_end, query_start, query_end), half-open places in the two as they are given.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.sequence import CODES, COMPLEMENTS, reverse_complement
from tessera.operators.alignment import global_alignment
from tessera.operators.batched import global_alignments, near_alignments
from tessera.operators.wavefront import GAP, near_alignment, wave_alignment

#: Segments whose alignment costs more than a fifth of the table's rows fill it, if it has so many cells at most; all others are aligned by wavefronts.
MOST_CELLS = 1_000_000


def _piece(text: str, x: Column, side: str) -> Column:
    return F.substring(F.col(text), (x[f"{side}_start"] + 1).cast("int"), (x[f"{side}_end"] - x[f"{side}_start"]).cast("int"))


def strand_votes(pairs: DataFrame) -> DataFrame:
    """``pairs`` with ``forward``, ``reverse``, ``incompatible`` and ``effective``.

    An anchor whose bases are equal votes forward, one whose bases are each other's reverse complement
    votes reverse.  The strand of the majority is effective; on a tie the claimed one.
    """
    same = lambda x: _piece("ref", x, "ref") == _piece("query", x, "query")
    turned = lambda x: _piece("ref", x, "ref") == reverse_complement(_piece("query", x, "query"))
    kind = F.transform("anchors", lambda x: F.when(same(x), 0).when(turned(x), 1).otherwise(2))
    count = lambda k: F.size(F.filter("kinds", lambda x: x == k)).cast("bigint")
    voted = pairs.withColumn("kinds", F.coalesce(kind, F.array().cast("array<int>"))).withColumns({"forward": count(0), "reverse": count(1), "incompatible": count(2)}).drop("kinds")
    return voted.withColumn("effective", F.when(F.col("reverse") > F.col("forward"), "-").when(F.col("forward") > F.col("reverse"), "+").otherwise(F.col("strand")))


def guides(ref: str, query: str, anchors: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """The anchors that guide an alignment of two texts of one strand.

    Anchors inside both texts are put in order and taken if they begin behind the last one taken on both sides; those
    of them whose bases are equal stay.
    """
    taken, ends = [], (0, 0)
    for a, b, c, d in sorted(anchors):
        if 0 <= a < b <= len(ref) and 0 <= c < d <= len(query) and a >= ends[0] and c >= ends[1]:
            taken.append((a, b, c, d))
            ends = b, d
    return [x for x in taken if ref[x[0] : x[1]] == query[x[2] : x[3]]]


_TURN = str.maketrans(CODES, COMPLEMENTS)


def segments(voted: DataFrame) -> DataFrame:
    """(pair_id, no, ref, query, anchor) of ``strand_votes`` rows on their effective strand: what stands before each guide, and the guide's length.

    The last segment has no guide behind it; pairs without guides have no segments.
    """

    def run(batches):
        for batch in batches:
            out = []
            for pair, ref, query, strand, anchors in batch.itertuples(index=False):
                n, ref, query = len(query), ref.upper(), query.upper()
                places = [(x["ref_start"], x["ref_end"], x["query_start"], x["query_end"]) for x in (anchors if anchors is not None else ())]
                if strand == "-":
                    query, places = query.translate(_TURN)[::-1], [(a, b, n - d, n - c) for a, b, c, d in places]
                found, r, q = guides(ref, query, places), 0, 0
                for no, (a, b, c, d) in enumerate([*found, (len(ref), len(ref), n, n)] if found else []):
                    out.append((pair, no, ref[r:a], query[q:c], b - a))
                    r, q = b, d
            yield pd.DataFrame(out, columns=["pair_id", "no", "ref", "query", "anchor"])

    kind = dict(voted.dtypes)["pair_id"]
    return voted.select("pair_id", "ref", "query", "effective", "anchors").mapInPandas(run, f"pair_id {kind}, no int, ref string, query string, anchor long")


def segment_alignment(ref: str, query: str) -> tuple[str, int, int]:
    """(CIGAR, score, matches) of one segment: gaps where a side is empty, else a best global alignment."""
    if not ref or not query:
        n = len(ref) + len(query)
        return (f"{n}{'D' if ref else 'I'}" if n else ""), -n, 0
    if (len(ref) + 1) * (len(query) + 1) > MOST_CELLS:
        return wave_alignment(ref, query)
    most = len(ref) // 5
    return (near_alignment(ref, query, most) if GAP * abs(len(ref) - len(query)) <= most else None) or global_alignment(ref, query)


def segment_alignments(refs: list[str], queries: list[str]) -> list[tuple[str, int, int]]:
    """``segment_alignment`` of every pair, with those that take the same way done together."""
    out: list[tuple[str, int, int] | None] = [None] * len(refs)
    rest = []
    for at, (ref, query) in enumerate(zip(refs, queries)):
        if not ref or not query or (len(ref) + 1) * (len(query) + 1) > MOST_CELLS:
            out[at] = segment_alignment(ref, query)
        elif ref == query:
            out[at] = f"{len(ref)}=", len(ref), len(ref)
        else:
            rest.append(at)
    for at, x in zip(rest, near_alignments([refs[at] for at in rest], [queries[at] for at in rest], [len(refs[at]) // 5 for at in rest])):
        out[at] = x
    rest = [at for at in rest if out[at] is None]
    for at, x in zip(rest, global_alignments([refs[at] for at in rest], [queries[at] for at in rest])):
        out[at] = x
    return out


_RUN = re.compile(r"([0-9]+)([=XIDM])")


def merged(cigar: str) -> str:
    """A CIGAR with neighbouring operations of one kind put together, in linear time."""
    out: list[list] = []
    for n, op in _RUN.findall(cigar):
        if out and out[-1][1] == op:
            out[-1][0] += int(n)
        elif n != "0":
            out.append([int(n), op])
    return "".join(f"{n}{op}" for n, op in out)


def anchor_guided(pairs: DataFrame) -> DataFrame:
    """(pair_id, strand, cigar, score, matches, block_length, guides) of all pairs; without a guide the last five are null, 0 guides.

    Segments are rows, so a long pair's segments are aligned in many tasks; their CIGARs and those of the guides
    between them are then put together in order.
    """
    voted = strand_votes(pairs)

    def run(batches):
        for batch in batches:
            done = pd.DataFrame(segment_alignments(batch["ref"].tolist(), batch["query"].tolist()), columns=["cigar", "score", "matches"])
            yield pd.concat([batch[["pair_id", "no", "anchor"]].reset_index(drop=True), done], axis=1)

    kind = dict(pairs.dtypes)["pair_id"]
    aligned = segments(voted).repartition("pair_id", "no").mapInPandas(run, f"pair_id {kind}, no int, anchor long, cigar string, score long, matches long")

    @F.pandas_udf("string")
    def together(cigar: pd.Series) -> pd.Series:
        return cigar.map(merged)

    text = F.concat("cigar", F.when(F.col("anchor") > 0, F.concat(F.col("anchor").cast("string"), F.lit("="))).otherwise(F.lit("")))
    parts = F.array_sort(F.collect_list(F.struct("no", text.alias("text"))))
    whole = aligned.groupBy("pair_id").agg(F.array_join(F.transform(parts, lambda x: x.text), "").alias("cigar"), F.sum(F.col("score") + F.col("anchor")).alias("score"), F.sum(F.col("matches") + F.col("anchor")).alias("matches"), F.count_if(F.col("anchor") > 0).alias("guides"))
    done = whole.withColumn("cigar", together("cigar"))
    bases = F.aggregate(F.transform(F.regexp_extract_all("cigar", F.lit("([0-9]+)"), F.lit(1)), lambda x: x.cast("bigint")), F.lit(0).cast("bigint"), lambda a, x: a + x)
    said = voted.select("pair_id", F.col("effective").alias("strand")).join(done.withColumn("block_length", bases), "pair_id", "left")
    return said.select("pair_id", "strand", "cigar", "score", "matches", "block_length", F.coalesce("guides", F.lit(0).cast("bigint")).alias("guides"))


def expanded_runs(cigar: str, ref: str, query: str) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, operations) of a CIGAR with its M operations as runs of = and X by the texts' letters; one that doesn't consume both texts is an error."""
    r, q = (np.frombuffer(x.upper().encode(), dtype=np.uint8) for x in (ref, query))
    i = j = 0
    sizes, ops = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype="<U1")]
    for n, op in _RUN.findall(cigar):
        n = int(n)
        if op == "M":
            if i + n > len(r) or j + n > len(q):
                break
            same = r[i : i + n] == q[j : j + n]
            begins = np.concatenate([np.zeros(min(n, 1), dtype=np.int64), np.flatnonzero(np.diff(same)) + 1])
            sizes.append(np.diff(begins, append=n))
            ops.append(np.where(same[begins], "=", "X"))
        else:
            sizes.append(np.array([n]))
            ops.append(np.array([op]))
        i, j = i + n * (op != "I"), j + n * (op != "D")
    if (i, j) != (len(r), len(q)) or _RUN.sub("", cigar):
        raise ValueError(f"the CIGAR doesn't fit texts of {len(r)} and {len(q)} letters: {cigar[:80]}")
    size, op = np.concatenate(sizes), np.concatenate(ops)
    size, op = size[size > 0], op[size > 0]
    first = np.flatnonzero(np.concatenate([np.ones(min(len(op), 1), dtype=bool), op[1:] != op[:-1]]))
    return np.add.reduceat(size, first) if len(first) else size, op[first]


def _written(size: np.ndarray, op: np.ndarray) -> str:
    return "".join([f"{n}{x}" for n, x in zip(size.tolist(), op.tolist())])


def expanded(cigar: str, ref: str, query: str) -> str:
    """A CIGAR as ``expanded_runs`` has it, written."""
    return _written(*expanded_runs(cigar, ref, query))


#: Bytes of texts whose operations are written at once.
SLICE = 1 << 22


def _slices(batch: pa.RecordBatch, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """A batch's rows in slices of about SLICE bytes of these columns' texts; a longer row is a slice of its own."""
    size = sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
    of = np.cumsum(size) // SLICE
    bounds = np.flatnonzero(np.concatenate([np.ones(min(len(of), 1), dtype=bool), of[1:] != of[:-1]])).tolist() + [len(of)]
    for begin, end in zip(bounds, bounds[1:]):
        yield batch.slice(begin, end - begin)


def _expanded_columns(part: pa.RecordBatch, ref: str, query: str) -> tuple[list[str], list[int], list[int]]:
    """(CIGARs, matches, all operations' lengths) of a slice's rows."""
    texts, matches, blocks = [], [], []
    for row in zip(*(part.column(c).to_pylist() for c in ("cigar", ref, query))):
        size, op = expanded_runs(*row)
        texts.append(_written(size, op))
        matches.append(int(size[op == "="].sum()))
        blocks.append(int(size.sum()))
    return texts, matches, blocks


def expand_matches(rows: DataFrame) -> DataFrame:
    """(pair_id, cigar, matches) of rows (pair_id, ref, query, cigar) with M operations told apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, ["ref", "query"]):
                texts, matches, _ = _expanded_columns(part, "ref", "query")
                yield pa.RecordBatch.from_arrays([part.column("pair_id"), pa.array(texts, pa.string()), pa.array(matches, pa.int64())], ["pair_id", "cigar", "matches"])

    return rows.select("pair_id", "ref", "query", "cigar").mapInArrow(run, f"pair_id {dict(rows.dtypes)['pair_id']}, cigar string, matches long")


def cigar_records(rows: DataFrame) -> DataFrame:
    """Alignment records (``paf.COLUMNS`` and ``tags``) of whole texts (qname, query, tname, target) and the CIGAR between them.

    M operations are told apart by letters and stand as the tag cg:Z; a block counts all operations, the
    quality is 255.  Nulls are empty texts; a CIGAR that doesn't consume both texts is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, ["target", "query"]):
                texts, matches, blocks = _expanded_columns(part, "target", "query")
                length = lambda c: pc.utf8_length(part.column(c)).cast(pa.int64())
                columns = [part.column("qname"), length("query"), part.column("tname"), length("target"), pa.array(texts, pa.string()), pa.array(matches, pa.int64()), pa.array(blocks, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["qname", "qlen", "tname", "tlen", "cigar", "matches", "block"])

    texts = rows.select("qname", "tname", *(F.coalesce(c, F.lit("")).alias(c) for c in ("query", "target", "cigar")))
    found = texts.mapInArrow(run, "qname string, qlen long, tname string, tlen long, cigar string, matches long, block long")
    zero = F.lit(0).cast("bigint")
    return found.select(
        "qname", "qlen", zero.alias("qs"), F.col("qlen").alias("qe"), F.lit("+").alias("strand"), "tname", "tlen", zero.alias("ts"), F.col("tlen").alias("te"), "matches", "block", F.lit(255).cast("bigint").alias("mapq"),
        F.create_map(F.lit("cg:Z"), F.col("cigar")).alias("tags"),
    )
