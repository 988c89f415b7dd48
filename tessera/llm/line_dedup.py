"""Removal of multi-line passages that other documents have already, by content-defined chunks of lines.

Native: DataFrame functions only.  A rolling hash runs over the hashes of each line and the line before
it.  Where it starts and stops being one that an earlier document has, a chunk begins and ends; so
chunks depend on nothing but the lines inside them, whatever stands around, and a passage of two
lines is one already.  (Boundaries where the hash is 0 modulo a divisor need lines around the passage:
they left six in seven repeated passages of two to six lines in place.)  What leaves the scan for counting
is hashes; only texts of repeated hashes are moved, once each a task, and compared byte by byte.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import join_by_count
from tessera.operators.lineage import checkpointed

#: Multipliers and moduli of the two halves of the rolling hash.
ROLL = (8191, 131071)
MODULUS = 2147483647
#: Words of the bitmap that tells which documents are joined (8 bytes each, a power of two), and SQL of a document's word and bit in it.
WORDS = 1 << 19
WORD, BIT = f"pmod(xxhash64(__id, __t), {WORDS}L)", f"cast(pmod(shiftright(xxhash64(__id, __t), 40), 64L) as int)"
#: A line of more words than this is a chunk by itself, like the lines that it could be wrapped to.
LONG_LINE = 50


def _half(h: str, k: int) -> str:
    return f"pmod({h if k == 0 else f'shiftright({h}, 29)'}, {MODULUS})"


def rolled(before: str, own: str) -> str:
    """SQL of the rolling hash over two lines' 64-bit hashes: two halves, each first * ROLL + second modulo MODULUS."""
    high, low = (f"pmod({_half(before, k)} * {ROLL[k]}L + {_half(own, k)}, {MODULUS})" for k in (0, 1))
    return f"(shiftleft({high}, 32) + {low})"


def line_units(text: str) -> str:
    """SQL of a text's lines, blank ones joined to the line before them; only the first may be blank."""
    return f"split(coalesce({text}, ''), '\\\\n(?= *[^ \\\\n])', -1)"


def core(unit: str) -> str:
    """SQL of a unit without the blank lines at its end."""
    return f"substring_index({unit}, '\\n', 1)"


def windows(units: str) -> str:
    """SQL of an array of (at, h): 2k for the rolling hash over units k and k+1, 2k+1 for unit k alone if it is long.  The first unit counts if it isn't blank."""
    named = f"transform({units}, (x, k) -> named_struct('k', cast(k as bigint), 'solid', trim(both ' \\n' from x) <> '', 'long', length(x) > {2 * LONG_LINE} and length(x) - length(replace(x, ' ', '')) >= {LONG_LINE} and size(filter(split({core('x')}, ' '), w -> w <> '')) > {LONG_LINE}, 'whole', xxhash64(x), 'core', xxhash64({core('x')})))"
    return (
        f"transform(array({named}), u -> concat(filter(zip_with(slice(u, 1, greatest(size(u) - 1, 0)), slice(u, 2, greatest(size(u) - 1, 0)), (a, b) -> if(a.solid, named_struct('at', 2 * a.k, 'h', {rolled('a.whole', 'b.core')}), null)), w -> w is not null), "
        f"transform(filter(u, x -> x.long), x -> named_struct('at', 2 * x.k + 1, 'h', {rolled('0L', 'x.core')}))))[0]"
    )


def window_text(units: str, at: str) -> str:
    """SQL of the text of the window ``at``."""
    k = f"cast({at} div 2 as int)"
    return f"if({at} % 2 = 0, concat({units}[{k}], '\\n', {core(f'{units}[{k} + 1]')}), {core(f'{units}[{k}]')})"


def marks(keys: DataFrame) -> DataFrame:
    """(__word, __mask): a bitmap of the rows (__id, __t), at most WORDS rows of 64 bits whatever their number."""
    return keys.select(F.expr(WORD).alias("__word"), F.expr(f"shiftleft(1L, {BIT})").alias("__bits")).groupBy("__word").agg(F.bit_or("__bits").alias("__mask"))


def marked(rows: DataFrame, bitmap: DataFrame) -> DataFrame:
    """``rows`` with ``__marked``: false only where (__id, __t) isn't among the keys of the bitmap.

    So rows that nothing is joined to stay where they were read.  With many more keys than bits more
    rows are marked than need be; the join that follows decides, and results don't change.
    """
    found = rows.withColumn("__word", F.expr(WORD)).join(F.broadcast(bitmap), "__word", "left")
    return found.withColumn("__marked", F.expr(f"coalesce(getbit(__mask, {BIT}) = 1, false)")).drop("__word", "__mask")


def repeated_windows(slim: DataFrame) -> DataFrame:
    """(__id, __t, at, lost) of windows of (__id, __t, __text) that an earlier document has; ``lost`` is null, or the window's text if others have its hash.

    ``__t`` is the text's hash, which tells apart texts of rows that share an id.
    """
    # Four numbers a window, written once: hashing all lines costs more than reading them again.
    w = checkpointed(slim.select("__id", "__t", F.expr(windows(line_units("__text"))).alias("w")).select("__id", "__t", F.explode("w").alias("w")).select("__id", "__t", F.col("w.at").alias("at"), F.col("w.h").alias("h")))
    shared = checkpointed(w.groupBy("h").agg(F.min("__id").alias("first_id"), F.max("__id").alias("last_id"), F.count("*").alias("n")).where("first_id < last_id").select("h", "n"))
    found = checkpointed(join_by_count(w, shared, "h"))
    wanted = found.groupBy("__id", "__t").agg(F.collect_set(F.struct("at", "h")).alias("__w"))
    units = marked(slim, marks(found)).where("__marked").join(wanted, ["__id", "__t"]).select("__id", F.expr(line_units("__text")).alias("u"), "__w")
    texts = units.select("__id", F.explode(F.expr(f"transform(__w, x -> named_struct('h', x.h, 'text', if(size(u) = 0, '', {window_text('u', 'x.at')})))")).alias("x"))
    # One row a task and hash goes into the shuffle.  Texts of one hash are equal if the least and the greatest are,
    # byte by byte; only if some hash has several is each text told from the others by itself.
    ends = [F.min("__id").alias("first_id"), F.max("__id").alias("last_id"), F.count("*").alias("n")]
    by_hash = checkpointed(texts.groupBy(F.col("x.h").alias("h")).agg(*ends, (F.min("x.text") != F.max("x.text")).alias("several")))
    proven = by_hash.where("not several and first_id < last_id").select("h", "n", F.expr("array(named_struct('lost', cast(null as string), 'first_id', first_id))").alias("x"))
    if not by_hash.where("several").isEmpty():
        mixed = texts.select("__id", "x").join(by_hash.where("several").select("h"), F.col("x.h") == F.col("h"))
        told = mixed.groupBy("h", F.col("x.text").alias("text")).agg(*ends).where("first_id < last_id")
        proven = proven.unionByName(told.groupBy("h").agg(F.sum("n").alias("n"), F.collect_list(F.struct(F.col("text").alias("lost"), "first_id")).alias("x")))
    joined = join_by_count(found, checkpointed(proven), "h").select("__id", "__t", "at", F.explode("x").alias("x"))
    return joined.where("__id > x.first_id").select("__id", "__t", "at", F.col("x.lost").alias("lost"))


def dedup_lines(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with repeated passages taken out of the text, and counts of what went.

    Two consecutive lines that are not blank, with the blank lines between them, and a line of over
    LONG_LINE words stay in the document with the smallest id that has them and go from all others,
    each with the blank lines after it.  Overlapping ones make one chunk.  Rows that share an id count
    as one document; rows without an id neither claim nor lose lines.  Null texts come back as empty,
    empty and very long texts work alike, and an empty table gives no rows.  Adds n_lines,
    removed_lines and removed_chunks; other columns are kept.
    """
    slim = docs.where(F.col(id_column).isNotNull()).select(F.col(id_column).alias("__id"), F.xxhash64(F.coalesce(F.col(text_column), F.lit(""))).alias("__t"), F.col(text_column).alias("__text"))
    gone = checkpointed(repeated_windows(slim).select("__id", "__t", "at", "lost"))
    lost = gone.groupBy("__id", "__t").agg(F.collect_set(F.struct("at", "lost")).alias("__lost"))
    keyed = marked(docs.withColumn("__id", F.col(id_column)).withColumn("__t", F.xxhash64(F.coalesce(F.col(text_column), F.lit("")))), marks(gone))
    whole = keyed.where("not __marked").withColumn("__lost", F.lit(None).cast(lost.schema["__lost"].dataType))
    joined = keyed.where("__marked").join(lost, ["__id", "__t"], "left").unionByName(whole).drop("__id", "__t", "__marked")
    cut = joined.withColumn("__units", F.expr(line_units(f"`{text_column}`")))
    # size(...) names the column twice, so that the optimizer does not compute it again for each element.
    sure = f"filter(__lost, x -> x.lost is null or (size(__units) > 0 and x.lost = {window_text('__units', 'x.at')}))"
    cut = cut.withColumn("__gone", F.expr(f"if(__lost is null, cast(array() as array<bigint>), array_sort(array_distinct(flatten(transform({sure}, x -> if(x.at % 2 = 0, array(x.at div 2, x.at div 2 + 1), array(x.at div 2)))))))"))
    cut = cut.withColumn("__kept", F.expr("if(size(__gone) = 0, __units, transform(array_except(sequence(0L, size(__units) - 1L), __gone), k -> if(size(__units) = 0, '', __units[cast(k as int)])))"))
    lines = "size(split({}, '\\n', -1))"
    return (
        cut.withColumn("n_lines", F.expr(lines.format(f"coalesce(`{text_column}`, '')")))
        .withColumn(text_column, F.expr("array_join(__kept, '\\n')"))
        .withColumn("removed_lines", F.expr(f"n_lines - if(size(__kept) = 0, 0, {lines.format(f'`{text_column}`')})"))
        .withColumn("removed_chunks", F.expr("size(filter(zip_with(__gone, concat(array(-9L), slice(__gone, 1, greatest(size(__gone) - 1, 0))), (own, before) -> own <> before + 1), x -> x))"))
        .drop("__units", "__gone", "__kept", "__lost")
    )


def oracle() -> str:
    """DuckDB SQL for the columns that the query returns."""
    return f"""
with lines as (select doc_id, x.pos as pos, x.line as line, trim(x.line, ' ') = '' as blank from (
    select doc_id, unnest(list_transform(list_zip(l, range(1, len(l) + 1)), lambda z: {{'line': z[1], 'pos': z[2]}})) as x
    from (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents))),
units as (select doc_id, u, string_agg(line, chr(10) order by pos) as unit, first(line order by pos) as head, count(*) as n, bool_or(not blank) as solid
  from (select *, sum(case when blank or pos = 1 then 0 else 1 end) over (partition by doc_id order by pos) as u from lines) group by doc_id, u),
pairs as (select doc_id, u, unit || chr(10) || lead(head) over (partition by doc_id order by u) as text, solid, lead(u) over (partition by doc_id order by u) is not null as more from units),
windows as (select doc_id, u, u + 1 as v, text from pairs where solid and more
  union all select doc_id, u, u, head from units where solid and len(list_filter(string_split(head, ' '), lambda w: w <> '')) > {LONG_LINE}),
firsts as (select text, min(doc_id) as first_id from windows group by text having min(doc_id) < max(doc_id)),
lost as (select distinct doc_id, unnest([u, v]) as u from windows join firsts using (text) where doc_id > first_id),
marked as (select x.*, l.u is not null as gone, l.u - 1 is distinct from lag(l.u) over (partition by x.doc_id order by x.u) and l.u is not null as begins from units x left join lost l on x.doc_id = l.doc_id and x.u = l.u)
select doc_id, coalesce(string_agg(unit, chr(10) order by u) filter (where not gone), '') as text, sum(n)::int as n_lines, coalesce(sum(n) filter (where gone), 0)::int as removed_lines,
  (count(*) filter (where begins))::int as removed_chunks
from marked group by doc_id"""
