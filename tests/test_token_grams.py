"""Unique token substrings against a plain version, and how their counts are made."""

from __future__ import annotations

from collections import Counter
from random import Random

from tessera.operators import tokens


def _stream(spark):
    rows, dice = [], Random(3)
    for k in range(12):
        row = []
        for i in range(9):
            row.append(("A:" if i % 2 == 0 else "D:") + dice.choice("xy" if i % 2 else "uvw"))
        row = row if k % 4 else row[::-1]
        rows += [(f"s{k % 2}", k, i, x[0], x) for i, x in enumerate(row)]
    return rows, spark.createDataFrame(rows, "sample string, sequence_id long, token_index long, token_type string, token string")


def test_minimal_unique_is_that_of_a_scan(spark):
    rows, frame = _stream(spark)
    of: dict[tuple, list[str]] = {}
    for sample, sequence, _, _, token in rows:
        of.setdefault((sample, sequence), []).append(token)
    key = lambda gram: ",".join(min(list(gram), list(gram)[::-1]))
    held = lambda gram: any(x.startswith("A:") for x in gram)
    grams = [(sample, sequence, i, n, row[i : i + n]) for (sample, sequence), row in of.items() for n in range(1, tokens.MOST + 1) for i in range(len(row) - n + 1) if held(row[i : i + n])]
    counts = Counter((sample, key(gram)) for sample, _, _, _, gram in grams)
    once = lambda sample, gram: counts[sample, key(gram)] == 1
    want = {(sample, key(gram), n, sequence, i) for sample, sequence, i, n, gram in grams if once(sample, gram) and not once(sample, gram[1:]) and not once(sample, gram[:-1])}
    got = [tuple(r) for r in tokens.minimal_unique(tokens.token_ngrams(frame)).collect()]
    assert want and len(got) == len(want) and set(got) == want


def test_unique_grams_are_counted_without_a_sort(spark, capsys):
    tokens.unique_grams(tokens.token_ngrams(_stream(spark)[1])).explain()
    plan = capsys.readouterr().out
    assert "HashAggregate" in plan and "SortAggregate" not in plan
