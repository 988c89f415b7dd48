"""Calls with the truth near them, made once for each place."""

from tessera.operators import records


def test_crowded_places_are_answered_once(spark):
    kind = "event_id long, chrom string, pos long"
    calls = [(k, f"chr{k % 2}", 100 + k % 3) for k in range(90)] + [(900, "chr0", 5000), (901, None, 100), (902, "chr0", None)]
    truth = [(1000 + k, f"chr{k % 2}", 60 + k % 90) for k in range(300)]
    left, right = spark.createDataFrame(calls, kind), spark.createDataFrame(truth, kind)
    places = records.near_places(left, right, 40)
    assert places.count() == 6
    got = {r.event_id: (r.near, r.nearest, r.ids) for r in records.nearby(left, right, 40).collect()}
    assert len(got) == len(calls)
    for event, chrom, pos in calls:
        near = [(abs(p - pos), e) for e, c, p in truth if c == chrom and chrom and pos is not None and abs(p - pos) <= 40]
        assert got[event] == (len(near), min((x for x, _ in near), default=None), ",".join(str(e) for _, e in sorted(near, key=lambda x: x[1])))
