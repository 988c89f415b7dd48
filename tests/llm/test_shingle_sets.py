"""The pipeline's near-duplicate stage against all pairs."""

import numpy as np

from tessera.llm import shingle_sets, simhash
from tests.llm.test_text_operators import ROWS, docs


def set_by_hand(text):
    words = (text or "").lower().encode().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def groups_by_hand(rows):
    """Smallest id of each row's group, over all pairs."""
    sets = [set_by_hand(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            union = len(sets[i] | sets[j])
            if 5 * len(sets[i] & sets[j]) >= 4 * union and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = {}
    for (i, _), x in zip(rows, label):
        least[x] = min(i, least.get(x, i))
    return {(i, least[x]) for (i, _), x in zip(rows, label)}


def near_rows():
    """Texts with copies edited so that the five-word likeness lies on both sides of 0.8, a dense group, and a common line."""
    rng = np.random.default_rng(12)
    vocabulary = [f"w{k}" for k in range(3000)]
    rows = []
    for k in range(40):
        words = list(rng.choice(vocabulary, rng.integers(30, 200)))
        rows.append((1000 + k, " ".join(words)))
        for c in range(2):
            edited = list(words)
            for at in rng.choice(len(edited), rng.integers(1, max(2, len(edited) // 25)), replace=False):
                edited[at] = f"new{k}x{c}x{at}"
            rows.append((int(rng.integers(2000, 9000)) * 100 + 2 * k + c, " ".join(edited)))
    base = list(rng.choice(vocabulary, 150))
    for k in range(60):
        edited = list(base)
        edited[int(rng.integers(150))] = f"dense{k}"
        rows.append((5000 + k, " ".join(edited)))
    common = "this very common line stands in each of these texts and nothing else does "
    return rows + [(6000 + k, common * 2 + " ".join(rng.choice(vocabulary, 4))) for k in range(30)]


def test_groups_against_all_pairs(spark):
    rows = near_rows()
    got = {(r.doc_id, r.component_id) for r in shingle_sets.near_duplicates(docs(spark, rows)).collect()}
    assert got == groups_by_hand(rows)
    assert len(rows) > len({c for _, c in got}) > 20


def test_pipeline_drops_all_near_copies(spark):
    import corpus_pipeline

    rows = near_rows()
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, frame, "").collect()}
    assert kept == {c for _, c in groups_by_hand(rows)}


def test_odd_rows(spark):
    rows = [r for r in ROWS if r[0] is not None]
    kept = [r.doc_id for r in shingle_sets.keep_one(docs(spark, ROWS)).collect()]
    assert sorted(x for x in kept if x is not None) == sorted({c for _, c in groups_by_hand(rows)}) and kept.count(None) == 2
    assert shingle_sets.keep_one(docs(spark, [])).count() == 0


def none_meet(batches):
    """In place of the meeting by shingles."""
    for batch in batches:
        yield from ()


def test_the_ring_alone_finds_the_nearest_copies(spark, monkeypatch):
    rng = np.random.default_rng(4)
    words = list(rng.choice([f"w{k}" for k in range(3000)], 900))
    rows = [(1, " ".join(words)), (2, " ".join([*words[:-1], "other"])), (3, " ".join(["first", *words[1:]])), (4, " ".join(rng.choice(words, 900)))]
    monkeypatch.setattr(shingle_sets, "_meeting", none_meet)
    assert {(r.doc_id, r.component_id) for r in shingle_sets.near_duplicates(docs(spark, rows)).collect()} == groups_by_hand(rows) == {(1, 1), (2, 1), (3, 1), (4, 4)}


def test_ring_links_connect_what_all_pairs_do(spark):
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    words = [int(b) for b in base] + [int(b) ^ sum(1 << int(k) for k in set(rng.integers(0, 64, n))) for b in base for n in (1, 3, 4, 5, 6)]
    words = sorted(set(words) | {int(base[0]) ^ (1 << i) ^ (1 << j) for i in range(30) for j in range(i, 30)})  # one long run
    a = np.array(words, dtype=np.uint64)
    near = np.argwhere(np.triu(np.bitwise_count(a[:, None] ^ a[None, :]) <= 4, 1))
    want = simhash.components(len(a), near[:, 0], near[:, 1])
    signed = a.view(np.int64).tolist()
    at = {x: k for k, x in enumerate(signed)}
    got = [(at[r.u], at[r.v]) for r in simhash.ring_links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()]
    assert (simhash.components(len(a), *np.array(got).T) == want).all() and len(set(want.tolist())) < len(a)


def dense_rows(n):
    """Copies of one text with up to eight words changed each, in groups over SMALL_RUN at a shingle: likenesses lie on both sides of 0.8."""
    rng = np.random.default_rng(0)
    base = [f"w{k}" for k in rng.choice(3000, 150)]
    rows = []
    for k in range(n):
        edited = list(base)
        for at in rng.choice(150, rng.integers(1, 8), replace=False):
            edited[at] = f"dense{k}x{at}"
        rows.append((k, " ".join(edited)))
    return rows


def test_large_groups_have_all_their_links(spark, monkeypatch):
    rows = dense_rows(500)
    want = groups_by_hand(rows)
    assert 1 < len({c for _, c in want}) < len(rows)
    assert {(r.doc_id, r.component_id) for r in shingle_sets.near_duplicates(docs(spark, rows)).collect()} == want
    monkeypatch.setattr(shingle_sets, "BLOCK", 100)
    assert {(r.doc_id, r.component_id) for r in shingle_sets.near_duplicates(docs(spark, rows)).collect()} == want


def test_signatures_rule_out_nothing_alike():
    rng = np.random.default_rng(1)
    sets = [rng.integers(-(1 << 62), 1 << 62, int(n)) for n in (1, 5, 60, 64, 255, 300)]
    for own in sets:
        for lost in range(len(own) // 5 + 1):
            other = own[lost:]
            alike = 9 * len(other) >= 4 * (len(own) + len(other))
            for far in ([False, True], [False, False]):
                i, _ = shingle_sets.signed_pairs([shingle_sets.signature(own), shingle_sets.signature(other)], np.array([len(own), len(other)]), np.array(far))
                assert len(i) or not alike
