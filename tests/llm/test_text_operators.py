"""Line dedup, packing, SimHash, pieces and fingerprints against brute force."""

import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import line_dedup, packing, phrases, piece_codec, simhash
from tessera.llm.queries import tokenizer_path
from tessera.operators.components import connected_components

SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("piece", T.StringType()), T.StructField("h", T.StringType())]
)


def docs(spark, rows):
    """Rows (doc_id, text), with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, None, None, None, "x", "y") for i, t in rows], SCHEMA)


ROWS = [
    (1, "one two three four five six seven\nalpha beta\ngamma delta\nepsilon zeta\neta theta"),
    (2, "another start\nalpha beta\ngamma delta\nepsilon zeta\neta theta"),
    (2, "another start\nalpha beta\ngamma delta\nepsilon zeta\neta theta"),
    (3, ""), (4, None), (None, "no id at all"), (None, None), (5, "word " * 3000), (6, "a  b   c "), (7, "One Two Three four FIVE six seven\nalpha beta\ngamma delta\nepsilon zeta\neta theta"),
    (8, "日本語 テキスト\n\n\n"), (9, "x" * 5000),
]


def windows_by_hand(text):
    """(text, its line numbers) of every two consecutive lines that are not blank, and of every line of over 50 words."""
    lines = (text or "").split("\n")
    solid = [k for k, x in enumerate(lines) if x.strip(" ")]
    out = [("\n".join(lines[a : b + 1]), range(a, b + 1)) for a, b in zip(solid, solid[1:])]
    return out + [(lines[k], range(k, k + 1)) for k in solid if len(lines[k].split(" ")) - lines[k].split(" ").count("") > line_dedup.LONG_LINE]


def deduped_by_hand(rows):
    """(id, text that stays) of rows (id, text)."""
    first, out = {}, []
    for i, t in rows:
        if i is not None:
            for text, _ in windows_by_hand(t):
                first[text] = min(first.get(text, i), i)
    for i, t in rows:
        lines = (t or "").split("\n")
        gone = {k for text, own in windows_by_hand(t) if i is not None and first[text] < i for k in own}
        for k in range(1, len(lines)):  # blank lines after a line that goes
            if k - 1 in gone and not lines[k].strip(" "):
                gone.add(k)
        out.append((i, "\n".join(x for k, x in enumerate(lines) if k not in gone)))
    return out


def test_line_dedup_against_brute_force(spark):
    rng = np.random.default_rng(3)
    lines = [f"line {k} of many" for k in range(40)] + ["", "  "]
    rows = ROWS + [(100 + k, "\n".join(lines[j] for s in rng.integers(0, 36, 4) for j in range(s, s + 6))) for k in range(30)]
    rows += [(200, "\n\nx\n\n \ny\n\n"), (201, "a\nx\n\n \ny\n\nz"), (202, "x\n\n\ny"), (203, "\tq\n\t\nw"), (204, "\tq\n\t\nw")]
    got = line_dedup.dedup_lines(docs(spark, rows))
    assert set(got.columns) >= {"piece", "h", "lang", "n_lines", "removed_lines"}
    found = got.collect()
    assert sorted(((r.doc_id, r.text) for r in found), key=str) == sorted(deduped_by_hand(rows), key=str)
    assert any(r.removed_lines for r in found) and all(r.n_lines - r.removed_lines == (len(r.text.split("\n")) if r.text or not r.removed_lines else 0) for r in found)
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0


def test_planted_passages_are_found_wherever_they_stand(spark):
    rng = np.random.default_rng(11)
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, 7))
    line = lambda n: " ".join(word() for _ in range(n))
    passages = [[line(60 // n + 1) for _ in range(n)] for n in (1, 2, 2, 3, 4, 5, 6)]
    rows = []
    for k in range(140):
        own = [line(int(rng.integers(3, 12))) for _ in range(rng.integers(0, 9))]
        at = int(rng.integers(0, len(own) + 1))
        rows.append((k, "\n".join(own[:at] + passages[k % 7] + own[at:])))
    kept = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs(spark, rows)).collect()}
    for k, text in rows:
        lost = [x for x in text.split("\n") if x not in kept[k].split("\n")]
        assert lost == (passages[k % 7] if k >= 7 else [])


def test_equal_hashes_of_different_texts(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "rolled", lambda before, own: f"pmod({own}, 2)")  # almost all windows collide
    rows = [(k, "\n".join(f"line {x}" for x in (k % 5, k % 5 + 1, 77 + k))) for k in range(20)]
    got = line_dedup.dedup_lines(docs(spark, rows)).collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted(deduped_by_hand(rows))


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    path, capacity = tokenizer_path("byte_bpe_50k.json"), 64
    reference = Tokenizer.from_file(path)
    rows = packing.pack_documents(docs(spark, ROWS), path, capacity=capacity, keep_ids=True).collect()
    pieces, sequences = {}, {}
    for r in rows:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        pieces.setdefault(r.doc_id, []).append((r.start, r.piece, bytes(r.ids)))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, t in ROWS:
        if i in (2, None):
            continue  # rows that share an id
        own = sorted(pieces[i])
        ids = reference.encode(t or "", add_special_tokens=False).ids + [0]
        assert np.frombuffer(b"".join(x for _, _, x in own), dtype="<u4").tolist() == ids
        assert all(len(x) == 4 * capacity for _, _, x in own[1:]) and [p for _, p, _ in own] == list(range(len(own)))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    assert packing.pack_documents(docs(spark, []), path).count() == 0


def test_token_ids_on_mixed_white_space():
    from tokenizers import Tokenizer

    path, rng = tokenizer_path("byte_bpe_50k.json"), np.random.default_rng(12)
    reference, own = Tokenizer.from_file(path), packing.WordCachedTokenizer(path)
    parts = [" ", " ", " ", "\n", "\t", "\r\n", "\u00a0", "\u3000", "\u2003", "\x1c", "\x85", "a", "The", "Thé", "'s", "'", "’ll", "12", "日本", "!?", "🙂", "<|endoftext|>", "<|", "\u0301", "ß"]
    texts = ["".join(parts[k] for k in rng.integers(0, len(parts), n)) for n in rng.integers(1, 12, 30_000)]
    want = reference.encode_batch(texts, add_special_tokens=False)
    assert [t for t, w in zip(texts, want) if np.frombuffer(own.encode(t), dtype="<u4").tolist() != w.ids] == []
    for text in (" " * 1_000_000, "\t" * 1_000_000, "a" * 1_000_000, "7" * 1_000_000, "x" + " " * 300_000 + "y z", "\n \u00a0" * 200_000):
        assert np.frombuffer(own.encode(text), dtype="<u4").tolist() == reference.encode(text, add_special_tokens=False).ids


def test_best_fit_decreasing_against_linear_search():
    rng = np.random.default_rng(1)
    for capacity in (7, 64, 100):
        lengths = rng.integers(1, capacity + 1, 300)
        room, places = [], {}
        for k in sorted(range(300), key=lambda k: -lengths[k]):
            fits = [b for b in range(len(room)) if room[b] >= lengths[k]]
            b = min(fits, key=lambda b: room[b]) if fits else len(room)
            if not fits:
                room.append(capacity)
            places[k] = b
            room[b] -= lengths[k]
        bins, offsets = packing.best_fit_decreasing(lengths, capacity)
        assert bins.max() + 1 == len(room)
        assert all(np.bincount(bins, weights=lengths) <= capacity)
        assert all((offsets + lengths) <= capacity)


def simhash_by_hand(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_classes_against_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(300)]
    base = [" ".join(rng.choice(words, 120)) for _ in range(12)]
    rows = list(ROWS)
    for k in range(150):
        text = base[k % 12].split()
        for at in rng.integers(0, 120, rng.integers(0, 3)):
            text[at] = rng.choice(words)
        rows.append((1000 + k, " ".join(text)))
    got = simhash.near_duplicates(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    prints = {}
    for i, t in rows:
        prints.setdefault(simhash_by_hand(t), []).append(i)
    assert {(r.doc_id, r.fp & (2**64 - 1)) for r in got} == {(i, f) for f, ids in prints.items() for i in ids}
    fps = sorted(prints)
    label = {f: f for f in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if (a ^ b).bit_count() <= 4 and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    smallest = {}
    for f, ids in prints.items():
        known = [i for i in ids if i is not None]
        smallest[label[f]] = min([*known, *([smallest[label[f]]] if smallest.get(label[f]) is not None else [])], default=None)
    assert {(r.fp & (2**64 - 1), r.component_id) for r in got} == {(f, smallest[label[f]]) for f in fps}
    assert simhash.near_duplicates(docs(spark, [])).count() == 0
    # The tasks' edges when every key of two fingerprints counts as a long run.
    keys = spark.createDataFrame([(f - (f >> 63 << 64),) for f in fps], "fp long").selectExpr("fp").select(F.explode(simhash.chain_keys("fp")).alias("key"), "fp").orderBy("key").toArrow()
    ends = []
    for run in (simhash.SMALL_RUN, 1):
        monkeypatch.setattr(simhash, "SMALL_RUN", run)
        same = {f - (f >> 63 << 64): f - (f >> 63 << 64) for f in fps}
        for batch in simhash._links(4)(iter(keys.to_batches(500))):
            for u, v in zip(*(c.to_pylist() for c in batch.columns)):
                old, new = max(same[u], same[v]), min(same[u], same[v])
                same = {k: new if x == old else x for k, x in same.items()}
        ends.append(same)
    assert ends[0] == ends[1] and len(set(ends[0].values())) == len(set(label.values()))
    kept = [r.doc_id for r in simhash.keep_one(docs(spark, rows)).collect() if r.doc_id is not None]
    assert sorted(kept) == sorted(i for i in {v for v in smallest.values() if v is not None})


def test_long_runs_give_the_same_components():
    rng = np.random.default_rng(2)
    low = np.uint64((1 << 26) - 1)  # one key of segment 0: the first two segments stay as they are, but for one bit
    centre = rng.integers(0, 2**63, 3, dtype=np.uint64) & ~low
    words = np.unique(np.array([c ^ np.uint64(sum(1 << int(b) for b in rng.choice([13, *range(26, 64)], rng.integers(0, 5)))) for c in centre for _ in range(120)], dtype=np.uint64))
    near = np.triu(simhash.linked(words[:, None], words[None, :], 0, 4), 1)
    i, j = np.nonzero(near)
    assert np.any(np.bitwise_count(words[:, None] ^ words[None, :]) <= 4) and len(i)
    a, b = simhash.run_edges(words, 0, 4)
    assert np.array_equal(simhash.components(len(words), i, j), simhash.components(len(words), a, b))


def test_stars_on_a_long_path(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100}


@pytest.fixture(scope="module")
def pieces():
    return piece_codec.PieceModel(tokenizer_path("piece_bpe_32k.model"))


def viterbi_by_hand(m, text):
    best, back = [0.0] + [None] * len(text), {}
    for end in range(1, len(text) + 1):
        for begin in range(max(0, end - m.longest), end):
            found = m.ids.get(text[begin:end])
            if found and (best[end] is None or best[begin] + found[1] > best[end]):
                best[end], back[end] = best[begin] + found[1], (begin, [found[0]])
        if text[end - 1] not in m.ids and (best[end] is None or best[end - 1] + m.unknown_score > best[end]):
            best[end], back[end] = best[end - 1] + m.unknown_score, (end - 1, m.fallback(text[end - 1]))
    out, end = [], len(text)
    while end:
        end, ids = back[end]
        out = [*ids, *out]
    return out


def test_streaming_viterbi(pieces, spark):
    rng = np.random.default_rng(4)
    letters = list("abcdeth ns. ▁\nqué日🙂")
    texts = ["", "hello world", "  two  spaces ", "日本 🙂 é", "a" * 100, "the then there\nthese\n\nthose", " lead", "a ▁ mark▁", "▁", "tail\n", "\n\n x"]
    texts += ["".join(letters[k] for k in rng.integers(0, len(letters), n)) for n in rng.integers(1, 200, 150)]
    for text in texts:
        ids = pieces.encode(text)
        assert np.frombuffer(ids, dtype="<u4").tolist() == (viterbi_by_hand(pieces, " " + text) if text else [])
        assert pieces.decode(ids) == text
        assert [x for piece in pieces.stream(" " + text) for x in piece] == viterbi_by_hand(pieces, " " + text)
    path = tokenizer_path("piece_bpe_32k.model")
    got = piece_codec.round_trip(docs(spark, ROWS), path).collect()
    assert len(got) == len(ROWS) and all(r.exact for r in got)
    back = piece_codec.decode(piece_codec.encode(docs(spark, ROWS), path), path).collect()
    assert sorted((r.doc_id or 0, r.text) for r in back) == sorted((i or 0, t or "") for i, t in ROWS)
    assert piece_codec.round_trip(docs(spark, []), path).count() == 0


def test_ids_are_committed_where_paths_meet(pieces):
    read = 0

    def chars():
        nonlocal read
        for char in " the cat sat on the mat and" * 50:
            read += 1
            yield char

    sent = most = 0
    for piece in pieces.stream(chars()):
        sent += sum(len(pieces.pieces[k]) for k in piece)
        most = max(most, read - sent)
    assert most <= 2 * pieces.longest  # never the whole text


def test_long_words_take_linear_time(pieces):
    import time

    word = "".join(chr(97 + k % 26) for k in range(1_000_000))
    begin = time.process_time()
    ids = pieces.encode(word[:100_000])
    small = time.process_time() - begin
    begin = time.process_time()
    assert pieces.decode(pieces.encode(word)) == word and pieces.decode(ids) == word[:100_000]
    assert time.process_time() - begin < 40 * small + 5


def test_fingerprints_and_edits(spark):
    rows = [*ROWS, (50, "The quick brown fox jumps over the lazy dog. " * 30), (51, "The quick brown fox jumps over the lazy dog. " * 30), (52, "Entirely other words stand here, nothing is shared at all. " * 20)]
    got = {}
    for r in phrases.with_edited(docs(spark, rows), rows_per_part=4).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    import hashlib

    place = lambda r: (-(1 << 63) if r[0] is None else r[0], int(np.uint64(xxhash.xxh64_intdigest((r[1] or "").encode(), 42)).astype(np.int64)))
    order, want = sorted(rows, key=place), []
    for (i, t), (_, following) in zip(order, order[1:] + order[:1]):
        text = t or ""
        cut = len(text) // 4
        edited = text[: len(text) - cut] + (following or "")[:cut]
        s, e, n = (phrases.signatures([x.encode()]) for x in (text, edited, following or ""))
        want.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), phrases.shown(s)[0], phrases.shown(e)[0], float(phrases.likeness(s, e)[0]), float(phrases.likeness(s, n)[0])))
    assert sorted((tuple(r) for own in got.values() for r in own), key=str) == sorted(want, key=str)
    assert got[50][0].fingerprint == got[51][0].fingerprint and got[50][0].near_next == 1.0
    assert got[51][0].near_next < 0.2 < got[51][0].near_edited
    assert got[3][0].near_edited == 1.0 and set(got[3][0].fingerprint) == {"-"}
    assert phrases.with_edited(docs(spark, [])).count() == 0
    assert len(phrases.fingerprints(docs(spark, rows)).collect()) == len(rows)


def names_by_hand(text):
    """Each level's phrase names of one text, symbol by symbol."""
    from tessera.llm import common

    def toss(labels):
        out = [0]
        for before, own in zip(labels, labels[1:]):
            low = ((before ^ own) & -(before ^ own)).bit_length() - 1
            out.append(0 if before == own else 1 + 2 * low + (own >> low & 1))
        return out

    symbols, levels = list(text), []
    for level in range(phrases.LEVELS if text else 0):
        labels = symbols
        for _ in range(3 if level == 0 else 4):
            labels = toss(labels)
        ends = [k + 1 for k in range(len(labels)) if k == len(labels) - 1 or 0 < k and labels[k - 1] < labels[k] >= labels[k + 1]]
        plain = [sum((x + 1) * pow(common._BASE, j, 1 << 64) for j, x in enumerate(symbols[b:e])) % (1 << 64) for b, e in zip([0, *ends], ends)]
        symbols = common.mix64(np.array(plain, dtype=np.uint64)).tolist()
        levels.append(symbols)
    return levels


def test_names_and_fingerprints_against_a_slow_version():
    from tessera.llm.common import mix64

    rng = np.random.default_rng(2)
    texts = [b"", b"a", b"aaaa", b"abab" * 40, "é日 🙂".encode() * 9, bytes(rng.integers(97, 123, 900, dtype=np.uint8)), b"one two three four " * 30]
    found = {k: [] for k in range(len(texts))}
    for _, owner, names in phrases.text_names(texts):
        for k in found:
            if len(texts[k]):
                found[k].append(names[owner == k].tolist())
    assert [found[k] for k in found] == [names_by_hand(t) for t in texts]
    got = phrases.signatures(texts)
    for k, text in enumerate(texts):
        bins = {}
        for level, names in enumerate(names_by_hand(text), 1):
            for h in mix64(np.array(names, dtype=np.uint64) + np.uint64(level)).tolist():
                bins.setdefault(h >> 58, []).append((max(3 - level, 0), h & (1 << 56) - 1))
        want = [-1] * 64
        for b, hashes in bins.items():
            first, h = min(hashes)
            want[b] = int(mix64(np.array([h | first << 56], dtype=np.uint64))[0]) & 0xFFFF
        assert got[k].tolist() == want
    long = [bytes(rng.integers(97, 123, 3_000_000, dtype=np.uint8)) for _ in range(2)]
    assert phrases.likeness(*[phrases.signatures([x]) for x in long])[0] < 0.02  # unrelated, however long


def test_equal_substrings_share_interior_phrases():
    rng = np.random.default_rng(8)
    middle = bytes(rng.integers(97, 123, 2000, dtype=np.uint8))
    names = {}
    for key, text in (("a", b"some head" + middle + b"tail"), ("b", b"quite another beginning, longer " + middle + b"!")):
        names[key] = [set(n.tolist()) for _, _, n in phrases.text_names([text])]
    for a, b in zip(names["a"][:4], names["b"][:4]):
        assert len(a & b) > 0.7 * min(len(a), len(b))


def test_line_dedup_bitmap_marks_all_keys(spark):
    keys = spark.range(0, 3000, 3).selectExpr("id as __id", "xxhash64(id, 'x') as __t")
    rows = spark.range(0, 3000).selectExpr("id as __id", "xxhash64(id, 'x') as __t").unionByName(spark.sql("select cast(null as bigint) as __id, 5L as __t"))
    found = {r["__id"]: r["__marked"] for r in line_dedup.marked(rows, line_dedup.marks(keys)).collect()}
    assert len(found) == 3001 and all(found[k] for k in range(0, 3000, 3)) and sum(found.values()) < 1010
    nothing = line_dedup.marked(rows, line_dedup.marks(keys.limit(0)))
    assert nothing.count() == 3001 and nothing.where("__marked").isEmpty()
