"""Conversation repair, language identification and vector codes."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_text_operators import ROWS, docs
from tessera.llm import conversation_repair, language_id, queries, vector_codes

DATA = "/root/testdata/sf0.001"
WHITE = " \t\n\x0b\x0c\r"
TALK = "conv_id long, turn long, role string, text string, step string, key string, shape string, seen int"


def talk(spark, rows):
    """Conversation rows with extra columns whose names clash with the operator's own."""
    return spark.createDataFrame([(*r, "x", "y", "z", 7) for r in rows], TALK)


def edits_by_hand(rows):
    """Least (cost, letters) and its repaired rows over all edit sequences, by relaxing whole (cost, letters) labels forward."""
    best = {0: (0, "", ())}
    order = {0: "u", 1: "u", 2: "a", 3: "u"}

    def relax(table, state, label):
        if state not in table or label[:2] < table[state][:2]:
            table[state] = label

    def insert(table):
        for _ in range(8):
            for s, (cost, letters, out) in list(table.items()):
                role = "user" if order[s] == "u" else "assistant"
                relax(table, 3 if s == 2 else 2, (cost + 5, letters + "I", out + ((role, ""),)))

    insert(best)
    for role, text, fault in rows:
        after = {}
        for s, (cost, letters, out) in best.items():
            relax(after, s, (cost + 2, letters + "D", out))
            if fault in ("blank", "duplicate"):
                continue
            extra, go = 5 if fault == "truncated" else 0, 3 if s == 2 else 2
            if role[:1] == "s" and s == 0:
                relax(after, 1, (cost + extra, letters + "K", out + ((role, text),)))
            if role[:1] == order[s]:
                relax(after, go, (cost + extra, letters + "K", out + ((role, text),)))
            relax(after, go, (cost + 1 + extra, letters + "R", out + (("user" if order[s] == "u" else "assistant", text),)))
        best = after
        insert(best)
    return min(best[s] for s in (0, 3) if s in best)


def repaired_by_hand(rows):
    """The contract, row by row: {conv_id: all columns}."""
    groups = {}
    for conv, turn, role, text in rows:
        kept = groups.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv, kept in groups.items():
        digest = lambda r: hashlib.sha256(f"{len(r[1].encode())}:{r[1]}{r[2]}".encode()).digest()
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], digest(r)))
        seen, faulty = set(), []
        for _, role, text in kept:
            solid = text.rstrip(WHITE)
            faulty.append((role, text, "blank" if not solid else "duplicate" if (role, text) in seen else "" if solid[-1] in ".!?" else "truncated"))
            seen.add((role, text))
        turns = [t for t, _, _ in kept if t is not None]
        cost, letters, result = edits_by_hand(faulty)
        count = lambda f: sum(x[2] == f for x in faulty)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(faulty, faulty[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        text = "\n".join(f"{r}:{t}" for r, t in result)
        out[conv] = (gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, letters, hashlib.sha256(text.encode()).hexdigest())
    return out


def rows_of(frame):
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    found = frame.collect()
    assert len({r.conv_id for r in found}) == len(found)
    return {r.conv_id: tuple(r[n] for n in names) for r in found}


def test_auction_equals_labels_of_all_edits():
    rng = np.random.default_rng(5)
    roles, faults = ("system", "user", "assistant", "tool"), ("", "blank", "duplicate", "truncated")
    shapes = [bytes(x) for n in range(3) for x in itertools.product(range(16), repeat=n)]
    shapes += [bytes(rng.choice(16, int(rng.integers(3, 40)), p=[0.15] * 4 + [0.4 / 12] * 12).tolist()) for _ in range(300)]
    for shape in shapes:
        want = edits_by_hand([(roles[x % 4], "t", faults[x // 4]) for x in shape])[:2]
        assert conversation_repair.cheapest_edits(shape) == want, shape
        assert conversation_repair.cheapest_edits(shape, block=3) == want, shape
    long = bytes(rng.choice(16, 3000, p=[0.15] * 4 + [0.4 / 12] * 12).tolist())
    assert conversation_repair.cheapest_edits(long) == edits_by_hand([(roles[x % 4], "t", faults[x // 4]) for x in long])[:2]


def test_repair_against_brute_force(spark):
    given = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows = given + [(1000 + k, t, r, x) for k in range(30) for t, r, x in (
        (None, "user", "No turn."), (None, None, "No role."), (3, "user", None), (3, "user", None), (9, "system", "Late. \n"), (9, "user", "Same"), (9, "user", "Same"), (12, "", "Empty role!"), (14, "assistant", "cut\x0b"), (15, "assistant", "é" * 30_000 + "?"))]
    rows += [(None, 0, "user", "Nobody's."), (None, 1, "assistant", " "), (None, None, None, None)]
    rows += [(5000, t, ("user", "assistant", "user", "system")[t * t % 4], f"Turn {t % 211}" + ".?!"[t % 3] * (t % 7 > 0)) for t in range(900)]
    rows += [(c, 0, "user", "Only one.") for c in range(6000, 6060)]
    want = repaired_by_hand(rows)
    assert rows_of(conversation_repair.damaged_and_repaired(talk(spark, rows))) == want
    assert (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in want.values()
    assert conversation_repair.damaged_and_repaired(talk(spark, [])).count() == 0
    edits = conversation_repair.repair(talk(spark, rows[:50])).collect()
    kept = {}
    for r in edits:
        if r.edit != "D":
            kept.setdefault(r.conv_id, []).append(r.role[0])
    assert all(re.fullmatch("s?(ua)+", "".join(v)) for v in kept.values())


def lang_by_hand(train, texts, params):
    """Naive Bayes with dictionaries, n-gram by n-gram."""
    import unicodedata

    def buckets(text):
        kind = [unicodedata.category(c)[0] for c in text.lower()]
        flat = re.sub(" +", " ", "".join(c if k in "LM" else " " for c, k in zip(text.lower(), kind))).strip(" ")
        flat = f" {flat} " if flat else ""
        out = []
        for n in params.orders:
            for a in range(n == 1, len(flat) - max(n - 1, 1) + (n > 1) * 0):
                code = n
                for c in flat[a : a + n]:
                    code = (code ^ ord(c)) * 0x9E3779B97F4A7C15 % 2**64
                    code ^= code >> 29
                out.append(code % params.buckets)
        return out

    langs = sorted({x for _, x in train})
    table = {x: np.full(params.buckets, params.smoothing) for x in langs}
    texts_of = dict.fromkeys(langs, 0)
    for text, lang in train:
        texts_of[lang] += 1
        for b in buckets(text):
            table[lang][b] += 1
    found = []
    for text in texts:
        grams = buckets(text)
        found.append([np.log(texts_of[x] / len(train)) + sum(np.log(table[x][b] / table[x].sum()) for b in grams) for x in langs])
    return langs, np.array(found)


def test_language_likelihoods_by_hand(spark):
    params = language_id.Params(buckets=256)
    train = [("Der Hund läuft, 12 Hunde!", "de"), ("the dog runs; the dogs run", "en"), ("Le chien court à l'école", "fr"), ("el perro corre por el año", "es"), ("", "en"), ("12 34", "de"), ("हिन्दी पाठ", "hi")]
    frame = spark.createDataFrame([(k, t, x, 1) for k, (t, x) in enumerate([*train, (None, "zz"), ("kein", None)])], "doc_id long, text string, lang string, bucket int")
    model = language_id.fit(frame, params=params)
    texts = ["dog", "l'année!!", "Hunde ÜBER  9 alles ", "x", "हिन्दी"]
    langs, want = lang_by_hand(train, texts, params)
    assert model.languages == langs
    got, n, has = language_id.likelihoods([t.encode() for t in texts], model)
    assert np.allclose(got, want, atol=1e-3) and has.all()
    found = {r.doc_id: r for r in language_id.identify(frame, model).collect()}
    assert len(found) == 9 and found[7].lang_pred == found[4].lang_pred == found[5].lang_pred == "und" and found[6].lang_pred == "hi"
    assert all(0 <= r.score <= 1 for r in found.values())
    assert {r.lang_pred for r in language_id.identify(docs(spark, ROWS), language_id.fit(docs(spark, ROWS))).collect()} == {"und"}  # no language to learn
    assert language_id.identify(docs(spark, []), model).count() == 0
    assert len(language_id.identify(docs(spark, ROWS), model).collect()) == len(ROWS)
    with pytest.raises(ValueError):
        language_id.fit(frame, params=language_id.Params(most_languages=3))


def test_language_held_out_accuracy(spark):
    given = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = queries.op12_language_id(spark, "/root/testdata/sf0.01").join(given.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert len(found) > 150 and np.mean([r.lang == r.lang_pred for r in found]) > 0.97
    # What is held out teaches nothing: other languages on held-out rows don't change the model.
    other = given.withColumn("lang", F.when(language_id.id_bucket("doc_id", 4) == 2, F.lit("zz")).otherwise(F.col("lang")))
    one, two = language_id.fit(given, (4, 2)), language_id.fit(other, (4, 2))
    assert one.languages == two.languages and np.array_equal(one.matrix, two.matrix)


def codes_by_hand(rows, parts=4, size=256, rounds=4):
    kept = [(i, v, x) for i, v, x in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // parts)
    ints = [[int(np.floor(1024 * float(np.float32(c)))) for c in v] + [0] * (width * parts - len(v)) for _, v, _ in kept]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, [int(np.floor(1024 * float(np.float32(c)))) for c in kept[k][1]]))[:size]
    books = [[ints[k][p * width : (p + 1) * width] for k in order] for p in range(parts)]
    near = lambda p, part: min(((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(books[p])))
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in ints]
    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for v in cut:
                members.setdefault(near(p, v[p])[1], []).append(v[p])
            books[p] = [[sum(c) // len(c) for c in zip(*members[k])] if k in members else e for k, e in enumerate(books[p])]
    found = [[near(p, v[p]) for p in range(parts)] for v in cut]
    errors = [sum(d for d, _ in f) for f in found]
    labels = {}
    for (_, _, x), e in zip(kept, errors):
        labels[x] = labels.get(x, 0) + e
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{k:02x}" for _, k in f), e, labels[x], digest) for (i, _, x), f, e in zip(kept, found, errors)), key=str)


VECTORS = "vec_id long, embedding array<float>, label int, entry int, part string, n long, id int"


def run_codes(spark, monkeypatch, rows):
    frame = spark.createDataFrame([(*r, 1, "p", 2, 3) for r in rows], VECTORS)
    monkeypatch.setattr(queries, "table", lambda *_: frame)
    return sorted((tuple(r) for r in queries.op13_vector_codes(spark, "").collect()), key=str)


def test_codes_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(2)
    base = rng.normal(0, 0.3, (40, 8))
    rows = [(int(i), (base[i % 40] + rng.normal(0, 0.05, 8)).astype(np.float32).tolist(), None if i % 11 == 0 else int(i % 5)) for i in rng.permutation(700)]
    rows += [(900, rows[3][1], 2)] * 60 + [(3, rows[5][1], 1), (None, rows[6][1], 1), (901, None, 1), (902, [0.5] * 7 + [None], 1), (903, [float("nan")] * 8, 1), (904, [float("inf")] * 8, 1), (905, [1.0], None), (906, [], 3)]
    assert run_codes(spark, monkeypatch, rows) == codes_by_hand(rows)
    few = [(1, [0.1, 0.2, 0.3], None), (2, [0.1, 0.2, 0.3], 1), (3, [1e6, -1e6, 2e5], 1), (4, [3e6, 1e4, -7e5], 2)]
    assert run_codes(spark, monkeypatch, few) == codes_by_hand(few)
    huge = [(1, [1e12, 2e12, 3.0, 4.0], None), (2, [-5e12, 1.0, 2.0, 3.0], 1)]
    assert run_codes(spark, monkeypatch, huge) == codes_by_hand(huge)
    assert run_codes(spark, monkeypatch, []) == [] and run_codes(spark, monkeypatch, [(1, None, 1)]) == []
    assert run_codes(spark, monkeypatch, [(1, [], 1), (2, [], 1)]) == codes_by_hand([(1, [], 1), (2, [], 1)])


def test_only_parts_that_change_are_shuffled(spark):
    kept = vector_codes.kept_vectors(spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet"))
    first = vector_codes.first_books(kept)
    assert first.width == 16 and all(len(b) == 256 for b in first.books)
    shared = spark.sparkContext.broadcast(first)
    state = vector_codes.checkpointed(vector_codes._members(kept, shared).repartition(4, *vector_codes.OWNERS))
    second = vector_codes._updated(first, state, shared)
    after = vector_codes._migrated(state, spark.sparkContext.broadcast(second), 4)
    plan = after._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1  # that of the moved parts
    stay = after.withColumn("at", F.spark_partition_id()).where("at < 4").select(*vector_codes.OWNERS, "at")
    home = state.select(*vector_codes.OWNERS, F.spark_partition_id().alias("home")).distinct()
    assert after.rdd.getNumPartitions() == 8 and 0 < stay.count() < after.count()
    assert stay.join(home, vector_codes.OWNERS).where("at != home").count() == 0
    assert after.agg(F.sum("n")).first()[0] == 4 * 500
