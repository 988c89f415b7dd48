"""Models, archives, URL rules, images and the pipeline."""

import hashlib
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from tests.llm.test_text_operators import ROWS, docs, simhash_by_hand
from tessera.llm import media, quality_crf, toxicity, url_rules, warc


def test_gru_gradients_match_differences():
    p = toxicity.Params(window=5, stride=3, hidden=3, size=2, word_buckets=32, gram_buckets=32)
    model = toxicity.Model.fresh(p)
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}
    words = [b"alpha", b"be", b"c", b"delta"]
    index = np.array([[0, 1], [1, 2], [2, 3], [3, 0], [0, 0]])
    mask = np.array([[1, 1], [1, 1], [1, 1], [1, 0], [1, 0]], dtype=bool)
    target, weight = np.array([1.0, 0.0]), np.array([0.7, 0.3])

    def loss():
        z = model.logits(model.projected(words), index, mask).astype(np.float64)
        return float((weight * (np.logaddexp(0, z) - target * z)).sum())

    grads = model.gradients(words, index, mask, target, weight)
    rng = np.random.default_rng(0)
    for name, value in model.weights.items():
        flat, grad = value.reshape(-1), np.asarray(grads[name], dtype=np.float64).reshape(-1)
        for k in rng.choice(np.flatnonzero(grad) if np.any(grad) else np.arange(len(flat)), 4):
            old = flat[k]
            flat[k] = old + 1e-3
            up = loss()
            flat[k] = old - 1e-3
            down = loss()
            flat[k] = old
            assert (up - down) / 2e-3 == pytest.approx(grad[k], abs=2e-3), name


def test_windows_cover_all_words():
    p = toxicity.Params()
    for n in (1, 19, 20, 21, 34, 35, 100):
        index, mask, owner = toxicity.layout(np.arange(n), np.array([n]), p)
        assert set(index[mask].tolist()) == set(range(n)) and not owner.any()


@pytest.fixture(scope="module")
def labelled():
    rng = np.random.default_rng(4)
    clean = [f"{a}{b}" for a in ("ba", "ce", "di", "fo") for b in ("lam", "nor", "pit", "sun", "tek")]
    texts, labels = [], []
    for k in range(400):
        words = rng.choice(clean, rng.integers(10, 60)).tolist()
        if k % 4 == 0:
            words[rng.integers(0, len(words))] = str(rng.choice(["vileword", "vilename,", "NASTY"]))
        texts.append(" ".join(words).encode())
        labels.append(int(k % 4 == 0))
    return texts, labels


def test_toxicity_held_out_accuracy(spark, labelled):
    texts, labels = labelled
    model = toxicity.train(texts[:300], labels[:300])
    scores = toxicity.Scorer(model)(texts[300:])[0]
    assert np.mean((scores >= 0.5) == np.array(labels[300:])) > 0.95
    got = toxicity.score_documents(docs(spark, ROWS), model).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in got if r.doc_id in (3, 4)} == {0.0}
    assert toxicity.score_documents(docs(spark, []), model).count() == 0
    long = b" ".join([texts[1]] * 300 + [b"vileword"] + [texts[1]] * 300)
    assert toxicity.Scorer(model)([long])[0][0] >= 0.5  # the whole text is read
    kept = toxicity.drop_toxic(docs(spark, [*ROWS, (77, texts[0].decode() + " vileword vileword")]), model)
    assert kept.columns == docs(spark, []).columns and 77 not in {r.doc_id for r in kept.collect()}
    assert len(toxicity.train([], []).weights) and len(toxicity.train([b"a"], [0]).weights)


def brute_marginals(emit, stay):
    n, total, good = len(emit), 0.0, np.zeros(len(emit))
    for code in range(2**n):
        y = [(code >> k) & 1 for k in range(n)]
        s = sum(e for e, v in zip(emit, y) if v) + sum(stay[0] if a and b else stay[1] if not a and not b else 0 for a, b in zip(y, y[1:]))
        total += np.exp(s)
        good += np.exp(s) * np.array(y)
    return good / total


def test_forward_backward_against_all_labellings():
    rng = np.random.default_rng(1)
    n_lines = np.array([3, 1, 6, 2])
    emit, stay = rng.normal(0, 2, 12), np.array([0.8, 1.4])
    odds, pairs = quality_crf.forward_backward(emit, n_lines, stay)
    at = 0
    for n in n_lines:
        assert 1 / (1 + np.exp(-odds[at : at + n])) == pytest.approx(brute_marginals(emit[at : at + n], stay))
        at += n
    assert pairs[[0, 3, 4, 10]].sum() == 0


def test_quality_held_out_accuracy(spark):
    rng = np.random.default_rng(6)
    words = ["plain", "words", "make", "good", "lines", "here"]
    texts, labels = [], []
    for k in range(300):
        lines = [" ".join(rng.choice(words, rng.integers(4, 12))) for _ in range(rng.integers(1, 8))]
        if k % 3 == 0:
            lines = [" ".join(w + "%%%" for w in x.split()) if k % 2 else x.upper() + "!!" for x in lines]
        texts.append("\n".join(lines).encode())
        labels.append(int(k % 3 != 0))
    model = quality_crf.train(texts[:200], labels[:200])
    scores = quality_crf.score_texts(model, texts[200:])[0]
    assert np.mean((scores >= 0.7) == np.array(labels[200:])) > 0.95
    got = quality_crf.score_documents(docs(spark, ROWS), model).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert quality_crf.score_documents(docs(spark, []), model).count() == 0
    assert quality_crf.keep_good(docs(spark, ROWS), model).columns == docs(spark, []).columns
    assert quality_crf.train([], []).scale == 0


PAGES = [
    (1, "http://a.example.net/en/1", "x" * 200), (2, "http://b.example.net/en/2?x=1", "x" * 200), (0, None, "x" * 200), (3, "no scheme", "short"), (4, "http://c/", "short"), (5, "http://é.org/ü", None),
    (6, "http://q", ""), (None, "http://n", "x" * 200), (7, "http://w\r\nX: y", "\r\n\r\nWARC/1.1\r\n" * 40), (0, None, "x" * 200), (8, "http://big", "é" * 400_000),
    (9, "", "tail%0A"), (10, "http://x/%0A", "y" * 100), (11, "http://x/%0A", "y" * 100),
]


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "z", 1) for i, u, h in rows], "page_id long, url string, html string, payload string, frame int")


def test_warc_round_trip(spark, tmp_path):
    path = warc.write_archives(pages(spark, PAGES), str(tmp_path))
    archives = spark.read.parquet(path)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(archives).collect()), key=str)
    want = []
    for i, _, h in PAGES:
        data = (h or "").encode()
        first = min((j for j, _, x in PAGES if j is not None and (x or "").encode() == data), default=None)
        revisit = len(data) >= 100 and i is not None and i > first
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    assert got == sorted(want, key=str)
    record = warc.lookup(archives, spark.createDataFrame([(8,)], "page_id long")).first().record
    assert warc.read_record(bytes(record), 0)[1] == ("é" * 400_000).encode()
    # URLs come back as they are; record ids are unique although page ids repeat and lack.
    urls = sorted(((r.page_id, r.url) for r in warc.read_archives(archives).collect()), key=str)
    assert urls == sorted(((i, u) for i, u, _ in PAGES), key=str)
    names = []
    for r in archives.collect():
        for e in r["index"]:
            data = warc.read_frame(bytes(r.bundle), e.frame)
            names.append(warc.read_record(data, e.offset)[0]["WARC-Record-ID"])
    assert len(set(names)) == len(PAGES)
    no_url = warc.write_archives(pages(spark, PAGES).drop("url"), str(tmp_path))
    assert {r.url for r in warc.read_archives(spark.read.parquet(no_url)).collect()} == {None}
    bundle = bytes(archives.where(F.size("index") > 1).first().bundle)
    frames = warc.seek_table(bundle)
    assert b"".join(warc.read_frame(bundle, k) for k in range(len(frames))) == b"".join(zstandard.ZstdDecompressor().decompressobj().decompress(bundle[a : a + n]) for a, n, _ in frames)
    with pytest.raises(ValueError):
        warc.seek_table(bundle[:-1] + b"\0")
    empty = warc.write_archives(pages(spark, []), str(tmp_path))
    assert warc.read_archives(spark.read.parquet(empty)).count() == 0


def test_url_rules(spark):
    rows = [
        (1, "http://www.Example.ORG/es/5", None), (2, "https://example.org/en/12", None), (3, "http://x.org", None), (4, "http://x.org/?a", None), (5, "http://a.com/fr/", None), (6, "http://a.com/de/1#f", None),
        (7, "http://acom/de/1", None), (8, None, None), (9, "nothing", None), (10, "http://evilorg/es/", None), (None, "http://a.com/xx", None),
    ]
    rows += [(100 + k, f"http://h{k % 7}.net/{'spam' if k % 2 else 'ham'}/{k}", None) for k in range(60)]
    labels = spark.createDataFrame([(100 + k, int(k % 2 == 0), 0) for k in range(50)] + [(100, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int")
    got = {r.page_id: r for r in url_rules.judge(pages(spark, rows), labels, url_rules.Params(min_support=0.1)).collect()}
    assert len(got) == len(rows)
    want = {1: ("example.org/es/", "block"), 2: ("example.org/en/1", "block"), 3: (None, None), 4: ("org/", "allow"), 5: ("com/fr/", "allow"), 6: ("com/de/", "block"), 7: (None, None), 10: (None, None), None: (None, None)}
    for i, (rule, verdict) in want.items():
        assert got[i].rule == rule and (verdict is None or got[i].verdict == verdict), i
    assert (got[1].host, got[1].path) == ("www.example.org", "/es/5") and (got[8].host, got[9].path) == ("", "")
    for k in range(60):
        assert got[100 + k].verdict == ("block" if k % 2 else "allow") and got[100 + k].mined_rule == ("part=spam" if k % 2 else None)
    none = labels.limit(0)
    assert {r.verdict for r in url_rules.judge(pages(spark, rows[-5:]), none).collect()} == {"allow"}
    assert url_rules.judge(pages(spark, []), labels).count() == 0


def test_mined_rules_against_all_token_sets(spark):
    from itertools import combinations

    rng = np.random.default_rng(3)
    rows = []
    for k in range(120):
        tokens = sorted({"s", *(f"t{x}" for x in range(7) if rng.random() < 0.4), *(("u", "v") if rng.random() < 0.3 else ())})
        bad = ("t1" in tokens and "t2" in tokens) or "u" in tokens and rng.random() < 0.8 or rng.random() < 0.1
        rows.append((k, tokens, bool(bad)))
    p = url_rules.Params(min_support=0.03, min_confidence=0.6)
    names = [t for t in sorted({t for _, ts, _ in rows for t in ts}) if t not in ("s", "v")]  # s has all rows, v stands with u
    sure, least = {}, 4
    for n in range(1, len(names) + 1):
        for c in combinations(names, n):
            own = [bad for _, ts, bad in rows if set(c) <= set(ts)]
            if sum(own) >= least and sum(own) / len(own) >= 0.6 and not any(set(x) < set(c) and sure[x][0] >= sum(own) / len(own) for x in sure):
                sure[c] = (sum(own) / len(own), sum(own) / len(rows))
    got = {tuple(r.tokens): (r.confidence, r.support) for r in url_rules.mine_rules(spark.createDataFrame(rows, "row long, tokens array<string>, bad boolean"), p).collect()}
    assert got.keys() == sure.keys() and len(got) > 3
    assert all(got[k] == pytest.approx(sure[k]) for k in sure)


def test_rules_hold_the_least_support_where_most_bad_rows_have_sure_tokens_only(spark):
    rows = [(k, ["sure"], True) for k in range(300)] + [(300 + k, ["p", "q", "sure"], True) for k in range(3)] + [(310 + k, ["p", f"r{k}"], k < 9) for k in range(40)] + [(360 + k, ["q", f"r{k}"], k < 9) for k in range(40)]
    p = url_rules.Params(min_support=0.02, min_confidence=0.2)  # eight rows at least
    got = {tuple(r.tokens) for r in url_rules.mine_rules(spark.createDataFrame(rows, "row long, tokens array<string>, bad boolean"), p).collect()}
    assert ("sure",) in got and ("p", "q") not in got and ("p",) in got


def test_long_urls_end(spark):
    long = ["http://h.net/" + "/".join(f"p{k}" for k in range(200)) + "?" + "&".join(f"k{k}=1" for k in range(200)), "http://h.net/" + "/".join(f"p{k}" for k in range(200)) + "/more"]
    rows = [(k, long[k] if k < 2 else f"http://h.net/x{k}", None) for k in range(51)]
    labels = spark.createDataFrame([(k, int(k > 3), 0) for k in range(51)], "doc_id long, quality int, toxic int")
    got = {r.page_id: r for r in url_rules.judge(pages(spark, rows), labels).collect()}
    assert got[0].verdict == got[1].verdict == "block" and got[9].verdict == "allow"


def test_png_filters_and_checksums():
    rng = np.random.default_rng(2)
    pixels = np.concatenate([rng.integers(0, 256, (20, 64)), np.arange(40 * 64).reshape(40, 64) % 251]).astype(np.uint8)
    for image in (pixels, pixels[:1], np.zeros((5, 64), np.uint8)):
        data = media.write_png(image)
        assert np.array_equal(media.read_png(data), image)
    with pytest.raises(ValueError):
        media.read_png(data[:40] + bytes([data[40] ^ 1]) + data[41:])
    kinds = np.array([1, 2, 3, 4, 4, 3, 0, 1] * 3)
    image = rng.integers(0, 256, (24, 9), dtype=np.uint8)
    filtered = np.zeros_like(image)
    for y in range(24):
        for x in range(9):
            a, b, c = (int(image[y, x - 1]) if x else 0, int(image[y - 1, x]) if y else 0, int(image[y - 1, x - 1]) if x and y else 0)
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            filtered[y, x] = (int(image[y, x]) - [0, a, b, (a + b) // 2, paeth][kinds[y]]) % 256
    assert np.array_equal(media.unfilter(kinds, filtered), image)
    matrix = media.cosine_matrix(16, 16)
    assert np.allclose(matrix @ matrix.T, np.eye(16))


def test_media_columns(spark):
    got = media.image_features(media.store_images(docs(spark, ROWS))).collect()
    assert len(got) == len(ROWS)
    want = {}
    for i, t in ROWS:
        data = (t or "").encode()
        whole = data + bytes(-len(data) % 64 or (0 if data else 64))
        want.setdefault(i, set()).add((len(data), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-64:])))
    assert all((r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) in want[r.doc_id] for r in got)
    assert len({(r.media_sha256, r.feature) for r in got if r.doc_id in (3, 4)}) == 1
    assert media.store_images(docs(spark, [])).count() == 0


def test_pipeline_stages(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from tests.llm.test_text_operators import deduped_by_hand

    rng = np.random.default_rng(9)
    words = [f"{a}{b}" for a in ("ba", "ce", "di", "fo", "gu") for b in ("lam", "nor", "pit", "sun", "tek")]
    rows, labels = [], []
    for k in range(240):
        lines = [" ".join(rng.choice(words, rng.integers(6, 20))) for _ in range(4)]
        toxic, bad = k % 6 == 0, k % 5 == 0
        if toxic:
            lines[1] += " vileword nasty vileword"
        if bad:
            lines = [" ".join(w + "$$$" for w in x.split()) for x in lines]
        rows.append((k, "\n".join(lines), "en", "s", 0))
        labels.append((k, int(not bad), int(toxic)))
    rows += [(500, rows[1][1], "en", "s", 0), (501, None, None, None, None), (None, "text without an id stands here", "en", "s", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    d = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for name in ("toxicity", "quality", "line_dedup", "near_dedup"):
        stages[name](spark, d, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        d = spark.read.parquet(f"{tmp_path}/{name}")
        assert d.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept.append({r.doc_id: r.text for r in d.collect()})
    toxic = {k for k in range(240) if k % 6 == 0}
    bad = {k for k in range(240) if k % 5 == 0}
    assert not toxic & set(kept[0]) and not bad & set(kept[1])
    assert len(set(range(240)) - toxic - bad - set(kept[1])) < 5
    assert kept[2] == dict(deduped_by_hand(list(kept[1].items())))
    seen = {}
    for i in sorted(x for x in kept[2] if x is not None):
        seen.setdefault(simhash_by_hand(kept[2][i]), i)
    assert set(kept[3]) - {None} <= set(seen.values())
    total = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in total.select("doc_id").distinct().collect()} == set(kept[3])
