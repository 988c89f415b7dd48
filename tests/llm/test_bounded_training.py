"""What trainings hold at once: slices of texts and words, with the same features."""

import numpy as np

from tessera.llm import quality_crf, toxicity


def test_line_features_are_made_in_slices(monkeypatch):
    rng = np.random.default_rng(3)
    texts = [b"\n".join(b" ".join(bytes(rng.integers(97, 123, 5).astype(np.uint8)) for _ in range(8)) for _ in range(40)) for _ in range(60)]
    whole, plain, seen = quality_crf.line_features(texts), quality_crf.line_features, []
    monkeypatch.setattr(quality_crf, "SLICE", 10_000, raising=False)
    monkeypatch.setattr(quality_crf, "line_features", lambda x: seen.append(sum(map(len, x))) or plain(x))
    model = quality_crf.train(texts, [k % 2 for k in range(60)], quality_crf.Params(steps=3))
    assert max(seen) <= 10_000 and sum(seen) == 2 * sum(map(len, texts))
    for a, b in zip(quality_crf.features_in_slices(texts), whole):
        assert a.dtype == b.dtype and (a == b).all()
    assert np.isfinite(model.weights).all()


def test_words_of_a_sample_are_hashed_in_slices(monkeypatch):
    texts = [b" ".join(b"w%d" % (k * 977 % 45_000 + j) for j in range(900)) for k in range(60)] + [b" \n", b""]
    p, plain, seen = toxicity.Params(), toxicity.grams, []
    sample = toxicity.Sample(texts, p)
    assert sample.known.tolist() == list(range(60)) and sample.lengths.tolist() == [900] * 60
    assert [sample.words[k] for k in sample.flat[:3]] == [b"w0", b"w1", b"w2"] and len(sample.words) > 40_000
    whole, ids, first = plain(sample.words, p)
    monkeypatch.setattr(toxicity, "grams", lambda words, p: seen.append(len(words)) or plain(words, p))
    words, pieces = sample.frequent(toxicity.Params(word_documents=1, gram_documents=1))
    assert max(seen) <= 20_000 and sum(seen) == len(sample.words)
    assert set(np.flatnonzero(words)) == set(whole) and set(np.flatnonzero(pieces)) == set(ids)
