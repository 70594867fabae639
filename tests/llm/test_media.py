"""Audio features against direct sums."""

import numpy as np
import pyarrow as pa
import pytest

from scanloom.llm import media


def _mel(f):
    return 2595 * np.log10(1 + f / 700)


@pytest.mark.parametrize("size", [64, 640, 1984])
def test_log_mel_and_segments_match_direct_sums(size):
    r = np.random.default_rng(size)
    loud = np.repeat(r.random(size // 16) > 0.5, 16)
    payload = np.where(loud, r.integers(0, 256, size), 128 + r.integers(-2, 3, size)).astype(np.uint8).tobytes()
    x = media.resample((np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128)
    mel, energy = media.log_mel(x)
    rate, n = media.RATE * media.UP / media.DOWN, media.FRAME
    edges = 700 * (10 ** (np.linspace(_mel(20), _mel(rate / 2), media.BANDS + 2) / 2595) - 1)
    for f in range(len(mel)):
        part = np.zeros(n)
        held = x[f * media.HOP : f * media.HOP + n]
        part[: len(held)] = held
        part *= np.hanning(n)
        power = [abs(sum(part[t] * np.exp(-2j * np.pi * k * t / n) for t in range(n))) ** 2 for k in range(n // 2 + 1)]
        for b in range(media.BANDS):
            low, mid, high = edges[b : b + 3]
            want = sum(p * max(0, min((k * rate / n - low) / (mid - low), (high - k * rate / n) / (high - mid))) for k, p in enumerate(power))
            assert mel[f, b] == pytest.approx(np.log1p(want), abs=2e-3)
        assert energy[f] == pytest.approx(10 * np.log10((part**2).mean() + 1e-6), abs=1e-3)
    level, want, k = energy - energy.mean(), [], 0
    while k < len(level):
        end = k
        while end < len(level) and level[end] > media.FALL:
            end += 1
        if end > k and max(level[k:end]) >= media.RISE:
            want.append((k, end))
        k = max(end, k + 1)
    assert media.segments(energy) == want


def test_tensors_keep_their_shape(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate([None, "", "a b c " * 400, "é" * 999, "x" * 200_000])], "doc_id long, text string")
    found = media.encode_media(docs)
    assert found.schema["tensor"].metadata == {"shape": [media.ROWS, media.BANDS]}
    table = media.with_tensors(found.select("doc_id", "tensor", "spans", "segments", "feature").toArrow().combine_chunks().to_batches()[0])
    assert table.schema.field("tensor").type == pa.fixed_shape_tensor(pa.float32(), (media.ROWS, media.BANDS))
    for tensor, feature, spans, segments in zip(table.column("tensor").to_numpy_ndarray(), *(table.column(c).to_pylist() for c in ("feature", "spans", "segments")), strict=True):
        values, own = media.read_feature(feature)
        assert np.allclose(values, tensor, atol=0.006) and len(spans) == media.ROWS and len(own) == len(segments)
        assert all(a < b for a, b in spans) and all(x[1] <= y[0] for x, y in zip(segments, segments[1:]))
