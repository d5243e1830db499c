import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pathloom.llm import audio
from pathloom.llm.queries import op10_media


@pytest.mark.parametrize(("up", "down"), [(1, 2), (3, 2), (2, 5), (1, 1)])
def test_polyphase_is_filtering_on_the_raised_grid(up, down):
    x = np.random.default_rng(0).normal(size=700).astype(np.float32)
    raised = np.zeros(len(x) * up, np.float32)
    raised[::up] = x
    h = audio.taps(up, down)
    plain = np.convolve(raised, h)[len(h) // 2 :][: len(raised)][::down]
    y = audio.resample(x, up, down)
    assert len(y) == len(plain) and np.allclose(y, plain, atol=1e-5)
    part = audio.resample(x[100:600], up, down, 300 * up // down, 320 * up // down, offset=100)
    assert np.allclose(part, y[300 * up // down : 320 * up // down], atol=1e-5)


def test_blocks_do_not_change_features(monkeypatch):
    samples = np.random.default_rng(1).integers(0, 256, 200_000, dtype=np.uint8).tobytes()
    one = [np.concatenate(x) for x in zip(*audio.log_mel(samples), strict=True)]
    monkeypatch.setattr(audio, "BLOCK", 128)
    many = [np.concatenate(x) for x in zip(*audio.log_mel(samples), strict=True)]
    assert all(np.allclose(a, b, atol=1e-3) for a, b in zip(one, many, strict=True))


def test_mel_bank_and_tone():
    bank = audio.mel_bank(8000, audio.N_FFT, audio.MELS)
    assert bank.shape == (audio.N_FFT // 2 + 1, audio.MELS) and bank.min() >= 0 and bank.max() <= 1
    low, high = ((128 + 100 * np.sin(2 * np.pi * f * np.arange(16_000) / 16_000)).astype(np.uint8).tobytes() for f in (300, 3000))
    assert next(audio.log_mel(low))[0].mean(0).argmax() < next(audio.log_mel(high))[0].mean(0).argmax()


def test_hysteresis():
    a, b = audio.OPEN_DB, audio.CLOSE_DB
    mid = (a + b) / 2
    assert audio.segments(np.array([mid, a, mid, mid, b - 1, mid, a])) == [(1, 4), (6, 7)]
    assert audio.segments(np.array([b - 1, b - 2])) == []


def test_wav_round_trip():
    for n in (0, 1, 576, 577):
        raw = bytes(range(256)) * 3
        assert audio.from_wav(audio.to_wav(raw[:n])) == (audio.RATE, raw[:n])
    with pytest.raises(ValueError):
        audio.from_wav(b"nothing")


def expected(text):
    raw = (text or "").encode()
    padded = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
    return len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:])


def test_digest_edges(make):
    rows = [(1, None), (2, ""), (3, "é" * 288), (3, "é" * 288), (4, "x" * 577), (None, "abc"), (5, "long text " * 60_000)]
    got = audio.media_digest(make(rows)).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted([(r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got], key=key) == sorted([(i, *expected(t)) for i, t in rows], key=key)
    assert all(r.media_bytes == r.payload_bytes + 44 for r in got)
    by = {r.doc_id: r for r in got}
    assert by[1].feature == by[2].feature and by[1].media_sha256 == by[2].media_sha256
    assert audio.media_digest(make(rows).limit(0)).count() == 0
    assert audio.media_digest(make(rows).selectExpr("text AS feature", "text"), keep=()).count() == 7


def test_clips_are_fixed_shape_tensors(spark):
    media = audio.to_wav(audio.payload(b"\xff" * 50_000))
    df = spark.createDataFrame([(1, bytearray(media)), (2, None)], "doc_id long, media binary")
    rows = audio.audio_clips(df).orderBy("clip").collect()
    assert [r.clip for r in rows] == list(range(len(rows))) and all(r.end_s > r.start_s for r in rows) and rows[0].active == 1.0
    tensors = audio.tensors(pa.array([r.tensor for r in rows], pa.list_(pa.float32())))
    assert tensors.type == pa.fixed_shape_tensor(pa.float32(), (audio.CLIP, audio.MELS)) and tensors.to_numpy_ndarray().shape == (len(rows), audio.CLIP, audio.MELS)


def test_query(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op10_media(spark, sf).withColumn("x", F.lit(1)).collect():
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == expected(texts[r.doc_id])
