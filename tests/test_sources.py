"""Audio, JSON results and sinks."""

import io
import wave

import numpy as np

from intervale.shipping import ship
from intervale.sources import audio, sinks


def wav(rate, samples):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.asarray(samples, "<i2").tobytes())
    return out.getvalue()


def test_audio_is_read_and_bad_files_have_no_length(spark, tmp_path):
    ship(spark)
    (tmp_path / "a.wav").write_bytes(wav(8000, [100] * 8000))
    (tmp_path / "b.wav").write_bytes(b"nothing")
    found = {r["path"][-5]: r["duration_ms"] for r in audio.read_audio(spark, str(tmp_path)).select("path", "duration_ms").collect()}
    assert found == {"a": 1000, "b": 0}
    assert len(audio.decode_wav(wav(16000, []))) == 0


def test_subtitle_variants_differ_by_a_millisecond(spark):
    rows = spark.createDataFrame([(1, 0, 4350, 5000, 0, "a"), (1, 1, 5000, 6000, 1, " "), (1, 2, 6000, 7000, 1, "b")], "file_id long, seg_idx long, start_ms long, end_ms long, speaker long, text string")
    a, b, c = (sinks.to_srt(rows, v).first()["srt"] for v in "ABC")
    assert ",350" in a and ",349" in b and "\n2\n" in a and "\n3\n" in c
    assert '"speakers":["Speaker1","Speaker2"]' in sinks.to_result_json(rows).first()["json"]


def test_log_mel_of_tones(spark):
    import numpy as np

    from intervale.sources import audio

    basis = audio.mel_basis()
    assert basis.shape == (80, 257) and (basis >= 0).all() and (basis.sum(1) > 0).all()
    assert (np.diff(basis.argmax(1)) >= 0).all()
    t = np.arange(32_000) / audio.RATE
    x = np.where(t < 1, np.sin(2 * np.pi * 300 * t), np.sin(2 * np.pi * 3000 * t)).astype(np.float32)
    mel = audio.log_mel(x)
    assert mel.shape == (80, 201) and abs(mel.mean(1)).max() < 1e-3 and abs(mel.std(1) - 1).max() < 1e-2
    low, high = (int(np.abs((basis * (np.arange(257) * audio.RATE / 512)).sum(1) / basis.sum(1) - hz).argmin()) for hz in (300, 3000))
    assert mel[low, 20:80].mean() > 0.5 > -0.5 > mel[low, 120:180].mean() and mel[high, 120:180].mean() > 0.5
    assert audio.log_mel(np.zeros(0)).shape == (80, 0) and audio.log_mel(np.ones(10)).shape[0] == 80
    rows = spark.createDataFrame([("a", [float(v) for v in x[:4000]]), ("b", None), ("c", [])], "path string, samples array<float>")
    found = {r["path"]: r["mel"] for r in audio.with_log_mel(rows).collect()}
    assert found["b"] is None and found["c"] is None and np.allclose(np.array(found["a"]), audio.log_mel(x[:4000]), atol=1e-5)
