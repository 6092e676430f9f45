import hashlib
import struct

import numpy as np

from judgeloom.llm import media


def test_digests_hold_the_stored_tensors(spark):
    """Empty, short and long recordings: the digest is that of the rows of features, which hold every frame, padded with the floor."""
    rows = [(1, None), (2, ""), (3, "short"), (4, "a longer text " * 3000), (5, "x" * 900_000)]
    stored = media.encode(spark.createDataFrame(rows, "doc_id long, text string"))
    held = {}
    for r in media.features(stored).collect():
        held.setdefault(r["doc_id"], []).append(r)
    kept = {r["doc_id"]: r["media"] for r in stored.collect()}
    got = {r["doc_id"]: r for r in media.digests(stored).collect()}
    assert got.keys() == held.keys() == {1, 2, 3, 4, 5}
    for d, blocks in held.items():
        blocks.sort(key=lambda r: r["block"])
        mel = media.log_mel(media.samples_of(kept[d])[0])
        values = np.array([r["log_mel"] for r in blocks], np.float32).reshape(-1, media.MELS)
        assert [r["block"] for r in blocks] == list(range(-(-len(mel) // media.TENSOR_FRAMES)))
        assert np.array_equal(values[: len(mel)], mel) and (values[len(mel) :] == np.float32(np.log(media.FLOOR))).all()
        assert blocks[0]["start_ms"] == 0 and blocks[-1]["end_ms"] == media.milliseconds(len(mel))
        seen = hashlib.sha256()
        for r in blocks:
            seen.update(struct.pack("<qq", r["start_ms"], r["end_ms"]) + np.array(r["log_mel"], "<f4").tobytes())
        assert got[d]["n_tensors"] == len(blocks) and got[d]["tensors_sha256"] == seen.hexdigest()
        assert f";tensors={len(blocks)};" in got[d]["feature"]
    assert len(held[3]) == 1 and len(held[5]) > 64


def test_resampling_by_the_definition():
    """Zeros between samples, every filter tap, every DOWN-th sample kept: one product at a time."""
    rng = np.random.RandomState(1)
    n = np.arange(media.UP * media.TAPS) - (media.UP * media.TAPS - 1) / 2
    cut = 1 / max(media.UP, media.DOWN)
    taps = media.UP * cut * np.sinc(n * cut) * np.hamming(media.UP * media.TAPS)
    for size in (1, 7, 64, 333):
        x = rng.uniform(-1, 1, size).astype(np.float32)
        wide = [float(x[k // media.UP]) if k % media.UP == 0 else 0.0 for k in range(size * media.UP)]
        want = []
        for k in range(0, size * media.UP, media.DOWN):
            want.append(sum(taps[j] * wide[k - j] for j in range(len(taps)) if 0 <= k - j < len(wide)))
        got = media.resample(x)
        assert len(got) == len(want) and np.allclose(got, want, atol=1e-5)


def test_log_mel_by_the_definition():
    raw = bytes(np.random.RandomState(2).randint(0, 256, 1600).astype(np.uint8))
    y = media.resample((np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128)
    rate = media.RATE * media.UP / media.DOWN
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = [700 * (10 ** (mel(rate / 2) * k / (media.MELS + 1) / 2595) - 1) for k in range(media.MELS + 2)]
    want = []
    for start in range(0, len(y) - media.FRAME + 1, media.HOP):
        frame = [float(v) * (0.5 - 0.5 * np.cos(2 * np.pi * k / (media.FRAME - 1))) for k, v in enumerate(y[start : start + media.FRAME])]
        power = []
        for f in range(media.FRAME // 2 + 1):
            at = np.exp(-2j * np.pi * f * np.arange(media.FRAME) / media.FRAME)
            power.append(abs((at * frame).sum()) ** 2)
        row = []
        for m in range(media.MELS):
            total = 0.0
            for f, p in enumerate(power):
                hz = f * rate / media.FRAME
                up, down = (hz - edges[m]) / (edges[m + 1] - edges[m]), (edges[m + 2] - hz) / (edges[m + 2] - edges[m + 1])
                total += p * max(0.0, min(up, down))
            row.append(np.log(total + media.FLOOR))
        want.append(row)
    assert np.allclose(media.log_mel(raw), np.array(want), atol=2e-3)
    assert media.log_mel(bytes(64)).shape == (1, media.MELS)


def test_hysteresis_by_a_state_machine():
    rng = np.random.RandomState(3)
    for n in (1, 2, 50, 400):
        for energy in (rng.randn(n) * 0.4, np.zeros(n), np.repeat(rng.randn(n // 5 + 1), 5)[:n]):
            middle, inside, want = np.median(energy), None, []
            for k, e in enumerate(energy.tolist()):
                if inside is not None and e < middle + media.LOW:
                    want.append((inside, k))
                    inside = None
                if inside is None and e >= middle + media.HIGH:
                    inside = k
            if inside is not None:
                want.append((inside, n))
            assert media.segments(energy) == want


def test_repeated_rows_clashing_columns_and_no_rows(spark):
    fields = "doc_id long, text string, media string, n_bytes string, feature int"
    rows = [(1, "same text é", "m", "n", 1), (1, "same text é", "m", "n", 1), (2, "same text é", "x", None, 2), (None, None, None, None, None), (3, "", "", "", 0)]
    got = media.digests(media.encode(spark.createDataFrame(rows, fields))).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["1", "1", "2", "3", "None"]
    same = {tuple(v for c, v in r.asDict().items() if c not in ("doc_id", "segments")) for r in got if r["doc_id"] in (1, 2)}
    assert len(same) == 1 and {r["n_bytes"] for r in got if r["doc_id"] in (1, 2)} == {len("same text é".encode())}
    nothing = {r["payload_sha256"] for r in got if r["doc_id"] not in (1, 2)}
    assert nothing == {hashlib.sha256(bytes(64)).hexdigest()}
    none = media.encode(spark.createDataFrame([], fields))
    assert none.count() == 0 and media.digests(none).count() == 0 and media.features(none).count() == 0
