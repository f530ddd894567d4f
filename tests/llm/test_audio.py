import io
import wave

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import audio


def wav(samples):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(audio.RATE)
        w.writeframes((np.clip(samples, -1, 1) * 20000).astype("<i2").tobytes())
    return out.getvalue()


def tune(seed):
    return audio.melody(np.random.default_rng(seed).standard_normal(64).tolist())


def errors(a, b, offset):
    lo, hi = max(0, -offset), min(len(a), len(b) - offset)
    if hi - lo < audio.MIN_OVERLAP:
        return None
    return sum(int(x & 0xFFFFFFFF ^ y & 0xFFFFFFFF).bit_count() for x, y in zip(a[lo:hi].tolist(), b[lo + offset : hi + offset].tolist())) / (32 * (hi - lo))


def test_recordings_are_aligned(spark):
    r = np.random.default_rng(9)
    base = [tune(k) for k in range(4)]
    clips = [(k, wav(base[k])) for k in range(4)]
    clips += [(10 + k, wav(np.concatenate([tune(50 + k)[: 4 * audio.NOTE], base[k]]) + 0.02 * r.standard_normal(len(base[k]) + 4 * audio.NOTE))) for k in range(4)]
    clips += [(20, wav(base[0])), (21, None), (22, b"junk"), (23, wav(np.zeros(100))), (24, wav(np.zeros(9000))), (None, wav(base[1])), (10, clips[4][1])]
    df = spark.createDataFrame(clips, "rec_id long, audio binary").repartition(3)
    prints = audio.fingerprints(df, F.col("rec_id"), F.col("audio"))
    got = {r.rec_id: r for r in audio.align(prints, F.col("rec_id") < 5).collect()}
    assert audio.align(prints, F.col("rec_id") < 5).count() == len(clips)
    for k in range(4):
        assert got[k].n_matches == 1 and got[k].best_class == 10 + k and got[k].best_offset == 4 * audio.NOTE // audio.HOP and got[10 + k].n_matches is None
    assert got[20].class_id == 0 and got[None].class_id == 1 and got[20].n_matches == 1
    assert [got[i].n_frames for i in (21, 22, 23)] == [0, 0, 0] and got[21].class_id == 21 and got[24].class_id == 24
    assert audio.align(prints.limit(0), F.col("rec_id") < 5).count() == 0
    fps = {i: audio.packed(audio.chroma(audio.decode_wav(a))) for i, a in clips if i is not None}
    for k in range(4):  # against every offset of every other recording
        best = min((e, j, o) for j in fps if len(fps[j]) and j not in (k, 20) for o in range(-90, 91) if (e := errors(fps[k], fps[j], o)) is not None)
        assert best[1] == 10 + k and best[2] == got[k].best_offset and abs(best[0] - got[k].best_error) < 1e-5


def test_filters_from_the_integral_image_are_sums_of_rectangles():
    frames = np.random.default_rng(2).random((40, 12))
    got = audio.packed(frames)
    for t in (0, 5, len(got) - 1):
        value = 0
        for f in audio.filter_bank():
            side = lambda rects: 1e-2 + sum(frames[t + a : t + a + w, y : y + h].sum() for a, w, y, h in rects)
            value = value << 2 | audio.GRAY[np.searchsorted(audio.STEPS, np.log(side(f.plus) / side(f.minus)))]
        assert value == int(got[t]) & 0xFFFFFFFF


def test_query_finds_the_takes(spark):
    rows = [(k, np.random.default_rng(k).standard_normal(64).tolist()) for k in range(45)] + [(60, None), (None, None)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    prints = audio.fingerprints(audio.recordings(vectors), F.col("rec_id"), F.col("audio"), lambda a: audio.melody(**a))
    got = {r.rec_id: r for r in audio.align(prints, F.col("rec_id") % 20 == 0).collect()}
    assert len(got) == 47 and sum(got[k].n_matches for k in (0, 20, 40)) == 6 and got[60].n_frames == 0


def test_recall_against_every_offset_with_bit_errors(spark):
    r = np.random.default_rng(3)
    base = r.integers(-(2**31), 2**31, (40, 117)).astype(np.int32)
    rows, of = [(k, base[k].tolist()) for k in range(40)], {}
    for k in range(40):
        for n, share in ((117, 0.10), (117, 0.14), (24, 0.04), (24, 0.08)):
            cut = r.integers(0, 118 - n)
            wrong = np.packbits(r.random((n, 32)) < share, axis=1).view(">u4")[:, 0].astype(np.uint32).view(np.int32)
            of[len(rows)] = k, cut
            rows.append((len(rows), (base[k, cut : cut + n] ^ wrong).tolist()))
    got = {x.rec_id: x for x in audio.align(spark.createDataFrame(rows, "rec_id long, fp array<int>"), F.col("rec_id") >= 40).collect()}
    fps = {i: np.array(fp, np.int32) for i, fp in rows}
    for kind in range(4):
        want = {i: k for i, (k, cut) in of.items() if i % 4 == kind and errors(fps[i], fps[k], cut) <= audio.MAX_BIT_ERRORS}
        found = sum(got[i].n_matches > 0 for i in want)
        assert len(want) >= 30 and found >= 0.9 * len(want), (kind, found, len(want))


def test_a_long_run_of_one_integer_is_aligned(spark):
    prints = spark.createDataFrame([(0, [7] * 30), (20, [7] * 40)], "rec_id long, fp array<int>")
    assert {x.rec_id: x.n_matches for x in audio.align(prints, F.lit(True)).collect()} == {0: 1, 20: 1}


def test_query_hears_every_row_itself(spark, tmp_path):
    vector = lambda k: np.random.default_rng(k).standard_normal(64).tolist()
    # 41 and 62 leave 1 and 2 by twenty, after rows that are there
    rows = [(k, vector(20 if k in (41, 62) else k)) for k in (20, 40, 41, 60, 62)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r.vec_id: r for r in audio.op7_chroma_fingerprints(spark, str(tmp_path)).collect()}
    assert {k: r.n_matches for k, r in got.items()} == {20: 2, 40: 0, 60: 0, 41: None, 62: None} and got[20].best_class == 41 and got[20].best_error == 0
