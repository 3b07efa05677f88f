"""Sound files in byte ranges."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from tidemark.sources import pcm
from tidemark.sources.readers import StageCounts, segment_topics


def wav(values, rate=16000, extra=b"", claimed=None):
    data = struct.pack(f"<{len(values)}h", *values)
    form = struct.pack("<HHIIHH", 1, 1, rate, rate * 2, 2, 16)
    body = b"WAVE" + b"fmt " + struct.pack("<I", 16) + form + extra + b"data" + struct.pack("<I", len(data) if claimed is None else claimed) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


@pytest.mark.parametrize("split", [50, 97, 1000, 1 << 20])
def test_files_are_cut_by_bytes(spark, tmp_path, split):
    rnd = random.Random(1)
    clips = {"a": [rnd.randint(-32768, 32767) for _ in range(1234)], "empty": [], "one": [7], "list": list(range(80)), "cut": list(range(50))}
    for name, values in clips.items():
        extra = b"LIST" + struct.pack("<I", 5) + b"hello\x00" if name == "list" else b""
        (tmp_path / f"{name}.wav").write_bytes(wav(values, extra=extra, claimed=10**9 if name == "cut" else None))
    (tmp_path / "fast.wav").write_bytes(wav([1, 2], rate=44100))
    (tmp_path / "text.wav").write_bytes(b"hello" * 100)
    (tmp_path / "none.wav").write_bytes(b"")
    (tmp_path / "_hidden.wav").write_bytes(b"x")
    df = pcm.read_pcm_samples(spark, str(tmp_path), frame=16, split_bytes=split)
    rows = df.collect()
    errors = {r["clip_id"]: r["error"] for r in rows if r["error"]}
    assert errors == {"fast.wav": "not mono 16 kHz 16-bit PCM", "text.wav": "not a WAV file", "none.wav": "not a WAV file"}
    for name, values in clips.items():
        own = sorted((r for r in rows if r["clip_id"] == f"{name}.wav"), key=lambda r: r["frame_index"])
        assert [r["frame_index"] for r in own] == list(range(-(-len(values) // 16)))
        assert [x * 32768 for r in own for x in r["samples"]] == values
    if split == 50:
        assert df.where("clip_id = 'a.wav'").select(F.spark_partition_id()).distinct().count() > 10  # one file in many tasks


def test_written_clips_are_read_back(spark, tmp_path):
    rows = [(k, i, (i * 37 + k * 11) % 60000 - 30000) for k in (1, 2) for i in range(500 * k)] + [(None, 0, 1), (2, -5, None)]
    df = spark.createDataFrame(rows, "clip int, i int, v int").repartition(6)
    done = {r["clip"]: r["samples"] for r in pcm.write_pcm(df, f"{tmp_path}/out", "clip", "i", "v").collect()}
    assert done == {"1": 500, "2": 1000}
    back = pcm.read_pcm_samples(spark, f"{tmp_path}/out", split_bytes=300).orderBy("clip_id", "frame_index").collect()
    for k in (1, 2):
        assert [round(x * 32768) for r in back if r["clip_id"] == f"{k}.wav" for x in r["samples"]] == [v for c, _, v in rows if c == k and v is not None]


def test_stage_counts_and_segmenters(spark):
    counts = StageCounts()
    first = counts.watch("all", spark.range(100), "id")
    last = counts.watch("odd", first.where("id % 2 = 1"))
    last.write.format("noop").mode("overwrite").save()
    assert [tuple(r) for r in counts.table(spark).orderBy("place").collect()] == [("all", 0, 100, 0.0, 99.0), ("odd", 1, 50, None, None)]
    with pytest.raises(ValueError, match="no segmenter 'nosuch'"):
        segment_topics("nosuch", spark.range(1))


def test_many_short_files_share_tasks(tmp_path, monkeypatch):
    monkeypatch.setattr(pcm, "TASKS", 10)
    for k in range(60):
        (tmp_path / f"{k:02}.wav").write_bytes(wav(list(range(100 + k))))
    parts = pcm.PcmReader(str(tmp_path), 16, 50).partitions()
    assert len(parts) <= 11  # one a byte range before: over 300
    pieces = [p for part in parts for p in part.parts]
    for k in range(60):
        own = [(begin, end) for path, _, begin, end in pieces if path.endswith(f"/{k:02}.wav")]
        assert own[0][0] == 0 and own[-1][1] == 44 + 2 * (100 + k) and all(a[1] == b[0] for a, b in zip(own, own[1:], strict=False))
    frames = [b.to_pydict() for part in parts for b in pcm.PcmReader(str(tmp_path), 16, 50).read(part)]
    read = {}
    for f in frames:
        for name, i, samples in zip(f["clip_id"], f["frame_index"], f["samples"], strict=True):
            read.setdefault(name, []).append((i, samples))
    for k in range(60):
        assert [round(x * 32768) for _, s in sorted(read[f"{k:02}.wav"]) for x in s] == list(range(100 + k))
