"""Colour histograms over every pixel of a box."""

import numpy as np
import pytest

from duskline.operators import inference
from duskline.plans.ingest import colour_histograms
from duskline.plans.views import table
from test_task_memory import frame


def counted(pixels):
    b, g, r = (pixels.reshape(-1, 3) >> 6).T.astype(int)
    return list(np.bincount(16 * r + 4 * g + b, minlength=64) / len(b))


@pytest.mark.parametrize("width,height,box", [(1, 1, (0, 0, 1, 1)), (200, 90, (0.1, 0.2, 0.93, 1.0)), (3000, 7, (0.01, 0.2, 1, 1)),
                                              (70, 900, (0.5, 0, 0.51, 1)), (60, 3000, (0, 0, 1, 1))])
def test_every_pixel_counts(spark, width, height, box):
    stride = width * 3 + 5
    payload = np.random.default_rng(5).integers(0, 256, stride * height, dtype=np.uint8).tobytes()
    got = inference.histograms(frame(spark, payload, stride, width, height, tuple(map(float, box))), cells=None)[0].collect()
    l, t = int(np.floor(box[0] * width)), int(np.floor(box[1] * height))
    r, b = int(np.ceil(box[2] * width)), int(np.ceil(box[3] * height))
    lines = np.frombuffer(payload, np.uint8).reshape(height, stride)[t:b, 3 * l:3 * r]
    assert [(x.sample_count, x.vals) for x in got] == [((r - l) * (b - t), counted(lines.reshape(-1)))]


def test_whole_texts_count(spark, sf):
    got = {r.observation_id: r for r in colour_histograms(spark, sf).collect()}
    texts = {f"d{r.doc_id}": r.text.encode() for r in table(spark, sf, "documents").select("doc_id", "text").collect()}
    texts = {k: v[:len(v) // 3 * 3] for k, v in texts.items() if len(v) >= 3}
    assert got.keys() == texts.keys() and max(map(len, texts.values())) > 3 * 4096
    for k, v in texts.items():
        assert got[k].sample_count == len(v) // 3 and got[k].vals == counted(np.frombuffer(v, np.uint8))
