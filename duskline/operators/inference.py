"""User models inside Spark tasks, colour histograms of image regions, and the frame clock."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scale import Columns, fold_sorted

PredictFn = Callable[[pd.DataFrame], pd.DataFrame]
REFUSED = ("face", "license_plate")


def predict(frames: DataFrame, make_predict_fn: Callable[[], PredictFn], schema: str) -> DataFrame:
    """Run a user model over batches. The model is built once per task, and inputs must come back unchanged."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model: PredictFn | None = None
        for batch in batches:
            model = model or make_predict_fn()
            before = pd.util.hash_pandas_object(batch, index=False).sum() if not batch.empty else 0
            out = model(batch)
            if not batch.empty and pd.util.hash_pandas_object(batch, index=False).sum() != before:
                raise RuntimeError("the model changed its input")
            yield out

    return frames.mapInPandas(run, schema)


def stub_model() -> PredictFn:
    """A deterministic stand-in: one box per frame from the payload length."""
    def run(batch: pd.DataFrame) -> pd.DataFrame:
        n = batch["payload"].map(len)
        return pd.DataFrame({"frame_index": batch["frame_index"], "category": "object", "confidence": (n % 100) / 100.0,
                             "x_min": 0.1, "y_min": 0.1, "x_max": 0.5, "y_max": 0.5})

    return run


#: Bytes of pixels of a box that travel to Python in one row, so a batch of rows is small however large the boxes are.
PIECE = 4_096


def histograms(frames: DataFrame, key: Sequence[str] = ("observation_id",), cells: int | None = 64) -> tuple[DataFrame, DataFrame]:
    """64-bin colour histograms of boxes in BGR24 frames: (descriptors, refusals).

    ``frames``: key, category, payload, width, height, stride_bytes, frame_sha256 and a normalised box. Refused: face
    and plate categories, buffers of the wrong length or digest, and boxes that round to nothing. ``cells``: pixels looked at
    in a line and lines looked at, as in the descriptor model_free.color_histogram.v1; with None every pixel of a box counts.
    """
    key = list(key)
    left, top = F.floor(F.col("x_min") * F.col("width")), F.floor(F.col("y_min") * F.col("height"))
    right, bottom = F.ceil(F.col("x_max") * F.col("width")), F.ceil(F.col("y_max") * F.col("height"))
    reason = (
        F.when(F.col("category").isin(*REFUSED), "category")
        .when((F.length("payload") != F.col("height") * F.col("stride_bytes")) | (F.col("stride_bytes") < F.col("width") * 3), "layout")
        .when(F.sha2("payload", 256) != F.col("frame_sha256"), "digest")
        .when((left >= right) | (top >= bottom), "empty_crop"))
    tagged = frames.withColumn("reason", reason).withColumns({"_l": left, "_t": top, "_r": right, "_b": bottom})
    types = {f.name: f.dataType.simpleString() for f in frames.schema}
    schema = ", ".join([*[f"{k} {types[k]}" for k in key], "category string", "vals array<double>", "sample_count long"])

    def looked_at(low: str, high: str) -> str:
        n = f"least({high} - {low}, {cells}L)"
        return f"transform(sequence(0L, {n} - 1), i -> {low} + ((2 * i + 1) * ({high} - {low})) div (2 * {n}))"

    def run_of(pixels: str) -> str:
        return f"substring(payload, cast(y * stride_bytes + x * 3 + 1 as int), cast(3 * ({pixels}) as int))"

    # Only the pixels that are looked at travel to Python, not the frames: a box as pieces, each a list of runs of pixels.
    if cells is None:
        wide, area = f"least(_r - _l, {PIECE // 3}L)", "(_r - _l) * (_b - _t)"
        tall = f"greatest({PIECE // 3}L div ({wide}), 1L)"
        n = f"((_r - _l + {wide} - 1) div ({wide})) * ((_b - _t + {tall} - 1) div ({tall}))"
        pieces = (f"flatten(transform(sequence(_t, _b - 1, {tall}), y0 -> transform(sequence(_l, _r - 1, {wide}), x -> "
                  f"transform(sequence(y0, least(y0 + {tall}, _b) - 1), y -> {run_of(f'least({wide}, _r - x)')}))))")
    else:
        area = f"least(_r - _l, {cells}L) * least(_b - _t, {cells}L)"
        n = "1L"
        pieces = f"array(flatten(transform({looked_at('_t', '_b')}, y -> transform({looked_at('_l', '_r')}, x -> {run_of('1')}))))"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_box = np.zeros(64, dtype=np.int64)  # of the box whose last piece is still to come
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                got, area, last = batch.column("pixels"), batch.column("area").to_numpy(), batch.column("last").to_numpy(zero_copy_only=False)
                runs, flat = got.value_lengths().to_numpy().astype(np.int64), got.flatten()
                ends = np.frombuffer(flat.buffers()[1], np.int32)[flat.offset:flat.offset + len(flat) + 1]
                sizes = np.diff(ends[np.concatenate([[0], np.cumsum(runs)])])
                px = np.frombuffer(flat.buffers()[2], np.uint8)[ends[0]:ends[-1]]
                if (sizes % 3).any():
                    raise ValueError("a box reaches out of its frame")
                px = px.reshape(-1, 3) >> 6
                box = np.cumsum(last) - last  # pieces of a box follow one another
                done = np.flatnonzero(last)
                counts = np.bincount(64 * np.repeat(box, sizes // 3) + 16 * px[:, 2] + 4 * px[:, 1] + px[:, 0],
                                     minlength=64 * (len(done) + 1)).reshape(-1, 64)
                counts[0] += open_box
                open_box, counts = counts[len(done)], counts[:len(done)]
                if not len(done):
                    continue
                if (counts.sum(axis=1) != area[done]).any():
                    raise ValueError("a box reaches out of its frame")
                vals = counts / area[done][:, None]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, 64 * len(done) + 1, 64, dtype=np.int32)), pa.array(vals.ravel()))
                heads = batch.take(pa.array(done))
                yield pa.RecordBatch.from_arrays([*[heads.column(k) for k in key], heads.column("category"), lists, heads.column("area")],
                                                 names=[*key, "category", "vals", "sample_count"])

    boxes = tagged.filter("reason is null").select(*key, "category", *[
        F.expr(f"case when reason is null then {e} end").alias(x) for x, e in (("area", area), ("_n", n), ("_pieces", pieces))])
    good = boxes.select(*key, "category", "area", "_n", F.posexplode_outer("_pieces").alias("_i", "pixels")).select(
        *key, "category", "area", (F.col("_i") == F.col("_n") - 1).alias("last"), "pixels")
    return good.mapInArrow(run, schema), tagged.filter("reason is not null").select(*key, "reason")


def repair_clock(frames: DataFrame, key: Sequence[str] = ("source_id", "session_id")) -> DataFrame:
    """``elapsed_ms`` per frame: the media position while it moves forward, else the nominal index·1000/fps.

    ``frames``: key, frame_index, position_ms, fps. Rows from the first frame no clock can order get NULL, as does
    everything after it. Sessions are read in order, a slice at a time, so they may have any length.
    """
    key = list(key)
    types = {f.name: f.dataType.simpleString() for f in frames.schema}

    class Clock:
        at, last, first, stopped = 0, -1, float("nan"), False

    def take(clock: Clock, c: Columns) -> Columns:
        pos, fps = c["position_ms"].astype(float), c["fps"].astype(float)
        out = np.full(len(pos), None, dtype=object)
        if clock.at == 0:
            clock.first = pos[0]
        media = np.isfinite(clock.first) and clock.first >= 0
        for i in range(len(pos)):
            if clock.stopped:
                break
            moved = pos[i] - clock.first if media else -1.0
            now = round(moved) if np.isfinite(moved) and moved >= 0 else -1
            if now <= clock.last:
                now = round((clock.at + i) * 1000.0 / fps[i])
            if now <= clock.last:
                clock.stopped = True
                break
            out[i] = clock.last = now
        clock.at += len(pos)
        return {**{k: c[k] for k in key}, "frame_index": c["frame_index"], "elapsed_ms": out}

    return fold_sorted(frames.select(*key, "frame_index", "position_ms", "fps"), key, ["frame_index"], Clock, take,
                       lambda clock: None, ", ".join([*[f"{k} {types[k]}" for k in key], "frame_index long, elapsed_ms long"]))
