"""Running a pluggable model over images."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Model = Callable[[pd.DataFrame], pd.DataFrame]


def score(images: DataFrame, load: Callable[[], Model], schema: str, batch: int = 16, timings: bool = False) -> DataFrame:
    """Detections of a model. ``load`` runs once per task and returns a function from a batch of image rows to result rows.

    With ``timings`` each result row carries ``inference_ms``, the time per image of its batch; ``schema`` must name it.
    """

    def run(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for pdf in chunks:
            for a in range(0, len(pdf), batch):
                part = pdf.iloc[a : a + batch]
                t = time.perf_counter()
                out = model(part)
                if timings:
                    out = out.assign(inference_ms=(time.perf_counter() - t) * 1000 / len(part))
                yield out

    return images.mapInPandas(run, schema)


def embed(images: DataFrame, load: Callable[[], Callable[[pd.DataFrame], list]], key: str = "image_id", batch: int = 16) -> DataFrame:
    """One vector per image: ``key, embedding``."""
    kind = images.schema[key].dataType.simpleString()

    def wrap():
        model = load()
        return lambda pdf: pd.DataFrame({key: pdf[key].to_numpy(), "embedding": list(model(pdf))})

    return score(images, wrap, f"{key} {kind}, embedding array<float>", batch)


def auto_annotate(images: DataFrame, detect: Callable[[], Model], segment: Callable[[], Model], det_schema: str, seg_schema: str, batch: int = 16) -> DataFrame:
    """Boxes from one model prompt another that returns polygons; the class comes from the box.

    ``segment`` sees image rows with a ``boxes`` array and returns one row per box with ``image_id, det_id, polygon``. An
    image's boxes are one detector call's output, so the array is bounded by what the detector returns.
    """
    det = score(images, detect, det_schema, batch)
    box = F.struct("det_id", "x1", "y1", "x2", "y2")
    prompts = det.groupBy("image_id").agg(F.sort_array(F.collect_list(box)).alias("boxes"))
    poly = score(images.join(prompts, "image_id"), segment, seg_schema, batch)
    return poly.join(det.select("image_id", "det_id", "cls"), ["image_id", "det_id"])
