"""SNK-1: persist and reload fitted pipelines/models."""

from __future__ import annotations

from pyspark.ml import PipelineModel


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str, cls=PipelineModel):
    return cls.load(path)
