"""Saving and loading of the fitted models that are written in Python (SNK-1).

A model states its learned values as plain JSON (``_state``) and the Spark ML
models that it holds (``_parts``); both are written next to its parameters
through Spark's file system, so that a saved model, alone or inside a
``PipelineModel``, is read back on any cluster that sees the folder.
"""

from __future__ import annotations

from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter


class _StateWriter(MLWriter):
    def __init__(self, model):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession, {"state": self.model._state()})
        for i, part in enumerate(self.model._parts()):
            part.write().save(f"{path}/part-{i}")


class _StateReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str):
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.cls._from_state(metadata["state"], path)
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


class SavedState(MLWritable, MLReadable):
    """Mixin of models with ``_state``, ``_parts`` and ``_from_state(state, path)``."""

    def _parts(self) -> list:
        return []

    def write(self) -> MLWriter:
        return _StateWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _StateReader(cls)
