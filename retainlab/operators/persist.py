"""Saving and loading of models whose state is more than parameters.

A model keeps its matrices as Parquet tables and its inner models in folders of
their own, beside the usual metadata, so it can be saved alone or as a stage of a
``PipelineModel``.
"""

from __future__ import annotations

from pyspark.ml.util import (DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable,
                             MLWriter)
from pyspark.sql import SparkSession


class _StateWriter(MLWriter):
    def __init__(self, instance: "StateWritable"):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        self.instance.save_state(self.sparkSession, path)


class _StateReader(MLReader):
    def __init__(self, cls: type):
        super().__init__()
        self.cls = cls

    def load(self, path: str):
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.cls()
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        model.load_state(self.sparkSession, path)
        return model


class StateWritable(MLWritable, MLReadable):
    """A model with ``save_state`` and ``load_state`` beside its parameters."""

    def write(self) -> MLWriter:
        return _StateWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _StateReader(cls)

    def save_state(self, spark: SparkSession, path: str) -> None:
        raise NotImplementedError

    def load_state(self, spark: SparkSession, path: str) -> None:
        raise NotImplementedError
