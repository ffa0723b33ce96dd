"""FTRL as a Spark ML estimator."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.ml import Estimator, Model
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.operators import encode, ftrl


def hashed_slots(df: DataFrame, columns: list[str], size: int, interactions: bool) -> DataFrame:
    return (encode.hash_interactions if interactions else encode.hash_features)(df, columns, size)


class _Writer(MLWriter):
    """Saves the settings as metadata, and the state of a fitted model as a table beside them."""

    def __init__(self, stage: FtrlModel | FtrlEstimator):
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.stage, path, self.sparkSession, extraMetadata={"settings": self.stage.saved()})
        if isinstance(self.stage, FtrlModel):
            self.stage.state.write.parquet(f"{path}/state")


class _Reader(MLReader):
    def __init__(self, kind: type):
        super().__init__()
        self.kind = kind

    def load(self, path: str) -> FtrlModel | FtrlEstimator:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        values = {**metadata["settings"], "params": ftrl.Ftrl(**metadata["settings"]["params"])}
        if self.kind is FtrlModel:
            values["state"] = self.sparkSession.read.parquet(f"{path}/state")
        stage = self.kind(**values)
        stage._resetUid(metadata["uid"])
        return stage


class _Saved(MLWritable, MLReadable):
    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class FtrlModel(Model, _Saved):
    """Adds the click probability ``p`` to rows with a unique ``row_key``."""

    def __init__(self, state: DataFrame, columns: list[str], params: ftrl.Ftrl, row_key: str, interactions: bool):
        super().__init__()
        self.state = state
        self.columns = columns
        self.settings = params
        self.row_key = row_key
        self.interactions = interactions

    def saved(self) -> dict[str, object]:
        return {"columns": self.columns, "params": asdict(self.settings), "row_key": self.row_key, "interactions": self.interactions}

    def _transform(self, dataset: DataFrame) -> DataFrame:
        # Rows are scored with all their columns, so none has to be found again.
        slots = hashed_slots(dataset, self.columns, self.settings.size, self.interactions)
        return ftrl.score(slots, self.state, self.settings).select(*dataset.columns, "p")


class FtrlEstimator(Estimator, _Saved):
    """Hashes the columns of labelled rows and fits FTRL on them in mini-batches."""

    def __init__(
        self,
        columns: list[str],
        label: str = "click",
        params: ftrl.Ftrl = ftrl.Ftrl(),
        epochs: int = 5,
        batches: int | None = None,
        row_key: str = "ID",
        time: str = "datetime",
        interactions: bool = False,
    ):
        super().__init__()
        barred = {row_key, label} & set(columns)
        if barred:
            raise ValueError(f"{sorted(barred)} must not be hashed as features")
        self.columns = columns
        self.label = label
        self.settings = params
        self.epochs = epochs
        self.batches = batches
        self.row_key = row_key
        self.time = time
        self.interactions = interactions

    def saved(self) -> dict[str, object]:
        names = ("columns", "label", "epochs", "batches", "row_key", "time", "interactions")
        return {"params": asdict(self.settings), **{n: getattr(self, n) for n in names}}

    def _fit(self, dataset: DataFrame) -> FtrlModel:
        slots = hashed_slots(dataset, self.columns, self.settings.size, self.interactions)
        held = ["holdout"] if "holdout" in dataset.columns else []
        rows = slots.select(self.row_key, self.time, F.col(self.label).cast("double").alias("y"), "x", *held)
        fitted = ftrl.fit(rows, self.settings, self.epochs, self.batches, (self.time, self.row_key))
        return FtrlModel(fitted.best_state, self.columns, self.settings, self.row_key, self.interactions)
