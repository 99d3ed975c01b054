"""Named stages that several reports share: computed once for a state of their inputs, kept in the shared folder."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from tidecase.sources.scratch import file_system, session_folder


class StageStore:
    """``StageStore(spark).get("name", [inputs], build)`` returns the stored stage, or builds, stores and returns it.

    A stage belongs to a name and a version of its inputs: paths, sizes and times of change of the files that they read. Changed inputs
    make another stage. A stage is written beside its place and moved there when it is whole, so a failed run leaves none, lost executors cost part of one
    stage, and of two writers one wins. Without ``folder`` stages live in the session's folder and go with it; in a
    folder of one's own ``expire`` removes those that are too old.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.folder = folder or f"{session_folder(spark)}/stages"

    def version(self, inputs: Sequence[DataFrame]) -> str:
        """Hash of the files that the inputs read; folders are listed once each."""
        files = sorted({f for df in inputs for f in df.inputFiles()})
        found: dict[str, tuple[int, int]] = {}
        for parent in sorted({f.rpartition("/")[0] for f in files}):
            fs, place = file_system(self.spark, parent)
            for status in fs.listStatus(place):
                found[status.getPath().toUri().getPath()] = (status.getLen(), status.getModificationTime())
        own = [(f, *found.get(file_system(self.spark, f)[1].toUri().getPath(), (0, 0))) for f in files]
        return hashlib.sha256(json.dumps(own).encode()).hexdigest()[:24]

    def path(self, name: str, inputs: Sequence[DataFrame]) -> str:
        return f"{self.folder}/{name}-{self.version(inputs)}"

    def get(self, name: str, inputs: Sequence[DataFrame], build: Callable[[], DataFrame]) -> DataFrame:
        made: list[DataFrame] = []  # built once, as building may store steps

        def write(to: str) -> None:
            made.append(build())
            made[0].write.parquet(to)

        path = self.place(name, inputs, write, lambda: made[0].schema)
        return self.spark.read.schema(self._schema(path)).parquet(f"{path}/data")

    def place(self, name: str, inputs: Sequence[DataFrame], write: Callable[[str], object], schema: Callable[[], StructType] | None = None) -> str:
        """The folder of the stage, whose ``data`` is what ``write`` writes at the path it is given."""
        path = self.path(name, inputs)
        fs, final = file_system(self.spark, path)
        if fs.exists(final):
            return path
        beside = f"{self.folder}/_{name}-{uuid.uuid4().hex}"
        write(f"{beside}/data")
        if schema is not None:
            self._note(f"{beside}/schema.json", schema().json())
        _, draft = file_system(self.spark, beside)
        if fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, True)
        return path

    def _note(self, path: str, text: str) -> None:
        fs, place = file_system(self.spark, path)
        out = fs.create(place, True)
        out.write(bytearray(text.encode()))
        out.close()

    def _schema(self, path: str) -> StructType:
        (row,) = self.spark.read.text(f"{path}/schema.json", wholetext=True).collect()
        return StructType.fromJson(json.loads(row[0]))

    def expire(self, seconds: float) -> list[str]:
        """Remove stages written longer than ``seconds`` ago, unfinished ones too; returns their names."""
        fs, place = file_system(self.spark, self.folder)
        gone = []
        if fs.exists(place):
            for status in fs.listStatus(place):
                if status.getModificationTime() <= (time.time() - seconds) * 1000:
                    fs.delete(status.getPath(), True)
                    gone.append(status.getPath().getName())
        return gone
