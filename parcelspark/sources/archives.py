"""Chip and embedding archives: one small numpy file per (parcel, date), read into and written from tables."""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

CHIP_SCHEMA = (
    "parcel_id string, obs_date date, lat double, lon double, gsd double, bands array<string>, "
    "pixels array<array<int>>, height int, width int"
)
OBSERVATION_SCHEMA = "parcel_id string, obs_date date, embedding array<float>"


def _files(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", f"*.{suffix}")
        .load(folder)
        .where(~F.contains(F.col("path"), F.lit("/_writing-")))
        .select(
            F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("folder"),
            F.regexp_extract("path", rf"([^/]+)\.{suffix}$", 1).alias("stem"),
            "content",
        )
    )


def read_chip_archive(spark: SparkSession, folder: str) -> DataFrame:
    """Chips of a `<parcel>/<date>.npz` tree. A file that cannot be decoded keeps its row with null pixels."""

    def decode(batches):
        for batch in batches:
            rows = [_decode_chip(f, s, c) for f, s, c in zip(batch["folder"], batch["stem"], batch["content"])]
            yield pd.DataFrame(rows, columns=["parcel_id", "day", "lat", "lon", "gsd", "bands", "pixels", "height", "width"])

    raw_schema = CHIP_SCHEMA.replace("obs_date date", "day string")
    return _files(spark, folder, "npz").mapInPandas(decode, raw_schema).select(
        "parcel_id", F.try_to_date("day").alias("obs_date"), "lat", "lon", "gsd", "bands", "pixels", "height", "width"
    )


def _decode_chip(folder: str, stem: str, content: bytes) -> tuple:
    try:
        data = np.load(io.BytesIO(content), allow_pickle=False)
        pixels = data["pixels"].astype(int)
        _, height, width = pixels.shape
        return (
            str(data["parcel_id"]), str(data["date"]), float(data["lat"]), float(data["lon"]), float(data["gsd"]),
            [str(b) for b in data["bands"]], list(pixels.reshape(len(pixels), -1)), height, width,
        )
    except Exception:
        return folder, stem, None, None, None, None, None, None, None


def read_embedding_archive(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors of a `<parcel>/<date>.npy` tree; stems that are no date give a null date, bad files no vector."""

    def load(content: bytes):
        try:
            return np.load(io.BytesIO(content), allow_pickle=False).astype(np.float32).ravel()
        except Exception:
            return None

    def decode(batches):
        for batch in batches:
            yield pd.DataFrame(
                {"parcel_id": batch["folder"], "day": batch["stem"], "embedding": [load(c) for c in batch["content"]]}
            )

    raw = _files(spark, folder, "npy").mapInPandas(decode, OBSERVATION_SCHEMA.replace("obs_date date", "day string"))
    return raw.select("parcel_id", F.try_to_date("day").alias("obs_date"), "embedding")


def decode_outcomes(chips: DataFrame) -> DataFrame:
    outcome = F.when(F.col("pixels").isNull(), "skipped").otherwise("decoded")
    return chips.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


class Archive(DataSource):
    """A tree of small numpy files `<parcel>/<date>.npy` (vectors) or `.npz` (chips), for `df.write.format("parcel_archive")`.

    The folder is a URI or path of any store that Arrow's file systems know; nothing lies on an executor's own disk. A
    task writes its files under a hidden folder of its own, moves them in place one by one when all are written, and
    leaves nothing if it fails; a repeated task replaces whole files.
    """

    @classmethod
    def name(cls) -> str:
        return "parcel_archive"

    def schema(self) -> str:
        return "parcel_id string, day string, content binary"

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["folder"], self.options["suffix"])


@dataclass
class Written(WriterCommitMessage):
    files: int


class ArchiveWriter(DataSourceWriter):
    def __init__(self, folder: str, suffix: str) -> None:
        self.folder, self.suffix = folder, suffix
        self.aside = f"_writing-{uuid.uuid4().hex}"

    def write(self, rows: Iterator[Row]) -> Written:
        store, root = open_store(self.folder)
        aside = f"{root}/{self.aside}/{uuid.uuid4().hex}"
        made: list[str] = []
        try:
            store.create_dir(aside, recursive=True)
            for row in rows:
                place = f"{quote(row['parcel_id'], safe=' ')}/{row['day']}.{self.suffix}"
                with store.open_output_stream(f"{aside}/{len(made)}") as out:
                    out.write(bytes(row["content"]))
                made.append(place)
            for i, place in enumerate(made):
                store.create_dir(f"{root}/{place.rsplit('/', 1)[0]}", recursive=True)
                store.move(f"{aside}/{i}", f"{root}/{place}")
        finally:
            if store.get_file_info(aside).type != fs.FileType.NotFound:
                store.delete_dir(aside)
        return Written(len(made))

    def _clear(self) -> None:
        store, root = open_store(self.folder)
        if store.get_file_info(f"{root}/{self.aside}").type != fs.FileType.NotFound:
            store.delete_dir(f"{root}/{self.aside}")

    def commit(self, messages: list[Written]) -> None:
        self._clear()

    def abort(self, messages: list[Written]) -> None:
        self._clear()


def open_store(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and the path in it."""
    if folder.startswith("file:") and not folder.startswith("file://"):
        folder = folder.removeprefix("file:")
    store, root = fs.FileSystem.from_uri(folder)
    return store, root.rstrip("/")


def _write(rows: DataFrame, folder: str, suffix: str) -> None:
    rows.sparkSession.dataSource.register(Archive)
    rows.write.format("parcel_archive").mode("append").option("folder", folder).option("suffix", suffix).save()


def write_embedding_archive(observations: DataFrame, folder: str) -> None:
    """Write `<parcel>/<date>.npy` files, one for each row."""

    def pack(batches):
        for batch in batches:
            yield batch[["parcel_id", "day"]].assign(content=[_saved(np.save, np.asarray(v, dtype=np.float32)) for v in batch["embedding"]])

    rows = observations.select("parcel_id", F.col("obs_date").cast("string").alias("day"), "embedding")
    _write(rows.mapInPandas(pack, "parcel_id string, day string, content binary"), folder, "npy")


def _saved(save, *arrays, **named) -> bytes:
    out = io.BytesIO()
    save(out, *arrays, **named)
    return out.getvalue()


def write_chip_archive(chips: DataFrame, folder: str) -> None:
    """Write `<parcel>/<date>.npz` files, one for each chip with pixels."""

    def pack(batches):
        for batch in batches:
            packed = []
            for row in batch.to_dict("records"):
                pixels = np.array([np.asarray(b) for b in row["pixels"]], dtype=np.uint16)
                packed.append(
                    _saved(
                        np.savez_compressed,
                        pixels=pixels.reshape(len(pixels), row["height"], row["width"]),
                        parcel_id=row["parcel_id"], date=row["day"], lat=row["lat"], lon=row["lon"], gsd=row["gsd"],
                        bands=np.array(list(row["bands"]), dtype=str),
                    )
                )
            yield batch[["parcel_id", "day"]].assign(content=packed)

    rows = chips.where(F.col("pixels").isNotNull()).select("*", F.col("obs_date").cast("string").alias("day")).drop("obs_date")
    _write(rows.mapInPandas(pack, "parcel_id string, day string, content binary"), folder, "npz")
