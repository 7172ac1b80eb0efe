"""Readers and the sink: uploads, images, OCR words, tags, training logs, reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: File types that are taken, and the most bytes of a file.
EXTENSIONS = (".jpg", ".jpeg", ".png", ".bmp", ".tif", ".tiff", ".webp")
MAX_BYTES = 20 * 1024 * 1024


def extension(path):
    """Lower case; none counts as .jpg."""
    found = F.lower(F.regexp_extract(path, r"[^/.](\.[^./]*)$", 1))
    return F.when(found == "", ".jpg").otherwise(found)


def read_scans(spark: SparkSession, path: str) -> DataFrame:
    """Uploaded files with name, extension, size, time and SHA-256; scan_id is a hash of the path.

    The reader leaves out files of no bytes, so these have to come from a table of uploads.
    """
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return d.select(
        F.xxhash64("path").alias("scan_id"), "path", F.regexp_extract("path", r"([^/]*)$", 1).alias("filename"),
        extension(F.col("path")).alias("ext"), "length", "content", F.col("modificationTime").alias("received_at"), F.sha2("content", 256).alias("sha256"),
    )


def intake_status(scans: DataFrame) -> DataFrame:
    """status: 400 for a type not taken, 413 for too many bytes, 400 for none, else 200 - in this order."""
    status = F.when(~F.col("ext").isin(*EXTENSIONS), 400).when(F.col("length") > MAX_BYTES, 413).when(F.col("length") == 0, 400).otherwise(200)
    return scans.withColumn("status", status)


#: Pixels at a time on the way from an image to rows or tiles.
BAND = 1 << 18


def _images(spark: SparkSession, path: str) -> DataFrame:
    d = spark.read.format("image").option("dropInvalid", True).load(path)
    return d.select(F.xxhash64("image.origin").alias("scan_id"), "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data")


def _rgb(data, channels: int):
    """Red, green and blue (numbers, last axis) of stored bytes (blue, green, red and alpha, or grey); alpha is laid over white."""
    import numpy as np

    a = np.asarray(data, dtype=float)
    rgb = a[..., [2, 1, 0]] if channels >= 3 else np.repeat(a, 3, axis=-1)
    if channels == 4:
        share = a[..., 3:] / 255
        rgb = rgb * share + 255 * (1 - share)
    return rgb


def read_image_pixels(spark: SparkSession, path: str) -> DataFrame:
    """scan_id, y, x, r, g, b, lum for each pixel of JPEG, PNG and BMP files; alpha is laid over white; other files are left out.

    A row for each pixel is for small images; read_image_tiles and tile_block_stats do without.
    """
    import numpy as np
    import pyarrow as pa

    def pixels(batches):
        for b in batches:
            for i in range(b.num_rows):
                scan, height, width, n = (b.column(k)[i].as_py() for k in range(4))
                a = np.frombuffer(b.column(4)[i].as_buffer(), dtype=np.uint8).reshape(height, width, n)
                step = max(1, BAND // max(1, width))
                for top in range(0, height, step):
                    rgb = _rgb(a[top : top + step], n)
                    y, x = (k.ravel().astype(np.int32) for k in np.indices(rgb.shape[:2]))
                    r, g, blue = (rgb[..., k].ravel() for k in range(3))
                    columns = [pa.array(np.full(len(y), scan)), pa.array(y + np.int32(top)), pa.array(x), pa.array(r), pa.array(g), pa.array(blue), pa.array(0.299 * r + 0.587 * g + 0.114 * blue)]
                    yield pa.RecordBatch.from_arrays(columns, ["scan_id", "y", "x", "r", "g", "b", "lum"])

    return _images(spark, path).mapInArrow(pixels, "scan_id long, y int, x int, r double, g double, b double, lum double")


def read_image_tiles(spark: SparkSession, path: str, tile: int = 256) -> DataFrame:
    """Images cut into tiles: scan_id, top, left, height, width (of the tile), page_h, page_w, channels, data (its stored bytes).

    An image passes through a task band by band, so beside its own bytes only one band is held.
    """
    import numpy as np
    import pyarrow as pa

    def tiles(batches):
        for b in batches:
            for i in range(b.num_rows):
                scan, height, width, n = (b.column(k)[i].as_py() for k in range(4))
                a = np.frombuffer(b.column(4)[i].as_buffer(), dtype=np.uint8).reshape(height, width, n)
                for top in range(0, height, tile):
                    band = a[top : top + tile]
                    lefts = [*range(0, width, tile)]
                    cuts = [band[:, at : at + tile] for at in lefts]
                    same = lambda v: pa.array([v] * len(cuts), pa.int32())  # noqa: B023, E731
                    columns = [pa.array([scan] * len(cuts), pa.int64()), same(top), pa.array(lefts, pa.int32()), same(len(band)), pa.array([c.shape[1] for c in cuts], pa.int32()), same(height), same(width), same(n), pa.array([c.tobytes() for c in cuts], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["scan_id", "top", "left", "height", "width", "page_h", "page_w", "channels", "data"])

    return _images(spark, path).mapInArrow(tiles, "scan_id long, top int, left int, height int, width int, page_h int, page_w int, channels int, data binary")


def tile_block_stats(tiles: DataFrame, size: int) -> DataFrame:
    """block_stats of the luminance from tiles: scan_id, block_y, block_x, mean, std; sides of tiles are multiples of `size`.

    Blocks are added up inside a task, a tile at a time; a row for each block is all that comes out.
    """
    import numpy as np
    import pyarrow as pa

    def blocks(batches):
        for b in batches:
            for scan, top, left, height, width, page_h, page_w, n, data in zip(*(b.column(k) for k in ("scan_id", "top", "left", "height", "width", "page_h", "page_w", "channels", "data")), strict=True):
                scan, top, left, height, width, page_h, page_w, n = (v.as_py() for v in (scan, top, left, height, width, page_h, page_w, n))
                if top % size or left % size:
                    raise ValueError("blocks don't fit into tiles")
                # Blocks that start before extent - size, the last full one left out
                down, across = min(height // size, -(-(page_h - size - top) // size)), min(width // size, -(-(page_w - size - left) // size))
                if down <= 0 or across <= 0:
                    continue
                rgb = _rgb(np.frombuffer(data.as_buffer(), dtype=np.uint8).reshape(height, width, n)[: down * size, : across * size], n)
                lum = (0.299 * rgb[..., 0] + 0.587 * rgb[..., 1] + 0.114 * rgb[..., 2]).reshape(down, size, across, size)
                y, x = np.indices((down, across))
                columns = [pa.array(np.full(down * across, scan)), pa.array((y.ravel() + top // size).astype(np.int32)), pa.array((x.ravel() + left // size).astype(np.int32)), pa.array(lum.mean(axis=(1, 3)).ravel()), pa.array(lum.std(axis=(1, 3)).ravel())]
                yield pa.RecordBatch.from_arrays(columns, ["scan_id", "block_y", "block_x", "mean", "std"])

    return tiles.mapInArrow(blocks, "scan_id long, block_y int, block_x int, mean double, std double")


def clean_tokens(raw: DataFrame) -> DataFrame:
    """OCR words with a whole-number confidence (-1 if it can't be read) of 20 or more, and not blank."""
    conf = F.coalesce(F.col("conf").cast("string").try_cast("double").cast("int"), F.lit(-1))
    d = raw.withColumn("conf", conf).withColumn("text", F.trim("text"))
    return d.where("conf >= 20 and text is not null and text <> ''")


def read_ocr_tokens(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated word table."""
    schema = "scan_id long, line_no int, word_no int, text string, left int, top int, width int, height int, conf string"
    return clean_tokens(spark.read.csv(path, sep="\t", header=True, schema=schema, quote=""))


def read_exif(packed: DataFrame, col: str = "tags") -> DataFrame:
    """JSON tags as a map of strings, without nulls."""
    return packed.withColumn(col, F.map_filter(F.from_json(col, "map<string,string>"), lambda k, v: v.isNotNull()))


def read_training_log(spark: SparkSession, path: str) -> DataFrame:
    schema = "epoch int, accuracy double, auc double, loss double, val_accuracy double, val_auc double, val_loss double"
    return spark.read.csv(path, header=True, schema=schema)


def read_settings(text: str | None) -> dict[str, float]:
    """Threshold and temperature of a settings file, with their usual values where they are missing."""
    try:
        found = json.loads(text) if text else {}
    except ValueError:
        found = {}
    return {"threshold": float(found.get("threshold_used", 0.54)), "temperature": float(found.get("temperature", 1.0))}


def write_reports(reports: DataFrame, path: str, form: str = "parquet", batch: int = 0) -> None:
    """One report for each scan, in a folder for each batch and in it for each verdict.

    Only the batch's own folder is written over: other batches stay, and the same batch written again
    leaves what it left the first time.
    """
    reports.write.mode("overwrite").partitionBy("verdict").format(form).save(f"{path.rstrip('/')}/batch={batch}")


def stream_reports(reports: DataFrame, path: str, checkpoint: str, form: str = "parquet"):
    """A stream of reports into the same folders, by the stream's own batches; a batch that is run again after a failure changes nothing."""
    return reports.writeStream.foreachBatch(lambda d, batch: write_reports(d, path, form, batch)).option("checkpointLocation", checkpoint)
