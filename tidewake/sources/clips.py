"""Clip folders, picture folders and video containers."""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, fields, replace
from datetime import datetime, timezone
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VIDEO = r"(?i)\.(mp4|avi|mov|mkv|flv|wmv|mpeg|mpg)$"
STAMP = re.compile(r"(\d{4})[_\-.](\d{2})[_\-.](\d{2})[_\-.](\d{2})[_\-.](\d{2})[_\-.](\d{2})")


def is_video(name):
    """Whether a file name (column) ends like a video's."""
    return name.rlike(VIDEO)


@dataclass(frozen=True)
class Clip:
    """What a clip folder holds, and where its results go."""

    video: str
    ais: str
    camera: str
    start_ms: int
    result: str


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, length, modified) of the files below a folder, without reading them."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.col("modificationTime").alias("modified"))


def find_clip(spark: SparkSession, folder: str, results: str) -> Clip:
    """The one video (start second in its name), the camera text and the ``ais`` folder of a clip folder."""
    names = [r["path"] for r in list_files(spark, folder).filter(is_video(F.col("name")) | F.col("name").endswith(".txt")).select("path").orderBy("path").collect()]
    videos, texts = [n for n in names if re.search(VIDEO, n)], [n for n in names if n.endswith(".txt")]
    if not videos or not texts:
        raise ValueError(f"{folder} needs a video and a camera text")
    stamps = STAMP.findall(videos[0].rsplit("/", 1)[-1])
    if not stamps:
        raise ValueError(f"no start time in the name of {videos[0]}")
    start = datetime(*map(int, stamps[0]), tzinfo=timezone.utc)
    return Clip(videos[0], folder.rstrip("/") + "/ais", texts[0], int(start.timestamp() * 1000), results.rstrip("/") + "/" + folder.rstrip("/").rsplit("/", 1)[-1])


def second_files(spark: SparkSession, path: str, start_ms: int) -> DataFrame:
    """(name, offset_s) of the message files of a folder, by their seconds from the start."""
    name = F.col("name")
    second = F.unix_seconds(F.try_to_timestamp(F.regexp_extract(name, r"^(.*)\.csv$", 1), F.lit("yyyy_MM_dd_HH_mm_ss")))
    return list_files(spark, path).select(name, (second - start_ms // 1000).alias("offset_s")).filter("offset_s IS NOT NULL")


def read_pictures(spark: SparkSession, path: str) -> DataFrame:
    """(path, label, content) of the pictures below a folder or of one file; label is the parent folder's name."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    parts = F.split("path", "/")
    kept = found.filter(F.lower("path").rlike(r"\.(jpg|jpeg|png|bmp|tif|tiff|pbm|pgm|ppm|webp|dib)$"))
    return kept.select("path", F.element_at(parts, -2).alias("label"), "content")


def labelled_pictures(pictures: DataFrame) -> DataFrame:
    """pictures with ``number``, the place of their label among all labels in order."""
    names = sorted(r["label"] for r in pictures.select("label").distinct().collect())
    return pictures.withColumn("number", (F.array_position(F.array(*[F.lit(n) for n in names]), F.col("label")) - 1).cast("int"))


def check_request(ais: str, camera: str, frames: int, step_seconds: float) -> None:
    """Raise ValueError where a request's local folder or file is not there, or a number is not positive."""
    if "://" not in ais and not os.path.isdir(ais):
        raise ValueError(f"no such folder: {ais}")
    if "://" not in camera and not os.path.isfile(camera):
        raise ValueError(f"no such file: {camera}")
    if frames <= 0 or step_seconds <= 0:
        raise ValueError("the numbers of frames and of seconds between them must be positive")


def merged(config: Any, *changes: dict) -> Any:
    """A dataclass with the changes of dicts, later ones first; unknown names raise."""
    known = {f.name for f in fields(config)}
    for change in changes:
        if unknown := set(change) - known:
            raise ValueError(f"no such settings: {sorted(unknown)}")
        config = replace(config, **change)
    return config


def read_settings(path: str) -> dict:
    """``name: value`` lines, sections by indent, as a nested dict; numbers, true, false and null as such."""
    out: dict = {}
    stack = [(-1, out)]
    with open(path, encoding="utf-8") as lines:
        for raw in lines:
            line = raw.split(" #")[0].rstrip()
            if not line.strip() or line.lstrip().startswith("#"):
                continue
            indent, (name, _, value) = len(line) - len(line.lstrip()), line.strip().partition(":")
            while stack[-1][0] >= indent:
                stack.pop()
            if value.strip():
                stack[-1][1][name.strip()] = _value(value.strip())
            else:
                stack[-1][1][name.strip()] = {}
                stack.append((indent, stack[-1][1][name.strip()]))
    return out


def _value(text: str) -> Any:
    plain = {"true": True, "false": False, "null": None, "~": None}
    if text.lower() in plain:
        return plain[text.lower()]
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            continue
    return text.strip("\"'")


# --- containers ---------------------------------------------------------------------------------

EMPTY_EDIT = -1


def boxes_in(data: bytes, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(type, body begin, end) of the boxes in a stretch; a broken size ends it."""
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            if start + 16 > end:
                return
            (size,), head = struct.unpack_from(">Q", data, start + 8), 16
        elif size == 0:
            size = end - start
        if size < head or size > end - start:
            return
        yield kind, start + head, start + size
        start += size


def implausible_edits(data: bytes) -> list[tuple[int, int]]:
    """(offset, length) of the durations of empty edits that are longer than their movie."""

    def child(start: int, end: int, kind: bytes) -> tuple[int, int] | None:
        return next(((a, b) for k, a, b in boxes_in(data, start, end) if k == kind), None)

    movie = child(0, len(data), b"moov")
    head = movie and child(*movie, b"mvhd")
    if not head:
        return []
    body = data[head[0] : head[1]]
    # Without a readable duration no edit is too long.
    longest = struct.unpack_from(">Q", body, 24)[0] if len(body) >= 32 and body[0] == 1 else struct.unpack_from(">I", body, 16)[0] if len(body) >= 20 and body[0] == 0 else 2**64 - 1
    out = []
    for kind, a, b in boxes_in(data, *movie):
        edits = child(a, b, b"edts") if kind == b"trak" else None
        listed = edits and child(*edits, b"elst")
        if not listed or listed[1] - listed[0] < 8:
            continue
        a, b = listed
        wide = 8 if data[a] == 1 else 4
        (count,) = struct.unpack_from(">I", data, a + 4)
        for at in range(a + 8, min(b - (2 * wide + 4) + 1, a + 8 + count * (2 * wide + 4)), 2 * wide + 4):
            duration, media = struct.unpack_from(">Qq" if wide == 8 else ">Ii", data, at)
            if media == EMPTY_EDIT and duration > longest:
                out.append((at, wide))
    return out


def find_implausible_edits(files: DataFrame) -> DataFrame:
    """(path, offset, length) of implausible empty edits in containers (path, content)."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, o, n) for p, content in zip(batch["path"], batch["content"]) for o, n in implausible_edits(content or b"")]
            yield pd.DataFrame(rows, columns=["path", "offset", "length"])

    return files.select("path", "content").mapInPandas(walk, "path string, offset long, length int")
