"""Token-id files with a minimal perfect hash index from document keys to their ids.

``shard-*.ids`` hold raw little-endian ids (16 bits wide where the vocabulary allows, else 32), all
documents in ascending key order, and behind them their number.  ``index-*.mph`` hold, per bucket of hashed keys, a minimal
perfect hash (levels of bit arrays; a key's rank among the set bits is its slot) and per slot a
stored fingerprint, the shard, the offset and the number of ids: a keyed read takes one bucket, a
few bits and one slot, whatever the number of documents.

Files are written by tasks under names of their own, then moved into place, so a task that runs
again after a lost executor writes the same file again.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.llm import textcore, tokenids
from tidewake.llm.textcore import mix
from tidewake.llm.workspace import Workspace

MAGIC = b"TWIDS1\0\0"
END_ID = 1
#: Bytes of text per shard and keys per index bucket that are aimed at; there are at most MOST_FILES of either.
SHARD_BYTES = 16 << 20
BUCKET_KEYS = 1 << 16
MOST_FILES = 20_000
#: Bytes of texts that are encoded at once: words, hashes and ids of them take thirty times as many.
ENCODE_BYTES = 1 << 20
GAMMA = 2.0


# --- minimal perfect hash -----------------------------------------------------------------------


def _level_hash(keys: np.ndarray, level: int) -> np.ndarray:
    return mix(keys + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) % (1 << 64)))


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys ^ np.uint64(0xA5A5A5A5DEADBEEF)) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    """Distinct 64-bit keys to 0..n-1, without the keys: at each level, a key alone at its bit stays."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        ones = np.concatenate([np.zeros(1, np.int64)] + [np.cumsum(x, dtype=np.int64) for x in levels]) if levels else np.zeros(1, np.int64)
        self.before, at, base = [], 1, 0
        for x in levels:
            own = ones[at : at + len(x)]
            self.before.append(base + np.concatenate(([0], own[:-1])))
            base += int(own[-1]) if len(own) else 0
            at += len(x)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], np.unique(keys)
        while len(left):
            size = max(64, int(GAMMA * len(left)))
            at = (_level_hash(left, len(levels)) % np.uint64(size)).astype(np.int64)
            count = np.bincount(at, minlength=size)
            levels.append(count == 1)
            left = left[count[at] > 1]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slots of keys; -1 where no level holds one (then the key was never stored)."""
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            at = (_level_hash(keys[open_], level) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[open_[hit]] = self.before[level][at[hit]]
            open_ = open_[~hit]
        return out

    def dump(self) -> bytes:
        parts = [struct.pack("<I", len(self.levels))]
        for bits in self.levels:
            parts += [struct.pack("<Q", len(bits)), np.packbits(bits).tobytes()]
        return b"".join(parts)

    @classmethod
    def load(cls, data: bytes, at: int = 0) -> tuple[PerfectHash, int]:
        (count,) = struct.unpack_from("<I", data, at)
        at += 4
        levels = []
        for _ in range(count):
            (size,) = struct.unpack_from("<Q", data, at)
            used = -(-size // 8)
            levels.append(np.unpackbits(np.frombuffer(data, np.uint8, used, at + 8), count=size).astype(bool))
            at += 8 + used
        return cls(levels), at


SLOT = np.dtype([("print", "<u4"), ("shard", "<u4"), ("offset", "<u8"), ("count", "<u8")])


def dump_index(keys: np.ndarray, shard: np.ndarray, offset: np.ndarray, count: np.ndarray) -> bytes:
    """One bucket's index; keys are distinct."""
    hashed = PerfectHash.build(keys)
    slots = np.zeros(len(keys), SLOT)
    at = hashed.slots(keys)
    slots["print"][at], slots["shard"][at], slots["offset"][at], slots["count"][at] = fingerprint(keys), shard, offset, count
    return MAGIC + struct.pack("<Q", len(keys)) + hashed.dump() + slots.tobytes()


def search_index(data: bytes, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of keys, and whether each key's stored fingerprint is the key's."""
    (n,) = struct.unpack_from("<Q", data, 8)
    hashed, at = PerfectHash.load(data, 16)
    slots = np.frombuffer(data, SLOT, n, at)
    place = hashed.slots(keys)
    found = (place >= 0) & (place < n)
    rows = slots[np.where(found, place, 0)] if n else np.zeros(len(keys), SLOT)
    return rows, found & (rows["print"] == fingerprint(keys))


# --- files --------------------------------------------------------------------------------------


def _files(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a folder given as uri or plain path."""
    return pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)


def put(folder: str, name: str, parts: list[bytes]) -> None:
    """Write a file under a name of its own and move it into place."""
    files, base = _files(folder)
    files.create_dir(base, recursive=True)
    own = f"{base}/.{name}.{uuid.uuid4().hex}"
    with files.open_output_stream(own) as out:
        for part in parts:
            out.write(part)
    files.move(own, f"{base}/{name}")


def get(folder: str, name: str) -> bytes:
    files, base = _files(folder)
    with files.open_input_stream(f"{base}/{name}") as stream:
        return stream.read()


def key_bits(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def id_batches(batches: Iterator[pa.RecordBatch], encoder: tokenids.IdEncoder, end: int, kind: str) -> Iterator[pa.RecordBatch]:
    """(k, ids with the end id, as bytes) of batches of (k, text); at most ENCODE_BYTES of texts, or one text, are encoded at once."""
    for batch in textcore.gathered(batches, ENCODE_BYTES):
        for part, texts in textcore.text_groups(batch, 1, ENCODE_BYTES):
            ids, at = encoder.texts(texts)
            ids = np.insert(ids, at[1:], end).astype(kind)
            at = (at + np.arange(len(at))) * ids.itemsize
            column = pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(ids)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), column], ["k", "ids"])


class TokenFiles:
    """Writes and reads the files of one folder."""

    def __init__(self, docs: DataFrame, tokenizer_path: str, folder: str | None = None, key: str = "doc_id", text: str = "text", end_id: int = END_ID):
        self.spark = docs.sparkSession
        self.work = Workspace(self.spark, "token-files")
        self.folder = folder or self.work.at("files")
        self.docs = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
        self.path, self.end = tokenizer_path, end_id

    def write(self) -> DataFrame:
        """Write shards and index; the shards' rows (k, shard, offset, n) in order, ids counted per shard."""
        from tokenizers import Tokenizer

        wide = Tokenizer.from_file(self.path).get_vocab_size(with_added_tokens=True) > 1 << 16
        kind = "<u4" if wide else "<u2"
        size = self.docs.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("b"), F.count("*").alias("n")).collect()[0]
        shards = min(MOST_FILES, max(1, -(-size["b"] // SHARD_BYTES), -(-size["n"] // (1 << 20))))
        folder, path, end = self.folder, self.path, self.end

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return id_batches(batches, tokenids.encoder(path), end, kind)

        # Keys alone set the bounds of the shards, so that texts are read and encoded once.
        bounds = self._bounds(shards)
        at = F.lit(0)
        if bounds:
            shared = F.array(*[F.lit(int(b)) for b in bounds]) if len(bounds) <= 64 else None
            at = F.size(F.filter(shared, lambda b: b <= F.col("k"))) if shared is not None else None
        encoded = self.docs.mapInArrow(textcore.lean(encode), "k long, ids binary")
        if at is None:
            marks = self.spark.sparkContext.broadcast(np.array(bounds, np.int64))

            def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    keys = batch.column(0).fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.searchsorted(marks.value, keys, side="right"), pa.int64())], ["k", "ids", "shard"])

            encoded = encoded.mapInArrow(place, "k long, ids binary, shard long")
        else:
            encoded = encoded.withColumn("shard", F.when(F.col("k").isNull(), 0).otherwise(at).cast("long"))
        count = len(bounds) + 1
        ordered = encoded.repartition(count, "shard").sortWithinPartitions("shard", F.col("k").asc_nulls_first(), F.crc32("ids"))

        def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, stream, own = None, None, ""
            files, base = _files(folder)
            files.create_dir(base, recursive=True)
            width, written = np.dtype(kind).itemsize, 0

            def close() -> None:
                if stream is not None:
                    stream.write(struct.pack("<Q", written))
                    stream.close()
                    files.move(own, f"{base}/shard-{now:06d}.ids")

            for batch in batches:
                shard = batch.column(2).to_numpy(zero_copy_only=False)
                counts, offsets = [], []
                for i, ids in enumerate(batch.column(1).to_pylist()):
                    if shard[i] != now:
                        close()
                        now, written = int(shard[i]), 0
                        own = f"{base}/.shard-{now:06d}.{uuid.uuid4().hex}"
                        stream = files.open_output_stream(own)
                        stream.write(MAGIC + struct.pack("<Q", width))
                    stream.write(ids)
                    counts.append(len(ids) // width)
                    offsets.append(written)
                    written += counts[-1]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(offsets, pa.int64()), pa.array(counts, pa.int64())], ["k", "shard", "offset", "n"])
            close()

        self.shards = count
        placed = self.work.save(ordered.mapInArrow(store, "k long, shard long, offset long, n long"), "placed")
        self._index(placed, size["n"])
        return placed

    def _bounds(self, shards: int) -> list[int]:
        """First keys of all shards but the first: quantiles of the keys, weighed by nothing but their number."""
        if shards == 1:
            return []
        found = self.docs.select("k").agg(F.percentile_approx("k", [i / shards for i in range(1, shards)], max(10_000, 20 * shards)).alias("q")).collect()[0]["q"]
        return sorted(set(found or []))

    def _index(self, placed: DataFrame, rows: int) -> None:
        """One file per bucket of keys; of rows with the same key the first one is found."""
        self.buckets = min(MOST_FILES, max(1, -(-rows // BUCKET_KEYS)))
        folder, buckets = self.folder, self.buckets

        def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, list[pa.RecordBatch]] = {}
            for batch in batches:
                for b in np.unique(of := batch.column(4).to_numpy(zero_copy_only=False)):
                    held.setdefault(int(b), []).append(batch.filter(pa.array(of == b)))
            for b, parts in held.items():
                column = lambda i: np.concatenate([p.column(i).to_numpy(zero_copy_only=False) for p in parts])  # noqa: B023, E731
                put(folder, f"index-{b:06d}.mph", [dump_index(column(0).astype(np.int64).view(np.uint64), column(1), column(2), column(3))])
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64())], ["bucket"])

        first = placed.filter("k IS NOT NULL").groupBy("k").agg(F.min(F.struct("shard", "offset", "n")).alias("s")).select("k", "s.*")
        bucket = F.pmod(F.xxhash64("k"), F.lit(buckets)).cast("long")
        self.work.save(first.withColumn("bucket", bucket).repartition(buckets, "bucket").mapInArrow(index, "bucket long"), "buckets")

    def look_up(self, keys: DataFrame) -> DataFrame:
        """(k, shard, offset, n) of each key that the index holds, each bucket's keys met with its file."""
        folder, buckets = self.folder, self.buckets

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            loaded: dict[int, bytes] = {}
            for batch in batches:
                of = batch.column(1).to_numpy(zero_copy_only=False)
                for b in np.unique(of):
                    if b not in loaded:
                        loaded = {b: get(folder, f"index-{b:06d}.mph")}
                    part = batch.column(0).filter(pa.array(of == b))
                    rows, known = search_index(loaded[b], key_bits(part))
                    rows, part = rows[known], part.filter(pa.array(known))
                    yield pa.RecordBatch.from_arrays([part, *[pa.array(rows[c].astype(np.int64)) for c in ("shard", "offset", "count")]], ["k", "shard", "offset", "n"])

        slim = keys.select("k").filter("k IS NOT NULL").withColumn("bucket", F.pmod(F.xxhash64("k"), F.lit(buckets)).cast("long"))
        return slim.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(search, "k long, shard long, offset long, n long")

    def starts(self) -> DataFrame:
        """(shard, base): ids in all shards before each, from the numbers that the shards end in; at most MOST_FILES rows."""
        folder = self.folder

        def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            files, base = _files(folder)
            for batch in batches:
                counts = []
                for s in batch.column(0).to_pylist():
                    info = files.get_file_info(f"{base}/shard-{s:06d}.ids")
                    if info.type != pafs.FileType.File:  # no document fell into this shard
                        counts.append(0)
                        continue
                    with files.open_input_file(info.path) as source:
                        counts.append(struct.unpack("<Q", source.read_at(8, info.size - 8))[0])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["shard", "n"])

        found = sorted(map(tuple, self.spark.range(self.shards).toDF("shard").mapInArrow(last, "shard long, n long").collect()))
        before = np.cumsum([0] + [n for _, n in found]).tolist()
        return self.spark.createDataFrame([(s, b) for (s, _), b in zip(found, before)], "shard long, base long")

    def read_back(self, places: DataFrame) -> DataFrame:
        """(k, shard, offset, n, ids_crc32) read from the shards at the given places."""
        folder = self.folder

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            files, base = _files(folder)
            now, source, width = None, None, 2
            for batch in batches:
                shard, offset, count = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
                crcs = []
                for s, o, n in zip(shard.tolist(), offset.tolist(), count.tolist()):
                    if s != now:
                        if source is not None:
                            source.close()
                        now, source = s, files.open_input_file(f"{base}/shard-{s:06d}.ids")
                        (width,) = struct.unpack("<Q", source.read_at(16, 0)[8:])
                    ids = np.frombuffer(source.read_at(n * width, 16 + o * width), f"<u{width}")
                    crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(crcs, pa.int64())], ["k", "shard", "offset", "n", "ids_crc32"])

        near = places.select("k", "shard", "offset", "n").repartition("shard").sortWithinPartitions("shard", "offset")
        return near.mapInArrow(read, "k long, shard long, offset long, n long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer_path: str, folder: str | None = None, key: str = "doc_id", text: str = "text", end_id: int = END_ID) -> DataFrame:
    """Write docs' ids and their index, and read them back: (key, start, n_tokens, ids_crc32) per document.

    Null texts count as empty (the end id alone).  Rows with a null key come first and are found by
    place, not by key; of rows with the same key the index finds the first, the others are read at
    their places.  Other columns do not matter, whatever their names; an empty table gives an
    empty one.
    """
    files = TokenFiles(docs, tokenizer_path, folder, key, text, end_id)
    placed = files.write()
    base = files.starts()
    # By key through the index; what a key does not find (null or repeated keys) by its place.
    keyed = files.look_up(placed.select("k").filter("k IS NOT NULL").distinct())
    others = placed.join(keyed.select("shard", "offset"), ["shard", "offset"], "left_anti").select("k", "shard", "offset", "n")
    found = files.read_back(keyed.union(others))
    return found.join(F.broadcast(base), "shard").select(F.col("k").alias(key), (F.col("base") + F.col("offset")).alias("start"), F.col("n").alias("n_tokens"), "ids_crc32")
