"""Token counts of whole texts, exactly as a public tokenizer gives them.

Texts are encoded by the library's batch call inside Arrow functions, which return lengths only.
Batches are balanced by bytes.  A long text is split before runs of white space that follow another
character: the pre-tokenizers of byte-level and word-level BPE begin a new piece there, whatever
stands before, and special strings hold no white space, so the parts' tokens joined are the text's.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.llm import textcore

#: A safe cut: before white space behind a character that is none, or between a letter and a digit.
SAFE_CUT = re.compile(r"(?<=\S)(?=[ \t\n\r\f\v])|(?<=[A-Za-z])(?=[0-9])")
#: Bytes of texts that are encoded in one call, and of a part of a long text.
BATCH_BYTES = 1 << 18
PART_BYTES = 1 << 16


def size_of(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass"))


def balanced_batches(parts: Iterable[tuple[int, str]], limit: int = BATCH_BYTES) -> Iterator[list[tuple[int, str]]]:
    """Batches of at most ``limit`` bytes each (single parts may be longer), whatever the number of parts."""
    batch, held = [], 0
    for part in parts:
        size = 4 + size_of(part[1])
        if batch and held + size > limit:
            yield batch
            batch, held = [], 0
        batch.append(part)
        held += size
    if batch:
        yield batch


def safe_parts(text: str, limit: int = PART_BYTES) -> Iterator[str]:
    """Parts of a text of about ``limit`` bytes that end at safe cuts; a part without one goes on to the next cut."""
    at, step = 0, max(1, limit // 4)
    while size_of(text[at : at + limit]) > limit or len(text) - at > limit:
        found = SAFE_CUT.search(text, at + step)
        if found is None:
            break
        last = found.start()
        # The last safe cut within the limit, else the first one.
        for found in SAFE_CUT.finditer(text, last, at + limit):
            if size_of(text[at : found.start()]) > limit:
                break
            last = found.start()
        yield text[at:last]
        at = last
    yield text[at:]


def library(path: str) -> tuple[Callable[[list[str]], list], bool]:
    """The batch call of the library that a vocabulary file is for, and whether texts may be split for it."""
    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: pieces.encode(texts, num_threads=1), False
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks, not threads, use the cores
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    encode = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
    return lambda texts: [x.ids for x in encode(texts, add_special_tokens=False)], True


def count_texts(encode: Callable[[list[str]], list], split: bool, texts: Iterable[str | None]) -> np.ndarray:
    """Numbers of tokens of texts; null counts as empty."""
    texts = list(texts)
    out = np.zeros(len(texts), np.int64)
    parts = ((i, part) for i, text in enumerate(texts) if text for part in (safe_parts(text) if split else (text,)))
    for batch in balanced_batches(parts):
        lengths = [len(ids) for ids in encode([part for _, part in batch])]
        np.add.at(out, [i for i, _ in batch], lengths)
    return out


def token_counts(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", limit: int = 512) -> DataFrame:
    """Per row: key, n_bytes (UTF-8), n_tokens and whether n_tokens exceeds ``limit``.

    A null text counts as empty (0 bytes, 0 tokens).  Null keys, repeated rows and ties stay as they
    are, one output row per input row; other columns are ignored, whatever their names; an empty
    table gives an empty one.  Very long texts are encoded in parts cut at safe boundaries.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, split = library(tokenizer_path)
        for batch in batches:
            counts = pa.array(count_texts(encode, split, batch.column(1).to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), counts], ["k", "n_bytes", "n_tokens"])

    slim = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("b"))
    kind = slim.schema["k"].dataType.simpleString()
    counted = slim.mapInArrow(textcore.lean(count), f"k {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("k").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
