"""Benchmark decontamination: exact bounds find passages, Smith-Waterman alignment scores them.

Test items are taken in blocks of bounded size, each a table that every task holds while it reads
all documents.  A score of ``LEAST_SCORE`` takes that many words of the item, in a stretch of the
text whose length is bounded since every further word of it costs.  So an item is aligned with a text
wherever a window of that length shares words enough with it, each as often as the item has it;
no passage of a sufficient score is passed over, however it was edited.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewake.llm import textcore

MATCH, MISMATCH, GAP = 1.0, -0.4, -0.4
#: An alignment counts from this part of the score of the whole item copied.
LEAST_SCORE = 0.5
#: Bytes of items in a block at most (as far as single items allow).
BLOCK_BYTES = 8 << 20
MEMO = 50_000
#: Cells of a table of items by places at most (as far as single texts allow).
CELLS = 1 << 21


def words_of(data: np.ndarray) -> np.ndarray:
    return textcore.word_hashes(data, textcore.MARKS)


def align(item: np.ndarray, text: np.ndarray) -> tuple[float, int, int]:
    """Smith-Waterman over words: the best local score, and where in text it begins and ends."""
    n = len(text)
    if not n or not len(item):
        return 0.0, 0, 0
    slope = -GAP * np.arange(n + 1)
    row, origin = np.zeros(n + 1), np.arange(n + 1)
    best, begin, end = 0.0, 0, 0
    for word in item:
        score = np.where(text == word, MATCH, MISMATCH)
        diagonal, up = row[:-1] + score, row[1:] + GAP
        new = np.zeros(n + 1)
        source = np.arange(n + 1)
        use = (diagonal >= up) & (diagonal > 0)
        new[1:] = np.where(use, diagonal, np.maximum(up, 0))
        source[1:] = np.where(use, origin[:-1], np.where(up > 0, origin[1:], source[1:]))
        # A gap along the text: the running maximum of what stands to the left, less the gaps.
        lifted = new + slope
        top = np.maximum.accumulate(lifted)
        if (top > lifted + 1e-12).any():
            at = np.maximum.accumulate(np.where(lifted >= top - 1e-12, np.arange(n + 1), 0))
            better = top - slope > new + 1e-12
            source = np.where(better, source[at], source)
            new = np.where(better, top - slope, new)
        row, origin = new, source
        k = int(row.argmax())
        if row[k] > best:
            best, begin, end = float(row[k]), int(origin[k]), k
    return best, begin, end


def longest_stretch(n: int) -> int:
    """Words of text that an alignment of sufficient score with an item of n words spans at most."""
    return int(n + n * MATCH * (1 - LEAST_SCORE) / -max(MISMATCH, GAP) + 1e-9)


@dataclass
class Items:
    """One block of test items: their words, and which items hold each word how often."""

    ids: list[int]
    words: list[np.ndarray]
    keys: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))

    def index(self) -> Items:
        """Key the block by its words: the items that hold keys[k] are owners[at[k] : at[k + 1]], so often each."""
        owner = np.repeat(np.arange(len(self.words)), [len(w) for w in self.words])
        self.keys, key = np.unique(np.concatenate(self.words), return_inverse=True)
        pairs, self.often = np.unique(key.astype(np.int64) * len(self.words) + owner, return_counts=True)
        self.owners = pairs % len(self.words)
        self.at = np.searchsorted(pairs // len(self.words), np.arange(len(self.keys) + 1))
        by_item = np.argsort(self.owners, kind="stable")
        edges = np.searchsorted(self.owners[by_item], np.arange(len(self.words) + 1))
        self.own = [(pairs[by_item[a:b]] // len(self.words), self.often[by_item[a:b]]) for a, b in zip(edges[:-1], edges[1:])]
        self.need = np.array([LEAST_SCORE * len(w) - 1e-9 for w in self.words])
        self.width = np.array([longest_stretch(len(w)) for w in self.words])
        self.masks = []
        for words in self.words:
            mask: dict[int, int] = {}
            for k, word in enumerate(words.tolist()):
                mask[word] = mask.get(word, 0) | 1 << k
            self.masks.append(mask)
        self.quick = np.zeros(1 << 20, bool)
        self.quick[(self.keys >> np.uint64(44)).astype(np.int64)] = True
        return self

    def hits(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in a text's words that hold a word of some item, and its key's number."""
        maybe = np.flatnonzero(self.quick[(words >> np.uint64(44)).astype(np.int64)])
        key = np.searchsorted(self.keys, words[maybe])
        sure = self.keys[np.minimum(key, len(self.keys) - 1)] == words[maybe]
        return maybe[sure], key[sure]

    def candidates(self, key: np.ndarray) -> np.ndarray:
        """Items of whose words a text with these keys holds enough."""
        seen = np.unique(key)
        sizes = self.at[seen + 1] - self.at[seen]
        ends = np.cumsum(sizes)
        if not len(ends):
            return ends
        pick = np.arange(ends[-1]) + np.repeat(self.at[seen] - (ends - sizes), sizes)
        return np.flatnonzero(np.bincount(self.owners[pick], self.often[pick], len(self.words)) >= self.need)

    def stretches(self, items: np.ndarray, n: int, at: np.ndarray, key: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, begin, end) where in a text of n words windows lie that share enough words with an item."""
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        times = np.zeros(len(self.keys), np.int64)
        step = max(1, CELLS // (n + 1))
        for few in (items[k : k + step] for k in range(0, len(items), step)):
            table = np.empty((len(few), len(key)), np.int64)
            for row, item in zip(table, few.tolist()):
                own, often = self.own[item]
                times[own] = often
                row[:] = times[key]
                times[own] = 0
            line, hit = np.nonzero(table)
            place, word = at[hit], key[hit]
            # A place counts in the windows that start after the place where its word's turn, that many back, stands.
            back = np.arange(len(line)) - table[line, hit]
            same = (back >= 0) & (word[back] == word) & (line[back] == line)
            first = np.maximum(np.maximum(np.where(same, place[back] + 1, 0), place - self.width[few][line] + 1), 0)
            base, cells = line * (n + 1), len(few) * (n + 1)
            shared = np.cumsum(np.bincount(base + first, minlength=cells) - np.bincount(base + place + 1, minlength=cells)).reshape(len(few), n + 1)
            for k in np.flatnonzero(shared.max(axis=1) >= self.need[few]).tolist():
                item, width = int(few[k]), int(self.width[few[k]])
                starts = np.flatnonzero(shared[k] >= self.need[item])
                for s in np.split(starts, np.flatnonzero(np.diff(starts) > width) + 1):
                    yield item, int(s[0]), min(n, int(s[-1]) + width)

    def in_order(self, item: int, window: np.ndarray) -> int:
        """Words that an item and a stretch of text have in common in the same order, at most (bits of a row of the table at once)."""
        masks = self.masks[item]
        free = full = (1 << len(self.words[item])) - 1
        for word in window.tolist():
            if word in masks:
                both = free & masks[word]
                free = ((free + both) | (free - both)) & full
        return len(self.words[item]) - free.bit_count()

    def matches(self, words: np.ndarray, memo: dict) -> list[tuple[int, float, int, int]]:
        """(item, score, first word, number of words) of the items that the text holds, each at its best place."""
        at, key = self.hits(words)
        items = self.candidates(key)
        best: dict[int, tuple[int, float, int, int]] = {}
        for item, lo, hi in self.stretches(items, len(words), at, key) if len(items) else ():
            target, window = self.words[item], words[lo:hi]
            name = (item, window.tobytes())
            if name not in memo:
                if len(memo) > MEMO:
                    memo.clear()
                memo[name] = align(target, window) if self.in_order(item, window) >= self.need[item] else (0.0, 0, 0)
            score, begin, end = memo[name]
            score /= MATCH * len(target)
            if score >= LEAST_SCORE and (item not in best or score > best[item][1]):
                best[item] = (item, score, lo + begin, end - begin)
        return list(best.values())


def item_blocks(benchmark: DataFrame, key: str, text: str) -> Iterator[Items]:
    """The test items in blocks that one task can hold; null texts and texts without words hold nothing."""
    slim = benchmark.select(F.col(key).alias("i"), F.col(text).alias("t")).filter("t IS NOT NULL")
    size = slim.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).collect()[0][0]
    blocks = max(1, -(-size // BLOCK_BYTES))
    for b in range(blocks):
        rows = slim.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).orderBy("i", "t").collect()
        words = [words_of(np.frombuffer(r["t"].encode(), np.uint8)) for r in rows]
        keep = [k for k, w in enumerate(words) if len(w)]
        if keep:
            yield Items([rows[k]["i"] for k in keep], [words[k] for k in keep])


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item_id, score, first_word, n_words): the test items that documents hold, each at its best place.

    Null or empty texts on either side hold nothing; null keys stay null; of repeated rows each
    gives its own result, of repeated items one; columns beyond the named ones do not matter,
    whatever their names; empty tables give an empty one.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    schema = T.StructType([slim.schema["k"], T.StructField("item", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("first_word", T.LongType()), T.StructField("n_words", T.LongType())])
    found = spark.createDataFrame([], schema)
    for items in item_blocks(benchmark, item_key, item_text):
        shared = spark.sparkContext.broadcast(items.index())

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block, memo = shared.value, {}
            for batch in batches:
                rows, at = [], []
                for i, data in enumerate(textcore.text_bytes(batch.column(1))):
                    best: dict = {}
                    for item, *rest in block.matches(words_of(data), memo):
                        if block.ids[item] not in best or rest > best[block.ids[item]]:
                            best[block.ids[item]] = rest
                    rows += [(k, *rest) for k, rest in best.items()]
                    at += [i] * len(best)
                keys = batch.column(0).take(pa.array(at, pa.int64()))
                kinds = (pa.int64(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([keys, *[pa.array([r[j] for r in rows], kind) for j, kind in enumerate(kinds)]], ["k", "item", "score", "first_word", "n_words"])

        found = found.union(slim.mapInArrow(textcore.lean(scan), schema))
    return found.select(F.col("k").alias(key), F.col("item").alias("item_id"), "score", "first_word", "n_words")


def clean_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs that hold no test item, with all their columns; rows pass straight through, none is dealt out."""
    spark, place = docs.sparkSession, docs.columns.index(text)
    for items in item_blocks(benchmark, item_key, item_text):
        shared = spark.sparkContext.broadcast(items.index())

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block, memo = shared.value, {}
            for batch in batches:
                yield batch.filter(pa.array([not block.matches(words_of(data), memo) for data in textcore.text_bytes(batch.column(place))], pa.bool_()))

        docs = docs.mapInArrow(textcore.lean(keep), docs.schema)
    return docs
