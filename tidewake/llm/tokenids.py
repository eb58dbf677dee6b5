"""Token ids of whole texts in bulk, for writers of id files.

Where a tokenizer drops white space, the ids of a text are those of its words one after another.
Then words are found and hashed by array steps, each new word is encoded once, and texts are put
together by array steps from a table of the words' ids, which a worker keeps from task to task.
Plain words, with marks behind them or not, go straight to the library's model where that gives the
tokenizer's ids, other words to its batch call.  For other tokenizers texts are split at safe cuts and encoded in balanced batches.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np

from tidewake.llm import textcore, tokencount

#: Words and ids that the table holds at most before it is begun anew.
MOST_WORDS = 600_000
MOST_IDS = 5_000_000
#: Letters that no normalizer here changes but for case, then marks that every BPE here takes apart from letters.
PLAIN = re.compile(r"([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+)([.,!?;:*#$%&|]*)")
PLAIN_PROBES = ("word", "Word", "ABSURD", "naïve", "ÉTÉ", "Übermaß", "ñandú", "internationalization", "q", "ÿ")
MOST_TAILS = 10_000
PROBES = ("a", "Word", "naïve", "x1", "it's", "...", "<|endoftext|>", "ß!", "ab</w>", "日本", "é")
GAPS = (" ", "\t", "\n", "\r\n", "  ", " \n\t ", "\x0b", "\x0c")


def words_stand_alone(encode: Callable[[list[str]], list]) -> bool:
    """Whether words between ASCII white space have the ids that they have alone, on all probes."""
    alone = dict(zip(PROBES, encode(list(PROBES))))
    texts = [(a, gap, b) for a in PROBES for gap in GAPS for b in PROBES]
    found = encode([a + gap + b for a, gap, b in texts])
    around = encode([gap + a + gap for a in PROBES for gap in GAPS])
    return all(ids == alone[a] + alone[b] for ids, (a, _, b) in zip(found, texts)) and around == [alone[a] for a in PROBES for _ in GAPS]


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 characters stand for themselves, the rest is numbered from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def direct_way(path: str, encode: Callable[[list[str]], list]) -> Callable[[str], list[int]] | None:
    """How the library's model alone gives a plain word's ids, or None: only if all probes come out the same."""
    if path.endswith(".model"):
        return None
    from tokenizers import Tokenizer

    tokenize = Tokenizer.from_file(path).model.tokenize
    letter = byte_letters()
    want = encode(list(PLAIN_PROBES))
    for fold in (False, True):

        def ids(word: str, fold: bool = fold) -> list[int]:
            word = word.lower() if fold else word
            return [t.id for t in tokenize(word if word.isascii() else "".join(letter[b] for b in word.encode()))]

        try:
            if [ids(p) for p in PLAIN_PROBES] == want:
                return ids
        except Exception:  # a model that does not know a letter raises: this is not its way
            continue
    return None


class IdEncoder:
    """Encodes UTF-8 texts to ids, all of one call in one array."""

    def __init__(self, path: str):
        self.encode, self.split = tokencount.library(path)
        self.by_word = words_stand_alone(self.encode)
        self.direct = direct_way(path, self.encode) if self.by_word else None
        self.tails: dict[str, list[int]] = {"": []}
        self._forget()

    def _forget(self) -> None:
        self.keys = np.empty(0, np.uint64)
        self.start, self.count = np.empty(0, np.int64), np.empty(0, np.int64)
        self.pool = np.empty(0, np.uint32)

    def texts(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where each text's begin and the last one's end."""
        if not self.by_word:
            parts = [list(tokencount.safe_parts(bytes(t).decode())) if self.split else [bytes(t).decode()] for t in texts]
            ids: list[list[int]] = [[] for _ in texts]
            for batch in tokencount.balanced_batches((i, p) for i, own in enumerate(parts) for p in own):
                for (i, _), found in zip(batch, self.encode([p for _, p in batch])):
                    ids[i] += found
            return np.array([x for own in ids for x in own], np.uint32), np.cumsum([0] + [len(x) for x in ids])
        found = [textcore.located_words(t, textcore.PLAIN) for t in texts]
        ends = np.cumsum([0] + [len(h) for h, _, _ in found])
        flat = np.concatenate([h for h, _, _ in found]) if found else np.empty(0, np.uint64)
        unique, at, back = np.unique(flat, return_index=True, return_inverse=True)
        place = self._places(unique, at, ends, texts, found)[back]
        count = self.count[place]
        after = np.concatenate(([0], np.cumsum(count)))
        ids = self.pool[np.arange(after[-1]) + np.repeat(self.start[place] - after[:-1], count)]
        return ids, after[ends]

    def _places(self, unique: np.ndarray, at: np.ndarray, ends: np.ndarray, texts: list[np.ndarray], found: list) -> np.ndarray:
        """Places of words in the table, which learns those it lacks."""
        if len(self.keys) > MOST_WORDS or len(self.pool) > MOST_IDS:
            self._forget()
        place = np.searchsorted(self.keys, unique)
        known = self.keys[np.minimum(place, len(self.keys) - 1)] == unique if len(self.keys) else np.zeros(len(unique), bool)
        new = np.flatnonzero(~known)
        if not len(new):
            return place
        owner = np.searchsorted(ends, at[new], side="right") - 1
        words = []
        for k, i in zip((at[new] - ends[owner]).tolist(), owner.tolist()):
            _, s, e = found[i]
            words.append(bytes(texts[i][s[k] : e[k]]).decode())
        ids = self._ids_of(words)
        count = np.array([len(x) for x in ids], np.int64)
        start = len(self.pool) + np.cumsum(count) - count
        self.pool = np.concatenate((self.pool, np.array([x for own in ids for x in own], np.uint32)))
        self.keys, self.start, self.count = (np.insert(old, place[new], add) for old, add in ((self.keys, unique[new]), (self.start, start), (self.count, count)))
        return np.searchsorted(self.keys, unique)

    def _ids_of(self, words: list[str]) -> list[list[int]]:
        out: list = [None] * len(words)
        rest = []
        if len(self.tails) > MOST_TAILS:
            self.tails = {"": []}
        for i, word in enumerate(words):
            found = PLAIN.fullmatch(word) if self.direct else None
            if found is None:
                rest.append((i, word))
                continue
            stem, tail = found.groups()
            if tail not in self.tails:
                self.tails[tail] = self.encode([tail])[0]
            out[i] = self.direct(stem) + self.tails[tail]
        for batch in tokencount.balanced_batches(rest):
            for (i, _), ids in zip(batch, self.encode([w for _, w in batch])):
                out[i] = ids
        return out


_encoders: dict[str, IdEncoder] = {}


def encoder(path: str) -> IdEncoder:
    """This worker's encoder; its table, of bounded size, lasts from task to task."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = IdEncoder(path)
    return _encoders[path]
