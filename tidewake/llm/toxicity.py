"""Toxicity by a subsequence string kernel, a support vector machine and Nyström landmarks.

The kernel of two words counts common subsequences of ORDER letters, each weighed by DECAY to the
power of the length it spans in either word, normalised to 1 for equal words and raised to POWER.
Gaps and inserted letters only weaken a match.  Words are read without marks ("st.up-id" is
"stupid"); very long ones in windows, runs of single letters ("i d i o t") as one word.  The kernel
of two sentences is the sum over the pairs of their different words, so the machine's value of a
sentence is the sum of a function of its words; of a text it is the highest value of its sentences.

The machine (squared hinge, Newton steps) is trained on the sentences of labelled texts: of each
toxic text on the one that it, so far, values most; of the others on all, with half the weight on
those that were their text's highest.  Its Nyström landmarks are words of these sentences, chosen in
rounds where the loss falls most steeply.  A text's score is a logistic function of its two highest
sentences, fitted on labelled texts that the machine has not seen.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewake.llm import textcore

ORDER = 3
DECAY = 0.6
POWER = 2
#: Letters of a word at most; longer ones are read in windows of so many, of which the highest counts.
WINDOW = 20
#: A sentence ends after a word that ends in one of these bytes, at a line's end, or after so many words.
END_MARKS = np.zeros(256, bool)
END_MARKS[[ord(c) for c in ".!?"]] = True
SENTENCE_WORDS = 40
#: Most letters of a stretch of single letters that is read as a word; the run is also read whole.
SPELLED = 12
#: Bounds of the labelled sample that is fitted: toxic and other texts, and bytes of one of them.
TOXIC_TEXTS = 1500
OTHER_TEXTS = 3000
TEXT_BYTES = 8000
LANDMARKS = 80
LANDMARK_ROUNDS = 6
#: Rounds of choosing witnesses after the last landmarks are chosen.
EXTRA_ROUNDS = 4
#: Words that landmarks are chosen from in a round, and the kernel below which two of them are apart.
CANDIDATES = 600
APART = 0.8
#: Part of the labelled sample that is kept from the machine for the logistic: one in so many.
KEPT_BACK = 4
#: Subsequences that are looked up at once.
CELLS = 1 << 16
#: Slots of the table of word values that a task remembers.
SLOTS = 1 << 20
#: Bytes of texts that are read at once; a longer text is read by itself.
GROUP_BYTES = 4 << 20


def letters(word: str) -> str:
    word = word.lower()
    return word if word.isalnum() else "".join(filter(str.isalnum, word))


def codes(words: list[str], width: int = WINDOW) -> np.ndarray:
    """Code points, one row per word, zeros behind; words are at most ``width`` long."""
    return np.array([w.ljust(width, "\0") for w in words], dtype=f"<U{width}").view(np.uint32).reshape(len(words), width) if words else np.zeros((0, width), np.uint32)


def kernel(a: np.ndarray, b: np.ndarray, pairs: bool = False) -> np.ndarray:
    """Weights of common subsequences of rows of a with rows of b; with ``pairs``, row by row."""
    b_t = b if pairs else b[None]
    shape = (len(a),) if pairs else (len(a), len(b))
    wide = max(int((b != 0).sum(1).max(initial=0)), 1)
    long = max(int((a != 0).sum(1).max(initial=0)), 1)
    d, d2 = np.float32(DECAY), np.float32(DECAY * DECAY)
    total = np.zeros(shape, np.float32)
    # prior[p][j]: subsequences of length p within a so far and b before j, weighed up to both ends
    prior = [[np.ones(shape, np.float32) for _ in range(wide + 1)]] + [[np.zeros(shape, np.float32) for _ in range(wide + 1)] for _ in range(ORDER - 1)]
    for i in range(long):
        x = a[:, i] if pairs else a[:, i, None]
        met = [(x == b_t[..., j]) & (x != 0) for j in range(wide)]
        fresh: list = [prior[0]]
        for p in range(1, ORDER):
            run = np.zeros(shape, np.float32)
            rows = [prior[p][0] * d]
            for j in range(wide):
                run = run * d
                run += met[j] * prior[p - 1][j] * d2
                rows.append(prior[p][j + 1] * d + run)
            fresh.append(rows)
        for j in range(wide):
            total += met[j] * prior[ORDER - 1][j] * d2
        prior = fresh
    return total


def own_weight(a: np.ndarray) -> np.ndarray:
    return np.maximum(kernel(a, a, pairs=True), 1e-12)


class Landmarks:
    """Strings as vectors over their subsequences of ORDER (3) letters, to which others are compared.

    A string of n letters has n choose 3 of them, each weighed by DECAY to the power of its span.
    Only those that some landmark has count, so few are left of most strings.
    """

    def __init__(self, strings: np.ndarray):
        self.count = len(strings)
        alphabet = np.unique(strings[strings != 0])
        self.alphabet, self.base = alphabet, len(alphabet) + 1
        found = []
        for rows, triple, weight in self._subsequences(strings):
            at = np.repeat(rows, triple.shape[1])
            found.append((triple.ravel(), at, np.tile(weight, len(rows))))
        triple, owner, weight = (np.concatenate(x) if found else np.empty(0, np.int64) for x in (zip(*found) if found else ((), (), ())))
        names, place = np.unique(triple, return_inverse=True)
        self.table = np.full(self.base**ORDER, -1, np.int32)
        self.table[names.astype(np.int64)] = np.arange(len(names))
        self.vectors = np.zeros((len(names), self.count), np.float32)
        np.add.at(self.vectors, (place, owner.astype(np.int64)), weight)
        self.vectors /= np.sqrt(own_weight(strings))[None]

    def _subsequences(self, strings: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """By lengths, in groups of bounded size: rows, their subsequences' numbers (-1 with a letter unknown here), and the weights."""
        lengths = (strings != 0).sum(1)
        place = np.searchsorted(self.alphabet, strings)
        known = self.alphabet[np.minimum(place, len(self.alphabet) - 1)] == strings if len(self.alphabet) else np.zeros(strings.shape, bool)
        code = np.where(known, place + 1, 0)
        for n in np.unique(lengths[lengths >= ORDER]).tolist():
            i, j, k = np.array([(i, j, k) for i in range(n) for j in range(i + 1, n) for k in range(j + 1, n)]).T
            weight = np.float32(DECAY) ** (k - i + 1).astype(np.float32)
            rows = np.flatnonzero(lengths == n)
            step = max(1, CELLS // len(i))
            for group in (rows[a : a + step] for a in range(0, len(rows), step)):
                c = code[group]
                x, y, z = c[:, i], c[:, j], c[:, k]
                yield group, np.where((x > 0) & (y > 0) & (z > 0), (x * self.base + y) * self.base + z, -1), weight

    def kernel(self, strings: np.ndarray) -> np.ndarray:
        """The normalised kernel of strings with all landmarks."""
        out = np.zeros((len(strings), self.count), np.float32)
        if not len(self.vectors):
            return out
        for rows, triple, weight in self._subsequences(strings):
            name = np.where(triple >= 0, self.table[triple], -1)
            line, column = np.nonzero(name >= 0)
            if len(line):
                parts = self.vectors[name[line, column]] * weight[column, None]
                begin = np.flatnonzero(np.concatenate(([True], np.diff(line) > 0)))
                out[rows[line[begin]]] = np.add.reduceat(parts, begin, axis=0)
        own = np.concatenate([np.empty(0, np.float32)] + [own_weight(strings[a : a + 4096]) for a in range(0, len(strings), 4096)])
        return out / np.sqrt(own)[:, None]


def normal_kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Normalised kernel of all rows of a with all rows of b."""
    return Landmarks(b).kernel(a)


def word_kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return normal_kernel(a, b) ** POWER


def word_windows(word: str) -> list[str]:
    """A word's instances: itself, or its windows."""
    if len(word) <= WINDOW:
        return [word]
    return [word[at : at + WINDOW] for at in range(0, len(word) - WINDOW // 2, WINDOW // 2)]


@dataclass
class Model:
    """Landmark words, the machine's weights over them, and the text-level logistic."""

    landmarks: list[str]
    weights: np.ndarray
    bias: float
    logistic: tuple[float, float, float] = (4.0, 0.0, 0.0)

    def __post_init__(self):
        self.index = Landmarks(codes(self.landmarks))

    def of_words(self, words: list[str]) -> np.ndarray:
        """What each word adds to its sentence's value; of a long word the highest window."""
        if not self.landmarks:
            return np.zeros(len(words))
        return self._highest([word_windows(w) for w in words])

    def of_runs(self, runs: list[str]) -> np.ndarray:
        """The same for runs of single letters: of all stretches that may be a word, the highest counts."""
        if not self.landmarks:
            return np.zeros(len(runs))
        stretches = [{run[k : k + n] for n in range(ORDER + 1, SPELLED + 1) for k in range(len(run) - n + 1)} for run in runs]
        return self._highest([sorted(s) + word_windows(run) for s, run in zip(stretches, runs)])

    def _highest(self, groups: list[list[str]]) -> np.ndarray:
        parts = [w for group in groups for w in group]
        out = np.full(len(groups), -np.inf)
        if parts:
            values = self.index.kernel(codes(parts)) ** POWER @ self.weights
            np.maximum.at(out, np.repeat(np.arange(len(groups)), [len(g) for g in groups]), values)
        return out

    def of_text(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        a, b, c = self.logistic
        return 1 / (1 + np.exp(-np.clip(a * first + b * second + c, -35, 35)))


_LETTER = np.zeros(256, np.int64)
_LETTER[[b for b in range(128) if chr(b).isalnum()]] = 1
_LETTER[0xC0:] = 1


class Words:
    """The words of one text: hashes, places, the sentence of each, and the runs of single letters."""

    def __init__(self, data: np.ndarray):
        self.data = data
        self.hashes, self.starts, self.ends = textcore.located_words(data)
        n = len(self.starts)
        self.sentence = np.zeros(n, np.int64)
        self.spelled: list[tuple[int, str]] = []
        if not n:
            return
        lines = np.concatenate(([0], np.cumsum(data == 10)))
        over = END_MARKS[data[self.ends[:-1] - 1]] | (lines[self.starts[1:]] > lines[self.ends[:-1]])
        begins = np.concatenate(([0], np.flatnonzero(over) + 1))
        place = np.arange(n) - np.repeat(begins, np.diff(np.concatenate((begins, [n]))))
        self.sentence = np.cumsum(place % SENTENCE_WORDS == 0) - 1
        count = np.concatenate(([0], np.cumsum(_LETTER[data])))
        single = (count[self.ends] - count[self.starts] == 1).astype(np.int8)
        edges = np.flatnonzero(np.diff(np.concatenate(([0], single, [0]))))
        for a, b in zip(edges[::2], edges[1::2]):
            if b - a > ORDER:
                self.spelled.append((int(self.sentence[a]), letters(bytes(data[self.starts[a] : self.ends[b - 1]]).decode("utf-8", "ignore"))))

    def string(self, i: int) -> str:
        return letters(bytes(self.data[self.starts[i] : self.ends[i]]).decode("utf-8", "ignore"))


class Reader:
    """The two highest sentence values of texts; a table of bounded size remembers words by hash."""

    def __init__(self, model: Model):
        self.model = model
        self.keys, self.values = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.float32)

    def read(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        words = [Words(data) for data in texts]
        ends = np.cumsum([0] + [len(w.hashes) for w in words])
        flat = np.concatenate([w.hashes for w in words]) if words else np.empty(0, np.uint64)
        unique, at, back = np.unique(flat, return_index=True, return_inverse=True)
        owner = np.searchsorted(ends, at, side="right") - 1
        value = self._values(unique, lambda k: words[owner[k]].string(int(at[k] - ends[owner[k]])))
        # A word counts once in a sentence.
        begins = np.cumsum([0] + [int(w.sentence[-1]) + 1 if len(w.sentence) else 0 for w in words])
        place = np.concatenate([w.sentence + b for w, b in zip(words, begins)]) if words else np.empty(0, np.int64)
        once = np.unique(place * len(unique) + back) if len(unique) else place
        sums = np.bincount(once // max(1, len(unique)), value[once % max(1, len(unique))], begins[-1])
        first, second = np.full(len(texts), self.model.bias), np.full(len(texts), self.model.bias)
        spelled = [(i, s, string) for i, w in enumerate(words) for s, string in w.spelled]
        together = self.model.of_runs([string for _, _, string in spelled])
        np.add.at(sums, np.array([begins[i] + s for i, s, _ in spelled], np.int64), together)
        for i, (a, b) in enumerate(zip(begins[:-1], begins[1:])):
            if b > a:
                first[i] += sums[a:b].max()
                second[i] += np.partition(sums[a:b], b - a - 2)[-2] if b - a > 1 else 0.0
        return first, second

    def _values(self, unique: np.ndarray, string) -> np.ndarray:
        slot = (unique & np.uint64(SLOTS - 1)).astype(np.int64)
        value = self.values[slot]
        new = np.flatnonzero(self.keys[slot] != unique)
        if len(new):
            value[new] = self.model.of_words([string(k) for k in new.tolist()])
            self.keys[slot[new]], self.values[slot[new]] = unique[new], value[new]
        return value


@dataclass
class Sentences:
    """Labelled sentences as lists of numbered words; ``text`` numbers the text of each sentence."""

    strings: list[str]
    word: np.ndarray
    start: np.ndarray
    text: np.ndarray
    toxic: np.ndarray

    @classmethod
    def of_texts(cls, texts: list[bytes], labels: list[int]) -> Sentences:
        number: dict[str, int] = {}
        word, start, owner = [], [], []
        for i, raw in enumerate(texts):
            found = Words(np.frombuffer(raw, np.uint8))
            rows: list[list[int]] = [[] for _ in range(int(found.sentence[-1]) + 1 if len(found.sentence) else 0)]
            plain = [(int(s), found.string(k)) for k, s in enumerate(found.sentence)]
            for s, string in plain + found.spelled:
                rows[s] += [number.setdefault(w, len(number)) for w in word_windows(string) if len(w) >= ORDER]
            for row in rows:
                if row:
                    start.append(len(word))
                    word += dict.fromkeys(row)
                    owner.append(i)
        return cls(list(number), np.array(word, np.int64), np.array(start, np.int64), np.array(owner, np.int64), np.array(labels, np.int64)[owner] if owner else np.empty(0, np.int64))

    def sums(self, of_word: np.ndarray) -> np.ndarray:
        """Per sentence the sum of its words' rows."""
        out = np.empty((len(self.start), *of_word.shape[1:]), of_word.dtype)
        step = 4_000
        edges = np.append(self.start, len(self.word))
        for a in range(0, len(self.start), step):
            b = min(a + step, len(self.start))
            out[a:b] = np.add.reduceat(of_word[self.word[edges[a] : edges[b]]], edges[a:b] - edges[a], axis=0)
        return out

    def steepest(self, pull: np.ndarray, weight: np.ndarray, chosen: list[int], x: np.ndarray, count: int) -> list[int]:
        """Words along whose occurrence the loss falls most, each apart from those chosen before."""
        lengths = np.diff(np.append(self.start, len(self.word)))
        gradient = np.bincount(self.word, np.repeat(pull, lengths), len(self.strings))
        size = np.bincount(self.word, np.repeat(weight, lengths), len(self.strings))
        floor = 5 * weight.max(initial=1e-12)
        value = np.abs(gradient) / np.sqrt(size + floor)
        few = np.argsort(-value, kind="stable")[:CANDIDATES]
        value = value[few]
        found, apart = list(chosen), np.zeros(len(few))
        if chosen:
            apart = normal_kernel(x[few], x[chosen]).max(axis=1)
        while len(found) - len(chosen) < count and (apart < APART).any():
            k = int(np.argmax(np.where(apart < APART, value, -1)))
            found.append(int(few[k]))
            apart = np.maximum(apart, normal_kernel(x[few], x[[few[k]]])[:, 0])
        return found


def train_machine(sentences: Sentences, ridge: float = 1e-4, count: int = LANDMARKS, rounds: int = LANDMARK_ROUNDS) -> Model:
    """The machine on labelled sentences; with ``count`` no less than the words, the exact kernel machine."""
    bad = sentences.toxic == 1
    if not bad.any() or bad.all():
        return Model([], np.zeros(0), -1.0)
    x = codes(sentences.strings)
    per_text = np.bincount(sentences.text)[sentences.text]
    weight = np.where(bad, 1.0 / per_text, 1.0)
    weight = np.where(bad, weight / weight[bad].sum(), weight / weight[~bad].sum())
    y = np.where(bad, 1.0, -1.0)
    use = np.ones(len(y), bool)
    pull = weight * y
    chosen: list[int] = []
    kernels = np.zeros((len(x), 0), np.float32)
    value = np.zeros(len(y))
    hard = np.zeros(len(y))
    every = count >= len(x)
    beta = np.zeros(1)
    for turn in range(rounds + EXTRA_ROUNDS):
        if every and not turn:
            new = list(range(len(x)))
        else:
            new = sentences.steepest(pull, weight, chosen, x, -(-count // rounds)) if turn < rounds and not every else chosen
        if len(new) > len(chosen):
            kernels = np.hstack((kernels, word_kernel(x, x[new[len(chosen) :]])))
            chosen = new
        gram = kernels[chosen].astype(float)
        vals, vecs = np.linalg.eigh((gram + gram.T) / 2 + 1e-6 * np.eye(len(chosen)))
        root = vecs / np.sqrt(np.maximum(vals, 1e-6)) @ vecs.T
        z = np.hstack((sentences.sums(kernels) @ root.astype(np.float32), np.ones((len(y), 1), np.float32)))
        beta = newton(z, y, np.where(use, weight, 0.0), ridge)
        value = z @ beta
        # The witness of each toxic text: the sentence of the highest value.
        order = np.lexsort((-value, sentences.text))
        heads = order[np.concatenate(([True], np.diff(sentences.text[order]) > 0))]
        witness = np.zeros(len(y), bool)
        witness[heads] = True
        use = ~bad | witness
        # Other texts: half the weight for all sentences alike, half for those that were highest in their text.
        hard += ((witness & ~bad) / max(1, (witness & ~bad).sum()) - hard) * max(1 / (turn + 1), 0.3)
        weight = np.where(bad, witness / max(1, (witness & bad).sum()), 0.5 / (~bad).sum() + 0.5 * hard)
        pull = weight * y * np.maximum(0, 1 - y * value)
    return Model([sentences.strings[i] for i in chosen], (root @ beta[:-1]).astype(np.float32), float(beta[-1]))


def newton(z: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float) -> np.ndarray:
    """Weights that minimise sum(weight * hinge^2) + ridge * |w|^2, the last one a free bias."""
    beta = np.zeros(z.shape[1])
    keep = np.diag([ridge] * (z.shape[1] - 1) + [1e-9])
    chunks = [slice(a, a + 4096) for a in range(0, len(z), 4096)]

    def values(b: np.ndarray) -> np.ndarray:
        return np.concatenate([z[c].astype(float) @ b for c in chunks])

    def loss(b: np.ndarray) -> float:
        return float((weight * np.maximum(0, 1 - y * values(b)) ** 2).sum() + b @ keep @ b)

    for _ in range(50):
        slack = weight * np.maximum(0, 1 - y * values(beta))
        active = weight * (slack > 0)
        curve, pull = keep.copy(), -keep @ beta
        for c in chunks:
            part = z[c].astype(float)
            curve += (part * active[c, None]).T @ part
            pull += part.T @ (y[c] * slack[c])
        step = np.linalg.solve(curve, pull)
        size, now = 1.0, loss(beta)
        while size > 1e-4 and loss(beta + size * step) > now:
            size /= 2
        beta = beta + size * step
        if np.abs(step).max() < 1e-6:
            break
    return beta


def fit_logistic(first: np.ndarray, second: np.ndarray, label: np.ndarray) -> tuple[float, float, float]:
    """A ridge logistic on two values, both classes weighing alike."""
    if len(set(label.tolist())) < 2:
        return (4.0, 0.0, 0.0)
    x = np.stack((first, second, np.ones(len(first))), 1)
    w = np.where(label == 1, 0.5 / max(1, (label == 1).sum()), 0.5 / max(1, (label == 0).sum()))
    beta = np.array([1.0, 1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -35, 35)))
        grad = x.T @ (w * (p - label)) + 2e-3 * beta * [1, 1, 0]
        hess = (x * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 2e-3 * np.diag([1.0, 1.0, 1e-3])
        step = np.linalg.solve(hess, grad)
        beta -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(b) for b in beta)


def labelled_sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, toxic_texts: int, other_texts: int, text_bytes: int) -> DataFrame:
    """(text, label, back) of a bounded sample of labelled rows, the first of either label by hash, of texts of a bounded length."""
    known = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.max(label).alias("y"))
    by_hash = F.xxhash64(F.col("k").cast("string"))
    chosen = known.filter("y = 1").orderBy(by_hash).limit(toxic_texts).union(known.filter("y = 0").orderBy(by_hash).limit(other_texts))
    chosen = chosen.withColumn("back", F.pmod(F.xxhash64(F.lit("back"), F.col("k").cast("string")), F.lit(KEPT_BACK)) == 0)
    texts = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).filter(F.octet_length("t") <= text_bytes)
    return texts.join(F.broadcast(chosen), "k").select("t", F.col("y").cast("int").alias("y"), "back").distinct()


def fit(texts: list[tuple[bytes, int, bool]]) -> Model:
    """The machine and its logistic from (text, label, kept back)."""
    seen = [r for r in texts if not r[2]]
    model = train_machine(Sentences.of_texts([r[0] for r in seen], [r[1] for r in seen]))
    back = [r for r in texts if r[2]]
    if len({r[1] for r in back}) < 2:
        back = texts
    first, second = Reader(model).read([np.frombuffer(r[0], np.uint8) for r in back])
    model.logistic = fit_logistic(first, second, np.array([r[1] for r in back], float))
    return model


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", toxic_texts: int = TOXIC_TEXTS, other_texts: int = OTHER_TEXTS, text_bytes: int = TEXT_BYTES) -> Model:
    """Fit on at most ``toxic_texts`` and ``other_texts`` of the labelled rows that are given, of at most ``text_bytes`` each.

    Copies of one text count once.  Null labels, keys and texts are left out; without both labels
    every text scores low.  Ties in the order by hash do not matter: keys are distinct.  One task
    fits and sends the model, so the driver holds neither the sample nor its kernels.
    """
    sample = labelled_sample(docs, labels, key, text, label, toxic_texts, other_texts, text_bytes)

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(t.encode(), y, back) for batch in batches for t, y, back in zip(*(c.to_pylist() for c in batch.columns))]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(sorted(rows)))], pa.binary())], ["model"])

    found = sample.repartition(1).mapInArrow(textcore.lean(fitted), "model binary").collect()
    return pickle.loads(bytes(found[0]["model"])) if found else fit([])


def score_texts(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text", score: str = "score") -> DataFrame:
    """keep's columns and ``score`` in 0..1 of every whole text; null and empty texts score as having no word.

    Null keys, ties and repeated rows stay, one row each; an empty table gives an empty one; columns
    beyond those named do not matter, but ``score`` must not be among keep.  Very long texts are
    read whole, in segments.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    slim = docs.select(*keep) if text in keep else docs.select(*keep, F.col(text).alias("__text"))
    place = list(keep).index(text) if text in keep else len(keep)
    schema = T.StructType([slim.schema[c] for c in keep] + [T.StructField(score, T.DoubleType())])

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        for batch in batches:
            scores = [shared.value.of_text(*reader.read(texts)) for _, texts in textcore.text_groups(batch, place, GROUP_BYTES)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(np.concatenate(scores) if scores else np.empty(0))], [*keep, score])

    return slim.mapInArrow(textcore.lean(values), schema)
