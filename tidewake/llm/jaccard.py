"""Exact n-gram Jaccard join and its connected components, by token-combination prefixes.

A document is its set of distinct word shingles (its tokens, 64-bit hashes).  Under one order of
all tokens - rare ones first, frequent ones by the class of their count, within a class by hash -
two sets of Jaccard >= t share a token among their first n - ceil(t n) + 1.  So rare tokens are
indexed alone.  A set that runs out of rare tokens has its prefix extended over its frequent tokens,
which are indexed in combinations of two neighbours (in that order): with M tokens missed on both
sides, M <= 0.3 n for t = 0.85, the first 0.3 n + 2 of them hold a neighbouring pair that both sets
share.  Sets that are equal are one node.

Which tokens count as frequent, and their classes, only steer the work: any choice gives the same
links.  They are counted over all documents; at most FREQUENT_MOST of them are named, the most
frequent ones.

Postings are not expanded into pairs at first.  In round k each posting links its nodes to 8^k
pivots; links found are contracted, and only nodes of different components meet again.  As soon as
the pairs left between components are no more than a further round would compare, each of them is
compared: after at most as many rounds as the longest posting has octal digits.

Signatures that many nodes have are salted: a row of theirs goes to one of several tasks, the few
rows that it meets go to all of them.  Other joins on keys that may be hot (pivots, mass copies) end
in their join, so that adaptive execution splits it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.llm import textcore
from tidewake.llm.components import connected_components
from tidewake.llm.skew import hot_keys, salted_join
from tidewake.llm.workspace import Workspace

FREQUENT_FROM = 16
FREQUENT_MOST = 1_000_000
#: Tokens of a set that are counted, as a multiple of its prefix; and the share of frequent ones
#: among them from which all tokens of the set are counted.
ZONE = 1.3
DOMINATED = 0.2
#: Pivots of a posting in the first round, and by how much each round multiplies them.
PIVOTS, GROWTH = 1, 8
#: Document keys broadcast at most when the texts of candidates are fetched (8 bytes each).
BROADCAST_KEYS = 400_000


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _sets(batch: pa.RecordBatch, words: int) -> Iterator[np.ndarray]:
    for data in textcore.text_bytes(batch.column(1)):
        yield textcore.shingle_set(textcore.word_hashes(data), words)


def _fingerprint(tokens: np.ndarray) -> int:
    """64 bits of a set; with its size they name a node."""
    if not len(tokens):
        return 0
    odd = np.arange(1, 2 * len(tokens), 2, dtype=np.uint64)
    return int(np.int64(textcore.mix(np.array([np.sum(textcore.mix(tokens + odd) * odd)], np.uint64)).view(np.int64)[0]))


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0] + [len(x) for x in rows]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(_signed(np.concatenate(rows)) if rows else np.empty(0, np.int64)))


def _prefix(n: int, percent: int) -> int:
    """How many first tokens of a set hold one that a linked set has too."""
    return n - -(-n * percent // 100) + 1 if n else 0


def _stretch(n: int, percent: int) -> int:
    """How many first frequent tokens hold a neighbouring pair that a linked set has too."""
    return -(-2 * n * (100 - percent) // 100) + 2


class JaccardJoin:
    """Links and components of the texts of ``docs`` whose shingle sets have Jaccard >= percent / 100."""

    def __init__(self, docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, percent: int = 85):
        self.docs = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
        self.words, self.percent = words, percent
        self.spark = docs.sparkSession
        self.work = Workspace(self.spark, "jaccard")
        self.rounds: list[dict] = []

    def _scan(self) -> DataFrame:
        """(k, n, fp, tokens): per document its set's size and fingerprint and the first tokens by hash."""
        words, percent = self.words, self.percent

        def scan(batches):
            for batch in batches:
                sets = list(_sets(batch, words))
                sizes = pa.array([len(s) for s in sets], pa.int64())
                prints = pa.array([_fingerprint(s) for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), sizes, prints, _lists([s[: int(ZONE * _prefix(len(s), percent)) + 2] for s in sets])], ["k", "n", "fp", "tokens"])

        return self.docs.mapInArrow(textcore.lean(scan), "k long, n long, fp long, tokens array<long>")

    def _counted(self, tokens: DataFrame, name: str) -> tuple[np.ndarray, np.ndarray]:
        """The most frequent of exploded tokens, at most FREQUENT_MOST of them, sorted, and the class (binary digits) of their counts."""
        counted = tokens.groupBy("token").count().filter(F.col("count") >= FREQUENT_FROM)
        counted = self.work.save(counted, name)
        by_power = counted.groupBy(F.floor(F.log2("count")).alias("power")).count().orderBy(F.desc("power")).collect()
        least, total = FREQUENT_FROM, 0
        for row in by_power:
            total += row["count"]
            if total > FREQUENT_MOST:
                least = 2 ** (row["power"] + 1)
                break
        chosen = counted.filter(F.col("count") >= least).select("token", F.floor(F.log2("count")).cast("int").alias("power")).toArrow()
        token = chosen.column(0).to_numpy().view(np.uint64)
        order = np.argsort(token)
        return token[order], chosen.column(1).to_numpy().astype(np.uint8)[order]

    def _frequent(self, nodes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Frequent tokens and their classes: counted near all sets' prefixes, then over all of the sets that these dominate."""
        near, near_class = self._counted(nodes.select(F.explode("tokens").alias("token")), "frequent-near")
        shared = self.spark.sparkContext.broadcast(near)

        def dominated(batches):
            for batch in batches:
                lists = batch.column(1)
                ends = lists.offsets.to_numpy()
                flat = lists.values.to_numpy().view(np.uint64)[ends[0] : ends[-1]]
                heavy = shared.value
                hit = heavy[np.minimum(np.searchsorted(heavy, flat), len(heavy) - 1)] == flat if len(heavy) else np.zeros(len(flat), bool)
                sums = np.concatenate(([0], np.cumsum(hit)))[ends - ends[0]]
                share = np.diff(sums) / np.maximum(np.diff(ends), 1)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(share > DOMINATED))], ["k"])

        keys = self.work.save(nodes.select("k", "tokens").mapInArrow(textcore.lean(dominated), "k long").distinct(), "dominated")
        sets = self._whole_sets(keys)
        far, far_class = self._counted(sets.select(F.explode("tokens").alias("token")), "frequent-far")
        tokens, at = np.unique(np.concatenate((near, far)), return_inverse=True)
        classes = np.zeros(len(tokens), np.uint8)
        np.maximum.at(classes, at, np.concatenate((near_class, far_class)))
        return tokens, classes

    def _whole_sets(self, keys: DataFrame) -> DataFrame:
        """(fp, n, tokens): the sets of the documents with these keys, each set once."""
        small = keys.count() <= BROADCAST_KEYS
        texts = self.docs.join(F.broadcast(keys) if small else keys, "k", "left_semi")
        words = self.words

        def full(batches):
            for batch in batches:
                sets = list(_sets(batch, words))
                yield pa.RecordBatch.from_arrays([pa.array([_fingerprint(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), _lists(sets)], ["fp", "n", "tokens"])

        return texts.mapInArrow(textcore.lean(full), "fp long, n long, tokens array<long>").groupBy("fp", "n").agg(F.first("tokens").alias("tokens"))

    def _signatures(self, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
        """(n, fp, rare, signs): per document its signatures, the first ``rare`` of them single tokens."""
        words, percent = self.words, self.percent
        shared = self.spark.sparkContext.broadcast(frequent)

        def sign(batches):
            heavy, classes = shared.value
            for batch in batches:
                out = []
                for s in _sets(batch, words):
                    if not len(s):
                        out.append((0, 0, 0, s))
                        continue
                    at = np.searchsorted(heavy, s)
                    common = heavy[np.minimum(at, len(heavy) - 1)] == s if len(heavy) else np.zeros(len(s), bool)
                    rare = s[~common]
                    if len(rare) >= (p := _prefix(len(s), percent)):
                        out.append((len(s), _fingerprint(s), p, rare[:p]))
                        continue
                    far = s[common][np.argsort(classes[at[common]], kind="stable")][: max(2, _stretch(len(s), percent) - 2 * len(rare))]
                    pairs = textcore.mix(far[:-1] * np.uint64(0x9FB21C651E98DF25) + far[1:])
                    out.append((len(s), _fingerprint(s), len(rare), np.concatenate((rare, pairs))))
                ints = [pa.array([x[i] for x in out], pa.int64()) for i in range(3)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *ints, _lists([x[3] for x in out])], ["k", "n", "fp", "rare", "signs"])

        signed = self.docs.mapInArrow(textcore.lean(sign), "k long, n long, fp long, rare long, signs array<long>")
        return signed.filter("k IS NOT NULL AND n > 0").groupBy("fp", "n", "rare").agg(F.first("signs").alias("signs"))

    def _postings(self, signed: DataFrame) -> DataFrame:
        """(sign, fp, n, reach) of the signatures that more than one node has."""
        signed = self.work.save(signed, "signed")
        counts = signed.select(F.explode("signs").alias("sign")).groupBy("sign").count().filter("count > 1").select("sign")
        rows = signed.select("fp", "n", "rare", F.posexplode("signs").alias("at", "sign"))
        # What a set can still share from its first common signature on: no token before it is shared.
        rows = rows.select("sign", "fp", "n", (F.col("n") - F.least("at", "rare")).alias("reach"))
        return rows.join(counts, "sign")

    def _may_link(self, a: str, b: str):
        """Whether the sizes and what can still be shared allow a link of rows a and b."""
        need = F.lit(self.percent) * (F.col(f"{a}.n") + F.col(f"{b}.n"))
        return (F.lit(100 + self.percent) * F.least(f"{a}.reach", f"{b}.reach") >= need) & (100 * F.least(f"{a}.n", f"{b}.n") >= self.percent * F.greatest(f"{a}.n", f"{b}.n"))

    def _fetch(self, pairs: DataFrame, nodes: DataFrame, known: DataFrame | None, name: str) -> DataFrame:
        """(fp, n, tokens) of the nodes in pairs, their texts read again."""
        wanted = pairs.select(F.col("a").alias("fp")).union(pairs.select(F.col("b").alias("fp"))).distinct()
        if known is not None:
            wanted = wanted.join(known.select("fp"), "fp", "left_anti")
        keys = self.work.save(nodes.join(wanted, "fp", "left_semi").select("k").distinct(), f"{name}-keys")
        found = self._whole_sets(keys)
        found = self.work.save(found, name)
        self.work.drop(f"{name}-keys")
        return found if known is None else known.union(found)

    def _verify(self, pairs: DataFrame, sets: DataFrame, name: str) -> DataFrame:
        """All pairs with whether they link."""
        first = sets.select(F.col("fp").alias("a"), F.col("n").alias("an"), F.col("tokens").alias("at"))
        second = sets.select(F.col("fp").alias("b"), F.col("n").alias("bn"), F.col("tokens").alias("bt"))
        with_b = pairs.join(first, "a").join(second, "b").select("a", "b", "an", "bn", F.size(F.array_intersect("at", "bt")).alias("both"))
        linked = with_b.select("a", "b", (100 * F.col("both") >= self.percent * (F.col("an") + F.col("bn") - F.col("both"))).alias("linked"))
        return self.work.save(linked, name)

    def _crossing(self, rows: DataFrame) -> DataFrame:
        """(sign, low, major) of the postings that join different components: their least size, and the component of most rows."""
        parts = rows.groupBy("sign", "component").agg(F.count("*").alias("m"), F.min("n").alias("low"))
        return parts.groupBy("sign").agg(F.min("low").alias("low"), F.max_by("component", "m").alias("major"), F.count("*").alias("components")).filter("components > 1").drop("components")

    def _pivots(self, rows: DataFrame, count: int, k: int, hot: DataFrame | None) -> DataFrame:
        """(sign, pivots): about ``count`` nodes of different components in each posting, the one that reaches farthest among them."""
        ahead = F.min(F.struct((-F.col("reach")).alias("back"), F.col("n"), F.col("fp"), F.col("component")))
        heads = rows.groupBy("sign", "component").agg(ahead.alias("head"))
        first = heads.groupBy("sign").agg(F.min("head").alias("first"), F.count("*").alias("components"))
        if count == 1:
            return first.select("sign", F.array("first").alias("pivots"))
        # A component's node is drawn with the chance count / components, the same on each run.
        heads = salted_join(heads, first, "sign", "component", hot)
        drawn = F.pmod(F.xxhash64("sign", "component", F.lit(k)), F.lit(1 << 20)) * F.col("components") < count * (1 << 20)
        heads = heads.filter(drawn | (F.col("head") == F.col("first")))
        return heads.groupBy("sign").agg(F.collect_list("head").alias("pivots"))

    def run(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(k, n, fp) of all documents; (fp, n, k) of nodes with the least key; (node, component) of linked nodes."""
        scanned = self.work.save(self._scan(), "scanned")
        grouped = scanned.filter("k IS NOT NULL AND n > 0").groupBy("fp", "n").agg(F.min("k").alias("k"), F.first("tokens").alias("tokens"))
        nodes = self.work.save(grouped, "nodes-with-tokens")
        scanned = self.work.save(scanned.select("k", "n", "fp"), "documents")
        self.work.drop("scanned")
        frequent = self._frequent(nodes)
        nodes = self.work.save(nodes.select("fp", "n", "k"), "nodes")
        self.work.drop("nodes-with-tokens")
        rows = self.work.save(self._postings(self._signatures(frequent)).withColumn("component", F.col("fp")), "postings")
        self.work.drop("signed")
        hot = hot_keys(rows, "sign", self.work, "hot-signs")
        done = sets = components = None
        k, count, last = 0, PIVOTS, False
        while not last:
            # A row that reaches too little for the posting's least size links with none of it.
            rows = salted_join(rows, self._crossing(rows), "sign", "fp", hot)
            least = F.greatest(F.col("low"), F.ceil(F.col("n") * self.percent / 100))
            rows = rows.filter(F.lit(100 + self.percent) * F.col("reach") >= self.percent * (F.col("n") + least))
            rows = self.work.save(rows.select("sign", "fp", "n", "reach", "component", "major"), f"rows-{k}")
            sums = rows.groupBy("sign", "component").count().groupBy("sign").agg(F.sum("count").alias("m"), F.sum(F.col("count") * F.col("count")).alias("mm"))
            left, total = sums.agg(F.coalesce(F.sum((F.col("m") * F.col("m") - F.col("mm")) / 2), F.lit(0)), F.coalesce(F.sum("m"), F.lit(0))).collect()[0]
            self.rounds.append({"rows": int(total), "pairs": int(left), "pivots": count})
            if not left:
                break
            last = left <= count * total
            y = rows.select("sign", "fp", "n", "reach", "component")
            if last:
                x = rows.filter("component != major").select("sign", F.struct((-F.col("reach")).alias("back"), "n", "fp", "component").alias("x"))
            else:
                x = self._pivots(rows, count, k, hot).select("sign", F.explode("pivots").alias("x"))
            x = x.select("sign", F.struct(F.col("x.fp").alias("fp"), F.col("x.n").alias("n"), (-F.col("x.back")).alias("reach"), F.col("x.component").alias("component")).alias("x"))
            met = salted_join(y, x, "sign", "fp", hot).withColumn("y", F.struct("fp", "n", "reach", "component"))
            met = met.filter((F.col("x.component") != F.col("y.component")) & self._may_link("x", "y")).select(F.least("x.fp", "y.fp").alias("a"), F.greatest("x.fp", "y.fp").alias("b")).distinct()
            met = self.work.save(met if done is None else met.join(done, ["a", "b"], "left_anti"), f"met-{k}")
            sets = self._fetch(met, nodes, sets, f"sets-{k}")
            checked = self._verify(met, sets, f"checked-{k}")
            self.work.drop(f"met-{k}")
            self.work.drop(f"contracted-{k - 1}" if k else "postings")
            done = checked if done is None else done.union(checked)
            components = connected_components(done.filter("linked").select("a", "b"), self.work, f"components-{k}")
            components = self.work.save(components, f"labels-{k}")
            self.work.drop(f"labels-{k - 1}")
            rows = rows.select("sign", "fp", "n", "reach").join(components, F.col("fp") == F.col("node"), "left").select("sign", "fp", "n", "reach", F.coalesce("component", "fp").alias("component"))
            if not last:
                rows = self.work.save(rows, f"contracted-{k}")
                self.work.drop(f"rows-{k}")
            k, count = k + 1, GROWTH * count
        if components is None:
            components = self.spark.createDataFrame([], "node long, component long")
        self.links = done
        return scanned, nodes, components


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, percent: int = 85) -> DataFrame:
    """(key, n_shingles, component_id) per row: the least key that a row reaches over links, itself included.

    Texts without words (or null) have no shingles and link with nothing; texts of fewer words than
    ``words`` are one shingle.  A null key gets its n_shingles and a null component_id and links
    with nothing.  Repeated rows stay, each with the same result; columns beyond key and text do
    not matter, whatever their names; an empty table gives an empty one.
    """
    scanned, nodes, components = JaccardJoin(docs, key, text, words, percent).run()
    labelled = nodes.join(components, F.col("fp") == F.col("node"), "left").select("fp", "n", "k", F.coalesce("component", "fp").alias("component"))
    least = labelled.groupBy("component").agg(F.min("k").alias("component_id"))
    named = labelled.join(least, "component").select("fp", "n", "component_id")
    found = scanned.filter("n > 0").join(named, ["fp", "n"], "left").select("k", "n", F.when(F.col("k").isNotNull(), F.col("component_id")).alias("component_id"))
    found = found.union(scanned.filter("n = 0").select("k", "n", F.col("k").alias("component_id")))
    return found.select(F.col("k").alias(key), F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, percent: int = 85) -> DataFrame:
    """docs without the rows that another one stands for: of each linked group the least key stays.

    Rows without words, and rows with a null key, stay.  Of repeated rows (equal key and text) one
    stays.  The rejected keys are broadcast only where they are few.
    """
    found = jaccard_components(docs, key, text, words, percent)
    work = Workspace(docs.sparkSession, "one-of-each")
    found = work.save(found.groupBy(key).agg(F.max(F.col("component_id") != F.col(key)).alias("drop"), F.count("*").alias("rows")).filter(F.col(key).isNotNull() & (F.col("drop") | (F.col("rows") > 1))), "found")
    small = found.count() <= BROADCAST_KEYS
    dropped, repeated = found.filter("drop").select(key), found.filter("NOT drop").select(key)
    kept = docs.join(F.broadcast(dropped) if small else dropped, key, "left_anti").select(docs.columns)
    if repeated.isEmpty():
        return kept
    side = F.broadcast(repeated) if small else repeated
    once = kept.join(side, key, "left_semi").dropDuplicates([key, text])
    return kept.join(side, key, "left_anti").unionByName(once).select(docs.columns)
