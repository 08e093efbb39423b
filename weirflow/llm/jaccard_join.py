"""Similarity join on word shingles: texts whose shingle sets have a Jaccard similarity of ``PERCENT`` or more.

Sets meet under rare shingles. Two sets that similar share at least ``PERCENT`` of the
larger one, so in any common order of all shingles they meet within the first
``size - least + 1`` of both. The order puts shingles of low hash first, rare before frequent among
them, then the others: a document's first shingles are mostly its own, and what
many documents share, a licence or a quoted passage, comes last. Only shingles of low
hash (``LOW`` of all) are counted over the corpus; any share gives the same result.

The sets under one shingle are a group; of groups with the same members one is kept. Each group is
searched by the dual traversal of a signature tree (``signature_tree``), and the pairs that it
can't exclude are verified by their whole sets, which are made anew from the texts of those documents alone. Components spare work, never a link between two of them: a first
round compares each set with the one of its groups that meets most others, as an original does among its
copies; a second one takes each set's best pair of the trees; the last one all pairs of the trees whose ends
are in different components by then. A group of more than ``BLOCK`` bytes is cut into blocks of one size
band, and of one component where that is large, and only pairs of blocks that may hold a link meet in a task.

Equal sets are one node, whatever the number of their copies.

Edge cases: a null or wordless text has the empty set and is linked with nothing, so it is its own component;
fewer words than a shingle has are one shingle of their own kind; repeated rows keep one row each; null ids take part but are never the smallest
(a component of nothing else has a null); an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.llm import signature_tree, simhash
from weirflow.llm.components import components
from weirflow.llm.storage import as_scan, located, small, small_or_plain, written

SHINGLE, PERCENT, LOW, BLOCK = 4, 85, 0.3, 32 << 20
#: Words whose hashes a task keeps, and the longest of them in bytes.
KNOWN, LONG = 200_000, 64
KEY = ["__file", "__row"]
#: Odd multipliers that mix hashes of words.
TIMES = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)]


class Words(dict):
    """Hashes of words, of short ones kept up to a bound."""

    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh64_intdigest(word)
        if len(word) <= LONG:
            if len(self) >= KNOWN:
                self.clear()
            self[word] = found
        return found


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * TIMES[1]
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, known: Words, length: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles."""
    words = (text or "").encode().lower().split()  # of bytes: ASCII letters and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < length:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), len(words))], np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = len(words) - length + 1
    out = h[:n]
    for i in range(1, length):
        out = mixed(out * TIMES[0]) + h[i : n + i]
    return np.unique(mixed(out))


def least_shared(size: int, percent: int) -> int:
    """Tokens that a set of ``size`` shares at least with one that is similar."""
    return -(-percent * size // 100)


def read(docs: DataFrame, length: int, percent: int, low: float, prints: bool = False) -> DataFrame:
    """A row a document: its set's digest, size, bitmap and first shingles, with an id ``rid``, and the SimHash ``fp`` of the set if ``prints``.

    ``low`` holds the shingles of low hash. ``spare`` is how many more than those the
    first ones are, and ``fill`` holds as many of the others.
    """
    bound = np.uint64(int(low * 2**64)) if low < 1 else ~np.uint64(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rid = Words(), TaskContext.get().partitionId() << 38
        for batch in batches:
            digests, sizes, counts, spares, lows, fills, maps, fps = [], [], [], [], [], [], [], []
            for text in batch.column("text"):
                found = shingles(text.as_py(), known, length)
                few = int(np.searchsorted(found, bound))
                spare = len(found) - least_shared(len(found), percent) + 1 - few if len(found) else 0
                digests.append(xxhash.xxh3_128_digest(found.tobytes()))
                sizes.append(len(found))
                counts.append(few)
                spares.append(spare)
                lows.append(found[:few].view(np.int64))
                fills.append(found[few : few + max(0, spare)].view(np.int64))
                maps.append(signature_tree.bitmap(found).tobytes())
                fps.append(simhash.of_hashes(found) if prints else 0)
            ids = pa.array(np.arange(rid, rid + batch.num_rows))
            rid += batch.num_rows
            lists = [pa.array(v, pa.list_(pa.int64())) for v in (lows, fills)]
            made = [ids, pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array(spares, pa.int64()), *lists, pa.array(maps, pa.binary()), pa.array(fps, pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("doc_id", *KEY)), *made], ["doc_id", *KEY, "rid", "digest", "size", "few", "spare", "low", "fill", "bits", "fp"])

    kind = dict(docs.dtypes)["doc_id"]
    return located(docs, "doc_id", "text").mapInArrow(run, f"doc_id {kind}, __file string, __row long, rid long, digest binary, size long, few long, spare long, low array<long>, fill array<long>, bits binary, fp long")


def first_shingles(rows: DataFrame) -> DataFrame:
    """``rid`` and ``token``, the first shingles of each set but those of low hash that no other set has."""
    tokens = rows.select("rid", F.explode("low").alias("token"))
    shared = tokens.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    listed = tokens.join(shared, "token").groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("all"))  # a document's own shingles
    # of the first ``few + spare`` shingles ``few - size(all)`` are the set's own alone, the rest are the rarest of ``all``
    taken = F.greatest(F.lit(0), F.least(F.size("all"), F.size("all") + F.col("spare"))).cast("int")
    common = listed.join(rows.select("rid", "spare"), "rid").select("rid", F.explode(F.slice("all", F.lit(1), taken)).alias("t")).select("rid", "t.token")
    return common.unionByName(rows.select("rid", F.explode("fill").alias("token")))


def groups(first: DataFrame) -> DataFrame:
    """``token``, ``rid`` and ``n``, the members of each group of two or more sets; of groups with the same members one."""
    same = [F.expr("bit_xor(xxhash64(rid))").alias("a"), F.expr("bit_xor(xxhash64(rid, 1))").alias("b")]
    held = first.groupBy("token").agg(F.count("*").alias("n"), *same).where("n > 1")
    kept = held.groupBy("n", "a", "b").agg(F.min("token").alias("token")).select("token", "n")
    return first.join(small_or_plain(written(kept, "jaccard-groups")), "token").select("token", "rid", "n")


def sets(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """``rid`` and ``hashes``, the set, of the rows that ``wanted`` (rid, __file, __row, perhaps with a hint) names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for batch in batches:
            found = [shingles(t.as_py(), known, length).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("rid"), pa.array(found, pa.binary())], ["rid", "hashes"])

    rows = located(docs, "text").join(wanted, KEY).select("rid", "text")
    return rows.mapInArrow(run, "rid long, hashes binary")


def beside(pairs: DataFrame, held: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """``pairs`` (hi, lo) with ``columns`` of both ends, found in ``held`` by ``rid``, as ``a_`` and ``b_``."""
    side = lambda end, name: held.select(F.col("rid").alias(end), *(F.col(c).alias(f"{name}_{c}") for c in columns))
    return pairs.join(side("hi", "a"), "hi").join(side("lo", "b"), "lo")


def filtered(pairs: DataFrame, test: Callable[..., bool], columns: tuple[str, ...]) -> DataFrame:
    """The ``pairs`` for which ``test`` holds, of the ``columns`` of one end and then the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(f"{end}_{c}") for end in "ab" for c in columns))
            yield batch.select(["hi", "lo"]).filter(pa.array([test(*(v.as_py() for v in r)) for r in rows], pa.bool_()))

    return pairs.mapInArrow(run, "hi long, lo long")


def possible(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """The ``pairs`` (hi, lo) that sizes and bitmaps don't exclude."""

    def test(size_a: int, a: bytes, size_b: int, b: bytes) -> bool:
        return signature_tree.may_be_alike(np.frombuffer(a, np.uint64), size_a, np.frombuffer(b, np.uint64), size_b, percent)

    columns = ("size", "bits")
    near = F.lit(100) * F.least("a_size", "b_size") >= percent * F.greatest("a_size", "b_size")
    return filtered(beside(pairs, rows, columns).where(near), test, columns)


def verified(docs: DataFrame, pairs: DataFrame, rows: DataFrame, length: int, percent: int) -> DataFrame | None:
    """The ``pairs`` (hi, lo) whose whole sets are similar; None without pairs."""

    def alike(x: bytes, y: bytes) -> bool:
        a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        both = len(np.intersect1d(a, b, assume_unique=True))
        return 100 * both >= percent * (len(a) + len(b) - both)

    pairs = written(pairs, "jaccard-pairs")
    met = written(pairs.select(F.explode(F.array("hi", "lo")).alias("rid")).distinct(), "jaccard-ends")
    few = small(met)
    if few == 0:
        return None
    hinted = F.broadcast if few else lambda df: df  # as many rows in both tables, each narrow
    held = written(sets(docs, hinted(rows.select("rid", *KEY).join(hinted(met), "rid")), length), "jaccard-sets")
    return written(filtered(beside(pairs, held, ("hashes",)), alike, ("hashes",)), "jaccard-links")


def ends(a: str, b: str) -> list[Column]:
    return [F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")]


def starred(members: DataFrame) -> DataFrame:
    """For each set a pair with the one of its groups that meets most others, that of most of its groups."""
    met = members.groupBy("rid").agg(F.sum("n").alias("met"))
    own = members.join(met, "rid")
    hubs = own.groupBy("token").agg(F.max(F.struct("met", "rid")).alias("hub")).select("token", F.col("hub.rid").alias("other"))
    next_to = own.join(hubs, "token").where("rid <> other").groupBy("rid", "other").count()
    best = next_to.groupBy("rid").agg(F.max_by("other", F.struct("count", "other")).alias("other"))
    return best.select(*ends("rid", "other")).distinct()


def dealt(members: DataFrame, percent: int, block: int) -> DataFrame:
    """``members`` (token, rid, root, size, bits) with ``i`` and ``j``, the pair of blocks, and ``own``, the block of the row."""
    one = F.lit(0).cast("long")
    heavy = F.octet_length("bits").cast("long")
    hot = members.groupBy("token").agg(F.sum(heavy).alias("bytes")).where(F.col("bytes") > block).select("token")
    if hot.isEmpty():
        return members.withColumns({"i": one, "j": one, "own": one})
    hot = written(hot, "jaccard-hot")
    plain = members.join(hot, "token", "left_anti").withColumns({"i": one, "j": one, "own": one})
    band = F.floor(F.log(F.col("size").cast("double")) / signature_tree.band_width(percent)).cast("long")
    rows = members.join(hot, "token").withColumn("band", band)
    by_root = rows.groupBy("token", "band", "root").agg(F.sum(heavy).alias("bytes"))
    shares = by_root.withColumn("k", F.ceil(F.col("bytes") / block))
    rest = shares.where("k = 1").groupBy("token", "band").agg(F.ceil(F.sum("bytes") / block).alias("rest"))
    shares = written(shares.join(rest, ["token", "band"], "left").select("token", "band", "root", "k", "rest"), "jaccard-shares")
    alone = F.xxhash64("band", "root", F.pmod(F.xxhash64("rid"), F.col("k")))
    rows = rows.join(shares, ["token", "band", "root"]).withColumn("own", F.when(F.col("k") > 1, alone).otherwise(F.xxhash64("band", F.pmod(F.xxhash64("root"), F.col("rest"))))).drop("k", "rest")
    blocks = written(rows.groupBy("token", "own", "band").agg(F.min("root").alias("a"), F.max("root").alias("b")), "jaccard-blocks")
    other = blocks.select("token", F.col("own").alias("j"), F.col("band").alias("other_band"), F.col("a").alias("c"), F.col("b").alias("d"))
    near = (F.abs(F.col("band") - F.col("other_band")) <= 1) & (F.col("own") <= F.col("j")) & ~((F.col("a") == F.col("b")) & (F.col("c") == F.col("d")) & (F.col("a") == F.col("c")))
    meet = blocks.join(other, "token").where(near).select("token", F.col("own").alias("i"), "j")
    each = meet.select("*", F.col("i").alias("own")).unionByName(meet.where("i <> j").select("*", F.col("j").alias("own")))
    return plain.unionByName(rows.join(each, ["token", "own"]).select(*plain.columns))


def searched(members: DataFrame, percent: int, block: int, best: bool) -> DataFrame:
    """Pairs ``hi``, ``lo`` of different roots that the trees of the groups can't exclude; with ``best`` the best of each set and group."""

    def found(rows: list[dict]) -> tuple[list[int], list[int]]:
        sizes, roots = (np.array([r[k] for r in rows], np.int64) for k in ("size", "root"))
        maps, ids = [np.frombuffer(r["bits"], np.uint64) for r in rows], [r["rid"] for r in rows]
        own = np.array([r["own"] for r in rows])
        if rows[0]["i"] == rows[0]["j"]:
            x = y = signature_tree.tree(sizes, roots, maps, percent)
            places = [np.arange(len(rows))] * 2
        else:
            places = [np.flatnonzero(own == rows[0][k]) for k in ("i", "j")]
            x, y = (signature_tree.tree(sizes[p], roots[p], [maps[i] for i in p], percent) for p in places)
        a, b, bound = signature_tree.pairs(x, y, percent)
        a, b = places[0][a], places[1][b]
        if best and len(a):
            ends, others = np.concatenate([a, b]), np.concatenate([b, a])
            score = np.tile(bound / (sizes[a] + sizes[b]), 2)
            order = np.lexsort((-score, ends))
            first = order[np.r_[True, ends[order][1:] != ends[order][:-1]]]
            a, b = ends[first], others[first]
        return [max(ids[p], ids[q]) for p, q in zip(a, b)], [min(ids[p], ids[q]) for p, q in zip(a, b)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in batch.to_pylist())
        hi, lo = [], []
        for _, group in groupby(rows, lambda r: (r["token"], r["i"], r["j"])):
            a, b = found(list(group))  # BLOCK bytes of bitmaps twice at most
            hi, lo = hi + a, lo + b
            if len(hi) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(hi, pa.int64()), pa.array(lo, pa.int64())], ["hi", "lo"])
                hi, lo = [], []
        yield pa.RecordBatch.from_arrays([pa.array(hi, pa.int64()), pa.array(lo, pa.int64())], ["hi", "lo"])

    blocks = ["token", "i", "j"]
    rows = dealt(members, percent, block).repartition(*blocks).sortWithinPartitions(*blocks)
    return rows.mapInArrow(run, "hi long, lo long").distinct()


def links(docs: DataFrame, rows: DataFrame, length: int, percent: int, block: int, first: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Links ``hi``, ``lo`` that connect all sets of ``rows`` that are similar: each node of a component but one, with the smallest."""
    members = written(groups(written(first_shingles(rows), "jaccard-first")), "jaccard-members")
    likely = starred(members).unionByName(first(rows)).distinct() if first else starred(members)
    found = verified(docs, possible(likely, rows, percent), rows, length, percent)
    roots = components(likely.limit(0) if found is None else found)
    for best in (True, False):
        own = members.join(roots, members.rid == roots.hi, "left").select("token", "rid", F.coalesce("lo", "rid").alias("root"))
        own = written(own, "jaccard-rooted")
        several = written(own.groupBy("token").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("token"), "jaccard-mixed")
        left = own.join(several, "token").join(rows.select("rid", "size", "bits"), "rid")
        found = verified(docs, searched(left, percent, block, best), rows, length, percent)
        roots = roots if found is None else components(roots.unionByName(found))
    return roots


def joined(
    docs: DataFrame, length: int = SHINGLE, percent: int = PERCENT, low: float = LOW, block: int = BLOCK, empties: bool = False, first: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, size (of its set), root (a component's node), component_id (its smallest doc_id), __file, __row.

    With ``empties`` texts without words are one component, else each is its own. ``first`` makes pairs (hi, lo) of the
    distinct sets (rid, fp, their SimHash, and others) that are verified before any search.
    """
    docs = as_scan(docs)
    every = written(read(docs, length, percent, low, first is not None), "jaccard-rows")
    nodes = written(every.groupBy("digest").agg(F.min("rid").alias("node"), F.min("doc_id").alias("first_id"), F.first("size").alias("size")), "jaccard-nodes")
    narrow = every.select("doc_id", "rid", "digest", "size", *KEY)
    copies = written(narrow.join(nodes.select("digest", "node"), "digest").where("rid <> node").select("rid"), "jaccard-copies")
    rows = every.where("size > 0").join(small_or_plain(copies), "rid", "left_anti")
    roots = links(docs, rows, length, percent, block, first)
    rooted = nodes.join(roots, nodes.node == roots.hi, "left").select("digest", "first_id", F.coalesce("lo", "node").alias("root"))
    rooted = written(rooted, "jaccard-roots")
    firsts = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    labels = written(rooted.join(firsts, "root").select("digest", "root", "component_id"), "jaccard-labels")
    empty = (F.col("size") == 0) & F.lit(not empties)
    return narrow.join(labels, "digest").select(
        "doc_id", "size", F.when(empty, F.col("rid")).otherwise(F.col("root")).alias("root"), F.when(empty, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), *KEY
    )
