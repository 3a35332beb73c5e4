"""SimHash near-dedup: 64-bit fingerprints of word shingles, joined with themselves along a binary trie.

The trie of all different fingerprints is traversed as pairs of nodes: a pair of prefixes of equal length stays only while
the bits in which they differ are within the budget. That needs all of a region's fingerprints in one place, so Spark first
deals them out by a rule that loses no pair: cut the bits into one run more than the budget has bits, and two fingerprints
within the budget agree in at least one whole run. So each fingerprint goes, once for each run, to the node of a trie that
reads this run first, and only pairs of equal nodes need a look: rows grow with the fingerprints, not with pairs of nodes.
A node that holds too many is dealt out again in the same way by the bits not yet agreed on, until it is small or those bits
leave no room for many. Inside a task the traversal goes on breadth-first, both nodes of a pair being ranges of
one sorted array. What leaves a task is a spanning forest of the links it found, never all pairs of a group; the
components of the forests' union are those of all links.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.components import components
from millrace.llm.shared import cut, small_batches, stored

_ONE = np.uint64(1)
#: Node pairs that a step of the traversal takes on at most.
_PART = 1 << 17


def simhash(text: str | None, width: int = 3) -> int:
    """The fingerprint, unsigned: a bit is 1 if it is set in over half of the shingles' XXH64 (seed 42); 0 without words."""
    w = (text or "").encode().lower().split()  # of bytes: A-Z, and the six ASCII white-space characters
    if not w:
        return 0
    if len(w) < width:
        shingles = [b" ".join(w)]
    else:
        shingles = map(b" ".join, zip(*(w[k:] for k in range(width)), strict=False))
    seeded = xxhash.xxh64_intdigest
    hashes = np.fromiter((seeded(s, 42) for s in shingles), np.uint64)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):  # bounded memory for very long texts
        part = hashes[k : k + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprint(text: Column, width: int = 3) -> Column:
    """simhash() of a column, as a signed long with the same bits."""

    @F.arrow_udf("bigint")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([simhash(t.as_py(), width) for t in texts], np.uint64).view(np.int64))

    return of(text)


def _join(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """root with the links x-y merged: each entry the least index of its component."""
    while len(x):
        a, b = root[x], root[y]
        apart = a != b
        x, y, a, b = x[apart], y[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(further := root[root], root):
            root = further
    return root


def trie_forest(prints: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of sorted different uint64 fingerprints within `budget` bits, as (fingerprint, root of its component)."""
    root = np.arange(len(prints))
    # A node pair: ranges [alo, ahi) and [blo, bhi), bits spent, and whether both are the same node. Breadth first, but in
    # parts of bounded size: the rest of a level waits on the stack.
    waiting = [(0, np.array([[0, len(prints), 0, len(prints), 0, 1]], np.int64))]
    while waiting:
        bit, pairs = waiting.pop()
        if len(pairs) > _PART:
            waiting += [(bit, pairs[k : k + _PART]) for k in range(0, len(pairs), _PART)]
            continue
        small = ((pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2]) <= 48) | (bit >= 63)
        for k in range(0, int(small.sum()), 1 << 14):
            alo, ahi, blo, bhi, _, same = pairs[small][k : k + (1 << 14)].T
            n, m = ahi - alo, bhi - blo
            of = np.repeat(np.arange(len(n)), n * m)
            at = np.arange(len(of)) - np.repeat(np.cumsum(n * m) - n * m, n * m)
            x, y = alo[of] + at // m[of], blo[of] + at % m[of]
            near = (np.bitwise_count(prints[x] ^ prints[y]) <= budget) & ((same[of] == 0) | (x < y))
            root = _join(root, x[near], y[near])
        pairs = pairs[~small]
        if not len(pairs):
            continue
        alo, ahi, blo, bhi, used, same = pairs.T
        half, keep = _ONE << np.uint64(63 - bit), ~((_ONE << np.uint64(64 - bit)) - _ONE) if bit else np.uint64(0)
        amid = np.searchsorted(prints, (prints[alo] & keep) | half)
        bmid = np.searchsorted(prints, (prints[blo] & keep) | half)
        stack = lambda a, b, c, d, more, s: np.stack([a, b, c, d, used + more, s], 1)
        children = [stack(alo, amid, blo, bmid, 0, same), stack(amid, ahi, bmid, bhi, 0, same), stack(alo, amid, bmid, bhi, 1, 0 * same), stack(amid, ahi, blo, bmid, 1, 0 * same)[same == 0]]
        pairs = np.concatenate(children)
        waiting.append((bit + 1, pairs[(pairs[:, 0] < pairs[:, 1]) & (pairs[:, 2] < pairs[:, 3]) & (pairs[:, 4] <= budget)]))
    moved = root != np.arange(len(root))
    return prints[moved], prints[root[moved]]


def _runs(mask: int, budget: int, bits: int) -> list[int]:
    """mask with the first `bits` bits, or all if fewer, of each of budget + 1 runs of the bits that it lacks; as signed longs."""
    free = [b for b in range(63, -1, -1) if not mask >> b & 1]
    ends = [len(free) * k // (budget + 1) for k in range(budget + 2)]
    masks = [(mask & (2**64 - 1)) | sum(1 << b for b in free[i : min(i + bits, j)]) for i, j in zip(ends[:-1], ends[1:], strict=True)]
    return [m - (m >> 63 << 64) for m in masks]


def links(prints: DataFrame, budget: int = 2, leaf: int = 4096) -> DataFrame:
    """prints (fp), different longs -> (u, v): links that connect whatever is connected by pairs within `budget` bits.

    A node holds about `leaf` fingerprints, or four times that where a region is crowded.
    """

    def finish(group: pa.Table) -> pa.Table:
        u, v = trie_forest(np.sort(group["fp"].to_numpy().view(np.uint64)), budget)
        return pa.table({"u": u.view(np.int64), "v": v.view(np.int64)})

    # A row's node is what it has in the bits of the mask, those in which the node's fingerprints agree.
    n, rows, found = prints.count(), prints.select("fp", F.lit(0).cast("long").alias("mask")), []
    masks, bits = [0] * (n > leaf), math.ceil(math.log2(max(1, n) / leaf))
    while True:
        if masks:
            further = F.array().cast("array<bigint>")
            for m in masks:
                further = F.when(F.col("mask") == m, F.array(*[F.lit(x) for x in _runs(m, budget, bits)])).otherwise(further)
            rows = rows.withColumn("mask", F.explode(further))
        rows = rows.withColumn("node", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = rows.groupBy("mask", "node").agg(F.count("*").alias("n")).where((F.col("n") > 4 * leaf) & (F.bit_count("mask") < 64 - budget))
        large = cut(sizes)
        # Crowded nodes are dealt out by whole runs: 64 bits are soon used up, so few masks, and few copies of a row, come of it.
        masks, bits = [r.mask for r in large.select("mask").distinct().collect()], 64
        parted = rows.join(large, ["mask", "node"], "left") if masks else rows.withColumn("n", F.lit(None))
        found.append(parted.where("n is null").select("mask", "node", "fp").groupBy("mask", "node").applyInArrow(finish, "u long, v long"))
        if not masks:
            return reduce(DataFrame.unionByName, found)
        rows = parted.where("n is not null").select("fp", "mask")


def _grouped(prints: DataFrame, budget: int) -> DataFrame:
    """prints (id, fp) -> (fp, component_id) of each different fp."""
    nodes = cut(prints.groupBy("fp").agg(F.min("id").alias("least")))
    tree = components(links(nodes.select("fp"), budget))
    placed = cut(nodes.join(tree, nodes["fp"] == tree["u"], "left").select("fp", "least", F.coalesce("v", "fp").alias("root")))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return placed.join(least, "root").select("fp", "component_id")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, budget: int = 2) -> DataFrame:
    """One row for each row of docs: id, fingerprint (16 hex digits), component_id (the smallest id reachable by links).

    Texts lower-cased (A-Z) are cut into shingles of `width` words, repeats included; a text with fewer words is one
    shingle, one without words (or null) has fingerprint zero. Fingerprints link at `budget` or fewer differing bits,
    equal ones always. Repeated rows are rows of their own; null ids take part but are never the smallest, unless a group
    has no other. Texts are read whole, long ones piece by piece. Other columns of docs aren't returned. Empty input gives no rows.
    """
    small_batches(docs.sparkSession)
    prints = cut(docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col), width).alias("fp")))
    return prints.join(_grouped(prints, budget), "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _shingle_set(text: str | None, width: int) -> set[int]:
    w = (text or "").encode().lower().split()
    seeded = xxhash.xxh64_intdigest
    return {seeded(b" ".join(w[k : k + width]), 42) for k in range(max(1, len(w) - width + 1))}


def _common(texts: DataFrame, width: int) -> dict[int, int]:
    """Shingles that are frequent in a sample of some 10,000 documents, with their counts: they only order shingles, so the result doesn't depend on them."""

    @F.arrow_udf("array<bigint>")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([np.fromiter(_shingle_set(t.as_py(), width), np.uint64).view(np.int64) for t in texts], pa.list_(pa.int64()))

    n, whole = texts.count(), 1 << 62
    sample = texts.where(F.pmod(F.xxhash64("id"), F.lit(whole)) < min(whole, whole * 10_000 // max(1, n)))
    counts = sample.select(F.explode(of("text")).alias("tok")).groupBy("tok").agg(F.count("*").alias("n")).where("n > 2").orderBy(F.desc("n"), "tok").limit(100_000)
    return {r.tok & (2**64 - 1): r.n for r in counts.collect()}


def _sketches(texts: DataFrame, width: int, print_width: int, similarity: float) -> DataFrame:
    """(id, fp, digest, bits, n, toks): fingerprint, a digest of the set of n shingles, which of 256 slots an odd number of them falls into, and
    the first of them in one order for all, rare ones first.

    Two sets with a Jaccard similarity of `similarity` share at least that part of either, so each has a shared shingle among
    all but the last ceil(similarity x n) - 1 of its n: no such pair is without a common tok.
    """
    known = texts.sparkSession.sparkContext.broadcast(_common(texts, width))  # 100,000 entries at most

    @F.arrow_udf("struct<fp: bigint, digest: binary, bits: array<bigint>, n: int, toks: array<bigint>>")
    def of(texts: pa.Array) -> pa.Array:
        out, common = [], known.value
        for t in texts:
            found = _shingle_set(t := t.as_py(), width)
            n = len(found)
            first = sorted(found, key=lambda x: (common.get(x, 0), x))[: n - math.ceil(similarity * n - 1e-9) + 1]
            every = np.sort(np.fromiter(found, np.uint64))
            digest, fp = xxhash.xxh3_128_digest(every.tobytes()), simhash(t, print_width)
            bits = np.packbits(np.bincount((every & np.uint64(255)).astype(np.int64), minlength=256) & 1).view(np.int64)
            out.append({"fp": fp - (fp >> 63 << 64), "digest": digest, "bits": bits, "n": n, "toks": np.array(first, np.uint64).view(np.int64)})
        return pa.array(out, pa.struct([("fp", pa.int64()), ("digest", pa.binary()), ("bits", pa.list_(pa.int64())), ("n", pa.int32()), ("toks", pa.list_(pa.int64()))]))

    return texts.select("id", of("text").alias("x")).select("id", "x.*")


def _settled(links: DataFrame) -> DataFrame:
    """links (id, to) -> (id, to): the nodes that go, each with the least of those that stay and are linked to it; no two that stay are linked.

    In each round the nodes that come before all their neighbours stay, and these go. First come those with the most links, of equals in a random
    order (by a hash), in which the longest chain of nodes that wait for each other has about as many as the logarithm of their number: rounds are few.
    """
    both = links.select("id", "to").unionByName(links.select(F.col("to").alias("id"), F.col("id").alias("to"))).distinct()
    ranked = both.groupBy("id").agg(F.count("*").alias("n")).select("id", F.struct(-F.col("n"), F.xxhash64("id"), "id").alias("place"))
    links = cut(both.join(ranked, "id").join(ranked.select(F.col("id").alias("to"), F.col("place").alias("place_to")), "to"))
    gone = []
    while not links.isEmpty():
        stay = links.groupBy("id").agg(F.first("place").alias("place"), F.min("place_to").alias("next")).where("place < next").select(F.col("id").alias("to"))
        gone.append(cut(links.join(stay, "to").groupBy("id").agg(F.min("to").alias("to"))))
        done = cut(gone[-1].select("id").unionByName(stay.select(F.col("to").alias("id"))))
        links = cut(links.join(done, "id", "left_anti").join(done.select(F.col("id").alias("to")), "to", "left_anti"))
    return reduce(DataFrame.unionByName, gone) if gone else links.select("id", "to")


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, budget: int = 3, similarity: float = 0.8, print_width: int = 3, rounds: int = 4) -> DataFrame:
    """near_duplicates() with the columns of docs together in one, doc: whatever their names, none is lost."""
    boxed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(id_col).alias("id"))
    small_batches(docs.sparkSession)
    own = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    print_of = F.xxhash64("text")
    several = stored(own.groupBy("id").agg(F.min(print_of).alias("a"), F.max(print_of).alias("b"), F.count("*").alias("c")).where("c > 1"))
    same = several.where("a = b").select("id")
    texts = own.join(several.select("id"), "id", "left_anti")
    if not same.isEmpty():
        texts = texts.unionByName(own.join(same, "id").groupBy("id").agg(F.first("text").alias("text")))
    sketches = stored(_sketches(texts, width, print_width, similarity))
    # Copies, of which one represents the rest from here on.
    copies = stored(sketches.groupBy("digest").agg(F.min("id").alias("to"), F.count("*").alias("c")).where("c > 1"))  # so that Spark can split the join at a group of very many
    copies = stored(sketches.select("id", "digest").join(copies, "digest").where("id <> to").select("id", "to"))
    single = sketches.join(copies.select("id"), "id", "left_anti")
    prints = stored(single.select("id", "n", "bits"))
    of_print = stored(single.select("id", "fp"))
    groups = of_print.join(_grouped(of_print, budget), "fp").select("id", F.xxhash64("component_id").alias("tok"))
    # Lists of candidates: documents with a tok in common. What two sets share is at most what either has from the first shared tok on, so
    # this one's place in the smaller set is early, and a list in which no document has its tok early holds no pair.
    early = F.col("pos") <= (1 - similarity) / (1 + similarity) * F.col("n") + 1e-6
    places = single.select("id", "n", F.posexplode("toks").alias("pos", "tok"))
    useful = places.groupBy("tok").agg(F.count("*").alias("c"), F.max(early).alias("early")).where("c > 1 and early").select("tok")
    listed = stored(places.join(stored(useful), "tok").select("id", "tok", "pos"))
    # Of lists with the same members the first in the order of shingles is enough: what a pair shares first is in no later one.
    kinds = listed.groupBy("tok").agg(F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("members"), F.count("*").alias("c"), F.sum("pos").alias("p"))
    kinds = kinds.groupBy("members", "c").agg(F.min(F.struct("p", "tok"))["tok"].alias("tok")).select("tok")
    # Groups of fingerprints are lists too, without places. They only serve to take copies out early: the others hold all pairs.
    groups = stored(groups)
    groups = groups.join(stored(groups.groupBy("tok").count().where("count > 1").select("tok")), "tok").select("id", "tok", F.lit(None).cast("int").alias("pos"))
    alive = stored(listed.join(stored(kinds), "tok").unionByName(groups).join(prints, "id"))

    @F.arrow_udf("boolean")
    def alike(ones: pa.Array, others: pa.Array) -> pa.Array:
        out, known = [], {}
        for one, other in ((x.as_py(), y.as_py()) for x, y in zip(ones, others, strict=True)):
            if other not in known:  # rows come grouped by the document they are compared with
                known = {other: _shingle_set(other, width)}
            a, b = _shingle_set(one, width), known[other]
            out.append(len(a & b) >= similarity * len(a | b))
        return pa.array(out, pa.bool_())

    left = F.least(F.col("n") - F.col("pos"), F.col("m") - F.col("pos_to")) >= similarity / (1 + similarity) * (F.col("n") + F.col("m")) - 1e-6
    # A shingle that only one of two sets has changes one slot's parity, so slots that differ are no more than such shingles.
    slots = reduce(Column.__add__, [F.bit_count(F.col("bits")[k].bitwiseXOR(F.col("bits_to")[k])) for k in range(4)])
    close = slots <= (1 - similarity) / (1 + similarity) * (F.col("n") + F.col("m")) + 1e-6
    worth = (F.least("n", "m") >= similarity * F.greatest("n", "m") - 1e-9) & F.coalesce(left, F.lit(True)) & close

    def verified(pairs: DataFrame) -> DataFrame:
        """Of pairs (id, to) those that are alike. Only texts of documents in a pair are moved, where Spark finds their ids few enough to broadcast.

        What two sets have in common is at most what their first shingles have, and the rest of the set whose first shingles end
        later; so most pairs that aren't alike go without a look at their texts.
        """
        pairs = stored(pairs.distinct())
        firsts = lambda c: sketches.join(pairs.select(F.col(c).alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("toks").alias(f"toks_{c}"))
        rest = F.greatest(F.col("n_id") - F.size("toks_id"), F.col("n_to") - F.size("toks_to"))
        least = similarity / (1 + similarity) * (F.col("n_id") + F.col("n_to")) - 1e-6
        pairs = stored(pairs.join(firsts("id"), "id").join(firsts("to"), "to").where(F.size(F.array_intersect("toks_id", "toks_to")) + rest >= least).select("id", "to"))
        ones = texts.join(pairs.select("id").distinct(), "id", "left_semi")
        others = texts.join(pairs.select(F.col("to").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("to"), F.col("text").alias("other"))
        return cut(ones.join(pairs, "id").join(others, "to").where(alike("text", "other")).select("id", "to"))

    gone = alive.select("id", F.col("id").alias("to")).limit(0)
    for k in range(rounds + 1):
        lists = cut(alive.groupBy("tok").agg(F.min(F.struct("id", "n", "pos", "bits")).alias("least"), F.count("*").alias("c"), F.count_if(early).alias("e")).where("c > 1"))
        rows, pairs = lists.agg(F.sum("c"), F.sum(F.col("c").cast("double") * F.col("e"))).first()
        if not rows:
            break
        if k == rounds or pairs <= 4 * rows:
            smaller = alive.where(early).select("tok", F.col("id").alias("with"), F.col("n").alias("m"), F.col("pos").alias("pos_to"), F.col("bits").alias("bits_to"))
            met = alive.where("pos is not null").join(smaller, "tok").where("m < n or m = n and with < id").where(worth)
            gone = gone.unionByName(_settled(verified(met.select(F.greatest("id", "with").alias("id"), F.least("id", "with").alias("to")))))
            break
        led = alive.join(lists.select("tok", F.col("least.id").alias("to"), F.col("least.n").alias("m"), F.col("least.pos").alias("pos_to"), F.col("least.bits").alias("bits_to")), "tok").where("id <> to")
        led = stored(led.select("id", "to", worth.alias("worth")).distinct())
        led = stored(led.join(led.select(F.col("id").alias("to")).distinct(), "to", "left_anti"))  # those that are least in all their lists stay
        new = cut(verified(led.where("worth").select("id", "to")).groupBy("id").agg(F.min("to").alias("to")))
        gone = gone.unionByName(new)
        alive = stored(alive.join(stored(led.select(F.col("to").alias("id")).distinct().unionByName(new.select("id"))), "id", "left_anti"))
    gone = cut(gone)
    stays = gone.select(F.col("id").alias("to"), F.col("to").alias("end"))
    gone = stored(gone.unionByName(copies.join(stays, "to", "left").select("id", F.coalesce("end", "to").alias("to"))))
    gone = gone.select(F.col("id").alias("gone_id"), "to")
    return boxed.join(gone, F.col("id") == F.col("gone_id"), "left").select("doc", F.coalesce("to", "id").alias("keep_id"), F.col("gone_id").isNull().alias("kept"))


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """All columns of docs, with keep_id (the document that stands for this one) and kept.

    options: those of judged(). Two documents are alike if their sets of shingles of `width` words have a Jaccard similarity of
    `similarity` or more. No two that stay are alike, and each that goes is alike one that stays, its keep_id. Candidates are
    the groups of near_groups() (shingles of `print_width` words, `budget` bits) and, as those miss most pairs with more than
    few edits, all documents that share a shingle of their _sketches() at a place early enough for the similarity, which misses none; what takes
    a candidate out unseen are bounds that hold for every pair. Each list of candidates is first
    compared with its least document only, once that is known to stay, so a group of copies takes as many comparisons as it
    has members; texts of equal sets are one candidate; what remains after `rounds` of that, or earlier if it is little, is compared pair by pair,
    and of what is alike there those with the most links stay first.
    Null ids and ids whose rows differ in text take no part and stay. Null and empty texts are alike, and texts shorter than a shingle
    only as a whole. Texts are compared whole, however long. Empty input gives no rows. Columns of docs named keep_id or kept are replaced.
    """
    names = [f"doc.`{c}`" for c in docs.columns if c not in ("keep_id", "kept")]
    return judged(docs, **options).select(*names, "keep_id", "kept")
