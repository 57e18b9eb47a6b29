"""Near duplicates: a blocked sparse product of documents by n-gram incidence.

1. Counting. Documents are dealt into blocks; a block sends each of its shingles once, with
   the number of its documents that have it, and gets back those that another document
   shares. A document of which less than the threshold is shared is linked with nothing.
2. Equal sets are one class from here on.
3. Classes that agree in a minimum hash are compared with the least of them; components
   of those links swallow groups of near copies without comparing all their pairs.
4. A pair of similar sets shares a shingle among the first of either set, in one order of
   all shingles, rare ones first (prefix filter, by size). Where the sets under a shingle
   are of several components, they are multiplied, incidence matrix by incidence matrix, column
   block by column block: all sets that such shingles join (a cluster) where they are few, else the sets
   under the shingles of one least set (a pivot). Groups are cut into blocks of sets, and each
   pair of blocks is a task. A pair whose overlap can no longer reach what the sizes ask for
   is dropped. Blocks inside one component are not multiplied.

Only classes of one group meet, and a task returns at most one link per set.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memberlens.llm.components import components
from memberlens.llm.scratch import Scratch, columns, in_parts, saved
from memberlens.llm.words import LEFT_TOO, Words, bucket_of, chunks, mix, plain, planes, runs, unplanes

#: Shingles of one batch of documents that are merged before they are sent.
SENT_TOGETHER = 1 << 20
#: Sets of one component or several that make a block.
BLOCK_SETS = 128
#: A cluster is taken apart if that reads less than this share of the sets.
APART = 1.0
#: Columns of the incidence matrix that are multiplied at a time.
COLUMNS = 4096
#: Minimum hashes in the first round.
MINIMA = 4


@dataclass(frozen=True)
class Likeness:
    """Sets of ``words``-word shingles; linked if 100 * overlap >= percent * union."""

    words: int = 5
    percent: int = 75

    def least_overlap(self, n: np.ndarray | int):
        """What two sets must share of a set of ``n``, whatever the other's size."""
        return -(-n * self.percent // 100)

    def linked(self, overlap, a, b):
        return 100 * overlap >= self.percent * (a + b - overlap)


def shingle_sets(texts: pa.Array, words: int, both: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray | None]]:
    """Each text's number and its set: sorted hashes, and with ``both`` the shingles' second
    hashes in that order. Fewer words than a shingle are one."""
    for base, part in chunks(texts):
        found = Words(part, lower=True)
        at, hashes = found.ngrams(words)
        too = found.ngrams(words, other=True)[1] if both else None
        lows = np.searchsorted(at, found.first[:-1])
        highs = np.searchsorted(at, found.first[1:])
        for k in range(len(part)):
            own, other = hashes[lows[k] : highs[k]], None
            if both:
                other = too[lows[k] : highs[k]]
            if not len(own) and found.first[k] < found.first[k + 1]:
                a, b = found.first[k], found.first[k + 1]
                length = np.uint64(b - a)
                own = mix(runs(found.hash[a:b], int(length)) + length)
                if both:
                    other = mix(runs(found.hash_too[a:b], int(length), LEFT_TOO) + length)
            if both:
                own, first = np.unique(own, return_index=True)
                yield base + k, own, other[first]
            else:
                yield base + k, np.unique(own), None


def _dealt(docs: DataFrame, text: str, id: str) -> tuple[int, DataFrame]:
    body = F.coalesce(text, F.lit(""))
    own = F.col(id).cast("bigint").alias("id")
    key = F.xxhash64(F.col(id), body).alias("key")
    print_ = F.xxhash64(body).alias("print")
    return in_parts(docs.select(key, own, body.alias("body"), print_), "block")


def _shared_shingles(dealt: DataFrame, like: Likeness, n: int) -> DataFrame:
    """block, bucket and body: the shingles of the block that occur in two documents at least,
    each with the number of binary digits of how many."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def flush(block: int) -> pa.RecordBatch:
            hashes, counts = np.unique(np.concatenate(held.pop(block)), return_counts=True)
            buckets = bucket_of(hashes, n)
            cuts = np.flatnonzero(np.diff(buckets)) + 1
            lows = np.minimum(counts, 255).astype(np.uint8)
            bodies = [
                planes(h.astype(np.uint32)) + c.tobytes()
                for h, c in zip(np.split(hashes, cuts), np.split(lows, cuts), strict=True)
            ]
            names = buckets[np.concatenate([[0], cuts])].astype(np.int32)
            own = np.full(len(names), block, np.int32)
            return pa.RecordBatch.from_arrays(
                [pa.array(names), pa.array(own), pa.array(bodies, pa.binary())], names=["bucket", "block", "body"]
            )

        sizes: dict[int, int] = {}
        for batch in batches:
            blocks = batch.column(0).to_numpy()
            for part in plain(batch.column(2)):
                for k, found, _ in shingle_sets(part, like.words):
                    if len(found):
                        block = int(blocks[k])
                        held.setdefault(block, []).append(found)
                        sizes[block] = sizes.get(block, 0) + len(found)
                        if sizes[block] > SENT_TOGETHER:
                            sizes[block] = 0
                            yield flush(block)
        for block in list(held):
            yield flush(block)

    def count(table: pa.Table) -> pa.Table:
        bodies = table["body"].to_pylist()
        hashes, counts, ends = [], [], [0]
        for body in bodies:
            n_here = len(body) // 5
            hashes.append(unplanes(body[: 4 * n_here], np.uint32))
            counts.append(np.frombuffer(body, np.uint8, offset=4 * n_here))
            ends.append(ends[-1] + n_here)
        hashes, counts = np.concatenate(hashes), np.concatenate(counts).astype(np.int64)
        both = np.sort((hashes.astype(np.uint64) << np.uint64(32)) | np.arange(len(hashes), dtype=np.uint64))
        order = (both & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.diff(both >> np.uint64(32), prepend=np.uint64(1 << 40)))
        total = np.add.reduceat(counts[order], first)
        digits = np.where(total >= 2, np.floor(np.log2(total)), 0).astype(np.uint8)
        of_entry = np.empty(len(hashes), np.uint8)
        of_entry[order] = np.repeat(digits, np.diff(np.append(first, len(both))))
        answers = []
        for lo, hi in zip(ends, ends[1:], strict=False):
            shared = of_entry[lo:hi] > 0
            answers.append(planes(hashes[lo:hi][shared]) + of_entry[lo:hi][shared].tobytes())
        return pa.table(
            {"block": table["block"], "bucket": table["bucket"], "body": pa.array(answers, pa.binary())}
        )

    sent = dealt.mapInArrow(send, "bucket int, block int, body binary")
    return sent.groupBy("bucket").applyInArrow(count, "block int, bucket int, body binary")


def sets(docs: DataFrame, like: Likeness, *, text: str, id: str) -> DataFrame:
    """id, print (of the text), n, and for sets that can be linked: class, shared, minima, prefix.

    ``class`` names the set, ``shared`` are its shingles that other documents have too (six
    bytes each), ``prefix`` those among which a similar set has one.
    """
    n, dealt = _dealt(docs, text, id)
    answers = _shared_shingles(dealt, like, n)

    def match(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, digits = [], []
        for bucket, body in zip(right["bucket"].to_pylist(), right["body"].to_pylist(), strict=True):
            n_here = len(body) // 5
            low = unplanes(body[: 4 * n_here], np.uint32).astype(np.uint64)
            keys.append((np.uint64(bucket) << np.uint64(32)) | low)
            digits.append(np.frombuffer(body, np.uint8, offset=4 * n_here))
        keys, at = np.unique(np.concatenate([*keys, np.zeros(0, np.uint64)]), return_index=True)
        digits = np.concatenate([*digits, np.zeros(0, np.uint8)])[at]
        out = {"n": [], "class": [], "shared": [], "minima": [], "prefix": []}
        for part in plain(left["body"]):
            for _, found, too in shingle_sets(part, like.words, both=True):
                out["n"].append(len(found))
                row = _linkable(found, too, keys, digits, n, like) if len(found) else None
                for name, value in zip(list(out)[1:], row or (None,) * 4, strict=True):
                    out[name].append(value)
        kinds = {"n": pa.int64(), "class": pa.binary(), "shared": pa.binary()}
        lists = pa.list_(pa.int64())
        given = {c: left[c] if left.num_rows else pa.array([], pa.int64()) for c in ("id", "print")}
        return pa.table(given | {c: pa.array(v, kinds.get(c, lists)) for c, v in out.items()})

    schema = "id bigint, print bigint, n bigint, class binary, shared binary, minima array<bigint>, prefix array<bigint>"
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(match, schema)


def _linkable(
    found: np.ndarray, too: np.ndarray, keys: np.ndarray, digits: np.ndarray, n: int, like: Likeness
) -> tuple | None:
    wanted = (bucket_of(found, n) << np.uint64(32)) | (found & np.uint64(0xFFFFFFFF))
    at = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
    known = keys[at] == wanted if len(keys) else np.zeros(len(found), bool)
    shared, size = found[known], len(found)
    if len(shared) < like.least_overlap(size):
        return None
    order = np.lexsort((wanted[known], digits[at[known]]))
    alone = size - len(shared)
    prefix = shared[order][: size - like.least_overlap(size) + 1 - alone]
    minima = [int(mix(shared ^ np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)).min()) for k in range(1, MINIMA + 1)]
    name = hashlib.blake2b(found.tobytes() + too.tobytes(), digest_size=16).digest()
    six = np.sort(shared >> np.uint64(16)).astype(np.uint64)
    body = six.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
    return name, body, np.array(minima, np.uint64).view(np.int64), prefix.view(np.int64)


def _unpack(body: bytes) -> np.ndarray:
    eight = np.zeros((len(body) // 6, 8), np.uint8)
    eight[:, :6] = np.frombuffer(body, np.uint8).reshape(-1, 6)
    return eight.view(np.uint64).ravel()


def _compared(pairs: DataFrame, classes: DataFrame, like: Likeness) -> DataFrame:
    """Those of the pairs (a, b) of classes that are linked."""
    sides = []
    for side in "ab":
        sides.append(classes.select(F.col("class").alias(side), F.col("n").alias(f"n_{side}"), F.col("shared").alias(f"s_{side}")))
    small, large = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    both = pairs.join(sides[0], "a").join(sides[1], "b").filter(100 * small >= like.percent * large)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n_a, s_a, n_b, s_b = (batch.column(c).to_pylist() for c in ("a", "b", "n_a", "s_a", "n_b", "s_b"))
            keep, last, of_last = [], None, None
            for k in range(len(a)):
                if s_b[k] is not last:
                    last, of_last = s_b[k], _unpack(s_b[k])
                overlap = len(np.intersect1d(_unpack(s_a[k]), of_last, assume_unique=True))
                keep.append(bool(like.linked(overlap, n_a[k], n_b[k])))
            kept = batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
            yield kept

    return both.select("a", "b", "n_a", "s_a", "n_b", "s_b").mapInArrow(compare, "a binary, b binary")


def _least_alike(classes: DataFrame, scratch: Scratch) -> DataFrame:
    """Each class with the least of those that share a minimum hash with it.

    The least are a table of their own: a join with a sum over the same shuffle could not be
    split where a minimum is very common.
    """
    each = classes.select("class", F.posexplode("minima").alias("pos", "minimum"))
    heads = each.groupBy("pos", "minimum").agg(F.min("class").alias("head"), F.count(F.lit(1)).alias("k"))
    heads = scratch.saved(heads.filter("k > 1"))
    pairs = each.join(heads, ["pos", "minimum"]).filter(F.col("class") != F.col("head"))
    return pairs.select(F.col("class").alias("a"), F.col("head").alias("b")).distinct()


def _with_root(rows: DataFrame, roots: DataFrame, column: str, name: str) -> DataFrame:
    up = roots.select(F.col("node").alias(column), F.col("root").alias("_up"))
    return rows.join(up, column, "left").withColumn(name, F.coalesce("_up", column)).drop("_up")


def _bodies(k: Column) -> Column:
    """How many sets the block pairs of a group of ``k`` read, about."""
    return k * F.ceil(k / BLOCK_SETS)


def _groups(live: DataFrame, scratch: Scratch) -> DataFrame:
    """cluster, class and part: groups in which all pairs of similar sets of different parts meet.

    ``live`` has class, part, and gram: a shingle under which sets of several parts have one of their
    first, with the least of those parts, the head. A cluster is what such shingles join. The least
    set under a shingle is its pivot, and all sets under the shingles of one pivot are a group too, which
    may be far smaller; a cluster is taken apart into these where that reads fewer sets. So sets that
    rare passages join to a large cluster meet the sets of their passages only. Small groups share bins.
    """
    clusters = components(live.select("part", "head").distinct(), scratch)
    found = scratch.saved(_with_root(live.select("class", "part", "gram"), clusters, "part", "cluster"))
    members = scratch.saved(found.select("cluster", "class", "part").distinct())
    pivots = scratch.saved(found.groupBy("gram").agg(F.min("class").alias("pivot")))
    under = scratch.saved(found.join(pivots, "gram").select("cluster", "pivot", "class", "part").distinct())
    sizes = scratch.saved(under.groupBy("cluster", "pivot").agg(F.count(F.lit(1)).alias("k")))
    apart = sizes.groupBy("cluster").agg(F.sum(_bodies(F.col("k"))).alias("apart"))
    together = members.groupBy("cluster").agg(_bodies(F.count(F.lit(1))).alias("together"))
    split = scratch.saved(apart.join(together, "cluster").filter(F.col("apart") < F.col("together") * APART).select("cluster"))
    sizes = scratch.saved(sizes.join(split, "cluster").select("pivot", "k"))
    small = sizes.filter(F.col("k") <= BLOCK_SETS).agg(F.sum("k")).first()[0] or 0
    bins = F.pmod(F.xxhash64("pivot"), F.lit(max(1, small // BLOCK_SETS)))
    name = F.when(F.col("k") > BLOCK_SETS, F.concat(F.lit("pivot "), F.hex("pivot")))
    name = F.coalesce(name, F.concat(F.lit("bin "), bins.cast("string")))
    whole = members.join(split, "cluster", "left_anti").select(
        F.concat(F.lit("cluster "), F.hex("cluster")).alias("cluster"), "class", "part"
    )
    parted = under.drop("cluster").join(sizes, "pivot").select(name.alias("cluster"), "class", "part")
    return scratch.saved(whole.unionByName(parted.distinct()))


def _placed(members: DataFrame, scratch: Scratch) -> DataFrame:
    """class, part, cluster and the block of each member.

    A part (component) that fills a block has blocks of its own, the others share blocks. The
    sizes are tables of their own, so that joins on a very large cluster or part can be split.
    """
    sizes = members.groupBy("cluster", "part").agg(F.count(F.lit(1)).alias("k"))
    sizes = scratch.saved(sizes.withColumn("large", F.col("k") >= BLOCK_SETS // 2))
    rest = F.sum(F.when(~F.col("large"), F.col("k")).otherwise(0)).alias("rest")
    small = scratch.saved(sizes.groupBy("cluster").agg(rest))

    def cut(what: Column, k: Column, size: int) -> Column:
        return F.pmod(F.xxhash64(what), F.greatest(F.ceil(k / size), F.lit(1))).cast("string")

    own = F.concat(F.hex("part"), F.lit(":"), cut(F.col("class"), F.col("k"), BLOCK_SETS))
    mixed = F.concat(F.lit(":"), cut(F.col("part"), F.col("rest"), BLOCK_SETS // 2))
    return (
        members.join(sizes, ["cluster", "part"])
        .join(small, "cluster")
        .select("class", "part", "cluster", F.when(F.col("large"), own).otherwise(mixed).alias("at"))
    )


def _tasks(members: DataFrame, scratch: Scratch) -> DataFrame:
    """cluster, one, two, class and part: the sets of each pair of blocks that may hold links."""
    placed = scratch.saved(_placed(members, scratch))
    blocks = scratch.saved(placed.select("cluster", "at").distinct())
    part = F.substring_index("one", ":", 1)
    inside = (part == F.substring_index("two", ":", 1)) & (part != "")
    pairs = (
        blocks.withColumnRenamed("at", "one")
        .join(blocks.withColumnRenamed("at", "two"), "cluster")
        .filter((F.col("one") <= F.col("two")) & ~inside)
    )
    ends = pairs.select("*", F.explode(F.array_distinct(F.array("one", "two"))).alias("at"))
    return placed.join(ends, ["cluster", "at"]).select("cluster", "one", "two", "class", "part")


def _multiplied(
    members: DataFrame, classes: DataFrame, like: Likeness, scratch: Scratch
) -> DataFrame:
    """Links (a, b) between parts, from class, part and cluster of the sets in question."""
    tasks = _tasks(members, scratch).join(classes.select("class", "n", "shared"), "class")

    def multiply(table: pa.Table) -> pa.Table:
        parts = table["part"].to_pylist()
        links = product_links([_unpack(s) for s in table["shared"].to_pylist()], table["n"].to_numpy(), parts, like)
        a, b = ([parts[x[k]] for x in links] for k in (0, 1))
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return tasks.groupBy("cluster", "one", "two").applyInArrow(multiply, "a binary, b binary")


def product_links(shared: list[np.ndarray], n: np.ndarray, parts: list, like: Likeness) -> list[tuple[int, int]]:
    """Pairs of rows that are linked, as many as it takes to join the parts they join."""
    names = {p: k for k, p in enumerate(dict.fromkeys(parts))}
    part = np.array([names[p] for p in parts])
    rows = np.repeat(np.arange(len(shared)), [len(s) for s in shared])
    _, columns = np.unique(np.concatenate(shared), return_inverse=True)
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    # linked: 100 * overlap >= percent * (a + b - overlap)
    need = -(-like.percent * (n[:, None] + n[None]) // (100 + like.percent))
    alive = (part[:, None] < part[None]) & (need <= np.minimum(n[:, None], n[None]))
    overlap = np.zeros(alive.shape, np.int64)
    left = np.array([len(s) for s in shared])
    for lo in range(0, int(columns[-1]) + 1, COLUMNS):
        a, b = np.searchsorted(columns, [lo, lo + COLUMNS])
        own = np.flatnonzero(alive.any(0) | alive.any(1))
        if not len(own):
            break
        place = np.full(len(shared), -1)
        place[own] = np.arange(len(own))
        block = np.zeros((len(own), COLUMNS), np.float32)
        here = place[rows[a:b]] >= 0
        block[place[rows[a:b]][here], columns[a:b][here] - lo] = 1
        overlap[np.ix_(own, own)] += (block @ block.T).astype(np.int64)
        left -= np.bincount(rows[a:b], minlength=len(shared))
        alive &= overlap + np.minimum(left[:, None], left[None]) >= need
    above, links = list(range(len(names))), []

    def top(k: int) -> int:
        while above[k] != k:
            above[k] = above[above[k]]
            k = above[k]
        return k

    for x, y in zip(*np.nonzero(alive & (overlap >= need)), strict=True):
        p, q = top(part[x]), top(part[y])
        if p != q:
            above[max(p, q)] = min(p, q)
            links.append((int(x), int(y)))
    return links


def _class_groups(found: DataFrame, like: Likeness, scratch: Scratch) -> DataFrame:
    """class, group and component (the smallest id) of all sets that can be linked."""
    classes = scratch.saved(
        found.filter("class is not null")
        .groupBy("class")
        .agg(
            F.min("id").alias("least"),
            F.first("n").alias("n"),
            F.first("shared").alias("shared"),
            F.first("minima").alias("minima"),
            F.first("prefix").alias("prefix"),
        )
    )
    first = components(_compared(_least_alike(classes, scratch), classes, like), scratch)
    entries = _with_root(classes.select("class", F.explode("prefix").alias("gram")), first, "class", "part")
    entries = scratch.saved(entries)
    several = scratch.saved(
        entries.groupBy("gram")
        .agg(F.min("part").alias("head"), F.max("part").alias("last"))
        .filter("head != last")
        .select("gram", "head")
    )
    live = scratch.saved(entries.join(several, "gram").select("class", "part", "gram", "head"))
    members = _groups(live, scratch)
    second = components(_multiplied(members, classes, like, scratch), scratch)
    whole = _with_root(classes.select("class", "least"), first, "class", "part")
    whole = scratch.saved(_with_root(whole, second, "part", "group").select("class", "least", "group"))
    named = scratch.saved(whole.groupBy("group").agg(F.min("least").alias("component")))
    return scratch.saved(whole.select("class", "group").join(named, "group"))


def grouped(
    docs: DataFrame, like: Likeness = Likeness(), *, text: str = "text", id: str = "doc_id"
) -> DataFrame:
    """One row per document: id, n_shingles, component_id, group and print (of the text).

    ``component_id`` is the smallest id that links reach, ``group`` names the component
    where ids are null or repeat; it is null for documents whose set is like no other
    document's. A null or empty text, or one of white space, has no shingles and no links.
    """
    scratch, kept = Scratch(docs.sparkSession), Scratch(docs.sparkSession)
    try:
        found = scratch.saved(sets(docs, like, text=text, id=id))
        of_class = _class_groups(found, like, scratch)
        rows = found.select("id", "print", "n", "class").join(of_class, "class", "left")
        return kept.saved(
            rows.select(
                F.col("id").alias(id),
                F.col("n").alias("n_shingles"),
                F.when(F.col("class").isNull(), F.col("id"))
                .otherwise(F.col("component"))
                .alias("component_id"),
                "group",
                "print",
            )
        )
    finally:
        scratch.remove()


def one_of_each(
    docs: DataFrame, like: Likeness = Likeness(), *, text: str = "text", id: str = "doc_id"
) -> DataFrame:
    """The documents with one of each component, the smallest id, all columns as they were.

    Among null or repeated ids the text's fingerprint decides. Rows that repeat id and text
    are one document and stay together.
    """
    rows = grouped(docs, like, text=text, id=id).filter("group is not null")
    rank = F.struct(F.col(id).isNull(), F.col(id), F.col("print"))
    rows = saved(rows.select("group", F.col(id).alias("own"), "print", rank.alias("rank")))
    # A table of its own, so that a join on a very large group can be split.
    first = saved(rows.groupBy("group").agg(F.min("rank").alias("first")))
    gone = rows.join(first, "group").filter("rank != first").select("own", "print").distinct()
    body = F.coalesce(text, F.lit(""))
    whole = docs.select(
        F.struct(*columns(docs)).alias("doc"),
        F.col(id).cast("bigint").alias("key"),
        F.xxhash64(body).alias("key_print"),
    )
    same = F.col("key").eqNullSafe(F.col("own")) & (F.col("key_print") == F.col("print"))
    return whole.join(gone, same, "left_anti").select("doc.*")
