"""Exact, line and near-duplicate removal, and repeats, against brute force."""

import hashlib
import math
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from memberlens.llm import components, grace_dedup, jaccard, line_dedup, repeats, scratch
from memberlens.llm.scratch import Scratch
from memberlens.llm import words as words_module
from memberlens.llm.words import Words, bucket_of, chunks, planes, unplanes
from tests.llm.cases import SCHEMA, WORD, ascii_lower, docs, documents, none, ordered  # noqa: F401


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


ROWS = [(r[0], r[1]) for r in documents()]


def largest(ids):
    return max((i for i in ids if i is not None), default=None)


def smallest(ids):
    return min((i for i in ids if i is not None), default=None)


def test_copy_groups(docs):
    groups = defaultdict(list)
    for i, text in ROWS:
        groups[text or ""].append(i)
    want = []
    for i, text in ROWS:
        ids = groups[text or ""]
        want.append((i, largest(ids), len(ids), i == largest(ids), sha(text or "")))
    assert ordered(grace_dedup.copy_groups(docs).collect()) == ordered(want)


def test_copies_spill_until_buckets_fit():
    records = [(k * 0x9E3779B97F4A7C15 % (1 << 64) - (1 << 63), f"text {k % 500}", k, 1) for k in range(500)] * 3
    plain = list(grace_dedup.distinct(records, 1 << 30))
    spilt = list(grace_dedup.distinct(records, 100))
    assert ordered(plain) == ordered(spilt) and len(plain) == 500
    assert {r[grace_dedup.COUNT] for r in spilt} == {3}


def test_a_table_of_short_texts_stays_within_its_bytes():
    """Records count with what they take in memory, not with their letters."""
    import tracemalloc

    def records():
        for k in range(40_000):
            yield (k * 0x9E3779B97F4A7C15 % (1 << 63), f"text of 20 letters{k:06}", k, 1, {"lang": f"l{k}", "source": f"s{k}", "n": k, "text_is_null": False})

    limit, most, files = 8 << 20, 0, 0
    tracemalloc.start()
    for _ in grace_dedup.distinct(records(), limit):
        files += 1
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert files == 40_000 and most < 1.5 * limit


def test_equal_hashes_of_unequal_texts_stay_apart():
    records = [(7, "a", 1, 1), (7, "b", 2, 1), (7, "a", 3, 1)]
    for limit in (0, 100):
        assert ordered(grace_dedup.distinct(records, limit)) == [(7, "a", 3, 2), (7, "b", 2, 1)]


def test_without_copies_keeps_all_columns(docs):
    kept = grace_dedup.without_copies(docs)
    assert kept.columns == docs.columns
    texts = [r["text"] or "" for r in kept.collect()]
    assert Counter(texts) == Counter({t or "": 1 for _, t in ROWS})


def kept_lines():
    places = defaultdict(set)
    for i, text in set(ROWS):
        for line in (text or "").split("\n"):
            key = ascii_lower(line.strip(" \t\n\x0b\x0c\r"))
            if len(key) >= 40:
                places[key].add((i, text))
    common = {k: largest(i for i, _ in v) for k, v in places.items() if len(v) >= 5}
    for i, text in ROWS:
        lines = (text or "").split("\n")
        stay = [x for x in lines if (k := ascii_lower(x.strip(" \t\n\x0b\x0c\r"))) not in common or common[k] == i]
        yield i, len(lines), len(lines) - len(stay), "\n".join(stay)


def test_common_lines(docs):
    found = line_dedup.without_common_lines(docs).collect()
    assert ordered(found) == ordered(kept_lines())
    assert sum(r["n_dropped"] for r in found) > 20


def test_a_document_with_many_lines(frame):
    line = "{} is a line that has at least forty letters in it"
    many = "\n".join(line.format(k) for k in range(300))
    rows = [(k, many) for k in range(4)] + [(9, many + "\nend")]
    found = line_dedup.without_common_lines(frame("doc_id bigint, text string", *rows)).collect()
    assert ordered(found) == [(k, 300, 300, "") for k in range(4)] + [(9, 301, 0, many + "\nend")]


def brute_sets():
    for _, text in ROWS:
        words = WORD.findall(ascii_lower(text or ""))
        yield {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute_components() -> list[tuple]:
    sets = list(brute_sets())
    above = list(range(len(sets)))

    def top(k):
        while above[k] != k:
            k = above[k]
        return k

    for x, y in combinations(range(len(sets)), 2):
        both = len(sets[x] & sets[y])
        if both and 100 * both >= 75 * len(sets[x] | sets[y]):
            above[max(top(x), top(y))] = min(top(x), top(y))
    members = defaultdict(list)
    for k in range(len(sets)):
        members[top(k)].append(ROWS[k][0])
    return [(ROWS[k][0], len(sets[k]), smallest(members[top(k)])) for k in range(len(sets))]


@pytest.mark.parametrize("small_blocks", [False, True])
def test_near_duplicates(docs, monkeypatch, small_blocks):
    if small_blocks:  # no first round to speak of, and many pairs of blocks
        monkeypatch.setattr(jaccard, "BLOCK_SETS", 4)
        monkeypatch.setattr(jaccard, "COLUMNS", 16)
        monkeypatch.setattr(jaccard, "MINIMA", 1)
    found = jaccard.grouped(docs).select("doc_id", "n_shingles", "component_id")
    assert ordered(found.collect()) == ordered(brute_components())


def test_one_of_each(docs):
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    gone = Counter(ROWS) - Counter((r["doc_id"], r["text"]) for r in kept.collect())
    components_ = {(i, t): c for (i, t), (_, _, c) in zip(ROWS, brute_components(), strict=True)}
    assert gone and all(components_[row] != row[0] or row[0] is None for row in gone)
    assert {(i, t) for (i, t), c in components_.items() if c == i and i is not None} <= {
        (r["doc_id"], r["text"]) for r in kept.collect()
    }


def test_products_agree_with_set_sizes():
    rng = np.random.default_rng(3)
    base = rng.choice(10**6, 60, replace=False).astype(np.uint64)
    sets = []
    for _ in range(40):
        extra = rng.integers(10**6, 10**9, rng.integers(0, 25)).astype(np.uint64)
        sets.append(np.unique(np.concatenate([rng.choice(base, rng.integers(40, 60), replace=False), extra])))
    like, n = jaccard.Likeness(), np.array([len(s) for s in sets])
    links = jaccard.product_links(sets, n, list(range(40)), like)
    brute = [
        (x, y)
        for x, y in combinations(range(40), 2)
        if 100 * len(np.intersect1d(sets[x], sets[y])) >= 75 * len(np.union1d(sets[x], sets[y]))
    ]

    def parts(edges):
        above = list(range(40))
        for _ in range(40):
            for x, y in edges:
                above[x] = above[y] = min(above[x], above[y])
        return above

    assert brute and set(links) <= set(brute) and parts(links) == parts(brute)


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(k + 1, k) for k in range(1, 60)] + [(100 + k, 100) for k in range(40)] + [(60, 139), (7, 7)]
    scratch = Scratch(spark)
    found = components.components(spark.createDataFrame(edges, "x bigint, y bigint"), scratch).collect()
    assert {r["node"]: r["root"] for r in found} == {
        k: 1 for k in [*range(2, 61), *range(100, 140)]
    }
    loop = spark.createDataFrame([(3, 3)], "x bigint, y bigint")
    assert components.components(loop, scratch).collect() == []
    scratch.remove()


def brute_repeats():
    words = [WORD.findall(t or "") for _, t in ROWS]
    seen = Counter(tuple(w[k : k + 35]) for w in words for k in range(len(w) - 34))
    for (i, _), w in zip(ROWS, words, strict=True):
        gone = {k + j for k in range(len(w) - 34) if seen[tuple(w[k : k + 35])] > 1 for j in range(35)}
        yield i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)


@pytest.mark.parametrize("together", [3 << 20, 50])
def test_repeats(docs, monkeypatch, together):
    monkeypatch.setattr(repeats, "SENT_TOGETHER", together)
    assert ordered(repeats.without_repeats(docs).collect()) == ordered(brute_repeats())


def test_empty_tables(none):
    assert grace_dedup.copy_groups(none).collect() == []
    assert line_dedup.without_common_lines(none).collect() == []
    assert jaccard.grouped(none).collect() == []
    assert jaccard.one_of_each(none).collect() == []
    assert repeats.without_repeats(none).collect() == []


def test_words_of_many_texts():
    import pyarrow as pa

    texts = ["", "a bc", " \t", "bc  a", "BC é\x0bbc", "a bc" * 9]
    found = Words(pa.array(["skipped", *texts]).slice(1), lower=True)
    spelt = [found.data[a:b].tobytes().decode() for a, b in zip(found.start, found.end, strict=True)]
    assert spelt == [w for t in texts for w in WORD.findall(ascii_lower(t))]
    assert len(set(found.hash.tolist())) == len(set(spelt))
    assert [base for base, _ in chunks(pa.array(texts), 5)] == [0, 2, 3, 4, 5]
    values = np.array([1, 70000, 5], np.uint32)
    assert (unplanes(planes(values), np.uint32) == values).all()
    assert bucket_of(np.array([0, (1 << 64) - 1], np.uint64), 7).tolist() == [0, 6]


def test_schema_has_clashing_names():
    assert "hash" in SCHEMA and "`a.b`" in SCHEMA


def test_parts_follow_the_bytes_of_text(docs, spark, monkeypatch):
    def near(rows):
        found = jaccard.grouped(rows).select("doc_id", "n_shingles", "component_id")
        return ordered(found.collect())

    rows = docs.unionByName(docs.filter("doc_id = 15").withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(40)))).drop("again"))
    want = near(rows), ordered(repeats.without_repeats(rows).collect())
    limit = 8000
    monkeypatch.setattr(scratch, "PART_BYTES", limit)
    key = F.xxhash64("doc_id", "body").alias("key")
    n, dealt = scratch.in_parts(rows.select(F.coalesce("text", F.lit("")).alias("body"), "doc_id").select(key, "doc_id", "body"), "part")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0]
    assert n == max(scratch.width(spark), math.ceil(total / limit)) > scratch.width(spark)
    assert ordered(dealt.select("doc_id").collect()) == ordered(rows.select("doc_id").collect())
    # Forty copies of one row are more than a part; they are spread.
    copies = dealt.filter("doc_id = 15").groupBy("part").agg(F.sum(F.octet_length("body")).alias("bytes")).collect()
    assert sum(r["bytes"] for r in copies) > 2 * limit and max(r["bytes"] for r in copies) <= limit
    assert (near(rows), ordered(repeats.without_repeats(rows).collect())) == want


def thue_morse(letters: str, size: int) -> str:
    return "".join(letters[k.bit_count() % 2] for k in range(size))


def colliding() -> list[str]:
    """Different words, or runs of words, that sums of powers modulo 2**64 cannot tell apart."""
    found = []
    for size in (1024, 2048, 4096):
        found += [thue_morse("ab", size), thue_morse("ba", size)]
    common = [f"w{k}" for k in range(60)]
    pairs = [" ".join([*common[:34], w]) for w in found]
    shingled = [" ".join([*common[:20], w, *common[20:24]]) for w in found]
    words = [" ".join(thue_morse(x, 32).replace("a", "alpha ").replace("b", "beta ").split() + ["one", "two", "three"]) for x in ("ab", "ba")]
    return [*found, *pairs, *shingled, *words, words[0]]


def test_words_that_sums_of_powers_confuse(spark):
    """As words, in shingles and in windows, against brute force."""
    texts = colliding()
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    sets = []
    for text in texts:
        words = WORD.findall(ascii_lower(text))
        sets.append({tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))})
    group = list(range(len(texts)))
    for _ in texts:
        for x, y in combinations(range(len(texts)), 2):
            if 100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y]):
                group[x] = group[y] = min(group[x], group[y])
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.grouped(rows).collect()}
    assert found == {k: (len(s), group[k]) for k, s in enumerate(sets)}
    words = [WORD.findall(t) for t in texts]
    seen = Counter(tuple(w[k : k + 35]) for w in words for k in range(len(w) - 34))
    want = {}
    for i, w in enumerate(words):
        gone = {k + j for k in range(len(w) - 34) if seen[tuple(w[k : k + 35])] > 1 for j in range(35)}
        want[i] = len(gone)
    assert {r["doc_id"]: r["n_removed"] for r in repeats.without_repeats(rows).collect()} == want
    assert set(want.values()) == {0, 35}


def test_hashes_of_runs_tell_sequences_apart():
    import pyarrow as pa

    ab = [np.array([1, 2], np.uint64)[[int(c == "b") for c in thue_morse(x, 4096)]] for x in ("ab", "ba")]
    for n in (1, 2, 3, 5, 18, 32, 35, 1024, 4096):
        seen = {}
        for values in ab:
            hashes = [words_module.runs(values, n, left) for left in (words_module.LEFT, words_module.LEFT_TOO)]
            for k, h in enumerate(zip(*(x.tolist() for x in hashes), strict=True)):
                assert seen.setdefault(h, values[k : k + n].tobytes()) == values[k : k + n].tobytes()
        assert len(set(seen.values())) == len(seen)
    both = Words(pa.array([thue_morse("ab", 1024) + " " + thue_morse("ba", 1024)]))
    assert len(set(both.hash.tolist())) == len(set(both.hash_too.tolist())) == 2


def passages(n: int) -> list[tuple]:
    """Documents of three passages each from a pool that grows with them: joined, but not alike."""
    rng = np.random.default_rng(7)
    pool = [" ".join(f"p{k}w{j}" for j in range(40)) for k in range(n // 2)]
    return [(k, " ".join(pool[p] for p in rng.choice(len(pool), 3, replace=False))) for k in range(n)]


def test_sets_that_share_passages_meet_few_others(spark, monkeypatch):
    """Twice the documents are twice the work, though nearly all are one cluster."""
    sizes, counted = [], {}
    tasks = jaccard._tasks

    def counting(members, scratch):
        rows = scratch.saved(tasks(members, scratch))
        counted.update(sets=rows.count(), pairs=rows.select("cluster", "one", "two").distinct().count())
        return rows

    monkeypatch.setattr(jaccard, "_tasks", counting)
    for n in (800, 1600):
        rows = spark.createDataFrame(passages(n), "doc_id bigint, text string")
        found = jaccard.grouped(rows).agg(F.count_distinct("component_id")).first()[0]
        assert found > 0.95 * n
        sizes.append(dict(counted))
    assert sizes[0]["sets"] > 0
    assert all(sizes[1][k] <= 2.3 * sizes[0][k] for k in ("sets", "pairs")), sizes


@pytest.mark.parametrize(("share", "sets"), [(0.0, 4), (1e9, 4), (1e9, 128)])
def test_groups_by_pivot_or_cluster_give_the_same(docs, monkeypatch, share, sets):
    """Whichever way the costs decide, links are the same."""
    monkeypatch.setattr(jaccard, "APART", share)
    monkeypatch.setattr(jaccard, "BLOCK_SETS", sets)
    monkeypatch.setattr(jaccard, "MINIMA", 1)
    found = jaccard.grouped(docs).select("doc_id", "n_shingles", "component_id")
    assert ordered(found.collect()) == ordered(brute_components())
