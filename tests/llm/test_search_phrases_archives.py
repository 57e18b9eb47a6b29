"""Lexical search, collocations and archives against brute force."""

import base64
import gzip
import hashlib
import math
import random
import re
import sys
from collections import Counter
from types import SimpleNamespace
from unittest.mock import MagicMock

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from memberlens.llm import collocations, lexical, warc
from tests.llm.cases import EXTRA, SCHEMA, ascii_lower, docs, documents, none, ordered  # noqa: F401

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall(ascii_lower(text or ""))


def best_by_hand(rows, items, k=10):
    counted = [(i, Counter(terms(t))) for i, t in rows]
    n_docs = sum(bool(c) for _, c in counted)
    whole = sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scored = []
        for doc, c in counted:
            m = 25 + (75 * sum(c.values()) * n_docs) // max(1, whole)
            score = 0
            for t in terms(text):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        scored.sort(key=lambda x: x[:3])
        out += [(item, r, s[3], -s[0]) for r, s in enumerate(scored[:k], 1)]
    return ordered(out)


def items_of(rows):
    rng = random.Random(3)
    texts = [t for _, t in rows if t]
    items = [(k, " ".join(rng.choice(texts).split()[:40])) for k in range(25)]
    items += [(100, None), (101, ""), (102, "!? ..."), (103, "nowhere found"), (104, items[0][1]), (None, "again AGAIN two")]
    return [*items, items[3]]


@pytest.fixture(scope="module")
def searched(spark, docs):
    rows = [(r[0], r[1]) for r in documents()]
    items = items_of(rows)
    table = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id bigint, text string, rank int, score int")
    return rows, items, table


def test_search_equals_brute_force(docs, searched):
    rows, items, table = searched
    assert ordered(lexical.ranked(docs, table).collect()) == best_by_hand(rows, items)


def test_search_in_many_blocks_and_buckets(docs, searched, monkeypatch):
    rows, items, table = searched
    monkeypatch.setattr(lexical, "BLOCK_BYTES", 20_000)
    assert ordered(lexical.ranked(docs, table, 3).collect()) == best_by_hand(rows, items, 3)


def test_search_bounds_lose_nothing(searched, monkeypatch):
    """In one task with small buckets and groups, from the shortest to the longest and back."""
    rows, items, _ = searched
    monkeypatch.setattr(lexical, "BUCKET_DOCS", 4)
    vectors = [Counter(terms(t)) for _, t in rows]
    names = sorted({t for c in vectors for t in c})
    rng = random.Random(8)
    some = [c for c in vectors if c]
    ends = [0]
    flat, values = [], []
    for c in some:
        for t in sorted(c):
            flat.append(names.index(t))
            values.append(rng.randint(1, 900_000))
        ends.append(len(flat))
    np, pa = lexical.np, lexical.pa
    lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (flat, values)]
    lengths = [math.sqrt(sum(v * v for v in values[a:b])) * lexical.SLACK for a, b in zip(ends, ends[1:], strict=False)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(some)), pa.int64()), *lists, pa.array(lengths)], names=["id", "terms", "impacts", "length"])
    skipped = 0
    for _, text in items[:25]:
        own = sorted({names.index(t) for t in terms(text) if t in names})
        weights = np.array([rng.randint(0, 9000) for _ in own], np.int64)
        dense = np.zeros(len(names), np.int64)
        dense[own] = weights
        for goal in (1, 10**9, 10**10, 10**11):
            for bucket in lexical._buckets([batch]):
                found = bucket.candidates(np.array(own), weights, goal)
                scores = bucket.scores(np.arange(len(bucket.ids)), dense)
                assert set(np.flatnonzero(scores >= goal)) <= set(found)
                skipped += len(bucket.ids) - len(found)
                if len(found):
                    assert list(bucket.scores(found, dense)) == list(scores[found])
    assert skipped > 0


def test_search_of_nothing(spark, docs, none, searched):
    _, _, table = searched
    assert lexical.ranked(none, table).collect() == []
    found = lexical.ranked(docs, table.filter("false"))
    assert found.collect() == [] and found.columns == ["item_id", "rank", "doc_id", "score"]


PIECE, WORD = re.compile("[.,;:!?\x0a-\x0d]"), re.compile("[^\x20\x09]+")


def phrases_by_hand(rows, mining):
    f, n = Counter(), Counter()
    for text, lang in rows:
        for piece in PIECE.split(ascii_lower(text or "")):
            words = WORD.findall(piece)
            n[lang or "und"] += len(words)
            for k in range(1, 5):
                for s in range(len(words) - k + 1):
                    f[lang or "und", tuple(words[s : s + k])] += 1
    wanted = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= mining.least}
    gone = set()
    for (lang, words), a in wanted.items():
        for k in range(2, len(words)):
            for s in range(len(words) - k + 1):
                inner = (lang, words[s : s + k])
                if 100 * a >= mining.percent * wanted[inner]:
                    gone.add(inner)
    out = []
    for lang in n:
        found = []
        for (own, words), a in wanted.items():
            if own == lang and (own, words) not in gone:
                cuts = [(2_000_000 * a // (f[own, words[:k]] + f[own, words[k:]]), k) for k in range(1, len(words))]
                score, k = min(cuts)
                found.append((-score, -a, " ".join(words).encode(), f[own, words[:k]], f[own, words[k:]]))
        for r, (s, a, p, left, right) in enumerate(sorted(found)[: mining.top], 1):
            out.append((lang, r, p.decode(), -a, left, right, n[lang], -s))
    return ordered(out)


def phrase_rows():
    rng = random.Random(2)
    words = ["a", "b", "C", "dé", "e-f", "\x0b", "ß", " g", "h"] + [f"w{k}" for k in range(60)]
    texts = []
    for _ in range(60):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n"]) for _ in range(80))
        texts.append((text + " New york city  hall", rng.choice(["aa", "bb", None])))
    texts += [("again again again again again " * 60, "aa"), ("x y z u v " * 50, None), (None, "aa"), ("", None), ("one", "cc")]
    return texts + [("the same line, of words", "und")] * 40


@pytest.fixture(scope="module")
def phrased(spark):
    rows = phrase_rows()
    kinds = "text string, lang string, phrase string, f bigint, a int, k int, part int, `group` int, prefix int"
    return rows, spark.createDataFrame([(*r, *[None] * 7) for r in rows], kinds).repartition(6)


@pytest.mark.parametrize("budget", [2 << 20, 2000, 64])
def test_phrases_equal_brute_force(phrased, monkeypatch, budget):
    """Also with so little room that prefixes are extended, up to whole suffixes, and cells are split."""
    rows, table = phrased
    monkeypatch.setattr(collocations, "HELD_WORDS", 300)
    monkeypatch.setattr(collocations, "COUNTED_WORDS", 500)
    mining = collocations.Mining(least=8, budget=budget, top=150)
    assert ordered(collocations.mined(table, mining).collect()) == phrases_by_hand(rows, mining)


def test_prefixes_are_extended_until_they_fit(spark, phrased):
    _, table = phrased
    texts = table.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("body"))
    scratch = collocations.Scratch(spark)
    words = collocations._word_counts(texts)
    assert collocations.partitioned(texts, words, collocations.Mining(), scratch).hot == []
    small = collocations.partitioned(texts, words, collocations.Mining(budget=64), scratch)
    assert len(small.hot) == 3
    assert len(set(zip(small.first, small.parts, strict=True))) > 20
    scratch.remove()


def test_phrases_in_two_rounds(phrased, monkeypatch):
    rows, table = phrased
    monkeypatch.setattr(collocations, "RANKED_TOGETHER", 10)
    mining = collocations.Mining(least=8, top=7)
    assert ordered(collocations.mined(table, mining).collect()) == phrases_by_hand(rows, mining)


def test_many_words_do_not_fit_one_number():
    w = collocations.np.array([[1, 1, 70000, 1], [2, 2, 3, 2], [0, 0, 0, 5], [0, 0, 0, 0]])
    found, counts = collocations._distinct(w, collocations.np.array([1, 2, 3, 4]))
    assert found.tolist() == [[1, 1, 70000], [2, 2, 3], [0, 5, 0], [0, 0, 0]] and counts.tolist() == [3, 4, 3]


def sent_here(rows, groups, hot=()):
    """What the task that sends suffixes makes of the rows, with cells dealt into so many groups."""
    first, parts = np.arange(1 << collocations.CELL_BITS) % groups, np.ones(1 << collocations.CELL_BITS, np.uint64)
    directory = SimpleNamespace(value=collocations.Directory(list(hot), first, parts))
    send = collocations._sent(SimpleNamespace(mapInArrow=lambda task, kinds: task), directory)
    texts, langs = (pa.array(c) for c in zip(*rows, strict=True))
    return pa.Table.from_batches(send(iter([pa.RecordBatch.from_arrays([langs, texts], names=["lang", "body"])]))).combine_chunks()


def build_here(least):
    """The function that a group's pieces go to."""
    sent = MagicMock()
    collocations._phrases(sent, least)
    return sent.groupBy.return_value.applyInArrow.call_args[0][0]


def calls(run):
    """How many functions are called, and the result."""
    n = 0

    def seen(frame, event, arg):
        nonlocal n
        n += event in ("call", "c_call")

    sys.setprofile(seen)
    try:
        found = run()
    finally:
        sys.setprofile(None)
    return n, found


def some_texts(long):
    rng = random.Random(8)
    words = [f"w{rng.randrange(10**6)}" for _ in range(900)] + ["x" * k for k in long]
    return [(" ".join(rng.choices(words, k=30)) + ". the same line", rng.choice(["aa", "bb"])) for _ in range(60)]


def test_sending_does_not_cost_more_the_more_groups_there_are(spark, monkeypatch):
    rows = some_texts([])
    few, table = calls(lambda: sent_here(rows, 1))
    many, spread = calls(lambda: sent_here(rows, 4096))
    assert table.num_rows == 2 and spread.num_rows > 1000
    assert many < few + 50
    build = build_here(2)
    few, _ = calls(lambda: build(table))
    monkeypatch.setattr(collocations, "HELD_WORDS", 20)
    monkeypatch.setattr(collocations, "TEXT_BYTES", 20)
    pieces = sent_here(rows, 1)
    many, _ = calls(lambda: build(pieces))
    assert pieces.num_rows == 60
    assert many < few + 50


def test_pieces_have_all_phrases(spark, monkeypatch):
    """Also of long words, in small pieces, and below prefixes that are extended."""
    monkeypatch.setattr(collocations, "PIECE", 3)
    monkeypatch.setattr(collocations, "SENT_TOGETHER", 50)
    rows = some_texts([63, 64, 65, 300]) + [("a b a b c " * 9, "aa")]
    wanted = Counter()
    for text, lang in rows:
        for words in (piece.split() for piece in text.split(".")):
            wanted.update((lang, " ".join(words[s : s + k])) for k in (2, 3, 4) for s in range(len(words) - k + 1))
    hashes = [collocations._hashes(lang, pa.array(["the", "x" * 64, "a"]))[1:] for lang in ("aa", "bb")]
    assert len(set(np.concatenate(hashes).tolist())) == 6
    build = build_here(1)
    for hot in [], [np.sort(np.concatenate(hashes))]:
        table, found = sent_here(rows, 7, hot), Counter()
        assert max(len(w.as_py()) for w in table["leaves"]) <= 12
        for group in table["group"].unique():
            for row in build(table.filter(pc.equal(table["group"], group))).to_pylist():
                found[row["lang"], row["phrase"]] += row["f"]
        assert found == wanted


def test_pieces_with_as_many_words_as_fit():
    n = collocations.PIECE + 3
    spelled = pa.array([" ", *(f"w{k} " for k in range(4 * n))])
    w = np.arange(1, 4 * n + 1).reshape(n, 4).T.copy()
    w[3, collocations.PIECE :: 2] = 0
    batch = collocations._pieces("aa", spelled, np.zeros(n, np.int64), w, np.full(n, 7, np.uint32))
    assert batch.num_rows == 2
    words, found, counts, depths = collocations._subtree(pa.Table.from_batches([batch]))
    assert set(counts) == {1} and set(depths) == {4}
    assert [words[k].as_py() for k in found.T.ravel().tolist()] == [spelled[k].as_py()[:-1] for k in w.T.ravel().tolist()]


def test_phrases_of_nothing(none, docs):
    found = collocations.mined(none)
    assert found.collect() == []
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    rows = [(r[1], r[2]) for r in documents()]
    assert ordered(collocations.mined(docs).collect()) == phrases_by_hand(rows, collocations.Mining())


PAGES = "page_id bigint, url string, html string, size int, row int, sha1 string, chunk int, body string, kind string"


def pages():
    rows = [
        (1, "http://a.example/", "<p>one</p>"), (2, "http://b.example/x\r\ny", "<p>one</p>"), (3, None, None), (4, "", ""),
        (5, "http://c.example", "x" * 5000), (6, "http://c.example", "x" * 5000), (7, "u", "a\r\n\r\nWARC/1.1\r\nb\n\n"),
        (8, "u", "é" * 1700 + "\r\n\r\n"), (8, "u", "é" * 1700 + "\r\n\r\n"), (None, "n", "<p>one</p>"), (None, "n", "alone"),
        (9, "u", "\r\n" * 900), (10, "u", "y" * 1000), (11, "u", "y" * 1001), (12, "u", "\n"),
    ]
    return [(*r, *[None] * 6) for r in rows]


def archived_by_hand(rows, least=0):
    bodies = [(r[0], (r[2] or "").encode()) for r in rows]
    best = {}
    for at, (page, body) in enumerate(bodies):
        rank = (page is not None, page or 0)
        if len(body) >= least and (body not in best or rank >= best[body][0]):
            best[body] = rank, at, page
    out = []
    for at, (page, body) in enumerate(bodies):
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        first = best.get(body, (None, at, None))
        kind = "response" if first[1] == at else "revisit"
        out.append((page, len(body), digest, kind, None if kind == "response" else first[2]))
    return ordered(out)


def listing(spark, folder):
    rows = warc.listed(spark, folder).collect()
    assert all(r["stated"] == f"sha1:{r['digest']}" for r in rows)
    number = lambda x: None if x is None else int(x)
    return ordered((number(r["source"]), r["size"], r["digest"], r["kind"], number(r["refers_source"])) for r in rows)


@pytest.mark.parametrize(("least", "segment"), [(0, 1 << 20), (0, 1000), (11, 7)])
def test_archives_and_back(spark, tmp_path, least, segment):
    table = spark.createDataFrame(pages(), PAGES).repartition(3)
    folder = str(tmp_path / "archives")
    warc.write(table, folder, id="page_id", url="url", payload="html", least=least, segment=segment)
    assert listing(spark, folder) == archived_by_hand(pages(), least)


def texts_of(folder):
    return [gzip.open(p).read() for p in sorted(folder.glob("part-*.gz"))]


def test_archives_are_plain_records(spark, tmp_path):
    """Read by a small reader of the format: fields, lengths, and segments that make the payload."""
    folder = tmp_path / "archives"
    table = spark.createDataFrame(pages(), PAGES).coalesce(1)
    warc.write(table, str(folder), id="page_id", url="url", payload="html", segment=700)
    blocks, kinds, ids = {}, Counter(), set()
    for data in texts_of(folder):
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            version, *lines = head.decode().split("\r\n")
            said = dict(line.split(": ", 1) for line in lines)
            size = int(said["Content-Length"])
            assert version == "WARC/1.1" and rest[size : size + 4] == b"\r\n\r\n"
            kinds[said["WARC-Type"]] += 1
            ids.add(said["WARC-Record-ID"])
            origin = said.get("WARC-Segment-Origin-ID", said["WARC-Record-ID"])
            blocks.setdefault(origin, []).append((int(said.get("WARC-Segment-Number", 1)), rest[:size], said))
            data = rest[size + 4 :]
    assert len(ids) == sum(kinds.values()) and kinds["revisit"] == 5 and kinds["continuation"] > 10
    for parts in blocks.values():
        parts.sort(key=lambda x: x[0])
        assert [p[0] for p in parts] == list(range(1, len(parts) + 1))
        block, said = b"".join(p[1] for p in parts), parts[0][2]
        if len(parts) > 1:
            assert int(parts[-1][2]["WARC-Segment-Total-Length"]) == len(block)
        if said["WARC-Type"] == "response":
            payload = block.partition(b"\r\n\r\n")[2]
            digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            assert said["WARC-Payload-Digest"] == f"sha1:{digest}"
        else:
            assert said["WARC-Refers-To"] in ids


def test_plain_files_in_many_splits(spark, tmp_path):
    """Unzipped archives are split among tasks; their lines meet again in order, and bodies come in chunks."""
    folder = tmp_path / "archives"
    rows = pages() + [(100 + k, "u", f"{k} " * 900 + "\n" * k, *[None] * 6) for k in range(60)]
    table = spark.createDataFrame(rows, PAGES).coalesce(2)
    warc.write(table, str(folder), id="page_id", url="url", payload="html", segment=800)
    unzipped = tmp_path / "plain"
    unzipped.mkdir()
    for k, data in enumerate(texts_of(folder)):
        (unzipped / f"{k}.warc").write_bytes(data)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert listing(spark, str(unzipped)) == archived_by_hand(rows)
        chunks = warc.read(spark, str(unzipped)).filter("source = '159' or segment > 1").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    (own,) = {r["record"] for r in chunks if r["source"] == "159"}
    pieces = sorted((r["segment"], r["chunk"], bytes(r["body"])) for r in chunks if r["record"] == own)
    assert b"".join(p[2] for p in pieces).decode() == rows[-1][2] and len(pieces) > 2


def test_long_records_come_in_chunks():
    """A record of another writer, however long, is passed on piece by piece."""
    payload = bytes(range(256)) * 20_000
    block = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n" + payload
    head = f"WARC/1.0\r\nwarc-type: response\r\nWARC-Record-ID: <x>\r\nContent-Type: application/http\r\nContent-Length: {len(block)}\r\n\r\n"
    data = head.encode() + block + b"\r\n\r\n" + b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    parser = warc.Parser(bodies=True)
    for at in range(0, len(data), 99_991):
        parser.feed(data[at : at + 99_991])
        assert len(parser.rest) < 1 << 18
    parser.end()
    rows = [dict(zip(warc.NAMES, r, strict=True)) for r in parser.rows]
    assert b"".join(r["body"] for r in rows if r["record"] == "<x>") == payload and len(rows) > 40
    assert [r["chunk"] for r in rows[:-1]] == list(range(len(rows) - 1))
    assert rows[-2]["digest"] == base64.b32encode(hashlib.sha1(payload).digest()).decode()
    assert rows[-2]["size"] == len(payload) and rows[-1]["kind"] == "warcinfo"


def test_broken_archives_are_reported():
    parser = warc.Parser(bodies=False)
    parser.feed(b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 10\r\n\r\nshort")
    with pytest.raises(ValueError, match="ends within"):
        parser.end()
    with pytest.raises(ValueError, match="no WARC record"):
        warc.Parser(bodies=False).feed(b"<html>\r\n\r\n")


def test_archives_of_nothing(spark, tmp_path):
    folder = str(tmp_path / "none")
    warc.write(spark.createDataFrame([], PAGES), folder, id="page_id", url="url", payload="html")
    assert warc.listed(spark, folder).collect() == []


def test_cases_have_clashing_columns():
    assert SCHEMA.count(",") == EXTRA + 3
