"""Sharding, mixing, language ID, URL filter, BPE and nearest neighbours."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer as Public

import corpus_pipeline
from memberlens.llm import bpe, language, mixing, queries, rotated_codes, sharding, url_model
from tests.llm.cases import DATA, WORD, docs, documents, none, ordered  # noqa: F401

ROWS = [r[:4] for r in documents()]


def md5_bits(i, text) -> str:
    body = hashlib.md5((text or "").encode()).hexdigest()
    name = hashlib.md5(f"{'' if i is None else i}:{body}".encode()).hexdigest()
    return f"{int(name[:12], 16):048b}"


def test_shards_split_only_where_they_are_too_large(docs):
    limit = 2000
    found = sharding.sharded(docs, limit=limit).select("doc.doc_id", "doc.text", "shard", "n_bytes", "shard_bytes")
    sizes = [(md5_bits(i, t), len((t or "").encode())) for i, t, *_ in ROWS]

    def shard(bits: str, prefix: str = "") -> tuple[str, int]:
        held = sum(n for b, n in sizes if b.startswith(prefix))
        alone = sum(b.startswith(prefix) for b, _ in sizes) == 1
        if held <= limit or alone or len(prefix) == 48:
            return prefix, held
        return shard(bits, bits[: len(prefix) + 1])

    want = [(i, t, p, len((t or "").encode()), n) for i, t, *_ in ROWS for p, n in [shard(md5_bits(i, t))]]
    assert ordered(found.collect()) == ordered(want)


def test_shards_of_repeated_rows_fit(spark):
    rows = [(7, "x" * 100, "a")] * 333 + [(None, "é" * 40, None)] * 50 + [(k, f"text {k}", "b") for k in range(90)]
    rows += [(1000, "y" * 1500, "c")] * 3 + [(1001, "z" * 1500, "c"), (None, None, None), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(5)
    found = sharding.sharded(docs, limit=1000, split_repeats=True).select("doc.*", "shard", "n_bytes", "shard_bytes").collect()
    assert ordered((r["doc_id"], r["text"], r["source"]) for r in found) == ordered(rows)
    held, texts = Counter(), defaultdict(list)
    for r in found:
        assert r["n_bytes"] == len((r["text"] or "").encode())
        held[r["shard"]] += r["n_bytes"]
        texts[r["shard"]].append(r["text"])
    assert all(r["shard_bytes"] == held[r["shard"]] for r in found)
    assert all(n <= 1000 or len(texts[shard]) == 1 for shard, n in held.items())
    names = sorted(held)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:]))
    assert sum(set(x) == {"x" * 100} for x in texts.values()) <= 64


def test_one_large_document_is_split_off_in_few_passes(spark, monkeypatch):
    """However large, it is a shard as soon as it is alone."""
    rows = [(k, f"text {k} " * 40) for k in range(200)] + [(999, "x" * 3_000_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    tables, saved = [], sharding.saved
    monkeypatch.setattr(sharding, "saved", lambda df: tables.append(1) or saved(df))
    found = sharding.sharded(docs, limit=20_000, split_repeats=True).select("doc.doc_id", "shard", "shard_bytes").collect()
    assert len(found) == 201 and len(tables) <= 4
    assert max(len(r["shard"]) for r in found) < 24
    assert all(r["shard_bytes"] <= 20_000 for r in found if r["doc_id"] != 999)


def test_empty_tables_of_sharding_and_mixing(none):
    assert sharding.sharded(none, split_repeats=True).collect() == []
    assert mixing.mixed(none).collect() == [] and mixing.emitted(none).collect() == []


def test_rows_without_an_id_spread_over_cells(spark, monkeypatch):
    """A third of the rows have no id; no cell that one task ranks has many of them."""
    rows = [(None if k % 3 == 0 else k, f"word{k} and more", "s") for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    cells, saved = [], mixing.saved
    monkeypatch.setattr(mixing, "saved", lambda df: cells.append(saved(df)) or cells[-1])
    found = mixing.mixed(docs)
    assert found.count() == 3000
    assert max(r["n"] for r in cells[0].collect()) < 20
    total = found.agg(F.sum(F.col("size") * F.col("copies"))).first()[0]
    assert abs(total - 1.5 * 9000) <= 6


def test_shards_are_written(docs, spark, tmp_path):
    sharding.write_shards(docs, str(tmp_path / "out"), limit=20_000)
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(ROWS)


def brute_targets(sizes: dict, weights=(5, 2, 1), share=1.5, most=2) -> dict:
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: float(weights[k % 3]) for k, s in enumerate(names)}
    full: set = set()
    while True:
        rest = share * sum(sizes.values()) - sum(most * sizes[s] for s in full)
        free = sum(weight[s] for s in names if s not in full)
        over = {s for s in names if s not in full and rest * weight[s] / free > most * sizes[s]}
        if not over:
            return {s: float(most * sizes[s]) if s in full else rest * weight[s] / free for s in names}
        full |= over


def test_mix_comes_near_its_targets(docs):
    rows = mixing.mixed(docs, carry=True).select("doc.doc_id", "doc.source", "size", "source_size", "target", "copies")
    rows = rows.collect()
    sizes = Counter()
    for _, t, _, s in ROWS:
        sizes[s] += len(WORD.findall(t or ""))
    targets = brute_targets(sizes)
    assert sorted(r["size"] for r in rows) == sorted(len(WORD.findall(t or "")) for _, t, *_ in ROWS)
    taken, largest = Counter(), Counter()
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and 0 <= r["copies"] <= 2
        assert math.isclose(r["target"], targets[r["source"]], rel_tol=1e-12)
        taken[r["source"]] += r["size"] * r["copies"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= 2 * largest[s] + 1, s
    again = mixing.mixed(docs.repartition(7), carry=True).select("doc.doc_id", "doc.text", "copies")
    first = mixing.mixed(docs, carry=True).select("doc.doc_id", "doc.text", "copies")
    assert ordered(again.collect()) == ordered(first.collect())


def test_mix_of_many_documents_is_close(spark):
    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"),
        F.repeat(F.lit("w "), (F.col("id") % 50 + 1).cast("int")).alias("text"),
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 5)).alias("source"),
    )
    rows = mixing.mixed(docs, carry=True).groupBy("doc.source").agg(
        F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target")
    )
    for r in rows.collect():
        assert abs(r["taken"] - r["target"]) <= 0.01 * r["target"] + 100


def test_emitted_copies(docs):
    want = Counter()
    for r in mixing.mixed(docs, carry=True).select("doc.doc_id", "doc.text", "copies").collect():
        want[r["doc_id"], r["text"]] += r["copies"]
    out = mixing.emitted(docs)
    assert out.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == +want


def test_languages_of_unseen_documents(spark):
    folder = DATA.replace("0.001", "0.01")
    found = queries.op4_string_kernel(spark, folder)
    truth = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    rows = found.join(truth, "doc_id").filter("held_out and lang is not null").collect()
    right = sum(r["lang_pred"] == r["lang"] for r in rows) / len(rows)
    assert right >= 0.97, right
    assert all(0 <= r["score"] <= 1 for r in found.collect())


def test_texts_without_letters_have_no_language(docs, none):
    docs = docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "aa").otherwise("bb"))
    found = language.identified(docs).select("doc.*", "held_out", "lang_pred", "score").collect()
    import zlib

    for r in found:
        lettered = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not lettered)
        name = "" if r["doc_id"] is None else str(r["doc_id"])
        assert r["held_out"] == (zlib.crc32(name.encode()) % 4 == 2)
    kept = language.with_language(docs)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r["lang_pred"] != "und" for r in found)
    assert language.identified(none).collect() == []
    unlabelled = language.identified(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in unlabelled.collect()} == {"und"}


def test_languages_of_long_texts_are_learned(spark):
    rng = random.Random(8)
    letters = {"aa": "abcdefgh", "bb": "efghijklm", "cc": "мнопрсту"}

    def prose(lang: str, n: int) -> str:
        return " ".join("".join(rng.choices(letters[lang], k=rng.randint(2, 6))) for _ in range(n))

    rows = [(k, prose("aa", 60), "aa") for k in range(40)]
    rows += [(100 + k, prose("bb", 12_000), "bb") for k in range(12)]
    rows += [(200 + k, prose("cc", 60), None) for k in range(4)] + [(300, "12 !", "aa"), (301, None, "bb")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert min(len(t) for _, t, c in rows if c == "bb" and t) > 50_000
    for r in language.identified(docs).filter("doc.lang is not null").collect():
        lettered = any(c.isalpha() for c in r["doc"]["text"] or "")
        assert r["lang_pred"] == (r["doc"]["lang"] if lettered else "und")
    # A small share of the sample still holds a text of each.
    short = language.identified(docs, language.Fit(sample_bytes=64)).select("lang_pred").distinct()
    assert {"aa", "bb"} <= {r["lang_pred"] for r in short.collect()}
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    kept = language.with_language(unlabelled)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {k for k, t, _ in rows if k < 300}


@pytest.mark.parametrize("kind", ["string", "int"])
def test_the_language_found_is_passed_on(spark, kind):
    """Documents without a label or with a wrong one leave the language stage with the one found."""
    rng = random.Random(9)
    letters = {1: "abcdefgh", 2: "мнопрсту"}

    def prose(lang: int) -> str:
        return " ".join("".join(rng.choices(letters[lang], k=5)) for _ in range(40))

    true = {k: k % 2 + 1 for k in range(120)}
    held = {k for k in true if zlib.crc32(str(k).encode()) % 4 == 2}  # never learned from
    given = {k: None if k % 5 == 0 else 3 - v if k in held else v for k, v in true.items()}
    rows = [(k, prose(v), given[k], f"s{k}") for k, v in true.items()] + [(500, "1 2 3", 1, "s"), (501, None, 2, "s")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang int, source string")
    docs = docs.withColumn("lang", F.col("lang").cast(kind))
    kept = corpus_pipeline.keep_languages(spark, docs, "")
    assert kept.dtypes == docs.dtypes
    assert {r["doc_id"]: int(r["lang"]) for r in kept.collect()} == true
    later = corpus_pipeline.drop_copies(spark, kept, "")
    assert {r["doc_id"]: int(r["lang"]) for r in later.collect()} == true
    same = kept.drop("lang").collect()
    assert ordered(same) == ordered(r for r in docs.drop("lang").collect() if r["doc_id"] < 500)


def test_labels_stay_if_there_is_nothing_to_learn_from(spark):
    held = spark.range(40).filter(language.held_out("id"))
    docs = held.select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"), F.lit("aa").alias("lang"))
    kept = language.with_language(docs).collect()
    assert len(kept) == held.count() > 0 and {r["lang"] for r in kept} == {"aa"}


def test_every_label_and_letter_is_learned(spark):
    rows = []
    for k in range(300):  # languages of three letters that no other has
        own = [chr(0x4E00 + 3 * k + j) for j in range(3)]
        for j in range(4):
            rows.append((len(rows), " ".join(own[j % 3 :] + own[: j % 3]) * 2, f"l{k}"))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    found = language.identified(docs).select("doc.lang", "held_out", "lang_pred").collect()
    learned = {r["lang"] for r in found if not r["held_out"]}
    assert len(learned) > 256
    assert all(r["lang_pred"] == r["lang"] for r in found if r["lang"] in learned)
    # With fewer landmarks than languages, those that have one are still told apart.
    few = language.Fit(landmarks=0, most_landmarks=100)
    found = language.identified(docs, few).select("doc.lang", "held_out", "lang_pred").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in found if r["lang"] in learned) >= 300


def test_many_labels_are_learned_in_bounded_memory():
    """As many labels as landmarks; the driver's matrices are all that grows with them."""
    import tracemalloc

    rng = np.random.default_rng(4)
    labels = [f"l{k:04}" for k in range(1500) for _ in range(2)]
    sets = [np.unique(np.concatenate([[1000 * (k // 2) + j for j in range(4)], rng.integers(1 << 30, 1 << 31, 3)])) for k in range(3000)]
    tracemalloc.start()
    model = language.Classifier.learned(sets, labels, language.Fit())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(model.presence.sizes) == 1500 and peak < 8 * 8 * 1500**2
    scores = model.presence.kernels(sets[::50]) @ model.weights
    assert [model.languages[k] for k in scores.argmax(1)] == labels[::50]


def test_kernels_by_matrix_products_are_exact(monkeypatch):
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 400, rng.integers(0, 200))) for _ in range(70)]
    presence = language.Presence(sets[:30])
    want = [[len(np.intersect1d(a, b)) / np.sqrt(max(len(a), 1) * max(len(b), 1)) for b in sets[:30]] for a in sets]
    for block in (4096, 7):
        monkeypatch.setattr(language, "BLOCK", block)
        assert (presence.kernels(sets) == np.array(want)).all()


def test_a_repeated_row_comes_once_into_the_sample(spark, monkeypatch):
    rows = [(1, "one text many times", "aa")] * 500 + [(4 * k, f"text {chr(97 + k)}", "aa") for k in range(26)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(4)
    sizes = []
    learned = language.Classifier.learned
    monkeypatch.setattr(
        language.Classifier, "learned", lambda sets, labels, fit: sizes.append(len(sets)) or learned(sets, labels, fit)
    )
    assert language.identified(docs, language.Fit(per_language=10_000)).count() == len(rows)
    assert sizes == [docs.filter(~language.held_out("doc_id")).distinct().count()]


def test_kernel_ridge_regression_by_the_book():
    fit = language.Fit(landmarks=5)
    texts = ["der hund bellt", "die katze schläft", "the dog barks", "the cat sleeps", "ein hund und eine katze", "a dog and a cat"]
    labels = ["de", "de", "en", "en", "de", "en"]
    model = language.Classifier.fitted(texts, labels, fit)

    def grams(text):
        padded = "".join(c if c.isalpha() else " " for c in f" {text.lower()} ")
        return {padded[k : k + n] for n in (1, 2, 3) for k in range(len(padded) - n + 1)} - {" "}

    held = [grams(t) for t in texts]
    turn, order = Counter(), []
    for k, label in enumerate(labels):
        order.append((turn[label], label, k))
        turn[label] += 1
    marks = [k for *_, k in sorted(order)[:5]]

    def kernel(a, b):
        return len(a & b) / math.sqrt(len(a) * len(b))

    k_nm = np.array([[kernel(a, held[m]) for m in marks] for a in held])
    k_mm = k_nm[marks]
    wanted = np.array([[1.0 if x == y else -1.0 for y in model.languages] for x in labels])
    left = k_nm.T @ k_nm + fit.ridge * len(texts) / 5 * k_mm
    left += 1e-6 * np.trace(left) / 5 * np.eye(5)
    scores = k_nm @ np.linalg.solve(left, k_nm.T @ wanted)
    assert np.allclose(model.presence.matrix(texts) @ model.weights, scores, atol=1e-3)


RULES = queries.URL_RULES
URLS = [
    None, "", "no scheme/org/", "http://", "http://org", "http://org/", "https://A.ORG/x?y=//z#k", "x://y://org/a",
    "http://example.org/es/1", "http://www.Example.org/en/12", "http://example.org/en/2", "http://myexample.org/es/",
    "http://a.com/fr/q", "http://a.com/de", "http://a.com/de/", "http://com/de/x", "http://b.com/en/?org/", "http://b.com#/de/",
    "http://b.com/EN/\nx", "ftp://net/é/ü", "http://c.net/" + "z" * 3000, "://d.net/x",
]


def by_hand(url):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
        host, tail = rest[:cut].translate({k: k + 32 for k in range(65, 91)}), rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail] + [len(tail)])]
    best = None
    for verdict, rule in RULES:
        name, start = rule.split("/", 1)
        fits = (host == name or host.endswith("." + name)) and path.startswith("/" + start)
        if fits and (best is None or len(rule) > len(best[1])):
            best = verdict, rule
    return host, path, best


def test_rules_and_parts_of_urls(spark):
    rows = [(k, u) for k, u in enumerate(URLS)] + [(0, None), (None, "http://a.com/de/")]
    found = url_model.judged(spark.createDataFrame(rows, "page_id bigint, url string"), RULES)
    got = ordered((r["page_id"], r["host"], r["path"], r["rule"], r["score"] is None) for r in found.collect())
    want = [(i, *(p := by_hand(u))[:2], p[2] and p[2][1], p[2] is not None) for i, u in rows]
    assert got == ordered(want)
    assert {r["verdict"] for r in found.collect()} == {"allow", "block"}
    none = spark.createDataFrame([], "page_id bigint, url string")
    assert url_model.judged(none, RULES).collect() == []


def test_scores_by_brute_force(spark):
    rng = random.Random(2)
    good, bad = ["alpha", "beta", "gamma"], ["casino", "pills", "spam"]
    urls = [(f"{rng.choice(good)}.{rng.choice(good)}/{rng.randint(1, 99)}", "allow") for _ in range(60)]
    urls += [(f"{rng.choice(bad)}.{rng.choice(good)}/{rng.randint(1, 99)}", "block") for _ in range(60)]
    urls += [("alpha.pills/1", None), ("é", None), ("", None)]
    rows = [(u, v, 1 + k % 3) for k, (u, v) in enumerate(dict(urls).items())]
    frame = spark.createDataFrame(rows, "url string, known string, n bigint")
    held = {
        r["url"] for r in frame.filter(F.pmod(F.xxhash64("url"), F.lit(url_model.HELD_OUT)) == 0).collect()
    }
    n = url_model.GRAM
    counts = {v: [Counter() for _ in range(n + 1)] for v in ("allow", "block")}

    def grams(url):
        padded = url_model.START * (n - 1) + url + url_model.STOP
        return [padded[k : k + n] for k in range(len(url) + 1)]

    for url, known, times in rows:
        if known and url not in held:
            for gram in grams(url):
                for k in range(1, n + 1):
                    counts[known][k][gram[n - k :]] += times

    def probability(verdict, gram):
        if not gram:
            return url_model.FLOOR
        level = counts[verdict][len(gram)]
        after = {g: c for g, c in level.items() if g[:-1] == gram[:-1]}
        below = probability(verdict, gram[1:])
        seen = sum(after.values())
        return (level[gram] + len(after) * below) / (seen + len(after)) if seen else below

    found = {r["url"]: r["score"] for r in url_model.scores(frame).collect()}
    assert set(found) == {u for u, v, _ in rows if v is None or u in held}
    for url, score in found.items():
        each = [math.log(probability("allow", g) / probability("block", g)) for g in grams(url)]
        assert math.isclose(score, sum(each) / len(each), rel_tol=1e-9, abs_tol=1e-9)
    limit = url_model.limit(url_model.scores(frame))
    right = [(found[u] >= limit) == (v == "allow") for u, v, _ in rows if v and u in held]
    assert sum(right) >= 0.9 * len(right)


def test_models_see_the_whole_url(spark):
    rng = random.Random(3)
    good, bad = ["news", "weather", "science"], ["casino", "pills", "jackpot"]
    urls = [f"https://a.org/p{k % 7}?cat={rng.choice(good)}&n={k}" for k in range(80)]
    urls += [f"https://b.com/de/p{k % 7}?cat={rng.choice(bad)}&n={k}" for k in range(80)]
    asked = [f"{start}?cat={word}" for start in ("https://c.net/p", "c.net/p") for word in good + bad]
    asked += ["https://c.net/p#casino pills jackpot", "https://c.net/p#news weather science", None, ""]
    pages = spark.createDataFrame(list(enumerate(urls + asked)), "page_id bigint, url string")
    found = {r["page_id"]: r for r in url_model.judged(pages, RULES).collect()}
    for k, url in enumerate(asked, len(urls)):
        assert found[k]["rule"] is None and found[k]["score"] is not None
        if url:
            assert found[k]["verdict"] == ("block" if any(word in url for word in bad) else "allow"), url
    assert len({found[k]["score"] for k in range(len(urls), len(found))}) == len(asked) - 1


TEXTS = [
    "", " ", "<|endoftext|>", "a<|startoftext|> b<|endoftext|>c", "</w> <w/>", "don't I'LL ΣΑΣ İstanbul", "a" * 400,
    "\x1c\x1d a\x1fb \x85  x y\u3000z", "é e\u0301 ﬁ ＡＢ 𝒜 👍🏽👨‍👩‍👧 ①②½", "\u200b\ufeff\x00 a\x00b", "한국어 テスト 中文 测试 हिन्दी", "'s''t'RE",
]


@pytest.fixture(scope="session")
def public():
    found = Public.from_file(public_tokenizers.path("word_bpe_49k.json"))
    found.no_padding()
    found.no_truncation()
    return found


def test_ids_are_those_of_the_library(public):
    rng = random.Random(4)
    own = bpe.Tokenizer(open(public_tokenizers.path("word_bpe_49k.json")).read())
    parts = ["a", "the", "ing", "é", "1", "!", "?", " ", "\n", "'s", "👍", "ß", "Σ", "½", "ation", "</w>", "<", "|"]
    texts = TEXTS + ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(1500)]
    texts += ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzaeiouaeiou", k=rng.randint(1, 30))) for _ in range(3000)]
    for text in texts:
        ids = public.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids, text
        back = public.decode(ids, skip_special_tokens=False)
        assert own.decode(ids) == back
        names = " ".join(map(str, ids))
        assert own.digest(text) == (len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (names, back)))


def test_encoding_documents_and_back(docs, none, public):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = bpe.decoded(bpe.encoded(docs, path).select("doc.doc_id", "ids"), path)
    want = []
    for i, text, *_ in ROWS:
        ids = public.encode(text or "", add_special_tokens=False).ids
        want.append((i, ids, public.decode(ids, skip_special_tokens=False)))
    assert ordered(rows.collect()) == ordered(want)
    assert bpe.digests(none, path).collect() == []


def brute_nearest(vectors: dict, queries_: list, k: int) -> dict:
    found = {}
    for q in queries_:
        all_ = [(math.sqrt(sum((a - b) ** 2 for a, b in zip(vectors[q], v, strict=True))), i) for i, v in vectors.items() if i != q]
        found[q] = sorted(all_)[:k]
    return found


def test_neighbours_and_recall(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet")
    vectors = {r["vec_id"]: r["embedding"] for r in rows.collect()}
    asked = [i for i in vectors if i % 10 == 0]
    small = rotated_codes.Index(block=64, codes=64)
    found = rotated_codes.nearest(rows, F.pmod("vec_id", F.lit(10)) == 0, index=small).collect()
    want = brute_nearest(vectors, asked, 10)
    got = defaultdict(list)
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["score"], r["vec_id"]))
        exact = np.sqrt(((np.array(vectors[r["query_id"]]) - np.array(vectors[r["vec_id"]])) ** 2).sum())
        assert math.isclose(r["score"], exact, rel_tol=1e-12)
    assert all(len(v) == 10 and v == sorted(v) for v in got.values())
    recall = np.mean([i in {j for _, j in want[q]} for q in asked for _, i in got[q]])
    assert recall >= 0.95, recall


def test_vectors_that_take_no_part_and_ties(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 2.0]), (4, None), (5, [0.0, 0.0])]
    rows += [(6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (100, [])]
    rows += [(200, [3.0, 2.0])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    found = rotated_codes.nearest(frame, F.pmod("vec_id", F.lit(100)) == 0, k=10).collect()
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in found]
    first = [(0, 1, 1), (0, 2, 2), (0, 3, 3), (0, 4, 200)]
    assert sorted(got) == first + [(200, 1, 0), (200, 2, 1), (200, 3, 2), (200, 4, 3)]
    assert rotated_codes.nearest(frame.filter("vec_id is null"), F.lit(True)).collect() == []
    assert rotated_codes.nearest(frame.filter("vec_id in (4, 5)"), F.lit(True)).collect() == []


def test_probed_lists_are_fitted_on_random_queries(spark, monkeypatch):
    rng = np.random.default_rng(4)
    # Ids follow the cluster: the lowest are one tight one.
    centres = rng.normal(size=(20, 8)) * 20
    rows = [(k, (centres[k // 150] + rng.normal(size=8)).tolist()) for k in range(3000)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    asked, probes = [], rotated_codes._probes
    monkeypatch.setattr(
        rotated_codes, "_probes", lambda sample, *rest: asked.append(sample[:256]) or probes(sample, *rest)
    )
    rotated_codes.nearest(frame, F.pmod("vec_id", F.lit(100)) == 0)
    cluster = ((asked[0][:, None] - centres[None]) ** 2).sum(2).argmin(1)
    assert len(asked[0]) == 256 and len(set(cluster.tolist())) >= 15


def test_a_repeated_vector_comes_once_into_the_sample(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(k, rng.normal(size=4).tolist()) for k in range(200)] + [(1, [1.0, 2.0, 3.0, 4.0])] * 400
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(4)
    sizes, centroids = [], rotated_codes._centroids
    monkeypatch.setattr(
        rotated_codes, "_centroids", lambda sample, *rest: sizes.append(len(sample)) or centroids(sample, *rest)
    )
    found = rotated_codes.nearest(frame, F.pmod("vec_id", F.lit(100)) == 0).collect()
    assert sizes == [201] and len(found) == 20


def clustered(n: int) -> list:
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(40, 16)) * 3
    return [(k, (centres[k % 40] + rng.normal(size=16)).tolist()) for k in range(n)]


def test_blocks_that_a_query_reads_do_not_grow_with_the_table(spark, monkeypatch):
    """Recall at two sizes, and how many blocks of original vectors a query is sent to."""
    sent, ranked = [], rotated_codes._Meeting.ranked
    monkeypatch.setattr(
        rotated_codes._Meeting, "ranked", lambda self, whole, asked: sent.append(asked.count()) or ranked(self, whole, asked)
    )
    for n in (3000, 12000):
        rows = clustered(n)
        frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(4)
        v = np.array([x for _, x in rows])
        found = defaultdict(set)
        for r in rotated_codes.nearest(frame, F.col("vec_id") < 100).collect():
            found[r["query_id"]].add(r["vec_id"])
        hits = 0
        for q in range(100):
            gap = ((v - v[q]) ** 2).sum(1)
            gap[q] = np.inf
            hits += len(found[q] & set(np.argsort(gap)[:10].tolist()))
        assert hits >= 950, (n, hits)
    assert sent[1] < 2 * sent[0], sent


def test_many_lists_lie_in_cells(spark, monkeypatch):
    monkeypatch.setattr(rotated_codes, "ONE_CELL", 4)
    v = np.array([x for _, x in clustered(2000)])
    lists = rotated_codes.Lists.fitted(v, 36, 7)
    assert len(lists.centres) == lists.begin[-1] and 6 <= len(lists.centres) <= 36
    of = lists.of(v)
    near = lists.nearest(v, 3)
    assert (of == near[:, 0]).mean() > 0.8 and near.shape == (2000, 3)
    assert rotated_codes._probes(v, lists, 10, 0.985) < len(lists.centres)


def test_of_equal_vectors_the_smallest_ids_are_found(spark):
    """A third of all rows are one vector, some of them with one id; other columns may clash."""
    rng = np.random.default_rng(8)
    rows = [(k, rng.normal(size=4).tolist(), k) for k in range(400)]
    rows += [(k, [1.0, 2.0, 3.0, 4.0], k) for k in range(1000, 1180)] + [(1003, [1.0, 2.0, 3.0, 4.0], 0)] * 20
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, list int").repartition(4)
    found = rotated_codes.nearest(frame, F.col("vec_id").isin(1000, 1001, 1179), k=5).collect()
    got = defaultdict(list)
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert got[1000] == [(x, 0.0) for x in (1001, 1002, 1003, 1003, 1003)]
    assert got[1001] == [(x, 0.0) for x in (1000, 1002, 1003, 1003, 1003)]
    assert got[1179] == [(x, 0.0) for x in (1000, 1001, 1002, 1003, 1003)]


def test_neighbours_without_queries_or_rows(spark):
    frame = spark.createDataFrame(clustered(50), "vec_id bigint, embedding array<double>")
    assert rotated_codes.nearest(frame, F.lit(None).cast("boolean")).collect() == []
    assert rotated_codes.nearest(frame.filter("false"), F.lit(True)).collect() == []
    one = rotated_codes.nearest(frame.filter("vec_id < 2"), F.lit(True), k=3)
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in one.collect()) == [(0, 1, 1), (1, 1, 0)]


def test_estimates_lie_within_their_bounds():
    rng = np.random.default_rng(1)
    v, q = rng.normal(size=(400, 64)), rng.normal(size=(20, 64))
    rotation = rotated_codes._rotation(64, 3)
    codes, norms, fit = rotated_codes.encode(v, rotation)
    unit = q / np.linalg.norm(q, axis=1, keepdims=True)
    product, error = rotated_codes.estimate(codes, fit, unit @ rotation, 3.0)
    true = v / norms[:, None] @ unit.T
    assert codes.shape == (400, 8)
    assert (np.abs(product - true) <= error[:, None]).mean() > 0.99
