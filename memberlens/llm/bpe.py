"""BPE encoding by backtracking, and decoding by an offset table.

A word is encoded left to right. An Aho-Corasick automaton gives the longest token at every
place; a token is taken if a pair-compatibility table says that BPE leaves it and the token
before it apart, else a shorter one is tried, and if none is left, the token before goes.
Places that turned out to be dead ends are remembered, so a word costs linear time, and the
tokens are exactly those of applying the merges in order.

Reads the files of the tokenizers library whose model is BPE with an end-of-word suffix over
bytes, with NFC, white space and lower case normalised and words split off by a pattern.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memberlens.llm.scratch import columns

#: Entries at which a cache starts anew: digests of words (some 200 MB in each Python worker,
#: filled by digests() only), ids of pieces, and verdicts on pairs of tokens (some 30 MB each).
WORD_CACHE, PIECE_CACHE, PAIR_CACHE = 1 << 19, 1 << 16, 1 << 17
#: Stands for the end-of-word suffix; no byte is mapped to it.
END = "\x00"
NEVER = 1 << 62
#: The pattern of the file this was written for, with white space as Unicode has it.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+"


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class Tokenizer:
    """``encode`` and ``decode`` as the tokenizers library has them, without template tokens."""

    def __init__(self, file: str):
        spec = json.loads(file)
        model, suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        names = [n.get("type") for n in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or not suffix or names != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("not a BPE file of the kind described above")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        self.letters = byte_letters()
        self._read_merges(model, suffix)
        self._read_automaton()
        self._fill_offsets(model["vocab"])
        self.specials = regex.compile("|".join(map(regex.escape, self.special)) or "(?!)")
        self.words = regex.compile(WORDS)
        self.by_piece: dict[str, list[int]] = {}
        self.by_word: dict[str, tuple[int, str, str]] = {}
        self.compatible: dict[tuple[int, int], bool] = {}

    def _read_merges(self, model: dict, suffix: str) -> None:
        vocab = model["vocab"]
        self.spelt: dict[int, str] = {}
        parts: dict[int, tuple[int, int]] = {}
        for letter in self.letters:
            self.spelt[vocab[letter]] = letter
            self.spelt[vocab[letter + suffix]] = letter + END
        self.rank: dict[tuple[int, int], int] = {}
        made_at: dict[int, int] = {}
        for rank, (left, right) in enumerate(model["merges"]):
            a, b, both = vocab[left], vocab[right], vocab[left + right]
            self.rank[a, b] = rank
            if both not in self.spelt:
                self.spelt[both], parts[both] = self.spelt[a] + self.spelt[b], (a, b)
                made_at[both] = rank
        # What a token shows at its right (left) end while it is built, with the rank of the
        # merge that ends that: from one symbol up to the whole token, which stays.
        self.right_end = {t: self._growth(t, parts, made_at, 1) for t in self.spelt}
        self.left_end = {t: self._growth(t, parts, made_at, 0) for t in self.spelt}

    @staticmethod
    def _growth(token: int, parts: dict, made_at: dict, side: int) -> list[tuple[int, int]]:
        steps, until = [], NEVER
        while True:
            steps.append((token, until))
            if token not in parts:
                return steps[::-1]
            until = made_at[token]
            token = parts[token][side]

    def _read_automaton(self) -> None:
        self.ids = {s: t for t, s in self.spelt.items()}
        self.longest_at = ahocorasick.Automaton()
        for spelt, token in self.ids.items():
            self.longest_at.add_word(spelt[::-1], token)
        self.longest_at.make_automaton()
        self.length = {t: len(s) for t, s in self.spelt.items()}
        self.shorter: dict[int, int | None] = {}
        for spelt, token in self.ids.items():
            heads = (self.ids.get(spelt[:n]) for n in range(len(spelt) - 1, 0, -1))
            self.shorter[token] = next((t for t in heads if t is not None), None)

    def _fill_offsets(self, vocab: dict[str, int]) -> None:
        """All tokens' texts in one string of bytes, and where each begins."""
        texts = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for text, token in {**vocab, **self.special}.items():
            texts[token] = text.encode()
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).tolist()
        self.all_texts = b"".join(texts)

    def decode(self, ids: list[int]) -> str:
        """The tokens' texts, a space between them."""
        blob, at = self.all_texts, self.offsets
        return b" ".join(blob[at[i] : at[i + 1]] for i in ids).decode()

    def _fit(self, left: int, right: int) -> bool:
        """Whether BPE leaves the two apart when their texts stand side by side.

        They are built up side by side: whichever end symbol is merged next gives way to
        the larger one, unless the two ends are merged with each other before.
        """
        ends, heads = self.right_end[left], self.left_end[right]
        i = j = 0
        while True:
            (a, a_until), (b, b_until) = ends[i], heads[j]
            both = self.rank.get((a, b), NEVER)
            # At equal ranks the place further left is merged first.
            if both != NEVER and both < a_until and both <= b_until:
                return False
            if a_until == b_until == NEVER:
                return True
            if a_until <= b_until:
                i += 1
            else:
                j += 1

    def fits(self, left: int, right: int) -> bool:
        known = self.compatible.get((left, right))
        if known is None:
            if len(self.compatible) >= PAIR_CACHE:
                self.compatible.clear()
            known = self.compatible[left, right] = self._fit(left, right)
        return known

    def encode_piece(self, piece: str) -> list[int]:
        """The tokens of one piece that the pattern has split off."""
        if piece.isascii() and piece.isprintable():
            word = piece + END
        else:
            letters = self.letters
            word = "".join([letters[b] for b in piece.encode()]) + END
        n = len(word) - 1
        longest: list[int | None] = [None] * (n + 1)
        for end, token in self.longest_at.iter(word[::-1]):
            if longest[n - end] is None:  # the longest of those that begin here comes first
                longest[n - end] = token
        length, shorter, known = self.length, self.shorter, self.compatible.get
        tokens, at, dead = [], 0, set()
        token, last = longest[0], None
        while at <= n:
            while token is not None:
                end = at + length[token]
                # The end mark is part of the last letter's symbol: nothing ends just before it.
                if end != n and end not in dead:
                    if last is None:
                        break
                    fit = known((last, token))
                    if fit or (fit is None and self.fits(last, token)):
                        break
                token = shorter[token]
            if token is not None:
                tokens.append(token)
                last, at = token, end
                token = longest[at] if at <= n else None
            else:
                dead.add(at)
                if not tokens:
                    raise ValueError(f"the vocabulary cannot spell {piece!r}")
                gone = tokens.pop()
                at -= length[gone]
                last = tokens[-1] if tokens else None
                token = shorter[gone]
        return tokens

    def _piece(self, piece: str) -> list[int]:
        known = self.by_piece.get(piece)
        if known is None:
            if len(self.by_piece) >= PIECE_CACHE:
                self.by_piece.clear()
            known = self.encode_piece(piece)
            if len(piece) < 64:
                self.by_piece[piece] = known
        return known

    def _normal(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        # Letter by letter: no special sigma at the end of a word.
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def _parts(self, text: str) -> Iterator[str | int]:
        """Stretches of normalised text, and special tokens."""
        at = 0
        if "<" in text:
            for found in self.specials.finditer(text):
                yield self._normal(text[at : found.start()])
                yield self.special[found.group()]
                at = found.end()
        yield self._normal(text[at:])

    def encode(self, text: str) -> list[int]:
        ids = []
        for part in self._parts(text):
            if isinstance(part, int):
                ids.append(part)
            else:
                for piece in self.words.findall(part):
                    ids += self._piece(piece)
        return ids

    def _word(self, word: str) -> tuple[int, str, str]:
        pieces = self.words.findall(word)
        # A word that is one piece is kept as a word; its parts with commas share pieces.
        find = self.encode_piece if len(pieces) == 1 else self._piece
        ids = [i for piece in pieces for i in find(piece)]
        known = (len(ids), " ".join(map(str, ids)), self.decode(ids))
        if len(self.by_word) >= WORD_CACHE:
            self.by_word.clear()
        if len(word) < 64:
            self.by_word[word] = known
        return known

    def digest(self, text: str) -> tuple[int, str, str]:
        """The number of ids, and the SHA-256 of the ids and of what they decode to."""
        count, ids, decoded = 0, [], []
        for part in self._parts(text):
            if isinstance(part, int):
                found = [(1, str(part), self.decode([part]))]
            elif regex.search("[\x1c-\x1f]", part):  # split() would take these for spaces
                found = [self._word(w) for w in regex.split(r"\p{White_Space}+", part)]
            else:
                get = self.by_word.get
                found = [get(w) or self._word(w) for w in part.split()]
            for n, names, texts in found:
                if n:
                    count += n
                    ids.append(names)
                    decoded.append(texts)
        sha = [hashlib.sha256(" ".join(x).encode()).hexdigest() for x in (ids, decoded)]
        return count, *sha


def _encoder(docs: DataFrame, path: str):
    """A function for tasks that returns the tokenizer, built once for each Python worker."""
    shared = docs.sparkSession.sparkContext.broadcast({"file": Path(path).read_text()})

    def get() -> Tokenizer:
        kept = shared.value
        if "tokenizer" not in kept:
            kept["tokenizer"] = Tokenizer(kept["file"])
        return kept["tokenizer"]

    return get


def _mapped(docs: DataFrame, text: str, fields: list[T.StructField], answer) -> DataFrame:
    """``doc`` (the row but for its text) and what ``answer`` gives for each text."""
    others = F.struct(*columns(docs, text)).alias("doc")
    rows = docs.select(others, F.coalesce(text, F.lit("")).alias("whole"))
    schema = T.StructType([rows.schema["doc"], *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = 256
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                found = answer(part.column(1))
                arrays = [part.column(0), *found]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return rows.mapInArrow(run, schema)


def encoded(docs: DataFrame, path: str, *, text: str = "text") -> DataFrame:
    """``doc``, the document's columns but for its text, and ``ids``. A null text is empty."""
    tokenizer = _encoder(docs, path)

    def answer(texts: pa.Array) -> list[pa.Array]:
        # A text that comes several times, as a mix has it, is encoded once.
        coded = texts.dictionary_encode()
        ids = [tokenizer().encode(t.as_py()) for t in coded.dictionary]
        return [pa.array(ids, pa.list_(pa.int32())).take(coded.indices)]

    return _mapped(docs, text, [T.StructField("ids", T.ArrayType(T.IntegerType()))], answer)


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` with ``text``, what their ``ids`` decode to; null ids are no ids."""
    tokenizer = _encoder(rows, path)

    @F.pandas_udf("string")
    def texts(ids):
        return ids.map(lambda x: tokenizer().decode([] if x is None else list(x)))

    return rows.withColumn("text", texts("ids"))


def digests(docs: DataFrame, path: str, *, text: str = "text") -> DataFrame:
    """``doc``, n_tokens and the SHA-256 of ids and decoded text, which stay in the task."""
    tokenizer = _encoder(docs, path)

    def answer(texts: pa.Array) -> list[pa.Array]:
        digest = tokenizer().digest
        count, ids, back = zip(*(digest(t.as_py()) for t in texts), strict=True)
        return [pa.array(count, pa.int64()), pa.array(ids), pa.array(back)]

    names = T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())
    return _mapped(docs, text, [T.StructField("n_tokens", T.LongType()), *names], answer)
