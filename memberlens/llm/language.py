"""Language ID by a string kernel.

The kernel of two texts is the number of character n-grams that occur in both (n-grams of
one to three letters together, each counted once, all that is no letter being one
character), over the root of the product of their numbers. Ridge regression, one language
against the rest, is fitted on a sample through Nystroem landmarks. A text's n-grams are
found in the tasks; only those of the sample come to the driver. As an n-gram weighs
nothing unless a landmark has it, those of the landmarks are all that is kept.

Texts are scored in batches by two matrix products: texts by n-grams with n-grams by
landmarks gives the kernel, in whole numbers and thus exactly, column block by column block;
the kernel with the weights gives a score for each language.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memberlens.llm.scratch import columns, saved

UNKNOWN = "und"
#: Characters whose n-grams are sorted together.
PIECE = 1 << 16
#: Texts that are scored together, and n-grams that a matrix has as columns at a time.
BATCH = 64
BLOCK = 4096


@dataclass(frozen=True)
class Fit:
    """What the classifier is fitted on and how large it may get."""

    #: Labelled texts for each language, about, of any length.
    per_language: int = 400
    #: Labelled texts of all languages, about; many languages have fewer each, but 16.
    sample: int = 100_000
    #: n-grams of the sample, 8 bytes each; every language has an equal share, and one text.
    sample_bytes: int = 128 << 20
    #: At least; every language has one, the commonest first, as long as there are not more than
    #: ``most_landmarks``: the others are learned by the landmarks of these. The driver holds about five matrices
    #: of landmarks by landmarks or languages, 8 bytes each: 0.7 GB at 4,096 of both.
    landmarks: int = 256
    most_landmarks: int = 4096
    ridge: float = 1e-2


@cache
def _letters() -> np.ndarray:
    """For each code point itself, or 1 if it is no letter."""
    return np.fromiter((k if chr(k).isalpha() else 1 for k in range(0x110000)), np.int64, 0x110000)


def distinct_grams(text: str) -> np.ndarray:
    """The distinct n-grams of a text in order, each as its code points of 21 bits."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letters = np.concatenate([[1], _letters()[points], [1]])
    found = []
    for lo in range(0, len(letters), PIECE):
        one = letters[lo : lo + PIECE + 2]
        two = one[:-1] << 21 | one[1:]
        three = two[:-1] << 21 | one[2:]
        found.append(np.unique(np.concatenate([one, two, three])))
    own = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
    return own[own != 1]


class Presence:
    """Which n-grams the landmarks have."""

    def __init__(self, marks: list[np.ndarray]):
        self.sizes = np.array([max(len(m), 1) for m in marks], np.float64)
        self.known = np.unique(np.concatenate(marks)) if marks else np.zeros(0, np.int64)
        places = [np.searchsorted(self.known, m) for m in marks]
        gram = np.concatenate(places)
        mark = np.repeat(np.arange(len(marks), dtype=np.int32), [len(m) for m in marks])
        #: The landmarks of a gram follow one another, from ``starts``.
        self.marks = mark[np.argsort(gram, kind="stable")]
        self.starts = np.searchsorted(np.sort(gram), np.arange(len(self.known) + 1))

    def places(self, own: np.ndarray) -> np.ndarray:
        """Where those of a text's n-grams are that a landmark has."""
        if not len(self.known):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.known, own), len(self.known) - 1)
        return at[self.known[at] == own]

    def kernels(self, sets: list[np.ndarray]) -> np.ndarray:
        """A row for each set of n-grams: its kernel with each landmark.

        Both factors are laid out for as many n-grams at a time as have a column in :data:`BLOCK`.
        """
        places = [self.places(own) for own in sets]
        row = np.repeat(np.arange(len(sets)), [len(p) for p in places])
        grams, column = np.unique(np.concatenate([np.zeros(0, np.int64), *places]), return_inverse=True)
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        shared = np.zeros((len(sets), len(self.sizes)))
        for lo in range(0, len(grams), BLOCK):
            some = grams[lo : lo + BLOCK]
            a, b = np.searchsorted(column, [lo, lo + BLOCK])
            texts = np.zeros((len(sets), len(some)), np.float32)
            texts[row[a:b], column[a:b] - lo] = 1
            first, n = self.starts[some], self.starts[some + 1] - self.starts[some]
            steps = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            marks = np.zeros((len(some), len(self.sizes)), np.float32)
            marks[np.repeat(np.arange(len(some)), n), self.marks[np.repeat(first, n) + steps]] = 1
            shared += texts @ marks
        sizes = np.array([max(len(own), 1) for own in sets], np.float64)
        return shared / np.sqrt(np.outer(sizes, self.sizes))

    def matrix(self, texts: list[str]) -> np.ndarray:
        """A row for each text: its kernel with each landmark."""
        return self.kernels([distinct_grams(text) for text in texts])


@dataclass
class Classifier:
    presence: Presence
    languages: list[str]
    weights: np.ndarray

    @classmethod
    def fitted(cls, texts: list[str], labels: list[str], fit: Fit) -> Classifier | None:
        return cls.learned([distinct_grams(text) for text in texts], labels, fit)

    @classmethod
    def learned(cls, sets: list[np.ndarray], labels: list[str], fit: Fit) -> Classifier | None:
        """From the n-grams of texts."""
        if not sets:
            return None
        languages = [c for c, _ in sorted(Counter(labels).items(), key=lambda x: (-x[1], x[0]))]
        place = {c: k for k, c in enumerate(languages)}
        # Landmarks take turns between the languages, so that rare ones have theirs.
        turn = Counter()
        order = []
        for k, label in enumerate(labels):
            order.append((turn[label], label, k))
            turn[label] += 1
        common = {c: k for k, c in enumerate(languages)}
        order.sort(key=lambda x: (x[0], common[x[1]] >= fit.most_landmarks, x[1], x[2]))
        marks = [sets[k] for *_, k in order[: min(max(fit.landmarks, len(languages)), fit.most_landmarks)]]
        presence = Presence(marks)
        between = np.concatenate([presence.kernels(marks[lo : lo + BATCH]) for lo in range(0, len(marks), BATCH)])
        left = fit.ridge * len(sets) / len(marks) * between
        right = np.zeros((len(marks), len(languages)))
        for lo in range(0, len(sets), BATCH):
            to_marks = presence.kernels(sets[lo : lo + BATCH])
            wanted = np.full((len(to_marks), len(languages)), -1.0)
            wanted[np.arange(len(to_marks)), [place[c] for c in labels[lo : lo + BATCH]]] = 1
            left += to_marks.T @ to_marks
            right += to_marks.T @ wanted
        left += 1e-6 * np.trace(left) / len(marks) * np.eye(len(marks))
        return cls(presence, languages, np.linalg.solve(left, right))

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score, 0 to 1; a text without a known gram is of the commonest."""
        # Rounded, so that a text's language does not depend on the batch that it comes in.
        scores = np.round(self.presence.matrix(texts) @ self.weights, 9)
        best = scores.argmax(1)
        score = np.clip((scores[np.arange(len(texts)), best] + 1) / 2, 0, 1)
        return [self.languages[k] for k in best], score


def held_out(id: str) -> F.Column:
    """Documents that are never learned from."""
    return F.pmod(F.crc32(F.coalesce(F.col(id).cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def fitted(docs: DataFrame, fit: Fit, *, text: str, id: str, label: str) -> Classifier | None:
    """The classifier of a sample drawn by a hash of id and text, about as large for each language."""
    spark = docs.sparkSession
    usable = docs.filter(~held_out(id) & F.col(label).isNotNull() & F.col(text).isNotNull()).select(
        F.col(label).cast("string").alias("label"),
        F.xxhash64(F.col(id), F.col(text)).alias("draw"),
        F.col(text).alias("body"),
    )
    place = F.pmod("draw", F.lit(1 << 30)) / float(1 << 30)
    counts = usable.groupBy("label").agg(F.approx_count_distinct("draw").alias("n"), F.min(place).alias("least")).collect()
    if not counts:
        return None
    texts = min(fit.per_language, max(fit.sample // len(counts), 16))
    shares = [(r["label"], max(texts / r["n"], r["least"])) for r in counts]
    shares = spark.createDataFrame(shares, "label string, share double")
    drawn = usable.join(shares, "label").filter(place <= F.col("share")).select("label", "draw", "body")

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                key = row.column(0)[0].as_py(), row.column(1)[0].as_py()
                if key in seen:
                    continue
                seen.add(key)
                own = distinct_grams(row.column(2)[0].as_py())
                arrays = [row.column(0), row.column(1), pa.array([len(own)]), pa.array([own.tobytes()])]
                yield pa.RecordBatch.from_arrays(arrays, names=["label", "draw", "n", "grams"])

    # Rows that repeat share a draw, so that they come once from each task, and then once.
    found = drawn.mapInArrow(present, "label string, draw bigint, n bigint, grams binary")
    sample = saved(found.dropDuplicates(["label", "draw"]))
    # Of each language the texts of the least hashes that fit into its share, and the first one.
    limit = fit.sample_bytes // 8 // len(counts)
    held, last = defaultdict(int), {}
    for r in sorted(sample.select("draw", "label", "n").collect()):
        held[r["label"]] += r["n"]
        if held[r["label"]] <= limit or r["label"] not in last:
            last[r["label"]] = r["draw"]
    if not last:
        return None
    lasts = spark.createDataFrame(list(last.items()), "label string, last bigint")
    kept = sample.join(lasts, "label").filter("draw <= last").select("draw", "label", "grams").toArrow()
    kept = kept.sort_by([("draw", "ascending"), ("label", "ascending")])
    sets = [np.frombuffer(own.as_buffer(), np.int64) for own in kept["grams"]]
    return Classifier.learned(sets, kept["label"].to_pylist(), fit)


def identified(
    docs: DataFrame,
    fit: Fit = Fit(),
    *,
    text: str = "text",
    id: str = "doc_id",
    label: str = "lang",
    labelled: DataFrame | None = None,
) -> DataFrame:
    """``doc`` (the document's columns), held_out, lang_pred and score.

    Learns from ``labelled``, or from ``docs`` themselves. ``und``, with score 0, if a text
    is null or has no letter, or if there was nothing to learn from.
    """
    model = fitted(labelled if labelled is not None else docs, fit, text=text, id=id, label=label)
    shared = docs.sparkSession.sparkContext.broadcast(model and model.__dict__ | {"presence": model.presence.__dict__})
    rows = docs.select(
        F.struct(*columns(docs)).alias("doc"),
        F.when(F.col(text).rlike(r"\p{L}"), F.col(text)).alias("body"),
        held_out(id).alias("held_out"),
    )
    keep = T.StructType([rows.schema["doc"], rows.schema["held_out"]])
    schema = T.StructType(
        [*keep, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, own = shared.value, None
        if parts:
            presence = Presence.__new__(Presence)
            presence.__dict__.update(parts["presence"])
            own = Classifier(**parts | {"presence": presence})
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH):
                part = batch.slice(lo, BATCH)
                bodies = part.column(1).to_pylist()
                names, scores = [UNKNOWN] * len(bodies), np.zeros(len(bodies))
                at = [k for k, body in enumerate(bodies) if body is not None]
                if at and own:
                    found, scores[at] = own.predict([bodies[k] for k in at])
                    for k, name in zip(at, found, strict=True):
                        names[k] = name
                arrays = [part.column(0), part.column(2), pa.array(names, pa.string()), pa.array(scores)]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return rows.mapInArrow(run, schema)


def with_language(docs: DataFrame, fit: Fit = Fit(), *, label: str = "lang", **names: str) -> DataFrame:
    """The documents whose text has a letter, with the language found as their label.

    All other columns are as they were, and so is the label if there is none to learn from.
    """
    found = identified(docs, fit, label=label, **names)
    kept = found.filter(F.col("doc").getField(names.get("text", "text")).rlike(r"\p{L}"))
    kind = docs.select(F.col(label)).schema[0].dataType
    # Without a classifier every score is 0; a label may be spelled like the unknown language.
    learned = (F.col("lang_pred") != UNKNOWN) | (F.col("score") > 0)
    known = F.when(learned, F.col("lang_pred").cast(kind))
    own = F.col("doc").getField(label)
    place = {c: F.col("doc").getField(c).alias(c) for c in docs.columns}
    return kept.select(*(place | {label: F.coalesce(known, own).alias(label)}).values())
