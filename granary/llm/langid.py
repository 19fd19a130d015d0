"""Language identification by a string kernel.

The kernel of two texts counts the n-grams of characters, of several lengths
together (a blended spectrum), that are present in both, over the geometric
mean of how many each has. Nyström landmarks stand for the kernel's feature
space: phi(x) = K(x, landmarks) K(landmarks, landmarks)^(-1/2). One ridge
regression per language against the rest is solved on phi. A batch of texts is
a 0/1 matrix of n-grams; its kernel values and scores are matrix products.

N-grams are numbered by a hash into ``features`` cells; two that fall into one
cell count as one, for training and prediction alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.scratch import map_batches, place_of, quoted, with_fields, written

UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_BATCH = 128


@dataclass
class Model:
    """All that a prediction needs; its size depends on the parameters alone."""

    languages: list[str]
    sizes: tuple[int, ...]
    features: int
    landmarks: np.ndarray  # features x landmarks, 0/1 over the root of the landmark's count
    weights: np.ndarray  # landmarks x languages, the whitening folded in
    bias: np.ndarray
    rest: np.ndarray  # each language's mean target: what a text without any evidence is given

    def scores(self, texts: list[str]) -> np.ndarray:
        kernel = presence(texts, self.sizes, self.features) @ self.landmarks
        return kernel @ self.weights + self.bias


def presence(texts: list[str], sizes: tuple[int, ...], features: int) -> np.ndarray:
    """A row per text: 1 / sqrt(number present) where an n-gram of one of the lengths is present, else 0. Case is folded; runs of white space count as one space."""
    out = np.zeros((len(texts), features), dtype=np.float32)
    for row, text in zip(out, texts):
        codes = np.frombuffer(f" {' '.join(text.lower().split())} ".encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
        h = np.zeros(len(codes), dtype=np.uint64)
        for n in range(1, max(sizes) + 1):
            h = h[: len(codes) - n + 1] * np.uint64(0x100000001B3) + codes[n - 1 :] + np.uint64(n) if len(codes) >= n else h[:0]
            if n in sizes:
                row[(h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - features.bit_length() + 1)] = 1
        row /= np.sqrt(max(1, row.sum()))
    return out


def sampled(docs: DataFrame, per_language: int, most_languages: int, sizes: tuple[int, ...], features: int, seed: int) -> list[tuple[str, bytes]]:
    """(lang, which n-grams are present, packed) of the sampled texts, by language and hash. Texts stay in their tasks; the driver gets ``features`` bits of each."""
    known = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    hashed = known.select("lang", F.xxhash64(F.lit(seed), "text").alias("h"), "text")
    # A third of all rows may be of one language: each of per_language salts keeps its first hash, so that many at most meet.
    least = written(hashed.groupBy("lang", F.pmod(F.col("h"), F.lit(per_language)).alias("salt")).agg(F.min("h").alias("h"), F.count("*").alias("n")), "sample")
    largest = least.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages)
    few = least.join(largest.select("lang"), "lang", "left_semi").select("lang", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _BATCH):
                part = batch.slice(at, _BATCH)
                bits = np.packbits(presence(part.column(2).to_pylist(), sizes, features) > 0, axis=1)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([b.tobytes() for b in bits], pa.binary())], ["lang", "h", "bits"])

    # Hashes of per_language rows at most for each of most_languages languages at most: the parameters bound the broadcast and what is collected.
    chosen = map_batches(hashed.join(F.broadcast(few), ["lang", "h"]).select("lang", "h", "text"), run, "lang string, h long, bits binary")
    rows = chosen.groupBy("lang", "h").agg(F.min("bits").alias("bits")).collect()
    return [(r["lang"], bytes(r["bits"])) for r in sorted(rows, key=lambda r: (r["lang"], r["h"]))]


def fit(docs: DataFrame, per_language: int = 400, most_languages: int = 128, landmarks: int = 128, sizes: tuple[int, ...] = (1, 2, 3), features: int = 1 << 13, ridge: float = 0.1, seed: int = 7) -> Model:
    """Learn from ``docs`` (text, lang); rows with a null in either, or no letter, take no part.

    The bounded sample: of each language ``per_language`` rows at most, those
    whose hashed text is the least of its remainder modulo that number; whole
    texts. A column with more values than ``most_languages`` is learnt for those
    that have the most rows, equal numbers by name. ``features`` is a power of two. Landmarks are the first sampled
    texts, as many of each language. The texts' own hash decides, so reruns
    agree and repeated texts count once. Without a usable row the model knows
    no language.
    """
    rows = sampled(docs, per_language, most_languages, sizes, features, seed)
    languages = sorted({lang for lang, _ in rows})
    of = np.array([languages.index(lang) for lang, _ in rows], dtype=np.int64)
    if not languages:
        return Model([], sizes, features, np.zeros((features, 0), np.float32), np.zeros((0, 0), np.float32), np.zeros(0, np.float32), np.zeros(0))
    def unpacked(bits: list[bytes]) -> np.ndarray:
        present = np.unpackbits(np.frombuffer(b"".join(bits), np.uint8).reshape(len(bits), -1), axis=1).astype(np.float32)
        return present / np.sqrt(np.maximum(1, present.sum(axis=1, keepdims=True)))

    share = max(1, landmarks // len(languages))
    marks = unpacked([rows[i][1] for k in range(len(languages)) for i in np.flatnonzero(of == k)[:share]])
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    keep = values > 1e-6 * values.max()
    whiten = vectors[:, keep] / np.sqrt(values[keep])
    kernel = np.concatenate([unpacked([bits for _, bits in rows[at : at + 1024]]) @ marks.T for at in range(0, len(rows), 1024)])
    phi = kernel.astype(np.float64) @ whiten
    target = np.where(of[:, None] == np.arange(len(languages)), 1.0, -1.0)
    phi_mean, target_mean = phi.mean(axis=0), target.mean(axis=0)
    centred = phi - phi_mean
    solved = np.linalg.solve(centred.T @ centred + ridge * np.eye(phi.shape[1]), centred.T @ (target - target_mean))
    return Model(languages, sizes, features, np.ascontiguousarray(marks.T), (whiten @ solved).astype(np.float32), (target_mean - phi_mean @ solved).astype(np.float32), target_mean)


def predict(docs: DataFrame, model: Model, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with lang_pred and score (0 to 1) added, under ``names``, in the place of columns so named.

    The language of the highest regression value; ties go to the first by
    name. score is how far that value is on its way from the language's mean
    target (0) to a member's (1), however many languages there are, to six
    places: beyond them it depends on which texts share a batch. A model of one
    language gives it to every text, with score 1.
    A null text, a text without a letter, or a model that has learnt no
    language gives ``und`` with score 0. Whole texts are read. Only ``text``
    is looked at; all other columns pass through, repeated rows too.
    """
    spark, columns = docs.sparkSession, [c for c in docs.columns if c.lower() not in {n.lower() for n in names}]
    kept = docs.select(*quoted(columns))
    shared, at_text = spark.sparkContext.broadcast(model), place_of(kept.columns, "text")
    schema = with_fields(kept.schema, f"`{names[0]}` string, `{names[1]}` double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, _BATCH):
                batch = whole.slice(at, _BATCH)
                texts = batch.column(at_text).to_pylist()
                good = [i for i, t in enumerate(texts) if t is not None and m.languages and _LETTER.search(t)]
                langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
                if good:
                    values = m.scores([texts[i] for i in good]).astype(np.float64)
                    best = values.argmax(axis=1)
                    way = (values.max(axis=1) - m.rest[best]) / np.maximum(1 - m.rest[best], 1e-9) if len(m.languages) > 1 else np.ones(len(good))
                    for i, k, s in zip(good, best, np.clip(way, 0, 1)):
                        langs[i], scores[i] = m.languages[k], round(float(s), 6)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, *names])

    return map_batches(kept, run, schema)


def held_out(doc_id) -> F.Column:
    """Rows kept from training: crc32 of the decimal doc_id is 1 modulo 3."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


def identified(docs: DataFrame, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with lang_pred and score, under ``names``, learnt from the rows that are not held out. A null doc_id is not held out."""
    train = docs.where(F.coalesce(~held_out("doc_id"), F.lit(True)))
    return predict(docs, fit(train), names)
