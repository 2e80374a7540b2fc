"""Language identification with string kernels.

Kernel: the blended spectrum of orders 1 to 3 on presence. It counts the character
n-grams that two texts share and divides by the root of their numbers of n-grams.
Nyström: landmarks drawn from the labelled sample span the feature space. One
ridge regression per language, against the rest, is fitted on the features. The
kernel with the landmarks is a product of presence vectors, so scoring folds the
landmarks' n-grams, the Nyström map and the regression weights into one matrix
(n-grams by languages): a batch of texts is its presence matrix times that.

The sample is bounded: up to ``SAMPLE`` distinct labelled texts of each language,
those of the least hashes, whole; ``LANDMARKS`` of each language are landmarks. Tasks
turn them into sets of n-grams, and the sets of the sample come to the driver to
be fitted; a sample above ``FITTED_BYTES`` is refused with a message. Every label is
learned, however many there are. Prediction reads all rows.

Defined results: a null text, or one without letters, is ``und`` with score 0;
equal texts get equal results; a row without label isn't learned from, one
without id is; without any labelled row everything is ``und``; an empty table
gives no rows. The label, source and id are never inputs of a prediction.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadlake.llm.common import column, folder, map_arrow, packed, small, stored

ORDERS = 3
#: Distinct labelled texts and landmarks of each language.
SAMPLE, LANDMARKS = 300, 64
#: Keys of the sample that are broadcast: up to so many rows.
BROADCAST_SAMPLE = 200_000
#: Samples of a language that are expected among the texts which are ranked.
SPARE = 4
#: Bytes of the sample's n-grams, and of the landmarks' matrix, that the driver takes.
FITTED_BYTES = 1 << 30
RIDGE = 1e-3
UNKNOWN = "und"
#: Characters of a text that are looked at together, and rows in a matrix product.
PIECE, ROWS = 1 << 20, 256
#: Documents whose score is below are rejected by ``known_language``.
LEAST_SCORE = 0.4


def ngrams(text: str, orders: int = ORDERS) -> np.ndarray:
    """Sorted distinct n-grams of a whole text in lower case: code points packed into 63 bits."""
    found: list[np.ndarray] = []
    text = text.lower()
    for begin in range(0, max(1, len(text)), PIECE):
        points = np.frombuffer(text[begin : begin + PIECE + orders - 1].encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64) + 1
        code = np.zeros(len(points) + 1, np.int64)
        for order in range(1, orders + 1):
            if len(points) < order:
                break
            code = (code[: len(points) - order + 1] << 21) | points[order - 1 :]
            found.append(np.unique(code))
    return np.unique(np.concatenate(found)) if len(found) > 1 else found[0] if found else np.empty(0, np.int64)


class Model:
    """n-grams in ascending order and their weights for each language."""

    def __init__(self, languages: list[str], grams: np.ndarray, weights: np.ndarray):
        self.languages, self.grams, self.weights = languages, grams, weights

    def scores(self, sets: list[np.ndarray]) -> np.ndarray:
        """Decision values (texts by languages) of n-gram sets: presence matrix times weights."""
        sizes = np.array([len(s) for s in sets])
        every = np.concatenate(sets)
        place = np.searchsorted(self.grams, every)
        place[place == len(self.grams)] = 0
        known = self.grams[place] == every
        row = np.repeat(np.arange(len(sets)), sizes)[known]
        # The product of the 0/1 matrix, given by its places, with the weights.
        out = np.stack([np.bincount(row, w[place[known]], len(sets)) for w in self.weights.T], axis=1)
        return out / np.sqrt(np.maximum(sizes, 1))[:, None]


def fit(sets: list[np.ndarray], labels: list[str], landmarks: list[int], ridge: float = RIDGE) -> Model:
    """One-versus-rest kernel ridge regression on Nyström features of a sample."""
    languages = sorted(set(labels))
    grams = np.unique(np.concatenate([sets[i] for i in landmarks]))
    if 4 * len(landmarks) * len(grams) > FITTED_BYTES:
        raise ValueError(f"{len(landmarks)} landmarks with {len(grams)} n-grams don't fit {FITTED_BYTES} bytes: lower landmarks")
    presence = np.zeros((len(landmarks), len(grams)), np.float32)
    for row, i in enumerate(landmarks):
        presence[row, np.searchsorted(grams, sets[i])] = 1 / np.sqrt(max(1, len(sets[i])))
    kernel = np.zeros((len(sets), len(landmarks)))
    for row, own in enumerate(sets):
        place = np.searchsorted(grams, own)
        place[place == len(grams)] = 0
        kernel[row] = presence[:, place[grams[place] == own]].sum(axis=1) / np.sqrt(max(1, len(own)))
    values, vectors = np.linalg.eigh(kernel[landmarks])
    keep = values > 1e-9 * values.max()
    nystroem = vectors[:, keep] / np.sqrt(values[keep])
    features = kernel @ nystroem
    wanted = np.array([[1.0 if label == lang else -1.0 for lang in languages] for label in labels])
    # Every language counts alike in every regression, however many rows it has.
    rows = Counter(labels)
    share = np.array([1 / rows[label] for label in labels])[:, None]
    weights = np.linalg.solve(features.T @ (share * features) + ridge * np.eye(features.shape[1]), features.T @ (share * wanted))
    return Model(languages, grams, presence.T.astype(np.float64) @ (nystroem @ weights))


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _sets(batches):
    import pyarrow as pa

    for batch in batches:
        sets = [ngrams(text.as_py()).tobytes() for text in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.binary())], names=["lang", "rank", "grams"])


def learn(labelled: DataFrame, *, sample: int = SAMPLE, landmarks: int = LANDMARKS) -> Model | None:
    """A model of rows (text, lang); None without rows."""
    rows = labelled.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    keys = F.xxhash64("text").alias("hash"), F.xxhash64(F.lit("text"), "text").alias("hash2")
    # Distinct texts are ranked by 128 bits alone; only the texts of the sample are fetched, one row of each. Of a
    # language with many texts only those below a hash are ranked: some SPARE samples of them, by its estimated count.
    hashed = rows.select("lang", *keys)
    counts = hashed.groupBy("lang").agg(F.approx_count_distinct("hash", 0.02).alias("n"))
    counts = small(stored(counts, f"{folder(labelled.sparkSession, None)}/languages"), BROADCAST_SAMPLE)
    share = SPARE * sample / F.col("n")
    near = (F.col("n") <= 2 * SPARE * sample) | (F.col("hash") / F.lit(2.0**64) + 0.5 < share)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("hash", "hash2"))
    least = hashed.join(counts, "lang").filter(near).select("lang", "hash", "hash2").distinct().withColumn("rank", rank).filter(F.col("rank") <= sample)
    least = small(stored(least, f"{folder(labelled.sparkSession, None)}/sample"), BROADCAST_SAMPLE)
    copy = F.row_number().over(Window.partitionBy("lang", "rank").orderBy("hash"))
    chosen = (
        rows.select("lang", "text", *keys).join(least, ["lang", "hash", "hash2"])
        .withColumn("copy", copy).filter(F.col("copy") == 1).select("lang", "rank", "text")
    )
    held = stored(map_arrow(chosen, _sets, "lang string, rank int, grams binary"), f"{folder(labelled.sparkSession, None)}/sets")
    size = held.agg(F.sum(F.octet_length("grams"))).first()[0] or 0
    if size > FITTED_BYTES:
        raise ValueError(f"the sample has {size} bytes of n-grams, above {FITTED_BYTES}: lower sample or landmarks, or cut the labelled texts")
    got = sorted((r["lang"], r["rank"], r["grams"]) for r in held.collect())
    if not got:
        return None
    sets = [np.frombuffer(g, np.int64) for _, _, g in got]
    return fit(sets, [lang for lang, _, _ in got], [i for i, (_, rank, _) in enumerate(got) if rank <= landmarks])


def _predict(broadcast):
    def predict(batches):
        import pyarrow as pa
        import regex

        model, letter = broadcast.value, regex.compile(r"\p{L}")
        for batch in batches:
            n = batch.num_rows
            languages, scores = [UNKNOWN] * n, [0.0] * n
            texts = ((i, t.as_py()) for i, t in enumerate(batch.column(1)))
            waiting = []

            def flush():
                if waiting:
                    found = model.scores([s for _, s in waiting])
                    for (i, _), best, value in zip(waiting, found.argmax(axis=1), found.max(axis=1), strict=True):
                        languages[i], scores[i] = model.languages[best], float(min(1.0, max(0.0, (value + 1) / 2)))
                    waiting.clear()

            for i, text in texts:
                if model is not None and text and letter.search(text):
                    waiting.append((i, ngrams(text)))
                    if len(waiting) == ROWS:
                        flush()
            flush()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(languages, pa.string()), pa.array(scores, pa.float64())], names=["row", "lang_pred", "score"])

    return predict


def predict(rows: DataFrame, model: Model | None) -> DataFrame:
    """(row, text) to (row, lang_pred, score)."""
    out = T.StructType([rows.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return map_arrow(rows, _predict(rows.sparkSession.sparkContext.broadcast(model)), out)


def identify(
    docs: DataFrame, *, sample: int = SAMPLE, landmarks: int = LANDMARKS,
    id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score. Held-out rows are not learned from."""
    doc_id, text = column(docs, id_column, "long"), column(docs, text_column, "string")
    labelled = docs.filter(~held_out(doc_id)).select(text.alias("text"), column(docs, lang_column, "string").alias("lang"))
    model = learn(labelled, sample=sample, landmarks=landmarks)
    row = F.struct(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"))
    found = predict(docs.select(row.alias("row"), text.alias("text")), model)
    return found.select("row.doc_id", "row.held_out", "lang_pred", "score")


def known_language(
    docs: DataFrame, *, least_score: float = LEAST_SCORE, sample: int = SAMPLE, landmarks: int = LANDMARKS,
    id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang",
) -> DataFrame:
    """The columns of ``docs`` without the documents of no or no certain language."""
    doc_id, text = column(docs, id_column, "long"), column(docs, text_column, "string")
    labelled = docs.filter(~held_out(doc_id)).select(text.alias("text"), column(docs, lang_column, "string").alias("lang"))
    model = learn(labelled, sample=sample, landmarks=landmarks)
    found = predict(packed(docs, "row").withColumn("text", F.col(f"row.`{text_column}`").cast("string")), model)
    return found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least_score)).select("row.*")
