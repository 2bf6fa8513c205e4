"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text is the average of the embeddings of its byte n-grams, hashed into ``BUCKETS``
rows; A-Z are lower-cased, and runs of other ASCII bytes are one blank, so words keep
their edges.  Embeddings and softmax are trained by stochastic gradient descent in
numpy on the driver, from at most ``SAMPLE_ROWS`` labelled rows, dealt evenly over the
languages; of a longer text the first ``SAMPLE_CHARS`` characters teach.  Rows are drawn
by document and text with a hard limit for each language, so copies of one text aren't
drawn together and can't exceed the sample.  Each row is seen whole and as a short cutting,
so short texts are known too.  Predictions read whole texts.

A fifth of the sample is kept back for the temperature of the scores.  The score below
which a text is rejected is calibrated on ``CALIBRATION_ROWS`` other labelled rows, whole,
which Spark scores: at most ``REJECTED`` of those told rightly fall below it.

A text that is null or has no letter is ``und`` with score 0 and is rejected.  With
no labelled row at all every text is ``und``.  Languages that are null teach nothing.
Repeated rows are judged alike; ties of languages go to the first by name.  Columns named
like the results are replaced, all others kept.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.llm import _common as c

BUCKETS = 1 << 14
DIM = 16
GRAMS = (2, 3, 4)
SAMPLE_ROWS = 2400
SAMPLE_CHARS = 100_000
CALIBRATION_ROWS = 10_000
EPOCHS = 8
REJECTED = 0.001
UNKNOWN = "und"

_LETTER = np.arange(256, dtype=np.uint8)
_LETTER[65:91] += 32
_LETTER[:65] = _LETTER[91:97] = _LETTER[123:128] = 32


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # (BUCKETS, languages): embedding times softmax weights
    bias: np.ndarray
    temperature: float
    threshold: float

    def scores(self, counts: np.ndarray) -> np.ndarray:
        z = (counts @ self.table) / max(counts.sum(), 1.0) + self.bias
        return softmax(z[None] / self.temperature)[0]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def gram_counts(b: np.ndarray) -> np.ndarray:
    """How often each bucket is hit by an n-gram of the text."""
    b = _LETTER[b]
    blank = b == 32
    twice = np.zeros(len(b), bool)
    twice[1:] = blank[1:] & blank[:-1]
    x = b[~twice].astype(np.uint32)
    hits, h = [], x
    for n in range(2, max(GRAMS) + 1):
        if len(x) < n:
            break
        h = h[: len(x) - n + 1] * np.uint32(0x01000193) ^ x[n - 1 :]
        if n in GRAMS:
            hits.append(h * np.uint32(0x9E3779B1) >> np.uint32(33 - BUCKETS.bit_length()))
    return np.bincount(np.concatenate(hits).astype(np.intp), minlength=BUCKETS) if hits else np.zeros(BUCKETS, np.intp)


def train(texts: list[bytes], labels: list[str], seed: int = 11, epochs: int = EPOCHS, rejected: float = REJECTED) -> LanguageModel:
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    n = len(languages)
    if not n:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32), 1.0, 1.0)
    y0 = np.array([languages.index(x) for x in labels])
    rows, y = [], []
    for t, k in zip(texts, y0.tolist()):
        b = np.frombuffer(t, np.uint8)
        at = rng.integers(0, max(1, len(b) - 20))
        for part in (b, b[at : at + int(rng.integers(20, 120))]):
            counts = gram_counts(part)
            if counts.any():
                hit = np.flatnonzero(counts)
                rows.append((hit, counts[hit] / counts.sum()))
                y.append(k)
    y = np.array(y)
    order = rng.permutation(len(y))
    back = set(order[: len(y) // 5].tolist()) if len(y) >= 50 else set()
    fit = np.array([i for i in order.tolist() if i not in back])
    E = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    W = rng.normal(0, 0.1, (DIM, n)).astype(np.float32)
    bias = np.zeros(n, np.float32)
    size = 64
    steps = epochs * -(-len(fit) // size)
    step = 0
    for _ in range(epochs):
        fit = rng.permutation(fit)
        for i in range(0, len(fit), size):
            part = fit[i : i + size]
            rate = 1 - step / steps
            step += 1
            used, at = np.unique(np.concatenate([rows[k][0] for k in part]), return_inverse=True)
            X = np.zeros((len(part), len(used)), np.float32)
            X[np.repeat(np.arange(len(part)), [len(rows[k][0]) for k in part]), at] = np.concatenate([rows[k][1] for k in part])
            H = X @ E[used]
            d = softmax(H @ W + bias)
            d[np.arange(len(part)), y[part]] -= 1
            d /= len(part)
            gW, gH = H.T @ d, d @ W.T
            W -= np.float32(2.0 * rate) * gW
            bias -= np.float32(0.2 * rate) * d.sum(0)
            E[used] -= np.float32(200.0 * rate) * (X.T @ gH)
    model = LanguageModel(languages, E @ W, bias, 1.0, 0.0)
    held = np.array(sorted(back), np.int64) if back else fit
    z = np.stack([(model.table[rows[k][0]] * rows[k][1][:, None]).sum(0) + bias for k in held])
    heats = np.geomspace(0.05, 5, 40)
    loss = [-np.log(np.maximum(softmax(z / t)[np.arange(len(held)), y[held]], 1e-12)).mean() for t in heats]
    model.temperature = float(heats[int(np.argmin(loss))])
    p = softmax(z / model.temperature)
    right = np.sort(p.max(1)[p.argmax(1) == y[held]])
    model.threshold = float(right[int(rejected * len(right))]) if len(right) else 1.0
    return model


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, calibration_rows: int = CALIBRATION_ROWS) -> LanguageModel:
    """A model from rows (text, lang) and, if there is one, doc_id; at most ``sample_rows`` of them come to the driver."""
    df = labelled.filter(F.col("lang").isNotNull() & has_letter(F.col("text")))
    counts = {r.lang: r["count"] for r in df.groupBy("lang").count().collect()}
    if not counts:
        return train([], [])
    drawn = F.xxhash64(*(F.col(x) for x in ("doc_id", "text") if x in labelled.columns))
    df = df.select("lang", "text", F.pmod(drawn, F.lit(1 << 30)).alias("drawn"))
    most = max(1, sample_rows // len(counts))
    upto = {lang: math.ceil(min(1.0, 1.2 * most / n) * (1 << 30)) for lang, n in counts.items()}
    limit = F.element_at(F.create_map(*(F.lit(x) for pair in upto.items() for x in pair)), F.col("lang"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("drawn", "text"))
    text = F.substring("text", 1, SAMPLE_CHARS).cast("binary").alias("text")
    sample = df.filter(F.col("drawn") < limit).select("lang", "drawn", text).withColumn("place", first).filter(F.col("place") <= most)
    rows = sorted(((r.lang, bytes(r.text)) for r in sample.select("lang", "text").collect()))
    model = train([t for _, t in rows], [lang for lang, _ in rows])
    # Those drawn for training are the lowest; calibration takes what lies above.
    share = math.ceil(min(1.0, calibration_rows / sum(counts.values())) * (1 << 30))
    others = df.filter((F.col("drawn") >= limit) & (F.col("drawn") < limit + share)).select("lang", "text")
    right = c.stored(identified(others, model).filter(F.col("lang") == F.col("lang_pred")).select("score"))
    told = right.count()
    if told >= 1 / REJECTED:
        lowest = right.orderBy("score").limit(int(REJECTED * told) + 1).collect()
        model.threshold = lowest[-1].score
    return model


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike("\\p{L}"), F.lit(False))


def identified(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` with lang_pred, score and rejected."""
    docs = docs.drop("lang_pred", "score", "rejected")
    body_name = c.free_name(docs, "body")
    df = docs.withColumn(body_name, F.when(has_letter(F.col("text")), F.col("text").cast("binary")))
    keep = docs.columns

    def predict(batches):
        import pyarrow as pa

        for batch in batches:
            best, score, out = [], [], []
            body = batch.column(body_name)
            for known, b in zip(body.is_valid().to_pylist(), c.binary_rows(body)):
                p = model.scores(gram_counts(b)) if known and model.languages else np.zeros(0)
                k = int(p.argmax()) if len(p) else -1
                best.append(model.languages[k] if k >= 0 else UNKNOWN)
                score.append(min(1.0, float(p[k])) if k >= 0 else 0.0)
                out.append(k < 0 or score[-1] < model.threshold)
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in keep), pa.array(best, pa.string()), pa.array(score, pa.float64()), pa.array(out, pa.bool_())], [*keep, "lang_pred", "score", "rejected"])

    from pyspark.sql import types as T

    more = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    return df.mapInArrow(c.released(predict), T.StructType([*docs.schema.fields, *more]))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = c.read_table(spark, sf_dir, "documents")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    model = fit(docs.filter(fold != 2).select("doc_id", "text", "lang"))
    held = F.coalesce(fold == 2, F.lit(False))
    return identified(docs.select("doc_id", held.alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score", "rejected")
