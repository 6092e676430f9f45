"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

N-grams of lower-cased text (runs of anything but letters are one space each character) hash to BUCKETS features.
Document frequencies cover every training document; the classifier is trained by FTRL-proximal with
elastic net on a bounded, stratified sample (SAMPLE rows of each language, those of the least hashes of id and text), and a
temperature fitted on a held-out fifth of that sample calibrates its scores. The model holds BUCKETS weights for each language.

Cases: a null text, or one without a letter, is ``und`` with score 0; texts are read whole, however
long; equal texts get equal results; repeated rows and rows of one id are drawn like others, SAMPLE of a language at most; rows with a null
lang or text are not learned from; a table without any labelled row predicts ``und``, one without a labelled letter the most frequent lang;
other columns are kept or ignored, whatever their names.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_of, give_back, giving_back, small_batches

BITS = 16
BUCKETS = 1 << BITS
ORDERS = (1, 2, 3, 4)
#: Training rows of each language.
SAMPLE = 700
#: Rows that are ranked for each sampled one: so one task ranks SPARE * SAMPLE rows of a language, however many it has.
SPARE = 8
EPOCHS, ALPHA, BETA, L1, L2 = 3, 0.5, 1.0, 1e-4, 1e-4
#: TF-IDF values are shares of a document; this brings them to the order of one.
SCALE = 10.0
#: Code points handled at once.
SLICE = 1 << 18
UND = "und"


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() if not 0xD800 <= c < 0xE000 else False for c in range(0x110000)), bool, 0x110000)


def codes_of(text: str) -> tuple[np.ndarray, bool]:
    """Code points with non-letters as spaces and a space at both ends, and whether there is a letter."""
    raw = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[raw]
    return np.where(letter, raw, np.uint32(32)), bool(letter.any())


def buckets(codes: np.ndarray) -> Iterator[np.ndarray]:
    """Feature numbers of all n-grams, order by order."""
    wide = codes.astype(np.uint64)
    h = wide
    for n in ORDERS:
        if n > 1:
            h = h[:-1] * np.uint64(0x9E3779B1) + wide[n - 1 :]
        yield ((h + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)).astype(np.int64)


def total(length: int) -> int:
    return sum(max(0, length - n + 1) for n in ORDERS)


def counts(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of one document and their counts."""
    ids, n = np.unique(np.concatenate(list(buckets(codes))), return_counts=True)
    return ids, n


def scores(codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sum over all n-grams of their feature's weights, as a share of the n-grams."""
    out = np.zeros(weights.shape[1])
    for at in range(0, len(codes), SLICE):
        for n, ids in zip(ORDERS, buckets(codes[at : at + SLICE + max(ORDERS) - 1]), strict=True):
            out += weights[ids[: max(0, min(SLICE, len(codes) - n + 1 - at))]].sum(axis=0, dtype=np.float64)
    return out / total(len(codes))


def document_frequencies(training: DataFrame) -> np.ndarray:
    """For each feature, the training documents that have it. What arrives here has BUCKETS rows at most."""

    @giving_back
    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        seen, held = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int8)
        for b in batches:
            for text in b.column("text").to_pylist():
                codes, _ = codes_of(text)
                for at in range(0, len(codes), SLICE):
                    for ids in buckets(codes[at : at + SLICE + max(ORDERS) - 1]):
                        held[ids] = 1
                seen += held
                held[:] = 0
        at = np.flatnonzero(seen)
        yield pa.record_batch([pa.array(at), pa.array(seen[at])], ["feature", "df"])

    df = np.zeros(BUCKETS, np.int64)
    for r in training.select("text").mapInArrow(count, "feature long, df long").groupBy("feature").agg(F.sum("df").alias("df")).collect():
        df[r["feature"]] = r["df"]
    return df


def ftrl(examples: list[tuple[np.ndarray, np.ndarray, int]], classes: int) -> np.ndarray:
    """Softmax regression by FTRL-proximal with L1 and L2 penalties; examples are (features, values, class)."""
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))

    def current(ids):
        zi = z[ids]
        return np.where(np.abs(zi) <= L1, 0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[ids])) / ALPHA + L2))

    order = np.random.RandomState(11)
    for _ in range(EPOCHS):
        for k in order.permutation(len(examples)):
            ids, x, y = examples[k]
            w = current(ids)
            logit = x @ w
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p[None, :]
            sigma = (np.sqrt(n[ids] + g * g) - np.sqrt(n[ids])) / ALPHA
            z[ids] += g - sigma * w
            n[ids] += g * g
    return current(np.arange(BUCKETS + 1))


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of the least mean negative log likelihood on held-out rows."""
    if not len(y):
        return 1.0

    def loss(t):
        s = logits / t
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]).mean())

    return float(min(np.exp(np.linspace(np.log(0.2), np.log(5), 65)), key=loss))


class Model:
    """Languages, weights by feature (IDF and scale folded in), intercepts, temperature."""

    def __init__(self, languages: list[str], weights: np.ndarray, bias: np.ndarray, heat: float):
        self.languages, self.weights, self.bias, self.heat = languages, weights, bias, heat

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages:
            return UND, 0.0
        codes, any_letter = codes_of(text)
        if not any_letter:
            return UND, 0.0
        logit = (scores(codes, self.weights) + self.bias) / self.heat
        p = np.exp(logit - logit.max())
        k = int(p.argmax())
        return self.languages[k], float(p[k] / p.sum())


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5) -> Model:
    """Learn from the text and lang of documents outside fold 0 of crc32(id as text)."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").alias("lang"), crc_of(f"`{id_col}`").alias("crc"))
    training = rows.where((F.col("crc") % folds != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in training.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0)
    df = document_frequencies(training)
    idf = (np.log((1 + sum(sizes.values())) / (1 + df)) + 1) * SCALE
    # a stable draw: the rows of the least hashes; equal rows share one, so places settle the last of them
    drawn = training.withColumn("draw", F.xxhash64(F.lit("sample"), "crc", "text"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw"))

    def least(rows: DataFrame) -> dict:
        """SAMPLE rows of each language at most: how many, and the greatest of their hashes."""
        held = rows.select("lang", "draw").withColumn("place", place).where(F.col("place") <= SAMPLE)
        return {r["lang"]: (r["n"], r["last"]) for r in held.groupBy("lang").agg(F.count("*").alias("n"), F.max("draw").alias("last")).collect()}

    def of_lang(values: dict) -> Column:
        return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))[F.col("lang")]

    # a hash below this holds more than enough rows of a language, unless very many are equal: then all its rows are ranked
    low = {x: min(2**63 - 1, -(2**63) + 2**64 * SPARE * SAMPLE // n) for x, n in sizes.items()}
    found = least(drawn.where(F.col("draw") <= of_lang(low)))
    rare = [x for x, n in sizes.items() if found.get(x, (0, 0))[0] < min(n, SAMPLE)]
    if rare:
        found |= least(drawn.where(F.col("lang").isin(rare)))
    last = of_lang({x: greatest for x, (_, greatest) in found.items()})
    sample = drawn.where(F.col("draw") <= last).withColumn("place", place).where(F.col("place") <= SAMPLE).select("text", "lang", "draw").repartition(1)

    def fit(batches: Iterator) -> Iterator:
        import pyarrow as pa

        learn, hold = [], []
        for b in batches:
            for text, lang, draw in zip(*(b.column(c).to_pylist() for c in ("text", "lang", "draw")), strict=True):
                codes, any_letter = codes_of(text)
                if any_letter:
                    ids, n = counts(codes)
                    (hold if draw % folds == 0 else learn).append((draw, (np.append(ids, BUCKETS), np.append(n / total(len(codes)) * idf[ids], 1.0), languages.index(lang))))
        # a language all of whose rows were held out is learned from them
        known = {y for _, (_, _, y) in learn}
        learn, hold = learn + [e for e in hold if e[1][2] not in known], [e for e in hold if e[1][2] in known]
        learn.sort(key=lambda e: (e[0], e[1][2], len(e[1][0])))
        w = ftrl([e for _, e in learn], len(languages))
        if not learn:
            w[-1] = np.log([sizes[x] for x in languages])
        heat = temperature(np.array([x @ w[ids] for _, (ids, x, _) in hold]).reshape(len(hold), len(languages)), np.array([y for _, (_, _, y) in hold], int))
        out = io.BytesIO()
        np.savez_compressed(out, weights=(w[:-1] * idf[:, None]).astype(np.float32), bias=w[-1], heat=heat)
        yield pa.record_batch([pa.array([out.getvalue()], pa.binary())], ["model"])

    got = np.load(io.BytesIO(sample.mapInArrow(fit, "model binary").first()["model"]))
    return Model(languages, got["weights"], got["bias"], float(got["heat"]))


def prediction(text: Column, model: Model) -> Column:
    """struct<lang, score> of a text column."""

    @F.arrow_udf("struct<lang:string,score:double>")
    def predict(col):
        import pyarrow as pa

        got = [model.predict(t.as_py()) for t in col]
        give_back()
        return pa.StructArray.from_arrays([pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], ["lang", "score"])

    return predict(text)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", folds: int = 5) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), (crc_of(f"`{id_col}`") % folds == 0).alias("held_out"), prediction(F.col(f"`{text_col}`").cast("string"), model).alias("got"))
    return rows.select("doc_id", "held_out", F.col("got.lang").alias("lang_pred"), F.col("got.score").alias("score"))


#: Documents predicted with less than this score are rejected by the pipeline's stage.
MIN_SCORE = 0.3


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The documents whose language is known well enough, with all their columns."""
    small_batches(docs.sparkSession)
    name = "__langid"
    got = docs.withColumn(name, prediction(F.col(f"`{text_col}`").cast("string"), model))
    return got.where((F.col(f"{name}.lang") != UND) & (F.col(f"{name}.score") >= MIN_SCORE)).drop(name)
