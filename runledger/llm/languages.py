"""Language identification: multinomial logistic regression on TF-IDF of character n-grams, fitted with FTRL-proximal.

A text is lower-cased, runs of characters that are not letters become one space, and its n-grams of one to three
characters are hashed into `BUCKETS` counts. A weight is (1 + log count) times the inverse document frequency, scaled
to length 1 a text. Document frequencies are counted over all documents that may be learned from. The regression is
fitted on a bounded sample of them by follow-the-regularised-leader with elastic-net penalties, which keeps most
weights at exactly zero; a temperature fitted on sampled documents left out of that makes scores calibrated.
"""

from __future__ import annotations

import functools
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runledger.llm.arrow import prepare
from runledger.llm.learn import held_out

FOLDS, FOLD = 5, 0
BUCKETS = 1 << 16
CHARS = 1 << 18  # characters looked at together
UNKNOWN = "und"


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def plain(text: str) -> np.ndarray:
    """Code points of the lower-cased text, a space before, after and for each run of what is not a letter; empty without letters."""
    out = []
    for k in range(0, len(text), CHARS):  # lower() of a part is that of the whole but for a final sigma
        points = np.frombuffer(text[k: k + CHARS].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        out.append(np.where(_letters()[points], points, 32).astype(np.uint32))
    points = np.concatenate([[32], *out, [32]]).astype(np.uint32)
    keep = np.concatenate([[True], (points[1:] != 32) | (points[:-1] != 32)])
    points = points[keep]
    return points if len(points) > 2 or (len(points) == 2 and points[0] != 32) else points[:0]


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the text's n-grams, going up, and how often each occurs. Nothing for null and texts without letters."""
    points = plain(text) if text else np.zeros(0, np.uint32)
    if len(points) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found = None
    for k in range(0, len(points), CHARS):
        part = points[k: k + CHARS + 2]
        one = part * np.uint32(0x9E3779B1)
        one ^= one >> np.uint32(15)
        two = (one[:-1] * np.uint32(0x85EBCA6B) + one[1:]) * np.uint32(0xC2B2AE35)
        three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * np.uint32(0x27D4EB2F) + one[2:] * np.uint32(0x165667B1)
        # an n-gram belongs to the part it starts in
        keys = np.concatenate([one[:CHARS] * np.uint32(0x2545F491), two[:CHARS], three[:CHARS]])
        keys = (keys ^ (keys >> np.uint32(16))) & np.uint32(BUCKETS - 1)
        if len(points) <= min(2000, CHARS):
            return np.unique(keys, return_counts=True)
        counts = np.bincount(keys, minlength=BUCKETS)
        found = counts if found is None else found + counts
    where = np.flatnonzero(found)
    return where, found[where]


def weights(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    w = (1 + np.log(counts)) * idf
    return (w / np.sqrt(w @ w)).astype(np.float32)


class Model:
    """`langs`, inverse document frequencies, weights by bucket and language, a constant per language and the temperature."""

    def __init__(self, langs: list[str], idf: np.ndarray):
        self.langs, self.idf = langs, idf.astype(np.float32)
        self.w, self.level, self.temperature = np.zeros((len(idf), len(langs)), np.float32), np.zeros(len(langs)), 1.0

    def logits(self, where: np.ndarray, values: np.ndarray) -> np.ndarray:
        return values @ self.w[where] + self.level

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int, rate: float, l1: float, l2: float, seed: int = 3) -> None:
        """FTRL-proximal over `rows` (buckets, weights, language), in another order each epoch."""
        z, n = np.zeros(self.w.shape), np.zeros(self.w.shape)
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            for k in rng.permutation(len(rows)):
                where, values, label = rows[k]
                zi, ni = z[where], n[where]
                w = np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((1 + np.sqrt(ni)) / rate + l2))
                p = softmax(values @ w)
                p[label] -= 1
                g = values[:, None] * p
                grown = ni + g * g
                z[where] = zi + g - (np.sqrt(grown) - np.sqrt(ni)) / rate * w
                n[where] = grown
        self.w = np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((1 + np.sqrt(n)) / rate + l2)).astype(np.float32)

    def calibrate(self, rows: list[tuple[np.ndarray, np.ndarray, int]], count: np.ndarray) -> None:
        """The temperature of the least log loss over `rows`, a row of language k counting `count[k]`; by golden section.

        A row counts as wrong with a chance of one in the number of rows, else a sample without errors would make scores 1.
        """
        if not rows or len(self.langs) < 2:
            return
        logits = np.stack([self.logits(where, values) for where, values, _ in rows])
        y, doubt = np.array([label for _, _, label in rows]), 1 / (len(rows) + 2)
        target = np.full(logits.shape, doubt / (logits.shape[1] - 1))
        target[np.arange(len(y)), y] = 1 - doubt

        def loss(log_t: float) -> float:
            x = logits / np.exp(log_t)
            top = x.max(1)
            return float((count[y] * (top + np.log(np.exp(x - top[:, None]).sum(1)) - (x * target).sum(1))).sum())

        low, high, step = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
        for _ in range(60):
            a, b = high - step * (high - low), low + step * (high - low)
            low, high = (low, b) if loss(a) <= loss(b) else (a, high)
        self.temperature = float(np.exp((low + high) / 2))

    def __call__(self, text: str | None) -> tuple[str, float]:
        where, counts = grams(text)
        if len(where) == 0 or not self.langs:
            return UNKNOWN, 0.0
        p = softmax(self.logits(where, weights(counts, self.idf[where])) / self.temperature)
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def document_frequencies(docs: DataFrame, text_col: str) -> tuple[int, np.ndarray]:
    """How many texts have letters, and in how many of them each bucket occurs. A row per task and bucket is shuffled."""

    def count(batches):
        df, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                where, _ = grams(text.as_py())
                df[where] += 1
                n += len(where) > 0
        there = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(there, BUCKETS)), pa.array(np.append(df[there], n))], names=["bucket", "n"])

    rows = docs.select(text_col).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # BUCKETS + 1 at most
    df = np.zeros(BUCKETS + 1, np.int64)
    for r in rows:
        df[r["bucket"]] = r["n"]
    return int(df[BUCKETS]), df[:BUCKETS]


def train(docs: DataFrame, most: int = 4000, epochs: int = 4, rate: float = 2.0, l1: float = 0.02, l2: float = 0.5, folds: int = FOLDS, fold: int = FOLD,
          id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model of the languages of all documents that are not held out.

    About `most` of their texts (in expectation; each language the same number, or all it has) are fitted on: those with the smallest id hashes. One
    task holds their n-gram counts and trains, the driver gets the weights. A fifth of the sample
    sets the temperature. Constants are shifted to how common the languages are among all that may be learned from.
    """
    known = docs.where(F.col(lang_col).isNotNull() & ~held_out(F.col(id_col), folds, fold)).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    everyone = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # one row a language
    langs = sorted(everyone)
    n, df = document_frequencies(known, "text") if langs else (0, np.zeros(BUCKETS))
    model = Model(langs, np.log((1 + n) / (1 + df)) + 1)
    if not langs:
        return model
    share = np.array([min(1.0, most / len(langs) / everyone[lang]) for lang in langs])
    place = F.pmod(F.xxhash64(F.lit(17), F.coalesce(F.col("id").cast("string"), F.lit(""))), F.lit(1 << 40)) / float(1 << 40)
    rates = known.sparkSession.createDataFrame(list(zip(langs, range(len(langs)), share.tolist(), strict=True)), "l string, label int, share double")
    some = known.join(F.broadcast(rates), F.col("lang") == F.col("l")).where(place < F.col("share")).select("id", "text", "label")

    def counted(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                found = [grams(t.as_py()) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.string()), part.column(2), pa.array([w for w, _ in found], pa.list_(pa.int32())), pa.array([c for _, c in found], pa.list_(pa.int32()))],
                    names=["id", "label", "buckets", "counts"])

    sample = some.mapInArrow(counted, "id string, label int, buckets array<int>, counts array<int>").repartition(1)

    def fit(batches):
        rows = []
        for batch in batches:
            for i, label, where, counts in zip(*batch.columns, strict=True):
                w = np.asarray(where.values, np.int64)
                if len(w):
                    rows.append((i.as_py() or "", w, weights(np.asarray(counts.values), model.idf[w]), label.as_py()))
        rows.sort(key=lambda r: (r[0], r[3], len(r[1]), r[1].tobytes()))
        rows = [r[1:] for r in rows]
        apart = rows[::5] if len(rows) >= 50 else []
        model.fit([r for k, r in enumerate(rows) if k % 5] if apart else rows, epochs, rate, l1, l2)
        seen = np.bincount([r[2] for r in rows], minlength=len(langs)) + 1e-9
        common = np.array([everyone[lang] for lang in langs], float)
        model.level = np.log(common / common.sum()) - np.log(seen / seen.sum())
        model.calibrate(apart, common / seen)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((model.w, model.level, model.temperature))], pa.binary())], names=["weights"])

    fitted = sample.mapInArrow(fit, "weights binary").first()
    if fitted is not None:
        model.w, model.level, model.temperature = pickle.loads(fitted["weights"])
    return model


def identify_languages(docs: DataFrame, model: Model | None = None, folds: int = FOLDS, fold: int = FOLD, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                       **settings) -> DataFrame:
    """`docs` with held_out, lang_pred and score, the calibrated probability of that language.

    Whole texts count, of any length. Null texts, empty ones and those without a letter are `und` with score 0; so is every
    text if no language is there to be learned. Ids, languages and sources of a row are not looked at for its prediction.
    A null id is the text "" when folds are drawn. Repeated rows get the same answer; an empty table gives no rows.
    Other columns pass through, those named like a result are replaced.
    """
    spark = prepare(docs.sparkSession)
    if model is None:
        model = train(docs, folds=folds, fold=fold, id_col=id_col, text_col=text_col, lang_col=lang_col, **settings)
    shared = spark.sparkContext.broadcast(model)  # BUCKETS weights a language
    kept = [f for f in docs.schema.fields if f.name not in ("held_out", "lang_pred", "score")]
    schema = T.StructType([*kept, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    at = [f.name for f in kept].index(text_col)

    def run(batches):
        model = shared.value
        for batch in batches:
            found = [model(t.as_py()) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([lang for lang, _ in found], pa.string()), pa.array([score for _, score in found], pa.float64())], names=schema.names)

    return docs.select(*[F.col(f.name) for f in kept]).mapInArrow(run, schema).withColumn("held_out", held_out(F.col(id_col), folds, fold))
