"""Language identification: averaged hashed subword embeddings under a linear softmax, trained by stochastic gradient descent."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._util import chunks, flat, small_batches, tidy, unused

#: Subwords are runs of so many UTF-8 bytes of the lower-cased text; everything but letters counts as a space.
ORDERS = (2, 3, 4)
#: Bytes whose subwords are looked up at a time, however long a text is.
PIECE = 1 << 17
#: The prediction for a text that is null or has no letter.
UNDETERMINED = "und"


def _byte_table() -> np.ndarray:
    table = np.full(256, 32, np.uint8)
    table[97:123] = np.arange(97, 123)
    table[65:91] = np.arange(97, 123)
    table[128:] = np.arange(128, 256)
    return table


_BYTES = _byte_table()


def subwords(data: np.ndarray, n: int, buckets: int) -> np.ndarray:
    """The bucket of the subword of ``n`` bytes at each position (fewer than ``len(data)`` by n - 1)."""
    data = _BYTES[data].astype(np.uint32)
    h = np.full(max(0, len(data) - n + 1), n, np.uint32)
    for i in range(n):
        h = (h ^ data[i : len(data) - n + 1 + i]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
    return (h & np.uint32(buckets - 1)).astype(np.int64)


def lower(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(column.cast(pa.large_string()))


@dataclass
class LanguageModel:
    """``table[bucket, language]`` is the product of embedding and softmax weights, which is all that a prediction needs."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    #: A prediction of a lower score is rejected.
    threshold: float = 0.0
    history: list[float] = field(default_factory=list)

    def logits(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(logits, number of subwords) of the texts that lie one after another in ``data``; PIECE bytes are looked up at a time."""
        total, count = np.zeros((len(ends) - 1, len(self.languages))), np.zeros(len(ends) - 1)
        for n in ORDERS:
            for lo in range(0, len(data) - n + 1, PIECE):
                hi = min(lo + PIECE, len(data) - n + 1)
                sums = np.zeros((hi - lo + 1, len(self.languages)))
                np.cumsum(self.table[subwords(data[lo : hi + n - 1], n, len(self.table))], axis=0, dtype=np.float64, out=sums[1:])
                first, last = np.searchsorted(ends, lo, side="right") - 1, np.searchsorted(ends, hi, side="left")
                start = np.clip(ends[first:last], lo, hi)
                to = np.clip(ends[first + 1 : last + 1] - n + 1, start, hi)
                total[first:last] += sums[to - lo] - sums[start - lo]
                count[first:last] += to - start
        return total / np.maximum(count, 1)[:, None] + self.bias, count

    def predict(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the language, calibrated probability)."""
        logits, _ = self.logits(data, ends)
        p = _softmax(logits / self.temperature)
        best = p.argmax(axis=1)
        return best, p[np.arange(len(p)), best]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(texts: list[str], labels: list[str], *, buckets: int = 1 << 16, dim: int = 16, epochs: int = 12, rate: float = 1.0, calibrate: float = 0.25, miss: float = 0.002, seed: int = 7) -> LanguageModel:
    """Train on whole texts. The share ``calibrate`` is held back to set the temperature and the rejection threshold, the
    ``miss`` quantile of the scores of its right predictions (0.5 at most)."""
    languages = sorted(set(labels))
    rng = np.random.default_rng(seed)
    if not languages:
        return LanguageModel([], np.zeros((buckets, 0), np.float32), np.zeros(0))
    rows = []
    for text in texts:
        data = flat(lower(pa.array([text])))[0]
        ids, n = np.unique(np.concatenate([subwords(data, k, buckets) for k in ORDERS if len(data) >= k] or [np.zeros(0, np.int64)]), return_counts=True)
        rows.append((ids, (n / max(1, n.sum())).astype(np.float32)))
    y = np.array([languages.index(x) for x in labels])
    order = rng.permutation(len(rows))
    held, learn = np.split(order, [int(len(order) * calibrate) if len(order) >= 40 else 0])
    emb = rng.normal(0, 1 / dim, (buckets, dim)).astype(np.float32)
    out, bias, history = np.zeros((dim, len(languages)), np.float32), np.zeros(len(languages), np.float32), []
    for epoch in range(epochs):
        step, loss = rate * (1 - epoch / epochs), 0.0
        for i in rng.permutation(learn):
            ids, w = rows[i]
            hidden = w @ emb[ids]
            g = _softmax(hidden @ out + bias)
            loss -= float(np.log(max(g[y[i]], 1e-12)))
            g[y[i]] -= 1
            back = out @ g
            out -= step * np.outer(hidden, g)
            bias -= 0.1 * step * g
            # the mean over subwords makes each one's gradient small; scaling it back keeps rare subwords learning
            emb[ids] -= (20 * step * w)[:, None] * back
        history.append(loss / max(1, len(learn)))
    model = LanguageModel(languages, (emb @ out).astype(np.float32), bias.astype(np.float64), history=history)
    if len(held):
        logits = np.array([w @ model.table[ids] for ids, w in (rows[i] for i in held)]) + bias
        nll = {t: -np.log(np.maximum(_softmax(logits / t)[np.arange(len(held)), y[held]], 1e-12)).mean() for t in np.geomspace(0.25, 8, 21)}
        model.temperature = float(min(nll, key=nll.get))
        p = _softmax(logits / model.temperature)
        if (right := p.argmax(axis=1) == y[held]).any():
            model.threshold = float(min(0.5, np.quantile(p[right].max(axis=1), miss)))
    return model


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_language: int = 700) -> LanguageModel:
    """Fit on a sample of labelled rows: about ``per_language`` of each language, chosen by a hash of the id, so that the
    driver gathers the same bounded number of texts from an input of any size. Null labels and texts teach nothing."""
    labelled = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return fit([], [])
    share = F.pmod(F.xxhash64("id", F.lit("language sample")), F.lit(1_000_000)) / 1_000_000
    limits = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, per_language / n))))
    sample = labelled.filter(share < limits[F.col("lang")]).select("id", "text", "lang").collect()
    sample.sort(key=lambda r: (str(r["id"]), r["lang"], r["text"]))
    return fit([r["text"] for r in sample], [r["lang"] for r in sample])


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, lang_score (0 to 1) and lang_rejected; columns of these names are replaced.

    A text that is null or has no letter gets ``und``, score 0, and is rejected, as is a prediction whose calibrated score
    is below the model's threshold. Whole texts count; beside a chunk of texts (the longest one at least), memory is constant. A model that saw no label predicts
    ``und`` throughout. Other columns pass through; equal rows get equal predictions; an empty table stays empty.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("lang_pred", "lang_score", "lang_rejected")
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType()), T.StructField("lang_rejected", T.BooleanType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names, (mark,) = docs.columns, unused(docs, 1)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in chunks(batches, text_col):
            letters = np.array(batch.column(mark).to_pylist(), bool)
            best, score = model.predict(*flat(lower(batch.column(text_col)))) if model.languages else (np.zeros(len(letters), int), np.zeros(len(letters)))
            known = letters & bool(model.languages)
            score = np.where(known, np.clip(score, 0, 1), 0.0)
            pred = [model.languages[k] if ok else UNDETERMINED for k, ok in zip(best, known, strict=True)]
            out = [batch.column(n) for n in names] + [pa.array(pred, pa.string()), pa.array(score), pa.array(~known | (score < model.threshold))]
            yield pa.RecordBatch.from_arrays(out, [*names, "lang_pred", "lang_score", "lang_rejected"])
        tidy()

    return docs.withColumn(mark, F.coalesce(F.col(text_col), F.lit("")).rlike(r"\p{L}")).mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    """True for the third of the ids that training never sees; a null id counts as held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(True))
