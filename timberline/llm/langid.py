"""Language identification: multinomial naive Bayes over hashed character n-grams.

The model is fitted on all labelled documents; its matrix of
log-probabilities (hash buckets x languages) is broadcast, and each batch of
texts is scored with one gather and one segmented sum.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timberline.llm.tables import slices

#: Orders of the n-grams and the number of hash buckets (the same buckets for all orders).
ORDERS = (1, 2, 3)
BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
#: Bytes of text scored at once; the arrays of its n-grams take some sixty times as much.
SLICE = 1 << 20
#: Languages whose counts a task holds before it hands them on, half a MB each.
HELD = 64
UNKNOWN = "und"
#: Letters from which on a text is judged by how likely its n-grams are, and how far below all training texts it may lie (nats an n-gram).
JUDGED_LETTERS, MARGIN = 20, 2.0


@functools.lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def grams(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams of all texts, (orders x positions), the first position of each text, letters per text.

    Texts are lower-cased; each run of other than letters becomes a space, and spaces bound each text.
    """
    letters = _letters()
    parts, counts = [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        is_letter = letters[codes]
        counts[i] = int(is_letter.sum())
        codes = np.where(is_letter, codes, 32)
        keep = is_letter.copy()
        keep[1:] |= is_letter[:-1]  # the first of the others after a letter stays as a space
        # the n-grams of a text end in spaces, its own and those that the next one begins with
        parts.append(np.concatenate(([np.uint32(32)] * 2, codes[keep], [np.uint32(32)])))
    starts = np.cumsum([0] + [len(p) for p in parts])
    codes = np.concatenate([*parts, np.full(max(ORDERS), 32, np.uint32)]).astype(np.uint64)
    n = int(starts[-1])
    rows, h = [], np.zeros(n, np.uint64)
    for k in range(max(ORDERS)):
        h = (h * np.uint64(1_000_003) + codes[k : k + n] + np.uint64(1)) & np.uint64(0xFFFFFFFF)
        if k + 1 in ORDERS:
            mixed = (h + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)
            rows.append((mixed >> np.uint64(64 - BUCKET_BITS)).astype(np.int32))
    return np.stack(rows), starts[:-1], counts


@dataclass
class LanguageModel:
    """``log_prob`` is (buckets x languages), ``log_prior`` one value a language.

    ``least`` is, by language, the lowest mean log-probability an n-gram that a training text of the language has.
    """

    languages: list
    log_prob: np.ndarray
    log_prior: np.ndarray
    least: np.ndarray | None = None

    def sums(self, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sum of the n-grams' log-probabilities in each language (texts x languages), number of n-grams and of letters of each text."""
        buckets, starts, letters = grams(texts)
        total = np.zeros((len(texts), len(self.languages)))
        for row in buckets:
            total += np.add.reduceat(self.log_prob[row], starts, axis=0, dtype=np.float64)
        return total, len(ORDERS) * np.diff(np.append(starts, buckets.shape[1])), letters

    def likelihood(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Mean log-probability of an n-gram in each language (texts x languages), and letters of each text."""
        total, n, letters = self.sums(texts)
        return total / n[:, None], letters

    def accepted(self, texts: list, min_score: float) -> list[bool]:
        """Whether a learned language explains each text: its n-grams are about as likely as those of training texts, and no other language is nearly as good."""
        if not texts:
            return []
        if not self.languages:
            return [bool(n) for n in grams(texts)[2]]
        total, n, letters = self.sums(texts)
        mean = total / n[:, None]
        langs, scores = self._best(total, letters)
        best = (mean + 0.0).argmax(axis=1)
        near = (letters < JUDGED_LETTERS) | (mean[np.arange(len(texts)), best] >= self.least[best] - MARGIN)
        return [lang != UNKNOWN and s >= min_score and bool(ok) for lang, s, ok in zip(langs, scores, near)]

    def score(self, texts: list) -> tuple[list, list]:
        """Best language and a score from 0 to 1 for each text; ``und`` and 0 without letters."""
        if not texts:
            return [], []
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        total, _, letters = self.sums(texts)
        return self._best(total, letters)

    def _best(self, total: np.ndarray, letters: np.ndarray) -> tuple[list, list]:
        total = total + self.log_prior
        # n-grams overlap, so evidence is tempered before it becomes a probability
        tempered = total * np.minimum(1.0, 60.0 / np.maximum(letters, 1))[:, None]
        tempered -= tempered.max(axis=1, keepdims=True)
        p = np.exp(tempered)
        p /= p.sum(axis=1, keepdims=True)
        best = total.argmax(axis=1)
        langs = [self.languages[b] if n else UNKNOWN for b, n in zip(best, letters)]
        scores = [float(p[i, b]) if n else 0.0 for i, (b, n) in enumerate(zip(best, letters))]
        return langs, scores


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", alpha: float = 0.5, ranges: bool = False) -> LanguageModel:
    """Fit on all rows of ``docs`` with text and language.

    Counting is a Spark job over the table as it is dealt: tasks count n-grams by (language, bucket), the
    counts are summed by key, and only that bounded table (languages x
    buckets) comes to the driver. With ``ranges`` a second job notes how unlikely
    training texts get. No labelled rows: a model without
    languages, which says ``und``.
    """
    rows = docs.select(F.col(text_col).alias("t"), F.col(lang_col).alias("l")).filter("t is not null and l is not null")

    def count(batches):
        held: dict = {}

        def told():
            for lang, sums in held.items():
                some = np.flatnonzero(sums)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(sums[some])],
                    names=["lang", "bucket", "n"],
                )
            held.clear()

        for batch in batches:
            for piece, texts in slices(batch, 0, SLICE):
                names, which = np.unique(np.array(piece.column(1).to_pylist(), object), return_inverse=True)
                buckets, starts, _ = grams(texts)
                of = np.repeat(which, np.diff(np.append(starts, buckets.shape[1])))
                for k, lang in enumerate(names):
                    sums = held.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
                    sums[:BUCKETS] += np.bincount(buckets[:, of == k].ravel(), minlength=BUCKETS)
                    sums[BUCKETS] += int((which == k).sum())  # documents
                    if len(held) >= HELD:
                        yield from told()
        yield from told()

    counted = rows.mapInArrow(count, "lang string, bucket int, n bigint")
    got = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(got.column("lang").to_pylist()))
    sums = np.zeros((BUCKETS + 1, len(languages)))
    at = {lang: k for k, lang in enumerate(languages)}
    which = np.array([at[x] for x in got.column("lang").to_pylist()], dtype=np.int64)
    sums[got.column("bucket").to_numpy(), which] = got.column("n").to_numpy()
    seen = sums[:BUCKETS] + alpha
    log_prob = np.log(seen / seen.sum(axis=0)).astype(np.float32) if languages else np.zeros((BUCKETS, 0), np.float32)
    n_docs = sums[BUCKETS]
    log_prior = np.log((n_docs + 1) / (n_docs + 1).sum()) if languages else np.zeros(0)
    model = LanguageModel(languages, log_prob, log_prior, np.full(len(languages), -np.inf))

    def lowest(batches):
        held: dict = {}
        for batch in batches:
            for piece, texts in slices(batch, 0, SLICE):
                mean, letters = shared.value.likelihood(texts)
                for lang, row, n in zip(piece.column(1).to_pylist(), mean, letters):
                    if n >= JUDGED_LETTERS:
                        x = float(row[at[lang]])
                        held[lang] = min(x, held.get(lang, x))
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.float64())], names=["lang", "x"])

    if ranges and languages:
        shared = docs.sparkSession.sparkContext.broadcast(model)
        lows = {r["lang"]: r["x"] for r in rows.mapInArrow(lowest, "lang string, x double").groupBy("lang").agg(F.min("x").alias("x")).collect()}
        model.least = np.array([lows.get(lang, -np.inf) for lang in languages])
    return model


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text",
             lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """Append the predicted language and its score to every row.

    Whole texts are scored. Null or letterless text gives ``und`` and 0.
    Input columns named like an output are replaced. An empty table stays
    empty; repeated rows get the same answer each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop(lang_out, score_out) if text_col not in (lang_out, score_out) else docs
    at = kept.columns.index(text_col)
    out = T.StructType([*kept.schema.fields, T.StructField(lang_out, T.StringType()), T.StructField(score_out, T.DoubleType())])

    def run(batches):
        for batch in batches:
            for piece, texts in slices(batch, at, SLICE):
                langs, scores = shared.value.score(texts)
                yield pa.RecordBatch.from_arrays(
                    [*piece.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                    names=[*piece.schema.names, lang_out, score_out],
                )

    return kept.mapInArrow(run, out)


def filter_language(docs: DataFrame, model: LanguageModel, text_col: str = "text", min_score: float = 0.3) -> DataFrame:
    """Keep the rows that a learned language explains; columns stay as they are.

    Letterless and null texts go; so do texts of ``JUDGED_LETTERS`` letters or more
    whose n-grams are by ``MARGIN`` less likely than those of any training text of
    the best language (another language or script, or junk), and texts whose
    language is known with less than ``min_score``. Without ``ranges``
    in the fit the likelihood is not judged. A model without languages keeps every text that has a letter.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for piece, texts in slices(batch, at, SLICE):
                yield piece.filter(pa.array(shared.value.accepted(texts, min_score), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
