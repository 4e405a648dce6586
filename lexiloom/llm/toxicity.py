"""Toxicity of texts by multiple-instance learning.

A text is a bag of sentences. A sentence's probability is logistic in its words and the
words' beginnings; the text's is their noisy-or, ``1 - prod(1 - p)``. Only texts have labels;
the likelihood of the text labels trains the sentence weights, which then say which
sentences make a text toxic.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

#: Labelled rows of the training sample in expectation, texts that a feature must be in, features kept.
SAMPLE_ROWS, MIN_TEXTS, MAX_FEATURES = 6000, 4, 30_000
#: How far a feature's count among toxic texts must be from its share, in standard deviations.
SCREEN = 2.5
STEPS, RATE, DECAY = 250, 0.2, 2e-4
#: A text is toxic from this score on.
THRESHOLD = 0.3
PREFIXES = (4, 5, 6)
#: Features are numbered by a hash below this.
BUCKETS = 1 << 22
REMEMBERED = 500_000
HELD_OUT = 2

_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[int]:
    """The word, and the beginnings shorter than it, hashed."""
    return [zlib.crc32(f.encode("utf-8", "surrogatepass")) % BUCKETS for f in ("=" + word, *(word[:n] for n in PREFIXES if len(word) > n))]


def held_out(doc_id: int | None) -> bool:
    """Whether a row is outside what labels are learnt from; a null id counts as the word None."""
    return zlib.crc32(str(doc_id).encode()) % 4 == HELD_OUT


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(z / 2))


class Model:
    """Weights by feature, and the bias of a sentence that has any of them."""

    def __init__(self, weights: dict[int, float], bias: float) -> None:
        self.weights, self.bias = weights, bias


class WordScores(dict):
    """Word -> sum of its features' weights, None where the model knows none of them."""

    def __init__(self, model: Model) -> None:
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float | None:
        if len(self) > REMEMBERED:
            self.clear()
        known = [w for w in map(self.model.weights.get, features(word)) if w is not None]
        self[word] = out = sum(known) if known else None
        return out


def sentence_scores(words: WordScores, text: str) -> list[tuple[int, int, float]]:
    """(start, end, logit) of each sentence that has a word the model knows; offsets in code points."""
    out = []
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    for m in _SENTENCE.finditer(low):
        known = [s for s in map(words.__getitem__, set(_WORD.findall(m[0]))) if s is not None]
        if known:
            out.append((m.start(), m.end(), words.model.bias + sum(known)))
    return out


def noisy_or(logits: list[float]) -> float:
    """Of no sentences 0."""
    return float(-np.expm1(-softplus(np.array(logits)).sum())) if logits else 0.0


def fit(texts: list[str], labels: list[int]) -> Model:
    """Maximum likelihood of the labels under noisy-or, by Adam over all sentences of the sample.

    Without both kinds of label no feature is kept and every score is 0.
    """
    numbers: dict[str, int] = {}
    made: list[np.ndarray] = []
    bags = []
    for t in texts:
        bag = []
        for s in _SENTENCE.findall(t.lower()):
            own = set(_WORD.findall(s))
            for w in own:
                if w not in numbers:
                    numbers[w] = len(made)
                    made.append(np.array(features(w), np.int32))
            bag.append(np.fromiter(sorted(map(numbers.__getitem__, own)), np.int32, len(own)))
        bags.append(bag)
    del numbers
    y = np.array(labels, bool)
    every, toxic = np.zeros(BUCKETS, np.int32), np.zeros(BUCKETS, np.int32)
    for bag, bad in zip(bags, y):
        seen = np.unique(np.concatenate([made[w] for s in bag for w in s] or [np.empty(0, np.int32)]))
        every[seen] += 1
        if bad:
            toxic[seen] += 1
    rate = y.mean() if len(y) else 0.0
    chosen = np.flatnonzero(every >= MIN_TEXTS) if 0 < rate < 1 else np.empty(0, np.int64)
    lead = np.abs((toxic[chosen] - every[chosen] * rate) / np.sqrt(every[chosen] * rate * (1 - rate) + 1e-9))
    chosen = chosen[np.argsort(-lead, kind="stable")[: min(MAX_FEATURES, int((lead > SCREEN).sum()))]]
    index = np.full(BUCKETS, -1, np.int32)
    index[chosen] = np.arange(len(chosen))
    of_word = [x[x >= 0] for x in (index[m] for m in made)]
    text_of, sent, feat = [], [], []
    for d, bag in enumerate(bags):
        for s in bag:
            own = [f for w in s for f in of_word[w].tolist()]
            if own:
                sent += [len(text_of)] * len(own)
                feat += own
                text_of.append(d)
    if not text_of:
        return Model({}, -5.0)
    doc, sent, feat = np.array(text_of), np.array(sent), np.array(feat)
    w, bias = np.zeros(len(chosen)), np.array([-4.0])
    state = [np.zeros_like(x) for x in (w, w, bias, bias)]
    for step in range(1, STEPS + 1):
        z = bias[0] + np.bincount(sent, w[feat], len(doc))
        mass = np.bincount(doc, softplus(z), len(y))
        pull = np.where(y, 1 / np.expm1(np.clip(mass, 1e-9, 500)), -1.0)
        g = pull[doc] * sigmoid(z)
        for k, (x, slope) in enumerate(((w, np.bincount(feat, g[sent], len(w)) / len(y) - DECAY * w), (bias, np.array([g.sum() / len(y)])))):
            m, v = state[2 * k : 2 * k + 2]
            m += 0.1 * (slope - m)
            v += 0.01 * (slope * slope - v)
            x += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(dict(zip(chosen.tolist(), w.tolist())), float(bias[0]))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_ROWS) -> Model:
    """The model from about ``sample`` labelled rows outside the held-out part, taken by a hash of their ids.

    Rows whose label or id is null are left out. The sampled ids are few by that bound, so
    they are broadcast and the texts are not shuffled.
    """
    ours = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) != HELD_OUT
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(ours & F.col("toxic").isNotNull())
    n = known.count()
    if n > sample:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < int((1 << 40) * sample / n))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "doc_id")
    got = sorted(rows.select("doc_id", "text", "toxic").collect())
    return fit([r[1] for r in got], [r[2] for r in got])


_OUT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("held_out", T.BooleanType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("predicted", T.IntegerType()),
        T.StructField("offending", T.StringType()),
    ]
)
_ARROW = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32()), ("offending", pa.string())])


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted, offending.

    ``offending`` holds the toxic sentences of a toxic text as ``start:end`` in code points,
    likeliest first: those that reach the threshold alone, or else the likeliest one.

    Defined cases: null and empty texts have no sentence and score 0; null and repeated ids
    give a row each; an empty table gives no rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordScores(shared.value)
        edge = float(np.log(THRESHOLD / (1 - THRESHOLD)))
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                found = sentence_scores(words, text or "")
                p = noisy_or([z for _, _, z in found])
                worst = sorted(found, key=lambda s: (-s[2], s[0])) if p >= THRESHOLD else []
                told = [s for s in worst if s[2] >= edge] or worst[:1]
                rows.append((doc_id, held_out(doc_id), p, int(p >= THRESHOLD), ",".join(f"{a}:{b}" for a, b, _ in told)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(score, _OUT)


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the rows that score as toxic; its columns stay as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordScores(shared.value)
        for batch in batches:
            kind = [noisy_or([z for _, _, z in sentence_scores(words, t or "")]) < THRESHOLD for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(kind, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
