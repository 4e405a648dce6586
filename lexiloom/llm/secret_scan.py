"""Secrets in texts: fixed patterns, and a linear-chain conditional random field that adds spans.

The field tags tokens O (outside), B (begin) and I (inside) from the token's shape, its
neighbours and features of the whole text. It learns from a bounded sample in which the
patterns' own matches are the tags, and is decoded by Viterbi over every whole text.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_TOKEN = re.compile(r"[A-Za-z0-9_+/.-]+=*|[^\sA-Za-z0-9_+/.-]")

#: Bounds of the training sample: documents in expectation, windows, tokens of a window.
SAMPLE_DOCS, WINDOWS, WIDTH = 3000, 1000, 48
#: Hashed features, steps of the optimiser, documents of the sample that a word needs to keep its identity.
SIZE, STEPS, MIN_WORD = 1 << 15, 80, 10
O, B, I = 0, 1, 2
#: Least length of a token that a span may hold, so that a tagged quote is not a secret.
LEAST = 6
#: Tokens whose features a worker remembers.
REMEMBERED = 400_000


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the patterns' matches, by start and then kind."""
    out = [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    # a run of the class matches whole or not at all, so its least length can be in the pattern
    out += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], s[2]))


def secret_spans(text: str) -> list[tuple[int, int]]:
    """The parts of the base matches that are the secret itself: the tags to learn."""
    out = [m.span(2) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    return out + [m.span() for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20] + [m.span() for m in _HEX.finditer(text)]


def shape(token: str) -> str:
    """Classes of the characters, runs once: ``sk-Ab12`` is ``a-Aa0``."""
    out: list[str] = []
    for c in token:
        k = "A" if "A" <= c <= "Z" else "a" if "a" <= c <= "z" else "0" if "0" <= c <= "9" else c if c < "\x80" else "u"
        if not out or out[-1] != k:
            out.append(k)
        if len(out) == 8:
            break
    return "".join(out)


def _at(role: str, value: object) -> int:
    return zlib.crc32(f"{role}|{value}".encode()) % SIZE


def traits(token: str, words: frozenset[str]) -> tuple[str, str, int, int, str]:
    """(word if it keeps its identity, shape, class of length, quarters of digits, prefix): all that features see."""
    low = token.lower()
    n = len(token)
    length = min(2 * n.bit_length() + (n >= 3 << max(0, n.bit_length() - 2)), 14)
    if low in words:
        word = low
    elif token.isalpha() and token.isascii():
        # most rare words; the shape of a plain word needs no look at its characters
        return "?", "a" if token == low else "Aa" if token[1:] == low[1:] else shape(token), length, 0, "-"
    else:
        word = "?"
    return word, shape(token), length, sum("0" <= c <= "9" for c in token) * 4 // n, token[:4] if n > 12 else "-"


def token_features(token_traits: tuple[str, str, int, int, str]) -> tuple[list[int], list[int], list[int], list[int]]:
    """Hashed features that a token gives itself, its successor, the one after, and its predecessor."""
    word, form, length, digits, prefix = token_traits
    own = [_at("w0", word), _at("s0", form), _at("l0", length), _at("ld", (length, digits)), _at("p0", prefix)]
    return own, [_at("w-1", word), _at("s-1", form[:3])], [_at("w-2", word)], [_at("w+1", word), _at("s+1", form[:3])]


def _share(x: float) -> int:
    return 0 if x == 0 else 1 if x < 0.01 else 2 if x < 0.05 else 3


def file_features(digits: float, signs: float) -> list[int]:
    """From the shares of tokens with a digit and of tokens that assign."""
    return [_at("fd", _share(digits)), _at("fs", _share(signs))]


class Field:
    """Weights of the field; all state that decoding needs."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray, words: frozenset[str]) -> None:
        self.weights, self.moves, self.words = weights, moves, words

    def __getstate__(self) -> tuple:
        return self.weights, self.moves, self.words

    def __setstate__(self, state: tuple) -> None:
        self.weights, self.moves, self.words = state


class Remembered(dict):
    """Token -> row of its scores for itself and its neighbours; tokens of equal traits share one."""

    def __init__(self, field: Field) -> None:
        super().__init__()
        self.field, self.n = field, 0
        self.by_traits: dict[tuple, int] = {}
        self.rows, self.flags = np.zeros((1024, 12)), np.zeros((1024, 2))

    def __missing__(self, token: str) -> int:
        seen = traits(token, self.field.words)
        if (k := self.by_traits.get(seen)) is None:
            k = self.by_traits[seen] = self._row(token, seen)
        self[token] = k
        return k

    def _row(self, token: str, seen: tuple) -> int:
        if self.n == len(self.rows):
            self.rows, self.flags = np.concatenate([self.rows, self.rows]), np.concatenate([self.flags, self.flags])
        k, self.n = self.n, self.n + 1
        self.rows[k] = np.concatenate([self.field.weights[f].sum(0) for f in token_features(seen)])
        self.flags[k] = any("0" <= c <= "9" for c in seen[1]), seen[1][-1] in "=:"
        return k


def emissions(known: Remembered, docs: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Scores (token, tag) of all documents' tokens one after another, and each document's first token."""
    ids = np.fromiter((k for d in docs for k in map(known.__getitem__, d)), np.int64)
    ends = np.cumsum([len(d) for d in docs])
    starts = ends - [len(d) for d in docs]
    rows = known.rows[ids]
    scores = rows[:, 0:3].copy()
    doc = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    for gap, part in ((1, slice(3, 6)), (2, slice(6, 9))):
        if len(ids) > gap:
            scores[gap:] += rows[:-gap, part] * (doc[gap:] == doc[:-gap])[:, None]
    if len(ids) > 1:
        scores[:-1] += rows[1:, 9:12] * (doc[1:] == doc[:-1])[:, None]
    if len(ids):
        n = np.maximum(1, ends - starts)
        sums = np.stack([np.bincount(doc, known.flags[ids, k], len(docs)) / n for k in (0, 1)], 1)
        of_file = np.stack([known.field.weights[file_features(d, s)].sum(0) for d, s in sums])
        scores += of_file[doc]
    return scores, starts


def viterbi(scores: np.ndarray, starts: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Best tags of each document.

    A token whose lead for O is more than any two moves can win back is O on every best path,
    so it parts the chain; the stretches between such tokens are decoded side by side.
    """
    n = len(scores)
    tags = np.zeros(n, np.int8)
    if not n:
        return tags
    win = (moves.max(1) - moves[:, O]).max() + (moves.max(0) - moves[O]).max()
    sure = scores[:, O] - scores[:, 1:].max(1) > win
    first = np.zeros(n, bool)
    first[starts[starts < n]] = True
    open_ = ~sure
    begins = np.flatnonzero(open_ & (first | np.concatenate([[True], sure[:-1]])))
    if not len(begins):
        return tags
    last = np.concatenate([first[1:] | sure[1:], [True]])
    ends = np.flatnonzero(open_ & last) + 1
    order = np.argsort(begins - ends, kind="stable")
    begins, lengths = begins[order], (ends - begins)[order]
    # a stretch that follows a sure token starts from O; a document's first token from nothing
    score = scores[begins] + np.where(first[begins][:, None], 0.0, moves[O])
    back = []
    for t in range(1, lengths[0]):
        live = int(np.searchsorted(-lengths, -t, "left"))
        step = score[:live, :, None] + moves
        back.append(step.argmax(1).astype(np.int8))
        score[:live] = step.max(1) + scores[begins[:live] + t]
    after = begins + lengths
    follows = (after < n) & ~first[np.minimum(after, n - 1)]
    tag = (score + np.where(follows[:, None], moves[:, O], 0.0)).argmax(1)
    for t in range(lengths[0] - 1, -1, -1):
        live = int(np.searchsorted(-lengths, -t, "left"))
        tags[begins[:live] + t] = tag[:live]
        if t:
            tag[:live] = back[t - 1][np.arange(live), tag[:live]]
    return tags


def tagged(text: str) -> tuple[list[str], np.ndarray]:
    """Tokens, and the tags that the patterns' secrets give them."""
    found = list(_TOKEN.finditer(text))
    tags = np.zeros(len(found), np.int64)
    starts = [m.start() for m in found]
    ends = [m.end() for m in found]
    for a, b in secret_spans(text):
        i, j = int(np.searchsorted(ends, a, "right")), int(np.searchsorted(starts, b, "left"))
        if i < j:
            tags[i:j] = I
            tags[i] = B
    return [m[0] for m in found], tags


def fit(texts: list[str]) -> Field:
    """Likelihood of the tags, raised by Adam over windows of the sample's tokens."""
    docs = [tagged(t) for t in texts]
    counts = Counter(w for toks, _ in docs for w in {t.lower() for t in toks})
    words = frozenset(w for w, n in counts.items() if n >= MIN_WORD)
    made: dict[str, tuple] = {}
    yes, hard, no = [], [], []
    for toks, tags in docs:
        n = max(1, len(toks))
        shares = file_features(sum(any("0" <= c <= "9" for c in t) for t in toks) / n, sum(t[-1] in "=:" for t in toks) / n)
        for a in range(0, len(toks), WIDTH):
            kind = yes if tags[a : a + WIDTH].any() else hard if max(map(len, toks[a : a + WIDTH])) > 12 else no
            kind.append((toks, tags, a, shares))
    keep = yes[: WINDOWS // 3]
    # without secrets: first windows with long tokens, which look most like them, then any
    for kind in (hard, no):
        room = (WINDOWS * 3 // 4 if kind is hard else WINDOWS) - len(keep)
        keep += kind[:: max(1, len(kind) // max(1, room))][:room]
    pad = SIZE
    feats, gold = np.full((len(keep), WIDTH, 12), pad, np.int32), np.full((len(keep), WIDTH), -1)
    for k, (toks, tags, a, shares) in enumerate(keep):
        for j in range(min(WIDTH, len(toks) - a)):
            near = []
            for gap, role in ((0, 0), (-1, 1), (-2, 2), (1, 3)):
                if 0 <= (at := a + j + gap) < len(toks):
                    t = toks[at]
                    if t not in made:
                        made[t] = token_features(traits(t, words))
                    near += made[t][role]
            near += shares
            feats[k, j, : len(near)] = near
            gold[k, j] = tags[a + j]
    return Field(*_adam(feats, gold), words)


def _adam(feats: np.ndarray, gold: np.ndarray, rate: float = 0.2, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    w, moves = np.zeros((SIZE + 1, 3)), np.zeros((3, 3))
    if not len(feats):
        return w[:-1], moves
    lanes, width, _ = feats.shape
    there = gold >= 0
    state = [np.zeros_like(x) for x in (w, w, moves, moves)]
    target = np.eye(3)[np.maximum(gold, 0)] * there[..., None]
    pairs = there[:, 1:] & there[:, :-1]
    seen = np.zeros((3, 3))
    np.add.at(seen, (gold[:, :-1][pairs], gold[:, 1:][pairs]), 1)
    flat = feats.reshape(-1, feats.shape[2])
    for step in range(1, STEPS + 1):
        e = w[flat].sum(1).reshape(lanes, width, 3)
        fwd, bwd = np.zeros_like(e), np.zeros_like(e)
        fwd[:, 0] = e[:, 0]
        for t in range(1, width):
            fwd[:, t] = np.where(there[:, t, None], np.logaddexp.reduce(fwd[:, t - 1, :, None] + moves, 1) + e[:, t], fwd[:, t - 1])
        total = np.logaddexp.reduce(fwd[:, -1], 1)
        for t in range(width - 2, -1, -1):
            bwd[:, t] = np.where(there[:, t + 1, None], np.logaddexp.reduce(moves + (e[:, t + 1] + bwd[:, t + 1])[:, None, :], 2), bwd[:, t + 1])
        prob = np.exp(np.minimum(0, fwd + bwd - total[:, None, None])) * there[..., None]
        both = fwd[:, :-1, :, None] + moves + (e[:, 1:] + bwd[:, 1:])[:, :, None, :] - total[:, None, None, None]
        expected = (np.exp(np.minimum(0, both)) * pairs[..., None, None]).sum((0, 1))
        slope = (target - prob).reshape(-1, 3)
        gw = np.stack([np.bincount(flat.ravel(), np.repeat(slope[:, y], flat.shape[1]), SIZE + 1) for y in range(3)], 1)
        gw[-1] = 0
        for k, (x, g) in enumerate(((w, gw / lanes - decay * w), (moves, (seen - expected) / lanes - decay * moves))):
            m, v = state[2 * k : 2 * k + 2]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w[-1] = 0
    return w[:-1], moves


def learned_spans(text: str, tags: np.ndarray, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Runs of B and I with a token of some length that touch no base span; kind 3."""
    found = list(_TOKEN.finditer(text))
    out: list[list[int]] = []
    before = O
    for k in np.flatnonzero(tags):
        m = found[k]
        if tags[k] == I and out and before == k - 1:
            out[-1][1], out[-1][2] = m.end(), max(out[-1][2], len(m[0]))
        else:
            out.append([m.start(), m.end(), len(m[0])])
        before = k
    return [(a, b, 3) for a, b, most in out if most >= LEAST and all(b <= x or y <= a for x, y, _ in base)]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{(*KINDS, 'crf')[k]}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], s[2])))


_OUT = T.StructType(
    [T.StructField("doc_id", T.LongType())]
    + [T.StructField(f"n_{k}", T.LongType()) for k in KINDS]
    + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]
)
_ARROW = pa.schema([(f.name, pa.int64() if isinstance(f.dataType, T.LongType) else pa.string()) for f in _OUT])


def scan_texts(known: Remembered, texts: list[str]) -> list[tuple[list, list]]:
    """(base spans, learned spans) of each text."""
    if len(known) > REMEMBERED:
        known.clear()
        known.by_traits.clear()
        known.n = 0
    docs = [_TOKEN.findall(t) for t in texts]
    scores, starts = emissions(known, docs)
    tags = viterbi(scores, starts, known.field.moves)
    out = []
    for text, a, toks in zip(texts, starts, docs):
        base, mine = base_spans(text), tags[a : a + len(toks)]
        out.append((base, learned_spans(text, mine, base) if mine.any() else []))
    return out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE_DOCS) -> Field:
    """The field from about ``sample`` documents, taken by a hash of their ids."""
    n = docs.count()
    part = docs if n <= sample else docs.where(F.pmod(F.xxhash64(F.col(id_col), F.lit("secrets")), F.lit(1 << 40)) < int((1 << 40) * sample / n))
    texts = [r[0] for r in part.select(text_col).where(F.col(text_col).isNotNull()).orderBy(F.xxhash64(text_col)).collect()]
    return fit(texts)


def find_secrets(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Spans are ``kind:start:end`` in code points, the end exclusive. Base spans stay as they
    are; the field adds spans that touch none of them, as kind ``crf``.

    Defined cases: null text is empty and has no spans; null and repeated ids give a row
    each; an empty table gives no rows (the field may have been fitted on no text at all);
    other columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(field)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Remembered(model.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = []
                for doc_id, (base, more) in zip(part["doc_id"].to_pylist(), scan_texts(known, [t or "" for t in part["text"].to_pylist()])):
                    n = Counter(k for _, _, k in base)
                    rows.append((doc_id, n[0], n[1], n[2], hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more)))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(scan, _OUT)
