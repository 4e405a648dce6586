"""SentencePiece encoding with seeded merge dropout, and lossless decoding.

Pieces of a merge-type model are built from characters by an agenda of neighbouring pairs,
best score first. A pair that comes up is skipped for good with a chance of the dropout share.
No piece goes on over the beginning of a word, so words are independent. Every occurrence of
a word draws for itself, from a hash of the seed, the document's id and the word's place.

What a draw decides is at which of the pairs that come up one is skipped. A worker remembers
(bounded) the segmentation of a word for the skips that it has met, which does not depend on
the draw, and segments what it does not remember thousands at a time.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from itertools import count, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

SPACE = "▁"
DROPOUT, SEED = 0.1, 17
#: Segmentations that a worker remembers, and characters from which on a heap is worth it.
REMEMBERED, LONGEST = 1_000_000, 64
_MASK, _NONE = (1 << 64) - 1, float("-inf")
_PRIMES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
#: Words up to this long are segmented many at a time, and how many.
SHORT, TOGETHER = 40, 4096
#: More pairs than come up in a short word (each merge makes two at most), as bits too.
FAR, FAR_BITS = 128, 7
_WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class Pieces:
    """Vocabulary of a model: scores and ids of its plain pieces, ids of its byte pieces."""

    def __init__(self, model_file: str) -> None:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.bytes = [0] * 256
        self.plain = [b""] * m.get_piece_size()
        for k in range(m.get_piece_size()):
            piece = m.id_to_piece(k)
            if m.is_byte(k):
                self.bytes[int(piece[1:-1], 16)] = k
                self.plain[k] = bytes([int(piece[1:-1], 16)])
            elif not (m.is_control(k) or m.is_unknown(k) or m.is_unused(k)):
                if SPACE in piece.lstrip(SPACE):
                    raise ValueError("a piece goes on over the beginning of a word")
                self.ids[piece], self.scores[piece] = k, m.get_score(k)
                self.plain[k] = piece.replace(SPACE, " ").encode()

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(symbol of each code point, keys, made, place, ids): the merges as sorted arrays.

        Symbols are the pieces, the characters inside pieces, and one more for all other
        characters. A key is ``left << 32 | right``; it makes a symbol whose score is the
        ``place``-th best, equal scores sharing a place. Last come the ids of the symbols, -1
        where one is no piece.
        """
        number = {p: k for k, p in enumerate(self.ids)}
        for c in sorted({c for p in self.ids for c in p} - set(number)):
            number[c] = len(number)
        place = {s: k for k, s in enumerate(sorted(set(self.scores.values()), reverse=True))}
        found = [(number[p[:k]] << 32 | number[p[k:]], number[p], place[self.scores[p]]) for p in self.ids for k in range(1, len(p)) if p[:k] in number and p[k:] in number]
        keys, made, places = zip(*sorted(found))
        ids = np.full(len(number) + 1, -1, np.int32)
        ids[list(map(number.__getitem__, self.ids))] = list(self.ids.values())
        points = np.full(0x110000, len(number), np.int32)
        for c, k in number.items():
            if len(c) == 1:
                points[ord(c)] = k
        return points, np.array(keys, np.int64), np.array(made, np.int32), np.array(places, np.int32), ids

    def decode(self, ids: list[int]) -> str:
        """The text, without the space that encoding puts before it."""
        return b"".join(map(self.plain.__getitem__, ids))[1:].decode()


class Encoder:
    def __init__(self, pieces: Pieces, dropout: float = DROPOUT, seed: int = SEED) -> None:
        self.pieces, self.seed = pieces, seed
        self.share = int(dropout * (1 << 64))
        #: rising; the skip comes after as many pairs as there are numbers above the drawn one
        self.levels = np.array([min(_MASK, int((1 - dropout) ** k * (1 << 64))) for k in range(FAR, 0, -1)], np.uint64)
        self.table: tuple | None = None
        self._forget()

    def _forget(self) -> None:
        """Segmentations as a tree for each word: from one to that with another skip. The empty word is a literal U+2581."""
        self.roots: dict[str, int] = {"": 0}
        self.children: dict[int, int] = {}
        #: of each node where it comes from, its ids, and how many pairs come up
        self.origin, self.known = np.full(1 << 16, -1, np.int64), [np.array(self._spelt(SPACE), np.int32).tobytes()]
        self.limit = np.zeros(1 << 16, np.int64)

    def gaps(self, keys: np.ndarray, turn: int) -> np.ndarray:
        """Pairs that come up before the next skip, ``FAR`` for that many and more."""
        if not self.share:
            return np.full(len(keys), FAR)
        x = keys + np.uint64((turn + 1) * _PRIMES[0] & _MASK)
        x = (x ^ x >> np.uint64(30)) * np.uint64(_PRIMES[1])
        x = (x ^ x >> np.uint64(27)) * np.uint64(_PRIMES[2])
        return FAR - np.searchsorted(self.levels, x ^ x >> np.uint64(31), "right")

    def drops(self, key: int) -> Iterator[int]:
        """At which of the pairs that come up one is skipped."""
        at, keys = 0, np.array([key], np.uint64)
        for turn in count() if self.share else ():
            gap = int(self.gaps(keys, turn)[0])
            at += gap
            if gap < FAR:
                yield at
                at += 1

    def word(self, word: str, key: int) -> bytes:
        """Ids (32-bit) of a word's pieces."""
        parts = self._short(word, key) if len(word) <= LONGEST else self._long(word, key)
        return self._ids(parts)

    def _ids(self, parts: list[str]) -> bytes:
        """Ids of pieces; what is none is spelt in bytes."""
        ids, out = self.pieces.ids, []
        for piece in parts:
            if (i := ids.get(piece)) is not None:
                out.append(i)
            else:
                out += self._spelt(piece)
        return np.array(out, np.int32).tobytes()

    def _spelt(self, piece: str) -> list[int]:
        return [self.pieces.bytes[x] for x in piece.encode()]

    def _short(self, word: str, key: int) -> list[str]:
        """The agenda as a list: for a few characters looking through it is cheaper than keeping it in order."""
        score, parts = self.pieces.scores.get, list(word)
        drops, turn = self.drops(key), -1
        drop = next(drops, None)
        agenda = [score(a + b, _NONE) for a, b in zip(parts, parts[1:])]
        while agenda and (best := max(agenda)) != _NONE:
            k = agenda.index(best)
            turn += 1
            if turn == drop:
                agenda[k], drop = _NONE, next(drops)
                continue
            parts[k] += parts.pop(k + 1)
            del agenda[k]
            if k:
                agenda[k - 1] = score(parts[k - 1] + parts[k], _NONE)
            if k < len(agenda):
                agenda[k] = score(parts[k] + parts[k + 1], _NONE)
        return parts

    def _long(self, word: str, key: int) -> list[str]:
        """The agenda as a heap, with the neighbours of each part."""
        scores = self.pieces.scores
        left, right = list(range(-1, len(word) - 1)), list(range(1, len(word) + 1))
        ends = list(range(1, len(word) + 1))
        alive = [True] * len(word)
        agenda: list[tuple[float, int, int, int]] = []
        drops, turn = self.drops(key), -1
        drop = next(drops, None)

        def propose(a: int, b: int) -> None:
            if a >= 0 and b < len(word) and (s := scores.get(word[a : ends[b]])) is not None:
                heapq.heappush(agenda, (-s, a, b, ends[b]))

        for k in range(len(word) - 1):
            propose(k, k + 1)
        while agenda:
            _, a, b, end = heapq.heappop(agenda)
            # one of the two has been merged since
            if not alive[a] or not alive[b] or right[a] != b or ends[b] != end:
                continue
            turn += 1
            if turn == drop:
                drop = next(drops)
                continue
            alive[b] = False
            ends[a], right[a] = end, right[b]
            if right[b] < len(word):
                left[right[b]] = a
            propose(left[a], a)
            propose(a, right[a])
        return [word[k : ends[k]] for k in range(len(word)) if alive[k]]

    def _table(self) -> tuple:
        if self.table is None:
            self.table = self.pieces.pairs()
        return self.table

    def together(self, words: list[str], dropped: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """Ids of words of one length, and how many pairs come up in each; ``dropped`` tells which of these are skipped.

        Each step takes the best pair of every word at once; it gives what ``word`` gives. A
        merged part stays at its first character and knows its neighbours.
        """
        points, keys, made, places, ids = self._table()
        size, none = len(words[0]), np.int32((1 << 31) - 1)
        # behind the last character stands a part without pairs
        sym = np.full((len(words), size + 1), -1, np.int32)
        sym[:, :size] = points[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)].reshape(-1, size)
        after = np.tile(np.arange(1, size + 2, dtype=np.int8), (len(words), 1))
        before = np.tile(np.arange(-1, size, dtype=np.int8), (len(words), 1))
        alive = np.ones((len(words), size), bool)
        turn = np.zeros(len(words), np.int64)
        agenda = np.full((len(words), size), none)

        def propose(rows: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
            want = sym[rows, left].astype(np.int64) << 32 | sym[rows, right]
            k = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
            agenda[rows, left] = np.where(keys[k] == want, places[k], none)

        every = np.arange(len(words))
        propose(np.repeat(every, size), np.tile(np.arange(size), len(words)), np.tile(np.arange(1, size + 1), len(words)))
        rows = every
        while len(rows):
            now = agenda if len(rows) == len(words) else agenda[rows]
            k = now.argmin(1)
            go = now[np.arange(len(rows)), k] != none
            rows, k = rows[go], k[go]
            skip = dropped[rows, turn[rows]]
            turn[rows] += 1
            agenda[rows[skip], k[skip]] = none
            r, k = rows[~skip], k[~skip]
            if not len(r):
                continue
            gone = after[r, k]
            want = sym[r, k].astype(np.int64) << 32 | sym[r, gone]
            sym[r, k] = made[np.searchsorted(keys, want)]
            alive[r, gone] = False
            agenda[r, gone] = none
            behind = after[r, gone]
            after[r, k] = behind
            before[r, behind] = k
            propose(r, k, behind)
            ahead = before[r, k]
            ok = ahead >= 0
            propose(r[ok], ahead[ok], k[ok])
        out = ids[np.maximum(sym[:, :size], 0)]
        odd = ((out < 0) & alive).any(1)
        stops = np.cumsum(4 * alive.sum(1)).tolist()
        flat = out[alive].tobytes()
        found = [flat[a:b] for a, b in zip([0, *stops], stops)]
        for row in np.flatnonzero(odd).tolist():
            edges = [*np.flatnonzero(alive[row]).tolist(), size]
            found[row] = self._ids([words[row][a:b] for a, b in zip(edges, edges[1:])])
        return found, turn

    def _learn(self, asked: list[str] | list[int], words: list[str]) -> None:
        """New nodes: of words (their root), or of (node, skip) codes, each with its word."""
        root = isinstance(asked[0], str)
        codes = np.full(len(asked), -1, np.int64) if root else np.array(asked, np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(sizes, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1):
            for a in range(0, len(part), TOGETHER):
                at = part[a : a + TOGETHER]
                dropped = np.zeros((len(at), FAR), bool)
                rows, code = np.arange(len(at)), codes[at]
                while len(rows := rows[code >= 0]):
                    code = code[code >= 0]
                    dropped[rows, code & FAR - 1] = True
                    code = self.origin[code >> FAR_BITS]
                ids, limit = self.together([words[k] for k in at.tolist()], dropped)
                first = len(self.known)
                if first + len(at) > len(self.limit):
                    more = max(len(at), len(self.limit))
                    self.limit = np.concatenate([self.limit, np.zeros(more, np.int64)])
                    self.origin = np.concatenate([self.origin, np.full(more, -1, np.int64)])
                self.limit[first : first + len(at)] = limit
                self.origin[first : first + len(at)] = codes[at]
                self.known += ids
                (self.roots if root else self.children).update(zip([asked[k] for k in at.tolist()], range(first, first + len(at))))

    def _find(self, where: dict, asked: list, words: list[str]) -> np.ndarray:
        """Nodes of what is asked for, learnt where they are not known."""
        node = np.fromiter(map(where.get, asked, repeat(-1)), np.int64, len(asked))
        if len(new := np.flatnonzero(node < 0)):
            once = {asked[k]: words[k] for k in new.tolist()}
            self._learn(list(once), list(once.values()))
            node[new] = [where[asked[k]] for k in new.tolist()]
        return node

    def encode_many(self, texts: list[tuple[str, int]]) -> list[np.ndarray]:
        """Ids of each (text, key)."""
        if len(self.known) > REMEMBERED:
            self._forget()
        words: list[str] = []
        keys, stops = [np.empty(0, np.uint64)], [0]
        for text, key in texts:
            for own in self._words(text, key):
                words += own[0]
                keys.append(own[1])
            stops.append(len(words))
        key = np.concatenate(keys)
        long = [k for k, w in enumerate(words) if len(w) > SHORT]
        asked = words
        if long:
            asked = words.copy()
            for k in long:
                asked[k] = ""
        node = self._find(self.roots, asked, words)
        at = self.gaps(key, 0)
        left = np.flatnonzero(at < self.limit[node])
        turn = 1
        while len(left):
            codes = (node[left] << FAR_BITS | at[left]).tolist()
            node[left] = self._find(self.children, codes, [words[k] for k in left.tolist()])
            at[left] += 1 + self.gaps(key[left], turn)
            left = left[at[left] < self.limit[node[left]]]
            turn += 1
        out = list(map(self.known.__getitem__, node.tolist()))
        for k in long:
            out[k] = self.word(words[k], int(key[k]))
        return [np.frombuffer(b"".join(out[a:b]), np.int32) for a, b in zip(stops, stops[1:])]

    def _words(self, text: str, key: int) -> Iterator[tuple[list[str], np.ndarray]]:
        """Of each stretch between literal U+2581: its words and their keys; before all but the first the empty word."""
        for n, part in enumerate((" " + text).split(SPACE)) if text else ():
            words = _WORD.findall(part.replace(" ", SPACE))
            own = xxhash.xxh64_intdigest(b"%d:%d" % (key, n), self.seed)
            keys = np.uint64(own) ^ np.arange(1, len(words) + 1, dtype=np.uint64) * np.uint64(_PRIMES[3])
            # a literal U+2581 must not come back as a space
            yield ([""] + words, np.append(np.uint64(0), keys)) if n else (words, keys)

    def encode(self, text: str, key: int = 0) -> np.ndarray:
        """Ids of a text; ``key`` tells it from other texts."""
        return self.encode_many([(text, key)])[0]


def encode_texts(docs: DataFrame, pieces: Pieces, dropout: float = DROPOUT, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, ids (array of int), lossless (the ids decode to the text).

    Defined cases: null text is empty and has no ids; null ids are a key like any other, and
    rows with equal id and text are encoded alike; texts of any length are encoded word by
    word; an empty table gives no rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value, dropout, seed)
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                texts = [(t or "", -1 if k is None else k) for k, t in zip(part["doc_id"].to_pylist(), part["text"].to_pylist())]
                ids = encoder.encode_many(texts)
                good = [encoder.pieces.decode(x.tolist()) == text for x, (text, _) in zip(ids, texts)]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                flat = pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32), pa.int32())
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.ListArray.from_arrays(pa.array(offsets), flat), pa.array(good, pa.bool_())], names=["doc_id", "ids", "lossless"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(each, "doc_id bigint, ids array<int>, lossless boolean")


def decode_ids(encoded: DataFrame, pieces: Pieces) -> DataFrame:
    """Per row of ``encoded`` (doc_id, ids): doc_id, text. Null ids are no text but empty."""
    shared = encoded.sparkSession.sparkContext.broadcast(pieces)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([shared.value.decode(x or []) for x in batch["ids"].to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(each, "doc_id bigint, text string")


def digest(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids joined by spaces), lossless."""
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), "lossless")
