"""Token counts of byte-level BPE by a compiled transducer.

The tokenizer (pattern that parts the text, then merges inside each part) becomes one
deterministic transducer over characters. A state is the place in the pattern together
with what the merges can still depend on: for each start of an unfinished vocabulary entry,
the token that ends there and how many tokens have come since. A transition carries the
change in the number of tokens. States are made when a text first reaches them and are
shared from then on.

A long text is cut into chunks. What a chunk does to any state it may be entered in is its
state map: up to its first certain boundary it depends on what came before, between its
first and last certain boundary it adds a fixed count, and what follows the last boundary is
the state it leaves. Maps compose associatively; Spark folds neighbouring maps, a bounded
number at a time, until each text has one.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from lexiloom.llm.common import cut

#: Characters of a chunk, and maps folded at once.
CHUNK, FAN = 1 << 16, 64
#: States that a worker keeps, and further ones that it drops together when they are that many.
KEPT_STATES, MORE_STATES = 100_000, 20_000

_SPACE, _LETTER, _NUMBER, _OTHER = "W", "L", "N", "O"
_CLASS = (regex.compile(r"\p{White_Space}"), regex.compile(r"\p{L}"), regex.compile(r"\p{N}"))
#: The second character of a certain boundary: the pattern parts here whatever came before.
_CERTAIN = regex.compile(r"(?<=\p{L})[^\p{L}]|(?<=\p{N})[^\p{N}]|(?<=[^\p{White_Space}\p{L}\p{N}'])[\p{White_Space}\p{L}\p{N}]", regex.V0)
_CERTAIN_BACK = regex.compile(r"(?r)" + _CERTAIN.pattern, regex.V0)


@lru_cache(1 << 16)
def char_class(ch: str) -> str:
    for kind, name in zip(_CLASS, (_SPACE, _LETTER, _NUMBER)):
        if kind.match(ch):
            return name
    return _OTHER


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Merges:
    """The merge automaton: how a byte changes the number of tokens of a part."""

    def __init__(self, tokenizer_json: str) -> None:
        model = json.loads(tokenizer_json)["model"]
        alphabet = byte_alphabet()
        raw = lambda s: bytes(alphabet[c] for c in s)
        self.tokens = {raw(s) for s in model["vocab"]}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.ranks = {(raw(a), raw(b)): k for k, (a, b) in enumerate(pairs)}
        self.open = {t[:k] for t in self.tokens for k in range(1, len(t))} | {b""}
        self.root = ((b"", None, 0),)
        self._fits: dict[tuple[bytes | None, bytes], bool] = {}
        self._shared: dict[tuple, tuple] = {}

    def encode(self, part: bytes) -> list[bytes]:
        """Merges in order of rank; only for the short strings that compiling meets."""
        out = [part[k : k + 1] for k in range(len(part))]
        while len(out) > 1:
            rank, k = min((self.ranks.get(p, len(self.ranks)), k) for k, p in enumerate(zip(out, out[1:])))
            if rank == len(self.ranks):
                break
            pair, merged, j = (out[k], out[k + 1]), [], 0
            while j < len(out):
                if j + 1 < len(out) and (out[j], out[j + 1]) == pair:
                    merged.append(pair[0] + pair[1])
                    j += 2
                else:
                    merged.append(out[j])
                    j += 1
            out = merged
        return out

    def fits(self, last: bytes | None, token: bytes) -> bool:
        """Whether ``token`` may follow ``last``: the merges leave the two as they are."""
        key = (last, token)
        if (known := self._fits.get(key)) is None:
            if len(self._fits) > 500_000:
                self._fits.clear()
            known = self._fits[key] = self.encode((last or b"") + token) == ([last, token] if last else [token])
        return known

    def forget(self) -> None:
        self._shared.clear()

    def _share(self, entry: tuple) -> tuple:
        return self._shared.setdefault(entry, entry)

    def feed(self, state: tuple, data: bytes) -> tuple[tuple, int]:
        """State and change in the number of tokens after ``data``.

        A part's encoding is the encoding of a shorter prefix and one token more, and that
        token is the only one that fits after the prefix's last token.
        """
        total = 0
        for k in range(len(data)):
            byte = data[k : k + 1]
            grown = [(start + byte, last, since) for start, last, since in state]
            token, since = next((u, n) for u, last, n in grown if u in self.tokens and self.fits(last, u))
            change = 1 - since
            state = (*(self._share((u, last, n + change)) for u, last, n in grown if u in self.open), self._share((b"", token, 0)))
            total += change
        return state, total


class State(dict):
    """Maps a character to (next state, change of the count); made when first asked for."""

    __slots__ = ("machine", "mode", "bpe", "held", "kept")

    def __missing__(self, ch: str) -> tuple[State, int]:
        *key, change = self.machine.go(self.mode, self.bpe, self.held, ch)
        out = (self.machine.state(*key), change)
        if out[0].kept or not self.kept:
            self[ch] = out
        return out


class Transducer:
    """Pattern and merges as one machine.

    Modes: B at a boundary; L, N, O inside a run of letters, numbers, others; A after an
    apostrophe that begins a part; r, v, l after such an apostrophe and that letter; W in
    white space, whose last character is held back since it may begin the next part.
    """

    def __init__(self, tokenizer_json: str) -> None:
        self.merges = Merges(tokenizer_json)
        self.states: dict[tuple, State] = {}
        self.more: dict[tuple, State] = {}
        self.start = self.state("B", self.merges.root, "")

    def state(self, mode: str, bpe: tuple, held: str) -> State:
        key = (mode, bpe, held)
        if (found := self.states.get(key, self.more.get(key))) is not None:
            return found
        kept = len(self.states) < KEPT_STATES
        if not kept and len(self.more) >= MORE_STATES:
            for s in self.more.values():
                s.clear()
            self.more.clear()
            self.merges.forget()
        found = State()
        found.machine, found.mode, found.bpe, found.held, found.kept = self, mode, bpe, held, kept
        (self.states if kept else self.more)[key] = found
        return found

    def go(self, mode: str, bpe: tuple, held: str, ch: str) -> tuple[str, tuple, str, int]:
        kind, feed, root = char_class(ch), self.merges.feed, self.merges.root
        data = ch.encode("utf-8", "surrogatepass")
        if mode == "W":
            if kind == _SPACE:
                bpe, n = feed(bpe, held.encode())
                return "W", bpe, ch, n
            if held == " ":
                bpe, n = feed(root, b" " + data)
                return kind, bpe, "", n
            _, n = feed(root, held.encode())
            mode, bpe, held, m = self.go("B", root, "", ch)
            return mode, bpe, held, n + m
        if mode == "A":
            if ch in "stmd":
                _, n = feed(bpe, data)
                return "B", root, "", n
            if ch in "rvl":
                bpe, n = feed(root, data)
                return ch, bpe, "", n
            mode = _OTHER
        elif mode in "rvl":
            if ch == ("l" if mode == "l" else "e"):
                n = [feed(root, s)[1] for s in (b"'" + mode.encode() + data, b"'", mode.encode())]
                return "B", root, "", n[0] - n[1] - n[2]
            mode = _LETTER
        if mode == kind:
            bpe, n = feed(bpe, data)
            return mode, bpe, "", n
        if kind == _SPACE:
            return "W", root, ch, 0
        bpe, n = feed(root, data)
        return "A" if ch == "'" else kind, bpe, "", n

    def count(self, text: str) -> int:
        """Tokens of a whole text."""
        state, n = self.start, 0
        for ch in text:
            state, change = state[ch]
            n += change
        return n + self.merges.feed(state.bpe, state.held.encode())[1] if state.held else n

    def chunk_map(self, chunk: str) -> tuple[str, int, str | None]:
        """(head, count, tail); without a certain boundary all is head and tail is None."""
        if (first := _CERTAIN.search(chunk)) is None:
            return chunk, 0, None
        last = _CERTAIN_BACK.search(chunk).start()
        return chunk[: first.start()], self.count(chunk[first.start() : last]), chunk[last:]

    def compose(self, a: tuple[str, int, str | None], b: tuple[str, int, str | None]) -> tuple[str, int, str | None]:
        if a[2] is None:
            return self._seam("", a[0], b)
        if b[2] is None:
            head, n, tail = self.chunk_map(a[2] + b[0])
            return (a[0], a[1], a[2] + b[0]) if tail is None else (a[0], a[1] + self.count(head) + n, tail)
        return a[0], a[1] + self.count(a[2] + b[0]) + b[1], b[2]

    def _seam(self, before: str, head: str, b: tuple[str, int, str | None]) -> tuple[str, int, str | None]:
        """A chunk without a boundary before ``b``; the seam itself may be a boundary."""
        h, n, tail = self.chunk_map(before + head + b[0])
        if tail is None:
            return h, b[1], b[2]
        return (h, n, tail) if b[2] is None else (h, n + self.count(tail) + b[1], b[2])

    def finish(self, a: tuple[str, int, str | None]) -> int:
        return self.count(a[0]) + a[1] + self.count(a[2] or "")


@lru_cache(2)
def transducer(tokenizer_json: str) -> Transducer:
    return Transducer(tokenizer_json)


_MAPS = T.StructType(
    [T.StructField("row", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType())]
    + [T.StructField(n, T.LongType()) for n in ("seg", "n_segs", "chunk", "n_chunks", "n")]
    + [T.StructField("head", T.StringType()), T.StructField("tail", T.StringType())]
)
_MAP = "struct<chunk: bigint, head: string, n: bigint, tail: string>"


def count_tokens(docs: DataFrame, tokenizer_json: str, id_col: str = "doc_id", text_col: str = "text", special: str = "<|endoftext|>", limit: int = 512, chunk: int = CHUNK) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``).

    ``tokenizer_json`` is the text of a byte-level BPE file. ``special`` inside a text is
    one token and parts the text, as the file's library does by default.

    Defined cases: null text is empty and has no tokens; null and repeated ids give a row
    each; an empty table gives no rows; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    parts = F.when(text.contains(special), F.split(text, "(?s)" + regex.escape(special, special_only=False), -1)).otherwise(F.array(text))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), parts.alias("parts"))
    rows = rows.select("row", "doc_id", "n_bytes", F.size("parts").cast("long").alias("n_segs"), F.posexplode("parts").alias("seg", "part"))
    pieces = F.greatest(F.lit(1), F.ceil(F.char_length("part") / chunk)).cast("long")
    rows = rows.withColumn("n_chunks", pieces)
    rows = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_chunks") - 1)).alias("chunk"))
    rows = rows.select("row", "doc_id", "n_bytes", F.col("seg").cast("long").alias("seg"), "n_segs", "chunk", "n_chunks", F.when(F.col("n_chunks") == 1, F.col("part")).otherwise(F.substring("part", F.col("chunk") * chunk + 1, F.lit(chunk))).alias("piece"))

    compiled = docs.sparkSession.sparkContext.broadcast(tokenizer_json)

    def to_maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(compiled.value)
        for batch in batches:
            single = batch["n_chunks"].to_pylist()
            maps = [("", machine.count(s), None) if n == 1 else machine.chunk_map(s) for s, n in zip(batch["piece"].to_pylist(), single)]
            head, n, tail = zip(*maps) if maps else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch[c] for c in ("row", "doc_id", "n_bytes", "seg", "n_segs", "chunk", "n_chunks")] + [pa.array(n, pa.int64()), pa.array(head, pa.string()), pa.array(tail, pa.string())],
                names=[f.name for f in _MAPS],
            )

    maps = cut(rows.mapInArrow(to_maps, _MAPS))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(compiled.value)
        for batch in batches:
            out = []
            for group, n_chunks in zip(batch["maps"].to_pylist(), batch["n_chunks"].to_pylist()):
                now, *rest = [(m["head"], m["n"], m["tail"]) for m in group]
                for m in rest:
                    now = machine.compose(now, m)
                out.append(now if n_chunks > 1 else ("", machine.finish(now), None))
            head, n, tail = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch[c] for c in ("row", "doc_id", "n_bytes", "seg", "n_segs", "chunk", "n_chunks")] + [pa.array(n, pa.int64()), pa.array(head, pa.string()), pa.array(tail, pa.string())],
                names=[f.name for f in _MAPS],
            )

    whole, parted = maps.where("n_chunks = 1"), maps.where("n_chunks > 1")
    left = maps.agg(F.max("n_chunks")).first()[0] or 1
    while left > 1:
        left = -(-left // FAN)
        groups = parted.groupBy("row", "seg", F.floor(F.col("chunk") / FAN).cast("long").alias("block")).agg(
            F.first("doc_id").alias("doc_id"), F.first("n_bytes").alias("n_bytes"), F.first("n_segs").alias("n_segs"),
            F.first(F.ceil(F.col("n_chunks") / FAN).cast("long")).alias("n_chunks"),
            F.array_sort(F.collect_list(F.struct("chunk", "head", "n", "tail"))).cast(f"array<{_MAP}>").alias("maps"),
        )
        # groups of a text that is whole already stay as they are, as one map folds to itself
        parted = groups.withColumnRenamed("block", "chunk").mapInArrow(fold, _MAPS)
    counted = whole.unionByName(parted).groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_bytes").alias("n_bytes"), (F.sum("n") + F.first("n_segs") - 1).alias("n_tokens")
    )
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
