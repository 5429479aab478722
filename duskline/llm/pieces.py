"""SentencePiece encoding and decoding: Unigram Viterbi over a double-array trie of pieces.

The model file's pieces and scores are read as log scores of a unigram model. A text becomes the sequence of pieces with
the greatest total score; characters that no piece covers fall back to the pieces of their UTF-8 bytes. The trie and
the Viterbi steps run on numpy arrays over many words at a time: no piece holds the white-space marker behind another
character, so a text can be cut before every marker, and equal words of a batch are worked out once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from .common import filled, widened

#: White space is written as this character, also in front of every text.
MARK = "▁"
#: What a character outside all pieces costs below the lowest score.
UNKNOWN_PENALTY = 10.0
#: Types of pieces in the model file.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Words kept with their pieces from batch to batch in a worker, words worked out together, rows to a batch.
MEMORY, TOGETHER, ROWS = 400_000, 20_000, 256


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and raw values of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind)
            size = varint() if size is None else size
            yield key >> 3, data[at:at + size]
            at += size


@dataclass(frozen=True)
class Pieces:
    """The vocabulary: texts, log scores and types of the pieces by id."""

    texts: tuple[str, ...]
    scores: np.ndarray
    types: np.ndarray


def parse(model: bytes) -> Pieces:
    """Read a SentencePiece model file."""
    texts, scores, types = [], [], []
    for number, value in _fields(model):
        if number == 1:
            piece = dict(_fields(value))
            texts.append(piece.get(1, b"").decode())
            scores.append(float(np.frombuffer(piece[2], "<f4")[0]) if 2 in piece else 0.0)
            types.append(piece.get(3, NORMAL))
    return Pieces(tuple(texts), np.array(scores), np.array(types))


class Trie:
    """A double-array trie: the child of state s by symbol c is base[s] + c if check says that it belongs to s."""

    def __init__(self, pieces: Pieces):
        matched = [i for i, t in enumerate(pieces.types) if t in (NORMAL, USER, UNUSED) and pieces.texts[i]]
        symbols = sorted({c for i in matched for c in pieces.texts[i]})
        #: Symbol of a code point; 0 is none.
        self.symbol = np.zeros(0x110000, np.int32)
        self.symbol[[ord(c) for c in symbols]] = np.arange(1, len(symbols) + 1)
        children: list[dict[int, int]] = [{}]
        piece_at = {}
        for i in matched:
            node = 0
            for s in self.symbol[[ord(c) for c in pieces.texts[i]]].tolist():
                node = children[node].setdefault(s, len(children))
                if node == len(children):
                    children.append({})
            piece_at[node] = i
        # Bases: nodes with many children are fitted first, into the emptiest array; single children fill the gaps.
        # Slots start past the largest symbol, so no base is negative.
        low = len(symbols) + 1
        taken = np.zeros(low + 4 * len(children) + len(symbols), bool)
        taken[:low] = True
        base = np.zeros(len(children), np.int64)
        order = sorted((n for n in range(len(children)) if children[n]), key=lambda n: -len(children[n]))
        many = [n for n in order if len(children[n]) > 1]
        hint = 1
        for n in many:
            keys = np.array(sorted(children[n]), np.int64)
            start = hint
            while True:
                starts = np.arange(start, start + 512)
                if start + 512 + low >= len(taken):
                    taken = np.append(taken, np.zeros(len(taken), bool))
                fits = np.flatnonzero(~taken[starts[:, None] + keys].any(axis=1))
                if len(fits):
                    base[n] = start + fits[0]
                    break
                start += 512
            taken[base[n] + keys] = True
            if len(fits) < 8 and start > hint:
                hint = start - 512  # the array is nearly full before this
        singles = order[len(many):]
        taken = np.append(taken, np.zeros(len(singles), bool))
        for n, slot in zip(singles, np.flatnonzero(~taken)[:len(singles)].tolist()):
            base[n] = slot - next(iter(children[n]))
        place = np.zeros(len(children), np.int64)
        room = int(base.max(initial=0)) + 2 * low + 1
        self.base, self.check = np.zeros(room, np.int64), np.full(room, -1, np.int64)
        self.piece = np.full(room, -1, np.int64)
        for n in _downward(children):
            state = int(place[n])
            self.piece[state], self.base[state] = piece_at.get(n, -1), base[n]
            for symbol, child in children[n].items():
                place[child] = base[n] + symbol
                self.check[base[n] + symbol] = state

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Child states, -1 where there is none."""
        to = self.base[state] + symbol
        return np.where((symbol > 0) & (self.check[to] == state), to, -1)


def _downward(children: list[dict[int, int]]) -> Iterator[int]:
    """Nodes, parents before children."""
    level = [0]
    while level:
        yield from level
        level = [c for n in level for c in children[n].values()]


class Unigram:
    """Encoder and decoder of one model file."""

    def __init__(self, model: bytes):
        self.pieces = parse(model)
        self.trie = Trie(self.pieces)
        p = self.pieces
        normal = p.scores[p.types == NORMAL]
        self.unknown_score = (normal.min() if len(normal) else 0.0) - UNKNOWN_PENALTY
        self.unknown = int(np.flatnonzero(p.types == UNKNOWN)[0]) if (p.types == UNKNOWN).any() else 0
        bytes_at = {int(p.texts[i][3:5], 16): int(i) for i in np.flatnonzero(p.types == BYTE)}
        self.byte_ids = [bytes_at[b] for b in range(256)] if len(bytes_at) == 256 else None
        self.longest = max((len(t) for t in p.texts), default=1)
        inner = any(MARK in t.lstrip(MARK) for i, t in enumerate(p.texts) if p.types[i] in (NORMAL, USER, UNUSED))
        self.cut = re.compile(r"(?s).+" if inner else rf"(?s){MARK}+[^{MARK}]*|[^{MARK}]+")
        self.memory: dict[str, bytes] = {}  # words and their ids as bytes
        self.plain = [b"" if t in (UNKNOWN, CONTROL) else bytes([int(x[3:5], 16)]) if t == BYTE else x.encode()
                      for x, t in zip(p.texts, p.types)]
        self.plain[self.unknown] = " ⁇ ".encode()

    def _viterbi(self, words: Sequence[str]) -> list[bytes]:
        """Pieces of each word. Words of like length are worked out together, position by position."""
        size = np.array([len(w) for w in words])
        width, n = int(size.max()), len(words)
        codes = np.zeros((n, width), np.int64)
        flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
        codes[np.arange(width)[None, :] < size[:, None]] = flat
        symbols = self.trie.symbol[codes].astype(np.int64)
        symbols[np.arange(width)[None, :] >= size[:, None]] = 0
        best = np.full((n, width + 1), -np.inf)
        best[:, 0] = 0
        came, by = np.zeros((n, width + 1), np.int32), np.full((n, width + 1), -1, np.int32)
        scores, trie = self.pieces.scores, self.trie
        for at in range(width):
            rows = np.flatnonzero(size > at)
            state = np.zeros(len(rows), np.int64)
            here = best[rows, at]
            single = np.zeros(len(rows), bool)
            first = np.arange(len(rows))
            for to in range(at + 1, min(at + self.longest, width) + 1):
                state = trie.step(state, symbols[rows, to - 1])
                on = state >= 0
                rows, state, here, first = rows[on], state[on], here[on], first[on]
                if not len(rows):
                    break
                piece = trie.piece[state]
                hit = piece >= 0
                if to == at + 1:
                    single[first[hit]] = True
                total = here[hit] + scores[piece[hit]]
                r = rows[hit]
                better = total > best[r, to]
                r = r[better]
                best[r, to], came[r, to], by[r, to] = total[better], at, piece[hit][better]
            rows = np.flatnonzero(size > at)[~single]
            total = best[rows, at] + self.unknown_score
            better = total > best[rows, at + 1]
            rows = rows[better]
            best[rows, at + 1], came[rows, at + 1], by[rows, at + 1] = total[better], at, -1
        # Back along the best ways, one piece of every word at a time, from the last to the first.
        at, left, rows_of, ids_of = size.copy(), np.arange(n), [], []
        while len(left):
            ids_of.append(by[left, at[left]])
            rows_of.append(left)
            at[left] = came[left, at[left]]
            left = left[at[left] > 0]
        rows, ids = np.concatenate(rows_of[::-1]), np.concatenate(ids_of[::-1])
        order = np.argsort(rows, kind="stable")
        data = ids[order].astype(np.int32).tobytes()
        ends = (np.cumsum(np.bincount(rows, minlength=n)) * 4).tolist()
        out = [data[a:b] for a, b in zip([0, *ends[:-1]], ends)]
        for i in np.unique(rows[ids < 0]).tolist():
            out[i] = self._with_unknown(words[i], by[i], came[i])
        return out

    def _with_unknown(self, word: str, by: np.ndarray, came: np.ndarray) -> bytes:
        """Ids of a word in which characters without a piece give way to their bytes."""
        ids: list[int] = []
        to = len(word)
        while to:
            start = int(came[to])
            if by[to] >= 0:
                ids.append(int(by[to]))
            elif self.byte_ids:
                ids.extend(self.byte_ids[b] for b in reversed(word[start:to].encode("utf-8", "replace")))
            else:
                ids.append(self.unknown)
            to = start
        return np.array(ids[::-1], np.int32).tobytes()

    def encode(self, texts: Sequence[str]) -> list[np.ndarray]:
        """Piece ids of each text. An empty text has none."""
        cut = [self.cut.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self.memory) > MEMORY:
            self.memory.clear()
        known = self.memory
        new = sorted({w for words in cut for w in words if w not in known}, key=len)
        at = 0
        while at < len(new):
            # Longer words go fewer at a time, so the tables of a step stay about as large.
            most = max(1, TOGETHER * 8 // max(8, len(new[min(at + TOGETHER, len(new)) - 1])))
            part = new[at:at + most]
            known.update(zip(part, self._viterbi(part)))
            at += most
        return [np.frombuffer(b"".join([known[w] for w in words]), np.int32) for words in cut]

    def decode(self, ids: Sequence[int]) -> str:
        """The text of piece ids: bytes are put together, markers become spaces, the one in front goes."""
        plain = self.plain
        text = b"".join([plain[i] for i in ids]).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


_loaded: dict[int, Unigram] = {}


def _model(shared) -> Unigram:
    """One encoder per worker process and model."""
    if shared.id not in _loaded:
        _loaded.clear()
        _loaded[shared.id] = Unigram(shared.value)
    return _loaded[shared.id]


class _Shared:
    """The model file's bytes, sent to the executors once (the file need not exist there)."""

    def __init__(self, docs: DataFrame, model: bytes):
        self.sent = docs.sparkSession.sparkContext.broadcast(model)
        self.id = hash(model)

    @property
    def value(self) -> bytes:
        return self.sent.value


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def encode(docs: DataFrame, model: bytes, text: str = "text", out: str = "tokens") -> DataFrame:
    """Add ``out``: array<int> of piece ids of each whole text; null text is empty and has no pieces.

    Markers in a text are taken for spaces, as the format does. Rows are worked on alone, so repeated rows come out
    alike. The input must not have a column named ``out``.
    """
    shared = _Shared(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unigram = _model(shared)
        for batch in _few(batches):
            ids = unigram.encode([t or "" for t in batch.column(text).to_pylist()])
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            values = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(ends), values)],
                                             names=[*batch.schema.names, out])

    return docs.mapInArrow(run, widened(docs.schema, {out: ArrayType(IntegerType())}))


def decode(rows: DataFrame, model: bytes, tokens: str = "tokens", out: str = "decoded") -> DataFrame:
    """Add ``out``: the text of an array of piece ids (null: empty)."""
    shared = _Shared(rows, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unigram = _model(shared)
        for batch in _few(batches):
            texts = [unigram.decode(ids or ()) for ids in batch.column(tokens).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())],
                                             names=[*batch.schema.names, out])

    return rows.mapInArrow(run, widened(rows.schema, {out: StringType()}))


def there_and_back(docs: DataFrame, model: bytes, text: str = "text", out: str = "tokens", back: str = "decoded") -> DataFrame:
    """``encode`` and ``decode`` in one pass: a task then has one Python worker with the model and its words, not two, and
    workers keep them for as long as they live."""
    shared = _Shared(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unigram = _model(shared)
        for batch in _few(batches):
            ids = unigram.encode([t or "" for t in batch.column(text).to_pylist()])
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            values = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32))
            texts = pa.array([unigram.decode(x.tolist()) for x in ids], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(ends), values), texts],
                                             names=[*batch.schema.names, out, back])

    return docs.mapInArrow(run, widened(docs.schema, {out: ArrayType(IntegerType()), back: StringType()}))


def tokenise(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id, n_chars, n_tokens, tokens_sha256 (of the comma-joined ids) and round_trip for every whole text.

    ``round_trip``: the decoded ids give the text back, its markers read as spaces.
    """
    back = there_and_back(docs.select("doc_id", filled("text").alias("text")), model)
    return back.select("doc_id", F.length("text").cast("long").alias("n_chars"),
                       F.size("tokens").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("tokens").cast("array<string>"), ","), 256).alias("tokens_sha256"),
                       (F.col("decoded") == F.replace("text", F.lit(MARK), F.lit(" "))).alias("round_trip"))
