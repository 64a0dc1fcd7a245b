"""Token counts and token ids by a public tokenizer, with lookups instead of encoding.

The byte-level vocabulary never merges over a space, a line end, or from a letter to the
punctuation behind it, so a text's tokens are those of its pieces between these places. Pieces
repeat, so each worker keeps a table of the pieces it has met (by a 64-bit hash of their
bytes; bounded, begun anew when full) and encodes only misses, many in one call of the
library. Texts are cut, hashed, looked up and put together as arrays, many at a time. A
text with anything else between its words (runs of white space, other white space, strings
like those of special tokens) is encoded whole by the library, so results never depend
on this shortcut.
"""

from __future__ import annotations

import os
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearken.llm.common import in_arrow, query, table
from hearken.llm.hashing import word_hashes

VOCABULARY = "byte_bpe_50k.json"
#: Pieces in the broadcast table, and the rows of text it is drawn from. Both only
#: change the speed.
FREQUENT_PIECES = 60_000
FREQUENT_ROWS = 20_000
SAMPLED_TASKS = 32
#: Pieces a worker keeps, and slots of their table, as a power of two.
CACHE_PIECES, TABLE_BITS = 1_500_000, 22
#: Texts handled together, and characters or bytes of them that are cut and looked up at once.
GROUP, PART_BYTES = 256, 1 << 19

_UNEVEN = re.compile(r"\s{2}|[^\S \n]|<\|")
_PAIRS = ("  ", "\n\n", " \n", "\n ", "<|")
def uneven(text: str) -> bool:
    """Whether white space is anything but single spaces and single line ends, or a special
    token may begin. All other white space is not printable, so most texts need no search."""
    if any(pair in text for pair in _PAIRS):
        return True
    return not text.replace("\n", "").isprintable() and bool(_UNEVEN.search(text))


def tokenizer_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_BREAKS = np.zeros(256, bool)
_BREAKS[[0x0A, 0x20]] = True
_LETTERS = np.array([chr(b).isalpha() and b < 128 for b in range(256)])
_SIGNS = np.array([33 <= b < 127 and not chr(b).isalnum() for b in range(256)])


def cut(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pieces of ``data``, which begins with a line end: at each space or
    line end, and where a sign follows an ASCII letter."""
    byte = np.frombuffer(data, np.uint8)
    begins = _BREAKS[byte]
    begins[1:] |= _SIGNS[byte[1:]] & _LETTERS[byte[:-1]]
    start = np.flatnonzero(begins)
    return start, np.append(start[1:], len(data))


def text_pieces(text: str) -> list[str] | None:
    """Pieces of a line end followed by ``text``. None if white space is uneven."""
    if uneven(text):
        return None
    data = ("\n" + text).encode()
    return [data[a:b].decode() for a, b in zip(*(x.tolist() for x in cut(data)), strict=True)]


class PieceTable:
    """Open addressing by hash: where a piece's ids start in ``pool``, and how many they are."""

    def __init__(self, bits: int) -> None:
        self.pool = np.zeros(1 << 16, np.uint32)
        self.used = self.entries = 0
        self._clear(bits)

    def _clear(self, bits: int) -> None:
        self.bits, self.shift, self.mask = bits, np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.zeros(1 << bits, np.uint64)
        self.start, self.length = np.zeros(1 << bits, np.int32), np.zeros(1 << bits, np.int32)

    def slots(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slot of each key, or the free one where it would go, and whether it is there."""
        slot = (keys >> self.shift).astype(np.int64)
        found = self.keys[slot] == keys
        open_ = np.flatnonzero(~found & (self.keys[slot] != 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            held = self.keys[slot[open_]]
            found[open_] = held == keys[open_]
            open_ = open_[(held != 0) & (held != keys[open_])]
        return slot, found

    def add(self, keys: np.ndarray, ids: np.ndarray, length: np.ndarray) -> None:
        """Distinct new keys; ``ids`` (empty if only lengths count) of one follow another's."""
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros(max(len(ids), len(self.pool)), np.uint32)))
        self.pool[self.used : self.used + len(ids)] = ids
        if 2 * (self.entries + len(keys)) > self.mask:
            old = np.flatnonzero(self.keys)
            known = self.keys[old], self.start[old], self.length[old]
            self._clear((2 * (self.entries + len(keys))).bit_length() + 1)
            self._insert(*known)
        self._insert(keys, self.used + np.cumsum(length) - length, length)
        self.used += len(ids)
        self.entries += len(keys)

    def _insert(self, keys: np.ndarray, start: np.ndarray, length: np.ndarray) -> None:
        left = np.arange(len(keys))
        while len(left):  # of keys that want one free slot the last gets it
            slot, _ = self.slots(keys[left])
            self.keys[slot] = keys[left]
            won = self.keys[slot] == keys[left]
            at = left[won]
            self.start[slot[won]], self.length[slot[won]] = start[at], length[at]
            left = left[~won]

    def ids(self, slot: np.ndarray) -> np.ndarray:
        length = self.length[slot].astype(np.int64)
        at = np.repeat(self.start[slot] - (np.cumsum(length) - length), length)
        return self.pool[at + np.arange(len(at))]


class PieceEncoder:
    """Ids (as bytes of little-endian unsigned 32-bit integers) or counts of texts."""

    def __init__(self, path: str, counts: bool, frequent: dict[str, int] | None = None) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.counts = counts
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.opens[i] = token.startswith("Ġ")
        self.line_end = self._ids(["\n"])[0]
        # lengths of frequent pieces come with the job; ids are always learned here
        self.frequent = frequent if counts and frequent else {}
        self._reset()

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(f.ids, np.uint32) for f in found]

    def _reset(self) -> None:
        self.table = PieceTable(TABLE_BITS)
        if self.frequent:
            pieces = [p.encode() for p in self.frequent]
            keys, first = np.unique(_piece_keys(b"".join(pieces), *_edges(pieces)), return_index=True)
            length = np.array(list(self.frequent.values()), np.int64)[first]
            self.table.add(keys, np.zeros(0, np.uint32), length)

    def _learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        """Encode new pieces and enter them. Those after a space, and those after a line end, are
        encoded in one run: each starts with a token that no piece has inside."""
        for first, starts in (" ", lambda ids: self.opens[ids]), ("\n", lambda ids: ids == self.line_end[0]):
            own = [k for k, p in enumerate(pieces) if p[0] == first]
            for a in range(0, len(own), 4096):
                part = own[a : a + 4096]
                ids = self._ids(["".join([pieces[k] for k in part])])[0]
                at = np.flatnonzero(starts(ids))
                if len(at) == len(part) and not at[0]:
                    self._enter(keys[part], ids, np.diff(at, append=len(ids)))
                else:
                    self._enter_each(keys[part], [pieces[k] for k in part])
        signs = [k for k, p in enumerate(pieces) if p[0] not in " \n"]
        if signs:
            self._enter_each(keys[signs], [pieces[k] for k in signs])

    def _enter_each(self, keys: np.ndarray, pieces: list[str]) -> None:
        found = self._ids(pieces)
        self._enter(keys, np.concatenate(found), np.array([len(f) for f in found]))

    def _enter(self, keys: np.ndarray, ids: np.ndarray, length: np.ndarray) -> None:
        self.table.add(keys, ids[:0] if self.counts else ids, length)

    def lengths(self, pieces: list[str]) -> list[int]:
        """Numbers of tokens of pieces."""
        data = [p.encode() for p in pieces]
        slot = self._look_up(b"".join(data), *_edges(data))
        return self.table.length[slot].tolist()

    def _look_up(self, data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        keys = _piece_keys(data, start, end)
        slot, found = self.table.slots(keys)
        if not found.all():
            new, at = np.unique(keys[~found], return_index=True)
            a, b = start[~found][at].tolist(), end[~found][at].tolist()
            self._learn(new, [data[i:j].decode() for i, j in zip(a, b, strict=True)])
            slot, _ = self.table.slots(keys)
        return slot

    def encode(self, texts: list[str]) -> list:
        """Value of each text."""
        out: list = [0 if self.counts else b""] * len(texts)
        held: list[tuple[int, bytes]] = []
        odd: set[int] = set()
        size = 0
        for i, text in enumerate(texts):
            if uneven(text):
                odd.add(i)
                ids = self._ids([text])[0]
                out[i] = len(ids) if self.counts else ids.tobytes()
                continue
            for part in _parts("\n" + text):
                held.append((i, part))
                size += len(part)
                if size > PART_BYTES:
                    self._add_values(held, out)
                    held, size = [], 0
        self._add_values(held, out)
        for i in range(len(texts)):
            if i not in odd:  # the line end put before it
                out[i] = out[i] - len(self.line_end) if self.counts else out[i][4 * len(self.line_end) :]
        return out

    def _add_values(self, held: list[tuple[int, bytes]], out: list) -> None:
        """Add the values of parts of texts, each beginning with a piece, to their texts'."""
        if not held:
            return
        if self.table.entries > CACHE_PIECES + len(self.frequent):
            self._reset()
        parts = [part for _, part in held]
        data = b"".join(parts)
        start, end = cut(data)
        slot = self._look_up(data, start, end)
        before = np.concatenate(([0], np.cumsum(self.table.length[slot], dtype=np.int64)))
        first = np.searchsorted(start, _edges(parts)[0])
        a, b = before[first], before[np.append(first[1:], len(start))]
        if self.counts:
            for (i, _), n in zip(held, (b - a).tolist(), strict=True):
                out[i] += n
            return
        ids = self.table.ids(slot).astype("<u4").tobytes()
        for (i, _), x, y in zip(held, (4 * a).tolist(), (4 * b).tolist(), strict=True):
            out[i] = out[i] + ids[x:y] if out[i] else ids[x:y]


def _parts(text: str) -> Iterator[bytes]:
    """A text that begins with a line end, in parts that begin with a space or line end each."""
    at = 0
    while len(text) - at > PART_BYTES:
        stop = max(text.rfind(c, at + 1, at + PART_BYTES) for c in " \n")
        if stop < 0:
            later = [x for x in (text.find(c, at + 1) for c in " \n") if x > 0]
            if not later:
                break
            stop = min(later)
        yield text[at:stop].encode()
        at = stop
    yield text[at:].encode()


def _edges(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    end = np.cumsum([len(p) for p in parts])
    return end - [len(p) for p in parts], end


def _piece_keys(data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of pieces, never 0."""
    return np.maximum(word_hashes(data, start, end), np.uint64(1))


_ENCODERS: dict[tuple, PieceEncoder] = {}


def worker_encoder(path: str, counts: bool, key: str = "", frequent: dict | None = None):
    """The encoder of this Python worker, kept from task to task."""
    name = (path, counts, key)
    if name not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[name] = PieceEncoder(path, counts, frequent)
    return _ENCODERS[name]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, GROUP):
            yield batch.slice(i, GROUP)


def _frequent_pieces(docs: DataFrame, path: str, rows: int, keep: int) -> dict[str, int]:
    """Token counts of the pieces met most often in at most ``rows`` rows; at most ``keep``.

    Up to ``SAMPLED_TASKS`` tasks read the first of their rows, the others none. Tasks add
    up their own pieces before the shuffle.
    """
    stride = max(1, docs.rdd.getNumPartitions() // SAMPLED_TASKS)

    def pieces(batches):
        seen: Counter = Counter()
        left = rows // SAMPLED_TASKS if TaskContext.get().partitionId() % stride == 0 else 0
        while left > 0 and (batch := next(batches, None)):
            texts = batch.column("text").slice(0, left)
            left -= len(texts)
            for text in texts.to_pylist():
                seen.update(text_pieces(text or "") or ())
        best = seen.most_common(keep)
        yield pa.RecordBatch.from_arrays(
            [pa.array([p for p, _ in best], pa.string()), pa.array([n for _, n in best], pa.int64())],
            names=["piece", "n"],
        )

    top = (
        in_arrow(docs.select("text"), pieces, "piece string, n long")
        .groupBy("piece")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "piece")
        .limit(keep)
        .collect()
    )
    pieces = [r["piece"] for r in top]
    return dict(zip(pieces, PieceEncoder(path, counts=True).lengths(pieces), strict=True))


def count_tokens(
    docs: DataFrame,
    path: str | None = None,
    frequent_pieces: int = FREQUENT_PIECES,
    frequent_rows: int = FREQUENT_ROWS,
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of every row of ``docs``, in one pass without shuffle.

    The counts of frequent pieces are broadcast (at most ``frequent_pieces`` of them,
    found in at most ``frequent_rows`` rows); others are encoded once per worker. Null
    text counts as empty: 0 bytes, 0 tokens. Repeated rows are counted each; a null id
    stays null; other columns are ignored; an empty table gives an empty result.
    """
    path = path or tokenizer_path()
    context = docs.sparkSession.sparkContext
    frequent = context.broadcast(_frequent_pieces(docs, path, frequent_rows, frequent_pieces))

    name = uuid.uuid4().hex

    def count(batches):
        encoder = worker_encoder(path, True, name, frequent.value)
        for batch in _groups(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(t.encode()) for t in texts], pa.int64()),
                    pa.array(encoder.encode(texts), pa.int64()),
                ],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    return in_arrow(
        docs.select("doc_id", "text"), count, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long"
    )


TOKEN_LIMIT = 1024


@query()
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every whole text, and whether it exceeds 1,024 tokens."""
    return count_tokens(table(spark, sf_dir, "documents")).withColumn(
        "over_limit", F.col("n_tokens") > TOKEN_LIMIT
    )
