"""Packing of token sequences into fixed windows by the online sum-of-squares rule."""

from __future__ import annotations

import functools
import json
import zlib

import numpy as np
from pyspark.sql import DataFrame

from dqloom.llm.common import slices, small_batches

WINDOW = 1024
END = 0  # id that closes each document
OPEN_WINDOWS = 4096  # partially filled windows that a task holds; beyond, they are completed by cutting
# Fixed value: how byte-level BPE vocabularies of this kind cut text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PIECE = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Encoder:
    """Ids of whole texts under a vocabulary file of the ``tokenizers`` library.

    The same vocabulary is given to a faster merger of byte pairs.  It is used where it agrees with the library on
    probes; texts that hold the string of a special token always go to the library itself.
    """

    PROBES = ("", " a  b\n\n c's 12é\t🙂 don't\r\n  x ", "Ünïcode—text ﬁ  ...!!  1234 　 .", "\x00﻿áe")

    def __init__(self, vocabulary: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(vocabulary)
        with open(vocabulary, encoding="utf-8") as file:
            found = json.load(file)
        self.special = [t["content"] for t in found.get("added_tokens", [])]
        # byte-level vocabularies write each byte as a printable character: itself, or the next free one from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        to_byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
        vocab = {t: i for t, i in found["model"]["vocab"].items() if t not in self.special}
        ranks = {bytes(to_byte[c] for c in token): i for token, i in vocab.items()}
        self.fast = tiktoken.Encoding("packing", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
        if any(self.fast.encode_ordinary(p) != self._slow(p) for p in self.PROBES):
            self.fast = None

    def _slow(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def __call__(self, text: str | None) -> np.ndarray:
        """The ids of ``text`` (null: none) and the closing id."""
        if not text:
            ids = []
        elif self.fast is None or any(s in text for s in self.special):
            ids = self._slow(text)
        else:
            ids = self.fast.encode_ordinary(text)
        return np.array([*ids, END], dtype="<u4")


@functools.lru_cache(maxsize=2)
def encoder(vocabulary: str) -> Encoder:
    return Encoder(vocabulary)


class Packer:
    """Online packing; the state is an array of how many open windows have each fill level.

    An item goes to the level that minimises the sum of squared counts of partially filled windows.  Windows whose
    level is a power of two need no padding, so they are not counted, nor are empty and full ones; of equal choices
    the fullest level is taken.  An item is (key, ids, first, last, whole length): a slice of a document's ids.
    """

    def __init__(self, window: int, first_id: int):
        self.window, self.next_id = window, first_id
        self.counts = np.zeros(window + 1, dtype=np.int64)
        self.open: list[list] = [[] for _ in range(window + 1)]
        levels = np.arange(window + 1)
        self.counted = ((levels & (levels - 1)) != 0) & (levels < window)
        self.done: list[tuple] = []

    def add(self, key, ids: np.ndarray) -> None:
        total, full = len(ids), len(ids) - len(ids) % self.window
        for start in range(0, full, self.window):
            self._close([(key, ids, start, start + self.window, total)])
        if full < total:
            self._place((key, ids[full:].copy() if full else ids, full, total, total))
        if self.counts.sum() > OPEN_WINDOWS:
            self.drain()

    def _place(self, item: tuple) -> None:
        size = item[3] - item[2]
        levels = slice(0, self.window + 1 - size)
        leave = np.where(self.counted[levels], 1 - 2 * self.counts[levels], 0)
        reach = np.where(self.counted[size:], 1 + 2 * self.counts[size:], 0)
        change = np.where(self.counts[levels] > 0, leave + reach, np.iinfo(np.int64).max)
        change[0] = reach[0]  # a new window
        level = len(change) - 1 - int(np.argmin(change[::-1]))
        items = self.open[level].pop() if level else []
        self.counts[level] -= level > 0
        items.append(item)
        if level + size == self.window:
            self._close(items)
        else:
            self.open[level + size].append(items)
            self.counts[level + size] += 1

    def _close(self, items: list[tuple]) -> None:
        offset = 0
        for key, ids, first, last, total in items:
            base = total - len(ids)  # a kept remainder starts there
            part = ids[first - base : last - base]
            self.done.append((key, first, last - first, zlib.crc32(part.tobytes()), total, self.next_id, offset, part))
            offset += last - first
        self.next_id += 1

    def drain(self) -> None:
        """Complete all open windows: the emptiest are cut up to fill the fullest; one at most stays short."""
        ready = [(n, items) for n in range(1, self.window) for items in self.open[n]]
        self.open, self.counts = [[] for _ in range(self.window + 1)], np.zeros(self.window + 1, dtype=np.int64)
        for n, items in ready:
            if not self.counted[n]:
                self._close(items)
        ready = [r for r in ready if self.counted[r[0]]]
        low = 0
        for high in range(len(ready) - 1, -1, -1):
            level, items = ready[high]
            while level < self.window and low < high:
                source = ready[low][1]
                key, ids, first, last, total = source.pop()
                cut = min(last, first + self.window - level)
                items.append((key, ids, first, cut, total))
                level += cut - first
                if cut < last:
                    source.append((key, ids, cut, last, total))
                elif not source:
                    low += 1
            if items:
                self._close(items)
            if high <= low:
                break

    def take(self) -> list[tuple]:
        done, self.done = self.done, []
        return done


def pack(
    docs: DataFrame, vocabulary: str, identifier: str = "doc_id", text: str = "text", window: int = WINDOW, with_ids: bool = False
) -> DataFrame:
    """Pieces of all documents in sequences of at most ``window`` ids: one row per piece.

    Columns: the identifier, ``start`` (ids of the document before the piece), ``length``, ``ids_crc32`` (of the ids
    as little-endian unsigned 32-bit numbers), ``doc_tokens`` (with the closing id), ``sequence_id``, ``offset``
    (in the sequence, gapless from 0) and, on demand, ``ids``.

    Each task packs the documents of its partition as they come, holding the level array, the ids in open windows
    (at most ``OPEN_WINDOWS`` of them) and one batch; nothing is shuffled.  Documents longer than a window are cut
    at its multiples and only their ends are placed.  What is open when the input ends is completed by cutting, so
    a task pads one window at most.  Sequence numbers start at the task's number times 2^40, so a task that runs
    again makes the same rows.  Null and empty texts are the closing id alone; null and repeated identifiers are
    kept as they are; an empty table has no pieces.
    """
    import pyarrow as pa
    from pyspark import TaskContext
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    if window < 1:
        raise ValueError("window must be positive")
    small_batches(docs.sparkSession)
    source = docs.select(docs[identifier], docs[text].alias("__text"))
    added = _parse_datatype_string(PIECE + (", ids array<int>" if with_ids else ""))
    schema = StructType([source.schema.fields[0], *added.fields])
    arrow = to_arrow_schema(schema)

    def run(batches):
        packer = Packer(window, TaskContext.get().partitionId() << 40)
        encode = encoder(vocabulary)

        def rows():
            found = packer.take()
            columns = [list(c) for c in zip(*found, strict=True)] or [[] for _ in range(8)]
            if not with_ids:
                columns.pop()
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)], names=arrow.names)

        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices([len(t or "") for t in texts]):
                for key, content in zip(keys[a:b], texts[a:b], strict=True):
                    packer.add(key, encode(content))
                yield rows()
        packer.drain()
        yield rows()

    return source.mapInArrow(run, schema)
