"""SentencePiece encoding and decoding through a table of distinct chunks."""

from __future__ import annotations

import functools
import hashlib
import re

from pyspark.sql import DataFrame

from dqloom.llm.common import annotate

MARK = "▁"  # the library's whitespace marker
# A chunk is a run of markers with the word behind it; trailing markers are a chunk of their own.
CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
TABLE_CHUNKS = 250_000  # chunks in the younger half of a worker's table; when it is full, it becomes the older half


class ChunkTable:
    """Ids and text of every distinct chunk that a worker has met.

    The model's pieces may hold markers only at their beginning (checked), so merges never cross the start of a
    chunk and a text's ids are those of its chunks in order.  Models that normalise text, drop white space or add no
    marker at the beginning, and pieces with inner markers, are refused: their texts cannot be cut this way.
    The table has two halves of bounded size and forgets what was not met since the last exchange of them; that
    costs time, never results.
    """

    def __init__(self, model_file: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("pieces cross whitespace markers; texts cannot be cut into chunks")
        probe = " a  b\tﬁ　É "
        if self.model.decode(self.model.encode(probe)) != probe or not self.model.id_to_piece(self.model.encode("a")[0]).startswith(MARK):
            raise ValueError("the model normalises text; its chunks are not parts of the text")
        self.known: dict[str, str] = {}
        self.older: dict[str, str] = {}
        self.odd: dict[str, str] = {}

    def add(self, chunks) -> None:
        """Enter the chunks that the table lacks; those of the older half are taken over."""
        known, older = self.known, self.older
        fresh = []
        for chunk in chunks:
            if (ids := older.get(chunk)) is None:
                fresh.append(chunk)
            else:
                known[chunk] = ids
        if not fresh:
            return
        # the library puts one marker before each text, which is the chunk's first one
        encoded = self.model.encode([c[1:] for c in fresh], num_threads=1)
        marker = self.model.piece_to_id(MARK)
        encoded = [ids or [marker] for ids in encoded]  # a marker alone: the library gives nothing for an empty text
        decoded = self.model.decode([[marker, *ids] for ids in encoded], num_threads=1)
        for chunk, ids, text in zip(fresh, encoded, decoded, strict=True):
            known[chunk] = ",".join(map(str, ids))
            if text != chunk.replace(MARK, " "):
                self.odd[chunk] = text

    def lookup(self, texts: list[str | None]) -> list[tuple[str, str]]:
        """Comma-joined ids and decoded text of each whole text, joined by position from those of its chunks."""
        marked = [MARK + t.replace(" ", MARK) if t else "" for t in texts]
        cut = [CHUNK.findall(t) for t in marked]
        if len(self.known) > TABLE_CHUNKS:
            self.known, self.older, self.odd = {}, self.known, {c: t for c, t in self.odd.items() if c in self.known}
        distinct: set[str] = set()
        for chunks in cut:
            distinct.update(chunks)
        self.add(distinct.difference(self.known))
        ids_of, odd = self.known.__getitem__, self.odd
        found = []
        for text, chunks in zip(marked, cut, strict=True):
            if odd:
                text = "".join([odd.get(c, c) for c in chunks])
            found.append((",".join(map(ids_of, chunks)), text.replace(MARK, " ")[1:]))
        return found


@functools.lru_cache(maxsize=2)
def table(model_file: str) -> ChunkTable:
    return ChunkTable(model_file)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def encode_ids(texts: list[str | None], model_file: str) -> list[list[int]]:
    """The ids of whole texts; null counts as empty and has none."""
    return [[int(i) for i in ids.split(",")] if ids else [] for ids, _ in table(model_file).lookup(texts)]


def encode(docs: DataFrame, model_file: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``piece_ids`` (array): the ids of each whole text."""
    return annotate(docs, "piece_ids array<int>", lambda texts: [encode_ids(texts, model_file)], text, keep)


def digests(docs: DataFrame, model_file: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of each whole text.

    Each worker segments every distinct marked word once and joins ids and decoded texts back by position.
    Null texts count as empty: no ids, and the digests of empty strings.  Repeated rows are encoded each by itself;
    an empty table gives an empty result.
    """

    def judge(texts):
        found = table(model_file).lookup(texts)
        n = [ids.count(",") + 1 if ids else 0 for ids, _ in found]
        return n, [_sha(ids) for ids, _ in found], [_sha(text) for _, text in found]

    return annotate(docs, "n_tokens long, ids_sha256 string, decoded_sha256 string", judge, text, keep)
