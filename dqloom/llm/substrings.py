"""Removal of passages that repeat earlier text, found through fixed-block anchors."""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dqloom.llm.common import cut_lineage, small_batches
from dqloom.llm.words import SEPARATORS, Words

WINDOW = 20  # words of a repeat at least
CHUNK_CHARS = 1 << 21  # characters of the documents that are looked at together in a task
BUCKET_WORDS = 1 << 21  # windows that meet in one group
_SPACES = bytes.maketrans(SEPARATORS, b" " * len(SEPARATORS))
_U = np.uint64


def _block(window: int) -> int:
    """The longest block of which every window holds a whole one, wherever the blocks begin."""
    return (window + 1) // 2


def chunks(docs: DataFrame, identifier: str, text: str) -> DataFrame:
    """(chunk, docs, words, body): groups of whole documents, compressed.  A longer document is a chunk of its own."""
    from pyspark import TaskContext

    small_batches(docs.sparkSession)

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        packer = zstandard.ZstdCompressor(level=3)
        keys, nulls, bodies, held = [], [], [], 0

        def row():
            nonlocal number
            number += 1
            sizes = np.array([len(b) for b in bodies], dtype=np.int64).tobytes()
            return pd.DataFrame({"chunk": [number], "ids": [np.array(keys, dtype=np.int64).tobytes()], "nulls": [np.array(nulls, dtype=bool).tobytes()],
                                 "sizes": [sizes], "body": [packer.compress(b"".join(bodies))], "chars": [held]})

        for pdf in batches:
            for key, content in zip(pdf["id"].tolist(), pdf["text"].tolist(), strict=True):
                content = content or ""
                if held and held + len(content) > CHUNK_CHARS:
                    yield row()
                    keys, nulls, bodies, held = [], [], [], 0
                nulls.append(key is None or key != key)
                keys.append(0 if nulls[-1] else int(key))
                bodies.append(content.encode("utf-8", "surrogatepass"))
                held += len(content)
        if bodies:
            yield row()

    # identifiers travel as text, so that nulls among them do not turn large ones into floats
    source = docs.select(docs[identifier].cast("string").alias("id"), docs[text].alias("text"))
    return source.mapInPandas(run, "chunk long, ids binary, nulls binary, sizes binary, body binary, chars long")


class _Chunk:
    """The words of a chunk's documents, in order of their identifiers; null identifiers come last."""

    def __init__(self, row):
        ids = np.frombuffer(row["ids"], dtype=np.int64)
        nulls = np.frombuffer(row["nulls"], dtype=bool)
        sizes = np.frombuffer(row["sizes"], dtype=np.int64)
        body = zstandard.ZstdDecompressor().decompress(row["body"]) if sizes.sum() else b""
        stops = np.cumsum(sizes)
        self.order = np.lexsort((ids, nulls))
        self.ids, self.nulls = ids[self.order], nulls[self.order]
        self.bodies = [body[stops[i] - sizes[i] : stops[i]] for i in self.order.tolist()]
        words = Words([b.decode("utf-8", "surrogatepass") for b in self.bodies], lower=False)
        self.words = words
        self.count = words.count
        first = np.cumsum(self.count) - self.count
        self.position = np.arange(len(words.hash)) - first[words.owner]  # of each word in its document

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the rolling windows and the index of their first words; windows end with their document."""
        rolled = self.words.rolling(size)
        owner = self.words.owner
        at = np.flatnonzero((owner[: len(rolled)] == owner[size - 1 : size - 1 + len(rolled)]) & ~self.nulls[owner[: len(rolled)]])
        return rolled[at], at


def _place(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and 32-bit remainder of 64-bit hashes, both rising with the hash.

    They are the upper bits of hash times buckets, so the remainder goes on where the bucket ends: a bucket of two
    million words has a fresh probe collide once in two thousand times, whatever the number of buckets.
    """
    code = (hashes >> _U(32)) * _U(buckets) + ((hashes & _U(0xFFFFFFFF)) * _U(buckets) >> _U(32))
    return (code >> _U(32)).astype(np.int64), (code & _U(0xFFFFFFFF)).astype(np.uint32)


def _pack_rising(values: np.ndarray) -> bytes:
    """Rising 32-bit numbers as the bytes of their differences, all first bytes, then all second ones and so on.

    The high bytes of the differences are mostly zero, which the shuffle's compression removes.
    """
    return np.diff(values, prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpack_rising(packed: bytes) -> np.ndarray:
    parts = np.frombuffer(packed, dtype=np.uint8).reshape(4, -1).T
    return np.cumsum(np.ascontiguousarray(parts).view("<u4").ravel(), dtype=np.uint32)


def _flags(packed: list[bytes], sizes: np.ndarray) -> np.ndarray:
    bits = [np.unpackbits(np.frombuffer(p, dtype=np.uint8), count=n) for p, n in zip(packed, sizes.tolist(), strict=True)]
    return np.concatenate(bits).astype(bool)


def _pack_flags(values: np.ndarray) -> bytes:
    return np.packbits(values).tobytes()


def _spread(chunk: int, bucket: np.ndarray, columns: dict) -> pd.DataFrame:
    """One row per bucket of entries that are sorted by bucket; a column is its values and how a bucket's are packed."""
    edges = np.flatnonzero(np.diff(bucket, prepend=-1))
    stops = np.append(edges[1:], len(bucket)) if len(bucket) else edges
    frame = {"chunk": chunk, "bucket": bucket[edges]}
    for name, (values, pack) in columns.items():
        frame[name] = [pack(values[a:b]) for a, b in zip(edges.tolist(), stops.tolist(), strict=True)]
    return pd.DataFrame(frame)


def _probes(row, block: int, buckets: int):
    """The chunk's distinct probes in order of bucket and remainder, and the probe of every window of ``block`` words.

    Returns bucket, remainder, whether one of the occurrences is a reference block, whether there are several, then
    the windows' first words and their place among the distinct probes.
    """
    chunk = _Chunk(row)
    hashes, at = chunk.windows(block)
    bucket, rest = _place(hashes, buckets)
    code = (bucket.astype(np.uint64) << _U(32)) | rest
    distinct, inverse, count = np.unique(code, return_inverse=True, return_counts=True)
    is_block = np.zeros(len(distinct), dtype=bool)
    is_block[inverse[chunk.position[at] % block == 0]] = True
    return chunk, (distinct >> _U(32)).astype(np.int64), distinct.astype(np.uint32), is_block, count > 1, at, inverse


def _rows(pdf: pd.DataFrame) -> list[dict]:
    return pdf.to_dict("records")


def _index(window: int, buckets: int):
    block = _block(window)

    def run(batches):
        for pdf in batches:
            for row in _rows(pdf):
                _, bucket, rest, is_block, several, *_ = _probes(row, block, buckets)
                if len(bucket):
                    yield _spread(row["chunk"], bucket, {"probes": (rest, _pack_rising), "blocks": (is_block, _pack_flags), "several": (several, _pack_flags)})

    return run


def _answer(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each chunk's probes of this bucket: 1 if the words occur elsewhere too, 3 if one occurrence is a block."""
    sizes = pdf["probes"].map(len).to_numpy() // 4
    probes = np.concatenate([_unpack_rising(p) for p in pdf["probes"]])
    distinct, inverse = np.unique(probes, return_inverse=True)
    count = np.bincount(inverse, weights=1 + _flags(pdf["several"], sizes), minlength=len(distinct)) > 1
    anchored = np.zeros(len(distinct), dtype=bool)
    anchored[inverse[_flags(pdf["blocks"], sizes)]] = True
    found = (count.astype(np.uint8) + 2 * (count & anchored).astype(np.uint8))[inverse]
    stops = np.cumsum(sizes)
    packed = [zstandard.compress(found[e - n : e].tobytes(), 1) for e, n in zip(stops.tolist(), sizes.tolist(), strict=True)]
    return pd.DataFrame({"chunk": pdf["chunk"], "bucket": pdf["bucket"], "turn": 1, "found": packed})


def _gather(replies: pd.DataFrame, turn: int) -> np.ndarray:
    """The answers of one turn in order of the chunk's entries."""
    own = replies[replies["turn"] == turn].sort_values("bucket")
    return np.frombuffer(b"".join(zstandard.decompress(f) for f in own["found"]), dtype=np.uint8)


def _groups(hashes: np.ndarray, checks: np.ndarray, *within: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by both hashes, then ``within`` (the last first), and where in it another window begins; stable."""
    order = np.lexsort((*within, checks, hashes))
    lead = np.ones(len(order), dtype=bool)
    lead[1:] = (np.diff(hashes[order]) != 0) | (np.diff(checks[order]) != 0)
    return order, lead


def _repeats(row, replies: pd.DataFrame, window: int, buckets: int):
    """Windows that lie in a maximal run of repeated probes which holds an anchor; sorted by hash, then in order.

    Returns the chunk, both hashes of the distinct windows, the first occurrence of each and all windows with their
    place.
    """
    block = _block(window)
    chunk, _, _, _, _, at, inverse = _probes(row, block, buckets)
    n = len(chunk.words.hash)
    # a window is as many probes as it has places for a block; all must be repeated, and one must hit an anchor
    inner = window - block + 1
    repeated, anchored = np.zeros(n + 1, dtype=np.int32), np.zeros(n + 1, dtype=np.int32)
    found = _gather(replies, 1)[inverse] if len(at) else np.zeros(0, np.uint8)
    repeated[at[found > 0] + 1], anchored[at[found == 3] + 1] = 1, 1
    repeated, anchored = np.cumsum(repeated), np.cumsum(anchored)
    hashes, first = chunk.windows(window)
    use = (repeated[first + inner] - repeated[first] == inner) & (anchored[first + inner] > anchored[first])
    hashes, first = hashes[use], first[use]
    checks = chunk.words.rolling_check(window)[first] if len(first) else hashes
    order, lead = _groups(hashes, checks)
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.cumsum(lead) - 1
    earliest = order[lead]
    return chunk, hashes[earliest], checks[earliest], first[earliest], first, place


def _claim(window: int, buckets: int):
    """Each chunk's distinct repeated windows with their first occurrence in it."""

    def run(key, pdf: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        found = []
        for row in _rows(pdf):
            chunk, distinct, checks, first, *_ = _repeats(row, replies, window, buckets)
            bucket, rest = _place(distinct, buckets)
            ids = chunk.ids[chunk.words.owner[first]]
            columns = {"checks": checks, "ids": ids, "starts": chunk.position[first].astype(np.uint32)}
            packed = {name: (values, np.ndarray.tobytes) for name, values in columns.items()}
            found.append(_spread(row["chunk"], bucket, {"rests": (rest, _pack_rising), **packed}))
        return pd.concat(found) if found else pd.DataFrame({c: [] for c in ("chunk", "bucket", "rests", "checks", "ids", "starts")})

    return run


def _settle(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each chunk's windows of this bucket: 1 if the same words start earlier in another chunk.

    Windows are the same if they agree in the bucket, the 32 bits behind it and the 64 bits of the other hash.
    """
    sizes = pdf["rests"].map(len).to_numpy() // 4
    rests = np.concatenate([_unpack_rising(p) for p in pdf["rests"]])
    checks = np.frombuffer(b"".join(pdf["checks"]), dtype=np.uint64)
    ids = np.frombuffer(b"".join(pdf["ids"]), dtype=np.int64)
    starts = np.frombuffer(b"".join(pdf["starts"]), dtype=np.uint32)
    order, lead = _groups(rests, checks, starts, ids)
    sorted_ids, sorted_starts = ids[order], starts[order]
    group = np.cumsum(lead) - 1
    heads = np.flatnonzero(lead)[group]
    later = (sorted_ids != sorted_ids[heads]) | (sorted_starts != sorted_starts[heads])
    found = np.zeros(len(order), dtype=np.uint8)
    found[order] = later
    stops = np.cumsum(sizes)
    packed = [zstandard.compress(found[e - n : e].tobytes(), 1) for e, n in zip(stops.tolist(), sizes.tolist(), strict=True)]
    return pd.DataFrame({"chunk": pdf["chunk"], "bucket": pdf["bucket"], "turn": 2, "found": packed})


RESULT = "id string, n_words long, n_removed long, kept string, kept_sha256 string"


def _remove(window: int, buckets: int, with_text: bool):
    def run(key, pdf: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        made = []
        for row in _rows(pdf):
            chunk, distinct, _, earliest, first, place = _repeats(row, replies, window, buckets)
            later = _gather(replies, 2).astype(bool) if len(distinct) else np.zeros(0, bool)
            # a window goes if its words start earlier elsewhere or earlier in this chunk; equal places are one document
            owner, position = chunk.words.owner, chunk.position
            head = earliest[place]
            gone = later[place] | (chunk.ids[owner[first]] != chunk.ids[owner[head]]) | (position[first] != position[head])
            cover = np.zeros(len(owner) + 1, dtype=np.int32)
            np.add.at(cover, first[gone], 1)
            np.add.at(cover, first[gone] + window, -1)
            kept = np.cumsum(cover[:-1]) == 0
            stops = np.cumsum(chunk.count)
            for i, (stop, n) in enumerate(zip(stops.tolist(), chunk.count.tolist(), strict=True)):
                own = kept[stop - n : stop]
                words = chunk.bodies[i].translate(_SPACES).split()
                left = b" ".join(words if own.all() else itertools.compress(words, own))
                made.append((None if chunk.nulls[i] else str(chunk.ids[i]), n, n - int(own.sum()), left.decode("utf-8", "surrogatepass") if with_text else None,
                             hashlib.sha256(left).hexdigest()))
        return pd.DataFrame(made, columns=["id", "n_words", "n_removed", "kept", "kept_sha256"]).astype({"id": object, "kept": object, "kept_sha256": object})

    return run


def remove_repeats(docs: DataFrame, identifier: str = "doc_id", text: str = "text", window: int = WINDOW, with_text: bool = True) -> DataFrame:
    """(identifier, ``n_words``, ``n_removed``, ``kept``, ``kept_sha256``), one row per row of ``docs``.

    A word goes if a window of ``window`` consecutive words covers it whose words also start earlier: in a document
    with a smaller identifier, or earlier in the same one.  Windows are judged on the input.

    1. Every document is cut into non-overlapping reference blocks; any window holds one.  Each chunk of documents
       sends its distinct rolling block-long probes, marked where a probe is a block, to groups by hash.  The
       groups answer which probes occur again and which of these meet a block, their anchor.
    2. From its anchors each chunk extends over the neighbouring repeated probes to maximal repeats, and claims
       their windows, each distinct one once, with its first place.
    3. Groups of equal windows settle which place is the earliest; the others' words go.  Windows are compared by two
       independent hashes, together 96 bits and those of the number of buckets.

    Probes and answers are packed arrays, about three bytes a word, and copies within a chunk are merged before the shuffle,
    so a hot passage sends one entry per chunk.  Groups are bounded by the number of buckets, which grows with the
    text.  Nothing is capped.  Null and empty texts have no words.  Rows that repeat an identifier and a place in
    the text are the same place.  Rows with a null identifier lose nothing and make nothing go.  An empty table gives
    an empty result.
    """
    if window < 1:
        raise ValueError("window must be positive")
    grouped = cut_lineage(chunks(docs, identifier, text))
    chars = grouped.agg(F.sum("chars")).first()[0] or 0
    buckets = max(8, chars // (5 * BUCKET_WORDS))
    probes = grouped.mapInPandas(_index(window, buckets), "chunk long, bucket long, probes binary, blocks binary, several binary")
    answer = "chunk long, bucket long, turn int, found binary"
    first = cut_lineage(probes.groupBy("bucket").applyInPandas(_answer, answer))
    claims = grouped.groupBy("chunk").cogroup(first.groupBy("chunk")).applyInPandas(
        _claim(window, buckets), "chunk long, bucket long, rests binary, checks binary, ids binary, starts binary"
    )
    both = first.union(cut_lineage(claims.groupBy("bucket").applyInPandas(_settle, answer)))
    found = grouped.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInPandas(_remove(window, buckets, with_text), RESULT)
    kind = docs.schema[identifier].dataType
    columns = ["n_words", "n_removed", *(["kept"] if with_text else []), "kept_sha256"]
    return found.select(F.col("id").cast(kind).alias(identifier), *columns)
