"""Spelling variants: words one edit apart, found by probing generated edits against Bloom filters."""

from __future__ import annotations

import functools
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dqloom.llm.common import cut_lineage, small_batches

LEAST_LENGTH = 7
LEAST_COUNT = 2
RATIO = 10  # a form is at least so many times as frequent as its variant
LOSSY = 31  # the query's contract deletes a letter of every occurrence whose hash this divides
BITS_A_WORD = 16
BITS_SET = 5  # bits a word sets in its 64-bit block
SHARD_WORDS = 1 << 14  # words of one filter, about: 32 KB
FILTER_BYTES = 1 << 25  # bytes of filters that are broadcast together; more words take more passes
PROBES = 1 << 20  # probes that a task holds at a time
TABLE_WORDS = 200_000  # distinct words that a counting task holds before it hands on its counts
CUT = 1 << 20  # characters of a text that are looked at together

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOWER = {c: c + 32 for c in range(65, 91)}
# A run of letters: basic Latin ones and what Latin-1 has from C0 on.
RUN = re.compile("[A-Za-zÀ-ÿ]+")


# -- counting ------------------------------------------------------------------------------------------------------


def runs_of(text: str):
    """Lists of the runs of a text, a bounded stretch of it at a time."""
    start = 0
    while start < len(text):
        end = start + CUT
        if end < len(text):
            # a run is never cut: the stretch ends behind the one that reaches over its end
            last = RUN.match(text, end)
            end = last.end() if last else end
        yield RUN.findall(text, start, end)
        start = end


def lossy(run: str, identifier) -> str:
    """The run, or without one letter where the hash of identifier and run says so."""
    h = zlib.crc32(f"{identifier}:{run}".encode())
    if h % LOSSY:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def vocabulary(docs: DataFrame, identifier: str = "doc_id", text: str = "text", change=None, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """``word, n`` of all whole texts: words of ``least_length`` letters and ``least_count`` occurrences at least.

    ``change`` (run, identifier) may change each lower-cased run; where the identifier is null it is left alone.
    Every task counts before anything is shuffled, so a frequent word crosses the shuffle once per task and table.
    """
    import pyarrow as pa

    small_batches(docs.sparkSession)
    # a change takes away one letter at most, so shorter runs never become words
    shortest = least_length

    def count(batches):
        held: Counter = Counter()

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for key, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for runs in runs_of(content or ""):
                    for run, n in Counter([r for r in runs if len(r) >= shortest]).items():
                        word = run.translate(_LOWER)
                        if change and key is not None:
                            word = change(word, key)
                        if len(word) >= least_length:
                            held[word] += n
                    if len(held) > TABLE_WORDS:
                        yield rows()
                        held.clear()
        yield rows()

    counted = docs.select(docs[identifier].cast("string"), docs[text]).mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


# -- filters -------------------------------------------------------------------------------------------------------


@functools.cache
def _values() -> np.ndarray:
    """A number for each code point up to 255."""
    return np.random.default_rng(12).integers(1, 1 << 63, 256, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(length: int) -> np.ndarray:
    factors = np.full(length, _BASE, dtype=np.uint64)
    factors[:1] = 1
    return np.cumprod(factors)


def letters(words: list[str], length: int) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("latin-1"), dtype=np.uint8).reshape(len(words), length)


def plain_hash(codes: np.ndarray) -> np.ndarray:
    """Polynomial of the letters; that of an edited word follows from it in one step."""
    return (_values()[codes] * _powers(codes.shape[1])).sum(axis=1, dtype=np.uint64)


def part_of(mixed: np.ndarray, parts: int) -> np.ndarray:
    return ((mixed >> _U(40)) % _U(parts)).astype(np.int64)


def block_and_mask(mixed: np.ndarray, blocks: int | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A word's block in its filter and the bits that it sets there."""
    again = _mixed(mixed + _U(_BASE))
    mask = np.zeros(len(mixed), dtype=np.uint64)
    for i in range(BITS_SET):
        mask |= _U(1) << ((again >> _U(6 * i)) & _U(63))
    return (((again >> _U(32)) * np.uint64(blocks)) >> _U(32)).astype(np.int64), mask


def filters(words: DataFrame, parts: dict[int, int]) -> DataFrame:
    """``length, part, blocks``: one blocked Bloom filter for each part of the words of a length.

    ``parts`` says how many parts a length has, so that each holds about ``SHARD_WORDS`` words at most.  Tasks send
    64-bit words in their own bits; a filter is put together in one task, as its size is bounded.
    """
    import pandas as pd

    def sizes(batches):
        for pdf in batches:
            found = []
            for n, some in pdf.groupby(pdf["word"].str.len()):
                mixed = _mixed(plain_hash(letters(list(some["word"]), int(n))) + _U(int(n)))
                found.append(pd.DataFrame({"length": int(n), "part": part_of(mixed, parts[int(n)]), "mixed": mixed.view(np.int64)}))
            if found:
                yield pd.concat(found)

    def build(key, pdf):
        mixed = pdf["mixed"].to_numpy().view(np.uint64)
        blocks = np.zeros(max(1, len(mixed) * BITS_A_WORD // 64), dtype=np.uint64)
        where, mask = block_and_mask(mixed, len(blocks))
        np.bitwise_or.at(blocks, where, mask)
        return pd.DataFrame({"length": [key[0]], "part": [key[1]], "blocks": [blocks.tobytes()]})

    hashed = words.select("word").mapInPandas(sizes, "length int, part long, mixed long")
    return hashed.groupBy("length", "part").applyInPandas(build, "length int, part long, blocks binary")


def edits(codes: np.ndarray, alphabet: np.ndarray):
    """Deletions and replacements of words of one length.  ``alphabet``: all letters, the most frequent first.

    Yields (hashes, owner, length, make): ``make(picked)`` spells the edits of those places.  As an insertion is a
    deletion seen from the other word, and a replacement by a more frequent letter one by a rarer seen from there,
    deletions and replacements by more frequent letters meet all pairs; most letters have few more frequent ones.  Of
    equal neighbours only the first is deleted, so that no edit comes twice.
    """
    rows, length = codes.shape
    rank = np.zeros(256, dtype=np.int64)
    rank[alphabet] = np.arange(len(alphabet))
    values, powers, whole = _values(), _powers(length), plain_hash(codes)
    terms = values[codes] * powers
    ahead = np.zeros((rows, length + 1), dtype=np.uint64)
    np.cumsum(terms, axis=1, out=ahead[:, 1:])
    inverse = _U(_INVERSE)
    for i in range(length):
        first = np.ones(rows, dtype=bool) if i == 0 else codes[:, i] != codes[:, i - 1]
        owner = np.flatnonzero(first)
        left = ahead[owner, i] + (whole[owner] - ahead[owner, i + 1]) * inverse

        def shorter(picked, owner=owner, i=i):
            return np.delete(codes[owner[picked]], i, axis=1)

        yield left, owner, length - 1, shorter
        ahead_of = rank[codes[:, i]]
        owner = np.repeat(np.arange(rows), ahead_of)
        letter = np.arange(len(owner)) - np.repeat(np.cumsum(ahead_of) - ahead_of, ahead_of)

        def replaced(picked, owner=owner, letter=letter, i=i):
            spelled = codes[owner[picked]].copy()
            spelled[:, i] = alphabet[letter[picked]]
            return spelled

        yield whole[owner] - terms[owner, i] + values[alphabet[letter]] * powers[i], owner, length, replaced


class Shards:
    """Filters of some parts of the words of one length, one behind the other."""

    def __init__(self, held: dict[int, bytes], parts: int):
        self.size, self.start = np.zeros(parts, dtype=np.uint64), np.zeros(parts, dtype=np.int64)
        self.blocks = np.frombuffer(b"".join(held.values()), dtype=np.uint64)
        at = 0
        for part, blocks in held.items():
            self.size[part], self.start[part] = len(blocks) // 8, at
            at += len(blocks) // 8
        self.whole = len(held) == parts

    def may_hold(self, mixed: np.ndarray) -> np.ndarray:
        """Places of the hashes whose filter is here and has their bits."""
        part = part_of(mixed, len(self.size))
        places = None
        if not self.whole:
            places = np.flatnonzero(self.size[part] > 0)
            mixed, part = mixed[places], part[places]
        where, mask = block_and_mask(mixed, self.size[part])
        hits = np.flatnonzero((self.blocks[self.start[part] + where] & mask) == mask)
        return hits if places is None else places[hits]


def probe(words: DataFrame, shards, parts: dict[int, int], alphabet: list[int]) -> DataFrame:
    """``edit, word, n``: edits of words that a filter of the broadcast ``shards`` says may be words.

    ``alphabet``: code points of all letters of the words, the most frequent first.
    """
    import pandas as pd

    signs = np.array(alphabet, dtype=np.uint8)

    def spelled(codes: np.ndarray) -> list[str]:
        text, n = codes.tobytes().decode("latin-1"), codes.shape[1]
        return [text[i : i + n] for i in range(0, len(text), n)]

    def run(batches):
        by_length: dict[int, dict[int, bytes]] = {}
        for (n, part), blocks in shards.value.items():
            by_length.setdefault(n, {})[part] = blocks
        held = {n: Shards(some, parts[n]) for n, some in by_length.items()}
        # words wait until there are enough of a length for a step
        step = max(1, PROBES // len(signs))
        waiting: dict[int, list[pd.DataFrame]] = {}
        sizes: dict[int, int] = {}

        def probed(length: int):
            part = pd.concat(waiting.pop(length), ignore_index=True)
            del sizes[length]
            names, counts = part["word"].to_numpy(), part["n"].to_numpy()
            for a in range(0, len(names), step):
                made, owners = [], []
                for hashes, owner, n, make in edits(letters(list(names[a : a + step]), length), signs):
                    if n in held and len(hits := held[n].may_hold(_mixed(hashes + _U(n)))):
                        made += spelled(make(hits))
                        owners.append(owner[hits] + a)
                if made:
                    owners = np.concatenate(owners)
                    yield pd.DataFrame({"edit": made, "word": names[owners], "n": counts[owners]})

        for pdf in batches:
            for length, some in pdf.groupby(pdf["word"].str.len()):
                length = int(length)
                waiting.setdefault(length, []).append(some)
                sizes[length] = sizes.get(length, 0) + len(some)
                if sizes[length] >= step:
                    yield from probed(length)
        for length in sorted(waiting):
            yield from probed(length)

    return words.select("word", "n").mapInPandas(run, "edit string, word string, n long")


def near_pairs(words: DataFrame) -> DataFrame:
    """``word, n, near, near_n``: every pair of words exactly one edit apart, once.

    ``words`` (word, n; distinct, of code points up to FF) should be stored, as it is read several times.  A filter
    holds about ``SHARD_WORDS`` words; at most ``FILTER_BYTES`` of filters are broadcast at a time, however many words there
    are, and a vocabulary that needs more is probed in several passes.  Positives alone are shuffled, to an exact join
    with the vocabulary, so a filter's false positives cost time only.
    """
    spark: SparkSession = words.sparkSession
    # one row per length of words: lengths beyond those of texts cannot occur, and each is one number
    counts = {r["length"]: r["n"] for r in words.groupBy(F.length("word").alias("length")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return words.select("word", "n", F.col("word").alias("near"), F.col("n").alias("near_n")).where("false")
    # at most 192 rows: the letters that occur
    used = words.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").groupBy(F.ascii("c").alias("c")).agg(F.count(F.lit(1)).alias("n"))
    alphabet = [r["c"] for r in used.orderBy(F.desc("n"), "c").collect()]
    parts = {n: -(-k // SHARD_WORDS) for n, k in counts.items()}
    shards = cut_lineage(filters(words, parts))
    passes, size = [[]], 0
    for n, k in sorted(counts.items()):
        for p in range(parts[n]):
            expected = k * BITS_A_WORD // 8 // parts[n]
            if passes[-1] and size + expected > FILTER_BYTES:
                passes.append([])
                size = 0
            passes[-1].append((n, p))
            size += expected
    found = None
    for some in passes:
        wanted = F.broadcast(spark.createDataFrame(some, "length int, part long"))
        # bounded by FILTER_BYTES
        held = {(r["length"], r["part"]): bytes(r["blocks"]) for r in shards.join(wanted, ["length", "part"]).collect()}
        sent = spark.sparkContext.broadcast(held)
        positives = cut_lineage(probe(words, sent, parts, alphabet))
        sent.unpersist()
        found = positives if found is None else found.union(positives)
    known = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    return found.join(known, found["edit"] == known["near"]).select("word", "n", "near", "near_n")


# -- forms ---------------------------------------------------------------------------------------------------------


def roots(links: DataFrame) -> DataFrame:
    """``word, root`` of ``links`` (word, form): the end of each word's chain of forms, by doubling.

    Counts grow at least tenfold along a chain, so a chain of 64-bit counts has fewer than twenty links and five
    rounds end it.
    """
    ahead = cut_lineage(links.select("word", F.col("form").alias("root")))
    while True:
        further = ahead.select(F.col("word").alias("root"), F.col("root").alias("end"))
        moved = cut_lineage(ahead.join(further, "root", "left").select("word", F.coalesce("end", "root").alias("root"), F.col("end").isNotNull().alias("moved")))
        if moved.where("moved").isEmpty():
            return moved.select("word", "root")
        ahead = moved.select("word", "root")


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for stored ``words`` (word, n): see ``group_variants``."""
    pairs = near_pairs(words)
    both = pairs.union(pairs.select("near", "near_n", "word", "n"))
    # strings compare by their bytes, which is the order of their code points
    best = both.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best")
    )
    judged = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n")
    )
    taken: Column = F.col("near_n") >= ratio * F.col("n")
    judged = cut_lineage(
        judged.select("word", "n", "n_near", F.when(taken, F.col("near")).alias("form"), F.when(taken, F.col("near_n")).alias("form_n"))
    )
    ends = roots(judged.where("form IS NOT NULL").select("word", "form"))
    return judged.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def group_variants(docs: DataFrame, identifier: str = "doc_id", text: str = "text", change=None, **options) -> DataFrame:
    """Words of all whole texts with their usual spelling: one row per word.

    Columns: ``word``; ``n``, its occurrences; ``n_near``, the number of words exactly one inserted, deleted or
    replaced letter away; ``form``, the most frequent of those (of equal ones the first in code-point order) if it is
    ten times as frequent, else null, and its count ``form_n``; ``root``, the last of the chain of forms from the word,
    the word itself if it has none.

    Words are lower-cased (A-Z only) runs of Latin letters with seven letters and two occurrences at least.  Null and
    empty texts have none; a null identifier leaves the words of its text as they are, whatever ``change`` does;
    repeated rows count once each; further columns are not read; an empty table gives an empty result.
    """
    return variants(cut_lineage(vocabulary(docs, identifier, text, change, **options)))
