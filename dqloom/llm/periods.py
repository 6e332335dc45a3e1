"""Periodic runs of words, found with a grammar made by recompression."""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dqloom.llm.common import slices, small_batches

LEAST = 12  # words of a run, and twice its period
GRID = 1 << 21  # grid points that are looked at together
APEX = 4  # symbols of a text at which compression ends; they are compared one by one
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ADDED = (
    "n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
)


def _scrambled(x: np.ndarray, seed: int) -> np.ndarray:
    x = x.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) & ((1 << 64) - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Grammar:
    """A run-length grammar of some texts, one after the other with a separator before, between and behind them.

    Levels alternate: *blocks* join all neighbours that are equal, *pairs* join neighbours of which the left one is a
    left symbol and the right one a right symbol (the side of a symbol is a hash of it and the level).  Equal groups
    get equal names by comparison, so equal names mean equal words.  How a stretch is grouped depends on its
    neighbours only, so two equal stretches are grouped alike but for some symbols at their ends.  Separators are all
    different and join nothing.  For each level ``symbols[h]`` has its symbols, ``starts[h]`` the symbol of the level
    below with which each begins (and the number of those as the last), ``blocks[h]`` whether it was made by blocks.
    """

    def __init__(self, words: np.ndarray, lengths: np.ndarray):
        """``words``: the texts' word numbers (not negative) without separators; ``lengths``: words of each text."""
        n = len(lengths)
        self.first = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1] + 1  # place of each text's first word
        self.words = np.empty(len(words) + n + 1, dtype=np.int64)
        inside = np.ones(len(self.words), dtype=bool)
        inside[self.first - 1] = inside[-1] = False
        self.words[inside] = words
        self.words[~inside] = -1 - np.arange(n + 1)
        self.symbols, self.starts, self.blocks = [self._small(self.words)], [None], [False]
        for turn in itertools.count():
            symbols = self.symbols[-1]
            walls = np.flatnonzero(symbols < 0)
            if np.diff(walls).max(initial=0) - 1 <= APEX:
                return
            if turn % 2:
                self._join_pairs(symbols.astype(np.int64), turn)
            else:
                self._join_blocks(symbols.astype(np.int64))

    @staticmethod
    def _small(x: np.ndarray) -> np.ndarray:
        return x.astype(np.int32)

    def _add(self, symbols: np.ndarray, begins: np.ndarray, joined: np.ndarray, names: np.ndarray, block: bool) -> None:
        """A level whose groups begin at ``begins``; those where ``joined`` get ``names``, the others keep their symbol."""
        starts = np.flatnonzero(begins)
        if len(starts) == len(symbols):
            return  # nothing was joined
        fresh = symbols[starts]
        if len(names):
            fresh[joined] = max(int(symbols.max()), -1) + 1 + np.unique(names, return_inverse=True)[1]
        # names are kept small, so that two of them fit into one number
        if fresh.max() >= 1 << 30:
            fresh[fresh >= 0] = np.unique(fresh[fresh >= 0], return_inverse=True)[1]
        self.symbols.append(self._small(fresh))
        self.starts.append(self._small(np.append(starts, len(symbols))))
        self.blocks.append(block)

    def _join_blocks(self, symbols: np.ndarray) -> None:
        begins = np.concatenate([[True], symbols[1:] != symbols[:-1]])
        starts = np.flatnonzero(begins)
        sizes = np.diff(np.append(starts, len(symbols)))
        joined = sizes > 1
        self._add(symbols, begins, joined, symbols[starts[joined]] << 31 | sizes[joined], True)

    def _join_pairs(self, symbols: np.ndarray, turn: int) -> None:
        left = (_scrambled(symbols, turn) & np.uint64(1)).astype(bool)
        ends = np.concatenate([[False], left[:-1] & ~left[1:] & (symbols[:-1] >= 0) & (symbols[1:] >= 0)])
        begins = ~ends
        starts = np.flatnonzero(begins)
        joined = np.append(starts[1:], len(symbols)) - starts == 2
        self._add(symbols, begins, joined, symbols[starts[joined]] << 31 | symbols[starts[joined] + 1], False)

    def _above(self, level: int, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gaps of the next level that lie at or behind ``gaps``, and whether they are the same place."""
        starts = self.starts[level + 1]
        up = np.searchsorted(starts, gaps)
        return up, starts[up] == gaps

    def _steps(self, level: int, gaps: np.ndarray, up: np.ndarray, exact: np.ndarray, forward: bool) -> np.ndarray:
        """Equal symbols from a gap to the end of the block it lies at or in."""
        starts = self.starts[level + 1]
        if forward:
            return starts[np.where(exact, up + 1, up)] - gaps
        return gaps - starts[up - 1]

    def common(self, a: np.ndarray, b: np.ndarray, forward: bool) -> np.ndarray:
        """How many words from place ``a`` on (backwards: before it) equal those from the other place ``b`` on.

        Two cursors climb from level to level: symbols are compared until both stand at a border of the level above.
        Where symbols differ they go down again, and compare what the symbols begin (backwards: end) with.  A level
        takes a few comparisons, whatever the lengths: a block is passed at once, by the smaller of the two rests.
        """
        x, y = a.astype(np.int64), b.astype(np.int64)
        back = 0 if forward else 1
        sign = 1 if forward else -1
        top = len(self.symbols) - 1
        stopped = np.full(len(x), -1)
        live = np.arange(len(x))
        for level in range(top + 1):
            symbols = self.symbols[level]
            climbed = []
            while len(live):
                ax, bx = x[live], y[live]
                if level < top:
                    ua, ea = self._above(level, ax)
                    ub, eb = self._above(level, bx)
                    both = ea & eb
                    if both.any():
                        x[live[both]], y[live[both]] = ua[both], ub[both]
                        climbed.append(live[both])
                        live, ax, bx, ua, ub, ea, eb = (v[~both] for v in (live, ax, bx, ua, ub, ea, eb))
                        if not len(live):
                            break
                same = symbols[ax - back] == symbols[bx - back]
                stopped[live[~same]] = level
                live, ax, bx = live[same], ax[same], bx[same]
                step = 1
                if level < top and self.blocks[level + 1]:
                    step = np.minimum(
                        self._steps(level, ax, ua[same], ea[same], forward), self._steps(level, bx, ub[same], eb[same], forward)
                    )
                x[live], y[live] = ax + sign * step, bx + sign * step
            live = np.concatenate(climbed) if climbed else np.zeros(0, dtype=np.int64)
        for level in range(top, 0, -1):
            live = np.flatnonzero(stopped >= level)
            starts, symbols = self.starts[level], self.symbols[level - 1]
            x[live], y[live] = starts[x[live]], starts[y[live]]
            while len(live):
                same = symbols[x[live] - back] == symbols[y[live] - back]
                live = live[same]
                step = 1
                if self.blocks[level] and len(live):
                    rests = []
                    for at in (x[live], y[live]):
                        up, exact = self._above(level - 1, at)
                        rests.append(self._steps(level - 1, at, up, exact, forward))
                    step = np.minimum(*rests)
                x[live] += sign * step
                y[live] += sign * step
        return np.abs(x - a)


def _grid(n: int):
    """Grid points (place, period) of a text of ``n`` words: multiples of each period, the next multiple inside too."""
    periods = np.arange(1, n // 2 + 1, dtype=np.int64)
    counts = (n - 1) // periods
    ends = np.cumsum(counts)
    done = 0
    while done < len(periods):
        base = ends[done - 1] if done else 0
        upto = max(done + 1, int(np.searchsorted(ends, base + GRID, side="right")))
        p = np.repeat(periods[done:upto], counts[done:upto])
        k = np.arange(len(p)) - np.repeat(ends[done:upto] - counts[done:upto] - base, counts[done:upto])
        yield k * p, p
        done = upto


def _candidates(words: np.ndarray, first: int, n: int, least: int):
    """Grid points of one text whose word equals the one a period further, with two equal words on one side of them.

    A run of a period is at least two periods long, so it holds a grid point and the next one; what it repeats is
    ``max(period, least - period)`` words long and contiguous, so three of those are on one side of the grid point.
    """
    for places, periods in _grid(n):
        keep = words[first + places] == words[first + places + periods]
        at, p = first + places[keep], periods[keep]
        sides = np.zeros(len(at), dtype=bool)
        for sign in (1, -1):
            near = np.ones(len(at), dtype=bool)
            for away in (sign, 2 * sign):
                # beyond a text lies a separator, which equals nothing; further places are cut to the table
                i, j = np.clip(at + away, 0, len(words) - 1), np.clip(at + p + away, 0, len(words) - 1)
                near &= words[i] == words[j]
            sides |= near
        yield at[sides], p[sides]


def find_runs(words: np.ndarray, lengths: np.ndarray, least: int = LEAST) -> list[np.ndarray]:
    """Maximal runs of each text as rows (start, length, smallest period), by start and period.

    ``words`` are the word numbers of all texts one after the other.  A run is at least ``least`` (6 or more) and two
    periods long.
    """
    if least < 6:
        raise ValueError("runs shorter than six words are not looked for")
    empty = np.zeros((0, 3), dtype=np.int64)
    if not len(words):
        return [empty] * len(lengths)
    grammar = Grammar(words, lengths)
    found, owner = [], []
    held, held_owner, waiting = [], [], 0

    def extend() -> None:
        nonlocal held, held_owner, waiting
        if waiting:
            at, p = (np.concatenate(part) for part in zip(*held, strict=True))
            who = np.repeat([o for o, _ in held_owner], [n for _, n in held_owner])
            ahead, behind = grammar.common(at, at + p, True), grammar.common(at, at + p, False)
            start, length = at - behind, behind + ahead + p
            keep = length >= np.maximum(least, 2 * p)
            # the same stretch is found from each of its grid points and for multiples of its period
            rows = np.stack([who[keep], start[keep], length[keep], p[keep]], axis=1)
            rows = rows[np.lexsort(rows.T[::-1])]
            new = np.ones(len(rows), dtype=bool)
            new[1:] = (rows[1:, :3] != rows[:-1, :3]).any(axis=1)
            found.append(rows[new])
        held, held_owner, waiting = [], [], 0

    for text, n in enumerate(lengths.tolist()):
        if n < least:
            continue
        for at, p in _candidates(grammar.words, int(grammar.first[text]), n, least):
            if len(at):
                held.append((at, p))
                held_owner.append((text, len(at)))
                waiting += len(at)
                if waiting > GRID // 4:
                    extend()
    extend()
    rows = np.concatenate(found) if found else np.zeros((0, 4), dtype=np.int64)
    rows = rows[np.lexsort(rows.T[::-1])]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:, :3] != rows[:-1, :3]).any(axis=1)
    rows = rows[new]
    rows[:, 1] -= grammar.first[rows[:, 0]]
    rows = rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]
    edges = np.searchsorted(rows[:, 0], np.arange(len(lengths) + 1))
    return [rows[a:b, 1:] for a, b in zip(edges[:-1], edges[1:], strict=True)]


def without_repeats(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of a text's words stay: those that no run contains behind its first period."""
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:n]) == 0


def made_periodic(words: list[str], identifier) -> list[str]:
    """The words with the repetition that the query's contract plants in every tenth document (by crc32 of the id)."""
    n = len(words)
    if identifier is None or not n:
        return words
    h = zlib.crc32(str(identifier).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def collapse(
    docs: DataFrame,
    identifier: str = "doc_id",
    text: str = "text",
    prepare=None,
    least: int = LEAST,
    with_text: bool = True,
    with_runs: bool = False,
) -> DataFrame:
    """Periodic runs of each whole text and the text without their repetitions: one row per row of ``docs``.

    Columns: the identifier, ``n_words``, ``n_runs``, the longest run's ``start``, ``length``, ``period`` and
    ``exponent_milli`` (1000 times length through period, rounded down; of equal lengths the smallest start, then
    period, counts; four nulls without runs), ``runs_sha256`` and ``collapsed_sha256``; on demand ``collapsed``, the
    words that stay joined by one space, and ``runs``, all of them.  ``prepare`` (words, identifier) may change the
    words first.

    Texts are worked on where they lie and nothing is shuffled.  Texts of one slice share a grammar; a longer text is
    a slice of its own, which takes memory in proportion to its words and time in proportion to words times their
    logarithm, however they repeat.  Null and empty texts have no words and no runs; repeated rows and null
    identifiers are rows like others; further columns are not read; an empty table gives an empty result.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    small_batches(docs.sparkSession)
    source = docs.select(docs[identifier].alias(identifier), docs[text].alias("__text"))
    extra = (", collapsed string" if with_text else "") + (", runs array<struct<start:long,length:long,period:long>>" if with_runs else "")
    schema = StructType([source.schema.fields[0], *_parse_datatype_string(ADDED + extra).fields])
    arrow = to_arrow_schema(schema)

    def judge(keys, texts):
        split = [WORD.findall(t or "") for t in texts]
        if prepare:
            split = [prepare(words, key) for words, key in zip(split, keys, strict=True)]
        names: dict[str, int] = {}
        lengths = np.array([len(words) for words in split], dtype=np.int64)
        numbers = np.fromiter((names.setdefault(w, len(names)) for words in split for w in words), np.int64, int(lengths.sum()))
        for words, runs in zip(split, find_runs(numbers, lengths, least), strict=True):
            if len(runs):
                best = runs[np.lexsort((runs[:, 2], runs[:, 0], -runs[:, 1]))[0]].tolist()
                listed = "".join([f"{s},{n},{p}\n" for s, n, p in runs.tolist()])
                stay = without_repeats(len(words), runs)
                left = " ".join([w for w, s in zip(words, stay.tolist(), strict=True) if s])
            else:
                best, listed, left = None, "", " ".join(words)
            row = [len(words), len(runs), *(best or [None] * 3), 1000 * best[1] // best[2] if best else None]
            row += [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in (listed, left)]
            row += [left] if with_text else []
            row += [[dict(zip(("start", "length", "period"), r, strict=True)) for r in runs.tolist()]] if with_runs else []
            yield row

    def run(batches):
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices([len(t or "") for t in texts]):
                columns = [list(c) for c in zip(*judge(keys[a:b], texts[a:b]), strict=True)]
                made = [pa.array(c, type=f.type) for c, f in zip(columns, list(arrow)[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *made], names=arrow.names)

    return source.mapInArrow(run, schema)


def contract(docs: DataFrame, identifier: str = "doc_id") -> DataFrame:
    """The query's columns: repetitions planted by identifier, texts given as digests only."""
    found = collapse(docs, identifier, prepare=made_periodic, with_text=False)
    return found.select(F.col(identifier), *(c.split()[0] for c in ADDED.split(", ")[1:]))
