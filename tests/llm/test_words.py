"""Byte-pair encoding, spelling variants, periodic runs."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import plain
import public_tokenizers
import pytest
from conftest import SMALL
from dqloom.llm import bpe, periods, queries, spelling
from tokenizers import Tokenizer

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
ODD = ["a", "b", " ", "  ", "\n", "\t", "\r\n", "é", "ﬁ", "　", "🙂", "the", "<|startoftext|>", "<|endoftext|>", "<|", "\x00", "1", "12", "ｂ", "́", "'ll", "'S", "½",
       "\x85", "\xa0", "\x1c", "Σ", "ΑΣ", "İ", "ß", "ing", "ed", "!!", "!!!!", "...", "</w>", "Å", "が", "한", "x" * 40, "th", "er", "in", "ab"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def documents(spark, rows):
    """Rows (doc_id, text) with further columns whose names clash with results."""
    schema = "doc_id long, text string, n_tokens string, word int, n string, start string, runs string, form double"
    return spark.createDataFrame([(d, t, "x", 1, "y", "z", None, 0.5) for d, t in rows], schema)


# -- byte pairs ----------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


def test_ids_are_those_of_the_library(library, monkeypatch):
    monkeypatch.setattr(bpe, "TABLE_CHUNKS", 50)  # the table's halves are exchanged all the time
    coder, draw = bpe.Coder(VOCABULARY), random.Random(1)
    rows = ["".join(draw.choice(ODD) for _ in range(draw.randint(0, 14))) for _ in range(6000)]
    rows += ["".join(draw.choice("aeinst"[: draw.randint(1, 6)]) for _ in range(draw.randint(0, 80))) for _ in range(6000)]
    rows += ["".join(chr(draw.choice([draw.randint(0, 0x2FF), draw.randint(0, 0xD7FF), draw.randint(0xE000, 0x10FFFF)])) for _ in range(9)) for _ in range(6000)]
    for text in rows:
        ids = library.encode(text, add_special_tokens=False).ids
        n, listed, decoded = coder.lookup(text)
        assert (n, listed) == (len(ids), " ".join(map(str, ids))) and decoded == library.decode(ids, skip_special_tokens=False), text


def test_merges_agree_with_plain_ones_on_small_vocabularies():
    """All words over two letters under random merges, against merging pair by pair."""
    draw = random.Random(3)
    for _ in range(60):
        tokens, merges = ["a", "b"], []
        while len(merges) < 12:
            left, right = draw.choice(tokens), draw.choice(tokens)
            if left + right not in tokens and len(left + right) < 9:
                merges.append((left, right))
                tokens.append(left + right)
        coder = bpe.WordCoder({t: i for i, t in enumerate(tokens)}, merges, "")
        for _ in range(100):
            word = "".join(draw.choice("ab") for _ in range(draw.randint(1, 40)))
            parts = list(word)
            for left, right in merges:
                i = 0
                while i < len(parts) - 1:
                    if (parts[i], parts[i + 1]) == (left, right):
                        parts[i : i + 2] = [left + right]
                    i += 1
            assert [tokens[i] for i in coder.encode(word)] == parts


def test_words_of_any_length(library):
    coder = bpe.Coder(VOCABULARY)
    for text in ("ab" * 200_000, "!" * 300_001, "é" * 100_000):
        assert coder.chunk_ids(text) == library.encode(text, add_special_tokens=False).ids


def test_bpe_of_tables(spark, library):
    rows = [(1, None), (1, ""), (2, " \n "), (2, "A b"), (2, "A b"), (None, "<|endoftext|>x"), (3, "word " * 40_000)]
    found = bpe.digests(documents(spark, rows), VOCABULARY).collect()
    assert found[0].asDict().keys() >= {"doc_id", "word", "n_tokens", "ids_sha256", "decoded_sha256"}
    for (_, text), row in zip(rows, found, strict=True):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert (row["n_tokens"], row["ids_sha256"]) == (len(ids), sha(" ".join(map(str, ids))))
        assert row["decoded_sha256"] == sha(library.decode(ids, skip_special_tokens=False))
    encoded = bpe.encode(documents(spark, rows), VOCABULARY)
    texts = [r["bpe_text"] for r in bpe.decode(encoded, VOCABULARY).collect()]
    assert texts == [library.decode(library.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False) for _, t in rows]
    assert bpe.digests(documents(spark, []), VOCABULARY).count() == 0


def test_bpe_query(spark, library):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    found = queries.QUERIES["op11_bpe"](spark, SMALL).collect()
    assert len(found) == len(texts)
    for row in found:
        ids = library.encode(texts[row["doc_id"]], add_special_tokens=False).ids
        assert row["ids_sha256"] == sha(" ".join(map(str, ids))) and row["decoded_sha256"] == sha(library.decode(ids, skip_special_tokens=False))


# -- spelling ------------------------------------------------------------------------------------------------------


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(words):
    """word -> (form, root, n, n_near, form_n), by all pairs that share a pattern."""
    holders = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            holders[w[:i] + "*" + w[i + 1 :]].add(w)
            holders[w[:i] + w[i + 1 :]].add(w)
        holders[w].add(w)
    near = defaultdict(set)
    for some in holders.values():
        for w in some:
            near[w] |= {x for x in some if one_apart(w, x)}
    form = {}
    for w in words:
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    made = {}
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        made[w] = (form[w], root, words[w], len(near[w]), words.get(form[w]))
    return made


def plain_words(rows, change):
    counts = Counter()
    for d, text in rows:
        for run in spelling.RUN.findall(text or ""):
            run = run.translate(plain.LOWER)
            counts[change(run, d) if change and d is not None else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def as_dict(rows):
    made = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(made) == len(rows)
    return made


def test_variants_of_random_words(spark, monkeypatch):
    draw, alphabet = random.Random(2), "abà÷ÿß"
    words = {"".join(draw.choice(alphabet) for _ in range(draw.randint(7, 9))): draw.choice([2, 3, 20, 200, 2000, 2000, 20_000, 300_000]) for _ in range(3000)}
    monkeypatch.setattr(spelling, "SHARD_WORDS", 300)  # several filters a length ...
    monkeypatch.setattr(spelling, "FILTER_BYTES", 1500)  # ... and several passes
    table = spelling.cut_lineage(spark.createDataFrame(list(words.items()), "word string, n long").repartition(3))
    assert as_dict(spelling.variants(table).collect()) == plain_variants(words)


def test_false_positives_do_no_harm(spark, monkeypatch):
    draw = random.Random(4)
    words = {"".join(draw.choice("abcd") for _ in range(8)): draw.choice([2, 30, 400]) for _ in range(800)}
    table = spelling.cut_lineage(spark.createDataFrame(list(words.items()), "word string, n long").coalesce(1))

    class Undecided(spelling.Shards):
        def may_hold(self, mixed):
            return np.arange(len(mixed))

    monkeypatch.setattr(spelling, "Shards", Undecided)
    assert as_dict(spelling.variants(table).collect()) == plain_variants(words)


def test_words_of_documents(spark, monkeypatch):
    monkeypatch.setattr(spelling, "CUT", 50)
    monkeypatch.setattr(spelling, "TABLE_WORDS", 10)
    draw = random.Random(5)
    parts = ["colour", "COLOURED", "coloured", "colored", "straße", "Straßen", "naïvely", "NAÏVELY", "x" * 70, " ", ", ", "7", "÷×ÿÀabcd", "\n", "中文", "governments", "government"]
    rows = [(i, "".join(draw.choice(parts) + draw.choice([" ", "", "-"]) for _ in range(40))) for i in range(60)]
    rows += [(None, "coloured colored"), (None, None), (7, ""), (7, rows[7][1]), (7, rows[7][1])]
    for change in (None, spelling.lossy):
        truth = plain_variants(plain_words(rows, change))
        assert as_dict(spelling.group_variants(documents(spark, rows), change=change).collect()) == truth and truth
    assert spelling.group_variants(documents(spark, [])).collect() == spelling.group_variants(documents(spark, [(1, None)])).collect() == []


def test_chains_end_in_their_root(spark):
    chain = {"a" * (7 + i): 2 * 10**i for i in range(18)}
    table = spelling.cut_lineage(spark.createDataFrame(list(chain.items()), "word string, n long"))
    assert {r["root"] for r in spelling.variants(table).collect()} == {"a" * 24}


def test_spelling_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    found = queries.QUERIES["op12_spelling_variants"](spark, SMALL).collect()
    assert as_dict(found) == plain_variants(plain_words(rows, spelling.lossy))


# -- periods -------------------------------------------------------------------------------------------------------


def plain_runs(words, least=12):
    found = {}
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i + p < len(words):
            if words[i] != words[i + p]:
                i += 1
                continue
            start = i
            while i + p < len(words) and words[i] == words[i + p]:
                i += 1
            if i - start + p >= max(least, 2 * p):
                found.setdefault((start, i - start + p), p)  # rising periods: the smallest comes first
    return sorted((s, n, p) for (s, n), p in found.items())


def plain_periods(identifier, text, planted=True):
    words = plain.WORD.findall(text or "")
    if planted:
        words = periods.made_periodic(words, identifier)
    runs, gone = plain_runs(words), set()
    for s, n, p in runs:
        gone.update(range(s + p, s + n))
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    listed, left = "".join(f"{s},{n},{p}\n" for s, n, p in runs), " ".join(w for i, w in enumerate(words) if i not in gone)
    return (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(listed), sha(left))


def sequence(draw):
    words = [draw.randrange(draw.choice([1, 2, 3, 5])) for _ in range(draw.choice([0, 1, 11, 12, 13, 40, 120]))]
    if words and draw.random() < 0.5:
        a = draw.randrange(len(words))
        p = 1 + (len(words) - a) // draw.randint(2, 8)
        words = words[:a] + [words[a + i % p] for i in range(len(words) - a)]
    if draw.random() < 0.2:
        words, other = [1, 0], [1]  # Fibonacci words have many runs
        while len(words) < 200:
            words, other = words + other, words
    return words


def test_runs_of_random_sequences(monkeypatch):
    draw = random.Random(6)
    for turn in range(80):
        monkeypatch.setattr(periods, "GRID", draw.choice([64, 1 << 21]))  # with small steps too
        some = [sequence(draw) for _ in range(draw.randint(1, 20))]
        flat, lengths = np.array([w for s in some for w in s], dtype=np.int64), np.array([len(s) for s in some])
        for words, runs in zip(some, periods.find_runs(flat, lengths), strict=True):
            assert list(map(tuple, runs.tolist())) == plain_runs(words), words


def test_common_stretches():
    draw = random.Random(8)
    for _ in range(40):
        words = [draw.randrange(2) for _ in range(300)] if draw.random() < 0.5 else [0] * draw.randint(20, 300)
        words += words[:100]
        grammar = periods.Grammar(np.array(words), np.array([len(words)]))
        a, b = np.array([[draw.randrange(len(words)) for _ in range(200)] for _ in range(2)])
        a, b = a[a != b], b[a != b]  # a place is not compared with itself
        ahead, behind = grammar.common(a + 1, b + 1, True), grammar.common(a + 1, b + 1, False)
        for x, y, f, g in zip(a.tolist(), b.tolist(), ahead.tolist(), behind.tolist(), strict=True):
            m = 0
            while max(x, y) + m < len(words) and words[x + m] == words[y + m]:
                m += 1
            k = 0
            while min(x, y) - k > 0 and words[x - k - 1] == words[y - k - 1]:
                k += 1
            assert (f, g) == (m, k)


def test_very_repetitive_texts_take_no_square_time():
    for words, run in (([0] * 100_000, (0, 100_000, 1)), ([0, 1, 2] * 40_000, (0, 120_000, 3)), (list(range(40_000)) * 3, (0, 120_000, 40_000))):
        assert list(map(tuple, periods.find_runs(np.array(words), np.array([len(words)]))[0].tolist())) == [run]


def test_collapsed_tables(spark):
    rows = [(1, None), (1, ""), (2, "a b c " * 5), (2, "a b c " * 5), (None, "x " * 12), (3, "x " * 11), (4, "é\x85 " * 20_000), (5, "one two three")]
    found = periods.collapse(documents(spark, rows), with_runs=True).collect()
    assert [r["collapsed"] for r in found] == ["", "", "a b c", "a b c", "x", " ".join("x" * 11), "é\x85", "one two three"]
    assert [len(r["runs"]) for r in found] == [0, 0, 1, 1, 1, 0, 1, 0] and found[2]["runs"][0].asDict() == {"start": 0, "length": 15, "period": 3}
    assert found[2]["exponent_milli"] == 5000 and found[0]["start"] is None
    assert periods.collapse(documents(spark, [])).count() == 0
    for (d, text), row in zip(rows, periods.contract(documents(spark, rows)).collect(), strict=True):
        assert tuple(row)[1:] == plain_periods(d, text)


def test_periods_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    found = queries.QUERIES["op13_periodic_runs"](spark, SMALL).collect()
    assert len(found) == len(texts) and found[0].asDict().keys() == {"doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"}
    for row in found:
        assert tuple(row)[1:] == plain_periods(row["doc_id"], texts[row["doc_id"]]), row["doc_id"]
