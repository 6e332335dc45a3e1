"""Secrets, tokens, packing."""

import random
import zlib

import numpy as np
import plain
import public_tokenizers
import pytest
from conftest import SMALL
from dqloom.llm import packing, pieces, queries, secrets
from tokenizers import Tokenizer

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["a", "b", " ", "  ", "▁", "\n", "\t", "é", "ﬁ", "　", "🙂", "the", "<s>", "</s>", "<unk>", "<0x41>", "\x00", "1", "12", "\r\n", "ｂ", "́", "'ll", "½", "\x85", "<|endoftext|>"]


def texts(n, seed=0, parts=ODD):
    draw = random.Random(seed)
    return [None, "", " ", "\n", "x" * 20_000, "ab " * 9_000] + ["".join(draw.choice(parts) for _ in range(draw.randint(0, 14))) for _ in range(n)]


def frame(spark, rows):
    schema = "doc_id long, text string, n_tokens string, start string, score int"
    return spark.createDataFrame([(i, t, "x", "y", 1) for i, t in enumerate(rows)], schema)


# -- secrets -------------------------------------------------------------------------------------------------------

PARTS = ["password", "Token", "API_KEY", "apikey", "=", ":", " ", '"', "'", "abc", "secret", "deadbeef01", "AKIA", "ABCDEF0123456789", "é", "\n", "x.y", "🙂"]


def test_base_spans_are_those_of_the_patterns(spark):
    rows = texts(1500, 3, PARTS) + ["token:token:abcdef", "AKIA" * 5, "0" * 23, "0" * 24, "password = 'abcde' passwd=abcdef"]
    found = {r["doc_id"]: r for r in secrets.scan(frame(spark, rows)).collect()}
    for i, text in enumerate(rows):
        assert [tuple(s) for s in found[i]["__base"]] == plain.secrets(text), text
        assert set(map(tuple, found[i]["__base"])) <= set(map(tuple, found[i]["__spans"]))


def test_weak_parts_need_complements(spark):
    weak, site, key = "aB3" + "xY7z" * 8, "https://api.example.org/v1", "ASIA" + "Q7" * 8
    rows = [weak, f"{weak} {site}", f"{weak}{' .' * 400} {site}", site, f"{key} and {weak}", f"{key} {weak} {site}", "lower " + "gh" * 20]
    found = [r["spans"] for r in sorted(secrets.scan(frame(spark, rows)).select("doc_id", secrets.as_text("__spans").alias("spans")).collect())]
    kinds = [[s.split(":")[0] for s in f.split(",")] if f else [] for f in found]
    assert kinds == [[], ["weak_secret"], [], [], ["weak_id", "weak_secret"], ["weak_id", "weak_secret", "endpoint"], []]


@pytest.mark.parametrize("length", [19, 20, 64, 65, 86, 93, 5000])
def test_weak_secrets_of_any_length(spark, length):
    key, site = ("aB3" + "xY7z+" * length)[:length], "https://api.example.org/v1"
    row = [f"at {site} key {key}"]
    found = secrets.scan(frame(spark, row)).select(secrets.as_text("__spans").alias("spans")).first()["spans"]
    masked = secrets.mask(frame(spark, row)).first()["text"]
    assert found == (f"weak_secret:34:{34 + length}" if length > 19 else "")
    assert masked == (f"at {site} key [SECRET]" if length > 19 else row[0])


def test_many_parts_in_one_document(spark):
    rows = [" ".join(["ASIA" + "Q7" * 8, "aB3" + "xY7z" * 8] * 3000)]
    found = secrets.scan(frame(spark, rows)).select(secrets.count_of("__spans", "weak_id").alias("n")).first()
    assert found["n"] == 3000


def test_links_are_those_of_all_pairs_and_do_not_depend_on_the_offset(spark):
    draw = random.Random(11)
    parts = ["ASIA" + "Q7" * 8, "AKIA" + "Q7" * 8, "aB3" + "xY7z" * 8, "https://a.example/x", "token=abcdefgh", "f" * 30, "login: someone", "aB3" + "xY7z" * 300]
    parts.append("https://a.example/" + "y" * 1100)
    rows = []
    for _ in range(60):
        text = "".join(draw.choice(parts) + " " + "." * draw.choice([0, 40, 200, 253, 254, 255, 300, 600]) + " " for _ in range(draw.randint(2, 6)))
        rows += ["- " * (shift // 2) + " " * (shift % 2) + text for shift in (0, 1, 100, 256, draw.randint(300, 2000))]
    weak = {secrets.KINDS.index(k): secrets.PATTERNS[k] for k in secrets.WEAK}
    found = {r["doc_id"]: [tuple(s) for s in r["__spans"]] for r in secrets.scan(frame(spark, rows)).collect()}
    for i, text in enumerate(rows):
        assert found[i] == plain.linked_secrets(text, weak, secrets.SCOPE // 2), text
    kinds = {i: [rank for _, rank, _ in spans] for i, spans in found.items()}
    assert all(kinds[i] == kinds[i - i % 5] for i in kinds) and {r for k in kinds.values() for r in k} == set(range(6))


def test_very_many_spans_in_one_text(spark):
    digest = [f"{i:032x}" for i in range(100_000)]
    rows = ["é ".join(digest), "🙂" * 5000 + " " + " - ".join(digest[:600]) + "x" * 9000, "é" * 4096 + digest[0], "-" * 4064 + digest[0]]
    found = {r["doc_id"]: r for r in secrets.scan(frame(spark, rows)).collect()}
    assert len(found[0]["__spans"]) == 100_000 and tuple(found[0]["__spans"][-1]) == (34 * 99_999, 2, 34 * 99_999 + 32)
    masked = {r["doc_id"]: r["text"] for r in secrets.mask(frame(spark, rows)).collect()}
    assert masked[0] == "é ".join(["[SECRET]"] * 100_000)
    assert masked[1] == "🙂" * 5000 + " " + " - ".join(["[SECRET]"] * 600) + "x" * 9000
    assert (masked[2], masked[3]) == ("é" * 4096 + "[SECRET]", "-" * 4064 + "[SECRET]")


def test_mask(spark):
    rows = ["no", None, "", "é token=abcdefgh, x", "f" * 30 + " and password: 'f0f0f0f0f0f0f0f0f0f0f0f0f0f0'"]
    masked = secrets.mask(frame(spark, rows))
    assert masked.columns == frame(spark, rows).columns
    assert [r["text"] for r in sorted(masked.collect())] == ["no", None, "", "é [SECRET], x", "[SECRET] and [SECRET]'"]
    assert secrets.mask(frame(spark, [])).count() == secrets.scan(frame(spark, [])).count() == 0


# -- pieces --------------------------------------------------------------------------------------------------------


def test_ids_and_round_trip_agree_with_the_library(monkeypatch):
    import sentencepiece

    monkeypatch.setattr(pieces, "TABLE_CHUNKS", 50)  # the table's halves are exchanged all the time
    whole, table, rows = sentencepiece.SentencePieceProcessor(model_file=PIECES), pieces.ChunkTable(PIECES), texts(6000, 1)
    for start in range(0, len(rows), 100):
        part = rows[start : start + 100]
        for text, (ids, decoded) in zip(part, table.lookup(part), strict=True):
            truth = whole.encode(text or "")
            assert [int(i) for i in ids.split(",")] == truth if ids else not truth, text
            assert decoded == whole.decode(truth), text


def test_piece_digests(spark):
    rows = texts(50, 2)
    found = pieces.digests(frame(spark, rows), PIECES)
    assert "start" in found.columns and dict(found.dtypes)["n_tokens"] == "bigint"
    by = {r["doc_id"]: r for r in found.collect()}
    assert [by[i]["n_tokens"] for i in range(len(rows))] == [len(i) for i in pieces.encode_ids(rows, PIECES)]
    assert by[0]["n_tokens"] == 0 and by[0]["ids_sha256"] == by[1]["decoded_sha256"]
    assert pieces.digests(frame(spark, []), PIECES).count() == 0
    assert [r["piece_ids"] for r in sorted(pieces.encode(frame(spark, rows), PIECES, keep=["doc_id"]).collect())] == pieces.encode_ids(rows, PIECES)


# -- packing -------------------------------------------------------------------------------------------------------


def check_packing(rows, found, window):
    """Every id in exactly one piece, sequences gapless and not too long; returns the fill of each sequence."""
    library = Tokenizer.from_file(BPE)
    by, filled = {}, {}
    for r in found:
        by.setdefault(r["doc_id"], []).append(r)
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(by) == set(rows)
    for key, text in rows.items():
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        at = 0
        for r in sorted(by[key], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids)) and r["length"] > 0
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    return [sum(n for _, n in parts) for parts in filled.values()]


def test_packing_of_odd_texts(spark):
    rows = dict(enumerate(texts(400, 5)))
    for window in (1024, 8, 1):
        table = frame(spark, list(rows.values())).repartition(3, "doc_id")
        fill = check_packing(rows, packing.pack(table, BPE, window=window).collect(), window)
        # one window of each task at most is padded
        assert sum(n < window and n & (n - 1) != 0 for n in fill) <= 3
    assert packing.pack(frame(spark, []), BPE).count() == 0


def test_packing_query(spark):
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    check_packing(rows, queries.QUERIES["op7_packing"](spark, SMALL).collect(), 1024)


def test_ids_of_pieces(spark):
    made = packing.pack(frame(spark, ["ab " * 900, None]), BPE, with_ids=True).collect()
    assert all(zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) == r["ids_crc32"] for r in made)


def test_level_rule_minimises_squares(monkeypatch):
    """Every placement is the best of all levels, and the state stays consistent."""
    draw = random.Random(9)
    packer = packing.Packer(64, 0)
    for i in range(600):
        before = packer.counts.copy()
        size = draw.randint(1, 40)
        packer.add(i, np.arange(size, dtype="<u4"))

        def cost(counts):
            return int((counts[packer.counted] ** 2).sum())

        options = []
        for level in range(0, 65 - size):
            if level == 0 or before[level]:
                after = before.copy()
                after[level] -= level > 0
                if level + size < 64:
                    after[level + size] += 1
                options.append(cost(after))
        assert cost(packer.counts) == min(options)
        assert [len(x) for x in packer.open] == packer.counts.tolist()
    packer.drain()
    fill = {}
    for p in packer.take():
        fill[p[5]] = fill.get(p[5], 0) + p[2]
    assert sum(n != 64 and n & (n - 1) != 0 for n in fill.values()) <= 1
    monkeypatch.setattr(packing, "OPEN_WINDOWS", 5)
    packer = packing.Packer(64, 0)
    for i in range(300):
        packer.add(i, np.arange(37, dtype="<u4"))
        assert packer.counts.sum() <= 6
