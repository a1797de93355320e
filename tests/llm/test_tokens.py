import struct
import zlib

import pytest

from pastward.llm import packing, token_files, token_ids
from pastward.llm.shared import Scratch

PATH = token_ids.vocabulary_path()
TEXTS = [
    "Plain text, with 12 numbers & signs... it's don't WE'LL", "", None, "a\u0085b c \x1c\x1d tab\tnew\nline", "İstanbul ŒUVRE straße ÉTÉ", "x<|endoftext|>y", "日本 Σς é",
    "12½ ²³ ª º µ", "word " * 3000, "'s ''t ...'m", "ſ Ŀ ŉ", "ZWSP​\x00\x7f", "q" * 5000,
]


def library(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids


def test_pieces_give_the_ids_of_the_library():
    for room in (2, 400_000):
        encoder = token_ids.PieceEncoder(PATH, room)
        for text in TEXTS * 2:
            ids = library(text)
            assert encoder.packed(text) == struct.pack(f"<{len(ids)}I", *ids)


@pytest.fixture
def many(docs, clashing):
    rows = list(enumerate(TEXTS)) + [(None, "no id"), (3, "again"), (3, "again")]
    return clashing(docs(*rows)), sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))


def test_token_files_round_trip(spark, many):
    df, rows = many
    path = Scratch(spark, "test").path("ids")
    token_files.write_token_files(df, path, PATH)
    expected, at = [], 0
    for doc, text in rows:
        ids = library(text) + [2]
        expected.append((doc, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        at += len(ids)
    got = sorted((tuple(r) for r in token_files.read_digests(spark, path).collect()), key=lambda r: r[1])
    assert got == expected
    assert token_files.read_document(spark, path, 8) == library(TEXTS[8]) + [2]
    assert token_files.read_document(spark, path, 999) is None


def test_token_file_refuses_another_dictionary():
    data = token_files.pack_file([1, None], [1, 1], [b"", b""], 2, b"one")
    assert token_files.TokenFile(data, b"one").ids == [1, None]
    with pytest.raises(ValueError):
        token_files.TokenFile(data, b"two")


def test_no_documents(spark, docs):
    path = Scratch(spark, "test").path("ids")
    token_files.write_token_files(docs(), path, PATH)
    assert token_files.read_digests(spark, path).collect() == []
    assert packing.packed(docs(), PATH).collect() == []


def test_packing_covers_every_id_once(many):
    df, rows = many
    pieces = packing.packed(df, PATH, window=64).collect()
    sequences, parts = {}, {}
    for p in pieces:
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
        parts.setdefault((p["doc_id"], p["doc_tokens"]), []).append((p["start"], p["length"], p["ids_crc32"]))
    for found in sequences.values():
        found.sort()
        assert [a for a, _ in found] == [sum(n for _, n in found[:k]) for k in range(len(found))]
        total = sum(n for _, n in found)
        assert total <= 64 and total & (total - 1) == 0
    for doc, text in rows:
        ids = library(text) + [2]
        own = parts[doc, len(ids)]
        for start, length, crc in own:
            assert zlib.crc32(struct.pack(f"<{length}I", *ids[start:start + length])) == crc
        copies = sum(r == (doc, text) for r in rows)
        assert sum(n for _, n, _ in own) == copies * len(ids)


def test_neighbours_fill_the_window_of_their_seed(docs):
    import random

    draw = random.Random(5)
    topics = [[f"{a}{b}" for b in ("ka", "lo", "mi", "ne", "pu", "ra", "so", "ti")] for a in ("ba", "du", "fe", "go")]
    rows = [(k, " ".join(draw.choice(topics[k % 4]) for _ in range(30))) for k in range(80)]
    pieces = packing.packed(docs(*rows), PATH, window=512).collect()
    seen = {}
    for p in pieces:
        seen.setdefault(p["sequence_id"], []).append(p["doc_id"] % 4)
    same = sum(max(v.count(t) for t in range(4)) for v in seen.values() if len(v) > 3)
    assert same > 0.6 * sum(len(v) for v in seen.values() if len(v) > 3)  # a quarter by chance
