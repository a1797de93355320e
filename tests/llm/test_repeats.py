import collections
import hashlib
import random

import pytest

from pastward.llm import repeats as R


def brute(texts, length):
    seen = collections.Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        inside = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                inside[i:i + length] = [True] * length
        kept = bytes(b for b, gone in zip(t, inside) if not gone)
        spans = sum(gone and (i == 0 or not inside[i - 1]) for i, gone in enumerate(inside))
        out.append((len(t), sum(inside), spans, hashlib.sha256(kept).hexdigest()))
    return out


def got(df, length, window):
    rows = R.repeated_bytes(df, length, window).collect()
    return sorted((tuple(r) for r in rows), key=repr)


def corpus(seed, count, alphabet):
    draw = random.Random(seed)
    passages = ["".join(draw.choice(alphabet) for _ in range(draw.randrange(10, 90))) for _ in range(6)]
    texts = []
    for _ in range(count):
        parts = []
        for _ in range(draw.randrange(0, 5)):
            p = draw.choice(passages)
            a = draw.randrange(len(p))
            parts += [p[a:] if draw.random() < 0.4 else p, "".join(draw.choice(alphabet) for _ in range(draw.randrange(0, 30)))]
        texts.append("".join(parts))
    return texts


@pytest.mark.parametrize("seed,alphabet", [(1, "abcdefgh é"), (2, "ab"), (3, "a")])
def test_same_as_brute_force(docs, seed, alphabet):
    texts = corpus(seed, 60, alphabet)
    expected = brute([t.encode() for t in texts], 40)
    assert got(docs(*enumerate(texts)), 40, 20) == sorted(((i, *e) for i, e in enumerate(expected)), key=repr)


def test_cores_in_parts(docs, monkeypatch):
    monkeypatch.setattr(R, "CHUNK_SUFFIXES", 5)
    monkeypatch.setattr(R, "CHUNK_BYTES", 300)
    draw = random.Random(4)
    shared = "".join(draw.choice("abcdefgh") for _ in range(40))
    texts = [draw.choice("xyz") * draw.randrange(3) + shared + draw.choice("pqrs") * draw.randrange(4) + str(k) * 30 for k in range(40)]
    expected = brute([t.encode() for t in texts], 40)
    assert got(docs(*enumerate(texts)), 40, 20) == sorted(((i, *e) for i, e in enumerate(expected)), key=repr)


def test_special_rows(docs, clashing):
    empty = hashlib.sha256(b"").hexdigest()
    text = "".join(chr(97 + k * 7 % 26) for k in range(30)) + "0123456789" * 2
    df = clashing(docs((1, None), (2, ""), (3, "short"), (4, text), (4, text), (None, "-" + text)))
    rows = [tuple(r) for r in R.repeated_bytes(df, 40, 20).collect()]
    assert len(rows) == 6
    assert (1, 0, 0, 0, empty) in rows and (2, 0, 0, 0, empty) in rows and (3, 5, 0, 0, hashlib.sha256(b"short").hexdigest()) in rows
    assert rows.count((4, 50, 50, 1, empty)) == 2 and (None, 51, 50, 1, hashlib.sha256(b"-").hexdigest()) in rows
    one = R.repeated_bytes(df, 40, 20, contents=True).filter("doc_id IS NULL").head()
    assert bytes(one["kept"]) == b"-" and [tuple(s) for s in one["spans"]] == [(1, 51)]


def test_empty_table(docs):
    assert R.repeated_bytes(docs()).collect() == []
