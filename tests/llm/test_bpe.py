"""Tree concatenation gives the very tokens of the tokenizer, and they decode to the text."""

from __future__ import annotations

import random

import pytest

from corvane.llm import bpe


@pytest.fixture(scope="module")
def vocabulary():
    with open(bpe.VOCABULARY, "rb") as f:
        return f.read()


def unsplit(rng, n):
    """Text without a place to cut."""
    kinds = ["abcdefghijklmnopqrstuvwxyz", "ab", "äöüßéèç", "0123456789", "漢字仮名交文", "aaaab", "=-*#", " ", "😀é"]
    out = ""
    while len(out) < n:
        out += "".join(rng.choices(rng.choice(kinds), k=rng.randint(1, n)))
    return out[:n]


def test_tree_concatenation_is_exact(vocabulary):
    rng, coder, tree = random.Random(1), bpe.encoding(vocabulary), bpe.Tree(bpe.encoding(vocabulary))
    for n in [1, 7, 50, 300, 3000]:
        for leaf in (5, 16, 64):
            for _ in range(12):
                text = unsplit(rng, n)
                assert tree.long(text, leaf).tolist() == coder.encode_ordinary(text), (n, leaf, text[:80])


def test_cuts_put_together_are_the_text(vocabulary):
    rng, coder = random.Random(2), bpe.encoding(vocabulary)
    for _ in range(200):
        text = "".join(rng.choices(["ab", " ", "\n", "  ", "'s", "9", "é", "!"], k=60))
        parts = bpe.cuts(text, 10)
        assert "".join(parts) == text
        assert [t for p in parts for t in coder.encode_ordinary(p)] == coder.encode_ordinary(text)


def test_encode_and_decode(spark, docs_of, vocabulary):
    coder, rng = bpe.encoding(vocabulary), random.Random(3)
    rows = [(1, None), (2, ""), (3, "Hello world, <|endoftext|> it's"), (None, "null id"), (3, "again"), (4, unsplit(rng, 2000)), (5, "word " * 1000), (6, unsplit(rng, 900) + " " + unsplit(rng, 900)), (4, unsplit(rng, 2000))]
    out = bpe.encode(docs_of(rows), leaf=64, spread=300)
    assert out.columns == ["doc_id", "tokens", "n_tokens", "exact"]
    want = [(i, None if t is None else coder.encode_ordinary(t)) for i, t in rows]
    got = out.collect()
    assert sorted(((r.doc_id, r.tokens) for r in got), key=repr) == sorted(want, key=repr)
    assert all(r.exact is None if r.tokens is None else r.exact for r in got)
    assert all(r.n_tokens == (None if r.tokens is None else len(r.tokens)) for r in got)
    back = bpe.decode(out)
    assert sorted(((r.doc_id, r.text) for r in back.collect()), key=repr) == sorted(rows, key=repr)


def test_empty(docs_of):
    assert bpe.encode(docs_of([])).count() == 0


def test_very_long_unsplit_text(docs_of, vocabulary):
    rng = random.Random(5)
    text = "".join(rng.choices("abcdefgh", k=200_000))
    assert bpe.encode(docs_of([(1, text)])).first().exact
    assert bpe.decode(bpe.encode(docs_of([(1, text)]))).first().text == text
