"""Branches of reply trees against a walk over each tree."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest

from corvane.llm import reply_trees


def brute(rows, branches):
    """``rows``: (conv, turn, role, text, parent turn or None, score or None); the parents are given by turn."""
    convs = defaultdict(set)
    for c, t, role, text, up, score in rows:
        if c is not None and t is not None:
            convs[c].add((t, role or "user", text or "", up, score))
    out = []
    for c, found in convs.items():
        nodes = sorted(found, key=lambda x: (x[0], x[2], x[1], x[3] is not None, x[3] or 0, x[4] is not None, x[4] or 0))
        first = {}
        for i, n in enumerate(nodes):
            first.setdefault(n[0], i)
        parent = [first.get(n[3]) if n[3] is not None else None for n in nodes]
        parent = [None if p is not None and p >= i else p for i, p in enumerate(parent)]
        leaves = []
        for i in range(len(nodes)):
            if i not in parent:
                path, at = [], i
                while at is not None:
                    path.append(at)
                    at = parent[at]
                m = [nodes[j] for j in reversed(path)]
                scores = [x[4] for x in m if x[4] is not None]
                score = float(sum(scores)) if scores else float(len(m))
                text = "".join(f"<|{r}|>\n{t}\n<|end|>\n" for _, r, t, *_ in m)
                leaves.append((-score, -sum(len(x[2]) for x in m), [(x[0], x[1], x[2]) for x in m], len(m), score, text))
        for k, x in enumerate(sorted(leaves)[:branches], 1):
            out.append((c, k, x[3], x[4], x[5]))
    return sorted(out)


@pytest.mark.parametrize("branches", [1, 3])
def test_branches(spark, branches):
    rng = random.Random(branches)
    rows = []
    for c in range(25):
        for t in range(rng.randrange(1, 12)):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["hi", "yes", "", None, f"text {t}"]), rng.choice([None, t - 1, t - 2, rng.randrange(14)]), rng.choice([None, 0.5, 2.0])))
    rows += rows[:5] + [(None, 1, "user", "x", None, None), (1, None, "user", "x", None, None)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, up long, points double, node string")
    found = sorted(tuple(r) for r in reply_trees.conversations(df, branches, "up", "points").collect())
    assert found == brute(rows, branches)


def test_without_parents_turns_follow_each_other(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b2"), (1, 1, "assistant", "b1"), (1, 2, "user", "c"), (1, 2, "user", "c")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = [(r.branch, r.n_messages, r.text) for r in reply_trees.conversations(df, 5).orderBy("branch").collect()]
    turn = lambda role, text: f"<|{role}|>\n{text}\n<|end|>\n"
    assert found == [(1, 3, turn("user", "a") + turn("assistant", "b1") + turn("user", "c")), (2, 2, turn("user", "a") + turn("assistant", "b2"))]


def test_long_chain_and_empty(spark):
    df = spark.createDataFrame([(1, t, "user", "x" * (100_000 if t == 3 else 1)) for t in range(12)], "conv_id long, turn long, role string, text string")
    assert reply_trees.conversations(df).first().n_messages == 12
    assert reply_trees.conversations(df.where("false")).count() == 0


def test_replies_by_message_id(spark):
    """Of two answers to one question each has its own follow-up; ids needn't be in order."""
    rows = [(1, "q", None, 0, "user", "question", 1.0), (1, "a1", "q", 1, "assistant", "first", 1.0), (1, "a2", "q", 1, "assistant", "second", 3.0), (1, "f1", "a1", 2, "user", "to first", 1.0), (1, "f2", "a2", 2, "user", "to second", 1.0)]
    rows += [(2, "x", "x", 0, "user", "itself", None), (2, "y", "gone", 1, "user", "orphan", None), (2, "c1", "c2", 2, "user", "cycle a", None), (2, "c2", "c1", 3, "user", "cycle b", None), (2, "c2", "c1", 3, "user", "cycle b", None)]
    df = spark.createDataFrame(rows, "conv_id long, id string, up string, turn long, role string, text string, points double")
    got = [(r.conv_id, r.branch, r.score, [x.split("\n")[1] for x in r.text.split("<|")[1:] if "|>" in x and not x.startswith("end")]) for r in reply_trees.conversations(df, 9, "up", "points", "id").collect()]
    assert sorted(got)[:2] == [(1, 1, 5.0, ["question", "second", "to second"]), (1, 2, 3.0, ["question", "first", "to first"])]
    assert sorted(x[3] for x in got if x[0] == 2) == [["cycle a", "cycle b"], ["itself"], ["orphan"]]


@pytest.mark.parametrize("doublings", [1, 2, 6])
def test_deep_trees_with_short_stretches(spark, doublings):
    rng = random.Random(doublings)
    nodes = [(c, n, None if n == 1 else n - 1 if c == 0 or rng.random() < 0.8 else rng.randrange(1, n)) for c, size in ((0, 75), (1, 40), (2, 1)) for n in range(1, size + 1)]
    df = reply_trees.stage(spark.createDataFrame(nodes, "conv_id long, node long, parent long"), "nodes")
    found = sorted((r.conv_id, r.leaf, list(r.path)) for r in reply_trees.paths(df, doublings).collect())
    up = {(c, n): p for c, n, p in nodes}
    want = []
    for c, n, _ in nodes:
        if (c, n) not in {(x, p) for x, _, p in nodes}:
            path = [n]
            while up[c, path[0]]:
                path.insert(0, up[c, path[0]])
            want.append((c, n, path))
    assert found == sorted(want)
