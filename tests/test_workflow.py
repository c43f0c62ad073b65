"""Workflows, templates and tabular input against literal results."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from corvane.functions.template import fill, rules
from corvane.functions.vectors import hashing_encoder
from corvane.operators import packing, retrieval
from corvane.operators.workflow import Task, Workflow, accepts, export
from corvane.plans import catalogue_text
from corvane.plans.app import App
from corvane.plans.engine import Index, Settings
from corvane.sources import tabular
from corvane.sources.content import Content


def data(df):
    return [r["data"] for r in df.orderBy("n").collect()]


@pytest.fixture(scope="module")
def two(spark):
    return spark.createDataFrame([(0, 2), (1, 4)], "n int, data int")


SQUARE, FOURTH = (lambda x: x**2), (lambda x: x**3)


def test_chain(spark):
    rows = spark.createDataFrame(list(enumerate([1, 2, 4, 8, 16, 32])), "n int, data int")
    w = Workflow([Task([lambda x: x * 2]), Workflow([Task([lambda x: x - 1])])])
    assert data(w(rows)) == [1, 3, 7, 15, 31, 63]


def test_hstack(two):
    assert [tuple(x) for x in data(Task([SQUARE, FOURTH])(two))] == [(4, 8), (16, 64)]


def test_vstack(two):
    assert sorted(data(Task([SQUARE, FOURTH], merge="vstack")(two))) == [4, 8, 16, 64]


def test_concat(two):
    out = Task([lambda x: (x**2).cast("int"), lambda x: (x**3).cast("int")], merge="concat")(two)
    assert data(out) == ["4. 8", "16. 64"]


def test_concat_leaves_out_what_counts_as_false(spark):
    rows = spark.createDataFrame([(0, "")], "n int, data string")
    assert data(Task([lambda x: x, lambda x: F.lit("a"), lambda x: F.lit(0), lambda x: F.lit(None).cast("string")], merge="concat")(rows)) == ["a"]


def test_separate(two):
    out = Task([SQUARE, FOURTH], merge=None)(two)
    assert [(r.out0, r.out1) for r in out.orderBy("n").collect()] == [(4, 8), (16, 64)]


def test_select_passes_others_unchanged(spark):
    rows = spark.createDataFrame([(0, "a.TXT"), (1, "b.md")], "n int, data string")
    assert data(Task([F.upper], select=r"\.txt$")(rows)) == ["A.TXT", "b.md"]


def test_one_to_many(spark):
    rows = spark.createDataFrame([(0, "a b"), (1, "c")], "n int, data string")
    split = lambda x: F.split(x, " ")
    assert data(Task([split])(rows)) == ["a", "b", "c"]
    assert data(Task([split], explode=False)(rows)) == [["a", "b"], ["c"]]


def test_hooks_and_columns(spark):
    said = []
    rows = spark.createDataFrame([(0, (1, 2))], "n int, data struct<x: int, y: int>")
    t = Task([lambda x: x + 1, lambda x: x + 1], column=["x", 1], initialize=lambda: said.append("in"), finalize=lambda: said.append("out"))
    w = Workflow([Workflow([t])])
    assert said == [] and tuple(data(w(rows))[0]) == (2, 3) and said == []
    assert w.run(rows, lambda df: said.append("rows") or df.count()) == 1 and said == ["in", "rows", "out"]
    with pytest.raises(ZeroDivisionError):
        w.run(rows, lambda df: 1 / 0)
    assert said[3:] == ["in", "out"]


def test_schedule_goes_on_after_errors(two):
    turns = []

    def run(df):
        turns.append(df.count())
        if len(turns) == 1:
            raise ValueError("broken")

    errors = Workflow([Task([SQUARE])]).schedule(lambda: two, run, 3)
    assert turns == [2, 2, 2] and len(errors) == 1 and "broken" in errors[0]


def test_accepts(spark):
    rows = spark.createDataFrame([("http://a/b",), ("x.PNG",), ("/tmp/x",), ("word",)], "d string")
    got = [tuple(r) for r in rows.select(*(accepts(k, F.col("d")) for k in ("url", "image", "file"))).collect()]
    assert got == [(True, False, False), (False, True, False), (False, False, True), (False, False, False)]


def test_template(spark):
    rows = spark.createDataFrame([("q", None)], "a string, b string")
    assert rows.select(fill("Q: {a} C: {b}", {"a": F.col("a"), "b": F.col("b")})).first()[0] == "Q: q C: "
    with pytest.raises(KeyError):
        fill("{a}", {"a": F.col("a"), "b": F.col("b")})
    with pytest.raises(KeyError):
        fill("{c}", {})
    assert fill("{a}", {"a": F.col("a"), "b": F.col("b")}, strict=False) is not None


def test_rules(spark):
    rows = spark.createDataFrame([("stop",), ("go",)], "a string")
    assert [r[0] for r in rows.select(rules(F.col("a"), {"stop": F.lit("halt")}, F.col("a"))).collect()] == ["halt", "go"]


def test_tabular(spark):
    rows = spark.createDataFrame([(1, "a", 0, "x"), (2, None, 3, "")], "id int, text string, flag int, more string")
    out = tabular.documents(rows, "id", content=["flag"]).orderBy("id").collect()
    assert [(r.id, r.text, r.data) for r in out] == [("1", "a. x", '{"flag":0}'), ("2", "3", '{"flag":3}')]


def test_csv_in_and_out(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a, b"), (2, 'say "c"')], "id int, text string")
    export(rows, str(tmp_path / "out"))
    assert sorted(tuple(r) for r in tabular.read_csv(spark, str(tmp_path / "out"), "id int, text string").collect()) == [(1, "a, b"), (2, 'say "c"')]


def test_files_only_from_the_allowed_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("hello")
    assert tabular.read_files(spark, str(tmp_path / "in"), str(tmp_path)).first()["content"] == b"hello"
    (tmp_path / "in-evil").mkdir()
    for bad in ("/etc", f"{tmp_path}/../x", f"file://{tmp_path}/in"):
        with pytest.raises(ValueError, match="not in"):
            tabular.read_files(spark, bad, str(tmp_path))
    with pytest.raises(ValueError, match="not in"):
        tabular.read_files(spark, str(tmp_path / "in-evil"), str(tmp_path / "in"))
    assert tabular.within("s3a://b/x/y", "s3a://b/x/") and not tabular.within("s3a://c/x/y", "s3a://b/x")


def test_segments_of_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("One line.\n\nTwo\nlines.\n")
    (tmp_path / "b.html").write_text("<html><body><article><h1>Head</h1><p>First.</p><p>Second.</p></article></body></html>")
    (tmp_path / "c.txt").write_text("")
    (tmp_path / "d.txt").write_bytes(b"caf\xe9")
    got = [(r.path.rsplit("/", 1)[1], r.pos, r.text) for r in tabular.read_segments(spark, str(tmp_path), str(tmp_path)).collect()]
    assert sorted(got) == [("a.txt", 0, "One line."), ("a.txt", 1, "Two lines."), ("b.html", 0, "# Head"), ("b.html", 1, "First."), ("b.html", 2, "Second."), ("d.txt", 0, "caf\ufffd")]


def test_streams_of_tokens(spark):
    rng = random.Random(1)
    rows = [(i, [rng.randrange(99) for _ in range(rng.choice([0, 1, 3, 40]))]) for i in range(60)] + [(60, None)]
    df = spark.createDataFrame(rows, "n int, tokens array<int>").repartition(7)
    every = [t for _, ts in rows for t in ts or []]
    for length in (1, 7, 1000):
        got = {r.chunk: list(r.tokens) for r in packing.concat(df, "n", length).collect()}
        want = [every[a : a + length] for a in range(0, len(every), length)]
        assert got == dict(enumerate(want if len(want) == 1 else [w for w in want if len(w) == length]))
    got = [(r.batch, r.chunk, list(r.tokens)) for r in packing.pack(df, "n", 50, batch=20).collect()]
    kept = [ts for _, ts in rows if ts]
    want = [(b, i, c) for b in range(-(-len(kept) // 20)) for i, c in enumerate(packing.packed([list(x) for x in kept[b * 20 : b * 20 + 20]], 50))]
    assert sorted(got) == sorted(want) and sorted(t for *_, c in got for t in c) == sorted(every)
    assert packing.concat(df.where("false"), "n", 5).count() == 0


def test_packed_turns_as_in_plain_python(spark, tiny):
    rows = sorted((r.conv_id, r.turn, r.text.split()) for r in spark.read.parquet(f"{tiny}/conversations.parquet").collect())
    want = [" ".join(c) for b in range(0, len(rows), 1000) for c in packing.packed([list(w) for *_, w in rows[b : b + 1000] if w], 512)]
    assert [r.text for r in catalogue_text.pack_records(spark, tiny).orderBy("batch", "chunk").collect()] == want


def test_answers(spark):
    asked = spark.createDataFrame([(0, "apple pie?"), (1, None)], "qid int, prompt string")
    found = spark.createDataFrame([(0, 7, "apple pie? yes"), (0, 8, "nothing")], "qid int, indexid long, text string")
    model = lambda s: s.str.upper()
    rows = lambda *a: [tuple(r) for r in retrieval.answers(asked, model, *a).orderBy("qid").collect()]
    assert rows() == [(0, "0", "APPLE PIE?"), (1, "1", None)] and rows("flatten") == [(0, "APPLE PIE?"), (1, None)]
    assert rows("reference", found, hashing_encoder()) == [(0, "0", "APPLE PIE?", 7), (1, "1", None, None)]


def test_an_application(spark, tmp_path):
    config = {
        "writable": True, "path": str(tmp_path / "app"), "index": {"dense": True, "columns": {"text": "body"}}, "graph": {"limit": 3, "minscore": -1.0, "topics": {"terms": 1}},
        "workflow": {"load": {"tasks": [{"action": ["upper"], "select": "bear"}, {"action": "upsert"}]}, "ask": {"tasks": [{"action": "search", "args": {"limit": 1}}]}, "fill": {"tasks": [{"template": "<{t}>", "columns": {"t": "x"}}]}},
    }
    app = App(spark, config)
    assert app.count() == 0
    rows = spark.createDataFrame([("1", "park bear attack"), ("2", "ice shelf")], "id string, data string")
    app.workflow("load", rows)
    assert app.count() == 2 and app.search("bear").first()["text"] == "PARK BEAR ATTACK"
    app.workflow("load", spark.createDataFrame([("2", "quiet bear"), ("3", "comet")], "id string, data string"))
    again = App(spark, json.dumps(config))
    assert again.count() == 3 and again.search("comet", 1).first()["id"] == "3"
    assert [r["id"] for r in again.workflow("ask", spark.createDataFrame([("quiet",)], "data string"))] == ["2"]
    assert [r["data"] for r in again.workflow("fill", spark.createDataFrame([("1", ("y",))], "id string, data struct<x: string>"))] == ["<y>"]
    assert again.delete(["1"]).count() == 2
    with pytest.raises(PermissionError):
        App(spark, {**config, "writable": False}).delete(["2"])


def test_tables_of_a_database(spark, tmp_path):
    content = Content.of(spark.createDataFrame([(i, f"text {i}") for i in range(40)], "id long, text string"), "id")
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    kinds = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    content.save_jdbc(url, kinds)
    back = Content.load_jdbc(spark, url, kinds)
    assert sorted((r.indexid, r.id, r.text) for r in back.sections.collect()) == sorted((r.indexid, r.id, r.text) for r in content.sections.collect())
    assert back.documents.count() == 40


def test_encoding_goes_on_where_it_stopped(spark, tmp_path):
    calls = str(tmp_path / "calls")
    inner = hashing_encoder(16)

    def encoder(texts):
        with open(calls, "a") as f:
            f.writelines(f"{t}\n" for t in texts)
        return inner(texts)

    docs = [(i, f"text {i % 6}") for i in range(8)]
    index = Index.of(spark.createDataFrame(docs, "id long, text string"), "id", Settings(keyword=False), encoder=encoder)
    assert index.encoded_at(str(tmp_path / "v"), 3).count() == 8
    assert len(open(calls).readlines()) == 6
    more = Index.of(spark.createDataFrame([*docs, (9, "other")], "id long, text string"), "id", Settings(keyword=False), encoder=encoder)
    found = {r.indexid: list(r.vector) for r in more.encoded_at(str(tmp_path / "v"), 3).collect()}
    assert len(found) == 9 and len(open(calls).readlines()) == 7 and found[0] == found[6]
