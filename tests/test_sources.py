"""Readers, writers, tokenisers, configurations, and the command line."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from segtide import cli, errors
from segtide.functions.costs import CosineCosts, EmbeddingStore, RuleCosts, UnitCosts
from segtide.functions.normalize import normalize, normalize_text
from segtide.functions.tokens import is_single_token, with_ranges
from segtide.sources import config as C
from segtide.sources import text as T


def test_tokens_take_bytes(spark):
    df = spark.createDataFrame([("aあ🦀", "東京　京都 大阪"), ("", ""), (None, None)], "c string, w string")
    got = df.select(with_ranges(F.col("c"), "character"), with_ranges(F.col("w"), "whitespace")).collect()
    assert [tuple(x)[1:] for x in got[0][0]] == [(0, 1), (1, 4), (4, 8)]
    assert [tuple(x)[1:] for x in got[0][1]] == [(0, 6), (9, 15), (16, 22)]
    assert got[1][0] == [] and got[2][0] is None
    assert spark.range(1).select(is_single_token(F.lit("ab"), "whitespace"), is_single_token(F.lit("a b"), "whitespace")).first() == (True, False)


def test_normal_forms(spark):
    assert normalize_text("ＡＢＣ", "nfkc-casefold") == "abc" and normalize_text("𝐀", "nfkc-casefold") == "a"
    assert spark.range(1).select(normalize(F.lit("ＡＢＣ"), "nfkc-casefold")).first()[0] == "abc"


def test_lines_and_floats(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("x\r\n\ny\rz\n".encode())
    rows = T.read_lines(spark, str(tmp_path / "a.txt")).orderBy("seq_id").collect()
    assert [tuple(r) for r in rows] == [(0, "x"), (1, ""), (2, "y\rz")]
    (tmp_path / "b.txt").write_bytes(b"\xff\n")
    with pytest.raises(Exception, match="UTF-8"):
        T.read_lines(spark, str(tmp_path / "b.txt")).collect()
    df = spark.createDataFrame([(0.0,), (1.0,), (0.19999999,), (1e-5,)], "v float")
    assert [r[0] for r in df.select(T.format_f32(F.col("v"))).collect()] == ["0", "1", "0.19999999", "0.00001"]


def write(path, *records):
    path.write_text("".join(json.dumps(r) + "\n" for r in records), encoding="utf-8")
    return str(path)


def test_configurations(tmp_path):
    write(tmp_path / "r.jsonl", {"operation": "substitution", "from": "a", "to": "b", "cost": 0.25}, {"operation": "deletion", "token": "a", "cost": 2})
    custom = write(tmp_path / "c.json", {"version": 1, "type": "custom", "defaults": {"insertion": 3}, "rules": {"path": "r.jsonl", "format": "jsonl"}})
    costs = C.load_costs(custom)
    assert costs.row("a")[0]["b"] == 0.25 and costs.deletion("a") == 2 and costs.insertions() == ({}, 3) and costs.row("b")[0] == {"b": 0}
    write(tmp_path / "e.jsonl", {"token": "a", "embedding": [1, 0]}, {"token": "b", "embedding": [0, 2]})
    embedding = C.load_costs(write(tmp_path / "d.json", {"version": 1, "type": "embedding", "embeddings": {"path": "e.jsonl", "format": "jsonl"}, "missing_substitution_cost": 0.7}))
    assert embedding.row("a")[0]["b"] == 1 and embedding.row("z")[1] == pytest.approx(0.7)
    for kind in (costs, embedding, UnitCosts()):
        C.save_costs(kind, str(tmp_path / "snap"), "whitespace")
        again = C.open_costs(str(tmp_path / "snap"), "whitespace")
        assert type(again) is type(kind) and again.row("a") == kind.row("a")
    with pytest.raises(errors.TokenizerMismatch):
        C.open_costs(str(tmp_path / "snap"), "character")


@pytest.mark.parametrize("rows", [
    [{"operation": "deletion", "token": "a b", "cost": 1}], [{"operation": "deletion", "token": "a", "cost": -1}], [{"operation": "deletion", "token": "a", "cost": 1, "to": "b"}],
    [{"operation": "swap", "token": "a", "cost": 1}], [{"operation": "deletion", "token": "a", "cost": 1}] * 2,
])
def test_bad_rules(tmp_path, rows):
    with pytest.raises((errors.InvalidFile, errors.InvalidCost), match=r"r\.jsonl:\d"):
        C.read_rules(write(tmp_path / "r.jsonl", *rows), RuleCosts())


@pytest.mark.parametrize("rows", [[], [{"token": "a", "embedding": [0, 0]}], [{"token": "a", "embedding": [1]}, {"token": "b", "embedding": [1, 2]}], [{"token": "a", "embedding": [1]}] * 2, [{"token": "a"}], [{"token": "a b", "embedding": [1]}]])
def test_bad_embeddings(tmp_path, rows):
    with pytest.raises(errors.SegtideError):
        C.read_embeddings(write(tmp_path / "e.jsonl", *rows))


def test_bad_configurations(tmp_path):
    for bad in ({"version": 2, "type": "custom", "rules": {"path": "r", "format": "jsonl"}}, {"version": 1, "type": "custom", "rules": {"path": "r", "format": "jsonl"}, "more": 1}, {"version": 1, "type": "other"}):
        with pytest.raises(errors.InvalidFile):
            C.load_costs(write(tmp_path / "c.json", bad))


def test_word2vec(spark, tmp_path):
    f = tmp_path / "v.txt"
    f.write_text("2 2\na 1 0\nb 0 3\n")
    assert [(r[0], list(r[1])) for r in C.word2vec(spark, str(f)).collect()] == [("a", [1.0, 0.0]), ("b", [0.0, 3.0])]
    assert C.convert_embeddings(spark, str(f), str(tmp_path / "o.jsonl"), config=str(tmp_path / "o.json")) == 2
    assert isinstance(C.load_costs(str(tmp_path / "o.json")), CosineCosts)
    for bad in ("", "3 2\na 1 0\n", "a 1 0\na 0 1\n", "a 1 0\nb 1\n", "a 0 0\n", "a 1 nan\n", "a 1 1e99\n", "a 1 x\n"):
        f.write_text(bad)
        with pytest.raises(errors.InvalidFile):
            C.word2vec(spark, str(f)).collect()


def test_passages(spark, tmp_path):
    p = {"id": 1, "pageid": 2, "revid": 3, "title": "t", "section": "s"}
    with gzip.open(tmp_path / "p.json.gz", "wt") as f:
        f.write("".join(json.dumps(p | {"text": t}) + "\n" for t in (" ", "one\n two", "three")) + "\n")
    assert [(r["line"], r["text"]) for r in T.read_passages(spark, str(tmp_path / "p.json.gz"), 1).collect()] == [(1, "one two")]


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "c.txt").write_text("  new   york  city\nno\tway\n", encoding="utf-8")
    assert cli.main(["index", str(tmp_path / "ix"), str(tmp_path / "c.txt"), "--tokenizer", "whitespace"]) == 0
    assert cli.main(["search", str(tmp_path / "ix"), "york city", "--verify", "--timing"]) == 0
    out = capsys.readouterr()
    assert out.out.splitlines() == ["0\t0\t8\t18\tyork  city"] and "total=" in out.err
    assert cli.main(["search", str(tmp_path / "ix"), "no way"]) == 0
    assert capsys.readouterr().out == '1\t0\t0\t6\t"no\tway"\n'
    assert cli.main(["search", str(tmp_path / "ix"), "york", "-t", "1"]) == 1 and "error" in capsys.readouterr().err
