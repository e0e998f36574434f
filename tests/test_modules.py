"""Unicode, JSON, folds, registry and readers."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quillmark.functions import pointer, unicode
from quillmark.operators import folds
from quillmark.operators.registry import ContractError, Operator, Registry
from quillmark.sources import readers


def test_nfkc(spark):
    rows = spark.createDataFrame([("Ａ①",), (None,), ("a",)], "t string").select(unicode.nfkc("t").alias("t")).collect()
    assert [r["t"] for r in rows] == ["A1", None, "a"]


def test_pointers_and_patches(spark):
    doc = '{"summary":"x","sections":[{"a/b":1}],"id":2}'
    rows = spark.createDataFrame([(doc, "/sections/0/a~1b"), (doc, "/sections/4"), (None, "/a"), ("{", "/a")], "d string, p string")
    assert [r[0] for r in rows.select(pointer.get_pointer("d", "p")).collect()] == ["1", None, None, None]
    cases = [(doc, "replace", "/summary", '"y"'), (doc, "replace", "/summary", '"x"'), (doc, "remove", "/id", None), (doc, "add", "/sections/-", "3")]
    got = [r[0] for r in spark.createDataFrame(cases, "d string, o string, p string, v string").select(pointer.patch("d", "o", "p", "v")).collect()]
    assert got == ['{"id":2,"sections":[{"a/b":1}],"summary":"y"}', None, None, '{"id":2,"sections":[{"a/b":1},3],"summary":"x"}']


def test_visual_lines(spark):
    blocks = [(1, 0, 0, 0.5, 0.1, 0.1, 0.02, "world"), (1, 0, 1, 0.1, 0.105, 0.1, 0.02, "hello"), (1, 0, 2, 0.1, 0.3, 0.1, 0.02, "next")]
    got = folds.visual_lines(spark.createDataFrame(blocks, "doc long, page int, ord int, x double, y double, width double, height double, text string"))
    assert sorted((r["line"], r["text"]) for r in got.collect()) == [(0, "hello world"), (1, "next")]


def test_ids_are_reused_once(spark):
    schema = "doc long, pos long, id string, text string, sources array<long>"
    old = spark.createDataFrame([(1, 0, "a", "t", [1]), (1, 1, "b", "t", [2])], schema)
    new = spark.createDataFrame([(1, 0, "", "t", [2]), (1, 1, "", "t", [2, 1]), (1, 2, "", "t", [1])], schema)
    assert sorted(tuple(r)[1:] for r in folds.reused_ids(new, old).collect()) == [(0, "b"), (1, "a"), (2, None)]


def test_registry_checks_contracts(spark):
    schema = StructType([StructField("x", LongType())])
    reg = Registry()
    reg.register(Operator("same", lambda d: d, (schema,), schema))
    df = spark.range(3).select(F.col("id").alias("x"), F.lit(1).alias("y"))
    assert reg.invoke("same", df).columns == ["x"]
    with pytest.raises(ContractError):
        reg.invoke("same", df.drop("x"))
    with pytest.raises(ContractError):
        reg.extend(Operator("same", lambda d: d, (schema,), schema, frozenset({"network"})))
    reg.extend(Operator("same", lambda d: d.select(F.lit("no").alias("z")), (schema,), schema))
    assert reg.invoke("same", df, fallback=True).count() == 3


def test_readers(spark, tmp_path):
    (tmp_path / "w.tsv").write_text("level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext\n5\t1\t1\t1\t1\t1\t3\t4\t5\t6\t90\tHi\n4\t1\t1\t1\t1\t0\t3\t4\t5\t6\t-1\t\n")
    assert [(r["text"], r["conf"]) for r in readers.recognised_words(spark, str(tmp_path / "w.tsv")).collect()] == [("Hi", 0.9)]
    (tmp_path / "m").mkdir()
    (tmp_path / "m/q.md").write_text("---\nid: q1\ntitle: T\n---\n# x\n## Answer\n- **yes** [a](b)\n## End\n")
    units = readers.markdown_units(spark, str(tmp_path / "m"))
    assert readers.sections(units, ["Answer"]).first()["Answer"] == "yes a" and units.first()["id"] == "q1"
