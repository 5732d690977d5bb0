"""How raw values become comparable text, and how JSON becomes documents."""

from __future__ import annotations

import tempfile

import pytest
from helpers import as_set
from pyspark.sql import functions as F

from docweave.functions import values as V
from docweave.operators.joins import natural_join
from docweave.operators.pairs import dedupe_documents, shred, to_document
from docweave.sources import json_documents as JD
from docweave.sources.json_documents import parse_documents, read_json_documents, stream_documents
from docweave.sources.sinks import joinable_lines, write_joinable_csv

FIRST = '[{"a":1,"b":"x"},{"a":"1","nested_arr":["q","p"]},{"nested_arr":["p","q"],"n":null},{"o":{"z":1}}]'
SECOND = '[{"a":-5,"b":"2020-01-01"},{"b":"x|y"},{"b":""},{}]'


@pytest.fixture(scope="module")
def folder():
    path = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    for name, text in (("one.json", FIRST), ("two.json", SECOND)):
        with open(f"{path}/{name}", "w") as f:
            f.write(text)
    return path


def maps(df) -> dict:
    return {r["doc"].rsplit("/", 1)[-1]: r["m"] for r in df.collect()}


def test_reads_arrays(spark, folder):
    assert maps(read_json_documents(spark, folder, set_attrs=("nested_arr",))) == {
        "one.json#0": {"a": "1", "b": "x"},
        "one.json#1": {"a": "1", "nested_arr": '["p","q"]'},
        "one.json#2": {"nested_arr": '["p","q"]', "n": "null"},
        "one.json#3": {},
        "two.json#0": {"a": "-5", "b": "2020-01-01"},
        "two.json#1": {"b": "x|y"},
        "two.json#2": {"b": ""},
        "two.json#3": {},
    }


def test_documents_read_join(spark, folder):
    docs = read_json_documents(spark, folder, set_attrs=("nested_arr",)).withColumn("w", F.lit(0).cast("bigint"))
    got = {(r["a"].rsplit("#")[-1], r["b"].rsplit("#")[-1]) for r in natural_join(docs).collect()}
    assert got == {("0", "1"), ("1", "2")}


def test_nulls_can_be_dropped(spark, folder):
    assert maps(read_json_documents(spark, folder, nulls="drop"))["one.json#2"] == {"nested_arr": '["p","q"]'}


def parse_one(spark, text, **rules):
    df = spark.createDataFrame([("f", text)], "file string, value string")
    return [r["m"] for r in parse_documents(df, **rules).orderBy("doc").collect()]


def test_number_text_is_kept(spark):
    assert parse_one(spark, '[{"a":1,"b":1.0,"c":"1","d":true,"e":10000000000000000000000}]') == [
        {"a": "1", "b": "1.0", "c": "1", "d": "true", "e": "10000000000000000000000"}
    ]


def test_last_duplicate_key_wins_and_keys_are_trimmed(spark):
    assert parse_one(spark, '[{"a":1,"b":2,"a":3," b ":"  4 "}]') == [{"a": "3", "b": "4"}]


def test_object_is_told_from_equal_text(spark):
    text = '[{"o":{"x":1},"s":"{\\"x\\":1}"}]'
    assert parse_one(spark, text) == [{"s": '{"x":1}'}]
    assert parse_one(spark, text, nested="whole") == [{"o": '{"x":1}', "s": '{"x":1}'}]


def test_whole_objects_are_canonical(spark):
    got = parse_one(spark, '[{"o":{"b":1,"a":{"y":2,"x":1}}},{"o":{"a":{"x":1,"y":2},"b":1}}]', nested="whole")
    assert got[0] == got[1] == {"o": '{"a":{"x":1,"y":2},"b":1}'}


def test_flatten(spark):
    text = '[{"p":{"a":1,"q":{"b":[1,2],"c":null}},"r":2,"e":{}}]'
    assert parse_one(spark, text, nested="flatten", depth=2) == [{"p_a": "1", "p_q_b": "[1,2]", "p_q_c": "null", "r": "2"}]


def test_flatten_deeper_than_the_depth_given_fails(spark):
    text = '[{"a":{"b":{"c":{"d":1}}}}]'
    assert parse_one(spark, text, nested="flatten", depth=3) == [{"a_b_c_d": "1"}]
    with pytest.raises(Exception, match="deeper than 2"):
        parse_one(spark, text, nested="flatten", depth=2)


def test_depth_counts_braces_outside_strings(spark):
    text = r'[{"a":{"b":"}}{{{","c":{"d\"{":1}}},{"x":1}]'
    assert spark.range(1).select(JD.object_depth(F.lit(text))).first()[0] == 3


def test_array_order_matters_unless_declared_a_set(spark):
    text = '[{"x":["b","a","b"]},{"x":["a","b"]}]'
    plain = parse_one(spark, text)
    assert plain[0] != plain[1]
    as_sets = parse_one(spark, text, set_attrs=("x",))
    assert as_sets[0] == as_sets[1]
    assert parse_one(spark, '[{"x":"text"},{"x":null}]', set_attrs=("x",)) == [{"x": "text"}, {"x": "null"}]


def test_lines_layout(spark):
    path = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    with open(f"{path}/l.json", "w") as f:
        f.write('[\n{"id":"x","a":1},\n  {"id":"y","a":[1,2]}\n]\n')
    by_id = read_json_documents(spark, path, "lines", "id")
    assert {r["doc"]: r["m"] for r in by_id.collect()} == {"x": {"a": "1"}, "y": {"a": "[1,2]"}}
    numbered = read_json_documents(spark, path, "lines")
    assert numbered.select("doc").distinct().count() == 2
    with pytest.raises(ValueError):
        stream_documents(spark, path, layout="lines")


def test_repeated_keys_in_nested_objects_lose_nothing(spark):
    text = '[{"o":{"x":1,"x":2},"a":1},{"a":2}]'
    assert parse_one(spark, text) == [{"a": "1"}, {"a": "2"}]


def test_malformed_text_fails(spark):
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        parse_one(spark, '[{"a":1},{"a":')


def test_encode_and_decode_cut_at_the_first_separator(spark):
    df = spark.createDataFrame([(["a-2020-01-01", "b--5", "c-", "d"],)], "t array<string>")
    got = df.select(V.decode_pairs(F.col("t")).alias("p")).first()["p"]
    assert [(p["attr"], p["val"]) for p in got] == [("a", "2020-01-01"), ("b", "-5"), ("c", ""), ("d", "")]
    back = df.select(V.encode_pairs(V.decode_pairs(F.col("t"))).alias("t")).first()["t"]
    assert back == ["a-2020-01-01", "b--5", "c-", "d-"]


def test_trim_pairs(spark):
    df = spark.createDataFrame([([(" a ", " 1"), ("b", "2 ")],)], f"p array<{V.PAIR}>")
    got = df.select(V.trim_pairs(F.col("p")).alias("p")).first()["p"]
    assert [(p["attr"], p["val"]) for p in got] == [("a", "1"), ("b", "2")]


def test_last_write_of_a_document_wins(spark):
    df = spark.createDataFrame(
        [(0, 1, {"a": "old"}, 1), (0, 1, {"a": "new"}, 5), (0, 1, {"a": "mid"}, 3), (1, 1, {"a": "other"}, 2)],
        "w long, doc long, m map<string,string>, pos long",
    )
    got = {(r["w"], r["doc"]): (r["m"], r["pos"]) for r in dedupe_documents(df, "pos").collect()}
    assert got == {(0, 1): ({"a": "new"}, 5), (1, 1): ({"a": "other"}, 2)}


def test_pairs_and_back(golden):
    back = to_document(shred(golden).unionByName(shred(golden)))
    want = {r["doc"]: r["m"] for r in golden.collect() if r["m"]}
    assert {r["doc"]: r["m"] for r in back.collect()} == want


def test_csv_lines(spark, golden):
    from docweave.operators.joins import joinable_sets

    sets = joinable_sets(natural_join(golden), golden)
    assert as_set(joinable_lines(sets), "DocumentID", "JoinableDocuments") == {
        ("1", "2,4"), ("2", "1,4"), ("3", "4"), ("4", "1,2,3"), ("5", "None"), ("6", "None"),
    }
    path = tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/csv"
    write_joinable_csv(sets, path)
    assert spark.read.csv(path, sep="|", header=True).count() == 6
