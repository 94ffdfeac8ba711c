import collections
import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as P
from loamlearn.llm import mixing, queries, secrets

DIR = "/root/testdata/sf0.001"


def test_registered():
    q = queries.queries()
    assert {k.split("_")[0] for k in q} == {f"op{i}" for i in range(1, 11)} | {"pipeline"} and len(P.STAGES) == 5


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    counts = {}
    for name, stage in P.STAGES:
        before = docs
        stage(spark, docs, DIR).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "encode":
            assert docs.columns == before.columns
        counts[name] = docs.count()
        if name == "near_duplicates":
            from tests_brute import brute_join

            rows = [(r["doc_id"], r["text"]) for r in before.collect()]
            assert sorted(r["doc_id"] for r in docs.collect()) == sorted(i for i, c in brute_join(rows, 5, 80) if i == c)
        if name == "language":
            assert counts[name] == sum(bool(re.search(r"[^\W\d_]", r["text"] or "")) for r in before.collect())
        if name == "secret_scan":
            assert counts[name] == counts["near_duplicates"]
            spans = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"] if s["verdict"] != "example"] for r in secrets.scan_secrets(before).collect()}
            was = {r["doc_id"]: r["text"] for r in before.collect()}
            for r in docs.collect():
                assert r["text"] == brute_masked(was[r["doc_id"]], spans[r["doc_id"]]) and r["n_chars"] == len(r["text"])
        if name == "mix":
            took = {r["doc_id"]: r for r in mixing.mix_sources(before).collect()}
            times = collections.Counter(r["doc_id"] for r in docs.collect())
            for i, r in took.items():  # half of a turn's words or more make a copy
                assert times.get(i, 0) == int(r["taken"] / r["size"] + 0.5) if r["size"] else i not in times
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(str(tmp_path / "mix")).collect()}
    for r in docs.collect():
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() and len(np.frombuffer(r["ids"], "<u4")) == r["n_tokens"]


def brute_masked(text, spans):
    out, at = [], 0
    for a, b in spans:
        if a >= at:
            out.append(text[at:a] + "[SECRET]")
        at = max(at, b)
    return "".join(out) + text[at:]


def test_near_duplicates_by_row(spark):
    t = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, t, "en", "a", 1, 7), (1, "other words that stand quite alone here for themselves", "en", "a", 1, 7), (0, t + " end", "en", "a", 1, 7), (None, "a null id with words enough to count", "en", "a", 1, 7), (None, "a null id with words enough to count", "en", "b", 1, 7), (None, t, "en", "a", 1, 7), (9, None, "en", "a", 1, 7), (9, "", "en", "a", 1, 7), (9, "", "en", "a", 1, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, __key int")
    got = sorted(((r["doc_id"], r["text"]) for r in P.near_duplicates(spark, docs, DIR).collect()), key=str)
    assert got == sorted([(0, t + " end"), (1, rows[1][1]), (None, rows[3][1]), (9, None), (9, "")], key=str)


def test_odd_rows(spark, tmp_path):
    rows = [(1, "eins zwei drei vier fünf sechs", "de", "a", 1, "x"), (1, "eins zwei drei vier fünf sechs", "de", "a", 1, "x"), (None, "one two three four five six", "en", None, 1, "y"), (3, None, None, "a", 0, "z"), (4, "", "en", "b", 0, "z"), (5, "12 34", "en", "b", 0, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, __found string").withColumns({c: F.lit(1) for c in ("__key", "__row", "__id", "__slot", "__cuts", "__lang_pred", "row_key", "size")})
    for name, stage in P.STAGES:
        stage(spark, docs, DIR).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name == "near_duplicates":
            assert sorted((r["doc_id"] or 0) for r in docs.collect()) == [0, 1]
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in P.STAGES:
        empty2 = stage(spark, empty, DIR)
        assert empty2.count() == 0
