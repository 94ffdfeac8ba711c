import pytest
from pyspark.sql import functions as F

from loamlearn.functions.hashing import bucket_and_sign, hash_features, murmur3_128
from loamlearn.operators import features as feat
from loamlearn.sources import lines as src
from loamlearn.sources.config import get, read_config


def test_parse(spark):
    rows = ["1###12.45###height:1.6,weight:56.0", "10###0.9###a:1,a:2,b:NaN###0.4", "1######1:1.2,9:3.2", "1###0.1,0.9###x:1", "1###0###a:x", "w###0###a:1", "1###0###a:Infinity", "1###0###", "2###1"]
    got = src.parse(spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, value string")).orderBy("i").collect()
    assert [r["error"] for r in got] == [None, None, None, None, "feature", "weight", "feature", None, None]
    assert got[0]["features"] == {"height": 1.6, "weight": 56.0}
    assert got[1]["features"]["a"] == 2 and got[1]["features"]["b"] != got[1]["features"]["b"] and got[1]["init_pred"] == [0.4]
    assert got[2]["label"] is None and got[3]["label"] == [0.1, 0.9] and got[7]["features"] == {}


def test_error_budget(spark):
    parsed = src.parse(spark.createDataFrame([("1###0###a:x",), ("1###0###a:1",)], "value string"))
    assert src.checked(parsed, 1).count() == 1
    with pytest.raises(ValueError):
        src.checked(parsed, 0)
    with pytest.raises(ValueError):
        src.checked(src.parse(spark.createDataFrame([("x###0###a:1",)], "value string")), 9)


def test_libsvm_and_hook(spark):
    df = spark.createDataFrame([("b 1:2 3:4.5",), ("1:1 2:2",), ("z 1:1",)], "value string")
    got = [r[0] for r in src.libsvm_to_lines(df, "binary_classification@a,b").collect()]
    assert got == ["1###1###1:2,3:4.5", "1######1:1,2:2", None]
    assert src.libsvm_to_lines(df.limit(1).replace("b 1:2 3:4.5", "2.5 1:1"), "regression").first()[0] == "1###2.5###1:1"
    hooked = src.apply_hook(df, lambda b: [b.decode(), b.decode().upper()] if b.startswith(b"b") else [])
    assert sorted(r[0] for r in hooked.collect()) == ["B 1:2 3:4.5", "b 1:2 3:4.5"]


def test_config():
    c = read_config('type : "gbdt"\n# comment\ndata { train { data_path : "/a/b", x = [1, 2.5,] } // end\n}\noptimization.max_depth = 7\nlist : [ {cols: "default", type: no_sample}, ]\nflag: true\nlost: ???', {"data.train.data_path": "/c"})
    assert c["type"] == "gbdt" and get(c, "data.train.data_path") == "/c" and get(c, "data.train.x") == [1, 2.5]
    assert get(c, "optimization.max_depth") == 7 and c["list"] == [{"cols": "default", "type": "no_sample"}] and c["flag"] is True
    assert get(c, "lost", 3) == 3 and get(c, "none.such", 4) == 4


def test_murmur_vectors():
    # published values of the x64 128-bit variant
    assert murmur3_128(b"") == (0, 0)
    assert murmur3_128(b"hello")[0] == 0xCBD8A7B341BD9B02
    assert murmur3_128(b"hello, world")[0] == 0x342FAC623A5EBC8E
    assert murmur3_128(b"The quick brown fox jumps over the lazy dog")[0] == 0xE34BBC7BBC071B6C


def test_hash_features(spark):
    ex = spark.createDataFrame([(1, f"f{i}", 1.0) for i in range(50)], "sample_id long, feature string, value double")
    got = {r["feature"]: r["value"] for r in hash_features(ex, 8, 3, "h").collect()}
    want: dict = {}
    for i in range(50):
        b, s = bucket_and_sign(f"f{i}", 3, 8)
        want[f"h{b}"] = want.get(f"h{b}", 0) + s
    assert got == want


def test_dictionary_and_labels(spark):
    names = spark.createDataFrame([(x,) for x in ("b", "a", "é", "Z", "a")], "feature string")
    got = {r["feature"]: r["idx"] for r in feat.dictionary(names).collect()}
    assert got == {feat.BIAS: 0, "Z": 1, "a": 2, "b": 3, "é": 4}
    df = spark.createDataFrame([([2.0],), ([0.2, 0.3, 0.5],), ([0.5, 0.6, 0.0],)], "label array<double>").select(feat.one_hot(F.col("label"), 3).alias("y"))
    assert df.collect()[0]["y"] == [0, 0, 1]
    assert [r[0] for r in df.select(feat.label_error(F.col("y"), 3)).collect()] == [None, None, "sum"]
