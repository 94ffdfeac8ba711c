import duckdb
import pytest

from loamlearn.plans import queries as Q

DIR = "/root/testdata/sf0.001"
SAMPLE = ["auc_100", "rmse_mae", "confusion_binary", "precision_recall", "loss_sigmoid", "loss_softmax", "loss_hsoftmax", "loss_multiclass_hinge", "parse_lines", "libsvm_convert", "feature_dict", "feature_stats", "standardize", "missing_mean", "weighted_median", "bins_quantile", "bin_assign", "linear_score", "fm_score", "ffm_score", "gbhsdt_score", "reg_objective", "owlqn_pseudograd", "gbdt_hist", "gbdt_best_split", "gbdt_stump", "tree_leafid", "save_modes"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("lineitem", "part", "embeddings", "documents"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple("" if r[i] is None else f"{float(r[i]):.9g}" if isinstance(r[i], int | float) and not isinstance(r[i], bool) else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, duck, name):
    df = Q.queries()[name](spark, DIR)
    want = duck.sql(Q.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert _rows(df.columns, df.collect()) == _rows(want.columns, want.fetchall())
