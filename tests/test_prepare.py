"""The preparation plan on rows of its own: categories that only the new rows have."""

import duckdb
import pytest

import __spark_entry__ as E
from compare import same_rows
from tabrisk.plans.prepare import PrepSpec, prepare
from tabrisk.sources.fixtures import subjects


@pytest.fixture(scope="module")
def new_categories(spark, tmp_path_factory):
    """Customers in debt are the new rows; only they have segment NEW, priority 9-NEW and no orders."""
    path = str(tmp_path_factory.mktemp("new-categories"))
    customers = [(i, ["A", "B", "C"][i % 3] if i != 12 else "NEW", -5.0 if i % 6 == 0 else 10.0 + i) for i in range(90)]
    orders = [(100 * i + j, i, float((i * 37 + j * 101) % 977 + 50), "9-NEW" if i == 18 else f"{(i + j) % 3}-OLD")
              for i in range(90) for j in range(0 if i == 24 else 1 + i % 13)]
    spark.createDataFrame(customers, "c_custkey bigint, c_mktsegment string, c_acctbal double").write.parquet(f"{path}/customer.parquet")
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderpriority string").write.parquet(
        f"{path}/orders.parquet")
    return path


@pytest.mark.parametrize("name", ["apply_and_append", "saved_preparation", "new_row_view"])
def test_new_categories_have_no_code(spark, new_categories, name):
    con = duckdb.connect()
    for t in ("customer", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{new_categories}/{t}.parquet/*.parquet')")
    got = E.queries()[name](spark, new_categories).toPandas()
    want = con.execute(E.oracle_sql()[name]).df()
    # the imputer also fills the mean price of the customer without orders, the SQL only the highest one
    ok, why = same_rows(got[got.key != 24], want[want.key != 24])
    assert ok, why
    assert len(got) == len(want)
    if "top_priority" in got:
        codes = got.set_index("key")[["segment", "top_priority"]].isna()
        assert codes.segment[codes.segment].index.tolist() == [12]
        assert sorted(codes.top_priority[codes.top_priority].index) == [18, 24]


def test_unknown_category_is_an_error_unless_asked(spark):
    """Also where the imputer reads the category: its codes are never averaged."""
    df = spark.createDataFrame([(i, "abc"[i % 3], None if i == 4 else 10.0 * (i % 3) + i / 100, i % 2) for i in range(30)],
                               "key bigint, kind string, price double, label int")
    spec = PrepSpec(key="key", label="label", categorical=["kind"], scaled=["price"], impute_target="price",
                    feature_order=["kind", "price"], corr_exclude=["key", "label"])
    fitted, _, _ = prepare(df, spec)
    assert fitted.impute_cols == ["kind", "price"]
    new = spark.createDataFrame([(100, "z", None, 1), (101, "b", None, 1), (102, "z", 7.0, 1)], df.schema)
    with pytest.raises(Exception, match="unknown category"):
        fitted.display(new).collect()
    rows = {r.key: r for r in fitted.display(new, on_unknown="null").collect()}
    assert [rows[k].kind for k in (100, 101, 102)] == [None, 1.0, None]
    mean = df.toPandas().price.mean()
    assert rows[100].price == pytest.approx(mean) and 10 < rows[101].price < 11 and rows[102].price == 7.0


def test_subjects_of_the_fixture(spark, new_categories):
    """What the queries above rest on."""
    s = subjects(spark, new_categories).toPandas().set_index("key")
    assert s.top_priority.isna().sum() == 1 and s.n_orders[24] == 0 and s.label[24] == 1
