import tempfile
from pathlib import Path

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from ledgerlens.sources import loader

few = settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def write(folder: Path, name: str, text: str):
    (folder / name).write_text(text, encoding="utf-8")


def test_csv_reader_aliases_quotes_and_bad_values(spark):
    folder = Path(tempfile.mkdtemp(prefix="ledgerlens-test-"))
    write(
        folder,
        "crypto_transfer_train.csv",
        "created_at,user_id,kind,sub_kind,ori_samount,twd_srate,relation_user_id,from_wallet_hash,to_wallet_hash,protocol,currency,source_ip\n"
        '2001-01-01 00:00:00,7,0,0,100000000,3000000000,,"a ""quoted"", wallet",,1,btc,nan\n'
        "\n"
        "garbage,8.0,1,1,x,3000000000,9.0,,,1,eth,abc\n",
    )
    rows = {r["user_id"]: r for r in loader.read_table(spark, str(folder), "crypto_transfer").collect()}
    assert rows[7]["from_wallet"] == 'a "quoted", wallet' and rows[7]["source_ip_hash"] is None
    assert rows[8]["created_at"] is None and rows[8]["ori_samount"] is None and rows[8]["relation_user_id"] == 9
    with pytest.raises(loader.MissingTable):
        loader.read_table(spark, str(folder), "usdt_swap")
    assert loader.load_predict(spark, str(folder)) is None


def test_missing_column_is_an_error(spark):
    df = spark.createDataFrame([(1,)], "user_id long")
    with pytest.raises(loader.MissingColumns):
        loader.coerce_types(df, "user_info")


def test_no_positives_is_an_error(spark):
    with pytest.raises(ValueError):
        loader.require_positives(spark.createDataFrame([(1, 0)], "user_id long, status int"))


@few
@given(st.lists(st.integers(0, 20), max_size=30), st.sets(st.integers(0, 20)), st.sets(st.integers(21, 30)))
def test_split_is_a_partition_of_labelled_rows(spark, ids, train, predict):
    rows = spark.createDataFrame([(i,) for i in ids], "user_id long")
    a = spark.createDataFrame([(i,) for i in train], "user_id long")
    b = spark.createDataFrame([(i,) for i in predict], "user_id long")
    out = loader.split_by_label(rows, a, b).collect()
    assert sorted(r["user_id"] for r in out) == sorted(i for i in ids if i in train | predict)


def test_sinks_round_trip(spark):
    base = tempfile.mkdtemp(prefix="ledgerlens-test-")
    df = spark.createDataFrame([(1, "x", "black"), (2, 'y,"z', "FP")], "user_id long, note string, case_group string")
    loader.write_outputs({"cases": df}, base, "parquet", {"cases": ["case_group"]})
    assert spark.read.parquet(f"{base}/cases").where("case_group = 'FP'").first()["note"] == 'y,"z'
    for fmt in ("csv", "json"):
        loader.write_outputs({f"c_{fmt}": df}, base, fmt)
    assert spark.read.json(f"{base}/c_json").count() == 2
    loader.write_outputs({"report": df.select("note")}, base, "text")
    assert spark.read.text(f"{base}/report").count() == 2


def test_first_part_wins_per_user(spark):
    a = spark.createDataFrame([(1, 0.1)], "user_id long, risk_score double")
    b = spark.createDataFrame([(1, 0.9), (2, 0.8)], "user_id long, risk_score double")
    got = {r["user_id"]: r["risk_score"] for r in loader.first_per_user([a, b]).collect()}
    assert got == {1: 0.1, 2: 0.8}
