from datetime import date

import pytest
from pyspark.sql import functions as F

from stayline import session
from stayline.functions import periods
from stayline.sources import schemas, tables
from tests.conftest import rows, ts


def test_scan_reads_only_the_columns(spark, tmp_path):
    schema = schemas.LAUNCH_PRESENTATION
    data = [("a", ts("2018-08-05T10:00"), "free"), ("b", ts("2018-09-05T10:00"), "premium")]
    spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/launch_presentation")
    df = tables.scan(spark, str(tmp_path), "launch_presentation", ["user_id", "timestamp"])
    august = periods.between_days(df, "timestamp", date(2018, 8, 1), date(2018, 8, 31))
    assert rows(august, "user_id") == [("a",)]
    plan = august.select("user_id")._jdf.queryExecution().toString()
    assert "ReadSchema: struct<user_id:string,timestamp:timestamp_ntz>" in plan
    assert "PushedFilters: [IsNotNull(timestamp), GreaterThanOrEqual(timestamp" in plan


def test_query_binds_values_and_leaves_no_view(spark, request):
    make = request.getfixturevalue("tables").launches
    launches = make(("a", "2018-08-05T10:00", "free"), ("b", "2018-09-05T10:00", "x' OR 1"))
    got = tables.query(
        spark,
        "SELECT user_id FROM {l} WHERE account_status = :status",
        {"l": launches},
        status="x' OR 1",
    )
    assert rows(got) == [("b",)]
    assert not [t for t in spark.catalog.listTables() if t.isTemporary]


def test_sample_rows_is_ordered(spark):
    assert rows(tables.sample_rows(spark.range(10, 0, -1), 2, ["id"])) == [(1,), (2,)]
    assert tables.sample_rows(spark.range(10), 4).count() == 4


def test_nested_and_flat_users_are_the_same(spark):
    nested = spark.createDataFrame(
        [("a", ts("2018-08-05T10:00"), None, ("teacher",), (True, None, "school"))],
        schemas.USER_FACTS_NESTED,
    )
    flat = tables.flatten_user_facts(nested)
    assert set(flat.columns) == set(schemas.USER_FACTS.names)
    assert flat.select("profile_role", "currently_premium", "account_type").first()[:] == (
        "teacher",
        True,
        "school",
    )
    assert tables.flatten_user_facts(flat).columns == flat.columns


@pytest.mark.parametrize("format", ["csv", "parquet"])
def test_result_and_list_files(spark, tmp_path, format):
    ids = spark.createDataFrame([("001",), ("b",), ("b",), (None,)], "hashed_coach_id string")
    path = f"{tmp_path}/ids"
    tables.write_result(ids, path, format)
    tables.write_result(ids, path, format)
    assert rows(tables.excluded_ids(spark, path, format)) == [("001",), ("b",)]
    words = spark.createDataFrame([("c", "e"), ("c", "e")], "category string, event string")
    tables.write_result(words, path, format)
    assert rows(tables.event_dictionary(spark, path, format)) == [("c", "e")]


def test_users_in_camel_case_and_missing_columns(spark, tmp_path):
    camel = spark.createDataFrame(
        [("a", ts("2018-08-05T10:00"), None, ("teacher",), (True, None, "school"))],
        "externalId string, firstSeen timestamp, lastPresented timestamp, profile struct<role:string>, "
        "primaryAccountDetails struct<currentlyPremium:boolean,currentlyOnTrial:boolean,accountType:string>",
    )
    flat = tables.flatten_user_facts(camel)
    assert set(flat.columns) == set(schemas.USER_FACTS.names)
    flat.write.parquet(f"{tmp_path}/user_facts")
    assert tables.scan(spark, str(tmp_path), "user_facts").count() == 1
    flat.drop("account_type").write.parquet(f"{tmp_path}/less/user_facts")
    with pytest.raises(ValueError, match="account_type"):
        tables.scan(spark, f"{tmp_path}/less", "user_facts")


def test_scratch_tables_go_at_the_end(spark):
    with session.scratch_tables(spark):
        df = session.checkpointed(spark.range(3))
        (folder,) = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
        assert df.count() == 3
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def test_kept_tables_go_with_the_block_around(spark):
    def there(df):
        path = spark._jvm.org.apache.hadoop.fs.Path(df.inputFiles()[0].rsplit("/", 1)[0])
        return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)

    with session.scratch_tables(spark):
        with session.scratch_tables(spark) as keep:
            passing = session.checkpointed(spark.range(3))
            kept = keep(passing.where("id > 0"))
        files = passing.inputFiles(), kept.inputFiles()
        assert files and not there(passing) and there(kept) and kept.count() == 2
    assert not there(kept)


def test_checkpointed_cuts_the_plan(spark):
    df = session.checkpointed(spark.range(5).withColumn("x", F.col("id") * 2))
    assert "Range" not in df._jdf.queryExecution().analyzed().toString()
    assert df.agg(F.sum("x")).first()[0] == 20
    assert spark.sparkContext.getCheckpointDir()
