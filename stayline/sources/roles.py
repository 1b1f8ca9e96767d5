"""The star-schema test tables in the roles of the study's tables.

A customer plays a user, an order a presentation, a line item a slide that is shown and
answered, a supplier a student. ``FIXTURES.md`` has the mapping. Ids stay the numbers the
tables hold, which join and group faster than text; ``ids_as_text`` turns them into text
where a result leaves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayline.sources.schemas import EVENT_DICTIONARY

TEST_TABLES = {
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, "
    "c_mktsegment string",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long",
    "part": "p_partkey long, p_name string, p_type string",
    "supplier": "s_suppkey long",
    "events": "ts timestamp_ntz, user_id long, event_type string",
    "documents": "doc_id long, n_chars long",
    "labels": "doc_id long, quality int",
}
EVENT_CATEGORIES = [
    ("teacher_event", "click"),
    ("teacher_event", "view"),
    ("teacher_event", "purchase"),
    ("student_event", "view"),
    ("student_event", "error"),
    ("before_session", "click"),
    ("during_session", "view"),
    ("after_session", "purchase"),
    ("before_signup", "signup"),
    ("teacher_event", "1-URGENT"),
    ("teacher_event", "2-HIGH"),
    ("teacher_event", "3-MEDIUM"),
    ("student_event", "3-MEDIUM"),
    ("student_event", "4-NOT SPECIFIED"),
    ("before_session", "1-URGENT"),
    ("during_session", "2-HIGH"),
    ("during_session", "4-NOT SPECIFIED"),
    ("after_session", "3-MEDIUM"),
    ("before_signup", "5-LOW"),
]


class Roles:
    """Role views over one directory of test tables."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        """One test table; the declared schema spares the scan a look at the file."""
        if name not in self._tables:
            reader = self.spark.read.schema(TEST_TABLES[name])
            self._tables[name] = reader.parquet(f"{self.root}/{name}.parquet")
        return self._tables[name]

    def user_facts_nested(self) -> DataFrame:
        """Users with profile and account details as structs."""
        seen = (
            self.table("orders")
            .groupBy(F.col("o_custkey").alias("c_custkey"))
            .agg(
                F.min("o_orderdate").alias("first_seen"),
                F.max("o_orderdate").alias("last_presented"),
            )
        )
        return (
            self.table("customer")
            .join(seen, "c_custkey", "left")
            .select(
                F.col("c_custkey").alias("external_id"),
                "first_seen",
                F.struct(F.col("c_mktsegment").alias("role")).alias("profile"),
                "last_presented",
                F.struct(
                    (F.col("c_acctbal") > 4500).alias("currently_premium"),
                    (F.col("c_nationkey") < 5).alias("currently_on_trial"),
                    F.col("c_mktsegment").alias("account_type"),
                ).alias("primary_account_details"),
            )
        )

    def user_facts(self) -> DataFrame:
        return self.user_facts_nested().select(
            "external_id",
            "first_seen",
            F.col("profile.role").alias("profile_role"),
            "last_presented",
            "primary_account_details.*",
        )

    def _lines(self) -> DataFrame:
        """Line items with their order's user and time.

        Both sides are large, so this is left to a shuffle join; one order with very many
        lines is split by the adaptive skew join.
        """
        lines = self.table("lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
        orders = self.table("orders").select(
            F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate"
        )
        return lines.join(orders, "l_orderkey")

    def _parts(self, column: str) -> DataFrame:
        return self.table("part").select(F.col("p_partkey").alias("l_partkey"), column)

    def slide_presented(self, with_type: bool = True) -> DataFrame:
        lines = self._lines()
        if with_type:
            lines = lines.join(self._parts("p_type"), "l_partkey")
        return lines.select(
            F.col("o_custkey").alias("user_id"),
            F.col("l_orderkey").alias("presentation_id"),
            F.col("l_partkey").alias("slide_id"),
            *([F.col("p_type").alias("slide_type")] if with_type else []),
            F.col("o_orderdate").alias("timestamp"),
        )

    def student_responses(self) -> DataFrame:
        return self._lines().join(self._parts("p_name"), "l_partkey").select(
            F.col("o_custkey").alias("teacher"),
            F.col("l_suppkey").alias("student"),
            F.col("l_orderkey").alias("presentation"),
            F.col("l_partkey").alias("slide"),
            F.col("p_name").alias("app"),
            F.col("o_orderdate").alias("timestamp"),
        )

    def student_responded(self) -> DataFrame:
        return self._lines().select(
            F.col("o_custkey").alias("teacher"),
            F.col("l_suppkey").alias("student"),
            F.col("l_orderkey").alias("presentation"),
            F.col("o_orderdate").alias("timestamp"),
        )

    def launch_presentation(self) -> DataFrame:
        status = F.col("o_orderstatus")
        return self.table("orders").select(
            F.col("o_custkey").alias("user_id"),
            F.col("o_orderdate").alias("timestamp"),
            F.when(status == "F", "free")
            .when(status == "O", "premium")
            .when(status == "P", "premiumTrial")
            .alias("account_status"),
        )

    def presenter_button_clicked(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_custkey").alias("user_id"),
            F.col("o_orderpriority").alias("button"),
            F.col("o_orderdate").alias("timestamp"),
        )

    def app_events(self) -> DataFrame:
        return self.table("events").select(
            "user_id",
            F.col("event_type").alias("event"),
            F.col("ts").alias("timestamp"),
        )

    def event_users(self) -> DataFrame:
        """Users of the event table, whose ids are their own; first seen is the first event."""
        return (
            self.table("events")
            .groupBy("user_id")
            .agg(F.min("ts").alias("first_seen"))
            .select(
                F.col("user_id").alias("external_id"), "first_seen", F.lit("teacher").alias("profile_role")
            )
        )

    def customer_events(self) -> DataFrame:
        """Events whose users are the customers, so that they meet the other tables."""
        return self.table("orders").select(
            F.col("o_custkey").alias("user_id"),
            F.col("o_orderpriority").alias("event"),
            F.col("o_orderdate").alias("timestamp"),
        )

    def event_dictionary(self) -> DataFrame:
        """Categories over the event types of both event tables; an event has several."""
        return self.spark.createDataFrame(EVENT_CATEGORIES, EVENT_DICTIONARY)

    def excluded_users(self) -> DataFrame:
        return self.table("supplier").select(F.col("s_suppkey").alias("hashed_coach_id"))
