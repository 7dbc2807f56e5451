"""Registered queries against their SQL on small tables that hold what once went wrong."""

from pathlib import Path

import duckdb
import pytest

from codestrata.plans import catalogue
from tests.oracle import connect, difference

SF = "/root/testdata/sf0.001"


@pytest.fixture
def tables(tmp_path):
    """A folder of the smallest tables, some replaced by the rows of a SELECT."""

    def made(**selects: str) -> str:
        for old in Path(SF).glob("*.parquet"):
            if old.stem in selects:
                duckdb.sql(f"COPY ({selects[old.stem]}) TO '{tmp_path / old.name}' (FORMAT parquet)")
            else:
                (tmp_path / old.name).symlink_to(old)
        return str(tmp_path)

    return made


def differs(spark, sf_dir: str, name: str) -> str:
    return difference(catalogue.queries()[name](spark, sf_dir), connect(sf_dir), catalogue.oracle_sql()[name])


def _events(*rows: tuple[int, str]) -> str:
    return " UNION ALL ".join(f"SELECT {i}::BIGINT AS event_id, TIMESTAMP '{ts}' AS ts, {i}::BIGINT AS user_id, 'view' AS event_type, 1.0::DOUBLE AS value, '{{\"k\": 7}}' AS props" for i, ts in rows)


def test_drained_rows_stay_out_of_the_driver(spark, tables):
    found = catalogue.queries()["l02_once"](spark, tables())
    assert "Scan parquet" in found._jdf.queryExecution().executedPlan().toString()  # tables of the memory sink lie in the driver
    assert differs(spark, SF, "l02_once") == "" and differs(spark, SF, "l04_activity_stream") == ""
def test_half_seconds_of_sessions(spark, tables):
    events = _events((0, "2024-01-01 00:00:00.5"), (1, "2024-01-02 00:00:01.5"), (2, "2024-01-03 00:00:02.499999"))
    assert differs(spark, tables(events=events), "l01_debounce_sessions") == ""


def test_days_are_whole_to_the_microsecond(spark, tables):
    events = _events((0, "2024-01-02 00:00:00.2"), (1, "2024-01-01 00:00:00.7"))
    assert differs(spark, tables(events=events), "s05_authorship") == ""


def test_review_of_more_than_fifty(spark, tables):
    many = f"SELECT * REPLACE (s_suppkey + 1000 * i AS s_suppkey, 6000::DOUBLE AS s_acctbal) FROM '{SF}/supplier.parquet', range(60) g(i)"
    assert differs(spark, tables(supplier=many), "v08_pr_review") == ""
