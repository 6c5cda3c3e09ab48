"""Every bound query against its SQL, on whole tables at sf0.01."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import re
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract

SF_DIR = "/root/testdata/sf0.01"
QUERIES = contract.queries()
ORACLE = contract.oracle_sql()

# Spark type name -> the DuckDB type names that mean the same.
SAME_TYPE = {
    "string": {"VARCHAR"},
    "bigint": {"BIGINT"},
    "int": {"INTEGER"},
    "double": {"DOUBLE"},
    "boolean": {"BOOLEAN"},
    "date": {"DATE"},
    "timestamp_ntz": {"TIMESTAMP"},
}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in contract.TABLES:
        path = Path(SF_DIR) / f"{name}.parquet"
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    yield connection
    connection.close()


def _plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, (dt.datetime, dt.date)):
        return value.isoformat()
    return value


def _canonical(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(
        (tuple(_plain(record[i]) for i in order) for record in records), key=repr
    )


def test_every_query_has_an_oracle():
    without = set(QUERIES) - set(ORACLE)
    assert set(ORACLE) <= set(QUERIES)
    assert all(name == "pipeline" or re.match(r"op\d+_", name) for name in without)


@pytest.mark.parametrize("absent", ["zstandard", "public_tokenizers"])
def test_queries_without_what_only_the_training_data_need(absent):
    """In a process of its own: the other queries are there all the same."""
    code = (
        f"import sys; sys.modules[{absent!r}] = None; import __spark_entry__ as c; "
        "print(len(c.queries()), sum(n.startswith('op') and n[2].isdigit() for n in c.queries()))"
    )
    root = Path(contract.__file__).parent
    done = subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=root, capture_output=True, text=True)
    own = sum(not re.match(r"op\d+_|pipeline", name) for name in QUERIES)
    assert done.stdout.split() == [str(own), "0"], done.stderr


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    actual = [tuple(row) for row in df.collect()]
    relation = duck.sql(ORACLE[name])
    expected = relation.fetchall()

    assert sorted(df.columns) == sorted(relation.columns)
    duck_types = dict(zip(relation.columns, map(str, relation.types)))
    for field in df.schema:
        assert duck_types[field.name] in SAME_TYPE[field.dataType.simpleString()], field
    assert expected, "the oracle must not be empty"
    assert _canonical(df.columns, actual) == _canonical(relation.columns, expected)
