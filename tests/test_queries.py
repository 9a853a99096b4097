"""The registered queries: beside their SQL, and without the optional subpackage."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from wardline.plans import catalogue

ROOT = Path(__file__).resolve().parent.parent
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = (
    "override_hits", "param_override_hits", "dangerous_name_nearby", "url_rating", "address_aimed", "character_counts", "blocked_documents", "unit_escalation_conversation",
    "toolkit_composites", "payload_violations", "nested_array_paths", "magnitude_guess", "decide_glob", "ledger_seal", "ledger_verify_truncated",
)


def same(v):
    return f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", SOME)
def test_query_and_sql_agree(spark, small, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    want = con.sql(catalogue.ORACLE_SQL[name])
    columns = sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    df = catalogue.QUERIES[name](spark, small)
    assert sorted(df.columns) == columns
    got = sorted(tuple(same(r[c]) for c in columns) for r in df.collect())
    assert got == sorted(tuple(same(r[i]) for i in at) for r in want.fetchall())


def test_amounts_of_zero_and_below_are_named_like_others(spark, tmp_path, monkeypatch):
    duckdb.sql(f"COPY (SELECT i AS event_id, v::DOUBLE AS value FROM range(8) AS r(i), (VALUES (0), (-3.5), (12.25)) AS x(v)) TO '{tmp_path}/events.parquet'")
    monkeypatch.setattr(sys.modules[__name__], "TABLES", ["events"])
    test_query_and_sql_agree(spark, tmp_path, "magnitude_guess")


def test_entry_and_names(spark):
    assert entry.entry(spark).columns == ["doc_id", "detector", "severity", "rule", "excerpt"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_works_without_the_subpackage(tmp_path):
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith(('wardline.llm', 'corpus_pipeline')): raise ImportError(name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "q = e.queries()\n"
        "assert len(q) > 50 and 'pipeline' not in q and not any(k.startswith('op1') for k in q) and set(e.oracle_sql()) <= set(q)\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
