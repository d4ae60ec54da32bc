"""Every registered query with SQL against DuckDB over the same tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from dossier.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: round(v, 9) if isinstance(v, float) and not math.isnan(v) else str(v) if v is not None else None
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in data), key=str)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    got = rows(df.columns, df.collect())
    cur = duck.execute(registry.ORACLE_SQL[name])
    assert got == rows([c[0] for c in cur.description], cur.fetchall())


def test_pages_as_blocks(spark):
    """What SQL can't say of the walk over real pages: every page has its title, headings and links, numbered without gaps."""
    rows = registry.QUERIES["d1_html_blocks"](spark, SF).collect()
    pages = {r["page_id"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert {r["page_id"] for r in rows if r["block_key"] == "title_0001"} == pages and all(r["text_content"] for r in rows)
    numbers = {}
    for r in rows:
        prefix, n = r["block_key"].rsplit("_", 1)
        numbers.setdefault((r["page_id"], prefix), []).append(int(n))
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in numbers.values())
    links = {(r["page_id"], r["href"]) for r in rows if r["block_type"] == "link"}
    assert len(links) > len(pages)


def test_entry(spark):
    assert registry.flagship(spark, SF).count() > 0
