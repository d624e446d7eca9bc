"""Forms with more senses than there are letters keep all their senses, in batches and streams."""

import duckdb
import pytest

from glosswork.plans import registry

N = 140


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A noun with 140 senses and an adjective with 70, to which 70 satellites come; documents whose words speak for ranks up to the last."""
    at = str(tmp_path_factory.mktemp("many"))
    name = lambda i: "w" + "".join(chr(97 + int(c)) for c in f"{i:04d}")
    items = [(i * 5, f"bank {name(i)} other{'s' * (i % 3)}") for i in range(N)] + [(i * 5 + 2 + k, f"flat {name(500 + 2 * i + k)}") for i in range(N // 2) for k in (0, 1)]
    texts = [f"the bank {name(i)}" for i in range(0, N, 3)] + [f"banks {name(i)} flat {name(500 + i)}" for i in (0, 1, 100, 126, 127, 128, 139)] + ["bank", "flat", "no word of it"]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{at}/documents.parquet")
    return at


def by_sql(at, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"create view {t} as select * from '{at}/{t}.parquet/*.parquet'")
    rows = c.execute(registry.oracle_sql()[name])
    return rows.fetchall(), [x[0] for x in rows.description]


def same(spark, at, name):
    want, columns = by_sql(at, name)
    got = [tuple(r) for r in registry.queries()[name](spark, at).select(*columns).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    return [dict(zip(columns, r, strict=True)) for r in got]


def test_predictions(spark, tables):
    rows = same(spark, tables, "predictions")
    chosen = {(r["form"], r["synset_id"]) for r in rows}
    assert ("bank", f"syn-{5 * 129:08d}-n") in chosen and any(f == "flat" and s.endswith("-s") for f, s in chosen)


def test_stream(spark, tables):
    assert len({r["synset_id"] for r in same(spark, tables, "resolve_stream") if r["form"] == "bank"}) > 40


def test_lemmatised(spark, tables):
    rows = same(spark, tables, "disambiguate_lemmatised")
    assert any(r["word"] == "banks" and r["synset_id"] == f"syn-{5 * 139:08d}-n" for r in rows)
