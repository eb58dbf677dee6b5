import ast
import pathlib

import __spark_entry__

ROOT = pathlib.Path(__spark_entry__.__file__).parent


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_nothing_else_imports_the_corpus_operators():
    for path in (ROOT / "tidewake").rglob("*.py"):
        if "llm" in path.relative_to(ROOT).parts:
            continue
        nodes = list(ast.walk(ast.parse(path.read_text())))
        names = {f"{n.module or ''}.{a.name}" for n in nodes if isinstance(n, ast.ImportFrom) for a in n.names}
        names |= {a.name for n in nodes if isinstance(n, ast.Import) for a in n.names}
        assert not any("llm" in n or "corpus_pipeline" in n for n in names), path


def test_queries_match_their_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    for name in ("ais_valid_filter", "ais_carry_anti", "iou_pairs", "mot_tracking_rows", "stable_ids_5", "voc_ap"):
        db = duckdb.connect()
        db.sql("SET TimeZone = 'UTC'")
        for path in pathlib.Path(sf).glob("*.parquet"):
            db.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
        got = queries[name](spark, sf)
        want = db.sql(sql[name])
        rows = lambda names, all_: sorted(str([r[names.index(c)] for c in sorted(names)]) for r in all_)
        assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(list(want.columns), want.fetchall()), name
