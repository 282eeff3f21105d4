"""The corpus queries that SQL can express give the same rows as DuckDB; hosts, chats and texts with odd cases, too."""

import duckdb
import pytest

from tidewell.llm import queries

DIR = "/root/testdata/sf0.001"


def shown(v):
    return repr(v + 0.0) if isinstance(v, float) else str(v)


def compare(spark, name, path):
    duck = duckdb.connect()
    for t in ("documents", "pages", "labels", "conversations"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/{t}.parquet{'/part-*' if path != DIR else ''}')")
    df = queries.queries()[name](spark, path)
    want = duck.sql(queries.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    got = sorted(tuple(shown(r[c]) for c in cols) for r in df.collect())
    assert got == sorted(tuple(shown(r[i]) for i in at) for r in want.fetchall())
    return len(got)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_whole_tables(spark, name):
    assert compare(spark, name, DIR) > 0


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd"))
    texts = [None, "", "under the MIT license under the mit license", "cc by nc\ncc by", "Licensed under the Apache License, Version 2\nx", "ünder the mit license", "Permission granted free of charge any person obtaining a copy of this software and associated documentation files to hereby"]
    texts += ["# Permission is hereby granted, free of charge, to any\n# person obtaining a copy of this software and\n# associated documentation files", "x\n" * 40 + "Redistribution and use in source and binary\nforms, with or without modification, are\npermitted provided that the following\nconditions are met" + "\ny" * 40]
    spark.createDataFrame(list(enumerate(texts)) + [(2, texts[2]), (9, "UNDER the mit license under the mit license")], "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    urls = ["http://a.example.com/en/7", "http://A.b.c.example.com/en/1?x", "http://x.net/de/8", None, "", "no scheme", "http:///en/3", "s://h", "http://org/es/2", "http://a..b/en/4", "http://q.test/en/1", "http://q.test/en/3", "http://r.test/fr/5"]
    spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)] + [(1, urls[1], ""), (None, urls[0], "")], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    spark.createDataFrame([(1, 0, 1), (3, 1, 0), (5, 0, None), (7, None, 0), (8, 1, 0), (1, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, 0, "user", "</s><~/s>[~SEP]"), (1, 1, "user", None), (1, 2, "assistant", "é🙂[INST]"), (1, 2, "assistant", "</s>"), (2, None, None, "x"), (None, 0, "assistant", "y"), (None, None, "assistant", "")], "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    return path


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_odd_cases(spark, odd, name):
    assert compare(spark, name, odd) > 0
