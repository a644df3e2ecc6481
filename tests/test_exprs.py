import pytest
from pyspark.sql import functions as F

from lattica.functions import exprs
from lattica.functions.components import connected_components


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize("path, module, group", [("a/b/c.ts", "a/b/", "a/b"), ("c.ts", ".", "root"), ("src/x/y/z.ts", "src/x/y/", "x/y"), ("src/x.ts", "src/", "src"), ("packages/p/q/r/s.ts", "packages/p/q/r/", "p/q")])
def test_modules(spark, path, module, group):
    m = exprs.module_of(F.lit(path))
    assert one(spark, m) == module and one(spark, exprs.cloud_group(m)) == group


def test_rounding_is_of_the_binary_value(spark):
    assert one(spark, exprs.half_up(F.lit(0.285), 2)) == 0.28
    assert one(spark, exprs.half_up(F.lit(2.5))) == 3.0


@pytest.mark.parametrize("name, tokens", [("getHTTPUserById", ["get", "http", "user", "by", "id"]), ("src/user-service_v2.test.ts", ["src", "user", "service", "v2", "test", "ts"]), ("", [])])
def test_tokens(spark, name, tokens):
    assert one(spark, exprs.name_tokens(F.lit(name))) == tokens


def test_paths(spark):
    assert one(spark, exprs.dirname(F.lit("a.ts"))) == "." and one(spark, exprs.dirname(F.lit("a/b/c.ts"))) == "a/b"
    assert one(spark, exprs.normalized_path(F.lit("src\\lib\\a.ts"))) == "lib/a.ts"
    assert one(spark, exprs.is_test_path(F.lit("x/__tests__/a.ts"))) and not one(spark, exprs.is_test_path(F.lit("tests/a.ts")))


def test_components(spark):
    import random

    r = random.Random(3)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    want = {x: find(x) for a, b in edges if a != b for x in (a, b)}
    got = connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert {row["node"]: row["component"] for row in got.collect()} == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
