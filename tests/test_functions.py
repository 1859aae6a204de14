from pyspark.sql import functions as F

from loomgraph.functions import exprs as X
from loomgraph.operators import windows


def one(spark, column):
    return spark.range(1).select(column.alias("x")).collect()[0]["x"]


def test_slugs_and_domains(spark):
    assert one(spark, X.slugify(F.lit("  éé--Weird__ chars!! "))) == "weird-chars"
    assert one(spark, X.slug_words(F.lit("One two three four five six"))) == "one-two-three-four-five"
    assert one(spark, X.segments(F.lit("App\\\\Core::x/ y "))) == ["App", "Core", "x", "y"]
    assert one(spark, X.domain_of_namespace(F.lit("App\\Core\\Kit"), 2)) == "core-kit"
    assert one(spark, X.domain_of_namespace(F.lit("App"), 1)) == "app"
    assert one(spark, X.domain_of_path(F.lit("./src/x/y.php"))) == "src"
    assert one(spark, X.domain_of_path(F.lit("y.php"))) == "root"
    assert one(spark, X.domain(F.lit(None).cast("string"), F.lit("lib/x.go"))) == "lib"


def test_line_ranges(spark):
    for text, good in (("12-87", True), ("12-87\n", False), ("0-3", False), ("9-3", False), ("", False), ("x", False), ("99999999999999999999-3", False)):
        assert (one(spark, X.range_start(F.lit(text))) is not None) is good
    assert one(spark, X.line_count(F.lit("a\nb\n"))) == 2 and one(spark, X.line_count(F.lit(""))) == 0 and one(spark, X.line_count(F.lit("\n"))) == 1
    assert one(spark, X.numbered(F.lit("a\nb"), F.lit(7))) == "7\ta\n8\tb"


def test_two_decimals_rounds_the_binary_value(spark):
    values = [0.125, 0.145, 1.005, 0.165, 0.29, 0.0, 1.0, 0.995, 0.005, 0.015, -0.125, -0.001, 2.675, 1234.565]
    df = spark.createDataFrame([(v,) for v in values], "x double").select("x", X.two_decimals(F.col("x")).alias("t"))
    for r in df.collect():
        assert r.t == ("%.2f" % r.x if r.x != -0.001 else "0.00"), r


def test_binary_excludes_and_displays(spark):
    assert one(spark, X.looks_binary(F.lit("a\0b"))) and not one(spark, X.looks_binary(F.lit("été\n")))
    assert one(spark, X.excluded(F.lit("a/vendor/b.js"), ["vendor"])) and one(spark, X.excluded(F.lit("a/.x/b"), [])) and one(spark, X.excluded(F.lit("a/b.min.js"), ["*.min.js", "[bad"]))
    assert not one(spark, X.excluded(F.lit("a/vendors/b.js"), ["vendor"]))
    assert one(spark, X.token_display(F.lit(1_100_000))) == "1.1M" and one(spark, X.token_display(F.lit(189_400))) == "189k" and one(spark, X.token_display(F.lit(950))) == "950"
    assert one(spark, X.percent(F.lit(2), F.lit(3))) == "66%" and one(spark, X.percent(F.lit(2), F.lit(0))) == "n/a"
    assert one(spark, X.strip_fences(F.lit(" ```json\n{}\n``` "))) == "{}" and one(spark, X.strip_fences(F.lit("{}"))) == "{}" and one(spark, X.strip_fences(F.lit("```"))) == ""


def test_bodies(spark):
    body = "**Exigence (EARS)** : The system shall x.\n\n**Critères d'acceptation** :\n1. a\n2. b\n\nrest 3"
    assert one(spark, X.requirement_of(F.lit(body))) == "The system shall x."
    assert one(spark, X.criteria_of(F.lit(body))) == ["1. a", "2. b"]
    assert one(spark, X.requirement_of(F.lit("first\nsecond"))) == "first"
    assert one(spark, X.import_target(F.lit(" 'a/b' as c;"))) == "a/b"


def test_windows_equal_the_loop(spark):
    df = spark.range(0, 800).select("id", windows.line_windows(F.col("id").cast("int")).alias("w"))
    for n, w in df.collect():
        want, start = [], 1
        while start <= n:
            end = min(start + 249, n)
            want.append((start, end))
            if end == n:
                break
            start = end - 19
        assert [tuple(x) for x in w] == want


def test_numbering_equals_a_window(spark):
    from pyspark.sql import Window

    rows = [("hot", k * 37 % 1009) for k in range(1000)] + [(None, k) for k in range(50)] + [(f"g{k % 7}", k) for k in range(90)]
    df = spark.createDataFrame(rows, "g string, k int").repartition(6)
    want = df.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy("k")).cast("bigint"))
    assert sorted(map(str, windows.numbered(df, ["g"], ["k"], "n").collect())) == sorted(map(str, want.collect()))
    assert windows.numbered(df.limit(0), ["g"], ["k"], "n").count() == 0
