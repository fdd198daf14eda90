import math

import pytest
from pyspark.sql import functions as F

from quern.functions import fmt
from quern.functions import text as X
from quern.functions import vectors as V


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize("text", ["", "a", " a  b ", "a\u00a0b\u2003c", "a\x1cb\x85c", "x" * 5000, "日本 語", "\ufeffa b"])
def test_token_count_is_that_of_split(spark, text):
    assert one(spark, X.token_count, text) == len(text.split())


def test_token_count_of_null(spark):
    assert one(spark, X.token_count, None) is None


@pytest.mark.parametrize("title,want", [("1.2.3.4 Title", (1, 2, "3")), ("7 Head", (7, 0, "")), ("Intro", (0, 0, "")), ("", (0, 0, "")), (None, (0, 0, ""))])
def test_heading_number(spark, title, want):
    assert tuple(one(spark, X.heading_number, title)) == want


@pytest.mark.parametrize("path,rev", [("/d/x_rev3.pdf", "3"), ("/d/x_ver2.html", "2"), ("/d/x_v2.pdf", ""), ("/d/x version 4.1.pdf", "4.1"), ("/d/x_r1.pdf", ""), ("/d/x_Rev1.2_final.pdf", "1.2")])
def test_revision(spark, path, rev):
    assert one(spark, X.revision, path) == rev


def test_status_takes_the_first_word_in_order(spark):
    assert one(spark, X.status, "/d/draft_released.pdf") == "released"
    assert one(spark, X.status, "/d/plain.pdf") == ""


def test_feature_tags(spark):
    df = spark.createDataFrame([("The ECC unit", "DMA and ECC IN A CPU1 ÉCC"), (None, None)], "t string, c string")
    assert [r[0] for r in df.select(X.feature_tags(F.col("t"), F.col("c"))).collect()] == [["CPU1", "DMA", "ECC"], []]


def test_like_wildcards_case_and_backslash(spark):
    df = spark.createDataFrame([("ecc_enable",), ("ECCxINIT",), ("a\\b",), ("É",), (None,)], "name string")
    names = lambda p: {r[0] for r in df.where(X.ascii_like(F.col("name"), p)).collect()}
    assert names("ecc") == {"ecc_enable", "ECCxINIT"}
    assert names("ecc_i") == {"ECCxINIT"}
    assert names("\\") == {"a\\b"}
    assert names("é") == set()


def test_subsequence(spark):
    df = spark.createDataFrame([("GPIO_Init",), ("gi",), ("ig",)], "n string")
    assert {r[0] for r in df.where(X.subsequence(F.col("n"), "gi")).collect()} == {"GPIO_Init", "gi"}
    assert df.where(X.subsequence(F.col("n"), "")).count() == 3


@pytest.mark.parametrize("n,want", [(0, "0 B"), (512, "512 B"), (1536, "1.5 KB"), (5 << 20, "5.0 MB"), (1 << 50, "1024.0 TB")])
def test_human_size(spark, n, want):
    assert one(spark, fmt.human_size, n, "bigint") == want


@pytest.mark.parametrize("s,want", [(0.0, "0s"), (59.9, "59s"), (60.0, "1m 0s"), (3600.0, "1h 0m"), (7384.0, "2h 3m")])
def test_fmt_eta(spark, s, want):
    assert one(spark, fmt.fmt_eta, s, "double") == want


@pytest.mark.parametrize("width,want", [(40, "a/b/c/d/file.c"), (13, "a/…/d/file.c"), (10, "…/d/file.c"), (8, "…/file.c"), (4, "file")])
def test_shorten(width, want):
    assert fmt.shorten("/root/a/b/c/d/file.c", "/root", width) == want


def test_shorten_keeps_as_much_of_the_head_as_fits():
    assert fmt.shorten("/r/a/b/c/d/e/f.c", "/r", 11) == "a/b/…/e/f.c"


def test_repository_addresses(spark):
    assert one(spark, X.repo_path, "https://github.com/a/b.git") == "a/b"
    assert one(spark, X.repo_path, "a/b") == "a/b"
    assert one(spark, X.dataset_id, "https://huggingface.co/datasets/a/b/") == "a/b"


def test_vectors(spark):
    v = [0.1 * i for i in range(384)]
    assert len(V.to_blob(v)) == 1536
    assert max(abs(a - b) for a, b in zip(v, V.from_blob(V.to_blob(v)))) < 1e-5
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [0.0, 0.0]), (4, [math.nan, 1.0]), (5, [1.0]), (6, None)], "id int, e array<double>")
    got = {r[0]: r[1] for r in df.select("id", V.cosine_to(F.col("e"), [3.0, 0.0])).collect()}
    assert got == {1: 1.0, 2: 0.0, 3: None, 4: None, 5: None, 6: None}
    unit = {r[0]: r[1] for r in df.select("id", V.l2_normalize(F.col("e"))).collect()}
    assert unit[2] == [0.0, 1.0] and unit[3] == [0.0, 0.0] and unit[6] is None


@pytest.mark.parametrize("text,want", [("2025-01-02T03:04:05Z", 1735787045), ("2025-01-02T04:04:05+01:00", 1735787045), ("2025-01-02T03:04:05", 1735787045), ("yesterday", None), ("", None), (None, None)])
def test_times_with_a_z(spark, text, want):
    assert one(spark, lambda c: F.unix_timestamp(fmt.parse_time(c)), text) == want


def test_devices():
    from quern.operators import embedding

    assert embedding.resolve_device("cuda") == "cuda" and embedding.resolve_device() in ("cpu", "cuda") and (embedding.batch_size("cuda"), embedding.batch_size("cpu")) == (1024, 256)
    with pytest.raises(ValueError):
        embedding.resolve_device("tpu")
    assert embedding.find_model("/nowhere", "/none") is None


def test_vectors_with_gaps(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0]), (5, [nan, 1.0]), (6, [None, 1.0]), (7, [-4.0, 3.0])], "i int, v array<float>")
    got = {r.i: r.c for r in df.select("i", V.cosine_to(F.col("v"), [6.0, 8.0]).alias("c")).collect()}
    assert got[1] == pytest.approx(1.0) and got[7] == pytest.approx(0.0) and all(got[i] is None for i in (2, 3, 4, 5, 6))
    assert df.where("i > 1 and i < 7").select(V.cosine_to(F.col("v"), [1.0, 0.0]).alias("c")).where("c is not null").count() == 0
