import datetime
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quern.operators import code, delta, documents, increments, references, reports, retrieval, scope, symbols, trees

T = datetime.datetime(2025, 3, 1)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_fanout_cut_comes_before_the_dedup(spark):
    df = spark.createDataFrame([("v1", i, [1.0, i / 10], "f", 1) for i in range(4)] + [("v2", 9, [1.0, 0.0], "f", 1), ("v2", 10, [0.0, 1.0], "g", 1)], "version string, chunk_id long, embedding array<double>, file_path string, line_start int")
    hits = retrieval.fanout(df, [1.0, 0.0], 2).withColumn("score", F.round("cosine", 4))
    assert rows(hits.select("version", "chunk_id", "rank")) == [("v1", 0, 1), ("v1", 1, 2), ("v2", 10, 2), ("v2", 9, 1)]
    out = retrieval.merge(hits, ["file_path", "line_start"], [F.asc("version"), F.asc("chunk_id")], 3)
    assert [tuple(r) for r in out.select("version", "chunk_id").collect()] == [("v1", 0), ("v2", 10)]


def test_knn_of_an_empty_table_and_of_more_than_there_is(spark):
    df = spark.createDataFrame([(1, [1.0]), (2, None)], "chunk_id long, embedding array<double>")
    assert retrieval.knn(df, [1.0], 9).count() == 1
    assert retrieval.knn(df.limit(0), [1.0], 9).count() == 0


def test_listing_prefers_the_first_version(spark):
    s = spark.createDataFrame([("v1", 1, "foo"), ("v2", 2, "foo"), ("v2", 3, "bar"), ("v3", 4, "baz")], "version string, id long, name string")
    sc = spark.createDataFrame([(0, "v2"), (1, "v1")], "pos int, version string")
    assert [(r.name, r.id) for r in symbols.listing(s, sc, "", 9).collect()] == [("bar", 3), ("foo", 2)]


def test_file_delta_actions(spark):
    m = spark.createDataFrame([("v", "r", p, t, h) for p, t, h in [("same", 1.0, "a"), ("gone", 1.0, "a"), ("touched", 1.0, "a"), ("new content", 1.0, "a"), ("hidden change", 1.0, "a"), ("null time", None, "a")]], "version string, input_root string, rel_path string, mtime double, sha256 string")
    w = spark.createDataFrame([("v", "r", p, t, h) for p, t, h in [("same", 1.0, "A"), ("added", 1.0, "a"), ("touched", 2.0, "a"), ("new content", 2.0, "b"), ("hidden change", 1.0, "b"), ("null time", None, "b"), ("same", 1.0, "A")]], m.schema)
    got = {r.rel_path: r.action for r in delta.file_delta(m, w).collect()}
    assert got == {"same": "unchanged", "gone": "delete", "added": "add", "touched": "touch", "new content": "replace", "hidden change": "unchanged", "null time": "replace"}
    assert {r.rel_path: r.action for r in delta.file_delta(m, w, always_hash=True).collect()}["hidden change"] == "replace"
    assert delta.file_delta(m.limit(0), w.limit(0)).count() == 0


def test_upper_median_with_ties_and_nulls(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 2.0), ("a", 9.0), ("b", 5.0), ("b", None), ("c", None)], "k string, v double")
    assert rows(reports.upper_median(df, ["k"], "v")) == [("a", 2.0), ("b", 5.0)]


def test_trees(spark):
    p = spark.createDataFrame([("/a/b/x.c",), ("/a/b/y.c",), ("/a/c",), (None,), ("",), ("/a/b/x.c",)], "path string")
    n = trees.path_nodes(p)
    assert rows(n.select("node", "files")) == [("a", 3), ("a/b", 2), ("a/b/x.c", 1), ("a/b/y.c", 1), ("a/c", 1)]
    assert {r.node for r in trees.filter_tree(n, "y").collect()} == {"a", "a/b", "a/b/y.c"}
    s = spark.createDataFrame([("v", "foo", None), ("v", "baz", "foo"), ("v", "self", "self"), ("v", "lone", "nobody")], "version string, name string, parent string")
    assert {r.name: r.parent for r in trees.symbol_tree(s).collect()} == {"foo": None, "baz": "foo", "self": None, "lone": None}


def test_session_scope():
    s = scope.Session(["a", "b", "c", "a"])
    assert s.meta() == {"scope_hint": "searched all 3 active versions"}
    for bad in ([], ["zz"], ["a", "zz"]):
        with pytest.raises(scope.ScopeError):
            s.choose(bad)
        assert s.versions() == ["a", "b", "c"]
    assert s.choose(["c", "a", "c"]) == ["c", "a"] and s.meta() == {"excluded_active_dbs": ["b"]}
    s.reset()
    assert s.versions() == ["a", "b", "c"]


# ---- splitters against plain models


def model_split(lines, most, overlap):
    out, i = [], 0
    n = [len(x.split()) for x in lines]
    while True:
        total, j = 0, i
        while j < len(lines) and total < most:
            total += n[j]
            j += 1
        out.append((i, j))
        if j >= len(lines):
            return out
        back, s = 0, j - 1
        while s > i and back < overlap:
            back += n[s]
            s -= 1
        i = max(s + 1, i + 1)


def test_line_splitter_equals_a_sequential_model():
    r = random.Random(5)
    for _ in range(300):
        lines = [" ".join("w" * r.randint(0, 9) for _ in range(r.choice([0, 1, 3, 7, 18, 40]))) for _ in range(r.randint(1, 120))]
        total = sum(len(x.split()) for x in lines)
        want = model_split(lines, 64, 8) if total > 64 else [(0, len(lines))]
        assert code.split_lines("\n".join(lines), 64, 8) == want


def test_split_chunks_names_and_lines(spark):
    big = "\n".join("a b c d e f g h" for _ in range(100))
    df = spark.createDataFrame([("f", 10, 0, 0, big), ("g", 1, 0, 0, "x"), ("n", 1, 1, 0, None)], "symbol_name string, line_start int, line_end int, chunk_index int, code_text string")
    got = [tuple(r) for r in code.split_chunks(df).select("symbol_name", "chunk_index", "line_start", "line_end").orderBy("symbol_name").collect()]
    assert got == [("f#0", 0, 10, 73), ("f#1", 1, 66, 109), ("g", 0, 1, 1), ("n", 0, 1, 1)]


@pytest.mark.parametrize("n,parts", [(0, 1), (511, 1), (512, 1), (513, 2), (960, 2), (961, 3)])
def test_section_windows(spark, n, parts):
    df = spark.createDataFrame([("t", " ".join(str(i) for i in range(n)))], "title string, content string")
    got = documents.split_sections(df, "content", "title").orderBy("idx").collect()
    assert len(got) == parts
    if parts > 1:
        assert got[1].title == "t [1]" and got[1].content.split()[0] == "448" and got[-1].content.split()[-1] == str(n - 1)


def test_html_sections(spark):
    page = """<html><body><p>before</p><nav><p>skip</p></nav><div id="protocol"><p>gone</p></div><h1>1 Top</h1><ul><li>no</li></ul><p>one <b>two</b></p>
    <h2>1.2 Sub</h2><p>three</p><h2>No number</h2><p>four</p><h3>Deep thing</h3><p>five</p><h2>3.1 empty</h2><h1></h1></body></html>"""
    df = spark.createDataFrame([("d", page), ("n", None), ("e", "")], "doc string, html string")
    got = [tuple(r) for r in documents.html_sections(documents.html_nodes(df, "doc", "html")).orderBy("ord").select("chapter", "section", "subsection", "title", "content").collect()]
    assert got == [(0, 0, "", "", "before"), (1, 0, "", "1 Top", "one two"), (1, 2, "", "1.2 Sub", "three"), (1, 0, "", "No number", "four"), (1, 0, "Deep thing", "Deep thing", "five")]


def test_pdf_sections(spark):
    s = [("d", 1, 0, 0, 0, "intro", 10.0), ("d", 2, 0, 0, 0, "2 Big", 14.0), ("d", 2, 1, 0, 0, "body", 10.0), ("d", 3, 0, 0, 0, "more", 10.0), ("d", 3, 1, 0, 0, "2.4", 11.5), ("d", 3, 1, 0, 1, "Sub", 10.0), ("d", 4, 0, 0, 0, "end", 10.0), ("d", 4, 0, 1, 0, " ", 30.0)]
    df = spark.createDataFrame(s, "doc string, page int, block int, line int, span int, text string, size double")
    got = [tuple(r) for r in documents.pdf_sections(df).orderBy("ord").select("chapter", "section", "title", "content", "page_range").collect()]
    assert got == [(0, 0, "", "intro", "1-1"), (2, 0, "2 Big", "body more", "2-3"), (2, 4, "2.4 Sub", "end", "3-4")]


def test_extractors():
    c = "#define MAX 3\nstruct pt {\n int x;\n};\ntypedef struct {\n int y;\n} q_t;\n/* int no(void) { */\nstatic int add(int a)\n{\n  if (a) { return 1; }\n  return 2;\n}\n"
    assert [(f[0], f[1], f[2], f[3]) for f in code.extract(c, "c")] == [("MAX", 1, 1, "macro"), ("pt", 2, 4, "struct"), ("q_t", 5, 7, "struct"), ("add", 9, 13, "function")]
    p = "class A:\n    def f(self):\n        pass\n\ndef g():\n    pass\n"
    assert [(f[0], f[3], f[4], f[5]) for f in code.extract(p, "python")] == [("A", "class", None, 0), ("f", "function", "A", 1), ("g", "function", None, 0)]
    j = "export class K {\n  run(x) {\n    if (x) { y(); }\n  }\n}\nfunction z() { return 1 }\n"
    assert [(f[0], f[3], f[4]) for f in code.extract(j, "javascript")] == [("K", "class", None), ("run", "function", "K"), ("z", "function", None)]
    assert [f[0] for f in code.extract("project(demo)\nmessage(x)\nadd_library(lib a.c)\n", "cmake")] == ["project(demo)", "add_library(lib)"]
    assert [f[0] for f in code.extract("all: a b\n\tcc\nX := 1\nclean:\n\trm\n", "make")] == ["all", "clean"]
    assert code.extract("", "c") == [] and code.extract("def (", "python") == []


# ---- references and incremental runs


def chunks(spark, r):
    return spark.createDataFrame(r, "version string, id long, deleted_at timestamp")


def test_orphans_whatever_the_order_of_arrival(spark):
    c = chunks(spark, [("v", 1, None), ("v", 2, T), ("v", 3, T), ("v", 3, None), ("w", 9, None)])
    s = spark.createDataFrame([("v", k, 100 + (k or 0), T) for k in (1, 2, 3, 9, None, 2)], "version string, chunk_id long, id long, loaded_at timestamp")
    n = references.merge_counts(references.existence_deltas(c), references.reference_deltas(s))
    got = references.orphans(references.child_rows(s, "symbols", "id"), references.orphan_keys(n)).select("child_id", "load_month").distinct()
    assert rows(got) == [(102, "2025-03"), (109, "2025-03")]
    late = references.merge_counts(n, references.existence_deltas(chunks(spark, [("v", 9, None)])))
    assert {r.key for r in references.orphan_keys(late).collect()} == {2}
    none = references.merge_counts(references.existence_deltas(c.limit(0)), references.reference_deltas(s.limit(0)))
    assert none.count() == 0


def test_ledger_applies_a_batch_once(spark, tmp_path):
    led = references.ReferenceLedger(spark, str(tmp_path / "ledger"))
    d = references.reference_deltas(spark.createDataFrame([("v", 1)], "version string, chunk_id long"))
    assert led.apply("a", d) and not led.apply("a", d)
    assert led.apply("b", references.existence_deltas(chunks(spark, [("v", 1, None)])))
    assert rows(led.counts()) == [("v", 1, 1, 1)]
    assert led.apply("s-0", d) and led.apply("s-1", d) and not led.apply("s-0", d) and rows(led.counts()) == [("v", 1, 3, 1)]
    assert led.vacuum() > 0 and rows(led.counts()) == [("v", 1, 3, 1)]


def test_a_failed_publication_leaves_the_ledger_as_it_was(spark, tmp_path):
    led = references.ReferenceLedger(spark, str(tmp_path / "ledger"))
    d = lambda k: references.reference_deltas(spark.createDataFrame([("v", k)], "version string, chunk_id long"))
    led.apply("s-1", d(1))
    whole = led._publish
    led._publish = lambda *a: (_ for _ in ()).throw(OSError("rename failed"))
    with pytest.raises(OSError):
        led.apply("s-2", d(2))
    assert rows(led.counts()) == [("v", 1, 1, 0)]
    led._publish = whole
    assert led.apply("s-2", d(2)) and not led.apply("s-2", d(2))
    assert rows(led.counts()) == [("v", 1, 1, 0), ("v", 2, 1, 0)]
    with pytest.raises(OSError):  # a number that another writer took
        led._publish(str(tmp_path / "ledger" / "x"), 2)


def manifest(spark, r):
    return spark.createDataFrame(r, "version string, input_root string, rel_path string, sha256 string, run_id long, written_at timestamp")


def walk(spark, r):
    return spark.createDataFrame(r, "version string, input_root string, rel_path string, sha256 string")


def test_incremental_run_survives_a_failure_and_redoes_only_changes(spark, tmp_path):
    runs = spark.createDataFrame([(1, "ok"), (2, "failed"), (3, "ok")], "run_id long, run_status string")
    w = walk(spark, [("v", "r", "a", "AA"), ("v", "r", "a", "AA"), ("v", "r", "b", "bb"), ("v", "r", "c", "cc"), ("u", "r", "d", "dd"), ("v", "r", "n", None)])
    m = manifest(spark, [("v", "r", "a", "aa", 1, T), ("v", "r", "b", "old", 1, T), ("v", "r", "b", "bb", 2, T), ("u", "r", "d", "dd", 1, T), ("u", "r", "d", "xx", 3, T), ("v", "r", "n", "q", 1, T)])
    job = increments.IncrementalRun(spark, str(tmp_path / "job"))
    want = [("u", "r", "d"), ("v", "r", "b"), ("v", "r", "c"), ("v", "r", "n")]
    with pytest.raises(RuntimeError):
        job.run(w, m, runs, fail_before_commit=True)
    assert rows(job.run(w, m, runs)) == want
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "job" / "out-1").rglob("*.parquet")}
    assert rows(job.run(w, m, runs)) == want
    assert before == {p: p.stat().st_mtime_ns for p in (tmp_path / "job" / "out-1").rglob("*.parquet")}  # nothing rewritten
    m2 = m.unionByName(manifest(spark, [("u", "r", "d", "dd", 4, T)]))
    runs2 = runs.unionByName(spark.createDataFrame([(4, "ok")], runs.schema))
    assert rows(job.run(w, m2, runs2)) == want[1:]
    after = {p for p in (tmp_path / "job" / "out-1").rglob("*.parquet")}
    assert {p for p in before if "version=v" in str(p)} <= after  # the other version's partitions stayed
    assert rows(job.run(w.where("version = 'u'"), m2, runs2)) == []  # a version that vanished is emptied


def test_incremental_run_on_empty_inputs(spark, tmp_path):
    runs = spark.createDataFrame([], "run_id long, run_status string")
    job = increments.IncrementalRun(spark, str(tmp_path / "job"))
    assert job.run(walk(spark, []), manifest(spark, []), runs).count() == 0
    assert rows(job.run(walk(spark, [("v", "r", "a", "x")]), manifest(spark, []), runs)) == [("v", "r", "a")]


def test_buckets_grow_with_the_largest_version(spark, tmp_path):
    runs = spark.createDataFrame([(1, "ok")], "run_id long, run_status string")
    job = increments.IncrementalRun(spark, str(tmp_path / "job"), rows_per_bucket=4)
    small, large = ([("v", "r", f"f{i}", "x") for i in range(n)] for n in (3, 30))
    assert job.run(walk(spark, small), manifest(spark, []), runs).count() == 3
    with pytest.raises(RuntimeError):
        job.run(walk(spark, large), manifest(spark, []), runs, fail_before_commit=True)
    assert job.result().count() == 3
    assert job.run(walk(spark, large), manifest(spark, []), runs).count() == 30 and (tmp_path / "job" / "out-8").exists()


def test_fingerprint_ignores_order_and_sees_repeats(spark):
    df = spark.createDataFrame([("v", 0, "a"), ("v", 0, "b")], "version string, bucket int, x string")
    f = lambda d: rows(increments.fingerprints(d, "s"))
    assert f(df) == f(df.orderBy(F.desc("x"))) and f(df) != f(df.unionByName(df.limit(1)))
    assert pd.DataFrame(f(df)).shape[0] == 1
