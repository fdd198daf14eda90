import io
import json

import pytest

from quern import server
from quern.operators import embedding
from quern.operators.code import parse_files
from quern.sources import files, snapshots
from quern.streaming import watch


@pytest.fixture
def tree(tmp_path):
    d = tmp_path / "src"
    (d / ".hidden").mkdir(parents=True)
    (d / "a.c").write_text("int f(void)\n{\n  return 1;\n}\n")
    (d / ".hidden" / "b.py").write_text("def g():\n    pass\n")
    (d / "Makefile").write_text("all:\n\tcc\n")
    (d / "m.HTML").write_text("x")
    (d / "m.html").write_text("<html></html>")
    (d / "notes.txt").write_text("x")
    return d


def test_scan_and_parse(spark, tree):
    f = files.scan(spark, str(tree))
    got = {r.rel_path: (r.kind, r.language) for r in f.collect()}
    assert got == {"a.c": ("code", "c"), ".hidden/b.py": ("code", "python"), "Makefile": ("code", "make"), "m.html": ("doc", None)}
    assert {r.symbol_name for r in parse_files(f.where("kind = 'code'")).collect()} == {"f", "g", "all"}
    assert files.manifest(f).where("length(sha256) = 64").count() == 4


def test_store_round_trip_and_tampering(spark, tmp_path):
    a, b = snapshots.Store(str(tmp_path / "a")), snapshots.Store(str(tmp_path / "b"))
    df = spark.createDataFrame([(1, "x")], "id long, name string")
    a.write("v1", {"symbols": df})
    with pytest.raises(FileExistsError):
        a.write("v1", {"symbols": df})
    a.write("v1", {"symbols": df.unionByName(df)}, force=True)
    assert a.read(spark, "symbols", "id long, name string, extra int").count() == 2
    assert a.read(spark, "doc_sections", "id long").count() == 0
    z = str(tmp_path / "v1.zip")
    a.export("v1", z)
    assert b.import_archive(z) == "v1" and b.active() == ["v1"] and b.versions() == ["v1"]
    import zipfile

    bad = str(tmp_path / "bad.zip")
    with zipfile.ZipFile(z) as old, zipfile.ZipFile(bad, "w") as new:
        for n in old.namelist():
            new.writestr(n, old.read(n) + (b"!" if n.endswith(".parquet") else b""))
    with pytest.raises(ValueError):
        b.import_archive(bad, "v2")
    assert b.versions() == ["v1"]
    assert a.delete("v1") and not a.delete("v1")


def test_config_carries_old_keys_over(tmp_path):
    s = snapshots.Store(str(tmp_path))
    (tmp_path / "config.json").write_text(json.dumps({"active_version": "v9", "repo_url": "https://github.com/a/b"}))
    assert s.active() == ["v9"] and s.remotes()["default"]["type"] == "github"
    s.activate("v9")
    s.activate("v8")
    assert s.active() == ["v9", "v8"] and s.deactivate("v9") and not s.deactivate("v9")


def test_remotes(spark, tmp_path):
    s = snapshots.Store(str(tmp_path / "home"))
    (tmp_path / "far").mkdir()
    s.write("v1", {"symbols": spark.createDataFrame([(1,)], "id long")})
    s.add_remote("far", "filesystem", str(tmp_path / "far"))
    s.add_remote("broken", "filesystem", str(tmp_path / "missing" / "x"))
    assert [r["ok"] for r in s.push("v1", ["broken", "far"])][1] is True
    assert [r["ok"] for r in s.push("v1", ["far"])] == [False]  # there already
    assert s.push("v1", ["far"], force=True)[0]["ok"]
    assert [v["name"] for v in s.backend("far").versions()] == ["v1"]
    s.origin("v1", "far")
    assert s.origin("v1") == "far" and s.remove_remote("far") and not s.remove_remote("far")


def test_release_backend_parses_its_client():
    b = snapshots.ReleaseBackend("https://github.com/a/b.git", "hub")
    b.run = lambda *args: json.dumps([{"tag_name": "v1", "assets": [{"size": 3}, {"size": 4}], "published_at": "2025-01-01T00:00:00Z"}]) if args[-1] == "repos/a/b/releases" else ""
    assert b.versions() == [{"name": "v1", "remote": "hub", "size_bytes": 7, "updated_at": "2025-01-01T00:00:00Z"}]


def test_addresses_and_folders():
    hosts = ("github.com", "www.github.com")
    assert {snapshots.address(u, hosts) for u in ("https://github.com/a/b", "github.com/a/b/", "a/b", "ssh://git@github.com/a/b")} == {"a/b"}
    with pytest.raises(ValueError):
        snapshots.address("https://example.org/a/b", hosts)
    assert snapshots.below(["r/s/v2/x", "r/s/v1/t/y", "r/s/file", "q/v3/z"], "r/s") == ["v1", "v2"]


def test_release_round_trip_checks_its_files(tmp_path):
    import shutil

    far, src = tmp_path / "far", tmp_path / "src" / "symbols"
    far.mkdir()
    src.mkdir(parents=True)
    (src / "a.parquet").write_text("x")
    b = snapshots.ReleaseBackend("a/b", "hub")

    def run(*args):
        if args[:2] == ("release", "create"):
            [shutil.copy(f, far) for f in args[5:7]]
        if args[:2] == ("release", "download"):
            [shutil.copy(f, args[args.index("--dir") + 1]) for f in far.iterdir()]
        return ""

    b.run = run
    b.push("v1", src.parent)
    b.download("v1", tmp_path / "got")
    assert (tmp_path / "got" / "symbols" / "a.parquet").read_text() == "x"
    (far / "checksums.json").write_text("{}")
    with pytest.raises(ValueError):
        b.download("v1", tmp_path / "bad")
    assert not (tmp_path / "bad").exists()


def test_git_transport_tracks_tables_and_commits_only_changes(tmp_path):
    b, calls = snapshots.GitBackend("url", "git"), []

    def run(*args):
        calls.append(args)
        if args[0] == "clone":
            (tmp_path / "w").mkdir(exist_ok=True)
            __import__("pathlib").Path(args[-1]).mkdir()
        return ""

    b.run = run
    (tmp_path / "src").mkdir()
    b.push("v1", tmp_path / "src")
    assert any(a[2:4] == ("lfs", "track") for a in calls) and not any("push" in a for a in calls)
    with pytest.raises(FileNotFoundError):
        b.delete("v9")


@pytest.fixture
def engine(spark):
    texts = ["enable the ecc unit", "reset the dma engine", "read the sensor"]
    v = embedding.hash_vectors(texts).tolist()
    c = spark.createDataFrame([(f"v{i % 2}", i, f"f{i}.c", 1, 3, t, v[i]) for i, t in enumerate(texts)], "version string, id long, file_path string, line_start int, line_end int, code_text string, embedding array<float>")
    s = spark.createDataFrame([("v0", 7, "ecc_enable", "function", "c", "f0.c", 0, None), ("v1", 8, "dma_reset", "function", "c", "f1.c", 1, None)], "version string, id long, name string, type string, language string, file_path string, chunk_id long, loaded_at timestamp")
    d = spark.createDataFrame([], "version string, section_id long, source_path string, page_range string, content string, embedding array<float>")
    return server.Engine(spark, {"code_chunks": c, "symbols": s, "doc_sections": d}, ["v0", "v1"])


def test_server(engine):
    ask = lambda name, **a: json.loads(server.handle(engine, {"id": 1, "method": "tools/call", "params": {"name": name, "arguments": a}})["result"]["content"][0]["text"])
    assert ask("search_code", query="ecc unit")["results"][0]["file_path"] == "f0.c"
    assert ask("search_docs", query="ecc")["results"] == []
    assert ask("get_symbol_definition", symbol="dma_reset")["code_text"] == "reset the dma engine"
    assert "error" in ask("get_symbol_definition", symbol="nope")
    assert ask("set_active_databases", versions=["v1"]) == {"active": ["v1"]}
    assert [s["name"] for s in ask("list_symbols")["symbols"]] == ["dma_reset"]
    assert server.handle(engine, {"id": 2, "method": "tools/call", "params": {"name": "set_active_databases", "arguments": {"versions": []}}})["error"]["code"] == -32603
    assert server.handle(engine, {"id": 3, "method": "nope"})["error"]["code"] == -32601
    engine.tables["symbols"] = engine.tables["symbols"].drop("name")
    assert server.handle(engine, {"id": 9, "method": "tools/call", "params": {"name": "list_symbols"}})["error"]["code"] == -32603  # and it goes on
    out = io.StringIO()
    server.serve(engine, io.StringIO('\n{"method": "note"}\nnot json\n{"id": 4, "method": "tools/list"}\n'), out)
    assert len(out.getvalue().splitlines()) == 1


def test_streams(spark, tmp_path):
    from quern.operators.references import ReferenceLedger, orphan_keys

    src = str(tmp_path / "children")
    kids = spark.createDataFrame([("v", 1), ("v", 2)], "version string, chunk_id long")
    kids.write.parquet(src)
    led = ReferenceLedger(spark, str(tmp_path / "ledger"))
    for _ in range(2):  # the second start finds nothing new
        watch.ledger_stream(None, spark.readStream.schema(kids.schema).parquet(src), led, str(tmp_path / "cp")).awaitTermination()
    assert {(r.key, r.refs) for r in orphan_keys(led.counts()).collect()} == {(1, 1), (2, 1)}
    ev = spark.createDataFrame([("2025-01-01 00:00:00", "a", 1.0), ("2025-01-01 10:00:00", "a", 2.0)], "t string, event_type string, value double").selectExpr("to_timestamp(t) ts", "event_type", "value")
    assert watch.event_windows(ev).first().total == 3.0
