import json
import os

import pytest

from quern import build as B
from quern import cli
from quern.sources.snapshots import Store

C = "int enable_ecc(int bank)\n{\n  /* turn on error correction of the sram */\n  return bank;\n}\n"
HTML = "<html><body><h1>1 Memory</h1><p>ECC configuration of the SRAM banks.</p><h2>1.1 Reset</h2><p>Reset clears the bank.</p></body></html>"


@pytest.fixture
def tree(tmp_path):
    d = tmp_path / "src"
    d.mkdir()
    (d / "a.c").write_text(C)
    (d / "b.py").write_text("def reset_dma():\n    return 1\n")
    (d / "empty.c").write_text("\n")
    (d / "m.html").write_text(HTML)
    (d / "n.pdf").write_bytes(b"no pdf")
    return d


def test_build_search_change_and_force(spark, tmp_path, tree, capsys):
    home = str(tmp_path / "home")
    run = lambda *a: cli.main(["--home", home, *a], session=lambda: spark)
    said = lambda: capsys.readouterr().out
    assert run("search", "code", "anything") == 1
    assert run("build", "-i", str(tree), "-o", "v1") == 0 and "5 add" in said()
    store = Store(home)
    assert store.active() == ["v1"] and B.interrupted(store) is None
    report = (tmp_path / "home" / "v1" / "build-report.txt").read_text()
    assert "zero_chunks" in report and "empty.c" in report and "zero_sections" in report
    assert run("search", "code", "enable error correction on sram") == 0 and said().splitlines()[0].endswith("enable_ecc")
    assert run("search", "docs", "ECC configuration of the SRAM") == 0 and said().startswith("[1]")
    before = sorted(os.listdir(tmp_path / "home" / "v1"))
    assert run("build", "-i", str(tree), "-o", "v1") == 0 and "nothing changed" in said()
    (tree / "b.py").unlink()
    (tree / "a.c").write_text(C.replace("enable_ecc", "disable_ecc"))
    os.utime(tree / "m.html", (1, 1))  # touched, same content
    assert run("build", "-i", str(tree), "-o", "v1") == 0
    out = said()
    assert "1 delete" in out and "1 replace" in out and "1 touch" in out
    names = {r.name for r in store.read(spark, "symbols", B.SYMBOLS).collect()}
    assert names == {"disable_ecc"} and sorted(os.listdir(tmp_path / "home" / "v1")) == before
    assert store.read(spark, "doc_sections", B.SECTIONS).count() == 2
    assert run("build", "-i", str(tree), "-o", "v1", "--force") == 0 and "nothing changed" not in said()
    assert run("list") == 0 and json.loads(said())[0]["size_bytes"] > 0
    assert run("stats") == 0 and json.loads(said())[0]["symbols"] == 1
    other = tmp_path / "other"
    other.mkdir()
    (other / "x.c").write_text(C)
    assert run("build", "-i", str(other), "-o", "v1") == 1 and "roots" in capsys.readouterr().err
    assert run("build", "-i", str(other), "-o", "v2") == 0
    said()
    assert run("diff", "v1", "v2") == 0
    d = json.loads(said())
    assert "x.c" in d["files"]["added"] and "a.c" in d["files"]["removed"] and {s["name"] for s in d["symbols"]} == {"disable_ecc", "enable_ecc"}
    assert run("build", "-i", str(other), "-i", str(tree), "-o", "v2") == 0 and run("build", "-i", str(other), "-o", "v2") == 0  # a root dropped
    assert {r.name for r in store.read(spark, "symbols", B.SYMBOLS, ["v2"]).collect()} == {"enable_ecc"}
    assert run("activate", "v9") == 1 and run("deactivate", "v2") == 0 and store.active() == ["v1"]


def test_pdf_documents_come_through_the_registered_reader(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "m_rev2.pdf").write_bytes(b"1 Intro|The body of it.")
    (tmp_path / "d" / "bad.pdf").write_bytes(b"\xff")
    B.register_pdf_reader(lambda data: [(1, i, 0, 0, t, 14.0 if i == 0 else 10.0) for i, t in enumerate(data.decode().split("|"))] + [(1, 2, 0, 0, "More of the body.", 10.0)])
    try:
        store = Store(str(tmp_path / "home"))
        B.build(spark, store, "v", [str(tmp_path / "d")])
        s = store.read(spark, "doc_sections", B.SECTIONS).collect()
        assert [(r.title, r.content, r.doc_type, r.doc_revision, r.chapter) for r in s] == [("1 Intro", "The body of it. More of the body.", "pdf", "2", 1)]
    finally:
        B.PDF_READER.clear()


def test_a_build_that_fails_leaves_the_version_and_a_marker(spark, tmp_path, tree, monkeypatch):
    store = Store(str(tmp_path / "home"))
    B.build(spark, store, "v1", [str(tree)])
    (tree / "new.py").write_text("def later():\n    pass\n")
    monkeypatch.setattr(store, "_publish", lambda *a: (_ for _ in ()).throw(OSError("disk full")))
    with pytest.raises(OSError):
        B.build(spark, store, "v1", [str(tree)])
    assert B.interrupted(store)["version"] == "v1" and "later" not in {r.name for r in store.read(spark, "symbols", B.SYMBOLS).collect()}
    monkeypatch.undo()
    assert B.build(spark, store, "v1", [str(tree)]).actions["add"] == 1 and B.interrupted(store) is None


def test_rows_can_be_inserted_one_at_a_time(spark, tmp_path, tree):
    store = Store(str(tmp_path / "home"))
    B.build(spark, store, "v1", [str(tree)])
    row = {"symbol_name": "late_one", "file_path": "x.c", "file_name": "x.c", "line_start": 1, "line_end": 2, "code_text": "int late_one;", "type": "constant", "language": "c", "parent_name": "", "call_depth": 0, "chunk_index": 0}
    ids = B.insert(spark, store, "v1", "code_chunks", [row])
    c, s = store.read(spark, "code_chunks", B.CHUNKS), store.read(spark, "symbols", B.SYMBOLS)
    assert c.where(f"id = {ids[0]}").count() == 1 and s.where("name = 'late_one'").first().chunk_id == ids[0]


def test_a_burst_of_changes_gives_one_rebuild(tmp_path):
    import threading
    import time

    from quern.streaming.watch import rebuild_on_change

    (tmp_path / "a.c").write_text("x")
    calls, end, count = [], threading.Event(), []
    t = threading.Thread(target=lambda: count.append(rebuild_on_change(str(tmp_path), lambda: calls.append(1), end.is_set, quiet=0.3, poll=0.03)))
    t.start()
    time.sleep(0.2)
    for i in range(5):
        (tmp_path / f"b{i}.c").write_text("y")
        time.sleep(0.03)
    time.sleep(1.0)
    (tmp_path / "a.c").unlink()
    time.sleep(1.0)
    end.set()
    t.join()
    assert len(calls) == 2 == count[0]
