"""Command line: python -m quern.cli [--home DIR] COMMAND ...

Exit codes: 0 done, 1 an error (said on standard error), 130 interrupted.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import build as B
from quern import server
from quern.operators import delta, stats
from quern.sources.snapshots import Store

SCHEMAS = {"code_chunks": B.CHUNKS, "doc_sections": B.SECTIONS, "symbols": B.SYMBOLS + ", loaded_at timestamp", "file_manifest": B.MANIFEST}


def tables(spark: SparkSession, store: Store, versions: list[str] | None = None) -> dict[str, DataFrame]:
    return {t: store.read(spark, t, s, versions) for t, s in SCHEMAS.items()}


def engine(spark: SparkSession, store: Store, model: str | None = None) -> server.Engine:
    there = set(store.versions())
    active = [v for v in store.active() if v in there]
    if not active:
        raise B.BuildError("no active version; build one first")
    return server.Engine(spark, tables(spark, store, active), active, model, lambda: B.listing(store))


def diff(spark: SparkSession, store: Store, v1: str, v2: str) -> dict:
    """Files, symbols, languages and documents by which two versions differ,
    as a dictionary for JSON."""
    for v in (v1, v2):
        if v not in store.versions():
            raise B.BuildError(f"no such version: {v}")
    t = tables(spark, store, [v1, v2])
    rows = lambda df: [json.loads(x) for x in df.toJSON().collect()]  # noqa: E731  (the answer itself)
    files = {c: [] for c in ("added", "removed", "changed")}
    for r in delta.file_diff(t["file_manifest"], v1, v2).orderBy("rel_path").collect():
        files[r["change"]].append(r["rel_path"])
    pct = stats.share(stats.count_by(t["code_chunks"], "language", "unknown", "language", by=["version"]), ["version"])
    docs = lambda v: t["doc_sections"].where(F.col("version") == v).select("doc_name").distinct()
    names = lambda df: sorted(r[0] for r in df.collect() if r[0] is not None)
    return {
        "v1": v1, "v2": v2, "files": files, "symbols": rows(delta.symbol_diff(t["symbols"], t["code_chunks"], v1, v2).orderBy("change", "name")), "languages": rows(delta.lang_shift(pct, v1, v2).orderBy("language")),
        "documents": {"added": names(docs(v2).exceptAll(docs(v1))), "removed": names(docs(v1).exceptAll(docs(v2)))},
    }


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quern")
    p.add_argument("--home", default=os.path.expanduser("~/.quern"))
    p.add_argument("--model", help="folder with model.onnx and tokenizer.json")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *args: tuple) -> None:
        c = sub.add_parser(name)
        for flags, options in args:
            c.add_argument(*flags, **options)

    version, flag = (("version",), {}), {"action": "store_true"}
    add("build", (("-i", "--input"), {"action": "append", "required": True}), (("-o", "--output"), {"required": True}), (("--force",), flag))
    add("search", (("what",), {"choices": ["code", "docs", "all"]}), (("query",), {}), (("-k",), {"type": int, "default": 10}))
    add("symbol", (("name",), {}))
    add("symbols", (("pattern",), {"nargs": "?", "default": ""}), (("--limit",), {"type": int, "default": 200}))
    add("list", (("--remote",), {"default": None}))
    add("stats")
    add("status")
    add("diff", (("v1",), {}), (("v2",), {}))
    add("active")
    add("activate", version, (("--only",), flag))
    add("deactivate", version)
    add("delete", version)
    add("export", version, (("file",), {}))
    add("import", (("file",), {}), (("--name",), {"default": None}), (("--force",), flag))
    add("remote", (("action",), {"choices": ["add", "remove", "list"]}), (("name",), {"nargs": "?"}), (("kind",), {"nargs": "?"}), (("url",), {"nargs": "?"}))
    add("push", (("version",), {"nargs": "?"}), (("--remote",), {"action": "append"}), (("--force",), flag), (("--dry-run",), flag), (("--all",), flag))
    add("pull", version, (("--remote",), {"default": None}), (("--force",), flag))
    add("serve")
    return p


def run(args: argparse.Namespace, session: Callable[[], SparkSession], say: Callable[[str], None] = print) -> int:
    store, c = Store(args.home), args.command
    show = lambda x: say(json.dumps(x, indent=2, ensure_ascii=False))
    if c == "build":
        say(str(B.build(session(), store, args.output, args.input, model=args.model, force=args.force)))
    elif c == "search":
        e = engine(session(), store, args.model)
        hits = ([("code", r) for r in e.search_code(args.query, args.k)["results"]] if args.what != "docs" else []) + ([("docs", r) for r in e.search_docs(args.query, args.k)["results"]] if args.what != "code" else [])
        for i, (kind, r) in enumerate(sorted(hits, key=lambda x: -x[1]["score"])[: args.k], 1):
            where = f"{r.get('file_path')}:{r.get('line_start')} {r.get('symbol_name')}" if kind == "code" else f"{r.get('source_path')} {r.get('title')}"
            say(f"[{i}] {r['score']:.4f} {r['version']} {where}")
    elif c == "symbol":
        show(engine(session(), store).get_symbol_definition(args.name))
    elif c == "symbols":
        show(engine(session(), store).list_symbols(args.pattern, args.limit)["symbols"])
    elif c == "list" and args.remote:
        here = set(store.versions())
        far = {v["name"] for v in store.backend(args.remote).versions()}
        show([{"name": n, "location": "local+remote" if n in here & far else "local" if n in here else "remote"} for n in sorted(here | far)])
    elif c == "list":
        show(B.listing(store))
    elif c == "stats":
        t = tables(session(), store)
        show([json.loads(x) for x in stats.version_stats(t["code_chunks"], t["symbols"], t["doc_sections"]).orderBy("version").toJSON().collect()])  # a row per version
    elif c == "status":
        show({"home": str(store.home), "versions": store.versions(), "active": store.active(), "remotes": sorted(store.remotes()), "interrupted": B.interrupted(store)})
    elif c == "diff":
        show(diff(session(), store, args.v1, args.v2))
    elif c == "active":
        show(store.active())
    elif c == "activate":
        if args.version not in store.versions():
            raise B.BuildError(f"no such version: {args.version}")
        store.replace_active([args.version]) if args.only else store.activate(args.version)
    elif c in ("deactivate", "delete"):
        if not getattr(store, c)(args.version):
            raise B.BuildError(f"no such version: {args.version}")
    elif c == "export":
        say(f"{len(store.export(args.version, args.file)['files'])} files")
    elif c == "import":
        say(store.import_archive(args.file, args.name, args.force))
    elif c == "remote":
        if args.action == "add":
            store.add_remote(args.name, args.kind, args.url)
        elif args.action == "remove" and not store.remove_remote(args.name):
            raise B.BuildError(f"no such remote: {args.name}")
        elif args.action == "list":
            show(store.remotes())
    elif c == "push":
        rows = [r | {"version": v} for v in (store.versions() if args.all else [args.version]) for r in store.push(v, args.remote, force=args.force, dry_run=args.dry_run)]
        show(rows)
        return int(not all(r["ok"] for r in rows))
    elif c == "pull":
        store.pull(args.version, args.remote, force=args.force)
    elif c == "serve":
        server.serve(engine(session(), store, args.model))
    return 0


def main(argv: list[str] | None = None, session: Callable[[], SparkSession] | None = None) -> int:
    from quern.session import local_session

    try:
        return run(_parser().parse_args(argv), session or local_session)
    except KeyboardInterrupt:
        return 130
    except Exception as e:  # noqa: BLE001
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
