"""Builds: scan, delta, parse, embed, write, activate.

A build compares the files below its roots with the manifest of the version,
reads and parses only what is new or changed, and publishes a whole snapshot in
one step: readers see the old version or the new one, and a build that fails
leaves the old one with a marker that says what was under way.  Ids are hashes
of where a row comes from, so a repeated build gives the same ones.
"""

from __future__ import annotations

import datetime
import json
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as X
from quern.operators import code, delta, documents, embedding
from quern.session import written
from quern.sources import files as FS
from quern.sources import registry
from quern.sources.snapshots import Store

MANIFEST = "kind string, rel_path string, input_root string, mtime double, sha256 string"
CHUNKS = "id bigint, " + code.CHUNK + ", embedding array<float>"
SECTIONS = (
    "section_id bigint, source_path string, doc_type string, chapter int, section int, subsection string, title string, content string, page_range string, feature_tags array<string>, "
    "doc_name string, doc_revision string, doc_status string, word_count int, fig_table_refs array<string>, embedding array<float>"
)
SYMBOLS = "id bigint, name string, type string, language string, file_path string, line_number int, chunk_id bigint"
FILES = "path string, kind string, language string, chunks bigint, skipped boolean, skip_reason string"
MARKER = ".quern-build-state.json"


class BuildError(RuntimeError):
    pass


# Readers of PDF bytes into rows (page, block, line, span, text, size); none is built in.
PDF_READER: list[Callable[[bytes], Iterable[tuple[int, int, int, int, str, float]]]] = []


def register_pdf_reader(read: Callable[[bytes], Iterable[tuple[int, int, int, int, str, float]]]) -> None:
    PDF_READER[:] = [read]


def pdf_spans(files: DataFrame) -> DataFrame:
    """(doc, page, block, line, span, text, size) of files (path, content) by
    the registered reader; a file it cannot read has no spans."""
    import pandas as pd

    schema, reader = "doc string, page int, block int, line int, span int, text string, size double", PDF_READER[:1]

    def run(batches):
        for pdf in batches:
            out = []
            for p, c in zip(pdf["path"], pdf["content"]):
                try:
                    out += [(p, *row) for row in reader[0](bytes(c))] if reader and c is not None else []
                except Exception:  # noqa: BLE001, S112 (whatever a reader raises on a broken file)
                    continue
            yield pd.DataFrame(out, columns=[x.split()[0] for x in schema.split(", ")])

    return files.select("path", "content").mapInPandas(run, schema)


def parse_docs(files: DataFrame) -> DataFrame:
    """Sections of document files (path, content) by their extension."""
    html = files.where(registry.extension(F.col("path")).isin("html", "htm")).select("path", F.decode("content", "UTF-8").alias("html"))
    pdf = files.where(registry.extension(F.col("path")) == "pdf")
    both = [documents.html_sections(documents.html_nodes(html, "path", "html")).withColumn("doc_type", F.lit("html")), documents.pdf_sections(pdf_spans(pdf)).withColumn("doc_type", F.lit("pdf"))]
    s = documents.split_sections(reduce(DataFrame.unionByName, both), "content", "title")
    path = F.col("doc")
    return s.select(
        F.xxhash64("doc", "ord", "idx").alias("section_id"), path.alias("source_path"), "doc_type", "chapter", "section", "subsection", "title", "content", "page_range", X.feature_tags(F.col("title"), F.col("content")).alias("feature_tags"),
        X.stem(path).alias("doc_name"), X.revision(path).alias("doc_revision"), X.status(path).alias("doc_status"), F.col("word_count").cast("int").alias("word_count"), X.figure_refs(F.col("content")).alias("fig_table_refs"),
    )


def symbols_of(chunks: DataFrame) -> DataFrame:
    """One row per name: the first chunk that defines it, pieces under the name
    of the whole."""
    name = F.regexp_replace("symbol_name", "#[0-9]+$", "")
    first = F.min(F.struct("file_path", "line_start", "chunk_index", "id", "type", "language"))
    return chunks.where("symbol_name <> ''").groupBy(name.alias("name")).agg(first.alias("f")).select(
        F.xxhash64("name").alias("id"), "name", "f.type", "f.language", "f.file_path", F.col("f.line_start").alias("line_number"), F.col("f.id").alias("chunk_id")
    )


@dataclass
class Built:
    version: str
    changed: int
    actions: dict[str, int] = field(default_factory=dict)
    dropped: list[str] = field(default_factory=list)
    report: str | None = None

    def __str__(self) -> str:
        return f"{self.version}: " + (", ".join(f"{n} {a}" for a, n in sorted(self.actions.items())) if self.changed else "nothing changed")


def build(spark: SparkSession, store: Store, version: str, roots: list[str], *, model: str | None = None, force: bool = False, activate: bool = True) -> Built:
    """Bring a version up to date with the files below `roots`.  Roots the
    manifest knows and the call leaves out are dropped with their files; if it
    knows none of the given ones this is another project, an error."""
    began, roots = time.time(), [str(Path(r).resolve()) for r in roots]
    missing = [r for r in roots if not Path(r).is_dir()]
    if missing or not roots:
        raise BuildError(f"no such folder: {', '.join(missing)}" if missing else "no folders given")
    at = F.lit(version).alias("version")
    read = lambda table, schema: store.read(spark, table, schema, [] if force else [version])
    manifest = read("file_manifest", MANIFEST).withColumn("version", F.lit(version))
    stored = [r[0] for r in manifest.select("input_root").distinct().collect()]  # roots: few
    if stored and not set(stored) & set(roots):
        raise BuildError(f"roots of {version} are {', '.join(sorted(stored))}; use force to build it anew")
    found = written(reduce(DataFrame.unionByName, [FS.scan(spark, r, content=False) for r in roots]), "walk")
    marker = store.home / MARKER
    marker.write_text(json.dumps({"version": version, "started_at": datetime.datetime.now(datetime.UTC).isoformat(), "roots": roots, "files": found.count()}))

    # only files that are new or have another mtime are opened
    key = ["input_root", "rel_path"]
    same = manifest.select(*key, "mtime", F.col("sha256").alias("known"))
    opened = found.join(same, [*key, "mtime"], "left_anti")
    content = written(FS.read_content(opened), "content")
    hashed = content.select(*key, F.sha2("content", 256).alias("sha256"))
    walk = found.join(same, [*key, "mtime"], "left").join(hashed, key, "left").select(at, "kind", *key, "mtime", F.coalesce("sha256", "known").alias("sha256"))
    walk = written(walk, "walk-hashed")
    changes = written(delta.file_delta(manifest, walk), "delta")
    actions = {r[0]: r[1] for r in changes.groupBy("action").count().collect()}  # at most five
    changed = sum(n for a, n in actions.items() if a != "unchanged")
    out = Built(version, changed, actions, sorted(set(stored) - set(roots)))
    if changed:
        fresh = content.join(changes.where("action in ('add', 'replace')").select(*key), key, "left_semi").drop("path").withColumn("path", F.concat_ws("/", *key))
        vector = lambda c: embedding.embed(F.col(c), model)
        chunks = code.parse_files(fresh.where("kind = 'code'")).withColumn("id", F.xxhash64("file_path", "symbol_name", "line_start", "chunk_index")).withColumn("embedding", vector("code_text"))
        sections = parse_docs(fresh.where("kind = 'doc'")).withColumn("embedding", vector("content"))
        keep = lambda table, schema, new, path: written(delta.apply_delta(read(table, schema).withColumn("version", F.lit(version)), changes, new.withColumn("version", F.lit(version)), path).drop("version"), table)
        chunks, sections = keep("code_chunks", CHUNKS, chunks, "file_path"), keep("doc_sections", SECTIONS, sections, "source_path")
        per = chunks.groupBy(F.col("file_path").alias("path")).agg(F.count(F.lit(1)).alias("chunks")).unionByName(sections.groupBy(F.col("source_path").alias("path")).agg(F.count(F.lit(1)).alias("chunks")))
        listed = walk.select(F.concat_ws("/", *key).alias("path"), "kind")
        lang = F.when(F.col("kind") == "code", registry.language(F.col("path"))).otherwise(F.when(registry.extension(F.col("path")) == "pdf", "pdf").otherwise("html"))
        records = written(listed.join(per, "path", "left").select("path", "kind", lang.alias("language"), F.coalesce("chunks", F.lit(0)).cast("bigint").alias("chunks"), F.col("chunks").isNull().alias("skipped"), F.when(F.col("chunks").isNull(), F.when(F.col("kind") == "code", "zero_chunks").otherwise("zero_sections")).alias("skip_reason")), "records")
        info = {"roots": roots, "model": model or "hash"}
        store.write(version, {"code_chunks": chunks, "symbols": symbols_of(chunks), "doc_sections": sections, "file_manifest": walk.drop("version"), "file_records": records}, info, force=True)
        out.report = str(store.path(version) / "build-report.txt")
        Path(out.report).write_text(report(records, version, time.time() - began))
    if activate:
        store.activate(version)
    marker.unlink(missing_ok=True)
    return out


def insert(spark: SparkSession, store: Store, version: str, table: str, rows: list[dict], model: str | None = None) -> list[int]:
    """Append a few chunks or sections; returns their ids.  Chunks bring their
    symbols along; the last writer of a name wins in lookups."""
    schema, key = {"code_chunks": (CHUNKS, ["file_path", "symbol_name", "line_start", "chunk_index"]), "doc_sections": (SECTIONS, ["source_path", "title", "page_range"])}[table]
    ident, text = schema.split()[0], "code_text" if table == "code_chunks" else "content"
    df = spark.createDataFrame([tuple(r.get(c.split()[0]) for c in schema.split(", ")) for r in rows], schema)
    df = written(df.withColumn(ident, F.xxhash64(*key)).withColumn("embedding", F.coalesce("embedding", embedding.embed(F.col(text), model))), "inserted")
    store.append(version, table, df)
    if table == "code_chunks":
        store.append(version, "symbols", symbols_of(df))
    return [r[0] for r in df.select(ident).collect()]  # the rows of the call


def interrupted(store: Store) -> dict | None:
    """What a build that did not end was doing."""
    at = store.home / MARKER
    return json.loads(at.read_text()) if at.exists() else None


def report(records: DataFrame, version: str, seconds: float, listed: int = 10_000) -> str:
    """A text of totals, languages and skipped files; at most `listed` skipped
    files are named, the rest is counted."""
    from quern.operators import reports

    t = records.groupBy("kind").agg(F.count(F.lit(1)).alias("files"), F.count_if("skipped").alias("skipped"), F.sum("chunks").alias("chunks")).collect()  # two rows
    lines = [f"build of {version}", f"written {datetime.datetime.now():%Y-%m-%d %H:%M:%S}", f"took {seconds:.1f} s", ""]
    for r in sorted(t):
        lines.append(f"{r['kind']}: {r['files']} files, {r['skipped']} skipped, {r['chunks']:,} {'chunks' if r['kind'] == 'code' else 'sections'}")
    by = reports.by_language(records.withColumn("elapsed", F.lit(0.0))).orderBy(F.desc("chunks"), "language").collect()  # a row per language
    lines += ["", f"{'language':<20} {'files':>8} {'chunks':>10} {'per file':>9}"] + [f"{r['language'] or '-':<20} {r['files']:>8} {r['chunks']:>10,} {r['avg_chunks']:>9.1f}" for r in by]
    gone = records.where("skipped").orderBy("skip_reason", "path").select("skip_reason", "path").limit(listed + 1).collect()
    if gone:
        lines += ["", "skipped"] + [f"{r['skip_reason']:<15} {r['path']}" for r in gone[:listed]]
        if len(gone) > listed:
            lines.append(f"and {records.where('skipped').count() - listed} more")
    return "\n".join(lines) + "\n"


def listing(store: Store) -> list[dict]:
    """Versions with their size, newest file and whether they are active."""
    active = store.active()
    out = []
    for v in store.versions():
        files = [p for p in store.path(v).rglob("*") if p.is_file()]
        newest = max((p.stat().st_mtime for p in files), default=0.0)
        out.append({"version": v, "size_bytes": sum(p.stat().st_size for p in files), "updated_at": datetime.datetime.fromtimestamp(newest, datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ"), "active": v in active})
    return out
