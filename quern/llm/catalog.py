"""Queries of the training-data operators and their SQL, where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import leakage, neardup, packing, pieces, provenance, similar, truncation
from quern.session import fresh_path, table, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def wrap(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return wrap


# ---- 1: generated, minified, vendored, blobs


def _labelled(s, d):
    return provenance.labelled(table(s, d, "code_chunks").select("file_path", "code_text"))


@query()
def p1_found(s, d):
    return _labelled(s, d).where("handwritten < 0.5").select("file_path").distinct()


@query()
def p1_labels(s, d):
    return _labelled(s, d)


# ---- 2: near-duplicates


def _near(s, d) -> neardup.NearDuplicates:
    """The task's own terms: three words, similarity 0.6, 50 words at least."""
    code, doc = table(s, d, "code_chunks").select("id", "code_text"), table(s, d, "doc_sections").select("section_id", "content")
    return neardup.NearDuplicates([(code, "code_chunks", "id", "code_text"), (doc, "doc_sections", "section_id", "content")], words=3, threshold=0.6, least=50)


@query()
def p2_found(s, d):
    return _near(s, d).pairs()


@query()
def p2_links(s, d):
    return _near(s, d).links


@query()
def p2_groups(s, d):
    return _near(s, d).groups()


# ---- 3: oversized items


def _pieces(s, d, with_text):
    code = table(s, d, "code_chunks").select("id", "code_text")
    doc = table(s, d, "doc_sections").select("section_id", "content")
    return pieces.split_table(code, "code_chunks", "id", "code_text", with_text=with_text).unionByName(pieces.split_table(doc, "doc_sections", "section_id", "content", with_text=with_text))


WS = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


@query(
    f"""select distinct 'code_chunks' as item_table, id as item_id from code_chunks where id is not null and len(regexp_extract_all(code_text, '[^{WS}]+')) > 512
    union all select distinct 'doc_sections', section_id from doc_sections where section_id is not null and len(regexp_extract_all(content, '[^{WS}]+')) > 512"""
)
def p3_found(s, d):
    return _pieces(s, d, False).select("item_table", "item_id").distinct()


@query()
def p3_pieces(s, d):
    return _pieces(s, d, True)


TEXTS = """x as (select distinct 'code_chunks' as item_table, id as item_id, code_text as t from code_chunks where id is not null union select distinct 'doc_sections', section_id, content from doc_sections where section_id is not null),
n as (select item_table, item_id, len(regexp_extract_all(t, '[^{}]+')) as n from x)""".format(WS)


@query(
    f"""with {TEXTS} select item_table, item_id, greatest(1, ceil((n - 513) / 384.0))::bigint + 1 as pieces, n::bigint as tokens, true as fits from n where n > 512"""
)
def p3_totals(s, d):
    """Pieces of each text, its tokens without the repeated ones, and whether
    every piece is within the limit."""
    p = _pieces(s, d, False).groupBy("item_table", "item_id", "content_hash").agg(F.count(F.lit(1)).alias("pieces"), F.sum("tokens").alias("sum"), F.max("tokens").alias("most"))
    return p.select("item_table", "item_id", "pieces", (F.col("sum") - pieces.OVERLAP * (F.col("pieces") - 1)).alias("tokens"), (F.col("most") <= pieces.LIMIT).alias("fits"))


@query(
    f"""with {TEXTS} select item_table, item_id, greatest(1, ceil((n - 513) / 384.0))::bigint + 1 as pieces, n::bigint as tokens from n where n > 512"""
)
def p3_files(s, d):
    """The same from files: texts that may be too long are written out, a file
    each, and split by byte ranges of files that no task reads whole."""
    code = table(s, d, "code_chunks").select(F.lit("code_chunks").alias("item_table"), F.col("id").alias("item_id"), F.col("code_text").alias("text"))
    doc = table(s, d, "doc_sections").select(F.lit("doc_sections").alias("item_table"), F.col("section_id").alias("item_id"), F.col("content").alias("text"))
    long = code.unionByName(doc).where(F.col("item_id").isNotNull() & (F.length("text") >= 2 * pieces.LIMIT + 1)).dropDuplicates()
    folder = fresh_path(s, "texts")
    done = written(pieces.write_files(long.withColumn("name", F.concat_ws("-", "item_table", "item_id", F.hex(F.xxhash64("text")))), folder), "files")
    if done.isEmpty():
        return s.createDataFrame([], "item_table string, item_id bigint, pieces bigint, tokens bigint")
    p = pieces.split_files(s, folder, size_of_range=4096, with_text=False).groupBy("path").agg(F.count(F.lit(1)).alias("pieces"), (F.sum("tokens") - pieces.OVERLAP * (F.count(F.lit(1)) - 1)).alias("tokens"))
    name = F.split(F.substring_index("path", "/", -1), "-")
    return p.select(name[0].alias("item_table"), name[1].cast("bigint").alias("item_id"), "pieces", "tokens")


# ---- 5: similar vectors


def _similar(s, d) -> similar.Neighbours:
    return similar.Neighbours(table(s, d, "vec_code").select("chunk_id", "embedding"), "chunk_id", "embedding", 384, 5)


@query()
def p5_found(s, d):
    return _similar(s, d).pairs()


@query()
def p5_neighbours(s, d):
    return _similar(s, d).lists()


# ---- 7: packing


def _assigned(s, d):
    lengths = written(packing.token_lengths(table(s, d, "documents").select("doc_id", "text")), "lengths")
    return packing.assign(lengths, packing.limits_of(s, table(s, d, "pack_limits")))


@query()
def p7_assignment(s, d):
    return _assigned(s, d)


@query()
def p7_utilisation(s, d):
    return packing.utilisation(_assigned(s, d), table(s, d, "pack_limits").select("limit_name", "capacity_tokens").distinct())


# ---- 8: leakage

GRAMS = """with w as (select {id} as id, regexp_extract_all(lower({text}), '[a-z0-9]+') as w from {table} where {id} is not null and {text} is not null), g as (select id, unnest(generate_series(1, len(w) - 11)) as i, w from w where len(w) >= 12)
select distinct id, array_to_string(w[i : i + 11], ' ') as g from g"""


@query(
    f"""with a as ({GRAMS.format(id="doc_id", text="text", table="documents")}), b as ({GRAMS.format(id="item_id", text="text", table="eval_items")}) select distinct a.id as doc_id, b.id as item_id from a join b using (g)"""
)
def p8_found(s, d):
    return p8_spans(s, d).select("doc_id", "item_id").distinct()


@query()
def p8_spans(s, d):
    return leakage.leaks(table(s, d, "documents").select("doc_id", "text"), table(s, d, "eval_items").select("item_id", "text"))


@query(
    f"""with a as ({GRAMS.format(id="doc_id", text="text", table="documents")}), b as ({GRAMS.format(id="item_id", text="text", table="eval_items")}) select b.id as item_id, count(distinct a.id)::bigint as documents from a join b using (g) group by 1"""
)
def p8_items(s, d):
    return p8_found(s, d).groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"))


# ---- 9: truncation


def _judged(s, d):
    return truncation.judged(table(s, d, "documents").select("doc_id", "text", "source"))


@query()
def p9_found(s, d):
    return _judged(s, d).where("posterior >= 0.5").select("doc_id").distinct()


@query()
def p9_sources(s, d):
    return truncation.by_source(_judged(s, d))
