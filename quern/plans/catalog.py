"""Queries of the engine's own operators and of the general operations, each
with the SQL that must give the same rows (None where SQL cannot say it)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import fmt
from quern.functions import text as X
from quern.functions import vectors as V
from quern.operators import code, delta, documents, embedding, increments, references, reports, retrieval, scope, stats, symbols, trees
from quern.session import fresh_path, table
from quern.sources import files as FS
from quern.sources import registry

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def wrap(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return wrap


WS = X.WHITESPACE


def _tokens(x: str) -> str:
    return f"regexp_extract_all({x}, '[^{WS}]+')"



USABLE = "embedding is not null and len(embedding) = {} and isfinite(list_sum(list_transform(embedding, lambda x: x::double * x::double))) and list_sum(list_transform(embedding, lambda x: x::double * x::double)) > 0"
ROUND_COS = "round(greatest(0, {}), 4)"


# ---- text of documents and sections


@query(f"select doc_id, len({_tokens('text')})::bigint as token_count from documents")
def token_count(s, d):
    return table(s, d, "documents").select("doc_id", X.token_count(F.col("text")).alias("token_count"))


@query(
    f"""with x as (select distinct version, section_id, coalesce(title, '') as title, coalesce(content, '') as content, {_tokens("coalesce(content, '')")} as w from doc_sections),
    y as (select *, unnest(generate_series(0, case when len(w) <= 512 then 0 else ceil((len(w) - 512) / 448.0)::int end)) as i from x)
    select version, section_id, i::int as idx, case when i > 0 then title || ' [' || i || ']' else title end as title,
    case when len(w) <= 512 then content else array_to_string(w[i * 448 + 1 : i * 448 + 512], ' ') end as content, len(w[i * 448 + 1 : i * 448 + 512])::bigint as word_count from y"""
)
def doc_split(s, d):
    x = table(s, d, "doc_sections").select("version", "section_id", "title", "content").distinct()
    return documents.split_sections(x, "content", "title").select("version", "section_id", "idx", "title", "content", "word_count")


@query("select id, replace(substring(coalesce(code_text, ''), 1, 300), chr(10), ' ') as snippet, replace(substring(coalesce(code_text, ''), 1, 120), chr(10), ' ') as short from code_chunks")
def snippet(s, d):
    return table(s, d, "code_chunks").select("id", X.snippet(F.col("code_text"), 300).alias("snippet"), X.snippet(F.col("code_text"), 120).alias("short"))


@query("select section_id, list_filter(string_split(array_to_string(coalesce(feature_tags, []::varchar[]), ','), ','), lambda x: x <> '') as tags from doc_sections")
def csv_split(s, d):
    csv = F.array_join(F.coalesce(F.col("feature_tags"), F.array().cast("array<string>")), ",")
    return table(s, d, "doc_sections").select("section_id", X.csv_split(csv).alias("tags"))


@query(
    """select section_id, array_to_string(list_sort(list_filter(list_distinct(list_filter(string_split_regex(coalesce(title, '') || ' ' || substring(coalesce(content, ''), 1, 500), '[^\\pL\\pN_]+'),
    lambda x: regexp_full_match(x, '[A-Z][A-Z0-9]{1,7}'))), lambda x: x not in ('A','I','AN','AT','BY','IN','IS','IT','OF','ON','OR','TO','UP','BE','DO','IF','NO','SO','AS'))), ',') as tags from doc_sections"""
)
def feature_tags(s, d):
    return table(s, d, "doc_sections").select("section_id", F.array_join(X.feature_tags(F.col("title"), F.col("content")), ",").alias("tags"))


@query(
    """with x as (select row_number() over () as r, section_id, regexp_extract_all(substring(coalesce(content, ''), 1, 3000), '(?i)\\b(?:Figure|Fig\\.?|Table)\\s+[0-9]+(?:[.\\-][0-9]+)*') as f from doc_sections)
    select section_id, array_to_string(list_transform(list_filter(list_zip(f, generate_series(1, len(f))), lambda p: list_position(f, p[1]) = p[2])[1:20], lambda p: p[1]), ',') as refs from x"""
)
def fig_table_refs(s, d):
    return table(s, d, "doc_sections").select("section_id", F.array_join(X.figure_refs(F.col("content")), ",").alias("refs"))


@query(
    """select section_id, coalesce(try_cast(nullif(regexp_extract(trim(coalesce(title, '')), '^([0-9]+)(?:\\.([0-9]+))?(?:\\.([0-9]+))?', 1), '') as int), 0) as chapter,
    coalesce(try_cast(nullif(regexp_extract(trim(coalesce(title, '')), '^([0-9]+)(?:\\.([0-9]+))?(?:\\.([0-9]+))?', 2), '') as int), 0) as section,
    coalesce(regexp_extract(trim(coalesce(title, '')), '^([0-9]+)(?:\\.([0-9]+))?(?:\\.([0-9]+))?', 3), '') as subsection from doc_sections"""
)
def heading_number(s, d):
    return table(s, d, "doc_sections").select("section_id", X.heading_number(F.col("title")).alias("h")).select("section_id", "h.chapter", "h.section", "h.subsection")


STEM = "regexp_replace(regexp_extract(source_path, '[^/]*$'), '(.)\\.[^.]*$', '\\1')"


@query(f"select section_id, regexp_extract({STEM}, '(?i)[_\\-\\s](?:rev?|ver?|version)\\.?\\s*([0-9]+[\\.0-9]*)', 1) as revision from doc_sections")
def doc_revision(s, d):
    return table(s, d, "doc_sections").select("section_id", X.revision(F.col("source_path")).alias("revision"))


@query("select section_id, case " + " ".join(f"when contains(lower({STEM}), '{w}') then '{w}'" for w in X.STATUS_WORDS) + " else '' end as status from doc_sections")
def doc_status(s, d):
    return table(s, d, "doc_sections").select("section_id", X.status(F.col("source_path")).alias("status"))


@query("select doc_id, sha256(text) as sha256, strlen(text)::bigint as size from documents")
def manifest_sha256(s, d):
    return table(s, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.octet_length("text").cast("bigint").alias("size"))


# ---- formats


@query(
    """select doc_id, case when n < 1024 then n::bigint || ' B' when n < 1048576 then printf('%.1f KB', n / 1024.0) when n < 1073741824 then printf('%.1f MB', n / 1048576.0) when n < 1099511627776 then printf('%.1f GB', n / 1073741824.0)
    else printf('%.1f TB', n / 1099511627776.0) end as size from (select doc_id, n_chars * 1031 as n from documents)"""
)
def human_size(s, d):
    return table(s, d, "documents").select("doc_id", fmt.human_size(F.col("n_chars") * 1031).alias("size"))


@query(
    """select doc_id, case when authored_at is null then '—' when x >= 86400 then x // 86400 || 'd ago' when x >= 3600 then x // 3600 || 'h ago' when x >= 60 then x // 60 || 'm ago' else 'just now' end as age
    from (select doc_id, authored_at, floor(epoch(ingested_at))::bigint - floor(epoch(authored_at))::bigint as x from documents)"""
)
def human_age(s, d):
    return table(s, d, "documents").select("doc_id", fmt.human_age(F.col("authored_at"), F.col("ingested_at")).alias("age"))


@query(
    """select event_id, case when x < 60 then x || 's' when x < 3600 then x // 60 || 'm ' || x % 60 || 's' else x // 3600 || 'h ' || (x % 3600) // 60 || 'm' end as eta from (select event_id, trunc(value * 97)::bigint as x from events)"""
)
def fmt_eta(s, d):
    return table(s, d, "events").select("event_id", fmt.fmt_eta(F.col("value") * 97).alias("eta"))


@query("select event_id, case when value < 60 then printf('%.2fs', value) else floor(value / 60)::bigint || printf('m %.0fs', value - 60 * floor(value / 60)) end as elapsed from events")
def fmt_elapsed(s, d):
    return table(s, d, "events").select("event_id", fmt.fmt_elapsed(F.col("value")).alias("elapsed"))


@query(
    """with p as (select input_root, rel_path, string_split(rel_path, '/') as q, len(string_split(rel_path, '/')) as n from walk),
    t as (select input_root, rel_path, q[n] as name, list_concat([rel_path], list_concat(case when n >= 3 then list_transform(generate_series(n - 2, 1, -1), lambda k: array_to_string(q[1:k], '/') || '/…/' || q[n - 1] || '/' || q[n]) else [] end,
    list_concat(case when n >= 2 then ['…/' || q[n - 1] || '/' || q[n]] else [] end, ['…/' || q[n]]))) as tries from p)
    select input_root, rel_path, coalesce(list_filter(tries, lambda x: length(x) <= 24)[1], name[1:24]) as shown from t"""
)
def fmt_path(s, d):
    w = table(s, d, "walk")
    return w.select("input_root", "rel_path", fmt.fmt_path(F.concat_ws("/", "input_root", "rel_path"), F.col("input_root"), 24).alias("shown"))


@query("select project, 'acme/' || project as path, 'acme/' || project as dataset from (select distinct project from documents where project is not null)")
def repo_path(s, d):
    p = table(s, d, "documents").where("project is not null").select("project").distinct()
    git = F.concat(F.lit("https://github.com/acme/"), "project", F.lit(".git"))
    hub = F.concat(F.lit("https://huggingface.co/datasets/acme/"), "project", F.lit("/"))
    return p.select("project", X.repo_path(git).alias("path"), X.dataset_id(hub).alias("dataset"))


@query("select version, sha256(array_to_string(list_sort(list(distinct input_root)), chr(10))) as hash from walk group by version")
def dirs_hash(s, d):
    return table(s, d, "walk").groupBy("version").agg(FS.roots_hash(F.collect_set("input_root")).alias("hash"))


# ---- scan and classification


def _case(pairs: dict[str, str], key: str) -> str:
    return f"case {key} " + " ".join(f"when '{k}' then '{v}'" for k, v in pairs.items()) + " end"


# Names and extensions with their languages, stated again so that the check does not read the registry's own lists.
NAMES_STATED = "CMakeLists.txt cmake, Makefile make, makefile make, GNUmakefile make, Cargo.toml toml, pyproject.toml toml, package.json json, go.mod gomod, build.gradle gradle, build.gradle.kts kotlin, pom.xml xml, conanfile.py conan, conanfile.txt conan"
EXTENSIONS_STATED = (
    "c c, h c, cpp cpp, cc cpp, cxx cpp, hpp cpp, hh cpp, hxx cpp, rs rust, py python, go go, js javascript, mjs javascript, cjs javascript, ts typescript, tsx typescript, mts typescript, cts typescript, java java, cs csharp, rb ruby, swift swift, "
    "kt kotlin, kts kotlin, scala scala, lua lua, php php, sh bash, bash bash, zig zig, ex elixir, exs elixir, hs haskell, lhs haskell, ml ocaml, mli ocaml, erl erlang, hrl erlang, dart dart, r r, R r, f90 fortran, f95 fortran, f03 fortran, f08 fortran, "
    "for fortran, f fortran, v verilog, sv systemverilog, svh systemverilog, vhd vhdl, vhdl vhdl, cmake cmake, mk make, mak make, toml toml, gradle gradle"
)
LANGUAGE = "coalesce({}, {})".format(*(_case(dict(x.split() for x in text.split(", ")), key) for text, key in ((NAMES_STATED, "b"), (EXTENSIONS_STATED, "e"))))


@query(
    f"""with p as (select distinct file_path as path from code_chunks union select distinct source_path from doc_sections), q as (select path, regexp_extract(path, '[^/]*$') as b from p),
    r as (select path, b, regexp_extract(b, '.\\.([^.]+)$', 1) as e from q), t as (select path, e, {LANGUAGE} as language from r) select path, language, case when language is not null then 'code' when e in ('pdf', 'html', 'htm') then 'doc' end as kind from t"""
)
def file_classify(s, d):
    p = table(s, d, "code_chunks").select(F.col("file_path").alias("path")).union(table(s, d, "doc_sections").select("source_path")).distinct()
    return p.select("path", registry.language(F.col("path")).alias("language"), registry.kind(F.col("path")).alias("kind"))


@query()
def code_extract(s, d):
    """Chunks parsed out of the live text of every file (its stored chunks in order)."""
    c = table(s, d, "code_chunks").where("deleted_at is null and code_text is not null").select("version", "file_path", "line_start", "id", "code_text").distinct()
    f = c.groupBy("version", "file_path").agg(F.sort_array(F.collect_list(F.struct("line_start", "id", "code_text"))).alias("t"))
    f = f.select(F.concat_ws("!", "version", "file_path").alias("path"), F.array_join(F.col("t.code_text"), "\n\n").cast("binary").alias("content"), registry.language(F.col("file_path")).alias("language"))
    return code.parse_files(f)


@query(
    f"""with recursive x as (select distinct code_text as t from code_chunks where code_text is not null), l as (select t, string_split(regexp_replace(t, '\\r\\n|\\r', chr(10), 'g'), chr(10)) as lines from x),
    n as (select t, lines, len(lines) as n, list_transform(lines, lambda y: len({_tokens("y")})) as c from l), tot as (select t, lines, n, list_transform(generate_series(0, n), lambda i: coalesce(list_sum(c[1:i]), 0)::int) as s from n),
    r as (select t, lines, n, s, 0 as i, 0 as a, case when s[n + 1] <= 512 then n else least(n, list_filter(generate_series(1, n), lambda j: s[j + 1] >= 512 or j = n)[1]) end as b from tot union all
    select t, lines, n, s, i + 1, a2, least(n, list_filter(generate_series(a2 + 1, n), lambda j: s[j + 1] >= s[a2 + 1] + 512 or j = n)[1]) from
    (select *, greatest(coalesce(list_max(list_filter(generate_series(a, b - 1), lambda j: s[j + 1] <= s[b + 1] - 64)), a - 1), a + 1) as a2 from r where b < n)),
    k as (select t, count(*) as parts from r group by t)
    select version, id, case when parts > 1 then symbol_name || '#' || i else symbol_name end as symbol_name, line_start + coalesce(a, 0) as line_start, line_start + coalesce(b, 1) - 1 as line_end, coalesce(i, 0)::int as chunk_index,
    case when parts > 1 then array_to_string(lines[a + 1:b], chr(10)) else code_text end as code_text from code_chunks left join r on r.t = code_text left join k on k.t = code_text"""
)
def code_split(s, d):
    c = table(s, d, "code_chunks").select("version", "id", "symbol_name", "line_start", "line_end", "chunk_index", "code_text")
    return code.split_chunks(c)


# ---- vectors


def _first(df: DataFrame, ident: str, dim: int) -> list[float]:
    """The usable vector with the lowest id (one row to the driver)."""
    ok = df.where(F.size("embedding") == dim).where(~F.exists("embedding", F.isnan) & F.exists("embedding", lambda x: x != 0))
    return list(ok.orderBy(ident).select("embedding").first()[0])


KNN = """with q as (select embedding as e from embeddings order by vec_id limit 1), s as (select vec_id, label, list_cosine_similarity(embedding::double[], e::double[]) as c from embeddings, q)
select vec_id, label, round(greatest(0, c), 4) as score from s order by c desc, vec_id limit 10"""


@query(KNN)
def knn_code(s, d):
    e = table(s, d, "embeddings")
    return retrieval.knn(e, _first(e, "vec_id", 64), 10, tie="vec_id").select("vec_id", "label", "score")


@query(
    """with q as (select embedding as e from embeddings order by vec_id limit 1), s as (select vec_id, list_cosine_similarity(embedding::double[], e::double[]) as c from embeddings, q),
    t as (select * from s order by c desc, vec_id limit 10) select vec_id, lang, source, round(greatest(0, c), 4) as score, replace(substring(text, 1, 400), chr(10), ' ') as snippet from t join documents on vec_id = doc_id"""
)
def knn_docs(s, d):
    e = table(s, d, "embeddings").select("vec_id", "embedding")
    top = retrieval.knn(e, _first(e, "vec_id", 64), 10, tie="vec_id")
    doc = table(s, d, "documents")
    return retrieval.with_payload(top, doc, ["vec_id"], ["doc_id"]).select("vec_id", "lang", "source", "score", X.snippet(F.col("text"), 400).alias("snippet"))


@query("select v.version, v.chunk_id, c.symbol_name, c.file_path, c.line_start from (select distinct version, chunk_id from vec_code) v join (select distinct version, id, symbol_name, file_path, line_start from code_chunks) c on v.version = c.version and v.chunk_id = c.id")
def vec_payload_join(s, d):
    v = table(s, d, "vec_code").select("version", "chunk_id").distinct()
    c = table(s, d, "code_chunks").select(F.col("version").alias("v2"), "id", "symbol_name", "file_path", "line_start").distinct()
    return retrieval.with_payload(v, c, ["version", "chunk_id"], ["v2", "id"]).select("version", "chunk_id", "symbol_name", "file_path", "line_start")


@query("select vec_id, round(list_sum(list_transform(embedding, lambda x: x::double * 3 / greatest(sqrt(n), 1e-9))), 4) as total from (select *, list_sum(list_transform(embedding, lambda x: (x::double * 3) * (x::double * 3))) as n from embeddings)")
def l2_normalize(s, d):
    e = table(s, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 3).alias("e"))
    return e.select("vec_id", F.round(F.aggregate(V.l2_normalize(F.col("e")), F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


FAN = f"""with v as (select distinct version, chunk_id, embedding from vec_code where {USABLE.format(384)}), q as (select embedding as e from v order by chunk_id limit 1),
s as (select version, chunk_id, list_cosine_similarity(embedding::double[], e::double[]) as c from v, q), r as (select *, row_number() over (partition by version order by c desc, chunk_id) as rank from s)"""


def _fan(s, d, k=10):
    v = table(s, d, "vec_code").select("version", "chunk_id", "embedding").where(F.size("embedding") == 384).distinct()
    return retrieval.fanout(v, _first(v, "chunk_id", 384), k)


@query(FAN + " select version, chunk_id, rank::int as rank, round(greatest(0, c), 4) as score from r where rank <= 10")
def fanout_code(s, d):
    return _fan(s, d).select("version", "chunk_id", "rank", V.similarity(F.col("cosine")).alias("score"))


@query(
    """with q as (select embedding as e from embeddings order by vec_id limit 1), s as (select coalesce(source, '?') as version, vec_id, list_cosine_similarity(embedding::double[], e::double[]) as c from embeddings join documents on vec_id = doc_id, q),
    r as (select *, row_number() over (partition by version order by c desc, vec_id) as rank from s) select version, vec_id, rank::int as rank, round(greatest(0, c), 4) as score from r where rank <= 10"""
)
def fanout_docs(s, d):
    e = table(s, d, "embeddings").select("vec_id", "embedding")
    j = retrieval.with_payload(e, table(s, d, "documents").select("doc_id", X.nonempty(F.col("source"), "?").alias("version")), ["vec_id"], ["doc_id"])
    return retrieval.fanout(j, _first(e, "vec_id", 64), 10, tie="vec_id").select("version", "vec_id", "rank", V.similarity(F.col("cosine")).alias("score"))


@query(
    FAN
    + """, h as (select r.version, chunk_id, c, round(greatest(0, c), 4) as score, file_path, line_start from r join (select distinct version, id, file_path, line_start from code_chunks) p on r.version = p.version and chunk_id = id where rank <= 10),
    m as (select *, row_number() over (partition by file_path, line_start order by score desc, version, c desc, chunk_id) as n from h) select version, chunk_id, file_path, line_start, score from m where n = 1 order by score desc, version, c desc, chunk_id limit 10"""
)
def merge_code(s, d):
    hits = _fan(s, d).withColumn("score", V.similarity(F.col("cosine")))
    c = table(s, d, "code_chunks").select(F.col("version").alias("v2"), "id", "file_path", "line_start").distinct()
    rows = retrieval.with_payload(hits, c, ["version", "chunk_id"], ["v2", "id"])
    out = retrieval.merge(rows, ["file_path", "line_start"], [F.asc("version"), F.desc("cosine"), F.asc("chunk_id")], 10)
    return out.select("version", "chunk_id", "file_path", "line_start", "score")


@query(
    """with q as (select embedding as e from embeddings order by vec_id limit 1), s as (select coalesce(source, '?') as version, coalesce(project, '?') as project, vec_id, list_cosine_similarity(embedding::double[], e::double[]) as c
    from embeddings join documents on vec_id = doc_id, q), r as (select *, row_number() over (partition by version order by c desc, vec_id) as rank, round(greatest(0, c), 4) as score from s),
    m as (select *, row_number() over (partition by project order by score desc, version, c desc, vec_id) as n from r where rank <= 10) select version, project, vec_id, score from m where n = 1 order by score desc, version, c desc, vec_id limit 10"""
)
def merge_docs(s, d):
    e = table(s, d, "embeddings").select("vec_id", "embedding")
    doc = table(s, d, "documents").select("doc_id", X.nonempty(F.col("source"), "?").alias("version"), X.nonempty(F.col("project"), "?").alias("project"))
    hits = retrieval.fanout(retrieval.with_payload(e, doc, ["vec_id"], ["doc_id"]), _first(e, "vec_id", 64), 10, tie="vec_id").withColumn("score", V.similarity(F.col("cosine")))
    return retrieval.merge(hits, ["project"], [F.asc("version"), F.desc("cosine"), F.asc("vec_id")], 10).select("version", "project", "vec_id", "score")


@query()
def embed_hash(s, d):
    e = table(s, d, "doc_sections").select("section_id", "content").distinct()
    return e.select("section_id", embedding.embed(F.col("content")).alias("embedding"))


# ---- symbols

NAME = "(select min(name) from symbols)"


@query(f"select version, id, name, type, file_path, line_number from symbols where name = {NAME}")
def symbol_lookup(s, d):
    t = table(s, d, "symbols")
    return symbols.lookup(t, t.agg(F.min("name")).first()[0]).select("version", "id", "name", "type", "file_path", "line_number")


@query("select version, id, name from symbols where translate(name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') like '%ma_k%'")
def symbol_like(s, d):
    return symbols.like(table(s, d, "symbols"), "Ma_k").select("version", "id", "name")


SCOPE = "(select version, row_number() over (order by version) as pos from (select distinct version from symbols))"


def _scope(df: DataFrame) -> DataFrame:
    """All versions in order of name: a few rows, numbered on the driver."""
    names = [r[0] for r in df.select("version").distinct().orderBy("version").collect()]
    return df.sparkSession.createDataFrame(list(enumerate(names, 1)), "pos int, version string")


@query(
    f"""with r as (select s.name, s.type, s.file_path, s.version, row_number() over (partition by s.name order by pos, s.id) as n from symbols s join {SCOPE} a on s.version = a.version
    where translate(s.name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') like '%e%') select name, type, file_path, version from r where n = 1 order by name limit 200"""
)
def list_symbols(s, d):
    t = table(s, d, "symbols")
    return symbols.listing(t, _scope(t), "e", 200).select("name", "type", "file_path", "version")


@query(
    f"""with r as (select s.name, s.version, s.id, row_number() over (partition by s.name order by pos, s.loaded_at desc, s.id) as n from symbols s join {SCOPE} a on s.version = a.version) select name, version, id from r where n = 1"""
)
def symbol_first_db(s, d):
    t = table(s, d, "symbols")
    return symbols.first_version(t, _scope(t)).select("name", "version", "id")


@query("with r as (select version, name, id, chunk_id, row_number() over (partition by version, name order by loaded_at desc, id desc, chunk_id desc nulls last) as n from symbols) select version, name, id, chunk_id from r where n = 1")
def symbol_upsert(s, d):
    t = table(s, d, "symbols")
    return symbols.last_per_key(t, ["version", "name"], [F.desc("loaded_at"), F.desc("id"), F.desc_nulls_last("chunk_id")]).select("version", "name", "id", "chunk_id")


@query("select distinct s.version, s.name, s.id, c.id as chunk_id, c.line_start, c.line_end from symbols s join code_chunks c on s.version = c.version and s.chunk_id = c.id")
def symbol_chunk_join(s, d):
    t = table(s, d, "symbols").select("version", "name", "id", "chunk_id").distinct()
    c = table(s, d, "code_chunks").select("version", F.col("id").alias("chunk_id"), "line_start", "line_end").distinct()
    return t.join(c, ["version", "chunk_id"]).select("version", "name", "id", "chunk_id", "line_start", "line_end").distinct()


@query("select version, id, name from symbols where regexp_matches(name, '(?is)r.*g.*t')")
def fuzzy_match(s, d):
    return table(s, d, "symbols").where(X.subsequence(F.col("name"), "rgt")).select("version", "id", "name")


@query(
    """with p as (select version, symbol_name, max(nullif(parent_name, '')) as parent from code_chunks group by all), n as (select distinct version, symbol_name from code_chunks)
    select p.version, p.symbol_name as name, n.symbol_name as parent from p left join n on p.version = n.version and p.parent = n.symbol_name and p.parent <> p.symbol_name"""
)
def symbol_tree(s, d):
    c = table(s, d, "code_chunks").groupBy("version", F.col("symbol_name").alias("name")).agg(F.max(F.nullif("parent_name", F.lit(""))).alias("parent"))
    return trees.symbol_tree(c)


# ---- counts


@query("select 'code_chunks' as t, count(*)::bigint as n from code_chunks union all select 'symbols', count(*) from symbols union all select 'doc_sections', count(*) from doc_sections")
def row_counts(s, d):
    one = lambda t: table(s, d, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("t"), "n")
    return one("code_chunks").unionByName(one("symbols")).unionByName(one("doc_sections"))


@query("select coalesce(nullif(language, ''), 'unknown') as language, count(*)::bigint as n from code_chunks group by 1 order by n desc, language")
def lang_counts(s, d):
    return stats.count_by(table(s, d, "code_chunks"), "language", "unknown", "language").orderBy(F.desc("n"), "language")


@query("select coalesce(nullif(type, ''), 'other') as type, count(*)::bigint as n from symbols group by 1 order by n desc, type")
def type_counts(s, d):
    return stats.count_by(table(s, d, "symbols"), "type", "other", "type").orderBy(F.desc("n"), "type")


LANG_PCT = "with c as (select version, coalesce(nullif(language, ''), 'unknown') as language, count(*) as n from code_chunks group by 1, 2), p as (select version, language, n::bigint as n, 100.0 * n / sum(n) over (partition by version) as pct from c)"


def _pct(s, d):
    return stats.share(stats.count_by(table(s, d, "code_chunks"), "language", "unknown", "language", by=["version"]), ["version"])


@query(LANG_PCT + " select version, language, n, round(pct, 4) as pct from p")
def lang_pct(s, d):
    return _pct(s, d).select("version", "language", "n", F.round("pct", 4).alias("pct"))


@query(LANG_PCT + ", r as (select *, row_number() over (partition by version order by n desc, language) as rank from p) select version, language, n, rank::int as rank from r where rank <= 3")
def top3_lang(s, d):
    return stats.top_per(stats.count_by(table(s, d, "code_chunks"), "language", "unknown", "language", by=["version"]), ["version"], "language", 3)


@query("select count(distinct source_path)::bigint as docs from doc_sections")
def distinct_docs(s, d):
    return table(s, d, "doc_sections").agg(F.countDistinct("source_path").alias("docs"))


@query("select coalesce(sum(word_count), 0)::bigint as total_words from doc_sections")
def total_words(s, d):
    return table(s, d, "doc_sections").agg(F.coalesce(F.sum(F.col("word_count").cast("bigint")), F.lit(0)).alias("total_words"))


@query(
    """with c as (select version, count(*) as chunks from code_chunks group by 1), s as (select version, count(*) as symbols from symbols group by 1),
    d as (select version, count(*) as sections, count(distinct source_path) as docs, coalesce(sum(word_count), 0) as total_words from doc_sections group by 1)
    select version, coalesce(chunks, 0)::bigint as chunks, coalesce(symbols, 0)::bigint as symbols, coalesce(sections, 0)::bigint as sections, coalesce(docs, 0)::bigint as docs, coalesce(total_words, 0)::bigint as total_words
    from c full join s using (version) full join d using (version)"""
)
def version_stats(s, d):
    return stats.version_stats(table(s, d, "code_chunks"), table(s, d, "symbols"), table(s, d, "doc_sections"))


# ---- deltas and diffs

LATEST = """l as (select version, input_root, rel_path, max_by(lower(sha256), (run_id, written_at, lower(sha256))) as sha, max_by(mtime, (run_id, written_at, lower(sha256), mtime)) as mtime from file_manifest
where run_id in (select run_id from build_runs where run_status = 'ok') group by all)"""
WALK = "w as (select version, input_root, rel_path, max(mtime) as mtime, max(lower(sha256)) as sha from walk group by all)"


def _latest(s, d):
    return delta.latest_manifest(table(s, d, "file_manifest"), table(s, d, "build_runs"))


@query(
    f"""with {LATEST}, {WALK} select version, input_root, rel_path, case when l.version is null then 'add' when w.version is null then 'delete' when l.mtime = w.mtime then 'unchanged'
    when l.sha is not distinct from w.sha then case when l.mtime is not distinct from w.mtime then 'unchanged' else 'touch' end else 'replace' end as action from l full join w using (version, input_root, rel_path)"""
)
def manifest_delta(s, d):
    return delta.file_delta(_latest(s, d), table(s, d, "walk"))


@query(f"with {LATEST}, r as (select min(input_root) as one from walk) select version, input_root, count(*)::bigint as files from l where not exists (from walk, r where walk.version = l.version and walk.input_root = l.input_root and input_root <> one) group by all")
def dropped_roots(s, d):
    """Roots of the manifest after the first root of the walk has gone."""
    walk = table(s, d, "walk")
    return delta.dropped_roots(_latest(s, d), walk.join(walk.agg(F.min("input_root").alias("input_root")), "input_root", "left_anti"))


def _two(df: DataFrame) -> tuple[str, str]:
    return tuple(df.agg(F.min("version"), F.max("version")).first())


TWO = "v as (select min(version) as v1, max(version) as v2 from {})"


@query(
    f"""with {LATEST}, {TWO.format("file_manifest")}, a as (select rel_path, sha from l, v where version = v1), b as (select rel_path, sha from l, v where version = v2), j as (select rel_path, case when a.rel_path is null then 'added'
    when b.rel_path is null then 'removed' when a.sha is distinct from b.sha then 'changed' end as change from a full join b using (rel_path)) select rel_path, change from j where change is not null"""
)
def file_diff(s, d):
    return delta.file_diff(_latest(s, d), *_two(table(s, d, "file_manifest")))


@query(
    f"""with {TWO.format("symbols")}, k as (select version, name, type, file_path, row_number() over (partition by version, name order by loaded_at desc, id desc, file_path desc) as n from symbols), u as (select * from k where n = 1),
    x as (select u.*, case when version = v2 then 'added' else 'removed' end as change from u, v where (version = v2 and name not in (select name from u, v where version = v1)) or (version = v1 and name not in (select name from u, v where version = v2))),
    p as (select version, symbol_name, max(parent_name) as parent from code_chunks where parent_name <> '' group by all) select x.name, x.change, x.type, x.file_path, p.parent from x left join p on p.version = x.version and p.symbol_name = x.name"""
)
def symbol_diff(s, d):
    t = table(s, d, "symbols")
    return delta.symbol_diff(t, table(s, d, "code_chunks"), *_two(t))


@query(
    LANG_PCT
    + f""", {TWO.format("code_chunks")}, a as (select language, pct as before from p, v where version = v1), b as (select language, pct as after from p, v where version = v2)
    select language, round(coalesce(before, 0), 1) as before, round(coalesce(after, 0), 1) as after from a full join b using (language)"""
)
def lang_shift(s, d):
    return delta.lang_shift(_pct(s, d), *_two(table(s, d, "code_chunks")))


@query(
    """with l as (select distinct version from code_chunks), r as (select distinct version from build_runs where run_status = 'ok')
    select version as name, case when l.version is not null and r.version is not null then 'local+remote' when l.version is not null then 'local' else 'remote' end as location from l full join r using (version)"""
)
def merge_versions(s, d):
    local = table(s, d, "code_chunks").select(F.col("version").alias("name")).distinct()
    remote = table(s, d, "build_runs").where("run_status = 'ok'").select(F.col("version").alias("name")).distinct()
    return scope.merge_listing(local, remote)


@query(f"with {LATEST}, {WALK} select version, input_root, rel_path, w.sha is null as missing from l left join w using (version, input_root, rel_path) where l.sha is distinct from w.sha")
def checksum_verify(s, d):
    w = table(s, d, "walk").groupBy(*delta.KEY).agg(F.max(F.lower("sha256")).alias("sha256"))
    return delta.checksum_mismatches(_latest(s, d), w, delta.KEY)


# ---- scope and trees

ACTIVE = "a as (select version, row_number() over (order by version)::int as pos from (select distinct version from build_runs)), s as (select version, row_number() over (order by version desc)::int as pos from (select distinct version from build_runs where run_status = 'failed'))"


def _scopes(s, d):
    runs = table(s, d, "build_runs")
    session = [r[0] for r in runs.where("run_status = 'failed'").select("version").distinct().orderBy(F.desc("version")).collect()]
    return _scope(runs), s.createDataFrame(list(enumerate(session, 1)), "pos int, version string")


@query(f"with {ACTIVE} select s.pos, s.version from s where version in (select version from a)")
def scope_semi(s, d):
    return scope.effective(*_scopes(s, d))


@query(f"with {ACTIVE} select a.pos, a.version from a where version not in (select version from s)")
def scope_anti(s, d):
    return scope.excluded(*_scopes(s, d))


NODES = """p as (select distinct list_filter(string_split(file_path, '/'), lambda x: x <> '') as p from code_chunks), r as (select p, unnest(generate_series(1, len(p))) as n from p),
t as (select array_to_string(p[1:n], '/') as node, array_to_string(p[1:n-1], '/') as parent, n::int as depth, count(*)::bigint as files from r group by all)"""


def _nodes(s, d):
    return trees.path_nodes(table(s, d, "code_chunks").select(F.col("file_path").alias("path")))


@query(f"with {NODES} select node, parent, depth, files from t")
def path_tree(s, d):
    return _nodes(s, d)


@query(
    f"""with {NODES}, h as (select node from t where regexp_matches(regexp_extract(node, '[^/]*$'), '(?is)q.*u.*e')), k as (select distinct array_to_string(string_split(node, '/')[1:n], '/') as node from (select node, unnest(generate_series(1, len(string_split(node, '/')))) as n from h))
    select node, parent, depth, files from t where node in (select node from k)"""
)
def tree_filter(s, d):
    return trees.filter_tree(_nodes(s, d), "que")


# ---- build telemetry

FILES = "f as (select file_path as path, coalesce(max(nullif(language, '')), 'unknown') as language, count(*)::bigint as chunks, sum(line_end - line_start + 1) / 1000.0 as elapsed, count(nullif(language, '')) = 0 as skipped from code_chunks group by 1)"


def _files(s, d):
    c, lang = table(s, d, "code_chunks"), F.nullif("language", F.lit(""))
    return c.groupBy(F.col("file_path").alias("path")).agg(
        F.coalesce(F.max(lang), F.lit("unknown")).alias("language"), F.count(F.lit(1)).alias("chunks"), (F.sum(F.col("line_end") - F.col("line_start") + 1) / F.lit(1000.0)).alias("elapsed"), (F.count(lang) == 0).alias("skipped")
    ).withColumn("skip_reason", F.when(F.col("skipped"), "no language"))


@query(f"with {FILES} select language, count(*)::bigint as files, sum(chunks)::bigint as chunks, round(sum(elapsed), 4) as elapsed, round(avg(chunks), 6) as avg_chunks from f group by 1")
def report_by_lang(s, d):
    return reports.by_language(_files(s, d))


@query(f"with {FILES} select count(*)::bigint as files, count_if(not skipped)::bigint as done, count_if(skipped)::bigint as skipped, coalesce(sum(chunks) filter (not skipped), 0)::bigint as chunks from f")
def report_totals(s, d):
    return reports.totals(_files(s, d))


@query(f"with {FILES} select path, 'no language' as reason from f where skipped union all select file_path, 'empty text' from (select file_path from code_chunks group by 1 having min(coalesce(length(code_text), 0)) = 0)")
def report_skipped(s, d):
    bad = table(s, d, "code_chunks").groupBy(F.col("file_path").alias("path")).agg(F.min(F.coalesce(F.length("code_text"), F.lit(0))).alias("n")).where("n = 0").withColumn("reason", F.lit("empty text"))
    return reports.skipped(_files(s, d), bad)


@query(
    """select user_id, ts, event_id, case when row_number() over w >= 2 then round(sum(value) over f / sum(value + 1) over f, 6) end as rate from events
    window w as (partition by user_id order by ts, event_id), f as (partition by user_id order by ts, event_id rows between 19 preceding and current row)"""
)
def rolling_rate(s, d):
    e = table(s, d, "events").select("user_id", "ts", "event_id", "value", (F.col("value") + 1).alias("sec"))
    return reports.rolling_rate(e, "user_id", ["ts", "event_id"], "value", "sec")


@query(
    """with f as (select version, file_path, count(*)::bigint as chunks from code_chunks group by all), b as (select *, sum(chunks) over (partition by version order by file_path)::bigint as boundary from f) select version, file_path, chunks, boundary, boundary <= 100 as complete from b"""
)
def checkpoint_boundary(s, d):
    f = table(s, d, "code_chunks").groupBy("version", "file_path").agg(F.count(F.lit(1)).alias("chunks"))
    return reports.complete_files(f, "version", ["file_path"], "chunks", 100)


@query(
    f"""with {LATEST}, {WALK}, d as (select version, count(*) as done from l group by 1), t as (select version, count(*) as total from w group by 1)
    select version, coalesce(done, 0)::bigint as done, coalesce(total, 0)::bigint as total, (100 * coalesce(done, 0) // greatest(1, coalesce(total, 0)))::bigint as pct from d full join t using (version)"""
)
def resume_progress(s, d):
    done = _latest(s, d).groupBy("version").agg(F.count(F.lit(1)).alias("done"))
    total = table(s, d, "walk").select(*delta.KEY).distinct().groupBy("version").agg(F.count(F.lit(1)).alias("total"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return done.join(total, "version", "full_outer").select("version", z("done"), z("total")).withColumn("pct", reports.progress(F.col("done"), F.col("total")))


@query("select event_type, (list_sort(list(value)))[count(*) // 2 + 1] as median from events where value is not null group by 1")
def upper_median(s, d):
    return reports.upper_median(table(s, d, "events"), ["event_type"], "value")


SPACES = "[ \\t\\n\\x0b\\f\\r]"
NUMBER = "coalesce(try_cast(nullif(regexp_extract(trim(title), '{}', {}), '') as int), 0)"
SECTIONS = """h as (select *, count(*) filter (where head) over w as ord from n window w as (partition by doc order by {order} rows unbounded preceding)),
m as (select doc, ord, any_value(title) as title, any_value({start}) as start from (select *, text as title from h where head) group by doc, ord),
c as (select doc, ord, title, start, {chapter} as c, {section} as s, regexp_extract(trim(title), '{number}', 3) as subsection from m),
g as (select *, last_value(case when {own} then c end ignore nulls) over (partition by doc order by ord rows unbounded preceding) as chapter from c),
b as (select doc, ord, trim(regexp_replace(string_agg(text, ' ' order by {order}), '{spaces}+', ' ', 'g')) as content, max({start}) as last from h where not head group by doc, ord)"""


def _sections(order: str, own: str, start: str = "0") -> str:
    return SECTIONS.format(order=order, own=own, start=start, spaces=SPACES, number=X.HEADING, chapter=NUMBER.format(X.HEADING, 1), section=NUMBER.format(X.HEADING, 2))


@query(
    f"""with t as (select distinct source_path, section_id, title, content, replace(replace(coalesce(title, ''), '&', '&amp;'), '<', '&lt;') || '</h2>' || replace(replace(content, '&', '&amp;'), '<', '&lt;') as k from doc_sections where content is not null),
    n as (select source_path as doc, section_id, k, 0 as part, true as head, trim(title) as text from t where trim(coalesce(title, '')) <> '' union all
    select source_path, section_id, k, 1, false, trim(regexp_replace(content, '{SPACES}+', ' ', 'g')) from t where trim(regexp_replace(content, '{SPACES}+', ' ', 'g')) <> ''),
    {_sections("section_id, k, part", "c > 0")}
    select b.doc, b.ord::int as ord, coalesce(chapter, 0)::int as chapter, coalesce(s, 0)::int as section, coalesce(subsection, '') as subsection, coalesce(title, '') as title, content, '' as page_range from b left join g using (doc, ord) where content <> ''"""
)
def html_sections(s, d):
    """Sections of pages rebuilt from the stored sections of each document."""
    t = table(s, d, "doc_sections").where("content is not null").select("source_path", "section_id", "title", "content").distinct()
    esc = lambda c: F.replace(F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    part = F.concat(F.lit("<h2>"), esc("title"), F.lit("</h2><div><p>"), esc("content"), F.lit("</p></div>"))
    p = t.select("source_path", "section_id", part.alias("h")).groupBy("source_path").agg(F.sort_array(F.collect_list(F.struct("section_id", "h"))).alias("x"))
    p = p.select("source_path", F.concat(F.lit("<html><body><nav><p>menu</p></nav>"), F.array_join(F.col("x.h"), ""), F.lit("</body></html>")).alias("html"))
    return documents.html_sections(documents.html_nodes(p, "source_path", "html"))


@query(
    f"""with t as (select source_path as doc, section_id::int as page, max(title) as title, max(content) as content from doc_sections where content is not null group by all),
    z as (select doc, page, 0 as line, title as text, 14.0 as size from t union all select doc, page, generate_subscripts(string_split(regexp_replace(content, '\\.{SPACES}', '.' || chr(1), 'g'), chr(1)), 1), unnest(string_split(regexp_replace(content, '\\.{SPACES}', '.' || chr(1), 'g'), chr(1))), 10.0 from t),
    y as (select doc, page, line, trim(text) as text, size from z where trim(text) <> ''), med as (select doc, list_sort(list(size))[(count(*) // 2 + 1)::int] as m from y group by doc),
    n as (select doc, page, line, text, size / m >= 1.4 as head from y join med using (doc)),
    {_sections("page, line", "true", "page")}
    select b.doc, b.ord::int as ord, coalesce(chapter, 0)::int as chapter, 0 as section, coalesce(subsection, '') as subsection, coalesce(title, '') as title, content, coalesce(start, 1) || '-' || last as page_range from b left join g using (doc, ord) where content <> ''"""
)
def pdf_sections(s, d):
    """Sections of spans made of each document's titles (large) and lines."""
    t = table(s, d, "doc_sections").where("content is not null").groupBy("source_path", "section_id").agg(F.max("title").alias("title"), F.max("content").alias("content"))
    head = t.select(F.col("source_path").alias("doc"), F.col("section_id").cast("int").alias("page"), F.lit(0).alias("block"), F.lit(0).alias("line"), F.lit(0).alias("span"), F.col("title").alias("text"), F.lit(14.0).alias("size"))
    body = t.select(F.col("source_path").alias("doc"), F.col("section_id").cast("int").alias("page"), F.lit(1).alias("block"), F.posexplode(F.split("content", r"(?<=\.)\s")).alias("line", "text"), F.lit(0).alias("span"), F.lit(10.0).alias("size"))
    return documents.pdf_sections(head.unionByName(body))


# ---- references without records (problem 4) and incremental runs (problem 6)

LIVE = "not exists (from code_chunks c where c.version is not distinct from x.version and c.id = x.chunk_id and c.deleted_at is null)"
ORPHAN = f"""o as (select distinct 'symbols' as child_table, x.id as child_id, strftime(x.loaded_at at time zone 'UTC', '%Y-%m') as load_month, x.version, x.chunk_id from symbols x where x.chunk_id is not null and {LIVE}
union select distinct 'vec_code', x.chunk_id, strftime(x.loaded_at at time zone 'UTC', '%Y-%m'), x.version, x.chunk_id from vec_code x where x.chunk_id is not null and {LIVE})"""


def _orphans(s, d):
    c = table(s, d, "code_chunks").select("version", "id", "deleted_at")
    sym = table(s, d, "symbols").select("version", "id", "chunk_id", "loaded_at")
    vec = table(s, d, "vec_code").select("version", "chunk_id", "loaded_at")
    counts = references.merge_counts(references.existence_deltas(c), references.reference_deltas(sym), references.reference_deltas(vec))
    rows = references.child_rows(sym, "symbols", "id").unionByName(references.child_rows(vec, "vec_code", "chunk_id"))
    return references.orphans(rows, references.orphan_keys(counts))


@query(f"with {ORPHAN} select distinct child_table, child_id, load_month from o")
def p4_found(s, d):
    return _orphans(s, d).select("child_table", "child_id", "load_month").distinct()


@query(f"with {ORPHAN} select distinct child_table, child_id, load_month from o")
def p4_ledger(s, d):
    """The same orphans from kept counts: the tables arrive as deltas of three
    periods, children before parents, and one batch comes twice."""
    c = table(s, d, "code_chunks").select("version", "id", "deleted_at", "loaded_at")
    sym = table(s, d, "symbols").select("version", "id", "chunk_id", "loaded_at")
    vec = table(s, d, "vec_code").select("version", "chunk_id", "loaded_at")
    lo, hi = c.agg(F.min(F.unix_timestamp("loaded_at")), F.max(F.unix_timestamp("loaded_at"))).first()
    step = ((hi or 0) - (lo or 0)) / 3 + 1
    period = F.greatest(F.lit(0), F.least(F.lit(2), F.coalesce(F.floor((F.unix_timestamp("loaded_at") - F.lit(lo or 0)) / F.lit(step)), F.lit(0))))
    ledger = references.ReferenceLedger(s, fresh_path(s, "ledger"))
    for n in range(3):
        at = lambda df: df.where(period == n)  # noqa: B023,E731
        ledger.apply(f"children-{n}", references.reference_deltas(at(sym)), references.reference_deltas(at(vec)))
        ledger.apply(f"parents-{n}", references.existence_deltas(at(c)))
        ledger.apply(f"children-{n}", references.reference_deltas(at(sym)))
    rows = references.child_rows(sym, "symbols", "id").unionByName(references.child_rows(vec, "vec_code", "chunk_id"))
    return references.orphans(rows, references.orphan_keys(ledger.counts())).select("child_table", "child_id", "load_month").distinct()


@query(f"with {ORPHAN} select child_table, load_month, count(distinct child_id)::bigint as orphans, count(distinct (version, chunk_id))::bigint as missing_keys from o group by all")
def p4_report(s, d):
    return _orphans(s, d).groupBy("child_table", "load_month").agg(F.countDistinct("child_id").alias("orphans"), F.countDistinct(F.struct("version", "key")).alias("missing_keys"))


@query(
    f"""with {LATEST} select distinct w.version, w.input_root, w.rel_path from walk w left join l on l.version = w.version and l.input_root = w.input_root and l.rel_path = w.rel_path where l.sha is null or w.sha256 is null or lower(w.sha256) <> l.sha"""
)
def p6_found(s, d):
    return increments.IncrementalRun(s, fresh_path(s, "increment")).run(table(s, d, "walk"), table(s, d, "file_manifest"), table(s, d, "build_runs"))


@query(SQL["p6_found"])
def p6_rerun(s, d):
    """The same files after a first run on the log as it was before the later
    half of the runs, a run that failed before its commit, and another one."""
    walk, log, runs = (table(s, d, t) for t in ("walk", "file_manifest", "build_runs"))
    half = runs.agg(F.percentile_approx("run_id", 0.5)).first()[0] or 0
    job = increments.IncrementalRun(s, fresh_path(s, "increment"))
    job.run(walk, log.where(F.col("run_id") <= half), runs)
    try:
        job.run(walk, log, runs, fail_before_commit=True)
    except RuntimeError:
        pass
    return job.run(walk, log, runs)
