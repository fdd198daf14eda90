"""Source files as chunks: extractors by language and the line splitter.

Grammar libraries are not required: Python is read with `ast`, brace languages
by a scanner that knows comments and strings, build files by their line syntax.
An extractor registered under a language replaces the built-in one.
"""

from __future__ import annotations

import ast
import bisect
import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_TOKENS, OVERLAP = 512, 64
LINES = re.compile(r"\r\n|\n|\r")

CHUNK = "symbol_name string, file_path string, file_name string, line_start int, line_end int, code_text string, type string, language string, parent_name string, call_depth int, chunk_index int"

# CMake commands that are kept as chunks.
CMAKE_COMMANDS = frozenset(
    "add_executable add_library add_test add_subdirectory option find_package target_sources target_link_libraries target_include_directories target_compile_definitions "
    "target_compile_options install project cmake_minimum_required include set_property add_custom_target add_custom_command enable_testing add_definitions set".split()
)
# XML elements that are kept as chunks.
XML_TAGS = frozenset("artifactId groupId version dependency plugin module profile execution goal dependencies plugins modules profiles properties build".split())

Found = tuple[str, int, int, str, str | None, int]  # name, first line, last line (1-based), type, parent, depth


def split_lines(text: str, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Line ranges [a, b) of a text above max_tokens: each takes lines until it
    has max_tokens tokens, the next starts so many whole lines back that they
    hold `overlap` tokens, one line further on at least."""
    n = [len(x.split()) for x in LINES.split(text)]
    if sum(n) <= max_tokens:
        return [(0, len(n))]
    total, out, a = [0], [], 0
    for x in n:
        total.append(total[-1] + x)
    while True:
        b = min(len(n), bisect.bisect_left(total, total[a] + max_tokens, a + 1))
        out.append((a, b))
        if b >= len(n):
            return out
        back = bisect.bisect_right(total, total[b] - overlap, a, b) - 1  # the last line whose tail holds the overlap
        a = max(back, a + 1)


def split_chunks(df: DataFrame, text: str = "code_text", name: str = "symbol_name", start: str = "line_start") -> DataFrame:
    """Rows above 512 tokens as numbered parts `name#i` with their own lines;
    others unchanged with chunk_index 0.  Null text stays one row."""
    kind = "array<struct<chunk_index:int,a:int,b:int,t:string>>"

    @F.pandas_udf(kind)
    def run(col: pd.Series) -> pd.Series:
        def one(t):
            if t is None:
                return [(0, 0, 1, None)]
            parts = split_lines(t)
            if len(parts) == 1:
                return [(0, 0, len(LINES.split(t)), t)]
            lines = LINES.split(t)
            return [(i, a, b, "\n".join(lines[a:b])) for i, (a, b) in enumerate(parts)]

        return col.map(lambda t: [dict(zip(("chunk_index", "a", "b", "t"), p)) for p in one(t)])

    # one piece of work, not one per use of the column: the array is exploded at once
    x = df.drop("chunk_index", "line_end").withColumn("_all", run(F.col(text))).withColumn("_n", F.size("_all")).withColumn("_p", F.explode("_all")).drop("_all")
    base = F.col(start)
    return (
        x.withColumn(name, F.when(F.col("_n") > 1, F.concat(F.col(name), F.lit("#"), F.col("_p.chunk_index").cast("string"))).otherwise(F.col(name)))
        .withColumn("chunk_index", F.col("_p.chunk_index")).withColumn("line_end", base + F.col("_p.b") - 1).withColumn(start, base + F.col("_p.a"))
        .withColumn(text, F.col("_p.t")).drop("_p", "_n")
    )


def mask(text: str, line_comment: tuple[str, ...], quotes: str = "\"'`") -> str:
    """The text with comments and string contents blanked, same length."""
    heads = "|".join(map(re.escape, line_comment))
    strings = "|".join(rf"{q}(?:\\.|[^\\{q}\n])*{q}" for q in quotes)
    token = re.compile(rf"/\*.*?\*/|(?:{heads})[^\n]*|{strings}", re.S)
    return token.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


# Patterns of declarations before a brace, per family: (type, pattern, whether to look inside).
BRACES: dict[str, list[tuple[str, str, bool]]] = {
    "c": [("struct", r"\b(?:struct|union)\s+(\w+)\s*$", False), ("struct", r"\btypedef\s+(?:struct|union)\b()\s*\w*\s*$", False), ("enum", r"\benum\s+(\w+)\s*$", False), ("function", r"(?<![\w.>])([A-Za-z_]\w*)\s*\([^;{}]*\)\s*$", False)],
    "cpp": [("module", r"\bnamespace\s+(\w+)\s*$", True), ("class", r"\bclass\s+(\w+)[^;{}()]*$", True), ("struct", r"\b(?:struct|union)\s+(\w+)[^;{}()]*$", True), ("enum", r"\benum\s+(?:class\s+)?(\w+)[^;{}()]*$", False), ("function", r"(~?[A-Za-z_]\w*)\s*\([^;{}]*\)[^;{}()]*$", False)],
    "rust": [("class", r"\bimpl\b(?:<[^{}]*>)?\s*(?:[\w:<>, ]+\s+for\s+)?(\w+)[^;{}]*$", True), ("interface", r"\btrait\s+(\w+)[^;{}]*$", False), ("module", r"\bmod\s+(\w+)\s*$", True), ("struct", r"\bstruct\s+(\w+)[^;{}]*$", False), ("enum", r"\benum\s+(\w+)[^;{}]*$", False), ("macro", r"\bmacro_rules!\s*(\w+)\s*$", False), ("function", r"\bfn\s+(\w+)[^;{}]*$", False)],
    "go": [("struct", r"\btype\s+(\w+)\s+(?:struct|interface)\s*$", False), ("function", r"\bfunc\s+(?:\([^)]*\)\s*)?(\w+)[^;{}]*$", False)],
    "javascript": [("class", r"\bclass\s+(\w+)[^;{}()]*$", True), ("interface", r"\binterface\s+(\w+)[^;{}()]*$", False), ("enum", r"\benum\s+(\w+)\s*$", False), ("function", r"\bfunction\s*\*?\s*(\w+)\s*\([^;{}]*\)[^;{}()]*$", False), ("function", r"(?:^|[;}\n])\s*(?:(?:async|static|get|set|public|private|protected)\s+)*(#?\w+)\s*\([^;{}]*\)(?:\s*:[^;{}()]*)?\s*$", False)],
    "java": [("class", r"\bclass\s+(\w+)[^;{}()]*$", True), ("interface", r"\b(?:interface|protocol|trait)\s+(\w+)[^;{}()]*$", True), ("enum", r"\benum\s+(?:class\s+)?(\w+)[^;{}()]*$", False), ("struct", r"\bstruct\s+(\w+)[^;{}()]*$", True), ("module", r"\b(?:namespace|extension|object)\s+([\w.]+)[^;{}()]*$", True), ("function", r"\b(?:fun|func|def|function)\s+(\w+)[^;{}]*$", False), ("function", r"([A-Za-z_]\w*)\s*\([^;{}]*\)[^;{}()]*$", False)],
}
FAMILY = {"c": "c", "cpp": "cpp", "rust": "rust", "go": "go", "zig": "rust"} | dict.fromkeys(("javascript", "typescript"), "javascript") | dict.fromkeys(("java", "csharp", "swift", "kotlin", "scala", "php", "dart", "gradle", "r"), "java")
NOT_NAMES = frozenset("if for while switch catch return sizeof else do match loop select unsafe".split())
# Line syntax of languages without braces: (type, pattern).
LINE_RULES: dict[str, list[tuple[str, str]]] = {
    "make": [("function", r"^([^\s#:=][^:=#]*?)\s*:(?!=)")], "toml": [("struct", r"^\[+\s*([^\]]+?)\s*\]+")], "gomod": [("module", r"^module\s+(\S+)"), ("constant", r"^require\s+(\S+)")],
    "ruby": [("function", r"^\s*def\s+([\w.?!]+)"), ("class", r"^\s*class\s+(\w+)"), ("module", r"^\s*module\s+(\w+)")], "lua": [("function", r"^\s*(?:local\s+)?function\s+([\w.:]+)")],
    "bash": [("function", r"^\s*(?:function\s+)?(\w+)\s*\(\)")], "elixir": [("function", r"^\s*defp?\s+(\w+)"), ("module", r"^\s*defmodule\s+([\w.]+)")],
    "haskell": [("function", r"^(\w+)\s*::"), ("struct", r"^(?:data|newtype)\s+(\w+)"), ("interface", r"^class\s+(\w+)"), ("type_alias", r"^type\s+(\w+)")],
    "ocaml": [("function", r"^\s*let\s+(?:rec\s+)?(\w+)"), ("struct", r"^\s*type\s+(\w+)"), ("module", r"^\s*module\s+(\w+)")], "erlang": [("function", r"^(\w+)\s*\([^)]*\)\s*->"), ("struct", r"^-record\((\w+)"), ("module", r"^-module\((\w+)")],
    "fortran": [("function", r"(?i)^\s*(?:subroutine|function)\s+(\w+)"), ("module", r"(?i)^\s*module\s+(\w+)"), ("struct", r"(?i)^\s*type\s*(?:::)?\s*(\w+)")],
    "verilog": [("module", r"^\s*module\s+(\w+)"), ("function", r"^\s*(?:function|task)\s+(?:\w+\s+)*(\w+)")], "vhdl": [("module", r"(?i)^\s*(?:entity|package)\s+(\w+)\s+is"), ("class", r"(?i)^\s*architecture\s+(\w+)"), ("function", r"(?i)^\s*(?:function|procedure)\s+(\w+)")],
}
LINE_RULES["systemverilog"] = LINE_RULES["verilog"]


def brace_chunks(text: str, language: str) -> Iterator[Found]:
    rules = [(kind, re.compile(p), inside) for kind, p, inside in BRACES[FAMILY[language]]]
    m = mask(text, ("//", "#") if language in ("php", "r") else ("//",), "\"`" if language == "rust" else "\"'`")
    starts = [0] + [x.end() for x in re.finditer("\n", m)]
    line = lambda at: bisect.bisect_right(starts, at)
    open_at: list[tuple[int, tuple | None, bool]] = []  # head start, (name, type) of a chunk, whether we look inside
    parents: list[str] = []
    head, blind = 0, 0
    if language in ("c", "cpp"):
        for x in re.finditer(r"(?m)^[ \t]*#[ \t]*define[ \t]+(\w+)(?:[^\n\\]|\\\n|\\.)*", m):
            yield x[1], line(x.start()), line(x.end()), "macro", None, 0
    for x in re.finditer(r"[{};]", m):
        c, at = x[0], x.start()
        if c == "{":
            hit = None
            if not blind:
                decl = re.sub(r"(?m)^[ \t]*#[^\n]*", lambda y: " " * len(y[0]), m[head:at])
                for kind, p, inside in rules:
                    if (y := p.search(decl)) and (y[1] or "") not in NOT_NAMES:
                        hit = (y[1] or "", kind, inside, head + len(decl) - len(decl.lstrip()))
                        break
            looks = hit[2] if hit else not open_at and "extern" in m[head:at]
            open_at.append((hit[3] if hit else at, hit[:2] if hit else None, looks))
            if hit and looks:
                parents.append(hit[0])
            blind += not looks
        elif c == "}" and open_at:
            first, hit, looks = open_at.pop()
            blind -= not looks
            if hit and looks:
                parents.pop()
            if hit:
                name = hit[0]
                if not name and (y := re.match(r"\s*(\w+)\s*;", m[x.end() :])):  # typedef of an anonymous struct
                    name = y[1]
                if name:
                    yield name, line(first), line(at), hit[1], parents[-1] if parents else None, len(parents)
        head = x.end()


def python_chunks(text: str) -> Iterator[Found]:
    def walk(body, parent, depth):
        for n in body:
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                cls = isinstance(n, ast.ClassDef)
                yield n.name, n.lineno, n.end_lineno, "class" if cls else "function", parent, depth
                if cls:
                    yield from walk(n.body, n.name, depth + 1)
            else:
                yield from walk([c for c in ast.iter_child_nodes(n) if isinstance(c, (ast.stmt, ast.excepthandler))], parent, depth)

    try:
        yield from walk(ast.parse(text).body, None, 0)
    except (SyntaxError, ValueError, RecursionError):
        for kind, p in (("function", r"^\s*(?:async\s+)?def\s+(\w+)"), ("class", r"^class\s+(\w+)")):
            yield from line_chunks(text, [(kind, p)])


def line_chunks(text: str, rules: list[tuple[str, str]]) -> Iterator[Found]:
    """A matching line starts a chunk that ends before the next match."""
    lines = LINES.split(text)
    hits = [(i, m[1].strip(), kind) for i, x in enumerate(lines) for kind, p in rules if (m := re.match(p, x))]
    for (i, name, kind), nxt in zip(hits, [*hits[1:], (len(lines), "", "")]):
        yield name, i + 1, max(nxt[0], i + 1), kind, None, 0


def cmake_chunks(text: str) -> Iterator[Found]:
    m = re.sub(r"#[^\n]*", lambda y: " " * len(y[0]), text)
    for x in re.finditer(r"(\w+)\s*\(([^()]*(?:\([^()]*\)[^()]*)*)\)", m):
        cmd, args = x[1].lower(), x[2].split()
        kind = {"function": "function", "macro": "macro"}.get(cmd, "constant" if cmd in CMAKE_COMMANDS else None)
        if kind:
            first = args[0].strip('"') if args else ""
            name = first if kind != "constant" else f"{cmd}({first})" if first else cmd
            yield name, text.count("\n", 0, x.start()) + 1, text.count("\n", 0, x.end()) + 1, kind, None, 0


def json_chunks(text: str) -> Iterator[Found]:
    try:
        top = json.loads(text)
    except ValueError:
        return
    for key in top if isinstance(top, dict) else ():
        at = text.find(json.dumps(key))
        if at >= 0:
            row = text.count("\n", 0, at) + 1
            yield key, row, row, "constant", None, 0


def xml_chunks(text: str) -> Iterator[Found]:
    stack: list[tuple[str, int]] = []
    for x in re.finditer(r"<(/?)([A-Za-z_][\w.:-]*)[^<>]*?(/?)>", text):
        row = text.count("\n", 0, x.start()) + 1
        if x[1]:
            while stack:
                tag, first = stack.pop()
                if tag == x[2]:
                    if tag in XML_TAGS:
                        named = [t for t, _ in stack if t in XML_TAGS]
                        yield tag, first, row, "struct", named[-1] if named else None, len(named)
                    break
        elif not x[3]:
            stack.append((x[2], row))


EXTRACTORS: dict[str, Callable[[str], Iterator[Found]]] = {"python": python_chunks, "conan": python_chunks, "cmake": cmake_chunks, "json": json_chunks, "xml": xml_chunks}


def register_extractor(language: str):
    def wrap(f):
        EXTRACTORS[language] = f
        return f

    return wrap


def extract(text: str, language: str) -> list[Found]:
    if language in EXTRACTORS:
        found = EXTRACTORS[language](text)
    elif language in FAMILY:
        found = brace_chunks(text, language)
    else:
        found = line_chunks(text, LINE_RULES.get(language, []))
    return sorted(found, key=lambda f: (f[1], -f[2]))


def parse_files(files: DataFrame, path: str = "path", content: str = "content", language: str = "language") -> DataFrame:
    """Chunks of source files (path, binary content, language); bytes that are
    no UTF-8 are replaced.  Files of no known language yield nothing."""

    def run(batches):
        for pdf in batches:
            out = []
            for p, c, lang in zip(pdf["path"], pdf["content"], pdf["language"]):
                if c is None or lang is None:
                    continue
                text = bytes(c).decode("utf-8", errors="replace")
                lines = LINES.split(text)
                for name, a, b, kind, parent, depth in extract(text, lang):
                    out.append((name, p, p.rsplit("/", 1)[-1], a, b, "\n".join(lines[a - 1 : b]), kind, lang, parent or "", depth, 0))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in CHUNK.split(", ")])

    rows = files.select(F.col(path).alias("path"), F.col(content).alias("content"), F.col(language).alias("language")).mapInPandas(run, CHUNK)
    return split_chunks(rows).select(*[x.split()[0] for x in CHUNK.split(", ")])
