"""Which files are source code, and in which language."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions import text as X

# Languages by file extension.
EXTENSIONS = {
    "c": ("c", "h"), "cpp": ("cpp", "cc", "cxx", "hpp", "hh", "hxx"), "rust": ("rs",), "python": ("py",), "go": ("go",), "javascript": ("js", "mjs", "cjs"), "typescript": ("ts", "tsx", "mts", "cts"),
    "java": ("java",), "csharp": ("cs",), "ruby": ("rb",), "swift": ("swift",), "kotlin": ("kt", "kts"), "scala": ("scala",), "lua": ("lua",), "php": ("php",), "bash": ("sh", "bash"), "zig": ("zig",),
    "elixir": ("ex", "exs"), "haskell": ("hs", "lhs"), "ocaml": ("ml", "mli"), "erlang": ("erl", "hrl"), "dart": ("dart",), "r": ("r", "R"), "fortran": ("f90", "f95", "f03", "f08", "for", "f"),
    "verilog": ("v",), "systemverilog": ("sv", "svh"), "vhdl": ("vhd", "vhdl"), "cmake": ("cmake",), "make": ("mk", "mak"), "toml": ("toml",), "gradle": ("gradle",),
}
# Languages by exact file name; these go before the extension.
FILE_NAMES = {
    "CMakeLists.txt": "cmake", "Makefile": "make", "makefile": "make", "GNUmakefile": "make", "Cargo.toml": "toml", "pyproject.toml": "toml", "package.json": "json", "go.mod": "gomod",
    "build.gradle": "gradle", "build.gradle.kts": "kotlin", "pom.xml": "xml", "conanfile.py": "conan", "conanfile.txt": "conan",
}
DOC_EXTENSIONS = ("pdf", "html", "htm")


def _lookup(pairs: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), key)


def extension(path: Column) -> Column:
    """After the last dot of the file name; '' without."""
    return F.regexp_extract(X.base_name(path), r"(?<=.)\.([^.]+)$", 1)


def language(path: Column) -> Column:
    """Language of a source file, null if it is none.  Case counts."""
    by_ext = {e: lang for lang, es in EXTENSIONS.items() for e in es}
    return F.coalesce(_lookup(FILE_NAMES, X.base_name(path)), _lookup(by_ext, extension(path)))


def kind(path: Column) -> Column:
    return F.when(language(path).isNotNull(), "code").when(extension(path).isin(*DOC_EXTENSIONS), "doc")
