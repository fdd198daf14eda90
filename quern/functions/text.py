"""Text metadata as built-in column expressions (stay in whole-stage codegen).

Null input gives null, except where stated.  All counts are bigint.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that separate tokens (those of str.split).
WHITESPACE = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
TOKEN = f"[^{WHITESPACE}]+"

# Status words in file names, in order of precedence.
STATUS_WORDS = ("released", "approved", "final", "review", "draft", "obsolete")
# Capital words that are no feature tags.
TAG_STOP_WORDS = ("A", "I", "AN", "AT", "BY", "IN", "IS", "IT", "OF", "ON", "OR", "TO", "UP", "BE", "DO", "IF", "NO", "SO", "AS")
# Patterns of tags, figure references, revisions, heading numbers.
TAG = r"(?U)\b([A-Z][A-Z0-9]{1,7})\b"
FIGURE = r"(?i)(?U)\b(?:Figure|Fig\.?|Table)\s+[0-9]+(?:[.\-][0-9]+)*"
REVISION = r"(?i)[_\-\s](?:rev?|ver?|version)\.?\s*([0-9]+[\.0-9]*)"
HEADING = r"^([0-9]+)(?:\.([0-9]+))?(?:\.([0-9]+))?"


def words(text: Column) -> Column:
    """Tokens: maximal runs of characters other than whitespace."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def token_count(text: Column) -> Column:
    return F.when(text.isNotNull(), F.size(words(text)).cast("bigint"))


def snippet(text: Column, width: int) -> Column:
    """The first `width` characters with line breaks as spaces; null gives ''."""
    return F.replace(F.substring(F.coalesce(text, F.lit("")), 1, width), F.lit("\n"), F.lit(" "))


def csv_split(text: Column) -> Column:
    """A comma list as array without empty entries; null gives []."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), ","), lambda x: x != "")


def feature_tags(title: Column, content: Column) -> Column:
    """Sorted distinct capital abbreviations of the title and the first 500
    characters of the content, without stop words; nulls count as ''."""
    both = F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.substring(F.coalesce(content, F.lit("")), 1, 500))
    tags = F.array_distinct(F.regexp_extract_all(both, F.lit(TAG), F.lit(1)))
    return F.array_sort(F.array_except(tags, F.array(*[F.lit(w) for w in TAG_STOP_WORDS])))


def figure_refs(content: Column, limit: int = 20) -> Column:
    """The first `limit` distinct figure and table references of the first
    3000 characters, in order; null gives []."""
    found = F.regexp_extract_all(F.substring(F.coalesce(content, F.lit("")), 1, 3000), F.lit(FIGURE), F.lit(0))
    return F.slice(F.array_distinct(found), 1, limit)


def heading_number(title: Column) -> Column:
    """struct(chapter, section, subsection) of a heading; (0, 0, '') without."""
    t = F.trim(F.coalesce(title, F.lit("")))
    part = lambda i: F.regexp_extract(t, HEADING, i)
    whole = lambda i: F.coalesce(F.try_to_number(F.when(part(i) != "", part(i)), F.lit("999999999")).cast("int"), F.lit(0))
    return F.struct(whole(1).alias("chapter"), whole(2).alias("section"), part(3).alias("subsection"))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    """File name without its last extension (a leading dot is no extension)."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def revision(path: Column) -> Column:
    return F.regexp_extract(stem(path), REVISION, 1)


def status(path: Column) -> Column:
    low, out = F.lower(stem(path)), F.lit("")
    for word in reversed(STATUS_WORDS):
        out = F.when(low.contains(word), F.lit(word)).otherwise(out)
    return F.when(path.isNotNull(), out)


def ascii_fold(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ascii_like(text: Column, pattern: str) -> Column:
    """Substring match in which % and _ are wildcards, letters A-Z match
    either case and there is no escape character."""
    p = pattern.replace("\\", "\\\\")
    return ascii_fold(text).like("%" + "".join(c.lower() if c.isascii() else c for c in p) + "%")


def subsequence(text: Column, query: str) -> Column:
    """Whether all characters of query occur in text in order, in any case."""
    import re

    return text.rlike("(?isu)" + ".*".join(re.escape(c) for c in query)) if query else F.lit(True)


def nonempty(text: Column, default: str) -> Column:
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(default))


def repo_path(url: Column) -> Column:
    """owner/name of a repository address."""
    bare = F.regexp_replace(url, r"\.git$", "")
    return F.when(bare.contains("github.com/"), F.regexp_replace(bare, r"^.*?github\.com/", "")).otherwise(bare)


def dataset_id(url: Column) -> Column:
    """Hub repository id: one known prefix and outer slashes removed."""
    return F.regexp_replace(F.regexp_replace(url, r"^(https://huggingface\.co/datasets/|https://huggingface\.co/|hf://|datasets/)", ""), r"^/+|/+$", "")
