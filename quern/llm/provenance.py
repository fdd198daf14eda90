"""Generated, minified or vendored source files, and data saved as code.

Belief propagation over the directory tree.  Leaves are files with log-evidence
for five labels (handwritten, generated, minified, vendored, blob).  Above them
stand sibling groups (the files of a directory with one extension), then the
directories up to the root; these have a sixth state, mixed, for folders of
unlike things.  Compatibilities say what a parent of each state holds.  Messages
are exact up and down: the tree is cut into blocks of at most `BLOCK` nodes that
tasks work through whole, and what lies above the blocks is cut again.

Evidence is learned from the collection in rounds.  The first propagation starts from public
conventions alone (names of build products, marks that tools must leave by their
own documentation, names of folders) and from statistics of the code.  Each round then
fits, from the beliefs so far: softmax regressions on
lines of head comments, of which the most telling counts, and on file names with
statistics (on bounded samples, `SAMPLE` rows per label and fold, in two folds by
directory, so that no file is judged by a model that saw its own directory); log-odds of directory names (over all directories); the
compatibilities (expected counts over all edges); and how far the code of a file
also stands in other files that are vendored (over all files, never counting the
file itself); and propagates with them.

Nulls: a null path takes no part; null and empty texts carry no evidence.
Repeated rows add nothing but weight within their own file.  A file is judged
by all its rows.  Empty tables give empty results.
"""

from __future__ import annotations

import io
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.session import written

LABELS = ("handwritten", "generated", "minified", "vendored", "blob")
HAND, GEN, MIN, VEN, BLOB, MIXED = range(6)
K = 6
NEVER = -50.0  # log-evidence of a file for the mixed state

# Compatibilities to start from (rows: state of the parent, columns: of the child).
HOLDS = np.array(
    [
        [0.930, 0.020, 0.010, 0.010, 0.015, 0.015],
        [0.060, 0.880, 0.010, 0.010, 0.020, 0.020],
        [0.220, 0.020, 0.700, 0.020, 0.020, 0.020],
        [0.005, 0.005, 0.015, 0.945, 0.010, 0.020],
        [0.350, 0.020, 0.010, 0.010, 0.590, 0.020],
        [0.740, 0.040, 0.030, 0.040, 0.030, 0.120],
    ]
)
ROOT = np.array([0.38, 0.01, 0.01, 0.01, 0.01, 0.58])
FIRM = 400.0  # edges that the stated compatibilities count as when they are fitted

BLOCK = 20_000  # nodes of the tree in one task
SAMPLE, BITS, LEAST = 2000, 16, 3  # rows a label and fold for the regressions; slots of their terms; lines a term must be in
STEPS, DECAY = 80, 0.5
ROUNDS = 2  # of learning after the first propagation
CLIP, TRAITS, LOW, MARGIN = 8.0, 3.0, -0.5, 2.0  # most that notes and that traits may say for a label, least (a missing notice says little), margin
NAMED = 4.0  # most that a learned directory name may say for a label (least: -1)
STRONG, FOLDER = 6.0, 9.0  # an unambiguous convention: of a file name or mark, of a folder
SURE = 0.5  # belief from which a file is an example

# Folders that hold third-party code by the convention of package managers and style guides.
VENDOR_DIRS = r"^(third[_-]?party|3rd[_-]?party|vendor|vendored|node_modules|bower_components|site-packages)$"
# Folders that mostly do.
MAYBE_VENDOR_DIRS = r"^(external|extern|deps|contrib|ext)$"
# Folders for output of tools, ones that mostly are, and those of bundlers.
GEN_DIRS = r"^(generated|__generated__|autogen)$"
MAYBE_GEN_DIRS = r"^gen$"
PACK_DIRS = r"^(dist|bundle|bundles)$"
VERSIONED_DIR = r"^[a-z][a-z0-9_]*-\d+\.\d+(\.\d+)*$"
# File names that compilers of interfaces, parser generators and tool kits write.
GEN_NAMES = re.compile(r"(\.(pb|pb-c|tab|yy|gen|generated|designer|g)\.[a-z]+$|_(pb2|pb2_grpc|gen|autogen|generated|parsetab)\.[a-z]+$|^parsetab\.py$)", re.I)
# File names of minifiers and bundlers.
MIN_NAMES = re.compile(r"(\.min\.[a-z]+$|-min\.[a-z]+$|\.bundle\.[a-z]+$|\.[0-9a-f]{6,}\.(js|css)$)", re.I)
# Marks of generated code that tools document (Go, .NET, phabricator-style, general).
GEN_MARK = re.compile(r"\bcode generated\b[^\n]*\bdo not edit\b|@generated\b|<auto-?generated\b|^\W*auto-?generated\b|\bgenerated\b[^\n]*\b(?:do not|don't) (?:edit|modify)\b|\b(?:do not|don't) (?:edit|modify)\b[^\n]*\bgenerated\b", re.I | re.M)

COMMENT = re.compile(r"/\*.*?\*/|//[^\n]*|^[ \t]*#(?![ \t]*(?:define|include|if|else|endif|line|pragma|ifdef|ifndef|undef))[^\n]*", re.S | re.M)
LITERAL = re.compile(r'"[^"\n]*"|\'[^\'\n]*\'|`[^`]*`|\b0[xX][0-9a-fA-F]+\w?')
QUOTES = ('"', "'", "`")
FILLER = b"0123456789 \t\r\n\f\v,{}()[];:.+-/*"
HEXADECIMAL = FILLER + b"abcdefABCDEFxXuUlL"
BLANKS, TRAILING = b" \t\r\n\f\v", bytes(range(0x80, 0xC0))  # bytes that are no characters of their own
IDENT = re.compile(r"(?<![\w$])[A-Za-z_$][\w$]*")
# identifiers with two digits on end, names of plain types aside
NUMBERED = re.compile(r"(?m)^(?!(?:u?int[0-9]+(?:_t)?|[uif][0-9]+|float[0-9]+)$).*[0-9][0-9]")
TWO_DIGITS = re.compile("[0-9][0-9]")
SHORT = (2).__ge__
STARTS = ("/*", "//", "#", "--", ";", "*", '"""')  # of comment lines
INCLUDE = re.compile(r"#\s*(?:include|import)\b")
WORDY = re.compile(r"\w")
TERM = re.compile(r"[a-z]+|\d[\da-f.]*|[^\w\s]", re.I)

SUMS = ("n", "data", "ids", "short", "numbered", "blank", "dense", "packed", "lines")
FEATURES = "file_path string, " + ", ".join(f"{x} bigint" for x in SUMS) + ", mark int, copy bigint, terms array<int>"


def head(text: str) -> str:
    """The comment lines a text starts with, however many, and blank lines
    between them passed over (until something is included).  Lines without a
    word say nothing and are left out."""
    out, block, included = [], False, False
    for line in io.StringIO(text):
        s = rest = line.strip()
        if not s and included and not block:
            break
        while rest and (block or rest.startswith(STARTS)):
            at = rest.find("*/") if block or rest.startswith("/*") else -1
            block = at < 0 and (block or rest.startswith("/*"))
            rest = rest[at + 2 :].lstrip() if at >= 0 else ""
        s = s[: len(s) - len(rest)].rstrip()
        if WORDY.search(s):
            out.append(s)
        if rest:
            break
        included = included or bool(INCLUDE.match(s))
    return "\n".join(out)


def slot(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)


def _word(w: str, known: dict[str, int] = {}) -> int:  # noqa: B006 (of the worker process)
    n = known.get(w)
    if n is None:
        if len(known) > 200_000:
            known.clear()
        n = known[w] = zlib.crc32(w.encode("utf-8", "surrogatepass"))
    return n


def head_terms(h: str) -> list[int]:
    """Slots of the words and pairs of words of each different head line, -1
    before each line; numbers count as one word, and so does a line's start."""
    lines, mask = {}, (1 << BITS) - 1
    for line in h.split("\n"):
        w = [7, *(_word("0" if x[0].isdigit() else x) for x in TERM.findall(line.lstrip("/*#-; ").lower()))]
        if len(w) > 2:
            one = {x & mask for x in w[1:]}
            one.update(((x * 0x9E3779B1 + y * 0x85EBCA6B) >> 11) & mask for x, y in zip(w, w[1:]))
            lines[tuple(sorted(one))] = None
    return [x for line in lines for x in (-1, *line)]


def name_terms(path: str) -> set[int]:
    base = path.rsplit("/", 1)[-1].lower()
    stem, _, rest = base.partition(".")
    parts = [re.sub(r"\d+", "0", x) for x in re.split(r"[_\-]", stem)]
    rest = re.sub(r"\b[0-9a-f]{6,}\b", "0", rest)
    return {slot("x" + rest), slot(f"h{parts[0]}_" if len(parts) > 1 else "h"), slot(f"t_{parts[-1]}.{rest}" if len(parts) > 1 else "t"), slot(f"u{stem[:1] == '_'}")}


def look(text: str) -> tuple:
    """Evidence of one text: size; characters of long stretches that are data
    only; identifiers, short ones, numbered ones; blanks; characters of densely
    written text; bytes after compression; lines; a documented mark of a tool;
    hash of the code without comments; terms of the head."""
    import xxhash

    n = len(text)
    code = COMMENT.sub(" ", text)
    raw = code.encode("utf-8", "surrogatepass")
    m = len(code)
    data = 0
    # more letters than hexadecimal digits and strings can hold: no data
    if m > 150 and len(raw.translate(None, HEXADECIMAL)) - sum(len(x) for q in QUOTES for x in code.split(q)[1::2]) < 0.2 * m:
        data = n if len(LITERAL.sub("", code).encode("utf-8", "surrogatepass").translate(None, FILLER)) < 0.2 * m else 0
    ids = [] if data else IDENT.findall(code)
    short = sum(map(SHORT, map(len, ids)))
    joined = "\n".join(ids)
    numbered = len(NUMBERED.findall(joined)) if TWO_DIGITS.search(joined) else 0
    squeezed = raw.translate(None, BLANKS)
    blank = n - len(text.encode("utf-8", "surrogatepass").translate(None, BLANKS + TRAILING))
    dense = n if ids and m > 200 and short > 0.45 * len(ids) and blank < 0.1 * n else 0
    h = head(text)
    copy = xxhash.xxh3_64_intdigest(squeezed) - (1 << 63) if len(squeezed) > 100 else None
    return n, data, len(ids), short, numbered, blank, dense, len(zlib.compress(raw, 1)), text.count("\n") + 1, int(bool(GEN_MARK.search(h))), copy, (head_terms(h) or None) if h else None


def chunk_evidence(chunks: DataFrame, path: str, text: str) -> DataFrame:
    names = [x.split()[0] for x in FEATURES.split(", ")]

    def run(batches):
        for pdf in batches:
            out = pd.DataFrame([(p, *look(t)) for p, t in zip(pdf["file_path"], pdf["text"])], columns=names)
            out["copy"] = out["copy"].astype("Int64")
            yield out

    return chunks.select(F.col(path).alias("file_path"), F.coalesce(F.col(text), F.lit("")).alias("text")).where("file_path is not null").mapInPandas(run, FEATURES)


def group_of(path: Column) -> Column:
    """The sibling group of a file: its directory and its extension."""
    full = F.concat(F.lit("/"), F.regexp_replace(path, "^/+", ""))
    ext = F.regexp_replace(F.lower(F.regexp_extract(full, r"[^/]*$", 0)), r"^[^.]*", "")
    return F.concat(F.regexp_replace(full, "[^/]*$", ""), F.lit("*"), F.regexp_replace(ext, "[0-9a-f]{6,}|[0-9]+", "0"))


def file_evidence(chunks: DataFrame) -> DataFrame:
    """One row per file: sums, flags, and as `traits` the slots of its binned
    statistics and of its name."""
    sums = chunks.groupBy("file_path").agg(*[F.sum(x).alias(x) for x in SUMS], F.max("mark").alias("mark"))

    @F.pandas_udf("array<int>")
    def traits(path: pd.Series, x: pd.DataFrame) -> pd.Series:
        ids, n = np.maximum(x["ids"], 1), np.maximum(x["n"], 1)
        bins = {
            "numbered": np.digitize(x["numbered"] / ids, [0.02, 0.06, 0.12, 0.2, 0.35]), "short": np.digitize(x["short"] / ids, [0.1, 0.25, 0.45]), "data": np.digitize(x["data"] / n, [0.1, 0.5, 0.9]),
            "blank": np.digitize(x["blank"] / n, [0.04, 0.1, 0.2, 0.3]), "dense": np.digitize(x["dense"] / n, [0.1, 0.4, 0.8]), "packed": np.digitize(x["packed"] / n, [0.15, 0.25, 0.35, 0.5, 0.7]),
            "wide": np.digitize(x["n"] / np.maximum(x["lines"], 1), [15, 30, 60, 120]),
        }
        own = [[slot(f"s{k}{v[i]}") for k, v in bins.items()] for i in range(len(path))]
        return pd.Series([[-1, *sorted({*s, *name_terms(p)})] for s, p in zip(own, path)], dtype=object)

    return sums.withColumn("traits", traits("file_path", F.struct(*[F.col(x) for x in SUMS])))


def copied(chunks: DataFrame, weights: DataFrame) -> DataFrame:
    """(file_path, copied): the mean over the texts of a file of the chance
    that some other file with that text is vendored; `weights` (file_path, w)
    says how likely each file is.  A file never counts for itself."""
    c = chunks.where("copy is not null").select("file_path", "copy").distinct()
    w = c.join(weights, "file_path").withColumn("not", F.log(1 - F.least("w", F.lit(0.999))))
    by = w.where("w > 0.001").groupBy("copy").agg(F.sum("not").alias("all"))
    others = F.coalesce(1 - F.exp(F.least(F.col("all") - F.when(F.col("w") > 0.001, F.col("not")).otherwise(0.0), F.lit(0.0))), F.lit(0.0))
    return w.join(by, "copy", "left").groupBy("file_path").agg(F.avg(others).alias("copied"))


def unary() -> Column:
    """Log-evidence of a file for each label by conventions, statistics and
    copies, handwritten at 0."""
    z = F.lit(0.0)
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    numbered, data, dense = share("numbered", "ids"), share("data", "n"), share("dense", "n")
    slope = lambda x, mid, steep, top: F.greatest(F.lit(-top), F.least(F.lit(top), (x - mid) * steep))
    base = F.regexp_extract("file_path", "[^/]*$", 0)
    gen = F.when(F.col("ids") >= 15, F.greatest(z, slope(numbered, 0.15, 60.0, 8.0))).otherwise(z) + F.when(F.col("mark") > 0, STRONG).otherwise(-0.5) + F.when(base.rlike("(?i)" + GEN_NAMES.pattern), STRONG).otherwise(-0.25)
    mini = F.when(F.col("n") > 200, slope(dense, 0.4, 25.0, 9.0)).otherwise(-1.0) + F.when(base.rlike("(?i)" + MIN_NAMES.pattern), 4.0).otherwise(-0.5)
    ven = F.when(F.col("copied") > 0, F.greatest(F.lit(-0.5), slope(F.col("copied"), 0.3, 14.0, STRONG))).otherwise(-0.5)
    blob = F.when(F.col("n") > 150, slope(data, 0.5, 16.0, 8.0)).otherwise(-2.0)
    return F.array(z, gen, mini, ven, blob, F.lit(NEVER))


def directory_unary(name: Column) -> Column:
    z = F.lit(0.0)
    return F.array(
        z, F.when(name.rlike(GEN_DIRS), FOLDER).when(name.rlike(MAYBE_GEN_DIRS), STRONG).otherwise(z), F.when(name.rlike(PACK_DIRS), 1.0).otherwise(z), F.when(name.rlike(VENDOR_DIRS), FOLDER).when(name.rlike(MAYBE_VENDOR_DIRS), 2.5).when(name.rlike(VERSIONED_DIR), 2.0).otherwise(z), z, z,
    )


# ---- propagation


def _log_sum(x: np.ndarray, axis: int = -1) -> np.ndarray:
    """log of the sum of exp over an axis."""
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True)), axis)


def _rows(col: pd.Series) -> np.ndarray:
    return np.stack(col.to_numpy()).astype(np.float64) if len(col) else np.zeros((0, K))


def _norm(x: np.ndarray) -> np.ndarray:
    """Messages matter up to a constant: the largest entry is 0."""
    return x - x.max(axis=-1, keepdims=True)


def _block(pdf: pd.DataFrame, holds: np.ndarray):
    """Order by depth, parents by position, and the upward pass of a block:
    (positions per depth, parent, h, message)."""
    depth = pdf["node"].str.count("/").to_numpy()
    where = pd.Series(np.arange(len(pdf)), index=pdf["node"])
    parent = where.reindex(pdf["parent"]).fillna(-1).to_numpy().astype(int)
    log, h, m = np.log(holds), _rows(pdf["u"]), np.zeros((len(pdf), K))
    levels = [np.flatnonzero(depth == d) for d in range(depth.max(), depth.min() - 1, -1)]
    for at in levels:
        m[at] = _norm(_log_sum(h[at][:, None, :] + log))
        inner = at[parent[at] >= 0]
        np.add.at(h, parent[inner], m[inner])
    return levels, parent, h, m


def _up(nodes: DataFrame, holds: np.ndarray) -> DataFrame:
    """(node, parent, m): the messages that leave each block."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        _, parent, _, m = _block(pdf, holds)
        out = np.flatnonzero(parent < 0)
        return pd.DataFrame({"node": pdf["node"].to_numpy()[out], "parent": pdf["parent"].to_numpy()[out], "m": list(m[out])})

    return nodes.groupBy("block").applyInPandas(run, "node string, parent string, m array<double>")


def _down(nodes: DataFrame, holds: np.ndarray) -> DataFrame:
    """(node, total) of every node, given what comes from above a block in
    `above`; a row without a node holds the expected counts of its edges."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        levels, parent, h, m = _block(pdf, holds)
        log, total, pairs = np.log(holds), np.empty_like(h), np.zeros((K, K))
        for at in levels[::-1]:
            top, inner = at[parent[at] < 0], at[parent[at] >= 0]
            if len(top):
                total[top] = h[top] + _rows(pdf["above"].iloc[top])
            if len(inner):
                cavity = _norm(total[parent[inner]] - m[inner])
                both = cavity[:, :, None] + log
                total[inner] = h[inner] + _log_sum(both, 1)
                joint = both + h[inner][:, None, :]
                joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True))
                pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        return pd.DataFrame({"node": [*pdf["node"], None], "total": [*_norm(total), pairs.ravel()]})

    return nodes.groupBy("block").applyInPandas(run, "node string, total array<double>")


def _plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def _total(c: str, k: int = K) -> Column:
    return F.array(*[F.sum(F.col(c)[i]) for i in range(k)])


def _chain() -> Column:
    """The node and all above it, the top first."""
    parts = F.split("node", "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def cut(nodes: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """Blocks of at most `most` nodes (with `block`, their top node), and the
    nodes above all blocks (None if there are none).  `nodes` is read more than
    once."""
    if nodes.count() <= most:
        return nodes.withColumn("block", F.lit("")), None
    big = nodes.select(F.explode(_chain()).alias("up")).groupBy("up").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > most).select("up")
    big = written(big, "big")
    over = nodes.select("node", F.explode(_chain()).alias("up")).join(big, "up", "left_semi").groupBy("node").agg(F.count(F.lit(1)).alias("b"))
    x = nodes.join(over, "node", "left").withColumn("b", F.coalesce("b", F.lit(0)))
    top = x.join(big.withColumnRenamed("up", "node"), "node", "left_semi").drop("b")
    rest = x.join(big.withColumnRenamed("up", "node"), "node", "left_anti")
    return rest.withColumn("block", F.element_at(_chain(), (F.col("b") + 1).cast("int"))).drop("b"), top


def tree_totals(nodes: DataFrame, holds: np.ndarray, block: int = BLOCK) -> DataFrame:
    """(node, total) of the nodes (node, parent, u) of a tree without leaves."""
    layers, rest = [], nodes
    while rest is not None:
        blocks, top = cut(rest, block)
        up = None
        if top is not None:
            blocks = written(blocks, "blocks")
            up = written(_up(blocks, holds), "up")
            got = up.groupBy(F.col("parent").alias("node")).agg(_total("m").alias("more"))
            top = written(top.join(got, "node", "left").select("node", "parent", F.when(F.col("more").isNull(), F.col("u")).otherwise(_plus(F.col("u"), F.col("more"))).alias("u")), "top")
        layers.append((blocks, up))
        rest = top
    root, log, done = [float(x) for x in np.log(ROOT)], np.log(holds), None

    @F.pandas_udf("array<double>")
    def onto(t: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series(list(_log_sum(_norm(_rows(t) - _rows(m))[:, :, None] + log, 1)), dtype=object)

    for blocks, up in layers[::-1]:
        if done is None:
            x = blocks.withColumn("above", F.array(*[F.lit(v) for v in root]))
        else:
            came = up.join(done.where("node is not null").select(F.col("node").alias("parent"), "total"), "parent").select("node", onto("total", "m").alias("above"))
            x = blocks.join(came, "node", "left").withColumn("above", F.coalesce("above", F.array(*[F.lit(v) for v in root])))
        now = written(_down(x, holds), "down")
        done = now if done is None else done.unionByName(now)
    return done


class Beliefs:
    """files: (path, belief) with six entries; nodes: (node, belief) of groups
    and directories; inner, leaves: expected counts of the edges."""

    def __init__(self, files: DataFrame, path: str = "file_path", evidence: str = "u", names: DataFrame | None = None, holds: np.ndarray = HOLDS, last: np.ndarray = HOLDS, block: int = BLOCK):
        log = np.log(last)
        f = written(files.select(F.col(path).alias("file"), group_of(F.col(path)).alias("parent"), F.col(evidence).alias("u"), _leaf_message(log)(F.col(evidence)).alias("m")), "leaves")
        below = f.groupBy(F.col("parent").alias("node")).agg(_total("m").alias("below"))
        nodes = below.select(F.explode(_chain()).alias("node")).distinct().join(below, "node", "left")
        zero, name = F.array(*[F.lit(0.0)] * K), F.substring_index("node", "/", -1)
        own = directory_unary(name)
        if names is not None:
            nodes = nodes.withColumn("name", F.regexp_replace(name, r"\d+", "0")).join(names, "name", "left").drop("name")
            own = _plus(own, F.coalesce("said", zero))
        u = _plus(F.when(F.col("below").isNotNull(), zero).otherwise(own), F.coalesce("below", zero))
        nodes = written(nodes.select("node", F.regexp_replace("node", "/?[^/]*$", "").alias("parent"), u.alias("u")), "nodes")
        nodes = nodes.withColumn("parent", F.when(F.col("node") != "", F.col("parent")))
        totals = tree_totals(nodes, holds, block)
        self.inner = _sum_pairs(totals.where("node is null").select("total"))
        there = totals.where("node is not null")
        done = written(f.join(there.select(F.col("node").alias("parent"), F.col("total").alias("t")), "parent").mapInPandas(_leaf_totals(log), "file string, belief array<double>, pairs array<double>"), "beliefs")
        self.leaves = _sum_pairs(done.where("pairs is not null").select(F.col("pairs").alias("total")))
        self.files = done.where("file is not null").select(F.col("file").alias(path), "belief")
        self.nodes = there.select("node", _shares()(F.col("total")).alias("belief"))


def _leaf_message(log: np.ndarray):
    @F.pandas_udf("array<double>")
    def run(u: pd.Series) -> pd.Series:
        return pd.Series(list(_norm(_log_sum(_rows(u)[:, None, :] + log))), dtype=object)

    return run


def _shares():
    @F.pandas_udf("array<double>")
    def run(col: pd.Series) -> pd.Series:
        x = _rows(col)
        return pd.Series(list(np.exp(x - _log_sum(x)[:, None])), dtype=object)

    return run


def _leaf_totals(log: np.ndarray):
    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            u = _rows(pdf["u"])
            both = _norm(_rows(pdf["t"]) - _rows(pdf["m"]))[:, :, None] + log
            total = u + _log_sum(both, 1)
            joint = both + u[:, None, :]
            joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True))
            pairs = (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            yield pd.DataFrame({"file": [*pdf["file"], None], "belief": [*np.exp(total - _log_sum(total)[:, None]), None], "pairs": [*[None] * len(pdf), pairs.ravel()]})

    return run


def _sum_pairs(rows: DataFrame) -> np.ndarray:
    """36 sums."""
    got = rows.agg(_total("total", K * K).alias("x")).first()[0]
    return np.array([0.0 if v is None else v for v in got]).reshape(K, K)


def fitted(holds: np.ndarray, counts: np.ndarray, firm: float = FIRM) -> np.ndarray:
    """Compatibilities by expected counts, the stated ones as `firm` edges a
    row; a file is never mixed, so that column may stay as it is."""
    x = counts + firm * holds
    x = np.maximum(x / x.sum(axis=1, keepdims=True), 1e-4)
    return x / x.sum(axis=1, keepdims=True)


# ---- what is learned between the passes


class Softmax:
    """Softmax regression over sets of slots, trained by full-gradient steps;
    classes are balanced, so that logits are log likelihood ratios to
    handwritten."""

    def __init__(self, weight: np.ndarray, bias: np.ndarray):
        self.weight, self.bias = weight, bias

    @classmethod
    def train(cls, sets: list, label: np.ndarray, steps: int = STEPS, decay: float = DECAY, least: int = LEAST) -> Softmax:
        k = len(LABELS)
        if not len(sets):
            return cls(np.zeros((1 << BITS, k), dtype=np.float32), np.zeros(k, dtype=np.float32))
        flat, size = np.concatenate([np.asarray(s, dtype=np.int64) for s in sets]), np.array([len(s) for s in sets])
        row = np.repeat(np.arange(len(sets)), size)
        often = np.bincount(flat, minlength=1 << BITS) >= least
        flat, row = flat[often[flat]], row[often[flat]]
        used, x = np.unique(flat, return_inverse=True)
        share = label.sum(axis=0)
        per = np.where(share >= 10, len(sets) / (k * np.maximum(share, 10)), 0.0)  # too few files of a label: it is not learned
        target = label * per
        mass = target.sum(axis=1, keepdims=True)
        w, b = np.zeros((len(used), k)), np.zeros(k)
        sw, sb = np.full_like(w, 1.0), np.full_like(b, 1.0)
        for _ in range(steps):
            z = b + np.stack([np.bincount(row, w[x, c], minlength=len(sets)) for c in range(k)], axis=1)
            p = np.exp(z - z.max(axis=1, keepdims=True)) * (per > 0)
            g = p / np.maximum(p.sum(axis=1, keepdims=True), 1e-30) * mass - target
            gw = np.stack([np.bincount(x, g[row, c], minlength=len(used)) for c in range(k)], axis=1) + decay * w
            gb = g.sum(axis=0)
            sw, sb = sw + gw * gw, sb + gb * gb
            w, b = w - 0.5 * gw / np.sqrt(sw), b - 0.5 * gb / np.sqrt(sb)
        weight = np.zeros((1 << BITS, k), dtype=np.float32)
        weight[used] = w
        weight[:, per == 0], b[per == 0] = 0.0, 0.0
        return cls(weight, b.astype(np.float32))

    def ratios(self, terms: pd.Series) -> np.ndarray:
        """Per row, the best of its lines for each label."""
        size = np.array([len(t) for t in terms])
        flat = np.concatenate([np.asarray(t, dtype=np.int64) for t in terms])
        heads = np.flatnonzero(flat < 0)
        w = self.weight[flat]
        w[heads] = self.bias
        z = np.add.reduceat(w, heads, axis=0)
        first = np.searchsorted(heads, np.cumsum(size) - size)
        return np.maximum.reduceat(z - z[:, :1], first, axis=0)


def lines_of(terms) -> list[tuple[int, ...]]:
    out: list[list[int]] = []
    for t in terms:
        if t < 0:
            out.append([])
        else:
            out[-1].append(t)
    return [tuple(x) for x in out]


def folded(path: str = "file_path") -> Column:
    """0 or 1 by directory."""
    return F.pmod(F.xxhash64(F.regexp_replace(path, "[^/]*$", "")), F.lit(2)).cast("int")


def learn(rows: DataFrame, beliefs: DataFrame, terms: str, sample: int = SAMPLE) -> DataFrame:
    """(file_path, ratio): for each file the best of its lines by the
    regression of the other fold, for rows (file_path, terms) of sets of slots.
    The regressions see about `sample` rows a label and fold."""
    spark = rows.sparkSession
    best = F.array_position("belief", F.array_max("belief")).cast("int")
    b = beliefs.where(F.array_max("belief") >= SURE).select("file_path", best.alias("best"))
    r = rows.where(F.col(terms).isNotNull()).select("file_path", F.col(terms).alias("terms"), folded().alias("fold"))
    known = r.join(b, "file_path")
    rate = {x[0]: min(1.0, 2 * sample / x[1]) for x in known.groupBy("best").count().collect()}  # at most five rows
    limit = F.element_at(F.create_map(*[F.lit(v) for k, s in (rate or {0: 1.0}).items() for v in (k, int(s * (1 << 20)))]), F.col("best"))
    key = F.xxhash64("file_path", "terms")
    got = known.where(F.pmod(key, F.lit(1 << 20)) < limit).select("fold", "terms", "best", F.xxhash64("file_path").alias("file")).collect()  # about 2 * sample rows a label
    models = []
    for fold in (0, 1):
        part = sorted({(r["file"], line, r["best"] - 1) for r in got if r["fold"] != fold for line in lines_of(r["terms"])})
        models.append(Softmax.train([x[1] for x in part], np.eye(len(LABELS))[[x[2] for x in part]].reshape(-1, len(LABELS))))
    sent = spark.sparkContext.broadcast(models)  # 2^BITS x 5 numbers each

    @F.pandas_udf("array<double>")
    def run(terms: pd.Series, fold: pd.Series) -> pd.Series:
        out = np.zeros((len(terms), len(LABELS)))
        for i, m in enumerate(sent.value):
            at = np.flatnonzero(fold.to_numpy() == i)
            if len(at):
                out[at] = m.ratios(terms.iloc[at])
        return pd.Series(list(out), dtype=object)

    top = F.array(*[F.max(F.col("r")[i]) for i in range(len(LABELS))])
    return r.select("file_path", run("terms", "fold").alias("r")).groupBy("file_path").agg(top.alias("ratio"))


def said(ratio: Column, most: float) -> Column:
    """Bounded evidence; the best of several lines is taken with a margin, and
    without lines it is the least."""
    inner = F.transform(F.slice(ratio, 2, len(LABELS) - 1), lambda x: F.greatest(F.lit(LOW), F.least(F.lit(most), x - MARGIN)))
    return F.concat(F.array(F.lit(0.0)), F.coalesce(inner, F.array(*[F.lit(LOW)] * (len(LABELS) - 1))), F.array(F.lit(0.0)))


def name_ratios(nodes: DataFrame) -> DataFrame:
    """(name, said): log-odds of directory names over all directories.  What a
    name says is how much likelier directories of that name have a state than
    directories have in general, smoothed by three of the latter; it speaks for a
    state only if most directories of the name have it."""
    x = nodes.where("node <> '' and not node like '%/*%'").select(F.regexp_replace(F.substring_index("node", "/", -1), r"\d+", "0").alias("name"), "belief")
    every = np.array(x.agg(_total("belief").alias("b")).first()[0] or [1.0] * K, dtype=float)
    every = every / every.sum()
    by = x.groupBy("name").agg(_total("belief").alias("b"), F.count(F.lit(1)).alias("dirs")).where("dirs >= 3")
    ratio = [F.log((F.col("b")[i] + F.lit(float(3 * every[i] + 1e-3))) / ((F.col("dirs") + 3) * F.lit(float(every[i] + 1e-3)))) for i in range(K)]
    most = [F.col("b")[i] >= F.col("dirs") / 2 for i in range(K)]
    said = [F.greatest(F.lit(-1.0), F.least(F.when(m, F.lit(NAMED)).otherwise(0.0), r - ratio[HAND])) for r, m in zip(ratio, most)]
    return by.select("name", F.array(*said).alias("said"))


def labelled(chunks: DataFrame, path: str = "file_path", text: str = "code_text", rounds: int = ROUNDS) -> DataFrame:
    """(file_path, label, handwritten): the likeliest label of each file and
    the probability that it is handwritten, after `rounds` of learning."""
    c = written(chunk_evidence(chunks, path, text), "chunk-evidence")
    f = written(file_evidence(c), "file-evidence")
    folders = F.slice(F.split("file_path", "/"), 1, F.greatest(F.size(F.split("file_path", "/")) - 1, F.lit(0)))
    weights = f.select("file_path", F.exists(folders, lambda x: x.rlike(VENDOR_DIRS)).cast("double").alias("w"))
    now = Beliefs(f.join(copied(c, weights), "file_path", "left").select("file_path", unary().alias("u")))
    for _ in range(rounds):
        notes = learn(c, now.files, "terms").withColumnRenamed("ratio", "notes")
        traits = learn(f, now.files, "traits")
        weights = now.files.select("file_path", F.col("belief")[VEN].alias("w"))
        evidence = f.join(copied(c, weights), "file_path", "left").join(notes, "file_path", "left").join(traits, "file_path", "left")
        evidence = evidence.select("file_path", _plus(unary(), _plus(said(F.col("notes"), CLIP), said(F.col("ratio"), TRAITS))).alias("u"))
        now = Beliefs(evidence, names=name_ratios(now.nodes), holds=fitted(HOLDS, now.inner), last=fitted(HOLDS, now.leaves))
    best = F.array_position("belief", F.array_max("belief")).cast("int")
    return now.files.select("file_path", F.element_at(F.array(*[F.lit(x) for x in LABELS]), best).alias("label"), F.col("belief")[0].alias("handwritten"))
