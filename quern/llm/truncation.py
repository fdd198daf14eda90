"""Text cut off by field limits or in transfer.

Two kinds of evidence meet in one posterior.  Lengths: for every source and
unit (characters, bytes) a log-normal length distribution is fitted by maximum
likelihood, right-censored at each length that more different texts have than the fit and
the lengths around it let expect, be their share ever so small; the
censoring posterior of a value at such a limit is one minus the share that the
fit itself puts there.  Away from limits the share of cut transfers holds, which
is estimated by EM from the endings of all texts.
Endings: a logistic model of the end of a text, trained on the collection's own
line and sentence ends against cuts at random places, gives the log-likelihood
ratio of "unfinished"; open code fences, open table rows, broken characters and
cut marks are its features.

The model is fitted on examples from about `SAMPLE` documents, at most `PER_DOC`
of each; closing lines (sign-offs) are counted over all documents, as is
everything else.

Nulls: a null or blank text is not cut off; a null source is one source of its
own.  Repeated ids are cut off if any of their texts is.  Empty tables give
empty results.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.session import written

SAMPLE, PER_DOC = 4000, 24
BITS = 18
SURE = 0.95  # most that a limit alone may claim
PRIORS = (0.02, 0.3)  # bounds of the share of cuts away from limits; the middle of their logits where there are no texts
LEAST_COUNT, CHANCE = 4, 1e-3  # texts at one length, and how likely so many may be without a limit, for a candidate
NEAR, SPLIT = 32, 3  # lengths on either side that tell how many to expect; those next to a limit that characters split by it fall on
TAIL = 240
OPEN = 4.0  # least evidence of an open code block or table row
CLOSING = 60  # characters of a closing line
LEAST_TEXTS, LEAST_SHARE = 3, 1e-4  # texts, and share of all texts, that a closing line ends: at most 10,000 lines pass
SIGNED = re.compile(r"-- \w+(?: \w+){0,3}$")  # a signature after the usual mark
FILE = re.compile(r"\S*/\S+\.\w{1,5}$")

MARK = re.compile(r"\s*(?:…|\.\.\.|\[(?:cut|truncated|snip|more|continued|\.\.\.|…)\])$", re.I)
RUN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_")
FENCE = re.compile(r"(?m)^[ \t>]*(?:```|~~~)")


def _kind(line: str) -> str:
    s = line.lstrip()
    if s.startswith("|"):
        return "row"
    if re.match(r"(?:[-*+•]|\d+[.)])\s", s):
        return "list"
    if s.startswith(("#", "=")):
        return "head"
    if s.startswith("--"):
        return "sign"
    return "quote" if s.startswith(">") else "text"


def features(tail: str, fenced: bool, size: int, opening: str = "") -> list[str]:
    """Names of the features of a text's end; `size` is its whole length and
    `opening` how its last line starts, if that lies before the tail."""
    marked = bool(MARK.search(tail))
    t = MARK.sub("", tail.rstrip()) if marked else tail.rstrip()
    broken = t.endswith("�")
    t = t.rstrip("�")
    line = t.rsplit("\n", 1)[-1]
    kind = "code" if fenced else _kind(opening or line)
    w = [re.sub(r"\d", "0", x).lower() for x in RUN.findall(line)]
    last = t[-1:] or " "
    group = "a" if last.isalpha() else "0" if last.isdigit() else last
    w = ["^"] * 5 + w
    blank = "b" if "\n\n" in t[-(len(line) + 2) :] else "n"
    count = min(len(w) - 5, 14)
    glued = tail[-1:].isspace() and not tail.endswith("\n")
    closed = kind != "row" or line.rstrip().endswith("|")
    return [
        "bias", f"k{kind}", f"g{kind}{group}", f"n{kind}{count}{group if not group.isalnum() else 'x'}", f"1{w[-1]}", f"2{w[-2]} {w[-1]}", f"3{w[-3]} {w[-2]} {w[-1]}", f"p2{w[-2]}", f"p3{w[-3]}", f"q{w[-3]} {w[-2]}",
        f"r{w[-4]} {w[-3]} {w[-2]}", f"s{w[-5]} {w[-4]} {w[-3]}", f"c{closed}{kind}", f"x{broken}", f"l{len(w[-1]) if last.isalpha() else 'x'}", f"f{fenced}", f"b{blank}{kind}{min(count, 4)}", f"d{glued}", f"w{line.lower()[:40]}" if count <= 5 else "w",
    ]


def slot(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)


def opening(text: str, end: int) -> str:
    """The start of the line that text[:end] ends with, if it lies more than a
    tail before; else ''."""
    stop = end
    while stop and text[stop - 1].isspace():
        stop -= 1
    at = text.rfind("\n", 0, stop) + 1
    return text[at : at + 40] if at < end - TAIL else ""


def _last_word(tail: str) -> str:
    t = MARK.sub("", tail.rstrip())
    m = re.search(r"[^\W\d_]+$", t)
    return m[0].lower() if m else ""


def examples(text: str, key: int) -> list[tuple[str, bool, int, str, bool]]:
    """(tail, fenced, length, opening, unfinished) examples of one text.  Its own end
    is never used, as it may be cut."""
    rng = np.random.default_rng(key & 0xFFFFFFFF)
    stop = text.rfind("\n", 0, max(len(text) - 1, 0))
    ends = [m.end() for m in re.finditer(r"[.?!](?=\s)|(?<=\S)(?=\n)", text)]
    fences = [m.start() for m in FENCE.finditer(text)]
    fenced = lambda at: bool(np.searchsorted(fences, at, side="left") % 2)
    good = [e for e in ends if (not fenced(e)) and (e <= stop or text[e - 1] in ".?!")]
    out = []
    for e in rng.permutation(good)[: PER_DOC // 2]:
        t = text[max(0, e - TAIL) : e]
        out.append((t.rstrip(".") if t.endswith(".") and rng.random() < 0.25 else t, False, int(e), opening(text, int(e)), False))
    known = set(ends)
    for e in rng.integers(1, max(2, len(text)), PER_DOC // 2):
        e = int(e)
        t = text[max(0, e - TAIL) : e]
        if e not in known and t.strip() and text[e : e + 1].strip() and (e - 1) not in known:
            out.append((t, fenced(e), e, opening(text, e), True))
    return out


def plain(line: str) -> str:
    """A line with a whole file name at its end counts as one for all files."""
    return FILE.sub("<file>", line.strip())


def last_line(text: str) -> str | None:
    """The last line, if it is short and not the only one."""
    at = text.rstrip().rfind("\n")
    line = text[at + 1 :].rstrip()
    return plain(line) if at >= 0 and len(line) <= CLOSING else None


def closings(docs: DataFrame, lasts: DataFrame, n: int) -> frozenset[str]:
    """Closing lines: of those that end enough texts (line, texts), the ones
    that do not start other lines as often, which a line cut at random would."""
    known = {r["line"]: r["texts"] for r in lasts.where(F.col("texts") >= max(LEAST_TEXTS, LEAST_SHARE * n)).collect()}  # at most 10,000
    if not known:
        return frozenset()
    short = any(len(x) < 6 for x in known)
    sent = docs.sparkSession.sparkContext.broadcast((frozenset(known), sorted({len(x) for x in known}), frozenset() if short else frozenset(x[:6] for x in known)))

    def run(batches):
        lines, sizes, first = sent.value
        for pdf in batches:
            c: Counter[str] = Counter()
            for t in pdf["text"]:
                for x in t.rstrip().split("\n")[:-1]:
                    if x.strip():
                        x = plain(x[:CLOSING])
                        if not first or x[:6] in first:
                            c.update(x[:z] for z in sizes if z <= len(x) and x[:z] in lines)
            yield pd.DataFrame({"line": list(c), "n": list(c.values())}).astype({"line": object, "n": "int64"})

    mid = docs.select("text").where("text is not null").mapInPandas(run, "line string, n bigint").groupBy("line").agg(F.sum("n").alias("n"))
    inner = {r["line"]: r["n"] for r in mid.collect()}
    return frozenset(x for x, k in known.items() if k >= 0.5 * inner.get(x, 0))


class EndModel:
    """Logistic regression on hashed features plus whether the last word is
    one that the examples complete; closing lines go before it."""

    def __init__(self, weight: np.ndarray, words: np.ndarray, closing: frozenset[str] = frozenset()):
        self.weight, self.words, self.closing = weight, words, closing

    def closes(self, tail: str) -> bool:
        line = tail.rstrip().rsplit("\n", 1)
        return len(line) > 1 and (plain(line[1]) in self.closing or bool(SIGNED.match(line[1])))

    def indices(self, tail: str, fenced: bool, size: int, opening: str = "") -> list[int]:
        names = features(tail, fenced, size, opening)
        last = _last_word(tail)
        if last:
            names.append(f"known{min(int(self.words[slot('W' + last)]), 3)}")
        return [slot(x) for x in names]

    def score(self, tail: str, fenced: bool, size: int, opening: str = "") -> float:
        if not fenced and self.closes(tail):
            return -8.0
        found = float(self.weight[self.indices(tail, fenced, size, opening)].sum())
        line = tail.rstrip().rsplit("\n", 1)[-1].strip()
        open_end = fenced or ((opening.lstrip() or line).startswith("|") and not line.endswith("|"))
        return max(found, OPEN) if open_end else found

    @classmethod
    def train(cls, rows: list[tuple[str, bool, int, str, bool]], rounds: int = 6, rate: float = 0.3, decay: float = 1e-4) -> EndModel:
        words = np.zeros(1 << BITS, dtype=np.int32)
        for tail, *_ in rows:
            for w in re.findall(r"[^\W\d_]+(?=[^\w])", tail.lower())[1:]:  # whole words only
                words[slot("W" + w)] += 1
        words = np.minimum(words // 2, 7)
        m = cls(np.zeros(1 << BITS, dtype=np.float32), words)
        xs = [m.indices(*r[:4]) for r in rows]
        width = max(map(len, xs), default=1)
        x = np.array([i + [0] * (width - len(i)) for i in xs], dtype=np.int64).reshape(-1, width)
        there = np.array([[1.0] * len(i) + [0.0] * (width - len(i)) for i in xs], dtype=np.float32).reshape(-1, width)
        y = np.array([r[4] for r in rows], dtype=np.float32)
        if not len(y):
            return m
        share = np.where(y == 1, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6)).astype(np.float32)  # balanced: the sum is a likelihood ratio
        sq, rng = np.full(1 << BITS, 1e-3, dtype=np.float32), np.random.default_rng(3)
        for _ in range(rounds):
            order = rng.permutation(len(y))
            for at in range(0, len(y), 256):
                b = order[at : at + 256]
                z = (m.weight[x[b]] * there[b]).sum(axis=1)
                g = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[b]) * share[b])[:, None] * there[b]
                hit, at_hit = np.unique(x[b].ravel(), return_inverse=True)
                grad = np.bincount(at_hit.ravel(), g.ravel(), minlength=len(hit)).astype(np.float32)
                sq[hit] += grad**2
                m.weight[hit] -= rate * (grad / np.sqrt(sq[hit]) + decay * m.weight[hit])
        return m


def fit_censored(n: float, s1: float, s2: float, cens: list[tuple[float, float]]) -> tuple[float, float]:
    """Mean and deviation of log lengths by EM: n exact values with sums s1,
    s2 of logs and squares, and (log limit, count) of censored ones."""
    if n < 2:
        return (s1 / n if n else 0.0), 1.0
    mu, sd = s1 / n, math.sqrt(max(s2 / n - (s1 / n) ** 2, 1e-4))
    total = n + sum(c for _, c in cens)
    for _ in range(200 if cens else 0):
        a, b = s1, s2
        for t, c in cens:
            z = (t - mu) / sd
            tail = max(0.5 * math.erfc(z / math.sqrt(2)), 1e-12)
            lam = math.exp(-0.5 * z * z) / math.sqrt(2 * math.pi) / tail
            e1 = mu + sd * lam
            a, b = a + c * e1, b + c * (sd * sd * (1 + z * lam - lam * lam) + e1 * e1)
        new = a / total, math.sqrt(max(b / total - (a / total) ** 2, 1e-4))
        if abs(new[0] - mu) + abs(new[1] - sd) < 1e-7:
            break
        mu, sd = new
    return mu, sd


def endings(docs: DataFrame, ident: str, text: str, source: str, model: EndModel) -> DataFrame:
    """(doc_id, source, chars, bytes, evidence, hash) of every non-blank text."""
    sent = docs.sparkSession.sparkContext.broadcast((model.weight, model.words, model.closing))  # 2 MB and at most 10,000 lines

    def run(batches):
        m = EndModel(*sent.value)
        for pdf in batches:
            out = []
            for i, t, s, h in zip(pdf["doc_id"], pdf["text"], pdf["source"], pdf["hash"]):
                if t.strip():
                    fenced = bool(len(FENCE.findall(t)) % 2) if "```" in t or "~~~" in t else False
                    bare = t.rstrip("�")
                    size = len(bare.encode("utf-8", "surrogatepass"))
                    marked = bool(MARK.search(t[-TAIL:])) and not m.closes(t[-TAIL:])
                    out.append((i, s, len(t), size, m.score(t[-TAIL:], fenced, len(t), opening(t, len(t))), marked, len(bare) < len(t), h))
            yield pd.DataFrame(out, columns=["doc_id", "source", "chars", "bytes", "evidence", "marked", "broken", "hash"])

    rows = docs.select(F.col(ident).cast("bigint").alias("doc_id"), F.col(text).alias("text"), F.col(source).cast("string").alias("source"), F.xxhash64(text).alias("hash")).where("doc_id is not null and text is not null")
    return rows.mapInPandas(run, "doc_id bigint, source string, chars bigint, bytes bigint, evidence double, marked boolean, broken boolean, hash bigint")


def train(docs: DataFrame, ident: str, text: str, sample: int = SAMPLE) -> EndModel:
    """One pass over the texts gives the examples of the sample and the last
    lines of all, another one counts lines that closing lines start."""
    n = docs.count()
    limit = int(min(1.0, sample / max(n, 1)) * (1 << 20))
    rows = docs.select(F.xxhash64(F.col(ident)).alias("key"), F.col(text).alias("text")).where("text is not null")
    names = ["line", "tail", "fenced", "size", "opening", "cut"]

    def run(batches):
        for pdf in batches:
            out = []
            for k, t in zip(pdf["key"], pdf["text"]):
                if k % (1 << 20) < limit:
                    out += [(None, *x) for x in examples(t, k)]
                line = last_line(t) if t.strip() else None
                if line:
                    out.append((line, None, None, None, None, None))
            yield pd.DataFrame(out, columns=names).astype({"fenced": "boolean", "size": "Int64", "cut": "boolean"})

    got = written(rows.mapInPandas(run, "line string, tail string, fenced boolean, size bigint, opening string, cut boolean"), "endings-seen")
    taken = got.where("tail is not null").select(*names[1:]).collect()  # sample * PER_DOC short rows
    model = EndModel.train(sorted(tuple(r) for r in taken))
    model.closing = closings(rows, got.where("line is not null").groupBy("line").agg(F.count(F.lit(1)).alias("texts")), n)
    return model


def share_of_cuts(ends: DataFrame) -> float:
    """The share of cuts among texts away from limits, by EM over the evidence
    of all of them, rounded to quarters."""
    e = F.greatest(F.lit(-12.0), F.least(F.lit(12.0), F.round(F.col("evidence") * 4) / 4))
    rows = ends.groupBy(e.alias("e")).agg(F.count(F.lit(1)).alias("n")).collect()  # at most 97
    lo, hi = (math.log(p / (1 - p)) for p in PRIORS)
    if not rows:
        return 1 / (1 + math.exp(-(lo + hi) / 2))
    x, c = np.array([r["e"] for r in rows], dtype=float), np.array([r["n"] for r in rows], dtype=float)
    p = 0.1
    for _ in range(200):
        p = float((c / (1 + np.exp(-(math.log(p / (1 - p)) + x)))).sum() / c.sum())
        p = min(PRIORS[1], max(PRIORS[0], p))
    return p


def limits(ends: DataFrame) -> DataFrame:
    """(source, unit, size, rows, censored): candidate limits of each source
    with the posterior that a value at the limit was cut there."""
    unit = F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("size")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("size"))))
    u = ends.select("source", "hash", unit.alias("x")).select("source", "hash", "x.unit", "x.size")
    h = u.groupBy("source", "unit", "size", "hash").agg(F.count(F.lit(1)).alias("c")).groupBy("source", "unit", "size").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("texts"))
    log = F.log("size")
    total = h.groupBy("source", "unit").agg(F.sum("c").alias("n"), F.sum("texts").alias("all"), F.sum(F.col("c") * log).alias("s1"), F.sum(F.col("c") * log * log).alias("s2")).select(F.col("source").alias("s"), F.col("unit").alias("u"), "n", "all", "s1", "s2")
    # texts expected at a length: by the fit of all rows, or by the lengths around it where they are more
    w = Window.partitionBy("source", "unit").orderBy("size")
    around = [F.coalesce(F.sum("texts").over(w.rangeBetween(*r)), F.lit(0)) / F.lit(NEAR) for r in ((-SPLIT - NEAR, -SPLIT - 1), (SPLIT + 1, SPLIT + NEAR))]
    x = h.withColumn("near", F.greatest(*around)).where(F.col("texts") >= LEAST_COUNT).join(total, h["source"].eqNullSafe(F.col("s")) & (h["unit"] == F.col("u")))
    mu, var = F.col("s1") / F.col("n"), F.greatest(F.col("s2") / F.col("n") - F.pow(F.col("s1") / F.col("n"), F.lit(2)), F.lit(1e-4))
    fit = F.col("all") * F.exp(-F.pow(log - mu, F.lit(2)) / (2 * var)) / (F.col("size") * F.sqrt(var * 2 * math.pi))
    x = x.withColumn("expected", F.greatest("near", fit, F.lit(1e-9)))
    # a Poisson count of that mean is as large with a chance below exp(-(expected - texts + texts * log(texts / expected)))
    excess = F.col("expected") - F.col("texts") + F.col("texts") * F.log(F.col("texts") / F.col("expected"))
    cand = x.where((F.col("texts") >= 2 * F.col("expected")) & (excess >= -math.log(CHANCE)))
    # only lengths that stand out are collected, whatever their share of the source
    packed = cand.groupBy("source", "unit", "n", "s1", "s2").agg(F.sort_array(F.collect_list(F.struct("size", "c", (F.col("near") * F.col("c") / F.col("texts")).alias("near")))).alias("at"))

    def run(batches):
        for pdf in batches:
            out = []
            for s, u, n, s1, s2, at in zip(*(pdf[c] for c in ("source", "unit", "n", "s1", "s2", "at"))):
                near = [a["near"] for a in at]
                at = [(a["size"], a["c"]) for a in at]
                n0 = n - sum(c for _, c in at)
                r1 = s1 - sum(c * math.log(z) for z, c in at)
                r2 = s2 - sum(c * math.log(z) ** 2 for z, c in at)
                mu, sd = fit_censored(n0, r1, r2, [(math.log(z), c) for z, c in at])
                for (z, c), beside in zip(at, near):
                    x = (math.log(z) - mu) / sd
                    natural = max(beside, n * math.exp(-0.5 * x * x) / (z * sd * math.sqrt(2 * math.pi)))
                    p = 1 - min(1.0, natural / c)
                    if p > 0.5:
                        out.append((s, u, z, c, p))
            yield pd.DataFrame(out, columns=["source", "unit", "size", "rows", "censored"])

    return packed.mapInPandas(run, "source string, unit string, size bigint, rows bigint, censored double")


def posteriors(ends: DataFrame, found: DataFrame, away: float) -> DataFrame:
    """Adds `censored` (1 at no limit: null) and `posterior` to the endings.  A
    byte limit that would split a character is met up to three bytes below."""
    near = found.select(F.col("source").alias("s"), F.col("unit").alias("u"), F.explode(F.when(F.col("unit") == "bytes", F.array(*[F.col("size") - i for i in range(4)])).otherwise(F.array("size"))).alias("z"), "size", "censored")
    near = near.groupBy("s", "u", "z").agg(F.max(F.struct((F.col("size") == F.col("z")).alias("same"), "censored")).alias("b"))
    c, b = near.where("u = 'chars'"), near.where("u = 'bytes'")
    c = c.select(F.col("s").alias("s1"), F.col("z").alias("z1"), F.col("b.censored").alias("c1"))
    b = b.select(F.col("s").alias("s2"), F.col("z").alias("z2"), F.col("b.censored").alias("c2"), F.col("b.same").alias("same"))
    x = ends.join(c, ends["source"].eqNullSafe(F.col("s1")) & (ends["chars"] == F.col("z1")), "left")
    x = x.join(b, ends["source"].eqNullSafe(F.col("s2")) & (ends["bytes"] == F.col("z2")) & (F.col("same") | (ends["chars"] < ends["bytes"]) | ends["broken"]), "left")
    at = F.greatest("c1", "c2")
    prior = F.when(at.isNotNull(), F.least(at, F.lit(SURE))).otherwise(away)
    bonus = F.when(F.col("broken"), 6.0).otherwise(0.0) + F.when(F.col("marked") & (at.isNotNull() | (F.col("evidence") > 0)), 8.0).otherwise(0.0)
    logit = F.log(prior / (1 - prior)) + F.col("evidence") + bonus
    return x.select("doc_id", "source", "chars", "bytes", "evidence", at.alias("censored"), (1 / (1 + F.exp(-F.greatest(F.lit(-50.0), F.least(F.lit(50.0), logit))))).alias("posterior"))


def judged(docs: DataFrame, ident: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, chars, bytes, evidence, censored, posterior)."""
    ends = written(endings(docs, ident, text, source, train(docs, ident, text)), "endings")
    return posteriors(ends, written(limits(ends), "limits"), share_of_cuts(ends))


def by_source(rows: DataFrame, least: float = 0.5) -> DataFrame:
    cut = F.col("posterior") >= least
    return rows.groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(cut).alias("truncated"), F.count_if(cut & F.col("censored").isNotNull()).alias("at_limit"), F.round(F.count_if(cut) / F.count(F.lit(1)), 4).alias("share")
    )
