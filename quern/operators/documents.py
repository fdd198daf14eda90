"""HTML and PDF-span documents as sections, and the word-window splitter."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as X

WINDOW, STRIDE = 512, 448

# Page furniture by id, by class and by tag name.
FURNITURE_ID = re.compile("nav|toc|sidebar|header|footer|menu", re.I)
FURNITURE_CLASS = re.compile("nav|toc|sidebar|header|footer|menu|breadcrumb", re.I)
FURNITURE_TAGS = ("nav", "header", "footer", "aside")
VOID_TAGS = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
HEADINGS = ("h1", "h2", "h3", "h4")

NODES = "doc string, pos int, tag string, text string"


class _Nodes(HTMLParser):
    """Headings and paragraphs in document order.  An unclosed tag stays open
    until an ancestor closes, so an unclosed p nests and repeats inner text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int | None]] = []  # tag, index of its node if it yields one
        self.nodes: list[list] = []
        self.hidden = 0  # depth of the outermost furniture tag, plus one

    def handle_starttag(self, tag, attrs):
        if tag in VOID_TAGS:
            return
        a = dict(attrs)
        if not self.hidden and (FURNITURE_ID.search(a.get("id") or "") or FURNITURE_CLASS.search(a.get("class") or "") or tag in FURNITURE_TAGS):
            self.hidden = len(self.open) + 1
        at = None
        if not self.hidden and (tag == "p" or tag in HEADINGS) and any(t == "body" for t, _ in self.open):
            at = len(self.nodes)
            self.nodes.append([tag, []])
        self.open.append((tag, at))

    def handle_endtag(self, tag):
        if any(t == tag for t, _ in self.open):
            while self.open.pop()[0] != tag:
                pass
            if self.hidden > len(self.open):
                self.hidden = 0

    def handle_data(self, data):
        if not self.hidden and data.strip() and not any(t in ("script", "style") for t, _ in self.open):
            for _, at in self.open:
                if at is not None:
                    self.nodes[at][1].append(data.strip())


def html_nodes(pages: DataFrame, doc: str, html: str) -> DataFrame:
    """(doc, pos, tag, text); null pages yield nothing."""

    def run(batches):
        for pdf in batches:
            out = []
            for d, h in zip(pdf["doc"], pdf["html"]):
                if h is not None:
                    p = _Nodes()
                    p.feed(h)
                    p.close()
                    out += [(d, i, tag, " ".join(parts)) for i, (tag, parts) in enumerate(p.nodes) if parts]
            yield pd.DataFrame(out, columns=["doc", "pos", "tag", "text"])

    return pages.select(F.col(doc).cast("string").alias("doc"), F.col(html).alias("html")).mapInPandas(run, NODES)


def html_sections(nodes: DataFrame) -> DataFrame:
    """Sections of nodes: headings h1-h4 start one; h1 resets the section, h2
    keeps the chapter if it has no number of its own, h3 and h4 set the
    subsection.  Headings without text below them give no section."""
    w = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    n = X.heading_number(F.col("text"))
    head = F.col("tag").isin(*HEADINGS)
    x = nodes.withColumn("n", n).withColumn("ord", F.sum(F.when(head, 1).otherwise(0)).over(w))
    h1, h2, low = F.col("tag") == "h1", F.col("tag") == "h2", F.col("tag").isin("h3", "h4")
    x = x.withColumn("chapter", F.coalesce(F.last(F.when(h1 | (h2 & (F.col("n.chapter") > 0)), F.col("n.chapter")), True).over(w), F.lit(0)))
    x = x.withColumn("section", F.coalesce(F.last(F.when(h1, 0).when(h2, F.col("n.section")), True).over(w), F.lit(0)))
    sub = F.when(h1 | h2, F.col("n.subsection")).when(low, F.when(F.col("n.subsection") != "", F.col("n.subsection")).otherwise(F.substring("text", 1, 40)))
    x = x.withColumn("subsection", F.coalesce(F.last(sub, True).over(w), F.lit("")))
    x = x.withColumn("title", F.coalesce(F.last(F.when(head, F.col("text")), True).over(w), F.lit("")))
    body = x.where("tag = 'p'").groupBy("doc", "ord", "chapter", "section", "subsection", "title").agg(F.sort_array(F.collect_list(F.struct("pos", "text"))).alias("b"))
    content = F.trim(F.regexp_replace(F.array_join(F.col("b.text"), " "), r"\s+", " "))
    return body.select("doc", F.col("ord").cast("int").alias("ord"), "chapter", "section", "subsection", "title", content.alias("content"), F.lit("").alias("page_range")).where("content <> ''")


def pdf_sections(spans: DataFrame) -> DataFrame:
    """Sections of text spans (doc, page, block, line, span, text, size).  The
    body size is the upper median of the non-blank spans; lines from 1.4 times
    that size are chapter headings, from 1.15 times section headings."""
    from quern.operators.reports import upper_median

    s = spans.where("trim(text) <> ''")
    med = upper_median(s, ["doc"], "size")
    lines = s.groupBy("doc", "page", "block", "line").agg(F.max("size").alias("size"), F.sort_array(F.collect_list(F.struct("span", "text"))).alias("t"))
    lines = lines.select("doc", "page", "block", "line", "size", F.trim(F.array_join(F.col("t.text"), " ")).alias("text")).join(med, "doc")
    ratio = F.col("size") / F.col("median")
    x = lines.withColumn("tag", F.when(ratio >= 1.4, "h1").when(ratio >= 1.15, "h2").otherwise("p")).withColumn("n", X.heading_number(F.col("text")))
    w = Window.partitionBy("doc").orderBy("page", "block", "line").rowsBetween(Window.unboundedPreceding, 0)
    h1, h2, head = F.col("tag") == "h1", F.col("tag") == "h2", F.col("tag") != "p"
    x = x.withColumn("ord", F.sum(F.when(head, 1).otherwise(0)).over(w))
    x = x.withColumn("chapter", F.coalesce(F.last(F.when(h1 | (h2 & (F.col("n.chapter") > 0)), F.col("n.chapter")), True).over(w), F.lit(0)))
    x = x.withColumn("section", F.coalesce(F.last(F.when(h1, 0).when(h2, F.col("n.section")), True).over(w), F.lit(0)))
    x = x.withColumn("subsection", F.coalesce(F.last(F.when(head, F.col("n.subsection")), True).over(w), F.lit("")))
    x = x.withColumn("title", F.coalesce(F.last(F.when(head, F.col("text")), True).over(w), F.lit("")))
    x = x.withColumn("start", F.coalesce(F.last(F.when(head, F.col("page")), True).over(w), F.lit(1)))
    body = x.where("tag = 'p'").groupBy("doc", "ord", "chapter", "section", "subsection", "title", "start").agg(F.max("page").alias("end"), F.sort_array(F.collect_list(F.struct("page", "block", "line", "text"))).alias("b"))
    content = F.trim(F.regexp_replace(F.array_join(F.col("b.text"), " "), r"\s+", " "))
    pages = F.concat_ws("-", "start", "end")
    return body.select("doc", F.col("ord").cast("int").alias("ord"), "chapter", "section", "subsection", "title", content.alias("content"), pages.alias("page_range")).where("content <> ''")


def split_sections(df: DataFrame, text: str, title: str, window: int = WINDOW, stride: int = STRIDE) -> DataFrame:
    """Sections of more than `window` words as windows with overlap, re-joined
    by single spaces; others keep their text.  Adds idx, word_count; the title
    of later windows gets ' [idx]'.  Null text counts as ''."""
    w, n = X.words(F.coalesce(F.col(text), F.lit(""))), F.size("_w")
    x = df.withColumn("_w", w)
    last = F.when(n <= window, 0).otherwise(F.ceil((n - window) / F.lit(float(stride)))).cast("int")
    x = x.withColumn("idx", F.explode(F.sequence(F.lit(0), last)))
    part = F.slice("_w", F.col("idx") * stride + 1, F.lit(window))
    return (
        x.withColumn("word_count", F.size(part).cast("bigint"))
        .withColumn(text, F.when(n <= window, F.coalesce(F.col(text), F.lit(""))).otherwise(F.array_join(part, " ")))
        .withColumn(title, F.when(F.col("idx") > 0, F.concat(F.coalesce(F.col(title), F.lit("")), F.lit(" ["), F.col("idx").cast("string"), F.lit("]"))).otherwise(F.coalesce(F.col(title), F.lit(""))))
        .drop("_w")
    )
