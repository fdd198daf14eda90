"""Evaluation texts leaking into training text.

One Aho-Corasick automaton over words holds every run of `run` consecutive
words of every test item; each document is scanned once and hits are mapped
back to character offsets of the original text.  Items come in blocks of a
bounded number of words, one automaton and pass a block, so that the size of
what is shipped to the workers is bounded whatever the size of the test set.

Nulls: a null or empty text on either side matches nothing; rows with a null id
take no part.  Items shorter than `run` words cannot match.  Repeated rows give
one result.  Empty tables give empty results.
"""

from __future__ import annotations

import re
from functools import reduce
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import written

RUN = 12
BLOCK_WORDS = 1_000_000  # words of test items in one automaton
WORD = re.compile(r"[a-z0-9]+")
SPANS = "doc_id bigint, item_id bigint, start int, end int, words int"

_built: dict[int, tuple] = {}  # the automaton of this worker process


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def lowered(text: str) -> tuple[str, list[int] | None]:
    """Lower-case text, and for each of its characters the index of its
    original where lower-casing changed the length."""
    low = text.lower()
    if len(low) == len(text):
        return low, None
    parts = [c.lower() for c in text]
    return "".join(parts), [i for i, p in enumerate(parts) for _ in p]


def build(items: list[tuple[int, list[str]]], run: int):
    """(automaton over word numbers, word numbers, item lists); None without a
    single run of words."""
    import ahocorasick

    vocab: dict[str, int] = {}
    owners: dict[tuple, set[int]] = {}
    for item, words in items:
        ids = [vocab.setdefault(w, len(vocab) + 1) for w in words]
        for i in range(len(ids) - run + 1):
            owners.setdefault(tuple(ids[i : i + run]), set()).add(item)
    if not owners:
        return None
    auto = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for key, who in owners.items():
        auto.add_word(key, tuple(sorted(who)))
    auto.make_automaton()
    return auto, vocab


def scan(text: str, auto, vocab: dict[str, int], run: int) -> list[tuple[int, int, int, int]]:
    """(item, start, end, words) of each maximal stretch of runs of an item."""
    low, origin = lowered(text)
    ids = tuple([vocab.get(w, 0) for w in WORD.findall(low)])
    if len(ids) < run:
        return []
    hits = [(item, at) for at, who in auto.iter(ids) for item in who]  # at: index of the run's last word
    if not hits:
        return []
    at_char = [m.span() for m in WORD.finditer(low)]
    back = (lambda i: origin[i]) if origin else (lambda i: i)
    out = []
    for item, own in groupby(sorted(hits), key=lambda h: h[0]):
        ends = [at for _, at in own]
        first = last = ends[0]
        for e in [*ends[1:], None]:
            if e is not None and e <= last + 1:
                last = e
                continue
            a, b = first - run + 1, last
            out.append((item, back(at_char[a][0]), back(at_char[b][1] - 1) + 1, b - a + 1))
            if e is not None:
                first = last = e
    return out


def _blocks(items: DataFrame, item: str, text: str, most: int):
    """Items in blocks of at most `most` words (one item a block at least),
    read through an iterator: the driver holds one block and one partition."""
    block, size = [], 0
    for r in items.select(item, text).where(f"{item} is not null and {text} is not null").distinct().toLocalIterator():
        w = words_of(r[1])
        if block and size + len(w) > most:
            yield block
            block, size = [], 0
        block.append((r[0], w))
        size += len(w)
    if block:
        yield block


def leaks(docs: DataFrame, items: DataFrame, doc: str = "doc_id", doc_text: str = "text", item: str = "item_id", item_text: str = "text", run: int = RUN, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, start, end, words): stretches of documents that repeat
    at least `run` consecutive words of an item; offsets are characters."""
    sides = docs.select(F.col(doc).cast("bigint").alias("doc_id"), F.col(doc_text).alias("text")).where("doc_id is not null and text is not null")
    parts: list[DataFrame] = []
    for block in _blocks(items, item, item_text, block_words):

        def run_block(batches, block=block):
            key = hash((run, tuple((i, tuple(w)) for i, w in block)))
            if key not in _built:
                _built.clear()
                _built[key] = build(block, run)
            made = _built[key]
            for pdf in batches:
                rows = [(d, *hit) for d, t in zip(pdf["doc_id"], pdf["text"]) for hit in scan(t, *made, run)] if made else []
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "start", "end", "words"])

        if parts:  # further blocks: the one before is done with, so that no more than two are ever held
            parts[-1] = written(parts[-1], "leaks")
        parts.append(sides.mapInPandas(run_block, SPANS))
    return reduce(DataFrame.unionByName, parts).distinct() if parts else docs.sparkSession.createDataFrame([], SPANS)
