import random

import numpy as np

from quern.llm import truncation

NOUNS = "buffer queue signal table vector stage socket region port latch driver clock".split()


def sentence(r):
    a, b, c = (r.choice(NOUNS) for _ in range(3))
    return r.choice([f"The {a} holds one {b} for every {c}.", f"Ask the {a} owner before you reset the {b}.", f"Reading {a.upper()} clears the {b} flag of the {c}.", f"We saw the {a} stall while the {b} was open."])


def collection(seed=4):
    r = random.Random(seed)
    rows, cut = [], set()
    for i in range(1500):
        t = " ".join(sentence(r) for _ in range(r.randint(2, 14)))
        src = "limited" if i % 3 == 0 else None if i % 3 == 1 else "free"
        if r.random() < 0.3:
            t += "\n\nCheers, the build bot"
        if src == "limited" and len(t) > 400:
            t = t[:400]
            if t.rstrip()[-1] != ".":  # longer than the limit, so cut; not after a whole sentence
                cut.add(i)
        elif i % 40 == 2:
            t = t[: r.randint(30, len(t) - 3)]
            if t.rstrip()[-1] != ".":
                cut.add(i)
        rows.append((i, t, src, "x"))
    return rows, cut


def test_cut_texts_are_found(spark):
    rows, cut = collection()
    df = spark.createDataFrame(rows + [(9001, None, "free", ""), (9002, " \n", "free", ""), (9003, "A table:\n\n| a | b |\n| c | d", None, ""), (9004, "Code:\n\n```c\nint x;\n", None, "")], "doc_id long, text string, source string, posterior string")
    j = truncation.judged(df)
    got = {r.doc_id for r in j.where("posterior >= 0.5").collect()}
    assert {9003, 9004} <= got and not {9001, 9002} & got
    got -= {9003, 9004}
    assert len(got & cut) >= 0.9 * len(cut) and len(got & cut) >= 0.9 * len(got)
    by = {r.source: r for r in truncation.by_source(j).collect()}
    assert by["limited"].at_limit > 50 and by["free"].at_limit == 0 and None in by


def test_a_limit_that_few_of_a_large_source_meet_is_found(spark):
    r = np.random.default_rng(5)
    sizes = np.minimum(np.exp(r.normal(6.0, 0.5, 20000)).astype(int) + 1, 1500)
    at = int((sizes == 1500).sum())
    rows = [("big", int(n), int(n), i) for i, n in enumerate(sizes)] + [("big", 411, 411, -1)] * 150 + [(None, 90 + i, 90 + i, i) for i in range(300)]
    got = truncation.limits(spark.createDataFrame(rows, "source string, chars long, bytes long, hash long")).collect()
    assert 4 <= at < 0.008 * len(sizes) and {(x.source, x.unit, x.size, x.rows) for x in got} == {("big", u, 1500, at) for u in ("chars", "bytes")}
    assert all(x.censored > 0.9 for x in got)


def test_no_documents(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert truncation.judged(df).count() == 0


def test_censored_fit_recovers_the_distribution():
    x = np.random.default_rng(1).normal(5.0, 0.7, 20000)
    t = 5.4
    seen = x[x < t]
    mu, sd = truncation.fit_censored(len(seen), seen.sum(), (seen**2).sum(), [(t, float((x >= t).sum()))])
    assert abs(mu - 5.0) < 0.03 and abs(sd - 0.7) < 0.03
    assert truncation.fit_censored(0, 0.0, 0.0, []) == (0.0, 1.0)
