import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import leakage, packing, pieces

ITEM = "Which rule says that every pin owns exactly one sparse bus, and why so?"


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def items(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


def test_leaks_with_offsets_into_the_original(spark):
    t = ["x " + ITEM.upper().replace(" ", " -- ") + " y", "WHICH rule", None, "", "İİ " + ITEM, ITEM[: len(ITEM) - 8], ITEM + " " + ITEM]
    got = leakage.leaks(docs(spark, t), items(spark, [ITEM, None, "", "too short"])).collect()
    assert {r.doc_id for r in got} == {0, 4, 5, 6} and {r.item_id for r in got} == {0}
    for r in got:
        assert leakage.words_of(t[r.doc_id][r.start : r.end])[:2] == ["which", "rule"] or r.doc_id == 6
        assert len(leakage.words_of(t[r.doc_id][r.start : r.end])) == r.words
    assert next(r.words for r in got if r.doc_id == 5) == 12


def test_leaks_equal_brute_force_in_any_block_size(spark):
    r = random.Random(3)
    word = lambda: r.choice("abcd")
    its = [" ".join(word() for _ in range(r.randint(3, 20))) for _ in range(12)]
    ds = [" ".join(word() for _ in range(r.randint(0, 60))) for _ in range(60)] + [its[0] + " " + its[1]]
    grams = lambda t, n=6: {tuple(t.split()[i : i + n]) for i in range(len(t.split()) - n + 1)}
    want = {(d, i) for d, t in enumerate(ds) for i, x in enumerate(its) if grams(t) & grams(x)}
    for block in (10, 10_000):
        got = leakage.leaks(docs(spark, ds), items(spark, its), run=6, block_words=block)
        assert {(x.doc_id, x.item_id) for x in got.collect()} == want


def test_leaks_of_empty_tables(spark):
    assert leakage.leaks(docs(spark, []), items(spark, [ITEM])).count() == 0
    assert leakage.leaks(docs(spark, [ITEM]), items(spark, [])).count() == 0


# ---- pieces


@settings(max_examples=120, deadline=None)
@given(st.integers(0, 1500), st.integers(0, 10**6), st.sampled_from([7, 64, 1000, 1 << 20]))
def test_pieces_round_trip_whatever_the_range(n, seed, width):
    r = random.Random(seed)
    words = ["".join(r.choice("abé漢.}") for _ in range(r.randint(1, 7))) for _ in range(n)]
    data = "".join(w + r.choice([" ", "\n", "\n\n", " ", "\t"]) for w in words).encode()
    g = pieces.Grid(64, 8, 8)
    got = pieces.pieces_of(data, g, width)
    assert (got == []) == (n <= 64)
    assert got == pieces.pieces_of(data, g)
    if got:
        assert b"".join(data[c:e] for _, c, _, e, _ in got) == data
        assert [p[0] for p in got] == list(range(len(got)))
        for k, c, s, e, m in got:
            assert len(data[s:e].decode().split()) == m <= 64
            if k:
                assert data[s:c].decode().split() == data[:c].decode().split()[-8:]


def test_cuts_prefer_blank_lines():
    text = " ".join(["w"] * 480) + "\n\n" + "\n".join(["w"] * 20) + " " + " ".join(["w"] * 300)
    assert pieces.pieces_of(text.encode(), pieces.Grid())[0][4] == 480


def test_split_table_edges(spark):
    long = " ".join(["tok"] * 600)
    df = spark.createDataFrame([(1, long, "x"), (1, long, "y"), (2, " ".join(["a"] * 512), ""), (3, None, ""), (4, "", ""), (None, long, "")], "id long, t string, text string")
    got = pieces.split_table(df, "tab", "id", "t").collect()
    assert {r.item_id for r in got} == {1} and len(got) == 2
    assert pieces.split_table(df.limit(0), "tab", "id", "t").count() == 0
    assert pieces.split_table(spark.createDataFrame([(9, "x" * 400_000)], "id long, t string"), "tab", "id", "t").count() == 0


def test_split_files_equals_the_whole_text(spark, tmp_path):
    r = random.Random(2)
    text = "".join("".join(r.choice("abé漢") for _ in range(r.randint(1, 9))) + r.choice([" ", "\n", "\n\n"]) for _ in range(4000))
    (tmp_path / "big.txt").write_text(text, encoding="utf-8")
    (tmp_path / "small.txt").write_text("a b c")
    got = pieces.split_files(spark, f"file://{tmp_path}", size_of_range=1500).orderBy("chunk_index").collect()
    want = pieces.pieces_of(text.encode(), pieces.Grid())
    assert [(p.chunk_index, p.core_start, p.byte_start, p.byte_end, p.tokens) for p in got] == want
    assert got[1].text == text.encode()[want[1][2] : want[1][3]].decode()


def test_any_bytes_are_split_exactly(spark, tmp_path):
    r = random.Random(6)
    bits = [b"\xff", b"\xe2\x80", b"\xe2\x80\xa8", b"\x80" * 9, b"\xc2", b"\xc2\xa0", b"\xe3\x80\x80", b" ", b"\n", "é漢".encode(), b"word", b"x."]
    data = b"".join(r.choice(bits) + r.choice([b"", b"", b" ", b"ab"]) for _ in range(30000))
    (tmp_path / "raw.bin").write_bytes(data)
    want = pieces.pieces_of(data, pieces.Grid())
    assert len(want) > 10 and b"".join(data[c:e] for _, c, _, e, _ in want) == data and max(p[4] for p in want) <= 512
    for width in (997, 1 << 13):
        assert pieces.pieces_of(data, pieces.Grid(), width) == want
        got = pieces.split_files(spark, f"file://{tmp_path}", size_of_range=width).orderBy("chunk_index").collect()
        assert [(p.chunk_index, p.core_start, p.byte_start, p.byte_end, p.tokens) for p in got] == want


def test_a_long_file_of_one_line(spark, tmp_path):
    (tmp_path / "line.txt").write_bytes(b"ab cde " * 3_000_000)
    got = pieces.split_files(spark, f"file://{tmp_path}", with_text=False).orderBy("chunk_index").collect()
    assert sum(p.tokens for p in got) - 64 * (len(got) - 1) == 6_000_000 and max(p.tokens for p in got) <= 512
    assert [p.chunk_index for p in got] == list(range(len(got))) and got[-1].byte_end == 21_000_000


# ---- packing


@settings(max_examples=150, deadline=None)
@given(st.integers(4, 60), st.lists(st.integers(1, 60), max_size=200))
def test_plan_is_best_fit_decreasing(cap, lens):
    lens = [x for x in lens if x <= cap]
    plan = packing.Plan(cap, dict(Counter(lens)))
    seen, load, free = Counter(), Counter(), []
    import numpy as np

    for x in lens:
        load[int(plan.place(np.array([x]), np.array([seen[x]]))[0])] += x
        seen[x] += 1
    assert not load or max(load.values()) <= cap
    assert set(load) == set(range(plan.containers))
    for x in sorted(lens, reverse=True):
        room = min((f for f in free if f >= x), default=None)
        if room is None:
            free.append(cap - x)
        else:
            free.remove(room)
            free.append(room - x)
    assert len(free) == plan.containers


def test_assignment_is_whole_with_hot_lengths_and_giants(spark):
    rows = [(i, 7) for i in range(300)] + [(i, i % 23) for i in range(300, 500)] + [(900, 205), (901, 100), (902, 1000), (902, 1000), (903, 0)]
    df = spark.createDataFrame(rows, "doc_id long, tokens long")
    got = packing.assign(df, [("a", 100), ("b", 33)]).collect()
    for name, cap in (("a", 100), ("b", 33)):
        load, sizes, own = Counter(), Counter(), Counter()
        for r in got:
            if r.limit_name == name:
                load[r.container_id] += r.tokens
                sizes[r.doc_id] += r.tokens
                own[r.doc_id] += 1
        want = Counter()
        for i, n in rows:
            want[i] += n
        assert {k: v for k, v in sizes.items() if v} == {k: v for k, v in want.items() if v} and set(sizes) == set(want)
        assert max(load.values()) <= cap
        assert all(own[i] == max(1, -(-n // cap)) for i, n in rows if i != 902)
        assert len([k for k, v in load.items() if v]) <= -(-sum(want.values()) // cap) * 1.25 + 1
    assert packing.assign(df.limit(0), [("a", 100)]).count() == 0
    with pytest.raises(ValueError):
        packing.assign(df, [("none", 0)])


def test_token_lengths(spark):
    import tiktoken  # noqa: F401

    df = spark.createDataFrame([(1, "Hello  world"), (2, ""), (3, None), (4, "<|endoftext|>")], "doc_id long, text string")
    got = {r.doc_id: r.tokens for r in packing.token_lengths(df).collect()}
    enc = packing.encoding(packing.VOCABULARY)
    assert got == {1: len(enc.encode_ordinary("Hello  world")), 2: 0, 3: 0, 4: len(enc.encode_ordinary("<|endoftext|>"))}


@pytest.mark.parametrize("cap", [64, 512, 8192])
def test_containers_are_close_to_the_fewest_possible(cap):
    r = random.Random(cap)
    lens = [min(cap, int(r.lognormvariate(4.5, 1.0)) + 1) for _ in range(20000)]
    plan = packing.Plan(cap, dict(Counter(lens)))
    least = max(-(-sum(lens) // cap), sum(x > cap // 2 for x in lens))  # by room, and as no two large ones go together
    assert least <= plan.containers <= 1.01 * least + 1
