import numpy as np
import pytest

from quern.llm import provenance

HAND = "// keeps the queue in step with the reader\nint drain_queue(struct queue *head)\n{\n    while (head->next != NULL) {\n        release_buffer(head->next);\n        head = head->next;\n    }\n    return head->count;\n}\n"


def exact(paths, unary):
    """Marginals by summing over all labelings of a small tree."""
    from itertools import product

    full = [("/" + p.lstrip("/")) for p in paths]
    group = {p: p.rsplit("/", 1)[0] + "/*." + p.rsplit(".", 1)[1] for p in full}
    dirs = sorted({"/".join(g.split("/")[:i]) for g in group.values() for i in range(1, len(g.split("/")))})
    nodes = dirs + sorted(set(group.values())) + full
    up = {n: n.rsplit("/", 1)[0] if n else None for n in dirs} | {g: g.rsplit("/", 1)[0] for g in group.values()} | group
    k, total = provenance.K, np.zeros((len(paths), provenance.K))
    for lab in product(range(k), repeat=len(nodes)):
        at = dict(zip(nodes, lab))
        w = sum(unary.get(n, np.zeros(k))[at[n]] + np.log(provenance.ROOT[at[n]] if up[n] is None else provenance.HOLDS[at[up[n]], at[n]]) for n in nodes)
        for i, p in enumerate(full):
            total[i, at[p]] += np.exp(w)
    return total / total.sum(axis=1, keepdims=True)


def test_propagation_is_exact_on_a_small_tree(spark):
    paths = ["q/a.c", "q/b.c"]
    r = np.random.default_rng(3)
    u = {"/" + p: np.append(r.normal(size=5) * 2, provenance.NEVER) for p in paths}
    df = spark.createDataFrame([(p, [float(x) for x in u["/" + p]]) for p in paths], "file_path string, u array<double>")
    want = exact(paths, u)
    got = {x.file_path: np.array(x.belief) for x in provenance.Beliefs(df).files.collect()}
    assert all(np.allclose(got[p], want[i], atol=1e-6) for i, p in enumerate(paths))


def test_blocks_of_any_size_give_the_same_beliefs(spark):
    r = np.random.default_rng(4)
    rows = [(f"/a{r.integers(3)}/b{r.integers(4)}/d{r.integers(2)}/f{i}.c", [0.0, *map(float, r.normal(size=4) * 3), provenance.NEVER]) for i in range(150)]
    df = spark.createDataFrame(rows, "file_path string, u array<double>").dropDuplicates(["file_path"])
    whole = provenance.Beliefs(df)
    want = {x.file_path: np.array(x.belief) for x in whole.files.collect()}
    for block in (7, 40):
        b = provenance.Beliefs(df, block=block)
        got = {x.file_path: np.array(x.belief) for x in b.files.collect()}
        assert set(got) == set(want) and all(np.allclose(got[p], want[p], atol=1e-8) for p in got)
        assert np.allclose(b.leaves, whole.leaves) and abs(b.leaves.sum() - len(want)) < 1e-6


def test_the_tree_decides_where_files_alone_cannot(spark):
    """Files of a third-party folder that say nothing, and one handwritten
    file beside generated ones: evidence of the file alone errs on both."""
    mute = [0.0, -1.0, -1.0, -0.5, -2.0, provenance.NEVER]
    weak = [0.0, 1.5, -1.0, -0.5, -2.0, provenance.NEVER]  # leans to generated
    rows = [(f"/w/vendor/lib{i}/src/a{j}.c", mute) for i in range(3) for j in range(2)] + [(f"/w/own{i}/src/m{j}.c", weak if (i, j) == (0, 0) else mute) for i in range(6) for j in range(8)]
    got = {x.file_path: int(np.argmax(x.belief)) for x in provenance.Beliefs(spark.createDataFrame(rows, "file_path string, u array<double>")).files.collect()}
    alone = {p: int(np.argmax(u)) for p, u in rows}
    for p, _ in rows:
        assert got[p] == (provenance.VEN if "/vendor/" in p else provenance.HAND)
    assert sum(alone[p] != got[p] for p in got) == 7


def test_more_files_elsewhere_change_no_label(spark):
    mute, seen = [0.0, -0.8, -2.0, -0.5, -6.0, provenance.NEVER], [0.0, -0.8, -2.0, 6.0, -6.0, provenance.NEVER]
    few = [(f"/vendor/lib{i}/src/a.c", mute) for i in range(2)] + [("/own/tool/src/a.c", mute)]
    many = [(f"/work/p{i}/src/f{j}.c", mute) for i in range(60) for j in range(15)]
    for rows in (few, few + many):
        got = {x.file_path: x.belief for x in provenance.Beliefs(spark.createDataFrame(rows, "file_path string, u array<double>")).files.collect()}
        assert all(got[p][3] > 0.5 for p, _ in few[:2]) and got["/own/tool/src/a.c"][0] > 0.5
    # a top that holds mostly copies does not overrule what the files of a project beside them say
    own = [0.0, -0.8, -2.0, -3.0, -6.0, provenance.NEVER]
    copies = [(f"/work/c{i}/src/f{j}.c", seen) for i in range(20) for j in range(3)]
    rows = [*copies, *[(f"/work/own{i}/src/a{j}.c", own) for i in range(3) for j in range(3)]]
    got = {x.file_path: x.belief for x in provenance.Beliefs(spark.createDataFrame(rows, "file_path string, u array<double>")).files.collect()}
    assert got["/work/own1/src/a1.c"][0] > 0.5 and got["/work/c3/src/f1.c"][3] > 0.9


CASES = [
    ("/p/src/core/queue.c", HAND, "handwritten"),
    ("/p/src/core/order.c", "// Do not edit the table order without telling the clock team.\n" + HAND, "handwritten"),
    ("/p/src/core/tools.c", "// Code generation happens in tools/, this module only loads the result.\n" + HAND, "handwritten"),
    ("/p/src/core/made.c", "// Code generated by maker from port.idl; DO NOT EDIT.\n" + HAND, "generated"),
    ("/p/src/io/port.pb-c.c", HAND, "generated"),
    ("/p/src/io/rows.c", "static const struct row rows[] = {\n" + "\n".join(f"add_qrst12({i}, qrst12_set_{i}, ab{i}_x);" for i in range(1000, 1060)) + "\n};\n", "generated"),
    ("/p/web/app.js", "".join(f"var {a}=function({b},c){{return {b}.{a}(c)||d[{a}]}};" for a in "efghijkmn" for b in "opqrstuvw"), "minified"),
    ("/p/third_party/zip/inflate.c", HAND.replace("queue", "window"), "vendored"),
    ("/p/src/data/font.c", "const unsigned char font[] = {\n" + ",\n".join("0x%02x, 0x%02x, 0x1f, 0x44" % (i, 255 - i) for i in range(120)) + "\n};\n", "blob"),
]


def test_labels(spark):
    others = [(f"/p{n}/src/{d}/plain{i}.c", HAND + f"/* {d} {i} {n} */\nint other_{d}(int a) {{ return a + {i} * {n}; }}\n") for n in range(len(CASES)) for d in ("core", "io", "data") for i in range(4)]
    rows = [(path.replace("/p/", f"/p{n}/"), text, label) for n, (path, text, label) in enumerate(CASES)]
    df = spark.createDataFrame([*others, *[r[:2] for r in rows], *[r[:2] for r in rows], *[(r[0], None) for r in rows], (None, HAND), ("/p/empty.c", "")], "file_path string, code_text string")
    got = {r.file_path: r for r in provenance.labelled(df, rounds=1).collect()}
    for path, _, label in rows:
        assert got[path].label == label and (got[path].handwritten >= 0.5) == (label == "handwritten"), path
    assert got["/p/empty.c"].label == "handwritten" and all(got[p].label == "handwritten" for p, _ in others)


WORDS = "buffer queue signal table vector stage socket region port latch driver clock frame cache token route".split()


def body(r, n):
    a, b, c = (WORDS[r.integers(len(WORDS))] for _ in range(3))
    return f"int {a}_{b}_{c}(struct {a} *{b})\n{{\n    if ({b}->{c} == NULL)\n        return reset_{c}({b});\n    return {b}->{c}->{a} + {'xyzuvw'[n % 6]};\n}}\n"


def held_out(seed=9):
    """Projects with planted files.  Phrasings of notices are none of the
    conventions the operator knows; some sit in folders that give them away,
    the others are to be found by what was learned from those."""
    r = np.random.default_rng(seed)
    made = ["Written out by {t}-weaver, hand changes are discarded", "Produced during the build out of {t}.xsd; hand changes are discarded", "Emitted by {t}-weaver during the build"]
    lent = ["Pristine {t} sources, fetched by the release manager", "Mirror of {t}, fetched by the release manager from the author's site", "Pristine mirror of {t}"]
    note = ["The {t} must be drained before this is called.", "Keeps {t} and its readers in step.", "Written by hand because the {t} was too slow.", "The release of {t} happens elsewhere."]
    licence = "// Terms of use follow, at length.\n" * 40
    rows, truth = [], {}
    for p in range(40):
        top = f"/ws/proj{p}"
        for i in range(14):
            d = ("src/core", "src/io", "src/ext", "lib")[r.integers(4)]
            t = WORDS[r.integers(len(WORDS))]
            rows.append((f"{top}/{d}/hand{i}.c", (licence if i % 3 == 0 else "") + f"// {note[r.integers(len(note))].format(t=t)}\n" + "".join(body(r, k) for k in range(r.integers(1, 5)))))
        for kind, heads, folder in (("generated", made, "generated"), ("vendored", lent, "third_party/zlibx")):
            for i in range(3):
                t = WORDS[r.integers(len(WORDS))]
                path = f"{top}/{folder if i < 2 else 'src/core'}/{kind[0]}{i}.c"
                rows.append((path, (licence if i == 2 else "") + f"// {heads[r.integers(len(heads))].format(t=t)}\n" + "".join(body(r, k) for k in range(r.integers(1, 5)))))
                truth[path] = kind
    return rows, truth


@pytest.mark.xfail(reason="with a margin of 2 for the best of several lines some files of folders named `generated` with unknown notices stay handwritten; a smaller one names too many handwritten files at 40,000 files", strict=False)
def test_unseen_phrasings_are_learned(spark):
    """Folders give two thirds of the planted files away.  Notices learned from
    those put the others, which stand among handwritten files behind licences
    of forty lines, before (nearly) every handwritten file."""
    rows, truth = held_out()
    df = spark.createDataFrame(rows, "file_path string, code_text string")
    got = {r.file_path: r for r in provenance.labelled(df).collect()}
    found = {p for p, x in got.items() if x.label != "handwritten"}
    outside = {p for p in truth if "/src/core/" in p}
    assert set(truth) - outside <= found and len(found & set(truth)) >= 0.95 * len(found)
    assert all(got[p].label == "handwritten" for p, _ in rows if "/src/ext/" in p)
    hand = np.sort([got[p].handwritten for p, _ in rows if p not in truth])
    assert np.mean([np.searchsorted(hand, got[p].handwritten) / len(hand) for p in outside]) < 0.05


def test_a_copy_of_a_vendored_file_is_vendored_and_a_lone_file_is_no_copy_of_itself(spark):
    own = [(f"/p/src/ext/m{i}.c", HAND.replace("queue", f"mine{chr(97 + i)}")) for i in range(4)]
    lib = [("/p/third_party/z/inflate.c", HAND.replace("queue", "window")), ("/p/src/core/inflate.c", HAND.replace("queue", "window"))]
    more = [(f"/p/src/core/k{i}.c", HAND.replace("queue", f"kept{chr(97 + i)}")) for i in range(6)]
    got = {r.file_path: r.label for r in provenance.labelled(spark.createDataFrame(own + lib + more, "file_path string, code_text string"), rounds=1).collect()}
    assert all(got[p] == "handwritten" for p, _ in own + more) and got["/p/third_party/z/inflate.c"] == "vendored" == got["/p/src/core/inflate.c"]


@pytest.mark.parametrize("between", ["", "\n", "\n\n#pragma once\n\n"])
@pytest.mark.parametrize("licence", ["// Licensed to the owners.\n" * 3, "// Licensed to the owners.\n" * 40, "/*\n" + " * Terms of use follow, at length.\n\n" * 200 + " */\n"])
def test_notices_after_a_licence_are_seen(licence, between):
    note = "// Code generated by maker from port.idl; DO NOT EDIT.\n"
    assert provenance.look(licence + between + note + HAND)[9] == 1 and provenance.look(licence + between + HAND + note)[9] == 0
    assert set(provenance.lines_of(provenance.head_terms(note))) <= set(provenance.lines_of(provenance.look(licence + between + note + HAND)[11]))


def test_the_head_ends_at_code():
    assert provenance.head("/* a */ int x; /* b */\n// c") == "/* a */"
    assert provenance.head("// a\n\n#include <b.h>\n\n// c\nint d;") == "// a\n#include <b.h>"
    assert provenance.look("/" + "*" * 300000 + "\n" + "//\n" * 30000 + HAND)[9] == 0


def test_siblings_inform_each_other(spark):
    lib = [(f"/p/opt/zed/part{i}.c", [0.0, -0.8, -2.0, 6.0, -6.0, provenance.NEVER]) for i in range(5)]
    mute = [0.0, -0.8, -2.0, -0.5, -6.0, provenance.NEVER]
    rows = [*lib, ("/p/opt/zed/last.c", mute), *[(f"/p/src/m{i}.c", mute) for i in range(12)]]
    p = {r.file_path: int(np.argmax(r.belief)) for r in provenance.Beliefs(spark.createDataFrame(rows, "file_path string, u array<double>")).files.collect()}
    assert p["/p/opt/zed/last.c"] == provenance.VEN and p["/p/src/m1.c"] == provenance.HAND


def test_no_files(spark):
    df = spark.createDataFrame([(None, "x")], "file_path string, code_text string")
    assert provenance.labelled(df).count() == 0
