import hashlib
import random
import zlib
from collections import defaultdict

from tests.llm import cases
from tidewell.llm import merkle, ordered

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
NAMES = ("doc_id", "text", "lang", "source", "n_chars")


def H(s):
    return hashlib.sha256(s.encode()).hexdigest()


def encoded(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(r, text):
    return H("".join(encoded(v) for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H("".join(out[-1][k : k + 8])) for k in range(0, len(out[-1]), 8)])
    return out


def path(tree, i):
    out = []
    for nodes in tree[:-1]:
        a = i // 8 * 8
        out.append(("".join(nodes[a:i]), "".join(nodes[i + 1 : a + 8])))
        i //= 8
    return out


def brute(rows):
    """Rows by definition, each tree built whole."""
    by = defaultdict(list)
    for r in (dict(zip(NAMES, row)) for row in rows):
        by[r["lang"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), r))
    langs = sorted(by, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in langs:
        by[g].sort(key=lambda x: x[:3])
        trees[g] = levels([x[2] for x in by[g]])
    top = levels([trees[g][-1][0] for g in langs])
    root, out = top[-1][0], []
    for k, g in enumerate(langs):
        for i, (_, _, own, r) in enumerate(by[g]):
            steps = path(trees[g], i) + path(top, k)
            folded = own
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and r["text"] is not None:
                folded = leaf(r, r["text"].translate(LOW))
            for a, b in steps:
                folded = H(a + folded + b)
            out.append((r["doc_id"], own, trees[g][-1][0], root, H("".join(a + b for a, b in steps)), folded, folded == root))
    return out


def check(spark, rows):
    got = [tuple(r) for r in merkle.op13_manifest(cases.docs(spark, rows)).collect()]
    assert sorted(got, key=repr) == sorted(brute(rows), key=repr)


def test_awkward_rows(spark):
    check(spark, cases.ROWS)
    check(spark, [(1, None, None, None, None)])
    check(spark, [(5, "Ab", "", "", 2), (3, "É Z", None, "x", None), (-7, "q", "é", None, 1)])
    assert merkle.op13_manifest(cases.docs(spark, [])).count() == 0


def test_one_group_over_many_stretches(spark, monkeypatch):
    monkeypatch.setattr(ordered.range_sorted, "__defaults__", (37, None))
    r = random.Random(2)
    rows = [(r.randrange(-500, 2000), f"Text {k}", "fr" if k % 3 else "en", "s", k) for k in range(1500)]
    check(spark, rows)


def test_tree_sizes_around_powers(spark, monkeypatch):
    monkeypatch.setattr(ordered.range_sorted, "__defaults__", (50, None))
    rows = []
    for n in (1, 7, 8, 9, 63, 64, 65, 511, 513):
        rows += [(k, f"T{k}", f"n{n}", None, None) for k in range(n)]
    check(spark, rows)


def test_many_groups_and_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(ordered.range_sorted, "__defaults__", (40, None))
    rows = [(k, f"T{k}", f"g{k % 200}", None, None) for k in range(400)] + [(1, "Same", "hot", "s", 4)] * 300 + [(None, None, "hot", None, None)] * 60
    check(spark, rows)


def test_a_stretch_leaves_few_ragged_nodes():
    for start, n, total in ((0, 100, 100), (5, 1000, 5000), (64, 640, 704), (3, 2, 9), (8, 1, 9), (700, 4, 704)):
        stretch = merkle.Stretch([H(str(k)) for k in range(n)], start, total)
        below = [place for level, k in stretch.ragged for place, _ in stretch.leaves_below(level, k, ())]
        assert sorted(below) == list(range(n))
        for level in range(len(stretch.levels)):
            assert sum(x == level for x, _ in stretch.ragged) <= 2 * (merkle.FANOUT - 1)


def test_a_changed_document_fails_alone(spark):
    rows = [(k, f"Text Number {k}", "en", "s", 1) for k in range(100)]
    got = {r["doc_id"]: r["verified"] for r in merkle.op13_manifest(cases.docs(spark, rows)).collect()}
    assert all(ok == (zlib.crc32(str(k).encode()) % 3 != 0) for k, ok in got.items())


def test_paths_of_subroots_lead_to_the_root(spark):
    proofs, known = merkle.manifest(cases.docs(spark, [(k, "x", f"l{k % 90}", "s", 1) for k in range(300)]))
    root = proofs.first()["root"]
    for r in known.collect():
        at = r["leaf"]
        for step in r["path"]:
            at = H(step["left"] + at + step["right"])
        assert at == root
