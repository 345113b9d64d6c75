import hashlib
import zlib

import pytest

from textquarry.llm.merkle_manifest import Block, addresses, audit, build_manifest, document_leaves, fold, prove, read_manifest, siblings, write_manifest


def h(*hexes):
    return hashlib.sha256("".join(hexes).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    said = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)]
    return h("".join(said))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def climb(tree, i, digest):
    """Root and siblings of a digest in place i, level by level."""
    found = []
    for nodes in tree[:-1]:
        run = nodes[i // 2 * 2 : i // 2 * 2 + 2]
        mine = list(run)
        mine[i % 2] = digest
        found += [n for k, n in enumerate(run) if k != i % 2]
        digest, i = h(*mine), i // 2
    return digest, found


def plain(rows):
    low = lambda v: (v is not None, v if v is not None else 0)
    parts = {}
    for r in rows:
        parts.setdefault(r[2], []).append(r)
    langs = sorted(parts, key=lambda v: (v is not None, (v or "").encode()))
    trees = {p: levels([leaf(*r) for r in sorted(parts[p], key=lambda r: (low(r[0]), leaf(*r)))]) for p in langs}
    top = levels([trees[p][-1][0] for p in langs])
    out = []
    for at, p in enumerate(langs):
        for i, r in enumerate(sorted(parts[p], key=lambda r: (low(r[0]), leaf(*r)))):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            said = leaf(*r[:3], r[3] + 1, r[4]) if hit else leaf(*r)
            sub, first = climb(trees[p], i, said)
            root, second = climb(top, at, sub)
            out.append((r[0], leaf(*r), trees[p][-1][0], top[-1][0], h(*first, *second), root, root == top[-1][0]))
    return sorted(out, key=repr)


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(3)


ODD = [
    (None, None, None, None, None), (1, "a", "en", 3, "x"), (1, "a", "en", 3, "x"), (1, "a", "en", 4, "y"), (2, "", "", 0, ""), (3, "é", "de", None, "😀" * 3000),
    (-5, "a", "en", 1, "z"), (7, "a", None, 1, "z"), (9, "a", "zz", 1, "lone"), (10, "a", "é", 1, "z"), (2**60, "a", "en", 1, "z"),
]


@pytest.mark.parametrize("more", [0, 80, 2100, 4300])
def test_rows_agree_with_a_plain_tree(spark, more):
    """Up to several blocks in a tree (a block has 1,024 leaves), full and not."""
    rows = ODD + [(i, "s", "en" if i % 40 else "fr", i, f"text {i}") for i in range(20, 20 + more)]
    docs = table(spark, rows).selectExpr("*", "1 AS tree", "2 AS block", "3 AS digest", "4 AS at")
    assert sorted(map(tuple, audit(docs).collect()), key=repr) == plain(rows)


def test_an_empty_table_has_no_tree(spark):
    assert audit(table(spark, ODD).limit(0)).collect() == []


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 9, 100, 1024])
def test_block_in_its_layout_is_the_plain_tree(n):
    leaves = [hashlib.sha256(bytes([i % 256, i // 256])).digest() for i in range(n)]
    tree = levels([d.hex() for d in leaves])
    block = Block.built(leaves, True)
    assert block.root().hex() == tree[-1][0]
    for i in {0, n // 2, n - 1}:
        root, others = climb(tree, i, leaves[i].hex())
        assert fold(leaves[i], block.path(i)).hex() == root and [s.hex() for s in siblings(block.path(i))] == others


@pytest.mark.parametrize("height", range(1, 12))
def test_addresses_are_a_permutation_with_each_subtree_in_one_piece(height):
    places = addresses(height)
    assert sorted(x for depth in places for x in depth.tolist()) == list(range(2**height - 1))
    top = height // 2
    for k in range(2**top if top else 0):  # the bottom subtrees
        inside = sorted(int(x) for d in range(top, height) for x in places[d][k << (d - top) : (k + 1) << (d - top)])
        assert inside == list(range(inside[0], inside[0] + len(inside)))


def test_a_written_manifest_proves_the_same(spark, tmp_path):
    docs = table(spark, ODD + [(i, "s", "en", i, f"text {i}") for i in range(20, 40)])
    manifest = build_manifest(document_leaves(docs))
    write_manifest(manifest, f"{tmp_path}/manifest")
    again = read_manifest(spark, f"{tmp_path}/manifest")
    assert again.root() == manifest.root()
    rows = lambda m: sorted(map(str, prove(m).collect()))
    assert rows(again) == rows(manifest)
