import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from seqloom.llm import merkle

DOCS = "doc_id bigint, source string, lang string, n_chars bigint, text string, g int, block int, rank string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(*values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    """All levels by the plain rule."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 2])) for i in range(0, len(levels[-1]), 2)])
    return levels


def plain(rows, changed):
    """(doc_id, leaf, subroot, root, proof, folded, verified) by the plain rule; ``changed``: which rows are tampered with."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda n: (n is not None, (n or "").encode()))
    trees = {}
    for n in names:
        groups[n].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r[:5])))
        trees[n] = tree([leaf(*r[:5]) for r in groups[n]])
    crown = tree([trees[n][-1][0] for n in names])
    out = []
    for g, n in enumerate(names):
        for i, r in enumerate(groups[n]):
            start = h = leaf(*r[:5])
            if changed(r):
                h = leaf(*r[:3], r[3] + 1, r[4])
            proof = ""
            for levels, at in ((trees[n], i), (crown, g)):
                for level in levels[:-1]:
                    other = level[at ^ 1] if at ^ 1 < len(level) else ""
                    proof += other
                    h = sha(other + h if at & 1 else h + other)
                    at >>= 1
            out.append((r[0], start, trees[n][-1][0], crown[-1][0], sha(proof), h, h == crown[-1][0]))
    return sorted(out, key=str)


def corpus(n):
    rng = random.Random(n)
    rows = [(rng.randrange(10**12), f"s{rng.randrange(3)}", rng.choice(["en", "en", "é", "🦆", "", None]), rng.randrange(99), "wörd " * rng.randrange(9)) for _ in range(n)]
    rows += [(2**53 + 1, None, "en", None, None), (2**53 + 3, "a:", "en", 0, ""), (None, "x", "en", 1, "x"), (None, "x", "en", 1, "x"), (7, "x", "solo", 2**63 - 1, "t\0" * 3000)]
    return rows + rows[:3]


@pytest.mark.parametrize("n,height", [(0, 10), (9, 1), (60, 2), (300, 3), (300, 10)])
def test_proofs_equal_plain_rule(spark, n, height):
    rows = corpus(n)
    df = spark.createDataFrame([(*r, 1, 2, "r") for r in rows], DOCS).repartition(3)
    tampered = lambda r: r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).alias("n_chars")
    when = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0) & F.col("n_chars").isNotNull()
    changed = F.when(when, merkle.leaf(F.col("doc_id"), F.col("source"), F.col("lang"), more, F.col("text")))
    got = merkle.verified(merkle.proofs(merkle.build(df, changed=changed, height=height))).collect()
    assert sorted(map(tuple, got), key=str) == plain(rows, tampered)


def test_one_leaf_and_empty(spark):
    df = spark.createDataFrame([(1, "s", None, 4, "text", 1, 2, "r")], DOCS)
    (r,) = merkle.verified(merkle.proofs(merkle.build(df))).collect()
    assert r.leaf == r.subroot == r.root == r.folded_root == leaf(1, "s", None, 4, "text") and r.proof_sha256 == sha("") and r.verified
    assert merkle.verified(merkle.proofs(merkle.build(df.where("false")))).count() == 0


@pytest.mark.parametrize("height", [0, 1, 2, 5, 10])
def test_addresses_are_van_emde_boas(height):
    at = merkle.addresses(height)
    assert sorted(np.concatenate(at).tolist()) == list(range((2 << height) - 1))

    def order(levels):
        """Nodes (depth, place) by recursion over subtrees."""
        if levels == 1:
            return [(0, 0)]
        top = levels // 2
        head, tail = order(top), order(levels - top)
        return head + [(top + d, (q << d) + p) for q in range(1 << top) for d, p in tail]

    assert [int(at[d][p]) for d, p in order(height + 1)] == list(range((2 << height) - 1))


def test_blocks_are_stored_whole(spark):
    rows = corpus(40)
    held = merkle.build(spark.createDataFrame([(*r, 1, 2, "r") for r in rows], DOCS), height=2)
    assert len(held.trees) == 3 and held.trees[-1].where("block > 0").isEmpty()
    for r in held.trees[0].collect():
        assert len(r.nodes) == ((2 << r.height) - 1) * merkle.SIZE and r.top == r.nodes[: merkle.SIZE]
