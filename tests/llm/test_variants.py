"""Spelling variants, heap clusters and b-bit classes against brute force, and over awkward rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from conftest import SF, same_rows
from pyspark.sql import functions as F

from outspan.llm import bbit_minhash as bb
from outspan.llm import centroid_heaps as ch
from outspan.llm import queries
from outspan.llm.centroid_heaps import heap_clusters
from outspan.llm.spelling_variants import near_words, spelling_variants, typed, word_counts


@pytest.mark.parametrize("name", ["op11_permuterm_variants", "op12_heap_clusters", "op13_bbit_minhash"])
def test_against_sql(spark, duck, name):
    assert same_rows(queries.QUERIES[name](spark, SF), duck, queries.ORACLE[name])


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(words):
    """Each word with all others, one by one."""
    out = {}
    for w, n in words.items():
        near = [v for v in words if v != w and one_edit(w, v)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        form = best if best is not None and words[best] >= 10 * n else None
        out[w] = [n, len(near), form, words[form] if form is not None else None]
    for w in out:
        root = w
        while out[root][2] is not None:
            root = out[root][2]
        out[w].append(root)
    return {w: tuple(v) for w, v in out.items()}


def test_variants_brute_force(spark):
    """Words over few letters have runs of equal ones, indels met at several places, chains of forms, and letters of several bytes."""
    rng = random.Random(11)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 6))): rng.choice([1, 2, 3, 30, 400, 5000]) for _ in range(300)}
    words |= {"chaina": 2, "chainb": 20, "chainbc": 200, "chainbcd": 2000, "🙂x": 5, "🙂y": 60, "": 1}
    got = spelling_variants(spark.createDataFrame(list(words.items()), "word string, n long"))
    assert {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in got.collect()} == variants(words)
    assert {r["word"]: r["root"] for r in got.filter("word LIKE 'chain%'").collect()}["chaina"] == "chainbcd"


def test_near_words_ranges_are_as_large_as_the_alphabet(spark):
    """Every pair is met once, also those that several places explain."""
    words = ["aaaa", "aaa", "aaab", "baaa", "aaaaa"]
    pairs = near_words(spark.createDataFrame([(w, 1) for w in words], "word string, n long")).collect()
    assert sorted((r["word"], r["near"]) for r in pairs) == sorted((a, b) for a in words for b in words if a != b and one_edit(a, b))


def test_word_counts_rows(spark):
    """Nulls, empty and long texts, repeated rows, only A to Z lowered, runs with marks that are no letters, clashing columns."""
    long = "Wörterbuch " * 30_000 + "x" * 200_000
    rows = [(1, "Éclairage éclairage ÉCLAIRAGE x-rayed99strings", "w"), (1, "Éclairage éclairage ÉCLAIRAGE x-rayed99strings", "w"), (2, None, None), (3, "", None), (None, "strings strings", None), (4, long, None), (None, "short tiny ab", "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, word string")
    want = {}
    for doc, text, _ in rows:
        run = ""
        for c in (text or "") + " ":
            if "a" <= c.lower() <= "z" and c.isascii() or "À" <= c <= "ÿ":
                run += c.lower() if c.isascii() else c
            elif run:
                word = typed(run, zlib.crc32(f"{'' if doc is None else doc}:{run}".encode()))
                want[word] = want.get(word, 0) + 1
                run = ""
    want = {w: n for w, n in want.items() if len(w) >= 7 and n >= 2}
    assert {r["word"]: r["n"] for r in word_counts(df).collect()} == want and len(want) >= 4
    assert word_counts(df.limit(0)).count() == 0 and spelling_variants(word_counts(df.limit(0))).count() == 0


def test_typed():
    assert typed("abc", 31 * 4) == "ac" and typed("abc", 32) == "abc" and typed("a", 0) == ""


def lloyd(rows, k, rounds, seed, scale):
    """Plain whole numbers, every distance in every round."""
    rows = [(i, [int(np.floor(np.float64(x) * scale)) for x in v]) for i, v in rows]
    order = sorted(rows, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    centre = [list(v) for _, v in order[:k]]
    near = lambda v: min((sum((x - y) ** 2 for x, y in zip(v, c, strict=True)), i) for i, c in enumerate(centre))
    for _ in range(rounds):
        at = [near(v)[1] for _, v in rows]
        for i in range(len(centre)):
            own = [v for (_, v), a in zip(rows, at, strict=True) if a == i]
            if own:
                centre[i] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return [(i, near(v)[1], near(v)[0], hashlib.sha256(",".join(map(str, centre[near(v)[1]])).encode()).hexdigest()) for i, v in rows]


@pytest.mark.parametrize("dim,k,block", [(3, 7, 16), (64, 5, 1024)])
def test_clusters_brute_force(spark, monkeypatch, dim, k, block):
    """Ties by a coarse scale, equal vectors, repeated and missing keys, vectors of other lengths, with nulls or not finite."""
    rng = np.random.default_rng(dim)
    monkeypatch.setattr(ch, "BLOCK", block)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(size=dim)]) for i in range(150)]
    rows += rows[:5] + [(None, rows[7][1]), (900, [0.0] * dim), (901, [0.0] * dim)]
    bad = [(902, None), (903, [1.0] * (dim - 1)), (904, [1.0] * (dim - 1) + [None]), (905, [float("nan")] * dim), (906, [float("inf")] * dim), (907, [])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows + bad], "id long, v array<float>, cluster int").repartition(3)
    for rounds, scale in ((0, 2), (4, 2), (5, 256)):
        got = heap_clusters(df, key="id", vector="v", k=k, rounds=rounds, dim=dim, scale=scale).collect()
        want = lloyd(rows, k, rounds, 2, scale)
        say = lambda x: sorted(map(str, x))
        assert say((r["id"], r["cluster"], r["distance"], r["centroid_sha256"]) for r in got) == say(want)
        assert {r["inertia"] for r in got} == {sum(w[2] for w in want)}
        assert {(r["cluster"], r["cluster_inertia"]) for r in got} == {(c, sum(w[2] for w in want if w[1] == c)) for c in {w[1] for w in want}}
    few = heap_clusters(df.filter("id = 900"), key="id", vector="v", k=k, dim=dim)
    assert [(r["id"], r["cluster"], r["distance"]) for r in few.collect()] == [(900, 0, 0)]
    assert heap_clusters(df.limit(0), key="id", vector="v", k=k, dim=dim).count() == 0


def test_clusters_pop_few(monkeypatch):
    """The heaps leave out what can't have changed, and what is left out is right."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 8)) * 4000
    v = np.rint(centres[rng.integers(6, size=900)] + rng.normal(size=(900, 8)) * 300).astype(np.int32)
    c = np.rint(centres + rng.normal(size=(6, 8)) * 900).astype(np.int64)
    block, offsets, state = ch.Block(v.tobytes(), None, 8, 6), np.zeros(6), None
    compared = []
    for _ in range(5):
        compared.append(block.step(c, offsets))
        assert (block.at == ch.squared(v.astype(np.int64), c).argmin(1)).all()
        total = np.array([[(block.at == i).sum(), *v[block.at == i].sum(0)] for i in range(6)])
        assert (block.sums[:, -1] == total[:, 0]).all() and (block.sums[:, :-1] == total[:, 1:]).all()
        new = [[int(x) // int(n) for x in s] if n else old for s, n, old in zip(block.sums[:, :-1].tolist(), block.sums[:, -1].tolist(), c.tolist(), strict=True)]
        offsets, c = ch._moved(c.tolist(), new, offsets), np.array(new, np.int64)
        block = ch.Block(v.tobytes(), block.state(), 8, 6)
    assert compared[0] == 900 and sum(compared[1:]) < 900


def test_clusters_large_components(spark):
    """Distances stay exact beyond what doubles hold; what doesn't fit in a long is an error."""
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.random.default_rng(2).integers(-(1 << 26), 1 << 26, (40, 4)))]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = heap_clusters(df, key="id", vector="v", k=4, rounds=2, dim=4, scale=1).collect()
    assert sorted((r["id"], r["cluster"], r["distance"], r["centroid_sha256"]) for r in got) == sorted(lloyd(rows, 4, 2, 2, 1))
    with pytest.raises(Exception, match="beyond"):
        heap_clusters(df, key="id", vector="v", k=4, rounds=2, dim=4, scale=8).count()


def classes(docs):
    """Every pair of texts by their shingles."""
    sets = []
    for _, t in docs:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set())
    label = list(range(len(docs)))
    for a in range(len(docs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * len(sets[a] | sets[b]):
                x, y = label[a], label[b]
                label = [x if z == y else z for z in label]
    least = {c: min((k for (k, _), z in zip(docs, label, strict=True) if z == c and k is not None), default=None) for c in set(label)}
    out = [(k, len(s), least[c] if s else k) for (k, _), s, c in zip(docs, sets, label, strict=True)]
    return sorted(map(str, [(*r, r[0] is not None and r[0] == r[2]) for r in out]))


def farm(rng, words, groups=6, size=40):
    """Groups of texts around one of their own, nearer and farther than the threshold, so that classes are chains and remainders."""
    docs = []
    for _ in range(groups):
        base = [rng.choice(words) for _ in range(rng.choice([30, 120, 300]))]
        for _ in range(size):
            own = list(base)
            for at in rng.sample(range(len(own)), max(1, int(len(own) * rng.choice([0.01, 0.02, 0.03, 0.05])))):
                own[at] = rng.choice(words)
            docs.append(" ".join(own))
    return docs


def test_classes_brute_force(spark, monkeypatch):
    """Chains of links around the threshold in groups of several blocks, copies, copies that differ in case and white space, awkward rows."""
    rng = random.Random(13)
    texts = farm(rng, [f"w{i}" for i in range(500)])
    rows = list(enumerate(texts, 100))
    rows += [(1, None), (2, ""), (3, " \n\t "[:3]), (4, "one"), (5, "ONE"), (6, "one two"), (7, "One\tTwo"), (8, "Été a b"), (9, "été a b"), (None, "one"), (None, "no key alone"), (None, texts[0]), (None, None), (8, texts[5]), (100, texts[0]), (100, texts[0]), (50, texts[3].upper()), (60, "w1 " * 60_000)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, node long, kept int").repartition(5)
    want = classes(rows)
    for compare, block in ((512, 256), (8, 4)):
        monkeypatch.setattr(bb, "COMPARE", compare)
        monkeypatch.setattr(bb, "BLOCK", block)
        got = sorted(map(str, [tuple(r) for r in bb.near_classes(df).collect()]))
        assert got == want
    assert bb.near_classes(df.limit(0)).count() == 0


def test_estimates():
    """Corrected shares of equal cells are near the similarity; packed cells are counted right, in NumPy and as columns."""
    rng = np.random.default_rng(4)
    for j in (0.0, 0.3, 0.85, 1.0):
        shared, own = int(2000 * j), 2000 - int(2000 * j)
        draw = lambda n: rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
        common = draw(shared)
        a, b = (bb.minima(np.concatenate([common, draw(own)])) for _ in range(2))
        x, y = bb.signature(a), bb.signature(b)
        low = np.uint64((1 << bb.BITS) - 1)
        assert bb.equal_cells(x, y) == ((a & low) == (b & low)).sum()
        true = shared / (shared + 2 * own) if own else 1.0
        assert abs(bb.estimate(int(bb.equal_cells(x, y))) - true) < 0.16
    assert bb.expected_miss() < 1e-8 and bb.estimate(bb.LEAST_EQUAL) > 0.6


def test_estimates_as_columns(spark):
    rng = np.random.default_rng(9)
    rows = [tuple(bb.signature(bb.minima(rng.integers(0, 1 << 63, 50, dtype=np.uint64))).tolist() for _ in range(2)) for _ in range(20)]
    got = spark.createDataFrame(rows, "a array<long>, b array<long>").select(bb._equal_cells(F.col("a"), F.col("b")).alias("n")).collect()
    assert [r["n"] for r in got] == [int(bb.equal_cells(np.array(a), np.array(b))) for a, b in rows]


def test_contracted_components(spark):
    """Dense groups, chains, loops, repeated and missing ends."""
    from outspan.llm.components import connected_components, contracted_components

    rng = random.Random(2)
    edges = [(a, b) for g in range(4) for a in range(g * 20, g * 20 + 20) for b in range(g * 20, a)] + [(i, i + 1) for i in range(200, 260)] + [(19, 205), (300, 300), (301, 301), (301, 302), (None, 4), (7, None)] + [(rng.randrange(1000, 1300), rng.randrange(1000, 1300)) for _ in range(150)]
    df = spark.createDataFrame(edges, "a long, b long")
    rows = lambda x: sorted(tuple(r) for r in x.select("node", "label").collect())
    assert rows(contracted_components(df)) == rows(connected_components(df))
    assert contracted_components(df.limit(0)).count() == 0
