"""Each text operator against a brute-force version, and over awkward rows: nulls, empty and long texts, ties, repeated rows, empty
tables, columns with clashing names."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from conftest import SF, same_rows
from pyspark.sql import functions as F

import corpus_pipeline
from outspan.llm import bpe, chosen_path, queries, suffix_dedup
from outspan.llm.chosen_path import expected_miss, gram_set, jaccard_classes
from outspan.llm.components import connected_components
from outspan.llm.multi_index import nearest, search_block, sign_codes
from outspan.llm.packing import pack, token_ids
from outspan.llm.pii import _automaton, find_pii, find_spans, luhn
from outspan.llm.quality_classifier import pool_adjacent_violators, quality_scores
from outspan.llm.quality_rules import quality_rules
from outspan.llm.site_style_tree import extract_main_text, main_text
from outspan.llm.suffix_dedup import difference_cover, remove_repeats, repeated_in_block, window_parts
from outspan.llm.toxicity import toxicity_scores

random.seed(5)
WORDS = [f"w{i}" for i in range(400)]
LONG = " ".join(random.choice(WORDS) for _ in range(40_000))
PASSAGE = " ".join(random.choice(WORDS) for _ in range(120))
CLASH = "n_words long, kept string, ids string, pii_spans string, removed int, class_id string, n_links int, score string, g int, scale int, runs int, key string, low int, fold string"
ROWS = [
    (1, "plain text with a few words in it. And more.", "en", "a"),
    (2, None, "en", "a"),
    (3, "", None, None),
    (4, " \n\t ", "de", "a"),
    (None, "no id here but some words anyway", "en", None),
    (5, LONG, "en", "b"),
    (6, "before " + PASSAGE + " after", "en", "b"),
    (7, "other start " + PASSAGE + " other end", "en", "b"),
    (8, "tie one two three four five six", "fr", "a"),
    (8, "tie one two three four five six", "fr", "a"),
    (9, "Übergrößen naïve 日本語 🙂 <|endoftext|> x", "de", "c"),
    (10, "a@b.co " * 3 + "1.2.3.4, 4539578763621486, +1 (555) 555-5555", "en", "a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*r, *([None] * 14)) for r in ROWS]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, {CLASH}")


@pytest.fixture(scope="module")
def tables(spark):
    return {t: spark.read.parquet(f"{SF}/{t}.parquet").toPandas() for t in ("documents", "labels", "pages")}


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def test_quality_rules_rows(docs):
    out = quality_rules(docs)
    assert out.columns[:4] == docs.columns[:4] and quality_rules(docs.select("text"), drop_text=True).filter("n_words >= 50").count() >= 3
    assert out.count() == len(ROWS) and out.filter("base_failed").count() == len(ROWS) - 3
    assert {r["doc_id"] for r in out.filter("kept").collect()} <= {5, 6, 7}
    assert quality_rules(docs.limit(0)).count() == 0
    assert out.filter("doc_id = 2").first()["n_words"] == 0


def test_quality_rules_sql(spark, duck):
    assert same_rows(queries.QUERIES["op1_quality_rules"](spark, SF), duck, queries.ORACLE["op1_quality_rules"])


def _mcd(x, floor):
    """Starts, steps and choice over the rows of one group, with dense matrices."""

    def middle(v):
        b, n = np.unique(np.floor(v * 256), return_counts=True)
        return (b[np.argmax(2 * np.cumsum(n) >= n.sum())] + 0.5) / 256

    def nearest(m, c, share):
        e = x - m
        b = np.floor(16 * np.log(np.einsum("ij,jk,ik->i", e, np.linalg.inv(c + floor), e) + 1e-6))
        u, n = np.unique(b, return_counts=True)
        return b, u[np.argmax(np.cumsum(n) >= share * len(x))]

    m = np.array([middle(v) for v in x.T])
    starts = [(m, np.diag([(1.4826 * middle(np.abs(v - k))) ** 2 for v, k in zip(x.T, m, strict=True)])), (x.mean(0), np.cov(x.T, bias=True))]
    ends = []
    for m, c in starts:
        for _ in range(10):
            b, last = nearest(m, c, 0.75)
            m, c = x[b <= last].mean(0), np.cov(x[b <= last].T, bias=True)
        ends.append((np.linalg.det(c + floor), m, c))
    _, m, c = min(ends, key=lambda e: e[0])
    c = c * 1.412
    return m, c, max(1, np.exp((nearest(m, c, 0.5)[1] + 1) / 16) / 4.351)


def test_quality_rules_against_dense_matrices(spark, tables):
    """All verdicts of whole groups against NumPy; a source whose own shape differs, outliers in it, and repetition in a clean group."""
    rng = random.Random(3)
    words = ["lorem", "ipsum", "dolor", "sit", "amet", "consectetur", "adipiscing", "elit", "sed", "eiusmod"]
    said = lambda n: " ".join(rng.choice(words) + str(rng.randrange(900)) for _ in range(n)).capitalize() + "."
    docs = [(1000 + i, "xx", "big", "\n".join(said(30) for _ in range(4))) for i in range(120)]
    docs += [(2000 + i, "xx", "tags", "\n".join(said(20).replace(" ", ", ") for _ in range(4))) for i in range(30)]
    odd = [(1, "xx", "big", "#$%! " * 300), (2, "xx", "tags", "\n".join(said(40).upper() for _ in range(3)))]
    lines = [said(12) for _ in range(10)]
    odd += [(3, "xx", "big", "\n".join(lines + [x for x in lines[:8] for _ in range(1)] + [said(60)]))]
    docs += odd
    df = spark.createDataFrame(docs, "doc_id long, lang string, source string, text string")
    got = quality_rules(df).collect()
    good = [r for r in got if not r["base_failed"]]
    x = np.array([[np.log(1 + r["word_chars"] / r["n_words"]), np.sqrt(r["n_punct"] / r["word_chars"]), np.sqrt(r["n_upper"] / r["word_chars"]), np.sqrt(r["n_repeat_words"] / (r["n_words"] + 50)), np.sqrt(r["n_dup_lines"] / (r["n_lines"] + 5))] for r in good])
    floor, source = np.diag(np.array((0.06, 0.03, 0.03, 0.095, 0.095)) ** 2), np.array([r["source"] for r in good])
    ml, cl, sl = _mcd(x, floor)
    for s in ("big", "tags"):
        at = np.flatnonzero(source == s)
        m, c, k = _mcd(x[at], floor)
        w, d = len(at) / (len(at) + 50), m - ml
        inverse = np.linalg.inv(w * c + (1 - w) * cl + w * (1 - w) * np.outer(d, d) + floor)
        for i in at:
            e = x[i] - (w * m + (1 - w) * ml)
            want = e @ inverse @ e / np.exp(w * np.log(k) + (1 - w) * np.log(sl))
            assert abs(good[i]["distance"] - want) < 1e-6 * max(1, want) and good[i]["kept"] == (want <= 30.86)
    kept = {r["doc_id"] for r in got if r["kept"]}
    assert not kept & {1, 2, 3} and len(kept) >= 148


def brute_pii(t):
    out = []
    for k, p in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, t):
            digits = re.sub("[^0-9]", "", m[0])
            if k == "ip" and any(int(x) > 255 for x in m[0].split(".")) or k == "card" and not (14 <= len(digits) <= 19 and luhn(digits)) or k == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), m.end(), k))
    return sorted(out, key=lambda s: (s[0], ["email", "ip", "card", "phone"].index(s[2])))


def test_pii_against_patterns(spark, tables):
    a = _automaton()
    for _ in range(5000):
        t = "".join(random.choice(["a", "@", ".", "1", "25", "+", "-", " ", "b.c", "1.2.3.4", "4539578763621486", "+1 (555) 555-5555", "(", ")", "%"]) for _ in range(random.randint(0, 25)))
        assert [s for s in find_spans(t, a) if s[2] in ("email", "ip", "card", "phone")] == brute_pii(t), t
    got = {r["doc_id"]: r["base_sha256"] for r in queries.op5_pii_anchor_expansion(spark, SF).collect()}
    for i, t in zip(tables["documents"].doc_id, tables["documents"].text, strict=True):
        assert got[i] == hashlib.sha256(",".join(f"{k}:{x}:{y}" for x, y, k in brute_pii(t or "")).encode()).hexdigest()


def test_pii_rows(docs):
    out = {r["doc_id"]: r for r in find_pii(docs, mask=True).collect()}
    assert len(out[10]["pii_spans"]) == 6 and "@" not in out[10]["text"] and out[2]["text"] is None and out[2]["pii_spans"] == []
    assert find_pii(docs).count() == len(ROWS) and find_pii(docs.limit(0)).count() == 0
    spans = find_spans('token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" https://me:pw@host.org/x', _automaton())
    assert {k for *_, k in spans} >= {"account", "url"}


def test_bpe_round_trip(spark, docs):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tk = Tokenizer.from_file(path)
    out = bpe.encode(docs, path, decoded="back").select("text", "ids", "back").collect()
    assert len(out) == len(ROWS)
    for r in out:
        ids = tk.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["back"] == tk.decode(ids, skip_special_tokens=False)
    assert bpe.decode(bpe.encode(docs.limit(0), path), path).count() == 0
    c = bpe.coder(path)
    for _ in range(2000):
        t = "".join(random.choice("ab'sте 日🙂\n\t 1²½_-—  the of \xa0\x85") for _ in range(random.randint(0, 40)))
        assert np.frombuffer(c.encode([t])[0], "<u4").tolist() == tk.encode(t, add_special_tokens=False).ids == token_ids(path, t).tolist()


def check_pieces(rows, ids, key):
    by = collections.defaultdict(list)
    for r in rows:
        by[r[key]].append(r)
    for k, pieces in by.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids[k])
            assert p["ids_crc32"] == zlib.crc32(ids[k][at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids[k])
    assert set(by) == set(ids)
    seqs = collections.defaultdict(list)
    for r in rows:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for s, parts in seqs.items():
        end = 0
        for o, n in sorted(parts):
            assert o == end
            end += n
        assert end == 2048 or s == max(seqs) and end <= 2048
    assert set(seqs) == set(range(len(seqs)))


def test_packing(spark, docs, tables):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(queries.tokenizer_path())
    own = lambda t: np.array([*tk.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
    d = tables["documents"]
    rows = queries.op10_mixture_packing(spark, SF).collect()
    check_pieces(rows, {i: own(t) for i, t in zip(d.doc_id, d.text, strict=True)}, "doc_id")
    total, share = collections.Counter(), collections.Counter()
    for r in rows:
        total[r["source"]] += r["length"]
    n = sum(total.values())
    half = max(r["sequence_id"] for r in rows) // 2
    for r in rows:
        if r["sequence_id"] < half:
            share[r["source"]] += r["length"]
    assert all(abs(share[s] - total[s] / n * half * 2048) <= 1024 for s in total)
    unique = docs.withColumn("doc_id", F.monotonically_increasing_id())
    texts = {r["doc_id"]: own(r["text"]) for r in unique.select("doc_id", "text").collect()}
    check_pieces(pack(unique, queries.tokenizer_path()).collect(), texts, "doc_id")
    assert pack(docs.limit(0), queries.tokenizer_path()).count() == 0


def test_packing_mixture(spark):
    """Proportions over all windows with rests in many partitions, and target shares other than the corpus'."""
    path = queries.tokenizer_path()
    rows = [(i, " ".join(WORDS[(i * 7 + k) % 400] for k in range(20)), f"s{i % 12}") for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(24)
    ids = {i: np.append(token_ids(path, t), 1).astype("<u4") for i, t, _ in rows}

    def shares_of(out):
        check_pieces(out, ids, "doc_id")
        by = collections.defaultdict(collections.Counter)
        for r in out:
            by[r["sequence_id"]][r["source"]] += r["length"]
        return by

    total = collections.Counter()
    for i, _, s in rows:
        total[s] += len(ids[i])
    by, so_far = shares_of(pack(df, path).collect()), collections.Counter()
    for w in sorted(by):
        so_far += by[w]
        done = sum(so_far.values()) / sum(total.values())
        assert all(abs(so_far[s] - total[s] * done) <= 512 for s in total)
    by = shares_of(pack(df, path, shares={"s0": 0.5}).collect())
    assert sum(by[w]["s0"] for w in (0, 1)) >= 0.3 * 4096


def brute_repeats(texts, length=400):
    seen = collections.Counter()
    data = [(t or "").encode() for t in texts]
    for x in data:
        seen.update(x[i : i + length] for i in range(len(x) - length + 1))
    out = []
    for x in data:
        cover = bytearray(len(x))
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                cover[i : i + length] = b"\x01" * length
        kept = bytes(b for b, c in zip(x, cover, strict=True) if not c)
        spans = sum(1 for i, c in enumerate(cover) if c and (i == 0 or not cover[i - 1]))
        out.append((len(x), sum(cover), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_dedup(spark, docs, tables):
    d = tables["documents"]
    want = dict(zip(d.doc_id, brute_repeats(d.text), strict=True))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in queries.op7_suffix_dedup(spark, SF).collect()}
    assert got == want
    rows = [(1, "x" * 900), (2, "ab" * 700), (3, LONG[:5000] + "q" + LONG[:450]), (4, "z" + LONG[100:900]), (5, None), (6, "x" * 401)]
    small = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in remove_repeats(small, digest=True).collect()}
    assert got == dict(zip([r[0] for r in rows], brute_repeats([r[1] for r in rows]), strict=True))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in remove_repeats(small, length=200, digest=True).collect()}
    assert got == dict(zip([r[0] for r in rows], brute_repeats([r[1] for r in rows], 200), strict=True))
    out = remove_repeats(docs)
    assert out.count() == len(ROWS) and out.filter("size(removed) > 0").count() == 2 and out.filter("doc_id = 2").first()["text"] is None
    assert remove_repeats(docs.limit(0)).count() == 0


def test_suffix_dedup_passages(spark, tables):
    """Passages under 400 bytes are counted, not removed; both lengths against brute force."""
    d = tables["documents"]
    want = {i: (*long, short[1]) for i, long, short in zip(d.doc_id, brute_repeats(d.text), brute_repeats(d.text, 250), strict=True)}
    cols = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated")
    assert {r["doc_id"]: tuple(r[c] for c in cols) for r in queries.op7_suffix_dedup(spark, SF).collect()} == want
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    short, long = word(300), word(500)
    rows = [(1, word(700) + short + word(80)), (2, short + word(900)), (3, word(450) + long), (4, long + short[:249]), (5, None), (6, word(260)), (7, word(30) + long[:399] + "Z" + short), (8, "x" * 399), (9, "y" * 260), (10, "y" * 260)]
    small = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: tuple(r[c] for c in cols) for r in remove_repeats(small, digest=True, passage=250).collect()}
    texts = [t for _, t in rows]
    assert got == {i: (*a, b[1]) for (i, _), a, b in zip(rows, brute_repeats(texts), brute_repeats(texts, 250), strict=True)}
    assert got[2][1] == 0 and got[2][4] == 300 and got[9][4] == 260
    out = {r["doc_id"]: r for r in remove_repeats(small, passage=250).collect()}
    assert out[2]["text"] == texts[1] and out[2]["n_repeated"] == 300 and out[5]["text"] is None and out[5]["n_repeated"] == 0
    with pytest.raises(ValueError):
        remove_repeats(small, passage=400)


@pytest.mark.parametrize("length,bucket", [(400, 5), (200, 5), (200, 0), (129, 2000)])
def test_suffix_dedup_splits_large_buckets(spark, monkeypatch, length, bucket):
    """A passage in 60 texts, with few kinds of surroundings at some places and their own at others: buckets over the limit are split twice."""
    monkeypatch.setattr(suffix_dedup, "BUCKET", bucket)
    rng = random.Random(length)
    passage = "".join(rng.choice("abcdefgh") for _ in range(900))
    rows = [(i, "".join(rng.choice("ABCD") for _ in range(i % 7)) + "".join(rng.choice("xy") for _ in range(i % 3)) + passage[(i % 5) * 40 : 900 - (i % 4) * 90] + "".join(rng.choice("pq") for _ in range(2 + i % 30))) for i in range(60)]
    rows += [(60, passage[:length]), (61, passage[300 : 299 + length] + "!"), (62, None), (63, rows[7][1]), (64, "é" * 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in remove_repeats(df, length=length, digest=True).collect()}
    assert got == dict(zip([r[0] for r in rows], brute_repeats([r[1] for r in rows], length), strict=True))


def test_suffix_dedup_searches_parts_again(spark, monkeypatch):
    """Only what repeats at 250 bytes is searched at 400, from where it lies in its text; parts may start inside a character."""
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("éüñabc") for _ in range(n))
    long, other = word(500), word(400)
    rows = [(1, word(900) + "é" + long + word(70)), (2, word(40) + "ü" + long + "ü" + word(800)), (3, other[:280] + word(700)), (4, word(33) + other + "x" + long[50:]), (5, None), (6, other + word(1200) + other), (7, other + word(30)), (8, word(2000))]
    rows += [(9, rows[1][1]), (10, long), (11, long)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    searched, search = {}, suffix_dedup._removed_runs

    def spy(base, *rest):
        searched[rest[-1]] = base.selectExpr("sum(octet_length(t))").first()[0]
        return search(base, *rest)

    monkeypatch.setattr(suffix_dedup, "_removed_runs", spy)
    got = {r["doc_id"]: tuple(r[c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated")) for r in remove_repeats(df, digest=True, passage=250).collect()}
    texts = [t for _, t in rows]
    assert got == {i: (*a, b[1]) for (i, _), a, b in zip(rows, brute_repeats(texts), brute_repeats(texts, 250), strict=True)}
    assert searched[250] == sum(g[0] for g in got.values()) and 0 < searched[400] <= sum(g[4] for g in got.values()) < searched[250]


def test_contexts_of_joined_texts(monkeypatch):
    """Texts that are looked at together have the contexts that each has alone; long ones go in chunks."""
    rng = random.Random(5)
    texts = [bytes(rng.choice(b"abcd") for _ in range(n)) for n in (10, 399, 400, 401, 900, 0, 3000, 650)] + [b"a" * 1000]
    alone = [(i, *row) for i, t in enumerate(texts) for row in zip(*(c.tolist() for c in suffix_dedup.contexts([t])[1:]), strict=True)]
    for small in (1 << 15, 1000, 700):
        monkeypatch.setattr(suffix_dedup, "CHUNK_SMALL", small)
        rows = list(zip(*(c.tolist() for c in suffix_dedup.contexts(texts)), strict=True))
        assert sorted(rows) == sorted(alone)
        for i, t in enumerate(texts):  # each window start lies in one context
            assert [x for r in sorted(rows, key=lambda r: r[3]) if r[0] == i for x in range(r[3], r[4] + 1)] == list(range(len(t) - 399))
    assert suffix_dedup.contexts([b"", b"x"])[0].tolist() == []


def test_equal_windows_are_not_sorted(monkeypatch):
    """Windows are sorted where those of a group differ: of two contexts that differ in a last byte, those that hold it, and the sample."""
    rng = random.Random(9)
    base = bytes(rng.randrange(256) for _ in range(900))
    sorted_rows, lexsort = [], np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys: sorted_rows.append(len(keys[0])) or lexsort(keys))
    flags = repeated_in_block(np.array([7, 7]), [base, base[:-1] + bytes([base[-1] ^ 1])], np.array([150, 150]), np.ones(2))
    assert [f.tolist() for f in flags] == [[True] * 500 + [False]] * 2
    assert sum(sorted_rows) < 2 * 501  # a sort of all windows would pass that with two keys


def test_runs_of_rows():
    flags = [[True, True, False, True], [True], [False, False], [True, False, True, True]]
    sizes = np.array([len(f) for f in flags])
    got = suffix_dedup._runs(np.array(sum(flags, [])), sizes)
    assert list(zip(*(c.tolist() for c in got), strict=True)) == [(0, 0, 1), (0, 3, 3), (1, 0, 0), (3, 0, 0), (3, 2, 3)]
    assert [len(c) for c in suffix_dedup._runs(np.zeros(5, bool), np.array([2, 3]))] == [0, 0, 0]


def test_window_parts():
    for length in range(128, 700):
        ranks, tail = window_parts(length)
        for residue in range(64):
            near = int(suffix_dedup._NEXT[residue])
            spans = [(0, 64), *((near + d, near + d + s) for d, s in ranks), *((t, t + 8) for t in tail)]
            assert set().union(*(range(*x) for x in spans)) == set(range(length))
    with pytest.raises(ValueError):
        window_parts(127)


def test_difference_cover_and_block():
    for v in (16, 64):
        d = difference_cover(v)
        assert {(a - b) % v for a in d for b in d} == set(range(v))
    base = bytes(random.randrange(256) for _ in range(700))
    other = base[:500] + bytes(random.randrange(256) for _ in range(200))
    flags = repeated_in_block(np.array([7, 7]), [base[:600], other[:600]], np.array([150, 150]), np.ones(2))
    assert [f.tolist() for f in flags] == [[True] * 101 + [False] * 100] * 2


def brute_classes(rows):
    sets = collections.defaultdict(list)
    for i, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t or "") if x]
        if w:
            sets[frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))].append(i)
    keys = list(sets)
    like = [[5 * len(a & b) >= 4 * len(a | b) and a is not b for b in keys] for a in keys]
    par = list(range(len(keys)))

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for a in range(len(keys)):
        for b in range(len(keys)):
            if like[a][b]:
                par[find(a)] = find(b)
    out = {}
    least = collections.defaultdict(lambda: 1 << 60)
    for a, k in enumerate(keys):
        least[find(a)] = min([least[find(a)], *(i for i in sets[k] if i is not None)])
    for a, k in enumerate(keys):
        for i in sets[k]:
            out[i] = (least[find(a)], sum(like[a]), len(sets[k]))
    return out


def test_chosen_path_join(spark, docs, tables):
    assert expected_miss() < 1e-3
    base = LONG.split()[:300]
    near = [(100 + i, " ".join([*base[:i], f"x{i}", *base[i + 1 :]])) for i in range(0, 300, 4)]
    rows = [*near, (500, " ".join(base)), (501, " ".join(base)), (502, "one two"), (503, "one  two\n"), (504, "one"), (505, ""), (506, None)]
    got = {r["doc_id"]: (r["class_id"], r["n_links"], r["n_same"]) for r in jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_classes(rows) | {505: (505, 0, 1), 506: (506, 0, 1)}
    d = tables["documents"]
    got = {r["doc_id"]: (r["class_id"], r["n_links"], r["n_same"]) for r in queries.op9_chosen_path_join(spark, SF).collect()}
    want = brute_classes(list(zip(d.doc_id, d.text, strict=True)))
    assert {i: got[i] for i in want} == want and set(got) == set(d.doc_id)
    assert jaccard_classes(docs).count() == len(ROWS) and jaccard_classes(docs.limit(0)).count() == 0
    assert len(gram_set("a b c d e f")) == 2 and gram_set("a b c d e").tolist() == gram_set(" a\tb c  d e\n").tolist()


def test_chosen_path_worst_case(spark, monkeypatch):
    """A set inside the other at exactly 0.8, in buckets that all go down to the last level."""
    assert chosen_path.RUNS >= 16 and expected_miss() <= 5e-5 and chosen_path.sketch_loss() < expected_miss()
    rng, missed = np.random.default_rng(1), 0
    for _ in range(3000):
        b = rng.integers(1, 1 << 63, 100, dtype=np.uint64) * np.uint64(2)
        one, other = ({tuple(p) for p in chosen_path.paths(np.sort(x))} for x in (b[:80], b))
        assert all(len(p) == chosen_path.LEVELS for p in one | other)
        missed += not one & other
    assert missed == 0
    monkeypatch.setattr(chosen_path, "BUCKET", 1)
    rows = []
    for i in range(150):
        w = [f"v{i}_{k}" for k in range(104)]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w[:84]))]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (i // 2 * 2, 1) for i in range(300)}


def test_components(spark):
    edges = [(f"n{i}", f"n{i + 1}") for i in range(20)] + [("z", "y"), ("y", "z"), ("q", "q")]
    got = {r["node"]: r["label"] for r in connected_components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert {got[f"n{i}"] for i in range(21)} == {"n0"} and got["z"] == "y" and got["q"] == "q"


def test_multi_index(spark, duck):
    rng = np.random.default_rng(1)
    codes = np.unique(rng.integers(0, 1 << 63, 600, dtype=np.uint64) | (rng.integers(0, 2, 600, dtype=np.uint64) << np.uint64(63)))
    qs = np.concatenate([codes[:20], codes[20:40] ^ np.uint64(0b1011)])
    who, entry, d = search_block(codes, np.ones(len(codes), int), qs, 5)
    for q in range(len(qs)):
        all_d = np.bitwise_count(codes ^ qs[q]).astype(int)
        kth = np.sort(all_d)[4]
        assert sorted(entry[who == q].tolist()) == np.flatnonzero(all_d <= kth).tolist()
    assert same_rows(queries.QUERIES["op3_multi_index_topk"](spark, SF), duck, queries.ORACLE["op3_multi_index_topk"])
    rows = [(i, [1.0, -1.0]) for i in range(30)] + [(99, None), (None, [1.0, 1.0]), (50, [0.5, None])]
    c = sign_codes(spark.createDataFrame(rows, "id long, v array<double>"), "v")
    got = nearest(c, c.filter("id = 7"), k=4).collect()
    assert [r["neighbor_id"] for r in sorted(got, key=lambda r: r["rank"])] == [0, 1, 2, 3]
    assert nearest(c.limit(0), c, 3).count() == 0 and nearest(c, c.limit(0), 3).count() == 0


def test_main_text(spark, tables):
    import html as h

    got = {r["page_id"]: r["text"] for r in queries.op2_site_style_tree(spark, SF).collect()}
    for i, page in zip(tables["pages"].page_id, tables["pages"].html, strict=True):
        a = re.search(r"<article>(.*?)(</article>|\Z)", page or "", re.S)
        x = re.sub(r"<[a-zA-Z/!][^>]*\Z", "", re.sub(r"</?b>", "", a[1]) if a else "")
        assert got[i] == " ".join(h.unescape(re.sub(r"<[a-zA-Z/!][^>]*>", " ", x)).split())
    page = '<body><header>Top</header><div class="sidebar-left">side</div><main><h1>A &amp; B</h1><p>One<br>two <i>th</i>ree<p>x < y<div class="share">no</div><ul><li>l1<li>l2</ul><form>f</form></main><div id="comments"><p>c</p></div><script>"</p>"</script><footer>f</footer>'
    assert main_text(page, frozenset()) == "A & B One two three x < y l1 l2"
    assert main_text("just text", frozenset()) == "just text" and main_text("", frozenset()) == ""
    same = [(f"http://h.org/{i}", f"<div class='box'>same line</div><div class='body'><p>text {i} alone</p></div>") for i in range(12)]
    rows = [*same, (None, None), ("http://h.org/x", "")]
    out = extract_main_text(spark.createDataFrame(rows, "url string, html string")).collect()
    assert sorted(r["text"] for r in out) == sorted([*(f"text {i} alone" for i in range(12)), "", ""])
    assert extract_main_text(spark.createDataFrame([], "url string, html string")).count() == 0


def test_main_text_judges_article(spark):
    """A recurring unmarked box inside the article goes, text of its own beside the article stays, and so does a repeated article."""
    page = "<body><div class='intro'>intro {i}</div><div class='strip'>Our shop</div><main><div class='body'><p>text {i} alone</p></div><div class='box'>Get our app</div></main></body>"
    deep = "<div>" * 20 + "<main><section><p>deep {i} alone</p></section></main>" + "</div>" * 20
    rows = [(f"http://h.org/{i}", page.replace("{i}", str(i))) for i in range(12)]
    rows += [(f"http://deep.org/{i}", deep.replace("{i}", str(i))) for i in range(12)]
    rows += [(f"http://copy.org/{i}", "<article><div>one text</div></article>") for i in range(12)]
    out = extract_main_text(spark.createDataFrame(rows, "url string, html string")).collect()
    want = [x for i in range(12) for x in (f"intro {i} text {i} alone", f"deep {i} alone", "one text")]
    assert sorted(r["text"] for r in out) == sorted(want)


def test_main_text_layout_classes():
    """Layout classes on the article or around it don't remove it; adverts, comments and teasers still go."""
    for around, article in (("layout no-sidebar", ""), ("sidebar", ""), ("x", "with-sidebar"), ("x", "post has-comments"), ("search", "widget"), ("search-result-page", "")):
        page = f'<div class="{around}"><article class="{article}"><div class="entry-header"><h1>Title</h1></div><p>text</p><div class="share">no</div></article><div class="ad">no</div></div>'
        assert main_text(page, frozenset()) == "Title text"
    assert main_text('<div class="search-result-page"><p>found</p></div><div class="search-box">no</div>', frozenset()) == "found"
    assert main_text('<main>story</main><div class="related"><article>no</article></div><div id="comments"><article class="comment">no</article></div>', frozenset()) == "story"
    assert main_text('<div class="site-header">no</div><nav><article>no</article></nav><div class="ad">no</div>', frozenset()) == ""


def test_main_text_probes():
    """Words of a class inside the article, teasers beside it, menus and rights of pages without one."""
    pages = {
        '<article><div class="header"><h1>Title</h1></div><p>Body.</p></article>': "Title Body.",
        '<article><p>Body.</p><p class="side-note">Note</p><div class="search-results">Found <a href=q>it</a></div></article>': "Body. Note Found it",
        '<article><p>Body.</p></article><article class="teaser"><p>Read this</p></article>': "Body.",
        "<ul><li><a href=x>Home</a></li><li><a href=y>About</a></li></ul><p>The text.</p><ul><li>see <a href=z>this</a></li></ul><div>Copyright 2020</div>": "The text. see this",
        "<ul><li><a href=x>Home</a></li></ul>": "Home",
        '<article><p>a</p><div class="comments">c</div><div class="notice">n</div><aside>x</aside><form>f</form></article>': "a",
    }
    for page, want in pages.items():
        assert main_text(page, frozenset()) == want


def test_main_text_rows(spark):
    """Repeated rows, null ids, clashing and extra columns, and a very long page."""
    long = "<article>" + "".join(f"<p>line {i}</p>" for i in range(60_000)) + "</article><footer>f</footer>"
    rows = [(1, "http://a/1", "<p>x</p>", "old", 7), (1, "http://a/1", "<p>x</p>", "old", 7), (None, None, long, None, None), (2, "//b", None, "old", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, __host long")
    out = extract_main_text(df)
    assert sorted(out.columns) == sorted(df.columns)
    got = sorted((r["text"] for r in out.collect()), key=len)
    assert got[:3] == ["", "x", "x"] and got[3] == " ".join(f"line {i}" for i in range(60_000))


def test_classifiers(spark, docs, tables):
    assert pool_adjacent_violators(np.arange(4), np.array([0.2, 0.1, 0.5, 0.4]), np.ones(4)).tolist() == pytest.approx([0.15, 0.15, 0.45, 0.45])
    known = tables["labels"].set_index("doc_id")
    q = queries.op4_rff_quality(spark, SF).toPandas().set_index("doc_id").join(known, how="inner")
    held = q[q.held_out]
    assert ((held.predicted == held.quality).mean() > 0.85) and q.score.between(0, 1).all()
    assert len(queries.op6_mil_toxicity(spark, SF).toPandas()) == len(tables["documents"])
    for f in (quality_scores, toxicity_scores):
        out = f(docs, labels(spark)).collect()
        assert len(out) == len(ROWS) and all(0 <= r["score"] <= 1 for r in out)
        assert f(docs.limit(0), labels(spark, [(1, 1, 0), (None, None, None)])).count() == 0


def test_ridge_is_the_dense_solution(spark):
    """Partition sums give the least squares of all rows at once, and features the Gaussian kernel they stand for."""
    from outspan.llm import quality_classifier as qc

    rng = np.random.default_rng(8)
    v = rng.normal(size=(300, len(qc.STATS)))
    y = (v[:, 0] + 0.3 * rng.normal(size=300) > 0).astype(float)
    rows = [(x.tolist(), float(t), int(i % 4)) for i, (x, t) in enumerate(zip(v, y, strict=True))]
    model = qc.fit(spark.createDataFrame(rows, "v array<double>, y double, fold int").repartition(5))
    fitted = np.array([r[2] < 3 for r in rows])
    assert np.allclose(model["centre"], v.mean(0)) and np.allclose(model["spread"], np.maximum(v.std(0), 0.02))
    z = qc._kernel_features(v, v.mean(0), np.maximum(v.std(0), 0.02))
    d = z.shape[1]
    ridge = qc.RIDGE * max(1.0, (z[fitted].T @ z[fitted])[0, 0])
    want = np.linalg.lstsq(np.vstack([z[fitted], np.sqrt(ridge) * np.eye(d)]), np.concatenate([y[fitted], np.zeros(d)]), rcond=None)[0]
    assert np.allclose(z @ model["beta"], z @ want, atol=1e-6)


def test_toxicity_is_the_noisy_or_likelihood(spark):
    """Weights against the same steps with slopes of the likelihood taken by finite differences."""
    from outspan.llm import toxicity as tx

    rng = random.Random(4)
    calm, bad = ["green", "river", "table", "window", "paper"], ["zorgish", "blarg"]
    docs = []
    for i in range(40):
        sentences = [" ".join(rng.choice(calm) for _ in range(4)) for _ in range(rng.randint(1, 4))]
        if i % 3 == 0:
            sentences.insert(rng.randrange(len(sentences) + 1), "you " + rng.choice(bad) + " " + rng.choice(calm))
        docs.append((". ".join(sentences) + ".", float(i % 3 == 0)))
    model = tx.fit(spark.createDataFrame(docs, "t string, y double").repartition(3))
    index = {w: i for i, w in enumerate(model["words"])}
    k, found = len(index), tx._word_sets([t for t, _ in docs], index)

    def likelihood(theta):
        total = 0.0
        for (n, f), (_, y) in zip(found, docs, strict=True):
            logits = [theta[k] + sum(theta[i] for i in w) for *_, w in f] + [theta[k]] * (n - len(f))
            clean = -sum(np.log1p(np.exp(a)) for a in logits)
            total += np.log(-np.expm1(clean)) if y else clean
        return total / len(docs)

    theta, first, second = np.zeros(k + 1), np.zeros(k + 1), np.zeros(k + 1)
    theta[k] = tx.START
    for step in range(1, tx.STEPS + 1):
        g = np.array([(likelihood(theta + e) - likelihood(theta - e)) / 2e-5 for e in 1e-5 * np.eye(k + 1)])
        g[:k] -= tx.SHRINK * theta[:k]
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        theta = theta + tx.RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8) * (1 - step / (tx.STEPS + 10))
    assert k and np.allclose(model["weights"], theta[:k], atol=2e-2) and abs(model["bias"] - theta[k]) < 2e-2


def test_toxicity_locates(spark):
    neutral = ["the cat sat here", "we saw a film", "rain fell on town", "they ate the bread"]
    rows, marks = [], []
    for i in range(400):
        s = [random.choice(neutral) for _ in range(5)]
        bad = i % 4 == 0
        if bad:
            s[i % 5] = "you total zorgish " + random.choice(["man", "fool"])
        rows.append((i, ". ".join(s) + "."))
        marks.append((i, 1, int(bad)))
    out = toxicity_scores(spark.createDataFrame(rows, "doc_id long, text string"), labels(spark, marks)).collect()
    text = dict(rows)
    for r in out:
        assert (r["score"] >= 0.5) == (r["doc_id"] % 4 == 0)
        if r["doc_id"] % 4 == 0:
            assert any("zorgish" in text[r["doc_id"]][s["start"] : s["end"]] for s in r["offending"])


def test_pipeline_stages(spark, docs):
    src = docs.select("doc_id", "text", "lang", "source", F.char_length("text").alias("n_chars"))
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, src, SF)
        assert out.columns == src.columns, name
        assert stage(spark, src.limit(0), SF).count() == 0
        if name in ("suffix_array_dedup", "pii"):
            assert out.count() == len(ROWS)
    packed = corpus_pipeline.packing(spark, src, SF)
    assert packed.filter("start = 0").count() == len(ROWS) and corpus_pipeline.packing(spark, src.limit(0), SF).count() == 0
    passage = " ".join(random.choice(["lorem", "ipsum", "dolor", "sit", "amet"]) + random.choice("abc") for _ in range(51))[:340]
    long = spark.createDataFrame([(i, f"{i} begins. {passage} Ends {i}.", "en", "a", None) for i in range(3)], src.schema)
    assert all(len(r["text"]) < 25 and r["n_chars"] == len(r["text"]) for r in corpus_pipeline.repeated_passages(spark, long, SF).collect())
    near = corpus_pipeline.near_duplicates(spark, src, SF)
    # Rows 6 and 7 share almost all of their words; 8 is there twice.
    assert {r["doc_id"] for r in near.collect()} == {1, 2, 3, 4, None, 5, 6, 8, 9, 10} and near.count() == len(ROWS) - 2


def test_pipeline_against_brute_force(spark, tables):
    from tokenizers import Tokenizer

    keep = {r["doc_id"] for r in queries.op1_quality_rules(spark, SF).filter("kept").collect()}
    rows = [(i, t) for i, t in zip(tables["documents"].doc_id, tables["documents"].text, strict=True) if i in keep]
    classes = brute_classes(rows)
    rows = [(i, t) for i, t in rows if i not in classes or classes[i][0] == i]
    a, cut, unit = _automaton(), [], 250
    data, seen = [t.encode() for _, t in rows], collections.Counter()
    for x in data:
        seen.update(x[k : k + unit] for k in range(len(x) - unit + 1))
    tk, ids = Tokenizer.from_file(queries.tokenizer_path()), {}
    from outspan.llm.pii import masked

    for (i, _), x in zip(rows, data, strict=True):
        cover = bytearray(len(x))
        for k in range(len(x) - unit + 1):
            if seen[x[k : k + unit]] > 1:
                cover[k : k + unit] = b"\x01" * unit
        t = bytes(b for b, c in zip(x, cover, strict=True) if not c).decode("utf-8", "ignore")
        t = masked(t, find_spans(t, a))
        cut.append(t)
        ids[i] = np.array([*tk.encode(t, add_special_tokens=False).ids, 1], "<u4")
    check_pieces(corpus_pipeline.run(spark, SF).collect(), ids, "doc_id")
