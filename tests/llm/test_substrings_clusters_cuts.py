"""Suffix dedup, centroid clustering and the fill-in-middle transformation against brute force."""

import hashlib
import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.llm import centroids, fill_in_middle, queries, suffix_dedup

NAMES = "doc_id long, text string, doc string, sign int, lo string, id string, n string, form string, cluster int, kept string, output string, spans string"


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


# --- suffix dedup


def test_longest_previous_factors_equal_their_definition():
    rng = random.Random(2)
    for _ in range(200):
        n = rng.randint(1, 40)
        raw = bytes(rng.choice(b"ab") for _ in range(n + 20))

        def shared(a, b, raw=raw):
            k = 0
            while max(a, b) + k < len(raw) and raw[a + k] == raw[b + k]:
                k += 1
            return k

        order = sorted(range(n), key=lambda i: raw[i:])
        common = np.array([0, *(shared(a, b) for a, b in zip(order, order[1:]))])
        want = [max((shared(i, j) for j in range(i)), default=0) for i in order]
        assert suffix_dedup.longest_previous(np.array(order), common).tolist() == want
        assert suffix_dedup.longest_previous(np.array(order), common, 5).tolist() == [x if x >= 5 else 0 for x in want]


def without_copies(docs, length):
    """(id, bytes, removed, spans, digest of what is left), by a table of all strings."""
    place = lambda i, p: ((1 << 63) - 1 if i is None else i, p)
    first, found = {}, []
    for i, t in docs:
        raw = (t or "").encode()
        for p in range(len(raw) - length + 1):
            first[raw[p : p + length]] = min(first.get(raw[p : p + length], (1 << 70, 0)), place(i, p))
    for i, t in docs:
        raw = (t or "").encode()
        lost = np.zeros(len(raw) + 2, bool)
        for p in range(len(raw) - length + 1):
            if first[raw[p : p + length]] < place(i, p):
                lost[p + 1 : p + 1 + length] = True
        edge = np.flatnonzero(lost[1:] != lost[:-1])
        kept = bytes(b for b, x in zip(raw, lost[1:]) if not x)
        found.append((i, len(raw), int(lost.sum()), [tuple(x) for x in edge.reshape(-1, 2).tolist()], sha(kept)))
    return sorted(found, key=repr)


def dropped(df, **given):
    found = suffix_dedup.drop_repeats(df, **given).collect()
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], [tuple(s) for s in r["spans"]], sha(bytes(r["kept"]))) for r in found), key=repr)


def passages():
    """Shared passages, texts within texts, repeated rows and ids, nulls, runs of one byte."""
    rng = random.Random(5)
    base = "".join(rng.choice("abcdefg hij\n") for _ in range(4000))
    docs = []
    for i in range(90):
        a = rng.randint(0, 3000)
        text = base[a : a + rng.randint(0, 500)] + "".join(rng.choice("xyz é漢😀") for _ in range(rng.randint(0, 150)))
        text += base[100:260] + text[:50] if rng.random() < 0.5 else ""
        docs.append((rng.choice([i, i, i, 3, None]), rng.choice([text, text, text, None, ""])))
    return docs + [(200, "x" * 2500), (201, "x" * 250), (5, docs[3][1]), docs[4], docs[4], (300, base), (301, base[7:]), (302, "y" * 99), (303, "y" * 100), (304, "y" * 100)]


@pytest.mark.parametrize("length,few", [(100, 16), (100, 1), (40, 16), (9, 1)])
def test_suffix_dedup_equals_brute_force(spark, monkeypatch, length, few):
    monkeypatch.setattr(suffix_dedup, "FEW", few)
    monkeypatch.setattr(suffix_dedup, "PIECE", 1 << 11)
    monkeypatch.setattr(suffix_dedup, "HELD", 1 << 8)
    monkeypatch.setattr(suffix_dedup, "SORTED", 1 << 9)
    docs = passages()
    df = spark.createDataFrame([(i, t, *["0"] * 1, 0, *["0"] * 4, 0, "0", "0", "0") for i, t in docs], NAMES).repartition(5)
    assert dropped(df, length=length, most=few if few < 16 else suffix_dedup.CONTEST) == without_copies(docs, length)


def test_suffix_dedup_of_hot_anchors_equals_brute_force(spark):
    """More different texts around one line than any task should get."""
    rng = random.Random(8)
    line = "".join(rng.choice("klmnop ") for _ in range(130))
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 30)))
    docs = [(i, word() + line + word()) for i in range(700)]
    assert dropped(spark.createDataFrame(docs, "doc_id long, text string").repartition(6), most=20) == without_copies(docs, 100)


def test_suffix_dedup_of_nothing_and_of_a_long_text(spark):
    assert dropped(spark.createDataFrame([], NAMES)) == []
    text = "".join(random.Random(1).choices("abcdefgh", k=40_000))
    (row,) = dropped(spark.createDataFrame([(1, text * 300)], "doc_id long, text string"))
    assert row == (1, 12_000_000, 11_960_000, [(40_000, 12_000_000)], sha(text))


# --- centroid clustering


def clustered(rows, dim, k, rounds, seed=2):
    fits = lambda v: v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if fits(v)]
    cents = [v for _, v in sorted(kept, key=lambda r: (sha(f"{seed}:{'' if r[0] is None else r[0]}"), r[1]))[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v: min((far(v, c), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in kept:
            own[nearest(v)[1]].append(v)
        cents = [[sum(x) // len(own[j]) for x in zip(*own[j])] if own[j] else c for j, c in enumerate(cents)]
    found = [(i, *nearest(v)) for i, v in kept]
    sums = defaultdict(int)
    for _, d, c in found:
        sums[c] += d
    return sorted(((i, c, d, sums[c], sum(sums.values()), sha(",".join(map(str, cents[c])))) for i, d, c in found), key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("dim,k,block", [(4, 7, 16), (3, 200, 4096), (1, 3, 8)])
def test_centroids_equal_brute_force(spark, dim, k, block):
    rng = np.random.default_rng(3)
    vectors = [[float(x) for x in v] for v in np.concatenate([rng.normal(0, 1, (80, dim)), rng.integers(-2, 2, (60, dim)) / 4, np.zeros((20, dim))])]
    rows = [(int(i) if i % 9 else None, v) for i, v in enumerate(vectors)]
    rows += [(500, None), (501, []), (502, [1.0] * (dim + 1)), (503, [float("nan")] * dim), (504, [float("-inf")] * dim), (505, [None] * dim), (1, vectors[1]), (1, vectors[2]), (506, [1e5] * dim)]
    df = spark.createDataFrame([(i, v, 0, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, cluster int, tree string, id int").repartition(4)
    found = centroids.centroid_clusters(df, dim=dim, k=k, rounds=4, block=block, leaf=4)
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert rows_of(found) == clustered(rows, dim, k, 4)


def test_centroids_of_nothing_and_of_vectors_too_large(spark):
    shape = "vec_id long, embedding array<double>"
    assert centroids.centroid_clusters(spark.createDataFrame([], shape), dim=2).count() == 0
    assert rows_of(centroids.centroid_clusters(spark.createDataFrame([(1, [1e300, 0.0]), (2, [1.0, 2.0])], shape), dim=2))[0][:3] == (2, 0, 0)


def test_whole_balls_and_exact_leaves_give_the_nearest_centroids():
    rng = np.random.default_rng(0)
    given = 0
    for turn in range(150):
        n, dim, k = int(rng.integers(1, 400)), int(rng.integers(1, 8)), int(rng.integers(1, 12))
        top = int(rng.choice([3, 50, 5000, centroids.largest(dim) - 2]))
        v = rng.integers(-top, top, (n, dim))
        v = v[rng.integers(0, min(n, 7), n)] if turn % 3 == 0 else v
        cents = v[rng.integers(0, n, k)] + rng.integers(-1, 2, (k, dim))
        tree = centroids.Tree.unpacked(centroids.build(np.arange(n), np.ones(n, bool), v, 4).packed())
        far = [[sum((int(a) - int(b)) ** 2 for a, b in zip(x, y)) for y in cents] for x in v]
        want = np.array([min(range(k), key=lambda j: (row[j], j)) for row in far])
        cluster, distance = centroids.assigned(tree, cents)
        assert (cluster == want[tree.ids]).all() and distance.tolist() == [far[i][want[i]] for i in tree.ids]
        totals, counts = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        given += centroids.summed(tree, cents, totals, counts)
        assert all(counts[j] == (want == j).sum() and (totals[j] == v[want == j].sum(0)).all() for j in range(k))
    assert given > 1000  # vectors that went to a centroid without being compared


# --- fill in the middle

UNITS = {"char": "(?s).", "word": "[ \t\n\x0b\x0c\r]*[^ \t\n\x0b\x0c\r]+|[ \t\n\x0b\x0c\r]+", "line": "[^\n]*\n|[^\n]+"}


def test_cuts_by_checkpoints_equal_cuts_by_units(monkeypatch):
    monkeypatch.setattr(fill_in_middle, "PIECE", 7)
    rng = random.Random(1)
    for _ in range(600):
        text = "".join(rng.choice("ab é漢😀\n\t") for _ in range(rng.randint(0, 40)))
        for unit, pattern in UNITS.items():
            units = re.findall(pattern, text)
            found = fill_in_middle.checkpoints(np.frombuffer(text.encode(), np.uint8), unit, rng.choice([1, 2, 3, 5]))
            assert found.n == len(units)
            for k in range(len(units) + 2):
                before = "".join(units[:k])
                assert found.cut(k) == (len(before.encode()), len(before))


def filled(i, text, unit="char", seed=1):
    text = text or ""
    units, s = re.findall(UNITS[unit], text), sha(f"{seed}:{'' if i is None else i}")
    h = [int(s[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return i, n, "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return i, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return i, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("unit", list(UNITS))
def test_fill_in_middle_equals_brute_force(spark, unit):
    rng = random.Random(4)
    texts = [None, "", "a", "<P", "<P>x", "a<<S", "<M>", "\x00é", "S><P"] * 3 + ["".join(rng.choice("ab <PSM>é漢😀\n") for _ in range(rng.randint(0, 90))) for _ in range(150)]
    rows = [(rng.choice([k, k, None]), t) for k, t in enumerate(texts)] + [(7, "twice"), (7, "twice")]
    df = spark.createDataFrame([(i, t, *["0"] * 1, 0, *["0"] * 4, 0, "0", "0", "0") for i, t in rows], NAMES).repartition(3)
    made = fill_in_middle.fill_in_middle(df, unit=unit)
    assert rows_of(made) == sorted((filled(i, t, unit) for i, t in rows), key=repr)
    back = made.select("doc_id", fill_in_middle.restored("output", "form").alias("text"))
    assert rows_of(back) == sorted(((i, t or "") for i, t in rows), key=repr)
    assert {r["form"] for r in made.collect()} == {"plain", "psm", "spm"}


def test_fill_in_middle_of_nothing_and_of_a_long_text(spark):
    assert fill_in_middle.fill_in_middle(spark.createDataFrame([], NAMES)).count() == 0
    text = "añ漢😀 \n" * 1_000_000
    for i in range(3):
        (row,) = fill_in_middle.fill_in_middle(spark.createDataFrame([(i, text)], "doc_id long, text string")).collect()
        assert tuple(row) == filled(i, text)
    with pytest.raises(ValueError):
        fill_in_middle.fill_in_middle(spark.createDataFrame([], NAMES), markers=("<", "<S>", "<M>"))


def test_queries_name_every_row(spark, sf_dir):
    for name, of in (("op11_suffix_dedup", "documents"), ("op13_fill_in_middle", "documents")):
        ids = lambda df: sorted(r[0] for r in df.select("doc_id").collect())
        assert ids(queries.queries()[name](spark, sf_dir)) == ids(spark.read.parquet(f"{sf_dir}/{of}.parquet"))
    found = queries.queries()["op13_fill_in_middle"](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), "doc_id")
    assert found.filter(F.col("restored_sha256") != F.sha2(F.coalesce("text", F.lit("")), 256)).count() == 0
