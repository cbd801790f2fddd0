"""Vector codes and hard negatives."""

import hashlib
import math

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerline.llm import dual_tree, hard_negatives, queries, vector_codes, vectors

ROWS = "vec_id long, embedding array<float>, label int, code string, _row string, score long"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", "y", 0) for i, v, label in rows], ROWS)


def usable(rows):
    return [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]


def stepped(v):
    return [math.floor(256 * float(x)) for x in v]


def random_rows(n, seed, width=32, labels=4):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        v = [float(np.float32(x)) for x in rng.normal(0, 0.3, width)]
        rows.append((i, v, int(rng.integers(labels)) if i % 9 else None))
    return rows


ODD = [
    (None, [0.5] * 32, 1), (7, None, 1), (8, [0.1] * 31 + [None], 1), (9, [float("nan")] + [0.1] * 31, 2), (10, [float("inf")] * 32, 2),
    (11, [0.25] * 32, None), (11, [0.25] * 32, None), (11, [-0.25] * 32, 3), (12, [0.25] * 20, 3), (13, [], 3),
]


# Vector codes


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 70), st.integers(1, 5), st.integers(0, 40), st.integers(0, 2**32 - 1))
def test_tree_finds_the_nearest_entry(entries, width, reach, seed):
    rng = np.random.default_rng(seed)
    book, points = rng.integers(-reach, reach + 1, (entries, width)), rng.integers(-reach - 3, reach + 4, (200, width))
    found, squared = vector_codes.nearest(book, vector_codes.build(book), points)
    every = ((points[:, None] - book[None]) ** 2).sum(axis=2)
    assert (found == every.argmin(axis=1)).all() and (squared == every.min(axis=1)).all()


def test_tree_leaves_entries_out():
    rng = np.random.default_rng(3)
    book = np.concatenate([rng.integers(-5, 5, (16, 4)) + 1000 * k for k in range(4)])
    seen, plain = [], vector_codes._squared
    try:
        vector_codes._squared = lambda p, e: seen.append(len(p) * len(e)) or plain(p, e)
        tree = vector_codes.build(book)
        seen.clear()
        vector_codes.nearest(book, tree, book[:16].repeat(20, axis=0))
    finally:
        vector_codes._squared = plain
    assert sum(seen) < 320 * 64


def brute_codes(rows, parts=16, entries=64, rounds=2):
    rows = usable(rows)
    width = max([1, *(len(v) for _, v, _ in rows)])
    size = -(-width // parts)
    whole = [[*stepped(v), *[0] * (parts * size - len(v))] for _, v, _ in rows]
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, rows[k][1]))
    cut = [[w[p * size : (p + 1) * size] for p in range(parts)] for w in whole]
    books = [[cut[k][p] for k in order[:entries]] for p in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(books[p])) for p, x in enumerate(c)] for c in cut]

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                own = [c[p] for c, f in zip(cut, found, strict=True) if f[p][1] == k]
                if own:
                    books[p][k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = assign()
    errors = [sum(d for d, _ in f) for f in found]
    per = {}
    for (_, _, label), e in zip(rows, errors, strict=True):
        per[label] = per.get(label, 0) + e
    said = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return sorted(
        ((i, "".join(f"{k:02x}" for _, k in f), e, per[label], said) for (i, _, label), f, e in zip(rows, found, errors, strict=True)), key=str
    )


@pytest.mark.parametrize("rows", [random_rows(150, 5) + ODD, ODD, random_rows(20, 6, width=7), ODD[1:2], []])
def test_codes_equal_brute_force(spark, rows):
    got = vector_codes.compress(frame(spark, rows))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_codes(rows)


def test_labels_meet_their_error_by_shuffle_too(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "MARKS", 0)
    rows = random_rows(120, 8) + ODD
    assert sorted((tuple(r) for r in vector_codes.compress(frame(spark, rows)).collect()), key=str) == brute_codes(rows)


def test_code_stands_for_its_entries(spark):
    books = vector_codes.train(frame(spark, random_rows(100, 9)))
    coded = vector_codes.encode(frame(spark, random_rows(100, 9)), books).collect()
    for r, (_, v, _) in zip(sorted(coded), random_rows(100, 9), strict=True):
        steps = [round(x * vectors.STEPS) for x in vector_codes.decode(r["code"], books)]
        assert sum((a - b) ** 2 for a, b in zip(steps, stepped(v), strict=True)) == r["error"]


def test_components_out_of_reach_are_an_error(spark):
    with pytest.raises(Exception, match="64-bit"):
        vector_codes.compress(frame(spark, [(1, [1e9] * 16, 1)])).collect()


@pytest.mark.parametrize("name", ["op11_vector_codes", "op13_hard_negatives"])
def test_vector_queries_equal_their_sql(spark, sf, name):
    embeddings = duckdb.read_parquet(f"{sf}/embeddings.parquet")  # noqa: F841
    want = duckdb.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, sf).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


# Hard negatives


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(1, 300), st.integers(1, 80), st.sampled_from([0, 3, 500]))
def test_descent_loses_no_pair(seed, candidates, anchors, reach):
    rng = np.random.default_rng(seed)
    c, a = rng.integers(-reach, reach + 1, (candidates, 6)) + rng.integers(0, 2, (candidates, 1)) * 900, rng.integers(-reach, reach + 1, (anchors, 6)) + 50
    trees = dual_tree.Tree(a, len(a), 20), dual_tree.Tree(c, len(c), 30)
    assert sorted(np.concatenate(trees[1].members).tolist()) == list(range(candidates))
    scores = a @ c.T
    assert (dual_tree.products(a, c) == scores).all()
    low, high = np.sort(rng.choice(scores.ravel(), 2))
    nodes = dual_tree.descend(*trees, lambda x, y, least, most: (most >= low) & (least <= high))
    met = np.zeros(scores.shape, dtype=bool)
    for x, y in zip(*nodes, strict=True):
        met[np.ix_(trees[0].members[trees[0].leaf[x]], trees[1].members[trees[1].leaf[y]])] = True
    assert met[(scores >= low) & (scores <= high)].all()


def test_descent_gives_up_far_nodes():
    rng = np.random.default_rng(2)
    c = np.concatenate([rng.integers(-9, 10, (200, 8)) + 1000 * k for k in range(-4, 5)])
    trees = dual_tree.Tree(c[:40], 40, 20), dual_tree.Tree(c, len(c), 50)
    _, met = dual_tree.descend(*trees, lambda x, y, least, most: most >= 20_000_000)
    assert 0 < len(set(met.tolist())) < len(trees[1].members) / 2


def brute_negatives(rows):
    rows = [(i, stepped(v), (int(math.fmod(label + 1, 10)) if i is not None and i % 7 == 0 else label)) for i, v, label in usable(rows) if label is not None]
    dot = lambda x, y: sum(p * q for p, q in zip(x, y, strict=False))
    order = lambda r: (-r[0], r[1] is None, r[1] or 0)
    out = []
    for k, (anchor, v, label) in enumerate(rows):
        if anchor is None or anchor % 100:
            continue
        scored = [(dot(v, w), i, own) for n, (i, w, own) in enumerate(rows) if n != k]
        for score, positive, _ in sorted((s for s in scored if s[2] == label), key=order)[:5]:
            fit = sorted((s for s in scored if s[2] != label and 30 * score <= 100 * s[0] <= 90 * score), key=order)[:10]
            out += [(anchor, positive, place, i, score, s) for place, (s, i, _) in enumerate(fit, 1)]
    return sorted(out, key=str)


def clustered(n, seed, width=16):
    rng = np.random.default_rng(seed)
    centers = rng.normal(0, 0.5, (6, width))
    return [(10 * i, [float(np.float32(x)) for x in centers[i % 6] + rng.normal(0, 0.1, width)], int(rng.integers(3)) if i % 5 else i % 6) for i in range(n)]


SMALL = {"TILE": 20, "GROUP": 16, "BLOCK": 8, "HANDFUL": 4, "GROWTH": 3}


@pytest.mark.parametrize(
    "rows",
    [
        clustered(400, 1),
        [(i * 20, v, label) for i, v, label in random_rows(200, 4)] + ODD + [(100, None, 2), (0, [0.5] * 32, 1), (0, [0.5] * 32, 1)],
        [(i * 50, [0.25] * 16, i % 2) for i in range(150)],
        ODD, [],
    ],
)
def test_negatives_equal_brute_force(spark, monkeypatch, rows):
    for name, value in SMALL.items():
        monkeypatch.setattr(hard_negatives, name, value)
    got = hard_negatives.hard_negatives(frame(spark, rows))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_negatives(rows)


@pytest.mark.parametrize(("reach", "kind"), [(200, np.float32), (1 << 20, np.float64), (1 << 26, np.int64)])
@pytest.mark.parametrize("same", [True, False])
def test_a_block_of_tiles_leaves_the_leading_rows_only(reach, kind, same):
    """One task holds a group against all its tiles: k rows per anchor and window leave it, whatever the tiles."""
    rng = np.random.default_rng(3)
    assert dual_tree.exact_kind(reach * 4.0, reach * 4.0) is kind
    rows = [{"row": i, "vec_id": None if i == 7 else i // 2, "label": int(rng.integers(3)), "vector": rng.integers(-reach, reach + 1, 16).tolist()} for i in range(400)]
    rows[11]["vector"] = rows[12]["vector"] = rows[300]["vector"] = rows[5]["vector"]
    fields = [("row", pa.int64()), ("vec_id", pa.int64()), ("label", pa.int64()), ("vector", pa.list_(pa.int32()))]
    window = pa.list_(pa.struct([("slot", pa.int32()), ("low", pa.int64()), ("high", pa.int64())]))
    dot = [[sum(p * q for p, q in zip(a["vector"], c["vector"], strict=True)) for c in rows] for a in rows[:20]]
    ends = [(0, -(1 << 62), 1 << 62)] if same else [(s, *sorted(int(x) for x in rng.choice(np.array(dot).ravel(), 2))) for s in range(3)]
    anchors = [r | {"windows": [dict(zip(("slot", "low", "high"), e, strict=True)) for e in ends[: 1 + k % 3]]} for k, r in enumerate(rows[:20])]
    tiles = pa.table({"number": pa.array(range(8), pa.int32()), "tile_rows": pa.array([rows[k::8] for k in range(8)], pa.list_(pa.struct(fields)))})
    groups = pa.table({"tiles": pa.array([list(range(8))], pa.list_(pa.int32())), "rows": pa.array([anchors], pa.list_(pa.struct([*fields, ("windows", window)])))})
    got = hard_negatives._scored(same, 5, pa.int64(), groups, tiles).to_pylist()
    want = []
    for a, scores in zip(anchors, dot, strict=True):
        for w in a["windows"]:
            fit = [(-s, c["vec_id"] is None, c["vec_id"] or 0, c["row"]) for s, c in zip(scores, rows, strict=True)
                   if w["low"] <= s <= w["high"] and (c["label"] == a["label"]) == same and (not same or c["row"] != a["row"])]
            want += [(a["row"], w["slot"], -s, None if unknown else i) for s, unknown, i, _ in sorted(fit)[:5]]
    assert sorted(((r["anchor"], r["slot"], r["score"], r["vec_id"]) for r in got), key=str) == sorted(want, key=str)


def test_files_of_tiles_hold_a_block_at_most(spark):
    """Readers take all tiles of a file into memory at once."""
    rows = spark.range(4000, numPartitions=1).selectExpr("id row", "id vec_id", "id % 3 label", "array(cast(id % 7 as int), cast(id % 11 as int)) vector")
    _, tiles = hard_negatives._place(rows, 4000, 2, 20, "rows")
    per = [r["count"] for r in tiles.groupBy("_metadata.file_path").count().collect()]
    assert sum(per) > 5 * hard_negatives.TOGETHER and max(per) <= hard_negatives.TOGETHER
