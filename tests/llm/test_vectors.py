import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rowproof.llm import cover_tree, multi_index, vectors


def brute(rows, cosine=0.95):
    def good(v):
        return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    ids, parent = [r[0] for r in rows], {}
    links = [0] * len(rows)

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if good(v) else None for _, v in rows]
    for i in range(len(rows)):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine:
                links[i] += 1
                links[j] += 1
                p, q = sorted((find(ids[i]), find(ids[j])))
                parent[q] = p
    return sorted((ids[i], links[i], find(ids[i])) for i in range(len(rows)))


def rows(n=300, dims=12):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(n, dims))
    base[50:120] = base[0] + 0.12 * rng.normal(size=(70, dims))
    base[120:140] = base[1] * rng.uniform(0.5, 3, (20, 1))
    base[140:150] = base[2]
    out = [(i, [float(x) for x in np.float32(v)]) for i, v in enumerate(base)]
    return out + [(n, None), (n + 1, [0.0] * dims), (n + 2, [float("nan")] * dims), (n + 3, [float("inf")] + [1.0] * (dims - 1)), (n + 4, [1.0, 0.0]), (n + 5, [2.0, 0.01]), (n + 6, []), (n + 7, [None] + [1.0] * (dims - 1))]


@pytest.mark.parametrize("block", [4096, 40])
def test_cover_tree_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(cover_tree, "BLOCK", block)
    monkeypatch.setattr(cover_tree, "SPREAD", 1)
    monkeypatch.setattr(cover_tree, "GROUP", 2)
    data = rows()
    df = spark.createDataFrame([(i, v, 0, 1) for i, v in data], "vec_id long, embedding array<float>, n int, cell int").repartition(3)
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in cover_tree.near_vectors(df).collect())
    assert got == brute(data)


@pytest.mark.parametrize("cosine", [0.7, 0.99, 0.9999])
def test_cover_tree_at_other_thresholds_and_in_small_pieces(spark, monkeypatch, cosine):
    monkeypatch.setattr(cover_tree, "BLOCK_BYTES", 8 * 12 * 40)
    monkeypatch.setattr(cover_tree, "HELD_BYTES", 2048)
    data = rows(220)
    rng = np.random.default_rng(7)
    close = np.array(data[5][1]) + 0.01 * rng.normal(size=(30, 12))
    data += [(1000 + i, [float(x) for x in np.float32(v)]) for i, v in enumerate(close)]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in cover_tree.near_vectors(spark.createDataFrame(data, "vec_id long, embedding array<float>"), cosine).collect())
    assert got == brute(data, cosine)


def test_radii_and_blocks_are_bounded():
    for distance in (1.9, 0.6, 0.32, 0.15, 0.01, 1e-4):
        r = cover_tree.radii(distance)
        assert r[-1] < distance and (len(r) == 3 or r[-2] >= distance) and all(a == 2 * b for a, b in zip(r, r[1:], strict=False))
    assert cover_tree.block_size(100, 64) == cover_tree.BLOCK and cover_tree.block_size(51_282, 64) == 9058
    for n, dims in ((10**9, 64), (10**12, 4096), (5, 10**8)):
        assert 1 <= cover_tree.block_size(n, dims) <= max(1, cover_tree.BLOCK_BYTES // (8 * dims))
    x = np.random.default_rng(1).normal(size=(300, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = cover_tree.nearest_centres(x, [1.0, 0.5, 0.25, 0.125])
    for r, c in zip([1.0, 0.5, 0.25, 0.125], near, strict=True):
        assert np.linalg.norm(x - x[c], axis=1).max() <= r + 1e-9
        centres = x[np.unique(c)]
        apart = np.linalg.norm(centres[:, None] - centres[None], axis=2) + 9 * np.eye(len(centres))
        assert apart.min() > r - 1e-9


def side(x, ids, n=None, wide=None):
    n = pa.array(np.ones(len(ids), np.int64) if n is None else n)
    v = vectors.packed(pa.ListArray.from_arrays(np.arange(0, x.shape[1] * len(ids) + 1, x.shape[1], dtype=np.int32), pa.array(x[ids].ravel())), n.is_valid(), "f8")
    return cover_tree._Side(cover_tree._planted(pa.table({"rep": ids, "h": ids, "n": n, "v": v}), cover_tree.radii(0.3163), "f8"), wide, "f8")


@pytest.mark.parametrize("kind", ["tight", "edge", "loose", "centres", "flat"])
@pytest.mark.parametrize("held", [64 << 20, 4096])
def test_blocks_of_any_structure(monkeypatch, kind, held):
    """Numbers of links and what links join equal brute force; few rows and nodes are looked at pair by pair."""
    monkeypatch.setattr(cover_tree, "HELD_BYTES", held)
    rng, n = np.random.default_rng(11), 700
    one, some = rng.normal(size=24), rng.normal(size=(30, 24))
    x = {
        "tight": lambda: one + 0.05 * rng.normal(size=(2 * n, 24)),
        "edge": lambda: one + 0.23 * rng.normal(size=(2 * n, 24)),
        "loose": lambda: one + 0.6 * rng.normal(size=(2 * n, 24)),
        "centres": lambda: some[rng.integers(0, 30, 2 * n)] + 0.25 * rng.normal(size=(2 * n, 24)),
        "flat": lambda: rng.normal(size=(2 * n, 3)) @ rng.normal(size=(3, 24)),
    }[kind]()
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    times = rng.integers(1, 4, 2 * n)
    times[:3] = 1 << 30
    paired, cosines = [], cover_tree._cosines
    monkeypatch.setattr(cover_tree, "_cosines", lambda x, i, y, j: paired.append(len(i)) or cosines(x, i, y, j))
    for wide in (None, cover_tree.directions(x, 0.3163)):
        a, b = (side(x, ids, times[ids], wide) for ids in (np.arange(n), np.arange(n, 2 * n)))
        paired.clear()
        edges = np.concatenate([cover_tree._pair(a, b, 0.95), cover_tree._pair(a, a, 0.95)], axis=1)
        assert sum(paired) < 0.3 * 2 * n * n
        link = x @ x.T >= 0.95
        np.fill_diagonal(link, False)
        assert (a.links == link[:n] @ times).all() and (b.links == link[n:, :n] @ times[:n]).all()
        link[n:, n:] = False
        low = cover_tree._lowest(2 * n, *np.nonzero(link))
        assert (cover_tree._lowest(2 * n, *edges) == low).all() and edges.shape[1] <= 3 * n


def test_blocks_without_structure_are_met_in_whole_matrices(monkeypatch):
    """Vectors far apart, some of them within the widest radius, and near copies: no node is looked at by itself for each pair."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(6000, 48))
    x[3000:3100] = x[:100] + 0.15 * rng.normal(size=(100, 48))
    x[100:140] = x[3000] + 0.1 * rng.normal(size=(40, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)

    a, b = side(x, np.arange(3000)), side(x, np.arange(3000, 6000))
    asked, held = [], cover_tree.CoverTree.held
    monkeypatch.setattr(cover_tree.CoverTree, "held", lambda t, level, node: asked.append(node) or held(t, level, node))
    link = x[:3000] @ x[3000:].T >= 0.95
    edges = cover_tree._pair(a, b, 0.95)
    assert link.sum() > 50 and (a.links == link.sum(axis=1)).all() and (b.links == link.sum(axis=0)).all()
    assert len(asked) < 6000
    linked = set(np.flatnonzero(link.any(axis=1)).tolist()) | set((3000 + np.flatnonzero(link.any(axis=0))).tolist())
    assert set(edges.ravel().tolist()) == linked
    own = x[:3000] @ x[:3000].T >= 0.95
    cover_tree._pair(c := side(x, np.arange(3000)), c, 0.95)
    assert (c.links == own.sum(axis=1) - 1).all()


@pytest.mark.parametrize("kind", ["f4", "f8"])
def test_packed_vectors(kind):
    data = [[1.0, -0.0], None, [0.0, -0.0], [], [2.0, None], [1e30, float("inf")], [float("nan"), 1.0], [3.0, 4.0], [5.0, 6.0], [1.0, 0.0], [7.0, 8.0]]
    column = pa.array([[9.0], *data, [9.0]], pa.list_(pa.float32() if kind == "f4" else pa.float64())).slice(1, len(data))
    got = vectors.packed(column, pa.array([i != 8 for i in range(len(data))]), kind)
    assert got.is_valid().to_pylist() == [i in (0, 7, 9, 10) for i in range(len(data))] and got[0] == got[9]
    assert vectors.unpacked(got.drop_null(), kind).tolist() == [[1, 0], [3, 4], [1, 0], [7, 8]]
    assert vectors.unpacked(pa.chunked_array([got.slice(9, 2), got.slice(7, 1)]), kind).tolist() == [[1, 0], [7, 8], [3, 4]]
    assert vectors.packed(column.slice(0, 0), pa.array([], pa.bool_()), kind).to_pylist() == []


def test_directions_only_refute():
    rng = np.random.default_rng(6)
    for x in (rng.normal(size=(900, 64)), rng.normal(size=(900, 4)) @ rng.normal(size=(4, 40)) + 0.2 * rng.normal(size=(900, 40)), rng.normal(size=(5, 30)), np.ones((3, 1)), rng.normal(size=(700, 3))):
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for distance in (0.3163, 0.8, 1.3):
            wide = cover_tree.directions(x, distance)
            if wide is not None:
                y = cover_tree._parts(x, wide)
                assert y.shape[1] <= x.shape[1] and (y @ y.T >= x @ x.T - cover_tree.SLACK / 2).all()
    x = rng.normal(size=(2000, 64))
    assert cover_tree.directions(x / np.linalg.norm(x, axis=1, keepdims=True), 0.3163).shape[1] <= 32


def test_spanning_links_join_what_links_join():
    rng = np.random.default_rng(8)
    for n in (1, 30, 400):
        path = np.stack([np.arange(n), np.arange(1, n + 1)]) * 3
        edges = [path[:, rng.permutation(n)], 5000 + rng.integers(0, 300, (2, 200))]
        got = cover_tree._spanning(edges)
        parent = {}

        def find(x, parent=parent):
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        for u, v in np.concatenate(edges, axis=1).T.tolist():
            p, q = sorted((find(u), find(v)))
            parent[q] = p
        assert sorted(map(tuple, got.T.tolist())) == sorted((x, find(x)) for x in list(parent) if find(x) != x)


def test_cover_tree_edges(spark):
    schema = "vec_id long, embedding array<float>"
    assert cover_tree.near_vectors(spark.createDataFrame([], schema)).count() == 0
    got = cover_tree.near_vectors(spark.createDataFrame([(1, None)], schema)).collect()
    assert [tuple(r) for r in got] == [(1, 0, 1, True)]


def test_different_vectors_of_one_id(spark):
    schema = "vec_id long, embedding array<float>"
    data = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.01]), (3, [0.0, 0.99]), (None, [0.0, 1.0])]
    got = sorted(((r.vec_id or 0), r.n_links, r.component_id or 0) for r in cover_tree.near_vectors(spark.createDataFrame(data, schema)).collect())
    assert got == [(0, 0, 0), (1, 0, 1), (1, 2, 1), (2, 2, 1), (3, 2, 1)]


def nearest(data, k=20, step=20):
    ok = [(i, np.array(v, float)) for i, v in data if v is not None and len(v) == len(data[0][1]) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    ids, x = np.array([i for i, _ in ok]), np.stack([v for _, v in ok])
    out = {}
    for i, v in ok:
        if i % step == 0:
            s = (x * v).sum(axis=1)
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def test_multi_index_small_is_exact(spark):
    data = rows()
    df = spark.createDataFrame([(i, v, "x") for i, v in data], "vec_id long, embedding array<float>, query_id string").repartition(3)
    got = {}
    for r in multi_index.MultiIndex(df).search(F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    expected = nearest(data)
    assert {k: [i for i, _ in v] for k, v in got.items()} == {k: [i for i, _ in v] for k, v in expected.items()}
    assert all(abs(a[1] - b[1]) < 1e-9 for k in got for a, b in zip(got[k], expected[k], strict=True))


def test_multi_index_edges(spark):
    schema = "vec_id long, embedding array<float>"
    assert multi_index.MultiIndex(spark.createDataFrame([], schema)).search(F.lit(True)).count() == 0
    few = spark.createDataFrame([(20, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5])], schema)
    got = [tuple(r) for r in multi_index.MultiIndex(few).search(F.col("vec_id") % 20 == 0).orderBy("rank").collect()]
    assert got == [(20, 1, 1, 0.5), (20, 2, 2, 0.5)]


def test_passed_is_the_full_order():
    rng = np.random.default_rng(2)
    for _ in range(20):
        a, b = rng.normal(size=rng.integers(1, 90)), rng.normal(size=rng.integers(1, 90))
        counts = rng.integers(0, 3, (len(a), len(b)))
        counts[0, 0] = 1
        enough = int(rng.integers(1, max(2, counts.sum())))
        cells, stop = multi_index.passed(a, b, counts, enough)
        order = sorted(((a[i] + b[j], i * len(b) + j) for i in range(len(a)) for j in range(len(b)) if counts[i, j]), reverse=True)
        held, expected = 0, set()
        for _, cell in order:
            expected.add(cell)
            held += counts.ravel()[cell]
            if held >= enough:
                break
        assert set(cells.tolist()) == expected
        assert all((a[c // len(b)] + b[c % len(b)] >= stop) == (c in expected) for _, c in order)


def test_repeated_rows_and_lengths(spark):
    schema = "vec_id long, embedding array<float>"
    data = [(20, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, [0.25, 0.5]), (3, [0.0, 2.0]), (None, [9.0, 9.0]), (40, [1.0, 2.0, 3.0]), (41, [1.0, 0.0, 0.0]), (60, [2.0]), (61, [4.0])]
    got = sorted(tuple(r) for r in multi_index.MultiIndex(spark.createDataFrame(data, schema)).search(F.col("vec_id") % 20 == 0).collect())
    assert got == [(20, 1, 1, 0.5), (20, 2, 2, 0.25), (20, 3, 3, 0.0), (40, 1, 41, 1.0), (60, 1, 61, 8.0)]


@pytest.mark.parametrize("spread", [0.0, 0.05])
def test_rows_of_one_id_hide_no_candidates(spark, monkeypatch, spread):
    """5,000 rows of one id, equal or different, and 60 other ids: each query gets 20 different ids, the nearest ones."""
    monkeypatch.setattr(multi_index, "LEAST", 200)
    rng = np.random.default_rng(9)
    base = rng.normal(size=(61, 8))
    base[20] = 3 * base[60]
    data = [(i, base[i].tolist()) for i in range(60)] + [(1000, (base[20] + spread * rng.normal(size=8)).tolist()) for _ in range(5000)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for r in multi_index.MultiIndex(df, centroids=64).search(F.col("vec_id") % 20 == 0, share=0.02).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == {0, 20, 40, 1000}
    for q, found in got.items():
        best = {}
        for i, v in data:
            if i != q:
                best[i] = max(best.get(i, -1e9), max(float(np.dot(v, w)) for j, w in data[: 60 if q < 60 else 61] if j == q) if q < 60 else -1e9)
        assert len(found) == 20 == len({i for i, _ in found})
        if q == 20:  # its neighbours are the copies: the rest is still searched
            assert found[0][0] == 1000 and [i for i, _ in found] == sorted(best, key=lambda i: (-best[i], i))[:20]


@pytest.mark.parametrize("block", [4096, 150])
def test_recall_and_share_scored(spark, monkeypatch, block):
    monkeypatch.setattr(multi_index, "BLOCK", block)
    d = "/root/testdata/sf0.1"
    df = spark.read.parquet(f"{d}/embeddings.parquet")
    data = [(r.vec_id, r.embedding) for r in df.orderBy("vec_id").collect()]
    expected = nearest(data)
    index = multi_index.MultiIndex(df)
    got = {}
    for r in index.search(F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    recall = np.mean([len(got[q] & {i for i, _ in v}) / len(v) for q, v in expected.items()])
    part = index.parts[0]
    scored = []
    for q in (np.array(v, float) for i, v in data if i % 20 == 0):
        cells, _ = multi_index.passed(q[: part.cut] @ part.books[0].T, q[part.cut :] @ part.books[1].T, part.counts, int(multi_index.SHARE * part.n) + 21)
        scored.append(part.counts.ravel()[cells].sum() / part.n)
    print("recall", recall, "share scored", np.mean(scored), "blocks", len(part.pieces))
    assert recall >= 0.9 and max(scored) < 1 / 3


def test_blocks_and_large_cells(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "QUERIES", 16)
    monkeypatch.setattr(multi_index, "BLOCK", 50)
    data = rows()
    index = multi_index.MultiIndex(spark.createDataFrame(data, "vec_id long, embedding array<float>").repartition(3), centroids=4)
    part = index.parts[-1]
    assert len(part.pieces) > 2 and part.pieces.max() > 1
    got = {}
    for r in index.search(F.lit(True), least=10_000).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    same_length = {q: [i for i, _ in v] for q, v in nearest(data, step=1).items()}
    assert {q: x for q, x in got.items() if q in same_length} == same_length
