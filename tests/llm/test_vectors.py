import numpy as np

from factloom.llm.embedding_dedup import embedding_neardup, table_plan
from factloom.llm.hilbert import hilbert_index, nearest_neighbours, search_plan

SCHEMA = "vec_id long, embedding array<float>, score string"


def rows(n=300, d=16, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d)).astype(np.float32)
    x[100:140] = x[0] + rng.standard_normal((40, d)).astype(np.float32) * 0.12  # a group of near copies
    x[200:220] = x[1]  # exact copies
    out = [(i, v.tolist(), "s") for i, v in enumerate(x)]
    bad = [None, [0.0] * d, [float("nan")] * d, [float("inf")] + [0.0] * (d - 1), [None] + [1.0] * (d - 1), [], [1.0, 2.0], [1.0, 2.0]]
    return out + [(1000 + i, v, "s") for i, v in enumerate(bad)]


def usable(v):
    return bool(v) and all(c is not None and np.isfinite(c) for c in v) and any(v)


def test_dedup_against_brute_force(spark):
    data = rows()
    good = [(i, np.array(v, float)) for i, v, _ in data if usable(v)]
    links = {i: set() for i, _, _ in data}
    for i, a in good:
        for j, b in good:
            if i != j and len(a) == len(b) and a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= 0.95:
                links[i].add(j)
    comp = {i: i for i in links}
    for _ in range(20):
        for i in links:
            comp[i] = min([comp[i], *(comp[j] for j in links[i])])
    for block in (512, 8):
        got = {r.id: (r.n_links, r.component_id, r.kept) for r in embedding_neardup(spark.createDataFrame(data, SCHEMA), block=block).collect()}
        assert got == {i: (len(links[i]), comp[i], comp[i] == i) for i in links}


def test_plan_keeps_its_recall():
    for n in (2, 1000, 10**6, 10**9):
        signs, tables = table_plan(n, 0.95, 0.999)
        p = (1 - np.arccos(0.95) / np.pi) ** signs
        assert 1 - (1 - p) ** tables >= 0.999


def test_curve_visits_every_cell_by_single_steps():
    for dims, bits in ((2, 4), (3, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(2**bits)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
        index = hilbert_index(cells, bits)
        assert sorted(index) == list(range(len(cells)))
        assert set(np.abs(np.diff(cells[np.argsort(index)], axis=0)).sum(axis=1)) == {1}


def test_neighbours_against_brute_force(spark):
    data = rows(600, 8)
    table = spark.createDataFrame(data, SCHEMA)
    good = [(i, np.array(v, float)) for i, v, _ in data if usable(v) and len(v) == 8]
    want = {}
    for i, a in good:
        if i % 50 == 0:
            near = sorted((np.sqrt(((a - b) ** 2).sum()), j) for j, b in good if j != i)[:10]
            want[i] = near
    for block in (512, 16):
        got = {}
        for r in nearest_neighbours(table, table.where("vec_id % 50 = 0"), block=block).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.score, r.id))
        assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
        hits = sum(len({j for _, j in got[q]} & {j for _, j in want[q]}) for q in want)
        assert hits >= 0.9 * sum(len(v) for v in want.values())
        if block == 512:
            assert {q: [j for _, j in v] for q, v in got.items()} == {q: [j for _, j in v] for q, v in want.items()}
        assert [j for _, j in got[200]] == [1, *range(201, 210)]  # copies: ties to the smaller id


def test_long_and_huge_vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((12, 3000))
    x[1], x[2], x[3] = x[0] * 1e200, x[0] * 1e-250, x[0] + 1e-3 * x[4]
    x[5] *= 1e250
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.id: (r.n_links, r.component_id) for r in embedding_neardup(table).collect()}
    assert all(got[i] == (3, 0) for i in range(4)) and all(got[i] == (0, i) for i in range(4, 12))
    near = {r.rank: (r.id, r.score) for r in nearest_neighbours(table, table.where("vec_id = 0"), k=11).collect()}
    want = sorted((np.ldexp(np.sqrt((np.ldexp(v - x[0], -900) ** 2).sum()), 900) if i in (1, 5) else np.sqrt(((v - x[0]) ** 2).sum()), i) for i, v in enumerate(x) if i)
    assert [near[r + 1][0] for r in range(11)] == [i for _, i in want] and np.allclose([near[r + 1][1] for r in range(9)], [d for d, _ in want[:9]], rtol=1e-9) and np.isfinite(near[11][1])


def test_plans_look_at_no_row_twice():
    rng = np.random.default_rng(6)
    for gaps in (rng.integers(0, 100, (500, 16)), rng.integers(0, 3, (500, 16)), np.zeros((5, 16), int)):
        used, radius = search_plan(gaps, 0.96, 100)
        assert used * min(2 * radius + 1, 100) <= 100 and (gaps[:, :used].min(axis=1) <= radius).mean() >= 0.96
    assert search_plan(np.zeros((5, 16), int), 0.96, 100) == (1, 0)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert embedding_neardup(empty).count() == 0 and nearest_neighbours(empty, empty).count() == 0
    one = spark.createDataFrame([(0, [1.0, 0.0], "s")], SCHEMA)
    assert nearest_neighbours(one, one).count() == 0 and embedding_neardup(one).first().kept
