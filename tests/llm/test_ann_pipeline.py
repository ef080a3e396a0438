import collections
import re
import sys

import numpy as np
import pyarrow as pa

sys.path.insert(0, __file__.rsplit("/", 1)[0])
import messy  # noqa: E402,F401

import corpus_pipeline  # noqa: E402
from tesserel.llm import ann, minhash, pii, substring, toxicity  # noqa: E402

SF = "/root/testdata/sf0.001"


def _brute(x, k):
    """The k nearest other rows of each row, ties by the lesser index."""
    x = x.astype(np.float64)
    out = []
    for i in range(len(x)):
        d = ((x - x[i]) ** 2).sum(1)
        d[i] = np.inf
        out.append(np.lexsort((np.arange(len(x)), d))[:k])
    return np.array(out)


def _frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))], "vec_id bigint, embedding array<float>")


def _recall(rows, x, k=10):
    got = collections.defaultdict(set)
    for r in rows:
        got[r.vec_id].add(r.neighbour_id)
    return np.mean([len(got[i] & set(t)) / k for i, t in enumerate(_brute(x, k).tolist())])


def test_recall_by_default_parameters(spark):
    data = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").collect()
    noise = np.array([r.embedding for r in data], np.float32)
    rng = np.random.default_rng(0)
    clusters = (rng.normal(size=(40, 16))[rng.integers(0, 40, 3000)] * 5 + rng.normal(size=(3000, 16)) * 0.05).astype(np.float32)
    offset = (100 + rng.normal(size=(1000, 64)) * 0.01).astype(np.float32)
    for x, least in ((noise, 0.93), (clusters, 0.95), (offset, 0.95)):
        rows = ann.op1_ann(_frame(spark, x)).collect()
        assert len(rows) == 10 * len(x) and _recall(rows, x) >= least
        for r in rows[:300]:
            assert abs(r.distance - np.linalg.norm(x[r.vec_id].astype(float) - x[r.neighbour_id])) < 1e-9


def test_clustered_rows_rank_few(spark, monkeypatch):
    rng = np.random.default_rng(0)
    x = (rng.normal(size=(40, 16))[rng.integers(0, 40, 3000)] * 5 + rng.normal(size=(3000, 16)) * 0.05).astype(np.float32)
    rows = _frame(spark, x).selectExpr("vec_id AS key", "embedding AS v").cache()
    best, reach = ann.search(rows, 3000, 16)
    assert best.count() == 30000
    # what the trees propose to a query, its own leaves included, by the same rule
    pool, depth = ann.directions(16), int(np.ceil(np.log2(3000 / ann.LEAF_ROWS)))
    p, n = x.astype(float) @ pool.T, np.zeros(3000)
    far = np.sqrt([(np.sort(((x.astype(float) - v) ** 2).sum(1))[10]) for v in x.astype(float)])
    for t in range(ann.TREES):
        sub = ann.Subtree.grow(x.astype(float), pool, t, 1, depth)
        m, _ = sub.margins(p, np.zeros(3000))
        n += ((m <= 1.2 * reach * far[:, None]) * np.bincount(sub.leaf, minlength=1 << depth)).sum(1)
    assert n.mean() < 0.4 * 3000  # of eight trees together


def test_levels_over_the_table_split_as_tasks_do(spark):
    x = np.array([r.embedding for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").orderBy("vec_id").collect()], np.float32)
    rows = _frame(spark, x).selectExpr("vec_id AS key", "embedding AS v").cache()
    f = ann.plant(rows, len(x), 64, trees=3, leaf_rows=32, cell_rows=64)
    assert f.top == 3 and f.depth == 4
    for t in f.cells(x.astype(float) @ ann.directions(64).T):
        sizes = collections.Counter(t.tolist())
        assert len(sizes) == 8 and max(sizes.values()) <= 80 and min(sizes.values()) >= 40
    best, _ = ann.search(rows, len(x), 64, 10, leaf_rows=32, cell_rows=64)
    assert _recall([collections.namedtuple("R", "vec_id neighbour_id")(r.q, r.near) for r in best.collect()], x) >= 0.9


def test_the_queue_is_that_of_all_trees():
    import heapq

    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 8))
    pool, top, levels = ann.directions(8), 2, 3
    p = x[:20] @ pool.T
    forest = ann.Forest(8, top, top + levels, rng.normal(size=(3, 4)) * 0.3)
    cells = {}
    for t in range(3):
        at = forest.cells(x @ pool.T)[t]
        for node in range(4, 8):
            cells[t, node] = ann.Subtree.grow(x[at == node], pool, t, node, levels)

    def threshold(t, n):
        if n < 1 << top:
            return forest.thresholds[t, n]
        up = n.bit_length() - 1 - top
        return cells[t, n >> up].thresholds[(1 << up) + (n & ((1 << up) - 1))]

    for limit in (0.01, 0.4, 0.9, 5.0):
        row, tree, node = forest.reached(p, np.full(20, limit))
        reached = set(zip(row.tolist(), tree.tolist(), node.tolist()))
        for i in range(20):
            heap, want = [(0.0, t, 1) for t in range(3)], set()
            while heap and heap[0][0] <= limit:  # the queue, until its least is beyond the limit
                c, t, n = heapq.heappop(heap)
                if n >= 1 << (top + levels):
                    want.add((t, n))
                    continue
                gap = float(p[i, ann.direction_of(np.array([t]), np.array([n]))[0]] - threshold(t, n))
                heapq.heappush(heap, (c + max(gap, 0.0), t, 2 * n))
                heapq.heappush(heap, (c + max(-gap, 0.0), t, 2 * n + 1))
            got = set()
            for (t, node), sub in cells.items():
                m, _ = sub.margins(p[i : i + 1], forest.cost_of(p[i : i + 1], t, node)[0])
                hit = np.flatnonzero(m[0] <= limit + 1e-6)
                assert not len(hit) or (i, t, node) in reached
                got |= {(t, (node << levels) + int(h)) for h in hit}
            assert got == want


def test_ties_and_copies_go_to_the_lesser_id(spark):
    rng = np.random.default_rng(2)
    grid = np.repeat(rng.integers(0, 3, size=(60, 3)), 1, axis=0).astype(np.float32)
    x = np.concatenate([grid, np.tile(np.float32([[9, 9, 9]]), (400, 1))])
    want = _brute(x, 10)
    for adaptive in ("true", "false"):
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        got = collections.defaultdict(list)
        for r in ann.op1_ann(_frame(spark, x)).collect():
            got[r.vec_id].append((r.rank, r.neighbour_id, r.distance))
        assert all([n for _, n, _ in sorted(got[i])] == want[i].tolist() for i in range(len(x)))
        assert all(d == 0 for _, _, d in got[100])
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_vectors_that_are_odd(spark):
    inf = float("inf")
    rows = [(1, [0.0, 0.0]), (1, [0.0, 0.0]), (2, [-0.0, 0.0]), (3, [1.0, 0.0]), (None, [0.0, 2.0]), (4, None), (5, []), (6, [1.0]), (7, [1.0, None]), (8, [float("nan"), 1.0]), (9, [inf, 0.0]), (10, [0.0, -inf])]
    df = spark.createDataFrame([(*r, None, None) for r in rows], "vec_id int, embedding array<double>, key string, v string")
    got = sorted(((r.vec_id, r.neighbour_id, r.rank) for r in ann.op1_ann(df, k=2).collect()), key=str)
    assert {g[:2] for g in got if g[0] == 1} == {(1, 2), (1, 3)} and {g[0] for g in got} == {1, 2, 3, None} and len(got) == 8
    assert {r.distance for r in ann.op1_ann(df, k=1).collect() if r.vec_id == 1} == {0.0}
    assert ann.op1_ann(df.limit(0)).count() == 0 and ann.op1_ann(df.where("vec_id = 3")).count() == 0
    huge = _frame(spark, np.array([[3e38, 0], [-3e38, 0], [1, 1], [1, 2]]))
    assert [r.neighbour_id for r in ann.op1_ann(huge, k=1).orderBy("vec_id").collect()] == [2, 2, 3, 2]


def test_queries_by_id_are_searched_exactly(spark, monkeypatch):
    rng = np.random.default_rng(4)
    noise = rng.normal(size=(1500, 24)).astype(np.float32)
    clusters = (rng.normal(size=(40, 16))[rng.integers(0, 40, 3000)] * 5 + rng.normal(size=(3000, 16)) * 0.05).astype(np.float32)
    offset = (100 + rng.normal(size=(1000, 64)) * 0.01).astype(np.float32)
    ties = np.concatenate([rng.integers(0, 3, size=(300, 3)), np.tile([[9, 9, 9]], (200, 1))]).astype(np.float32)
    monkeypatch.setattr(ann.scan, "__defaults__", (10, 64, 256, 400))  # several cells, leaves and blocks of queries
    for x in (noise, clusters, offset, ties):
        got = collections.defaultdict(list)
        for r in ann.op1_ann(_frame(spark, x), every=50).collect():
            got[r.vec_id].append((r.rank, r.neighbour_id, r.distance))
        want = _brute(x, 10)
        assert set(got) == set(range(0, len(x), 50))
        for i, rows in got.items():
            assert [n for _, n, _ in sorted(rows)] == want[i].tolist()
            assert all(abs(d - np.linalg.norm(x[i].astype(float) - x[n])) < 1e-9 for _, n, d in rows)


def test_the_query_estimates_nothing(spark, monkeypatch):
    from tesserel.llm import queries

    def sampled(*_):
        raise AssertionError("a limit that is calibrated on a sample")

    monkeypatch.setattr(ann, "limits", sampled)
    monkeypatch.setattr(ann, "search", sampled)
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = [r.vec_id for r in rows], np.array([r.embedding for r in rows], np.float32)
    want = {ids[i]: {ids[j] for j in near} for i, near in enumerate(_brute(x, 10)) if ids[i] % 50 == 0}
    got = collections.defaultdict(set)
    for r in queries.queries()["op1_ann"](spark, SF).collect():
        got[r.vec_id].add(r.neighbour_id)
    assert got == want  # recall 1


def test_queries_by_id_of_odd_tables(spark):
    rows = [(None, [0.0, 0.0]), (0, [0.0, 1.0]), (0, [5.0, 1.0]), (50, [0.0, 1.0]), (51, [0.0, 1.0]), (-100, [7.0, 7.0]), (100, None), (150, [1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = collections.Counter(r.vec_id for r in ann.op1_ann(df, every=50).collect())
    assert got == {0: 10, 50: 5, -100: 5}
    text = df.selectExpr("if(vec_id = 51, 'x', string(vec_id)) AS vec_id", "embedding")
    assert collections.Counter(r.vec_id for r in ann.op1_ann(text, every=50).collect()) == {"0": 10, "50": 5, "-100": 5}
    assert ann.op1_ann(df.where("vec_id = 51"), every=50).count() == 0 and ann.op1_ann(df.limit(0), every=50).count() == 0
    queries = __import__("tesserel.llm.queries", fromlist=["queries"]).queries()
    out = queries["op1_ann"](spark, SF)
    n = spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id % 50 = 0").count()
    assert n and out.count() == 10 * n


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "substrings", "pii", "packing"]
    at, before = docs, {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, SF)
        rows = out.collect()
        if name == "packing":
            assert {r.doc_id for r in rows} == set(before) and len(rows) == len(before)
            break
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        after = {r.doc_id: r.text for r in rows}
        assert len(after) == len(rows) and all(r.n_chars == len(r.text) for r in rows if r.text != before[r.doc_id])
        if name == "toxicity":
            bad = {r.doc_id for r in toxicity.op7_toxicity(docs, labels).collect() if r.toxic}
            assert set(before) - set(after) == bad
        if name == "near_duplicates":
            keep = {r.doc_id for r in minhash.op10_minhash(at).collect() if r.keep}
            assert set(after) == keep
        if name == "substrings":
            drops = {r.doc_id: r.drops for r in substring.op6_substring(at).collect()}
            assert all(after.get(i) == t for i, t in before.items() if not drops.get(i))
            assert substring.op6_substring(out).count() == 0
        if name == "pii":
            assert all(not pii.entities(t.encode()) for t in after.values())
            assert all(after[i] == t for i, t in before.items() if not pii.entities(t.encode()))
        before, at = after, spark.createDataFrame(rows, docs.schema)
    assert corpus_pipeline.run(spark, SF).count() == len(before)


def test_pipeline_bears_odd_rows(spark, tmp_path):
    rows = [(i, t, "en", None, len(t) if t else None, None) for i, t in messy.ROWS]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, k1 string")
    for name, d in (("full", docs), ("none", docs.limit(0))):
        d.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/full").count() == len(rows) - 2
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    assert re.match("packing", corpus_pipeline.STAGES[-1][0])
    assert isinstance(pa.__version__, str)
