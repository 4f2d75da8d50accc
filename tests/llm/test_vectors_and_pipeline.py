import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import near_vectors as nv
from textloom.llm.components import connected_components


def brute(rows, cosine):
    ok = {}
    for k, (_, v) in enumerate(rows):
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok[k] = np.array(v, float) / np.linalg.norm(np.array(v, float))
    links = {k: [j for j in ok if j != k and k in ok and len(ok[j]) == len(ok[k]) and ok[j] @ ok[k] >= cosine] for k in range(len(rows))}
    label = {k: rows[k][0] for k in links}
    changed = True
    while changed:
        changed = False
        for k, js in links.items():
            m = min([label[k], *(label[j] for j in js)])
            if m < label[k]:
                label[k], changed = m, True
    return {rows[k][0]: (len(links[k]), label[k]) for k in links}


@pytest.mark.parametrize("block", [2048, 16])
def test_near_vectors_against_all_pairs(spark, block):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16))
    rows = [(k, (centres[k % 12] + rng.normal(scale=0.12, size=16)).tolist()) for k in range(400)]
    rows += [(400, rows[3][1]), (401, rows[3][1]), (402, None), (403, []), (404, [0.0] * 16), (405, [float("nan")] * 16), (406, [None] * 16), (407, [1.0, 2.0])]
    df = spark.createDataFrame([(k, v, 0, "x") for k, v in rows], "vec_id long, embedding array<double>, label int, fp string")
    got = {r.vec_id: r for r in nv.near_vectors(df, 0.9, lists=8, probes=8, block=block).collect()}
    want = brute(rows, 0.9)
    assert {k: (r.n_links, r.component_id) for k, r in got.items()} == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert nv.near_vectors(df.where("false")).count() == 0


def test_links_are_counted_once_from_either_side_when_few_lists_are_visited(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=16)
    rows = [(k, (base + rng.normal(scale=0.3, size=16)).tolist()) for k in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    unit = np.array([np.array(v) / np.sqrt((np.array(v) ** 2).sum()) for _, v in rows])
    order = sorted(range(150), key=lambda k: unit[k].tobytes())
    quantiser = nv.Quantiser(unit[order], 12, 16)
    visits = nv._nearest(unit, quantiser.coarse, 3)
    meets = np.array([[visits[b, 0] in visits[a] or visits[a, 0] in visits[b] for b in range(150)] for a in range(150)])
    linked = (unit @ unit.T >= 0.9) & meets & ~np.eye(150, dtype=bool)
    got = {r.vec_id: r.n_links for r in nv.near_vectors(df, 0.9, lists=12, probes=3, block=32).collect()}
    assert got == dict(enumerate(linked.sum(1).tolist()))


def test_recall_where_a_query_visits_few_of_many_lists(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(4000, 32))
    base /= np.linalg.norm(base, axis=1)[:, None]
    turn = rng.normal(size=base.shape)
    turn -= (turn * base).sum(1)[:, None] * base
    turn /= np.linalg.norm(turn, axis=1)[:, None]
    c = rng.uniform(0.9, 0.95, size=(4000, 1))
    x = np.concatenate([base, c * base + np.sqrt(1 - c * c) * turn])
    want = sum(int(((x[k : k + 1000] @ x.T) >= 0.9).sum()) for k in range(0, len(x), 1000)) - len(x)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = nv.near_vectors(df, 0.9, lists=600, probes=24)  # a twenty-fifth of the lists
    assert got.agg(F.sum("n_links")).first()[0] >= 0.97 * want >= 8000 * 0.97


def test_repeated_and_null_ids_of_vectors(spark):
    a, b = [1.0, 0.0], [0.0, 1.0]
    df = spark.createDataFrame([(1, a), (1, a), (1, b), (2, [2.0, 0.0]), (None, a), (3, [1.0, None])], "vec_id long, embedding array<double>")
    got = sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in nv.near_vectors(df).collect())
    assert got == [("1", 0, 1, True), ("1", 2, 1, True), ("1", 2, 1, True), ("2", 2, 1, False), ("3", 0, 3, True), ("None", None, None, None)]


def test_components_of_chains_stars_and_loops(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (3, None)] + [(200, 201)] * 3
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 140), 100), 200: 200, 201: 200}


DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, mark string"


def rows(spark, *pairs):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "r", "m") for i, t in pairs], DOCS)


def prose(seed, n=40):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(n))


def test_near_duplicates_of_rows_with_equal_and_null_ids(spark):
    import corpus_pipeline

    a, b, c = prose(1), prose(2), prose(3)
    near = a.replace(a.split()[0], "other")
    docs = rows(spark, (5, a), (3, near), (7, a), (7, a), (7, b), (None, a), (None, c), (None, c), (8, ""), (8, ""), (9, None), (1, "short"), (2, "SHORT"))
    got = sorted(((r.doc_id if r.doc_id is not None else -1), r.text or "") for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert got == sorted([(3, near), (7, b), (-1, c), (8, ""), (8, ""), (9, ""), (1, "short")])
    assert corpus_pipeline.near_duplicates(spark, docs.where("false"), "").count() == 0


def test_quality_judges_rows_not_ids(spark, tmp_path):
    import corpus_pipeline

    good, junk = [prose(k) for k in range(60)], ["### $$$ %%% " * 10 + str(k) for k in range(20)]
    texts = [*enumerate(good), *((100 + k, t) for k, t in enumerate(junk)), (0, junk[1] + " more"), (None, junk[2]), (None, good[3]), (300, None)]
    docs = rows(spark, *texts)
    labels = spark.createDataFrame([(k, 1, 0) for k in range(1, 60)] + [(100 + k, 0, 0) for k in range(20)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.quality(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    kept = {(r.doc_id, r.text) for r in out.collect()}
    assert {(k, t) for k, t in enumerate(good)} | {(None, good[3])} <= kept
    assert not any(t and t.startswith("###") for _, t in kept)


def test_decontaminated_judges_rows_not_ids(spark, tmp_path):
    import corpus_pipeline

    item = prose(50, 20)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = rows(spark, (1, "x " + item), (1, prose(51)), (None, item), (None, prose(52)), (2, None), (2, ""))
    kept = sorted(str((r.doc_id, r.text)) for r in corpus_pipeline.decontaminated(spark, docs, str(tmp_path)).collect())
    assert kept == sorted(map(str, [(1, prose(51)), (None, prose(52)), (2, None), (2, "")]))


def test_pipeline_stages_keep_columns_and_clean_documents(spark, tmp_path):
    import corpus_pipeline

    source = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{source}/documents.parquet")
    ids = docs.agg(F.collect_set("doc_id")).first()[0]
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, source)
        assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        assert set(now.agg(F.collect_set("doc_id")).first()[0]) <= set(ids)
    left = now.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, now, source)
    assert packed.select("doc_id").distinct().count() == left > 0.5 * len(ids)
