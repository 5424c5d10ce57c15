"""Findings of larger tables, on small ones: tables that are folders, blocks, odd letters."""

import random

import numpy as np
import pytest
from common import SF
from conftest import rows
from test_text import values

from lectern import catalog
from lectern.functions import text as T
from lectern.operators import clean, lexical, vector
from lectern.sources import ingest

QUERIES = catalog.queries()


def test_title_letters_stay_one(spark):
    cases = {"auf ßein ein": "Auf ẞein Ein", "of ﬁn of": "Of ﬁn Of", "ᾳx": "ᾼx", "ΟΔΟΣ İa": "Οδοσ Ia"}
    assert values(spark, T.title_case("x"), list(cases)) == list(cases.values())


@pytest.mark.parametrize("name,tables", [("stream_postings", ["documents"]), ("stream_query_batch", ["embeddings"]), ("stream_resumable_chunks", ["documents"]), ("stream_usage", ["events"])])
def test_streams_read_tables_that_are_folders(spark, tmp_path, name, tables):
    for t in tables:
        spark.read.parquet(f"{SF}/{t}.parquet").repartition(3).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert rows(QUERIES[name](spark, str(tmp_path))) == rows(QUERIES[name](spark, SF))


def test_flags_equal_the_predicates(spark):
    r = random.Random(7)
    pieces = ["", " ", "  ", "\t", "12", "xiv.", "A.D.", "THE", "Word", "(plain),", "é", "ß", "日本", "…", "a1", " ", "O'Neill", "Ⅳ", "lower", "cut-", "\U00010400", "..", "mix"]
    lines = ["".join(r.choice(pieces) + r.choice(["", " ", " ", " "]) for _ in range(r.randrange(12))) for _ in range(3000)]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "book_id long, line_no int, line string")
    got = clean.flagged(df).select("line", "blank", "noise", "prose", (T.strip("line") == "").alias("b"), T.is_noise("line").alias("n"), T.is_prose("line").alias("p")).collect()
    assert len(got) == 3000 and {x for x in got if (x.blank, x.noise, x.prose) != (x.b, x.n, x.p)} == set()
    assert {sum(x[i] for x in got) > 20 for i in (1, 2, 3)} == {True}


def test_lines_have_offsets_of_their_own_body(spark):
    bodies = [(1, "a\n\né日\n"), (2, None), (3, ""), (None, "x\ny"), (5, "z")]
    df = spark.createDataFrame(bodies, "book_id long, body string").coalesce(1)
    want = [(k, i, x, a, a + len(x)) for k, t in bodies for i, x in enumerate((t or "").split("\n")) for a in [len("\n".join((t or "").split("\n")[:i])) + (i > 0)]]
    old, clean.STEP = clean.STEP, 2
    try:
        assert sorted(map(tuple, clean.lines(df).collect()), key=repr) == sorted(want, key=repr)
    finally:
        clean.STEP = old


def test_block_search_equals_all_pairs(spark):
    """Few numbers to a slice: every slice of vectors meets each of queries; equal vectors go by id, whatever tile they are in."""
    r = np.random.default_rng(3)
    x = np.repeat(r.normal(size=(40, 8)).astype(np.float32), 5, 0)[r.permutation(200)]
    v = spark.createDataFrame([(i, [float(a) for a in y]) for i, y in enumerate(x)] + [(900, None)], "vec_id long, embedding array<float>")
    q = v.where("vec_id < 30").selectExpr("vec_id qid", "embedding qvec")
    s = [[(-sum(float(a) * float(b) for a, b in zip(x[i], y, strict=True)), j) for j, y in enumerate(x)] for i in range(30)]
    want = sorted((i, j, rank + 1) for i in range(30) for rank, (_, j) in enumerate(sorted(s[i])[:7]))
    old = vector.PASS, vector.TILE
    vector.PASS, vector.TILE = 64, (3, 16)
    try:
        found = vector.top_k(v, q, 7)
        assert sorted((t.qid, t.id, t.ann_rank) for t in found.collect()) == want
        assert vector.top_k(v.limit(0), q, 7).count() == 0 and vector.top_k(v, q.limit(0), 7).count() == 0
        near = vector.lsh_top_k(v, q, 7, 200, 1)
        assert sorted((t.qid, t.id, t.ann_rank) for t in near.collect()) == want
        c = vector.ivf_fit(v.where("embedding is not null"), 4)
        assert sorted((t.qid, t.id, t.ann_rank) for t in vector.ivf_top_k(vector.ivf_assign(v.where("embedding is not null"), c), c, q, 7, 4).collect()) == want
    finally:
        vector.PASS, vector.TILE = old


def test_scores_of_more_than_a_thousand_queries(spark):
    v = spark.range(1100).selectExpr("id vec_id", "array(cast(id as float), 1f) embedding")
    assert vector.scored(v.limit(2), v.selectExpr("vec_id qid", "embedding qvec")).count() == 2200


def test_many_queries_in_tiles(spark):
    """The matrix of passages and queries, in tiles of any size, and the joins of an index give the same rows."""
    r = random.Random(4)
    docs = [(f"d{i:03}", " ".join(r.choices(["Été", "alpha", "beta", "x1", "zeta", "ß"], k=r.randrange(9)))) for i in range(120)] + [("none", None)]
    p, q = spark.createDataFrame(docs, "id string, text string"), spark.createDataFrame([(7, "ete alpha alpha"), (9, "zeta x1 unknown"), (11, "...")], "qid long, query string")

    def plain(df):
        return sorted((t.qid, t.rank, t.id, round(t.score, 9)) for t in df.collect())
    want = plain(lexical.any_term(lexical.postings(p), *lexical.statistics(p), q, 5))
    old = lexical.TILE, lexical.FEW
    try:
        for lexical.TILE, lexical.FEW in ((1 << 22, 1 << 18), (30, 1 << 18), (1 << 22, 2)):
            assert plain(lexical.any_term_search(p, q, 5)) == want and len(want) == 10
    finally:
        lexical.TILE, lexical.FEW = old


def test_tiles_of_products():
    r = np.random.default_rng(1)
    v, q = r.integers(-2, 3, (90, 3)).astype(float), r.integers(-2, 3, (7, 3)).astype(float)  # full of ties
    ids, old = r.permutation(90), vector.TILE
    v[4] = np.nan
    want = [(i, int(j)) for i in range(7) for j in ids[np.lexsort((ids, np.where(np.arange(90) == 4, -np.inf, -(v @ q[i]))))[:5]]]
    try:
        for vector.TILE in ((512, 4096), (2, 4), (3, 20)):
            row, found, _ = vector.best(ids, v, q, 5)
            assert list(zip(row.tolist(), found.tolist(), strict=True)) == want
    finally:
        vector.TILE = old


def test_nodes_leave_a_task_in_pieces(spark):
    df = spark.createDataFrame([(i, f"<title>t {i}</title>" + "<p>one</p><p>two</p>" * i) for i in range(9)] + [(None, "<p>x</p>"), (10, None)], "volume long, xml string").coalesce(1)
    whole, old = rows(ingest.nodes(df)), ingest.HELD
    try:
        ingest.HELD = 150
        assert rows(ingest.nodes(df)) == whole and len(whole) == 9 + 2 * 36 + 1
    finally:
        ingest.HELD = old


def test_graph_is_built_once(spark, monkeypatch):
    """Several blocks of queries read one index."""
    monkeypatch.setattr(vector, "PASS", 64)
    plan = QUERIES["vec_hnsw_topk"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("InMemoryRelation") > 1 and plan.count("mapInArrow") == 0 or plan.count("InMemoryRelation") == plan.count("MapInArrow")
    spark.catalog.clearCache()
