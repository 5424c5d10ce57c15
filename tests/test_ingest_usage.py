import json
import random

import pytest
from common import SF
from pyspark.sql import functions as F

from lectern.operators import longs, usage
from lectern.sources import ingest, schemas


def test_files(spark, tmp_path):
    (tmp_path / "007_a.md").write_bytes("# First\nAuthor: A B\nauthor: C\nBook ID: no 12\nnonsense\n---\nbody one\r\ntwo".encode())
    (tmp_path / "0042 x.md").write_bytes(b"no header \x91quoted\x92 \x81")
    (tmp_path / "skip.txt").write_bytes(b"x")
    got = {r.path.rsplit("/", 1)[1]: r for r in ingest.parsed(ingest.read_files(spark, str(tmp_path))).collect()}
    a, b = got["007_a.md"], got["0042%20x.md"] if "0042%20x.md" in got else got["0042 x.md"]
    assert len(got) == 2 and (a.title, a.author, a.book_id, a.body, a.body_start_line) == ("First", "C", 12, "body one\ntwo", 6)
    assert b.body == "no header ‘quoted’ �" and b.book_id == 42 and b.body_start_line == 0


def test_manifest(spark, tmp_path):
    p = tmp_path / "m.json"
    p.write_text(json.dumps([{"URL": "u1", "Title": "t1", "Author": " "}, {"URL": "", "Title": "t2"}, {"URL": "u3", "Title": "t3", "Category": "c"}]))
    assert sorted((r.url, r.author, r.category) for r in ingest.manifest(spark, str(p)).collect()) == [("u1", "Unknown", "Uncategorized"), ("u3", "Unknown", "c")]


W = " ".join(["word"] * 60)


def test_works(spark):
    head = "<ThML><ThML.body><div1 title='JUSTIN MARTYR'><ThML.head><electronicEdInfo><workID>w1</workID><authorID>justin</authorID><DC><DC.Title>First_Apology</DC.Title></DC></electronicEdInfo></ThML.head>"
    vol = head + f"<p>Before <note>gone <p>inner</p></note>after {W}</p></div1></ThML.body></ThML>"
    n = ingest.nodes(spark.createDataFrame([("anf01", vol)], "volume string, xml string"))
    w = ingest.works_by_head(n).collect()
    assert len(w) == 1 and w[0].author == "Justin Martyr" and w[0].title == "First Apology" and w[0].ccel_id == "anf01#001"
    assert "gone" not in w[0].text and "inner" not in w[0].text and w[0].text.startswith("Before after word")
    npnf = f"<ThML><div1 title='Title Page'><p>{W}</p></div1><div1 title='On Faith'><p>{W}</p></div1><div1 title='Index of Subjects'><p>{W}</p></div1><div1 title='Short'><p>x</p></div1></ThML>"
    w = ingest.works_by_division(ingest.nodes(spark.createDataFrame([("npnf101", npnf)], "volume string, xml string"))).collect()
    assert [(r.title, r.ccel_id) for r in w] == [("On Faith", "npnf101#001")]


def test_fetch_and_sinks(spark, tmp_path):
    works = spark.createDataFrame([("gutenberg", "1"), ("ia", "b"), ("x", "c")], "kind string, id string").withColumn("urls", ingest.candidate_urls("kind", "id"))
    got = {r.id: r.url for r in ingest.fetched(works, lambda u: "text" if u.endswith("_djvu.txt") or "-0.txt" in u else None).collect()}
    assert got["1"].endswith("1-0.txt") and "download" in got["b"] and got["c"] is None
    c1 = spark.createDataFrame([(1, 0, "a"), (2, 0, "b"), (2, 1, "c")], "book_id long, chunk_index int, text string")
    ingest.write_chunks(c1, str(tmp_path / "c"), 2)
    ingest.write_chunks(spark.createDataFrame([(2, 0, "new")], "book_id long, chunk_index int, text string"), str(tmp_path / "c"), 2)
    assert sorted((r.book_id, r.text) for r in spark.read.parquet(str(tmp_path / "c")).collect()) == [(1, "a"), (2, "new")]
    t, bad = ingest.repaired({"books": c1, "chunks": c1}, "chunks", {"books": ["book_id"]})
    assert t["chunks"].count() == 0 and bad == {"books": 1}


def test_schemas(spark):
    df = schemas.evolved(spark.createDataFrame([(1, "x")], "id int, more string"), schemas.BOOKS)
    assert df.columns == [*schemas.BOOKS.names, "more"] and df.schema["id"].dataType.simpleString() == "bigint"


def test_long_s(spark):
    lex = spark.createDataFrame([("those", 5), ("first", 9), ("sirst", 1), ("of", 99), ("self", 3), ("fell", 4), ("sell", 4)], "word string, freq long")
    texts = spark.createDataFrame([(1, "Thofe firft OF the FELF, fell; fooo'f"), (2, None), (3, "")], "doc_id long, text string")
    got = {r.doc_id: (r.text, r.changed) for r in longs.corrected(texts, lex).collect()}
    assert got == {1: ("Those first OF the SELF, fell; fooo'f", 3), 2: ("", 0), 3: ("", 0)}


def test_long_s_candidates(spark):
    got = {(r.mask, r.candidate) for r in longs.candidates(spark.createDataFrame([("offaf",), ("ffffff",), ("abc",)], "token string")).collect()}
    assert got == {(m, "".join("s" if c == "f" and m >> [0, 0, 1, 1, 2][i] & 1 else c for i, c in enumerate("offaf"))) for m in range(1, 8)}


@pytest.mark.parametrize("seed", range(3))
def test_limiter(spark, seed):
    r = random.Random(seed)
    hits = [(u, i, t) for u in range(3) for i, t in enumerate(sorted(r.choices(range(100), k=40)))]
    df = spark.createDataFrame(hits, "user_id long, event_id long, s long").select("user_id", "event_id", F.timestamp_seconds("s").alias("ts"))
    want = set()
    for u in range(3):
        kept = []
        for _, i, t in (h for h in hits if h[0] == u):
            kept = [x for x in kept if x >= t - 10]
            if len(kept) < 3:
                kept.append(t)
                want.add((u, i))
    for f in (usage.rate_limited, usage.rate_limited_fold):
        assert {(x.user_id, x.event_id) for x in f(df, 3, 10).where("accepted").collect()} == want


def test_quota_overshoots_once(spark):
    df = spark.createDataFrame([(1, i, 3, i != 1) for i in range(6)], "user_id long, event_id long, units long, ok boolean").withColumn("ts", F.timestamp_seconds(F.col("event_id")))
    assert [r.admitted for r in usage.quota_admission(df, 5).orderBy("event_id").collect()] == [True, True, True, False, False, False]


def test_entry_without_llm(spark):
    import __spark_entry__ as e

    asked = spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id % 20 = 0").count()  # ten rows for each query
    assert asked and e.entry(spark).count() == 10 * asked and set(e.oracle_sql()) <= set(e.queries())


def test_long_s_candidates_of_all_documents(spark, tmp_path):
    from lectern.plans import q_usage

    rows = [(1, "some", "en"), (60, "sea", "en"), (5000, "self", "en"), (5001, "sieben", "de")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.token, r.mask, r.candidate) for r in q_usage.fix_long_s_candidates(spark, str(tmp_path)).collect()}
    assert got == {("fome", 1, "some"), ("fea", 1, "sea"), ("felf", 1, "self"), ("felf", 2, "fels"), ("felf", 3, "sels")}
