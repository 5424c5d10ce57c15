import json

import pytest

from lectern import engine
from lectern.operators import retrieve

PROSE = "the quick brown fox number {} jumps over lazy dogs and sleeps well in the garden of plain words"


@pytest.fixture(scope="module")
def library(spark, tmp_path_factory):
    books = spark.createDataFrame([(i, f"Title {i}", "Ann Bee" if i % 2 else "Cee", "c", 1600 + i, None, None, "\n\n".join([PROSE.format(i)] * 8)) for i in range(12)] + [(99, "Blank", "x", "c", 1, None, None, "  ")],
                                  "book_id long, title string, author string, category string, year int, publisher string, url string, content string")
    return engine.Library.build(spark, books, engine.EngineConfig(folder=str(tmp_path_factory.mktemp("library"))))


def test_modes(library):
    got = library.semantic("fox number 7", 3, filters=retrieve.Filters(author="ann")).collect()
    assert len(got) == 3 and got[0].author == "Ann Bee" and [r.rank for r in got] == [1, 2, 3]
    hits = library.search("number 4", 5, semantic=False).collect()
    assert hits[0].book_id == 4 and hits[0].score < 0
    assert library.literal("nothere").count() == 0
    text, units = library.run("fox", 60, deep=True)
    assert text.startswith('Top 12 results for "fox"') and units == 3
    assert library.run("absent", mode="Literal")[0] == 'No results for "absent".'
    with pytest.raises(engine.QuotaExceeded):
        library.run("fox", used=5, limit=5)


def test_approximate(library, spark):
    other = engine.Library(spark, library.books, library.passages, library.vectors, library.embed, engine.EngineConfig(index="ivf", cells=4, probes=4))
    flat, ivf = (sorted(r.score for r in x.semantic("fox number 7", 5, rerank=False).collect()) for x in (library, other))
    assert ivf == pytest.approx(flat)
    graphs = engine.Library(spark, library.books, library.passages, library.vectors, library.embed, engine.EngineConfig(index="hnsw"))
    assert sorted(r.score for r in graphs.semantic("fox number 7", 5, rerank=False).collect()) == pytest.approx(flat)


def test_long_s_in_build(spark, tmp_path):
    """Words in which an f was read for a long s are repaired in what is indexed, by the lexicon that is given, unless it is switched off."""
    text = "\n\n".join("The houfe of the wife is fafe and the Houfe stands by the river every day." for _ in range(8))
    books = spark.createDataFrame([(1, "T", "A", "c", 1700, None, None, text)], "book_id long, title string, author string, category string, year int, publisher string, url string, content string")
    words = spark.createDataFrame([(w, 5) for w in "the house of wife is safe and stands by river every day".split()], "word string, freq long")
    for on, first in ((True, "The house of the wife is safe and the House stands"), (False, "The houfe of the wife is fafe and the Houfe stands")):
        lib = engine.Library.build(spark, books, engine.EngineConfig(folder=str(tmp_path / str(on))), apply_long_s=on, lexicon=words)
        assert all(r.text.startswith(first) for r in lib.passages.collect())


def test_missing(spark, tmp_path):
    with pytest.raises(engine.SearchUnavailable):
        engine.Library.open(spark, engine.EngineConfig(folder=str(tmp_path / "none")))


def test_command_line(library, capsys):
    engine.main(["--q", "number", "--literal", "--k", "2", "--data", library.config.folder, "--year-min", "1605"])
    got = json.loads(capsys.readouterr().out)
    assert len(got) == 2 and all(r["year"] >= 1605 for r in got)
