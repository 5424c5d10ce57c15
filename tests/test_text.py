from pyspark.sql import functions as F

from lectern.functions import text as T


def values(spark, column, xs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_noise(spark):
    cases = {"": False, "   ": False, "123": True, "12345": True, "xiv.": True, "civil": True, "D 3": True, "~": True, "* * * *": True, "NAMES OF LECTURERS,": True,
             "THE ONE TWO THREE FOUR FIVE": True, "THE ONE TWO THREE FOUR FIVE SIX": False, "A" * 32: True, "A" * 33: False, "ABCDEFGxyz": True, "ABCDEFxyzw": False, "plain words here": False, "  ": False}
    assert values(spark, T.is_noise("x"), list(cases)) == list(cases.values())


def test_prose(spark):
    cases = {"the quick brown fox jumps": True, "the quick brown fox": False, "12 34 56 78 90 ab": False, "THE QUICK BROWN FOX JUMPS": False, "(the) quick, brown; fox. a1": True, "a b c d e": False, "": False}
    assert values(spark, T.is_prose("x"), list(cases)) == list(cases.values())


def test_tokens_and_strip(spark):
    assert values(spark, T.token_estimate("x"), ["", "one", "a b c d e f g h i j", " x "]) == [1, 2, 14, 2]
    assert values(spark, T.strip("x"), ["　a b\u0085", "\x1cx\x1f"]) == ["a b", "x"]


def test_like(spark):
    assert values(spark, T.contains_like("x", "A_c%"), ["xabcx", "abx", None]) == [True, False, None]
    assert values(spark, T.contains_like("x", "a\\b"), ["xa\\bx", "ab"]) == [True, False]
    assert values(spark, T.contains_like("x", "É"), ["é", "É"]) == [False, True]


def test_titles_and_case(spark):
    assert values(spark, T.title_case("x"), ["THE  city_of GOD", "on the trinity of", None]) == ["The City of God", "On the Trinity Of", ""]
    df = spark.createDataFrame([("shew", "FHEW"), ("shew", "Fhew"), ("shew", "fhew")], "t string, s string")
    assert [r[0] for r in df.select(T.match_case("t", "s")).collect()] == ["SHEW", "Shew", "shew"]


def test_sources(spark):
    cases = {"https://archive.org/details/abc?x": ("ia", "abc"), "http://gutenberg.org/ebooks/12.txt": ("gutenberg", "12"), "https://books.google.com/books?id=q1&z": ("google", "q1"), "https://books.google.de/x": ("google", ""),
             "https://hdl.handle.net/2027/mdp.1?a": ("hathi", "mdp.1"), "https://example.org": (None, None), None: (None, None)}
    assert [tuple(r) for r in values(spark, T.parse_source("x"), list(cases))] == list(cases.values())
    assert values(spark, T.connector_id("x"), ["https://www.gutenberg.org/ebooks/12?a", "https://www.gutenberg.org/ebooks/ab", "https://archive.org/details/a?b/c", "https://x.y"]) == ["12", None, "a?b", None]


def test_years_json_pkce(spark):
    assert values(spark, T.year_of("x"), ["[1399, 1400]", "c16001", "2099", "2100"]) == [1400, None, 2099, None]
    assert values(spark, T.first_or_scalar("x", "k"), ['{"k": [1, 2]}', '{"k": "a"}', "{}", '{"k": []}']) == ["1", "a", None, None]
    assert values(spark, T.pkce_challenge("x"), ["dBjftJeZ4CVP-mB92K27uhbUJU1p1r_wW1gFWFOEjXk"]) == ["E9Melhoa2OwvFrEMTJguCHaoeK1t8URWbuGJSstw-cM"]
    assert values(spark, T.bearer("x"), ["bearer  abc ", "Basic x", None]) == ["abc", None, None]


def test_snippet(spark):
    assert values(spark, T.snippet("x", 5), ["a  b\nc", "abcdefg"]) == ["a b c", "abcde […]"]
    assert values(spark, F.array_join(T.sentences("x"), "|"), ["One. Two! three? Four"]) == ["One.|Two! three?|Four"]
