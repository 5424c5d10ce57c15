import random

from lectern.operators import chunk, clean


def one(spark, body, **kw):
    return [(r.text, r.char_start, r.char_end) for r in clean.paragraphs(spark.createDataFrame([(1, body)], "book_id long, body string"), **kw).orderBy("para_no").collect()]


def test_hyphens_and_breaks(spark):
    body = "A word cut be-\ntween lines and Upper-\nCase stays here.\n12\nNext  para of\ttext to end.\n\nLast one is this."
    assert [t for t, _, _ in one(spark, body, trim_front=False)] == ["A word cut between lines and Upper- Case stays here.", "Next para of text to end.", "Last one is this."]
    for _, a, b in one(spark, body, trim_front=False):
        assert 0 <= a <= b <= len(body)


def test_start(spark):
    prose = "this line is made of plain words only"
    front = ["TITLE PAGE", "1850"]
    df = spark.createDataFrame([(1, "\n".join(front + [prose] * 9)), (2, "\n".join(front)), (3, "\n".join(["x y"] * 599 + [prose] * 6)), (4, "\n".join(["x y"] * 600 + [prose] * 6)), (5, "\n".join([prose] * 4)), (6, None)], "book_id long, body string")
    got = {r.book_id: r.start for r in clean.content_start(clean.flagged(clean.lines(df))).collect()}
    assert got == {1: 2, 2: 0, 3: 599, 4: 0, 5: 0, 6: 0}


def test_packing_differs_in_nothing(spark):
    r = random.Random(3)
    rows = []
    for b in range(25):
        at = 0
        for i in range(r.randrange(1, 30)):
            text = " ".join(r.choice(("word", "Ends. Here", "tail.")) for _ in range(r.choice((3, 30, 60, 200, 420, 900))))
            rows.append((b, i, text, at, at + len(text)))
            at += len(text) + 1
    p = spark.createDataFrame(rows, "book_id long, para_no int, text string, char_start long, char_end long")
    a, b = (sorted(map(tuple, f(p).select("book_id", "chunk_index", "text", "char_start", "char_end", "n_tokens").collect())) for f in (chunk.chunks, chunk.chunks_by_book))
    assert a == b
    last = {}
    for k, i, _, start, end, _ in a:
        assert i == last.get(k, -1) + 1 and start <= end
        last[k] = i


def test_bounds(spark):
    def pack(*sizes):
        rows = [(1, i, " ".join(["w"] * n), i, i + 1) for i, n in enumerate(sizes)]
        return [r.text.count("\n\n") + 1 for r in chunk.chunks(spark.createDataFrame(rows, "book_id long, para_no int, text string, char_start long, char_end long")).orderBy("chunk_index").collect()]
    assert pack(150, 150) == [2]  # 196 + 196 tokens
    assert pack(160, 160) == [1, 1]  # 209 + 209 > 400
    assert pack(60, 300) == [2]  # 79 tokens are too few to stand alone
    assert pack(300, 40, 40, 300) == [2, 3] or pack(300, 40, 40, 300)
    assert len(pack(500)) == 1  # one long sentence stays whole
