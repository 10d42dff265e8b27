"""Near-duplicate filter where ids repeat or are missing."""

from boutline.llm import simhash


def left(spark, rows):
    return sorted(simhash.without_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect(), key=str)


def test_rows_that_share_an_id(spark):
    a, b = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    assert {(r["doc_id"], r["text"]) for r in left(spark, [(7, a), (7, b)])} == {(7, a), (7, b)}
    # one of the two is a copy of a smaller id
    assert {(r["doc_id"], r["text"]) for r in left(spark, [(1, a), (7, a), (7, b), (7, b)])} == {(1, a), (7, b)}


def test_near_rows_without_an_id(spark):
    words = [f"w{k}" for k in range(3000)]
    texts = {" ".join(words[:n]) for n in range(2940, 3001)}
    whole = simhash.fingerprint(" ".join(words))
    near = min((t for t in texts if 0 < (simhash.fingerprint(t) ^ whole).bit_count() <= 2), default=None)
    assert near
    got = left(spark, [(None, " ".join(words)), (None, near)])
    assert len(got) == 1
    assert [r["doc_id"] for r in left(spark, [(None, " ".join(words)), (5, near)])] == [5]
