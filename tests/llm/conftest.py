import pytest

SF = "/root/testdata/sf0.001"
LONG = "the of and words that go on " * 4000


@pytest.fixture(scope="session")
def documents(spark):
    """The smallest table with odd rows added, and columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    base = spark.read.parquet(f"{SF}/documents.parquet")
    hex_key, key = "deadbeef00112233445566778899aabb", "AKIA" + "Q7XW3" * 4
    odd = [
        (900001, None, "en", "src0", 0), (900002, "", "en", "src0", 0), (900003, " \n\t ", None, None, 4), (900004, LONG, "en", "src1", len(LONG)),
        (900005, "same words again", "en", "src1", 16), (900005, "same words again", "en", "src1", 16), (900006, "same  words\nagain", "en", None, 17),
        (900007, f"é token = 'abc' PASSWORD: \"hunter22\" {key} x {hex_key} fin", "en", "src2", 10), (900008, "token=secret=abcdefgh token=token:abcdefg", "fr", "src2", 5),
        (900009, f"api_key={hex_key}", "fr", "src2", 5), (900010, "id q8Zx-7Lm2Vt_Rk9Wp3Yb6Nc1Hd5Jf0Gs4Ta 2024-01-02-report-final-v2-draft-ok", "de", "src3", 5),
    ]
    rows = base.unionByName(spark.createDataFrame(odd, base.schema))
    return rows.withColumns({"size": F.lit("x"), "node": F.lit(1), "t": F.lit(2), "row": F.lit(3), "words": F.lit(None).cast("string")}).cache()


@pytest.fixture(scope="session")
def docs_list(documents):
    return [(r["doc_id"], r["text"] or "", r["source"]) for r in documents.select("doc_id", "text", "source").collect()]


@pytest.fixture(scope="session")
def empty(documents):
    return documents.where("false")
