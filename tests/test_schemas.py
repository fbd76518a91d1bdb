from corpusmill import schemas
from corpusmill.config import csv_set


def test_schemas(spark):
    assert set(schemas.TABLES) == {"documents", "chunks", "questions", "clusters", "conflicts"}
    assert not schemas.IDENTITY_COLUMNS & set(schemas.schema("questions").fieldNames())
    df = schemas.conformed(spark.createDataFrame([("u", 200, "x")], "url string, http_status long, other string"), "documents")
    assert df.schema.simpleString() == schemas.schema("documents").simpleString() and df.first().http_status == 200


def test_csv_set():
    assert csv_set(" A.example, ,b.example,a.example") == ("a.example", "b.example") and csv_set(None) == ()
