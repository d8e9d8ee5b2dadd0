import pytest
from pyspark.sql import functions as F

ODD_TEXTS = [None, "", " \n\t ", "one", "one two", "tie tie tie tie", "1234 !!", "été Ünïcode ß", "a\x1cb \x85 c", "x" * 5000, "  lead and trail  ", "a\n\n b\r\n c\x0bd", "word, word. word!",
             "it's 'tis <s> </s> <|endoftext|> ▁mark ▁", "same text of a few words here", "same text of a few words here", "same text of a few words here now"]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and odd texts, repeated rows, ties, one long text, extra columns of clashing names."""
    rows = [(i, t, "en" if i % 2 else None, None, len(t or "")) for i, t in enumerate(ODD_TEXTS)]
    rows += [rows[14], (None, None, None, None, None), (None, "a null id has text", "en", "s", 1), (400, " ".join(f"w{i}" for i in range(60_000)), "en", "long", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clash = ["score", "n_tokens", "key", "a", "b", "h1", "rep", "node", "component", "cluster", "window", "task", "side", "kept", "rejected_by", "lang_pred", "words", "hash", "item_id", "tie"]
    return docs.withColumns({c: F.lit("x") for c in clash})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def texts_of(spark, sf_dir):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
