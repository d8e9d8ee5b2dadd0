import pytest
from pyspark.sql import functions as F

from postlens.functions import numeric, text
from postlens.operators.ocr import aggregate_tokens


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).cast("string").alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).head()[0]


@pytest.mark.parametrize("raw, want", [
    (None, ""), ("", ""), ("[]", ""), ('[{"id":1}]', ""), ('[{"name":"a"},{"name":"b"}]', "a,b"),
    ("[oops", ""), ('{"name":"a"}', ""), (' [{"name":"a"}] ', "a"), ('[{"name":"a"},3,"b",{"name":"c d"}]', "a,c d"),
])
def test_tag_names(spark, raw, want):
    assert one(spark, text.tag_names(F.col("t")), t=raw) == want


@pytest.mark.parametrize("raw, ident, want", [
    ('["u/a1","u/b2"]', "b2", "u/b2"), ("u/a1, u/b2", "b2", "u/b2"), ("[u/a1, 'u/b2']", "b2", "u/b2"),
    ('["u/a1","u/b2"]', "zz", "u/a1"), ('["u/a1"]', None, None), (None, "a", None), ("", "a", None), ("[]", "a", None),
])
def test_cover_url(spark, raw, ident, want):
    assert one(spark, text.cover_url(F.col("u"), F.col("i")), u=raw, i=ident) == want


@pytest.mark.parametrize("raw, ident, want", [
    ('["u/a1","u/b2","u/c3"]', "a1", ["u/b2", "u/c3"]), ("u/a1,u/b2", None, ["u/a1", "u/b2"]), (None, "a", []),
    ('["1","2","3","4"]', "", ["1", "2", "3"]),
])
def test_inner_urls(spark, raw, ident, want):
    assert one(spark, text.inner_urls(F.col("u"), F.col("i"), 3), u=raw, i=ident) == want


def test_all_inner_urls_without_a_bound(spark):
    assert len(one(spark, text.inner_urls(F.col("u"), F.col("i")), u=",".join(f"u{i}" for i in range(40)), i="u7")) == 39


@pytest.mark.parametrize("raw, want", [("['a', b]", "a"), ("x,y", "x"), ("", ""), (None, ""), ("[]", "")])
def test_first_url(spark, raw, want):
    assert one(spark, text.first_url(F.col("u")), u=raw) == want


@pytest.mark.parametrize("length, want", [
    (1, [1]), (200, [200]), (201, [52, 52, 52, 45]), (208, [52] * 4), (500, [52] * 9 + [32]),
])
def test_chunk_lengths(spark, length, want):
    pieces = one(spark, text.content_chunks(F.col("t")), t="x" * length)
    assert [len(p) for p in pieces] == want


def test_blank_content_has_no_chunks(spark):
    assert one(spark, text.content_chunks(F.col("t")), t=" \n　\t") == []
    assert one(spark, text.content_chunks(F.col("t")), t=None) == []


def test_chunks_count_characters_not_bytes(spark):
    body = "内容😀" * 70
    assert "".join(one(spark, text.content_chunks(F.col("t")), t=body)) == body
    assert len(one(spark, text.content_chunks(F.col("t"), most=4), t=body)) == 4


def test_encoder_text(spark):
    assert one(spark, text.encoder_text(F.col("t")), t="　 a b \n") == "a b"
    assert one(spark, text.encoder_text(F.col("t")), t="  ") == " "
    assert one(spark, text.encoder_text(F.col("t")), t=None) == " "


def test_numbers(spark):
    assert one(spark, numeric.to_number(F.col("t")), t="x1") == 0.0
    assert one(spark, numeric.to_number(F.col("t")), t="2.5") == 2.5
    assert one(spark, numeric.to_number(F.col("t")), t=None) == 0.0
    assert one(spark, numeric.to_number(F.col("t")), t="NaN") == 0.0
    assert one(spark, numeric.fill_category("t"), t=None) == "missing"


def test_long_token_groups_keep_their_head(spark):
    rows = [(1, 1, i, "ab", 0.9) for i in range(500)] + [(1, 2, 0, "z", 0.2)] + [(2, 5, 0, "q", 0.1)]
    rows += [(3, i, 0, "t", 0.5 + i / 1000) for i in range(400)]
    df = spark.createDataFrame(rows, "post_id int, image_id int, pos int, text string, conf double")
    out = {r["post_id"]: r for r in aggregate_tokens(df, 200, 500).collect()}
    assert out[1]["ocr_text"] == " ".join(["ab"] * 500)[:200] and out[1]["ocr_confidence"] == pytest.approx(0.9)
    assert out[2]["ocr_text"] == "" and out[2]["ocr_confidence"] == 0.0
    whole = {r["post_id"]: r["ocr_text"] for r in aggregate_tokens(df).collect()}
    assert whole == {1: " ".join(["ab"] * 500), 2: "", 3: " ".join(["t"] * 400)}
    assert out[3]["ocr_text"] == " ".join(["t"] * 400)[:500] and out[3]["ocr_confidence"] == pytest.approx(0.899)
