"""Text and JSON columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from postlens.settings import CHUNK_SIZE, CONTENT_LIMIT

# The white space that is trimmed from texts, wider than SQL's default.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once per row, also where lambdas read it."""
    return F.transform(F.array(value), use)[0]


def _unquote(text: Column) -> Column:
    return F.btrim(text, F.lit("\"'"))


def url_list(text: Column) -> Column:
    """a JSON array, a bracketed list that is not JSON, or a bare comma list; NULL and '' give NULL."""
    def parse(body: Column) -> Column:
        bracketed = body.startswith("[") & body.endswith("]")
        inner = F.substring(body, F.lit(2), F.greatest(F.length(body) - 2, F.lit(0)))
        loose = F.transform(F.split(inner, ","), lambda u: _unquote(strip(u)))
        plain = F.transform(F.split(body, ","), strip)
        return F.when(bracketed, F.coalesce(F.from_json(body, "array<string>"), loose)).otherwise(plain)

    return F.when(text != "", _with(strip(text), parse))


def cover_url(text: Column, file_id: Column) -> Column:
    """first URL holding the id, else the first URL; NULL when either input is empty."""
    def pick(urls: Column) -> Column:
        hit = F.try_element_at(F.filter(urls, lambda u: F.contains(u, file_id)), F.lit(1))
        return F.coalesce(hit, F.try_element_at(urls, F.lit(1)))

    return F.when(file_id != "", _with(url_list(text), pick))


def inner_urls(text: Column, file_id: Column, most: int | None = None) -> Column:
    """the other URLs, the first `most` of them if given; no list gives an empty array."""
    wanted = F.coalesce(file_id, F.lit(""))
    kept = F.filter(url_list(text), lambda u: (wanted == "") | ~F.contains(u, wanted))
    return F.coalesce(kept if most is None else F.slice(kept, 1, most), F.array().cast("array<string>"))


def first_url(text: Column) -> Column:
    """incremental runs take the first entry of the list as the cover; '' if there is none."""
    head = F.split(F.btrim(text, F.lit("[]")), ",")
    return F.coalesce(_unquote(strip(F.try_element_at(head, F.lit(1)))), F.lit(""))


def tag_names(text: Column) -> Column:
    """names of the objects in a JSON array, joined by commas; other items are skipped, anything else gives ''."""
    def parse(body: Column) -> Column:
        items = F.from_json(F.when(body.startswith("[") & body.endswith("]"), body), "array<string>")
        names = F.filter(F.transform(items, lambda t: F.get_json_object(t, "$.name")), lambda n: n.isNotNull())
        return F.array_join(names, ",")

    return F.coalesce(_with(strip(text), parse), F.lit(""))


def encoder_text(text: Column) -> Column:
    """blank becomes one space, the rest is trimmed."""
    body = strip(F.coalesce(text, F.lit("")))
    return F.when(body == "", F.lit(" ")).otherwise(body)


def content_chunks(
    text: Column, limit: int = CONTENT_LIMIT, size: int = CHUNK_SIZE, most: int | None = None
) -> Column:
    """a text of at most `limit` characters stays whole, a longer one is cut into pieces of `size`, the first
    `most` of them if given; blank has none."""

    def cut(body: Column) -> Column:
        pieces = F.regexp_extract_all(body, F.lit(f"(?s).{{1,{size}}}"), 0)
        return (
            F.when(body == "", F.array().cast("array<string>"))
            .when(F.length(body) <= limit, F.array(body))
            .otherwise(pieces if most is None else F.slice(pieces, 1, most))
        )

    return _with(strip(F.coalesce(text, F.lit(""))), cut)


def image_count(images: Column) -> Column:
    """images that are present."""
    return F.coalesce(F.size(F.filter(images, lambda i: i.isNotNull())), F.lit(0))


def has_text(text: Column) -> Column:
    """P17."""
    return (F.coalesce(text, F.lit("")) != "").cast("int")
