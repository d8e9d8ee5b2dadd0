import re

from pyspark.sql import functions as F

from postlens.llm import decontamination as dec


def plain_tokens(text):
    """(kind or word, filler or None) by a scan of its own."""
    out, last, last_end = [], None, 0
    for m in re.finditer(r"\d+(?:[.,]\d+)*|[^\W\d_]+", text):
        w, before = m[0], text[: m.start()]
        if w[0].isdigit():
            out.append(("number", w))
        elif last == "number" and before[last_end:] in ("", " ") and w.lower() == w and w in dec.UNITS:
            out.append(("unit", w))
        elif len(w) > 1 and w[0].isupper() and w[1].islower() and re.search(r"[^\W\d_A-ZÀ-Þ] $|[\d,;:)] $", before):
            out.append(("name", w.lower()))
        else:
            out.append((w.lower(), None))
        last, last_end = ("number" if w[0].isdigit() else "word"), m.end()
    return out


def plain(docs, items, window=8, stride=4):
    found = set()
    for d, text in docs:
        t = plain_tokens(text or "")
        for i, item in items:
            u = plain_tokens(item)
            width = min(window, len(u))
            if len(u) < 4:
                continue
            shifts = {}
            for a in range(0, len(t) - width + 1, stride if width == window else 1):
                for b in range(len(u) - width + 1):
                    x, y = u[b : b + width], t[a : a + width]
                    if 2 * sum(f is None for _, f in x) > width and [k for k, _ in x] == [k for k, _ in y]:
                        cells, fills = shifts.setdefault(a - b, (set(), set()))
                        cells |= set(range(b, b + width))
                        fills |= {((k, f), g) for (k, f), (_, g) in zip(x, y, strict=True) if f is not None}
            covered = set().union(*(c for c, f in shifts.values() if len({a for a, _ in f}) == len(f)))
            if 100 * len(covered) >= 50 * len(u):
                found.add((d, i))
    return found


ITEM = "if the train with Anna leaves at 9 and runs 120 km in 2 hours then how fast does the train with Anna run from the town at 9 on a day like this"
OTHER = ITEM.replace("Anna", "Boris").replace("120 km", "300 miles").replace(" 9 ", " 11 ")
INCONSISTENT = ITEM.replace("with Anna leaves", "with Boris leaves").replace("with Anna run", "with Carla run")


def test_templates_and_slots(spark):
    items = [(1, ITEM), (2, "short item of five words"), (3, "too short one"), (4, None), (None, ITEM), (5, ""), (6, "1 2 3 4 5 6 7 8 9 10 11 12")]
    docs = [
        (1, "before it, " + ITEM + " and after"), (2, "one two three " + OTHER), (3, INCONSISTENT), (4, None), (5, ""), (None, ITEM), (6, "here is a short item of five words, too"),
        (7, "too short one"), (8, "9 8 7 6 5 4 3 2 1 0 1 2 3"), (9, " ".join(ITEM.split()[:6])), (10, "clean text of many other words " * 30), (11, ITEM), (11, ITEM), (12, ("filler words " * 30_000) + OTHER),
        (13, ITEM.upper()), (14, ITEM.replace(" ", "\n ").replace("fast", "fast,")),
    ]
    clash = {c: F.lit("x") for c in ("hash", "raw", "words", "at", "shift", "pairs", "width", "covered")}
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns(clash)
    b = spark.createDataFrame(items, "item_id long, text string").withColumns(clash)
    rows = dec.leaks(d, b).collect()
    got = {(r.doc_id, r.item_id): r for r in rows}
    assert len(rows) == len(got)
    assert {(1, 1), (2, 1), (6, 2), (11, 1), (12, 1)} <= set(got)
    assert not {k for k, _ in got} & {4, 5, 7, 8, 9, 10}
    assert (3, 1) not in got
    assert not got[1, 1].reparameterised and got[2, 1].reparameterised and got[12, 1].reparameterised
    assert got[11, 1].covered >= 28
    assert dec.leaks(d.limit(0), b).count() == 0 and dec.leaks(d, b.limit(0)).count() == 0
    small = [x for x in docs if x[0] not in (None, 11, 12, 13, 14)] + [(11, ITEM)]
    assert {k for k in got if k[0] not in (12, 13, 14)} == plain(small, [x for x in items if x[0] and x[1]])


def test_documents(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id) for r in dec.leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    assert got == {(d, i) for d, t in docs for i, b in items if b in (t or "")}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    exact = {(r.doc_id, r.item_id) for r in docs.join(items.withColumnRenamed("text", "b"), F.expr("contains(text, b)")).select("doc_id", "item_id").collect()}
    assert {(r.doc_id, r.item_id) for r in dec.leaks(docs, items).collect()} == exact and exact


def test_no_python_in_plan(spark, sf_dir):
    leaks = dec.leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    assert "Python" not in leaks._jdf.queryExecution().toString() and "Arrow" not in leaks._jdf.queryExecution().toString()


def test_short_and_partial_runs_at_every_offset(spark):
    nine = "seven green boats drift slowly past our old mill"
    long = "a quiet stream turns west below the broken bridge where four herons stand and wait for evening rain"
    half = " ".join(long.split()[3:12])  # 9 of 18 words
    d = spark.createDataFrame([(10 * k + j, "zz " * k + t + " yy") for k in range(4) for j, t in enumerate((nine, half))], "doc_id long, text string")
    rows = dec.leaks(d, spark.createDataFrame([(1, nine), (2, long)], "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id, r.covered) for r in rows} == {(10 * k + j, j + 1, 9) for k in range(4) for j in range(2)}


def test_copies_in_another_setting_case_or_wrapping(spark):
    capital = "What is the capital of France?"
    items = spark.createDataFrame([(1, ITEM), (2, capital)], "item_id long, text string")
    docs = [(1, ITEM.upper()), (2, ITEM.lower()), (3, ITEM.replace(" ", "\n ").replace("fast", "fast,")), (4, OTHER.replace(" ", " \r\n")), (5, INCONSISTENT)]
    docs += [(10 + i, before + capital) for i, before in enumerate(("", "Question: ", "1) ", "well, ", "he asks ", "QUESTION\n"))]
    docs += [(20, "Question: " + capital.replace("France", "Spain")), (21, "Question: " + capital.replace("What", "Where")), (22, capital.upper()), (23, ITEM.lower().replace(" 9 ", " 11 ").replace("120", "300"))]
    got = {(r.doc_id, r.item_id): (r.covered, r.reparameterised) for r in dec.leaks(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()}
    n = len(ITEM.split())
    assert got == {(1, 1): (n, False), (2, 1): (n, False), (3, 1): (n, False), (4, 1): (n, True), (20, 2): (6, True), (22, 2): (6, False), (23, 1): (n, True)} | {(10 + i, 2): (6, False) for i in range(6)}


def test_copies_of_items_full_of_placeholders(spark):
    sums = "Compute 12 + 7 * 3 - 4 / 2 + 9 * 6."
    train = "If the trains of Anna, Boris, Carla, Doris and Emil leave at 9, Anna drives 120 km, Boris drives 80 miles and Carla 60, who of Anna and Boris is first?"
    items = spark.createDataFrame([(1, sums), (2, train), (3, "1 2 3 4 5")], "item_id long, text string")
    docs = [(1, "so: " + sums + " Then"), (2, "x " + train + " y"), (3, "Compute 13 + 8 * 4 - 5 / 3 + 8 * 7."), (4, "5 4 3 2 1 9 8 7 6"), (5, "0 1 2 3 4 5 6")]
    got = {(r.doc_id, r.item_id): (r.covered, r.item_words, r.reparameterised) for r in dec.leaks(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()}
    n = len(plain_tokens(train))
    assert got == {(1, 1): (8, 8, False), (2, 2): (n, n, False), (5, 3): (5, 5, False)}
