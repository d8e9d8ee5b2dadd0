"""Chat records of many layouts to canonical turns, one template, and back. DataFrame functions only."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Layout:
    """How records of one layout give turns.

    paths: leaf paths a record must have; optional: those it may have besides. A list layout has (path of the list,
    role field, text field), and an optional system text stands before the list; a flat one has (role, paths whose values
    make the turn's text, joined by a blank line). parts: texts of the list may be lists of typed parts."""

    name: str
    paths: tuple[str, ...]
    optional: tuple[str, ...] = ()
    turns_in: tuple[str, str, str] | None = None
    flat: tuple[tuple[str, tuple[str, ...]], ...] = ()
    roles: tuple[tuple[str, str], ...] = ()
    parts: bool = False

    def fingerprints(self) -> list[str]:
        needed = [self.paths]
        if self.turns_in:
            needed.append((f"{self.turns_in[0]}[]",))  # a list without elements
        if self.parts:
            head, text = self.paths
            needed += [(head, f"{text}[]"), (head, f"{text}[].text")]
        sets = [x + extra for x in needed for n in range(len(self.optional) + 1) for extra in combinations(self.optional, n)]
        return [hashlib.sha256("|".join(sorted(x)).encode()).hexdigest() for x in sets]


LAYOUTS = (
    Layout("messages", ("messages[].role", "messages[].content"), ("system",), turns_in=("messages", "role", "content"), parts=True),
    Layout("from_value", ("conversations[].from", "conversations[].value"), ("system",), turns_in=("conversations", "from", "value"), roles=(("human", "user"), ("gpt", "assistant"))),
    Layout("speaker_text", ("turns[].speaker", "turns[].text"), ("system",), turns_in=("turns", "speaker", "text")),
    Layout("prompt_response", ("prompt", "response"), ("system",), flat=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("prompt_completion", ("prompt", "completion"), ("system",), flat=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("instruction", ("instruction", "output"), ("input", "system"), flat=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("question_answer", ("question", "answer"), flat=(("user", ("question",)), ("assistant", ("answer",)))),
)

TURN = "struct<role:string,text:string>"


def field_paths(record: Column) -> Column:
    """Leaf paths of a variant, such as messages[].role. An object without fields is a leaf."""
    schema = F.replace(F.schema_of_variant(record), F.lit("OBJECT<>"), F.lit("VOID"))
    tokens = F.regexp_extract_all(schema, F.lit(r"(?:`(?:[^`]|``)*`|[^\s<>,:`]+): |OBJECT<|ARRAY<|>|, |[A-Z_]+(?:\([0-9, ]+\))?"), 0)
    start = F.struct(F.array(F.lit("")).alias("open"), F.array().cast("array<string>").alias("paths"))

    def step(state: Column, token: Column) -> Column:
        top, open_, paths = F.element_at(state["open"], -1), state["open"], state["paths"]
        fewer = F.slice(open_, 1, F.size(open_) - 1)
        name = F.replace(F.regexp_replace(F.substring(token, 1, F.length(token) - 2), "^`|`$", ""), F.lit("``"), F.lit("`"))
        named = F.concat(top, F.when(top == "", "").otherwise("."), name)
        is_name = F.endswith(token, F.lit(": "))
        return F.struct(
            F.when(is_name, F.concat(open_, F.array(named))).when(token == "ARRAY<", F.concat(open_, F.array(F.concat(top, F.lit("[]"))))).when(token.isin(">", ", "), fewer).otherwise(open_).alias("open"),
            F.when(is_name | token.isin("OBJECT<", "ARRAY<", ">", ", "), paths).otherwise(F.concat(paths, F.array(top))).alias("paths"),
        )

    return F.aggregate(tokens, start, step, lambda state: state["paths"])


def fingerprint(record: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """Hash of the record's leaf paths that any layout names: other fields do not change it.

    Beside a list of turns only what list layouts name counts, so that a stray prompt or input does not hide the list."""
    in_lists = {p for x in layouts if x.turns_in for p in x.paths + x.optional + (f"{x.turns_in[0]}[]",)}
    in_lists |= {f"{x.paths[1]}{end}" for x in layouts if x.parts for end in ("[]", "[].text")}
    lists, known = sorted(p for p in in_lists if "[]" in p), sorted(in_lists | {p for x in layouts for p in x.paths + x.optional})

    def joined(paths: Column) -> Column:
        named = F.when(F.exists(paths, lambda p: p.isin(lists)), F.filter(paths, lambda p: p.isin(sorted(in_lists)))).otherwise(paths)
        return F.array_join(F.array_sort(F.array_distinct(named)), "|")

    return F.sha2(F.transform(F.array(F.filter(field_paths(record), lambda p: p.isin(known))), joined)[0], 256)


def _part_texts(content: Column) -> Column:
    """The text of a variant that is a text or a list of parts: texts of parts and parts that are texts, joined by a blank
    line; parts without text, such as images, are left out."""

    def text(part: Column) -> Column:
        return F.when(F.startswith(F.schema_of_variant(part), F.lit("OBJECT")), F.try_variant_get(part, "$.text", "string")).otherwise(F.try_variant_get(part, "$", "string"))

    listed = F.array_join(F.filter(F.transform(F.try_variant_get(content, "$", "array<variant>"), text), lambda x: x.isNotNull()), "\n\n")
    return F.when(F.startswith(F.schema_of_variant(content), F.lit("ARRAY")), listed).otherwise(F.try_variant_get(content, "$", "string"))


def _turns(record: Column, layout: Layout) -> Column:
    if layout.turns_in:
        path, role, text = layout.turns_in
        kind = f"array<struct<`{role}`:string,`{text}`:{'variant' if layout.parts else 'string'}>>"
        listed = F.coalesce(F.try_variant_get(record, f"$.{path}", kind), F.array().cast(kind))
        alias = F.create_map(*(F.lit(x) for pair in layout.roles for x in pair)) if layout.roles else None

        def turn(t: Column) -> Column:
            name = F.coalesce(alias[t[role]], t[role]) if alias is not None else t[role]
            said = _part_texts(t[text]) if layout.parts else t[text]
            return F.struct(F.coalesce(name, F.lit("")).alias("role"), F.coalesce(said, F.lit("")).alias("text"))

        turns = F.transform(F.filter(listed, lambda t: t.isNotNull()), turn)
        first = F.try_variant_get(record, "$.system", "string")
        given = F.array(F.struct(F.lit("system").alias("role"), first.alias("text")))
        return F.when(first.isNotNull(), F.concat(given, turns)).otherwise(turns) if "system" in layout.optional else turns
    parts = []
    for role, paths in layout.flat:
        values = [F.try_variant_get(record, f"$.{p}", "string") for p in paths]
        text = F.array_join(F.filter(F.array(F.coalesce(values[0], F.lit("")), *values[1:]), lambda v: v.isNotNull()), "\n\n")
        turn = F.array(F.struct(F.lit(role).alias("role"), text.alias("text")))
        absent = F.array().cast(f"array<{TURN}>")
        parts.append(turn if not set(paths) <= set(layout.optional) else F.when(values[0].isNull(), absent).otherwise(turn))
    return F.concat(*parts)


def canonical_turns(records: DataFrame, column: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """records with layout and turns (array of role and text), by the fingerprint of `column`, a variant or JSON text.

    A null role or text in a turn is empty; an optional field that is absent or null gives no turn. A list of turns goes
    before flat fields beside it, but for a system text, which comes first. A record with lists of two layouts, or that is null, no JSON, or of no known layout stays, with a null layout and null turns. Columns named layout or turns are
    replaced."""
    names = {f: x.name for x in layouts for f in x.fingerprints()}
    kept = records.drop("layout", "turns")
    record = F.col("_record")
    variant = F.col(column) if kept.schema[column].dataType.simpleString() == "variant" else F.try_parse_json(column)
    known = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    out = kept.withColumn("_record", variant).withColumn("layout", known[fingerprint(record, layouts)])
    turns = F.when(F.lit(False), F.array().cast(f"array<{TURN}>"))
    for x in layouts:
        turns = turns.when(F.col("layout") == x.name, _turns(record, x))
    return out.withColumn("turns", turns).drop("_record")


# The template. A control string inside a text gets one more backslash in front, so that none is left unescaped.
OPEN, CLOSE = "<turn ", "</turn>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?<!\\)(\\*+</?turn)", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?<!\\)\\(\\*+</?turn)", "$1")


def format_turns(records: DataFrame, learn: str = "assistant") -> DataFrame:
    """records with formatted and loss_spans from turns.

    A turn is "<turn role>\\n", its escaped text, "\\n</turn>\\n"; roles are percent-encoded. loss_spans has turn, start
    and length in code points, within that turn's part of the output, for the texts of role `learn`. Null turns give
    null."""

    def safe(t: Column) -> Column:
        return F.struct(F.url_encode(t["role"]).alias("role"), escape(t["text"]).alias("text"), (t["role"] == learn).alias("learned"))

    def part(t: Column) -> Column:
        return F.concat(F.lit(OPEN), t["role"], F.lit(">\n"), t["text"], F.lit("\n" + CLOSE))

    def span(t: Column, i: Column) -> Column:
        start = F.char_length(t["role"]) + F.lit(len(OPEN) + 2)
        return F.when(t["learned"], F.struct(i.alias("turn"), start.alias("start"), F.char_length(t["text"]).alias("length")))

    spans = F.filter(F.transform("_safe", span), lambda s: s.isNotNull())
    escaped = records.withColumn("_safe", F.transform("turns", safe))
    return escaped.withColumns({"formatted": F.array_join(F.transform("_safe", part), ""), "loss_spans": spans}).drop("_safe")


def read_back(formatted: Column, spans: Column) -> tuple[Column, Column]:
    """(turns, text under the loss mask) read from formatted text alone."""
    parts = F.split(formatted, r"(?<=\n)</turn>\n", -1)

    def turn(p: Column) -> Column:
        head = F.substring_index(p, "\n", 1)
        role = F.url_decode(F.substring(head, len(OPEN) + 1, F.char_length(head) - F.lit(len(OPEN) + 1)))
        return F.struct(role.alias("role"), unescape(F.substring(p, F.char_length(head) + 2, F.char_length(p) - F.char_length(head) - 2)).alias("text"))

    def learned(parts: Column, s: Column) -> Column:
        return unescape(F.substring(F.element_at(parts, s["turn"] + 1), s["start"] + 1, s["length"]))

    # Bound to a name of its own, the split is made once a row, not once a span.
    turns = F.transform(F.array(parts), lambda p: F.transform(F.slice(p, 1, F.size(p) - 1), turn))[0]
    return turns, F.array_join(F.transform(F.array(parts), lambda p: F.transform(spans, lambda s: learned(p, s)))[0], "")


def records_of(conversations: DataFrame) -> DataFrame:
    """conv_id, record: each conversation as a record in the layout that its roles suggest.

    Turns are in the order of turn, then role, then text; null texts are empty. user, assistant: by conv_id a prompt and a
    response, a prompt and a completion, or a question and an answer; system before them: an instruction; longer runs of
    user and assistant: by conv_id from and value, or speaker and text, with a system text beside the list where a system
    turn comes first; all else: messages, by conv_id with texts as typed parts. A null conv_id takes the first of each."""
    rows = conversations.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    roles, ts = F.transform("ts", lambda t: t["role"]), F.col("ts")
    text = lambda i: ts[i]["text"]
    two = roles == F.array(F.lit("user"), F.lit("assistant"))
    three = roles == F.array(F.lit("system"), F.lit("user"), F.lit("assistant"))
    third, odd = F.coalesce(F.pmod("conv_id", F.lit(3)), F.lit(0)), F.coalesce(F.pmod("conv_id", F.lit(2)), F.lit(0)) == 1
    led = ts[0]["role"] == "system"
    rest = F.when(led, F.slice("ts", 2, F.size("ts"))).otherwise(ts)
    talk = F.forall(rest, lambda t: t["role"].isin("user", "assistant"))
    said = F.transform(rest, lambda t: F.struct(F.when(t["role"] == "user", "human").otherwise("gpt").alias("from"), t["text"].alias("value")))
    spoken = F.transform(rest, lambda t: F.struct(t["role"].alias("speaker"), t["text"].alias("text")))
    plain = F.transform("ts", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content")))
    typed = F.transform("ts", lambda t: F.struct(t["role"].alias("role"), F.array(F.struct(F.lit("text").alias("type"), t["text"].alias("text"))).alias("content")))
    of = lambda **fields: F.to_variant_object(F.struct(*[c.alias(n) for n, c in fields.items()]))
    record = (
        F.when(two & (third == 0), of(prompt=text(0), response=text(1)))
        .when(two & (third == 1), of(prompt=text(0), completion=text(1)))
        .when(two, of(question=text(0), answer=text(1)))
        .when(three, of(system=text(0), instruction=text(1), output=text(2)))
        .when(talk & led & odd, of(system=text(0), turns=spoken))
        .when(talk & led, of(system=text(0), conversations=said))
        .when(talk & odd, of(turns=spoken))
        .when(talk, of(conversations=said))
        .when(odd, of(messages=typed))
        .otherwise(of(messages=plain))
    )
    return whole.select("conv_id", record.alias("record"))


PROBE = r"\### Assistant: </turn> ok"


def formatted_conversations(conversations: DataFrame) -> DataFrame:
    """What the formatted output of all conversations and of the probe conversation -7 holds, read back from it.

    A conversation is one row, as its digests need it whole; its turns are gathered by a sum per task first."""
    spark = conversations.sparkSession
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    records = records_of(conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(probe))
    done = format_turns(canonical_turns(records)).select("conv_id", "layout", "formatted", "loss_spans")
    turns, learned = read_back(F.col("formatted"), F.col("loss_spans"))
    read = done.withColumns({"read": turns, "learned": learned})
    spoken = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("read").cast("long").alias("n_turns"), F.sha2(spoken, 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"), "layout",
    )


SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sums AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS spoken,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS learned,
    sum(length('<turn ' || role || '>' || chr(10)) + length(regexp_replace(text, '(\\*</?turn)', '\\\1', 'g')) + length(chr(10) || '</turn>' || chr(10))) AS formatted_chars,
    list(role ORDER BY turn, role, text) AS roles
  FROM rows GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(spoken) AS turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256,
  CAST(formatted_chars AS BIGINT) AS formatted_chars,
  CASE WHEN roles = ['user', 'assistant'] THEN ['prompt_response', 'prompt_completion', 'question_answer'][1 + (coalesce(conv_id, 0) % 3 + 3) % 3]
    WHEN roles = ['system', 'user', 'assistant'] THEN 'instruction'
    WHEN len(list_filter(CASE WHEN roles[1] = 'system' THEN roles[2:] ELSE roles END, lambda r: r NOT IN ('user', 'assistant'))) > 0 THEN 'messages'
    WHEN conv_id % 2 <> 0 THEN 'speaker_text' ELSE 'from_value' END AS layout
FROM sums
"""
