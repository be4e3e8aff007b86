"""Chat formatting as relational work: turns are collected as structs, sorted, adjacent turns of one role merged into a block
by array aggregation, and the blocks concatenated. Spark expressions only.

Template: a block is ``<turn ROLE>`` text ``</turn>`` newline; texts of merged turns are parted by ``<next>``. In roles and
texts ``&``, ``<`` and ``>`` are written ``&amp;``, ``&lt;``, ``&gt;``, so no text can hold a control string, whatever it
says, and reading back is exact. The loss mask is a list of spans (start, length in code points of the formatted text) that
cover assistant texts alone: no marker, no separator.

Defined results: null text is empty; a null role is the role ""; a null turn sorts first; turns with the same number are
ordered by role, then text; fully repeated rows are separate turns; a null conversation id is a conversation; an empty table
gives an empty result; other columns are ignored. A conversation's turns are gathered in one row, as its output is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import read

CLOSE, NEXT = "</turn>\n", "<next>"
LOSS_ROLE = "assistant"
#: Elements of an array whose sums are made by appending, one after another.
RUN = 128


def escape(text: Column) -> Column:
    for plain, written in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def escaped(text: str) -> str:
    for plain, written in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = text.replace(plain, written)
    return text


def unescape(text: Column) -> Column:
    for plain, written in ((">", "&gt;"), ("<", "&lt;"), ("&", "&amp;")):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once, wherever the optimiser would otherwise repeat it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(lengths: Column) -> Column:
    """For each of the ``lengths`` (an array of bigint) the sum of those before it. An array grows by copying, so sums are made by
    runs of ``RUN`` elements, and the runs joined: time grows with the array, not with its square."""
    none = F.array().cast("array<bigint>")

    def sums(values: Column, first: Column) -> Column:
        start = F.struct(first.alias("at"), none.alias("out"))
        return F.aggregate(values, start, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    total = lambda run: F.aggregate(run, F.lit(0).cast("bigint"), lambda x, n: x + n)
    cut = lambda values: F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / RUN).cast("int")), lambda k: F.slice(values, k * RUN + 1, RUN))
    joined = lambda runs: _let(sums(F.transform(runs, total), F.lit(0).cast("bigint")), lambda before: F.flatten(F.transform(runs, lambda run, k: sums(run, F.element_at(before, k + 1)))))
    return F.when(F.size(lengths) == 0, none).otherwise(_let(lengths, lambda values: _let(cut(values), joined)))


def merged(turns: Column) -> Column:
    """Sorted turns as blocks ``role, texts``: runs of one role, however long, aggregated into one array."""

    def blocks(ts: Column) -> Column:
        opens = F.filter(F.sequence(F.lit(1), F.size(ts)), lambda i: F.when(i == 1, F.lit(True)).otherwise(F.element_at(ts, i)["role"] != F.element_at(ts, F.greatest(i - 1, F.lit(1)))["role"]))
        texts = lambda at, end: F.transform(F.slice(ts, at, end - at), lambda t: t["text"])
        return _let(opens, lambda o: F.transform(o, lambda at, k: F.struct(F.element_at(ts, at)["role"].alias("role"), texts(at, F.coalesce(F.try_element_at(o, k + 2), F.size(ts) + 1)).alias("texts"))))

    return _let(turns, blocks)


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = LOSS_ROLE) -> DataFrame:
    """``conv_id, formatted, loss_spans`` (array of ``start, length``; the first code point is 1), one row a conversation."""
    rows = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("t"),
    )
    # sorted as they are said, escaped only then: escapes sort otherwise than what they stand for
    said = F.transform(F.array_sort("ts"), lambda t: F.struct(escape(t["role"]).alias("role"), escape(t["text"]).alias("text")))
    gathered = rows.groupBy("conv_id").agg(F.collect_list("t").alias("ts")).select("conv_id", merged(said).alias("blocks"))
    head = lambda b: F.concat(F.lit("<turn "), b["role"], F.lit(">"))
    formatted = F.array_join(F.transform("blocks", lambda b: F.concat(head(b), F.array_join(b["texts"], NEXT), F.lit(CLOSE))), "")
    size = lambda c: F.char_length(c).cast("bigint")
    # what stands before each text, the text, and what follows: the head or a separator, and the end of the block
    lengths = F.flatten(
        F.transform(
            "blocks",
            lambda b: F.transform(
                b["texts"],
                lambda t, j: F.struct(
                    F.when(j == 0, size(head(b))).otherwise(len(NEXT)).alias("head"),
                    size(t).alias("text"),
                    F.when(j == F.size(b["texts"]) - 1, len(CLOSE)).otherwise(0).cast("bigint").alias("tail"),
                    (b["role"] == F.lit(escaped(loss_role))).alias("loss"),
                ),
            ),
        )
    )

    def spans(parts: Column) -> Column:
        at = running(F.transform(parts, lambda x: x["head"] + x["text"] + x["tail"]))
        placed = F.zip_with(parts, at, lambda x, n: F.struct(x["loss"].alias("loss"), (n + x["head"] + 1).cast("int").alias("start"), x["text"].cast("int").alias("length")))
        return F.transform(F.filter(placed, lambda x: x["loss"]), lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length")))

    return gathered.select("conv_id", formatted.alias("formatted"), _let(lengths, spans).alias("loss_spans"))


def turns_of(formatted: Column) -> Column:
    """The turns (array of ``role, text``) read back from a formatted text alone."""
    blocks = F.filter(F.split(formatted, CLOSE), lambda b: b != "")
    head_end = lambda b: F.instr(b, ">")
    return F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                F.split(F.substr(b, head_end(b) + 1), NEXT, -1),
                lambda x: F.struct(unescape(F.substr(b, F.lit(7), head_end(b) - 7)).alias("role"), unescape(x).alias("text")),
            ),
        )
    )


def digest(formatted: DataFrame) -> DataFrame:
    """The columns of the query, read back from the operator's output."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    # four bytes a code point: a span is found by its place, without reading what stands before it
    wide = F.encode("formatted", "UTF-32")
    under = lambda text: F.transform("loss_spans", lambda s: F.decode(F.substr(text, (s["start"] - 1) * 4 + 1, s["length"] * 4), "UTF-32"))
    loss = unescape(F.array_join(_let(wide, under), ""))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return formatted.withColumn("turns", turns_of(F.col("formatted"))).withColumn("loss", loss).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), sha(said).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"),
        sha(F.col("loss")).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return digest(format_chats(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)))


SQL = r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
e as (
  select *, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') as etext,
         replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') as erole,
         lag(role) over w as before, lead(role) over w as after
  from c window w as (partition by conv_id order by turn nulls first, role, text))
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       cast(sum(length(etext) + case when role is not distinct from before then 6 else 7 + length(erole) end
                + case when role is not distinct from after then 0 else 8 end) as bigint) as formatted_chars
from e group by conv_id
"""
