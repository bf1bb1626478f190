"""Chat formatting by grammar round trip, with DataFrame expressions only.

Grammar of a formatted conversation::

    conversation := turn*
    turn         := "### " role "\n" body "\n</turn>\n"

``role`` has no newline (a newline is written ``\n``, a backslash ``\b``). A ``body`` holds no control string
(``### `` or ``</turn>``) unless a backslash stands before it. A conversation is first rendered as it is and
parsed again by this grammar; where the turns that come back differ, or the grammar rejects a body, its
conflicting content is escaped (one more backslash before each control string) and the comparison is repeated.
Escaping adds exactly one backslash to the run before each control string and parsing removes exactly one, so
the second rendering always returns the source; ``round_trip`` reports the comparison for every row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, END = "### ", "\n</turn>\n"
_CONTROL = r"(?:### |</turn>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"(\\*{_CONTROL})", r"\\$1")


def unescape(body: Column) -> Column:
    return F.regexp_replace(body, rf"\\(\\*{_CONTROL})", "$1")


def _role_out(role: Column) -> Column:
    return F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n"))


def _role_in(role: Column) -> Column:
    return F.replace(F.replace(role, F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def render(turns: Column, escaped: bool) -> Column:
    """array<struct<role, text>> to one string."""
    body = (lambda t: escape(t)) if escaped else (lambda t: t)
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(HEAD), _role_out(t["role"]), F.lit("\n"), body(t["text"]), F.lit(END))), "")


def _parts(formatted: Column) -> Column:
    """What stands before each end mark; the empty rest after the last one is dropped."""
    parts = F.split(formatted, END, -1)
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def parse(formatted: Column) -> Column:
    """The deterministic parser: array<struct<role, text>>; text is null where the grammar rejects a body."""

    def turn(part: Column) -> Column:
        rest = F.substring(part, len(HEAD) + 1, 2**31 - 1)
        role = F.substring_index(rest, "\n", 1)
        body = rest.substr(F.char_length(role) + 2, F.char_length(rest))
        fits = part.startswith(HEAD) & rest.contains("\n") & ~body.rlike(rf"(?<!\\){_CONTROL}")
        return F.struct(_role_in(role).alias("role"), F.when(fits, unescape(body)).alias("text"))

    return F.transform(_parts(formatted), turn)


def loss_spans(formatted: Column, learn_role: str = "assistant") -> Column:
    """array<struct<start, len>>: code-point spans of the (escaped) bodies of turns with that role."""
    zero = F.struct(
        F.lit(0).cast("long").alias("at"),
        F.array().cast("array<struct<start:bigint,len:bigint>>").alias("spans"),
    )

    def step(acc: Column, part: Column) -> Column:
        head = F.char_length(F.substring_index(part, "\n", 1)) + 1
        size = F.char_length(part)
        span = F.struct((acc["at"] + head).alias("start"), (size - head).cast("long").alias("len"))
        learn = F.substring_index(part, "\n", 1) == HEAD + learn_role
        return F.struct(
            (acc["at"] + size + len(END)).alias("at"),
            F.when(learn, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"),
        )

    return F.aggregate(_parts(formatted), zero, step, lambda acc: acc["spans"])


def masked_text(formatted: Column, spans: Column) -> Column:
    """The unescaped text under the loss mask, span after span."""
    return F.array_join(F.transform(spans, lambda s: unescape(formatted.substr((s["start"] + 1).cast("int"), s["len"].cast("int")))), "")


def format_conversations(turns: DataFrame, learn_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans, n_escaped_turns, round_trip.

    ``turns`` has conv_id, turn, role, text; other columns are ignored. Rows go by turn (null first), then role,
    then text, so ties and repeated rows keep one order and repeated rows are repeated turns. Null role or text
    is empty; a null conv_id is a conversation of its own. No rows give no rows. The rows of one conversation
    meet in one task, for its output is one string; so do very long texts. ``loss_spans`` are places by code point, which
    are cut from the string one by one, so reading them back costs a conversation's length for each assistant turn.
    """
    rows = turns.select(
        "conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text")
    )
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    source = grouped.select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    plain = source.withColumn("plain", render(F.col("turns"), escaped=False))
    chosen = plain.select(
        "conv_id",
        "turns",
        F.when(parse(F.col("plain")).eqNullSafe(F.col("turns")), F.col("plain")).otherwise(render(F.col("turns"), escaped=True)).alias("formatted"),
    )
    return chosen.select(
        "conv_id",
        "formatted",
        loss_spans(F.col("formatted"), learn_role).alias("loss_spans"),
        F.size(F.filter("turns", lambda t: t["text"].rlike(_CONTROL))).alias("n_escaped_turns"),
        parse(F.col("formatted")).eqNullSafe(F.col("turns")).alias("round_trip"),
    )


def digest_rows(formatted: DataFrame) -> DataFrame:
    """The digest columns, read back from the formatted text and its loss mask."""
    back = formatted.withColumn("turns", parse(F.col("formatted"))).withColumn("learned", masked_text(F.col("formatted"), F.col("loss_spans")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "round_trip",
    )


#: The conversation that the query adds: control strings of the template inside texts.
PROBE = [(-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")]


def op1_chat_format(spark, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame(PROBE, "conv_id long, turn long, role string, text string")
    return digest_rows(format_conversations(table.unionByName(probe)))


OP1_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), joined AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS learned,
         sum(4 + length(replace(replace(role, '\', '\b'), chr(10), '\n')) + 1 + length(text)
             + len(regexp_extract_all(text, '### |</turn>')) + 9) AS formatted_chars
  FROM rows GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256,
       formatted_chars::BIGINT AS formatted_chars, true AS round_trip
FROM joined
"""
