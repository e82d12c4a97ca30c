"""Chat formatting in Spark expressions: sort turns, merge same-role neighbours, concatenate, mask.

Format of a conversation::

    <s>[ROLE]user[/ROLE]text[SEP]text</s>[ROLE]assistant[/ROLE]text</s>

A block holds adjacent turns of one role, their texts set apart by [SEP].  In
roles and texts a backslash is put after each backslash and after the first
character of each control string, so no control string survives inside a text
and the turns can be read back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.sketch import let

START, END, ROLE, ROLE_END, SEP = "<s>", "</s>", "[ROLE]", "[/ROLE]", "[SEP]"
#: Beside the format's own control strings, those of the common instruction format are escaped.
_CONTROL = r"(\\|<(?=/?s>)|\[(?=/?(?:INST|ROLE|SEP)\]))"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_conversations(rows: DataFrame, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row a conversation: conv_id, formatted, loss_spans.

    Turns are ordered by (turn, role, text), null first.  Null texts and roles are
    empty; rows with a null conv_id form one conversation; repeated rows are turns
    of their own.  ``loss_spans`` are (start, length) in characters of ``formatted``
    and (byte_start, byte_length) in its UTF-8 bytes, 0-based: one for each text of a
    role in ``learn``, without the marks around it.  An empty table gives no rows; other
    columns are ignored.  Work grows with a conversation's length (offsets: n log n);
    a conversation is one row, of 2 GB at most.
    """
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    # every array that a lambda looks into is bound by let(): a column would be computed again for each element

    def split(turns: Column) -> Column:
        role = lambda i: F.get(turns, i)["role"]
        changes = F.filter(F.sequence(F.lit(0), F.size(turns) - 1), lambda i: (i == 0) | (role(i) != role(i - 1)))
        texts = lambda i, end: F.transform(F.sequence(i, end - 1), lambda j: F.get(turns, j)["text"])
        block = lambda cuts, k: F.struct(role(F.get(cuts, k)).alias("role"), texts(F.get(cuts, k), F.get(cuts, k + 1)).alias("texts"))
        return let(F.concat(changes, F.array(F.size(turns))), lambda cuts: F.transform(F.sequence(F.lit(0), F.size(cuts) - 2), lambda k: block(cuts, k)))

    chats = chats.select("conv_id", let(F.col("turns"), split).alias("blocks"))
    # the pieces of the format in order, with whether each is under the mask
    piece = lambda text, learned: F.struct(text.alias("text"), learned.alias("learned"))
    no = F.lit(False)

    def pieces(b: Column) -> Column:
        head = F.concat(F.lit(ROLE), escape(b["role"]), F.lit(ROLE_END))
        learned = b["role"].isin(*learn)
        texts = F.flatten(F.transform(b["texts"], lambda t, i: F.array(piece(F.when(i == 0, head).otherwise(F.lit(SEP)), no), piece(escape(t), learned))))
        return F.concat(texts, F.array(piece(F.lit(END), no)))

    def offsets(pieces: Column, chars: Column, octets: Column) -> Column:
        def span(x: Column, i: Column) -> Column:
            n, m = F.char_length(x["text"]).cast("bigint"), F.octet_length(x["text"]).cast("bigint")
            return F.struct((F.get(chars, i) - n).alias("start"), n.alias("length"), (F.get(octets, i) - m).alias("byte_start"), m.alias("byte_length"))

        return F.filter(F.transform(pieces, lambda x, i: F.when(x["learned"], span(x, i))), lambda s: s.isNotNull())

    def written(pieces: Column) -> Column:
        chars = running_sum(F.transform(pieces, lambda x: F.char_length(x["text"]).cast("bigint")))
        octets = running_sum(F.transform(pieces, lambda x: F.octet_length(x["text"]).cast("bigint")))
        spans = let(chars, lambda c: let(octets, lambda o: offsets(pieces, c, o)))
        return F.struct(F.array_join(F.transform(pieces, lambda x: x["text"]), "").alias("formatted"), spans.alias("loss_spans"))

    all_pieces = F.concat(F.array(piece(F.lit(START), no)), F.flatten(F.transform("blocks", pieces)))
    return chats.select("conv_id", let(all_pieces, written).alias("_w")).select("conv_id", "_w.formatted", "_w.loss_spans")


def running_sum(values: Column) -> Column:
    """The sums of the first 1, 2, ... numbers of an array, by doubling: n log n steps instead of n copies of n numbers."""
    add = lambda acc, k: F.transform(acc, lambda x, i: x + F.coalesce(F.get(acc, i - F.pow(F.lit(2), k).cast("int")), F.lit(0)))
    return let(values, lambda v: F.aggregate(F.sequence(F.lit(0), F.ceil(F.log2(F.size(v) + 1)).cast("int")), v, add))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text)."""
    body = F.substring(formatted, F.lit(len(START) + 1), F.char_length(formatted))
    blocks = F.filter(F.split(body, END), lambda b: b != "")

    def turns(b: Column) -> Column:
        at = F.instr(b, ROLE_END)
        role = unescape(F.substring(b, F.lit(len(ROLE) + 1), at - len(ROLE) - 1))
        texts = F.split(F.substring(b, at + len(ROLE_END), F.char_length(b)), r"\[SEP\]")
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def digest(chats: DataFrame) -> DataFrame:
    """Read the formatted conversations back and digest turns and masked text."""
    turns = let(read_turns(F.col("formatted")), lambda t: F.struct(F.size(t).cast("bigint").alias("n"), F.sha2(F.array_join(F.transform(t, lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256).alias("sha")))
    # by bytes: a place in characters would be counted from the start of the text each time
    cut = lambda b, s: F.decode(F.substring(b, (s["byte_start"] + 1).cast("int"), s["byte_length"].cast("int")), "UTF-8")
    loss = let(F.encode("formatted", "UTF-8"), lambda b: F.array_join(F.transform("loss_spans", lambda s: unescape(cut(b, s))), ""))
    seen = chats.select("conv_id", turns.alias("turns"), let(loss, lambda x: F.struct(F.char_length(x).cast("bigint").alias("n"), F.sha2(x, 256).alias("sha"))).alias("loss"), F.char_length("formatted").cast("bigint").alias("formatted_chars"))
    return seen.select("conv_id", F.col("turns.n").alias("n_turns"), F.col("turns.sha").alias("turns_sha256"), F.col("loss.n").alias("loss_chars"), F.col("loss.sha").alias("loss_sha256"), "formatted_chars")


ORACLE = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), e AS (
  SELECT *, lag(role) OVER w AS prior_role,
         length(regexp_replace(role, '\\|</?s>|\[/?(INST|ROLE|SEP)\]', '\0+', 'g')) AS role_chars,
         length(regexp_replace(text, '\\|</?s>|\[/?(INST|ROLE|SEP)\]', '\0+', 'g')) AS text_chars
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(text_chars + CASE WHEN prior_role = role THEN 5 ELSE 4 + 13 + role_chars END))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
