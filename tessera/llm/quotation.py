"""Chat formatting by quotation linking (operator 8).

Mail-like messages quote what they answer: lines led by ``>`` marks, nested to
any depth. This operator rebuilds who answers whom from the quotes alone:

1. Every message is cut into passages of one quote level (paragraphs; wrapped
   lines are joined). Attribution lines above a quote and the quotes themselves
   are left out of the clean text.
2. Passages are normalised (case, blanks) and hashed. A passage belongs to the
   earliest message of its group that wrote it unquoted: one minimum per
   (group, hash), combined before the shuffle, however often it occurs. The same
   is done for the units of a passage: its sentences, its lines and itself, of
   ``UNIT_WORDS`` words or more.
3. Quoted passages are joined to their owners. One that nobody wrote whole is
   looked up unit by unit, so a quote trimmed to a sentence or to some lines
   links as well. A message answers the owner of the longest linked text (bytes
   of passages, or of linked units) on its shallowest linked level.
4. Threads follow from the answers by pointer doubling. Within a thread every
   reply comes after what it answers; reply numbers are counted in blocks of
   positions, so a thread of any size is spread over many tasks.

Defined results: null and empty texts have no passages; messages without a
group or position are threads of their own, without numbers; rows that repeat a
group and position are one message to others and are returned each; a passage
quoted before anybody wrote it links nothing; an empty table gives an empty
result; other columns are ignored whatever their names.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import python_rows, table, written

MARKS = re.compile(r"[ \t]{0,3}((?:>[ \t]?)+)")
ATTRIBUTION = re.compile(r"(?:On\b.*\bwrote|.*\b(?:wrote|writes|schrieb|escribió|a écrit)\s*):\s*$")
#: Words of the shortest sentence or line that counts as a quotation by itself.
UNIT_WORDS = 3
SENTENCE_END = re.compile(r"(?<=[.!?…])[\"')\]]*\s+")
#: Positions per block when replies are numbered.
BLOCK_BITS = 10


def lines_of(text: str | None) -> list[tuple[int, str]]:
    """(quote level, line without its marks) per line."""
    out = []
    for line in (text or "").split("\n"):
        m = MARKS.match(line)
        out.append((m.group(1).count(">"), line[m.end() :]) if m else (0, line))
    return out


def blocks_of(text: str | None) -> tuple[list[tuple[int, list[str]]], str]:
    """((level, lines of a passage) in order, clean text). A passage ends at a blank line or where the level changes."""
    lines = lines_of(text)
    own = [
        (n, line)
        for n, (level, line) in enumerate(lines)
        if level == 0 and not (ATTRIBUTION.match(line) and next((lv for lv, body in lines[n + 1 :] if lv or body.strip()), 0) > 0)
    ]
    written_here = {n for n, _ in own}
    found, level_now, held = [], 0, []
    for n, (level, line) in enumerate([*lines, (0, "")]):
        skipped = level == 0 and n < len(lines) and n not in written_here
        if held and (level != level_now or not line.strip() or skipped):
            found.append((level_now, held))
            held = []
        if line.strip() and not skipped:
            level_now = level
            held.append(line.strip())
    return found, "\n".join(line.rstrip() for _, line in own).strip()


def passages_of(text: str | None) -> tuple[list[tuple[int, str]], str]:
    """((level, passage) in order, clean text), wrapped lines joined."""
    found, clean = blocks_of(text)
    return [(level, " ".join(lines)) for level, lines in found], clean


def units_of(lines: list[str]) -> set[str]:
    """What of a passage may be quoted by itself, normalised: its sentences, its lines and the whole."""
    whole = normal(" ".join(lines))
    units = {whole, *SENTENCE_END.split(whole), *map(normal, lines)}
    return {u for u in units if len(u.split()) >= UNIT_WORDS}


def normal(passage: str) -> str:
    return " ".join(passage.lower().split())


_KEY = "group bigint, position bigint, level int, size bigint, h1 bigint, h2 bigint"


def _signed(raw: bytes, seed: int) -> int:
    return int.from_bytes(xxhash.xxh64_digest(raw, seed), "big", signed=True)


def _hashed(messages: DataFrame, columns: str, rows_of) -> DataFrame:
    """One row of ``rows_of`` (level, lines) per passage or unit of the messages that have a place."""
    types = {"bigint": pa.int64(), "int": pa.int32()}
    schema = pa.schema([(c.split()[0], types[c.split()[1]]) for c in columns.split(", ")])

    def run(batches):
        for rows in python_rows(batches):
            out = [
                (group, position, *found)
                for group, position, text in rows
                for level, lines in blocks_of(text)[0]
                for found in rows_of(level, lines)
            ]
            parts = list(map(list, zip(*out, strict=True))) if out else [[]] * len(schema)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(parts, schema.types, strict=True)], schema=schema)

    known = messages.where("group is not null and position is not null").select("group", "position", "text")
    return known.mapInArrow(run, columns)


def _whole(level: int, lines: list[str]) -> list[tuple]:
    raw = normal(" ".join(lines)).encode("utf-8")
    return [(level, len(raw), _signed(raw, 1), _signed(raw, 2))]


def _written_units(level: int, lines: list[str]) -> list[tuple]:
    raws = [] if level else [u.encode("utf-8") for u in units_of(lines)]
    return [(level, len(raw), _signed(raw, 1), _signed(raw, 2)) for raw in raws]


def _quoted_units(level: int, lines: list[str]) -> list[tuple]:
    """The units of a quoted passage, with the passage's own hashes."""
    if not level:
        return []
    ((_, _, p1, p2),) = _whole(level, lines)
    raws = [u.encode("utf-8") for u in units_of(lines)]
    return [(level, len(raw), _signed(raw, 1), _signed(raw, 2), p1, p2) for raw in raws]


def _owned(quoted: DataFrame, written_rows: DataFrame) -> DataFrame:
    """``quoted`` rows with the earliest writer of each, null if nobody wrote it before."""
    owners = written_rows.groupBy("group", "h1", "h2").agg(F.min("position").alias("owner"))
    found = quoted.join(owners, ["group", "h1", "h2"], "left")
    # A message cannot quote what was first written later.
    return found.withColumn("owner", F.when(F.col("owner") < F.col("position"), F.col("owner")))


def answers(messages: DataFrame) -> DataFrame:
    """``messages`` (group, position, text) -> (group, position, parent, quoted, linked) for messages that quote."""
    passages = written(_hashed(messages, _KEY, _whole), "passages")
    # Repeated rows of a message quote once; for owners repeats do not matter.
    whole = written(_owned(passages.where("level > 0").distinct(), passages.where("level = 0")), "quoted-passages")
    place = ["group", "position", "level", "p1", "p2"]
    named = whole.withColumnsRenamed({"h1": "p1", "h2": "p2"})
    votes, lost = named.where("owner is not null").select(*place, "owner", "size"), named.where("owner is null").select(*place)
    if not lost.isEmpty():
        units = _hashed(messages, _KEY + ", p1 bigint, p2 bigint", _quoted_units).distinct()
        units = written(units.join(lost, place, "left_semi"), "quoted-units")
        # Only what is looked for is gathered of all that was written.
        wanted = units.select("group", "h1", "h2").distinct()
        said = _hashed(messages, _KEY, _written_units).join(wanted, ["group", "h1", "h2"], "left_semi")
        votes = votes.unionByName(_owned(units, said).where("owner is not null").select(*place, "owner", "size"))
    votes = written(votes, "quotation-votes")
    per_owner = votes.groupBy("group", "position", "level", "owner").agg(F.sum("size").alias("size"))
    parents = per_owner.groupBy("group", "position").agg(F.min_by("owner", F.struct("level", -F.col("size"), -F.col("owner"))).alias("parent"))
    linked = votes.select(*place).distinct().groupBy("group", "position").agg(F.count("*").alias("linked"))
    quoted = whole.groupBy("group", "position").agg(F.count("*").alias("quoted"))
    joined = quoted.join(parents, ["group", "position"], "left").join(linked, ["group", "position"], "left")
    return joined.select("group", "position", "parent", "quoted", F.coalesce("linked", F.lit(0)).alias("linked"))


def threads(parents: DataFrame) -> DataFrame:
    """(group, position, parent or null) -> (group, position, root, depth). Parents stand at smaller positions.

    Pointers double each round: after k rounds a message points 2**k answers up. Messages that have reached
    their root rest, so roots with many answers are not joined again.
    """
    start = F.coalesce("parent", "position")
    state = parents.select("group", "position", start.alias("up"), F.col("parent").isNotNull().cast("bigint").alias("depth"))
    state = written(state.withColumn("done", F.col("depth") == 0), "thread-pointers")
    while not state.where("not done").isEmpty():
        step = state.select(F.col("group").alias("g"), F.col("position").alias("p"), F.col("up").alias("next"), F.col("depth").alias("more"), F.col("done").alias("top"))
        open_ = state.where("not done").join(step, (F.col("group") == F.col("g")) & (F.col("up") == F.col("p")))
        moved = open_.select("group", "position", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), F.col("top").alias("done"))
        state = written(state.where("done").unionByName(moved), "thread-pointers")
    return state.select("group", "position", F.col("up").alias("root"), "depth")


def numbered(placed: DataFrame) -> DataFrame:
    """(group, position, root, ...) with reply_index: 0, 1, ... in order of position within (group, root)."""
    blocked = placed.withColumn("block", F.shiftright("position", BLOCK_BITS))
    sizes = blocked.groupBy("group", "root", "block").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("group", "root").orderBy("block")) - F.col("n")
    offsets = sizes.select("group", "root", "block", before.alias("before"))
    inside = F.row_number().over(Window.partitionBy("group", "root", "block").orderBy("position")) - F.lit(1)
    ranked = blocked.withColumn("inside", inside).join(offsets, ["group", "root", "block"])
    return ranked.withColumn("reply_index", F.col("before") + F.col("inside")).drop("block", "inside", "before")


def conversations(
    messages: DataFrame, group_col: str = "conv_id", position_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """One row per message: (group, position, role, parent, root, depth, reply_index, quoted, linked, clean text).

    Sort by (group, root, reply_index) to read the conversations.
    """
    rows = messages.select(
        F.col(group_col).cast("bigint").alias("group"), F.col(position_col).cast("bigint").alias("position"),
        F.col(role_col).alias("role"), F.col(text_col).alias("text"),
    )
    found = answers(rows)
    nodes = rows.select("group", "position").where("group is not null and position is not null").distinct()
    parents = written(nodes.join(found, ["group", "position"], "left"), "answers")
    placed = numbered(threads(parents)).join(parents, ["group", "position"])
    placed = written(placed, "threads")

    @F.pandas_udf("string")
    def clean(texts):
        return texts.map(lambda t: passages_of(t)[1])

    joined = rows.join(placed, ["group", "position"], "left")
    return joined.select(
        F.col("group").alias(group_col), F.col("position").alias(position_col), F.col("role").alias(role_col), "parent", "root", "depth", "reply_index",
        F.coalesce("quoted", F.lit(0)).alias("quoted"), F.coalesce("linked", F.lit(0)).alias("linked"), clean("text").alias("clean_text"),
    )


def as_mail(conversations: DataFrame) -> DataFrame:
    """The given turns as mail: each turn quotes the one (every fourth: the one but one) before it, and what stands before that.

    Equality joins on (conversation, turn) fetch the quoted turns, so a long conversation is not one window.
    """
    rows = conversations.select("conv_id", "turn", "role", "text")
    back = F.when(F.pmod(F.col("conv_id") * 7 + F.col("turn") * 3, F.lit(4)) == 0, 2).otherwise(1)
    rows = rows.withColumns({"one": F.col("turn") - back, "two": F.col("turn") - back - 1})
    texts = conversations.groupBy("conv_id", "turn").agg(F.min("text").alias("said"))
    for name in ("one", "two"):
        said = texts.select("conv_id", F.col("turn").alias(name), F.col("said").alias(f"said_{name}"))
        rows = rows.join(said, ["conv_id", name], "left")
    quoted = lambda c, mark: F.concat(F.lit(mark), F.regexp_replace(F.col(c), "\n", "\n" + mark))
    head = F.concat(F.lit("On turn "), F.col("one").cast("string"), F.lit(" they wrote:\n"))
    nested = F.when(F.col("said_two").isNotNull(), F.concat(quoted("said_two", "> > "), F.lit("\n>\n"))).otherwise("")
    lead = F.when(F.col("said_one").isNotNull(), F.concat(head, nested, quoted("said_one", "> "), F.lit("\n\n"))).otherwise("")
    return rows.select("conv_id", "turn", "role", F.concat(lead, F.coalesce("text", F.lit(""))).alias("text"))


def linked_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    mail = written(as_mail(table(spark, sf_dir, "conversations")), "mail")
    found = conversations(mail)
    return found.select(
        "conv_id", "turn", "role", F.col("parent").alias("parent_turn"), F.col("root").alias("root_turn"), "depth", "reply_index", "quoted", "linked",
        F.sha2("clean_text", 256).alias("clean_sha256"),
    )

