"""Chat logs as tables: turns (conv_id, turn, role, text) plus a sessions table.

The reference keeps one dict of sessions in memory and rewrites one JSON file per
click. Here every change is a batch job: a table of requests is applied to the
turns table for many sessions at once with joins, producing a new snapshot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tremolo.operators.ordered import last_known, ranks
from tremolo.sources.records import json_objects

# The message icons.
USER_ICON, ASSISTANT_ICON = "🧑", "🤖"

CHAT_JSON_SCHEMA = "map<string, array<struct<role: string, content: string, turn: bigint>>>"
NEST_TURNS = 1024
#: outside messages a chat file has names, brackets, braces and separators only
_STRING = r'"(?:[^"\\]++|\\[\s\S])*+"'
_SESSION_NAME = r'"((?:[^"\\]++|\\[\s\S])*+)"\s*:\s*\['
_BEFORE_MESSAGE = (r'^(?:[\s,\[\]}]++|\{(?=\s*' + _STRING + r'\s*:\s*\[)|' + _STRING
                   + r'\s*:\s*(?=\[))*+')
CONTENT_RE = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})\n(\S+) ([\s\S]*)$"


# ------------------------------------------------------------------ sources and sinks

def read_chat_json(spark: SparkSession, path: str) -> DataFrame:
    """SRC5: the reference's JSON file (session name -> list of {role, content}) as turns
    ``conv_id, turn, role, content``. A document of any size is cut at the end of its messages
    (``records.json_objects``), so no row holds more than a message; the files written by
    :func:`write_chat_json` (one turn per line, with its number) read the same way.

    A message belongs to the last session name before it, and without a number of its own it takes its
    place in the session. Sessions without messages have no turns."""
    found = json_objects(spark, path)
    # in front of a message: the names of the sessions that begin there, the last one with a message
    head = F.regexp_extract("value", _BEFORE_MESSAGE, 0)
    names = F.regexp_extract_all(head, F.lit(_SESSION_NAME), F.lit(1))
    rows = found.withColumn("body", F.substr("value", F.length(head) + 1)).where(
        F.col("body") != "").withColumn("name", F.when(F.size(names) > 0, F.element_at(names, -1)))
    begins = F.when(F.col("name").isNotNull(), F.struct("name", "record"))
    rows = last_known(rows, "file", ("record",), begins, "session").where("session IS NOT NULL")
    message = F.from_json("body", "role string, content string, turn bigint")
    # a name begins a session of its own each time: places are counted from it
    placed = ranks(rows.select("file", "record", message.alias("m"), F.col("session.name").alias("name"),
                               F.struct("file", "session.record").alias("begin")), "begin", ("record",), "place")
    name = F.from_json(F.concat(F.lit('{"n":"'), "name", F.lit('"}')), "n string")["n"]  # its escapes
    return placed.select(F.nullif(name, F.lit("")).alias("conv_id"),
                         F.coalesce(F.col("m.turn"), F.col("place")).alias("turn"),
                         F.col("m.role").alias("role"), F.col("m.content").alias("content"))


def flatten_sessions(nested: DataFrame, json: str = "json") -> DataFrame:
    """SRC5: JSON texts ``{"<id>": [{role, content, turn}]}`` as turns; a message without a
    turn takes its place in the list. The inverse of :func:`nest_sessions`."""
    sessions = nested.select(F.explode(F.from_json(json, CHAT_JSON_SCHEMA))
                             .alias("conv_id", "messages"))
    return sessions.select("conv_id", F.posexplode("messages").alias("pos", "m")).select(
        F.nullif("conv_id", F.lit("")).alias("conv_id"), F.coalesce(F.col("m.turn"), F.col("pos").cast("long")).alias("turn"),
        F.col("m.role").alias("role"), F.col("m.content").alias("content"))


def parse_content(turns: DataFrame, content: str = "content") -> DataFrame:
    """Split ``"YYYY-MM-DD HH:MM:SS\\n<icon> text"`` into said_at, icon, text.
    Content that does not follow the pattern keeps its whole text, NULL time and icon."""
    c = F.col(content)
    matched = c.rlike(CONTENT_RE)
    return (turns
            .withColumn("said_at", F.when(matched, F.to_timestamp_ntz(
                F.regexp_extract(c, CONTENT_RE, 1))))
            .withColumn("icon", F.when(matched, F.regexp_extract(c, CONTENT_RE, 2)))
            .withColumn("text", F.when(matched, F.regexp_extract(c, CONTENT_RE, 3))
                        .otherwise(c)))


def build_content(said_at, role, text) -> F.Column:
    """The stored content string from its parts."""
    icon = F.when(role == "user", F.lit(USER_ICON)).otherwise(F.lit(ASSISTANT_ICON))
    return F.concat(F.date_format(said_at, "yyyy-MM-dd HH:mm:ss"), F.lit("\n"), icon,
                    F.lit(" "), text)


def _as_json(messages: F.Column) -> F.Column:
    """A session without an id is written under the empty key, and read back as NULL."""
    return F.to_json(F.create_map(F.coalesce(F.col("conv_id").cast("string"), F.lit("")), messages))


def nest_sessions(turns: DataFrame, content: str = "content", block: int | None = None) -> DataFrame:
    """SNK2, the reference's shape: a session per row as ``{"<id>": [{role, content, turn}, ...]}`` in turn
    order, turns with one number in order of role and content (conv_id, messages, json). A row holds a whole
    session; it is put together from pieces of ``NEST_TURNS`` turns that were ranked and sorted apart, so a
    session with a third of all turns is not sorted in one task. With a ``block`` the pieces of so many turns
    stay rows of their own (conv_id, piece, messages, json), and no row grows with a session."""
    rows = turns.select("conv_id", "turn", "role", F.col(content).alias("content"))
    ranked = ranks(rows, "conv_id", ("turn", "role", "content"), "_k")
    msgs = F.array_sort(F.collect_list(F.struct("_k", "turn", "role", "content")))
    nested = ranked.groupBy("conv_id", F.floor(F.col("_k") / (block or NEST_TURNS)).alias("piece")).agg(
        msgs.alias("_m")).select("conv_id", "piece", F.transform("_m", lambda x: F.struct(
            x["role"].alias("role"), x["content"].alias("content"),
            x["turn"].alias("turn"))).alias("messages"))
    if not block:
        pieces = F.array_sort(F.collect_list(F.struct("piece", "messages")))
        nested = nested.groupBy("conv_id").agg(F.flatten(F.transform(
            pieces, lambda x: x["messages"])).alias("messages"))
    return nested.withColumn("json", _as_json(F.col("messages")))


def turn_lines(turns: DataFrame, content: str = "content") -> DataFrame:
    """SNK2: a JSON text ``{"<id>": [{role, content, turn}]}`` per turn (json)."""
    turn = F.struct("role", F.col(content).alias("content"), "turn")
    return turns.select(_as_json(F.array(turn)).alias("json"))


def write_chat_json(turns: DataFrame, path: str, content: str = "content") -> None:
    """SNK2: JSON lines ``{"<id>": [{role, content, turn}]}``, one turn per line at any length
    of a session, without a shuffle (parquet of ``turns`` is the table of record)."""
    turn_lines(turns, content).write.mode("overwrite").text(path)


# ------------------------------------------------------------------ reads

def sessions_of(turns: DataFrame) -> DataFrame:
    return turns.select("conv_id").distinct()


def read_session(turns: DataFrame, requests: DataFrame) -> DataFrame:
    """The turns of the requested sessions (``conv_id``) in order; a session requested
    twice is read once, and a NULL request reads the turns without an id."""
    return turns.join(_ids(requests), _same_id(turns), "left_semi").orderBy("conv_id", "turn")


def _ids(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("conv_id").alias("_id")).distinct()


def _same_id(turns: DataFrame) -> F.Column:
    """Equal ids, NULL being an id like any other."""
    return turns["conv_id"].eqNullSafe(F.col("_id"))


def list_sessions(sessions: DataFrame, limit: int | None = None) -> DataFrame:
    """The sessions in id order; all of them unless a ``limit`` is asked for."""
    ids = sessions.select("conv_id").orderBy("conv_id")
    return ids if limit is None else ids.limit(limit)


def pairs(turns: DataFrame, text: str = "text") -> DataFrame:
    """(user message, following assistant reply) pairs per session.

    The reply is the session's next existing turn (numbers may have gaps; turns without a number come
    first) when it is the assistant's; a user turn without one gets a NULL reply. Turns without an id are
    one session. The next turn is the one before in descending order, looked up in range partitions
    (``ordered.last_known``), so a very long session is never gathered in one task; of turns with one number
    the order is that of role and text."""
    rows = turns.select("conv_id", "turn", "role", F.col(text).alias("message")).withColumns({
        "_t": -F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 62))),
        "_back": F.struct((F.col("role") == "user").alias("a"), F.xxhash64("role", "message").alias("b")),
    })
    linked = last_known(rows, "conv_id", ("_t", "_back"), F.struct("role", "message"), "_next", before=True)
    return linked.where(F.col("role") == "user").select("conv_id", "turn", "message", F.when(
        F.col("_next.role") == "assistant", F.col("_next.message")).alias("reply"))


def undo_last_pair(turns: DataFrame, text: str = "text") -> DataFrame:
    """The pairs of each session without its last pair (the last user turn is found
    by a per-session max, a partial aggregate). Turns without a number come first; of a session that has
    no other ones all are kept but none can be told to be the last."""
    p = pairs(turns, text)
    last = p.groupBy(F.col("conv_id").alias("_id")).agg(F.max("turn").alias("_last"))
    return p.join(last, F.col("conv_id").eqNullSafe(F.col("_id"))).where(
        F.col("turn").isNull() | (F.col("turn") < F.col("_last"))).drop("_id", "_last")


# ------------------------------------------------------------------ changes as batch jobs

def append_messages(turns: DataFrame, requests: DataFrame, text: str = "text") -> DataFrame:
    """B6 / SE3: append (user message, reply) for every request ``(conv_id, req_no, message,
    reply)``; the replies come with the requests, from an answer table. Nulls stay null.

    New turns follow each session's last turn, in request order; a request for an
    unknown session starts it at turn 0. Returns the new turns table."""
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("_last"))
    w = Window.partitionBy("conv_id").orderBy("req_no")
    req = (requests.join(last, "conv_id", "left")
           .withColumn("_k", F.row_number().over(w) - 1)
           .withColumn("_base", F.coalesce(F.col("_last"), F.lit(-1)) + 1 + 2 * F.col("_k")))
    new = req.select("conv_id", F.explode(F.array(
        F.struct(F.col("_base").alias("turn"), F.lit("user").alias("role"),
                 F.col("message").alias(text)),
        F.struct((F.col("_base") + 1).alias("turn"), F.lit("assistant").alias("role"),
                 F.col("reply").alias(text)))).alias("t")).select(
        "conv_id", F.col("t.turn").cast("long").alias("turn"), "t.role", F.col(f"t.{text}"))
    return turns.select("conv_id", "turn", "role", text).unionByName(new)


def new_session_id(sessions: DataFrame) -> DataFrame:
    """The next session number, max + 1 (the reference's count + 1 collides after a
    deletion). Of text ids such as "Sohbet 7" the number at the end counts."""
    number = F.regexp_extract(F.col("conv_id").cast("string"), r"(\d+)\s*$", 1).try_cast("bigint")
    return sessions.agg((F.coalesce(F.max(number), F.lit(0)) + 1).alias("conv_id"))


def clear_sessions(turns: DataFrame, targets: DataFrame) -> DataFrame:
    """Drop all turns of the target sessions (NULL: those without an id); the sessions themselves stay."""
    return turns.join(_ids(targets), _same_id(turns), "left_anti")


def delete_sessions(sessions: DataFrame, turns: DataFrame, targets: DataFrame):
    """Remove the target sessions and their turns. Returns (sessions, turns)."""
    t = _ids(targets)
    return (sessions.join(t, _same_id(sessions), "left_anti"), turns.join(t, _same_id(turns), "left_anti"))


def rename_sessions(turns: DataFrame, renames: DataFrame) -> DataFrame:
    """Apply ``(old_id, new_id)`` renames at once. A rename of a session that does not
    exist does nothing. A target that already exists (and is not itself renamed away) is
    overwritten: its turns are dropped; of several renames onto one target the one with the
    largest old id wins."""
    existing = turns.select(F.col("conv_id").alias("old_id")).distinct()
    valid = renames.where(F.col("new_id").isNotNull()).join(existing, "old_id", "left_semi")
    r = valid.groupBy("new_id").agg(F.max("old_id").alias("old_id"))
    lost = valid.join(r, ["old_id", "new_id"], "left_anti")
    overwritten = (r.select(F.col("new_id").alias("conv_id"))
                   .join(r.select(F.col("old_id").alias("conv_id")), "conv_id", "left_anti")
                   .unionByName(lost.select(F.col("old_id").alias("conv_id"))).distinct())
    kept = turns.join(overwritten, "conv_id", "left_anti")
    moved = kept.join(r, kept["conv_id"] == r["old_id"], "left")
    return moved.select(F.coalesce(F.col("new_id"), F.col("conv_id")).alias("conv_id"),
                        *[c for c in turns.columns if c != "conv_id"])
