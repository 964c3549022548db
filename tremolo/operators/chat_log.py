"""B6-B12 as one ordered change log: mixed actions on many sessions, applied as if one after
the other, by joins.

A log row is (seq, conv_id, action, text, reply, new_id); ``seq`` is unique and gives the order.

* ``new``: the session exists from here on (nothing, if it does already)
* ``append``: a user turn ``text`` and an assistant turn ``reply``; an unknown session is created
* ``clear``: the session's turns go, the session stays
* ``delete``: the session goes with its turns
* ``rename``: the session is called ``new_id``; another one of that name is overwritten; nothing, if
  there is no session to rename or the name is its own

Rows without a seq, a conv_id or a known action, and renames without a ``new_id``, do nothing. Sessions and turns with
a NULL id are kept as they are; a turn's session exists even if the sessions table lacks it.

How: every name has a timeline of the log rows that name it, a rename being on two. (1) Whether a session
exists before a row follows from the row before it, but for names that got a session by a rename: that
depends on another name's past. Those links are resolved by rounds of joins among the renames alone; a
chain of renames halves in every round. (2) A session's stay under one name is a segment. Segments
are linked by the renames that took effect into paths, whose ends are found by pointer jumping.
(3) Each appended or stored turn belongs to its segment's path, hence to the name at its end; it
stays if the path's end is alive and no clear of the path came after it.

Timelines and turn numbers are looked up in range partitions (``operators.ordered``), so a session or
name with a third of all rows is not one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremolo.operators.ordered import last_known, ranks, stored

ACTIONS = ("new", "append", "clear", "delete", "rename")
START = -(1 << 62)  # the place of sessions that exist before the log


def _timelines(sessions: DataFrame, log: DataFrame) -> DataFrame:
    """name, seq, kind, other: a row for every session at START, and one or two for every change."""
    first = sessions.select(F.col("conv_id").alias("name"), F.lit(START).alias("seq"),
                            F.lit("start").alias("kind"))
    plain = log.where("action <> 'rename'").select(
        F.col("conv_id").alias("name"), "seq", F.col("action").alias("kind"))
    moves = log.where("action = 'rename'")
    away = moves.select(F.col("conv_id").alias("name"), "seq", F.lit("away").alias("kind"))
    into = moves.select(F.col("new_id").alias("name"), "seq", F.lit("into").alias("kind"))
    return first.unionByName(plain).unionByName(away).unionByName(into)


def _effects(rows: DataFrame) -> DataFrame:
    """seq, took, held of each rename: whether its session existed, and whether its new name was
    in use. ``rows`` are timelines with ``past``: the last row that decides, if any."""
    def side(kind, value, link):
        # a rename into the name decides by its own effect; every other row by its kind
        past = F.col("past")
        return rows.where(F.col("kind") == kind).select(
            "seq", F.when(past.isNull(), False).when(past["kind"] == "into", None).otherwise(
                past["kind"].isin("start", "new", "append")).alias(value),
            F.when(past["kind"] == "into", past["seq"]).alias(link))

    state = stored(side("away", "took", "took_by").join(side("into", "held", "held_by"), "seq"))
    while state.where("took IS NULL OR held IS NULL").limit(1).count():
        known = state.select(
            F.col("seq").alias("link"), F.struct("took", "took_by", "held", "held_by").alias("of"))
        for value, link in (("took", "took_by"), ("held", "held_by")):
            of = F.col("of")
            both = F.when(of["took"] | of["held"], True).when(~of["took"] & ~of["held"], False)
            # one side is known to be false: the other one's link decides
            jump = F.when(of["took"].isNull() & ~of["held"], of["took_by"]).when(
                of["held"].isNull() & ~of["took"], of["held_by"])
            state = state.join(known, F.col(link) == F.col("link"), "left").withColumn(
                value, F.coalesce(F.col(value), both)).withColumn(
                link, F.when(F.col(value).isNull(), F.coalesce(jump, F.col(link)))).drop("link", "of")
        state = stored(state)
    return state.select("seq", "took", "held")


def _path_ends(links: DataFrame) -> DataFrame:
    """segment, end: the last segment of the path from each segment that has a successor."""
    ends = stored(links)
    while True:
        nxt = ends.select(F.col("segment").alias("_s"), F.col("end").alias("_e"))
        step = ends.join(nxt, F.col("end") == F.col("_s"), "left")
        if not step.where("_s IS NOT NULL").limit(1).count():
            return ends
        ends = stored(step.select("segment", F.coalesce("_e", "end").alias("end")))


def apply_log(turns: DataFrame, sessions: DataFrame, log: DataFrame,
              text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(sessions, turns) after all changes: conv_id; and conv_id, turn, role, ``text``.

    Stored turns keep their numbers unless they were cleared; appended ones follow the last."""
    changes = log.where(F.col("seq").isNotNull() & F.col("conv_id").isNotNull()
                        & F.col("action").isin(*ACTIONS)).where(
        "action <> 'rename' OR (new_id IS NOT NULL AND new_id <> conv_id)")
    given = sessions.select("conv_id").unionByName(turns.select("conv_id")).distinct()
    known = given.where("conv_id IS NOT NULL")
    by_seq = ("seq",)
    decides = F.when(F.col("kind") != "clear", F.struct("kind", "seq"))
    rows = stored(last_known(_timelines(known, changes), "name", by_seq, decides, "past", before=True))
    effects = _effects(rows)

    # whether a session bears the name before each row, and whether one begins there
    into = F.col("past.kind") == "into"
    of_past = effects.select(F.col("seq").alias("_ps"), (F.col("took") | F.col("held")).alias("_pv"))
    of_row = effects.select(F.col("seq").alias("_rs"), F.col("took").alias("took"))
    rows = rows.join(of_past, into & (F.col("past.seq") == F.col("_ps")), "left").join(
        of_row, F.col("kind").isin("into", "away") & (F.col("seq") == F.col("_rs")), "left").withColumn(
        "exists", F.when(F.col("past").isNull(), False).when(into, F.col("_pv")).otherwise(
            F.col("past.kind").isin("start", "new", "append")))
    born = (F.col("kind") == "start") | ((F.col("kind") == "into") & F.col("took")) | (
        F.col("kind").isin("new", "append") & ~F.col("exists"))
    segment = F.struct(F.col("name"), F.col("seq").alias("since"))
    rows = stored(last_known(rows.select("name", "seq", "kind", "took", "exists", "past"), "name", by_seq,
                             F.when(born, segment), "segment").withColumn("born", born))
    rows = rows.withColumn("inside", F.col("born") | F.col("exists"))

    moves = rows.where("kind = 'away' AND took").select("segment", "seq").join(
        rows.where("kind = 'into' AND took").select("seq", F.col("segment").alias("end")), "seq")
    ends = _path_ends(moves.select("segment", "end"))

    def at_end(part: DataFrame) -> DataFrame:
        e = ends.withColumnRenamed("segment", "_s")
        return part.join(e, F.col("segment") == F.col("_s"), "left").withColumn(
            "end", F.coalesce("end", "segment")).drop("_s")

    # the sessions that are left: of each name the last row, if it leaves one
    last = rows.groupBy("name").agg(F.max_by(F.struct("kind", "segment", "inside"), "seq").alias("l"))
    alive = last.where("l.kind NOT IN ('delete', 'away') AND l.inside").select(
        F.col("name").alias("conv_id"), F.col("l.segment").alias("end"))
    cleared = at_end(rows.where("kind = 'clear' AND inside")).groupBy("end").agg(
        F.max("seq").alias("cleared"))
    alive = stored(alive.join(cleared, "end", "left"))

    kept = at_end(rows.where("kind = 'start'").select("segment", F.col("name").alias("was"))).join(
        alive.where("cleared IS NULL"), "end").select("was", "conv_id")
    stays = turns.select("conv_id", "turn", "role", text)
    old = stays.withColumnRenamed("conv_id", "was").join(kept, "was").drop("was")
    first = old.groupBy("conv_id").agg((F.max("turn") + 1).alias("base"))
    added = at_end(rows.where("kind = 'append'").select("segment", "seq")).join(alive, "end").where(
        "cleared IS NULL OR seq > cleared").select("conv_id", "seq")
    added = ranks(added, "conv_id", by_seq, "k").join(first, "conv_id", "left").join(
        changes.where("action = 'append'").select("seq", F.col("text").alias("_t"), "reply"), "seq")
    place = F.coalesce(F.col("base"), F.lit(0)) + 2 * F.col("k")
    new = added.select("conv_id", F.explode(F.array(
        F.struct(place.cast("long").alias("turn"), F.lit("user").alias("role"), F.col("_t").alias(text)),
        F.struct((place + 1).cast("long").alias("turn"), F.lit("assistant").alias("role"),
                 F.col("reply").alias(text)))).alias("t")).select("conv_id", "t.*")
    unnamed = stays.where("conv_id IS NULL")
    old = old.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", text)
    return (alive.select("conv_id").unionByName(given.where("conv_id IS NULL")),
            old.unionByName(new).unionByName(unnamed.withColumn("turn", F.col("turn").cast("long"))))
