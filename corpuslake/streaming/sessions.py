"""Per-conversation state over a stream of turns: active card sets and compaction triggers."""

from __future__ import annotations

import uuid
from bisect import bisect_left
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import partial
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpuslake.operators.activation import active_sets as last_touched
from corpuslake.operators.retrieval import alias_stream
from corpuslake.operators.tables import shared_folder


def _lru(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, size: int) -> Iterator[pd.DataFrame]:
    """State is the set, newest first, with each card's newest time and event, and the turns seen; batches are folded one by one."""
    cards, times, events, n = state.get if state.exists else ([], [], [], 0)
    newest = {c: (int(t), int(e)) for c, t, e in zip(cards, times, events, strict=True)}
    for rows in batches:
        out = []
        rows = rows.sort_values(["ts", "event_id"])
        for ts, event, card in zip(rows["ts"], rows["event_id"], rows["card"], strict=True):
            at = (int(pd.Timestamp(ts).value), int(event))
            newest[card] = max(at, newest.get(card, at))
            # a card that drops out is older than `size` others, and those only grow newer
            newest = dict(sorted(newest.items(), key=lambda x: x[1], reverse=True)[:size])
            n += 1
            out.append((key[0], event, n, ",".join(newest)))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "n", "active"])
    state.update((list(newest), [t for t, _ in newest.values()], [e for _, e in newest.values()], n))


def active_sets(touches: DataFrame, size: int) -> DataFrame:
    """A stream of touches (user_id, event_id, ts, card) to the active set after each: user_id, event_id, n and active, newest first.

    The set holds the `size` cards whose newest (ts, event_id) seen so far are the latest, so the set after all touches does not
    depend on the order in which they come. State is `size` cards a conversation."""
    return touches.groupBy("user_id").applyInPandasWithState(partial(_lru, size=size), "user_id long, event_id long, n long, active string", "cards array<string>, times array<long>, events array<long>, n long", "append", GroupStateTimeout.NoTimeout)


#: Slots in milliseconds; and the delay and slot of replays, as stored files come in any order.
HOUR, STORED = 3_600_000, {"delay": "3650 days", "slot": 86_400_000}


def _ordered(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, fold: Callable, start: tuple, columns: list[str], names: list[str], slot: int) -> Iterator[pd.DataFrame]:
    """Adds a conversation's new rows to those that wait, and folds what lies in closed slots, in order, into its state."""
    kept = tuple(state.get) if state.exists else ()
    held, waiting = kept[len(columns) :] or start, [list(x) for x in kept[: len(columns)]] or [[] for _ in columns]
    for batch in batches:
        for have, c in zip(waiting, columns, strict=True):
            values = batch[c]
            have += [None if no else x for x, no in zip(values.tolist(), values.isna(), strict=True)] if values.hasnans else values.tolist()
    closed = state.getCurrentWatermarkMs() // slot * slot * 1000
    rows = sorted(zip(*waiting, strict=True), key=lambda r: r[:2])
    due = bisect_left(rows, closed, key=lambda r: r[0])
    held, out = fold(held, rows[:due]) if due else (held, [])
    state.update((*([r[i] for r in rows[due:]] for i in range(len(columns))), *held))
    if due < len(rows):
        state.setTimeoutTimestamp((rows[due][0] // (slot * 1000) + 1) * slot)
    yield pd.DataFrame([(key[0], *r) for r in out], columns=names)


def in_order(turns: DataFrame, fold: Callable, start: tuple, state: str, rows: dict[str, str], out: str, delay: str, slot: int) -> DataFrame:
    """fold(state, rows) -> (state, output rows) over each user_id's rows in order of (ts, event_id): rows are tuples of the columns named
    (event_id first) behind their time in microseconds. delay: how much later than newer rows a row may come, else it is dropped. slot: milliseconds.

    Rows wait in the conversation's state. When the watermark has passed the end of a time slot, no earlier row can come any more (later ones
    are late and dropped), so all slots that are closed by then are folded in one call and let go. Python is called once a conversation and
    batch, and once when its next slot closes, however many slots there are; a call holds the rows of one conversation that wait."""
    own = turns.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).withColumn("at", F.unix_micros("ts")).where("at is not null")
    own = own.select("user_id", "ts", "at", *rows)
    columns, names = {"at": "bigint", **rows}, [x.split()[0] for x in out.split(", ")]
    waiting = ", ".join(f"_{c} array<{t}>" for c, t in columns.items())
    step = partial(_ordered, fold=fold, start=start, columns=list(columns), names=names, slot=slot)
    return own.groupBy("user_id").applyInPandasWithState(step, out, f"{waiting}, {state}", "append", GroupStateTimeout.EventTimeTimeout)


def _compaction(state: tuple, rows: list[tuple], limit: float) -> tuple[tuple, list[tuple]]:
    used, done, n = state
    out = []
    for _, event, size in rows:
        used, n = used + size, n + 1
        if due := used >= limit:
            used, done = 0, done + 1
        out.append((event, n, due, done))
    return (used, done, n), out


def _threshold(threshold: float) -> float:
    if not 0.5 <= threshold <= 0.95:
        raise ValueError("threshold must lie between 0.5 and 0.95")
    return threshold


def compactions(turns: DataFrame, capacity: int, threshold: float = 0.8, delay: str = "1 hour", slot: int = HOUR) -> DataFrame:
    """A stream of turns (user_id, event_id, ts, size) to whether each one makes a compaction due, and how many there were.

    Due: the size since the last compaction reaches threshold times capacity; the threshold lies between 0.5 and 0.95. A turn's row comes
    when the watermark, `delay` behind the newest turn, has passed its slot; results don't depend on the order of arrival within it."""
    fold = partial(_compaction, limit=_threshold(threshold) * capacity)
    return in_order(turns, fold, (0, 0, 0), "used bigint, done bigint, n bigint", {"event_id": "bigint", "size": "bigint"}, "user_id long, event_id long, n long, due boolean, compactions long", delay, slot)


#: Sizes of the kinds of active sets; None never evicts (defaults, a parameter).
SIZES = {"character": None, "relationship": 4, "world": 6}


def processed(matched: list[tuple[str, str, str]]) -> list[tuple[str, str]]:
    """(kind, card) that a turn touches, oldest first, from its (kind, card, alias) matches.

    Of each card the longest alias counts (bytes, then the smaller one). A world card goes where its alias lies inside a longer one of
    another world card; world cards are gone through from the longest alias on, the others in order of id."""
    best: dict[tuple[str, str], str] = {}
    for kind, card, alias in matched:
        old = best.get((kind, card))
        if old is None or (-len(alias.encode()), alias) < (-len(old.encode()), old):
            best[kind, card] = alias
    world = {c: a for (k, c), a in best.items() if k == "world"}
    shadowed = {c for c, a in world.items() if any(o != c and a in b and len(b.encode()) > len(a.encode()) for o, b in world.items())}
    rest = sorted((k, c) for k, c in best if k != "world")
    return rest + [("world", c) for c in sorted(world, key=lambda c: (-len(world[c].encode()), c)) if c not in shadowed]


def _activate(state: tuple, rows: list[tuple], sizes: dict[str, int | None]) -> tuple[tuple, list[tuple]]:
    """State is each active card with the time, event and place of its newest touch."""
    held = {(k, c): (t, e, p) for k, c, t, e, p in zip(*state, strict=True)}
    out = []
    for (at, event), turn in groupby(rows, key=lambda r: r[:2]):
        met = [(kind, card, alias) for _, _, kind, card, alias in turn if card is not None]
        for place, card in enumerate(processed(met)):
            held[card] = (at, event, place)
        for kind, size in sizes.items():
            own = sorted((c for c in held if c[0] == kind), key=held.get, reverse=True)
            for c in own[size:] if size is not None else ():
                del held[c]
        shown = {kind: [c for _, c in sorted((x for x in held if x[0] == kind), key=held.get, reverse=True)] for kind in sizes}
        out.append((event, len(met), ";".join(f"{k}={','.join(v)}" for k, v in shown.items())))
    flat = [(k, c, *at) for (k, c), at in held.items()]
    return tuple(list(x) for x in zip(*flat, strict=True)) if flat else ([], [], [], [], []), out


def activations(turns: DataFrame, aliases: DataFrame, sizes: dict[str, int | None] | None = None, delay: str = "1 hour", slot: int = HOUR) -> DataFrame:
    """A stream of turns (user_id, event_id, ts, text) to the active sets after each: user_id, event_id, n_matches and active (kind=newest,...;...).

    aliases: kind, card and alias of every card. A turn's cards are found by the runtime rule, shadowed aliases go, and each kind's
    set keeps its most recently touched cards. State is the active cards; turns are taken in order of (ts, event_id), as compactions() does."""
    ids = aliases.withColumn("owner", F.struct("kind", "card"))
    met = alias_stream(turns, "text", ids.select("owner", "alias"), "owner", "alias").select("user_id", "event_id", "ts", "owner.kind", "owner.card", "alias")
    rows = {"event_id": "bigint", "kind": "string", "card": "string", "alias": "string"}
    state = "kinds array<string>, cards array<string>, times array<bigint>, events array<bigint>, places array<bigint>"
    return in_order(met, partial(_activate, sizes=sizes or SIZES), ([], [], [], [], []), state, rows, "user_id long, event_id long, n_matches long, active string", delay, slot)


def kept_messages(roles: list[str], keep: int = 4) -> int:
    """How many of the newest messages stay (all: nothing is compacted): `keep`, one more if the last is the user's, but at most all but one; and
    one more if the first that stays answers a user's."""
    n = min(len(roles) - 1, keep + (roles[-1] == "user"))
    return n + (0 < n < len(roles) and roles[-n] == "assistant" and roles[-n - 1] == "user")


def _split(state: tuple, rows: list[tuple], limit: float, keep: int, least: int) -> tuple[tuple, list[tuple]]:
    """State is the size and number of messages held, of compactions, and the roles and sizes of the newest messages."""
    used, n, done, roles, sizes = state
    roles, sizes, out = list(roles), list(sizes), []
    for _, event, role, size in rows:
        used, n = used + size, n + 1
        roles, sizes = [*roles, role][-keep - 3 :], [*sizes, size][-keep - 3 :]
        older = 0
        if used >= limit and n >= least:
            stay = kept_messages(roles, keep)
            older = n - stay
            if older > 0:
                roles, sizes, n, done = roles[-stay:] if stay else [], sizes[-stay:] if stay else [], stay, done + 1
                used = sum(sizes)
        out.append((event, older, n, done))
    return (used, n, done, roles, sizes), out


def compaction_splits(turns: DataFrame, capacity: int, threshold: float = 0.8, keep: int = 4, least: int = 3, delay: str = "1 hour", slot: int = HOUR) -> DataFrame:
    """A stream of turns (user_id, event_id, ts, role, size) to the split that each one brings about: how many of the oldest messages are to
    be summarised (0: none), how many messages are held after that, and how many compactions there were.

    Due when the messages held reach threshold times capacity; those that stay count towards the next one. System messages are no
    part of the history: leave them out. State is a few messages a conversation; turns are taken in order of (ts, event_id), as compactions() does."""
    how = partial(_split, limit=_threshold(threshold) * capacity, keep=keep, least=least)
    rows = {"event_id": "bigint", "role": "string", "size": "bigint"}
    return in_order(turns, how, (0, 0, 0, [], []), "used bigint, n bigint, done bigint, roles array<string>, sizes array<bigint>", rows, "user_id long, event_id long, compacted long, kept long, compactions long", delay, slot)


def restored_sets(saved: DataFrame, session: str, active: str, touches: DataFrame, order: list[str], card: str, size: int) -> DataFrame:
    """(session, active): the saved list (oldest first) cut to its newest `size`, or where it is absent the set that a replay of the
    stored conversation leads to. Only conversations without a saved list are replayed."""
    rows = saved.select(session, active)
    there = rows.where(F.col(active).isNotNull()).select(session, F.reverse(F.slice(active, F.greatest(F.size(active) - size + 1, F.lit(1)), size)).alias(active))
    replay = last_touched(touches.join(rows.where(F.col(active).isNull()).select(session), session, "left_semi"), session, order, card, size)
    lists = replay.groupBy(session).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col(card).alias("card")))), lambda x: x["card"]).alias("_set"))
    absent = rows.where(F.col(active).isNull()).select(session).join(lists, session, "left").select(session, F.coalesce("_set", F.array().cast("array<string>")).alias(active))
    return there.union(absent)


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def _drain(out: DataFrame, folder: str) -> None:
    out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()


def run_once(spark: SparkSession, out: DataFrame) -> DataFrame:
    """All that the stream's source holds now, through the stream and into files, read back."""
    folder = _folder(spark)
    _drain(out, folder)
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


def replay(spark: SparkSession, turns: DataFrame, through: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """run_once() for streams that wait for the watermark: when the source is through, a last row of the year 2200 closes all conversations.

    That row has a ts only and comes by a folder of its own, in a second run over the same state, so no row of the source is late for it."""
    folder = _folder(spark)
    end = spark.range(1).select(*(F.to_timestamp(F.lit("2200-01-01")).cast(f.dataType).alias(f.name) if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in turns.schema))
    end.limit(0).write.parquet(f"{folder}/end")
    out = through(turns.union(spark.readStream.schema(turns.schema).parquet(f"{folder}/end")))
    # all rows of the source wait at once: this provider keeps them on disk
    with _setting(spark, "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"):
        _drain(out, folder)
        end.coalesce(1).write.mode("append").parquet(f"{folder}/end")
        _drain(out, folder)
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


def events(spark: SparkSession, path: str, per_batch: int = 8) -> DataFrame:
    """Event files as a stream; a table in one file is one batch.

    The path is given as a pattern, as Spark takes a plain path for a folder and the table may be one file."""
    head, _, name = path.rpartition("/")
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", per_batch).parquet(f"{head}/[{name[0]}]{name[1:]}")


def _last(rows: DataFrame, field: str) -> DataFrame:
    return rows.groupBy("user_id").agg(F.max_by(field, "n").alias(field))


def replayed_sets(spark: SparkSession, path: str, size: int) -> DataFrame:
    """The active sets that conversations end with, by replaying the stored stream."""
    card = F.concat_ws(":", "event_type", F.get_json_object("props", "$.k").cast("long") % 20)
    touches = events(spark, path).select("user_id", "event_id", "ts", card.alias("card"))
    return _last(run_once(spark, active_sets(touches, size)), "active")


def replayed_compactions(spark: SparkSession, path: str, capacity: int, threshold: float) -> DataFrame:
    """The number of compactions of each conversation. Files of a stored table may come in any order, so a turn may be as late as the table is long."""
    turns = events(spark, path).select("user_id", "event_id", "ts", (F.length("props") + F.length("event_type")).cast("long").alias("size"))
    return _last(replay(spark, turns, lambda t: compactions(t, capacity, threshold, **STORED)), "compactions")
