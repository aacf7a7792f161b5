"""Card viewer replay (N01-N03) over per-topic decks; H18-H19 are in functions.

The viewer stands at p = 3 * index + phase of the deck of its topic. With N
cards in that deck: next -> (p + 1) mod 3N, prev -> max(p - 1, 0), another topic
-> p = 0 of its deck. A stored state is where a user begins; an index beyond the
deck restarts at 0 and keeps the phase (a negative one goes to the last card).
A user without a stored state begins at 0 of ``all``. In a deck without cards
positions go on without wrapping, as on the page.

All events are range-partitioned by (user, ts, event_id), sorted, and walked in
that order, a user's history over as many tasks as it fills. A task knows where
it stands from the first topic change or new user it meets; what comes before
goes on from an earlier task and is left open. The tasks' end states, one row a
task, are chained on the driver. Where a stretch fills whole tasks (a user with
more events than a task takes, in one topic), each such task's effect is first
found as a function of the position it begins at (``Drift``: no larger than its
number of prevs, however large the deck), and the driver applies these one at a
time. Then the open stretches are walked from the positions so found.

Stretches between topic changes are walked with running sums and minima: p is
the running sum held up at 0, started again at 0 where it reaches 3N.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deckflow.session import cut, shuffle_partitions

NEXT, PREV, TOPIC = "next", "prev", "topic"
ALL = "all"
EVENT, OPEN, TASK = 0, 1, 2


def deck_sizes(cards: DataFrame) -> DataFrame:
    """Cards per topic, and of ``all``."""
    own = cards.filter(F.col("topic").isNotNull() & (F.col("topic") != ALL)).groupBy("topic").agg(F.count(F.lit(1)).alias("n"))
    return own.union(cards.agg(F.lit(ALL).alias("topic"), F.count(F.lit(1)).alias("n")))


def walk(steps, p: int, size: int):
    """Positions after each step (+1 or -1) from ``p`` in a deck of ``size``
    positions (0: never wraps)."""
    import numpy as np
    n = len(steps)
    out, at, ahead = np.empty(n, np.int64), 0, 64 + 2 * size
    while at < n:
        upto = min(n, at + ahead) if size else n
        total = p + np.cumsum(steps[at:upto], dtype=np.int64)
        here = total - np.minimum(np.minimum.accumulate(total), 0)
        over = np.flatnonzero(here >= size) if size else here[:0]
        if len(over):
            upto = at + int(over[0]) + 1
            out[at:upto] = here[:upto - at]
            out[upto - 1] = p = 0
            ahead = 64 + 2 * size
        else:
            out[at:upto] = here
            p = int(here[-1])
            ahead *= 2
        at = upto
    return out


class Drift:
    """Where a run of steps leads from any position of a deck.

    Positions are labels on a ring that turns by ``turn``; a prev keeps the label
    at 0 in its place while the others move, so it joins the label that comes
    to 0 with it. Only labels that ever stood at 0 during a prev need a record;
    all others just turn."""

    def __init__(self, size: int):
        self.size, self.turn, self.floor = size, 0, 0
        self.holder: dict[int, int | None] = {}  # slot -> label, where not its own
        self.joined: dict[int, int] = {}         # label -> label it stands with
        self.slot: dict[int, int] = {}           # label -> slot, where not its own

    def add(self, steps) -> None:
        import numpy as np
        if not self.size:
            total = np.cumsum(steps, dtype=np.int64)
            low = int(total.min(initial=0))
            self.floor = max(self.floor + int(total[-1]), int(total[-1]) - low)
            self.turn += int(total[-1])
            return
        before = 0
        for i in np.flatnonzero(steps < 0).tolist():
            self.turn += i - before  # the nexts since the last prev
            before = i + 1
            zero, one = -self.turn % self.size, (1 - self.turn) % self.size
            self.turn -= 1
            if self.size == 1:
                continue
            label, other = self.holder.get(zero, zero), self.holder.get(one, one)
            if label is None:
                continue
            self.holder[zero] = None
            if other is None:
                self.holder[one], self.slot[label] = label, one
            else:
                self.joined[label] = other
        self.turn += len(steps) - before

    def after(self, p: int) -> int:
        if not self.size:
            return max(p + self.turn, self.floor)
        while p in self.joined:
            p = self.joined[p]
        return (self.slot.get(p, p) + self.turn) % self.size


def go_on(steps, marks, state):
    """Positions after each row from ``state`` (p, size, topic). Rows with step 0
    are marks: ``marks[i]`` is their (p, size, topic). Also returns the stretches
    ``(from, to, topic)`` and the state at the end."""
    import numpy as np
    place, stretches = np.empty(len(steps), np.int64), []
    p, size, topic = state
    edges = [0, *np.flatnonzero(steps == 0).tolist(), len(steps)]
    for i, j in zip(edges, edges[1:]):
        if i == j:
            continue
        begin = i
        if steps[i] == 0:
            p, size, topic = marks[i]
            place[i] = p
            i += 1
        if i < j:
            place[i:j] = walk(steps[i:j], p, size)
            p = int(place[j - 1])
        stretches.append((begin, j, topic))
    return place, stretches, (p, size, topic)


def _rows(b, kind, topics, place, task):
    import numpy as np
    import pyarrow as pa
    n = b.num_rows
    return pa.RecordBatch.from_arrays([
        pa.array(kind), b.column("user_id"), b.column("ts"), b.column("event_id"), pa.array(topics, pa.string()), pa.array(place), b.column("step"),
        pa.array(np.full(n, task, np.int32)), pa.nulls(n, pa.binary())], names=_NAMES)


_NAMES = ["kind", "user_id", "ts", "event_id", "topic", "p", "step", "task", "state"]


def _first_walk(start):
    """Walks a task's sorted rows; ``start`` is the state of a new user."""
    def run(batches):
        import pickle

        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext
        task, begun, known, first, user, state, schema = TaskContext.get().partitionId(), False, False, None, None, start, None
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            users, steps, schema = b.column("user_id"), b.column("step").to_numpy(), b.schema
            same = users.dictionary_encode().indices.fill_null(-1).to_numpy()
            turns = (np.flatnonzero(same[1:] != same[:-1]) + 1).tolist()
            head = users[0].as_py()
            if not begun:
                begun, first = True, head
            elif head != user:
                known, state = True, start
            user = users[n - 1].as_py()
            marks = {i: (b.column("p")[i].as_py(), b.column("size")[i].as_py(), b.column("topic")[i].as_py()) for i in np.flatnonzero(steps == 0).tolist()}
            kind, place, topics = np.zeros(n, np.int32), np.zeros(n, np.int64), np.full(n, None, object)
            for k, (i, j) in enumerate(zip([0, *turns], [*turns, n])):
                if k:
                    known, state = True, start
                if not known:
                    met = np.flatnonzero(steps[i:j] == 0)
                    upto = i + int(met[0]) if len(met) else j
                    kind[i:upto] = OPEN
                    i = upto
                if i < j:
                    own = {m - i: v for m, v in marks.items() if i <= m < j}
                    place[i:j], stretches, state = go_on(steps[i:j], own, state)
                    known = True
                    for f, t, topic in stretches:
                        topics[i + f:i + t] = topic
            yield _rows(b, kind, topics, place, task).filter(pa.array(b.column("stored").to_numpy(zero_copy_only=False) == 0))
        if begun:
            row = pickle.dumps((first, user, known, state))
            empty = [pa.nulls(1, schema.field(c).type) for c in ("user_id", "ts", "event_id")]
            yield pa.RecordBatch.from_arrays([pa.array([TASK], pa.int32()), *empty, pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int8()),
                                              pa.array([task], pa.int32()), pa.array([row], pa.binary())], names=_NAMES)

    return run


def _drifts(sizes: dict[int, int]):
    """Of tasks that are open as a whole: their effect, pickled."""
    def run(batches):
        import pickle

        import pyarrow as pa
        task, drift = None, None

        def out():
            return pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), pa.array([pickle.dumps(drift)], pa.binary())], names=["task", "state"])

        for b in batches:
            tasks, steps = b.column("task").to_numpy(), b.column("step").to_numpy()
            at = 0
            while at < len(tasks):
                upto = at + int((tasks[at:] == tasks[at]).sum())
                if tasks[at] != task:
                    if drift is not None:
                        yield out()
                    task, drift = int(tasks[at]), Drift(sizes[int(tasks[at])])
                drift.add(steps[at:upto])
                at = upto
        if drift is not None:
            yield out()

    return run


def _second_walk(states: dict[int, tuple]):
    """Walks the open rows of each task from the state it begins in."""
    def run(batches):
        import numpy as np
        task, state = None, None
        for b in batches:
            tasks, steps = b.column("task").to_numpy(), b.column("step").to_numpy()
            place, topics, at = np.zeros(len(tasks), np.int64), np.full(len(tasks), None, object), 0
            while at < len(tasks):
                upto = at + int((tasks[at:] == tasks[at]).sum())
                if tasks[at] != task:
                    task = int(tasks[at])
                    state = states[task]
                place[at:upto], _, state = go_on(steps[at:upto], {}, state)
                topics[at:upto] = state[2]
                at = upto
            if len(tasks):
                yield _rows(b, np.zeros(len(tasks), np.int32), topics, place, 0)

    return run


def _prepared(events: DataFrame, decks: DataFrame, stored: DataFrame | None, all_size: int) -> DataFrame:
    """Rows to walk: steps, and marks with the position and deck they lead to.
    Only marks meet the decks (most rows have no topic, which would be one hot key)."""
    # the sort has stored states before the events of their user
    cols = ["user_id", "ts", "event_id", "step", "topic", "p", "size", "stored"]
    step = F.when(F.col("op") == NEXT, 1).when(F.col("op") == PREV, -1).otherwise(0).cast("tinyint")
    e = events.withColumn("step", step).withColumn("stored", F.lit(0).cast("tinyint"))
    steps = (e.filter("step <> 0").withColumn("topic", F.lit(None).cast("string"))
             .withColumn("p", F.lit(0).cast("long")).withColumn("size", F.lit(0).cast("long")).select(cols))
    places = lambda: (3 * F.coalesce("n", F.lit(0))).cast("long").alias("size")
    topic = F.coalesce(F.nullif("topic", F.lit("")), F.lit(ALL))
    marks = e.filter("step = 0").withColumn("topic", topic).join(decks, "topic", "left").select(
        "user_id", "ts", "event_id", "step", "topic", F.lit(0).cast("long").alias("p"), places(), "stored")
    rows = steps.unionByName(marks)
    if stored is None:
        return rows
    n, idx, phase = F.coalesce("n", F.lit(0)), F.coalesce("idx", F.lit(0)), F.coalesce("phase", F.lit(0))
    held = F.when(n == 0, F.greatest(idx, F.lit(0))).when(idx >= n, 0).when(idx < 0, n - 1).otherwise(idx)
    kinds = dict(events.dtypes)
    return rows.unionByName(stored.withColumn("topic", topic).join(decks, "topic", "left").select(
        "user_id", F.lit(None).cast(kinds["ts"]).alias("ts"), F.lit(None).cast(kinds["event_id"]).alias("event_id"), F.lit(0).cast("tinyint").alias("step"), "topic",
        (3 * held + phase).cast("long").alias("p"), places(), F.lit(1).cast("tinyint").alias("stored")))


def positions(events: DataFrame, cards: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """``user_id, ts, event_id, topic, p`` after every event. ``events``:
    user_id, ts, event_id, op, topic (of a topic change); ``stored``: user_id,
    idx, phase, topic, at most one row per user."""
    import pickle
    spark = events.sparkSession
    decks = deck_sizes(cards)
    all_size = decks.filter(F.col("topic") == ALL).first()["n"]
    start = (0, 3 * all_size, ALL)
    n = shuffle_partitions(spark)
    rows = _prepared(events, decks, stored, all_size)
    order = [F.col("user_id"), F.desc("stored"), F.col("ts"), F.col("event_id")]
    schema = ", ".join(["kind int", *[f"{c} {dict(rows.dtypes)[c]}" for c in ("user_id", "ts", "event_id")], "topic string, p long, step tinyint, task int, state binary"])
    walked = cut(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_first_walk(start), schema))
    ends = {r["task"]: pickle.loads(r["state"]) for r in walked.filter(F.col("kind") == TASK).select("task", "state").collect()}
    open_rows = walked.filter(F.col("kind") == OPEN)
    dealt = lambda df: df.repartition(n, "task").sortWithinPartitions("task", "ts", "event_id")

    # decks of the open tasks: known from the tasks before, whatever the positions
    sizes, before, deck = {}, None, start
    for task in sorted(ends):
        first, last, known, state = ends[task]
        deck = deck if before is not None and ends[before][1] == first else start
        if not known:
            sizes[task] = deck[1]
        else:
            deck = state
        before = task
    drifts = iter(())
    if sizes:
        whole = open_rows.join(F.broadcast(spark.createDataFrame([(t,) for t in sizes], "task int")), "task")
        drifts = cut(dealt(whole).mapInArrow(_drifts(sizes), "task int, state binary")).orderBy("task").toLocalIterator()
    states, before, state = {}, None, start
    for task in sorted(ends):
        first, last, known, end = ends[task]
        state = state if before is not None and ends[before][1] == first else start
        states[task] = state
        state = end if known else (pickle.loads(next(drifts)["state"]).after(state[0]), *state[1:])
        before = task
    cols = ["user_id", "ts", "event_id", "topic", "p"]
    later = dealt(open_rows).mapInArrow(_second_walk(states), schema)
    return walked.filter(F.col("kind") == EVENT).select(cols).unionByName(later.select(cols))


def replay_views(events: DataFrame, cards: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Topic, index and phase shown after every event."""
    return positions(events, cards, stored).select("user_id", "ts", "event_id", "topic", F.floor(F.col("p") / 3).cast("int").alias("idx"),
                                                   (F.col("p") % 3).cast("int").alias("phase"))


def last_state(views: DataFrame) -> DataFrame:
    """Where each user ends, and after how many events."""
    last = views.groupBy("user_id").agg(F.max_by(F.struct("idx", "phase", "topic"), F.struct("ts", "event_id")).alias("s"), F.count(F.lit(1)).alias("n_events"))
    return last.select("user_id", "s.idx", "s.phase", "s.topic", "n_events")
