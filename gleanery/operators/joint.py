"""A crawl schedule that keeps both spacings at once: between requests to one host, and between all requests.

In the order of arrival, a request starts at the latest of its arrival, its host's previous start and its own delay, and
the start of the request ``per_second`` places before it and one step.  Each of the two spacings alone has a closed form
over the whole table; both together are the least fixpoint of the two.  A round applies both closed forms and then solves
every span of the order exactly, given what comes in from the spans before.  All three only ever raise starts, and never
above the answer; once a round leaves what spans hand on unchanged, the answer is reached.  A span is right as soon as
all before it are, so there are no more rounds than spans and one.

Before the rounds, every span says how its last starts follow from those before it: each is the latest of a time of its
own and of some starts before, each with what lies between.  Those summaries, taken one after the other, give what comes
in to all spans.  They know all of it where a span has no more than FOLLOWED hosts, so one round confirms it even if every
span is full to the last place; of more hosts the most frequent are followed, and the rounds find the rest.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery import constants as C
from gleanery.operators.joins import broadcast_if_small
from gleanery.operators.scan import before, running_count, running_max, with_row_number
from gleanery.operators.schedule import SECOND
from gleanery.session import checkpointed, shuffle_width

# A span is walked row by row in one task; the fewer spans, the fewer rounds.
SPAN_ROWS = 4096
# Hosts of a span that its summary follows, and places it may wait for: they bound the summary's size.
FOLLOWED = 120
MOST_PLACES = 128
# Stands for a start that another does not depend on.
_NEVER = -(1 << 61)
_HANDED = "_span long, _owner string, _i long, _at long"


class Joint(NamedTuple):
    """The rows with their starts, and how many rounds it took."""

    rows: DataFrame
    rounds: int


def _solver(delay: str, per_second: int, step_us: int):
    """Starts of one span, request by request, from the starts that the spans before hand on."""
    def solve(rows: pa.Table, handed: pa.Table) -> pa.Table:
        rows = rows.sort_by("_i")
        owners = rows.column("_owner").combine_chunks().dictionary_encode()
        codes, names = owners.indices.to_pylist(), owners.dictionary.to_pylist()
        last = [None] * len(names)
        code_of = {name: code for code, name in enumerate(names)}
        earlier = {}
        for owner, place, at in zip(*(handed.column(c).to_pylist() for c in ("_owner", "_i", "_at"))):
            if place is not None:
                earlier[place] = at
            elif owner in code_of:
                last[code_of[owner]] = at
        places, delays = rows.column("_i").to_pylist(), rows.column(delay).to_pylist()
        starts = rows.column("_at").to_pylist()
        for n, (place, code, at) in enumerate(zip(places, codes, starts)):
            ahead = starts[n - per_second] if n >= per_second else earlier.get(place)
            if ahead is not None and ahead + step_us > at:
                at = ahead + step_us
            if last[code] is not None and last[code] + delays[n] > at:
                at = last[code] + delays[n]
            starts[n] = last[code] = at
        return rows.set_column(rows.schema.get_field_index("_at"), "_at", pa.array(starts, pa.int64()))

    return solve


def _handed_on(rows: DataFrame, per_second: int, span_rows: int) -> DataFrame:
    """``_span, _owner, _i, _at``: for every host of a span its last start before, for the first places what they wait for."""
    tails = rows.groupBy("_owner", "_span").agg(F.max("_at").alias("_last"))
    of_owner = tails.withColumn("_at", F.max("_last").over(before(["_span"], ["_owner"]))).where("_at IS NOT NULL")
    of_owner = of_owner.select("_span", "_owner", F.lit(None).cast("long").alias("_i"), "_at")
    # A span may be shorter than the distance of two requests that wait for each other.
    waits = (F.col("_i") + per_second).alias("_i")
    target = F.floor((F.col("_i") + per_second) / span_rows)
    of_place = rows.where(target > F.col("_span")).select(
        target.alias("_span"), F.lit(None).cast("string").alias("_owner"), waits, "_at")
    return of_owner.unionByName(of_place)


def _summary(per_second: int, step_us: int):
    """One row for a span: what its last starts are, and what those before it add to them."""
    def summarise(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("_i")
        owners = rows.column("_owner").combine_chunks().dictionary_encode()
        codes, names = owners.indices.to_pylist(), owners.dictionary.to_pylist()
        first, waits = rows.column("_i")[0].as_py(), min(per_second, len(codes))
        followed = np.argsort(-np.bincount(codes), kind="stable")[:FOLLOWED].tolist()
        # Columns: the span's own times, the places before it, the followed hosts' starts before it.
        column_of = {code: 1 + waits + k for k, code in enumerate(followed)}
        latest, own, recent = {}, {}, [None] * per_second
        for n, (code, at, pause) in enumerate(zip(codes, rows.column("_at").to_pylist(), rows.column("_delay").to_pylist())):
            if n >= per_second:
                made = recent[n % per_second] + step_us
            else:
                made = np.full(1 + waits + len(followed), _NEVER, np.int64)
                if first + n >= per_second:
                    made[1 + n] = step_us
            made[0] = max(made[0], at)
            if code not in column_of:
                made[0] = max(made[0], own.get(code, _NEVER) + pause)
                own[code] = int(made[0])
            elif code in latest:
                np.maximum(made, latest[code] + pause, out=made)
            else:
                made[column_of[code]] = max(made[column_of[code]], pause)
            recent[n % per_second] = made
            if code in column_of:
                latest[code] = made
        made = [recent[n % per_second] for n in range(len(codes) - waits, len(codes))] + [latest[code] for code in followed]
        return pa.table({
            "_span": rows.column("_span")[:1], "_first": pa.array([first], pa.int64()), "_rows": pa.array([len(codes)], pa.int64()),
            "_names": pa.array([[names[code] for code in followed]], pa.list_(pa.string())),
            "_numbers": pa.array([np.stack(made).tobytes()], pa.binary())})

    return summarise


def _walk(per_second: int):
    """What comes in to every span, from the summaries of all spans."""
    def walk(spans: pa.Table) -> pa.Table:
        handed, places, hosts = [], {}, {}
        for span in spans.sort_by("_span").to_pylist():
            first, n, names = span["_first"], span["_rows"], span["_names"]
            waits = min(per_second, n)
            for place in range(first, first + waits):
                if place - per_second in places:
                    handed.append((span["_span"], None, place, places[place - per_second]))
            handed.extend((span["_span"], name, None, hosts[name]) for name in names if name in hosts)
            before = [0, *(places.get(first + k - per_second, _NEVER) for k in range(waits)), *(hosts.get(x, _NEVER) for x in names)]
            numbers = np.frombuffer(span["_numbers"], np.int64).reshape(-1, len(before))
            after = (numbers + np.array(before, np.int64)).max(1).tolist()
            places.update(zip(range(first + n - waits, first + n), after))
            places = {place: at for place, at in places.items() if place >= first + n - per_second}
            hosts.update(zip(names, after[waits:]))
        kinds = pa.int64(), pa.string(), pa.int64(), pa.int64()
        columns = list(zip(*handed)) or [[], [], [], []]
        return pa.table({name: pa.array(c, kind) for name, c, kind in zip(("_span", "_owner", "_i", "_at"), columns, kinds)})

    return walk


def joint_schedule(
    df: DataFrame, key: str, arrival: str, tie: str, delay: str, per_second: int = C.OUTBOUND_REQUESTS_PER_SECOND,
    step_us: int = int(C.GLOBAL_STEP_SECONDS * SECOND), start: str = "start_us", chunks: int | None = None,
    span_rows: int | None = None,
) -> Joint:
    """Add ``start``, the least times with ``start >= arrival``, per key ``start >= previous start + delay`` and
    ``start >=`` the start ``per_second`` places before ``+ step_us``, in the order of ``arrival, tie``.

    Equals the serial walk in that order.  A null key is a key; rows without an arrival or a delay have no start and
    delay nobody.  Pass a narrow table: its columns go along in every round.  ``span_rows`` is the length of a span, by
    default as many spans as ``spark.sql.shuffle.partitions``, none shorter than SPAN_ROWS.
    """
    whole = F.col(arrival).isNotNull() & F.col(delay).isNotNull()
    rows = df.where(whole).withColumn("_owner", F.to_json(F.struct(F.col(key).alias("k"))))
    rows = with_row_number(rows, [arrival, tie], "_i", chunks)
    rows = running_count(rows, ["_owner"], ["_i"], F.col(delay), "_waits")
    n = rows.count()
    span_rows = span_rows or max(SPAN_ROWS, -(-n // shuffle_width(df.sparkSession)))
    rows = rows.withColumns({
        "_chain": F.col("_i") % per_second, "_steps": F.floor(F.col("_i") / per_second).cast("long") * step_us,
        "_at": F.col(arrival).cast("long"), "_span": F.floor(F.col("_i") / span_rows)})
    solve = _solver(delay, per_second, step_us)
    if n > span_rows and per_second <= MOST_PLACES:
        summaries = rows.select("_span", "_i", "_owner", "_at", F.col(delay).cast("long").alias("_delay")).groupBy("_span").applyInArrow(
            _summary(per_second, step_us), "_span long, _first long, _rows long, _names array<string>, _numbers binary")
        # One row a span, of bounded size.
        handed = checkpointed(summaries.withColumn("_all", F.lit(0)).groupBy("_all").applyInArrow(_walk(per_second), _HANDED))
        rows = checkpointed(rows.groupBy("_span").cogroup(handed.groupBy("_span")).applyInArrow(solve, rows.schema))
    most = -(-n // span_rows) + 1
    rounds = 0
    while rounds < most:
        rounds += 1
        polite = running_max(rows, ["_owner"], ["_i"], F.col("_at") - F.col("_waits"), "_lead")
        polite = polite.withColumn("_at", F.col("_waits") + F.col("_lead")).drop("_lead")
        spaced = running_max(polite, ["_chain"], ["_i"], F.col("_at") - F.col("_steps"), "_lead")
        spaced = checkpointed(spaced.withColumn("_at", F.col("_steps") + F.col("_lead")).drop("_lead"))
        handed = checkpointed(_handed_on(spaced, per_second, span_rows))
        solved = spaced.groupBy("_span").cogroup(handed.groupBy("_span")).applyInArrow(solve, spaced.schema)
        rows = checkpointed(solved)
        now = _handed_on(rows, per_second, span_rows)
        same = (handed["_span"] == now["_span"]) & handed["_owner"].eqNullSafe(now["_owner"]) & handed["_i"].eqNullSafe(now["_i"]) & (
            handed["_at"] == now["_at"])
        if not now.join(broadcast_if_small(handed), same, "left_anti").limit(1).count():
            break
    done = rows.select(*df.columns, F.col("_at").alias(start))
    return Joint(done.unionByName(df.where(~whole).withColumn(start, F.lit(None).cast("long"))), rounds)
