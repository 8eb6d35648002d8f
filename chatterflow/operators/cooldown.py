"""Cooldown as chains of successors (DF8): which events of a ticker are accepted, without reading them in order in one place.

The event that is accepted after another depends on that one alone: it is the first later one of another run that is manual,
more than ``hours`` later or stronger by ``delta``. So the accepted events are the chain of successors from a ticker's first
event. The events are range-sorted into blocks. Within a block all successors are found at once in numpy (a tree of greatest
strengths), and so is each event's exit, the last of its chain in the block. A ticker that spans several blocks has its
exits' successors looked up in the later blocks: the block's summary names the first one that has it, and exits that meet
there are dealt out in chunks. That leaves a chain over exits, which visits a block once at most; it is followed by pointer
jumping, in as many rounds as the logarithm of a ticker's blocks. At last each block marks its chain from where it is entered.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as lex
from ..sources.storage import written
from .ranges import placed

#: Below all strengths, above the padding of a tree.
LOW = -1.7e308
#: Exits that meet one block together.
CHUNK = 1 << 16
HELP = ("_t", "_s", "_r", "_m")


class Block:
    """A block's events in order: times, strengths, runs, and the searches over them."""

    def __init__(self, rows: pa.Table, wait: int, delta: float, more: pa.Table | None = None):
        """``more``: events of other blocks whose successors are asked for; their runs get the same numbers."""
        self.wait, self.n = wait, rows.num_rows
        every = rows.select(list(HELP)) if more is None else pa.concat_tables([rows.select(list(HELP)), more.select(list(HELP))])
        t = every["_t"]
        strength = np.nan_to_num(pc.fill_null(every["_s"], float("nan")).to_numpy(), nan=LOW)
        no_time = pc.is_null(t).to_numpy()
        run = pc.fill_null(every["_r"].combine_chunks().dictionary_encode().indices.cast(pa.int64()), -1).to_numpy().copy()
        run[run < 0] = -2 - np.flatnonzero(run < 0)  # events without a run are of different runs
        self.run = run
        self.t = pc.fill_null(t, -(1 << 62)).to_numpy()
        # what an event offers, and what the next one needs
        self.offer = np.where(no_time | pc.fill_null(every["_m"], False).to_numpy(zero_copy_only=False), np.inf, strength)
        self.need = np.where(no_time, LOW, np.where(strength == LOW, np.inf, strength + delta))
        n = self.n
        self.size = 1 << max(0, (n - 1).bit_length())
        best, owner, second = (np.full(2 * self.size, v) for v in (-np.inf, -1, -np.inf))
        best[self.size : self.size + n], owner[self.size : self.size + n] = self.offer[:n], run[:n]
        k = self.size
        while k > 1:
            k >>= 1
            at = np.arange(k, 2 * k)
            a, b = 2 * at, 2 * at + 1
            left = best[a] >= best[b]
            best[at], owner[at] = np.where(left, best[a], best[b]), np.where(left, owner[a], owner[b])
            second[at] = np.where(owner[a] == owner[b], np.maximum(second[a], second[b]), np.where(left, np.maximum(second[a], best[b]), np.maximum(second[b], best[a])))
        self.tree = best, owner, second
        change = np.flatnonzero(run[1:n] != run[: n - 1]) + 1
        self.other = np.append(change, n)[np.searchsorted(change, np.arange(n), "right")]

    def _fits(self, node: np.ndarray, need: np.ndarray, run: np.ndarray) -> np.ndarray:
        best, owner, second = self.tree
        return np.where(owner[node] != run, best[node], second[node]) >= need

    def after(self, states: np.ndarray, start: np.ndarray) -> np.ndarray:
        """For each state (a place in the arrays) the first event from ``start`` on that it accepts, or n."""
        n, need, run = self.n, self.need[states], self.run[states]
        # later than the wait, whatever the strength
        late = np.maximum(np.searchsorted(self.t[:n], self.t[states] + self.wait, "right"), start)
        inside = late < n
        place = np.minimum(late, n - 1)
        out = np.where(inside, np.where(self.run[place] != run, place, self.other[place]), n)
        # strong enough: up the tree until a node has one, then down to it
        todo = np.flatnonzero(start < n)
        node = start[todo] + self.size
        found = np.full(len(states), n)
        while len(todo):
            node = node // (node & -node)  # the widest node that begins here
            hit = self._fits(node, need[todo], run[todo])
            self._down(node[hit], todo[hit], need, run, found)
            todo, node = todo[~hit], node[~hit] + 1
            going = (node & (node - 1)) != 0
            todo, node = todo[going], node[going]
        return np.minimum(out, found)

    def _down(self, node: np.ndarray, which: np.ndarray, need: np.ndarray, run: np.ndarray, found: np.ndarray) -> None:
        while len(node) and (inner := node < self.size).any():
            left = 2 * node
            node = np.where(inner, np.where(self._fits(np.where(inner, left, node), need[which], run[which]), left, left + 1), node)
        found[which] = node - self.size

    def successors(self) -> np.ndarray:
        at = np.arange(self.n)
        return self.after(at, at + 1)

    def exits(self) -> np.ndarray:
        """The last event of each event's chain."""
        at, following = np.arange(self.n), self.successors()
        end = np.where(following < self.n, following, at)
        while (end[end] != end).any():
            end = end[end]
        return end

    def chain(self, entry: int) -> np.ndarray:
        """Which events the chain from ``entry`` visits."""
        seen, jump = np.zeros(self.n + 1, bool), np.append(self.successors(), self.n)
        seen[entry] = True
        while (jump < self.n).any():
            seen[jump[seen]] = True
            jump = jump[jump]
        return seen[: self.n]

    def summary(self) -> tuple:
        """The greatest strength and the last time, each with its run's first event and the greatest of other runs."""
        out = []
        for v in (self.offer[: self.n], self.t[: self.n]):
            i = int(v.argmax())
            rest = v[self.run[: self.n] != self.run[i]]
            out += [i, v[i], rest.max() if len(rest) else None]
        return tuple(out)


def cooldown(events: DataFrame, hours: int = lex.GATES["cooldown_hours"], delta: float = lex.GATES["cooldown_delta"]) -> DataFrame:
    """DF8: the accepted events. An event up to ``hours`` after the ticker's last accepted one is accepted only if stronger by ``delta``.

    An event of the last accepted one's run is never accepted, a manual one of another run always. events: ticker, signal_id,
    signal_time, strength, and analysis_run_id and manual where they are known; events without a ticker are left out.
    """
    wait = hours * 3_600_000_000
    given = lambda c, kind: F.col(c).cast(kind) if c in events.columns else F.lit(None).cast(kind)
    help_ = (F.unix_micros("signal_time"), F.col("strength").cast("double"), given("analysis_run_id", "string"), given("manual", "boolean"))
    rows = placed(events.filter("ticker is not null").withColumns(dict(zip(HELP, help_, strict=True))), ["ticker"], [F.asc_nulls_first("_t"), "signal_id"])
    blocks = written(rows.groupBy("ticker", "_part").agg(F.min("_row").alias("_first")))
    # a ticker's first event enters its first block
    of = Window.partitionBy("ticker").orderBy("_part")
    blocks = blocks.withColumns({"_b": F.row_number().over(of), "_blocks": F.count(F.lit(1)).over(Window.partitionBy("ticker"))})
    entry = F.when(F.col("_b") == 1, F.col("_first"))
    most = blocks.agg(F.max("_blocks")).first()[0] or 1
    if most > 1:
        entered = _entered(rows, blocks.filter("_blocks > 1").select("ticker", "_part", "_b"), wait, delta, most)
        blocks, entry = blocks.join(entered, ["ticker", "_part"], "left"), F.coalesce("_enters", entry)
    entries = written(blocks.select("ticker", "_part", entry.alias("_entry")).filter("_entry is not null"))
    columns = events.columns

    def mark(group: pa.Table) -> pa.Table:
        group = group.sort_by("_row")
        at = int(np.searchsorted(group["_row"].to_numpy(), group["_entry"][0].as_py()))
        return group.filter(pa.array(Block(group, wait, delta).chain(at))).select(columns)

    return rows.join(entries, ["ticker", "_part"]).groupBy("ticker", "_part").applyInArrow(mark, events.schema)


#: Of a block: its exits, with how they go on, and once (without a row) its summary.
EXIT = "ticker string, _part long, _row long, _t long, _s double, _r string, _m boolean, first boolean, top double, top_run string, top_other double, late long, late_run string, late_other long"


def _entered(rows: DataFrame, long: DataFrame, wait: int, delta: float, most: int) -> DataFrame:
    """ticker, _part and _enters, the event by which the chain of a ticker of several blocks enters all but its first.

    ``long``: the blocks of such tickers; a boundary between ranges cuts one ticker at most, so there are no more than two for each
    range, whatever the data.
    """
    own = written(rows.select("ticker", "_part", "_row", *HELP).join(F.broadcast(long), ["ticker", "_part"]))
    block = ["ticker", "_part"]

    def exits(group: pa.Table) -> pa.Table:
        group = group.sort_by("_row")
        b = Block(group, wait, delta)
        end = b.exits()
        out = group.take(pa.array(np.unique(end))).select([*block, "_row", *HELP])
        head = group["_row"][int(end[0])].as_py() if group["_b"][0].as_py() == 1 else -1
        out = out.append_column("first", pc.equal(out["_row"], pa.scalar(head, pa.int64())))
        i, top, top_other, j, late, late_other = b.summary()
        facts = {"top": top, "top_run": _run(group, i), "top_other": top_other, "late": int(late), "late_run": _run(group, j), "late_other": None if late_other is None else int(late_other)}
        whole = {**dict.fromkeys(("_row", *HELP, "first")), **facts, **{c: group[c][0].as_py() for c in block}}
        return pa.concat_tables([pa.Table.from_pylist([whole], _SCHEMA), _wide(out)])

    found = written(own.groupBy(*block).applyInArrow(exits, EXIT))
    facts = found.filter("_row is null").select(*block, "top", "top_run", "top_other", "late", "late_run", "late_other").orderBy(*block).collect()  # two for each range at most
    ends = found.filter("_row is not null").select(*block, "_row", *HELP, "first")
    targets = written(ends.mapInArrow(_targets(facts, wait, delta), "ticker string, _part long, _row long, _t long, _s double, _r string, _m boolean, first boolean, _to long"))

    # exits that meet one block, in chunks; the block's events go to each
    going = targets.filter("_to is not null")
    chunks = written(going.groupBy("ticker", "_to").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("_chunks")))
    dealt = going.join(F.broadcast(chunks), ["ticker", "_to"]).withColumn("_chunk", F.pmod(F.xxhash64("_row"), "_chunks")).drop("_chunks")
    met = own.join(F.broadcast(chunks.withColumnRenamed("_to", "_part")), block).withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_chunks") - 1))).drop("_chunks")

    def hop(events: pa.Table, states: pa.Table) -> pa.Table:
        events = events.sort_by("_row")
        b = Block(events, wait, delta, states)
        at = b.after(np.arange(b.n, b.n + states.num_rows), np.zeros(states.num_rows, np.int64))
        name = events["_row"].to_numpy()
        return pa.table({"ticker": states["ticker"], "_row": states["_row"], "_to": states["_to"], "_enters": name[at], "_next": name[b.exits()[at]]})

    some = lambda f: lambda a, b: f(a, b) if a.num_rows and b.num_rows else _NO_HOPS
    hops = met.groupBy("ticker", "_part", "_chunk").cogroup(dealt.groupBy("ticker", F.col("_to").alias("_part"), "_chunk"))
    hops = written(hops.applyInArrow(some(hop), "ticker string, _row long, _to long, _enters long, _next long"))

    # the chain over exits; it has an exit of a block at most
    reached, jump = written(targets.filter("first").select("ticker", "_row")), hops.select("ticker", "_row", "_next")
    steps = 1
    while steps < most:
        nexts = jump.join(F.broadcast(reached), ["ticker", "_row"]).select("ticker", F.col("_next").alias("_row"))
        reached = written(reached.union(nexts))
        steps *= 2
        if steps < most:
            then = jump.select("ticker", F.col("_row").alias("_next"), F.col("_next").alias("_then"))
            jump = written(jump.join(then, ["ticker", "_next"]).select("ticker", "_row", F.col("_then").alias("_next")))
    return hops.join(F.broadcast(reached), ["ticker", "_row"]).select("ticker", F.col("_to").alias("_part"), "_enters")


_NO_HOPS = pa.table({"ticker": pa.array([], pa.string()), **{c: pa.array([], pa.int64()) for c in ("_row", "_to", "_enters", "_next")}})
_KINDS = {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
_SCHEMA = pa.schema([(c, _KINDS[kind]) for c, kind in (x.split() for x in EXIT.split(", "))])


def _wide(exits: pa.Table) -> pa.Table:
    for f in _SCHEMA:
        if f.name not in exits.column_names:
            exits = exits.append_column(f, pa.nulls(exits.num_rows, f.type))
    return exits.select(_SCHEMA.names).cast(_SCHEMA)


def _run(group: pa.Table, i: int) -> str | None:
    return group["_r"][i].as_py()


def _targets(facts: list, wait: int, delta: float):
    """By ticker its blocks' summaries; each exit gets the first later block that has a successor of it."""
    by: dict[str, list] = {}
    for r in facts:
        by.setdefault(r["ticker"], []).append(r)

    def run(batches):
        for b in batches:
            names = b.column("ticker").to_numpy(zero_copy_only=False)
            part, runs = b.column("_part").to_numpy(), b.column("_r").to_numpy(zero_copy_only=False)
            t, s = b.column("_t"), b.column("_s")
            no_time = pc.is_null(t).to_numpy(zero_copy_only=False)
            t = pc.fill_null(t, -(1 << 62)).to_numpy()
            s = np.nan_to_num(pc.fill_null(s, float("nan")).to_numpy(), nan=LOW)
            need = np.where(no_time, LOW, np.where(s == LOW, np.inf, s + delta))
            to = np.full(b.num_rows, -1)
            for ticker in set(names):
                open_ = names == ticker
                for r in by[ticker]:
                    if not open_.any():
                        break
                    strong = _beyond(runs, r["top_run"], r["top"], r["top_other"]) >= need
                    late = _beyond(runs, r["late_run"], r["late"], r["late_other"]) > t + wait
                    hit = open_ & (part < r["_part"]) & (strong | late)
                    to[hit] = r["_part"]
                    open_ &= ~hit
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.where(to < 0, 0, to), pa.int64(), mask=to < 0)], [*b.schema.names, "_to"])

    return run


def _beyond(runs: np.ndarray, run: str | None, best: float, other: float | None) -> np.ndarray:
    """The greatest value of another run than each of ``runs``: the best one's, unless it is of the same run; no run differs from all."""
    return np.where((runs == run) & (run is not None), -np.inf if other is None else other, best)
