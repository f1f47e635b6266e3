"""Chat formatting with minimum-cost role repair.

A rendered conversation is accepted by the legal-turn automaton: an optional system turn, then user and assistant turns in alternation,
ending on an assistant turn. Dynamic programming over (messages read, role of the last turn written) finds the cheapest way to get there:
each message begins a turn or is merged into the last one, under its own role or relabelled, and empty turns may be inserted anywhere. The plan depends
on the sequence of roles alone, so a worker plans each distinct sequence once.

Messages are grouped by conversation in one shuffle; planning and rendering run in an Arrow map over whole conversations.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROLES = ("system", "user", "assistant")
START = "start"
#: Which turn may follow which.
LEGAL: Mapping[str, tuple[str, ...]] = {START: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
FINAL = ("assistant",)
ALIASES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant"}
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Plans a worker keeps before it starts anew; this bounds memory and changes no result.
CACHE = 50_000


@dataclass(frozen=True)
class Costs:
    """unknown is the price of giving a role to a message that has none of the known ones."""

    merge: float = 1.0
    relabel: float = 1.5
    insert: float = 2.0
    unknown: float = 0.5


COSTS = Costs()


def normal_role(role: str | None) -> str:
    """The known role that a label stands for, or the empty string."""
    r = (role or "").strip().lower()
    r = ALIASES.get(r, r)
    return r if r in ROLES else ""


def insertions(costs: Costs) -> dict[tuple[str, str], tuple[float, tuple[str, ...]]]:
    """(state, role) -> the price and the empty turns by which the automaton gets from the state to one that a turn of role may follow."""
    out = {}
    for state in LEGAL:
        paths: dict[str, tuple[str, ...]] = {state: ()}
        queue = [state]
        while queue:  # breadth first: fewest insertions, ties by the order of LEGAL
            at = queue.pop(0)
            for nxt in LEGAL[at]:
                if nxt not in paths:
                    paths[nxt] = (*paths[at], nxt)
                    queue.append(nxt)
        for role in ROLES:
            ways = [(len(p), p) for s, p in paths.items() if role in LEGAL[s]]
            if ways:
                n, p = min(ways, key=lambda w: w[0])
                out[state, role] = (n * costs.insert, p)
    return out


@dataclass(frozen=True)
class Plan:
    """turns: (role, positions of the messages in it); an inserted turn has none."""

    cost: float
    turns: tuple[tuple[str, tuple[int, ...]], ...]
    merged: int
    relabelled: int
    inserted: int


def plan(roles: tuple[str, ...], costs: Costs = COSTS) -> Plan:
    """The cheapest repair of a sequence of normal roles. Of equal costs the fewest insertions, then relabels, then merges win, then the first found
    in the order system, user, assistant, merging before beginning a turn. No messages give no turns, at no cost."""
    if not roles:
        return Plan(0.0, (), 0, 0, 0)
    gaps = insertions(costs)
    # state -> (price, insertions, relabels, merges), back pointers by step
    best: dict[str, tuple] = {START: (0.0, 0, 0, 0)}
    back: list[dict[str, tuple[str, str, tuple[str, ...]]]] = []
    for r in roles:
        nxt: dict[str, tuple] = {}
        how: dict[str, tuple[str, str, tuple[str, ...]]] = {}
        for state, (c, i, l, m) in best.items():
            for t in ROLES:
                extra = 0.0 if t == r else costs.relabel if r else costs.unknown
                changed = int(t != r and bool(r))
                options = []
                if state == t:
                    options.append(((c + extra + costs.merge, i, l + changed, m + 1), "merge", ()))
                if (state, t) in gaps:
                    price, path = gaps[state, t]
                    options.append(((c + extra + price, i + len(path), l + changed, m), "turn", path))
                for key, kind, path in options:
                    if t not in nxt or key < nxt[t]:
                        nxt[t], how[t] = key, (state, kind, path)
        best = nxt
        back.append(how)
    ends = []
    for state, key in best.items():
        tails = [((key[0] + len(p) * costs.insert, key[1] + len(p), *key[2:]), state, p) for f, p in _tails(state).items() if f in FINAL]
        ends += tails
    total, state, tail = min(ends, key=lambda e: e[0])
    turns: list[tuple[str, list[int]]] = [(t, []) for t in reversed(tail)]
    open_turn: list[int] = []
    for at in range(len(roles) - 1, -1, -1):
        before, kind, path = back[at][state]
        open_turn.append(at)
        if kind == "turn":
            turns.append((state, open_turn[::-1]))
            open_turn = []
            turns += [(t, []) for t in reversed(path)]
        state = before
    return Plan(total[0], tuple((t, tuple(m)) for t, m in reversed(turns)), total[3], total[2], total[1])


def _tails(state: str) -> dict[str, tuple[str, ...]]:
    """Where empty turns lead from a state, and by which."""
    paths: dict[str, tuple[str, ...]] = {state: ()}
    queue = [state]
    while queue:
        at = queue.pop(0)
        for nxt in LEGAL[at]:
            if nxt not in paths:
                paths[nxt] = (*paths[at], nxt)
                queue.append(nxt)
    return paths


def clean(text: str | None) -> str:
    """A message's text, in which the markers of turns stand for nothing: a space parts their brackets."""
    t = text or ""
    return t.replace(OPEN, "<| im_start |>").replace(CLOSE, "<| im_end |>") if "<|im_" in t else t


def render(p: Plan, texts: list[str | None]) -> str:
    """The turns between markers; merged messages are parted by a blank line."""
    return "".join(f"{OPEN}{role}\n" + "\n\n".join(clean(texts[i]) for i in members) + f"{CLOSE}\n" for role, members in p.turns)


def _format(costs: Costs):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans: dict[tuple[str, ...], Plan] = {}
        names: dict[str | None, str] = {}
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [], [])
            size, first = 0, 0
            ids = batch.column(0)
            for at, messages in enumerate(batch.column(1).to_pylist()):
                roles = []
                for m in messages:
                    if m["role"] not in names:
                        if len(names) >= CACHE:
                            names.clear()
                        names[m["role"]] = normal_role(m["role"])
                    roles.append(names[m["role"]])
                key = tuple(roles)
                if (p := plans.get(key)) is None:
                    if len(plans) >= CACHE:
                        plans.clear()
                    p = plan(key, costs)
                    if len(key) <= 64:
                        plans[key] = p
                text = render(p, [m["text"] for m in messages])
                for o, v in zip(out, (len(messages), len(p.turns), p.cost, p.merged, p.relabelled, p.inserted, text)):
                    o.append(v)
                size += len(text)
                if size > 4_000_000:
                    yield _rows(ids.slice(first, at + 1 - first), out)
                    out, size, first = ([], [], [], [], [], [], []), 0, at + 1
            if out[0]:
                yield _rows(ids.slice(first), out)

    return run


_COLUMNS = (("n_messages", pa.int64()), ("n_turns", pa.int64()), ("cost", pa.float64()), ("n_merged", pa.int64()), ("n_relabelled", pa.int64()), ("n_inserted", pa.int64()), ("chat", pa.string()))


def _rows(ids: pa.Array, out: tuple[list, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids, *(pa.array(o, t) for o, (_, t) in zip(out, _COLUMNS))], names=["conv_id", *(n for n, _ in _COLUMNS)])


def format_chats(messages: DataFrame, costs: Costs = COSTS, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, n_messages, n_turns, cost, n_merged, n_relabelled, n_inserted, chat), one row a conversation.

    Messages are in the order of turn, a null turn first; of equal turns the order is by role, then text, nulls first, and repeated rows are all kept. A null text is an empty one,
    a null or unknown role is given one. A row of null conv_id, whose conversation is not known, is one of its own, so such rows are never gathered. A conversation is a row of the result, so one is as long as a
    row can be. Ids are whole numbers, or strings of them (others raise). Other columns are ignored, whatever their names. No rows give no rows."""
    message = F.struct(F.col(f"`{turn_col}`").cast("long").alias("turn"), F.col(f"`{role_col}`").cast("string").alias("role"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = messages.select(F.col(f"`{conv_col}`").cast("long").alias("conv_id"), message.alias("m"))
    grouped = rows.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("ms"))
    grouped = grouped.unionByName(rows.where("conv_id is null").select("conv_id", F.array("m").alias("ms")))
    grouped = grouped.select("conv_id", F.transform("ms", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("text"))).alias("ms"))
    return grouped.mapInArrow(_format(costs), "conv_id long, n_messages long, n_turns long, cost double, n_merged long, n_relabelled long, n_inserted long, chat string")
