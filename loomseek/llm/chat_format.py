"""Chat formatting with minimum-cost role repair.

A conversation is legal if it is empty, or an optional system turn followed by user and assistant turns in alternation, the
last one an assistant's. Dynamic programming over the automaton of these rules finds the cheapest repair: a turn keeps its
role, gets another, or is merged into the turn before it, and empty turns may be inserted before it or at the end. The repaired
turns are then rendered. Only roles go to Python, and equal sequences of roles are repaired once for each worker; texts stay in the JVM.

Definitions. Turns are in the order of their number (null last), then role, then text; rows alike in all three count once. Roles are
compared in lower case without outer spaces, some synonyms are known, and any other role (null too) is unknown and cheap to replace.
A null text is empty. Rows with a null conv_id are one conversation. Of the ways of equal cost to one role after a turn, an emitted
turn goes before a merged one, and then the role before it decides, in the order of ROLES; of ends of equal cost the role first in
the alphabet. A conversation is gathered in one row, so its turns must fit in a worker. Marks of the format within a text are broken by a space, so no text can pose as a turn.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MERGE, INSERT, RELABEL, UNKNOWN = 1, 2, 3, 1
START, END = "<|im_start|>", "<|im_end|>"
SYNONYMS = {"human": "user", "customer": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant", "developer": "system"}
ROLES = ("system", "user", "assistant")
#: What may follow what; "" is the beginning.
NEXT = {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
FINAL = ("", "assistant")

Turns = tuple[tuple[str, int, int], ...]  #: (role, first input turn, number of input turns)


def _detours() -> dict[tuple[str, str], tuple[str, ...]]:
    """The fewest empty turns to insert between one state and another, so that the second can follow."""
    out: dict[tuple[str, str], tuple[str, ...]] = {}
    for state in NEXT:
        reach, level = {state: ()}, [state]
        while level:
            for s in level:
                for role in NEXT[s]:
                    out.setdefault((state, role), reach[s])
            level = [r for s in level for r in NEXT[s] if r not in reach and not reach.update({r: (*reach[s], r)})]
    return out


DETOURS = _detours()


def relabel_cost(role: str | None, to: str) -> int:
    return 0 if role == to else UNKNOWN if role not in ROLES else RELABEL


@lru_cache(maxsize=1 << 16)
def repair(roles: tuple[str | None, ...]) -> tuple[int, Turns]:
    """Cost and turns of the cheapest repair of a sequence of roles."""
    best: dict[str, int] = {"": 0}
    steps: list[dict[str, tuple[str, tuple[str, ...], bool]]] = []  # by state: state before, inserted turns, merged
    for role in roles:
        new: dict[str, int] = {}
        step: dict[str, tuple[str, tuple[str, ...], bool]] = {}

        def offer(state: str, cost: int, how: tuple[str, tuple[str, ...], bool]) -> None:
            if state not in new or cost < new[state]:  # noqa: B023
                new[state], step[state] = cost, how  # noqa: B023

        for state in ("", *ROLES):
            for to in ROLES if state in best else ():
                if (state, to) in DETOURS:
                    path = DETOURS[state, to]
                    offer(to, best[state] + relabel_cost(role, to) + INSERT * len(path), (state, path, False))
        for state, cost in best.items():
            if state:
                offer(state, cost + relabel_cost(role, state) + MERGE, (state, (), True))
        best = new
        steps.append(step)
    ends = {s: () if s in FINAL else (*DETOURS[s, "assistant"], "assistant") for s in best}
    last = min(best, key=lambda s: (best[s] + INSERT * len(ends[s]), s))
    turns: list[tuple[str, int, int]] = [(r, len(roles), 0) for r in reversed(ends[last])]
    state, open_ = last, 0
    for i in range(len(roles) - 1, -1, -1):
        before, path, merged = steps[i][state]
        open_ += 1
        if not merged:
            turns.append((state, i, open_))
            turns += [(r, i, 0) for r in reversed(path)]
            open_ = 0
        state = before
    return best[last] + INSERT * len(ends[last]), tuple(reversed(turns))


def normal_role(role: str | None) -> str | None:
    role = (role or "").strip().lower()
    role = SYNONYMS.get(role, role)
    return role if role in ROLES else None


_PLAN = "struct<cost:int,turns:array<struct<role:string,first:int,n:int>>>"


def _planner():
    @F.arrow_udf(_PLAN)
    def plans(roles: pa.Array) -> pa.Array:
        out = []
        for sequence in roles.to_pylist():
            cost, turns = repair(tuple(normal_role(r) for r in sequence))
            out.append({"cost": cost, "turns": [{"role": r, "first": i, "n": n} for r, i, n in turns]})
        kind = pa.struct([("cost", pa.int32()), ("turns", pa.list_(pa.struct([("role", pa.string()), ("first", pa.int32()), ("n", pa.int32())])))])
        return pa.array(out, kind)

    return plans


def safe(text: Column) -> Column:
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit(START), F.lit("<| im_start |>")), F.lit(END), F.lit("<| im_end |>"))


def render(turns: Column, texts: Column) -> Column:
    """The repaired turns as one text; merged texts are joined by a line feed."""
    body = lambda t: F.array_join(F.slice(texts, t["first"] + 1, t["n"]), "\n")
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(START), t["role"], F.lit("\n"), body(t), F.lit(END + "\n"))), "")


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row for each conversation: conv_id, turns_in, turns_out, repair_cost, text."""
    one = F.struct(F.col("turn").isNull().alias("last"), F.col("turn").alias("turn"), F.col("role").alias("role"), safe(F.col("text")).alias("text"))
    grouped = turns.groupBy("conv_id").agg(F.array_distinct(F.sort_array(F.collect_list(one))).alias("turns"))
    planned = grouped.withColumn("plan", _planner()(F.col("turns.role")))
    return planned.select("conv_id", F.size("turns").alias("turns_in"), F.size("plan.turns").alias("turns_out"), F.col("plan.cost").alias("repair_cost"),
                          render(F.col("plan.turns"), F.col("turns.text")).alias("text"))


def _sql() -> str:
    """The same dynamic programming as a recursive query: each step takes all conversations one turn further and keeps the cheapest way to each role."""
    mark = lambda role, body: f"'{START}' || {role} || chr(10) || {body} || '{END}' || chr(10)"
    empty = lambda path: "''" + "".join(" || " + mark(f"'{r}'", "''") for r in path)
    states = ("", *ROLES)
    moves = [f"('{s}', '{to}', {INSERT * len(path)}, 0, {states.index(s)}, {len(path) + 1}, {empty(path)})" for s in states for to in ROLES for path in [DETOURS.get((s, to))] if path is not None]
    moves += [f"('{s}', '{s}', {MERGE}, 1, {states.index(s)}, 0, '')" for s in ROLES]
    ends = {s: () if s in FINAL else (*DETOURS[s, "assistant"], "assistant") for s in states}
    last = ", ".join(f"('{s}', {INSERT * len(p)}, {len(p)}, {empty(p)})" for s, p in ends.items())
    synonyms = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in SYNONYMS.items())
    roles = ", ".join(f"'{r}'" for r in ROLES)
    safe_ = f"replace(replace(coalesce(text, ''), '{START}', '<| im_start |>'), '{END}', '<| im_end |>')"
    return f"""
WITH RECURSIVE one AS (SELECT DISTINCT conv_id, turn, role, {safe_} AS text FROM conversations),
convs AS (SELECT conv_id, row_number() OVER () AS u FROM (SELECT DISTINCT conv_id FROM one)),
named AS (SELECT u, turn, role AS given, text, CASE lower(trim(role)) {synonyms} ELSE lower(trim(role)) END AS role FROM one JOIN convs ON one.conv_id IS NOT DISTINCT FROM convs.conv_id),
turns AS (SELECT u, row_number() OVER (PARTITION BY u ORDER BY turn NULLS LAST, given NULLS FIRST, text) AS i, CASE WHEN role IN ({roles}) THEN role END AS role, text FROM named),
moves(state, to_, price, kind, ord, more, path) AS (VALUES {", ".join(moves)}),
ends(state, price, more, path) AS (VALUES {last}),
dp AS (SELECT u, 0::BIGINT AS i, '' AS state, 0 AS cost, 0 AS n, '' AS done, '' AS body FROM convs
  UNION ALL SELECT u, i, to_, cost, n, done, body FROM (
    SELECT dp.u, t.i, to_, dp.cost + price + CASE WHEN t.role = to_ THEN 0 WHEN t.role IS NULL THEN {UNKNOWN} ELSE {RELABEL} END AS cost, dp.n + more AS n,
      CASE WHEN kind = 1 THEN done WHEN dp.state = '' THEN path ELSE done || {mark("dp.state", "body")} || path END AS done,
      CASE WHEN kind = 1 THEN body || chr(10) || t.text ELSE t.text END AS body,
      row_number() OVER (PARTITION BY dp.u, to_ ORDER BY dp.cost + price + CASE WHEN t.role = to_ THEN 0 WHEN t.role IS NULL THEN {UNKNOWN} ELSE {RELABEL} END, kind, ord) AS r
    FROM dp JOIN turns t ON t.u = dp.u AND t.i = dp.i + 1 JOIN moves ON moves.state = dp.state) WHERE r = 1)
SELECT conv_id, i::INT AS turns_in, (n + more)::INT AS turns_out, (cost + price)::INT AS repair_cost, done || {mark("state", "body")} || path AS text
FROM dp JOIN ends USING (state) JOIN convs USING (u) WHERE i = (SELECT count(*) FROM turns WHERE turns.u = dp.u)
QUALIFY row_number() OVER (PARTITION BY u ORDER BY cost + price, state) = 1"""


CHAT_SQL = _sql()
