"""Repair of conversation structure by a run-length dynamic programme.

A conversation's rows become symbols of role and fault. The cheapest edits (keep, give another
role, delete, insert an empty turn) that leave an optional system turn and then pairs of user and
assistant turns are shortest paths through four states, and a symbol is a 4 x 4 min-plus matrix
over them. Equal consecutive symbols are one run, which is crossed by the binary powers of its
matrix; powers are computed once per symbol. Then the choices of each row are unrolled forwards
against the costs that remain, least letter first, so equally cheap repairs have one audit.

Matrices compose, so a conversation need not be in one task. Its rows are numbered by a distributed
sort and cut into segments of ``SEGMENT`` rows. Segments are composed upwards in a tree with
``FAN`` children a node, costs that remain go down the tree, the end states of each segment go up,
start states go down, and each segment unrolls its own rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tallyweave.llm.common import join_groups
from tallyweave.operators.ordering import group_ordinal
from tallyweave.session import cut

SEGMENT = 4096
FAN = 512
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: States: nothing yet, after the system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
#: State after a user or assistant turn that an edit makes: the one that may follow.
NEXT = (USER, USER, ASSISTANT, USER)
#: State after a kept turn, by role letter.
KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}, "o": {}}
FAR = 1 << 40
#: Cost to finish from each state when no row is left and nothing may be inserted.
DONE = (0, FAR, FAR, 0)


def product(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Min-plus product; unreachable stays unreachable."""
    return np.minimum((left[:, :, None] + right[None, :, :]).min(axis=1), FAR)


def _inserted() -> np.ndarray:
    """Cost from state to state by insertions alone."""
    step = np.full((4, 4), FAR, np.int64)
    np.fill_diagonal(step, 0)
    for p, q in enumerate(NEXT):
        step[p, q] = INSERT
    return product(product(step, step), step)


GAPS = _inserted()


@lru_cache
def options(symbol: str, state: int) -> tuple[tuple[str, int, int], ...]:
    """What may be done with a row besides insertions before it: letter, cost, next state; least letter first.

    A symbol is a role letter (s, u, a or o for others) and ``x`` (must go), ``t`` (truncated) or ``.``.
    """
    role, fault = symbol
    found = [("D", DELETE, state)]
    if fault != "x":
        extra = TRUNCATED if fault == "t" else 0
        if state in KEPT[role]:
            found.append(("K", KEEP + extra, KEPT[role][state]))
        found.append(("R", REROLE + extra, NEXT[state]))
    return tuple(found)


@lru_cache
def power(symbol: str, k: int) -> np.ndarray:
    """Transition over 2^k rows of ``symbol``, insertions before each included."""
    if k:
        half = power(symbol, k - 1)
        return product(half, half)
    row = np.full((4, 4), FAR, np.int64)
    for p in range(4):
        for _, cost, q in options(symbol, p):
            row[p, q] = min(row[p, q], cost)
    return product(GAPS, row)


def runs(symbols: list[str]) -> list[tuple[str, int]]:
    return [(symbol, sum(1 for _ in same)) for symbol, same in groupby(symbols)]


def transition(symbols: list[str]) -> np.ndarray:
    """Cost from state to state over a segment: the product of its runs' binary powers."""
    total = GAPS
    for symbol, n in runs(symbols):
        for k in range(n.bit_length()):
            if n >> k & 1:
                total = product(total, power(symbol, k))
    return total


def before_run(symbol: str, n: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """Costs that remain before ``n`` rows of ``symbol``, given those behind them."""
    column = np.array(after, np.int64)[:, None]
    for k in range(n.bit_length()):
        if n >> k & 1:
            column = product(power(symbol, k), column)
    return tuple(column[:, 0].tolist())


@lru_cache(maxsize=1 << 16)
def _one_before(symbol: str, after: tuple[int, ...]) -> tuple[int, ...]:
    return before_run(symbol, 1, after)


@lru_cache(maxsize=1 << 16)
def _choose(symbol: str | None, state: int, here: tuple[int, ...], after: tuple[int, ...]) -> tuple[str, int]:
    """Least cheapest letters from ``state`` over one row (or over the end, without a symbol), and the next state."""
    letters = ""
    while True:
        if symbol is None:
            if here[state] == after[state]:
                return letters, state
        else:
            letter, cost, then = options(symbol, state)[0]
            if cost + after[then] == here[state]:
                return letters + letter, then
        if INSERT + here[NEXT[state]] == here[state]:
            letters, state = letters + "I", NEXT[state]
            continue
        for letter, cost, then in options(symbol, state)[1:]:
            if cost + after[then] == here[state]:
                return letters + letter, then
        raise ValueError("no choice has the cost that remains")


def _base(costs: tuple[int, ...]) -> tuple[int, ...]:
    """Costs less their minimum: what choices depend on, in few different values."""
    least = min(costs)
    return tuple(min(c - least, FAR) for c in costs)


def unroll(symbols: list[str], state: int, after: tuple[int, ...]) -> tuple[list[str], int]:
    """Letters per row (insertions before it included) and the end state of a segment."""
    parts = runs(symbols)
    ends = [_base(after)]
    for symbol, n in reversed(parts):
        ends.append(_base(before_run(symbol, n, ends[-1])))
    ends.reverse()
    letters = []
    for (symbol, n), end in zip(parts, ends[1:], strict=True):
        left = [end]
        for _ in range(n):
            left.append(_base(_one_before(symbol, left[-1])))
        for i in range(n, 0, -1):
            own = _one_before(symbol, left[i - 1])  # in the scale of the costs behind the row
            made, state = _choose(symbol, state, own, left[i - 1])
            letters.append(made)
    return letters, state


def finish(state: int) -> str:
    """Insertions at the end."""
    return _choose(None, state, before_end(), DONE)[0]


def before_end() -> tuple[int, ...]:
    return tuple(product(GAPS, np.array(DONE, np.int64)[:, None])[:, 0].tolist())


def repair(symbols: list[str]) -> tuple[int, str]:
    """Least cost and audit of one conversation in plain Python, by the same steps."""
    after = before_end()
    total = product(transition(symbols), np.array(after)[:, None])[START, 0]
    letters, state = unroll(symbols, START, after)
    return int(total), "".join(letters) + finish(state)


# ---- on tables


def _blank(text: Column) -> Column:
    return ~text.rlike(r"[^\x20\x09-\x0D]")


def inspect(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows numbered in their conversation, with their first fault: ``_key``, ``_pos`` (from 0), ``_turn``, ``_role``, ``_text``, ``_fault``.

    A null role or text is one space. Order is by turn (nulls first), role, text. Faults, the first
    that holds: ``blank`` (no character but space, tab and line breaks), ``duplicate`` (role and
    text of an earlier row), ``truncated`` (the last other character is none of ``.!?``), else null.
    """
    space = F.lit(" ")
    plain = rows.select(
        F.col(key).alias("_key"), F.col(turn).alias("_turn"), F.coalesce(F.col(role).cast("string"), space).alias("_role"),
        F.coalesce(F.col(text).cast("string"), space).alias("_text"),
    ).withColumn("_row", F.monotonically_increasing_id())  # the row's number only parts equal rows
    placed = group_ordinal(plain, ["_key"], ["_turn", "_role", "_text", "_row"], "_pos").drop("_row")
    said = F.sha2(F.concat(F.length("_role").cast("string"), F.lit(":"), "_role", "_text"), 256)
    placed = cut(placed.withColumn("_pos", F.col("_pos") - 1).withColumn("_said", said))
    copies = placed.groupBy("_key", "_said").agg(F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    marked = join_groups(placed, cut(copies), ["_key", "_said"], "_n")
    fault = (
        F.when(_blank(F.col("_text")), "blank").when(F.col("_pos") > F.col("_first"), "duplicate")
        .when(~F.col("_text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated")
    )
    return marked.select("_key", "_pos", "_turn", "_role", "_text", fault.alias("_fault"))


def _symbol() -> Column:
    letter = F.substring("_role", 1, 1)
    role = F.when(letter.isin("s", "u", "a"), letter).otherwise("o")
    fault = F.when(F.col("_fault").isin("blank", "duplicate"), "x").when(F.col("_fault") == "truncated", "t").otherwise(".")
    return F.concat(role, fault)


def _mapped(df: DataFrame, schema: T.StructType, fn: Callable[[dict], dict]) -> DataFrame:
    """One output row per input row, in Arrow batches."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                yield pa.RecordBatch.from_pylist([fn(row) for row in batch.slice(at, 256).to_pylist()], schema=arrow)

    return df.mapInArrow(run, schema)


def _schema(df: DataFrame, **kinds: str) -> T.StructType:
    """The key column and further ones of the given types."""
    return T.StructType([df.schema["_key"]] + [T.StructField(n, T._parse_datatype_string(k)) for n, k in kinds.items()])


def sweep(leaves: DataFrame, join: Callable[[list], list], deal: Callable[[list, list], list], top: list, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """Compose the values of segments up a tree, then hand a context down: (root values, context per segment).

    ``leaves`` has ``_key``, ``_seg`` and ``_v``, and is read several times. ``join`` composes the
    values of neighbouring nodes; ``deal`` gives each of them its context from their parent's.
    A node has ``fan`` children at most and a tree ends when every conversation has one node.
    """
    schema = _schema(leaves, _seg="bigint", _v="array<bigint>")

    def grouped(level: DataFrame) -> DataFrame:
        child = F.struct(F.col("_seg").alias("seg"), F.col("_v").alias("v"))
        parent = F.call_function("div", F.col("_seg"), F.lit(fan)).alias("_up")
        return level.groupBy("_key", parent).agg(F.sort_array(F.collect_list(child)).alias("_children"))

    levels = [leaves]
    while levels[-1].filter("_seg > 0").limit(1).count():
        made = _mapped(grouped(levels[-1]), schema, lambda r: {"_key": r["_key"], "_seg": r["_up"], "_v": join([c["v"] for c in r["_children"]])})
        levels.append(cut(made))
    given = levels[-1].select("_key", "_seg", F.array(*map(F.lit, top)).cast("array<bigint>").alias("_given"))
    for level in reversed(levels[:-1]):
        parents = given.select(F.col("_key").alias("_k"), F.col("_seg").alias("_s"), "_given")
        nodes = grouped(level)
        nodes = nodes.join(parents, nodes["_key"].eqNullSafe(parents["_k"]) & (nodes["_up"] == parents["_s"])).drop("_k", "_s")
        dealt = _schema(leaves, _dealt="array<struct<seg:bigint,given:array<bigint>>>")
        down = _mapped(nodes, dealt, lambda r: {"_key": r["_key"], "_dealt": [
            {"seg": c["seg"], "given": g} for c, g in zip(r["_children"], deal([c["v"] for c in r["_children"]], r["_given"]), strict=True)
        ]})
        given = down.select("_key", F.explode("_dealt").alias("_d")).select("_key", F.col("_d.seg").alias("_seg"), F.col("_d.given").alias("_given"))
        given = cut(given)
    return levels[-1], given


def _composed(matrices: list) -> list:
    total = GAPS
    for m in matrices:
        total = product(total, np.array(m, np.int64).reshape(4, 4))
    return total.ravel().tolist()


def _remaining(matrices: list, after: list) -> list:
    """Costs that remain behind each child, given those behind the last."""
    out, column = [], np.array(after, np.int64)[:, None]
    for m in reversed(matrices):
        out.append(column[:, 0].tolist())
        column = product(np.array(m, np.int64).reshape(4, 4), column)
    return out[::-1]


def _followed(maps: list) -> list:
    return [_states(maps, [s])[-1] for s in range(4)]


def _states(maps: list, given: list) -> list:
    """Start state, then the state behind each child."""
    out = [given[0]]
    for m in maps:
        out.append(m[out[-1]])
    return out


def repair_conversations(
    rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", segment: int = SEGMENT, fan: int = FAN
) -> DataFrame:
    """The cheapest edits of every conversation, one row per edit in order of ``pos``, ``step``.

    ``key``, ``pos`` (number of the row in its conversation, from 0; an insertion has that of the row it
    stands before), ``step`` (order at one ``pos``), ``action`` (keep, rerole, delete, insert), ``role``
    and ``text`` after the edit (null if deleted), ``turn``, ``was`` (the role before; null if inserted),
    ``fault`` and ``cost``. Roles count by their first letter. Deletion is required for blank and
    duplicate rows; a truncated row that stays adds ``TRUNCATED``. Among equally cheap repairs the
    letters D, I, K, R of the edits are ASCII-least. Rows with a null key form one conversation;
    repeated rows are rows of their own (and duplicates); other columns are ignored; an empty
    table gives no rows.
    """
    seen = cut(inspect(rows, key, turn, role, text))
    narrow = seen.select("_key", F.call_function("div", F.col("_pos"), F.lit(segment)).alias("_seg"), "_pos", _symbol().alias("_symbol"))
    gathered = narrow.groupBy("_key", "_seg").agg(F.sort_array(F.collect_list(F.struct("_pos", "_symbol"))).alias("_rows"))
    parts = cut(gathered.select("_key", "_seg", F.col("_rows._symbol").alias("_symbols")))

    def valued(row: dict) -> dict:
        return {"_key": row["_key"], "_seg": row["_seg"], "_v": transition(row["_symbols"]).ravel().tolist()}

    leaves = cut(_mapped(parts, _schema(parts, _seg="bigint", _v="array<bigint>"), valued))
    after = sweep(leaves, _composed, _remaining, list(before_end()), fan)[1]
    parts = cut(_same_place(parts, after, "_after"))

    def ends(row: dict) -> dict:
        alone = not row["_seg"] and len(row["_symbols"]) < segment  # then it is entered at the start only
        after = tuple(row["_after"])
        return {"_key": row["_key"], "_seg": row["_seg"], "_v": [START if alone and s != START else unroll(row["_symbols"], s, after)[1] for s in range(4)]}

    behind = cut(_mapped(parts, _schema(parts, _seg="bigint", _v="array<bigint>"), ends))
    tops, begin = sweep(behind, _followed, lambda maps, given: [[s] for s in _states(maps, given)[:-1]], [START], fan)

    def unrolled(row: dict) -> dict:
        letters, state = unroll(row["_symbols"], row["_begin"][0], tuple(row["_after"]))
        states, now = [], row["_begin"][0]
        for made, symbol in zip(letters, row["_symbols"], strict=True):
            states.append(now)
            now = _walk(now, made, symbol)
        return {"_key": row["_key"], "_seg": row["_seg"], "_letters": letters, "_states": states}

    made = _mapped(_same_place(parts, begin, "_begin"), _schema(parts, _seg="bigint", _letters="array<string>", _states="array<bigint>"), unrolled)
    made = made.select("_key", "_seg", F.posexplode(F.arrays_zip("_letters", "_states")).alias("_i", "_made"))
    made = made.select(F.col("_key").alias("_k"), (F.col("_seg") * segment + F.col("_i")).alias("_p"), F.col("_made._letters").alias("_letters"), F.col("_made._states").alias("_state"))
    joined = seen.join(made, seen["_key"].eqNullSafe(made["_k"]) & (seen["_pos"] == made["_p"])).drop("_k", "_p")
    # the end of a conversation: insertions after its last row
    last = seen.groupBy("_key").agg((F.max("_pos") + 1).alias("_pos"))
    final = tops.select(F.col("_key").alias("_k"), F.element_at("_v", START + 1).alias("_state"))
    last = last.join(final, last["_key"].eqNullSafe(final["_k"])).drop("_k")
    tail = F.element_at(F.array(*[F.lit(finish(s)) for s in range(4)]), (F.col("_state") + 1).cast("int"))
    last = last.withColumn("_letters", tail).filter("_letters <> ''")
    return _edits(joined.unionByName(last, allowMissingColumns=True), key)


def _walk(state: int, letters: str, symbol: str) -> int:
    for letter in letters:
        state = NEXT[state] if letter in "IR" else KEPT[symbol[0]][state] if letter == "K" else state
    return state


def _same_place(parts: DataFrame, given: DataFrame, name: str) -> DataFrame:
    other = given.select(F.col("_key").alias("_k"), F.col("_seg").alias("_s"), F.col("_given").alias(name))
    return parts.join(other, parts["_key"].eqNullSafe(other["_k"]) & (parts["_seg"] == other["_s"])).drop("_k", "_s")


def _edits(rows: DataFrame, key: str) -> DataFrame:
    """One row per letter. A made turn is assistant's behind a user turn and else user's."""
    letters = rows.select("*", F.posexplode(F.split("_letters", "")).alias("_step", "_letter")).filter("_letter <> ''")
    # insertions at one place alternate, so the state before the step-th letter follows from that before the first
    state = F.when(F.col("_step") == 0, F.col("_state")).otherwise(
        F.when((F.col("_state") == USER) == (F.col("_step") % 2 == 1), ASSISTANT).otherwise(USER)
    )
    new = F.when(state == USER, "assistant").otherwise("user")
    letter = F.col("_letter")
    of_row = letter != "I"
    extra = F.when(of_row & (letter != "D") & (F.col("_fault") == "truncated"), TRUNCATED).otherwise(0)
    cost = F.when(letter == "D", DELETE).when(letter == "I", INSERT).when(letter == "R", REROLE).otherwise(KEEP) + extra
    return letters.select(
        F.col("_key").alias(key), F.col("_pos").alias("pos"), F.col("_step").alias("step"),
        F.when(letter == "D", "delete").when(letter == "I", "insert").when(letter == "R", "rerole").otherwise("keep").alias("action"),
        F.when(letter == "K", F.col("_role")).when(letter != "D", new).alias("role"),
        F.when(letter == "I", "").when(letter != "D", F.col("_text")).alias("text"),
        F.when(of_row, F.col("_turn")).alias("turn"), F.when(of_row, F.col("_role")).alias("was"), F.when(of_row, F.col("_fault")).alias("fault"), cost.cast("bigint").alias("cost"),
    )


def repaired(edits: DataFrame, key: str = "conv_id") -> DataFrame:
    """The turns that remain: ``key``, ``pos``, ``step`` (their order), ``role``, ``text``."""
    return edits.filter("action <> 'delete'").select(key, "pos", "step", "role", "text")


#: Adjacent role letters that may stand in a conversation.
LEGAL = {"su", "ua", "au"}


def digests(edits: DataFrame, key: str = "conv_id") -> DataFrame:
    """Per conversation: faults, cost, audit letters and hash of the repaired turns (role:text, a line each).

    ``gaps`` counts missing turn numbers between the least and the greatest (null turns aside),
    ``illegal`` adjacent rows whose role letters are none of ``LEGAL``. A conversation's edits
    stream through one task in order, as a hash of the whole is asked for; no more than one is held.
    """
    kind = edits.schema[key].dataType
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    schema = T.StructType([T.StructField(key, kind)] + [T.StructField(c, T.LongType()) for c in names] + [T.StructField(c, T.StringType()) for c in ("audit", "repaired_sha256")])
    arrow = to_arrow_schema(schema)
    letter = {"keep": "K", "rerole": "R", "delete": "D", "insert": "I"}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (row for batch in batches for at in range(0, len(batch), 256) for row in batch.slice(at, 256).to_pylist())
        for value, rows in groupby(stream, key=lambda r: r["_key"]):
            count, audit, whole = dict.fromkeys(names, 0), [], hashlib.sha256()
            before = low = high = None
            turns, begun = 0, False
            for row in rows:
                audit.append(letter[row["action"]])
                count["cost"] += row["cost"]
                if row["action"] != "delete":
                    whole.update((("\n" if begun else "") + f"{row['role']}:{row['text']}").encode())
                    begun = True
                if row["action"] == "insert":
                    continue
                if row["fault"]:
                    count[row["fault"]] += 1
                if before is not None and before + row["was"][:1] not in LEGAL:
                    count["illegal"] += 1
                before, now = row["was"][:1], row["turn"]
                if now is not None:
                    turns += now != high  # rows come in order of turns
                    low, high = now if low is None else low, now
            count["gaps"] = int(high - low) + 1 - turns if turns else 0
            out = {key: value, **count, "audit": "".join(audit), "repaired_sha256": whole.hexdigest()}
            yield pa.RecordBatch.from_pylist([out], schema=arrow)

    ordered = edits.withColumnRenamed(key, "_key").repartition("_key").sortWithinPartitions("_key", "pos", "step")
    return ordered.mapInArrow(read, schema)
