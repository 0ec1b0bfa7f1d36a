"""Chat formatting: schema fingerprints pick a declarative mapping to canonical turns; a reversible turn template."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template's signs. A text's "<" and "[" are followed by a backslash in the output, and "\" by another one, so
#: that neither the template's marks nor other control strings can stand in a text; ``unescape`` takes them out.
TURN, BODY, END = "<|turn|>", "<|text|>", "<|end|>"
_MARKED = re.compile(r"([<\[\\])\\")


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "<\\").replace("[", "[\\")


def unescape(text: str) -> str:
    return _MARKED.sub(r"\1", text)


def paths(value: object, at: str = "") -> set[str]:
    """Nested field paths of a JSON value; all items of an array share the path ``[]``."""
    if isinstance(value, dict):
        return set().union(*[paths(v, f"{at}.{k}" if at else str(k)) for k, v in value.items()]) if value else {at + "{}"}
    if isinstance(value, list):
        return set().union(*[paths(v, at + "[]") for v in value]) if value else {at + "[]"}
    return {at}


def fingerprint(value: object) -> str:
    """Hash of the record's field paths: records of one layout share it whatever their contents."""
    return hashlib.sha256("\n".join(sorted(paths(value))).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Mapping:
    """Where a layout keeps its turns. needs: paths by which the layout is known (others may be missing or extra).

    Either ``turns`` is the path of an array of items with ``role`` and ``text``, or ``fixed`` lists (role, paths) of
    turns; the texts at the paths of one turn are joined by an empty line. A row layout (``order``) holds one turn.
    """

    name: str
    needs: frozenset[str]
    turns: str | None = None
    role: str | None = None
    text: str | None = None
    order: str | None = None
    fixed: tuple[tuple[str, tuple[str, ...]], ...] = ()
    roles: dict[str, str] = field(default_factory=dict, hash=False)


#: Names that stand for a canonical role; other roles are kept as they are.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}


def _mapping(name: str, needs: str, **how) -> Mapping:
    return Mapping(name, frozenset(needs.split()), **how)


#: The layouts known at first; the one with the most needed paths that a record has is taken.
LAYOUTS = (
    _mapping("turn rows", "conv_id turn role text", role="role", text="text", order="turn"),
    _mapping("messages", "messages[].role messages[].content", turns="messages", role="role", text="content", roles=ROLES),
    _mapping("from-value", "conversations[].from conversations[].value", turns="conversations", role="from", text="value", roles=ROLES),
    _mapping("dialogue", "dialog[].speaker dialog[].text", turns="dialog", role="speaker", text="text", roles=ROLES),
    _mapping("instruction", "instruction output", fixed=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
    _mapping("prompt-completion", "prompt completion", fixed=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",)))),
    _mapping("prompt-response", "prompt response", fixed=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    _mapping("question-answer", "question answer", fixed=(("system", ("system",)), ("user", ("context", "question")), ("assistant", ("answer",)))),
)


@lru_cache(maxsize=4096)
def _choose(mark: str, have: frozenset[str], layouts: tuple[Mapping, ...]) -> Mapping | None:
    """The mapping of a fingerprint; remembered, so that each layout is matched once in a worker."""
    fits = [m for m in layouts if m.needs <= have]
    return max(fits, key=lambda m: len(m.needs), default=None)


def turns_of(value: object, layouts: tuple[Mapping, ...] = LAYOUTS) -> tuple[str, list[tuple[str, str]], int | None] | None:
    """(layout, [(role, text)], order of a row layout) of one JSON record; None if no layout fits."""
    if not isinstance(value, dict):
        return None
    have = frozenset(paths(value))
    mapping = _choose(fingerprint(value), have, layouts)
    if mapping is None:
        return None
    say = lambda x: "" if x is None else x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)
    if mapping.turns is not None:
        items = value.get(mapping.turns) or []
        return mapping.name, [(mapping.roles.get(say(i.get(mapping.role)), say(i.get(mapping.role))), say(i.get(mapping.text))) for i in items if isinstance(i, dict)], None
    if mapping.order is not None:
        return mapping.name, [(say(value.get(mapping.role)), say(value.get(mapping.text)))], value.get(mapping.order)
    out = []
    for role, places in mapping.fixed:
        given = [say(value[p]) for p in places if value.get(p) not in (None, "")]
        if given or any(p in mapping.needs for p in places):
            out.append((role, "\n\n".join(given)))
    return mapping.name, out, None


def _read(data: str | None, layouts: tuple[Mapping, ...]) -> tuple[str, list[tuple[str, str]], int | None] | None:
    """``turns_of`` a JSON text; None also for what is no JSON, nested beyond the interpreter's depth, no valid Unicode (lone
    surrogates), or numbered by anything but a whole number of 64 bits."""
    if data is None:
        return None
    try:
        found = turns_of(json.loads(data), layouts)
        if found is not None:
            for said in found[1]:
                "".join(said).encode()
    except (ValueError, RecursionError):
        return None
    if found is not None and found[2] is not None and (type(found[2]) is not int or not -(1 << 63) <= found[2] < 1 << 63):
        return None
    return found


def canonical_turns(records: DataFrame, id_col: str, json_col: str, layouts: tuple[Mapping, ...] = LAYOUTS) -> DataFrame:
    """(id_col, layout, turn long, role, text): the turns of JSON records of any known layout.

    Records that are null, not JSON, nested too deeply, no valid Unicode, of a row layout whose number is no whole number, or
    of no known layout give one row with a null layout, turn, role and text.
    ``turn`` is the place in the record, or the record's own number in a row layout (null if it has none).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, layout, turn, role, text = [], [], [], [], []
            for k, data in enumerate(batch.column(1).to_pylist()):
                name, said, own = _read(data, layouts) or (None, [(None, None)], None)
                for j, (r, t) in enumerate(said):
                    row.append(k)
                    layout.append(name)
                    turn.append(None if name is None else own if len(said) == 1 and _is_row(name, layouts) else j)
                    role.append(r)
                    text.append(t)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(layout, pa.string()), pa.array(turn, pa.int64()), pa.array(role, pa.string()), pa.array(text, pa.string())], names=["id", "layout", "turn", "role", "text"])

    kind = records.schema[id_col].dataType.simpleString()
    rows = records.select(F.col(id_col).alias("id"), F.col(json_col).alias("json"))
    return rows.mapInArrow(run, f"id {kind}, layout string, turn long, role string, text string").withColumnRenamed("id", id_col)


def _is_row(name: str, layouts: tuple[Mapping, ...]) -> bool:
    return any(m.name == name and m.order is not None for m in layouts)


def format_turn(role: str, text: str) -> str:
    return f"{TURN}{escape(role)}{BODY}{escape(text)}{END}\n"


def format_chats(turns: DataFrame, id_col: str, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(id_col, formatted, loss_starts array<long>, loss_ends array<long>): one row per conversation.

    Turns are ordered by number (null first), then role, then text, so repeated numbers have one order; repeated rows
    are all kept. A null role or text is empty. The loss mask holds the spans (in code points) of the escaped texts
    of the loss roles, without any mark. A conversation is streamed through its task turn by turn after sorting.
    Rows whose id is null are one conversation.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, str]] = []
        now: object = None
        fresh = True

        def out(id_type: pa.DataType) -> pa.RecordBatch:
            parts, starts, ends, at = [], [], [], 0
            for role, text in held:
                piece = format_turn(role, text)
                if role in loss_roles:
                    begin = at + len(TURN) + len(escape(role)) + len(BODY)
                    starts.append(begin)
                    ends.append(begin + len(escape(text)))
                parts.append(piece)
                at += len(piece)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([now], id_type), pa.array(["".join(parts)], pa.string()), pa.array([starts], pa.list_(pa.int64())), pa.array([ends], pa.list_(pa.int64()))], names=["id", "formatted", "loss_starts", "loss_ends"])

        id_type = None
        for batch in batches:
            id_type = batch.column(0).type
            for one, role, text in zip(*[batch.column(c).to_pylist() for c in ("id", "role", "text")], strict=True):
                if not fresh and one != now:
                    yield out(id_type)
                now, fresh = one, False
                held.append((role or "", text or ""))
        if held:
            yield out(id_type)

    kind = turns.schema[id_col].dataType.simpleString()
    rows = turns.select(F.col(id_col).alias("id"), "turn", "role", "text")
    ordered = rows.repartition("id").sortWithinPartitions("id", "turn", "role", "text")
    return ordered.mapInArrow(run, f"id {kind}, formatted string, loss_starts array<bigint>, loss_ends array<bigint>").withColumnRenamed("id", id_col)


def parse_chat(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation; ValueError if it isn't one."""
    out = []
    for piece in formatted.split(END + "\n"):
        if not piece:
            continue
        if not piece.startswith(TURN) or BODY not in piece:
            raise ValueError("not a formatted conversation")
        role, text = piece[len(TURN) :].split(BODY, 1)
        out.append((unescape(role), unescape(text)))
    return out


def read_chats(chats: DataFrame, id_col: str) -> DataFrame:
    """What the formatted conversations say, read from them: turn count and digest, loss characters and digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for text, starts, ends in zip(*[batch.column(k).to_pylist() for k in (1, 2, 3)], strict=True):
                said = parse_chat(text)
                loss = "".join(unescape(text[a:b]) for a, b in zip(starts, ends, strict=True))
                digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest()
                for column, value in zip(out, (len(said), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)), strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(out, kinds, strict=True)]], names=["id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = chats.schema[id_col].dataType.simpleString()
    rows = chats.select(F.col(id_col).alias("id"), "formatted", "loss_starts", "loss_ends")
    return rows.mapInArrow(run, f"id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long").withColumnRenamed("id", id_col)


def as_record(*columns: str) -> Column:
    """The columns of a row as a JSON record, null fields included, so that rows of one table share a fingerprint."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
