"""Chat formatting: schema fingerprints pick declarative mappings, turns are marked and escaped.

A record is a JSON object of any known layout. Its fingerprint is a hash of the sorted paths of its
leaves (array steps written ``[]``); a mapping lists where role and text of a layout's turns stand.
Mappings are data: a new layout is a new row of LAYOUTS. A record may hold further fields (a name, an id):
the first time its fingerprint is met, the layout with the most paths that are all there is chosen for it, unless a
field is left over in which some layout keeps text. So no text is dropped without a word.

The template writes a turn as ``### role: text</turn>`` and a line break. A backslash goes before each
backslash, ``#`` and ``<`` of a text or role (and before ``:`` of a role), so no control string survives inside one and reading
back undoes exactly that. Every turn stays a row, in order, so a conversation of any length is never
gathered; its loss mask is the span of an assistant's text in its row.

Defined results: null text or role is empty; a record that is not an object, or of an unknown layout,
gives one row with a null layout, role and text and the record itself in ``unread``; such a row is carried along and
never formatted. Turns of one conversation are ordered by turn, then place in the record, role and text; repeated
rows repeat; very long texts are read whole; an empty table gives an empty result. Other columns are carried along;
one that has the name of a column made here comes back as ``given_`` and its name.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "</turn>"


@dataclass(frozen=True)
class Layout:
    """``turns``: (fixed role, text path) in order; or ``each``: (array, role field, text field)."""

    name: str
    paths: tuple[str, ...]
    turns: tuple[tuple[str, str], ...] = ()
    each: tuple[str, str, str] | None = None
    roles: dict[str, str] = field(default_factory=dict)


# Known layouts.
_NAMES = {"human": "user", "gpt": "assistant"}
LAYOUTS = (
    Layout("prompt", ("prompt",), (("user", "prompt"),)),
    Layout("completion", ("completion",), (("assistant", "completion"),)),
    Layout("prompt_completion", ("prompt", "completion"), (("user", "prompt"), ("assistant", "completion"))),
    Layout("prompt_response", ("prompt", "response"), (("user", "prompt"), ("assistant", "response"))),
    Layout("question_answer", ("question", "answer"), (("user", "question"), ("assistant", "answer"))),
    Layout("instruction", ("instruction", "output"), (("user", "instruction"), ("assistant", "output"))),
    Layout(
        "instruction_input",
        ("instruction", "input", "output"),
        (("system", "instruction"), ("user", "input"), ("assistant", "output")),
    ),
    Layout("messages", ("messages[].role", "messages[].content"), each=("messages", "role", "content")),
    Layout("chat", ("chat.turns[].role", "chat.turns[].text"), each=("chat.turns", "role", "text")),
    Layout(
        "conversations", ("conversations[].from", "conversations[].value"), each=("conversations", "from", "value"), roles=_NAMES
    ),
)


def fingerprint(paths: tuple[str, ...] | set[str]) -> str:
    return hashlib.sha1("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def leaf_paths(value: object, at: str = "") -> set[str]:
    """Paths of all leaves; an empty object or array is a leaf."""
    found: set[str] = set()
    waiting = [(value, at)]
    while waiting:
        value, at = waiting.pop()
        if isinstance(value, dict) and value:
            waiting += [(v, f"{at}.{k}" if at else k) for k, v in value.items()]
        elif isinstance(value, list) and value:
            waiting += [(v, f"{at}[]") for v in value]
        else:
            found.add(at)
    return found


def _at(record: dict, path: str) -> object:
    for name in path.split("."):
        record = record[name]
    return record


def _text(value: object) -> str:
    text = "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
    # JSON can name half of a surrogate pair, which is no text.
    return text if text.isascii() else text.encode("utf-8", "replace").decode()


MAPPINGS = {fingerprint(layout.paths): layout for layout in LAYOUTS}
TEXTS = {path for layout in LAYOUTS for path in layout.paths if not layout.each or path.endswith(f".{layout.each[2]}")}
MADE = ("layout", "fingerprint", "part", "role", "text", "unread")
KNOWN = 100_000  # fingerprints remembered by a task


def choose_layout(paths: set[str]) -> Layout | None:
    """The layout with the most paths, all of them there, if no other path is one that a layout keeps text in."""
    fitting = [layout for layout in LAYOUTS if paths >= set(layout.paths)]
    best = max(fitting, key=lambda layout: len(layout.paths), default=None)
    return None if best is None or (paths - set(best.paths)) & TEXTS else best


def turns_of(record: str | None, known: dict[str, Layout | None] | None = None) -> list[tuple[str | None, str, str | None, str | None]]:
    """(layout, fingerprint, role, text) of each turn of a record; ``known`` are fingerprints met before."""
    known = dict(MAPPINGS) if known is None else known
    try:
        value = json.loads(record or "null")
    except (ValueError, RecursionError):
        value = None
    if not isinstance(value, dict):
        return [(None, fingerprint(()), None, None)]
    paths = leaf_paths(value)
    mark = fingerprint(paths)
    if mark not in known:
        if len(known) >= KNOWN:
            known.clear()
            known.update(MAPPINGS)
        known[mark] = choose_layout(paths)
    layout = known[mark]
    if layout is None:
        return [(None, mark, None, None)]
    if layout.each:
        array, role, text = layout.each
        steps = _at(value, array)
        if not isinstance(steps, list) or not all(isinstance(x, dict) for x in steps):
            return [(None, mark, None, None)]
        pairs = [(_text(x.get(role)), _text(x.get(text))) for x in steps]
    else:
        pairs = [(role, _text(_at(value, path))) for role, path in layout.turns]
    return [(layout.name, mark, layout.roles.get(role, role), text) for role, text in pairs]


def canonical_turns(records: DataFrame, record: str = "record") -> DataFrame:
    """The other columns of ``records`` with layout, fingerprint, part, role, text and unread, a row per turn."""
    keys = [c for c in records.columns if c != record]
    held = records.select(F.struct(*[F.col(f"`{c}`") for c in keys]).alias("key"), F.col(f"`{record}`").alias("record"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = dict(MAPPINGS)
        for batch in batches:
            rows, out = [], ([], [], [], [], [], [])
            for k, text in enumerate(batch.column(1).to_pylist()):
                for part, (layout, mark, role, body) in enumerate(turns_of(text, known)):
                    rows.append(k)
                    for column, item in zip(out, (layout, mark, part, role, body, text if layout is None else None), strict=True):
                        column.append(item)
            kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), *[pa.array(c, t) for c, t in zip(out, kinds, strict=True)]],
                ["key", *MADE],
            )

    kind = held.schema["key"].dataType.simpleString()
    turns = held.mapInArrow(run, f"key {kind}, layout string, fingerprint string, part int, role string, text string, unread string")
    given = [F.col(f"key.`{c}`").alias(f"given_{c}" if c.lower() in MADE else c) for c in keys]
    return turns.select(*given, *MADE)


def _escaped(text: Column, role: bool = False) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "([\\\\#<:])" if role else "([\\\\#<])", "\\\\$1")


def format_turns(turns: DataFrame) -> DataFrame:
    """``formatted`` for each turn, and the span [loss_start, loss_end) of it that is learnt (null if none).

    A row of :func:`canonical_turns` without a layout is no turn: all three are null.
    """
    head = F.concat(F.lit("### "), _escaped(F.col("role"), role=True), F.lit(": "))
    body = _escaped(F.col("text"))
    turn = F.col("layout").isNotNull() if "layout" in turns.columns else F.lit(True)
    learnt = turn & (F.col("role") == "assistant")
    return turns.withColumns(
        {
            "formatted": F.when(turn, F.concat(head, body, F.lit(f"{END}\n"))),
            "loss_start": F.when(learnt, F.length(head)),
            "loss_end": F.when(learnt, F.length(head) + F.length(body)),
        }
    )


_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.)*)</turn>\n", re.S)
_ESCAPE = re.compile(r"\\(.)", re.S)


def unescape(text: str) -> str:
    return _ESCAPE.sub(r"\1", text)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted text; what is not a whole turn is an error."""
    found, at = [], 0
    while at < len(formatted):
        turn = _TURN.match(formatted, at)
        if turn is None:
            raise ValueError(f"no turn at {at}")
        found.append((unescape(turn[1]), unescape(turn[2])))
        at = turn.end()
    return found


def digest_conversations(formatted: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Read formatted turns back in order and digest each conversation.

    A digest is sequential, so a conversation is streamed through one task, a batch at a time: memory
    does not grow with its length. Rows that are no turns take no part.
    """
    rows = formatted.filter(F.col("formatted").isNotNull()).select(F.col(key).alias("key"), "formatted", "loss_start", "loss_end", *[F.col(c).alias(f"o{k}") for k, c in enumerate(order)])
    rows = rows.repartition("key").sortWithinPartitions("key", *[f"o{k}" for k in range(len(order))])
    rows = rows.select("key", "formatted", "loss_start", "loss_end")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        current, state, started = None, None, False

        def closed() -> pa.RecordBatch:
            turns, all_turns, loss, learnt, size = state
            values = [current, turns, all_turns.hexdigest(), loss, learnt.hexdigest(), size]
            kinds = [key_kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names)

        key_kind = pa.int64()
        for batch in batches:
            key_kind = batch.schema.field(0).type
            columns = [batch.column(k).to_pylist() for k in range(4)]
            for name, text, low, high in zip(*columns, strict=True):
                if not started or name != current:
                    if started:
                        yield closed()
                    current, started = name, True
                    state = [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, body in read_turns(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{body}\n".encode())
                if low is not None:
                    learnt = unescape(text[low:high])
                    state[2] += len(learnt)
                    state[3].update(learnt.encode())
                state[4] += len(text)
        if started:
            yield closed()

    kind = rows.schema["key"].dataType.simpleString()
    schema = f"key {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)
