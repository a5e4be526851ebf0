"""Chat formatting by schema fingerprints.

A record is JSON text.  The sorted nested field paths of a record are hashed, those of a list's elements by element, so
that an element with other fields than its neighbours' changes the hash; the hash selects a declarative mapping (where the turns are, which field is the role, which the text), so records of different layouts
become the same canonical turns without probing field by field.  Turns are rendered into one marked-up text whose
control strings are escaped reversibly, with the loss mask as spans over the assistant's texts.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices


class Layout(NamedTuple):
    """A declarative mapping.  ``turns`` is the path of a list of messages, or None if the record itself is described
    by ``fixed``: (role, fields whose texts are joined by a blank line) in order."""

    name: str
    turns: str | None
    role: str | None
    text: str | None
    fixed: tuple[tuple[str, tuple[str, ...]], ...] = ()


def paths_of(value: object, at: str = "$") -> set[str]:
    """Nested field paths, objects and lists marked as such.  Scalars of any kind, null among them, are alike; a list has
    one path for each different shape among its elements, named by the shape's own hash."""
    if isinstance(value, dict):
        out = {f"{at}:object"}
        for k, v in value.items():
            out |= paths_of(v, f"{at}.{k}")
        return out
    if isinstance(value, list):
        return {f"{at}:list", *(f"{at}[{schema_fingerprint(v)}]" for v in value)}
    return {at}


def schema_fingerprint(value: object) -> str:
    """Hex hash of the sorted field paths of a record."""
    return hashlib.blake2b("\n".join(sorted(paths_of(value))).encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


def registry(examples: list[tuple[object, Layout]]) -> dict[str, Layout]:
    """Fingerprint to layout, from one example record of each layout."""
    return {schema_fingerprint(example): layout for example, layout in examples}


_ROW = Layout("row", None, "role", "text")
_MESSAGES = Layout("messages", "messages", "role", "content")
_SHARE = Layout("conversations", "conversations", "from", "value")
_TASK = Layout("instruction", None, None, None, (("user", ("instruction", "input")), ("assistant", ("output",))))
_PROMPT = Layout("prompt", None, None, None, (("user", ("prompt",)), ("assistant", ("completion",))))
_ANSWER = Layout("question", None, None, None, (("user", ("question",)), ("assistant", ("answer",))))
LAYOUTS = registry(
    [
        ({"role": "", "text": ""}, _ROW),
        ({"conv_id": 0, "turn": 0, "role": "", "text": ""}, _ROW),
        ({"messages": [{"role": "", "content": ""}]}, _MESSAGES),
        ({"messages": []}, _MESSAGES),
        ({"id": 0, "messages": [{"role": "", "content": ""}]}, _MESSAGES),
        ({"conversations": [{"from": "", "value": ""}]}, _SHARE),
        ({"conversations": []}, _SHARE),
        ({"id": 0, "conversations": [{"from": "", "value": ""}]}, _SHARE),
        ({"instruction": "", "input": "", "output": ""}, _TASK),
        ({"instruction": "", "output": ""}, _TASK._replace(fixed=(("user", ("instruction",)), ("assistant", ("output",))))),
        ({"prompt": "", "completion": ""}, _PROMPT),
        ({"prompt": "", "response": ""}, _PROMPT._replace(fixed=(("user", ("prompt",)), ("assistant", ("response",))))),
        ({"system": "", "prompt": "", "completion": ""}, _PROMPT._replace(fixed=(("system", ("system",)), *_PROMPT.fixed))),
        ({"question": "", "answer": ""}, _ANSWER),
    ]
)
#: Halves of surrogate pairs, which JSON can escape but UTF-8 can't hold, become replacement characters.
_HALVES = re.compile("[\ud800-\udfff]")
#: Names that other layouts give to the canonical roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def turns_of(record: object, layouts: dict[str, Layout] = LAYOUTS) -> tuple[str | None, list[tuple[str, str]]]:
    """The layout's name and the canonical turns (role, text); (None, []) for a record of no known layout."""
    layout = layouts.get(schema_fingerprint(record))
    if layout is None:
        return None, []
    say = lambda v: "" if v is None else _HALVES.sub("\ufffd", v) if isinstance(v, str) else json.dumps(v)
    if layout.fixed:
        return layout.name, [(role, "\n\n".join(t for f in fields if (t := say(record[f])))) for role, fields in layout.fixed]
    rows = [record] if layout.turns is None else record[layout.turns]
    names = [say(r[layout.role]) for r in rows]
    if layout.name == "conversations":
        names = [ROLES.get(n, n) for n in names]
    return layout.name, [(n, say(r[layout.text])) for n, r in zip(names, rows)]


#: Control strings of the template; a backslash before one, or before a backslash, makes it plain text.  In a role the
#: colon is escaped too, since a colon ends the role.
OPEN, SAYS, CLOSE = "### ", ": ", " </turn>\n"
_IN_TEXT = re.compile(r"\\|###|</turn>")
_IN_ROLE = re.compile(r"\\|###|</turn>|:")
_ESCAPED = re.compile(r"\\(\\|###|</turn>|:)")
_TURN = re.compile(r"### ((?:[^\\:]|\\(?:\\|###|</turn>|:))*+): ((?:[^\\ ]++|\\(?:\\|###|</turn>)| (?!</turn>\n))*+) </turn>\n")


def escape(text: str, control: re.Pattern = _IN_TEXT) -> str:
    return control.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """One turn's markup, and the span of its text inside it if it is the assistant's, else (0, 0)."""
    head, body = f"{OPEN}{escape(role, _IN_ROLE)}{SAYS}", escape(text)
    span = (len(head), len(head) + len(body)) if role == "assistant" else (0, 0)
    return f"{head}{body}{CLOSE}", *span


def read_back(markup: str) -> list[tuple[str, str]]:
    """The turns of a marked-up text, by scanning for unescaped control strings."""
    out, at = [], 0
    while at < len(markup):
        if not (turn := _TURN.match(markup, at)):
            raise ValueError(f"no whole turn at {at}")
        out.append((unescape(turn[1]), unescape(turn[2])))
        at = turn.end()
    return out


SEGMENTS = "layout string, role string, markup string, loss_start int, loss_end int"


def format_records(records: DataFrame, key: str, order: str | None = None, record: str = "record") -> DataFrame:
    """(key, seq, layout, role, markup, loss_start, loss_end), one row a turn, from JSON records.

    A conversation's formatted text is its markups in the order of ``order`` and seq, so a conversation of any length
    needs no row that holds all of it.  A record of an unknown layout, null, broken or too deeply nested JSON gives one
    row with a null layout and no markup.  Null texts and roles are empty texts; other scalars are written as JSON.
    """
    kinds = {f.name: f.dataType.simpleString() for f in records.schema}
    cols = [key] + ([order] if order else [])
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in cols), "seq int", SEGMENTS])
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = []
            for *ids, body in zip(*(part.column(c).to_pylist() for c in cols), part.column(record).to_pylist()):
                try:
                    layout, turns = turns_of(json.loads(body)) if body is not None else (None, [])
                except (ValueError, RecursionError):
                    layout, turns = None, []
                if not turns:
                    rows.append((*ids, 0, layout, None, None, 0, 0))
                rows += [(*ids, k, layout, role, *render(role, text)) for k, (role, text) in enumerate(turns)]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    return records.select(*cols, record).mapInArrow(run, schema)


DIGESTS = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


class _Digest:
    """Running digests of one conversation's markups."""

    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0

    def add(self, markup: str, start: int, end: int) -> None:
        for role, text in read_back(markup):
            self.turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            self.n += 1
        masked = unescape(markup[start:end])
        self.loss.update(masked.encode("utf-8", "surrogatepass"))
        self.loss_chars += len(masked)
        self.chars += len(markup)

    def row(self) -> tuple:
        return self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def digest_segments(segments: DataFrame, key: str, order: str) -> DataFrame:
    """(key, DIGESTS) read back from the markups of ``format_records``.

    A digest runs over a conversation in order, so a conversation's rows meet in one task, sorted; they stream through
    it with constant memory, however long the conversation is.  Ties of ``order`` go by role and markup.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = f"{key} {segments.schema[key].dataType.simpleString()}, {DIGESTS}"
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now, rows = None, None, []

        def flush() -> Iterator[pa.RecordBatch]:
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)
                rows.clear()

        for part in slices(batches):
            for k, markup, a, b in zip(*(part.column(c).to_pylist() for c in (key, "markup", "loss_start", "loss_end"))):
                if held is None or k != now:
                    if held is not None:
                        rows.append((now, *held.row()))
                    held, now = _Digest(), k
                if markup is not None:
                    held.add(markup, a, b)
            if len(rows) > 1000:
                yield from flush()
        if held is not None:
            rows.append((now, *held.row()))
        yield from flush()

    return (
        segments.select(key, order, "seq", "role", "markup", "loss_start", "loss_end")
        .repartition(key)
        .sortWithinPartitions(key, order, "seq", "role", "markup")
        .select(key, "markup", "loss_start", "loss_end")
        .mapInArrow(run, schema)
    )


def row_records(conversations: DataFrame) -> DataFrame:
    """A record of the row layout for each row of (conv_id, turn, role, text), nulls written out."""
    body = F.to_json(F.struct("conv_id", "turn", "role", "text"), {"ignoreNullFields": "false"})
    return conversations.select("conv_id", "turn", body.alias("record"))
