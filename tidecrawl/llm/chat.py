"""Chat formatting by schema fingerprints.

A record's nested field paths, with the kinds of their values, are hashed, as far as any layout knows them; the
fingerprint selects a declarative mapping that says where turns, roles and texts lie. Prompt, instruction, message and
turn-row layouts so become canonical turns, and these one marked-up text in which control strings inside texts are
escaped reversibly. Records without a mapping go whole to a table of rejects.
"""

from __future__ import annotations

import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


# ---------------------------------------------------------------- layouts
def paths(value, at: str = "") -> set[str]:
    """Nested field paths of a record with their kinds; list elements share the path []; nulls have none."""
    if isinstance(value, dict):
        return set().union(*(paths(v, f"{at}.{k}") for k, v in value.items())) if value else set()
    if isinstance(value, list):
        return set().union({f"{at}[]"}, *(paths(v, f"{at}[]") for v in value))
    if value is None:
        return set()
    kind = "bool" if isinstance(value, bool) else "number" if isinstance(value, (int, float)) else "text"
    return {f"{at}:{kind}"}


#: Each layout: an example of its shape, and its mapping. A mapping lists sources of turns in order:
#: ("each", list path, role path, text path) or ("one", role, text path) or ("row", role path, text path).
#: A path may name several, joined by +; dots lead into nested fields and through lists. The texts found are joined by
#: blank lines.
PARTS = "content+content.text"  # a text, or a list of typed parts with texts
LAYOUTS = [
    ({"role": "", "text": ""}, [("row", "role", "text")]),
    ({"role": ""}, [("row", "role", "text")]),
    ({"text": ""}, [("row", "role", "text")]),
    ({}, [("row", "role", "text")]),
    ({"messages": [{"role": "", "content": ""}]}, [("each", "messages", "role", PARTS)]),
    ({"messages": [{"role": "", "content": [{"type": "", "text": ""}]}]}, [("each", "messages", "role", PARTS)]),
    ({"messages": [{"role": "", "content": ""}, {"role": "", "content": [{"type": "", "text": ""}]}]}, [("each", "messages", "role", PARTS)]),
    ({"messages": [{"role": "", "text": ""}]}, [("each", "messages", "role", "text")]),
    ({"conversations": [{"from": "", "value": ""}]}, [("each", "conversations", "from", "value")]),
    ({"prompt": "", "completion": ""}, [("one", "user", "prompt"), ("one", "assistant", "completion")]),
    ({"prompt": "", "response": ""}, [("one", "user", "prompt"), ("one", "assistant", "response")]),
    ({"question": "", "answer": ""}, [("one", "user", "question"), ("one", "assistant", "answer")]),
    ({"instruction": "", "output": ""}, [("one", "user", "instruction"), ("one", "assistant", "output")]),
    ({"instruction": "", "input": "", "output": ""}, [("one", "user", "instruction+input"), ("one", "assistant", "output")]),
    ({"system": "", "instruction": "", "output": ""}, [("one", "system", "system"), ("one", "user", "instruction"), ("one", "assistant", "output")]),
    ({"system": "", "instruction": "", "input": "", "output": ""}, [("one", "system", "system"), ("one", "user", "instruction+input"), ("one", "assistant", "output")]),
]
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


class Layouts:
    """Mappings by the fingerprint of their shape. Only field paths that some layout names count in a fingerprint, so
    numbering, sources and other extra fields don't keep a record from its mapping."""

    def __init__(self, layouts: list[tuple[dict, list]]) -> None:
        self.known = frozenset().union(*(paths(shape) for shape, _ in layouts))
        self.mappings = {self.fingerprint(shape): mapping for shape, mapping in layouts}

    def fingerprint(self, record) -> str:
        own = sorted(paths(record) & self.known) if isinstance(record, dict) else ["not a record"]
        return hashlib.sha256("\n".join(own).encode()).hexdigest()[:16]

    def turns_of(self, record) -> list[tuple[str, str]]:
        """The canonical (role, text) turns of a record; none if no mapping has its fingerprint.

        A turn row needs its text field, though that may be null: else the text would lie in a field that isn't known.
        """
        mapping = self.mappings.get(self.fingerprint(record))
        if mapping is None or not isinstance(record, dict):
            return []
        out = []
        for how, *rule in mapping:
            if how == "each":
                out += [(ROLES.get(r := joined(x, rule[1]), r), joined(x, rule[2])) for x in record.get(rule[0]) or [] if isinstance(x, dict)]
            elif how == "one":
                out.append((rule[0], joined(record, rule[1])))
            elif rule[1] in record:
                out.append((joined(record, rule[0]), joined(record, rule[1])))
        return out


def found_at(value, steps: list[str]):
    """The texts, numbers and flags that a path leads to, through lists."""
    if isinstance(value, list):
        for x in value:
            yield from found_at(x, steps)
    elif steps:
        if isinstance(value, dict) and steps[0] in value:
            yield from found_at(value[steps[0]], steps[1:])
    elif value is not None and not isinstance(value, dict):
        yield str(value)


def joined(value: dict, names: str) -> str:
    return "\n\n".join(x for n in names.split("+") for x in found_at(value, n.split(".")))


# ---------------------------------------------------------------- template
def escape(text: str) -> str:
    """Put one more backslash into every '<', backslashes, '|': no control string is left."""
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn, and the character range of it that the loss covers."""
    head = f"{OPEN}{escape_role(role)}\n"
    body = escape(text)
    return head + body + CLOSE, len(head), len(head) + len(body) if role == "assistant" else len(head)


TURN = re.compile(re.escape(OPEN) + r"([^\n]*)\n(.*?)" + re.escape(CLOSE), re.S)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    out, at = [], 0
    while at < len(formatted):
        found = TURN.match(formatted, at)
        if found is None:
            raise ValueError(f"no turn at {at}")
        out.append((unescape_role(found[1]), unescape(found[2])))
        at = found.end()
    return out


# ---------------------------------------------------------------- operators
def canonical_turns(records: DataFrame, layouts: list[tuple[dict, list]] | None = None) -> DataFrame:
    """(conv_id, turn, part, role, text, layout, reject) from records(conv_id, turn, record): record is JSON text.

    One row for each canonical turn, part numbering those of one record; layout is its fingerprint. Records that are
    null, no JSON object, of a layout without a mapping or without any turn give one row that holds the whole record in
    reject (an empty text for null), without role and text: see rejected(). A record that occurs twice gives its turns
    twice; other columns are ignored.
    """
    known = LAYOUTS if layouts is None else layouts
    names = ["conv_id", "turn", "part", "role", "text", "layout", "reject"]

    def run(batches):
        made = Layouts(known)
        for batch in batches:
            out = []
            for conv, turn, raw in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "record"))):
                try:
                    record = json.loads(raw or "null")
                except ValueError:
                    record = None
                turns, layout = made.turns_of(record), made.fingerprint(record)
                out += [(conv, turn, k, r, t, layout, None) for k, (r, t) in enumerate(turns)] or [(conv, turn, 0, None, None, layout, raw or "")]
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int32(), *[pa.string()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    rows = records.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "record")
    return rows.mapInArrow(run, "conv_id long, turn long, part int, role string, text string, layout string, reject string")


def rejected(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, layout, record): the records of canonical_turns() that no mapping took, whole."""
    return turns.where("reject is not null").select("conv_id", "turn", "layout", F.col("reject").alias("record"))


def _sorted_turns(turns: DataFrame) -> DataFrame:
    cols = [c for c in ("turn", "part", "role", "text") if c in turns.columns]
    if {"reject", "layout"} <= set(turns.columns):
        turns = turns.where("reject is null")
    return turns.select("conv_id", *cols).repartition("conv_id").sortWithinPartitions("conv_id", *cols)


def format_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn_no, formatted, loss_from, loss_to) from turns(conv_id, turn[, part], role, text).

    One formatted piece for each turn, in order; a conversation's text is its pieces joined. The loss covers
    characters loss_from..loss_to-1 of a piece, an assistant's text. Turns are ordered by turn, part, role and text,
    nulls first; null role and text are empty; a turn that occurs twice is formatted twice. Records that
    canonical_turns() rejected are left out; other columns are ignored. A conversation's turns
    stream through one task in order, so a long one needs no memory.
    """
    names = ["conv_id", "turn_no", "formatted", "loss_from", "loss_to"]

    def run(batches):
        last, k = object(), 0
        for batch in batches:
            out = []
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                last, k = conv, k + 1 if conv == last else 0
                out.append((conv, k, *render(role or "", text or "")))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()])], names=names)

    return _sorted_turns(turns).mapInArrow(run, "conv_id long, turn_no long, formatted string, loss_from long, loss_to long")


def digest_formatted(pieces: DataFrame) -> DataFrame:
    """What formatted pieces hold, read back from them, one row for each conversation, in a stream over its pieces.

    pieces must be as format_turns() gives them: a conversation's pieces together and in order.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches):
        last, state = None, None

        def done():
            n, whole, chars, loss, length = state
            return last, n, whole.hexdigest(), chars, loss.hexdigest(), length

        for batch in batches:
            out = []
            for conv, piece, lo, hi in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_from", "loss_to"))):
                if state is None or conv != last:
                    if state is not None:
                        out.append(done())
                    last, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in read_back(piece):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                covered = unescape(piece[lo:hi])
                state[2] += len(covered)
                state[3].update(covered.encode())
                state[4] += len(piece)
            if out:
                yield batch_of(out)
        if state is not None:
            yield batch_of([done()])

    def batch_of(out):
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return pieces.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
