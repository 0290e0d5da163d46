"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) turns to a string. Successive turn prefixes are rendered, and
what a rendering adds to the one before is the span of its last turn. If the earlier rendering is no prefix of the
later one, the template has rewritten history: the turn is marked, and its span begins where the two part. Where the
text stands inside a span is found in the same way, by rendering the turn with two texts that differ in all letters.

The rows of a conversation pass in order through one stream. A template may look at any earlier turn, so all turns of
the conversation are held and each prefix is rendered whole, with every template, also the one here: memory grows with
the conversation, work with its square. Only where the caller declares a template of theirs to be context-free (what it
gives for a list is what it gives for each turn, one after the other) no earlier turn is held or rendered again.

The template here marks turns with ``<|im_start|>`` and ``<|im_end|>``. In texts and roles a backslash more is put between
``<`` and ``|`` wherever only backslashes stand between them, so no text holds a control string, and taking one away
gives the text back. Null roles and texts are empty. Turns of equal number go by role, then text; repeated rows are turns of
their own. Rows without a conversation id are one conversation. An empty table has no conversations.
"""

import hashlib
import re
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.rows import fields

LOSS_ROLE = "assistant"
START, END = "<|im_start|>", "<|im_end|>\n"  # fixed values of the format

_OPEN, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<(\\*)\\\|")
_TURN = re.compile(re.escape(START) + r"(.*)\n((?s:.*))" + re.escape(END))


def escape(text: str) -> str:
    return _OPEN.sub(r"<\1\\|", text) if "|" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text) if "|" in text else text


def _one_line(role: str) -> str:
    return escape(role).replace("\\", "\\\\").replace("\n", "\\n")


def _role(line: str) -> str:
    return unescape(re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], line))


def render(turns: list) -> str:
    """The template: ``turns`` are (role, text) pairs."""
    return "".join([f"{START}{_one_line(role)}\n{escape(text)}{END}" for role, text in turns])


def parse(span: str):
    """(role, text) of one formatted turn."""
    found = _TURN.fullmatch(span)
    return _role(found[1]), unescape(found[2])


class Locator:
    """Locates the spans of one conversation's turns, one after the other, from renderings of all its prefixes."""

    def __init__(self, template, context_free=False):
        self._template, self._turns, self._before, self._passed = template, [], "", 0
        self._context_free = context_free

    def add(self, role: str, text: str, masked: bool):
        """(span, start and end of the text in the span if ``masked``, whether history was rewritten, where the span
        begins in the rendering of all turns so far)."""
        turns = [*self._turns, (role, text)]
        now = self._template(turns)
        begin, rewritten = len(self._before), not now.startswith(self._before)
        if rewritten:
            begin = len(commonprefix([self._before, now]))
        body = self._text_in(turns, now, begin) if masked else (None, None)
        at = self._passed + begin
        if self._context_free:
            self._passed += len(now)
        else:
            self._turns, self._before = turns, now
        return now[begin:], *body, rewritten, at

    def _text_in(self, turns, now, begin):
        role, _ = turns[-1]
        a, b = (self._template([*turns[:-1], (role, letter)]) for letter in "AB")
        head = len(commonprefix([a, b]))
        tail = len(a) - head - 1
        return max(head - begin, 0), max(len(now) - tail - begin, 0)


def _ordered(conversations: DataFrame) -> DataFrame:
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
                                F.coalesce("text", F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


FORMATTED = fields(conv_id="bigint", position="bigint", role="string", begin="bigint", formatted="string",
                   loss_begin="bigint", loss_end="bigint", rewritten="boolean")
_ROWS = 256


def _batches(rows, schema, size=_ROWS):
    """Rows as Arrow batches of at most ``size``."""
    names, held = [f.name for f in schema.fields], []
    kinds = {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    made = pa.schema([(f.name, kinds[f.dataType.simpleString()]) for f in schema.fields])
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in held], made)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in held], made)


def _rows(batches, size=_ROWS):
    for batch in batches:
        for lo in range(0, batch.num_rows, size):
            yield from zip(*[c.to_pylist() for c in batch.slice(lo, size).columns])


def format_turns(conversations: DataFrame, template=render, loss_role=LOSS_ROLE, context_free=False) -> DataFrame:
    """One row per turn, a conversation's rows together and in order: its ``position`` from 0, its ``formatted`` span,
    where that begins in the rendering of all turns up to it, and from where to where (in that rendering) the loss mask
    reaches. Unless a later turn is marked as rewritten, these are the places in the conversation's whole.

    ``context_free`` declares that the template renders turns one by one, so that prefixes need not be rendered. ``conversations`` has ``conv_id, turn, role, text``; other columns are left out. Positions are in code points.
    """
    def run(batches):
        def turns():
            conv, locator, position = object(), None, 0
            for conv_id, _, role, text in _rows(batches):
                if conv_id != conv:
                    conv, locator, position = conv_id, Locator(template, context_free), 0
                span, begin, end, rewritten, at = locator.add(role, text, role == loss_role)
                yield (conv_id, position, role, at, span, None if begin is None else at + begin,
                       None if end is None else at + end, rewritten)
                position += 1

        yield from _batches(turns(), FORMATTED)

    return _ordered(conversations).mapInArrow(run, FORMATTED)


DIGESTS = fields(conv_id="bigint", n_turns="bigint", turns_sha256="string", loss_chars="bigint", loss_sha256="string",
                 formatted_chars="bigint", rewritten_turns="bigint")


def digests(formatted: DataFrame) -> DataFrame:
    """One row per conversation, read back from what ``format_turns`` returned (as it returned it: the rows of a
    conversation follow one another in one partition)."""
    def run(batches):
        def conversations():
            conv, state = object(), None
            for conv_id, _, _, begin, span, loss_begin, loss_end, rewritten in _rows(batches):
                if conv_id != conv:
                    if state:
                        yield _digest(conv, state)
                    conv, state = conv_id, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                role, text = parse(span)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                if loss_begin is not None:
                    masked = unescape(span[loss_begin - begin:loss_end - begin])
                    state[2] += len(masked)
                    state[3].update(masked.encode())
                state[4] += len(span)
                state[5] += rewritten
            if state:
                yield _digest(conv, state)

        yield from _batches(conversations(), DIGESTS)

    return formatted.mapInArrow(run, DIGESTS)


def _digest(conv, state):
    return conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5]
