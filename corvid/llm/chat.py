"""Chat formatting by a grammar round trip.

A conversation is rendered as ``<s>`` and its turns one after another; each turn opens and closes with control strings:

    system     <<SYS>>\\n text \\n<</SYS>>\\n\\n
    user       [INST] text [/INST]
    assistant  text</s>
    any other  [ROLE] role [TEXT] text [/ROLE]      (without the blanks)

Reading is deterministic: a scanner finds control strings from the left (none holds or overlaps another), and a state
machine accepts them in the grammar's places only. A backslash run of length m before a control string stands for m div 2
backslashes, and for the bare string where m is odd; all other backslashes stand for themselves.

1. Every turn is rendered as it is and read back. Where the reading isn't the source turn, the places at which the scanner
   took something in a text for a control string are escaped, and the turn is rendered again, until both are identical.
   A turn ends in a control string, so turns read alike alone and in a row; this work splits by row, not by conversation.
2. Conversations are put together in order of their turns, in parts of at most ``part_chars`` code points (or one turn),
   so that no row grows with its conversation. Each part has the spans of its text that the loss covers.
3. The parts are read back with the same machine, batch by batch; digests are over what was read.

The digest of a conversation is one pass over its turns in order, by its definition: a conversation streams through one
task, which holds a batch of it at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Control strings: what a conversation starts with, (open, close) by role, (open, middle, close) of all other roles, and the roles the loss covers."""

    start: str = "<s>"
    roles: dict[str, tuple[str, str]] = field(default_factory=lambda: {"system": ("<<SYS>>\n", "\n<</SYS>>\n\n"), "user": ("[INST] ", " [/INST]"), "assistant": ("", "</s>")})
    other: tuple[str, str, str] = ("[ROLE]", "[TEXT]", "[/ROLE]")
    loss: tuple[str, ...] = ("assistant",)

    @property
    def controls(self) -> list[str]:
        found = [self.start, *self.other, *[x.strip() for pair in self.roles.values() for x in pair]]
        return sorted({x for x in found if x})

    def __post_init__(self):
        bare = [r for r, (a, _) in self.roles.items() if not a]
        marks = [x.strip() for pair in self.roles.values() for x in pair if x]
        if len(bare) > 1 or any(not b for _, b in self.roles.values()) or len(marks + [self.start, *self.other]) != len(self.controls):
            raise ValueError("roles need control strings of their own, and one role at most may have no opening one")
        for a in self.controls:
            for b in self.controls:
                if (a != b and a in b) or any(a[k:] == b[: len(a) - k] for k in range(1, len(a))) or "\\" in a:
                    raise ValueError(f"control strings {a!r} and {b!r} can be confused")


class Grammar:
    """The scanner, the machine and the renderer of a template."""

    def __init__(self, template: Template):
        self.template = template
        self.token = re.compile(r"(\\*)(" + "|".join(map(re.escape, template.controls)) + ")")
        self.opens = {a.strip(): (role, a, b) for role, (a, b) in template.roles.items() if a}
        self.bare = next(((role, b) for role, (a, b) in template.roles.items() if not a), None)

    def plain(self, text: str) -> str:
        """A rendered text without its escapes."""
        return self.token.sub(lambda m: m[1][: len(m[1]) // 2] + m[2], text) if "\\" in text else text

    def read(self, text: str, first: bool = True) -> tuple[list[tuple[str, str, int, int]], int]:
        """Turns (role, text, start and end of the rendered text) up to the first control string out of place, and where that is (-1: none).

        ``first`` says whether the text opens the conversation.
        """
        turns, at, t = [], 0, self.template
        if first:
            if not text.startswith(t.start):
                return turns, 0
            at = len(t.start)
        marks = iter(m for m in self.token.finditer(text, at) if len(m[1]) % 2 == 0)
        while at < len(text):
            m = next(marks, None)
            if m is None:
                return turns, at
            begin, role = m.end(1), None
            if begin == at and m[2] in self.opens:
                role, a, b = self.opens[m[2]]
                if not text.startswith(a, at):
                    return turns, at
                body, m = at + len(a), next(marks, None)
                stop = m.end(1) - (len(b) - len(b.lstrip())) if m is not None and m[2] == b.strip() else -1
                if stop < body or not text.startswith(b, stop):
                    return turns, m.start(2) if m is not None else at
                end = stop + len(b)
            elif begin == at and m[2] == t.other[0]:
                middle, last = next(marks, None), next(marks, None)
                if middle is None or last is None or middle[2] != t.other[1] or last[2] != t.other[2]:
                    return turns, m.end()
                role, body, stop, end = self._half(text, m.end(), middle.end(1)), middle.end(), last.end(1), last.end()
            elif self.bare and m[2] == self.bare[1].strip() and text.startswith(self.bare[1], begin - (len(self.bare[1]) - len(self.bare[1].lstrip()))):
                role, body, stop = self.bare[0], at, begin - (len(self.bare[1]) - len(self.bare[1].lstrip()))
                end = stop + len(self.bare[1])
            else:
                return turns, begin
            turns.append((role, self._half(text, body, stop), body, stop))
            at = end
        return turns, -1

    def _half(self, text: str, start: int, stop: int) -> str:
        """The source of text[start:stop]; backslashes before the control string that follows it are halved, too."""
        found = text[start:stop]
        n = len(found) - len(found.rstrip("\\"))
        if n and self.token.match(text, stop):
            found = found[: len(found) - n // 2]
        return self.plain(found)

    def escaped(self, text: str, places: set[int], closing: bool) -> str:
        """``text`` with the control strings at ``places`` escaped, and its last backslashes doubled where they touch the closing string."""
        if places:
            text = self.token.sub(lambda m: m[1] + m[1] + "\\" + m[2] if m.start(2) in places else m[0], text)
        n = len(text) - len(text.rstrip("\\")) if closing else 0
        return text + "\\" * n

    def render(self, role: str, text: str) -> tuple[str, int, int, int]:
        """The turn as rendered, the span of its text, and how many rounds it took.

        A round renders and reads; if the reading differs, the next one escapes the control strings that the scanner
        finds in the sources and hasn't escaped yet, and doubles backslashes that touch a closing string.
        """
        t, marked, closing, rounds = self.template, {}, False, 0
        while True:
            rounds += 1
            body = self.escaped(text, marked.get("text", set()), closing)
            if role in t.roles:
                head, tail = t.roles[role]
            else:
                head, tail = t.other[0] + self.escaped(role, marked.get("role", set()), closing) + t.other[1], t.other[2]
            out = head + body + tail
            turns, wrong = self.read(out, first=False)
            if wrong < 0 and len(turns) == 1 and turns[0][:2] == (role, text):
                return out, turns[0][2], turns[0][3], rounds
            found = {name: {m.start(2) for m in self.token.finditer(source)} for name, source in (("text", text), ("role", role))}
            if found == marked and closing:
                raise ValueError(f"the template can't carry a turn of role {role!r}")
            closing, marked = found == marked or not any(found.values()) or closing, found


def _rendered(template: Template):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(template)
        for batch in batches:
            roles = batch.column(2).to_pylist()
            found = [grammar.render(r, t) for r, t in zip(roles, batch.column(3).to_pylist())]
            start, end = ([x[k] if r in template.loss else 0 for r, x in zip(roles, found)] for k in (1, 2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array([x[0] for x in found], pa.string()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array([x[3] for x in found], pa.int32())], ["conv_id", "turn", "role", "segment", "start", "end", "rounds"])

    return run


PARTS = "conv_id long, part long, text string, loss array<struct<start: long, end: long>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _parts(start: str, part_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        now, part, pieces, spans, size = (), 0, [], [], 0

        def close() -> None:
            if pieces:
                done.append((now[0], part, "".join(pieces), spans))

        for batch in batches:
            for conv, segment, a, b in zip(*(batch.column(k).to_pylist() for k in (0, 3, 4, 5))):
                if now != (conv,):
                    close()
                    now, part, pieces, spans, size = (conv,), 0, [start], [], len(start)
                elif size + len(segment) > part_chars:
                    close()
                    part, pieces, spans, size = part + 1, [], [], 0
                if b > a:
                    spans.append({"start": size + a, "end": size + b})
                pieces.append(segment)
                size += len(segment)
                if sum(len(x[2]) for x in done) > part_chars:
                    yield _batch(done)
                    done = []
        close()
        if done:
            yield _batch(done)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], _SPANS)], ["conv_id", "part", "text", "loss"])

    return run


def _digests(template: Template):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar, now, out = Grammar(template), (), []
        turns = loss = None
        n = chars = loss_chars = 0
        for batch in batches:
            for conv, text, spans in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3))):
                if first := now != (conv,):
                    if now:
                        out.append((*now, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
                    now, turns, loss, n, chars, loss_chars = (conv,), hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                found, wrong = grammar.read(text, first)
                if wrong >= 0:
                    raise ValueError(f"conversation {conv}: no turn at {wrong}")
                for role, said, _, _ in found:
                    turns.update(f"{role}\n{said}\n".encode())
                for s in spans:
                    said = grammar._half(text, s["start"], s["end"])
                    loss.update(said.encode())
                    loss_chars += len(said)
                n, chars = n + len(found), chars + len(text)
            if len(out) > 10_000:
                yield _batch(out)
                out = []
        if now:
            out.append((*now, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
            yield _batch(out)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return run


def render_turns(rows: DataFrame, template: Template | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Each row rendered alone: conv_id, turn, role, segment, start and end of the loss in it (both 0: none), rounds."""
    x = rows.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return x.mapInArrow(_rendered(template or Template()), "conv_id long, turn long, role string, segment string, start long, end long, rounds int")


def format_conversations(rows: DataFrame, template: Template | None = None, part_chars: int = 1 << 20, **columns) -> DataFrame:
    """Rows (conv_id, part, text, loss): the conversations rendered, in parts that follow one another by number.

    Turns go by ``turn``, null ones first, equal ones by role and then by what they are rendered as; repeated rows are
    turns of their own. Null texts and roles are empty ones, rows with a null conv_id are one conversation. A text may
    have any length; it is never cut. Other columns are ignored, whatever their names. No rows give no rows.
    """
    template = template or Template()
    x = render_turns(rows, template, **columns).drop("rounds").repartition("conv_id").sortWithinPartitions(F.col("conv_id"), F.col("turn"), F.col("role"), F.col("segment"))
    return x.mapInArrow(_parts(template.start, part_chars), PARTS)


def read_back(parts: DataFrame, template: Template | None = None, in_order: bool = False) -> DataFrame:
    """One row per conversation, from its parts alone: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    ``in_order`` says that the parts come as :func:`format_conversations` made them, so that they need no shuffle.
    """
    if not in_order:
        parts = parts.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return parts.mapInArrow(_digests(template or Template()), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def chat_digests(rows: DataFrame, template: Template | None = None, part_chars: int = 1 << 20, **columns) -> DataFrame:
    """:func:`read_back` of :func:`format_conversations`."""
    return read_back(format_conversations(rows, template, part_chars, **columns), template, in_order=True)


ORACLE_SQL = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
escaped AS (
  SELECT *, regexp_replace(role, '(\\*)(<s>|</s>|<<SYS>>|<</SYS>>|\[INST\]|\[/INST\]|\[ROLE\]|\[TEXT\]|\[/ROLE\])', '\1\1\\\2', 'g') AS r,
    regexp_replace(text, '(\\*)(<s>|</s>|<<SYS>>|<</SYS>>|\[INST\]|\[/INST\]|\[ROLE\]|\[TEXT\]|\[/ROLE\])', '\1\1\\\2', 'g') AS t FROM said),
rendered AS (
  SELECT *, CASE role
    WHEN 'system' THEN '<<SYS>>' || chr(10) || t || chr(10) || '<</SYS>>' || chr(10) || chr(10)
    WHEN 'user' THEN '[INST] ' || t || ' [/INST]'
    WHEN 'assistant' THEN regexp_replace(t, '(\\+)$', '\1\1') || '</s>'
    ELSE '[ROLE]' || regexp_replace(r, '(\\+)$', '\1\1') || '[TEXT]' || regexp_replace(t, '(\\+)$', '\1\1') || '[/ROLE]' END AS segment FROM escaped)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, segment)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, segment) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(length(segment)))::BIGINT AS formatted_chars
FROM rendered GROUP BY conv_id
"""
