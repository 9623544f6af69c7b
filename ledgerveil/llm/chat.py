"""Chat formatting by a finite-state machine over roles and a declarative template."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerveil.llm.text import map_arrow


@dataclass(frozen=True)
class Template:
    """How turns are written, which roles may follow which, and whose texts carry loss.

    ``opening`` holds ``{role}``. Role names are escaped like texts, so any role can be read back. ``escaped`` are the
    characters that start a control string; inside texts they and the escape character are preceded by ``escape``.
    """

    opening: str = "### {role}: "
    closing: str = " </turn>\n"
    escape: str = "\\"
    escaped: str = "#<:"
    start: str = ""
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    accepting: tuple[str, ...] = ("assistant",)
    loss_roles: tuple[str, ...] = ("assistant",)

    def quote(self, text: str) -> str:
        out = text.replace(self.escape, self.escape * 2)
        for c in self.escaped:
            out = out.replace(c, self.escape + c)
        return out

    def unquote(self, text: str) -> str:
        return re.sub(re.escape(self.escape) + "(.)", r"\1", text, flags=re.S)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """(text, loss flag) pieces of one turn: opening, escaped text, closing."""
        return [(self.opening.replace("{role}", self.quote(role)), False), (self.quote(text), role in self.loss_roles), (self.closing, False)]

    def pattern(self) -> re.Pattern[str]:
        """Matches one formatted turn; groups are the role and the text, both escaped."""
        body = f"((?:[^{re.escape(self.escaped + self.escape)}]|{re.escape(self.escape)}.)*)"
        before, after = self.opening.split("{role}")
        return re.compile(re.escape(before) + body + re.escape(after) + body + re.escape(self.closing), re.S)


class Machine:
    """Validates the order of roles of one conversation, turn by turn."""

    def __init__(self, template: Template) -> None:
        self.template, self.state, self.fault = template, template.start, None

    def see(self, role: str, n: int) -> None:
        if self.fault is None and role not in self.template.follows.get(self.state, ()):
            self.fault = f"turn {n}: {role or 'no role'} after {self.state or 'start'}"
        self.state = role

    def verdict(self) -> str | None:
        if self.fault is None and self.state not in self.template.accepting:
            return f"ends with {self.state or 'nothing'}"
        return self.fault


def turns(conversations: DataFrame, template: Template | None = None, *, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, turn, role, formatted, segments): every turn as it stands in the output, with per-segment loss flags.

    Null roles and texts are empty. Each turn is formatted by itself; a conversation is the concatenation of its turns.
    """
    template = template or Template()
    rows = conversations.select(F.col(key).alias("key"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def write(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            made = [template.segments(r, t) for r, t in zip(b["role"], b["text"])]
            yield b | {"formatted": ["".join(s for s, _ in m) for m in made], "segments": [[{"text": s, "loss": f} for s, f in m] for m in made]}

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return map_arrow(rows, write, f"key {kinds['key']}, turn {kinds['turn']}, role string, text string, formatted string, segments array<struct<text: string, loss: boolean>>")


def conversations(table: DataFrame, template: Template | None = None, *, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Per conversation, read back from its formatted turns: what it holds, under the loss mask and in all.

    Columns: ``key``, n_turns, turns_sha256 (role, newline, text, newline per turn), loss_chars, loss_sha256 (unescaped
    text under the loss mask), formatted_chars, fault (null if the machine accepts the order of roles).

    Turns are taken by (turn, role, formatted text), so ties and repeated rows have a fixed order and all count; null turns come
    first. Rows with a null key form one conversation. The turns of a conversation stream through one task in order, as
    its digests ask for, and are never held together. Other columns are ignored; no rows give no conversations.
    """
    template = template or Template()
    pattern = template.pattern()
    rows = turns(table, template, key=key, turn=turn, role=role, text=text)
    rows = rows.select("key", "turn", "role", "formatted", F.transform("segments", lambda s: s["loss"]).alias("loss"))
    rows = rows.repartition("key").sortWithinPartitions("key", "turn", "role", "formatted")

    def read(batches: Iterator[dict]) -> Iterator[dict]:
        names = ("key", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "fault")
        open_: list = []
        for b in batches:
            out: list[tuple] = []
            for key, role, formatted, loss in zip(b["key"], b["role"], b["formatted"], b["loss"]):
                if not open_ or open_[0] != key:
                    if open_:
                        out.append(closed(open_))
                    open_ = [key, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, Machine(template)]
                found = pattern.fullmatch(formatted)
                text = template.unquote(found[2])
                open_[1] += 1
                open_[2].update(f"{template.unquote(found[1])}\n{text}\n".encode("utf-8", "surrogatepass"))
                if loss[1]:
                    open_[3] += len(text)
                    open_[4].update(text.encode("utf-8", "surrogatepass"))
                open_[5] += len(formatted)
                open_[6].see(role, open_[1])
            if out:
                yield dict(zip(names, map(list, zip(*out))))
        if open_:
            yield {n: [v] for n, v in zip(names, closed(open_))}

    def closed(o: list) -> tuple:
        return o[0], o[1], o[2].hexdigest(), o[3], o[4].hexdigest(), o[5], o[6].verdict()

    kind = rows.schema["key"].dataType.simpleString()
    out = map_arrow(rows, read, f"key {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, fault string")
    return out.withColumnRenamed("key", key)
