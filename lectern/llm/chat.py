"""Chat formatting: a finite-state machine over roles, a declarative template, segments with loss flags."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEGMENTS = ("conv_id long, turn_no long, segment int, kind string, text string, loss boolean, state string, "
            "valid boolean")


@dataclass(frozen=True)
class Template:
    """How a turn is written: ``open`` role ``middle`` text ``close``. Roles in ``loss_roles`` are trained on.

    ``moves`` is the state machine: the roles that may follow each role (``start`` is the beginning), ``final`` the
    roles a conversation may end with. Control strings inside roles and texts get ``escape`` after their first
    character, once more than they already have there; reading takes one away, so any text comes back unchanged.
    """

    open: str = "<|im_start|>"
    middle: str = "<|im_sep|>"
    close: str = "<|im_end|>\n"
    escape: str = "\\"
    loss_roles: frozenset[str] = frozenset({"assistant"})
    moves: dict[str, frozenset[str]] = field(default_factory=lambda: {
        "start": frozenset({"system", "user"}), "system": frozenset({"user"}),
        "user": frozenset({"assistant"}), "assistant": frozenset({"user"})})
    final: frozenset[str] = frozenset({"assistant"})

    def __post_init__(self):
        marks = self.controls
        if len(self.escape) != 1 or any(len(m) < 2 or self.escape in m for m in marks):
            raise ValueError("control strings need two characters and none may hold the escape character")
        for a, b in product(marks, marks):
            if a != b and a in b or any(a.endswith(b[:k]) for k in range(1, len(b)) if not (a == b and k == len(b))):
                raise ValueError("control strings must not overlap or hold one another")

    @property
    def controls(self) -> list[str]:
        return [m.strip("\n") for m in (self.open, self.middle, self.close)]

    def _pattern(self, least: int) -> re.Pattern:
        e = re.escape(self.escape)
        return re.compile("|".join(f"(?<={re.escape(m[0])}){e}{{{least},}}(?={re.escape(m[1:])})" for m in self.controls))

    def escaped(self, text: str) -> str:
        return self._pattern(0).sub(lambda m: m.group() + self.escape, text)

    def unescaped(self, text: str) -> str:
        return self._pattern(1).sub(lambda m: m.group()[1:], text)

    def segments(self, role: str, text: str) -> list[tuple[str, str, bool]]:
        """(kind, text, loss) of one turn, in order."""
        return [("head", f"{self.open}{self.escaped(role)}{self.middle}", False),
                ("text", self.escaped(text), role in self.loss_roles), ("tail", self.close, False)]

    def parse(self, formatted: str) -> list[tuple[str, str]]:
        """(role, text) of every turn of a formatted conversation: the inverse of formatting."""
        turns = []
        for part in formatted.split(self.close)[:-1]:
            role, text = part.removeprefix(self.open).split(self.middle)
            turns.append((self.unescaped(role), self.unescaped(text)))
        return turns


def format_turns(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """``turns(conv_id, turn, role, text)`` as rows of text segments with loss flags, in order.

    The rows of a conversation are brought to one partition and sorted there by turn (null first), role and text; they
    are then read as a stream, holding one turn at a time, so a conversation of any length fits. ``valid`` says whether
    the turns up to here follow the state machine (``state`` is the last role); nothing is dropped for it. Null roles
    and texts are empty, a null ``conv_id`` is a conversation of its own, repeated rows are turns of their own.
    """
    sent = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
                        F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, state, number, valid, begun = None, "start", 0, True, False
        for batch in batches:
            out = []
            for key, role, text in zip(batch["conv_id"].astype("Int64"), batch["role"], batch["text"]):
                key = None if pd.isna(key) else int(key)
                if not begun or key != conv:
                    conv, state, number, valid, begun = key, "start", 0, True, True
                valid = valid and role in template.moves.get(state, ())
                state = role
                for i, (kind, part, loss) in enumerate(template.segments(role, text)):
                    out.append((conv, number, i, kind, part, loss, state, valid))
                number += 1
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SEGMENTS.split(", ")]).astype({"conv_id": "Int64"})

    return (sent.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
            .mapInPandas(run, SEGMENTS))


def read_back(segments: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per conversation, read from the formatted text: number of turns, digests, lengths, validity.

    Takes the output of ``format_turns`` in its order and partitions (no shuffle). Each formatted turn is parsed again;
    the loss digest is made of the unescaped segments under the loss mask.
    """
    schema = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
              "formatted_chars long, valid boolean")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, begun, pending = None, False, ""
        n = loss_chars = chars = 0
        turns, loss, valid, state = hashlib.sha256(), hashlib.sha256(), True, "start"
        for batch in batches:
            out = []
            for key, kind, text, masked, last, ok in zip(batch["conv_id"].astype("Int64"), batch["kind"], batch["text"],
                                                         batch["loss"], batch["state"], batch["valid"]):
                key = None if pd.isna(key) else int(key)
                if begun and key != conv:
                    out.append((conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars,
                                valid and state in template.final))
                if not begun or key != conv:
                    conv, begun, pending, n, loss_chars, chars = key, True, "", 0, 0, 0
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                pending += text
                chars += len(text)
                valid, state = ok, last
                if masked:
                    plain = template.unescaped(text)
                    loss_chars += len(plain)
                    loss.update(plain.encode())
                if kind == "tail":
                    for role, said in template.parse(pending):
                        turns.update(f"{role}\n{said}\n".encode())
                        n += 1
                    pending = ""
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")]).astype({"conv_id": "Int64"})
        if begun:
            yield pd.DataFrame([(conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars,
                                 valid and state in template.final)],
                               columns=[c.split()[0] for c in schema.split(", ")]).astype({"conv_id": "Int64"})

    return segments.mapInPandas(run, schema)
