"""Chat formatting by incremental black-box rendering.

A template is only called, never looked into: ``render(turns)`` returns the formatted text of
a list of (role, text).  Rendering successive prefixes of a conversation and comparing
consecutive outputs locates each turn's span: it is what the output grew by.  Where an output
doesn't start with the one before, the template has rewritten history; then spans come
from the final output alone.  Inside its span a turn's text lies between what two probe texts leave
unchanged on either side.

A longer conversation than ``WINDOW`` turns is rendered in windows that overlap, if the overlap renders
alike in both (else from the start): O(n) renders of at most ``WINDOW`` turns.  A template that depends on more
turns than a window has is found by ``whole_prefixes``, which the operator sets: every prefix
is rendered once as it is and must be what the windows gave, else all is done from the start.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
WINDOW, OVERLAP = 64, 4
#: Probe texts without a common first or last character.
PROBES = ("qaz", "wsx")


class MarkedTemplate:
    """User turns in [INST] marks, assistant turns closed by </s>, any other role named before its text.

    Control strings inside roles and texts get a backslash after their first character, and one more
    if backslashes stand there already; ``unescape`` takes one away.  So texts hold no mark, and
    every text can be read back."""

    MARKS = ("[INST]", "[/INST]", "</s>", "<<ROLE>>", "<</ROLE>>")

    def __init__(self):
        body = "|".join(f"(?<={re.escape(m[0])}){{}}(?={re.escape(m[1:])})" for m in self.MARKS)
        self._put = re.compile(body.replace("{}", r"\\*"))
        self._take = re.compile(body.replace("{}", r"\\+"))

    def escape(self, text: str) -> str:
        return self._put.sub(lambda m: "\\" + m[0], text)

    def unescape(self, text: str) -> str:
        return self._take.sub(lambda m: m[0][1:], text)

    def render(self, turns: list[Turn]) -> str:
        out = []
        for role, text in turns:
            text = self.escape(text)
            if role == "user":
                out.append(f"[INST] {text} [/INST]")
            elif role == "assistant":
                out.append(f" {text}</s>")
            else:
                out.append(f"<<ROLE>>{self.escape(role)}<</ROLE>>{text}</s>")
        return "".join(out)

    def read_role(self, before: str) -> str:
        """Role of a turn from what its span holds before the text."""
        if before.startswith("<<ROLE>>"):
            return self.unescape(before[len("<<ROLE>>"):-len("<</ROLE>>")])
        return "user" if before.startswith("[INST]") else "assistant"


@dataclass
class Formatted:
    text: str = ""
    #: per turn (start, end, text start, text end); None where the output doesn't show the turn
    spans: list[tuple[int, int, int, int] | None] = field(default_factory=list)
    #: turns whose rendering changed what stood before
    rewrites: list[int] = field(default_factory=list)


def _alike(a: str, b: str) -> int:
    """Length of the common beginning."""
    lo, hi = 0, min(len(a), len(b))
    if a[:hi] == b[:hi]:
        return hi
    while lo < hi:  # a[:lo] is common, a[:hi + 1] isn't
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def _between(render: Callable, turns: list[Turn], k: int) -> tuple[int, int]:
    """(characters before, characters after) turn k's text in the rendering of ``turns``."""
    with_probe = [render([*turns[:k], (turns[k][0], p), *turns[k + 1:]]) for p in PROBES]
    return _alike(*with_probe), _alike(with_probe[0][::-1], with_probe[1][::-1])


def _grown(render: Callable, turns: list[Turn], done: int) -> Formatted | None:
    """Spans of the turns from ``done`` on by successive prefixes; None as soon as history changes."""
    out = Formatted(render(turns[:done]) if done else "")
    for k in range(done, len(turns)):
        now = render(turns[:k + 1])
        if not now.startswith(out.text):
            out.rewrites.append(k)
            return out
        before, after = _between(render, turns[:k + 1], k)
        out.spans.append((len(out.text), len(now), before, len(now) - after))
        out.text = now
    return out


def format_turns(render: Callable[[list[Turn]], str], turns: list[Turn], whole_prefixes: bool = False) -> Formatted:
    """Format one conversation; an empty one is what the template makes of no turns, without spans.
    With ``whole_prefixes`` what windows gave is compared with the rendering of every longer prefix."""
    if not turns:
        return Formatted(render([]))
    first = _grown(render, turns[:WINDOW], 0)
    whole = first
    at = WINDOW
    while at < len(turns) and not whole.rewrites:
        part = turns[at - OVERLAP:at + WINDOW - OVERLAP]
        more = _grown(render, part, 1)
        # the overlap must look the same from here as it did from the window before
        old = [whole.text[s:e] for s, e, _, _ in whole.spans[at - OVERLAP + 1:at]]
        new = [more.text[s:e] for s, e, _, _ in more.spans[:OVERLAP - 1]]
        if more.rewrites or old != new:
            whole = _grown(render, turns, 0)
            break
        shift = len(whole.text) - more.spans[OVERLAP - 2][1]
        whole.spans += [(s + shift, e + shift, a + shift, b + shift) for s, e, a, b in more.spans[OVERLAP - 1:]]
        whole.text += more.text[more.spans[OVERLAP - 2][1]:]
        at += WINDOW - OVERLAP
    else:
        if whole_prefixes and not whole.rewrites and any(render(turns[:k + 1]) != whole.text[:whole.spans[k][1]] for k in range(WINDOW, len(turns))):
            whole = _grown(render, turns, 0)
    if not whole.rewrites:
        return whole
    # history changes: every turn's text is located in the final output, by exchanging it alone
    out = Formatted(render(turns), [], [])
    was = ""
    for k in range(len(turns)):
        now = render(turns[:k + 1])
        if not now.startswith(was):
            out.rewrites.append(k)
        was = now
        before, after = _between(render, turns, k)
        shown = before + after <= len(out.text) and before < len(render([*turns[:k], (turns[k][0], PROBES[0]), *turns[k + 1:]]))
        out.spans.append((before, len(out.text) - after, before, len(out.text) - after) if shown else None)
    return out


SPANS = "array<struct<start:bigint,end:bigint,text_start:bigint,text_end:bigint,loss:boolean>>"


def format_conversations(rows: DataFrame, template=None, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, spans (in turn order), rewrites.

    ``rows``: conv_id, turn, role, text; others are ignored.  Turns go by number, null last; equal numbers
    by role and text, so repeated rows stay as turns of their own.  Null role and text are empty; rows
    with a null conv_id form one conversation.  An empty table gives an empty result.  Rows are dealt by
    conversation and read in order; a conversation is one output text, so its turns meet in one task."""
    template = template or MarkedTemplate()
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    said = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    said = said.repartition(parts, "conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_last(), "role", "text")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        ready: list = []

        def out(kind):
            conv = pa.array([c for c, _, _ in ready], kind)
            spans = [[None if s is None else {"start": s[0], "end": s[1], "text_start": s[2], "text_end": s[3], "loss": turn[0] in loss_roles}
                      for s, turn in zip(f.spans, turns, strict=True)] for _, turns, f in ready]
            shape = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("text_start", pa.int64()), ("text_end", pa.int64()), ("loss", pa.bool_())]))
            got = pa.RecordBatch.from_arrays([conv, pa.array([len(t) for _, t, _ in ready], pa.int64()), pa.array([f.text for _, _, f in ready], pa.string()),
                                              pa.array(spans, shape), pa.array([f.rewrites for _, _, f in ready], pa.list_(pa.int64()))],
                                             ["conv_id", "n_turns", "formatted", "spans", "rewrites"])
            ready.clear()
            return got

        held, turns, kind, size = None, [], None, 0
        for batch in batches:
            kind = batch.column("conv_id").type
            for c, role, text in zip(*[batch.column(x).to_pylist() for x in ("conv_id", "role", "text")], strict=True):
                if turns and c != held:
                    ready.append((held, turns, format_turns(template.render, turns, whole_prefixes=True)))
                    size, turns = size + len(ready[-1][2].text), []
                    if size > 4 << 20:
                        yield out(kind)
                        size = 0
                held = c
                turns.append((role, text))
        if turns:
            ready.append((held, turns, format_turns(template.render, turns, whole_prefixes=True)))
        if ready:
            yield out(kind)

    kind = rows.schema["conv_id"].dataType.simpleString()
    return said.select("conv_id", "role", "text").mapInArrow(run, f"conv_id {kind}, n_turns bigint, formatted string, spans {SPANS}, rewrites array<bigint>")


def read_back(formatted: DataFrame, template=None) -> DataFrame:
    """Digests of what the formatted texts and their spans say, without a look at the input."""
    template = template or MarkedTemplate()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            cols: list[list] = [[] for _ in range(5)]
            for text, spans in zip(batch.column("formatted").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                turns, loss = hashlib.sha256(), []
                for s in spans:
                    body = template.unescape(text[s["text_start"]:s["text_end"]])
                    turns.update(f"{template.read_role(text[s['start']:s['text_start']])}\n{body}\n".encode("utf-8", "surrogatepass"))
                    if s["loss"]:
                        loss.append(body)
                under = "".join(loss)
                for c, v in zip(cols, (len(spans), turns.hexdigest(), len(under), hashlib.sha256(under.encode("utf-8", "surrogatepass")).hexdigest(), len(text)), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *[pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)]],
                                             ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.select("conv_id", "formatted", "spans").mapInArrow(
        run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
