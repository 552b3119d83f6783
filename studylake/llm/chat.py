r"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole: for each turn `<|role|>\n`, the text, `<|end|>\n`. Control strings start with `<|`; inside roles and texts a
backslash becomes `\\`, `<|` becomes `<\|` and, in roles, a newline becomes `\n`, so no text can contain one, and unescaping gives the text back.
The rendering is encoded once with offsets; the sorted spans of the turns to learn from are intersected with the tokens' spans
by binary search. A token that reaches over a span's end is masked in with the part that lies inside.

Nulls: null texts and roles are empty, null turns come first; rows of one turn are ordered by role and text. A null conv_id is a conversation of its own. Empty texts
are turns with an empty span. Repeated rows are turns of their own. Very long texts are encoded whole. An empty table gives an empty result. Columns besides conv_id, turn, role, text are not read.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows
from .tokens import path_of, tokenizer

END = "<|end|>\n"
_TURN = re.compile(r"<\|([^\n]*)\|>\n(.*?)<\|end\|>\n", re.S)


def escape(text: str, line: bool = False) -> str:
    text = text.replace("\\", "\\\\").replace("<|", "<\\|")
    return text.replace("\n", "\\n") if line else text


def unescape(text: str, line: bool = False) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if line and m[1] == "n" else m[1], text, flags=re.S)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and each turn's text span in it."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"<|{escape(role, True)}|>\n", escape(text)
        at += len(head)
        spans.append((at, at + len(body)))
        out += [head, body, END]
        at += len(body) + len(END)
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    return [(unescape(m[1], True), unescape(m[2])) for m in _TURN.finditer(formatted)]


def masked(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indexes of the tokens that meet a span, and the part of each inside it (start, end). Offsets and spans are sorted."""
    tokens, low, high = [], [], []
    for a, b in spans:
        i, j = int(np.searchsorted(ends, a, "right")), int(np.searchsorted(starts, b, "left"))
        if a < b and i < j:
            tokens.append(np.arange(i, j))
            low.append(np.maximum(starts[i:j], a))
            high.append(np.minimum(ends[i:j], b))
    if not tokens:
        return (np.zeros(0, np.int64),) * 3
    return np.concatenate(tokens), np.concatenate(low), np.concatenate(high)


def format_conversations(rows: DataFrame, learn: str = "assistant", vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """conv_id, formatted, ids, loss_tokens, loss_starts, loss_ends, span_ends: the rendering, its ids, the tokens to learn from, the parts of them, and where each learnt turn ends."""
    turns = rows.select(rows["conv_id"].cast("long").alias("conv_id"), rows["turn"].cast("long").alias("turn"), *(F.coalesce(rows[c].cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    whole = whole.select("conv_id", F.transform("turns", lambda t: t["role"]).alias("roles"), F.transform("turns", lambda t: t["text"]).alias("texts"))

    def start():
        encode = tokenizer(path_of(vocabulary)).encode

        def body(batch):
            out = []
            for conv, roles, texts in batch:
                formatted, spans = render(list(zip(roles, texts, strict=True)))
                found = encode(formatted, add_special_tokens=False)
                offsets = np.array(found.offsets, np.int64).reshape(-1, 2)
                learnt = [s for s, role in zip(spans, roles, strict=True) if role == learn]
                tokens, low, high = masked(offsets[:, 0], offsets[:, 1], learnt)
                out.append((conv, formatted, found.ids, tokens.tolist(), low.tolist(), high.tolist(), [b for _, b in learnt]))
            return out

        return body

    return map_rows(whole, start, "conv_id long, formatted string, ids array<int>, loss_tokens array<int>, loss_starts array<int>, loss_ends array<int>, span_ends array<int>")


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_tokens, from the formatted output alone."""

    def start():
        def body(batch):
            out = []
            for conv, text, ids, low, high, stops in batch:
                turns = parse(text)
                sha = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode("utf-8", "surrogatepass")).hexdigest()
                loss, at, part, stops = [], 0, [], list(stops)
                # Tokens of one character share its span: each character counts once. A turn's escapes end with the turn; an empty turn ends where it starts.
                for a, b in zip(low, high, strict=True):
                    while stops and stops[0] <= a:
                        loss.append(unescape("".join(part)))
                        part = []
                        stops.pop(0)
                    if b > at:
                        part.append(text[max(at, a) : b])
                        at = b
                learnt = "".join([*loss, unescape("".join(part))])
                out.append((conv, len(turns), sha, len(learnt), hashlib.sha256(learnt.encode("utf-8", "surrogatepass")).hexdigest(), len(text), len(ids)))
            return out

        return body

    columns = formatted.select("conv_id", "formatted", "ids", "loss_starts", "loss_ends", "span_ends")
    return map_rows(columns, start, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long")
