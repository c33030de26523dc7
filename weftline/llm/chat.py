"""Chat formatting: whole conversations rendered, encoded once with offsets, loss masks aligned to turns.

A turn is rendered as ``<|role|>`` text ``<|end|>``. Control strings inside texts and roles are escaped by a
backslash, so the format reads back without loss. The markers are added tokens of the tokenizer, hence no token
straddles a turn's border; each token's mask comes from a binary search of its offsets in the sorted turn spans.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
OPEN, SHUT, END = "<|", "|>", "<|end|>"
ROLES = ("assistant", "system", "tool", "user")
MARKERS = [*(f"{OPEN}{r}{SHUT}" for r in ROLES), f"{OPEN}role:", SHUT, END]
_escape = re.compile(r"[\\|]")
_turn = re.compile(r"<\|(?:(assistant|system|tool|user)|role:([^|]*))\|>([^|]*)<\|end\|>")


def escape(text: str) -> str:
    """No ``|`` stays, so no marker can appear in a text: ``\\p`` stands for it, ``\\\\`` for a backslash."""
    return _escape.sub(lambda m: r"\\" if m[0] == "\\" else r"\p", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "|" if m[1] == "p" else m[1], text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation and the span of each turn's escaped text, in code points."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head = f"{OPEN}{role}{SHUT}" if role in ROLES else f"{OPEN}role:{escape(role)}{SHUT}"
        body = escape(text)
        parts += [head, body, END]
        spans.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation; ValueError if it isn't one."""
    turns, at = [], 0
    for m in _turn.finditer(formatted):
        if m.start() != at:
            raise ValueError(f"no turn at {at}")
        turns.append((m[1] if m[1] is not None else unescape(m[2]), unescape(m[3])))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"no turn at {at}")
    return turns


def load_tokenizer(path: str):  # noqa: ANN201
    """The public tokenizer with this template's markers added; their strings can't occur in escaped texts."""
    from tokenizers import AddedToken, Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.add_special_tokens([AddedToken(m, special=True, normalized=False) for m in MARKERS])
    return tokenizer


def token_mask(offsets: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Whether each token (start, end) overlaps one of the sorted, disjoint spans; empty tokens and spans never do."""
    if not len(spans) or not len(offsets):
        return np.zeros(len(offsets), bool)
    spans = spans[spans[:, 1] > spans[:, 0]]
    if not len(spans):
        return np.zeros(len(offsets), bool)
    at = np.searchsorted(spans[:, 1], offsets[:, 0], side="right")  # the first span that ends after the token starts
    inside = at < len(spans)
    return inside & (offsets[:, 1] > spans[np.minimum(at, len(spans) - 1), 0]) & (offsets[:, 1] > offsets[:, 0])


def masked_spans(offsets: np.ndarray, mask: np.ndarray) -> list[tuple[int, int]]:
    """The code points under the mask as sorted, disjoint spans; bytes of one character are several tokens of it."""
    spans: list[tuple[int, int]] = []
    for a, b in offsets[mask].tolist():
        if spans and a <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(b, spans[-1][1]))
        else:
            spans.append((a, b))
    return spans


SCHEMA = "conv_id long, formatted string, input_ids array<int>, token_start array<int>, token_end array<int>, loss_mask array<boolean>"


def format_conversations(conversations: DataFrame, tokenizer: str = TOKENIZER, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """A row per conv_id: the rendered text, its tokens with offsets in code points, and which of them count in the loss.

    Turns are ordered by turn, then role and text, so ties give one result; nulls of turn come first, a null role
    or text is empty. A row without conv_id belongs to no conversation that is known: it makes one of its own, with a
    null conv_id, however many such rows there are. Repeated rows are repeated turns. Very long texts are encoded whole;
    a conversation is one row. An empty table gives none. Other columns are not read. Roles beyond the known ones keep
    their name, escaped, in the marker.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    whole = rows.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    whole = whole.unionByName(rows.where("conv_id IS NULL").select("conv_id", F.array("t").alias("turns")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load_tokenizer(tokenizer)
        for batch in batches:
            for part in slices(batch, 64):
                talks = [[(t["role"], t["text"]) for t in turns] for turns in part.column("turns").to_pylist()]
                texts, spans = zip(*(render(t) for t in talks), strict=True) if talks else ((), ())
                ids, starts, ends, masks = [], [], [], []
                for talk, own, coded in zip(talks, spans, coder.encode_batch(list(texts), add_special_tokens=False), strict=True):
                    offsets = np.array(coded.offsets, np.int32).reshape(-1, 2)
                    counted = np.array([s for s, (role, _) in zip(own, talk, strict=True) if role in loss_roles], np.int32).reshape(-1, 2)
                    ids.append(coded.ids)
                    starts.append(offsets[:, 0])
                    ends.append(offsets[:, 1])
                    masks.append(token_mask(offsets, counted))
                yield pa.RecordBatch.from_arrays(
                    [part.column("conv_id"), pa.array(texts, pa.string()), pa.array(ids, pa.list_(pa.int32())), pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32())), pa.array(masks, pa.list_(pa.bool_()))],
                    ["conv_id", "formatted", "input_ids", "token_start", "token_end", "loss_mask"],
                )

    return whole.mapInArrow(run, SCHEMA)


def digest(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), all read back from the output."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 64):
                out = []
                for r in part.to_pylist():
                    turns = parse(r["formatted"])
                    offsets = np.array([r["token_start"], r["token_end"]], np.int64).T.reshape(-1, 2)
                    loss = unescape("".join(r["formatted"][a:b] for a, b in masked_spans(offsets, np.array(r["loss_mask"], bool))))
                    sha = hashlib.sha256("".join(f"{role}\n{text}\n" for role, text in turns).encode()).hexdigest()
                    out.append((r["conv_id"], len(turns), sha, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(r["formatted"])))
                columns = zip(*out, strict=True) if out else [[]] * 6
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: Two turns made of control strings, added to every run of the query.
HARD_TEXT = r"\### Assistant: </turn> ok"
HARD = [(-7, 0, "user", HARD_TEXT), (-7, 1, "assistant", HARD_TEXT)]

#: The same digest in DuckDB: lengths follow from the template, texts from the table.
ORACLE = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), escaped AS (
  SELECT *, length(text) + length(text) - length(replace(replace(text, '\', ''), '|', '')) AS body,
    CASE WHEN role IN ('assistant', 'system', 'tool', 'user') THEN length(role) + 4
      ELSE 2 * length(role) - length(replace(replace(role, '\', ''), '|', '')) + 9 END AS head
  FROM rows
)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(head + body + 7) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
"""
