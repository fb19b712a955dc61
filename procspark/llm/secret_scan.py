"""Secrets in texts through a trigram inverted index.

Every rule is a regular expression. From its parse tree follows a Boolean query over the trigrams that any match
must contain; rules without such trigrams scan every text. The index is cut by documents: each block of rows has its own
postings (trigram -> rows), so nothing is shuffled, a frequent trigram is never one key for all rows, and a
candidate's text is at hand for the check with the real expression.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache
from itertools import product
from re import _constants as op
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from procspark.llm.common import arrow_map, only

Query = tuple  # ("all",) | ("tri", bytes) | ("and", Query, ...) | ("or", Query, ...)
ALL: Query = ("all",)
FEW = 64  # strings followed through a product before they are judged


@dataclass(frozen=True)
class Rule:
    """``least``: shortest length of ``group``; ``base`` rules come first among spans that start together."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    any_case: bool = False
    base: bool = False

    @property
    def regex(self) -> re.Pattern:
        return _compiled(self.pattern, self.any_case)


@cache
def _compiled(pattern: str, any_case: bool) -> re.Pattern:
    return re.compile(pattern.encode(), re.IGNORECASE if any_case else 0)  # on bytes only ASCII letters have two cases


# The three base kinds, then public formats of well-known keys.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2, True, True),
    Rule("access", r"AKIA[A-Z0-9]+", 16, 0, False, True),
    Rule("hex", r"[0-9a-f]+", 32, 0, False, True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 39),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]+", 32),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]++\.eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]+", 40),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)


def _all_of(parts: list[Query]) -> Query:
    parts = [p for p in dict.fromkeys(parts) if p != ALL]
    return ALL if not parts else parts[0] if len(parts) == 1 else ("and", *parts)


def _any_of(parts: list[Query]) -> Query:
    parts = list(dict.fromkeys(parts))
    return ALL if not parts or ALL in parts else parts[0] if len(parts) == 1 else ("or", *parts)


def _strings(node) -> set[str] | None:
    """All strings a node can match, if they are few."""
    kind, arg = node
    if kind is op.LITERAL:
        return {chr(arg).lower()}
    if kind is op.IN:
        out: set[str] = set()
        for k, a in arg:
            if k is op.LITERAL:
                out.add(chr(a).lower())
            elif k is op.RANGE and a[1] - a[0] < 4:
                out |= {chr(c).lower() for c in range(a[0], a[1] + 1)}
            else:
                return None
        return out if len(out) <= 8 else None
    if kind is op.SUBPATTERN:
        return _sequence_strings(arg[3])
    if kind is op.BRANCH:
        sets = [_sequence_strings(p) for p in arg[1]]
        return None if None in sets else set().union(*sets)
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT) and arg[1] is not op.MAXREPEAT and arg[1] <= 2:
        inner = _sequence_strings(arg[2])
        if inner is None:
            return None
        out = {"".join(p) for n in range(arg[0], arg[1] + 1) for p in product(inner, repeat=n)}
        return out if len(out) <= FEW else None
    if kind is op.AT:
        return {""}
    return None


def _sequence_strings(nodes) -> set[str] | None:
    out = {""}
    for node in nodes:
        more = _strings(node)
        if more is None or len(out) * len(more) > FEW:
            return None
        out = {a + b for a in out for b in more}
    return out


def _of_strings(strings: set[str]) -> Query:
    def one(s: str) -> Query:
        b = s.encode()
        return _all_of([("tri", b[i:i + 3]) for i in range(len(b) - 2)])

    return _any_of([one(s) for s in sorted(strings)])


def _of_nodes(nodes) -> Query:
    """What every match of these nodes in a row must contain: runs of known strings, and the demands of the rest."""
    parts, run = [], {""}
    for node in nodes:
        known = _strings(node)
        if known is not None and len(run) * len(known) <= FEW:
            run = {a + b for a in run for b in known}
            continue
        parts.append(_of_strings(run))
        run = {""}
        if known is not None:
            run = known
            continue
        kind, arg = node
        if kind is op.SUBPATTERN:
            parts.append(_of_nodes(arg[3]))
        elif kind is op.BRANCH:
            parts.append(_any_of([_of_nodes(p) for p in arg[1]]))
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT) and arg[0] >= 1:
            parts.append(_of_nodes(arg[2]))
    return _all_of([*parts, _of_strings(run)])


@cache
def trigram_query(pattern: str) -> Query:
    """The trigrams, in lower case, that a text needs for ``pattern`` to match; ``("all",)`` if none is certain."""
    return _of_nodes(_parser.parse(pattern))


def trigrams_in(query: Query) -> set[bytes]:
    return {query[1]} if query[0] == "tri" else set().union(*[trigrams_in(q) for q in query[1:]]) if query != ALL else set()


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
PIECE = 4 << 20  # bytes looked at together while postings are built


def postings(data: np.ndarray, offsets: np.ndarray, wanted: list[bytes]) -> dict[bytes, np.ndarray]:
    """Rows (numbers within the block) that contain each wanted trigram; ``data`` holds the texts end to end."""
    code = np.array([w[0] << 16 | w[1] << 8 | w[2] for w in wanted], dtype=np.int64)
    first = np.zeros(1 << 16, dtype=bool)  # by the first two bytes, small enough to stay in a cache
    first[code >> 8] = True
    rows: dict[bytes, list[np.ndarray]] = {w: [] for w in wanted}
    order = np.argsort(code)
    for lo in range(0, max(len(data) - 2, 0), PIECE):
        part = _LOWER[data[lo:lo + PIECE + 2]]
        if len(part) < 3:
            break
        pair = part[:-2].astype(np.uint16) << 8 | part[1:-1]
        at = np.flatnonzero(first[pair])
        full = pair[at].astype(np.int64) << 8 | part[at + 2]
        spot = np.searchsorted(code[order], full)
        hit = np.flatnonzero(code[order][np.minimum(spot, len(code) - 1)] == full)
        row = np.searchsorted(offsets, at[hit] + lo, side="right") - 1
        inside = at[hit] + lo + 3 <= offsets[row + 1]
        key = np.unique(spot[hit][inside] * np.int64(len(offsets)) + row[inside])
        for k in range(len(wanted)):
            a, b = np.searchsorted(key, [k * len(offsets), (k + 1) * len(offsets)])
            if b > a:
                rows[wanted[order[k]]].append(key[a:b] - k * len(offsets))
    return {w: np.unique(np.concatenate(r)) if r else np.empty(0, np.int64) for w, r in rows.items()}


def answer(query: Query, index: dict[bytes, np.ndarray], n: int) -> np.ndarray:
    """Rows of the block that satisfy the query."""
    if query == ALL:
        return np.arange(n)
    if query[0] == "tri":
        return index[query[1]]
    parts = sorted((answer(q, index, n) for q in query[1:]), key=len)
    out = parts[0]
    for p in parts[1:]:
        out = np.intersect1d(out, p, assume_unique=True) if query[0] == "and" else np.union1d(out, p)
    return out


def _block(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column end to end, and where each row starts; nulls are empty."""
    col = batch.column(k).cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8)[offsets[0]:offsets[-1]] if col.buffers()[2] is not None and len(col) else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def matches(rule: Rule, text: bytes) -> list[tuple[int, int]]:
    """Byte spans, leftmost and without overlap; matches that are too short use up their place and are dropped."""
    return [m.span() for m in rule.regex.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


_LONG_HEX = re.compile(rb"[0-9a-f]{32,}")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``id``, ``spans array<struct<kind, start, end>>`` in code points, by start and then by the order of rules.

    One row per input row, as often as it is there; null text is empty and has no spans, a null id stays null. Whole
    texts are searched. No shuffle: the index lives as long as its block of rows.
    """
    queries = {r: trigram_query(r.pattern) for r in rules}
    wanted = sorted(set().union(*[trigrams_in(q) for q in queries.values()]))
    source = only(docs, id_col, text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = _block(batch, 1)
        n = batch.num_rows
        index = postings(data, offsets, wanted) if wanted else {}
        view = memoryview(data)
        found: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
        for k, rule in enumerate(rules):
            # a run of at least `least` characters of one class starts where the maximal run does
            whole_run = rule.pattern == "[0-9a-f]+" and rule.least == 32
            for i in answer(queries[rule], index, n).tolist():
                text = view[offsets[i]:offsets[i + 1]]
                hits = [m.span() for m in _LONG_HEX.finditer(text)] if whole_run else matches(rule, text)
                found[i] += [(a, k, b) for a, b in hits]
        rows = []
        for i, spans in enumerate(found):
            if spans:
                text = bytes(view[offsets[i]:offsets[i + 1]])
                plain = text.isascii()
                spans.sort()
                last, chars, here = 0, 0, []
                for a, k, b in spans:  # code points before each start, counted once along the text
                    chars += a - last if plain else len(text[last:a].decode())
                    last = a
                    here.append({"kind": rules[k].kind, "start": chars, "end": chars + (b - a if plain else len(text[a:b].decode()))})
                rows.append(here)
            else:
                rows.append([])
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], names=[id_col, "spans"])

    kind = source.schema[id_col].dataType.simpleString()
    return arrow_map(source, run, f"`{id_col}` {kind}, spans array<struct<kind: string, start: bigint, end: bigint>>")


def trigram_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The index as rows ``trigram, ids``: one row per trigram of the rules and block of documents that has it."""
    wanted = sorted(set().union(*[trigrams_in(trigram_query(r.pattern)) for r in rules]))
    source = only(docs, id_col, text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column(0)
        rows = [(w.decode("latin-1"), ids.take(pa.array(r)).to_pylist()) for w, r in postings(*_block(batch, 1), wanted).items() if len(r)]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(ids.type))], names=["trigram", "ids"])

    return arrow_map(source, run, f"trigram string, ids array<{source.schema[id_col].dataType.simpleString()}>")
