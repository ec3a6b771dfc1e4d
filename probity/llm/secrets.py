"""Secret scans: all rules in one pass of one deterministic automaton."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .automaton import Automaton
from .common import chunks


@dataclass(frozen=True)
class Rule:
    """kind; pattern, taken leftmost, longest and without overlaps; of a match, `value` (the tail from its last match of
    `value_start`) must have `least` bytes, else the match is dropped after it has used up its text."""

    kind: str
    pattern: str
    least: int = 1
    head: str = ""  # pattern of what comes before the value that `least` counts


_ASSIGN = "(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?"
#: Base rules, in the order of ties.
BASE = (
    Rule("assign", _ASSIGN + "[A-Za-z0-9+/_.=\\-]+", 6, _ASSIGN),
    Rule("access", "AKIA[A-Z0-9]+", 20),
    Rule("hex", "[0-9a-f]+", 24),
)
#: Rules for further well-known token forms.
MORE = (
    Rule("private_key", "-----BEGIN (RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----"),
    Rule("github", "gh[pousr]_[A-Za-z0-9]+", 24),
    Rule("slack", "xox[abprs]-[A-Za-z0-9\\-]+", 15),
    Rule("jwt", "eyJ[A-Za-z0-9_\\-]+\\.eyJ[A-Za-z0-9_\\-]+\\.[A-Za-z0-9_\\-]+", 30),
)


def _detector(rule: Rule) -> str:
    """The rule's pattern for the byte pass. Long counted runs would multiply the states of the joint automaton, so at most
    8 bytes of a bare run are asked for, which is where any long enough match begins as well."""
    return {"hex": "[0-9a-f]{8}"}.get(rule.kind, rule.pattern)


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = BASE + MORE):
        self.rules = rules
        self.joint = Automaton([_detector(r) for r in rules], backward=True)
        self.exact = [Automaton([r.pattern], search=False) for r in rules]
        self.heads = [Automaton([r.head], search=False) if r.head else None for r in rules]

    def spans(self, raw: bytes, begin: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
        """(start, end, rule) of rule k in a piece in which its matches begin at `begin`: from each that no match before covers, the
        longest. A match is read once, so time is linear however many places begin one."""
        rule, head, auto, i = self.rules[k], self.heads[k], self.exact[k], 0
        while i < len(begin):
            at = int(begin[i])
            end = auto.longest(raw, at)
            value = head.longest(raw, at) if head else at
            if end - value >= rule.least:
                yield at, end, k
            i = max(i + 1, int(np.searchsorted(begin, end)))

    def scan(self, buf: np.ndarray, offs: np.ndarray) -> list[list[tuple[int, int, int]]]:
        """Spans (start, end, rule) in code points of every text of a chunk, by start, then rule."""
        out: list[list] = [[] for _ in range(len(offs) - 1)]
        if not len(buf):
            return out
        # no match holds a byte that resets every rule: texts fall into pieces there
        stop = self.joint.reset[buf]
        edge = np.zeros(len(buf) + 1, bool)
        edge[offs] = True
        edge[1:] |= stop
        edge[:-1] |= stop
        cuts = np.flatnonzero(edge)
        size = np.diff(cuts)
        some = np.flatnonzero((size > 7) & ~stop[cuts[:-1]])  # no rule matches fewer than 8 bytes
        starts, ends = cuts[some], cuts[some + 1]
        piece, place, bits = self.joint.begins(buf, starts, ends)
        for p in np.unique(piece).tolist():
            mine = slice(int(np.searchsorted(place, starts[p])), int(np.searchsorted(place, ends[p])))
            s, raw = int(starts[p]), buf[starts[p] : ends[p]].tobytes()
            r = int(np.searchsorted(offs, s, "right")) - 1
            for k in range(len(self.rules)):
                begin = place[mine][(bits[mine] >> k & 1) > 0] - s
                out[r] += [(s + a - int(offs[r]), s + b - int(offs[r]), k) for a, b, k in self.spans(raw, begin, k)]
        for r, found in enumerate(out):
            if found:
                text = buf[offs[r] : offs[r + 1]]
                points = np.concatenate(([0], np.cumsum((text & 0xC0) != 0x80)))
                out[r] = sorted(((int(points[a]), int(points[b]), k) for a, b, k in found), key=lambda x: (x[0], x[2]))
        return out


@lru_cache(4)
def _compiled(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


def find_secrets(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """Columns `keep` of docs (None: all), then secrets: array of (kind, start, end) in code points, by start, then kind.

    One pass of the joint automaton over every byte, from right to left, tells where matches of which rules begin; from the leftmost
    that no match before covers, the rule's own automaton reads the longest match. No shuffle; a task holds one Arrow batch.

    Nulls: a null text is empty and has no secrets, as an empty one. Repeated rows each get their spans. Texts of any
    length are scanned whole. A column named secrets is replaced. An empty table gives an empty result.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c != "secrets"]
    d = docs.select(*dict.fromkeys([*keep, text_col]))
    sent = docs.sparkSession.sparkContext.broadcast(_compiled(rules))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(batch.schema.get_field_index(text_col))
            for a, b, buf, offs in chunks(text, 4 << 20):
                part = batch.slice(a, b - a)
                found = [[{"kind": rules[k].kind, "start": s, "end": e} for s, e, k in x] for x in sent.value.scan(buf, offs)]
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(c)) for c in keep] + [pa.array(found, kind)], names=[*keep, "secrets"])

    item = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    return d.mapInArrow(scan, T.StructType([T.StructField(f.name, f.dataType) for f in d.schema.fields if f.name in keep] + [T.StructField("secrets", T.ArrayType(item))]))
