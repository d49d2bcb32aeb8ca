"""License scan by ordered signature rules.

A text becomes lower-case words joined by one space. The words it holds open the gates of the
rules (:mod:`license_rules`); only rules whose gate is open are run, as regular expressions over
the joined words. Detections are intervals of words. One is suppressed if it lies within a
detection of a higher priority, or within a longer one, or an equal one of an earlier rule, of the same
priority; what suppresses may itself be suppressed, which changes nothing, as containment is
transitive. Base rules have the highest priority and are never suppressed.

Defined results. A null text is an empty one: no words, no detections, score 0. Words are cut in
slices of bounded size, so a long text costs a few times its own size. The number of detections
is not limited. Ids, repeated rows and further columns are carried through; every row is scanned by
itself, so there is no shuffle and nothing to skew.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from .license_rules import KINDS, Rule, signatures
from .text import column_bytes

SLICE_BYTES = 1 << 20
#: Lower-case letters, digits and all bytes of other scripts are in words; the rest are gaps.
_WORD_BYTES = bytes(
    b + 32 if ord("A") <= b <= ord("Z") else b if b >= 0x80 or chr(b).isdigit() or ord("a") <= b <= ord("z") else 0x20
    for b in range(256))
_GAP = re.compile(b"[" + b"".join(b"\\x%02x" % b for b in range(256) if _WORD_BYTES[b] == 0x20) + b"]")

DETECTION = "struct<rule:int,label:string,kind:string,first:bigint,last:bigint,kept:boolean,words:string>"
RESULT = f"struct<words:bigint,found:array<{DETECTION}>,score:double>"


class Scanner:
    """Rules made ready: patterns over UTF-8 bytes, and rules by the words that open them."""

    def __init__(self, rules: list[Rule]):
        self.rules = rules
        self.level = [list(KINDS).index(r.kind) for r in rules]
        self.patterns = [re.compile(b"(?<![^ ])(?:" + r.pattern.encode() + b")(?![^ ])") for r in rules]
        self.group = [p.groupindex.get("at", 0) for p in self.patterns]
        self.gates = [[frozenset(w.encode() for w in group) for group in r.gate] for r in rules]
        self.by_word: dict[bytes, list[int]] = {}
        for i, groups in enumerate(self.gates):
            for word in groups[0]:
                self.by_word.setdefault(word, []).append(i)
        self.keys = frozenset().union(*(g for groups in self.gates for g in groups)) if rules else frozenset()

    def normal(self, data: bytes) -> tuple[bytes, int, set[bytes]]:
        """Words joined by one space, their number, and the gate words among them."""
        parts, n, seen = [], 0, set()
        at = 0
        while at < len(data):
            # A slice ends at a gap: letters of the next word belong to this one.
            gap = _GAP.search(data, at + SLICE_BYTES)
            end = gap.end() if gap else len(data)
            mapped = data[at:end].translate(_WORD_BYTES)
            words = mapped.split()
            if words:
                n += len(words)
                seen |= self.keys.intersection(words)
                parts.append(b" ".join(words))
            at = end
        return b" ".join(parts), n, seen

    def opened(self, seen: set[bytes]) -> list[int]:
        """Rules whose gate is open, in order."""
        first = {i for word in seen for i in self.by_word.get(word, ())}
        return sorted(i for i in first if all(not group.isdisjoint(seen) for group in self.gates[i]))

    def detections(self, joined: bytes, rules: list[int]) -> list[tuple[int, int, int, int, int]]:
        """(rule, first word, last word, begin, end) of all matches."""
        spans = [(i, *m.span(self.group[i])) for i in rules for m in self.patterns[i].finditer(joined)]
        if not spans:
            return []
        # Places become word numbers by one walk over the text.
        edges = sorted({s for _, a, b in spans for s in (a, b)})
        number, at, count = {}, 0, 0
        for e in edges:
            count += joined.count(b" ", at, e)
            number[e], at = count, e
        return [(i, number[a], number[b], a, b) for i, a, b in spans]

    def kept(self, found: list[tuple[int, int, int, int, int]]) -> np.ndarray:
        """Which detections are not suppressed."""
        if not found:
            return np.zeros(0, bool)
        rule, first, last = (np.array([f[k] for f in found], np.int64) for k in range(3))
        level = np.array([self.level[i] for i in rule])
        keep = np.ones(len(found), bool)
        order = np.lexsort((rule, -last, first))
        # Of the same level: an earlier start or a later end, in this order, contains.
        for one in np.unique(level):
            here = order[level[order] == one]
            reach = np.maximum.accumulate(last[here])
            keep[here[1:]] = last[here[1:]] > reach[:-1]
            above = order[level[order] < one]
            if len(above):
                reach = np.maximum.accumulate(last[above])
                at = np.searchsorted(first[above], first[here], side="right")
                keep[here] &= ~((at > 0) & (reach[np.maximum(at - 1, 0)] >= last[here]))
        return keep

    def scan(self, data: bytes) -> tuple[int, list[dict], float]:
        joined, n, seen = self.normal(data)
        rules = self.opened(seen)
        found = self.detections(joined, rules) if rules else []
        rows, sure = [], {}
        for (i, first, last, a, b), keep in zip(found, self.kept(found)):
            r = self.rules[i]
            rows.append({"rule": i, "label": r.label, "kind": r.kind, "first": first, "last": last, "kept": bool(keep),
                         "words": joined[a:b].decode()})
            if keep:
                sure[r.label] = max(sure.get(r.label, 0.0), KINDS[r.kind])
        rows.sort(key=lambda d: (d["first"], d["last"], d["rule"]))
        return n, rows, 1.0 - float(np.prod([1.0 - sure[label] for label in sorted(sure)])) if sure else 0.0


_held: dict = {}


def _scanner() -> Scanner:
    """The rules of this process, compiled once."""
    if "scanner" not in _held:
        _held["scanner"] = Scanner(signatures())
    return _held["scanner"]


def _scan(texts: pa.Array) -> pa.Array:
    scanner = _scanner()
    data, offsets = column_bytes(texts)
    words, found, score = [], [], []
    for a, b in zip(offsets[:-1], offsets[1:]):
        n, rows, s = scanner.scan(data[a:b].tobytes())
        words.append(n)
        found.append(rows)
        score.append(s)
    detection = pa.struct([("rule", pa.int32()), ("label", pa.string()), ("kind", pa.string()), ("first", pa.int64()),
                           ("last", pa.int64()), ("kept", pa.bool_()), ("words", pa.string())])
    return pa.StructArray.from_arrays(
        [pa.array(words, pa.int64()), pa.array(found, pa.list_(detection)), pa.array(score, pa.float64())],
        ["words", "found", "score"])


def with_licenses(docs: DataFrame, column: str = "text", name: str = "licenses") -> DataFrame:
    """``docs`` and a struct: ``words`` (their number), ``found`` (all detections by place: rule,
    label, kind, first and last word, whether kept, the words) and ``score``, the chance that
    some license is stated, taking the best kept detection of each label as independent."""
    scan = arrow_udf(_scan, RESULT).asNondeterministic()
    return docs.withColumn(name, scan(F.col(f"`{column}`")))


def label_list(found: Column, kinds: Column | None = None) -> Column:
    """Distinct labels of the kept detections (of base rules only with ``kinds``), sorted."""
    kept = F.filter(found, lambda d: d["kept"] if kinds is None else d["kept"] & (d["kind"] == kinds))
    return F.array_join(F.array_sort(F.array_distinct(F.transform(kept, lambda d: d["label"]))), ",")
