"""Row-level detectors: one declarative table of rules over lines and syntax facts."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_, or_
from typing import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as fixed
from ..functions import text as T
from .parse import with_facts

# `/`, spaces, `0` that starts neither a decimal fraction nor a longer word.
DIVISION_BY_ZERO = rf"/{T.WS}*0(?!\.\p{{Nd}}|{T.WORD})"
# (The look-ahead only names the first letters, which rejects most positions at once.)
SECRET = (
    rf"(?iu)(?=[past])(?<!{T.WORD})({'|'.join(fixed.SECRET_NAMES)}){T.WS}*={T.WS}*"
    r"['\"][^\n]+['\"]"
)


@dataclass(frozen=True)
class Rule:
    """A finding for each line or fact where ``predicate`` holds.

    ``predicate``, ``severity`` and ``message`` get the line or fact as a struct with
    ``line_text`` (and ``kind``, ``name``, ``flag`` for facts).  ``hint`` may tell from a
    whole text that no line of it can match; ``words`` is a pattern without which a text has no
    fact that can.
    """

    issue_type: str
    over: str  # "line" or "fact"
    predicate: Callable[[Column], Column]
    severity: Callable[[Column], Column]
    message: Callable[[Column], Column]
    hint: Callable[[Column], Column] | None = None
    words: str | None = None


def _always(value: str) -> Callable[[Column], Column]:
    return lambda _: F.lit(value)


def _simple(issue_type: str, over: str, severity: str, predicate, words: str | None = None) -> Rule:
    return Rule(
        issue_type, over, predicate, _always(severity),
        _always(fixed.RULE_MESSAGES[issue_type]), words=words,
    )


def _pattern(issue_type: str, severity: str, pattern: str, *needs: str) -> Rule:
    """A line rule by pattern. Text that lacks a needed character, or does not match as a
    whole, has no matching line and is not split."""

    def hint(text: Column) -> Column:
        return reduce(and_, [text.contains(c) for c in needs]) & text.rlike(pattern)

    return Rule(
        issue_type, "line", lambda x: x["line_text"].rlike(pattern), _always(severity),
        _always(fixed.RULE_MESSAGES[issue_type]), hint,
    )


def _call_to(name: str) -> Callable[[Column], Column]:
    return lambda x: (x["kind"] == "call") & (x["name"] == name)


def _eval_is_compiled(x: Column) -> Column:
    return x["line_text"].contains("compile(") & x["line_text"].contains("ctx")


def _exec_from_file(x: Column) -> Column:
    return x["line_text"].contains("read()") | F.col("code").contains("open(")


def _either(test, yes: str, no: str) -> Callable[[Column], Column]:
    return lambda x: F.when(test(x), yes).otherwise(no)


_TEXT = fixed.RULE_MESSAGES

RULES: tuple[Rule, ...] = (
    _pattern("division_by_zero", "high", DIVISION_BY_ZERO, "/"),
    Rule("eval_usage", "fact", _call_to("eval"),
         _either(_eval_is_compiled, "medium", "high"),
         _either(_eval_is_compiled, _TEXT["eval_usage_compiled"], _TEXT["eval_usage"]), words="eval"),
    Rule("exec_usage", "fact", _call_to("exec"),
         _either(_exec_from_file, "medium", "high"),
         _either(_exec_from_file, _TEXT["exec_usage_from_file"], _TEXT["exec_usage"]), words="exec"),
    _simple("potential_infinite_loop", "fact", "medium",
            lambda x: (x["kind"] == "while_true") & ~x["flag"], "while"),
    _simple("assert_in_production", "fact", "low",
            lambda x: (x["kind"] == "assert")
            & ~F.col("function_name").startswith("test"), "assert"),
    _simple("bare_except_swallow", "fact", "high",
            lambda x: x["kind"] == "except_pass", "except"),
    Rule("mutable_default_argument", "fact",
         lambda x: x["kind"] == "mutable_default", _always("medium"),
         lambda x: F.format_string(_TEXT["mutable_default_argument"], x["name"]), words=r"[\[{]"),
    _pattern("hardcoded_secret", "high", SECRET, "="),
    _simple("print_in_production", "fact", "low", _call_to("print"), "print"),
)

RULE_ISSUE_COLUMNS = (
    "type", "severity", "confidence", "function", "file", "line_number", "file_line",
    "code_snippet", "chunk_id", "message",
)


def _code_lines(code: Column) -> Column:
    numbered = F.transform(
        T.lines(code),
        lambda x, i: F.struct((i + 1).alias("line_no"), x.alias("line_text")),
    )

    def holds_code(row):
        stripped = T.strip(row["line_text"])
        return (stripped != "") & ~stripped.startswith("#")

    return F.filter(numbered, holds_code)


def _lines_in_question(text: Column, rules) -> Column:
    """Code lines of texts in which some line rule may match, NULL for others."""
    hints = [r.hint for r in rules if r.over == "line"]
    if not hints:
        return F.lit(None)
    if None in hints:
        return _code_lines(text)
    return F.when(reduce(or_, [h(text) for h in hints]), _code_lines(text))


def _finding(rule: Rule, rule_seq: int) -> Callable[[Column], Column]:
    confidence = fixed.CONFIDENCE.get(rule.issue_type, fixed.DEFAULT_CONFIDENCE)

    def build(x: Column) -> Column:
        return F.struct(
            F.lit(rule_seq).alias("rule_seq"),
            F.lit(rule.issue_type).alias("type"),
            rule.severity(x).alias("severity"),
            F.lit(confidence).alias("confidence"),
            x["line_no"].alias("line_number"),
            T.strip(x["line_text"]).alias("code_snippet"),
            rule.message(x).alias("message"),
        )

    return build


def scan(chunks: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Issues of every rule over every chunk, in one pass and without a shuffle.

    Each rule turns the lines or facts of a chunk into an array of findings; the arrays
    are joined in rule order and exploded once.  ``line_number`` counts from the start
    of the chunk, ``file_line`` from the start of the file.
    """
    words = [r.words for r in rules if r.over == "fact"]
    asked = () if None in words else tuple(words)
    prepared = (with_facts(chunks, asked) if words else chunks).withColumn(
        "code_lines", _lines_in_question(F.col("code"), rules)
    )
    findings = [
        F.transform(
            F.filter(F.col("code_lines" if r.over == "line" else "facts"), r.predicate),
            _finding(r, n),
        )
        for n, r in enumerate(rules)
    ]
    # Without lines in question a line rule finds NULL, which adds nothing.
    findings = F.flatten(F.array_compact(F.array(*findings)))
    order = [c for c in ("repo", "rel_path", "func_seq", "part") if c in chunks.columns]
    rows = prepared.select(
        *order, "chunk_id", "start_line",
        F.col("function_name").alias("function"), F.col("file_path").alias("file"),
        F.posexplode(findings).alias("hit_seq", "hit"),
    )
    return rows.select(
        *order, "hit.rule_seq", "hit_seq",
        "hit.type", "hit.severity", "hit.confidence", "function", "file",
        F.col("hit.line_number").alias("line_number"),
        (F.col("start_line") + F.col("hit.line_number") - 1).alias("file_line"),
        "hit.code_snippet", "chunk_id", "hit.message",
    )


def scan_texts(
    texts: DataFrame, id_column: str, text_column: str, issue_type: str
) -> DataFrame:
    """One line rule over any text table: (id, line_no, code_snippet)."""
    rule = next(r for r in RULES if r.issue_type == issue_type and r.over == "line")
    hits = F.filter(_code_lines(F.col(text_column)), rule.predicate)
    if rule.hint is not None:
        texts = texts.where(rule.hint(F.col(text_column)))
    return texts.select(id_column, F.explode(hits).alias("x")).select(
        id_column,
        F.col("x.line_no").alias("line_no"),
        T.strip(F.col("x.line_text")).alias("code_snippet"),
        rule.severity(F.col("x")).alias("severity"),
        F.lit(fixed.CONFIDENCE[issue_type]).alias("confidence"),
    )
