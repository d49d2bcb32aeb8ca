"""One parse per file: functions, arguments and calls as a flat table.

The only Python in this module is a few Arrow functions that turn source text into facts;
everything else in the library works on their columns in the JVM.
Source text is only ever parsed, never imported or run.
"""

from __future__ import annotations

import ast
import gc
import re
import textwrap
import warnings

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import (
    ArrayType, BooleanType, IntegerType, StringType, StructField, StructType,
)

from ..functions.memory import give_back

#: Texts, and bytes of text about, whose facts a worker holds as Python objects at once.
LOT_ROWS = 256
LOT_BYTES = 4 * 1024 * 1024

PARSE_TYPE = StructType([
    StructField("error", StringType()),
    StructField("functions", ArrayType(StructType([
        StructField("name", StringType()),
        StructField("start_line", IntegerType()),
        StructField("end_line", IntegerType()),
        StructField("code", StringType()),
        StructField("is_async", BooleanType()),
        StructField("is_nested", BooleanType()),
        StructField("arguments", ArrayType(StringType())),
        StructField("calls", ArrayType(StringType())),
    ]))),
])
FACT_TYPE = ArrayType(StructType([
    StructField("kind", StringType()),
    StructField("line_no", IntegerType()),
    StructField("line_text", StringType()),
    StructField("name", StringType()),
    StructField("flag", BooleanType()),
]))
PARSE_FACTS_TYPE = StructType([
    PARSE_TYPE["error"],
    StructField("functions", ArrayType(StructType([
        *PARSE_TYPE["functions"].dataType.elementType, StructField("facts", FACT_TYPE)]))),
])
_PARSED = to_arrow_type(PARSE_TYPE)
_PARSED_FACTS = to_arrow_type(PARSE_FACTS_TYPE)
_FACTS = to_arrow_type(FACT_TYPE)

_DEFS = (ast.FunctionDef, ast.AsyncFunctionDef)
_MAY_HAVE_FACTS = r"eval|exec|print|while|assert|except|[\[{]|[^\x00-\x7f]"
# What a parser may raise on hostile input; one bad text must not end a task.
PARSE_FAILURES = (SyntaxError, ValueError, RecursionError, MemoryError)


def parse_text(source: str) -> ast.Module:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return ast.parse(source)


#: Nodes that only say how another is used, which no one asks about.
_MARKS = (ast.expr_context, ast.operator, ast.unaryop, ast.boolop, ast.cmpop, ast.alias, ast.type_ignore)
#: Fields of a kind of node that hold others, as far as asked for.
_below: dict[type, tuple[str, ...]] = {ast.Name: (), ast.Constant: ()}


def _fields_below(kind: type) -> tuple[str, ...]:
    def holds_nodes(of) -> bool:
        return any(isinstance(x, type) and issubclass(x, ast.AST) and not issubclass(x, _MARKS)
                   for x in (of, *getattr(of, "__args__", ())))

    return tuple(f for f in kind._fields if holds_nodes(kind._field_types.get(f)))


def _walk(root: ast.AST) -> list[ast.AST]:
    """All nodes breadth first, like ``ast.walk``, but without going into names and
    constants, which hold nothing anyone asks about, and without operators, contexts and imported names."""
    found = [root]
    for node in found:
        kind = node.__class__
        fields = _below.get(kind)
        if fields is None:
            fields = _below[kind] = _fields_below(kind)
        for field in fields:
            value = getattr(node, field)
            if value.__class__ is list:
                found += [v for v in value if v is not None] if None in value else value
            elif value is not None:
                found.append(value)
    return found


#: Fields of a statement that hold statements, or the arms of one.
_BLOCKS = ("body", "handlers", "orelse", "finalbody", "cases")


def _definitions(tree: ast.Module) -> list[ast.AST]:
    """The functions of a text in the order of :func:`_walk`: only statements hold statements."""
    found = [tree]
    for node in found:
        for field in _BLOCKS:
            value = node.__dict__.get(field)
            if isinstance(value, list):
                found += value
    return [node for node in found if isinstance(node, _DEFS)]


def _callee(call: ast.Call) -> str | None:
    target = call.func
    return getattr(target, "id", None) or getattr(target, "attr", None)


#: Calls and kinds of nodes that some rule asks about.
_FACT_CALLS = ("eval", "exec", "print")
_FACT_NODES = {ast.Call, ast.While, ast.Assert, ast.ExceptHandler, *_DEFS}
#: A source of these characters alone has the same lines for the parser and for ``splitlines``.
_PLAIN = re.compile(r"[\t\n\x20-\x7e]*")


def _functions_of(source: str, with_facts: bool = False) -> dict:
    try:
        tree = ast.parse(source)
        rows = source.splitlines()
        plain = with_facts and _PLAIN.fullmatch(source) is not None and "barry_as_FLUFL" not in source
        found, inner = [], set()
        for node in _definitions(tree):
            calls = []
            asked = [child for child in _walk(node) if child.__class__ in _FACT_NODES]
            for child in asked:
                kind = child.__class__
                if kind is ast.Call:
                    name = _callee(child)
                    if name:
                        calls.append(name)
                elif child is not node and kind in _DEFS:
                    inner.add(child)
            found.append({
                "name": node.name,
                "start_line": node.lineno,
                "end_line": node.end_lineno,
                "code": "\n".join(rows[node.lineno - 1:node.end_lineno]),
                "is_async": isinstance(node, ast.AsyncFunctionDef),
                "is_nested": node in inner,
                "arguments": [a.arg for a in node.args.args],
                "calls": calls,
            })
            if with_facts:
                found[-1]["facts"] = _own_facts(node, asked, found[-1]["code"]) if plain else None
        return {"error": None, "functions": found}
    except PARSE_FAILURES as exc:
        return {"error": f"{type(exc).__name__}: {exc}", "functions": []}


def _facts_in(nodes: list[ast.AST], rows: list[str], first_line: int = 1) -> list[dict]:
    """Those of ``nodes`` that some rule asks about; ``rows`` start at ``first_line``."""
    facts = []

    def add(kind, node, name=None, flag=None):
        line = node.lineno - first_line
        facts.append({
            "kind": kind, "line_no": line + 1,
            "line_text": rows[line], "name": name, "flag": flag,
        })

    for node in nodes:
        kind = node.__class__
        if kind is ast.Call:
            if node.func.__class__ is ast.Name and node.func.id in _FACT_CALLS:
                add("call", node, node.func.id)
            continue
        if kind not in _FACT_NODES:
            continue
        match node:
            case ast.While(test=ast.Constant(value=True as test)) if test is True:
                leaves = any(
                    isinstance(c, (ast.Break, ast.Return, ast.Raise))
                    for c in _walk(node)
                )
                add("while_true", node, flag=leaves)
            case ast.Assert():
                add("assert", node)
            case ast.ExceptHandler(body=[ast.Pass()]):
                add("except_pass", node)
            case ast.FunctionDef() | ast.AsyncFunctionDef():
                for default in node.args.defaults:
                    if isinstance(default, (ast.List, ast.Dict, ast.Set)):
                        add("mutable_default", node, node.name)
    return facts


def _facts_of(code: str) -> list[dict]:
    """Syntax nodes that some rule asks about, in breadth-first order."""
    try:
        return _facts_in(_walk(ast.parse(code)), code.splitlines())
    except PARSE_FAILURES:
        return []


def _own_facts(node: ast.AST, nodes: list[ast.AST], code: str) -> list[dict] | None:
    """What :func:`_facts_of` finds in the stripped ``code`` of a function, from the parse of its plain
    file; ``nodes`` are those of :func:`_walk` of a kind asked for. None where the code by itself may not parse."""
    text = code.strip()
    if text.endswith("\\"):
        return None
    if node.decorator_list:  # not part of the code
        decorators, node.decorator_list = node.decorator_list, []
        nodes = _walk(node)
        node.decorator_list = decorators
    return _facts_in(nodes, text.splitlines(), node.lineno)


def _in_lots(texts: pa.Array, facts_of, wanted: pa.DataType) -> pa.Array:
    """``facts_of`` every text as one column. Only the facts of ``LOT_ROWS`` texts, or of about ``LOT_BYTES``,
    are Python objects at a time; what they took is then handed back."""
    # Trees hold no cycles, so the collector finds nothing in them and may rest.
    collects = gc.isenabled()
    gc.disable()
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return _lots(texts, facts_of, wanted)
    finally:
        if collects:
            gc.enable()


def _lots(texts: pa.Array, facts_of, wanted: pa.DataType) -> pa.Array:
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lots, begin = [], 0
    while begin < len(texts):
        before = ends[begin - 1] if begin else 0
        stop = min(begin + LOT_ROWS, max(begin + 1, int(np.searchsorted(ends, before + LOT_BYTES))))
        lots.append(pa.array([None if x is None else facts_of(x) for x in texts[begin:stop].to_pylist()], wanted))
        begin = stop
    if not lots:
        return pa.array([], wanted)
    if ends[-1] > LOT_BYTES:
        give_back()
    return pa.concat_arrays(lots)


@F.arrow_udf(PARSE_TYPE)
def _parse_files(content: pa.Array) -> pa.Array:
    return _in_lots(content, _functions_of, _PARSED)


@F.arrow_udf(PARSE_FACTS_TYPE)
def _parse_files_facts(content: pa.Array) -> pa.Array:
    return _in_lots(content, lambda x: _functions_of(x, True), _PARSED_FACTS)


@F.arrow_udf(FACT_TYPE)
def _syntax_facts(code: pa.Array) -> pa.Array:
    return _in_lots(code, _facts_of, _FACTS)


@F.arrow_udf(BooleanType())
def _parses(text: pa.Array) -> pa.Array:
    def ok(source: str) -> bool:
        # Methods come indented or bare; as the body of a block they are valid as well.
        for candidate in (source, "if 1:\n" + textwrap.indent(source, " ")):
            try:
                parse_text(candidate)
            except SyntaxError:
                continue
            except PARSE_FAILURES:
                break
            return True
        return False

    return pa.array([None if t is None else ok(t) for t in text.to_pylist()], pa.bool_())


def parse_files(files: DataFrame, facts: bool = False) -> DataFrame:
    """One row per ``def`` of each file, and one row with no ``func_seq`` for a file that
    has none or does not parse (``error``). With ``facts`` also the syntax facts of each function's
    code, for :func:`with_facts`; NULL where only a parse of the code by itself can tell.

    Store this table if it is read more than once: it is flat, so a reader of, say, the
    calls does not load the code.
    """
    # Declared non-deterministic so that no rewrite evaluates the parse twice.
    once = (_parse_files_facts if facts else _parse_files).asNondeterministic()
    keep = [c for c in files.columns if c != "content"]
    parsed = files.withColumn("parsed", once("content"))
    rows = parsed.select(
        *keep, F.col("parsed.error").alias("error"),
        F.posexplode_outer("parsed.functions").alias("func_seq", "f"),
    )
    return rows.select(*keep, "error", "func_seq", "f.*")


def parse_errors(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("error").isNotNull()).select(
        "repo", "file_path", "rel_path", "error"
    )


def functions(parsed: DataFrame) -> DataFrame:
    """One row per ``def``; ``is_method`` keeps its historic meaning of *async*."""
    return parsed.where(F.col("func_seq").isNotNull()).select(
        "repo", "file_path", "rel_path", "func_seq",
        F.col("name").alias("function_name"), "start_line", "end_line", "code",
        F.col("is_async").alias("is_method"), "is_async", "is_nested",
        *[c for c in ("facts",) if c in parsed.columns],
    )


def function_args(parsed: DataFrame) -> DataFrame:
    """Positional argument names of each plain (not async) function."""
    return parsed.where(~F.col("is_async")).select(
        "file_path", "func_seq", F.col("name").alias("function_name"),
        F.col("start_line").alias("line_number"), "arguments",
    )


def with_facts(chunks: DataFrame, words: tuple[str, ...] = ()) -> DataFrame:
    """``chunks`` plus their syntax facts; text that does not parse has none.

    A chunk without any word or bracket a fact starts from is not sent to the parser; with ``words``
    (patterns), nor is one without any of these.
    (Names with other than ASCII letters may still read as one of the words.)
    Nor is a chunk whose ``facts`` are there from the parse of its file; these are taken as they are.
    """
    may_have = "|".join((*words, r"[^\x00-\x7f]")) if words else _MAY_HAVE_FACTS
    known = F.col("facts") if "facts" in chunks.columns else F.lit(None).cast(FACT_TYPE)
    code = F.when(known.isNull() & F.col("code").rlike(may_have), F.col("code"))
    facts = _syntax_facts.asNondeterministic()(code)
    return chunks.withColumn(
        "facts", F.coalesce(known, facts, F.array().cast(FACT_TYPE))
    )


def parses(text):
    """True where a text parses as Python, by itself or as a class body."""
    return _parses(text)


def call_sites(parsed: DataFrame) -> DataFrame:
    """Every call inside each function, nested functions included, duplicates kept.

    (``file_path`` by parts, ``func_seq``, ``call_seq``) is the order of the calls of
    one caller name over the whole corpus.
    """
    return parsed.select(
        "repo", "file_path", "func_seq", F.col("name").alias("caller"),
        F.posexplode("calls").alias("call_seq", "callee"),
    )
