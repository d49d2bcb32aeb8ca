"""Call graph and source-to-sink paths as joins.

Nodes are bare function names within a ``repo``. A path search answers, for each source,
the path that a depth-first walk in call order would report first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from .. import fixed_values as fixed
from ..functions import text as T
from ..plans.checkpoints import cut, cut_counted, forget, stored
from ..plans.skew import SMALL_ROWS, join_null_safe, spread_lookup, step_join
from .parse import call_sites, functions

KEY = ["repo", "name"]


def call_nodes(parsed: DataFrame) -> DataFrame:
    """One row per name: place and text of its last definition; source and sink marks of
    any definition. An aggregate with map-side combine, so a name defined everywhere
    (``get``, ``run``) is reduced before the shuffle. ``parsed`` is read twice and stored unless
    it is a stored table already."""
    parsed = stored(parsed)
    code = F.col("code")
    f = functions(parsed).select(
        "repo", F.col("function_name").alias("name"), "file_path", "start_line", "func_seq", "code",
    )
    # Names and places are reduced without the text, which is fetched for the last ones only.
    marks = f.select(
        *KEY, F.struct(T.path_order(F.col("file_path")).alias("path"), "func_seq", "file_path").alias("at"),
        T.contains_any(code, fixed.SOURCE_SUBSTRINGS).alias("src"),
        T.contains_any(code, fixed.SINK_SUBSTRINGS).alias("snk"),
    ).groupBy(*KEY).agg(
        F.max("at").alias("last"), F.bool_or("src").alias("is_source"),
        F.bool_or("snk").alias("is_sink"),
    ).select(*KEY, "last.file_path", "last.func_seq", "is_source", "is_sink")
    place = ["repo", "name", "file_path", "func_seq"]
    return join_null_safe(f, marks.hint("shuffle_hash"), place).select(*KEY, "file_path", "start_line", "code", "is_source", "is_sink")


def call_edges(parsed: DataFrame) -> DataFrame:
    """Distinct (caller, callee) with the place of the first such call as ``ordinal``."""
    place = F.struct(
        T.path_order(F.col("file_path")).alias("path"), "func_seq", "call_seq"
    )
    return call_sites(parsed).groupBy("repo", "caller", "callee").agg(
        F.min(place).alias("ordinal")
    )


#: Rounds of the general search that are kept as they are before they are merged.
MOST_ROUNDS = 16
#: Hops of the first stored steps of the backward search, and of any.
FIRST_HOPS, MOST_HOPS = 4, 16


def reaching(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Names from which a sink can be reached, sinks included.

    A frontier walks the edges backwards. A stored step is a chain of hops in one plan, and
    steps become longer, so their number grows with the logarithm of the depth as long as
    MOST_HOPS allows. Every name also calls itself in the walked table: a hop hands on what it
    has, with the hop it was found at, and goes on from the latest finds only. What earlier steps
    know is taken out once a step; a step whose last hop finds nothing is the end."""
    back = cut(
        edges.select("repo", "callee", "caller")
        .unionByName(edges.select("repo", F.col("callee").alias("caller"), "callee"))
        .unionByName(edges.select("repo", "caller", F.col("caller").alias("callee")))
        .unionByName(nodes.where("is_sink").select("repo", F.col("name").alias("caller"), F.col("name").alias("callee")))
        .distinct()
    )
    known = frontier = cut(nodes.where("is_sink").select(*KEY).distinct())
    step, n = 0, 1
    while n:
        hops = min(FIRST_HOPS << step // 2, MOST_HOPS)
        walked = frontier.select("repo", F.col("name").alias("callee"), F.lit(0).alias("hop"))
        for hop in range(1, hops + 1):
            itself = F.col("caller") == F.col("callee")
            walked = (
                walked.join(back, ["repo", "callee"]).where(itself | (F.col("hop") == hop - 1))
                .groupBy("repo", F.col("caller").alias("name")).agg(F.min(F.when(itself, F.col("hop")).otherwise(hop)).alias("hop"))
                .withColumnRenamed("name", "callee")
            )
        new, n = cut_counted(
            walked.withColumnRenamed("callee", "name").join(known, KEY, "left_anti"), F.col("hop") == hops)
        known = known.unionByName(new.select(*KEY))
        frontier = new.where(F.col("hop") == hops).select(*KEY)
        step += 1
        known = known if step % 8 else cut(known)
    return known


def _live_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges into names that reach a sink, with the callee's sink mark."""
    live = reaching(edges, nodes).join(nodes.select(*KEY, "is_sink"), KEY).withColumnRenamed("name", "callee")
    return cut(edges.join(live, ["repo", "callee"]).select("repo", "caller", "callee", "ordinal", "is_sink"))


def _jumps(live: DataFrame) -> list[DataFrame]:
    """Jump tables over the first live call of every name: table t has ``name, at, hops, ended``, the
    name that is reached after 2**t calls, or the first sink before.

    A name that ends later than a table tells is followed by one that ends just beyond it, so
    each doubling ends some name as long as any can end. When none is left, or a doubling
    ends none, all others run into cycles."""
    first = live.groupBy("repo", "caller").agg(
        F.min_by(F.struct("callee", "is_sink"), F.col("ordinal")).alias("step"))
    table, left = cut_counted(first.select(
        "repo", F.col("caller").alias("name"), F.col("step.callee").alias("at"), F.lit(1).cast("long").alias("hops"),
        F.col("step.is_sink").alias("ended")), ~F.col("ended"))
    tables, before = [table], None
    while left and left != before:
        then = table.select(
            "repo", F.col("name").alias("at"), F.col("at").alias("then"), F.col("hops").alias("more"), F.col("ended").alias("end"))
        # Many names may meet at one; such a key is split by adaptive execution, as this is an inner join.
        on = table.where("not ended").join(then, ["repo", "at"])
        doubled = on.select("repo", "name", F.col("then").alias("at"), (F.col("hops") + F.col("more")).alias("hops"), F.col("end").alias("ended"))
        before = left
        table, left = cut_counted(table.where("ended").unionByName(doubled), ~F.col("ended"))
        tables.append(table)
    return tables


def _follow_first(live: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(paths, sources whose walk comes back to a name) of always taking the first live call.

    Calls that cannot reach a sink fail in any walk, so as long as no name comes up
    twice this *is* the depth-first walk. Paths are found by doubling and rebuilt from the jump
    tables, largest jump first: a row is one place of one path, and each table puts a place halfway
    between those there are."""
    tables = _jumps(live)
    ends = sources.select("repo", F.col("name").alias("source")).join(
        tables[-1].withColumnRenamed("name", "source"), ["repo", "source"])
    # A source that is a sink may be the end of its own walk: then the walk is a cycle.
    straight = F.col("ended") & (F.col("at") != F.col("source"))
    ends = cut(ends.withColumn("straight", straight))
    places = ends.where("straight").select(
        "repo", "source", F.col("hops").alias("length"), F.lit(0).cast("long").alias("place"), F.col("source").alias("name"))
    for t in reversed(range(len(tables))):
        far = F.col("place") + (1 << t)
        jump = tables[t].select("repo", "name", F.col("at").alias("then"))
        on = places.join(jump, ["repo", "name"], "left")
        both = F.array(F.struct("place", "name"), F.struct(far.alias("place"), F.col("then").alias("name")))
        here = F.slice(both, 1, F.when(far <= F.col("length"), 2).otherwise(1))
        places = on.select("repo", "source", "length", F.explode(here).alias("p")).select("repo", "source", "length", "p.*")
    paths = places.groupBy("repo", "source").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda p: p["name"]).alias("path"))
    return paths, ends.where("not straight").select("repo", F.col("source").alias("name"))


def _search(live: DataFrame, sources: DataFrame) -> DataFrame:
    """Paths where cycles matter.

    For each (source, name) only the path that comes first in call order can be part of
    the answer, so that one is kept and improved round by round until nothing changes. A path
    behind the first one to a sink that its source has so far can only lead to later ones,
    and goes no further.
    """
    key = ["repo", "source", "at"]
    no_calls = live.schema["ordinal"].dataType.simpleString()
    frontier, n = cut_counted(
        sources.select(
            "repo", F.col("name").alias("source"), F.col("name").alias("at"),
            F.array().cast(f"array<{no_calls}>").alias("calls"),
            F.array("name").alias("path"), F.lit(False).alias("is_sink"),
        )
    )
    # What rounds found is kept as they left it, with the best row of a key in the latest that has it.
    rounds = [frontier]
    while n:
        steps = step_join(
            frontier.where("not is_sink").withColumnRenamed("at", "caller")
            .drop("is_sink"),
            n, live, ["repo", "caller"], spread_by=["source"], frontier_is_hot=True,
        ).where(~F.array_contains("path", F.col("callee")))
        so_far = reduce(DataFrame.unionByName, rounds)
        goal = so_far.where(F.col("is_sink") & (F.size("path") > 1)).groupBy("repo", "source").agg(F.min("calls").alias("goal"))
        found, n_found = cut_counted(steps.select(
            "repo", "source", F.col("callee").alias("at"),
            F.struct(
                F.concat("calls", F.array("ordinal")).alias("calls"),
                F.concat("path", F.array("callee")).alias("path"), "is_sink",
            ).alias("new"),
        ).groupBy(*key).agg(F.min_by("new", F.col("new.calls")).alias("new"))
            .join(goal, ["repo", "source"], "left")
            .where(F.col("goal").isNull() | (F.col("new.calls") < F.col("goal"))).select(*key, "new.*"))
        old = so_far.select(*key, "calls")
        if n_found <= SMALL_ROWS:
            # Only rows of keys that were found again are shuffled.
            old = old.join(F.broadcast(found.select(*key)), key, "left_semi")
        old = old.groupBy(*key).agg(F.min("calls").alias("old_calls"))
        frontier, n = cut_counted(
            found.join(old, key, "left")
            .where(F.col("old_calls").isNull() | (F.col("calls") < F.col("old_calls"))).drop("old_calls")
        )
        forget(found)
        rounds.append(frontier)
        if len(rounds) == MOST_ROUNDS:
            merged = reduce(DataFrame.unionByName, rounds).groupBy(*key).agg(
                F.min_by(F.struct("calls", "path", "is_sink"), F.col("calls")).alias("b")).select(*key, "b.*")
            rounds = [cut(merged)]
    ends = reduce(DataFrame.unionByName, rounds).where(F.col("is_sink") & (F.size("path") > 1))
    return ends.groupBy("repo", "source").agg(
        F.min_by("path", F.col("calls")).alias("path")
    )


def sink_paths(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(repo, source, path): the first path from each source to a sink, if any.

    ``edges``: repo, caller, callee, ordinal (orderable among the calls of one caller);
    ``nodes``: repo, name, is_source, is_sink. A source that is itself a sink needs a
    further sink, and a walk ends at the first sink it meets.
    """
    first = edges.groupBy("repo", "caller", "callee").agg(F.min("ordinal").alias("ordinal"))
    edges, nodes = cut(first), cut(nodes.select(*KEY, "is_source", "is_sink"))
    live = _live_edges(edges, nodes)
    paths, around = _follow_first(live, nodes.where("is_source").select(*KEY))
    around, n = cut_counted(around)
    return paths.unionByName(_search(live, around)) if n else paths


def taint_issues(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """One issue per path, at its source."""
    place = nodes.select(*KEY, "file_path", "start_line", "code")
    at_source = paths.withColumn("sink", F.element_at("path", -1)).join(
        place.withColumnRenamed("name", "source"), ["repo", "source"]
    )
    at_sink = spread_lookup(
        at_source,
        place.select("repo", F.col("name").alias("sink"),
                     F.col("file_path").alias("sink_file"),
                     F.col("start_line").alias("sink_line")),
        ["repo", "sink"], spread_by=["source"],
    )
    arrows = F.array_join("path", fixed.PATH_ARROW)
    return at_sink.select(
        "repo", F.lit("taint_flow").alias("type"), F.lit("high").alias("severity"),
        F.lit(fixed.CONFIDENCE["taint_flow"]).alias("confidence"),
        F.col("source").alias("function"), F.col("file_path").alias("file"),
        F.col("start_line").alias("line_number"), F.col("start_line").alias("file_line"),
        F.left("code", F.lit(120)).alias("code_snippet"),
        F.format_string("taint_%s_%s", "source", "sink").alias("chunk_id"),
        arrows.alias("taint_path"), F.col("sink").alias("sink_function"),
        "sink_file", "sink_line",
        F.format_string(
            fixed.TAINT_MESSAGE, F.col("source"), F.col("sink"), F.size("path") - 1, arrows
        ).alias("message"),
    )


def counters(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """One row: numbers of sources, sinks and flows."""
    return nodes.agg(
        F.count_if("is_source").alias("sources"), F.count_if("is_sink").alias("sinks")
    ).withColumn("flows", paths.agg(F.count(F.lit(1))).scalar())
