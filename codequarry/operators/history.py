"""Who changed a line, what the file was before, and the story of an issue."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .. import fixed_values as fixed
from ..functions import text as T
from ..functions.ages import age_text, days_old
from ..plans.checkpoints import cut
from ..plans.skew import keep_last, shared, spread_lookup

SEQ_BUCKET = 4_096
LINE_BLOCK = 64
#: Lines of a block of a file, a power of two, and changes that a task paints at once.
OWNED_BLOCK = 65_536
PAINT_ROWS = 200_000

ARCHAEOLOGY = (
    "investigated", "reason", "author", "author_email", "commit_hash", "commit_summary",
    "days_old", "age_description", "code_before", "had_safe_version", "insight",
)


def parse_blame(porcelain: Column) -> Column:
    """One blame record as a struct, NULL where the text holds none."""
    rows = T.lines(porcelain)

    def value(prefix: str) -> Column:
        hit = F.filter(rows, lambda x: x.startswith(prefix + " "))
        found = F.try_element_at(hit, F.lit(1))
        return F.coalesce(
            T.strip(F.substring(found, len(prefix) + 2, 1_000_000_000)), F.lit("")
        )

    words = F.split(T.strip(F.try_element_at(rows, F.lit(1))), T.WS + "+")
    commit = F.element_at(words, 1)
    stamp = value("author-time")
    record = F.struct(
        commit.alias("commit_hash"), value("author").alias("author"),
        F.btrim(value("author-mail"), F.lit("<>")).alias("author_mail"),
        F.when(stamp.rlike(r"^\d+$"), stamp.cast("long")).otherwise(0).alias("ts_epoch"),
        value("summary").alias("summary"),
    )
    return F.when((T.strip(porcelain) != "") & (F.length(commit) >= 7), record)


def _tree_nodes(first: Column, stop: Column) -> Column:
    """The fewest aligned ranges that make up the lines ``first`` (included) to ``stop`` (not),
    as (level, node): node n of level k is the lines from n * 2**k on. At most two of a level.
    :func:`owned_ranges` no longer goes by these; a test holds their number."""
    def of(level: Column) -> Column:
        low = F.negate(F.call_function("shiftright", F.negate(first), level))
        high = F.call_function("shiftright", stop, level)

        def node(which: Column, wanted: Column) -> Column:
            return F.when((low < high) & wanted, F.struct(level.alias("level"), which.alias("node")))

        return F.array(
            node(low, low.bitwiseAND(F.lit(1)) == 1), node(high - 1, high.bitwiseAND(F.lit(1)) == 1))

    levels = F.sequence(F.lit(0), F.ceil(F.log2(stop - first)).cast("int"))
    return F.filter(F.flatten(F.transform(levels, of)), lambda n: n.isNotNull())


def _painted(group: np.ndarray, first: np.ndarray, stop: np.ndarray, rank: np.ndarray):
    """(row, first, stop) of the longest ranges with one owner: for each piece of line the row with the
    greatest rank that covers it. Rows of a group are neighbours; ``stop`` is not included.

    A range of the ends that occur is two overlapping ranges of the greatest power of two that fits;
    the greatest row of each is handed down power by power."""
    groups, ends = np.concatenate([group, group]), np.concatenate([first, stop])
    order = np.lexsort((ends, groups))
    groups, ends = groups[order], ends[order]
    new = np.ones(len(ends), bool)
    new[1:] = (groups[1:] != groups[:-1]) | (ends[1:] != ends[:-1])
    place = np.empty(len(ends), np.int64)
    place[order] = np.cumsum(new) - 1
    ends = ends[new]
    left, right = place[:len(first)], place[len(first):]
    by_rank = np.argsort(rank, kind="stable")
    value = np.empty(len(rank), np.int64)
    value[by_rank] = np.arange(len(rank))
    power = np.frexp((right - left).astype(np.float64))[1] - 1
    top = np.full(len(ends), -1, np.int64)
    for level in range(int(power.max()), -1, -1):
        at = power == level
        np.maximum.at(top, left[at], value[at])
        np.maximum.at(top, right[at] - (1 << level), value[at])
        if level:
            half = 1 << (level - 1)
            down = top.copy()
            np.maximum(down[half:], top[:-half], out=down[half:])
            top = down
    row = np.where(top >= 0, by_rank[top], -1)
    owner = np.where(row >= 0, rank[row], 0)
    # Nothing covers what is behind the last end of a group, so no range goes on into the next.
    starts = np.concatenate([[0], np.flatnonzero(owner[1:] != owner[:-1]) + 1])
    stops = np.append(starts[1:], len(ends) - 1)
    held = owner[starts] > 0
    return row[starts[held]], ends[starts[held]], ends[stops[held]]


def _paint(batches):
    """Rows by group and owner → their ranges. What is held of a group is painted over and over, so a
    task holds at most about ``PAINT_ROWS`` changes and twice the ranges they leave."""
    def painted(rows: pa.Table) -> pa.Table:
        fresh = rows["fresh"].to_numpy()
        taken, first, stop = _painted(np.cumsum(fresh), *(rows[c].to_numpy() for c in ("first", "stop", "rank")))
        group = np.cumsum(fresh)[taken]
        out = rows.take(pa.array(taken))
        starts = np.ones(len(taken), bool)
        starts[1:] = group[1:] != group[:-1]
        for name, values in (("first", first), ("stop", stop), ("fresh", starts)):
            out = out.set_column(out.schema.get_field_index(name), out.schema.field(name), pa.array(values))
        return out

    held, n, limit = [], 0, PAINT_ROWS
    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < limit:
            continue
        rows = pa.Table.from_batches(held).combine_chunks()
        last = int(np.flatnonzero(rows["fresh"].to_numpy())[-1])
        if last:
            yield from painted(rows.slice(0, last)).to_batches()
        rest = rows.slice(last)
        rest = painted(rest) if rest.num_rows >= PAINT_ROWS // 2 else rest
        held, n = rest.to_batches(), rest.num_rows
        limit = max(PAINT_ROWS, 2 * n)
    if held:
        yield from painted(pa.Table.from_batches(held).combine_chunks()).to_batches()


def owned_ranges(line_history: DataFrame) -> DataFrame:
    """(repo if given, file, line_from, line_to) → the last commit that touched these lines.

    ``line_history``: file, line_from, line_to, commit_id, committed_at, and any commit facts that
    can be ordered. The last change wins, then the greatest commit id, then the greatest facts.
    Ranges of a file do not overlap and are as long as they can be; lines that no change covers
    are in none. A change without a first or a last line covers nothing, one whose ends are the
    wrong way round covers what lies between. Null is a file and a repo like others.

    Rows follow changes, never lines. Files are cut into blocks of ``OWNED_BLOCK`` lines, or as many as
    a change has on average, so all changes together are at most three times as many pieces. The pieces of
    a block are shuffled and sorted by owner once and painted in Arrow (:func:`_painted`); ranges at the edge
    of a block, at most two a block, are joined with their neighbours."""
    keys = shared(["repo", "file"], line_history)
    facts = [c for c in line_history.columns if c not in (*keys, "line_from", "line_to", "committed_at", "commit_id")]
    owner = ["committed_at", "commit_id", *facts]
    ends = [F.col(c).cast("long") for c in ("line_from", "line_to")]
    known = line_history.where(F.col("line_from").isNotNull() & F.col("line_to").isNotNull())
    k, o = [f"k{n}" for n in range(len(keys))], [f"o{n}" for n in range(len(owner))]
    changes = known.select(
        *(F.col(c).alias(n) for c, n in zip(keys, k)), F.least(*ends).alias("first"), (F.greatest(*ends) + 1).alias("stop"),
        *(F.col(c).alias(n) for c, n in zip(owner, o)))
    length, low, high = changes.agg(
        F.avg(F.col("stop").cast("double") - F.col("first")), F.min("first"), F.max("stop")).first()
    bits = max(OWNED_BLOCK.bit_length() - 1, int(length or 0).bit_length())

    def block(line: Column) -> Column:
        return F.call_function("shiftright", line, F.lit(bits))

    one_block = low is None or low >> bits == (high - 1) >> bits
    if one_block:
        pieces = changes.withColumn("block", F.lit(0).cast("long"))
    else:
        begin, end = (F.call_function("shiftleft", x, F.lit(bits)) for x in (F.col("block"), F.col("block") + 1))
        pieces = changes.withColumn("block", F.explode(F.sequence(block(F.col("first")), block(F.col("stop") - 1)))).withColumns(
            {"first": F.greatest("first", begin), "stop": F.least("stop", end)})
    order = Window.partitionBy(*k, "block").orderBy(*o)
    ranked = pieces.select(
        *k, "block", "first", "stop", *o, F.dense_rank().over(order).alias("rank"), (F.row_number().over(order) == 1).alias("fresh"))
    ranges = ranked.mapInArrow(_paint, ranked.schema).select(*k, "block", "first", "stop", *o)
    if not one_block:
        ranges = cut(ranges)
        at_edge = (F.col("first") == F.call_function("shiftleft", "block", F.lit(bits))) | (
            F.col("stop") == F.call_function("shiftleft", F.col("block") + 1, F.lit(bits)))
        by_place = Window.partitionBy(*k).orderBy("first")
        same = F.struct("first", *o).eqNullSafe(F.lag(F.struct("stop", *o)).over(by_place))
        islands = ranges.where(at_edge).withColumn("new", (~same).cast("int")).withColumn(
            "island", F.sum("new").over(by_place))
        joined = islands.groupBy(*k, "island", *o).agg(F.min("first").alias("first"), F.max("stop").alias("stop"))
        ranges = ranges.where(~at_edge).select(*k, "first", "stop", *o).unionByName(joined.select(*k, "first", "stop", *o))
    types = dict(line_history.dtypes)
    return ranges.select(
        *(F.col(n).alias(c) for c, n in zip(keys, k)), F.col("first").cast(types["line_from"]).alias("line_from"),
        (F.col("stop") - 1).cast(types["line_to"]).alias("line_to"), *(F.col(n).alias(c) for c, n in zip(owner, o)))


def line_owners(line_history: DataFrame) -> DataFrame:
    """(repo if given, file, line_no) → the last commit that touched the line.

    ``line_history``: file, line_from, line_to, commit_id, committed_at, and any commit
    facts. The last change wins, then the greatest commit id. Each covered line is one
    row and is reduced before the shuffle, so a much-changed line costs nothing. This is the
    quicker form for changes of a few lines; long ones belong to :func:`owned_ranges`.
    """
    lines = line_history.withColumn(
        "line_no", F.explode(F.sequence("line_from", "line_to"))
    ).drop("line_from", "line_to")
    keys = shared(["repo", "file"], line_history)
    return keep_last(lines, [*keys, "line_no"], F.struct("committed_at", "commit_id"))


def asked_owners(line_history: DataFrame, issues: DataFrame) -> DataFrame:
    """:func:`line_owners` of the lines that issues (file, line_no) ask about.

    Changes and lines meet by blocks of lines, and only changes to asked blocks are looked
    at, so a change to a long range costs a row per block and no history is spread out line
    by line."""
    keys = shared(["repo", "file"], line_history, issues)
    block = F.floor(F.col("line_no") / LINE_BLOCK).cast("long").alias("block")
    lines = issues.where(F.col("line_no").isNotNull()).select(*keys, "line_no", block).distinct()
    changes = line_history.join(lines.select(*keys).distinct(), keys, "left_semi").withColumn(
        "block", F.explode(F.sequence(
            F.floor(F.col("line_from") / LINE_BLOCK).cast("long"), F.floor(F.col("line_to") / LINE_BLOCK).cast("long")))
    )
    facts = changes.join(lines, [*keys, "block"]).where("line_no between line_from and line_to")
    return keep_last(
        facts.drop("block", "line_from", "line_to"), [*keys, "line_no"], F.struct("committed_at", "commit_id")
    )


def blame(issues: DataFrame, owners: DataFrame, *, spread_by: list[str]) -> DataFrame:
    """Issues (file, line_no) with the owner of their line; no owner leaves NULLs."""
    keys = shared(["repo", "file", "line_no"], issues, owners)
    return spread_lookup(issues, owners, keys, spread_by=spread_by, how="left")


def _earlier_max(rows: DataFrame, width: int, levels: int) -> DataFrame:
    """``rows`` (repo if given, file, seq, top) plus ``before``: the greatest ``top`` at a smaller seq
    (a ``top`` that starts with the seq is the row before).

    A prefix scan over ranges: a running maximum inside each range of ``width``, and the
    maximum of all earlier ranges from one summary row per range, found the same way one
    level up. Every group is as small as its range, however many rows a file has.
    """
    keys = shared(["repo", "file"], rows)
    order = Window.partitionBy(*keys, "bucket") if levels else Window.partitionBy(*keys)
    inside = order.orderBy("seq").rangeBetween(Window.unboundedPreceding, -1)
    if not levels:
        return rows.withColumn("before", F.max("top").over(inside))
    split = rows.withColumn("bucket", F.floor(F.col("seq") / width).cast("long"))
    local = split.withColumn("here", F.max("top").over(inside))
    ranges = split.groupBy(*keys, "bucket").agg(F.max("top").alias("top"))
    carried = _earlier_max(
        ranges.withColumnRenamed("bucket", "seq"), width, levels - 1
    ).select(*keys, F.col("seq").alias("bucket"), "before")
    return local.join(carried, [*keys, "bucket"]).select(
        *rows.columns, F.coalesce("here", "before").alias("before")
    )


def version_before(
    commits: DataFrame, versions: DataFrame, *, width: int = SEQ_BUCKET, levels: int = 2
) -> DataFrame:
    """``commits`` (file, seq) plus ``before_seq``: the greatest version of the file with
    a smaller ``seq``, NULL for the first. No commit meets every version of its file."""
    keys = shared(["repo", "file"], commits, versions)
    asked = commits.select(*keys, "seq").distinct()
    points = versions.select(*keys, "seq", F.col("seq").alias("top")).unionByName(
        asked.withColumn("top", F.lit(None).cast("long"))
    )
    merged = points.groupBy(*keys, "seq").agg(F.max("top").alias("top"))
    found = _earlier_max(merged, width, levels).select(
        *keys, "seq", F.col("before").alias("before_seq")
    )
    return commits.join(found, [*keys, "seq"])


def excerpt(content: Column, line_no: Column, context: int = 10) -> Column:
    rows = T.lines(content)
    start = F.greatest(F.lit(1), line_no - context)
    stop = F.least(F.size(rows), line_no + context)
    return F.when(
        stop >= start, F.array_join(F.slice(rows, start, stop - start + 1), "\n")
    ).otherwise(F.when(content.isNotNull(), F.lit("")))


def archaeology(as_of: int) -> Column:
    """The story of one issue as a struct.

    Works on: file, line_no, commit_id (NULL = no owner), author, author_mail, ts_epoch,
    summary, before_content (NULL = no earlier version).
    """
    asked = F.coalesce(F.col("file"), F.lit(""))
    line_no = F.coalesce(F.col("line_no"), F.lit(0))
    days = days_old(F.col("ts_epoch"), as_of)
    short = F.left(F.col("commit_id").cast("string"), F.lit(8))
    missing = (asked == "") | (line_no == 0)
    found = ~missing & F.col("commit_id").isNotNull()
    reason = F.when(missing, fixed.HISTORY_NO_PLACE).when(
        ~found,
        F.format_string(fixed.HISTORY_NO_OWNER, asked, line_no),
    )
    insight = F.format_string(
        fixed.HISTORY_INSIGHT, age_text(days), F.col("author"), short,
        F.left(F.col("summary"), F.lit(60)),
    )

    def known(value: Column) -> Column:
        return F.when(found, value)

    has_before = found & F.col("before_content").isNotNull()
    return F.struct(
        found.alias("investigated"), reason.alias("reason"),
        known(F.col("author")).alias("author"),
        known(F.col("author_mail")).alias("author_email"),
        known(short).alias("commit_hash"), known(F.col("summary")).alias("commit_summary"),
        known(days).alias("days_old"), known(age_text(days)).alias("age_description"),
        F.when(has_before, excerpt(F.col("before_content"), F.col("line_no")))
        .alias("code_before"),
        has_before.alias("had_safe_version"), known(insight).alias("insight"),
    )


def investigate(
    issues: DataFrame, line_history: DataFrame, versions: DataFrame, as_of: int
) -> DataFrame:
    """``issues`` (issue_id, file, line_no, …) plus ``archaeology``.

    ``line_history`` also carries author, author_mail, ts_epoch, summary and
    ``commit_seq``, the place of the commit in the file's history; ``versions``: file,
    seq, content.
    """
    keys = shared(["repo", "file"], issues, line_history, versions)
    # Read three times below.
    owned = cut(blame(issues, asked_owners(line_history, issues), spread_by=["issue_id"]))
    commits = owned.where(F.col("commit_seq").isNotNull()).select(
        *keys, F.col("commit_seq").alias("seq")
    ).distinct()
    known = versions.join(commits.select(*keys).distinct(), keys, "left_semi")
    before = version_before(commits, known.select(*keys, "seq"))
    text = before.join(
        known.select(*keys, F.col("seq").alias("before_seq"),
                     F.col("content").alias("before_content")),
        [*keys, "before_seq"],
    ).select(*keys, F.col("seq").alias("commit_seq"), "before_content")
    told = spread_lookup(
        owned, text, [*keys, "commit_seq"], spread_by=["issue_id"], how="left"
    )
    return told.select(*issues.columns, archaeology(as_of).alias("archaeology"))


def attach(issues: DataFrame, investigated: DataFrame) -> DataFrame:
    """Copy each story to every issue of its chunk; the last one of a chunk wins.

    ``investigated``: repo where issues have one, chunk_id, seq, archaeology.
    """
    keys = [k for k in ("repo", "chunk_id") if k in issues.columns]
    stories = keep_last(
        investigated.select(*keys, "seq", "archaeology"), keys, F.col("seq")
    ).drop("seq")
    return spread_lookup(issues, stories, keys, spread_by=["issue_id"], how="left")


def counters(investigated: DataFrame) -> DataFrame:
    return investigated.agg(
        F.count_if("archaeology.investigated").alias("investigated"),
        F.count(F.lit(1)).alias("asked"),
    )
