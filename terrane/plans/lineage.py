"""Chains of changes: each file names the state before and after it. Checks on chains, duplicate versions, history and file trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import require
from ..sources.checkpoints import cut


def chain(files: DataFrame) -> DataFrame:
    """file, parent, current, status (ok, fork, broken), follows (whether it is ok), in file order. files: file, parent, current.

    The first file starts the chain, whatever its parent. Another file is in order if its parent is the state that the file before it left. If not, and an
    earlier file had the same parent, it is a fork.
    """
    # ranges of files are looked at by themselves, and joined to the state that the range before leaves
    ranges = cut(files.select("file", "parent", "current").repartitionByRange("file").withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_part").orderBy("file")
    ends = ranges.groupBy("_part").agg(F.max_by("current", "file").alias("_last"))
    left = ends.select("_part", F.lag("_last").over(Window.orderBy("_part")).alias("_left"), (F.row_number().over(Window.orderBy("_part")) == 1).alias("_begins"))  # a row a range
    placed = ranges.withColumns({"_place": F.row_number().over(inside), "_lag": F.lag("current").over(inside)}).join(F.broadcast(left), "_part")
    before = F.when(F.col("_place") == 1, F.col("_left")).otherwise(F.col("_lag"))
    first = F.col("_begins") & (F.col("_place") == 1)
    # forks are told by a plain column, never null and unique on the other side: who asks only which files follow gets a plan without this join
    parent = F.coalesce(F.concat(F.lit("="), F.col("parent")), F.lit("")).alias("_parent")
    earliest = ranges.groupBy(parent).agg(F.min("file").alias("_earliest"))
    links = placed.select("file", "parent", "current", parent, (first | F.col("parent").eqNullSafe(before)).alias("follows")).join(earliest, "_parent", "left")
    status = F.when(F.col("follows"), "ok").when(F.col("file") > F.col("_earliest"), "fork").otherwise("broken")
    return links.select("file", "parent", "current", status.alias("status"), "follows")


def problem(files: DataFrame) -> DataFrame:
    """code, file: the first file out of order, if there is one; if it is a fork, every file with the same parent, whether before or after it."""
    links = chain(files)
    first = links.where("status <> 'ok'").orderBy("file").limit(1).select(F.col("status").alias("code"), F.col("parent").alias("_parent"), F.col("file").alias("_file"))
    same = (F.col("file") == F.col("_file")) | (F.col("code") == "fork") & F.col("parent").eqNullSafe(F.col("_parent"))
    return files.join(F.broadcast(first), same).select("code", "file")


def version(file: Column) -> Column:
    """The part of a file's name before the first underscore."""
    return F.regexp_extract(file, r"^([^_]+)_", 1)


def duplicate_versions(files: DataFrame) -> DataFrame:
    """version, files: versions that several files have."""
    by = files.groupBy(version(F.col("file")).alias("version")).agg(F.array_sort(F.collect_set("file")).alias("files"))
    return by.where((F.size("files") > 1) & (F.col("version") != ""))


def renumber(group: list[tuple[str, str | None, str]], taken: set[str]) -> list[tuple[str, str]]:
    """(old file, new file) for files of one version: in chain order, the first keeps its version, the others get the next free ones."""
    current = {c for _, _, c in group}
    start = [g for g in group if g[1] not in current]
    require(len(start) == 1 and len({p for _, p, _ in group}) == len(group), "no-chain-order", "the files don't follow one another")
    by_parent = {p: (f, c) for f, p, c in group}
    out, at, used = [], start[0][1], set(taken)
    for k in range(len(group)):
        require(at in by_parent, "no-chain-order", "the files don't follow one another")
        file, at = by_parent[at]
        old, rest = file.split("_", 1)
        new = old
        if k:
            while new in used:
                new = str(int(new) + 1).zfill(len(old))
            out.append((file, f"{new}_{rest}"))
        used.add(new)
    return out


def banner(text: Column) -> Column:
    """Struct (parent, current) of a change file's header lines."""
    parent, current = (F.regexp_extract(text, rf"(?m)^-- {k}: ([0-9a-f]+)$", 1) for k in ("parent", "current"))
    return F.struct(F.when(parent != "", parent).alias("parent"), F.when(current != "", current).alias("current"))


#: How a change of each operation starts its line in a header.
MARKS = {"create": "+", "alter": "~", "drop": "-"}


def headers(changes: DataFrame, states: DataFrame) -> DataFrame:
    """file, text: the header of each change file, a line for each change in order of place, then the states before and after, as banner() reads them.

    changes: file, place, kind, identity, operation, notes (array, may be null). states: file, parent, current (hex; a
    null parent has no line). A file without changes has the states only.
    """
    mark = F.element_at(F.create_map(*(F.lit(x) for pair in MARKS.items() for x in pair)), F.col("operation"))
    notes = F.when(F.size("notes") > 0, F.concat(F.lit(" ["), F.array_join("notes", ", "), F.lit("]"))).otherwise("")
    line = F.concat(F.lit("-- "), mark, F.lit(" "), F.col("kind"), F.lit(" "), F.col("identity"), notes)
    # a file's changes are what one step of a catalog changes
    lines = changes.select("file", F.struct("place", line.alias("line")).alias("x")).groupBy("file").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    both = states.join(lines, "file", "left")
    body = F.coalesce(F.transform("xs", lambda x: x.line), F.array().cast("array<string>"))
    end = F.array(*(F.when(F.col(k).isNotNull(), F.concat(F.lit(f"-- {k}: "), F.col(k))) for k in ("parent", "current")))
    return both.select("file", F.array_join(F.concat(body, F.filter(end, lambda x: x.isNotNull())), "\n").alias("text"))


def slug(first: tuple[str, str] | None) -> str:
    """A file's name from its first change (operation, identity): add_posts, alter_posts, drop_posts."""
    if first is None:
        return "migration"
    operation, identity = first
    return f"{'add' if operation == 'create' else operation}_{identity.rsplit('.', 1)[-1]}"


def history(files: DataFrame, commits: DataFrame) -> DataFrame:
    """file, state: of files now there or ever committed. files: file, hash. commits: file, hash, at.

    uncommitted: never committed; lost: committed, but gone; rewritten: differs from its last commit; ok.
    """
    last = commits.groupBy("file").agg(F.max(F.struct("at", "hash")).alias("x")).select("file", F.col("x.hash").alias("committed"))
    both = files.select("file", F.col("hash").alias("now")).join(last, "file", "full_outer")
    state = F.when(F.col("committed").isNull(), "uncommitted").when(F.col("now").isNull(), "lost").when(F.col("now") != F.col("committed"), "rewritten").otherwise("ok")
    return both.select("file", state.alias("state"))


def tree_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, operation: of two trees of (path, hash)."""
    a, b = before.select("path", F.col("hash").alias("x")), after.select("path", F.col("hash").alias("y"))
    both = a.join(b, "path", "full_outer").where(~F.col("x").eqNullSafe(F.col("y")))
    return both.select("path", F.when(F.col("x").isNull(), "add").when(F.col("y").isNull(), "remove").otherwise("change").alias("operation"))


def verify(files: DataFrame, stored: DataFrame, rebuilt: DataFrame, tip: str) -> DataFrame:
    """check, status (ok, failed, skipped), n. A check that depends on a failed one is skipped.

    versions: no version twice; chain: every file follows the one before; rebuild: the declarations
    give the stored snapshot again; tip: the chain's last state is that of the snapshot.
    """
    from . import snapshot as S

    spark = files.sparkSession
    n_versions = duplicate_versions(files).count()
    n_chain = last = None
    if not n_versions:
        # one pass for both: files that don't follow, and the state that the last file leaves
        n_chain, last = chain(files).agg(F.count_if(~F.col("follows")), F.max_by("current", F.struct("file"))).first()
    n_rebuild = S.diff(stored, rebuilt).count()
    n_tip = None if n_versions or n_chain or n_rebuild else int(last != tip)
    rows = [("versions", n_versions), ("chain", n_chain), ("rebuild", n_rebuild), ("tip", n_tip)]
    return spark.createDataFrame([(c, "skipped" if n is None else "failed" if n else "ok", n) for c, n in rows], "check string, status string, n int")
