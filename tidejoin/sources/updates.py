"""Update sets and bulk loads as signed changelogs.

A changelog has the columns of its relation, ``op`` (+1 or -1), and ``batch``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import written
from .tables import tbl_schema

#: Order of a bulk load, from the last dimension to the fact table.
LOAD_ORDER = ("nation", "customer", "orders", "lineitem")


def bulk(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Every row as an INSERT, a batch per table in load order."""
    return {name: tables[name].withColumn("op", F.lit(1)).withColumn("batch", F.lit(k).cast("long")) for k, name in enumerate(LOAD_ORDER) if name in tables}


def pair_lines(spark: SparkSession, files: list[tuple[str, int]], relation: str, root: str | None = None) -> DataFrame:
    """Update files (path, batch) in which the lines that aren't blank are DELETE and INSERT in turn.

    The place of a line within its file decides; files are independent, and large ones are read in splits.  ``root``: a
    folder that holds the files, of which some may be missing.
    """
    out = numbered_lines(spark, files, root)
    if out is None:
        return spark.createDataFrame([], tbl_schema(relation)).withColumn("op", F.lit(1)).withColumn("batch", F.lit(0).cast("long"))
    return paired(out, relation)


def paired(lines: DataFrame, relation: str) -> DataFrame:
    """Numbered lines of one relation as a changelog: odd ones are deletes."""
    field = F.split("line", r"\|", -1)
    columns = [field[i].cast(f.dataType).alias(f.name) for i, f in enumerate(tbl_schema(relation))]
    return lines.select(*columns, F.when(F.col("n") % 2 == 1, -1).otherwise(1).alias("op"), "batch")


def _name(level: int) -> Column:
    """The last part of the file's path, or the one before."""
    return F.regexp_extract("file", "([^/]+)" + "/[^/]+" * level + "$", 1)


def numbered_lines(spark: SparkSession, files: list[tuple[str, int]], root: str | None = None) -> DataFrame | None:
    """``file, block, line, n, batch``: the lines that aren't blank, numbered from 1 within their file, by one scan of all
    files.  A path may be a folder of files; last parts of paths differ."""
    if not files:
        return None
    batches = {path.rstrip("/").rpartition("/")[2]: batch for path, batch in files}
    if len(batches) < len(files):
        raise ValueError("files of one name can't be told apart")
    text = spark.read.text(root, lineSep="\n", recursiveFileLookup=True) if root else spark.read.text([p for p, _ in files], lineSep="\n")
    of = F.create_map(*[F.lit(x) for pair in batches.items() for x in pair])
    return numbered(located(text), batch=F.coalesce(F.try_element_at(of, _name(0)), F.try_element_at(of, _name(1))).cast("long"))


def located(text: DataFrame) -> DataFrame:
    """``file, block, line``: the lines of a text scan that aren't blank, with the split that they are read in."""
    lines = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.when(F.col("value").contains("\r"), F.regexp_replace("value", "\r$", "")).otherwise(F.col("value")).alias("line"))
    return lines.where(F.trim("line") != "")


def numbered(lines: DataFrame, **of_file: Column) -> DataFrame:
    """Located lines with ``n``, from 1 within their file, and columns made from the file's name, once per split.

    A split is read in order by one task, so the lines are written once with their places in their tasks, and a number is
    that place moved by the counts of the splits before: no line is shuffled or sorted.
    """
    split = ["file", "block"]
    placed = written(lines.withColumn("_id", F.monotonically_increasing_id()), "lines")
    sizes = placed.groupBy(*split).agg(F.count("*").alias("_size"), F.min("_id").alias("_first"))
    before = F.sum("_size").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    # a row per split
    starts = F.broadcast(sizes.select(*split, (F.coalesce(before, F.lit(0)) - F.col("_first") + 1).alias("_shift"), *[c.alias(n) for n, c in of_file.items()]))
    return placed.join(starts, split).select(*lines.columns, (F.col("_shift") + F.col("_id")).alias("n"), *of_file)


#: Relations that have update files.
RELATIONS = ("orders", "lineitem")
#: Update files, or folders of part files, by name: relation and number of the set.
SET_NAME = r"/(orders|lineitem)\.tbl\.u([0-9]+)(?:/[^/]*)?$"


def update_lines(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """The update files of a folder as a stream of ``file, block, line``; sets that come later are taken when they come."""
    reader = spark.readStream.format("text").option("lineSep", "\n")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return located(reader.load(f"{path}/*.tbl.u*"))


def changelogs_of(lines: DataFrame, wanted: dict[str, Callable[[], Column] | None] | None = None) -> dict[str, DataFrame]:
    """A micro-batch of ``update_lines`` as a changelog per relation; ``batch`` is the number of the set.

    ``wanted``: filters of relations, that are asked again later.  A line that fails its filter is counted, but neither its
    text nor its relation is found and written.
    """
    # the relation stands in each line's row, so that no later filter parses lines of the other before it is asked
    kept = {"line": F.col("line"), "relation": F.regexp_extract("file", SET_NAME, 1)}
    named = unfailed(lines, wanted or {}).select("file", "block", *[F.when(F.col("keep"), c).alias(n) for n, c in kept.items()])
    rows = numbered(named, batch=F.regexp_extract("file", SET_NAME, 2).cast("long")).where("line is not null")
    return {r: paired(rows.where(F.col("relation") == r), r) for r in RELATIONS}


def unfailed(lines: DataFrame, wanted: dict[str, Callable[[], Column] | None]) -> DataFrame:
    """Located lines with ``keep``: false if the filter of the line's relation surely drops it.

    It raises no error: a field that is missing or bad, or a path that names both relations, keeps the line for a stricter
    look.  Only the filters' columns are parsed, without splitting the line.
    """
    # each step is a projection of its own, so that nothing is computed twice; columns that no filter asks for go
    named = lines.withColumns({f"_{r}": F.col("file").contains(f"/{r}.tbl.u") for r in RELATIONS})
    passes = F.lit(None).cast("boolean")
    upto, fields = {}, {}
    for r in RELATIONS:
        if (where := wanted.get(r)) is not None:
            own = reduce(lambda a, b: a & b, [F.col(f"_{n}") if n == r else ~F.col(f"_{n}") for n in RELATIONS])
            for i, f in enumerate(tbl_schema(r)):
                upto[f"_{f.name}"] = F.when(own, F.substring_index("line", "|", i + 1))
                whole = F.octet_length(f"_{f.name}") < F.octet_length("line")
                fields[f.name] = F.when(whole, F.substring_index(f"_{f.name}", "|", -1)).try_cast(f.dataType)
            passes = F.when(own, where()).otherwise(passes)
    return named.withColumns(upto).withColumns(fields).select(*lines.columns, F.coalesce(passes, F.lit(True)).alias("keep"))


def update_sets(spark: SparkSession, path: str, relations: tuple[str, ...] = ("orders", "lineitem"), first_batch: int = len(LOAD_ORDER), layout: str = "pairs", tables: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """Sets 1, 2, ... of ``<relation>.tbl.u<N>``, until no relation has a file of that number; one batch each.

    ``layout="refresh"`` reads inserts from ``<relation>.tbl.u<N>`` and order keys to delete from ``delete.<N>``;
    the rows to delete are then looked up in ``tables``.
    """
    have = _names(spark, path)
    found: dict[str, list[tuple[str, int]]] = {r: [] for r in relations}
    deletes: list[tuple[str, int]] = []
    for n in count(1):
        own = [r for r in relations if f"{r}.tbl.u{n}" in have]
        gone = layout == "refresh" and f"delete.{n}" in have
        if not own and not gone:
            break
        for r in own:
            found[r].append((f"{path}/{r}.tbl.u{n}", first_batch + n - 1))
        if gone:
            deletes.append((f"{path}/delete.{n}", first_batch + n - 1))
    if layout == "pairs":
        return {r: pair_lines(spark, files, r) for r, files in found.items()}
    return {r: _refresh(spark, r, files, deletes, tables or {}) for r, files in found.items()}


def _refresh(spark: SparkSession, relation: str, inserts: list[tuple[str, int]], deletes: list[tuple[str, int]], tables: dict[str, DataFrame]) -> DataFrame:
    """Inserted rows, and the rows known before its batch for each key to delete: one scan of the inserts, one of the keys."""
    schema = tbl_schema(relation)
    key, names = "o_orderkey" if relation == "orders" else "l_orderkey", [f.name for f in schema]
    field = F.split("line", r"\|", -1)
    lines = numbered_lines(spark, inserts)
    if lines is None:
        inserted = spark.createDataFrame([], schema).withColumn("op", F.lit(1)).withColumn("batch", F.lit(0).cast("long"))
    else:
        inserted = lines.select(*[field[i].cast(f.dataType).alias(f.name) for i, f in enumerate(schema)], F.lit(1).alias("op"), "batch")
    gone = numbered_lines(spark, deletes)
    if gone is None:
        return inserted
    gone = gone.select(field[0].cast("long").alias("_key"), F.col("batch").alias("_batch")).distinct()
    known = inserted.select(*names, "batch")
    if relation in tables:
        known = known.unionByName(tables[relation].select(*names, F.lit(-1).cast("long").alias("batch")))
    dead = known.join(gone, (F.col(key) == F.col("_key")) & (F.col("batch") < F.col("_batch")))
    return inserted.unionByName(dead.select(*names, F.lit(-1).alias("op"), F.col("_batch").alias("batch")))


def _names(spark: SparkSession, path: str) -> set[str]:
    """What a folder holds, by one listing."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return {f.getPath().getName() for f in fs.listStatus(at)} if fs.exists(at) else set()
