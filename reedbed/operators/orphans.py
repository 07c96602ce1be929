"""References to records that do not exist, directly or through an orphaned parent.

A *reference* is a column of a table whose values name records of a *target*. A target lists stretches of
time in which each key is there. A value that is not there at its row's own time is a direct orphan. A
*link* says that a column names rows of another table; rows that name only orphaned rows inherit that, and
so on down the graph of links until nothing new is found.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reedbed.plans.runtime import materialise, shuffle_partitions

COLUMNS = ("table_name", "row_no", "field_name", "period", "kind")


@dataclass(frozen=True)
class Reference:
    """``table.field`` names keys of ``target``."""

    table: str
    field: str
    target: str


@dataclass(frozen=True)
class Link:
    """``child.field`` names rows of ``parent`` by ``parent.key``."""

    child: str
    field: str
    parent: str
    key: str


def stretches(df: DataFrame, key: str, added: str | None = None, removed: str | None = None) -> DataFrame:
    """Columns key, added, removed of a target table; without ``added`` and ``removed``, always there."""
    none = F.lit(None).cast("timestamp_ntz")
    return df.select(
        F.col(key).alias("key"),
        (F.col(added) if added else none).alias("added"),
        (F.col(removed) if removed else none).alias("removed"),
    ).where(F.col("key").isNotNull())


def key_states(target: DataFrame) -> DataFrame:
    """One row for each key: the first of its starts (null: from the start), and whether it is always there.

    Rows are aggregated before the shuffle, so a key that holds a third of them costs one row for each partition."""
    states = target.groupBy("key").agg(
        F.min("added").alias("first_added"),
        F.max(F.col("added").isNull()).alias("open"),
        F.max(F.col("added").isNull() & F.col("removed").isNull()).alias("always"),
    )
    return states.select("key", F.when(~F.col("open"), F.col("first_added")).alias("first_added"), "always")


def _judged(refs: DataFrame, target: DataFrame) -> DataFrame:
    """References (code, row_no, at, key) that aren't there, with their kind: (code, row_no, at, verdict).

    A key's state tells those that are missing or come before all of its starts. For the others, starts, ends and references
    of a key lie on one line of time, range-partitioned and sorted, so that one key with its stretches is spread over many
    tasks; how many stretches are open is a running sum, carried over partitions by one row for each partition and key."""
    states = key_states(target)
    known = refs.join(states, "key", "left")
    verdict = F.when(F.col("always").isNull(), F.lit("missing")).when(F.col("at") < F.col("first_added"), F.lit("late"))
    asked = known.withColumn("verdict", verdict).where("verdict IS NOT NULL OR (at IS NOT NULL AND NOT always)")
    real = target.where("added IS NOT NULL OR removed IS NOT NULL").where("added IS NULL OR removed IS NULL OR added < removed").distinct()
    none = [F.lit(None).cast("smallint").alias("code"), F.lit(None).cast("long").alias("row_no"), F.lit(None).cast("string").alias("verdict")]
    changes = F.array(
        F.struct(F.col("added").alias("at"), F.lit(1).alias("delta")), F.struct(F.col("removed").alias("at"), F.lit(-1).alias("delta"))
    )
    moves = real.select("key", F.inline(changes)).where("at IS NOT NULL OR delta = 1").select("key", "at", F.lit(0).alias("kind"), "delta", *none)
    line = moves.unionByName(asked.select("key", "at", F.lit(1).alias("kind"), F.lit(0).alias("delta"), "code", F.col("row_no").cast("long").alias("row_no"), "verdict"))
    order = ["key", "at", "kind", "row_no"]
    line = line.repartitionByRange(shuffle_partitions(refs.sparkSession), *order).sortWithinPartitions(*order)
    line = materialise(line.withColumn("part", F.spark_partition_id()), "timeline")
    here = F.sum("delta").over(Window.partitionBy("part", "key").orderBy("at", "kind", "row_no").rowsBetween(Window.unboundedPreceding, 0))
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = line.groupBy("part", "key").agg(F.sum("delta").alias("n")).select("part", "key", F.sum("n").over(before).alias("carried")).where("carried <> 0")
    counted = line.withColumn("here", here).where("kind = 1").join(carried, ["part", "key"], "left")
    absent = counted.where(F.col("verdict").isNotNull() | (F.col("here") + F.coalesce("carried", F.lit(0)) <= 0))
    return absent.select("code", "row_no", "at", F.coalesce("verdict", F.lit("deleted")).alias("verdict"))


def direct_orphans(
    tables: Mapping[str, DataFrame],
    references: Iterable[Reference],
    targets: Mapping[str, DataFrame],
    row_id: str = "row_no",
    at: str = "made_at",
) -> DataFrame:
    """One row for each reference that is not there: table_name, row_no, field_name, period, kind.

    ``missing``: no target row has the value. Else ``late`` if the row's time is before every start of it,
    else ``deleted``. A null value refers to nothing; an empty string is a value. A row without a time
    counts only if the value is missing, under the period ``unknown``. Repeated rows each count. Empty
    tables give no rows. Columns other than those named are never read, whatever their names.

    The references go to their keys' states, on the outer side of a left join that adaptive execution splits where a key
    is hot; the other side has one row for each key. Those that the state doesn't settle go on to a line of time.
    """
    references = list(references)
    parts = []
    for target in dict.fromkeys(r.target for r in references):
        codes = [r for r in references if r.target == target]
        rows = []
        for name in dict.fromkeys(r.table for r in codes):
            fields = [
                F.struct(F.lit(k).cast("smallint").alias("code"), F.col(f"`{r.field}`").alias("key"))
                for k, r in enumerate(codes)
                if r.table == name
            ]
            rows.append(
                tables[name]
                .select(F.col(row_id).alias("row_no"), F.col(at).alias("at"), F.inline(F.array(*fields)))
                .where(F.col("key").isNotNull())
            )
        named = lambda what, codes=codes: F.element_at(F.array(*[F.lit(getattr(r, what)) for r in codes]), F.col("code") + 1)
        parts.append(
            _judged(reduce(DataFrame.unionByName, rows), targets[target]).select(
                named("table").alias("table_name"),
                "row_no",
                named("field").alias("field_name"),
                F.coalesce(F.date_format("at", "yyyy-MM"), F.lit("unknown")).alias("period"),
                F.col("verdict").alias("kind"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def find_orphans(
    tables: Mapping[str, DataFrame],
    references: Iterable[Reference],
    targets: Mapping[str, DataFrame],
    links: Iterable[Link] = (),
    row_id: str = "row_no",
    at: str = "made_at",
) -> DataFrame:
    """The fixpoint: direct orphans (level 0), then, level by level, rows that inherit it (kind ``inherited``).

    A row inherits if its link's value is the key of at least one parent row and all parent rows with that
    key are orphaned. Each level looks at the keys of the parents found in the level before only, semi-joins the children
    with those that are dead and leaves out rows found already, so it ends also on cyclic links. Columns: those of :func:`direct_orphans` and
    ``level``. A row may have several direct rows (one a field) and at most one inherited row a link.
    """
    direct = direct_orphans(tables, references, targets, row_id, at).withColumn("level", F.lit(0))
    links = [x for x in links if x.child in tables and x.parent in tables]
    if not links:
        return direct
    found = frontier = materialise(direct, "orphans-0")
    level = 0
    while True:
        level += 1
        grown = []
        for link in links:
            of_parent = lambda df, link=link: df.where(F.col("table_name") == link.parent).select("row_no").distinct()
            parent = tables[link.parent].select(
                F.col(row_id).alias("row_no"), F.col(f"`{link.key}`").alias("key")
            ).where(F.col("key").isNotNull())
            touched = parent.join(of_parent(frontier), "row_no", "left_semi").select("key").distinct()
            dead_keys = (
                parent.join(touched, "key", "left_semi")
                .join(of_parent(found).withColumn("dead", F.lit(True)), "row_no", "left")
                .groupBy("key")
                .agg(F.min(F.coalesce("dead", F.lit(False))).alias("dead"))
                .where("dead")
                .select("key")
            )
            known = found.where(
                (F.col("table_name") == link.child) & (F.col("field_name") == link.field) & (F.col("kind") == "inherited")
            ).select("row_no").distinct()
            child = tables[link.child].select(
                F.col(row_id).alias("row_no"), F.col(at).alias("at"), F.col(f"`{link.field}`").alias("key")
            ).where(F.col("key").isNotNull())
            grown.append(
                child.join(dead_keys, "key", "left_semi")
                .join(known, "row_no", "left_anti")
                .select(
                    F.lit(link.child).alias("table_name"),
                    "row_no",
                    F.lit(link.field).alias("field_name"),
                    F.coalesce(F.date_format("at", "yyyy-MM"), F.lit("unknown")).alias("period"),
                    F.lit("inherited").alias("kind"),
                    F.lit(level).alias("level"),
                )
            )
        frontier = materialise(reduce(DataFrame.unionByName, grown), f"orphans-{level}")
        if frontier.isEmpty():
            return found
        found = found.unionByName(frontier)


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans by table, field, period and kind."""
    return orphans.groupBy("table_name", "field_name", "period", "kind").agg(F.count("*").alias("orphans"))
