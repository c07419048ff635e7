"""Extraction as DataFrame operations: sources (unit, file, file_order, text) to facts and locations."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..llm.shared import materialise, only_wanted
from .binder import Outline, build, build_part, outline

RESULT = "unit string, kind string, s string, p string, o string, file string, start_line int, end_line int"
#: Characters of code that one task reads of a unit; larger units are spread.
PART_CHARS = 4_000_000
#: Characters of a task that reads several units, or files of several parts.
TASK_CHARS = 500_000
_KEYS = pa.list_(pa.int64())
_OUTLINE = (pa.binary(), _KEYS, _KEYS, _KEYS, _KEYS, _KEYS, pa.bool_())


def _result(unit: str, facts: list, places: list) -> pa.Table:
    n, m = len(facts), len(places)
    texts = lambda values: pa.array(values, pa.string())
    columns = {"unit": texts([unit] * (n + m)), "kind": texts(["fact"] * n + ["place"] * m), "s": texts([f[0] for f in facts] + [p[0] for p in places])}
    columns |= {c: texts([f[i] for f in facts] + [None] * m) for c, i in (("p", 1), ("o", 2))}
    columns |= {c: pa.array([None] * n + [p[i] for p in places], t) for c, i, t in (("file", 1, pa.string()), ("start_line", 2, pa.int32()), ("end_line", 3, pa.int32()))}
    return pa.table(columns)


def _ordered(table: pa.Table, *columns: str) -> list[dict]:
    return sorted(table.select(["file_order", "file", *columns]).to_pylist(), key=lambda r: (r["file_order"], r["file"]))


def extract(sources: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """Facts (kind = fact) and places (kind = place) of every unit.

    A body can only be read when the declarations that it names are known.  A
    unit of up to `part_chars` characters is read by one task.  A larger one is
    spread: its files are outlined one by one (declarations without code), and
    parts of about `part_chars` characters are read side by side, each with the
    outlines of the files that its own ones need (`needed`).  Null texts declare
    nothing; rows with a null unit are left out.
    """
    rows = sources.where("unit is not null").select("unit", "file", "file_order", F.coalesce("text", F.lit("")).alias("text"))
    sizes = rows.groupBy("unit").agg(F.sum(F.length("text")).alias("chars")).withColumn("parts", F.ceil(F.col("chars") / part_chars).cast("int"))
    # code takes far longer than its bytes tell: tasks are counted by characters, or few small partitions would be merged
    least = rows.sparkSession.sparkContext.defaultParallelism
    tasks = {r.large: max(least, r.parts, r.chars // TASK_CHARS) for r in sizes.groupBy((F.col("parts") > 1).alias("large")).agg(F.sum("parts").alias("parts"), F.sum("chars").alias("chars")).where("parts > 0").collect()}
    # a unit's number of parts is one row; units can be as many as files
    sized = rows.join(sizes.drop("chars"), "unit")

    def whole(key, table):
        return _result(key[0].as_py(), *build([(r["file"], r["text"]) for r in _ordered(table, "text")]))

    small = sized.where("parts <= 1").drop("parts").repartition(tasks.get(False, least), "unit").groupBy("unit").applyInArrow(whole, RESULT)
    if True not in tasks:
        return small

    def outlines(batches):
        for batch in batches:
            made = [outline(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, t) for x, t in zip(zip(*made), _OUTLINE))], names=[*batch.schema.names, *Outline._fields])

    # a unit's files are dealt to many tasks, each file to one part of its unit
    dealt = sized.where("parts > 1").repartition(tasks[True], "unit", "file", "file_order").withColumn("part", F.pmod(F.xxhash64("file", "file_order"), F.col("parts")).cast("int"))
    made = dealt.mapInArrow(outlines, "unit string, file string, file_order int, text string, parts int, part int, data binary, declares array<bigint>, needs array<bigint>, signs array<bigint>, types array<bigint>, spaces array<bigint>, deep boolean")
    made = materialise(made.withColumn("row", F.monotonically_increasing_id()), "outlines")
    lent = needed(made).join(made.select("row", "file", "file_order", "data"), "row")
    given = made.select("row", "unit", "part", "file", "file_order", "data", "text").unionByName(lent.withColumn("text", F.lit(None).cast("string")))

    def part(key, table):
        files = _ordered(table, "row", "data", "text")
        own = {k: r["text"] for k, r in enumerate(files) if r["text"] is not None}
        return _result(key[0].as_py(), *build_part([(r["file"], r["data"]) for r in files], own))

    spread = given.repartition(tasks[True], "unit", "part").groupBy("unit", "part").applyInArrow(part, RESULT).select(*small.columns)
    return small.unionByName(spread)


def needed(made: DataFrame) -> DataFrame:
    """row, unit, part: the files that a part's own ones need, by themselves or through other files; see Outline.

    Each round adds the files that declare what the last ones name.
    """
    declared = made.select("unit", F.explode("declares").alias("key"), "row")
    clash = made.select("unit", F.explode("types").alias("key")).join(made.select("unit", F.explode("spaces").alias("key")), ["unit", "key"], "left_semi")
    entire = materialise(clash.select("unit").unionByName(made.where("deep").select("unit")).distinct(), "entire")
    own = made.select("row", "unit", "part")
    all_parts = made.join(entire, "unit", "left_semi").select("row", "unit", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("to"))
    known = [all_parts.where("part <> to").select("row", "unit", F.col("to").alias("part"))]
    front = made.join(entire, "unit", "left_anti").select("unit", "part", F.explode("needs").alias("key"))
    while True:
        found = only_wanted(front, declared, "unit", "key").join(declared, ["unit", "key"]).select("row", "unit", "part").distinct()
        for rows in (own, *known[1:]):
            found = found.join(rows, ["row", "unit", "part"], "left_anti")
        found = materialise(found, "needed")
        if found.isEmpty():
            return reduce(DataFrame.unionByName, known)
        known.append(found)
        front = found.join(made.select("row", F.explode("signs").alias("key")), "row").select("unit", "part", "key").distinct()


def facts_of(extracted: DataFrame) -> DataFrame:
    return extracted.where("kind = 'fact'").select("unit", "s", "p", "o")


def locations_of(extracted: DataFrame) -> DataFrame:
    return extracted.where("kind = 'place'").select("unit", F.col("s").alias("fragment"), "file", "start_line", "end_line")
