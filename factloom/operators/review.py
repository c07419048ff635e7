"""The review stage: describe candidates, ask a model once for each new content, drop what it rejects."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .models import Model, ScriptedModel, create_model
from .rubrics import RUBRICS

__all__ = ["Model", "ScriptedModel", "create_model"]

#: Most lines of one excerpt, lines looked ahead for a closing brace, and adjudications in flight.
MOST_LINES, LOOK_AHEAD, PARALLEL = 400, 2000, 8

OUTCOMES = ("confirmed", "uncertain", "rejected")


def cache_key(model: Column, system: Column, pattern: Column, fragments: Column, source: Column) -> Column:
    """Lower-case hex SHA-256 of a candidate's content; the order of its fragments doesn't matter.

    Fixed by the cache's format: the parts follow each other without a separator.
    """
    return F.sha2(F.concat(model, system, pattern, F.array_join(F.array_sort(fragments), ","), source), 256)


def excerpts(lines: DataFrame, spans: DataFrame) -> DataFrame:
    """(file, start_line, end_line, excerpt): the text of each span.

    lines: (file, line from 1, text); spans: (file, start_line, end_line).  A
    span of one line is widened to the line that closes the braces it opens,
    at most LOOK_AHEAD lines on, and stays as it is if none does; braces in
    strings and comments count too.  An excerpt has MOST_LINES lines at most.
    Lines are joined in blocks of LOOK_AHEAD, so a span meets the lines of its
    own block and the next, not those of its whole file.
    """
    wanted = spans.select("file", "start_line", "end_line").distinct()
    last = F.greatest(F.col("end_line"), F.col("start_line") + LOOK_AHEAD)
    block = lambda c: F.floor(c / LOOK_AHEAD)
    wanted = wanted.withColumn("block", F.explode(F.sequence(block(F.col("start_line")), block(last))))
    near = wanted.join(lines.withColumn("block", block(F.col("line"))), ["file", "block"]).where((F.col("line") >= F.col("start_line")) & (F.col("line") <= last))
    opens, closes = F.length("text") - F.length(F.replace("text", F.lit("{"), F.lit(""))), F.length("text") - F.length(F.replace("text", F.lit("}"), F.lit("")))
    sofar = Window.partitionBy("file", "start_line", "end_line").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    near = near.withColumns({"opened": F.sum(opens).over(sofar), "depth": F.sum(opens - closes).over(sofar)})
    closing = F.min(F.when((F.col("opened") > 0) & (F.col("depth") <= 0), F.col("line")))
    kept = near.groupBy("file", "start_line", "end_line").agg(closing.alias("close"), F.array_sort(F.collect_list(F.struct("line", "text"))).alias("ls"))
    last = F.when(F.col("start_line") == F.col("end_line"), F.coalesce("close", "end_line")).otherwise(F.col("end_line"))
    body = F.filter("ls", lambda x: (x["line"] <= last) & (x["line"] < F.col("start_line") + MOST_LINES))
    return kept.select("file", "start_line", "end_line", F.array_join(F.transform(body, lambda x: x["text"]), "\n").alias("excerpt"))


def described(reported: DataFrame, root: str = "") -> DataFrame:
    """Adds description: the candidate's pattern and one line for each role, with its place where known."""
    place = lambda r: F.when(r["file"].isNotNull(), F.concat(F.lit(" ("), F.regexp_replace(r["file"], F.lit("^" + re.escape(root) + "/?"), F.lit("")), F.lit(":"), r["start_line"].cast("string"), F.lit(")"))).otherwise(F.lit(""))
    lines = F.transform("roles", lambda r: F.concat(F.lit("- "), r["role"], F.lit(": "), r["label"], place(r)))
    return reported.withColumn("description", F.concat(F.lit("CANDIDATE "), F.col("pattern"), F.lit("\n"), F.array_join(lines, "\n")))


def sources_of(reported: DataFrame, texts: DataFrame) -> DataFrame:
    """Adds source: the excerpts of a match's roles, one for each place, in role order; null if none can be read."""
    roles = reported.select("unit", "pattern", "match_id", F.posexplode("roles").alias("k", "r")).where("r.file is not null")
    roles = roles.select("unit", "pattern", "match_id", "k", F.col("r.file").alias("file"), F.col("r.start_line").alias("start_line"), F.col("r.end_line").alias("end_line"))
    found = roles.join(texts, ["file", "start_line", "end_line"]).where("excerpt is not null")
    first = found.groupBy("unit", "pattern", "match_id", "file", "start_line").agg(F.min(F.struct("k", "excerpt")).alias("e"))
    joined = first.groupBy("unit", "pattern", "match_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["excerpt"]), "\n\n").alias("source"))
    return reported.join(joined, ["unit", "pattern", "match_id"], "left")


def system_prompt(pattern: str, rubric: str | None) -> str:
    """What the model is told of a pattern, the same for all its candidates."""
    what = re.sub(r"\s+", " ", rubric).strip() if rubric else f"the classic collaboration named {pattern}, judged by the roles' intent and not their names"
    return f"Decide whether the candidate is an instance of {pattern}: {what} Reply with a JSON object: verdict (confirmed, rejected or uncertain) and rationale."


def prompts(reported: DataFrame) -> DataFrame:
    """Adds system and, from description and source, prompt; the table of patterns is a constant."""
    spark = reported.sparkSession
    systems = spark.createDataFrame([(p, system_prompt(p, r)) for p, r in RUBRICS.items()], "pattern string, system string")
    return reported.join(F.broadcast(systems), "pattern", "left").withColumn("prompt", F.concat(F.col("description"), F.lit("\n\nSOURCE\n"), F.coalesce("source", F.lit(""))))


def candidates(reported: DataFrame, sources: DataFrame, root: str = "") -> DataFrame:
    """Reported matches with fragments, description, source, system and prompt.

    sources: (file, text), the scanned files; a file of several units is read once.
    """
    files = sources.select("file", "text").dropDuplicates(["file"])
    lines = files.select("file", F.posexplode(F.split("text", "\n")).alias("k", "text")).select("file", (F.col("k") + 1).alias("line"), "text")
    spans = reported.select(F.explode("roles").alias("r")).where("r.file is not null").select("r.file", "r.start_line", "r.end_line")
    described_ = described(reported, root).withColumn("fragments", F.transform("roles", lambda r: r["fragment"]))
    return prompts(sources_of(described_, excerpts(lines, spans)))


def parsed(reply: Column) -> Column:
    """struct<outcome, rationale> of a reply: the outermost braces as JSON; uncertain where that says nothing known."""
    found = F.from_json(F.regexp_extract(reply, "(?s)\\{.*\\}", 0), "verdict string, rationale string", {"mode": "PERMISSIVE"})
    verdict = F.lower(F.trim(found["verdict"]))
    outcome = F.when(verdict.isin(*OUTCOMES), verdict).otherwise(F.lit("uncertain"))
    return F.struct(outcome.alias("outcome"), F.coalesce(found["rationale"], F.lit("")).alias("rationale"))


def adjudicate(candidates: DataFrame, model: Model, parallel: int = PARALLEL) -> DataFrame:
    """candidates (key, system, prompt) -> key, outcome, rationale, model, tokens_in, tokens_out, error.

    One question for each key, `parallel` tasks at a time; a failed question
    leaves its error and no outcome.
    """
    name = model.name

    def run(batches):
        for batch in batches:
            out = []
            for key, system, prompt in zip(*(batch.column(k).to_pylist() for k in range(3))):
                try:
                    reply, n_in, n_out = model.complete(system, prompt)
                    out.append((key, reply, n_in, n_out, None))
                except Exception as e:  # the match stays, unreviewed
                    out.append((key, None, 0, 0, str(e) or type(e).__name__))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["key", "reply", "tokens_in", "tokens_out", "error"])

    asked = candidates.select("key", "system", "prompt").dropDuplicates(["key"]).repartition(parallel)
    got = asked.mapInArrow(run, "key string, reply string, tokens_in long, tokens_out long, error string").withColumn("v", F.when(F.col("error").isNull(), parsed(F.col("reply"))))
    return got.select("key", "v.outcome", "v.rationale", F.lit(name).alias("model"), "tokens_in", "tokens_out", "error")


def review(candidates: DataFrame, cache: DataFrame, model: Model, keep_rejected: bool = False, parallel: int = PARALLEL) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept matches, tally, new cache entries) of candidates (unit, pattern, match_id, fragments, system, prompt, source).

    What the cache (key, outcome, rationale, model) knows costs no question.
    Candidates without readable source are never asked about and stay.
    """
    from ..shared import checkpoint

    key = cache_key(F.lit(model.name), F.col("system"), F.col("pattern"), F.col("fragments"), F.col("source"))
    keyed = candidates.withColumn("key", F.when(F.col("source").isNotNull(), key))
    known = cache.select("key", "outcome", "rationale", "model").dropDuplicates(["key"])
    missing = keyed.where("key is not null").join(known, "key", "left_anti")
    asked = checkpoint(adjudicate(missing, model, parallel))
    answers = known.withColumns({"hit": F.lit(True), "tokens_in": F.lit(0).cast("long"), "tokens_out": F.lit(0).cast("long"), "error": F.lit(None).cast("string")}).unionByName(asked.withColumn("hit", F.lit(False)))
    # of candidates with one key, the first carries the tokens; those without source have no key and no window
    first = F.row_number().over(Window.partitionBy("key").orderBy("unit", "pattern", "match_id")) == 1
    tokens = lambda c: F.when(F.col("_first"), F.col(c)).otherwise(F.lit(0))
    judged = keyed.where("key is not null").withColumn("_first", first).join(answers, "key", "left")
    judged = judged.withColumns({"tokens_in": tokens("tokens_in"), "tokens_out": tokens("tokens_out")}).drop("_first")
    judged = judged.unionByName(keyed.where("key is null"), allowMissingColumns=True)
    judged = judged.withColumn("dropped", F.lit(not keep_rejected) & F.coalesce(F.col("outcome") == "rejected", F.lit(False)))
    fresh = asked.where("error is null").select("key", "outcome", "rationale", "model")
    return judged.where("not dropped"), tally(judged), fresh


@dataclass
class Review:
    """How to review a scan: with which model, what is known already, and what becomes of rejected matches."""

    model: Model
    cache_path: str | None = None
    keep_rejected: bool = False
    parallel: int = PARALLEL


def reviewed(reported: DataFrame, sources: DataFrame, how: Review, root: str = "") -> tuple[DataFrame, dict]:
    """Kept matches with verdict (null where there is none), and the tally.

    New verdicts go to the cache file; as many as questions were asked come to the driver.
    """
    from ..shared import checkpoint
    from ..sources.corpora import load_cache, save_cache

    spark = reported.sparkSession
    entries = load_cache(how.cache_path) if how.cache_path else {}
    rows = [(k, v["outcome"], v.get("rationale") or "", v.get("model") or how.model.name) for k, v in entries.items()]
    cache = spark.createDataFrame(rows, "key string, outcome string, rationale string, model string")
    kept, counts, fresh = review(checkpoint(candidates(reported, sources, root)), cache, how.model, how.keep_rejected, how.parallel)
    verdict = F.when(F.col("outcome").isNotNull(), F.struct("outcome", "rationale", "model"))
    kept = checkpoint(kept.select(*reported.columns, verdict.alias("verdict")))
    summary = counts.first().asDict()
    if how.cache_path:
        entries |= {r.key: {"outcome": r.outcome, "rationale": r.rationale, "model": r.model} for r in fresh.toLocalIterator()}
        save_cache(how.cache_path, entries)
    return kept, {"model": how.model.name} | summary


def tally(judged: DataFrame) -> DataFrame:
    """Counters of a review, one row."""
    is_ = lambda o: F.count_if(F.col("outcome") == o).alias(o)
    return judged.agg(
        F.count_if(F.col("outcome").isNotNull()).alias("reviewed"), is_("confirmed"), is_("uncertain"), is_("rejected"),
        F.count_if("dropped").alias("dropped"), F.count_if(F.col("outcome").isNull()).alias("unreviewed"),
        F.count_if(F.coalesce("hit", F.lit(False))).alias("cache_hits"),
        F.coalesce(F.sum("tokens_in"), F.lit(0)).alias("tokens_in"), F.coalesce(F.sum("tokens_out"), F.lit(0)).alias("tokens_out"),
        F.first("error", ignorenulls=True).alias("failure"),
    )
