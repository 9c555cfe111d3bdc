"""Stages over documents as a graph: each declares the tables it needs, and what several need is made once.

A stage's table is written to the shared folder, with its rows counted on the way, so that a lost executor costs a part of one
stage and a trace costs no job of its own. Where a stage fails, the documents it fails for are searched by halves of
a hash of their keys; they go to the dead letters with the error, leave the tables after it, and all others go on.
Only what the documents cause is searched for: where the machines fail, or the store, so does the run.
"""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import PySparkException, PythonException
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.text import extracted_normal, paragraphs_strict
from ..streaming.sinks import shared_folder
from ..streaming.sinks import written as saved
from . import chapters, documents, pacing, passages, plain, scenes, staging


@dataclass(frozen=True)
class Stage:
    """``run`` takes the tables that ``needs`` names, in order, and gives the one that ``makes`` names. All have the graph's key."""

    name: str
    needs: tuple[str, ...]
    makes: str
    run: Callable[..., DataFrame]


@dataclass
class Outcome:
    """Tables by name, dead letters (key, stage, error), and the trace (place, stage, rows_in, rows_out, seconds, jobs, lost)."""

    tables: dict[str, DataFrame]
    dead: DataFrame
    trace: list[dict] = field(default_factory=list)


#: Errors that a row may cause, by their class.
OF_ROWS = ("SparkRuntimeException", "SparkArithmeticException", "SparkArrayIndexOutOfBoundsException", "SparkDateTimeException", "SparkIllegalArgumentException", "SparkNumberFormatException", "SparkUpgradeException", "PythonException")


def of_documents(e: PySparkException) -> bool:
    """Whether the rows of a stage caused its failure, not a machine, the store or the plan."""
    if isinstance(e, PythonException):
        return True
    cause = getattr(e, "_origin", None)
    while cause is not None:
        if cause.getClass().getSimpleName() in OF_ROWS:
            return True
        cause = cause.getCause()
    return False


#: Bytes of a table that a task reads at most: each byte is much work, and few large tasks end far apart.
SPLIT = 8 << 20
_SPLIT, _OPEN = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"


def _bytes(said: str) -> int:
    """Spark's sizes: a number, and a unit or none."""
    number, unit = re.fullmatch(r"(\d+)\s*([kmgt]?)i?b?", said.lower()).groups()
    return int(number) << 10 * " kmgt".index(unit or " ")


class Graph:
    """Stages in any order; ``execute`` runs each after those it needs."""

    def __init__(self, stages: list[Stage], key: str = "doc_id", deepest: int = 40):
        self.stages, self.key, self.deepest = stages, key, deepest
        if len({s.makes for s in stages}) < len(stages):
            raise ValueError("two stages make one table")

    def ordered(self, given) -> list[Stage]:
        """Stages after those they need, else as they are listed; a stage that can never run is an error."""
        made, left, out = set(given), list(self.stages), []
        while left:
            ready = next((s for s in left if made.issuperset(s.needs)), None)
            if ready is None:
                raise ValueError("stages that lack what they need: " + ", ".join(f"{s.name} ({', '.join(n for n in s.needs if n not in made)})" for s in left))
            out.append(ready)
            made.add(ready.makes)
            left.remove(ready)
        return out

    def execute(self, wanted: set[str] | None = None, **given: DataFrame) -> Outcome:
        """Runs all stages, or those that the wanted tables need. Inputs are read by the stages that need them.

        Tables are read in splits of at most SPLIT bytes, so that the cores end a stage at about the same time.
        """
        conf = next(iter(given.values())).sparkSession.conf
        before = {k: conf.get(k) for k in (_SPLIT, _OPEN)}
        try:
            conf.set(_SPLIT, str(min(SPLIT, _bytes(before[_SPLIT]))))
            conf.set(_OPEN, str(min(SPLIT // 16, _bytes(before[_OPEN]))))
            return self._executed(wanted, given)
        finally:
            for k, v in before.items():
                conf.set(k, v)

    def _executed(self, wanted: set[str] | None, given: dict[str, DataFrame]) -> Outcome:
        order = self.ordered(given)
        if wanted is not None:
            need = set(wanted)
            for stage in reversed(order):
                if stage.makes in need:
                    need.update(stage.needs)
            order = [s for s in order if s.makes in need]
        spark = next(iter(given.values())).sparkSession
        folder = f"{shared_folder(spark)}/graph-{uuid.uuid4().hex}"
        tables, rows, trace, dead = dict(given), {}, [], None
        for place, stage in enumerate(order):
            began = time.time()
            frames = [tables[n] for n in stage.needs]
            out = f"{folder}/{stage.makes}"
            schema, written, paths, lost, jobs = None, 0, [], [], 0
            todo = [(0, 0)]
            while todo:
                depth, part = todo.pop()
                own = frames if not depth else [f.filter(F.pmod(F.xxhash64(self.key), F.lit(1 << depth)) == part) for f in frames]
                seen, path = Observation(), f"{out}/depth={depth}/part={part}"
                jobs += 1
                try:
                    # a stage may write tables of its own as it is made
                    made = stage.run(*own)
                    schema = schema or made.schema
                    made.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(path)
                    written += seen.get["n"]
                    paths.append(path)
                except PySparkException as e:
                    if not of_documents(e):
                        raise
                    # whether there is more than one document to tell apart
                    if depth < self.deepest and len(own[0].select(self.key).distinct().head(2)) > 1:
                        todo += [(depth + 1, part), (depth + 1, part + (1 << depth))]
                    else:
                        lost.append((depth, part, str(e).splitlines()[0][:300]))
            schema = schema or stage.run(*[f.filter(F.lit(False)) for f in frames]).schema
            # parts that failed are not read, whatever they left
            tables[stage.makes] = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
            here = None
            for depth, part, error in lost:
                keys = frames[0].filter(F.pmod(F.xxhash64(self.key), F.lit(1 << depth)) == part) if depth else frames[0]
                letters = keys.select(F.col(self.key), F.lit(stage.name).alias("stage"), F.lit(error).alias("error")).distinct()
                here = letters if here is None else here.unionByName(letters)
            if lost:
                # found once: the tables that they are told from lose them next
                dead = saved(here, "dead") if dead is None else dead.unionByName(saved(here, "dead"))
                # what is lost in one stage is in no table after it
                gone = dead.select(self.key).distinct()
                tables = {n: t.join(gone, self.key, "left_anti") for n, t in tables.items()}
            rows[stage.makes] = written
            gone_here = dead.filter(F.col("stage") == stage.name).count() if lost else 0
            trace.append({"place": place, "stage": stage.name, "rows_in": sum(rows[n] for n in stage.needs if n in rows), "rows_out": written, "seconds": time.time() - began, "jobs": jobs, "lost": gone_here})
        if dead is None:
            dead = next(iter(given.values())).select(self.key).limit(0).withColumns({"stage": F.lit(""), "error": F.lit("")})
        return Outcome(tables, dead, trace)


def trace_table(spark, outcome: Outcome) -> DataFrame:
    return spark.createDataFrame([tuple(t.values()) for t in outcome.trace] or [], "place int, stage string, rows_in long, rows_out long, seconds double, jobs int, lost long")


def with_dead(outcome: Outcome, table: str, key: str = "doc_id") -> DataFrame:
    """A table with a row more for each document that some stage failed for: its key, the ``stage`` and the ``error``, which are null in all other rows."""
    made = outcome.tables[table]
    none = F.lit(None).cast("string")
    lost = outcome.dead.select(*[F.col(c) if c == key else F.lit(None).cast(t).alias(c) for c, t in made.dtypes], "stage", "error")
    return made.select("*", none.alias("stage"), none.alias("error")).unionByName(lost)


def _scene_rows(paras: DataFrame) -> DataFrame:
    return scenes.told_scenes(paras, scenes.scenes(paras)).drop("pos")


def _narrative(clean: DataFrame) -> DataFrame:
    return clean.select("doc_id", scenes.narrative_mode("text").alias("mode"), scenes.point_of_view("text").alias("pov"))


def _render_plan(blocks: DataFrame, found: DataFrame) -> DataFrame:
    """Cues dealt to a document's scenes in proportion, one scene at least."""
    at, share = Window.partitionBy("doc_id").orderBy("pos"), Window.partitionBy("doc_id")
    many = found.groupBy("doc_id").agg(F.count("*").alias("_scenes"))
    cues = blocks.join(many, "doc_id", "left").withColumn("_scenes", F.greatest(F.coalesce("_scenes", F.lit(1)), F.lit(1)))
    cues = cues.withColumns({"_i": F.row_number().over(at) - 1, "_n": F.count("*").over(share), "_ms": pacing.cue_duration()})
    scene = F.when(F.col("_n") <= 1, 0).otherwise(F.least(F.col("_scenes") - 1, F.floor(F.col("_i") * F.col("_scenes") / F.col("_n"))))
    return cues.groupBy("doc_id", scene.cast("int").alias("scene")).agg(F.count("*").alias("cues"), F.min("_i").alias("first_cue"), F.max("_i").alias("last_cue"), F.sum("_ms").alias("duration_ms"))


def _documents(clean, paras, found, blocks, readable, flow, paced, named) -> DataFrame:
    """A row a document that was cleaned: what the other stages say of it."""
    counted = lambda df, name: df.groupBy("doc_id").agg(F.count("*").alias(name))
    out = clean.select("doc_id").distinct()
    for part in (counted(paras, "paragraphs"), counted(found, "scenes"), counted(blocks, "blocks"), counted(named, "chapters"), readable.select("doc_id", "words", "reading_ease"), flow.select("doc_id", "dominant"), paced.select("doc_id", F.col("score").alias("pacing"))):
        out = out.join(part, "doc_id", "left")
    return out.fillna(0, ["paragraphs", "scenes", "blocks", "chapters"])


#: From raw documents (doc_id, text) to blocks, their measures and a row a document.
ENRICHED = [
    Stage("Text Cleaning", ("documents",), "clean", lambda d: d.select("doc_id", extracted_normal(F.coalesce("text", F.lit(""))).alias("text"))),
    Stage("Chapter Detection", ("clean",), "chapters", lambda c: chapters.chapters(c)),
    Stage("Paragraph Reconstruction", ("clean",), "rebuilt", lambda c: staging.rebuilt_texts(c)),
    Stage("Paragraphs", ("rebuilt",), "paragraphs", lambda r: r.select("doc_id", F.posexplode(paragraphs_strict("text")).alias("pos", "text"))),
    Stage("Scene Segmentation", ("paragraphs",), "scenes", _scene_rows),
    Stage("Narrative Analysis", ("rebuilt",), "narrative", _narrative),
    Stage("Cinematification", ("rebuilt",), "plain_blocks", lambda r: plain.plain_blocks(r)),
    Stage("Readability Analysis", ("rebuilt",), "readability", lambda r: passages.readability(r)),
    Stage("Text Statistics", ("rebuilt",), "statistics", lambda r: passages.text_statistics(r)),
    Stage("Sentence Flow", ("rebuilt",), "flow", lambda r: passages.sentence_flow(r)),
    Stage("Sentiment Flow", ("rebuilt",), "sentiment", lambda r: passages.sentiment_flow(r)),
    Stage("Sentiment Enrichment", ("plain_blocks", "flow"), "blocks", lambda b, f: b.drop("emotion").join(documents.filled_emotions(b, f.withColumnRenamed("pos", "i")), ["doc_id", "pos"])),
    Stage("Pacing Analysis", ("blocks",), "pacing", lambda b: pacing.pacing(b)),
    Stage("Renderer", ("blocks", "scenes"), "plan", _render_plan),
    Stage("Document", ("clean", "paragraphs", "scenes", "blocks", "readability", "sentiment", "pacing", "chapters"), "documents_made", _documents),
]
#: Cleaning, paragraphs and blocks only.
BASIC = [s for s in ENRICHED if s.makes in ("clean", "rebuilt", "plain_blocks")]
