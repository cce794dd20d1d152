"""Toxicity of whole texts by convolutional networks, with cutoffs per language."""

from __future__ import annotations

import functools
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textreg.llm import text_cnn
from textreg.llm.batches import stage
from textreg.llm.warc import make_folder, open_folder
from textreg.plans.stage import shared_root

#: Networks, each trained without one part of the sample; labelled rows in the sample, half of either label; characters of its texts.
MEMBERS = 3
SAMPLE, SAMPLE_CHARS = 6000, 20_000
#: Batches that a network is trained on.
TRAIN_STEPS = 700
#: Bytes of text scored together; a longer text is alone.
BATCH_BYTES = 4 << 20
#: Score from which a text counts as toxic where its language has no cutoff of its own, and the steps of a cutoff.
CUTOFF, STEPS = 0.3, 100

_TRAINED = pa.schema([("member", pa.int32()), ("file", pa.string())])


def held_out(id_col: str | Column) -> Column:
    """A quarter of the ids, whose labels are never read."""
    return F.coalesce(F.crc32((F.col(id_col) if isinstance(id_col, str) else id_col).cast("string")) % 4 == 2, F.lit(False))


def _fold(id_col: str) -> Column:
    return F.pmod(F.xxhash64(F.lit("fold"), id_col), F.lit(MEMBERS)).cast("int")


def _train(folder: str, steps: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([("id", "ascending")])
        member = table.column("member")[0].as_py()
        texts = text_cnn.cut(table.column("text").combine_chunks())
        model = text_cnn.train(
            texts, table.column("y").to_numpy().astype(np.float32), table.column("weight").to_numpy(), seed=member, steps=steps
        )
        # A name per attempt: only that of the one whose row is kept is read.
        file = f"{member}-{uuid.uuid4().hex}.npz"
        system, root = open_folder(folder)
        with system.open_output_stream(f"{root}/{file}", compression=None) as out:
            out.write(text_cnn.to_bytes(model))
        return pa.Table.from_arrays([pa.array([member], pa.int32()), pa.array([file])], schema=_TRAINED)

    return run


@functools.lru_cache(maxsize=1)
def read_networks(folder: str, files: tuple[str, ...]) -> list[text_cnn.Model]:
    """The networks of ``files``; a Python worker reads them once."""
    system, root = open_folder(folder)
    models = []
    for file in files:
        with system.open_input_stream(f"{root}/{file}", compression=None) as source:
            models.append(text_cnn.from_bytes(source.read()))
    return models


def train_members(
    docs: DataFrame, labelled: DataFrame, sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS, steps: int = TRAIN_STEPS
) -> tuple[str, dict[int, str]]:
    """Networks fitted on a sample of ``labelled(id, y)``: a shared folder and the file of each member; ``docs(id, text)``.

    The sample holds at most ``sample / 2`` rows of either label, those of least hash, whose texts have at most ``sample_chars``
    characters; weights restore the labels' shares. Each member is trained in a task of its own, without the rows of its own fold, and written by it: the driver
    sees the names of the files only.
    """
    spark = docs.sparkSession
    folder = f"{shared_root(spark)}/textreg/networks-{uuid.uuid4().hex}"
    here = labelled.join(docs.select("id").distinct(), "id", "left_semi")
    counts = {r["y"]: r["n"] for r in here.groupBy("y").agg(F.count("*").alias("n")).collect()}
    chosen = [
        here.filter(F.col("y") == y).orderBy(F.xxhash64(F.lit("sample"), "id"), "id").limit(sample // 2)
        .withColumn("weight", F.lit(n / min(n, sample // 2)))
        for y, n in counts.items()
    ]
    if not chosen:
        return folder, {}
    make_folder(folder)
    ids = chosen[0] if len(chosen) == 1 else chosen[0].unionByName(chosen[1])
    # At most ``sample`` ids, and one text per id.
    rows = (
        docs.filter(F.char_length("text") <= sample_chars).join(F.broadcast(ids), "id")
        .groupBy("id", "y", "weight").agg(F.min("text").alias("text"))
    )
    members = F.filter(F.sequence(F.lit(0), F.lit(MEMBERS - 1)), lambda m: m != _fold("id"))
    dealt = rows.select("id", "y", "weight", "text", F.explode(members).alias("member"))
    trained = dealt.groupBy("member").applyInArrow(_train(folder, steps), "member int, file string")
    return folder, {r["member"]: r["file"] for r in stage(trained, "trained").collect()}


def _score(folder: str, files: dict[int, str]):
    members = sorted(files)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = read_networks(folder, tuple(files[m] for m in members))
        for batch in batches:
            texts = batch.column(1)
            upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + BATCH_BYTES, side="right")))
                found = dict(zip(members, text_cnn.logits(models, text_cnn.cut(texts.slice(at, end - at))), strict=True))
                columns = [pa.array(found[m].astype(np.float64)) if m in found else pa.nulls(end - at, pa.float64()) for m in range(MEMBERS)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), batch.column(2).slice(at, end - at), *columns], schema=_SCORED)
                at = end

    return run


_SCORED = pa.schema([("id", pa.int64()), ("lang", pa.string()), *[(f"z{m}", pa.float64()) for m in range(MEMBERS)]])
_SCORED_TYPES = "id bigint, lang string, " + ", ".join(f"z{m} double" for m in range(MEMBERS))


def _logistic(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def cutoffs(scored: DataFrame) -> DataFrame:
    """``lang, threshold``: per language the cutoff of ``scored(lang, y, score)`` with the best F1; of equal ones the highest.

    Scores are counted in steps of 1 / ``STEPS``. A language without a row of label 1 has no cutoff.
    """
    step = F.least(F.floor(F.col("score") * STEPS), F.lit(STEPS - 1)).alias("step")
    counted = scored.groupBy("lang", step).agg(F.sum("y").alias("hits"), F.count("*").alias("n"))
    down = Window.partitionBy("lang").orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("lang")
    hits, n, every = F.sum("hits").over(down), F.sum("n").over(down), F.sum("hits").over(whole)
    f1 = counted.select("lang", (F.col("step") / STEPS).alias("threshold"), every.alias("every"), (2 * hits / (n + every)).alias("f1"))
    best = f1.filter("every > 0").groupBy("lang").agg(F.max(F.struct("f1", "threshold")).alias("best"))
    return best.select("lang", F.col("best.threshold").alias("threshold"))


def score_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic",
    sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS, steps: int = TRAIN_STEPS,
) -> DataFrame:
    """Score each text: ``id_col``, ``held_out``, ``score``, ``predicted``, ``threshold``, ``toxic``, one row per document.

    ``MEMBERS`` networks over hashed word embeddings are trained on a bounded sample of the labelled rows (``train_members``);
    labels of held-out ids are not read. ``score`` is the logistic function of their mean output for the whole text, whatever its length; it
    sees words only. ``predicted`` is 1 from ``CUTOFF`` on. ``threshold`` is calibrated by language over all labelled rows, each scored by the
    network that has not seen its fold, and ``toxic`` says whether the score reaches it.

    Texts are read once to be scored and do not move; the networks have a fixed size, and the tasks read them from the shared folder. Null and empty texts get the
    score of no words; null ids are never labelled; of several labels of an id the greatest counts, null ones do not. Without labelled rows all
    scores are 0. Languages without labelled toxic rows, and null, use ``CUTOFF``. Rows may repeat; other columns are ignored.
    """
    read = docs.select(
        F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")
    )
    known = labels.select(F.col(id_col).cast("bigint").alias("id"), (F.col(label_col) > 0).cast("int").alias("y"))
    labelled = known.filter(F.col("id").isNotNull() & F.col("y").isNotNull() & ~held_out("id")).groupBy("id").agg(F.max("y").alias("y"))
    folder, files = train_members(read.select("id", "text"), labelled, sample, sample_chars, steps)
    members = sorted(files)
    if members:
        outputs = stage(read.mapInArrow(_score(folder, files), _SCORED_TYPES), "toxicity")
        mean = sum(F.col(f"z{m}") for m in members) / len(members)
    else:
        outputs, mean = read.select("id", "lang", F.lit(None).cast("double").alias("z0")), F.lit(-math.inf)
    own = F.coalesce(*[F.when(_fold("id") == m, F.col(f"z{m}")) for m in members], mean)
    limits = cutoffs(outputs.join(labelled, "id").select("lang", "y", _logistic(own).alias("score")))
    limits = limits.select(F.col("lang").alias("of"), "threshold")
    score, threshold = F.col("score"), F.coalesce("threshold", F.lit(CUTOFF))
    return (
        outputs.select("id", "lang", _logistic(mean).alias("score")).join(limits, F.col("lang") == F.col("of"), "left")
        .select(
            F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", (score >= CUTOFF).cast("int").alias("predicted"),
            threshold.alias("threshold"), (score >= threshold).alias("toxic"),
        )
    )
