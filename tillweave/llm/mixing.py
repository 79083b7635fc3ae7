"""Mixing sources to target weights: raking, then sampling by calibrated probabilities.

Everything here is DataFrame work: documents are summed to cells (source x language x topic), the cells'
token weights are raked to the three target marginals by iterative proportional fitting, and each document
is kept with the probability of its cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillweave.llm.common import BLANKS_CLASS, materialize

DIMENSIONS = ("source", "lang", "topic")
#: Exponent that flattens observed shares to default targets.
TEMPERATURE = 0.9
#: Raking ends when every marginal share is within this of its target.
TOLERANCE = 1e-9
#: Rounds in one job, and jobs at most.
ROUNDS_PER_JOB = 4
MAX_JOBS = 15


def token_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    words = F.regexp_count(text, F.lit("[^" + BLANKS_CLASS[1:-1] + "]+"))
    return F.coalesce(words, F.lit(0)).cast("bigint")


def topic_of(text: Column) -> Column:
    """A coarse topic by form: notices that name a licence, tables with column bars, prose else."""
    return (
        F.when(F.contains(text, F.lit("License")), "notice")
        .when(F.contains(text, F.lit(" | ")), "table")
        .otherwise("prose")
    )


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on key and seed only."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    digits = F.substring(F.md5(named.cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("bigint") / F.lit(float(2**52))


def cell_weights(
    cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, temperature: float = TEMPERATURE
) -> DataFrame:
    """Rake (source, lang, topic, base) to the target marginals; returns one row per cell.

    ``weight`` is the raked token weight, of the same total as ``base``, and ``probability`` is weight / base
    over the largest such ratio, so that the expected tokens of the sample have the raked shares.
    ``targets`` has shares by value for any of the three dimensions, summing to anything; values not named get
    0, values without tokens are passed over. A dimension without targets gets its observed shares to the power
    ``temperature``, normalised. Cells without tokens have no weight and probability 1. ``marginal_error`` is
    the largest distance of a marginal share from its target after the last round, ``converged`` says whether
    it is within the tolerance: targets that contradict empty cells can't be met.
    """
    held = cells.where(F.col("base") > 0)
    total = held.agg(F.sum("base").cast("double"))
    work = cells.withColumn("weight", F.col("base").cast("double"))
    for dim in DIMENSIONS:
        wanted = (targets or {}).get(dim)
        sums = held.groupBy(dim).agg(F.sum("base").cast("double").alias("tokens"))
        if wanted is None:
            raw = F.pow(F.col("tokens"), F.lit(temperature))
        else:
            pairs = [F.lit(x) for name, share in wanted.items() for x in (name, float(share))]
            raw = F.coalesce(F.create_map(*pairs)[F.col(dim)], F.lit(0.0)) if pairs else F.lit(0.0)
        sums = sums.select(dim, raw.alias("raw"))
        share = F.col("raw") / sums.agg(F.sum("raw")).scalar()
        work = work.join(sums.select(dim, (share * total.scalar()).alias(f"{dim}_goal")), dim, "left")
    work = materialize(work, "mix-cells")
    for _ in range(MAX_JOBS):
        for _ in range(ROUNDS_PER_JOB):
            for dim in DIMENSIONS:
                now = F.sum("weight").over(Window.partitionBy(dim))
                work = work.withColumn("weight", F.when(now > 0, F.col("weight") * F.col(f"{dim}_goal") / now).otherwise(0.0))
        work = materialize(work, "mix-cells")
        worst = F.lit(0.0)
        for dim in DIMENSIONS:
            off = F.abs(F.sum("weight").over(Window.partitionBy(dim)) - F.coalesce(f"{dim}_goal", F.lit(0.0)))
            worst = F.greatest(worst, off)
        seen = work.select(worst.alias("off"), "base").agg(F.max("off").alias("off"), F.sum("base").alias("all")).first()
        error = float(seen["off"] / seen["all"]) if seen["all"] else 0.0
        if error <= TOLERANCE:
            break
    ratio = F.when(F.col("base") > 0, F.col("weight") / F.col("base"))
    largest = work.agg(F.max(ratio)).scalar()
    return work.select(
        *DIMENSIONS,
        "base",
        "weight",
        F.coalesce(ratio / largest, F.lit(1.0)).alias("probability"),
        F.lit(error).alias("marginal_error"),
        F.lit(error <= TOLERANCE).alias("converged"),
    )


def consistent_weights(cells: DataFrame, temperature: float = TEMPERATURE) -> DataFrame:
    """Weights whose three marginals can always be met: the tokens of each cell to the power ``temperature``.

    The columns are those of ``cell_weights``. The goals are the marginals of this one table, so none contradicts another.
    """
    flat = F.when(F.col("base") > 0, F.pow(F.col("base").cast("double"), F.lit(temperature))).otherwise(F.lit(0.0))
    sums = cells.agg(F.sum("base").cast("double").alias("all"), F.sum(flat).alias("flat")).first()
    scale = sums["all"] / sums["flat"] if sums["flat"] else 0.0
    work = materialize(cells.select(*DIMENSIONS, "base", (flat * F.lit(scale)).alias("weight")), "mix-cells")
    ratio = F.when(F.col("base") > 0, F.col("weight") / F.col("base"))
    return work.select(
        *DIMENSIONS,
        "base",
        "weight",
        F.coalesce(ratio / work.agg(F.max(ratio)).scalar(), F.lit(1.0)).alias("probability"),
        F.lit(0.0).alias("marginal_error"),
        F.lit(True).alias("converged"),
    )


def _keyed(docs: DataFrame, source: Column, lang: Column, topic: Column, text: Column) -> list[Column]:
    blank = F.lit("")
    return [
        F.coalesce(source.cast("string"), blank).alias("source"),
        F.coalesce(lang.cast("string"), blank).alias("lang"),
        F.coalesce(topic, blank).alias("topic"),
        token_count(text).alias("tokens"),
    ]


def mixing_plan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    lang_col: str = "lang",
    topic: Column | None = None,
    targets: dict[str, dict[str, float]] | None = None,
    temperature: float = TEMPERATURE,
    seed: int = 7,
) -> DataFrame:
    """(id, source, lang, topic, tokens, probability, kept, marginal_error, converged): one row per input row.

    A null source, language or topic counts as the empty string. A null or empty text has no tokens and the
    probability of its cell. ``kept`` compares the probability with a hash of id and seed, so rows that repeat
    an id in one cell are kept or left together. ``marginal_error`` and ``converged`` are those of ``cell_weights``,
    the same in all rows: where ``converged`` is false, the sample does not meet its targets. An empty table gives no rows. Other columns are not read.
    """
    topic = topic_of(F.col(text_col)) if topic is None else topic
    rows = docs.select(
        F.col(id_col).alias("id"), *_keyed(docs, F.col(source_col), F.col(lang_col), topic, F.col(text_col))
    )
    cells = rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("base"))
    chances = materialize(cell_weights(materialize(cells, "mix-cells"), targets, temperature), "mix-chances")
    out = rows.join(chances.select(*DIMENSIONS, "probability", "marginal_error", "converged"), list(DIMENSIONS))
    return out.select(
        F.col("id").alias(id_col),
        *DIMENSIONS,
        "tokens",
        "probability",
        (uniform(F.col("id"), seed) < F.col("probability")).alias("kept"),
        "marginal_error",
        "converged",
    )


def sample_to_targets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    lang_col: str = "lang",
    topic: Column | None = None,
    targets: dict[str, dict[str, float]] | None = None,
    temperature: float = TEMPERATURE,
    seed: int = 7,
) -> DataFrame:
    """The documents drawn by ``mixing_plan``, with all their columns, where its targets can be met.

    Where raking does not converge, given targets are an error; flattened ones are taken from one flattened table of
    the cells instead, as those of ``mixing_plan`` contradict each other.
    """
    topic = topic_of(F.col(text_col)) if topic is None else topic
    keys = [k.alias(f"__mix_{n}") for k, n in zip(
        _keyed(docs, F.col(source_col), F.col(lang_col), topic, F.col(text_col)), (*DIMENSIONS, "tokens"))]
    cells = docs.select(*keys).groupBy(*[F.col(f"__mix_{d}").alias(d) for d in DIMENSIONS]).agg(
        F.sum("__mix_tokens").alias("base")
    )
    cells = materialize(cells, "mix-cells")
    chances = materialize(cell_weights(cells, targets, temperature), "mix-chances")
    failed = chances.where(~F.col("converged")).select("marginal_error").first()
    if failed is not None and targets:
        raise ValueError(f"targets contradict each other or the documents: a share is off by {failed['marginal_error']:.3g}")
    if failed is not None:
        chances = materialize(consistent_weights(cells, temperature), "mix-chances")
    named = chances.select(*[F.col(d).alias(f"__mix_{d}") for d in DIMENSIONS], F.col("probability").alias("__mix_chance"))
    marked = docs.select("*", *keys[:3]).join(named, [f"__mix_{d}" for d in DIMENSIONS])
    return marked.where(uniform(F.col(id_col), seed) < F.col("__mix_chance")).select(*[F.col(f"`{c}`") for c in docs.columns])
