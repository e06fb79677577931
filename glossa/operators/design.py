"""Stimulus reshaping and generation of design points.

Design factors are short literal lists, so a grid is an ``explode`` of literal
arrays on each stimulus row: no join and no shuffle, whatever the table's size.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col, non_blank

# The four prompt components, in bit order.
COMPONENTS = ("D", "R", "V", "C")
# Lowest canonical level at which each component is present.
CANONICAL_FROM = {"D": 1, "R": 2, "V": 2, "C": 3}
# Task domains with their complexity, and those with the full factorial.
DOMAIN_COMPLEXITY = {
    "landlord_tenant": "high",
    "medical_test": "high",
    "pharma_adverse_event": "high",
    "financial_instrument": "high",
    "regulatory_complaint": "high",
    "rental_review": "standard",
    "dietary_advice": "standard",
    "cover_letter": "standard",
    "insurance_claim": "standard",
    "academic_appeal": "standard",
}
FOCAL_DOMAINS = ("landlord_tenant", "rental_review", "financial_instrument")
# Ordinal codes.
DEPTH_CODES = {"shallow": 1, "medium": 2, "deep": 3}
GENERATION_CODES = {"gen1": 1, "gen2": 2, "gen3": 3, "gen4": 4}
# The model that stands for each generation.
GENERATION_MODELS = {
    "gen1": "davinci-002",
    "gen2": "gpt-3.5-turbo-0125",
    "gen3": "gpt-4-0613",
    "gen4": "gpt-4o-2024-08-06",
}
# Replicates and temperatures of each design.
REPLICATES = {"E1": 20, "E2": 100, "E3": 30, "E4": 20, "E5": 50}
TEMPERATURES = {"E1": (0.7,), "E2": (0.2, 0.5, 0.8, 1.2), "E3": (0.7,), "E4": (0.0, 0.7), "E5": (0.8,)}
# Concepts of the diachronic design whose salience changed.
CHANGING_CONCEPTS = (
    "pandemic",
    "remote work",
    "artificial intelligence",
    "vaccine",
    "disinformation",
    "climate anxiety",
    "supply chain",
    "NFT",
    "long COVID",
    "diversity and inclusion",
)


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def unpivot_prompts(
    df: DataFrame, ids: Sequence[str], prompts: Mapping[str, str], paraphrase_prefix: str = "paraphrase"
) -> DataFrame:
    """One row per (stimulus, prompt variant); ``prompts`` maps variant key to column. Blank prompts are left out."""
    renamed = df.select(*ids, *[F.col(source).alias(key) for key, source in prompts.items()])
    long = renamed.unpivot(list(ids), list(prompts), "prompt_key", "prompt")
    return long.filter(non_blank("prompt")).withColumn(
        "is_paraphrase", F.startswith("prompt_key", F.lit(paraphrase_prefix))
    )


def unpivot_sides(
    df: DataFrame, ids: Sequence[str], sides: Mapping[str, tuple[str, str | Column | None]]
) -> DataFrame:
    """One row per sentence side; ``sides`` maps side name to (sentence column, truth column or None)."""
    entries = [
        F.struct(
            F.lit(side).alias("sentence_col"),
            F.col(sentence).alias("sentence"),
            (F.lit(None).cast("string") if truth is None else col(truth)).alias("ground_truth"),
        )
        for side, (sentence, truth) in sides.items()
    ]
    return df.select(*ids, F.inline(F.array(*entries)))


def design_grid(
    stimuli: DataFrame,
    replicates: int,
    temperatures: Sequence[float] = (),
    models: Sequence[str] = (),
) -> DataFrame:
    """Every stimulus × model × temperature × replicate index ``0..replicates-1``."""
    grid = stimuli
    if models:
        grid = grid.withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))
    if temperatures:
        grid = grid.withColumn("temperature", F.explode(F.array(*[F.lit(float(t)) for t in temperatures])))
    return grid.withColumn("response_index", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))


def condition_id(flags: Mapping[str, Column]) -> Column:
    """Component letters in order, absent ones marked ``~``."""
    return F.concat(*[F.when(flag, name).otherwise(f"~{name}") for name, flag in flags.items()])


def factorial_conditions(df: DataFrame) -> DataFrame:
    """Cross every row with the 2^4 component conditions.

    ``n_components`` counts the components present; it is not a canonical level.
    """
    coded = df.withColumn("condition", F.explode(F.sequence(F.lit(0), F.lit(2 ** len(COMPONENTS) - 1))))
    flags = {name: F.getbit("condition", F.lit(bit)) == 1 for bit, name in enumerate(COMPONENTS)}
    return coded.select(
        "*",
        *[flag.alias(name) for name, flag in flags.items()],
        condition_id(flags).alias("condition_id"),
        F.bit_count("condition").cast("int").alias("n_components"),
    )


def canonical_levels(df: DataFrame) -> DataFrame:
    """Cross every row with the four canonical levels and the components each implies."""
    coded = df.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(3))))
    return coded.select(
        "*",
        *[(F.col("level") >= low).alias(name) for name, low in CANONICAL_FROM.items()],
        F.concat(F.lit("L"), F.col("level").cast("string")).alias("condition_id"),
    )


def canonical_level(components: Sequence[str] = tuple(CANONICAL_FROM)) -> Column:
    """Canonical level of a row's component flags; null for any other combination."""
    levels = [
        F.when(reduce(lambda a, b: a & b, [F.col(c) == F.lit(level >= CANONICAL_FROM[c]) for c in components]), level)
        for level in range(4)
    ]
    return F.coalesce(*levels)


def mapped(value: str | Column, codes: Mapping[str, object]) -> Column:
    """Literal map lookup; null for a value outside the map."""
    pairs = [F.lit(x) for item in codes.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), col(value))


def with_domain(df: DataFrame, domain: str = "domain") -> DataFrame:
    """Add the complexity class of a task domain and whether it gets the full factorial."""
    return df.withColumns(
        {"complexity": mapped(domain, DOMAIN_COMPLEXITY), "is_focal": F.col(domain).isin(*FOCAL_DOMAINS)}
    )


def ordinal(value: str | Column, codes: Mapping[str, int], default: int | None = None) -> Column:
    code = mapped(value, codes)
    return code if default is None else F.coalesce(code, F.lit(default))


def flag(condition: Column) -> Column:
    """0/1 recode of a condition; a missing value counts as 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def row_mean(*columns: str | Column) -> Column:
    """Mean of the values present in the row; null if none is."""
    values = [col(c) for c in columns]
    total = sum((F.coalesce(v.cast("double"), F.lit(0.0)) for v in values[1:]), F.coalesce(values[0].cast("double"), F.lit(0.0)))
    present = sum((v.isNotNull().cast("int") for v in values[1:]), values[0].isNotNull().cast("int"))
    return F.when(present > 0, total / present)


def route_judges(responses: DataFrame, routes: Mapping[str, str | Sequence[str]], generator: str = "model") -> DataFrame:
    """One row per response and judge; a model never judges its own output.

    ``routes`` maps a generator to its judge or judges and is a short literal map, so
    routing is a column expression. A route onto the generator itself is refused.
    Responses of an unrouted generator get no row; see ``coverage_gap``.
    """
    judges = {g: [j] if isinstance(j, str) else list(j) for g, j in routes.items()}
    own = sorted(g for g, listed in judges.items() if g in listed)
    if own:
        raise ValueError(f"models routed to judge themselves: {', '.join(own)}")
    return responses.withColumn("judge_model", F.explode(mapped(generator, judges)))


def pending(design: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Design points without a stored result."""
    return design.join(done.select(*keys), list(keys), "left_anti")


def coverage_gap(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of ``left`` that ``right`` does not cover, with the number of rows each would lose."""
    uncovered = left.join(right.select(*keys), list(keys), "left_anti")
    return uncovered.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))


def diachronic_concepts(concepts: DataFrame, n_controls: int = 10) -> DataFrame:
    """The changing concepts plus the first ``n_controls`` controls by id, with a type label.

    The order is that of ``concept_id``. The control slice is a top-k feature of
    the design, so it keeps its limit.
    """
    spark = concepts.sparkSession
    changing = spark.createDataFrame([(c, "changing") for c in CHANGING_CONCEPTS], "concept string, concept_type string")
    stable = head_by(concepts.filter(F.col("concept_type") == "control"), ["concept_id"], n_controls).select(
        "concept", F.lit("stable").alias("concept_type")
    )
    return changing.unionByName(stable)


def head_by(df: DataFrame, order: Sequence[str | Column], n: int) -> DataFrame:
    """First ``n`` rows in an explicit order (planned as a distributed take-ordered)."""
    return df.orderBy(*order).limit(n)
