"""Mixing sources to target weights by iterative proportional fitting.

Documents are summed to cells (source, language, topic). Each round scales the cells' weights so that weighted tokens
meet the target shares of the sources, then of the languages, then of the topics; rounds end when all three
hold. A document is then kept with its cell's weight as probability, or for certain where the weight is over
one; what the probability can't give stays as the sample's weight, so weighted samples have the target shares
in expectation.

A cell's weight is the product of its three values' factors. Cells and factors are tables that never leave Spark:
a round reads the cells once for each margin, joins the other margins' factors and sums, map-side first, so that no
task holds a margin's cells. Only factors are written, so plans stay as small as in the first round. Documents are
read for the cells and once more for the result, and joined to cells as rows, whichever source they come from.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bedtide.llm.frames import pick
from bedtide.session import materialise

MARGINS = ("source", "lang", "topic")
# Target share of a value: its own share to this power, scaled to sum to one. 1 keeps shares, 0 makes them equal.
TEMPER = {"source": 0.7, "lang": 0.7, "topic": 0.5}
TOLERANCE, MAX_ROUNDS = 1e-9, 102
NONE = "(none)"
# Topics by cues in the text, the first that is found counts.
TOPICS = (
    ("license", r"(?i)licen[cs]e|copyright|all rights reserved"),
    ("contact", r"[\w.+-]+@[\w-]+\.\w|\(\d{3}\) ?\d{3}-\d{4}"),
    ("table", r"\w \| \w"),
    ("marks", r"[#*$%&]{3}"),
)
OTHER = "prose"


def topic_of(text: Column, topics: tuple = TOPICS) -> Column:
    found = None
    for name, cue in topics:
        found = F.when(text.rlike(cue), name) if found is None else found.when(text.rlike(cue), name)
    return F.lit(OTHER) if found is None else found.otherwise(OTHER)


def weighted_documents(documents: DataFrame, topics: tuple = TOPICS, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, lang, topic, tokens, draw) and ``carry`` of each row; tokens are runs without white space. Null
    sources and languages are a value of their own. ``draw`` is the id, or the text's hash where there is none."""
    rows = pick(documents, doc_id="doc_id", text="text", source="source", lang="lang", **{f"carry_{i}": c for i, c in enumerate(carry)})
    text = F.coalesce("text", F.lit(""))
    return rows.select(
        "doc_id", *(F.coalesce(F.col(c).cast("string"), F.lit(NONE)).alias(c) for c in ("source", "lang")), topic_of(text, topics).alias("topic"),
        F.regexp_count(text, F.lit(r"[^ \t-\r]+")).cast("bigint").alias("tokens"),
        F.coalesce(F.col("doc_id").cast("string"), F.xxhash64("text").cast("string")).alias("draw"), *(f"carry_{i}" for i in range(len(carry))),
    )


def tempered_targets(cells: DataFrame, margin: str, power: float) -> DataFrame:
    """(value, share) in proportion to the value's own share of the tokens to ``power``; values without tokens
    have none."""
    own = cells.groupBy(margin).agg(F.sum("tokens").cast("double").alias("t")).where("t > 0").withColumn("p", F.pow("t", F.lit(power)))
    total = own.agg(F.sum("p").alias("all"))
    return own.join(total).select(F.col(margin).alias("value"), (F.col("p") / F.col("all")).alias("share"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], tolerance: float = TOLERANCE, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """``cells`` with ``weight``: weighted tokens meet the shares of every margin, within ``tolerance``.

    ``targets[margin]`` has (value, share). Shares of a margin are taken in proportion among the values that
    have tokens. A value without target keeps no tokens; one without tokens is left as it is. If the margins
    contradict each other the last round's weights are returned, which meet the last margin.
    """
    total = cells.agg(F.sum("tokens").cast("double")).first()[0] or 0.0
    if not total:
        return materialise(cells.withColumn("weight", F.lit(1.0)))
    cells, factors = materialise(cells), {}
    for margin in MARGINS:
        own = cells.groupBy(margin).agg(F.sum("tokens").alias("own"))
        aims = own.where("own > 0").join(targets[margin].withColumnRenamed("value", margin), margin)
        whole = aims.agg(F.sum("share")).first()[0] or 1.0
        factors[margin] = materialise(own.join(aims.select(margin, (F.col("share") / F.lit(whole) * total).alias("share")), margin, "left").select(
            margin, F.when(F.col("own") > 0, F.coalesce("share", F.lit(0.0))).alias("aim"), F.lit(1.0).alias("factor"), F.lit(0.0).alias("moved")))

    def scaled(*margins: str) -> DataFrame:
        return reduce(lambda rows, m: rows.join(factors[m].select(m, F.col("factor").alias(f"factor_{m}")), m), margins, cells)

    for _ in range(max_rounds):
        for margin in MARGINS:
            first, second = (m for m in MARGINS if m != margin)
            mass = scaled(first, second).groupBy(margin).agg(F.sum(F.col("tokens") * F.col(f"factor_{first}") * F.col(f"factor_{second}")).alias("mass"))
            factor = F.when(F.col("aim").isNull(), 1.0).when(F.col("mass") > 0, F.col("aim") / F.col("mass")).otherwise(0.0)
            moved = F.when(F.col("factor") > 0, F.abs(factor / F.col("factor") - 1)).otherwise(0.0)
            factors[margin] = materialise(factors[margin].join(mass, margin).select(margin, "aim", factor.alias("factor"), moved.alias("moved")))
        if reduce(DataFrame.union, (f.select("moved") for f in factors.values())).agg(F.max("moved")).first()[0] <= tolerance:
            break
    weight = reduce(lambda a, b: a * b, (F.col(f"factor_{m}") for m in MARGINS))
    return materialise(scaled(*MARGINS).withColumn("weight", weight).drop(*(f"factor_{m}" for m in MARGINS)))


def unit_hash(*columns: Column) -> Column:
    """A number from 0 up to 1 that depends on the columns' text alone."""
    digest = F.md5(F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("")) for c in columns)))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint") / F.lit(float(1 << 48))


def mix(documents: DataFrame, targets: dict[str, DataFrame] | None = None, topics: tuple = TOPICS, carry: tuple[str, ...] = (), seed: str = "mix") -> DataFrame:
    """(doc_id, source, lang, topic, tokens, weight, probability, sample_weight, sampled) and ``carry`` for each row.

    ``weight`` is the calibrated weight of the document's tokens, ``probability`` that weight up to one and
    ``sample_weight`` the weight divided by the probability. ``sampled`` is drawn by a hash of ``seed`` and doc_id, or of
    the text where the id is null, so that it is the same at every run and for repeated rows. Null texts have no tokens; they share the weight of their cell. Without tokens at all every
    weight is 1.
    """
    rows = weighted_documents(documents, topics, carry)
    cells = materialise(rows.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens")))
    aims = targets or {m: materialise(tempered_targets(cells, m, TEMPER[m])) for m in MARGINS}
    raked = rake(cells, aims)
    weights = materialise(raked.select(
        *MARGINS, "weight", F.least(F.lit(1.0), "weight").alias("probability"), F.greatest(F.lit(1.0), "weight").alias("sample_weight")))
    out = rows.join(weights, list(MARGINS)).withColumn("sampled", unit_hash(F.lit(seed), F.col("draw")) < F.col("probability"))
    return out.select("doc_id", *MARGINS, "tokens", "weight", "probability", "sample_weight", "sampled", *(F.col(f"carry_{i}").alias(c) for i, c in enumerate(carry)))
