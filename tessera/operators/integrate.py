"""Evidence for aligning classes of different sources: overlap of their identifiers and trials of candidate keys.

All figures come from whole columns; only a small, fixed sample of values reaches the driver, to choose how identifiers
are normalised. Both sides of a comparison are united, tagged and grouped by value, so one shuffle gives all counts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.normalize import BY_NAME, Rule, pick_rule
from tessera.operators.classframe import not_blank
from tessera.plans.engine import Engine
from tessera.plans.errors import Rejected, SourceFault
from tessera.plans.model import ObjectType, Source

#: Values of each side that the normalising rule is chosen by: the least ones, so that the choice never varies.
SAMPLE = 20
# Endings of names, and words of comments, that hint at an identifier.
NAME_HINT = re.compile(r"(no|code|sn|num)$", re.I)
COMMENT_HINT = re.compile(r"(编号|序列号|单号|证件号|卡号|号码)")


def texts(df: DataFrame, column: str) -> DataFrame:
    """The non-blank values of a column as texts: ``value``."""
    c = F.col(f"`{column}`")
    return df.where(not_blank(c)).select(c.cast("string").alias("value"))


def sample(values: DataFrame, n: int = SAMPLE) -> list[str]:
    return [r[0] for r in values.orderBy("value").limit(n).collect()]


def choose_rule(a: DataFrame, b: DataFrame) -> Rule:
    return pick_rule(sample(a) + sample(b))


def overlap_counts(a: DataFrame, b: DataFrame, rule: Rule) -> DataFrame:
    """norm_rule, count_a, count_b, count_hit, rate of the distinct normalised values of both sides."""
    tagged = a.select(rule.column(F.col("value")).alias("value"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(b.select(rule.column(F.col("value")).alias("value"), F.lit(0).alias("a"), F.lit(1).alias("b")))
    sides = tagged.groupBy("value").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    counts = sides.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(n) for n, c in (("count_a", F.col("a")), ("count_b", F.col("b")), ("count_hit", F.col("a") * F.col("b")))))
    most = F.greatest("count_a", "count_b")
    return counts.select(F.lit(rule.name).alias("norm_rule"), "count_a", "count_b", "count_hit", F.when(most > 0, F.col("count_hit") / most).otherwise(F.lit(0.0)).alias("rate"))


def eligible(cls: ObjectType) -> bool:
    return bool(cls.sources and cls.identity)


def identifiers(engine: Engine, cls: ObjectType) -> DataFrame:
    """The identifiers of a class, over all its sources."""
    if not eligible(cls):
        raise Rejected(f"{cls.name} has no sources or no identity to compare")
    parts = [texts(engine.table(s), s.fields[cls.key_of(s)]) for s in cls.sources.values()]
    return reduce(DataFrame.unionByName, parts)


def overlap(engine: Engine, class_a: str, class_b: str) -> DataFrame:
    """One row: class_a, class_b, norm_rule, count_a, count_b, count_hit, rate."""
    if class_a == class_b:
        raise Rejected("a class is not compared with itself")
    a, b = (identifiers(engine, engine.model.object(c)) for c in (class_a, class_b))
    return overlap_counts(a, b, choose_rule(a, b)).select(F.lit(class_a).alias("class_a"), F.lit(class_b).alias("class_b"), "*")


@dataclass(frozen=True)
class Candidate:
    name: str
    current: bool
    #: A declared unique column or primary key in every source.
    hard: bool
    hinted: bool


def key_candidates(engine: Engine, cls: ObjectType) -> list[Candidate]:
    """Properties that may tell individuals apart: mapped in every source, and the present key, unique or a text primary
    key everywhere, or hinted at by name or comment and no whole number, which row numbers are."""
    found = []
    infos = {s.name: {c.name: c for c in engine.sources.info(s.connection, s.table).columns} for s in cls.sources.values()}
    for p in cls.properties.values():
        if p.derived is not None or not cls.sources or any(p.name not in s.fields for s in cls.sources.values()):
            continue
        columns = [infos[s.name][s.fields[p.name]] for s in cls.sources.values()]
        hard = all(c.unique and not c.pk for c in columns) or all(c.pk and not c.integer for c in columns)
        hinted = bool(NAME_HINT.search(p.name) or any(COMMENT_HINT.search(t or "") for t in (p.description, *(c.comment for c in columns))))
        if p.name == cls.identity or hard or (hinted and not any(c.integer for c in columns)):
            found.append(Candidate(p.name, p.name == cls.identity, hard, hinted))
    return found


def _column(engine: Engine, s: Source, p: str) -> DataFrame:
    return texts(engine.table(s), s.fields[p])


def key_trial(engine: Engine, name: str, mates: list[str] | None = None) -> DataFrame:
    """candidate, hard, rows, distinct_values, unique_in_each, mate, mate_key, hits: one row per candidate and mate candidate.

    A candidate is unique if no source repeats one of its normalised values. Hits count normalised values that both have;
    each side is normalised by its own rule. Candidates without any mate have one row with null mates.
    """
    cls = engine.model.object(name)
    others = [engine.model.object(m) for m in mates] if mates is not None else [c for c in engine.model.object_types.values() if c.name != name and c.sources]
    parts, labels = [], []

    def add(owner: ObjectType, p: str, side: str) -> None:
        values = {}
        for s in owner.sources.values():
            try:
                values[s] = _column(engine, s, p)
            except SourceFault:
                continue  # a trial goes by what can be read
        rule = pick_rule([v for part in values.values() for v in sample(part)][:SAMPLE])
        label = f"{owner.name}.{p}"
        labels.append((label, side))
        for s, v in values.items():
            parts.append(v.select(F.lit(label).alias("column"), F.lit(s.name).alias("source"), rule.column(F.col("value")).alias("value")))

    own = key_candidates(engine, cls)
    for c in own:
        add(cls, c.name, "own")
    for o in others:
        for c in key_candidates(engine, o):
            add(o, c.name, "mate")
    schema = "candidate string, hard boolean, rows long, distinct_values long, unique_in_each boolean, mate string, mate_key string, hits long"
    if not own or not parts:
        return engine.spark.createDataFrame([], schema)
    # Rows per column, source and value; then per column and value; all later steps are small.
    counted = reduce(DataFrame.unionByName, parts).groupBy("column", "source", "value").agg(F.count(F.lit(1)).alias("n"))
    per_source = counted.groupBy("column", "source").agg(F.sum("n").alias("rows"), F.max("n").alias("most"))
    figures = per_source.groupBy("column").agg(F.sum("rows").alias("rows"), (F.max("most") == 1).alias("unique_in_each"))
    values = counted.select("column", "value").distinct()
    figures = figures.join(values.groupBy("column").agg(F.count(F.lit(1)).alias("distinct_values")), "column")
    # The columns that hold a value, a handful by construction, meet in one row.
    together = values.groupBy("value").agg(F.collect_list("column").alias("columns")).where(F.size("columns") > 1)
    ours = [label for label, side in labels if side == "own"]
    theirs = [label for label, side in labels if side == "mate"]
    hits = together.select(F.explode("columns").alias("column"), "columns").where(F.col("column").isin(ours)).select("column", F.explode("columns").alias("mate_column"))
    hits = hits.where(F.col("mate_column").isin(theirs) if theirs else F.lit(False)).groupBy("column", "mate_column").agg(F.count(F.lit(1)).alias("hits"))
    grid = engine.spark.createDataFrame([(c.name, f"{name}.{c.name}", c.hard, m) for c in own for m in theirs or [None]], "candidate string, column string, hard boolean, mate_column string")
    out = grid.join(figures, "column", "left").join(hits, ["column", "mate_column"], "left")
    return out.select(
        "candidate", "hard", F.coalesce("rows", F.lit(0)).cast("long").alias("rows"), F.coalesce("distinct_values", F.lit(0)).cast("long").alias("distinct_values"), F.coalesce("unique_in_each", F.lit(True)).alias("unique_in_each"),
        F.split_part("mate_column", F.lit("."), F.lit(1)).alias("mate"), F.split_part("mate_column", F.lit("."), F.lit(2)).alias("mate_key"), F.coalesce("hits", F.lit(0)).cast("long").alias("hits"),
    )


def normalized(c: Column, rule: str) -> Column:
    return BY_NAME[rule].column(c)
