"""The queries p5 to p8, over whole tables and whole texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalogue.tables import read
from tessera.functions.codes import code_form
from tessera.llm.lookalike import consistent_forms, lookalikes
from tessera.llm.mixture import CORPUS, EXACT, SEED, Mixture
from tessera.llm.overlap import overlapping, overlaps
from tessera.llm.tokens import encode

#: Two classes of a workspace overlap from this rate on.
LEAST_RATE = 0.25


def _identifiers(spark: SparkSession, at: str) -> DataFrame:
    return read(spark, at, "class_ident").select("workspace_id", "class_name", code_form(F.col("ident")).alias("ident"))


def p5_found(spark: SparkSession, at: str) -> DataFrame:
    found = overlapping(_identifiers(spark, at), "workspace_id", "class_name", "ident", LEAST_RATE)
    return found.select(F.col("scope").cast("int").alias("workspace_id"), F.col("a").alias("class_a"), F.col("b").alias("class_b"))


def p5_overlap(spark: SparkSession, at: str) -> DataFrame:
    found = overlaps(_identifiers(spark, at), "workspace_id", "class_name", "ident")
    return found.select(F.col("scope").cast("int").alias("workspace_id"), F.col("a").alias("class_a"), F.col("b").alias("class_b"), "count_a", "count_b", "count_hit", "rate")


def p6_ids(spark: SparkSession, at: str) -> DataFrame:
    return encode(read(spark, at, "documents"), ["doc_id"], "text")


def _mixture(spark: SparkSession, at: str, total=CORPUS, **measure) -> Mixture:
    return Mixture(read(spark, at, "documents"), read(spark, at, "mix_target"), total=total, **measure)


def _by_characters(spark: SparkSession, at: str) -> Mixture:
    """The same mixture with sizes that SQL can count too."""
    return _mixture(spark, at, size=F.length("text"), unit="chars")


def p7_mix(spark: SparkSession, at: str) -> DataFrame:
    """As many tokens as the sources hold: small sources are clamped at their repetitions, the others take what is left."""
    return _mixture(spark, at).documents()


def p7_shares(spark: SparkSession, at: str) -> DataFrame:
    return _mixture(spark, at).shares()


def p7_exact(spark: SparkSession, at: str) -> DataFrame:
    """The largest mixture that meets every share."""
    return _mixture(spark, at, EXACT).documents()


def p7_exact_shares(spark: SparkSession, at: str) -> DataFrame:
    return _mixture(spark, at, EXACT).shares()


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def p7_chars_plan(spark: SparkSession, at: str) -> DataFrame:
    return _rounded(_by_characters(spark, at).planned(), "amount", "epochs")


def p7_chars_mix(spark: SparkSession, at: str) -> DataFrame:
    return _by_characters(spark, at).documents()


def p7_chars_shares(spark: SparkSession, at: str) -> DataFrame:
    return _rounded(_by_characters(spark, at).shares(), "epochs", "reached_share")


def p8_found(spark: SparkSession, at: str) -> DataFrame:
    return lookalikes(read(spark, at, "documents"))


def p8_forms(spark: SparkSession, at: str) -> DataFrame:
    return consistent_forms(read(spark, at, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p5_found, p5_overlap, p6_ids, p7_mix, p7_shares, p7_exact, p7_exact_shares, p7_chars_plan, p7_chars_mix, p7_chars_shares, p8_found, p8_forms)}

_SETS = """held as (
    select distinct workspace_id, class_name, nullif(regexp_replace(upper(ident), '[^A-Z0-9]', '', 'g'), '') as ident
    from class_ident where workspace_id is not null and class_name is not null),
  sizes as (select workspace_id, class_name, count(ident) as n from held group by workspace_id, class_name),
  hits as (
    select x.workspace_id, x.class_name as a, y.class_name as b, count(*) as n
    from held x join held y on x.workspace_id = y.workspace_id and x.ident = y.ident and x.class_name < y.class_name group by 1, 2, 3),
  figures as (
    select x.workspace_id, x.class_name as class_a, y.class_name as class_b, x.n as count_a, y.n as count_b, coalesce(h.n, 0) as count_hit,
           case when greatest(x.n, y.n) > 0 then coalesce(h.n, 0)::double / greatest(x.n, y.n) else 0.0::double end as rate
    from sizes x join sizes y on x.workspace_id = y.workspace_id and x.class_name < y.class_name
    left join hits h on h.workspace_id = x.workspace_id and h.a = x.class_name and h.b = y.class_name)"""

_MIX = f"""sized as (
    select doc_id, source, n, cast('0x' || substr(md5('{SEED}|' || coalesce(doc_id::varchar, '')), 1, 15) as bigint) as point
    from (select doc_id, nullif(lower(trim(source)), '') as source, length(text) as n from documents) where source is not null and n > 0),
  sizes as (select source, sum(n)::bigint as size, count(*) as documents from sized group by source),
  wanted as (
    select nullif(lower(trim(source)), '') as source, max(coalesce(target_share, 0)) as share, max(coalesce(max_repeat, 1)) as most from mix_target group by 1),
  held as (
    select source, share, most, coalesce(size, 0) as size, coalesce(documents, 0) as documents, (most * coalesce(size, 0))::double as most_size
    from wanted left join sizes using (source) where source is not null),
  active as (select *, (select sum(size) from held where share > 0 and size > 0 and most > 0) as total from held where share > 0 and size > 0 and most > 0),
  levels as (
    select *, (total - coalesce(sum(most_size) over (order by most_size / share, source rows between unbounded preceding and 1 preceding), 0))
              / sum(share) over (order by most_size / share desc, source desc rows unbounded preceding) as level from active),
  level as (
    select (max(total) - coalesce(sum(most_size) filter (most_size <= share * level), 0)) / sum(share) filter (most_size > share * level) as level from levels),
  amounts as (
    select held.*, case when share > 0 and size > 0 then least(most_size, coalesce(share * (select level from level), most_size)) else 0.0 end as amount from held),
  plan as (
    select *, amount - whole * size as rest, case when whole < most and amount - whole * size >= 0.5 then amount - whole * size else 0 end as partial
    from (select *, case when size > 0 then amount / size else 0.0 end as epochs,
                 case when size > 0 then least(floor(amount / size + 1e-12)::int, greatest(0, most)) else 0 end as whole from amounts)),
  reach as (select source, point, n, whole, partial, doc_id, sum(n) over (partition by source order by point range unbounded preceding) as upto from sized join plan using (source)),
  cuts as (select source, max(point) filter (partial > 0 and upto - n / 2.0 <= partial) as cut from reach group by source),
  mixed as (
    select doc_id, source, n as n_chars, whole + case when point <= coalesce(cut, -1) then 1 else 0 end as repeats from reach join cuts using (source)),
  sums as (select source, sum(n_chars * repeats)::bigint as mixed_chars from mixed group by source)"""

ORACLE: dict[str, str] = {
    "p7_chars_plan": f"with {_MIX} select source, share as target_share, most as max_repeat, documents, size as chars, round(amount, 6) as amount, round(epochs, 6) as epochs from plan",
    "p7_chars_mix": f"with {_MIX} select * from mixed where repeats > 0",
    "p7_chars_shares": f"""with {_MIX} select source, share as target_share, most as max_repeat, documents, size as chars, round(epochs, 6) as epochs, coalesce(mixed_chars, 0) as mixed_chars,
      round(coalesce(mixed_chars / sum(mixed_chars) over (), 0), 6) as reached_share from plan left join sums using (source)""",
    "p5_found": f"with {_SETS} select workspace_id, class_a, class_b from figures where rate >= {LEAST_RATE}",
    "p5_overlap": f"with {_SETS} select * from figures",
}
