"""Queries p1 and p5 over the tables of the domain, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import plain_id
from ..operators.latest import latest_version
from functools import reduce

from ..operators.orphans import advance, empty_index, empty_state, problems, snapshots, standing
from ..operators.rolling import trailing_totals
from ..runtime import stable, table


def giver_days(spark: SparkSession, d: str) -> DataFrame:
    gifts = latest_version(
        table(spark, d, "giving_gifts"), ["gift_id"], "created_at", ["pco_person_id", "received_at", "amount_cents"]
    )
    facts = gifts.select(plain_id(F.col("pco_person_id")).alias("giver"), F.to_date("received_at").alias("day"), F.col("amount_cents").cast("long").alias("cents"))
    return trailing_totals(facts, "giver", "day", "cents")


def ad_days(spark: SparkSession, d: str) -> DataFrame:
    facts = latest_version(table(spark, d, "meta_ad_insights"), ["ad_id", "day"], "created_at", ["spend"])
    return trailing_totals(facts, "ad_id", "day", "spend")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    ads = ad_days(spark, d).where((F.col("total_7") == 0) & (F.col("total_30") > 0))
    older = F.col("total_30") - F.col("total_7")
    givers = giver_days(spark, d).where((F.col("n") > 0) & (older > 0) & (older < F.col("total_7")))
    pick = lambda df, kind: df.select(F.lit(kind).alias("kind"), F.col("entity").alias("entity_id"), F.date_format("day", "yyyy-MM-dd").alias("day_text"))
    return pick(ads, "ad").unionByName(pick(givers, "giver"))


def _days(df: DataFrame) -> DataFrame:
    money = [F.col(c).cast("decimal(18,2)").alias(c) for c in ("total", "total_7", "total_30")]
    return df.select("entity", "day", "n", *money, "avg_7", "avg_30")


def p1_giver_days(spark: SparkSession, d: str) -> DataFrame:
    """Every day of each giver with totals and averages of both periods."""
    return _days(giver_days(spark, d))


def p1_ad_days(spark: SparkSession, d: str) -> DataFrame:
    """Every day of each ad with totals and averages of both periods."""
    return _days(ad_days(spark, d))


def _rolled(df: DataFrame) -> DataFrame:
    """Per entity: days covered, days with activity, peaks of the trailing periods."""
    return df.groupBy("entity").agg(
        F.count(F.lit(1)).alias("days"),
        F.count_if(F.col("n") > 0).alias("active_days"),
        F.sum("total").cast("decimal(18,2)").alias("grand_total"),
        F.max("total_7").cast("decimal(18,2)").alias("peak_7"),
        F.max("total_30").cast("decimal(18,2)").alias("peak_30"),
        F.round(F.sum(F.col("total_30").cast("decimal(18,2)")) / 30, 2).cast("double").alias("sum_avg_30"),
    )


def p1_giver_rollup(spark: SparkSession, d: str) -> DataFrame:
    return _rolled(giver_days(spark, d))


def p1_ad_rollup(spark: SparkSession, d: str) -> DataFrame:
    return _rolled(ad_days(spark, d))


def references(spark: SparkSession, d: str) -> DataFrame:
    def refs(name: str, rid: str, target: str, key: str, at: str) -> DataFrame:
        return table(spark, d, name).select(
            F.lit(name).alias("ref_table"), F.col(rid).alias("record_id"), F.lit(target).alias("target"), plain_id(F.col(key)).alias("key"), F.col(at).alias("ref_at")
        )

    return (
        refs("giving_gifts", "gift_id", "pco_people", "pco_person_id", "received_at")
        .unionByName(refs("pco_group_memberships", "membership_id", "pco_people", "pco_person_id", "joined_at"))
        .unionByName(refs("pursuit_cards", "card_id", "pursuit_people", "person_id", "created_at"))
    )


def parents(spark: SparkSession, d: str) -> DataFrame:
    def keys(name: str, key: str) -> DataFrame:
        return table(spark, d, name).select(F.lit(name).alias("target"), plain_id(F.col(key)).alias("key"), F.col("created_at").alias("since")).where(F.col("key").isNotNull())

    return keys("pco_people", "pco_person_id").unionByName(keys("pursuit_people", "id"))


def reference_state(spark: SparkSession, d: str) -> DataFrame:
    """State of every reference after one increment that holds the whole tables."""
    state, _ = advance(empty_state(spark), empty_index(spark), references(spark, d), parents(spark, d))
    return state


#: Quarters of the replay: everything older comes with the first, everything later with the last.
QUARTERS = [f"{y}Q{q}" for y in (2023, 2024, 2025) for q in (1, 2, 3, 4)][3:]


def _quarter(at):
    q = F.concat(F.year(at).cast("string"), F.lit("Q"), F.quarter(at).cast("string"))
    return F.least(F.greatest(F.coalesce(q, F.lit(QUARTERS[0])), F.lit(QUARTERS[0])), F.lit(QUARTERS[-1]))


def p5_replay(spark: SparkSession, d: str) -> DataFrame:
    """Snapshots after each quarter of a replay through the state: per table references, waiting, reopened and late ones.

    Records come in the quarter of their own time, parents in that of their created_at. A person of
    the roster whose last re-sync says inactive counts as deleted after the quarter of that re-sync.
    """
    refs = stable(references(spark, d).withColumn("quarter", _quarter(F.col("ref_at"))))
    come = stable(parents(spark, d).withColumn("quarter", _quarter(F.col("since"))))
    last = F.max(F.struct(F.coalesce("updated_at", F.lit("1900-01-01").cast("timestamp_ntz")), F.coalesce("src_status", F.lit("")))).alias("l")
    roster = table(spark, d, "pco_people").select(plain_id(F.col("pco_person_id")).alias("key"), "updated_at", "src_status").where("key is not null").groupBy("key").agg(last)
    left = stable(roster.where("l.col2 = 'inactive'").select(F.lit("pco_people").alias("target"), "key", _quarter(F.col("l.col1")).alias("quarter")))
    state, index, counts = empty_state(spark), empty_index(spark), []
    for k, q in enumerate(QUARTERS):
        gone = left.where(F.col("quarter") == QUARTERS[k - 1]) if k else None
        state, index = advance(state, index, refs.where(F.col("quarter") == q), come.where(F.col("quarter") == q), gone, at=f"{q[:4]}-{int(q[5]) * 3 - 2:02d}-01")
        state, index = stable(state), stable(index)
        counts.append(standing(state).withColumn("quarter", F.lit(q)))
    return reduce(DataFrame.unionByName, counts).select("quarter", "ref_table", "refs", "waiting", "reopened", "late")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return problems(reference_state(spark, d))


def p5_snapshots(spark: SparkSession, d: str) -> DataFrame:
    return snapshots(reference_state(spark, d))


QUERIES = {"p1_found": p1_found, "p1_giver_days": p1_giver_days, "p1_ad_days": p1_ad_days, "p1_giver_rollup": p1_giver_rollup, "p1_ad_rollup": p1_ad_rollup, "p5_found": p5_found, "p5_snapshots": p5_snapshots, "p5_replay": p5_replay}

_PLAIN = r"nullif(regexp_replace(regexp_replace(lower(regexp_replace({c}, '^\s+|\s+$', '', 'g')), '^(\d+)\.0+$', '\1'), '^0+(\d+)$', '\1'), '')"


def plain_sql(c: str) -> str:
    return _PLAIN.replace("{c}", c)


_GIVER = f"""facts as (select {plain_sql('pco_person_id')} entity, cast(received_at as date) "day", cast(coalesce(amount_cents,0) as decimal(18,2)) v
 from (select *, row_number() over (partition by gift_id order by created_at desc nulls last, pco_person_id desc nulls last, received_at desc nulls last, amount_cents desc nulls last) rn from giving_gifts where gift_id is not null) where rn=1)"""
_AD = """facts as (select ad_id entity, "day", cast(coalesce(spend,0) as decimal(18,2)) v
 from (select *, row_number() over (partition by ad_id, "day" order by created_at desc nulls last, spend desc nulls last) rn from meta_ad_insights where ad_id is not null and "day" is not null) where rn=1)"""
_DENSE = """, daily as (select entity, "day", sum(v) total, count(*) n from facts where entity is not null and "day" is not null group by 1,2),
spine as (select entity, cast(unnest(generate_series(min("day"), max("day"), interval 1 day)) as date) "day" from daily group by entity),
dense as (select s.entity, s."day", coalesce(d.total,0) total, coalesce(d.n,0) n from spine s left join daily d on d.entity=s.entity and d."day"=s."day"),
rolled as (select *, sum(total) over (partition by entity order by "day" rows between 6 preceding and current row) total_7,
 sum(total) over (partition by entity order by "day" rows between 29 preceding and current row) total_30 from dense)"""
_ROLL = """ select entity, count(*) "days", count(*) filter (where n>0) active_days, cast(sum(total) as decimal(18,2)) grand_total, cast(max(total_7) as decimal(18,2)) peak_7,
 cast(max(total_30) as decimal(18,2)) peak_30, cast(round(cast(sum(total_30) as decimal(28,6))/30, 2) as double) sum_avg_30 from rolled group by entity"""
_DAYS = """ select entity, "day", n, cast(total as decimal(18,2)) total, cast(total_7 as decimal(18,2)) total_7, cast(total_30 as decimal(18,2)) total_30,
 cast(total_7 as double)/7 avg_7, cast(total_30 as double)/30 avg_30 from rolled"""
_STATE = f"""with refs as (
 select 'giving_gifts' ref_table, gift_id record_id, 'pco_people' target, {plain_sql('pco_person_id')} k, received_at ref_t from giving_gifts
 union all select 'pco_group_memberships', membership_id, 'pco_people', {plain_sql('pco_person_id')}, joined_at from pco_group_memberships
 union all select 'pursuit_cards', card_id, 'pursuit_people', {plain_sql('person_id')}, created_at from pursuit_cards),
one as (select ref_table, record_id, target, k, min(ref_t) ref_t from refs where k is not null and record_id is not null group by 1,2,3,4),
parents as (select target, k, min(since) since from (select 'pco_people' target, {plain_sql('pco_person_id')} k, created_at since from pco_people
 union all select 'pursuit_people', {plain_sql('id')}, created_at from pursuit_people) where k is not null group by 1,2),
state as (select o.*, p.since, case when p.k is null then 'absent' when p.since > o.ref_t then 'late' else 'ok' end problem from one o left join parents p on p.target=o.target and p.k=o.k)"""

_Q = "least(greatest(coalesce(year({t}) || 'Q' || quarter({t}), '2023Q4'), '2023Q4'), '2025Q4')"
_REPLAY = f"""with refs as (
 select 'giving_gifts' ref_table, gift_id record_id, 'pco_people' target, {plain_sql('pco_person_id')} k, received_at ref_t from giving_gifts
 union all select 'pco_group_memberships', membership_id, 'pco_people', {plain_sql('pco_person_id')}, joined_at from pco_group_memberships
 union all select 'pursuit_cards', card_id, 'pursuit_people', {plain_sql('person_id')}, created_at from pursuit_cards),
 r0 as (select *, {_Q.replace('{t}', 'ref_t')} q from refs where k is not null and record_id is not null),
 come as (select target, k, since, {_Q.replace('{t}', 'since')} q from (select 'pco_people' target, {plain_sql('pco_person_id')} k, created_at since from pco_people union all select 'pursuit_people', {plain_sql('id')}, created_at from pursuit_people) where k is not null),
 l as (select {plain_sql('pco_person_id')} k, max({{'a': coalesce(updated_at, timestamp '1900-01-01'), 'b': coalesce(src_status, '')}}) l from pco_people where {plain_sql('pco_person_id')} is not null group by 1),
 gone as (select 'pco_people' target, k, {_Q.replace('{t}', 'l.a')} g from l where l.b = 'inactive'),
 qs as (select unnest([{', '.join(f"'{q}'" for q in QUARTERS)}]) q),
 -- At the end of quarter Q a deletion of an earlier quarter holds; what came later than it counts.
 there as (select qs.q, c.target, c.k, min(c.since) since from qs join come c on c.q <= qs.q left join gone g on g.target = c.target and g.k = c.k and g.g < qs.q where g.k is null or c.q > g.g group by 1, 2, 3),
 ever as (select c.target, c.k, min(c.q) q from come c group by 1, 2),
 one as (select qs.q, r.ref_table, r.record_id, r.target, r.k, min(r.ref_t) ref_t, min(r.q) rq from qs join r0 r on r.q <= qs.q group by 1, 2, 3, 4, 5)
 select o.q as quarter, o.ref_table, cast(count(*) as bigint) as refs, cast(count(*) filter (where t.k is null) as bigint) as waiting,
 cast(count(*) filter (where t.k is null and e.k is not null and g.k is not null and greatest(e.q, o.rq) <= g.g) as bigint) as reopened, cast(count(*) filter (where t.since > o.ref_t) as bigint) as late
 from one o left join there t on t.q = o.q and t.target = o.target and t.k = o.k left join ever e on e.target = o.target and e.k = o.k left join gone g on g.target = o.target and g.k = o.k and g.g < o.q group by 1, 2"""

ORACLE = {
    "p5_replay": _REPLAY,
    "p1_found": "with a as (with " + _AD + _DENSE + " select 'ad' kind, entity entity_id, strftime(\"day\",'%Y-%m-%d') day_text from rolled where total_7=0 and total_30>0), g as (with " + _GIVER + _DENSE
    + " select 'giver' kind, entity entity_id, strftime(\"day\",'%Y-%m-%d') day_text from rolled where n>0 and total_30-total_7>0 and total_30-total_7<total_7) select * from a union all select * from g",
    "p1_giver_days": "with " + _GIVER + _DENSE + _DAYS,
    "p1_ad_days": "with " + _AD + _DENSE + _DAYS,
    "p1_giver_rollup": "with " + _GIVER + _DENSE + _ROLL,
    "p1_ad_rollup": "with " + _AD + _DENSE + _ROLL,
    "p5_found": _STATE + " select distinct ref_table, record_id, problem from state where problem<>'ok'",
    "p5_snapshots": _STATE + """, long as (select ref_table, cast(date_trunc('month', ref_t) as date) period, 1 refs, case when problem<>'ok' then 1 else 0 end opened, 0 resolved from state
 union all select ref_table, cast(date_trunc('month', since) as date), 0, 0, 1 from state where problem='late'),
g as (select ref_table, period, cast(sum(refs) as bigint) refs, cast(sum(opened) as bigint) opened, cast(sum(resolved) as bigint) resolved from long group by 1,2)
select *, cast(sum(opened-resolved) over (partition by ref_table order by period nulls first rows unbounded preceding) as bigint) waiting from g""",
}
